"""Fill-in-middle: texts cut twice between units and put in another order, with sentinels.

A unit is a word with the white space before it; white space at the end of a text is
one more. One automaton over bytes knows whether it is between units and how much of a
sentinel it has read. Its table gives the next state and what a step emits: a code
point begins, a unit has ended, a sentinel is complete. Many pieces of the texts run
through the table side by side, each warmed up on the bytes before it, since the state
hangs on the last few bytes alone. The first pass counts what was emitted, by text;
the second finds the bytes where the drawn cuts lie.

Null text counts as empty. Empty texts, texts that hold a sentinel and those that
aren't drawn stay plain. Ids draw by their decimal digits: rows of one id draw alike
numbers, a null id draws by the empty string. Repeated rows each give a row, an empty
table none. Very long texts are cut whole; a task holds one step of texts, or one text.
Bytes that are no UTF-8 become replacement characters first. Extra columns ride along
in transform(), whatever their names, and aren't read by digests().
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import sha, ship, text_steps, tidy

#: Prefix, suffix and middle sentinels, and the white space between words.
SENTINELS = ("<P>", "<S>", "<M>")
SPACE = b"\t\n\x0b\x0c\r "

#: What a step of the automaton emits.
POINT, UNIT, SENTINEL = 1, 2, 4
#: Stands after each text; no byte of UTF-8 is equal to it.
END = 0xFF
#: Bytes of a piece that the automaton reads beside the other pieces.
PIECE = 1024

PLAIN, PSM, SPM = "plain", "psm", "spm"


class Rates(NamedTuple):
    """Percent of texts that are transformed, and of these the percent with the suffix first."""

    transformed: int = 50
    suffix_first: int = 80


class Table(NamedTuple):
    following: np.ndarray  # state * 256 + byte -> state
    emitted: np.ndarray  # state * 256 + byte -> bits
    reach: int  # bytes that fix the state


@functools.cache
def table(sentinels: tuple[str, ...]) -> Table:
    """The automaton. A state is (at a text's start, in white space or in a word) and a prefix of a sentinel."""
    marks = [s.encode() for s in sentinels]
    heads = sorted({m[:i] for m in marks for i in range(len(m))})  # what has been read of a sentinel
    number = {(part, head): i for i, (part, head) in enumerate((p, h) for p in range(3) for h in heads)}
    following, emitted = np.zeros((len(number), 256), np.int32), np.zeros((len(number), 256), np.uint8)
    for (part, head), state in number.items():
        for byte in range(256):
            if byte == END:
                emitted[state, byte] = UNIT if part else 0
                following[state, byte] = number[0, b""]
                continue
            seen = head + bytes([byte])
            space = byte in SPACE
            bits = 0 if 0x80 <= byte < 0xC0 else POINT  # a byte that goes on a code point begins none
            bits |= UNIT if space and part == 2 else 0
            bits |= SENTINEL if any(seen.endswith(m) for m in marks) else 0
            rest = next(seen[i:] for i in range(len(seen) + 1) if seen[i:] in heads)
            following[state, byte], emitted[state, byte] = number[1 if space else 2, rest], bits
    return Table(following.ravel() * 256, emitted.ravel(), max(map(len, marks), default=1))


def emissions(data: np.ndarray, automaton: Table) -> np.ndarray:
    """What the automaton emits at every byte of data, which begins with a text."""
    n = len(data)
    pieces = -(-n // PIECE)
    padded = np.full(automaton.reach + pieces * PIECE, END, np.uint8)
    padded[automaton.reach : automaton.reach + n] = data
    # a column a piece, with the bytes before it on top
    lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, automaton.reach + PIECE)[::PIECE].T)
    out = np.empty((PIECE, pieces), np.uint8)
    state = np.zeros(pieces, np.int32)
    for i, column in enumerate(lanes):
        at = state + column
        if i >= automaton.reach:
            out[i - automaton.reach] = automaton.emitted[at]
        state = automaton.following[at]
    return out.T.reshape(-1)[:n]


def draws(seed: int, doc_id: object) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


class Cut(NamedTuple):
    n: int
    form: str
    output: bytes
    prefix_chars: int | None
    middle_chars: int | None


def cuts(ids: Sequence[object], texts: Sequence[bytes], seed: int, rates: Rates, sentinels: tuple[str, str, str]) -> Iterator[Cut]:
    """How each text is cut and what comes of it."""
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    found = emissions(data, table(sentinels))
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - [len(t) + 1 for t in texts]
    # first pass: counts by text
    units = np.flatnonzero(found & UNIT)  # a unit's end is the byte after it
    marked = np.flatnonzero(found & SENTINEL)
    first_unit, past_unit = np.searchsorted(units, starts), np.searchsorted(units, ends)
    has_mark = np.searchsorted(marked, ends) > np.searchsorted(marked, starts)
    p, s, m = (x.encode() for x in sentinels)
    for i, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
        n = int(past_unit[i] - first_unit[i])
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not text or has_mark[i] or h3 % 100 >= rates.transformed:
            yield Cut(n, PLAIN, text, None, None)
            continue
        # second pass: the bytes of the two cuts
        begin, (one, two) = int(starts[i]), sorted((h1 % (n + 1), h2 % (n + 1)))
        place = lambda k: int(units[first_unit[i] + k - 1]) if k else begin  # noqa: B023, E731
        a, b = place(one), place(two)
        points = [int(np.count_nonzero(found[x:y] & POINT)) for x, y in ((begin, a), (a, b))]
        prefix, middle, suffix = text[: a - begin], text[a - begin : b - begin], text[b - begin :]
        if h4 % 100 < rates.suffix_first:
            yield Cut(n, SPM, b"".join((s, suffix, p, prefix, m, middle)), *points)
        else:
            yield Cut(n, PSM, b"".join((p, prefix, s, suffix, m, middle)), *points)


def restored(output: bytes, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> bytes:
    """The text that an output was made of. No text that was cut holds a sentinel, so each stands where it was put."""
    if form == PLAIN:
        return output
    p, s, m = (x.encode() for x in sentinels)
    opening, between = (p, s) if form == PSM else (s, p)
    one, _, rest = output.removeprefix(opening).partition(between)
    two, _, middle = rest.partition(m)
    return one + middle + two if form == PSM else two + middle + one


def _checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    """Sentinels that can't run into each other or into a text's ends."""
    p, s, m = sentinels
    for a in (p, s, m):
        if not a or any(a[:i] == b[-i:] for b in (p, s, m) for i in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError(f"no sentinel may be empty, hold or overlap another: {list(sentinels)}")
        if any(a != b and a in b for b in (p, s, m)):
            raise ValueError(f"no sentinel may be empty, hold or overlap another: {list(sentinels)}")
    return p, s, m


def _mapped(rows: DataFrame, schema: str, make: Callable[[list[Cut]], list[pa.Array]], seed: int, rates: Rates, sentinels: Sequence[str], keep: bool) -> DataFrame:
    """rows (id, text, then what rides along), and after id or all of them what make gives of a step's cuts."""
    ship(rows.sparkSession)
    marks = _checked(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_steps(batch.column(1)):
                part = batch.slice(a, b - a)
                found = list(cuts(part.column(0).to_pylist(), texts, seed, rates, marks))
                arrays = [*(part.columns if keep else part.columns[:1]), *make(found)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    return rows.mapInArrow(tidy(run), schema)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rates: Rates = Rates(), sentinels: Sequence[str] = SENTINELS) -> DataFrame:  # noqa: B008
    """docs and fim: a struct of n (units), form, text, prefix_chars and middle_chars (null if plain)."""
    kind = "n long, form string, text string, prefix_chars long, middle_chars long"
    rows = docs.select(F.col(id_col).alias("c0"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("c1"), F.struct(*docs.columns).alias("c2"))
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema)] + [f"c{i + 3} {k.split()[1]}" for i, k in enumerate(kind.split(", "))])

    def make(found: list[Cut]) -> list[pa.Array]:
        return [pa.array([c.n for c in found], pa.int64()), pa.array([c.form for c in found]), pa.array([c.output for c in found], pa.binary()).cast(pa.string()), *_points(found)]

    out = _mapped(rows, schema, make, seed, rates, sentinels, keep=True)
    fim = F.struct(*[F.col(f"c{i + 3}").alias(k.split()[0]) for i, k in enumerate(kind.split(", "))])
    return out.select(*[F.col("c2").getField(c).alias(c) for c in docs.columns], fim.alias("fim"))


def _points(found: list[Cut]) -> list[pa.Array]:
    return [pa.array([c.prefix_chars for c in found], pa.int64()), pa.array([c.middle_chars for c in found], pa.int64())]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rates: Rates = Rates(), sentinels: Sequence[str] = SENTINELS) -> DataFrame:  # noqa: B008
    """One row a document: id, n, form, prefix_chars, middle_chars, output_sha256, and restored_sha256 of what is rebuilt from output and form."""
    marks = _checked(sentinels)
    rows = docs.select(F.col(id_col).alias("c0"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("c1"))

    def make(found: list[Cut]) -> list[pa.Array]:
        return [pa.array([c.n for c in found], pa.int64()), pa.array([c.form for c in found]), *_points(found), pa.array([sha(c.output) for c in found]), pa.array([sha(restored(c.output, c.form, marks)) for c in found])]

    kind = docs.schema[id_col].dataType.simpleString()
    out = _mapped(rows, f"c0 {kind}, c1 long, c2 string, c3 long, c4 long, c5 string, c6 string", make, seed, rates, sentinels, keep=False)
    return out.toDF(id_col, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: DuckDB's version of digests() over documents, with the defaults.
DIGESTS_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM documents),
d AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p"""
