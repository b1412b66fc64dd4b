"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Entropy spans: a candidate is a maximal run of ``[A-Za-z0-9+/_=-]`` of MIN_RUN
characters or more. A window of WINDOW characters slides over it; counts change
by one character in and one out, and the window's Shannon entropy is compared
with the threshold of the character class that the window falls in (hex of
either case, alphanumeric, full, or letters that change their case again and
again). Windows over the threshold merge to a span, and a span widens to the ends of
the values between separators that it touches, and over slashes to what doesn't look
like a word, so no end of a secret stays outside; words at its ends are left out. Allow-listed candidates are
dropped, and of longer ones the values between separators that hold a placeholder;
what stands beside these is a candidate of its own. A span that patterns' spans cover
is dropped; one that reaches beyond them stays whole. Words, paths and names in camel
case have no class: windows of letters alone need CHANGES of case.

Null text counts as empty: no spans, the hash of the empty string. Repeated rows
and ids, and null ids, each give a row. An empty table gives no rows. Very long
texts are scanned whole, in time that grows with their length. Extra columns, of
any name, are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import sha, ship, steps, text_steps, tidy

WINDOW = 20
MIN_RUN = 20
#: Bits a character that a window must exceed, by class.
THRESHOLD = {"hex": 2.9, "alnum": 3.6, "full": 3.7, "letters": 3.7}
#: In a window without a digit: letters of either case, and neighbours of different case, at least.
OF_EITHER_CASE, CHANGES = 7, 7
KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Not secrets, however high their entropy.
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
        r"\d{4}-\d{2}-\d{2}[T_]?[\d-]*",  # dates and times
        r"[\d+/=_-]+",  # figures alone
    )
)
#: A value between separators that holds one of these is not a secret.
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|lorem|xxxx|0123456789|abcdefgh")
SEPARATORS = "/=_-"
VALUE = re.compile(r"[^/=_-]+")
PADDING = re.compile(r"={1,2}\Z")
#: A part of a path, over which a span doesn't widen.
WORD = re.compile(r"[a-z]{3,}|[A-Z][a-z]{2,}|\d{1,4}")

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN_BYTE = np.zeros(256, bool)
_RUN_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_CLOG = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]  # one character comes before one goes


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in LONG_HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _window_class(digits: int, lower: int, upper: int, other: int, hexes: int, changes: int) -> str | None:
    if hexes == WINDOW and digits:
        return "hex"
    if digits and (lower or upper):
        return "full" if other else "alnum"
    if not digits and min(lower, upper) >= OF_EITHER_CASE and changes >= CHANGES:
        return "letters"
    return None


def entropy_spans(run: str) -> list[tuple[int, int]]:
    """Merged windows of a candidate whose entropy exceeds the threshold of their class."""
    counts: dict[str, int] = {}
    tally = [0, 0, 0, 0, 0, 0]  # digits, lower, upper, other, hex digits, changes of case
    weight = 0.0  # sum of c log2 c
    out: list[tuple[int, int]] = []

    def kinds(c: str) -> tuple[int, ...]:
        if c.isdigit():
            return (0, 4)
        if c in "abcdefABCDEF":
            return (1 if c.islower() else 2, 4)
        return (1,) if c.islower() else (2,) if c.isupper() else (3,)

    def changed(i: int) -> bool:
        return run[i - 1].isalpha() and run[i].isalpha() and run[i - 1].islower() != run[i].islower()

    for i, c in enumerate(run):
        n = counts.get(c, 0)
        weight += _CLOG[n + 1] - _CLOG[n]
        counts[c] = n + 1
        for k in kinds(c):
            tally[k] += 1
        tally[5] += i > 0 and changed(i)
        if i >= WINDOW:
            gone = run[i - WINDOW]
            n = counts[gone]
            weight += _CLOG[n - 1] - _CLOG[n]
            counts[gone] = n - 1
            for k in kinds(gone):
                tally[k] -= 1
            tally[5] -= changed(i - WINDOW + 1)
        if i >= WINDOW - 1:
            kind = _window_class(*tally)
            if kind and math.log2(WINDOW) - weight / WINDOW > THRESHOLD[kind]:
                start = i - WINDOW + 1
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
    return out


def flagged(part: str) -> list[tuple[int, int]]:
    """entropy_spans() of a candidate, each widened to whole values, without words at its ends; spans that then meet are one."""
    found = entropy_spans(part)
    if not found:
        return []
    values = [m.span() for m in VALUE.finditer(part)]
    starts, ends = [s for s, _ in values], [e for _, e in values]

    def word(i: int) -> bool:
        return WORD.fullmatch(part, starts[i], ends[i]) is not None

    def joins(i: int, j: int) -> bool:
        """Whether the value j goes on from its neighbour i: over one slash, and no word."""
        left, right = min(i, j), max(i, j)
        return starts[right] == ends[left] + 1 and part[ends[left]] == "/" and not word(j)

    out: list[tuple[int, int]] = []
    for s, e in found:
        if out and e <= out[-1][1]:
            continue
        i, j = bisect_right(ends, s), bisect_left(starts, e) - 1  # the first and the last value that it touches
        while i < j and word(i):  # a window begins in the path before a secret
            i += 1
        while i < j and word(j):
            j -= 1
        while i > 0 and (not out or starts[i] > out[-1][1]) and joins(i, i - 1):
            i -= 1
        while j + 1 < len(values) and joins(j, j + 1):
            j += 1
        s, e = starts[i], ends[j]
        if PADDING.match(part, e):  # what fills up base64
            e = len(part)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def candidates(run: str) -> Iterator[tuple[int, str]]:
    """(start, text) of what is to be tested of a run: all of it, or what stands between its placeholders."""
    at = 0
    found = [m for m in VALUE.finditer(run) if PLACEHOLDER.search(m.group())] if PLACEHOLDER.search(run) else []
    for m in [*found, None]:
        part = run[at : m.start() if m else len(run)]
        if m or at:
            at += len(part) - len(part.lstrip(SEPARATORS))
            part = part.strip(SEPARATORS)
        if len(part) >= MIN_RUN and not allowed(part):
            yield at, part
        at = m.end() if m else at


def allowed(run: str) -> bool:
    return any(p.fullmatch(run) for p in ALLOW)


def united(base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans sorted by start as the stretches that they cover together."""
    out: list[tuple[int, int]] = []
    for s, e, _ in base:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The patterns' spans, and all spans with those of the entropy test. Runs go forward, and the stretches with them."""
    base = base_spans(text)
    stretches, i = united(base), 0
    more = []
    for m in RUN.finditer(text):
        if allowed(m.group()):
            continue
        for at, part in candidates(m.group()):
            for s, e in flagged(part):
                s, e = s + at + m.start(), e + at + m.start()
                while i < len(stretches) and stretches[i][1] < e:
                    i += 1
                if i == len(stretches) or stretches[i][0] > s:
                    more.append((s, e, "entropy"))
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def suspects(texts: list[bytes]) -> np.ndarray:
    """Which texts can hold a span: a key word, an access prefix, or a run of MIN_RUN characters."""
    flags = np.zeros(len(texts), bool)
    for a, b in steps(texts):
        joined = b"\n".join(texts[a:b]) + b"\n"
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        stops = np.flatnonzero(~_RUN_BYTE[np.frombuffer(joined, np.uint8)])
        long = stops[np.diff(stops, prepend=-1) > MIN_RUN]
        flags[a + np.searchsorted(ends, long, side="right")] = True
        low = joined.translate(_LOWER)
        if any(w in low for w in WORDS) or b"akia" in low:
            for i in range(a, b):
                if not flags[i]:
                    t = texts[i].translate(_LOWER)
                    flags[i] = b"akia" in t or any(w in t for w in WORDS)
    return flags


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


DIGEST = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(column: pa.Array) -> Iterator[tuple[int, str, list, list]]:
    """(row, text, base spans, all spans) of the texts that hold any."""
    for a, _, texts in text_steps(column):
        for i in np.flatnonzero(suspects(texts)).tolist():
            text = texts[i].decode("utf-8", "replace")
            base, spans = all_spans(text)
            if spans:
                yield a + i, text, base, spans


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_assign, n_access, n_hex, base_sha256 and spans."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = sha(b"")
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((3, n), np.int64)
            digest, spans = [none] * n, [""] * n
            for i, _, base, found in _scan(batch.column(1)):
                for _, _, k in base:
                    counts[KINDS.index(k), i] += 1
                digest[i], spans[i] = sha(joined(base).encode()), joined(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest), pa.array(spans)], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(tidy(rows), f"id {kind}, {DIGEST}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span's text replaced; overlapping spans become one mask. All rows and columns stay."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: dict[int, str] = {}
            for i, text, _, spans in _scan(batch.column(at)):
                out, done = [], 0
                for s, e, _ in spans:
                    if s >= done:
                        out += [text[done:s], mask]
                    done = max(done, e)
                new[i] = "".join([*out, text[done:]])
            if not new:
                yield batch
                continue
            old = batch.column(at)
            hit = np.zeros(batch.num_rows, bool)
            hit[list(new)] = True
            texts = pc.replace_with_mask(old, pa.array(hit), pa.array([new[i] for i in sorted(new)], old.type))
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(tidy(rows), docs.schema)
