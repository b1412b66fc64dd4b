"""Byte-level BPE by merge replay over the vocabulary of a task's part of the corpus.

Texts are cut by the tokenizer's pattern. The distinct pieces of a segment that the
task hasn't met yet form one symbol sequence; an inverted index leads from each
merge (by rank) to the positions of its pair. Merges are applied in rank order,
every occurrence of a merge at once, and each changes only the entries of the
touched neighbours. Merged pieces are kept for the segments that follow; beyond
MEMO, only those that the last segment had twice or more. This changes no result.

Two pieces of a rank file need care, and get it: a piece that is itself a token
is that token, and a merge can give rise to a pair of lower rank, in which case
the piece is done again one merge at a time.

The rank file is read on the driver and broadcast, MOST_BYTES at most; its path need
not exist where the tasks run. Null text counts as empty: no tokens. Repeated rows
and ids, and null ids, each give a row. An empty table gives no rows. Very long
texts are encoded whole. Extra columns, of any name, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain, islice
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ship, text_steps, tidy, trim

#: Text bytes of a segment: its distinct pieces are merged together.
SEGMENT_BYTES = 3 << 20
#: Merged pieces that a task keeps, of some 300 bytes each.
MEMO = 150_000
#: A rank file may have this size; it goes to every executor.
MOST_BYTES = 64 << 20
#: Pairs that are looked up at once.
RANKED = 1 << 16
NONE = np.int32(1 << 30)


class Merges:
    """The ranks of a vocabulary and the table of pairs that merge."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.width = max(self.ranks.values()) + 1
        byte_id = np.full(256, -1, np.int32)
        for c in range(256):
            byte_id[c] = self.ranks.get(bytes([c]), -1)
        if (byte_id < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.byte_id = byte_id
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        self.keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(self.keys)
        self.values = np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.keys = self.keys[order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, or NONE."""
        if len(left) > RANKED:  # wide figures of a part at a time
            return np.concatenate([self.rank(left[a : a + RANKED], right[a : a + RANKED]) for a in range(0, len(left), RANKED)])
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def one_by_one(self, piece: bytes) -> list[int]:
        """The leftmost pair of lowest rank, again and again: a heap of pairs, outdated ones skipped."""
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int) -> tuple[int, int, int] | None:
            j = after[i]
            r = self.ranks.get(parts[i] + parts[j]) if j < n else None
            return None if r is None else (r, i, j)

        heap = [x for i in range(n) if (x := pair(i))]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or parts[j] is None or self.ranks.get(parts[i] + parts[j]) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (x := pair(k)):
                    heapq.heappush(heap, x)
        return [self.ranks[p] for p in parts if p is not None]

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of every piece."""
        out: list[list[int] | None] = [None if (r := self.ranks.get(p)) is None else [r] for p in pieces]
        todo = [i for i, x in enumerate(out) if x is None and pieces[i]]
        if todo:
            for i, ids in zip(todo, self._merged([pieces[i] for i in todo]), strict=True):
                out[i] = ids
        return [x or [] for x in out]

    def _merged(self, pieces: list[bytes]) -> list[list[int]]:
        tok = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(tok)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[starts] = -1
        alive = np.ones(n, bool)
        now = np.full(n, NONE, np.int32)  # what the pair that begins here merges to
        has = np.flatnonzero(after >= 0).astype(np.int32)
        now[has] = self.rank(tok[has], tok[has + 1])
        has = has[now[has] < NONE]
        order = has[np.argsort(now[has], kind="stable")]
        ranks, first = np.unique(now[order], return_index=True)
        index: dict[int, list] = {int(r): [p] for r, p in zip(ranks, np.split(order, first[1:]), strict=False)}  # none: split still gives one part
        heap = [int(r) for r in ranks]  # sorted, so a heap
        again: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r, None)
            if held is None:
                continue
            p = np.unique(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
            p = p[alive[p] & (now[p] == r)]
            if not len(p):
                continue
            if (clash := np.flatnonzero(after[p[:-1]] == p[1:])).size:  # as in "aaa": the left one goes first
                drop, last = set(), -2
                for i in clash.tolist():
                    if i != last:
                        drop.add(i + 1)
                        last = i + 1
                    else:
                        last = -2
                p = np.delete(p, sorted(drop))
            q = after[p]
            tok[p] = r
            alive[q] = False
            now[q] = NONE
            nxt = after[q]
            after[p] = nxt
            now[p] = NONE
            right = nxt >= 0
            before[nxt[right]] = p[right]
            touched = p[right]
            left = before[p]
            left = left[left >= 0]
            touched = np.unique(np.concatenate([touched, left]))
            if not len(touched):
                continue
            fresh = self.rank(tok[touched], tok[after[touched]])
            now[touched] = fresh
            good = fresh < NONE
            at, fresh = touched[good], fresh[good]
            if not len(at):
                continue
            if (low := at[fresh < r]).size:
                again.update(np.searchsorted(ends, low, side="right").tolist())
            order = np.argsort(fresh, kind="stable")
            at, fresh = at[order], fresh[order]
            cuts = np.flatnonzero(np.diff(fresh)) + 1
            for new, group in zip(fresh[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if new in index:
                    index[new].append(group)
                else:
                    index[new] = [group]
                    heapq.heappush(heap, new)
        left = np.flatnonzero(alive)
        ids = tok[left].tolist()
        bounds = np.searchsorted(left, ends).tolist()
        out, a = [], 0
        for b in bounds:
            out.append(ids[a:b])
            a = b
        for i in again:
            out[i] = self.one_by_one(pieces[i])
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class Pieces:
    """The distinct pieces that a task has met, numbered, with lists of what each function of makes of their ids."""

    def __init__(self, m: Merges, *of: Callable[[list[int]], Any]):
        self.m, self.of = m, of or (lambda ids: ids,)
        self.number: dict[str, int] = {}
        self.made: list[list[Any]] = [[] for _ in self.of]

    def _shrink(self, held: list[list[int]]) -> None:
        """Go on with the pieces that the last segment had twice or more."""
        used = np.bincount(np.fromiter(chain.from_iterable(held), np.int32), minlength=len(self.number))
        keep = [(p, i) for p, i in self.number.items() if used[i] > 1][:MEMO]
        self.made = [[x[i] for _, i in keep] for x in self.made]
        self.number = {p: i for i, (p, _) in enumerate(keep)}

    def add(self, texts: list[bytes]) -> Iterator[list[list[Any]]]:
        """For each text, what the functions make of its pieces; new pieces are merged together."""
        number, found, before = self.number, self.m.pattern.findall, len(self.number)
        held = [[number.setdefault(p, len(number)) for p in found(t.decode("utf-8", "replace"))] for t in texts]
        ids = self.m.replay([p.encode() for p in islice(number, before, None)])
        for x, f in zip(self.made, self.of, strict=True):
            x += map(f, ids)
        ids = None
        for h in held:
            yield [[x[i] for i in h] for x in self.made]
        if len(number) > MEMO:
            self._shrink(held)


_known: dict[tuple[str, str], Merges] = {}


def merges(ranks: bytes, pattern: str) -> Merges:
    """One table of each vocabulary in a process."""
    key = hashlib.sha256(ranks).hexdigest(), pattern
    if key not in _known:
        _known[key] = Merges(ranks, pattern)
    return _known[key]


def _ranks(spark: SparkSession, path: str) -> Broadcast[bytes]:
    data = Path(path).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the array of token ids."""
    ship(docs.sparkSession)
    kind, ranks = docs.schema[id_col].dataType.simpleString(), _ranks(docs.sparkSession, vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(merges(ranks.value, pattern))
        for batch in batches:
            for a, b, texts in text_steps(batch.column(1), SEGMENT_BYTES):
                out = [list(chain.from_iterable(held)) for (held,) in pieces.add(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(tidy(rows), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of arrays of token ids."""
    ship(tokens.sparkSession)
    kind, ranks = tokens.schema[id_col].dataType.simpleString(), _ranks(tokens.sparkSession, vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(ranks.value, pattern)
        for batch in batches:
            out = [m.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(tidy(rows), f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, and hashes of the ids and of the bytes they decode to, without building arrays of ids in rows."""
    ship(docs.sparkSession)
    kind, ranks = docs.schema[id_col].dataType.simpleString(), _ranks(docs.sparkSession, vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(ranks.value, pattern)
        pieces = Pieces(m, lambda ids: ",".join(map(str, ids)), m.decode)
        for batch in batches:
            for a, b, texts in text_steps(batch.column(1), SEGMENT_BYTES):
                n, ids_sha, text_sha = [], [], []
                for said, back in pieces.add(texts):
                    whole = ",".join(said)
                    n.append(whole.count(",") + 1 if said else 0)
                    ids_sha.append(hashlib.sha256(whole.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(back)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                said = back = whole = None
                trim()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(tidy(rows), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
