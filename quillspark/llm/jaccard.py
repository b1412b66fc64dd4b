"""Similarity join on word shingles by parity sketches.

A document's shingles are hashed to the bits of a sketch, each flipping one bit.
The Hamming distance of two sketches is then at most the size of the symmetric
difference of the sets, and sets of n and m shingles with a Jaccard similarity of
0.8 or more differ in at most (n + m) / 9 shingles.

1. Sizes fall in bands of a factor of two. A band cuts the hash space into more
   parts than two of its sets can differ in shingles (up to band FINE, every shingle
   is a part), so two similar sets agree in the whole sketch of some part
   (pigeonhole). Part sketches (as fingerprints of their bits) are the join keys; a
   document also joins the band above where a partner may lie there.
2. The documents of a key are linked to its first one, which is checked: the
   Hamming distance of whole sketches drops most pairs, the shingle sets decide the
   rest. Components of these links come next. A key that HOT documents of one step
   of a task share is linked to the first of them there and then; only that one, with
   a count, goes on to meet the key's other documents, so no task holds them all.
3. Keys whose documents still lie in several components: up to PAIRS documents,
   pairs of different components are checked. Larger keys (a passage that many
   documents share) are not used. A document keeps the guarantee if its keys that
   are in use, empty parts not counted, outnumber the shingles in which it may
   differ; a pair is safe if either document keeps it.
4. The documents that do not keep it consist of shared passages for the most part.
   Among them, shingles of up to PAIRS documents are rare. Similar sets share a
   shingle in the rarest n - 0.8 n + 1 of either, so pairs that share a rare one
   there are checked. What is left are pairs that share frequent shingles alone.
   Documents with equal sets of these form a group. If x and y share only frequent
   shingles and are similar, each is also similar to the smallest document of the
   other's group, and these two to each other; within a group, both are similar to
   its smallest. So the smallest document of each group is checked against the
   group's, and against those of other groups and the documents that are too large
   to be similar to their own group's. Only this last comparison is made in blocks,
   by sketches, and then exactly: groups against groups, never all documents.

So no link between different components is missed, whatever the skew, and no key
emits all its pairs. Documents with equal sets form a class, which takes part once.

Texts that are null or without a word have an empty set and link with nothing.
Rows with a null id have no component. Rows of one id are one document of the
component, each with its own figures; what any of them links with, all do. An empty
table gives no rows. Very long texts count whole. Extra columns, of any name, are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import binary_views, partitions, scratch, ship, stored, tidy
from .components import components
from .shingles import column_sets, mix

WORDS = 5
#: Keys of more documents, in several components, are left to the last step.
PAIRS = 24
#: Bands up to this one, of at most 2**FINE shingles, have a part for every shingle.
FINE = 6
#: Documents of a key in one step of a task from which on they go by their first one; over PAIRS.
HOT = 128
#: Parts of a band beyond the shingles in which two of its sets can differ.
SPARE = 1.3
#: Entries that a task holds before it hands them on.
HELD = 1 << 18
#: Bytes of keys and documents that a task of the key join is given.
TASK_BYTES = 24 << 20
BLOCK = 1024


def most_apart(n, m):
    """The most shingles in which sets of n and m with similarity 0.8 differ."""
    return (n + m) // 9


def band(n: int) -> int:
    """Sizes up to 2**band, over half of it."""
    return max(0, int(n - 1).bit_length())


def bands(n: int) -> list[int]:
    """A document's own band, and the next if its partners reach it."""
    own, top = band(n), band(n * 5 // 4)
    return [own] if own == top else [own, top]


def parts(level: int) -> int:
    return int(SPARE * most_apart(1 << level, 1 << level)) + 3


def reach(n: int, level: int) -> int:
    """The most shingles in which a set of n and a partner in the band's range differ."""
    return most_apart(n, min(1 << level, n * 5 // 4))


def _part(s: np.ndarray, level: int) -> np.ndarray:
    """The part of every shingle of a sorted set, in order."""
    return s if level <= FINE else ((s >> np.uint64(32)) * np.uint64(parts(level))) >> np.uint64(32)


def part_keys(s: np.ndarray, level: int) -> np.ndarray:
    """Fingerprints of the sketches of the parts that hold shingles; the low six bits tell the band."""
    part = _part(s, level)
    first = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
    keys = mix(np.bitwise_xor.reduceat(mix(s + np.uint64(level)), first) + np.uint64(level))
    return (keys & ~np.uint64(63)) | np.uint64(level)


def n_parts_held(s: np.ndarray, level: int) -> int:
    return int(np.count_nonzero(np.diff(_part(s, level)))) + 1


def sketch(s: np.ndarray) -> bytes:
    """Parity bits, at least as many as shingles; a power of two, so that sketches fold to a common size."""
    size = max(64, 1 << (len(s) * 3 // 2).bit_length())
    at = (s & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches at the smaller one's size."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


def node_of(s: np.ndarray, salt: int) -> tuple[int, int]:
    """128 bits of a set: the node of its class and what tells two classes of one node apart."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))


def sketches(texts: DataFrame, salt: int) -> DataFrame:
    """(id, n, node, other, sketch, held0, held1): one row a document; held: parts with shingles in its bands."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, other, bits, held = [], [], [], [], ([], [])
            for s in column_sets(batch.column(1), WORDS):
                n.append(len(s))
                if not len(s):
                    for x in (node, other, bits, *held):
                        x.append(None)
                    continue
                a, b = node_of(s, salt)
                node.append(a)
                other.append(b)
                bits.append(sketch(s))
                levels = bands(len(s))
                held[0].append(n_parts_held(s, levels[0]))
                held[1].append(n_parts_held(s, levels[1]) if len(levels) > 1 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, node, other)), pa.array(bits, pa.binary()), *(pa.array(x, pa.int64()) for x in held)],
                names=["id", "n", "node", "other", "sketch", "held0", "held1"],
            )

    return texts.mapInArrow(tidy(rows), "id long, n long, node long, other long, sketch binary, held0 long, held1 long")


def _entries(texts: DataFrame, salt: int, buckets: int) -> DataFrame:
    """(bucket, keys, nodes, counts, first): part keys and whose they are, packed; a class gives its keys once a batch.

    Rows without first: an entry stands for counts documents (1 where counts is null). Rows with first are lists of
    the documents that keys of one step share, first not among them; they can lie in any bucket.
    """

    def hot_runs(k: np.ndarray, v: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        """Which entries stay, for how many documents each stands, and the lists by their signs."""
        keep, count, lists = np.ones(len(k), bool), np.ones(len(k), np.int32), {}
        for r in np.flatnonzero(size >= HOT).tolist():
            a, n = int(first[r]), int(size[r])
            nodes = np.unique(v[a : a + n])
            if len(nodes) < HOT:
                continue
            keep[a + 1 : a + n] = False
            v[a], count[a] = nodes[0], len(nodes)
            level = int(k[a] & np.uint64(63))
            sign = int(mix(mix(nodes.view(np.uint64)).sum(keepdims=True) + np.uint64(level))[0])
            lists.setdefault(sign, (nodes, []))[1].append(k[a])
        return keep, count, lists

    def packed(keys: list, nodes: list) -> pa.RecordBatch:
        k, v = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(k, kind="stable")
        k, v = k[order], v[order]
        first = np.flatnonzero(np.diff(k, prepend=~k[:1]))
        size = np.diff([*first, len(k)])
        counts, lists = None, {}
        if size.max() >= HOT:
            keep, counts, lists = hot_runs(k, v, first, size)
            k, v, counts = k[keep], v[keep], counts[keep]
        bucket = (((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        ends = [*starts[1:], len(k)]
        out = [(int(bucket[a]), k[a:b].tobytes(), v[a:b].tobytes(), None if counts is None or counts[a:b].max() == 1 else counts[a:b].tobytes(), None) for a, b in zip(starts, ends, strict=True)]
        out += [(sign % buckets, np.array(ks, np.uint64).tobytes(), members[1:].tobytes(), None, int(members[0])) for sign, (members, ks) in lists.items()]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "keys", "nodes", "counts", "first"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, size = [], [], 0
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            seen: set[int] = set()
            for ok, s in zip(known.tolist(), column_sets(batch.column(1), WORDS), strict=True):
                if not ok or not len(s) or (node := node_of(s, salt)[0]) in seen:
                    continue
                seen.add(node)
                for level in bands(len(s)):
                    if reach(len(s), level):
                        keys.append(part_keys(s, level))
                        nodes.append(np.full(len(keys[-1]), node, np.int64))
                        size += len(keys[-1])
                if size >= HELD:
                    yield packed(keys, nodes)
                    keys, nodes, size = [], [], 0
        if size:
            yield packed(keys, nodes)

    return texts.mapInArrow(tidy(rows), "bucket long, keys binary, nodes binary, counts binary, first long")


#: Kinds of rows of _matched.
MEMBER, LISTED, LIST_OF = 0, 1, 2


def _matched(entries: DataFrame) -> DataFrame:
    """(kind, key, node, first, level, size, times): documents of keys that two or more share, and the key's first one.

    MEMBER: a document of a key. times keys say the same, this one stands for them; size counts what a list holds too.
    LISTED: a document of a list, which is known by its own key, and the first one that it was linked to.
    LIST_OF: the list of the key node holds documents of the key.
    """
    names = ["kind", "key", "node", "first", "level", "size", "times"]

    def batch_of(kind: int, *columns: np.ndarray | int) -> pa.RecordBatch:
        n = max(len(x) for x in columns if isinstance(x, np.ndarray))
        full = [pa.array(x.view(np.int64) if isinstance(x, np.ndarray) else np.full(n, x, np.int64), pa.int64()) for x in columns]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *full], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, counts = [], [], []
        for batch in batches:
            firsts, counted = batch.column(4).to_pylist(), batch.column(3).to_pylist()
            for first, ks, vs, cs in zip(firsts, binary_views(batch.column(1)), binary_views(batch.column(2), np.int64), counted, strict=True):
                if first is None:
                    keys.append(ks.copy())
                    nodes.append(vs.copy())
                    counts.append(np.ones(len(ks), np.int32) if cs is None else np.frombuffer(cs, np.int32))
                    continue
                level = int(ks[0] & np.uint64(63))
                name = int(mix(np.array([int(mix(vs.view(np.uint64)).sum())], np.uint64) + np.uint64(first & (1 << 64) - 1) + np.uint64(level)).view(np.int64)[0])
                yield batch_of(LISTED, np.full(len(vs), name, np.int64), vs, first, level, HOT, 0)
                yield batch_of(LIST_OF, ks, name, first, level, HOT, 0)
        if not keys:
            return
        k, v, c = np.concatenate(keys), np.concatenate(nodes), np.concatenate(counts)
        keys = nodes = counts = None
        order = np.argsort(k, kind="stable")
        k = k[order]
        same = c[order] > 1
        same[1:] |= k[1:] == k[:-1]
        same[:-1] |= k[1:] == k[:-1]
        k, order = k[same], order[same]
        v, c = v[order], c[order]
        order = np.lexsort((v, k))
        k, v, c = k[order], v[order], c[order]
        if not len(k):
            return
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])  # a class of several batches counts once
        more = np.add.reduceat(c.astype(np.int64) - 1, np.flatnonzero(fresh))
        k, v = k[fresh], v[fresh]
        first = np.flatnonzero(np.diff(k, prepend=~k[:1]))
        here = np.diff([*first, len(k)])
        beyond = np.add.reduceat(more, first)
        size = here + beyond
        level = (k & np.uint64(63)).astype(np.int64)
        # keys with the same documents say the same: one of a band is enough to check pairs, and to count keys the rest add up
        plain = (beyond == 0) & (here > 1)
        sign = mix(np.add.reduceat(mix(v.view(np.uint64)), first) + level[first].astype(np.uint64))
        _, pick, times = np.unique(sign[plain], return_index=True, return_counts=True)
        weight = (beyond > 0).astype(np.int64)
        weight[np.flatnonzero(plain)[pick]] = times
        w = np.repeat(weight, here)
        keep = w > 0
        yield batch_of(MEMBER, k[keep], v[keep], np.repeat(v[first], here)[keep], level[keep], np.repeat(size, here)[keep], w[keep])

    return entries.mapInArrow(tidy(rows), "kind int, " + ", ".join(f"{x} long" for x in names[1:]))


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches are near enough, with the ids of their classes."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where("greatest(n_a, n_b) * 4 <= least(n_a, n_b) * 5")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            most = most_apart(na, nb)
            ok = [distance(x, y) <= m for x, y, m in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "rep_a", "rep_b"]).filter(pa.array(ok, pa.bool_()))

    return rows.select("a", "b", "rep_a", "rep_b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(tidy(test), "a long, b long, rep_a long, rep_b long")


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, s): the packed shingle sets of documents. wanted (id) was written, so the planner knows its size."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [x.tobytes() for x in column_sets(batch.column(1), WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.binary())], names=["id", "s"])

    return stored(texts.join(wanted, "id", "left_semi").mapInArrow(tidy(sets), "id long, s binary"), "shingles")


def _exact(near: DataFrame, texts: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of near pairs, the links (a, b) by id: their shingle sets decide. And the sets, those of held among them, which are not made again."""
    near = stored(near.select("rep_a", "rep_b").distinct(), "near-pairs")
    wanted = near.select(F.col("rep_a").alias("id")).unionAll(near.select(F.col("rep_b").alias("id"))).distinct()
    wanted = stored(wanted if held is None else wanted.join(held.select("id"), "id", "left_anti"), "wanted")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(binary_views(batch.column(2)), binary_views(batch.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    made = _sets(texts, wanted)
    held = made if held is None else held.unionAll(made)
    a, b = held.select(F.col("id").alias("rep_a"), F.col("s").alias("s_a")), held.select(F.col("id").alias("rep_b"), F.col("s").alias("s_b"))
    rows = near.join(a, "rep_a").join(b, "rep_b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "s_a", "s_b")
    return rows.mapInArrow(tidy(test), "a long, b long"), held


def _in_blocks(centres: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (a, b) of a centre and another document, near by their sketches, in different components: block by block within a band."""
    parts_of = {}
    for side, df in (("centres", centres), ("others", others)):
        rows = df.groupBy("level").count().collect()  # a row a band: 64 at most
        parts_of[side] = F.create_map(*[F.lit(v) for r in rows for v in (r["level"], -(-r["count"] // BLOCK))])[F.col("level")].cast("int")
    at = F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("int")
    mine = centres.withColumn("i", F.pmod(at, parts_of["centres"])).withColumn("j", F.explode(F.sequence(F.lit(0), parts_of["others"] - 1))).withColumn("centre", F.lit(True))
    theirs = others.withColumn("j", F.pmod(at, parts_of["others"])).withColumn("i", F.explode(F.sequence(F.lit(0), parts_of["centres"] - 1))).withColumn("centre", F.lit(False))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        bits = [np.frombuffer(x, np.uint8) for x in pdf["sketch"]]
        size = min(map(len, bits))
        bits = np.stack([fold(x, size) for x in bits])
        node, comp, n, centre = (pdf[c].to_numpy() for c in ("node", "component", "n", "centre"))
        theirs = np.flatnonzero(~centre)
        for r in np.flatnonzero(centre).tolist():
            near = np.bitwise_count(bits[theirs] ^ bits[r]).sum(axis=1, dtype=np.int64) <= most_apart(n[theirs], n[r])
            near &= (comp[theirs] != comp[r]) & (np.maximum(n[theirs], n[r]) * 4 <= np.minimum(n[theirs], n[r]) * 5)
            out += [(node[r], x) for x in node[theirs[near]]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return mine.unionByName(theirs).groupBy("level", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _left_over(rest: DataFrame, texts: DataFrame, salt: int) -> DataFrame:
    """Candidate pairs (a, b) by node of documents (node, rep, n, sketch, component) that their keys don't cover: step 4."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = list(column_sets(batch.column(1), WORDS))
            node = [node_of(x, salt)[0] if len(x) else None for x in s]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64()))], names=["node", "s"])

    # an id may have several texts, and rows may repeat: one of each node that is left over
    wanted = stored(rest.select(F.col("rep").alias("id")).distinct(), "wanted")
    own = texts.join(wanted, "id", "left_semi").mapInArrow(tidy(shingles), "node long, s array<long>").dropDuplicates(["node"]).join(rest.select("node", "n"), "node")
    of = stored(own.select("node", "n", F.explode("s").alias("s")), "left-over-shingles")
    often = stored(of.groupBy("s").agg(F.count("*").alias("df")).where(F.col("df") > 1), "left-over-counts")
    need = F.ceil(F.col("n") * 4 / 5)
    marked = of.join(often, "s", "left").withColumn("df", F.coalesce("df", F.lit(1)))

    where = rest.select("node", "n", "component")
    rare = marked.where(F.col("df") <= PAIRS)
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "s"))
    first = rare.withColumn("place", place).where((F.col("place") <= F.col("n") - need + 1) & (F.col("df") > 1)).select("node", "s").join(where, "node")
    side = lambda x: first.select("s", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("component").alias(f"c_{x}"))
    pairs = side("a").join(side("b"), "s").where("a < b and c_a <> c_b and greatest(n_a, n_b) * 4 <= least(n_a, n_b) * 5").select("a", "b").distinct()

    many = F.col("df") > PAIRS
    signs = marked.groupBy("node", "n").agg(F.count_if(many).alias("f"), *[F.bit_xor(F.when(many, F.xxhash64("s", F.lit(i)))).alias(f"sign{i}") for i in (1, 2)])
    signs = stored(signs.where(F.col("f") >= need), "left-over-signs")
    group = ["f", "sign1", "sign2"]
    least = signs.groupBy(*group).agg(F.min(F.struct("n", "node")).alias("least")).select(*group, F.col("least.node").alias("centre"), F.col("least.n").alias("n_centre"))
    placed = stored(signs.join(least, group).select("node", "n", "f", "centre", "n_centre"), "left-over-groups")
    star = placed.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    pairs = pairs.unionAll(star)

    # the smallest of a group, and those too large to be similar to it by the frequent shingles alone
    facing = stored(_by_level(rest.join(placed.where("node = centre or 9 * f < 4 * (n + n_centre)").select("node", (F.col("node") == F.col("centre")).alias("is_centre")), "node")), "left-over-facing")
    if facing.isEmpty():
        return pairs.distinct()
    return pairs.unionAll(_in_blocks(facing.where("is_centre").drop("is_centre"), facing.drop("is_centre"))).distinct()


def classes_of(rows: DataFrame) -> DataFrame:
    """One row a distinct set: its node, smallest document, figures."""
    return rows.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("other").alias("o1"), F.max("other").alias("o2"), F.any_value("sketch").alias("sketch"), F.min("held0").alias("held0"), F.min("held1").alias("held1"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    ship(docs.sparkSession)
    with scratch() as keep:
        rows, by_class = map(keep, _components_of(_texts(docs, id_col, text_col)))
    out = rows.join(by_class, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _components_of(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches of all documents, component_id by node), both written."""
    spark = texts.sparkSession
    for salt in range(4):
        rows = stored(sketches(texts, salt), "sketches")
        classes = stored(classes_of(rows), "classes")
        if classes.where("o1 <> o2").isEmpty():  # two classes of one node: draw nodes anew
            break
    size = rows.agg(F.sum("n")).first()[0] or 0
    n = max(partitions(spark), -(-int(size * 16 * 0.5) // TASK_BYTES))  # about half as many keys as shingles, of 16 bytes
    matched = stored(_matched(_entries(texts, salt, n).repartitionById(n, F.col("bucket").cast("int"))), "matched")

    # every document of a key against its first; and what the rows of one id link with
    star = matched.where(f"kind <> {LIST_OF} and node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    found, held = _exact(_near(star, classes), texts)
    several = rows.where("id is not null and node is not null").groupBy("id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("id")
    one = rows.select("id", "node").join(several, "id", "left_semi").join(classes.select("node", "rep"), "node").select(F.col("rep").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    links = stored(found.unionAll(one), "links-1")
    comp = stored(components(links), "components-1")

    # keys whose documents lie in several components, with what their lists hold
    named = stored(classes.join(comp, classes["rep"] == comp["node"], "left").select(classes["node"], "rep", "n", "sketch", "held0", "held1", F.coalesce("component", "rep").alias("component")), "named")
    where = named.select("node", "component")
    members = stored(matched.where(f"kind <> {LIST_OF} and size > 2").join(where, "node"), "members")
    lists = matched.where(f"kind = {LIST_OF}").select("key", F.col("node").alias("list")).distinct()
    spread = members.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
    spread = spread.unionAll(lists.join(spread.withColumnRenamed("key", "list"), "list").select("key", "c1", "c2"))
    mixed_keys = stored(spread.groupBy("key").agg(F.min("c1").alias("c1"), F.max("c2").alias("c2")).where("c1 <> c2").select("key"), "mixed-keys")
    mixed = stored(members.where(f"kind = {MEMBER}").join(mixed_keys, "key", "left_semi"), "mixed")
    few = mixed.where(F.col("size") <= PAIRS)
    left, right = few.select("key", F.col("node").alias("a"), F.col("component").alias("ca"), "first"), few.select("key", F.col("node").alias("b"), F.col("component").alias("cb"))
    pairs = left.join(right, "key").where("a < b and ca <> cb and a <> first and b <> first").select("a", "b").distinct()

    # documents that the keys in use don't cover
    in_list = lists.join(mixed_keys, "key", "left_semi").groupBy(F.col("list").alias("key")).agg(F.count("*").alias("times"))
    in_list = members.where(f"kind = {LISTED}").drop("times").join(in_list, "key").select("node", "level", "times")
    heavy = mixed.where(F.col("size") > PAIRS).select("node", "level", "times").unionAll(in_list).groupBy("node", "level").agg(F.sum("times").alias("heavy"))
    rest = stored(_uncovered(named, heavy), "uncovered")
    if not rest.isEmpty():
        pairs = pairs.unionAll(_left_over(rest, texts, salt)).distinct()
    more, _ = _exact(_near(pairs, classes), texts, held)
    known = comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(known.unionAll(more))

    by_class = stored(named.join(final, named["rep"] == final["node"], "left").select(named["node"], F.coalesce(final["component"], "rep").alias("component_id")), "component-of-class")
    return rows, by_class


def _levels(n: Column) -> list[Column]:
    """bands(n) as columns; the second is null where it is the first."""
    bits = lambda c: (F.length(F.bin(c - 1)) * (c > 1).cast("int")).cast("long")
    own, top = bits(n), bits(F.floor(n * 5 / 4))
    return [own, F.when(top != own, top)]


def _by_level(rows: DataFrame) -> DataFrame:
    """rows (with n) once for each of their bands."""
    levels = F.filter(F.array(*_levels(F.col("n"))), lambda x: x.isNotNull())
    return rows.withColumn("level", F.explode(levels))


def _uncovered(named: DataFrame, heavy: DataFrame) -> DataFrame:
    """(node, rep, n, sketch, component) of documents whose keys in use may all be missed, in either band."""
    own, top = _levels(F.col("n"))
    columns = ["node", "rep", "n", "sketch", "component"]
    both = named.select(*columns, own.alias("level"), F.col("held0").alias("held")).unionAll(named.where("held1 is not null").select(*columns, top.alias("level"), F.col("held1").alias("held")))
    reach_ = F.floor((F.col("n") + F.least(F.pow(F.lit(2.0), F.col("level")).cast("long"), F.floor(F.col("n") * 5 / 4))) / 9)
    return both.join(heavy, ["node", "level"], "left").where(reach_ > 0).where(F.col("held") - F.coalesce("heavy", F.lit(0)) <= reach_).select(*columns).dropDuplicates(["node"])
