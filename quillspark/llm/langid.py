"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes; max pooling over a window of WINDOW
positions and a softmax layer give a distribution over the learned languages. The
network is trained in numpy on the driver, on a bounded sample: PER_LANG labelled
documents of a language, on average, and SAMPLE in all at most, chosen by a hash, of
each TAKE windows. Up to SAMPLE languages none is left out; where there are more than SAMPLE /
PER_LANG, each has fewer documents. Prediction covers every window of a whole text,
however long; a window counts by the bytes of text in it.

Null text, and text without a letter, gives ``und`` with score 0. Without
labelled rows, and on an empty table, every text does. A null id has no remainder:
it isn't held out, so such rows are learned from. Repeated rows and ids each give a row; extra columns, of any
name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, stored, text_steps, tidy

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANG = 1500
SAMPLE = 48_000
TAKE = 2
EPOCHS = 6
#: Windows of one vectorised step.
BLOCK = 512
PAD = max(WIDTHS) - 1


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts, each padded to whole windows, in one buffer; each window's text and bytes of text."""
    sizes = np.array([len(t) for t in texts])
    counts = np.maximum(1, -(-sizes // WINDOW))
    buffer = np.frombuffer(b"".join([t + b"\0" * (c * WINDOW - len(t)) for t, c in zip(texts, counts.tolist(), strict=True)]) + b"\0" * PAD, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return buffer, owner, np.clip(sizes[owner] - nth * WINDOW, 0, WINDOW)


class Net:
    """filters[w]: (w, 256, FILTERS); dense: (filters in all, languages)."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)
        self._pairs: list[np.ndarray] | None = None

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.dense + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.05, seed: int = 11) -> None:
        """Adagrad on cross-entropy; the gradient of a maximum goes to the bytes that made it."""
        rng = np.random.default_rng(seed)
        x = np.zeros((len(texts), WINDOW + PAD), np.uint8)
        for i, t in enumerate(texts):
            t = t[: WINDOW + PAD]
            x[i, : len(t)] = np.frombuffer(t, np.uint8)
        weights = [*self.filters, self.dense, self.bias]
        seen = [np.full_like(w, 1e-6) for w in weights]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                b, n = x[rows], len(rows)
                pooled, where = [], []
                for w, f in zip(WIDTHS, self.filters, strict=True):
                    z = f[0][b[:, :WINDOW]]
                    for o in range(1, w):
                        z = z + f[o][b[:, o : o + WINDOW]]
                    where.append(z.argmax(axis=1))
                    pooled.append(np.take_along_axis(z, where[-1][:, None, :], axis=1)[:, 0])
                pooled = np.concatenate(pooled, axis=1)
                p = self._softmax(pooled)
                p[np.arange(n), y[rows]] -= 1
                p /= n
                hidden = np.maximum(pooled, 0)
                back = (p @ self.dense.T) * (pooled > 0)
                grads = []
                for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    g = np.zeros_like(f)
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for o in range(w):
                        np.add.at(g[o], (np.take_along_axis(b, where[k] + o, axis=1), np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [hidden.T @ p, p.sum(axis=0)]
                for weight, g, s in zip(weights, grads, seen, strict=True):
                    s += g * g
                    weight -= rate * g / np.sqrt(s)

    def _tables(self) -> list[np.ndarray]:
        """Two neighbouring offsets of a filter as one table over pairs of bytes."""
        if self._pairs is None:
            self._pairs = []
            for f in self.filters:
                for o in range(0, len(f) - 1, 2):
                    self._pairs.append((f[o][:, None, :] + f[o + 1][None, :, :]).reshape(65536, FILTERS))
        return self._pairs

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """A distribution over the languages for every text."""
        buffer, owner, weight = windows(texts)
        tables = self._tables()
        out = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(owner), BLOCK):
            b = min(a + BLOCK, len(owner))
            n = (b - a) * WINDOW
            part = buffer[a * WINDOW : b * WINDOW + PAD].astype(np.intp)
            pair = part[:-1] * 256 + part[1:]
            pooled, k = [], 0
            for w, f in zip(WIDTHS, self.filters, strict=True):
                z = tables[k].take(pair[:n], axis=0)
                for o in range(2, w - 1, 2):
                    z += tables[k + o // 2].take(pair[o : o + n], axis=0)
                if w % 2:
                    z += f[w - 1].take(part[w - 1 : w - 1 + n], axis=0)
                k += w // 2
                pooled.append(z.reshape(b - a, WINDOW, FILTERS).max(axis=1))
            p = self._softmax(np.concatenate(pooled, axis=1))
            np.add.at(out, owner[a:b], p * np.maximum(weight[a:b], 1)[:, None])
        return out / out.sum(axis=1, keepdims=True)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pairs": None}


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_lang: int = PER_LANG, sample: int = SAMPLE) -> Net | None:
    """Learn from docs, a sample of them of per_lang a language and sample in all at most; None if no row has a label and a letter.

    Rows draw by id and text, so rows of one id, or without one, are not drawn together; equal rows are. Of more than
    sample languages some are left out.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("y")).where("y is not null and t is not null")
    counts = stored(rows.groupBy("y").agg(F.count("*").alias("n")), "languages")  # written, so that the planner knows its size
    n_langs = counts.count()
    if not n_langs:
        return None
    draw = F.pmod(F.xxhash64("id", "t", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    places = [F.substring("t", F.greatest(F.lit(1), F.floor((F.length("t") - WINDOW) * (k / max(1, TAKE - 1)))).cast("int"), WINDOW + PAD) for k in range(TAKE)]
    share = counts.select(F.col("y").alias("_y"), (min(per_lang, sample / n_langs) / F.col("n")).alias("share"))
    near = rows.join(share, rows["y"] == share["_y"]).where(F.col("share") > draw).where(F.col("t").rlike(r"\p{L}"))
    # a share is met on average only: of what is drawn beyond the sample, the last of each language go
    got = near.select("id", "y", F.array(*places).alias("parts"), (draw / F.col("share")).alias("place")).orderBy("place").limit(sample).collect()
    got.sort(key=lambda r: (r["id"] is None, r["id"] or 0, r["y"], r["parts"]))
    if not got:
        return None
    langs = sorted({r["y"] for r in got})
    number = {v: i for i, v in enumerate(langs)}
    net = Net(langs)
    net.train([p.encode() for r in got for p in r["parts"]], np.array([number[r["y"]] for r in got for _ in r["parts"]]))
    return net


def predict(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.when(F.col(text_col).cast("string").rlike(r"\p{L}"), F.col(text_col).cast("string")).alias("t"))
    if net is None:
        return rows.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array(net.langs, object)
        for batch in batches:
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for a, b, texts in text_steps(batch.column(1)):
                p = net.predict(texts)
                best = p.argmax(axis=1)
                lang[a:b], score[a:b] = langs[best], p[np.arange(b - a), best]
            lang[~known], score[~known] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.minimum(score, 1.0))], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
