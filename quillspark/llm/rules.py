"""Quality rules: text figures, and a decision list learned from labelled ones.

Everything over the documents is column expressions; the learner runs on the
driver over at most MAX_LABELS rows of figures. It covers the bad class: each rule
grows, threshold by threshold, to the conjunction with the best information gain
on two thirds of the rows, loses its last conditions while that helps on the other
third, and takes the rows that it covers away. The list becomes one ordered
conditional expression.

Null text counts as empty: all figures 0, base_failed. Without labels of both
classes the list is empty and the base rules alone decide. Repeated rows and ids,
and null ids, each give a row; a null id has no label. An empty table gives no rows.
Very long texts count whole. Extra columns, of any name, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_CLASS

WINDOW = 8
MAX_LABELS = 4000
MAX_RULES = 12
MAX_CONDITIONS = 4
#: A rule must be right on this share of the rows that it covers.
PRECISION = 0.9
#: And cover this many.
COVER = 5
SPACES = " \t\n\x0b\x0c\r"

#: What thresholds are learned on, from the figures.
RATIOS = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "adjacent_share": "n_adjacent / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and its figures, as longs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    df = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+")).alias("w"))
    df = df.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("lines"))
    n = F.size("h")
    runs = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_bangs"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
        F.size(F.filter("h", lambda x, i: x == F.get("h", i - 1))).cast("long").alias("n_adjacent"),
        runs.alias("runs"),
    )
    df = df.withColumn("repeats", F.when(F.size(F.array_distinct("runs")) < F.size("runs"), F.sort_array(F.transform("runs", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda j, k: F.coalesce(F.get("repeats", j)["x"] == F.get("repeats", k)["x"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("repeats") - 1), lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: F.get("repeats", j)["i"]))
    df = df.withColumn("places", F.when(F.col("repeats").isNotNull(), places))
    covered = F.aggregate(F.sequence(F.lit(0), F.size("places") - 2), F.lit(WINDOW), lambda a, j: a + F.least(F.lit(WINDOW), F.get("places", j + 1) - F.get("places", j)))
    df = df.withColumn("n_repeat_words", F.when(F.col("places").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    return df.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_distinct", "n_adjacent")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    figure: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.figure] > self.threshold if self.above else row[self.figure] <= self.threshold

    def column(self) -> Column:
        c = F.expr(RATIOS[self.figure])
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _counts(rule: Rule, rows: list[dict]) -> tuple[int, int]:
    """Bad and good rows that a rule covers."""
    hit = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def _best(rows: list[dict]) -> Condition | None:
    """The threshold with the highest information gain for the bad class; one sweep a figure."""
    bad = sum(r["bad"] for r in rows)
    good = len(rows) - bad
    if not bad or not good:
        return None
    start, best = math.log2(bad / (bad + good)), (0.0, None)
    for figure in RATIOS:
        ordered = sorted((r[figure], r["bad"]) for r in rows)
        p = n = 0
        for (value, is_bad), (following, _) in zip(ordered, ordered[1:], strict=False):
            p += is_bad
            n += not is_bad
            if value == following:
                continue
            for above, a, b in ((False, p, n), (True, bad - p, good - n)):
                if a >= COVER and (gain := a * (math.log2(a / (a + b)) - start)) > best[0] + 1e-12:
                    best = (gain, Condition(figure, above, (value + following) / 2))
    return best[1]


def _grow(rows: list[dict]) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS and (c := _best(rows)):
        rule += (c,)
        rows = [r for r in rows if c.holds(r)]
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    def worth(k: int) -> tuple[float, int]:
        p, n = _counts(rule[:k], rows)
        return ((p - n) / (p + n) if p + n else -1.0, -k)

    return rule[: max(range(1, len(rule) + 1), key=worth)]


def learn(rows: list[dict]) -> list[Rule]:
    """Ordered rules for bad rows; rows hold the figures of RATIOS and bad, in an order that is fixed."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and sum(r["bad"] for r in rows) >= COVER:
        grow, prune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
        rule = _grow(grow)
        if not rule:
            break
        rule = _prune(rule, prune)
        p, n = _counts(rule, rows)
        if p < COVER or p < PRECISION * (p + n):
            break
        rules.append(rule)
        rows = [r for r in rows if not all(c.holds(r) for c in rule)]
    return rules


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_labels: int = MAX_LABELS) -> list[Rule]:
    """Learn from at most max_labels labelled rows of figures(), chosen by a hash."""
    draw = F.xxhash64("id", F.lit("rules"))
    chosen = labels.select(F.col(id_col).alias("id"), (F.col(label_col).cast("double") < 0.5).alias("bad")).where("id is not null and bad is not null").orderBy(draw, "id", "bad").limit(max_labels)
    rows = stats.withColumnRenamed(id_col, "id").join(F.broadcast(chosen), "id").where(~base_failed())
    got = rows.select(draw.alias("draw"), "id", "bad", *[F.expr(e).cast("double").alias(k) for k, e in RATIOS.items()]).orderBy("draw", "id", "bad", *RATIOS).limit(max_labels).collect()
    return learn([r.asDict() for r in got])


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds, counted from 1; null if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out.cast("int")


def apply(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """figures() with base_failed, the rule that fired and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), verdict(rules))).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
