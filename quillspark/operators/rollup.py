"""Weighted roll-up of signal scores: sub-criteria, sections, overall, with exclusions and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import py_round

TOP_SCORE, GOOD_FROM, MIXED_FROM = 5, 7.5, 4.0
EVIDENCE_TARGET = 5
# What a confidence label is worth.
CONFIDENCE = {"low_confidence": 0, "medium_confidence": 1, "high_confidence": 2}


def _keep(x: Column, _digits: int) -> Column:
    return x


def exact_sum(x: Column) -> Column:
    """A sum of doubles that doesn't depend on their order, to twelve places."""
    return F.sum(x.cast("decimal(38,12)")).cast("double")


def weighted_mean(value: Column, weight: Column, where: Column | None = None) -> Column:
    """Over the rows that count; over all if none does; a total weight of 0 counts as 1.

    Means of scores of two places often end in a tie of the next rounding, so sums must be exact.
    """

    def mean(v: Column, w: Column) -> Column:
        total = exact_sum(w)
        return exact_sum(v * w) / F.when(total == 0, 1.0).otherwise(total)

    if where is None:
        return mean(value, weight)
    some = mean(F.when(where, value), F.when(where, weight))
    return F.when(F.count_if(where) > 0, some).otherwise(mean(value, weight))


def _counted(test: Column, where: Column) -> Column:
    """Rows that pass, of those that count, or of all if none counts."""
    return F.when(F.count_if(where) > 0, F.count_if(where & test)).otherwise(F.count_if(test))


def confidence_label(gap: Column) -> Column:
    return F.when(gap < 0.5, "high_confidence").when(gap < 1.5, "medium_confidence").otherwise("low_confidence")


def confidence_score(label: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for k, v in CONFIDENCE.items():
        out = out.when(label == k, v)
    return out


def plausibility(confidence: Column) -> Column:
    return py_round(confidence / 2 * 5, 2)


def evidence_score(confidence: Column) -> Column:
    return py_round(confidence / 2 * 100, 2)


def sub_scores(signals: DataFrame, keys: tuple[str, ...] = ("doc_id", "section_key", "sub_id"), carry: tuple[str, ...] = ("sub_weight", "counts"), rounded: bool = True) -> DataFrame:
    """keys, carried columns, n_signals, score_10, quality, exists. signals: keys, score, signal_weight."""
    rnd = py_round if rounded else _keep
    total = F.sum("signal_weight")
    score = F.sum(F.col("score") * F.col("signal_weight")) / (TOP_SCORE * F.when(total == 0, 1.0).otherwise(total)) * 10
    out = signals.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carry], F.count("*").alias("n_signals"), rnd(score, 2).alias("score_10"))
    return with_quality(out)


def with_quality(df: DataFrame) -> DataFrame:
    s = F.col("score_10")
    return df.withColumn("quality", F.when(s >= GOOD_FROM, "good").when(s >= MIXED_FROM, "mixed").otherwise("weak")).withColumn("exists", F.when(s > 0, "yes").otherwise("no"))


def cap(subs: DataFrame, caps: DataFrame) -> DataFrame:
    """subs with scores cut to the cap of their doc_type and sub_id, and capped; the score before as uncapped_10."""
    out = subs.join(F.broadcast(caps), ["doc_type", "sub_id"], "left").withColumn("uncapped_10", F.col("score_10"))
    out = out.withColumn("capped", F.coalesce(F.col("score_10") > F.col("cap"), F.lit(False))).withColumn("score_10", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("score_10")))
    return with_quality(out.drop("cap"))


def section_scores(subs: DataFrame, keys: tuple[str, ...] = ("doc_id", "section_key"), carry: tuple[str, ...] = ("section_weight",), rounded: bool = True) -> DataFrame:
    """Figures of sections. subs: keys, sub_weight, counts, score_10, n_signals, evidence_count, confidence_label.

    Coverage counts what scored before a cap (uncapped_10, if there is one).
    """
    rnd = py_round if rounded else _keep
    counts = F.coalesce("counts", F.lit(True))
    before = F.col("uncapped_10") if "uncapped_10" in subs.columns else F.col("score_10")
    confidence = confidence_score(F.col("confidence_label"))
    scored = F.when(F.count_if(counts) > 0, F.count_if(counts)).otherwise(F.count("*"))
    label = lambda name: _counted(F.col("confidence_label") == name, counts)
    out = subs.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carry],
        rnd(weighted_mean(F.col("score_10"), F.col("sub_weight"), counts), 2).alias("score_10"),
        F.count("*").alias("total_items"),
        scored.alias("scored_items"),
        F.sum("n_signals").alias("signal_count"),
        F.sum("evidence_count").alias("evidence_count"),
        _counted(F.col("score_10") >= GOOD_FROM, counts).alias("good_items"),
        _counted(before > 0, counts).alias("positive_items"),
        label("high_confidence").alias("high_confidence_subcriterion_count"),
        label("medium_confidence").alias("medium_confidence_subcriterion_count"),
        label("low_confidence").alias("low_confidence_subcriterion_count"),
        rnd(F.coalesce(F.when(F.count_if(counts) > 0, F.avg(F.when(counts, confidence))).otherwise(F.avg(confidence)), F.lit(0.0)), 2).alias("avg_confidence_0to2"),
    )
    return _derived(out, rounded)


def _derived(df: DataFrame, rounded: bool = True) -> DataFrame:
    rnd = py_round if rounded else _keep
    s = F.col("score_10")
    return (
        df.withColumn("final_score_0to100", rnd(s * 10, 2))
        .withColumn("quality_score_0to100", F.col("final_score_0to100"))
        .withColumn("coverage_score_0to100", rnd(F.col("positive_items") / F.greatest(F.lit(1), F.col("scored_items")) * 100, 2))
        .withColumn("evidence_score_0to100", evidence_score(F.col("avg_confidence_0to2")))
        .withColumn("quality_score_avg_0to10", s)
        .withColumn("avg_plausibility_0to5", plausibility(F.col("avg_confidence_0to2")))
        .withColumn("weak_signal_count", F.col("low_confidence_subcriterion_count"))
        .withColumn("expected_items", F.col("scored_items"))
        .withColumn("target_evidence_per_item", F.lit(EVIDENCE_TARGET))
    )


def overall_scores(sections: DataFrame, excluded: DataFrame, rounded: bool = True) -> DataFrame:
    """One row a document. sections: (doc_id, doc_type, section_key, …); excluded: (doc_type, section_key).

    The score, good and positive items leave excluded sections out; the other counts don't, so the
    coverage of a document with an excluded section stays under 100.
    """
    rnd = py_round if rounded else _keep
    rows = sections.join(F.broadcast(excluded.withColumn("out", F.lit(True))), ["doc_type", "section_key"], "left").withColumn("scoring", F.col("out").isNull())
    scoring = F.col("scoring")
    total = lambda c: F.sum(c).alias(c)
    part = lambda c: F.when(F.count_if(scoring) > 0, F.sum(F.when(scoring, F.col(c)))).otherwise(F.sum(c)).alias(c)
    out = rows.groupBy("doc_id").agg(
        rnd(weighted_mean(F.col("score_10"), F.coalesce("section_weight", F.lit(1.0)), scoring), 2).alias("score_10"),
        *map(total, ("total_items", "scored_items", "signal_count", "evidence_count")),
        *map(part, ("good_items", "positive_items")),
        *map(total, ("high_confidence_subcriterion_count", "medium_confidence_subcriterion_count", "low_confidence_subcriterion_count")),
        rnd(F.sum(F.col("avg_confidence_0to2") * F.col("scored_items")) / F.greatest(F.lit(1), F.sum("scored_items")), 2).alias("avg_confidence_0to2"),
    )
    return _derived(out, rounded)


def with_empty(overall: DataFrame, documents: DataFrame) -> DataFrame:
    """A row of zeros for documents without any section; good, positive and expected items stay null there."""
    out = documents.select("doc_id").join(overall, "doc_id", "left")
    blank = {"good_items", "positive_items", "expected_items"}
    zero = {c: 0 for c in out.columns if c not in blank and c not in ("doc_id", "target_evidence_per_item")}
    return out.fillna(zero | {"target_evidence_per_item": EVIDENCE_TARGET})


def flat_scores(scores: DataFrame, rubric_subs: DataFrame, rounded: bool = True) -> DataFrame:
    """Sub-scores given as 0 to 10, -1 for not applicable: (doc_id, sub_id, score) with section and counts; clamped."""
    rows = scores.join(F.broadcast(rubric_subs), "sub_id")
    na = F.col("score") < 0
    out = rows.withColumn("counts", ~na).withColumn("score_10", F.when(na, 0.0).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.col("score").cast("double")))))
    if rounded:
        out = out.withColumn("score_10", py_round(F.col("score_10"), 2))
    return with_quality(out.withColumn("evidence_count", F.lit(0)).withColumn("confidence_label", F.lit("high_confidence")))


def mean_signal(signals: DataFrame) -> DataFrame:
    """(doc_id, avg_signal_score_0to5)."""
    return signals.groupBy("doc_id").agg(py_round(F.avg("score"), 4).alias("avg_signal_score_0to5"))


def nested(overall: DataFrame, sections: DataFrame, subs: DataFrame) -> DataFrame:
    """(doc_id, result): everything as one JSON object, for the sink."""
    sub = subs.groupBy("doc_id", "section_key").agg(F.sort_array(F.collect_list(F.struct("sub_id", "score_10", "quality", "exists"))).alias("sub_criteria"))
    part = sections.join(sub, ["doc_id", "section_key"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section_key", F.struct("score_10", "scored_items", "coverage_score_0to100", "sub_criteria").alias("s")))).alias("features"))
    rest = F.struct(*[c for c in overall.columns if c != "doc_id"]).alias("overall")
    return overall.select("doc_id", rest).join(part, "doc_id").select("doc_id", F.to_json(F.struct("features", "overall")).alias("result"))
