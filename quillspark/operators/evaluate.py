"""Comparison of score distributions across runs, groups and methods."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..cluster import stored
from ..functions.columns import py_round

MOMENTS = ("count", "mean", "std", "var", "min", "max", "median")
#: Values of a group that a task may hold; medians of larger groups come from ranges.
HELD = 100_000
#: Parts that a sketch cuts a range into, and its sharpness: a mark is off by one in so many ranks at most.
PARTS, SHARP = 128, 10_000


def _moments(c: str) -> dict[str, Column]:
    return {"count": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "var": F.var_samp(c), "min": F.min(c), "max": F.max(c)}


def medians(rows: DataFrame, held: int = HELD, ends: DataFrame | None = None) -> DataFrame:
    """(g, median) of rows (g, v), exact; no task holds more than held values of a group.

    A group's middle lies between two of its values, with known counts up to the lower one and strictly between them.
    Where too many lie between, a sketch of these gives two that are nearer, and one pass counts again: a round leaves
    about three of PARTS. A value that fills the middle becomes a bound itself, so ties end the search.

    Bounds are written before rows meet them, so the planner knows that they are few and sends them to the rows; else
    it would send all rows of a group to one task. ends: (g, n, low, high), if they are written already.
    """
    rows = rows.where("v is not null")

    def within(bounds: DataFrame) -> DataFrame:
        return rows.join(bounds.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of"))).drop("of")

    def counted(bounds: DataFrame) -> DataFrame:
        between = (F.col("v") > F.col("low")) & (F.col("v") < F.col("high"))
        keys = ("g", "n", "k", "l", "low", "high")
        return within(bounds).groupBy(*keys).agg(F.count_if(F.col("v") <= F.col("low")).alias("upto"), F.count_if(between).alias("between"))

    if ends is None:
        ends = stored(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "median-ends")
    known = stored(counted(ends.select("g", "n", F.expr("(n - 1) div 2").alias("k"), F.expr("n div 2").alias("l"), "low", "high")), "median-bounds")
    inside = (F.col("l") >= F.col("upto")) & (F.col("k") < F.col("upto") + F.col("between"))
    wide = inside & (F.col("between") > max(held, 1))  # of one value neither bound could come nearer
    middle = (F.col("v") > F.col("low")) & (F.col("v") < F.col("high"))
    while not known.where(wide).isEmpty():
        keys = [c for c in known.columns]
        marks = within(known.where(wide)).where(middle).groupBy(*keys).agg(F.percentile_approx("v", [i / PARTS for i in range(PARTS + 1)], SHARP).alias("marks"))
        part = lambda rank: F.floor((F.col(rank) - F.col("upto")) * PARTS / F.col("between")).cast("int")
        low = F.when(part("k") > 0, F.get("marks", F.greatest(part("k") - 1, F.lit(0)))).otherwise(F.col("low"))
        high = F.when(part("l") < PARTS - 1, F.get("marks", F.least(part("l") + 2, F.lit(PARTS)))).otherwise(F.col("high"))
        nearer = stored(marks.select("g", "n", "k", "l", low.alias("low"), high.alias("high")), "median-nearer")
        known = stored(known.where(~wide).unionByName(counted(nearer)), "median-bounds")
    listed = stored(within(known.where(inside)).where(middle).groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("values")), "median-values")
    rest = known.join(listed.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of")), "left")
    at = lambda rank: F.when(F.col(rank) < F.col("upto"), F.col("low")).when(F.col(rank) >= F.col("upto") + F.col("between"), F.col("high")).otherwise(F.get("values", (F.col(rank) - F.col("upto")).cast("int")))
    return rest.select("g", F.when(F.col("k") == F.col("l"), at("k")).otherwise(0.5 * at("k") + 0.5 * at("l")).alias("median"))


def _summaries(long: DataFrame, held: int) -> DataFrame:
    """(g, and the moments) of rows (g, v): one pass, and medians by ranges if a group is larger than held."""
    if not (long.groupBy("g").count().agg(F.max("count")).first()[0] or 0) > held:
        return long.groupBy("g").agg(*[e.alias(k) for k, e in _moments("v").items()], F.percentile("v", 0.5).alias("median"))
    rest = stored(long.groupBy("g").agg(*[e.alias(k) for k, e in _moments("v").items()]), "moments")
    ends = rest.where("count > 0").select("g", F.col("count").alias("n"), F.col("min").alias("low"), F.col("max").alias("high"))
    return rest.join(medians(long, held, ends).withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of")), "left").drop("of")


def column_summary(df: DataFrame, columns: Sequence[str], held: int = HELD) -> DataFrame:
    """(metric, mean, std, var, min, max, median): a row a column."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "g", "v")
    return _summaries(long, held).select(F.col("g").alias("metric"), *[k for k in MOMENTS if k != "count"])


def group_summary(df: DataFrame, by: str, columns: Sequence[str], held: int = HELD) -> DataFrame:
    """One wide row a group: <column>_<moment>. Values are taken as doubles."""
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.col(by).alias("by"), F.explode(values).alias("x")).select(F.struct("by", "x.column").alias("g"), "x.v")
    rows = _summaries(long, held).select("g.by", "g.column", F.struct(*MOMENTS).alias("m"))
    of = {c: F.first(F.when(F.col("column") == c, F.col("m")), ignorenulls=True).alias(c) for c in columns}
    return rows.groupBy("by").agg(*[of[c] for c in columns]).select(F.col("by").alias(by), *[F.col(c).getField(k).alias(f"{c}_{k}") for c in columns for k in MOMENTS])


def flatten_results(overall: DataFrame, sections: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One wide row a document: overall_<metric>, and <section>_<metric> of every section in keys."""
    wide = sections.groupBy("doc_id").pivot("section_key", list(keys)).agg(*[F.first(m).alias(m) for m in metrics])
    return overall.select("doc_id", *[F.col(c).alias(f"overall_{c}") for c in overall.columns if c != "doc_id"]).join(wide, "doc_id", "left")


def score_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_score_100")]


def moments_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def welch(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """One row (statistic, dof) of Welch's t of two groups; null where a variance is undefined or both are 0."""
    of = lambda g: F.when(F.col(group) == F.lit(g), F.col(value))
    r = df.agg(*[f(of(g)).alias(f"{n}_{s}") for g, s in ((a, "a"), (b, "b")) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    ea, eb = F.try_divide("v_a", "n_a"), F.try_divide("v_b", "n_b")
    t = F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(ea + eb))
    dof = F.try_divide((ea + eb) ** 2, F.try_divide(ea**2, F.col("n_a") - 1) + F.try_divide(eb**2, F.col("n_b") - 1))
    return r.select(t.alias("statistic"), dof.alias("dof"))


def ks(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """One row (statistic, n_a, n_b): the largest gap between two empirical distributions.

    Counts by distinct value are written in ranges of values. Running sums go by range, each from the sum of the
    ranges before it, so no task holds all values.
    """
    is_a, is_b = F.count_if(F.col(group) == F.lit(a)), F.count_if(F.col(group) == F.lit(b))
    points = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(is_a.alias("a"), is_b.alias("b"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = stored(points.repartitionByRange(n, "v").withColumn("part", F.spark_partition_id()), "distribution")
    ranges = points.groupBy("part").agg(F.sum("a").alias("of_a"), F.sum("b").alias("of_b"))  # a row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", *[F.coalesce(F.sum(f"of_{x}").over(before), F.lit(0)).alias(f"from_{x}") for x in "ab"], *[F.sum(f"of_{x}").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"n_{x}") for x in "ab"])
    up = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cdf = points.join(F.broadcast(ranges), "part").select("n_a", "n_b", *[(F.col(f"from_{x}") + F.sum(x).over(up)).alias(x) for x in "ab"])
    return cdf.agg(F.max(F.abs(F.try_divide("a", "n_a") - F.try_divide("b", "n_b"))).alias("statistic"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(1 - x, b, a) / b


def t_p_value(t: float | None, dof: float | None) -> float | None:
    """Two-sided."""
    return None if t is None or dof is None or dof <= 0 else incomplete_beta(dof / (dof + t * t), dof / 2, 0.5)


#: Fixed value: samples of more rows than this take the limit's distribution.
EXACT_UP_TO = 10_000


def _outside_square(n: int, h: int) -> float:
    """The share of lattice paths of two samples of n that touch a line h steps off the diagonal, by reflection."""
    whole = 2 * math.lgamma(n + 1)
    share = lambda k: math.exp(whole - math.lgamma(n - k * h + 1) - math.lgamma(n + k * h + 1))
    return 2 * math.fsum((-1) ** (k - 1) * share(k) for k in range(1, n // h + 1))


def _outside(n_a: int, n_b: int, h: int) -> float:
    """The same of samples of different sizes: h in units of the sizes' least common multiple. Paths inside are counted row by row."""
    g = math.gcd(n_a, n_b)
    up, across = n_b // g, n_a // g
    row, low, scale = np.ones(1), 0, 0.0
    for i in range(n_a + 1):
        new_low, new_high = max(0, (i * up - h) // across + 1), min(n_b, -(-(i * up + h) // across) - 1)
        if new_high < new_low:
            return 1.0
        wide = np.zeros(new_high - new_low + 1)
        a, b = max(low, new_low), min(low + len(row) - 1, new_high)
        if i == 0:
            wide[:] = 1.0  # along the first side there is one path to each point
        else:
            if b >= a:
                wide[a - new_low : b - new_low + 1] = row[a - low : b - low + 1]
            wide = np.cumsum(wide)
        top = wide.max()
        if top == 0:
            return 1.0
        row, low, scale = wide / top, new_low, scale + math.log(top)
    if low + len(row) - 1 < n_b:
        return 1.0
    inside = math.log(row[n_b - low]) + scale if row[n_b - low] > 0 else -math.inf
    return 1 - math.exp(inside - math.lgamma(n_a + n_b + 1) + math.lgamma(n_a + 1) + math.lgamma(n_b + 1))


def _kolmogorov(n: float, d: float) -> float:
    """P(D_n > d) of a sample of n: Pelz and Good's expansion to the third order; the first tail term where that is small."""
    z = d * math.sqrt(n)
    if z <= 0:
        return 1.0
    if z > 3:  # Smirnov's one-sided tail twice: two-sided ones meet with probability far below the rest
        return min(1.0, 2 * math.exp(-2 * z * z - 2 * z / (3 * math.sqrt(n))))
    pi2, z2, root = math.pi**2, z * z, math.sqrt(math.pi / 2)
    half, whole = [(k + 0.5) ** 2 for k in range(-60, 60)], [float(k * k) for k in range(-60, 61)]
    e = lambda q: math.exp(-pi2 * q / (2 * z2))
    k0 = root / z * math.fsum(e(q) for q in half)
    k1 = root / (6 * z2**2) * math.fsum((pi2 * q - z2) * e(q) for q in half)
    k2 = root / (72 * z**7) * math.fsum((6 * z2**3 + 2 * z2**2 + pi2 * (2 * z2**2 - 5 * z2) * q + pi2**2 * (1 - 2 * z2) * q * q) * e(q) for q in half)
    k2 -= root / (36 * z**3) * math.fsum(pi2 * q * e(q) for q in whole)
    k3 = root / (6480 * z**10) * math.fsum((pi2**3 * q**3 * (5 - 30 * z2) + pi2**2 * q * q * (212 * z2**2 - 60 * z2) + pi2 * q * (135 * z2**2 - 96 * z2**3) - 30 * z2**3 - 90 * z2**4) * e(q) for q in half)
    k3 += root / (108 * z**6) * math.fsum((3 * pi2 * q * z2 - pi2**2 * q * q) * e(q) for q in whole)
    return min(1.0, max(0.0, 1 - (k0 + k1 / math.sqrt(n) + k2 / n + k3 / n**1.5)))


def ks_p_value(d: float | None, n_a: int, n_b: int) -> float | None:
    """Two-sided: by counting lattice paths while the larger sample has EXACT_UP_TO rows at most, else from the distribution of one sample of n_a n_b / (n_a + n_b)."""
    if d is None or not n_a or not n_b:
        return None
    if max(n_a, n_b) > EXACT_UP_TO:
        return _kolmogorov(float(round(n_a * n_b / (n_a + n_b))), d)
    h = round(d * math.lcm(n_a, n_b))
    if h <= 0:
        return 1.0
    return min(1.0, max(0.0, _outside_square(n_a, h) if n_a == n_b else _outside(n_a, n_b, h)))


def tests(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """(test, statistic, p_value): Welch and Kolmogorov-Smirnov, from one row of sums each."""
    w, k = welch(df, group, value, a, b).first(), ks(df, group, value, a, b).first()
    rows = [("welch_ttest", w["statistic"], t_p_value(w["statistic"], w["dof"])), ("ks_2samp", k["statistic"], ks_p_value(k["statistic"], k["n_a"] or 0, k["n_b"] or 0))]
    return df.sparkSession.createDataFrame(rows, "test string, statistic double, p_value double")


def means(df: DataFrame, by: str, columns: Sequence[str], prefix: str) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(f"{prefix}_{c}") for c in columns])


def compare(runs: dict[str, DataFrame], by: str, columns: Sequence[str], against: str | None = None) -> DataFrame:
    """Means of every method side by side, full outer; differences with the reference method, or of the first from the second."""
    out = None
    for name, df in runs.items():
        m = means(df, by, columns, name)
        out = m if out is None else out.join(m, by, "full")
    names = list(runs)
    for c in columns:
        if against:
            for n in names:
                if n != against:
                    out = out.withColumn(f"{n}_vs_{against}_{c}", F.col(f"{n}_{c}") - F.col(f"{against}_{c}"))
        else:
            out = out.withColumn(f"diff_{c}", F.col(f"{names[0]}_{c}") - F.col(f"{names[1]}_{c}"))
    return out


def errors(compared: DataFrame, columns: Sequence[str], methods: Sequence[str], against: str) -> DataFrame:
    """(metric, method, mae, bias, n) over the rows that all methods have."""
    rows = None
    for c in columns:
        common = compared.dropna(subset=[f"{m}_{c}" for m in (*methods, against)])
        for m in methods:
            d = F.col(f"{m}_vs_{against}_{c}")
            r = common.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.count(d).alias("n")).select(F.lit(c).alias("metric"), F.lit(m).alias("method"), "mae", "bias", "n")
            rows = r if rows is None else rows.unionByName(r)
    return rows


def stability(a: DataFrame, b: DataFrame, by: str, value: str, names: tuple[str, str] = ("pipeline", "baseline")) -> DataFrame:
    """Mean, spread and range of repeated runs of either method, and which one varies less."""

    def one(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(by).agg(py_round(F.avg(value), 2).alias(f"{tag}_mean"), py_round(F.stddev_samp(value), 3).alias(f"{tag}_std"), py_round(F.max(value) - F.min(value), 2).alias(f"{tag}_range"))

    x, y = names
    out = one(a, x).join(one(b, y), by, "left").withColumn("std_diff", py_round(F.col(f"{x}_std") - F.col(f"{y}_std"), 3))
    return out.withColumn("more_stable", F.when(F.col("std_diff") < 0, x).when(F.col("std_diff") > 0, y).otherwise("tie"))


def stack_groups(groups: dict[str, tuple[DataFrame, DataFrame]], by: str, required: Sequence[str], how: str = "full") -> DataFrame:
    """Both methods' rows of every group joined, groups on top of each other; rows without a required score go."""
    out = None
    for name, (a, b) in groups.items():
        r = a.join(b, by, how).withColumn("group", F.lit(name))
        out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    return out.dropna(subset=list(required))


def without(df: DataFrame, by: str, names: Sequence[str]) -> DataFrame:
    return df.where(~F.col(by).isin(*names))


def excluded_table(df: DataFrame, by: str, names: Sequence[str], group: str = "group") -> DataFrame:
    """(group, total_files, excluded_files, excluded_rate, excluded_names) and a row "overall"; the list of names is a parameter."""
    hit = F.col(by).isin(*names)
    out = df.rollup(group).agg(F.count("*").alias("total_files"), F.count_if(hit).alias("excluded_files"), py_round(F.count_if(hit) / F.count("*") * 100, 1).alias("excluded_rate"), F.array_join(F.sort_array(F.collect_list(F.when(hit, F.col(by)))), ", ").alias("excluded_names"))
    return out.withColumn(group, F.coalesce(group, F.lit("overall")))


def group_deltas(df: DataFrame, methods: Sequence[str], keys: Sequence[str], groups: tuple[str, str], group: str = "group") -> DataFrame:
    """(method, section, <group>_mean ×2, delta), rounded to one place; one pass over the rows."""
    long = df.unpivot([group], [f"{m}_{k}_score_100" for m in methods for k in keys], "name", "value")
    a, b = (F.avg(F.when(F.col(group) == g, F.col("value"))) for g in groups)
    out = long.groupBy("name").agg(py_round(a, 1).alias(f"{groups[0]}_mean"), py_round(b, 1).alias(f"{groups[1]}_mean"), py_round(a - b, 1).alias("delta"))
    method = F.regexp_extract("name", f"^({'|'.join(methods)})_(.*)_score_100$", 1)
    return out.select(method.alias("method"), F.regexp_extract("name", f"^({'|'.join(methods)})_(.*)_score_100$", 2).alias("section"), *[c for c in out.columns if c != "name"])


def delta_pivot(deltas: DataFrame, methods: Sequence[str]) -> DataFrame:
    values = [c for c in deltas.columns if c not in ("method", "section")]
    return deltas.groupBy("section").pivot("method", list(methods)).agg(*[F.first(v).alias(v) for v in values])


def set_scores(base: Column, pred: Column) -> dict[str, Column]:
    """tp, fp, fn, precision, recall, f1 of two arrays as sets; null where undefined."""
    tp, fp, fn = F.size(F.array_intersect(base, pred)), F.size(F.array_except(pred, base)), F.size(F.array_except(base, pred))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {"tp": tp, "fp": fp, "fn": fn, "precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r)}


def pair_by_position(base: DataFrame, pred: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The nth criterion of either side of a key, as far as both go; each has (criterion, chunks)."""

    def numbered(df: DataFrame, tag: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.select(*keys, nth.alias("pair_index"), F.col("criterion").alias(f"{tag}_criterion"), F.col("chunks").alias(f"{tag}_chunks"))

    out = numbered(base, "base").join(numbered(pred, "pred"), [*keys, "pair_index"])
    s = set_scores(F.col("base_chunks"), F.col("pred_chunks"))
    return out.select(*keys, "pair_index", "base_criterion", "pred_criterion", *[c.alias(k) for k, c in s.items()])


def f1_summary(pairs: DataFrame, *by: str) -> DataFrame:
    """criteria_n, sums, micro and macro figures by any keys, or of all rows."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    out = (pairs.groupBy(*by) if by else pairs.groupBy()).agg(F.count("*").alias("criteria_n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.avg("f1").alias("macro_f1"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.withColumn("micro_precision", p).withColumn("micro_recall", r).withColumn("micro_f1", F.try_divide(2 * p * r, p + r))


def variant_pivot(summary: DataFrame, by: str, variants: Sequence[str], value: str = "micro_f1") -> DataFrame:
    return summary.groupBy(by).pivot("variant", list(variants)).agg(F.first(value))


def section_score(signals: DataFrame, *by: str) -> DataFrame:
    """by and score_100: mean signal score on a scale to 100."""
    return signals.groupBy(*by).agg((F.avg("score") / 5 * 100).alias("score_100"))


def closest(df: DataFrame, reference: str, methods: Sequence[str], key: str) -> DataFrame:
    """key, distances of the methods from the reference, and the closest one; "tie" if the least is shared."""
    d = {m: F.abs(F.col(m) - F.col(reference)) for m in methods}
    least = F.least(*d.values())
    hits = sum((F.when(x == least, 1).otherwise(0) for x in d.values()), F.lit(0))
    name = F.coalesce(*[F.when(x == least, F.lit(m)) for m, x in d.items()])
    return df.select(key, *[x.alias(f"{m}_dist") for m, x in d.items()], F.when(hits > 1, "tie").otherwise(name).alias("closer"))


def paired_diff(df: DataFrame, key: str, phase: str, columns: Sequence[str], phases: tuple[str, str] = ("before", "after")) -> DataFrame:
    """key and after minus before of every column; raises unless every key has both phases."""
    b, a = phases
    halves = {p: df.where(F.col(phase) == p).select(key, *[F.col(c).alias(f"{p}_{c}") for c in columns]) for p in phases}
    lonely = halves[b].select(key).join(halves[a], key, "left_anti").unionByName(halves[a].select(key).join(halves[b], key, "left_anti"))
    if (bad := lonely.limit(5).collect()):
        raise ValueError(f"not in both phases: {sorted(str(r[0]) for r in bad)}")
    return halves[b].join(halves[a], key).select(key, *[(F.col(f"{a}_{c}") - F.col(f"{b}_{c}")).alias(c) for c in columns])


def feature_stats(diff: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, count, mean, std, min, max) in the order of columns."""
    long = diff.unpivot([], list(columns), "feature", "value")
    pos = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature"))
    total = long.groupBy("feature").agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return total.orderBy(pos)


def histogram(df: DataFrame, value: str, low: float = 0.0, high: float = 100.0, bins: int = 10, *by: str) -> DataFrame:
    """by, bin (from 1) and n; the last bin is closed, values outside are left out."""
    at = F.least(F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return df.where(F.col(value).between(low, high)).groupBy(*by, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def quantized_merge(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Rows of names that both have."""
    return a.join(b.select(by).distinct(), by, "left_semi")
