"""Mixing sources to target weights by iterative proportional fitting.

Token counts of documents add up to cells of source, language and topic. Raking
scales the cells in turn to the target share of every source, language and topic
until the margins agree. A cell gives at most its tokens, so for the draw the cells
are raked again with those that are whole held, so that the expected tokens are
RATE of all and every margin is at its target, or as near as its tokens allow: a
value with too few tokens for its target at RATE is taken whole. The gaps of the
expected draw to the targets are returned. A hash of the id decides, so a rerun
draws the same documents.

Targets default to the margins' token shares raised to POWER (which lifts small
ones) and scaled to 1. Given targets may leave values out (share 0) or name values
without tokens (ignored); shares are scaled to what is there.

Null source, language or topic is a value of its own. Null or empty texts have no
tokens: they belong to a cell and are drawn like its other documents. Repeated
rows and ids each count and share one fate; so do null ids. An empty table gives no
rows. Very long texts count whole. Columns of the operator's own names in a table
that it is given are not read, but for the margins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE_CLASS, scratch, stored

POWER = 0.7
RATE = 0.7
#: Largest relative gap at which margins agree, the sweeps to get there at most, and how many are planned at once.
TOLERANCE, MOST_SWEEPS, STEP = 1e-9, 600, 4
#: If this many sweeps lower the gap by less than a hundredth, no weights meet all margins, and those reached are taken.
STALLED = 24
#: Cells up to this number are swept in one task, without shuffles.
FEW = 10_000
MARGINS = ("source", "lang", "topic")
_NULL = "\0null"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """What a text is about by the marks in it: the first that fits."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.lower(text)
    return (
        F.when(low.contains("license"), "legal")
        .when(text.contains("@"), "contact")
        .when(text.contains(" | "), "table")
        .when(low.contains("token") | low.contains("password"), "code")
        .when(F.length(text) > 4000, "long prose")
        .otherwise("prose")
    )


def cells(docs: DataFrame, tokens: str = "tokens", margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """One row a cell: margins (nulls named), n_docs, n (its tokens)."""
    named = [F.coalesce(F.col(m).cast("string"), F.lit(_NULL)).alias(m) for m in margins]
    return docs.groupBy(*named).agg(F.count("*").alias("n_docs"), F.sum(tokens).alias("n"))


def swept(cell: DataFrame, name: str, sweep: Callable[[DataFrame], DataFrame], gap: Column, n_cells: int, tolerance: float, sweeps: int) -> DataFrame:
    """cell after sweeps until the largest gap is tolerance at most, or stays where it is. Each STEP of them is written, so plans stay small and a lost executor costs one step."""
    seen: list[float] = []
    for _ in range(0, sweeps, STEP):
        for _ in range(STEP):
            cell = sweep(cell)
        cell = gathered(stored(cell, name), n_cells)
        seen.append(cell.select(gap.alias("off")).agg(F.max("off")).first()[0] or 0.0)
        if seen[-1] <= tolerance or (len(seen) > STALLED // STEP and seen[-1] > 0.99 * seen[-1 - STALLED // STEP]):
            break
    return cell


def rake(cell: DataFrame, targets: dict[str, dict[str, float]] | None = None, margins: tuple[str, ...] = MARGINS, power: float = POWER, tolerance: float = TOLERANCE, sweeps: int = MOST_SWEEPS) -> DataFrame:
    """cell with weight: tokens after raking, adding up to 1; and off, the largest relative gap that is left in a margin.

    A cell's sums are few rows, so windows by a margin's value hold cells, not documents. off is over tolerance only
    where no weights meet all targets (a value's only cells lie where another margin's target is 0).
    """
    total = cell.agg(F.sum("n")).first()[0] or 0
    out = cell.withColumn("weight", F.try_divide(F.col("n"), F.lit(float(total))))
    for m in margins:
        w = Window.partitionBy(m)
        if targets and m in targets:
            shares = F.create_map(*[F.lit(v) for k, x in targets[m].items() for v in (k, float(x))])
            raw = F.coalesce(F.try_element_at(shares, F.col(m)), F.lit(0.0))
        else:
            raw = F.pow(F.sum("weight").over(w), power)
        raw = F.when(F.sum("weight").over(w) > 0, raw).otherwise(0.0)
        out = stored(out.withColumn(f"to_{m}", raw), "cells")
        whole = out.groupBy(m).agg(F.first(f"to_{m}").alias("x")).agg(F.sum("x")).first()[0] or 1.0
        out = out.withColumn(f"to_{m}", F.col(f"to_{m}") / whole)

    def sweep(c: DataFrame) -> DataFrame:
        for m in margins:
            whole = F.sum("weight").over(Window.partitionBy(m))
            c = c.withColumn("weight", F.coalesce(F.col("weight") * F.try_divide(F.col(f"to_{m}"), whole), F.lit(0.0)))
        return c

    gaps = [F.abs(F.coalesce(F.try_divide(F.sum("weight").over(Window.partitionBy(m)), F.col(f"to_{m}")), F.lit(1.0)) - 1) for m in margins]
    off = F.greatest(*gaps)
    out = stored(out, "cells")
    n_cells = out.count()
    return swept(gathered(out, n_cells), "raked", sweep, off, n_cells, tolerance, sweeps).withColumn("off", off)


def gathered(cell: DataFrame, n_cells: int) -> DataFrame:
    return cell.coalesce(1) if n_cells <= FEW else cell


def held(cell: DataFrame, margin: str, cap: str, weight: str, goal: Column) -> DataFrame:
    """cell with weight scaled by one factor a value of margin, so that the sum of min(cap, weight) there is goal (at most the caps' sum).

    By rising weight / cap, a factor f gives min over k of (the caps after k) + f * (the weights up to k); the largest f that some k asks for is right.
    """
    one = Window.partitionBy(margin)
    upto = one.orderBy(F.coalesce(F.try_divide(F.col(weight), F.col(cap)), F.lit(0.0))).rowsBetween(Window.unboundedPreceding, 0)
    out = cell.withColumns({"_after": F.sum(cap).over(one) - F.sum(cap).over(upto), "_upto": F.sum(weight).over(upto)})
    factor = F.max(F.try_divide(goal - F.col("_after"), F.col("_upto"))).over(one)
    return out.withColumn(weight, F.coalesce(F.col(weight) * factor, F.lit(0.0))).drop("_after", "_upto")


def calibrate(raked: DataFrame, rate: float = RATE, margins: tuple[str, ...] = MARGINS, tolerance: float = TOLERANCE, sweeps: int = MOST_SWEEPS) -> DataFrame:
    """raked with probability, and a gap_ column a margin: the expected draw's share of the value over its target, less 1.

    Cells are raked again with min(n, tokens) in place of tokens: a cell that is whole holds, and the others of its
    margins make up for it. A value whose tokens are too few for its target at this rate is taken whole, and the
    other values of the margin share the rest in proportion to their targets.
    """
    base = raked.withColumn("_cap", F.when(F.col("weight") > 0, F.col("n")).otherwise(0).cast("long"))
    r = base.agg(F.sum("n").alias("n"), F.sum("_cap").alias("cap"), F.count("*").alias("cells")).first()
    goal = min(rate * (r["n"] or 0), float(r["cap"] or 0))
    out = base.withColumn("_x", F.col("weight") * goal)
    for m in margins:  # what each value can give: its share of the goal, no more than it has
        value = base.groupBy(m).agg(F.first(f"to_{m}").alias("_to"), F.sum("_cap").alias("_has")).withColumn("_all", F.lit(0))
        value = held(value, "_all", "_has", "_to", F.lit(goal)).select(F.col(m).alias("_value"), F.least(F.col("_to"), F.col("_has").cast("double")).alias(f"_goal_{m}"))
        out = out.join(stored(value, "goals"), F.col(m) == F.col("_value"), "left").drop("_value")
    out = gathered(stored(out, "goals"), r["cells"])
    x = F.least(F.col("_x"), F.col("_cap").cast("double"))
    share = {m: F.try_divide(F.sum(x).over(Window.partitionBy(m)), F.lit(goal)) for m in margins}

    def sweep(c: DataFrame) -> DataFrame:
        for m in margins:
            c = held(c, m, "_cap", "_x", F.col(f"_goal_{m}"))
        return c

    off = F.greatest(*[F.abs(F.coalesce(F.try_divide(share[m] * goal, F.col(f"_goal_{m}")), F.lit(1.0)) - 1) for m in margins])
    out = swept(out, "held", sweep, off, r["cells"], tolerance, sweeps)
    gaps = {f"gap_{m}": F.try_divide(share[m], F.col(f"to_{m}")) - 1 for m in margins}
    # a cell without tokens is drawn at the overall rate
    probability = F.when(F.col("n") == 0, F.lit(float(rate))).otherwise(F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("_x"), F.col("n"))), F.lit(0.0)))
    return out.withColumns(gaps | {"probability": probability}).drop("_x", "_cap", *[f"_goal_{m}" for m in margins])


def draw(id_col: Column, seed: int = 17) -> Column:
    """Uniform in [0, 1) by a hash of the id."""
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double") / float(1 << 53)


def assign(docs: DataFrame, cell: DataFrame, id_col: str = "doc_id", margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """docs with probability, weight, a gap_ column a margin, and kept.

    cell was written and read again, so the planner knows its size and broadcasts it only if it is small.
    """
    right = stored(cell.select(*[F.col(m).alias(f"_{m}") for m in margins], "probability", F.coalesce(F.try_divide(F.col("weight"), F.col("n")), F.lit(0.0)).alias("weight"), *[f"gap_{m}" for m in margins]), "probabilities")
    on = None
    for m in margins:
        c = F.coalesce(docs[m].cast("string"), F.lit(_NULL)) == right[f"_{m}"]
        on = c if on is None else on & c
    return docs.join(right, on, "left").drop(*[f"_{m}" for m in margins]).withColumn("kept", draw(F.col(id_col)) < F.col("probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, topic_of: Callable[[Column], Column] = topic) -> tuple[DataFrame, DataFrame]:
    """(documents with tokens, topic, probability, weight, gaps, kept and without their text; the calibrated cells). topic_of: from a text to its topic."""
    rows = stored(docs.select(id_col, "source", "lang", topic_of(F.col(text_col)).alias("topic"), n_tokens(F.col(text_col)).alias("tokens")), "tokens")
    with scratch() as keep:
        cell = keep(stored(calibrate(rake(cells(rows), targets), rate), "calibrated"))
    return assign(rows, cell, id_col), cell
