"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (role and text) is rendered once as the prompt;
what remains of either side is its completion. A mask lists the character spans of
a completion that are trained on: text and end mark of assistant turns.

Null roles and texts count as empty. Two equal conversations give a prompt and
empty completions. Turns of one number order by role, then text; repeated turns
stay. A pair needs both sides; rows with a null id are left out. An empty table
gives no pairs. Very long texts and conversations are rendered whole: a pair is one
row. Extra columns, of any name, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, SHUT, END = "<|", "|>\n", "<|end|>"
TRAINED = "assistant"


def turns(df: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """Rows (pair_id, chosen, rejected) with arrays of turns, from a table of turns."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = df.select(pair.alias("pair_id"), chosen.alias("is_chosen"), turn.alias("turn")).where("pair_id is not null and is_chosen is not null")
    side = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.col("turn")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = rows.groupBy("pair_id").agg(side(F.col("is_chosen")).alias("chosen"), side(~F.col("is_chosen")).alias("rejected"))
    return out.where((F.size("chosen") > 0) & (F.size("rejected") > 0))


def swapped(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows (pair_id, chosen, rejected) from a table of conversations without preferences.

    A conversation is the chosen side; the rejected one has the same turns, but for the last assistant turn,
    whose text is that of the next conversation's (by number). Conversations without such a turn, or without a
    next one that has it, give no pair. One exchange: an assistant turn also goes to the conversation before,
    of which all but the last of a task are dropped before the shuffle.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = df.select(F.col(id_col).cast("long").alias("pair_id"), turn.alias("own")).where("pair_id is not null")
    none = F.lit(None).cast(rows.schema["own"].dataType)
    both = F.array(F.struct("pair_id", "own", none.alias("next")), F.struct((F.col("pair_id") - 1).alias("pair_id"), none.alias("own"), F.col("own").alias("next")))
    rows = rows.select(F.explode(F.when(F.col("own.role") == TRAINED, both).otherwise(F.slice(both, 1, 1))).alias("r")).select("r.*")
    rows = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list("own")).alias("t"), F.max("next")["text"].alias("other"))
    rows = rows.select("pair_id", "other", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("chosen"))
    back = F.array_position(F.transform(F.reverse("chosen"), lambda t: t["role"]), TRAINED)
    rows = rows.withColumn("at", (F.size("chosen") - back).cast("int")).where((back > 0) & F.col("other").isNotNull())
    changed = F.transform("chosen", lambda t, i: F.when(i == F.col("at"), F.struct(t["role"].alias("role"), F.col("other").alias("text"))).otherwise(t))
    return rows.select("pair_id", "chosen", changed.alias("rejected"))


def _render(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(SHUT), t["text"], F.lit(END + "\n"))), "")


def _mask(part: Column) -> Column:
    """start:end of trained spans, in characters of the rendered part, comma-joined."""

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + len(OPEN) + F.length(t["role"]) + len(SHUT)
        end = start + F.length(t["text"]) + len(END)
        spans = F.when(t["role"] == TRAINED, F.concat(a["spans"], F.array(F.concat_ws(":", start.cast("string"), end.cast("string"))))).otherwise(a["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(part, start, step, lambda a: a["spans"]), ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    both = F.least(F.size("chosen"), F.size("rejected"))
    equal = F.transform(F.slice("chosen", 1, both), lambda t, i: t == F.get("rejected", i))
    df = pairs.withColumn("equal", equal)
    first = F.array_position("equal", False)
    df = df.withColumn("n_prompt_turns", F.when(first == 0, F.size("equal")).otherwise(first - 1).cast("long"))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns").cast("int") + 1, F.size(c))
    df = df.select("pair_id", "n_prompt_turns", F.slice("chosen", F.lit(1), F.col("n_prompt_turns").cast("int")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return df.select("pair_id", "n_prompt_turns", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def pairs_sql(sides: str) -> str:
    """format_pairs in SQL, over sides (pair_id, side, role, text, pos): the turns of both sides, 0 the chosen, numbered from 1."""
    return rf"""
WITH {sides},
sizes AS (
  SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM t GROUP BY pair_id
), both_sides AS (SELECT * FROM sizes WHERE nc > 0 AND nr > 0),
apart AS (
  SELECT c.pair_id, min(c.pos) AS differ FROM t c JOIN t r ON r.pair_id = c.pair_id AND r.side = 1 AND r.pos = c.pos
  WHERE c.side = 0 AND (c.role <> r.role OR c.text <> r.text) GROUP BY c.pair_id
), cut AS (SELECT b.pair_id, coalesce(a.differ - 1, least(b.nc, b.nr)) AS n FROM both_sides b LEFT JOIN apart a USING (pair_id)),
rendered AS (
  SELECT t.*, cut.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS out, length(role) + 5 AS head FROM t JOIN cut USING (pair_id)
), placed AS (
  SELECT *, coalesce(sum(CASE WHEN pos > n THEN length(out) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM rendered
), marked AS (
  SELECT *, CAST(begun + head AS BIGINT) || ':' || CAST(begun + head + length(text) + 7 AS BIGINT) AS span FROM placed
)
SELECT pair_id, max(n) AS n_prompt_turns,
  coalesce(string_agg(out, '' ORDER BY pos) FILTER (side = 0 AND pos <= n), '') AS prompt,
  coalesce(string_agg(out, '' ORDER BY pos) FILTER (side = 0 AND pos > n), '') AS chosen,
  coalesce(string_agg(out, '' ORDER BY pos) FILTER (side = 1 AND pos > n), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 0 AND pos > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 1 AND pos > n AND role = 'assistant'), '') AS rejected_mask
FROM marked GROUP BY pair_id
"""


_NUMBERED = """row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos"""

#: Of neighbouring conversation numbers.
NEIGHBOURS_SQL = pairs_sql(f"""t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text, {_NUMBERED}
  FROM conversations WHERE conv_id IS NOT NULL
)""")

#: Of conversations whose last assistant turn is exchanged for the next one's.
SWAPPED_SQL = pairs_sql(f"""c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, {_NUMBERED} FROM conversations WHERE conv_id IS NOT NULL
), last AS (SELECT conv_id, max(pos) AS place, max_by(text, pos) AS said FROM c WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT a.conv_id AS pair_id, a.place, b.said FROM last a JOIN last b ON b.conv_id = a.conv_id + 1),
t AS (
  SELECT pair_id, 0 AS side, role, text, pos FROM c JOIN p ON pair_id = conv_id
  UNION ALL SELECT pair_id, 1, role, CASE WHEN pos = place THEN said ELSE text END, pos FROM c JOIN p ON pair_id = conv_id
)""")
