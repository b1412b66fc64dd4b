"""The whole scoring run: pool, stage 1, stage 2, repair, roll-up; baselines share all but the scorer's request."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..cluster import folder, is_complete, ship, stored
from ..functions import text as T
from ..operators import belief, chunks, repair, retrieval, rollup, rubric as R
from ..sources.ledger import Ledger
from ..sources.scorers import Generate, first_object

#: Stands for a document's chunk ids in a section's schema.
CHUNK_IDS = "@chunk_ids@"

#: Takes a table, or what makes it, and its name; gives the table back, kept.
Store = Callable[[DataFrame | Callable[[], DataFrame], str], DataFrame]


def _made(df: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    return df() if callable(df) else df


def keep_in_memory(df: DataFrame | Callable[[], DataFrame], _name: str) -> DataFrame:
    """For small trials: an executor that is lost has its tables made again."""
    return _made(df).persist()


def checkpointed(df: DataFrame | Callable[[], DataFrame], name: str) -> DataFrame:
    """Cut the plan with a table in the folder of spark.checkpoint.dir."""
    return stored(_made(df), name)


def store_in(path: str) -> Store:
    """Write what a run makes once to tables under path, and go on from them: a stopped run resumes.

    A table counts as made if its write came to an end; what a stopped write left is written again.
    """

    def put(df: DataFrame | Callable[[], DataFrame], name: str) -> DataFrame:
        spark, to = SparkSession.getActiveSession(), f"{path.rstrip('/')}/{name}"
        if not is_complete(spark, to):
            _made(df).write.mode("overwrite").parquet(to)
        return spark.read.parquet(to) if callable(df) else spark.read.schema(df.schema).parquet(to)

    return put


@dataclass
class Scored:
    chunks: DataFrame
    stage1_raw: DataFrame
    findings: DataFrame
    state: DataFrame
    stage2_raw: DataFrame
    signals: DataFrame
    subs: DataFrame
    sections: DataFrame
    overall: DataFrame
    results: DataFrame
    failures: DataFrame


ANSWERED = "doc_id string, section_pos int, section_name string, raw string, ok boolean, attempts int, error string"


def stage1(inputs: DataFrame, criteria_json: str, sub_ids: list[str], generate: Generate, ledger: Ledger, tokens: int = 8192, retries: int = 1) -> DataFrame:
    """(doc_id, section_pos, section_name, raw, ok, attempts, error): the nth sections of all documents in the nth step, each seeing the state of its document so far.

    Documents run side by side; the order within one is the method's own, so there are as many steps as the longest
    document has sections. Each step's answers are in the ledger before the next begins. What a document carries from
    step to step are the names of its sections and what was found in them. An answer that fails ends its document's
    run there. inputs are read once a step: give a written table.
    """
    spark = inputs.sparkSession
    ship(spark)
    begin = json.dumps({"seen": [], "known": []})

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            messages, schemas = [], []
            for name, content, held in zip(pdf["section_name"], pdf["content"], pdf["held"], strict=True):
                state = json.loads(held)
                view = json.dumps(belief.running_view(state["seen"], state["known"], sub_ids), ensure_ascii=False)
                messages.append(retrieval.stage1_request(name, content, criteria_json, view))
                schemas.append(json.dumps(R.evidence_schema(sub_ids, list(json.loads(content)))))
            yield pdf.assign(messages=messages, schema=schemas)

    def after(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, name, content, held, raw in zip(pdf["doc_id"], pdf["section_name"], pdf["content"], pdf["held"], pdf["raw"], strict=True):
                state = json.loads(held)
                state["seen"].append(name)
                state["known"].append(belief.section_findings(first_object(raw), name, sub_ids, list(json.loads(content))))
                out.append((doc, json.dumps(state, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["doc_id", "held"])

    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_pos"))
    rows = stored(inputs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("section_pos").cast("int").alias("section_pos"), "section_name", "content").withColumn("nth", nth), "stage1-sections")
    kinds = "doc_id string, section_pos int, section_name string, content string, held string"
    states, answered = None, []
    for n in range(1, (rows.agg(F.max("nth")).first()[0] or 0) + 1):
        mine = rows.where(F.col("nth") == n).drop("nth")
        mine = mine.withColumn("held", F.lit(begin)) if states is None else mine.join(states, "doc_id")
        requests = stored(mine.select("doc_id", "section_pos", "section_name", "content", "held").mapInPandas(asked, f"{kinds}, messages string, schema string"), "stage1-requests")
        said = stored(ledger.ask(f"stage1-{n:04d}", requests, generate, ("doc_id", "section_pos", "section_name"), tokens, retries), "stage1-answers")
        answered.append(said)
        good = requests.select("doc_id", "section_pos", "section_name", "content", "held").join(said.where("ok").select("doc_id", "section_pos", "raw"), ["doc_id", "section_pos"])
        states = stored(good.mapInPandas(after, "doc_id string, held string"), "stage1-states")
    out = spark.createDataFrame([], ANSWERED)
    for t in answered:
        out = out.unionByName(t)
    return out


def stage2_requests(chunk: DataFrame, beliefs: DataFrame, rubric: DataFrame) -> DataFrame:
    """(doc_id, section_key, messages, schema): one a rubric section, over the whole text; the schema names its signals and the document's chunks."""
    views = R.prompt_view(rubric)
    subs = R.subs(rubric).select("sub_id", "section_key")
    one = F.struct("belief_pos", F.to_json(F.struct("sub_id", "good", "bad", "implications")).alias("j"))
    held = beliefs.join(F.broadcast(subs), "sub_id").groupBy("doc_id", "section_key").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["j"]), ","), F.lit("]")).alias("beliefs"))
    sections: dict[str, dict[str, list[str]]] = {}
    for r in rubric.orderBy("section_pos", "sub_pos", "signal_pos").select("section_key", "sub_id", "sid").collect():  # a rubric's few hundred rows
        sections.setdefault(r["section_key"], {}).setdefault(r["sub_id"], []).append(r["sid"])
    forms = R.small(rubric.sparkSession, ((k, json.dumps(R.scoring_schema(list(x.items()), [CHUNK_IDS]))) for k, x in sections.items()), "section_key string, form string")
    ids = chunk.groupBy("doc_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("chunk_pos", "chunk_id"))), lambda x: x["chunk_id"])).alias("ids"))
    rows = retrieval.stage2_messages(retrieval.full_text(chunk).join(ids, "doc_id"), views, held, ("ids",)).join(F.broadcast(forms), "section_key")
    return rows.select("doc_id", "section_key", "messages", F.replace("form", F.lit(json.dumps([CHUNK_IDS])), F.col("ids")).alias("schema"))


def roll_up(responses: DataFrame, chunk: DataFrame, rubric: DataFrame, doc_types: DataFrame, evidence_cap: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(signals, subs, sections, overall) of stage-2 answers (doc_id, section_key, raw)."""
    spark = responses.sparkSession
    ids = chunk.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    signals, state = repair.normalize(responses, rubric, ids)
    places = ids.select("doc_id", F.map_from_entries(F.transform("chunk_ids", lambda c, i: F.struct(c, i))).alias("places"))
    state = state.join(places, "doc_id", "left").withColumn("used_chunk_ids", F.when(F.col("places").isNull(), F.col("used_chunk_ids")).otherwise(T.by_position(F.col("used_chunk_ids"), F.col("places")))).drop("places")
    rows = repair.scored_subs(signals, state, rubric, doc_types, R.excluded_subs(spark)).withColumn("signal_weight", F.coalesce("signal_weight", F.lit(1.0)))
    carry = ("doc_type", "sub_weight", "section_weight", "counts", "if_applicable", "used_chunk_ids", "evidence_status", "pros", "drawbacks", "missing_evidence")
    subs = rollup.sub_scores(rows, carry=carry)
    n = F.size("used_chunk_ids").cast("long")
    subs = subs.withColumn("evidence_count", n if evidence_cap is None else F.least(n, F.lit(evidence_cap))).withColumn("confidence_label", rollup.confidence_label(F.lit(0.0)))
    subs = rollup.cap(subs, R.score_caps(spark))
    sections = rollup.section_scores(subs, carry=("section_weight", "doc_type"))
    overall = rollup.overall_scores(sections, R.excluded_sections(spark))
    return signals, subs, sections, overall


def score(applications: DataFrame, rubric: DataFrame, generate: Generate, store: Store = checkpointed, evidence_cap: int | None = None, retries: int = 1, ledger: Ledger | None = None) -> Scored:
    """Applications (doc_id, raw) to scored results, by the given model.

    With a ledger in a folder that lasts, a run that was stopped anywhere asks again only for what it lacks.
    """
    ledger = ledger or Ledger(folder(applications.sparkSession, "ledger"))
    chunk = store(chunks.pool(applications), "chunks")
    types = store(applications.select(F.col("doc_id").cast("string").alias("doc_id"), F.lower(F.coalesce(F.get_json_object("raw", "$.doc_type"), F.lit(""))).alias("doc_type")), "doc_types")
    inputs = store(retrieval.section_inputs(chunk), "section_inputs")
    view = R.stage1_view(rubric).orderBy("section_pos", "sub_pos", "signal_pos").select("sid", "sub_id", "sub_name", "section_name", "text").collect()  # a rubric's few hundred rows
    subs = list(dict.fromkeys(r["sub_id"] for r in view))
    raw1 = store(lambda: stage1(inputs, json.dumps({"signals": [r.asDict() for r in view]}), subs, generate, ledger, retries=retries), "stage1_raw")
    sub_table = R.subs(rubric)
    valid = chunks.section_ids(chunk).withColumnRenamed("parser_section", "section_name")
    findings = store(belief.normalize(raw1.where("ok"), valid, sub_table.where("section_key <> 'application_form'")), "findings")
    state = store(belief.state(raw1.where("ok").select("doc_id", "section_pos", "section_name"), findings, sub_table), "belief_state")
    asked = store(stage2_requests(chunk, belief.beliefs(findings), rubric), "stage2_requests")
    raw2 = store(lambda: ledger.ask("stage2", asked, generate, ("doc_id", "section_key"), 80_000, retries), "stage2_raw")
    failed = raw1.where("not ok").select("doc_id", F.lit("stage1").alias("stage"), F.col("section_name").alias("part"), "raw", "attempts", "error").unionByName(raw2.where("not ok").select("doc_id", F.lit("stage2").alias("stage"), F.col("section_key").alias("part"), "raw", "attempts", "error"))
    good = raw2.join(failed.select("doc_id").distinct(), "doc_id", "left_anti")
    signals, sub, sections, overall = roll_up(good, chunk, rubric, types, evidence_cap)
    sub, sections, overall = store(sub, "sub_scores"), store(sections, "section_scores"), store(overall, "overall_scores")
    return Scored(chunk, raw1, findings, state, raw2, signals, sub, sections, overall, rollup.nested(overall, sections, sub), failed)


def baseline(applications: DataFrame, rubric: DataFrame, generate: Generate, store: Store = checkpointed, evidence_cap: int | None = None, retries: int = 1, ledger: Ledger | None = None) -> Scored:
    """The one-shot baseline: one request a document for all signals, then the same repair and roll-up as of the run.

    An answer holds sub-criteria at its top or by section; each section of the rubric takes its own from it.
    """
    ledger = ledger or Ledger(folder(applications.sparkSession, "ledger"))
    chunk = store(chunks.pool(applications), "baseline_chunks")
    types = store(applications.select(F.col("doc_id").cast("string").alias("doc_id"), F.lower(F.coalesce(F.get_json_object("raw", "$.doc_type"), F.lit(""))).alias("doc_type")), "baseline_doc_types")
    view = R.stage1_view(rubric).orderBy("section_pos", "sub_pos", "signal_pos").select("sid", "sub_id", "sub_name", "section_name", "text").collect()  # a rubric's few hundred rows
    asked = store(retrieval.baseline_messages(chunk, json.dumps({"signals": [r.asDict() for r in view]})), "baseline_requests")
    raw = store(lambda: ledger.ask("baseline", asked, generate, ("doc_id",), 80_000, retries), "baseline_raw")
    failed = raw.where("not ok").select("doc_id", F.lit("baseline").alias("stage"), F.lit("").alias("part"), "raw", "attempts", "error")
    keys = sorted({r["section_key"] for r in R.subs(rubric).select("section_key").distinct().collect()})  # a rubric's few sections
    by_section = raw.where("ok").withColumn("section_key", F.explode(F.array(*map(F.lit, keys))))
    found = F.from_json(T.json_object("raw"), "map<string,string>")
    own = F.try_element_at(found, F.col("section_key"))
    answers = by_section.select("doc_id", "section_key", F.coalesce(F.when(F.startswith(F.btrim(own), F.lit("{")), own), F.col("raw")).alias("raw"))
    signals, sub, sections, overall = roll_up(answers, chunk, rubric, types, evidence_cap)
    sub, sections, overall = store(sub, "baseline_sub_scores"), store(sections, "baseline_section_scores"), store(overall, "baseline_overall_scores")
    none = raw.limit(0)
    return Scored(chunk, none, none, none, raw, signals, sub, sections, overall, rollup.nested(overall, sections, sub), failed)


def run_id(name: Column, run: Column) -> Column:
    """The id under which one of many runs of a document goes: the run first, so that no name can be mistaken for it."""
    return F.concat_ws("#", run.cast("string"), name.cast("string"))


def run_parts(doc_id: Column) -> tuple[Column, Column]:
    """(name, run) of a run_id()."""
    run = F.substring_index(doc_id, "#", 1)
    return F.substring(doc_id, F.length(run) + 2, F.length(doc_id)), run.cast("int")


def repeated(applications: DataFrame, rubric: DataFrame, generate: Generate, runs: int, group: str | None = None) -> DataFrame:
    """Rows of runs (pdf_name, run_idx, group, overall figures, pool_size) of the same applications scored over and over."""
    numbered = applications.select(F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run_idx"), F.col("doc_id").alias("pdf_name"), "raw")
    s = score(numbered.select(run_id(F.col("pdf_name"), F.col("run_idx")).alias("doc_id"), "raw"), rubric, generate)
    size = s.chunks.groupBy("doc_id").agg(F.count("*").alias("pool_size"))
    rows = s.overall.join(size, "doc_id").join(rollup.mean_signal(s.signals), "doc_id")
    name, run = run_parts(F.col("doc_id"))
    return rows.select(name.alias("pdf_name"), run.alias("run_idx"), F.lit(group).cast("string").alias("group"), F.col("final_score_0to100").alias("overall_score_100"), "coverage_score_0to100", "avg_signal_score_0to5", "total_items", "signal_count", "good_items", "positive_items", "pool_size")
