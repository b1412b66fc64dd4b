"""Files that arrive are decoded and scored as they come; progress and results are tables by job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..cluster import scratch, stored
from ..plans import parsing
from ..sources import files, pages as P
from .folding import fold_beliefs, section_events  # noqa: F401
from .keyed import Keyed

# Progress at the steps of a job.
STEPS = (("accepted", 10), ("parsed", 28), ("features", 40), ("profiles", 48), ("stage1", 62), ("stage2", 70), ("scored", 92), ("done", 100))
JOB = "job_id string, status string, phase string, progress int, detail string, at timestamp"
RESULT = "job_id string, result string, at timestamp"
FORMATS = (".json", ".pdf", ".docx", ".doc")
#: Batches after which the tables are merged.
MERGE_EVERY = 20

Work = Callable[[DataFrame], DataFrame]


def inbox(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(job_id, path, extension, content) of files that arrive in a folder; the id is what the name begins with if that is twelve hex digits, else as many of the path's hash."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)
    own = F.regexp_extract("path", r"/([0-9a-f]{12})(_[^/]*)?\.[^./]+$", 1)
    job = F.when(own != "", own).otherwise(F.substring(F.sha2("path", 256), 1, 12))
    return rows.select(job.alias("job_id"), "path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), "content")


def decoded(rows: DataFrame, decoder: P.Decoder = P.pdfplumber_decoder, fallback: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(job_id, path, raw, error) of inbox() rows: JSON as it is, documents as the parsers' JSON; raw is null where error says why.

    fallback takes the (doc_id, text) of documents and gives (doc_id, raw) for those that no layout fits.
    """
    text = F.decode("content", "UTF-8")
    known = F.col("extension").isin(*FORMATS)
    is_json = F.col("extension") == ".json"
    plain = rows.where(is_json | ~known).select("job_id", "path", F.when(is_json & F.try_parse_json(text).isNotNull(), text).alias("raw"), F.when(~known, F.concat(F.lit("no format of a document: "), "extension")).when(F.try_parse_json(text).isNull(), F.lit("not JSON")).alias("error"))
    papers = rows.where(known & ~is_json)
    if papers.isEmpty():
        return plain
    papers = stored(papers.withColumnRenamed("job_id", "doc_id"), "uploads")
    pages = stored(P.decode(papers.where("extension = '.pdf'"), decoder, "doc_id"), "upload-pages")
    docx = stored(files.docx_text(papers.where("extension <> '.pdf'").withColumn("name", F.col("doc_id"))).withColumnRenamed("name", "doc_id"), "upload-texts")
    texts = parsing.L.page_budget(pages).select("doc_id", "text").unionByName(docx.select("doc_id", "text"))
    done = parsing.parse(papers.select("doc_id", "extension"), pages, docx.select("doc_id", "text"), stored(fallback(texts), "upload-fallback") if fallback else None)
    said = pages.select("doc_id", "error").unionByName(docx.select("doc_id", "error")).groupBy("doc_id").agg(F.max("error").alias("said"))
    rows = papers.select("doc_id", "path").join(done, "doc_id", "left").join(said, "doc_id", "left")
    empty = F.coalesce("raw", F.lit("{}")) == "{}"
    return plain.unionByName(rows.select(F.col("doc_id").alias("job_id"), "path", F.when(~empty, F.col("raw")).alias("raw"), F.when(empty, F.concat(F.lit("no layout fits, or too little text could be read"), F.coalesce(F.concat(F.lit(": "), "said"), F.lit("")))).alias("error")))


def _status(df: DataFrame, phase: str, status: str = "running", detail: str = "") -> DataFrame:
    said = F.col("detail") if "detail" in df.columns else F.lit(detail)
    return df.select("job_id", F.lit(status).alias("status"), F.lit(phase).alias("phase"), F.lit(dict(STEPS).get(phase, 100)).alias("progress"), said.alias("detail"), F.current_timestamp().alias("at"))


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}".split("\n")[0][:200]


def isolated(rows: DataFrame, work: Work) -> tuple[list[DataFrame], dict[str, str]]:
    """work on all jobs of rows at once; where that fails, on either half of them, and so on. The written results, and the error of each job that fails alone.

    rows are a batch's, written: their ids are as many as files may come at once. One bad job costs about two tries for
    each halving, not the batch.
    """
    jobs = sorted(r["job_id"] for r in rows.select("job_id").distinct().collect())
    done, failed, todo = [], {}, [jobs] if jobs else []
    while todo:
        some = todo.pop()
        try:
            part = rows if some is jobs else rows.where(F.col("job_id").isin(some))
            done.append(stored(work(part), "results"))
        except Exception as e:
            if len(some) == 1:
                failed[some[0]] = _said(e)
            else:
                todo += [some[len(some) // 2 :], some[: len(some) // 2]]
    return done, failed


def job_table(spark: SparkSession, out: str) -> Keyed:
    return Keyed(spark, f"{out}/jobs", JOB, order=("progress", "at"))


def result_table(spark: SparkSession, out: str) -> Keyed:
    return Keyed(spark, f"{out}/results", RESULT)


def serve(source: DataFrame, out: str, work: Work, checkpoint: str, features: Work | None = None, once: bool = True, decoder: P.Decoder = P.pdfplumber_decoder, fallback: Work | None = None) -> StreamingQuery:
    """Run work on every micro-batch of inbox() rows, as (job_id, path, raw): (job_id, result) goes to the result table, the jobs' steps to the job table, both under out.

    Files that can't be read fail alone. A job fails alone too: where work gives a column error that isn't null, by
    that; where work raises, by being found among the others. features may fail: its error is noted and the batch goes
    on. A batch that is tried again replaces what it wrote before.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        with scratch():
            read = stored(decoded(df, decoder, fallback), "batch")
            bad = read.where("error is not null").withColumn("detail", F.col("error"))
            good = read.where("error is null").select("job_id", "path", "raw")
            log = _status(bad, "error", "failed").unionByName(_status(good, "accepted")).unionByName(_status(good, "parsed"))
            if features:
                try:
                    features(good).write.mode("overwrite").parquet(f"{out}/features/batch={number:012d}")
                    log = log.unionByName(_status(good, "features"))
                except Exception as e:
                    log = log.unionByName(_status(good, "features", detail=_said(e)))
            done, failed = isolated(good, work)
            told = lambda t: F.col("error").cast("string") if "error" in t.columns else F.lit(None).cast("string")
            rows = spark.createDataFrame(list(failed.items()), "job_id string, detail string").select("job_id", F.lit(None).cast("string").alias("result"), "detail")
            for t in done:
                rows = rows.unionByName(t.select("job_id", F.col("result").cast("string").alias("result"), told(t).alias("detail")))
            rows = stored(rows, "answers")
            well = rows.where("detail is null")
            log = log.unionByName(_status(rows.where("detail is not null"), "error", "failed"))
            log = log.unionByName(_status(well.drop("detail"), "scored")).unionByName(_status(well.drop("detail"), "done", "done"))
            result_table(spark, out).put(well.select("job_id", "result", F.current_timestamp().alias("at")), number)
            job_table(spark, out).put(log, number)
        if number % MERGE_EVERY == MERGE_EVERY - 1:
            result_table(spark, out).compact()
            job_table(spark, out).compact()

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def jobs(spark: SparkSession, out: str) -> DataFrame:
    """The furthest row of every job."""
    return job_table(spark, out).rows()


def job(spark: SparkSession, out: str, job_id: str) -> dict | None:
    """The furthest row of a job."""
    row = job_table(spark, out).of(job_id).first()
    return row.asDict() if row else None


def result(spark: SparkSession, out: str, job_id: str) -> tuple[int, str | None]:
    """(200, the result), (409, None) while it isn't done, (404, None) if there is no such job."""
    row = job(spark, out, job_id)
    if row is None:
        return 404, None
    if row["status"] != "done":
        return 409, None
    found = result_table(spark, out).of(job_id).first()
    return (200, found["result"]) if found else (404, None)


def history(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(job_id, modified, title, doc_type, overall, n_sections, size) of result files named by twelve hex digits, the latest first; files that aren't JSON are left out."""
    rows = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"))
    rows = rows.withColumn("job_id", F.regexp_extract("name", r"^([a-f0-9]{12})\.json$", 1)).where("job_id <> ''").where(F.try_parse_json("value").isNotNull())
    get = lambda p: F.get_json_object("value", p)
    return rows.select("job_id", "modified", get("$.title").alias("title"), get("$.doc_type").alias("doc_type"), get("$.overall.final_score_0to100").cast("double").alias("overall"), F.size(F.json_object_keys(get("$.features"))).alias("n_sections"), "size").orderBy(F.desc("modified"), F.desc("job_id"))


def history_page(spark: SparkSession, folder: str, size: int = 50, after: str | None = None) -> tuple[list[dict], str | None]:
    """(rows of history(), key): the size latest files after a key, and the key of what follows, null at the end. Only a page's files are opened.

    A key is the time in microseconds and the id of a page's last file.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    listed = listed.select("path", F.regexp_extract("path", r"/([a-f0-9]{12})\.json$", 1).alias("job_id"), F.unix_micros("modificationTime").alias("time")).where("job_id <> ''")
    if after:
        time, _, job_id = after.partition("-")
        listed = listed.where((F.col("time") < int(time)) | ((F.col("time") == int(time)) & (F.col("job_id") < job_id)))
    found = listed.orderBy(F.desc("time"), F.desc("job_id")).limit(size + 1).collect()
    if not found:
        return [], None
    page = found[:size]
    rows = history(spark, [r["path"] for r in page]).collect()
    return [r.asDict() | {"modified": r["modified"].isoformat()} for r in rows], f"{page[-1]['time']}-{page[-1]['job_id']}" if len(found) > size else None
