"""spark-submit entry: parse a folder of files to application JSON, cut applications to chunks, or score them.

    python -m quillspark parse   IN_FOLDER OUT_FOLDER [--url URL --model NAME]
    python -m quillspark chunks  IN_FOLDER OUT_FOLDER
    python -m quillspark score   IN_FOLDER OUT_FOLDER --url URL --model NAME [--criteria FILE]
    python -m quillspark profile WORKS_JSON FUNDINGS_JSON OUT_FOLDER --year 2026
    python -m quillspark show    OUT_FOLDER/json|chunks DOCUMENT

Results are tables of few files with an index; show prints the rows of one document as JSON. score says what failed,
and ends with 1 if anything did.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from .operators import chunks, citations, rubric
from .plans import parsing, scoring
from .sources import files, packs, profiles
from .sources.ledger import Ledger
from .sources.scorers import Generate, HttpScorer


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("chunks", "score"):
        s = sub.add_parser(name)
        s.add_argument("source")
        s.add_argument("out")
    s.add_argument("--url", required=True)
    s.add_argument("--model", required=True)
    s.add_argument("--criteria")
    s = sub.add_parser("parse")
    for a in ("source", "out", "--url", "--model"):
        s.add_argument(a)
    s = sub.add_parser("profile")
    for a in ("works", "fundings", "out"):
        s.add_argument(a)
    s.add_argument("--year", type=int, required=True)
    s = sub.add_parser("show")
    s.add_argument("table")
    s.add_argument("document")
    return p.parse_args(args)


def main(args: list[str] | None = None, generate: Generate | None = None) -> int:
    """0, or 1 where documents failed. generate: a model in place of the one at --url."""
    o = arguments(args)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    if o.what == "show":
        rows = packs.read(spark, o.table, o.document)
        if "chunk_pos" in rows.columns:
            rows = rows.orderBy("chunk_pos")
        for r in rows.toJSON().toLocalIterator():
            print(r)
        return 0
    if o.what == "profile":
        works = profiles.works(files.json_files(spark, o.works).select(F.col("stem").alias("orcid"), "raw"))
        fundings = profiles.fundings(files.json_files(spark, o.fundings).select(F.col("stem").alias("orcid"), "raw"))
        citations.features(works.select("orcid").distinct(), works, fundings, None, o.year).write.mode("overwrite").parquet(o.out)
        return 0
    model = generate or (HttpScorer(o.url, o.model) if o.what != "chunks" and o.url and o.model else None)
    if o.what == "parse":
        packs.write(parsing.parse_folder(spark, o.source, f"{o.out}/parsed", model), f"{o.out}/json")
        return 0
    applications = files.json_files(spark, o.source).select(F.col("stem").alias("doc_id"), "raw")
    if o.what == "chunks":
        pool = scoring.checkpointed(chunks.pool(applications), "pool")
        packs.write(pool, f"{o.out}/chunks", order=("chunk_pos",))
        chunks.index_text(pool).write.mode("overwrite").parquet(f"{o.out}/index")
        return 0
    table = rubric.read(spark, o.criteria) if o.criteria else rubric.load(spark)
    done = scoring.score(applications, table, model, scoring.store_in(o.out), ledger=Ledger(f"{o.out}/ledger", o.model))
    done.results.write.mode("overwrite").parquet(f"{o.out}/results")
    done.failures.write.mode("overwrite").parquet(f"{o.out}/failures")
    failed = spark.read.schema(done.failures.schema).parquet(f"{o.out}/failures").groupBy("stage").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).orderBy("stage").collect()
    for r in failed:
        print(f"{r['stage']}: {r['n']} failed, the first of them {r['first']}; see {o.out}/failures", file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
