"""Folders, JSON, CSV and other files in and out of DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..cluster import ship, stored
from ..functions.columns import strip


def folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".pdf", ".docx", ".doc")) -> DataFrame:
    """(path, name, stem, extension, length, modified, content) of a folder's files, not its subfolders'. In no order: see listing()."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    out = rows.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), extension.alias("extension"), "length", F.col("modificationTime").alias("modified"), "content")
    return out.where(F.col("extension").isin(*extensions))


def listing(files: DataFrame) -> DataFrame:
    """The files of folder() by name, without their contents, which the scan then doesn't read."""
    return files.drop("content").orderBy("name")


def docx_text(files: DataFrame) -> DataFrame:
    """(name, text, error): paragraphs, then tables with cells parted by tabs; text is null where the file can't be read or is empty."""

    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t")).strip()
        for pdf in batches:
            out = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                try:
                    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
                    parts = [t for p in body.findall(f"{w}p") if (t := said(p))]
                    parts += [t for tbl in body.findall(f"{w}tbl") for row in tbl.iter(f"{w}tr") if (t := "\t".join(said(c) for c in row.findall(f"{w}tc"))).strip()]
                    out.append((name, "\n".join(parts) or None, None))
                except Exception as e:  # an unreadable file is a row with its error
                    out.append((name, None, repr(e)[:200]))
            yield pd.DataFrame(out, columns=["name", "text", "error"])

    return files.select("name", "content").mapInPandas(run, "name string, text string, error string")


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, raw, modified): whole JSON files as text, keys in their order."""
    rows = spark.read.text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("raw"))
    return rows.withColumn("stem", F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.json$", ""))


def write_json(df: DataFrame, path: str, by: str = "doc_id", mode: str = "overwrite") -> None:
    """A folder a document."""
    df.write.mode(mode).partitionBy(by).json(path)


def keep_head(c: Column) -> Column:
    """A text with merge conflicts resolved to the first side."""
    return F.regexp_replace(c, r"(?m)^<<<<<<< [^\n]*\n((?s:.*?))^=======(?s:.*?)^>>>>>>> [^\n]*\n?", "$1")


def repaired(files: DataFrame) -> DataFrame:
    """json_files with raw repaired where it isn't JSON; null where that doesn't help."""
    ok = lambda c: F.try_parse_json(c).isNotNull()
    return files.withColumn("raw", F.when(ok(F.col("raw")), F.col("raw")).when(ok(keep_head(F.col("raw"))), keep_head(F.col("raw"))))


def unwrapped(raw: Column) -> Column:
    """A map of section to JSON whose values may be JSON in texts, with or without conflicts: as from_json gives both alike."""
    return F.transform_values(F.from_json(raw, "map<string,string>"), lambda _, v: F.when(F.try_parse_json(v).isNotNull(), v).otherwise(keep_head(v)))


def cached(candidates: DataFrame, cache: DataFrame, key: str = "stem", min_chars: int = 0) -> DataFrame:
    """Candidates that the cache (key, raw) doesn't hold, or holds with too little text."""
    good = cache.where(F.length("raw") >= min_chars).select(key)
    return candidates.join(good, key, "left_anti")


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a CSV file with a header; blank lines inside are dropped."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    df = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
    return df.dropna(how="all")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the log at path doesn't have; how many were new. Resume after a stop is a second call."""
    spark = df.sparkSession
    try:
        done = csv_rows(spark, path).select(F.col(key).cast("string").alias(key)).distinct()
        df = df.join(done, df[key].cast("string") == done[key], "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    df = df.persist()
    n = df.count()
    if n:
        write_csv(df, path, "append")
    df.unpersist()
    return n


SHEET = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
#: Fixed value: rows that a sheet can hold.
SHEET_ROWS = 1_048_576


def _column(name: str) -> int:
    """A1 -> 0, B7 -> 1, AA3 -> 26."""
    n = 0
    for c in name:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of a workbook's first sheet as texts, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        said = lambda node: "".join(t.text or "" for t in node.iter(f"{{{SHEET['m']}}}t"))
        shared = [said(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", SHEET)] if "xl/sharedStrings.xml" in names else []
        first = min(n for n in names if n.startswith("xl/worksheets/sheet") and n.endswith(".xml"))
        for row in ElementTree.fromstring(z.read(first)).iter(f"{{{SHEET['m']}}}row"):
            cells: list[str | None] = []
            for i, c in enumerate(row.findall("m:c", SHEET)):
                at, v = _column(c.get("r") or _letters(i)), c.find("m:v", SHEET)
                text = said(c) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text or 0)] if c.get("t") == "s" else v.text
                cells += [None] * (at + 1 - len(cells))
                cells[at] = text
            yield cells


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells) of the first sheet of workbooks; cells as texts, null where empty. A file that isn't a workbook has no rows."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(p, i, cells) for i, cells in enumerate(_sheet_rows(content))]
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook as a table of texts, named by its first row."""
    rows = sheet_rows(spark, path)
    head = rows.where("row = 0").select("cells").first()
    names = [n or f"column{i}" for i, n in enumerate(head["cells"])] if head else []
    return rows.where("row > 0").orderBy("row").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def write_sheet(df: DataFrame, path: str, order: list[str] | None = None) -> int:
    """Write a table as a workbook of one sheet, row by row over the driver; how many rows. A sheet holds SHEET_ROWS at most, else an error."""
    kinds = {c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint", "double", "float") or t.startswith("decimal")}
    spark, n = df.sparkSession, 1
    cell = lambda at, text: f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{relation}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SHEET["m"]}" xmlns:r="{relation}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            put = lambda i, cells: f.write(f'<row r="{i}">{"".join(cells)}</row>'.encode())
            f.write(f'<worksheet xmlns="{SHEET["m"]}"><sheetData>'.encode())
            put(1, [cell(f"{_letters(k)}1", c) for k, c in enumerate(df.columns)])
            for r in (df.orderBy(*order) if order else df).toLocalIterator():
                n += 1
                if n > SHEET_ROWS:
                    raise ValueError(f"more than {SHEET_ROWS} rows")
                put(n, [f'<c r="{_letters(k)}{n}"><v>{v}</v></c>' if c in kinds else cell(f"{_letters(k)}{n}", str(v)) for k, (c, v) in enumerate(zip(df.columns, r, strict=True)) if v is not None])
            f.write(b"</sheetData></worksheet>")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    to = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    to.write(bytearray(out.getvalue()))
    to.close()
    return n - 1


def append_sheet(df: DataFrame, path: str, key: str) -> int:
    """Add rows whose key the workbook at path doesn't have, after those that it has; how many were new. df's columns are matched by name."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return write_sheet(df.dropDuplicates([key]), path, [key])
    old = stored(read_sheet(spark, path).withColumn("_place", F.monotonically_increasing_id()), "sheet")
    new = df.dropDuplicates([key]).withColumn(key, F.col(key).cast("string")).join(old.select(key), key, "left_anti")
    n = new.count()
    if n:
        columns = [c for c in old.columns if c != "_place"]
        typed = [F.col(c).cast(df.schema[c].dataType).alias(c) if c in df.columns else F.col(c) for c in columns]
        added = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast("string").alias(c) for c in columns], F.lit(1 << 62).alias("_place"))
        both = old.unionByName(added.select(*[F.col(c).cast("string").alias(c) for c in columns], "_place")).orderBy("_place", key)
        write_sheet(both.select(*typed), path)
    return n


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The path of a glob that comes last by name."""
    try:
        return spark.read.format("binaryFile").load(pattern).agg(F.max("path")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def reference_scores(spark: SparkSession, path: str, suffix: str = "_codex") -> DataFrame:
    """(doc_id, sub_id, score) of score files <id><suffix>.json with sub_scores."""
    rows = json_files(spark, path)
    doc = F.coalesce(F.get_json_object("raw", "$.doc_id"), F.regexp_replace("stem", f"{suffix}$", ""))
    scores = F.from_json(F.get_json_object("raw", "$.sub_scores"), "map<string,double>")
    return rows.select(doc.alias("doc_id"), F.explode(scores).alias("sub_id", "score"))


def doc_types(cache: DataFrame) -> DataFrame:
    """(doc_id, doc_type) of parsed applications, lower-cased; empty where there is none."""
    return cache.select("doc_id", F.lower(F.coalesce(strip(F.get_json_object("raw", "$.doc_type")), F.lit(""))).alias("doc_type"))
