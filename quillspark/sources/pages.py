"""Pages of binary files as tables of words, characters, boxes and texts, by a decoder that is plugged in."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..cluster import ship
from ..functions import text as T

#: content -> pages, each a dict of text, width, height, words, chars, rects and optionally png
Decoder = Callable[[bytes], list[dict[str, Any]]]

PAGE = "doc_id string, page int, text string, page_width double, page_height double, words array<struct<text:string,x0:double,top:double,x1:double,bottom:double>>, boxes array<struct<top:double,bottom:double,width:double,fill:boolean>>, png string, error string"


def pdfplumber_decoder(content: bytes) -> list[dict[str, Any]]:
    """Needs pdfplumber, which is optional; characters of watermarks are left out."""
    import io

    import pdfplumber

    def keep(obj: dict) -> bool:
        c = obj.get("non_stroking_color")
        grey = isinstance(c, (list, tuple)) and len(c) == 3 and abs(c[0] - c[1]) < 0.05 and abs(c[1] - c[2]) < 0.05 and c[0] > 0.7
        return obj.get("object_type") != "char" or not grey

    out = []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for p in pdf.pages:
            clean = p.filter(keep)
            out.append({"text": clean.extract_text() or "", "width": float(p.width), "height": float(p.height), "words": clean.extract_words(x_tolerance=1, y_tolerance=3), "rects": p.rects})
    return out


def decode(files: DataFrame, decoder: Decoder = pdfplumber_decoder, id_col: str = "stem") -> DataFrame:
    """Rows of PAGE, one a page; a file that can't be decoded is one row with its error."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "page", "text", "page_width", "page_height", "words", "boxes", "png", "error"]
        for pdf in batches:
            out = []
            for doc, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    for i, p in enumerate(decoder(bytes(content))):
                        words = [{k: w[k] for k in ("text", "x0", "top", "x1", "bottom")} for w in p.get("words", [])]
                        boxes = [{"top": float(r["top"]), "bottom": float(r["bottom"]), "width": float(r.get("width", 0)), "fill": bool(r.get("fill"))} for r in p.get("rects", [])]
                        png = base64.b64encode(p["png"]).decode() if p.get("png") else None
                        out.append((doc, i, p.get("text", ""), float(p.get("width", 0)), float(p.get("height", 0)), words, boxes, png, None))
                except Exception as e:  # an unreadable file is a row with its error
                    out.append((doc, 0, "", 0.0, 0.0, [], [], None, repr(e)[:200]))
            yield pd.DataFrame(out, columns=columns)

    return files.select(F.col(id_col).cast("string").alias("doc_id"), "content").mapInPandas(run, PAGE)


def words(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", "page_height", F.explode("words").alias("w")).select("doc_id", "page", "w.*", "page_height")


def boxes(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", "page_width", F.explode("boxes").alias("b")).select("doc_id", "page", "b.*", "page_width")


def ocr_requests(pages: DataFrame) -> DataFrame:
    """(doc_id, page, messages) of pages with an image and without text, for a model that reads images."""
    image = F.struct(F.lit("user").alias("role"), F.lit("Transcribe the text of this page.").alias("content"), F.array("png").alias("images"))
    return pages.where("png is not null and trim(text) = ''").select("doc_id", "page", F.to_json(F.array(image)).alias("messages"))


def with_ocr(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """pages with the texts of a model's answers (doc_id, page, raw, ok) to ocr_requests; pages without an answer stay as they are.

    Thoughts before an answer and a fence around it go. Answers are read per page, so both sides shuffle by page only.
    """
    said = F.regexp_replace(F.col("raw"), r"(?s)<think>.*?</think>\s*", "")
    said = F.regexp_replace(F.btrim(said), r"(?s)\A```[a-z]*\n(.*?)\n?```\z", "$1")
    text = answers.where("ok").groupBy("doc_id", "page").agg(F.min(said).alias("ocr"))
    rows = pages.join(text, ["doc_id", "page"], "left")
    use = (T.text_or_empty("text") == "") & (T.text_or_empty("ocr") != "")
    return rows.withColumn("text", F.when(use, F.col("ocr")).otherwise(F.col("text"))).select(*pages.columns)
