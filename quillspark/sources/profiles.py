"""Profiles of researchers and citation counts: recorded answers of REST services as tables, online look-up opt-in."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..cluster import ship
from ..functions import text as T

WORKS = "group array<struct<`work-summary`:array<struct<`put-code`:string,title:struct<title:struct<value:string>>,`publication-date`:struct<year:struct<value:string>>,type:string,`external-ids`:struct<`external-id`:array<struct<`external-id-type`:string,`external-id-value`:string>>>>>>>"
FUNDINGS = "group array<struct<`funding-summary`:array<struct<title:struct<title:struct<value:string>>,type:string,organization:struct<name:string,address:struct<city:string,country:string>>,`start-date`:struct<year:struct<value:string>>>>>>"
PERSON = "name struct<`given-names`:struct<value:string>,`family-name`:struct<value:string>>, emails struct<email:array<struct<email:string>>>"
AGAIN = (429, 500, 502, 503, 504)


def _year(c: F.Column | None) -> F.Column:
    return F.when(c.rlike(r"^\d+$"), c.cast("int"))


def persons(raw: DataFrame) -> DataFrame:
    """(orcid, given_name, family_name, full_name, emails_public) of (orcid, raw)."""
    rows = raw.select("orcid", F.from_json("raw", PERSON).alias("p"))
    given, family = F.col("p.name.given-names.value"), F.col("p.name.family-name.value")
    mails = F.filter(F.coalesce(F.col("p.emails.email.email"), F.array().cast("array<string>")), lambda e: F.coalesce(e, F.lit("")) != "")
    return rows.select("orcid", given.alias("given_name"), family.alias("family_name"), F.concat_ws(" ", F.nullif(given, F.lit("")), F.nullif(family, F.lit(""))).alias("full_name"), mails.alias("emails_public"))


def works(raw: DataFrame, most: int | None = None) -> DataFrame:
    """(orcid, work_pos, put_code, title, year, type, doi): the first summary of every group, most of them at most."""
    rows = raw.select("orcid", F.posexplode(F.from_json("raw", WORKS)["group"]).alias("work_pos", "g")).select("orcid", "work_pos", F.get("g.work-summary", F.lit(0)).alias("s")).where("s is not null")
    if most is not None:
        rows = rows.where(F.col("work_pos") < most)
    ids = F.transform(F.coalesce(F.col("s.external-ids.external-id"), F.array().cast("array<struct<`external-id-type`:string,`external-id-value`:string>>")), lambda x: F.struct(x["external-id-type"].alias("type"), x["external-id-value"].alias("value")))
    return rows.select("orcid", "work_pos", F.col("s.put-code").alias("put_code"), F.col("s.title.title.value").alias("title"), _year(F.col("s.publication-date.year.value")).alias("year"), F.col("s.type").alias("type"), T.extract_doi(ids).alias("doi"))


def fundings(raw: DataFrame) -> DataFrame:
    rows = raw.select("orcid", F.posexplode(F.from_json("raw", FUNDINGS)["group"]).alias("funding_pos", "g")).select("orcid", "funding_pos", F.get("g.funding-summary", F.lit(0)).alias("s")).where("s is not null")
    return rows.select("orcid", "funding_pos", F.col("s.title.title.value").alias("title"), F.col("s.type").alias("type"), F.col("s.organization.name").alias("org"), F.col("s.organization.address.city").alias("org_city"), F.col("s.organization.address.country").alias("org_country"), _year(F.col("s.start-date.year.value")).alias("start_year"))


def http_get(url: str, timeout: float = 20) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""


Get = Callable[[str], tuple[int, str]]


def _asked(url: str, get: Get, retries: int, backoff: float) -> tuple[int, str]:
    """The last status and body; answers that say "later" are asked again after backoff * 2**n seconds."""
    status, body = 503, ""
    for attempt in range(retries + 1):
        try:
            status, body = get(url)
        except OSError:
            status, body = 503, ""
        if status not in AGAIN or attempt == retries:
            break
        time.sleep(backoff * 2**attempt)
    return status, body


def _outcome(status: int) -> str:
    return "ok" if status == 200 else "unavailable" if status in AGAIN else "missing"


class Pace:
    """Lets calls of all threads through one by one, rate a second at most; without a rate, at once."""

    def __init__(self, rate: float | None):
        self.gap, self.free_at, self.lock = 1 / rate if rate else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                at = max(time.monotonic(), self.free_at)
                self.free_at = at + self.gap
            time.sleep(max(0.0, at - time.monotonic()))


@dataclass(frozen=True)
class Ask:
    """How a service is asked: in_flight calls at once a task, rate calls a second by all tasks together, and again where it says "later".

    parallel is the number of tasks; with a rate, by default as many as the cluster has cores. Each task keeps to its
    part of the rate, retries included, so the whole is kept however many tasks run at once.
    """

    get: Get = http_get
    in_flight: int = 8
    rate: float | None = None
    parallel: int | None = None
    retries: int = 2
    backoff: float = 0.4

    def tasks(self, spark: SparkSession) -> int | None:
        return self.parallel or (spark.sparkContext.defaultParallelism if self.rate else None)

    def spread(self, rows: DataFrame) -> DataFrame:
        n = self.tasks(rows.sparkSession)
        return rows if n is None else rows.repartition(n)

    def answers(self, urls: Iterable[str], tasks: int | None) -> Iterator[tuple[int, str]]:
        """(status, body) of each URL, in their order; no more than 2 * in_flight are held."""
        pace = Pace(self.rate / (tasks or 1) if self.rate else None)

        def paced(url: str) -> tuple[int, str]:
            pace.wait()
            return self.get(url)

        with ThreadPoolExecutor(max(1, self.in_flight)) as pool:
            waiting: deque[Future] = deque()
            for url in urls:
                if len(waiting) >= 2 * max(1, self.in_flight):
                    yield waiting.popleft().result()
                waiting.append(pool.submit(_asked, url, paced, self.retries, self.backoff))
            while waiting:
                yield waiting.popleft().result()


def cited_by(dois: DataFrame, url: str, ask: Ask = Ask()) -> DataFrame:  # noqa: B008
    """(doi, cited_by, status) of distinct DOIs: ok, missing (the service doesn't know it) or unavailable (it didn't answer); cited_by is null but for ok.

    Write the result before using it twice.
    """
    ship(dois.sparkSession)
    tasks = ask.tasks(dois.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            said = ask.answers((f"{url}/https://doi.org/{doi}" for doi in pdf["doi"]), tasks)
            for doi, (status, body) in zip(pdf["doi"], said, strict=True):
                found, n = _outcome(status), None
                if found == "ok":
                    try:
                        n = int(json.loads(body).get("cited_by_count") or 0)
                    except (ValueError, AttributeError, TypeError):
                        found = "unavailable"
                out.append((doi, n, found))
            yield pd.DataFrame(out, columns=["doi", "cited_by", "status"]).astype({"cited_by": "Int64"})

    wanted = dois.select(T.normalize_doi("doi").alias("doi")).where("doi <> ''").distinct()
    return ask.spread(wanted).mapInPandas(run, "doi string, cited_by long, status string")


#: What a registry of researchers is asked for.
RECORDS = ("person", "works", "fundings")


def fetch(ids: DataFrame, url: str, ask: Ask = Ask(), records: tuple[str, ...] = RECORDS) -> DataFrame:  # noqa: B008
    """(orcid, record, raw, status): the answers for distinct researchers (orcid), to be read by persons(), works() and fundings().

    raw is null but for ok. Write the result before using it twice.
    """
    ship(ids.sparkSession)
    tasks = ask.tasks(ids.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = list(zip(pdf["orcid"], pdf["record"], strict=True))
            said = ask.answers((f"{url}/{orcid}/{record}" for orcid, record in asked), tasks)
            out = [(*key, body if status == 200 else None, _outcome(status)) for key, (status, body) in zip(asked, said, strict=True)]
            yield pd.DataFrame(out, columns=["orcid", "record", "raw", "status"])

    wanted = ids.select(F.btrim("orcid").alias("orcid")).where("orcid <> ''").distinct()
    wanted = wanted.select("orcid", F.explode(F.array(*map(F.lit, records))).alias("record"))
    return ask.spread(wanted).mapInPandas(run, "orcid string, record string, raw string, status string")


def record(fetched: DataFrame, name: str) -> DataFrame:
    """(orcid, raw) of one kind of answer."""
    return fetched.where((F.col("record") == name) & (F.col("status") == "ok")).select("orcid", "raw")
