"""Model calls as a replaceable function of a request, in batches on executors, with a retry on malformed JSON."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..cluster import ship

#: messages JSON, schema JSON, tokens -> the answer's text
Generate = Callable[[str, str, int], str]


@dataclass(frozen=True)
class HttpScorer:
    """A chat endpoint that takes messages and a JSON Schema."""

    url: str
    model: str
    temperature: float = 0.1
    top_p: float = 0.9
    timeout: float = 1200
    context: int = 131_072

    def body(self, messages: str, schema: str, tokens: int) -> dict:
        options = {"temperature": self.temperature, "top_p": self.top_p, "num_predict": tokens, "num_ctx": self.context}
        return {"model": self.model, "messages": json.loads(messages), "format": json.loads(schema or "{}"), "stream": False, "think": False, "options": options}

    def __call__(self, messages: str, schema: str, tokens: int) -> str:
        data = json.dumps(self.body(messages, schema, tokens)).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, data, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
            message = json.load(r).get("message") or {}
        return message.get("content") or message.get("thinking") or ""


@dataclass(frozen=True)
class FakeScorer:
    """Answers by the first pattern that the messages match; for tests and dry runs."""

    answers: tuple[tuple[str, str], ...]
    otherwise: str = "{}"

    def __call__(self, messages: str, schema: str, tokens: int) -> str:
        return next((a for p, a in self.answers if re.search(p, messages)), self.otherwise)


def first_object(text: str) -> dict:
    """The JSON object in an answer; raises ValueError if there is none."""
    text = re.sub(r"(?s)<think>.*?</think>\s*", "", text or "").strip()
    start, end = text.find("{"), text.rfind("}")
    found = json.loads(text[start : end + 1] if 0 <= start < end else text)
    if not isinstance(found, dict):
        raise ValueError("no JSON object")
    return found


def call(requests: DataFrame, generate: Generate, keys: tuple[str, ...], tokens: int = 8192, retries: int = 1) -> DataFrame:
    """keys, raw, ok, attempts, error of requests (keys, messages, schema, and tokens where requests have a budget of their own). Write the result before using it twice.

    A malformed answer is asked for again; an answer that stays so, or a call that fails, is a row with its error.
    """
    ship(requests.sparkSession)
    kinds = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for m, s, most in zip(pdf["messages"], pdf["schema"], pdf["tokens"], strict=True):
                raw, ok, n, error = "", False, 0, None
                for n in range(1, retries + 2):
                    try:
                        raw = generate(m, s, int(most))
                    except Exception as e:
                        error = repr(e)[:300]
                        break
                    try:
                        first_object(raw)
                        ok, error = True, None
                        break
                    except ValueError as e:
                        error = f"malformed: {e}"[:300]
                out.append((raw, ok, n, error))
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), pd.DataFrame(out, columns=["raw", "ok", "attempts", "error"])], axis=1)

    schema = F.col("schema") if "schema" in requests.columns else F.lit("{}")
    messages = F.col("messages") if requests.schema["messages"].dataType.simpleString() == "string" else F.to_json("messages")
    budget = F.col("tokens") if "tokens" in requests.columns else F.lit(tokens)
    return requests.select(*keys, messages.alias("messages"), schema.alias("schema"), budget.alias("tokens")).mapInPandas(run, f"{kinds}, raw string, ok boolean, attempts int, error string")


def recorded(requests: DataFrame, responses: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Answers from a table of recorded ones (keys, raw); a request without one is a row with an error."""
    out = requests.select(*keys).join(responses.select(*keys, "raw"), list(keys), "left")
    return out.select(*keys, F.coalesce("raw", F.lit("")).alias("raw"), F.col("raw").isNotNull().alias("ok"), F.lit(1).alias("attempts"), F.when(F.col("raw").isNull(), F.lit("no recorded answer")).alias("error"))
