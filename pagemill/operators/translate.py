"""Requests to a language provider, retries, the second pass for missing ids, and reviews.

A provider is any object with ``translate(units) -> [(id, translation)]`` and
``review(units) -> [(id, ok, translation)]``; it raises ``ProviderError`` with a code.  The default one is
deterministic and needs no network.  Batches are rows; how many run at once is the number of partitions.
"""

from __future__ import annotations

import re
import tempfile
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text
from .batching import greedy_batches

# Error codes and which of them are worth another attempt.
RETRYABLE = {"network", "timeout", "rate_limit", "http"}
FATAL = {"auth", "payload_too_large", "invalid_response"}
ATTEMPTS, BACKOFF, MISSING_BATCH = 3, 1.5, 5


class ProviderError(Exception):
    def __init__(self, code: str, retry_after: float | None = None) -> None:
        super().__init__(code)
        self.code, self.retry_after = code, retry_after


class EchoProvider:
    """Keeps numbers, abbreviations and symbols, and stands a CJK sign for every other word."""

    KEEP = re.compile(r"[\d±≤≥°µμΔα-ωΣ]|^[A-Z]{2,}$|__[A-Z]+_\d+__")

    def translate(self, units: list[tuple[str, str]]) -> list[tuple[str, str]]:
        return [(i, " ".join(w if self.KEEP.search(w) else "文" for w in t.split())) for i, t in units]

    def review(self, units: list[tuple[str, str, str]]) -> list[tuple[str, bool, str | None]]:
        return [(i, True, None) for i, _, _ in units]


REPLIES = "doc_id long, batch int, id string, translation string, attempts int, error_code string"


def call(ask: Callable, units: list, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> tuple[list, int, str | None]:
    """(reply, attempts made, error code): retryable errors are tried again after a growing pause."""
    for n in range(1, attempts + 1):
        try:
            return list(ask(units)), n, None
        except ProviderError as e:
            if e.code in FATAL or e.code not in RETRYABLE or n == attempts:
                return [], n, e.code
            wait(e.retry_after if e.retry_after is not None else BACKOFF * 2 ** (n - 1))
    return [], attempts, None


def ask_batches(units: DataFrame, provider=None, concurrency: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``units`` (doc_id, batch, ord, id, text) -> one row per reply; a failed batch is one row with its code."""
    provider = provider or EchoProvider()
    batches = units.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "text"))).alias("units"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, batch, rows in zip(frame["doc_id"], frame["batch"], frame["units"]):
                reply, n, code = call(provider.translate, [(r["id"], r["text"]) for r in rows], wait=wait)
                out += [(doc, batch, i, t, n, None) for i, t in reply] if code is None else [(doc, batch, None, None, n, code)]
            yield pd.DataFrame(out, columns=["doc_id", "batch", "id", "translation", "attempts", "error_code"])

    return batches.repartition(concurrency, "doc_id", "batch").mapInPandas(run, REPLIES)


def accepted(units: DataFrame, replies: DataFrame) -> DataFrame:
    """Units with their translation, null where none came: invented ids and blanks go, one row an id stays."""
    good = replies.where(F.col("id").isNotNull() & (text.trim(F.col("translation")) != "")).groupBy("doc_id", "id").agg(F.min(text.clean_translation(F.col("translation"))).alias("translation"))
    return units.join(good, ["doc_id", "id"], "left")


def _said(replies: DataFrame) -> DataFrame:
    """``replies`` written before anything reads them, so that a paid request is made once whatever reads its answer.

    They go to spark.checkpoint.dir, or, in local mode without one (tests), to a folder of this machine.
    """
    context = replies.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = replies.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagemill-"))
    return replies.checkpoint(eager=True)


def translate(units: DataFrame, provider=None, concurrency: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``units`` (doc_id, ord, id, text) with ``translation`` and ``status`` (done, failed).

    Ids that the first pass did not bring are asked for once more, five to a request.
    """
    first = accepted(units, _said(ask_batches(greedy_batches(units), provider, concurrency, wait)))
    again = first.where("translation IS NULL").drop("translation")
    second = accepted(again, _said(ask_batches(greedy_batches(again, max_blocks=MISSING_BATCH), provider, concurrency, wait)))
    both = first.where("translation IS NOT NULL").unionByName(second)
    return both.withColumn("status", F.when(F.col("translation").isNotNull(), "done").otherwise("failed"))


def apply_review(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``entries`` (id, source, translation) with the first verdict (id, seq, ok, correction) of each applied.

    A correction counts if it is not blank, is still CJK where the translation was, and brings no new
    numeric error; a rejected one leaves the entry as it was, marked ok.  Entries without a verdict failed.
    """
    first = verdicts.groupBy("id").agg(F.min_by(F.struct("ok", "correction"), "seq").alias("v"))
    clean = text.clean_translation(F.col("v.correction"))
    cjk = lambda c: F.regexp_like(c, F.lit(text.CJK))
    errors = lambda c: text.bound(numeric.compare(F.col("source"), c), lambda d: F.size(d["missing"]) + F.size(d["added"]))
    wanted = ~F.col("v.ok") & F.col("v.correction").isNotNull() & (clean != "")
    good = wanted & (cjk(clean) | ~cjk(F.col("translation"))) & (errors(clean) <= errors(F.col("translation")))
    state = F.when(F.col("v").isNull(), "failed").when(F.coalesce(good, F.lit(False)), "corrected").otherwise("ok")
    judged = entries.join(first, "id", "left").withColumn("qa", state).withColumn("rejected", F.coalesce(wanted, F.lit(False)) & (F.col("qa") != "corrected"))
    return judged.withColumn("original", F.when(F.col("qa") == "corrected", F.col("translation"))).withColumn("translation", F.when(F.col("qa") == "corrected", clean).otherwise(F.col("translation"))).drop("v")
