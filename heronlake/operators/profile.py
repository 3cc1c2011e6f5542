"""Profiles of batch steps and progress of streams, as tables.

Counts are taken by Spark while the rows pass (``DataFrame.observe``), so a profile costs no pass of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from heronlake.sources.scratch import scratch

STEPS = "step string, place int, seconds double, counts map<string,double>"
PROGRESS = "name string, batch bigint, came bigint, progress double, counts map<string,double>"


class Profile:
    """The steps of a batch job: what each wrote, how long it took, and counts of its rows."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.steps = spark, []

    def step(self, name: str, rows: DataFrame, **counts: Column) -> DataFrame:
        """Write the rows of a step, count them as they pass (``n``, and what is named), and read them again."""
        seen, path, began = Observation(name), scratch(self.spark, "step"), time.monotonic()
        rows.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in counts.items())).write.parquet(path)
        told = {k: None if v is None else float(v) for k, v in seen.get.items()}
        self.steps.append((name, len(self.steps), time.monotonic() - began, told))
        return self.spark.read.schema(rows.schema).parquet(path)

    def table(self) -> DataFrame:
        """(step, place, seconds, counts)"""
        return self.spark.createDataFrame(self.steps, STEPS)


def profiled_search(profile: Profile, queries: DataFrame, chunks: DataFrame, qkey: str = "item_id", ckey: str = "chunk_id", text: str = "chunk") -> DataFrame:
    """Hybrid search with a profile: candidates of the fusion, those reranked, and the results."""
    from heronlake.operators import retrieval

    score = {"best": F.max("score"), "mean": F.avg("score")}
    found = profile.step("fusion", retrieval.fused(queries, chunks, qkey, ckey, text), dense=F.count_if(F.col("dense") > 0), sparse=F.count_if(F.col("sparse") > 0))
    best = profile.step("candidates", retrieval.top_k(found, qkey, "score", ckey, retrieval.RERANKED).drop("rank"), **score)
    ranked = profile.step("rerank", retrieval.rerank(best, queries, chunks, qkey, ckey, text), phrases=F.count_if(F.col("rerank_score") >= 1.0))
    return profile.step("results", retrieval.top_k(ranked, qkey, "final", ckey, retrieval.FINAL), best=F.max("final"), mean=F.avg("final"))


class Progress(StreamingQueryListener):
    """Hears the batches of streams and tells how far one is: from 25, by the share of its rows, to 95, then 100."""

    def __init__(self, total: int) -> None:
        self.total, self.rows, self.came, self.ended = total, [], 0, False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        told = {k: float(v) for m in p.observedMetrics.values() for k, v in m.asDict().items() if v is not None}
        self.came += int(told.get("came", p.numInputRows))
        self.rows.append((p.name or "", p.batchId, self.came, 25 + 70 * min(1.0, self.came / max(1, self.total)), told))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = event.exception is None

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, batch, came, progress, counts) of each batch, and a last row when the stream has ended."""
        last = [("", (self.rows[-1][1] + 1) if self.rows else 0, self.came, 100.0, {})] if self.ended else []
        return spark.createDataFrame(self.rows + last, PROGRESS)


def ingested(stream: DataFrame, total: int, write: Callable[[DataFrame], object], **counts: Column) -> Progress:
    """Run a stream to its end, as ``write`` starts it, with its progress over ``total`` rows."""
    spark, heard = stream.sparkSession, Progress(total)
    spark.streams.addListener(heard)
    try:
        query = write(stream.observe("ingested", F.count(F.lit(1)).alias("came"), *(c.alias(k) for k, c in counts.items())))
        query.awaitTermination()
        for _ in range(100):  # events come a little later
            if heard.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    return heard
