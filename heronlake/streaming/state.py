"""Keyed state over streams: admission by sliding windows, caches with expiry, and backoff.

Each is a processor whose state Spark keeps by key, so decisions carry on over triggers and restarts, and a timer that clears
the state once it can't matter any more. Rows of a key are taken by time within a trigger, and triggers are taken to come in
time order; a row behind the watermark is dropped. The decisions are those of the folds in ``operators.activity``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heronlake.sources.scratch import scratch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The longest wait between tries, in seconds, and the greatest share that is added to it.
LONGEST, JITTER = 60.0, 0.1


def together(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """What a trigger brings of a key, in order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable")


class Admission(StatefulProcessor):
    """A request is admitted if fewer than ``limit`` were in the last ``seconds``; rejected ones don't count."""

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.window = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.held.get()] if self.held.exists() else []
        told, batch = [], together(rows, "t_", "tie_")
        for t in batch["t_"]:
            held = [x for x in held if x > t - self.window]
            told.append(len(held) < self.limit)
            if told[-1]:
                held.append(t)
        self.held.put([(int(x),) for x in held])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((held[-1] + self.window) // 1000) + 1)
        yield pd.DataFrame({"key_": [key[0]] * len(told), "tie_": batch["tie_"], "admitted": told})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()  # all that it holds lies before the window of what can still come
        return iter(())


class Cache(StatefulProcessor):
    """A get has the value that was last set for its key, unless it is older than ``seconds``."""

    def __init__(self, seconds: int) -> None:
        self.life = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint, v string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        ids, found = [], []
        for r in together(rows, "t_", "get_", "id_").itertuples(index=False):
            if r.get_:
                ids.append(r.id_)
                found.append(last[1] if last is not None and r.t_ - last[0] <= self.life else None)
            else:
                last = (int(r.t_), r.v_)
        if last is not None:
            self.last.update(last)
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((last[0] + self.life) // 1000) + 1)
        yield pd.DataFrame({"id_": ids, "cached": pd.Series(found, dtype=object)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())


class Backoff(StatefulProcessor):
    """Waits that double with each failure in a row, and are at least what the answer asks for; a success starts again. A
    key that is idle for ``forget`` seconds (0: never) starts again too."""

    def __init__(self, forget: int = 0) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.failures.get()[0] if self.failures.exists() else 0
        out, batch = [], together(rows, "t_", "id_")
        for ident, ok, after in zip(batch["id_"], batch["ok_"], batch["after_"], strict=True):
            n = 0 if ok else n + 1
            if not ok:
                wait = min(LONGEST, 2.0 ** min(n, 64))
                out.append((key[0], ident, wait, round((1 + JITTER) * wait, 6), max(wait, after)))
        self.failures.update((n,))
        if self.forget:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(batch["t_"].iloc[-1] // 1000) + self.forget * 1000)
        yield pd.DataFrame(out, columns=["key_", "id_", "backoff_s", "most_s", "wait_s"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.failures.clear()
        return iter(())


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    rows = stream.withColumn("ts_", F.col(ts).cast("timestamp")).withWatermark("ts_", late)
    return rows.withColumn("t_", F.unix_micros("ts_"))


def admitted(stream: DataFrame, by: str, ts: str, tie: str, limit: int, seconds: int, late: str = "1 day") -> DataFrame:
    """(by, tie, admitted) of a stream of requests; null keys are a client."""
    key, name = stream.schema[by].dataType.simpleString(), stream.schema[tie].dataType.simpleString()
    rows = _timed(stream, ts, late).select(F.col(by).alias("key_"), F.col(tie).alias("tie_"), "t_", "ts_")
    found = rows.groupBy("key_").transformWithStateInPandas(Admission(limit, seconds), f"key_ {key}, tie_ {name}, admitted boolean", "Append", "EventTime")
    return found.select(F.col("key_").alias(by), F.col("tie_").alias(tie), "admitted")


def cached(stream: DataFrame, by: str, ts: str, ident: str, get: str, value: str, seconds: int, late: str = "1 day") -> DataFrame:
    """(ident, cached): of a stream of sets and gets (rows where ``get`` is true), each get with what the cache holds as text."""
    name = stream.schema[ident].dataType.simpleString()
    rows = _timed(stream, ts, late).select(F.col(by).alias("key_"), "t_", F.col(ident).alias("id_"), F.col(value).cast("string").alias("v_"), F.col(get).alias("get_"), "ts_")
    found = rows.groupBy("key_").transformWithStateInPandas(Cache(seconds), f"id_ {name}, cached string", "Append", "EventTime")
    return found.select(F.col("id_").alias(ident), "cached")


def backoff(stream: DataFrame, by: str, ts: str, ident: str, ok: str, after: str, forget: int = 0, late: str = "1 day") -> DataFrame:
    """(by, ident, backoff_s, most_s, wait_s) of each failure in a stream of answers; ``after`` are seconds as text, or not."""
    key, name = stream.schema[by].dataType.simpleString(), stream.schema[ident].dataType.simpleString()
    asked = F.coalesce(F.col(after).try_cast("double"), F.lit(0.0)).alias("after_")
    rows = _timed(stream, ts, late).select(F.col(by).alias("key_"), F.col(ident).alias("id_"), F.col(ok).alias("ok_"), asked, "t_", "ts_")
    found = rows.groupBy("key_").transformWithStateInPandas(Backoff(forget), f"key_ {key}, id_ {name}, backoff_s double, most_s double, wait_s double", "Append", "EventTime")
    return found.select(F.col("key_").alias(by), F.col("id_").alias(ident), "backoff_s", "most_s", "wait_s")


@contextmanager
def rocks(spark: SparkSession):
    """Streams that start here keep their state in RocksDB, which these processors need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def arrivals(rows: DataFrame, ts: str, triggers: int = 3) -> DataFrame:
    """A table as a stream that brings its rows in that many triggers, by time."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "arrivals")
    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = rows.agg(F.min(moment), F.max(moment)).first()
    step = max(1, ((high or 0) - (low or 0)) // triggers + 1)
    for i in range(triggers):
        some = F.least(F.floor((moment - F.lit(low or 0)) / step), F.lit(triggers - 1)) == i
        rows.where(some if i else some | moment.isNull()).coalesce(1 if triggers > 8 else 8).write.mode("append").parquet(f"{path}/n={i:04d}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).option("basePath", path).parquet(f"{path}/n=*")


def kept(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """What a stateful stream gives until its input is used up, as a table; a folder keeps table and state for the next run."""
    spark = stream.sparkSession
    base = folder or scratch(spark, name)
    with rocks(spark):
        stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
