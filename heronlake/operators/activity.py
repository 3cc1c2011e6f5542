"""Sessions, logs, metrics and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds of request durations in seconds.
BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


def last_turns(turns: DataFrame, n: int = 8) -> DataFrame:
    """The last n turns of each session, oldest first."""
    order = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def memory(turns: DataFrame, n: int = 8) -> DataFrame:
    """(conv_id, memory): the last turns as lines; n bounds each group."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return last_turns(turns, n).groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("memory"))


def histogram(rows: DataFrame, by: str, value: str, bounds: tuple = BUCKETS) -> DataFrame:
    """Cumulative counts below each bound, and count and sum, in one pass."""
    counts = [F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return rows.groupBy(by).agg(*counts, F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))


def load(rows: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """Requests of the same client in the last ``seconds``, this one included."""
    w = W.partitionBy(by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("load", F.count(F.lit(1)).over(w))


def admitted(rows: DataFrame, by: str, ts: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """Admission with a sliding window in which rejected requests don't count.

    The decision on a request depends on those before it, so a client's requests are folded in order; a stream of sorted
    batches keeps only the window of one client in memory, whatever the client's share of the rows.
    """
    kind = rows.schema[by].dataType.simpleString()
    tie_kind = rows.schema[tie].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, held = None, []
        for b in batches:
            out = []
            for c, t in zip(b[by], b["_t"], strict=True):
                if c != client:
                    client, held = c, []
                held = [x for x in held if x > t - seconds * 1_000_000]
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(t)
            yield pd.DataFrame({by: b[by], tie: b[tie], "admitted": out})

    timed = rows.select(by, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    return timed.repartition(by).sortWithinPartitions(by, "_t", tie).mapInPandas(fold, f"`{by}` {kind}, `{tie}` {tie_kind}, admitted boolean")


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def valid_at(entries: DataFrame, asked: DataFrame, key: str, at: str, value: str, seconds: int) -> DataFrame:
    """``asked`` with the value that was last set for its key, unless it is older than ``seconds``: a cache with expiry.

    Both sides go through one window by key, so a get meets only the set before it; at the same moment a set comes first.
    """
    sets = entries.select(key, F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("_set"), *(F.lit(None).cast(f.dataType).alias(f"_{f.name}") for f in asked.schema if f.name not in (key, at)))
    gets = asked.select(key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(sets.schema["_set"].dataType).alias("_set"), *(F.col(f.name).alias(f"_{f.name}") for f in asked.schema if f.name not in (key, at)))
    w = W.partitionBy(key).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = sets.unionByName(gets).withColumn("_last", F.last("_set", ignorenulls=True).over(w)).where("_kind = 1")
    fresh = F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("_last.at").cast("timestamp")) <= seconds * 1_000_000
    return both.select(key, F.col("_at").alias(at), *(F.col(f"_{f.name}").alias(f.name) for f in asked.schema if f.name not in (key, at)), F.when(fresh, F.col("_last.v")).alias("cached"))


#: The steps of a job.
STEPS = {"pending": ("running", "failed"), "running": ("completed", "failed")}


def transitions(log: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """The rows of a job log with the state before and whether the step from it is allowed; a job begins as pending."""
    before = F.lag(state).over(W.partitionBy(key).orderBy(order))
    rows = log.withColumn("before", before)
    allowed = F.when(F.col("before").isNull(), F.col(state) == "pending").otherwise(F.lit(False))
    for a, b in STEPS.items():
        allowed = F.when(F.col("before") == a, F.col(state).isin(*b)).otherwise(allowed)
    return rows.withColumn("allowed", allowed)


def prometheus(name: str, kind: str, rows: DataFrame, labels: list[str], value: str) -> DataFrame:
    """(line): a metric's type and its samples as text lines."""
    shown = F.array_join(F.array(*(F.format_string(f'{c}="%s"', F.col(c).cast("string")) for c in labels)), ",")
    lines = rows.select(F.concat(F.lit(f"{name}{{"), shown, F.lit("} "), F.col(value).cast("string")).alias("line"))
    return rows.sparkSession.createDataFrame([(f"# TYPE {name} {kind}",)], "line string").unionByName(lines)
