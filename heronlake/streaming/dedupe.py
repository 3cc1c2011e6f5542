"""Dedupe over streams with a bounded read for each trigger.

What was seen is a stored table in partitions by the first digits of the hash, with a Bloom filter of a fixed size for each.
A trigger reads the filters of its own prefixes. Only the hashes that a filter doesn't rule out are looked up, in the
partitions of their prefixes; where none is, no part of the history is read. The new hashes, the filters and a row that
says the trigger is done are one change of the store, so a trigger that runs again after a failure adds nothing twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.sources.scratch import stored
from heronlake.sources.store import Layout, Store

#: Bits of a prefix's filter, and how many of them a hash sets; with a tenth as many hashes, one in a hundred others passes.
BITS, PROBES = 1 << 18, 7
#: Files that a prefix has before they are written together.
FILES = 16

TABLES = {
    "hashes": Layout("prefix string, content_hash string", ("content_hash",), ("prefix",), (), 1),
    "filters": Layout("prefix string, bits binary, n bigint", ("prefix",), (), (), 4),
    "triggers": Layout("number bigint, came bigint, looked_up bigint, new bigint, read_bytes bigint", ("number",), (), (), 1),
}


def places(hashes: list[str]) -> np.ndarray:
    """The bits of each hash, from its own last 32 digits: two numbers of 64 bits, combined."""
    tail = np.array([[int(h[-32:-16], 16), int(h[-16:], 16)] for h in hashes], np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        return (tail[:, :1] + np.arange(PROBES, dtype=np.uint64) * (tail[:, 1:] | np.uint64(1))) % np.uint64(BITS)


def _meet(key: tuple, came: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """The hashes of a prefix, each with whether its filter has it, and the filter with all of them."""
    bits = np.unpackbits(np.frombuffer(old["bits"][0], np.uint8)) if len(old) else np.zeros(BITS, np.uint8)
    at = places(came["content_hash"].tolist()).astype(np.int64)
    maybe = bits[at].all(1)
    bits[at.ravel()] = 1
    n = int(old["n"][0]) if len(old) else 0
    rows = {"prefix": key[0], "content_hash": came["content_hash"], "maybe": maybe, "bits": None, "n": None}
    whole = {"prefix": key[0], "content_hash": None, "maybe": None, "bits": [np.packbits(bits).tobytes()], "n": n + int((~maybe).sum())}
    return pd.concat([pd.DataFrame(rows).astype(object), pd.DataFrame(whole).astype(object)], ignore_index=True)


class Seen:
    """The hashes that came, below a path. Prefixes have ``digits`` hexadecimal digits: choose them for partitions that a
    trigger can read."""

    def __init__(self, spark: SparkSession, path: str, digits: int = 2) -> None:
        self.store, self.digits = Store(spark, path, TABLES), digits

    def hashes(self) -> DataFrame:
        return self.store.read("hashes").select("content_hash")

    def triggers(self) -> DataFrame:
        """What each trigger brought, looked up, added and read of the history."""
        return self.store.read("triggers")

    def add(self, batch: DataFrame, number: int) -> None:
        """A trigger's hashes (hexadecimal, of 32 digits or more; null ones are left out)."""
        snap = self.store.snapshot()
        if snap.read("triggers", {"number": number}).count():
            return
        came = batch.where(F.col("content_hash").isNotNull()).select("content_hash").distinct()
        came = stored(came.withColumn("prefix", F.substring("content_hash", 1, self.digits)), "came")
        filters = snap.read("filters", keys=came.select("prefix").distinct())
        met = came.groupBy("prefix").cogroup(filters.groupBy("prefix")).applyInPandas(_meet, "prefix string, content_hash string, maybe boolean, bits binary, n bigint")
        met = stored(met, "met")
        rows = met.where("content_hash IS NOT NULL")
        asked = rows.where("maybe").select("prefix", "content_hash")
        opened = snap.pruned("hashes", keys=asked.select("prefix").distinct()).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
        known = snap.read("hashes", keys=asked)
        new = rows.select("prefix", "content_hash").join(known.select("content_hash"), "content_hash", "left_anti").select("prefix", "content_hash")
        new = stored(new, "new")
        counts = rows.agg(F.count(F.lit(1)).alias("came"), F.count_if("maybe").alias("looked")).first()
        told = [(number, counts.came, counts.looked, new.count(), opened)]
        with self.store.change() as c:
            c.append("hashes", new)
            c.upsert("filters", met.where("content_hash IS NULL").select("prefix", "bits", "n"))
            c.append("triggers", self.store.spark.createDataFrame(told, TABLES["triggers"].columns))
            c.compact("hashes", FILES)

