"""Keyed writes as rewrites: the last write of a key wins, deletes are anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: one aggregation, whose state is one row a key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade(old: DataFrame, new: DataFrame, chunks: DataFrame, fresh: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks after an upsert: a document that is written again loses its old chunks first."""
    return upsert(old, new, [key]), delete(chunks, new, [key]).unionByName(fresh)


def uuid5(name, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"):
    """The UUID of a name, by SHA-1, in a namespace (that of domain names)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
