"""Incremental indexing: what is pending or uncached, keyed upserts, replacement, cascades and dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def pending(current: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows of current (key, file_hash) that are not embedded with the same hash."""
    done = state.where("status = 'embedded'").select(key, "file_hash")
    return current.join(done, [key, "file_hash"], "left_anti")


def reindexable(current: DataFrame, meta: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Pending rows of current whose file has been parsed as it is now: those that a new index job takes without parsing."""
    return pending(current, state, key).join(meta.select(key, "file_hash"), [key, "file_hash"], "left_semi")


def misses(candidates: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(cache, keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and those of old whose keys it lacks."""
    return old.join(new.select(keys), keys, "left_anti").unionByName(new)


def replace_group(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """old with all rows of the groups in new replaced by new's."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def cascade_delete(gone: DataFrame, key: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    return tuple(x.join(gone.select(key), key, "left_anti") for x in tables)


def dense_ids(rows: DataFrame, group: str, position: str, name: str) -> DataFrame:
    """Ids from 1 on in the order of group and position: row numbers inside groups on top of running totals of the group sizes.

    Groups are dealt into ranges, whose totals are few; so no task sees all rows, and only one sees the ranges.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    least, most = sizes.agg(F.min(group), F.max(group)).first() or (0, 0)
    width = max(1, ((most or 0) - (least or 0)) // 1024 + 1)
    ranged = sizes.withColumn("_range", F.floor((F.col(group) - F.lit(least or 0)) / width))
    totals = ranged.groupBy("_range").agg(F.sum("_n").alias("_t"))
    before = lambda w: w.rowsBetween(W.Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_t").over(before(W.Window.orderBy("_range"))), F.lit(0)).alias("_start"))  # 1025 rows at most
    inside = F.coalesce(F.sum("_n").over(before(W.Window.partitionBy("_range").orderBy(group))), F.lit(0))
    bases = ranged.withColumn("_in", inside).join(F.broadcast(starts), "_range").select(group, (F.col("_start") + F.col("_in")).alias("_base"))
    numbered = rows.withColumn("_k", F.row_number().over(W.Window.partitionBy(group).orderBy(position)))
    return numbered.join(bases, group).withColumn(name, (F.col("_base") + F.col("_k")).cast("long")).drop("_k", "_base")
