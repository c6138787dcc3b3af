"""Maintenance of the index from snapshots: classify, upsert, sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BYTES = 32 * 1024
STICKY = ("acoustid", "mb_recording_id", "mb_release_id", "apple_id")


def changes(disk: DataFrame, index: DataFrame, full: bool = False) -> DataFrame:
    """(path, change): 'added', 'updated', 'unchanged', 'corrupt' or 'missing' of `disk` (path, size_bytes, mtime) against `index` (with sha256, status)."""
    d = disk.select("path", F.col("size_bytes").alias("d_size"), F.col("mtime").alias("d_mtime"))
    j = d.join(index.select("path", "size_bytes", "mtime", "sha256", "status"), "path", "full_outer")
    same = (F.col("size_bytes") == F.col("d_size")) & (F.abs(F.col("mtime") - F.col("d_mtime")) < 1) & F.col("sha256").isNotNull() & F.lit(not full)
    what = F.when(F.col("d_size").isNull(), F.when(F.col("status") == "active", "missing")).when(same, "unchanged").when(F.col("d_size") < MIN_BYTES, "corrupt").when(F.col("size_bytes").isNull(), "added").otherwise("updated")
    return j.select("path", what.alias("change")).where("change is not null")


def missing(disk: DataFrame, index: DataFrame, finished: bool) -> DataFrame:
    """(path) of active index entries that a scan has not seen; none after a scan that was stopped, as it says nothing of what it did not reach."""
    gone = changes(disk, index).where("change = 'missing'").select("path")
    return gone if finished else gone.limit(0)


def sticky(new: Column, old: Column) -> Column:
    """The new value unless blank, else the old one."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def upsert(index: DataFrame, scanned: DataFrame, key: str = "path", keep: tuple[str, ...] = STICKY) -> DataFrame:
    """`index` with the rows of `scanned` (same columns) put in by key; `keep` columns survive a blank scan."""
    cols = [c for c in index.columns if c != key]
    j = index.select(key, F.struct(*cols).alias("o")).join(scanned.select(key, F.struct(*cols).alias("n")), key, "full_outer")
    return j.select(key, *[(sticky(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in cols])


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key by the order of `by`, as one aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r")).select(*keys, "r.*")
