"""Sources: library tables, probe and provider JSON, logs, file listings, read-through cache."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..core.session import checkpoint_dir, table
from ..functions.media import LOSSLESS_CODECS

#: Sample formats and their bit depth (fixed values).
DEPTHS = {"s16": 16, "s16p": 16, "s32": 32, "s32p": 32, "u8": 8, "u8p": 8, "flt": 32, "fltp": 32, "dbl": 64, "dblp": 64}
PROBE = "streams array<struct<codec_name: string, profile: string, bit_rate: string, duration: string, sample_rate: string, channels: string, bits_per_raw_sample: string, sample_fmt: string>>, format struct<bit_rate: string, duration: string, format_name: string>"
SKIPPED = ("@eaDir", "#recycle", ".DS_Store", "@tmp", "#snapshot")


_ingested: dict[tuple[str, str, str], str] = {}


def ingested(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table without its repeated rows, taken in once a session: scans of it need no exchange.

    Rows alike in all columns count once (maps, which can't be compared, are taken from any of them). What
    is taken in lies in the shared checkpoint folder, so every later query prunes columns and pushes filters
    into its Parquet files; changes of the source are seen by the next session.
    """
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _ingested:
        t = table(spark, d, name)
        maps = [f.name for f in t.schema if isinstance(f.dataType, MapType)]
        plain = [c for c in t.columns if c not in maps]
        once = t.groupBy(*plain).agg(*[F.first(m).alias(m) for m in maps]) if maps else t.distinct()
        at = f"{checkpoint_dir(spark)}/ingested/{hashlib.md5(d.encode()).hexdigest()}/{name}"
        once.select(*t.columns).write.mode("overwrite").parquet(at)
        _ingested[key] = at
    return spark.read.parquet(_ingested[key])


def library(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Tracks (id and the columns): repeated rows count once, other columns are never read."""
    return ingested(spark, d, "tracks").select("id", *columns)


def scan(tracks: DataFrame, status: str = "active", prefix: str | None = None) -> DataFrame:
    """Tracks of a status below a folder; both filters reach the Parquet scan."""
    t = tracks.where(F.col("status") == status)
    return t.where(F.col("path").startswith(prefix.rstrip("/") + "/")) if prefix else t


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, mtime) of the files below a folder, without reading them; cache folders and hidden names left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    p = F.regexp_replace("path", "^file:/*", "/")
    return f.select(p.alias("path"), F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").alias("mtime")).where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in SKIPPED])) & ~F.col("path").rlike(r"/\.[^/]"))


def probed(json: Column, size_bytes: Column) -> Column:
    """Struct of codec, duration, bitrate, sample_rate, bit_depth, channels, lossless, corrupt from a probe's JSON; bad JSON is corrupt."""
    j = F.from_json(json, PROBE)
    st, fm = F.get(j["streams"], 0), j["format"]
    num = lambda c: F.nullif(c.try_cast("bigint"), F.lit(0))
    sec = F.coalesce(F.nullif(st["duration"].try_cast("double"), F.lit(0.0)), F.nullif(fm["duration"].try_cast("double"), F.lit(0.0)))
    codec = F.nullif(F.lower(st["codec_name"]), F.lit(""))
    fmt = F.lower(st["sample_fmt"])
    depth = F.coalesce(num(st["bits_per_raw_sample"]), *[F.when(fmt == k, F.lit(v).cast("bigint")) for k, v in DEPTHS.items()])
    rate = F.coalesce(num(st["bit_rate"]), num(fm["bit_rate"]), F.when(sec > 0, F.try_divide(size_bytes * 8, sec).cast("bigint")))
    return F.struct(
        codec.alias("codec"), sec.alias("duration"), rate.alias("bitrate"), num(st["sample_rate"]).alias("sample_rate"), depth.alias("bit_depth"), num(st["channels"]).alias("channels"),
        (F.coalesce(codec.isin(*LOSSLESS_CODECS), F.lit(False)) | (F.lower(F.coalesce(st["profile"], F.lit(""))) == "alac")).alias("lossless"), (F.coalesce(sec, F.lit(0.0)) <= 0).alias("corrupt"),
    )


def log_tail(lines: DataFrame, n: int, level: str | None = None, contains: str | None = None) -> DataFrame:
    """The last n lines of `lines` (line_no, level, text): the last 4n are read, then filtered, then the last n kept."""
    last = lines.orderBy(F.desc("line_no")).limit(n * 4)
    if level:
        last = last.where(F.col("level") == level)
    if contains:
        last = last.where(F.contains(F.lower("text"), F.lit(contains.lower())))
    return last.orderBy(F.desc("line_no")).limit(n)


def cached(requests: DataFrame, cache: DataFrame, now: str) -> DataFrame:
    """Requests (cache_key) with their payload from `cache` (cache_key, payload, expires_at); expired entries don't count."""
    fresh = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp_ntz"))).select("cache_key", "payload")
    return requests.join(fresh, "cache_key", "left")
