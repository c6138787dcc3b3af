"""What could be cleaned up: empty folders, left-over files, orphan sidecars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders of caches, marks of unfinished files, files that belong to audio, and audio itself (fixed values).
CACHE_DIRS = ("@eaDir", "#recycle", "@tmp", "#snapshot")
TEMP_MARKS = (".part-", ".tmp", ".partial")
SIDECARS = (".lrc", ".cue", ".log", ".m3u", ".m3u8")
AUDIO = (".mp3", ".flac", ".wav", ".aac", ".m4a", ".m4b", ".alac", ".ogg", ".oga", ".opus", ".wma", ".aiff", ".aif", ".ape", ".wv", ".dsf")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def below(path: Column, folders: tuple[str, ...]) -> Column:
    """Whether a path is one of the folders or lies below one."""
    hits = [(path == f.rstrip("/")) | path.startswith(f.rstrip("/") + "/") for f in folders]
    return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)


def in_cache(path: Column) -> Column:
    """Whether a path is, or lies in, a folder that the storage makes for itself."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in CACHE_DIRS]))


def empty_folders(folders: DataFrame, files: DataFrame, root: str = "", caches: bool = False, off_limits: tuple[str, ...] = ()) -> DataFrame:
    """`folders` (path) with no file of `files` (path) anywhere below; one anti-join, no bottom-up loop.

    Any file keeps its folders, an orphan sidecar too. Files in cache folders keep theirs unless caches are
    cleaned as well (`caches`); cache folders themselves, `root`, and `off_limits` folders and all below
    them are never reported. Null paths are left out; empty tables give what is left of `folders`.
    """
    kept = files.where("path is not null")
    held = (kept.where(~in_cache(F.col("path"))) if caches else kept).select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    asked = folders.select("path").where(~F.col("path").isin(root, root.rstrip("/")) & ~in_cache(F.col("path")) & ~below(F.col("path"), off_limits)).distinct()
    return asked.join(held, "path", "left_anti")


def file_category() -> Column:
    """'temp', 'cache', 'sidecar' or null of a file path; audio is never in any."""
    path, s = F.col("path"), suffix(F.col("path"))
    any_of = lambda marks: F.coalesce(*[F.when(F.contains(F.lower(path), F.lit(m)), True) for m in marks], F.lit(False))
    return F.when(s.isin(*AUDIO) & ~any_of(TEMP_MARKS), None).when(any_of(TEMP_MARKS), "temp").when(F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in CACHE_DIRS])), "cache").when(s.isin(*SIDECARS), "sidecar")
