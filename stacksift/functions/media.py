"""Scores of a file's format, sound, tags and place, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Preference of formats (fixed values); 0.40 for any other.
FORMAT_RANK = {"flac": 1.00, "alac": 0.97, "wavpack": 0.94, "ape": 0.92, "pcm_s24le": 0.90, "pcm_s16le": 0.86, "wav": 0.86, "aiff": 0.84, "dsd": 0.95, "opus": 0.62, "aac": 0.58, "mp3": 0.52, "vorbis": 0.50, "wmav2": 0.30, "wmapro": 0.34}
#: Weights of the eight criteria (fixed values).
WEIGHTS = {"format": 0.30, "bitrate": 0.22, "resolution": 0.12, "tags": 0.16, "artwork": 0.08, "lyrics": 0.04, "duration": 0.05, "path": 0.03}
#: Worth of each tag field in completeness (fixed values).
COMPLETENESS = {"title": 0.20, "artist": 0.18, "album": 0.15, "albumartist": 0.10, "year": 0.10, "track_no": 0.09, "genre": 0.06, "disc_no": 0.04, "isrc": 0.04, "mb_recording_id": 0.04}
#: Signs of a throw-away copy in a path, and in a file name (fixed values).
BAD_PATH = ("new folder", "copy", "duplicate", "dup", "temp", "tmp", "downloads", "download", "recycle", "@eadir", "unsorted", "incoming", "torrent")
BAD_NAME = ("(1)", "(2)", "(3)", " - copy", "_copy", "copy of", "duplicate")
#: Codecs that are out of date, and those that lose nothing (fixed values).
LEGACY_CODECS = ("wmav1", "wmav2", "wmapro", "ra_144", "ra_288", "adpcm_ms", "amr_nb")
LOSSLESS_CODECS = ("flac", "alac", "wav", "pcm_s16le", "pcm_s24le", "aiff", "ape", "wavpack", "dsd")
NUMERIC = {"year", "track_no", "disc_no"}


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def is_blank(c: str) -> Column:
    """Null, '' and 0 are the three spellings of nothing."""
    return F.col(c).isNull() | (F.col(c) == (0 if c in NUMERIC else ""))


def completeness() -> Column:
    return F.round(F.least(F.lit(1.0), total([F.when(is_blank(c), 0.0).otherwise(w) for c, w in COMPLETENESS.items()])), 4)


def quality() -> Column:
    """0.55 format, 0.15 sample rate, 0.10 bit depth, 0.20 tags."""
    fmt = F.when(F.col("lossless"), 1.0).otherwise(F.least(F.coalesce("bitrate", F.lit(0)) / 320000, F.lit(1.0)))
    rate = F.least(F.coalesce(F.nullif("sample_rate", F.lit(0)), F.lit(44100)) / 96000, F.lit(1.0))
    depth = F.least(F.coalesce(F.nullif("bit_depth", F.lit(0)), F.lit(16)) / 24, F.lit(1.0))
    return F.round(0.55 * fmt + 0.15 * rate + 0.10 * depth + 0.20 * F.coalesce("tag_completeness", F.lit(0.0)), 4)


def steps(value: Column, bounds: list[tuple[float, float]], below: float) -> Column:
    """The value of the first bound reached, highest first."""
    out = F.when(value >= bounds[0][0], bounds[0][1])
    for b, v in bounds[1:]:
        out = out.when(value >= b, v)
    return out.otherwise(below)


def format_score(prefer_lossless: bool = True) -> Column:
    codec = F.lower(F.coalesce("codec", F.lit("")))
    base = reduce(lambda x, kv: x.when(codec == kv[0], kv[1]), FORMAT_RANK.items(), F).otherwise(0.40)
    return base if prefer_lossless else F.when(F.col("lossless"), F.least(base, F.lit(0.70))).otherwise(base)


def resolution_score() -> Column:
    rate = steps(F.coalesce("sample_rate", F.lit(0)), [(176400, 1.0), (88200, 0.9), (44100, 0.75), (32000, 0.45), (1, 0.2)], 0.0)
    depth = F.coalesce(F.nullif("bit_depth", F.lit(0)), F.lit(16))
    return F.round(0.6 * rate + 0.4 * F.when(depth == 8, 0.2).when(depth.isin(24, 32), 1.0).otherwise(0.7), 4)


def tags_score() -> Column:
    return F.round(F.when(F.coalesce("mb_recording_id", F.lit("")) != "", F.least(F.lit(1.0), F.col("tag_completeness") + 0.08)).otherwise(F.col("tag_completeness")), 4)


def artwork_score() -> Column:
    return F.when(F.col("has_artwork"), steps(F.coalesce("artwork_px", F.lit(0)), [(1400, 1.0), (1000, 0.9), (600, 0.75), (300, 0.5)], 0.35)).otherwise(0.0)


def lyrics_score() -> Column:
    return F.when(F.col("has_synced_lyrics"), 1.0).when(F.col("has_lyrics"), 0.6).otherwise(0.0)


def file_name(path: str = "path") -> Column:
    return F.substring_index(path, "/", -1)


def path_score() -> Column:
    low, name = F.lower("path"), F.lower(file_name())
    bad = total([F.when(F.contains(low, F.lit(t)), 0.25).otherwise(0.0) for t in BAD_PATH]) + total([F.when(F.contains(name, F.lit(t)), 0.30).otherwise(0.0) for t in BAD_NAME])
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - bad - F.when(F.size(F.split("path", "/")) > 9, 0.10).otherwise(0.0))), 4)


def suggestion() -> Column:
    """A better format for a file, or null: old codecs, and lossless files above 2.8 Mbit/s."""
    return (
        F.when(F.lower(F.coalesce("codec", F.lit(""))).isin(*LEGACY_CODECS), F.when(F.coalesce("bitrate", F.lit(0)) > 320000, "flac").otherwise("aac_256"))
        .when(F.col("lossless") & (F.col("duration") > 0) & (F.try_divide(F.col("size_bytes") * 8, F.col("duration")) > 2800000), "flac_16_44")
    )


#: White space of all kinds, for both engines' patterns.
SPACES = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def unsafe_replaced(text: Column, longest: int = 120) -> Column:
    """A path component without characters some file systems refuse, reserved names marked, cut at `longest`; '' becomes Unknown."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_"), rf"^[{SPACES}]+|[{SPACES}]+$", "")
    out = F.regexp_replace(out, r"[ .]+$", "")
    out = F.regexp_replace(out, r"^((?i)con|prn|aux|nul|com[1-9]|lpt[1-9])$", "_$1")
    # replacements rather than conditions: a condition would repeat the whole expression in each branch
    out = F.regexp_replace(out, rf"^([\s\S]{{0,{longest - 1}}}[^ ._-])[ ._-]*(?<=^[\s\S]{{{longest}}})[\s\S]+$", "$1")
    return F.regexp_replace(F.substring(out, 1, longest), "^$", "Unknown")
