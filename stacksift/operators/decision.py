"""Scoring, ranking and verdict on the copies of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import media

AMBIGUITY_MARGIN = 0.03
AUTO_CONFIDENCE = 0.90
#: What a loser lacks, by criterion (fixed values).
LACKS = {"format": "lower-ranked format", "bitrate": "lower bitrate", "resolution": "lower resolution", "tags": "incomplete tags", "artwork": "missing or small artwork", "lyrics": "no lyrics", "duration": "shorter (possibly truncated)", "path": "messy location"}
CRITERIA = tuple(media.WEIGHTS)
COLUMNS = ("path", "size_bytes", "codec", "lossless", "bitrate", "sample_rate", "bit_depth", "duration", "tag_completeness", "mb_recording_id", "has_artwork", "artwork_px", "has_lyrics", "has_synced_lyrics", "first_seen")


def scored(members: DataFrame, weights: dict[str, float] | None = None, prefer_lossless: bool = True) -> DataFrame:
    """`members` (group_id, track_id, COLUMNS) with s_<criterion> and their weighted `score`.

    Bitrate is judged against the best lossy peer, duration against the longest. The peers' bests are
    aggregated map-side and joined back, so a large group is never sorted or held by one task.
    """
    w = media.WEIGHTS | (weights or {})
    peers = members.groupBy("group_id").agg(F.max(F.when(~F.col("lossless"), F.coalesce("bitrate", F.lit(0)))).alias("_best"), F.max("duration").alias("_longest"))
    m = members.join(peers, "group_id")
    br = F.coalesce("bitrate", F.lit(0))
    bitrate = F.when(F.col("lossless"), 1.0).when(br <= 0, 0.0).otherwise(F.round(0.6 * F.least(br / 320000, F.lit(1.0)) + 0.4 * F.when(F.col("_best") > 0, br / F.col("_best")).otherwise(1.0), 4))
    share = F.try_divide("duration", "_longest")
    duration = F.when((F.coalesce("_longest", F.lit(0.0)) <= 0) | (F.coalesce("duration", F.lit(0.0)) == 0), 0.5).when(share >= 0.98, 1.0).when(share >= 0.95, 0.8).otherwise(F.round(F.greatest(F.lit(0.0), share * 0.7), 4))
    parts: dict[str, Column] = {"format": media.format_score(prefer_lossless), "bitrate": bitrate, "resolution": media.resolution_score(), "tags": media.tags_score(), "artwork": media.artwork_score(), "lyrics": media.lyrics_score(), "duration": duration, "path": media.path_score()}
    m = m.withColumns({"s_" + k: v for k, v in parts.items()})
    return m.withColumn("score", F.round(media.total([F.col("s_" + k) * w[k] for k in parts]) / (sum(w[k] for k in parts) or 1.0), 5)).drop("_best", "_longest")


def ranked(s: DataFrame, steps: int = 200) -> DataFrame:
    """`s` (group_id, track_id, score, size_bytes, first_seen) with `rank`, 1 for the best of a group: by score, size, earlier discovery, smaller id.

    A group is cut into steps of score that are ranked by themselves; how many members the steps above hold
    is a window over `steps` rows at most, so no task ever sorts a whole group. A null score ranks last.
    """
    s = s.withColumn("_step", F.coalesce(F.floor((1 - F.col("score")) * steps), F.lit(1 << 40)))
    held = s.groupBy("group_id", "_step").agg(F.count("*").alias("_n"))
    above = held.select("group_id", "_step", F.coalesce(F.sum("_n").over(W.partitionBy("group_id").orderBy("_step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    own = F.row_number().over(W.partitionBy("group_id", "_step").orderBy(F.desc("score"), F.desc("size_bytes"), F.asc("first_seen"), F.asc("track_id")))
    return s.withColumn("_own", own).join(above, ["group_id", "_step"]).withColumn("rank", (F.col("_own") + F.col("_above")).cast("int")).drop("_step", "_own", "_above")


#: The note on a verdict changed by hand, as on all texts of reasons here (fixed values).
OVERRIDDEN = "(manually overridden)"


def overridden(members: DataFrame, overrides: DataFrame) -> DataFrame:
    """`members` (group_id, track_id, action, reason) after `overrides` (group_id, track_id, action); of several for a member the least action counts.

    Only a changed action is noted in the reason, once. Overrides that would leave a group without a keeper
    are refused as a whole: `refused` is true on such a group's members and they stay as they were.
    """
    o = overrides.where("group_id is not null and track_id is not null and action is not null").groupBy("group_id", "track_id").agg(F.min("action").alias("_wanted"))
    m = members.select("group_id", "track_id", "action", "reason").join(o, ["group_id", "track_id"], "left").withColumn("_to", F.coalesce("_wanted", "action"))
    keepers = m.groupBy("group_id").agg(F.count_if(F.col("_to") == "keep").alias("_keepers"), F.count_if(~F.col("_to").eqNullSafe(F.col("action"))).alias("_changes"))
    m = m.join(keepers, "group_id", "left").withColumn("refused", F.coalesce((F.col("_keepers") == 0) & (F.col("_changes") > 0), F.lit(False)))
    new = ~F.col("_to").eqNullSafe(F.col("action")) & ~F.col("refused")
    base = F.trim(F.replace(F.coalesce("reason", F.lit("")), F.lit(OVERRIDDEN), F.lit("")))
    return m.select("group_id", "track_id", F.when(new, F.col("_to")).otherwise(F.col("action")).alias("action"), F.when(new, F.trim(F.concat(base, F.lit(" " + OVERRIDDEN)))).otherwise(F.col("reason")).alias("reason"), "refused")


def member_sets(members: DataFrame) -> DataFrame:
    """(group_id, n, h1, h2): what tells a group's set of distinct tracks, of any size, as aggregates: its number and two sums of hashes."""
    d = members.where("group_id is not null and track_id is not null").select("group_id", "track_id").distinct()
    return d.groupBy("group_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("track_id").cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(1), "track_id").cast("decimal(38,0)")).alias("h2"))


def not_settled(members: DataFrame, settled: DataFrame) -> DataFrame:
    """(group_id) of groups of `members` whose very tracks are not those of a group of `settled` (both group_id, track_id) with another id."""
    a, b = member_sets(members), member_sets(settled).withColumnRenamed("group_id", "other")
    hit = a.join(b, ["n", "h1", "h2"]).where("group_id <> other").select("group_id").distinct()
    return a.select("group_id").join(hit, "group_id", "left_anti")


def kept_reason() -> Column:
    bits = F.concat_ws(
        ", ",
        F.when(F.col("lossless"), F.concat(F.lit("lossless ("), F.coalesce("codec", F.lit("None")), F.lit(")"))).when(F.col("bitrate") > 0, F.concat(F.floor(F.col("bitrate") / 1000).cast("string"), F.lit(" kbps"))),
        F.when(F.col("s_tags") >= 0.8, "near-complete tags"),
        F.when(F.col("has_artwork") & (F.col("artwork_px") >= 600), F.concat(F.col("artwork_px").cast("string"), F.lit("px artwork"))),
        F.when(F.col("has_synced_lyrics"), "synced lyrics"),
    )
    return F.when(bits != "", F.concat(F.lit("Best copy: "), bits)).otherwise("Highest score in cluster")


def verdicts(members: DataFrame, confidence: DataFrame) -> DataFrame:
    """A row for each member of groups of two or more: rank, action and reason.

    `confidence` has (group_id, confidence). The winner is kept; losers go to quarantine if the margin is
    not ambiguous and the confidence suffices, else they are skipped. Winner and runner-up come from an
    aggregate of the two best (max over an ordered struct), not from sorting whole groups.
    """
    s = scored(members)
    order = F.struct(F.col("score"), F.col("size_bytes"), -F.unix_micros(F.col("first_seen").cast("timestamp")), -F.col("track_id"))
    top = s.groupBy("group_id").agg(F.count("*").alias("members"), F.max_by(F.struct("track_id", "score", *["s_" + k for k in CRITERIA]), order).alias("win"), F.sum("size_bytes").alias("bytes"), F.max_by("size_bytes", order).alias("win_bytes"))
    second = s.join(top.select("group_id", F.col("win.track_id").alias("_w")), "group_id").where("track_id <> _w").groupBy("group_id").agg(F.max("score").alias("second"))
    m = s.join(top.where("members > 1").join(second, "group_id"), "group_id").join(confidence, "group_id", "left")
    keep = F.col("track_id") == F.col("win.track_id")
    margin = F.round(F.col("win.score") - F.col("second"), 5)
    gaps = F.array_compact(F.array(*[F.when(F.round(F.col("win.s_" + k) - F.col("s_" + k), 6) > 0.05, F.struct(-F.round(F.col("win.s_" + k) - F.col("s_" + k), 6), F.lit(i).alias("i"), F.lit(LACKS[k]).alias("text"))) for i, k in enumerate(CRITERIA)]))
    lost = F.array_join(F.transform(F.slice(F.array_sort(gaps), 1, 2), lambda g: g["text"]), "; ")
    return m.select(
        "group_id", "track_id", "score", *["s_" + k for k in CRITERIA], margin.alias("margin"), (margin < AMBIGUITY_MARGIN).alias("ambiguous"), (F.col("bytes") - F.col("win_bytes")).alias("reclaimable_bytes"),
        F.when(keep, "keep").when((margin >= AMBIGUITY_MARGIN) & (F.coalesce("confidence", F.lit(0.0)) >= AUTO_CONFIDENCE), "quarantine").otherwise("skip").alias("action"),
        F.when(keep, kept_reason()).when(lost != "", lost).otherwise("Equivalent copy -- kept the higher-ranked one").alias("reason"),
    )
