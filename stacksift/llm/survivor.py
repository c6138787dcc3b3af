"""Problem 3: the best representative of each duplicate group.

`survivors` unpivots the fields of a group's members to long rows, sums votes (source trust times recency
decay) per normalised value, takes each field's winner by max_by and pivots back. In text fields a member
votes for its own value; in ranked fields, where higher is better, it approves of its own value and of
every higher one. `dominant_members` then checks which member, if any, bears the voted record against all
others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ("format", "bitrate", "resolution", "tags", "artwork", "lyrics", "duration", "path")
#: Text fields of the surviving record and what makes two values the same.
TEXT_FIELDS = ("title", "artist", "albumartist", "album", "year", "genre", "codec")
HALF_LIFE_DAYS = 365.0
#: Moment from which ages are measured; a later one scales all votes alike.
AS_OF = "2026-01-01 00:00:00"


def valid_members(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per (group, track) whose track exists: of several the one with the highest id; tracks joined.

    Repeated member or track rows count once (of track rows that differ, the greatest by their fields in
    order). Scores on the scale 0..100 (told by an entry above 1) are
    brought to 0..1 and all are rounded to 3 places; null breakdowns and entries stay null.
    """
    b = F.col("score_breakdown")
    top = F.greatest(*[F.coalesce(b[s], F.lit(0.0)) for s in SCORES])
    scaled = F.struct(*[F.round(F.when(top > 1, b[s] / 100).otherwise(b[s]), 3).alias(s) for s in SCORES])
    m = members.where("group_id is not null and track_id is not null").groupBy("group_id", "track_id").agg(F.max_by(F.struct(b), "id")["score_breakdown"].alias("score_breakdown"))
    t = tracks.select(F.col("id").alias("track_id"), F.struct("tag_completeness", F.col("lossless").cast("double").alias("lossless"), "first_seen", *TEXT_FIELDS).alias("x")).groupBy("track_id").agg(F.max("x").alias("x")).select("track_id", "x.*")
    return m.join(t, "track_id").withColumn("score", scaled).drop("score_breakdown").select("*", *[F.col("score")[s].alias("s_" + s) for s in SCORES]).drop("score")


RANKED = (*("s_" + s for s in SCORES), "tag_completeness", "lossless")


def normalised(value: Column) -> Column:
    """The form in which values are the same: trimmed, lower case with one form of sigma, spaces squeezed; blank is null."""
    return F.nullif(F.regexp_replace(F.translate(F.lower(F.trim(value)), "ς", "σ"), r"\s+", " "), F.lit(""))


def survivors(rows: DataFrame, text_fields: tuple[str, ...] = TEXT_FIELDS, ranked: tuple[str, ...] = RANKED, half_life_days: float = HALF_LIFE_DAYS, as_of: str = AS_OF) -> DataFrame:
    """One record per group_id, built field by field from `rows` (group_id, track_id, first_seen, the fields).

    A member's vote weighs trust (tag_completeness plus a tenth for lossless, 0.5 where unknown) times
    0.5 ** (age / half life), age being measured back from `as_of` and an unknown one counting as four half
    lives. Votes are summed per normalised value and rounded to 6 places.
    Text fields: the value with the most votes wins, ties go to the value that sorts first; the spelling with
    the most votes, then the first in order, stands for the value.
    Ranked fields are normalised to 3 places within 0..1: a vote counts for its own value and all higher
    ones, so the value that most of the trusted, recent votes stand behind wins, ties going to the higher
    one; the highest exact value stands for it.
    Nulls and blanks don't vote; a field nobody knows is null; a group of one member is that member's record.
    The long rows are aggregated map-side and a ranked field has 1001 normalised values at most, so a group
    of any size passes through no single task.
    """
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("first_seen").cast("timestamp"))) / F.lit(86400.0 * half_life_days)
    trust = F.greatest(F.coalesce(F.col("tag_completeness"), F.lit(0.5)), F.lit(0.0)) + F.coalesce(F.col("lossless"), F.lit(0.0)) / 10
    voted = rows.withColumn("_vote", trust * F.pow(F.lit(0.5), F.coalesce(age, F.lit(4.0))))
    entries = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(None).cast("double").alias("rank")) for f in text_fields]
    entries += [F.struct(F.lit(f).alias("field"), F.lit(None).cast("string").alias("value"), F.col(f).cast("double").alias("rank")) for f in ranked]
    step = F.when(F.col("e.rank").isNotNull(), F.round(F.least(F.greatest(F.col("e.rank"), F.lit(0.0)), F.lit(1.0)), 3))
    long = voted.select("group_id", "_vote", F.explode(F.array(*entries)).alias("e")).select("group_id", "e.field", "e.value", "e.rank", "_vote", normalised(F.col("e.value")).alias("norm"), step.alias("step")).where("norm is not null or rank is not null")
    spelt = long.groupBy("group_id", "field", "norm", "step", "value").agg(F.sum("_vote").alias("v"), F.max("rank").alias("rank"))
    per_value = spelt.groupBy("group_id", "field", "norm", "step").agg(F.round(F.sum("v"), 6).alias("votes"), F.min(F.struct(-F.round("v", 6), "value"))["value"].alias("value"), F.max("rank").alias("rank"))
    own = F.min_by(F.struct("value", "rank"), F.struct(-F.col("votes"), "norm"))
    steps = F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", "votes", "rank"))))
    won = per_value.groupBy("group_id", "field").agg(own.alias("w"), steps.alias("steps"))
    # votes for a step are those of all steps up to it, summed upwards
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("votes"), F.lit(None).cast("double").alias("rank"))
    best = F.aggregate("steps", none, lambda a, x: F.struct((a["sum"] + x["votes"]).alias("sum"), F.greatest(a["votes"], a["sum"] + x["votes"]).alias("votes"), F.when(a["sum"] + x["votes"] >= a["votes"], x["rank"]).otherwise(a["rank"]).alias("rank")))["rank"]
    won = won.select("group_id", "field", F.when(F.size("steps") > 0, F.struct(F.lit(None).cast("string").alias("value"), best.alias("rank"))).otherwise(F.col("w")).alias("w"))
    pick = lambda f, k: F.max(F.when(F.col("field") == f, F.col("w")[k])).alias(f)
    return won.groupBy("group_id").agg(*[pick(f, "value") for f in text_fields], *[pick(f, "rank") for f in ranked])


def dominant_members(rows: DataFrame) -> DataFrame:
    """(group_id, track_id) of the member that beats every other one of its group, where there is one.

    A beats B if A is nowhere lower and somewhere higher in RANKED, compared where both are known and with
    tag_completeness and lossless; if they differ nowhere, the earlier first_seen, then the smaller
    track_id wins. Groups of fewer than two members give no row; a null first_seen counts as the latest.

    Candidates are the members that bear the record voted by `survivors` (approval makes its ranked values
    the highest known ones, as every member approves of them). The exact check needs no pairs: a member's
    set `bad` holds the fields in which it is known and below that record, its set `known` those known. A winner has no bad field. Against it, B
    differs nowhere just when B's bad set shares nothing with A's known set; then B must come later. So
    per group the earliest member of every bad set is enough, and a group has 2**10 of them at most.
    """
    best = survivors(rows, (), RANKED).select("group_id", *[F.col(f).alias("b_" + f) for f in RANKED])
    bits = lambda cond: reduce(lambda x, y: x + y, [F.when(cond(f), 1 << i).otherwise(0) for i, f in enumerate(RANKED)])
    order = F.struct(F.coalesce(F.col("first_seen").cast("timestamp"), F.lit("9999-01-01").cast("timestamp")).alias("t"), "track_id")
    marked = rows.select("group_id", "track_id", "first_seen", *RANKED).join(best, "group_id", "left").select("group_id", order.alias("o"), bits(lambda f: F.col(f) < F.col("b_" + f)).alias("bad"), bits(lambda f: F.col(f).isNotNull()).alias("known"))
    firsts = marked.groupBy("group_id", "bad").agg(F.min(F.struct("o", "known")).alias("f"), F.count("*").alias("n"))
    group = firsts.groupBy("group_id").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bad", "f")).alias("all"), F.max(F.when(F.col("bad") == 0, F.col("f"))).alias("a"))
    blocked = F.exists("all", lambda x: (x["bad"].bitwiseAND(F.col("a.known")) == 0) & (x["f"]["o"] < F.col("a.o")))
    return group.where(F.col("a").isNotNull() & (F.col("n") > 1) & ~blocked).select("group_id", F.col("a.o.track_id").alias("track_id"))
