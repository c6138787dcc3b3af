"""Answers of metadata services, read from their JSON as Columns: nested arrays stay inside one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import title_case

#: Shapes of the answers as far as they are read.
_RESULTS = "array<struct<id: string, score: double, recordings: array<struct<id: string, title: string, artists: array<struct<id: string, name: string>>>>>>"
FINGERPRINT = f"status string, results {_RESULTS}"
_CREDIT = "array<struct<name: string, joinphrase: string>>"
RECORDING = f"title string, length bigint, score double, `artist-credit` {_CREDIT}, genres array<struct<name: string>>, releases array<struct<id: string, title: string, status: string, date: string, `artist-credit`: {_CREDIT}, `release-group`: struct<`secondary-types`: array<string>>, media: array<struct<position: bigint, `track-count`: bigint, track: array<struct<position: bigint>>>>>>"
RECORDINGS = "recordings array<struct<id: string, title: string, score: double, length: double>>"
IMAGES = "array<struct<size: string, `#text`: string>>"
#: Results and recordings of one that count, and the share of a result without recordings (fixed values).
MOST_RESULTS, MOST_RECORDINGS, BARE = 5, 4, 0.5
#: Order of image sizes (fixed values).
SIZES = {"mega": 5, "extralarge": 4, "large": 3, "medium": 2, "small": 1}


def by_fingerprint(json: Column) -> Column:
    """array<struct<acoustid, confidence, title, artist>> of a lookup by fingerprint; empty unless its status is ok.

    The first MOST_RESULTS results count, of each the first MOST_RECORDINGS recordings; a result without
    recordings gives its bare id at half its score.
    """
    j = F.from_json(json, FINGERPRINT)
    entry = lambda acoustid, confidence, title, artist: F.struct(acoustid.alias("acoustid"), confidence.alias("confidence"), title.cast("string").alias("title"), artist.cast("string").alias("artist"))
    score = lambda r: F.coalesce(r["score"], F.lit(0.0))
    named = lambda rec: F.nullif(F.array_join(F.transform(rec["artists"], lambda a: F.coalesce(a["name"], F.lit(""))), " & "), F.lit(""))
    one = lambda r: F.when(F.coalesce(F.size(r["recordings"]), F.lit(0)) > 0, F.transform(F.slice(r["recordings"], 1, MOST_RECORDINGS), lambda rec: entry(r["id"], F.round(score(r), 4), rec["title"], named(rec)))).otherwise(F.array(entry(r["id"], score(r) * BARE, F.lit(None), F.lit(None))))
    return F.when(j["status"] == "ok", F.flatten(F.transform(F.slice(F.coalesce(j["results"], F.array().cast(_RESULTS)), 1, MOST_RESULTS), one)))


def by_search(json: Column, seconds: Column) -> Column:
    """array<struct<id, confidence>> of a search: the score against the best, distrusted where the length is off by more than 12 s, raised within 2 s."""
    recs = F.from_json(json, RECORDINGS)["recordings"]
    top = F.coalesce(F.nullif(F.array_max(F.transform(recs, lambda r: F.coalesce(r["score"], F.lit(0.0)))), F.lit(0.0)), F.lit(100.0))

    def confidence(r: Column) -> Column:
        base = F.round(F.least(F.lit(1.0), F.coalesce(r["score"], F.lit(0.0)) / top * 0.95), 4)
        off = F.abs(r["length"] / 1000 - seconds)
        return F.when((r["length"] > 0) & (seconds > 0) & (off > 12), base * 0.55).when((r["length"] > 0) & (seconds > 0) & (off < 2), F.least(F.lit(1.0), base * 1.05)).otherwise(base)

    return F.transform(recs, lambda r: F.struct(r["id"].alias("id"), confidence(r).alias("confidence")))


def recording(json: Column) -> Column:
    """A recording flattened: its credits joined, its earliest official release (or earliest of all) with medium, position, year and first genre."""
    j = F.from_json(json, RECORDING)
    joined = F.nullif(F.trim(F.array_join(F.transform(j["artist-credit"], lambda c: F.concat(F.coalesce(c["name"], F.lit("")), F.coalesce(c["joinphrase"], F.lit("")))), "")), F.lit(""))
    official = F.filter(j["releases"], lambda r: F.coalesce(r["status"], F.lit("")) == "Official")
    some = F.when(F.size(official) > 0, official).otherwise(j["releases"])
    order = F.array_min(F.transform(some, lambda r, i: F.struct(F.coalesce(F.nullif(r["date"], F.lit("")), F.lit("9999")).alias("d"), i.alias("i"))))["i"]
    first = F.get(some, order)
    last = lambda a: F.element_at(a, -1)
    known = lambda xs: F.when(F.size(xs) > 0, last(xs))
    media = F.coalesce(first["media"], F.array().cast("array<struct<position: bigint, `track-count`: bigint, track: array<struct<position: bigint>>>>"))
    there = lambda xs: F.filter(xs, lambda x: F.coalesce(x, F.lit(0)) != 0)
    positions = there(F.flatten(F.transform(media, lambda m: F.transform(F.coalesce(m["track"], F.array().cast("array<struct<position: bigint>>")), lambda t: t["position"]))))
    credit = F.get(first["artist-credit"], 0)["name"]
    genre = F.get(j["genres"], 0)["name"]
    year = F.substring(F.coalesce(first["date"], F.lit("")), 1, 4)
    return F.struct(
        joined.alias("artist"), F.coalesce(credit, joined).alias("albumartist"), first["title"].alias("album"), first["date"].alias("date"), F.when(year.rlike("^[0-9]{1,4}$"), year.cast("int")).alias("year"),
        known(positions).alias("track_no"), known(there(F.transform(media, lambda m: m["track-count"]))).alias("total_tracks"), known(there(F.transform(media, lambda m: m["position"]))).alias("disc_no"),
        title_case(genre).alias("genre"), F.coalesce(F.array_contains(first["release-group"]["secondary-types"], "Compilation"), F.lit(False)).alias("compilation"),
    )


def ranked(position: Column, first: float, step: float, least: float) -> Column:
    """Confidence of a service's own order: `first` for position 0, falling by `step`, never below `least`."""
    return F.round(F.greatest(F.lit(least), first - position * step), 4)


def by_tracklist(base: Column, listed: Column, similarity: Column) -> Column:
    """Confidence of a release after its track list: x 0.4 if it has one without the title, x (0.5 + 0.5 similarity) if it has it (0..100, null: not in it)."""
    return F.when(~listed, base).when(similarity.isNull(), F.round(base * 0.4, 4)).otherwise(F.round(base * (0.5 + 0.5 * similarity / 100), 4))


def largest_image(json: Column) -> Column:
    """The address of the largest image that has one; the first of equal ones."""
    rank = lambda i: F.coalesce(*[F.when(i["size"] == k, v) for k, v in SIZES.items()], F.lit(0))
    with_text = F.filter(F.from_json(json, IMAGES), lambda i: F.coalesce(i["#text"], F.lit("")) != "")
    best = F.array_max(F.transform(with_text, lambda i, k: F.struct(rank(i).alias("r"), (-k).alias("k"), i["#text"].alias("u"))))
    return best["u"]
