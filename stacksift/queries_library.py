
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import queries_sql as qs
from . import sources
from .core.components import star_components
from .core.session import table
from .sources import providers, tags
from .functions import fingerprint, fuzzy, media, text
from .operators import decision, dedup, fusion, incremental, jobs
from .operators.search import best_matches
from .plans import cleanup, organise
from .streaming import activity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2025-06-30 00:00:00"
T = "t AS (SELECT DISTINCT * EXCLUDE (raw_tags) FROM tracks)"
M = "m AS (SELECT group_id, track_id, arg_max(proposed_action, id) AS proposed_action, max(id) AS id FROM duplicate_members GROUP BY ALL)"
Q = "q AS (SELECT DISTINCT * FROM quarantine)"


def q(name: str, sql: str | None = None, *ctes: str):
    """Registers a query under its name, with the statement it must equal."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def lib(s: SparkSession, d: str, *c: str) -> DataFrame:
    return sources.library(s, d, *c)


def lower(c: str):
    """Lower case with one form of sigma; engines differ on the final one."""
    return F.translate(F.lower(c), "ς", "σ")


def members(s: SparkSession, d: str) -> DataFrame:
    """One row per group and track, of several the one with the highest id."""
    m = table(s, d, "duplicate_members")
    return m.groupBy("group_id", "track_id").agg(F.max_by("proposed_action", "id").alias("proposed_action"), F.max("id").alias("id"))


def quarantine(s: SparkSession, d: str) -> DataFrame:
    return sources.ingested(s, d, "quarantine")


def candidates(s: SparkSession, d: str) -> DataFrame:
    return sources.ingested(s, d, "candidates")


# ---------------------------------------------------------------- sources
q("src_01", "SELECT id, path, size_bytes FROM t WHERE status = 'active' AND starts_with(path, '/lib00/nas/')", T)(lambda s, d: sources.scan(lib(s, d, "path", "size_bytes", "status"), prefix="/lib00/nas").select("id", "path", "size_bytes"))
q("src_02")(lambda s, d: sources.listing(s, d, "*.parquet"))


@q("src_03", """SELECT id, nullif(lower(codec), '') AS codec, nullif(duration, 0) AS duration, coalesce(nullif(bitrate, 0), CASE WHEN duration > 0 THEN CAST(trunc(size_bytes * 8 / duration) AS BIGINT) END) AS bitrate,
  nullif(bit_depth, 0) AS bit_depth, coalesce(lower(codec) IN ('flac','alac','wav','pcm_s16le','pcm_s24le','aiff','ape','wavpack','dsd'), false) AS lossless, coalesce(duration, 0) <= 0 AS corrupt FROM t""", T)
def src_03(s, d):
    t = lib(s, d, "codec", "duration", "bitrate", "bit_depth", "size_bytes")
    j = F.to_json(F.struct(F.array(F.struct(F.col("codec").alias("codec_name"), F.col("bitrate").cast("string").alias("bit_rate"), F.col("bit_depth").cast("string").alias("bits_per_raw_sample"))).alias("streams"), F.struct(F.col("duration").cast("string").alias("duration")).alias("format")))
    return t.select("id", sources.probed(j, F.col("size_bytes")).alias("p")).select("id", "p.codec", "p.duration", "p.bitrate", "p.bit_depth", "p.lossless", "p.corrupt")


@q("src_04", """SELECT id, nullif(title, '') AS title, nullif(artist, '') AS artist, nullif(albumartist, '') AS albumartist, nullif(album, '') AS album, nullif(genre, '') AS genre, CASE WHEN year BETWEEN 1860 AND 2200 THEN year END::INT AS year, track_no, CASE WHEN k = 1 OR k IN (0, 2) AND track_no IS NOT NULL THEN total_tracks END AS total_tracks, CASE WHEN k < 4 THEN disc_no END AS disc_no,
  CASE WHEN k < 4 THEN nullif(isrc, '') END AS isrc, CASE WHEN k < 3 THEN nullif(mb_recording_id, '') END AS mb_recording_id, k < 3 AND coalesce(lower(trim(albumartist)) = 'various artists', false) AS compilation FROM (SELECT *, id % 5 AS k FROM t)""", T)
def src_04(s, d):
    """Tags read back from the frame maps of five kinds of containers, made of the library's rows by id."""
    names = ("id3", "vorbis", "mp4", "asf", "generic")
    kind = F.element_at(F.array(*[F.lit(k) for k in names]), (F.col("id") % 5 + 1).cast("int"))
    number = lambda own, total: F.when(F.col(own).isNotNull(), F.concat(F.lit(" "), F.col(own).cast("string"), F.coalesce(F.concat(F.lit("/"), F.col(total).cast("string")), F.lit("")) if total else F.lit("")))
    both = {"title": F.col("title"), "artist": F.col("artist"), "albumartist": F.col("albumartist"), "album": F.col("album"), "genre": F.col("genre"), "date": F.concat(F.col("year").cast("string"), F.lit("-01-01")), "isrc": F.col("isrc"), "mb_recording_id": F.col("mb_recording_id")}

    def frames(k: str):
        own, total, disc, _ = tags.NUMBERS[k]
        pairs = [(tags.KINDS[k][f][-1], c) for f, c in both.items() if f in tags.KINDS[k]]
        pairs.append((own[-1], number("track_no", "total_tracks" if k in tags.PAIRED else None)))
        pairs += [(total[-1], F.col("total_tracks").cast("string"))] if total else []
        pairs += [(disc[-1], number("disc_no", None))] if disc else []
        pairs += [(tags.COMPILATION[k][0], F.when(F.lower(F.trim("albumartist")) == "various artists", tags.COMPILATION[k][1][-1]))] if k in tags.COMPILATION else []
        made = F.array(*[F.struct(F.lit(n.upper() if k == "vorbis" else n).alias("key"), F.array(c, F.lit("more")).alias("value"), (F.coalesce(c, F.lit("")) != "").alias("there")) for n, c in pairs])
        return F.map_from_entries(F.transform(F.filter(made, lambda e: e["there"]), lambda e: F.struct(e["key"], e["value"])))

    m = F.when(kind == "id3", frames("id3"))
    for k in names[1:]:
        m = m.when(kind == k, frames(k))
    t = lib(s, d, "title", "artist", "albumartist", "album", "genre", "year", "track_no", "total_tracks", "disc_no", "isrc", "mb_recording_id")
    fields = ("title", "artist", "albumartist", "album", "genre", "year", "track_no", "total_tracks", "disc_no", "isrc", "mb_recording_id", "compilation")
    return t.select("id", kind.alias("kind"), m.alias("m")).select("id", tags.read(F.col("kind"), F.col("m")).alias("x")).select("id", *[f"x.{f}" for f in fields])


q("src_05", "SELECT doc_id, sha256(text) AS digest FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("digest")))


@q("src_06", """WITH k AS (SELECT doc_id, text, sha256(n_chars || substr(text, 1, 256) || substr(text, -256)) AS quick FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(text) AS digest FROM k WHERE quick IN (SELECT quick FROM k GROUP BY quick HAVING count(*) > 1)""")
def src_06(s, d):
    """Two stages: a cheap signature of size, head and tail; the whole text is hashed only where signatures meet."""
    k = table(s, d, "documents").where("text is not null").withColumn("quick", F.sha2(F.concat(F.col("n_chars").cast("string"), F.substring("text", 1, 256), F.right("text", F.lit(256))), 256))
    twice = k.groupBy("quick").agg(F.count("*").alias("n")).where("n > 1").select("quick")
    return k.join(twice, "quick", "left_semi").select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))


q("src_07", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))).alias("digest")))


@q("src_09a", """SELECT candidate_id, position, acoustid, confidence, title, artist FROM (SELECT candidate_id, i, j, candidate_id || '-' || i AS acoustid, CASE WHEN i % 3 = 0 THEN coalesce(confidence, 0.5) * (10 - i) / 10 * 0.5 ELSE round(coalesce(confidence, 0.5) * (10 - i) / 10, 4) END AS confidence, CASE WHEN i % 3 > 0 THEN title END AS title,
  CASE WHEN i % 3 > 0 THEN nullif(coalesce(artist, '') || ' & ' || coalesce(albumartist, ''), '') END AS artist, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY i, j) - 1 AS INT) AS position FROM (SELECT DISTINCT * FROM candidates) , range(1, 6) a(i), range(1, 5) b(j) WHERE (i % 3 > 0 OR j = 1) AND confidence IS NOT NULL)""")
def src_09a(s, d):
    """Answers of a lookup by fingerprint, read from nested JSON: five results of six, four recordings of five, bare ids at half."""
    person = lambda c: F.struct(F.lit("a").alias("id"), F.coalesce(F.col(c), F.lit("")).alias("name"))
    rec = F.struct(F.lit("r").alias("id"), F.col("title").alias("title"), F.array(person("artist"), person("albumartist")).alias("artists"))
    result = lambda i: F.struct(F.concat(F.col("candidate_id").cast("string"), F.lit("-"), i.cast("string")).alias("id"), (F.coalesce("confidence", F.lit(0.5)) * (10 - i) / 10).alias("score"), F.when(i % 3 > 0, F.array_repeat(rec, 5)).alias("recordings"))
    c = candidates(s, d).select("candidate_id", F.to_json(F.struct(F.when(F.col("confidence").isNull(), "error").otherwise("ok").alias("status"), F.transform(F.sequence(F.lit(1), F.lit(6)), result).alias("results"))).alias("json"))
    return c.select("candidate_id", F.posexplode(providers.by_fingerprint(F.col("json"))).alias("position", "x")).select("candidate_id", "position", "x.*")


@q("src_09b", """SELECT candidate_id, i AS id, CASE WHEN i < 4 AND off > 12 THEN base * 0.55 WHEN i < 4 AND off < 2 THEN least(1.0, base * 1.05) ELSE base END AS confidence FROM (SELECT candidate_id, CAST(i AS VARCHAR) AS sid, i, abs(180 + i * 9 * (pos % 3) - 180)::DOUBLE AS off,
  round(least(1.0, CAST(100 - 17 * i AS DOUBLE) / 83 * 0.95::DOUBLE), 4) AS base FROM (SELECT DISTINCT * FROM candidates), range(1, 5) a(i) WHERE pos IS NOT NULL)""".replace("i AS id", "sid AS id"))
def src_09b(s, d):
    """Answers of a search, read from JSON: scores against the best, distrusted where the length is far off, raised where it is near."""
    rec = lambda i: F.struct(i.cast("string").alias("id"), (100 - 17 * i).alias("score"), F.when(i < 4, (180 + i * 9 * (F.col("pos") % 3)) * 1000).alias("length"))
    c = candidates(s, d).where("pos is not null").select("candidate_id", F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.lit(4)), rec).alias("recordings"))).alias("json"))
    return c.select("candidate_id", F.explode(providers.by_search(F.col("json"), F.lit(180.0))).alias("x")).select("candidate_id", "x.*")


@q("src_09c", """SELECT candidate_id, nullif(trim(coalesce(artist, '') || ' feat. ' || coalesce(albumartist, '')), '') AS artist, coalesce(albumartist, nullif(trim(coalesce(artist, '') || ' feat. ' || coalesce(albumartist, '')), '')) AS albumartist, CASE WHEN first THEN album ELSE 'Again' END AS album, CASE WHEN first THEN release_date ELSE '2001-05' END AS date,
  CASE WHEN NOT first THEN 2001 WHEN regexp_full_match(substr(release_date, 1, 4), '[0-9]{1,4}') THEN CAST(substr(release_date, 1, 4) AS INT) END AS year, CASE WHEN first THEN nullif(track_no, 0) END AS track_no, CASE WHEN first THEN nullif(total_tracks, 0) END AS total_tracks, CASE WHEN first THEN 1 END::BIGINT AS disc_no,
  array_to_string(list_transform(regexp_extract_all(genre, '(\\p{L}+|\\P{L}+)'), lambda w: upper(w[1]) || lower(w[2:])), '') AS genre, first AND compilation IS NOT DISTINCT FROM true AS compilation
FROM (SELECT *, candidate_id % 2 = 0 AND coalesce(nullif(release_date, ''), '9999') <= '2001-05' OR candidate_id % 2 = 1 AS first FROM (SELECT DISTINCT * FROM candidates))""")
def src_09c(s, d):
    """Recordings flattened from JSON: credits joined, the earliest official release with its medium; of odd answers only the first release is official."""
    credit = lambda *c: F.array(*[F.struct(F.coalesce(F.col(x), F.lit("")).alias("name") if k else F.col(x).alias("name"), F.lit(j).alias("joinphrase")) for x, j, k in c])
    status = lambda even: F.when(F.col("candidate_id") % 2 == 0, "Official").otherwise(even)
    track = F.array(F.struct(F.lit(1).alias("position"), F.col("total_tracks").alias("track-count"), F.array(F.struct(F.col("track_no").alias("position"))).alias("track")))
    kinds = F.struct(F.when(F.col("compilation"), F.array(F.lit("Compilation"))).otherwise(F.array().cast("array<string>")).alias("secondary-types"))
    one = F.struct(F.lit("1").alias("id"), F.col("album").alias("title"), status("Official").alias("status"), F.col("release_date").alias("date"), credit(("albumartist", "", False)).alias("artist-credit"), kinds.alias("release-group"), track.alias("media"))
    two = F.struct(F.lit("2").alias("id"), F.lit("Again").alias("title"), status("Bootleg").alias("status"), F.lit("2001-05").alias("date"), credit(("albumartist", "", False)).alias("artist-credit"))
    rec = F.to_json(F.struct("title", credit(("artist", " feat. ", True), ("albumartist", "", True)).alias("artist-credit"), F.array(F.struct(F.col("genre").alias("name"))).alias("genres"), F.array(F.from_json(F.to_json(one), _RELEASE), F.from_json(F.to_json(two), _RELEASE)).alias("releases")))
    return candidates(s, d).select("candidate_id", rec.alias("json")).select("candidate_id", providers.recording(F.col("json")).alias("x")).select("candidate_id", "x.*")


_RELEASE = "id string, title string, status string, date string, `artist-credit` array<struct<name: string, joinphrase: string>>, `release-group` struct<`secondary-types`: array<string>>, media array<struct<position: bigint, `track-count`: bigint, track: array<struct<position: bigint>>>>"
@q("src_09f", """SELECT candidate_id, CASE WHEN album <> '' THEN 0.62::DOUBLE ELSE round(greatest(0.25::DOUBLE, 0.55::DOUBLE - (pos - 1) * 0.08::DOUBLE), 4) END AS confidence, CASE WHEN artwork_px >= 1000 THEN 'extra' WHEN artwork_px >= 600 THEN 'large' WHEN artwork_px IS NOT NULL THEN 'medium' ELSE 'small' END AS artwork FROM (SELECT DISTINCT * FROM candidates)""")
def src_09f(s, d):
    """A supporting source: the answer on the track itself at .62, else by the order of its search; the largest image that has an address."""
    px = F.col("artwork_px")
    image = lambda size, text, has: F.struct(F.lit(size).alias("size"), F.when(has, text).otherwise("").alias("#text"))
    images = F.to_json(F.array(image("small", "small", F.lit(True)), image("medium", "medium", px.isNotNull()), image("extralarge", "extra", F.coalesce(px >= 1000, F.lit(False))), image("large", "large", F.coalesce(px >= 600, F.lit(False)))))
    return candidates(s, d).select("candidate_id", F.when(F.col("album") != "", 0.62).otherwise(providers.ranked(F.col("pos") - 1, 0.55, 0.08, 0.25)).alias("confidence"), providers.largest_image(images).alias("artwork"))


@q("src_09g", """SELECT album, arg_min(id, (CASE WHEN has_synced_lyrics THEN 0 ELSE 1 END, round(abs(duration - want), 6), id)) AS chosen, CASE WHEN bool_or(has_synced_lyrics) THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM a JOIN g USING (album) GROUP BY album HAVING min(abs(duration - want)) <= 12""", T, "a AS (SELECT id, album, duration, has_synced_lyrics FROM t WHERE album <> '' AND duration > 0)", "g AS (SELECT album, avg(duration) AS want FROM a GROUP BY album)")
def src_09g(s, d):
    """Of an album's tracks the nearest to its mean length, those with synced lyrics before others; none where even the nearest is more than 12 s off."""
    a = lib(s, d, "album", "duration", "has_synced_lyrics").where("album <> '' and duration > 0")
    x = a.join(a.groupBy("album").agg(F.avg("duration").alias("want")), "album").withColumn("off", F.abs(F.col("duration") - F.col("want")))
    best = F.min_by("id", F.struct((~F.col("has_synced_lyrics")).cast("int"), F.round("off", 6), F.col("id")))
    return x.groupBy("album").agg(best.alias("chosen"), F.when(F.bool_or("has_synced_lyrics"), 0.9).otherwise(0.7).alias("confidence"), F.min("off").alias("off")).where("off <= 12").select("album", "chosen", "confidence")


@q("src_10", """WITH c AS (SELECT sha1(source || '|' || title) AS cache_key, arg_max(candidate_id, (fetched_at, candidate_id)) AS payload, max(fetched_at) + INTERVAL 365 DAY AS expires_at FROM candidates WHERE fetched_at IS NOT NULL GROUP BY ALL)
SELECT r.cache_key, CASE WHEN c.expires_at >= TIMESTAMP '2025-06-30' THEN c.payload END AS payload FROM (SELECT DISTINCT sha1(source || '|' || title) AS cache_key FROM candidates) r LEFT JOIN c USING (cache_key)""")
def src_10(s, d):
    c = table(s, d, "candidates").withColumn("cache_key", text.cache_key(F.col("source"), F.col("title")))
    cache = incremental.latest(c.where("fetched_at is not null").select("cache_key", F.col("candidate_id").alias("payload"), "fetched_at", "candidate_id"), ["cache_key"], ["fetched_at", "candidate_id"]).select("cache_key", "payload", (F.col("fetched_at") + F.expr("INTERVAL 365 DAYS")).alias("expires_at"))
    return sources.cached(c.select("cache_key").distinct(), cache, AS_OF)


@q("src_11", "WITH l AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 800) SELECT event_id AS line_no, props AS text FROM l WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 200")
def src_11(s, d):
    lines = table(s, d, "events").select(F.col("event_id").alias("line_no"), F.col("event_type").alias("level"), F.col("props").alias("text"))
    return sources.log_tail(lines, 200, "error").select("line_no", "text")


q("src_14", "SELECT id, replace(path, '/lib00/music', '***') AS line FROM t", T)(lambda s, d: lib(s, d, "path").select("id", text.redacted(F.col("path"), ["/lib00/music", "nas"]).alias("line")))

# ---------------------------------------------------------------- projections and filters
_C = ("path", "filename", "ext", "codec", "lossless", "bitrate", "duration", "title", "artist", "album", "year", "status", "tag_completeness", "quality_score")
q("pf_01", f"SELECT id, {', '.join(_C)}, round(size_bytes / 1048576.0, 2) AS size_mb FROM t", T)(lambda s, d: lib(s, d, *_C, "size_bytes").select("id", *_C, F.round(F.col("size_bytes") / 1048576.0, 2).alias("size_mb")))
q("pf_02", "SELECT id FROM t WHERE status = 'active' AND codec = 'flac' AND lossless", T)(lambda s, d: lib(s, d, "status", "codec", "lossless").where("status = 'active' and codec = 'flac' and lossless").select("id"))
q("pf_03", "SELECT id FROM t WHERE status = 'active' AND NOT has_artwork AND tag_completeness < 0.85", T)(lambda s, d: lib(s, d, "status", "has_artwork", "tag_completeness").where("status = 'active' and not has_artwork and tag_completeness < 0.85").select("id"))


def groups_where(g: DataFrame, kind: str | None = None, resolved: bool | None = None, min_bytes: int | None = None) -> DataFrame:
    """Optional filters, each applied only when given."""
    for cond in (kind is not None and F.col("kind") == kind, resolved is not None and F.col("resolved") == resolved, min_bytes is not None and F.col("reclaimable_bytes") >= min_bytes):
        g = g if cond is False else g.where(cond)
    return g


q("pf_04", "SELECT id FROM duplicate_groups WHERE kind = 'acoustic' AND resolved = false AND reclaimable_bytes >= 1000000")(lambda s, d: groups_where(table(s, d, "duplicate_groups"), "acoustic", False, 1_000_000).select("id"))
q("pf_05", "SELECT id FROM t WHERE codec IN ('mp3', 'aac', 'opus')", T)(lambda s, d: lib(s, d, "codec").where(F.col("codec").isin("mp3", "aac", "opus")).select("id"))
q("pf_06", "SELECT id FROM t WHERE status = 'active' AND (audio_md5 IS NULL OR fingerprint IS NULL)", T)(lambda s, d: lib(s, d, "status", "audio_md5", "fingerprint").where("status = 'active' and (audio_md5 is null or fingerprint is null)").select("id"))
q("pf_07", "SELECT id FROM t WHERE starts_with(path, '/lib00/music/')", T)(lambda s, d: lib(s, d, "path").where(F.col("path").startswith("/lib00/music/")).select("id"))


def search(t: DataFrame, query: str) -> DataFrame:
    """Tracks with a token for every word of the query, the last word being a prefix."""
    words = [w for w in query.lower().split() if w]
    bag = F.array_union(F.array_union(text.tokens(F.col("title")), text.tokens(F.col("artist"))), F.array_union(text.tokens(F.col("album")), text.tokens(F.col("albumartist"))))
    t = t.withColumn("_bag", bag)
    for w in words[:-1]:
        t = t.where(F.array_contains("_bag", w))
    return t.where(F.exists("_bag", lambda x: x.startswith(words[-1]))).drop("_bag") if words else t.drop("_bag")


q("pf_08", "SELECT id FROM (SELECT id, regexp_split_to_array(lower(concat_ws(' ', title, artist, album, albumartist)), '[^\\p{L}\\p{N}]+') AS bag FROM t) WHERE list_contains(bag, 'the') AND len(list_filter(bag, lambda x: starts_with(x, 'gold'))) > 0", T)(lambda s, d: search(lib(s, d, "title", "artist", "album", "albumartist"), "the gold").select("id"))
q("pf_09", "SELECT id FROM t WHERE title ILIKE '%river%' OR artist ILIKE '%river%' OR album ILIKE '%river%' OR path ILIKE '%river%'", T)(lambda s, d: lib(s, d, "title", "artist", "album", "path").where(" or ".join(f"{c} ilike '%river%'" for c in ("title", "artist", "album", "path"))).select("id"))
q("pf_10", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")(lambda s, d: table(s, d, "events").where("ts >= timestamp_ntz '2024-01-31' - interval 7 days").select("event_id"))
q("pf_11", "SELECT id FROM q WHERE NOT restored AND purge_after <= TIMESTAMP '2025-06-30'", Q)(lambda s, d: quarantine(s, d).where(f"not restored and purge_after <= timestamp_ntz '{AS_OF}'").select("id"))
q("pf_12", "SELECT id, title FROM t WHERE id = 100", T)(lambda s, d: lib(s, d, "title").where("id = 100"))


def lexical(path):
    """A path with '.' and '..' resolved without touching the disk."""
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)).otherwise(F.array_append(a, x))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def inside(path, root: str):
    return lexical(path).startswith(root.rstrip("/") + "/") | (lexical(path) == root.rstrip("/"))


q("pf_13", "SELECT id, starts_with(path, '/lib00/music/') AS within FROM t", T)(lambda s, d: lib(s, d, "path").select("id", inside(F.concat(F.lit("/lib00/./nas/../"), F.substring("path", 8, 10_000)), "/lib00/music").alias("within")))
q("pf_14", "SELECT id FROM t WHERE regexp_matches(path, '^/(lib00/(Downloads|incoming)|etc)/')", T)(lambda s, d: lib(s, d, "path").where(F.col("path").rlike("^/(lib00/(Downloads|incoming)|etc)/")).select("id"))
_SUGGEST = "CASE WHEN lower(coalesce(codec, '')) IN ('wmav1','wmav2','wmapro','ra_144','ra_288','adpcm_ms','amr_nb') THEN CASE WHEN coalesce(bitrate, 0) > 320000 THEN 'flac' ELSE 'aac_256' END WHEN lossless AND duration > 0 AND size_bytes * 8 / duration > 2800000 THEN 'flac_16_44' END"
q("pf_15", f"SELECT * FROM (SELECT id, {_SUGGEST} AS preset FROM t) WHERE preset IS NOT NULL", T)(lambda s, d: lib(s, d, "codec", "bitrate", "lossless", "duration", "size_bytes").select("id", media.suggestion().alias("preset")).where("preset is not null"))
q("pf_16", "SELECT id FROM t WHERE NOT has_artwork OR coalesce(artwork_px, 0) < 600", T)(lambda s, d: lib(s, d, "has_artwork", "artwork_px").where("not has_artwork or coalesce(artwork_px, 0) < 600").select("id"))
q("pf_17", "SELECT id FROM t WHERE lower(trim(albumartist)) IN ('various artists', 'various', 'va')", T)(lambda s, d: lib(s, d, "albumartist").where("lower(trim(albumartist)) in ('various artists', 'various', 'va')").select("id"))


def made_files(s, d):
    """File paths around the tracks: sidecars, left-overs and cache files by rule from the id."""
    p = F.col("path")
    stem = F.regexp_replace(p, r"\.[^./]*$", "")
    return lib(s, d, "path", "size_bytes").select("id", F.when(F.col("id") % 11 == 0, F.concat(stem, F.lit(".lrc"))).when(F.col("id") % 11 == 1, F.concat(p, F.lit(".part-1"))).when(F.col("id") % 11 == 2, F.concat(F.regexp_replace(p, "/[^/]*$", "/@eaDir/"), F.lit("x.db"))).otherwise(p).alias("path"), "size_bytes")


_FILES = r"""f AS (SELECT id, size_bytes, CASE id % 11 WHEN 0 THEN regexp_replace(path, '\.[^./]*$', '') || '.lrc' WHEN 1 THEN path || '.part-1' WHEN 2 THEN regexp_replace(path, '/[^/]*$', '/@eaDir/') || 'x.db' ELSE path END AS path FROM t),
c AS (SELECT *, CASE WHEN regexp_matches(lower(path), '\.part-|\.tmp|\.partial') THEN 'temp' WHEN regexp_matches(lower(path), '\.(mp3|flac|wav|aac|m4a|m4b|alac|ogg|oga|opus|wma|aiff|aif|ape|wv|dsf)$') THEN NULL WHEN contains(path, '/@eaDir/') THEN 'cache' WHEN regexp_matches(lower(path), '\.(lrc|cue|log|m3u|m3u8)$') THEN 'sidecar' END AS category FROM f)"""
q("pf_18", "SELECT id, category FROM c WHERE category IS NOT NULL", T, _FILES)(lambda s, d: made_files(s, d).select("id", cleanup.file_category().alias("category")).where("category is not null"))


def violations(t: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(id, problems): the names of the rules a row breaks, in order; a rule that is null is not broken."""
    return t.withColumn("problems", F.array_compact(F.array(*[F.when(F.expr(cond) == F.lit(False), F.lit(name)) for name, cond in rules.items()]))).where("size(problems) > 0").select("id", F.array_join("problems", ",").alias("problems"))


_RULES = {"year": "year between 1860 and 2200", "bitrate": "bitrate between 8000 and 10000000", "title": "length(title) <= 25", "status": "status in ('active', 'missing')"}
q("pf_19", "SELECT * FROM (SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in _RULES.items()) + ") AS problems FROM t) WHERE problems <> ''", T)(lambda s, d: violations(lib(s, d, "year", "bitrate", "title", "status"), _RULES))
q("pf_20", "SELECT id, CASE WHEN size_bytes < 2000000 THEN 'corrupt' ELSE status END AS status FROM t", T)(lambda s, d: lib(s, d, "size_bytes", "status").select("id", F.when(F.col("size_bytes") < 2_000_000, "corrupt").otherwise(F.col("status")).alias("status")))
q("pf_21", "SELECT kind, list_filter([kind, 'exact_file'], lambda x: x NOT IN ('exact_file', 'acoustic')) AS unknown FROM (SELECT DISTINCT kind FROM duplicate_groups)")(lambda s, d: table(s, d, "duplicate_groups").select("kind").distinct().select("kind", F.array_except(F.array("kind", F.lit("exact_file")), F.array(F.lit("exact_file"), F.lit("acoustic"))).alias("unknown")))


# ---------------------------------------------------------------- joins
@q("jn_01", "SELECT m.group_id, list(m.track_id ORDER BY m.id DESC) AS tracks, CAST(sum(t.size_bytes) AS BIGINT) AS bytes FROM m JOIN t ON t.id = m.track_id JOIN duplicate_groups g ON g.id = m.group_id GROUP BY m.group_id", T, M)
def jn_01(s, d):
    """Groups with their members nested, newest first."""
    m = members(s, d).join(lib(s, d, "size_bytes").withColumnRenamed("id", "track_id"), "track_id").join(table(s, d, "duplicate_groups").select(F.col("id").alias("group_id")), "group_id", "left_semi")
    nest = F.transform(F.sort_array(F.collect_list(F.struct(F.col("id"), F.col("track_id"))), False), lambda x: x["track_id"])
    return m.groupBy("group_id").agg(nest.alias("tracks"), F.sum("size_bytes").alias("bytes"))


q("jn_02", "SELECT id, path FROM t WHERE id IN (SELECT id FROM (SELECT id, regexp_split_to_array(lower(concat_ws(' ', title, artist, album, albumartist)), '[^\\p{L}\\p{N}]+') AS bag FROM t) WHERE list_contains(bag, 'of') AND len(list_filter(bag, lambda x: starts_with(x, 'si'))) > 0)", T)(lambda s, d: lib(s, d, "path").join(search(lib(s, d, "title", "artist", "album", "albumartist"), "of si").select("id"), "id", "left_semi"))
q("jn_03", "SELECT DISTINCT lower(trim(title)) AS title FROM candidates WHERE trim(title) <> '' AND lower(trim(title)) NOT IN (SELECT lower(trim(title)) FROM tracks WHERE title IS NOT NULL)")(
    lambda s, d: table(s, d, "candidates").select(F.lower(F.trim("title")).alias("title")).where("title <> ''").distinct().join(table(s, d, "tracks").select(F.lower(F.trim("title")).alias("title")), "title", "left_anti"))


@q("jn_04", "WITH w AS (SELECT DISTINCT translate(lower(album), 'ς', 'σ') AS album, unnest(range(1, total_tracks + 1)) AS track_no FROM candidates WHERE album IS NOT NULL AND total_tracks BETWEEN 1 AND 99) SELECT album, CAST(track_no AS BIGINT) AS track_no FROM w WHERE (album, track_no) NOT IN (SELECT (translate(lower(album), 'ς', 'σ'), track_no) FROM tracks WHERE album IS NOT NULL AND track_no IS NOT NULL)")
def jn_04(s, d):
    """Track numbers of a release that the library lacks."""
    want = table(s, d, "candidates").where("album is not null and total_tracks between 1 and 99").select(lower("album").alias("album"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total_tracks"))).alias("track_no")).distinct()
    return want.join(table(s, d, "tracks").select(lower("album").alias("album"), "track_no"), ["album", "track_no"], "left_anti")


_SNAP = """i AS (SELECT path, arg_max(size_bytes, id) AS size_bytes, arg_max(mtime, id) AS mtime, arg_max(struct_pack(x := sha256), id).x AS sha256, arg_max(status, id) AS status FROM t GROUP BY path),
n AS (SELECT path FROM t GROUP BY path HAVING count(*) = 1),
s AS (SELECT CASE WHEN id % 13 = 0 THEN path || '.new' ELSE path END AS path, CASE WHEN id % 5 = 0 THEN size_bytes + 1 WHEN id % 17 = 0 THEN 100 ELSE size_bytes END AS size_bytes, mtime FROM t SEMI JOIN n USING (path) WHERE id % 7 <> 0),
ch AS (SELECT path, CASE WHEN s.size_bytes IS NULL THEN CASE WHEN status = 'active' THEN 'missing' END WHEN i.size_bytes = s.size_bytes AND abs(i.mtime - s.mtime) < 1 AND sha256 IS NOT NULL THEN 'unchanged' WHEN s.size_bytes < 32768 THEN 'corrupt' WHEN i.size_bytes IS NULL THEN 'added' ELSE 'updated' END AS change FROM s FULL JOIN (SELECT i.* FROM i SEMI JOIN n USING (path)) i USING (path))"""


def index_of(s, d):
    t = lib(s, d, "path", "size_bytes", "mtime", "sha256", "status", "acoustid")
    once = t.groupBy("path").agg(F.count("*").alias("n")).where("n = 1").select("path")
    return t.join(once, "path", "left_semi")


def disk_of(s, d):
    i = F.col("id")
    return index_of(s, d).where(i % 7 != 0).select(F.when(i % 13 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), F.when(i % 5 == 0, F.col("size_bytes") + 1).when(i % 17 == 0, F.lit(100).cast("bigint")).otherwise(F.col("size_bytes")).alias("size_bytes"), "mtime")


q("jn_05", "SELECT * FROM ch WHERE change IS NOT NULL", T, _SNAP)(lambda s, d: incremental.changes(disk_of(s, d), index_of(s, d)))
q("jn_06", "SELECT path FROM ch WHERE change = 'missing'", T, _SNAP)(lambda s, d: incremental.missing(disk_of(s, d), index_of(s, d), finished=True))
q("jn_07", "SELECT id, min(id) OVER (PARTITION BY sha256) AS root FROM t WHERE sha256 <> '' QUALIFY count(*) OVER (PARTITION BY sha256) > 1", T)(lambda s, d: dedup.equal_groups(lib(s, d, "sha256"), "sha256"))
_WORDS = "w AS (SELECT id, [CAST('0x' || substr(h, i * 8 + 1, 8) AS BIGINT) for i in range(0, CAST(len(h) // 8 AS BIGINT))] AS words FROM (SELECT id, hex(from_base64(translate(fingerprint, '-_', '+/') || repeat('=', CAST((4 - length(fingerprint) % 4) % 4 AS BIGINT)))) AS h FROM t WHERE fingerprint IS NOT NULL))"
q("jn_08", "SELECT * FROM js_g", T, _WORDS, *qs.similar_sound("js_", "t", "w"))(lambda s, d: dedup.similar_sound(lib(s, d, "fingerprint", "duration")))
q("jn_09", "SELECT * FROM jt_g", T, *qs.similar_tags("jt_", "t"))(lambda s, d: dedup.similar_tags(lib(s, d, "title", "artist", "albumartist", "duration")))


@q("jn_10", """SELECT candidate_id, arg_max(id, (round(score, 9), -id)) AS id, round(max(score), 4) AS score FROM (SELECT candidate_id, id, 0.7::DOUBLE * y.sorted + 0.3::DOUBLE * z.in_set AS score FROM ask, loc JOIN f y ON y.a = ct AND y.b = lt JOIN f z ON z.a = ca AND z.b = la) WHERE score >= 85 GROUP BY 1""", T,
   *qs.composed("n", "SELECT title AS x FROM t UNION SELECT artist FROM t UNION SELECT title FROM candidates UNION SELECT artist FROM candidates"),
   "loc AS (SELECT coalesce(y.n, '') AS lt, coalesce(z.n, '') AS la, min(id) AS id FROM t LEFT JOIN n y ON y.x = title LEFT JOIN n z ON z.x = artist WHERE coalesce(y.n, '') <> '' GROUP BY ALL)",
   "ask AS (SELECT DISTINCT candidate_id, coalesce(y.n, '') AS ct, coalesce(z.n, '') AS ca FROM candidates LEFT JOIN n y ON y.x = title LEFT JOIN n z ON z.x = artist WHERE candidate_id % 20 = 0 AND coalesce(y.n, '') <> '')",
   *qs.ratios("f", "SELECT DISTINCT ct AS a, lt AS b FROM ask, loc UNION SELECT DISTINCT ca, la FROM ask, loc"))
def jn_10(s, d):
    """The best local track of each catalogue entry asked about (those whose id is divisible by 20), all tracks compared."""
    n = text.normalised
    rows = lib(s, d, "title", "artist").select("id", n(F.col("title")).alias("title"), n(F.col("artist")).alias("artist")).where("title <> ''")
    asked = candidates(s, d).where("candidate_id % 20 = 0").select(F.col("candidate_id").alias("query_id"), n(F.col("title")).alias("title"), n(F.col("artist")).alias("artist")).where("title <> ''")
    return best_matches(asked, rows).withColumnRenamed("query_id", "candidate_id")


q("jn_11", "SELECT t.id, CASE WHEN b.confidence >= 0.6 THEN b.candidate_id END AS candidate_id FROM t LEFT JOIN b ON b.k = lower(t.title)", T, "b AS (SELECT lower(title) AS k, max(coalesce(confidence, 0)) AS confidence, arg_max(candidate_id, (coalesce(confidence, 0), -candidate_id)) AS candidate_id FROM candidates GROUP BY lower(title))")(
    lambda s, d: lib(s, d, "title").select("id", F.lower("title").alias("k")).join(table(s, d, "candidates").groupBy(F.lower("title").alias("k")).agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.max_by("candidate_id", F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("candidate_id"))).alias("c")), "k", "left").select("id", F.when(F.col("confidence") >= 0.6, F.col("c")).alias("candidate_id")))


@q("jn_12", "SELECT g.group_id FROM s g WHERE NOT EXISTS (SELECT 1 FROM s r JOIN duplicate_groups x ON x.id = r.group_id AND x.resolved WHERE r.tracks = g.tracks AND r.group_id <> g.group_id)", M, "s AS (SELECT group_id, list_sort(list(DISTINCT track_id)) AS tracks FROM m WHERE group_id IS NOT NULL AND track_id IS NOT NULL GROUP BY group_id)")
def jn_12(s, d):
    """Groups whose very members were not settled before in another group."""
    g = members(s, d)
    return decision.not_settled(g, g.join(table(s, d, "duplicate_groups").where("resolved").select(F.col("id").alias("group_id")), "group_id", "left_semi"))


q("jn_13", "SELECT id FROM q WHERE original_path NOT IN (SELECT path FROM tracks)", Q)(lambda s, d: quarantine(s, d).join(table(s, d, "tracks").select(F.col("path").alias("original_path")), "original_path", "left_anti").select("id"))
q("jn_14", "SELECT t.id, CASE WHEN bool_or(coalesce(q.restored, false)) THEN 'active' ELSE any_value(t.status) END AS status FROM t LEFT JOIN q ON q.original_path = t.path GROUP BY t.id", T, Q)(
    lambda s, d: lib(s, d, "path", "status").join(quarantine(s, d).where("restored").select(F.col("original_path").alias("path"), F.lit(True).alias("back")).distinct(), "path", "left").select("id", F.when(F.col("back"), "active").otherwise(F.col("status")).alias("status")))
q("jn_15", "SELECT id FROM duplicate_groups WHERE id IN (SELECT group_id FROM quarantine)")(lambda s, d: table(s, d, "duplicate_groups").select("id").join(table(s, d, "quarantine").select(F.col("group_id").alias("id")), "id", "left_semi"))
q("jn_16", "SELECT t.id, coalesce(nullif(t.apple_id, ''), CAST(b.c AS VARCHAR)) AS ref FROM t LEFT JOIN (SELECT lower(title) AS k, min(candidate_id) AS c FROM candidates GROUP BY 1) b ON b.k = lower(t.title)", T)(
    lambda s, d: lib(s, d, "apple_id", "title").withColumn("k", F.lower("title")).join(table(s, d, "candidates").groupBy(F.lower("title").alias("k")).agg(F.min("candidate_id").alias("c")), "k", "left").select("id", F.coalesce(F.nullif("apple_id", F.lit("")), F.col("c").cast("string")).alias("ref")))

# ---------------------------------------------------------------- aggregates
_N = lambda c: F.count_if(c)
q("agg_01", "SELECT count(*) AS tracks, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes, coalesce(CAST(sum(CAST(round(duration * 1000) AS BIGINT)) AS DOUBLE), 0) / 1000 AS seconds, count(DISTINCT artist) AS artists, count(DISTINCT album) AS albums, count_if(lossless) AS lossless, count_if(has_artwork) AS artwork, count_if(has_lyrics) AS lyrics FROM t WHERE status = 'active'", T)(
    lambda s, d: lib(s, d, "status", "size_bytes", "duration", "artist", "album", "lossless", "has_artwork", "has_lyrics").where("status = 'active'").agg(F.count("*").alias("tracks"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), (F.coalesce(F.sum(F.round(F.col("duration") * 1000).cast("bigint")).cast("double"), F.lit(0.0)) / 1000).alias("seconds"), F.count_distinct("artist").alias("artists"), F.count_distinct("album").alias("albums"), _N(F.col("lossless")).alias("lossless"), _N(F.col("has_artwork")).alias("artwork"), _N(F.col("has_lyrics")).alias("lyrics")))
q("agg_02", "SELECT o_orderpriority AS kind, o_orderstatus AS state, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, kind, state")(lambda s, d: table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "state"))
q("agg_03", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, action LIMIT 20")(lambda s, d: table(s, d, "events").groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "action").limit(20))


def daily_filled(e: DataFrame, first: str, last: str) -> DataFrame:
    """(day, n) for every day of a period, days without events included."""
    n = e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = e.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


_DAYS = "dd AS (SELECT CAST(x AS DATE) AS day FROM unnest(generate_series(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY)) u(x)), dn AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)"
q("agg_04", "SELECT day, coalesce(n, 0) AS n FROM dd LEFT JOIN dn USING (day)", _DAYS)(lambda s, d: daily_filled(table(s, d, "events"), "2024-01-01", "2024-02-15"))
q("agg_05", "SELECT count(*) AS items, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM q WHERE NOT restored", Q)(lambda s, d: quarantine(s, d).where("not restored").agg(F.count("*").alias("items"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")))
q("agg_06", "SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (state = 'F') AS BIGINT) AS failed FROM (SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1)")(lambda s, d: table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("state") == "F", F.col("n"))).alias("failed")))
q("agg_07", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1")(lambda s, d: table(s, d, "events").where("ts >= timestamp_ntz '2024-01-31' - interval 7 days").groupBy("event_type").agg(F.count("*").alias("n")))
q("agg_08", "SELECT count(*) AS tracks, count_if(lossless) AS lossless, count(*) - count_if(lossless) AS lossy, round(avg(quality_score), 4) AS quality, count_if(tag_completeness < 0.85) AS incomplete FROM t WHERE status = 'active'", T)(
    lambda s, d: lib(s, d, "status", "lossless", "quality_score", "tag_completeness").where("status = 'active'").agg(F.count("*").alias("tracks"), _N(F.col("lossless")).alias("lossless"), (F.count("*") - _N(F.col("lossless"))).alias("lossy"), F.round(F.avg("quality_score"), 4).alias("quality"), _N(F.col("tag_completeness") < 0.85).alias("incomplete")))
q("agg_09", "SELECT coalesce(codec, 'unknown') AS codec, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM t GROUP BY codec", T)(lambda s, d: lib(s, d, "codec", "size_bytes").groupBy("codec").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).select(F.coalesce("codec", F.lit("unknown")).alias("codec"), "n", "bytes"))
q("agg_10", "SELECT codec, count(*) AS n, bool_or(lossless) AS lossless, codec IN ('wmav1','wmav2','wmapro','ra_144','ra_288','adpcm_ms','amr_nb') AS legacy FROM t WHERE codec IS NOT NULL GROUP BY codec", T)(lambda s, d: lib(s, d, "codec", "lossless").where("codec is not null").groupBy("codec").agg(F.count("*").alias("n"), F.bool_or("lossless").alias("lossless")).withColumn("legacy", F.col("codec").isin(*media.LEGACY_CODECS)))
q("agg_11", "SELECT albumartist, album, count(*) AS have, max(total_tracks) AS want FROM t WHERE album IS NOT NULL GROUP BY ALL HAVING max(total_tracks) IS NOT NULL AND count(*) < max(total_tracks) ORDER BY want - have DESC, albumartist NULLS FIRST, album LIMIT 50", T)(
    lambda s, d: lib(s, d, "albumartist", "album", "total_tracks").where("album is not null").groupBy("albumartist", "album").agg(F.count("*").alias("have"), F.max("total_tracks").alias("want")).where("want is not null and have < want").orderBy(F.desc(F.col("want") - F.col("have")), F.asc_nulls_first("albumartist"), "album").limit(50))
q("agg_12", "SELECT albumartist, album, count(*) AS n, max(total_tracks) AS expected, greatest(0, coalesce(max(total_tracks), count(*)) - count(*)) AS missing, CAST(sum(size_bytes) AS BIGINT) AS bytes, round(CAST(sum(CAST(round(quality_score * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000, 6) AS quality, bool_and(lossless) AS lossless, arg_min(struct_pack(y := year), id).y AS year FROM t WHERE album <> '' GROUP BY ALL", T)(
    lambda s, d: lib(s, d, "albumartist", "album", "total_tracks", "size_bytes", "quality_score", "lossless", "year").where("album <> ''").groupBy("albumartist", "album").agg(F.count("*").alias("n"), F.max("total_tracks").alias("expected"), F.greatest(F.lit(0), F.coalesce(F.max("total_tracks"), F.count("*")) - F.count("*")).alias("missing"), F.sum("size_bytes").alias("bytes"), F.round(F.sum(F.round(F.col("quality_score") * 10000).cast("bigint")).cast("double") / F.count("*") / 10000, 6).alias("quality"), F.bool_and("lossless").alias("lossless"), F.min_by(F.struct("year"), "id")["year"].alias("year")))
q("agg_13", "SELECT count(*) AS groups, CAST(sum(member_count - 1) AS BIGINT) AS extra, CAST(sum(reclaimable_bytes) AS BIGINT) AS bytes FROM duplicate_groups WHERE NOT resolved")(lambda s, d: table(s, d, "duplicate_groups").where("not resolved").agg(F.count("*").alias("groups"), F.sum(F.col("member_count") - 1).alias("extra"), F.sum("reclaimable_bytes").alias("bytes")))
_SHOWN = ("track_id", "path", "score", "action")
_BEST_FIRST = ", ".join(f"list({c} ORDER BY coalesce(score, -1) DESC, track_id) AS {c}s" for c in _SHOWN)


def _taken(c: str):
    return lambda z: z[c]


@q("agg_14", f"SELECT kind, groups, bytes, group_id, {', '.join(c + 's' for c in _SHOWN)} FROM (SELECT kind, count(*) OVER (PARTITION BY kind) AS groups, CAST(sum(reclaimable_bytes) OVER (PARTITION BY kind) AS BIGINT) AS bytes, id AS group_id, row_number() OVER (PARTITION BY kind ORDER BY reclaimable_bytes DESC NULLS LAST, id) AS r FROM duplicate_groups WHERE NOT resolved) LEFT JOIN (SELECT group_id, {_BEST_FIRST} FROM (SELECT m.group_id, m.track_id, path, action, round(score, 4) AS score FROM (SELECT group_id, track_id, arg_max(struct_pack(x := proposed_action), id).x AS action, arg_max(struct_pack(x := score), id).x AS score FROM duplicate_members GROUP BY ALL) m JOIN t ON t.id = m.track_id) GROUP BY 1) USING (group_id) WHERE r <= 5", T)
def agg_14(s, d):
    """The dry-run report of unresolved groups: totals per kind, and of the five groups of a kind that free the most their members, best score first."""
    g = table(s, d, "duplicate_groups").where("not resolved").select("kind", F.col("id").alias("group_id"), "reclaimable_bytes")
    totals = g.groupBy("kind").agg(F.count("*").alias("groups"), F.sum("reclaimable_bytes").alias("bytes"))
    top = g.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy(F.desc_nulls_last("reclaimable_bytes"), "group_id"))).where("r <= 5").drop("r", "reclaimable_bytes")
    m = table(s, d, "duplicate_members").join(top.select("group_id"), "group_id", "left_semi").groupBy("group_id", "track_id").agg(F.max_by(F.struct("proposed_action", "score"), "id").alias("x"))
    m = m.join(lib(s, d, "path").withColumnRenamed("id", "track_id"), "track_id").withColumn("score", F.round("x.score", 4))
    entry = F.struct((-F.coalesce("score", F.lit(-1.0))).alias("o"), "track_id", "path", "score", F.col("x.proposed_action").alias("action"))
    nested = m.groupBy("group_id").agg(F.array_sort(F.collect_list(entry)).alias("e")).select("group_id", *[F.transform("e", _taken(c)).alias(c + "s") for c in _SHOWN])
    return totals.join(top, "kind").join(nested, "group_id", "left").select("kind", "groups", "bytes", "group_id", *[c + "s" for c in _SHOWN])


q("agg_15", "SELECT CAST(sum(greatest(0, len(track_ids) - 1)) AS BIGINT) AS duplicate_files FROM clusters")(lambda s, d: table(s, d, "clusters").agg(F.sum(F.greatest(F.lit(0), F.size("track_ids") - 1)).alias("duplicate_files")))
q("agg_16", "SELECT category, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM c WHERE category IS NOT NULL GROUP BY 1", T, _FILES)(lambda s, d: made_files(s, d).select(cleanup.file_category().alias("category"), "size_bytes").where("category is not null").groupBy("category").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")))
q("agg_17", "SELECT count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, min(moved_at) AS oldest FROM q WHERE NOT restored", Q)(lambda s, d: quarantine(s, d).where("not restored").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.min("moved_at").alias("oldest")))
q("agg_18", "SELECT source, count(*) AS n FROM candidates GROUP BY source")(lambda s, d: table(s, d, "candidates").groupBy("source").agg(F.count("*").alias("n")))
q("agg_20", "SELECT count_if(change = 'added') AS added, count_if(change = 'updated') AS updated, count_if(change = 'unchanged') AS unchanged, count_if(change = 'missing') AS missing, count_if(change = 'corrupt') AS corrupt FROM ch", T, _SNAP)(lambda s, d: incremental.changes(disk_of(s, d), index_of(s, d)).agg(*[_N(F.col("change") == c).alias(c) for c in ("added", "updated", "unchanged", "missing", "corrupt")]))
@q("agg_21", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN 2 WHEN 2 THEN NULL ELSE NULL END::BIGINT AS succeeded, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN k ELSE NULL END::BIGINT AS failed FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def agg_21(s, d):
    """What came out of a job: the first whole number or list among the names it may report under; booleans and texts don't count."""
    k = F.get_json_object("props", "$.k")
    result = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"succeeded": true, "converted": "7", "added": '), k, F.lit(', "errors": 3}'))).when(F.col("event_id") % 4 == 1, F.lit('{"restored": ["a", "b"], "failed": []}')).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"errors": '), k, F.lit("}"))).otherwise("{}")
    return table(s, d, "events").select("event_id", jobs.outcome(result).alias("o")).select("event_id", "o.*")


@q("agg_22", "SELECT CAST(count_if(ok) AS BIGINT) AS converted, CAST(count_if(NOT ok) AS BIGINT) AS failed, CAST(sum(CASE WHEN ok THEN greatest(0, size_bytes - dst) ELSE 0 END) AS BIGINT) AS saved_bytes FROM (SELECT size_bytes, coalesce(bitrate > 0 AND duration > 0, false) AS ok, CAST(trunc(coalesce(duration, 0) * 32000) AS BIGINT) AS dst FROM t WHERE lossless)", T)
def agg_22(s, d):
    """Totals of a conversion of all lossless files to 256 kbit/s; files without length or bitrate fail."""
    ok = F.coalesce((F.col("bitrate") > 0) & (F.col("duration") > 0), F.lit(False))
    results = lib(s, d, "lossless", "bitrate", "size_bytes", "duration").where("lossless").select(ok.alias("ok"), F.col("size_bytes").alias("src_bytes"), (F.coalesce("duration", F.lit(0.0)) * 32000).cast("bigint").alias("dst_bytes"))
    return jobs.converted(results)


q("agg_23", "SELECT count(*) AS total FROM t WHERE status = 'active' AND year >= 2000", T)(lambda s, d: lib(s, d, "status", "year").where("status = 'active' and year >= 2000").agg(F.count("*").alias("total")))
q("agg_24", "SELECT count(apple_id) AS matched FROM t", T)(lambda s, d: lib(s, d, "apple_id").agg(F.count("apple_id").alias("matched")))
q("agg_25", "SELECT round(100.0 * count_if(has_artwork) / nullif(count(*), 0), 2) AS artwork_share, round(100.0 * count_if(lossless) / nullif(count(*), 0), 2) AS lossless_share FROM t", T)(lambda s, d: lib(s, d, "has_artwork", "lossless").agg(*[F.round(F.try_divide(100.0 * _N(F.col(c)), F.count("*")), 2).alias(n) for c, n in (("has_artwork", "artwork_share"), ("lossless", "lossless_share"))]))
q("agg_26", "SELECT folder, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (SELECT size_bytes, unnest([array_to_string(p[1:k], '/') for k in range(1, len(p))]) AS folder FROM (SELECT size_bytes, string_split(path, '/') AS p FROM t)) GROUP BY folder", T)(lambda s, d: lib(s, d, "path", "size_bytes").select("size_bytes", F.explode(cleanup.ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(F.sum("size_bytes").alias("bytes")))
q("agg_27", "SELECT day, greatest(2.0, round(100.0 * coalesce(n, 0) / max(n) OVER (), 4)) AS height FROM dd LEFT JOIN dn USING (day)", _DAYS)(
    lambda s, d: (lambda x: x.withColumn("one", F.lit(1)).join(x.agg(F.max("n").alias("peak")).withColumn("one", F.lit(1)), "one").select("day", F.greatest(F.lit(2.0), F.round(100.0 * F.col("n") / F.col("peak"), 4)).alias("height")))(daily_filled(table(s, d, "events"), "2024-01-01", "2024-02-15")))
q("agg_28", "SELECT count(*) AS n, CAST(sum(t.size_bytes) AS BIGINT) AS bytes FROM m JOIN t ON t.id = m.track_id WHERE m.proposed_action = 'quarantine'", T, M)(lambda s, d: members(s, d).where("proposed_action = 'quarantine'").join(lib(s, d, "size_bytes").withColumnRenamed("id", "track_id"), "track_id").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")))


# ---------------------------------------------------------------- windows, ranking, verdicts
def group_members(s, d):
    """Valid members of the duplicate groups with what their scoring reads."""
    t = lib(s, d, *decision.COLUMNS).withColumnRenamed("id", "track_id")
    return members(s, d).select("group_id", "track_id").where("group_id is not null").join(t, "track_id")


_RANK = "CASE lower(coalesce(codec, '')) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in media.FORMAT_RANK.items()) + " ELSE 0.40::DOUBLE END"
_RES = "round(0.6::DOUBLE * CASE WHEN sample_rate >= 176400 THEN 1.0 WHEN sample_rate >= 88200 THEN 0.9 WHEN sample_rate >= 44100 THEN 0.75 WHEN sample_rate >= 32000 THEN 0.45 WHEN sample_rate > 0 THEN 0.2 ELSE 0 END::DOUBLE + 0.4::DOUBLE * CASE coalesce(nullif(bit_depth, 0), 16) WHEN 8 THEN 0.2 WHEN 24 THEN 1.0 WHEN 32 THEN 1.0 ELSE 0.7 END::DOUBLE, 4)"
_TAGS = "round(CASE WHEN coalesce(mb_recording_id, '') <> '' THEN least(1.0, tag_completeness + 0.08::DOUBLE) ELSE tag_completeness END, 4)"
_ART = "CASE WHEN NOT has_artwork THEN 0.0 WHEN artwork_px >= 1400 THEN 1.0 WHEN artwork_px >= 1000 THEN 0.9 WHEN artwork_px >= 600 THEN 0.75 WHEN artwork_px >= 300 THEN 0.5 ELSE 0.35 END::DOUBLE"
_LYR = "CASE WHEN has_synced_lyrics THEN 1.0 WHEN has_lyrics THEN 0.6 ELSE 0.0 END::DOUBLE"
_PATHS = "round(greatest(0.0, 1.0::DOUBLE - (" + " + ".join(f"CASE WHEN contains(lower(path), '{x}') THEN 0.25 ELSE 0 END" for x in media.BAD_PATH) + " + " + " + ".join(f"CASE WHEN contains(lower(string_split(path, '/')[-1]), '{x}') THEN 0.30 ELSE 0 END" for x in media.BAD_NAME) + ")::DOUBLE - CASE WHEN len(string_split(path, '/')) > 9 THEN 0.10 ELSE 0 END::DOUBLE), 4)"
_BIT = "CASE WHEN lossless THEN 1.0 WHEN coalesce(bitrate, 0) <= 0 THEN 0.0 ELSE round(0.6::DOUBLE * least(bitrate / 320000, 1.0) + 0.4::DOUBLE * CASE WHEN best > 0 THEN bitrate / best ELSE 1.0 END, 4) END::DOUBLE"
_DUR = "CASE WHEN coalesce(longest, 0) <= 0 OR coalesce(duration, 0) = 0 THEN 0.5 WHEN duration / longest >= 0.98 THEN 1.0 WHEN duration / longest >= 0.95 THEN 0.8 ELSE round(duration / longest * 0.7::DOUBLE, 4) END::DOUBLE"
_SCORED = f"""g0 AS (SELECT m.group_id, m.track_id, t.* EXCLUDE (id) FROM m JOIN t ON t.id = m.track_id WHERE m.group_id IS NOT NULL),
g1 AS (SELECT *, max(CASE WHEN NOT lossless THEN coalesce(bitrate, 0) END) OVER (PARTITION BY group_id) AS best, max(duration) OVER (PARTITION BY group_id) AS longest FROM g0),
g2 AS (SELECT *, {_RANK} AS s_format, {_BIT} AS s_bitrate, {_RES} AS s_resolution, {_TAGS} AS s_tags, {_ART} AS s_artwork, {_LYR} AS s_lyrics, {_DUR} AS s_duration, {_PATHS} AS s_path FROM g1),
sc AS (SELECT *, round(({" + ".join(f"s_{k} * {w}::DOUBLE" for k, w in media.WEIGHTS.items())}) / {sum(media.WEIGHTS.values())!r}::DOUBLE, 5) AS score FROM g2)"""
_S = [f"s_{k}" for k in media.WEIGHTS]
q("win_01", f"SELECT group_id, track_id, {', '.join(_S)}, score FROM sc", T, M, _SCORED)(lambda s, d: decision.scored(group_members(s, d)).select("group_id", "track_id", *_S, "score"))
q("win_03", "SELECT group_id, track_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY score DESC, size_bytes DESC, first_seen, track_id) AS INT) AS rank FROM sc", T, M, _SCORED)(lambda s, d: decision.ranked(decision.scored(group_members(s, d))).select("group_id", "track_id", "rank"))


def group_verdicts(s, d):
    return decision.verdicts(group_members(s, d), table(s, d, "duplicate_groups").select(F.col("id").alias("group_id"), "confidence"))


_VERDICT = """rk AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, size_bytes DESC, first_seen, track_id) AS rn, count(*) OVER (PARTITION BY group_id) AS cnt FROM sc),
mg AS (SELECT group_id, round(max(score) FILTER (rn = 1) - max(score) FILTER (rn > 1), 5) AS margin, CAST(sum(size_bytes) - max(size_bytes) FILTER (rn = 1) AS BIGINT) AS reclaimable_bytes FROM rk WHERE cnt > 1 GROUP BY 1),
vd AS (SELECT rk.group_id, track_id, margin, margin < 0.03 AS ambiguous, mg.reclaimable_bytes, CASE WHEN rn = 1 THEN 'keep' WHEN margin >= 0.03 AND coalesce(dg.confidence, 0) >= 0.90 THEN 'quarantine' ELSE 'skip' END AS action FROM rk JOIN mg USING (group_id) LEFT JOIN duplicate_groups dg ON dg.id = rk.group_id)"""
q("win_04", "SELECT DISTINCT group_id, margin, ambiguous FROM vd", T, M, _SCORED, _VERDICT)(lambda s, d: group_verdicts(s, d).select("group_id", "margin", "ambiguous").distinct())
q("win_05", "SELECT group_id, track_id, action FROM vd", T, M, _SCORED, _VERDICT)(lambda s, d: group_verdicts(s, d).select("group_id", "track_id", "action"))
q("win_12", "SELECT DISTINCT group_id, reclaimable_bytes FROM vd", T, M, _SCORED, _VERDICT)(lambda s, d: group_verdicts(s, d).select("group_id", "reclaimable_bytes").distinct())
_LACKS = "[" + ", ".join(f"{{g: -round(w.s_{k} - l.s_{k}, 6), i: {i}, t: '{decision.LACKS[k]}'}}" for i, k in enumerate(decision.CRITERIA)) + "]"
q("win_09", f"""SELECT group_id, track_id, CASE WHEN x = '' THEN 'Equivalent copy -- kept the higher-ranked one' ELSE x END AS reason FROM (SELECT l.group_id, l.track_id,
  array_to_string(list_transform(list_sort(list_filter({_LACKS}, lambda z: z.g < -0.05))[1:2], lambda z: z.t), '; ') AS x FROM rk l JOIN rk w ON w.group_id = l.group_id AND w.rn = 1 WHERE l.rn > 1)""", T, M, _SCORED, _VERDICT)(lambda s, d: group_verdicts(s, d).where("action <> 'keep'").select("group_id", "track_id", "reason"))
q("win_14", """SELECT group_id, track_id, CASE WHEN bits <> '' THEN 'Best copy: ' || bits ELSE 'Highest score in cluster' END AS reason FROM (SELECT group_id, track_id, concat_ws(', ', CASE WHEN lossless THEN 'lossless (' || coalesce(codec, 'None') || ')' WHEN bitrate > 0 THEN (bitrate // 1000) || ' kbps' END,
  CASE WHEN s_tags >= 0.8 THEN 'near-complete tags' END, CASE WHEN has_artwork AND artwork_px >= 600 THEN artwork_px || 'px artwork' END, CASE WHEN has_synced_lyrics THEN 'synced lyrics' END) AS bits FROM rk WHERE rn = 1 AND cnt > 1)""", T, M, _SCORED, _VERDICT)(lambda s, d: group_verdicts(s, d).where("action = 'keep'").select("group_id", "track_id", "reason"))

#: Trust in each source per field; users may pass another table.
TRUST = {"title": {"openrecord": 0.95, "tunefinder": 0.92, "discindex": 0.80, "fanwiki": 0.70}, "artist": {"openrecord": 0.95, "tunefinder": 0.90, "discindex": 0.85, "fanwiki": 0.72}, "album": {"openrecord": 0.92, "tunefinder": 0.90, "discindex": 0.88, "fanwiki": 0.68}, "year": {"openrecord": 0.88, "tunefinder": 0.75, "discindex": 0.93, "fanwiki": 0.40}, "genre": {"openrecord": 0.70, "tunefinder": 0.85, "discindex": 0.90, "fanwiki": 0.88}}
_FIELDS = tuple(TRUST)


def answers(s, d):
    """Answers of the sources, the lower-cased title and artist standing for the entity asked about."""
    return table(s, d, "candidates").where("artist is not null").withColumn("entity_id", F.concat_ws("|", lower("title"), lower("artist"))).select("entity_id", "source", "confidence", (F.col("pos") * 1_000_000 + F.col("candidate_id")).alias("pos"), *_FIELDS).distinct()


def trust_table(s):
    return s.createDataFrame([(f, k, v) for f, x in TRUST.items() for k, v in x.items()], "field string, source string, trust double")


_ANS = "an AS (SELECT DISTINCT translate(lower(title), 'ς', 'σ') || '|' || translate(lower(artist), 'ς', 'σ') AS entity_id, source, confidence, pos * 1000000 + candidate_id AS pos, title, artist, album, year, genre FROM candidates WHERE artist IS NOT NULL)"
_VOTES = _ANS + ", tr(field, source, trust) AS (VALUES " + ", ".join(f"('{f}', '{k}', {v}::DOUBLE)" for f, x in TRUST.items() for k, v in x.items()) + """),
bs AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY entity_id, source ORDER BY confidence DESC NULLS LAST, pos) = 1),
lo AS (UNPIVOT (SELECT entity_id, source, confidence, pos, title, artist, album, CAST(year AS VARCHAR) AS year, genre FROM bs) ON title, artist, album, year, genre INTO NAME field VALUE value),
vo AS (SELECT entity_id, field, source, pos, value, round(coalesce(trust, 0.30) * coalesce(confidence, 0.5), 5) AS weight FROM lo LEFT JOIN tr USING (field, source) WHERE value NOT IN ('', '0')),
wn AS (SELECT entity_id, field, arg_max(value, (weight, -pos)) AS value, arg_max(source, (weight, -pos)) AS source, max(weight) AS weight, count(DISTINCT lower(trim(value))) > 1 AS conflict FROM vo GROUP BY ALL)"""


def votes(s, d):
    return fusion.ballots(fusion.best_per_source(answers(s, d)), _FIELDS, trust_table(s))


def _voted():
    """The fields that count for an entity's confidence."""
    return F.col("field").isin("title", "artist", "album", "year")


q("win_06", "SELECT entity_id, source, pos, confidence FROM bs", _VOTES)(lambda s, d: fusion.best_per_source(answers(s, d)).select("entity_id", "source", "pos", "confidence"))
q("win_07", "SELECT * FROM wn", _VOTES)(lambda s, d: fusion.winners(votes(s, d)))
q("win_08", "SELECT entity_id, field FROM wn WHERE conflict", _VOTES)(lambda s, d: fusion.winners(votes(s, d)).where("conflict").select("entity_id", "field"))
q("agg_19", "SELECT entity_id, round(CAST(sum(CAST(round(weight * 100000) AS BIGINT)) FILTER (field IN ('title', 'artist', 'album', 'year')) AS DOUBLE) / count(*) FILTER (field IN ('title', 'artist', 'album', 'year')) / 100000, 7) AS confidence FROM wn GROUP BY 1", _VOTES)(lambda s, d: fusion.winners(votes(s, d)).groupBy("entity_id").agg(F.round(F.sum(F.when(_voted(), F.round(F.col("weight") * 100000).cast("bigint"))).cast("double") / F.count_if(_voted()) / 100000, 7).alias("confidence")))
q("win_13", "SELECT DISTINCT candidate_id, year, CASE WHEN year IS NULL OR regexp_extract(release_date, '(\\d{4})', 1) = CAST(year AS VARCHAR) THEN release_date END AS release_date FROM candidates")(lambda s, d: table(s, d, "candidates").select("candidate_id", "year", F.when(F.col("year").isNull() | (F.regexp_extract("release_date", r"(\d{4})", 1) == F.col("year").cast("string")), F.col("release_date")).alias("release_date")).distinct())
q("set_06", "SELECT id, CASE WHEN c.genre IS NULL OR c.genre = '' THEN t.genre WHEN t.genre IS NULL OR t.genre = '' OR c.confidence >= 0.8 THEN c.genre ELSE t.genre END AS genre FROM t JOIN (SELECT title, arg_max(struct_pack(g := genre), (confidence, candidate_id)).g AS genre, max(confidence) AS confidence FROM candidates WHERE confidence IS NOT NULL GROUP BY title) c USING (title)", T)(
    lambda s, d: lib(s, d, "title", "genre").join(table(s, d, "candidates").where("confidence is not null").groupBy("title").agg(F.max_by(F.struct("genre"), F.struct("confidence", "candidate_id"))["genre"].alias("new"), F.max("confidence").alias("w")), "title").select("id", fusion.overwrite(F.col("genre"), F.col("new"), F.col("w"), True).alias("genre")))

# ---------------------------------------------------------------- sorting, sets, graphs
q("srt_01", "SELECT id, title, quality_score FROM t WHERE status = 'active' ORDER BY quality_score DESC NULLS LAST, id LIMIT 100 OFFSET 50", T)(lambda s, d: lib(s, d, "title", "quality_score", "status").where("status = 'active'").select("id", "title", "quality_score").orderBy(F.desc_nulls_last("quality_score"), "id").offset(50).limit(100))
q("srt_02", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")(lambda s, d: table(s, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20))
q("srt_03", "SELECT id, reclaimable_bytes FROM duplicate_groups ORDER BY reclaimable_bytes DESC NULLS LAST, id LIMIT 50")(lambda s, d: table(s, d, "duplicate_groups").select("id", "reclaimable_bytes").orderBy(F.desc_nulls_last("reclaimable_bytes"), "id").limit(50))
q("srt_04", "SELECT id, tag_completeness FROM t ORDER BY tag_completeness NULLS FIRST, id LIMIT 200", T)(lambda s, d: lib(s, d, "tag_completeness").orderBy(F.asc_nulls_first("tag_completeness"), "id").limit(200))
q("srt_05", "SELECT group_id, list(track_id ORDER BY score DESC, track_id) AS tracks FROM sc GROUP BY 1", T, M, _SCORED)(lambda s, d: decision.scored(group_members(s, d)).groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "track_id"))), lambda x: x["track_id"]).alias("tracks")))
q("srt_06", "SELECT DISTINCT filename FROM t ORDER BY lower(filename), filename LIMIT 500", T)(lambda s, d: lib(s, d, "filename").select("filename").distinct().orderBy(F.lower("filename"), "filename").limit(500))
q("srt_07", "SELECT id, duration FROM t WHERE duration > 0 ORDER BY round(abs(duration - 200), 6), id LIMIT 10", T)(lambda s, d: lib(s, d, "duration").where("duration > 0").orderBy(F.round(F.abs(F.col("duration") - 200), 6), "id").limit(10))
q("srt_08", "SELECT albumartist, arg_min(id, (coalesce(nullif(year, 0), 9999), coalesce(disc_no, 1), coalesce(track_no, 99), id)) AS earliest FROM t WHERE albumartist IS NOT NULL GROUP BY 1", T)(lambda s, d: lib(s, d, "albumartist", "year", "disc_no", "track_no").where("albumartist is not null").groupBy("albumartist").agg(F.min_by("id", F.struct(F.coalesce(F.nullif("year", F.lit(0)), F.lit(9999)), F.coalesce("disc_no", F.lit(1)), F.coalesce("track_no", F.lit(99)), F.col("id"))).alias("earliest")))

EXACT = dedup.LAYERS[:3]
_LAYER = "tk AS (SELECT * FROM t WHERE status = 'active')"


def _layer_sql(n: int, source: str, column: str, kind: str, confidence: float) -> str:
    return f"l{n} AS (SELECT '{kind}' AS kind, {confidence}::DOUBLE AS confidence, min(id) OVER (PARTITION BY {column}) AS root, id FROM {source} WHERE {column} <> '' QUALIFY count(*) OVER (PARTITION BY {column}) > 1), r{n} AS (SELECT * FROM {source} WHERE id NOT IN (SELECT id FROM l{n}))"


_LAYERS = (_LAYER, _layer_sql(1, "tk", "sha256", "exact_file", 1.0), _layer_sql(2, "r1", "audio_md5", "exact_audio", 0.99), _layer_sql(3, "r2", "acoustid", "acoustic", 0.97))
_LT = ("sha256", "audio_md5", "acoustid", "fingerprint", "duration", "title", "artist", "albumartist", "size_bytes", "status")


def active(s, d):
    return lib(s, d, *_LT).where("status = 'active'")


q("set_01", "SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3", T, *_LAYERS)(lambda s, d: dedup.layered(active(s, d), EXACT))
_ALL = (T, *_LAYERS, _WORDS, *qs.similar_sound("ds_", "r3", "w"), "r4 AS (SELECT * FROM r3 WHERE id NOT IN (SELECT id FROM ds_g))", *qs.similar_tags("dt_", "r4"),
        "al AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT 'acoustic', 0.92::DOUBLE, root, id FROM ds_g UNION ALL SELECT 'metadata', 0.80::DOUBLE, root, id FROM dt_g)")
q("dedup_layers", "SELECT * FROM al", *_ALL)(lambda s, d: dedup.layered(active(s, d)))
q("dedup_report", "SELECT kind, confidence, count(*) AS groups, CAST(sum(n) AS BIGINT) AS files, CAST(sum(n - 1) AS BIGINT) AS duplicate_files, CAST(sum(b) AS BIGINT) AS reclaimable_bytes FROM (SELECT kind, confidence, root, count(*) AS n, sum(size_bytes) - max(size_bytes) AS b FROM al JOIN tk USING (id) GROUP BY ALL) GROUP BY ALL", *_ALL)(lambda s, d: dedup.report(dedup.layered(active(s, d)), active(s, d)))
q("dedup_exact_report", """, g AS (SELECT kind, confidence, root, count(*) AS n, sum(size_bytes) - max(size_bytes) AS b FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) JOIN tk USING (id) GROUP BY ALL)
SELECT kind, confidence, count(*) AS groups, CAST(sum(n) AS BIGINT) AS files, CAST(sum(n - 1) AS BIGINT) AS duplicate_files, CAST(sum(b) AS BIGINT) AS reclaimable_bytes FROM g GROUP BY ALL""", T, *_LAYERS)(lambda s, d: dedup.report(dedup.layered(active(s, d), EXACT), active(s, d)))
q("set_02", "SELECT list_sort(list_distinct(list_filter(track_ids, lambda x: x IS NOT NULL))) AS ids, min(cluster_id) AS first_cluster FROM clusters WHERE track_ids IS NOT NULL GROUP BY 1")(lambda s, d: table(s, d, "clusters").where("track_ids is not null").groupBy(F.array_sort(F.array_distinct(F.array_compact("track_ids"))).alias("ids")).agg(F.min("cluster_id").alias("first_cluster")))
q("set_03", "SELECT title, 'library' AS origin FROM t WHERE title IS NOT NULL UNION ALL SELECT title, source FROM (SELECT DISTINCT * FROM candidates)", T)(lambda s, d: lib(s, d, "title").where("title is not null").select("title", F.lit("library").alias("origin")).unionByName(candidates(s, d).select("title", F.col("source").alias("origin"))))
q("set_04", "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view')")(lambda s, d: table(s, d, "events").select("event_type").distinct().exceptAll(s.createDataFrame([("click",), ("view",)], "event_type string")))
q("set_05", "SELECT id, coalesce(nullif(artist, ''), nullif(albumartist, '')) AS artist, coalesce(nullif(albumartist, ''), nullif(artist, '')) AS albumartist FROM t", T)(lambda s, d: lib(s, d, "artist", "albumartist").select("id", F.coalesce(F.nullif("artist", F.lit("")), F.nullif("albumartist", F.lit(""))).alias("artist"), F.coalesce(F.nullif("albumartist", F.lit("")), F.nullif("artist", F.lit(""))).alias("albumartist")))


#: Fields whose changes are reported, and those that are numbers (fixed values).
DIFFED = ("title", "artist", "albumartist", "album", "genre", "isrc", "acoustid", "mb_recording_id", "mb_release_id", "apple_id", "year", "track_no", "disc_no", "total_tracks", "artwork_px")
COUNTED = DIFFED[10:]


@q("set_07", "SELECT id, x.f AS field, x.o AS old, x.n AS new FROM (SELECT id, unnest([" + ", ".join(f"{{f: '{c}', o: CAST({c} AS VARCHAR), n: " + (f"CAST(nullif({c}, 0) AS VARCHAR)}}" if c in COUNTED else f"nullif(trim({c}, ' '), '')}}") for c in DIFFED) + "]) AS x FROM t) WHERE x.o IS DISTINCT FROM x.n", T)
def set_07(s, d):
    """What a cleaning of blanks would change in fifteen fields, one row for each change, null-safe."""
    row = lambda f, o, n: F.struct(F.lit(f).alias("field"), o.cast("string").alias("old"), n.cast("string").alias("new"))
    clean = lambda c: F.nullif(c, F.lit(0)) if c in COUNTED else F.nullif(F.trim(c), F.lit(""))
    x = lib(s, d, *DIFFED).select("id", F.explode(F.array(*[row(c, F.col(c), clean(c)) for c in DIFFED])).alias("x"))
    return x.select("id", "x.*").where("not (old <=> new)")


@q("gr_01", """SELECT x AS node, root FROM r""", """e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT track_ids[1] AS a, unnest(track_ids[2:]) AS b FROM clusters) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)""", "b AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e)",
   """r(x, root) USING KEY (x) AS (SELECT x, min(x) FROM b GROUP BY x UNION SELECT b.y, min(r.root) FROM r JOIN b ON b.x = r.x JOIN recurring.r AS c ON c.x = b.y WHERE r.root < c.root GROUP BY b.y)""")
def gr_01(s, d):
    c = table(s, d, "clusters")
    e = c.select(F.get("track_ids", F.lit(0)).alias("u"), F.explode(F.slice("track_ids", 2, 1_000_000_000)).alias("v"))
    return star_components(e)


_CHAIN = "SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS path FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS k FROM {0})"


@q("gr_02", f"""SELECT path FROM fo WHERE path NOT IN (SELECT path FROM fl) AND path <> '' AND NOT starts_with(path || '/', '/lib00/incoming/') AND NOT regexp_matches(path, '/(@eaDir|#recycle|@tmp|#snapshot)(/|$)')""", T, _FILES, f"fo AS ({_CHAIN.format('f')})", "kf AS (SELECT f.path FROM f JOIN t USING (id) WHERE status = 'active' AND quality_score > 0.6 AND NOT contains(f.path, '/@eaDir/'))", f"fl AS ({_CHAIN.format('kf')})")
def gr_02(s, d):
    """Folders that would be empty if only good active files and no caches were left; what comes in is off limits."""
    files = made_files(s, d).join(lib(s, d, "status", "quality_score"), "id")
    return cleanup.empty_folders(files.select(F.explode(cleanup.ancestors(F.col("path"))).alias("path")), files.where("status = 'active' and quality_score > 0.6"), caches=True, off_limits=("/lib00/incoming",))


# ---------------------------------------------------------------- scalar functions
q("fn_01", "SELECT DISTINCT title, coalesce(n, '') AS normal FROM t LEFT JOIN n ON x = title", T, *qs.composed("n", "SELECT title AS x FROM t"))(lambda s, d: lib(s, d, "title").select("title").distinct().select("title", text.normalised(F.col("title")).alias("normal")))
q("fn_02", f"SELECT DISTINCT title, translate(regexp_replace(title, '{text.ARABIC_MARKS}', '', 'g'), '{text.ARABIC_FROM}', '{text.ARABIC_TO}') AS folded FROM t", T)(lambda s, d: lib(s, d, "title").select("title", F.translate(F.regexp_replace("title", text.ARABIC_MARKS, ""), text.ARABIC_FROM, text.ARABIC_TO).alias("folded")).distinct())
q("fn_03", "SELECT id, [h || '|' || CAST(CAST(floor(duration / 7.0) AS BIGINT) AS VARCHAR), h || '|' || CAST(CAST(floor(duration / 7.0) AS BIGINT) + 1 AS VARCHAR)] AS keys FROM (SELECT id, duration, array_to_string(string_split(y.n, ' ')[1:3], ' ') || '|' || substr(coalesce(z.n, ''), 1, 24) AS h FROM t JOIN n y ON y.x = title LEFT JOIN n z ON z.x = coalesce(nullif(artist, ''), albumartist) WHERE y.n <> '' AND duration > 0)", T, *qs.composed("n", "SELECT title AS x FROM t UNION SELECT coalesce(nullif(artist, ''), albumartist) FROM t"))(
    lambda s, d: lib(s, d, "title", "artist", "albumartist", "duration").select("id", text.normalised(F.col("title")).alias("t"), text.normalised(F.coalesce(F.nullif("artist", F.lit("")), F.col("albumartist"))).alias("a"), "duration").where("t <> '' and duration > 0").select("id", F.array(*[F.concat_ws("|", dedup.tag_block(F.col("t"), F.col("a")), (F.floor(F.col("duration") / dedup.TOLERANCE) + k).cast("string")) for k in (0, 1)]).alias("keys")))
_CANDS = "c AS (SELECT candidate_id, confidence, translate(lower(coalesce(title, '')), 'ς', 'σ') AS ti, translate(lower(coalesce(album, '')), 'ς', 'σ') AS al, translate(lower(coalesce(artist, '')), 'ς', 'σ') AS ar, translate(lower(coalesce(albumartist, '')), 'ς', 'σ') AS aa, album FROM candidates)"
q("fn_04", "SELECT candidate_id, round(sorted, 4) AS sorted_ratio, round(in_set, 4) AS set_ratio FROM c JOIN f ON a = ti AND b = al WHERE album IS NOT NULL", _CANDS, *qs.ratios("f", "SELECT ti AS a, al AS b FROM c"))(lambda s, d: table(s, d, "candidates").where("album is not null").select("candidate_id", F.round(fuzzy.ratio_column(fuzzy.token_sort_ratio)(lower("title"), lower("album")), 4).alias("sorted_ratio"), F.round(fuzzy.ratio_column(fuzzy.token_set_ratio)(lower("title"), lower("album")), 4).alias("set_ratio")))
q("fn_05", "SELECT * FROM w", T, _WORDS)(lambda s, d: lib(s, d, "fingerprint").where("fingerprint is not null").select("id", fingerprint.words(F.col("fingerprint")).alias("words")))


@q("fn_06", f"SELECT m.id, f.id AS other, round({qs.agreement('m.words', 'f.words')}, 6) AS agreement FROM m JOIN f USING (album) WHERE m.id <> f.id", T, _WORDS, "m AS (SELECT id, album, words FROM t JOIN w USING (id) WHERE album <> '')", "f AS (SELECT album, arg_min(id, id) AS id, arg_min(words, id) AS words FROM m GROUP BY album)")
def fn_06(s, d):
    """Agreement of each fingerprint with that of its album's first track, over all offsets."""
    f = lib(s, d, "fingerprint", "album").where("fingerprint is not null and album <> ''").select("id", "album", fingerprint.words(F.col("fingerprint")).alias("w"))
    first = f.groupBy("album").agg(F.min_by(F.struct(F.col("id").alias("other"), F.col("w").alias("v")), "id").alias("x")).select("album", "x.*")
    return f.join(first, "album").where("id <> other").select("id", "other", F.round(fingerprint.agreement_column()("w", "v"), 6).alias("agreement"))


q("fn_07", "SELECT id, list_transform(list_filter(range(0, 6), lambda b: b * greatest(1, len(words) // 6) + 2 <= len(words)), lambda b: CAST(b AS VARCHAR) || ':' || CAST(words[b * greatest(1, len(words) // 6) + 1] >> 24 AS VARCHAR) || ':' || CAST(words[b * greatest(1, len(words) // 6) + 2] >> 24 AS VARCHAR)) AS keys FROM w WHERE len(words) >= 2", T, _WORDS)(lambda s, d: lib(s, d, "fingerprint").select("id", fingerprint.words(F.col("fingerprint")).alias("w")).where("w is not null").select("id", fingerprint.band_keys(F.col("w")).alias("keys")))
q("fn_08", "SELECT id, round(0.55::DOUBLE * CASE WHEN lossless THEN 1.0 ELSE least(coalesce(bitrate, 0) / 320000, 1.0) END + 0.15::DOUBLE * least(coalesce(nullif(sample_rate, 0), 44100) / 96000, 1.0) + 0.10::DOUBLE * least(coalesce(nullif(bit_depth, 0), 16) / 24, 1.0) + 0.20::DOUBLE * coalesce(tag_completeness, 0), 4) AS quality FROM t", T)(lambda s, d: lib(s, d, "lossless", "bitrate", "sample_rate", "bit_depth", "tag_completeness").select("id", media.quality().alias("quality")))
q("fn_09", "SELECT id, round(least(1.0, " + " + ".join(f"CASE WHEN {c} IS NULL OR {c} = {0 if c in media.NUMERIC else chr(39) * 2} THEN 0 ELSE {w} END::DOUBLE" for c, w in media.COMPLETENESS.items()) + "), 4) AS completeness FROM t", T)(lambda s, d: lib(s, d, *media.COMPLETENESS).select("id", media.completeness().alias("completeness")))
q("fn_10", f"SELECT id, {_RANK} AS preferred, CASE WHEN lossless THEN least({_RANK}, 0.70::DOUBLE) ELSE {_RANK} END AS unbiased FROM t", T)(lambda s, d: lib(s, d, "codec", "lossless").select("id", media.format_score().alias("preferred"), media.format_score(False).alias("unbiased")))
q("fn_11", f"SELECT id, {_RES} AS resolution FROM t", T)(lambda s, d: lib(s, d, "sample_rate", "bit_depth").select("id", media.resolution_score().alias("resolution")))
q("fn_12", f"SELECT id, {_ART} AS artwork, {_LYR} AS lyrics, {_TAGS} AS tags FROM t", T)(lambda s, d: lib(s, d, "has_artwork", "artwork_px", "has_lyrics", "has_synced_lyrics", "tag_completeness", "mb_recording_id").select("id", media.artwork_score().alias("artwork"), media.lyrics_score().alias("lyrics"), media.tags_score().alias("tags")))
q("fn_13", f"SELECT id, {_PATHS} AS path_score FROM t", T)(lambda s, d: lib(s, d, "path").select("id", media.path_score().alias("path_score")))
q("fn_14", "SELECT group_id, round(CAST(sum(CAST(round(score * 100000) AS BIGINT)) AS DOUBLE) / count(*) / 100000, 7) AS mean_score FROM sc GROUP BY 1", T, M, _SCORED)(lambda s, d: decision.scored(group_members(s, d)).groupBy("group_id").agg(F.round(F.sum(F.round(F.col("score") * 100000).cast("bigint")).cast("double") / F.count("*") / 100000, 7).alias("mean_score")))
q("fn_15", "SELECT DISTINCT candidate_id, round(least(1.0, coalesce(confidence, 0.5) * (0.45::DOUBLE + 0.55::DOUBLE * y.sorted / 100) * (0.60::DOUBLE + 0.40::DOUBLE * z.in_set / 100)), 5) AS adjusted FROM c JOIN f y ON y.a = ti AND y.b = al JOIN f z ON z.a = ar AND z.b = aa", _CANDS, *qs.ratios("f", "SELECT ti AS a, al AS b FROM c UNION SELECT ar, aa FROM c"))(lambda s, d: candidates(s, d).select("candidate_id", F.round(F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)) * (0.45 + 0.55 * fuzzy.ratio_column(fuzzy.token_sort_ratio)(lower("title"), lower("album")) / 100) * (0.60 + 0.40 * fuzzy.ratio_column(fuzzy.token_set_ratio)(lower("artist"), lower("albumartist")) / 100)), 5).alias("adjusted")))
def _safe(e: str) -> str:
    """A safe path component of less than 120 characters; none here is longer."""
    bare = f"regexp_replace(regexp_replace(regexp_replace(coalesce({e}, ''), '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '^[{media.SPACES}]+|[{media.SPACES}]+$', '', 'g'), '[ .]+$', '')"
    return f"coalesce(nullif(regexp_replace({bare}, '^(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])$', '_\\1'), ''), 'Unknown')"


q("fn_17", f"SELECT id, {_safe('title')} AS safe FROM t", T)(lambda s, d: lib(s, d, "title").select("id", media.unsafe_replaced(F.col("title")).alias("safe")))
_PARTS = f"""pt AS (SELECT *, {_safe("coalesce(nullif(artist, ''), nullif(albumartist, ''), 'Unknown Artist')")} AS ar, {_safe("coalesce(nullif(albumartist, ''), nullif(artist, ''), 'Unknown Artist')")} AS aa, {_safe("coalesce(nullif(album, ''), 'Unknown Album')")} AS al,
  {_safe("coalesce(nullif(title, ''), regexp_replace(string_split(path, '/')[-1], '(.)[.][^.]*$', '\\1'))")} AS ti, coalesce(CAST(nullif(year, 0) AS VARCHAR), '0000') AS ye, CASE WHEN coalesce(track_no, 0) < 10 THEN '0' ELSE '' END || CAST(coalesce(track_no, 0) AS VARCHAR) AS tn, '.' || regexp_replace(ext, '^[.]+', '') AS ex FROM t),
wh AS (SELECT id, path, ex, CASE WHEN coalesce(album, '') = '' THEN {_safe("aa")} || '/Singles/' || {_safe("ti")} WHEN lower(trim(coalesce(albumartist, ''))) IN ('various artists', 'various', 'va') THEN 'Compilations/' || {_safe("ye || ' - ' || al")} || '/' || {_safe("tn || ' - ' || ar || ' - ' || ti")}
  ELSE {_safe("aa")} || '/' || {_safe("ye || ' - ' || al")} || '/' || {_safe("tn || ' - ' || ti")} END AS w FROM pt)"""
q("fn_18", "SELECT id, path, CASE WHEN ends_with(lower(w), lower(ex)) THEN w ELSE w || ex END AS target FROM wh", T, _PARTS)(lambda s, d: organise.targets(lib(s, d, "path", "ext", "codec", "title", "artist", "albumartist", "album", "year", "genre", "track_no", "disc_no")))
q("fn_19", "SELECT id, CASE WHEN size_bytes < 1024 THEN printf('%.2f B', size_bytes::DOUBLE) WHEN size_bytes < 1048576 THEN printf('%.2f KB', size_bytes / 1024) WHEN size_bytes < 1073741824 THEN printf('%.2f MB', size_bytes / 1048576) ELSE printf('%.2f GB', size_bytes / 1073741824) END AS size FROM t", T)(lambda s, d: lib(s, d, "size_bytes").select("id", text.human_bytes(F.col("size_bytes")).alias("size")))
q("fn_20", f"SELECT DISTINCT title, list_filter(regexp_split_to_array({qs.lowered('title')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS tokens FROM t WHERE title IS NOT NULL", T)(lambda s, d: lib(s, d, "title").where("title is not null").select("title", text.tokens(F.col("title")).alias("tokens")).distinct())
q("fn_21", "SELECT DISTINCT candidate_id, CASE WHEN y BETWEEN 1860 AND 2200 THEN y END AS year, CAST(nullif(regexp_extract(length_text, '^\\s*(\\d+)', 1), '') AS BIGINT) AS number, track_no AS part, total_tracks AS total FROM (SELECT *, CAST(nullif(regexp_extract(release_date, '(\\d{4})', 1), '') AS INT) AS y FROM candidates)")(
    lambda s, d: candidates(s, d).select("candidate_id", text.year_in(F.col("release_date")).alias("year"), text.leading_int(F.col("length_text")).alias("number"), text.pair_of(F.concat_ws("/", F.coalesce(F.concat(F.lit(" "), F.col("track_no").cast("string")), F.lit("")), F.concat(F.col("total_tracks").cast("string"), F.lit(" ")))).alias("p"), "track_no", "total_tracks").select("candidate_id", "year", "number", F.coalesce("p.number", F.when(F.lit(False), 0)).alias("part"), F.when(F.col("track_no").isNull(), F.col("total_tracks")).otherwise(F.col("p.total")).alias("total")).distinct())
@q("fn_22", """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\[\\d{1,3}:\\d{2}(?:[.:]\\d{1,3})?\\]', '', 'g'), ' ')), lambda x: x <> ''), chr(10)) AS lyrics, len(string_split(text, chr(10))) >= 3 AS timed FROM documents WHERE text IS NOT NULL
UNION ALL SELECT id, '[' || CASE WHEN ms < 600000 THEN '0' ELSE '' END || CAST(ms // 60000 AS VARCHAR) || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 // 10 AS VARCHAR), 2, '0') || ']', NULL FROM (SELECT id, CAST(round(duration * 1000) AS BIGINT) AS ms FROM t WHERE duration > 0)""", T)
def fn_22(s, d):
    """Stamps put before the lines of texts and taken off again, with the test for timed lyrics; and the stamps of the tracks' lengths."""
    stamp = lambda i: text.lrc_stamp(i * 61_250)
    docs = table(s, d, "documents").where("text is not null")
    timed = docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(stamp(i % 90), x)), "\n").alias("x"))
    tracks = lib(s, d, "duration").where("duration > 0").select(F.col("id").alias("doc_id"), text.lrc_stamp(F.round(F.col("duration") * 1000).cast("bigint")).alias("lyrics"), F.lit(None).cast("boolean").alias("timed"))
    return timed.select("doc_id", text.strip_lrc(F.col("x")).alias("lyrics"), text.is_timed(F.col("x")).alias("timed")).unionByName(tracks)


q("fn_24", "SELECT DISTINCT title, regexp_replace(title, '([+\\-&|!(){}\\[\\]^\"~*?:\\\\/])', '\\\\\\1', 'g') AS escaped FROM t", T)(lambda s, d: lib(s, d, "title").select("title", text.lucene_escaped(F.col("title")).alias("escaped")).distinct())
q("fn_25", "SELECT DISTINCT candidate_id, sha1(source || '|' || title) AS cache_key FROM candidates")(lambda s, d: table(s, d, "candidates").select("candidate_id", text.cache_key(F.col("source"), F.col("title")).alias("cache_key")).distinct())
q("fn_27", "SELECT id, string_split(path, '/')[-1] AS name, CASE WHEN contains(string_split(path, '/')[-1], '.') THEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) ELSE '' END AS suffix FROM t", T)(lambda s, d: lib(s, d, "path").select("id", media.file_name().alias("name"), cleanup.suffix(F.col("path")).alias("suffix")))
q("fn_28", "SELECT id, CAST(CAST(floor(duration) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(duration) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM t", T)(lambda s, d: lib(s, d, "duration").select("id", text.clock(F.col("duration")).alias("clock")))
@q("fn_29", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 END AS deep FROM events")
def fn_29(s, d):
    """A flat key, and 'a.b[0].c' in nested JSON; null wherever something on the way is missing."""
    k = F.get_json_object("props", "$.k")
    nested = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a": {"b": [{"c": '), (k.cast("bigint") + 1).cast("string"), F.lit("}]}}"))).otherwise('{"a": {"b": []}}')
    return table(s, d, "events").select("event_id", k.cast("bigint").alias("k"), F.get(F.from_json(nested, "a struct<b: array<struct<c: bigint>>>")["a"]["b"], 0)["c"].alias("deep"))


@q("fn_30", """SELECT event_id, k, CASE WHEN event_id % 2 = 0 THEN '...' ELSE '[1,{"a":2}]' END AS list, CASE WHEN event_id % 2 = 0 THEN '...' ELSE '{"b":true}' END AS nested, CASE WHEN event_id % 2 = 0 THEN 5000 ELSE 5 END::BIGINT AS letters FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def fn_30(s, d):
    """Payloads of more than 4000 characters keep their scalars only; every second one here is longer."""
    e = table(s, d, "events").select("event_id", F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "list": [1,{"a":2}], "nested": {"b":true}, "text": "'), F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("x"), 5000)).otherwise("short"), F.lit('"}')).alias("p"))
    at = lambda f: F.get_json_object(jobs.trimmed(F.col("p")), f"$.{f}")
    return e.select("event_id", at("k").cast("bigint").alias("k"), at("list").alias("list"), at("nested").alias("nested"), F.length(at("text")).cast("bigint").alias("letters"))


q("fn_34", "SELECT id, CAST(moved_at AS DATE) AS day, strftime(moved_at, '%Y%m%d') AS stamp, CAST(moved_at AS DATE) + 30 AS due FROM q", Q)(lambda s, d: quarantine(s, d).select("id", F.to_date("moved_at").alias("day"), F.date_format("moved_at", "yyyyMMdd").alias("stamp"), F.date_add(F.to_date("moved_at"), 30).alias("due")))


# ---------------------------------------------------------------- sinks, as the state they would leave
def rescan(s, d):
    """A scan of half the index that lost ids and found new sizes."""
    return index_of(s, d).where("id % 2 = 0").select("path", (F.col("size_bytes") + 7).alias("size_bytes"), F.lit("").alias("acoustid"), "status")


q("snk_01", "SELECT path, CASE WHEN id % 2 = 0 THEN size_bytes + 7 ELSE size_bytes END AS size_bytes, acoustid, CASE WHEN id % 2 = 1 THEN audio_md5 END AS audio_md5, CASE WHEN id % 2 = 1 THEN fingerprint END AS fingerprint, status FROM t SEMI JOIN (SELECT path FROM t GROUP BY 1 HAVING count(*) = 1) n USING (path)", T)(
    lambda s, d: (lambda i: incremental.upsert(i, rescan(s, d).select("path", "size_bytes", "acoustid", F.lit(None).cast("string").alias("audio_md5"), F.lit(None).cast("string").alias("fingerprint"), "status")))(index_of(s, d).join(lib(s, d, "audio_md5", "fingerprint"), "id").select("path", "size_bytes", "acoustid", "audio_md5", "fingerprint", "status")))
@q("snk_02", """SELECT id AS group_id, kind, NULL AS track_id, NULL AS action FROM duplicate_groups WHERE resolved UNION ALL
SELECT root, 'exact_file', id, action FROM (SELECT l1.root, l1.id, CASE WHEN rn = 1 THEN 'keep' WHEN margin >= 0.03 THEN 'quarantine' ELSE 'skip' END AS action FROM l1 JOIN rk ON rk.group_id = l1.root AND rk.track_id = l1.id JOIN mg ON mg.group_id = l1.root
  WHERE root NOT IN (SELECT a.root FROM (SELECT root, list_sort(list(id)) AS ids FROM l1 GROUP BY 1) a JOIN (SELECT group_id, list_sort(list(DISTINCT track_id)) AS ids FROM duplicate_members WHERE track_id IS NOT NULL AND group_id IN (SELECT id FROM duplicate_groups WHERE resolved) GROUP BY 1) b USING (ids)))""", T, *_LAYERS[:2], "m AS (SELECT root AS group_id, id AS track_id FROM l1)", _SCORED, _VERDICT.replace("LEFT JOIN duplicate_groups dg ON dg.id = rk.group_id", "LEFT JOIN duplicate_groups dg ON false"))
def snk_02(s, d):
    """The groups a rebuild leaves: resolved ones stay, found ones are added with their verdicts, but not those whose very tracks were settled before."""
    g, m = table(s, d, "duplicate_groups").where("resolved"), table(s, d, "duplicate_members")
    found = dedup.layered(active(s, d), EXACT[:1]).select(F.col("root").alias("group_id"), F.col("id").alias("track_id"), "kind", "confidence")
    settled = m.join(g.select(F.col("id").alias("group_id")), "group_id", "left_semi").select((-F.col("group_id") - 1).alias("group_id"), "track_id")
    new = found.join(decision.not_settled(found, settled), "group_id", "left_semi")
    scored = new.select("group_id", "track_id").join(lib(s, d, *decision.COLUMNS).withColumnRenamed("id", "track_id"), "track_id")
    v = decision.verdicts(scored, new.select("group_id", "confidence").distinct()).select("group_id", F.lit("exact_file").alias("kind"), "track_id", "action")
    return g.select(F.col("id").alias("group_id"), "kind", F.lit(None).cast("bigint").alias("track_id"), F.lit(None).cast("string").alias("action")).unionByName(v)


q("snk_03", "SELECT source, title, arg_max(candidate_id, (fetched_at, candidate_id)) AS candidate_id FROM candidates WHERE fetched_at IS NOT NULL GROUP BY ALL")(lambda s, d: incremental.latest(table(s, d, "candidates").where("fetched_at is not null").select("source", "title", "candidate_id", "fetched_at"), ["source", "title"], ["fetched_at", "candidate_id"]).select("source", "title", "candidate_id"))
q("snk_05", "SELECT id FROM t WHERE status <> 'missing'", T)(lambda s, d: lib(s, d, "status").join(lib(s, d, "status").where("status = 'missing'").select("id"), "id", "left_anti").select("id"))
q("snk_06", "SELECT DISTINCT id FROM duplicate_members WHERE group_id NOT IN (SELECT id FROM duplicate_groups WHERE resolved)")(lambda s, d: table(s, d, "duplicate_members").where("group_id is not null").select("id", "group_id").distinct().join(table(s, d, "duplicate_groups").where("resolved").select(F.col("id").alias("group_id")), "group_id", "left_anti").select("id"))
@q("snk_07", """SELECT coalesce(n.external_id, o.external_id) AS external_id, coalesce(nullif(n.name, ''), o.name) AS name, CASE WHEN n.external_id IS NULL THEN o.entries ELSE n.entries END AS entries, CASE WHEN n.external_id IS NULL THEN o.synced_at ELSE n.synced_at END AS synced_at FROM o FULL JOIN n USING (external_id)""",
   *[f"{k} AS (SELECT source || '-' || (pos % 3) AS external_id, {name} AS name, count(*) AS entries, max(fetched_at) AS synced_at FROM (SELECT DISTINCT * FROM candidates) WHERE pos IS NOT NULL AND {cond} GROUP BY 1)" for k, name, cond in (("o", "min(source)", "candidate_id % 2 = 0"), ("n", "CASE WHEN count(*) % 2 = 0 THEN '' ELSE min(source) || ' new' END", "candidate_id % 2 = 1 AND pos % 3 > 0"))])
def snk_07(s, d):
    """Playlists put in by external id after a second synchronisation; a blank name leaves the old one."""
    c = candidates(s, d).where("pos is not null").withColumn("external_id", F.concat_ws("-", "source", (F.col("pos") % 3).cast("string")))
    lists = lambda df, name: df.groupBy("external_id").agg(name.alias("name"), F.count("*").alias("entries"), F.max("fetched_at").alias("synced_at"))
    old, new = lists(c.where("candidate_id % 2 = 0"), F.min("source")), lists(c.where("candidate_id % 2 = 1 and pos % 3 > 0"), F.when(F.count("*") % 2 == 0, "").otherwise(F.concat(F.min("source"), F.lit(" new"))))
    return incremental.upsert(old, new, "external_id", ("name",))


q("snk_12", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'C' ELSE o_orderstatus END AS state FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus").isin("O", "P"), "C").otherwise(F.col("o_orderstatus")).alias("state")))


@q("snk_13", """SELECT m.group_id, m.track_id, CASE WHEN new THEN wanted ELSE action END AS action, CASE WHEN new THEN trim(trim(replace(coalesce(reason, ''), '(manually overridden)', '')) || ' (manually overridden)') ELSE reason END AS reason, refused FROM (
  SELECT *, wanted IS DISTINCT FROM action AND NOT refused AS new FROM (SELECT *, coalesce(count_if(wanted = 'keep') OVER (PARTITION BY group_id) = 0 AND count_if(wanted IS DISTINCT FROM action) OVER (PARTITION BY group_id) > 0, false) AS refused FROM (
    SELECT *, CASE WHEN track_id % 10 = 0 THEN 'keep' WHEN track_id % 3 = 0 THEN 'quarantine' ELSE action END AS wanted FROM (SELECT group_id, track_id, arg_max(struct_pack(x := proposed_action), id).x AS action, arg_max(struct_pack(x := reason), id).x AS reason FROM duplicate_members WHERE group_id IS NOT NULL AND track_id IS NOT NULL GROUP BY ALL)))) m""")
def snk_13(s, d):
    """Verdicts after overrides by hand; a group that would be left without a keeper refuses its overrides."""
    m = table(s, d, "duplicate_members").where("group_id is not null and track_id is not null").groupBy("group_id", "track_id").agg(F.max_by(F.struct("proposed_action", "reason"), "id").alias("x")).select("group_id", "track_id", F.col("x.proposed_action").alias("action"), "x.reason")
    by_hand = m.select("group_id", "track_id", F.when(F.col("track_id") % 10 == 0, "keep").when(F.col("track_id") % 3 == 0, "quarantine").alias("action")).where("action is not null")
    return decision.overridden(m, by_hand)


q("snk_14", "SELECT group_id, track_id, CASE WHEN group_id IN (SELECT id FROM duplicate_groups WHERE resolved) THEN 'skip' ELSE proposed_action END AS action FROM m", M)(lambda s, d: members(s, d).join(table(s, d, "duplicate_groups").where("resolved").select(F.col("id").alias("group_id"), F.lit("skip").alias("settled")), "group_id", "left").select("group_id", "track_id", F.coalesce("settled", "proposed_action").alias("action")))

# ---------------------------------------------------------------- streams
q("str_01", "SELECT event_id, user_id, admitted FROM ad WHERE n > 0", *qs.admitted(3, 3600.0))(lambda s, d: activity.run_once(activity.admitted(activity.events_stream(s, d), 3, 3600.0), _fresh("admitted"), "append"))
@q("str_02", """SELECT event_id, recent, recent > 10 AS refused, least(2.0, greatest(0.0, (n - 60) * 0.25))::DOUBLE AS delay FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, since ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW) AS n
  FROM (SELECT *, coalesce(count_if(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM events))""")
def str_02(s, d):
    """Attempts per user since the last success, which are too many, and how long each waits for the pressure of all."""
    e = table(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    r = activity.delayed(activity.rolling(e, success=F.col("event_type") == "signup"))
    return r.select("event_id", "recent", (F.col("recent") > activity.MOST_OF_USER).alias("refused"), "delay")


q("str_05", "SELECT id, purge_after < TIMESTAMP '2025-06-30' AS expired FROM q", Q)(lambda s, d: quarantine(s, d).select("id", (F.col("purge_after") < F.lit(AS_OF).cast("timestamp_ntz")).alias("expired")))
q("str_08", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")(lambda s, d: activity.run_once(activity.daily(activity.events_stream(s, d)), _fresh("daily"), "complete"))


def _fresh(name: str) -> str:
    """A name for a streaming run of its own."""
    import uuid

    return f"{name}_{uuid.uuid4().hex}"


_TARGETS = "SELECT id, path, '/lib00/music/' || CASE WHEN ends_with(lower(w), lower(ex)) THEN w ELSE w || ex END AS target FROM wh"
q("win_10", "SELECT * FROM nu", T, _PARTS, *qs.numbered(_TARGETS))(lambda s, d: organise.numbered(organise.targets(lib(s, d, "path", "ext", "codec", "title", "artist", "albumartist", "album", "year", "genre", "track_no", "disc_no"), "/lib00/music/")))
# ---------------------------------------------------------------- the rest of the inventory
q("win_02", "SELECT group_id, track_id, s_duration FROM sc", T, M, _SCORED)(lambda s, d: decision.scored(group_members(s, d)).select("group_id", "track_id", "s_duration"))
q("win_11", "SELECT * FROM nu", Q, *qs.numbered("SELECT id, original_path AS path, '/q/' || string_split(quarantine_path, '/')[-1] AS target FROM q"))(lambda s, d: organise.numbered(quarantine(s, d).select("id", F.col("original_path").alias("path"), F.concat(F.lit("/q/"), F.substring_index("quarantine_path", "/", -1)).alias("target"))))


@q("jn_17", """SELECT DISTINCT candidate_id, bt AS t, br AS ratio FROM (SELECT al, w, arg_max(t, (sorted, t)) AS bt, round(max(sorted), 4) AS br FROM asked JOIN held USING (al) JOIN f ON a = w AND b = t WHERE sorted >= 82 GROUP BY ALL) JOIN cd USING (al, w)""", T, *qs.composed("n", "SELECT title AS x FROM t UNION SELECT title FROM candidates"),
   "held AS (SELECT DISTINCT translate(lower(album), 'ς', 'σ') AS al, n AS t FROM t JOIN n ON x = title WHERE album <> '' AND n <> '')", "cd AS (SELECT DISTINCT candidate_id, translate(lower(album), 'ς', 'σ') AS al, coalesce(n, '') AS w FROM candidates LEFT JOIN n ON x = title WHERE album <> '')",
   "asked AS (SELECT DISTINCT al, w FROM cd)", *qs.ratios("f", "SELECT w AS a, t AS b FROM asked JOIN held USING (al)"))
def jn_17(s, d):
    """The best entry of an album's track list for each answer that names the album: title ratio of 82 or more.

    Both sides are distinct by album and title before they meet, so copies and repeated answers move once.
    """
    n = text.normalised
    album = lib(s, d, "album", "title").where("album <> ''").select(lower("album").alias("al"), "title").distinct().select("al", n(F.col("title")).alias("t")).where("t <> ''").distinct()
    want = candidates(s, d).where("album <> ''").select("candidate_id", lower("album").alias("al"), n(F.col("title")).alias("w")).distinct()
    scored = want.select("al", "w").distinct().join(album, "al").withColumn("ratio", fuzzy.ratio_column(fuzzy.token_sort_ratio)("w", "t")).where("ratio >= 82")
    best = scored.groupBy("al", "w").agg(F.max_by(F.struct("t", F.round("ratio", 4).alias("ratio")), F.struct("ratio", "t")).alias("b"))
    return want.join(best, ["al", "w"]).select("candidate_id", "b.t", "b.ratio")


@q("src_09e", """SELECT candidate_id, CASE WHEN NOT listed THEN base WHEN br IS NULL THEN round(base * 0.4::DOUBLE, 4) ELSE round(base * (0.5::DOUBLE + 0.5::DOUBLE * br / 100), 4) END AS confidence FROM (SELECT c.candidate_id, greatest(0.35::DOUBLE, round(0.82::DOUBLE - 0.12::DOUBLE * (pos - 1), 4)) AS base, cd.al IS NOT NULL AND cd.al IN (SELECT al FROM held) AS listed, br
  FROM (SELECT DISTINCT candidate_id, pos FROM candidates WHERE pos IS NOT NULL) c LEFT JOIN cd USING (candidate_id) LEFT JOIN (SELECT al, w, max(sorted) AS br FROM asked JOIN held USING (al) JOIN f ON a = w AND b = t WHERE sorted >= 82 GROUP BY ALL) y ON y.al = cd.al AND y.w = cd.w)""", *ORACLES["jn_17"].partition("WITH RECURSIVE ")[2].rpartition(" SELECT DISTINCT candidate_id, bt")[:1])
def src_09e(s, d):
    """Confidence of a release by its rank, after its track list: the library's tracks of the album stand for the list."""
    n = text.normalised
    held = lib(s, d, "album", "title").where("album <> ''").select(lower("album").alias("al"), "title").distinct().select("al", n(F.col("title")).alias("t")).where("t <> ''").distinct()
    want = candidates(s, d).where("pos is not null").select("candidate_id", "pos", F.when(F.col("album") != "", lower("album")).alias("al"), n(F.col("title")).alias("w"))
    best = want.select("al", "w").distinct().join(held, "al").withColumn("r", fuzzy.ratio_column(fuzzy.token_sort_ratio)("w", "t")).where("r >= 82").groupBy("al", "w").agg(F.max("r").alias("r"))
    x = want.join(held.select("al", F.lit(True).alias("listed")).distinct(), "al", "left").join(best, ["al", "w"], "left")
    return x.select("candidate_id", providers.by_tracklist(providers.ranked(F.col("pos") - 1, 0.82, 0.12, 0.35), F.coalesce("listed", F.lit(False)), F.col("r")).alias("confidence")).distinct()


_BLANK = "CASE WHEN coalesce({0}, '') = '' THEN {2}::DOUBLE WHEN coalesce({1}, '') = '' THEN 0.0::DOUBLE ELSE {3} END"


@q("fn_16", f"""SELECT l.id, c.id AS candidate_id, round(least(1.0, 0.45::DOUBLE * y.sorted / 100 + {_BLANK.format('l.ar', 'c.ar', 0.15, '0.30::DOUBLE * z.in_set / 100')} + {_BLANK.format('l.al', 'c.al', 0.07, '0.15::DOUBLE * v.sorted / 100')} + 0.04::DOUBLE), 4) AS confidence
  FROM lo l JOIN ca c USING (k) JOIN f y ON y.a = l.ti AND y.b = c.ti JOIN f z ON z.a = l.ar AND z.b = c.ar JOIN f v ON v.a = l.al AND v.b = c.al""", T,
   *qs.composed("n", "SELECT title AS x FROM t UNION SELECT artist FROM t UNION SELECT album FROM t UNION SELECT title FROM candidates UNION SELECT artist FROM candidates UNION SELECT album FROM candidates"),
   *[f"{p} AS (SELECT translate(lower(title), 'ς', 'σ') AS k, coalesce(y.n, '') AS ti, coalesce(z.n, '') AS ar, coalesce(v.n, '') AS al, min({i}) AS id FROM {t} LEFT JOIN n y ON y.x = title LEFT JOIN n z ON z.x = artist LEFT JOIN n v ON v.x = album WHERE title <> '' GROUP BY ALL)" for p, i, t in (("lo", "id", "t"), ("ca", "candidate_id", "candidates"))],
   *qs.ratios("f", "SELECT l.ti AS a, c.ti AS b FROM lo l JOIN ca c USING (k) UNION SELECT l.ar, c.ar FROM lo l JOIN ca c USING (k) UNION SELECT l.al, c.al FROM lo l JOIN ca c USING (k)"))
def fn_16(s, d):
    """Confidence of an answer by title .45, artist .30, album .15 and length .10, unknown fields counting partly.

    Tracks and answers alike in the three normalised fields are one class each, their least id standing for
    them, so a hot title meets by its different artists and albums and not by its copies.
    """
    n, sort_, set_ = text.normalised, fuzzy.ratio_column(fuzzy.token_sort_ratio), fuzzy.ratio_column(fuzzy.token_set_ratio)
    kinds = lambda df, i, p: df.where("title <> ''").select(F.col(i).alias("i"), lower("title").alias("k"), *[n(F.col(c)).alias(p + c) for c in ("title", "artist", "album")]).groupBy("k", *[p + c for c in ("title", "artist", "album")]).agg(F.min("i").alias(p + "id"))
    p = kinds(lib(s, d, "title", "artist", "album"), "id", "l").join(kinds(candidates(s, d), "candidate_id", "c"), "k")
    partly = lambda a, b, unknown, known: F.when(F.col(a) == "", unknown).when(F.col(b) == "", 0.0).otherwise(known)
    score = 0.45 * sort_("ltitle", "ctitle") / 100 + partly("lartist", "cartist", 0.15, 0.30 * set_("lartist", "cartist") / 100) + partly("lalbum", "calbum", 0.07, 0.15 * sort_("lalbum", "calbum") / 100) + 0.04
    return p.select(F.col("lid").alias("id"), F.col("cid").alias("candidate_id"), F.round(F.least(F.lit(1.0), score), 4).alias("confidence"))


@q("fn_23", "SELECT id, CAST(artwork_px AS INT) AS width FROM t WHERE artwork_px BETWEEN 1 AND 65535", T)
def fn_23(s, d):
    """Widths read back from headers made of them: PNG for even ids, JPEG with another segment before the frame for odd ones."""
    from .functions.register import image_width

    t = lib(s, d, "artwork_px").where("artwork_px between 1 and 65535")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex("artwork_px"), 8, "0"), F.lit("00000001"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC20011080064"), F.lpad(F.hex("artwork_px"), 4, "0"), F.lit("03"))
    return t.select("id", image_width()(F.unhex(F.when(F.col("id") % 2 == 0, png).otherwise(jpeg))).alias("width"))


q("fn_26", "SELECT event_id, replace(props, '\"k\": 6', '***') AS props FROM events")(lambda s, d: table(s, d, "events").select("event_id", text.redacted(F.col("props"), ['"k": 6', "no"]).alias("props")))


def _target(s, name: str) -> str:
    from .core.session import checkpoint_dir

    return f"{checkpoint_dir(s)}/{_fresh(name)}"


@q("snk_04", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1")
def snk_04(s, d):
    """Audit rows appended in two writes, read back."""
    at, e = _target(s, "audit"), table(s, d, "events").select(F.col("event_type").alias("action"), "event_id")
    e.where("event_id % 2 = 0").write.mode("append").parquet(at)
    e.where("event_id % 2 = 1").write.mode("append").parquet(at)
    return s.read.parquet(at).groupBy("action").agg(F.count("*").alias("n"))


@q("str_03", "SELECT path FROM ch WHERE change IN ('added', 'updated')", T, _SNAP)
def str_03(s, d):
    """What an incremental pass would work on: everything but unchanged, missing and corrupt files."""
    return incremental.changes(disk_of(s, d), index_of(s, d)).where("change in ('added', 'updated')").select("path")


@q("str_04", "SELECT event_id, md5(props) AS digest FROM events")
def str_04(s, d):
    """A resumable backfill in micro-batches, run twice; the second run finds nothing to do."""
    at = _target(s, "backfill")
    work = lambda b: b.select("event_id", F.md5("props").alias("digest"))
    for _ in range(2):
        activity.apply_batches(activity.events_stream(s, d), _fresh("backfill"), at, "event_id", work)
    return s.read.parquet(at)
