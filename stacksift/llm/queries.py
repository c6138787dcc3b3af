"""Queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.session import table
from . import bpe, consolidate, encoding, lookalike, matching, names, packing, personal, survivor


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("track_id", "candidate_id").distinct()


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Tracks and candidates of one recording, with a confidence."""
    return matching.match_candidates(table(spark, d, "tracks"), table(spark, d, "candidates"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(names.same_names(table(spark, d, "tracks")))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every name with its entity's number of spellings."""
    e = names.same_names(table(spark, d, "tracks"))
    n = e.groupBy("entity").agg(F.count("*").alias("spellings"), F.min("name").alias("first_spelling"))
    return e.join(n, "entity").select("name", "first_spelling", "spellings")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.dominant_members(survivor.valid_members(table(spark, d, "duplicate_members"), table(spark, d, "tracks")))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of every group of two or more members, best value field by field."""
    rows = survivor.valid_members(table(spark, d, "duplicate_members"), table(spark, d, "tracks"))
    several = rows.groupBy("group_id").agg(F.count("*").alias("members")).where("members > 1")
    return survivor.survivors(rows).join(several, "group_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_values(table(spark, d, "tracks")).select("track_id", "field").distinct()


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled values with the original where it can be had."""
    return encoding.garbled_values(table(spark, d, "tracks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_forms(table(spark, d, "tracks")).where("changed").select("track_id", "field").distinct()


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every title and artist in its one form."""
    return lookalike.consistent_forms(table(spark, d, "tracks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.track_groups(table(spark, d, "duplicate_members"), table(spark, d, "clusters"), table(spark, d, "tracks"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its containers, for each capacity."""
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "capacities"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers used, the least possible number, and the share of room left unused."""
    packed = p9_containers(spark, d)
    caps = table(spark, d, "capacities").select("capacity_id", "capacity_tokens").distinct()
    per = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    return (
        per.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest")).join(caps, "capacity_id")
        .select("capacity_id", "capacity_tokens", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("waste"))
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.document_items(table(spark, d, "documents"), table(spark, d, "tracks")).select("doc_id", "kind", "found_text").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All texts with typed placeholders in place of personal information."""
    return personal.redacted_documents(table(spark, d, "documents"), table(spark, d, "tracks"))


_S = ("format", "bitrate", "resolution", "tags", "artwork", "lyrics", "duration", "path")
_TOP = "greatest(" + ", ".join(f"coalesce(score_breakdown.{s}, 0)" for s in _S) + ")"
_MEMBERS = f"""
m0 AS (SELECT *, {_TOP} AS top FROM (SELECT group_id, track_id, arg_max(struct_pack(s := score_breakdown), id).s AS score_breakdown
  FROM duplicate_members WHERE group_id IS NOT NULL AND track_id IS NOT NULL GROUP BY ALL)),
t AS (SELECT DISTINCT id, tag_completeness, CAST(CAST(lossless AS INT) AS DOUBLE) AS lossless, first_seen, title, artist, albumartist, album, year, genre, codec FROM tracks),
m AS (SELECT group_id, track_id, {", ".join(f"round(CASE WHEN top > 1 THEN score_breakdown.{s} / 100 ELSE score_breakdown.{s} END, 3) AS s_{s}" for s in _S)}, t.* EXCLUDE (id) FROM m0 JOIN t ON t.id = track_id)"""
_F = (*(f"s_{s}" for s in _S), "tag_completeness", "lossless")

QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_entities, p4_found, p4_restored, p5_found, p5_forms, p3_found, p3_survivors, p7_found, p8_ids, p9_containers, p9_fill, p10_found, p10_redacted)}
_T = survivor.TEXT_FIELDS
ORACLES = {
    "p3_survivors": f"""
WITH {_MEMBERS}, g AS (SELECT group_id, count(*) AS members, {", ".join(f"max({f}) AS {f}" for f in _F)} FROM m GROUP BY 1 HAVING count(*) > 1),
v AS (SELECT *, (greatest(coalesce(tag_completeness, 0.5), 0) + coalesce(lossless, 0) / 10) * pow(0.5, coalesce((epoch(TIMESTAMP '{survivor.AS_OF}') - floor(epoch(first_seen))) / {86400.0 * survivor.HALF_LIFE_DAYS}, 4)) AS vote FROM m),
l AS (UNPIVOT (SELECT group_id, vote, {", ".join(f"CAST({f} AS VARCHAR) AS {f}" for f in _T)} FROM v) ON {", ".join(_T)} INTO NAME field VALUE value),
n AS (SELECT *, nullif(regexp_replace(translate(lower(trim(value)), 'ς', 'σ'), '\\s+', ' ', 'g'), '') AS norm FROM l),
s AS (SELECT group_id, field, norm, value, sum(vote) AS v FROM n WHERE norm IS NOT NULL GROUP BY ALL),
p AS (SELECT group_id, field, norm, round(sum(v), 6) AS votes, arg_min(value, (-round(v, 6), value)) AS value FROM s GROUP BY ALL),
w AS (SELECT group_id, field, arg_min(value, (-votes, norm)) AS value FROM p GROUP BY ALL),
x AS (SELECT group_id, {", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f in _T)} FROM w GROUP BY 1)
SELECT g.*, x.* EXCLUDE (group_id) FROM g LEFT JOIN x ON x.group_id = g.group_id""",
    "p3_found": f"""
WITH {_MEMBERS}, pairs AS (
  SELECT a.group_id, a.track_id, ({" OR ".join(f"coalesce(a.{f} < b.{f}, false)" for f in _F)}) AS lower, ({" OR ".join(f"coalesce(a.{f} > b.{f}, false)" for f in _F)}) AS higher,
    coalesce(a.first_seen, TIMESTAMP '9999-01-01') < coalesce(b.first_seen, TIMESTAMP '9999-01-01') OR (coalesce(a.first_seen, TIMESTAMP '9999-01-01') = coalesce(b.first_seen, TIMESTAMP '9999-01-01') AND a.track_id < b.track_id) AS earlier
  FROM m a JOIN m b ON a.group_id = b.group_id AND a.track_id <> b.track_id)
SELECT group_id, track_id FROM pairs GROUP BY ALL HAVING bool_and(NOT lower AND (higher OR earlier))""",
    "p7_found": """
WITH RECURSIVE t AS (SELECT DISTINCT id FROM tracks),
l AS (SELECT DISTINCT list_sort(list_distinct(track_ids)) AS ids FROM clusters WHERE track_ids IS NOT NULL),
h AS (SELECT 'l' || row_number() OVER () AS node, ids FROM l),
e AS (SELECT node, id FROM (SELECT node, unnest(ids) AS x FROM h) JOIN t ON id = x
  UNION SELECT 'g' || group_id, t.id FROM duplicate_members JOIN t ON t.id = track_id WHERE group_id IS NOT NULL),
s AS (SELECT DISTINCT a.id AS x, b.id AS y FROM (SELECT node, min(id) AS id FROM e GROUP BY node) a JOIN e b USING (node) WHERE a.id <> b.id),
b AS (SELECT x, y FROM s UNION SELECT y, x FROM s),
r(x, root) USING KEY (x) AS (SELECT x, min(x) FROM b GROUP BY x
  UNION SELECT b.y, min(r.root) FROM r JOIN b ON b.x = r.x JOIN recurring.r AS c ON c.x = b.y WHERE r.root < c.root GROUP BY b.y)
SELECT root AS group_root, x AS track_id FROM r""",
}
