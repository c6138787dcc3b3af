"""Queries of the core's training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core.orphans import LIBRARY_REFS, orphan_cascade, orphans_by_period
from .core.session import table


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    tables = {t: table(spark, d, t) for t in ("quarantine", "duplicate_members", "duplicate_groups", "tracks")}
    return orphan_cascade(tables, dict.fromkeys(tables, "id"), LIBRARY_REFS), tables


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (table_name, row_id) of the dangling references: the cascade's direct orphans in the tables asked for."""
    return _orphans(spark, d)[0].where("depth = 0 and table_name in ('quarantine', 'duplicate_members')").select("table_name", "row_id").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table, reference and month."""
    orphans, t = _orphans(spark, d)
    month = lambda c: F.date_format(c, "yyyy-MM")
    groups = t["duplicate_groups"].select(F.col("id").alias("group_id"), month("created_at").alias("period"))
    periods = {
        "quarantine": t["quarantine"].select(F.col("id").alias("row_id"), month("moved_at").alias("period")),
        "duplicate_groups": groups.select(F.col("group_id").alias("row_id"), "period"),
        "duplicate_members": t["duplicate_members"].select(F.col("id").alias("row_id"), "group_id").distinct().join(groups, "group_id", "left").select("row_id", "period"),
    }
    return orphans_by_period(orphans, periods)


_P6 = """
SELECT DISTINCT 'quarantine' AS table_name, q.id AS row_id FROM quarantine q
WHERE q.group_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM duplicate_groups g WHERE g.id = q.group_id)
UNION ALL
SELECT DISTINCT 'duplicate_members', m.id FROM duplicate_members m
WHERE m.track_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tracks t WHERE t.id = m.track_id)"""

QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
ORACLES = {
    "p6_found": _P6,
    "p6_report": f"""
WITH o AS (SELECT table_name, row_id, 0 AS depth FROM ({_P6})),
m AS (SELECT DISTINCT id, group_id FROM duplicate_members),
g AS (SELECT id, CASE WHEN id NOT IN (SELECT group_id FROM m WHERE group_id IS NOT NULL) THEN 0 ELSE 1 END AS depth FROM (SELECT DISTINCT id FROM duplicate_groups)
  WHERE id NOT IN (SELECT group_id FROM m WHERE group_id IS NOT NULL AND id NOT IN (SELECT row_id FROM o WHERE table_name = 'duplicate_members'))),
i AS (SELECT * FROM o UNION ALL SELECT 'duplicate_groups', id, depth FROM g
  UNION ALL SELECT DISTINCT 'quarantine', q.id, g.depth + 1 FROM quarantine q JOIN g ON g.id = q.group_id),
l AS (SELECT table_name, row_id, min(depth) AS depth FROM i GROUP BY ALL),
w AS (
  SELECT 'quarantine' AS table_name, id AS row_id, min(strftime(moved_at, '%Y-%m')) AS period FROM quarantine GROUP BY id
  UNION ALL
  SELECT 'duplicate_groups', id, min(strftime(created_at, '%Y-%m')) FROM duplicate_groups GROUP BY id
  UNION ALL
  SELECT 'duplicate_members', m.id, min(strftime(g.created_at, '%Y-%m')) FROM duplicate_members m LEFT JOIN duplicate_groups g ON g.id = m.group_id GROUP BY m.id)
SELECT table_name, CASE table_name WHEN 'quarantine' THEN 'quarantine.group_id' WHEN 'duplicate_groups' THEN 'duplicate_groups.id' ELSE 'duplicate_members.track_id' END AS reference,
  coalesce(w.period, 'unknown') AS period, CAST(count_if(depth = 0) AS BIGINT) AS direct, CAST(count_if(depth > 0) AS BIGINT) AS inherited
FROM l LEFT JOIN w USING (table_name, row_id) GROUP BY ALL""",
}
