"""References to records that do not exist: the fixpoint cascade down the foreign-key graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


@dataclass(frozen=True)
class Reference:
    """`child.column` refers to `parent.parent_key`; a null reference refers to nothing."""

    child: str
    column: str
    parent: str
    parent_key: str = "id"


def _missing_keys(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Referring keys without a target. Keys are made distinct before the shuffle, so a hot key moves once."""
    wanted = child.where(F.col(column).isNotNull()).select(F.col(column).alias("_k")).distinct()
    return wanted.join(parent.select(F.col(parent_key).alias("_k")).where("_k is not null").hint("merge"), "_k", "left_anti")


def _salted(rows: DataFrame, keys: DataFrame, salts: int) -> DataFrame:
    """rows(_r, _k) whose _k is among the distinct `keys`; hot keys are spread over `salts` tasks. Keys grow with the data and are never broadcast."""
    spread = keys.select("_k", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    return rows.withColumn("_s", F.pmod(F.xxhash64("_r"), F.lit(salts)).cast("int")).join(spread.hint("merge"), ["_k", "_s"], "left_semi").select("_r", "_k")


def orphan_cascade(tables: dict[str, DataFrame], keys: dict[str, str], refs: Sequence[Reference], salts: int = 8) -> DataFrame:
    """Rows that refer, directly or through others, to rows that do not exist.

    Returns distinct (table_name STRING, row_id BIGINT, reference STRING, depth INT): depth 0 is a direct
    orphan (the target is missing), depth n an inherited one (its target exists but is an orphan of depth
    n - 1; of several rows with the key referred to, all are orphans by then); a row keeps its least depth per
    reference. Each round semi-joins the children of the tables
    that got new orphans; on an acyclic graph the rounds end when no table is left below them, on a cyclic
    one when a round finds nothing.
    Nulls refer to nothing; repeated rows count once; empty parents make every reference an orphan; other
    columns, whatever their names, are not read.
    """
    slim = {t: df.select(F.col(keys[t]).cast("bigint").alias("_id"), *{r.column: F.col(r.column).alias("_c_" + r.column) for r in refs if r.child == t}.values()) for t, df in tables.items()}

    def rows(r: Reference) -> DataFrame:
        return slim[r.child].select(F.col("_id").alias("_r"), F.col("_c_" + r.column).alias("_k")).where("_k is not null").distinct()

    def found(r: Reference, keys_: DataFrame, depth: int) -> DataFrame:
        return _salted(rows(r), keys_, salts).select(F.lit(r.child).alias("table_name"), F.col("_r").alias("row_id"), F.lit(f"{r.child}.{r.column}").alias("reference"), F.lit(depth).alias("depth"))

    first = [found(r, _missing_keys(tables[r.child], r.column, tables[r.parent], r.parent_key), 0) for r in refs]
    out = reduce(DataFrame.unionByName, first)
    fresh, live, depth = out, {r.child for r in refs}, 0
    reachable = _reaches(refs)
    while any(r.parent in live for r in refs):
        depth += 1
        below = [r for r in refs if r.parent in live]
        step = reduce(
            DataFrame.unionByName,
            [found(r, _dead_keys(tables[r.parent], keys[r.parent], r.parent_key, fresh.where(F.col("table_name") == r.parent), out.where(F.col("table_name") == r.parent)), depth) for r in below],
        ).join(out.hint("merge"), ["table_name", "row_id", "reference"], "left_anti")
        live = {r.child for r in below}
        if any(t in reachable[t] for t in live):  # a cycle: only data can tell when it ends
            step = cut(step)
            if step.isEmpty():
                break
        out, fresh = out.unionByName(step), step
    return out


def _dead_keys(parent: DataFrame, pk: str, key: str, fresh: DataFrame, orphans: DataFrame) -> DataFrame:
    """Keys of the `fresh` orphans of a table under which it has none but orphans."""
    ids = fresh.select(F.col("row_id").alias("_id")).distinct()
    if pk == key:
        return ids.select(F.col("_id").alias("_k"))
    rows = parent.select(F.col(pk).cast("bigint").alias("_id"), F.col(key).alias("_k")).where("_k is not null")
    touched = rows.join(ids.hint("merge"), "_id", "left_semi").select("_k").distinct()
    alive = rows.join(orphans.select(F.col("row_id").alias("_id")).hint("merge"), "_id", "left_anti").select("_k")
    return touched.join(alive.hint("merge"), "_k", "left_anti")


def _reaches(refs: Sequence[Reference]) -> dict[str, set[str]]:
    down: dict[str, set[str]] = {}
    for r in refs:
        down.setdefault(r.parent, set()).add(r.child)
        down.setdefault(r.child, set())
    for _ in down:
        for t in down:
            down[t] |= set().union(*(down[c] for c in down[t])) if down[t] else set()
    return down


#: The references of the library's tables that are reported. A group stands on its members: one whose members
#: are all orphans is an orphan too, and so is what was quarantined for it.
LIBRARY_REFS = (Reference("quarantine", "group_id", "duplicate_groups"), Reference("duplicate_members", "track_id", "tracks"), Reference("duplicate_groups", "id", "duplicate_members", "group_id"))


def orphans_by_period(orphans: DataFrame, periods: dict[str, DataFrame]) -> DataFrame:
    """Direct and inherited orphans per table, reference and period.

    `periods` maps a table to (row_id, period); a row without one counts under 'unknown', a row with
    several under its least.
    """
    when = reduce(DataFrame.unionByName, [p.groupBy("row_id").agg(F.min("period").alias("period")).select(F.lit(t).alias("table_name"), "row_id", "period") for t, p in periods.items()])
    least = orphans.groupBy("table_name", "row_id", "reference").agg(F.min("depth").alias("depth"))
    return (
        least.join(when, ["table_name", "row_id"], "left")
        .groupBy("table_name", "reference", F.coalesce("period", F.lit("unknown")).alias("period"))
        .agg(F.count_if(F.col("depth") == 0).alias("direct"), F.count_if(F.col("depth") > 0).alias("inherited"))
    )
