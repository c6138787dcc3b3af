"""Per-field weighted vote over what several sources say of one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TRUST, OVERWRITE = 0.30, 0.80


def best_per_source(c: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Each source's most confident answer per entity; the earlier one on ties."""
    return c.groupBy(entity, "source").agg(F.max_by(F.struct(*[x for x in c.columns if x not in (entity, "source")]), F.struct("confidence", -F.col("pos"))).alias("b")).select(entity, "source", "b.*")


def ballots(c: DataFrame, fields: tuple[str, ...], trust: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(entity, field, source, pos, value, weight): one row for each non-blank field; weight = trust x confidence.

    `trust` (field, source, trust) is a small table users may replace; sources it lacks count DEFAULT_TRUST.
    """
    long = c.select(entity, "source", "confidence", "pos", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(entity, "source", "confidence", "pos", "x.*").where("value is not null and value not in ('', '0')")
    return long.join(trust, ["field", "source"], "left").select(entity, "field", "source", "pos", "value", F.round(F.coalesce("trust", F.lit(DEFAULT_TRUST)) * F.coalesce("confidence", F.lit(0.5)), 5).alias("weight"))


def winners(votes: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(entity, field, value, source, weight, conflict): the heaviest ballot, the earlier one on ties; conflict if normalised values differ."""
    return votes.groupBy(entity, "field").agg(F.max_by(F.struct("value", "source", "weight"), F.struct("weight", -F.col("pos"))).alias("w"), (F.count_distinct(F.lower(F.trim("value"))) > 1).alias("conflict")).select(entity, "field", "w.*", "conflict")


def overwrite(old: Column, new: Column, weight: Column, allowed: bool) -> Column:
    """Blanks are always filled; a value is replaced only if allowed and the new one weighs OVERWRITE or more."""
    blank = old.isNull() | (old == "")
    return F.when(new.isNull() | (new == ""), old).when(blank, new).when(F.lit(allowed) & (weight >= OVERWRITE), new).otherwise(old)
