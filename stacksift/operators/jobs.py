"""Results of jobs: what came out of one, and payloads kept small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which jobs report what succeeded and what failed, in order of preference (fixed values).
SUCCEEDED = ("succeeded", "converted", "moved", "applied", "computed", "restored", "purged", "enriched", "updated", "added")
FAILED = ("failed", "errors", "quarantine_failed")
MOST_CHARACTERS = 4000


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def first_number(result: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys of a JSON object that holds a whole number or a list: the number, or the list's length.

    Booleans, texts and nulls are passed over; bad JSON and no such key give null.
    """
    v = F.try_parse_json(result)

    def one(key: str) -> Column:
        x = F.try_variant_get(v, f"$.{key}", "variant")
        return F.when(_kind(x).isin("BIGINT") | _kind(x).rlike(r"^DECIMAL\(\d+,0\)$"), F.try_variant_get(v, f"$.{key}", "bigint")).when(_kind(x).startswith("ARRAY"), F.size(F.try_variant_get(v, f"$.{key}", "array<variant>")).cast("bigint"))

    return F.coalesce(*[one(k) for k in keys])


def outcome(result: Column) -> Column:
    """struct<succeeded, failed> of a job's result."""
    return F.struct(first_number(result, SUCCEEDED).alias("succeeded"), first_number(result, FAILED).alias("failed"))


def trimmed(payload: Column, most: int = MOST_CHARACTERS) -> Column:
    """A JSON object of up to `most` characters as it is; of a longer one lists and objects are replaced by '...'."""
    m = F.try_variant_get(F.try_parse_json(payload), "$", "map<string, variant>")
    short = F.transform_values(m, lambda _, x: F.when(_kind(x).startswith("ARRAY") | _kind(x).startswith("OBJECT"), F.parse_json(F.lit('"..."'))).otherwise(x))
    return F.when(F.length(payload) > most, F.to_json(short)).otherwise(payload)


def converted(results: DataFrame) -> DataFrame:
    """(converted, failed, saved_bytes) of `results` (ok, src_bytes, dst_bytes): bytes are saved by what came out smaller, never lost by what grew."""
    saved = F.when(F.col("ok"), F.greatest(F.lit(0), F.col("src_bytes") - F.col("dst_bytes"))).otherwise(0)
    return results.agg(F.count_if("ok").alias("converted"), F.count_if(~F.col("ok")).alias("failed"), F.sum(saved).alias("saved_bytes"))
