"""Acoustic fingerprints: decoding, LSH bands and offset-tolerant similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS, WORDS, BITS = 6, 2, 8


def words(fp: Column) -> Column:
    """The unsigned 32-bit words of base64url text; null where it holds fewer than two."""
    raw = F.hex(F.try_to_binary(F.translate(fp, "-_", "+/"), F.lit("base64")))
    n = F.floor(F.length(raw) / 8).cast("int")
    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(raw, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint")))


def band_keys(w: Column) -> Column:
    """One key a band: its number and the top bits of its first words; finer than a hash of them."""
    seg = F.greatest(F.lit(1), F.floor(F.size(w) / BANDS)).cast("int")
    top = lambda i: F.shiftright(F.get(w, i), 32 - BITS).cast("string")
    each = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.when(b * seg + WORDS <= F.size(w), F.concat_ws(":", b.cast("string"), *[top((b * seg + k).cast("int")) for k in range(WORDS)])))
    return F.array_compact(each)


def best_agreement(a: np.ndarray, b: np.ndarray, shift: int = 60, least: int = 10) -> float:
    """The largest share of equal bits over all offsets within `shift` that overlap in `least` words; 0 if none does."""
    best = 0.0
    for k in range(-min(shift, len(b)), min(shift, len(a)) + 1):
        x, y = (a[k:], b) if k >= 0 else (a, b[-k:])
        n = min(len(x), len(y))
        if n >= least:
            best = max(best, 1.0 - int(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (n * 32))
    return best


def agreement_column():
    """A pandas UDF of `best_agreement` on two word arrays; 0 where either is null."""

    @F.pandas_udf("double")
    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None or y is None else best_agreement(np.asarray(x, np.uint32), np.asarray(y, np.uint32)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return agreement


def aligned_agreement(a: Column, b: Column) -> Column:
    """Share of equal bits without an offset, by built-ins only; null for lengths that differ."""
    return F.when(F.size(a) == F.size(b), F.round(1 - F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x) / (F.size(a) * 32), 6))
