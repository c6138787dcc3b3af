"""The functions as SQL functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import fingerprint, fuzzy, text


def image_width():
    """A pandas UDF from PNG or JPEG bytes to the width in pixels; null for anything else or a cut-off header."""

    def width(b: bytes | None) -> int | None:
        if not b:
            return None
        if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
            return int.from_bytes(b[16:20], "big")
        if b[:2] != b"\xff\xd8":
            return None
        at = 2
        while at + 9 <= len(b) and b[at] == 0xFF:
            kind, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[at + 7 : at + 9], "big")
            at += 2 + max(size, 2)
        return None

    @F.pandas_udf("int")
    def of(s: pd.Series) -> pd.Series:
        return s.map(width).astype("Int32")

    return of


def register_udfs(spark: SparkSession) -> None:
    """Makes nfkc, normalised, token_sort_ratio, token_set_ratio, fingerprint_agreement and image_width callable from SQL."""
    spark.udf.register("nfkc", text.nfkc())
    spark.udf.register("token_sort_ratio", fuzzy.ratio_column(fuzzy.token_sort_ratio))
    spark.udf.register("token_set_ratio", fuzzy.ratio_column(fuzzy.token_set_ratio))
    spark.udf.register("fingerprint_agreement", fingerprint.agreement_column())
    spark.udf.register("image_width", image_width())
    steps = "lower(trim(nfkc(coalesce(x, ''))))"
    for pattern, by in ((text.REMARKS, " "), (text.FEATURING, ""), (text.ARABIC_MARKS, "")):
        steps = f"regexp_replace({steps}, r'{pattern}', '{by}')"
    steps = f"trim(regexp_replace(regexp_replace(translate({steps}, '{text.ARABIC_FROM}', '{text.ARABIC_TO}'), r'{text.NON_WORD}', ' '), r'\\s+', ' '))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalised(x STRING) RETURNS STRING RETURN {steps}")
