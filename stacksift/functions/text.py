"""Text functions as Columns, with the SQL of each for the oracle."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bracketed remarks that are no part of a title, and what introduces guests (fixed values).
REMARKS = r"\((?:official|audio|video|lyrics?|hd|hq|remaster(?:ed)?|explicit|clean|radio edit|album version|bonus track)[^)]*\)|\[(?:official|audio|video|lyrics?|remaster(?:ed)?)[^\]]*\]"
FEATURING = r"\s*[\(\[]?\b(?:feat|ft|featuring)\b.*$"
#: Arabic marks and the letters that are written in several ways (fixed values).
ARABIC_MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
ARABIC_FROM, ARABIC_TO = "أإآٱىئؤة", "ااااييوه"
NON_WORD = r"[^\p{L}\p{N}_\s]"


def nfkc():
    """A pandas UDF to Unicode compatibility form; Spark has no built-in for it."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return composed


def composed(text: Column) -> Column:
    """`text` in compatibility form; only values with a character beyond ASCII leave the JVM."""
    return F.coalesce(nfkc()(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)


def normalised(text: Column) -> Column:
    """Letters and digits of a title or name: compatibility form, lower case, remarks and guests dropped, Arabic spellings folded, single spaces; null gives ''."""
    t = F.lower(F.trim(composed(F.coalesce(text, F.lit("")))))
    t = F.regexp_replace(F.regexp_replace(t, REMARKS, " "), FEATURING, "")
    t = F.translate(F.regexp_replace(t, ARABIC_MARKS, ""), ARABIC_FROM, ARABIC_TO)
    return F.trim(F.regexp_replace(F.regexp_replace(t, NON_WORD, " "), r"\s+", " "))


def normalised_sql(c: str) -> str:
    """The same of a column that is in compatibility form."""
    t = f"lower(regexp_replace(trim(coalesce({c}, '')), '(\\p{{L}})Σ($|[^\\p{{L}}])', '\\1ς\\2', 'g'))"
    t = f"regexp_replace(regexp_replace({t}, '{REMARKS}', ' ', 'g'), '{FEATURING}', '')"
    t = f"translate(regexp_replace({t}, '{ARABIC_MARKS}', '', 'g'), '{ARABIC_FROM}', '{ARABIC_TO}')"
    return f"trim(regexp_replace(regexp_replace({t}, '{NON_WORD}', ' ', 'g'), '\\s+', ' ', 'g'))"


def tokens(text: Column) -> Column:
    """Search tokens: runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def year_in(text: Column) -> Column:
    """The first four digits if they lie in 1860..2200, else null."""
    y = F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit("")).cast("int")
    return F.when(y.between(1860, 2200), y)


def leading_int(text: Column) -> Column:
    """The number at the start of a text, else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*(\d+)", 1), F.lit("")).cast("bigint")


def pair_of(text: Column) -> Column:
    """'3/12' as struct(number, total); either may be null."""
    second = F.nullif(F.regexp_extract(text, r"^\s*\d+\s*/\s*(\d+)", 1), F.lit("")).cast("bigint")
    return F.struct(leading_int(text).alias("number"), second.alias("total"))


def human_bytes(n: Column) -> Column:
    """1536 -> '1.50 KB', up to TB."""
    step = lambda k: F.format_string("%.2f %s", n / F.lit(float(1024**k)), F.lit(("B", "KB", "MB", "GB", "TB")[k]))
    out = F.when(n < 1024, step(0))
    for k in (1, 2, 3):
        out = out.when(n < 1024 ** (k + 1), step(k))
    return out.otherwise(step(4))


def clock(sec: Column) -> Column:
    """215.3 -> '3:35'; null stays null."""
    s = F.floor(sec)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def lrc_stamp(ms: Column) -> Column:
    """Milliseconds as '[mm:ss.cc]'."""
    part = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    minutes = F.floor(ms / 60000).cast("bigint")
    return F.concat(F.lit("["), F.when(minutes < 10, "0").otherwise(""), minutes.cast("string"), F.lit(":"), part(F.floor(ms / 1000) % 60), F.lit("."), part(F.floor(ms % 1000 / 10)), F.lit("]"))


#: A time stamp in lyrics (fixed value).
STAMP = r"\[\d{1,3}:\d{2}(?:[.:]\d{1,3})?\]"


def strip_lrc(text: Column) -> Column:
    """Lyrics without their time stamps and blank lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, STAMP, "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def is_timed(text: Column) -> Column:
    """Whether lyrics have three lines or more that begin with a time stamp; false for null."""
    return F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"^{STAMP}"))) >= 3, F.lit(False))


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first letter, the others small."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)")), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), "")


def lucene_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def redacted(text: Column, secrets: list[str]) -> Column:
    """Log text with every secret of six characters or more replaced by ***."""
    for s in secrets:
        if len(s) >= 6:
            text = F.replace(text, F.lit(s), F.lit("***"))
    return text


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]))
