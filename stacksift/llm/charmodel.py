"""Character statistics of a corpus of short values, shared by the operators on characters."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Word ends in the pair counts.
START, END = "\x02", "\x03"
#: Pairs a model may hold: the square of the characters in use, not of the corpus; checked when it is built.
MOST_PAIRS = 4_000_000

#: Characters nobody sees (fixed values): soft hyphen, Arabic letter mark, zero-width and direction marks, joiners, BOM.
IGNORABLE = {0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x2066, 0x2067, 0x2068, 0x2069, 0x3164, 0xFEFF, 0xFFA0}
#: Hyphens that look like the ordinary one (fixed values).
HYPHENS = {0x2010, 0x2011, 0x2043, 0x2212, 0xFE63, 0xFF0D}
_COMPAT = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


def is_ignorable(c: str) -> bool:
    return ord(c) in IGNORABLE or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0000 <= ord(c) <= 0xE007F


_plain_of: dict[str, str] = {}


def plain_char(c: str) -> str:
    """The character(s) a plain spelling has in place of `c`, before look-alike letters are told apart."""
    known = _plain_of.get(c)
    if known is not None:
        return known
    out = c
    if is_ignorable(c):
        out = ""
    elif unicodedata.category(c) == "Zs":
        out = " "
    elif ord(c) in HYPHENS:
        out = "-"
    else:
        d = unicodedata.decomposition(c)
        if d.startswith(_COMPAT):
            out = unicodedata.normalize("NFKC", c)
        elif d.startswith("<compat>"):  # ligatures and letter-like numbers, not signs that are their own
            full = unicodedata.normalize("NFKC", c)
            out = full if full.isalpha() and unicodedata.category(c)[0] in "LN" else c
        elif d and not d.startswith("<") and " " not in d:  # singletons such as the Kelvin sign
            out = unicodedata.normalize("NFC", c)
    _plain_of[c] = out
    return out


class _Plain(dict):
    """`plain_char` by code point, for str.translate."""

    def __missing__(self, code: int) -> str:
        self[code] = out = plain_char(chr(code))
        return out


_plain_table = _Plain()


def plain(text: str) -> str:
    """Compatibility-normalised, composed, without ignorable characters, with ordinary spaces and hyphens."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_plain_table))


def pairs_of(s: str) -> list[str]:
    """Adjacent pairs of characters."""
    return list(map(add, s[:-1], s[1:]))


def pair_counts(values: DataFrame, keep=None) -> dict[str, int]:
    """Adjacent-pair counts over the distinct non-null `values` (value STRING), each word between START and END.

    `keep`, a function of the value, tells what counts as clean. Counting is map-side; what comes to the
    driver is bounded by the square of the characters in use and checked against MOST_PAIRS.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for v in b.column(0).to_pylist():
                if v and (keep is None or keep(v)):
                    s = START + plain(v).replace(" ", END + START) + END
                    n.update(pairs_of(s))
        n.pop(END + START, None)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["pair", "n"])

    distinct = values.where("value is not null and value <> ''").select("value").distinct()
    sums = distinct.mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    got = sums.limit(MOST_PAIRS + 1).collect()
    if len(got) > MOST_PAIRS:
        raise ValueError("more character pairs than a model may hold")
    return {r["pair"]: r["n"] for r in got}


def values_of(df: DataFrame, *columns: str) -> DataFrame:
    """(value) of several columns below each other."""
    return reduce(DataFrame.unionByName, [df.select(F.col(c).alias("value")) for c in columns])


def gathered(rows: DataFrame, *columns: str, rows_a_task: int = 25_000) -> DataFrame:
    """`rows` in ranges of the columns, so that equal values reach one worker and are worked on once.

    The last column should tell rows apart: ranges then cut a hot value's rows into several tasks.
    """
    n = max(1, -(-rows.count() // rows_a_task))
    return rows.repartitionByRange(n, *columns)


class PairModel:
    """Log-likelihoods and mutual information of adjacent characters."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.pair = counts
        self.left, self.right = Counter(), Counter()
        for p, n in counts.items():
            self.left[p[0]] += n
            self.right[p[1]] += n
        self.n = max(1, sum(counts.values()))
        self.kinds = len(self.right) + 200
        self._log: dict[str, float] = {}
        self._info: dict[str, float] = {}
        self.scores: dict[str, float] = {}
        self.options: dict[tuple[str, bool], list] = {}

    def log(self, pair: str) -> float:
        """log P(second | first), interpolated with the second's own share."""
        x = self._log.get(pair)
        if x is None:
            a = self.left.get(pair[0], 0)
            own = (self.right.get(pair[1], 0) + 0.05) / (self.n + 0.05 * self.kinds)
            x = self._log[pair] = math.log((self.pair.get(pair, 0) + 4 * own) / (a + 4))
        return x

    def of(self, text: str) -> float:
        """Log-likelihood of a text, word by word."""
        pairs = pairs_of(START + text.replace(" ", END + START) + END)
        known = list(map(self._log.get, pairs))
        return sum(map(self.log, pairs)) if None in known else sum(known)

    def info(self, pair: str) -> float:
        """The pair's share of the corpus mutual information in bits; 0 for pairs seen no more than by chance."""
        x = self._info.get(pair)
        if x is None:
            c = self.pair.get(pair, 0)
            x = 0.0
            if c:
                x = max(0.0, c / self.n * math.log2(c * self.n / (self.left[pair[0]] * self.right[pair[1]])))
            self._info[pair] = x
        return x
