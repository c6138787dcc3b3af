"""Exact search: the best of all rows for each query by ratios of title and artist, without blocking that could lose it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import lcs, token_set_ratio

TITLE, ARTIST, LEAST = 0.7, 0.3, 85.0
#: Rows of the searched side and queries that one task compares.
ROWS, QUERIES = 20_000, 2_000
#: Slots of pairs of characters; queries compared together; bits of a machine word in use and characters of a text that are kept in columns (longer ones are compared singly).
GRAMS, TOGETHER, WORD, WIDE = 512, 64, 63, 128


def sorted_words(texts: pd.Series) -> list[str]:
    return [" ".join(sorted((t or "").split())) for t in texts]


class Texts:
    """A block of texts by which the LCS ratios of many queries are found at once.

    `grams` counts each text's adjacent pairs of characters (its two ends are characters, too), hashed into
    GRAMS slots: a character that isn't in the common subsequence takes two pairs from its own text or parts
    one of the other, so texts of n and m characters with a subsequence of L share 3 L - n - m + 1 pairs or more.
    """

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.length = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer("".join(f"\x02{t}\x03" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), self.length + 2)
        at = np.flatnonzero(of[:-1] == of[1:])
        slot = (flat[at] * 0x9E3779B1 ^ flat[at + 1] * 0x85EBCA77) % 1_000_003 % GRAMS
        self.grams = np.zeros((len(texts), GRAMS), np.float32)
        np.add.at(self.grams.reshape(-1), of[at] * GRAMS + slot, 1)
        letters, code = np.unique(flat, return_inverse=True)
        self.place = {chr(c): i + 1 for i, c in enumerate(letters.tolist())}
        column = np.arange(len(flat)) - np.repeat(np.cumsum(self.length + 2) - self.length - 2, self.length + 2) - 1
        inside = (column >= 0) & (column < self.length[of]) & (column < WIDE)
        self.codes = np.zeros((min(WIDE, int(self.length.max(initial=0))), len(texts)), np.int32)
        self.codes[column[inside], of[inside]] = code[inside] + 1

    def common(self, queries: list[str], q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """LCS lengths of the pairs (queries[q], texts[t]), bit by bit for all of them together."""
        masks = np.zeros((len(queries), len(self.place) + 1), np.uint64)
        for k in np.unique(q):
            if len(queries[k]) <= WORD:
                for i, c in enumerate(queries[k]):
                    if c in self.place:
                        masks[k, self.place[c]] |= np.uint64(1 << i)
        n = np.array([len(x) for x in queries], np.int64)[q]
        full = (np.uint64(1) << np.minimum(n, WORD).astype(np.uint64)) - np.uint64(1)
        s = full.copy()
        # t in falling order of length, so that each step has the first pairs only
        down = np.argsort(-self.length[t], kind="stable")
        x, y, width = q[down], t[down], -self.length[t][down]
        s, full = s[down], full[down]
        for j, row in enumerate(self.codes):
            if not (k := int(np.searchsorted(width, -j, "left"))):
                break
            m = s[:k] & masks[x[:k], row[y[:k]]]
            s[:k] = ((s[:k] + m) | (s[:k] - m)) & full[:k]
        s[down] = s.copy()
        both = n - np.bitwise_count(s).astype(np.int64)
        for i in np.flatnonzero((n > WORD) | (self.length[t] > WIDE)):
            both[i] = lcs(queries[q[i]], self.texts[t[i]])
        return both

    def near(self, queries: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Parts of all (query, text, ratio) whose ratio, 100 * 2 LCS / (both lengths) or 100 for two empty ones, is `least` or more.

        `self.texts` must be in order of length. Pairs too far apart in length or with too few common pairs of
        characters (one product of matrices tells) can't reach `least`, the others are compared in full.
        """
        share = max(0.0, least / 200 - 1e-9)
        away = lambda n: (3 * share - 1) * n.astype(np.float32)[:, None]
        one = lambda n: np.ones((n, 1), np.float32)
        right = np.hstack([self.grams, one(len(self.texts)), -away(self.length)])
        order = sorted(range(len(queries)), key=lambda k: len(queries[k]))
        for i in range(0, len(order), TOGETHER):
            part = order[i : i + TOGETHER]
            asked = Texts([queries[k] for k in part])
            a = np.searchsorted(self.length, int(asked.length[0] * share / (1 - share)), "left") if share < 1 else 0
            b = np.searchsorted(self.length, int(asked.length[-1] * (1 - share) / share) + 1, "right") if share > 0 else len(self.texts)
            spare = np.hstack([asked.grams, -away(asked.length), one(len(part))]) @ right[a:b].T
            q, t = np.nonzero(spare >= 0.99)
            total = asked.length[q] + self.length[a + t]
            whole = spare[q, t] >= 3 * (np.ceil(total * share - 1e-6) - total * share) + 0.99  # L is a whole number
            q, t, total = q[whole], a + t[whole], total[whole]
            both = self.common(asked.texts, q, t)
            ratios = np.where(total > 0, 200.0 * both / np.maximum(total, 1), 100.0)
            keep = ratios >= least - 1e-9
            yield np.array(part)[q[keep]], t[keep], ratios[keep]


def best_matches(queries: DataFrame, rows: DataFrame, least: float = LEAST, rows_a_task: int = ROWS, queries_a_task: int = QUERIES) -> DataFrame:
    """(query_id, id, score): for each of `queries` (query_id, title, artist) the best of `rows` (id, title, artist).

    The score is 0.7 of the titles' ratio with their words in order and 0.3 of the artists' word-set ratio; only
    `least` or more is a match, ties go to the smaller id. Every query meets every row, in blocks of bounded
    size, so nothing is lost to blocking; a row whose title alone rules the score out isn't compared further.
    Titles and artists should be normalised; null counts as ''. Rows alike in both fields are compared once; where
    equal titles don't do, those without an artist match nothing and are left out.
    Empty tables give an empty result.
    """
    r = rows.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("artist", F.lit("")).alias("artist")).groupBy("title", "artist").agg(F.min("id").alias("id"))
    q = queries.select("query_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("artist", F.lit("")).alias("artist")).where("query_id is not null").distinct()
    if TITLE * 100 < least:  # without an artist a side's word-set ratio is 0
        r, q = r.where("trim(artist) <> ''"), q.where("trim(artist) <> ''")
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-r.count() // rows_a_task))
    blocks = max(1, -(-q.count() // queries_a_task))
    each = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    left = r.withColumn("p", F.pmod(F.xxhash64("title", "artist"), F.lit(parts)).cast("int")).select("*", each(blocks, "b"))
    right = q.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).select("*", each(parts, "p"))

    def compare(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(asked):
            titles = pd.Series(sorted_words(found["title"]))
            found = found.assign(title=titles.to_numpy(), n=titles.str.len().to_numpy()).sort_values(["n", "id"], ignore_index=True)
            texts, artists, ids = Texts(found["title"].tolist()), found["artist"].tolist(), found["id"].to_numpy()
            keys, asking = asked["query_id"].tolist(), asked["artist"].tolist()
            for q, t, ratios in texts.near(sorted_words(asked["title"]), (least - ARTIST * 100) / TITLE):
                by_title = TITLE * ratios
                order = np.lexsort((ids[t], -by_title, q))
                best: dict[int, tuple[float, int, float]] = {}
                for k, i, x in zip(q[order].tolist(), t[order].tolist(), by_title[order].tolist(), strict=True):
                    top = best.get(k)
                    most = round(x + ARTIST * 100, 9)
                    if top and (most, -int(ids[i])) < top[:2]:
                        continue
                    x += ARTIST * token_set_ratio(asking[k], artists[i])
                    if x >= least and (top is None or (round(x, 9), -int(ids[i])) > top[:2]):
                        best[k] = (round(x, 9), -int(ids[i]), x)
                out += [(keys[k], -i, x) for k, (_, i, x) in best.items()]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    # a stated number of tasks, as adaptive execution would gather these small, costly rows into a few
    tasks = min(parts * blocks, 20 * spark.sparkContext.defaultParallelism)
    pairs = left.repartition(tasks, "p", "b").groupBy("p", "b").cogroup(right.repartition(tasks, "p", "b").groupBy("p", "b")).applyInPandas(compare, "query_id bigint, id bigint, score double")
    return pairs.groupBy("query_id").agg(F.max_by(F.struct("id", "score"), F.struct(F.round("score", 9), -F.col("id"))).alias("w")).select("query_id", "w.id", F.round("w.score", 4).alias("score"))


