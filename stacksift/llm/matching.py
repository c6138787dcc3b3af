"""Problem 1: matching entities across sources without keys.

Tracks and candidates become profiles of cleaned title, version, album, artist and duration. Attributes
and pairs of attributes that two profiles share link them in a candidate graph weighted by rarity;
meta-blocking prunes each candidate's weaker edges; pair similarity is then refined by the similarity of
neighbouring pairs (same albums, same artists) until the accepted pairs are stable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core.session import cut
from .charmodel import PairModel, gathered
from .encoding import clean_model, judge
from .lookalike import consistent
from .names import FILLERS, TITLES, fold, ratio

#: Words in brackets that make another version of a song (fixed values); all other bracketed words are noise.
VERSIONS = ("live", "remix", "acoustic", "instrumental", "demo", "karaoke", "radio edit", "extended", "unplugged", "a cappella", "cover", "edit", "mix")
#: Seconds within which two copies of one recording lie, and the width of a duration slot.
TOLERANCE = 3.6
#: An edge is kept if its weight is at least this share of its candidate's heaviest edge.
PRUNE = 0.12
#: Confidence from which a pair is a match; share of it that comes from the neighbours; sum of theirs that is full support.
ACCEPT, NEIGHBOUR, SUPPORT = 0.8, 0.1, 1.7

_NUMBER = re.compile(r"^\s*(?:\d{1,3}\s*[-.)]+\s*|0\d\s+)")
_YEAR = re.compile(r"^\s*(?:19|20)\d\d\s*-\s*")
_BRACKET = re.compile(r"[(\[]([^)\]]*)(?:[)\]]|$)")
_DISC = re.compile(r"\s+(?:cd|disc|disk)\s*\d+\s*$")
_TAIL = re.compile(r"\s+-\s+(?:album version|single version)\s*$")


def clean_text(value: str | None, model: PairModel | None) -> str:
    """A value as it was meant: encoding repaired, in one form, folded to Latin lower case; '' for null."""
    if not value:
        return ""
    text = value
    if model is not None and not value.isascii():
        garbled, restored, _ = judge(value, model)
        text = restored or value if garbled else consistent(value, model) or value
    return fold(text).replace("_", " ")


def clean_title(value: str | None, model: PairModel | None = None) -> tuple[str, str]:
    """(core, version) of a title: numbering and noise dropped, letters and digits only."""
    t = _TAIL.sub("", _NUMBER.sub("", clean_text(value, model)))
    version = ""
    for inner in _BRACKET.findall(t):
        words = inner.strip()
        version = version or next((v for v in VERSIONS if words == v or words.endswith(" " + v) or words.startswith(v + " ") or len(words) >= 3 and v.startswith(words) or len(words) >= 4 and ratio(words, v) >= 0.8), "")
    return _words(_BRACKET.sub(" ", t)) or _words(t), version


def _words(text: str) -> str:
    """Words of letters and digits with single spaces; apostrophes join."""
    return " ".join(re.findall(r"\w+", re.sub("['’`´]", "", text)))


def title_ratio(a: str, b: str) -> float:
    """LCS ratio of two titles; half of it where one word for word of them is another one rather than mistyped."""
    if a == b:
        return 1.0
    r = ratio(a, b)
    x, y = a.split(), b.split()
    if len(x) == len(y) and any(p != q and max(len(p), len(q)) > 3 and ratio(p, q) < 0.6 for p, q in zip(x, y, strict=True)):
        return r / 2
    return r


def clean_album(value: str | None, model: PairModel | None = None) -> str:
    """An album without year, disc, edition and punctuation; a volume number stays."""
    t = clean_text(value, model)
    core = re.sub(r"\W+", "", _DISC.sub("", _BRACKET.sub(" ", _YEAR.sub("", t))))
    return core or re.sub(r"\W+", "", t)


def clean_artist(value: str | None, model: PairModel | None = None) -> str:
    """An artist's words in order of length, joined; '' for null and collective values."""
    t = clean_text(value, model)
    if t in ("various artists", "various", "va"):
        return ""
    words = [w for w in re.findall(r"[^\W_]+", re.sub(r"\([^)]*\)", " ", t)) if w not in FILLERS and w not in TITLES and len(w) > 1]
    return " ".join(sorted(words, key=lambda w: (-len(w), w)))


def seconds(text: Column) -> Column:
    """Seconds of a length in words: h:m:s, m:s, ISO 8601, 'x min y s', seconds or (from 10,000 on) milliseconds; null if unreadable."""
    t = F.lower(F.trim(text))
    part = lambda p: F.coalesce(F.regexp_extract(t, p, 1).try_cast("double"), F.lit(0.0))
    number = F.regexp_replace(t, r"\s*(?:s|sec|seconds|ms)$", "").try_cast("double")
    clock = F.split(t, ":")
    return (
        F.when(t.rlike(r"^\d+(:\d+(\.\d+)?){1,2}$"), F.aggregate(F.transform(clock, lambda x: x.try_cast("double")), F.lit(0.0), lambda a, x: a * 60 + x))
        .when(t.rlike(r"^pt(\d+h)?(\d+m)?([\d.]+s)?$"), part(r"(\d+)h") * 3600 + part(r"(\d+)m") * 60 + part(r"([\d.]+)s$"))
        .when(t.rlike(r"\d\s*(min|m)\b"), part(r"(\d+)\s*h") * 3600 + part(r"(\d+)\s*m") * 60 + part(r"(\d+)\s*s"))
        .when(number > 0, F.when(t.endswith("ms") | (number >= 10000), number / 1000).otherwise(number))
    )


_CLEAN = "struct<title: string, version: string, album: string, artist: string>"


def _cleaned(spark, model: PairModel):
    shared = spark.sparkContext.broadcast(model.pair)

    @F.pandas_udf(_CLEAN)
    def cleaned(titles: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = PairModel(shared.value)
        memory: dict = {}

        def once(f, v):
            r = memory.get((f, v))
            if r is None:
                if len(memory) > 300_000:
                    memory.clear()
                r = memory[f, v] = f(v, m)
            return r

        for t, a, r in titles:
            rows = [(*once(clean_title, x), once(clean_album, y), once(clean_artist, z)) for x, y, z in zip(t, a, r, strict=True)]
            yield pd.DataFrame(rows, columns=["title", "version", "album", "artist"])

    return cleaned


def profiles(rows: DataFrame, key: str, seconds_: Column, model: PairModel) -> tuple[DataFrame, DataFrame]:
    """(profiles (id, title, version, album, artist, sec), members (id, key)): rows alike in all cleaned fields are one profile."""
    clean = _cleaned(rows.sparkSession, model)
    slim = rows.select(F.col(key).cast("bigint").alias("key"), "title", "album", F.coalesce(F.nullif("artist", F.lit("")), F.col("albumartist")).alias("artist"), F.round(seconds_, 1).alias("sec")).where("key is not null and title is not null")
    read = gathered(slim, "album", "title", "key").select("key", clean("title", "album", "artist").alias("c"), F.when(F.col("sec") > 0, F.col("sec")).alias("sec"))
    # filters wait for the checkpoint: before it, Spark would push them, and the cleaning, below the exchange
    read = cut(read).select("key", "c.*", "sec").where("title <> ''").withColumn("id", F.xxhash64("title", "version", "album", "artist", F.coalesce("sec", F.lit(-1.0))))
    # every field is a grouping key, so all uses of the profiles share one exchange
    return read.select("id", "title", "version", "album", "artist", "sec").distinct(), read.select("id", "key").distinct()


def attributes(p: DataFrame, spread: bool) -> DataFrame:
    """(id, attr, extra) of each profile: pairs of cleaned fields, so that one noisy field leaves others to share.

    A title enters whole or by one of its ends, so that a typing error in the other end still meets. Durations
    enter as slots of TOLERANCE; one side (`spread`) also takes the neighbouring slots, so any
    two lengths within the tolerance share one.
    """
    slot = F.floor(F.col("sec") / TOLERANCE).cast("int")
    slots = F.when(F.col("sec").isNull(), F.array().cast("array<int>")).otherwise(F.array(slot - 1, slot, slot + 1) if spread else F.array(slot))
    words = F.when(F.col("artist") == "", F.array().cast("array<string>")).otherwise(F.slice(F.split("artist", " "), 1, 2))
    key = lambda tag, *c: F.xxhash64(F.lit(tag), *c)
    album = lambda *k: F.when(F.col("album") != "", F.array(*k)).otherwise(F.array().cast("array<bigint>"))
    attrs = F.concat(
        album(key("ta", "title", "album"), key("ah", "album", F.substring("title", 1, 6)), key("at", "album", F.substring("title", -6, 6))),
        F.when(F.col("album") != "", F.transform(slots, lambda s: key("as", F.col("album"), s))).otherwise(F.array().cast("array<bigint>")),
        F.transform(slots, lambda s: key("ts", F.col("title"), s)),
        F.transform(F.slice(words, 1, 1), lambda w: key("tw", F.col("title"), w)),
        F.flatten(F.transform(F.slice(words, 1, 1), lambda w: F.transform(slots, lambda s: key("wt", w, s, F.substring("title", 1, 2))))),
    )
    ends = lambda w, s: F.array(key("wt", w, s, F.substring("title", 1, 2)), key("we", w, s, F.right("title", F.lit(3))))
    more = F.concat(
        F.transform(F.slice(words, 2, 1), lambda w: key("tw", F.col("title"), w)),
        F.flatten(F.transform(words, lambda w: F.flatten(F.transform(slots, lambda s: ends(w, s))))),
        F.when(F.col("album") != "", F.transform(words, lambda w: key("aw", F.col("album"), w, F.substring("title", 1, 4)))).otherwise(F.array().cast("array<bigint>")),
    )
    tagged = lambda a, extra: F.transform(F.array_distinct(a), lambda x: F.struct(x.alias("attr"), F.lit(extra).alias("extra")))
    return p.select("id", F.explode(F.concat(tagged(attrs, False), tagged(F.array_except(more, attrs), True))).alias("x")).select("id", "x.attr", "x.extra")


def candidate_graph(left: DataFrame, right: DataFrame, prune: float = PRUNE) -> DataFrame:
    """(l, r, weight): pairs of profiles sharing attributes; an attribute weighs log(right profiles / those that bear it).

    Of each right profile's edges, those lighter than `prune` times its heaviest one, `extra` attributes of
    the artist not counted in that (else pairs without an artist would fall to them), are cut (meta-blocking
    by weight); no number of edges is capped. Attributes are pairs of fields, hence rare, and a hot recording
    is a few profiles, not its copies. The smaller, right side spreads over neighbouring duration slots. All
    that follows the join is partitioned by the right profile, so the edges are shuffled once.
    Here as in all of this module's joins both sides grow with the input and Spark takes exploded attributes
    for a few per cent of their size, so the hints keep it from broadcasting them.
    """
    a, b = attributes(left, False), attributes(right, True)
    n = F.lit(float(max(2, right.count())))
    weight = b.groupBy("attr").agg(F.count("*").alias("n")).select("attr", (F.log(n / F.col("n")) + 0.1).alias("w"))
    shared = b.join(weight.hint("merge"), "attr").withColumnRenamed("id", "r").join(a.select(F.col("id").alias("l"), "attr", F.col("extra").alias("lextra")).hint("merge"), "attr").select("r", "l", "w", F.when(~F.col("extra") & ~F.col("lextra"), F.col("w")).otherwise(0.0).alias("own"))
    e = shared.repartition("r").groupBy("r", "l").agg(F.sum("w").alias("weight"), F.sum("own").alias("own"))
    # a window, as a join of the heaviest edges would make Spark compute all edges twice
    return e.withColumn("top", F.max("own").over(W.partitionBy("r"))).where(F.col("weight") >= prune * F.col("top")).select("l", "r", "weight")


def _similarities():
    @F.pandas_udf("struct<title: double, album: double, artist: double>")
    def similar(t: pd.Series, u: pd.Series, a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        memory: dict = {}

        def r(p: str, q: str) -> float | None:
            if not p or not q:
                return None
            if p == q:
                return 1.0
            k = memory.get((p, q))
            if k is None:
                k = memory[p, q] = ratio(p, q)
            return k

        def vol(p: str, q: str) -> float | None:
            s = r(p, q)
            if s is not None and s < 1 and re.findall(r"vol(\d+)$", p) != re.findall(r"vol(\d+)$", q) and "vol" in p and "vol" in q:
                return 0.0
            return s

        def who(p: str, q: str) -> float | None:
            s = r(p, q)
            if s is None or s == 1:
                return s
            return max([s] + [r(v, w) for v in p.split()[:2] for w in q.split()[:2] if len(v) > 3 and len(w) > 3])

        return pd.DataFrame({"title": [title_ratio(p, q) for p, q in zip(t, u, strict=True)], "album": [vol(p, q) for p, q in zip(a, b, strict=True)], "artist": [who(p, q) for p, q in zip(x, y, strict=True)]}, dtype="float64")

    return similar


def score_pairs(graph: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, near, rt, own): the pairs that may match at all, with their own confidence from their attributes.

    Versions must agree and known lengths lie within TOLERANCE. Where an album is missing the artist stands
    in for it, at a discount; what neither side knows counts as half known.
    """
    side = lambda p, s: p.select(F.col("id").alias(s), *[F.col(c).alias(s + c) for c in ("title", "version", "album", "artist", "sec")]).hint("merge")
    p = graph.join(side(left, "l"), "l").join(side(right, "r"), "r").where("lversion = rversion").where(F.coalesce(F.abs(F.col("lsec") - F.col("rsec")) <= TOLERANCE, F.lit(True)))
    p = p.withColumn("s", _similarities()("ltitle", "rtitle", "lalbum", "ralbum", "lartist", "rartist"))
    t, a, w = F.col("s.title"), F.col("s.album"), F.col("s.artist")
    length = F.when(F.col("lsec").isNull() | F.col("rsec").isNull(), F.lit(0.5)).otherwise(1 - F.abs(F.col("lsec") - F.col("rsec")) / (4 * TOLERANCE))
    place = F.coalesce(a, w * 0.85, F.lit(0.4))
    own = 0.42 * t + 0.33 * place + 0.25 * length
    own = own * F.when(w.isNull(), 0.98).otherwise(0.8 + 0.2 * w)
    # without both albums a pair needs its length and a title as good as equal
    sure = (t >= 0.72) & F.when(a.isNotNull(), a >= 0.7).otherwise((t >= 0.9) & F.col("lsec").isNotNull() & F.col("rsec").isNotNull() & F.coalesce(w >= 0.75, F.lit(False)))
    near = F.when(a.isNotNull(), F.xxhash64(F.lit("albums"), "lalbum", "ralbum")).otherwise(F.xxhash64(F.lit("artists"), "lartist", "rartist"))
    return p.where(sure).select("l", "r", near.alias("near"), F.xxhash64("rtitle").alias("rt"), own.alias("own"))


def propagate(pairs: DataFrame) -> DataFrame:
    """(l, r, confidence): own confidence refined by that of the neighbours until no pair changes sides.

    `pairs` has l, r, own, near (what its neighbours share: the two albums, or the two artists where an album
    is missing) and rt (the right title). A pair's neighbours vouch for it with the best confidence of each
    title that is a match, summed over the titles of `near`; SUPPORT of it is full support. The first round
    takes every pair to be fully supported; confidence grows with support and support with confidence, so
    from there on matches can only fall away, and the rounds end when none does: always, and at the largest
    set of matches that support each other.
    """
    p, before, support = cut(pairs), None, None
    while True:
        conf = p.withColumn("confidence", F.col("own") * (1 - NEIGHBOUR) + NEIGHBOUR) if support is None else _supported(p, support)
        best = conf.where(F.col("confidence") >= ACCEPT).groupBy("near", "rt").agg(F.max("confidence").alias("best"), F.count("*").alias("n"))
        support = cut(best.groupBy("near").agg(F.sum("best").alias("sum"), F.sum("n").alias("n")))
        now = support.agg(F.sum("n")).first()[0]
        if now == before:
            return _supported(p, support).select("l", "r", "confidence")
        before = now


def _supported(p: DataFrame, support: DataFrame) -> DataFrame:
    s = F.least(F.lit(1.0), F.coalesce("sum", F.lit(0.0)) / SUPPORT)
    return p.join(support.select("near", "sum").hint("merge"), "near", "left").withColumn("confidence", F.col("own") * (1 - NEIGHBOUR) + NEIGHBOUR * s)


def match_candidates(tracks: DataFrame, candidates: DataFrame, model: PairModel | None = None) -> DataFrame:
    """Distinct (track_id, candidate_id, confidence) of tracks and candidates that are the same recording.

    `tracks` has id, title, album, artist, albumartist and duration (s), `candidates` candidate_id, title,
    album, artist, albumartist and length_text. Records without a title match nothing; other nulls count as
    unknown. All copies of a recording match; repeated rows count once; empty tables give an empty result.
    """
    model = model or clean_model(tracks)
    left, of_left = profiles(tracks, "id", F.col("duration"), model)
    right, of_right = profiles(candidates, "candidate_id", seconds(F.col("length_text")), model)
    graph = candidate_graph(left, right)
    found = propagate(score_pairs(graph, left, right)).where(F.col("confidence") >= ACCEPT)
    found = found.select("l", "r", F.round("confidence", 4).alias("confidence"))
    return found.join(of_left.select(F.col("id").alias("l"), F.col("key").alias("track_id")).hint("merge"), "l").join(of_right.select(F.col("id").alias("r"), F.col("key").alias("candidate_id")).hint("merge"), "r").select("track_id", "candidate_id", "confidence").distinct()
