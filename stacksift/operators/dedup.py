"""Duplicate layers: equal files, equal sound, similar fingerprints, similar tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.components import star_components
from ..core.session import cut
from ..functions import fingerprint, fuzzy
from ..functions.text import normalised

TOLERANCE, SIMILAR, TITLE_RATIO = 7.0, 0.90, 88.0


def equal_groups(tracks: DataFrame, column: str) -> DataFrame:
    """(id, root) of tracks sharing a non-empty value; root is the least id. One aggregate, no self-join."""
    t = tracks.where(F.coalesce(column, F.lit("")) != "").select("id", F.col(column).alias("k")).distinct()
    g = t.groupBy("k").agg(F.min("id").alias("root"), F.count("*").alias("n")).where("n > 1")
    return t.join(g, "k").select("id", "root")


def _linked(edges: DataFrame) -> DataFrame:
    return star_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("id"), "root")


def _spread(classes: DataFrame, of_class: DataFrame) -> DataFrame:
    """Members of classes that are linked, or hold several members; root is the least id of all."""
    node = classes.join(of_class.select(F.col("id").alias("cls"), F.col("root").alias("top")), "cls", "left").select("id", F.coalesce("top", "cls").alias("top"))
    g = node.groupBy("top").agg(F.min("id").alias("root"), F.count("*").alias("n")).where("n > 1")
    return node.join(g, "top").select("id", "root")


def similar_sound(tracks: DataFrame, tolerance: float = TOLERANCE, least: float = SIMILAR) -> DataFrame:
    """(id, root): tracks (id, fingerprint, duration) whose fingerprints agree and lengths lie within the tolerance.

    Copies with the same fingerprint and length are one class, so a hot recording is compared once. Classes
    meet in blocks of duration slot and LSH band; the neighbouring slot is indexed too. Lengths travel with
    the keys, so pairs too far apart end before any fingerprint moves. Blocks have no cap: what is in one
    block shares 16 bits and a slot, and equal fingerprints are already one class.
    """
    t = tracks.where("fingerprint is not null and duration > 0").select("id", "fingerprint", "duration")
    classes = cut(_classes(t, ["fingerprint", "duration"]))
    c = classes.where("id = cls").withColumn("w", fingerprint.words(F.col("fingerprint"))).where("w is not null").select("id", "duration", "w")
    slot = F.floor(F.col("duration") / max(1.0, tolerance))
    keys = c.select("id", "duration", F.explode(fingerprint.band_keys(F.col("w"))).alias("band"), slot.alias("slot"))
    own, near = keys.select("id", "duration", "band", "slot"), keys.select(F.col("id").alias("other"), F.col("duration").alias("far"), "band", F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("slot"))
    pairs = own.join(near, ["band", "slot"]).where((F.col("id") != F.col("other")) & (F.abs(F.col("duration") - F.col("far")) <= tolerance)).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    both = pairs.join(c.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(c.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    return _spread(classes.select("id", "cls"), _linked(both.where(fingerprint.agreement_column()("wa", "wb") >= least)))


def _classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with `cls`, the least id among those alike in `keys`; aggregated first, so no task sorts a class."""
    return rows.join(rows.groupBy(*keys).agg(F.min("id").alias("cls")), keys)


def tag_block(title: Column, artist: Column) -> Column:
    """What tracks of nearly equal tags share: the first three words of the normalised title and the artist's first 24 letters."""
    return F.concat_ws("|", F.array_join(F.slice(F.split(title, " "), 1, 3), " "), F.substring(artist, 1, 24))


def similar_tags(tracks: DataFrame, tolerance: float = TOLERANCE, title_ratio: float = TITLE_RATIO) -> DataFrame:
    """(id, root): tracks (id, title, artist, albumartist, duration) of nearly equal title, artist and length.

    Tracks alike in all cleaned fields are one class. Blocks are the first three title words, the artist's
    first 24 letters and the duration slot, each class also standing in the next slot; within a block,
    classes within the tolerance whose title ratio and artist ratio suffice are linked. Clusters are the
    components over all blocks and disjoint; blocks have no cap, since equal tags are one class already.
    """
    t = tracks.select("id", normalised(F.col("title")).alias("t"), normalised(F.coalesce(F.nullif("artist", F.lit("")), F.col("albumartist"))).alias("a"), "duration").where("t <> '' and duration > 0")
    classes = cut(_classes(t, ["t", "a", "duration"]))
    c = classes.where("id = cls").select("id", "t", "a", "duration")
    head = tag_block(F.col("t"), F.col("a"))
    slot = F.floor(F.col("duration") / max(1.0, tolerance))
    x = c.select(F.col("id").alias("a_"), F.col("t").alias("ta"), F.col("a").alias("aa"), F.col("duration").alias("da"), head.alias("h"), slot.alias("slot"))
    y = c.select(F.col("id").alias("b_"), F.col("t").alias("tb"), F.col("a").alias("ab"), F.col("duration").alias("db"), head.alias("h"), F.explode(F.array(slot, slot - 1)).alias("slot"))
    p = x.join(y, ["h", "slot"]).where((F.col("a_") != F.col("b_")) & (F.abs(F.col("da") - F.col("db")) <= tolerance))
    sort_, set_ = fuzzy.ratio_column(fuzzy.token_sort_ratio), fuzzy.ratio_column(fuzzy.token_set_ratio)
    e = p.where((sort_("ta", "tb") >= title_ratio) & (set_("aa", "ab") >= title_ratio - 8))
    return _spread(classes.select("id", "cls"), _linked(e.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct()))


#: Layers in order of cost: kind, confidence, how it groups.
LAYERS = (
    ("exact_file", 1.0, lambda t: equal_groups(t, "sha256")),
    ("exact_audio", 0.99, lambda t: equal_groups(t, "audio_md5")),
    ("acoustic", 0.97, lambda t: equal_groups(t, "acoustid")),
    ("acoustic", 0.92, similar_sound),
    ("metadata", 0.80, similar_tags),
)


def layered(tracks: DataFrame, layers=LAYERS) -> DataFrame:
    """(kind, confidence, root, id): cheapest layer first; a track taken by one is left out of the later ones."""
    left, out = tracks.select(*[c for c in ("id", "sha256", "audio_md5", "acoustid", "fingerprint", "duration", "title", "artist", "albumartist") if c in tracks.columns]), None
    for kind, confidence, group in layers:
        found = cut(group(left).select(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), "root", "id"))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("id"), "id", "left_anti")
    return out


def report(clusters: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per kind: groups, files, files beyond the first, and bytes beyond the largest file of each group."""
    g = clusters.join(tracks.select("id", "size_bytes"), "id").groupBy("kind", "confidence", "root").agg(F.count("*").alias("n"), (F.sum("size_bytes") - F.max("size_bytes")).alias("reclaimable"))
    return g.groupBy("kind", "confidence").agg(F.count("*").alias("groups"), F.sum("n").alias("files"), F.sum(F.col("n") - 1).alias("duplicate_files"), F.sum("reclaimable").alias("reclaimable_bytes"))
