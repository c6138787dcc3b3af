"""Problem 7: pairwise matches consolidated into groups by hierarchical union-find.

Each edge partition keeps only the spanning forest of what it has seen; forests are merged through fewer
and fewer partitions, each bounded by `bound` edges. Forests that bounded partitions can't make smaller are
contracted: nodes that are nowhere a root drop out, what links the roots is the next level's graph, and
its forests are built and merged in turn, until one bounded partition holds the rest.
Going back down the levels gives every node its component, so no size needs a larger task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.session import cut

#: Non-track nodes (groups, lists) are coded above every track id; ids must lie within +-MOST_ID, which is checked.
HYPER, MOST_ID = 1 << 61, 1 << 60


def union_find(u: np.ndarray, v: np.ndarray, seed: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning star forest of the edges: (node, root) for node != root, the root being the least node.

    With a seed, the root is the least in an order of that seed instead, so that no numbering of the nodes
    makes each of them a root somewhere. Array union-find: every round hooks the later root of each open
    edge under the earlier one and then halves all paths until they are flat.
    """
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    if seed is not None:
        mixed = (nodes.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(mixed ^ (mixed >> np.uint64(32)), kind="stable")
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        nodes, inv = nodes[order], place[inv]
    a, b = inv[: len(u)], inv[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        ra, rb = parent[a], parent[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def _forests(seed: int | None):
    def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partition's spanning forest; edges are buffered only up to the size of the forest so far."""
        u = v = np.empty(0, np.int64)
        more, waiting = [], 0
        for batch in batches:
            more.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            waiting += batch.num_rows
            if waiting > max(250_000, len(u)):
                u, v = union_find(np.concatenate([u, *(x for x, _ in more)]), np.concatenate([v, *(y for _, y in more)]), seed)
                more, waiting = [], 0
        u, v = union_find(np.concatenate([u, *(x for x, _ in more)]).astype(np.int64), np.concatenate([v, *(y for _, y in more)]).astype(np.int64), seed)
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(v[i : i + 100_000])], names=["u", "v"])

    return spanning


def forest(edges: DataFrame, seed: int | None = None) -> DataFrame:
    """The spanning forests of the partitions of `edges` (u, v BIGINT, not null) as they lie."""
    return edges.select("u", "v").mapInArrow(_forests(seed), "u bigint, v bigint")


def contracted(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels (node, label), edges (u, v)): the forests `f` (u, root v) of all partitions without their leaves.

    A node that is a root anywhere keeps itself as label; any other one takes one of its roots, which stay
    linked to each other in its place. So two labels are linked just where their nodes are; labels without
    edges are finished components.
    """
    ends = f.select(F.col("u").alias("node"), F.col("v").alias("r"), F.lit(False).alias("is_root")).unionByName(f.select(F.col("v").alias("node"), F.lit(None).cast("bigint").alias("r"), F.lit(True).alias("is_root")))
    labels = cut(ends.groupBy("node").agg(F.min("r").alias("r"), F.bool_or("is_root").alias("is_root")).select("node", F.when(F.col("is_root"), F.col("node")).otherwise(F.col("r")).alias("label")))
    e = f.join(labels.withColumnRenamed("node", "u"), "u").where("label <> v")
    return labels, e.select(F.greatest("label", "v").alias("u"), F.least("label", "v").alias("v")).distinct()


def consolidate(edges: DataFrame, bound: int = 4_000_000, fan_in: int = 8) -> DataFrame:
    """(node, root) for every node linked to another one by `edges` (u, v BIGINT); root is the least of its component.

    Nulls and self-loops link nothing; repeated and reversed edges count once; other columns are ignored.
    An empty input gives an empty result. `bound` is the number of edges that one task may hold; it says how
    many levels the hierarchy has, not what comes out.
    """
    e = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    f, levels = cut(forest(e)), []
    n, parts = f.count(), max(1, f.rdd.getNumPartitions())
    while True:
        least = max(1, math.ceil(n / bound))
        parts = max(least, parts // fan_in)
        f = forest(f.repartition(parts, "u"), None if parts == 1 else len(levels))
        if parts == 1:
            break
        f = cut(f)
        n = f.count()
        if parts == least and n > bound:
            labels, f = contracted(f)
            levels.append(labels)
            f = cut(f)
            n = f.count()
    tree = f.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(f.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    if not levels:
        return tree
    for labels in reversed(levels):
        tree = labels.join(tree.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("root"))
    tree = cut(tree)
    least_of = tree.groupBy("root").agg(F.min("node").alias("low"))  # a label is any node of its component
    return tree.join(least_of, "root").select("node", F.col("low").alias("root"))


def _checked(c: str):
    """An id that is known to lie below the codes of groups and lists."""
    return F.when(F.abs(c) < MOST_ID, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} beyond +-2**60: "), F.col(c).cast("string"))))


def membership_edges(members: DataFrame, lists: DataFrame, tracks: DataFrame) -> DataFrame:
    """Edges between tracks and the groups (group_id, track_id) or lists (track_ids) that hold them.

    A group or list becomes a node of its own, so one of any size gives as many edges as members and
    never pairs. Lists are numbered, not hashed: the distinct lists are written once and their place in what
    was written is their number, so different lists never share a node. Ids without a row in `tracks` (id),
    nulls and empty lists give no edge; a list held by several rows, in whatever order, is one node. Track
    and group ids beyond +-2**60 are refused with an error.
    """
    by_group = members.where("group_id is not null and track_id is not null").select(F.col("track_id").alias("u"), (F.lit(HYPER) + _checked("group_id") * 2).cast("bigint").alias("v"))
    whole = cut(lists.select(F.array_sort(F.array_distinct(F.array_compact("track_ids"))).alias("ids")).where("size(ids) > 1").distinct())
    by_list = whole.select("ids", (F.lit(HYPER) + F.monotonically_increasing_id() * 2 + 1).cast("bigint").alias("v")).select(F.explode("ids").alias("u"), "v")
    there = tracks.select(F.col("id").alias("u")).where("u is not null").distinct()
    return by_group.unionByName(by_list).distinct().join(there, "u", "left_semi").select(_checked("u").alias("u"), "v")


def track_groups(members: DataFrame, lists: DataFrame, tracks: DataFrame, bound: int = 4_000_000) -> DataFrame:
    """(group_root, track_id): every track that hangs together with another one; the root has a row too."""
    tree = consolidate(membership_edges(members, lists, tracks), bound).where(F.col("node") < MOST_ID)
    tied = tree.where("node <> root").select(F.col("root").alias("group_root"), F.col("node").alias("track_id"))
    return tied.unionByName(tied.select("group_root", F.col("group_root").alias("track_id")).distinct())
