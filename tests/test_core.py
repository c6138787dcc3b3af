"""Orphan cascade and components on small fixtures."""

import random

from stacksift.core.components import star_components
from stacksift.core.orphans import Reference, orphan_cascade, orphans_by_period

ROW = "id bigint, parent bigint, table_name string"


def test_cascade_reports_direct_and_inherited(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 9, "x")], ROW)  # 2 dangles
    b = spark.createDataFrame([(10, 1, "y"), (11, 2, "y"), (12, 7, "y"), (12, 7, "y"), (13, None, "y")], ROW)
    c = spark.createDataFrame([(20, 11, "z"), (21, 12, "z"), (22, 10, "z")], ROW)
    refs = [Reference("a", "parent", "root"), Reference("b", "parent", "a"), Reference("c", "parent", "b")]
    root = spark.createDataFrame([(5,)], "id bigint")
    got = {(r.table_name, r.row_id, r.depth) for r in orphan_cascade({"root": root, "a": a, "b": b, "c": c}, dict.fromkeys(("root", "a", "b", "c"), "id"), refs).collect()}
    assert got == {("a", 2, 0), ("b", 12, 0), ("b", 11, 1), ("c", 21, 1), ("c", 20, 2)}


def test_cascade_ends_on_a_cycle_and_on_empty_tables(spark):
    t = spark.createDataFrame([(1, 2), (2, 3), (3, 99), (4, 5), (5, 4)], "id bigint, up bigint")
    got = {(r.row_id, r.depth) for r in orphan_cascade({"t": t}, {"t": "id"}, [Reference("t", "up", "t")]).collect()}
    assert got == {(3, 0), (2, 1), (1, 2)}
    empty = t.limit(0)
    assert orphan_cascade({"t": t, "e": empty}, {"t": "id", "e": "id"}, [Reference("e", "up", "t")]).count() == 0
    assert orphan_cascade({"t": t, "e": empty}, {"t": "id", "e": "id"}, [Reference("t", "up", "e")]).count() == 5


def test_hot_reference_is_spread(spark):
    child = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 77 else id end as up")
    parent = spark.range(3000).selectExpr("id").where("id <> 77")
    got = orphan_cascade({"c": child, "p": parent}, {"c": "id", "p": "id"}, [Reference("c", "up", "p")])
    assert got.count() == 1000 + (77 % 3 != 0)


def test_orphans_without_a_period(spark):
    o = spark.createDataFrame([("t", 1, "t.c", 0), ("t", 2, "t.c", 1)], "table_name string, row_id bigint, reference string, depth int")
    p = spark.createDataFrame([(1, "2024-01"), (1, "2024-02")], "row_id bigint, period string")
    assert {(r.period, r.direct, r.inherited) for r in orphans_by_period(o, {"t": p}).collect()} == {("2024-01", 1, 0), ("unknown", 0, 1)}


def brute(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_star_components_equal_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(500, 560)]
    got = {r.node: r.root for r in star_components(spark.createDataFrame(edges + edges[:9] + [(None, 4), (7, 7)], "u bigint, v bigint")).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])
    assert star_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_groups_stand_on_their_members(spark):
    from stacksift.core.orphans import LIBRARY_REFS

    tracks = spark.createDataFrame([(1,), (2,)], "id bigint")
    members = spark.createDataFrame([(10, 100, 1), (11, 100, 9), (12, 101, 8), (12, 101, 8), (13, 101, 9), (14, None, 7), (15, 103, 2)], "id bigint, group_id bigint, track_id bigint")
    groups = spark.createDataFrame([(100,), (101,), (102,), (103,)], "id bigint")
    quarantine = spark.createDataFrame([(20, 100), (21, 101), (22, 102), (23, 999), (24, None)], "id bigint, group_id bigint")
    tables = {"tracks": tracks, "duplicate_members": members, "duplicate_groups": groups, "quarantine": quarantine}
    got = {(r.table_name, r.row_id, r.depth) for r in orphan_cascade(tables, dict.fromkeys(tables, "id"), LIBRARY_REFS).collect()}
    assert got == {("duplicate_members", i, 0) for i in (11, 12, 13, 14)} | {("duplicate_groups", 102, 0), ("duplicate_groups", 101, 1), ("quarantine", 23, 0), ("quarantine", 22, 1), ("quarantine", 21, 2)}
