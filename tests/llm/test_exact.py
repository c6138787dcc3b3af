"""Consolidation, survivors, encoding and packing against brute force and public libraries."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stacksift.llm import bpe, consolidate, packing, survivor


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("bound", [4_000_000, 20])  # 20 takes many levels
def test_consolidate_equals_brute_force(spark, bound):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 200)] + [(i, i + 1) for i in range(2000, 2100)]
    df = spark.createDataFrame([(u, v, "x") for u, v in edges + edges[:20]] + [(None, 1, "x"), (9, 9, "x")], "u bigint, v bigint, node string").repartition(6)
    got = {r.node: r.root for r in consolidate.consolidate(df, bound).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])
    assert consolidate.consolidate(df.limit(0), bound).count() == 0


def test_track_groups(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 11), (2, 99), (3, 20), (None, 10), (4, None)], "group_id bigint, track_id bigint")
    lists = spark.createDataFrame([(1, [30, 31, None]), (2, [31, 30]), (3, []), (4, None), (5, [40]), (6, [50, 99]), (7, [31, 20])], "cluster_id bigint, track_ids array<bigint>")
    tracks = spark.createDataFrame([(i,) for i in (10, 11, 20, 30, 31, 40, 50, 50)], "id bigint")
    got = {(r.group_root, r.track_id) for r in consolidate.track_groups(members, lists, tracks).collect()}
    assert got == {(10, 10), (10, 11), (20, 20), (20, 30), (20, 31)}
    assert consolidate.track_groups(members.limit(0), lists.limit(0), tracks.limit(0)).count() == 0


def test_dominance_equals_pairs(spark):
    rng = random.Random(2)
    rows, tid = [], 0
    for g in range(250):
        for _ in range(rng.randrange(1, 6)):
            tid += 1
            rows.append((g, tid, f"2024-01-0{rng.randrange(1, 4)}", *[rng.choice([None, 0.5, 0.5, 1.0]) for _ in survivor.RANKED]))
    df = spark.createDataFrame(rows, "group_id bigint, track_id bigint, first_seen string, " + ", ".join(f"{f} double" for f in survivor.RANKED)).withColumn("first_seen", F.to_timestamp("first_seen"))

    def beats(a, b):
        known = [(x, y) for x, y in zip(a[3:], b[3:], strict=True) if x is not None and y is not None]
        if any(x < y for x, y in known):
            return False
        return any(x > y for x, y in known) or (a[2], a[1]) < (b[2], b[1])

    want = set()
    for g, members in itertools.groupby(rows, key=lambda r: r[0]):
        m = list(members)
        want |= {(g, a[1]) for a in m if len(m) > 1 and all(beats(a, b) for b in m if b is not a)}
    df = df.withColumn("tag_completeness", F.col("tag_completeness")).withColumn("lossless", F.col("lossless"))
    assert {(r.group_id, r.track_id) for r in survivor.dominant_members(df).collect()} == want


def test_survivor_prefers_trusted_recent_and_complete(spark):
    schema = "group_id bigint, track_id bigint, tag_completeness double, lossless double, first_seen timestamp, title string, artist string, albumartist string, album string, year bigint, genre string, codec string, " + ", ".join(f"s_{s} double" for s in survivor.SCORES)
    base = [None] * len(survivor.SCORES)
    t = __import__("datetime").datetime(2025, 1, 1)
    old = t.replace(year=2015)
    rows = [(1, 1, 0.9, 1.0, old, "Old", None, None, "", None, None, "mp3", *base), (1, 2, 0.8, 0.0, t, "New", "A", None, " ", None, None, "mp3", *base), (1, 3, 0.1, 0.0, t, "new ", "B", None, None, None, None, "flac", *base), (2, 9, None, None, None, None, None, None, None, None, None, None, *base)]
    got = {r.group_id: r for r in survivor.survivors(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].title, got[1].artist, got[1].album, got[1].codec, got[1].tag_completeness) == ("New", "A", None, "mp3", 0.9)
    assert 2 not in got or got[2].title is None


@pytest.fixture(scope="module")
def tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(bpe.vocabulary("byte_bpe_50k"))
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.encoder(bpe.vocabulary("byte_bpe_50k"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_public_library(tokenizer, text):
    assert tokenizer[1](text) == tokenizer[0].encode_ordinary(text)


def test_ids_of_hard_texts(spark, tokenizer):
    texts = [None, "", " ", "<|endoftext|>", "a" * 20_000, "ab" * 9_000, " \n\t" * 3_000, "é́" * 2_000, "مرحبا 123  \n", "🎵" * 500]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_documents(df).collect()}
    assert got == {i: (tokenizer[0].encode_ordinary(t) if t else []) for i, t in enumerate(texts)}
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_completion_is_optimal_on_small_cases():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(1, 60)
        count = {s: items.count(s) for s in items}
        best = max((sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room), default=0)
        chosen = packing.complete(room, sorted(count), count)
        assert sum(chosen) == best and all(chosen.count(s) <= count[s] for s in chosen)


def fewest(items, capacity):
    """The least number of containers by trying everything."""
    best = len(items)

    def go(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(items):
            best = len(loads)
            return
        for k in sorted(set(range(len(loads))), key=lambda k: -loads[k]):
            if loads[k] + items[i] <= capacity and loads[k] not in loads[:k]:
                loads[k] += items[i]
                go(i + 1, loads)
                loads[k] -= items[i]
        go(i + 1, [*loads, items[i]])

    go(0, [])
    return best


def test_plan_needs_the_fewest_containers():
    rng = random.Random(8)
    for k in range(250):
        capacity = rng.randrange(8, 40)
        items = sorted((rng.randrange(1, capacity + 1) if k % 2 else rng.randrange(2, 2 + capacity // 2) for _ in range(rng.randrange(1, 10))), reverse=True)
        plan = packing.plan({s: items.count(s) for s in items}, capacity)
        assert sorted((s for t, f in plan for s, n in f.items() for _ in range(t * n)), reverse=True) == items
        assert all(sum(s * n for s, n in f.items()) <= capacity for _, f in plan)
        assert sum(t for t, _ in plan) == fewest(items, capacity) >= packing.least_containers({s: items.count(s) for s in items}, capacity), (items, capacity)


def test_dominated_fillings_are_left_out():
    count = {2: 1, 3: 1, 5: 1, 4: 1}
    got = list(packing.completions(9, sorted(count), count, 9))
    assert got[0] == [5, 4] and [5, 3] not in got and [4, 3, 2] not in got
    assert packing.plan({}, 5) == packing.plan({3: 0}, 5) == []


def check_packing(rows, sizes, capacity):
    load, pieces = {}, {}
    for r in rows:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.n_tokens))
    assert max(load.values()) <= capacity
    assert set(pieces) == set(sizes)
    for doc, n in sizes.items():
        p = sorted(pieces[doc])
        assert [x[0] for x in p] == list(range(len(p))) and sum(x[2] for x in p) == n
        assert [x[1] for x in p] == [i * capacity for i in range(len(p))]
        assert len(p) == max(1, -(-n // capacity))
    return len([c for c, n in load.items() if n])


@pytest.mark.parametrize("salt", [100_000, 50])
def test_packing_whole_and_tight(spark, salt):
    rng = random.Random(4)
    sizes = {i: rng.choice([0, 3, 3, 3, 7, 40, 64, 65, 200, rng.randrange(1, 500)]) for i in range(900)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    rows = packing.pack(df, 1, 64, salt).collect()
    used = check_packing(rows, sizes, 64)
    assert used <= -(-sum(sizes.values()) // 64) + 12


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, n_tokens bigint")
    assert {(r.container_id, r.n_tokens) for r in packing.pack(df, 1, 8).collect()} == {(0, 0)}
    assert packing.pack(df.limit(0), 1, 8).count() == 0
    docs = spark.createDataFrame([(1, "a b c", 5), (2, None, 5)], "doc_id bigint, text string, container_id bigint")
    caps = spark.createDataFrame([(1, "byte_bpe_50k", 2)], "capacity_id bigint, tokenizer string, capacity_tokens bigint")
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in packing.pack_documents(docs, caps).collect()) == [(1, 0, 2), (1, 1, 1), (2, 0, 0)]
    assert packing.pack_documents(docs, caps.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 1, 0)
