"""Decision, duplicate layers, fusion, plans and functions on small fixtures."""

import base64
import random
import struct

from pyspark.sql import functions as F

from stacksift.functions import fingerprint, fuzzy, media, text
from stacksift.operators import decision, dedup, fusion, incremental
from stacksift.plans import cleanup, organise
from stacksift.streaming import activity

MEMBER = "group_id bigint, track_id bigint, path string, size_bytes bigint, codec string, lossless boolean, bitrate bigint, sample_rate bigint, bit_depth bigint, duration double, tag_completeness double, mb_recording_id string, has_artwork boolean, artwork_px bigint, has_lyrics boolean, has_synced_lyrics boolean, first_seen string"
THREE = [
    (1, 1, "/m/a.flac", 30, "flac", True, 900_000, 44100, 16, 240.0, 0.95, "x", True, 1400, True, True, "2024-01-01"),
    (1, 3, "/m/a.mp3", 20, "mp3", False, 320_000, 44100, 16, 240.0, 0.80, None, True, 600, False, False, "2024-01-01"),
    (1, 2, "/m/Downloads/New folder/Song (1).mp3", 10, "mp3", False, 192_000, 44100, 16, 239.5, 0.40, None, False, None, False, False, "2024-01-01"),
]


def words_of(values):
    return base64.urlsafe_b64encode(struct.pack(f">{len(values)}I", *values)).decode().rstrip("=")


def test_scores_of_three_copies(spark):
    got = {r.track_id: round(r.score, 4) for r in decision.scored(spark.createDataFrame(THREE, MEMBER)).collect()}
    assert got == {1: 0.9676, 3: 0.7316, 2: 0.4896}


def test_one_keeper_and_ambiguity(spark):
    twins = [(2, 10 + i, f"/m/{i}.flac", 30, "flac", True, 900_000, 44100, 16, 200.0, 0.9, None, False, None, False, False, "2024-01-01") for i in range(2)]
    alone = [(3, 30, *THREE[0][2:])]
    m = spark.createDataFrame(THREE + twins + alone, MEMBER).withColumn("first_seen", F.to_timestamp("first_seen"))
    conf = spark.createDataFrame([(1, 0.95), (2, 1.0), (3, 1.0)], "group_id bigint, confidence double")
    got = {(r.group_id, r.track_id): r.action for r in decision.verdicts(m, conf).collect()}
    assert got == {(1, 1): "keep", (1, 2): "quarantine", (1, 3): "quarantine", (2, 10): "keep", (2, 11): "skip"}


def test_layers_one_cluster_each(spark):
    rng = random.Random(7)
    a = [rng.getrandbits(32) for _ in range(300)]
    near = [w ^ (1 << rng.randrange(32)) if rng.random() < 0.4 else w for w in a]
    b = [rng.getrandbits(32) for _ in range(300)]
    rows = [
        (1, "H1", "M1", None, None, 200.0, "Alpha", "X", None, 40), (2, "H1", "M1", None, None, 200.0, "Alpha", "X", None, 40),
        (3, "H2a", "M2", None, None, 210.0, "Beta", "Y", None, 41), (4, "H2b", "M2", None, None, 210.0, "Beta", None, None, 41),
        (5, "H3", "M3", None, words_of(a), 180.0, "Gamma", "Z", None, 38), (6, "H4", "M4", None, words_of(near), 181.0, "Gamma", "Z", None, 4),
        (7, "H5", "M5", None, words_of(b), 180.5, "Delta", "W", None, 37),
        (8, "H6", "M6", None, None, 3600.0, "أنت عمري", "أم كلثوم", None, 140), (9, "H7", "M7", None, None, 3602.0, "انت عمرى (Official Audio)", "ام كلثوم", None, 57),
    ]
    t = spark.createDataFrame(rows, "id bigint, sha256 string, audio_md5 string, acoustid string, fingerprint string, duration double, title string, artist string, albumartist string, size_bytes bigint")
    got = {}
    for r in dedup.layered(t).collect():
        got.setdefault((r.kind, r.root), set()).add(r.id)
    assert got == {("exact_file", 1): {1, 2}, ("exact_audio", 3): {3, 4}, ("acoustic", 5): {5, 6}, ("metadata", 8): {8, 9}}
    assert dedup.layered(t.limit(0)).count() == 0


def test_fingerprints(spark):
    v = [1, 2**31, 2**32 - 1, 7] * 6
    r = spark.createDataFrame([(words_of(v), "AAAA"), (None, "")], "a string, b string").select(fingerprint.words(F.col("a")).alias("w"), fingerprint.words(F.col("b")).alias("n")).collect()
    assert list(r[0].w) == v and r[0].n is None and r[1].w is None


def test_ratios():
    assert fuzzy.token_sort_ratio("b a", "a b") == 100 and fuzzy.token_set_ratio("a b", "a b c") == 100
    assert fuzzy.token_set_ratio("", "a") == 0 and fuzzy.ratio("", "") == 100
    assert fuzzy.ratio("kitten", "sitting") == 200 * 4 / 13


def test_normalised(spark):
    cases = {"Enta Omry (Official Video)": "enta omry", "Song feat. Someone": "song", "Song ft. Someone Else": "song", "Track [Remastered 2011]": "track", "  Mixed   Spacing  ": "mixed spacing", "أُغْنِيَةٌ": "اغنيه", "عمرى": "عمري", "إحساس": "احساس", "": "", None: ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.normalised(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == cases


def test_safe_names(spark):
    cases = {"CON": "_CON", "a/b:c": "a_b_c", "": "Unknown", "  ": "Unknown", "x" * 200: "x" * 120, "end. .": "end", None: "Unknown"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", media.unsafe_replaced(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == cases


def test_targets_are_unique_and_tidy_files_stay(spark):
    rows = [(1, "/lib/x.mp3", ".mp3", "T", "A", "A", "B", 2000, 1), (2, "/lib/y.mp3", ".mp3", "t", "A", "A", "B", 2000, 1), (3, "/lib/A/2000 - B/02 - Mr. Z.mp3", ".mp3", "Mr. Z", "A", "A", "B", 2000, 2), (4, "/lib/s.mp3", ".mp3", "Solo", "A", None, None, None, None)]
    t = spark.createDataFrame(rows, "id bigint, path string, ext string, title string, artist string, albumartist string, album string, year bigint, track_no bigint").selectExpr("*", "null as codec", "null as genre", "cast(null as bigint) as disc_no")
    got = {r.id: (r.target, r.changed) for r in organise.numbered(organise.targets(t, "/lib/")).collect()}
    assert got == {1: ("/lib/A/2000 - B/01 - T.mp3", True), 2: ("/lib/A/2000 - B/01 - t (2).mp3", True), 3: ("/lib/A/2000 - B/02 - Mr. Z.mp3", False), 4: ("/lib/A/Singles/Solo.mp3", True)}


def test_a_target_wanted_too_often_is_refused(spark):
    rows = [(i, f"/in/{i}.mp3", "/lib/T.mp3") for i in range(1, 151)] + [(200, "/lib/T (3).mp3", "/lib/t.mp3"), (201, "/lib/U.mp3", "/lib/V.mp3"), (202, "/in/u.mp3", "/lib/u.mp3")]
    got = {r.id: r for r in organise.numbered(spark.createDataFrame(rows, "id bigint, path string, target string")).collect()}
    assert len(got) == len(rows) and len({r.target.lower() for r in got.values()}) == len(rows)
    assert [got[i].target for i in (1, 2, 3, 98)] == ["/lib/T.mp3", "/lib/T (2).mp3", "/lib/T (4).mp3", "/lib/T (99).mp3"]
    assert all(got[i].target == got[i].path and not got[i].changed for i in [*range(99, 151), 200])
    assert got[201].target == "/lib/V.mp3" and got[202].target == "/lib/u (2).mp3"


def test_empty_folders_and_categories(spark):
    folders = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/c",), ("/d",)], "path string")
    files = spark.createDataFrame([("/a/b/x.lrc",), ("/a/y.mp3",)], "path string")
    assert {r.path for r in cleanup.empty_folders(folders, files).collect()} == {"/a/b/c", "/d"}
    nas = spark.createDataFrame([("/",), ("/e",), ("/e/@eaDir",), ("/q",), ("/q/x",), (None,)], "path string")
    cached = spark.createDataFrame([("/e/@eaDir/t.db",), (None,)], "path string")
    assert cleanup.empty_folders(nas, cached, root="/", off_limits=("/q",)).count() == 0
    assert {r.path for r in cleanup.empty_folders(nas, cached, root="/", caches=True, off_limits=("/q",)).collect()} == {"/e"}
    kinds = {r.path: r.k for r in spark.createDataFrame([("/a/x.lrc",), ("/a/x.part-1",), ("/a/@eaDir/t.db",), ("/a/x.mp3",)], "path string").select("path", cleanup.file_category().alias("k")).collect()}
    assert kinds == {"/a/x.lrc": "sidecar", "/a/x.part-1": "temp", "/a/@eaDir/t.db": "cache", "/a/x.mp3": None}


def test_vote_ties_and_conflicts(spark):
    c = spark.createDataFrame([("e", "s1", 0.5, 1, "A", ""), ("e", "s2", 0.5, 2, "B", "g"), ("e", "s1", 0.5, 3, "Z", "h")], "entity_id string, source string, confidence double, pos bigint, title string, genre string")
    trust = spark.createDataFrame([("title", "s1", 0.9), ("title", "s2", 0.9)], "field string, source string, trust double")
    got = {r.field: (r.value, r.source, r.weight, r.conflict) for r in fusion.winners(fusion.ballots(fusion.best_per_source(c), ("title", "genre"), trust)).collect()}
    assert got == {"title": ("A", "s1", 0.45, True), "genre": ("g", "s2", 0.15, False)}


def test_snapshot_changes_and_upsert(spark):
    index = spark.createDataFrame([("/a", 50_000, 1.0, "h", "active"), ("/b", 50_000, 1.0, "h", "active"), ("/c", 50_000, 1.0, None, "active"), ("/d", 1, 1.0, "h", "missing")], "path string, size_bytes bigint, mtime double, sha256 string, status string")
    disk = spark.createDataFrame([("/a", 50_000, 1.5), ("/c", 50_000, 1.0), ("/e", 50_000, 1.0), ("/f", 5, 1.0)], "path string, size_bytes bigint, mtime double")
    assert {r.path: r.change for r in incremental.changes(disk, index).collect()} == {"/a": "unchanged", "/b": "missing", "/c": "updated", "/e": "added", "/f": "corrupt"}
    old = spark.createDataFrame([("/a", "k1", 1), ("/b", "k2", 2)], "path string, apple_id string, n bigint")
    new = spark.createDataFrame([("/a", "", 5), ("/c", "k3", 6)], "path string, apple_id string, n bigint")
    assert {tuple(r) for r in incremental.upsert(old, new).select("path", "apple_id", "n").collect()} == {("/a", "k1", 5), ("/b", "k2", 2), ("/c", "k3", 6)}


def test_stream_equals_batch_and_admits(spark, data):
    got = activity.run_once(activity.daily(activity.events_stream(spark, data)), "t_daily", "complete")
    batch = spark.read.parquet(f"{data}/events.parquet").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()}
    ok = activity.run_once(activity.admitted(activity.events_stream(spark, data), 2, 600.0), "t_admitted", "append").collect()
    events = {r.event_id: r.ts.timestamp() for r in spark.read.parquet(f"{data}/events.parquet").collect()}
    hits: dict[int, list[float]] = {}
    want = set()
    by_user = {r.event_id: r.user_id for r in ok}
    for e in sorted(by_user, key=lambda e: (events[e], e)):
        h = [x for x in hits.get(by_user[e], []) if x > events[e] - 600]
        if len(h) < 2:
            want.add(e)
            h.append(events[e])
        hits[by_user[e]] = h
    assert {r.event_id for r in ok if r.admitted} == want


def test_registered_functions(spark):
    from stacksift.functions.register import register_udfs

    register_udfs(spark)
    png = "89504E470D0A1A0A0000000D4948445200000258000000010806"
    jpg = "FFD8FFE000104A46494600010100000100010000FFC00011080064012C03"
    r = spark.sql(f"select token_sort_ratio('b a', 'a b') as r, nfkc('ﬁ') as n, image_width(unhex('{png}')) as p, image_width(unhex('{jpg}')) as j, image_width(unhex('00')) as x").first()
    assert (r.r, r.n, r.p, r.j, r.x) == (100.0, "fi", 600, 300, None)
    cases = ["Ｈｅｌｌｏ (Official Video) feat. X", "أُغْنِيَةٌ  عمرى", "Don't - Stop", "", None]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    df.createOrReplaceTempView("cases")
    assert spark.sql("select t, normalised(t) as n from cases").collect() == df.select("t", text.normalised(F.col("t")).alias("n")).collect()


def test_search_equals_comparing_all(spark):
    from stacksift.operators.search import best_matches

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 4))), word() if i % 7 else None, "x") for i in range(300)] + [(900, "w" * 80 + " long title", "q", "x"), (901, "yellow submarine", "beatles", "x"), (5, "yellow submarine", "beatles", "x"), (902, None, None, "x")]
    asked = [(i, t[::-1] if i % 3 == 0 else t[:-1] or t, a) for i, t, a, _ in rows[::4] if t] + [(1000, "yellow submarine", "the beatles"), (1001, "w" * 79 + " long title", "q"), (1002, "", ""), (None, "a", "b")]
    want = {}
    for k, t, a in asked:
        scored = [(round(0.7 * fuzzy.token_sort_ratio(t, x or "") + 0.3 * fuzzy.token_set_ratio(a or "", y or ""), 9), -i) for i, x, y, _ in rows]
        if k is not None and max(scored)[0] >= 85:
            want[k] = (-max(scored)[1], round(max(scored)[0], 4))
    r = spark.createDataFrame(rows, "id bigint, title string, artist string, score string")
    q = spark.createDataFrame(asked, "query_id bigint, title string, artist string")
    for sizes in ((20_000, 2_000), (50, 9)):
        got = {x.query_id: (x.id, x.score) for x in best_matches(q, r, rows_a_task=sizes[0], queries_a_task=sizes[1]).collect()}
        assert got == want and got[1000] == (5, 100.0) and 1001 in got
    assert best_matches(q.limit(0), r).count() == best_matches(q, r.limit(0)).count() == 0


def test_search_compares_in_full_only_what_can_match():
    from stacksift.operators import search

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9)))
    titles = sorted({" ".join(sorted(word() for _ in range(rng.randrange(1, 5)))) for _ in range(2_000)} | {"", "x" * 90, "y" * 300}, key=len)
    queries = ["", "x" * 80, "y" * 299] + [t[: k % 5] + t[k % 5 + k % 3 :] + "z" * (k % 4) for k, t in enumerate(titles[::9])]
    texts = search.Texts(titles)
    compared = []
    common = texts.common
    texts.common = lambda asked, q, t: compared.append(len(q)) or common(asked, q, t)
    for least in (78.5, 30.0, 0.0):
        compared.clear()
        got = {(queries[q], titles[t]): x for part in texts.near(queries, least) for q, t, x in zip(*part, strict=True)}
        want = {(q, t): fuzzy.ratio(q, t) for q in queries for t in titles}
        assert got == {k: x for k, x in want.items() if x >= least}
        assert least < 78 or sum(compared) < 0.1 * len(queries) * len(titles)


def test_wide_letters_are_the_same_title(spark):
    t = spark.createDataFrame([(1, "Ｈｅｌｌｏ Ｗｏｒｌｄ", "A", None, 200.0), (2, "Hello World", "A", None, 201.0), (3, "Hello World", "A", None, 230.0)], "id bigint, title string, artist string, albumartist string, duration double")
    assert {(r.root, r.id) for r in dedup.similar_tags(t).collect()} == {(1, 1), (1, 2)}


def test_occupied_targets_are_not_given_out(spark):
    p = spark.createDataFrame([(1, "/in/a.mp3", "/lib/T.mp3"), (2, "/in/b.mp3", "/lib/S.mp3")], "id bigint, path string, target string")
    got = {r.id: r.target for r in organise.numbered(p, spark.createDataFrame([("/lib/t.mp3",), (None,)], "path string")).collect()}
    assert got == {1: "/lib/T (2).mp3", 2: "/lib/S.mp3"}


def test_overrides_need_a_keeper_and_are_noted_once(spark):
    m = spark.createDataFrame([(1, 1, "keep", "best"), (1, 2, "quarantine", "x (manually overridden)"), (2, 3, "keep", None), (2, 4, "skip", None), (3, 5, "skip", "s")], "group_id bigint, track_id bigint, action string, reason string")
    o = spark.createDataFrame([(1, 2, "skip"), (1, 1, "keep"), (2, 3, "quarantine"), (9, 9, "keep"), (None, 5, "keep")], "group_id bigint, track_id bigint, action string")
    got = {r.track_id: (r.action, r.reason, r.refused) for r in decision.overridden(m, o).collect()}
    assert got == {1: ("keep", "best", False), 2: ("skip", "x (manually overridden)", False), 3: ("keep", None, True), 4: ("skip", None, True), 5: ("skip", "s", False)}


def test_settled_sets_and_stopped_scans(spark):
    m = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 1), (3, 1), (3, 3), (4, None)], "group_id bigint, track_id bigint")
    assert {r.group_id for r in decision.not_settled(m, m.where("group_id = 2")).collect()} == {2, 3}
    index = spark.createDataFrame([("/a", 50_000, 1.0, "h", "active")], "path string, size_bytes bigint, mtime double, sha256 string, status string")
    disk = spark.createDataFrame([], "path string, size_bytes bigint, mtime double")
    assert incremental.missing(disk, index, True).count() == 1 and incremental.missing(disk, index, False).count() == 0


def test_outcomes_and_payloads(spark):
    from stacksift.operators import jobs

    cases = {'{"added": 12, "errors": 2}': (12, 2), '{"restored": ["a", "b"], "failed": []}': (2, 0), "{}": (None, None), '{"succeeded": true, "added": 3}': (3, None), "no json": (None, None), None: (None, None)}
    got = spark.createDataFrame([(k,) for k in cases], "j string").select("j", jobs.outcome(F.col("j")).alias("o")).collect()
    assert {r.j: tuple(r.o) for r in got} == cases
    long = '{"a":1,"b":[1],"c":{"d":2},"e":"x"}'
    r = spark.createDataFrame([(long,)], "j string").select(jobs.trimmed(F.col("j"), 10).alias("s"), jobs.trimmed(F.col("j")).alias("w")).first()
    assert r.w == long and __import__("json").loads(r.s) == {"a": 1, "b": "...", "c": "...", "e": "x"}


def test_answers_without_anything(spark):
    from stacksift.sources import providers

    r = spark.createDataFrame([("{}",), (None,), ('{"status": "ok", "results": null}',), ("[]",)], "j string").select(providers.by_fingerprint(F.col("j")).alias("f"), providers.by_search(F.col("j"), F.lit(1.0)).alias("s"), providers.recording(F.col("j")).alias("r"), providers.largest_image(F.col("j")).alias("i")).collect()
    assert [x.f for x in r] == [None, None, [], None] and all(x.i is None and x.r.album is None for x in r)


def test_lyrics(spark):
    lrc = "[00:01.00] one\n[00:02] two\n\n[100:03.5]three [00:04.00]"
    r = spark.createDataFrame([(lrc,), (None,), ("[00:01.00] one\n two",)], "t string").select(text.strip_lrc(F.col("t")).alias("s"), text.is_timed(F.col("t")).alias("v")).collect()
    assert [(x.s, x.v) for x in r] == [("one\ntwo\nthree", True), (None, False), ("one\ntwo", False)]


def test_rolling_counts_start_anew_after_a_success(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(i, 1, at(m), ok) for i, (m, ok) in enumerate([(0, False), (10, False), (14, False), (15.5, False), (16, True), (17, False), (40, False)])] + [(90, 2, at(16), False)]
    e = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp, ok boolean")
    assert {r.event_id: r.recent for r in activity.rolling(e, success=F.col("ok")).collect()} == {0: 1, 1: 2, 2: 3, 3: 3, 4: 4, 5: 1, 6: 1, 90: 1}
    many = spark.range(70).selectExpr("id as event_id", "id as user_id", "timestamp '2024-01-01 00:14:59' + make_interval(0, 0, 0, 0, 0, 0, id) as ts")
    assert {r.event_id: r.delay for r in activity.delayed(many).collect() if r.delay} == {i: min(2.0, (i - 59) * 0.25) for i in range(60, 70)}
    assert activity.rolling(e.limit(0)).count() == activity.delayed(e.limit(0)).count() == 0


def test_tags_of_containers(spark):
    from stacksift.sources import tags

    rows = [(1, "id3", {"TIT2": ["T"], "trck": ["3/12"], "TDRC": ["1999-05"], "TCMP": ["1"]}), (2, "vorbis", {"Title": ["V", "W"], "ALBUM ARTIST": ["A"], "tracknumber": ["4"], "totaltracks": ["9"], "compilation": ["yes"]}), (3, "mp4", {"\xa9nam": [], "trkn": ["0"]}), (4, "other", {"Title": ["G"], "year": ["999"]}), (5, None, None)]
    r = {x.id: x.t for x in spark.createDataFrame(rows, "id bigint, kind string, m map<string, array<string>>").select("id", tags.read(F.col("kind"), F.col("m")).alias("t")).collect()}
    assert (r[1].title, r[1].track_no, r[1].total_tracks, r[1].year, r[1].compilation) == ("T", 3, 12, 1999, True)
    assert (r[2].title, r[2].albumartist, r[2].track_no, r[2].total_tracks, r[2].compilation) == ("V", "A", 4, 9, True)
    assert (r[3].title, r[3].track_no, r[4].title, r[4].year, r[5].title, r[5].compilation) == (None, 0, "G", None, None, False)
