"""Encoding repair, look-alikes, names, matching and personal information on small fixtures."""

import pytest
from pyspark.sql import functions as F

from stacksift.llm import charmodel, encoding, lookalike, matching, names, personal

TRACK = "id bigint, title string, album string, artist string, albumartist string, duration double, value string"
CLEAN = ["Où dort la Fenêtre", "La Fête Rêvée", "Été à Kalmar", "Über die Brücke", "Fünf Süße Märchen", "Canción de la Niñez", "Así Corazón", "Ночная Гроза", "Моя Луна", "Дорога и Осень", "Луна над городом", "Αυγή και Θάλασσα", "Η Σελήνη σου", "أغنية الغريبة", "وردة ومدينة", "Quiet Harbour", "The Golden Lantern", "Don't Wake the Garden", "Midnight Telegram", "Moja Łąka", "Późna Róża", "Ścieżka do Nocy", "Blå Ørken", "Coração e Pão", "CANÇÕES DE Maré"]
#: What the fixture damages: one value in twenty-five, as in a library; the rest is clean.
DAMAGED = ["FÃªte RÃªvÃ©e", "FÃƒÂªte", "Ëóíà íàä ãîðîäîì", "Ïîÿ Ãðîçà", "Gr├╝n ├╝ber", "M√§rchen", "Caf�"]


@pytest.fixture(scope="module")
def model():
    n: dict[str, int] = {}
    for v in CLEAN * 40:
        s = charmodel.START + v.replace(" ", charmodel.END + charmodel.START) + charmodel.END
        for i in range(len(s) - 1):
            n[s[i : i + 2]] = n.get(s[i : i + 2], 0) + 1
    n.pop(charmodel.END + charmodel.START, None)
    return charmodel.PairModel(n)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1250", "cp437", "cp850", "mac_roman", "cp1256"])
def test_utf8_misread_is_undone(model, wrong):
    hits = 0
    for text in CLEAN:
        if text.isascii():
            continue
        garbled = "".join(encoding_char(b, wrong) for b in text.encode())
        if garbled != text:
            bad, restored, _ = encoding.judge(garbled, model)
            assert bad, (wrong, text, garbled)
            hits += restored == text
    assert hits >= 0.8 * sum(not t.isascii() for t in CLEAN)


def encoding_char(b, codec):
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return chr(b)


def test_clean_values_are_not_garbled(model):
    assert [v for v in CLEAN if encoding.judge(v, model)[0]] == []
    assert encoding.judge(None, model) == encoding.judge("", model) == encoding.judge("plain", model) == (False, None, None)
    assert encoding.judge("Ëóíà íàä ãîðîäîì", model)[:2] == (True, "Луна над городом")
    assert encoding.judge("La F�te", model)[:2] == (True, None)
    assert encoding.judge("La Fête " * 3000, model)[0] is False


def test_a_single_misread_letter_is_mapped():
    n: dict[str, int] = {}
    for v in ["Cicha Tęsknota", "Moja Tęsknota nad Driti", "Święta Tęsknota", "Blue Harbour", "Fête", "Têtes"] * 60:
        s = charmodel.START + v.replace(" ", charmodel.END + charmodel.START) + charmodel.END
        for i in range(len(s) - 1):
            n[s[i : i + 2]] = n.get(s[i : i + 2], 0) + 1
    polish = charmodel.PairModel(n)
    assert encoding.judge("Cicha Têsknota", polish) == (True, "Cicha Tęsknota", "cp1250 as cp1252")
    assert encoding.judge("Têsknota Blue Harbour Blue Harbour Têsknota", polish)[:2] == (True, "Tęsknota Blue Harbour Blue Harbour Tęsknota")
    assert not any(encoding.judge(v, polish)[0] for v in ("Cicha Tęsknota", "Fête", "Têtes"))


def test_look_alikes_take_the_script_of_their_word(model):
    cases = {"Gоldеn Lаntеrn": "Golden Lantern", "Ｑｕｉｅｔ　Harbour": "Quiet Harbour", "Mid​night Telegram": "Midnight Telegram", "Fête".replace("ê", "ê"): "Fête", "Моя Лунa": "Моя Луна", "The Golden": "The Golden", "Τhe Gοlden Lantern": "The Golden Lantern", "02 ‑ x": "02 - x"}
    assert {k: lookalike.consistent(k, model) for k in cases} == cases
    for v in ["Η Σελήνη σου", "Моя Луна", "Don't Wake", "", None, "Дорога и Осень", "№ 5 ™ ½"]:
        assert lookalike.consistent(v, model) == v


def test_garbled_and_forms_on_tables(spark):
    rows = [(i, v, None, "A", None, 1.0, "clash") for i, v in enumerate(CLEAN * 8)] + [(900, "FÃªte RÃªvÃ©e", "Mid​night", "A", "", 1.0, "x"), (900, "FÃªte RÃªvÃ©e", "Mid​night", "A", "", 1.0, "x"), (901, None, "", None, None, None, None)]
    t = spark.createDataFrame(rows, TRACK)
    got = encoding.garbled_values(t).collect()
    assert [(r.track_id, r.field, r.restored) for r in got] == [(900, "title", "Fête Rêvée")]
    forms = {(r.track_id, r.field): r.form for r in lookalike.consistent_forms(t, ("title", "album")).where("changed").collect()}
    assert forms == {(900, "album"): "Midnight"}
    assert encoding.garbled_values(t.limit(0)).count() == 0 and lookalike.consistent_forms(t.limit(0)).count() == 0


def test_readings():
    r = names.read_name
    same = [("The Gonletanel Trio", "Trio of Gonletanel"), ("Gonletanel-Trio", "Gonletanel 3o"), ("Belhidomar B.B.", "Big Band of Belhidomar"), ("Leonard Beloendropan", "Belöndropan, Leonard"), ("Mr. Ignacio Bomanbarpo", "Nacho Bomanbarpo"), ("Boris Kavikhuvi", "Борис Кавихуви"), ("Casda M. Bordanlaki", "Casda Bordanlaki"), ("Peldelantru Phil.", "The Peldelantru Philharmonic"), ("Selrick Kérbrobrehol", "selrick kerbrobrehol (solo)")]
    for a, b in same:
        assert names.compare(r(a), r(b))[0] in ("same", "typo", "nick"), (a, b, r(a), r(b))
    for a, b in [("Deborah Bomanbarpo", "Ignacio Bomanbarpo"), ("Gonletanel Trio", "Gonletanel Quartet")]:
        assert names.compare(r(a), r(b))[0] in ("", "family"), (a, b)
    assert names.compare(r("L. Bel"), r("Leonard Bel"))[0] == "short"
    assert r("").core == "" and names.compare(r(""), r(""))[0] == ""


def test_lcs_equals_the_table_method():
    import random

    rng = random.Random(9)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert names.lcs(a, b) == t[-1][-1]


def test_names_linked_and_relatives_kept_apart(spark):
    rows, i = [], 0
    for artist, n in [("Leonard Belöndropan", 9), ("Belöndropan, Leonard", 2), ("L. Belöndropan", 2), ("Leonrad Belöndropan", 1), ("Deborah Belöndropan", 5), ("The Kalmar Trio", 4), ("Kalmar Trio, The", 1), ("Kalmar Quartet", 3)]:
        for k in range(n):
            i += 1
            rows.append((i, f"Song {k}", "Album D" if "Deborah" in artist else f"Album {artist.split()[-1][:3]}", artist, "Various Artists" if k % 2 else None, 1.0, ""))
    rows += rows[:3] + [(999, None, None, "", None, None, None)]
    t = spark.createDataFrame(rows, TRACK)
    pairs = {(r.name_a, r.name_b) for r in names.name_pairs(names.same_names(t)).collect()}
    group = sorted(["Leonard Belöndropan", "Belöndropan, Leonard", "L. Belöndropan", "Leonrad Belöndropan"])
    assert pairs == {(a, b) for k, a in enumerate(group) for b in group[k + 1 :]} | {("Kalmar Trio, The", "The Kalmar Trio")}
    assert names.name_pairs(names.same_names(t.limit(0))).count() == 0


def test_lengths_in_words(spark):
    from pyspark.sql import functions as F

    cases = {"3:05": 185.0, "01:00:05": 3605.0, "PT4M9S": 249.0, "4 min 4 s": 244.0, "244": 244.0, "244500": 244.5, "244.5 s": 244.5, "": None, None: None, "soon": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", matching.seconds(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == cases


def test_cleaned_titles():
    c = matching.clean_title
    assert c("05 - No More Lantern [HQ]") == c("No_More_Lantern (feat. X)") == ("no more lantern", "")
    assert c("No More Lantern (Live)") == ("no more lantern", "live") and c("X (Acostic)")[1] == "acoustic"
    assert matching.title_ratio("dont wake the ember", "dont wake the mirror") < 0.5 < matching.title_ratio("the scond waltz", "the second waltz")
    assert matching.clean_album("2019 - Café Gofar (Deluxe Edition)") == matching.clean_album("cafe gofar CD2") == "cafegofar"


def test_matching_by_title_album_and_length(spark):
    tracks = [(1, "Blue Lantern", "Quiet Harbour", "Ann Kalmar", None, 200.0, ""), (2, "05 - Blue Lantern", "Quiet Harbour (Deluxe Edition)", "Ann Kalmar", None, 201.2, ""), (3, "Blue Lantern (Live)", "Quiet Harbour", "Ann Kalmar", None, 260.0, ""), (4, "Blue Lantern", "Other Days", "Bob Tenner", None, 200.0, ""), (5, "Blue Lantern", "Quiet Harbour", None, None, 290.0, ""), (6, None, "Quiet Harbour", None, None, 200.0, ""), (7, "Red Garden", "Quiet Harbour", "Ann Kalmar", None, 180.0, "")]
    cands = [(10, "Blue Lantren", "Quiet Harbour", "Ann Kalmar", None, "3:21"), (11, "Blue Lantern (Live)", None, "Kalmar, Ann", None, "260400"), (12, "Blue Lantern", "Unknown Place", "Zed Zorro", None, "3:20"), (13, None, None, None, None, None), (14, "Red Garden", "Quiet Harbour", "Ann Kalmar", None, "PT3M")]
    t = spark.createDataFrame(tracks + tracks[:2], TRACK)
    c = spark.createDataFrame(cands + cands[:1], "candidate_id bigint, title string, album string, artist string, albumartist string, length_text string")
    got = {(r.track_id, r.candidate_id) for r in matching.match_candidates(t, c).collect()}
    assert got == {(1, 10), (2, 10), (3, 11), (7, 14)}
    assert matching.match_candidates(t.limit(0), c.limit(0)).count() == 0


def test_matching_broadcasts_nothing(spark, tmp_path):
    def read(rows, kind):  # from files, as Spark knows no size of rows it is given
        spark.createDataFrame(rows, kind).write.parquet(at := str(tmp_path / str(len(kind))))
        return spark.read.parquet(at)

    kind = "id bigint, title string, version string, album string, artist string, sec double"
    p = read([(1, "leaving", "", "letters", "westrick", 347.7)], kind)
    graph = matching.candidate_graph(p, p)
    pairs = matching.score_pairs(graph, p, p)
    support = pairs.groupBy("near").agg(F.sum("own").alias("sum"))
    of = read([(1, "Leaving", "Letters", "Westrick", "Westrick", 347.7)], "id bigint, title string, album string, artist string, albumartist string, duration double")
    found = matching.match_candidates(of, of.select(F.col("id").alias("candidate_id"), "title", "album", "artist", "albumartist", F.lit("347.7").alias("length_text")))
    for df in (graph, pairs, matching._supported(pairs, support), found):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


GIVEN = {"susanna", "leonard", "caswyn", "john", "mary", "نورة", "أحمد"}


def name_model():
    """A name model fitted on sentences that hold other names than the tests do."""
    from stacksift.llm import person

    made = lambda parts, i: "".join(parts[i // len(parts) ** k % len(parts)] for k in range(3))
    latin, arabic = ["bar", "gol", "nim", "tra", "vo", "pel", "kru"], ["زا", "ما", "لو", "تي", "شا", "طو"]
    cues = [("Signed:", "\nThe box is here."), ("The reel was donated by", "'s family."), ("Regards,", "\nThe Box and The Reel")]
    texts = [f"{cue} {('Susanna', 'Leonard', 'Caswyn')[i % 3]} {made(latin, 3 * i + j).capitalize()}{end}" for i in range(60) for j, (cue, end) in enumerate(cues)]
    texts += [f"شكرا. مع التحية، {('نورة', 'أحمد')[i % 2]} {made(arabic, i)}" for i in range(60)]
    texts += ["The Golden Lantern and The Quiet Harbour are in The Box. Write to us, please, and The Reel sings.", "the family sings and the box is donated by the shop to the reel"] * 6
    return person.fit_names(texts, GIVEN)


NAMES = name_model()


def kinds(text):
    return [(m.label, m.text) for m in personal.items(text, NAMES)]


def test_items_of_each_kind():
    assert kinds("Write to ann.lee+x (at) mill-music (dot) example please. Rip@320kbps") == [("email", "ann.lee+x (at) mill-music (dot) example")]
    assert kinds("Ring me on +44 7700 900 023, not 2004311285002. Tel. 555-0166 ext. 07") == [("phone", "+44 7700 900 023"), ("phone", "555-0166 ext. 07")]
    assert kinds("the shop has the other reel 020 7946 0105 (ask for the shop) reel 33197") == [("phone", "020 7946 0105")]
    assert kinds("My passport number is QQ 13 03 14 C. Barcode on the back is 2004311285002") == [("id_number", "QQ 13 03 14 C")]
    assert kinds("ship to Flat 18, 22 Nuper Street,\nLenor Bay QX12 3HN soon") == [("address", "Flat 18, 22 Nuper Street,\nLenor Bay QX12 3HN")]
    assert kinds("Signed: Susanna Draherkarju\nThe reel was donated by M. KALMARUK's family.") == [("person_name", "Susanna Draherkarju"), ("person_name", "M. KALMARUK")]
    assert kinds("مع التحية، جميلة ماحوبيطي") == [("person_name", "جميلة ماحوبيطي")]
    assert kinds(None) == kinds("") == kinds(" \n") == kinds("2023-05-08 07:41:35 INFO job 48877 total=45031") == []


def test_repeated_names_share_evidence():
    text = "caswyn balpar sings. Regards, Caswyn Balpar"
    assert [t for _, t in kinds(text)] == ["caswyn balpar", "Caswyn Balpar"]
    assert kinds("caswyn balpar sings.") == []


def test_names_without_a_cue():
    from stacksift.llm import person

    plain = person.NameModel(frozenset({"john", "mary"}))
    prose = [("Yesterday I met John Smith at the station", "John Smith"), ("John Smith lives next door", "John Smith"), ("Written by Mary Jones, Oslo", "Mary Jones")]
    for text, name in [*prose, ("this is Jones, Mary speaking", "Jones, Mary"), ("by MARY JONES’S hand", "MARY JONES")]:
        assert [(m.label, m.text) for m in personal.items(text, plain)] == [("person_name", name)], text
    assert [kinds(text) for text, _ in prose] == [[("person_name", name)] for _, name in prose]
    for model in (NAMES, plain):
        assert [m.text for m in personal.items("/lib/music/John Smith/Songs/01 Mary Jones.mp3\nI met john", model) if m.label != "none"] == []


def test_similar_mentions_share_evidence():
    assert [t for _, t in kinds("Regards, Susanna Draher. The box is for S. Draher, by Draher, Susanna too")] == ["Susanna Draher", "S. Draher", "Draher, Susanna"]


def test_items_of_any_length_are_whole():
    far = "a" * 95 + "@" + ".".join(["sub-domain"] * 30) + ".example"
    assert kinds(f"mail {far} now") == [("email", far)]
    assert kinds("ship to 22 " + "N" + "u" * 90 + " Street,\n" + "L" + "e" * 90 + " QX12 3HN soon")[0][1].endswith("QX12 3HN")


def test_stretches_that_differ_in_digits_are_read_once():
    from stacksift.llm import person

    person._readings.clear()
    assert [kinds(f"{i:05}: Regards, Caswyn Balpar {i}.") for i in range(500)] == [[("person_name", "Caswyn Balpar")]] * 500
    assert len(person._readings) < 20


def test_names_over_spaces_breaks_and_marks():
    from stacksift.llm import person

    model = person.NameModel(frozenset({"john"}), frozenset({"the", "box"}), frozenset({"golden"}))
    far = "12:30 \t no " * 40
    found = {
        "John Kalmar": ["John Kalmar"], "John\xa0Kalmar": ["John\xa0Kalmar"], "John\nKalmar": ["John\nKalmar"], "John \n   Kalmar": ["John \n   Kalmar"], "John  Kalmar": [], "John\tKalmar": [], "John\n\nKalmar": [],
        "John K. Kalmar": ["John K. Kalmar"], "John K.\nKalmar": ["John K.\nKalmar"], "J. K. Kalmar": ["J. K. Kalmar"], "j. Kalmar": [], "Kalmar, John": ["Kalmar, John"], "Kalmar,\nJ.": ["Kalmar,\nJ."], "Kalmar, John K.": ["Kalmar, John K."],
        "JOHN KALMAR’S": ["JOHN KALMAR"], "John KALMAR": [], "John Box": [], "Golden Kalmar": [], "Mr. John Kalmar.": ["John Kalmar"], "(John Kalmar)": ["John Kalmar"],
    }
    for text, names_ in found.items():
        for before, after in (("", ""), (far, " no" + far), ("\n\n", "\n")):
            t = before + text + after
            assert [t[x.start : x.end] for x in person.spans(t, model)] == names_, t
    assert [s.context[2] + " " + s.context[6] for s in person.spans("a\nb 17 John Kalmar\n, c d", model)] == ["p3=b 0 \n n3=\n , c"][:0] + [s.context[2] + " " + s.context[6] for s in person.spans("a\nb 42 John Kalmar\n, c d", model)]
    assert [s.common for s in person.spans("John Box", model, everything=True)] == [True]


def test_street_before_a_line_break():
    assert kinds("ship to Birkenweg\n12, 12345 Lenor soon") == [("address", "Birkenweg\n12, 12345 Lenor")]


def test_long_text_is_read_to_its_end():
    assert kinds("la la " * 40_000 + "mail: a.b@c.example") == [("email", "a.b@c.example")]


def test_documents_redacted(spark):
    docs = spark.createDataFrame([(1, "Signed: Susanna Draher. Call 020 7946 0071", "k"), (1, "Signed: Susanna Draher. Call 020 7946 0071", "k"), (2, None, "k"), (3, "", "k"), (4, "Regards, Leonard Kalmaruk", "k")], "doc_id bigint, text string, kind string")
    tracks = spark.createDataFrame([(1, "leonard kalmaruk", None)], "id bigint, artist string, albumartist string")
    got = {r.doc_id: (r.text, r["items"]) for r in personal.redacted_documents(docs, tracks, NAMES).collect()}
    assert got == {1: ("Signed: [PERSON_NAME]. Call [PHONE]", 2), 2: (None, 0), 3: ("", 0), 4: ("Regards, Leonard Kalmaruk", 0)}
    assert personal.document_items(docs.limit(0), tracks.limit(0)).count() == 0
    many = spark.createDataFrame([(i, f"title {i}", "a", n, None) for i, n in enumerate(["Ann Berg", "Ann Holm", "Zoe K. Lund", "Trio Berg"])], "id bigint, title string, album string, artist string, albumartist string")
    assert personal.given_names(many) == {"ann", "zoe"} and personal.title_words(many) == {"title"}
    assert [r.found_text for r in personal.document_items(docs.withColumn("text", F.lit("I met Ann Kalmaruk and Ann Berg")), many).select("found_text").distinct().collect()] == ["Ann Kalmaruk"]


def test_name_model_is_that_of_all_documents(spark):
    from stacksift.llm import person

    family = lambda i: "".join("bdfgklmnpr"[i // 10**k % 10] + "aeiou"[(i // 3 + k) % 5] for k in range(4))
    texts = [f"the reel {i} is signed by {('Susanna', 'Leonard', 'Golden')[i % 3]} {family(i).capitalize()} of {'Tenner' if i % 1000 < 2 else 'Lund'}, and The Reel" for i in range(12_000)]
    few = [f"Regards, Zorin {x.capitalize()}" for x in ("kalmar", "draher", "nuper", "lenor")]  # a given name of four documents, which a sample misses
    docs = spark.createDataFrame(enumerate([*texts, *few, few[0], None, ""]), "doc_id bigint, text string").repartition(3)
    tracks = spark.createDataFrame([(i, n, None, "Golden Box", t) for i, (n, t) in enumerate([("Susanna Berg", "Golden Reel"), ("Susanna Holm", "Golden Hour")])], "id bigint, artist string, albumartist string, album string, title string")
    got, want = personal.name_model(docs, tracks), person.fit_names([*texts, *few], {"susanna"}, {"golden"})
    assert (got.given, got.ordinary, got.lower) == (want.given, want.ordinary, want.lower) and got.weights.tolist() == want.weights.tolist()
    assert {"susanna", "leonard", "zorin"} <= got.given and {"tenner", "lund"} <= got.ordinary and "golden" in got.lower
    none = personal.name_model(docs.limit(0), tracks.limit(0))
    assert none.given == none.ordinary == frozenset() and none.weights.tolist() == person.plain_weights().tolist()


def test_common_skeletons_are_paired_whole(spark):
    rows = [(i, ("", "abc", "", True, "latin" if i % 2 else "cyrillic"), "krl") for i in range(60)] + [(99, ("trio", "abc", "", True, "latin"), "krl")]
    read = spark.createDataFrame(rows, f"id bigint, r {names._READ}, skel string")
    got = names.candidate_pairs(read, spark.createDataFrame([], "id bigint, rec bigint"))
    assert {(r.a, r.b) for r in got.collect()} == {(i, j) for j in range(60) for i in range(j)}


def test_typing_errors_in_title_and_album_leave_a_shared_key(spark):
    kind = "id bigint, title string, album string, artist string, sec double"
    left = matching.attributes(spark.createDataFrame([(1, "leavinghoher", "grjadolgu", "wesrick naldupelnol", 347.7)], kind), False)
    right = matching.attributes(spark.createDataFrame([(2, "lraving hoher", "gejadolgu", "wesrick naldupelnol", 346.7), (3, "lravinghoher", "gejadolgu", "naldupelnol", 346.7)], kind), True)
    assert {r.id for r in right.join(left.select("attr"), "attr").select("id").collect()} == {2, 3}


def bearers(n):
    """n names of one four-letter family name, with what links to each: (id, name) and the pairs that must meet."""
    letters = "bdfgklmnprstvz"
    rows, want = [], []
    for i in range(n // 3):
        given = "".join(letters[i // 14**k % 14] + "aeiou"[(i // 7 + k) % 5] for k in range(3)).capitalize() + "no"
        typo = given[1] + given[0] + given[2:] if i % 2 else given[:-2] + given[-1]
        a, b, c = f"{given} Berg", f"Berg, {given[0]}.", f"{typo.capitalize()} Berg"
        rows += [a, b, c]
        want += [(a, b), (a, c)]
    return rows, want


@pytest.mark.parametrize("n", [60, 5000])
def test_bearers_of_a_common_family_name_all_meet(spark, n):
    rows, want = bearers(n)
    distinct = sorted(set(rows))
    number = {v: i for i, v in enumerate(distinct)}
    read = spark.createDataFrame([(i, tuple(vars(names.read_name(v)).values()), "") for v, i in number.items()], f"id bigint, r {names._READ}, skel string")
    got = {(r.a, r.b) for r in names.candidate_pairs(read, spark.createDataFrame([], "id bigint, rec bigint")).collect()}
    assert len(distinct) > names.BLOCK - 20
    assert [p for p in want if p[0] != p[1] and (min(number[p[0]], number[p[1]]), max(number[p[0]], number[p[1]])) not in got] == []
    assert len(got) < len(distinct) ** 2 / 8 or n == 60
