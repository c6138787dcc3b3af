"""Problem 2: variant spellings of names typed by people.

Names are read (order, initials, titles, ensemble words, script), their token suffixes are indexed, suffix
blocks that are too common are refined with the recordings the names stand on and the rest of the name
before being given up, and the pairs of a block are compared by longest-common-subsequence ratio.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.session import cut
from ..functions.fuzzy import lcs
from .charmodel import PairModel
from .consolidate import consolidate
from .encoding import clean_model, judge
from .lookalike import consistent

#: Suffixes are indexed from this length; blocks above BLOCK names are refined with other fields.
SUFFIX, BLOCK = 4, 48
#: Least LCS ratio of family or ensemble names, and of given names, that are the same but for typing.
CORE_RATIO, GIVEN_RATIO = 0.8, 0.72
#: Ensemble words, by which ensembles of one name differ (fixed values).
ENSEMBLES = ("symphony orchestra", "chamber choir", "chamber orchestra", "big band", "orchestra", "philharmonic", "ensemble", "quartet", "quintet", "sextet", "trio", "duo", "collective", "brothers", "sisters", "choir", "band", "group")
#: Short forms no rule gives (fixed values).
SHORT = {"3o": "trio", "bros": "brothers", "bros.": "brothers", "4tet": "quartet", "5tet": "quintet", "qt": "quartet", "qt.": "quartet", "orch": "orchestra", "phil": "philharmonic", "ens": "ensemble", "coll": "collective", "so": "symphony orchestra", "bb": "big band", "cc": "chamber choir", "srs": "sisters", "str": "string"}
TITLES = {"mr", "mrs", "ms", "dr", "prof", "sir", "dj", "mc", "herr", "frau", "sr", "sra", "mme", "don"}
FILLERS = {"the", "of", "and", "&", "und", "et", "y"}
#: Well-known short forms of given names (fixed values).
NICKNAMES = {"abby": "abigail", "alex": "alexander", "andy": "andrew", "ben": "benjamin", "beth": "elizabeth", "bill": "william", "bob": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher", "chuck": "charles", "dan": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard", "ed": "edward", "fred": "frederick", "fritz": "friedrich", "jim": "james", "jimmy": "james", "jenny": "jennifer", "joe": "joseph", "jon": "jonathan", "kate": "katherine", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "liz": "elizabeth", "lola": "dolores", "lupe": "guadalupe", "maggie": "margaret", "matt": "matthew", "mike": "michael", "nacho": "ignacio", "ned": "edward", "nick": "nicholas", "paco": "francisco", "pancho": "francisco", "peggy": "margaret", "pepe": "jose", "penny": "penelope", "pete": "peter", "richie": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel", "sasha": "alexander", "steve": "steven", "sue": "susanna", "ted": "theodore", "tom": "thomas", "tony": "anthony", "vicky": "victoria", "will": "william", "becky": "rebecca", "gus": "augustus", "manny": "emmanuel", "sandy": "alexander", "greg": "gregory", "gio": "giovanni", "frankie": "francesca", "tori": "victoria", "dima": "dmitri", "stas": "stanislav", "max": "maximilian", "sonya": "sofia", "kostya": "konstantin", "vanya": "ivan", "misha": "mikhail", "kolya": "nikolai", "nat": "nathaniel", "pat": "patricia", "tricia": "patricia", "hank": "henry", "hans": "johannes", "gabe": "gabriel", "josh": "joshua", "kathy": "katherine", "kit": "christopher"}

_CYR = dict(zip("абвгдезийклмнопрстуфхцъыьэ", ["a", "b", "v", "g", "d", "e", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "", "y", "", "e"], strict=True)) | {"ё": "e", "ж": "zh", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}
_GRK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", ["a", "v", "g", "d", "e", "z", "i", "th", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "s", "t", "y", "f", "ch", "ps", "o"], strict=True))
_ARA = dict(zip("ابتثجحخدذرزسشصضطظعغفقكلمنهويىةءأإآؤئ", ["a", "b", "t", "th", "j", "h", "kh", "d", "dh", "r", "z", "s", "sh", "s", "d", "t", "z", "a", "gh", "f", "q", "k", "l", "m", "n", "h", "u", "i", "i", "h", "", "a", "a", "a", "u", "i"], strict=True))
_LATIN = {"ø": "o", "ß": "ss", "ł": "l", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
_LETTERS = _CYR | _GRK | _ARA | _LATIN


@lru_cache(maxsize=100_000)
def _fold_char(c: str) -> str:
    t = _LETTERS.get(c)
    if t is not None:
        return t
    return "".join(_LETTERS.get(x, x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def fold(text: str) -> str:
    """Lower case in Latin letters without marks; other scripts are transliterated letter by letter."""
    if text.isascii():
        return text.lower()
    return "".join([_fold_char(c) for c in unicodedata.normalize("NFKC", text).lower()])


def skeleton(token: str) -> str:
    """Consonants as different romanisations agree on them."""
    t = re.sub("kh|ch", "k", token)
    t = re.sub("sh|ts", "s", t)
    t = re.sub("zh", "z", t)
    t = re.sub("gh", "g", t)
    t = re.sub("th", "t", re.sub("dh", "d", t))
    return re.sub(r"[aeiouywhj']", "", t.replace("q", "k").replace("j", "g")) if t else ""


def ratio(a: str, b: str) -> float:
    """2 LCS / (len a + len b); 1 for two empty strings, 0 against one."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else float(a == b)


@dataclass(frozen=True)
class Reading:
    """A name as read: an ensemble's `kind` is its ensemble word, a person's is ''."""

    kind: str
    core: str  # family or ensemble name
    given: str  # '' for ensembles and single names
    ordered: bool  # whether it is sure which token is the family name
    script: str


@lru_cache(maxsize=None)
def _ensemble_words() -> dict[str, str]:
    return {w: w for e in ENSEMBLES for w in e.split()}


def _ensemble_word(token: str) -> str | None:
    bare = token.rstrip(".")
    if token in SHORT or bare in SHORT:
        return SHORT.get(token) or SHORT[bare]
    words = _ensemble_words()
    if bare in words:
        return bare
    if token.endswith(".") and len(bare) >= 2:
        hits = [w for w in words if w.startswith(bare)]
        if len(hits) == 1 or hits and len(bare) >= 3:
            return hits[0]
    if len(bare) >= 5:
        best = max(words, key=lambda w: ratio(bare, w))
        if ratio(bare, best) >= 0.82 and abs(len(best) - len(bare)) <= 2:
            return best
    return None


def read_name(name: str, model: PairModel | None = None) -> Reading:
    """The reading of a name; an empty or unreadable one has an empty core."""
    text = name
    if model is not None and not name.isascii():
        garbled, restored, _ = judge(name, model)
        text = restored if garbled and restored else consistent(name, model) or name
    letters = [unicodedata.name(c, "?").split(" ")[0] for c in text if c.isalpha()]
    script = max(set(letters), key=letters.count) if letters else ""
    low = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", fold(text))
    low = re.sub(r"\b([a-z])\.([a-z])\.(?![a-z])", r"\1\2", low)
    turned = False
    if low.count(",") == 1:
        a, b = low.split(",")
        if b.strip():
            low, turned = f"{b} {a}", True
    raw = [t for t in re.split(r"[\s_/,;\-]+", low) if t]
    raw = [t for t in raw if t.strip(".'") and t.strip(".") not in TITLES]
    kinds = [(t, _ensemble_word(t)) for t in raw]
    for i, (t, k) in enumerate(kinds[:-1]):  # "ch." stands for chamber only before another ensemble word
        if t.rstrip(".") == "ch" and kinds[i + 1][1] and kinds[i + 1][1] != "chamber":
            kinds[i] = (t, "chamber")
    if sum(k is not None for _, k in kinds) and len([1 for t, k in kinds if k is None and t.strip(".") not in FILLERS]) >= 1:
        word = " ".join(k for _, k in kinds if k)
        kind = next((e for e in ENSEMBLES if all(w in word.split() for w in e.split())), word)
        core = " ".join(re.sub(r"[^a-z0-9؀-ۿ]", "", t) for t, k in kinds if k is None and t.strip(".") not in FILLERS)
        return Reading(kind, core.strip(), "", True, script)
    tokens = [re.sub(r"[^a-z0-9.\u0080-￿]", "", t) for t in raw if t not in FILLERS]
    tokens = [t for t in tokens if t.strip(".")]
    if not tokens:
        return Reading("", "", "", True, script)
    if len(tokens) == 1:
        return Reading("", tokens[0].strip("."), "", True, script)
    first, last = tokens[0], tokens[-1]
    if len(last.strip(".")) <= 1 < len(first.strip(".")) and not turned:
        first, last, turned = last, first, True
    given = first if first.endswith(".") or len(first) == 1 else first.strip(".")
    return Reading("", last.strip("."), given if len(given.strip(".")) > 1 else given.strip(".") + ".", turned or given.endswith("."), script)


def given_fit(a: str, b: str) -> str:
    """'same', 'typo', 'short' (initial or abbreviation), 'nick' or '' for two given names."""
    x, y = a.strip("."), b.strip(".")
    if x == y:
        return "same" if not (a.endswith(".") and len(x) == 1) else "short"
    if a.endswith(".") or b.endswith("."):
        return "short" if (x.startswith(y) or y.startswith(x)) and x and y else ""
    if NICKNAMES.get(x, x) == NICKNAMES.get(y, y):
        return "nick"
    return "typo" if ratio(x, y) >= GIVEN_RATIO else ""


def compare(a: Reading, b: Reading) -> tuple[str, float]:
    """(how, LCS ratio) of two readings; how is 'same', 'typo', 'short', 'nick', 'family' (only the family name fits) or ''."""
    if not a.core or not b.core or a.kind != b.kind:
        return "", 0.0
    cross = a.script != b.script
    if a.kind:
        r = max(ratio(a.core, b.core), _cross(a.core, b.core) if cross else 0.0)
        return ("same" if r == 1 else "typo", r) if r >= CORE_RATIO else ("", r)
    best = ("", 0.0)
    turns = [(b.core, b.given)] + ([(b.given, b.core)] if b.given and not (a.ordered and b.ordered) and not b.given.endswith(".") else [])
    for core, given in turns:
        r = ratio(a.core, core)
        if cross:
            r = max(r, _cross(a.core, core))
        if r < CORE_RATIO:
            continue
        if not a.given and not given:
            how = "same" if r == 1 else "typo"
        elif not a.given or not given:
            how = ""
        else:
            how = given_fit(a.given, given)
            if cross and not how and (skeleton(a.given) == skeleton(given) or _cross(a.given, given) >= CORE_RATIO):
                how = "same"
            how = how or "family"
        if how == "same" and r < 1 and not cross:
            how = "typo"
        rank = ("", "family", "nick", "short", "typo", "same").index
        if rank(how) > rank(best[0]):
            best = (how, r)
    return best


def _cross(a: str, b: str) -> float:
    x, y = skeleton(a), skeleton(b)
    return ratio(x, y) if min(len(x), len(y)) >= 2 else 0.0


_READ = "struct<kind: string, core: string, given: string, ordered: boolean, script: string>"


def _readings(names: DataFrame, model: PairModel) -> DataFrame:
    shared = names.sparkSession.sparkContext.broadcast(model.pair)

    @F.pandas_udf(_READ)
    def read(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = PairModel(shared.value)
        for s in values:
            yield pd.DataFrame([vars(read_name(v, m)) for v in s], columns=["kind", "core", "given", "ordered", "script"])

    return names.withColumn("r", read("name"))


_FIELDS = ["kind", "core", "given", "ordered", "script"]


def _compared():
    @F.pandas_udf("struct<how: string, ratio: double>")
    def compared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left = [Reading(*x) for x in a[_FIELDS].itertuples(index=False, name=None)]
        right = [Reading(*x) for x in b[_FIELDS].itertuples(index=False, name=None)]
        return pd.DataFrame([compare(x, y) for x, y in zip(left, right, strict=True)], columns=["how", "ratio"])

    return compared


def _skeletons():
    @F.pandas_udf("string")
    def skeletons(s: pd.Series) -> pd.Series:
        return s.map(skeleton)

    return skeletons


def _formal():
    """Given name to the form its nickname stands for, as a literal map."""
    return F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])


def suffix_keys(readings: DataFrame) -> DataFrame:
    """(id, key, parent, kind, t, other): each token's suffixes, and those of its mirror image, from SUFFIX letters on.

    `parent` is the next shorter suffix, `t` the token as it stands or mirrored, `other` what the rest of a
    person's name is: the given name of a family name and the other way round, in its formal form.
    """
    bare = lambda c: F.regexp_replace(c, r"\.$", "")
    formal = lambda c: F.coalesce(F.element_at(_formal(), c), c)
    of_core = F.transform(F.split("r.core", " "), lambda t: F.struct(t.alias("t"), F.when(F.col("r.kind") == "", F.when(F.col("r.given").endswith("."), F.col("r.given")).otherwise(formal(F.col("r.given")))).otherwise("").alias("other")))
    of_given = F.array(F.struct(bare("r.given").alias("t"), formal(F.col("r.core")).alias("other")))
    tokens = F.array_distinct(F.filter(F.concat(of_core, of_given), lambda x: F.length(x["t"]) >= SUFFIX))
    both = F.concat(F.transform(tokens, lambda x: F.struct(F.lit("s").alias("side"), x["t"].alias("t"), x["other"].alias("other"))), F.transform(tokens, lambda x: F.struct(F.lit("p").alias("side"), F.reverse(x["t"]).alias("t"), x["other"].alias("other"))))
    each = readings.select("id", F.col("r.kind").alias("kind"), F.explode(both).alias("x")).select("id", "kind", "x.*")
    long = each.select("id", "kind", "side", "t", "other", F.explode(F.sequence(F.lit(SUFFIX), F.length("t"))).alias("n"))
    return long.select("id", F.concat("side", F.expr("right(t, n)")).alias("key"), F.when(F.col("n") > SUFFIX, F.concat("side", F.expr("right(t, n - 1)"))).alias("parent"), "kind", "t", "other").distinct()


def refined(common: DataFrame) -> DataFrame:
    """(key, id, whole) of names in suffix blocks that are too common, split by what else the names say.

    The parts are told by kind and by the rest of the name: by the first four letters of the other token (of
    the token's far end where there is no other), with each single letter left out, so that one typing error
    still meets; and by its last three letters. Initials and abbreviations meet every name of their block
    whose other token starts alike (`whole` is false on full names there: two of these don't meet).
    """
    short = F.col("other").endswith(".") | (F.length("other") == 1)
    head = F.substring(F.when(F.col("other") != "", F.col("other")).otherwise(F.col("t")), 1, 4)
    left_out = F.transform(F.sequence(F.lit(1), F.length(head)), lambda i: F.concat(F.substring(head, F.lit(1), i - 1), F.substring(head, i + 1, F.lit(4))))
    part = lambda tag, x, whole: F.struct(F.concat(F.lit(tag), x).alias("part"), whole.alias("whole"))
    yes = F.lit(True)
    full = F.concat(F.transform(F.array_distinct(F.concat(F.array(head), left_out)), lambda x: part("h", x, yes)), F.array(part("e", F.right("other", F.lit(3)), yes), part("i", F.substring("other", 1, 1), F.lit(False))))
    none = F.transform(F.array_distinct(F.concat(F.array(head), left_out)), lambda x: part("h", x, yes))
    parts = F.when(F.col("other") == "", none).when(short, F.array(part("i", F.substring("other", 1, 1), yes))).otherwise(full)
    return common.select("id", "key", "kind", F.explode(parts).alias("x")).select(F.xxhash64(F.lit("refined"), "key", "kind", "x.part").alias("key"), "id", "x.whole")


def _met(blocks: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, that share a block of (key, id, whole) and of which one is `whole`; large blocks are split by salts."""
    blocks = blocks.groupBy("key", "id").agg(F.bool_or("whole").alias("whole"))
    n = blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = blocks.join(n, "key").withColumn("salts", F.ceil(F.col("n") / (4 * BLOCK)).cast("int"))
    x = sized.select("key", F.col("id").alias("a"), F.col("whole").alias("wa"), F.pmod(F.xxhash64("id"), "salts").cast("int").alias("s"))
    y = sized.select("key", F.col("id").alias("b"), F.col("whole").alias("wb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
    return x.join(y, ["key", "s"]).where("a < b and (wa or wb)").select("a", "b").distinct()


def candidate_pairs(readings: DataFrame, recordings: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of names sharing a suffix block, or kind and skeleton (`skel`), whatever the block's size.

    A suffix is used where its block has at most BLOCK names and the next shorter suffix' block has more.
    The shortest suffixes that are too common are discarded only after they were refined with other fields:
    their blocks are split by the recordings (id, rec) of the names, and by kind and the rest of the name
    (`refined`), whatever the suffix' length. No block is dropped; those that stay large are split by salts.
    """
    keys = cut(suffix_keys(readings))
    n = keys.groupBy("key").agg(F.count_distinct("id").alias("n"))
    common = n.where(F.col("n") > BLOCK).select("key")
    small = n.where((F.col("n") > 1) & (F.col("n") <= BLOCK)).select("key")
    minimal = keys.join(small, "key", "left_semi").join(common.select(F.col("key").alias("parent"), F.lit(True).alias("c")), "parent", "left").where("parent is null or c").select(F.xxhash64("key").alias("key"), "id")
    least = cut(keys.where("parent is null").join(common, "key", "left_semi").select("id", "key", "kind", "t", "other"))
    wide = least.select("key", "id").distinct().join(recordings, "id").select(F.xxhash64(F.lit("recording"), "key", "rec").alias("key"), "id")
    foreign = readings.where("length(skel) >= 3").select(F.xxhash64(F.lit("skeleton"), "skel", "r.kind").alias("key"), "id")
    whole = reduce(DataFrame.unionByName, [minimal, wide, foreign]).withColumn("whole", F.lit(True))
    return _met(whole.unionByName(refined(least)))


def shared_recordings(pairs: DataFrame, recordings: DataFrame) -> DataFrame:
    """(a, b, shared): recordings that carry both names of a pair (a, b, na, nb); followed from the rarer name, na and nb being their numbers."""
    rarer = F.coalesce("na", F.lit(0)) <= F.coalesce("nb", F.lit(0))
    by = pairs.select("a", "b", F.when(rarer, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(rarer, F.col("b")).otherwise(F.col("a")).alias("other"))
    return by.join(recordings, "id").select("a", "b", F.col("other").alias("id"), "rec").join(recordings, ["id", "rec"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("shared"))


def tag_key(column: str):
    """Letters and digits of a tag in lower case."""
    return F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}\p{N}]+", "")


def name_links(tracks: DataFrame, model: PairModel | None = None, various: tuple[str, ...] = ("various artists", "various", "va")) -> tuple[DataFrame, DataFrame]:
    """(names (id, name, r), links (a, b, how, ratio, shared)) among the distinct values of artist and albumartist."""
    model = model or clean_model(tracks)
    rows = tracks.select("id", "title", "album", F.explode(F.array_distinct(F.array("artist", "albumartist"))).alias("name")).where(F.col("name").isNotNull() & (F.trim("name") != "") & ~F.lower(F.trim("name")).isin(*various))
    with_rec = rows.select("name", F.when((tag_key("title") != "") & (tag_key("album") != ""), F.xxhash64(tag_key("title"), tag_key("album"))).alias("rec")).distinct()
    distinct = with_rec.select("name").distinct()
    names = cut(_readings(distinct.select(F.xxhash64("name").alias("id"), "name"), model).withColumn("skel", _skeletons()("r.core")))
    recordings = cut(with_rec.where("rec is not null").select(F.xxhash64("name").alias("id"), "rec"))
    pairs = candidate_pairs(names, recordings)
    # what later steps ask of a name travels with the pair, so no step joins the names again
    families = names.where("r.given <> '' and r.kind = '' and r.given not like '%.'").groupBy(F.col("r.given").alias("given")).agg(F.approx_count_distinct("r.core").alias("families"))
    told = names.select("id", "r", F.col("r.given").alias("given")).join(families, "given", "left").join(recordings.groupBy("id").agg(F.count("*").alias("n")), "id", "left")
    told = cut(told.select("id", F.struct("r", F.coalesce("families", F.lit(0)).alias("families"), (F.col("given").endswith(".") & (F.col("r.kind") == "")).alias("short"), "n").alias("x")))
    seen = pairs.join(told.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(told.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
    ends = [F.col(f"x{s}.{c}").alias(n + s) for s in "ab" for c, n in (("families", "f"), ("short", "s"), ("r.given", "g"), ("n", "n"))]
    fit = cut(seen.withColumn("c", _compared()("xa.r", "xb.r")).where("c.how <> ''").select("a", "b", "c.how", "c.ratio", *ends))
    links = fit.join(shared_recordings(fit, recordings), ["a", "b"], "left").fillna(0, ["shared"])
    return names, cut(links)


def same_names(tracks: DataFrame, model: PairModel | None = None) -> DataFrame:
    """(name, entity): every value of artist and albumartist, `entity` being one of the names that mean the same.

    Links by equal readings or typing errors join names first, unless both given names are established
    (borne with three family names or more, and a twentieth of the other's) and differ. Initials, abbreviations, nicknames and names of which
    only the family name fits then join the one group of full names they share most recordings with; an
    initial also joins where its family has only one group it fits. Null, blank and collective values
    ('Various Artists') are no names; a name without partners is its own entity; empty in, empty out.
    """
    names, l = name_links(tracks, model)
    established = (F.col("how") == "typo") & (F.least("fa", "fb") >= 3) & (F.least("fa", "fb") >= 0.05 * F.greatest("fa", "fb"))
    strong = (F.col("how") == "same") | (F.col("how") == "nick") | ((F.col("how") == "typo") & ~(established & (F.col("ga") != F.col("gb")) & (F.col("shared") == 0)))
    l = l.withColumn("strong", strong)
    first = consolidate(l.where("strong").select(F.col("a").alias("u"), F.col("b").alias("v")))
    group = cut(names.select("id").join(first.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("g")))
    weak = l.where("not strong and (how = 'short' or shared > 0)")
    weak = weak.join(group.select(F.col("id").alias("a"), F.col("g").alias("ka")), "a").join(group.select(F.col("id").alias("b"), F.col("g").alias("kb")), "b").where("ka <> kb")
    turned = lambda x, y: F.struct(F.col("k" + x).alias("gx"), F.col("k" + y).alias("gy"), F.col("s" + x).alias("sx"), F.col("s" + y).alias("sy"))
    to = weak.select("how", "shared", "ratio", F.explode(F.array(turned("a", "b"), turned("b", "a"))).alias("x")).select("how", "shared", "ratio", "x.*")
    per = to.groupBy("gx", "gy").agg(F.sum("shared").alias("shared"), F.max(F.when(F.col("how") == "short", 1).otherwise(0)).alias("fits"), F.max("ratio").alias("ratio"), F.max(F.col("sx").cast("int")).alias("sx"), F.max(F.col("sy").cast("int")).alias("sy"))
    # a group picks its best partner, one with a full name that fits before others; groups of initials pick, full names are picked
    pick = per.where("(sx = 1 and sy = 0) or (sx = sy and shared > 0)").groupBy("gx").agg(F.max_by(F.struct("gy", "shared", "fits"), F.struct(((F.col("sy") == 0) & (F.col("fits") == 1)).cast("int"), F.col("shared"), F.col("fits"), F.col("ratio"), F.col("gy"))).alias("p"), F.count_if(F.col("fits") == 1).alias("choices"))
    joined = pick.where("(p.shared > 0 and p.fits = 1) or p.shared > 1 or (p.fits = 1 and choices = 1)").select(F.col("gx").alias("u"), F.col("p.gy").alias("v"))
    # groups are settled already: only their joins are consolidated, not all links again
    second = consolidate(joined)
    return names.select("id", "name").join(group, "id").join(second.select(F.col("node").alias("g"), "root"), "g", "left").select("name", F.coalesce("root", "g").alias("entity"))


def name_pairs(entities: DataFrame) -> DataFrame:
    """Distinct (name_a, name_b), name_a < name_b by code point, of one entity; the statement asks for pairs.

    An entity's names are salted over both sides of the join, so many spellings of one name share the work
    of several tasks.
    """
    several = entities.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity")
    e = entities.join(several, "entity", "left_semi")
    salts = 8
    left = e.select("entity", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int").alias("s"))
    right = e.select("entity", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    return left.join(right, ["entity", "s"]).where("name_a < name_b").select("name_a", "name_b").distinct()
