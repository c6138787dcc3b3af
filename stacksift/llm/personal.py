"""Problem 10: personal information inside free text, replaced by typed placeholders.

A skip-chain conditional random field over the mentions of a document. A mention is a stretch of text that
has the format of an item or the shape of a name; everything else is certainly no item and drops out of the
field. Each mention takes one of six labels. Formats and the words around numbers are unary factors with
stated weights; the unary factors of names are fitted (module `person`). Neighbouring mentions of a line share
chain factors, and distant mentions of the same number or of one family name share skip factors, so evidence
at one mention reaches the others. Marginals come from loopy belief propagation.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.session import cut
from . import person
from .person import NameModel, score, spans

LABELS = ("none", "email", "phone", "id_number", "address", "person_name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON_NAME]"}

#: Log-linear weights of the features: label -> gain over 'none'.
WEIGHTS: dict[str, dict[str, float]] = {
    "bias": {"email": -3.0, "phone": -3.0, "id_number": -3.0, "address": -3.0, "person_name": -3.0},
    "email_format": {"email": 8.0},
    "address_format": {"address": 8.0},
    "phone_strong": {"phone": 5.0, "id_number": -1.0},  # a format only phones have
    "phone_weak": {"phone": 1.5},
    "phone_cue": {"phone": 4.0, "id_number": -2.0},
    "phone_after": {"phone": 2.5},
    "id_strong": {"id_number": 4.5, "phone": -2.0},
    "id_weak": {"id_number": 1.0},
    "id_cue": {"id_number": 4.0, "phone": -3.0},
    "code_cue": {"phone": -8.0, "id_number": -8.0},  # barcodes, catalogue numbers, dates and the like
}
#: Chain factor for two neighbouring mentions of a line that are both items, and skip factors for agreement of similar and of the same mentions.
CHAIN, SKIP, SAME = 0.2, 3.0, 5.0
ROUNDS, THRESHOLD = 6, 0.5
#: Features of examples (about) that a task of the fit goes through, and the arrays that hold examples.
TASK_FEATURES = 8_000_000
PACKED = ("slots", "sizes", "labels", "times")
#: Least number of family names of a given name and of titles of a title word, and their least shares, which bound both sets by MOST_WORDS.
BORNE_BY, BORNE_SHARE, TITLES_BY, TITLE_SHARE, MOST_WORDS = 2, 4e-6, 3, 4e-5, 500_000

_D = r"[0-9٠-٩۰-۹]"
_DOT = r"(?:\s?[(\[{](?i:dot)[)\]}]\s?|\sDOT\s|\.)"
_AT = r"(?:[@＠﹫]|\s?[(\[{](?i:at)[)\]}]\s?|\sAT\s)"
_AT_SIGNS = ("@", "＠", "﹫")
#: Without one of these there is no other sign either.
_AT_WORDS = ("AT", *(at + end for at in ("at", "At", "aT") for end in ")]}"))
_AT_SIGN, _DOT_WORD = regex.compile(r"[@＠﹫]"), regex.compile(r"DOT|(?i:dot)[)\]}]")
_SPACE, _LAST_SPACE = regex.compile(r"\s"), regex.compile(r"(?r)\s")
_AT_MARK = regex.compile(r"[@＠﹫]|[(\[{](?i:at)[)\]}]|\sAT\s")
_EMAIL = regex.compile(rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}_%+-]+(?:{_DOT}[\p{{L}}\p{{N}}_%+-]+)*{_AT}[\p{{L}}\p{{N}}-]+(?:{_DOT}[\p{{L}}\p{{N}}-]+)*{_DOT}\p{{L}}{{2,24}}(?![\p{{L}}\p{{N}}_-])")
_NUMBER = regex.compile(rf"(?<![\p{{L}}\p{{N}}_.,:/@#-])(?!\d{{4}}-\d\d-\d\d)(?:\+\s?|\()?{_D}(?:(?:[ .\-/]|\)[ .-]?|[ ]?\()?{_D}){{6,22}}(?:,?\s(?:ext|x|extension|Durchwahl|poste|доб)\.?\s?{_D}{{1,5}})?(?![\p{{L}}\p{{N}}_])")
_CODE = regex.compile(rf"(?<![\p{{L}}\p{{N}}_.:/@#-])(?:(?!(?:ID|NI|EAN|UPC)\b)\p{{Lu}}{{1,3}}[- ]?{_D}(?:[- ]?{_D}){{4,12}}(?:[- ]?\p{{Lu}})?|{_D}{{5,9}}[- ]?\p{{Lu}})(?![\p{{L}}\p{{N}}_-])")
_EXT = rf"(?:,?\s(?:ext|extension|Durchwahl|poste|доб)\.?\s?{_D}{{1,5}})?"
#: Formats of telephone numbers (whole mention).
_PHONE_STRONG = regex.compile(
    rf"(?:\+{_D}{{1,3}}[ .-]?(?:\({_D}{{1,4}}\)[ .-]?)?{_D}{{1,5}}(?:[ .-]?{_D}{{2,5}}){{1,5}}|00{_D}{{2,3}}[ .-]?{_D}{{2,5}}(?:[ .-]?{_D}{{2,4}}){{1,5}}|\(0?{_D}{{2,5}}\)[ .-]?{_D}{{3,4}}[ .-]?{_D}{{3,4}}|{_D}{{3}}[.-]{_D}{{3}}[.-]{_D}{{4}}"
    rf"|0{_D}{{2,4}}[ .-]{_D}{{3,4}}[ .-]{_D}{{3,4}}|0{_D}{{4}}[ .-]{_D}{{6}}|{_D}{{2}}(?:[ .]{_D}{{2}}){{4}}|555-01{_D}{{2}}|[0٠][1-9١-٩]{_D}{{8,9}}|[0٠]{_D}{{2,4}}(?:[ .-]{_D}{{3,4}}){{2}}|[0٠]{_D}{{4}}[ .-]{_D}{{6}}|[0٠]{_D}{{2,4}}[/ -]{_D}{{5,8}}(?:-{_D}{{1,4}})?|\+{_D}{{2}} \(0\){_D}{{2,4}}[ /-]{_D}{{4,8}}(?:-{_D}{{1,4}})?|[1١][2-9٢-٩]{_D}{{9}}){_EXT}"
)
#: Formats of identity numbers (whole mention).
_ID_STRONG = regex.compile(rf"{_D}{{3}}-{_D}{{2}}-{_D}{{4}}|\p{{Lu}}{{2}}[ -]?{_D}{{2}}[ ]?{_D}{{2}}[ ]?{_D}{{2}}[ -]?\p{{Lu}}|\p{{Lu}}{{2}}[ -]?{_D}{{4}}[- ]?{_D}{{4}}|\p{{Lu}}-?{_D}{{7,8}}(?:-?\p{{Lu}})?|{_D}{{7,8}}-?\p{{Lu}}|[1-9] {_D}{{2}} {_D}{{2}} {_D}{{2}} {_D}{{3}} {_D}{{3}} {_D}{{2}}")
_ID_WEAK = regex.compile(rf"{_D}{{9,15}}|[\p{{Lu}}]{{1,3}}[ -]?[\d -]{{5,14}}\p{{Lu}}?")
_PHONE_CUE = regex.compile(r"(?:(?i:phone|fax|tel|tél|mobile?|cell|call|ring|text|whatsapp|sms|telefon|handy|teléfono|телефон|тел|هاتف|جوال)[\p{L} ./]{0,12}[:.]?|☎|☏|📞|(?i:ring me on|call|text|reach me on|(?<!passport |identity )number is))\s*\(?$")
_PHONE_AFTER = regex.compile(r"\s*\((?i:mobil|mobile|home|work|cell|office|büro|fax|as of|ask for)")
_ID_CUE = regex.compile(r"(?:\b(?i:id|passport|identity|social security|ni number|id card|my card|personalausweis|ausweis|pass|dni|nif|nie|insee|снилс|инн|паспорт)|الهوية|جواز)[^\d\n.;!?]{0,24}\.?\s?\(?$")
_CODE_CUE = regex.compile(r"(?:\b(?i:barcode|ean|isrc|strichcode|code-barres|código de barras|catalogue|cat\.|matrix|штрих-?код|invoice|rechnung|factura|facture|upc)|الباركود)[^\d\n.!?]{0,24}(?:\p{Lu}{2,4}\s?)?$|\w=$|^EAN ")

_TOWN = r"\p{Lu}[\p{L}'’-]+(?: (?:Bay|BAY))?"
_SEP = r"(?:,[ \n]|\n|,\n)"
_POST = r"(?:,?[ \n](?:\p{Lu}{1,2}\d{1,2}[A-Z]? \d\p{Lu}{2}|\p{Lu}{2} \d{5}(?:-\d{4})?))?"
_STREET = r"(?:\p{Lu}[\p{L}'’-]+ ){1,2}(?i:street|st\.|st|avenue|ave\.|ave|road|rd\.|rd|lane|ln\.|crescent|close|drive|dr\.|court|place|square|terrace|way|gardens|hill|grove|row|park|walk|mews|boulevard|blvd\.?)"
_ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?:"
    rf"(?:(?i:flat|apt\.?|apartment|unit|suite) \d+[A-Za-z]?{_SEP})?\d+[A-Za-z]? {_STREET}{_SEP}{_TOWN}{_POST}"
    rf"|(?i:p\.o\. box|po box) \d+{_SEP}{_TOWN}{_POST}"
    rf"|\p{{Lu}}[\p{{L}}-]*(?i:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer)[ \n]\d+ ?[a-zA-Z]?{_SEP}\d{{5}}[ \n]{_TOWN}"
    rf"|(?i:postfach|bp|b\.p\.|apartado(?: de correos)?) \d[\d ]*{_SEP}\d{{5}}[ \n]{_TOWN}"
    rf"|(?:C/|(?i:calle|avda\.|avenida|plaza|paseo|c\.)) ?(?:(?i:de|del|la|los) )*\p{{Lu}}[\p{{L}}'’-]+,?[ \n]\d+ ?[a-zA-Z]?{_SEP}\d{{5}}[ \n]{_TOWN}"
    rf"|\d+(?: bis| ter)?,?[ \n](?i:rue|avenue|boulevard|bd\.?|place|chemin|allée|impasse|quai)[ \n](?:(?i:de la|de l'|du|des|de|d') ?)?\p{{Lu}}[\p{{L}}'’-]+{_SEP}\d{{5}}[ \n]{_TOWN}"
    rf"|(?i:ул\.|улица|пр\.|пер\.|а/я)[ \n]?\p{{Lu}}?[\p{{L}}-]*(?:,[ \n]д\.[ \n]?)?\d*[а-я]?(?:,[ \n](?:корп|кв)\.[ \n]?\d+)*,[ \n](?i:г\.)[ \n]?\p{{Lu}}[\p{{L}}-]+"
    rf"|(?:شارع|طريق)[ \n][ء-ي]+(?:[ \n][ء-ي]+)?[ \n]{_D}+[،,][ \n][ء-ي]+"
    rf"|(?:ص\.ب\.?|صندوق بريد)[ \n]?{_D}+[،,][ \n][ء-ي]+"
    rf")"
)
_ADDRESS_MARK = regex.compile(r"\b(?i:street|st|ave|avenue|road|rd|lane|crescent|close|drive|court|place|square|terrace|way|gardens|hill|grove|row|park|walk|mews|boulevard|box|rue|calle|avda|avenida|plaza|paseo|postfach|bp|apartado|chemin|allée|impasse|quai|bd)\b|straße|strasse|str\.|STRASSE|weg |platz |gasse |allee |C/|ул\.|улица|пер\.|а/я|شارع|طريق|ص\.ب|صندوق")

#: Whether a stretch holds such a mark; a line may end after it.
_address_marks = person.Read(lambda chunk: _ADDRESS_MARK.search(chunk + " ") is not None)
#: The digits that every match of _NUMBER and of _CODE has.
_DIGITS_OF = {_NUMBER: re.compile(rf"{_D}(?:[ .\-/()]{{0,2}}{_D}){{6}}"), _CODE: re.compile(rf"{_D}(?:[- ]?{_D}){{4}}")}
#: What every address has: a number before a name, a postcode, a box's number or (in Russian) a town.
_ADDRESS_NUMBER = regex.compile(r"\d(?:[A-Za-z]? \p{Lu}|[،,][ \n][ء-ي])|\d{5}[ \n]\p{Lu}|[bB][oO][xX] \d|[гГ]\.")


@dataclass
class Mention:
    start: int
    end: int
    text: str
    features: set[str] = field(default_factory=set)
    key: str = ""
    score: float | None = None  # of a name, from the fitted weights
    same: str = ""  # of a name: both its words
    marginals: np.ndarray | None = None

    @property
    def label(self) -> str:
        """The likeliest item label if its marginal passes THRESHOLD, else 'none'."""
        k = int(np.argmax(self.marginals[1:])) + 1
        return LABELS[k] if self.marginals[k] >= THRESHOLD else "none"


def _key(text: str) -> str:
    """What makes two mentions similar: folded letters and digits, words in order of the alphabet."""
    words = regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKD", text).casefold())
    return " ".join(sorted(w for w in words if len(w) > 1 or w.isdigit()))


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Where the stretches between empty lines lie."""
    at = 0
    while at < len(text):
        stop = text.find("\n\n", at)
        stop = len(text) if stop < 0 else stop
        if stop > at:
            yield at, stop
        at = stop + 1


def _emails(text: str) -> Iterator[Mention]:
    """Emails of the stretches without spaces that hold a sign of one or, with signs in words, of such paragraphs; none goes over an empty line."""
    signs = [x for x in _AT_SIGNS if x in text]
    if any(x in text for x in _AT_WORDS) or signs and _DOT_WORD.search(text):
        where = [(a, b) for a, b in _paragraphs(text) if _AT_MARK.search(text, a, b)]
    else:
        where, end = [], 0
        for m in _AT_SIGN.finditer(text) if signs else ():
            if m.start() >= end:
                space, stop = _LAST_SPACE.search(text, 0, m.start()), _SPACE.search(text, m.start())
                end = stop.start() if stop else len(text)
                where.append((space.end() if space else 0, end))
    for a, b in where:
        for m in _EMAIL.finditer(text, a, b):
            yield Mention(m.start(), m.end(), m.group(), {"email_format"})


def _numbers(text: str) -> Iterator[Mention]:
    for pattern, digits in _DIGITS_OF.items():
        for m in pattern.finditer(text) if digits.search(text) else ():
            t, a, b = m.group(), m.start(), m.end()
            if t[0] == "(" and ")" not in t:
                t, a = t[1:], a + 1
            before = text[max(0, a - 40) : a]
            if pattern is _NUMBER and " " in t and not _PHONE_STRONG.fullmatch(t) and not _ID_STRONG.fullmatch(t):
                if parts := _split(t, a):
                    yield from parts
                    continue
            f = set()
            if _PHONE_STRONG.fullmatch(t):
                f.add("phone_strong")
            elif pattern is _NUMBER and 7 <= sum(c.isdigit() for c in t) <= 15:
                f.add("phone_weak")
            if _ID_STRONG.fullmatch(t):
                f.add("id_strong")
            elif _ID_WEAK.fullmatch(t):
                f.add("id_weak")
            if _ID_CUE.search(before):
                f.add("id_cue")
            elif _PHONE_CUE.search(before):
                f.add("phone_cue")
            elif ("phone_strong" not in f or not (" " in t or "+" in t)) and (_CODE_CUE.search(before) or t.startswith("EAN")):
                f.add("code_cue")
            if _PHONE_AFTER.match(text, b):
                f.add("phone_after")
            if f:
                yield Mention(a, b, t, f)


def _split(t: str, at: int) -> list[Mention]:
    """The telephone and identity numbers of strong format in a run of digit groups that is neither as a whole."""
    words, out, i = t.split(" "), [], 0
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    while i < len(words):
        for j in range(len(words), i, -1):
            part = " ".join(words[i:j])
            kinds = {f for f, p in (("phone_strong", _PHONE_STRONG), ("id_strong", _ID_STRONG)) if p.fullmatch(part)}
            if kinds:
                out.append(Mention(at + int(starts[i]), at + int(starts[i]) + len(part), part, kinds))
                i = j - 1
                break
        i += 1
    return out


def _addresses(text: str) -> Iterator[Mention]:
    """Addresses of the paragraphs that hold a number and a word of one; none goes over an empty line."""
    if _ADDRESS_NUMBER.search(text):
        for a, b in _paragraphs(text):
            if _ADDRESS_NUMBER.search(text, a, b) and any(map(_address_marks.__getitem__, person.chunks(text[a:b]))):
                for m in _ADDRESS.finditer(text, a, b):
                    yield Mention(m.start(), m.end(), m.group(), {"address_format"})


def _names(text: str, model: NameModel) -> Iterator[Mention]:
    for s in spans(text, model):
        yield Mention(s.start, s.end, text[s.start : s.end], {"name_shape"}, "name " + s.words[1], score=score(s, model), same=" ".join(s.words))


def mentions(text: str, model: NameModel) -> list[Mention]:
    """All mentions of a text in order; of overlapping ones of the same kind the first and longest."""
    out = [*_emails(text), *_addresses(text), *_numbers(text), *_names(text, model)]
    out.sort(key=lambda m: (m.start, -m.end))
    for m in out:
        m.key = m.key or _key(m.text)
    return out


_UNARY: dict[frozenset, np.ndarray] = {}


def _unary(features: frozenset) -> np.ndarray:
    u = _UNARY.get(features)
    if u is None:
        s = np.zeros(len(LABELS))
        for f in ("bias", *features):
            for label, w in WEIGHTS.get(f, {}).items():
                s[LABELS.index(label)] += w
        if not features & {"email_format"}:
            s[1] = -12.0
        if not features & {"address_format"}:
            s[4] = -12.0
        if not features & {"phone_strong", "phone_weak"}:
            s[2] = -12.0
        if not features & {"id_strong", "id_weak", "id_cue"}:
            s[3] = -12.0
        s[5] = -12.0
        u = _UNARY[features] = np.exp(s - s.max())
    return u


def _of_name(score_: float) -> np.ndarray:
    """Unary factor of a name-shaped mention: a name with the fitted odds, or nothing."""
    s = np.full(len(LABELS), -12.0)
    s[0], s[5] = 0.0, min(12.0, max(-12.0, score_))
    return np.exp(s - s.max())


_CHAIN = np.exp(np.array([[CHAIN if a and b else 0.0 for b in range(len(LABELS))] for a in range(len(LABELS))]))
_SKIP = np.exp(np.array([[SKIP if a == b and a else 0.0 for b in range(len(LABELS))] for a in range(len(LABELS))]))


_SAME = np.exp(np.array([[SAME if a == b and a else 0.0 for b in range(len(LABELS))] for a in range(len(LABELS))]))


def infer(found: list[Mention], text: str) -> None:
    """Sets the marginals of all mentions by loopy belief propagation.

    Chain factors join neighbours of a line; a skip factor joins each mention with the previous one of both
    the same words, else of the same key (digits of a number, family name), which makes a document of n mentions have at most 2n factors.
    """
    n = len(found)
    unary = [_unary(frozenset(m.features)) if m.score is None else _of_name(m.score) for m in found]
    edges: list[tuple[int, int, np.ndarray]] = []
    last: dict[str, int] = {}
    for i, m in enumerate(found):
        if i and found[i - 1].end <= m.start and "\n" not in text[found[i - 1].end : m.start]:
            edges.append((i - 1, i, _CHAIN))
        for key, factor in ((m.same, _SAME), (m.key, _SKIP)):
            if key and key in last:
                edges.append((last[key], i, factor))
                break
        last.update({key: i for key in (m.same, m.key) if key})
    if not edges:
        for m, u in zip(found, unary, strict=True):
            m.marginals = u / u.sum()
        return
    messages = {}
    around: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (i, j, _) in enumerate(edges):
        messages[k, 0] = messages[k, 1] = np.full(len(LABELS), 1 / len(LABELS))  # (k, 0) goes to j, (k, 1) to i
        around[i].append((k, 1))
        around[j].append((k, 0))
    for _ in range(ROUNDS):
        moved = 0.0
        for k, (i, j, factor) in enumerate(edges):
            for to, source in ((0, i), (1, j)):
                b = unary[source].copy()
                for q, side in around[source]:
                    if q != k:
                        b *= messages[q, side]
                out = factor.T @ b if to == 0 else factor @ b
                out /= out.sum()
                moved = max(moved, float(np.abs(out - messages[k, to]).max()))
                messages[k, to] = out
        if moved < 1e-4:
            break
    for i, m in enumerate(found):
        b = unary[i].copy()
        for q, side in around[i]:
            b *= messages[q, side]
        m.marginals = b / b.sum()


def items(text: str | None, model: NameModel) -> list[Mention]:
    """The items of a text, in order and without overlap; null and empty texts have none."""
    if not text:
        return []
    found = mentions(text, model)
    if not found:
        return []
    infer(found, text)
    rank = {"email": 0, "address": 1, "id_number": 2, "phone": 2, "person_name": 3}
    chosen: list[Mention] = []
    for m in sorted((m for m in found if m.label != "none"), key=lambda m: (rank[m.label], -m.marginals.max(), m.start - m.end)):
        if all(m.end <= c.start or m.start >= c.end for c in chosen):
            chosen.append(m)
    return sorted(chosen, key=lambda m: m.start)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with placeholders in place of the spans (start, end, kind)."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], PLACEHOLDERS[kind]]
            at = b
    return "".join([*out, text[at:]])


def _few(words: DataFrame) -> set[str]:
    got = words.limit(MOST_WORDS + 1).collect()
    if len(got) > MOST_WORDS:
        raise ValueError("more words than the lexicon may hold")
    return {r[0] for r in got}


def given_names(tracks: DataFrame) -> set[str]:
    """Given names of the library's artists: first words that stand before BORNE_BY different family names or more.

    One is enough where an initial stands between them, as it does in persons' names alone. Words before which
    most given names stand (trio, orchestra) are no family names. BORNE_SHARE of all names is the least at any
    size, so the set is bounded; that is checked.
    """
    names = tracks.select(F.explode(F.array("artist", "albumartist")).alias("name")).where(F.col("name").rlike(r"^\p{L}[\p{L}'-]{2,} (?:\p{L}\. )?\p{L}[\p{L}'-]{2,}$")).select(F.lower("name").alias("name")).distinct()
    pairs = cut(names.select(F.substring_index("name", " ", 1).alias("g"), F.substring_index("name", " ", -1).alias("f"), F.when(F.contains("name", F.lit(". ")), BORNE_BY).otherwise(1).alias("w")))
    n, firsts = pairs.agg(F.count("*"), F.count_distinct("g")).first()
    many = pairs.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= max(20, 0.02 * firsts)).select("f")
    return _few(pairs.join(many.hint("merge"), "f", "left_anti").groupBy("g").agg(F.sum("w").alias("n")).where(F.col("n") >= max(BORNE_BY, BORNE_SHARE * n)).select("g"))


def title_words(tracks: DataFrame) -> set[str]:
    """Words of TITLES_BY different titles or albums or more; TITLE_SHARE of all is the least at any size, which bounds the set."""
    named = [c for c in ("title", "album") if c in tracks.columns]
    if not named:
        return set()
    values = tracks.select(F.explode(F.array(*named)).alias("v")).where("v is not null").distinct()
    words = cut(values.select(F.explode(F.array_distinct(F.split(F.lower("v"), r"[^\p{L}\p{M}'’-]+"))).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n")))
    n = words.agg(F.sum("n")).first()[0] or 0
    return _few(words.where(F.col("n") >= max(TITLES_BY, TITLE_SHARE / 6 * n)).select("w"))


def name_model(documents: DataFrame, tracks: DataFrame) -> NameModel:
    """The name model of the library's given names and title words, fitted on all documents."""
    return fit_documents(documents.select("text"), given_names(tracks), title_words(tracks))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for b in batches:
        yield from b.column(0).to_pylist()


def fit_documents(texts: DataFrame, given: set[str], titles: set[str] = frozenset()) -> NameModel:
    """`person.fit_names` of all different `texts` (text), counted and fitted where they lie.

    Counts of words stay in tables; the driver gets the words that SHARE of the texts have and the given names
    learned (MOST_WORDS of either, checked) and, in each pass of the fit, the sum of the slopes by slot.
    """
    texts = cut(texts.where("text is not null and text <> ''").distinct())
    sc = texts.sparkSession.sparkContext
    least = person.least_texts(texts.count())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for df, lower in person.count_words(_strings(batches)):
            words = list(df.keys() | lower.keys())
            yield pa.RecordBatch.from_pydict({"word": words, "n": [df[w] for w in words], "low": [lower[w] for w in words]}, pa.schema([("word", pa.string()), ("n", pa.int64()), ("low", pa.int64())]))

    words = cut(texts.mapInArrow(counted, "word string, n bigint, low bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low")))
    common, lower = (_few(words.where(F.col(c) >= least).select("word")) for c in ("n", "low"))
    frequent = sc.broadcast((common, lower))  # bounded by MOST_WORDS

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in person.count_followed(_strings(batches), *frequent.value):
            rows = [(a, k, None) for a, (k, _) in part.items()] + [(a, 0, b) for a, (_, f) in part.items() for b in f]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["word", "k", "follower"])

    follows = texts.mapInArrow(followed, "word string, k bigint, follower string").groupBy("word").agg(F.sum("k").alias("k"), F.count_distinct("follower").alias("followers")).where(F.col("followers") >= person.FOLLOWED)
    learned = _few(follows.join(words.hint("merge"), "word").where(F.col("k") >= person.FOLLOWING * F.col("n")).select("word"))
    base = person.lexicon(common, lower, set(given) | (learned - person.HONORIFICS - titles), titles)
    shared = sc.broadcast(base)

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in person.examples(_strings(batches), shared.value):
            ones, zeros = rows.labelled()
            yield pa.RecordBatch.from_pydict({**{k: [x.tobytes()] for k, x in zip(PACKED, rows.arrays, strict=True)}, "features": [len(rows.arrays[0])], "ones": [ones], "zeros": [zeros]})

    examples = cut(texts.mapInArrow(taught, ", ".join(f"{k} binary" for k in PACKED) + ", features bigint, ones bigint, zeros bigint"))
    features, ones, zeros = examples.agg(F.sum("features"), F.sum("ones"), F.sum("zeros")).first()
    if not features:
        return replace(base, weights=person.plain_weights())
    parts = examples.select(*PACKED).rdd.coalesce(-(-features // TASK_FEATURES)).map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def slopes(w: np.ndarray) -> np.ndarray:
        now = sc.broadcast(w)
        total = parts.map(lambda r: person.Rows.packed(*r).slopes(now.value, ones, zeros)).treeReduce(np.add)
        now.destroy()
        return total

    weights = person.regression(slopes)
    parts.unpersist()
    return replace(base, weights=weights)


_ITEMS = "array<struct<start: int, end: int, kind: string, found_text: string, confidence: double>>"


def items_column(spark, model: NameModel):
    """A pandas UDF from texts to their items; positions count characters."""
    shared = spark.sparkContext.broadcast(model)  # bounded by MOST_WORDS and the number of slots

    @F.pandas_udf(_ITEMS)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in texts:
            yield pd.Series([[{"start": x.start, "end": x.end, "kind": x.label, "found_text": x.text, "confidence": round(float(x.marginals.max()), 4)} for x in items(t, m)] for t in s], dtype=object)

    return found


def document_items(documents: DataFrame, tracks: DataFrame, model: NameModel | None = None) -> DataFrame:
    """(doc_id, start, end, kind, found_text, confidence): the items of all `documents` (doc_id, text).

    Names that are a whole value of tracks.artist or tracks.albumartist, in whatever case, are artists and no
    items. Null, empty and blank texts have no items; texts of any length are read whole; repeated rows
    count once; columns besides the named ones are not read.
    """
    find = items_column(documents.sparkSession, model or name_model(documents, tracks))
    each = documents.select("doc_id", "text").where("text is not null and text <> ''").select("doc_id", F.explode(find("text")).alias("x")).select("doc_id", "x.*").distinct()
    artists = tracks.select(F.explode(F.array("artist", "albumartist")).alias("a")).where("a is not null").select(F.lower("a").alias("a")).distinct()
    # one anti-join for all items: what is no name gets a key that no artist has, spread over the tasks
    key = F.when(F.col("kind") == "person_name", F.lower(F.regexp_replace("found_text", r"\n", " "))).otherwise(F.concat(F.lit("\x00"), F.pmod(F.xxhash64("doc_id"), F.lit(4096)).cast("string")))
    return each.withColumn("a", key).join(artists, "a", "left_anti").drop("a")


def redacted_documents(documents: DataFrame, tracks: DataFrame, model: NameModel | None = None) -> DataFrame:
    """(doc_id, text, items) of every document, its items replaced by typed placeholders; null stays null."""
    spans = document_items(documents, tracks, model).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans_: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None or not len(s) else redact(t, [(x["start"], x["end"], x["kind"]) for x in s]) for t, s in zip(texts, spans_, strict=True)], dtype=object)

    return documents.select("doc_id", "text").distinct().join(spans, "doc_id", "left").select("doc_id", replaced("text", "spans").alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("items"))
