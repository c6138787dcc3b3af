"""Problem 5: visually identical text brought to one form.

After compatibility normalisation and deletion of ignorable characters, each character spans a lattice of
itself and its look-alikes in other scripts; Viterbi finds the path that is best under the corpus' pair
model, in which words of mixed scripts are improbable, with a price for every change and for every change
of script inside a word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charmodel import END, START, PairModel, plain
from .encoding import clean_model, judge, non_ascii

#: Latin letters and what looks like them in Cyrillic, Greek and Armenian (fixed values).
CYRILLIC = {"A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "У", "a": "а", "c": "с", "e": "е", "h": "һ", "i": "і", "j": "ј", "k": "к", "l": "ӏ", "o": "о", "p": "р", "s": "ѕ", "x": "х", "y": "у", "d": "ԁ", "q": "ԛ", "w": "ԝ", "ë": "ё", "Ë": "Ё", "ï": "ї", "Ï": "Ї"}
GREEK = {"A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ", "i": "ι", "k": "κ", "o": "ο", "p": "ρ", "u": "υ", "v": "ν", "a": "α", "ó": "ό", "í": "ί"}
ARMENIAN = {"o": "օ", "n": "ո", "u": "ս", "h": "հ", "g": "ց"}
OTHER = {"i": "ı", "a": "ɑ", "g": "ɡ", "e": "ҽ"}
#: Arabic letters of other languages that look like an Arabic one (fixed values).
ARABIC = {"ی": "ي", "ک": "ك", "ہ": "ه", "ۃ": "ة"}
#: Nats a changed character costs; nats a change of script inside a word costs.
CHANGE, MIXED = 1.5, 6.0


@lru_cache(maxsize=None)
def script(c: str) -> str:
    """The script of a letter, '' for anything else."""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


@lru_cache(maxsize=None)
def _classes() -> dict[str, tuple[str, ...]]:
    of: dict[str, set[str]] = {}
    for table in (CYRILLIC, GREEK, ARMENIAN, OTHER):
        for a, b in table.items():
            of.setdefault(a, {a}).add(b)
    out: dict[str, set[str]] = {}
    for group in of.values():
        for c in group:
            out.setdefault(c, set()).update(group)
    for a, b in ARABIC.items():
        out[a] = {a, b}
    return {c: tuple(sorted(x)) for c, x in out.items()}


def lattice(text: str) -> list[tuple[str, ...]]:
    """The alternatives of each character, itself first."""
    classes = _classes()
    return [(c, *(x for x in classes.get(c, ()) if x != c)) for c in text]


def resolve(text: str, model: PairModel) -> str:
    """The best path through the look-alike lattice of a normalised text.

    A state is the last character and the script last written, at first that of the first letter without
    look-alikes; the script carries over spaces at an eighth of the price, so words made of look-alikes only
    follow their neighbours. Texts in which no word could be mixed
    or read in another script keep their characters.
    """
    if text.isascii():
        return text
    log = model.log
    first = next((script(c) for c in text if script(c) and c not in _classes()), "")
    states: dict[tuple[str, str], tuple[float, tuple | None]] = {(START, first): (0.0, None)}
    for options in lattice(text):
        nxt: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for k, c in enumerate(options):
            if c == " ":
                for (p, s), (x, back) in states.items():
                    y = x + log(p + END)
                    key = (START, s)
                    if key not in nxt or y > nxt[key][0]:
                        nxt[key] = (y, (c, back))
                continue
            sc = script(c)
            price = CHANGE if k else 0.0
            for (p, s), (x, back) in states.items():
                y = x + log(p + c) - price
                if sc and s and sc != s:
                    y -= MIXED if p != START and script(p) else MIXED / 8
                key = (c, sc or s)
                if key not in nxt or y > nxt[key][0]:
                    nxt[key] = (y, (c, back))
        states = nxt
    _, node = max(((x + log(p + END), back) for (p, _), (x, back) in states.items()), key=lambda z: z[0])
    out = []
    while node:
        out.append(node[0])
        node = node[1]
    return "".join(reversed(out))


def consistent(value: str | None, model: PairModel) -> str | None:
    """The one form of a value; null stays null, '' stays ''."""
    if not value or value.isascii():
        return value
    text = plain(value)
    if text.isascii():
        return text
    words = text.split(" ")
    if not any(_doubtful(w) for w in words):
        return text
    return resolve(text, model)


def _doubtful(word: str) -> bool:
    """Whether a word mixes scripts or could be read in another one as a whole."""
    kinds = {script(c) for c in word} - {""}
    if len(kinds) > 1:
        return True
    if not kinds or word.isascii():
        return False
    classes = _classes()
    return all(c in classes or not c.isalpha() for c in word) or any(c in ARABIC for c in word)


def form_column(spark, model: PairModel):
    """A pandas UDF from values to (form, garbled)."""
    shared = spark.sparkContext.broadcast(model.pair)  # bounded by charmodel.MOST_PAIRS

    @F.pandas_udf("struct<form: string, garbled: boolean>")
    def formed(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, memory = PairModel(shared.value), {}
        for s in values:
            rows = []
            for v in s:
                if (r := memory.get(v)) is None:
                    if len(memory) > 100_000:
                        memory.clear()
                    form = consistent(v, m)
                    r = memory[v] = (form, form != v and judge(v, m)[0])
                rows.append(r)
            yield pd.DataFrame(rows, columns=["form", "garbled"])

    return formed


def consistent_forms(tracks: DataFrame, columns: tuple[str, ...] = ("title", "artist"), model: PairModel | None = None) -> DataFrame:
    """(track_id, field, value, form, changed) of every non-null value of `tracks` (id and the columns), distinct.

    `changed` tells that the value was not in its form; values garbled by a wrong encoding (problem 4) keep
    their characters and are not changed. Empty and ASCII values are their own form; values of any length
    are resolved whole; an empty table gives an empty result.
    """
    model = model or clean_model(tracks)
    formed = form_column(tracks.sparkSession, model)
    long = tracks.select(F.col("id").alias("track_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("x")).select("track_id", "x.field", "x.value").where("value is not null")
    seen = long.where(non_ascii("value")).withColumn("f", formed("value")).select("track_id", "field", "value", F.when(F.col("f.garbled"), F.col("value")).otherwise(F.col("f.form")).alias("form"))
    same = long.where(~non_ascii("value")).select("track_id", "field", "value", F.col("value").alias("form"))
    return seen.unionByName(same).withColumn("changed", F.col("form") != F.col("value")).distinct()
