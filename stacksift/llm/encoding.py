"""Problem 4: text decoded with the wrong character encoding, found and, where possible, restored.

Adjacent pairs are scored by their share of the corpus mutual information; the maximum-scoring segments of
improbable pairs are the only places where inverse mappings (encode with the encoding that was wrongly
used, decode with the one that was right) are tried. A mapping is taken if it makes the value likelier
under the pair model.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charmodel import END, START, PairModel, is_ignorable, pair_counts, pairs_of, plain, plain_char, values_of

#: Encodings as which UTF-8 is commonly misread (fixed values).
MISREAD = ("cp1252", "latin-1", "cp1251", "cp1256", "cp1250", "cp437", "cp850", "mac_roman", "cp1253", "cp1254", "cp1257", "koi8-r", "cp866", "iso8859-2", "iso8859-7", "iso8859-5", "cp1255", "cp852")
#: Pairs (wrongly used, right) of single-byte encodings (fixed values).
SINGLE = (("cp1252", "cp1251"), ("cp1252", "cp1256"), ("cp1252", "cp1253"), ("cp1252", "cp1250"), ("cp1252", "koi8-r"), ("cp1252", "iso8859-2"), ("cp1252", "iso8859-5"), ("cp1252", "cp1254"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1250", "cp1252"), ("cp1256", "cp1252"), ("cp1253", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp437", "cp1251"), ("cp1252", "cp866"), ("cp1252", "mac_cyrillic"))
#: Bits of mutual information at which a pair is neither probable nor improbable.
NEUTRAL = 8e-4
#: What a single-byte mapping must gain in log-likelihood, in all and for each character it changes.
GAIN, GAIN_EACH = 6.0, 1.2


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte; bytes the encoding leaves undefined stand for the control characters of the same number."""
    table = {}
    for b in range(255, -1, -1):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


def _encode(text: str, codec: str) -> bytes | None:
    table = _bytes_of(codec)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


@lru_cache(maxsize=None)
def _sequences(codec: str) -> re.Pattern:
    """What the UTF-8 sequences of non-ASCII characters look like when read in an encoding."""
    of: dict[int, str] = {}
    for c, b in _bytes_of(codec).items():
        of.setdefault(b, "")
        of[b] += re.escape(c)
    cls = lambda lo, hi: "[" + "".join(of.get(b, "") for b in range(lo, hi + 1)) + "]"
    tail = cls(0x80, 0xBF)
    return re.compile(f"{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}}")


@lru_cache(maxsize=None)
def _leads(codec: str) -> frozenset[str]:
    """Characters that a misread UTF-8 sequence can begin with."""
    return frozenset(c for c, b in _bytes_of(codec).items() if 0xC2 <= b <= 0xF4)


#: Signs besides letters that misread text commonly held (fixed values).
SIGNS = set("‘’“”–—…«»‹›•·°©®™€£¿¡§†‡‚„ƒ¨´¸ªº¹²³¼½¾±µ¶¢¤¥¦¬¯×÷ˆ˜‰\xa0\xad") | {chr(c) for c in range(0x80, 0xA0)}


def _undo(run: str, codec: str) -> tuple[str, int]:
    """The run with every misread sequence decoded, and how many there were."""
    table, n = _bytes_of(codec), 0

    def one(m: re.Match) -> str:
        nonlocal n
        try:
            c = bytes([table[x] for x in m.group()]).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        if not (c.isalpha() or c in SIGNS):
            return m.group()
        n += 1
        return c

    return _sequences(codec).sub(one, run), n


def _sane(text: str) -> bool:
    """No control characters and no private or unassigned ones came out."""
    return not any(ord(c) < 32 or 0x7F <= ord(c) < 0xA0 or 0xE000 <= ord(c) <= 0xF8FF for c in text)


_SPACE = re.compile(r"[\s_]")


def _score(p: str, model: PairModel) -> float:
    x = model.scores.get(p)
    if x is None:
        # the model has word ends, not the space between words
        pair = START + p[1] if p[0] == " " else p[0] + END if p[1] == " " else p
        x = max(-3.0, min(3.0, math.log2(NEUTRAL / max(model.info(pair), 1e-12))))
        x = model.scores[p] = min(x, 0.0) if p.isascii() else x
    return x


def segments(text: str, model: PairModel) -> list[tuple[int, int]]:
    """Maximal-scoring segments (first, last + 1) of improbable adjacent pairs that hold a non-ASCII character.

    A pair's score is log2(NEUTRAL / information), within +-3; plain ASCII pairs score nothing above 0.
    Ruzzo and Tompa's linear pass finds all disjoint maximal segments.
    """
    pairs = pairs_of(START + _SPACE.sub(" ", text) + END)
    scores = list(map(model.scores.get, pairs))
    if None in scores:
        scores = [_score(p, model) for p in pairs]
    if max(scores) <= 0:
        return []
    kept: list[list[float]] = []  # left sum, right sum, from, to
    total = 0.0
    for i, x in enumerate(scores):
        total += x
        if x <= 0:
            continue
        new = [total - x, total, i, i + 1]
        while kept:
            j = next((j for j in range(len(kept) - 1, -1, -1) if kept[j][0] < new[0]), -1)
            if j < 0 or kept[j][1] >= new[1]:
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append(new)
    out = []
    for _, _, a, b in kept:  # pair i joins characters i - 1 and i of the text
        a, b = max(0, int(a) - 1), min(len(text), int(b))
        if not text[a:b].isascii():
            out.append((a, b))
    return out


def strictly_misread(text: str) -> bool:
    """Whether a run of non-ASCII characters is, as a whole, UTF-8 misread in a common way; what isn't is clean enough to count."""
    if text.isascii():
        return False
    if "�" in text or any(0x80 <= ord(c) < 0xA0 for c in text):
        return True
    for run in re.findall(r"[^\x00-\x7f]{2,}", text):
        for codec in MISREAD[:9]:
            raw = _encode(run, codec)
            if raw is not None:
                try:
                    if _sane(raw.decode("utf-8")):
                        return True
                except UnicodeDecodeError:
                    pass
    return False


def _runs(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where mappings are tried: each segment rounded out to the words it touches; runs that meet are one."""
    out: list[tuple[int, int]] = []
    for a, b in found:
        while a > 0 and not text[a - 1].isascii():
            a -= 1
        while b < len(text) and not text[b].isascii():
            b += 1
        while a > 0 and text[a - 1].isalpha():
            a -= 1
        while b < len(text) and text[b].isalpha():
            b += 1
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


#: Encodings whose letters are not Latin (fixed values).
OTHER_SCRIPTS = {"cp1251", "cp1256", "cp1253", "koi8-r", "iso8859-5", "cp866", "mac_cyrillic"}
_ADJACENT = re.compile(r"[^\x00-\x7f]{2}")
_TOUCHING = re.compile(r"[A-Za-z][^\x00-\xbf]|[^\x00-\xbf][A-Za-z]")


def _maps(run: str, single: bool) -> Iterator[tuple[str, str, bool]]:
    """(name, restored run, from UTF-8) by every inverse mapping that applies to a run; text misread twice is undone twice."""
    chars = set(run)
    for codec in MISREAD if _ADJACENT.search(run) else ():  # a misread sequence is two characters or more
        if _leads(codec).isdisjoint(chars):
            continue
        got, n = _undo(run, codec)
        if n:
            yield f"utf-8 as {codec}", got, True
            for again in MISREAD[:9]:
                twice, m = _undo(got, again)
                if m:
                    yield f"utf-8 as {again}, utf-8 as {codec}", twice, True
        if n and " " in run:  # a no-break space that was made an ordinary one
            got, m = _undo(re.sub("(?<=[\xc3ăأ├√]) ", "\xa0", run), codec)
            if m > n > 0:
                yield f"utf-8 as {codec}", got, True
    if single:
        touching = _TOUCHING.search(run) is not None
        for wrong, right in SINGLE:
            if touching and right in OTHER_SCRIPTS:
                continue  # letters of another script inside a Latin word
            raw = _encode(run.replace("\xa0", " "), wrong)
            if raw is not None:
                try:
                    yield f"{right} as {wrong}", raw.decode(right), False
                except UnicodeDecodeError:
                    pass


def _most(text: str, a: int, b: int, model: PairModel) -> float:
    """The most that other non-ASCII characters in text[a:b] could gain: no pair's log-likelihood exceeds 0, and pairs of ASCII characters stay."""
    s = START + text[max(0, a - 1) : b + 1].replace(" ", END + START) + END
    return -sum([model.log(p) for p in [s[i : i + 2] for i in range(len(s) - 1)] if not p.strip(START + END).isascii()])


#: Runs a model remembers the mappings of; the memory is emptied beyond it, the mappings don't depend on it.
REMEMBERED = 100_000


def _options(run: str, single: bool, model: PairModel) -> list[tuple[str, str, bool]]:
    """`_maps` of a run that bring only what clean values may hold; runs come again, so a model remembers them."""
    known = model.options.get((run, single))
    if known is None:
        known = []
        for how, new, multi in _maps(run, single):
            if new == run or not multi and not all(c.isalpha() for c in new if not c.isascii()):
                continue
            if multi and not _sane(new.replace("�", "")) and not any(0x80 <= ord(c) < 0xA0 for c in run):
                continue
            if multi and not all(c.isascii() or not model.right.keys().isdisjoint((c, c.lower(), c.upper())) or c in SIGNS or c == "�" for c in set(new) - set(run)):
                continue  # a letter that no clean value has
            known.append((how, new, multi))
        if len(model.options) >= REMEMBERED:
            model.options.clear()
        model.options[run, single] = known
    return known


def _mapped(text: str, runs: list[tuple[int, int]], model: PairModel, odd: bool) -> Iterator[tuple[str, str, bool, int]]:
    """(how, whole text, from UTF-8, changed signs) of each mapping on one run alone and on all runs it applies to; what lies between runs stays."""
    of: dict[tuple[str, bool], list[tuple[int, int, str, int]]] = {}
    for a, b in runs:
        run = text[a:b]
        high = sum(not c.isascii() for c in run)
        for how, new, multi in _options(run, odd or _most(text, a, b, model) >= max(GAIN, GAIN_EACH * high), model):
            yield how, text[:a] + new + text[b:], multi, high
            if len(runs) > 1:
                of.setdefault((how, multi), []).append((a, b, new, high))
    for (how, multi), parts in of.items():
        if len({a for a, *_ in parts}) > 1:
            whole, at = [], 0
            for a, b, new, _ in parts:
                if a >= at:
                    whole += [text[at:a], new]
                    at = b
            yield how, "".join([*whole, text[at:]]), multi, sum(h for *_, h in parts)


def repair(text: str, found: list[tuple[int, int]], model: PairModel) -> tuple[str, str] | None:
    """(how, restored text) by the best mapping inside the improbable runs around the segments `found`; None where none is likelier."""
    best, gained = None, 0.0
    runs = _runs(text, found)
    odd = plain(text) != text  # else a restored text has no characters to normalise either, but for those it brings
    at = model.of(plain(text)) if runs else 0.0
    for how, whole, multi, high in _mapped(text, runs, model, odd):
        gain = model.of(plain(whole) if odd else whole) - at
        if not multi and (gain < GAIN or gain < GAIN_EACH * high):
            continue
        if multi and gain > 0:
            gain += 4.0
        if gain > gained:
            best, gained = (how, whole), gain
    return best


class _Visible(dict):
    """Code points to themselves, or to nothing where they can't be seen; soft hyphens stay."""

    def __missing__(self, code: int) -> str:
        self[code] = out = chr(code) if code == 0xAD or not is_ignorable(chr(code)) else ""
        return out


_visible_table = _Visible()


def _visible(text: str) -> str:
    return text.translate(_visible_table)


#: Signs of good typography, never a reason by themselves (fixed values).
TYPOGRAPHIC = set("‘’“”–—…«»·")


def alien(c: str, model: PairModel) -> bool:
    """Whether clean values never have this sign (no letter, mark or space) and no plain form explains it: replacement and control characters among others."""
    kind = unicodedata.category(c)
    return not c.isascii() and not c.isalpha() and kind[0] not in "MZ" and c not in TYPOGRAPHIC and c not in model.left and c not in model.right and plain_char(c) == c


def lost(text: str, found: list[tuple[int, int]], model: PairModel) -> bool:
    """Whether an improbable segment (`found`) of the value holds a sign that is alien to the corpus: damage no mapping undoes."""
    return any(alien(c, model) for a, b in found for c in text[a:b] if not c.isascii())


def judge(text: str | None, model: PairModel) -> tuple[bool, str | None, str | None]:
    """(garbled, restored or None, how or why) of one value; null, empty and ASCII values are not garbled.

    Both verdicts rest on the improbable segments: a mapping inside them makes the value likelier, or they
    hold signs alien to the corpus (a pair with one has no mutual information, so it lies in a segment).
    """
    if not text or text.isascii():
        return False, None, None
    text = _visible(text)
    found = [] if text.isascii() else segments(text, model)
    if not found:
        return False, None, None
    if got := repair(text, found, model):
        return True, None if lost(got[1], segments(got[1], model), model) else got[1], got[0]
    if lost(text, found, model):
        return True, None, "alien signs"
    return False, None, None


def clean_model(tracks: DataFrame) -> PairModel:
    """The pair model of the clean values of all tag columns."""
    return PairModel(pair_counts(values_of(tracks, "title", "album", "artist", "albumartist"), lambda v: not strictly_misread(v)))


RESULT = "struct<garbled: boolean, restored: string, how: string>"


def judge_column(spark, model: PairModel):
    """A pandas UDF from values to (garbled, restored, how); a worker judges each distinct value of its batches once."""
    shared = spark.sparkContext.broadcast(model.pair)  # bounded by MOST_PAIRS

    @F.pandas_udf(RESULT)
    def judged(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, memory = PairModel(shared.value), {}
        for s in values:
            rows = []
            for v in s:
                if (r := memory.get(v)) is None:
                    if len(memory) > 100_000:
                        memory.clear()
                    r = memory[v] = judge(v, m)
                rows.append(r)
            yield pd.DataFrame(rows, columns=["garbled", "restored", "how"])

    return judged


def non_ascii(column: str):
    """Values that can be garbled or look alike at all, told in the JVM."""
    return F.col(column).rlike("[^\\x00-\\x7F]")


def garbled_values(tracks: DataFrame, columns: tuple[str, ...] = ("title", "album"), model: PairModel | None = None) -> DataFrame:
    """Distinct (track_id, field, value, restored, how) of the garbled values of `tracks` (id and the columns).

    A value is garbled if it is, wholly or in part, text decoded with the wrong encoding; `restored` is null
    where the original is lost (replacement characters, dropped bytes). Null, empty and plain ASCII values
    are never garbled; values of any length are judged whole; repeated rows count once; an empty table gives
    an empty result. Only values with a non-ASCII character leave the JVM.
    """
    model = model or clean_model(tracks)
    judged = judge_column(tracks.sparkSession, model)
    long = tracks.select(F.col("id").alias("track_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("x")).select("track_id", "x.field", "x.value").where(non_ascii("value"))
    return long.withColumn("j", judged("value")).where("j.garbled").select("track_id", "field", "value", F.col("j.restored").alias("restored"), F.col("j.how").alias("how")).distinct()
