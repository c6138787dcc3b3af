"""Names of persons in running text: name-shaped spans, their features, and weights fitted without typed cues.

A span is two words, or a word and an initial, that stand together as a name does: capitalised, in capitals, in
lower case or in a script without case, with a middle initial or turned round a comma. The corpus says which
words are ordinary (they stand in many documents), the library's artists which words are given names. Spans
with a known given name and no ordinary word are names to learn from, spans with an ordinary word are none;
what surrounds them, how they are written and how their words end are the features, so names the lexicon
doesn't know are found by their surroundings.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate, chain
from zlib import crc32

import numpy as np
import regex

#: Forms of address (fixed values): no part of a name, but they may stand before one.
HONORIFICS = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "herr", "frau", "sr", "sra", "señor", "señora", "don", "doña", "mme", "mlle", "monsieur", "madame", "г-н", "г-жа", "господин", "госпожа", "السيد", "السيدة", "الأستاذ", "الأستاذة"}
#: Hashed features; their number bounds the weights, and two bytes hold one.
SLOTS = 1 << 16
#: Stretches of text a worker remembers the reading of, and words or examples it counts before it hands the counts on.
MOST_READINGS, MOST_COUNTED = 100_000, 100_000
#: Share of the texts (and least number) in which an ordinary word stands; how many rare words follow a given name, and in what share of its texts.
SHARE, LEAST, FOLLOWED, FOLLOWING = 0.001, 4, 3, 0.3
#: Passes over the examples, step and pull towards zero of the fit; share of examples whose lexical features are hidden.
PASSES, STEP, PULL, HIDDEN = 60, 0.5, 2e-6, 0.5

_TOKEN = regex.compile(r"\p{L}(?:\.(?!\p{L}{2})|[\p{L}\p{M}'’‘-]*[\p{L}\p{M}])?|[^\s\p{L}\p{M}]+|\n")
_POSSESSIVE = regex.compile(r"['’][sS]$")
_ENDING = regex.compile(r"\.\w{2,4}\b")
_MARKS = regex.compile(r"[\p{N}]+")


@dataclass(frozen=True)
class NameModel:
    """What spans are judged by: given names and ordinary words in lower case, and fitted weights (None: those of `plain_weights`)."""

    given: frozenset[str]
    ordinary: frozenset[str] = frozenset()
    lower: frozenset[str] = frozenset()  # those that are ordinary in lower case alone
    weights: np.ndarray | None = None

    def kinds(self, everything: bool) -> Read:
        """What stretches are to a name by this model (`_kind`), as far as they were met; not shipped."""
        met = self.__dict__.setdefault("met", {})
        if everything not in met:
            met[everything] = Read(lambda chunk: _kind(chunk, self, everything))
        return met[everything]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "met"}


@dataclass
class Span:
    start: int
    end: int
    words: tuple[str, ...]  # given or initial, family; as they would stand in plain order
    shape: str
    known: bool
    common: bool
    context: list[str] = field(default_factory=list)


def _case(w: str) -> str:
    """'A' of a capitalised word, 'U' in capitals, 'a' in lower case, 'n' without case, '.' of an initial."""
    if w[-1] == "." or len(w) == 1:
        return "."
    if not (w[0].isupper() or w[0].islower()):
        return "n"
    return "a" if w[0].islower() else "U" if w.isupper() else "A"


class Read(dict):
    """What `read` says of a stretch without spaces, remembered for MOST_READINGS of them."""

    def __init__(self, read: Callable[[str], object]) -> None:
        self.read = read

    def __missing__(self, chunk: str):
        if len(self) >= MOST_READINGS:
            self.clear()
        self[chunk] = got = self.read(chunk)
        return got


def _reading(chunk: str) -> tuple[tuple[str, int, int, str, str], ...]:
    """The tokens of a stretch without spaces: as written, where it starts and ends, in lower case, and its case (marks have none)."""
    got = []
    for m in _TOKEN.finditer(chunk):
        w = m.group()
        if w == "\n":
            low, case = w, ""
        elif not w[0].isalpha():
            low, case = _MARKS.sub("0", w)[-2:], ""
        else:
            bare = w[:-2] if len(w) > 3 and w[-1] in "sS" and w[-2] in "'’" else w
            low = bare.rstrip(".").casefold()
            case = "" if low in HONORIFICS else _case(bare)
        got.append((w, m.start(), m.end(), low, case))
    return tuple(got)


_readings = Read(_reading)
#: How many tokens from where a name begins to the end of what is behind it, at most.
AROUND = 9


#: Which digits a number has tells nothing here, so stretches that differ in them alone are read once.
_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def chunks(text: str) -> list[str]:
    """The stretches without spaces, every digit a 0, line breaks by themselves; no token goes over a space, so each stretch is read once."""
    same = text.encode("utf-8", "surrogatepass").translate(_DIGITS).decode("utf-8", "surrogatepass")
    return same.replace("\n", " \n ").replace("\xa0", " ").split(" ")


#: What a stretch is to a name, two signs each. First as its second word: by case, a letter if it may be the family name, after a comma the
#: given one, and both, or an initial, capital or not. Then what it ends in as its first word: by case, an initial, by case before a comma.
_SECOND = {"A": "abc", "U": "def", "a": "ghi", "n": "jkl"}
_BEFORE, _BEFORE_COMMA = dict(zip("AUan", "ABCD", strict=True)), dict(zip("AUan", "KLMN", strict=True))


def _kind(chunk: str, model: NameModel, everything: bool) -> str:
    read = _readings[chunk]
    if not read:
        return "  "
    if chunk == "\n":
        return "\n\n"
    given, ordinary, lower = model.given, model.ordinary, model.lower

    def family(low: str, c: str) -> bool:
        return low not in ordinary or everything and c != "a"

    def first(low: str, c: str) -> bool:
        return low in given or low not in (ordinary if c == "n" else lower) or everything and c != "a"

    def initial(w: str) -> str:
        return "" if w[-1] != "." else "X" if w[0].isupper() else "Y"

    w, _, _, low, c = read[0]
    if c == ".":
        second = initial(w).lower()
    else:
        second = c and ("", *_SECOND[c])[family(low, c) + 2 * first(low, c)]
    w, _, _, low, c = read[-1]
    if w in (",", "،"):
        _, _, _, low, c = read[-2] if len(read) > 1 else read[-1]
        before = _BEFORE_COMMA[c] if c and c != "." and family(low, c) else ""
    else:
        before = initial(w) if c == "." else _BEFORE[c] if c and first(low, c) else ""
    return (second or "-") + (before or "-")


def _begin() -> re.Pattern:
    """Where a name may begin in the signs of a text: before a second word that fits, over a line break and a middle initial or not."""
    gap, gap_after = r"(?:(?:  )?\n\n(?:  )*)?", r"(?:(?:  )*\n\n(?:  )*)?"
    family = {c: s[0] + s[2] for c, s in _SECOND.items()}
    plain = {_BEFORE[c]: family[c] for c in "AUan"} | {"X": family["A"] + family["U"], "Y": family["a"] + family["n"]}
    return re.compile("|".join(
        [f"{t}(?={gap}(?:[{s}]|[xy][XY]{gap_after}[{s}]))" for t, s in plain.items()]
        + [f"{_BEFORE_COMMA[c]}(?={gap}[{_SECOND[c][1:]}{'x' if c in 'AU' else 'y'}])" for c in "AUan"]
    ))


_BEGIN = _begin()


def spans(text: str, model: NameModel, everything: bool = False) -> Iterator[Span]:
    """Name-shaped spans of a text, whole.

    The family name must be no ordinary word and the given name, unless it is known, none that is ordinary in
    lower case (in scripts without case: at all); with `everything`, spans that aren't in lower case may hold both.
    The signs of the stretches (`_kind`) rule out where none begins; tokens are looked at where one may.
    """
    pieces = chunks(text)
    kinds = "".join(map(model.kinds(everything).__getitem__, pieces))
    begins = [m.start() for m in _BEGIN.finditer(kinds)]
    if not begins:
        return
    given, ordinary, lower = model.given, model.ordinary, model.lower
    inner: set[int] = set()  # where initials after a word that is a given name or rare start; they begin no name of their own
    passed = to = base = 0

    def start(x: int) -> int:
        return offsets[bisect_right(firsts, x) - 1] + tokens[x][1]

    def joined(end: int, j: int) -> bool:
        """Whether token j follows the one that ends there as the next word of a name does."""
        return end + 1 == start(j) and text[end] in " \n\xa0"

    for nth, at in enumerate(begins):
        if at // 2 >= to:
            # the stretches around this place and those near it, with AROUND tokens after the last one and as many before as a context has
            last = nth
            while last + 1 < len(begins) and begins[last + 1] - begins[last] <= 4 * AROUND:
                last += 1
            lo, to = max(passed, at // 2 - 4), begins[last] // 2 + 1
            reads = list(map(_readings.__getitem__, pieces[lo:to]))
            while lo > passed and sum(map(len, reads[: at // 2 - lo])) < 3:
                more = max(passed, lo - 8)
                reads[:0] = map(_readings.__getitem__, pieces[more:lo])
                lo = more
            hi, behind = to, 0
            while hi < len(pieces) and behind < AROUND:
                reads.append(_readings[pieces[hi]])
                behind += len(reads[-1])
                hi += 1
            base += len("".join(pieces[passed:lo])) + lo - passed - kinds.count("\n", 2 * passed, 2 * lo)
            passed = lo
            tokens = list(chain.from_iterable(reads))  # as written, start, end (in its stretch), lower case, case
            firsts = list(accumulate(map(len, reads), initial=0))  # the number of each stretch's first token
            offsets = list(accumulate([0 if x == "\n" else len(x) + 1 for x in pieces[lo:hi]], initial=base))  # a line break stands between two that count their own
            n = len(tokens)
        comma = kinds[at] in "KLMN"
        i = firsts[at // 2 - passed + 1] - 1 - comma
        offset = offsets[at // 2 - passed]
        if offset + tokens[i][1] in inner:
            continue
        # the next word, over a line break token or a comma
        j, end = i + 1, offset + tokens[i][2]
        if comma:
            if offset + tokens[j][1] != end:
                continue
            j, end = j + 1, end + 1
        if j < n and tokens[j][0] == "\n":
            if text[end : text.find("\n", end)] not in ("", " "):
                continue
            j += 1
        elif j >= n or not joined(end, j):
            continue
        if j >= n or not tokens[j][4]:
            continue
        b, mid = j, None
        if tokens[j][4] == "." and tokens[j][0][-1] == "." or comma:
            k = j + 1
            if tokens[j][4] == "." and tokens[j][0][-1] == "." and k < n and tokens[k][0] == "\n":
                k += 1
            if k < n and tokens[k][4] and (k == j + 2 or joined(start(j) + len(tokens[j][0]), k)):
                if not comma and tokens[k][4] != ".":
                    b, mid = k, j  # a middle initial
                elif comma and tokens[k][4] == "." and tokens[k][0][-1] == ".":
                    b, mid = k, j  # a given name and an initial after the comma
        first, last = (j, i) if comma else (i, b)
        (w, _, _, low, f), (_, _, _, family, g) = tokens[first], tokens[last]
        if g == "." or f == "." and w[-1] != ".":
            continue
        if (g in "AU") != w[0].isupper() if f == "." else g != f:
            continue
        known = low in given
        common = family in ordinary or f != "." and not known and low in (ordinary if f == "n" else lower)
        if common and (not everything or g == "a"):
            continue
        if mid is not None and not comma and (known or low not in ordinary):
            inner.add(start(mid))
        w = tokens[b][0]
        begin, end = offset + tokens[i][1], start(b) + len(w)
        cut = _POSSESSIVE.search(w) if w[-1] in "sS" else None
        if cut:
            end -= cut.end() - cut.start()
        s = Span(begin, end, (low, family), f + g + ("," if comma else "") + ("m" if mid is not None else ""), known, common)
        p3, p2, p1 = [t[3] for t in tokens[i - 3 : i]] if i > 2 else (["<"] * 3 + [t[3] for t in tokens[:i]])[-3:]
        n1, n2, n3 = ([t[3] for t in tokens[b + 1 : b + 4]] + [">"] * 3)[:3]
        if cut:
            n1, n2, n3 = "'s", n1, n2
        s.context = [f"p1={p1}", f"p2={p2} {p1}", f"p3={p3} {p2} {p1}", f"w1={p2}", f"n1={n1}", f"n2={n1} {n2}", f"n3={n1} {n2} {n3}", f"x={p1}|{n1}"]
        path = text[max(0, begin - 1) : begin] == "/" or text[end : end + 1] == "/" or text[end : end + 1] == "." and _ENDING.match(text, end) is not None and text.rfind("/", text.rfind("\n", 0, begin) + 1, begin) >= 0
        if path:
            s.context.append("path")
        yield s


def features(s: Span, model: NameModel, hidden: bool = False) -> list[int]:
    """Slots of a span's features; `hidden` leaves out what the lexicon and the words themselves say."""
    out = ["bias", "shape=" + s.shape, *s.context]
    if not hidden:
        first, last = s.words
        out += ["known" if s.known else "unknown", "g3=" + first[-3:], "g2=" + first[-2:], "f3=" + last[-3:]]
        out += [f"both={s.known}{last in model.ordinary}"]
    return [crc32(x.encode()) % SLOTS for x in out]


def plain_weights() -> np.ndarray:
    """Weights before any fit: a known given name speaks for a name, ordinary words, paths and lower case against."""
    w = np.zeros(SLOTS)
    for f, x in {"bias": -3.0, "known": 5.0, "path": -8.0, "shape=aa": -4.0, "shape=.A": 2.5, "shape=.U": 2.5, "shape=.n": 1.5}.items():
        w[crc32(f.encode()) % SLOTS] += x
    for known in (True, False):
        w[crc32(f"both={known}True".encode()) % SLOTS] -= 6.0
    return w


def score(s: Span, model: NameModel) -> float:
    w = plain_weights() if model.weights is None else model.weights
    return float(w[features(s, model)].sum())


def example(s: Span, families: set[str]) -> int | None:
    """1, 0 or None: what a span teaches.

    A known given name with a word that isn't ordinary is a name, so is an initial with the family name of one
    in the same text (`families`); spans in paths and with ordinary words are none. Nothing is told by other
    initials.
    """
    if "path" in s.context:
        return 0
    if s.shape[0] == ".":
        return 1 if s.words[1] in families and not s.common else None
    return 0 if s.common else 1 if s.known else None


#: Slopes are whole multiples of this, so that their sum (of 1 at most in each class) is the same in whatever order and parts.
GRAIN = 2.0**-48


class Rows:
    """Different examples as arrays: the slots of all features, the number of each one's, the labels, and how often each comes."""

    def __init__(self, slots: np.ndarray, sizes: np.ndarray, labels: np.ndarray, times: np.ndarray) -> None:
        self.arrays = slots, sizes, labels, times

    @classmethod
    def of(cls, counts: dict[tuple[int, bytes], int]) -> Rows:
        """From the numbers of (label, slots as bytes)."""
        return cls.packed(b"".join(f for _, f in counts), np.fromiter((len(f) // 2 for _, f in counts), np.uint16, len(counts)), np.fromiter((y for y, _ in counts), np.uint8, len(counts)), np.fromiter(counts.values(), np.int64, len(counts)))

    @classmethod
    def packed(cls, slots, sizes, labels, times) -> Rows:
        return cls(np.frombuffer(slots, np.uint16), np.frombuffer(sizes, np.uint16), np.frombuffer(labels, np.uint8), np.frombuffer(times, np.int64))

    def labelled(self) -> tuple[int, int]:
        """The number of names and of what is none."""
        _, _, labels, times = self.arrays
        ones = int(times[labels == 1].sum())
        return ones, int(times.sum()) - ones

    def slopes(self, w: np.ndarray, ones: int, zeros: int) -> np.ndarray:
        """The slope of the loss over these rows, by slot; each class weighs a half of the `ones` and `zeros` there are in all."""
        flat, sizes, y, times = self.arrays
        of = np.repeat(np.arange(len(y)), sizes)
        z = np.bincount(of, w[flat], len(y))
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, 0.5 / max(1, ones), 0.5 / max(1, zeros))
        return np.bincount(flat, (np.rint(slope / GRAIN) * GRAIN * times)[of], SLOTS)


def regression(slopes: Callable[[np.ndarray], np.ndarray], passes: int = PASSES) -> np.ndarray:
    """Weights by logistic regression (Adagrad, full batches) from `plain_weights` on; `slopes` gives those of all examples.

    As the neighbours' labels enter as they are known, this is the pseudo-likelihood of the field's unaries.
    Classes weigh the same in all.
    """
    w = plain_weights()
    start, seen = w.copy(), np.full(SLOTS, 1e-8)
    for _ in range(passes):
        g = slopes(w) + PULL * (w - start)
        seen += g * g
        w = w - STEP * g / np.sqrt(seen)
    return w


#: Words that stand free between spaces and punctuation; parts of addresses, paths and codes are none.
_FREE = regex.compile(r"(?<![\p{L}\p{N}@_/\\.-])\p{L}[\p{L}\p{M}'’-]*+(?![\p{N}@_/\\]|\.\p{L})")

#: The last word of a stretch without spaces, and the first one.
_LAST = regex.compile(r"(?<![\p{L}\p{N}_@/.-])\p{L}[\p{L}\p{M}'’-]*+\Z")
_FIRST = regex.compile(r"\p{L}[\p{L}\p{M}-]+(?![\p{L}\p{N}_@/-])")


def least_texts(n: int) -> float:
    """The number of texts, of n, in which an ordinary word stands at least."""
    return max(LEAST, SHARE * n)


def count_words(texts: Iterable[str]) -> Iterator[tuple[Counter, Counter]]:
    """In how many texts each word stands, and in how many in lower case, in parts of bounded size that add up."""

    def read(chunk: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        words = _FREE.findall(chunk)
        return tuple(w.casefold() for w in words), tuple(w for w in words if w.islower())

    reads = Read(read)
    df: Counter = Counter()
    lower: Counter = Counter()
    for t in texts:
        both = list(map(reads.__getitem__, set(t.split())))
        df.update(set(chain.from_iterable([x for x, _ in both])))
        lower.update(set(chain.from_iterable([x for _, x in both])))
        if len(df) > MOST_COUNTED:
            yield df, lower
            df, lower = Counter(), Counter()
    yield df, lower


def followed(text: str, firsts: Read, seconds: Read) -> Iterator[tuple[str, str]]:
    """A word and the one that follows it after a space or line break, or after an initial, both written alike.

    `firsts` and `seconds` read the last and the first word of a stretch and its case, or None.
    """
    lines = [line.split(" ") for line in text.split("\n")]
    chunks = [c for line in lines for c in line]
    starts = set(accumulate(map(len, lines)))  # of the lines but the first, and the end
    for i, (a, b) in enumerate(zip(chunks, chunks[1:], strict=False)):
        if (first := firsts[a]) is None:
            continue
        if len(b) == 2 and b[1] == "." and b[0].isalpha():  # an initial; a line doesn't end after it
            second = seconds[chunks[i + 2]] if i + 2 not in starts else None
        else:
            second = seconds[b]
        if second is not None and second[1] == first[1]:
            yield first[0], second[0]


def count_followed(texts: Iterable[str], common: set[str], lower: set[str]) -> Iterator[dict[str, tuple[int, set[str]]]]:
    """Words that rare ones (none of `common`) follow: in how many texts, and FOLLOWED of the followers, as more tell nothing.

    In parts of bounded size that add up. Words of `lower` (often in lower case) are no given names, hence left out.
    """

    def first(chunk: str) -> tuple[str, str] | None:
        m = _LAST.search(chunk)
        return None if m is None or (a := m.group().casefold()) in lower else (a, _case(m.group()))

    def second(chunk: str) -> tuple[str, str] | None:
        m = _FIRST.match(chunk)
        return None if m is None or len(b := m.group().casefold()) < 4 or b in common else (b, _case(m.group()))

    firsts, seconds = Read(first), Read(second)
    n: Counter = Counter()
    followers: dict[str, set[str]] = {}
    for t in texts:
        here = set()
        for a, b in followed(t, firsts, seconds):
            here.add(a)
            f = followers.setdefault(a, set())
            if len(f) < FOLLOWED:
                f.add(b)
        n.update(here)
        if len(n) > MOST_COUNTED:
            yield {a: (k, followers[a]) for a, k in n.items()}
            n, followers = Counter(), {}
    yield {a: (k, followers[a]) for a, k in n.items()}


def lexicon(common: set[str], lower: set[str], known: set[str], titles: set[str]) -> NameModel:
    """The model before its fit; no `known` given name is an ordinary word."""
    return NameModel(frozenset(known), frozenset(common - known), frozenset((lower | titles) - known))


def examples(texts: Iterable[str], base: NameModel) -> Iterator[Rows]:
    """What the spans of the texts teach, in parts of bounded size; whose lexical features are left out a hash tells."""
    counts: Counter = Counter()
    for text in texts:
        found = list(spans(text, base, everything=True))
        if not found:
            continue
        families = {s.words[1] for s in found if s.known and not s.common}
        of = crc32(text.encode("utf-8", "surrogatepass"))
        for s in found:
            y = example(s, families)
            if y is not None:
                hidden = crc32(str(s.start).encode(), of) * 2654435761 % (1 << 32) < HIDDEN * (1 << 32)
                counts[y, array("H", features(s, base, hidden)).tobytes()] += 1
        if len(counts) > MOST_COUNTED:
            yield Rows.of(counts)
            counts = Counter()
    if counts:
        yield Rows.of(counts)


def fit_names(texts: Iterable[str], given: set[str], titles: set[str] = frozenset()) -> NameModel:
    """The name model of some texts, the given names the library knows and the words its titles use.

    Equal texts count once. Words in SHARE of the texts are ordinary. A word that rare words follow in FOLLOWING of its texts,
    FOLLOWED different ones at least, is a given name too unless titles use it. The weights are then fitted to what the spans
    teach (`example`), the lexical features of HIDDEN of them left out, so that surroundings, shape and endings
    carry names the lexicon lacks. `personal.fit_documents` does the same for a DataFrame.
    """
    texts = set(texts)
    df: Counter = Counter()
    lower: Counter = Counter()
    for a, b in count_words(texts):
        df.update(a)
        lower.update(b)
    least = least_texts(len(texts))
    common, low = {w for w, n in df.items() if n >= least}, {w for w, n in lower.items() if n >= least}
    follows: Counter = Counter()
    followers: dict[str, set[str]] = {}
    for part in count_followed(texts, common, low):
        for a, (n, f) in part.items():
            follows[a] += n
            followers.setdefault(a, set()).update(f)
    learned = {a for a, f in followers.items() if len(f) >= FOLLOWED and follows[a] >= FOLLOWING * df[a]} - HONORIFICS - titles
    base = lexicon(common, low, set(given) | learned, titles)
    parts = list(examples(texts, base))
    ones, zeros = (sum(n) for n in zip(*(p.labelled() for p in parts), strict=True)) if parts else (0, 0)
    return replace(base, weights=regression(lambda w: sum(p.slopes(w, ones, zeros) for p in parts)) if parts else plain_weights())
