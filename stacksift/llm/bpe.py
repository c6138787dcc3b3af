"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

The merges of a piece run over a segment tree on its byte positions: every leaf holds the rank of the pair
that starts there, every inner node the leftmost minimum below it. A merge takes the root's minimum and
updates the pairs of the live neighbours in logarithmic time, so pieces of any length cost n log n.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: How the 50k byte-level vocabularies split text into pieces (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 30
#: Pieces a worker remembers; the memory is emptied beyond it, the ids don't depend on it.
REMEMBERED = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece; b'' gives none."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    token: list[bytes] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [NONE] * (2 * size)  # tree[i] is the least rank below i; going left on ties finds the leftmost
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(token[i] + token[i + 1], NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def update(at: int, rank: int) -> None:
        at += size
        tree[at] = rank
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            low = a if a <= b else b
            if tree[at] == low:
                return
            tree[at] = low
            at >>= 1

    while (low := tree[1]) != NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != low:
                i += 1
        i -= size
        j = after[i]
        token[i] += token[j]
        k = after[i] = after[j]
        token[j] = b""
        if k < n:
            before[k] = i
            update(i, get(token[i] + token[k], NONE))
        else:
            update(i, NONE)
        update(j, NONE)
        h = before[i]
        if h >= 0:
            update(h, get(token[h] + token[i], NONE))
    return [ranks[t] for t in token if t]


def encoder(path: str) -> Callable[[str | None], list[int]]:
    """text -> ids, without special tokens; null and '' give []."""
    import regex

    ranks, split, memory = load_ranks(path), regex.compile(PATTERN).findall, {}

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        for piece in split(text):
            known = memory.get(piece)
            if known is None:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                known = merge_piece(piece.encode("utf-8", "surrogatepass"), ranks)
                if len(piece) < 64:
                    memory[piece] = known
            ids += known
        return ids

    return encode


_encoders: dict[str, Callable[[str | None], list[int]]] = {}


def encoder_here(path: str) -> Callable[[str | None], list[int]]:
    """The worker's own encoder of a vocabulary, loaded once."""
    if path not in _encoders:
        _encoders[path] = encoder(path)
    return _encoders[path]


def vocabulary(name: str, folder: str = TOKENIZERS) -> str:
    """The ranks file of a byte-level tokenizer."""
    return f"{folder}/{name}.tiktoken"


def encode_column(path: str):
    """A pandas UDF from text to its ids."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder_here(path)
        for s in texts:
            yield pd.Series([encode(x) for x in s], dtype=object)

    return ids


def count_column(path: str):
    """A pandas UDF from text to its number of ids; nothing but the number leaves the worker."""

    @F.pandas_udf(T.LongType())
    def size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder_here(path)
        for s in texts:
            yield pd.Series([len(encode(x)) for x in s], dtype="int64")

    return size


def encode_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every row of `documents` (doc_id, text).

    Null and empty texts give an empty list, strings that look like special tokens are ordinary text, and
    texts of any length are encoded whole. Repeated rows stay repeated; other columns are not read. The work
    is done where the texts are scanned: nothing is shuffled, and the size of the scan's splits
    (spark.sql.files.maxPartitionBytes) is that of the tasks.
    """
    return documents.select("doc_id", encode_column(vocabulary(tokenizer, folder))("text").alias("ids"))
