"""Problem 9: documents packed into containers of fixed capacity by bin completion.

Sizes are whole numbers up to the capacity, so the corpus reduces to a histogram of sizes, aggregated on
the cluster and never larger than the capacity. On it runs bin completion: the largest size left opens a
container, the undominated fillings of the room beside it are the branches, least waste first, and a branch
takes its filling as often as the histogram allows. Branches that can't use fewer containers than the best
packing so far, by the waste they have made and the sizes that are left, are cut; the first packing takes
the best-fitting filling throughout. Documents then find their container by their rank within their size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core.session import cut
from .bpe import TOKENIZERS, count_column, vocabulary

#: Fillings one search may take; beyond it the best packing so far is used.
SEARCH_NODES = 20_000
#: Rows `capacities` may have; each is a packing of the whole corpus.
MOST_CAPACITIES = 1000


def _reach(room: int, sizes: list[int], count: dict[int, int]) -> list[int]:
    """Bit sets of the sums up to `room` that the first i sizes can make."""
    out, full = [1], (1 << room + 1) - 1
    for s in sizes:
        r, n, k = out[-1], min(count[s], room // s), 1
        if r == full:
            return out + [full] * (len(sizes) + 1 - len(out))
        while n > 0:
            r |= r << min(k, n) * s & full
            n -= min(k, n)
            k *= 2
        out.append(r)
    return out


def _dominated(filling: list[int], waste: int, sizes: list[int], count: dict[int, int]) -> bool:
    """Whether a size left out could take the place of items that are together no larger, without going over.

    Only items smaller than it count: these fit wherever it stood, so every packing that goes on from here
    has one as good that goes on from the exchange (Martello and Toth's dominance).
    """
    sums, items = 1, sorted(filling)
    i = 0
    for x in sizes:
        while i < len(items) and items[i] < x:
            sums |= sums << items[i]
            i += 1
        low = max(0, x - waste)
        if sums >> low & (1 << x - low + 1) - 1 and count[x] > filling.count(x):
            return True
    return False


def _exact(total: int, i: int, sizes: list[int], count: dict[int, int], reach: list[int]) -> Iterator[list[int]]:
    """Ways to make `total` of the first i sizes, largest sizes first; `reach` keeps out of dead ends."""
    if not total:
        yield []
        return
    i = min(i, bisect_right(sizes, total))
    while i and reach[i] >> total & 1:
        s = sizes[i - 1]
        for n in range(min(count[s], total // s), 0, -1):
            if reach[i - 1] >> total - n * s & 1:
                for rest in _exact(total - n * s, i - 1, sizes, count, reach):
                    yield [s] * n + rest
        i -= 1


def completions(room: int, sizes: list[int], count: dict[int, int], most_waste: int) -> Iterator[list[int]]:
    """Undominated fillings of `room` with sizes (ascending list, counts > 0), largest sizes first, least waste first.

    Sums that can be made are known beforehand, so no branch ends in a dead end; the first filling, the
    best fit, is never dominated.
    """
    sizes = sizes[: bisect_right(sizes, room)]
    reach = _reach(room, sizes, count)
    first = True
    for waste in range(min(room, most_waste) + 1):
        if reach[-1] >> room - waste & 1:
            for filling in _exact(room - waste, len(sizes), sizes, count, reach):
                if first or not _dominated(filling, waste, sizes, count):
                    first = False
                    yield filling


def complete(room: int, sizes: list[int], count: dict[int, int]) -> list[int]:
    """The sizes that fill `room` with the least waste, largest first."""
    return next(completions(room, sizes, count, room))


def least_containers(histogram: dict[int, int], capacity: int) -> int:
    """A lower bound of the containers needed: for each k, items above half the capacity stand alone, and those from k on must fit beside them."""
    half = capacity // 2
    number = np.zeros(capacity + 2, np.int64)
    for s, n in histogram.items():
        number[s] += n
    size = number * np.arange(capacity + 2)
    n_upto, size_upto = np.cumsum(number), np.cumsum(size)
    best = -(-int(size_upto[-1]) // capacity)
    for k in range(half + 1):
        alone = int(n_upto[capacity] - n_upto[capacity - k])
        beside = int(n_upto[capacity - k] - n_upto[half])
        room = beside * capacity - int(size_upto[capacity - k] - size_upto[half])
        small = int(size_upto[half] - (size_upto[k - 1] if k else 0))
        best = max(best, alone + beside + max(0, -(-(small - room) // capacity)))
    return best


def plan(histogram: dict[int, int], capacity: int, nodes: int = SEARCH_NODES) -> list[tuple[int, dict[int, int]]]:
    """Fillings [(times, {size: items})] that use up the histogram of sizes in 1..capacity in as few containers as found.

    Depth-first over the fillings around the largest size left, each taken as often as it can be. The search
    ends when the lower bound is met or no branch can do better, and in any case after `nodes` fillings. The
    number of fillings of a packing is bounded by the capacity, not the corpus: each use of one exhausts a
    size or leaves less of it than one more container would take.
    """
    count = {s: n for s, n in sorted(histogram.items()) if n > 0}
    left, used, allowed = sum(s * n for s, n in count.items()), 0, 0
    if not left:
        return []
    least, best_used, best = least_containers(count, capacity), 1 << 62, []

    def branches() -> Iterator[dict[int, int]]:
        rest = {s: n for s, n in count.items() if n}
        big = next(reversed(rest))
        rest[big] -= 1
        sizes = list(rest) if rest[big] else list(rest)[:-1]
        for chosen in completions(capacity - big, sizes, rest, allowed):
            filling: dict[int, int] = {}
            for s in (big, *chosen):
                filling[s] = filling.get(s, 0) + 1
            yield filling

    def waste_left() -> int:
        """What containers may still waste so that fewer than the best are used."""
        return capacity if not best else (best_used - 1 - used) * capacity - left

    allowed = waste_left()
    # on the way to the first packing only each level's first branch is known, its generator, which holds the sums
    # of all sizes, is let go; a level that the search comes back to generates its branches again
    stack: list[Iterator[dict[int, int]] | None] = [None]
    taken: list[tuple[int, dict[int, int]]] = []
    while stack:
        if len(taken) == len(stack):  # back from below this branch
            times, filling = taken.pop()
            for s, k in filling.items():
                count[s] += times * k
            left += times * sum(s * k for s, k in filling.items())
            used -= times
        allowed = waste_left()
        if allowed < 0 or best and nodes <= 0:
            filling = None
        elif not best:
            filling = next(branches(), None)
        else:
            if stack[-1] is None:
                stack[-1] = branches()
                next(stack[-1], None)
            filling = next(stack[-1], None)
        if filling is None:
            stack.pop()
            continue
        nodes -= 1
        load = sum(s * k for s, k in filling.items())
        times = min(count[s] // k for s, k in filling.items())
        if best and capacity - load > allowed:
            stack.pop()  # fillings only get worse
            continue
        for s, k in filling.items():
            count[s] -= times * k
        left -= times * load
        used += times
        taken.append((times, filling))
        if not left:
            if used < best_used:
                best_used, best = used, list(taken)
                if best_used <= least:
                    break
        elif used + -(-left // capacity) < best_used:
            allowed = waste_left()
            stack.append(branches() if best else None)
    return best


def _slots(fillings: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: first rank of each run, its first container, items a container."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    container = 0
    for times, filling in fillings:
        for s, k in filling.items():
            runs.setdefault(s, []).append((seen.get(s, 0), container, k))
            seen[s] = seen.get(s, 0) + times * k
        container += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()}


def sized_documents(documents: DataFrame, tokenizer: str, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) per distinct row of `documents` (doc_id, text)."""
    return documents.select("doc_id", count_column(vocabulary(tokenizer, folder))("text").alias("n_tokens"))


def pack(sized: DataFrame, capacity_id: int, capacity: int, rows_a_salt: int = 100_000, total: int | None = None) -> DataFrame:
    """(capacity_id, container_id, doc_id, piece, token_start, n_tokens): `sized` (doc_id, n_tokens) in containers.

    A document larger than the capacity is cut into full containers and a remainder, which is packed like a
    document; no other is cut. Documents without tokens (null, empty) take no room: they are dealt out over
    the containers, or go to container 0 where there is no other. Repeated rows are packed as often as they
    come. Containers are numbered from 0; ranks within a size are counted per salted part, so a size that
    holds most of the corpus passes through no single task.
    """
    c = int(capacity)
    if c < 1:
        raise ValueError("a capacity must be at least 1")
    total = sized.count() if total is None else total
    salts = max(1, -(-total // rows_a_salt))
    n = F.col("n_tokens")
    full = F.floor(n / c).cast("bigint")
    parts = sized.where("doc_id is not null and n_tokens is not null").select("doc_id", "n_tokens", full.alias("full"), (n % c).alias("rest")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    per_part = parts.groupBy("rest", "salt").agg(F.count("*").alias("k"), F.sum("full").alias("whole"))
    by_size = per_part.groupBy("rest").agg(F.sum("k").alias("k"), F.sum("whole").alias("whole")).collect()  # `capacity` rows at most
    histogram = {r["rest"]: r["k"] for r in by_size}
    firsts, wholes = {}, 0
    for r in sorted(by_size, key=lambda r: r["rest"]):
        firsts[r["rest"]] = wholes
        wholes += r["whole"]
    histogram.pop(0, None)
    fillings = plan(histogram, c)
    slots = _slots(fillings)
    packed = sum(t for t, _ in fillings)
    containers = packed + wholes
    shared = sized.sparkSession.sparkContext.broadcast((slots, firsts))  # bounded by the capacity, not the corpus
    # where a part's ranks and whole containers start within its size: a window over the parts of one size
    upto = W.partitionBy("rest").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = per_part.select("rest", "salt", F.coalesce(F.sum("k").over(upto), F.lit(0)).alias("k0"), F.coalesce(F.sum("whole").over(upto), F.lit(0)).alias("w0"))
    w = W.partitionBy("rest", "salt").orderBy("doc_id")
    ranked = parts.withColumn("i", F.row_number().over(w) - 1).withColumn("w", F.coalesce(F.sum("full").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(starts, ["rest", "salt"]).withColumn("i", F.col("i") + F.col("k0")).withColumn("w", F.col("w") + F.col("w0"))

    @F.pandas_udf("struct<container: bigint, first_full: bigint>")
    def place(rest: pd.Series, i: pd.Series, w_: pd.Series) -> pd.DataFrame:
        slots_, firsts_ = shared.value
        rank, sizes = i.to_numpy(np.int64), rest.to_numpy(np.int64)
        out = np.zeros(len(rank), np.int64)
        first_full = packed + w_.to_numpy(np.int64)
        for s in np.unique(sizes):
            m = sizes == s
            first_full[m] += firsts_[int(s)]
            if int(s) in slots_:
                first, box, per = slots_[int(s)]
                j = np.searchsorted(first, rank[m], "right") - 1
                out[m] = box[j] + (rank[m] - first[j]) // per[j]
            elif containers:
                out[m] = rank[m] % containers
        return pd.DataFrame({"container": out, "first_full": first_full})

    placed = ranked.withColumn("p", place("rest", "i", "w"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.col("full") - 1, F.lit(0))), lambda x: F.struct((F.col("p.first_full") + x).alias("container_id"), x.alias("piece"), (x * c).alias("token_start"), F.lit(c).cast("bigint").alias("n_tokens")))
    last = F.struct(F.col("p.container").alias("container_id"), F.col("full").alias("piece"), (F.col("full") * c).alias("token_start"), F.col("rest").alias("n_tokens"))
    all_ = F.concat(F.when(F.col("full") > 0, pieces).otherwise(F.array().cast("array<struct<container_id:bigint,piece:bigint,token_start:bigint,n_tokens:bigint>>")), F.when((F.col("rest") > 0) | (F.col("full") == 0), F.array(last)).otherwise(F.array().cast("array<struct<container_id:bigint,piece:bigint,token_start:bigint,n_tokens:bigint>>")))
    return placed.select(F.lit(capacity_id).cast("bigint").alias("capacity_id"), "doc_id", F.explode(all_).alias("x")).select("capacity_id", "x.container_id", "doc_id", "x.piece", "x.token_start", "x.n_tokens")


def pack_documents(documents: DataFrame, capacities: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """`pack` of all documents for every row of `capacities` (capacity_id, tokenizer, capacity_tokens; a small, fixed table)."""
    rows = capacities.select("capacity_id", "tokenizer", "capacity_tokens").distinct().limit(MOST_CAPACITIES + 1).collect()
    if len(rows) > MOST_CAPACITIES:
        raise ValueError("more capacities than one call may pack")
    sized = {t: cut(sized_documents(documents, t, folder)) for t in sorted({r["tokenizer"] for r in rows})}
    if not rows:
        return documents.sparkSession.createDataFrame([], "capacity_id bigint, container_id bigint, doc_id bigint, piece bigint, token_start bigint, n_tokens bigint")
    totals = {t: s.count() for t, s in sized.items()}
    return reduce(DataFrame.unionByName, [pack(sized[r["tokenizer"]], r["capacity_id"], r["capacity_tokens"], total=totals[r["tokenizer"]]) for r in sorted(rows, key=lambda r: r["capacity_id"])])
