"""Items of varying length packed into containers of fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.ranking import positions
from lodestack.session import cut

#: A set of equal containers: how many, and how many items of each size are in one.
Pattern = tuple[int, dict[int, int]]


class _Sizes:
    """Sizes still to be packed, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.pop(bisect_left(self.order, size))

    def largest(self, limit: int, without: int) -> int | None:
        """The largest size of at most ``limit``, one item of size ``without`` being taken."""
        i = bisect_right(self.order, limit) - 1
        if i >= 0 and self.order[i] == without and self.count[without] == 1:
            i -= 1
        return self.order[i] if i >= 0 else None

    def smallest(self, k: int, without: int) -> list[int]:
        out: list[int] = []
        for s in self.order:
            out += [s] * min(k, self.count[s] - (s == without))
            if len(out) >= k:
                break
        return out[:k]

    def best_pair(self, limit: int, without: int) -> int:
        """The largest sum of two items of at most ``limit``; 0 if none."""
        some = [s for s in self.order if s < limit and self.count[s] > (s == without)]
        i, j, best = 0, len(some) - 1, 0
        while i <= j:
            a, b = some[i], some[j]
            if a + b > limit:
                j -= 1
            else:
                if i < j or self.count[a] - (a == without) > 1:
                    best = max(best, a + b)
                i += 1
        return best


def dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Containers that some best packing has, and the sizes that remain; after Martello and Toth.

    For a size a, a set of items beside it is fixed if no other set that fits can do better: a alone, if nothing
    fits; a and the largest b that fits, if b fills the rest, or only one item fits, or no two items that fit are
    larger together than b. Equal sets are fixed at once, so the work depends on the number of sizes, not of items.
    """
    left, fixed, changed = _Sizes(counts), [], True
    while changed:
        changed = False
        for a in reversed(list(left.order)):
            while a in left.count:
                rest = capacity - a
                least = left.smallest(3, a)
                b = left.largest(rest, a)
                if b is None:
                    fixed.append((left.count[a], {a: 1}))
                    left.take(a, left.count[a])
                    changed = True
                    break
                one = len(least) < 2 or least[0] + least[1] > rest
                two = len(least) < 3 or sum(least) > rest
                if not (b == rest or one or (two and b >= left.best_pair(rest, a))):
                    break
                # Several at once only where each of them would be fixed in the same way.
                if b == rest:
                    n = left.count[a] // 2 if a == b else min(left.count[a], left.count[b])
                else:
                    n = 1 if a == b or b in least or a in least else max(1, min(left.count[a] - 1, left.count[b] - 1))
                fixed.append((n, {a: 2} if a == b else {a: 1, b: 1}))
                left.take(a, 2 * n if a == b else n)
                if a != b:
                    left.take(b, n)
                changed = True
    return fixed, dict(left.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Largest items first, each into the fullest container that it fits in, equal containers together."""
    free: list[int] = []
    open_: dict[int, list[Pattern]] = {}

    def put(n: int, items: dict[int, int], room: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(free, room)
            open_[room].append((n, items))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(free, size)
            if i == len(free):
                m, items, room = -(-n // (capacity // size)), {}, capacity
            else:
                room = free[i]
                m, items = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    free.pop(i)
            each = room // size
            full = min(m, n // each)
            put(full, items | {size: each}, room - each * size)
            n -= full * each
            some = int(full < m and 0 < n < each)
            if some:
                put(1, items | {size: n}, room - n * size)
                n = 0
            if items or room < capacity:
                put(m - full - some, items, room)
    return [p for patterns in open_.values() for p in patterns]



def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Containers for so many items of each size from 1 to ``capacity``."""
    fixed, rest = dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _lookup(patterns: list[Pattern]) -> tuple[pd.DataFrame, int]:
    """(size, first rank, first container, items a container): where the items of a size go, by rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for n, items in patterns:
        for size, each in items.items():
            rows.append((size, used.get(size, 0), base, each))
            used[size] = used.get(size, 0) + n * each
        base += n
    table = pd.DataFrame(rows, columns=["size", "rank", "base", "each"], dtype="int64").sort_values(["size", "rank"])
    return table, base


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, ``piece``, ``start``, ``size``, ``container_id``): every item in a container.

    An item larger than the capacity is cut into pieces that fill a container each, and the remainder; no other item
    is cut. Items of the same size are alike, so a packing is made for the histogram of sizes alone, which has at most
    ``capacity`` rows however many items there are, and is then dealt to the items by their rank within
    their size. Ranks are made by a distributed sort, so a hot size is no problem. The sizes are checkpointed before it and
    the histogram is taken from the sorted rows, so texts are measured once. Items of size 0 (or null)
    need no space and are spread over all containers; if there are no others, they share container 0.
    """
    items = cut(items.select(key, size))
    whole = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    pieces = F.greatest(F.ceil(whole / F.lit(capacity)), F.lit(1)).cast("bigint")
    rows = items.select(F.col(key).alias("__k"), whole.alias("__all"), F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece"))
    rows = rows.withColumn("__size", F.least(F.col("__all") - F.col("piece") * capacity, F.lit(capacity).cast("bigint"))).withColumn("__mix", F.xxhash64("__k", "piece"))
    placed = positions(rows, ["__size"], ["__mix", "__k", "piece"])
    counts = {r["__size"]: r["n"] for r in placed.where(F.col("__size") > 0).groupBy("__size").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, total = _lookup(plan(counts, capacity))
    shift = np.int64(1) << 44
    firsts = (table["size"] * shift + table["rank"]).to_numpy("int64")
    shared = items.sparkSession.sparkContext.broadcast((firsts, table["rank"].to_numpy("int64"), table["base"].to_numpy("int64"), table["each"].to_numpy("int64"), max(total, 1)))

    @F.pandas_udf("bigint")
    def container(s: pd.Series, rank: pd.Series) -> pd.Series:
        starts, ranks, bases, each, n = shared.value
        r, s = rank.to_numpy("int64"), s.to_numpy("int64")
        if not len(starts):
            return pd.Series(r % n)
        at = np.maximum(np.searchsorted(starts, s * shift + r, side="right") - 1, 0)
        return pd.Series(np.where(s == 0, r % n, bases[at] + (r - ranks[at]) // each[at]))

    return placed.select(
        F.col("__k").alias(key), "piece", (F.col("piece") * capacity).alias("start"), F.col("__size").alias("size"), container("__size", "__start").alias("container_id")
    )


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, the fewest containers that could do (tokens / capacity), and the share filled."""
    used = packed.groupBy("container_id").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"))
    out = used.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.max("used").alias("fullest"),
    )
    return out.select("*", F.ceil(F.col("tokens") / capacity).alias("at_least"), F.round(F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6).alias("filled"))
