"""Items packed into containers of fixed capacity, improved by local search."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.session import written

CAPACITY = 2048
#: Items that one task packs together.
GROUP = 20_000
#: Containers filled less than this share are packed anew across groups.
DISSOLVE = 0.97
BINS = 1 << 20


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit in order of falling size: a start for the search."""
    free_mask = 0  # bit f: some container has f units free
    by_free: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    room: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = free_mask >> s
        if fit:
            f = s + ((fit & -fit).bit_length() - 1)
            b = by_free[f].pop()
            if not by_free[f]:
                free_mask &= ~(1 << f)
        else:
            b, f = len(bins), capacity
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] = f - s
        by_free.setdefault(f - s, []).append(b)
        free_mask |= 1 << (f - s)
    return bins


class Search:
    """Swap-based local search over the containers that are not full.

    A donor, the emptiest container, gives items to others: it moves one, exchanges one for a smaller one, or two for one,
    whenever the sum of squared fills grows and the other's capacity holds. It goes on until the donor is empty and so
    disappears, or nothing helps; then the next donor. Each step raises the sum, so it ends.
    """

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes.tolist(), capacity
        self.bins = bins
        self.fill = [sum(self.sizes[i] for i in b) for b in bins]
        self.at: dict[int, set[int]] = {}  # free units -> containers
        self.has: dict[int, dict[int, int]] = {}  # size -> containers with such an item and how many
        self.mask = 0  # bit s: some container has an item of size s
        for b, f in enumerate(self.fill):
            if f < capacity:
                self._enter(b)

    def _enter(self, b: int) -> None:
        self.at.setdefault(self.capacity - self.fill[b], set()).add(b)
        for i in self.bins[b]:
            own = self.has.setdefault(self.sizes[i], {})
            own[b] = own.get(b, 0) + 1
            self.mask |= 1 << self.sizes[i]

    def _leave(self, b: int) -> None:
        free = self.capacity - self.fill[b]
        self.at[free].discard(b)
        if not self.at[free]:
            del self.at[free]
        for i in self.bins[b]:
            own = self.has[self.sizes[i]]
            own[b] -= 1
            if not own[b]:
                del own[b]
                if not own:
                    self.mask &= ~(1 << self.sizes[i])

    def _take(self, b: int, size: int) -> int:
        k = next(k for k, i in enumerate(self.bins[b]) if self.sizes[i] == size)
        return self.bins[b].pop(k)

    def _exchange(self, donor: int, give: list[int], other: int, back: int | None) -> None:
        """Moves the items ``give`` to ``other`` and one of size ``back`` the other way. The donor is not in the indexes."""
        if self.fill[other] < self.capacity:
            self._leave(other)
        got = [self._take(other, back)] if back is not None else []
        for i in give:
            self.bins[donor].remove(i)
        self.bins[other] += give
        self.bins[donor] += got
        moved = sum(self.sizes[i] for i in give) - (back or 0)
        self.fill[other] += moved
        self.fill[donor] -= moved
        if self.fill[other] < self.capacity:
            self._enter(other)

    def _step(self, donor: int) -> bool:
        frees = sorted(self.at, reverse=True)
        if not frees:
            return False
        most, mine = frees[0], self.fill[donor]
        items = sorted(self.bins[donor], key=lambda i: -self.sizes[i])
        for i in items:  # move one: the fullest container that takes it
            s = self.sizes[i]
            fits = [f for f in frees if f >= s > 0]
            if fits and self.capacity - fits[-1] + s > mine - s:
                for f in reversed(fits):
                    if self.capacity - f + s > mine:
                        self._exchange(donor, [i], min(self.at[f]), None)
                        return True
        by: dict[int, list[int]] = {}
        for i in items:
            if self.sizes[i] > 0:
                by.setdefault(self.sizes[i], []).append(i)
        pairs: dict[int, list[int]] = {}
        order = list(by)  # every size of the donor; a sum needs one pair only
        for x, a in enumerate(order):
            if len(by[a]) > 1:
                pairs.setdefault(2 * a, by[a][:2])
            for b in order[x + 1 :]:
                pairs.setdefault(a + b, [by[a][0], by[b][0]])
        offers = [({s: own[:1] for s, own in by.items()}), pairs]
        masks = [sum(1 << s for s in give) for give in offers]
        for gain in range(min(most, mine), 0, -1):
            backs = (self.mask & ~1) << gain
            for give, mask in zip(offers, masks):
                hits = mask & backs
                while hits:
                    s = hits.bit_length() - 1
                    hits ^= 1 << s
                    for other in self.has[s - gain]:
                        if self.capacity - self.fill[other] >= gain and self.fill[other] + gain > mine:
                            self._exchange(donor, give[s], other, s - gain)
                            return True
        return False

    def run(self, rounds: int | None = None) -> list[list[int]]:
        """Goes over all containers that are not full until a round empties none, or so many times."""
        for _ in count() if rounds is None else range(rounds):
            todo = sorted((b for own in self.at.values() for b in own), key=lambda b: self.fill[b])
            gone = 0
            for donor in todo:
                if not self.bins[donor] or self.fill[donor] >= self.capacity:
                    continue
                self._leave(donor)
                steps = 0
                while self.bins[donor] and self.fill[donor] and self._step(donor):
                    steps += 1
                if self.bins[donor] and self.fill[donor] == 0 and self.at:  # only items of no size are left
                    rest = self.bins[donor]
                    self.bins[donor] = []
                    other = min(self.at[min(self.at)])
                    self._leave(other)
                    self.bins[other] += rest
                    self._enter(other)
                if not self.bins[donor]:
                    gone += 1
                elif self.fill[donor] < self.capacity:
                    self._enter(donor)
            if not gone:
                break
        return [b for b in self.bins if b]


def pack_sizes(sizes: np.ndarray, capacity: int, rounds: int | None = None) -> list[list[int]]:
    """Places of the items in each container; every item once, no container beyond its capacity."""
    sizes = np.asarray(sizes, np.int64)
    return Search(sizes, best_fit(sizes, capacity), capacity).run(rounds)


def pack(items: DataFrame, row_id: str, size: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Every item in a container: row_id, piece, begin, n_tokens, container_id.

    An item larger than the capacity, and only that, is cut into full containers and a rest. Items of size null count as 0; items
    of size 0 are placed too. Repeated rows and ids are items of their own. Items are dealt out evenly to groups of about
    ``group``, whatever their ids, and each group is packed by ``Search``; what is left in containers filled less than
    ``DISSOLVE`` is dealt out anew to as few groups, so that the space lost doesn't grow with the number of groups. An empty
    table gives no rows.
    """
    kind = dict(items.dtypes)[row_id]
    n = F.coalesce(F.col(size), F.lit(0)).cast("int")
    cuts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(capacity))
    rows = items.select(F.col(row_id).alias("row_id"), n.alias("n"), F.posexplode(cuts).alias("at", "begin")).select(
        "row_id", (F.col("at") + 1).cast("int").alias("piece"), F.col("begin").cast("int").alias("begin"), F.least(F.lit(capacity), F.col("n") - F.col("begin")).cast("int").alias("n_tokens")
    )
    rows = written(rows, "pack-items")
    schema = f"row_id {kind}, piece int, begin int, n_tokens int, container_id bigint, fill int"

    def packed(df: DataFrame, level: int) -> DataFrame:
        groups = max(1, -(-df.count() // group))
        number = F.monotonically_increasing_id()
        dealt = df.withColumn("grp", F.pmod(F.xxhash64(number), F.lit(groups)))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            bins = pack_sizes(pdf["n_tokens"].to_numpy(), capacity)
            where = np.empty(len(pdf), np.int64)
            fill = np.empty(len(pdf), np.int64)
            size_of = pdf["n_tokens"].to_numpy()
            base = (int(pdf["grp"].iloc[0]) * 2 + level) * BINS
            for k, b in enumerate(bins):
                where[b] = base + k
                fill[b] = size_of[b].sum()
            return pdf.drop(columns="grp").assign(container_id=where, fill=fill)

        # A stated number of partitions, which is not made smaller: groups are small in bytes but long to pack.
        dealt = dealt.repartition(min(groups, 10_000), "grp")
        return written(dealt.groupBy("grp").applyInPandas(one, schema), f"pack-{level}")

    first = packed(rows, 0)
    loose = F.col("fill") < DISSOLVE * capacity
    again = packed(first.where(loose).drop("container_id", "fill"), 1)
    return first.where(~loose).union(again).drop("fill")


def summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, items, tokens, least containers possible by volume, and share of the space that is used."""
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("items"))
    total = F.coalesce(F.sum("fill"), F.lit(0))
    return bins.agg(F.count("*").alias("containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), total.alias("tokens"), F.ceil(total / capacity).alias("least"), F.coalesce(F.round(F.try_divide(total, F.count("*") * capacity), 6), F.lit(1.0)).alias("used"))
