"""Filling fixed-capacity containers with items of varying length.

All decisions are made on the histogram of lengths, which has at most as many rows as a
container has tokens, whatever the corpus. The plan is a list of classes of equal containers
(lengths and how many of each), and so is bounded too; items then find their container from
their rank among the items of their length.

Large items are grouped: sorted by length and cut into groups of equal cardinality, each
rounded up to its longest item. For these few sizes the configuration program (which fillings
of a container to use, and how often) is solved by column generation. Rounded items are then
replaced by the actual ones, container by container of equal content, and small items go by
best fit, longest first, into the room that is left.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

CAPACITY = 2048
GROUPS = 24
#: Items longer than this share of a container take part in the configurations.
LARGE = 1 / 8
#: Items of one length are ranked within so many shares, so that no length is one task's work.
SHARES = 64


@dataclass
class Containers:
    """`n` equal containers: `content` maps a length to how many items of it each one holds."""

    n: int
    free: int
    content: dict[int, int] = field(default_factory=dict)

    def split(self, n: int) -> Containers:
        self.n -= n
        return Containers(n, self.free, dict(self.content))

    def add(self, size: int, k: int = 1) -> None:
        self.content[size] = self.content.get(size, 0) + k
        self.free -= size * k


def group_sizes(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, n) of items, longest first, cut into groups of equal cardinality."""
    total = sum(counts.values())
    share, out, room = -(-total // groups) if total else 1, [], 0
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            if not room:
                out.append([])
                room = share
            k = min(n, room)
            out[-1].append((size, k))
            n, room = n - k, room - k
    return out


def best_filling(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of a container, any number of each size (unbounded knapsack)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        for i, s in enumerate(sizes):
            if s <= c and best[c - s] + worth[i] > best[c] + 1e-12:
                best[c], last[c] = best[c - s] + worth[i], i
    filling, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            filling[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), filling


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(filling, times) that cover the demand: the linear program by column generation, rounded
    down, and the few items left by first fit."""
    k = len(sizes)
    if not k:
        return []
    need = np.array(demand, float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(k))
        value, filling = best_filling(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, filling.astype(float))
        now = np.linalg.solve(basis, need)
        positive = step > 1e-9
        if not positive.any():
            break
        ratio = np.where(positive, now / np.where(positive, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = filling
    times = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-9).astype(np.int64)
    out, left = [], np.array(demand, np.int64)
    for j in np.argsort(-times, kind="stable"):
        filling = basis[:, j].round().astype(int)
        used = filling > 0
        n = int(min(times[j], (left[used] // filling[used]).min())) if used.any() else 0
        if n > 0:
            out.append((filling, n))
            left -= filling * n
    while left.any():
        filling, room = np.zeros(k, int), capacity
        for i in range(k):
            n = int(min(left[i], room // sizes[i]))
            filling[i] = n
            room -= n * sizes[i]
        used = filling > 0
        n = int((left[used] // filling[used]).min())
        out.append((filling, n))
        left -= filling * n
    return out


def substitute(filling: np.ndarray, n: int, stock: list[list[list[int]]], capacity: int) -> list[Containers]:
    """n containers of a filling with actual lengths taken from the groups' runs, longest first."""
    out = [Containers(n, capacity)]
    for i, per in enumerate(filling):
        for _ in range(int(per)):
            done: list[Containers] = []
            for c in out:
                while c.n:
                    size, have = stock[i][0]
                    part = c if have >= c.n else c.split(have)
                    stock[i][0][1] -= part.n
                    if not stock[i][0][1]:
                        stock[i].pop(0)
                    done.append(part)
                    part.add(size)
                    if part is c:
                        break
            out = done
    return out


def plan_containers(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> list[Containers]:
    """Classes of equal containers that hold all items of a histogram (length to number)."""
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("a length lies outside of 1..capacity")
    big = {s: n for s, n in counts.items() if s > large * capacity and n}
    small = {s: n for s, n in counts.items() if s <= large * capacity and n}
    runs = group_sizes(big, groups)
    sizes, demand = [r[0][0] for r in runs], [sum(n for _, n in r) for r in runs]
    stock = [[list(x) for x in r] for r in runs]
    made: list[Containers] = []
    for filling, n in configurations(sizes, demand, capacity):
        made += substitute(filling, n, stock, capacity)
    room: dict[int, list[Containers]] = defaultdict(list)
    for c in made:
        room[c.free].append(c)

    def fill(size: int, n: int) -> int:
        """Best fit of n items of one size; the items that found no room."""
        while n:
            free = next((f for f in range(size, capacity + 1) if room.get(f)), None)
            if free is None:
                return n
            c = room[free].pop()
            per = min(free // size, n)
            # into each container as many as keep the next fuller one the worse fit
            many = min(c.n, n // per)
            part = c if many == c.n else c.split(many)
            if part is not c:
                room[free].append(c)
            part.add(size, per)
            room[part.free].append(part)
            n -= per * many
        return 0

    for size in sorted(small, reverse=True):
        n = fill(size, small[size])
        if n:
            per = capacity // size
            for k, many in ((per, n // per), (n % per, 1)):
                if k and many:
                    c = Containers(many, capacity)
                    c.add(size, k)
                    room[c.free].append(c)
    return [c for free in sorted(room) for c in room[free] if c.n]


def plan_table(plan: list[Containers]) -> pd.DataFrame:
    """(size, begin, end, base, per): items of a size with ranks begin..end - 1 go `per` to a
    container from number `base` on."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for c in plan:
        for size, per in sorted(c.content.items()):
            n = per * c.n
            rows.append((size, used[size], used[size] + n, base, per))
            used[size] += n
        base += c.n
    return pd.DataFrame(rows, columns=["size", "begin", "end", "base", "per"]).astype("int64").sort_values(["size", "begin"])


def pack(sizes: DataFrame, item: str, length: str, capacity: int = CAPACITY, shares: int = SHARES) -> DataFrame:
    """(item, part, tokens, container): every token of every item in one container.

    An item longer than the capacity is cut into full containers and a rest; no other item is
    cut. Items of length null or below 1 go nowhere. Items with equal ids are packed each for
    itself. Containers are numbered from 0. A full part of a long item fills a container of
    its own.
    """
    rows = sizes.select(F.col(f"`{item}`").alias("item"), F.col(f"`{length}`").cast("long").alias("length")).where(F.col("length") >= 1)
    # one pass over the lengths: all but the long items have a single part
    cuts = F.floor((F.col("length") - 1) / capacity).cast("int")
    parts = rows.select("item", "length", F.explode(F.sequence(F.lit(0), cuts)).alias("part"))
    tokens = F.least(F.lit(capacity).cast("long"), F.col("length") - F.col("part") * capacity).cast("int")
    share = F.pmod(F.xxhash64("item", "part"), F.lit(shares)).cast("int")
    pieces = stage(parts.select("item", "part", tokens.alias("tokens"), share.alias("share")), "pieces")

    # at most capacity * shares rows, whatever the corpus
    cells = pieces.groupBy("tokens", "share").agg(F.count("*").alias("n")).toPandas().sort_values(["tokens", "share"])
    histogram = {int(s): int(n) for s, n in cells.groupby("tokens")["n"].sum().items()}
    ranges = plan_table(plan_containers(histogram, capacity))
    cells["start"] = cells.groupby("tokens")["n"].cumsum() - cells["n"]
    starts = {(int(r.tokens), int(r.share)): int(r.start) for r in cells.itertuples(index=False)}
    by_size = {int(s): tuple(g[c].to_numpy() for c in ("begin", "base", "per")) for s, g in ranges.groupby("size")}

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("tokens", "share").orderBy("item", "part")) - 1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens, rank = pdf["tokens"].to_numpy(), pdf["rank"].to_numpy().astype(np.int64)
            rank = rank + np.array([starts[k] for k in zip(tokens.tolist(), pdf["share"].tolist(), strict=True)], np.int64)
            container = np.empty(len(pdf), np.int64)
            order = np.argsort(tokens, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(tokens[order]) != 0]) if len(order) else []
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                at = order[a:b]
                begin, base, per = by_size[int(tokens[at[0]])]
                i = np.searchsorted(begin, rank[at], side="right") - 1
                container[at] = base[i] + (rank[at] - begin[i]) // per[i]
            yield pd.DataFrame({"item": pdf["item"], "part": pdf["part"], "tokens": pdf["tokens"], "container": container})

    kind = dict(pieces.dtypes)["item"]
    out = ranked.mapInPandas(assign, f"item {kind}, part int, tokens int, container long")
    return out.withColumnRenamed("item", item)


def kept(sizes: DataFrame, packed: DataFrame, item: str, length: str, capacity: int = CAPACITY) -> DataFrame:
    """One row of what must hold of a packing: containers over their capacity, tokens lost (or, below
    zero, gained), items that are split though they would fit, items whose parts do not follow
    each other, and whether there are at most 1 % (and one) more containers than tokens fill. Ids
    must be unique."""
    boxes = packed.groupBy("container").agg(F.sum("tokens").alias("held"))
    over = boxes.agg(F.count_if(F.col("held") > capacity).alias("over_full"), F.count("*").alias("boxes"), F.sum("held").alias("held"))
    wanted = sizes.where(F.col(length) >= 1).agg(F.sum(length).alias("wanted"))
    parts = packed.groupBy(item).agg(F.count("*").alias("n"), F.max("part").alias("last"), F.countDistinct("part").alias("parts"), F.sum("tokens").alias("size"))
    cut = parts.agg(
        F.count_if((F.col("n") > 1) & (F.col("size") <= capacity)).alias("split"),
        F.count_if((F.col("last") != F.col("n") - 1) | (F.col("parts") != F.col("n"))).alias("gaps"),
    )
    # three tables of one row each, side by side
    one = F.lit(1).alias("_one")
    all_of = over.select("*", one).join(wanted.select("*", one), "_one").join(cut.select("*", one), "_one")
    least = F.ceil(F.col("wanted") / capacity)
    return all_of.select(
        "over_full",
        (F.coalesce("wanted", F.lit(0)) - F.coalesce("held", F.lit(0))).cast("long").alias("lost"),
        "split",
        "gaps",
        F.coalesce(F.col("boxes") <= least * 1.01 + 1, F.lit(True)).alias("near_least"),
    )
