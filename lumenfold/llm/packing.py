"""Filling fixed-capacity containers by linear grouping.

Items over the capacity are split; full pieces fill containers, the last piece
is an item like others.  Lengths above capacity / SMALL form groups of equal
cardinality and are rounded up to the largest of their group.  For the few
rounded sizes configurations (what goes together into one container) are
optimised by bounded knapsacks; actual items then take the places of rounded
ones, and small items and the rest go best-fit, largest first, into what is
left.

Large tables are packed in parallel shards of about SHARD_ITEMS items, dealt by
row number; each shard wastes at most the open containers of its end.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SMALL = 8
GROUPS = 200
CELLS = 1024
FULL = 0.995
SHARD_ITEMS = 16_384


def size_groups(sizes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Index of each item's group; sizes come sorted ascending, and a group's
    rounded size is its last member."""
    return np.minimum(np.arange(len(sizes)) * groups // max(len(sizes), 1), groups - 1)


def _best_pattern(sizes, demand, capacity):
    """Counts per size of the fullest container that the demand can fill: a
    bounded knapsack over capacity in CELLS steps, which slightly prefers large
    sizes, as they are the harder ones to place later."""
    step = max(1, math.ceil(capacity / CELLS))
    cells = capacity // step
    units = [k for k, s in enumerate(sizes) for _ in range(min(demand[k], capacity // s))]
    best = np.zeros(cells + 1)
    taken = np.zeros((len(units), cells + 1), dtype=bool)
    for u, k in enumerate(units):
        w = math.ceil(sizes[k] / step)
        value = sizes[k] * (1 + 0.02 * sizes[k] / capacity)
        if w > cells:
            continue
        with_it = best[: cells + 1 - w] + value
        better = with_it > best[w:] + 1e-12
        taken[u, w:] = better
        best[w:] = np.where(better, with_it, best[w:])
    counts, c = [0] * len(sizes), cells
    for u in range(len(units) - 1, -1, -1):
        if taken[u, c]:
            counts[units[u]] += 1
            c -= math.ceil(sizes[units[u]] / step)
    return counts


def configurations(rounded: list[int], demand: list[int], capacity: int):
    """(counts per size, times): configurations over FULL of the capacity, each
    used until one of its sizes runs out, so that there are few of them.
    Sizes that no such configuration takes are left to best-fit."""
    left = list(demand)
    out = []
    while any(left):
        live = [k for k, d in enumerate(left) if d > 0 and rounded[k] <= capacity]
        if not live:
            break
        p = _best_pattern([rounded[k] for k in live], [left[k] for k in live], capacity)
        if sum(n * rounded[k] for n, k in zip(p, live)) < FULL * capacity:
            break
        counts = [0] * len(rounded)
        for n, k in zip(p, live):
            counts[k] = n
        times = min(left[k] // n for k, n in enumerate(counts) if n)
        out.append((counts, times))
        left = [d - n * times for d, n in zip(left, counts)]
    return out


class OpenBins:
    """Containers by free space, for best-fit."""

    def __init__(self):
        self.by_space: list[tuple[int, int]] = []

    def add(self, space: int, name: int) -> None:
        if space > 0:
            bisect.insort(self.by_space, (space, name))

    def take(self, size: int) -> tuple[int, int] | None:
        at = bisect.bisect_left(self.by_space, (size, -1))
        return self.by_space.pop(at) if at < len(self.by_space) else None


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item (sizes 1..capacity)."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    limit = capacity / SMALL
    small = [i for i in order if sizes[i] <= limit]
    large = [i for i in order if sizes[i] > limit]
    out = [-1] * len(sizes)
    count = 0
    bins = OpenBins()
    rest: list[int] = []
    if large:
        groups = size_groups(np.array([sizes[i] for i in large]))
        members: dict[int, list[int]] = defaultdict(list)
        for i, g in zip(large, groups.tolist()):
            members[g].append(i)
        ids = sorted(members)
        rounded = [sizes[members[g][-1]] for g in ids]
        queues = {k: list(members[g]) for k, g in enumerate(ids)}
        for counts, times in configurations(rounded, [len(members[g]) for g in ids], capacity):
            for _ in range(times):
                space = capacity
                placed = False
                for k, n in enumerate(counts):
                    for _ in range(n):
                        if queues[k]:
                            i = queues[k].pop()
                            out[i] = count
                            space -= sizes[i]
                            placed = True
                if placed:
                    bins.add(space, count)
                    count += 1
        rest = [i for k in queues for i in queues[k]]
    for i in sorted(small + rest, key=lambda i: (-sizes[i], i)):
        got = bins.take(sizes[i])
        if got is None:
            got = (capacity, count)
            count += 1
        out[i] = got[1]
        bins.add(got[0] - sizes[i], got[1])
    return out


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["tokens", "doc_id", "item"], kind="stable")
    pdf = pdf.assign(container=np.asarray(pack(pdf["tokens"].tolist(), capacity), dtype=np.int64))
    return pdf[["capacity", "shard", "container", "doc_id", "piece", "tokens"]]


def fill_containers(sized: DataFrame, containers: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_kind, capacity, shard, container, doc_id, piece, tokens): every
    item once per kind and capacity; (container_kind, capacity, shard, container)
    names a container.

    Defined cases: items of 0 tokens take no space and are left out, their
    documents having nothing to place; an item over the capacity becomes
    pieces 0, 1, ... of which all but the last fill a container (of shard -1)
    each; kinds with a null or non-positive capacity have no rows; rows that
    repeat a kind with its capacity count once, a kind with several capacities
    is packed for each; repeated ids are separate items, which row numbers tell
    apart; other columns are ignored."""
    # numbered once and written, so that a row keeps its number in every use
    items = cut(sized.select("doc_id", "tokens").filter("tokens > 0").withColumn("item", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(items.count() / shard_items))
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).filter("capacity > 0").distinct()
    # one pass over the items per capacity, whatever the number of kinds that have it
    capacities = sorted(r["capacity"] for r in kinds.select("capacity").distinct().collect())
    each = items.withColumn("capacity", F.explode(F.array(*[F.lit(c).cast("long") for c in capacities]).cast("array<bigint>")))
    each = each.withColumn("full", F.floor((F.col("tokens") - 1) / F.col("capacity")))
    filled = each.filter("full > 0").select("capacity", "item", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece")).select(
        "capacity", F.lit(-1).alias("shard"), F.xxhash64("item", "piece").alias("container"), "doc_id", F.col("piece").cast("int").alias("piece"), F.col("capacity").alias("tokens")
    )
    rest = each.select(
        "capacity", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"), "item", "doc_id",
        F.col("full").cast("int").alias("piece"), (F.col("tokens") - F.col("full") * F.col("capacity")).alias("tokens"),
    )
    packed = rest.groupBy("capacity", "shard").applyInPandas(_packed, "capacity long, shard int, container long, doc_id long, piece int, tokens long")
    return kinds.join(packed.unionByName(filled), "capacity").select("container_kind", "capacity", "shard", "container", "doc_id", "piece", "tokens")


def fill_report(packed: DataFrame) -> DataFrame:
    """(container_kind, capacity, containers, items, tokens, fill) of a packing."""
    per = packed.groupBy("container_kind", "capacity", "shard", "container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("container_kind", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"),
        F.round(F.sum("t") / (F.count(F.lit(1)) * F.first("capacity")), 6).alias("fill"), F.max("t").alias("fullest"),
    )
