"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sources that hold the same
text) and size class.  A min-cost flow routes the tokens of each pattern to
source quotas; using a document again costs more each time, so copies are made
only where a source is short.  Documents are then drawn in a seeded order.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

REPEAT_COST = 10
TOP_UPS = 2


class MinCostFlow:
    """Successive shortest paths with potentials; capacities are tokens."""

    def __init__(self, n: int):
        self.graph: list[list[list[int]]] = [[] for _ in range(n)]

    def edge(self, u: int, v: int, cap: int, cost: int) -> tuple[int, int]:
        self.graph[u].append([v, cap, cost, len(self.graph[v])])
        self.graph[v].append([u, 0, -cost, len(self.graph[u]) - 1])
        return u, len(self.graph[u]) - 1

    def flow_on(self, e: tuple[int, int]) -> int:
        u, k = e
        v, _, _, r = self.graph[u][k]
        return self.graph[v][r][1]

    def reachable(self, s: int) -> set[int]:
        """Nodes that capacity is left to: the near side of a minimum cut."""
        seen, todo = {s}, [s]
        while todo:
            for v, cap, _, _ in self.graph[todo.pop()]:
                if cap > 0 and v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen

    def run(self, s: int, t: int) -> int:
        """Send as much as possible from s to t at least cost."""
        n = len(self.graph)
        potential = [0] * n
        sent = 0
        while True:
            dist = [math.inf] * n
            dist[s] = 0
            via: list[tuple[int, int] | None] = [None] * n
            heap = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for k, (v, cap, cost, _) in enumerate(self.graph[u]):
                    if cap > 0 and d + cost + potential[u] - potential[v] < dist[v]:
                        dist[v] = d + cost + potential[u] - potential[v]
                        via[v] = (u, k)
                        heapq.heappush(heap, (dist[v], v))
            if dist[t] == math.inf:
                return sent
            for v in range(n):
                if dist[v] < math.inf:
                    potential[v] += dist[v]
            push, v = math.inf, t
            while v != s:
                u, k = via[v]
                push = min(push, self.graph[u][k][1])
                v = u
            v = t
            while v != s:
                u, k = via[v]
                self.graph[u][k][1] -= push
                self.graph[v][self.graph[u][k][3]][1] += push
                v = u
            sent += push


def largest_total(shares: dict[str, float], reach: dict[str, int]) -> int:
    """Largest mix in which every source that has any text meets its share."""
    live = [reach[s] / w for s, w in shares.items() if w > 0 and reach.get(s, 0) > 0]
    return int(min(live)) if live else 0


def plan(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]):
    """(flow, quota) of the largest exact mix: tokens of (pattern, source, repeat).

    patterns: tokens of the documents that exactly these sources hold.  The size
    of the mix is found by Newton steps on minimum cuts: a flow that leaves quotas
    open shows the cut that binds, and the size at which this cut holds."""
    reach: dict[str, int] = {}
    for members, tokens in patterns.items():
        for s in members:
            if s in targets:
                reach[s] = reach.get(s, 0) + tokens * targets[s][1]
    present = {s: w for s, (w, _) in targets.items() if reach.get(s, 0) > 0}
    scale = sum(present.values())
    shares = {s: w / scale for s, w in present.items()} if scale > 0 else {}
    names = sorted(shares)
    keys = sorted(m for m in patterns if any(s in shares for s in m))
    node = {s: 1 + len(keys) + i for i, s in enumerate(names)}
    sink = 1 + len(keys) + len(names)
    total = largest_total(shares, reach)
    while True:
        quota = {s: int(shares[s] * total) for s in names}
        g = MinCostFlow(sink + 1)
        taken, limits = [], []
        for p, members in enumerate(keys):
            inside = [s for s in members if s in node]
            limits.append(patterns[members] * max(targets[s][1] for s in inside))
            g.edge(0, 1 + p, limits[-1], 0)
            for s in inside:
                # convex: the r-th use costs r times more; no more uses than the quota could take
                for r in range(min(targets[s][1], quota[s] // patterns[members] + 1)):
                    taken.append((members, s, r, g.edge(1 + p, node[s], patterns[members], r * REPEAT_COST)))
        for s in names:
            g.edge(node[s], sink, quota[s], 0)
        if g.run(0, sink) >= sum(quota.values()) or total <= 0:
            return [(m, s, r, g.flow_on(e)) for m, s, r, e in taken if g.flow_on(e) > 0], quota
        inside = g.reachable(0)
        fixed = sum(limits[p] for p in range(len(keys)) if 1 + p not in inside)
        fixed += sum(patterns[m] * targets[s][1] for p, m in enumerate(keys) if 1 + p in inside for s in m if s in node and node[s] not in inside)
        free = 1 - sum(shares[s] for s in names if node[s] in inside)
        total = min(total - 1, int(fixed / free) if free > 1e-12 else total - 1)


def mix_sources(sized: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, tokens, uses): the documents drawn for each source and
    how often each is used.

    `sized` has doc_id, source, tokens and optionally `copy_of`, a key that
    equal documents of several sources share.  Sources without a target are
    never drawn; a target without documents gives its share to the others in
    proportion.  Per pattern and source whole documents are taken in the order
    of a seeded hash as long as they fit the planned tokens; shorter ones then
    fill the gap, so that a share misses its target by less than a document.

    Defined cases: null sources and documents of 0 tokens are never drawn;
    max_repeats below 1 or null excludes a source; repeated target rows use
    the first by share; an empty table gives no rows; a source with a third of
    all rows is aggregated before the plan and ranked in hash buckets."""
    goal = {}
    for r in targets.select("source", "target_share", "max_repeats").orderBy("source", F.desc("target_share")).collect():
        if r["source"] is not None and r["target_share"] and r["target_share"] > 0 and r["max_repeats"] and r["max_repeats"] > 0:
            goal.setdefault(r["source"], (float(r["target_share"]), int(r["max_repeats"])))
    spark = sized.sparkSession
    wanted = spark.createDataFrame([(s,) for s in goal], "source string")
    rows = sized.filter("source is not null and tokens > 0").join(F.broadcast(wanted), "source", "left_semi")
    if "copy_of" not in rows.columns:
        rows = rows.withColumn("copy_of", F.col("doc_id").cast("string"))
    # one row per (text, source): copies inside a source are one document
    texts = rows.groupBy("copy_of", "source").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"))
    members = texts.groupBy("copy_of").agg(F.array_sort(F.collect_set("source")).alias("pattern"))
    texts = cut(texts.join(members, "copy_of"))
    totals = texts.groupBy("pattern", "copy_of").agg(F.max("tokens").alias("t")).groupBy("pattern").agg(F.sum("t").alias("t"))
    found = totals.collect()  # one row per combination of target sources
    flow, _ = plan({tuple(r["pattern"]): int(r["t"]) for r in found}, goal)
    if not flow:
        return texts.limit(0).select("doc_id", "source", "tokens", F.lit(1).alias("uses"))
    # a pattern's documents lie on a ring of tokens in seeded order; each source
    # gets an interval of it, which may go round several times
    planned: dict[tuple, dict[str, int]] = {}
    for m, s, _, tokens in flow:
        planned.setdefault(m, {})[s] = planned.get(m, {}).get(s, 0) + tokens
    length = {tuple(r["pattern"]): int(r["t"]) for r in found}
    spans, allowed = [], []
    for m in sorted(planned):
        most, at = max(goal[s][1] for s in m if s in goal), 0
        for s in sorted(planned[m]):
            lo, hi = at, at + planned[m][s]
            allowed.append(("\x1f".join(m), s, planned[m][s], goal[s][1], most))
            for lap in range(lo // length[m], -(-hi // length[m])):
                base = lap * length[m]
                spans.append(("\x1f".join(m), s, max(lo, base) - base, min(hi, base + length[m]) - base))
            at = hi
    spans_df = spark.createDataFrame(spans, "pattern_key string, source string, lo long, hi long")
    allowed_df = spark.createDataFrame(allowed, "pattern_key string, source string, planned long, own_most long, most long")
    line = texts.withColumn("pattern_key", F.array_join("pattern", "\x1f")).groupBy("pattern_key", "copy_of").agg(F.max("tokens").alias("tokens"))
    line = cut(line.withColumn("order", F.xxhash64(F.lit(seed), "copy_of")))
    placed = _running(line, ["pattern_key"])
    used = (
        placed.join(F.broadcast(spans_df), "pattern_key").filter("start >= lo and start + tokens <= hi")
        .groupBy("pattern_key", "copy_of", "source").agg(F.count(F.lit(1)).alias("uses"), F.first("tokens").alias("tokens"))
    )
    used = cut(used)
    for _ in range(TOP_UPS):  # the gap that the first document too long for it left
        got = used.groupBy("pattern_key", "source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("got"))
        gap = allowed_df.join(got, ["pattern_key", "source"], "left").withColumn("gap", F.col("planned") - F.coalesce("got", F.lit(0))).filter("gap > 0")
        own = used.select("pattern_key", "copy_of", "source", F.col("uses").alias("own_uses"))
        whole = used.groupBy("pattern_key", "copy_of").agg(F.sum("uses").alias("all_uses"))
        free = (
            line.join(F.broadcast(gap), "pattern_key").filter("tokens <= gap")
            .join(own, ["pattern_key", "copy_of", "source"], "left").join(whole, ["pattern_key", "copy_of"], "left")
            .filter("coalesce(own_uses, 0) < own_most and coalesce(all_uses, 0) < most")
            # a text that several sources hold goes to one of them in a round
            .withColumn("turn", F.row_number().over(Window.partitionBy("pattern_key", "copy_of").orderBy("source"))).filter("turn = 1")
        )
        more = _running(free.select("pattern_key", "copy_of", "source", "tokens", "order", "gap"), ["pattern_key", "source"]).filter("start + tokens <= gap")
        used = cut(
            used.unionByName(more.select("pattern_key", "copy_of", "source", F.lit(1).cast("long").alias("uses"), "tokens"))
            .groupBy("pattern_key", "copy_of", "source").agg(F.sum("uses").alias("uses"), F.first("tokens").alias("tokens"))
        )
    return texts.join(used.select("copy_of", "source", "uses"), ["copy_of", "source"]).select("doc_id", "source", "tokens", "uses")


def _running(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`start`: tokens of the rows before each one in seeded order, in two
    levels (inside 4,096 hash buckets, then over the buckets' sums), so that no
    key is ordered in one task."""
    rows = rows.withColumn("bucket", F.shiftright("order", 52))
    inside = Window.partitionBy(*keys, "bucket").orderBy("order", "copy_of").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "bucket").agg(F.sum("tokens").alias("b")).withColumn("offset", F.coalesce(F.sum("b").over(over), F.lit(0)))
    part = rows.withColumn("part", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return part.join(before.drop("b"), [*keys, "bucket"]).withColumn("start", F.col("offset") + F.col("part"))


def mix_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, documents, uses, tokens, max_uses)."""
    per = drawn.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("max_uses")
    )
    total = per.agg(F.sum("tokens").alias("total"))
    return targets.select("source", "target_share", "max_repeats").join(per, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("max_uses", F.lit(0)).alias("max_uses"), "max_repeats",
    )
