"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Tokens flow from each pattern, once for nothing and again at
costs that rise with each repetition, through the sources it belongs to, into quotas of the targets' size; the cheapest largest flow says how many
tokens each pattern gives to each source. Every document of a pattern is then taken as often as the flow fills the pattern whole, and documents
in the order of a seeded hash once more until the rest is met to within 1 / BUCKETS of the pattern or a document.

A null source is a source of its own, after all others. A null size counts as 0. Sources whose documents are all empty have target 0. Rows that
are equal in every column get equal decisions, as do all reruns. An empty table gives an empty table. Only pattern and source totals reach the driver:
more than MAX_PATTERNS distinct sets of sources raise ValueError (nothing is dropped; group the sources first). Input columns pass through unless an
output column has their name; names that begin with _mix_ are the operator's own.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, without

#: Steps of the seeded order at which a pattern can be cut, patterns that the driver takes, and the cost of a token's first, second ... use.
BUCKETS, MAX_PATTERNS, REPEAT_COSTS = 4096, 100_000, (0, 1, 3)

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: str) -> Column:
    """Words of a text column; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float], most: float = 3.0) -> dict[str | None, float]:
    """All sizes together, shared by the weights (dealt in turn to the sources by code point, null last), no source above `most` times its size:
    the excess goes to the others by weight until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), list(order)
    while free:
        per = left / sum(weight[s] for s in free)
        full = [s for s in free if per * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: per * weight[s] for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


class _Flow:
    """Min-cost flow by cheapest augmenting paths with potentials; integer capacities and non-negative costs."""

    def __init__(self, n: int) -> None:
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to, self.room, self.cost = [], [], []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        price = [0] * len(self.arcs)
        while True:
            dist, via = [None] * len(self.arcs), [0] * len(self.arcs)
            dist[source], heap, done = 0, [(0, source)], set()
            while heap:
                d, x = heapq.heappop(heap)
                if x in done:
                    continue
                done.add(x)
                for e in self.arcs[x]:
                    y = self.to[e]
                    if self.room[e] and y not in done:
                        new = d + self.cost[e] + price[x] - price[y]
                        if dist[y] is None or new < dist[y]:
                            dist[y], via[y] = new, e
                            heapq.heappush(heap, (new, y))
            if dist[sink] is None:
                return
            price = [p + (dist[sink] if d is None or d > dist[sink] else d) for p, d in zip(price, dist)]
            x, room = sink, None
            while x != source:
                e = via[x]
                room = self.room[e] if room is None else min(room, self.room[e])
                x = self.to[e ^ 1]
            x = sink
            while x != source:
                e = via[x]
                self.room[e] -= room
                self.room[e ^ 1] += room
                x = self.to[e ^ 1]


def route(sizes: dict[tuple, int], quotas: dict[str | None, float], costs: Sequence[int] = REPEAT_COSTS) -> dict[tuple, dict]:
    """pattern -> source -> tokens. sizes: of each pattern, a tuple of sources."""
    patterns, sources = sorted(sizes, key=repr), sorted(quotas, key=repr)
    at = {s: 2 + len(patterns) + k for k, s in enumerate(sources)}
    net, arcs = _Flow(2 + len(patterns) + len(sources)), {}
    for k, p in enumerate(patterns):
        for c in costs:
            net.arc(0, 2 + k, sizes[p], c)
        for s in p:
            arcs[p, s] = net.arc(2 + k, at[s], len(costs) * sizes[p], 0)
    for s in sources:
        net.arc(at[s], 1, round(quotas[s]), 0)
    net.run(0, 1)
    return {p: {s: net.room[arcs[p, s] ^ 1] for s in p} for p in patterns}


def mix(df: DataFrame, sources: Column, size: Column, id_cols: Sequence[str], weights: Sequence[float] = (5, 2, 1), seed: int = 0, costs: Sequence[int] = REPEAT_COSTS, name: str = "mix") -> DataFrame:
    """Adds size, source_size and target (of the source that the document is taken for: the first of its pattern, or the one that the flow gives
    its place in the seeded order), taken_for and taken (the words taken, repeats counted), a multiple of size and at most len(costs) times it.

    sources: array<string>; id_cols: what tells rows apart in the seeded order.
    """
    made = ("size", "source_size", "target", "taken_for", "taken")
    rest = without(df, made)
    rows = df.select(
        *[f"`{c}`" for c in rest],
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))).alias("_mix_p"),
        F.pmod(F.xxhash64(F.lit(seed), *[f"`{c}`" for c in id_cols]), F.lit(BUCKETS)).cast("int").alias("_mix_b"),
    )
    spark = df.sparkSession
    # BUCKETS rows a pattern at most
    steps = materialise(rows.groupBy("_mix_p", "_mix_b").agg(F.sum("size").alias("n")), name)
    totals = steps.groupBy("_mix_p").agg(F.sum("n").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    key = {r["_mix_p"]: tuple(json.loads(r["_mix_p"])) for r in totals}
    sizes = {key[r["_mix_p"]]: r["n"] for r in totals}
    held: dict[str | None, int] = {}
    for p, n in sizes.items():
        for s in p:
            held[s] = held.get(s, 0) + n
    # what documents in several sources add to each of these is shared out: all together are the documents' words
    total, claimed = sum(sizes.values()), sum(held.values())
    quota = targets(held, weights, float(len(costs)))
    if claimed > total:
        quota = {s: q * total / claimed for s, q in quota.items()}
    flow = route(sizes, quota, costs)
    plan = []
    for text, p in key.items():
        out, n = flow[p], sizes[p]
        whole, more = divmod(sum(out.values()), n) if n else (0, 0)
        plan.append((text, int(whole), int(more), json.dumps([[s, out[s]] for s in p])))
    plans = spark.createDataFrame(plan, "_mix_p string, whole int, more long, shares string")
    # the step of the seeded order up to which a pattern's documents are taken once more: the one that ends nearest to what is missing
    w = Window.partitionBy("_mix_p").orderBy("_mix_b")
    run = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    near = steps.withColumn("run", run).join(F.broadcast(plans.select("_mix_p", "more")), "_mix_p")
    cut = near.groupBy("_mix_p").agg(F.min_by("_mix_b", F.struct(F.abs(F.col("run") - F.col("more")), "_mix_b")).alias("b"), F.min(F.abs(F.col("run") - F.col("more"))).alias("off"))
    cuts = {r["_mix_p"]: (r["b"], r["off"]) for r in cut.collect()}
    full = []
    for text, whole, more, _ in plan:
        p, n = key[text], sizes[key[text]]
        b, off = cuts[text]
        last = -1 if more <= off else b
        # each source of the pattern has a stretch of the seeded order in proportion to what flows to it
        amount, ends, got = max(1, sum(flow[p].values())), [], 0
        for s in p:
            got += flow[p][s]
            ends.append((got * BUCKETS // amount, s))
        ends[-1] = (BUCKETS, ends[-1][1])
        full.append((text, whole, last, [{"e": e, "s": s, "size": held[s], "target": float(quota[s])} for e, s in ends]))
    table = spark.createDataFrame(full, T.StructType.fromDDL("_mix_p string, whole int, last int, ends array<struct<e:int,s:string,size:bigint,target:double>>"))
    # at most MAX_PATTERNS rows
    got = rows.join(F.broadcast(table), "_mix_p", "left")
    goes = F.filter("ends", lambda x: F.col("_mix_b") < x["e"])[0]
    return got.select(
        *[f"`{c}`" for c in rest],
        "size",
        goes["size"].alias("source_size"),
        goes["target"].alias("target"),
        goes["s"].alias("taken_for"),
        (F.col("size") * (F.col("whole") + (F.col("_mix_b") <= F.col("last")).cast("int"))).cast("long").alias("taken"),
    )
