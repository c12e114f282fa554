"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to).  A flow network routes the token capacity of each pattern to the quotas of
its sources; repeating a pattern costs more with every pass, so the flow uses
fresh text before repeats.  The flow of a pattern is then turned into whole
passes over its documents plus a seeded selection for the rest.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.common import Scratch, bounded_rows

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"

#: Most patterns that the network may have; it is solved on the driver.
MAX_PATTERNS = 2_000

#: Cost of the first, second and third pass over a document: convex.
PASS_COSTS = (0, 1, 3)

#: Seeded documents are ordered by bin first, so that only one bin is sorted.
BINS = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def water_fill(total: float, weights: Sequence[float], caps: Sequence[float]) -> list[float]:
    """Share ``total`` by weight; what exceeds a cap is reshared until none is above."""
    share, open_, left = [0.0] * len(caps), list(range(len(caps))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > caps[i]]
        if not over:
            for i in open_:
                share[i] = left * weights[i] / weight
            break
        rest = left
        for i in over:
            share[i] = float(caps[i])
            rest -= caps[i]
        open_, left = [i for i in open_ if i not in set(over)], rest
    return share


class FlowNetwork:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.cap[arc ^ 1]

    def solve(self, source: int, sink: int) -> int:
        n, pushed, far = len(self.arcs), 0, float("inf")
        height = [0] * n
        while True:
            dist, via = [far] * n, [-1] * n
            dist[source], queue = 0, [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > dist[a]:
                    continue
                for e in self.arcs[a]:
                    b = self.to[e]
                    if self.cap[e] > 0 and (x := d + self.cost[e] + height[a] - height[b]) < dist[b]:
                        dist[b], via[b] = x, e
                        heapq.heappush(queue, (x, b))
            if via[sink] < 0:
                return pushed
            height = [h + (d if d < far else dist[sink]) for h, d in zip(height, dist, strict=True)]
            path, a = [], sink
            while a != source:
                path.append(via[a])
                a = self.to[via[a] ^ 1]
            step = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= step
                self.cap[e ^ 1] += step
            pushed += step


def route(patterns: dict[tuple, int], quotas: dict, pass_costs: Sequence[int] = PASS_COSTS) -> dict[tuple, int]:
    """Words to take from each pattern so that the sources' quotas are met at least cost."""
    names, keys = list(quotas), list(patterns)
    net = FlowNetwork(2 + len(names) + len(keys))
    source, sink = 0, 1
    at_source = {s: 2 + i for i, s in enumerate(names)}
    for s in names:
        net.add(at_source[s], sink, int(quotas[s]), 0)
    arcs: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        node = 2 + len(names) + i
        arcs[key] = [net.add(source, node, int(patterns[key]), cost) for cost in pass_costs]
        for s in key:
            net.add(node, at_source[s], int(patterns[key]) * len(pass_costs), 0)
    net.solve(source, sink)
    return {key: sum(map(net.flow, own)) for key, own in arcs.items()}


def source_targets(sizes: dict, weigh: Callable[[list], list[float]], total_share: float = 1.0, most: int = len(PASS_COSTS)) -> dict:
    """Target of each source: names in code-point order, null last; capped at ``most`` times its size."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    shares = water_fill(total_share * sum(sizes.values()), weigh(names), [most * sizes[s] for s in names])
    return dict(zip(names, shares, strict=True))


def mix(docs: DataFrame, weigh: Callable[[list], list[float]], sources: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """How many words of each document the mix takes.

    ``sources`` is an array column, the sources that a document belongs to
    (null elements are a source of their own; a null or empty array is the null
    source).  ``weigh`` maps the ordered source names to their weights.
    Returns one row per input row: ``doc_id, size, pattern, passes, taken``
    besides ``source_size`` and ``target``, the sums over its sources.

    A null or empty text has size 0 and is never taken.  Repeated rows are
    documents of their own, ordered by id and size, and equal ones are
    interchangeable.  A null id is drawn like any other and reported as null; an
    empty table gives an empty result.  Other columns are not read.  Reruns give
    the same rows.
    The sums per pattern go to the driver, which checks that there are at most
    ``max_patterns`` of them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    given = F.when(sources.isNull() | (F.size(sources) == 0), F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(sources)))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), n_words(F.col(text_col)).alias("size"), given.alias("pattern"))
    sized = scratch.save(sized.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")), "sizes")

    rows = bounded_rows(sized.groupBy("pattern").agg(F.sum("size").alias("size")), max_patterns)
    if rows is None:
        raise ValueError(f"more than {max_patterns} membership patterns: merge sources or raise max_patterns")
    patterns = {tuple(r["pattern"]): int(r["size"]) for r in rows}
    sizes: dict = {}
    for key, size in patterns.items():
        for s in key:
            sizes[s] = sizes.get(s, 0) + size
    targets = source_targets(sizes, weigh) if sizes else {}
    if any(len(k) > 1 for k in patterns):  # overlapping sources count shared words once
        scale = sum(patterns.values()) / max(1, sum(sizes.values()))
        targets = source_targets(sizes, weigh, scale)
    flows = route(patterns, {s: round(t) for s, t in targets.items()})

    plan_rows = []
    for key, size in patterns.items():
        passes, rest = divmod(flows[key], size) if size else (0, 0)
        plan_rows.append((list(key), int(sum(sizes[s] for s in key)), float(sum(targets[s] for s in key)), int(passes), int(rest)))
    plan_type = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("passes", T.LongType()), T.StructField("rest", T.LongType())])
    plan = spark.createDataFrame(plan_rows, plan_type)

    # Words of a pattern in each bin, to find the bin in which its rest ends.
    in_bin = F.pmod("draw", F.lit(BINS)).cast("int")
    bins = sized.groupBy("pattern", in_bin.alias("bin")).agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = bins.withColumn("before", before).join(F.broadcast(plan.select("pattern", "rest")), "pattern")
    ends = ends.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select("pattern", F.col("bin").alias("last_bin"), "before")
    plan = plan.join(F.broadcast(ends), "pattern", "left")

    drawn = sized.withColumn("bin", in_bin).join(F.broadcast(plan), "pattern")
    inner = F.col("bin") < F.coalesce("last_bin", F.lit(-1))
    edge = F.coalesce(F.col("bin") == F.col("last_bin"), F.lit(False))
    easy = drawn.where(~edge).withColumn("chosen", inner)
    in_order = Window.partitionBy("pattern").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hard = drawn.where(edge).withColumn("upto", F.col("before") + F.sum("size").over(in_order))
    # The document that crosses the end is taken if that comes nearer.
    hard = hard.withColumn("chosen", F.col("upto") - F.col("size") / 2 <= F.col("rest")).drop("upto")
    both = easy.unionByName(hard)
    taken = F.col("size") * (F.col("passes") + F.col("chosen").cast("long"))
    return both.select("doc_id", "size", "pattern", "source_size", "target", "passes", taken.alias("taken"))


def cycle_weights(weights: Sequence[float]) -> Callable[[list], list[float]]:
    """Weights that repeat over the ordered source names."""
    return lambda names: [float(weights[i % len(weights)]) for i in range(len(names))]
