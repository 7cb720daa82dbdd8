"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to). A flow routes words from patterns to
the quotas of their sources: the first pass over a pattern is free, every further pass costs one more, up to `most`
passes, so repetition is spread as thinly as the quotas allow. A pattern's flow is then turned into documents: whole
passes first, and for the remainder the documents in a seeded order that fit one after another, plus the one document
that brings the sum nearest. The order goes by a hash of seed, id and text, so rows without an id, or under one, are spread
like all others. Only sums by pattern reach the driver.

Cases: documents without sources or words are never needed and take 0 words; a null source is a source of its own, after
all others; repeated rows are separate documents, told apart by a number that is written once with the sizes; quotas beyond `most` passes are cut to them.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Hashable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from jobtally.llm.work import written
from jobtally.operators.joins import split_lookup

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 20_000


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(text: Column | str) -> Column:
    """What tells texts under one id apart; null counts as empty."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def shared_by_weight(sizes: list[int], weights: list[float], share: float, most: int) -> list[float]:
    """Targets that sum to `share` of all sizes, in proportion to the weights, none above `most` times its size.

    What a capped source leaves over goes to the others by weight until none is above: sources are capped in the order
    of cap by weight, up to the one from which on the common level holds.
    """
    total = sum(sizes) * share
    caps = [float(most * s) for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    left, weight = total, float(sum(weights))
    targets = [0.0] * len(sizes)
    for at, i in enumerate(order):
        if caps[i] / weights[i] > left / weight:
            for j in order[at:]:
                targets[j] = weights[j] * (left / weight)
            break
        targets[i] = caps[i]
        left, weight = left - caps[i], weight - weights[i]
    return targets


def min_cost_flow(sizes: dict[Hashable, int], members: dict[Hashable, list], quotas: dict[Hashable, int],
                  most: int) -> dict[tuple, int]:
    """Words from each pattern to each of its sources, as many as the quotas take, with the fewest repetitions."""
    graph: list[list[int]] = [[], []]
    arcs: list[list] = []  # head, capacity left, cost
    place: dict = {}

    def node(name):
        if name not in place:
            place[name] = len(graph)
            graph.append([])
        return place[name]

    def arc(a, b, capacity, cost):
        graph[a].append(len(arcs))
        arcs.append([b, capacity, cost])
        graph[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    used = {}
    for p, size in sizes.items():
        for turn in range(most):
            arc(0, node(("p", p)), size, turn)
        for s in members[p]:
            used[p, s] = arc(node(("p", p)), node(("s", s)), most * size, 0)
    for s, quota in quotas.items():
        arc(node(("s", s)), 1, quota, 0)
    while True:
        cost, via, queue, queued = [math.inf] * len(graph), [-1] * len(graph), deque([0]), {0}
        cost[0] = 0
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in graph[a]:
                b, capacity, price = arcs[e]
                if capacity > 0 and cost[a] + price < cost[b]:
                    cost[b], via[b] = cost[a] + price, e
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        if via[1] < 0:
            return {k: arcs[e ^ 1][1] for k, e in used.items()}
        path, at = [], 1
        while at:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        amount = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= amount
            arcs[e ^ 1][1] += amount


def pattern_key(sources: Column | str) -> Column:
    """A text that names a set of sources; null is told apart from every name."""
    return F.to_json(F.struct(F.array_sort(F.array_distinct(sources)).alias("in")), {"ignoreNullFields": "false"})


def selected(documents: DataFrame, needed: dict[str, int], most: int, seed: str) -> DataFrame:
    """`documents` (row, id, digest, pattern, size) with the number of times each is taken, so that a pattern gives the words needed."""
    spark = documents.sparkSession
    sums = documents.groupBy("pattern").agg(F.sum("size").alias("held"), F.count("*").alias("n")).collect()
    plan = [(r.pattern, min(needed.get(r.pattern, 0), most * r.held), r.held, r.n) for r in sums]
    plan = spark.createDataFrame([(p, a // h if h else 0, a % h if h else 0, n) for p, a, h, n in plan],
                                 "pattern string, passes long, rest long, n_rows long")
    buckets = max(1, math.ceil(sum(r.n for r in sums) / ROWS_PER_BUCKET))
    place = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\x1f"), "digest"))
    keyed = documents.withColumn("place", place).withColumn(
        "bucket", F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * buckets, 32))
    before = keyed.groupBy("pattern", "bucket").agg(F.sum("size").alias("sum"))
    before = before.withColumn("before", F.sum("sum").over(W.partitionBy("pattern").orderBy("bucket")) - F.col("sum"))
    # What every document adds up to in the seeded order: within its bucket, plus all buckets before.
    order = W.partitionBy("pattern", "bucket").orderBy("place", "row").rowsBetween(W.unboundedPreceding, 0)
    running = (keyed.withColumn("within", F.sum("size").over(order))
               .join(before.drop("sum"), ["pattern", "bucket"]))
    # One pattern may hold most documents: its rows are split for the lookup.
    running = split_lookup(running, plan, ["pattern"], size="n_rows").withColumn("fits", F.col("before") + F.col("within") <= F.col("rest"))
    running = written(running.select("row", "id", "digest", "pattern", "size", "place", "passes", "rest", "fits"), "mix")
    gaps = running.groupBy("pattern").agg(
        (F.max("rest") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0))).alias("gap"))
    gaps = gaps.join(plan.select("pattern", "n_rows"), "pattern")
    open_rows = split_lookup(running.filter("NOT fits"), gaps, ["pattern"], size="n_rows", how="inner").filter("abs(gap - size) < gap")
    last = open_rows.groupBy("pattern").agg(
        F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "place", "row")).alias("best"))
    last = last.select("pattern", F.col("best.row").alias("one_more")).join(plan.select("pattern", "n_rows"), "pattern")
    one_more = (F.col("row") == F.col("one_more")) & ~F.col("fits")
    return (split_lookup(running, last, ["pattern"], size="n_rows")
            .select("id", "digest", "pattern", "size", (F.col("passes") + F.when(F.col("fits") | F.coalesce(one_more, F.lit(False)), 1)
                                              .otherwise(0)).alias("times")))


def mix(documents: DataFrame, sources: Column, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: int = 2,
        seed: str = "mix", id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with the times and words taken, and the sources with size and target.

    `sources` is an array of the sources of a document. Sources in the order of their code points, null last, weigh
    `weights` in turn; together they get `share` of all words, and none more than `most` times what it holds.
    """
    spark = documents.sparkSession
    sized = written(documents.select(F.col(id).alias("id"), digest(text).alias("digest"), sources.alias("sources"), words(text).alias("size"))
                    .withColumns({"pattern": pattern_key("sources"), "row": F.monotonically_increasing_id()}), "sizes")
    patterns = sized.groupBy("pattern", "sources").agg(F.sum("size").alias("size")).collect()
    sizes: dict[str, int] = {}
    members: dict[str, list] = {}
    held: dict[str | None, int] = {}
    for row in patterns:
        sizes[row.pattern] = sizes.get(row.pattern, 0) + row.size
        members[row.pattern] = sorted(set(row.sources or ()), key=lambda s: (s is None, s or ""))
    for pattern, size in sizes.items():
        for s in members[pattern]:
            held[s] = held.get(s, 0) + size
    names = sorted(held, key=lambda s: (s is None, (s or "").encode()))
    total = sum(sizes.values())
    weigh = [weights[i % len(weights)] for i in range(len(names))]
    factor = share * total / sum(held.values()) if sum(held.values()) else 0.0
    targets = dict(zip(names, shared_by_weight([held[s] for s in names], weigh, factor, most)))
    flow = min_cost_flow(sizes, members, {s: math.floor(t + 0.5) for s, t in targets.items()}, most)
    needed: dict[str, int] = {}
    for (pattern, _), amount in flow.items():
        needed[pattern] = needed.get(pattern, 0) + amount
    taken = selected(sized.select("row", "id", "digest", "pattern", "size"), needed, most, seed)
    mixed = taken.select(F.col("id").alias(id), "pattern", "size", "times", (F.col("times") * F.col("size")).alias("taken"), "digest")
    reached = {s: sum(a for (_, t), a in flow.items() if t == s) for s in names}
    report = spark.createDataFrame([(s, held[s], targets[s], reached[s]) for s in names],
                                   "source string, source_size long, target double, routed long")
    return mixed, report
