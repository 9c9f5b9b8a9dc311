"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to (one row for each pattern); the flow routes
words from patterns to source quotas, a pattern's first copy at cost 0, its second at 1 and so on (convex,
so nothing repeats before all that helps has been used once). Documents are then taken in a seeded order.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.llm.common import tune, written

WORD = r"[^\x20\x09-\x0D]+"
#: Patterns and sources come to the driver; beyond so many the mix is refused rather than done in part.
MAX_PATTERNS = 100_000
#: Documents of a pattern to a bucket of the seeded order, and runs of buckets that sums are first taken of.
BUCKET_ROWS, SPANS = 512, 4096


def share_targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Split ``total`` by weight; a target stops at ``cap`` times its size, the excess is shared again by weight."""
    targets, active, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while active:
        weight = sum(weights[i] for i in sorted(active))
        if weight <= 0:
            break
        over = [i for i in sorted(active) if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in active:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in over)
        active -= set(over)
    return targets


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int) -> list[int]:
    """Words taken from each pattern (its source indexes, its size): maximum flow at least cost.

    A path's cost is that of its first arc, a word of a pattern's copy k costing k - 1. So shortest paths come
    copy by copy: each cost's arcs are opened in turn and blocking flows fill what is open (Dinic's algorithm);
    a path visits each source once at most, so the number of blocking flows follows the sources, not the patterns.
    """
    n_p, sink = len(patterns), len(patterns) + len(quotas)
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to: list[int] = []
    room: list[int] = []
    for p, (members, size) in enumerate(patterns):
        for s in members:
            graph[p].append(len(to))
            graph[n_p + s].append(len(to) + 1)
            to += (n_p + s, p)
            room += (repeats * size, 0)
    for s, quota in enumerate(quotas):
        graph[n_p + s].append(len(to))
        graph[sink].append(len(to) + 1)
        to += (sink, n_p + s)
        room += (quota, 0)
    taken = [0] * n_p
    for copy in range(1, repeats + 1):
        while True:
            starts = [p for p in range(n_p) if taken[p] < copy * patterns[p][1]]
            level, queue = dict.fromkeys(starts, 0), deque(starts)
            while queue and sink not in level:
                x = queue.popleft()
                for a in graph[x]:
                    if room[a] > 0 and to[a] not in level:
                        level[to[a]] = level[x] + 1
                        queue.append(to[a])
            if sink not in level:
                break
            tried = [0] * len(graph)  # arcs of a node that lead nowhere any more
            for p in starts:
                path: list[int] = []
                x = p
                while taken[p] < copy * patterns[p][1]:
                    if x == sink:
                        step = min(copy * patterns[p][1] - taken[p], *(room[a] for a in path))
                        for a in path:
                            room[a] -= step
                            room[a ^ 1] += step
                        taken[p] += step
                        path, x = [], p
                    elif tried[x] < len(graph[x]):
                        a = graph[x][tried[x]]
                        if room[a] > 0 and level.get(to[a], -1) == level[x] + 1:
                            path.append(a)
                            x = to[a]
                        else:
                            tried[x] += 1
                    elif path:
                        x = to[path.pop() ^ 1]
                        tried[x] += 1
                    else:
                        break
    return taken


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, in seeded order, every document that still fits into what is left."""
    rows = rows.sort_values(["_order", "_row"], kind="stable")
    left, extra = int(rows["_left"].iloc[0]), []
    for size in rows["_size"]:
        extra.append(int(0 < size <= left))
        left -= size * extra[-1]
    return rows.assign(_extra=extra)[["_pattern", "_row", "_size", "_extra"]]


def _edges(sums: DataFrame, by: str) -> DataFrame:
    """``_pattern, by, _left``: of each pattern the first ``by`` whose ``_sum`` does not fit into what is left there."""
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("_pattern").orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = sums.withColumn("_room", F.col("_left") - before).where("_room < _sum")
    return over.groupBy("_pattern").agg(F.min(F.struct(by, "_room")).alias("_e")).select("_pattern", F.col("_e")[by].alias(by), F.col("_e")["_room"].alias("_left"))


def mix(docs: DataFrame, members: str, targets: dict[int, float], repeats: int = 2, seed: int = 7, order_col: str = "_row") -> DataFrame:
    """Words to take of each row: adds ``taken``. ``docs`` has ``_row`` (unique), ``_size`` and the array column ``members``.

    targets: words wanted by source index, the values in ``members``. Rows of no source or size 0 take 0. The
    seeded order hashes ``order_col``, whose values should differ from row to row. A
    document is taken whole, a number of times that differs by one at most within its pattern. Reruns agree.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("_pattern", F.array_join(F.array_sort(F.array_distinct(members)), ","))
    patterns = keyed.groupBy("_pattern").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).orderBy("_pattern").limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    order = sorted(targets)
    at = {s: i for i, s in enumerate(order)}
    flow = min_cost_flow([(tuple(at[int(s)] for s in r["_pattern"].split(",") if s and int(s) in at), r["size"] or 0) for r in patterns], [round(targets[s]) for s in order], repeats)
    plan = [(r["_pattern"], int(f // r["size"]) if r["size"] else 0, int(f % r["size"]) if r["size"] else 0, max(1, math.ceil(r["n"] / BUCKET_ROWS))) for r, f in zip(patterns, flow, strict=True)]
    plan_df = spark.createDataFrame(plan, "_pattern string, _copies long, _rest long, _buckets long")

    dealt = keyed.join(F.broadcast(plan_df), "_pattern")  # MAX_PATTERNS short rows at most
    dealt = dealt.withColumn("_order", F.xxhash64(F.lit(seed), order_col)).withColumn("_bucket", F.pmod(F.col("_order"), F.col("_buckets")))
    dealt = dealt.withColumn("_span", F.floor(F.col("_bucket") / F.ceil(F.col("_buckets") / SPANS)))
    # Rounds: of the buckets after the last edge, the documents that fit into what is left by themselves go whole
    # up to the bucket where their sum does not fit; of that one, the edge, every document that still fits. What
    # is left then is less than any document passed over, so the rounds are few; buckets only advance.
    state = [(r[0], -1, r[2]) for r in plan if r[2] > 0]
    ranges, filled = [], spark.createDataFrame([], dealt.select("_row", F.lit(1).alias("_extra")).schema)
    while state:
        now = F.broadcast(spark.createDataFrame(state, "_pattern string, _from long, _left long"))  # MAX_PATTERNS short rows at most
        fits = dealt.select("_pattern", "_span", "_bucket", "_row", "_order", "_size").join(now, "_pattern").where("_bucket > _from and _size > 0 and _size <= _left")
        buckets = written(fits.groupBy("_pattern", "_span", "_bucket").agg(F.sum("_size").alias("_sum"), F.first("_left").alias("_left")), "buckets")
        # The edge's span first, then the edge within it: no task sees all buckets of a pattern.
        spans = _edges(buckets.groupBy("_pattern", "_span").agg(F.sum("_sum").alias("_sum"), F.first("_left").alias("_left")), "_span")
        edges = _edges(buckets.drop("_left").join(F.broadcast(spans), ["_pattern", "_span"]), "_bucket")  # MAX_PATTERNS short rows at most
        edge = {r["_pattern"]: (r["_bucket"], r["_left"]) for r in edges.collect()}
        ranges += [(p, start, edge[p][0] if p in edge else 1 << 62, left) for p, start, left in state]
        at = [(p, k, room) for p, (k, room) in sorted(edge.items()) if room > 0]
        if not at:
            break
        last = F.broadcast(spark.createDataFrame(at, "_pattern string, _bucket long, _left long"))
        rows = fits.drop("_left", "_span").join(last, ["_pattern", "_bucket"]).groupBy("_pattern").applyInPandas(_fill, "_pattern string, _row long, _size long, _extra long")  # a bucket of each pattern
        rows = written(rows, "filled").where("_extra > 0")
        filled = filled.unionByName(rows.select("_row", F.col("_extra").cast("int").alias("_extra")))
        used = {r["_pattern"]: r["n"] for r in rows.groupBy("_pattern").agg(F.sum("_size").alias("n")).collect()}
        state = [(p, k, room - used.get(p, 0)) for p, k, room in at if room > used.get(p, 0)]
    passed = spark.createDataFrame(ranges, "_of string, _from long, _to long, _most long").withColumn("_all", F.lit(1))
    within = (F.col("_pattern") == F.col("_of")) & (F.col("_bucket") > F.col("_from")) & (F.col("_bucket") < F.col("_to")) & (F.col("_size") <= F.col("_most"))
    return (
        dealt.join(F.broadcast(passed), within, "left")  # a range at most for each document; MAX_PATTERNS short rows a round
        .join(filled, "_row", "left")
        .withColumn("taken", F.col("_size") * (F.col("_copies") + F.coalesce("_all", "_extra", F.lit(0))))
        .drop("_pattern", "_copies", "_rest", "_buckets", "_order", "_bucket", "_span", "_of", "_from", "_to", "_most", "_all", "_extra")
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 7) -> DataFrame:
    """Mix with one source to a document: ``id, source, size, source_size, target, taken``, one row for each row.

    Size is the number of words (null text: 0). Sources by code point, null last, get ``weights`` in turn and
    share ``share`` times all words; no target exceeds ``cap`` times its source. Rows that repeat an id are
    rows of their own, and of equal rows any one may be taken; ids may be of any type. An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"))
    # Number the rows once, in a written table, so that a task that runs again sees the same numbers.
    sized = written(sized.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    repeated = sized.groupBy("_id").count().where("count > 1").limit(1).count() or sized.where("_id is null").limit(1).count()
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    totals.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes = [int(r["n"]) for r in totals]
    goals = share_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), cap)
    table = sized.sparkSession.createDataFrame([(r["_source"], i, sizes[i], goals[i]) for i, r in enumerate(totals)], "_name string, _index long, source_size long, target double")
    placed = sized.join(F.broadcast(table), F.col("_source").eqNullSafe(F.col("_name")))  # MAX_PATTERNS rows at most
    mixed = mix(placed.withColumn("_members", F.array("_index")), "_members", dict(enumerate(goals)), cap, seed, "_row" if repeated else "_id")  # ids are independent of the files' order
    return mixed.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), "source_size", "target", "taken")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
