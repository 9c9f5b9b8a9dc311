"""Centroid clustering: Lloyd's rounds in exact integers, with Yinyang's group filters.

The starting centroids are dealt into groups once. Each vector carries an upper bound of its distance to its own
centroid and one lower bound for each group, of its distance to the group's other centroids:

1. After an update the bounds move by the centroids' drifts. A vector whose upper bound lies below all its lower
   bounds stays (global filter), before and after its upper bound is made exact.
2. Otherwise only groups whose lower bound does not exceed the upper bound are looked at (group filter), in them
   only centroids that the group's old bound and their own drift do not rule out, and those exactly.

Bounds are doubles rounded outwards and compared strictly, so a tie is always looked at; distances are integers.
The state is a table that each round reads and writes in place of partitions: vectors are never shuffled. Sums
change by the vectors that moved alone, added up by partial aggregates; the driver holds k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import column, forget, list_array, tune, written

CENTROIDS, ROUNDS, DIM, SCALE = 40, 5, 64, 256
#: Centroids to a group.
GROUP = 10
#: Largest component for which a squared distance is a long; distances up to FLOAT are exact as doubles.
MOST, FLOAT = 1 << 27, 1 << 22
#: Numbers of a task's table of distances.
TABLE = 1 << 21
UP, DOWN = 1 + 1e-12, 1 - 1e-12


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, as long; raises beyond ``MOST``."""
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    inside = lambda x: F.abs(x.cast("double")) <= MOST / scale
    return F.when(F.forall(vector, inside), F.transform(vector, whole)).otherwise(F.raise_error(F.lit(f"a component exceeds {MOST / scale}")).cast("array<bigint>"))


def whole_vector(vector: Column) -> Column:
    """Not null, and without a null or non-finite component."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids (int64)."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), dtype=np.int64)
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= FLOAT:
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(1)[:, None] + (g * g).sum(1)[None, :] - 2 * (f @ g.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), dtype=np.int64)
    for j, own in enumerate(c):
        out[:, j] = ((x - own) ** 2).sum(1)
    return out


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: nearest of ``groups`` means of centroids, empty groups dropped."""
    means = centroids[:groups].astype(np.float64)
    own = np.zeros(len(centroids), dtype=np.int64)
    for _ in range(rounds):
        own = ((centroids[:, None, :] - means[None, :, :]) ** 2.0).sum(2).argmin(1)
        for g in np.unique(own):
            means[g] = centroids[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


def first_assignment(x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper bound and lower bounds by group, all centroids looked at."""
    d = squared(x, centroids)
    own = d.argmin(1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, own].astype(np.float64)) * UP
    far = np.sqrt(d.astype(np.float64)) * DOWN
    far[rows, own] = np.inf
    lower = np.stack([far[:, group == g].min(1) for g in range(group.max() + 1)], axis=1)
    return own, upper, lower


def next_assignment(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, group: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The assignment to moved centroids; also the number of exact distances that the filters left."""
    old, own, exact = lower, own.copy(), 0
    upper = (upper + drift[own] * UP) * UP
    most = np.array([drift[group == g].max() for g in range(group.max() + 1)])
    lower = np.maximum(old - most * UP, 0) * DOWN
    rows = np.flatnonzero(upper >= lower.min(1))
    if not len(rows):
        return own, upper, lower, exact
    d = ((x[rows] - centroids[own[rows]]) ** 2).sum(1)
    exact += len(rows)
    upper[rows] = np.sqrt(d.astype(np.float64)) * UP
    left = upper[rows] >= lower[rows].min(1)
    rows, d = rows[left], d[left]
    # Of the rows left: the least distance so far with its centroid, and what is known of each centroid looked at.
    start, best, best_d = own[rows], own[rows].copy(), d.copy()
    for g in range(group.max() + 1):
        at = np.flatnonzero(lower[rows, g] <= upper[rows])
        if not len(at):
            continue
        members = np.flatnonzero(group == g)
        known = np.full((len(at), len(members)), np.inf)
        for m, c in enumerate(members):
            bound = np.maximum(old[rows[at], g] - drift[c] * UP, 0) * DOWN
            is_own = start[at] == c
            near = (bound <= upper[rows[at]]) & ~is_own
            known[:, m] = np.where(is_own, np.sqrt(d[at].astype(np.float64)) * DOWN, bound)
            i = at[near]
            dc = squared(x[rows[i]], centroids[c : c + 1])[:, 0]
            exact += len(i)
            known[near, m] = np.sqrt(dc.astype(np.float64)) * DOWN
            better = (dc < best_d[i]) | (dc == best_d[i]) & (c < best[i])
            best[i[better]], best_d[i[better]] = c, dc[better]
        known[start[at][:, None] == members[None, :]] = np.inf
        lower[rows[at], g] = known.min(1)
    moved = best != start
    i = rows[moved]
    # The centroid left behind counts in its group again; the new one's group keeps a bound that is low enough.
    lower[i, group[start[moved]]] = np.minimum(lower[i, group[start[moved]]], np.sqrt(d[moved].astype(np.float64)) * DOWN)
    own[rows] = best
    upper[rows] = np.sqrt(best_d.astype(np.float64)) * UP
    return own, upper, lower, exact


def _floor_means(sums: dict[int, tuple[int, list[int]]], before: np.ndarray) -> np.ndarray:
    out = before.copy()
    for c, (n, total) in sums.items():
        if n:
            out[c] = [t // n for t in total]
    return out


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, width)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 2) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row for each vector kept.

    Kept are vectors of ``dim`` components, none null or non-finite; each row that repeats is a vector of its own.
    Start: the ``k`` rows of the least sha256 of ``seed:id`` (all, if there are fewer), equal hashes by their
    vectors; rows of a null id are clustered but never start. No vector kept, or none with an id, gives an empty
    result. Other columns are not looked at. Components beyond 2**27 after scaling raise. Distances are exact.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(column(id_col).cast("long").alias("_id"), column(vector_col).alias("_e")).where(whole_vector(F.col("_e")) & (F.size("_e") == dim))
    rows = written(rows.select("_id", quantised(F.col("_e"), scale).alias("_v")), "vectors")
    first = rows.where("_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256).alias("h"), "_v").orderBy("h", "_v").limit(k).collect()  # k rows
    out_schema = f"{_quoted(id_col)} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out_schema)
    centroids = np.array([r["_v"] for r in first], dtype=np.int64).reshape(len(first), dim)
    k = len(centroids)
    group = grouped(centroids, max(1, k // GROUP))
    groups = int(group.max()) + 1
    state_schema = "_id long, _v array<bigint>, _from int, _own int, _upper double, _lower array<double>"
    step = max(1, TABLE // k)

    def assign(drift: np.ndarray | None, centroids: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, step):
                    b = whole.slice(lo, step)
                    x = _matrix(b, "_v", dim)
                    if drift is None:
                        before = np.full(len(x), -1)
                        own, upper, lower = first_assignment(x, centroids, group)
                    else:
                        before = b.column(b.schema.get_field_index("_own")).to_numpy()
                        upper = b.column(b.schema.get_field_index("_upper")).to_numpy()
                        own, upper, lower, _ = next_assignment(x, before, upper, _matrix(b, "_lower", groups), centroids, group, drift)
                    at = b.schema.get_field_index
                    yield pa.RecordBatch.from_arrays(
                        [b.column(at("_id")), b.column(at("_v")), pa.array(before, type=pa.int32()), pa.array(own, type=pa.int32()), pa.array(upper), list_array(lower.ravel(), np.full(len(x), groups), pa.float64())],
                        names=["_id", "_v", "_from", "_own", "_upper", "_lower"],
                    )

        return work

    state = written(rows.mapInArrow(assign(None, centroids), state_schema), "assigned")
    forget(rows)
    sums: dict[int, tuple[int, list[int]]] = {}
    for _ in range(rounds):
        # What each vector that moved takes from its old cluster and adds to its new one: at most k rows come back.
        moved = state.where("_from != _own").select(F.explode(F.array(F.struct(F.col("_own").alias("c"), F.lit(1).alias("s")), F.struct(F.col("_from").alias("c"), F.lit(-1).alias("s")))).alias("m"), "_v").select("m.c", "m.s", "_v").where("c >= 0")
        parts = moved.groupBy("c").agg(F.sum("s").alias("n"), *(F.sum(F.col("s") * F.get("_v", F.lit(i))).alias(f"x{i}") for i in range(dim)))
        for r in parts.collect():
            n, total = sums.get(r["c"], (0, [0] * dim))
            sums[r["c"]] = (n + r["n"], [t + r[f"x{i}"] for i, t in enumerate(total)])
        old, centroids = centroids, _floor_means(sums, centroids)
        drift = np.sqrt(((centroids - old) ** 2).sum(1).astype(np.float64)) * UP
        last, state = state, written(state.mapInArrow(assign(drift, centroids), state_schema), "assigned")
        forget(last)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1).to_numpy()
            d = ((_matrix(b, "_v", dim) - centroids[own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], names=["_id", "_own", "_d"])

    done = written(state.select("_id", "_own", "_v").mapInArrow(measure, "_id long, _own int, _d long"), "distances")
    forget(state)
    inertia = {r["_own"]: r["s"] for r in done.groupBy("_own").agg(F.sum("_d").alias("s")).collect()}  # k rows
    total = sum(inertia.values())
    named = [(c, s, total, hashlib.sha256(",".join(str(int(x)) for x in centroids[c]).encode()).hexdigest()) for c, s in inertia.items()]
    table = spark.createDataFrame(named, "_own int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(table), "_own").select(F.col("_id").alias(id_col), F.col("_own").alias("cluster"), F.col("_d").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql(rounds: int) -> str:
    out = []
    for t in range(rounds + 1):
        out.append(f"d{t} AS MATERIALIZED (SELECT x.r, y.j, sum((x.q - y.q) * (x.q - y.q))::BIGINT AS d FROM x JOIN c{t} y USING (i) GROUP BY ALL)")
        out.append(f"a{t} AS MATERIALIZED (SELECT r, d, j FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)")
        if t < rounds:
            out.append(f"s{t} AS (SELECT a.j, x.i, sum(x.q)::BIGINT AS s, count(*) AS n FROM a{t} a JOIN x USING (r) GROUP BY ALL)")
            out.append(f"c{t + 1} AS MATERIALIZED (SELECT c.j, c.i, CASE WHEN s.n IS NULL THEN c.q ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS q FROM c{t} c LEFT JOIN s{t} s USING (j, i))")
    return ",\n".join(out)


SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, [floor({SCALE} * e::DOUBLE)::BIGINT FOR e IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len([1 FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
x AS MATERIALIZED (SELECT r, unnest(range({DIM})) AS i, unnest(v) AS q FROM kept),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j FROM kept QUALIFY j < {CENTROIDS}),
c0 AS (SELECT f.j, x.i, x.q FROM first f JOIN x USING (r)),
{_rounds_sql(ROUNDS)},
h AS (SELECT j, sha256(string_agg(q::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY j)
SELECT k.vec_id, a.j::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a{ROUNDS} a JOIN kept k USING (r) JOIN h USING (j)
"""
