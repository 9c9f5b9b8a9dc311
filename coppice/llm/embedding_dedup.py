"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors are one class. Each table hashes a class's vector to the signs of ``bits`` random projections.

1. Ids, keys and a sketch of ``SKETCH`` further signs are dealt by bucket. Tasks compare the sketches of a
   bucket in blocks and name those that some other one may be similar to: a pair at the threshold itself
   fails with a chance of less than 1e-6, farther pairs mostly fail.
2. Only for those is the vector sent to the bucket's tasks and compared in double precision. A pair counts in
   the first table in which its signs agree, so it counts once.

A bucket of more than ``block`` classes is dealt over tasks by pairs of blocks, which does not drop any pair.
Tasks return sums by class and a spanning forest of the links found, not the pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import column, forget, list_array, tune, written
from coppice.llm.components import connected_components

THRESHOLD = 0.9
#: Share of the pairs at the threshold itself that some table must bring together.
RECALL = 0.995
#: Vectors to a bucket that the number of bits aims at, and to a block of a larger bucket.
BUCKET, BLOCK = 1024, 2048
#: Signs of a sketch, and standard deviations beyond the expected difference at the threshold that may pass.
SKETCH, SIGMAS = 256, 5
SEED = 11


def table_shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a table (the more vectors, the more) and tables (as many as the recall then takes)."""
    bits = min(30, max(4, math.ceil(math.log2(max(2, n / bucket)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def most_different(threshold: float) -> int:
    """Signs of two sketches that may differ."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return min(SKETCH, math.ceil(SKETCH * p + SIGMAS * math.sqrt(SKETCH * p * (1 - p))))


@functools.lru_cache(maxsize=8)
def planes(seed: int, dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, count))


def _usable(values: list | None) -> np.ndarray | None:
    if not values or any(v is None for v in values):
        return None
    x = np.asarray(values, dtype=np.float64)
    top = np.abs(x).max(initial=0)
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top  # the square of a very large component would overflow
    return x / np.linalg.norm(x)


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_block(x: np.ndarray, keys: np.ndarray, table: int, weight: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links between rows ``left`` and ``right`` of x that no table before ``table`` finds: linked weight by row, and a forest."""
    degree, forest, parent = np.zeros(len(x)), [], np.arange(len(x))
    for lo in range(0, len(left), 512):
        rows = left[lo : lo + 512]
        i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
        i, j = rows[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        first = np.ones(len(i), dtype=bool)
        for t in range(table):
            first &= keys[i, t] != keys[j, t]
        i, j = i[first], j[first]
        degree += np.bincount(i, weight[j], minlength=len(x)) + np.bincount(j, weight[i], minlength=len(x))
        for a, b in zip(i, j, strict=True):
            ra, rb = _find(parent, a), _find(parent, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                forest.append((a, b))
    return degree.astype(np.int64), forest


def near_pairs(sketch: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, most: int) -> np.ndarray:
    """Rows that differ from some other one, of the other block if there are two, in ``most`` signs or fewer."""
    near = np.zeros(len(sketch), dtype=bool)
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        differ = np.zeros((len(rows), len(right)), dtype=np.int32)
        for w in range(sketch.shape[1]):
            differ += np.bitwise_count(sketch[rows, w][:, None] ^ sketch[right, w][None, :])
        close = differ <= most
        if same:
            close &= rows[:, None] != right[None, :]
        near[rows] |= close.any(1)
        near[right] |= close.any(0)
    return near


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``id, n_links, component_id, kept``: one row for each row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
    different lengths do not link. Ids are long. Each row is a vector of its own: rows that share an id count
    each, and a component's id is the least of its rows. A null id links with nothing and is its own component
    (null). Other columns are not looked at; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(column(id_col).cast("long").alias("_id"), column(vector_col).alias("_v"))
    usable = F.col("_id").isNotNull() & (F.size("_v") > 0)
    n = rows.where(usable).count()
    bits, tables = table_shape(n, threshold, recall)
    words = SKETCH // 64

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_dim: dict[int, tuple[list, list]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (u := _usable(v)) is not None:
                    own = by_dim.setdefault(len(u), ([], []))
                    own[0].append(i)
                    own[1].append(u)
            for dim, (ids, unit) in by_dim.items():
                x = np.array(unit)
                signs = x @ planes(seed, dim, tables * bits + SKETCH) > 0
                keys = (signs[:, : tables * bits].reshape(len(ids), tables, bits) * (1 << np.arange(bits))).sum(2)
                sketch = np.packbits(signs[:, tables * bits :], axis=1).view(np.int64)
                equal = [xxhash.xxh3_128_digest(u.tobytes()) for u in unit]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, type=pa.int64()), pa.array(equal, type=pa.binary()), pa.array(np.full(len(ids), dim)), list_array(x.ravel(), np.full(len(ids), dim), pa.float64()),
                        list_array(keys.ravel(), np.full(len(ids), tables), pa.int32()), *(pa.array(np.ascontiguousarray(sketch[:, w])) for w in range(words)),
                    ],
                    names=["_id", "_equal", "_dim", "_x", "_keys", *sketches],
                )

    sketches = [f"_s{w}" for w in range(words)]
    schema = f"_id long, _equal binary, _dim long, _x array<double>, _keys array<int>, {', '.join(f'{c} long' for c in sketches)}"
    signed = written(rows.where(usable).mapInArrow(sign, schema), "signed")
    # A class of equal vectors: how many there are and the least id; a very common vector combines before the shuffle.
    classes = signed.groupBy("_equal", "_dim").agg(F.min("_id").alias("_least"), F.count("*").alias("_count"), F.first("_x").alias("_x"), F.first("_keys").alias("_keys"), *(F.first(c).alias(c) for c in sketches))
    classes = written(classes.withColumn("_item", F.monotonically_increasing_id()), "classes")

    entries = classes.select("_item", "_dim", *sketches, F.posexplode("_keys").alias("_table", "_key"))
    bucket = ["_dim", "_table", "_key"]
    counts = entries.groupBy(*bucket).count().where("count > 1").withColumn("_blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
    # Block i of a bucket meets itself and all others: a row for each, two of them in each pair's task.
    dealt = entries.join(counts, bucket).withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "_item"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    task = [*bucket, "_lo", "_hi"]
    dealt = dealt.select("_item", *sketches, *bucket, "_b", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"))
    most = most_different(threshold)

    def near(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[3:]
        b = pdf["_b"].to_numpy()
        hit = near_pairs(pdf[sketches].to_numpy().view(np.uint64), np.flatnonzero(b == lo), np.flatnonzero(b == hi), lo == hi, most)
        return pdf.loc[hit, ["_item", *task, "_b"]]

    places = written(dealt.groupBy(*task).applyInPandas(near, "_item long, _dim long, _table int, _key int, _lo int, _hi int, _b int"), "places")
    placed = places.join(classes.select("_item", F.col("_count").alias("_weight"), "_x", "_keys"), "_item")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table, lo, hi = key[1], key[3], key[4]
        ids, weight = pdf["_item"].to_numpy(), pdf["_weight"].to_numpy()
        x, keys, b = np.stack(pdf["_x"].to_numpy()), np.stack(pdf["_keys"].to_numpy()), pdf["_b"].to_numpy()
        degree, forest = link_block(x, keys, int(table), weight, np.flatnonzero(b == lo), np.flatnonzero(b == hi), lo == hi, threshold)
        at = np.flatnonzero(degree)
        return pd.DataFrame({"_a": np.concatenate([ids[at], ids[[i for i, _ in forest]]]).astype(np.int64), "_to": np.concatenate([ids[at], ids[[j for _, j in forest]]]).astype(np.int64), "_n": np.concatenate([degree[at], np.zeros(len(forest), dtype=np.int64)])})

    found = written(placed.groupBy(*task).applyInPandas(compare, "_a long, _to long, _n long"), "links")
    forget(places)
    degrees = found.where("_n > 0").groupBy("_a").agg(F.sum("_n").alias("_links"))
    parts = connected_components(found.where("_n = 0"), "_a", "_to")
    # The least id of a component of classes.
    named = classes.select("_item", "_equal", "_dim", "_least", "_count").join(parts, F.col("_item") == F.col("node"), "left").withColumn("_comp", F.coalesce("component", "_item"))
    least = named.groupBy("_comp").agg(F.min("_least").alias("_component"))
    named = named.join(least, "_comp").join(degrees, F.col("_item") == F.col("_a"), "left")
    # Equal vectors link with each other, too (below a threshold of 1 and a little).
    own = F.col("_count") - 1 if threshold <= 1 - 1e-12 else F.lit(0)
    named = written(named.select("_equal", "_dim", "_component", (F.coalesce("_links", F.lit(0)) + own).alias("_links")), "named")
    forget(classes, found)
    linked = signed.select("_id", "_equal", "_dim").join(named, ["_equal", "_dim"]).select("_id", "_links", "_component")
    # Rows that have no vector to compare are those that did not come back; rows of one id are told apart by their vector.
    rest = rows.where(~usable | ~_comparable(F.col("_v"))).select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_component"))
    out = linked.unionByName(rest)
    return out.select(F.col("_id").alias(id_col), F.col("_links").cast("long").alias("n_links"), F.col("_component").alias("component_id"), F.coalesce(F.col("_component") == F.col("_id"), F.lit(True)).alias("kept"))


def _comparable(v: Column) -> Column:
    """Whether ``_usable`` takes a vector, which is not empty."""
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
