"""Hard-negative mining: product quantisation whose residual norms bound each score, and an exact integer rerank.

Vectors become integers; rows of one label and vector are a class, of which only the first ids can be returned.

1. Codebooks of ``WIDTH`` components each are fit on a bounded sample. A class keeps a code and the norm of what the
   code leaves over, for each codebook.
2. Classes that hold an anchor are the query set. It meets all classes in blocks: a task has one block of each.
   A lookup table gives an anchor's score with every code; Cauchy-Schwarz on the residual norms bounds the rest.
3. First pass: same label. A class is scored exactly unless its upper bound lies below the least of the best lower
   bounds. Second pass: other labels, for the window of each positive score found; a class is scored exactly unless
   its bounds leave the window or its upper bound lies below the best lower bounds that surely lie in it.

The bounds are exact, so nothing is missed; a task returns at most a few rows for each anchor class and window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.llm.common import column, forget, tune, written
from coppice.llm.yinyang import quantised, squared, whole_vector

POSITIVES, NEGATIVES, SCALE = 5, 5, 256
#: A negative's score is at least NUM / DEN of the positive's.
NUM, DEN = 80, 100
#: Components to a codebook, its codes, the rows it is fit on and the rounds of the fit.
WIDTH, CODES, SAMPLE, FIT_ROUNDS = 2, 256, 4096, 4
#: Classes and anchor classes to a block, and anchors scored at once.
ROWS, ANCHORS, AT_ONCE = 8192, 1024, 32


def fit_codebooks(sample: np.ndarray, width: int = WIDTH, codes: int = CODES, rounds: int = FIT_ROUNDS, seed: int = 13) -> list[np.ndarray]:
    """Integer centroids of each run of ``width`` components (Lloyd's rounds from rows of the sample)."""
    rng, out = np.random.default_rng(seed), []
    for lo in range(0, sample.shape[1], width):
        x = sample[:, lo : lo + width]
        distinct = np.unique(x, axis=0)
        book = distinct[np.sort(rng.choice(len(distinct), min(codes, len(distinct)), replace=False))]
        for _ in range(rounds):
            own = squared(x, book).argmin(1)
            n = np.bincount(own, minlength=len(book))
            for j in range(book.shape[1]):
                book[:, j] = np.where(n > 0, np.rint(np.bincount(own, x[:, j], minlength=len(book)) / np.maximum(n, 1)), book[:, j])
        out.append(book)
    return out


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (uint8) and residual norms, rounded up (float32), by codebook."""
    codes = np.empty((len(x), len(books)), dtype=np.uint8)
    norms = np.empty((len(x), len(books)), dtype=np.float32)
    lo = 0
    for m, book in enumerate(books):
        part = x[:, lo : lo + book.shape[1]]
        lo += book.shape[1]
        for at in range(0, len(x), 4096):
            d = squared(part[at : at + 4096], book)
            own = d.argmin(1)
            codes[at : at + 4096, m] = own
            norms[at : at + 4096, m] = np.sqrt(d[np.arange(len(own)), own].astype(np.float64)) * (1 + 1e-6)
    return codes, norms


def plain_codebooks(dim: int, width: int = WIDTH) -> list[np.ndarray]:
    """One code, zero: all of a vector is its residual. For lengths that no codebook is fit for."""
    return [np.zeros((1, min(width, dim - lo)), dtype=np.int64) for lo in range(0, dim, width)]


def score_bounds(anchors: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (int64) of the inner products of anchors (rows) with coded vectors (columns)."""
    approx = np.zeros((codes.shape[0], len(anchors)), dtype=np.int64)
    sizes = np.empty((len(anchors), len(books)))
    lo = 0
    for m, book in enumerate(books):
        part = anchors[:, lo : lo + book.shape[1]]
        lo += book.shape[1]
        approx += (book @ part.T)[codes[:, m]]
        sizes[:, m] = np.sqrt((part.astype(np.float64) ** 2).sum(1))
    slack = np.ceil(norms.astype(np.float64) @ sizes.T * (1 + 1e-9) + 1).astype(np.int64)
    return (approx - slack).T, (approx + slack).T


def _best(score: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    return np.lexsort((first, -score))[:most]


def _floor_of_best(lower: np.ndarray, most: int) -> int:
    """What ``most`` of these lower bounds reach at least; no bound if there are fewer."""
    return int(np.partition(lower, len(lower) - most)[len(lower) - most]) if len(lower) >= most else np.iinfo(np.int64).min


def _block(pdf: pd.DataFrame) -> dict[int, tuple]:
    """Vectors and the other columns of a block, by length of the vectors."""
    out = {}
    for dim, own in pdf.groupby("_dim", sort=False):
        out[int(dim)] = (_numbers(own["_x"], "<i8"), own)
    return out


def _numbers(column: pd.Series, kind: str) -> np.ndarray:
    """A matrix of the rows' bytes."""
    data = b"".join(column)
    return np.frombuffer(data, dtype=kind).reshape(len(column), -1) if data else np.zeros((len(column), 0), dtype=kind)


def mine(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", is_anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, num: int = NUM, den: int = DEN, scale: int = SCALE, rows_block: int = ROWS, anchors_block: int = ANCHORS
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of each anchor and positive.

    Rows with a null id, label or vector, or a null or non-finite component take no part. ``is_anchor``: a condition
    on ``_id`` (ids divisible by 100 by default). Scores are inner products of ``floor(scale * x)``, higher first,
    then smaller ids; vectors of different lengths have none and do not meet. Rows that repeat id, label and vector
    are one; a row with the anchor's own id is not a positive of it. A negative's score times ``den`` lies between
    ``num`` and ``den`` times the positive's. An anchor without positives, or a positive without negatives, has no
    row. Ids and labels are longs. Other columns are not looked at; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    tune(spark)
    is_anchor = F.col("_id") % 100 == 0 if is_anchor is None else is_anchor
    most = positives + 1  # one of them may be the anchor itself
    keep = max(most, negatives)
    rows = vectors.select(column(id_col).cast("long").alias("_id"), column(label_col).cast("long").alias("_label"), column(vector_col).alias("_e"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & whole_vector(F.col("_e"))).select("_id", "_label", quantised(F.col("_e"), scale).alias("_v"))
    rows = rows.withColumn("_of", F.xxhash64("_label", "_v"))
    # The first ids of each class, a few from each task; a class's other ids come after these whatever their scores.
    ranked = rows.withColumn("_k", F.dense_rank().over(W.partitionBy("_of", "_label", "_v").orderBy("_id"))).where(F.col("_k") <= keep)
    classes = ranked.groupBy("_of", "_label", "_v").agg(F.sort_array(F.collect_set("_id")).alias("_ids"))
    classes = written(classes.withColumn("_class", F.monotonically_increasing_id()).withColumn("_dim", F.size("_v")), "classes")
    anchor_rows = rows.where(is_anchor).distinct()
    anchors = written(anchor_rows.join(classes.select("_class", "_of", "_label", "_v"), ["_of", "_label", "_v"]).select("_id", "_class"), "anchors")

    lengths = classes.groupBy("_dim").count().orderBy(F.desc("count"), "_dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    fit = lengths[0]["_dim"]
    sample = classes.where(F.col("_dim") == fit).orderBy("_of", "_class").select("_v").limit(SAMPLE).collect()  # a bounded sample
    books = fit_codebooks(np.array([r["_v"] for r in sample], dtype=np.int64).reshape(-1, fit)) if fit else []

    def code(batches):
        for b in batches:
            dims = b.column(b.schema.get_field_index("_dim")).to_numpy()
            flat = b.column(b.schema.get_field_index("_v")).flatten().to_numpy(zero_copy_only=False).astype("<i8")
            ends = np.cumsum(dims)
            x, codes, norms = [], [], []
            for d, end in zip(dims.tolist(), ends.tolist(), strict=True):
                x.append(flat[end - d : end])
            got: dict[int, tuple] = {}
            for d in set(dims.tolist()):
                own = [v for v in x if len(v) == d]
                got[d] = iter(zip(*encode(np.array(own, dtype=np.int64).reshape(len(own), d), books if d == fit else plain_codebooks(d)), strict=True))
            for d in dims.tolist():
                c, r = next(got[d])
                codes.append(c.tobytes())
                norms.append(r.astype("<f4").tobytes())
            at = b.schema.get_field_index
            first = pa.array([i[0] for i in b.column(at("_ids")).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(at("_class")), b.column(at("_label")), b.column(at("_dim")), first, pa.array([v.tobytes() for v in x], type=pa.binary()), pa.array(codes, type=pa.binary()), pa.array(norms, type=pa.binary())], names=["_class", "_label", "_dim", "_first", "_x", "_codes", "_norms"])

    coded = written(classes.mapInArrow(code, "_class long, _label long, _dim int, _first long, _x binary, _codes binary, _norms binary"), "coded")
    queries = written(coded.join(anchors.select("_class").distinct(), "_class", "left_semi").select("_class", "_label", "_dim", "_x"), "queries")
    counted = lambda df, size: max(1, -(-df.count() // size))
    row_blocks, anchor_blocks = counted(coded, rows_block), counted(queries, anchors_block)
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "_class"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    all_rows = coded.withColumn("_r", block(row_blocks, 1)).withColumn("_q", every(anchor_blocks))
    books_of = lambda d: books if d == fit else plain_codebooks(d)
    found_schema = "_query long, _ps long, _class long, _score long"

    def search(same: bool):
        def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            there = _block(right)
            for dim, (a, own) in _block(left).items():
                if dim not in there:
                    continue
                x, held = there[dim]
                codes, norms = _numbers(held["_codes"], "u1"), _numbers(held["_norms"], "<f4")
                label, first, cls = held["_label"].to_numpy(), held["_first"].to_numpy(), held["_class"].to_numpy()
                names, labels = own["_class"].to_numpy(), own["_label"].to_numpy()
                windows = [None] * len(own) if same else own["_windows"].tolist()
                for lo in range(0, len(own), AT_ONCE):
                    low, high = score_bounds(a[lo : lo + AT_ONCE], codes, norms, books_of(dim))
                    for i in range(len(low)):
                        q = lo + i
                        at = np.flatnonzero((label == labels[q]) == same)
                        l, h = low[i, at], high[i, at]
                        for ps in [None] if same else windows[q]:
                            if same:
                                pick, count = at[h >= _floor_of_best(l, most)], most
                            else:
                                # num * ps <= den * score <= den * ps
                                least = -(-num * int(ps) // den)
                                sure = l[(l >= least) & (h <= ps)]
                                pick, count = at[(h >= max(least, _floor_of_best(sure, negatives))) & (l <= ps)], negatives
                            score = x[pick] @ a[q]
                            if not same:
                                inside = (score >= least) & (score <= ps)
                                pick, score = pick[inside], score[inside]
                            top = _best(score, first[pick], count)
                            out += [(names[q], 0 if same else ps, c, s) for c, s in zip(cls[pick[top]].tolist(), score[top].tolist(), strict=True)]
            return pd.DataFrame(out, columns=["_query", "_ps", "_class", "_score"])

        return task

    def met(q: DataFrame, same: bool) -> DataFrame:
        q = q.withColumn("_q", block(anchor_blocks, 2)).withColumn("_r", every(row_blocks))
        found = q.groupBy("_q", "_r").cogroup(all_rows.groupBy("_q", "_r")).applyInPandas(search(same), found_schema)
        # Up to ``keep`` ids of each class; the best of a query by score and id.
        wide = found.join(classes.select("_class", "_ids"), "_class").select("_query", "_ps", "_score", F.explode("_ids").alias("_to"))
        best = W.partitionBy("_query", "_ps").orderBy(F.desc("_score"), "_to")
        top = wide.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= (most if same else negatives))
        return top.groupBy("_query", "_ps").agg(F.sort_array(F.collect_list(F.struct("_k", "_to", "_score"))).alias("_top"))

    near = written(met(queries, True), "positives")
    windows = near.select(F.col("_query").alias("_class"), F.array_distinct(F.col("_top._score")).alias("_windows"))
    far = met(queries.join(windows, "_class"), False)
    pairs = anchors.join(near.select(F.col("_query").alias("_class"), "_top"), "_class")
    pairs = pairs.select("_id", "_class", F.explode(F.slice(F.filter("_top", lambda t: t["_to"] != F.col("_id")), 1, positives)).alias("_p"))
    pairs = pairs.select("_id", "_class", F.col("_p._to").alias("_to"), F.col("_p._score").alias("_ps"))
    joined = pairs.join(far.withColumnRenamed("_query", "_class"), ["_class", "_ps"]).withColumn("_n", F.explode("_top"))
    out = written(joined.select(F.col("_id").alias("anchor_id"), F.col("_to").alias("positive_id"), F.col("_n._k").cast("int").alias("rank"), F.col("_n._to").alias("negative_id"), F.col("_ps").alias("positive_score"), F.col("_n._score").alias("negative_score")), "mined")
    forget(classes, anchors, coded, queries, near)
    return out


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


SQL = f"""
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * e::DOUBLE)::BIGINT FOR e IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {NUM} * p.positive_score <= {DEN} * s.score AND {DEN} * s.score <= {DEN} * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= {NEGATIVES}
"""
