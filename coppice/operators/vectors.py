"""Vector search: chunk texts, normalisation and exact top-k."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.functions.text import natural_key, trim_all
from coppice.operators.hierarchy import parent_chain

MOST_CHARS = 5000
#: Characters of a hit on the command line; rows to a block where a table of queries is searched.
COMMAND_CHARS, BLOCK = 280, 4096


def embed_text(nodes: DataFrame, hops: int = 3, most: int = MOST_CHARS) -> DataFrame:
    """Adds ``embed_text``: heading, up to ``hops`` parents and the content, without blank parts, cut at ``most``."""
    head = F.concat_ws(" ", F.concat_ws(" - ", "doc_no", "title"), F.concat(F.lit("["), F.col("type"), F.lit("]")))
    above = F.transform("chain", lambda c: F.concat_ws(" - ", c["doc_no"], c["title"]))
    text = F.array_join(F.filter(F.concat(F.array(head), above, F.array(F.coalesce("content", F.lit("")))), lambda x: F.trim(x) != ""), "\n")
    return parent_chain(nodes, hops).withColumn("embed_text", F.substring(text, 1, most)).drop("chain")


def in_chunk_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(natural_key(F.col("doc_no")), "ord")


def truncated(chunks: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    return chunks.agg(F.count_if(F.length("embed_text") >= most).alias("n"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def top_k(vectors: DataFrame, query: list[float] | Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """``key, score``: the ``k`` largest dot products, ties by key; each task keeps ``k`` rows."""
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    rows = vectors if where is None else vectors.where(where)
    return rows.select(*vectors.columns, dot(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def search(vectors: DataFrame, chunks: DataFrame, query: list[float], k: int = 10, type_: str | None = None, chars: int = 400) -> DataFrame:
    """Hits with score to four places, parent context and a snippet of ``chars`` characters; 1 to 50 of them."""
    if not 1 <= k <= 50:
        raise ValueError("k must lie between 1 and 50")
    joined = vectors if type_ is None else vectors.join(chunks.where(F.col("type") == type_).select("id"), "id", "left_semi")
    best = top_k(joined, query, k, "id")
    rows = best.select("id", "score").join(chunks, "id")
    up = chunks.select(F.col("id").alias("_p"), F.col("doc_no").alias("parent_doc_no"), F.col("title").alias("parent_title"))
    rows = rows.join(up, F.col("parent_id") == F.col("_p"), "left")
    return rows.orderBy(F.desc("score"), "id").select("id", F.round("score", 4).alias("score"), "doc_no", "title", "type", "parent_doc_no", "parent_title", F.substring("content", 1, chars).alias("snippet"))


def command_search(vectors: DataFrame, chunks: DataFrame, query: list[float], k: int = 8, full: bool = False, chars: int = COMMAND_CHARS) -> DataFrame:
    """Hits as the command line shows them: scores to three places, trimmed contents, cut after ``chars`` unless ``full``."""
    best = top_k(vectors, query, k, "id").select("id", F.col("score").alias("_score"))
    up = chunks.select(F.col("id").alias("_p"), F.col("doc_no").alias("parent_doc_no"), F.col("title").alias("parent_title"))
    rows = best.join(chunks, "id").join(up, F.col("parent_id") == F.col("_p"), "left")
    content = trim_all(F.coalesce("content", F.lit("")))
    snippet = content if full else F.concat(F.substring(content, 1, chars), F.when(F.length(content) > chars, "…").otherwise(""))
    return rows.orderBy(F.desc("_score"), "id").select("id", F.round("_score", 3).alias("score"), "doc_no", "title", "type", "parent_doc_no", "parent_title", snippet.alias("snippet"))


def top_k_of_each(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query, key, rank, score``: ``top_k`` for each row of a table of queries (``key, vector``), all in one job.

    Both sides are dealt into blocks of some ``block`` rows; a task has one block of each and keeps ``k`` rows of each
    query, so what is merged by query does not grow with the vectors. Rows without a vector or with a null component
    take no part; vectors of other lengths than a query's do not meet it. Query keys are distinct.
    """
    usable = F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull())
    rows = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_v")).where(usable)
    asked = queries.select(F.col(key).alias("_query"), F.col(vector).alias("_w")).where(F.col("_w").isNotNull() & F.forall("_w", lambda x: x.isNotNull()))
    n, m = (max(1, -(-df.count() // block)) for df in (rows, asked))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.withColumn("_q", F.pmod(F.xxhash64("_query"), F.lit(m)).cast("int")).withColumn("_r", every(n))
    right = rows.withColumn("_r", F.pmod(F.xxhash64("_key", "_v"), F.lit(n)).cast("int")).withColumn("_q", every(m))
    kinds = rows.schema["_key"].dataType.simpleString(), asked.schema["_query"].dataType.simpleString()

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        sizes = b["_v"].map(len).to_numpy()
        for size, own in a.groupby(a["_w"].map(len), sort=False):
            there = b[sizes == size]
            if not len(there):
                continue
            x, y, keys = np.array(own["_w"].tolist(), dtype=np.float64), np.array(there["_v"].tolist(), dtype=np.float64), there["_key"].to_numpy()
            for name, q in zip(own["_query"], x, strict=True):
                rough = y @ q
                slack = 1e-9 * (1 + np.abs(rough).max())
                at = np.flatnonzero(rough >= np.partition(rough, len(rough) - min(k, len(rough)))[len(rough) - min(k, len(rough))] - slack)
                score = (y[at] * q).sum(1)  # the same for equal vectors, wherever they lie
                top = np.lexsort((keys[at], -score))[:k]
                found.append(pd.DataFrame({"query": name, "key": keys[at][top], "score": score[top]}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "key": [], "score": []})

    found = left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInPandas(best, f"query {kinds[1]}, key {kinds[0]}, score double")
    w = W.partitionBy("query").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", F.col("key").alias(key), "rank", "score")


def unit(query: list[float]) -> list[float]:
    """A query's embedding at unit length; a zero vector stays as it is."""
    size = math.sqrt(sum(x * x for x in query))
    return [x / size for x in query] if size else list(query)


def check_vectors(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not of ``dim`` components."""
    return vectors.where(F.coalesce(F.size(vector), F.lit(-1)) != dim)
