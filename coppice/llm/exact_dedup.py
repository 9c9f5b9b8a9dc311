"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

1. Each distinct (64-bit key, digest) is an index entry with its largest id and its number of rows; equal
   texts combine before the shuffle, so a text that a third of all rows share is a few rows.
2. Entries are counted by a fixed number of key prefixes (at most ``2 ** MAX_DEPTH`` rows), and the directory
   doubles until no bucket holds more than ``capacity`` of them. A bucket that the deepest directory can't
   split keeps its entries as they are.
3. The directory's pointers deal the entries to buckets; each bucket is written by its owner task as a file of
   the shared folder, in key order, so entries of one key lie in a chain.
4. A row finds its entry by its key's slot, the slot's bucket and the chain there. Only texts whose chain
   says that they may repeat are read again; their bytes are compared by the owners of their bucket and key.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import column, flagged, forget, written

MAX_DEPTH = 16
CAPACITY = 1 << 16

NORMALISERS = {
    "none": lambda c: c,
    "case": F.lower,
    "space": lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")),
}


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def double_directory(cells: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[tuple[int, int, int]]]:
    """Global depth and one pointer (slot, bucket prefix, local depth) for each slot of the directory.

    cells: entries by ``max_depth``-bit prefix. Buckets start as one and split while overfull.
    """
    full: list[dict[int, int]] = [{} for _ in range(max_depth + 1)]
    full[max_depth] = cells
    for d in range(max_depth, 0, -1):
        for prefix, n in full[d].items():
            full[d - 1][prefix >> 1] = full[d - 1].get(prefix >> 1, 0) + n
    leaves, open_buckets = [], [(0, 0)]
    while open_buckets:
        prefix, depth = open_buckets.pop()
        if full[depth].get(prefix, 0) > capacity and depth < max_depth:
            open_buckets += [(prefix << 1, depth + 1), (prefix << 1 | 1, depth + 1)]
        else:
            leaves.append((prefix, depth))
    top = max(d for _, d in leaves)
    pointers = [(slot, prefix, depth) for prefix, depth in leaves for slot in range(prefix << (top - depth), (prefix + 1) << (top - depth))]
    return top, sorted(pointers)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: str = "none", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """Classes of equal texts: ``id, keep_id, group_size, kept, text_sha256``, one row for each input row.

    Texts are equal when identical after ``normalise`` (none, case or space), whatever their length; a null text
    counts as empty. The largest id of a class stays. Rows that repeat an id count as rows: each is returned,
    and all that carry the largest id are kept. Null ids sort below all others. Other columns are not looked at.
    An empty table gives an empty result. ``key_bits``: bits that a key keeps, the others are 0; fewer give long chains.
    """
    spark = docs.sparkSession
    text = NORMALISERS[normalise](F.coalesce(column(text_col), F.lit("")))
    key = F.shiftleft(F.shiftrightunsigned(F.xxhash64("_text"), 64 - key_bits), 64 - key_bits)
    rows = docs.select(column(id_col).alias("_id"), text.alias("_text")).withColumn("_key", key)
    probes = written(rows.select("_id", "_key", F.unhex(F.sha2("_text", 256)).alias("_digest")), "hash-probes")

    entries = written(probes.groupBy("_key", "_digest").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")), "hash-entries")
    cells = {r[0]: r[1] for r in entries.groupBy(_prefix(F.col("_key"), MAX_DEPTH).alias("_cell")).count().collect()}  # 2 ** MAX_DEPTH rows at most
    depth, pointers = double_directory(cells, capacity)
    table = json.dumps([{"_slot": s, "_bucket": b << 8 | d} for s, b, d in pointers])
    directory = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<_slot: bigint, _bucket: bigint>>"))))
    # A bucket's number holds its prefix and its local depth.
    find = lambda df: df.withColumn("_slot", _prefix(F.col("_key"), depth)).join(directory, "_slot").drop("_slot")
    index = find(entries).repartition("_bucket").sortWithinPartitions("_bucket", "_key", "_digest")
    index = written(index.select("_key", "_digest", "_keep", "_n", "_bucket"), "hash-index", by="_bucket")

    forget(entries)

    # Texts that occur once are done: only chains with an entry of several rows are looked at again.
    several = index.where("_n > 1").select("_bucket", "_key").distinct()
    again = find(flagged(rows, "_key", several, "_key", "_maybe").where("_maybe")).join(several, ["_bucket", "_key"], "left_semi")
    classes = written(
        again.groupBy("_bucket", "_key", "_text")  # the text is a grouping key: its bytes are compared
        .agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("_bucket", "_key", F.unhex(F.sha2("_text", 256)).alias("_digest"), "_keep", "_n"),
        "hash-classes",
    )
    forget(index)
    return find(probes).join(classes, ["_bucket", "_key", "_digest"], "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("_keep", "_id").alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_keep") == F.col("_id"), F.col("_keep").isNull()).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
