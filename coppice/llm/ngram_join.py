"""N-gram Jaccard join of documents by the grouped prefix join.

Shingles are ordered by the count of their rarest word: one that holds a rare word is hardly ever in two
documents by chance, and the words of a passage that many share are not rare. (Counts of shingles would
need a table as large as the corpus to tell one from a few.) Documents of the same shingle set are one class. Classes with the same prefix and size are one group, and
only groups are dealt by their prefixes; groups that may be similar are expanded to their members, whose
whole sets are compared exactly. See ``setjoin`` for the filters and for how hot shingles are split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm import setjoin as S
from coppice.llm.common import FEW_ROWS, column, flagged, forget, list_array, tune, written
from coppice.llm.components import connected_components

#: Bits of the table of word counts, and of a shingle's hash.
BITS, HASH_BITS = 18, 48
LONGS = ("_d1", "_d2", *S.BITMAPS)
#: As ``LONGS``, of sets that may be large.
WIDE_LONGS = ("_d1", "_d2", *S.bitmap_columns(S.ALL_BANDS))
DIGEST = ["_d1", "_d2"]
#: Stands for a null id, and sorts before all others.
NO_ID = -(1 << 63)


def id_or_least(id_col: str) -> Column:
    return F.coalesce(column(id_col).cast("long"), F.lit(NO_ID))


def shingles(texts: list[bytes | None], k: int, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Hashes of all k-word shingles, text after text, the classes of their rarest words, and each text's number.

    A text of fewer words is one shingle.
    """
    flat, sizes = S.words_of_texts(texts)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    first = np.repeat(S.starts_of(sizes) - S.starts_of(counts), counts) + np.arange(int(counts.sum()))
    length = np.repeat(np.minimum(sizes, k), counts)
    h = length.astype(np.uint64)
    known = classes[(flat & np.uint64(len(classes) - 1)).astype(np.int64)] if classes is not None else None
    rarest = np.full(len(h), 255, dtype=np.uint8) if classes is not None else None
    for i in range(k if len(flat) else 0):
        inside = length > i
        at = np.where(inside, first + i, 0)
        h = np.where(inside, S.mixed(h * S._M1 + flat[at]), h)
        if known is not None:
            rarest = np.where(inside, np.minimum(rarest, known[at]), rarest)
    return h, rarest, counts


def shingle_sets(texts: list[bytes | None], k: int, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's set of shingles, the rarest first, as codes and as hashes, and its size."""
    h, rarest, counts = shingles(texts, k, classes)
    return S.ordered_sets(counts, h, rarest, HASH_BITS)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``id, n_shingles, component_id``: one row for each row.

    Texts link when den * intersection >= num * union of their sets of k-word shingles (A-Z in lower case; a
    text of fewer words is one shingle; without words or null it links with nothing). The component is the
    smallest id reachable by links. Rows may repeat, ids too: each row is a document. A null id counts as the
    smallest of all. Other columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark, FEW_ROWS)
    rows = docs.select(id_or_least(id_col).alias("_doc"), column(text_col).alias("_text"))
    table = spark.sparkContext.broadcast(S.rarity(S.word_counts(rows, "_text", BITS)))  # of fixed size

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, whole, sizes = shingle_sets(S.binary(batch.column(1)), k, table.value)
            prefix, lengths = S.prefixes(codes, sizes, num, den)
            words = [*(pa.array(d) for d in S.digests(whole, sizes)), *S.bitmaps(whole, sizes, num, den, S.ALL_BANDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *words, list_array(prefix.view(np.int64), lengths, pa.int64())], names=["_doc", "_n", *WIDE_LONGS, "_prefix"])

    signed = written(rows.mapInArrow(sign, f"_doc long, _n long, {', '.join(f'{c} long' for c in WIDE_LONGS)}, _prefix array<long>"), "shingle-prefixes", hashes=True)
    hashed = signed.withColumn("_g1", F.xxhash64("_prefix")).withColumn("_g2", F.xxhash64(F.lit(1), "_prefix"))
    group = ["_n", "_g1", "_g2"]
    classes = hashed.where("_n > 0").groupBy(*DIGEST).agg(F.min(F.struct("_doc", *group)).alias("_m")).select(*DIGEST, "_m.*")
    classes = written(classes.withColumn("_item", F.monotonically_increasing_id()), "classes")

    groups = classes.groupBy(*group).agg(F.min(F.struct("_item", *DIGEST, "_doc")).alias("_m"), F.count("*").alias("_c"))
    groups = written(groups.select(*group, F.col("_m._item").alias("_group"), *(F.col(f"_m.{c}") for c in (*DIGEST, "_doc")), "_c"), "groups")
    # Prefixes of one document of each group; rows that repeat it repeat its entries, which changes nothing.
    # Members of a group differ outside the prefix, so a group of several has no bitmap that holds for all: they
    # are compared by prefix and size alone.
    items = signed.select(*DIGEST, "_doc", *WIDE_LONGS[2:], "_prefix").join(groups.select(*DIGEST, "_doc", "_n", F.col("_group").alias("_item"), "_c"), [*DIGEST, "_doc"])
    free = (F.col("_c") > 1).cast("int").alias("_free")
    items = written(items.select("_item", "_n", "_prefix", *WIDE_LONGS[2:], free), "group-prefixes", hashes=True)
    comps = S.candidate_components(items, num, den, S.ALL_BANDS)
    placed = groups.join(comps, groups["_group"] == comps["_item"], "left").where("_comp is not null or _c > 1").select(*group, F.coalesce("_comp", "_group").alias("_comp"))
    members = written(classes.select("_item", "_doc", *DIGEST, *group).join(placed, group).select("_item", "_doc", *DIGEST, "_n", "_comp"), "members")
    wanted = written(members.join(S.block_plan(members), "_comp").select("_item", *DIGEST, "_comp", "_k", F.col("_doc").alias("_at")), "wanted")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, whole, sizes = shingle_sets(S.binary(batch.column(3)), k)
            d1, d2 = S.digests(whole, sizes)
            same = (batch.column(4).to_numpy() == d1) & (batch.column(5).to_numpy() == d2)  # rows may share an id
            take = pa.array(np.flatnonzero(same))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), list_array(whole[np.repeat(same, sizes)].view(np.int64), sizes[same], pa.int64())], names=["_item", "_comp", "_k", "_set"])

    few = flagged(rows, "_doc", wanted, "_at", "_maybe").where("_maybe")
    sets = few.join(wanted, F.col("_doc") == F.col("_at")).select("_item", "_comp", "_k", "_text", *DIGEST).mapInArrow(expand, "_item long, _comp long, _k int, _set array<long>")
    links = written(S.verified(sets, S.spanning_links(num, den), []), "links")
    forget(items, groups, members, wanted)
    tune(spark)
    parts = connected_components(links, "_left", "_right")
    labelled = classes.select("_item", "_doc", *DIGEST).join(parts, F.col("_item") == F.col("node"))
    least = labelled.groupBy("component").agg(F.min("_doc").alias("_least"))
    named = labelled.join(least, "component").select(*DIGEST, "_least").unionByName(
        classes.join(parts, F.col("_item") == F.col("node"), "left_anti").select(*DIGEST, F.col("_doc").alias("_least"))
    )
    out = signed.select("_doc", "_n", *DIGEST).join(named, DIGEST, "left")
    component = F.when(F.col("_n") > 0, F.col("_least")).otherwise(F.col("_doc"))
    null_out = lambda c: F.when(c != NO_ID, c)
    return out.select(null_out(F.col("_doc")).alias(id_col), F.col("_n").alias("n_shingles"), null_out(component).alias("component_id"))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
