"""A corpus pipeline: language ID, line dedup, near-duplicate removal, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and is the next
stage's docs. All but the last return the columns of ``documents``; extra columns of the input, whatever their
names, are kept as they are. Null ids, and rows that repeat, are documents of their own; null texts go in the
first stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import language_id, line_dedup, mixing, ngram_join, packing
from coppice.llm.common import column, written

#: A text that no language codes in fewer bits a byte is rejected: bytes alone take as many.
MOST_BITS = 8
#: Words to a shingle, and the least Jaccard similarity, of near-duplicates.
SHINGLE, NUM, DEN = 5, 80, 100


def _packed(docs: DataFrame) -> Column:
    """All columns as one, so that no name of an extra column meets one of a stage's own."""
    return F.struct(*(column(c) for c in docs.columns)).alias("_in")


def _unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns packed in ``_in``, but for those given anew."""
    return rows.select(*((new[c] if c in new else F.col("_in").getField(c)).alias(c) for c in columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (also null texts) or that no language codes shorter than bytes, and corrects ``lang``."""
    rows = docs.select(_packed(docs), F.col("text").alias("_text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = language_id.predict(rows, language_id.train(docs.select("doc_id", "text", "lang").where(~held)), "_text")
    kept = scored.where((F.col("lang_pred") != language_id.UNDECIDED) & (F.col("bits_per_byte") <= MOST_BITS))
    return _unpacked(kept, docs.columns, lang=F.col("lang_pred"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``_in, _row``: rows packed and numbered once, in a written table, so that a task that runs again sees the same numbers."""
    return written(docs.select(_packed(docs), F.monotonically_increasing_id().alias("_row")), "numbered")


def _identified(docs: DataFrame) -> DataFrame:
    """``_in, _row``: rows by their ids, so that nothing depends on the files' order; by numbers if ids are null or repeat."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return _numbered(docs)
    return docs.select(_packed(docs), F.col("doc_id").alias("_row"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that repeat one of a smaller id; a document that has lost lines and has only blank ones left goes."""
    rows = _identified(docs)
    lines = line_dedup.dedup_lines(rows.select("_row", F.col("_in")["text"].alias("text"), "_in"), id_col="_row")
    kept = lines.where((F.col("n_removed") == 0) | F.col("text").rlike(mixing.WORD))
    return _unpacked(kept, docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one of the smallest id stays, once if the row repeats.

    Similar: a Jaccard similarity of 0.8 or more of the sets of five-word shingles.
    """
    numbered = _numbered(docs)
    parts = ngram_join.similar_documents(numbered.select("_row", F.col("_in")["text"].alias("text")), id_col="_row", k=SHINGLE, num=NUM, den=DEN).select("_row", F.col("component_id").alias("_of"))
    joined = numbered.select("_row", F.col("_in")["doc_id"].alias("_id")).join(parts, "_row")
    # The row of the smallest id of a component; partial minima combine before the shuffle.
    stays = joined.groupBy("_of").agg(F.min(F.struct(F.col("_id").isNotNull(), F.col("_id"), F.col("_row"))).alias("_m")).select(F.col("_m")["_row"].alias("_row"))
    return _unpacked(numbered.join(stays, "_row", "left_semi"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    numbered = _identified(docs)
    mixed = mixing.mix_sources(numbered.select(F.col("_row").alias("_key"), F.col("_in")["text"].alias("text"), F.col("_in")["source"].alias("source")), id_col="_key")
    taken = mixed.where("taken > 0").select(F.col("_key").alias("_row"), (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    return _unpacked(numbered.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its ids and its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_ngrams),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the language model nor the packing; tests/llm holds the run against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
