"""A stored inverted index: segments of sorted postings with their dictionary and lengths.

A batch of documents is one segment. Its postings are range-partitioned and sorted by (field, term, key), so a term
that very many documents hold lies in several files; ``bounds`` names the first and last term of each of them. A
search resolves its terms on the dictionary, then reads the files whose bounds hold one of them, and of those the row
groups. Counts and lengths are summed over segments, so scores are those of one index over all documents.

A segment counts once its row in ``segments`` is written, which is done last; ``merge`` replaces segments by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators.search import Query, Term, entries_of, postings
from coppice.sources.readers import or_empty

#: Bytes to a row group of postings, so that a file is read in part.
ROW_GROUP = 1 << 20
#: Terms of a wildcard or of edits that are looked up one by one; beyond, their range is read.
NAMED = 1000
#: Terms of the texts to a file of postings at most, in the mean, so that what a task sorts does not grow with the input.
TERMS = 1 << 21
#: Bytes that a term and what is behind it take in the mean, or more.
BYTES = 3


def _live(spark: SparkSession, path: str) -> list[int]:
    rows = or_empty(lambda: spark.read.parquet(f"{path}/segments"), "number int, replaces array<int>", spark).collect()  # a row for each batch
    gone = {n for r in rows for n in r["replaces"]}
    return sorted(r["number"] for r in rows if r["number"] not in gone)


def _write(path: str, table: str, number: int, df: DataFrame, by: list[str] | None = None) -> None:
    df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/{table}/segment={number}", partitionBy=by)


def _segment(spark: SparkSession, path: str, number: int, rows: DataFrame, n: list[tuple[str, int]], key: str, parts: int, replaces: list[int]) -> None:
    """n: documents of each field."""
    ranged = rows.select(key, "field", "term", "tf", "dl").repartitionByRange(parts, "field", "term", key)
    # A file hardly ever has two fields, so terms first: their beginnings tell most rows apart, which sorts faster.
    ranged = ranged.sortWithinPartitions("term", "field", key)
    _write(path, "postings", number, ranged.withColumn("part", F.spark_partition_id()), ["part"])
    # A term that several files hold is a row for each of them; readers add these up.
    held = spark.read.parquet(f"{path}/postings/segment={number}").groupBy("field", "term", "part").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    _write(path, "dictionary", number, held.sort("field", "term", "part"))
    words = spark.read.parquet(f"{path}/dictionary/segment={number}")
    entry = F.struct("field", "term")
    _write(path, "bounds", number, words.groupBy("part").agg(F.min(entry).alias("first"), F.max(entry).alias("last")))
    totals = {r["field"]: r["total"] for r in words.groupBy("field").agg(F.sum("tf").alias("total")).collect()}  # a row for each field
    _write(path, "stats", number, spark.createDataFrame([(f, d, totals.get(f, 0)) for f, d in n], "field string, n long, total long"))
    spark.createDataFrame([(number, replaces)], "number int, replaces array<int>").write.mode("append").parquet(f"{path}/segments")


def _files(spark: SparkSession, terms: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-terms // TERMS))


def add(docs: DataFrame, key: str, fields: list[str], path: str, parts: int | None = None) -> None:
    """A new segment of documents, none of which is in the index yet; the first one makes the index.

    A null field has no term. ``parts``: files that the postings are dealt to (if not given, as many as shuffles, and more for more than ``TERMS`` terms each).
    """
    spark = docs.sparkSession
    sizes = docs.agg(F.count("*"), *(F.sum(F.octet_length(F.col(f).cast("string"))) for f in fields)).first()
    numbers = or_empty(lambda: spark.read.parquet(f"{path}/segments"), "number int", spark).agg(F.max("number")).first()[0]
    parts = parts or _files(spark, sum(x or 0 for x in sizes[1:]) // BYTES)
    _segment(spark, path, 0 if numbers is None else numbers + 1, postings(docs, key, fields), [(f, sizes[0]) for f in fields], key, parts, [])


def merge(spark: SparkSession, path: str, key: str, parts: int | None = None) -> None:
    """All segments as one; no text is read. Searches that have begun still find the old files."""
    live = _live(spark, path)
    if len(live) > 1:
        index = Stored(spark, path, key, live)
        sums = index._table("stats").groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # a row for each field
        parts = parts or _files(spark, sum(r["total"] for r in sums))
        _segment(spark, path, max(live) + 1, index.postings, [(r["field"], r["n"]) for r in sums], key, parts, live)


def open_index(spark: SparkSession, path: str, key: str) -> Stored:
    return Stored(spark, path, key, _live(spark, path))


@dataclass
class Stored:
    """The live segments at one time; ``score`` and ``hits`` of a search take it for their index."""

    spark: SparkSession
    path: str
    key: str
    segments: list[int]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/segment={n}" for n in self.segments))

    @property
    def postings(self) -> DataFrame:
        return self._table("postings")

    @property
    def dictionary(self) -> DataFrame:
        return self._table("dictionary").groupBy("field", "term").agg(F.sum("df").alias("df"))

    @property
    def stats(self) -> DataFrame:
        return self._table("stats").groupBy("field").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl"))

    def near(self, text: str, edits: int) -> DataFrame:
        """``term``: those within so many edits, measured where their length allows it.

        Variants of all terms would be some 27 times as many rows as the dictionary, and longer to make than very many searches.
        """
        alike = self._table("dictionary").where(F.length("term").between(len(text) - edits, len(text) + edits))
        return alike.where(F.levenshtein("term", F.lit(text), edits) >= 0).select("term").distinct()

    def entries(self, query: Query) -> DataFrame:
        """Dictionary entries of the query's terms, as ``search.matching_terms`` gives them."""
        words = self._table("dictionary")

        def of(t: Term) -> DataFrame:
            if t.edits:
                found = words.join(self.near(t.text, t.edits), "term")
            else:
                found = words.where(F.col("term").startswith(t.text) if t.prefix else F.col("term") == t.text)
            return found.groupBy("field", "term").agg(F.sum("df").alias("df"))

        return entries_of(query, of, self.spark)

    def held(self, query: Query) -> DataFrame:
        """Postings of the query's terms and few others: files by their bounds, rows by what the scan can skip."""
        rows, ranges = F.lit(False), F.lit(False)
        for t in query.terms:
            hit, within = self._condition(t)
            if t.field:
                hit &= F.col("field") == t.field
                within &= (F.col("first.field") <= t.field) & (F.col("last.field") >= t.field)
            rows, ranges = rows | hit, ranges | within
        parts = self._table("bounds").where(ranges).select("segment", "part").collect()  # names of files
        wanted = F.lit(False)
        for n in {r["segment"] for r in parts}:
            wanted |= (F.col("segment") == n) & F.col("part").isin([r["part"] for r in parts if r["segment"] == n])
        return self.postings.where(wanted & rows).select(self.key, "field", "term", "tf", "dl")

    def _condition(self, t: Term) -> tuple[Column, Column]:
        """What a posting's term must be, and bounds (of one field or several) that may hold such a term."""
        several = F.col("first.field") < F.col("last.field")
        between = lambda lo, hi: several | (F.col("first.term") <= hi) & (F.col("last.term") >= lo)
        if t.prefix:
            return F.col("term").startswith(t.text), between(t.text, t.text + "\U0010ffff")
        if not t.edits:
            return F.col("term") == t.text, between(t.text, t.text)
        near = sorted(r[0] for r in self.near(t.text, t.edits).limit(NAMED + 1).collect())
        if not near:
            return F.lit(False), F.lit(False)
        if len(near) > NAMED:
            return F.lit(True), F.lit(True)
        within = F.lit(False)
        for term in near:
            within |= between(term, term)
        return F.col("term").isin(near), within
