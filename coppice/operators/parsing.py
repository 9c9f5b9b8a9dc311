"""Text to nodes: lines, headings, segments, heading parents and content cleanup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from coppice.functions.text import trim_all
from coppice.sources.scratch import settled

# Fixed value: the heading line.
HEADING = r"^(#{1,6}) ([A-Za-z0-9_.-]+) - (.+?) \[([^\]]+)\]\s+<!-- UUID: ([0-9a-f-]{36}) -->$"
MAX_DEPTH = 6

NODE = "id string, doc_no string, title string, type string, depth int, parent_id string, content string, ord int"


def lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, n, line``: the lines of each text in order, from 0."""
    return texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))


def headings(rows: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``is_heading`` and its parts ``depth, doc_no, title, type, id`` (null on other lines)."""
    c = F.col(line)
    hit = c.rlike(HEADING)
    part = lambda g: F.when(hit, F.regexp_extract(c, HEADING, g))
    return rows.select("*", hit.alias("is_heading"), F.length(part(1)).alias("depth"), part(2).alias("doc_no"), part(3).alias("title"), part(4).alias("type"), part(5).alias("id"))


def segments(rows: DataFrame, key: str, order: str = "n", line: str = "line", is_heading: str = "is_heading") -> DataFrame:
    """``key, seg, first, last, body``: a heading's lines up to the next one; lines before the first are dropped.

    Each ``key`` (a document, a revision) is cut on its own, so only one document's lines are ordered together.
    """
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = rows.withColumn("seg", F.sum(F.col(is_heading).cast("int")).over(w)).where("seg > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col(is_heading), F.struct(F.col(order).alias("o"), F.col(line).alias("t"))))), lambda x: x["t"]), "\n")
    return numbered.groupBy(key, "seg").agg(F.min(order).alias("first"), F.max(order).alias("last"), body.alias("body"))


def heading_parent(nodes: DataFrame, key: str | None = None) -> DataFrame:
    """Adds ``parent_id``: the nearest node before of depth - 1 with no shallower one between, else null."""
    by = [key] if key else []
    w = W.partitionBy(*by).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    candidates = []
    for d in range(2, MAX_DEPTH + 1):
        last = F.max(F.when(F.col("depth") <= d - 1, F.struct("ord", "depth", "id"))).over(w)
        candidates.append(F.when((F.col("depth") == d) & (last["depth"] == d - 1), last["id"]))
    return nodes.withColumn("parent_id", F.coalesce(*candidates))


def clean_lines(source: list[str]) -> str:
    """Blocks that a lone leading backtick opens become code fences; see FIXTURES.md for its quirks."""
    out: list[str] = []
    block: list[str] | None = None

    def flush() -> None:
        out.extend(["```", *block, "```"])

    for line in source:
        if block is not None:
            if line.endswith("`"):
                if line[:-1].strip():
                    block.append(line[:-1])
                flush()
                block = None
            else:
                block.append(line)
        elif not line.startswith("`"):
            out.append(line)
        elif len(line) > 1 and line.endswith("`"):
            out.append(line)
        else:
            block = [line[1:]] if line[1:].strip() else []
    if block:
        flush()
    return "\n".join(out).strip()


@F.pandas_udf(T.StringType())
def _clean(column: pd.Series) -> pd.Series:
    return column.map(lambda t: None if t is None else clean_lines(t.split("\n")))


def clean_content(nodes: DataFrame, column: str = "content") -> DataFrame:
    """Content with stray backtick blocks fenced and trimmed; texts without a line that starts so stay JVM-side."""
    c = F.col(column)
    return nodes.withColumn(column, F.when(c.rlike(r"(?m)^`"), _clean(c)).otherwise(trim_all(c)))


def parse(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Nodes of each document: heading fields, cleaned content, order and heading parent."""
    h = headings(lines(texts, key, text))
    bodies = segments(h, key)
    heads = h.where("is_heading").select(key, F.col("n").alias("first"), "id", "doc_no", "title", "type", "depth")
    nodes = heads.join(bodies, [key, "first"]).withColumn("ord", F.row_number().over(W.partitionBy(key).orderBy("first")) - 1)
    return clean_content(heading_parent(nodes.withColumnRenamed("body", "content"), key)).select(key, "id", "doc_no", "title", "type", "depth", "parent_id", "content", "ord")


def profile(nodes: DataFrame) -> DataFrame:
    """Counts by type, by depth, and of empty contents, as ``facet, value, n``."""
    by = lambda facet, c: nodes.groupBy(c.cast("string").alias("value")).count().select(F.lit(facet).alias("facet"), "value", F.col("count").alias("n"))
    empty = nodes.agg(F.count_if(F.coalesce("content", F.lit("")) == "").alias("n")).select(F.lit("empty").alias("facet"), F.lit("content").alias("value"), "n")
    return by("type", F.col("type")).unionByName(by("depth", F.col("depth"))).unionByName(empty)


def batches_of(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch``: rows in order, ``size`` to a batch, numbered over sorted partitions without one global task.

    The partitions are written once: counted and numbered in runs of their own, their bounds need not be the same.
    """
    spark = rows.sparkSession
    ranged = settled(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("lo")).collect()  # one row to a partition
    before, table = 0, []
    for r in sorted(counts, key=lambda r: r["_p"]):
        table.append((r["_p"], before - r["lo"]))
        before += r["n"]
    shift = spark.createDataFrame(table, "_p int, _shift long")
    return ranged.join(F.broadcast(shift), "_p").withColumn("batch", F.floor((F.col("_i") + F.col("_shift")) / size)).drop("_p", "_i", "_shift")


def iterate(df: DataFrame) -> Iterator:
    """Rows at the driver one partition at a time, for result pages and exports."""
    return df.toLocalIterator()


def parse_lines(rows: DataFrame, key: str, block: str = "block") -> DataFrame:
    """``parse`` of texts that are given as lines, so that one very large text is parsed by as many tasks as it has blocks.

    rows: ``key, block, n, line``; ``n`` orders a text's lines, and so do its blocks (numbers, or arrays and structs of
    such), each of which is one task. First each block is summed up as its number of headings and, for each depth, its
    last heading of that depth or less; these are combined over the blocks before; then lines are numbered and headings
    get parents within their block. A segment's content is one row, as everywhere.
    """
    h = headings(rows)
    head = F.struct("n", "depth", "id")
    last = [f"_last{d}" for d in range(1, MAX_DEPTH)]
    sums = h.groupBy(key, block).agg(F.count_if("is_heading").alias("_heads"), *(F.max(F.when(F.col("is_heading") & (F.col("depth") <= d), head)).alias(c) for d, c in enumerate(last, 1)))
    w = W.partitionBy(key).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(key, block, F.coalesce(F.sum("_heads").over(w), F.lit(0)).alias("_before"), *(F.max(c).over(w).alias(c) for c in last))

    own = W.partitionBy(key, block).orderBy("n")
    so_far, earlier = own.rowsBetween(W.unboundedPreceding, W.currentRow), own.rowsBetween(W.unboundedPreceding, -1)
    marked = h.join(before.select(key, block, "_before"), [key, block])
    marked = marked.withColumn("seg", F.col("_before") + F.sum(F.col("is_heading").cast("int")).over(so_far)).where("seg > 0")
    text = F.when(~F.col("is_heading"), F.struct(F.col("n").alias("o"), F.col("line").alias("t")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["t"]), "\n")
    bodies = marked.groupBy(key, "seg").agg(body.alias("content"))

    heads = h.where("is_heading").select(key, block, "n", "id", "doc_no", "title", "type", "depth").join(before, [key, block])
    heads = heads.withColumn("seg", F.col("_before") + F.row_number().over(own))
    parents = []
    for d, c in enumerate(last, 1):
        near = F.coalesce(F.max(F.when(F.col("depth") <= d, head)).over(earlier), F.col(c))
        parents.append(F.when((F.col("depth") == d + 1) & (near["depth"] == d), near["id"]))
    heads = heads.withColumn("parent_id", F.coalesce(*parents))
    nodes = heads.join(bodies, [key, "seg"]).withColumn("ord", (F.col("seg") - 1).cast("int"))
    return clean_content(nodes).select(key, "id", "doc_no", "title", "type", "depth", "parent_id", "content", "ord")
