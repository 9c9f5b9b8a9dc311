"""Readers of the artifacts: Markdown, JSON maps, vectors, registries, caches, histories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

NODE_VALUE = "struct<id: string, doc_no: string, title: string, type: string, depth: int, parentId: string, content: string, order: int, addressRefs: array<string>>"
ADDRESS_VALUE = "struct<chain: string, explorerUrl: string, label: string, chainlogId: string, etherscanName: string, isContract: boolean, isProxy: boolean, implementation: string, roles: array<string>, aliases: array<string>, expectedTokens: array<string>>"
HISTORY = "array<struct<date: string, commitHash: string, changeType: string, pr: int, prTitle: string, prAuthor: string, prUrl: string, reviewCount: int, approvalCount: int, commentCount: int, summary: string, description: string, diff: array<string>>>"
#: Fixed value: what the lookup service returns for sources that are not published.
UNVERIFIED = "Contract source code not verified"


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def split_file(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """``path, block, n, piece``: files cut at a separator, a task to each block of a file, whatever the file's size.

    ``n`` numbers a file's pieces from 0: blocks are counted first, then a piece's place in its block is added. A
    separator at the end of a file begins no further piece. Row numbers and blocks come from the scan itself.
    """
    rows = spark.read.text(path, lineSep=separator)
    m = F.col("_metadata")
    rows = rows.select(m["file_path"].alias("path"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("piece"))
    # Rows of a block follow each other in one task.
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    w = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select("path", "block", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(shift, ["path", "block"]).select("path", "block", (F.col("_i") + F.col("_shift")).alias("n"), "piece")


def _brackets(text: Column) -> Column:
    """Opening less closing brackets of a text without strings."""
    without = lambda chars: F.length(F.translate(text, chars, ""))
    return without("}]") - without("{[")


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """``path, ord, entry``: the members (``"key": value``) of files that hold one JSON object each, as text.

    Files are cut at all commas, by many tasks to a file. For each piece two things are known without the ones before
    it: whether it changes from outside to inside a string, and its brackets under either start. Both are combined
    over blocks, then within a block; a member ends at a comma outside strings at depth 1.
    """
    rows = split_file(spark, path, ",")
    plain = F.regexp_replace("piece", r"\\.", "")  # escaped characters are in strings
    parts = F.split(plain, '"', -1)
    side = lambda odd: F.array_join(F.filter(parts, lambda _, i: i % 2 == (1 if odd else 0)), "")
    rows = rows.withColumn("_flip", (F.size(parts) - 1) % 2).withColumn("_out", _brackets(side(False))).withColumn("_in", _brackets(side(True)))
    own = W.partitionBy("path", "block").orderBy("n")
    upto, before = own.rowsBetween(W.unboundedPreceding, W.currentRow), own.rowsBetween(W.unboundedPreceding, -1)
    # Whether a piece begins in a string, if its block begins outside; the depth behind it under either start.
    rows = rows.withColumn("_odd", F.coalesce(F.sum("_flip").over(before), F.lit(0)) % 2)
    d0, d1 = F.when(F.col("_odd") == 0, F.col("_out")).otherwise(F.col("_in")), F.when(F.col("_odd") == 0, F.col("_in")).otherwise(F.col("_out"))
    rows = rows.withColumn("_d0", F.sum(d0).over(upto)).withColumn("_d1", F.sum(d1).over(upto))
    last = F.max_by(F.struct((F.col("_odd") + F.col("_flip")).alias("f"), F.col("_d0").alias("a"), F.col("_d1").alias("b")), "n")
    sums = rows.groupBy("path", "block").agg(last.alias("_s"))
    whole = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    state = sums.select("path", "block", "_s", (F.coalesce(F.sum("_s.f").over(whole), F.lit(0)) % 2).alias("_start"))
    depth = F.when(F.col("_start") == 0, F.col("_s.a")).otherwise(F.col("_s.b"))
    state = state.select("path", "block", "_start", F.coalesce(F.sum(depth).over(whole), F.lit(0)).alias("_base"))
    rows = rows.join(state, ["path", "block"])
    inside = (F.col("_odd") + F.col("_flip") + F.col("_start")) % 2 == 1
    behind = F.col("_base") + F.when(F.col("_start") == 0, F.col("_d0")).otherwise(F.col("_d1"))
    rows = rows.withColumn("_end", ((behind == 1) & ~inside).cast("long"))
    # A member's number: ends before its pieces, over blocks and within the block.
    ends = rows.groupBy("path", "block").agg(F.sum("_end").alias("_e"))
    ends = ends.select("path", "block", F.coalesce(F.sum("_e").over(whole), F.lit(0)).alias("_ends"))
    rows = rows.join(ends, ["path", "block"]).withColumn("ord", F.col("_ends") + F.coalesce(F.sum("_end").over(before), F.lit(0)))
    pieces = F.array_sort(F.collect_list(F.struct("n", "piece")))
    joined = rows.groupBy("path", "ord").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), ",").alias("entry"), F.max(behind == 0).alias("_last"))
    # The object's own braces are on its first and last member.
    entry = F.when(F.col("ord") == 0, F.regexp_replace("entry", r"^\s*\{", "")).otherwise(F.col("entry"))
    entry = F.when(F.col("_last"), F.regexp_replace(entry, r"\}\s*$", "")).otherwise(entry)
    return joined.select("path", "ord", F.regexp_replace(entry, r"^\s+|\s+$", "").alias("entry")).where("entry <> ''")


def json_map(spark: SparkSession, path: str, value: str, lines: bool = False) -> DataFrame:
    """``key, value``: members of files that hold one JSON object each, read in blocks; ``lines``: one object to a line."""
    text = spark.read.text(path).select("value") if lines else json_entries(spark, path).select(F.concat(F.lit("{"), F.col("entry"), F.lit("}")).alias("value"))
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def nodes(spark: SparkSession, path: str) -> DataFrame:
    v = F.col("value")
    return json_map(spark, path, NODE_VALUE).select(v["id"].alias("id"), v["doc_no"].alias("doc_no"), v["title"].alias("title"), v["type"].alias("type"), v["depth"].alias("depth"), v["parentId"].alias("parent_id"), v["content"].alias("content"), v["order"].alias("ord"), F.coalesce(v["addressRefs"], F.array().cast("array<string>")).alias("address_refs"))


def addresses(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, ADDRESS_VALUE).select(F.col("key").alias("address"), "value.*")


def or_empty(read, schema: str, spark: SparkSession) -> DataFrame:
    """The frame that ``read`` returns, or an empty one if its files are missing."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], schema)
        raise


def registry(spark: SparkSession, path: str) -> DataFrame:
    """``name, address, ord`` of registry files (name to address); addresses in lower case, others dropped."""
    rows = json_entries(spark, path).select("ord", F.explode(F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), "map<string, string>")).alias("name", "address"))
    return rows.where(F.col("address").startswith("0x")).select("name", F.lower("address").alias("address"), "ord")


def lookup_entry(chain_id: Column, address: Column, response: Column) -> list[Column]:
    """Columns of one lookup's response (JSON): a failed or unpublished one gives empty fields, not nulls."""
    r = lambda k: F.coalesce(F.get_json_object(response, f"$.result[0].{k}"), F.lit(""))
    impl = r("Implementation")
    return [
        chain_id.alias("chain_id"), address.alias("address"), r("ContractName").alias("contract_name"),
        F.when(r("ABI") == UNVERIFIED, "").otherwise(r("ABI")).alias("abi"), r("Proxy").isin("1", "true").alias("is_proxy"),
        F.when(impl.startswith("0x"), F.lower(impl)).otherwise("").alias("implementation"), r("SourceCode").alias("source_code"),
    ]


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (``chain_id, address``) that the cache lacks; empty answers are in the cache too."""
    return wanted.select("chain_id", "address").distinct().join(cache, ["chain_id", "address"], "left_anti")


def fetch(wanted: DataFrame, client, pause: float = 0.25) -> DataFrame:
    """``chain_id, address, response``: a client's answers, ``pause`` seconds between calls of a task; errors give null.

    ``client(chain_id, address)`` returns JSON text. Repartition ``wanted`` to bound the calls at a time.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for batch in batches:
            out = []
            for c, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out.append(client(c, a))
                except Exception:  # noqa: BLE001  a failed call is an empty answer
                    out.append(None)
                time.sleep(pause)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=pa.string())], names=["chain_id", "address", "response"])

    return wanted.select("chain_id", "address").mapInArrow(ask, "chain_id long, address string, response string")


def embed(chunks: DataFrame, service, dim: int, batch: int = 64, retries: int = 3, text: str = "embed_text") -> DataFrame:
    """Adds ``embedding``: ``service(list of texts)`` in batches, retried with growing pauses, and normalised."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for b in batches:
            texts, out = b.column(b.schema.get_field_index(text)).to_pylist(), []
            for i in range(0, len(texts), batch):
                for attempt in range(retries):
                    try:
                        found = np.asarray(service(texts[i : i + batch]), dtype=np.float64)
                        break
                    except Exception:  # noqa: BLE001
                        if attempt == retries - 1:
                            raise
                        time.sleep(2**attempt)
                if found.shape != (len(texts[i : i + batch]), dim):
                    raise ValueError(f"the service returned {found.shape}")
                size = np.linalg.norm(found, axis=1, keepdims=True)
                out += (found / np.where(size > 0, size, 1)).astype(np.float32).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, type=pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return chunks.mapInArrow(work, schema)


def flat_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``pos, embedding``: row-major files of 32-bit little-endian floats, read in blocks of whole vectors.

    ``pos`` goes on from one file to the next, in the order of their names. Raises if a file's size is no multiple.
    """
    sizes = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # a row to a file; contents are not read
    odd = [r["length"] for r in sizes if r["length"] % (4 * dim)]
    if odd:
        raise ValueError(f"{odd[0]} bytes are no multiple of {dim} floats")
    names = sorted(r["path"] for r in sizes if r["length"])
    schema = "pos long, raw binary"
    if not names:
        return spark.createDataFrame([], "pos long, embedding array<float>")
    records = spark.sparkContext.binaryRecords(",".join(names), 4 * dim)
    rows = spark.createDataFrame(records.zipWithIndex().map(lambda r: (r[1], bytearray(r[0]))), schema)

    def floats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<f4")
            ends = np.arange(0, len(flat) + 1, dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["pos", "embedding"])

    return rows.mapInArrow(floats, "pos long, embedding array<float>")


def histories(spark: SparkSession, path: str) -> DataFrame:
    """History entries of one file to a node, with ``id`` from the file's name. Diff rows stay JSON text."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="[!_]*.json").select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("id"), "value")
    return rows.select("id", F.posexplode(F.from_json("value", HISTORY)).alias("pos", "e")).select("id", "pos", "e.*")


def diff_rows(diff: Column) -> Column:
    """Diff tuples as structs of op, text and segments."""
    seg = F.from_json(F.get_json_object(diff, "$[1]"), "array<array<string>>")
    op = F.get_json_object(diff, "$[0]")
    segs = F.when(op == "~", F.transform(seg, lambda s: F.struct(F.element_at(s, 1).alias("op"), F.element_at(s, 2).alias("text"))))
    return F.struct(op.alias("op"), F.when(op != "~", F.get_json_object(diff, "$[1]")).alias("text"), segs.alias("segs"))


def staged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Staged JSON lines (commits, revisions, proposals, calls) with an explicit schema."""
    return spark.read.schema(schema).json(path)


COMMITS = "seq int, hash string, ts string, message string"
REVISIONS = "seq int, text string"
PROPOSALS = "number int, title string, body string, author string, url string, comment_count int, review_count int, reviews array<struct<state: string>>"


def proposals(spark: SparkSession, path: str) -> DataFrame:
    """Proposals with ``approval_count``, the approved ones of their reviews."""
    return staged(spark, path, PROPOSALS).withColumn("approval_count", F.size(F.filter("reviews", lambda r: r["state"] == "APPROVED"))).drop("reviews")
