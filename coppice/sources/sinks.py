"""Sinks: tables, vectors with their metadata, keyed upserts, CSV and JSON envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators import history


def table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_map(df: DataFrame, key: str, path: str) -> None:
    """One JSON object to a line, ``{key: row}``; a map file's lines are its entries."""
    rest = F.struct(*(c for c in df.columns if c != key))
    df.select(F.to_json(F.map_from_arrays(F.array(key), F.array(rest))).alias("value")).write.mode("overwrite").text(path)


def json_objects(df: DataFrame, key: str, file: str, path: str) -> None:
    """A file that holds one JSON object for each value of ``file``: its rows by key, in the keys' order.

    A value's rows are one text, so choose ``file`` to have some thousands of them.
    """
    rest = [c for c in df.columns if c not in (key, file)]
    members = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.struct(*rest).alias("v")))), lambda m: F.concat(F.to_json(F.array(m["k"])).substr(F.lit(2), F.length(F.to_json(F.array(m["k"]))) - 2), F.lit(": "), F.to_json(m["v"])))
    whole = F.concat(F.lit("{"), F.array_join(members, ",\n"), F.lit("}"))
    df.groupBy(file).agg(whole.alias("value")).write.mode("overwrite").partitionBy(file).text(path)


def vectors(chunks: DataFrame, path: str, model: str, dim: int) -> None:
    """Chunks with their vectors, and one row of metadata beside them."""
    table(chunks, f"{path}/chunks")
    meta = chunks.agg(F.count("*").alias("count")).select(F.lit(model).alias("model"), F.lit(dim).alias("dim"), "count", F.lit(True).alias("normalized"), F.current_timestamp().alias("generated_at"))
    table(meta, f"{path}/meta")


def merge_history(existing: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """Writes the upsert of new entries beside the existing ones; returns the manifest. A repeated run changes nothing."""
    merged = history.upsert(existing, new)
    table(merged, f"{path}/entries")
    done = merged.sparkSession.read.parquet(f"{path}/entries")
    counts = history.manifest(done)
    table(counts, f"{path}/manifest")
    return merged.sparkSession.read.parquet(f"{path}/manifest")


def csv(df: DataFrame, path: str) -> None:
    """With a header; every value quoted, inner quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def tool_result(df: DataFrame) -> DataFrame:
    """``text``: each row as JSON in a tool's content item."""
    return df.select(F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.to_json(F.struct("*")).alias("text"))).alias("content"))).alias("text"))
