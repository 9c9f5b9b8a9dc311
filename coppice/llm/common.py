"""Shared folder handling, written intermediate tables and Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows and bytes to an Arrow batch: texts may be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = "1000", str(16 << 20)
#: Rows where arrays of all words of a batch are held beside the texts: they take many times the bytes.
FEW_ROWS = "250"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession, rows: str = ARROW_ROWS) -> None:
    """Small Arrow batches, so that a Python worker holds few texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); own one only where it is unset and all is local."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="coppice-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, by: str | None = None, codec: str | None = None, hashes: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``by``: a column whose values get a folder of files each. ``codec``: of the files, if not the usual one.
    ``hashes``: most columns are hashes, for which no dictionary is tried. The files stay until ``forget`` or until the Python
    process ends, as the frames returned to callers read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):  # the table stands on its own, so the shuffle files behind it can go
        df.write.option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path, partitionBy=by, compression=codec)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def forget(*tables: DataFrame) -> None:
    """Remove the files of tables made by ``written`` that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._written_to)


#: Words of 64 bits of the filter below.
FILTER_WORDS = 1 << 20


def flagged(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, flag: str) -> DataFrame:
    """Adds ``flag``: true if the key may be among the wanted ones, false if it is not (a Bloom filter of one hash).

    The filter has ``FILTER_WORDS`` words whatever the input, so it can be broadcast, and keeps rows that are
    not wanted out of a shuffle. An exact join must follow: when very many keys are wanted it lets others by.
    """
    word = lambda c: F.pmod(F.xxhash64(F.lit(17), c), F.lit(FILTER_WORDS))
    bit = lambda c: F.pmod(F.xxhash64(F.lit(23), c), F.lit(64)).cast("int")
    bits = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)))
    words = wanted.groupBy(word(F.col(wanted_key)).alias("_word")).agg(F.bit_or(F.element_at(bits, bit(F.col(wanted_key)) + 1)).alias("_bits"))
    joined = rows.join(F.broadcast(words), word(F.col(key)) == F.col("_word"), "left")
    hit = F.coalesce(F.getbit("_bits", bit(F.col(key))) == 1, F.lit(False))
    return joined.withColumn(flag, hit).drop("_word", "_bits")


def sampled_ids(rows: DataFrame, id_col: str, by: str | None, sample: int, total: int) -> DataFrame:
    """The ``sample`` ids of least hash (of each value of ``by``; ``total`` ids in all at most) as a broadcast table.

    Counts come first, so that only about four times the sample is ever ranked, whatever the input's size.
    """
    keys = [by] if by else []
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).limit(total + 1).collect()
    if len(counts) > total:
        raise ValueError(f"more than {total} labels")
    sample = min(sample, total // max(1, len(counts)))
    spark = rows.sparkSession
    part = [(*([r[by]] if by else []), min(1.0, (4 * sample + 100) / max(1, r["_n"]))) for r in counts]
    h = F.xxhash64(id_col)
    within = lambda share: h < (share * 2.0**64 - 2.0**63)
    if by:
        table = spark.createDataFrame(part, f"_by {rows.schema[by].dataType.simpleString()}, _share double")
        few = rows.join(F.broadcast(table), F.col(by) == F.col("_by")).where(within(F.col("_share")))
    else:
        few = rows.where(within(F.lit(part[0][-1] if part else 1.0)))
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_h", id_col)
    few = few.select(*keys, F.col(id_col), h.alias("_h")).distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= sample)
    chosen = [tuple(r) for r in few.select(*keys, id_col).collect()]
    return F.broadcast(spark.createDataFrame(chosen, rows.select(*keys, id_col).schema))


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
