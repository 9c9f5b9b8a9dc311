"""Changes between snapshots as a stream: what is known of a node is its state, so no earlier snapshot is read again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from coppice.sources import scratch

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Added to a snapshot's number for its event time, as rows at the epoch itself would be late.
EPOCH = 10**9
ARRIVALS = "id {kind}, seq long, content_hash string, title string"
CHANGES = "id {kind}, seq long, change string, n long"


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


class _Changes(StatefulProcessor):
    """A node's last snapshot, hash and title, and its number of changes; a timer for the snapshot that it may be missing from.

    A snapshot's number is its event time, in seconds from a fixed one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, content_hash string, title string")
        self.count = handle.getValueState("count", "n long")

    def _told(self, key: tuple, changes: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        if changes:
            n = self.count.get()[0] if self.count.exists() else 0
            self.count.update((n + len(changes),))
            yield pd.DataFrame([(key[0], seq, change, n + i) for i, (seq, change) in enumerate(changes, 1)], columns=["id", "seq", "change", "n"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        table = pd.concat(list(rows))
        old = self.last.get() if self.last.exists() else None
        now = tuple(old) if old is not None else None
        changes: list[tuple[int, str]] = []
        for seq, digest, title in sorted(zip(table["seq"].astype(int), map(_text, table["content_hash"]), map(_text, table["title"]), strict=True), key=lambda r: r[0]):
            if now is not None and seq <= now[0]:
                continue  # delivered before
            if now is None:
                changes.append((seq, "added"))
            elif seq > now[0] + 1:
                changes += [(now[0] + 1, "removed"), (seq, "added")]
            elif (digest, title) != (now[1], now[2]):
                changes.append((seq, "modified"))
            now = (seq, digest, title)
        if now is not None and (old is None or now[0] != old[0]):
            self.last.update(now)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((now[0] + 1 + EPOCH) * 1000 - 1)
        yield from self._told(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The next snapshot has come without the node."""
        if self.last.exists():
            seq = self.last.get()[0]
            self.last.clear()
            yield from self._told(key, [(seq + 1, "removed")])

    def close(self) -> None:
        pass


def changes(arrivals: DataFrame) -> DataFrame:
    """``id, seq, change, n`` (a node's n-th change) of a stream of ``id, seq, content_hash, title``.

    A snapshot comes whole before the next but one begins: the watermark is the largest number of earlier batches. A
    row that comes again changes nothing. Numbers follow each other; a node that the following number lacks is removed.
    """
    kind = arrivals.schema["id"].dataType.simpleString()
    rows = arrivals.select("id", F.col("seq").cast("long").alias("seq"), "content_hash", "title", F.timestamp_seconds(F.col("seq") + EPOCH).alias("_at")).withWatermark("_at", "0 seconds")
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=_Changes(), outputStructType=CHANGES.format(kind=kind), outputMode="Append", timeMode="EventTime")


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, kind: str = "string") -> DataFrame:
    """Reads the snapshots that came to the folder ``source`` since the last run, and appends their changes to ``target``.

    A run that failed is gone on with from its checkpoint, whose commits ``target`` follows, so nothing is told twice.
    """
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        stream = spark.readStream.schema(ARRIVALS.format(kind=kind)).option("recursiveFileLookup", True).parquet(source)
        query = changes(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(CHANGES.format(kind=kind)).parquet(target)


def replay(snapshots: DataFrame, runs: int = 2) -> DataFrame:
    """``changes`` of a table of snapshots that comes in so many parts, with a new run of the stream for each."""
    spark = snapshots.sparkSession
    path = scratch.folder(spark, "snapshots")
    rows = snapshots.select("id", F.col("seq").cast("long").alias("seq"), "content_hash", "title")
    lo, hi = rows.agg(F.min("seq"), F.max("seq")).first()
    kind = rows.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], CHANGES.format(kind=kind))
    for k in range(runs if lo is not None else 0):
        part = rows.where((F.col("seq") >= lo + (hi - lo + 1) * k // runs) & (F.col("seq") < lo + (hi - lo + 1) * (k + 1) // runs))
        part.write.mode("append").parquet(f"{path}/in/{k}")
        out = follow(spark, f"{path}/in", f"{path}/out", f"{path}/check", kind)
    return out
