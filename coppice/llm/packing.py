"""Packing token sequences into windows by non-negative least squares.

Documents are cut at every ``window`` tokens; whole windows need no packing, the rests do. Their lengths'
histogram (one count for each length below the window, whatever the corpus) comes to the driver, where

1. shallow combinations are enumerated: lengths taken twice up to ``DEPTH`` times or with partners so that
   they fill a window exactly, the most frequent lengths first;
2. non-negative least squares finds how often to use each so that the lengths used come near the histogram;
3. repeats are rounded down within what is left of each length;
4. the residual is packed greedily, the longest length that fits next, each pattern as often as it goes.

The result is a table of slots (length, range of ranks, first sequence, offset) whose size depends on the
window alone; executors look up each piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.llm.common import list_array, tune, written

WINDOW = 2048
END_ID = 1
DEPTH = 4
#: Combinations that enter the least squares.
COLUMNS = 600
#: Pieces to a cell when pieces are ranked within their length.
CELL_ROWS = 20_000
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Encoder:
    """Ids of a byte-level BPE file. Beside a ``.tiktoken`` file of the same vocabulary, the faster library
    serves texts in which no special token is spelt out; both give the same ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int | None = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``window`` ids: ``id, start, length, doc_tokens, ids_crc32`` and, if kept, ``ids``.

    A null text counts as empty: one piece that holds the end id (none at all without an end id).
    """
    path = path or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()
    tail = [] if end_id is None else [end_id]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows, start, length, total, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array((enc.ids(text) if text else []) + tail, dtype="<u4")
                for lo in range(0, len(ids), window):
                    piece = ids[lo : lo + window]
                    rows.append(i)
                    start.append(lo)
                    length.append(len(piece))
                    total.append(len(ids))
                    crc.append(zlib.crc32(piece.tobytes()))
                    if keep_ids:
                        kept.append(piece)
            columns = [batch.column(0).take(pa.array(rows, type=pa.int64())), *(pa.array(c, type=pa.int64()) for c in (start, length, total, crc))]
            if keep_ids:
                columns.append(list_array(np.concatenate(kept).astype(np.int32) if kept else np.zeros(0, np.int32), np.array(length, dtype=np.int64), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "doc_tokens", "ids_crc32", *["ids"] * keep_ids])

    tune(docs.sparkSession)
    schema = f"`{id_col}` {kind}, start long, length long, doc_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 with least ||a x - b||, by accelerated projected gradients; good enough to be rounded."""
    if not a.size:
        return np.zeros(a.shape[1])
    v = np.ones(a.shape[1])
    for _ in range(30):  # the largest eigenvalue of a'a
        v = a.T @ (a @ v)
        v /= max(np.linalg.norm(v), 1e-30)
    rate = 1 / max(float(v @ (a.T @ (a @ v))) * 1.02, 1e-30)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0, y - rate * (a.T @ (a @ y - b)))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def combinations(counts: np.ndarray, window: int, columns: int = COLUMNS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Shallow combinations of the lengths that occur and fill the window exactly, common lengths first."""
    there = np.flatnonzero(counts)
    out: dict[tuple[int, ...], int] = {}
    for a in there:
        if counts[b := window - a] and a <= b:
            out[(int(b), int(a))] = int(min(counts[a], counts[b]))
    common = there[np.argsort(-counts[there], kind="stable")][: max(8, columns // 8)]
    for d in range(3, depth + 1):
        for i, a in enumerate(common):
            for b in common[i : i + 24]:
                rest = window - a - (d - 2) * b
                if rest > 0 and counts[rest]:
                    out.setdefault(tuple(sorted((int(a), *[int(b)] * (d - 2), int(rest)), reverse=True)), int(min(counts[a], counts[b], counts[rest])))
    return sorted(out, key=lambda c: (len(c), -out[c], c))[:columns]


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that fit the window, and their repeats, which use up ``counts`` (by length) exactly."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    found = combinations(left, window)
    matrix = np.zeros((window + 1, len(found)))
    for j, c in enumerate(found):
        for n in c:
            matrix[n, j] += 1
    for j in np.argsort(-(x := nnls(matrix, left.astype(float))), kind="stable"):
        need: dict[int, int] = {}
        for n in found[j]:
            need[n] = need.get(n, 0) + 1
        times = min(int(x[j] + 1e-6), *(int(left[n]) // k for n, k in need.items()))
        if times > 0:
            out.append((found[j], times))
            for n, k in need.items():
                left[n] -= k * times
    while left.any():
        room, pattern, need = window, [], {}
        lengths = np.flatnonzero(left)
        while True:
            at = int(np.searchsorted(lengths, room, side="right")) - 1
            while at >= 0 and left[lengths[at]] <= need.get(int(lengths[at]), 0):
                at -= 1
            if at < 0:
                break
            n = int(lengths[at])
            pattern.append(n)
            need[n] = need.get(n, 0) + 1
            room -= n
        times = min(int(left[n]) // k for n, k in need.items())
        out.append((tuple(pattern), times))
        for n, k in need.items():
            left[n] -= k * times
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where the pieces of a length go by rank: ranks lo.. of ``length`` open sequences ``sequence``.. at ``offset``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return pd.DataFrame(rows, columns=["length", "lo", "sequence", "offset"]).sort_values(["length", "lo"], ignore_index=True)


def pack(pieces: DataFrame, window: int = WINDOW, key: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``window``.

    Pieces are ranked within their length by ``key``, in cells so that no length is one task's; ties are
    pieces alike in all that counts here. An empty table gives an empty result. Pieces longer than the
    window raise.
    """
    spark = pieces.sparkSession
    histogram = pieces.groupBy("length").count().collect()  # as many rows as the window has lengths
    if any(not 0 < r["length"] <= window for r in histogram):
        raise ValueError("a piece does not fit the window")
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    table = slots(plan(counts, window))
    packed = {c: table[c].to_numpy(dtype=np.int64) for c in table}
    shared = spark.sparkContext.broadcast(packed)  # bounded by the window

    cells = max(1, math.ceil(int(counts.max(initial=0)) / CELL_ROWS))
    celled = pieces.withColumn("_cell", F.pmod(F.xxhash64(*key), F.lit(cells)))
    w = W.partitionBy("length", "_cell")
    ranked = celled.withColumn("_rank", F.row_number().over(w.orderBy(*key)) - 1)
    if cells > 1:
        sums = celled.groupBy("length", "_cell").count()
        before = F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.join(sums.select("length", "_cell", before.alias("_before")), ["length", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before")
    ranked = ranked.select(*pieces.columns, "_rank")  # Arrow matches columns by place

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        span = int(max(t["lo"].max(initial=0) + 1, 1)) + 1
        keys = t["length"] * span + t["lo"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), side="right") - 1
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_rank"]
            added = [pa.array(t["sequence"][at] + rank - t["lo"][at]), pa.array(t["offset"][at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *added], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long, offset long"])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: ``id, start, length, doc_tokens, ids_crc32[, ids], sequence_id, offset``.

    Every id of every document lies in one piece, and pieces lie gapless from offset 0 in their sequence. Rows
    that repeat an id are packed on their own. Null texts count as empty; null ids are kept.
    """
    pieces = written(tokenise(docs, id_col, text_col, path, window, END_ID, keep_ids), "pieces")
    return pack(pieces, window, (id_col, "start", "ids_crc32"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
