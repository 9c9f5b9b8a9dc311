"""Suffix-array dedup: bytes that repeat a string of a smaller document, by interval expansion on a Burrows-Wheeler transform.

1. Equal texts are one class of the least id; the texts are written once by class.
2. A window of ``length`` bytes belongs to its minimizer, the least hash of the ``GRAM``-byte strings in it, so equal
   windows, wherever they are, share a key. Keys of one document alone are done with; only 16 bytes for each
   minimizer were dealt.
3. The other keys' pieces of text (runs of windows of one key) are cut out; equal pieces combine, and buckets of keys
   deal them to tasks. A key with very many different pieces is dealt by single windows instead.
4. A task sorts its pieces' suffixes, and extends intervals of the transform backward, breadth first: a string of
   l + 1 bytes whose interval ends at an unset row sets that row's common prefix to l, in increasing order, and
   stops at ``length``. Rows still unset share ``length`` bytes with the row before: each run takes its least id.
5. A piece's windows with a smaller id go back to the occurrences, and bytes they cover are taken from the texts.

Hashes only choose what meets; what is removed rests on the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import FILTER_WORDS, cleaned, column, flagged, forget, tune, written

LENGTH = 50
#: Bytes to a hashed string; windows to a piece at most.
GRAM, WINDOWS = 20, 64
#: Bytes of text hashed at once, and of pieces to a task's transform; pieces of a key beyond which windows are dealt.
CHUNK, BUCKET, PIECES = 1 << 16, 1 << 17, 1 << 14
#: Symbols that are sorted by at once.
FIRST = 7
#: Pieces that a task returns at once.
FLUSH = 1 << 16
NULL_ID = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all strings of ``gram`` bytes, from the words of 8 bytes that lie in them."""
    n = len(data) - gram + 1
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))  # one that begins at each byte
    if gram < 8:
        h = words[:n] & np.uint64((1 << 8 * gram) - 1)
    else:
        h = words[:n]
        for at in (*range(8, gram - 7, 8), *[gram - 8] * (gram % 8 > 0)):
            h = h * _MIX
            h ^= words[at : at + n]
            h ^= h >> np.uint64(29)
    h = h + np.uint64(1)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def pieces_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, key, first window and number of windows of each run of windows of one key; each window is in one run."""
    out: list[tuple] = []
    part: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        if not part:
            return
        data = np.frombuffer(b"".join(b for _, _, b in part), dtype=np.uint8)
        least = sliding_least(gram_hashes(data, gram), length - gram + 1)
        sizes = np.array([len(b) for _, _, b in part])
        first = np.cumsum(sizes) - sizes
        upto = first + sizes - length + 1  # windows from there on cross the text's end
        # A run begins where the key changes, and with each text; only these places are looked at one by one.
        new = least[1:] != least[:-1]
        new[first[1:] - 1] = True
        at = np.concatenate([[0], np.flatnonzero(new) + 1])
        own = np.searchsorted(first, at, side="right") - 1
        inside = at < upto[own]
        end = np.minimum(np.append(at[1:], len(least)), upto[own])[inside]
        at, own = at[inside], own[inside]
        parts = -(-(end - at) // WINDOWS)
        key, own, end = (np.repeat(x, parts) for x in (least[at], own, end))
        start = np.repeat(at, parts) + WINDOWS * (np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts))
        text, shift = np.array([t for t, _, _ in part]), np.array([s for _, s, _ in part])
        out.append((text[own], key.view(np.int64), shift[own] + start - first[own], np.minimum(end - start, WINDOWS)))
        part.clear()

    for t, b in enumerate(texts):
        for lo in range(0, max(1, len(b) - length + 1), CHUNK):
            piece = b[lo : lo + CHUNK + length - 1]
            if len(piece) >= length:
                part.append((t, lo, piece))
                held += len(piece)
                if held >= CHUNK:
                    flush()
                    held = 0
    flush()
    return tuple(np.concatenate(c) if out else np.zeros(0, dtype=np.int64) for c in (zip(*out, strict=True) if out else ((),) * 4))


def packed(symbols: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` symbols (7 at most) that begin at each position as one number; 0 follows the last."""
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(size, dtype=np.int64)])
    key = padded[: len(symbols)].copy()
    for j in range(1, size):
        key <<= 9
        key |= padded[j : j + len(symbols)]
    return key


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` symbols (or more) that follow; by doubling, from 7 symbols at once."""
    n, size = len(symbols), FIRST
    key = packed(symbols, size)
    order = np.argsort(key)
    some = slice(None)  # places in the order of those that are not alone with their rank
    rank = np.empty(n, dtype=np.int64)
    while True:
        at = order[some]
        new = np.ones(len(at), dtype=bool)
        new[1:] = np.diff(key[at] if size == FIRST else key) != 0
        # A rank is the place of the first of its equals, so that ranks of those alone stay.
        place = np.arange(n)[some]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        rank[at] = np.repeat(place[first], count)
        tied = np.repeat(count > 1, count)
        if size >= depth or not tied.any():
            return order
        some = place[tied]
        at = at[tied]
        # Two ranks further on as well, if three fit in 63 bits.
        steps = 2 if (n + 1) ** 3 < 1 << 63 else 1
        key = rank[at]
        for step in range(1, steps + 1):
            on = at + step * size
            key = key * (n + 1) + np.where(on < n, rank[np.minimum(on, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, order[some] = key[by], at[by]
        size *= steps + 1


def run_ends(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Flags of n + 1 rows: the row shares fewer than ``length`` symbols with the row before.

    Symbol 0 separates and ends the pieces; strings with one are not extended, so flags are right after each row
    that has no separator among its first ``length`` symbols. The first intervals are those of strings of 7 symbols,
    but for those that end where shorter ones do: what extends them ends where extensions of the shorter ones do.
    """
    n, size = len(symbols), min(FIRST, length)
    last = symbols[order - 1]
    head = symbols[order]
    follow = np.empty(n, dtype=np.int64)
    follow[np.argsort(last, kind="stable")] = np.arange(n)  # the row of the suffix that begins one symbol before
    ends = np.ones(n + 1, dtype=bool)
    key = packed(symbols, size)[order]
    differ = key[1:] ^ key[:-1]
    ends[1:n] = differ != 0
    hi = np.flatnonzero((differ > 0) & (differ < 1 << 9)) + 1
    edge = np.flatnonzero(ends)
    lo = edge[np.searchsorted(edge, hi) - 1]
    whole = np.ones(len(lo), dtype=bool)
    for j in range(size):
        whole &= (key[lo] >> 9 * j & 511) != 0
    lo, hi = lo[whole], hi[whole]
    source = np.empty(n, dtype=np.int64)
    for _ in range(size, length):
        if not len(lo):
            break
        size = hi - lo
        rows = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        of = np.repeat(np.arange(len(lo)), size)
        real = last[rows] != 0
        to, of = follow[rows[real]], of[real]
        if len(to) * 8 > n:
            source.fill(-1)
            source[to] = of
            to = np.flatnonzero(source >= 0)
            of = source[to]
        else:
            by = np.argsort(to)
            to, of = to[by], of[by]
        if not len(to):
            break
        cut = np.ones(len(to), dtype=bool)
        cut[1:] = (to[1:] != to[:-1] + 1) | (of[1:] != of[:-1]) | (head[to[1:]] != head[to[:-1]])
        at = np.flatnonzero(cut)
        lo, hi = to[at], to[np.append(at[1:], len(to)) - 1] + 1
        fresh = ~ends[hi]
        lo, hi = lo[fresh], hi[fresh]
        ends[hi] = True
    return ends


def least_by_window(pieces: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, id and windows (bits): for each window of a piece the least id of all pieces that hold its string.

    pieces: the bytes of all pieces in a row, of the given sizes.
    """
    begin = np.cumsum(sizes + 1) - sizes - 1
    data = np.zeros(len(pieces) + len(sizes), dtype=np.uint16)
    data[np.arange(len(pieces)) + np.repeat(np.arange(len(sizes)), sizes)] = pieces.astype(np.uint16) + np.uint16(1)
    order = sorted_suffixes(data, length)
    ends = run_ends(data, order, length)
    own = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(len(data)) - begin[own]
    row = np.flatnonzero((offset + length <= sizes[own])[order])
    at = order[row]
    run = np.cumsum(ends[:-1])[row]
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    lowest = np.repeat(np.minimum.reduceat(least[own[at]], first), np.diff(np.append(first, len(row))))
    piece, bit = own[at], np.left_shift(np.uint64(1), offset[at].astype(np.uint64))
    by = np.lexsort((lowest, piece))
    piece, lowest, bit = piece[by], lowest[by], bit[by]
    first = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (lowest[1:] != lowest[:-1])]))
    return piece[first], lowest[first], np.bitwise_or.reduceat(bit, first).view(np.int64)


def expanded(table: pa.Table, length: int = LENGTH) -> pa.Table:
    """``_key, _piece, _lowest, _bits``: windows of pieces and the least id that has them, where it is less than the piece's ``_most``.

    Other windows are nobody's repeats: all holders of the piece have ids of ``_least`` to ``_most``.
    """
    table = table.combine_chunks()
    held = table.column("_piece").combine_chunks() if table.column("_piece").num_chunks != 1 else table.column("_piece").chunk(0)
    ends = np.frombuffer(held.buffers()[1], dtype=np.int32)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    piece, lowest, bits = least_by_window(data, np.diff(ends).astype(np.int64), table.column("_least").to_numpy(), length)
    used = lowest < table.column("_most").to_numpy()[piece]
    of = pa.array(piece[used])
    return pa.table([table.column("_key").take(of), held.take(of), pa.array(lowest[used]), pa.array(bits[used])], names=["_key", "_piece", "_lowest", "_bits"])


def cover(text: bytes, starts: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs of bytes that the windows cover (bit i of a row: the window at its start + i), and the bytes left."""
    row, bit = np.nonzero(np.unpackbits(windows.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    at = starts[row] + bit
    delta = np.bincount(at, minlength=len(text) + 1) - np.bincount(at + length, minlength=len(text) + 1)
    gone = np.cumsum(delta[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()


def key_filter(wanted: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of ``FILTER_WORDS`` words, of keys whose low bits are a hash's."""
    bits = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)))
    word, bit = F.col(key).bitwiseAND(F.lit(FILTER_WORDS - 1)), F.shiftright(F.col(key), FILTER_WORDS.bit_length() - 1).bitwiseAND(F.lit(63))
    with cleaned(wanted.sparkSession):
        words = wanted.groupBy(word.alias("_word")).agg(F.bit_or(F.element_at(bits, bit.cast("int") + 1)).alias("_bits")).toArrow()
    out = np.zeros(FILTER_WORDS, dtype=np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def in_filter(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """True for each key that is in the filter, and by chance for others."""
    bit = key >> np.int64(len(words).bit_length() - 1) & np.int64(63)
    return words[key & np.int64(len(words) - 1)] >> bit & np.int64(1) == 1


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, pieces: int = PIECES, keep_bytes: bool = True) -> DataFrame:
    """``id, n_bytes, n_removed, spans, kept, kept_sha256``: one row for each row.

    A text's bytes (UTF-8) go where a string of ``length`` bytes covers them that also starts in a document with a
    smaller id; strings are judged on the input, overlaps count, and matches do not cross documents. ``spans`` are
    the removed runs (start, end exclusive, in bytes), ``kept`` the bytes left (only with ``keep_bytes``). A null text counts as empty. Ids are
    longs; a null id is larger than all others. Rows that share an id do not take bytes from each other. Other
    columns are not looked at; an empty table gives an empty result. A text and its windows must fit in a task.
    """
    spark = docs.sparkSession
    tune(spark)
    text = F.coalesce(column(text_col), F.lit("")).cast("binary")
    rows = docs.select(column(id_col).cast("long").alias("_id"), text.alias("_text"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2("_text", 256))).withColumn("_rank", F.coalesce("_id", F.lit(NULL_ID)))
    texts = rows.groupBy("_digest").agg(F.min("_rank").alias("_least"), F.first("_text").alias("_text"))
    texts = written(texts.withColumn("_class", F.monotonically_increasing_id()), "texts", codec="zstd")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, key, _, _ = pieces_of(b.column(1).to_pylist(), length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(t))], names=["_key", "_least"])

    long = texts.where(F.length("_text") >= length)
    shared = long.select("_least", "_text").mapInArrow(keys, "_key long, _least long").groupBy("_key").agg(F.min("_least").alias("lo"), F.max("_least").alias("hi"))
    shared = written(shared.where("lo < hi").select(F.col("_key").alias("_wanted")), "keys")
    table = spark.sparkContext.broadcast(key_filter(shared, "_wanted"))  # of fixed size

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, key, start, n = pieces_of(b.column(1).to_pylist(), length, gram)
            maybe = in_filter(key, table.value)
            t, key, start, n = t[maybe], key[maybe], start[maybe], n[maybe]
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(t)), pa.array(start * WINDOWS + n - 1)], names=["_key", "_class", "_place"])

    maybe = long.select("_class", "_text").mapInArrow(minimizers, "_key long, _class long, _place long")
    places = maybe.join(shared, F.col("_key") == F.col("_wanted"), "left_semi").groupBy("_class").agg(F.collect_list(F.struct("_key", "_place")).alias("_at"))
    places = written(places, "places", codec="zstd")
    table.destroy()
    forget(shared)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, keys, counts, starts = [], [], [], []

            def flush(upto: int) -> pa.RecordBatch:
                of = pa.array(np.repeat(np.arange(upto - len(counts), upto), counts))
                out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(held, type=pa.binary()), b.column(0).take(of), b.column(1).take(of), pa.array(np.concatenate(starts))], names=["_key", "_piece", "_class", "_least", "_start"])  # noqa: B023
                for part in (held, keys, counts, starts):  # noqa: B023
                    part.clear()
                return out

            for i, (data, at) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                data, at = data.as_py(), at.values
                place = at.field("_place").to_numpy()
                start = place // WINDOWS
                held += [data[s:e] for s, e in zip(start.tolist(), (start + place % WINDOWS + length).tolist(), strict=True)]
                keys.append(at.field("_key").to_numpy())
                starts.append(start)
                counts.append(len(start))
                if len(held) > FLUSH:
                    yield flush(i + 1)
            if held:
                yield flush(b.num_rows)

    def of(wanted: DataFrame) -> DataFrame:
        """The texts of the wanted classes, and most others kept out of the shuffle."""
        return flagged(texts, "_class", wanted, "_class", "_maybe").where("_maybe").drop("_maybe").join(wanted, "_class")

    placed = of(places).select("_class", "_least", "_text", "_at")
    where = written(placed.mapInArrow(cut, "_key long, _piece binary, _class long, _least long, _start long"), "pieces", codec="zstd")
    forget(places)
    holders = F.min("_least").alias("_least"), F.max("_least").alias("_most")
    pieces_table = where
    distinct = written(where.groupBy("_key", "_piece").agg(*holders), "distinct", codec="zstd")
    hot = written(distinct.groupBy("_key").count().where(F.col("count") > pieces).select("_key"), "hot")
    dealt = distinct.withColumn("_by", F.col("_key"))
    if not hot.isEmpty():
        each = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("_piece") - length + 1), lambda i: F.substring("_piece", i, F.lit(length)))).alias("_i", "_w")
        windows = lambda df: df.join(hot, "_key", "left_semi").select("*", each).withColumn("_piece", F.col("_w")).drop("_w")
        split = windows(distinct).groupBy("_key", "_piece").agg(holders[0], F.max("_most").alias("_most")).withColumn("_by", F.xxhash64("_piece"))
        dealt = distinct.join(hot, "_key", "left_anti").withColumn("_by", F.col("_key")).unionByName(split)
        where = where.join(hot, "_key", "left_anti").unionByName(windows(where).withColumn("_start", F.col("_start") + F.col("_i")).drop("_i"))
    total = distinct.agg(F.sum(F.length("_piece") + 1)).first()[0] or 0

    n_buckets = max(1, -(-total // bucket))
    runs = dealt.groupBy(F.pmod(F.xxhash64("_by"), F.lit(n_buckets)).alias("_bucket")).applyInArrow(lambda table: expanded(table, length), "_key long, _piece binary, _lowest long, _bits long")
    runs = written(runs, "runs", codec="zstd")
    forget(distinct)
    hits = where.join(runs, ["_key", "_piece"]).where("_lowest < _least").groupBy("_class").agg(F.collect_list(F.struct("_start", "_bits")).alias("_hits"))
    hits = written(hits, "hits", codec="zstd")
    forget(runs, hot, pieces_table)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut_out = [cover(data, hit.values.field("_start").to_numpy(), hit.values.field("_bits").to_numpy(), length) for data, hit in zip(b.column(1).to_pylist(), b.column(2), strict=True)]
            flat = np.array([x for s, _ in cut_out for x in s], dtype=np.int64).reshape(-1, 2)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "end"])
            ends = np.concatenate([[0], np.cumsum([len(s) for s, _ in cut_out])]).astype(np.int32)
            digests = pa.array([hashlib.sha256(k).hexdigest() for _, k in cut_out], type=pa.string())
            kept = pa.array([k if keep_bytes else None for _, k in cut_out], type=pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pairs), digests, kept], names=["_digest", "spans", "kept_sha256", "_kept"])

    done = of(hits).select("_digest", "_text", "_hits").mapInArrow(remove, "_digest binary, spans array<struct<start: long, end: long>>, kept_sha256 string, _kept binary")
    done = written(texts.select("_digest", "_least").join(done, "_digest", "left"), "removed")
    forget(texts, hits)
    n = F.length("_text").cast("long")
    out = rows.select("_id", "_rank", "_digest", n.alias("n_bytes"), *["_text"] * keep_bytes).join(done, "_digest")
    # A copy of a smaller document's text goes whole, if it holds a window at all; a text without hits stays whole.
    copy = (F.col("_rank") > F.col("_least")) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")))
    digest = F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("_digest"))))
    kept = [F.when(copy, F.lit(b"")).otherwise(F.coalesce("_kept", "_text")).alias("kept")] if keep_bytes else []
    out = out.select(F.col("_id").alias(id_col), "n_bytes", spans.alias("spans"), *kept, digest.alias("kept_sha256"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(column(id_col), "n_bytes", removed.alias("n_removed"), "spans", *["kept"] * keep_bytes, "kept_sha256")


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
