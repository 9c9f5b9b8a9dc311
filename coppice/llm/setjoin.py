"""Exact set-similarity joins by prefix filtering, for sets of any kind (words of a line, shingles of a text).

Elements are 64-bit hashes in one global order, rarest first, by counts of hashed buckets (a table of fixed
size that all data have been counted into). Two sets whose Jaccard similarity is ``num / den`` or more
share an element of their prefixes, of n - ceil(n * num / den) + 1 elements, and a second one if the
prefixes are longer by one.

1. ``candidate_edges``: prefixes are dealt by element; small sets by a pair of elements where the first is
   common. In a task, the holders are compared in order of size under the length, positional and bitmap
   filters. What leaves the task is a spanning forest of the pairs that pass, not the pairs. A key that more
   than ``HOLDERS`` prefixes hold is dealt over tasks by pairs of blocks of that size, so that no pair is lost
   and no task gets all of it.
2. Connected components of the candidates; no link crosses two of them.
3. ``verified``: the whole sets of a component meet, in blocks if there are many, and are compared exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import FEW_ROWS, cleaned, flagged, forget, tune, written
from coppice.llm.components import connected_components

#: Holders of a key to a block; keys that more hold are split.
HOLDERS = 4000
#: Small sets are dealt by pairs of elements where more prefixes than this may hold the first one.
COMMON = 1000
#: Cells that keys are counted by before those of full cells are counted exactly.
CELLS = 1 << 16
#: Keys to split of which a table may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000
#: Set elements, and sets, to a block of a component.
ELEMENTS, MEMBERS = 1 << 19, 1024
#: Sets of a component up to which its pairs are compared together with those of others.
SMALL = 8
#: Cells to a piece of a table of word counts.
COUNTS = 1 << 12
#: Pairs compared at once.
PAIRS = 1 << 21
#: Sizes up to which a bitmap of 64, 128 and 256 bits tells sets apart; larger sets have none.
SHORT, MIDDLE, WIDE = 80, 200, 700
#: Bands of sizes of a pair's larger set, and the columns of their bitmaps.
BANDS = ((0, SHORT, ["_x"]), (SHORT, MIDDLE, ["_y0", "_y1"]), (MIDDLE, WIDE, ["_z0", "_z1", "_z2", "_z3"]), (WIDE, None, []))
#: The same where large sets are common. By far most of their pairs that share an element of the prefixes do so by
#: chance, and their number grows with the square of the sets', so that they would join more and more sets to one
#: component. Bitmaps of 256, 1024 and 4096 bits differ by chance in four standard deviations more bits than may
#: differ up to these sizes, at a similarity of 0.8 and more.
UPTO = (400, 2000, 8000)
ALL_BANDS = (*BANDS[:2], (MIDDLE, UPTO[0], ["_z0", "_z1", "_z2", "_z3"]), (UPTO[0], UPTO[1], [f"_v{i}" for i in range(16)]), (UPTO[1], UPTO[2], [f"_w{i}" for i in range(64)]), (UPTO[2], None, []))
#: Words of a bitmap from which only keys that may have a second holder get it.
LARGE_BITMAP = 16


def bitmap_columns(bands: tuple) -> tuple[str, ...]:
    return tuple(c for _, _, columns in bands for c in columns)


BITMAPS = bitmap_columns(BANDS)

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(30))
    h *= _M2
    h ^= h >> np.uint64(27)
    h *= _M3
    h ^= h >> np.uint64(31)
    return h


#: Bytes hashed at once, and to a word that is not hashed on its own.
PIECE, LONG = 1 << 16, 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _M1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_SPACE] = 0
_STEP = 0xD1342543DE82EF95
_POWER, _INVERSE = (np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(PIECE, x, dtype=np.uint64)])) for x in (_STEP, pow(_STEP, -1, 1 << 64)))


def words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words ``[^\\x20\\x09-\\x0D]+`` of bytes that end with white space; A-Z count as a-z.

    A word's hash is a polynomial of its bytes modulo 2**64, from running sums over the whole piece; one of
    more than ``LONG`` bytes, for which such polynomials may coincide by construction, is hashed on its own.
    """
    hashes, starts, lo = [], [], 0
    while lo < len(data):
        hi = min(len(data), lo + PIECE)
        space = (data[lo:hi] == 0x20) | (data[lo:hi] - np.uint8(0x09) < 5)
        if hi < len(data):
            ends = np.flatnonzero(space)
            if not len(ends):  # a word longer than a piece
                end = hi + int(np.argmax(_SPACE[data[hi:]]))
                hashes.append(np.array([xxhash.xxh3_64_intdigest(data[lo:end].tobytes().lower())], dtype=np.uint64))
                starts.append(np.array([lo]))
                lo = end
                continue
            hi = lo + int(ends[-1]) + 1
            space = space[: hi - lo]
        total = _BYTE.take(data[lo:hi])
        total *= _POWER[: hi - lo]
        np.cumsum(total, out=total)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        first, after = edge[::2], edge[1::2]  # each word ends within the piece, as white space ends it
        before = np.where(first > 0, total[first - 1], np.uint64(0))
        h = mixed((total[after - 1] - before) * _INVERSE[first] + (after - first).astype(np.uint64) * _M1)
        for w in np.flatnonzero(after - first > LONG):
            h[w] = xxhash.xxh3_64_intdigest(data[lo + first[w] : lo + after[w]].tobytes().lower())
        hashes.append(h)
        starts.append(first + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, a line feed after each, and where each ends."""
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    return data, np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))


def words_of_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of each text's."""
    data, ends = joined(texts)
    h, start = words_in(data)
    return h, np.diff(np.searchsorted(start, ends), prepend=0)


def binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def rarity(counts: np.ndarray) -> np.ndarray:
    """Classes 0 to 255 that grow with the counts."""
    return np.minimum(255, 6 * np.log2(1 + counts.astype(np.float64))).astype(np.uint8)


#: Elements from which an owner is sorted on its own, by all bits.
LARGE = 1 << 13


def ordered_sets(owner_sizes: np.ndarray, h: np.ndarray, rank: np.ndarray | None, hash_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's different elements, the rarest first: as rank << hash_bits | hash, whole hashes, and how many each has.

    h: elements, owner after owner (``owner_sizes`` of each); codes keep the first ``hash_bits`` bits. One sort
    of plain integers orders the sets of as many small owners as the bits left can number; in them, two
    elements are one if those first bits are equal.
    """
    bits = np.uint64(hash_bits)
    code = h >> np.uint64(64 - hash_bits)
    if rank is not None:
        code = code | rank.astype(np.uint64) << bits
    chunk = 1 << (56 - hash_bits)
    own = bits + np.uint64(8)
    edges = np.concatenate([[0], np.cumsum(owner_sizes)])
    places, sizes = [], []
    large = np.flatnonzero(owner_sizes > LARGE)
    lo = 0
    while lo < len(owner_sizes):
        if owner_sizes[lo] > LARGE:
            some = np.arange(edges[lo], edges[lo + 1])
            some = some[np.lexsort((h[some], code[some] >> bits))]
            some = some[np.concatenate([[True], h[some[1:]] != h[some[:-1]]])]
            places.append(some)
            sizes.append(np.array([len(some)]))
            lo += 1
            continue
        hi = min(lo + chunk, len(owner_sizes))
        nxt = np.searchsorted(large, lo)
        if nxt < len(large):
            hi = min(hi, int(large[nxt]))
        owner = np.repeat(np.arange(hi - lo, dtype=np.uint64), owner_sizes[lo:hi])
        key = owner << own | code[edges[lo] : edges[hi]]
        at = np.argsort(key)
        key = key[at]
        if len(key):
            first = np.concatenate([[True], key[1:] != key[:-1]])
            key, at = key[first], at[first]
        sizes.append(np.bincount((key >> own).astype(np.int64), minlength=hi - lo))
        places.append(at + edges[lo])
        lo = hi
    if not places:
        return code, h, np.zeros(0, dtype=np.int64)
    at = np.concatenate(places)
    return code[at], h[at], np.concatenate(sizes)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def prefixes(codes: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of ordered sets, set after set, and their lengths; small sets' are longer by one if that can be shared."""
    p = np.where(sizes > 0, prefix_length(sizes, num, den), 0)
    p += (sizes <= SHORT) & (overlap_needed(sizes, num, den) >= 2)
    inside = np.arange(len(codes)) - np.repeat(starts_of(sizes), sizes) < np.repeat(p, sizes)
    return codes[inside], p


def per_set(values: np.ndarray, sizes: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
    """``ufunc`` over each set's values; 0 for empty sets."""
    out = np.zeros(len(sizes), dtype=values.dtype)
    full = np.flatnonzero(sizes > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, starts_of(sizes)[full])
    return out


def digests(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's whole hashes."""
    return tuple(per_set(mixed(h * _M1 ^ np.uint64(salt)), sizes, np.add).view(np.int64) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def parities(h: np.ndarray, sizes: np.ndarray, words: int) -> list[np.ndarray]:
    """Bitmaps of 64 * ``words`` bits: an element flips a bit, so two differ in no more bits than their sets in elements."""
    at = mixed(h * _M1) & np.uint64(64 * words - 1)
    bit = np.uint64(1) << (at & np.uint64(63))
    return [per_set(np.where(at >> np.uint64(6) == w, bit, np.uint64(0)), sizes, np.bitwise_xor).view(np.int64) for w in range(words)]


def bitmaps(h: np.ndarray, sizes: np.ndarray, num: int, den: int, bands: tuple = BANDS) -> list[pa.Array]:
    """The bitmaps of each set, null where sets of its size are not compared by them."""
    out = []
    for above, upto, columns in bands:
        if not columns:
            continue
        words, has = len(columns), (sizes > above * num // den) & (sizes <= upto)
        part = parities(h[np.repeat(has, sizes)], sizes[has], words)
        at = np.cumsum(has) - 1
        out += [pa.array(np.where(has, w[at], 0) if len(w) else np.zeros(len(sizes), dtype=np.int64), mask=~has) for w in part]
    return out


def overlap_needed(n: np.ndarray | int, num: int, den: int):
    """Least intersection with any set that can be similar to one of n elements."""
    return -(-n * num // den)


def prefix_length(n: np.ndarray | int, num: int, den: int):
    return n - overlap_needed(n, num, den) + 1


def word_counts(docs: DataFrame, text_col: str, bits: int) -> np.ndarray:
    """Words of all texts counted by the last ``bits`` bits of their hashes: a table of fixed size.

    Each task's table leaves it in pieces of bytes, and tables are summed piece by piece.
    """
    mask = np.uint64((1 << bits) - 1)
    cells = min(1 << bits, COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            h, _ = words_of_texts(binary(batch.column(0)))
            total += np.bincount((h & mask).astype(np.int64), minlength=1 << bits)
        yield from pieces(dict(enumerate(total.reshape(-1, cells))))

    def pieces(of: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        full = [b for b, n in of.items() if n.any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, type=pa.int32()), pa.array([of[b].tobytes() for b in full], type=pa.binary())], names=["_b", "_n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(n.as_buffer(), dtype=np.int64)
        yield from pieces(total)

    tune(docs.sparkSession, FEW_ROWS)
    kind = "_b int, _n binary"
    with cleaned(docs.sparkSession):
        rows = docs.select(text_col).mapInArrow(count, kind).repartition("_b").mapInArrow(add, kind).toArrow()
    out = np.zeros(((1 << bits) // cells, cells), dtype=np.int64)
    for b, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        out[b] = np.frombuffer(n, dtype=np.int64)
    return out.reshape(-1)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], enough: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by integer keys: tables of whole runs of a key, with the runs' starts (and the end)."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def starts(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, t.num_rows - 1), dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= enough:
            t = pa.Table.from_batches(held)
            s = starts(t)
            if len(s) > 2:
                yield t.slice(0, int(s[-2])), s[:-1]
            t = t.slice(int(s[-2])).combine_chunks()
            held = t.to_batches()
            rows = 0  # the rest waits for as many rows again, so a long run is not looked through again and again
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def group_labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least number joined to each of 0..n-1 by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
        i, j = i[differ], j[differ]


def similar_runs(start: np.ndarray, n: np.ndarray, pos: np.ndarray, x: list[np.ndarray], free: np.ndarray, side: np.ndarray, cross: np.ndarray, above: int, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in the same run, sorted by size, that pass the filters and are not both of ``above`` elements or fewer.

    x: the words of the bitmaps, none if there are no bitmaps; ``free`` rows have none either. cross: only rows of different sides.
    """
    total = len(n)
    run = np.repeat(np.arange(len(start) - 1), np.diff(start))
    wide = np.int64(n.max(initial=0)) * den // num + 2
    end = np.searchsorted(run * wide + n, run * wide + n * den // num, side="right")
    counts = np.maximum(end - np.arange(total) - 1, 0)
    upto = np.cumsum(counts)
    lo = 0
    while lo < total:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        c = counts[lo:hi]
        if c.sum():
            i = np.repeat(np.arange(lo, hi), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + i + 1
            both = n[i] + n[j]
            need = -(-num * both // (num + den))
            ok = (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need) & (n[j] > above)
            ok &= ~cross[i] | (side[i] != side[j])
            i, j, both, need = i[ok], j[ok], both[ok], need[ok]
            ok = sum((np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in x), np.zeros(len(i), dtype=np.int64)) <= both - 2 * need
            ok |= free[i] | free[j]
            yield i[ok], j[ok]
        lo = hi


def _cell(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")


def full_cells(entries: DataFrame, more_than: int) -> tuple[DataFrame, int]:
    """``_c``: the cells that more entries than that fall into, and how many: CELLS at most."""
    rows = entries.groupBy(_cell(F.col("_e")).alias("_c")).count().where(F.col("count") > more_than).select("_c").collect()
    return F.broadcast(entries.sparkSession.createDataFrame(rows, "_c int")), len(rows)


def keys_of(items: DataFrame, columns: list[str], num: int, den: int, pairs: bool) -> tuple[DataFrame, bool]:
    """``_e, _pos`` and ``columns``: an item's keys, and where in its set the key's (first) element lies; whether some may be hot.

    A key is an element of the prefix, or if ``pairs`` and its cell is common, the element with each later one
    of the prefix longer by one: the two first elements that similar sets share lie in both prefixes.
    """
    n = F.col("_n")
    p = (n - F.floor((n * num + den - 1) / den) + 1).cast("int")
    single = items.select(*columns, "_prefix", p.alias("_p"), F.posexplode(F.slice("_prefix", F.lit(1), F.greatest(p, F.lit(1)))).alias("_pos", "_e"))
    if not pairs:
        return single.drop("_prefix", "_p"), True
    common, some = full_cells(single, COMMON)
    if not some:
        return single.drop("_prefix", "_p"), HOLDERS < COMMON
    marked = single.withColumn("_c", _cell(F.col("_e"))).join(common.withColumn("_common", F.lit(True)), "_c", "left").drop("_c")
    # A prefix that is not longer by one belongs to a set that is similar to none but equal ones.
    second = F.slice("_prefix", F.col("_pos") + 2, F.greatest(F.col("_p") - F.col("_pos"), F.lit(0)))
    spread = marked.withColumn("_e2", F.explode(F.when(F.col("_common"), second).otherwise(F.array(F.lit(None).cast("long")))))
    return spread.withColumn("_e", F.when(F.col("_e2").isNull(), F.col("_e")).otherwise(F.xxhash64("_e", "_e2"))).select(*columns, "_pos", "_e"), True


def in_blocks(entries: DataFrame, hot: bool) -> DataFrame:
    """Adds ``_run`` (the key, and if keys are split a hash of it and the pair of blocks), ``_cross`` (1 if that is of two blocks)
    and ``_side`` (1 if in the later one of two) to entries with ``_e`` and ``_item``.

    Keys of more than HOLDERS entries are split into blocks of about as many; each block meets all others. Where two
    runs' hashes coincide, they are compared as one, which loses no pair.
    """
    cells, some = full_cells(entries, HOLDERS) if hot else (None, 0)
    if not some:
        return entries.select("*", F.col("_e").alias("_run"), F.lit(0).alias("_cross"), F.lit(0).alias("_side"))
    heavy = entries.withColumn("_c", _cell(F.col("_e"))).join(cells, "_c").groupBy("_e").count().where(F.col("count") > HOLDERS)
    heavy = written(heavy.select("_e", F.ceil(F.col("count") / HOLDERS).cast("int").alias("_k")), "common-keys")
    few = heavy.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    dealt = entries.join(F.broadcast(heavy) if few else heavy, "_e", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("_item"), F.col("_k")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    run, cross, side = F.xxhash64("_e", F.least("_b", "_o"), F.greatest("_b", "_o")), F.col("_b") != F.col("_o"), F.col("_b") > F.col("_o")
    return dealt.select("*", run.alias("_run"), cross.cast("int").alias("_cross"), side.cast("int").alias("_side")).drop("_k", "_b", "_o")


def candidate_edges(items: DataFrame, num: int, den: int, above: int, upto: int | None, bitmap: list[str]) -> DataFrame:
    """``src, dst``: a spanning forest, task by task, of the pairs of items that pass the filters.

    Pairs whose larger set has more than ``above`` and at most ``upto`` elements. items: ``_item`` (long,
    unique), ``_n`` (size), ``_prefix`` (array of long), the bitmap's words as long columns, and ``_free`` (1 where
    the bitmap does not hold for all that the item stands for).
    """
    spark = items.sparkSession
    items = items.where(F.col("_n") > above * num // den)
    if upto is not None:
        items = items.where(F.col("_n") <= upto)
    with cleaned(spark):
        columns = ["_item", "_n", "_free"]
        if len(bitmap) < LARGE_BITMAP:
            keys, hot = keys_of(items, [*columns, *bitmap], num, den, pairs=upto is not None and upto <= SHORT)
        else:
            held = keys_of(items, ["_item"], num, den, pairs=False)[0].groupBy("_e").count().where("count > 1").select("_e")
            held = written(held, "held-keys")
            keys, hot = keys_of(items, [*columns, *bitmap], num, den, pairs=False)
            keys = flagged(keys, "_e", held, "_e", "_maybe").where("_maybe").drop("_maybe")
        dealt = in_blocks(keys, hot)
    # Size, place, sides and freedom in one long. Spark sorts by one long, the run; a run's few rows are put in order of size here.
    packed = F.shiftleft(F.col("_n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("_pos").cast("long"), 3)).bitwiseOR((F.col("_cross") * 4 + F.col("_side") * 2 + F.col("_free")).cast("long"))
    dealt = dealt.select("_run", packed.alias("_w"), *bitmap, "_item")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in runs(batches, ["_run"]):
            w = t.column("_w").to_numpy()
            n = w >> 32
            order = np.argsort(np.repeat(np.arange(len(start) - 1), np.diff(start)) * (n.max() + 1) + n)
            item, n, w = t.column("_item").to_numpy()[order], n[order], w[order]
            x = [t.column(k).to_numpy().view(np.uint64)[order] for k in bitmap]
            ids, of = np.unique(item, return_inverse=True)
            label = np.arange(len(ids))
            for i, j in similar_runs(start, n, (w & 0xFFFFFFFF) >> 3, x, w & 1 == 1, w >> 1 & 1, w & 4 == 4, above, num, den):
                a, b = label[of[i]], label[of[j]]
                a, b = a[a != b], b[a != b]
                if len(a):
                    label = group_labels(a, b, len(ids))[label]
            moved = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["src", "dst"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    try:
        return written(dealt.repartition("_run").sortWithinPartitions("_run").mapInArrow(compare, "src long, dst long").distinct(), "candidates")
    finally:
        tune(spark)
        if len(bitmap) >= LARGE_BITMAP:
            forget(held)


def candidate_components(items: DataFrame, num: int, den: int, bands: tuple = BANDS) -> DataFrame:
    """``_item, _comp`` of the items that some other one may be similar to.

    items: as in ``candidate_edges`` with the bands' bitmaps. Bands of sizes have bitmaps that suit them, so that hardly
    any pair passes by chance.
    """
    found = [candidate_edges(items, num, den, above, upto, bitmap) for above, upto, bitmap in bands]
    parts = connected_components(functools.reduce(DataFrame.unionByName, found))
    forget(*found)
    return parts.select(F.col("node").alias("_item"), F.col("component").alias("_comp"))


def block_plan(members: DataFrame, size_col: str = "_n") -> DataFrame:
    """``_comp, _k``: blocks that a component is dealt into, by its elements; only components of two items or more."""
    sizes = members.groupBy("_comp").agg(F.sum(size_col).alias("_s"), F.count("*").alias("_c")).where("_c > 1")
    return sizes.select("_comp", F.ceil(F.greatest(F.col("_s") / ELEMENTS, F.col("_c") / MEMBERS)).cast("int").alias("_k"))


class Overlaps:
    """Intersections of one set with all others of a group, by the elements' holders."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.n = np.diff(offsets)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        elements, ids, counts = np.unique(values, return_inverse=True, return_counts=True)
        order = np.argsort(ids, kind="stable")
        self.owner, self.first = owner[order], np.concatenate([[0], np.cumsum(counts)])
        self.ids, self.offsets, self.shared = ids, offsets, counts > 1

    def of(self, i: int) -> np.ndarray:
        ids = self.ids[self.offsets[i] : self.offsets[i + 1]]
        ids = ids[self.shared[ids]]
        size = self.first[ids + 1] - self.first[ids]
        at = np.repeat(self.first[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.bincount(self.owner[at], minlength=len(self.n))

    def similar(self, i: int, num: int, den: int) -> np.ndarray:
        """Others that i is similar to, as a mask."""
        shared = self.of(i)
        ok = shared * den >= num * (self.n[i] + self.n - shared)
        ok[i] = False
        return ok


def similar_pairs(values: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets i and j are similar, for many pairs at once. values: the sets' elements, set after set."""
    out = np.zeros(len(i), dtype=bool)
    _, ids = np.unique(values, return_inverse=True)
    n, wide = np.diff(offsets), np.int64(len(values) + 1)
    upto = np.cumsum(n[i] + n[j])
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        two = np.stack([i[lo:hi], j[lo:hi]], axis=1).ravel()
        size = n[two]
        at = np.arange(size.sum()) + np.repeat(offsets[two] - starts_of(size), size)
        key = np.repeat(np.arange(len(two)) // 2, size) * wide + ids[at]
        key.sort()
        shared = np.bincount(key[1:][key[1:] == key[:-1]] // wide, minlength=hi - lo)
        out[lo:hi] = shared * den >= num * (n[i[lo:hi]] + n[j[lo:hi]] - shared)
        lo = hi
    return out


def pairs_of_runs(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows of runs of ``SMALL`` rows or fewer."""
    size = np.diff(start)
    own = np.repeat(np.arange(len(size)), size)
    n = np.where(size[own] <= SMALL, start[1:][own] - np.arange(len(own)) - 1, 0)
    i = np.repeat(np.arange(len(own)), n)
    return i, np.arange(len(i)) - np.repeat(starts_of(n), n) + i + 1


def verified(sets: DataFrame, compare: Callable[[dict, Overlaps], tuple[list, list]], columns: list[str], pairs: Callable[[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """``_left, _right`` (long) that ``compare`` returns for each component or pair of its blocks.

    sets: ``_comp, _k, _item, _set`` (array of long) and ``columns`` (long), one row for each item. compare gets
    the columns as arrays (also ``_item``, and ``_side``: 0 and 1 where two blocks meet, else 0) and the overlaps.
    ``pairs``, if given, answers for all components of ``SMALL`` items or fewer at once: it gets the columns, the sets'
    elements and their bounds, and the pairs of rows.
    """
    spark = sets.sparkSession
    dealt = sets.withColumn("_b", F.pmod(F.xxhash64("_item"), F.col("_k")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    dealt = dealt.select("_comp", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"), "_b", "_item", "_set", *columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in runs(batches, ["_comp", "_lo", "_hi"], 512):
            t = t.combine_chunks()
            sets_ = t.column("_set").chunk(0) if t.num_rows else None
            c = {k: t.column(k).to_numpy() for k in ("_item", "_b", "_lo", "_hi", *columns)}
            left, right = [], []
            if pairs:
                values, offsets = sets_.flatten().to_numpy(), sets_.offsets.to_numpy().astype(np.int64)
                x, y = pairs(c | {"_side": (c["_b"] != c["_lo"]).astype(int)}, values, offsets - offsets[0], *pairs_of_runs(start))
                left += x.tolist()
                right += y.tolist()
            for a, b in zip(start[:-1], start[1:], strict=True):
                if b - a < 2 or pairs and b - a <= SMALL:
                    continue
                part = sets_.slice(a, b - a)
                values, offsets = part.flatten().to_numpy(), part.offsets.to_numpy()
                part_c = {k: v[a:b] for k, v in c.items()} | {"_side": (c["_b"][a:b] != c["_lo"][a:b]).astype(int)}
                x, y = compare(part_c, Overlaps(values, offsets - offsets[0]))
                left += x
                right += y
            yield pa.RecordBatch.from_arrays([pa.array(left, type=pa.int64()), pa.array(right, type=pa.int64())], names=["_left", "_right"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return dealt.repartition("_comp", "_lo", "_hi").sortWithinPartitions("_comp", "_lo", "_hi", "_item").mapInArrow(work, "_left long, _right long")


def spanning_links(num: int, den: int) -> Callable[[dict, Overlaps], tuple[list, list]]:
    """For ``verified``: a spanning forest of the links between similar items."""

    def links(c: dict, over: Overlaps) -> tuple[list, list]:
        item, side = c["_item"], c["_side"]
        m = len(item)
        label = np.arange(m)
        left, right = [], []
        split = bool(side.any())
        for i in range(m):
            if split and side[i]:
                continue
            open_ = label != label[i]
            if split:
                open_ &= side == 1
            if not open_.any():
                if not split and (label == label[0]).all():
                    break
                continue
            hit = np.flatnonzero(over.similar(i, num, den) & open_)
            for j in hit:
                if label[j] != label[i]:
                    left.append(int(item[i]))
                    right.append(int(item[j]))
                    label[label == label[j]] = label[i]
        return left, right

    return links


def repeated_later(num: int, den: int) -> Callable[[dict, Overlaps], tuple[list, list]]:
    """For ``verified``: items (twice) to which an item earlier by (``_doc``, ``_line``) is similar."""

    def later(c: dict, over: Overlaps) -> tuple[list, list]:
        item, side = c["_item"], c["_side"]
        order = np.lexsort((c["_line"], c["_doc"]))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        gone = np.zeros(len(item), dtype=bool)
        split = bool(side.any())
        for i in order:
            open_ = ~gone & (rank > rank[i]) & (item != item[i])
            if split:
                open_ &= side != side[i]
            if open_.any():
                gone |= over.similar(i, num, den) & open_
        out = [int(x) for x in item[gone]]
        return out, out

    return later


def repeated_pairs(num: int, den: int) -> Callable[[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """What ``repeated_later`` finds, for ``verified`` as ``pairs``."""

    def later(c: dict, values: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Where a component is split, the rows of one block alone meet elsewhere.
        ok = (c["_item"][i] != c["_item"][j]) & ((c["_side"][i] != c["_side"][j]) | (c["_lo"][i] == c["_hi"][i]))
        i, j = i[ok], j[ok]
        ok = similar_pairs(values, offsets, i, j, num, den)
        i, j = i[ok], j[ok]
        doc, line = c["_doc"], c["_line"]
        out = c["_item"][np.unique(np.where((doc[i] > doc[j]) | ((doc[i] == doc[j]) & (line[i] > line[j])), i, j))]
        return out, out

    return later
