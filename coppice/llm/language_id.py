"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree of order ``ORDER`` is counted on a bounded sample of labelled texts and then
frozen. A byte seen c times after a context (n bytes seen there, d of them different) has probability
c / (n + d); any other byte escapes with d / (n + d) to the next shorter context, whose distribution is
renormalised over the bytes not seen in the longer one (exclusion). Below order 0 all 256 bytes are equally
likely, so every text has an exact, finite code length. The language with the shortest code wins.

Frozen statistics make a byte's code length a function of its context alone. A byte that was not seen costs the
context's escape (with the renormalisation) plus what the shorter context takes for it, so only what some
language has seen is stored: for each (context, byte) and for each context's escape one row of bits by
language, found through a hash table. The model is as large as the sample, whatever the alphabets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.common import column, sampled_ids, tune

ORDER = 3
#: Labelled texts that the trees are counted on, for each language; those with the least hash of the id.
SAMPLE = 300
#: Texts of all labels together at most.
SAMPLE_TOTAL = 6000
#: Bytes of a text that the trees are counted on at most: one very long text must not be most of the sample.
SAMPLE_BYTES = 20_000
#: A context of two bytes or more that a language's sample holds less often is left to the shorter one.
LEAST_SEEN = 3
#: Labels of which the sample holds fewer texts are not learned unless no label has so many.
LEAST_TEXTS = 3
#: Bytes scored at once, which bounds a worker's memory.
CHUNK = 1 << 20
#: Bytes that the score takes as evidence at most.
SHARP = 32
UNDECIDED = "und"
_WORDS = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(any(map(str.isalpha, m.group())) for m in _WORDS.finditer(text))


class _Rows:
    """Rows of bits by a number, in an open hash table; ``find`` gives the row's index, or -1."""

    def __init__(self, numbers: np.ndarray, bits: np.ndarray):
        self.bits = np.ascontiguousarray(bits, dtype=np.float32)
        self.power = max(4, int(4 * len(numbers)).bit_length())
        self.keys = np.full(1 << self.power, -1, dtype=np.int64)
        self.at = np.zeros(1 << self.power, dtype=np.int32)
        left, slot = np.arange(len(numbers)), self._slot(numbers)
        while len(left):  # of those that want a free slot the first takes it; the others go on to the next slot
            free = self.keys[slot] < 0
            takers, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[takers], self.at[takers] = numbers[left[placed]], left[placed]
            rest = np.ones(len(left), dtype=bool)
            rest[placed] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        # Multiplicative hashing by the golden ratio.
        return (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.power)).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        slot = self._slot(numbers)
        held = self.keys[slot]
        out = np.where(held == numbers, self.at[slot], -1)
        on = np.flatnonzero((held != numbers) & (held >= 0))
        while len(on):
            slot_on = slot[on] = (slot[on] + 1) & (len(self.keys) - 1)
            held = self.keys[slot_on]
            hit = held == numbers[on]
            out[on[hit]] = self.at[slot_on[hit]]
            on = on[~hit & (held >= 0)]
        return out


class ContextTrees:
    """Frozen statistics of all languages: bits of what was seen, and of escapes, for each order."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.languages = sorted(texts)
        self.order = order
        joined = {lang: np.frombuffer(b"\n".join([b"\n" * order, *texts[lang]]), dtype=np.uint8) for lang in self.languages}
        seen = np.unique(np.concatenate([np.array([10], dtype=np.uint8), *joined.values()]))
        self.symbols = len(seen) + 1  # the last stands for every byte that the sample lacks
        self.fold = np.full(256, len(seen), dtype=np.int32)
        self.fold[seen] = np.arange(len(seen))
        self.newline = int(self.fold[10])
        self.pairs: list[_Rows] = []
        self.escapes: list[_Rows] = []
        s, folded = self.symbols, [self.fold[joined[lang]].astype(np.int64) for lang in self.languages]
        for k in range(order + 1):
            counted = [np.unique(self._numbers(a, k + 1), return_counts=True) for a in folded]
            counted = [self._frequent(g, c) for g, c in counted] if k >= 2 else counted
            pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(g for g, _ in counted)]))
            contexts, of = np.unique(pairs // s, return_inverse=True)
            bits = self._bits_at(pairs % s**k, k - 1).astype(np.float64)  # of the shorter context, for now
            escapes = np.zeros((len(contexts), len(self.languages)))
            for j, (g, c) in enumerate(counted):
                count = np.zeros(len(pairs))
                count[np.searchsorted(pairs, g)] = c
                sums = lambda w, of=of, n=len(contexts): np.bincount(of, weights=w, minlength=n)
                total, distinct = sums(count), sums(count > 0)
                rest = np.maximum(1 - sums(np.where(count > 0, np.exp2(-bits[:, j]), 0)), 1e-12)  # of the bytes not seen
                known = total > 0  # a context that this language has not seen codes as its shorter one does
                escapes[known, j] = np.log2(rest[known] * (total + distinct)[known] / distinct[known])
                bits[:, j] = np.where(count > 0, np.log2(np.maximum(total + distinct, 1)[of] / np.maximum(count, 1)), escapes[of, j] + bits[:, j])
            self.pairs.append(_Rows(pairs, bits))
            self.escapes.append(_Rows(contexts, escapes))

    def _bits_at(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Bits by language of each gram's last symbol after the k symbols before it; below order 0 all bytes are alike."""
        if k < 0:
            return np.full((len(grams), len(self.languages)), 8, dtype=np.float32)
        row = self.pairs[k].find(grams)
        out = self.pairs[k].bits[row] if len(self.pairs[k].bits) else np.zeros((len(grams), len(self.languages)), dtype=np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            bits = self._bits_at(grams[miss] % self.symbols**k, k - 1)
            context = self.escapes[k].find(grams[miss] // self.symbols)
            known = context >= 0
            bits[known] += self.escapes[k].bits[context[known]]
            out[miss] = bits
        return out

    def _numbers(self, a: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(max(0, len(a) - length + 1), dtype=np.int64)
        for i in range(length):
            out = out * self.symbols + a[i : i + len(out)]
        return out

    def _frequent(self, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, at = np.unique(grams // self.symbols, return_inverse=True)
        keep = np.bincount(at, weights=counts)[at] >= LEAST_SEEN if len(at) else np.zeros(0, dtype=bool)
        return grams[keep], counts[keep]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language; a text starts after ``order`` line ends."""
        out = np.zeros((len(texts), len(self.languages)))
        pad = b"\n" * self.order
        group: list[int] = []
        held = 0
        for i, t in enumerate(texts):
            group.append(i)
            held += len(t)
            if held >= CHUNK or i == len(texts) - 1:
                data = np.frombuffer(pad.join([b"", *(texts[j] for j in group)]), dtype=np.uint8)
                starts = np.cumsum([0, *(len(texts[j]) + self.order for j in group)])
                for lo in range(0, len(data), 2 * CHUNK):
                    out_rows = self._bits_of(data, lo, min(len(data), lo + 2 * CHUNK), starts)
                    out[group] += out_rows
                group, held = [], 0
        return out

    def _bits_of(self, data: np.ndarray, lo: int, hi: int, starts: np.ndarray) -> np.ndarray:
        """Sums by text over data[lo:hi]; the bytes of the padding count nothing."""
        first = max(0, lo - self.order)
        a = self.fold[data[first:hi]]
        a = np.concatenate([np.full(self.order - (lo - first), self.newline, dtype=np.int32), a])
        bits = self._bits_at(self._numbers(a, self.order + 1), self.order)
        pads = (starts[:-1, None] + np.arange(self.order)).ravel()
        pads = pads[(pads >= lo) & (pads < hi)] - lo
        bits[pads] = 0
        out = np.zeros((len(starts) - 1, bits.shape[1]))
        inside = np.clip(starts, lo, hi) - lo
        full = np.flatnonzero(np.diff(inside) > 0)
        if len(full):
            out[full] = np.add.reduceat(bits, inside[full], axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, least: int = LEAST_TEXTS) -> ContextTrees:
    """Trees of ``sample`` texts of each label at most, chosen by a hash of the id over all labelled rows.

    Of a longer text ``SAMPLE_BYTES`` bytes are counted, so that a label of long texts alone is learned as well.
    """
    given = docs.where(column(lang_col).isNotNull() & column(text_col).isNotNull())
    rows = given.select(column(id_col).alias("_id"), column(lang_col).alias("_lang"), column(text_col).alias("_text"))
    chosen = sampled_ids(rows.select("_id", "_lang"), "_id", "_lang", sample, SAMPLE_TOTAL)
    part = F.substring(F.encode("_text", "UTF-8"), 1, SAMPLE_BYTES).alias("_text")
    rows = rows.join(chosen, ["_id", "_lang"], "left_semi").select("_id", "_lang", part).orderBy("_lang", "_id", "_text").collect()
    texts: dict[str, list[bytes]] = {}
    for r in rows:
        texts.setdefault(r["_lang"], []).append(bytes(r["_text"]))
    return ContextTrees({k: v for k, v in texts.items() if len(v) >= least} or texts)


def predict(docs: DataFrame, trees: ContextTrees, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``bits_per_byte`` to the rows of ``docs``; columns of these names are replaced.

    A null text, or one without letters, is ``und`` with score 0 and null bits. The score is the share of the
    best language if code lengths a byte are taken as log-likelihoods of ``SHARP`` bytes; a tie goes to the
    language that sorts first. With nothing learned every text is ``und``.
    """
    docs = docs.select(*(column(c) for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")))
    given, at_text = docs.columns, docs.columns.index(text_col)
    names = np.array([*trees.languages, UNDECIDED], dtype=object)
    frozen = docs.sparkSession.sparkContext.broadcast(trees)  # its size is bounded by the sample's

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = frozen.value
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            data = [t.encode("utf-8", "replace") if t is not None else b"" for t in texts]
            known = np.array([has_letter(t) for t in texts], dtype=bool) & bool(model.languages)
            pick, share, rate = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if known.any():
                at = np.flatnonzero(known)
                size = np.array([len(data[i]) for i in at])
                bits = model.code_lengths([data[i] for i in at]) / size[:, None]
                pick[at] = bits.argmin(1)
                rate[at] = bits.min(1)
                weight = np.exp2((bits.min(1, keepdims=True) - bits) * np.minimum(size, SHARP)[:, None])
                share[at] = 1 / weight.sum(1)
            added = [pa.array(names[pick], type=pa.string()), pa.array(share), pa.array(rate, mask=np.isnan(rate))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "lang_pred", "score", "bits_per_byte"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    tune(docs.sparkSession)
    plain = docs.toDF(*(f"_{i}" for i in range(len(given))))  # names may hold dots, which columns by name do not bear
    return plain.mapInArrow(score, T.StructType([*plain.schema.fields, *added])).toDF(*given, *(f.name for f in added))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score``: one row for each row, whole texts.

    Learns only from the text and non-null label of rows whose crc32(id as text) mod 4 is not 2; the label, the
    source and the id are no input of a prediction. A null id counts as not held out. Rows may repeat; other
    columns are not looked at. An empty table gives an empty result.
    """
    held = F.coalesce(F.crc32(column(id_col).cast("string")) % 4 == 2, F.lit(False))
    trees = train(docs.where(~held), id_col, text_col, lang_col)
    rows = docs.select(column(id_col), held.alias("held_out"), column(text_col).alias("_text"))
    return predict(rows, trees, "_text").drop("_text")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")
