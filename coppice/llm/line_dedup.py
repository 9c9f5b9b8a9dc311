"""Line dedup by an exact set-similarity join of lines.

A line is its set of words (A-Z in lower case). Equal sets are one class; classes are joined by prefix,
positional and length filters with the rarest words first (see ``setjoin``), and what passes is verified on
the whole sets. A line goes if a line before it, by document and then by place, is similar to it, whether
that one goes itself or not. Lines of fewer than ``least`` different words always stay.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm import setjoin as S
from coppice.llm.common import FEW_ROWS, column, flagged, forget, list_array, tune, written
from coppice.llm.ngram_join import LONGS, id_or_least

#: Different words that a line must have to be compared, and the least Jaccard similarity.
LEAST, NUM, DEN = 5, 80, 100
#: The query compares every line that has a word.
QUERY_LEAST = 1
#: Bits of the table of word counts, and of a word's hash.
BITS, HASH_BITS = 18, 44


def line_sets(texts: list[bytes | None], classes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each line's different words, the rarest first, as codes and as hashes, and their number; and the number of lines of each text."""
    data, ends = S.joined(texts)
    feeds = np.flatnonzero(data == 10)  # the joined texts' lines: each ends with a line feed
    h, start = S.words_in(data)
    rank = classes[(h & np.uint64(len(classes) - 1)).astype(np.int64)] if classes is not None else None
    codes, whole, sizes = S.ordered_sets(np.diff(np.searchsorted(start, feeds), prepend=0), h, rank, HASH_BITS)
    return codes, whole, sizes, np.diff(np.searchsorted(feeds, ends), prepend=0)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, num: int = NUM, den: int = DEN) -> DataFrame:
    """``_doc, _gone``: for each document that loses lines, their numbers from 0 (``_doc`` is the id, the least long if null)."""
    spark = docs.sparkSession
    tune(spark, FEW_ROWS)
    rows = docs.select(id_or_least(id_col).alias("_doc"), column(text_col).alias("_text"))
    table = spark.sparkContext.broadcast(S.rarity(S.word_counts(rows, "_text", BITS)))  # of fixed size

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, whole, sizes, lines = line_sets(S.binary(batch.column(1)), table.value)
            long = sizes >= least
            inside = np.repeat(long, sizes)
            codes, whole, n = codes[inside], whole[inside], sizes[long]
            doc = np.repeat(batch.column(0).to_numpy(), lines)[long]
            place = (np.arange(len(sizes)) - np.repeat(S.starts_of(lines), lines))[long]
            prefix, p = S.prefixes(codes, n, num, den)
            words = [*(pa.array(d) for d in S.digests(whole, n)), *S.bitmaps(whole, n, num, den)]
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(n), *words, list_array(prefix.view(np.int64), p, pa.int64())], names=["_doc", "_line", "_n", *LONGS, "_prefix"])

    lines = written(rows.mapInArrow(split, f"_doc long, _line long, _n long, {', '.join(f'{c} long' for c in LONGS)}, _prefix array<long>"), "lines", hashes=True)
    digest = ["_d1", "_d2"]
    # A class is found by digests alone; of lines that do not repeat, nothing else is shuffled. Those that may
    # repeat are joined by their place, so that a very common line is no hot key.
    found = written(lines.groupBy(*digest).agg(F.min(F.struct("_doc", "_line")).alias("_m"), F.count("*").alias("_c")).select(*digest, "_c", "_m.*"), "line-digests", hashes=True)
    repeated = found.where("_c > 1")
    marked = flagged(lines, "_d1", repeated, "_d1", "_maybe")
    once = marked.where("not _maybe").withColumn("_c", F.lit(1).cast("long")).drop("_maybe")
    place = ["_doc", "_line", *digest]
    again = marked.where("_maybe").join(flagged(found, "_d1", repeated, "_d1", "_hit").where("_hit").drop("_hit"), place).select(*once.columns).dropDuplicates(place)  # rows may share an id
    classes = written(once.unionByName(again).withColumn("_item", F.monotonically_increasing_id()), "line-classes", hashes=True)
    forget(found)

    comps = S.candidate_components(classes.select("_item", "_n", "_prefix", *LONGS[2:], F.lit(0).alias("_free")), num, den)
    comps = written(comps.withColumnRenamed("_item", "_member"), "components")
    few = flagged(classes.select("_item", "_doc", "_line", "_n", *digest), "_item", comps, "_member", "_maybe").where("_maybe")
    members = written(few.join(comps, F.col("_item") == F.col("_member")).drop("_member", "_maybe"), "members")
    wanted = members.join(S.block_plan(members), "_comp").groupBy("_doc").agg(F.collect_list(F.struct("_line", "_item", "_comp", "_k", *digest)).alias("_want"))
    wanted = written(wanted.withColumnRenamed("_doc", "_at"), "wanted")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lines_ = [], []
            for doc, text, want in zip(batch.column(0).to_pylist(), S.binary(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = text.split(b"\n") if text else []
                for w in want:
                    if w["_line"] < len(own):
                        out.append((w["_comp"], w["_k"], w["_item"], doc, w["_line"], w["_d1"], w["_d2"]))
                        lines_.append(own[w["_line"]])
            _, whole, n, _ = line_sets(lines_, None)
            d1, d2 = S.digests(whole, n)
            rows_ = np.array(out, dtype=np.int64).reshape(len(out), 7)
            same = (rows_[:, 5] == d1) & (rows_[:, 6] == d2)  # rows may share an id
            columns = [pa.array(rows_[same, c]) for c in range(5)]
            columns[1] = columns[1].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, list_array(whole[np.repeat(same, n)].view(np.int64), n[same], pa.int64())], names=["_comp", "_k", "_item", "_doc", "_line", "_set"])

    few = flagged(rows, "_doc", wanted, "_at", "_maybe").where("_maybe")
    sets = few.join(wanted, F.col("_doc") == F.col("_at")).select("_doc", "_text", "_want").mapInArrow(expand, "_comp long, _k int, _item long, _doc long, _line long, _set array<long>")
    gone = written(S.verified(sets, S.repeated_later(num, den), ["_doc", "_line"], S.repeated_pairs(num, den)).select("_left").distinct(), "repeated")
    forget(comps, members, wanted)
    tune(spark)
    # Lines can only go if their class occurs again or has an earlier like.
    marked = flagged(classes.select(*digest, "_c", F.col("_doc").alias("_doc0"), F.col("_line").alias("_line0"), "_item"), "_item", gone, "_left", "_maybe")
    hit = marked.where("_maybe").join(gone, F.col("_item") == F.col("_left"), "left")
    rest = marked.where("not _maybe and _c > 1").withColumn("_left", F.lit(None).cast("long"))
    first = written(hit.where("_left is not null or _c > 1").select(*rest.columns).unionByName(rest).drop("_maybe", "_item", "_c"), "suspects")
    some = flagged(lines.select("_doc", "_line", *digest), "_d1", first, "_d1", "_maybe").where("_maybe").drop("_maybe")
    later = some.join(first, digest).where("_left is not null or _doc != _doc0 or _line != _line0")
    out = written(later.groupBy("_doc").agg(F.array_sort(F.collect_set("_line")).alias("_gone")), "gone-lines")
    forget(lines, classes, gone, first)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of their text, and ``n_lines``, ``n_removed``, ``n_compared``.

    Lines end at a line feed and are otherwise kept as they are, in their order. n_lines counts the lines of
    the old text (null: 0), n_compared those left of ``least`` words or more (null where no line was
    removed). A null text stays null. Rows that
    share an id are one document: lines at the same place of it are not repeats of each other. A null id
    counts as the smallest. Input columns of the added names are replaced, others returned untouched, whatever
    their names. Very long lines are compared whole. An empty table gives an empty result.
    """
    gone = repeated_lines(docs, id_col, text_col, least, num, den)
    added = ("n_lines", "n_removed", "n_compared")
    packed = docs.select(id_or_least(id_col).alias("_doc"), F.struct(*[column(c) for c in docs.columns if c not in added]).alias("_in"))
    # Texts that lose no line stay where they are.
    marked = flagged(packed, "_doc", gone, "_doc", "_maybe")
    whole = marked.where("not _maybe").withColumn("_gone", F.lit(None).cast("array<bigint>"))
    # Lines gone grow with the input: the join is the same at every size.
    # A document has one row of them at most, so they are hashed, and texts need no sort.
    joined = marked.where("_maybe").join(gone.hint("shuffle_hash"), "_doc", "left").select(*whole.columns).unionByName(whole)
    old = F.col("_in")[text_col]
    removed = F.coalesce("_gone", F.array().cast("array<bigint>"))
    left = F.filter(F.split(old, "\n", -1), lambda _, i: ~F.array_contains(removed, i.cast("long")))
    text = F.when(F.col("_gone").isNull(), old).otherwise(F.array_join(left, "\n"))
    n_lines = F.octet_length(old) - F.octet_length(F.replace(old, F.lit("\n"), F.lit(""))) + 1
    size = lambda line: F.size(F.array_distinct(F.filter(F.split(F.translate(line, string.ascii_uppercase, string.ascii_lowercase), r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    columns = [(text if c == text_col else F.col("_in")[c]).alias(c) for c in docs.columns if c not in added]
    return joined.select(
        *columns,
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"),
        F.when(F.size(removed) > 0, F.size(F.filter(left, lambda x: size(x) >= least))).cast("long").alias("n_compared"),
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=QUERY_LEAST).select("doc_id", "n_lines", "n_removed", "text")
