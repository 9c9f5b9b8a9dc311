import corpus_pipeline as P
import pytest
from brute import dedup_lines, ngram_components, words
from pyspark.sql import functions as F

from coppice.llm import mixing
from coppice.llm.common import written


@pytest.fixture(scope="module")
def kept(spark):
    """The frame after each stage, over the smallest documents and some odd ones."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = docs.orderBy("doc_id").first()
    odd = [(5001, None, "en", "src0", 0), (5002, "", "en", None, 0), (5003, "123 456", None, "src0", 7), (5004, first.text, first.lang, None, first.n_chars), (5005, first.text + " more", first.lang, "src1", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = [written(docs, "in")]
    for name, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], ""), name.replace(" ", "-")))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_return_documents(kept):
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    for df in kept[1:-1]:
        assert df.columns == kept[0].columns and df.dtypes == kept[0].dtypes


def test_language_stage_keeps_clean_documents(kept):
    before, after = dict(texts(kept[0])), dict(texts(kept[1]))
    assert set(before) - set(after) == {5001, 5002, 5003} and all(before[i] == t for i, t in after.items())


def test_line_stage_equals_brute_force(kept):
    before = texts(kept[1])
    want = dedup_lines(before)
    old = dict(before)
    want = {i: t for i, t in want.items() if t == old[i] or words(t)}
    assert dict(texts(kept[2])) == want
    assert all(r.n_chars == len(r.text) for r in kept[2].collect())


def test_ngram_stage_keeps_one_of_each_group(kept):
    before = texts(kept[2])
    want = {c for _, c in ngram_components(before, 5, 80).values()}
    assert {i for i, _ in texts(kept[3])} == want and kept[3].count() == len(want)


def test_mixing_stage_comes_near_its_targets(kept):
    rows = kept[3].collect()
    sizes: dict = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.share_targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2), strict=True))
    largest = {s: max(len(words(r.text)) for r in rows if r.source == s) for s in names}
    taken = dict.fromkeys(names, 0)
    for r in kept[4].collect():
        taken[r.source] += len(words(r.text))
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], largest[s]) for s in names)


def test_packing_stage_holds_every_document(kept):
    rows = kept[5].collect()
    assert sum(r.length for r in rows if r.start == 0) > 0
    got: dict = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    copies: dict = {}
    for i, _ in texts(kept[4]):
        copies[i] = copies.get(i, 0) + 1
    total = {r.doc_id: r.doc_tokens for r in rows}
    assert got == {i: n * total[i] for i, n in copies.items()}


def test_an_empty_table_passes(spark, kept):
    docs = kept[0].limit(0)
    for _, stage in P.STAGES:
        docs = written(stage(spark, docs, ""), "empty")
    assert docs.isEmpty()


def test_ngram_stage_takes_five_words_and_a_similarity_of_0_8(spark):
    base = [f"w{i}" for i in range(200)]
    # One block of changed words: a five-word similarity of 0.81 to 0.84, under 0.85 also by four words.
    docs = [(i, " ".join(base[: 200 - n] + [f"x{i}y{j}" for j in range(n)])) for i, n in ((1, 0), (2, 18), (3, 20))]
    docs += [(4, " ".join(f"z{j}" for j in range(200))), (5, " ".join(["q", *(f"z{j}" for j in range(160)), *(f"v{j}" for j in range(39))]))]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    want = {c for _, c in ngram_components(docs, 5, 80).values()}
    assert want == {1, 4, 5} != {c for _, c in ngram_components(docs).values()}
    assert {i for i, _ in texts(P.join_ngrams(spark, table, ""))} == want


def test_line_stage_keeps_documents_with_short_lines_left(spark):
    line = "one two three four five six"
    docs = [(1, line), (2, f"{line}\n- bread\n- milk"), (3, f"{line}\n \t\n"), (4, line), (5, f"{line}\n東京は日本の首都です"), (6, " ")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(texts(P.dedup_lines(spark, table, ""))) == {1: line, 2: "- bread\n- milk", 5: "東京は日本の首都です", 6: " "}


def test_language_stage_keeps_documents_of_close_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and n_chars > 100").orderBy("doc_id").limit(200)
    close = docs.withColumn("lang", F.concat(F.lit("en-"), (F.crc32(F.col("doc_id").cast("string")) % 5).cast("string"))).persist()
    assert {i for i, _ in texts(P.identify_language(spark, close, ""))} == {i for i, _ in texts(close)}


def test_packing_stage_returns_the_ids(spark):
    from brute import crc

    table = spark.createDataFrame([(1, "one two three", "en", "s", 13), (2, "word " * 3000, "en", "s", 15000)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = P.pack(spark, table, "").collect()
    assert all(len(r.ids) == r.length and crc(r.ids) == r.ids_crc32 for r in rows) and len(rows) > 2


def test_stages_keep_extra_columns_of_any_name(spark):
    names = ["my col", "a.b", "_row", "_k", "_in", "_text", "_doc", "_id", "n_removed", "n_lines", "score", "lang_pred", "size", "taken", "_item", "tick`s"]
    texts = ["the and of the one two three four five", "the and of the six seven eight nine ten\nof the and in a house", "der die das und ein Haus am See ist gut", None]
    rows = [(i if i < 6 else None if i < 8 else 5, f"{texts[i % 4]} w{i} x{i} y{i}" if texts[i % 4] else None, ["en", "en", "de", "en"][i % 4], f"src{i % 2}", 10, *(f"{n}-{i}" for n in names)) for i in range(40)]
    import pyspark.sql.types as T

    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))] + [T.StructField(n, T.StringType()) for n in names])
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), "odd")
        assert docs.columns == schema.names, name
        got = docs.collect()
        assert got and all([r[n] for n in names] == [f"{n}-{r['my col'].split('-')[1]}" for n in names] for r in got), name
        if name in ("language ID", "line dedup"):
            assert len(got) == 30
    assert P.pack(spark, docs, "").count() == docs.count()
