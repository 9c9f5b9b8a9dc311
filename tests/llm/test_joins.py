import random

import numpy as np
import pytest
from brute import dedup_lines, ngram_components

from coppice.llm import components as C
from coppice.llm import setjoin as S
from coppice.llm.embedding_dedup import near_duplicates, table_shape
from coppice.llm.line_dedup import dedup_lines as spark_lines
from coppice.llm.ngram_join import similar_documents

SCHEMA = "doc_id long, text string"


def near_copies(n, seed=1, words=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(copy)))
    return out


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += near_copies(60) + [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "One Two"), (5004, "one\ttwo"), (5005, "one two three"), (5006, "é É"), (5007, "word " * 30000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == ngram_components(docs)
    # Small blocks: hot shingles and large components are split, with the same result.
    for name, value in (("HOLDERS", 5), ("COMMON", 2), ("CELLS", 64), ("BROADCAST_KEYS", 3), ("LARGE", 100), ("ELEMENTS", 500), ("MEMBERS", 7)):
        monkeypatch.setattr(S, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == ngram_components(docs)


def test_ngram_join_odd_tables(spark):
    assert similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, "A B C D E"), (7, None), (7, "z")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA + ", _item string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(table).collect()), key=repr)
    assert got == sorted([(None, 2, None), (3, 2, None), (3, 2, None), (4, 2, None), (7, 0, 7), (7, 1, 7)], key=repr)


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += near_copies(40, words=12) + [(5000, None), (5001, ""), (5002, "\n\n"), (5003, "a b c d e\nE D C B A\na b c d"), (5004, "one two three four five six seven eight nine ten\r\n"), (5005, "one two three four five six seven eight nine")]
    want = dedup_lines(docs)
    table = spark.createDataFrame([(i, t, i) for i, t in docs], SCHEMA + ", n_lines long")
    got = spark_lines(table).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert {r.doc_id: r.n_lines for r in got} == {i: 0 if t is None else t.count("\n") + 1 for i, t in docs}
    for name, value in (("HOLDERS", 5), ("COMMON", 2), ("CELLS", 64), ("BROADCAST_KEYS", 3), ("LARGE", 8), ("ELEMENTS", 60), ("MEMBERS", 7), ("PAIRS", 50)):
        monkeypatch.setattr(S, name, value)
    assert {r.doc_id: r.text for r in spark_lines(table).collect()} == want


def test_line_dedup_odd_tables(spark):
    assert spark_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e"), (2, "a b c d e\nx"), (2, "a b c d e\nx"), (3, "p q r s t"), (3, "p q r s t")]
    got = sorted(((r.doc_id, r.text, r.n_removed, r.n_compared) for r in spark_lines(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(None, "a b c d e", 0, None), (2, "x", 1, 0), (2, "x", 1, 0), (3, "p q r s t", 0, None), (3, "p q r s t", 0, None)], key=repr)


def test_texts_that_lose_lines_are_not_sorted(spark):
    out = spark_lines(spark.createDataFrame([(1, "a b c d e"), (2, "x\na b c d e\n"), (3, ""), (4, None)], SCHEMA))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.doc_id, r.text, r.n_lines) for r in out.collect()) == [(1, "a b c d e", 1), (2, "x\n", 3), (3, "", 1), (4, None, 0)]


def test_words_in(monkeypatch):
    from brute import words

    monkeypatch.setattr(S, "PIECE", 64)
    rng = random.Random(3)
    texts = ["", "  ", "One two\tthree\x0bfour\x0cfive\rsix\nseven", "x" * 64, "y" * 63, "A" * 200 + " b", "é\u00a0É \u2003 z", " ".join("".join(rng.choice("abAB") for _ in range(rng.randrange(1, 90))) for _ in range(80))]
    h, sizes = S.words_of_texts([t.encode() for t in texts])
    want = [words(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(dict(zip(flat, h.tolist(), strict=True))) == len(set(h.tolist())) == len(set(flat))
    assert all(len({a for w, a in zip(flat, h.tolist(), strict=True) if w == x}) == 1 for x in set(flat))


def test_prefix_filters_lose_nothing():
    rng = np.random.default_rng(0)
    for num in (80, 85):
        for _ in range(300):
            n = int(rng.integers(1, 40))
            universe = rng.choice(200, size=60, replace=False)
            a, b = (np.sort(rng.choice(universe, size=min(60, max(1, n + int(d))), replace=False)) for d in (0, rng.integers(-3, 4)))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= num * (len(a) + len(b) - shared):
                pa, pb = (x[: S.prefix_length(len(x), num, 100)] for x in (a, b))
                assert len(np.intersect1d(pa, pb))


def test_two_elements_of_longer_prefixes_are_shared():
    rng = np.random.default_rng(1)
    seen = 0
    for num in (80, 85):
        for _ in range(400):
            n = int(rng.integers(2, 40))
            a = np.sort(rng.choice(300, size=n, replace=False))
            b = np.sort(np.unique(np.concatenate([rng.permutation(a)[: n - rng.integers(0, 1 + n // 8)], rng.choice(300, size=rng.integers(0, 3))])))
            shared = np.intersect1d(a, b)
            if 100 * len(shared) >= num * (len(a) + len(b) - len(shared)) and len(a) != len(shared):
                prefix = [S.prefixes(x.astype(np.uint64), np.array([len(x)]), num, 100)[0] for x in (a, b)]
                assert len(np.intersect1d(*prefix)) >= 2 and set(shared[:2]) <= set(np.intersect1d(*prefix).tolist())
                seen += 1
    assert seen > 100


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)] + [(i, i + 1) for i in range(100, 160)] + [(200, x) for x in range(201, 240)] + [(5, 5), (None, 3)]
    from brute import components

    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = components({x for e in real for x in e}, real)
    assert got == want


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.1, np.repeat(base[:1], 80, axis=0) + rng.normal(size=(80, 16)) * 0.05, np.repeat(base[1:2], 30, axis=0)])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] + [0.0] * 14), (904, [1.0] * 3), (905, [float("inf")] * 16), (None, [1.0] * 16)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    from brute import components

    want = components(range(len(u)), zip(*np.nonzero(links), strict=True))
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    for block in (1024, 16):
        got = {r.vec_id: r for r in near_duplicates(table, block=block).collect()}
        assert len(got) == len(rows) + len(odd)
        found = sum(got[i].n_links for i in range(len(u)))
        assert found <= links.sum() and found >= 0.99 * links.sum()
        same = sum(got[i].component_id == want[i] for i in range(len(u)))
        assert same >= 0.97 * len(u)
        assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i, _ in odd)
        assert all(r.kept == (r.vec_id == r.component_id) for i, r in got.items() if i is not None)
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def brute_vectors(rows):
    """(n_links, component) by place: each row a vector of its own."""
    import math

    from brute import components

    unit = []
    for i, v in rows:
        ok = i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    part = components(range(len(rows)), links)
    least: dict = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[part[n]] = min(i, least.get(part[n], i))
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return sorted(((i, degree[n], least.get(part[n]) if i is not None else None) for n, (i, _) in enumerate(rows)), key=repr)


def test_embeddings_of_odd_tables(spark):
    e = lambda *v: [float(x) for x in v]
    rows = [(i, None) for i in range(5)] + [(10 + i, []) for i in range(5)] + [(20, e(1, 0)), (21, e(1, 0.01)), (22, e(2, 0)), (23, e(1, 0, 0)), (24, e(1, 0, 0.1)), (25, e(-1)), (26, e(3)), (27, e(0, 0))]
    rows += [(30, e(0, 1)), (30, e(0, 1)), (30, e(5, 5)), (None, e(0, 1)), (31, [1.0, None]), (32, [float("nan"), 1.0]), (33, e(1e300, 1e300)), (34, e(1e-300, 1e-300))]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, _item int")
    got = near_duplicates(table).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute_vectors([(i, [1.0, 1.0] if i in (33, 34) else v) for i, v in rows])
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    floats = near_duplicates(spark.createDataFrame(rows[10:13], "vec_id int, embedding array<float>")).collect()
    assert all(r.n_links == 2 and r.component_id == 20 for r in floats)


def test_embeddings_with_a_very_common_vector(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(10_000)] + [(20_000 + i, [1.0, 0.1, i / 100]) for i in range(3)] + [(30_000, [0.0, 1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0] == got[9_999] == (10_002, 0) and got[20_001] == (10_002, 0) and got[30_000] == (0, 30_000) and len(got) == len(rows)


@pytest.mark.parametrize("n", [10, 10_000, 10**9])
def test_tables_keep_the_recall(n):
    bits, tables = table_shape(n)
    p = (1 - np.arccos(0.9) / np.pi) ** bits
    assert 1 - (1 - p) ** tables >= 0.995


def test_line_dedup_of_short_lines_equals_brute_force(spark, tmp_path):
    from coppice.llm.line_dedup import op5_line_dedup

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(5000, None), (5001, "\n \n"), (5002, "Home\nHOME\nhome page\n\n"), (5003, "a b c d e\nb c d a\na b c"), (5004, "page home home\nc b a\nc b"), (5005, "no no no no no no\nNo\n\n")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = dedup_lines(docs, least=1)
    # A line without words is blank and always stays.
    assert want[5005] == "no no no no no no\n\n" and want[5002] == "Home\nhome page\n\n"
    assert {r.doc_id: r.text for r in op5_line_dedup(spark, str(tmp_path)).collect()} == want


def test_large_documents_that_share_a_passage_are_no_candidates(spark, monkeypatch):
    """Sets of some 600 to 6,000 shingles of which all share a rare one, and no two others but a near copy."""
    rng = random.Random(21)
    passage = " ".join(f"rare{i}" for i in range(6))
    texts = [" ".join([*(f"w{rng.randrange(300)}" for _ in range(n)), passage]) for n in [600] * 20 + [2000] * 20 + [5000] * 8]
    texts.append(texts[25].replace(passage, passage + " and more"))
    found, compared = [], S.candidate_components

    def kept(*args):
        found.append(compared(*args))
        return found[-1]

    monkeypatch.setattr(S, "candidate_components", kept)
    rows = similar_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: 25 if i == len(texts) - 1 else i for i in range(len(texts))}
    assert found[0].count() == 2


def test_small_components_are_compared_together(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(1, S.SMALL + 3, 12)
        comp = np.repeat(np.arange(12), sizes)
        start = np.concatenate([[0], np.cumsum(sizes)])
        n = int(sizes.sum())
        sets = [np.array(sorted(rng.choice(12, rng.integers(1, 12), replace=False)), dtype=np.int64) for _ in range(n)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        split = rng.integers(0, 2, 12)[comp]  # of these components, two blocks meet
        c = {"_item": rng.permutation(n) - rng.integers(0, 2) * 5, "_doc": rng.integers(0, 4, n), "_line": rng.integers(0, 3, n), "_side": rng.integers(0, 2, n) * split, "_lo": np.zeros(n, dtype=int), "_hi": split}
        want = set()
        for a, b in zip(start[:-1], start[1:], strict=True):
            part = {k: v[a:b] for k, v in c.items()}
            if b - a <= S.SMALL and (not split[a] or part["_side"].any()):
                want |= set(S.repeated_later(80, 100)(part, S.Overlaps(np.concatenate(sets[a:b]), offsets[a : b + 1] - offsets[a]))[0])
        for most in (S.PAIRS, 5):
            monkeypatch.setattr(S, "PAIRS", most)
            got = S.repeated_pairs(80, 100)(c, np.concatenate(sets), offsets, *S.pairs_of_runs(start))[0]
            assert set(got.tolist()) == want
