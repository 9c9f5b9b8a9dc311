import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from coppice.llm import hard_negatives as H
from coppice.llm import suffix_dedup as S
from coppice.llm import yinyang as Y

VECTORS = "vec_id long, embedding array<float>, label int"


def removed(docs, length):
    """(id, n_bytes, n_removed, n_spans, sha256) of each row, every window looked up."""
    rank = lambda i: S.NULL_ID if i is None else i
    data = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in data:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, S.NULL_ID), rank(i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < rank(i):
                gone[s : s + length] = True
        runs = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def spark_removed(table, **options):
    rows = S.remove_repeats(table, **options).collect()
    for r in rows:
        assert r.n_removed == sum(s.end - s.start for s in r.spans) and len(r.kept) == r.n_bytes - r.n_removed
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in rows), key=repr)


@pytest.mark.parametrize("length", [5, 50])
def test_transform_finds_least_ids(length):
    rng = random.Random(length)
    for _ in range(40):
        letters = rng.choice([b"ab", b"abcdef\0\xff", bytes(range(256))])
        pieces = [bytes(rng.choice(letters) for _ in range(rng.randrange(length, length + 40))) for _ in range(rng.randrange(1, 30))]
        pieces += [rng.choice(pieces)[: length + 3] + bytes(rng.choice(letters) for _ in range(5)) for _ in range(10)]
        least = np.array([rng.randrange(100) for _ in pieces])
        first, want = {}, {}
        for p, m in zip(pieces, least.tolist(), strict=True):
            for s in range(len(p) - length + 1):
                first[p[s : s + length]] = min(first.get(p[s : s + length], 10**9), m)
        for n, p in enumerate(pieces):
            for s in range(len(p) - length + 1):
                at = (n, first[p[s : s + length]])
                want[at] = want.get(at, 0) | 1 << s
        got = {(a, b): c & (2**64 - 1) for a, b, c in zip(*(x.tolist() for x in S.least_by_window(np.frombuffer(b"".join(pieces), dtype=np.uint8), np.array([len(p) for p in pieces]), least, length)), strict=True)}
        assert got == want


def test_transform_returns_only_windows_that_a_holder_loses():
    lone, copied, inside = bytes(range(60)), bytes(range(60, 120)), bytes(range(70, 125))
    table = pa.table({"_key": [1, 2, 3], "_piece": pa.array([lone, copied, inside], type=pa.binary()), "_least": [5, 4, 6], "_most": [5, 9, 6]})
    # The lone piece's windows are nobody's repeats; the copied one's go from document 9, one of them from 6 as well.
    assert S.expanded(table).to_pylist() == [{"_key": 2, "_piece": copied, "_lowest": 4, "_bits": (1 << 11) - 1}, {"_key": 3, "_piece": inside, "_lowest": 4, "_bits": 1}]


def test_minimizers_that_no_other_document_has_stay_in_their_task(spark):
    keys = np.array([random.Random(i).randrange(-(1 << 63), 1 << 63) for i in range(3000)])
    words = S.key_filter(spark.createDataFrame([(int(k),) for k in keys[:1000]], "k long"), "k")
    assert len(words) == S.FILTER_WORDS and S.in_filter(keys[:1000], words).all() and S.in_filter(keys[1000:], words).sum() < 10
    assert not S.in_filter(keys, S.key_filter(spark.createDataFrame([], "k long"), "k")).any()


def test_each_window_lies_in_one_piece(monkeypatch):
    rng = random.Random(5)
    texts = [b"", b"a" * 49, b"a" * 50, b"a" * 1000, bytes(rng.randrange(256) for _ in range(3000)), b"ab" * 400]
    for chunk in (S.CHUNK, 300):
        monkeypatch.setattr(S, "CHUNK", chunk)
        t, key, start, n = S.pieces_of(texts)
        seen = sorted((int(a), int(s) + i) for a, s, w in zip(t, start, n, strict=True) for i in range(w))
        assert seen == [(a, s) for a, b in enumerate(texts) for s in range(len(b) - 49)]
        by = {}
        for a, k, s, w in zip(t.tolist(), key.tolist(), start.tolist(), n.tolist(), strict=True):
            for i in range(w):
                assert by.setdefault(texts[a][s + i : s + i + 50], k) == k


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(10**5)}" for _ in range(60))
    docs += [(6000 + i, f"{rng.random()} {passage[rng.randrange(9):]} {rng.random()} é{i}") for i in range(60)]
    docs += [(5000, None), (5001, ""), (5002, "a" * 49), (5003, "a" * 50), (5004, "a" * 200), (4999, "b" + "a" * 60), (5005, passage[:49]), (5006, passage[:50]), (5007, passage), (5008, passage), (5008, passage), (5008, passage + "x"), (None, passage), (None, "ü" * 400), (5009, "ü" * 30 + "x"), (-3, passage[20:90]), (5010, "word " * 100000)]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, _key int")
    want = removed(docs, 50)
    assert sum(r[2] > 0 for r in want) > 60
    assert spark_removed(table) == want
    # Small buckets and keys dealt by windows: the same rows.
    monkeypatch.setattr(S, "CHUNK", 1000)
    assert spark_removed(table, bucket=2000, pieces=3) == want


def test_suffix_dedup_odd_tables(spark):
    assert spark_removed(spark.createDataFrame([], "doc_id long, text string")) == []
    docs = [(3, "abcdefgh"), (2, "xxabcdefyy"), (2, "xxabcdefyy"), (4, "abcde"), (None, None)]
    table = spark.createDataFrame([(t, i, t) for i, t in docs], "text string, doc_id long, spans string")
    assert spark_removed(table, length=5, gram=3) == removed(docs, 5)


def quantise(v, scale=256):
    return [math.floor(scale * float(x)) for x in v]


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def lloyd(rows, k, rounds, dim, seed=2):
    kept = [(i, quantise(v)) for i, v, _ in rows if whole(v) and len(v) == dim]
    centroids = [v for _, _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v, v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            of = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if of:
                centroids[j] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    got = [(i, *near(v)) for i, v in kept]
    sums = {}
    for _, d, j in got:
        sums[j] = sums.get(j, 0) + d
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in got), key=repr)


def some_vectors(n, dim, seed, spread=0.3):
    rng = random.Random(seed)
    tops = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(tops)], rng.choice([0, 1, 2, None] if i % 9 == 0 else [0, 1, 2])) for i in range(n)]
    rows += [(n + i, list(rows[0][1]), i % 2) for i in range(30)]  # copies
    bad = [None, [], [None] * dim, [math.nan] * dim, [math.inf] + [0.0] * (dim - 1), [0.0] * (dim + 1), [0.0] * dim]
    rows += [(2 * n + 50 * i, v, 1) for i, v in enumerate(bad)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows] + [(None, [0.1] * dim, 1), (7, [0.2] * dim, 2), (7, [0.2] * dim, 2)]


@pytest.mark.parametrize("k", [3, 25])
def test_clustering_equals_lloyd(spark, monkeypatch, k):
    rows = some_vectors(300, 8, k)
    table = spark.createDataFrame(rows, VECTORS)
    want = lloyd(rows, k, 5, 8)
    for size in (Y.TABLE, 200):  # in one piece, and a few rows at a time
        monkeypatch.setattr(Y, "TABLE", size)
        got = Y.cluster(table, k=k, dim=8).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_group_filters_save_distances_and_keep_ties():
    rng = np.random.default_rng(4)
    x = (rng.integers(0, 40, 6)[rng.integers(0, 6, 2000)][:, None] * 50 + rng.integers(-9, 9, (2000, 12))).astype(np.int64)
    c = x[rng.choice(2000, 40, replace=False)].copy()
    c[7] = c[3]  # a tie for every vector
    group = Y.grouped(c, 4)
    own, upper, lower = Y.first_assignment(x, c, group)
    looked = 0
    for _ in range(6):
        assert (own == Y.squared(x, c).argmin(1)).all()
        moved = c.copy()
        for j in np.unique(own):
            moved[j] = np.floor_divide(x[own == j].sum(0), (own == j).sum())
        drift = np.sqrt(((moved - c) ** 2).sum(1).astype(float)) * Y.UP
        c = moved
        own, upper, lower, exact = Y.next_assignment(x, own, upper, lower, c, group, drift)
        d = Y.squared(x, c).astype(float)
        assert (upper**2 >= d[np.arange(2000), own]).all()
        d[np.arange(2000), own] = np.inf
        assert all((lower[:, g] ** 2 <= d[:, group == g].min(1)).all() for g in range(group.max() + 1))
        looked += exact
    assert looked < 0.6 * 6 * 2000 * 40


def test_clustering_odd_tables(spark):
    assert Y.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    assert Y.cluster(spark.createDataFrame([(None, [1.0, 2.0], 0)], VECTORS), dim=2).count() == 0
    one = Y.cluster(spark.createDataFrame([(5, [1.0, -0.001], 0), (5, [1.0, -0.001], 0)], VECTORS).withColumnRenamed("label", "_v"), dim=2, k=4).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in one] == [(5, 0, 0, 0)] * 2
    big = Y.cluster(spark.createDataFrame([(i, [100000.0 * i, 1.0], 0) for i in range(6)], VECTORS), dim=2, k=2)
    assert sorted(tuple(r) for r in big.collect()) == lloyd([(i, [100000.0 * i, 1.0], 0) for i in range(6)], 2, 5, 2)


def mined(rows, anchors, positives=5, negatives=5, num=80, den=100):
    kept = sorted({(i, c, tuple(quantise(v))) for i, v, c in rows if i is not None and c is not None and whole(v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, c, v in kept:
        if not anchors(i):
            continue
        scored = sorted((-dot(v, w), j, d) for j, d, w in kept if len(w) == len(v))
        for s, p, d in [x for x in scored if x[2] == c and x[1] != i][:positives]:
            fit = [x for x in scored if x[2] != c and num * -s <= den * -x[0] <= den * -s][:negatives]
            out += [(i, p, n, j, -s, -t) for n, (t, j, _) in enumerate(fit, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rows = some_vectors(400, 7, 3, 0.2)
    table = spark.createDataFrame([(*r, 1) for r in rows], VECTORS + ", _class int")
    want = mined(rows, lambda i: i % 10 == 0)
    assert len(want) > 200
    from pyspark.sql import functions as F

    every_tenth = F.col("_id") % 10 == 0
    got = H.mine(table, is_anchor=every_tenth).collect()
    assert sorted(tuple(r) for r in got) == want
    # Small blocks, few codes: the same rows.
    monkeypatch.setattr(H, "AT_ONCE", 3)
    monkeypatch.setattr(H, "SAMPLE", 20)
    got = H.mine(table, is_anchor=every_tenth, rows_block=50, anchors_block=9).collect()
    assert sorted(tuple(r) for r in got) == want


def test_score_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (500, 7))
    books = H.fit_codebooks(x[:100], codes=100)
    codes, norms = H.encode(x, books)
    low, high = H.score_bounds(x[:40], codes, norms, books)
    exact = x[:40] @ x.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < np.abs(exact).mean()


def test_hard_negatives_odd_tables(spark):
    assert H.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert H.mine(spark.createDataFrame([(None, [1.0], 1), (100, None, 1), (200, [1.0], None), (300, [1.0], 1)], VECTORS)).count() == 0
    rows = [(100, [1.0, 0.5], 1), (101, [1.0, 0.5], 1), (101, [1.0, 0.5], 1), (100, [0.9, 0.5], 1), (102, [1.0, 0.5], 2), (103, [0.9, 0.4], 3), (200, [], 1), (201, [], 1), (202, [], 2), (300, [1.0], 1), (301, [1.0], 1), (302, [0.95], 2)]
    assert sorted(tuple(r) for r in H.mine(spark.createDataFrame(rows, VECTORS)).collect()) == mined(rows, lambda i: i % 100 == 0)
