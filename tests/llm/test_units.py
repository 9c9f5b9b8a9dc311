import hashlib
import random
import re
import time

import brute
import numpy as np
import pytest
from brute import crc, words

from coppice.llm import chat, exact_dedup, language_id, licenses, mixing, packing, secrets


def test_extendible_directory():
    rng = random.Random(1)
    cells: dict[int, int] = {}
    for _ in range(2000):
        c = rng.randrange(1 << 16) if rng.random() < 0.7 else rng.randrange(64)
        cells[c] = cells.get(c, 0) + 1
    depth, pointers = exact_dedup.double_directory(cells, 100)
    assert [p[0] for p in pointers] == list(range(1 << depth))
    load: dict[tuple[int, int], int] = {}
    for c, n in cells.items():
        slot, prefix, local = pointers[c >> (16 - depth)]
        assert prefix == c >> (16 - local)
        load[prefix, local] = load.get((prefix, local), 0) + n
    assert all(n <= 100 or local == 16 for (_, local), n in load.items())
    assert exact_dedup.double_directory({}, 100) == (0, [(0, 0, 0)])


def test_exact_dedup_follows_its_directory(spark, monkeypatch):
    """Pointers that lead elsewhere lose the duplicates: rows find their entries through the directory alone."""
    table = spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)], "doc_id long, text string")
    assert all(r.group_size == 4 for r in exact_dedup.exact_duplicates(table, capacity=1).collect())
    depths = []
    real = exact_dedup.double_directory
    monkeypatch.setattr(exact_dedup, "double_directory", lambda *a: depths.append(real(*a)) or (depths[-1][0], depths[-1][1][:1]))
    assert exact_dedup.exact_duplicates(table, capacity=1).count() < 20 and depths[0][0] > 1


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "A"), (6, "b " * 50_000), (7, "b " * 50_000), (7, "z"), (None, "a"), (8, "é"), (9, "é")]
    table = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _key string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(table, capacity=2).collect()), key=repr)
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    top = {t: max(i for i in ids if i is not None) for t, ids in groups.items()}
    want = sorted(((i, top[t or ""], len(groups[t or ""]), i == top[t or ""] if i is not None else False, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(g[3] == w[3] or g[0] is None for g, w in zip(got, want, strict=True))
    assert exact_dedup.exact_duplicates(table.limit(0)).count() == 0
    # Keys of 2 bits: chains of several texts, in buckets that no directory can split.
    for bits in (0, 2):
        chained = exact_dedup.exact_duplicates(table, capacity=1, key_bits=bits).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in chained), key=repr) == got
    odd = table.withColumnRenamed("text", "the.text").withColumnRenamed("doc_id", "my id")
    assert exact_dedup.exact_duplicates(odd, "my id", "the.text").count() == len(rows)
    assert {r.doc_id: r.group_size for r in exact_dedup.exact_duplicates(table, normalise="case").collect()}[5] == 4


def test_targets_and_flow():
    assert mixing.share_targets([100, 100, 100], [3, 1, 2], 450, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.share_targets([10, 0, 1000], [3, 1, 2], 1515, 2) == pytest.approx([20, 0, 1495])
    assert mixing.share_targets([], [], 0, 2) == []
    # Pattern 0 is in both sources: it goes where nothing else can, and nothing repeats before all is used once.
    assert mixing.min_cost_flow([((0, 1), 10), ((0,), 10)], [10, 10], 2) == [10, 10]
    assert mixing.min_cost_flow([((0,), 10), ((1,), 10)], [25, 5], 2) == [20, 5]
    assert mixing.min_cost_flow([((), 10)], [5], 2) == [0]


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(1, 200))), rng.choice(["a", "a", "a", "Z", "é", None])) for i in range(1500)] + [(2000, None, "a"), (2001, "", "empty"), (2002, "x", "a"), (2002, "x", "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = [tuple(r) for r in mixing.mix_sources(table).collect()]
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2), strict=True))
    taken: dict = {}
    for i, s, size, source_size, target, t in once:
        assert source_size == sizes[s] and target == pytest.approx(want[s]) and 0 <= t <= 2 * size and t % max(1, size) == 0
        taken[s] = taken.get(s, 0) + t
    assert len(once) == len(rows) and all(abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]) for s in names)
    assert mixing.mix_sources(table.limit(0)).count() == 0


def test_mixing_reruns_agree(spark):
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 3}") for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [{r.doc_id: r.taken for r in mixing.mix_sources(t).collect()} for t in (table, table.repartition(9))]
    assert runs[0] == runs[1]


def test_mixing_takes_ids_of_any_type(spark):
    rows = [(f"id{i}", "w " * (i % 37 + 1), f"s{i % 3}") for i in range(900)] + [(None, "w " * 20_000, "s1")]
    table = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = mixing.mix_sources(table).collect()
    assert len(got) == len(rows) and all(r.taken % max(1, r["size"]) == 0 for r in got)
    runs = [{r.doc_id: r.taken for r in mixing.mix_sources(t).collect()} for t in (table.limit(900), table.limit(900).repartition(9))]
    assert runs[0] == runs[1] and sum(runs[0].values()) > 0


def test_mixing_looks_for_the_edge_in_spans(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = [(i, i % 91 + 1, [i % 2]) for i in range(2000)]
    table = spark.createDataFrame(rows, "_row long, _size long, m array<int>")
    runs = []
    for spans in (7, 4096):
        monkeypatch.setattr(mixing, "SPANS", spans)
        runs.append({r._row: r.taken for r in mixing.mix(table, "m", {0: 20_000, 1: 60_000}).collect()})
    assert runs[0] == runs[1]
    taken = [sum(t for i, t in runs[0].items() if i % 2 == k) for k in (0, 1)]
    assert 0 <= 20_000 - taken[0] < 91 and 0 <= 60_000 - taken[1] < 91


def test_flow_equals_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 5)
        patterns = [(tuple(sorted(rng.sample(range(n), rng.randrange(0, n + 1)))), rng.randrange(0, 20)) for _ in range(rng.randrange(1, 9))]
        quotas, repeats = [rng.randrange(0, 40) for _ in range(n)], rng.randrange(1, 4)
        taken = mixing.min_cost_flow(patterns, quotas, repeats)
        assert all(0 <= t <= repeats * size for t, (_, size) in zip(taken, patterns, strict=True))
        # It can be routed, is as much as can be, and with every bound on the copies as little is repeated as can be.
        assert brute.most_flow([(m, t) for (m, _), t in zip(patterns, taken, strict=True)], quotas) == sum(taken)
        for k in range(1, repeats + 1):
            assert sum(min(t, k * size) for t, (_, size) in zip(taken, patterns, strict=True)) == brute.most_flow([(m, k * size) for m, size in patterns], quotas)


def test_flow_of_many_patterns_ends():
    rng = random.Random(6)
    patterns = [(tuple(sorted(rng.sample(range(40), rng.randrange(1, 6)))), rng.randrange(1, 10**6)) for _ in range(10_000)]
    quotas = [rng.randrange(10**8) for _ in range(40)]
    began = time.monotonic()
    taken = mixing.min_cost_flow(patterns, quotas, 2)
    assert sum(taken) <= sum(quotas) and time.monotonic() - began < 30


def test_code_lengths_equal_brute_force():
    rng = random.Random(8)
    alphabets = {"a": "abc ", "b": "bcdé\n", "c": "xyzabcdefgh ", "d": "q"}
    texts = {k: ["".join(rng.choice(v) for _ in range(rng.randrange(1, 60))).encode() for _ in range(5)] for k, v in alphabets.items()}
    for order in (0, 1, 2, 3):
        trees = language_id.ContextTrees(texts, order=order)
        probes = [b"", b"a", "abc bcdé\nxyz qq".encode(), bytes(range(256)), *(rng.choice(texts[k]) for k in texts)]
        got = trees.code_lengths(probes)
        for j, lang in enumerate(trees.languages):
            assert got[:, j] == pytest.approx([brute.ppm_bits(t, texts[lang], order, language_id.LEAST_SEEN) for t in probes], rel=1e-4, abs=1e-3)


def test_model_is_as_large_as_its_sample():
    rng = np.random.default_rng(3)
    texts = {f"l{i:02}": [rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes() for _ in range(3)] for i in range(24)}
    trees = language_id.ContextTrees(texts)
    held = sum(r.bits.nbytes + r.keys.nbytes + r.at.nbytes for r in (*trees.pairs, *trees.escapes))
    assert held < 400 << 20
    assert [trees.languages[i] for i in trees.code_lengths([texts["l07"][0], texts["l20"][1]]).argmin(1)] == ["l07", "l20"]


def test_labels_of_long_texts_alone_are_learned(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("der die das und nicht " * 2000, "de"), ("the and of not with " * 2000, "en")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(len(t) > language_id.SAMPLE_BYTES for _, t, _ in rows)
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.train(docs)).collect()} == {i: lang for i, _, lang in rows}


def test_predictions_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "the and of not", "en", 5, "x", "y", 7), (2, "the and of not", "en", 6, "x", "z", 8)], "doc_id long, text string, lang string, score int, lang_pred string, `a.b` string, `my col` int")
    got = sorted(language_id.predict(docs, language_id.train(docs)).collect())
    assert [(r.doc_id, r.lang_pred, r.score, r["a.b"], r["my col"]) for r in got] == [(1, "en", 1.0, "y", 7), (2, "en", 1.0, "z", 8)]


def test_context_trees_are_distributions():
    trees = language_id.ContextTrees({"x": [b"abab abba", b"abc"], "y": [b"zzz yzz", b"zyx"]}, order=2)
    every = [bytes([b]) for b in range(256)]
    for context in (b"", b"a", b"ab", b"zz", b"\xffq", b"b\xff"):
        bits = trees.code_lengths([context + e for e in every]) - trees.code_lengths([context])
        assert np.exp2(-bits).sum(0) == pytest.approx([1, 1], abs=1e-4)
    text = b"ab ba z" * 400_000  # longer than a chunk
    assert trees.code_lengths([text])[0] == pytest.approx(trees.code_lengths([text[:700_000]])[0] * len(text) / 700_000, rel=1e-4)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(10_001, None, "en", "s"), (10_002, "", "en", "s"), (10_003, "12 34 !?", None, "s"), (10_004, "²³", None, "s"), (None, "the and of", None, None)], docs.schema)
    rows = {r.doc_id: r for r in language_id.identify(docs.unionByName(odd)).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (10_001, 10_002, 10_003, 10_004)) and rows[None].lang_pred == "en"
    import zlib

    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows.values())
    empty = language_id.identify(docs.limit(0))
    assert empty.count() == 0
    blank = docs.limit(3).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language_id.identify(blank).collect()} == {"und"}


def test_plans_use_every_piece_once():
    rng = np.random.default_rng(0)
    for counts in (np.bincount(rng.integers(1, 65, 3000), minlength=65), np.bincount([64] * 5 + [1] * 200 + [33] * 9, minlength=65), np.zeros(65, dtype=int), np.bincount([40] * 7, minlength=65)):
        patterns = packing.plan(counts, 64)
        used = np.zeros(65, dtype=int)
        for pattern, times in patterns:
            assert times > 0 and sum(pattern) <= 64
            for n in pattern:
                used[n] += times
        assert (used == counts).all()
    x = packing.nnls(np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([1.0, 3.0]))
    assert x == pytest.approx([0, 2], abs=1e-3)


def test_packing(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CELL_ROWS", 20)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9001, None), (9002, ""), (9003, "a <|endoftext|> b"), (9004, "x" * 30_000), (9005, "same"), (9005, "same"), (None, "null id")]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int")
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted(((i, [*(tok.encode(t, add_special_tokens=False).ids if t else []), 1]) for i, t in docs), key=repr)
    rows = packing.pack_documents(table, window=512).collect()
    seen: dict = {}
    for r in rows:
        assert crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length <= 512
        seen.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, ids in want:
        own = seen[i, len(ids)]
        copies = sum(1 for x in want if x == (i, ids))
        for start in {r.start for r in own}:
            pieces = [r for r in own if r.start == start]
            assert len(pieces) == copies and all(list(p.ids) == ids[start : start + p.length] for p in pieces)
        assert sum(r.length for r in own) == copies * len(ids)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert sum(r.length for r in rows) > 0.97 * 512 * len(sequences)
    assert packing.pack_documents(table.limit(0)).count() == 0


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 8:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def test_base_spans():
    rng = random.Random(6)
    parts = ["token", "SECRET", "Api_Key", "apikey", "passwd", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "deadbeef" * 4, "0" * 31, "ABCDEF0123456789", "x.y-z", "é", "ſecret", "toKen", "\n", "İ", "password", "aA1+/_.=-"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert secrets.base_spans(text) == brute_spans(text)


def test_secret_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    net = secrets.train(docs)
    x, y = secrets.labelled([r.text for r in docs.limit(200).collect()], n=800, seed=99)
    p = net.probability(net.logits(x)) >= net.threshold
    assert p[y > 0].mean() > 0.9 and p[y == 0].mean() < 0.05
    rows = {r.doc_id: r for r in secrets.digest(secrets.scan(docs, net)).collect()}
    for r in docs.collect():
        base = ",".join(f"{k}:{s}:{e}" for s, e, k in brute_spans(r.text or ""))
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "key ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5", 0), (3, "x", 0)], "doc_id long, text string, findings int")
    got = sorted(((r.doc_id, r.spans) for r in secrets.digest(secrets.scan(odd, net)).collect()))
    assert got[0] == (1, "") and got[1] == (2, "") and got[2] == (3, "") and got[3][1].startswith("model:4:")
    assert secrets.scan(odd.limit(0), net).count() == 0 and secrets.train(odd.limit(0)) is not None


def test_chat(spark):
    u, a = ("user", "hi"), ("assistant", "yo")
    convs = {1: [u], 2: [u, a], 3: [u, a, u], 4: [u, a, u], 5: [a], 6: [("user", None), (None, "x")], 7: [("user", "")], 8: [u, a, ("user", "bye")]}
    rows = [(c, i, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)] + [(9, None, "user", "n"), (9, None, "user", "n"), (None, 0, "user", "only")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, _pos string")
    got = {r.conv_id: r for r in chat.collapse(table).collect()}
    assert sorted((c for c, r in got.items() if r.kept), key=repr) == sorted([3, 5, 6, 8, 9, None], key=repr)
    assert got[3].rendered == "<|user|>\nhi\n<|assistant|>\nyo\n<|user|>\nhi\n" and got[2].rendered is None and got[9].n_turns == 2
    assert got[6].rendered == "<|user|>\n\n<||>\nx\n" and chat.collapse(table.limit(0)).count() == 0
    once = chat.collapse(table, template="{role}: {text};").where("conv_id = 5").first()
    assert once.rendered == "assistant: yo;"


def test_licences(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [
        (1, "a/LICENSE", gpl), (2, "a/x.py", "code\n" + mit + "\nmore"), (3, "a/b/c/y.py", "nothing"), (4, "z/q.py", "released into the wild"), (5, "a/b/z.py", None), (6, None, mit.lower()),
        (7, "a/COPYING.txt", mit), (8, "p/k.py", mit), (9, "p/l.py", ""), (10, "a/w.py", "Licensed under CC BY-NC 4.0."), (11, "a/b/LICENCE.md", gpl), (None, "n/k.py", mit), (None, "n/l.py", "x"), (12, "r/s", mit), (12, "r/s", "x"),
    ]
    table = spark.createDataFrame([(*r, 0) for r in rows], "id long, path string, text string, score int")
    got = sorted(((r.id, r.path, r.licence, r.origin) for r in licenses.scan(table, "id", "path", "text").collect()), key=repr)
    # Of a directory's licence files the least path declares; files without the name declare nothing.
    assert got == sorted([
        (1, "a/LICENSE", "GPL-3.0", "own"), (2, "a/x.py", "MIT", "own"), (3, "a/b/c/y.py", "GPL-3.0", "inherited"), (4, "z/q.py", None, "none"), (5, "a/b/z.py", "GPL-3.0", "inherited"), (6, "", "MIT", "own"),
        (7, "a/COPYING.txt", "MIT", "own"), (8, "p/k.py", "MIT", "own"), (9, "p/l.py", None, "none"), (10, "a/w.py", "CC-BY-NC-4.0", "own"), (11, "a/b/LICENCE.md", "GPL-3.0", "own"), (None, "n/k.py", "MIT", "own"), (None, "n/l.py", None, "none"),
        (12, "r/s", "MIT", "own"), (12, "r/s", "MIT", "own"),
    ], key=repr)
    assert licenses.scan(table.limit(0), "id", "path", "text").count() == 0
    vectors, _ = licenses.template_weights(licenses.TEMPLATES)
    assert all(sum(v * v for v in w.values()) == pytest.approx(1) for w in vectors.values())
    few = table.where("id in (2, 3)")
    assert {r.id: r.licence for r in licenses.scan(few, "id", "path", "text", templates={"Own": "code"}, texts={}).collect()} == {2: "Own", 3: None}


def brute_licence(text, templates, least=0.8, span=4):
    """The best (licence, score) over all runs of lines and windows, by plain TF-IDF cosines."""
    vectors, idf = licenses.template_weights(templates)
    outside = np.log(1 + len(templates)) + 1
    terms = lambda t: re.findall("[a-z0-9]+", t.lower())
    lines, flat = (text or "").split("\n"), terms(text or "")
    headers = {tuple(terms("\n".join(lines[i : i + k]))) for i in range(len(lines)) for k in range(1, span + 1)}
    headers |= {tuple(flat[i : i + n]) for n in {len(terms(t)) for t in templates.values()} for i in range(len(flat) - n + 1)}
    best = (0, None)
    for h in headers:
        w = {t: h.count(t) * idf.get(t, outside) for t in set(h)}
        norm = np.sqrt(sum(x * x for x in w.values()))
        for name, v in vectors.items():
            score = round(float(sum(w[t] * x for t, x in v.items() if t in w) / norm), 6) if norm else 0
            if score >= least and (score > best[0] or score == best[0] and name < best[1]):
                best = (score, name)
    return best[::-1] if best[1] else (None, None)


def test_licences_equal_brute_force(spark):
    rng = random.Random(8)
    words = "the mit with a license copyright released under work version public der mit source of and x y z".split()
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            t = rng.choice(list(licenses.TEMPLATES.values())).split()
            if rng.random() < 0.6:
                t = [w for w in t if rng.random() < 0.9]
            for _ in range(rng.randrange(3)):
                t.insert(rng.randrange(len(t) + 1), rng.choice(words))
            if rng.random() < 0.4:
                t = [rng.choice(words) for _ in range(rng.randrange(1, 60))]
            parts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\n# "]) for w in t))
        texts.append(rng.choice(["", "\n", " "]).join(parts))
    texts += [None, "", "\n\n", " ".join(words[i % len(words)] for i in range(5000)) + " " + licenses.TEMPLATES["LGPL-3.0"]]
    table = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string")
    got = {r.id: (r.licence, r.score) for r in licenses.scan(table, "id", "path", "text").collect()}
    want = {i: brute_licence(t, licenses.TEMPLATES) for i, t in enumerate(texts)}
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(got[i][1] == (pytest.approx(w[1], abs=2e-6) if w[0] else None) for i, w in want.items()) and sum(w[0] is not None for w in want.values()) > 50


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(1, 40), rng.choice([[0], [1], [0, 1], [1, 0, 1], []])) for i in range(2000)]
    table = spark.createDataFrame(rows, "_row long, _size long, m array<int>")
    total = sum(s for _, s, _ in rows)
    want = {0: 0.5 * total, 1: 0.3 * total}
    out = mixing.mix(table, "m", want).collect()
    assert len(out) == len(rows) and all(r.taken == 0 for r in out if not r.m)
    assert abs(sum(r.taken for r in out) - sum(want.values())) <= 0.01 * total
    # Nothing repeats, as one copy of everything is enough.
    assert all(r.taken <= r._size for r in out)


def test_mix_goes_on_after_a_document_that_does_not_fit(spark):
    sizes = [250] * 5000 + [1_000_000]
    got = []
    for seed in range(3):
        rows = [(i, s, [0]) for i, s in enumerate(sizes)]
        out = mixing.mix(spark.createDataFrame(rows, "_row long, _size long, m array<int>"), "m", {0: sum(sizes) / 2}, seed=seed).collect()
        assert len(out) == len(rows) and all(r.taken in (0, r._size) for r in out)
        got.append(sum(r.taken for r in out) / (sum(sizes) / 2))
    assert all(1 - 250 / (sum(sizes) / 2) < x <= 1 for x in got), got


def test_licence_headers_over_lines_inside_lines_and_whole_texts(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, "a/x", "This work is licensed under the GNU\nGeneral Public License, version 3.\n\ncode"), (2, "b/x", f"Copyright 2020 Foo. {mit}"), (3, "c/x", f"{prose} {gpl} {prose}"),
        (4, "d/x", f"{prose}\n# This work is licensed\n# under the GNU General\n# Public License,\n# version 3.\n{prose}"), (5, "e/LICENSE", licenses.full_texts()["MIT"].replace("<year> <copyright holders>", "2020 Foo")),
        (6, "e/y", "x"), (7, "f/COPYING", licenses.full_texts()["LGPL-3.0"]), (8, "g/x", licenses.full_texts()["MIT"].split("\n", 1)[1]), (9, "h/x", f"{prose} the public version of the general work {prose}"),
    ]
    got = {r.id: (r.licence, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string"), "id", "path", "text").collect()}
    assert got == {
        1: ("GPL-3.0", "own"), 2: ("MIT", "own"), 3: ("GPL-3.0", "own"), 4: ("GPL-3.0", "own"), 5: ("MIT", "own"), 6: ("MIT", "inherited"), 7: ("LGPL-3.0", "own"), 8: (None, "none"), 9: (None, "none"),
    }


def test_licence_hints_lose_nothing():
    vectors, _ = licenses.template_weights(licenses.TEMPLATES)
    hints = licenses.hint_terms(licenses.TEMPLATES, licenses.LEAST)
    assert all(sum(v * v for t, v in w.items() if t not in hints) < licenses.LEAST**2 for w in vectors.values())


def test_secret_threshold_keeps_the_recall():
    rng = np.random.default_rng(1)
    net = secrets.CharNet()
    x, y = rng.integers(0, 24, (400, secrets.WIDTH)), (np.arange(400) % 2).astype(float)
    net.calibrate(x, y)  # an untrained network: its secrets' probabilities are low
    p = net.probability(net.logits(x))
    assert net.threshold < 0.9 and (p[y > 0] >= net.threshold).mean() >= secrets.RECALL


def test_secrets_inside_long_runs_are_seen():
    class Sees:
        threshold = 0.5
        probability = staticmethod(lambda z: z)
        logits = staticmethod(lambda x: (np.lib.stride_tricks.sliding_window_view(x[:, secrets.BEFORE :], 20, axis=1) == 11).all(2).any(1).astype(float))

    for at in range(0, 400, 7):
        run = "ab/c" * 100
        run = run[:at] + "7" * 20 + run[at:]
        assert secrets.spans_of(f"see {run} end", Sees) == [(4, 4 + len(run), "model")]
    assert secrets.spans_of("see " + "ab/1" * 100, Sees) == []
