import json
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coppice.operators import chainstate as C
from coppice.operators import history as D
from coppice.operators import reports as R
from coppice.operators.tools import Tools
from coppice.sources import readers, sinks
from coppice.streaming import incremental, snapshots


def test_edit_scripts():
    assert "".join(o + t for o, t in D.edit_script(list("abc"), list("axc"))) == "=a-b+x=c"
    assert D.word_diff("b c", "b x") == [("=", "b "), ("-", "c"), ("+", "x")]
    assert D.line_diff("a\nb c\nd", "a\nb x\nd") == [("=", "a", None), ("~", None, [("=", "b "), ("-", "c"), ("+", "x")]), ("=", "d", None)]
    assert D.line_diff("same", "same") == [] and D.line_diff(None, None) == []
    far = D.line_diff("\n".join(map(str, range(20))), "\n".join("x" if i in (2, 15) else str(i) for i in range(20)))
    assert [r[0] for r in far] == list("==-+==…==-+==")


def test_diffs_of_a_batch_are_few_objects_at_a_time():
    texts = ["\n".join(f"line {j} of text {i} {'x' if j % 3 else i}" for j in range(30)) for i in range(1001)]
    old, new = [*texts[:-1], None], [*texts[1:], ""]
    tracemalloc.start()
    got = D.line_diffs(pa.array(old), pa.array(new))
    peak = tracemalloc.get_traced_memory()[1]  # without Arrow's own
    tracemalloc.stop()
    assert peak < 8 << 20
    want = [[{"op": op, "text": t, "segs": s and [{"op": o, "text": x} for o, x in s]} for op, t, s in D.line_diff(a, b)] for a, b in zip(old, new, strict=True)]
    assert got.to_pylist() == want and D.line_diffs(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []


def test_edit_script_replays():
    import random

    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        ops = D.edit_script(a, b)
        assert [t for o, t in ops if o != "+"] == a and [t for o, t in ops if o != "-"] == b


def test_scores_and_bullets(spark):
    cases = [("Update Emergency Response Article", "Emergency Response", None, 1.0), ("Risk Review", "Core Council Risk Advisor", None, 0.25), ("Risk Review", "Core Council Risk Advisor", "council advisor duties", 0.45), ("", "x", None, 0.0)]
    rows = spark.createDataFrame(cases, "b string, n string, d string, want double").withColumn("got", D.match_score(F.col("b"), F.col("n"), F.col("d"))).collect()
    assert [r.got for r in rows] == pytest.approx([r.want for r in rows])
    prs = spark.createDataFrame([(7, "- **One** — first\ntext\n* **Two** - second\n- plain")], "number int, body string")
    assert [(r.pos, r.title, r.description) for r in D.bullets(prs).orderBy("pos").collect()] == [(0, "One", "first"), (1, "Two", "second")]
    messages = spark.createDataFrame([("Edit (#186)",), ("Edit (#186) more",)], "m string")
    assert [r[0] for r in messages.select(D.pr_number(F.col("m"))).collect()] == [186, None]


def test_best_bullets_by_brute_force(spark):
    """Common and rare words, words of the description alone, repeated titles and bullets, ties, nulls and empty titles."""
    rng = random.Random(5)
    words = ["common", "usual", *(f"w{i}" for i in range(12))]
    text = lambda most: " ".join(rng.choice(words[: rng.choice((3, 14))]) for _ in range(rng.randrange(most)))
    nodes = [(rng.choice((1, 2, None)), i, rng.choice((text(14), "The Of", None, "Common usual"))) for i in range(60)]
    bullets = [(rng.choice((1, 2)), i, text(6), rng.choice((text(9), None))) for i in range(40)]
    bullets += [(c, i + 100, t, d) for c, i, t, d in bullets[:10]]
    n = spark.createDataFrame(nodes, "change int, id int, title string")
    b = spark.createDataFrame(bullets, "change int, pos int, title string, description string")
    paired = n.withColumnRenamed("title", "node_title").join(b, "change").select("id", "pos", D.match_score(F.col("title"), F.col("node_title"), F.col("description")).alias("s")).collect()
    for threshold in (0.35, 0.5, 0.2, 0.05):
        want: dict = {}
        for r in paired:
            if r.s is not None and r.s >= threshold and (r.id not in want or (-r.s, r.pos) < want[r.id]):
                want[r.id] = (-r.s, r.pos)
        got = D.best_bullets(n, b, "change", threshold=threshold).collect()
        assert {(r.id, r.pos, r.score) for r in got} == {(i, pos, -s) for i, (s, pos) in want.items()} and len(got) == len(want) > 0
    assert D.best_bullets(n, b.limit(0), "change").count() == 0 and D.best_bullets(n.limit(0), b, "change").count() == 0


def test_history_entries(spark):
    nodes = spark.createDataFrame([("a", 0, "T one", "x"), ("a", 1, "T one", "y"), ("b", 1, "Emergency Response", "l1\nl2"), ("b", 2, "Emergency Response", "l1\nl2")], "id string, seq int, title string, content string")
    changes = D.snapshot_diff(D.with_hash(nodes))
    assert {(r.id, r.seq, r.change) for r in changes.collect()} == {("a", 0, "added"), ("a", 1, "modified"), ("b", 1, "added"), ("a", 2, "removed")}
    commits = spark.createDataFrame([(0, "h0" * 5, "2024-01-01T00:00", "first"), (1, "h1" * 5, "2024-01-02T00:00", "Edit (#5)"), (2, "h2" * 5, "2024-01-03T00:00", "Gone (#6)")], readers.COMMITS)
    prs = spark.createDataFrame([(5, "PR five", "ann", "u5", "- **Update Emergency Response** — why", 1, 0, 2), (6, "PR six", None, "u6", "plain", 0, 0, 0)], "number int, title string, author string, url string, body string, review_count int, approval_count int, comment_count int")
    rows = {(r.id, r.seq): r for r in D.entries(changes, commits, prs, nodes).collect()}
    assert rows["a", 0].diff is None and rows["a", 0].pr is None and rows["a", 0].date == "2024-01-01" and rows["a", 0].commit_hash == "h0h0h0h"
    assert [(x.op, x.text) for x in rows["a", 1].diff] == [("-", "x"), ("+", "y")] and rows["a", 1].summary is None
    assert rows["b", 1].summary == "Update Emergency Response" and rows["b", 1].description == "why" and rows["b", 1].review_count == 1 and rows["b", 1].approval_count is None
    assert [(x.op, x.text) for x in rows["b", 1].diff] == [("+", "l1"), ("+", "l2")]
    assert (rows["a", 2].summary, rows["a", 2].description) == ("PR six", "plain") and rows["a", 2].diff[0].op == "-"
    assert [r.seq for r in D.after_checkpoint(commits, "h1" * 5).collect()] == [2] and D.after_checkpoint(commits, "zz").count() == 3


def test_upserts_and_streams_are_idempotent(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    put = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
    run = lambda: incremental.process_new(spark, source, "id string, commit_hash string", target, check, lambda b: b)
    put("1.json", [{"id": "a", "commit_hash": "x"}, {"id": "a", "commit_hash": "x"}])
    run()
    run()
    put("2.json", [{"id": "a", "commit_hash": "x"}, {"id": "a", "commit_hash": "y"}])
    run()
    assert {r.id: r.n for r in incremental.manifest(spark.read.parquet(target)).collect()} == {"a": 2}
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, commit_hash string")
    once = sinks.merge_history(rows.limit(0), rows, str(tmp_path / "h1"))
    again = sinks.merge_history(spark.read.parquet(str(tmp_path / "h1/entries")), rows, str(tmp_path / "h2"))
    assert sorted(once.collect()) == sorted(again.collect())


def test_chain_state(spark):
    abi = json.dumps([{"type": "function", "name": "f", "stateMutability": "view", "inputs": []}, {"type": "function", "name": "g", "stateMutability": "view", "inputs": [{"name": "x", "type": "uint"}]}, {"type": "function", "name": "h", "stateMutability": "nonpayable", "inputs": []}, {"type": "event", "name": "e"}])
    addresses = spark.createDataFrame([("0xa", "A", "ethereum", True, "0xi"), ("0xb", "B", "ethereum", False, None), ("0xc", None, "ethereum", False, None), ("0xd", "D", "base", False, None)], "address string, registry_name string, chain string, is_proxy boolean, implementation string")
    cache = spark.createDataFrame([(1, "0xi", abi), (1, "0xa", "[]")], "chain_id int, address string, abi string")
    todo = C.calls(C.with_abi(C.readable(addresses), cache))
    assert [(r.address, r.fn) for r in todo.collect()] == [("0xa", "f")]
    results = spark.createDataFrame([("0xa", "f", 0, "1", "success"), ("0xa", "f", 1, None, "failure"), ("0xa", "k", 2, C.ZERO, "success"), ("0xa", "n", 3, "7", "success")], "address string, fn string, pos int, value string, status string")
    state = C.state_long(results)
    assert C.state_nested(state).first()["values"] == {"f": None, "k": C.ZERO, "n": "7"}
    assert [r.fn for r in C.shown(state).collect()] == ["n"] and tuple(C.success_counts(state).first()) == (2, 1)
    values = spark.createDataFrame([(None,), ('"x"',), ("[1, 2]",), ("true",), ('{"a":1}',)], "v string").select(C.format_value(F.col("v"))).collect()
    assert [r[0] for r in values] == ["—", "x", "1, 2", "true", '{"a":1}']


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "x", "A", None), ("d2", "y", None, ["A", "B"]), ("d3", "x", None, None)], "doc_no string, category string, agent string, agents array<string>")
    chains = spark.createDataFrame([("A", "f1", "Fay", "X1"), ("B", "f1", "Fay", "X2")], "agent_name string, facilitator_id string, facilitator_name string, executor_name string")
    assert {r.doc_no for r in R.responsibilities(rows, chains, agent="B").collect()} == {"d2"}
    assert {r.doc_no for r in R.responsibilities(rows, chains, facilitator="Fay").collect()} == {"d1", "d2"}
    assert {(r.doc_no, r.executor_name) for r in R.row_facilitators(rows, chains).collect()} == {("d1", "X1"), ("d2", "X1")}
    assert [(r.label, r.n) for r in R.by_category(rows, {"y": "Why", "x": "Ex", "z": "Zed"}).collect()] == [("Why", 1), ("Ex", 2)]
    table = spark.createDataFrame([('say "hi", ok', 1)], "a string, b int")
    sinks.csv(table, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first().a == 'say "hi", ok'


def test_readers(spark, tmp_path):
    (tmp_path / "docs.json").write_text(json.dumps({"u1": {"id": "u1", "doc_no": "A.1", "title": "T", "type": "Core", "depth": 1, "parentId": None, "content": "c", "order": 0}}))
    node = readers.nodes(spark, str(tmp_path / "docs.json")).first()
    assert (node.id, node.doc_no, node.address_refs) == ("u1", "A.1", [])
    (tmp_path / "reg.json").write_text(json.dumps({"X": "0xAB", "v": "1.0"}))
    assert [(r.name, r.address) for r in readers.registry(spark, str(tmp_path / "reg.json")).collect()] == [("X", "0xab")]
    assert readers.or_empty(lambda: readers.nodes(spark, str(tmp_path / "none.json")), "id string", spark).isEmpty()
    (tmp_path / "v.bin").write_bytes(b"\x00\x00\x80?\x00\x00\x00@" * 3)
    assert [r.embedding for r in readers.flat_vectors(spark, str(tmp_path / "v.bin"), 2).collect()] == [[1.0, 2.0]] * 3
    (tmp_path / "hist").mkdir()
    (tmp_path / "hist" / "n1.json").write_text(json.dumps([{"date": "2024-01-01", "commitHash": "h", "changeType": "modified", "diff": [["=", "a"], ["~", [["-", "b"], ["+", "c"]]], ["…"]]}]))
    entry = readers.histories(spark, str(tmp_path / "hist")).withColumn("d", F.transform("diff", readers.diff_rows)).first()
    assert entry.id == "n1" and [(x.op, x.text, None if x.segs is None else [tuple(s) for s in x.segs]) for x in entry.d] == [("=", "a", None), ("~", None, [("-", "b"), ("+", "c")]), ("…", None, None)]
    answers = spark.createDataFrame([("0xa", json.dumps({"status": "1", "result": [{"ContractName": "V", "ABI": readers.UNVERIFIED, "Proxy": "1", "Implementation": "0xAB"}]})), ("0xb", json.dumps({"status": "0", "result": "nope"})), ("0xc", None)], "a string, r string")
    got = {r.address: (r.contract_name, r.abi, r.is_proxy, r.implementation) for r in answers.select(*readers.lookup_entry(F.lit(1), F.col("a"), F.col("r"))).collect()}
    assert got == {"0xa": ("V", "", True, "0xab"), "0xb": ("", "", False, ""), "0xc": ("", "", False, "")}
    found = readers.embed(spark.createDataFrame([("x",), ("yy",)], "embed_text string"), lambda ts: [[float(len(t)), 0.0] for t in ts], 2).collect()
    assert [r.embedding for r in found] == [[1.0, 0.0]] * 2


def test_tools(spark):
    nodes = spark.createDataFrame([("a", "A.1", "One", "Core", None, "text", 0, []), ("b", "A.1.1", "Two", "Note", "a", "more", 1, ["0x1"])], "id string, doc_no string, title string, type string, parent_id string, content string, ord int, address_refs array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "id string, embedding array<double>")
    tools = Tools(nodes, vectors, lambda q: [1.0, 0.0])
    call = lambda name, **a: tools.handle({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})
    items = lambda r: json.loads(r["result"]["content"][0]["text"])
    assert [x["id"] for x in items(call("search", query="q"))] == ["a", "b"] and [x["id"] for x in items(call("search", query="q", type="Note"))] == ["b"]
    assert items(call("get", id="A.1.1"))[0]["parent_doc_no"] == "A.1" and items(call("get", id="b"))[0]["id"] == "b"
    assert {x["section"] for x in items(call("neighbors", id="a", window=4))} == {"self", "child"}
    assert call("get", id="zzz")["result"]["isError"] and call("search", query="q", k=99)["result"]["isError"]
    assert len(tools.handle({"id": 1, "method": "tools/list"})["result"]["tools"]) == 3
    assert tools.handle({"id": 1, "method": "nope"})["error"]["code"] == -32601 and tools.handle({"id": 1, "method": "ping"})["result"] == {}
    assert "protocolVersion" in tools.handle({"id": 1, "method": "initialize"})["result"]


def test_files_are_read_in_blocks(spark, tmp_path):
    rng = random.Random(3)
    odd = ['a, "b" {c} [d] \\ ', "tail\\\\", "é,\n}", "", '","', "]]]}}}{{{"]
    value = lambda i: {"id": f"k{i}", "title": rng.choice(odd), "depth": i, "content": "".join(rng.choice(odd) for _ in range(rng.randrange(9))), "addressRefs": [rng.choice(odd) for _ in range(i % 4)]}
    maps = [{f"k, {i}" if i % 5 else f"{{{i}": value(i) for i in range(400)}, {}, {"one": value(1)}]
    for n, m in enumerate(maps):
        (tmp_path / f"m{n}.json").write_text(json.dumps(m, ensure_ascii=bool(n), indent=2 if n else None))
    (tmp_path / "text.md").write_text("\n".join(f"line {i} é" for i in range(3000)))
    want = {k: v for m in maps for k, v in m.items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = readers.json_map(spark, str(tmp_path / "m*.json"), "struct<id: string, title: string, depth: int, content: string, addressRefs: array<string>>")
        rows = got.collect()
        assert len(rows) == len(want) and {r.key: r.value.asDict() for r in rows} == want
        lines = readers.split_file(spark, str(tmp_path / "text.md"))
        assert lines.select("block").distinct().count() > 20
        assert [(r.n, r.piece) for r in lines.orderBy("n").collect()] == [(i, f"line {i} é") for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_vectors_have_one_numbering(spark, tmp_path):
    np.arange(40, dtype="<f4").tofile(tmp_path / "b.bin")
    np.arange(100, 112, dtype="<f4").tofile(tmp_path / "c.bin")
    rows = readers.flat_vectors(spark, str(tmp_path / "*.bin"), 4).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(13)) and rows[9].embedding == [36.0, 37.0, 38.0, 39.0] and rows[12].embedding[0] == 108.0
    np.zeros(3, dtype="<f4").tofile(tmp_path / "d.bin")
    with pytest.raises(ValueError, match="no multiple"):
        readers.flat_vectors(spark, str(tmp_path / "*.bin"), 4)


def whole_table(a, b):
    """The edit script by the whole table, with the same rule for ties."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("=", a[i]))
        elif not i or (j and t[i][j - 1] >= t[i - 1][j]):
            j -= 1
            out.append(("+", b[j]))
        else:
            i -= 1
            out.append(("-", a[i]))
    return out[::-1]


@pytest.mark.parametrize("kept", [1, 2, 5, 64])
def test_edit_scripts_equal_the_whole_table(monkeypatch, kept):
    rng = random.Random(kept)
    monkeypatch.setattr(D, "KEPT_ROWS", max(2, kept))
    for _ in range(150):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(40))] for _ in range(2))
        assert D.edit_script(a, b) == whole_table(a, b)


def test_edit_script_of_long_texts_needs_little_memory():
    rng = random.Random(1)
    a = [f"line {i}" for i in range(20_000)]
    b = [f"other {i}" if rng.random() < 0.1 else t for i, t in enumerate(a) if rng.random() > 0.05] + ["end"]
    tracemalloc.start()
    script = D.edit_script(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [t for op, t in script if op != "+"] == a and [t for op, t in script if op != "-"] == b
    assert most < 60 << 20  # the whole table takes 1.5 GB


def test_stream_of_snapshots_equals_the_batch_diff(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"n{i}", seq, rng.choice(["h1", "h2", None]), rng.choice("tu")) for i in range(40) for seq in range(10) if rng.random() < 0.7 and not (seq == 7)]
    rows += [("late", 9, "h", "t"), ("early", 0, "h", "t")]
    table = spark.createDataFrame(rows, "id string, seq int, content_hash string, title string")
    want = sorted((r.id, r.seq, r.change) for r in D.snapshot_diff(table).collect())
    for runs in (1, 3):
        got = snapshots.replay(table, runs).collect()
        assert sorted((r.id, r.seq, r.change) for r in got) == want
        by = {}
        for r in sorted(got, key=lambda r: (r.id, r.seq)):
            by.setdefault(r.id, []).append(r.n)
        assert all(n == list(range(1, len(n) + 1)) for n in by.values())
    assert snapshots.replay(table.limit(0)).count() == 0


def test_active_documents_come_after_the_sort(spark):
    nodes = spark.createDataFrame([("n2", "A.10", "ten", ""), ("n1", "A.9", "nine", ""), ("d1", "A.9.0.6.10", "", ""), ("d2", "A.9.0.6.2", "", "")], "id string, doc_no string, title string, content string")
    edges = spark.createDataFrame([("e", n, "responsible_for", ["s"]) for n in ("n2", "n1", "n1")], "from_id string, to_id string, edge_type string, sources array<string>")
    entities = spark.createDataFrame([("e", "E", "org")], "id string, name string, type string")
    chains = spark.createDataFrame([], "agent_name string, executor_name string, facilitator_name string, govops_name string")
    rows = R.active_data(edges, entities, nodes, chains)
    assert [(r.doc_no, r.active_docs) for r in rows.collect()] == [("A.9", ["A.9.0.6.2", "A.9.0.6.10"])] * 2 + [("A.10", [])]
    # No exchange or sort lies above the join that brings the documents.
    top = rows._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
    assert "Sort" not in top and "Exchange" not in top
