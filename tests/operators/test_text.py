import random
import re

import pytest
from pyspark.sql import functions as F

from coppice.operators import extraction as X
from coppice.operators import mentions as M
from coppice.operators import search as S
from coppice.operators import search_index as I
from coppice.operators import vectors as V

A = "0x" + "Ab" * 20
B = "0x" + "cd" * 20
SOL = "1A2B3C4D5E6F7G8H9JAKBLCMDNEPFQGRHSJTKULVMWNX"[:44]


def nodes(spark, *texts):
    return spark.createDataFrame([(f"n{i}", t, i) for i, t in enumerate(texts)], "id string, content string, ord int")


def test_chains(spark):
    texts = [f"the address on Base is {A}", f"on base and ethereum: {A}", f"plain {A}", "arbitrum " + "x" * 150 + f" polygon {A}", "gnosis " + "x" * 150 + f" {A}", f"ébase {A}"]
    got = {r.id: r.chain for r in M.extract_addresses(nodes(spark, *texts)).collect()}
    assert got == {"n0": "base", "n1": "ethereum", "n2": "ethereum", "n3": "polygon", "n4": "gnosis", "n5": "base"}


def test_matches(spark):
    text = f"{A} {A.lower()} {SOL} 0x{'a' * 64} é{SOL[:43]}"
    rows = M.extract_addresses(nodes(spark, text)).orderBy("pos").collect()
    assert [(r.address, r.pos, r.chain) for r in rows] == [(A.lower(), 0, "ethereum"), (SOL, 86, "solana"), (SOL[:43], text.rindex(SOL[:43]), "solana")]
    assert rows[0].explorer_url == "https://etherscan.io/address/" + A.lower()


def test_roles_labels_tokens(spark):
    texts = [
        f"the Grove Foundation address is {A}. It holds USDS, sUSDS and USDS. A multisig, with a subproxy; Aave.",
        f"Uniswap proxy. Recipient: Some Party {A}",
        f"| Name | Address | Role |\n|---|---|---|\n| **Fine Vault** | `{A}` | signer |",
        f"| Address | X |\n| - | - |\n| {A} | 12.5 |",
        f"This at address {A}",
    ]
    got = {r.id: r for r in M.extract_addresses(nodes(spark, *texts)).collect()}
    assert got["n0"].label == "Grove Foundation" and got["n0"].tokens == ["USDS", "sUSDS"]
    assert got["n0"].roles == ["grove", "multisig", "subproxy", "foundation"]
    assert got["n1"].roles == ["external", "proxy"] and got["n1"].label == "Some Party"
    assert got["n2"].label == "Fine Vault" and set(got["n2"].roles) == {"vault", "signer"}
    assert got["n3"].label is None and got["n4"].label is None


def test_merge_and_enrich(spark):
    rows = [("n0", 0, "a", 5, "ethereum", "Contract", ["x"], ["DAI"]), ("n1", 1, "a", 1, "base", "Ops", ["y"], []), ("n2", 2, "a", 0, "arbitrum", "Spark Ops", ["x"], ["SKY"]), ("n3", 3, "b", 0, "ethereum", "Contract", [], []), ("n3", 3, "c", 9, "ethereum", None, [], [])]
    found = spark.createDataFrame(rows, "id string, ord int, address string, pos int, chain string, label string, roles array<string>, tokens array<string>")
    merged = X.merge_addresses(found)
    got = {r.address: (r.chain, r.label, r.aliases, r.roles, r.tokens, r.refs) for r in merged.collect()}
    assert got == {"a": ("base", "Spark Ops", ["Contract", "Ops"], ["x", "y"], ["DAI", "SKY"], 3), "b": ("ethereum", "Contract", [], [], [], 1), "c": ("ethereum", None, [], [], [], 1)}
    assert {r.id: r.address_refs for r in X.address_refs(found.select("id").distinct(), found).collect()}["n3"] == ["b", "c"]

    columns = "address string, chain string, explorer_url string, label string, aliases array<string>, roles array<string>, tokens array<string>"
    base = spark.createDataFrame([("0xa", "ethereum", "", "Vat", [], [], []), ("0xb", "base", "", "Vat", [], [], []), ("s", "solana", "", "Sol", ["z"], [], []), ("0xc", "other", "", None, [], [], [])], columns)
    registry = spark.createDataFrame([("OLD", "0xA", 0), ("MCD_VAT", "0xA", 1), ("MCD_VAT", "0xb", 2)], "name string, address string, ord int")
    verified = spark.createDataFrame([(1, "0xa", "Vat2", True, "0xi"), (8453, "0xb", "Vat2", False, ""), (1, "0xc", "", False, "")], "chain_id int, address string, contract_name string, is_proxy boolean, implementation string")
    out = {r.address: r for r in X.enrich(base, registry, verified).collect()}
    assert (out["0xa"].label, out["0xa"].aliases, out["0xa"].is_contract, out["0xa"].implementation) == ("MCD_VAT", ["Vat", "Vat2"], True, "0xi")
    assert (out["0xb"].label, out["0xb"].aliases, out["0xb"].registry_name) == ("Vat", ["Vat2"], None)
    assert (out["s"].label, out["s"].aliases, out["s"].is_contract) == ("Sol", ["z"], False)
    assert (out["0xc"].label, out["0xc"].chain_id, out["0xc"].is_contract) == (None, 1, False)
    cache = spark.createDataFrame([(1, "0xz")], "chain_id int, address string")
    assert [r.address for r in X.missing_implementations(X.enrich(base, registry, verified), cache).collect()] == ["0xi"]


def test_links_and_parties(spark):
    u = "18ac7dd3-c646-4352-9b0d-d01a2932d7d1"
    text = f"[a]({u}) [b](http://x) [c]({u}) Transaction Hash: 0x{'b' * 64} and {B}"
    table = nodes(spark, text)
    assert [r.target for r in X.links(table).collect()] == [u]
    spans = X.auto_links(table, spark.createDataFrame([(B, "https://x/" + B)], "address string, explorer_url string")).orderBy("pos").collect()
    assert [(r.kind, r.url) for r in spans] == [("tx", "https://etherscan.io/tx/0x" + "b" * 64), ("evm", "https://x/" + B)]
    assert text[spans[0].pos :].startswith("0xbbb")
    row = spark.range(1).select(X.has_math(F.lit("a $x")).alias("a"), X.has_math(F.lit("5 $ a")).alias("b"), X.party_of(F.lit("Responsible Party: is the Team X.\n")).alias("p"), X.party_of(F.lit("")).alias("q"), X.process_of(F.lit("Update Process: must follow the protocol for 'Alignment Conserver Changes'")).alias("r"), X.agent_of(F.lit("A.6.1.1.2.7")).alias("g"), X.agent_of(F.lit("A.6.1.1.2")).alias("h")).first()
    assert (row.a, row.b, row.p, row.q, row.r, row.g, row.h) == (True, False, "Team X", "Unknown", "Alignment Conserver Changes", "Grove", None)


def test_query_language():
    q = S.parse('"surplus buffer" USDS in:a.1 in:A.2 type:"Active Data"')
    assert q.phrases == ["surplus buffer", "USDS"] and q.scope == "A.2" and q.type == "Active Data"
    assert S.parse("title:USDS").phrases == [] and S.parse("-USDS").phrases == []
    assert S.parse("-USDS").terms == [S.Term("usds", presence="not")]
    assert S.parse("govern* misaligment~1 delegate^5 +must title:quorum").terms == [S.Term("govern", prefix=True), S.Term("misaligment", edits=1), S.Term("delegate", boost=5.0), S.Term("must", presence="must"), S.Term("quorum", "title")]
    assert S.parse("0x35d1").terms == [S.Term("0x35d1", prefix=True)]
    assert S.parse("18AC7DD3-c646-4352-9b0d-d01a2932d7d1").id == "18ac7dd3-c646-4352-9b0d-d01a2932d7d1"
    assert S.parse("MCD_VAT").registry_id == "MCD_VAT" and S.parse("").terms == []
    # Tried again with a wildcard behind each word; a field that there is none of, or no number, then finds nothing.
    for text in ("nofield:licence", "licence~", "a^x b", "a~b"):
        assert S.parse(text).nothing, text
    assert not S.parse("title: b").nothing and S.parse("title: b").terms == [S.Term("", "title", prefix=True), S.Term("b", prefix=True)]
    assert S.parse("+ a~1").terms == [S.Term("", prefix=True, presence="must"), S.Term("a", edits=1), S.Term("", prefix=True)]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_deletion_variants_meet(spark, edits):
    rng = random.Random(edits)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(300)})
    table = spark.createDataFrame([(w,) for w in words], "term string")
    got = {}
    for r in S.variants_of(table, edits).collect():
        got.setdefault(r.term, set()).add(r.variant)
    assert got == {w: set(S.deletion_variants(w, edits)) for w in words}
    near = table.alias("a").join(table.alias("b"), F.levenshtein("a.term", "b.term") <= edits).selectExpr("a.term x", "b.term y").collect()
    assert all(got[r.x] & got[r.y] for r in near)


def test_stored_index(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(60)), f"t{i % 5} common") for i in range(300)] + [(300, None, ""), (301, "", None)]
    table = spark.createDataFrame(docs, "id long, content string, title string")
    fields, path = ["content", "title"], str(tmp_path / "index")
    I.add(table.where("id < 200"), "id", fields, path, parts=12)
    I.add(table.where("id >= 200"), "id", fields, path, parts=12)
    spark.range(3).write.parquet(f"{path}/postings/segment=7")  # a segment that was not finished counts for nothing
    plain, stats = S.postings(table, "id", fields), S.field_stats(table, fields)
    queries = ["w1 w7", "+w1 -w2 common", "w39*", "title:t3 w11~1^2", "w12~2", "absent", "title:*", "w1~3", "nofield:w1"]
    rows = lambda df: {r.id: (round(r.score, 9), sorted(r.fields), sorted(r.matched)) for r in df.collect()}
    for text in queries:
        q = S.parse(text)
        want = rows(S.score(plain, stats, q, "id"))
        assert rows(S.score(I.open_index(spark, path, "id"), None, q, "id")) == want, text
        assert bool(want) != (text in ("absent", "nofield:w1"))
    # A search of one term reads the files that hold it, not the index.
    index = I.open_index(spark, path, "id")
    files = lambda df: _scan_metric(df, "numFiles")
    assert files(index.postings) == 24 and 1 <= files(index.held(S.parse("content:w77"))) <= 4
    assert _scan_metric(index.held(S.parse("content:w77")), "filesSize") * 5 < _scan_metric(index.postings, "filesSize")
    I.merge(spark, path, "id", parts=6)
    merged = I.open_index(spark, path, "id")
    assert len(merged.segments) == 1 and rows(S.score(merged, None, S.parse("w1 w39*"), "id")) == rows(S.score(plain, stats, S.parse("w1 w39*"), "id"))


def _scan_metric(df, name):
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply(name).value() for i in range(leaves.size()))


def test_marks_of_matched_terms(spark):
    rows = [("a", "A.1", "On <licence>", "Core", "x " * 80 + "about govern and governance, a license & more " + "y " * 90, 0, []), ("b", "A.2", "B", "Core", "", 1, ["0x1"])]
    table = spark.createDataFrame(rows, "id string, doc_no string, title string, type string, content string, ord int, address_refs array<string>")
    fields = ["title", "doc_no", "type", "content"]
    index, stats = S.postings(table, "id", fields), S.field_stats(table, fields)
    one = lambda q: S.hits(table, index, stats, q).first()
    assert "about <mark>govern</mark> and <mark>governance</mark>, a license &amp; more" in one("govern*").snippet
    fuzzy = one("content:licence~2")
    assert "a <mark>license</mark> &amp; more" in fuzzy.snippet and fuzzy.snippet.startswith("…") and fuzzy.title_html == "On &lt;<mark>licence</mark>&gt;"
    named = S.hits(table, index, stats, "QQQ_ZED", spark.createDataFrame([("0x1", "QQQ_ZED")], "address string, registry_name string")).collect()
    assert [(r.id, r.tier, r.score, r.snippet, r.match_reason) for r in named] == [("b", 2, 2.0, "", "registry")]


def test_hits(spark):
    rows = [("a", "A.1", "Alpha <b>", "Core", "the alpha text " + "x " * 100, 0, ["0x1"]), ("b", "A.1.2", "Beta", "Core", "alpha beta gamma", 1, []), ("c", "A.10", "Gamma", "Scope", "alphabet", 2, ["0x1"])]
    table = spark.createDataFrame(rows, "id string, doc_no string, title string, type string, content string, ord int, address_refs array<string>")
    fields = ["title", "doc_no", "type", "content"]
    index, stats = S.postings(table, "id", fields), S.field_stats(table, fields)
    addresses = spark.createDataFrame([("0x1", "MCD_ALPHA")], "address string, registry_name string")
    find = lambda q: [r.id for r in S.hits(table, index, stats, q, addresses).collect()]
    assert find("alpha") == ["a", "b"] and find("in:A.1 alph*") == ["a", "b"] and find("in:a.1.2 alpha") == ["b"]
    assert find("+alpha -beta") == ["a"] and find('type:"scope" alphabet') == ["c"] and find('"beta gamma"') == ["b"]
    assert find("title:gamma") == ["c"] and find("alpa~1") == ["a", "b"] and find("") == []
    assert find("MCD_ALPHA") == ["a", "c"] or find("MCD_ALPHA")[0] == "a"
    first = S.hits(table, index, stats, "alpha").first()
    assert first.title_html == "<mark>Alpha</mark> &lt;b&gt;" and first.match_reason == "title + content" and first.snippet.endswith("…")
    assert S.page(table.orderBy("ord"), 1, 2).collect()[0].id == "c"


def test_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [4.0, 3.0]), (4, [4.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = {r.vec_id: r.v for r in table.select("vec_id", V.normalised(F.col("embedding")).alias("v")).collect()}
    assert unit[1] == pytest.approx([0.6, 0.8]) and unit[2] == [0.0, 0.0]
    assert [r.vec_id for r in V.top_k(table, [1.0, 0.0], 3).collect()] == [3, 4, 1]
    assert V.check_vectors(table, 3).count() == 4
    for k in (0, 51):
        with pytest.raises(ValueError):
            V.search(table, table, [1.0, 0.0], k)


def by_columns(nodes, key="id", text="content", order="ord"):
    """Addresses by the column expressions, a text beside each of its addresses."""
    found = X.occurrences(nodes, key, text, X.EVM, "evm").unionByName(X.occurrences(nodes, key, text, X.BASE58, "base58"))
    rows = X.first_by_key(found, key).join(nodes.select(key, F.col(text).alias("_t"), order), key)
    t, pos, size = F.col("_t"), F.col("pos"), F.length("found")
    rows = rows.withColumn("_table", X.table_context(t, pos)).withColumn("_note", X.annotation_text(t, pos, size, F.col("_table")))
    chain = F.when(F.col("kind") == "base58", "solana").otherwise(X.chain_of(t, pos))
    rows = rows.select(key, order, "address", "pos", chain.alias("chain"), X.roles_of(F.col("_note")).alias("roles"), X.label_of(t, pos, F.col("_table")).alias("label"), X.tokens_of(F.col("_note")).alias("tokens"))
    return rows.withColumn("explorer_url", X.explorer_url(F.col("chain"), F.col("address")))


def test_one_pass_finds_what_the_columns_say(spark):
    rng = random.Random(12)
    words = ["Sky Foundation", "aligned\u00a0delegate", "sub-proxy", "subproxy", "Proxy", "multi-sig", "Spark", "SparkLend", "uniswap", "Chainlink", "on Base", "arb", "OP Mainnet", "gnosis safe", "USDS", "sUSDS,", "stUSDS", "The Treasury address is", "address of the Grove\r\nOne is", "Owner: Some Name", "**Bold Name**:", "address on the Arbitrum One is", "é", "\U0001f600", "price-feed", "staking  rewards", "reserves", "MATIC", "at address", "It at address", "\n", "\n\n"]
    cells = ["", "a", "Name", "**The Vault**", "12.5%", "[Link](x)", "`code`", "Purpose", "Recipient one", A]
    address = lambda: rng.choice([A, B, SOL, "0x" + "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(40)), "0x" + "1" * 41])
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            if rng.random() < 0.3:
                width = rng.randrange(1, 5)
                row = lambda w=width: "|" + "|".join(rng.choice([f" {rng.choice(cells)} ", f" {address()} "]) for _ in range(w)) + "|" + "\r" * (rng.random() < 0.1)
                parts.append("\n" + "\n".join([row(), "|" + "---|" * width, *(row() for _ in range(rng.randrange(4)))][rng.randrange(2) :]) + "\n")
            parts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(8))) + " " + address())
        texts.append(" ".join(parts))
    table = nodes(spark, *texts, "", "no address")
    key = lambda df: sorted((r.id, r.ord, r.address, r.pos, r.chain, r.roles, r.label or "", r.tokens, r.explorer_url) for r in df.collect())
    got, want = key(M.extract_addresses(table)), key(by_columns(table))
    assert len(want) > 700 and len({r[4] for r in want}) > 4 and sum(bool(r[6]) for r in want) > 200
    assert got == want


def test_many_addresses_in_one_text(spark):
    lines = "\n".join(f"| name {i} | 0x{i:040x} |" for i in range(8000))
    table = nodes(spark, "| Name | Address |\n|---|---|\n" + lines)
    rows = {r.address: r.label for r in M.extract_addresses(table).select("address", "label").collect()}
    assert len(rows) == 8000 and rows[f"0x{77:040x}"] == "name 77"
    assert X.occurrences(table, "id", "content", X.EVM, "evm").select(F.sum("pos")).first()[0] == sum(m.start() for m in re.finditer("0x", "| Name | Address |\n|---|---|\n" + lines))


def test_an_identifier_needs_no_index(spark, monkeypatch):
    from coppice.plans import text_queries as Q

    monkeypatch.setattr(Q, "_index", lambda *_: pytest.fail("an index is made"))
    assert Q.search_by_id(spark, "/root/testdata/sf0.001").count() == 1


def test_files_of_postings_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "TERMS", 20, raising=False)
    docs = spark.createDataFrame([(i, f"w{i} x{i} y{i} z") for i in range(100)], "k int, text string")
    I.add(docs, "k", ["text"], str(tmp_path))
    index = I.open_index(spark, str(tmp_path), "k")
    assert index.postings.select("part").distinct().count() > 10 and index.dictionary.where("term = 'z'").first().df == 100


def test_an_index_is_smaller_than_variants_of_its_terms(spark, tmp_path):
    """Rows of all tables of an index together are in proportion to the postings; edits are still found at any number."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 12))) for _ in range(500)})
    docs = spark.createDataFrame([(i, " ".join(words[i * 10 : i * 10 + 10])) for i in range(50)], "k int, text string")
    I.add(docs, "k", ["text"], str(tmp_path), parts=3)
    rows = sum(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir())
    assert rows < 3 * len(words), rows
    index = I.open_index(spark, str(tmp_path), "k")
    for edits in (1, 2, 4):
        pairs = spark.createDataFrame([(w,) for w in words], "term string").where(F.levenshtein("term", F.lit(words[7])) <= edits)
        assert {r.term for r in index.near(words[7], edits).collect()} == {r.term for r in pairs.collect()}, edits


def test_a_small_table_of_nodes_is_indexed_by_many_tasks(spark, monkeypatch):
    from coppice.plans import text_queries as Q

    seen = []
    monkeypatch.setattr(Q, "_index", lambda s, d, name, batches, *_: seen.append(batches()[0].rdd.getNumPartitions()))
    monkeypatch.setattr(Q.S, "hits", lambda *_: None)
    monkeypatch.setattr(Q, "load", lambda s, d, t: s.read.parquet(f"{d}/{t}.parquet").coalesce(1))
    Q._hits(spark, "/root/testdata/sf0.001", "USDS")
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))] and seen[0] > 1
