"""Entities in text: on-chain addresses with chain, roles, label and tokens; merging and enrichment; links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from coppice.functions.text import END, START, UUID, any_of, extract_or_null, trim_all, word

# ---- Fixed values -------------------------------------------------------------------------------------------
EVM = r"(?<![0-9a-fA-F])0x[0-9a-fA-F]{40}(?![0-9a-fA-F])"
BASE58 = START + r"[1-9A-HJ-NP-Za-km-z]{43,44}" + END
LINK = rf"\[[^\]]+\]\(({UUID})\)"
TX_HASH = r"(?i)Transaction\s+Hash:\s*(0x[0-9a-fA-F]{64})" + END
CHAINS = {
    "ethereum": ["ethereum", "mainnet"],
    "base": ["base"],
    "arbitrum": ["arbitrum", "arb"],
    "optimism": ["optimism", "op mainnet"],
    "polygon": ["polygon", "matic"],
    "avalanche": ["avalanche", "avax"],
    "gnosis": ["gnosis", "xdai"],
}
CHAIN_IDS = {"ethereum": 1, "base": 8453, "arbitrum": 42161, "optimism": 10, "polygon": 137, "avalanche": 43114, "gnosis": 100}
EXPLORERS = {
    "ethereum": "https://etherscan.io/address/",
    "base": "https://basescan.org/address/",
    "arbitrum": "https://arbiscan.io/address/",
    "optimism": "https://optimistic.etherscan.io/address/",
    "polygon": "https://polygonscan.com/address/",
    "avalanche": "https://snowtrace.io/address/",
    "gnosis": "https://gnosisscan.io/address/",
    "solana": "https://explorer.solana.com/address/",
}
TX_URL = "https://etherscan.io/tx/"
EXPLICIT = r"(?i)(?<![A-Za-z0-9_])address\s+on\s+(?:the\s+)?(.{3,30}?)\s+is\s*$"
ROLES = {
    "sky": [word(r"Sky\s+(?:Frontier|Foundation|Ecosystem|Token|Governance|Star|Council|Aligned|Atlas|Operator)"), "(?i)" + word(r"Aligned\s+Delegate")],
    "spark": [word("Spark(?:Lend|FI)?")],
    "maker": [word("Maker(?:DAO)?")],
    "grove": [word("Grove")],
    "external": ["(?i)" + word(x) for x in ("Chainlink", "Uniswap", "Aave", "Curve", "Morpho", r"Gnosis\s+Safe")],
    "multisig": ["(?i)" + word("multi-?sig")],
    "subproxy": ["(?i)" + word("sub-?proxy")],
    "hot-wallet": ["(?i)" + word("hot[- ]wallet")],
    "proxy": [r"(?i)(?<![A-Za-z0-9_])(?<!sub-?)proxy(?![A-Za-z0-9_])"],
    "registry": ["(?i)" + word("registry")],
    "oracle": ["(?i)" + word("oracle"), "(?i)" + word("price[- ]feed")],
    "treasury": ["(?i)" + word("treasury")],
    "buffer": ["(?i)" + word("buffer")],
    "reserve": ["(?i)" + word("reserves?")],
    "vesting": ["(?i)" + word("vesting")],
    "vault": ["(?i)" + word("vault")],
    "foundation": ["(?i)" + word("foundation")],
    "incentive-pool": ["(?i)" + word(r"incentive\s+pool")],
    "staking-rewards": ["(?i)" + word(r"staking\s+rewards?")],
    "signer": ["(?i)" + word("signer")],
    "delegate": ["(?i)" + word("delegate")],
    "executor": ["(?i)" + word("executor")],
    "controller": ["(?i)" + word("controller")],
}
ALIGNED, OUTSIDE = ("sky", "spark", "grove", "maker"), "external"
TOKENS = ("USDS", "DAI", "SKY", "MKR", "sUSDS", "stUSDS", "USDC", "ETH", "WETH", "SPK", "GROVE")
_NAME = r"([A-Z][A-Za-z0-9 .&'’-]{2,60}?)"
LABELS = [
    START + r"address\s+of\s+(?:the\s+)?" + _NAME + r"\s+(?:is|on|at)" + END,
    START + r"(?:the\s+)?" + _NAME + r"['’]?s?\s+address\s+(?:is|on)" + END,
    START + r"reward\s+address\s+for\s+(?:the\s+)?" + _NAME + r"\s+is" + END,
    START + _NAME + r"\s+at\s+address" + END,
    START + r"(?:Recipient|Multisig|Operator|Owner|Controller|Executor)\s*[:-]\s*([A-Z][A-Za-z0-9 .&'’-]{2,60})",
    r"\*\*" + _NAME + r"\*\*\s*[:-]",
]
PRONOUNS = r"(?i)^(The|This|That|These|Those|It)$"
LABEL_HEADERS = ("name", "label", "entity", "description", "role", "party", "who", "organization", "contract", "subject", "details", "purpose")
GENERIC_LABELS = ("contract", "address", "registry", "multisig", "the contract", "the address", "the multisig", "agreement")
# ---- End of fixed values ------------------------------------------------------------------------------------

TIGHT, WIDE, ANNOTATION, LABEL_WINDOW = 120, 300, 300, 200


def normalise(address: Column) -> Column:
    """Hexadecimal addresses in lower case; base58 is case-sensitive."""
    return F.when(address.startswith("0x"), F.lower(address)).otherwise(address)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _starts(gaps: pd.Series, hits: pd.Series) -> pd.Series:
    """Where hits begin, from the lengths of the gaps before, between and behind them and of the hits: running sums."""
    return pd.Series([np.cumsum(g[:-1]) + np.cumsum(h) - h for g, h in zip(gaps, hits, strict=True)])


def occurrences(texts: DataFrame, key: str, text: str, pattern: str, kind: str) -> DataFrame:
    """``key, kind, found, pos``: every match with its position (from 0, in code points).

    Positions come from the lengths of the pieces between matches, as the pattern splits the text.
    """
    rows = texts.where(F.col(text).rlike(pattern)).select(key, F.split(text, pattern, -1).alias("_gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("_hits"))
    ends = _starts(F.transform("_gaps", F.length), F.transform("_hits", F.length))
    return rows.select(key, F.lit(kind).alias("kind"), F.posexplode(F.arrays_zip(F.col("_hits").alias("found"), ends.alias("pos"))).alias("_n", "_m")).select(key, "kind", F.col("_m.found").alias("found"), F.col("_m.pos").alias("pos"))


def first_by_key(found: DataFrame, key: str) -> DataFrame:
    """The first occurrence of each address in each text; hexadecimal ones count as earlier than base58 ones."""
    rows = found.withColumn("address", normalise(F.col("found")))
    w = W.partitionBy(key, "address").orderBy(F.col("kind") != "evm", "pos")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def before(text: Column, pos: Column, n: int) -> Column:
    """The ``n`` characters before a position."""
    start = F.greatest(pos - n, F.lit(0))
    return F.substring(text, start + 1, pos - start)


def around(text: Column, pos: Column, length: Column, n: int = ANNOTATION) -> Column:
    start = F.greatest(pos - n, F.lit(0))
    return F.substring(text, start + 1, pos + length + n - start)


def chain_of(text: Column, pos: Column) -> Column:
    """Explicit phrase, then a name within 120 characters, then within 300, in the vocabulary's order; else ethereum."""
    tight = before(text, pos, TIGHT)
    choices = []
    for window in (extract_or_null(tight, EXPLICIT), tight, before(text, pos, WIDE)):
        choices += [F.when(any_of(window, ["(?i)" + word(x) for x in names]), chain) for chain, names in CHAINS.items()]
    return F.coalesce(*choices, F.lit("ethereum"))


def explorer_url(chain: Column, address: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in EXPLORERS.items() for x in kv))
    return F.concat(F.element_at(table, chain), address)


ROW, RULE = r"^\|.+\|$", r"^\|[\s\-:|]+\|$"


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.substring(line, F.lit(2), F.length(line) - 2), r"\|", -1), trim_all)


def table_context(text: Column, pos: Column) -> Column:
    """Struct of ``cells, headers, column`` if the position lies in a table's row, else null."""
    lines = F.split(text, "\n", -1)
    number = F.size(F.split(F.substring(text, F.lit(1), pos), "\n", -1))  # 1-based
    line = F.element_at(lines, number)
    is_row = lambda x: x.rlike(ROW)
    is_rule = lambda x: x.rlike(RULE)
    above = F.reverse(F.slice(lines, F.lit(1), F.greatest(number - 1, F.lit(0))))
    # Walk up while rows last; stop at the first rule.
    state = F.struct(F.lit(0).alias("n"), F.lit(False).alias("over"), F.lit(0).alias("at"))
    walked = F.aggregate(
        above,
        state,
        lambda a, x: F.when(a["over"], a).otherwise(F.struct((a["n"] + 1).alias("n"), (~is_row(x) | is_rule(x)).alias("over"), F.when(is_row(x) & is_rule(x), a["n"] + 1).otherwise(F.lit(0)).alias("at"))),
    )
    head = F.when((walked["at"] > 0) & (F.size(above) > walked["at"]), F.element_at(above, F.greatest(F.least(walked["at"] + 1, F.size(above)), F.lit(1))))
    headers = F.when(is_row(head) & ~is_rule(head), _cells(head)).otherwise(F.array().cast("array<string>"))
    cells = _cells(line)
    offset = pos - F.length(F.array_join(F.slice(lines, F.lit(1), number - 1), "\n")) - F.when(number > 1, 1).otherwise(0)
    pipes = F.length(F.regexp_replace(F.substring(line, F.lit(1), offset), r"[^|]", ""))
    column = F.greatest(F.lit(0), F.least(F.size(cells) - 1, pipes - 1))
    return F.when(is_row(line) & ~is_rule(line) & (F.length(line) > 2), F.struct(cells.alias("cells"), headers.alias("headers"), column.alias("column")))


def annotation_text(text: Column, pos: Column, length: Column, table: Column) -> Column:
    heads = F.when(F.size(table["headers"]) > 0, F.array_join(table["headers"], " | "))
    return F.concat_ws("\n", around(text, pos, length), heads, F.array_join(table["cells"], " | "))


def tags_of(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """Every tag of which some pattern fires, in the vocabulary's order."""
    return F.filter(F.array(*(F.when(any_of(text, patterns), tag) for tag, patterns in vocabulary.items())), lambda t: t.isNotNull())


def roles_of(text: Column) -> Column:
    """Tags of the closed vocabulary; the outside tag goes where an aligned one fires."""
    tags = tags_of(text, ROLES)
    return F.when(F.arrays_overlap(tags, F.array(*(F.lit(t) for t in ALIGNED))), F.array_remove(tags, OUTSIDE)).otherwise(tags)


CLEANING = ((r"^\*\*(.*?)\*\*$", "$1"), (r"^__(.*?)__$", "$1"), (r"^\[([^\]]+)\]\([^)]*\)$", "$1"), ("`", ""), (r"\s+", " "))
ADDRESS_CELL, NUMBER_CELL = r"^(0x[0-9a-fA-F]{40}|[1-9A-HJ-NP-Za-km-z]{43,44})$", r"^[0-9.,%$]+$"


def clean_cell(cell: Column) -> Column:
    for pattern, to in CLEANING:
        cell = F.regexp_replace(cell, pattern, to)
    return trim_all(cell)


def looks_like_address(c: Column) -> Column:
    return c.rlike(ADDRESS_CELL)


def looks_like_number(c: Column) -> Column:
    return c.rlike(NUMBER_CELL)


def label_of(text: Column, pos: Column, table: Column) -> Column:
    """A name in the 200 characters before, else a telling cell of the row, else its first telling sibling."""
    window = before(text, pos, LABEL_WINDOW)
    prose = []
    for pattern in LABELS:
        name = F.regexp_replace(trim_all(extract_or_null(window, pattern)), r"\s+", " ")
        prose.append(F.when((F.length(name) >= 3) & ~name.rlike(PRONOUNS), name))
    n = F.size(table["cells"])
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i != table["column"] + 1)
    cell = lambda i: clean_cell(F.element_at(table["cells"], i))
    good = F.filter(at, lambda i: (F.length(cell(i)) >= 3) & ~looks_like_address(cell(i)) & ~looks_like_number(cell(i)))
    header = lambda i: F.lower(F.when(i <= F.size(table["headers"]), F.element_at(table["headers"], F.least(i, F.greatest(F.size(table["headers"]), F.lit(1))))).otherwise(""))
    titled = F.filter(good, lambda i: header(i).rlike("|".join(LABEL_HEADERS)))
    pick = lambda a: F.when(F.size(a) > 0, cell(F.element_at(a, F.lit(1))))
    return F.coalesce(*prose, F.when(table.isNotNull(), F.coalesce(pick(titled), pick(good))))


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(word("|".join(TOKENS))), F.lit(0)))


def best_label(labels: Column) -> Column:
    """The longest label that is not generic (of all if none is); ties go by code point."""
    telling = F.filter(labels, lambda x: ~F.lower(x).isin(*GENERIC_LABELS))
    pool = F.when(F.size(telling) > 0, telling).otherwise(labels)
    return F.array_min(F.transform(pool, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))["x"]


def merge_addresses(found: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each address over all texts: ``address, chain, label, aliases, roles, tokens, explorer_url, refs``.

    The first chain other than ethereum wins. All parts are partial aggregates, so an address that very many
    texts mention is combined before the shuffle; sets are as large as their closed vocabularies, labels apart.
    """
    at = F.struct(F.col(order), F.col("pos"))
    flat = found.select("address", order, "pos", "chain", "label", "roles", "tokens")
    main = flat.groupBy("address").agg(
        F.min(F.when(F.col("chain") != "ethereum", F.struct(at.alias("at"), F.col("chain")))).alias("_c"),
        F.collect_set("label").alias("_labels"),
        F.collect_set("roles").alias("_roles"),
        F.collect_set("tokens").alias("_tokens"),
        F.count("*").alias("refs"),
    )
    label = best_label(F.col("_labels"))
    merged = main.select(
        "address",
        F.coalesce(F.col("_c")["chain"], F.lit("ethereum")).alias("chain"),
        label.alias("label"),
        F.when(label.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.transform(F.array_remove("_labels", label), F.trim)))).alias("aliases"),
        F.array_sort(F.array_distinct(F.flatten("_roles"))).alias("roles"),
        F.array_sort(F.array_distinct(F.flatten("_tokens"))).alias("tokens"),
        "refs",
    )
    return merged.withColumn("explorer_url", explorer_url(F.col("chain"), F.col("address")))


def address_refs(nodes: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """``nodes`` with ``address_refs``: the sorted addresses of each, empty where there is none."""
    refs = found.groupBy(key).agg(F.array_sort(F.collect_set("address")).alias("address_refs"))
    return nodes.drop("address_refs").join(refs, key, "left").withColumn("address_refs", F.coalesce("address_refs", F.array().cast("array<string>")))


def enrich(addresses: DataFrame, registry: DataFrame, verified: DataFrame) -> DataFrame:
    """Adds chain id, registry and verified names, the winning ``label``, ``aliases`` and contract facts.

    registry: ``name, address`` (mainnet only; the last of an address by ``ord`` wins). verified: ``chain_id,
    address, contract_name, is_proxy, implementation``. Solana rows pass through unchanged.
    """
    solana = F.col("chain") == "solana"
    table = F.create_map(*(F.lit(x) for kv in CHAIN_IDS.items() for x in kv))
    names = registry.where(F.col("address").startswith("0x")).groupBy(F.lower("address").alias("address")).agg(F.max_by("name", "ord").alias("_registry"))
    facts = verified.select("chain_id", "address", F.nullif("contract_name", F.lit("")).alias("_verified"), "is_proxy", F.nullif("implementation", F.lit("")).alias("implementation"))
    rows = addresses.withColumn("chain_id", F.when(~solana, F.coalesce(F.element_at(table, F.col("chain")), F.lit(1))))
    rows = rows.join(names, "address", "left").join(facts, ["chain_id", "address"], "left")
    official = F.when(F.col("chain_id") == 1, F.col("_registry"))
    own = F.nullif("label", F.lit(""))
    winner = F.coalesce(official, own, F.when(~solana, F.col("_verified")))
    losers = F.array(official, own, F.col("_verified"))
    aliases = F.when(solana, F.col("aliases")).otherwise(F.array_sort(F.array_distinct(F.filter(F.concat("aliases", losers), lambda x: x.isNotNull() & (x != "") & ~x.eqNullSafe(winner)))))
    return rows.select(
        "address", "chain", "chain_id", "explorer_url", winner.alias("label"), official.alias("registry_name"), F.when(~solana, F.col("_verified")).alias("verified_name"),
        (~solana & F.col("_verified").isNotNull()).alias("is_contract"), F.coalesce(F.when(~solana, F.col("is_proxy")), F.lit(False)).alias("is_proxy"),
        F.when(~solana, F.col("implementation")).alias("implementation"), "roles", aliases.alias("aliases"), "tokens",
    )


def missing_implementations(enriched: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct implementations of proxies that the cache (``chain_id, address``) lacks."""
    wanted = enriched.where(F.col("is_proxy") & F.col("implementation").isNotNull()).select(F.col("implementation").alias("address")).distinct()
    return wanted.join(cache.where("chain_id = 1").select("address"), "address", "left_anti")


def address_profile(enriched: DataFrame) -> DataFrame:
    """``facet, value, n``: counts of labelled, registered, verified, proxy and unverified addresses, and by chain."""
    facets = {"labelled": F.col("label").isNotNull(), "registered": F.col("registry_name").isNotNull(), "verified": F.col("verified_name").isNotNull(), "proxy": F.col("is_proxy"), "unverified": ~F.col("is_contract") & (F.col("chain") != "solana"), "all": F.lit(True)}
    one = enriched.agg(*(F.count_if(c).alias(k) for k, c in facets.items()))
    wide = one.select(F.explode(F.array(*(F.struct(F.lit("total").alias("facet"), F.lit(k).alias("value"), F.col(k).alias("n")) for k in facets))).alias("r")).select("r.*")
    return wide.unionByName(enriched.groupBy("chain").count().select(F.lit("chain").alias("facet"), F.col("chain").alias("value"), F.col("count").alias("n")))


def links(nodes: DataFrame, key: str = "id", text: str = "content", pattern: str = LINK) -> DataFrame:
    """``key, pos, target``: distinct link targets in the order first seen."""
    return nodes.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("pos", "target"))


def resolve_links(found: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Links whose target is a node, with its number and title."""
    to = nodes.select(F.col(key).alias("target"), F.col("doc_no").alias("target_doc_no"), F.col("title").alias("target_title"))
    return found.join(to, "target").select(key, "pos", "target", "target_doc_no", "target_title")


def auto_links(texts: DataFrame, known: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """``key, pos, found, kind, url``: transaction hashes after their label, and addresses outside them.

    known: ``address, explorer_url``; other addresses get the default explorer.
    """
    label = r"(?i)Transaction\s+Hash:\s*0x[0-9a-fA-F]{64}" + END
    tx = occurrences(texts, key, text, label, "tx").select(key, "kind", F.regexp_extract("found", TX_HASH, 1).alias("found"), (F.col("pos") + F.length("found") - 66).alias("pos"))
    # A hash is longer than an address and holds none, as the patterns look at what stands beside a match.
    spans = occurrences(texts, key, text, EVM, "evm").unionByName(occurrences(texts, key, text, BASE58, "base58"))
    addresses = spans.withColumn("address", normalise(F.col("found"))).join(known.select("address", F.col("explorer_url").alias("_u")), "address", "left")
    urls = addresses.select(key, "pos", "found", "kind", F.coalesce("_u", F.concat(F.lit(EXPLORERS["ethereum"]), "found")).alias("url"))
    return tx.select(key, "pos", "found", "kind", F.concat(F.lit(TX_URL), "found").alias("url")).unionByName(urls)


def linked_text(text: Column) -> Column:
    """The text with addresses in hexadecimal turned into Markdown links to the default explorer."""
    return F.regexp_replace(text, f"({EVM})", f"[$1]({EXPLORERS['ethereum']}$1)")


def has_math(text: Column) -> Column:
    return text.rlike(r"\$\$|\$[^$\s]")


# Phrases of controllers.
PARTY = r"[Rr]esponsible [Pp]arty[:\s]+(?:is\s+(?:the\s+)?)?([^.\n\-]+)"
PROCESS = r"[Uu]pdate [Pp]rocess[:\s]+(?:must follow the protocol for\s+)?['`]?([^'`.\n]+)['`]?"
GENERIC_TITLES = ("Distribution Reward Payments", "Integration Boost Payments", "Third Party Partner Payment Addresses And Transaction Records")
AGENT_PREFIXES = {"A.6.1.1.1": "Spark", "A.6.1.1.2": "Grove", "A.6.1.1.3": "Keel", "A.6.1.1.4": "Skybase", "A.6.1.1.5": "Obex", "A.6.1.1.6": "Pattern", "A.6.1.1.7": "Launch Agent 6", "A.6.1.1.8": "Launch Agent 7"}
OPERATOR, OPERATOR_ROLE = "Soter Labs", "Operational GovOps"


def agent_of(doc_no: Column, prefixes: dict[str, str] | None = None) -> Column:
    """The agent of a number below one of the prefixes: a lookup of its first five segments, not a range join."""
    table = F.create_map(*(F.lit(x) for kv in (prefixes or AGENT_PREFIXES).items() for x in kv))
    p = F.split(doc_no, r"\.")
    return F.when(F.size(p) > 5, F.element_at(table, F.array_join(F.slice(p, 1, 5), ".")))


def party_of(content: Column) -> Column:
    return F.coalesce(extract_or_null(content, PARTY), F.lit("Unknown"))


def process_of(content: Column) -> Column:
    raw = F.coalesce(F.trim(F.regexp_replace(extract_or_null(content, PROCESS), "['`.]", "")), F.lit("Direct Edit"))
    return F.when(F.lower(raw).contains("alignment"), "Alignment Conserver Changes").otherwise("Direct Edit")


def resolve_party(rows: DataFrame, facilitators: DataFrame, party: str = "party", agent: str = "agent") -> DataFrame:
    """Adds ``entity_name, entity_role``; facilitators: ``agent, operational_facilitator``."""
    name = F.regexp_replace(F.trim(F.col(party)), r"\.$", "")
    low = F.lower(name)
    out = rows.join(facilitators.select(F.col("agent").alias("_a"), F.col("operational_facilitator").alias("_f")), F.col(agent) == F.col("_a"), "left")
    ops, facilitator = low.contains("operational govops"), low == "operational facilitator"
    return out.select(
        *rows.columns,
        F.when(ops, OPERATOR).when(facilitator, F.coalesce("_f", F.lit("Operational Facilitator"))).otherwise(name).alias("entity_name"),
        F.when(ops, OPERATOR_ROLE).when(facilitator, "Operational Facilitator").otherwise(name).alias("entity_role"),
    )


def title_context(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``context``: for generic titles, the title two segments up without its suffix."""
    p = F.split("doc_no", r"\.")
    up = nodes.groupBy(F.col("doc_no").alias("_up")).agg(F.min_by("title", "ord").alias("_t"))
    keyed = rows.withColumn("_up", F.when(F.col("title").isin(*GENERIC_TITLES) & (F.size(p) > 2), F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 2, F.lit(1))), ".")))
    return keyed.join(up, "_up", "left").withColumn("context", F.regexp_replace("_t", r"(?i)\s+Instance Configuration Document$", "")).drop("_up", "_t")
