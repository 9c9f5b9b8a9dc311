"""Addresses in text, in one pass over each text: matches, windows, tables, chains, roles, labels and tokens.

Each text is scanned once for addresses; what is read for one of them is cut out around it. The words of all chains
and roles are one automaton, which names the few patterns that can fire in a window. The results are those of the
column expressions in ``extraction``, which say what each part is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.text import END, START, word
from coppice.operators import extraction as X

#: Line ends as the patterns of the column expressions take them, and where ``$`` holds.
_ENDS = "\n\r\u0085\u2028\u2029"
_DOT, _LAST = f"[^{_ENDS}]", f"(?=(?:\r\n|[{_ENDS}])?\\Z)"


def _compiled(pattern: str) -> regex.Pattern:
    """A pattern with the meaning that it has in a column expression: ASCII classes and cases, all line ends."""
    flags = regex.ASCII
    if pattern.startswith("(?i)"):
        pattern, flags = pattern[4:], flags | regex.IGNORECASE
    pattern = re.sub(r"(?<!\\)\.(?=[*+{])", lambda _: _DOT, pattern)
    return regex.compile(pattern[:-1] + _LAST if pattern.endswith("$") and not pattern.endswith(r"\$") else pattern, flags)


def _start_of(pattern: str) -> str:
    """The letters that a match of a word pattern begins with, in lower case."""
    body = re.sub(r"\(\?<!.*?\)", "", pattern.replace("(?i)", "").replace(START, "").replace(END, "")).removeprefix("(?:")
    m = re.match(r"[A-Za-z]+", body)
    return (m[0][:-1] if body[m.end() : m.end() + 1] == "?" else m[0]).lower()


class Vocabulary:
    """Patterns by name; ``fire`` gives the names of which one matches, in the order of the names."""

    def __init__(self, names: dict[str, list[str]]) -> None:
        self.patterns = [(at, _compiled(p)) for at, patterns in enumerate(names.values()) for p in patterns]
        self.names = list(names)
        by: dict[str, list[int]] = {}
        for i, p in enumerate(p for patterns in names.values() for p in patterns):
            by.setdefault(_start_of(p), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for start, which in by.items():
            self.automaton.add_word(start, which)
        self.automaton.make_automaton()

    def fire(self, window: str) -> list[str]:
        found: set[int] = set()
        tried: set[int] = set()
        for _, which in self.automaton.iter(window.lower()):
            for i in which:
                if i not in tried:
                    tried.add(i)
                    at, pattern = self.patterns[i]
                    if at not in found and pattern.search(window):
                        found.add(at)
        return [self.names[at] for at in sorted(found)]


class _Reader:
    """The compiled patterns; made once in each Python worker."""

    def __init__(self) -> None:
        self.kinds = (("evm", _compiled(X.EVM)), ("base58", _compiled(X.BASE58)))
        self.explicit = _compiled(X.EXPLICIT)
        self.chains = Vocabulary({c: ["(?i)" + word(x) for x in names] for c, names in X.CHAINS.items()})
        self.roles = Vocabulary(X.ROLES)
        self.labels = [_compiled(p) for p in X.LABELS]
        self.pronouns, self.tokens = _compiled(X.PRONOUNS), _compiled(word("|".join(X.TOKENS)))
        self.row, self.rule = _compiled(X.ROW), _compiled(X.RULE)
        self.cleaning = [(_compiled(p), to.replace("$1", r"\1")) for p, to in X.CLEANING]
        self.address, self.number = _compiled(X.ADDRESS_CELL), _compiled(X.NUMBER_CELL)
        self.spaces, self.headers = regex.compile(r"\s+", regex.ASCII), regex.compile("|".join(X.LABEL_HEADERS))

    def addresses(self, text: str) -> list[tuple[str, str, int, int]]:
        """Kind, address, first position and length of each different one; hexadecimal ones come first."""
        found: dict[str, tuple[str, str, int, int]] = {}
        for kind, pattern in self.kinds:
            for m in pattern.finditer(text):
                address = m[0].lower() if m[0].startswith("0x") else m[0]
                found.setdefault(address, (kind, address, m.start(), len(m[0])))
        return list(found.values())

    def _trim(self, text: str) -> str:
        return text.strip(" \t\n\r\x0b\x0c")

    def chain(self, text: str, pos: int) -> str:
        tight = text[max(0, pos - X.TIGHT) : pos]
        said = self.explicit.search(tight)
        for window in (said[1] if said else "", tight, text[max(0, pos - X.WIDE) : pos]):
            fired = self.chains.fire(window)
            if fired:
                return fired[0]
        return "ethereum"

    def _cells(self, line: str) -> list[str]:
        return [self._trim(c) for c in line[1:-1].split("|")]

    def _is_row(self, line: str, rule: bool = False) -> bool:
        return bool(self.row.search(line)) and bool(self.rule.search(line)) == rule

    def table(self, text: str, pos: int, known: dict[int, list[str]]) -> tuple[list[str], list[str], int] | None:
        """Cells, headers and column of a table's row; ``known`` keeps the headers by the beginning of a row."""
        at = text.rfind("\n", 0, pos) + 1
        end = text.find("\n", pos)
        line = text[at : end if end >= 0 else len(text)]
        if len(line) <= 2 or not self._is_row(line):
            return None
        # Up over rows to the first rule, or to a row whose headers are known.
        passed, begin, headers = [], at, []
        while True:
            if begin in known:
                headers = known[begin]
                break
            passed.append(begin)
            if not begin:
                break
            above = text.rfind("\n", 0, begin - 1) + 1
            before = text[above : begin - 1]
            if self._is_row(before, rule=True):
                if above:
                    top = text[text.rfind("\n", 0, above - 1) + 1 : above - 1]
                    headers = self._cells(top) if self._is_row(top) else []
                break
            if not self._is_row(before):
                break
            begin = above
        known.update(dict.fromkeys(passed, headers))
        cells = self._cells(line)
        return cells, headers, max(0, min(len(cells) - 1, line[: pos - at].count("|") - 1))

    def _clean(self, cell: str) -> str:
        for pattern, to in self.cleaning:
            cell = pattern.sub(to, cell)
        return self._trim(cell)

    def label(self, text: str, pos: int, table: tuple[list[str], list[str], int] | None) -> str | None:
        window = text[max(0, pos - X.LABEL_WINDOW) : pos]
        for pattern in self.labels:
            m = pattern.search(window)
            name = self.spaces.sub(" ", self._trim(m[1])) if m else ""
            if len(name) >= 3 and not self.pronouns.search(name):
                return name
        if table is None:
            return None
        cells, headers, column = table
        good = [(i, c) for i, c in ((i, self._clean(c)) for i, c in enumerate(cells) if i != column) if len(c) >= 3 and not self.address.search(c) and not self.number.search(c)]
        titled = [c for i, c in good if i < len(headers) and self.headers.search(headers[i].lower())]
        return (titled or [c for _, c in good] or [None])[0]

    def read(self, text: str) -> list[tuple]:
        """Address, position, chain, roles, label and tokens of each address of a text."""
        out, known = [], {}
        for kind, address, pos, size in self.addresses(text):
            table = self.table(text, pos, known)
            note = [text[max(0, pos - X.ANNOTATION) : pos + size + X.ANNOTATION]]
            if table:
                note += [" | ".join(table[1])] * bool(table[1]) + [" | ".join(table[0])]
            note = "\n".join(note)
            roles = self.roles.fire(note)
            if any(r in X.ALIGNED for r in roles):
                roles = [r for r in roles if r != X.OUTSIDE]
            chain = "solana" if kind == "base58" else self.chain(text, pos)
            out.append((address, pos, chain, roles, self.label(text, pos, table), list(dict.fromkeys(self.tokens.findall(note)))))
        return out


def extract_addresses(nodes: DataFrame, key: str = "id", text: str = "content", order: str = "ord") -> DataFrame:
    """``key, order, address, pos, chain, roles, label, tokens, explorer_url``: one row for each address of each text."""
    rows = nodes.where(F.col(text).rlike(f"{X.EVM}|{X.BASE58}")).select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(text).alias("_text"))
    kind = lambda c: rows.schema[c].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()))
        for b in batches:
            read = [(i, r) for i, t in enumerate(b.column(2).to_pylist()) for r in reader.read(t)]
            of = pa.array([i for i, _ in read], type=pa.int64())
            columns = [pa.array([r[c] for _, r in read], type=t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *columns], names=["_key", "_order", "address", "pos", "chain", "roles", "label", "tokens"])

    found = rows.mapInArrow(work, f"_key {kind('_key')}, _order {kind('_order')}, address string, pos int, chain string, roles array<string>, label string, tokens array<string>")
    return found.select(F.col("_key").alias(key), F.col("_order").alias(order), "address", "pos", "chain", "roles", "label", "tokens", X.explorer_url(F.col("chain"), F.col("address")).alias("explorer_url"))
