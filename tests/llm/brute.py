"""Plain versions of the operators, for small tables."""

import collections
import functools
import itertools
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text) if lower else text)


def shingle_set(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def ngram_components(docs, k=4, num=85, den=100):
    sets = {i: shingle_set(t, k) for i, t in docs}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = {}
    for ids in holders.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if den * n >= num * (len(sets[a]) + len(sets[b]) - n)]
    return {i: (len(sets[i]), c) for i, c in components(list(sets), links).items()}


def dedup_lines(docs, least=5, num=80, den=100):
    seen, holders, out = [], {}, {}
    for doc, text in sorted(docs):
        kept = []
        for line in (text or "").split("\n"):
            s = frozenset(words(line))
            if len(s) < least:
                kept.append(line)
                continue
            shared = {}
            for w in s:
                for n in holders.get(w, ()):
                    shared[n] = shared.get(n, 0) + 1
            if not any(den * k >= num * (len(s) + len(seen[n]) - k) for n, k in shared.items()):
                kept.append(line)
            for w in s:
                holders.setdefault(w, []).append(len(seen))
            seen.append(s)
        out[doc] = None if text is None else "\n".join(kept)
    return out


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def targets(sizes, weights, total, cap):
    """Level that every target is its weight times of, but for those at their cap; found by bisection."""
    total = min(total, cap * sum(sizes))
    low, high = 0.0, 1e15
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights)) < total else (low, mid)
    return [min(cap * s, high * w) for s, w in zip(sizes, weights)]


def most_flow(patterns, quotas):
    """The least cut, over all sets of sources whose quotas are cut."""
    cuts = (set(c) for n in range(len(quotas) + 1) for c in itertools.combinations(range(len(quotas)), n))
    return min(sum(quotas[s] for s in cut) + sum(size for members, size in patterns if not set(members) <= cut) for cut in cuts)


def ppm_bits(text, sample, order, least_seen):
    """Code length by counting and by the definition of escapes with exclusion, byte after byte."""
    data = b"\n" * order + b"".join(b"\n" + t for t in sample)

    def seen(context):
        k = len(context)
        counts = collections.Counter(data[i + k] for i in range(len(data) - k) if data[i : i + k] == context)
        return counts if k < 2 or sum(counts.values()) >= least_seen else {}

    @functools.cache
    def probability(context, byte):
        counts = seen(context)
        below = (lambda b: probability(context[1:], b)) if context else (lambda b: 1 / 256)
        if not counts:
            return below(byte)
        n, d = sum(counts.values()), len(counts)
        if byte in counts:
            return counts[byte] / (n + d)
        return d / (n + d) * below(byte) / sum(below(b) for b in range(256) if b not in counts)

    padded = b"\n" * order + text
    return -sum(math.log2(probability(padded[i : i + order], padded[i + order])) for i in range(len(text)))
