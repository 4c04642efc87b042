import hashlib
import re
from collections import Counter, defaultdict

import pytest

VECTORS = "vec_id long, embedding array<float>"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that results use too; an operator must not stumble over them.
CLASHING = {"n_words": "a", "row": "b", "score": "c", "spans": "d", "kid": "e", "key": "f", "h": "g", "n": "h", "c": "i", "bucket": "j", "words": "k", "topic": "l"}


@pytest.fixture(scope="session")
def make_docs(spark):
    from pyspark.sql import functions as F

    def make(texts, clash=True, ids=None, lang="en"):
        rows = [(i if ids is None else ids[i], t, lang, f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()}) if clash else df

    return make


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


def brute_components(rows, percent=80):
    """rows: (doc_id, text) -> {doc_id: (shingles, component)}"""
    sets, by = {}, defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
        for s in sets[i]:
            by[s].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        common = Counter(j for x in s for j in by[x] if j < i)
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def brute_windows(docs, items, size=13):
    """{doc_id: (words, hit words, item ids)}"""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def brute_suffixes(rows, length=50):
    """[(doc_id, bytes, removed, spans, kept)] in the order of the rows"""
    first, enc = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in enc:
        for k in range(len(b) - length + 1 if i is not None else 0):
            g = b[k : k + length]
            first[g] = min(first.get(g, i), i)
    out = []
    for i, b in enc:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1 if i is not None else 0):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def cells_of(df, *cols):
    return sorted((tuple(r[c] if not isinstance(r[c], bytearray) else bytes(r[c]) for c in cols) for r in df.select(*cols).collect()), key=lambda r: tuple((x is not None, x) for x in r))
