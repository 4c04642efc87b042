"""Jaccard join and suffix dedup against brute force, and the components they build on."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellstrata.llm import _text as X
from cellstrata.llm import jaccard, suffixes
from cellstrata.llm.components import components
from tests.llm.conftest import brute_components, brute_suffixes, sha

WORDS = [f"{a}{b}" for a in "bdfglmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]


def corpus(rng, n=140):
    say = lambda k: [rng.choice(WORDS) for _ in range(k)]
    common, passages = say(9), [say(60) for _ in range(3)]
    texts = [None, "", " \n\t", "a", "a b c d", "a b c d e", "a b c d e", "Été été", "x" * 20000, " ".join(["for"] * 400), " ".join(["for"] * 390)]
    for i in range(n):
        kind = i % 7
        words = say(rng.choice([3, 8, 30, 90, 200]))
        if kind == 1 and i > 7:  # a near copy of an earlier text
            words = (texts[rng.randrange(11, len(texts))] or "").split(" ")
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
        elif kind == 2:
            words = words[: len(words) // 2] + rng.choice(passages) + words[len(words) // 2 :]
        elif kind == 3:
            words = common + words[:4]
        elif kind == 4:  # mostly passages
            words = rng.choice(passages) + rng.choice(passages) + words[:6]
        texts.append(" ".join(words))
    texts += [" ".join([w if rng.random() > 0.02 else rng.choice(WORDS) for w in passages[0] * 2]) for _ in range(40)]
    return texts


@pytest.mark.parametrize("least,most,high", [(8, 1 << 20, 64), (2, 1 << 20, 5), (2, 40, 3), (10**6, 1 << 20, 64)])
def test_jaccard_equals_brute_force(spark, make_docs, monkeypatch, least, most, high):
    monkeypatch.setattr(jaccard, "HIGH", high)
    texts = corpus(random.Random(least))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(make_docs(texts), least_frequent=least, most_frequent=most).collect()}
    assert got == brute_components(list(enumerate(texts)))
    assert len({c for _, c in got.values()}) < len(texts) - 30


def test_jaccard_of_odd_rows(spark, make_docs):
    a, b, c = "a b c d e f g h i j", "p q r s t u v w x y", "one two three four five"
    docs = make_docs([a, a, b, b, a, None, c], ids=[5, 3, 3, 9, None, None, 7])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()), key=str)
    # the rows of document 3 tie both texts
    assert got == sorted([(5, 6, 3), (3, 6, 3), (3, 6, 3), (9, 6, 3), (None, 6, None), (None, 0, None), (7, 1, 7)], key=str)
    assert jaccard.link(docs.limit(0)).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, a), (7, c), (None, a), (None, None)], key=str)


def test_prefixes_keep_every_similar_pair():
    """Sets that link share a signature, whatever is frequent."""
    rng = random.Random(2)
    for _ in range(60):
        n = rng.choice([1, 4, 12, 50, 70, 150, 400])
        base = rng.sample(range(10**6), n + 60)
        one = set(base[:n])
        other = set(list(one)[: n - rng.randint(0, max(0, n // 9))]) | set(base[n : n + rng.randint(0, n // 12 + 1)])
        flat = [X.mix(np.array(sorted(s), dtype=X.U64)) for s in (one, other)]
        flat = [np.sort(f) for f in flat]
        g, first = np.concatenate(flat), np.array([0, len(flat[0]), len(flat[0]) + len(flat[1])])
        every = np.unique(g)
        name = np.unique(X.bucket_of(every, 4).astype(X.U64) << X.U64(32) | every & X.U64(0xFFFFFFFF))
        often = np.sort(np.array(rng.sample(name.tolist(), int(len(name) * rng.choice([0, 0.5, 0.95, 1])))).astype(X.U64))
        known = jaccard.Order(4, np.full(16, 0xFFFFFFFFFFFFFFFF, dtype=X.U64), often, often[:0])
        sig, owner, *_ = jaccard.signatures(g, first, known, 80)
        if 100 * len(one & other) >= 80 * len(one | other):
            assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


@pytest.mark.parametrize("percent", [50, 60, 70, 80, 95, 100])
def test_prefixes_keep_pairs_of_far_sizes(percent):
    """A set and its smallest part that links share a signature when all is frequent."""
    rng = random.Random(percent)
    for n in [1, 2, 4, 16, 50, 64, 70, 88, 128, 150, 256, 400]:
        whole = rng.sample(range(10**6), n)
        flat = [np.sort(X.mix(np.array(sorted(s), dtype=X.U64))) for s in (whole, whole[: jaccard.least_overlap(n, percent)])]
        name = np.unique(X.bucket_of(flat[0], 4).astype(X.U64) << X.U64(32) | flat[0] & X.U64(0xFFFFFFFF))
        known = jaccard.Order(4, np.full(16, 0xFFFFFFFFFFFFFFFF, dtype=X.U64), name, name[:0])
        sig, owner, *_ = jaccard.signatures(np.concatenate(flat), np.array([0, n, n + len(flat[1])]), known, percent)
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_jaccard_of_half(spark, make_docs):
    texts = corpus(random.Random(50), 70)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(make_docs(texts), percent=50, least_frequent=2).collect()}
    assert got == brute_components(list(enumerate(texts)), 50)


def test_boilerplate_does_not_meet(spark, make_docs):
    """Documents that share 24 of 30 shingles, too few to link, and plain copies of the 24, which each may link with."""
    say = lambda i, k: " ".join(f"w{i}x{j}" for j in range(k))
    common = " ".join(f"c{j}" for j in range(28))  # 24 shingles
    texts = [f"{common} {say(i, 6)}" for i in range(60)] + [f"{common} {say(100 + i, 7)}" for i in range(30)] + [common, f"{common} end"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(make_docs(texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))
    live = [("s", i, 30, i, 24, 0) for i in range(60)] + [("s", 100, 24, 100, 24, 0), ("s", 101, 25, 101, 24, 0)]
    cols = ", ".join(["sig string", "c long", "n int", "k long", "low int", "high int"])
    rest = {c: F.lit(0) for c in jaccard._OF if c not in ("c", "n", "low", "high")} | {"often": F.lit(True)}
    met = jaccard._last_pairs(spark.createDataFrame(live, cols).withColumns(rest), 80).select("xc", "yc").collect()
    assert sorted((r.xc, r.yc) for r in met) == sorted([(100, i) for i in range(60)] + [(100, 101)])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- suffixes ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot,often,chunk", [(20_000, 1000, None), (1, 1, None), (2, 3, 50)])
def test_suffix_dedup_equals_brute_force(spark, make_docs, monkeypatch, hot, often, chunk):
    if chunk:
        for name in ("_CHUNK", "_GROUP", "_SNIPPETS"):
            monkeypatch.setattr(suffixes, name, chunk)
    rng = random.Random(4)
    texts = corpus(rng, 70)
    line = "Diese Zeile steht überall, und sie ist länger als fünfzig Bytes lang."
    texts += [f"{rng.choice(WORDS) * 3}\n{line}\n{rng.choice(WORDS) * 9}" for _ in range(25)]
    texts += [line[:45], line, line[3:] + "é" * 40, "é" * 100, "a" * 49, "a" * 50, "a" * 51, "ab" * 300, texts[30], texts[30]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(order[i], t) for i, t in enumerate(texts)]
    docs = make_docs(texts, ids=order)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans) // 2, bytes(r.kept), r.kept_sha256) for r in suffixes.dedup(docs, hot=hot, often=often).collect()}
    expected = {i: (n, gone, spans, kept, sha(kept)) for i, n, gone, spans, kept in brute_suffixes(rows)}
    assert got == expected and sum(v[1] for v in got.values()) > 1000


def test_suffix_dedup_of_odd_rows(spark, make_docs):
    t = "0123456789" * 8
    rows = [(7, t), (None, t), (3, "x" + t), (3, t), (9, None), (9, "")]
    docs = make_docs([t for _, t in rows], ids=[i for i, _ in rows])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans) // 2) for r in suffixes.dedup(docs, with_kept=False).collect()), key=str)
    assert got == sorted([(i, n, gone, spans) for i, n, gone, spans, _ in brute_suffixes(rows)], key=str)
    assert suffixes.dedup(docs.limit(0)).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_suffix_sort():
    rng = random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(60, 400))).encode()
        buf = np.frombuffer(text, np.uint8)
        at = np.array(sorted(rng.sample(range(len(text) - 20), rng.randint(1, len(text) - 20))))
        group = np.sort(np.array([rng.randrange(3) for _ in at]))
        s = suffixes.Suffixes(buf, 20)
        i, j = at[rng.randrange(len(at))], at[rng.randrange(len(at))]
        m = 0
        while m < 20 and text[i + m] == text[j + m]:
            m += 1
        assert s.common(np.array([i]), np.array([j]))[0] == m
        order, string = s.classes(at, group)
        cut = [(group[o], text[at[o] : at[o] + 20]) for o in order]
        assert cut == sorted(cut)
        assert [cut[k] == cut[k - 1] for k in range(1, len(cut))] == [string[k] == string[k - 1] for k in range(1, len(cut))]


def test_a_hash_collision_removes_nothing(monkeypatch):
    """With hashes that all agree, only bytes decide."""
    monkeypatch.setattr(suffixes.Suffixes, "common", lambda self, i, j: np.full(len(i), self.length))
    buf = np.frombuffer(b"aaaaaaaabbbbcccc" + b"aaaaaaaabbbbdddd", np.uint8)
    _, string = suffixes.Suffixes(buf, 16).classes(np.array([0, 16]), np.array([0, 0]))
    assert list(string) == [0, 1]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(6)
    shared = bytes(rng.randrange(97, 110) for _ in range(90))
    texts = [bytes(rng.randrange(97, 110) for _ in range(70)) + shared + b"tail" * 20, shared + b"zz" * 60, b"short"]
    buf, offs = X.flat(pa.array(texts, pa.large_binary()))
    start, count, place, x, doc = suffixes.anchors(buf, offs, 50, 24)
    found = {}
    for s, n, p, h, d in zip(start, count, place, x, doc, strict=True):
        for k in range(n):
            window = bytes(buf[s + k : s + k + 50])
            assert found.setdefault(window, (p - s - k, h)) == (p - s - k, h)
            assert offs[d] <= s and s + k + 50 <= offs[d + 1]
    assert count.sum() == sum(max(0, len(t) - 49) for t in texts)


def test_same_row_struct_survives(spark, make_docs):
    docs = make_docs(["a b c"] * 2)
    assert jaccard.keep_one(docs).select(F.col("row")).first()["row"] == "b"
