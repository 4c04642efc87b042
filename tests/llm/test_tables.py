"""Neighbours, chat formatting, line dedup and mixing on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellstrata.llm import chat, lines, mixing, neighbours
from tests.llm.conftest import VECTORS, cells_of, sha

# --- neighbours --------------------------------------------------------------------------------------------------


def brute_nearest(rows, queries, k=10):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in queries:
        own = [v for i, v in fine if i == q]
        if own:
            v = min(own)
            d = sorted((float(np.sqrt(((np.float32(w).astype(float) - np.float32(v).astype(float)) ** 2).sum())), i) for i, w in fine if i != q and len(w) == len(v))
            out[q] = d[:k]
    return out


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 60)]
    rows += [(100, rows[0][1]), (200, rows[0][1]), (201, rows[0][1]), (202, rows[0][1])]  # ties
    rows += [(300, None), (301, []), (302, [0.0] * 8), (400, [float("nan")] * 8), (401, [None] * 8), (402, [float("inf")] + [1.0] * 7), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (None, [1.0] * 8), (203, [1.0] * 8), (203, [1.0] * 8)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit("clash")).withColumn("score", F.lit(1))
    found = neighbours.nearest(df, F.col("vec_id") % 100 == 0, target=0.999999, group=2).collect()
    expected = brute_nearest([(i, v) for i, v in rows], [100, 200, 300, 400, 500])
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == {100, 200, 500}
    assert [r.rank for r in found if r.query_id == 100] and max(r.rank for r in found) == 10
    for q, want in expected.items():
        assert [i for _, i in got[q]] == [i for _, i in want]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want], rtol=1e-12)


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + rng.normal(size=32) * (0.05 if i % 3 == 0 else 0.8)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0, sample=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expected = brute_nearest(rows, list(range(0, 3000, 100)))
    recall = [len(got[q] & {i for _, i in w}) / len(w) for q, w in expected.items()]
    assert len(recall) == 30 and sum(recall) / len(recall) >= 0.9


def test_neighbours_with_too_many_probes_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, most_probes=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q, want in brute_nearest(rows, [0, 100, 200, 300]).items():
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def found_by(spark, rows, **options):
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    return {q: [i for _, i in sorted(v)] for q, v in got.items()}


def near_by(rows, queries):
    return {q: [i for _, i in w] for q, w in brute_nearest(rows, queries).items()}


def test_neighbours_of_a_length_that_the_sample_lacks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8 if i > 30 else 3) * 10).tolist()) for i in range(300)]
    assert found_by(spark, rows, sample=1)[0] == near_by(rows, [0])[0]


def test_neighbours_beyond_a_few_copies(spark):
    rng = np.random.default_rng(7)
    rows = {i: (rng.normal(size=8) * 10).tolist() for i in range(1000)}
    first = [r.id for r in spark.range(1000).where("id % 100 <> 0").orderBy(F.xxhash64("id"), "id").limit(3).collect()]
    rows |= {i: rows[0] for i in first}  # all of the sample that is near
    rows = list(rows.items())
    assert found_by(spark, rows, sample=100, target=0.999999)[0] == near_by(rows, [0])[0]


def test_neighbours_are_as_many_as_there_are(spark):
    rng = np.random.default_rng(8)
    few = [(i, (rng.normal(size=8) * 10).tolist()) for i in range(8)]
    assert found_by(spark, few, target=0.1) == near_by(few, [0])
    many = [(i, (rng.normal(size=8) * 10).tolist()) for i in range(400)]
    got = found_by(spark, many, target=0.001, tables=1)
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q in (0, 100, 200, 300)}


def test_neighbours_among_copies(spark):
    """A third of the rows are one vector, a third of the queries too, and one row repeats."""
    rng = np.random.default_rng(9)
    same = rng.normal(size=8).tolist()
    rows = [(i, same if i % 300 < 100 else rng.normal(size=8).tolist()) for i in range(1500)]
    rows += [(7, same)] * 15 + [(300, same)] * 30
    got = found_by(spark, rows, group=50)
    want = near_by(rows, sorted(got))
    assert set(got) == set(range(0, 1500, 100))
    for q in (0, 300, 600, 900, 1200):
        assert got[q] == want[q]  # ids rise, and repeats are listed as often as they occur


def test_neighbours_come_from_buckets(spark):
    """Of clustered vectors a small part is compared, nearly all neighbours are found, and a large group is split."""
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(40, 32)) * 3
    rows = [(i, (centres[i % 40 if i % 3 else 0] + rng.normal(size=32) * 0.3).tolist()) for i in range(6000)]
    found = neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, group=200).collect()
    got, compared = defaultdict(set), {}
    for r in found:
        got[r.query_id].add(r.vec_id)
        compared[r.query_id] = r.compared
    want = near_by(rows, sorted(got))
    assert len(got) == 60 and sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
    alone = [n for q, n in compared.items() if q % 3]
    assert sum(alone) / len(alone) < 0.35 * len(rows)  # of eight tables together


def test_visits_are_the_likeliest_buckets():
    rng = np.random.default_rng(3)
    for r in (0.2, 0.6, 1.5):
        offset = rng.uniform(size=3)
        got = neighbours.visits(offset, r, 0.8, 10_000)
        reach = max(1, math.ceil(3.5 * r))
        chance = lambda move: math.prod((math.erf((m + 1 - o) / r / math.sqrt(2)) - math.erf((m - o) / r / math.sqrt(2))) / 2 for m, o in zip(move, offset, strict=True))  # noqa: B023, E731
        every = sorted((chance(m) for m in np.ndindex(*[2 * reach + 1] * 3) for m in [np.array(m) - reach]), reverse=True)
        assert np.allclose([chance(m) for m in got], every[: len(got)])
        assert sum(every[: len(got)]) >= 0.8 > sum(every[: len(got) - 1])


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert neighbours.nearest(none, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0])], VECTORS)
    assert neighbours.nearest(one, F.col("vec_id") % 100 == 0).count() == 0


# --- chat --------------------------------------------------------------------------------------------------------

NASTY = ["", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\INST]", "[ROLE x]", "a\n[ASST] b </s>", "é<s>", "\\", "<", "[/INST", "<</s>"]


def test_escaping_is_reversible():
    rng = random.Random(1)
    parts = ["<", "[", "\\", "/", "s>", "INST", "]", "SYS", "ASST", "ROLE", " ", "x", "[/INST]", "</s>"]
    for text in NASTY + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]:
        assert chat.unescape(chat.escape(text)) == text
        for role in ("user", "assistant", "system", "tool", "", "a]b%5D", "</s>"):
            turns = [(role, text), ("user", text), ("assistant", text)]
            formatted, mask = chat.render(turns)
            assert chat.parse(formatted) == turns
            lost = "".join(chat.unescape(formatted[s:e]) for s, e in zip(mask[::2], mask[1::2], strict=True))
            assert lost == "".join(t for r, t in turns if r == "assistant")


def test_linear_conversations(spark):
    turns = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 5, "assistant", "x"), (2, 3, "system", None), (2, None, None, "n"), (None, 0, "user", "lone"), (3, 0, "user", "t"), (3, 0, "user", "t"), (3, 0, "tool", "t")]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"{i}" * 50) for i in range(300)]
    df = spark.createDataFrame(rows, turns).withColumn("node", F.lit("clash")).withColumn("leaf", F.lit(0))
    made = chat.format_conversations(chat.linear(df))
    said = {r.tree: r for r in chat.read_back(made).collect()}
    assert [(t.role, t.text) for t in said[2].turns] == [("", "n"), ("system", ""), ("assistant", "x")]
    assert [(t.role, t.text) for t in said[3].turns] == [("tool", "t"), ("user", "t"), ("user", "t")]
    assert len(said[4].turns) == 300 and [t.text for t in said[4].turns] == [f"{i}" * 50 for i in range(300)]
    assert said[4].loss_text == "".join(f"{i}" * 50 for i in range(1, 300, 2)) and said[None].loss_text == ""
    assert {r.tree: len(r.formatted) for r in made.collect()} == {k: r.formatted_chars for k, r in said.items()}
    assert chat.format_conversations(chat.linear(df.limit(0))).count() == 0


def test_reply_trees(spark):
    nodes = "tree long, node long, parent long, role string, text string, score double"
    rows = [
        (1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "good", 0.9), (1, 3, 1, "assistant", "bad", 0.1), (1, 4, 2, "user", "more", 0.5), (1, 5, 3, "user", "huh", 0.2),
        (2, 1, 99, "user", "orphan", 0.0), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0), (3, 3, 2, "assistant", "hangs on a loop", 1.0), (4, 1, None, "user", "x", None), (4, None, 1, "user", "no id", 1.0),
    ]
    df = spark.createDataFrame(rows, nodes)
    made = chat.read_back(chat.format_conversations(df)).collect()
    got = {(r.tree, r["rank"]): [t.text for t in r.turns] for r in made}
    assert got == {(1, 1): ["q", "good", "more"], (1, 2): ["q", "bad", "huh"], (2, 1): ["orphan"], (4, 1): ["x"]}
    best = chat.read_back(chat.format_conversations(df, branches=1)).collect()
    assert {(r.tree, len(r.turns)) for r in best} == {(1, 3), (2, 1), (4, 1)}


# --- lines -------------------------------------------------------------------------------------------------------


def test_templates(spark, make_docs):
    note = "Copyright 20{0} by the authors of this work"
    texts = [note.format(i) + f"\nown words of document number {w} here" for i, w in enumerate("abcdef")]
    texts += ["same old line here\nA one\n\nlast", "x\nsame old line here", " same\told  line here \nshort", None, "", "\n\n", "same old line here"]
    kept = {r.doc_id: r for r in lines.drop_recurring(make_docs(texts)).select("row.doc_id", "text", "n_lines", "n_dropped").collect()}
    assert kept[0].text == texts[0]  # the first document keeps what recurs
    # one template: the differing word is a variable field too
    assert all(r.text == "" for i, r in kept.items() if 0 < i < 6)
    assert kept[6].text == texts[6] and kept[7].text == "x" and kept[8].text == "short" and kept[12].text == ""
    assert (kept[9].text, kept[9].n_lines) == (None, 0) and kept[10].text == "" and kept[11].text == "\n\n"
    assert [kept[i].n_dropped for i in (0, 1, 6, 7, 9)] == [0, 2, 0, 1, 0]


def test_lines_equal_the_sql(spark, make_docs):
    rng = random.Random(6)
    vocab = "the of and red green blue 17 23 x9 alpha beta gamma delta".split()
    stock = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9))) for _ in range(25)]

    def line():
        words = rng.choice(stock).split()
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = rng.choice(vocab)
        return rng.choice([" ", "  ", "\t"]).join(words) + rng.choice(["", " "])

    texts = ["\n".join(line() for _ in range(rng.randint(0, 12))) for _ in range(80)]
    docs = make_docs(texts)
    got = cells_of(lines.drop_recurring(docs).select("row.doc_id", "n_lines", "n_dropped", "text"), "doc_id", "n_lines", "n_dropped", "text")
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    expected = con.sql(f"with recursive {lines.sql()} select doc_id, n_lines, n_dropped, text from kept").fetchall()
    assert got == sorted(expected) and sum(r[2] for r in got) > 20


def brute_templates(rows, min_docs, similar=0.8, depth=3):
    """[(doc_id, kept text)] with seeding repeated on the rest of each leaf; rows have ids and single blanks."""
    mask = lambda x: " ".join("<*>" if re.search("[0-9]", w) else w for w in x.split())
    held, leaves, gone = defaultdict(set), defaultdict(list), {}
    for i, t in rows:
        for x in t.split("\n"):
            if len(x.split()) >= 4:
                held[mask(x)].add(i)
    for m in held:
        leaves[len(m.split()), *m.split()[:depth]].append(m)
    for rest in leaves.values():
        rest.sort(key=lambda m: (-len(held[m]), m))
        while rest:
            own = [m for m in rest if sum(a == b for a, b in zip(m.split(), rest[0].split(), strict=True)) >= similar * len(m.split())]
            docs = set().union(*(held[m] for m in own))
            gone |= {m: min(docs) for m in own if len(docs) >= min_docs}
            rest = [m for m in rest if m not in own]
    return [(i, "\n".join(x for x in t.split("\n") if gone.get(mask(x), i) == i)) for i, t in rows]


@pytest.mark.parametrize("batch", [1, 500])
def test_every_template_of_a_leaf_is_found(spark, make_docs, batch):
    rng = random.Random(8)
    ends = [[rng.choice("abcdefgh") * 3 for _ in range(5)] for _ in range(12)]

    def line():
        words = list(rng.choice(ends))
        if rng.random() < 0.6:
            words[rng.randrange(5)] = f"{rng.choice('pqrstuvwxyz')}{rng.choice('pqrstuvwxyz')}"
        return " ".join(["the", "same", rng.choice(["lead", "start"]), *words])

    texts = ["\n".join(line() for _ in range(rng.randint(0, 3))) for _ in range(60)]
    got = cells_of(lines.drop_recurring(make_docs(texts), batch=batch).select("row.doc_id", "text"), "doc_id", "text")
    assert got == brute_templates(list(enumerate(texts)), lines.MIN_DOCS)
    documents = make_docs(texts).select("doc_id", "text").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert got == sorted(con.sql(f"with recursive {lines.sql()} select doc_id, text from kept").fetchall())


def test_the_line_stage_drops_a_leafs_second_template(spark, make_docs):
    first, second = "we all say one two three four five {0}", "we all say six seven eight nine ten {0}"
    texts = [first.format(w) for w in "abcde"] + [second.format(w) for w in "abcd"] + ["we all say that this stands here alone"]
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, make_docs(texts, clash=False), "").collect()}
    assert kept == {i: texts[i] for i in (0, 5, 9)}


def test_lines_of_rows_without_or_with_equal_ids(spark, make_docs):
    row = "this line is in all of them"
    docs = make_docs([row] * 5, ids=[7, None, 3, 3, None])
    kept = Counter((r.doc_id, r.text) for r in lines.drop_recurring(docs, min_docs=2).select("row.doc_id", "text").collect())
    assert kept == {(3, row): 2, (7, ""): 1, (None, ""): 2}
    assert lines.drop_recurring(docs.limit(0)).count() == 0


def test_lines_of_many_rows_without_an_id(spark, make_docs):
    """Each loses what recurs in its own text; what they lose is held by text, never in one list for all."""
    own = "this line is in all of them"
    texts = [f"{own}\nand words of number {c} alone here {c}{c}" for c in "abcdefghij"]
    docs = make_docs(texts, ids=[1, 2, 3, *[None] * 7])
    kept = Counter((r.doc_id, r.text) for r in lines.drop_recurring(docs, similar=1).select("row.doc_id", "text").collect())
    assert kept == Counter([(1, texts[0]), *[(i, texts[k].split("\n")[1]) for k, i in enumerate([2, 3, *[None] * 7], 1)]])


def test_lines_whatever_the_screen(spark, make_docs, monkeypatch):
    texts = [f"one two three {a} {b}\nx{a} says that {b} and more so" for a in "abcd" for b in "efgh"] + ["z" * 50_000 + " a b c\n" + "p q r s\n" * 3000, None]
    expected = cells_of(lines.drop_recurring(make_docs(texts)).select("row.doc_id", "text"), "doc_id", "text")
    monkeypatch.setattr(lines._screened, "__defaults__", (64,))
    assert cells_of(lines.drop_recurring(make_docs(texts)).select("row.doc_id", "text"), "doc_id", "text") == expected


# --- mixing ------------------------------------------------------------------------------------------------------


def test_mixing_equals_the_sql(spark, make_docs):
    rng = random.Random(9)
    texts = [None, "", "a | b", "### x", *[" ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([3, 150, 1200]))) for _ in range(300)]]
    docs = make_docs(texts)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("l"), F.col("doc_id") % 3)))
    got = mixing.sample(docs).select("row.doc_id", "n_words", "topic", F.round("probability", 6).alias("probability"), "sampled")
    documents = docs.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    expected = con.sql(f"with {mixing.sql()} select doc_id, n_words, topic, round(probability, 6) probability, sampled from mixed").fetchall()
    cols = ("doc_id", "n_words", "topic", "probability", "sampled")
    assert cells_of(got, *cols) == sorted(expected)
    many = mixing.rake(spark.createDataFrame([("a", "x", "t", 90), ("b", "x", "t", 10)], "source string, lang string, topic string, words long"), one_task=1)
    few = mixing.rake(spark.createDataFrame([("a", "x", "t", 90), ("b", "x", "t", 10)], "source string, lang string, topic string, words long"))
    near = lambda df: {r.source: round(r.weight, 6) for r in df.collect()}
    assert near(many) == near(few)


def test_raking_meets_the_marginals(spark):
    rng = random.Random(1)
    rows = [(f"s{i}", f"l{j}", f"t{k}", rng.randint(200, 1000)) for i in range(5) for j in range(3) for k in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, words long")
    raked = mixing.rake(cells, rate=0.3, temper=0.5, rounds=20).toPandas()
    total = 0.3 * sum(r[3] for r in rows)
    for d in ("source", "lang", "topic"):
        held = raked.groupby(d).words.sum() ** 0.5
        target = held / held.sum() * total
        assert np.allclose(raked.groupby(d).weight.sum(), target, rtol=1e-3)
    assert (raked.weight <= raked.words).all()


def test_raking_meets_given_targets(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", f"l{j}" if j else "", f"t{k}", rng.randint(200, 1000)) for i in range(5) for j in range(3) for k in range(3)]
    cells = spark.createDataFrame([*rows, ("s9", "l1", "t1", 0)], "source string, lang string, topic string, words long")
    targets = {"source": {"s0": 2, "s1": 1, "s2": 1, "s9": 5, "absent": 7}, "lang": {None: 0.5, "l1": 0.3, "l2": 0.2}}
    total = 0.2 * sum(r[3] for r in rows)
    for one_task in (1, 100_000):
        raked = mixing.rake(cells, rate=0.2, rounds=12, targets=targets, one_task=one_task).toPandas()
        share = lambda d: (raked.groupby(d).weight.sum() / total).round(3).to_dict()  # noqa: B023, E731
        assert share("source") == {"s0": 0.5, "s1": 0.25, "s2": 0.25, "s3": 0, "s4": 0, "s9": 0}
        assert share("lang") == {"": 0.5, "l1": 0.3, "l2": 0.2}
        held = raked.groupby("topic").words.sum() ** mixing.TEMPER
        assert np.allclose(raked.groupby("topic").weight.sum(), held / held.sum() * total, rtol=1e-3)
        assert (raked.weight <= raked.words).all()
    for wrong in ({"colour": {"red": 1}}, {"lang": {"l1": -1}}, {"lang": {"l1": 0}}, {"lang": {}}, {"lang": {"absent": 1}}):
        with pytest.raises(ValueError):
            mixing.rake(cells, targets=wrong)


def test_raking_goes_on_to_a_tolerance(spark):
    """Targets far from the table's own mix, met to a tolerance; what can't be met is told."""
    rng = random.Random(5)
    rows = [(f"s{i}", f"l{j}", f"t{k}", rng.choice([20, 900, 5000])) for i in range(4) for j in range(3) for k in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, words long")
    targets = {"source": {"s0": 5, "s1": 3, "s2": 1, "s3": 1}, "lang": {"l0": 1, "l1": 6, "l2": 3}, "topic": {"t0": 1, "t1": 1, "t2": 1}}
    told = mixing.marginals(cells, rate=0.05, targets=targets, rounds=2, tolerance=1e-3).collect()
    assert len(told) == 10 and all(abs(r.reached / r.target - 1) <= 1e-3 for r in told)
    assert {(r.dimension, r.category): round(r.target / (0.05 * sum(x[3] for x in rows)), 3) for r in told if r.dimension == "source"} == {("source", f"s{i}"): v for i, v in enumerate([0.5, 0.3, 0.1, 0.1])}
    short = {r.category: r for r in mixing.marginals(cells, rate=0.9, targets={"lang": {"l0": 1}}, tolerance=1e-3, most_rounds=16).collect() if r.dimension == "lang"}
    assert short["l0"].reached <= short["l0"].words < short["l0"].target and short["l1"].reached == 0


def test_topics_of_a_column(spark, make_docs):
    docs = make_docs(["one two three four five"] * 3000).withColumn("subject", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.concat(F.lit("x"), F.col("doc_id") % 2)))
    mixed = mixing.sample(docs, rate=0.3, topics=F.col("subject"), targets={"topic": {"x0": 1, "x1": 1}})
    got = {r["topic"]: r["count"] for r in mixed.where("sampled").groupBy("topic").count().collect()}
    assert set(got) == {"x0", "x1"} and all(abs(n - 450) < 90 for n in got.values())
    assert {r["topic"] for r in mixed.select("topic").distinct().collect()} == {"", "x0", "x1"}


def test_samples_have_the_mix_asked_for(spark, make_docs):
    docs = make_docs(["one two three four five"] * 6000).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, "fr").otherwise("en"))
    got = mixing.sample(docs, rate=0.4, targets={"lang": {"en": 1, "fr": 1}}).where("sampled").groupBy("row.lang").count().collect()
    assert all(abs(r["count"] - 1200) < 120 for r in got) and len(got) == 2


def test_mixing_of_odd_tables(spark, make_docs):
    assert mixing.sample(make_docs(["a"]).limit(0)).count() == 0
    empty = mixing.sample(make_docs([None, "", " "])).collect()
    assert {(r.n_words, r.probability) for r in empty} == {(0, mixing.RATE)}
    twice = mixing.sample(make_docs(["a b c"] * 6, ids=[1, 1, 2, 2, None, None])).select("row.doc_id", "sampled").collect()
    assert len({(r.doc_id, r.sampled) for r in twice}) == 3 and len(twice) == 6


@pytest.mark.parametrize("n", [0, 1, 7])
def test_uniform_numbers(spark, n):
    u = spark.range(2000).select(mixing.uniform(F.col("id") * 8 + n).alias("u")).toPandas().u
    assert u.between(0, 1, inclusive="left").all() and abs(u.mean() - 0.5) < 0.03


def test_sha():
    assert sha("") == sha(b"")
