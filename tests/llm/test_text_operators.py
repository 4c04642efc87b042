"""Decontamination, token counts, language ID and toxicity on small tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellstrata.llm import decontaminate, langid, tokens, toxicity
from tests.llm.conftest import brute_windows

ITEMS = "item_id long, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()
ODD = [None, "", "   \n", "!!!", "é", "x" * 30000, "Alpha-BETA gamma" * 3, "\x00a\x00b"]


def _text(rng, n):
    return rng.choice([" ", "  ", ", "]).join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("bits,threshold", [(1 << 28, "10485760"), (64, "-1")])
def test_contamination(spark, make_docs, bits, threshold):
    """Neither the size of the screens nor the kind of the joins changes the result."""
    rng = random.Random(3)
    items = [(1, _text(rng, 30)), (2, _text(rng, 13)), (3, "Rare Pair"), (4, None), (5, "..."), (6, "é"), (7, _text(rng, 5)), (2, _text(rng, 14)), (None, _text(rng, 16)), (8, "tau tau tau " * 9), (9, "tau")]
    texts = [*ODD, *[_text(rng, n) for n in (1, 2, 12, 13, 14, 400)]]
    texts += [f"{_text(rng, 8)} {(items[0][1]).upper()} {_text(rng, 5)}", f"rare pair {items[1][1]} rare, pair", f"{items[8][1]}", " ".join(items[0][1].replace(",", "").split()[3:17]), "tau " * 40, f"x {items[0][1]} {items[0][1]}"]
    docs = make_docs(texts + texts[-2:])  # rows that repeat but for the id
    bench = spark.createDataFrame(items, ITEMS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = decontaminate.contamination(docs, bench, most_bits=bits)
        rows = found.select("row.doc_id", "n_words", "n_hit", "items", "n_items", "spans").collect()
        kept = {r.doc_id for r in decontaminate.clean(docs, bench, most_bits=bits).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = sorted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in rows)
    assert got == brute_windows([(r.doc_id, r.text) for r in docs.collect()], items)
    assert all(r.n_hit == sum(e - s for s, e in zip(r.spans[::2], r.spans[1::2], strict=True)) and r.n_items == len(r["items"]) and r.spans == sorted(set(r.spans)) for r in rows)
    assert kept == {i for i, n, h, _ in got if not (h and 20 * h >= n)}
    assert decontaminate.clean(docs, bench).columns == docs.columns


def test_contamination_of_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], ITEMS)
    docs = make_docs(["a b c", None])
    assert [(r.n_words, r.n_hit, r.items) for r in decontaminate.contamination(docs, none).collect()] == [(3, 0, []), (0, 0, [])]
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0


def test_token_counts_equal_the_library(spark, make_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(5)
    parts = list("aabcdest'  \n\t.,!?123éßñ中文字 🙂\x85\x1c²Ⅷ") + ["'s", "'re", "'ll", " 's", "''", "<|endoftext|>", "\r\n", "aaaa"]
    texts = [*ODD, "it's 'something' ''s", "x   ", "   x", "a" * 5000, "<|endoftext|><|endoftext|>"]
    texts += ["a<|endof", "text|>b", "<|endof<|endoftext|>text|>", "<|endof", "<|endoftext|>", "text|>", "<|endoftext|>" * 60_000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    counted = tokens.count_tokens(make_docs(texts), "byte_bpe_50k.json").select("row.doc_id", "n_bytes", "n_tokens").collect()
    expected = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [r.n_tokens for r in sorted(counted, key=lambda r: r.doc_id)] == expected
    assert {r.n_bytes for r in counted if r.doc_id in (0, 1)} == {0}
    assert tokens.count_tokens(make_docs(["a"]).limit(0), "byte_bpe_50k.json").count() == 0
    with pytest.raises(ValueError):
        tokens.Counter(str(public_tokenizers.path("word_bpe_49k.json")))


LEXICON = {"en": "the and of ing tion that with have this from", "fr": "le la une être avec pour dans qui eau ment", "de": "der die und nicht schön über keit ung ein ist"}


def _spoken(rng, lang, n):
    return " ".join(rng.choice(LEXICON[lang].split()) + rng.choice(LEXICON[lang].split()) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(2)
    rows = [(i, _spoken(rng, lang, rng.randint(3, 40)), lang) for i, lang in enumerate(["en", "fr", "de"] * 60)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 ...", "fr"), (1003, "Ж" * 10, None), (None, rows[0][1], "en"), (1004, rows[1][1] * 200, "xx")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.learn(docs, F.col("doc_id") < 90)
    assert model[0] == ["de", "en", "fr"]
    said = {r.doc_id: r for r in langid.identify(docs, *model, keep=["doc_id"]).select("row.doc_id", "lang_pred", "score").collect()}
    held = [said[i].lang_pred == lang for i, _, lang in rows[90:]]
    assert sum(held) / len(held) > 0.97
    assert [said[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and said[1000].score == 0
    assert said[1003].lang_pred in model[0] and said[1004].lang_pred == "fr" and said[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in said.values())
    nothing = langid.learn(docs, F.lit(False))
    assert {r.lang_pred for r in langid.identify(docs, *nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), *model).count() == 0


def test_a_bundle_is_the_sum_of_its_grams():
    space = langid.Space(64, 1)
    codes, triples, has = space.counted(pa.array(["Abc abc", "!!", None]), np.arange(3), 3)
    vec = space.bundled(codes, triples, 3)
    letters = {c: space.vectors(np.array([ord(c)]))[0].astype(int) for c in "abc"} | {" ": space.vectors(np.array([0]))[0].astype(int)}
    total = 0
    text = " abc abc "
    for i in range(len(text) - 2):
        total = total + np.roll(letters[text[i]], 2) * np.roll(letters[text[i + 1]], 1) * letters[text[i + 2]]
    assert (vec[0] == total).all() and list(has) == [True, False, False] and not vec[2].any()


@pytest.mark.parametrize("grams,rows", [(8192, 1024), (7, 2), (40, 5)])
def test_bundles_in_slices(monkeypatch, grams, rows):
    """Sparse and dense slices give the same sums."""
    rng = random.Random(grams)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) for _ in range(23)] + ["a" * 900, ""]
    space = langid.Space(32, 1)
    codes, (row, gram, many), _ = space.counted(pa.array(texts), np.arange(25), 25)
    counts = np.zeros((25, len(codes)))
    counts[row, gram] = many
    monkeypatch.setattr(langid, "_GRAMS", grams)
    monkeypatch.setattr(langid, "_ROWS", rows)
    assert (space.bundled(codes, (row, gram, many), 25) == counts @ space.grams(codes)).all()


def test_many_short_texts_of_many_letters_fit_in_memory():
    """10,000 texts of 30 ideographs have about as many n-grams as places."""
    import tracemalloc

    rng = random.Random(1)
    texts = pa.array(["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(30)) for _ in range(10_000)])
    space = langid.Space(64, 1)
    tracemalloc.start()
    codes, triples, has = space.counted(texts, np.arange(10_000), 10_000)
    vec = space.bundled(codes, triples, 10_000)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert has.all() and (vec != 0).any(axis=1).all() and len(codes) > 250_000


def test_language_is_chosen_by_cosine(spark):
    """The registered choice, spelled out text by text."""
    rng = random.Random(4)
    rows = [(i, _spoken(rng, lang, rng.randint(1, 9)), lang) for i, lang in enumerate(["en", "fr", "de"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    space = langid.Space(langid.DIMENSIONS, langid.SEED)
    letter = lambda c: space.vectors(np.array([c]))[0].astype(int)

    def vector(text):
        out, run = np.zeros(langid.DIMENSIONS), re.sub("[^a-zà-ÿ]+", " ", f" {text.lower()} ")
        code = [0 if c == " " else ord(c) for c in run]
        for x, y, z in zip(code, code[1:], code[2:], strict=False):
            out += np.roll(letter(x), 2) * np.roll(letter(y), 1) * letter(z)
        return out

    langs, protos = langid.learn(docs, F.col("doc_id") % 2 == 0)
    for name, got in zip(langs, protos, strict=True):
        own = sum(vector(t) for i, t, lang in rows if lang == name and i % 2 == 0)
        assert np.allclose(got, own / np.linalg.norm(own), atol=1e-9)
    said = {r.doc_id: r for r in langid.identify(docs, langs, protos, keep=["doc_id"]).select("row.doc_id", "lang_pred", "score").collect()}
    for i, t, _ in rows:
        v = vector(t)
        cos = protos @ v / np.linalg.norm(v)
        assert said[i].lang_pred == langs[int(np.argmax(cos))] and abs(said[i].score - cos.max()) < 1e-5


def _toxic_tables(spark, n=600):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        said = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 12))]
        if bad:
            at = rng.randrange(len(said))
            said[at] += " " + rng.choice(["vile", "vilest", "grotsky"]) + rng.choice(["", " xi"])
        docs.append((i, ". ".join(said) + ".", "en"))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = _toxic_tables(spark)
    model = toxicity.learn(docs, labels.where("doc_id < 400"))
    odd = spark.createDataFrame([(900, None, "en"), (901, "", "en"), (902, "?!.", "en"), (None, "vile", "en"), (903, "alpha beta. " * 3000 + "You VILE thing. gamma", "en")], docs.schema)
    scored = {r.doc_id: r for r in toxicity.score(docs.unionByName(odd).withColumn("score", F.lit(1)), model).select("row.doc_id", "row.text", F.col("score").alias("p"), "offending", "sentence_scores").collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(scored[i].p >= 0.5) == bool(truth[i]) for i in range(400, 600)]
    assert sum(held) / len(held) > 0.97
    assert [scored[i].p for i in (900, 901, 902)] == [0, 0, 0]
    assert scored[None].p >= 0.5 and scored[903].p >= 0.5
    s, e = scored[903].offending
    assert scored[903].text.encode()[s:e] == b"You VILE thing"
    for i in range(400, 600):
        for s, e in zip(scored[i].offending[::2], scored[i].offending[1::2], strict=True):
            assert any(w in scored[i].text.encode()[s:e] for w in (b"vil", b"grot"))


def test_labels_without_documents_are_no_sample(spark):
    docs, labels = _toxic_tables(spark, 60)
    stray = spark.range(1000, 20_000).selectExpr("id doc_id", "1 quality", "cast(id % 2 as int) toxic")
    plain, more = (toxicity.learn(docs, x, per_class=40) for x in (labels, labels.unionByName(stray)))
    assert len(plain.words) and (plain.words == more.words).all() and (plain.weights == more.weights).all() and plain.bias == more.bias
    few = toxicity.learn(docs, labels, per_class=40, class_bytes=1500)
    assert len(few.words) < len(plain.words)
    assert toxicity.learn(docs, labels, class_bytes=1) is not None  # one document of each class


def test_scores_equal_a_plain_noisy_or(spark):
    """The model's scores, spelled out sentence by sentence, and the fit against plain gradient steps."""
    docs, labels = _toxic_tables(spark, 90)
    model = toxicity.learn(docs, labels)
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))

    def features(sentence):
        out = set()
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", sentence.lower().encode()):
            for part in {w, *(w[:k] for k in toxicity.STEMS if len(w) > k)}:
                buf = np.frombuffer(part, np.uint8)
                out.add(int(toxicity.X.hash_spans(buf, np.array([0]), np.array([len(buf)]))[0]))
        return out

    bags = {r.doc_id: [f for x in re.split(r"[\n.!?]", r.text) if (f := features(x))] for r in docs.collect()}
    for r in toxicity.score(docs, model, keep=["doc_id"]).select("row.doc_id", "score").collect():
        clean = 1.0
        for f in bags[r.doc_id]:
            clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(weight.get(x, 0.0) for x in f))))
        assert abs(r.score - (1 - clean)) < 1e-9
    # the loss of the fitted weights is no more than what plain descent from them reaches
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    prior = sum(truth.values()) / len(truth)

    def loss(bias, w):
        out = 0.0
        for i, y in truth.items():
            keep = -sum(np.logaddexp(0, bias + sum(w.get(x, 0.0) for x in f)) for f in bags[i])
            p = min(max(-np.expm1(keep), 1e-9), 1)
            out += -np.log(p) * prior / sum(truth.values()) if y else -keep * (1 - prior) / (len(truth) - sum(truth.values()))
        return out

    best = loss(model.bias, weight)
    for step in (0.3, -0.3):
        assert best <= loss(model.bias + step, weight) + 1e-3
        for x in list(weight)[:6]:
            assert best <= loss(model.bias, {**weight, x: weight[x] + step}) + 1e-3


def test_toxicity_without_labels(spark):
    docs, labels = _toxic_tables(spark, 9)
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, few)).collect()} == {0.0}
    model = toxicity.learn(docs, labels)
    assert toxicity.score(docs.limit(0), model).count() == 0
