"""The pipeline: stages one by one against brute force, the whole, and the registered queries."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from cellstrata.llm import lines, mixing, queries
from cellstrata.runtime import cut
from tests.llm.conftest import DOCS, brute_components, brute_windows

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
WORDS = [f"{a}{b}" for a in "bdfglmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, say(20)) for i in range(5)]
    docs, labels = [], []
    for i in range(400):
        text = "\n".join(say(rng.randint(5, 30)) for _ in range(rng.randint(1, 5)))
        if i % 5 == 0:
            text += " vile grotsky vile"
        elif i % 11 == 0:
            text = docs[i - 2][1]
        elif i % 13 == 0:
            text += f"\n{say(3)} {items[i % 5][1]}"
        elif i % 4 == 0:
            text += "\nCopyright 1999 by the same people as ever"
        docs.append((i, text, ["en", "fr"][i % 2], f"s{i % 3}", len(text)))
        labels.append((i, 1, int("vile" in text)))
    docs.append((1000, None, None, None, None))
    docs.append((1001, "", "en", "s1", 0))
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def _sql(documents, query):
    con = duckdb.connect()
    con.register("documents", documents)
    return con.sql(query).df()


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.toPandas()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, folder))
        after = docs.toPandas()
        texts = dict(zip(before.doc_id, before.text, strict=True))
        if name != "source_mixing":
            assert list(after.columns) == list(before.columns)
        kept = set(after.doc_id)
        if name == "toxicity":
            assert kept == {i for i, t in texts.items() if not t or "vile" not in t}
        elif name == "line_dedup":
            want = _sql(before, f"with recursive {lines.sql()} select doc_id, text, n_dropped from kept")
            want = {r.doc_id: r.text for r in want.itertuples() if r.n_dropped == 0 or r.text.strip()}
            assert {i: t for i, t in zip(after.doc_id, after.text, strict=True) if t is not None} == {i: t for i, t in want.items() if texts[i] is not None}
            assert (after.n_chars.dropna() == after.text.dropna().str.len()).all()
        elif name == "ngram_jaccard_join":
            assert kept == {c for _, c in brute_components(list(texts.items())).values()}
        elif name == "benchmark_decontamination":
            assert kept == {i for i, n, h, _ in brute_windows(list(texts.items()), items) if not (h and 20 * h >= n)}
            assert len(kept) < len(before)
        else:
            want = _sql(before, f"with {mixing.sql()} select doc_id from mixed where sampled")
            assert kept == set(want.doc_id) and 0 < len(kept) < len(before)
        before = after


def test_the_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(corpus_pipeline.run(spark, folder)) == rows(docs)


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, folder, make_docs, tmp_path):
    """Columns of the names that the stages use themselves pass through, and what is added makes room."""
    docs = make_docs(["a b c d e f g", None, "", "a b c d e f g", "vile grotsky vile", "x " * 3000]).withColumn("probability", F.lit("m")).withColumn("topic_", F.lit("n"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "n_words_", "topic__", "probability_"]
    assert {(r.topic, r.n_words, r.row, r.probability, r.topic_) for r in out.collect()} <= {("l", "a", "b", "m", "n")}


def test_registered():
    known = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in known} and "pipeline" in known
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    expected = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DATA).toPandas()[list(expected.columns)]
    rows = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert rows(got) == rows(expected)
