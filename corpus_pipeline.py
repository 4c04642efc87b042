"""The corpus pipeline: toxicity, line dedup, near duplicates, contamination, mixing.

Every stage is a function of (spark, docs, sf_dir) that calls one operator on all its
predecessor kept. ``run`` writes each stage's result as Parquet and reads it again.

Defined results of every stage: a document of null or empty text stays (it scores 0, says no line,
links with nothing, has no words and is sampled at the rate); rows without an id stay or go by their
own text; ties go to the smallest id; rows that repeat are judged alike, and the near-duplicate stage
leaves one of those that share an id; a very long text is taken whole; an empty table gives an empty
one. Other columns pass through unchanged, whatever their names: see ``mix_sources`` for what it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellstrata.llm import decontaminate, jaccard, lines, mixing, toxicity
from cellstrata.runtime import cut, ship

#: Toxicity is a fitted model, which SQL can't express; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a model learned from the labelled ones of this stage's input."""
    labels = _table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return toxicity.score(docs, toxicity.learn(docs, labels)).where(F.col("score") < 0.5).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less recurring lines; a document that lost all it said goes, any other stays."""
    kept = lines.drop_recurring(docs).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x09-\x0D\x20]"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest id."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under a twentieth of whose words lie in benchmark windows."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with calibrated probabilities; beside the documents' columns n_words, topic and probability.

    Where the documents have a column of that name already, the added one gets underscores until it is free.
    """
    taken = {c.lower() for c in docs.columns}
    added = {"n_words": F.col("n_words"), "topic": F.col("topic"), "probability": F.round("probability", 6)}
    own = [x.alias(name + "_" * next(i for i in range(len(taken) + 1) if name + "_" * i not in taken)) for name, x in added.items()]
    return mixing.sample(docs).where("sampled").select("row.*", *own)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
