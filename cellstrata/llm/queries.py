"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellstrata.llm import chat, decontaminate, jaccard, langid, lines, mixing, neighbours, suffixes, tokens, toxicity
from cellstrata.runtime import ship

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _share(column: str, parts: int):
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_OP1 = rf"""
with d as (select doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
bw as (select distinct item, least(len(w), 13) n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') win
  from b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') win from d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i) where len(w) >= n),
m as (select doc_id, i, dw.n, item from dw join bw on dw.win = bw.win and dw.n = bw.n),
h as (select doc_id, count(distinct i + k) n_hit from (select distinct doc_id, i, n from m), unnest(range(0, n)) t(k) group by 1),
it as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from m group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join h using (doc_id) left join it using (doc_id)
"""


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rest = _share("doc_id", 4)
    model = langid.learn(docs, F.col("doc_id").isNotNull() & (rest != 2))
    said = langid.identify(docs, *model, keep=["doc_id"])
    return said.select("row.doc_id", F.coalesce(_share("row.doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"))


SQL_OP4 = rf"""
with recursive w as (select doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+'), []) w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from w, unnest(range(1, greatest(len(w) - 3, 2))) t(i) where len(w) > 0),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
eb as (select a, b from e union all select b, a from e),
r as (select distinct a doc_id, a c from eb union select r.doc_id, b from r join eb on eb.a = r.c),
m as (select doc_id, min(c) c from r group by 1)
select w.doc_id, coalesce(n, 0) n_shingles, coalesce(c, w.doc_id) component_id from w left join n using (doc_id) left join m using (doc_id)
"""


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    said = chat.read_back(chat.format_conversations(chat.linear(rows.unionByName(own))))
    return said.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL_OP5 = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) loss_sha256,
  cast(3 + sum(length(text) + length(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST|/?SYS|/?ASST|/?ROLE)'))
    + case role when 'user' then 15 when 'system' then 13 when 'assistant' then 12 else 16 + length(role) end) as bigint) formatted_chars
from t group by conv_id
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(_table(spark, sf_dir, "documents"), with_kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_share("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.learn(docs, labels), keep=["doc_id"])
    return scored.select(
        "row.doc_id",
        F.coalesce(_share("row.doc_id", 5) == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "offending",
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_recurring(_table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL_OP8 = f"with recursive {lines.sql()} select doc_id, n_lines, n_dropped, sha256(text) kept_sha256 from kept"


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.sample(_table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "n_words", "topic", F.round("probability", 6).alias("probability"), "sampled")


SQL_OP9 = f"with {mixing.sql()} select doc_id, n_words, topic, round(probability, 6) probability, sampled from mixed"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(_table(spark, sf_dir, "documents"), VOCABULARY, keep=["doc_id"])
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": SQL_OP1, "op4_ngram_jaccard_join": SQL_OP4, "op5_chat_formatting": SQL_OP5, "op8_line_dedup": SQL_OP8, "op9_source_mixing": SQL_OP9}
