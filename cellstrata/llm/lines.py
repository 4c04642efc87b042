"""Line dedup with a log-template tree, in DataFrame operations only.

A line's tokens are its runs of other characters than blanks, and a token with a digit is a
variable field, ``<*>``. The tree has a fixed depth: token count, then the first ``depth``
tokens. In a leaf the masked line of most documents (ties: the smallest) is the seed; every
line that agrees with it in ``similar`` of its tokens joins its template, whose other fields
are variable too. Seeding is repeated on the lines that did not fit, until none is left that could
recur. A template found in ``min_docs`` documents or more recurs: its lines are dropped from all
documents but the one of smallest id, so what is said once stays once. ``sql`` says the same.

A round of reseeding takes the next ``batch`` lines of each leaf in the seeds' order: of these, each
that agrees with no earlier seed is one, and a line joins the first seed that it agrees with. That is
what seeding one by one comes to, in fewer rounds; every round leaves a leaf at least ``batch`` lines
fewer, or none.

Only hashes of lines are shuffled until the leaves that can recur are known (two 64-bit
hashes each), and counts are combined before each shuffle. A line that a third of the documents
have is one group of a partial aggregation, and a splittable side of a join. Lines themselves are
shuffled for leaves of several lines; others stay at the scan by a bitmap of the leaves, a broadcast
table of 16 bits a leaf, at most ``BITS``: past that it lets more through, which costs but changes nothing.

Defined results: blank lines and lines of fewer than ``min_tokens`` tokens are always kept; a
null text stays null with 0 lines; rows without an id are no documents to count, but lose
recurring lines; rows that share an id are one document; within the kept document every
occurrence stays; a very long text is one row, split where it lies. A document may end up empty:
``drop_recurring`` leaves that to its caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellstrata.runtime import cut, drop

MIN_DOCS, MIN_TOKENS, DEPTH, SIMILAR = 2, 4, 3, 0.8
BITS, BATCH = 1 << 25, 500


def masked(text: Column) -> Column:
    """A text's lines with single blanks between tokens and variable fields as ``<*>``.

    Each step is a pass of its own over the array, and its costly part is for the lines that need it:
    inside one lambda nothing is shared between its branches.
    """
    lines = F.split(text, "\n")
    even = lambda x: F.trim(F.regexp_replace(x, r"[\x09-\x0D\x20]+", " "))
    odd = lambda x: F.contains(x, F.lit("  ")) | F.startswith(x, F.lit(" ")) | F.endswith(x, F.lit(" "))
    plain = F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.transform(lines, even)).otherwise(F.transform(lines, lambda x: F.when(odd(x), even(x)).otherwise(x)))
    return F.transform(plain, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(x))


def _tokens(ms: Column) -> Column:
    return F.length(ms) - F.length(F.replace(ms, F.lit(" "), F.lit(""))) + 1


def _key(ms: Column) -> Column:
    return F.struct(F.xxhash64(ms).alias("a"), F.xxhash64(F.lit(1), ms).alias("b"))


def _screened(lines: DataFrame, leaves: DataFrame, most: int = BITS) -> DataFrame:
    """The lines whose leaf may be among ``leaves``: the broadcast table has at most ``most`` / 64 rows of 16 bytes."""
    bits = min(most, max(1 << 12, 1 << (16 * max(leaves.count(), 1) - 1).bit_length()))
    at = lambda h: F.pmod(h, F.lit(bits))
    word = lambda h: F.shiftright(at(h), 6)
    bit = lambda h: F.pmod(h, F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("leaf")))
    words = cut(leaves.select(word(F.col("leaf")).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")), "screen")
    met = lines.withColumn("w", word(F.col("leaf"))).join(F.broadcast(words), "w")
    return met.where(F.getbit("b", bit(F.col("leaf"))) == 1).drop("w", "b")


def _same(a: Column, b: Column) -> Column:
    """Number of tokens in which two masked lines agree."""
    return F.size(F.filter(F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: x == y), lambda x: x))


def _reseeded(rest: DataFrame, min_docs: int, similar: float, batch: int) -> DataFrame:
    """(key, group) of the masked lines that no seed has taken yet (leaf, key, n, ms, docs); those that can't recur are left out."""
    order = Window.partitionBy("leaf").orderBy(F.desc("docs"), "ms")
    out = rest.select("key", F.col("key").alias("group")).limit(0)
    while True:
        # Summed over lines, so never fewer than the documents that the rest of a leaf spans.
        spans = rest.groupBy("leaf").agg(F.sum("docs").alias("most")).where(F.col("most") >= min_docs)
        rest = cut(rest.join(spans.select("leaf"), "leaf"), "rest")
        if rest.isEmpty():
            return out
        top = rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= batch)
        top = top.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("rank", "n", "ms", "key"))).alias("top"))
        near = lambda x: lambda s: _same(s.ms, x.ms) >= F.lit(similar) * x.n
        seeds = F.aggregate("top", F.slice("top", 1, 0), lambda held, x: F.when(F.exists(held, near(x)), held).otherwise(F.concat(held, F.array(x))))
        own = F.struct("ms", "n")
        taken = rest.join(cut(top.select("leaf", seeds.alias("seeds")), "seeds"), "leaf").select(*rest.columns, F.get(F.filter("seeds", near(own)), 0).key.alias("group"))
        taken = cut(taken, "taken")
        out = out.unionByName(taken.where(F.col("group").isNotNull()).select("key", "group"))
        rest = taken.where(F.col("group").isNull()).drop("group")


def _who(text: Column) -> Column:
    """What tells rows without an id apart: their text. Null where there is an id."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(text))


def templates(
    docs: DataFrame, *, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, similar: float = SIMILAR, batch: int = BATCH, text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, who, key) of each document's distinct lines; (key, n_docs, first_doc) of the lines whose template recurs."""
    # Masked inside the array, so that no later filter or hash has it computed again.
    lines = docs.select("doc_id", _who(F.col(text)).alias("who"), F.explode(masked(F.col(text))).alias("ms"))
    lines = lines.withColumn("n", F.when(F.col("ms") != "", _tokens(F.col("ms"))).otherwise(0)).where(F.col("n") >= min_tokens)
    lines = lines.withColumn("leaf", F.xxhash64("n", F.substring_index("ms", " ", depth)))
    held = lines.select(_key(F.col("ms")).alias("key"), "n", "leaf", "doc_id", "who").distinct()
    held = cut(held, "lines")
    counts = cut(held.groupBy("key", "n", "leaf").agg(F.count("doc_id").alias("docs")), "counts")
    leaves = counts.groupBy("leaf").agg(F.sum("docs").alias("most"), F.count("*").alias("kinds")).where(F.col("most") >= min_docs)
    leaves = cut(leaves.select("leaf", "kinds"), "leaves")
    able = counts.join(leaves, "leaf")
    # Only leaves of several masked lines need the lines themselves.
    near = able.where("kinds > 1").select("key", "n", "leaf", "docs")
    said = _screened(lines, leaves.where("kinds > 1")).select(_key(F.col("ms")).alias("key"), "ms").distinct()
    said = cut(said.join(near, "key"), "templates")
    seeds = cut(said.groupBy("leaf").agg(F.min(F.struct((-F.col("docs")).alias("d"), "ms", "key")).alias("seed")), "seeds")
    joins = _same(F.col("ms"), F.col("seed.ms")) >= F.lit(similar) * F.col("n")
    pairs = cut(said.join(seeds, "leaf").select("leaf", "key", "n", "ms", "docs", F.when(joins, F.col("seed.key")).alias("group")), "seeded")
    drop(said, seeds)
    group = pairs.where(F.col("group").isNotNull()).select("key", "group")
    group = group.unionByName(_reseeded(pairs.where(F.col("group").isNull()).drop("group"), min_docs, similar, batch))
    group = cut(group.unionByName(able.where("kinds = 1").select("key", F.col("key").alias("group"))), "groups")
    drop(pairs, counts, leaves)
    # Distinct documents of each template: first within (template, document), then of the template.
    spread = held.select("key", "doc_id").join(group, "key").select("group", "doc_id").distinct()
    recurs = spread.groupBy("group").agg(F.count("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc")).where(F.col("n_docs") >= min_docs)
    recurring = cut(group.join(cut(recurs, "recurs"), "group").select("key", "n_docs", "first_doc"), "recurring")
    drop(group)
    return held, recurring


def drop_recurring(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` as a struct ``row``, the text less its recurring lines, n_lines and n_dropped."""
    held, recurring = templates(docs, text=text, **options)
    gone = held.select("key", "doc_id", "who").join(recurring.select("key", "first_doc"), "key").where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first_doc")))
    gone = cut(gone.groupBy("doc_id", "who").agg(F.collect_list("key").alias("gone")).withColumnsRenamed({"doc_id": "gone_id", "who": "gone_who"}), "gone")
    drop(held, recurring)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"), _who(F.col(text)).alias("_who"))
    whole = F.split(F.col(f"row.`{text}`"), "\n")
    both = F.filter(F.zip_with(whole, masked(F.col(f"row.`{text}`")), lambda x, m: F.struct(x.alias("x"), _key(m).alias("k"))), lambda s: ~F.array_contains(F.col("gone"), s.k))
    kept = F.when(F.col("gone").isNull(), whole).otherwise(F.transform(both, lambda s: s.x))
    both = rows.join(gone, F.col("_id").eqNullSafe(F.col("gone_id")) & F.col("_who").eqNullSafe(F.col("gone_who")), "left").select("row", kept.alias("kept"), F.coalesce(F.size(whole), F.lit(0)).alias("lines"))
    return both.select(
        "row",
        F.when(F.col(f"row.`{text}`").isNotNull(), F.array_join("kept", "\n")).alias("text"),
        F.when(F.col(f"row.`{text}`").isNull(), 0).otherwise(F.col("lines")).cast("long").alias("n_lines"),
        F.when(F.col(f"row.`{text}`").isNull(), 0).otherwise(F.col("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def sql(min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, similar: float = SIMILAR, source: str = "documents") -> str:
    """Common table expressions, for ``with recursive``, that say the same: ``kept`` has doc_id, text, n_lines and n_dropped."""
    return rf"""
ln as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) pos, unnest(string_split(text, chr(10))) line from {source}),
lm as (select *, regexp_replace(trim(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') ms from ln),
lk as (select *, case when ms = '' then 0 else len(string_split(ms, ' ')) end n, array_to_string(string_split(ms, ' ')[1:{depth}], ' ') lead from lm),
ld as (select distinct ms, n, lead, doc_id from lk where n >= {min_tokens}),
lt as (select ms, n, lead, count(doc_id) docs from ld group by all),
ls as (select n, lead from lt group by all having sum(docs) >= {min_docs}),
lg as (select n, lead, ms, docs, cast(null as varchar) grp from lt semi join ls using (n, lead)
  union all select n, lead, ms, docs, case when list_sum(list_transform(list_zip(string_split(ms, ' '), string_split(seed, ' ')), lambda p: case when p[1] = p[2] then 1 else 0 end)) >= {similar} * n then seed end
  from (select *, first_value(ms) over (partition by n, lead order by docs desc, ms) seed from lg where grp is null)),
lr as (select grp, count(distinct doc_id) docs, min(doc_id) first_doc from ld join lg using (ms) where grp is not null group by 1 having count(distinct doc_id) >= {min_docs}),
lx as (select lg.ms, first_doc from lg join lr using (grp) where grp is not null),
kept as (select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (lx.ms is null or doc_id = first_doc or n < {min_tokens}), '') as text,
  count(*) n_lines, count(*) filter (lx.ms is not null and doc_id <> first_doc and n >= {min_tokens}) n_dropped from lk left join lx using (ms) group by 1)"""
