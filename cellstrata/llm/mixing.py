"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of (source, language, topic) with their word counts as weights. The
cells' weights are raked in turn to the target marginals of source, language and topic, and cut
back to what a cell holds, for a fixed number of rounds; with ``tolerance``, on until every marginal is
that close to its target (as a share of it), or ``most_rounds`` are done. ``marginals`` tells what is
reached, which shares that ask for more than a category holds never meet. A marginal's targets are its categories'
words to the power ``temper`` (below 1: small ones gain), or the shares that ``targets`` gives for
a marginal, as {"lang": {"en": 3, "fr": 1}}; either scaled to ``rate`` of all words. A document is sampled with its cell's probability, weight over words, by a hash of its id.

A document's topic is what ``topics`` says, a column over the documents; without it, its form: tabular,
noisy (runs of symbols), long, short or prose.

The cells are summed before any shuffle. Up to ``one_task`` of them are raked in one task, more
in as many as their categories need.

Defined results: a null source or language is the empty one; null and word-less texts have 0
words, and a cell without words keeps its documents with probability ``rate``; rows that share
an id are sampled alike; a very long text is one row; a null topic is the empty one; a null id is an id of its own; an empty table gives an empty one. Shares
are relative, over the categories that the cells have; one that is not named gets 0, and None is
the empty one. A category can't give more than the words it holds: shares that ask for more are
met at a lower ``rate`` only, and scarce ones may need more ``rounds``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellstrata.runtime import cut

RATE, TEMPER, ROUNDS, LONG, SHORT = 0.5, 0.7, 8, 1000, 100
MOST_ROUNDS = 200
_WORD = r"[^\x09-\x0D\x20]+"
_SALT = "mix"
_DIMS = ("source", "lang", "topic")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def topic(text: Column, n: Column) -> Column:
    return (
        F.when(F.contains(text, F.lit(" | ")), "tabular")
        .when(text.rlike(r"[#$%&*]{3}"), "noisy")
        .when(n >= LONG, "long")
        .when(n < SHORT, "short")
        .otherwise("prose")
    )


def _placed(docs: DataFrame, text: str, topics: Column | None) -> DataFrame:
    own = F.lit(None).cast("string") if topics is None else F.coalesce(topics.cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("told"))
    t = F.col(f"row.`{text}`")
    out = rows.select("row", "told", words(t).alias("n_words"))
    named = lambda c: F.coalesce(F.col(f"row.{c}").cast("string"), F.lit("")).alias(c)
    return out.select("row", "n_words", named("source"), named("lang"), F.coalesce("told", topic(t, F.col("n_words"))).alias("topic"))


def _shares(targets: dict | None) -> dict[str, dict[str, float]]:
    """``targets`` with None as the empty category."""
    out = {}
    for d, shares in (targets or {}).items():
        if d not in _DIMS:
            raise ValueError(f"targets are for {', '.join(_DIMS)}, not {d}")
        out[d] = own = {}
        for k, v in shares.items():
            if not (math.isfinite(v) and v >= 0):
                raise ValueError(f"share of {d} {k!r}: {v}")
            own["" if k is None else str(k)] = own.get("" if k is None else str(k), 0.0) + float(v)
        if not sum(own.values()) > 0:
            raise ValueError(f"no share of {d} is over 0")
    return out


def _residual(df: DataFrame) -> float:
    """The largest distance of a marginal from its target, as a share of the target."""
    by = [df.groupBy(d).agg(F.max(f"t_{d}").alias("t"), F.sum("weight").alias("w")).where("t > 0").agg(F.max(F.abs(F.col("w") / F.col("t") - 1)).alias("x")) for d in _DIMS]
    return max((r.x or 0.0) for r in reduce(DataFrame.unionByName, by).collect())


def _raked(cells: DataFrame, rate: float, temper: float, rounds: int, targets: dict | None, tolerance: float | None, most_rounds: int, one_task: int) -> DataFrame:
    shares = _shares(targets)
    few = cells.count() <= one_task
    df = cells.coalesce(1) if few else cells
    # Sums are rounded, as their order is not fixed.
    for d in _DIMS:
        own = F.sum("words").over(Window.partitionBy(d))
        once = F.row_number().over(Window.partitionBy(d).orderBy(*_DIMS)) == 1
        wanted = F.pow(own.cast("double"), F.lit(temper))
        if d in shares:  # nothing can be taken of a category without words
            named = F.create_map(*[F.lit(x) for kv in shares[d].items() for x in kv])
            wanted = F.when(own > 0, F.coalesce(F.try_element_at(named, F.col(d)), F.lit(0.0))).otherwise(F.lit(0.0))
        df = df.withColumn(f"t_{d}", wanted).withColumn(f"f_{d}", once)
    totals = df.agg(F.sum("words").alias("words"), *[F.sum(F.when(F.col(f"f_{d}"), F.col(f"t_{d}"))).alias(f"s_{d}") for d in _DIMS]).first()
    if not totals.words:
        return cells.withColumns({c: F.lit(0.0) for c in ("weight", *(f"t_{d}" for d in _DIMS))})
    for d in shares:
        if not totals[f"s_{d}"]:
            raise ValueError(f"no words in any {d} that has a share")
    for d in _DIMS:
        df = df.withColumn(f"t_{d}", F.col(f"t_{d}") * F.lit(rate * totals.words / totals[f"s_{d}"]))
    df = df.drop(*[f"f_{d}" for d in _DIMS]).withColumn("weight", F.col("words") * F.lit(float(rate)))
    done = 0
    while True:
        for i in range(rounds):
            for d in _DIMS:
                total = F.sum("weight").over(Window.partitionBy(d))
                df = df.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"t_{d}") / total).otherwise(F.lit(0.0)))
            df = df.withColumn("weight", F.least("weight", F.col("words").cast("double")))
            if not few or i == rounds // 2:
                df = cut(df, "raked")
                df = df.coalesce(1) if few else df
        done += rounds
        if tolerance is None or done >= most_rounds:
            return df
        df = cut(df, "raked")
        if _residual(df) <= tolerance:
            return df
        df = df.coalesce(1) if few else df


def rake(
    cells: DataFrame,
    *,
    rate: float = RATE,
    temper: float = TEMPER,
    rounds: int = ROUNDS,
    targets: dict[str, dict[str, float]] | None = None,
    tolerance: float | None = None,
    most_rounds: int = MOST_ROUNDS,
    one_task: int = 100_000,
) -> DataFrame:
    """Cells (source, lang, topic, words) with ``weight``, raked to the tempered marginals or to ``targets``."""
    return _raked(cells, rate, temper, rounds, targets, tolerance, most_rounds, one_task).select(*_DIMS, "words", "weight")


def marginals(cells: DataFrame, *, rate: float = RATE, temper: float = TEMPER, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None, tolerance: float | None = None, most_rounds: int = MOST_ROUNDS, one_task: int = 100_000) -> DataFrame:
    """(dimension, category, words, target, reached) of every marginal after raking."""
    df = cut(_raked(cells, rate, temper, rounds, targets, tolerance, most_rounds, one_task), "raked")
    each = [df.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("category")).agg(F.sum("words").alias("words"), F.max(f"t_{d}").alias("target"), F.sum("weight").alias("reached")) for d in _DIMS]
    return reduce(DataFrame.unionByName, each)


def cells_of(docs: DataFrame, *, text: str = "text", topics: Column | None = None) -> DataFrame:
    """Cells (source, lang, topic, words) of the documents."""
    return _placed(docs, text, topics).groupBy(*_DIMS).agg(F.sum("n_words").alias("words"))


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) made of the id: 52 bits of its MD5."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(_SALT)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sample(docs: DataFrame, *, text: str = "text", rate: float = RATE, topics: Column | None = None, **options) -> DataFrame:
    """``docs`` as a struct ``row`` with n_words, topic, probability and whether it is ``sampled``."""
    cells = cut(cells_of(docs, text=text, topics=topics), "cells")
    raked = cut(rake(cells, rate=rate, **options), "raked")
    chance = F.round(F.when(F.col("words") > 0, F.col("weight") / F.col("words")).otherwise(F.lit(float(rate))), 9)
    joined = _placed(docs, text, topics).join(raked.select(*_DIMS, chance.alias("probability")), list(_DIMS))
    return joined.select("row", "n_words", "topic", "probability", (uniform(F.col("row.doc_id")) < F.col("probability")).alias("sampled"))


def sql(source: str = "documents", rate: float = RATE, temper: float = TEMPER, rounds: int = ROUNDS) -> str:
    """Common table expressions that say the same: ``mixed`` has the documents' columns, n_words, topic, probability, sampled."""
    out = [
        rf"""mw as (select *, cast(coalesce(len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')), 0) as bigint) n_words, coalesce(source, '') ms, coalesce(lang, '') ml from {source}),
mp as (select *, case when contains(text, ' | ') then 'tabular' when regexp_matches(text, '[#$%&*]{{3}}') then 'noisy' when n_words >= {LONG} then 'long' when n_words < {SHORT} then 'short' else 'prose' end topic from mw),
mc as (select ms, ml, topic, sum(n_words) words from mp group by all)"""
    ]
    for d, short in (("ms", "s"), ("ml", "l"), ("topic", "t")):
        out.append(f"m{short} as (select {d}, pow(cast(sum(words) as double), {temper}) * {rate} * (select sum(words) from mc) / (select sum(x) from (select pow(cast(sum(words) as double), {temper}) x from mc group by {d})) target from mc group by {d})")
    out.append(f"r0 as (select mc.*, ms.target t_ms, ml.target t_ml, mt.target t_topic, words * {rate} w from mc join ms using (ms) join ml using (ml) join mt using (topic))".replace("join ms using", "join ms using"))
    last = "r0"
    for i in range(rounds):
        for d in ("ms", "ml", "topic"):
            name = f"r{i}_{d}"
            out.append(f"{name} as (select * replace (case when sum(w) over (partition by {d}) > 0 then w * t_{d} / sum(w) over (partition by {d}) else 0.0 end as w) from {last})")
            last = name
        name = f"r{i + 1}"
        out.append(f"{name} as materialized (select * replace (least(w, cast(words as double)) as w) from {last})")
        last = name
    out.append(
        f"mixed as (select mp.* exclude (ms, ml, topic), mp.topic, round(case when words > 0 then w / words else {rate} end, 9) probability, "
        f"cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '{_SALT}'), 1, 13) as ubigint) as double) / {float(1 << 52)!r} < round(case when words > 0 then w / words else {rate} end, 9) sampled "
        f"from mp join {last} on mp.ms = {last}.ms and mp.ml = {last}.ml and mp.topic = {last}.topic)"
    )
    return ",\n".join(out)
