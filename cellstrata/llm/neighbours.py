"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to ``hashes`` slots floor((a.x + b) / width) with Gaussian a, and its
bucket is the tuple of slots. For a query whose neighbours lie about ``r`` away, a projection
moves by a normal amount of deviation ``r``, so every perturbation of the query's slots has an
estimated chance of holding a neighbour. The buckets of a table are visited in the order of
those chances until they add up to what ``tables`` tables need for ``target`` together. The
candidates of all tables are merged and reranked by exact Euclidean distance in double
precision.

*Fitted* on a bounded sample (``sample`` rows of smallest hash of their id): each query's r, an
upper estimate of the distance of its k-th neighbour, and the slot width, 1.5 times the median r. The
slots per table grow with the logarithm of the row count. Every row is indexed.

*Tables meet in a shuffle.* Rows are entries of (table, group of buckets), and a group is what shares the
first slots, so that the buckets a query visits lie in few groups: it is sent to each group once, with
the buckets it visits there. A task holds one group's rows and streams the queries past them; only rows
of a visited bucket are compared. A group of over four times ``group`` rows is split, and its queries go
to every part.

*Copies.* Of rows with one vector only the k + 1 smallest ids can be among a query's k best, and k
times each, so others leave the index first. Queries with one vector are searched once.

*The exact way.* Queries without k found - as their r is 0 or unknown, as they would visit over
``most_probes`` buckets of a table, or as their buckets hold too few - are compared with every row,
in blocks of rows. ``compared`` tells how many distances a query took, which shows such queries.

Defined results: vectors null, zero, or with null or non-finite components take no part, nor do
rows without an id; vectors of another length than the query's are no candidates; rows with the
query's id are its own; of several query rows with one id the smallest vector is searched;
repeated candidates are listed as often as they occur; ties go to the smaller id; an empty table
gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellstrata.llm._text import U64, mix
from cellstrata.runtime import cut, drop, ship

_SLICE, _PAIRS, _NEAR, _HELD = 1024, 50_000, 4096, 1_000_000
_BLOCK = 16_384  # rows of a block of the exact way


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that take part; floats stay floats, other numbers are doubles."""
    e = F.col(embedding)
    kind = vectors.schema[embedding].dataType.elementType
    number = e if isinstance(kind, T.FloatType) else e.cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), number.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_length(column: pa.Array):
    """Each length of vectors and the rows that have it."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        yield dim, at, column if len(at) == len(size) else column.take(pa.array(at))


@dataclass
class Tables:
    """The hash tables for vectors of one length, and the sample that a query's r is told by."""

    dim: int
    width: float
    hashes: int
    tables: int
    leading: int
    seed: int
    near: np.ndarray
    nth: int

    def __post_init__(self):
        rng = np.random.default_rng([self.seed, self.dim])
        self.a = rng.standard_normal((self.dim, self.tables * self.hashes))
        self.b = rng.uniform(0, self.width, self.tables * self.hashes)

    def places(self, x: np.ndarray) -> np.ndarray:
        """In slot widths, by row, table and hash."""
        return ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.hashes)

    def keys(self, slots: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the leading slots, which name the group, and of all, which name the bucket."""
        h = np.full(len(slots), table + 1, dtype=U64)
        group = h
        for j in range(self.hashes):
            h = mix(h * U64(0x9E3779B97F4A7C15) + np.ascontiguousarray(slots[:, j]).view(U64))
            if j + 1 == self.leading:
                group = h
        return group, h

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """Each query's distance to the nth of the sample but itself: its k-th neighbour is hardly farther."""
        out = np.zeros(len(queries))
        for at in range(0, len(queries), 64):
            q = queries[at : at + 64]
            d = np.maximum((q**2).sum(axis=1)[:, None] + (self.near**2).sum(axis=1)[None, :] - 2 * (q @ self.near.T), 0)
            n = min(self.nth, d.shape[1]) - 1
            out[at : at + 64] = np.sqrt(np.partition(d, n, axis=1)[:, n]) if d.shape[1] else 0
        scale = np.sqrt((queries**2).sum(axis=1))
        return np.where(out > 1e-6 * scale, out, 0.0)  # rounding of the faster form: no distance


_erf = np.vectorize(math.erf, otypes=[float])


def visits(offset: np.ndarray, r: float, need: float, most: int, first: int = 64) -> np.ndarray | None:
    """Perturbations of a query's slots by falling chance, until the chances add up to ``need``; r in slot widths.

    The n likeliest tuples extend the n likeliest shorter ones, so no other ones are made; ``first`` is tried for n.
    """
    moves, chances = [], []
    reach = max(1, math.ceil(3.5 * r))
    step = np.arange(-reach, reach + 1)
    for o in offset:
        p = np.diff(_erf((np.arange(-reach, reach + 2) - o) / (r * math.sqrt(2)))) / 2
        order = np.argsort(-p, kind="stable")
        moves.append(step[order])
        chances.append(p[order])
    n = min(first, most)
    while True:
        chance, picks = np.ones(1), np.zeros((1, 0), np.int64)
        for m, p in zip(moves, chances, strict=True):
            grown = (chance[:, None] * p[None, :]).ravel()
            top = np.argpartition(-grown, n - 1)[:n] if len(grown) > n else np.arange(len(grown))
            chance, picks = grown[top], np.concatenate([picks[top // len(p)], m[top % len(p)][:, None]], axis=1)
        if chance.sum() >= need:
            order = np.argsort(-chance, kind="stable")
            return picks[order[: int(np.searchsorted(np.cumsum(chance[order]), need)) + 1]]
        if n >= most or len(chance) < n:
            return None
        n = min(2 * n, most)


def _fit(rows: DataFrame, k: int, tables: int, sample: int, group: int, seed: int) -> dict[int, Tables]:
    sizes = {x.n: x.rows for x in rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).collect()}
    held = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    by: dict[int, list] = {}
    for x in held:
        by.setdefault(len(x.embedding), []).append(x.embedding)
    out = {}
    for dim, own in by.items():
        near, total = np.array(own, dtype=np.float64), sizes[dim]
        # one more, as a query may be in the sample itself; one that is not looks a row farther, which is safe
        nth = 1 + (k if total <= sample else math.ceil(k * len(held) / sum(sizes.values())) + 1)
        hashes = min(24, max(4, round(0.65 * math.log2(max(total, 2)))))
        rough = Tables(dim, 1.0, 1, 1, 0, seed, near, nth).reach(near[:256])
        width = 1.5 * float(np.median(rough[rough > 0])) if (rough > 0).any() else 1.0
        leading = round(hashes * math.log2(max(total / group, 1)) / math.log2(max(total, 2)))
        out[dim] = Tables(dim, width, hashes, tables, leading, seed, near, nth)
    return out


_PLACE = ["d", "t", "g"]


def _entries(held, whole: bool):
    """(d, t, g) of rows (no, vec_id, embedding) in every table; ``whole``: with the bucket and the row."""

    def run(batches):
        for b in batches:
            for dim, at, column in _by_length(b.column(2)):
                own = held.value.get(dim)
                for lo in range(0, len(at) if own else 0, _SLICE):
                    part, rows = column.slice(lo, _SLICE), pa.array(at[lo : lo + _SLICE])
                    slots = np.floor(own.places(_matrix(part, dim))).astype(np.int64)
                    for t in range(own.tables):
                        g, key = own.keys(slots[:, t], t)
                        out, names = [*[pa.array(np.full(len(part), x), pa.int32()) for x in (dim, t)], pa.array(g.view(np.int64))], _PLACE
                        if whole:
                            out += [pa.array(key.view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), part]
                            names = [*_PLACE, "key", "no", "vec_id", "embedding"]
                        yield pa.RecordBatch.from_arrays(out, names)

    return run


def _probes(held, need: float, most: int):
    """(d, t, g, query, keys, embedding): the buckets that queries (cls, embedding) visit, by group; none of those that
    go the exact way."""

    def run(batches):
        for b in batches:
            for dim, at, column in _by_length(b.column(1)):
                own = held.value.get(dim)
                if own is None:
                    continue
                x, cls = _matrix(column, dim), np.asarray(b.column(0))[at]
                place, r = own.places(x), own.reach(x) / own.width
                slot = np.floor(place).astype(np.int64)
                for q in np.flatnonzero(r > 0).tolist():
                    found, first = [], 64
                    for t in range(own.tables):
                        got = visits(place[q, t] - slot[q, t], r[q], need, most, first)
                        if got is None:
                            break
                        first = max(64, len(got) * 5 // 4)
                        found.append(own.keys(slot[q, t] + got, t))
                    if len(found) < own.tables:
                        continue
                    for t, (g, key) in enumerate(found):
                        order = np.argsort(g, kind="stable")
                        lead = np.flatnonzero(np.concatenate([[True], np.diff(g[order]) != 0]))
                        n = len(lead)
                        keys = pa.ListArray.from_arrays(pa.array(np.append(lead, len(g)), pa.int32()), pa.array(key[order].view(np.int64)))
                        yield pa.RecordBatch.from_arrays(
                            [*[pa.array(np.full(n, v), pa.int32()) for v in (dim, t)], pa.array(g[order][lead].view(np.int64)), pa.array(np.full(n, cls[q]), pa.int64()), keys, column.take(pa.array(np.full(n, q)))],
                            [*_PLACE, "query", "keys", "embedding"],
                        )

    return run


_MEETING = [*_PLACE, "s", "side", "no", "id", "key", "keys", "embedding"]
_FOUND = "query long, no long, vec_id long, score double, compared long"


def _meet(entries: DataFrame, probes: DataFrame, most: int) -> DataFrame:
    """Rows and queries of one (d, t, g, s), rows first, in one task: each query's ``most`` best rows there."""
    null = F.lit(None)
    e = entries.select(*_PLACE, "s", F.lit(0).alias("side"), "no", F.col("vec_id").alias("id"), "key", null.cast("array<long>").alias("keys"), "embedding")
    q = probes.select(*_PLACE, "s", F.lit(1).alias("side"), F.col("query").alias("no"), F.col("own").alias("id"), null.cast("long").alias("key"), "keys", "embedding")
    both = e.unionByName(q).repartition(*_PLACE, "s").sortWithinPartitions(*_PLACE, "s", "side")
    return both.select(*_MEETING).mapInArrow(_search(most), _FOUND)


class _Best:
    """What a task found: k rows a query, whatever groups they came from; told when over ``_HELD`` are left."""

    def __init__(self, k: int):
        self.k, self.size, self.found, self.effort = k, 0, [], []

    def add(self, query, no, vec_id, score, asked, compared) -> None:
        self.found.append((query, no, vec_id, score))
        self.effort.append((asked, compared))
        self.size += len(query)

    def combine(self) -> None:
        query, no, vec_id, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        by = np.lexsort((no, vec_id, score, query))
        query, no, vec_id, score = query[by], no[by], vec_id[by], score[by]
        new = np.ones(len(no), dtype=bool)  # a row found in several tables has the same score each time
        new[1:] = (no[1:] != no[:-1]) | (query[1:] != query[:-1])
        query, no, vec_id, score = query[new], no[new], vec_id[new], score[new]
        stay = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.found = [(query[stay], no[stay], vec_id[stay], score[stay])]
        asked, compared = (np.concatenate(x) for x in zip(*self.effort, strict=True))
        once, back = np.unique(asked, return_inverse=True)
        self.effort = [(once, np.bincount(back, compared, len(once)).astype(np.int64))]
        self.size = int(stay.sum())

    def tell(self):
        if not self.found:
            return
        self.combine()
        query, no, vec_id, score = self.found[0]
        asked, compared = self.effort[0]
        none, m, names = pa.nulls, len(asked), ["query", "no", "vec_id", "score", "compared"]
        for at in range(0, len(query), 1 << 16):
            p = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([*[pa.array(x[p]) for x in (query, no, vec_id, score)], none(len(query[p]), pa.int64())], names)
        for at in range(0, m, 1 << 16):
            p = slice(at, at + (1 << 16))
            n = len(asked[p])
            yield pa.RecordBatch.from_arrays([pa.array(asked[p]), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.float64()), pa.array(compared[p])], names)
        self.found, self.effort, self.size = [], [], 0


def _search(k: int):
    def run(batches):
        group, parts, rows, best = None, [], None, _Best(k)
        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([np.asarray(b.column(i)) for i in range(5)], axis=1)
            edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(axis=1), [True]]))
            for lo, hi in zip(edge, edge[1:], strict=False):
                own, part = tuple(place[lo, :4].tolist()), b.slice(lo, hi - lo)
                if own != group:
                    group, parts, rows = own, [], None
                if place[lo, 4] == 0:
                    parts.append(part)
                elif parts:
                    rows = rows or _Group(parts, own[0])
                    rows.nearest(part, k, best)
                    if best.size > _HELD:
                        best.combine()
                        if best.size > _HELD // 2:
                            yield from best.tell()
        yield from best.tell()

    return run


class _Group:
    """The rows of a group by bucket."""

    def __init__(self, parts: list, dim: int):
        get = lambda i: pa.concat_arrays([p.column(i) for p in parts])
        key = np.asarray(get(7).fill_null(0)).view(U64)
        order = np.argsort(key, kind="stable")
        self.key, self.dim = key[order], dim
        self.no, self.id = np.asarray(get(5))[order], np.asarray(get(6))[order]
        self.x = np.concatenate([_matrix(p.column(9), dim) for p in parts])[order]

    def nearest(self, part: pa.RecordBatch, k: int, best: _Best) -> None:
        """Adds the k best of the rows whose bucket a query visits; queries without a list of buckets visit all."""
        x, name = _matrix(part.column(9), self.dim), np.asarray(part.column(5))
        own = part.column(6)
        skip, has_own = np.asarray(own.fill_null(0)), np.asarray(own.is_valid())
        whole = np.asarray(part.column(8).is_null())
        n = part.column(8).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = part.column(8).flatten().to_numpy(zero_copy_only=False).view(U64)
        lo, hi = np.searchsorted(self.key, keys, "left"), np.searchsorted(self.key, keys, "right")
        who = np.repeat(np.arange(len(x)), n)
        who, lo, hi = (np.concatenate(v) for v in ((who, np.flatnonzero(whole)), (lo, np.zeros(whole.sum(), np.int64)), (hi, np.full(whole.sum(), len(self.x)))))
        order = np.argsort(who, kind="stable")
        who, lo, size = who[order], lo[order], (hi - lo)[order]
        total = np.cumsum(np.bincount(who, size, len(x)).astype(np.int64))
        at = 0
        while at < len(x):  # as many queries as make some pairs, one at least
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
            p = slice(*np.searchsorted(who, [at, to]))
            many = size[p]
            row = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[p], many)
            q = np.repeat(who[p], many)
            at = to
            if not len(q):
                continue
            d = np.concatenate([np.sqrt(((x[q[i : i + _NEAR]] - self.x[row[i : i + _NEAR]]) ** 2).sum(axis=1)) for i in range(0, len(q), _NEAR)])
            asked, compared = np.unique(q, return_counts=True)
            other = ~(has_own[q] & (skip[q] == self.id[row]))
            q, row, d = q[other], row[other], d[other]
            by = np.lexsort((self.id[row], d, q))
            q, row, d = q[by], row[by], d[by]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            q, row, d = q[nth < k], row[nth < k], d[nth < k]
            best.add(name[q], self.no[row], self.id[row], d, name[asked], compared)


def _ranked(found: DataFrame, of: str, k: int) -> DataFrame:
    best = Window.partitionBy(of).orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 10,
    target: float = 0.92,
    tables: int = 8,
    sample: int = 4096,
    most_probes: int = 20_000,
    group: int = 1024,
    seed: int = 11,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score, compared): the k nearest rows found of every query; ``is_query`` is over vec_id."""
    spark = ship(vectors.sparkSession)
    every = usable(vectors, vec_id, embedding)
    times = F.row_number().over(Window.partitionBy("embedding", "vec_id").orderBy("vec_id"))
    copies = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    rows = every.withColumn("_n", times).where(F.col("_n") <= k).withColumn("_n", copies).where(F.col("_n") <= k + 1)
    rows = cut(rows.select(F.monotonically_increasing_id().alias("no"), "vec_id", "embedding"), "neighbours-rows")
    asked = every.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = cut(asked.withColumn("cls", F.min("vec_id").over(Window.partitionBy("embedding"))), "neighbours-queries")
    searched = asked.where("vec_id = cls").select("cls", "embedding")

    fitted = _fit(rows, k, tables, sample, group, seed)
    held = spark.sparkContext.broadcast(fitted)
    place = [T.StructField(c, T.IntegerType()) for c in "dt"] + [T.StructField("g", T.LongType())]
    entries = rows.mapInArrow(_entries(held, True), T.StructType([*place, T.StructField("key", T.LongType()), *rows.schema]))
    sizes = rows.mapInArrow(_entries(held, False), T.StructType(place)).groupBy(*_PLACE).agg(F.count("*").alias("n"))
    parts = F.when(F.col("n") > 4 * group, F.ceil(F.col("n") / group)).otherwise(1).cast("int")
    groups = cut(sizes.select(*_PLACE, parts.alias("parts")), "neighbours-groups")
    entries = entries.join(groups.where("parts > 1"), _PLACE, "left").withColumn("s", F.pmod(F.xxhash64("no"), F.coalesce("parts", F.lit(1))).cast("int"))
    need = 1 - (1 - target) ** (1 / tables)
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a query's visits take far longer than its bytes
    probes = searched.repartition(tasks, "cls").mapInArrow(_probes(held, need, most_probes), T.StructType([*place, T.StructField("query", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), rows.schema["embedding"]]))
    probes = probes.join(groups, _PLACE).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # A class of queries leaves out no row: own ids go when the class is dealt to its queries, and 2k hold k of others.
    found = cut(_meet(entries, probes.select(*_PLACE, "s", "query", F.lit(None).cast("long").alias("own"), "keys", "embedding"), 2 * k), "neighbours-found")
    once = found.where("no is not null").groupBy("query", "no").agg(F.min("vec_id").alias("vec_id"), F.min("score").alias("score"))
    effort = found.where("no is null").groupBy("query").agg(F.sum("compared").alias("compared"))
    classes = _ranked(once, "query", 2 * k).select(F.col("query").alias("cls"), "vec_id", "score")
    own = classes.join(asked.select("cls", F.col("vec_id").alias("query_id")), "cls").where("vec_id <> query_id")
    own = _ranked(own, "query_id", k).join(effort.withColumnRenamed("query", "cls"), "cls", "left")
    out = cut(own.select("query_id", "rank", "vec_id", "score", "compared"), "neighbours-best")
    drop(found, groups)

    full = out.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    left = cut(asked.join(full, "vec_id", "left_anti"), "neighbours-left")
    if left.isEmpty():
        return out
    blocks = max(1, math.ceil(rows.count() / _BLOCK))
    every_row = rows.select(F.size("embedding").alias("d"), F.lit(-1).alias("t"), F.pmod(F.xxhash64("no"), F.lit(blocks)).alias("g"), F.lit(0).alias("s"), "no", "vec_id", F.lit(None).cast("long").alias("key"), "embedding")
    whole = left.select(F.size("embedding").alias("d"), F.lit(-1).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("g"), F.lit(0).alias("s"), F.col("vec_id").alias("query"), F.col("vec_id").alias("own"), F.lit(None).cast("array<long>").alias("keys"), "embedding")
    found = cut(_meet(every_row, whole, k), "neighbours-whole")
    exact = _ranked(found.where("no is not null"), "query", k).join(found.where("no is null").groupBy("query").agg(F.sum("compared").alias("all")), "query")
    exact = exact.select(F.col("query").alias("query_id"), "rank", "vec_id", "score", F.col("all").alias("compared"))
    return out.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(exact)
