"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct shingles of five words. Two documents link when the
Jaccard similarity of their sets is at least ``percent`` / 100, decided in whole numbers.

*Order and classes.* All shingles are counted: packed sorted arrays of each chunk's shingles meet
in groups of the hash space. Those of one document come first in the order, then *rare* ones, then
*frequent* ones, each class in the order of its hashes. What is found more than once is told to all
tasks by a bitmap (of bounded size, see ``_bitmap``), whose false hits only move a shingle to the rare ones; frequent is
what ``LEAST_FREQUENT`` documents have, or the least power of two times that leaves at most
``MOST_FREQUENT`` hashes, which are broadcast. A shingle of one document can match nothing, so it
counts for a prefix but is not indexed.

*Signatures.* A set of n shingles that links shares at least a = ceil(t n) of them, so n - a + 1
unshared ones are too many. Its prefix grows in the global order until sum(max(0, p - (k - 1)))
over the classes reaches n - a + 1, where p of the prefix's shingles lie in a class that is
indexed by k-combinations: if two sets shared no combination, more than n - a of the prefix of
the one that ends first would be unshared. Rare shingles are indexed alone (k = 1). Frequent
ones are dealt by their hash to classes of about four prefix members and indexed by pairs
(k = 2); the number of classes follows from the size, rounded to a power of 100 / percent (1.25
at least), and a set signs for its own size and the next, as linked sets are at most one apart.
(Sets so small that linked ones may share no more shingles than there are classes index them alone:
at 80 percent sets of one shingle.)

*Candidates.* Equal sets are one class. In a group of classes with a common signature, stars
around one class are verified first and joined into components; then pairs of different
components that share a signature, and pass the bounds on length, position and count, are verified.
So no pair that could join components is left out, and groups of copies are not expanded. These
pairs meet by signature and rank of size: a set of n shingles, s of which other documents have,
links with none of more than s (100 + percent) / percent - n, so of documents that share a
boilerplate but say more of their own than may differ, no two meet.

*Verification* fetches the texts of both classes and intersects their sets.

Defined results: null and word-less texts have no shingles and link with nothing; a text of
fewer than five words is one shingle; rows without an id have a null component and link
nothing; rows that share an id link what any of them links; a very long text is a piece of its own;
an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellstrata.llm import _bitmap
from cellstrata.llm import _text as X
from cellstrata.llm.components import components
from cellstrata.runtime import cut, drop, ship

SHINGLE, PERCENT = 5, 80
MOST_FREQUENT = 1 << 20
LEAST_FREQUENT = 8
HIGH = 64  # documents; what has fewer is compared by bitmaps before texts are
SKETCH = 8  # words of such a bitmap
_GROUP = 2_000_000  # shingles of a group of the hash space
_CHUNK = 4_000_000
_RANK = 1.07  # ratio of the sizes of two ranks in the last round
_PER_CLASS = 4
STARS = 2  # rounds after the first; the last one is over all pairs

#: Bytes of words: all but blank and the controls 9 to 13.
WORD = np.ones(256, dtype=bool)
WORD[[9, 10, 11, 12, 13, 32]] = False


def _sorted(own: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sorts by (own, key). Both fit one word but for the key's last bits, whose rare ties are sorted in full."""
    bits = max(1, int(own[-1] if len(own) else 0).bit_length())
    if bits <= 16:
        word = own.astype(X.U64) << X.U64(64 - bits) | key >> X.U64(bits)
        order = np.argsort(word)
        told = word[order]
        same = np.flatnonzero(told[1:] == told[:-1])
        if not len(same) or (key[order[same]] == key[order[same + 1]]).all():
            return order
    return np.lexsort((key, own))


def shingle_sets(texts: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text after text and sorted within, and each text's first one."""
    buf, offs = X.flat(texts)
    low = X.LOWER[buf]
    s, e, first = X.spans(low, offs, WORD)
    g, at = X.shingles(X.hash_spans(low, s, e), first, shingle, short=True)
    if seed:
        g = X.mix(g ^ X.U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    own = np.searchsorted(first, at, "right") - 1
    order = _sorted(own, g)
    g, own = g[order], own[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    g, own = g[new], own[new]
    return g, np.searchsorted(own, np.arange(len(first)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[first[1:]] - total[first[:-1]]


def _fingerprints(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, whatever the order."""
    lo = X.mix(_sums(X.mix(g), first) + np.diff(first).astype(X.U64))
    hi = X.mix(_sums(X.mix(g * X.U64(0x94D049BB133111EB) + X.U64(1)), first))
    return lo, hi


def least_overlap(n, percent: int):
    """ceil(percent / 100 * n) in whole numbers."""
    return (n * percent + 99) // 100


@dataclass
class Order:
    """What is known of shingles: those of several documents (a bitmap), and the sorted names of frequent ones and of
    the most frequent of these."""

    buckets: int
    bitmap: np.ndarray
    frequent: np.ndarray
    high: np.ndarray

    def rank(self, g: np.ndarray) -> np.ndarray:
        """0: of one document, 1: rare, 2: frequent, 3: frequent and high."""
        name = X.bucket_of(g, self.buckets).astype(X.U64) << X.U64(32) | (g & X.U64(0xFFFFFFFF))
        out = _bitmap.holds(self.bitmap, name).astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, name), len(self.frequent) - 1)
            out[self.frequent[at] == name] = 2
        if len(self.high):
            at = np.minimum(np.searchsorted(self.high, name), len(self.high) - 1)
            out[self.high[at] == name] = 3
        return out


def _sets(docs: DataFrame, shingle: int, seed: int, text: str, buckets: int) -> DataFrame:
    """(doc_id, n, c, hi) of every row, and (bucket, packed) of each chunk's distinct shingles and their counts."""

    def run(batches):
        held, size = [], 0
        empty = lambda n, t=pa.int64(): pa.nulls(n, t)
        names = ["doc_id", "n", "c", "hi", "bucket", "packed"]

        def told():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            edge = np.searchsorted(X.bucket_of(h, buckets), np.arange(buckets + 1))
            low = (h & X.U64(0xFFFFFFFF)).astype(np.uint32)
            full = np.flatnonzero(np.diff(edge))
            rows = []
            for b in full.tolist():
                p = slice(edge[b], edge[b + 1])
                many = np.flatnonzero(n[p] > 1).astype(np.uint32)
                rows.append(X.pack(np.diff(low[p], prepend=np.uint32(0)), many, n[p][many].astype(np.uint32)))
            return pa.RecordBatch.from_arrays([*[empty(len(rows))] * 4, pa.array(full, pa.int32()), pa.array(rows, pa.binary())], names)

        for b in X.pieces(batches):
            g, first = shingle_sets(b.column(1), shingle, seed)
            lo, hi = _fingerprints(g, first)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first), pa.int64()), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), empty(n, pa.int32()), empty(n, pa.binary())], names)
            held.append(g)
            size += len(g)
            if size >= _CHUNK:
                yield told()
                held, size = [], 0
        if size:
            yield told()

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, c long, hi long, bucket int, packed binary")


def _counted(key, table):
    """Shingles of a group of the hash space that are found more than once: (name, times)."""
    low, times = [], []
    for data in table.column("packed").to_pylist():
        step, many, n = X.unpack(data, np.uint32, np.uint32, np.uint32)
        count = np.ones(len(step), dtype=np.int64)
        count[many] = n
        low.append(np.cumsum(step, dtype=np.uint32))
        times.append(count)
    low, times = np.concatenate(low), np.concatenate(times)
    by = np.argsort(low, kind="stable")
    low, times = low[by], times[by]
    lead = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    total = np.add.reduceat(times, lead)
    at = np.flatnonzero(total > 1)
    name = np.int64(key[0].as_py()) << 32 | low[lead[at]].astype(np.int64)
    return pa.table({"name": pa.array(name, pa.int64()), "times": pa.array(total[at], pa.int64())})


def _order(told: DataFrame, buckets: int, most: int, least: int) -> Order:
    several = cut(told.groupBy("bucket").applyInArrow(_counted, "name long, times long"), "jaccard-several")

    bitmap = _bitmap.collect(several.select("name"), _bitmap.bits_for(several.count()))
    sizes = several.where(F.col("times") >= least).groupBy(F.floor(F.log2(F.col("times") / least)).alias("k")).agg(F.count("*").alias("n")).collect()
    floor, left = least, sum(r.n for r in sizes)
    for r in sorted(sizes):
        if left <= most:
            break
        left -= r.n
        floor = least << (r.k + 1)
    rows = several.where(F.col("times") >= floor)  # at most ``most``
    found = np.array([(r.name, r.times) for r in rows.toLocalIterator()], dtype=np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0].view(X.U64) if len(found) else found[:, 0])]
    names = found[:, 0].copy().view(X.U64)
    drop(several)
    return Order(buckets, bitmap, names, names[found[:, 1] >= HIGH])


def _step(percent: int) -> float:
    """Ratio of the sizes of two ranks: linked sets are at most one rank apart."""
    return max(1.25, 100 / percent)


def _classes(size_rank: int, percent: int) -> int:
    """Number of frequent classes for a size rank; 0: frequent shingles are indexed alone.

    Linked sets of this rank share ``least`` shingles, or one that is indexed alone; in fewer classes than that,
    two shared ones fall to one class even where a whole set is too small for its prefix.
    """
    size = _step(percent) ** (size_rank + 1)
    least = math.ceil(percent / 100 * _step(percent) ** (size_rank - 1) - 1e-9)
    classes = max(1, math.ceil((100 - percent) / 100 * size / _PER_CLASS))
    return classes if least > classes else 0


def signatures(g: np.ndarray, first: np.ndarray, known: Order, percent: int):
    """For sets as of shingle_sets: signature, set, position in the set's order, whether it is of frequent shingles;
    and by set whether its prefix has no frequent ones, its numbers of frequent, of high and of other shared shingles, and a
    bitmap of the latter. Shingles of one document are left out."""
    n = np.diff(first)
    own = X.owner(first)
    rank = known.rank(g)
    key = X.mix(g ^ X.U64(0x5851F42D4C957F2D))
    order = _sorted(4 * own + np.minimum(rank, 2), key) if len(own) else own
    key, rank = key[order], rank[order]
    place = np.arange(len(g)) - first[own]
    need = n - least_overlap(n, percent) + 1
    rare = np.bincount(own[rank < 2], minlength=len(n))
    take = (rank == 1) & (place < need[own])
    out = [(key[take], own[take], place[take])]
    pairs = []
    step = math.log(_step(percent))
    for d in np.flatnonzero((rare < need) & (n > 0)).tolist():
        lo = first[d] + rare[d]
        h = key[lo : first[d + 1]]
        lack = int(need[d] - rare[d])
        size_rank = int(math.log(n[d]) / step + 1e-9)  # 8 of ratio 2 is rank 3, whatever the rounding
        for b in (size_rank, size_rank + 1):
            m = _classes(b, percent)
            salt = X.mix(np.array([b + 1], dtype=X.U64))[0]
            if not m:
                pairs.append((X.mix(h[:lack] ^ salt), d, rare[d] + np.arange(min(lack, len(h)))))
                continue
            cls = (h % X.U64(m)).astype(np.int64)
            by = np.argsort(cls, kind="stable")
            sizes = np.bincount(cls, minlength=m)
            nth = np.empty(len(h), dtype=np.int64)  # how many of its class came before
            nth[by] = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            gain = np.cumsum(nth > 0)
            end = int(np.searchsorted(gain, lack)) + 1
            i, j = _pairs(by[by < end], cls)
            pairs.append((X.mix(X.mix(h[i] ^ salt) * X.U64(0x9E3779B97F4A7C15) + h[j]), d, rare[d] + i))
    if pairs:
        sig = np.concatenate([p[0] for p in pairs])
        size = [len(p[0]) for p in pairs]
        extra = (sig, np.repeat([p[1] for p in pairs], size), np.concatenate([p[2] for p in pairs]))
    else:
        extra = (np.zeros(0, X.U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    kind = np.concatenate([np.zeros(len(out[0][0]), bool), np.ones(len(extra[0]), bool)])
    return *(np.concatenate([a, b]) for a, b in zip(out[0], extra, strict=True)), kind, rare >= need, *_profile(key, rank, own, len(n))


def _profile(key: np.ndarray, rank: np.ndarray, own: np.ndarray, sets: int):
    often, high = (np.bincount(own[rank >= r], minlength=sets) for r in (2, 3))
    low = (rank == 1) | (rank == 2)
    bits = np.zeros((sets, SKETCH), dtype=X.U64)
    at = key[low] % X.U64(64 * SKETCH)
    np.bitwise_or.at(bits, (own[low], (at >> X.U64(6)).astype(np.int64)), X.U64(1) << (at & X.U64(63)))
    return often, high, np.bincount(own[low], minlength=sets), bits


def _pairs(order: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of one class; order: positions, class after class and rising within."""
    c = cls[order]
    i, j = [], []
    gap = 1
    while gap < len(order):
        same = np.flatnonzero(c[gap:] == c[:-gap])
        if not len(same):
            break
        i.append(order[same])
        j.append(order[same + gap])
        gap += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(i), np.concatenate(j)) if i else (none, none)


_WORDS = [f"b{i}" for i in range(SKETCH)]
_OF = ["c", "n", "pos", "pure", "f", "high", "low", *_WORDS]


def _signed(docs: DataFrame, shingle: int, seed: int, percent: int, known: Order, text: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for b in X.pieces(batches):
            g, first = shingle_sets(b.column(0), shingle, seed)
            lo, _ = _fingerprints(g, first)
            sig, d, pos, often, pure, f, high, low, bits = signatures(g, first, held.value, percent)
            n = np.diff(first)
            for at in range(0, len(sig), 1 << 18):
                p = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[p].view(np.int64)), pa.array(lo.view(np.int64)[d[p]]), pa.array(n[d[p]], pa.int32()), pa.array(pos[p], pa.int32()), pa.array(pure[d[p]]), *[pa.array(v[d[p]], pa.int32()) for v in (f, high, low)], *[pa.array(bits[d[p], w].view(np.int64)) for w in range(SKETCH)], pa.array(often[p])],
                    ["sig", *_OF, "often"],
                )

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "sig long, c long, n int, pos int, pure boolean, f int, high int, low int, " + ", ".join(f"{w} long" for w in _WORDS) + ", often boolean")


def _near(percent: int):
    """Whether sets x and y can be similar enough by their sizes and by what they can have in common.

    Of other shingles than high ones, at most those are shared whose bits both have, and what a set has beyond its bits.
    """
    n1, n2 = F.col("xn"), F.col("yn")
    ones = lambda f: sum((F.bit_count(f(w)) for w in _WORDS), F.lit(0))
    common = ones(lambda w: F.col(f"x{w}").bitwiseAND(F.col(f"y{w}")))
    spare = F.least(*[F.col(f"{p}low") - ones(lambda w, p=p: F.col(f"{p}{w}")) for p in "xy"])
    shared = F.least("xhigh", "yhigh") + F.least("xlow", "ylow", common + spare)
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (shared * (100 + percent) >= (n1 + n2) * percent)


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Of rows for each common signature of classes x and y, the pairs (a, b) that may be similar enough.

    *Position*: of two sets with a common shingle at p1 and p2, at most min(p1, p2) + 1 + min(n1 - p1, n2 - p2) - 1
    are shared. *Count*: if all signatures of both are single shingles, what is shared up to the end of the prefix
    that ends first is what the signatures share, and behind it that set has no more than ceil(t n) - 1. If neither
    prefix has rare shingles only, all rare ones are signatures: what is shared is them and frequent ones.
    """
    n1, n2, p1, p2 = F.col("xn"), F.col("yn"), F.col("xpos"), F.col("ypos")
    most = F.least(p1, p2) + 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    need = (F.col("xn") + F.col("yn")) * percent
    by = pairs.groupBy(F.least("xc", "yc").alias("a"), F.greatest("xc", "yc").alias("b")).agg(
        F.count("*").alias("s"), F.min(most).alias("most"), F.first("xn").alias("xn"), F.first("yn").alias("yn"), F.min(F.col("xpure") & F.col("ypure")).alias("pure"),
        F.min(~F.col("xpure") & ~F.col("ypure")).alias("mixed"), F.sum(F.when(F.col("often"), 0).otherwise(1)).alias("r"), F.min(F.least("xf", "yf")).alias("f"),
    )
    behind = F.expr(f"(greatest(xn, yn) * {percent} + 99) div 100 - 1")
    fit = (F.col("most") * (100 + percent) >= need) & (~F.col("pure") | ((F.col("s") + behind) * (100 + percent) >= need)) & (~F.col("mixed") | ((F.col("r") + F.col("f")) * (100 + percent) >= need))
    return by.where(fit).select("a", "b")


def _verified(edges: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, seed: int, percent: int, text: str) -> DataFrame:
    """Those of the candidate edges (a, b) whose sets are similar enough."""
    wanted = edges.select(F.col("a").alias("c")).unionByName(edges.select(F.col("b").alias("c"))).distinct()
    rep = reps.join(wanted, "c").select("c", F.col("rep").alias("doc_id"))
    texts = docs.select("doc_id", F.col(text).alias("text")).join(rep, "doc_id").select("c", "text")

    def proper(batches):  # of rows that share an id, the one that is of the class
        for b in X.pieces(batches):
            lo, _ = _fingerprints(*shingle_sets(b.column(1), shingle, seed))
            yield b.filter(pa.array(lo.view(np.int64) == np.asarray(b.column(0))))

    texts = cut(texts.mapInArrow(proper, "c long, text string").dropDuplicates(["c"]), "jaccard-texts")
    both = edges.join(texts.select(F.col("c").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("c").alias("a"), F.col("text").alias("text")), "a")

    def run(batches):
        for b in X.pieces(batches, "text", 1 << 20):
            a_id, b_id = np.asarray(b.column(0)), np.asarray(b.column(1))
            _, lead, back = np.unique(a_id, return_index=True, return_inverse=True)
            ga, fa = shingle_sets(b.column(2).take(pa.array(lead)), shingle, seed)
            gb, fb = shingle_sets(b.column(3), shingle, seed)
            tag = lambda g, i: X.mix(g ^ X.mix(i.astype(X.U64) + X.U64(1)))
            known = np.sort(tag(ga, X.owner(fa)))
            ask = tag(gb, back[X.owner(fb)])
            at = np.minimum(np.searchsorted(known, ask), max(0, len(known) - 1))
            both = _sums((known[at] == ask).astype(np.int64), fb) if len(known) else np.zeros(len(b_id), np.int64)
            union = np.diff(fa)[back] + np.diff(fb) - both
            ok = 100 * both >= percent * union
            yield pa.RecordBatch.from_arrays([pa.array(a_id[ok]), pa.array(b_id[ok])], ["a", "b"])

    out = cut(both.select("a", "b", "text", "text_b").mapInArrow(run, "a long, b long"), "jaccard-links")
    drop(texts)
    return out


def _last_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Rows for each common signature of classes of different components that may be similar enough by size and by
    what they can share; x is the smaller one, and looks for y in the ranks of size that it may link with."""
    rank = lambda n: F.floor(F.log(n) / F.lit(math.log(_RANK))).cast("int")
    able = lambda p: F.floor((F.col(f"{p}low") + F.col(f"{p}high")) * (100 + percent) / percent)
    side = lambda p: [F.col(c).alias(p + c) for c in [*_OF, "k"]]
    most = F.least(able("x") - F.col("xn"), F.floor(F.col("xn") * 100 / percent))
    x = live.select("sig", "often", *side("x")).where(most >= F.col("xn"))
    x = x.withColumn("rank", F.explode(F.sequence(rank(F.col("xn")), rank(most))))
    y = live.select("sig", *side("y")).withColumn("rank", rank(F.col("yn")))
    less = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("xc") < F.col("yc")))
    fit = F.col("xn") + F.col("yn") <= F.least(able("x"), able("y"))
    return x.join(y, ["sig", "rank"]).where((F.col("xk") != F.col("yk")) & less & fit).drop("rank")


def link(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, text: str = "text", most_frequent: int = MOST_FREQUENT, least_frequent: int = LEAST_FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    text = "text"
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(16, total // (6 * _GROUP))
    for seed in range(8):
        told = cut(_sets(docs, shingle, seed, text, buckets), "jaccard-told")
        sets = cut(told.where("packed is null").select("doc_id", "n", "c", "hi"), "jaccard-sets")
        able = sets.where("n > 0 and doc_id is not null")
        reps = cut(able.groupBy("c", "hi").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "jaccard-classes")
        seen = reps.agg(F.count("*").alias("n"), F.countDistinct("c").alias("k")).first()
        if seen.n == seen.k:
            break
        drop(told, sets, reps)  # two classes have one 64-bit hash: hash anew
    else:
        raise RuntimeError("sets that differ had equal hashes eight times")
    known = _order(told.where("packed is not null").select("bucket", "packed"), buckets, most_frequent, least_frequent)
    drop(told)
    signed = _signed(docs.where("doc_id is not null"), shingle, seed, percent, known, text)
    # A rare shingle's group is bounded by what made it rare, so a window may hold it. Groups of frequent
    # ones have no bound: their leaders come from a combined aggregate and meet them in a join.
    of = _OF
    # The leader of a group is the class nearest to what many share: most of its copies link with it.
    lead = F.struct((F.col("n") - F.col("high")).alias("own"), F.xxhash64("c").alias("x"), *of)
    own = Window.partitionBy("sig")
    cols = ["sig", *of, "lead"]
    rare = signed.where("not often").select("sig", *of).distinct()
    live = rare.withColumns({"lead": F.min(lead).over(own), "c0": F.min("c").over(own), "c1": F.max("c").over(own)}).where("c0 <> c1").select(*cols, F.lit(False).alias("often"))
    if len(known.frequent):
        many = cut(signed.where("often").drop("often").distinct(), "jaccard-frequent")
        heads = many.groupBy("sig").agg(F.min(lead).alias("lead"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("sig", "lead")
        live = live.unionByName(many.join(heads, "sig").select(*cols, F.lit(True).alias("often")))
    live = cut(live, "jaccard-live")
    if len(known.frequent):
        drop(many)
    side = lambda p, *of: [F.col(c).alias(p + c.rpartition(".")[2]) for c in of]
    near = _near(percent)
    leads = [f"lead.{c}" for c in of]
    pairs = live.where("c <> lead.c").select("sig", "often", *side("x", *of), *side("y", *leads))
    done = cut(_likely(pairs.where(near), percent), "jaccard-stars")
    links = _verified(done, docs, reps, shingle, seed, percent, text)
    shared = able.groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.collect_set("c").alias("all")).where("a <> b").select("a", F.explode("all").alias("b"))
    label = cut(components(links.unionByName(shared)), "jaccard-label")
    drop(links)
    for turn in range(1, STARS + 1):
        # What shares a signature but no component yet.
        placed = cut(live.drop("lead", "k").join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("k", F.coalesce("component", "c")).drop("component"), "jaccard-placed")
        drop(live)
        mixed = placed.groupBy("sig").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min(F.struct(F.xxhash64(F.lit(turn), "c").alias("x"), *of, "k")).alias("lead"))
        mixed = cut(mixed.where("k0 <> k1").select("sig", "lead"), "jaccard-mixed")
        live = cut(placed.join(mixed, "sig"), "jaccard-left")
        drop(placed, mixed)
        if turn < STARS:  # another star in each group, around another class
            pairs = live.where("k <> lead.k").select("sig", "often", *side("x", *of), *side("y", *leads))
        else:  # then all that is left
            pairs = _last_pairs(live.drop("lead"), percent)
        fresh = cut(_likely(pairs.where(near), percent).join(done, ["a", "b"], "left_anti"), "jaccard-fresh")
        links = _verified(fresh, docs, reps, shingle, seed, percent, text)
        before = label
        label = cut(components(label.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links)), "jaccard-label")
        drop(links, before)
        done = done.unionByName(fresh)
    drop(live)
    whole = label.join(reps.select(F.col("c").alias("node"), "rep"), "node")
    small = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    by = cut(label.join(small, "component").select(F.col("node").alias("c"), "component_id"), "jaccard-components")
    classes = reps.join(by, "c", "left").select("c", F.coalesce("component_id", "rep").alias("component_id"))
    out = sets.withColumn("c", F.when(F.col("n") > 0, F.col("c")))
    return out.join(classes, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents less all but the one of smallest id of each component; rows without an id stay.

    Of several rows with one id, the first by text stays.
    """
    first = link(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = rows.where("row.doc_id is not null").join(first, F.col("row.doc_id") == F.col("_first"))
    nth = F.row_number().over(Window.partitionBy("_first").orderBy("row.text"))
    named = named.withColumn("nth", nth).where("nth = 1").select("row")
    return named.unionByName(rows.where("row.doc_id is null")).select("row.*")
