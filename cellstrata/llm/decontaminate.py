"""Benchmark decontamination: a prefix-filtered containment join.

Every window of ``window`` benchmark words (a shorter item is one window) is a set of word
shingles. Shingles are ordered by rarity, counted over all documents. Containment of the
whole window needs all of its shingles, so its necessary prefix is the rarest one: only
that is joined with the shingles of the documents. A match fixes where the window would
lie; it must lie inside the document (length and positional bounds). Then the window's words
are compared with the document's at that place.

Windows and their prefixes are a table, and documents meet it by the prefix's hash: a bitmap of the
hashes (of bounded size, see ``_bitmap``) keeps other shingles at the scan, and what passes
carries the words around it, so no text moves. Spark sends the prefixes to all tasks if they are
small, and shuffles both sides if not. What is found is told by the text's hash of 128 bits, so that
copies count once, and the documents fetch it by theirs.

Defined results: null and word-less texts have no words and are clean; a null benchmark
text or one without words has no windows; a null item_id hits words but names no item;
repeated items count once; rows are independent, so repeated documents repeat; a very long text
is a piece of its own; empty tables give no hits, or no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellstrata.llm import _bitmap
from cellstrata.llm import _text as X
from cellstrata.runtime import cut, drop, ship

#: Bytes of words: digits, a-z and all above ASCII, once A-Z are in lower case.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: The same, of a text as it is.
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(texts: pa.Array):
    buf, offs = X.flat(texts)
    buf = X.LOWER[buf]
    s, e, first = X.spans(buf, offs, WORD)
    return buf, s, e, first, X.hash_spans(buf, s, e)


def _joined(buf: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Array:
    """n words from each place on, with blanks between."""
    word = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    size = e[word] - s[word] + 1
    stop = np.cumsum(size)
    data = np.full(int(stop[-1]) if len(stop) else 0, 32, dtype=np.uint8)
    inside = np.ones(len(data), dtype=bool)
    inside[stop - 1] = False
    data[inside] = buf[np.arange(len(data))[inside] - np.repeat(stop - size - s[word], size - 1)]
    ends = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(n)])]
    whole = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return whole.cast(pa.large_string())  # each ends in a blank


def _windows(window: int, shingle: int):
    """(win, n, hashes, item) of every window of a benchmark."""

    def run(batches):
        for b in X.pieces(batches):
            buf, s, e, first, h = _words(b.column(1))
            size = np.diff(first)
            many = np.where(size > 0, np.maximum(size - window, 0) + 1, 0)
            item = np.repeat(np.arange(b.num_rows), many)
            at = np.repeat(first[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            n = np.minimum(size, window)[item]
            told = {j: X.shingles(h, first, j) for j in np.unique(np.minimum(n, shingle)).tolist()}
            for lo in range(0, len(at), 20_000):
                p = slice(lo, lo + 20_000)
                k = np.minimum(n[p], shingle)
                each = n[p] - k + 1
                place = np.repeat(at[p] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                own = np.zeros(len(place), dtype=X.U64)
                kind = np.repeat(k, each)
                for j in np.unique(k).tolist():
                    g, start = told[j]
                    mine = kind == j
                    own[mine] = g[np.searchsorted(start, place[mine])]
                hashes = pa.ListArray.from_arrays(X.offsets_of(each), pa.array(own.view(np.int64)))
                yield pa.RecordBatch.from_arrays([_joined(buf, s, e, at[p], n[p]).cast(pa.string()), pa.array(n[p], pa.int32()), hashes, b.column(0).take(pa.array(item[p]))], ["win", "n", "hashes", "item"])

    return run


def _count(held, sizes: list[int]):
    """(h, n): occurrences of the shingles that the bitmap lets through."""

    def run(batches):
        bitmap, seen, size = held.value, [], 0

        def told():
            h, n = np.unique(np.concatenate(seen), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        for b in X.pieces(batches):
            _, _, _, first, h = _words(b.column(0))
            for k in sizes:
                g, _ = X.shingles(h, first, k)
                seen.append(g[_bitmap.holds(bitmap, g)])
                size += len(seen[-1])
            if size > 1_000_000:
                yield told()
                seen, size = [], 0
        if size:
            yield told()

    return run


_MET = "k1 long, k2 long, h long, pos int, left int, lead int, around string"


def _meet(held, sizes: list[int], window: int):
    """Of each text, its shingles that the bitmap lets through: place, words from there to the end, and the words around."""

    def run(batches):
        bitmap = held.value
        for b in X.pieces(batches):
            k1, k2 = np.asarray(b.column(0)), np.asarray(b.column(1))
            _, once = np.unique(np.stack([k1, k2]), axis=1, return_index=True)  # copies in a piece tell the same
            if len(once) < len(k1):
                b = b.take(pa.array(np.sort(once)))
                k1, k2 = np.asarray(b.column(0)), np.asarray(b.column(1))
            buf, s, e, first, h = _words(b.column(2))
            for k in sizes:
                g, at = X.shingles(h, first, k)
                ok = _bitmap.holds(bitmap, g)
                g, at = g[ok], at[ok]
                for lo in range(0, len(g), 20_000):
                    p = slice(lo, lo + 20_000)
                    doc = np.searchsorted(first, at[p], "right") - 1
                    begin = np.maximum(first[doc], at[p] - (window - k))
                    end = np.minimum(first[doc + 1], at[p] + window)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[doc]), pa.array(k2[doc]), pa.array(g[p].view(np.int64)), pa.array(at[p] - first[doc], pa.int32()), pa.array(first[doc + 1] - at[p], pa.int32()), pa.array(at[p] - begin, pa.int32()), _joined(buf, s, e, begin, end - begin).cast(pa.string())],
                        ["k1", "k2", "h", "pos", "left", "lead", "around"],
                    )

    return run


def _merge(batches):
    """Maximal runs of hit words, from a document's windows (start, n)."""
    for b in batches:
        found = b.column(2)
        own = np.repeat(np.arange(b.num_rows), found.value_lengths().to_numpy(zero_copy_only=False))
        start, n = (np.asarray(x) for x in found.flatten().flatten())
        order = np.lexsort((start, own))
        own, start, end = own[order], start[order].astype(np.int64), (start + n)[order].astype(np.int64)
        wide = (int(end.max()) + 1) if len(end) else 1
        reach = np.maximum.accumulate(own * wide + end)  # the farthest end so far, of the same document
        new = np.concatenate([[True], own[1:] * wide + start[1:] > reach[:-1]]) if len(own) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        lo, hi = start[at], reach[np.append(at[1:], len(own)).astype(np.int64) - 1] - own[at] * wide if len(at) else at
        runs = np.bincount(own[at], minlength=b.num_rows)
        spans = pa.ListArray.from_arrays(X.offsets_of(2 * runs), pa.array(np.stack([lo, hi], axis=1).reshape(-1), pa.int64()))
        hit = np.bincount(own[at], hi - lo, b.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), spans, b.column(3), pa.array(hit), b.column(4)], ["k1", "k2", "spans", "items", "n_hit", "size"])


_HITS = "k1 long, k2 long, spans array<long>, items array<string>, n_hit long, size int"


def _name(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def hits(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, shingle: int = 3, most_bits: int = _bitmap.MOST, text: str = "text") -> DataFrame:
    """(k1, k2, spans, items, n_hit, size) of the texts that hold a window, by the two hashes of ``_name``; size: their words."""
    spark = ship(docs.sparkSession)
    said = docs.select(F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    all_ = items.mapInArrow(_windows(window, shingle), "win string, n int, hashes array<long>, item string")
    all_ = cut(all_.groupBy("win").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"), F.collect_set("item").alias("items")), "windows")
    sizes = sorted({min(r.n, shingle) for r in all_.select("n").distinct().collect()})  # at most ``window`` lengths
    if not sizes:
        return spark.createDataFrame([], _HITS)
    shared = all_.select("win", F.posexplode("hashes").alias("off", "h"))
    known = cut(shared.select("h").distinct(), "shingles")
    bitmap = spark.sparkContext.broadcast(_bitmap.collect(known, _bitmap.bits_for(known.count(), most_bits)))
    counts = said.mapInArrow(_count(bitmap, sizes), "h long, n long").groupBy("h").agg(F.sum("n").alias("times"))
    # The rarest shingle, and of equal ones the smallest; a window with one that no document has is nowhere.
    rarest = shared.join(counts, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "h", "off")).alias("p")).where("p.times > 0")
    prefixes = cut(rarest.select("win", "p.h", "p.off").join(all_.drop("hashes"), "win"), "prefixes")
    chosen = cut(prefixes.select("h").distinct(), "chosen")
    screen = spark.sparkContext.broadcast(_bitmap.collect(chosen, _bitmap.bits_for(chosen.count(), most_bits)))
    met = said.select(*_name(F.col("text")), "text").mapInArrow(_meet(screen, sizes, window), _MET)
    pairs = met.join(prefixes, "h").where((F.col("pos") >= F.col("off")) & (F.col("left") >= F.col("n") - F.col("off")))
    # ``around`` and ``win`` end each word in a blank: what lies before the window is the words before it.
    before = F.col("lead") - F.col("off")
    words = F.length("around") - F.length(F.replace(F.col("around"), F.lit(" "), F.lit("")))
    here = F.when(before > 0, F.call_function("substring_index", F.col("around"), F.lit(" "), (before - words - 1).cast("int"))).otherwise(F.col("around"))
    pairs = pairs.where(F.startswith(here, F.col("win")))
    found = pairs.select("k1", "k2", (F.col("pos") - F.col("off")).alias("start"), "n", "items", (F.col("pos") + F.col("left")).alias("size"))
    spans = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.first("size").alias("size"))
    out = cut(spans.mapInArrow(_merge, _HITS), "hits")
    drop(all_, known, prefixes, chosen)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """``row`` (the kept columns) with n_words, spans, items, n_hit and n_items of each whole text.

    ``spans`` holds word positions start, end, start, end, ... of the maximal hit runs.
    """
    cols = docs.columns if keep is None else keep
    t = F.col(f"`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.coalesce(F.regexp_count(t, F.lit(_WORDS)), F.lit(0)).cast("long").alias("n_words"), *[F.when(t.isNotNull(), k).alias(k_) for k, k_ in zip(_name(t), ("k1", "k2"), strict=True)])
    both = rows.join(hits(docs, benchmark, text=text, **options), ["k1", "k2"], "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return both.select("row", "n_words", none("spans", "array<bigint>"), none("items", "array<string>"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"))


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents less those whose hit words are a twentieth of their words or more."""
    foul = hits(docs, benchmark, text=text, **options).where(20 * F.col("n_hit") >= F.col("size")).select("k1", "k2")
    t = F.col(f"`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.when(t.isNotNull(), k).alias(n) for k, n in zip(_name(t), ("k1", "k2"), strict=True)])
    return rows.join(foul, ["k1", "k2"], "left_anti").select("row.*")
