"""Suffix-array dedup: a byte goes if a string of ``length`` bytes over it also starts in a document of smaller id.

*Suffix sort.* Suffixes are compared by their longest common extension, found by binary search
over prefix polynomial hashes, so a comparison takes log(length) steps; a merge sort orders them,
all groups and all runs of a level at once, each suffix finding its rank in the run beside its
own. Neighbours that agree in ``length`` bytes are one string; they are compared byte by byte
before that counts, so a hash collision can't remove anything.

*Which suffixes meet.* Every window of ``length`` bytes has an anchor, the ``gram`` bytes in it of
smallest hash (a minimizer), so equal windows have equal anchors at equal places. Anchors of one
document alone can't match; the other windows are cut out as snippets around their anchors, and
snippets of one anchor are sorted together, window by window.

*Volume and skew.* Documents equal as a whole are settled first. Anchors travel as packed sorted
arrays, one entry per task's chunk and anchor however many documents have it. Equal snippets of a
chunk are settled there, and only the one of smallest id goes on. What is still found over
``often`` times is settled by an aggregate that combines before its shuffle. An anchor of more than
``hot`` documents has its windows dealt by their own content, so no group holds what all those
documents say. Texts are written once, bucketed by row, and later passes join them where they lie.

Defined results: null texts are empty; rows without an id match nothing and lose nothing; rows that
share an id don't match each other; texts shorter than ``length`` lose nothing; overlapping matches
count, and matches are judged on the input; a very long text is a piece of its own; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellstrata.llm import _text as X
from cellstrata.runtime import at_exit, cut, drop, scratch_dir, ship

LENGTH, GRAM, HOT, OFTEN = 50, 24, 20_000, 1000
_CHUNK = 500_000  # anchors of a chunk
_GROUP = 500_000  # anchors of a reduce group
_SNIPPETS = 50_000  # snippets of a reduce group
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = X.U64(0xD1342543DE82EF95)
_SPREAD = X.U64(0x9E3779B97F4A7C15)


def _power(base: np.uint64, n: int) -> np.uint64:
    return X.U64(pow(int(base), n, 1 << 64))


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-byte strings, by doubling."""
    h, size, out, done = _TABLE[buf], 1, None, 0
    n = len(buf) - k + 1
    rest = k
    while rest:
        if rest & 1:
            part = h[done : done + n]
            out = part if out is None else out * _power(_BASE, size) + part
            done += size
        rest >>= 1
        if rest:
            h = h[:-size] * _power(_BASE, size) + h[size:]
            size *= 2
    return out * _SPREAD


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: first window, windows, anchor's place, anchor's hash, text."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none.astype(X.U64), none
    h = gram_hashes(buf, gram)
    bits = X.U64(max(1, int(len(h)).bit_length()))
    # the smallest hash, and of equal ones the leftmost, in one number
    least = (h >> bits << bits) | np.arange(len(h), dtype=X.U64)
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: size - width], least[width - size :])
    doc = X.owner(offs)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= offs[1:][doc])
    place = (least[start] & ((X.U64(1) << bits) - X.U64(1))).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(start)))
    return start[at], count, place[at], h[place[at]], doc[start[at]]


class Suffixes:
    """Common extensions of the suffixes of a buffer, up to ``length``."""

    def __init__(self, buf: np.ndarray, length: int):
        self.buf, self.length = np.concatenate([buf, np.zeros(length + 8, np.uint8)]), length
        n = len(self.buf)
        power = np.full(n + 1, _BASE, dtype=X.U64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        self.prefix = np.concatenate([np.zeros(1, X.U64), np.cumsum(_TABLE[self.buf] * self.power[:n], dtype=X.U64)])
        self.lead = np.ndarray((n - 7,), dtype=">u8", buffer=self.buf, strides=(1,))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension by binary search: are the first m bytes equal, by their hashes?"""
        got = np.zeros(len(i), dtype=np.int64)
        step = 1 << (self.length.bit_length() - 1)
        pi, pj = self.power[i], self.power[j]
        si, sj = self.prefix[i], self.prefix[j]
        while step:
            m = got + step
            ok = (m <= self.length) & ((self.prefix[np.minimum(i + m, len(self.prefix) - 1)] - si) * pj == (self.prefix[np.minimum(j + m, len(self.prefix) - 1)] - sj) * pi)
            got[ok] += step
            step >>= 1
        return got

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before j, or equals it where that is asked."""
        a, b = self.lead[i], self.lead[j]
        out = a < b
        tie = np.flatnonzero(a == b)
        if len(tie):
            i, j = i[tie], j[tie]
            m = self.common(i, j)
            end = m >= self.length
            out[tie] = np.where(end, or_equal[tie], self.buf[i + m] < self.buf[j + m])
        return out

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of the suffixes within each run of equal ``group``: a merge sort from the bottom up."""
        order = np.arange(len(at))
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(at)))
        width = 1
        while width < size.max(initial=0):
            live = size > width
            lo, n = first[live], size[live]
            base = np.repeat(lo, n)
            t = np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
            total = np.repeat(n, n)
            run = t // width
            own = run * width
            left = np.minimum((run ^ 1) * width, total)
            right = np.minimum(left + width, total)
            pair = (run & ~1) * width
            me = at[order[base + t]]
            # the rank in the run beside: how many of it come before; equal ones of the left run do
            a, b = left.copy(), right.copy()
            later = (run & 1).astype(bool)
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) // 2
                before = self.less(at[order[base[open_] + mid]], me[open_], later[open_])
                a[open_] = np.where(before, mid + 1, a[open_])
                b[open_] = np.where(before, b[open_], mid)
            merged = order.copy()
            merged[base + pair + (t - own) + (a - left)] = order[base + t]
            order = merged
            width *= 2
        return order

    def classes(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted order and, by place in it, the number of the string of ``length`` bytes; equal ones are verified."""
        order = self.sort(at, group)
        same = np.zeros(len(at), dtype=bool)
        if len(at) > 1:
            i, j = at[order[:-1]], at[order[1:]]
            near = np.flatnonzero((group[1:] == group[:-1]) & (self.lead[i] == self.lead[j]))
            near = near[self.common(i[near], j[near]) >= self.length]
            ok = X.same_spans(self.buf, i[near], self.buf, j[near], np.full(len(near), self.length))
            same[near[ok] + 1] = True
        return order, np.cumsum(~same) - 1


def _find_anchors(length: int, gram: int, buckets: int):
    """Of each chunk: per bucket its anchors as (remainder, row) and, of those in several rows, (remainder, rows);
    and at once the (row, anchor) of the latter."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def told():
            x = np.concatenate([h[0] for h in held])
            kid = np.concatenate([h[1] for h in held])
            order = np.lexsort((kid, x))
            x, kid = x[order], kid[order]
            new = np.ones(len(x), dtype=bool)
            new[1:] = (x[1:] != x[:-1]) | (kid[1:] != kid[:-1])
            x, kid = x[new], kid[new]
            lead = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            many = np.diff(np.append(lead, len(x)))
            shared = np.repeat(many > 1, many)
            kids, index = np.unique(kid, return_inverse=True)
            one_x, one_k = x[~shared], index[~shared].astype(np.uint32)
            more_x, more_n = x[lead[many > 1]], many[many > 1].astype(np.uint32)
            cut1 = np.searchsorted(X.bucket_of(one_x, buckets), np.arange(buckets + 1))
            cut2 = np.searchsorted(X.bucket_of(more_x, buckets), np.arange(buckets + 1))
            low = lambda v: (v & X.U64(0xFFFFFFFF)).astype(np.uint32)
            rows = []
            for b in np.flatnonzero((np.diff(cut1) > 0) | (np.diff(cut2) > 0)).tolist():
                p, q = slice(cut1[b], cut1[b + 1]), slice(cut2[b], cut2[b + 1])
                own = np.unique(one_k[p])
                slot = np.searchsorted(own, one_k[p]).astype(np.uint32)
                rows.append((b, X.pack(np.diff(kids[own], prepend=0), low(one_x[p]), slot, low(more_x[q]), more_n[q])))
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["bucket", "packed", "kid", "x"])
            sx, sk = x[shared], kid[shared]
            for at in range(0, len(sx), 1 << 18):
                p = slice(at, at + (1 << 18))
                n = len(sx[p])
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(sk[p]), pa.array(sx[p].view(np.int64))], ["bucket", "packed", "kid", "x"])

        for b in X.pieces(batches):
            buf, offs = X.flat(b.column(1))
            _, _, _, x, doc = anchors(buf, offs, length, gram)
            held.append((x, np.asarray(b.column(0))[doc]))
            size += len(x)
            if size >= _CHUNK:
                yield from told()
                held, size = [], 0
        if size:
            yield from told()

    return run


def _share(buckets: int, hot: int):
    """Anchors of a bucket in rows of several chunks, or in several of a chunk: (row, anchor) of the lone ones; and the hot ones."""

    def run(key, table):
        bucket = key[0].as_py()
        low, kid, many_low, many_n = [], [], [], []
        for data in table.column("packed").to_pylist():
            kids, one, slot, more, n = X.unpack(data, np.int64, np.uint32, np.uint32, np.uint32, np.uint32)
            low.append(one)
            kid.append(np.cumsum(kids)[slot])
            many_low.append(more)
            many_n.append(n)
        low, kid, many_low, many_n = (np.concatenate(v) for v in (low, kid, many_low, many_n))
        every = np.concatenate([low, many_low])
        value, back = np.unique(every, return_inverse=True)
        count = np.bincount(back, np.concatenate([np.ones(len(low)), many_n]), len(value)).astype(np.int64)
        shared = (count > 1)[back[: len(low)]]
        # the anchor's upper half is its bucket and what the bucket leaves open: the remainder alone names it here
        hot_low = value[count > hot]
        n, m = int(shared.sum()), len(hot_low)
        return pa.table(
            {
                "bucket": pa.array(np.full(n + m, bucket), pa.int32()),
                "kid": pa.concat_arrays([pa.array(kid[shared], pa.int64()), pa.nulls(m, pa.int64())]),
                "low": pa.array(np.concatenate([low[shared], hot_low]).astype(np.int64)),
            }
        )

    return run


_SNIPPET = "bucket int, x long, doc_id long, kid long, a int, off int, bytes binary"


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The names in a column of lists, and each one's row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy(zero_copy_only=False).view(X.U64)


def _among(known: tuple[np.ndarray, np.ndarray], row: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether each (row, name) is among the known ones."""
    tag = lambda o, v: X.mix(v ^ X.mix(o.astype(X.U64) + X.U64(1)))
    held = np.sort(tag(*known))
    if not len(held):
        return np.zeros(len(name), dtype=bool)
    ask = tag(row, name)
    return held[np.minimum(np.searchsorted(held, ask), len(held) - 1)] == ask


def _cut_snippets(length: int, gram: int, buckets: int, groups: int):
    """Snippets around the shared anchors of each row; what equal ones of the chunk settle comes as spans (kid, a, e)."""
    names = ["bucket", "x", "doc_id", "kid", "a", "off", "bytes", "e"]

    def run(batches):
        for b in X.pieces(batches):
            kid, doc_id, text = (b.column(i) for i in range(3))
            buf, offs = X.flat(text)
            start, count, place, x, doc = anchors(buf, offs, length, gram)
            name = X.bucket_of(x, buckets).astype(X.U64) << X.U64(32) | (x & X.U64(0xFFFFFFFF))
            ok = _among(_listed(b.column(3)), doc, name)
            start, count, place, x, doc, name = start[ok], count[ok], place[ok], x[ok], doc[ok], name[ok]
            off = place - start
            often = _among(_listed(b.column(4)), doc, name)
            if often.any():  # the windows of hot anchors go by their own content
                n = count[often]
                s = np.repeat(start[often], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = X.mix(X.hash_spans(buf, s, s + length) ^ X.U64(0x243F6A8885A308D3))
                start, x, doc = np.concatenate([start[~often], s]), np.concatenate([x[~often], own]), np.concatenate([doc[~often], np.repeat(doc[often], n)])
                off, count = np.concatenate([off[~often], np.zeros(len(s), np.int64)]), np.concatenate([count[~often], np.ones(len(s), np.int64)])
            end = start + count - 1 + length
            ids, kids = np.asarray(doc_id)[doc], np.asarray(kid)[doc]
            # equal snippets of several documents: only the smallest id goes on, the others are settled
            h = X.hash_spans(buf, start, end)
            order = np.lexsort((ids, h))
            h, start, end, x, off, ids, kids, doc = (v[order] for v in (h, start, end, x, off, ids, kids, doc))
            lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            least = np.repeat(lead, np.diff(np.append(lead, len(h))))
            gone = ids > ids[least]
            gone &= (end - start == end[least] - start[least]) & X.same_spans(buf, start, buf, start[least], end - start)
            place0 = start - offs[doc]
            goes = np.flatnonzero(~gone)
            bytes_ = _slices(buf, start[goes], end[goes])
            n = len(goes)
            yield pa.RecordBatch.from_arrays(
                [pa.array((X.mix(x[goes]) % X.U64(groups)).astype(np.int32)), pa.array(x[goes].view(np.int64)), pa.array(ids[goes]), pa.array(kids[goes]), pa.array(place0[goes], pa.int32()), pa.array(off[goes], pa.int32()), bytes_, pa.nulls(n, pa.int32())], names
            )
            done = np.flatnonzero(gone)
            n = len(done)
            if n:
                none = pa.nulls
                yield pa.RecordBatch.from_arrays([none(n, pa.int32()), none(n, pa.int64()), none(n, pa.int64()), pa.array(kids[done]), pa.array(place0[done], pa.int32()), none(n, pa.int32()), none(n, pa.binary()), pa.array((place0 + end - start)[done], pa.int32())], names)

    return run


def _slices(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    size = e - s
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - s, size)] if len(s) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _sort_snippets(length: int):
    """Suffix sort of a group of anchors: (kid, a, e) of the windows that a smaller document has too."""

    def run(key, table):
        get = lambda c: table.column(c).to_numpy()
        x, ids, kid, a, off = get("x").view(X.U64), get("doc_id"), get("kid"), get("a").astype(np.int64), get("off").astype(np.int64)
        buf, offs = X.flat(table.column("bytes"))
        size = np.diff(offs)
        # one snippet of each content; what it says of windows holds for all rows of its smallest id
        h = X.mix(X.hash_spans(buf, offs[:-1], offs[1:]) ^ X.mix(x * X.U64(64) + off.astype(X.U64)))
        order = np.lexsort((ids, h))
        lead = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        rep = np.empty(len(h), np.int64)
        rep[order] = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]
        equal = (size == size[rep]) & (x == x[rep]) & (off == off[rep])
        equal &= X.same_spans(buf, offs[:-1], buf, offs[rep], size)
        rep = np.where(equal, rep, np.arange(len(h)))
        whole = ids > ids[rep]
        kept = np.flatnonzero(rep == np.arange(len(h)))
        # only anchors with several contents are left to compare
        _, back, times = np.unique(x[kept], return_inverse=True, return_counts=True)
        kept = kept[times[back] > 1]
        n = size[kept] - length + 1
        snippet = np.repeat(kept, n)
        step = np.arange(len(snippet)) - np.repeat(np.cumsum(n) - n, n)
        at = offs[snippet] + step
        rel = off[snippet] - step  # where the anchor lies in the window
        group = X.mix(x[snippet] * X.U64(64) + rel.astype(X.U64))
        by = np.argsort(group, kind="stable")
        dup = np.zeros(len(snippet), dtype=bool)
        if len(by):
            order, string = Suffixes(buf, length).classes(at[by], group[by])
            own = ids[snippet[by[order]]]
            least = np.minimum.reduceat(own, np.flatnonzero(np.concatenate([[True], string[1:] != string[:-1]])))
            dup[by[order]] = own > least[string]
        # runs of such windows, per snippet
        edge = np.ones(len(dup) + 1, dtype=bool)
        edge[1:-1] = (snippet[1:] != snippet[:-1]) | (dup[1:] != dup[:-1])
        first = np.flatnonzero(edge)[:-1]
        last = np.append(first[1:], len(dup)) - 1
        some = dup[first] if len(dup) else np.zeros(0, bool)
        first, last = first[some], last[some]
        run_of, lo, hi = snippet[first], step[first], step[last] + length
        # every row with the representative's content and id gets its runs
        rows = np.flatnonzero(~whole)
        rows = rows[np.argsort(rep[rows], kind="stable")]
        i, j = np.searchsorted(rep[rows], run_of, "left"), np.searchsorted(rep[rows], run_of, "right")
        many = j - i
        who = rows[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(i, many)] if len(many) else np.zeros(0, np.int64)
        lo, hi = np.repeat(lo, many), np.repeat(hi, many)
        all_ = np.flatnonzero(whole)
        return pa.table(
            {
                "kid": pa.array(np.concatenate([kid[who], kid[all_]]), pa.int64()),
                "a": pa.array(np.concatenate([a[who] + lo, a[all_]]), pa.int32()),
                "e": pa.array(np.concatenate([a[who] + hi, a[all_] + size[all_]]), pa.int32()),
            }
        )

    return run


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; touching ones are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _finish(length: int):
    def run(batches):
        for b in X.pieces(batches):
            texts, copy = b.column(1), b.column(2).to_pylist()
            starts, ends = b.column(3).to_pylist(), b.column(4).to_pylist()
            buf, offs = X.flat(texts)
            raw = buf.tobytes()
            out = []
            for i in range(b.num_rows):
                body = raw[offs[i] : offs[i + 1]]
                spans = [(0, len(body))] if copy[i] and len(body) >= length else union_spans(list(zip(starts[i] or [], ends[i] or [], strict=True)))
                kept, at = [], 0
                for s, e in spans:
                    kept.append(body[at:s])
                    at = e
                kept.append(body[at:])
                out.append((len(body), sum(e - s for s, e in spans), [p for s in spans for p in s], b"".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.binary()), pa.array([hashlib.sha256(o[3]).hexdigest() for o in out])],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
            )

    return run


def _settle(snippets: DataFrame, often: int) -> tuple[DataFrame, DataFrame]:
    """Of contents found over ``often`` times only the rows of the smallest id go on; the others' spans are settled."""
    content = ["bucket", "x", "off", "bytes"]
    keyed = snippets.withColumn("h", F.xxhash64(*content))
    many = cut(keyed.groupBy("h").agg(F.count("*").alias("times")).where(F.col("times") > often).select("h"), "suffix-often")
    if many.isEmpty():
        return snippets.select("kid", "a", F.lit(0).alias("e")).limit(0), snippets
    held = keyed.join(many, "h", "left_semi").drop("h")
    first = cut(held.groupBy(*content).agg(F.min("doc_id").alias("first")), "suffix-first")
    both = held.join(first, content)
    end = (F.col("a") + F.octet_length("bytes")).cast("int").alias("e")
    going = keyed.join(many, "h", "left_anti").drop("h").unionByName(both.where("doc_id = first").select(*snippets.columns))
    return both.where("doc_id > first").select("kid", "a", end), going


def dedup(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, often: int = OFTEN, text: str = "text", with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, kept_sha256) of every row; ``spans`` holds start, end, start, end, ..."""
    spark = ship(docs.sparkSession)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.monotonically_increasing_id().alias("kid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    name = f"texts_{uuid.uuid4().hex}"
    writer = rows.repartition(parts, "kid").write.format("parquet").option("compression", "zstd").bucketBy(parts, "kid").sortBy("kid")
    path = f"{scratch_dir(spark).rstrip('/')}/{name}"
    writer.option("path", path).saveAsTable(name)
    at_exit(spark, path)
    drop()
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the files stay: the plan has them and their buckets
    able = table.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    seen = cut(able.select("kid", "doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("n")), "suffix-texts")
    total = seen.agg(F.sum("n")).first()[0] or 0
    least = cut(seen.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1"), "suffix-copied")
    copies = cut(seen.join(least, "h").where("doc_id > first").select("kid"), "suffix-copies")
    drop(seen, least)
    buckets = max(parts, total // (13 * _GROUP))
    live = able.join(copies, "kid", "left_anti").select("kid", "text")
    found = cut(live.mapInArrow(_find_anchors(length, gram, buckets), "bucket int, packed binary, kid long, x long"), "suffix-anchors")
    share = found.where("packed is not null").select("bucket", "packed").groupBy("bucket").applyInArrow(_share(buckets, hot), "bucket int, kid long, low long")
    share = cut(share, "suffix-shared")
    name_of = F.col("bucket").cast("long") * (1 << 32) + F.col("low")
    hot_names = cut(share.where("kid is null").select(name_of.alias("name"), F.lit(True).alias("hot")), "suffix-hot")
    named = share.where("kid is not null").select("kid", name_of.alias("name"))
    high = F.shiftrightunsigned("x", 32)  # the bucket of an anchor, as bucket_of has it
    local = found.where("packed is null").select("kid", (F.shiftrightunsigned(high * buckets, 32) * (1 << 32) + F.col("x").bitwiseAND(F.lit(0xFFFFFFFF))).alias("name"))
    flagged = named.unionByName(local).join(hot_names, "name", "left")
    lists = flagged.groupBy("kid").agg(F.collect_set("name").alias("names"), F.collect_set(F.when(F.col("hot"), F.col("name"))).alias("often"), F.count("*").alias("times"))
    lists = cut(lists, "suffix-lists")
    drop(found, share, hot_names)
    occurrences = lists.agg(F.sum("times")).first()[0] or 0
    groups = max(parts, int(occurrences) // _SNIPPETS)
    cutting = able.join(lists, "kid").select("kid", "doc_id", "text", "names", "often")
    snippets = cut(cutting.mapInArrow(_cut_snippets(length, gram, buckets, groups), f"{_SNIPPET}, e int"), "suffix-snippets")
    drop(lists)
    settled, going = _settle(snippets.where("bytes is not null").drop("e"), often)
    sorted_ = going.groupBy("bucket").applyInArrow(_sort_snippets(length), "kid long, a int, e int")
    spans = sorted_.unionByName(settled).unionByName(snippets.where("bytes is null").select("kid", "a", "e"))
    spans = spans.groupBy("kid").agg(F.collect_list(F.struct("a", "e")).alias("s"))
    marks = spans.join(copies.withColumn("copy", F.lit(True)), "kid", "full")
    marks = marks.select("kid", F.coalesce("copy", F.lit(False)).alias("copy"), F.col("s.a").alias("a"), F.col("s.e").alias("e"))
    last = table.join(marks, "kid", "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "a", "e")
    done = last.mapInArrow(_finish(length), "doc_id long, n_bytes long, n_removed long, spans array<long>, kept binary, kept_sha256 string")
    return done if with_kept else done.drop("kept")
