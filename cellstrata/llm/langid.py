"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1, drawn from its code point. An n-gram of
letters (runs of other characters count as one blank) is the product of its letters' vectors,
each rotated by its place; a text is the sum of its n-grams' vectors; a language's prototype is
the sum over all its training texts. A text gets the language whose prototype has the largest
cosine with it, and that cosine, no less than 0, as its score.

Training uses every training row: each partition adds up n-gram counts per language and sends
one vector per language, so what is gathered is languages times dimensions.

Defined results: null texts, texts without a letter and all texts when nothing was learned are
``und`` with score 0; a null language is not learned; equal cosines go to the language that
sorts first; rows are independent, so repeated rows repeat. A very long text is a piece of its own;
what a piece takes beyond its n-grams is a slice of vectors and one vector a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellstrata.llm import _text as X
from cellstrata.runtime import ship

DIMENSIONS = 1024
NGRAM = 3
SEED = 7
_PIECE = 1 << 20
_DENSE = 4_000_000
_GRAMS, _ROWS = 8192, 1024  # n-grams and texts of a slice of a bundle


class _Letters:
    """Lower-case code point of each letter, 0 for other characters; filled as characters turn up."""

    def __init__(self):
        self.table = np.full(0x110000, -1, dtype=np.int64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        out = self.table[code]
        new = np.unique(code[out < 0])
        if len(new):
            for c in new.tolist():
                low = chr(c).lower()
                self.table[c] = (ord(low) if len(low) == 1 else c) if chr(c).isalpha() else 0
            out = self.table[code]
        return out


class Space:
    """The vectors of letters and n-grams."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.letters = _Letters()
        self.own = np.zeros((64, dimensions), dtype=np.int8)  # letters' vectors in the order they turn up
        self.at = np.full(0x110000, -1, dtype=np.int32)
        self.known = 0

    def vectors(self, symbols: np.ndarray) -> np.ndarray:
        """One row per symbol: the vector drawn from its code point."""
        for s in np.unique(symbols[self.at[symbols] < 0]).tolist():
            if self.known == len(self.own):
                self.own = np.concatenate([self.own, np.zeros_like(self.own)])
            bits = np.random.default_rng([self.seed, s]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.own[self.known] = 2 * bits - 1
            self.at[s] = self.known
            self.known += 1
        return self.own[self.at[symbols]]

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """One row per n-gram, given as NGRAM symbols of 21 bits."""
        out = np.ones((len(codes), self.dimensions), dtype=np.int8)
        for place in range(NGRAM):
            symbol, back = np.unique((codes >> (21 * (NGRAM - 1 - place))) & 0x1FFFFF, return_inverse=True)
            out *= np.roll(self.vectors(symbol), NGRAM - 1 - place, axis=1)[back]
        return out.astype(np.float32)

    def counted(self, texts: pa.Array, group: np.ndarray, groups: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Distinct n-grams of some texts; (group of texts, n-gram, count) of what occurs; whether each text has a letter."""
        texts = texts.cast(pa.large_string())
        blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        buf, offs = X.flat(pc.binary_join_element_wise(blank, texts.fill_null(""), blank, none) if len(texts) else texts)
        code = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]
        symbol = self.letters(code)
        text = X.owner(first)
        has = np.bincount(text[symbol > 0], minlength=len(texts)) > 0
        stay = np.ones(len(symbol), dtype=bool)
        stay[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0) | (text[1:] != text[:-1])
        symbol, text = symbol[stay], text[stay]
        if len(symbol) < NGRAM:
            return np.zeros(0, np.int64), (np.zeros(0, np.int64),) * 3, has
        n = len(symbol) - NGRAM + 1
        ok = np.ones(n, dtype=bool)
        for j in range(NGRAM - 1):  # two blanks in a row are where texts meet
            ok &= (symbol[j : j + n] != 0) | (symbol[j + 1 : j + 1 + n] != 0)
        at = np.flatnonzero(ok)
        known, small = np.unique(symbol, return_inverse=True)
        if len(known) ** NGRAM <= _DENSE:
            gram = small[at]
            for j in range(1, NGRAM):
                gram = gram * len(known) + small[at + j]
            there = np.zeros(len(known) ** NGRAM, dtype=bool)
            there[gram] = True
            uniq = np.flatnonzero(there)
            back = (np.cumsum(there) - 1)[gram]
            codes, rest = np.zeros(len(uniq), np.int64), uniq
            for j in range(NGRAM):
                codes |= known[rest % len(known)] << (21 * j)
                rest = rest // len(known)
        else:
            code = symbol[at]
            for j in range(1, NGRAM):
                code = code << 21 | symbol[at + j]
            codes, back = np.unique(code, return_inverse=True)
        pair = group[text[at]] * len(codes) + back
        if groups * len(codes) <= _DENSE:
            many = np.bincount(pair)
            pair = np.flatnonzero(many)
            many = many[pair]
        else:
            pair, many = np.unique(pair, return_counts=True)
        return codes, (pair // len(codes), pair % len(codes), many), has

    def bundled(self, codes: np.ndarray, triples: tuple[np.ndarray, np.ndarray, np.ndarray], groups: int) -> np.ndarray:
        """The sums of n-gram vectors, a slice of n-grams and texts at a time; groups rise in ``triples``."""
        out = np.zeros((groups, self.dimensions), dtype=np.float64)
        order = np.argsort(triples[1] // _GRAMS, kind="stable")
        row, gram, many = (x[order] for x in triples)
        edge = np.searchsorted(gram // _GRAMS, np.arange(-(-len(codes) // _GRAMS) + 1))
        for i, (lo, hi) in enumerate(zip(edge, edge[1:], strict=False)):
            vectors = self.grams(codes[i * _GRAMS : (i + 1) * _GRAMS])
            at, size = gram[lo:hi] - i * _GRAMS, len(vectors)
            first = int(row[lo]) if hi > lo else groups
            for begin in range(first - first % _ROWS, groups, _ROWS):
                x, y = lo + np.searchsorted(row[lo:hi], [begin, begin + _ROWS])
                own, rows = row[x:y] - begin, min(_ROWS, groups - begin)
                if (y - x) * 16 >= rows * size:
                    counts = np.bincount(own * size + at[x - lo : y - lo], many[x:y], rows * size).reshape(rows, size)
                    out[begin : begin + rows] += counts.astype(np.float32) @ vectors
                    continue
                for s in range(0, y - x, _GRAMS):  # few of these texts have few of these n-grams
                    e = min(s + _GRAMS, y - x)
                    part = vectors[at[x - lo + s : x - lo + e]] * many[x + s : x + e, None].astype(np.float32)
                    lead = np.flatnonzero(np.diff(own[s:e], prepend=-1))
                    out[begin + own[s:e][lead]] += np.add.reduceat(part, lead, axis=0)
        return out


_spaces: dict[tuple[int, int], Space] = {}


def _space(dimensions: int, seed: int) -> Space:
    if (dimensions, seed) not in _spaces:
        _spaces[dimensions, seed] = Space(dimensions, seed)
    return _spaces[dimensions, seed]


def learn(docs: DataFrame, training: Column, *, dimensions: int = DIMENSIONS, seed: int = SEED, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, of length 1, from the rows that ``training`` holds for."""

    def run(batches):
        space = _space(dimensions, seed)
        total: dict[str, dict[int, int]] = {}
        sums: dict[str, np.ndarray] = {}

        def bundle():
            for name, own in total.items():
                codes = np.fromiter(own.keys(), np.int64, len(own))
                counts = np.fromiter(own.values(), np.int64, len(own))
                zero, each = np.zeros(len(own), np.int64), np.arange(len(own))
                # in parts of 11 bits: sums of 8192 products stay exact in float32
                for shift in range(0, int(counts.max()).bit_length(), 11):
                    vec = space.bundled(codes, (zero, each, (counts >> shift) & 0x7FF), 1)
                    sums[name] = sums.get(name, 0.0) + float(1 << shift) * vec[0]
            total.clear()

        for b in X.pieces(batches, "text", _PIECE):
            names, group = np.unique(np.array(b.column(1).to_pylist(), dtype=object), return_inverse=True)
            codes, (of, gram, many), _ = space.counted(b.column(0), group, len(names))
            edge = np.searchsorted(of, np.arange(len(names) + 1))
            for i, name in enumerate(names):
                own, p = total.setdefault(name, {}), slice(edge[i], edge[i + 1])
                for c, n in zip(codes[gram[p]].tolist(), many[p].tolist(), strict=True):
                    own[c] = own.get(c, 0) + n
            if sum(map(len, total.values())) > 1_000_000:
                bundle()
        bundle()
        for name, vec in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([vec], pa.list_(pa.float64()))], ["lang", "vec"])

    rows = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = rows.mapInArrow(run, "lang string, vec array<double>").select("lang", F.posexplode("vec").alias("i", "x"))
    by = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = sorted((r.lang, [p.x for p in r.v]) for r in by.collect())
    protos = np.array([v for _, v in found], dtype=np.float64).reshape(len(found), dimensions)
    norm = np.linalg.norm(protos, axis=1, keepdims=True)
    return [name for name, _ in found], protos / np.where(norm > 0, norm, 1)


def identify(docs: DataFrame, langs: list[str], protos: np.ndarray, *, dimensions: int = DIMENSIONS, seed: int = SEED, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns) with ``lang_pred`` and ``score`` of each whole text."""
    held = ship(docs.sparkSession).sparkContext.broadcast((langs, protos.astype(np.float32)))

    def run(batches):
        names, mat = held.value
        space = _space(dimensions, seed)
        labels = np.array([*names, "und"], dtype=object)
        for b in X.pieces(batches, "text", _PIECE):
            n = b.num_rows
            codes, triples, has = space.counted(b.column(1), np.arange(n), n)
            pick, score = np.full(n, len(names)), np.zeros(n)
            if len(names) and len(codes):
                vec = space.bundled(codes, triples, n)
                norm = np.linalg.norm(vec, axis=1)
                cos = vec @ mat.T.astype(np.float64) / np.where(norm > 0, norm, 1)[:, None]
                pick[has] = np.argmax(cos, axis=1)[has]
                score[has] = np.clip(cos.max(axis=1), 0, 1)[has]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels[pick], pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return X.annotate(docs, run, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep, text)
