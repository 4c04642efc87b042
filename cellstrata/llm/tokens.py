"""Token counts by rank-synchronous array merging.

Pre-tokens of a whole piece of texts are cut by character class in numpy, distinct ones
are held as ragged arrays of symbol ids, and every round merges the lowest-rank pair of
each sequence, in all sequences at once, until no sequence has a mergeable pair. What is
left of a sequence is its token count.

A merge's pair always ranks above the merges that built its parts, so merging all
occurrences of a sequence's lowest pair in one round equals merging them one by one;
overlapping occurrences (``aaa``) are taken from the left.

Defined results: null and empty texts have 0 bytes and 0 tokens; a special token's string
inside a text is one token, as the library has it by default, and what only arises across two
texts is none; a very long text is a piece of its own, held with its symbols by one task; rows
are independent, so repeated rows repeat and an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellstrata.llm import _text as X

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: Unicode's White_Space, which the pattern's \s means.
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_KNOWN_LIMIT = 2_000_000


def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
    out[_WHITE] = _SPACE
    return out


class Counter:
    """Counts tokens with the merges of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        added = spec["added_tokens"]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError(f"{path}: added tokens that take blanks or whole words")
        self.specials = sorted((t["content"] for t in added if t["content"]), key=len, reverse=True)
        # at the leftmost place the longest one
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        vocab = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        self.byte_id = np.array([vocab[stand_in[b]] for b in range(256)], dtype=np.int64)
        self.base = max(vocab.values()) + 1
        keys, made = [], []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            keys.append(vocab[a] * self.base + vocab[b])
            made.append(vocab[a + b])
        keys = np.array(keys, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array(made, dtype=np.int64)  # by rank
        # A small open-addressed table: most pairs are found or refused at one look.
        self.bits = 20
        self.slot = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot[self._slot(self.keys)] = np.arange(len(self.keys))
        self.known_hash, self.known_count = np.zeros(0, X.U64), np.zeros(0, np.int32)
        self.classes = _classes()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(X.U64) * X._M1) >> X.U64(64 - self.bits)).astype(np.int64)

    def _ranks(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number past all ranks."""
        none = len(self.keys)
        at = self.slot[self._slot(pairs)]
        hit = at >= 0
        out = np.full(len(pairs), none, dtype=np.int64)
        exact = hit & (self.keys[at] == pairs)
        out[exact] = self.rank[at[exact]]
        ask = np.flatnonzero(hit & ~exact)  # another key took the slot
        if len(ask):
            i = np.minimum(np.searchsorted(self.keys, pairs[ask]), none - 1)
            ok = self.keys[i] == pairs[ask]
            out[ask[ok]] = self.rank[i[ok]]
        return out

    def merged(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Symbols that survive in each byte run buf[s:e]."""
        count = (e - s).astype(np.int64)
        none = len(self.keys)
        live = np.flatnonzero(count > 1)
        size = count[live]
        first = np.concatenate([[0], np.cumsum(size)])
        sym = self.byte_id[buf[np.arange(first[-1]) - np.repeat(first[:-1] - s[live], size)]]
        while len(live):
            own = np.repeat(np.arange(len(live)), size)
            rank = np.full(len(sym), none, dtype=np.int64)
            rank[:-1] = self._ranks(sym[:-1] * self.base + sym[1:])
            rank[first[1:] - 1] = none  # a pair never crosses sequences
            least = np.minimum.reduceat(rank, first[:-1])
            go = least < none
            if not go.any():
                break
            pick = (rank == least[own]) & (rank < none)
            at = np.flatnonzero(pick)
            # In a run of touching picks (a a a), every other one from the left is taken.
            if len(at) > 1:
                new = np.concatenate([[True], np.diff(at) != 1])
                lead = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
                at = at[(at - lead) % 2 == 0]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            size = size - np.bincount(own[at], minlength=len(live))
            count[live] = size
            goes = go & (size > 1)
            stay &= goes[own]
            sym, live, size = sym[stay], live[goes], size[goes]
            first = np.concatenate([[0], np.cumsum(size)])
        return count

    def _cuts(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each character; first: the first character of each text."""
        n = len(code)
        kind = self.classes[code]
        begin = np.zeros(n + 1, dtype=bool)
        begin[first] = True
        begin = begin[:n]
        prev = np.empty(n, dtype=np.uint8)
        prev[1:] = kind[:-1]
        prev[:1] = 255
        change = begin | (kind != prev)
        start = change.copy()
        # Of a space run before other text, the last character stands apart: a blank joins what
        # follows, any other is a pre-token of its own.
        nxt = np.zeros(n, dtype=bool)
        nxt[:-1] = ~begin[1:]
        last_white = np.flatnonzero((kind == _SPACE) & nxt & np.concatenate([kind[1:] != _SPACE, [False]]))
        start[last_white] = True
        blank = last_white[code[last_white] == 32]
        start[blank + 1] = False
        # Contractions: an apostrophe alone, with no blank before it, takes a short ending.
        quote = np.flatnonzero((code == 39) & start)
        quote = quote[quote + 1 < n]
        quote = quote[~begin[quote + 1] & (kind[quote + 1] == _LETTER)]
        if len(quote):
            a = code[quote + 1]
            two = quote + 2 < n
            inside = two.copy()
            inside[two] &= ~begin[quote[two] + 2]
            b = np.where(inside, code[np.minimum(quote + 2, n - 1)], 0)
            one = np.isin(a, [115, 116, 109, 100])  # s t m d
            both = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # re ve ll
            for take, q in ((1, quote[one]), (2, quote[both])):
                start[q + 1] = False
                after = q + take + 1
                ok = after < n
                start[after[ok]] = True
        return start

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        buf, offs = X.flat(texts)
        raw = buf.tobytes()
        if any(t.encode() in raw for t in self.specials):  # in a text, or across two
            return np.diff(offs), self._with_specials(texts)
        return np.diff(offs), self._plain(buf, offs)

    def _plain(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text, special strings taken as any other text."""
        if not len(buf):
            return np.zeros(len(offs) - 1, dtype=np.int64)
        raw = buf.tobytes()
        lead = (buf & 0xC0) != 0x80
        at_byte = np.flatnonzero(lead)
        code = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = np.searchsorted(at_byte, offs)
        cut = np.flatnonzero(self._cuts(code, first[:-1][first[:-1] < len(code)]))
        s = at_byte[cut]
        e = np.concatenate([s[1:], [len(buf)]])
        h = X.hash_spans(buf, s, e)
        uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known_hash, uniq)
        at[at == len(self.known_hash)] = 0
        seen = self.known_hash[at] == uniq if len(self.known_hash) else np.zeros(len(uniq), bool)
        n = np.zeros(len(uniq), dtype=np.int64)
        n[seen] = self.known_count[at[seen]]
        new = np.flatnonzero(~seen)
        if len(new):
            n[new] = self.merged(buf, s[where[new]], e[where[new]])
            if len(self.known_hash) + len(new) > _KNOWN_LIMIT:  # only a cache: start afresh
                self.known_hash, self.known_count = uniq, n.astype(np.int32)
            else:
                joined = np.concatenate([self.known_hash, uniq[new]])
                order = np.argsort(joined, kind="stable")
                self.known_hash, self.known_count = joined[order], np.concatenate([self.known_count, n[new].astype(np.int32)])[order]
        total = np.concatenate([[0], np.cumsum(n[back])])
        bound = np.searchsorted(cut, first)
        return total[bound[1:]] - total[bound[:-1]]

    def _with_specials(self, texts: pa.Array) -> np.ndarray:
        """Texts are cut at special strings, the leftmost and then longest first, each one token."""
        out = np.zeros(len(texts), dtype=np.int64)
        parts, own = [], []

        def count():
            np.add.at(out, np.array(own, dtype=np.int64), self._plain(*X.flat(pa.array(parts, pa.large_string()))))
            parts.clear()
            own.clear()

        for i, t in enumerate(texts.to_pylist()):
            at = 0
            for hit in self.special.finditer(t or ""):
                parts.append(t[at : hit.start()])
                own.append(i)
                out[i] += 1
                at = hit.end()
                if len(parts) >= 50_000:
                    count()
            parts.append((t or "")[at:])
            own.append(i)
        count()
        return out


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns) with ``n_bytes`` and ``n_tokens`` of each whole text.

    ``vocabulary`` is a path that every machine has, or a name of the installed vocabulary package.
    """

    def run(batches):
        counter = _counter(_vocabulary(vocabulary))
        for b in X.pieces(batches):
            n_bytes, n = counter.counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64())], ["row", "n_bytes", "n_tokens"])

    return X.annotate(docs, run, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())], keep, text)


def _vocabulary(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))
