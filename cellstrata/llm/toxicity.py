"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores sigmoid(bias + weights of its distinct
words and word stems, the first 3 to 6 bytes), and the document is toxic unless every sentence is clean: 1 - prod(1 - s), the
noisy-or. Weights are fitted to document labels alone; sentence scores then locate the
offending sentences.

The fit takes a bounded sample of the labelled documents: of each class those of smallest
hash of their id, at most ``per_class`` of them and, but for the first, ``class_bytes`` of
text, weighted back to the classes' shares of all labelled documents, in one task. Labels
without a document count for nothing. Every feature of ``least_docs`` sampled documents is
kept whose likelihood ratio with the label is ``least_z`` deviations or more; how many those
are is bounded by the sample alone. Scoring covers every text, a piece at a time.

Defined results: a text without words (null and empty too) has no sentence that could
offend and scores 0; without labels of both classes everything scores 0; documents with
several labels count as often; null labels are not learned; repeated rows repeat; a very long
text is a piece of its own.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellstrata.llm import _text as X
from cellstrata.llm.decontaminate import WORD
from cellstrata.runtime import cut, ship

PER_CLASS, CLASS_BYTES = 4000, 64 << 20
LEAST_DOCS, LEAST_Z = 3, 4.5
STEMS = (3, 4, 5, 6)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 33, 46, 63]] = True  # line end ! . ?


@dataclass
class Model:
    words: np.ndarray  # hashes, sorted
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.screen = np.zeros(1 << 16, dtype=bool)
        self.screen[(self.words >> X.U64(48)).astype(np.int64)] = True


def _lower(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case."""
    low = X.LOWER[buf]
    low[1:][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)] += 0x20
    return low


def _sentences(texts: pa.Array):
    """Text offsets, words' starts and ends, each word's sentence, each text's first sentence; features and their sentences."""
    buf, offs = X.flat(texts)
    low = _lower(buf)
    s, e, first = X.spans(low, offs, WORD)
    raw = np.cumsum(_BREAK[buf])[s] if len(s) else np.zeros(0, np.int64)
    new = np.ones(len(s), dtype=bool)
    new[1:] = raw[1:] != raw[:-1]
    new[first[:-1][first[:-1] < len(s)]] = True
    sentence = np.cumsum(new) - 1
    count = int(sentence[-1]) + 1 if len(s) else 0
    bound = np.concatenate([sentence, [count]])[first]
    hashes, where = [X.hash_spans(low, s, e)], [sentence]
    for k in STEMS:
        at = np.flatnonzero(e - s > k)
        hashes.append(X.hash_spans(low, s[at], s[at] + k))
        where.append(sentence[at])
    return offs, s, e, sentence, bound, np.concatenate(hashes), np.concatenate(where)


def softplus(z):
    return np.logaddexp(0.0, z)


def sentence_scores(model: Model, texts: pa.Array):
    """Logits of all sentences, each text's first sentence, and sentences' byte ranges within their texts."""
    offs, s, e, sentence, bound, h, where = _sentences(texts)
    z = np.full(int(bound[-1]), model.bias)
    if len(model.words) and len(h):
        may = np.flatnonzero(model.screen[(h >> X.U64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(model.words, h[may]), len(model.words) - 1)
        ok = model.words[at] == h[may]
        pair = np.unique(where[may[ok]] * len(model.words) + at[ok])  # a feature counts once in a sentence
        np.add.at(z, pair // len(model.words), model.weights[pair % len(model.words)])
    begin = np.flatnonzero(np.diff(np.concatenate([[-1], sentence])))
    last = np.append(begin[1:], len(s))[: len(begin)] - 1
    doc = X.owner(bound)
    return z, bound, s[begin] - offs[doc], e[last] - offs[doc]


def noisy_or(z: np.ndarray, bound: np.ndarray) -> np.ndarray:
    keep = np.concatenate([[0.0], np.cumsum(-softplus(z))])
    return -np.expm1(np.minimum(0.0, keep[bound[1:]] - keep[bound[:-1]]))


def choose(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z) -> tuple[np.ndarray, np.ndarray]:
    """Features that go with the label, sorted, and their log odds; pos, neg: each document's distinct features."""
    vocab, inside = np.unique(np.concatenate([pos, neg]), return_counts=True)
    vocab = vocab[inside >= least_docs]
    told = lambda v: np.searchsorted(v, vocab, "right") - np.searchsorted(v, vocab, "left")
    pos, neg = told(np.sort(pos)), told(np.sort(neg))
    odds = np.log((pos + 0.5) / (n_pos - pos + 0.5)) - np.log((neg + 0.5) / (n_neg - neg + 0.5))
    # the likelihood ratio that a feature and the label go together, as a number of deviations
    part = lambda seen, due: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(due, 1e-9)), 0.0)
    has, n = pos + neg, n_pos + n_neg
    z = np.sqrt(np.maximum(0, 2 * (part(pos, has * n_pos / n) + part(neg, has * n_neg / n) + part(n_pos - pos, (n - has) * n_pos / n) + part(n_neg - neg, (n - has) * n_neg / n))))
    chosen = np.flatnonzero(z > least_z)
    return vocab[chosen], odds[chosen]


def fit(words: np.ndarray, odds: np.ndarray, sent: np.ndarray, feat: np.ndarray, doc_of: np.ndarray, label: np.ndarray, prior: float, rounds: int = 400) -> Model:
    """words, odds: as chosen; sent, feat: each sentence's distinct features; doc_of: by sentence; label: by document;
    prior: share of label 1 among all."""
    n_pos, n_neg = int(label.sum()), int((1 - label).sum())
    weight = np.where(label == 1, prior / n_pos, (1 - prior) / n_neg)
    theta = np.concatenate([np.clip(odds, -4, 4), [-7.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    docs, n_sent = len(label), len(doc_of)
    for t in range(1, rounds + 1):
        z = np.bincount(sent, theta[feat], n_sent) + theta[-1]
        clean = np.bincount(doc_of, -softplus(z), docs)  # log of the chance that no sentence offends
        p = np.clip(-np.expm1(clean), 1e-9, 1.0)
        out = np.where(label == 1, -(1 - p) / p, 1.0) * weight
        g = out[doc_of] / (1 + np.exp(-z))
        grad = np.concatenate([np.bincount(feat, g[sent], len(words)), [g.sum()]])
        grad[:-1] += 1e-5 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(words, theta[:-1], float(theta[-1]))


def fit_texts(parts: list[tuple[pa.Array, np.ndarray]], prior: float, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z) -> Model:
    """The model of some texts and their labels. Features are made twice, so that only the chosen ones are kept."""
    label = np.concatenate([y for _, y in parts])
    if not label.any() or label.all():
        return nothing()
    seen: tuple[list, list] = ([], [])
    for texts, y in parts:
        _, _, _, _, bound, h, sent = _sentences(texts)
        doc = X.owner(bound)[sent]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        for k in (0, 1):
            seen[k].append(h[new & (y[doc] == k)])
    words, odds = choose(np.concatenate(seen[1]), np.concatenate(seen[0]), int(label.sum()), int((1 - label).sum()), least_docs, least_z)
    del seen
    if not len(words):
        return nothing()
    sents, feats, docs_of, n_sent, n_doc = [], [], [], 0, 0
    for texts, y in parts:
        _, _, _, _, bound, h, sent = _sentences(texts)
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        ok = words[at] == h
        pair = np.unique(sent[ok] * len(words) + at[ok])
        sents.append(pair // len(words) + n_sent)
        feats.append(pair % len(words))
        docs_of.append(X.owner(bound) + n_doc)
        n_sent += int(bound[-1])
        n_doc += len(y)
    return fit(words, odds, *(np.concatenate(v) for v in (sents, feats, docs_of)), label, prior)


def nothing() -> Model:
    return Model(np.zeros(0, X.U64), np.zeros(0), float("-inf"))


def learn(
    docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z, text: str = "text"
) -> Model:
    """Fits to ``labels`` (doc_id, toxic 0 or 1) of ``docs``."""
    ship(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    held = docs.groupBy("doc_id").agg(F.sum(F.octet_length(text)).cast("long").alias("bytes"), F.count("*").alias("rows"))
    known = cut(known.join(held, "doc_id"), "labelled")
    share = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.sum("rows").alias("n")).collect()}
    if len(share) < 2:
        return nothing()
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = Window.partitionBy("toxic").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    one = lambda y: known.where(F.col("toxic") == y).orderBy(*by).limit(per_class)
    sample = one(0).unionByName(one(1)).withColumn("before", F.coalesce(F.sum("bytes").over(first), F.lit(0)))
    sample = sample.withColumn("nth", F.row_number().over(Window.partitionBy("toxic").orderBy(*by)))
    sample = sample.where((F.col("nth") == 1) | (F.col("before") + F.coalesce("bytes", F.lit(0)) <= class_bytes)).select("doc_id", "toxic")
    # at most 2 * per_class rows of 12 bytes
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").repartition(1).sortWithinPartitions("doc_id", "toxic", "text")
    prior = share[1] / sum(share.values())

    def run(batches):  # in a fixed order, so that a fit repeats to the last bit
        parts = [(b.column(0), np.array(b.column(1))) for b in X.pieces(batches)]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_texts(parts, prior, least_docs, least_z))], pa.binary())], ["model"])

    found = rows.select("text", "toxic").mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else nothing()


_FIELDS = [
    T.StructField("score", T.DoubleType()),
    T.StructField("offending", T.ArrayType(T.LongType())),
    T.StructField("sentence_scores", T.ArrayType(T.DoubleType())),
]


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, locate: float = 0.5) -> DataFrame:
    """``row`` (the kept columns) with the score of each whole text and its offending sentences.

    ``offending`` holds UTF-8 byte positions start, end, start, end, ... of the sentences whose own
    score reaches ``locate``, ``sentence_scores`` their scores.
    """
    held = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for b in X.pieces(batches):
            z, bound, s, e = sentence_scores(model, b.column(1))
            own = 1 / (1 + np.exp(-z))
            hit = np.flatnonzero(own >= locate)
            at = np.searchsorted(hit, bound)
            ranges = np.stack([s[hit], e[hit]], axis=1).reshape(-1)
            out = [
                b.column(0),
                pa.array(np.clip(noisy_or(z, bound), 0, 1)),
                pa.ListArray.from_arrays(pa.array(2 * at, pa.int32()), pa.array(ranges, pa.int64())),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(own[hit])),
            ]
            yield pa.RecordBatch.from_arrays(out, ["row", "score", "offending", "sentence_scores"])

    return X.annotate(docs, run, _FIELDS, keep, text)
