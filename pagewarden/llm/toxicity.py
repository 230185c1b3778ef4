"""Toxicity by multiple-instance learning: a document is a bag of sentences, its label says
only whether some sentence is toxic. A sentence's probability is a logistic model of its
words; a document's is their noisy-or, 1 - prod(1 - p). Training sees document labels only;
the sentence probabilities that come out locate the offending sentences.

Features are hashed: whole words and their first 4, 5 and 6 bytes, ASCII letters
lower-cased. Nothing but the text enters a score. The model is fitted in one task on a
bounded sample, ``MAX_PER_LABEL`` documents of each label in the order of a hash of doc_id;
every whole text is scored.

Defined results: a null or empty text has no sentence and score 0; so has every text if the
labels hold no toxic or no other document; equal rows score alike; an empty table gives an
empty result; further columns are ignored; null labels are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _INVERSE, _ODD, _power_table, byte_slices, flat_text, mix64

BITS = 20
MAX_PER_LABEL = 3000
#: Sentences from this probability on are reported; documents from it on are predicted toxic.
THRESHOLD = 0.3
#: Likelihood ratio from which a feature counts as evidence of toxicity.
LEAST_RATIO = 16.0
_SLICE_BYTES = 2 << 20
_PREFIXES = (4, 5, 6)

_FOLD = np.full(256, 0x20, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _FOLD[_b] = _b
for _b in range(0x41, 0x5B):
    _FOLD[_b] = _b + 0x20
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n")] = True


class Sentences:
    """Sentences and hashed features of a run of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.n_docs = len(offsets) - 1
        folded = _FOLD[data]
        word = folded != 0x20
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        starts, ends = word.copy(), word.copy()
        starts[1:] &= ~word[:-1] | head[1:n]
        ends[:-1] &= ~word[1:] | head[1:n]
        at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        opens = head[:n].copy()
        opens[1:] |= _STOPS[data[:-1]]
        every = np.cumsum(opens) - 1 if n else np.zeros(0, np.int64)
        used, self.of_word = np.unique(every[at], return_inverse=True)
        begin = np.flatnonzero(opens)
        self.begin = begin[used]
        self.end = np.append(begin[1:], n)[used]
        self.doc = np.searchsorted(offsets, self.begin, side="right") - 1
        self.offsets, self.data = offsets, data
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * _power_table(_ODD, n), out=sums[1:])
        back = _power_table(_INVERSE, n)[at] if n else np.zeros(0, np.uint64)
        shift = np.uint64(64 - BITS)
        self.features = [(mix64((sums[to] - sums[at]) * back) >> shift).astype(np.int32)]
        for k in _PREFIXES:
            h = mix64((sums[np.minimum(at + k, n)] - sums[at]) * back + np.uint64(k)) >> shift
            self.features.append(np.where(to - at >= k, h.astype(np.int32), -1))

    def present(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each sentence's distinct features among those that ``used`` marks: sentence, feature."""
        keys = []
        for f in self.features:
            fine = used[f]
            keys.append(self.of_word[fine].astype(np.int64) << BITS | f[fine])
        keys = np.unique(np.concatenate(keys))
        return keys >> BITS, keys & ((1 << BITS) - 1)


def fit(texts: list[str], labels: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-2) -> dict[int, float]:
    """Weights by feature, the bias at -1; empty if a label is missing."""
    if not len(labels) or labels.min() == labels.max():
        return {}
    every = np.ones((1 << BITS) + 1, bool)
    every[-1] = False
    words, sentence, doc, n_sentences = [], [], [], 0
    for k in range(0, len(texts), 256):
        some = Sentences(*flat_text(pa.array(texts[k : k + 256], pa.large_string())))
        at, feature = some.present(every)
        words.append(feature)
        sentence.append(at + n_sentences)
        doc.append(some.doc + k)
        n_sentences += len(some.begin)
    words, sentence, doc = np.concatenate(words), np.concatenate(sentence), np.concatenate(doc)
    # features whose documents differ by label beyond chance, by the likelihood ratio
    pairs = np.unique(words.astype(np.int64) * len(texts) + doc[sentence])
    feature, holder = pairs // len(texts), pairs % len(texts)
    n, n_toxic = float(len(labels)), float(labels.sum())
    toxic = np.bincount(feature, weights=labels[holder], minlength=1 << BITS)
    clean = np.bincount(feature, weights=1 - labels[holder], minlength=1 << BITS)
    ratio = np.zeros(1 << BITS)
    for seen, of in ((toxic, n_toxic), (clean, n - n_toxic), (n_toxic - toxic, n_toxic), (n - n_toxic - clean, n - n_toxic)):
        both = toxic + clean if seen is toxic or seen is clean else n - toxic - clean
        ratio += 2 * seen * np.log(np.maximum(seen, 1e-9) * n / (of * np.maximum(both, 1e-9)))
    chosen = np.flatnonzero((ratio >= LEAST_RATIO) & (toxic * (n - n_toxic) > clean * n_toxic))
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    words = place[words]
    sentence, words = sentence[words >= 0], words[words >= 0]
    w, bias = np.zeros(len(chosen) + 1), -4.0
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(sentence, weights=w[words], minlength=n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(texts)))
        score = np.maximum(1 - none, 1e-9)
        slope = np.where(labels[doc] > 0, -(none / score)[doc] * p, p) / len(texts)
        grad = np.append(np.bincount(words, weights=slope[sentence], minlength=len(chosen)), slope.sum())
        grad[:-1] += decay * w[:-1] / len(texts)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {int(f): float(x) for f, x in zip(chosen, w[:-1]) if abs(x) > 1e-3} | {-1: float(w[-1])}


def train(docs: DataFrame, labels: DataFrame, per_label: int = MAX_PER_LABEL) -> dict[int, float]:
    """Fits on ``per_label`` documents of each value of labels.toxic at most."""
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("id_"), "toxic").dropDuplicates(["id_"])
    order = F.xxhash64("id_")
    sample = None
    for value in (0, 1):
        some = known.where(F.col("toxic") == value).orderBy(order, "id_").limit(per_label)
        sample = some if sample is None else sample.union(some)

    def one_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"id_": [], "text": [], "toxic": []}), *frames]).drop_duplicates("id_").sort_values("id_")
        model = fit(rows["text"].fillna("").tolist(), rows["toxic"].to_numpy(float))
        yield pd.DataFrame({"feature": list(model.keys()), "weight": list(model.values())}, dtype="float64").astype({"feature": "int64"})

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id_"))  # 2 * per_label rows
    fitted = texts.select("id_", "text", F.col("toxic").cast("double").alias("toxic")).repartition(1).mapInPandas(one_task, "feature bigint, weight double")
    return {r.feature: r.weight for r in fitted.collect()}


def score(docs: DataFrame, model: dict[int, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, n_sentences and the offending sentences (start and end in code points,
    score) of each row."""
    weights = np.zeros((1 << BITS) + 1, np.float32)
    for f, x in model.items():
        if f >= 0:
            weights[f] = x
    bias = model.get(-1, -np.inf)
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 4 MB, whatever the corpus

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        used = table != 0
        for batch in batches:
            for some in byte_slices(batch, "text", _SLICE_BYTES):
                data, offsets = flat_text(some.column("text"))
                parts = Sentences(data, offsets)
                with np.errstate(over="ignore"):
                    at, feature = parts.present(used)
                    z = bias + np.bincount(at, weights=table[feature], minlength=len(parts.begin))
                    p = 1 / (1 + np.exp(-z))
                none = np.bincount(parts.doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=parts.n_docs)
                hot = np.flatnonzero(p >= threshold)
                letters = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                base = letters[offsets[parts.doc[hot]]]
                spans = pa.StructArray.from_arrays(
                    [pa.array(letters[parts.begin[hot]] - base), pa.array(letters[parts.end[hot]] - base), pa.array(p[hot])], ["start", "end", "score"]
                )
                held_by = np.append(0, np.cumsum(np.bincount(parts.doc[hot], minlength=parts.n_docs))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"),
                        pa.array(1 - np.exp(none)),
                        pa.array(np.bincount(parts.doc, minlength=parts.n_docs)),
                        pa.ListArray.from_arrays(pa.array(held_by), spans),
                    ],
                    ["doc_id", "score", "n_sentences", "offending"],
                )

    kind = "doc_id bigint, score double, n_sentences bigint, offending array<struct<start: bigint, end: bigint, score: double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rate, kind)
