"""Language ID by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes that overlap by the widest filter less one byte, the last
one padded with spaces, so that a filter meets each place of the text once. The network embeds each byte, convolves filters of several widths, applies a ReLU, pools each filter's maximum over the window and ends in a
softmax over the languages. It is trained in numpy, in one task, on a bounded sample: windows of at most
``PER_LANGUAGE`` distinct documents of each of the ``LANGUAGES`` most frequent languages, ``DOC_WINDOWS`` windows each.
A text's probabilities are those of its windows, every one, weighed by their bytes that are letters (ASCII) or
beyond ASCII.

For scoring, embedding and filters are folded into tables by pairs of bytes, so that a filter's response is a sum of
looked-up rows; this changes no result but for rounding.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was
learned; equal probabilities go to the first language by code point; equal texts score alike; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_slices, flat_text

WINDOW = 96
WIDTHS = (2, 3, 4)
#: Places of a window where filters are applied; as far apart are windows.
STEP = WINDOW - max(WIDTHS) + 1
FILTERS, DIMS = 16, 8
#: Bounds of the training sample.
PER_LANGUAGE, LANGUAGES, DOC_WINDOWS = 600, 200, 2
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 6, 300, 64, 4e-3, 7
UNKNOWN = "und"
_SLICE_BYTES = 1 << 20
#: Windows that are convolved at once.
_SOME = 256

_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: ASCII letters are read in lower case.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, padded with spaces, and the text of each."""
    lengths = np.diff(offsets)
    counts = -(-lengths // STEP)
    text = np.repeat(np.arange(len(lengths)), counts)
    # each text has STEP bytes a window and the rest of the last one's
    room = np.where(counts > 0, counts * STEP + WINDOW - STEP, 0)
    begins = np.cumsum(room) - room
    held = np.full(max(int(room.sum()), WINDOW), 0x20, np.uint8)
    held[np.arange(len(data)) + np.repeat(begins - offsets[:-1], lengths)] = _FOLD[data]
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.lib.stride_tricks.sliding_window_view(held, WINDOW)[begins[text] + nth * STEP], text


class Network:
    """Embedding (256, DIMS); filters by width (width, DIMS, FILTERS) with biases; a dense layer."""

    def __init__(self, n_labels: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {"embed": draw(256, DIMS, scale=0.5)}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = draw(w * DIMS, FILTERS, scale=(2 / (w * DIMS)) ** 0.5)
            self.weights[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.weights["dense"] = draw(len(WIDTHS) * FILTERS, n_labels, scale=0.2)
        self.weights["out"] = np.zeros(n_labels, np.float32)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy."""
        p, n = self.weights, len(x)
        e = p["embed"][x]  # (n, WINDOW, DIMS)
        pooled, kept = [], []
        for w in WIDTHS:
            spans = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)[:, :STEP].transpose(0, 1, 3, 2).reshape(n, -1, w * DIMS)
            z = spans @ p[f"filter{w}"]
            best = z.argmax(axis=1)
            top = np.take_along_axis(z, best[:, None, :], axis=1)[:, 0] + p[f"bias{w}"]
            pooled.append(np.maximum(top, 0))
            kept.append((spans, best, top > 0))
        h = np.concatenate(pooled, axis=1)
        q = softmax(h @ p["dense"] + p["out"])
        q[np.arange(n), y] -= 1
        q /= n
        grads = {"dense": h.T @ q, "out": q.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        back = q @ p["dense"].T
        for k, w in enumerate(WIDTHS):
            spans, best, live = kept[k]
            slope = back[:, k * FILTERS : (k + 1) * FILTERS] * live  # (n, FILTERS)
            taken = np.take_along_axis(spans, best[:, :, None], axis=1)  # (n, FILTERS, w * DIMS)
            grads[f"filter{w}"] = np.einsum("nf,nfd->df", slope, taken)
            grads[f"bias{w}"] = slope.sum(axis=0)
            to = slope[:, :, None] * p[f"filter{w}"].T[None]  # (n, FILTERS, w * DIMS)
            rows = np.take_along_axis(x, (best[:, :, None] + np.arange(w)).reshape(n, -1), axis=1)
            np.add.at(grads["embed"], rows.ravel(), to.reshape(-1, DIMS))
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        per_epoch = -(-len(x) // BATCH)
        epochs = max(epochs, -(-LEAST_STEPS // per_epoch))
        t, steps = 0, epochs * per_epoch
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), BATCH):
                t += 1
                rate = RATE * (1 - t / (steps + 1))
                for name, g in self.step(x[order[k : k + BATCH]], y[order[k : k + BATCH]]).items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.weights[name] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Scorer:
    """A trained network with its filters as tables by pairs of bytes."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.dense, self.out = weights["dense"], weights["out"]
        single = {(w, k): weights["embed"] @ weights[f"filter{w}"].reshape(w, DIMS, FILTERS)[k] for w in WIDTHS for k in range(w)}
        first, second = np.divmod(np.arange(65536), 256)
        zero = np.zeros((65536, FILTERS), np.float32)
        bias = [weights[f"bias{w}"] for w in WIDTHS]
        self.head = np.concatenate([single[w, 0][first] + single[w, 1][second] + b for w, b in zip(WIDTHS, bias)], axis=1)
        tail = []
        for w in WIDTHS:
            part = single[w, 2][first] if w > 2 else zero
            tail.append(part + single[w, 3][second] if w > 3 else part)
        self.tail = np.concatenate(tail, axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.out)), np.float32)
        for k in range(0, len(x), _SOME):
            out[k : k + _SOME] = self._some(x[k : k + _SOME])
        return out

    def _some(self, x: np.ndarray) -> np.ndarray:
        pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        z = self.head[pairs[:, :STEP]]
        z += self.tail[pairs[:, 2 : 2 + STEP]]
        return softmax(np.maximum(z.max(axis=1), 0) @ self.dense + self.out)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages by code point and the network's weights. ``docs`` has text and lang."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64("text", "lang").alias("key"))
    # equal documents count once; a lower bound on the keys holds per_language of them, about, before they are ranked
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES)
    known = sorted((r.lang, r.n) for r in counts.collect())
    if not known:
        return [], {}
    langs = [lang for lang, _ in known]
    top = 2.0**63
    bounds = F.broadcast(docs.sparkSession.createDataFrame([(lang, int(min(top, -top + 2 * top * 2 * per_language / n)) - 1) for lang, n in known], "lang string, most long"))
    few = rows.join(bounds, "lang").where(F.col("key") <= F.col("most")).groupBy("lang", "key").agg(F.first("text").alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Evenly spread windows of each document, as bytes."""
        for batch in batches:
            for some in byte_slices(batch, "text", _SLICE_BYTES):
                x, text = windows(*flat_text(some.column("text")))
                begin = np.searchsorted(text, np.arange(some.num_rows + 1))
                chosen = []
                for b, e in zip(begin[:-1], begin[1:]):
                    at = b + (np.arange(min(DOC_WINDOWS, e - b)) * (e - b)) // DOC_WINDOWS if e - b >= DOC_WINDOWS else np.arange(b, e)
                    chosen.append(x[at].tobytes())
                yield pa.RecordBatch.from_arrays([some.column("lang"), some.column("key"), pa.array(chosen, pa.binary())], ["lang", "key", "windows"])

    def one_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"lang": [], "key": [], "windows": []}), *frames]).sort_values(["lang", "key"])
        rows = rows.groupby("lang", sort=True).head(per_language)
        x = np.frombuffer(b"".join(rows["windows"]), np.uint8).reshape(-1, WINDOW)
        y = np.repeat([langs.index(lang) for lang in rows["lang"]], [len(w) // WINDOW for w in rows["windows"]]).astype(int)
        net = Network(len(langs)).fit(x, y) if len(x) else Network(len(langs))
        yield pd.DataFrame({"name": list(net.weights), "weights": [v.astype("<f4").tobytes() for v in net.weights.values()], "width": [v.shape[-1] for v in net.weights.values()]})

    sample = few.select("lang", "key", "text").mapInArrow(pieces, "lang string, key bigint, windows binary")
    told = sample.repartition(1).mapInPandas(one_task, "name string, weights binary, width int").collect()
    weights = {r.name: np.frombuffer(r.weights, "<f4") for r in told}
    return langs, {r.name: weights[r.name].reshape(-1, r.width) if r.name in ("embed", "dense") or r.name.startswith("filter") else weights[r.name] for r in told}


def predict(docs: DataFrame, langs: list[str], weights: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    held = docs.sparkSession.sparkContext.broadcast((langs, weights))  # a few kilobytes, whatever the corpus

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights = held.value
        scorer = Scorer(weights) if langs else None
        for batch in batches:
            for some in byte_slices(batch, "text", _SLICE_BYTES):
                n = some.num_rows
                sums = np.zeros((n, max(len(langs), 1)))
                if langs:
                    for part, data, offsets in _parts(*flat_text(some.column("text"))):
                        x, text = windows(data, offsets)
                        weight = _LETTER[x[:, :STEP]].sum(axis=1)
                        np.add.at(sums, part + text, scorer.probabilities(x) * weight[:, None])
                total = sums.sum(axis=1)
                lettered = np.array(some.column("lettered").to_numpy(zero_copy_only=False), bool) & (total > 0)
                best = sums.argmax(axis=1)
                score = np.where(lettered, sums[np.arange(n), best] / np.where(total > 0, total, 1), 0.0)
                names = [langs[k] if fine else UNKNOWN for k, fine in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lettered).mapInArrow(rate, "doc_id bigint, lang_pred string, score double")


def _parts(data: np.ndarray, offsets: np.ndarray, most: int = 4 << 20):
    """Texts as they are, but a very long one in parts of whole windows: first text, bytes, offsets."""
    if len(data) <= most or len(offsets) != 2:
        yield 0, data, offsets
        return
    step = most // STEP * STEP
    for k in range(0, len(data), step):
        some = data[k : k + step]
        yield 0, some, np.array([0, len(some)])
