"""Language ID: the folded tables against the plain network, windows, gradients, held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import language, queries
from pagewarden.llm.shared import flat_text

SF = "/root/testdata/sf0.01"


def plain(weights, x):
    """The network's probabilities, place by place."""
    e = weights["embed"][x].astype(float)
    pooled = []
    for w in language.WIDTHS:
        z = np.stack([e[:, t : t + w].reshape(len(x), -1) @ weights[f"filter{w}"] for t in range(language.STEP)], axis=1)
        pooled.append(np.maximum(z.max(axis=1) + weights[f"bias{w}"], 0))
    return language.softmax(np.concatenate(pooled, axis=1) @ weights["dense"] + weights["out"])


def test_windows_cover_whole_texts():
    texts = ["", "a", "Été " * 40, "x" * language.STEP, "y" * (language.STEP + 1), None, "Z" * 1000]
    data, offsets = flat_text(pa.array(texts))
    x, text = language.windows(data, offsets)
    for i, t in enumerate(texts):
        raw = bytes(language._FOLD[b] for b in (t or "").encode())
        want = [raw[k : k + language.WINDOW].ljust(language.WINDOW) for k in range(0, len(raw), language.STEP)]
        assert [row.tobytes() for row in x[text == i]] == want


def test_tables_equal_the_network():
    rng = np.random.default_rng(1)
    net = language.Network(5)
    for k in net.weights:
        net.weights[k] = net.weights[k] + rng.normal(size=net.weights[k].shape).astype(np.float32) * 0.1
    x = rng.integers(0, 256, (600, language.WINDOW), dtype=np.uint8)
    assert np.abs(language.Scorer(net.weights).probabilities(x) - plain(net.weights, x)).max() < 1e-4


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    net = language.Network(3)
    x, y = rng.integers(97, 123, (8, language.WINDOW), dtype=np.uint8), rng.integers(0, 3, 8)
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}
    grads = net.step(x, y)
    loss = lambda: -np.log(plain(net.weights, x)[np.arange(8), y]).mean()
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        held = net.weights[name][at]
        net.weights[name][at] = held + 1e-5
        up = loss()
        net.weights[name][at] = held - 1e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at]))
        net.weights[name][at] = held


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = queries.op11_language(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert len(told) == docs.count()
    assert (told.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in told.doc_id]).all()
    assert told.score.between(0, 1).all() and set(told.lang_pred) <= {"en", "fr", "de", "es", "und"}
    away = told[told.held_out & told.text.str.len().ge(20) & told.lang.notna()]
    assert (away.lang_pred == away.lang).mean() > 0.95


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(["the and of that"] * (i % 7 + 1)), "en") for i in range(40)] + [(100 + i, " ".join(["der und nicht für"] * (i % 5 + 1)), "de") for i in range(40)]
    rows += [(7, "the and of that", "en")] * 300
    odd = [(None, "the and of that", None), (900, None, "en"), (901, "", "de"), (902, "12 34 !?", "en"), (903, "Ж", None), (904, "a", ""), (905, "the of and " * 500_000, None), (900, "the of", None)]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")


def test_odd_texts(spark, docs):
    """Nulls, no letters, unlabelled, a very long text, repeated and clashing; equal texts score alike."""
    wide = docs.withColumns({c: F.lit(c) for c in ("key", "most", "lettered", "score", "n")}).repartition(6)
    langs, weights = language.train(wide)
    assert langs == ["", "de", "en"]
    rows = language.predict(wide, langs, weights).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, round(r.score, 6)))
    assert by[901] == by[902] == {("und", 0.0)} and ("und", 0.0) in by[900]
    assert len(by[7]) == 1 and {x[0] for x in by[7]} == {"en"} == {x[0] for x in by[905]} and {x[0] for x in by[100]} == {"de"}
    assert by[903] != {("und", 0.0)}
    assert language.predict(docs.limit(0), langs, weights).count() == 0


def test_nothing_to_learn_from(spark, docs):
    assert language.train(docs.limit(0)) == ([], {})
    assert {(r.lang_pred, r.score) for r in language.predict(docs, [], {}).collect()} == {("und", 0.0)}


def test_training_is_repeatable(spark, docs):
    a, b = language.train(docs), language.train(docs.repartition(5))
    assert a[0] == b[0] and all(np.array_equal(a[1][k], b[1][k]) for k in a[1])
