"""Whitening against a plain numpy version."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import queries, whitening


def brute(rows, most=16, by_count=False):
    """(vec_id, component): n, deviation, |whitened|, explained; one length of vectors."""
    sound = [(i, tuple(math.floor(64 * float(e)) + 1_000_000 for e in v)) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    weights = {}
    for _, x in sound:
        weights[x] = weights.get(x, 0) + 1 if by_count else 1
    n = sum(weights.values())
    sums = [sum(x[k] * w for x, w in weights.items()) for k in range(len(sound[0][1]))]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    fit = np.array([np.array(x) - mean for x in weights])
    cov = (fit * np.array(list(weights.values()))[:, None]).T @ fit / n
    values, vectors = np.linalg.eigh(cov)
    out = []
    for i, x in sound:
        for k in range(1, min(most, len(values)) + 1):
            e = values[-k]
            if e > values[-1] * len(values) * np.finfo(float).eps:
                out.append((i, k, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), abs((np.array(x) - mean) @ vectors[:, -k]) / math.sqrt(e), e / np.trace(cov)))
    return sorted(out)


def compare(df, want):
    rows = sorted(tuple(r) for r in df.collect())
    assert [r[:4] for r in rows] == [w[:4] for w in want]
    assert np.allclose([abs(r[4]) for r in rows], [w[4] for w in want], rtol=1e-7, atol=1e-9)
    assert np.allclose([r[5] for r in rows], [w[5] for w in want], rtol=1e-9)
    assert max(r[6] for r in rows) < 1e-9 and len({r[6] for r in rows}) == 1
    return rows


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    some = (rng.normal(size=(300, 20)) * np.linspace(0.1, 2, 20)).astype(np.float32).tolist()
    rows = list(enumerate(some))
    rows += [(1000 + k, some[0]) for k in range(200)] + [(5, some[5]), (None, some[6]), (None, [x + 1e-6 for x in some[6]])]
    return rows + [(2000, None), (2001, [*some[1][:-1], None]), (2002, [*some[1][:-1], float("nan")]), (2003, [*some[1][:-1], float("-inf")]), (2004, [])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("by_count", [False, True])
def test_whitening_against_numpy(spark, vectors, by_count):
    """Equal, null, non-finite, clashing; one vector holds 200 of 500 rows."""
    told = [(-1 if i is None else i, v) for i, v in vectors]
    df = frame(spark, vectors).withColumns({c: F.lit(c) for c in ("x", "z", "rows", "weight", "n")}).repartition(7)
    rows = compare(whitening.whiten(df, by_count=by_count).fillna(-1, ["vec_id"]), brute(told, by_count=by_count))
    assert {r[1] for r in rows} == set(range(1, 17))


def test_whitened_rows_agree_in_sign(spark, vectors):
    rows = whitening.whiten(frame(spark, vectors)).where("vec_id IS NOT NULL").collect()
    x = {i: np.floor(64 * np.array(v, np.float64)) + 1e6 for i, v in vectors[:300]}
    z = np.zeros((300, 16))
    for r in rows:
        if r.vec_id < 300:
            z[r.vec_id, r.component - 1] = r.whitened
    # whitened values are one linear map of the vectors
    a = np.array([x[i] for i in range(300)])
    fitted, *_ = np.linalg.lstsq(np.c_[a - a.mean(axis=0), np.ones(300)], z, rcond=None)
    assert np.abs(np.c_[a - a.mean(axis=0), np.ones(300)] @ fitted - z).max() < 1e-6


def test_odd_tables(spark, vectors):
    assert whitening.whiten(frame(spark, []).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0
    line = frame(spark, [(1, [0.0, 1.0, 2.0]), (2, [0.0, 2.0, 4.0]), (3, [0.0, 3.0, 6.0]), (4, [7.0])])
    assert {(r.vec_id, r.component) for r in whitening.whiten(line).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_deviations_beyond_64_bits_stay_exact(spark):
    rows = [(1, [1e8, 0.0]), (2, [-1e8, 1.0]), (3, [3e13, 2.0]), (4, [1e300, 0.0])]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(wide).where("component = 1").collect()}
    x = [[math.floor(64 * e) + 1_000_000 for e in v] for _, v in rows[:3]]
    want = [sum((3 * e - sum(c)) ** 2 for e, c in zip(v, zip(*x))) for v in x]
    assert got == {i + 1: w if w < 2**63 else None for i, w in enumerate(want)}
    near = spark.createDataFrame([(1, [1e6, 0.0]), (2, [-1e6, 1.0])], "vec_id long, embedding array<double>")
    x = [[math.floor(64 * e) + 1_000_000 for e in v] for v in ([1e6, 0.0], [-1e6, 1.0])]
    want = [sum((2 * e - sum(c)) ** 2 for e, c in zip(v, zip(*x))) for v in x]
    assert {r.vec_id: r.deviation for r in whitening.whiten(near).where("component = 1").collect()} == {1: want[0], 2: want[1]}


def test_query_whitens_every_row(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(queries.op12_whitening(spark, sf), brute(rows))
