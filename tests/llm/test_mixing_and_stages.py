"""The mix against brute force, rows that differ in one column alone, and stages that are chained without writing."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pagewarden.llm import mixing, shared


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """By rounds: share among the open sources by weight; those above their cap stop there and the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = left - sum(fixed.values())
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > cap * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_mix_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 30))), [None, "a", "b", "c", "d"][int(rng.integers(0, 2 + seed))], int(i % 3)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(text.split())
    targets = brute_targets(dict(sizes))
    got = {r.doc_id: r for r in mixing.mix(docs, group_rows=20, fan_in=3).collect()}
    assert len(got) == len(rows)
    taken = Counter()
    for i, text, source, _ in rows:
        r = got[i]
        n = len(text.split())
        ratio = targets[source] / sizes[source] if sizes[source] and n else 0
        assert (r.size, r.source_size) == (n, sizes[source]) and abs(r.target - targets[source]) < 1e-6
        assert r.copies in (int(ratio + 1e-9), int(ratio + 1e-9) + 1) and r.taken == r.copies * n <= 2 * n
        taken[source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 15 for s in sizes)


def test_expected_copies(spark):
    """Over many like sources a row is taken as often as its probability says, on whatever level of the tree it meets others."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{k:03}") for k in range(150) for i in range(40)], "doc_id long, text string, source string")
    sums, ratio = {}, {}
    for r in mixing.mix(docs, group_rows=8, fan_in=2).collect():
        of = round(r.target / r.source_size, 6)
        ratio[of] = ratio.get(of, 0) + 1
        sums.setdefault((of, r.doc_id), []).append(r.copies)
    assert len(ratio) == 3
    off = [np.mean(copies) - of for (of, _), copies in sums.items()]
    assert abs(np.mean(off)) < 0.01 and max(map(abs, off)) < 0.3


def test_rows_that_differ_elsewhere_keep_their_copies(spark):
    rows = [(1, "one two three", s, u) for s, u in (("a", "u1"), ("b", "u2"), ("a", "u3"))] * 4 + [(k, "w " * (k % 7 + 1), "ab"[k % 2], "u") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, url string")
    mixed = shared.stage_table(mixing.mix(docs), "test-mixed")
    told = Counter()
    for r in mixing.take_mix(docs, mixed).collect():
        told[tuple(r)] += 1
    again = Counter(tuple(r) for r in mixing.take_mix(docs.repartition(7), mixing.mix(docs.repartition(5))).collect())
    assert told == again
    ratio = {r.source_size: r.target / r.source_size for r in mixed.collect()}
    size_of = {s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in "ab"}
    for row in set(rows):
        n = 4 if row[0] == 1 else 1
        expected = n * ratio[size_of[row[2]]]
        assert abs(told[row] - expected) < 1
    assert sum(told.values()) == sum(r.copies for r in mixed.collect() if r.size)


def test_stages_chain_without_writing(spark, tmp_path):
    """Lazy results give the rows that written ones give, and stay readable while other stages run."""
    rng = np.random.default_rng(8)
    bench = " ".join(f"bench{i}" for i in range(20))
    texts = [" ".join(f"{a}{b}" for a, b in rng.integers(0, 900, (60, 2))) for _ in range(20)]
    texts += [texts[0], texts[1] + " more", bench + " " + " ".join(texts[2].split()[::-1])]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(23)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality_rules"](spark, docs, sf)
    second = stages["quality_rules"](spark, docs, sf)
    near = stages["near_duplicates"](spark, first, sf)
    clean = stages["decontamination"](spark, near, sf)
    mixed = stages["mix_sources"](spark, clean, sf)
    files = stages["token_files"](spark, mixed, sf)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "text").collect()))
    assert rows(first) == rows(second)
    assert near.count() == first.count() - 2 and clean.count() == near.count() - 1
    told = sorted(map(tuple, files.collect()))
    assert told == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert [r[0] for r in told] == [i for i, _ in rows(mixed)]
