"""Mixing sources to target weights by pivotal dependent rounding.

Every row starts with its source's copy number (target / source size, at most 2). Its
whole part is taken; the fractional parts are probabilities. Two rows meet, words move
from one to the other at random until one probability is 0 or 1, and the other row goes
on to meet the next. Each meeting keeps the source's expected words, so a source ends
within one row's size of its target. Groups of a source leave one open row each, and
those meet again in a reduction tree. Random numbers are hashes of the row: reruns agree.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a
source of its own, last in order; rows that are equal in all columns are rounded together, to nearly equal
numbers of copies; rows that differ in any column are rounded apart; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ROW_KEY, own_columns, small_side, stage_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2.0
#: Rows of a source that one task rounds together, about; and open rows of one node of the tree.
GROUP_ROWS = 2_000
FAN_IN = 512
#: Equal rows that one task tells.
EQUAL_ROWS = 100_000
SEED = 20_240_601

WHITE_SPACE = r" \t\n\x0B\f\r"


def word_count(text: Column) -> Column:
    """Runs of other characters than space and U+0009 to U+000D; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{WHITE_SPACE}]+"))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """source, source_size, target, in doubles. ``sizes`` has source and size.

    Targets share ``share`` times all sizes by weight. Those above ``cap`` times their
    source's size stop there and the excess is shared again among the rest; this is the
    fixed point target = min(cap * size, c * weight). In the order of cap * size / weight
    the capped sources come first, so one running sum finds c.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())  # over sources, not rows
    named = per_source.withColumn("nth", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    )
    by_ratio = W.orderBy(F.col("source_size") / F.col("weight"), "nth")
    before, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    full = F.lit(cap) * F.col("source_size")
    rest = named.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    )
    # this source stays under its cap if the price that remains before it does not fill it
    price = rest.withColumn("price", F.col("left") / F.col("weight_left")).withColumn(
        "free", F.col("price") * F.col("weight") <= full
    )
    first_free = F.min(F.when(F.col("free"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), "nth", "price"))).over(everything)
    return price.select(
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        F.coalesce(F.least(full, first_free["price"] * F.col("weight")), full).alias("target"),
    )


def _pivot(group: pd.DataFrame) -> pd.DataFrame:
    """Rounds a group's open rows; at most one stays open (done false).

    Long rows meet first, so that the row that stays open is a short one."""
    group = group.sort_values(["size", "key", "key2", "doc_id"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    p, s, u = group["p"].to_numpy(copy=True), group["size"].to_numpy(float), group["u"].to_numpy()
    open_row = 0
    for j in range(1, len(group)):
        i = open_row
        to_i = min((1.0 - p[i]) * s[i], p[j] * s[j])
        to_j = min((1.0 - p[j]) * s[j], p[i] * s[i])
        if u[j] * (to_i + to_j) < to_j:
            moved, gains, loses = to_i, i, j
        else:
            moved, gains, loses = to_j, j, i
        p[gains] += moved / s[gains]
        p[loses] -= moved / s[loses]
        p[[i, j]] = [0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x for x in p[[i, j]]]
        open_row = i if 0.0 < p[i] < 1.0 else j
    group["p"] = p
    group["done"] = (p == 0.0) | (p == 1.0)
    return group


_OPEN = "doc_id bigint, key bigint, key2 bigint, source string, source_size bigint, target double, size bigint, whole int, n bigint, p double, u double, node bigint, done boolean"


def row_keys(docs: DataFrame) -> list[Column]:
    """128 bits that stand for a row: hashes of all its columns (but a row's own number)."""
    flat = [F.col(f"`{c}`") if _hashed(t) else F.to_json(F.struct(F.col(f"`{c}`"))) for c, t in docs.dtypes if c != ROW_KEY]
    return [F.xxhash64(*flat).alias("key"), F.xxhash64(F.lit("second"), *reversed(flat)).alias("key2")]


def _hashed(kind: str) -> bool:
    return not any(x in kind for x in ("map<", "variant"))


def draw(level: int, seed: int) -> Column:
    """A number in [0, 1] of a row's own at each level of the tree."""
    return F.xxhash64("key", "key2", F.lit(level), F.lit(seed)).cast("double") / F.lit(2.0**64) + F.lit(0.5)


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = MAX_COPIES,
    seed: int = SEED,
    group_rows: int = GROUP_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """doc_id, key and key2 (hashes of all columns), size, source_size, target, copies, taken.

    n equal rows that meet each other leave floor(n * p) of 1, one open row with the rest, and zeros:
    so they are counted first and go on as one row each of these, however many they are."""
    sizes = stage_table(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(docs), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, share, cap)
    counted = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows")).withColumnRenamed("source", "source_")
    targets = stage_table(targets.join(counted, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumnRenamed("source", "of"), "mix-sources")
    equal = sizes.groupBy("doc_id", "key", "key2", "source", "size").agg(F.count(F.lit(1)).alias("n_equal"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    left = F.col("n_equal") * F.col("ratio_p")
    ones = F.floor(left + F.lit(1e-9)).cast("bigint")
    rest = F.when(left - ones < 1e-9, 0.0).otherwise(left - ones)
    part = lambda n, p: F.struct(n.cast("bigint").alias("n"), p.cast("double").alias("p"))
    parts = F.array(part(ones, F.lit(1.0)), part(F.when(rest > 0, 1).otherwise(0), rest), part(F.col("n_equal") - ones - F.when(rest > 0, 1).otherwise(0), F.lit(0.0)))
    rows = (
        equal.join(small_side(targets), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("ratio", F.when(F.col("size") > 0, ratio).otherwise(0.0))
        .withColumn("whole", F.floor(F.col("ratio") + F.lit(1e-9)).cast("int"))
        .withColumn("ratio_p", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
        .withColumn("u", draw(0, seed))
        .withColumn("node", F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.ceil(F.col("n_rows") / group_rows)).cast("long"))
        .withColumn("part", F.explode(F.filter(parts, lambda x: x["n"] > 0)))
        .withColumns({"n": F.col("part.n"), "p": F.col("part.p"), "done": F.col("part.p").isin(0.0, 1.0)})
        .select(*[c.split()[0] for c in _OPEN.split(", ")])
    )
    rows = stage_table(rows, "mix-rows")
    largest = targets.agg(F.max("n_rows")).first()[0] or 0
    nodes = -(-largest // group_rows)
    decided = rows.where("done")
    level = stage_table(rows.where("NOT done").groupBy("source", "node").applyInPandas(_pivot, _OPEN), "mix-level")
    depth = 0
    while True:
        decided = decided.unionByName(level.where("done"))
        open_rows = level.where("NOT done")
        if nodes <= 1:
            break
        nodes, depth = -(-nodes // fan_in), depth + 1
        up = open_rows.withColumn("node", F.floor(F.col("node") / fan_in).cast("long")).withColumn("u", draw(depth, seed))
        level = stage_table(up.groupBy("source", "node").applyInPandas(_pivot, _OPEN), "mix-level")
    # one open row a source is left: rounded to the nearer side, which errs by half its size at most
    last = open_rows.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0))
    copies = (F.col("whole") + F.col("p")).cast("int")
    return as_often(decided.unionByName(last), rows).select(
        "doc_id", "key", "key2", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def as_often(told: DataFrame, counted: DataFrame, chunk: int = EQUAL_ROWS) -> DataFrame:
    """Each row of ``told`` ``n`` times; more than ``chunk`` times in several tasks."""
    most = counted.agg(F.max("n")).first()[0] or 0
    if most > chunk:
        told = told.withColumn("chunk_", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk)))).repartition("key", "chunk_")
        return told.withColumn("nth_", F.explode(F.sequence(F.lit(1), F.least(F.lit(chunk), F.col("n") - F.col("chunk_") * chunk))))
    return told.withColumn("nth_", F.explode(F.sequence(F.lit(1), F.col("n"))))


def take_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, the table that ``mixed`` was made of, as often as ``mixed`` takes them; rows that
    are equal in all columns together as often as all of them. Rows of no words are not taken. Names that begin with
    mix_ are taken by the operator."""
    copies = stage_table(
        mixed.groupBy(F.col("key").alias("mix_key_"), F.col("key2").alias("mix_key2_")).agg(F.sum("copies").cast("int").alias("mix_copies_"), F.count(F.lit(1)).alias("mix_rows_")), "mix-copies"
    ).where("mix_copies_ > 0")
    keys = ["mix_key_", "mix_key2_"]
    rows = docs.select(*own_columns(docs), *[k.alias(c) for k, c in zip(row_keys(docs), keys)])
    joined = rows.join(small_side(copies), keys)
    if copies.where("mix_rows_ > 1").limit(1).count():
        joined = joined.where("mix_rows_ = 1").unionByName(joined.where("mix_rows_ > 1").dropDuplicates(keys))
    return joined.withColumn("mix_copy_", F.explode(F.sequence(F.lit(1), F.col("mix_copies_")))).select(*own_columns(docs))
