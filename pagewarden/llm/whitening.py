"""Whitening of embeddings by a covariance in which equal vectors count by a weight.

Entries become whole numbers x = floor(64 * c) + 1000000. Equal x vectors are grouped; each distinct
vector enters the fit once, with weight one or its number of rows. Tasks centre blocks of distinct
vectors and multiply them (a weighted GEMM); the small matrices are added in a tree of bounded fan-in, in a
fixed order. Each distinct vector is projected once and joined back to its rows: vectors with many rows by a
broadcast of at most ``HOT_VECTORS`` of them, the others by a shuffle.

Defined results: rows are dropped whose vector is null, empty, or holds a null, non-finite or
unrepresentable entry (64 * |c| of 2**52 or more); vectors of different lengths are whitened apart,
length by length; vec_id may be null or repeat; components whose eigenvalue is not above the rounding error
of the largest (constant or dependent dimensions, a single vector) have no rows; a deviation beyond the long
range is null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage_table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Vectors with more rows than this share of all are joined by a broadcast; there are at most 1 / share.
HOT_VECTORS = 500
#: Bytes of the matrices that one task adds, and the most of them.
FAN_BYTES, FAN_IN = 64 << 20, 64
BLOCK_ROWS = 4096


def whole_numbers(rows: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose vector has finite entries only."""
    c = F.col("embedding").cast("array<double>")
    sound = F.forall(c, lambda e: e.isNotNull() & (F.abs(e) * SCALE < 2.0**52))
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(c.isNotNull() & (F.size(c) > 0) & sound, c).alias("c")).where("c IS NOT NULL")
    return fine.select("vec_id", F.transform("c", lambda e: F.floor(e * SCALE) + F.lit(SHIFT)).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _blocks(batch: pa.RecordBatch):
    for k in range(0, batch.num_rows, BLOCK_ROWS):
        yield batch.slice(k, BLOCK_ROWS)


def weighted_sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The weights' sum and the weighted sums of each dimension, exact. ``vectors`` has x and weight."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            for some in _blocks(batch):
                x, w = _matrix(some.column("x"), dims), some.column("weight").to_numpy()
                n += int(w.sum())
                # 26 bits at a time, so that no sum of products overflows
                low, high = x & ((1 << 26) - 1), x >> 26
                for part, by in ((low, 1), (high, 1 << 26)):
                    for bits, scale in ((w & 0xFFFFFF, 1), (w >> 24, 1 << 24)):
                        got = bits @ part
                        sums = [s + int(g) * by * scale for s, g in zip(sums, got)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([n, *sums], pa.decimal128(38, 0))], ["at", "s"])

    told = dict(vectors.select("x", "weight").mapInArrow(add, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect())
    return int(told.get(-1, 0)), [int(told.get(k, 0)) for k in range(dims)]


def centred_products(vectors: DataFrame, column: str, dims: int, mean: np.ndarray) -> np.ndarray:
    """The weighted sum of outer products of the rows less ``mean``. ``vectors`` is a staged table, so that the
    order of the sums, and with it the last bits, stay the same if a task runs again."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for some in _blocks(batch):
                x = _matrix(some.column(column), dims).astype(float) - mean
                block = x.T @ (x * some.column("weight").to_numpy()[:, None])
                total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "matrix"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.zeros(dims * dims)
        for held in table["matrix"]:
            total += np.frombuffer(held.as_buffer())
        return pa.table({"part": pa.array([table["part"][0].as_py() // fan], pa.int64()), "matrix": pa.array([total.tobytes()], pa.binary())})

    fan = max(2, min(FAN_IN, FAN_BYTES // (8 * dims * dims)))
    kind = "part bigint, matrix binary"
    numbered = vectors.select(column, F.col("weight").cast("double").alias("weight"), F.spark_partition_id().cast("long").alias("part"))
    level = stage_table(numbered.mapInArrow(multiply, kind), "whiten-products")
    left = (level.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        level = stage_table(level.groupBy(F.floor(F.col("part") / fan).alias("group_")).applyInArrow(add, kind), "whiten-sums")
        left = -(-left // fan)
    held = level.first()
    return np.frombuffer(held.matrix).reshape(dims, dims) if held else np.zeros((dims, dims))


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (rows) by falling eigenvalue; each vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors.T[::-1]
    kept = values > max(values[0], 0.0) * len(values) * np.finfo(float).eps
    values, vectors = values[kept][:most], vectors[kept][:most]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]) if len(vectors) else np.ones(0)
    return values, vectors * signs[:, None]


def _whiten_one(rows: DataFrame, dims: int, most: int, by_count: bool) -> DataFrame:
    """Rows (vec_id, x) of one length. See :func:`whiten`."""
    spark = rows.sparkSession
    counted = stage_table(rows.groupBy("x").agg(F.count(F.lit(1)).alias("rows")), "whiten-distinct")
    vectors = counted.select("x", "rows", (F.col("rows") if by_count else F.lit(1)).cast("long").alias("weight"))
    n, sums = weighted_sums(vectors, dims)
    mean = np.array([s / n for s in sums])
    covariance = centred_products(vectors, "x", dims, mean) / n
    values, axes = components(covariance, most)
    explained = [float(v / np.trace(covariance)) for v in values]
    project = axes.T / np.sqrt(values)

    def deviations(x: np.ndarray) -> list[int | None]:
        """Exact; in whole numbers of 64 bits where they cannot overflow, else in Python's."""
        far = np.abs(x.astype(float) * n - np.array(sums, float)).max(initial=0.0) * (1 + 1e-9) + 4096.0
        fits = n * max(int(np.abs(x).max(initial=0)), 1) < 2**62 and max(map(abs, sums)) < 2**62 and far * far * dims < 2.0**62
        if fits:
            off = x * n - np.array(sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        told = [sum((n * int(e) - s) ** 2 for e, s in zip(row, sums)) for row in x]
        return [d if d < 2**63 else None for d in told]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _blocks(batch):
                x = _matrix(some.column("x"), dims)
                z = (x.astype(float) - mean) @ project
                held = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), len(values)).cast(pa.list_(pa.float64())) if len(values) else pa.array([[]] * len(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([some.column("x"), some.column("rows"), some.column("weight"), held, pa.array(deviations(x), pa.int64())], ["x", "rows", "weight", "z", "deviation"])

    placed = stage_table(vectors.mapInArrow(place, "x array<bigint>, rows bigint, weight bigint, z array<double>, deviation bigint"), "whiten-placed")
    if not len(values):
        return spark.createDataFrame([], RESULT)
    middle = placed.select(F.posexplode("z").alias("at", "e"), "weight").groupBy("at").agg((F.sum(F.col("e") * F.col("weight")) / n).alias("m"))
    centre = np.array([m for _, m in sorted(middle.collect())])
    off = float(np.abs(centred_products(placed, "z", len(values), centre) / n - np.eye(len(values))).max())
    # a vector with more than a share of all rows goes by broadcast: there are at most HOT_VECTORS
    total = counted.agg(F.sum("rows")).first()[0]
    sides, hot = placed.select("x", "z", "deviation", "rows"), F.col("rows") > max(total / HOT_VECTORS, 1)
    often = F.broadcast(sides.where(hot).drop("rows"))
    seldom = sides.where(~hot).drop("rows")
    joined = rows.join(often, "x").unionByName(rows.join(often, "x", "left_anti").join(seldom, "x"))
    told = joined.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return told.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(e) for e in explained]), F.col("at") + 1).alias("explained"),
        F.lit(off).alias("identity_error"),
    )


RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, most: int = COMPONENTS, by_count: bool = False) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each sound row and
    component up to ``most``. ``by_count`` weighs a distinct vector by its rows, else each counts once."""
    found = stage_table(whole_numbers(rows), "whiten-rows")
    lengths = [r[0] for r in found.select(F.size("x")).distinct().orderBy(F.size("x")).collect()]
    out = rows.sparkSession.createDataFrame([], RESULT)
    for dims in lengths:
        out = out.unionByName(_whiten_one(found.where(F.size("x") == dims), dims, most, by_count))
    return out
