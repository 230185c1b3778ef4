"""A table that batches are added to once each, however often they come.

``rows`` holds the data by ``attempt``, a name of its own for each try; ``manifest`` names the attempts that count, one for
each batch. Data are written first and the manifest last, so that readers see whole batches only: an attempt that ended between
the two is not named and never read. A batch that is named adds nothing when it comes again, nor does a key that is stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "batch bigint, attempt string, n_rows bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """batch, attempt, n_rows of the batches that count: should two attempts ever be named for a batch, the first by name is it."""
    path = f"{folder}/manifest"
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    one = spark.read.schema(MANIFEST).parquet(path).groupBy("batch").agg(F.min(F.struct("attempt", "n_rows")).alias("m_"))
    return one.select("batch", "m_.attempt", "m_.n_rows")


def read_batches(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """The rows of all batches that count. Spark reads the folders of named attempts alone."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    path = f"{folder}/rows"
    if not _exists(spark, path):
        return spark.createDataFrame([], kind)
    whole = T.StructType([*kind.fields, T.StructField("attempt_", T.StringType())])
    named = manifest_of(spark, folder).select(F.col("attempt").alias("attempt_"))
    return spark.read.schema(whole).parquet(path).join(named, "attempt_", "left_semi").select(*[F.col(f"`{c}`") for c in kind.names])


def write_rows(rows: DataFrame, folder: str, attempt: str) -> None:
    rows.write.parquet(f"{folder}/rows/attempt_={attempt}")


def name_attempt(spark: SparkSession, folder: str, batch: int, attempt: str, n_rows: int) -> None:
    """One file of one row, which appears as a whole."""
    spark.createDataFrame([(batch, attempt, n_rows)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def save_batch(rows: DataFrame, folder: str, batch: int, key: str = "id", newest: str = "ts") -> int:
    """Adds the rows of a batch whose key is not stored, each key once (the latest by ``newest``), and returns how many they are; 0 if
    the batch is named already. A null key is a key like any other."""
    spark = rows.sparkSession
    if manifest_of(spark, folder).where(F.col("batch") == batch).limit(1).count():
        return 0
    rest = [c for c in rows.columns if c not in (key, newest)]
    best = rows.groupBy(key).agg(F.max(F.struct(newest, *[F.col(f"`{c}`") for c in rest])).alias("row_"))
    once = best.select(key, F.col(f"row_.{newest}").alias(newest), *[F.col("row_").getField(c).alias(c) for c in rest]).select(*rows.columns)
    stored = read_batches(spark, folder, rows.schema).select(F.col(key).alias("stored_"))
    fresh = once.join(stored, F.col(key).eqNullSafe(F.col("stored_")), "left_anti")
    attempt = f"{batch}-{uuid.uuid4().hex}"
    write_rows(fresh, folder, attempt)
    n = spark.read.schema(rows.schema).parquet(f"{folder}/rows/attempt_={attempt}").count()
    name_attempt(spark, folder, batch, attempt, n)
    return n


def batch_writer(folder: str, key: str = "id", newest: str = "ts"):
    """A ``foreachBatch`` function that saves each micro-batch once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        save_batch(batch, folder, batch_id, key, newest)

    return write
