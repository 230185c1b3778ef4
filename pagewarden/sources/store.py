"""Elements of pages, written once and bucketed by page, so that all work by page joins without a parse or a shuffle."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import dom


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder where driver and executors both write: below ``spark.checkpoint.dir``, which must be set on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{top.rstrip('/')}/pagewarden/{label}-{uuid.uuid4().hex}"


def store_elements(pages: DataFrame, buckets: int | None = None) -> DataFrame:
    """``dom.elements(pages)`` as a table of its own, bucketed by page and in document order. It stays until its folder
    is removed; ``buckets`` is the session's number of shuffle partitions by default."""
    spark = pages.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, folder = f"elements_{uuid.uuid4().hex}", shared_folder(spark, "elements")
    rows = dom.elements(pages).repartition(n, "page_id")
    rows.write.bucketBy(n, "page_id").sortBy("page_id", "idx").option("path", folder).format("parquet").saveAsTable(name)
    return spark.table(name)
