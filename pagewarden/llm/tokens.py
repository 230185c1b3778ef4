"""Token counts, and token-id files.

``count_tokens``: batch encoding in Arrow functions that return lengths only; batches are
cut by bytes and long texts at safe boundaries.

``write_token_ids`` / ``read_token_ids``: flat files of unsigned ids, one for each range of
document ids, with 64-bit offsets and document ids beside them. A part's place in the whole
is the prefix sum of the counts of the parts before it, so parts are written at once.

Defined results: a null text counts as empty (no ids; only the end id in files); a null
``doc_id`` sorts first; rows of equal ``doc_id`` follow each other by a hash of their texts, so that
many of them make several parts;
an empty table gives no rows and one manifest of no parts; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pieces import BATCH_BYTES, PieceEncoder
from .shared import byte_slices, flat_text, new_folder, stage_table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes of text that one part of the files takes, about.
PART_BYTES = 64 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. ``vocabulary`` is the path of a
    tokenizers file on the executors."""
    vocabulary = vocabulary or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(vocabulary)
        for batch in batches:
            for part in byte_slices(batch, "text", BATCH_BYTES):
                data, offsets = flat_text(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(encoder.counts(data, offsets))],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        count, "doc_id bigint, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


# --- files -----------------------------------------------------------------


def _write_file(folder: str, name: str, parts: list[np.ndarray], attempt: int) -> None:
    """All of a file or nothing: a retried task puts the same bytes in its place."""
    system, base = pafs.FileSystem.from_uri(folder)
    passing = f"{base}/_{name}.{attempt}"
    with system.open_output_stream(passing) as out:
        for x in parts:
            out.write(x)
    system.move(passing, f"{base}/{name}")


def write_token_ids(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, folder: str | None = None, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Writes the files and returns their manifest: part, file, width, n_docs, n_nulls (first documents whose
    id is null), n_tokens, start."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    folder = folder or new_folder(spark, "token-ids")
    system, base = pafs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(vocabulary)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        name = f"part-{part:06d}"
        where, top = pafs.FileSystem.from_uri(folder)
        passing = f"{top}/_{name}.bin.{attempt}"
        doc_ids, counts, n_nulls = [], [], 0
        with where.open_output_stream(passing) as out:
            for batch in batches:
                for some in byte_slices(batch, "text", BATCH_BYTES):
                    data, offsets = flat_text(some.column("text"))
                    ids, first = encoder.encode(data, offsets)
                    out.write(np.insert(ids, first[1:], end_id).astype(encoder.width))
                    counts.append(np.diff(first) + 1)
                    doc_ids.append(some.column("doc_id").fill_null(0).to_numpy())
                    n_nulls += some.column("doc_id").null_count
        if not counts:
            where.delete_file(passing)
            return
        where.move(passing, f"{top}/{name}.bin")
        counts, doc_ids = np.concatenate(counts), np.concatenate(doc_ids)
        _write_file(folder, f"{name}.off", [np.append(0, np.cumsum(counts)).astype("<u8")], attempt)
        _write_file(folder, f"{name}.doc", [doc_ids.astype("<i8")], attempt)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([name]), pa.array([encoder.width.itemsize], pa.int32()), pa.array([len(counts)], pa.int64()), pa.array([n_nulls], pa.int64()), pa.array([int(counts.sum())], pa.int64())],
            ["part", "file", "width", "n_docs", "n_nulls", "n_tokens"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash").asc()]
    ordered = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    parts = stage_table(ordered.mapInArrow(write, "part bigint, file string, width int, n_docs bigint, n_nulls bigint, n_tokens bigint"), "token-parts")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over parts, not documents
    return parts.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), F.lit(folder).alias("folder"))


def _mapped(system, path: str, width: str) -> np.ndarray:
    if isinstance(system, pafs.LocalFileSystem):
        return np.memmap(path, width, "r") if os.path.getsize(path) else np.zeros(0, width)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), width)


def read_token_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document in the whole), n_tokens, ids_crc32 of each
    document, from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, base = pafs.FileSystem.from_uri(row["folder"])
                at = f"{base}/{row['file']}"
                ids = _mapped(system, f"{at}.bin", f"<u{row['width']}")
                offsets = _mapped(system, f"{at}.off", "<u8").astype(np.int64)
                doc_ids = _mapped(system, f"{at}.doc", "<i8")
                for k in range(0, len(doc_ids), 4096):
                    some = np.array(doc_ids[k : k + 4096])
                    to = offsets[k : k + len(some) + 1]
                    sums = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(to[:-1], to[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some, mask=np.arange(k, k + len(some)) < row["n_nulls"]),
                            pa.array(to[:-1] + row["start"]),
                            pa.array(np.diff(to)),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spark = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(max(n, spark.sparkContext.defaultParallelism)).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
