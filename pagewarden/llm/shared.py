"""Shared storage, size-checked joins and Arrow text helpers of the llm operators."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side of at most so many rows, and so many bytes as JSON, is broadcast;
#: a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 48 << 20
#: Bytes of text whose words are hashed at once.
PART_BYTES = 1_000_000
#: The column of a row's own number; doc_id may be null or repeat.
ROW_KEY = "row_key_"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a new temporary folder becomes the checkpoint folder
    on a local master; on a cluster, whose executors would not see it, that is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/pagewarden/{label}-{uuid.uuid4().hex}"


#: Folders of the tables that are staged within ``staged_tables``.
_noted: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("noted", default=None)


@contextlib.contextmanager
def staged_tables():
    """Notes the folders of all tables that are staged within, so that they can be dropped
    when nothing reads them any more. Those that are left at the end count as staged further out."""
    held: list[str] = []
    token = _noted.set(held)
    try:
        yield held
    finally:
        _noted.reset(token)
        if _noted.get() is not None:
            _noted.get().extend(held)


def drop_tables(folders: list[str]) -> None:
    """Removes the folders and forgets them."""
    while folders:
        system, base = pafs.FileSystem.from_uri(folders.pop())
        if system.get_file_info(base).type != pafs.FileType.NotFound:
            system.delete_dir(base)


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage,
    survives lost executors, and is computed once however often it is used."""
    path = new_folder(df.sparkSession, label)
    if _noted.get() is not None:
        _noted.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The staged table that ``make`` tells; what was staged on the way is dropped when it is written."""
    with staged_tables() as made:
        out = stage_table(make(), label)
        *before, last = made
        drop_tables(before)
        made[:] = [last]
    return out


def own_columns(docs: DataFrame) -> list[Column]:
    """All columns of ``docs``, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def numbered_rows(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` with ``ROW_KEY``. Where it lacks the column the table is written with it,
    so that every later read finds the same numbers."""
    return docs if ROW_KEY in docs.columns else stage_table(docs.withColumn(ROW_KEY, F.monotonically_increasing_id()), label)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``most`` bytes as JSON. It should be a staged
    table: it is measured, and the measuring ends soon after ``rows`` rows."""
    width = F.octet_length(F.to_json(F.struct("*")))
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and size <= most


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else as it is, so that Spark shuffles it."""
    return F.broadcast(df) if is_small(df, rows, most) else df


# --- Arrow text ------------------------------------------------------------


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_slices(batch: pa.RecordBatch, column: str, limit: int):
    """``batch`` in slices whose ``column`` has about ``limit`` bytes each (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_part(data: np.ndarray, first: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of all words; ``first`` tells where texts begin."""
    n = len(data)
    word = ~separator[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_ODD, n), out=sums[1:])
    return mix64((sums[to] - sums[at]) * _power_table(_INVERSE, n)[at]), at


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, part: int = PART_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and each text's first word
    (n + 1 positions). Words are maximal runs of bytes for which ``separator`` is false.
    The work takes about 50 times the bytes held at once, so they are hashed in parts of
    about ``part`` bytes, cut before separators."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    hashes, places, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while start < n:
        stop, step = min(start + part, n), 1 << 12
        while stop < n:  # to the next separator
            cut = np.flatnonzero(separator[data[stop : stop + step]])
            if len(cut):
                stop += int(cut[0])
                break
            stop = min(stop + step, n)
        some, at = _hash_part(data[start:stop], first[start:stop], separator)
        hashes.append(some)
        places.append(at + start)
        start = stop
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets).astype(np.int64)
