"""N-gram Jaccard join by MinHash banding.

1. Texts with equal n-gram sets are one class; its smallest row stands for it.
2. Band and row counts follow from the threshold and the target recall. Classes that
   share a band hash are chained to the bucket's smallest class: one pair a member, not
   all pairs. Chains give candidate groups.
3. In each candidate group every pair of classes is compared on full n-gram sets, in
   blocks of about ``BLOCK`` classes or ``BLOCK_NGRAMS`` n-grams at most; only counts and a spanning set of links leave a task.
   A large group is cut into blocks and each pair of blocks is a task of its own. So a pair
   is found if any chain of bands joins it: recall is that of the banding, or better.

Words are runs of other characters than space and U+0009 to U+000D, compared as they are;
an n-gram is five words; a text of one to four words has one n-gram of all of them.

Defined results: a null text or one without words is a class of its own without links;
equal rows are one class; ties go to the smallest doc_id; an empty table gives an empty
result; further columns are ignored; a null doc_id is a row like any other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import ROW_KEY, WHITE, byte_slices, flat_text, mix64, numbered_rows, own_columns, settled, small_side, stage_table, word_hashes

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 512
BLOCK = 1024
BLOCK_NGRAMS = 2_000_000
_SLAB = 2048
_STRIP = 256
_SLICE_BYTES = 1 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """The most rows a band with which bands for the recall at the threshold fit into ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' word n-grams, in order, and each text's first (m + 1)."""
    words, first = word_hashes(data, offsets, WHITE)
    counts = np.diff(first)
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1) for k in range(n)]
    total = len(words)
    if total >= n:
        sums = np.zeros(total - n + 1, np.uint64)
        for k, f in enumerate(factors):
            sums += words[k : total - n + 1 + k] * f
    else:
        sums = np.zeros(0, np.uint64)
    inside = np.zeros(len(sums), bool)
    made = np.maximum(counts - n + 1, 0)
    ends = np.append(0, np.cumsum(made))
    places = np.arange(ends[-1]) + np.repeat(first[:-1] - ends[:-1], made)
    inside[places] = True
    grams = sums[places] if len(places) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        alone = []
        for i in short:
            with np.errstate(over="ignore"):
                alone.append(sum((words[first[i] + k] * factors[k] for k in range(counts[i])), np.uint64(counts[i])))
        grams = np.insert(grams, ends[short], np.array(alone, np.uint64))
        made[short] = 1
        ends = np.append(0, np.cumsum(made))
    return mix64(grams), ends


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def min_hashes(grams: np.ndarray, first: np.ndarray, n_hashes: int) -> np.ndarray:
    """n_hashes x texts; every text has an n-gram. Each hash is an odd multiple modulo 2^32."""
    high = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n_hashes, len(first) - 1), np.uint32)
    spread = np.empty_like(high)
    for k, m in enumerate(_multipliers(n_hashes)):
        np.multiply(high, m, out=spread)
        np.minimum.reduceat(spread, first[:-1], out=out[k])
    return out


def _signatures(bands: int, rows: int, n: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in byte_slices(batch, "text", _SLICE_BYTES):
                data, offsets = flat_text(some.column("text"))
                grams, first = ngrams(data, offsets, n)
                counts = np.diff(first)
                full = np.flatnonzero(counts)
                own = some.column("row").to_numpy()
                kinds, sizes = [], np.zeros(len(counts), np.int32)
                for i in range(len(counts)):
                    if counts[i]:
                        distinct = np.unique(grams[first[i] : first[i + 1]])
                        sizes[i] = len(distinct)
                        kinds.append(hashlib.blake2b(distinct.tobytes(), digest_size=16).digest())
                    else:
                        kinds.append(b"row" + int(own[i]).to_bytes(8, "big"))
                keys = np.zeros((len(full), bands), np.uint64)
                if len(full):
                    hashes = min_hashes(grams, np.append(first[full], first[-1]), bands * rows)
                    for b in range(bands):
                        key = np.full(len(full), b + 1, np.uint64)
                        for h in hashes[b * rows : (b + 1) * rows]:
                            key = mix64(key + h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                        keys[:, b] = key
                lengths = np.where(counts > 0, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("row"),
                        some.column("doc_id"),
                        pa.array(kinds, pa.binary()),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    ["row", "doc_id", "kind", "n_ngrams", "bands"],
                )

    return sign


def _local_roots(adjacent: np.ndarray) -> np.ndarray:
    """The smallest member index of each member's component."""
    root = np.arange(len(adjacent))
    seen = np.zeros(len(adjacent), bool)
    for start in range(len(adjacent)):
        if seen[start]:
            continue
        front = np.zeros(len(adjacent), bool)
        front[start] = True
        while front.any():
            seen |= front
            root[front] = start
            front = adjacent[front].any(axis=0) & ~seen
    return root


def _distinct_grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-grams and the text's number, a few texts at a time."""
    grams, member, a = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _SLICE_BYTES, side="right")) - 1)
        some, first = ngrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
        of = np.repeat(np.arange(a, b), np.diff(first))
        order = np.lexsort((some, of))
        some, of = some[order], of[order]
        new = np.append(True, (some[1:] != some[:-1]) | (of[1:] != of[:-1]))[: len(some)]
        grams.append(some[new])
        member.append(of[new])
        a = b
    return np.concatenate(grams), np.concatenate(member)


def _compare(threshold: float, n: int):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """Links among a block's classes, or between two blocks': counts and spanning links."""
        group = group.sort_values("row").reset_index(drop=True)
        m = len(group)
        grams, member = _distinct_grams(*flat_text(pa.array(group.pop("text"), pa.large_string())), n)
        sizes = np.bincount(member, minlength=m)
        order = np.argsort(grams)
        grams, member = grams[order], member[order]
        code = np.cumsum(np.append(True, grams[1:] != grams[:-1])[: len(grams)]) - 1
        # only n-grams of two members or more count towards intersections
        shared = np.bincount(code)[code] > 1 if len(code) else np.zeros(0, bool)
        code, member = code[shared], member[shared]
        _, code = np.unique(code, return_inverse=True)
        # counts below 2^24 are exact in 32 bits
        common = np.zeros((m, m), np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64)
        width = int(code[-1]) + 1 if len(code) else 0
        for low in range(0, width, _SLAB):
            a, b = np.searchsorted(code, [low, low + _SLAB])
            slab = np.zeros((m, min(_SLAB, width - low)), np.float32)
            slab[member[a:b], code[a:b] - low] = 1
            common += slab @ slab.T
        adjacent = np.empty((m, m), bool)
        for low in range(0, m, _STRIP):
            strip = common[low : low + _STRIP].astype(np.float64)
            either = sizes[low : low + _STRIP, None] + sizes[None, :] - strip
            adjacent[low : low + _STRIP] = strip >= threshold * either - 1e-9
        del common
        np.fill_diagonal(adjacent, False)
        chunk = group["chunk"].to_numpy()
        counted = adjacent
        if group["low"].iat[0] != group["high"].iat[0]:  # pairs within a block belong to another task, even if one block is empty
            counted = adjacent & (chunk[:, None] != chunk[None, :])
        weights = group["n_docs"].to_numpy()
        root = _local_roots(counted)
        return pd.DataFrame(
            {"row": group["row"], "root": group["row"].to_numpy()[root], "classes": counted.sum(axis=1), "docs": counted @ weights}
        )

    return compare


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = NGRAM, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (smallest doc_id that links join it
    to, its own if none), copy_id (smallest doc_id with the same n-grams), n_ngrams, n_links
    (other documents at or above the threshold, copies included), n_class_links (other
    n-gram sets), keep (true for one row of all that links join), and ``ROW_KEY`` if ``docs`` has it."""
    bands, rows = choose_bands(threshold, recall)
    its_key = [c for c in docs.columns if c == ROW_KEY]
    rows_of = numbered_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *its_key), "near-rows")
    texts = rows_of.select(F.col(ROW_KEY).alias("row"), "doc_id", "text")
    signed = stage_table(
        texts.mapInArrow(_signatures(bands, rows, n), "row bigint, doc_id bigint, kind binary, n_ngrams int, bands array<bigint>"), "near-signed"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "bands", "n_ngrams"))
    classes = stage_table(
        signed.groupBy("kind").agg(first.alias("first"), F.count(F.lit(1)).alias("n_docs")).select(
            "kind", "n_docs", F.col("first.row").alias("row"), F.col("first.doc_id").alias("copy_id"), F.col("first.bands").alias("bands"), F.col("first.n_ngrams").alias("n_ngrams")
        ),
        "near-classes",
    )
    keyed = classes.select("row", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head")
    chained = keyed.join(heads, "key").where("row <> head").select(F.col("row").alias("a"), F.col("head").alias("b")).distinct()
    # a row's smallest head stands for its other heads (one a band at most): same groups, fewer pairs
    headed = stage_table(chained.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("heads")), "near-chained")
    between = headed.select(F.col("m").alias("a"), F.explode("heads").alias("b")).where("a <> b").distinct()
    groups = connected_components(headed.select("a", F.col("m").alias("b")).union(between))
    grouped = groups.join(classes.select(F.col("row").alias("node"), "n_docs", "n_ngrams"), "node")
    grouped = stage_table(grouped, "near-grouped")
    sized = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n_ngrams").alias("grams"))
    chunks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("grams") / BLOCK_NGRAMS)).cast("int")
    members = stage_table(
        grouped.join(sized, "root").select(F.col("node").alias("row"), F.col("root").alias("group"), "n_docs", chunks.alias("chunks"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk")),
        "near-members",
    )
    # a class's text is that of the row that stands for it
    its_text = texts.join(small_side(members), "row").select("row", "group", "n_docs", "chunks", "chunk", "text")
    dealt = its_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "row", "group", "n_docs", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "text"
    )
    links = stage_table(
        dealt.groupBy("group", "low", "high").applyInPandas(_compare(threshold, n), "row bigint, root bigint, classes bigint, docs bigint"), "near-links"
    )
    counts = links.groupBy("row").agg(F.sum("classes").alias("n_class_links"), F.sum("docs").alias("linked_docs"))
    joined = connected_components(links.where("row <> root").select(F.col("row").alias("a"), F.col("root").alias("b")))
    told = (
        classes.select("kind", "row", "copy_id", "n_docs")
        .join(counts, "row", "left")
        .join(joined.withColumnRenamed("node", "row"), "row", "left")
        .withColumn("root", F.coalesce("root", "row"))
    )
    told = stage_table(told, "near-told")
    heads = told.groupBy("root").agg(F.min(F.struct(F.col("copy_id").isNull().alias("no_id"), "copy_id", "row")).alias("head"))
    told = told.join(heads, "root").select(
        "kind",
        "copy_id",
        F.col("head.copy_id").alias("class_id"),
        F.col("head.row").alias("head_row"),
        (F.coalesce("linked_docs", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
        F.coalesce("n_class_links", F.lit(0)).alias("n_class_links"),
    )
    return signed.join(told, "kind").select(
        *[F.col("row").alias(c) for c in its_key], "doc_id", "class_id", "copy_id", "n_ngrams", "n_links", "n_class_links", (F.col("row") == F.col("head_row")).alias("keep")
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but one row of each group of near duplicates."""
    rows = numbered_rows(docs, "near-rows")
    kept = settled(lambda: near_duplicates(rows, **options).where("keep").select(ROW_KEY), "near-kept")
    return rows.join(small_side(kept), ROW_KEY, "left_semi").select(*own_columns(docs))
