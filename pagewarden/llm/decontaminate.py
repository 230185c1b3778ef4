"""Benchmark decontamination on a positional inverted index.

1. Test items become windows of 13 consecutive words; an item of fewer words is one window.
2. One pass over the documents stores the postings of every test word: for each document
   and word the sorted positions. The vocabulary is looked up in blocks of about
   ``MAX_WORDS`` words, cut by a hash of the word, so what a task holds does not grow with
   the test set; a larger vocabulary takes a pass for each block.
3. The stored lists tell in how many documents each word occurs. A window's words are ranked
   by that. Its rarest word's list, moved back by the word's offset, gives the candidate
   starts; they are intersected by a join with the list of the next rarest word, moved by
   its own offset, and what is left with those of all other words.
4. Starts that every list holds exactly are phrase matches. With ``slop`` a word may lie so
   many places off: starts where every word is near but not all are in place are proximity
   matches.

Nothing but the vocabulary's blocks and the number of blocks passes the driver. Windows and
candidate documents are broadcast if they are small, else joined by shuffles.

Words are runs of ASCII letters, digits and all non-ASCII characters, with A-Z lower-cased.

Defined results: a null text and one without words have no words and are not
contaminated; a null or wordless item matches nothing; equal items count each by its id;
equal rows and rows of equal or null doc_id are judged one by one; an empty table on either
side gives no hits; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ROW_KEY, byte_slices, flat_text, is_small, numbered_rows, own_columns, settled, small_side, stage_table

WINDOW = 13
#: Test words that one pass over the documents looks up, about (100 bytes each), and their bytes.
MAX_WORDS = 500_000
MAX_WORD_BYTES = 16 << 20
#: A document is contaminated if 20 times its hit words are at least its words.
PARTS = 20
_SLICE_BYTES = 4 << 20

_FOLD = np.full(256, 0x20, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _FOLD[_b] = _b
for _b in range(0x41, 0x5B):
    _FOLD[_b] = _b + 0x20


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, in order, and each text's first (n + 1)."""
    folded = _FOLD[data]
    texts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(folded)]
    )
    split = pc.split_pattern(texts, b" ")
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    return words.filter(full), before[split.offsets.to_numpy()]


# --- test items ------------------------------------------------------------


def item_words(items: DataFrame) -> DataFrame:
    """item_id (string) and words of every item that has any; each item once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = words_in(*flat_text(batch.column("text")))
            lists = pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), words.cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists.cast(pa.list_(pa.string()))], ["item_id", "words"])

    texts = items.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    return texts.mapInArrow(split, "item_id string, words array<string>").where("size(words) > 0")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, window (a hash of its words), words: the windows of every item."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    each = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("words"))
    return each.select("item_id", F.xxhash64(F.array_join("words", " ")).alias("window"), "words").distinct()


def vocabulary_of(windows: DataFrame, max_words: int = MAX_WORDS) -> tuple[DataFrame, int]:
    """word, code, block of every test word, and the number of blocks. A block is taken by the
    word's hash, so its words are about ``max_words`` at most, whichever windows they stand in."""
    words = windows.select(F.explode("words").alias("word")).distinct()
    coded = stage_table(words.withColumn("code", F.monotonically_increasing_id()), "bench-words")
    n, size = coded.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    blocks = max(1, -(-n // max_words), -(-size // MAX_WORD_BYTES))
    return coded.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int")), blocks


# --- index -----------------------------------------------------------------

_INDEX = "row bigint, doc_id bigint, n_words bigint, postings array<struct<code: bigint, places: array<int>>>"


def build_index(docs: DataFrame, words: list[str], codes: list[int]) -> DataFrame:
    """row, doc_id, n_words and postings (code of a word, its sorted positions) of every document for
    the given words; ``docs`` has row, doc_id and text."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, of = pa.array([w.encode() for w in words], pa.large_binary()), np.array(codes, np.int64)
        for batch in batches:
            for some in byte_slices(batch, "text", _SLICE_BYTES):
                told, first = words_in(*flat_text(some.column("text")))
                n = len(first) - 1
                at = pc.fill_null(pc.index_in(told, values), -1).to_numpy()
                doc = np.repeat(np.arange(n), np.diff(first))
                known = np.flatnonzero(at >= 0)
                key = doc[known] * max(len(of), 1) + at[known]
                order = np.argsort(key, kind="stable")
                key, place = key[order], (known - first[doc[known]])[order].astype(np.int32)
                head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(key)).astype(np.int32)), pa.array(place))
                posts = pa.StructArray.from_arrays([pa.array(of[key[head] % max(len(of), 1)]), lists], ["code", "places"])
                held = np.append(0, np.cumsum(np.bincount(key[head] // max(len(of), 1), minlength=n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column("row"), some.column("doc_id"), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(held), posts)],
                    ["row", "doc_id", "n_words", "postings"],
                )

    return docs.mapInArrow(index, _INDEX)


def stored_index(docs: DataFrame, vocabulary: DataFrame, blocks: int) -> DataFrame:
    """The written index of ``docs`` for all blocks, with the block of each row of it. More than
    one block takes passes that must agree on rows, so those get numbers that are written first."""
    if blocks > 1:
        docs = numbered_rows(docs, "bench-rows")
    row = F.col(ROW_KEY) if ROW_KEY in docs.columns else F.monotonically_increasing_id()
    every = None
    for block in range(blocks):
        words = vocabulary.where(F.col("block") == block).select("word", "code").toPandas()  # about MAX_WORDS rows
        named = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        table = stage_table(build_index(named, words["word"].tolist(), words["code"].tolist()), "bench-index").withColumn("block", F.lit(block))
        every = table if every is None else every.unionByName(table)
    return every


def posting_lists(index: DataFrame) -> DataFrame:
    """row, code, places: one row for each document and word."""
    return index.select("row", F.explode("postings").alias("p")).select("row", "p.code", "p.places")


def ranked_words(windows: DataFrame, vocabulary: DataFrame, lists: DataFrame) -> DataFrame:
    """window, length, rank, offset, code: a window's words from that in the fewest documents on, ties by
    word and offset; without windows of which a word occurs nowhere."""
    counts = lists.groupBy("code").agg(F.count(F.lit(1)).alias("n_docs"))
    known = vocabulary.select("word", "code").join(counts, "code")
    spread = windows.select("window", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word")).join(known, "word")
    grouped = spread.groupBy("window", "length").agg(F.array_sort(F.collect_list(F.struct("n_docs", "word", "offset", "code"))).alias("r"))
    placed = grouped.where(F.size("r") == F.col("length")).select("window", "length", F.posexplode("r").alias("rank", "p"))
    return placed.select("window", "length", "rank", "p.offset", "p.code")


def _intersect(starts: DataFrame, parts: DataFrame, n_parts: Column, lists: DataFrame, slop: int) -> DataFrame:
    """Of ``starts`` (row, window, length, start, exact) those at which the lists of all ``n_parts`` parts (window,
    offset, code) hold start + offset, ``slop`` places off at most; exact stays where none is off."""
    there = lists.select("row", "code", F.explode("places").alias("place"))
    reach = F.sequence(F.lit(-slop), F.lit(slop)) if slop else F.array(F.lit(0))
    needs = starts.join(parts, "window").withColumn("off", F.explode(reach)).withColumn("place", (F.col("start") + F.col("offset") + F.col("off")).cast("int"))
    held = needs.join(there, ["row", "code", "place"]).groupBy("row", "window", "length", "start", "exact").agg(
        F.count_distinct("offset").alias("n_"), F.count_if(F.col("off") == 0).alias("n_exact_")
    )
    return held.where(F.col("n_") == n_parts).select("row", "window", "length", "start", (F.col("exact") & (F.col("n_exact_") == n_parts)).alias("exact"))


def find_windows(index: DataFrame, ranked: DataFrame, slop: int = 0) -> DataFrame:
    """row, window, length, start, exact of every match of a window. ``ranked`` is a staged table."""
    hint = F.broadcast if is_small(ranked) else lambda df: df  # a part of a small table is small
    part = lambda ranks: ranked.where(ranks).select("window", "offset", "code")
    lead = ranked.where("rank = 0").select("window", "length", F.col("offset").alias("lead"), "code")
    led = posting_lists(index).join(hint(lead), "code").select("row", "window", "length", "lead", F.explode("places").alias("place"))
    starts = led.select("row", "window", "length", (F.col("place") - F.col("lead")).alias("start"), F.lit(True).alias("exact")).where("start >= 0")
    starts = stage_table(starts, "bench-starts")
    # lists of candidate documents alone go on
    rows = stage_table(starts.where("length > 1").select("row").distinct(), "bench-candidates")
    own = index.join(small_side(rows), "row", "left_semi")
    second = part("rank = 1")
    lists = posting_lists(own).join(hint(second.select("code").distinct()), "code", "left_semi")
    crossed = stage_table(_intersect(starts, hint(second), F.lit(1), lists, slop), "bench-crossed")
    left = stage_table(crossed.where("length > 2").select("row").distinct(), "bench-candidates")
    own = index.join(small_side(left), "row", "left_semi")
    whole = _intersect(crossed, hint(part("rank > 1")), F.col("length") - 2, posting_lists(own), slop)
    return starts.where("length = 1").union(crossed.where("length = 2")).union(whole)


def covered_words(found: DataFrame) -> DataFrame:
    """row, n_hit: words inside any found window."""
    along = W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = found.groupBy("row", "start").agg((F.col("start") + F.max("length")).cast("long").alias("end"))
    reached = spans.withColumn("reached", F.coalesce(F.max("end").over(along), F.lit(0)))
    fresh = F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))
    return reached.groupBy("row").agg(F.sum(fresh).alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0, parts: int = PARTS, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (proximity matches that are no
    phrase matches; 0 without ``slop``) for each row of ``docs``, and ``ROW_KEY`` if ``docs`` has it."""
    its_key = [c for c in docs.columns if c == ROW_KEY]
    of_items = stage_table(item_windows(item_words(items), size), "bench-windows")
    windows = of_items.select("window", "words").distinct()
    vocabulary, blocks = vocabulary_of(windows, max_words)
    index = stored_index(docs, vocabulary, blocks)
    ranked = stage_table(ranked_words(windows, vocabulary, posting_lists(index)), "bench-coded")
    found = stage_table(find_windows(index, ranked, slop), "bench-found")
    exact = found.where("exact")
    named = exact.select("row", "window").distinct().join(of_items.select("window", "item_id"), "window").select("row", "item_id").distinct()
    named = named.groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    told = named.select("row", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    near = found.where("NOT exact").groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
    hits = stage_table(covered_words(exact).join(told, "row").join(near, "row", "full_outer"), "bench-hits")
    all_rows = index.where("block = 0").select("row", "doc_id", "n_words").join(small_side(hits), "row", "left")
    n_hit = zero("n_hit")
    return all_rows.select(
        *[F.col("row").alias(c) for c in its_key],
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        zero("n_items").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (parts * n_hit >= F.col("n_words"))).alias("contaminated"),
        zero("n_near").alias("n_near"),
    )


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents."""
    rows = numbered_rows(docs, "bench-rows")
    bad = settled(lambda: contamination(rows, items, **options).where("contaminated").select(ROW_KEY), "bench-bad")
    return rows.join(small_side(bad), ROW_KEY, "left_anti").select(*own_columns(docs))
