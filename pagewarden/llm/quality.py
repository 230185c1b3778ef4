"""Quality rules: base counts of every whole text and the log-likelihood ratio of its
hashed word n-grams between a trusted target and the raw corpus.

Only DataFrame functions. Unigrams and bigrams of lower-cased words hash into ``BUCKETS``
buckets; both multinomials are counted over all documents in one pass, which sends at
most one row for each bucket and task. A text's score is its mean log ratio for each n-gram.
A text is kept if the base rules hold and its score reaches the threshold, a parameter,
for every document alike.

Defined results: a null text has no words and fails the base rules; so does an empty
one; equal rows are judged alike; an empty corpus gives an empty result; without any trusted
row the target is uniform by smoothing; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import own_columns, small_side, stage_table

BUCKETS = 16_384
SMOOTHING = 8.0
#: Mean log ratio (nats an n-gram) from which a text is kept.
THRESHOLD = -0.12
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30

_WHITE = r"[ \t\n\x0B\f\r]+"
_TRIM = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Runs of other characters than space and U+0009 to U+000D."""
    plain = F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), "")
    rare = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f"))
    return F.when(rare, F.array_remove(F.split(text, _WHITE), "")).otherwise(plain)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def joined(hashes: Column, apart: int) -> Column:
    """Hashes of the pairs of elements that lie ``apart``."""
    n = F.size(hashes) - apart
    both = F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, apart + 1, n), lambda x, y: F.xxhash64(x, y))
    return F.when(n > 0, both).otherwise(F.array().cast("array<bigint>"))


def repeated_words(pairs: Column) -> Column:
    """Words that lie in 8-word windows found twice or more in the text, from the
    hashes of its word pairs. Two equal windows hold five equal runs of four words, so
    a text with fewer than five repeated runs has none; that spares most texts the rest."""

    def starts(placed: Column) -> Column:
        # neighbours in the order of (hash, place) tell which windows are repeated
        def place(x: Column, k: Column) -> Column:
            same = (F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"])
            return F.when(F.coalesce(F.get(placed, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(same, F.lit(False)), x["i"])

        return F.sort_array(F.array_compact(F.transform(placed, place)))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at,
            start,
            lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"), (i + WINDOW).alias("end")),
            lambda s: s["n"],
        )

    def count(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return covered(let(placed, starts))

    return let(
        joined(pairs, 2),
        lambda quads: F.when(F.size(quads) - F.size(F.array_distinct(quads)) < 5, F.lit(0)).otherwise(count(joined(quads, 4))),
    )


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_TRIM)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def with_hashes(docs: DataFrame) -> DataFrame:
    """``text_`` (null: empty), ``words_``, and 64-bit hashes of the words and of the word
    pairs, beside all columns."""
    return (
        docs.withColumn("text_", F.coalesce(F.col("text"), F.lit("")))
        .withColumn("words_", words_of(F.col("text_")))
        .withColumn("hashes_", F.transform("words_", lambda w: F.xxhash64(w)))
        .withColumn("pairs_", joined(F.col("hashes_"), 1))
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(hashed: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed beside all columns."""
    text = F.col("text_")
    return hashed.withColumns(
        {
            "n_words": F.size("hashes_").cast("long"),
            "word_chars": F.length(F.array_join("words_", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": duplicate_lines(text).cast("long"),
            "n_repeat_words": repeated_words(F.col("pairs_")).cast("long"),
        }
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def bucket_of(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: n-grams of all documents, and of those whose doc_id is in ``trusted``."""
    ids = small_side(stage_table(trusted.select(F.col("doc_id").alias("trusted_id_")).distinct(), "quality-trusted"))
    hashed = with_hashes(docs.select("doc_id", "text"))
    marked = hashed.join(ids, F.col("doc_id") == F.col("trusted_id_"), "left")
    grams = marked.select(
        F.col("trusted_id_").isNotNull().cast("long").alias("t"), F.explode(F.concat("hashes_", "pairs_")).alias("h")
    )
    return grams.groupBy(bucket_of(F.col("h"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: the array of log p_target / p_raw by bucket, ``buckets`` long."""
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")
    )
    totals = filled.agg(F.sum("raw").alias("raw_total"), F.sum("target").alias("target_total"))
    rated = filled.join(F.broadcast(totals)).select(  # totals is one row
        "bucket",
        (
            F.log((F.col("target") + smoothing) / (F.col("target_total") + smoothing * buckets))
            - F.log((F.col("raw") + smoothing) / (F.col("raw_total") + smoothing * buckets))
        ).alias("ratio"),
    )
    return rated.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"]).alias("ratios"))


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """Two structs for each row: ``doc``, all its columns as they are, and ``verdict``, the base counts,
    base_failed, quality_score and kept. So no name of ``docs`` meets one of the verdict's."""
    ratios = log_ratios(bucket_counts(docs, trusted, buckets), buckets, smoothing)
    # ``buckets`` numbers, whatever the corpus, as a constant of the scoring plan
    table = F.from_json(F.lit(ratios.select(F.to_json("ratios")).first()[0]), "array<double>")
    def total(grams: str) -> Column:
        return F.aggregate(grams, F.lit(0.0), lambda acc, h: acc + F.get(table, bucket_of(h, buckets)))

    n_grams = F.greatest(2 * F.size("hashes_") - 1, F.lit(1))
    rows = docs.select(F.struct(*own_columns(docs)).alias("doc"), "text")
    rated = base_counts(with_hashes(rows)).withColumn("quality_score", (total("hashes_") + total("pairs_")) / n_grams)
    rated = rated.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= threshold))
    return rated.select("doc", F.struct(*COUNTS, "base_failed", "quality_score", "kept").alias("verdict"))
