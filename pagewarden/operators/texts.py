"""Text utilities: stripping, URLs, search, passages, vectors."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def strip_tags(html: Column, limit: int | None = None) -> Column:
    """Text without tags, scripts and styles, in single spaces; ``limit`` characters of it, or all."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    whole = F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))
    return whole if limit is None else F.substring(whole, 1, limit)


def strip_think(text: Column) -> Column:
    """Drops <think> blocks, and everything up to a stray closing tag."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s).*?</think>", ""))


def shorten_url(url: Column, keep: int = 25) -> Column:
    """Cuts a query or fragment beyond ``keep`` characters, if that makes the URL shorter."""
    at = F.instr(F.regexp_replace(url, "#", "?"), "?")
    rest = F.substring(url, at, F.length(url))
    short = F.concat(F.substring(url, F.lit(1), at - 1), F.substring(rest, 1, keep), F.lit("..."), F.left(F.md5(rest), F.lit(7)))
    return F.when((at > 0) & (F.length(rest) > keep) & (F.length(short) < F.length(url)), short).otherwise(url)


def url_map(urls: DataFrame, column: str = "url") -> DataFrame:
    """short, original of every URL that is shortened, each once."""
    pairs = urls.select(shorten_url(F.col(column)).alias("short"), F.col(column).alias("original")).where("short <> original")
    return pairs.groupBy("short").agg(F.min("original").alias("original"))


def restore_urls(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``restored``: the original of a shortened URL in ``column``, or else the value itself."""
    return rows.join(known.select(F.col("short").alias(column), F.col("original").alias("o_")), column, "left").withColumn("restored", F.coalesce("o_", column)).drop("o_")


def search(texts: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", context: int = 150, most: int | None = None) -> DataFrame:
    """The first ``most`` matches of each text, or all, with the characters around them."""
    found = X.find_all(F.coalesce(F.col(text), F.lit("")), pattern)
    found = found if most is None else F.slice(found, 1, most)
    t = F.col(text)
    around = lambda m: F.substring(t, F.greatest(m["start"] - context, F.lit(0)) + 1, m["end"] + context - F.greatest(m["start"] - context, F.lit(0)))
    return texts.select(key, text, F.posexplode(found).alias("n", "m")).select(key, "n", F.col("m.value").alias("value"), F.col("m.start").alias("start"), around(F.col("m")).alias("context"))


def passages(texts: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20) -> DataFrame:
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "raw"))
    return lines.select(key, "line", F.trim("raw").alias("passage")).where(F.length("passage") > least)


#: Queries that are compared in one pass over the vectors, and vectors that are compared at once.
QUERY_BLOCK, VECTOR_BLOCK = 1_000, 2_048


def _matrix(rows: list, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows of a length, and those rows as unit vectors; rows without direction are zero."""
    at = np.flatnonzero(lengths == length)
    m = np.array([rows[i] for i in at], float).reshape(len(at), length)
    norm = np.sqrt((m * m).sum(axis=1))
    fine = np.isfinite(norm) & (norm >= 1e-12)
    return at, np.where(fine[:, None], m, 0.0) / np.where(fine, norm, 1.0)[:, None]


def _best(query: np.ndarray, similarity: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best rows of each query: the most similar, then by id."""
    order = np.lexsort((ident, -similarity, query))
    begins = np.searchsorted(query[order], query[order], side="left")
    return order[np.arange(len(order)) - begins < k]


def top_similar(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, similarity, n: the ``k`` most similar rows of each query vector (query_id, query) by cosine, rounded to six digits; equal ones by
    vec_id. ``block`` queries at a time pass over the vectors: a task multiplies blocks of vectors by them and keeps the best of each
    query, so that only those are shuffled. Rows without a vector drop out; vectors of other lengths, without direction or with entries
    that are no numbers have similarity 0."""
    spark, out = vectors.sparkSession, None
    rows = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda e: F.coalesce(e.cast("double"), F.lit(float("nan")))).alias("embedding"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.transform("query", lambda e: F.coalesce(e.cast("double"), F.lit(float("nan")))).alias("query"))
    for some in _blocks_of(asked.toLocalIterator(), block):
        part = rows.mapInArrow(_compare(spark.sparkContext.broadcast(some), k), "query_id bigint, vec_id bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, similarity double, n int")
    best = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)


def _blocks_of(rows: Iterator, size: int) -> Iterator[list]:
    rows = iter(rows)
    while some := list(itertools.islice(rows, size)):
        yield [(r.query_id, r.query) for r in some]


def _compare(held, k: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [q for q, _ in held.value]
        asked = [v if v is not None else [] for _, v in held.value]
        sizes = np.array([len(v) for v in asked])
        matrices = {n: _matrix(asked, sizes, n) for n in set(sizes.tolist()) if n}
        state = (np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))
        for batch in batches:
            for at in range(0, batch.num_rows, VECTOR_BLOCK):
                some = batch.slice(at, VECTOR_BLOCK)
                ids, rows = some.column("vec_id"), some.column("embedding").to_pylist()
                lengths = np.array([len(r) for r in rows])
                similar = np.zeros((len(asked), len(rows)))
                for n in set(lengths.tolist()) & set(matrices):
                    mine, unit = matrices[n]
                    place, other = _matrix(rows, lengths, n)
                    similar[np.ix_(mine, place)] = unit @ other.T
                similar = np.round(np.clip(similar, -1, 1), 6) + 0.0
                least = np.partition(similar, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(asked), -2.0)
                q, v = np.nonzero(similar >= least[:, None])
                null = ids.is_null().to_numpy(zero_copy_only=False)
                number = np.where(null, np.iinfo(np.int64).min, ids.fill_null(0).to_numpy(zero_copy_only=False))
                state = tuple(np.concatenate([a, b]) for a, b in zip(state, (q, similar[q, v], number[v], null[v])))
                kept = _best(state[0], state[1], state[2], k)
                state = tuple(a[kept] for a in state)
        q, similarity, number, null = state
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], pa.int64()), pa.array(number, pa.int64(), mask=null), pa.array(similarity, pa.float64())], ["query_id", "vec_id", "similarity"])

    return compare


def relevant_passages(passages: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, context: the ``k`` passages (vec_id, passage, embedding) most similar to each query, the best first, a line each."""
    best = top_similar(passages.select("vec_id", "embedding"), queries, k)
    told = best.join(passages.select("vec_id", "passage"), "vec_id")
    lines = F.array_sort(F.collect_list(F.struct("n", "passage")))
    return told.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda l: l["passage"]), "\n").alias("context"))


def markdown_headers(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw")).where(F.col("raw").rlike("^#{1,6} "))
    return lines.select(key, "line", F.length(F.regexp_extract("raw", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("raw", "^#+ ", "")).alias("title"))
