"""Stored scans: id, url, ts, score, level. Reading, adding, trimming, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def read_pages(pages: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """Pages with a body, cut at the scan limit."""
    return pages.where(F.length(F.trim("html")) > 0).withColumn("html", F.substring("html", 1, limit))


def rejected_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("html").isNull() | (F.length(F.trim("html")) == 0)).select("page_id", F.lit("No page content").alias("error"))


def append_new(stored: DataFrame, scans: DataFrame, key: str = "id") -> DataFrame:
    """``scans`` whose id is not stored, each id once (the newest)."""
    newest = W.partitionBy(key).orderBy(F.desc("ts"), "url")
    once = scans.withColumn("n_", F.row_number().over(newest)).where("n_ = 1").drop("n_")
    return once.join(stored.select(key), key, "left_anti")


def newest(scans: DataFrame, n: int = 100, key: str = "id") -> DataFrame:
    return scans.orderBy(F.desc("ts"), key).limit(n)


def without(scans: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return scans.join(ids.select(key), key, "left_anti")


def valid_records(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Stored JSON records with a numeric version and data of string id and url; others are dropped."""
    kind = "version double, data struct<id: string, url: string>"
    parsed = raw.withColumn("rec_", F.from_json(column, kind, {"mode": "PERMISSIVE"}))
    return parsed.where(F.col("rec_.version").isNotNull() & F.col("rec_.data.id").isNotNull() & F.col("rec_.data.url").isNotNull()).select("rec_.version", "rec_.data.id", "rec_.data.url", column)


def storage_usage(records: DataFrame, json: str = "raw", warn: int = 4_000_000) -> DataFrame:
    used = F.coalesce(F.sum(F.length(json)) * 2, F.lit(0)).cast("long")
    return records.agg(used.alias("used"), (used > warn).alias("warning"))


def filter_scans(scans: DataFrame, now: Column | None = None, level: str | None = None, search: str = "", days: int = 0) -> DataFrame:
    out = scans.where(F.col("level") == level) if level else scans
    if search:
        q = search.lower()
        out = out.where(F.contains(F.lower(X.hostname(F.col("url"))), F.lit(q)) | F.contains(F.lower("url"), F.lit(q)))
    return out.where(F.unix_timestamp(F.col("ts").cast("timestamp")) >= F.unix_timestamp(now.cast("timestamp")) - days * 86400) if days else out


def stats(scans: DataFrame, today: Column) -> DataFrame:
    n = lambda level: F.count_if(F.col("level") == level).alias(f"{level}_count")
    hosts = scans.groupBy(X.hostname(F.col("url")).alias("host")).agg(F.max("score").alias("top")).agg(F.count_if(F.col("top") >= 50).alias("high_risk_domains"))
    totals = scans.agg(
        F.count(F.lit(1)).alias("total_scans"), *[n(x) for x in ("critical", "high", "medium", "low", "none")],
        F.count_if(F.to_date("ts") == today).alias("scans_today"), F.coalesce(X.half_up(F.avg("score")), F.lit(0)).alias("average_risk"),
    )
    return totals.crossJoin(hosts)  # one row each


def domain_stats(scans: DataFrame) -> DataFrame:
    """scan_count, highest score, the level of its first scan, last scan by host."""
    return scans.groupBy(X.hostname(F.col("url")).alias("hostname")).agg(
        F.count(F.lit(1)).alias("scan_count"), F.max("score").alias("highest_score"),
        F.min_by("level", F.struct(-F.col("score"), F.col("ts"), F.col("id"))).alias("highest_level"), F.max("ts").alias("last_scan"), F.min(F.struct("ts", "id")).alias("first_"),
    )


def riskiest(domains: DataFrame, k: int = 5) -> DataFrame:
    return domains.orderBy(F.desc("highest_score"), F.desc("scan_count"), "first_").limit(k).drop("first_")


def most_scanned(domains: DataFrame, k: int = 5) -> DataFrame:
    return domains.orderBy(F.desc("scan_count"), "first_").limit(k).drop("first_")


def trend(scans: DataFrame, days: int = 30) -> DataFrame:
    """Mean score and count by day, the last ``days`` days; none for fewer than two days."""
    daily = scans.groupBy(F.to_date("ts").alias("date")).agg(X.half_up(F.avg("score")).alias("avg_score"), F.count(F.lit(1)).alias("scan_count"))
    every = W.partitionBy()  # over days
    ranked = daily.withColumn("n_", F.row_number().over(W.orderBy(F.desc("date")))).withColumn("of_", F.count(F.lit(1)).over(every))
    return ranked.where(f"n_ <= {days} AND of_ >= 2").drop("n_", "of_")


def scan_view(scans: DataFrame) -> DataFrame:
    """Dashboard row: site without scheme, its first letter, injection level by score, status."""
    site = F.regexp_replace("url", "^https?://", "")
    s = F.col("score")
    level = F.when(s >= 80, "critical").when(s >= 60, "high").when(s >= 30, "medium").when(s > 0, "low").otherwise("none")
    status = F.when(F.col("level") == "critical", "critical").when(F.col("level") == "none", "clean").otherwise("warning")
    return scans.select("id", site.alias("website"), F.upper(F.left(site, F.lit(1))).alias("initial"), level.alias("injection_level"), status.alias("status"))


def one_scan(scans: DataFrame, ident, key: str = "id") -> DataFrame:
    return scans.where(F.col(key) == F.lit(ident))


def delete_scans(scans: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Each id that was asked for, and whether a scan of it was there to remove; ``without`` gives what stays."""
    return ids.select(key).distinct().join(scans.select(key).distinct().withColumn("there_", F.lit(True)), key, "left").select(key, F.coalesce("there_", F.lit(False)).alias("removed"))


def trim_records(scans: DataFrame, text: int = 10_000, blocks: int = 50, detail: int = 2_000, size: int = 50_000, short_text: int = 2_000, few_blocks: int = 10, few: int = 5) -> DataFrame:
    """Records as they are stored (id, ocr_text, ocr_blocks, details: arrays of texts, correlations: array): read text and blocks are cut where either is
    over its limit, details each; a record that is still over ``size`` (twice its JSON's length) is cut further, then its correlations."""
    over = (F.length("ocr_text") > text) | (F.size("ocr_blocks") > blocks)
    first = scans.withColumns({
        "ocr_text": F.when(over, F.substring("ocr_text", 1, text)).otherwise(F.col("ocr_text")),
        "ocr_blocks": F.when(over, F.slice("ocr_blocks", 1, blocks)).otherwise(F.col("ocr_blocks")),
        "details": F.transform("details", lambda d: F.substring(d, 1, detail)),
    })
    weight = lambda df: F.length(F.to_json(F.struct(*df.columns))) * 2
    big = weight(first) > size
    second = first.withColumn("big_", big & F.col("ocr_text").isNotNull())
    second = second.withColumns({"ocr_text": F.when(F.col("big_"), F.substring("ocr_text", 1, short_text)).otherwise(F.col("ocr_text")), "ocr_blocks": F.when(F.col("big_"), F.slice("ocr_blocks", 1, few_blocks)).otherwise(F.col("ocr_blocks"))}).drop("big_")
    return second.withColumn("big_", weight(second) > size).withColumn("correlations", F.when(F.col("big_"), F.slice("correlations", 1, few)).otherwise(F.col("correlations"))).drop("big_")


def stored_first(stored: DataFrame, current: DataFrame) -> DataFrame:
    """The stored rows; the current ones only if nothing is stored."""
    some = stored.limit(1).select(F.lit(1).alias("some_"))
    return stored.unionByName(current.join(F.broadcast(some), F.lit(True), "left_anti"))  # one row


def with_scan(found: DataFrame, scans: DataFrame, key: str = "id") -> DataFrame:
    """Detector rows of all scans with their scan's url and time."""
    return found.join(scans.select(key, "url", "ts"), key)


def save_steps(steps: DataFrame, folder: str) -> None:
    """Step histories as lines of JSON, a session's steps in one row."""
    row = F.struct("step", *[c for c in steps.columns if c not in ("session", "step")])
    steps.groupBy("session").agg(F.array_sort(F.collect_list(row)).alias("history")).write.mode("overwrite").json(folder)


def load_steps(spark, folder: str, schema: str) -> DataFrame:
    """Steps of stored histories; ``schema`` tells the columns beside session. Missing ones are null; broken lines drop out."""
    rows = spark.read.schema(f"session bigint, history array<struct<{schema}>>, bad_ string").option("columnNameOfCorruptRecord", "bad_").json(folder)
    return rows.where("history IS NOT NULL").select("session", F.explode("history").alias("h")).select("session", "h.*")


def report(scans: DataFrame, today: Column, days: int = 30, most: int = 5) -> DataFrame:
    """section, place, name, value: what a report on stored scans says: its numbers, the riskiest and the most scanned domains and the
    average risk by day, each in order."""
    rows = lambda df, section, name, value: df.select(
        F.lit(section).alias("section"), F.col("place_").cast("long").alias("place"), name.cast("string").alias("name"), value.cast("long").alias("value")
    )
    numbers = stats(scans, today)
    names = [c for c in numbers.columns]
    told = numbers.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in names])).alias("place_", "n_"))
    domains = domain_stats(scans)
    numbered = lambda df, *order: df.withColumn("place_", F.row_number().over(W.orderBy(*order)) - 1)  # noqa: E731  over a few rows
    worst = numbered(riskiest(domains, most), F.desc("highest_score"), F.desc("scan_count"), "hostname")
    usual = numbered(most_scanned(domains, most), F.desc("scan_count"), "hostname")
    daily = numbered(trend(scans, days), "date")
    return (
        rows(told, "numbers", F.col("n_.name"), F.col("n_.value"))
        .unionByName(rows(worst, "riskiest", F.col("hostname"), F.col("highest_score")))
        .unionByName(rows(usual, "most scanned", F.col("hostname"), F.col("scan_count")))
        .unionByName(rows(daily, "trend", F.col("date"), F.col("avg_score")))
    )
