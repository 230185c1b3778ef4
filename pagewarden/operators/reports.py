"""Reports over whole scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from .scans import Scan


def summary(found: DataFrame, assessed: DataFrame, key: str = "page_id") -> DataFrame:
    """key, summary: how many findings there are, by severity and by kind."""
    of = lambda c, v: F.count_if(F.col(c) == v)
    levels, kinds = ("critical", "high", "medium", "low"), [k for k, _ in R.SUMMARY_SENTENCES]
    counted = found.groupBy(key).agg(F.count(F.lit(1)).alias("n_"), *[of("severity", v).alias(f"{v}_") for v in levels], *[of("category", k).alias(f"{k}_") for k in kinds])
    told = assessed.select(key, "score", "level").join(counted, key, "left")
    n = F.col("n_")
    head = F.concat(
        F.lit("The scan detected "), n.cast("string"), F.when(n > 1, " security findings").otherwise(" security finding"), F.lit(" with an overall risk score of "), F.col("score").cast("string"), F.lit("/100 ("), F.upper("level"), F.lit(").")
    )
    parts = F.concat_ws(", ", *[F.when(F.col(f"{v}_") > 0, F.concat(F.col(f"{v}_").cast("string"), F.lit(f" {v}"))) for v in levels])
    said = [F.when(F.col(f"{k}_") > 0, text) for k, text in R.SUMMARY_SENTENCES]
    whole = F.concat_ws(" ", head, F.when(parts != "", F.concat(F.lit("Severity breakdown: "), parts, F.lit("."))), *said)
    return told.select(key, F.when(n.isNull(), R.NO_FINDINGS).otherwise(whole).alias("summary"))


def reports(scan: Scan, pages: DataFrame) -> DataFrame:
    """One nested row a page: page_id, url, hostname, risk (score, level, confidence, category scores), findings (most severe first), summary."""
    found, assessed = scan.findings(), scan.assessment()
    level = X.rank_of(F.col("severity"))
    row = F.struct((-level).alias("r"), "merge_key", "title", "category", "severity", "confidence", "description", "recommendation", "evidence", "strength")
    listed = found.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x.dropFields("r", "merge_key")).alias("findings"))
    risk = assessed.select("page_id", F.struct("score", "level", "confidence", "privacy", "injection", "deception").alias("risk"))
    out = pages.select("page_id", "url", X.hostname(F.col("url")).alias("hostname")).join(risk, "page_id").join(summary(found, assessed), "page_id").join(listed, "page_id", "left")
    kind = out.schema["findings"].dataType.simpleString()
    return out.withColumn("findings", F.coalesce("findings", F.array().cast(kind)))


def export_rows(made: DataFrame, at: Column) -> DataFrame:
    """page_id, file (named by the time of the scan, a text like 2024-01-01T00:00:00Z), json: what a text or JSON sink writes."""
    stamp = F.substring(F.regexp_replace(at, "[:.]", "-"), 1, 19)
    return made.select("page_id", F.concat(F.lit("report-"), stamp, F.lit(".json")).alias("file"), F.to_json(F.struct(*made.columns)).alias("json"))


def metrics(scan: Scan) -> DataFrame:
    """One row: highest privacy and injection score, numbers of personal data, injections, hidden elements, pages, critical pages."""
    one = scan.legacy().agg(F.max("privacy").alias("max_privacy"), F.max("injection").alias("max_injection"), F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("overall") == "critical").alias("n_critical"))
    for name, rows in (("n_pii", scan.pii), ("n_injections", scan.injections), ("n_hidden", scan.hidden)):
        one = one.crossJoin(rows.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return one


def recommendations(scan: Scan) -> DataFrame:
    """nth, severity, text: what is recommended for all pages together."""
    flags = scan.injections.agg(F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("critical_injection"))
    for name, rows, test in (("pii", scan.pii, F.lit(True)), ("hidden", scan.hidden, F.lit(True)), ("clean", scan.legacy(), F.col("overall") == "none")):
        flags = flags.crossJoin(rows.agg(F.coalesce(F.bool_or(test), F.lit(False)).alias(name)))  # one row each
    flags = flags.withColumn("always", F.lit(True))
    said = lambda severity, text: F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("text"))
    every = F.array_compact(F.array(*[F.when(F.col(name), said(severity, text)) for name, severity, text in R.RECOMMENDATIONS]))
    alone = F.concat(F.array(said(*R.NO_RECOMMENDATION)), every)
    return flags.select(F.posexplode(F.when(F.size(every) == 1, alone).otherwise(every)).alias("nth", "r")).select("nth", "r.severity", "r.text")
