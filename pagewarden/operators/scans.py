"""Whole scans: what the detectors find on a page, what contradicts it, and what it all adds up to."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from . import detect, dom, forms, risk, screens

_ANOMALY = "page_id, ord, type, severity, selector, content, technique, reason"


def reason(kind: Column, technique: Column) -> Column:
    """Why an anomaly of hidden text is one."""
    label = X.lookup(technique, R.TECHNIQUE_LABELS, "")
    out = F.when(kind == "OFFSCREEN_SUSPICIOUS_CONTENT", R.OFFSCREEN_REASON)
    for name, (before, after) in R.ANOMALY_REASONS.items():
        out = out.when(kind == name, F.concat(F.lit(before), label, F.lit(after)))
    return out


def anomalies(rows: DataFrame, hidden: DataFrame, injections: DataFrame, least: int = 5) -> DataFrame:
    """page_id, ord, type, severity, selector, content, technique, reason: hidden texts of ``least`` characters or more by
    what they say, and hidden interactive elements whose selector no hidden text of the page has."""
    text = F.col("text")
    known = hidden.where(F.length("text") >= least)
    confirmed = dom.invisible_injections(known, injections).select("page_id", "idx").distinct().withColumn("inj_", F.lit(True))
    targets, odd = detect.agent_targeting(text), detect.suspicious(text)
    kind = (
        F.when(F.col("inj_"), "INVISIBLE_PROMPT_INJECTION").when(targets, "HIDDEN_AGENT_INSTRUCTION").when(F.col("technique") == "offscreen", "OFFSCREEN_SUSPICIOUS_CONTENT")
        .when(odd, "DOM_VISIBILITY_MISMATCH").otherwise("CLOAKED_CONTENT")
    )
    severity = (
        F.when(F.col("type").isin("HIDDEN_AGENT_INSTRUCTION", "INVISIBLE_PROMPT_INJECTION") | targets, "critical").when(odd | (F.col("type") == "OFFSCREEN_SUSPICIOUS_CONTENT"), "high")
        .when(F.col("type") == "DOM_VISIBILITY_MISMATCH", "medium").otherwise("low")
    )
    said = known.join(confirmed, ["page_id", "idx"], "left").withColumn("type", kind).select(
        "page_id", F.col("idx").alias("ord"), "type", severity.alias("severity"), "selector", text.alias("content"), "technique", reason(F.col("type"), F.col("technique")).alias("reason")
    )
    before, after = R.INTERACTIVE_REASON
    live = dom.hidden_interactive(rows).join(said.select("page_id", "selector"), ["page_id", "selector"], "left_anti").select(
        "page_id", F.col("idx").alias("ord"), F.lit("HIDDEN_INTERACTIVE_ELEMENT").alias("type"), F.when(detect.agent_targeting(F.col("content")), "critical").otherwise("medium").alias("severity"),
        "selector", "content", F.lit(None).cast("string").alias("technique"), F.concat(F.lit(before), "element", F.lit(after)).alias("reason"),
    )
    return said.unionByName(live)


def cross_validation(found: DataFrame) -> DataFrame:
    """Of each page with anomalies: n_anomalies, hidden_injections, invisible (those that are not merely cloaked), severity (the
    highest) and mismatches (selector and reason of hidden texts that are not merely cloaked, in order)."""
    kind = F.col("type")
    told = F.when(~kind.isin("CLOAKED_CONTENT", "HIDDEN_INTERACTIVE_ELEMENT"), F.struct("ord", "selector", "reason"))
    return found.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_anomalies"), F.count_if(kind.isin("INVISIBLE_PROMPT_INJECTION", "HIDDEN_AGENT_INSTRUCTION")).alias("hidden_injections"), F.count_if(kind != "CLOAKED_CONTENT").alias("invisible"),
        X.level_of_rank(F.max(X.rank_of(F.col("severity")))).alias("severity"),
        F.transform(F.array_sort(F.collect_list(told)), lambda x: F.struct(x["selector"].alias("selector"), x["reason"].alias("reason"))).alias("mismatches"),
    )


def model_pii(spans: DataFrame, threshold: float = 0.5, key: str = "page_id") -> DataFrame:
    """Rows of personal data from a model's spans (key, label, value, start, logit): those of confidence ``threshold`` or more, once for a
    category and value, first by place. Labels that are none of the known entities drop out."""
    entities = spans.sparkSession.createDataFrame([*R.MODEL_ENTITIES], "label string, category string, risk string, action string")
    p = X.sigmoid(F.col("logit"))
    named = spans.where(p >= threshold).join(F.broadcast(entities), "label")  # a fixed list
    first = named.groupBy(key, "category", "value").agg(F.min_by(F.struct("start", "logit", "risk", "action"), F.struct("start", -F.col("logit"))).alias("s"))
    whole = first.select(key, "category", "value", "s.*")
    return whole.select(
        key, F.lit(5000).alias("ord"), "category", "value", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("value")).cast("int").alias("end"), "risk",
        (F.floor(p * 100 + 0.5) / 100).alias("confidence"), "action", F.lit("ml").alias("detected_by"), X.mask_pii(F.col("value"), F.col("category")).alias("masked"),
    )


@dataclass(frozen=True)
class Scan:
    """Detector rows of a table of pages (page_id, html), by page."""

    pages: DataFrame
    elements: DataFrame
    pii: DataFrame
    injections: DataFrame
    hidden: DataFrame
    anomalies: DataFrame
    correlations: DataFrame | None = None

    def contributions(self) -> DataFrame:
        return risk.contributions(self.pii, self.injections, self.hidden, self.anomalies, self.correlations, "page_id")

    def assessment(self) -> DataFrame:
        return risk.assess(self.pages, self.contributions(), self.correlations, "page_id")

    def legacy(self) -> DataFrame:
        return risk.legacy_risk(self.pages, self.pii, self.injections, self.hidden, self.anomalies, "page_id")

    def findings(self) -> DataFrame:
        return risk.merge_findings(risk.findings(self.pii, self.injections, self.hidden, self.anomalies, self.correlations, "page_id"), "page_id")


def scan_pages(pages: DataFrame, rows: DataFrame | None = None) -> Scan:
    """All detectors over pages (page_id, html): personal data in the source and in form fields, injections, hidden content,
    anomalies. Nothing runs before a result is asked for. ``rows`` are the pages' elements where they are stored (see
    ``sources.store``), so that no detector parses a page; else each parses for itself."""
    rows = dom.elements(pages) if rows is None else rows
    pii = detect.distinct_pii(detect.pii_matches(pages, "page_id", "html"), "page_id").withColumn("selector", F.lit(None).cast("string"))
    asked = forms.field_findings(forms.fields(rows))
    pii = pii.unionByName(asked.select(
        "page_id", (F.col("idx") + 1000).alias("ord"), "category", "value", F.lit(0).alias("start"), F.lit(0).alias("end"), "risk", "confidence", "action", F.lit("form").alias("detected_by"), "masked", "selector",
    ))
    injections = detect.injections(pages, ("page_id",), "html")
    hidden = dom.hidden_content(rows)
    return Scan(pages.select("page_id").distinct(), rows, pii, injections, hidden, anomalies(rows, hidden, injections))


def with_screens(scan: Scan, shown: DataFrame) -> Scan:
    """The scan with what screens show: ``shown`` has page_id, text and confidence of each page's read text."""
    return replace(scan, correlations=screens.correlations(shown, scan.elements, scan.injections, scan.hidden))


def with_models(scan: Scan, pages: DataFrame, spans: DataFrame | None = None) -> Scan:
    """The scan with a model's spans (see ``model_pii``) that no rule found, and with one indirect injection for each page that
    the classifier flags and no rule hits. Screens that were added stay."""
    pii = scan.pii
    if spans is not None:
        pii = detect.merge_model_pii(pii, model_pii(spans).withColumn("selector", F.lit(None).cast("string")), "page_id")
    injections = detect.merge_injections(scan.injections, pages, ("page_id",), "html")
    return replace(scan, pii=pii, injections=injections)
