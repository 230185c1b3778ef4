"""Scores and findings from detector rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X

#: Correlations that are about personal data, and those about deception.
_VISUAL = tuple(r[0] for r in R.VISUAL_REQUESTS)
_MISMATCH = ("VISUAL_DOM_MISMATCH", "HIDDEN_CONTENT_MISMATCH")


def legacy_risk(keys: DataFrame, pii: DataFrame, injections: DataFrame, hidden: DataFrame | None = None, anomalies: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Summed scores of each key: privacy, injection, hidden, visual_anomaly, overall level. The
    level looks at the injection sum before it is cut at 100."""
    weigh = lambda c, *w: F.sum(sum((F.when(F.col(c) == n, x).otherwise(0) for n, x in w), F.lit(0)))
    out = keys.select(key).distinct()
    out = out.join(pii.groupBy(key).agg(F.count(F.lit(1)).alias("n_pii")), key, "left")
    out = out.join(injections.groupBy(key).agg(weigh("severity", ("low", 10), ("medium", 25), ("high", 50), ("critical", 80)).alias("inj_sum")), key, "left")
    out = out.join(hidden.groupBy(key).agg(F.count(F.lit(1)).alias("n_hidden")), key, "left") if hidden is not None else out.withColumn("n_hidden", F.lit(0))
    anomaly = weigh("severity", ("low", 5), ("medium", 15), ("high", 35), ("critical", 60)).alias("anom_sum")
    out = out.join(anomalies.groupBy(key).agg(anomaly), key, "left") if anomalies is not None else out.withColumn("anom_sum", F.lit(0))
    cap = lambda c: F.least(F.coalesce(c, F.lit(0)), F.lit(100)).cast("long")
    privacy, hid, anom = cap(F.col("n_pii") * 20), cap(F.col("n_hidden") * 15), cap(F.col("anom_sum"))
    raw = F.coalesce("inj_sum", F.lit(0))
    return out.select(key, privacy.alias("privacy"), cap(F.col("inj_sum")).alias("injection"), hid.alias("hidden"), anom.alias("visual_anomaly"), X.legacy_level(F.greatest(privacy, raw, hid, anom)).alias("overall"))


def _weight(otherwise: int) -> Column:
    w = X.weight_of(F.col("severity"))
    return F.when(w > 0, w).otherwise(otherwise)


def contributions(
    pii: DataFrame, injections: DataFrame, hidden: DataFrame | None = None, anomalies: DataFrame | None = None, correlations: DataFrame | None = None, key: str = "doc_id"
) -> DataFrame:
    """key, source, category, score, severity, place: what speaks for a risk. PII by type; injections by type and
    first 50 characters; hidden elements by selector; anomalies by type and selector, 40 at most where a hidden element
    counts already; correlations by type (mismatches by selector too). ``place`` orders the injections."""
    by_type = pii.groupBy(key, "category").agg(F.count(F.lit(1)).alias("n"), F.min_by("risk", F.struct("ord", "start")).alias("severity"))
    none = F.lit(None).cast("struct<ord: int, start: int>")
    row = lambda source, category, score: [key, source.alias("source"), F.lit(category).alias("category"), F.least(score, F.lit(100)).cast("long").alias("score"), "severity"]
    rows = by_type.select(*row(F.concat(F.lit("PII: "), "category"), "privacy", _weight(10) + F.when(F.col("n") > 1, 5).otherwise(0)), none.alias("place"))
    first = injections.groupBy(key, "type", F.substring("content", 1, 50).alias("head")).agg(
        F.min_by("severity", F.struct("ord", "start")).alias("severity"), F.min(F.struct(F.col("ord").cast("int").alias("ord"), F.col("start").cast("int").alias("start"))).alias("place")
    )
    rows = rows.union(first.select(*row(F.concat(F.lit("Injection: "), "type"), "injection", _weight(25)), "place"))
    if hidden is not None:
        each = hidden.groupBy(key, "selector").agg(F.min_by("technique", "idx").alias("technique")).withColumn("severity", F.lit("medium"))
        rows = rows.union(each.select(*row(F.concat(F.lit("Hidden: "), "technique"), "deception", F.lit(15)), none))
    if anomalies is not None:
        once = anomalies.groupBy(key, "type", "selector").agg(F.min_by("severity", "ord").alias("severity"))
        score = _weight(15)
        if hidden is not None:
            over = hidden.select(key, "selector").distinct().withColumn("over_", F.lit(True))
            once = once.join(over, [key, "selector"], "left")
            score = F.when(F.col("over_"), F.least(_weight(15), F.lit(40))).otherwise(_weight(15))
        rows = rows.union(once.select(*row(F.concat(F.lit("Anomaly: "), "type"), "deception", score), none))
    if correlations is not None:
        seen = correlations.where(F.col("type").isin(*_VISUAL)).groupBy(key, "type").agg(F.first("severity").alias("severity"))
        rows = rows.union(seen.select(*row(F.concat(F.lit("Visual: "), "type"), "privacy", _weight(25)), none))
        off = correlations.where(F.col("type").isin(*_MISMATCH)).groupBy(key, "type", F.coalesce("selector", F.lit("visual")).alias("selector")).agg(F.first("severity").alias("severity"))
        rows = rows.union(off.select(*row(F.concat(F.lit("Visual: "), "type"), "deception", _weight(15)), none))
        rows = boost_first_injection(rows, correlations.where("type = 'CROSS_MODAL_INJECTION'"), key)
    return rows


def boost_first_injection(rows: DataFrame, confirmed: DataFrame, key: str = "doc_id") -> DataFrame:
    """15 points more, 100 at most, on the first injection row of each key in ``confirmed``; a
    row of 80 where there is none."""
    place = W.partitionBy(key, "category").orderBy("place", "source", "score")
    mark = confirmed.select(F.col(key).alias("k_")).distinct()
    marked = rows.join(mark, F.col(key) == F.col("k_"), "left").withColumn("n_", F.row_number().over(place))
    up = F.col("k_").isNotNull() & (F.col("category") == "injection") & (F.col("n_") == 1)
    lifted = marked.select(key, "source", "category", F.when(up, F.least(F.col("score") + 15, F.lit(100))).otherwise(F.col("score")).alias("score"), "severity", "place")
    bare = mark.join(rows.where("category = 'injection'").select(F.col(key).alias("k_")).distinct(), "k_", "left_anti")
    return lifted.union(bare.select("k_", F.lit("Visual: CROSS_MODAL_INJECTION"), F.lit("injection"), F.lit(80).cast("long"), F.lit("critical"), F.lit(None).cast("struct<ord: int, start: int>")))


def assess(keys: DataFrame, rows: DataFrame, correlated: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """score, level, confidence, category scores, number of contributions in all and by category (n_privacy, ...) of
    each key; category scores are maxima."""
    kinds = ("privacy", "injection", "deception")
    of = lambda c: F.col("category") == c
    tops = [F.max(F.when(of(c), F.col("score"))).alias(c) for c in kinds] + [F.count_if(of(c)).alias(f"n_{c}") for c in kinds]
    grouped = rows.groupBy(key).agg(*tops, F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("n_categories"))
    out = keys.select(key).distinct().join(grouped, key, "left").na.fill(0)
    seen = F.lit(False)
    if correlated is not None:
        out = out.join(correlated.select(key).distinct().withColumn("seen_", F.lit(True)), key, "left")
        seen = F.coalesce("seen_", F.lit(False))
    score = F.least(X.half_up(F.col("injection") * F.lit(0.4) + F.col("privacy") * F.lit(0.35) + F.col("deception") * F.lit(0.25)), F.lit(100))
    conf = F.lit(0.5) + F.when(F.col("n") >= 2, 0.15).otherwise(0.0) + F.when(F.col("n") >= 4, 0.1).otherwise(0.0) + F.when(F.col("n_categories") > 1, 0.1).otherwise(0.0) + F.when(seen, 0.15).otherwise(0.0)
    conf = F.when(F.col("n") == 0, 1.0).otherwise(F.round(F.least(conf, F.lit(1.0)), 2))
    return out.select(
        key, score.alias("score"), X.level_of_score(score).alias("level"), conf.alias("confidence"), *kinds, F.col("n").alias("n_contributions"), *[f"n_{c}" for c in kinds]
    )


def explanation(assessed: DataFrame, key: str = "doc_id") -> DataFrame:
    """explanation and recommendation of each key."""
    def part(name: str) -> Column:
        n = F.col(f"n_{name}")
        said = F.concat(F.lit(f"{name.capitalize()} risk is "), X.level_of_score(F.col(name)), F.lit(" — "), n.cast("string"), F.when(n > 1, " findings detected.").otherwise(" finding detected."))
        return F.when(F.col(name) > 0, said)

    level = F.col("level")
    head = F.concat(F.lit("Overall risk: "), F.upper(level), F.lit(" (score "), F.col("score").cast("string"), F.lit("/100)."))
    told = F.when(F.col("n_contributions") == 0, R.NO_THREATS).otherwise(F.concat_ws(" ", head, part("privacy"), part("injection"), part("deception")))
    advice = [F.when(F.col(c) >= 25, said) for c, said in (("privacy", R.PRIVACY_ACTION), ("injection", R.INJECTION_ACTION), ("deception", R.DECEPTION_ACTION))]
    whole = F.concat(X.lookup(level, R.LEVEL_ACTION, ""), F.lit(" "), F.concat_ws(" ", *advice))
    recommended = F.when(level == "none", R.NO_ACTION).when(level == "low", R.LOW_ACTION).otherwise(whole)
    return assessed.select(key, told.alias("explanation"), recommended.alias("recommendation"))


def _evidence(source: str, label: str, detail: Column, selector: Column | None = None) -> Column:
    where = F.lit(None).cast("string") if selector is None else selector
    return F.struct(F.lit(source).alias("source"), F.lit(label).alias("label"), detail.alias("detail"), where.alias("selector"))


def findings(
    pii: DataFrame, injections: DataFrame, hidden: DataFrame | None = None, anomalies: DataFrame | None = None, correlations: DataFrame | None = None, key: str = "doc_id"
) -> DataFrame:
    """Detector rows as findings of one shape: key, place (order), merge_key, title, category, severity, confidence, description,
    recommendation, evidence. ``pii`` is distinct and masked."""
    text = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    place = lambda n, *c: F.array(F.lit(n), *[F.coalesce(x.cast("int"), F.lit(0)) for x in c]).alias("place")
    label = X.lookup(F.col("category"), R.FINDING_LABELS, "Sensitive Data")
    where = F.col("selector") if "selector" in pii.columns else F.lit(None).cast("string")
    alone = text("unique:pii:", F.col("category"), ":", F.col("value"), ":", F.coalesce(where, F.lit("")))
    out = pii.select(
        key, place(0, F.col("ord"), F.col("start")), F.when(F.contains(F.lower(label), F.lit("password")), "merge:credential").otherwise(alone).alias("merge_key"), label.alias("title"),
        F.lit("privacy").alias("category"), F.col("risk").alias("severity"), "confidence", text(label, " detected in the page. ", F.col("action")).alias("description"), F.col("action").alias("recommendation"),
        F.array(_evidence("DOM", "DOM Detection", text(F.col("detected_by"), " detected ", F.col("category"), ': "', F.col("masked"), '"'), where)).alias("evidence"),
    )
    grave = F.col("severity").isin("critical", "high")
    out = out.unionByName(injections.select(
        key, place(1, F.col("ord"), F.col("start")), text("unique:injection:", F.col("ord").cast("string"), ":", F.col("start").cast("string")).alias("merge_key"), text("Prompt Injection (", F.col("type"), ")").alias("title"),
        F.lit("injection").alias("category"), "severity", F.when(F.col("severity") == "critical", 0.95).when(F.col("severity") == "high", 0.9).otherwise(0.8).alias("confidence"),
        text("A ", F.col("type"), ' prompt injection was detected: "', F.substring("content", 1, 80), '"').alias("description"),
        F.when(grave, R.INJECTION_ACTION).otherwise("Review before allowing AI agent access.").alias("recommendation"),
        F.array(_evidence("DOM", "DOM Detection", text(F.col("type"), ' prompt injection: "', F.substring("content", 1, 120), '"'))).alias("evidence"),
    ))
    deception = lambda selector: F.when(F.coalesce(selector, F.lit("")) != "", text("merge:deception:", selector))
    if hidden is not None:
        out = out.unionByName(hidden.select(
            key, place(2, F.col("idx")), deception(F.col("selector")).alias("merge_key"), text("Hidden Content (", F.col("technique"), ")").alias("title"), F.lit("deception").alias("category"), F.lit("medium").alias("severity"),
            F.lit(0.85).alias("confidence"), text("Content hidden via ", F.col("technique"), ': "', F.substring("text", 1, 100), '"').alias("description"), F.lit("Investigate hidden content before proceeding.").alias("recommendation"),
            F.array(_evidence("DOM", "Hidden Content", text("Content hidden via ", F.col("technique"), " in <", F.col("element"), ">"), F.col("selector"))).alias("evidence"),
        ))
    if anomalies is not None:
        critical = F.col("severity") == "critical"
        out = out.unionByName(anomalies.select(
            key, place(3, F.col("ord")), deception(F.col("selector")).alias("merge_key"), F.replace("type", F.lit("_"), F.lit(" ")).alias("title"), F.lit("deception").alias("category"), "severity",
            F.when(critical, 0.95).otherwise(0.85).alias("confidence"), F.col("reason").alias("description"),
            F.when(critical, "Do not allow AI agent access — hidden agent-targeting instructions detected.").otherwise(R.DECEPTION_ACTION).alias("recommendation"),
            F.array(_evidence("CROSS_VALIDATION", "Cross-Validation", F.col("reason"), F.col("selector"))).alias("evidence"),
        ))
    if correlations is not None:
        kind = F.col("type")
        category = F.when(kind == "CROSS_MODAL_INJECTION", "injection").when(kind.isin(*_MISMATCH), "deception").otherwise("privacy")
        # where the first evidence has a selector, the screen's word does not stand before it
        shared = X.lookup(kind, {"VISUAL_CREDENTIAL_REQUEST": "merge:credential", "VISUAL_PII_REQUEST": "merge:pii-visual", "VISUAL_OTP_REQUEST": "merge:otp", "VISUAL_PAYMENT_REQUEST": "merge:payment", "CROSS_MODAL_INJECTION": "merge:injection-cross"}, "")
        unseen = (kind == "HIDDEN_CONTENT_MISMATCH") & F.col("selector").isNotNull()
        merge = F.when(shared != "", shared).when(unseen, deception(F.col("selector"))).otherwise(text("unique:correlation:", kind, ":", F.coalesce("selector", F.lit("visual"))))
        seen = F.when(F.col("word").isNotNull(), _evidence("OCR", "Visual / OCR", text('"', F.col("word"), '"')))
        inside = F.when(F.col("selector").isNotNull(), _evidence("DOM", "DOM Element", text("<", F.col("element"), "> ", F.coalesce("matched", F.lit(""))), F.col("selector")))
        out = out.unionByName(correlations.select(
            key, place(4, X.lookup_rank(kind, (*_VISUAL, "CROSS_MODAL_INJECTION", *_MISMATCH)), F.col("input_idx")), merge.alias("merge_key"), F.replace("type", F.lit("_"), F.lit(" ")).alias("title"), category.alias("category"), "severity", "confidence",
            F.col("explanation").alias("description"),
            F.when(F.col("severity") == "critical", "Block AI agent interaction — high-severity cross-modal finding.").otherwise("Review finding before allowing AI agent access.").alias("recommendation"),
            F.array_compact(F.array(seen, inside, _evidence("CORRELATION", "Cross-Modal Correlation", F.col("explanation")))).alias("evidence"),
        ))
    return out


def merge_findings(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each merge key: the highest severity, the texts of the first row that holds it, the highest confidence,
    and its evidence, distinct by source and detail, in order; with the strength of the evidence."""
    parts = rows.select(key, "merge_key", "place", F.posexplode("evidence").alias("nth", "e"))
    once = parts.groupBy(key, "merge_key", "e.source", "e.detail").agg(F.min(F.struct("place", "nth", "e")).alias("first"))
    told = once.groupBy(key, "merge_key").agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["e"]).alias("evidence"), F.collect_set("source").alias("sources_"))
    rank = X.rank_of(F.col("severity"))
    text = F.struct("title", "description", "recommendation")
    grouped = rows.groupBy(key, "merge_key").agg(
        F.max(rank).alias("rank_"), F.min_by(text, F.struct((-rank).alias("r"), "place")).alias("text_"), F.min_by("category", "place").alias("category"), F.max("confidence").alias("confidence")
    )
    has = lambda s: F.array_contains("sources_", s)
    strength = F.when(has("CORRELATION") | (has("DOM") & has("OCR")), "CROSS_MODAL").when(F.size("sources_") > 1, "MULTI_SOURCE").otherwise("SINGLE_SOURCE")
    return grouped.join(told, [key, "merge_key"]).select(
        key, "merge_key", "text_.title", "category", X.level_of_rank(F.col("rank_")).alias("severity"), "confidence", "text_.description", "text_.recommendation", "evidence", strength.alias("strength")
    )
