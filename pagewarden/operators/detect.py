"""Personal data and prompt injections in texts: one row for each match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X

_RULES: list[R.Rule] = list(R.PII_RULES)


def register_rule(rule: R.Rule) -> None:
    """Adds a rule after the built-in ones, for all later calls."""
    _RULES.append(rule)


def rule_matches(text: Column, rule: R.Rule) -> Column:
    found = X.find_all(text, rule.java, rule.guard)
    if rule.near:
        near = rule.near.replace(r"\b", R.WORD_EDGE)
        before = lambda m: F.substring(text, F.greatest(m["start"] - rule.within, F.lit(0)) + 1, F.least(m["start"], F.lit(rule.within)))
        found = F.filter(found, lambda m: before(m).rlike(near))
    if rule.check:
        test = {"luhn": X.luhn, "verhoeff": X.verhoeff}[rule.check]
        found = F.filter(found, lambda m: test(m["value"]))
    return found


def pii_matches(texts: DataFrame, key: str = "doc_id", text: str = "text", categories: tuple[str, ...] | None = None) -> DataFrame:
    """Every match of every rule: key, ord (rule), category, value, start, end, risk, confidence, action, detected_by."""
    def told(i: int, r: R.Rule):
        return lambda m: F.struct(
            F.lit(i).alias("ord"), F.lit(r.category).alias("category"), m["value"].alias("value"), m["start"].alias("start"), m["end"].alias("end"),
            F.lit(r.risk).alias("risk"), F.lit(r.confidence).alias("confidence"), F.lit(r.action).alias("action"), F.lit(r.detected_by).alias("detected_by"),
        )

    whole = F.coalesce(F.col(text), F.lit(""))
    parts = [F.transform(rule_matches(whole, r), told(i, r)) for i, r in enumerate(_RULES) if categories is None or r.category in categories]
    return texts.select(key, F.explode(F.concat(*parts)).alias("m")).select(key, "m.*")


def distinct_pii(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each (document, category, value): the first rule and place; with the masked value."""
    first = W.partitionBy(key, "category", "value").orderBy("ord", "start")
    return matches.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_").withColumn("masked", X.mask_pii(F.col("value"), F.col("category")))


def by_risk(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stable order: highest risk first, then rule and place."""
    return matches.orderBy(key, F.desc(X.rank_of(F.col("risk"))), "ord", "start")


def ranked_by_risk(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same order within each document as ``place``, for tables too large to sort as a whole."""
    order = W.partitionBy(key).orderBy(F.desc(X.rank_of(F.col("risk"))), "ord", "start")
    return matches.withColumn("place", F.row_number().over(order))


def injections(texts: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """All matches of all injection rules, none merged."""
    def told(i: int, kind: str, severity: str):
        return lambda m: F.struct(
            F.lit(i).alias("ord"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), m["value"].alias("content"), m["start"].alias("start"), m["end"].alias("end")
        )

    whole = F.coalesce(F.col(text), F.lit(""))
    parts = [F.transform(X.find_all(whole, p), told(i, t, s)) for i, (p, t, s) in enumerate(R.INJECTION_RULES)]
    return texts.select(*key, F.explode(F.concat(*parts)).alias("m")).select(*key, "m.*")


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p.replace(r"\b", R.WORD_EDGE)) for p in patterns])


def agent_targeting(text: Column) -> Column:
    return any_of(text, R.AGENT_TARGETING)


def suspicious(text: Column) -> Column:
    return any_of(text, R.SUSPICIOUS)


def injection_score(text: Column, most: int | None = None) -> Column:
    """The stub classifier in closed form: sigma(7) if a trigger word is among the words (the first ``most``), else sigma(-1)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({R.WORD_EDGE}[a-z]+{R.WORD_EDGE})"), F.lit(1))
    words = words if most is None else F.slice(words, 1, most)
    hit = F.arrays_overlap(words, F.array(*[F.lit(w) for w in R.TRIGGER_WORDS]))
    return F.when(F.coalesce(hit, F.lit(False)), X.sigmoid(F.lit(7.0))).otherwise(X.sigmoid(F.lit(-1.0)))


def score_severity(p: Column) -> Column:
    return F.when(p > 0.9, "critical").when(p > 0.75, "high").when(p > 0.6, "medium").otherwise("low")


def merge_injections(found: DataFrame, texts: DataFrame, key: tuple[str, ...], text: str = "text") -> DataFrame:
    """Rule matches win; a text without any that the classifier flags gets one indirect row."""
    p = injection_score(F.col(text))
    snippet = F.trim(F.regexp_replace(F.substring(F.col(text), 1, 120), r"\s+", " "))
    extra = texts.where(p > 0.5).join(found.select(*key).distinct(), list(key), "left_anti").select(
        *key, F.lit(-1).alias("ord"), F.lit("indirect").alias("type"), score_severity(p).alias("severity"), snippet.alias("content"), F.lit(0).alias("start"), F.least(F.length(text), F.lit(120)).alias("end")
    )
    return found.unionByName(extra)


def sanitize_prompt(texts: DataFrame, key: tuple[str, ...], text: str = "text") -> DataFrame:
    """Each detected match's first occurrence becomes ``[BLOCKED]``; blocked counts them."""
    hits = F.concat(*[F.transform(X.find_all(F.coalesce(F.col(text), F.lit("")), p), lambda m: m["value"]) for p, _, _ in R.INJECTION_RULES])

    def once(t: Column, value: Column) -> Column:
        at = F.instr(t, value)
        return F.when(at > 0, F.overlay(t, F.lit("[BLOCKED]"), at, F.length(value))).otherwise(t)

    return texts.select(*key, F.size(hits).alias("blocked"), F.aggregate(hits, F.col(text), once).alias("sanitized"))


def merge_model_pii(found: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rule matches, and model rows (same columns) whose (category, lower-cased value) no rule row has."""
    low = F.lower("value").alias("low_")
    fresh = spans.withColumn("low_", F.lower("value")).join(found.select(key, "category", low).distinct(), [key, "category", "low_"], "left_anti").drop("low_")
    return found.unionByName(fresh)


def route_intent(text: Column) -> Column:
    """(scenario, confidence) of a prompt; the first scenario whose keywords occur."""
    pair = lambda name, c: F.struct(F.lit(name).alias("scenario"), F.lit(c).alias("confidence"))
    out = None
    for name, p in R.INTENTS:
        hit = text.rlike(p.replace(r"\b", R.WORD_EDGE))
        out = F.when(hit, pair(name, 0.85)) if out is None else out.when(hit, pair(name, 0.85))
    return out.otherwise(pair("fallback", 0.4))
