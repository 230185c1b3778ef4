"""Form fields of element rows (see dom.elements): what they hold and how it is redacted. What belongs to a page is found by windows over the
page; sides that are joined grow with the pages and are merged, as Spark takes exploded rows for as small as their files and would broadcast them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from . import dom


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def field_selector() -> Column:
    """tag#id, else tag[name="…"], else tag.class, else the tag."""
    first = F.split(F.trim(_attr("class")), r"\s+")[0]
    tag = F.col("tag")
    return (
        F.when(_attr("id") != "", F.concat(tag, F.lit("#"), _attr("id")))
        .when(_attr("name") != "", F.concat(tag, F.lit('[name="'), _attr("name"), F.lit('"]')))
        .when(first != "", F.concat(tag, F.lit("."), first))
        .otherwise(tag)
    )


def fields(rows: DataFrame) -> DataFrame:
    """Inputs, text areas and selects: page_id, idx, tag, attrs, selector, type (lower case, '' without
    one), names, value. A select has the value of its selected option, or else of its first."""
    names = F.lower(F.concat_ws(" ", _attr("name"), _attr("id"), _attr("aria-label"), _attr("placeholder")))
    own = F.when(F.col("tag") == "textarea", F.coalesce("own_text", F.lit(""))).otherwise(_attr("value"))
    told = F.coalesce(F.try_element_at("attrs", F.lit("value")), F.trim("own_text"))
    tag, option = F.col("tag"), F.col("tag") == "option"
    picks = rows.where(tag.isin("input", "textarea", "select", "option")).withColumn("select_", F.when(tag.isin("select", "option"), dom.nearest(tag == "select", F.col("idx"))))
    rank = F.struct(~F.map_contains_key("attrs", "selected"), "idx")
    chosen = F.min_by(told, F.when(option, rank)).over(W.partitionBy("page_id", "select_"))
    value = F.when(tag == "select", F.coalesce(chosen, F.lit(""))).otherwise(own)
    every = picks.select("page_id", "idx", "tag", "attrs", field_selector().alias("selector"), F.lower(_attr("type")).alias("type"), names.alias("names"), value.alias("value"))
    return every.where(~option)


def _first_rule(names: Column, rules: tuple) -> Column:
    out = None
    for category, pattern, risk, action in rules:
        hit = F.struct(F.lit(category).alias("category"), F.lit(risk).alias("risk"), F.lit(action).alias("action"))
        out = F.when(names.rlike(pattern), hit) if out is None else out.when(names.rlike(pattern), hit)
    return out


def field_findings(every: DataFrame) -> DataFrame:
    """Password fields and fields that ask for personal data, the first rule each; one row for a category and selector of a page."""
    secret = (F.col("tag") == "input") & (F.col("type") == "password")
    rule = _first_rule(F.col("names"), R.FIELD_RULES)
    filled = F.trim("value") != ""
    label = F.col("rule_.category")
    seen = every.withColumn("secret_", secret).withColumn("rule_", F.when(~F.col("type").isin("password", "hidden", "submit", "button"), rule)).where("secret_ OR rule_ IS NOT NULL")
    pick = lambda a, b: F.when(F.col("secret_"), a).otherwise(b)
    found = seen.select(
        "page_id", "idx", "tag", "selector", pick(F.lit("password_field"), label).alias("category"),
        pick(F.lit("[password input]"), F.when(filled, F.col("value")).otherwise(F.concat(F.lit("["), label, F.lit(" field]")))).alias("value"),
        pick(F.lit("[PASSWORD FIELD]"), F.when(filled, X.mask_pii(F.col("value"), label)).otherwise(F.concat(F.lit("["), F.upper(label), F.lit(" FIELD]")))).alias("masked"),
        pick(F.lit(1.0), F.when(filled, 0.92).otherwise(0.75)).alias("confidence"),
        pick(F.lit("high"), F.col("rule_.risk")).alias("risk"),
        pick(F.lit("Ensure value is never captured or transmitted"), F.col("rule_.action")).alias("action"),
    )
    order = W.partitionBy("page_id", "category", "selector").orderBy("idx")
    return found.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def field_category() -> Column:
    """Category of a field whose value is redacted; null if its names say nothing."""
    ahead = tuple(r for r in R.FIELD_RULES if r[0] in R.FIELD_FIRST)
    rest = tuple(r for r in R.FIELD_RULES if r[0] not in R.FIELD_FIRST)
    return F.when(F.col("type") == "password", "password_field").when(F.col("type") != "hidden", _first_rule(F.col("names"), ahead + rest)["category"])


def _numbered(order: list[str | Column]) -> Column:
    n = (F.row_number().over(W.partitionBy("page_id", "prefix_").orderBy(*order)) + F.col("used_")).cast("string")
    return F.concat(F.lit("["), "prefix_", F.lit("_"), F.when(F.length(n) >= 3, n).otherwise(F.lpad(n, 3, "0")), F.lit("]"))


def _used(marks: DataFrame) -> DataFrame:
    """The highest number of each prefix of a page's placeholders."""
    part = lambda i: F.regexp_extract("placeholder", r"^\[([A-Z]+)_(\d+)\]$", i)
    return marks.select("page_id", part(1).alias("prefix_"), part(2).try_cast("int").alias("n_")).groupBy("page_id", "prefix_").agg(F.max("n_").alias("used_"))


def _with_used(rows: DataFrame, marks: DataFrame | None) -> DataFrame:
    if marks is None:
        return rows.withColumn("used_", F.lit(0))
    return rows.join(_used(marks).hint("merge"), ["page_id", "prefix_"], "left").withColumn("used_", F.coalesce("used_", F.lit(0)))


def form_redactions(every: DataFrame, findings: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """page_id, idx, selector, category, original, placeholder, fresh: each password field with a number of
    its own, then each other filled field. A value that ``marks`` (page_id, value, placeholder) or an earlier
    field holds keeps that placeholder (not fresh); numbers go on after those of ``marks``."""
    secret = (F.col("tag") == "input") & (F.col("type") == "password")
    held = ~F.col("type").isin("password", "submit", "button", "reset", "image") & (F.trim("value") != "")
    # the finding of the same selector decides first, password fields before others
    rank = F.struct(F.col("category") != "password_field", "idx")
    told = findings.groupBy("page_id", "selector").agg(F.min_by("category", rank).alias("told_"))
    category = F.when(secret, "password_field").otherwise(F.coalesce("told_", field_category(), F.lit("custom")))
    known = every.where(secret | held).join(told.hint("merge"), ["page_id", "selector"], "left").select("page_id", "idx", "selector", "value", secret.alias("secret_"), category.alias("category"))
    known = known.withColumn("prefix_", X.placeholder_prefix(F.col("category")))
    if marks is None:
        known = known.withColumn("marked_", F.lit(None).cast("string"))
    else:
        known = known.join(marks.groupBy("page_id", "value").agg(F.min("placeholder").alias("marked_")).hint("merge"), ["page_id", "value"], "left")
    known = _with_used(known, marks).repartition("page_id")
    same = W.partitionBy("page_id", "secret_", "value")
    first = F.row_number().over(same.orderBy("idx")) == 1
    known = known.withColumn("fresh", F.col("secret_") | (first & F.col("marked_").isNull()))
    new = known.withColumn("new_", F.when(F.col("fresh"), _numbered([~F.col("fresh"), ~F.col("secret_"), "idx"])))
    placeholder = F.coalesce("new_", "marked_", F.max("new_").over(same))
    original = F.when(F.col("secret_"), "[password value]").otherwise(F.col("value"))
    return new.select("page_id", "idx", "selector", "category", original.alias("original"), placeholder.alias("placeholder"), "fresh")


def with_values_redacted(rows: DataFrame, redactions: DataFrame) -> DataFrame:
    """Element rows whose value attributes are their placeholders; of password fields they are empty."""
    by = redactions.select("page_id", "idx", F.when(F.col("category") == "password_field", F.lit("")).otherwise(F.col("placeholder")).alias("by_"))
    kept = F.map_filter("attrs", lambda k, _: ~k.isin("value", "data-sanitized"))
    changed = F.map_concat(kept, F.create_map(F.lit("value"), F.col("by_"), F.lit("data-sanitized"), F.lit("true")))
    return rows.join(by.hint("merge"), ["page_id", "idx"], "left").withColumn("attrs", F.when(F.col("by_").isNotNull(), changed).otherwise(F.col("attrs"))).drop("by_")


def sensitive_attribute(name: Column, value: Column) -> Column:
    """Sensitive by name, or not on the safe list and by a value longer than 8."""
    return name.rlike(R.SENSITIVE_ATTRIBUTE) | (~F.lower(name).isin(*R.SAFE_ATTRIBUTES) & value.rlike(R.SENSITIVE_ATTRIBUTE_VALUE) & (F.length(value) > 8))


def attribute_redactions(rows: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """page_id, idx, name, original, placeholder: a SENSITIVE number for each sensitive attribute, after those of ``marks`` (page_id, placeholder)."""
    each = rows.select("page_id", "idx", F.posexplode(F.map_entries("attrs")).alias("at_", "e_")).select("page_id", "idx", "at_", F.col("e_.key").alias("name"), F.col("e_.value").alias("original"))
    found = _with_used(each.where(sensitive_attribute(F.col("name"), F.col("original"))).withColumn("prefix_", F.lit("SENSITIVE")), marks)
    return found.select("page_id", "idx", "name", "original", _numbered(["idx", "at_"]).alias("placeholder"))


def mark_injections(rows: DataFrame, injections: DataFrame) -> DataFrame:
    """page_id, at, text of every text node, in which the first occurrence of each injection (page_id, ord,
    content, severity) of the page is replaced, in the first node that holds it. Of injections that overlap, the first by ``ord`` wins."""
    nodes = rows.select("page_id", F.explode("texts").alias("t_")).select("page_id", "t_.at", "t_.text")
    said = F.concat(F.lit("[UNTRUSTED CONTENT BLOCKED — "), F.upper("severity"), F.lit("]"))
    wanted = injections.where(F.length("content") > 0).select("page_id", "ord", "content", said.alias("mark"))
    hits = nodes.join(wanted, "page_id").where(F.contains("text", F.col("content"))).groupBy("page_id", "ord", "content", "mark").agg(F.min("at").alias("at"))
    by_node = hits.groupBy("page_id", "at").agg(F.array_sort(F.collect_list(F.struct("ord", "content", "mark"))).alias("marks_"))
    none = F.array().cast("array<struct<ord: int, content: string, mark: string>>")
    marked = F.aggregate(F.coalesce(F.col("marks_").cast("array<struct<ord: int, content: string, mark: string>>"), none), F.col("text"), lambda t, m: X.replace_first(t, m["content"], m["mark"]))
    return nodes.join(by_node, ["page_id", "at"], "left").select("page_id", "at", marked.alias("text"))
