"""A page made safe to hand on: hidden parts removed, field values and personal data replaced, injections marked, with a
log of all changes and counts of what was kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from . import dom, forms

CHANGES = "page_id bigint, step int, place bigint, type string, category string, original string, replacement string, selector string, risk string"


@dataclass(frozen=True)
class Sanitized:
    """``rows``: the elements that stay, with their attributes; ``texts``: page_id, at, text of their text nodes; ``changes``: what was
    changed (page_id, step, place, type, category, original, replacement, selector, risk), in order of step and place; ``stats``: one
    row a page."""

    rows: DataFrame
    texts: DataFrame
    changes: DataFrame
    stats: DataFrame


def category_label(category: Column) -> Column:
    return F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))


def masked_value(value: Column) -> Column:
    """Stars for four characters or fewer, else the first and last character with up to six stars between."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("*"), F.least(n - 2, F.lit(6))), F.right(value, F.lit(1))))


def shortened(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def in_body(rows: DataFrame) -> DataFrame:
    """The elements below the body; of a page that has none, all but html and what is in the head."""
    tag = F.col("tag")
    told = rows.withColumn("body_", F.max((tag == "body").cast("int")).over(W.partitionBy("page_id"))).withColumn("below_", dom.within(tag == "body", strictly=True))
    kept = told.withColumn("head_", dom.within(tag == "head")).where(F.when(F.col("body_") == 1, F.col("below_")).otherwise(~F.col("head_") & (tag != "html")))
    return kept.drop("body_", "below_", "head_")


def texts_in_body(rows: DataFrame) -> DataFrame:
    """``rows`` as :func:`in_body` gives them, and the body itself for its own texts."""
    tag = F.col("tag")
    held = rows.withColumn("body_", F.max((tag == "body").cast("int")).over(W.partitionBy("page_id"))).withColumn("below_", dom.within(tag == "body"))
    return held.withColumn("head_", dom.within(tag == "head")).where(F.when(F.col("body_") == 1, F.col("below_")).otherwise(~F.col("head_"))).drop("body_", "below_", "head_")


def unsafe_hidden(attrs: Column) -> Column:
    """Hidden by style, attribute or class, or moved off the screen."""
    attr = lambda n: F.coalesce(F.try_element_at(attrs, F.lit(n)), F.lit(""))
    style = F.regexp_replace(F.lower(attr("style")), r"\s+", "")
    prop = lambda p: F.regexp_extract(style, f"(?:^|;){p}:([^;!]*)", 1)
    far = lambda p: F.coalesce(F.regexp_extract(prop(p), r"^[-+]?\d+", 0).try_cast("double") < -1000, F.lit(False))
    hidden = (prop("display") == "none") | (prop("visibility") == "hidden") | (prop("opacity") == "0") | (attr("aria-hidden") == "true") | F.map_contains_key(attrs, "hidden")
    return hidden | ((prop("position") == "absolute") & (far("left") | far("top"))) | attr("class").rlike("sr-only|visually-hidden")


def preserved(rows: DataFrame) -> DataFrame:
    """page_id, structure_preserved, actions_preserved, text_preserved: containers, things to act on and text nodes that say something."""
    tag, attr = F.col("tag"), lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    acts = tag.isin("button", "a") | ((tag == "input") & (attr("type") == "submit")) | (attr("role") == "button")
    below = in_body(rows).groupBy("page_id").agg(F.count_if(tag.isin(*R.CONTAINERS)).alias("structure_preserved"), F.count_if(acts).alias("actions_preserved"))
    said = F.size(F.filter("texts", lambda t: F.regexp_replace(t["text"], r"^\s+|\s+$", "") != ""))
    texts = texts_in_body(rows).groupBy("page_id").agg(F.sum(said).alias("text_preserved"))
    pages = rows.select("page_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return pages.join(below, "page_id", "left").join(texts, "page_id", "left").select("page_id", *[zero(c) for c in ("structure_preserved", "actions_preserved", "text_preserved")])


def _change(step: int, place: Column, kind: str, category: Column, original: Column, by: Column, selector: Column, risk: Column) -> list[Column]:
    return [
        F.col("page_id"), F.lit(step).alias("step"), place.cast("long").alias("place"), F.lit(kind).alias("type"), category.alias("category"), original.alias("original"),
        by.alias("replacement"), selector.cast("string").alias("selector"), risk.alias("risk"),
    ]


def remove_hidden(rows: DataFrame, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Elements outside hidden ones that hold text, and the log: one row for each hidden element with text, also within others. ``listed``
    (page_id, selector) names more that are hidden, by id, name, first class or place among siblings."""
    below = in_body(rows).select("page_id", "idx")
    known = rows.join(below, ["page_id", "idx"], "left_semi")
    if listed is None:
        marked = known.where(unsafe_hidden(F.col("attrs")))
    else:
        named = listed.select("page_id", F.col("selector").alias("its_")).distinct().withColumn("listed_", F.lit(True))
        placed = known.join(dom.sibling_place(rows), ["page_id", "idx"]).withColumn("its_", dom.place_selector(1, by_name=True))
        marked = placed.join(named, ["page_id", "its_"], "left").where(unsafe_hidden(F.col("attrs")) | F.coalesce("listed_", F.lit(False))).select(*rows.columns)
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    told = dom.subtree_text(rows, marked, separator="").withColumn("text", trimmed).where("text <> ''")
    gone = marked.join(told, ["page_id", "idx"])
    log = gone.select(*_change(1, F.col("idx"), "hidden-removed", F.lit("Hidden Content"), shortened(F.col("text"), 80), F.lit(R.HIDDEN_REMOVED), forms.field_selector(), F.lit("high")))
    flags = rows.join(told.select("page_id", "idx", F.lit(True).alias("gone_")), ["page_id", "idx"], "left")
    kept = flags.withColumn("out_", dom.within(F.coalesce("gone_", F.lit(False)))).where("NOT out_").drop("gone_", "out_")
    return kept, log


def redact_fields(rows: DataFrame, pii: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values of fields replaced by category placeholders: passwords, fields whose selector ``pii`` names (its last row counts), and filled ones
    whose name or id tells what they ask for."""
    every = forms.fields(rows)
    known = pii.where("selector IS NOT NULL").groupBy("page_id", "selector").agg(F.max_by(F.struct("category", "masked", "risk"), "ord").alias("m_"))
    secret = F.col("type") == "password"
    names = F.lower(F.concat_ws(" ", F.coalesce(F.try_element_at("attrs", F.lit("name")), F.lit("")), F.coalesce(F.try_element_at("attrs", F.lit("id")), F.lit(""))))
    guess = F.when(F.trim("value") != "", X.first_match(names, R.CONTEXT_FIELDS))
    told = every.join(known, ["page_id", "selector"], "left").withColumn("category_", F.when(secret, "password_field").when(F.col("m_").isNotNull(), F.col("m_.category")).otherwise(guess))
    told = told.where("category_ IS NOT NULL").withColumn("by_", F.when(secret, "[REDACTED_PASSWORD]").otherwise(X.lookup(F.col("category_"), R.VIEW_PLACEHOLDER, "[REDACTED]")))
    log = told.select(*_change(
        2, F.col("idx"), "redaction", F.when(secret, "Password").otherwise(category_label(F.col("category_"))),
        F.when(secret, "[password value]").when(F.col("m_").isNotNull(), F.col("m_.masked")).otherwise(masked_value(F.col("value"))), F.col("by_"), F.col("selector"),
        F.when(secret, "high").when(F.col("m_").isNotNull(), F.col("m_.risk")).otherwise("medium"),
    ))
    given = told.select("page_id", "idx", secret.alias("secret_"), "by_")
    without = lambda *names: F.map_filter("attrs", lambda k, _: ~k.isin(*names))
    changed = F.when(F.col("secret_"), F.map_concat(without("value", "placeholder"), F.create_map(F.lit("value"), F.lit(""), F.lit("placeholder"), F.col("by_"))))
    changed = changed.when(F.col("by_").isNotNull(), F.map_concat(without("value"), F.create_map(F.lit("value"), F.col("by_")))).otherwise(F.col("attrs"))
    return rows.join(given, ["page_id", "idx"], "left").withColumn("attrs", changed).drop("secret_", "by_"), log


def replace_in_texts(rows: DataFrame, pii: DataFrame, injections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """page_id, at, text of a page's text nodes, in which each injection in turn is marked where it first occurs, and then each value of personal data in
    turn is replaced once in every node that holds it, and the log. All of a page's nodes are one array, through which its findings
    pass in order, so that each sees what those before it left."""
    nodes = texts_in_body(rows).where("size(texts) > 0").select("page_id", F.explode("texts").alias("t"))
    pages = nodes.groupBy("page_id").agg(F.array_sort(F.collect_list("t")).alias("n_"))
    mark = F.concat(F.lit(R.CONTEXT_MARK[0]), F.upper("severity"), F.lit(R.CONTEXT_MARK[1]), shortened(F.col("content"), 40), F.lit(R.CONTEXT_MARK[2]))
    wanted = injections.where(F.length("content") > 0).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", F.col("content").alias("value"), mark.alias("by"), F.col("severity").alias("risk"), F.lit("").alias("category"), F.lit("").alias("masked")))).alias("i_")
    )
    by = X.lookup(F.col("category"), R.VIEW_PLACEHOLDER, "[REDACTED]")
    values = pii.where("selector IS NULL AND length(value) > 0").groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct(F.struct("ord", "start").alias("ord"), "value", by.alias("by"), "risk", "category", "masked"))).alias("p_")
    )
    joined = pages.join(wanted, "page_id", "left").join(values, "page_id", "left")

    def passed(found: Column, texts: Column, everywhere: bool) -> Column:
        """Texts after all of ``found``, and of each that was met the first node that held it (from 1)."""

        def step(state: Column, m: Column) -> Column:
            first = F.array_position(F.transform(state["texts"], lambda t: F.contains(t, m["value"])), F.lit(True))
            here = (lambda i: F.lit(True)) if everywhere else (lambda i: i == first - 1)
            after = F.transform(state["texts"], lambda t, i: F.when(here(i), X.replace_first(t, m["value"], m["by"])).otherwise(t))
            return F.struct(F.when(first > 0, after).otherwise(state["texts"]).alias("texts"), F.concat(state["at"], F.array(first)).alias("at"))

        start = F.struct(texts.alias("texts"), F.array().cast("array<bigint>").alias("at"))
        return F.when(found.isNull(), start).otherwise(F.aggregate(found, start, step))

    marked = joined.withColumn("a_", passed(F.col("i_"), F.transform("n_", lambda t: t["text"]), False))
    done = marked.withColumn("b_", passed(F.col("p_"), F.col("a_.texts"), True))
    texts = done.select("page_id", F.posexplode("b_.texts").alias("k_", "text"), "n_").select("page_id", F.get("n_", F.col("k_"))["at"].alias("at"), "text")
    met = lambda found, at: F.explode(F.filter(F.zip_with(found, at, lambda m, k: F.struct(m.alias("m"), k.alias("k"))), lambda x: x["k"] > 0))
    bound = done.where("i_ IS NOT NULL").select("page_id", met("i_", "a_.at").alias("x")).select("page_id", "x.m.*")
    none = F.lit(None).cast("string")
    log = bound.select(*_change(
        3, F.col("ord"), "injection-bound", F.concat(F.lit("Injection ("), "risk", F.lit(")")), shortened(F.col("value"), 60), F.concat(F.substring("by", 1, 80), F.lit("...")), none, F.col("risk")
    ))
    replaced = done.where("p_ IS NOT NULL").select("page_id", met("p_", "b_.at").alias("x"))
    once = replaced.groupBy("page_id", "x.m.category", "x.m.masked").agg(F.min(F.struct("x.k", "x.m.ord", "x.m.by", "x.m.risk")).alias("f_"))
    log = log.unionByName(once.select(*_change(4, F.col("f_.k"), "redaction", category_label(F.col("category")), F.col("masked"), F.col("f_.by"), none, F.col("f_.risk"))))
    return texts, log


def sanitize_context(rows: DataFrame, pii: DataFrame, injections: DataFrame) -> Sanitized:
    """``pii`` has page_id, ord, start, category, value, masked, risk and selector (null for those found in texts), ``injections`` page_id, ord,
    content and severity. What is preserved is counted in the page as it came."""
    shown, hidden_log = remove_hidden(rows)
    safe, field_log = redact_fields(shown, pii)
    texts, text_log = replace_in_texts(safe, pii, injections)
    changes = hidden_log.unionByName(field_log).unionByName(text_log)
    of = lambda kind: F.count_if(F.col("type") == kind)
    counted = changes.groupBy("page_id").agg(of("redaction").alias("total_redactions"), of("injection-bound").alias("injections_bound"), of("hidden-removed").alias("hidden_removed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    kept = ("structure_preserved", "actions_preserved", "text_preserved")
    stats = preserved(rows).join(counted, "page_id", "left").select("page_id", *[zero(c) for c in ("total_redactions", "injections_bound", "hidden_removed")], *kept)
    return Sanitized(safe, texts, changes, stats)
