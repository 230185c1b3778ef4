"""Elements of pages that a user or an agent can act on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from . import dom

CONTROLS = ("input", "select", "textarea")


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _says(text: Column) -> Column:
    return text.rlike("|".join(R.SEARCH_WORDS))


def wrapped_controls(rows: DataFrame, levels: int = 2) -> DataFrame:
    """page_id and idx of the elements that hold a form control at most ``levels`` levels down: the controls climb to their parents, one
    equal join a level."""
    parents = rows.select("page_id", F.col("idx").alias("at_"), F.col("parent_idx").alias("up_"))
    reached = rows.where(F.col("tag").isin(*CONTROLS) & F.col("parent_idx").isNotNull()).select("page_id", F.col("parent_idx").alias("at_")).distinct()
    every = reached
    for _ in range(levels - 1):
        reached = reached.join(parents, ["page_id", "at_"]).where("up_ IS NOT NULL").select("page_id", F.col("up_").alias("at_")).distinct()
        every = every.unionByName(reached)
    return every.distinct().withColumnRenamed("at_", "idx")


def _searches() -> Column:
    """Words of a search in the classes, the id or a data attribute."""
    data = F.map_values(F.map_filter("attrs", lambda k, _: k.startswith("data-")))
    return _says(F.array_join(F.split(F.trim(F.lower(_attr("class"))), r"\s+"), " ")) | _says(F.lower(_attr("id"))) | F.exists(data, lambda v: _says(F.lower(v)))


def interactive_reasons(rows: DataFrame) -> DataFrame:
    """``rows`` with ``reason``, the first rule that makes an element interactive, null for others: a large frame, a label or span around a form
    control, words of a search, tag, handler, role, a small element with a name of its own, a pointer. A label for another
    element is none, html and body are none. ``width``, ``height`` and ``cursor`` columns are used where there are any; without a cursor
    the inline style tells."""
    size = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0) for c in ("width", "height")]
    styled = F.regexp_extract(F.regexp_replace(F.lower(_attr("style")), r"\s+", ""), "(?:^|;)cursor:([^;!]*)", 1)
    cursor = F.coalesce(F.col("cursor"), styled) if "cursor" in rows.columns else styled
    tag = F.col("tag")
    named = lambda names: F.arrays_overlap(F.map_keys("attrs"), F.array(*map(F.lit, names)))
    wrapped = tag.isin("label", "span") & F.col("wraps_").isNotNull()
    reason = (
        F.when(tag.isin("html", "body"), None)
        .when(tag.isin("iframe", "frame") & (size[0] > R.FRAME_SIDE) & (size[1] > R.FRAME_SIDE), "frame")
        .when((tag == "label") & (_attr("for") != ""), None)
        .when(wrapped, "wrapper")
        .when(_searches(), "search")
        .when(tag.isin(*R.INTERACTIVE_TAGS), "tag")
        .when(named(R.INTERACTIVE_ATTRIBUTES), "handler")
        .when(F.try_element_at("attrs", F.lit("role")).isin(*R.INTERACTIVE_ROLES), "role")
        .when(size[0].between(*R.ICON_SIDES) & size[1].between(*R.ICON_SIDES) & named(R.ICON_ATTRIBUTES), "icon")
        .when(cursor == "pointer", "pointer")
    )
    wraps = wrapped_controls(rows).withColumn("wraps_", F.lit(True))
    return rows.join(wraps, ["page_id", "idx"], "left").withColumn("reason", reason).drop("wraps_")


def interactive_index(rows: DataFrame) -> DataFrame:
    """page_id, idx, tag, reason and n, the number of each visible interactive element of a page in document order."""
    seen = interactive_reasons(rows).where(F.col("reason").isNotNull() & dom.visible(F.col("attrs")))
    return seen.select("page_id", "idx", "tag", "reason", F.row_number().over(W.partitionBy("page_id").orderBy("idx")).alias("n"))
