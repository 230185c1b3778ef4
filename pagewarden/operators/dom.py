"""HTML pages as element rows, and relational work on them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..sources.html_tree import page_tree

ELEMENTS = (
    "page_id bigint, idx int, last_idx int, parent_idx int, depth int, tag string, attrs map<string,string>, own_text string, "
    "texts array<struct<at: int, text: string>>, first_text int, end_text int"
)
#: Bytes of pages that a task holds as Python texts, and elements that it passes on at once.
PAGE_BYTES, SOME_ELEMENTS = 4 << 20, 5_000

_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_ARROW = pa.schema(
    [(c.split()[0], _KINDS.get(c.split()[1]) or pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))) for c in ELEMENTS.replace("at: int, text", "at:int;text").split(", ")]
)


def page_slices(batch: pa.RecordBatch, column: str = "html", limit: int = PAGE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of ``column``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def element_rows(page_id: int | None, html: str | None) -> Iterator[tuple]:
    """The rows of one page, in the order of ``ELEMENTS``."""
    tree = page_tree(html)
    for idx, texts in enumerate(tree.texts):
        told = [{"at": at, "text": text} for at, text in texts]
        yield (
            page_id, idx, tree.last[idx], tree.parents[idx], tree.depths[idx], tree.tags[idx], tree.attrs[idx], "".join(text for _, text in texts), told,
            tree.first_text[idx], tree.end_text[idx],
        )


def elements(pages: DataFrame) -> DataFrame:
    """One row for each element of each page, in document order; one parse a page. The subtree of an element is the range
    ``idx`` to ``last_idx`` of the page's elements and ``first_text`` to ``end_text`` (not included) of its texts. Text outside any
    element belongs to the first body, which begins there if there is none yet."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

        for batch in batches:
            for some in page_slices(batch):
                out: list[tuple] = []
                for page_id, html in zip(some.column("page_id").to_pylist(), some.column("html").to_pylist()):
                    for row in element_rows(page_id, html):
                        out.append(row)
                        if len(out) >= SOME_ELEMENTS:
                            yield batch_of(out)
                            out = []
                if out:
                    yield batch_of(out)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(parse, ELEMENTS)


def _before(strictly: bool):
    return W.partitionBy("page_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1 if strictly else 0)


def within(top: Column, strictly: bool = False) -> Column:
    """Whether an element lies in the subtree of one for which ``top`` holds (``strictly``: below it). The furthest end of the tops so
    far tells, in one pass over a page."""
    return F.coalesce(F.max(F.when(top, F.col("last_idx"))).over(_before(strictly)) >= F.col("idx"), F.lit(False))


def nearest(top: Column, value: Column) -> Column:
    """``value`` of the element for which ``top`` holds that an element lies in; null in none. Such elements must not nest."""
    last = F.last(F.when(top, F.struct(F.col("last_idx").alias("end_"), value.alias("value_"))), ignorenulls=True).over(_before(False))
    return F.when(last["end_"] >= F.col("idx"), last["value_"])


def _number(value: Column) -> Column:
    return F.regexp_extract(value, r"^[-+]?[0-9.]+", 0).try_cast("double")


def hiding_technique(attrs: Column) -> Column:
    """How an element's own markup hides it; null if it does not. The first that applies."""
    style = F.regexp_replace(F.lower(F.coalesce(F.try_element_at(attrs, F.lit("style")), F.lit(""))), r"\s+", "")
    prop = lambda p: F.regexp_extract(style, f"(?:^|;){p}:([^;]*)", 1)
    return (
        F.when(prop("display") == "none", "display_none")
        .when(prop("visibility") == "hidden", "visibility_hidden")
        .when(_number(prop("opacity")) == 0, "opacity_zero")
        .when(F.try_element_at(attrs, F.lit("aria-hidden")) == "true", "aria_hidden")
        .when((_number(prop("width")) == 0) | (_number(prop("height")) == 0), "zero_size")
        .when(prop("position").isin("absolute", "fixed") & ((_number(prop("left")) < -1000) | (_number(prop("top")) < -1000)), "offscreen")
        .when((prop("overflow") == "hidden") & ((_number(prop("width")) <= 1) | (_number(prop("height")) <= 1)), "overflow_hidden")
    )


def visible(attrs: Column) -> Column:
    style = F.regexp_replace(F.lower(F.coalesce(F.try_element_at(attrs, F.lit("style")), F.lit(""))), r"\s+", "")
    classes = F.split(F.coalesce(F.try_element_at(attrs, F.lit("class")), F.lit("")), r"\s+")
    away = style.rlike("position:absolute") & style.rlike(r"left:-\d{4,}px")
    return ~(
        style.rlike("display:none|visibility:hidden|opacity:0(;|$)")
        | F.map_contains_key(attrs, "hidden")
        | (F.coalesce(F.try_element_at(attrs, F.lit("aria-hidden")), F.lit("")) == "true")
        | away
        | F.arrays_overlap(classes, F.array(F.lit("sr-only"), F.lit("visually-hidden")))
    )


def category(tag: Column, attrs: Column) -> Column:
    """Kind of element; an invisible one that is no script or style is hidden."""
    kind = (
        F.when(tag.isin("input", "textarea", "select"), "input")
        .when(tag == "form", "form")
        .when(tag == "button", "button")
        .when(tag == "a", "link")
        .when(tag == "iframe", "iframe")
        .when(tag == "script", "script")
        .when(tag == "style", "style")
        .when(tag.isin("img", "video", "audio", "canvas", "svg", "picture"), "media")
        .when(tag.isin("details", "summary", "dialog", "menu"), "interactive")
        .when(F.map_contains_key(attrs, "role") | F.map_contains_key(attrs, "tabindex") | F.map_contains_key(attrs, "onclick"), "interactive")
        .otherwise("structural")
    )
    return F.when(~visible(attrs) & ~kind.isin("script", "style"), "hidden").otherwise(kind)


def page_texts(rows: DataFrame) -> DataFrame:
    """page_id and its texts in order: at, text, depth (of the element)."""
    each = rows.where("own_text <> ''").select("page_id", "depth", F.explode("texts").alias("t"))
    return each.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("t.at", "t.text", "depth"))).alias("all_"))


def subtree_text(rows: DataFrame, of: DataFrame | None = None, separator: str | None = None, max_depth: int | None = None) -> DataFrame:
    """page_id, idx and the text of an element with all its descendants, in document order; of all elements, or of those in ``of``
    (page_id, idx, depth, first_text, end_text) alone, so that each costs its own slice of the page's texts. Texts are joined by single
    spaces and squeezed; with a ``separator``, joined by it as they are, the whole trimmed. ``max_depth``: of descendants so
    many levels down."""
    tops = (rows if of is None else of).select("page_id", "idx", F.col("depth").alias("top_"), "first_text", "end_text").where("end_text > first_text")
    n = F.col("end_text") - F.col("first_text")
    # a page whose texts are all there is cut by place, one that lost some by number
    whole = F.try_element_at("all_", F.lit(-1))["at"] == F.size("all_") - 1
    own = F.when(whole, F.slice("all_", F.col("first_text") + 1, n)).otherwise(F.filter("all_", lambda t: (t["at"] >= F.col("first_text")) & (t["at"] < F.col("end_text"))))
    if max_depth is not None:
        own = F.filter(own, lambda t: t["depth"] - F.col("top_") <= max_depth)
    if separator is None:
        text = F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda t: t["text"]), " "), r"\s+", " "))
    else:
        text = F.regexp_replace(F.array_join(F.transform(own, lambda t: t["text"]), separator), r"^\s+|\s+$", "")
    told = tops.join(page_texts(rows), "page_id").withColumn("n_", F.size(own))
    return told.where("n_ > 0").select("page_id", "idx", text.alias("text"))


def cut(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def hidden_content(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Hidden elements that hold text: page_id, idx, element, selector, technique, text (``limit`` characters)."""
    marked = rows.withColumn("technique", hiding_technique(F.col("attrs"))).where("technique IS NOT NULL")
    ident, names = F.try_element_at("attrs", F.lit("id")), F.trim(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")))
    classes = F.when(names != "", F.concat(F.lit("."), F.regexp_replace(names, r"\s+", "."))).otherwise("")
    selector = F.when(F.length(ident) > 0, F.concat(F.lit("#"), ident)).otherwise(F.concat("tag", classes))
    told = subtree_text(rows, marked).where("text <> ''")
    return marked.join(told, ["page_id", "idx"]).select("page_id", "idx", F.col("tag").alias("element"), selector.alias("selector"), "technique", cut(F.col("text"), limit).alias("text"))


def without_hidden(rows: DataFrame) -> DataFrame:
    """Elements outside every hidden subtree."""
    return rows.withColumn("gone_", within(~visible(F.col("attrs")))).where("NOT gone_").drop("gone_")


def tag_counts(rows: DataFrame, tags=("a", "form", "input", "button", "iframe", "script", "img", "p", "li", "b")) -> DataFrame:
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_elements"), *[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in tags])


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page_id", category(F.col("tag"), F.col("attrs")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def sibling_place(rows: DataFrame) -> DataFrame:
    """Place among siblings of the same tag; 0 if alone."""
    of = W.partitionBy("page_id", "parent_idx", "tag")
    n = F.count(F.lit(1)).over(of)
    return rows.select("page_id", "idx", F.when(n == 1, 0).otherwise(F.row_number().over(of.orderBy("idx"))).alias("place"))


def find_elements(rows: DataFrame, tag: str | None = None, css_class: str | None = None, ident: str | None = None, attr: tuple[str, str | None] | None = None, limit: int | None = None) -> DataFrame:
    """Elements by tag, class, id and attribute (name, value; None: any value), numbered by page."""
    out = rows
    if tag:
        out = out.where(F.col("tag") == tag)
    if css_class:
        out = out.where(F.array_contains(F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), r"\s+"), css_class))
    if ident:
        out = out.where(F.try_element_at("attrs", F.lit("id")) == ident)
    if attr:
        name, value = attr
        out = out.where(F.map_contains_key("attrs", name) if value is None else F.try_element_at("attrs", F.lit(name)) == value)
    out = out.withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy("idx")))
    return out if limit is None else out.where(F.col("n") <= limit)


def links(rows: DataFrame, limit: int | None = None, width: int | None = None) -> DataFrame:
    """Links with text, in document order: page_id, n, href, text; ``limit`` counts links before those without text
    drop out, ``width`` cuts texts."""
    first = find_elements(rows, "a", limit=limit)
    told = subtree_text(rows, first).where("text <> ''")
    return first.join(told, ["page_id", "idx"]).select("page_id", "n", F.try_element_at("attrs", F.lit("href")).alias("href"), cut(F.col("text"), width).alias("text"))


def invisible_injections(hidden: DataFrame, injections: DataFrame) -> DataFrame:
    """Hidden rows that contain an injection of the same page."""
    found = injections.select(F.col("page_id").alias("p_"), "content")
    return hidden.join(found, (F.col("page_id") == F.col("p_")) & F.contains("text", F.col("content")), "left_semi")


def short_selector() -> Column:
    """tag#id, else tag and first class, else the tag."""
    ident, names = F.coalesce(F.try_element_at("attrs", F.lit("id")), F.lit("")), F.trim(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")))
    return F.when(ident != "", F.concat("tag", F.lit("#"), ident)).when(names != "", F.concat("tag", F.lit("."), F.split(names, r"\s+")[0])).otherwise(F.col("tag"))


def place_selector(classes: int = 0, by_name: bool = False) -> Column:
    """For rows with ``place`` (see ``sibling_place``): tag#id, else tag[name="…"] (``by_name``), else the tag with its first ``classes`` classes, else
    tag:nth-of-type(place) among siblings of the same tag, else the tag."""
    attr = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    named = F.slice(F.filter(F.split(attr("class"), r"\s+"), lambda c: c != ""), 1, classes)
    out = F.when(attr("id") != "", F.concat("tag", F.lit("#"), attr("id")))
    if by_name:
        out = out.when(attr("name") != "", F.concat("tag", F.lit('[name="'), attr("name"), F.lit('"]')))
    if classes:
        out = out.when(F.size(named) > 0, F.concat("tag", F.lit("."), F.array_join(named, ".")))
    return out.when(F.col("place") > 0, F.concat("tag", F.lit(":nth-of-type("), F.col("place").cast("string"), F.lit(")"))).otherwise(F.col("tag"))


def element_paths(rows: DataFrame, of: DataFrame, separator: str = " > ", classes: int = 2) -> DataFrame:
    """page_id, idx, path of the elements in ``of`` (page_id, idx): the selectors (see ``place_selector``) of an element and all above it, outermost
    first. An element meets those that begin before it and end after it, by page."""
    placed = rows.join(sibling_place(rows), ["page_id", "idx"])
    steps = placed.select("page_id", F.col("idx").alias("top_"), "last_idx", "depth", place_selector(classes).alias("step_"))
    met = of.select("page_id", "idx").join(steps, "page_id").where("idx >= top_ AND idx <= last_idx")
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "step_"))), lambda s: s["step_"]), separator)
    return met.groupBy("page_id", "idx").agg(path.alias("path"))


def hidden_interactive(rows: DataFrame) -> DataFrame:
    """Links, buttons and forms that are hidden or off the screen and have text or a target: page_id, idx, element,
    selector, content."""
    attr = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    style = F.regexp_replace(F.lower(attr("style")), r"\s+", "")
    prop = lambda p: F.regexp_extract(style, f"(?:^|;){p}:([^;]*)", 1)
    hidden = (prop("display") == "none") | (prop("visibility") == "hidden") | (prop("opacity") == "0") | (attr("aria-hidden") == "true") | F.map_contains_key("attrs", "hidden")
    away = prop("position").isin("absolute", "fixed") & F.coalesce((_number(prop("left")) < -1000) | (_number(prop("top")) < -1000), F.lit(False))
    tag = F.col("tag")
    live = ((tag == "a") & F.map_contains_key("attrs", "href")) | (tag == "button") | ((tag == "input") & (F.lower(attr("type")) == "submit")) | ((tag == "form") & F.map_contains_key("attrs", "action"))
    some = rows.where(live & (hidden | away))
    told = some.join(subtree_text(rows, some), ["page_id", "idx"], "left")
    content = F.coalesce(F.nullif("text", F.lit("")), F.nullif(attr("href"), F.lit("")), F.nullif(attr("action"), F.lit("")))
    return told.select("page_id", "idx", F.col("tag").alias("element"), short_selector().alias("selector"), content.alias("content")).where("content IS NOT NULL")


def classification(rows: DataFrame) -> DataFrame:
    """page_id, idx, tag, classification: suspicious, sensitive, safe or unclassified."""
    attr = lambda n: F.lower(F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit("")))
    unseen = rows.where(~visible(F.col("attrs")))
    told = rows.join(subtree_text(rows, unseen), ["page_id", "idx"], "left")
    text = F.coalesce("text", F.lit(""))
    asks = F.col("tag").isin("input", "textarea") & (attr("type").isin(*R.SENSITIVE_INPUT_TYPES) | attr("name").rlike(R.SENSITIVE_INPUT_NAMES) | attr("id").rlike(R.SENSITIVE_INPUT_NAMES))
    hidden = F.when(text.rlike(R.SUSPICIOUS_HIDDEN) | (F.length(text) > 20), "suspicious").otherwise("unclassified")
    seen = F.when(asks, "sensitive").when(F.col("tag").isin("iframe", "script"), "suspicious").otherwise("safe")
    return told.select("page_id", "idx", "tag", F.when(visible(F.col("attrs")), seen).otherwise(hidden).alias("classification"))


def page_metadata(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """page_id, title, counts of elements by tag, text nodes, their characters (in the body), hidden elements, doctype and charset of each page."""
    tag, attr = F.col("tag"), lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    counts = {
        "n_elements": F.lit(True), "n_scripts": tag == "script", "n_styles": (tag == "style") | ((tag == "link") & (attr("rel") == "stylesheet")), "n_forms": tag == "form", "n_inputs": tag.isin("input", "textarea", "select"),
        "n_links": tag == "a", "n_images": tag == "img", "n_iframes": tag == "iframe", "n_hidden": hiding_technique(F.col("attrs")).isin("display_none", "visibility_hidden", "opacity_zero", "aria_hidden") | F.map_contains_key("attrs", "hidden"),
    }
    one = rows.groupBy("page_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.min(F.when(tag == "body", F.struct("idx", "last_idx"))).alias("body_"), F.min_by(F.trim(F.regexp_replace("own_text", r"\s+", " ")), F.when(tag == "title", F.col("idx"))).alias("title_"), F.max(F.when(tag == "meta", F.nullif(attr("charset"), F.lit("")))).alias("charset"))
    inside = rows.join(one.select("page_id", "body_"), "page_id").where(F.col("body_").isNull() | F.col("idx").between(F.col("body_.idx"), F.col("body_.last_idx")))
    texts = inside.select("page_id", F.explode("texts").alias("t")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("t.text")).alias("n_chars"))
    kind = F.nullif(F.regexp_extract("html", r"(?i)<!doctype\s+([a-z0-9]+)", 1), F.lit(""))
    named = pages.select("page_id", F.when(kind.isNotNull(), F.concat(F.lit("<!DOCTYPE "), F.lower(kind), F.lit(">"))).alias("doctype"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    told = named.join(one, "page_id", "left").join(texts, "page_id", "left")
    return told.select("page_id", F.coalesce(F.nullif("title_", F.lit("")), F.lit("(untitled)")).alias("title"), *[zero(c) for c in (*counts, "n_texts", "n_chars")], "doctype", "charset")


def node_outline(rows: DataFrame, depth: int = 4, most: int = 30, width: int = 60) -> DataFrame:
    """page_id, idx, parent_idx, depth, tag, attrs (cut at ``width``), n_children, n_chars (of the whole subtree), hidden: the elements less than ``depth`` deep,
    ``most`` children each."""
    nth = F.row_number().over(W.partitionBy("page_id", "parent_idx").orderBy("idx"))
    kids = rows.where("parent_idx IS NOT NULL").groupBy("page_id", F.col("parent_idx").alias("idx")).agg(F.count(F.lit(1)).alias("n_children"))
    kept = rows.withColumn("nth_", nth).where((F.col("depth") < depth) & (F.col("parent_idx").isNull() | (F.col("nth_") <= most)))
    # characters so far at an element's end, less those before it
    so_far = rows.select("page_id", "idx", "last_idx", "depth", F.length("own_text").alias("n_"), F.sum(F.length("own_text")).over(_before(False)).alias("sum_"))
    ends = so_far.select("page_id", F.col("idx").alias("last_idx"), F.col("sum_").alias("end_"))
    chars = so_far.where(F.col("depth") < depth).join(ends, ["page_id", "last_idx"]).select("page_id", "idx", (F.col("end_") - F.col("sum_") + F.col("n_")).alias("n_chars"))
    shown = F.transform_values("attrs", lambda k, v: F.when(F.length(v) > width, F.concat(F.substring(v, 1, width), F.lit("..."))).otherwise(v))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return kept.join(kids, ["page_id", "idx"], "left").join(chars, ["page_id", "idx"], "left").select(
        "page_id", "idx", "parent_idx", "depth", "tag", shown.alias("attrs"), zero("n_children"), zero("n_chars"), (~visible(F.col("attrs"))).alias("hidden")
    )


def extract_text(rows: DataFrame, tag: str = "body", limit: int | None = None) -> DataFrame:
    """page_id, text of each page's first element of a tag; cut at ``limit`` characters and marked."""
    first = rows.where(F.col("tag") == tag).groupBy("page_id").agg(F.min(F.struct("idx", "depth", "first_text", "end_text")).alias("f_")).select("page_id", "f_.*")
    told = subtree_text(rows, first)
    text = F.col("text")
    return told.select("page_id", (text if limit is None else F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("[...truncated]"))).otherwise(text)).alias("text"))


def page_statistics(rows: DataFrame) -> DataFrame:
    """links, iframes, images, interactive, total and text_chars of each page."""
    live = F.col("tag").isin("a", "button", "input", "select", "textarea") | F.map_contains_key("attrs", "onclick")
    of = lambda t: F.count_if(F.col("tag") == t)
    return rows.groupBy("page_id").agg(of("a").alias("links"), of("iframe").alias("iframes"), of("img").alias("images"), F.count_if(live).alias("interactive"), F.count(F.lit(1)).alias("total"), F.sum(F.length(F.trim("own_text"))).alias("text_chars"))


def buttons(rows: DataFrame) -> DataFrame:
    """page_id, idx, text of buttons, submit inputs and elements in the role of a button."""
    attr = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    some = rows.where((F.col("tag") == "button") | ((F.col("tag") == "input") & (F.lower(attr("type")) == "submit")) | (attr("role") == "button"))
    told = some.join(subtree_text(rows, some), ["page_id", "idx"], "left")
    return told.select("page_id", "idx", F.coalesce(F.nullif("text", F.lit("")), attr("value")).alias("text"))


def form_inputs(rows: DataFrame) -> DataFrame:
    """page_id, form_idx, action, method, n_inputs of every form."""
    attr = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    fields = rows.where(F.col("tag").isin("form", "input", "textarea", "select")).withColumn("form_", nearest(F.col("tag") == "form", F.col("idx")))
    held = fields.where("tag <> 'form'").groupBy("page_id", F.col("form_").alias("idx")).agg(F.count(F.lit(1)).alias("n_"))
    every = rows.where("tag = 'form'").select("page_id", "idx", attr("action").alias("action"), F.lower(F.coalesce(F.nullif(attr("method"), F.lit("")), F.lit("get"))).alias("method"))
    return every.join(held, ["page_id", "idx"], "left").select("page_id", F.col("idx").alias("form_idx"), "action", "method", F.coalesce("n_", F.lit(0)).cast("long").alias("n_inputs"))
