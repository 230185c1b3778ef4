"""What a screen shows against what its page holds: read text with inputs, boxes, scrolling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..functions.ordered import fold_by_key
from .forms import field_selector


def first_word(normal: Column, words: tuple[str, ...]) -> Column:
    """The first of ``words``, in their order, that a normalised text holds; null if none."""
    return F.coalesce(*[F.when(F.contains(normal, F.lit(w)), F.lit(w)) for w in words])


def inputs_of(elements: DataFrame) -> DataFrame:
    """page_id, idx, type and the joined names of each input, all in lower case."""
    attr = lambda n: F.lower(F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit("")))
    names = F.concat_ws(" ", *[attr(n) for n in ("name", "id", "placeholder", "aria-label", "autocomplete")])
    return elements.where(F.col("tag").isin("input", "textarea", "select")).select("page_id", "idx", attr("type").alias("type"), names.alias("names"))


def _wanted(kind: str, pattern: str) -> Column:
    hit = F.col("names").rlike(pattern)
    if kind == "VISUAL_CREDENTIAL_REQUEST":
        return hit | (F.col("type") == "password")
    return hit | F.contains("names", F.lit("one-time-code")) | F.col("type").isin("tel", "number") if kind == "VISUAL_OTP_REQUEST" else hit


def visual_requests(screens: DataFrame, inputs: DataFrame) -> DataFrame:
    """page_id, type, severity, confidence, word, input_idx (first matching input; null if none) of each
    request that a screen (page_id, text, confidence) shows, and of sensitive words without an input."""
    firsts = [F.min_by(F.struct("idx", "type"), F.when(_wanted(r[0], r[5]), F.col("idx"))).alias(f"in{i}_") for i, r in enumerate(R.VISUAL_REQUESTS)]
    taken = F.bool_or((F.col("type") == "file") | F.col("names").rlike(R.SENSITIVE_INPUT)).alias("takes_")
    joined = screens.where(F.trim("text") != "").join(inputs.groupBy("page_id").agg(*firsts, taken), "page_id", "left").withColumn("n_", X.normalize(F.col("text")))
    row = lambda kind, severity, base, strength, word, idx: F.struct(
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"), X.correlation_confidence(F.lit(base), F.col("confidence"), strength).alias("confidence"), word.alias("word"), idx.cast("int").alias("input_idx")
    )
    found = []
    for i, (kind, severity, base, weak, words, _) in enumerate(R.VISUAL_REQUESTS):
        own, word = F.col(f"in{i}_"), first_word(F.col("n_"), words)
        if weak is None:
            strength = F.when(own["type"] == "password", 1.0).otherwise(0.85)
            found.append(F.when(word.isNotNull() & own["idx"].isNotNull(), row(kind, severity, base, strength, word, own["idx"])))
        else:
            strength = F.when(own["idx"].isNotNull(), 1.0).otherwise(weak)
            found.append(F.when(word.isNotNull(), row(kind, severity, base, strength, word, own["idx"])))
    word = first_word(F.col("n_"), R.VISUAL_SENSITIVE)
    found.append(F.when(word.isNotNull() & ~F.coalesce("takes_", F.lit(False)), row("VISUAL_DOM_MISMATCH", "medium", 0.75, F.lit(0.8), word, F.lit(None))))
    return joined.select("page_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("page_id", "f.*")


def overlapping_boxes(boxes: DataFrame, least: float = 0.5, cell: float = 64.0) -> DataFrame:
    """Pairs a < b of boxes (image_id, box_id, x, y, width, height) of an image with intersection over
    union above ``least``. Boxes meet in grid cells, so only near ones are paired."""
    at = lambda c, size: F.sequence(F.floor(F.col(c) / cell), F.floor((F.col(c) + F.col(size)) / cell))
    cells = boxes.withColumn("cx", F.explode(at("x", "width"))).withColumn("cy", F.explode(at("y", "height")))
    a, b = cells.alias("a"), cells.alias("b")
    pair = a.join(b, ["image_id", "cx", "cy"]).where("a.box_id < b.box_id")
    side = lambda p, s: F.greatest(F.least(F.col(f"a.{p}") + F.col(f"a.{s}"), F.col(f"b.{p}") + F.col(f"b.{s}")) - F.greatest(f"a.{p}", f"b.{p}"), F.lit(0.0))
    inter = side("x", "width") * side("y", "height")
    # a pair is reported in the cell of its common corner alone
    here = (F.col("cx") == F.floor(F.greatest("a.x", "b.x") / cell)) & (F.col("cy") == F.floor(F.greatest("a.y", "b.y") / cell))
    iou = inter / (F.col("a.width") * F.col("a.height") + F.col("b.width") * F.col("b.height") - inter)
    return pair.where(here & (inter > 0)).select("image_id", F.col("a.box_id").alias("a"), F.col("b.box_id").alias("b"), iou.alias("iou")).where(F.col("iou") > least)


def scroll_info(top: Column, height: Column, visible: Column) -> Column:
    """above, below, percent, pages_above, pages_below, total_pages along one side."""
    above, below = F.greatest(top, F.lit(0)), F.greatest(height - visible - top, F.lit(0))
    pages = lambda x, other: F.when(visible > 0, F.round(x / visible, 1)).otherwise(F.lit(other))
    percent = F.when(height > visible, F.round(top / (height - visible) * 100, 1)).otherwise(F.lit(0.0))
    return F.struct(above.alias("above"), below.alias("below"), percent.alias("percent"), pages(above, 0.0).alias("pages_above"), pages(below, 0.0).alias("pages_below"), pages(height, 1.0).alias("total_pages"))


def scrollable(tag: Column, scroll_height: Column, client_height: Column, scroll_width: Column, client_width: Column, overflow: Column) -> Column:
    """Content exceeds its box by more than a pixel, and the style, or without one the tag, lets it scroll."""
    larger = (scroll_height > client_height + 1) | (scroll_width > client_width + 1)
    lets = F.when(overflow.isNull(), F.lower(tag).isin("div", "main", "section", "article", "aside", "body", "html")).otherwise(F.lower(overflow).isin("auto", "scroll", "overlay"))
    return F.coalesce(larger & lets, F.lit(False))


def sensitive_field(attrs: Column) -> Column:
    """Fields whose live value must not be kept: by type, or autocomplete of cards and one-time codes."""
    attr = lambda n: F.lower(F.coalesce(F.try_element_at(attrs, F.lit(n)), F.lit("")))
    return attr("type").isin("password", "file", "hidden") | attr("autocomplete").startswith("cc-") | attr("autocomplete").startswith("one-time-code")


def hidden_mismatches(hidden: DataFrame, screens: DataFrame) -> DataFrame:
    """Hidden text (page_id, idx, text) of whose longer words, in the first 80 characters, fewer than 30 % occur
    in what the page's screen (page_id, text, confidence) shows: page_id, idx, severity, confidence, ratio."""
    shown = screens.where(F.trim("text") != "").select("page_id", X.normalize(F.col("text")).alias("shown_"), "confidence")
    own = F.substring(X.normalize(F.col("text")), 1, 80)
    words = F.filter(F.split("own_", " "), lambda w: F.length(w) > 3)
    joined = hidden.withColumn("own_", own).where(F.length("own_") >= 5).withColumn("words_", words).where(F.size("words_") > 0).join(shown, "page_id")
    ratio = F.size(F.filter("words_", lambda w: F.contains(F.col("shown_"), w))) / F.size("words_")
    odd = first_word(F.col("own_"), R.INJECTION_KEYWORDS).isNotNull()
    found = joined.withColumn("ratio", ratio).where("ratio < 0.3")
    return found.select("page_id", "idx", F.when(odd, "high").otherwise("low").alias("severity"), X.correlation_confidence(F.lit(0.85), F.col("confidence"), 1 - F.col("ratio")).alias("confidence"), "ratio")


def _click_box() -> Column:
    role = F.try_element_at("attrs", F.lit("role"))
    tests = [F.col("tag") == t if r is None else (F.col("tag") == t) & F.coalesce(role == r, F.lit(False)) for t, r in R.CLICK_BOXES]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def contained_elements(rows: DataFrame, least: float = 0.99) -> DataFrame:
    """page_id, idx, within of elements (with x, y, width, height, null without a box) that lie to ``least`` of their area in
    their nearest ancestor whose box stands for all within it. Fields, labels, such boxes themselves and elements with a
    handler, a label or a role of their own stay out of it."""
    tops = rows.where(_click_box() & F.col("x").isNotNull()).select("page_id", F.col("idx").alias("top"), F.col("last_idx").alias("end_"), F.struct("x", "y", "width", "height").alias("b"))
    attr = lambda n: F.try_element_at("attrs", F.lit(n))
    own_right = (
        F.col("tag").isin("input", "select", "textarea", "label") | _click_box() | F.map_contains_key("attrs", "onclick")
        | (F.trim(F.coalesce(attr("aria-label"), F.lit(""))) != "") | F.coalesce(attr("role").isin(*R.CLICK_ROLES), F.lit(False))
    )
    inner = rows.where(~own_right & F.col("x").isNotNull() & (F.col("width") * F.col("height") != 0))
    own = inner.select("page_id", "idx", F.struct("x", "y", "width", "height").alias("a"))
    above = own.join(tops, "page_id").where("idx > top AND idx <= end_")
    nearest = above.groupBy("page_id", "idx").agg(F.max_by(F.struct("top", "a", "b"), "top").alias("n"))
    side = lambda p, s: F.greatest(F.least(F.col(f"n.a.{p}") + F.col(f"n.a.{s}"), F.col(f"n.b.{p}") + F.col(f"n.b.{s}")) - F.greatest(f"n.a.{p}", f"n.b.{p}"), F.lit(0.0))
    share = side("x", "width") * side("y", "height") / (F.col("n.a.width") * F.col("n.a.height"))
    return nearest.where(share >= least).select("page_id", "idx", F.col("n.top").alias("within"))


def suppress_boxes(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes (image_id, box_id, x, y, width, height, score) that stay when each, by falling score and then by box_id, removes those that overlap it
    by more than ``least``. Only overlapping pairs are passed in order; state is the removed boxes of an image."""
    pairs = overlapping_boxes(boxes, least)
    rank = boxes.select("image_id", "box_id", "score")
    a, b = rank.select("image_id", F.col("box_id").alias("a"), F.col("score").alias("sa")), rank.select("image_id", F.col("box_id").alias("b"), F.col("score").alias("sb"))
    known = pairs.join(a, ["image_id", "a"]).join(b, ["image_id", "b"])
    first = F.col("sa") >= F.col("sb")  # a is the smaller id
    either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    ordered = known.select("image_id", (-either("sa", "sb")).alias("place"), either("a", "b").alias("high"), either("b", "a").alias("low"))

    def remove(gone: set, row: tuple) -> tuple | None:
        image, _, high, low = row
        if high in gone or low in gone:
            return None
        gone.add(low)
        return image, low

    kind = dict(boxes.dtypes)
    out = fold_by_key(ordered, "image_id", ["place", "high", "low"], set, remove, f"image_id {kind['image_id']}, box_id {kind['box_id']}")
    return boxes.join(out, ["image_id", "box_id"], "left_anti")


def _told(sentence: str, value: Column) -> Column:
    before, _, after = sentence.partition("{}")
    return F.concat(F.lit(before), value, F.lit(after)) if _ else F.lit(sentence)


def cross_modal(shown: DataFrame, injections: DataFrame) -> DataFrame:
    """page_id, confidence, word, matched (the page's first injection) of screens that show injection language on
    pages with an injection."""
    first = injections.groupBy("page_id").agg(F.min_by("content", F.struct("ord", "start")).alias("matched"))
    word = first_word(X.normalize(F.col("text")), R.INJECTION_KEYWORDS)
    seen = shown.where(F.trim("text") != "").select("page_id", X.correlation_confidence(F.lit(0.95), F.col("confidence"), F.lit(1.0)).alias("confidence"), word.alias("word"))
    return seen.where("word IS NOT NULL").join(first, "page_id")


def correlations(shown: DataFrame, rows: DataFrame, injections: DataFrame, hidden: DataFrame) -> DataFrame:
    """page_id, type, severity, confidence, word, input_idx, element, selector, matched, explanation: requests that screens
    (page_id, text, confidence) show, injections seen on both sides, and hidden text that they do not show."""
    names = ["page_id", "type", "severity", "confidence", "word", "input_idx", "element", "selector", "matched", "explanation"]
    attr = lambda n: F.nullif(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    fields = rows.where(F.col("tag").isin("input", "textarea", "select")).select(
        "page_id", F.col("idx").alias("input_idx"), F.col("tag").alias("element"), field_selector().alias("selector"), F.coalesce(attr("name"), attr("placeholder"), attr("id"), F.lit("")).alias("matched")
    )
    asked = visual_requests(shown, inputs_of(rows)).join(fields, ["page_id", "input_idx"], "left")
    said = None
    for kind, (with_input, without) in R.REQUEST_SENTENCES.items():
        one = F.when(F.col("input_idx").isNotNull(), _told(with_input, F.col("word"))).otherwise(_told(without, F.col("word")))
        said = F.when(F.col("type") == kind, one) if said is None else said.when(F.col("type") == kind, one)
    out = asked.withColumn("explanation", said).select(*names)
    crossed = cross_modal(shown, injections).withColumns({"type": F.lit("CROSS_MODAL_INJECTION"), "severity": F.lit("critical"), "input_idx": F.lit(None).cast("int"), "element": F.lit("text"), "selector": F.lit("dom")})
    out = out.unionByName(crossed.withColumn("explanation", said).select(*names))
    unseen = hidden_mismatches(hidden, shown).join(hidden, ["page_id", "idx"])
    told = F.when(F.col("severity") == "high", _told(R.HIDDEN_MISMATCH_SENTENCES["high"], F.col("technique"))).otherwise(_told(R.HIDDEN_MISMATCH_SENTENCES["low"], F.col("technique")))
    unseen = unseen.withColumns({"type": F.lit("HIDDEN_CONTENT_MISMATCH"), "word": F.lit(None).cast("string"), "input_idx": F.col("idx").cast("int"), "matched": F.col("text"), "explanation": told})
    return out.unionByName(unseen.select(*names))


def page_text(boxes: DataFrame, most: int = 80, least: float = 4.0) -> DataFrame:
    """Read text of each page: page_id, text (joined by spaces), confidence (mean, two places), n_blocks, from its first ``most``
    boxes (page_id, ord, text, confidence, width, height), without those under ``least`` in size and blank ones."""
    first = boxes.withColumn("n_", F.row_number().over(W.partitionBy("page_id").orderBy("ord"))).where(F.col("n_") <= most)
    fine = (F.col("width") >= least) & (F.col("height") >= least) & (F.trim("text") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fine, F.struct("ord", "text")))), lambda x: x["text"]), " ")
    mean = F.floor(F.coalesce(F.avg(F.when(fine, F.col("confidence"))), F.lit(0.0)) * 100 + 0.5) / 100
    return first.groupBy("page_id").agg(joined.alias("text"), mean.alias("confidence"), F.count_if(fine).alias("n_blocks"))


def first_block(boxes: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Of each page that shows one of ``words``, the first of them in their order, and the first box (ord) whose own text
    holds it; null if it goes over more than one box."""
    whole = page_text(boxes).select("page_id", first_word(X.normalize(F.col("text")), words).alias("word")).where("word IS NOT NULL")
    held = F.when(F.contains(X.normalize(F.col("text")), F.col("word")), F.col("ord"))
    return whole.join(boxes, "page_id").groupBy("page_id", "word").agg(F.min(held).alias("ord"))
