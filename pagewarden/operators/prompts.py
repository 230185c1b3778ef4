"""Text rows for a planner: prompts, announcements, element and page-state lines, and what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from . import dom


def _n(x: Column) -> Column:
    return x.cast("string")


def user_prompt(task: Column, url: Column, title: Column, n_redacted: Column, context: Column, most: int = 2000) -> Column:
    """The planner's prompt; the context is cut at ``most`` characters and marked."""
    shown = F.when(F.length(context) > most, F.concat(F.substring(context, 1, most), F.lit("\n[...context truncated...]"))).otherwise(context)
    note = F.when(n_redacted > 0, F.concat(F.lit("Note: "), _n(n_redacted), F.lit(" PII value(s) were redacted from the page context before this analysis.\n"))).otherwise("")
    return F.concat(F.lit("Task: "), task, F.lit("\nPage URL: "), url, F.lit("\nPage title: "), title, F.lit("\n"), note, F.lit("\nPage context (sanitized):\n"), shown, F.lit("\n\nGenerate the JSON action plan now."))


def plan_message(n_pii: Column, n_blocked: Column, n_steps: Column, warnings: Column) -> Column:
    """What is said when a plan is ready: data found, injections blocked, steps, and the first warning unless it is about redaction."""
    many = lambda n: F.when(n != 1, "s").otherwise("")
    first = F.get(warnings, F.lit(0))
    return F.concat_ws(
        "\n",
        F.when(n_pii > 0, F.concat(F.lit("Scanned the page — found "), _n(n_pii), F.lit(" sensitive item"), many(n_pii), F.lit(" (kept local, never sent anywhere)."))),
        F.when(n_blocked > 0, F.concat(F.lit("Blocked "), _n(n_blocked), F.lit(" injection attempt"), many(n_blocked), F.lit("."))),
        F.concat(F.lit("Ready with a "), _n(n_steps), F.lit("-step plan. Review and approve to continue.")),
        F.when(first.isNotNull() & ~F.contains(first, F.lit("redacted")), F.concat(F.lit("Note: "), first)),
    )


def parse_results(results: DataFrame, schema: str, column: str = "final_result") -> DataFrame:
    """``results`` with ``parsed``, the JSON text as ``schema``, and ``error`` where it is none."""
    parsed = F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = F.col(column).isNotNull() & (F.col("p_").isNull() | F.col("p_._bad").isNotNull())
    return results.withColumn("p_", parsed).select("*", F.when(~bad, F.col("p_").dropFields("_bad")).alias("parsed"), F.when(bad, "not JSON of the schema").alias("error")).drop("p_")


def format_hint(kind: Column) -> Column:
    """The format that an input of a date or time type takes; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in R.INPUT_FORMATS.items() for x in kv]), F.lower(kind))


def meaningful_text(attrs: Column, text: Column) -> Column:
    """The first of value, aria-label, title, placeholder and alt that is not empty, else the element's text."""
    given = [F.nullif(F.try_element_at(attrs, F.lit(n)), F.lit("")) for n in ("value", "aria-label", "title", "placeholder", "alt")]
    return F.trim(F.coalesce(*given, text, F.lit("")))


def image_context(attrs: Column, width: int = 100) -> Column:
    """What an image's attributes tell: alt, title, label and file name, each of ``width`` characters at most; null if nothing."""
    def capped(value: Column) -> Column:
        return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width), F.lit("..."))).otherwise(value)

    def part(name: str, shown: str) -> Column:
        value = F.trim(F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit("")))
        return F.when(value != "", F.concat(F.lit(f"{shown}="), capped(value)))

    source = F.trim(F.regexp_replace(F.coalesce(F.try_element_at(attrs, F.lit("src")), F.lit("")), r"[\t\n\r]", ""))
    file = F.substring_index(F.regexp_replace(F.regexp_replace(source, r"[?#].*", ""), "/+$", ""), "/", -1)
    src = F.when(~F.lower(source).startswith("data:") & (file != ""), F.concat(F.lit("image_src="), capped(file)))
    return F.nullif(F.concat_ws(" ", part("alt", "image_alt"), part("title", "image_title"), part("aria-label", "image_label"), src), F.lit(""))


def element_line(n: Column, tag: Column, attrs: Column, is_new: Column, depth: Column | None = None, keep: tuple[str, ...] = ("type", "name", "role", "value", "placeholder", "title", "alt", "aria-label", "href")) -> Column:
    """``*[n]<tag name=value ... />``: a star for a new element, then the kept attributes that are not empty, in order of ``keep``."""
    shown = F.concat_ws(" ", *[F.when(F.coalesce(F.try_element_at(attrs, F.lit(k)), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.try_element_at(attrs, F.lit(k)))) for k in keep])
    line = F.concat(F.when(is_new, "*").otherwise(""), F.lit("["), _n(n), F.lit("]<"), tag, F.when(shown != "", F.concat(F.lit(" "), shown)).otherwise(""), F.lit(" />"))
    return line if depth is None else F.concat(F.repeat(F.lit("\t"), depth), line)


def page_state(links: Column, interactive: Column, iframes: Column, images: Column, total: Column, text_chars: Column, pending: Column, above: Column, below: Column, lines: Column, most: int = 40_000) -> Column:
    """The state of a page as text: statistics with remarks on empty and loading pages, pages above and below, and its element
    lines (cut at ``most`` characters) between marks of its start and end."""
    busy = F.concat(_n(pending), F.lit(" network request(s) in flight and little text rendered - page may still be loading, consider waiting - "))
    remark = F.when(total < 10, "Page appears empty - consider waiting - ").when((pending > 0) & (total > 20) & (text_chars < total * 5), busy).otherwise("")
    stats = F.concat(
        F.lit("<page_stats>"), remark, _n(links), F.lit(" links, "), _n(interactive), F.lit(" interactive, "), _n(iframes), F.lit(" iframes"),
        F.when(images > 0, F.concat(F.lit(", "), _n(images), F.lit(" images"))).otherwise(""), F.lit(", "), _n(total), F.lit(" total elements</page_stats>\n"),
    )
    one = lambda x: F.format_string("%.1f", x.cast("double"))
    info = F.concat(F.lit("<page_info>"), one(above), F.lit(" pages above, "), one(below), F.lit(" pages below"), F.when(below > 0.2, " — scroll down to reveal more content").otherwise(""), F.lit("</page_info>\n"))
    body = F.concat(F.when(above > 0, "").otherwise("[Start of page]\n"), F.substring(lines, 1, most), F.when(below > 0, "").otherwise("\n[End of page]"))
    return F.concat(stats, info, F.when(lines == "", "empty page").otherwise(body))


def select_options(options: DataFrame, shown: int = 4, width: int = 30) -> DataFrame:
    """Of each select (page_id, select_idx), from its options (idx, text, value): count, first (texts of the first ``shown``, then how many more),
    hint (numeric, codes, dates or paths, e-mail addresses) from the first five values."""
    text, value = F.trim("text"), F.trim(F.coalesce("value", F.lit("")))
    rows = options.select("page_id", "select_idx", "idx", text.alias("text"), F.when(value != "", value).otherwise(text).alias("value")).where("text <> '' OR value <> ''")
    listed = rows.groupBy("page_id", "select_idx").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "value"))).alias("o"))
    label = lambda o: F.when(o["text"] != "", o["text"]).otherwise(o["value"])
    first = F.transform(F.slice("o", 1, shown), lambda o: F.concat(F.substring(label(o), 1, width), F.when(F.length(label(o)) > width, "...").otherwise("")))
    more = F.when(F.size("o") > shown, F.array(F.concat(F.lit("... "), _n(F.size("o") - shown), F.lit(" more options...")))).otherwise(F.array().cast("array<string>"))
    some = F.filter(F.transform(F.slice("o", 1, 5), lambda o: o["value"]), lambda v: v != "")
    hint = F.when(F.size("o") < 2, F.lit(None)).when(F.forall(some, lambda v: v.rlike("^[0-9]+$")), "numeric").when(F.forall(some, lambda v: (F.length(v) == 2) & v.rlike("[A-Z]") & ~v.rlike("[a-z]")), "country/state codes")
    hint = hint.when(F.forall(some, lambda v: F.contains(v, F.lit("/")) | F.contains(v, F.lit("-"))), "date/path format").when(F.exists(some, lambda v: F.contains(v, F.lit("@"))), "email addresses")
    return listed.select("page_id", "select_idx", F.size("o").alias("count"), F.concat(first, more).alias("first"), hint.alias("hint"))


def profile_field(description: Column, profile: dict[str, Column]) -> Column:
    """The profile's column that a description asks for; the first pattern that applies, null if none."""
    low, out = F.lower(description), None
    for name, wanted, unwanted in R.PROFILE_FIELDS:
        test = low.rlike(wanted) if unwanted is None else low.rlike(wanted) & ~low.rlike(unwanted)
        value = profile[name] if name == "password" else F.nullif(profile[name], F.lit(""))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def attach_values(steps: DataFrame, given: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Steps (keys, attrs, value) with supplied values: the user's before the stored one; marked user-provided in the attributes."""
    joined = steps.join(given.select(*keys, F.col("value").alias("given_")), keys, "left").join(stored.select(*keys, F.col("value").alias("stored_")), keys, "left")
    new = F.coalesce("given_", "stored_")
    bare = F.map_filter("attrs", lambda k, _: k != "data-value-source")
    marked = F.map_concat(bare, F.create_map(F.lit("data-value-source"), F.lit("user-provided")))
    return joined.withColumns({"attrs": F.when(new.isNotNull(), marked).otherwise(F.col("attrs")), "value": F.coalesce(new, "value")}).drop("given_", "stored_")


def match_targets(wanted: DataFrame, elements: DataFrame) -> DataFrame:
    """want_id, idx: the element (page_id, idx, tag, attrs, text) that a description (want_id, page_id, description) means. Words for credentials ask
    for inputs of their types first; else the first element whose text or label holds a word of three letters or more."""
    attr = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    low = F.lower("description")
    label = F.lower(F.coalesce(F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit("")), *[F.nullif(attr(n), F.lit("")) for n in ("aria-label", "placeholder", "value", "title")], F.lit("")))
    live = F.col("tag").isin("button", "a", "input") | attr("role").isin("button", "link")
    seen = elements.where(live).select("page_id", "idx", "tag", F.lower(attr("type")).alias("type"), label.alias("label"))
    words = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 2))
    asks = wanted.select("want_id", "page_id", low.alias("low"), words.alias("words"))
    rank = None
    for i, (hints, types) in enumerate(R.FIELD_HINTS):
        test = F.greatest(*[F.contains("low", F.lit(w)) for w in hints]) & (F.col("tag") == "input") & F.col("type").isin(*types)
        rank = F.when(test, i) if rank is None else rank.when(test, i)
    spoken = F.exists("words", lambda w: F.contains(F.col("label"), w)) & (F.col("label") != "")
    rank = rank.when(spoken, len(R.FIELD_HINTS))
    met = asks.join(seen, "page_id").withColumn("rank", rank).where("rank IS NOT NULL")
    return met.groupBy("want_id").agg(F.min_by("idx", F.struct("rank", "idx")).alias("idx"))


def start_url(text: Column) -> Column:
    """The one web address that a task names; null if it names none or several. E-mail addresses, files and words after a negation
    (don't, not, never, avoid, within 20 characters before) are none."""
    bare = F.regexp_replace(text, R.EMAIL_IN_TASK, "")
    full = X.find_all(bare, R.FULL_URL)
    blanked = F.regexp_replace(bare, R.FULL_URL, " ")
    rest = X.find_all(blanked, R.BARE_URL)
    ending = r"\.(?:" + "|".join(R.FILE_ENDINGS) + ")"
    negated = lambda source, m: F.substring(source, F.greatest(m["start"] - 20, F.lit(0)) + 1, F.least(m["start"], F.lit(20))).rlike(r"(?i)\b(?:don't|not|never|avoid)\b")
    clean = lambda m: F.regexp_replace(m["value"], r"""[.,;:!?()\[\]"']+$""", "")
    file = lambda v: F.lower(v).startswith("file://")
    a = F.transform(F.filter(full, lambda m: ~negated(bare, m) & (file(m["value"]) | ~F.lower(m["value"]).rlike(ending))), clean)
    b = F.transform(F.filter(rest, lambda m: ~negated(blanked, m) & ~F.lower(m["value"]).rlike(ending) & ~F.contains(F.lower(m["value"]), F.lit(".htm"))), lambda m: F.concat(F.lit("https://"), clean(m)))
    every = F.array_distinct(F.concat(a, b))
    return F.when(F.size(every) == 1, F.get(every, F.lit(0)))


def options_of(rows: DataFrame) -> DataFrame:
    """page_id, select_idx, idx, text, value of the options in element rows."""
    picks = rows.where("tag IN ('select', 'option')").withColumn("select_idx", dom.nearest(F.col("tag") == "select", F.col("idx")))
    return picks.where("tag = 'option' AND select_idx IS NOT NULL").select("page_id", "select_idx", "idx", F.col("own_text").alias("text"), F.try_element_at("attrs", F.lit("value")).alias("value"))

