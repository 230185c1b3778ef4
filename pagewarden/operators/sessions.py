"""Agent sessions: loops, stagnation, retries, streaks, totals, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R


def action_hash(name: Column, params: Column) -> Column:
    """First 12 hex digits of the SHA-256 of an action (params: a map) in normal form: a search by its sorted distinct words, clicks and
    inputs by the element's index, inputs by their text too, navigation by its URL, scrolling by direction and index, others by all
    parameters in order of their names."""
    p = lambda key, default="": F.coalesce(F.try_element_at(params, F.lit(key)), F.lit(default))
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(p("query")), r"[^A-Za-z0-9_\s]", " "), r"\s+"), lambda w: w != "")))
    known = F.array_sort(F.filter(F.map_entries(params), lambda e: e["value"].isNotNull()))
    body = (
        F.when(name == "search", F.concat_ws("|", F.lit("search"), p("engine", "google"), F.array_join(words, "|")))
        .when(name == "input", F.concat_ws("|", F.lit("input"), p("index", "None"), F.lower(F.trim(p("text")))))
        .when(name == "click", F.concat_ws("|", F.lit("click"), p("index", "None")))
        .when(name == "navigate", F.concat_ws("|", F.lit("navigate"), p("url")))
        .when(name == "scroll", F.concat_ws("|", F.lit("scroll"), F.when(p("down", "true") == "true", "down").otherwise("up"), p("index", "None")))
        .otherwise(F.concat_ws("|", name, F.array_join(F.transform(known, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")))
    )
    return F.left(F.sha2(body, 256), F.lit(12))


def page_fingerprint(url: Column, count: Column, text: Column) -> Column:
    return F.struct(url.alias("url"), count.alias("element_count"), F.left(F.sha2(text, 256), F.lit(16)).alias("text_hash"))


def repetition(steps: DataFrame, window: int = 20, exempt=("wait", "done", "go_back")) -> DataFrame:
    """session, step, max_repetition: highest frequency of one action hash in the last ``window`` counted actions."""
    along = W.partitionBy("session").orderBy("step").rowsBetween(-(window - 1), 0)
    held = F.collect_list("hash").over(along)
    most = F.aggregate(F.array_distinct("held_"), F.lit(0), lambda m, h: F.greatest(m, F.size(F.filter("held_", lambda x: x == h))))
    return steps.where(~F.col("action").isin(*exempt)).withColumn("held_", held).select("session", "step", most.alias("max_repetition"))


def islands(frame: DataFrame, same: Column, order: Column | str, by: str = "session") -> DataFrame:
    """``run_``: steps since ``same`` (equal to the step before) was last false."""
    along = W.partitionBy(by).orderBy(order)
    cut = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(along.rowsBetween(W.unboundedPreceding, 0))
    marked = frame.withColumn("island_", cut)
    return marked.withColumn("run_", F.row_number().over(W.partitionBy(by, "island_").orderBy(order)) - 1).drop("island_")


def stagnation(steps: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    along = W.partitionBy("session").orderBy("step")
    marked = steps.withColumn("same_", F.col(fingerprint) == F.lag(fingerprint).over(along))
    return islands(marked, F.col("same_"), "step").select("session", "step", F.col("run_").alias("stagnation"))


def nudge(repeats: Column, stagnant: Column) -> Column:
    return F.when(repeats >= 12, "stop").when(repeats >= 8, "strong").when((repeats >= 5) | (stagnant >= 5), "gentle").otherwise("none")


def retries(steps: DataFrame) -> DataFrame:
    """Redundant: the same element and action as the successful step before."""
    along = W.partitionBy("session").orderBy("step")
    before = lambda c: F.lag(c).over(along)
    redundant = (before("element") == F.col("element")) & (before("action") == F.col("action")) & before("ok")
    return steps.select("session", "step", F.coalesce(redundant, F.lit(False)).alias("redundant"))


def failure_streaks(steps: DataFrame, replan_at: int = 3) -> DataFrame:
    along = W.partitionBy("session").orderBy("step")
    cut = F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(along.rowsBetween(W.unboundedPreceding, 0))
    grouped = steps.withColumn("g_", cut)
    streak = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(W.partitionBy("session", "g_").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    return grouped.select("session", "step", streak.alias("streak"), (streak >= replan_at).alias("replan"))


def sensitive_submits(steps: DataFrame) -> DataFrame:
    """Submit clicks after an earlier fill of the plan."""
    before = W.partitionBy("session").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    filled = F.max(F.col("is_fill").cast("int")).over(before)
    return steps.select("session", "step", (F.col("is_submit") & (F.coalesce(filled, F.lit(0)) == 1)).alias("sensitive_submit"))


def totals(steps: DataFrame) -> DataFrame:
    return steps.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(~F.col("ok")).alias("n_errors"), F.bool_or(~F.col("ok")).alias("has_errors"),
        F.min(F.when(~F.col("ok"), F.col("step"))).alias("first_error_step"), F.max_by("action", "step").alias("last_action"),
    )


def action_names(steps: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("step", "action")))
    return steps.groupBy("session").agg(F.array_join(F.transform(listed, lambda x: x["action"]), ",").alias("actions"))


def replay_decision(steps: DataFrame, skip_failures: bool = True, longest: float = 45.0, default: float = 2.0) -> DataFrame:
    why = F.when(F.col("action").isNull(), "no action").when(F.lit(skip_failures) & ~F.col("ok"), "skipped: original error").when(F.col("redundant"), "redundant retry").otherwise("replay")
    return steps.select("session", "step", why.alias("decision"), F.when(F.col("interval").isNull(), default).otherwise(F.least("interval", F.lit(longest))).alias("delay"))


def plan_states(items: DataFrame, updates: DataFrame) -> DataFrame:
    """plan, item, state after the ordered index updates: items before the index done, the index current;
    marks made before stay when the index moves back."""
    ordered = updates.groupBy("plan").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "index"))), lambda x: x["index"]).alias("moves"))
    top = items.groupBy("plan").agg(F.max("item").alias("last"))
    joined = items.join(top, "plan").join(ordered, "plan", "left")
    clamp = lambda i: F.least(F.greatest(i, F.lit(0)), F.col("last"))
    state = F.aggregate(
        F.coalesce("moves", F.array().cast("array<int>")), F.when(F.col("item") == 0, "current").otherwise("pending"),
        lambda s, i: F.when(F.col("item") < clamp(i), "done").when(F.col("item") == clamp(i), "current").when(s == "current", "pending").otherwise(s),
    )
    return joined.select("plan", "item", state.alias("state"))


#: What elements are found again by, one level after another.
_LEVELS = ((0, ("hash",)), (1, ("stable_hash",)), (2, ("xpath",)), (3, ("tag", "ax_name")), (4, ("tag", "name_")), (4, ("tag", "id_")), (4, ("tag", "label_")))


def refind_elements(recorded: DataFrame, current: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``by``, elem, level, new_idx of recorded elements (``by``, elem, frame, hash, stable_hash, xpath, tag, ax_name, attrs) in the new state of
    the same page or session (``by``, idx and the same columns): exact hash, stable hash, xpath, tag and accessible name,
    then tag and name, id or aria-label. A level looks only for what the levels before did not find. Of equal elements one in the same
    frame wins, then the lowest index: the lowest of each frame stands for them, so equal elements never meet in pairs."""
    named = lambda df: df.withColumns({f"{n}_": F.nullif(F.try_element_at("attrs", F.lit(k)), F.lit("")) for n, k in (("name", "name"), ("id", "id"), ("label", "aria-label"))})
    found = named(recorded).withColumn("hit_", F.lit(None).cast("struct<level:int,idx:bigint>"))
    new = named(current)
    for level, keys in _LEVELS:
        lowest = new.dropna(subset=list(keys)).groupBy(*by, *keys, "frame").agg(F.min("idx").cast("bigint").alias("idx"))
        held = lowest.groupBy(*by, *keys).agg(F.collect_list(F.struct("frame", "idx")).alias("held_"))
        held = held.select(*[F.col(c).alias(f"of_{c}") for c in (*by, *keys)], "held_")
        same = [F.col(c) == F.col(f"of_{c}") for c in by] + [F.when(F.col("hit_").isNull(), F.col(c)) == F.col(f"of_{c}") for c in keys]
        best = F.array_min(F.transform("held_", lambda h: F.struct((~F.coalesce(h["frame"] == F.col("frame"), F.lit(False))).alias("away"), h["idx"].alias("idx"))))
        hit = F.when(F.col("held_").isNotNull(), F.struct(F.lit(level).alias("level"), best["idx"].alias("idx")))
        found = found.join(held, same, "left").withColumn("hit_", F.coalesce("hit_", hit)).drop("held_", *[f"of_{c}" for c in (*by, *keys)])
    return found.select(*by, "elem", F.col("hit_.level").alias("level"), F.col("hit_.idx").alias("new_idx"))


def durations(steps: DataFrame) -> DataFrame:
    """session, seconds (sum of ended - started), n_steps, errors (the first error of each step, in order of steps, '' for none)."""
    span = F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    told = F.array_sort(F.collect_list(F.struct("step", F.coalesce(F.get("errors", F.lit(0)), F.lit("")).alias("error"))))
    return steps.groupBy("session").agg((F.sum(span) / 1_000_000).alias("seconds"), F.count(F.lit(1)).alias("n_steps"), F.transform(told, lambda x: x["error"]).alias("errors"))


def last_facts(steps: DataFrame) -> DataFrame:
    """session, final_result, is_done, successful (null unless done), is_judged, is_validated (null unless judged), last_action of a session's
    last step (step, action, extracted, done, success, verdict)."""
    last = steps.groupBy("session").agg(F.max_by(F.struct("action", "extracted", "done", "success", "verdict"), "step").alias("l"))
    done = F.coalesce("l.done", F.lit(False))
    return last.select(
        "session", F.nullif("l.extracted", F.lit("")).alias("final_result"), done.alias("is_done"), F.when(done, F.col("l.success")).alias("successful"),
        F.col("l.verdict").isNotNull().alias("is_judged"), F.col("l.verdict").alias("is_validated"), F.col("l.action").alias("last_action"),
    )


def in_order(value: Column | str, step: str = "step", where: Column | None = None) -> Column:
    """Aggregate: the values of a session's steps in order; only those of steps that ``where`` tells."""
    pair = F.struct(F.col(step).alias("at"), (F.col(value) if isinstance(value, str) else value).alias("v"))
    return F.transform(F.array_sort(F.collect_list(pair if where is None else F.when(where, pair))), lambda x: x["v"])


def session_lists(steps: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """session, urls, extracted (contents that are not empty), actions (of the names in ``include``), each in order of the steps."""
    return steps.groupBy("session").agg(
        in_order("url").alias("urls"), in_order("extracted", where=F.coalesce("extracted", F.lit("")) != "").alias("extracted"), in_order("action", where=F.col("action").isin(*include)).alias("actions")
    )


def step_reviews(steps: DataFrame) -> DataFrame:
    """session, step, review: the numbered step's actions as JSON, then its results and errors (arrays of struct<content, error>)."""
    n = F.row_number().over(W.partitionBy("session").orderBy("step"))
    line = lambda kind, i, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{kind} "), (i + 1).cast("string"), F.lit(": "), text, F.lit("\n"))).otherwise("")
    told = F.array_join(F.transform("results", lambda r, i: F.concat(line("Result", i, r["content"]), line("Error", i, r["error"]))), "")
    acts = F.when(F.size("actions") > 0, F.concat(F.lit("Actions: "), F.to_json("actions"), F.lit("\n"))).otherwise("")
    return steps.select("session", "step", F.concat(F.lit("Step "), n.cast("string"), F.lit(":\n"), acts, told).alias("review"))


def action_histories(steps: DataFrame) -> DataFrame:
    """session, step, nth, action, element, memory: actions, elements and memories (arrays) of a step side by side, as many as the shortest
    has; without elements all actions go on with none."""
    n = F.least(F.size("actions"), F.coalesce(F.nullif(F.size("elements"), F.lit(0)), F.size("actions")), F.size("memories"))
    at = lambda c: F.get(c, F.col("nth"))
    each = steps.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("nth"))
    return each.select("session", "step", "nth", at("actions").alias("action"), at("elements").alias("element"), F.nullif(at("memories"), F.lit("")).alias("memory"))


def interacted_elements(steps: DataFrame, elements: DataFrame) -> DataFrame:
    """session, step, index and the element (session, step, index, element) that it stands for in that step; null if none does."""
    return steps.select("session", "step", "index").join(elements, ["session", "step", "index"], "left")


def expected_elements(steps: DataFrame, most: int = 50) -> DataFrame:
    """session, step, expected: the highest index of the step's actions (array) and one, ``most`` at most; 0 without one."""
    return steps.select("session", "step", F.least(F.coalesce(F.array_max("indexes") + 1, F.lit(0)), F.lit(most)).alias("expected"))


def last_screenshots(steps: DataFrame, n_last: int, with_nulls: bool = True) -> DataFrame:
    """session, step, path of the last ``n_last`` steps; steps without a path drop out afterwards, if at all."""
    last = steps.withColumn("n_", F.row_number().over(W.partitionBy("session").orderBy(F.desc("step")))).where(F.col("n_") <= n_last)
    return (last if with_nulls else last.where("path IS NOT NULL")).select("session", "step", "path")


def planning_flags(steps: DataFrame, replan_at: int = 3, explore_at: int = 5, budget: float = 0.75) -> DataFrame:
    """session, step, streak, replan, explore, over_budget. A step with one result that is an error (n_results, ok) adds to the streak, any other
    ends it. ``planned`` tells of a plan, ``max_steps`` the session's budget (0: none)."""
    failed = ~F.col("ok") & (F.col("n_results") == 1)
    streaks = failure_streaks(steps.withColumn("ok", ~failed), replan_at).select("session", "step", "streak")
    n = F.row_number().over(W.partitionBy("session").orderBy("step"))
    used = steps.select("session", "step", "planned", "max_steps", n.alias("n_")).join(streaks, ["session", "step"])
    near = (F.col("max_steps") > 0) & (F.col("n_") / F.col("max_steps") >= budget) & (F.col("n_") < F.col("max_steps"))
    return used.select("session", "step", "streak", (F.col("planned") & (F.col("streak") >= replan_at)).alias("replan"), (~F.col("planned") & (F.col("n_") >= explore_at)).alias("explore"), near.alias("over_budget"))


def compaction(steps: DataFrame, chars: int = 40_000, every: int = 25) -> DataFrame:
    """session, step, compact: where the text so far passes another multiple of ``chars``, or ``every`` steps are full."""
    along = W.partitionBy("session").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    told = steps.select("session", "step", F.sum(F.length("text")).over(along).alias("n_"), F.coalesce(F.length("text"), F.lit(0)).alias("own_"), F.row_number().over(W.partitionBy("session").orderBy("step")).alias("k_"))
    passes = F.floor(F.coalesce("n_", F.lit(0)) / chars) > F.floor((F.coalesce("n_", F.lit(0)) - F.col("own_")) / chars)
    return told.select("session", "step", (passes | (F.col("k_") % every == 0)).alias("compact"))


def history_line() -> Column:
    """A step as text (step_number, error, system_message, evaluation, memory, next_goal, results)."""
    full = lambda c: F.nullif(c, F.lit(""))
    tag = F.when(F.col("step_number").isNotNull(), "<step>\n").otherwise("<step_unknown>\n")
    parts = F.concat_ws("\n", *[full(c) for c in ("evaluation", "memory", "next_goal", "results")])
    return F.when(full("error").isNotNull(), F.concat(tag, "error")).when(full("system_message").isNotNull(), F.col("system_message")).otherwise(F.concat(tag, parts))


def substitute_variables(actions: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``actions`` (keys, params: a map) whose parameter values that equal an old value (old, new) are the new one; of several new ones for an
    old value the first in order."""
    one = values.groupBy(F.col("old").alias("value")).agg(F.min("new").alias("new"))
    each = actions.select(*keys, F.explode_outer("params").alias("name", "value"))
    swapped = each.join(one, "value", "left").select(*keys, "name", F.coalesce("new", "value").alias("value"))
    whole = swapped.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value"))))).alias("params"))
    return whole


def new_elements(states: DataFrame) -> DataFrame:
    """session, state, node of nodes that the session's state before (number - 1) does not hold; those of the first are not new."""
    before = states.select("session", (F.col("state") + 1).alias("state"), "node")
    first = states.groupBy("session").agg(F.min("state").alias("first_"))
    return states.join(before, ["session", "state", "node"], "left_anti").join(first, "session").where("state > first_").drop("first_")


def state_diff(before: DataFrame, after: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """keys and change (appeared, disappeared, moved) of elements that two states hold in other places or only one of them holds."""
    a = before.select(*keys, F.struct(*place).alias("was_"))
    b = after.select(*keys, F.struct(*place).alias("is_"))
    change = F.when(F.col("was_").isNull(), "appeared").when(F.col("is_").isNull(), "disappeared").when(F.col("was_") != F.col("is_"), "moved")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).where("change IS NOT NULL")


def current_tab(tabs: DataFrame, pages: DataFrame) -> DataFrame:
    """session, step, tab: the tab with the page's URL and title, if there is exactly one."""
    met = tabs.join(pages.select("session", "step", "url", "title"), ["session", "step", "url", "title"])
    return met.groupBy("session", "step").agg(F.count(F.lit(1)).alias("n_"), F.min("tab").alias("tab")).where("n_ = 1").drop("n_")


def session_health(steps: DataFrame, window: int = 20, exempt=("wait", "done", "go_back"), fingerprint: str = "fingerprint") -> DataFrame:
    """One row for each session (session, step, action, hash, ok, element, ``fingerprint``): n_steps, n_errors, worst_repetition, longest_stagnation,
    n_redundant, longest_streak, n_replans, nudge (the strongest) and last_action. All windows share one order by session and step."""
    along = ["session", "step"]
    every = (
        steps.select(*along).join(repetition(steps, window, exempt), along, "left").join(stagnation(steps, fingerprint), along).join(retries(steps), along).join(failure_streaks(steps), along)
    )
    told = every.withColumn("n_", nudge(F.coalesce("max_repetition", F.lit(0)), F.col("stagnation")))
    strength = F.array_position(F.array(*map(F.lit, ("none", "gentle", "strong", "stop"))), F.col("n_"))
    health = told.groupBy("session").agg(
        F.coalesce(F.max("max_repetition"), F.lit(0)).alias("worst_repetition"), F.max("stagnation").alias("longest_stagnation"), F.count_if("redundant").alias("n_redundant"),
        F.max("streak").alias("longest_streak"), F.count_if("replan").alias("n_replans"), F.max_by("n_", strength).alias("nudge"),
    )
    return totals(steps).select("session", "n_steps", "n_errors", "last_action").join(health, "session")
