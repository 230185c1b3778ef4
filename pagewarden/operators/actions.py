"""Safety verdicts on planned actions: plan, step, type, value, selector, description, tag (null: no
target), attrs (map), requires_approval, safe, timeout_ms, depends_on (array of steps)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..functions.ordered import fold_by_key


def _verdict(allowed: Column | bool, reason: Column | str, risk: Column | str) -> Column:
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(column(allowed).alias("allowed"), column(reason).alias("reason"), column(risk).alias("risk"))


def pattern_group(text: Column) -> Column:
    """(category, risk) of the first pattern group that the text hits; null if none."""
    out = None
    for name, risk, patterns in R.ACTION_PATTERNS:
        hit = F.struct(F.lit(name).alias("category"), F.lit(risk).alias("risk"))
        test = text.rlike("(?i)" + "|".join(patterns))
        out = F.when(test, hit) if out is None else out.when(test, hit)
    return out


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def value_source() -> Column:
    given = _attr("data-value-source")
    return F.when(given.isin("user-provided", "page-derived"), given).otherwise("unknown")


def password_target() -> Column:
    named = F.concat(F.coalesce(_attr("name"), F.lit("")), F.coalesce(_attr("id"), F.lit("")))
    chosen = (F.lower("tag") == "input") & F.contains(F.coalesce("selector", F.lit("")), F.lit('[type="password"]'))
    told = (F.coalesce(_attr("type"), F.lit("")) == "password") | named.rlike("(?i)password|passwd|pwd") | chosen
    return F.col("tag").isNotNull() & F.coalesce(told, F.lit(False))


def first_hit() -> Column:
    """(field, category, risk) of the first field with a hit: selector, value, description, then attributes by name."""
    named = lambda field, hit: F.when(hit.isNotNull(), F.struct(field.alias("field"), hit["category"].alias("category"), hit["risk"].alias("risk")))
    plain = [named(F.lit(c), pattern_group(F.col(c))) for c in ("selector", "value", "description")]
    entries = F.filter(F.array_sort(F.map_entries(F.coalesce("attrs", F.expr("map()").cast("map<string,string>")))), lambda e: e["key"] != "data-value-source")
    hits = F.filter(F.transform(entries, lambda e: named(F.concat(F.lit("attribute:"), e["key"]), pattern_group(e["value"]))), lambda h: h.isNotNull())
    return F.coalesce(*plain, F.get(hits, F.lit(0)))


def action_verdict() -> Column:
    kind, source, hit = F.col("type"), value_source(), first_hit()
    target, href = F.col("tag").isNotNull(), _attr("href")
    approval = F.coalesce("requires_approval", F.lit(False))
    url, link = X.url_verdict(F.col("value")), X.url_verdict(href)
    return (
        F.when(~F.coalesce(kind.isin(*R.ACTION_TYPES), F.lit(False)), _verdict(False, F.concat(F.lit('Disallowed action type: "'), F.coalesce(kind, F.lit("")), F.lit('"')), "critical"))
        .when(~F.coalesce("safe", F.lit(False)), _verdict(False, "Action explicitly marked as unsafe by the planner", "high"))
        .when(~F.coalesce(F.col("timeout_ms").between(1, 30000), F.lit(False)), _verdict(False, F.concat(F.lit("Invalid timeout "), F.coalesce(F.col("timeout_ms").cast("string"), F.lit("")), F.lit("ms — must be 1–30000")), "medium"))
        .when(hit.isNotNull(), _verdict(False, F.concat(hit["category"], F.lit(" detected in "), hit["field"]), hit["risk"]))
        .when((kind == "navigate") & (F.coalesce("value", F.lit("")) == ""), _verdict(False, "Navigate action requires a URL value", "medium"))
        .when(kind == "navigate", _verdict(url["allowed"], url["reason"], url["risk"]))
        .when((kind == "fill") & ~approval, _verdict(False, "Fill actions must require user approval", "high"))
        .when((kind == "fill") & ~target, _verdict(False, "Fill action requires a target element", "medium"))
        .when((kind == "fill") & password_target() & (source != "user-provided"), _verdict(False, "Password fill must use user-provided values — never auto-extract from the page", "critical"))
        .when(kind == "fill", _verdict(True, F.concat(F.lit("Fill action approved (source: "), source, F.lit(")")), F.when(source == "unknown", "medium").otherwise("low")))
        .when((kind == "click") & (href != "") & ~link["allowed"], _verdict(False, F.concat(F.lit("Click target href blocked: "), link["reason"]), link["risk"]))
        .when((kind == "click") & _attr("download").isNotNull(), _verdict(False, "Click target triggers a download", "high"))
        .when((kind == "click") & (_attr("target") == "_blank"), _verdict(True, "Click opens new tab — allowed with caution", "low"))
        .when(kind == "click", _verdict(True, "Click action passed all safety checks", "none"))
        .when((kind == "type") & ~target, _verdict(False, "Type action requires a target element", "medium"))
        .when((kind == "type") & password_target() & ~approval, _verdict(False, "Typing into password fields must require user approval", "high"))
        .when(kind == "type", _verdict(True, "Type action passed all safety checks", "none"))
        .otherwise(_verdict(True, "Action passed all safety checks", "none"))
    )


def step_verdicts(steps: DataFrame) -> DataFrame:
    """plan, step, allowed, reason, risk; a step that depends on itself or a later one is not allowed."""
    judged = steps.withColumn("v_", action_verdict())
    later = F.exists(F.coalesce("depends_on", F.array().cast("array<bigint>")), lambda d: d >= F.col("step"))
    v = F.when(F.col("v_.allowed") & F.coalesce(later, F.lit(False)), _verdict(False, "Step depends on a later or same step (circular dependency)", "medium")).otherwise(F.col("v_"))
    return judged.select("plan", "step", v.alias("v_")).select("plan", "step", "v_.*")


def plan_verdicts(verdicts: DataFrame) -> DataFrame:
    """A plan is allowed if all its steps are; its risk is their highest."""
    rank = F.max(X.rank_of(F.col("risk")))
    return verdicts.groupBy("plan").agg(F.bool_and("allowed").alias("allowed"), X.level_of_rank(rank).alias("risk"), F.count_if(~F.col("allowed")).alias("n_blocked"))


def menu_opener() -> Column:
    """Steps on elements (attrs) that open a menu."""
    role, open_ = F.coalesce(_attr("role"), F.lit("")), F.coalesce(_attr("aria-expanded"), F.lit(""))
    return (
        F.coalesce(_attr("aria-haspopup"), F.lit("")).isin("true", "menu", "listbox")
        | (F.coalesce(_attr("data-gw-click"), F.lit("")) == "toggleSubMenu")
        | F.contains(F.coalesce(_attr("class"), F.lit("")), F.lit("expand-button"))
        | (role.isin("menuitem", "button") & open_.isin("false", "true"))
    )


def menu_item() -> Column:
    """Steps on elements (attrs, ax_name) that lie in a menu."""
    given = F.coalesce(_attr("class"), F.lit(""))
    low = F.lower(given)
    return (
        F.coalesce(_attr("role"), F.lit("")).isin("menuitem", "option", "menuitemcheckbox", "menuitemradio", "treeitem")
        | F.contains(given, F.lit("gw-action--inner"))
        | F.contains(low, F.lit("menuitem"))
        | ((F.coalesce("ax_name", F.lit("")) != "") & low.rlike("dropdown|popup|menu|submenu|action"))
    )


def form_submit() -> Column:
    """Clicks that submit a form."""
    tag, kind = F.lower("tag"), F.coalesce(_attr("type"), F.lit(""))
    selector, told = F.lower(F.coalesce("selector", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    has = lambda text, word: F.contains(text, F.lit(word))
    inside = has(selector, "form") | has(told, "form") | has(told, "submit")
    sends = ((tag == "input") & (kind == "submit")) | ((tag == "button") & kind.isin("submit", "") & inside) | (has(selector, "form") & has(selector, "submit")) | told.rlike(r"submit\s*(form|application|registration|payment)")
    return (F.col("type") == "click") & F.col("tag").isNotNull() & F.coalesce(sends, F.lit(False))


def _gate_facts(steps: DataFrame) -> DataFrame:
    """plan, step, blocked, unapproved, submits, secret, fills: what the gates ask of a step (``approved``: by the user)."""
    approved = F.coalesce("approved", F.lit(False))
    writes = F.coalesce(F.col("type").isin("fill", "type"), F.lit(False))
    return steps.select(
        "*", (~action_verdict()["allowed"]).alias("blocked"), (F.coalesce("requires_approval", F.lit(False)) & ~approved).alias("unapproved"), (form_submit() & ~approved).alias("submits"),
        (writes & password_target() & (value_source() != "user-provided") & ~approved).alias("secret"), writes.alias("fills"),
    )


def gate_outcomes(steps: DataFrame) -> DataFrame:
    """plan, step, outcome: blocked, needs_approval, pending_submit, password_source or run. A submit waits
    for approval after a completed (column ``completed``) fill of an earlier step."""
    before = W.partitionBy("plan").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    filled = F.coalesce(F.max((F.col("fills") & F.coalesce("completed", F.lit(False))).cast("int")).over(before), F.lit(0)) == 1
    return _gate_facts(steps).select(
        "plan", "step", F.when(F.col("blocked"), "blocked").when(F.col("unapproved"), "needs_approval").when(F.col("submits") & filled, "pending_submit").when(F.col("secret"), "password_source").otherwise("run").alias("outcome")
    )


def run_plans(steps: DataFrame) -> DataFrame:
    """plan, step, status, reason of each step that a plan reaches, in order; ``completed`` is what a step's
    action gave. A step whose dependencies are not all completed is skipped; the first that fails or waits for approval ends the plan."""
    facts = _gate_facts(steps).select("plan", "step", "depends_on", "blocked", "unapproved", "submits", "secret", "fills", F.coalesce("completed", F.lit(False)).alias("ok"))

    def gate(state: dict, row: tuple) -> tuple | None:
        plan, step, needs, blocked, unapproved, submits, secret, fills, ok = row
        if state["over"]:
            return None
        if any(n not in state["done"] for n in (needs if needs is not None else ())):
            return plan, step, "skipped", "dependency"
        reason = "blocked" if blocked else "needs_approval" if unapproved else "pending_submit" if submits and state["filled"] else "password_source" if secret else None if ok else "action"
        if reason:
            state["over"] = True
            return plan, step, "pending" if reason == "pending_submit" else "failed", reason
        state["done"].add(step)
        state["filled"] |= bool(fills)
        return plan, step, "completed", None

    kind = dict(steps.dtypes)
    return fold_by_key(facts, "plan", ["step"], lambda: {"over": False, "done": set(), "filled": False}, gate, f"plan {kind['plan']}, step {kind['step']}, status string, reason string")


def plan_results(ran: DataFrame) -> DataFrame:
    """plan, status (completed, failed or blocked), stopped_at, reason."""
    last = ran.groupBy("plan").agg(F.max_by(F.struct("status", "step", "reason"), "step").alias("l"))
    ended = F.col("l.status").isin("failed", "pending")
    status = F.when(F.col("l.status") == "failed", "failed").when(F.col("l.status") == "pending", "blocked").otherwise("completed")
    return last.select("plan", status.alias("status"), F.when(ended, F.col("l.step")).alias("stopped_at"), F.when(ended, F.col("l.reason")).alias("reason"))


def plan_summary(ran: DataFrame, steps: DataFrame) -> DataFrame:
    """plan, n_completed, n_failed, n_skipped, n_pending, and completed, the descriptions of the completed steps in order: what is told when a plan
    ends. ``ran`` is what :func:`run_plans` gives, ``steps`` has plan, step, description."""
    told = ran.join(steps.select("plan", "step", "description"), ["plan", "step"], "left")
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    done = F.array_sort(F.collect_list(F.when(F.col("status") == "completed", F.struct("step", "description"))))
    return told.groupBy("plan").agg(*map(n, ("completed", "failed", "skipped", "pending")), F.transform(done, lambda d: d["description"]).alias("completed"))


def rerun_counts(results: DataFrame) -> DataFrame:
    """run, n_results, n_success, n_errors of results (run, error; null or empty without one)."""
    wrong = F.coalesce(F.col("error"), F.lit("")) != ""
    return results.groupBy("run").agg(F.count(F.lit(1)).alias("n_results"), F.count_if(~wrong).alias("n_success"), F.count_if(wrong).alias("n_errors"))


def plans_from_json(raw: DataFrame) -> DataFrame:
    """Steps of planner output (plan, raw: JSON text, prompt): plan, step, type, selector, value, description, requires_approval, safe, timeout_ms,
    depends_on, rollback, reasoning, risk. Steps are numbered anew, unknown types wait, fills need approval, dependencies reach back only; text that is no
    JSON, or has no steps, is one wait step."""
    top = raw.select("plan", "prompt", F.try_parse_json("raw").alias("v_"))
    kind = lambda v: F.schema_of_variant(v)
    text = lambda v, path: F.when(kind(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    plain = lambda v, path: F.when(text(v, path) != "", text(v, path))
    told = F.trim(text(F.col("v_"), "$.reasoning"))
    risk = text(F.col("v_"), "$.riskLevel")
    listed = F.try_variant_get("v_", "$.steps", "array<variant>")
    opened = top.select(
        "plan", F.when(told != "", told).otherwise(F.concat(F.lit('Plan for: "'), F.coalesce("prompt", F.lit("")), F.lit('"'))).alias("reasoning"),
        F.when(risk.isin("low", "medium", "high", "critical"), risk).otherwise("low").alias("risk"), F.posexplode_outer(listed).alias("at_", "s_"),
    )
    s = F.col("s_")
    named = text(s, "$.type")
    step = (F.coalesce("at_", F.lit(0)) + 1).cast("bigint")
    typed = opened.withColumn("step", step).withColumn("type", F.when(named.isin(*R.ACTION_TYPES), named).otherwise("wait"))
    empty = F.col("at_").isNull()
    needs = F.filter(F.transform(F.try_variant_get("s_", "$.dependsOn", "array<variant>"), lambda d: F.try_variant_get(d, "$", "double")), lambda d: d.isNotNull() & (d == F.floor(d)) & (d >= 1) & (d < F.col("step")))
    asked = F.when(kind(F.try_variant_get(s, "$.requiresApproval", "variant")) == "BOOLEAN", F.try_variant_get(s, "$.requiresApproval", "boolean"))
    selector = plain(s, "$.selector")
    return typed.select(
        "plan", "step", "type", selector.alias("selector"), F.when(empty, "1000").otherwise(plain(s, "$.value")).alias("value"),
        F.when(empty, "Analyze page structure").otherwise(F.coalesce(plain(s, "$.description"), F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(": "), "type"))).alias("description"),
        ((F.col("type") == "fill") | F.coalesce(asked, F.lit(False))).alias("requires_approval"), F.lit(True).alias("safe"),
        F.when(F.col("type") == "wait", 3000).when(F.col("type") == "navigate", 10000).otherwise(5000).alias("timeout_ms"),
        F.coalesce(F.transform(needs, lambda d: d.cast("bigint")), F.array().cast("array<bigint>")).alias("depends_on"),
        F.when(F.col("type") == "fill", F.concat(F.lit("Clear the "), F.coalesce(selector, F.lit("field")))).alias("rollback"), "reasoning", "risk",
    )
