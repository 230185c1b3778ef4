"""Agent sessions, plans and prompts from events, customers and parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import prompts, sessions
from .catalog import query, table

_E = "SELECT user_id AS session, event_id AS step, * FROM events"


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumns({"session": F.col("user_id"), "step": F.col("event_id")})


def _n():
    return F.col("event_id")


# --- sessions --------------------------------------------------------------


@query(f"SELECT session, CAST(sum(event_id % 90) AS DOUBLE) AS seconds, count(*) AS n_steps, string_agg(CASE WHEN event_type = 'error' THEN props ELSE '' END, '|' ORDER BY step) AS errors FROM ({_E}) GROUP BY 1")
def session_durations(spark, d):
    e = _events(spark, d).withColumns({"started": F.col("ts"), "ended": F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _n() % 90), "errors": F.when(F.col("event_type") == "error", F.array("props", "event_type")).otherwise(F.array().cast("array<string>"))})
    return sessions.durations(e).withColumn("errors", F.array_join("errors", "|"))


def _facts(spark, d) -> DataFrame:
    return _events(spark, d).select(
        "session", "step", F.col("event_type").alias("action"), F.when(_n() % 4 == 0, "").otherwise(F.col("props")).alias("extracted"), (_n() % 3 == 0).alias("done"), (_n() % 2 == 0).alias("success"),
        F.when(_n() % 5 == 0, _n() % 10 == 0).alias("verdict"), F.col("props").alias("url"),
    )


@query(f"""SELECT session, CASE WHEN s % 4 = 0 THEN NULL ELSE props END AS final_result, s % 3 = 0 AS is_done, CASE WHEN s % 3 = 0 THEN s % 2 = 0 END AS successful, s % 5 = 0 AS is_judged, CASE WHEN s % 5 = 0 THEN s % 10 = 0 END AS is_validated, action AS last_action
FROM (SELECT session, max(step) AS s, arg_max(props, step) AS props, arg_max(event_type, step) AS action FROM ({_E}) GROUP BY 1)""")
def session_facts(spark, d):
    return sessions.last_facts(_facts(spark, d))


@query(f"""SELECT session, string_agg(props, ',' ORDER BY step) AS urls, coalesce(string_agg(props, ',' ORDER BY step) FILTER (event_id % 4 <> 0), '') AS extracted, coalesce(string_agg(event_type, ',' ORDER BY step) FILTER (event_type IN ('click', 'view')), '') AS actions FROM ({_E}) GROUP BY 1""")
def session_lists(spark, d):
    listed = sessions.session_lists(_facts(spark, d), ("click", "view"))
    return listed.select("session", *[F.array_join(c, ",").alias(c) for c in ("urls", "extracted", "actions")])


@query(f"""SELECT session, step, 'Step ' || row_number() OVER (PARTITION BY session ORDER BY step) || ':' || chr(10) || 'Actions: [{{"type":"' || event_type || '"}}]' || chr(10) || 'Result 1: ' || props || chr(10) || CASE WHEN event_type = 'error' THEN 'Error 2: failed' || chr(10) ELSE '' END AS review FROM ({_E})""")
def step_reviews(spark, d):
    result = F.struct(F.col("props").alias("content"), F.lit("").alias("error"))
    failed = F.struct(F.lit("").alias("content"), F.when(F.col("event_type") == "error", "failed").otherwise("").alias("error"))
    return sessions.step_reviews(_events(spark, d).select("session", "step", F.array(F.struct(F.col("event_type").alias("type"))).alias("actions"), F.array(result, failed).alias("results")))


@query(f"""SELECT session, step, 0 AS nth, event_type AS action, CASE WHEN event_id % 2 = 0 THEN props END AS element, CASE WHEN event_id % 3 = 0 THEN 'kept' END AS memory FROM ({_E})
UNION ALL SELECT session, step, 1, 'wait', NULL, 'again' FROM ({_E}) WHERE event_id % 2 = 1""")
def action_histories(spark, d):
    elements = F.when(_n() % 2 == 0, F.array("props")).otherwise(F.array().cast("array<string>"))
    memories = F.array(F.when(_n() % 3 == 0, "kept").otherwise(""), F.lit("again"), F.lit("more"))
    return sessions.action_histories(_events(spark, d).select("session", "step", F.array(F.col("event_type"), F.lit("wait")).alias("actions"), elements.alias("elements"), memories.alias("memories")))


@query(f"SELECT session, step, event_id % 7 AS index, CASE WHEN event_id % 7 < 4 THEN props END AS element FROM ({_E})")
def interacted_elements(spark, d):
    e = _events(spark, d).withColumn("index", _n() % 7)
    return sessions.interacted_elements(e, e.where("index < 4").select("session", "step", "index", F.col("props").alias("element")))


@query(f"SELECT session, step, CASE WHEN event_type = 'view' THEN 0 ELSE least(event_id % 60 + 1, 50) END AS expected FROM ({_E})")
def expected_elements(spark, d):
    indexes = F.when(F.col("event_type") == "view", F.array().cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("bigint"), _n() % 60))
    return sessions.expected_elements(_events(spark, d).withColumn("indexes", indexes))


@query(f"SELECT session, step, path FROM (SELECT session, step, CASE WHEN event_id % 3 > 0 THEN 'shot-' || event_id END AS path, row_number() OVER (PARTITION BY session ORDER BY step DESC) AS n FROM ({_E})) WHERE n <= 4 AND path IS NOT NULL")
def last_screenshots(spark, d):
    e = _events(spark, d).withColumn("path", F.when(_n() % 3 > 0, F.concat(F.lit("shot-"), _n().cast("string"))))
    return sessions.last_screenshots(e, 4, with_nulls=False)


@query(f"""WITH s AS (SELECT *, event_type = 'error' AND event_id % 2 = 0 AS failed, row_number() OVER (PARTITION BY session ORDER BY step) AS n FROM ({_E})),
g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY step) AS g FROM s), t AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY session, g ORDER BY step) AS streak FROM g)
SELECT session, step, CAST(streak AS BIGINT) AS streak, session % 2 = 0 AND streak >= 1 AS replan, session % 2 = 1 AND n >= 5 AS explore, n >= 9 AND n < 12 AS over_budget FROM t""")
def planning_flags(spark, d):
    e = _events(spark, d).select("session", "step", (F.col("event_type") != "error").alias("ok"), F.when(_n() % 2 == 0, 1).otherwise(2).alias("n_results"), (F.col("session") % 2 == 0).alias("planned"), F.lit(12).alias("max_steps"))
    return sessions.planning_flags(e, replan_at=1)


@query(f"""WITH t AS (SELECT session, step, sum(length(props) * 100) OVER w AS n, length(props) * 100 AS own, row_number() OVER w AS k FROM ({_E}) WINDOW w AS (PARTITION BY session ORDER BY step))
SELECT session, step, floor(n / 3000) > floor((n - own) / 3000) OR k % 25 = 0 AS compact FROM t""")
def compaction_steps(spark, d):
    return sessions.compaction(_events(spark, d).withColumn("text", F.repeat("props", F.lit(100))), chars=3000)


@query(f"""SELECT session, step, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '<step>' ELSE '<step_unknown>' END || chr(10) || props WHEN 'signup' THEN 'hello'
 ELSE CASE WHEN event_id % 2 = 0 THEN '<step>' ELSE '<step_unknown>' END || chr(10) || CASE WHEN event_id % 3 = 0 THEN 'good' || chr(10) ELSE '' END || 'kept' || chr(10) || props END AS line FROM ({_E})""")
def history_lines(spark, d):
    kind = F.col("event_type")
    e = _events(spark, d).select(
        "session", "step", F.when(_n() % 2 == 0, _n()).alias("step_number"), F.when(kind == "error", F.col("props")).alias("error"), F.when(kind == "signup", "hello").alias("system_message"),
        F.when(_n() % 3 == 0, "good").otherwise("").alias("evaluation"), F.lit("kept").alias("memory"), F.lit("").alias("next_goal"), F.col("props").alias("results"),
    )
    return e.select("session", "step", sessions.history_line().alias("line"))


@query(f"""WITH u AS (SELECT session AS plan, step AS ord, event_id % 6 AS i FROM ({_E})), m AS (SELECT plan, item, last(least(i, 3) ORDER BY ord) AS final, arg_max(least(i, 3), ord) FILTER (least(i, 3) >= item) AS top FROM u, (SELECT unnest([0, 1, 2, 3]) AS item) GROUP BY 1, 2)
SELECT plan, item, CASE WHEN item < final THEN 'done' WHEN item = final THEN 'current' WHEN top > item THEN 'done' ELSE 'pending' END AS state FROM m""")
def plan_item_states(spark, d):
    e = _events(spark, d)
    items = e.select(F.col("session").alias("plan")).distinct().select("plan", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("item"))
    return sessions.plan_states(items, e.select(F.col("session").alias("plan"), F.col("step").alias("ord"), (_n() % 6).cast("int").alias("index")))


@query(f"""SELECT session, step, CASE WHEN event_type = 'view' THEN 'no action' WHEN event_type = 'error' THEN 'skipped: original error' WHEN again THEN 'redundant retry' ELSE 'replay' END AS decision, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE least(event_id % 100, 45) END AS DOUBLE) AS delay FROM (
SELECT *, coalesce(lag(props) OVER w = props AND lag(event_type) OVER w = event_type AND lag(event_type) OVER w <> 'error', false) AS again FROM ({_E}) WINDOW w AS (PARTITION BY session ORDER BY step))""")
def replay_decisions(spark, d):
    e = _events(spark, d).select("session", "step", F.col("event_type").alias("action"), (F.col("event_type") != "error").alias("ok"), F.col("props").alias("element"))
    told = e.join(sessions.retries(e), ["session", "step"]).withColumns({"interval": F.when(F.col("step") % 3 > 0, (F.col("step") % 100).cast("double")), "action": F.when(F.col("action") != "view", F.col("action"))})
    return sessions.replay_decision(told)


_KINDS = ("search", "click", "input", "navigate", "scroll", "upload")


@query("""SELECT event_id, left(sha256(CASE event_id % 6 WHEN 0 THEN 'search|google|' || array_to_string(list_sort(list_distinct(['k', event_type, regexp_extract(props, '[0-9]+')])), '|') WHEN 1 THEN 'click|' || user_id
 WHEN 2 THEN 'input|' || user_id || '|hello ' || event_type WHEN 3 THEN 'navigate|' || props WHEN 4 THEN 'scroll|' || CASE WHEN user_id % 2 = 0 THEN 'down' ELSE 'up' END || '|' || user_id
 ELSE 'upload|down=' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || ',index=' || user_id || ',query=K ' || upper(event_type) || '-' || props || ',text= Hello ' || event_type || ' ,url=' || props END), 12) AS hash FROM events""")
def action_hashes(spark, d):
    name = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (_n() % 6 + 1).cast("int"))
    params = {"index": F.col("user_id").cast("string"), "down": F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"), "url": F.col("props"), "text": F.concat(F.lit(" Hello "), "event_type", F.lit(" ")), "query": F.concat(F.lit("K "), F.upper("event_type"), F.lit("-"), "props")}
    given = F.create_map(*[x for k, v in params.items() for x in (F.lit(k), v)])
    return _events(spark, d).select("event_id", sessions.action_hash(name, given).alias("hash"))


@query("SELECT page_id, url, length(html) AS element_count, left(sha256(html), 16) AS text_hash FROM pages")
def page_fingerprints(spark, d):
    print_ = sessions.page_fingerprint(F.col("url"), F.length("html"), F.col("html"))
    return table(spark, d, "pages").select("page_id", print_.alias("p")).select("page_id", "p.*")


# --- elements over states --------------------------------------------------


@query("""SELECT elem % 5 AS page_id, elem, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 4 END AS INTEGER) AS level, CASE WHEN k < 6 THEN CASE WHEN k = 0 AND elem % 2 = 0 THEN elem * 2 + 1 ELSE elem * 2 END END AS new_idx FROM (SELECT p_partkey AS elem, p_partkey % 7 AS k FROM part)""")
def found_again(spark, d):
    """Elements that the new state holds twice (the second in frame b), changed so that one level after another applies. Another page
    holds the same elements under lower numbers, which must not be found."""
    k, n = F.col("p_partkey") % 7, F.col("p_partkey")
    text = lambda p, same: F.concat(F.lit(p), n.cast("string"), F.when(same, "").otherwise("-new"))

    def state(new: bool) -> DataFrame:
        keeps = lambda level: F.lit(True) if not new else k <= level
        attrs = F.when(k == 5, F.create_map(F.lit("aria-label"), text("l", F.lit(True)))).otherwise(F.create_map(F.lit("name"), text("m", keeps(4))))
        return table(spark, d, "part").select(
            (n % 5).alias("page_id"), n.alias("elem"), text("h", keeps(0)).alias("hash"), text("s", keeps(1)).alias("stable_hash"), text("x", keeps(2)).alias("xpath"), F.lit("a").alias("tag"), text("n", keeps(3)).alias("ax_name"), attrs.alias("attrs"),
            F.when(n % 2 == 0, "b").otherwise("a").alias("frame"),
        )

    new = state(True)
    # equal to the first of each pair only by its whole hash
    second = new.where(k == 0).select("page_id", (F.col("elem") * 2 + 1).alias("idx"), "hash", F.lit(None).cast("string").alias("stable_hash"), F.lit(None).cast("string").alias("xpath"), "tag", F.lit(None).cast("string").alias("ax_name"), F.expr("map()").cast("map<string,string>").alias("attrs"), F.lit("b").alias("frame"))
    first = new.select("page_id", (F.col("elem") * 2).alias("idx"), "hash", "stable_hash", "xpath", "tag", "ax_name", "attrs", F.lit("a").alias("frame"))
    elsewhere = first.withColumns({"page_id": F.col("page_id") + 100, "idx": F.lit(-1).cast("bigint")})
    return sessions.refind_elements(state(False), first.unionByName(second).unionByName(elsewhere)).select("page_id", "elem", "level", "new_idx")


_STATES = "(SELECT DISTINCT l_suppkey AS session, l_linenumber AS state, l_partkey % 20 AS node FROM lineitem)"


def _states(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_linenumber").alias("state"), (F.col("l_partkey") % 20).alias("node")).distinct()


@query(f"WITH s AS {_STATES} SELECT session, state, node FROM s WHERE state > (SELECT min(state) FROM s f WHERE f.session = s.session) AND NOT EXISTS (SELECT 1 FROM s b WHERE b.session = s.session AND b.state = s.state - 1 AND b.node = s.node)")
def new_elements(spark, d):
    return sessions.new_elements(_states(spark, d))


@query("""SELECT key, change FROM (SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'appeared' WHEN b.k IS NULL THEN 'disappeared' WHEN a.x <> b.x THEN 'moved' END AS change
FROM (SELECT s_suppkey AS k, s_nationkey AS x FROM supplier) a FULL JOIN (SELECT c_custkey + 20 AS k, c_nationkey AS x FROM customer) b ON a.k = b.k) WHERE change IS NOT NULL""")
def state_changes(spark, d):
    before = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("x"))
    after = table(spark, d, "customer").select((F.col("c_custkey") + 20).alias("key"), F.col("c_nationkey").alias("x"))
    return sessions.state_diff(before, after, ["key"], ["x"])


@query("SELECT session, step, arg_min(tab, tab) AS tab FROM (SELECT user_id AS session, event_id AS step, unnest(['a', 'b', 'c']) AS tab, event_id % 4 AS k FROM events) WHERE k = 0 AND tab = 'b' OR k = 1 AND tab = 'c' GROUP BY 1, 2")
def current_tabs(spark, d):
    e = _events(spark, d)
    pages = e.select("session", "step", F.col("props").alias("url"), F.col("event_type").alias("title"))
    own = lambda t, here: F.struct(F.lit(t).alias("tab"), F.col("props").alias("url"), F.when(here, F.col("event_type")).otherwise("other").alias("title"))
    tabs = e.select("session", "step", F.explode(F.array(own("a", _n() % 4 == 2), own("b", (_n() % 4 == 0) | (_n() % 4 == 2)), own("c", _n() % 4 == 1))).alias("t")).select("session", "step", "t.*")
    return sessions.current_tab(tabs, pages)


@query("SELECT event_id, event_type || '=' || CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' ELSE event_type END || ';n=' || event_id AS params FROM events")
def substituted_variables(spark, d):
    e = table(spark, d, "events").select("event_id", F.create_map(F.col("event_type"), F.col("event_type"), F.lit("n"), _n().cast("string")).alias("params"), "event_type")
    values = spark.createDataFrame([("click", "tap"), ("view", "look")], "old string, new string")
    out = sessions.substitute_variables(e, values, ["event_id", "event_type"])
    told = F.concat(F.col("event_type"), F.lit("="), F.element_at("params", F.col("event_type")), F.lit(";n="), F.element_at("params", "n"))
    return out.select("event_id", told.alias("params"))


# --- prompts ---------------------------------------------------------------


@query("""SELECT doc_id, 'Task: read ' || lang || chr(10) || 'Page URL: ' || source || chr(10) || 'Page title: t' || chr(10) || CASE WHEN doc_id % 3 > 0 THEN 'Note: ' || (doc_id % 3) || ' PII value(s) were redacted from the page context before this analysis.' || chr(10) ELSE '' END
 || chr(10) || 'Page context (sanitized):' || chr(10) || CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || '[...context truncated...]' ELSE text END || chr(10) || chr(10) || 'Generate the JSON action plan now.' AS prompt FROM documents""")
def planner_prompts(spark, d):
    row = table(spark, d, "documents")
    made = prompts.user_prompt(F.concat(F.lit("read "), "lang"), F.col("source"), F.lit("t"), F.col("doc_id") % 3, F.col("text"))
    return row.select("doc_id", made.alias("prompt"))


@query("""SELECT event_id, concat_ws(chr(10), CASE event_id % 3 WHEN 1 THEN 'Scanned the page — found 1 sensitive item (kept local, never sent anywhere).' WHEN 2 THEN 'Scanned the page — found 2 sensitive items (kept local, never sent anywhere).' END,
 CASE WHEN event_id % 5 = 1 THEN 'Blocked 1 injection attempt.' WHEN event_id % 5 > 1 THEN 'Blocked ' || (event_id % 5) || ' injection attempts.' END, 'Ready with a ' || (event_id % 7) || '-step plan. Review and approve to continue.', CASE WHEN event_type = 'click' THEN 'Note: slow page' END) AS message FROM events""")
def plan_messages(spark, d):
    warnings = F.when(F.col("event_type") == "click", F.array(F.lit("slow page"))).when(F.col("event_type") == "view", F.array(F.lit("2 redacted"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", prompts.plan_message(_n() % 3, _n() % 5, _n() % 7, warnings).alias("message"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END AS k, CASE WHEN event_id % 4 = 0 THEN 'not JSON of the schema' END AS error FROM events")
def parsed_results(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(_n() % 4 == 0, F.concat(F.lit("no "), "props")).otherwise(F.col("props")).alias("final_result"))
    return prompts.parse_results(e, "k bigint").select("event_id", F.col("parsed.k").alias("k"), "error")


_PART_ATTRS = {"type": "CASE p_size % 6 WHEN 0 THEN 'date' WHEN 1 THEN 'week' WHEN 2 THEN 'TIME' ELSE 'text' END", "title": "CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END", "alt": "p_name"}


def _part_attrs():
    return F.create_map(*[x for k, v in _PART_ATTRS.items() for x in (F.lit(k), F.expr(v))])


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'YYYY-MM-DD' WHEN 1 THEN 'YYYY-W##' WHEN 2 THEN 'HH:MM' END AS format, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS meaning, CASE WHEN p_partkey % 2 = 0 THEN '*' ELSE '' END || '[' || p_partkey || ']<input type=' || CASE p_size % 6 WHEN 0 THEN 'date' WHEN 1 THEN 'week' WHEN 2 THEN 'TIME' ELSE 'text' END || CASE WHEN p_size % 2 = 0 THEN ' title=' || p_type ELSE '' END || ' alt=' || p_name || ' />' AS line FROM part")
def element_lines(spark, d):
    attrs, n = _part_attrs(), F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey", prompts.format_hint(attrs["type"]).alias("format"), prompts.meaningful_text(attrs, F.lit("t")).alias("meaning"), prompts.element_line(n, F.lit("input"), attrs, n % 2 == 0).alias("line")
    )


@query("SELECT p_partkey, concat_ws(' ', 'image_alt=' || p_name, CASE WHEN p_size % 2 = 0 THEN 'image_title=' || p_type END, CASE WHEN p_partkey % 3 > 0 THEN 'image_src=' || p_partkey || '.png' END) AS context FROM part")
def image_contexts(spark, d):
    n = F.col("p_partkey")
    src = F.when(n % 3 > 0, F.concat(F.lit(" http://h/pic/"), n.cast("string"), F.lit(".png?v=1#x"))).otherwise("DATA:image/png;base64,xx")
    attrs = F.map_concat(_part_attrs(), F.create_map(F.lit("src"), src))
    return table(spark, d, "part").select("p_partkey", prompts.image_context(attrs).alias("context"))


@query("""SELECT event_id, '<page_stats>' || CASE WHEN event_id % 50 < 10 THEN 'Page appears empty - consider waiting - ' WHEN event_id % 3 > 0 AND event_id % 50 > 20 AND event_id % 200 < event_id % 50 * 5 THEN (event_id % 3) || ' network request(s) in flight and little text rendered - page may still be loading, consider waiting - ' ELSE '' END
 || '1 links, 2 interactive, 0 iframes' || CASE WHEN event_id % 2 > 0 THEN ', 1 images' ELSE '' END || ', ' || (event_id % 50) || ' total elements</page_stats>' || chr(10) || '<page_info>' || CASE WHEN event_id % 4 = 0 THEN '0.0' ELSE (event_id % 4) || '.0' END || ' pages above, ' || CASE WHEN event_id % 2 = 0 THEN '0.0' ELSE '1.5' END || ' pages below' || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' — scroll down to reveal more content' END
 || '</page_info>' || chr(10) || CASE WHEN event_type = 'view' THEN 'empty page' ELSE CASE WHEN event_id % 4 = 0 THEN '[Start of page]' || chr(10) ELSE '' END || left(props, 5) || CASE WHEN event_id % 2 = 0 THEN chr(10) || '[End of page]' ELSE '' END END AS state FROM events""")
def page_states(spark, d):
    lines = F.when(F.col("event_type") == "view", "").otherwise(F.col("props"))
    below = F.when(_n() % 2 == 0, 0.0).otherwise(1.5)
    return table(spark, d, "events").select("event_id", prompts.page_state(F.lit(1), F.lit(2), F.lit(0), _n() % 2, _n() % 50, _n() % 200, _n() % 3, _n() % 4, below, lines, most=5).alias("state"))


@query("""WITH o AS (SELECT p_size AS s, p_partkey AS i, CASE p_size % 5 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'UK' WHEN 2 THEN 'a/' || p_name WHEN 3 THEN p_partkey || '@x' ELSE p_name END AS v, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part),
c AS (SELECT s, count(*) AS n FROM o GROUP BY 1)
SELECT CAST(s AS BIGINT) AS select_idx, CAST(c.n AS INTEGER) AS count, string_agg(CASE WHEN o.n = 5 THEN '... ' || (c.n - 4) || ' more options...' ELSE left(p, 30) || CASE WHEN length(p) > 30 THEN '...' ELSE '' END END, '|' ORDER BY o.n) AS first, CASE WHEN c.n < 2 THEN NULL ELSE CASE s % 5 WHEN 0 THEN 'numeric' WHEN 1 THEN 'country/state codes' WHEN 2 THEN 'date/path format' WHEN 3 THEN 'email addresses' END END AS hint
FROM (SELECT *, (SELECT p_type || p_name FROM part WHERE p_partkey = i) AS p FROM o WHERE n <= 5) o JOIN c USING (s) GROUP BY s, c.n""")
def select_summaries(spark, d):
    kind, n = F.col("p_size") % 5, F.col("p_partkey").cast("string")
    value = F.when(kind == 0, n).when(kind == 1, "UK").when(kind == 2, F.concat(F.lit("a/"), "p_name")).when(kind == 3, F.concat(n, F.lit("@x"))).otherwise(F.col("p_name"))
    options = table(spark, d, "part").select(F.lit(1).alias("page_id"), F.col("p_size").cast("long").alias("select_idx"), F.col("p_partkey").alias("idx"), F.concat("p_type", "p_name").alias("text"), value.alias("value"))
    return prompts.select_options(options).select("select_idx", "count", F.array_join("first", "|").alias("first"), "hint")


_DESCRIPTIONS = ("Your E-mail please", "Mobile", "Full name", "User name", "passwd", "anything")


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'e' || c_custkey WHEN 1 THEN c_phone WHEN 2 THEN c_name WHEN 4 THEN c_mktsegment END AS value FROM (SELECT *, CAST(c_nationkey AS VARCHAR) AS c_phone FROM customer)")
def profile_values(spark, d):
    k = F.col("c_custkey")
    asked = F.element_at(F.array(*[F.lit(x) for x in _DESCRIPTIONS]), (k % 6 + 1).cast("int"))
    profile = {"email": F.concat(F.lit("e"), k.cast("string")), "phone": F.col("c_nationkey").cast("string"), "name": F.col("c_name"), "password": F.col("c_mktsegment")}
    return table(spark, d, "customer").select("c_custkey", prompts.profile_field(asked, profile).alias("value"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'old' END AS value, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'user-provided' ELSE 'page-derived' END AS source FROM customer")
def attached_values(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    steps = c.select("c_custkey", F.create_map(F.lit("data-value-source"), F.lit("page-derived")).alias("attrs"), F.lit("old").alias("value"))
    given, stored = c.where(k % 2 == 0).select("c_custkey", F.col("c_name").alias("value")), c.where(k % 3 == 0).select("c_custkey", F.col("c_mktsegment").alias("value"))
    out = prompts.attach_values(steps, given, stored, ["c_custkey"])
    return out.select("c_custkey", "value", F.element_at("attrs", "data-value-source").alias("source"))


@query("SELECT c_custkey AS want_id, CAST(CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 2 ELSE 0 END END AS INTEGER) AS idx FROM customer WHERE c_custkey % 4 < 3")
def matched_targets(spark, d):
    """A link that speaks of the market segment, a wrapper, a text input and a password input a page. (An automobile holds the hint mobile.)"""
    k = F.col("c_custkey")
    element = lambda i, tag, text, **attrs: F.struct(F.lit(i).alias("idx"), F.lit(tag).alias("tag"), text.alias("text"), (F.create_map(*[F.lit(x) for kv in attrs.items() for x in kv]) if attrs else F.expr("map()").cast("map<string,string>")).alias("attrs"))
    rows = F.array(element(0, "a", F.concat(F.lit("Go to "), "c_mktsegment")), element(1, "div", F.lit("your login email password")), element(2, "input", F.lit(""), type="text"), element(3, "input", F.lit(""), type="password"))
    elements = table(spark, d, "customer").select(k.alias("page_id"), F.explode(rows).alias("e")).select("page_id", "e.*")
    said = F.when(k % 4 == 0, "your login").when(k % 4 == 1, "The PASSWORD").when(k % 4 == 2, F.concat(F.lit("see the "), F.lower("c_mktsegment"))).otherwise("zz of")
    return prompts.match_targets(table(spark, d, "customer").select(k.alias("want_id"), k.alias("page_id"), said.alias("description")), elements)


_TASKS = (
    ("go to https://a.example/x, now", "https://a.example/x"), ("mail me@b.example and open shop.c.example/p.", "https://shop.c.example/p"), ("read report.pdf", None),
    ("compare a.example with b.example", None), ("never open bad.example", None), ("just work", None), ("file:///tmp/a.txt", "file:///tmp/a.txt"),
)


@query("SELECT event_id, CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {'NULL' if u is None else repr(u)}" for i, (_, u) in enumerate(_TASKS)) + " END AS url FROM events")
def start_urls(spark, d):
    task = F.element_at(F.array(*[F.lit(t) for t, _ in _TASKS]), (_n() % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", prompts.start_url(task).alias("url"))


@query("SELECT conv_id, turn, CASE WHEN n <= 4 THEN repeat('*', n) ELSE left(text, 1) || repeat('*', least(n - 2, 6)) || right(text, 1) END AS masked FROM (SELECT *, CAST(length(text) AS INTEGER) AS n FROM conversations)")
def masked_values(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.mask_value(F.col("text")).alias("masked"))


@query(f"SELECT category, {'CASE category ' + ' '.join(f'''WHEN '{c}' THEN '{c.replace('_', ' ').title()}' ''' for c in R.PLACEHOLDER_PREFIX) + ' END'} AS title FROM (SELECT DISTINCT list_extract({list(R.PLACEHOLDER_PREFIX)}, CAST(event_id % {len(R.PLACEHOLDER_PREFIX)} + 1 AS INTEGER)) AS category FROM events)")
def category_titles(spark, d):
    names = F.array(*[F.lit(c) for c in R.PLACEHOLDER_PREFIX])
    return table(spark, d, "events").select(F.element_at(names, (_n() % len(R.PLACEHOLDER_PREFIX) + 1).cast("int")).alias("category")).distinct().select("category", X.title_case(F.col("category")).alias("title"))


@query("SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 2592000 THEN (s // 86400) || 'd ago' ELSE (s // 2592000) || 'mo ago' END AS label FROM (SELECT event_id, CAST(event_id * event_id AS BIGINT) AS s FROM events)")
def time_labels(spark, d):
    """Ages in seconds: those of events from 4,294,968 on are longer than any two timestamps are apart."""
    return table(spark, d, "events").select("event_id", X.age_label(_n() * _n()).alias("label"))


@query("SELECT event_id, round(1 / (1 + exp(value - event_id % 5)), 6) AS p FROM events")
def two_class_odds(spark, d):
    return table(spark, d, "events").select("event_id", F.round(X.softmax2(F.col("value"), _n() % 5), 6).alias("p"))


@query("SELECT doc_id, hash_ AS same FROM (SELECT doc_id, count(*) OVER (PARTITION BY left(text, 2000), right(text, 2000), length(text)) AS hash_ FROM documents)")
def sample_hashes(spark, d):
    """Documents with the same sample, counted by its hash."""
    h = table(spark, d, "documents").select("doc_id", X.sample_hash(F.col("text")).alias("h"))
    same = h.groupBy("h").agg(F.count(F.lit(1)).alias("same"))
    return h.join(same, "h").select("doc_id", "same")


@query(f"""WITH t AS (SELECT p_partkey, 'div/input|' AS path, 'class=' || CASE WHEN p_size % 2 = 0 THEN 'box is-active' ELSE 'box' END || 'name=' || p_name AS whole, 'class=boxname=' || p_name AS stable FROM part)
SELECT p_partkey, left(sha256(path || whole || '|ax_name=x'), 16) AS hash, left(sha256(path || stable || '|ax_name=x'), 16) AS stable_hash FROM t""")
def element_hashes(spark, d):
    attrs = F.create_map(F.lit("name"), F.col("p_name"), F.lit("class"), F.when(F.col("p_size") % 2 == 0, "box is-active").otherwise("box"), F.lit("onclick"), F.lit("f()"))
    path = F.array(F.lit("div"), F.lit("input"))
    return table(spark, d, "part").select("p_partkey", X.element_hash(path, attrs, F.lit("x")).alias("hash"), X.element_hash(path, attrs, F.lit("x"), stable=True).alias("stable_hash"))

