"""Queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import actions, detect, dom, forms, interactive, redact, risk, screens, sessions, texts, views
from ..sources import history
from ..sources.tables import read_table as table
from ..sources.tables import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def docs(spark, d):
    return spread(table(spark, d, "documents"), "doc_id")


def talks(spark, d):
    return table(spark, d, "conversations")


# --- SQL building blocks ---------------------------------------------------


def _q(s: str) -> str:
    return s.replace("'", "''")


def sql_matches(pattern: str, source: str, keys: str, extra: str = "") -> str:
    """Rows keys, value, start, before for every match of ``pattern`` in ``text`` of ``source``."""
    return f"""SELECT {keys}, split_part(parts[i], chr(2), 1) AS value,
       CAST(length(replace(array_to_string(parts[1:i-1], ''), chr(2), '')) AS INTEGER) AS start,
       replace(array_to_string(parts[1:i-1], ''), chr(2), '') AS before
FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i
      FROM (SELECT *, string_split(regexp_replace(text, '({_q(pattern)})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM {source} WHERE text IS NOT NULL))
{extra}"""


_LUHN = "(length(regexp_replace(value, '\\D', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(regexp_replace(value, '\\D', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * CAST(substr(reverse(regexp_replace(value, '\\D', '', 'g')), i, 1) AS INT) > 9 THEN 2 * CAST(substr(reverse(regexp_replace(value, '\\D', '', 'g')), i, 1) AS INT) - 9 ELSE 2 * CAST(substr(reverse(regexp_replace(value, '\\D', '', 'g')), i, 1) AS INT) END ELSE CAST(substr(reverse(regexp_replace(value, '\\D', '', 'g')), i, 1) AS INT) END)) % 10 = 0)"
#: Verhoeff's check over the reversed digits: each is moved by its place (8 rows of 10), then multiplied (10 rows of 10).
_MOVED = ", ".join(str(x) for k in range(8) for x in X.shuffle(k))
_PRODUCT = ", ".join(str(X.dihedral(a, b)) for a in range(10) for b in range(10))
_DIGITS = "regexp_replace(value, '\\D', '', 'g')"
_VERHOEFF = f"""(regexp_matches({_DIGITS}, '^[2-9][0-9]{{11}}$') AND list_reduce(list_concat([0], list_transform(range(1, 13), lambda i: CAST([{_MOVED}][(i - 1) % 8 * 10 + CAST(substr(reverse({_DIGITS}), i, 1) AS INT) + 1] AS INT))),
 lambda c, x: CAST([{_PRODUCT}][c * 10 + x + 1] AS INT)) = 0)"""
_CHECKS = {"luhn": _LUHN, "verhoeff": _VERHOEFF}
_CATEGORIES = tuple(dict.fromkeys(r.category for r in R.PII_RULES))


def sql_pii(source: str = "documents", keys: str = "doc_id", categories=_CATEGORIES) -> str:
    parts = []
    for i, r in enumerate(R.PII_RULES):
        if r.category in categories:
            cond = "WHERE true"
            if r.near:
                cond += f" AND regexp_matches(right(before, {r.within}), '{_q(r.near)}')"
            if r.check:
                cond += f" AND {_CHECKS[r.check]}"
            parts.append(
                f"SELECT {keys}, {i} AS ord, '{r.category}' AS category, value, start, CAST(start + length(value) AS INTEGER) AS \"end\", '{r.risk}' AS risk, CAST({r.confidence} AS DOUBLE) AS confidence, '{_q(r.action)}' AS action, '{r.detected_by}' AS detected_by FROM ({sql_matches(r.pattern, source, keys)}) {cond}"
            )
    return "\nUNION ALL\n".join(parts)


def sql_injections(source: str, keys: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {keys}, {i} AS ord, '{t}' AS type, '{s}' AS severity, value AS content, start, CAST(start + length(value) AS INTEGER) AS \"end\" FROM ({sql_matches('(?:' + p + ')' if not p.startswith('(?') else p, source, keys)})"
        for i, (p, t, s) in enumerate(R.INJECTION_RULES)
    )


_RANK = "CASE {0} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_FIRST = f"SELECT * EXCLUDE n_ FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category, value ORDER BY ord, start) AS n_ FROM ({sql_pii()})) WHERE n_ = 1"
_MASK = """CASE category
 WHEN 'email' THEN left(value, 1) || repeat('*', greatest(length(split_part(value, '@', 1)) - 1, 2)) || '@' || split_part(value, '@', 2)
 WHEN 'phone' THEN array_to_string(list_transform(range(1, length(value) + 1), lambda i: CASE WHEN regexp_matches(substr(value, i, 5), '^\\d{5}') THEN '*' ELSE substr(value, i, 1) END), '')
 WHEN 'credit_card' THEN array_to_string(list_transform(range(1, length(value) + 1), lambda i: CASE WHEN regexp_matches(substr(value, i), '^\\d[\\d\\s\\-]*\\d{4}$') THEN '*' ELSE substr(value, i, 1) END), '')
 WHEN 'aadhaar' THEN '**** **** ' || right(regexp_replace(value, '\\D', '', 'g'), 4)
 WHEN 'ssn' THEN '***-**-' || right(value, 4) WHEN 'pan' THEN '*****' || substr(value, 6, 4) || '*'
 WHEN 'upi_id' THEN '****@***' WHEN 'bank_account' THEN repeat('*', greatest(length(value) - 4, 3)) || right(value, 4)
 WHEN 'date_of_birth' THEN '**/**/****' WHEN 'api_key' THEN left(value, 4) || repeat('*', greatest(length(value) - 8, 4)) || right(value, 4)
 WHEN 'session_id' THEN left(value, 4) || repeat('*', greatest(length(value) - 8, 4)) || right(value, 4)
 WHEN 'address' THEN '[REDACTED ADDRESS]' ELSE NULL END"""


def _pii(spark, d) -> DataFrame:
    return detect.pii_matches(docs(spark, d))


def _once(spark, d) -> DataFrame:
    return detect.distinct_pii(_pii(spark, d))


# --- detectors -------------------------------------------------------------


def _per_category(name: str):
    def run(spark, d):
        return detect.pii_matches(docs(spark, d), categories=(name,)).select("doc_id", "ord", "value", "start", "end", "confidence")

    run.__name__ = f"pii_{name}"
    QUERIES[run.__name__] = run
    ORACLES[run.__name__] = f'SELECT doc_id, ord, value, start, "end", confidence FROM ({sql_pii(categories=(name,))})'


for _name in _CATEGORIES:
    _per_category(_name)


@query(f"SELECT doc_id, ord, category, value, risk, confidence, {_RANK.format('risk')} AS rank FROM ({_FIRST})")
def pii_distinct(spark, d):
    return _once(spark, d).select("doc_id", "ord", "category", "value", "risk", "confidence", X.rank_of(F.col("risk")).alias("rank"))


@query(f"SELECT doc_id, category, value, {_MASK} AS masked FROM ({_FIRST})")
def pii_mask(spark, d):
    return _once(spark, d).select("doc_id", "category", "value", "masked")


@query(f"SELECT category, risk, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({_FIRST}) GROUP BY ALL")
def pii_counts(spark, d):
    return _once(spark, d).groupBy("category", "risk").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(sql_injections("conversations", "conv_id, turn"))
def injection_matches(spark, d):
    return detect.injections(talks(spark, d), ("conv_id", "turn"))


@query(f"""SELECT conv_id, turn, regexp_matches(text, '{_q('|'.join('(?:' + p.replace('(?is)', '(?s:').replace('(?i)', '') + (')' if '(?is)' in p else '') + ')' for p in R.AGENT_TARGETING))}', 'i') AS targets,
 regexp_matches(text, '{_q('|'.join('(?:' + p.replace('(?i)', '') + ')' for p in R.SUSPICIOUS))}', 'i') AS suspicious FROM conversations""")
def agent_text_flags(spark, d):
    t = F.col("text")
    return talks(spark, d).select("conv_id", "turn", detect.agent_targeting(t).alias("targets"), detect.suspicious(t).alias("suspicious"))


_WORDS60 = ", ".join(f"'{w}'" for w in R.TRIGGER_WORDS)


@query(f"SELECT conv_id, turn, round(CASE WHEN len(list_intersect(regexp_extract_all(lower(text), '\\b[a-z]+\\b'), [{_WORDS60}])) > 0 THEN 1 / (1 + exp(-7.0)) ELSE 1 / (1 + exp(1.0)) END, 6) AS p FROM conversations")
def injection_scores(spark, d):
    return talks(spark, d).select("conv_id", "turn", F.round(detect.injection_score(F.col("text")), 6).alias("p"))


@query(f"SELECT severity, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS severity) LEFT JOIN (SELECT severity, count(*) AS n FROM ({sql_injections('conversations', 'conv_id, turn')}) GROUP BY 1) USING (severity)")
def injection_severities(spark, d):
    found = detect.injections(talks(spark, d), ("conv_id", "turn")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    every = spark.sql("SELECT explode(array('critical', 'high', 'medium', 'low')) AS severity")
    return every.join(found, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query()
def injections_merged(spark, d):
    t = talks(spark, d)
    return detect.merge_injections(detect.injections(t, ("conv_id", "turn")), t, ("conv_id", "turn"))


@query()
def prompts_sanitized(spark, d):
    return detect.sanitize_prompt(talks(spark, d), ("conv_id", "turn"))


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(text, '{_q(p)}') THEN '{n}'" for n, p in R.INTENTS) + " ELSE 'fallback' END AS scenario FROM conversations")
def prompt_intent(spark, d):
    return talks(spark, d).select("conv_id", "turn", detect.route_intent(F.col("text"))["scenario"].alias("scenario"))


# --- risk and findings -----------------------------------------------------

_INJ = sql_injections("documents", "doc_id")
_WEIGHT = "CASE {0} WHEN 'critical' THEN 80 WHEN 'high' THEN 50 WHEN 'medium' THEN 25 WHEN 'low' THEN 10 ELSE 0 END"


@query(f"""WITH p AS (SELECT doc_id, count(*) AS n FROM ({_FIRST}) GROUP BY 1), j AS (SELECT doc_id, sum({_WEIGHT.format('severity')}) AS s FROM ({_INJ}) GROUP BY 1),
t AS (SELECT doc_id, least(coalesce(p.n, 0) * 20, 100) AS privacy, coalesce(s, 0) AS raw FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN p USING (doc_id) LEFT JOIN j USING (doc_id))
SELECT doc_id, CAST(privacy AS BIGINT) AS privacy, CAST(least(raw, 100) AS BIGINT) AS injection, CAST(0 AS BIGINT) AS hidden, CAST(0 AS BIGINT) AS visual_anomaly,
CASE WHEN greatest(privacy, raw) >= 80 THEN 'critical' WHEN greatest(privacy, raw) >= 60 THEN 'high' WHEN greatest(privacy, raw) >= 30 THEN 'medium' WHEN greatest(privacy, raw) > 0 THEN 'low' ELSE 'none' END AS overall FROM t""")
def legacy_risk(spark, d):
    return risk.legacy_risk(docs(spark, d), _once(spark, d), detect.injections(docs(spark, d)))


_CONTRIB = f"""SELECT doc_id, 'PII: ' || category AS source, 'privacy' AS category, CAST(least({_WEIGHT.format('arg_min(risk, ord)')} + CASE WHEN count(*) > 1 THEN 5 ELSE 0 END, 100) AS BIGINT) AS score, arg_min(risk, ord) AS severity FROM ({_FIRST}) GROUP BY doc_id, category
UNION ALL SELECT doc_id, 'Injection: ' || type, 'injection', CAST({_WEIGHT.format('arg_min(severity, ord * 1000000 + start)')} AS BIGINT), arg_min(severity, ord * 1000000 + start) FROM ({_INJ}) GROUP BY doc_id, type, left(content, 50)"""


def _contributions(spark, d):
    return risk.contributions(_once(spark, d), detect.injections(docs(spark, d)))


@query(_CONTRIB)
def risk_contributions(spark, d):
    return _contributions(spark, d).drop("place")


@query(f"""WITH c AS ({_CONTRIB}), g AS (SELECT doc_id, max(score) FILTER (category = 'privacy') AS p, max(score) FILTER (category = 'injection') AS i, count(*) AS n, count(DISTINCT category) AS k FROM c GROUP BY 1),
t AS (SELECT doc_id, coalesce(p, 0) AS privacy, coalesce(i, 0) AS injection, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN g USING (doc_id)),
s AS (SELECT *, CAST(least(floor(injection * CAST(0.4 AS DOUBLE) + privacy * CAST(0.35 AS DOUBLE) + 0.5), 100) AS BIGINT) AS score FROM t)
SELECT doc_id, score, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS level,
CASE WHEN n = 0 THEN 1.0 ELSE round(CAST(0.5 AS DOUBLE) + CASE WHEN n >= 2 THEN 0.15 ELSE 0 END + CASE WHEN n >= 4 THEN 0.1 ELSE 0 END + CASE WHEN k > 1 THEN 0.1 ELSE 0 END, 2) END AS confidence,
privacy, injection, CAST(0 AS BIGINT) AS deception, n AS n_contributions FROM s""")
def risk_assessment(spark, d):
    return risk.assess(docs(spark, d), _contributions(spark, d)).drop("n_privacy", "n_injection", "n_deception")


def _sql_part(kind: str, n: str) -> str:
    level = "CASE WHEN {0} >= 75 THEN 'critical' WHEN {0} >= 50 THEN 'high' WHEN {0} >= 25 THEN 'medium' ELSE 'low' END".format(kind)
    return f"CASE WHEN {kind} > 0 THEN '{kind.capitalize()} risk is ' || {level} || ' — ' || {n} || ' finding' || CASE WHEN {n} > 1 THEN 's' ELSE '' END || ' detected.' END"


_ADVISED = "concat_ws(' ', " + ", ".join(f"CASE WHEN {c} >= 25 THEN '{_q(t)}' END" for c, t in (("privacy", R.PRIVACY_ACTION), ("injection", R.INJECTION_ACTION))) + ")"


@query(f"""WITH k AS (SELECT doc_id, count(*) FILTER (category = 'privacy') AS n_p, count(*) FILTER (category = 'injection') AS n_i FROM ({_CONTRIB}) GROUP BY 1)
SELECT doc_id, CASE WHEN n_contributions = 0 THEN '{R.NO_THREATS}' ELSE concat_ws(' ', 'Overall risk: ' || upper(level) || ' (score ' || score || '/100).', {_sql_part('privacy', 'n_p')}, {_sql_part('injection', 'n_i')}) END AS explanation,
 CASE level WHEN 'none' THEN '{R.NO_ACTION}' WHEN 'low' THEN '{R.LOW_ACTION}' WHEN 'medium' THEN '{R.LEVEL_ACTION["medium"]} ' || {_ADVISED} WHEN 'high' THEN '{R.LEVEL_ACTION["high"]} ' || {_ADVISED} ELSE '{R.LEVEL_ACTION["critical"]} ' || {_ADVISED} END AS recommendation
FROM ({ORACLES['risk_assessment']}) LEFT JOIN k USING (doc_id)""")
def risk_explanations(spark, d):
    return risk.explanation(risk.assess(docs(spark, d), _contributions(spark, d)))


_LABEL = "CASE category " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in R.FINDING_LABELS.items()) + " END"


@query(f"""SELECT doc_id, 'unique:pii:' || category || ':' || value || ':' AS merge_key, {_LABEL} AS title, 'privacy' AS category, risk AS severity, confidence, 'SINGLE_SOURCE' AS strength,
 detected_by || ' detected ' || category || ': "' || {_MASK} || '"' AS detail, {_LABEL} || ' detected in the page. ' || action AS description FROM ({_FIRST})
UNION ALL SELECT doc_id, 'unique:injection:' || ord || ':' || start, 'Prompt Injection (' || type || ')', 'injection', severity, CAST(CASE severity WHEN 'critical' THEN 0.95 WHEN 'high' THEN 0.9 ELSE 0.8 END AS DOUBLE), 'SINGLE_SOURCE',
 type || ' prompt injection: "' || left(content, 120) || '"', 'A ' || type || ' prompt injection was detected: "' || left(content, 80) || '"' FROM ({_INJ})""")
def findings_merged(spark, d):
    rows = risk.findings(_once(spark, d), detect.injections(docs(spark, d)))
    told = risk.merge_findings(rows).withColumn("detail", F.get("evidence", F.lit(0))["detail"])
    return told.select("doc_id", "merge_key", "title", "category", "severity", "confidence", "strength", "detail", "description")


# --- redaction -------------------------------------------------------------

_PREFIX = "CASE category " + " ".join(f"WHEN '{c}' THEN '{p}'" for c, p in R.PLACEHOLDER_PREFIX.items()) + " END"
_ORDER = f"{_RANK.format('risk')} DESC, ord, start"
_MARKS = f"""SELECT doc_id, value, category, '[' || prefix || '_' || CASE WHEN n >= 100 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 3, '0') END || ']' AS placeholder
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, prefix ORDER BY {_ORDER}) AS n FROM (SELECT *, {_PREFIX} AS prefix, row_number() OVER (PARTITION BY doc_id, value ORDER BY {_ORDER}) AS v FROM ({_FIRST})) WHERE v = 1)"""


def _marks(spark, d):
    return redact.placeholders(_once(spark, d))


@query(_MARKS)
def placeholders(spark, d):
    return _marks(spark, d)


@query(f"""SELECT doc_id, count(*) AS total, count(*) FILTER (category = 'email') AS emails, count(*) FILTER (category = 'phone') AS phones, count(*) FILTER (category IN ('password_field', 'api_key', 'session_id')) AS credentials,
count(*) FILTER (category = 'custom') AS form_values, count(*) FILTER (category NOT IN ('email', 'phone', 'password_field', 'api_key', 'session_id', 'custom')) AS other FROM ({_MARKS}) GROUP BY doc_id""")
def redaction_stats(spark, d):
    return redact.redaction_stats(_marks(spark, d))


_PAIRS = f"(SELECT doc_id, list(struct_pack(v := value, p := placeholder) ORDER BY length(value) DESC, value) AS l FROM ({_MARKS}) GROUP BY 1)"
_FOLD = "list_reduce(list_concat([t], list_transform(l, lambda x: x.v || chr(1) || x.p)), lambda a, x: replace(a, split_part(x, chr(1), 1), split_part(x, chr(1), 2)))"
_REDACTED = f"SELECT doc_id, CASE WHEN l IS NULL THEN t ELSE {_FOLD} END AS redacted, CAST(coalesce(len(l), 0) AS INTEGER) AS n_values FROM (SELECT doc_id, text AS t, l FROM documents LEFT JOIN {_PAIRS} USING (doc_id))"


@query(_REDACTED)
def redacted_texts(spark, d):
    return redact.redact_texts(docs(spark, d), _marks(spark, d))


@query(f"SELECT doc_id, value FROM ({_MARKS}) JOIN ({_REDACTED}) USING (doc_id) WHERE length(value) >= 4 AND NOT starts_with(value, '[') AND contains(redacted, value)")
def leak_check(spark, d):
    marks = _marks(spark, d)
    return redact.leaks(redact.redact_texts(docs(spark, d), marks), marks)


# --- history: a page's scan has a score and level from its id --------------

_LEVEL = "CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END"
_SCANS = f"(SELECT *, {_LEVEL} AS level FROM (SELECT page_id AS id, url, (page_id * 37) % 101 AS score, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (page_id * 7 % 960) AS ts FROM pages))"
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


def _scans(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", (F.col("page_id") * 37 % 101).alias("score"), F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, CAST(page_id * 7 % 960 AS INT))").alias("ts"))
    return p.withColumn("level", X.level_of_score(F.col("score")))


@query(f"SELECT id, {_HOST} AS host FROM {_SCANS}")
def hostnames(spark, d):
    return _scans(spark, d).select("id", X.hostname(F.col("url")).alias("host"))


@query(f"""SELECT count(*) AS total_scans, count(*) FILTER (level = 'critical') AS critical_count, count(*) FILTER (level = 'high') AS high_count, count(*) FILTER (level = 'medium') AS medium_count, count(*) FILTER (level = 'low') AS low_count, count(*) FILTER (level = 'none') AS none_count,
count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-05') AS scans_today, CAST(floor(avg(score) + 0.5) AS BIGINT) AS average_risk, (SELECT count(*) FROM (SELECT {_HOST} AS h, max(score) AS m FROM {_SCANS} GROUP BY 1) WHERE m >= 50) AS high_risk_domains FROM {_SCANS}""")
def history_stats(spark, d):
    return history.stats(_scans(spark, d), F.lit("2024-01-05").cast("date"))


_DOMAINS = f"SELECT {_HOST} AS hostname, count(*) AS scan_count, max(score) AS highest_score, arg_min(level, -score) AS highest_level, max(ts) AS last_scan, min((ts, id)) AS first_ FROM {_SCANS} GROUP BY 1"


@query(f"SELECT * EXCLUDE first_ FROM ({_DOMAINS})")
def domain_stats(spark, d):
    return history.domain_stats(_scans(spark, d)).drop("first_")


@query(f"SELECT * EXCLUDE first_ FROM ({_DOMAINS} ORDER BY highest_score DESC, scan_count DESC, first_ LIMIT 5)")
def riskiest_domains(spark, d):
    return history.riskiest(history.domain_stats(_scans(spark, d)))


@query(f"SELECT * EXCLUDE first_ FROM ({_DOMAINS} ORDER BY scan_count DESC, first_ LIMIT 5)")
def most_scanned_domains(spark, d):
    return history.most_scanned(history.domain_stats(_scans(spark, d)))


@query(f"SELECT CAST(ts AS DATE) AS date, CAST(floor(avg(score) + 0.5) AS BIGINT) AS avg_score, count(*) AS scan_count FROM {_SCANS} GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def risk_trend(spark, d):
    return history.trend(_scans(spark, d))


@query(f"SELECT id FROM {_SCANS} WHERE level = 'high' AND (contains({_HOST}, 'a') OR contains(lower(url), 'a')) AND ts >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY")
def history_filter(spark, d):
    return history.filter_scans(_scans(spark, d), F.expr("TIMESTAMP_NTZ '2024-02-01'"), "high", "A", 20).select("id")


@query(f"SELECT id, regexp_replace(url, '^https?://', '') AS website, upper(left(regexp_replace(url, '^https?://', ''), 1)) AS initial, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS injection_level, CASE level WHEN 'critical' THEN 'critical' WHEN 'none' THEN 'clean' ELSE 'warning' END AS status FROM {_SCANS}")
def recent_scans_view(spark, d):
    return history.scan_view(_scans(spark, d))


@query(f"SELECT id, score FROM {_SCANS} ORDER BY ts DESC, id LIMIT 100")
def newest_scans(spark, d):
    return history.newest(_scans(spark, d)).select("id", "score")


@query(f"SELECT id FROM {_SCANS} WHERE id NOT IN (SELECT id FROM {_SCANS} WHERE level = 'high')")
def append_scans(spark, d):
    s = _scans(spark, d)
    return history.append_new(s.where("level = 'high'"), s.union(s)).select("id")


@query("SELECT page_id, length(html) AS n FROM (SELECT page_id, substr(html, 1, 2000000) AS html FROM pages WHERE length(trim(html)) > 0)")
def page_source(spark, d):
    return history.read_pages(table(spark, d, "pages")).select("page_id", F.length("html").cast("long").alias("n"))


@query("SELECT page_id, 'Valid URL' AS reason, true AS allowed FROM pages WHERE url LIKE 'https://%' UNION ALL SELECT page_id, 'HTTP URL (insecure but allowed)', true FROM pages WHERE url LIKE 'http://%'")
def url_safety(spark, d):
    v = X.url_verdict(F.col("url"))
    return table(spark, d, "pages").select("page_id", v["reason"].alias("reason"), v["allowed"].alias("allowed"))


# --- texts and vectors -----------------------------------------------------


@query("SELECT page_id, (trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text FROM pages")
def tag_stripped(spark, d):
    return table(spark, d, "pages").select("page_id", texts.strip_tags(F.col("html")).alias("text"))


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, trim(l[i]) AS passage FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE length(trim(l[i])) > 20")
def passage_split(spark, d):
    return texts.passages(docs(spark, d))


@query("""SELECT doc_id, CAST(n - 1 AS INTEGER) AS n, value, start, substr(before || value || after, greatest(start - 150, 0) + 1, start + length(value) + 150 - greatest(start - 150, 0)) AS context FROM (
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS n, substr(text, start + length(value) + 1) AS after FROM (""" + sql_matches(r"idiot|moron", "documents", "doc_id, text") + "))")
def search_in_texts(spark, d):
    return texts.search(docs(spark, d), r"idiot|moron")


def sql_short(url: str) -> str:
    base = f"regexp_extract({url}, '^[^?#]*')"
    after = f"substr({url}, length({base}) + 1)"
    return f"CASE WHEN length({after}) > 35 THEN {base} || left({after}, 25) || '...' || left(md5({after}), 7) ELSE {url} END"


@query(f"SELECT page_id, {sql_short('url')} AS short FROM pages")
def url_shorten(spark, d):
    return table(spark, d, "pages").select("page_id", texts.shorten_url(F.col("url")).alias("short"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '(?s).*?</think>', '', 'g'), ' ') AS text FROM conversations")
def think_stripped(spark, d):
    return talks(spark, d).select("conv_id", "turn", texts.strip_think(F.col("text")).alias("text"))


_COS = "round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6)"


@query(f"SELECT query_id, vec_id, similarity, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS n FROM (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE n <= 10")
def semantic_topk(spark, d):
    v = table(spark, d, "embeddings")
    return texts.top_similar(v.select("vec_id", "embedding"), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")))


# --- pages as elements -----------------------------------------------------


def _elements(spark, d):
    return dom.elements(spread(table(spark, d, "pages"), "page_id"))


_TAGS = ("a", "p", "li", "b")


@query("SELECT page_id, " + ", ".join(f"CAST(len(regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '<{t}[ >]')) AS BIGINT) AS n_{t}" for t in _TAGS) + " FROM pages")
def page_tag_counts(spark, d):
    return dom.tag_counts(_elements(spark, d), _TAGS).drop("n_elements")


@query()
def element_categories(spark, d):
    return dom.category_counts(_elements(spark, d))


@query()
def page_links(spark, d):
    return dom.links(_elements(spark, d))


@query()
def hidden_content(spark, d):
    return dom.hidden_content(_elements(spark, d))


@query()
def interactive_elements(spark, d):
    return interactive.interactive_index(_elements(spark, d))


@query()
def sibling_places(spark, d):
    return dom.sibling_place(_elements(spark, d))


# --- sessions: events as agent steps ---------------------------------------

_STEPS = "(SELECT user_id AS session, event_id AS step, event_type AS action, left(sha256(event_type), 12) AS hash, event_type <> 'error' AS ok, props AS element FROM events)"


def _steps(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), F.col("event_type").alias("action"), F.left(F.sha2("event_type", 256), F.lit(12)).alias("hash"), (F.col("event_type") != "error").alias("ok"), F.col("props").alias("element"))


@query(f"""WITH w AS (SELECT session, step, array_agg(hash) OVER (PARTITION BY session ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS held FROM {_STEPS} WHERE action <> 'view')
SELECT session, step, CAST(list_max(list_transform(list_distinct(held), lambda h: len(list_filter(held, lambda x: x = h)))) AS INTEGER) AS max_repetition FROM w""")
def loop_detector(spark, d):
    return sessions.repetition(_steps(spark, d), exempt=("view",))


@query(f"""WITH l AS (SELECT *, CASE WHEN hash = lag(hash) OVER (PARTITION BY session ORDER BY step) THEN 0 ELSE 1 END AS cut FROM {_STEPS}), g AS (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY step) AS island FROM l)
SELECT session, step, CAST(row_number() OVER (PARTITION BY session, island ORDER BY step) - 1 AS INTEGER) AS stagnation FROM g""")
def stagnation(spark, d):
    return sessions.stagnation(_steps(spark, d), "hash")


@query(f"SELECT session, step, coalesce(lag(element) OVER w = element AND lag(action) OVER w = action AND lag(ok) OVER w, false) AS redundant FROM {_STEPS} WINDOW w AS (PARTITION BY session ORDER BY step)")
def retry_detection(spark, d):
    return sessions.retries(_steps(spark, d))


@query(f"""WITH g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY step) AS g FROM {_STEPS})
SELECT session, step, CAST(s AS BIGINT) AS streak, s >= 3 AS replan FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY session, g ORDER BY step) AS s FROM g)""")
def failure_streaks(spark, d):
    return sessions.failure_streaks(_steps(spark, d))


@query(f"SELECT session, step, is_submit AND coalesce(max(is_fill) OVER (PARTITION BY session ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS sensitive_submit FROM (SELECT *, action = 'purchase' AS is_submit, CAST(action = 'signup' AS INTEGER) AS is_fill FROM {_STEPS})")
def sensitive_submit(spark, d):
    s = _steps(spark, d)
    return sessions.sensitive_submits(s.withColumns({"is_submit": F.col("action") == "purchase", "is_fill": F.col("action") == "signup"}))


@query(f"SELECT session, count(*) AS n_steps, count(*) FILTER (NOT ok) AS n_errors, bool_or(NOT ok) AS has_errors, min(step) FILTER (NOT ok) AS first_error_step, arg_max(action, step) AS last_action FROM {_STEPS} GROUP BY 1")
def session_totals(spark, d):
    return sessions.totals(_steps(spark, d))


@query(f"SELECT session, string_agg(action, ',' ORDER BY step) AS actions FROM {_STEPS} GROUP BY 1")
def action_names(spark, d):
    return sessions.action_names(_steps(spark, d))


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE ORDER BY ts DESC, event_id LIMIT 50")
def recent_messages(spark, d):
    e = table(spark, d, "events")
    last = e.agg((F.max("ts") - F.expr("INTERVAL 5 MINUTES")).alias("since"))
    return e.join(F.broadcast(last), F.col("ts") > F.col("since")).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts")


@query(f"SELECT session, step, CASE WHEN max_repetition >= 12 THEN 'stop' WHEN max_repetition >= 8 THEN 'strong' WHEN max_repetition >= 5 OR stagnation >= 5 THEN 'gentle' ELSE 'none' END AS nudge FROM ({ORACLES['loop_detector']}) JOIN ({ORACLES['stagnation']}) USING (session, step)")
def nudges(spark, d):
    s = _steps(spark, d)
    both = sessions.repetition(s, exempt=("view",)).join(sessions.stagnation(s, "hash"), ["session", "step"])
    return both.select("session", "step", sessions.nudge(F.col("max_repetition"), F.col("stagnation")).alias("nudge"))


# --- planned actions: events as steps --------------------------------------

_KINDS = {"click": "click", "view": "scroll", "purchase": "fill", "signup": "type", "error": "run"}


def _actions(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in _KINDS.items()])
    attrs = F.when(n % 5 == 0, F.create_map(F.lit("type"), F.lit("password"))).when(n % 5 == 1, F.create_map(F.lit("href"), F.lit("javascript"))).otherwise(F.create_map(F.lit("target"), F.lit("_blank")))
    return e.select(
        F.col("user_id").alias("plan"), n.alias("step"), kind.alias("type"), F.col("props").alias("value"), F.lit("#f").alias("selector"), F.lit("go").alias("description"), F.lit("input").alias("tag"),
        attrs.alias("attrs"), (n % 2 == 0).alias("requires_approval"), (n % 11 != 0).alias("safe"), (n % 31 * 1000).alias("timeout_ms"), F.array(n - F.col("user_id") % 3).alias("depends_on"),
    )


#: Risk of an action; ok and bad are medium risks, allowed and not.
_STEP_RISK = """CASE WHEN event_type = 'error' THEN 'critical' WHEN event_id % 11 = 0 THEN 'high' WHEN event_id % 31 = 0 THEN 'bad'
WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 1 THEN 'high' WHEN event_id % 5 = 0 THEN 'critical' ELSE 'ok' END
WHEN event_type = 'click' THEN CASE WHEN event_id % 5 > 1 THEN 'low' ELSE 'none' END
WHEN event_type = 'signup' AND event_id % 5 = 0 AND event_id % 2 = 1 THEN 'high' ELSE 'none' END"""
_STEP_VERDICTS = f"""SELECT plan, step, allowed AND NOT circular AS allowed, CASE WHEN allowed AND circular THEN 'medium' ELSE risk END AS risk FROM (SELECT *, r IN ('none', 'low', 'ok') AS allowed, CASE r WHEN 'ok' THEN 'medium' ELSE r END AS risk FROM (
SELECT user_id AS plan, event_id AS step, user_id % 3 = 0 AS circular, {_STEP_RISK} AS r FROM events))"""
_STEP_VERDICTS = f"SELECT plan, step, allowed, CASE risk WHEN 'bad' THEN 'medium' ELSE risk END AS risk FROM ({_STEP_VERDICTS})"


@query(_STEP_VERDICTS)
def action_verdicts(spark, d):
    return actions.step_verdicts(_actions(spark, d)).select("plan", "step", "allowed", "risk")


@query(f"SELECT plan, bool_and(allowed) AS allowed, CASE max({_RANK.format('risk')}) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS risk, count(*) FILTER (NOT allowed) AS n_blocked FROM ({_STEP_VERDICTS}) GROUP BY 1")
def plan_audit(spark, d):
    return actions.plan_verdicts(actions.step_verdicts(_actions(spark, d)))


_OPEN = r"\.open\s*\(\s*['\"](?!https?://)"


def _sql_group(name: str, patterns: tuple[str, ...]) -> str:
    tests = [f"regexp_matches(text, '{_q(p)}', 'i')" for p in patterns if p != _OPEN]
    if _OPEN in patterns:
        tests.append("regexp_matches(regexp_replace(text, '\\.open\\s*\\(\\s*[''\"]https?://', '', 'gi'), '\\.open\\s*\\(\\s*[''\"]', 'i')")
    return f"WHEN {' OR '.join(tests)} THEN '{_q(name)}'"


@query("SELECT page_id, CASE " + " ".join(_sql_group(n, p) for n, _, p in R.ACTION_PATTERNS) + " END AS category FROM (SELECT page_id, html AS text FROM pages)")
def dangerous_patterns(spark, d):
    return table(spark, d, "pages").select("page_id", actions.pattern_group(F.col("html"))["category"].alias("category"))


# --- screens: documents as read text, vectors as boxes ---------------------

_NORMAL = "trim(regexp_replace(regexp_replace(lower(text), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _sql_word(words: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains(n, '{w}') THEN '{w}'" for w in words) + " END"


@query(f"WITH s AS (SELECT doc_id AS page_id, {_NORMAL} AS n FROM documents WHERE trim(text) <> '') SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT page_id, '{k}' AS type, '{s}' AS severity, round(floor({b} * CAST(0.9 AS DOUBLE) * {w} * 100 + 0.5) / 100, 2) AS confidence, {_sql_word(words)} AS word FROM s"
    for k, s, b, w, words in [(r[0], r[1], r[2], r[3], r[4]) for r in R.VISUAL_REQUESTS if r[3]] + [("VISUAL_DOM_MISMATCH", "medium", 0.75, 0.8, R.VISUAL_SENSITIVE)]
) + ") WHERE word IS NOT NULL")
def visual_requests(spark, d):
    read = docs(spark, d).select(F.col("doc_id").alias("page_id"), "text", F.lit(0.9).alias("confidence"))
    found = screens.visual_requests(read, screens.inputs_of(_elements(spark, d)))
    return found.select("page_id", "type", "severity", F.round("confidence", 2).alias("confidence"), "word")


_BOXES = "(SELECT label AS image_id, vec_id AS box_id, CAST(floor(embedding[1] * 300) AS DOUBLE) AS x, CAST(floor(embedding[2] * 300) AS DOUBLE) AS y, 60.0::DOUBLE AS width, 40.0::DOUBLE AS height FROM embeddings)"


@query(f"""SELECT image_id, a, b, i / (4800 - i) AS iou FROM (SELECT a.image_id, a.box_id AS a, b.box_id AS b, greatest(least(a.x, b.x) + 60 - greatest(a.x, b.x), 0) * greatest(least(a.y, b.y) + 40 - greatest(a.y, b.y), 0) AS i
FROM {_BOXES} a JOIN {_BOXES} b ON a.image_id = b.image_id AND a.box_id < b.box_id) WHERE i / (4800 - i) > 0.5""")
def box_overlaps(spark, d):
    return screens.overlapping_boxes(_boxes(spark, d))


@query("""SELECT event_id, above, below, CASE WHEN h > v THEN round(t / (h - v) * 100, 1) ELSE 0.0 END AS percent, round(above / v, 1) AS pages_above, round(below / v, 1) AS pages_below, round(h / v, 1) AS total_pages FROM (
SELECT event_id, t, h, v, t AS above, greatest(h - v - t, 0) AS below FROM (SELECT event_id, event_id % 300 AS t, event_id % 5000 AS h, 128 AS v FROM events))""")
def scroll_positions(spark, d):
    n = F.col("event_id")
    return table(spark, d, "events").select("event_id", screens.scroll_info(n % 300, n % 5000, F.lit(128)).alias("s")).select("event_id", "s.*")


# --- reports ---------------------------------------------------------------


@query(f"SELECT severity, count(*) AS n FROM ({ORACLES['findings_merged']}) GROUP BY 1")
def finding_severities(spark, d):
    return findings_merged(spark, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT max(privacy) AS max_privacy, max(injection) AS max_injection, count(*) AS n_pages, count(*) FILTER (overall = 'critical') AS n_critical, count(*) FILTER (overall = 'none') AS n_clean FROM ({ORACLES['legacy_risk']})")
def report_totals(spark, d):
    return legacy_risk(spark, d).agg(
        F.max("privacy").alias("max_privacy"), F.max("injection").alias("max_injection"), F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("overall") == "critical").alias("n_critical"), F.count_if(F.col("overall") == "none").alias("n_clean")
    )


@query(f"SELECT conv_id, turn, {_NORMAL} AS normal FROM conversations")
def normalized_texts(spark, d):
    return talks(spark, d).select("conv_id", "turn", X.normalize(F.col("text")).alias("normal"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'success') THEN 'success' WHEN contains(lower(text), 'failure') THEN 'failure' ELSE 'neutral' END AS verdict FROM conversations")
def evaluation_verdicts(spark, d):
    low = F.lower("text")
    return talks(spark, d).select("conv_id", "turn", F.when(F.contains(low, F.lit("success")), "success").when(F.contains(low, F.lit("failure")), "failure").otherwise("neutral").alias("verdict"))


# --- forms: customers as filled fields -------------------------------------


def _form(spark, d) -> DataFrame:
    """Six fields and a button for each customer."""
    name, market, account = F.col("c_name"), F.col("c_mktsegment"), F.concat(F.lit("token-"), F.col("c_nationkey").cast("string"), F.lit("-secret"))
    attrs = lambda **given: F.create_map(*[x for k, v in given.items() for x in (F.lit(k.strip("_").replace("_", "-")), v if not isinstance(v, str) else F.lit(v))])
    every = [
        ("input", attrs(type="text", name="fullName", value=name)),
        ("input", attrs(type="PASSWORD", id="pw", value=market)),
        ("input", attrs(name="q", value=market)),
        ("input", attrs(type="hidden", name="again", value=market)),
        ("input", attrs(name="emailOrName", value="")),
        ("textarea", attrs(aria_label="street address", data_account=name)),
        ("button", attrs(title="a secret token", formaction=account)),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(t).alias("tag"), a.alias("attrs"), (market if t == "textarea" else F.lit("")).alias("own_text")) for i, (t, a) in enumerate(every)])
    return table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.explode(rows).alias("r")).select("page_id", "r.*", F.col("r.idx").alias("last_idx"))


_FIELDS = """(SELECT c_custkey AS page_id, unnest([
 {'idx': 0, 'selector': 'input[name="fullName"]', 'category': 'name', 'value': c_name, 'confidence': CAST(0.92 AS DOUBLE), 'risk': 'medium'},
 {'idx': 1, 'selector': 'input#pw', 'category': 'password_field', 'value': '[password input]', 'confidence': CAST(1.0 AS DOUBLE), 'risk': 'high'},
 {'idx': 4, 'selector': 'input[name="emailOrName"]', 'category': 'name', 'value': '[name field]', 'confidence': CAST(0.75 AS DOUBLE), 'risk': 'medium'},
 {'idx': 5, 'selector': 'textarea', 'category': 'address', 'value': c_mktsegment, 'confidence': CAST(0.92 AS DOUBLE), 'risk': 'medium'}]) AS f FROM customer)"""


@query(f"SELECT page_id, f.idx AS idx, f.selector AS selector, f.category AS category, f.value AS value, f.confidence AS confidence, f.risk AS risk FROM {_FIELDS}")
def field_findings(spark, d):
    return forms.field_findings(forms.fields(_form(spark, d))).select("page_id", "idx", "selector", "category", "value", "confidence", "risk")


def _form_redactions(spark, d):
    every = forms.fields(_form(spark, d))
    return forms.form_redactions(every, forms.field_findings(every))


@query("""SELECT c_custkey AS page_id, f.idx AS idx, f.category AS category, f.placeholder AS placeholder, f.fresh AS fresh FROM (SELECT c_custkey, unnest([
 {'idx': 0, 'category': 'name', 'placeholder': '[NAME_001]', 'fresh': true}, {'idx': 1, 'category': 'password_field', 'placeholder': '[PASSWORD_001]', 'fresh': true},
 {'idx': 2, 'category': 'custom', 'placeholder': '[SENSITIVE_001]', 'fresh': true}, {'idx': 3, 'category': 'custom', 'placeholder': '[SENSITIVE_001]', 'fresh': false},
 {'idx': 5, 'category': 'address', 'placeholder': '[SENSITIVE_001]', 'fresh': false}]) AS f FROM customer)""")
def form_redactions(spark, d):
    return _form_redactions(spark, d).select("page_id", "idx", "category", "placeholder", "fresh")


@query("""SELECT c_custkey AS page_id, f.idx AS idx, f.name AS name, f.original AS original, f.placeholder AS placeholder FROM (SELECT c_custkey, unnest([
 {'idx': 5, 'name': 'data-account', 'original': c_name, 'placeholder': '[SENSITIVE_002]'},
 {'idx': 6, 'name': 'formaction', 'original': 'token-' || c_nationkey || '-secret', 'placeholder': '[SENSITIVE_003]'}]) AS f FROM customer)""")
def attribute_redactions(spark, d):
    marks = _form_redactions(spark, d)
    return forms.attribute_redactions(forms.with_values_redacted(_form(spark, d), marks), marks)


@query("SELECT event_id, event_type IN ('signup', 'purchase', 'click') AND event_id % 4 < 3 OR event_id % 7 = 0 AS sensitive FROM (SELECT *, event_id % 4 AS r FROM events)")
def sensitive_fields(spark, d):
    n = F.col("event_id")
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in (("signup", "PASSWORD"), ("purchase", "file"), ("click", "hidden"))], F.lit("text"))
    attrs = F.create_map(F.lit("type"), F.when(n % 4 < 3, kind).otherwise("text"), F.lit("autocomplete"), F.when(n % 7 == 0, "cc-number").otherwise("name"))
    return table(spark, d, "events").select("event_id", screens.sensitive_field(attrs).alias("sensitive"))


@query("SELECT event_id, (h > 901 OR w > 801) AND CASE WHEN event_id % 3 = 0 THEN event_type = 'view' ELSE event_id % 3 = 1 END AS scrolls FROM (SELECT event_id, event_type, event_id % 1800 AS h, event_id % 1000 AS w FROM events)")
def scrollable_boxes(spark, d):
    n = F.col("event_id")
    tag = F.when(F.col("event_type") == "view", "DIV").otherwise("span")
    overflow = F.when(n % 3 == 1, "auto").when(n % 3 == 2, "hidden")
    return table(spark, d, "events").select("event_id", screens.scrollable(tag, n % 1800, F.lit(900), n % 1000, F.lit(800), overflow).alias("scrolls"))


# --- pages as text ---------------------------------------------------------


def _page_texts(spark, d):
    rows = _elements(spark, d)
    return dom.subtree_text(rows, rows.where("idx = 0")).select("page_id", "text")


@query()
def marked_injections(spark, d):
    found = detect.injections(_page_texts(spark, d), ("page_id",))
    return forms.mark_injections(_elements(spark, d), found)


@query()
def page_views(spark, d):
    rows, whole = _elements(spark, d), _page_texts(spark, d)
    pii = detect.distinct_pii(detect.pii_matches(whole, "page_id"), "page_id").select("page_id", "ord", "value", "category")
    found = detect.injections(whole, ("page_id",))
    return views.structured_view(rows, pii, found, dom.hidden_content(rows), "2024-01-01T00:00:00Z")


@query()
def markdown_pages(spark, d):
    return views.markdown(table(spark, d, "pages"))


@query()
def markdown_chunks(spark, d):
    return views.markdown_chunks(docs(spark, d), most=2000)


# --- plans -----------------------------------------------------------------

_PLANNER = """concat('{"riskLevel": "', event_type, '", "steps": [{"type": "', event_type, '", "selector": "", "value": 5}, {"type": "fill", "selector": "#a", "requiresApproval": false, "dependsOn": [1, 0, 2, 1.5, "1"]}, ', props, ']}')"""


@query("""SELECT event_id AS plan, s.step AS step, s.type AS type, s.selector AS selector, s.description AS description, s.requires_approval AS requires_approval, s.timeout_ms AS timeout_ms, s.n_needs AS n_needs FROM (SELECT event_id, unnest([
 {'step': 1::BIGINT, 'type': CASE event_type WHEN 'click' THEN 'click' ELSE 'wait' END, 'selector': NULL, 'description': 'Step 1: ' || CASE event_type WHEN 'click' THEN 'click' ELSE 'wait' END, 'requires_approval': false, 'timeout_ms': CASE event_type WHEN 'click' THEN 5000 ELSE 3000 END, 'n_needs': 0},
 {'step': 2::BIGINT, 'type': 'fill', 'selector': '#a', 'description': 'Step 2: fill', 'requires_approval': true, 'timeout_ms': 5000, 'n_needs': 2},
 {'step': 3::BIGINT, 'type': 'wait', 'selector': NULL, 'description': 'Step 3: wait', 'requires_approval': false, 'timeout_ms': 3000, 'n_needs': 0}]) AS s FROM events)""")
def planner_steps(spark, d):
    raw = table(spark, d, "events").select(F.col("event_id").alias("plan"), F.expr(_PLANNER).alias("raw"), F.lit("go").alias("prompt"))
    return actions.plans_from_json(raw).select("plan", "step", "type", "selector", "description", "requires_approval", "timeout_ms", F.size("depends_on").alias("n_needs"))


def _gated(spark, d):
    n = F.col("step")
    return _actions(spark, d).withColumns({
        "approved": n % 3 == 0, "completed": n % 13 != 0, "description": F.when(n % 2 == 0, "submit form").otherwise("go"),
        "depends_on": F.when(n % 17 == 0, F.array(n + 1)).otherwise(F.array().cast("array<bigint>")),
    })


@query(f"""SELECT plan, step, CASE WHEN NOT ok THEN 'blocked' WHEN step % 2 = 0 AND NOT approved THEN 'needs_approval' WHEN submits AND NOT approved AND filled = 1 THEN 'pending_submit' WHEN secret AND NOT approved THEN 'password_source' ELSE 'run' END AS outcome FROM (
SELECT *, coalesce(max(CAST(writes AND step % 13 <> 0 AS INTEGER)) OVER (PARTITION BY plan ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled FROM (
SELECT user_id AS plan, event_id AS step, ({_STEP_RISK}) IN ('none', 'low', 'ok') AS ok, event_id % 3 = 0 AS approved, event_type = 'click' AND event_id % 2 = 0 AS submits, event_type IN ('purchase', 'signup') AS writes,
event_type IN ('purchase', 'signup') AND event_id % 5 = 0 AS secret FROM events))""")
def gate_outcomes(spark, d):
    return actions.gate_outcomes(_gated(spark, d))


@query()
def plan_runs(spark, d):
    return actions.run_plans(_gated(spark, d))


@query()
def plan_results(spark, d):
    return actions.plan_results(actions.run_plans(_gated(spark, d)))


@query("SELECT p_partkey, p_size % 4 = 0 OR (p_size % 4 <> 0 AND p_type = 'ECONOMY' AND p_size % 2 = 0) AS opens, p_type = 'PROMO' OR contains(p_name, 'ring') AS lies_in FROM part")
def menu_steps(spark, d):
    size, kind = F.col("p_size"), F.col("p_type")
    attrs = F.map_from_arrays(
        F.array(F.lit("class"), F.lit("role"), F.lit("aria-expanded"), F.lit("aria-haspopup")),
        F.array(F.when(F.contains("p_name", F.lit("ring")), "Dropdown-Menu").otherwise("plain"), F.when(kind == "PROMO", "option").when(kind == "ECONOMY", "button").otherwise("none"), F.when(size % 2 == 0, "true").otherwise("mixed"), F.when(size % 4 == 0, "menu").otherwise("no")),
    )
    rows = table(spark, d, "part").select("p_partkey", attrs.alias("attrs"), F.lit("name").alias("ax_name"))
    return rows.select("p_partkey", actions.menu_opener().alias("opens"), actions.menu_item().alias("lies_in"))


# --- screens ---------------------------------------------------------------


def _sql_normal(column: str) -> str:
    return _NORMAL.replace("lower(text)", f"lower({column})")


@query(f"""SELECT page_id, idx, severity, round(floor(least(0.85 * CAST(0.9 AS DOUBLE) * (1 - ratio), 1) * 100 + 0.5) / 100, 2) AS confidence FROM (
SELECT page_id, idx, CASE WHEN {" OR ".join(f"contains(own, '{w}')" for w in R.INJECTION_KEYWORDS)} THEN 'high' ELSE 'low' END AS severity, len(list_filter(words, lambda w: contains(shown, w))) / CAST(len(words) AS DOUBLE) AS ratio
FROM (SELECT *, list_filter(string_split(own, ' '), lambda w: length(w) > 3) AS words FROM (SELECT conv_id AS page_id, CAST(turn AS INTEGER) AS idx, left({_sql_normal('c.text')}, 80) AS own, {_sql_normal('d.text')} AS shown FROM conversations c JOIN documents d ON conv_id = doc_id WHERE trim(d.text) <> '') WHERE length(own) >= 5)
WHERE len(words) > 0) WHERE ratio < 0.3""")
def hidden_mismatches(spark, d):
    hidden = talks(spark, d).select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("idx"), "text")
    shown = docs(spark, d).select(F.col("doc_id").alias("page_id"), "text", F.lit(0.9).alias("confidence"))
    return screens.hidden_mismatches(hidden, shown).select("page_id", "idx", "severity", F.round("confidence", 2).alias("confidence"))


def _boxes(spark, d):
    side = lambda i: F.floor(F.get("embedding", F.lit(i)) * F.lit(300).cast("float")).cast("double")
    return table(spark, d, "embeddings").select(F.col("label").alias("image_id"), F.col("vec_id").alias("box_id"), side(0).alias("x"), side(1).alias("y"), F.lit(60.0).alias("width"), F.lit(40.0).alias("height"))


@query(f"SELECT image_id AS page_id, box_id AS idx, CAST(-1 AS BIGINT) AS within FROM {_BOXES} WHERE greatest(least(x + 60, 80) - greatest(x, -80), 0) * greatest(least(y + 40, 60) - greatest(y, -60), 0) / 2400 >= 0.99 AND box_id % 5 <> 0")
def contained_elements(spark, d):
    boxes = _boxes(spark, d).select(F.col("image_id").alias("page_id"), F.col("box_id").alias("idx"), "x", "y", "width", "height")
    attrs = F.when(F.col("idx") % 5 == 0, F.create_map(F.lit("onclick"), F.lit("f()"))).otherwise(F.create_map(F.lit("role"), F.lit("none")))
    inner = boxes.select("*", F.col("idx").alias("last_idx"), F.lit("b").alias("tag"), attrs.alias("attrs"))
    top = boxes.select("page_id").distinct().select("page_id", F.lit(-1).cast("bigint").alias("idx"), F.lit(-80.0).alias("x"), F.lit(-60.0).alias("y"), F.lit(160.0).alias("width"), F.lit(120.0).alias("height"), F.lit(2**40).alias("last_idx"), F.lit("a").alias("tag"), F.create_map(F.lit("href"), F.lit("/")).alias("attrs"))
    return screens.contained_elements(inner.unionByName(top))


@query()
def kept_boxes(spark, d):
    return screens.suppress_boxes(_boxes(spark, d).withColumn("score", F.col("box_id") * 7919 % 101 / 101.0))
