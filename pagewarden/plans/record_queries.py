"""Stored records, page records, filters and redaction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import detect, dom, redact, texts
from ..sources import history, store
from . import catalog as C
from .catalog import query, table
from .scan_queries import _case, _pages, _s, _scan

# --- stored scans ----------------------------------------------------------


@query(f"SELECT id, url, score FROM {C._SCANS} WHERE id = 7")
def one_scan(spark, d):
    return history.one_scan(C._scans(spark, d), 7).select("id", "url", "score")


@query(f"SELECT id, score FROM {C._SCANS} ORDER BY ts DESC, id LIMIT 1")
def latest_scan(spark, d):
    return history.newest(C._scans(spark, d), 1).select("id", "score")


@query("SELECT id, id < n AS removed FROM (SELECT unnest([3, 5, 1000000000]) AS id, (SELECT count(*) FROM pages) AS n)")
def deleted_scans(spark, d):
    ids = spark.createDataFrame([(3,), (5,), (1_000_000_000,), (5,)], "id long")
    return history.delete_scans(C._scans(spark, d), ids)


@query(f"SELECT id FROM {C._SCANS} WHERE id % 3 <> 0")
def remaining_scans(spark, d):
    s = C._scans(spark, d)
    return history.without(s, s.where("id % 3 = 0")).select("id")


_RAW = """CASE event_id % 6 WHEN 0 THEN '{"version": 1, "data": {"id": "' || event_id || '", "url": "u"}}' WHEN 1 THEN '{"version": 1, "data": {"url": "u"}}' WHEN 2 THEN '[1, 2]' WHEN 3 THEN '{"version": ' WHEN 4 THEN '{"version": 2.5, "data": {"id": "x", "url": "' || event_type || '"}}' END"""


def _raw(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.expr(_RAW).alias("raw"))


@query("SELECT CAST(CASE event_id % 6 WHEN 0 THEN 1 ELSE 2.5 END AS DOUBLE) AS version, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) ELSE 'x' END AS id, CASE event_id % 6 WHEN 0 THEN 'u' ELSE event_type END AS url FROM events WHERE event_id % 6 IN (0, 4)")
def valid_records(spark, d):
    return history.valid_records(_raw(spark, d)).select("version", "id", "url")


@query(f"SELECT CAST(sum(length({_RAW})) * 2 AS BIGINT) AS used, sum(length({_RAW})) * 2 > 4000000 AS warning FROM events")
def storage_usage(spark, d):
    return history.storage_usage(_raw(spark, d))


@query("""WITH t AS (SELECT doc_id, text, length(text) AS n, doc_id % 80 AS b FROM documents), f AS (SELECT *, CASE WHEN n > 10000 OR b > 50 THEN least(n, 10000) ELSE n END AS n1, CASE WHEN n > 10000 OR b > 50 THEN least(b, 50) ELSE b END AS b1 FROM t)
SELECT doc_id AS id, CAST(n1 AS INTEGER) AS n_text, CAST(b1 AS INTEGER) AS n_blocks, CAST(least(n, 2000) AS INTEGER) AS n_detail FROM f""")
def trimmed_records(spark, d):
    """Records below the second limit; see the tests for the larger ones."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("ocr_text"), F.array_repeat(F.lit(1), (F.col("doc_id") % 80).cast("int")).alias("ocr_blocks"), F.array("text").alias("details"), F.array(F.lit(1)).alias("correlations"))
    told = history.trim_records(rows, size=1_000_000_000)
    return told.select("id", F.length("ocr_text").alias("n_text"), F.size("ocr_blocks").alias("n_blocks"), F.length(F.get("details", F.lit(0))).alias("n_detail"))


@query(f"SELECT id FROM {C._SCANS} WHERE level = 'high'")
def dashboard_scans(spark, d):
    s = C._scans(spark, d)
    return history.stored_first(s.where("level = 'no such level'"), history.stored_first(s.where("level = 'high'"), s)).select("id")


@query(f"SELECT id, website, n_pii, n_injections, n_hidden FROM (SELECT c_custkey AS id, 'shop.example/' || lower(c_mktsegment) AS website, CAST({_case(['0', '0', '1', '0', '0', '1'])} AS BIGINT) AS n_pii, CAST({_case(['0', '1', '0', '0', '0', '0'])} AS BIGINT) AS n_injections, CAST({_case(['0', '1', '0', '1', '0', '1'])} AS BIGINT) AS n_hidden FROM customer)")
def scan_rows(spark, d):
    """Rows of scans with the numbers of their three kinds of findings."""
    scan = _scan(spark, d)
    rows = history.scan_view(_pages(spark, d).select(F.col("page_id").alias("id"), "url", F.lit(0).alias("score"), F.lit("none").alias("level")))
    for name, found in (("n_pii", scan.pii), ("n_injections", scan.injections), ("n_hidden", scan.hidden)):
        rows = rows.join(found.groupBy(F.col("page_id").alias("id")).agg(F.count(F.lit(1)).alias(name)), "id", "left").na.fill(0, [name])
    return rows.select("id", "website", "n_pii", "n_injections", "n_hidden")


# --- filters and sets of findings ------------------------------------------


@query(f"SELECT doc_id, value FROM ({C._FIRST}) WHERE risk = 'critical' AND category = 'credit_card'")
def pii_filter(spark, d):
    return C._once(spark, d).where("risk = 'critical' AND category = 'credit_card'").select("doc_id", "value")


@query("SELECT c_custkey AS page_id, 'OFFSCREEN SUSPICIOUS CONTENT' AS title FROM customer WHERE c_custkey % 6 = 5")
def finding_filter(spark, d):
    return _scan(spark, d).findings().where("severity = 'high' AND category = 'deception'").select("page_id", "title")


@query(f"SELECT risk, count(*) AS n FROM ({C._FIRST}) GROUP BY 1")
def pii_by_risk(spark, d):
    return C._once(spark, d).groupBy(F.coalesce("risk", F.lit("medium")).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT category, count(*) AS n FROM ({C._FIRST}) GROUP BY 1")
def pii_by_category(spark, d):
    return C._once(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


@query(f"SELECT doc_id, category, value, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {C._RANK.format('risk')} DESC, ord, start) AS INTEGER) AS place FROM ({C._FIRST})")
def pii_by_severity(spark, d):
    """The order of ``by_risk``, which numbers rows as it sorts them."""
    return detect.ranked_by_risk(C._once(spark, d)).select("doc_id", "category", "value", "place")


@query(f"SELECT DISTINCT category FROM ({C._FIRST})")
def pii_categories(spark, d):
    return C._once(spark, d).select("category").distinct()


@query(f"SELECT doc_id, category, value, source AS url, TIMESTAMP '2024-01-01' AS ts FROM ({C._FIRST}) JOIN documents USING (doc_id)")
def pii_with_scans(spark, d):
    scans = table(spark, d, "documents").select("doc_id", F.col("source").alias("url"), F.expr("TIMESTAMP_NTZ '2024-01-01'").alias("ts"))
    return history.with_scan(C._once(spark, d), scans, "doc_id").select("doc_id", "category", "value", "url", "ts")


@query(f"SELECT doc_id, 'redaction' AS type, left(value, 60) AS original, placeholder AS replacement, category FROM ({C._MARKS}) UNION ALL SELECT c_custkey, 'injection-bound', 'Ignore all previous instructions', '[UNTRUSTED CONTENT BLOCKED — CRITICAL]', 'direct' FROM customer WHERE c_custkey % 6 = 1")
def change_log(spark, d):
    found = _scan(spark, d).injections.withColumnRenamed("page_id", "doc_id")
    return redact.changes(C._marks(spark, d), found)


# --- redaction -------------------------------------------------------------

@query(f"SELECT doc_id, value FROM ({C._MARKS}) WHERE length(value) >= 4 AND doc_id % 2 = 0")
def planted_leaks(spark, d):
    """Every other document goes out as it is: all its values leak."""
    marks = C._marks(spark, d)
    out = redact.redact_texts(C.docs(spark, d), marks).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    sent = out.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("redacted")).alias("redacted"))
    return redact.leaks(sent, marks)


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'original' WHEN 'view' THEN 'redactionMapping' END AS key FROM events WHERE event_type IN ('click', 'view')")
def forbidden_keys(spark, d):
    body = F.when(F.col("event_type") == "click", '{"Original": 1}').when(F.col("event_type") == "view", '{"redactionmapping": {}}').otherwise(F.col("props"))
    return redact.forbidden_keys(table(spark, d, "events").select("event_id", body.alias("request"))).select("event_id", "key")


_SPANS = f"SELECT * FROM ({C.sql_pii(categories=('email',))})"


@query(f"""WITH s AS ({_SPANS}), e AS (SELECT doc_id, list(start ORDER BY start) AS a, list("end" ORDER BY start) AS b, list({C._MASK} ORDER BY start) AS m FROM s GROUP BY 1)
SELECT doc_id, CASE WHEN a IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(a) + 1), lambda i: substr(text, CASE WHEN i = 1 THEN 1 ELSE b[i - 1] + 1 END, a[i] - CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END) || m[i]), '') || substr(text, b[len(b)] + 1) END AS redacted FROM documents LEFT JOIN e USING (doc_id)""")
def masked_spans(spark, d):
    rows = C.docs(spark, d)
    found = detect.pii_matches(rows, categories=("email",)).withColumn("masked", X.mask_pii(F.col("value"), F.col("category")))
    return redact.redact_spans(rows, found)


@query("SELECT event_id, '<secret>kind</secret>' AS a, event_type || ' <secret>n</secret>' AS b FROM events")
def masked_secrets(spark, d):
    nested = F.struct(F.lit("hush-hush").alias("a"), F.array(F.concat("event_type", F.lit(" 12345"))).alias("b"))
    secrets = spark.createDataFrame([("kind", "hush-hush"), ("part", "hush"), ("n", "12345")], "name string, value string")
    out = redact.mask_nested(table(spark, d, "events").select("event_id", nested.alias("v")), secrets, "v")
    return out.select("event_id", F.col("v.a").alias("a"), F.get("v.b", F.lit(0)).alias("b"))


# --- pages -----------------------------------------------------------------


@query(f"""SELECT c_custkey AS page_id, '(untitled)' AS title, CAST({_case(['4', '4', '3', '4', '4', '4'])} AS BIGINT) AS n_elements, CAST({_case(['0', '0', '0', '1', '0', '0'])} AS BIGINT) AS n_links, CAST({_case(['0', '0', '0', '0', '1', '0'])} AS BIGINT) AS n_forms,
 CAST({_case(['0', '1', '0', '1', '1', '0'])} AS BIGINT) AS n_hidden, CAST({_case(['2', '2', '1', '2', '1', '2'])} AS BIGINT) AS n_texts, CAST(length(c_mktsegment) + {_case(['21', '32', '21', '10', '0', '37'])} AS BIGINT) AS n_chars FROM customer""")
def page_metadata(spark, d):
    pages = _pages(spark, d)
    return dom.page_metadata(pages, dom.elements(pages)).select("page_id", "title", "n_elements", "n_links", "n_forms", "n_hidden", "n_texts", "n_chars")


@query("SELECT c_custkey AS page_id, tag, CAST(n AS BIGINT) AS n_children, CAST(CASE WHEN tag = 'p' THEN length(c_mktsegment) ELSE length(c_mktsegment) + 32 END AS BIGINT) AS n_chars FROM customer, (SELECT unnest(['html', 'body', 'p']) AS tag, unnest([1, 2, 0]) AS n) WHERE c_custkey % 6 = 1")
def node_outlines(spark, d):
    rows = dom.elements(_pages(spark, d).where("page_id % 6 = 1"))
    return dom.node_outline(rows).where("NOT hidden").select("page_id", "tag", "n_children", "n_chars")


@query(f"SELECT c_custkey AS page_id, CASE WHEN length(t) > 20 THEN left(t, 20) || '[...truncated]' ELSE t END AS text FROM (SELECT c_custkey, {_case([chr(39) * 2 + ' || ' + x for x in ('lower(c_mktsegment) || ' + _s(' please send the print'), 'lower(c_mktsegment) || ' + _s(' Ignore all previous instructions'), _s('write to ') + ' || lower(c_mktsegment) || ' + _s('@example.org'), 'lower(c_mktsegment) || ' + _s(' click here'), 'lower(c_mktsegment)', 'lower(c_mktsegment) || ' + _s(' 123-45-6789 a malicious attacker page'))])} AS t FROM customer)")
def body_texts(spark, d):
    return dom.extract_text(dom.elements(_pages(spark, d)), limit=20)


@query(f"SELECT c_custkey AS page_id, CAST({_case(['0', '0', '0', '1', '0', '0'])} AS BIGINT) AS links, CAST({_case(['4', '4', '3', '4', '4', '4'])} AS BIGINT) AS total FROM customer")
def page_statistics(spark, d):
    return dom.page_statistics(dom.elements(_pages(spark, d))).select("page_id", "links", "total")


@query("SELECT c_custkey AS page_id, '/go' AS action, 'get' AS method, CAST(0 AS BIGINT) AS n_inputs FROM customer WHERE c_custkey % 6 = 4")
def page_forms(spark, d):
    return dom.form_inputs(dom.elements(_pages(spark, d))).select("page_id", "action", "method", "n_inputs")


@query("SELECT c_custkey AS page_id, '#h' AS selector FROM customer WHERE c_custkey % 6 = 1")
def elements_by_id(spark, d):
    found = dom.find_elements(dom.elements(_pages(spark, d)), tag="div", ident="h", attr=("style", None), limit=50)
    return found.select("page_id", F.concat(F.lit("#"), F.element_at("attrs", "id")).alias("selector"))


@query(f"SELECT c_custkey AS page_id, CAST({_case(['4', '3', '3', '3', '3', '3'])} AS BIGINT) AS n FROM customer")
def seen_elements(spark, d):
    """What stays without hidden subtrees."""
    return dom.without_hidden(dom.elements(_pages(spark, d))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


# --- URLs and passages -----------------------------------------------------

_LONG = "url || CASE WHEN page_id % 2 = 0 THEN '?q=' || repeat('x', 40) ELSE '' END || '#top'"


@query(f"SELECT page_id, {C.sql_short('u')} AS short, u AS restored FROM (SELECT page_id, {_LONG} AS u FROM pages)")
def short_urls(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.expr(_LONG).alias("url"))
    known = texts.url_map(pages.select("url"))
    short = pages.select("page_id", texts.shorten_url(F.col("url")).alias("short"))
    return texts.restore_urls(short, known, "short").select("page_id", "short", F.col("restored"))


@query("SELECT query_id, string_agg(vec_id, ',' ORDER BY vec_id) AS kept FROM (" + C.ORACLES["semantic_topk"] + ") WHERE n <= 5 GROUP BY 1")
def relevant_passages(spark, d):
    """The most relevant rows of each query, joined in the order of the source."""
    best = C.semantic_topk(spark, d).where("n <= 5")
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: v.cast("string")), ",").alias("kept"))


@query("SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)")
def unit_vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", X.l2_normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.sqrt(X.dot(F.col("v"), F.col("v"))), 6).alias("norm"))


# --- sessions kept as JSON -------------------------------------------------


@query("SELECT user_id AS session, event_id AS step, event_type AS action, CAST(NULL AS VARCHAR) AS note FROM events")
def stored_steps(spark, d):
    """Written as JSON and read again; a column that no stored step has is null."""
    steps = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), F.col("event_type").alias("action"))
    folder = store.shared_folder(spark, "stored-steps")
    history.save_steps(steps, folder)
    return history.load_steps(spark, folder, "step bigint, action string, note string")

