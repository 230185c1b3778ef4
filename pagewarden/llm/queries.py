"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, mixing, near_join, quality, secrets, sharding, tokens, toxicity, trie, warc, whitening
from .shared import new_folder


#: Places that a word of a proximity match may lie off.
SLOP = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, of: int = 4, rest: int = 2) -> Column:
    """A null doc_id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(of)) == rest, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "n_sentences",
        "offending",
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality.judge(docs.select("doc_id", "text"), labels.where("quality = 1"))
    return judged.select("doc.doc_id", *[f"verdict.{c}" for c in (*quality.COUNTS, "base_failed", "kept", "quality_score")])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_token_ids(tokens.write_token_ids(table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 of the stored map decides; ``next_shard`` is the shard of version 2, with one more."""
    folder = new_folder(spark, "slot-map")
    told = sharding.shard_records(table(spark, sf_dir, "documents"), folder=folder)
    grown = sharding.grow(spark, folder).select("vslot", F.col("shard").alias("next_shard"))  # a row a slot
    return told.join(F.broadcast(grown), "vslot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        "map_version",
        "next_shard",
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records_of(table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan_versions(docs.select("doc_id", "text"), secrets.BlobLedger(spark))
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(told, 256).alias("base_sha256"), told.alias("spans"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(table(spark, sf_dir, "documents")).drop("keep")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    told = language.predict(docs, *language.train(docs.where(~out)))
    return told.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_quality,
        op3_decontamination,
        op4_token_files,
        op5_token_counts,
        op6_sharding,
        op7_warc,
        op8_secrets,
        op9_mixing,
        op10_near_join,
        op11_language,
        op12_whitening,
        op13_prefix_trie,
    )
}

_SECRETS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
)


def _secret_spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """doc_id, rank, kind, start, end of the matches: texts are cut at marks around each match."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(value) AS "end" FROM (
SELECT doc_id, split_part(parts[i], chr(2), 1) AS value, length(replace(array_to_string(parts[1:i-1], ''), chr(2), '')) AS start
FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '(?:{quoted})', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL)))
WHERE length(regexp_extract(value, '{quoted}', {group})) >= {least}"""


_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, array_to_string(w[i : i + 12], ' ') AS k, w[i : i + 12] AS ws, least(len(w), 13) AS n
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1),
tokens AS (SELECT doc_id, i - 1 AS pos, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
holders AS (SELECT word, count(DISTINCT doc_id) AS n_docs FROM tokens GROUP BY 1),
parts AS (SELECT k, n, off, word, row_number() OVER (PARTITION BY k ORDER BY n_docs, word, off) AS r
          FROM (SELECT k, n, i - 1 AS off, ws[i] AS word FROM (SELECT k, ws, n, unnest(range(1, n + 1)) AS i FROM (SELECT DISTINCT k, ws, n FROM bw))) JOIN holders USING (word)),
starts AS (SELECT doc_id, k, pos - off AS start FROM parts JOIN tokens USING (word) WHERE r = 1 AND pos >= off),
kept AS (SELECT k FROM parts GROUP BY k, n HAVING count(*) = n),
needs AS (SELECT doc_id, k, start, n, off, word, r = 1 AS r_lead, unnest(range(-{SLOP}, {SLOP} + 1)) AS shift FROM starts JOIN kept USING (k) JOIN parts USING (k)),
met AS (SELECT x.doc_id, k, start, n, count(DISTINCT off) AS n_met, count(*) FILTER (shift = 0) AS n_exact
        FROM needs x JOIN tokens y ON x.doc_id = y.doc_id AND x.word = y.word AND y.pos = start + off + shift WHERE NOT (r_lead AND shift <> 0) GROUP BY ALL),
near AS (SELECT doc_id, count(*) AS n_near FROM met WHERE n_met = n AND n_exact < n GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op8_secrets": f"""
WITH s AS ({" UNION ALL ".join(_secret_spans(i, *r) for i, r in enumerate(_SECRETS))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
      string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)""",
    "op10_near_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, common = p.n AND common = q.n AS same FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
      WHERE 5 * common >= 4 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
root AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1),
copy AS (SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS copy_id
         FROM documents LEFT JOIN (SELECT a, b FROM l WHERE same) s ON s.a = doc_id GROUP BY doc_id)
SELECT d.doc_id, class_id, copy_id, CAST(coalesce(n.n, 0) AS INTEGER) AS n_ngrams,
       (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links,
       (SELECT count(DISTINCT k.copy_id) FROM l JOIN copy k ON k.doc_id = l.b WHERE l.a = d.doc_id AND NOT l.same) AS n_class_links
FROM documents d JOIN root USING (doc_id) JOIN copy USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op13_prefix_trie": """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, CAST(conv_id AS VARCHAR) AS digits FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, digits, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM ids
        UNION ALL
        SELECT conv_id, digits, i + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)
        FROM (SELECT conv_id, digits, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(digits, i // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM crc WHERE i < 8 * length(digits))),
heads AS (SELECT conv_id, CAST(xor(c, CAST(4294967295 AS BIGINT)) % 6 AS BIGINT) AS h FROM crc WHERE i = 8 * length(digits)),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS t
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY 1),
built AS (SELECT conv_id, list_concat(coalesce(b.t[1 : h], []), own.t[h + 1 :]) AS t
          FROM ids JOIN heads USING (conv_id) JOIN own USING (conv_id) LEFT JOIN (SELECT conv_id AS base, t FROM own) b USING (base)),
steps AS (SELECT conv_id, d, t[1 : d] AS p, len(t) = d AS ends FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM built)),
nodes AS (SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(any_value(p[d].text)), 0) AS saved,
          sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM steps GROUP BY p),
kids AS (SELECT p[1 : depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
told AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
sums AS (SELECT p[1 : d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
         FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM told) GROUP BY 1)
SELECT told.conv_id, told.depth, up.conv_id AS parent_conv_id, told.n_convs, told.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, told.ends_sha256
FROM told JOIN sums USING (p) LEFT JOIN nodes up ON told.depth > 0 AND up.p = told.p[1 : told.depth - 1]""",
}
