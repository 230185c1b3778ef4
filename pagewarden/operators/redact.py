"""Reversible redaction, its statistics and the leak check."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions import rules as R
from ..functions import text as X


def placeholders(pii: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, value, category, placeholder: numbered by document and prefix in order of risk, rule
    and place; one for each distinct value, whose first category wins."""
    order = (F.desc(X.rank_of(F.col("risk"))), F.asc("ord"), F.asc("start"))
    once = pii.withColumn("n_", F.row_number().over(W.partitionBy(key, "value").orderBy(*order))).where("n_ = 1").withColumn("prefix", X.placeholder_prefix(F.col("category")))
    n = F.row_number().over(W.partitionBy(key, "prefix").orderBy(*order)).cast("string")
    number = F.when(F.length(n) >= 3, n).otherwise(F.lpad(n, 3, "0"))
    return once.select(key, "value", "category", F.concat(F.lit("["), "prefix", F.lit("_"), number, F.lit("]")).alias("placeholder"))


def redact_texts(texts: DataFrame, marks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every occurrence of every value becomes its placeholder, longest values first."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("n"), "value", "placeholder"))).alias("pairs")
    joined = texts.join(marks.groupBy(key).agg(pairs), key, "left")
    redacted = F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<n: int, value: string, placeholder: string>>")), F.col(text), lambda t, p: F.replace(t, p["value"], p["placeholder"]))
    return joined.select(key, redacted.alias("redacted"), F.coalesce(F.size("pairs"), F.lit(0)).alias("n_values"))


def redact_spans(texts: DataFrame, matches: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Replaces matches by their masks at their offsets, from right to left."""
    spans = F.sort_array(F.collect_list(F.struct("start", "end", "masked")), asc=False).alias("spans")
    joined = texts.join(matches.groupBy(key).agg(spans), key, "left")
    out = F.aggregate("spans", F.col(text), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), s["masked"], F.substring(t, s["end"] + 1, F.length(t))))
    return joined.select(key, F.coalesce(out, F.col(text)).alias("redacted"))


def redaction_stats(marks: DataFrame, key: str = "doc_id") -> DataFrame:
    c = F.col("category")
    named = ("email", "phone", "password_field", "api_key", "session_id", "custom")
    return marks.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c == "email").alias("emails"), F.count_if(c == "phone").alias("phones"),
        F.count_if(c.isin("password_field", "api_key", "session_id")).alias("credentials"), F.count_if(c == "custom").alias("form_values"), F.count_if(~c.isin(*named)).alias("other"),
    )


def leaks(outgoing: DataFrame, marks: DataFrame, key: str = "doc_id", text: str = "redacted") -> DataFrame:
    """Values of four characters or more, not in brackets, that outgoing text still holds; none if all is well."""
    return outgoing.join(marks, key).where((F.length("value") >= 4) & ~F.col("value").startswith("[") & F.contains(F.col(text), F.col("value"))).select(key, "value")


def forbidden_keys(requests: DataFrame, column: str = "request", keys: tuple[str, ...] = R.FORBIDDEN_KEYS) -> DataFrame:
    """Requests (JSON texts) that hold a key which must not go out, and the key: all columns and key."""
    low = F.lower(column)
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(f'"{k.lower()}":')), F.lit(k)) for k in keys]))
    return requests.withColumn("key", F.explode(hits))


def redact_corpus(texts: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, redacted, total, emails, phones, credentials, form_values, other and n_leaks of each row: ``found`` (see ``detect.distinct_pii``) becomes numbered
    placeholders, which replace its values; what still holds one is counted."""
    marks = placeholders(found, key)
    done = redact_texts(texts, marks, key, text)
    leaked = leaks(done, marks, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_leaks"))
    told = done.drop("n_values").join(redaction_stats(marks, key), key, "left").join(leaked, key, "left")
    counts = ("total", "emails", "phones", "credentials", "form_values", "other", "n_leaks")
    return told.select(key, "redacted", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


# --- stored secrets --------------------------------------------------------------

#: Bytes of stored values that one automaton holds; more of them take further passes over a text.
SECRET_BYTES = 16 << 20
#: Marks of replaced parts while further passes follow: characters that stand for no text. A text's own ones are doubled.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_MARKED = re.compile(f"({_OPEN}{_OPEN}|{_OPEN}[^{_CLOSE}]+{_CLOSE})")


def secret_blocks(secrets: DataFrame, most: int = SECRET_BYTES) -> Iterator[list[tuple[str, str]]]:
    """(value, name) of stored secrets, the longest values first, in blocks of about ``most`` bytes. A value with several names has the
    first of them."""
    once = secrets.where(F.length("value") > 0).groupBy("value").agg(F.min("name").alias("name"))
    block, size = [], 0
    for r in once.orderBy(-F.length("value"), "value").select("value", "name").toLocalIterator():
        if block and size + len(r.value) > most:
            yield block
            block, size = [], 0
        block.append((r.value, r.name or ""))
        size += len(r.value) + len(r.name or "")
    if block:
        yield block


def automaton_of(block: list[tuple[str, str]]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for rank, (value, name) in enumerate(block):
        machine.add_word(value, (rank, len(value), name))
    machine.make_automaton()
    return machine


def replace_secrets(text: str, machine: ahocorasick.Automaton) -> str:
    """``text`` in which each occurrence of a value is replaced by its name between marks. Of occurrences that overlap, the one of
    the first rank stays, then the one further left; replaced parts are not looked into again."""
    found = sorted((rank, end - size + 1, end + 1, name) for end, (rank, size, name) in machine.iter(text))
    if not found:
        return text
    starts, spans = [], []
    for _, start, end, name in found:
        k = bisect.bisect_left(starts, start)
        if (k == 0 or spans[k - 1][1] <= start) and (k == len(spans) or spans[k][0] >= end):
            starts.insert(k, start)
            spans.insert(k, (start, end, name))
    out, at = [], 0
    for start, end, name in spans:
        out += [text[at:start], _OPEN, "<secret>", name.replace(_CLOSE, ""), "</secret>", _CLOSE]
        at = end
    return "".join([*out, text[at:]])


def _leaves(values: pa.Array, change) -> pa.Array:
    """``values`` of any nested type with all its texts changed; keys and names of fields stay."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pa.array([None if v is None else change(v) for v in values.to_pylist()], kind)
    if pa.types.is_struct(kind):
        kids = [_leaves(kid, change) for kid in values.flatten()]
        return pa.StructArray.from_arrays(kids, fields=[kind.field(k) for k in range(kind.num_fields)], mask=values.is_null()) if kids else values
    if pa.types.is_map(kind):
        offsets = values.offsets
        whole = pa.MapArray.from_arrays(offsets, values.keys, _leaves(values.items, change), type=kind) if not values.null_count else None
        return whole if whole is not None else pa.array([None if v is None else [(k, e) for k, e in v] for v in _masked_maps(values, change)], kind)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        make = pa.ListArray if pa.types.is_list(kind) else pa.LargeListArray
        return make.from_arrays(values.offsets, _leaves(values.values, change), type=kind, mask=values.is_null())
    return values


def _masked_maps(values: pa.Array, change) -> list:
    """Maps of which some are null: their items changed as one array, then dealt out again."""
    told = values.to_pylist()
    items = _leaves(pa.array([e for v in told if v is not None for _, e in v], values.type.item_type), change).to_pylist()
    dealt = iter(items)
    return [None if v is None else [(k, next(dealt)) for k, _ in v] for v in told]


def _masked(column: Column, kind: DataType, block: list[tuple[str, str]], spark: SparkSession, first: bool, last: bool) -> Column:
    held = spark.sparkContext.broadcast(block)  # SECRET_BYTES at most
    machines: list[ahocorasick.Automaton] = []

    def change(text: str) -> str:
        if first and _OPEN in text:
            text = text.replace(_OPEN, _OPEN + _OPEN)
        if _OPEN not in text:
            text = replace_secrets(text, machines[0])
        else:
            text = "".join(part if k % 2 else replace_secrets(part, machines[0]) for k, part in enumerate(_MARKED.split(text)))
        if last and _OPEN in text:
            text = _MARKED.sub(lambda m: _OPEN if m[0] == _OPEN * 2 else m[0][1:-1], text)
        return text

    def mask(values: pa.Array) -> pa.Array:
        if not machines:
            machines.append(automaton_of(held.value))
        return _leaves(values, change)

    mask.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(mask, kind)(column)


def mask_nested(rows: DataFrame, secrets: DataFrame, column: str, most: int = SECRET_BYTES) -> DataFrame:
    """Replaces stored values (name, value) by <secret>name</secret> in every text within ``column``, a text or a nested value whose
    type stays; keys and names of fields are left. The longest values come first, equal ones by value; of occurrences that
    overlap the first stays, and no mark is looked into again. However many secrets there are, an automaton finds all of a block
    in one pass; null stays null."""
    kind, spark = rows.schema[column].dataType, rows.sparkSession
    block, first, blocks = None, True, secret_blocks(secrets, most)
    while (then := next(blocks, None)) or block:
        if block:
            rows = rows.withColumn(column, _masked(F.col(f"`{column}`"), kind, block, spark, first, then is None))
            first = False
        block = then
    return rows


def mask_known_secrets(texts: DataFrame, secrets: DataFrame, text: str = "text", most: int = SECRET_BYTES) -> DataFrame:
    """The same in a column of texts."""
    return mask_nested(texts, secrets, text, most)


def changes(marks: DataFrame, injections: DataFrame, key: str = "doc_id", width: int = 60) -> DataFrame:
    """key, type, original, replacement, category: what a stored record tells of its redactions and blocked injections."""
    a = marks.select(key, F.lit("redaction").alias("type"), F.substring("value", 1, width).alias("original"), F.col("placeholder").alias("replacement"), "category")
    b = injections.select(key, F.lit("injection-bound"), F.substring("content", 1, width), F.concat(F.lit("[UNTRUSTED CONTENT BLOCKED — "), F.upper("severity"), F.lit("]")), F.col("type"))
    return a.union(b)
