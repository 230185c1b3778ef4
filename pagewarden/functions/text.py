"""Column functions: matches with offsets, checks, masks, ranks, hosts, URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import BLOCKED_SCHEMES, DYNAMIC_CLASSES, LEVELS, PLACEHOLDER_PREFIX, SEVERITY_WEIGHT, STATIC_ATTRIBUTES, WORD_EDGE

MATCH = "array<struct<value: string, start: int, end: int>>"


def holds(text: Column, needs: str) -> Column:
    """Whether a text holds a literal, or a pattern if ``needs`` has other characters than letters, digits, @, _ and -."""
    return F.contains(text, F.lit(needs)) if re.fullmatch(r"[\w@-]+", needs) else text.rlike(needs)


#: Marks around matches, and what stands for them where a text holds them itself.
_BEGIN, _END, _OTHER = "\x01", "\x02", "\ufffd"
#: Matches whose places are summed in one go: positions are sums within blocks, then over blocks, so that no array grows
#: by one match at a time.
_BLOCK = 256


def find_all(text: Column, pattern: str, needs: str | None = None) -> Column:
    """All matches, left to right, with code-point offsets (end exclusive). The pattern must not match an
    empty text. ``needs`` is cheap to look for (see ``holds``) and occurs in every text with a match. A text is
    searched once; its matches are marked and it is cut at the marks."""
    java = pattern.replace(r"\b", WORD_EDGE) if WORD_EDGE not in pattern else pattern
    marked = F.regexp_replace(F.translate(text, _BEGIN + _END, _OTHER * 2), F.lit(java), F.lit(f"{_BEGIN}$0{_END}"))

    def placed(parts: Column) -> Column:
        n = F.size(parts) - 1
        value = lambda s: F.substring_index(s, _END, 1)

        def step(state: Column, s: Column) -> Column:
            end = state["pos"] + F.length(value(s))
            one = F.array(F.struct(value(s).alias("value"), state["pos"].alias("start"), end.alias("end")))
            return F.struct((state["pos"] + F.length(s) - 1).alias("pos"), F.concat(state["found"], one).alias("found"))

        def block(b: Column) -> Column:
            nothing = F.struct(F.lit(0).alias("pos"), F.array().cast(MATCH).alias("found"))
            return F.aggregate(F.slice(parts, b * _BLOCK + 2, F.lit(_BLOCK)), nothing, step)

        def join(state: Column, held: Column) -> Column:
            moved = F.transform(held["found"], lambda m: F.struct(m["value"].alias("value"), (m["start"] + state["base"]).alias("start"), (m["end"] + state["base"]).alias("end")))
            return F.struct((state["base"] + held["pos"]).alias("base"), F.concat(state["out"], F.array(moved)).alias("out"))

        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), block)
        none = F.struct(F.length(F.get(parts, F.lit(0))).alias("base"), F.array().cast(f"array<{MATCH}>").alias("out"))
        return F.when(n > 0, F.flatten(F.aggregate(blocks, none, join, lambda s: s["out"]))).otherwise(F.array().cast(MATCH))

    found = F.get(F.transform(F.array(F.split(marked, _BEGIN)), placed), F.lit(0))
    return found if needs is None else F.when(holds(text, needs), found).otherwise(F.array().cast(MATCH))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum ends in 0."""
    d = F.reverse(digits(value))

    def step(total: Column, i: Column) -> Column:
        x = F.substring(d, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + x - F.when(x > 9, 9).otherwise(0)

    n = F.length(d)
    return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0)


def dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon, on which the Verhoeff check rests."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def shuffle(times: int) -> list[int]:
    order = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    out = list(range(10))
    for _ in range(times):
        out = [order[x] for x in out]
    return out


def verhoeff(value: Column) -> Column:
    """12 digits, not beginning with 0 or 1, with a right check digit."""
    d = F.reverse(digits(value))
    product = F.array(*[F.array(*[F.lit(dihedral(a, b)) for b in range(10)]) for a in range(10)])
    moved = F.array(*[F.array(*[F.lit(x) for x in shuffle(k)]) for k in range(8)])

    def step(c: Column, i: Column) -> Column:
        digit = F.substring(d, i + 1, 1).cast("int")
        return F.get(F.get(product, c), F.get(F.get(moved, i % 8), digit))

    good = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), step) == 0
    return F.when((F.length(d) == 12) & ~digits(value).rlike("^[01]"), good).otherwise(False)


def mask_pii(value: Column, category: Column) -> Column:
    """A value masked as its category asks."""
    n = F.length(value)
    local = F.substring_index(value, "@", 1)
    stars = lambda count: F.repeat(F.lit("*"), count.cast("int"))
    tail = F.right(value, F.lit(4))
    return (
        F.when(category == "email", F.concat(F.left(local, F.lit(1)), stars(F.greatest(F.length(local) - 1, F.lit(2))), F.lit("@"), F.get(F.split(value, "@"), F.lit(1))))
        .when(category == "phone", F.regexp_replace(value, r"\d(?=\d{4})", "*"))
        .when(category == "ssn", F.concat(F.lit("***-**-"), tail))
        .when(category == "credit_card", F.regexp_replace(value, r"\d(?=[\d\s\-]*\d{4}$)", "*"))
        .when(category == "pan", F.concat(F.lit("*****"), F.substring(value, 6, 4), F.lit("*")))
        .when(category == "aadhaar", F.concat(F.lit("**** **** "), F.right(digits(value), F.lit(4))))
        .when(category == "upi_id", F.lit("****@***"))
        .when(category == "bank_account", F.concat(stars(F.greatest(n - 4, F.lit(3))), tail))
        .when(category == "date_of_birth", F.lit("**/**/****"))
        .when(category.isin("api_key", "session_id"), F.concat(F.left(value, F.lit(4)), stars(F.greatest(n - 8, F.lit(4))), tail))
        .when(category == "address", F.lit("[REDACTED ADDRESS]"))
        .when(category == "name", F.concat(F.left(value, F.lit(1)), stars(F.greatest(n - 1, F.lit(2)))))
        .when(category == "password_field", F.lit("[PASSWORD FIELD]"))
        .otherwise(stars(F.least(n, F.lit(8))))
    )


def mask_value(value: Column) -> Column:
    """First and last character with at most six stars between; all stars up to 4 characters."""
    n = F.length(value)
    stars = lambda c: F.repeat(F.lit("*"), c.cast("int"))
    return F.when(n <= 4, stars(n)).otherwise(F.concat(F.left(value, F.lit(1)), stars(F.least(n - 2, F.lit(6))), F.right(value, F.lit(1))))


def title_case(category: Column) -> Column:
    return F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", ""), r"\s+", " "))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def rank_of(level: Column) -> Column:
    out = F.when(level == LEVELS[0], 0)
    for i, name in enumerate(LEVELS[1:], 1):
        out = out.when(level == name, i)
    return out


def level_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (rank + 1).cast("int"))


def weight_of(level: Column) -> Column:
    out = F.when(level == "none", 0)
    for name, weight in SEVERITY_WEIGHT.items():
        out = out.when(level == name, weight)
    return out


def level_of_score(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").when(score > 0, "low").otherwise("none")


def legacy_level(top: Column) -> Column:
    return F.when(top >= 80, "critical").when(top >= 60, "high").when(top >= 30, "medium").when(top > 0, "low").otherwise("none")


def hostname(url: Column) -> Column:
    """Host of a URL; '' for opaque schemes; what precedes the first slash of anything else."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    bare = F.get(F.split(F.regexp_replace(url, r"^https?://", ""), "/"), F.lit(0))
    return F.coalesce(host, F.when(url.rlike(r"(?i)^(about|data|blob|javascript|mailto):"), F.lit("")).otherwise(F.when(bare == "", url).otherwise(bare)))


def url_verdict(url: Column) -> Column:
    """allowed, reason, risk of a URL; the first rule that applies."""
    t = F.trim(url)
    low = F.lower(t)
    verdict = lambda ok, reason, risk: F.struct(F.lit(ok).alias("allowed"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), F.lit(risk).alias("risk"))
    out = F.when(t == "", verdict(False, "Empty URL", "medium"))
    for scheme in BLOCKED_SCHEMES:
        out = out.when(low.startswith(scheme), verdict(False, f"Blocked URL scheme: {scheme}", "critical"))
    web = low.startswith("http://") | low.startswith("https://")
    return (
        out.when(low.rlike("[\\x00\\r\\n]"), verdict(False, "URL contains control characters", "critical"))
        .when(t.rlike(r"^[\w+.-]+:") & ~web, verdict(False, F.concat(F.lit("Unknown URL scheme: "), F.substring_index(t, ":", 1)), "high"))
        .when(web & F.try_parse_url(t, F.lit("HOST")).isNull(), verdict(False, "Malformed URL", "medium"))
        .when(low.startswith("http://"), verdict(True, "HTTP URL (insecure but allowed)", "low"))
        .otherwise(verdict(True, "Valid URL", "none"))
    )


def placeholder_prefix(category: Column) -> Column:
    out = None
    for name, prefix in PLACEHOLDER_PREFIX.items():
        out = F.when(category == name, prefix) if out is None else out.when(category == name, prefix)
    return out.otherwise("SENSITIVE")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm < 1e-12, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; 0 if a side is null or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm < 1e-12, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), 0.0).otherwise(value)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def correlation_confidence(base: Column, conf: Column, strength: Column) -> Column:
    return F.floor(F.least(base * F.least(conf, F.lit(1.0)) * strength, F.lit(1.0)) * 100 + 0.5) / 100


def age_label(seconds: Column) -> Column:
    """An age in whole seconds as "just now", or its whole minutes, hours, days or months of 30 days."""
    n = lambda k, unit: F.concat(F.call_function("div", seconds, F.lit(k)).cast("string"), F.lit(unit))
    return F.when(seconds < 60, "just now").when(seconds < 3600, n(60, "m ago")).when(seconds < 86400, n(3600, "h ago")).when(seconds < 30 * 86400, n(86400, "d ago")).otherwise(n(30 * 86400, "mo ago"))


def time_ago(ts: Column, now: Column) -> Column:
    return age_label(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp")))


def replace_first(text: Column, value: Column, by: Column) -> Column:
    """The first occurrence of a literal value replaced; the text as it is without one."""
    at = F.position(value, text)
    return F.when((at > 0) & (F.length(value) > 0), F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.length(value), F.length(text)))).otherwise(text)


def first_match(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first pattern that ``text`` matches; null without one."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in patterns])


def lookup(key: Column, entries: dict[str, str], default: str) -> Column:
    out = None
    for name, value in entries.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(default)


def lookup_rank(key: Column, names: tuple[str, ...]) -> Column:
    """The place of ``key`` among ``names``; null if it is none of them."""
    out = None
    for i, name in enumerate(names):
        out = F.when(key == name, i) if out is None else out.when(key == name, i)
    return out


def softmax2(first: Column, second: Column) -> Column:
    """Probability of the second of two classes from their logits."""
    top = F.greatest(first, second)
    return F.exp(second - top) / (F.exp(first - top) + F.exp(second - top))


def sample_hash(text: Column, width: int = 2000) -> Column:
    """A 64-bit hash of a text's first and last ``width`` characters and its length."""
    return F.xxhash64(F.left(text, F.lit(width)), F.right(text, F.lit(width)), F.length(text))


def element_hash(path: Column, attrs: Column, ax_name: Column, stable: bool = False) -> Column:
    """16 hex digits for an element by its tags from the root on, its static attributes in order of name and its accessible name;
    ``stable`` leaves out class names that tell a passing state."""
    known = F.map_filter(attrs, lambda k, _: k.isin(*STATIC_ATTRIBUTES))
    if stable:
        lasting = lambda v: F.array_join(F.array_sort(F.filter(F.split(v, r"\s+"), lambda c: ~F.lower(c).rlike("|".join(DYNAMIC_CLASSES)))), " ")
        known = F.map_filter(F.transform_values(known, lambda k, v: F.when(k == "class", lasting(v)).otherwise(v)), lambda k, v: (k != "class") | (v != ""))
    told = F.array_join(F.transform(F.array_sort(F.map_entries(known)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "")
    name = F.when(F.coalesce(ax_name, F.lit("")) != "", F.concat(F.lit("|ax_name="), ax_name)).otherwise("")
    return F.left(F.sha2(F.concat(F.array_join(path, "/"), F.lit("|"), told, name), 256), F.lit(16))
