"""Stored secrets in nested values and the page tree, against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pagewarden.operators import dom, redact
from pagewarden.sources.html_tree import page_tree

# --- stored secrets --------------------------------------------------------------


def plain(text, secrets):
    """The values in order, each in what no earlier one has replaced."""
    parts = [(text, False)]
    for value, name in sorted(secrets.items(), key=lambda s: (-len(s[0]), s[0])):
        out = []
        for part, done in parts:
            if done:
                out.append((part, True))
                continue
            for k, bare in enumerate(part.split(value)):
                out += [(f"<secret>{name}</secret>", True)] * (k > 0) + [(bare, False)]
        parts = out
    return "".join(p for p, _ in parts)


def masked(rows, stored, column, **how):
    return [r[column] for r in redact.mask_nested(rows, stored, column, **how).orderBy("id").collect()]


def stored(spark, secrets):
    return spark.createDataFrame([(n, v) for v, n in secrets.items()] + [("none", None), ("empty", "")], "name string, value string")


KIND = "struct<password: string, n: bigint, deep: array<struct<a: string, m: map<string,string>>>, `x.y`: array<string>>"


@pytest.mark.parametrize("most", [1 << 20, 12])
def test_nested_secrets(spark, most):
    """A quote, a backslash, a field's name, a number beside a number, a line end; in one automaton and in several."""
    secrets = {'pa"ss': "q", "back\\slash": "b", "password": "p", "12345": "num", "line\nend": "l", "ss": "short", "secret": "s", "école": "e"}
    values = [
        {"password": 'my pa"ss and back\\slash', "n": 12345, "deep": [{"a": "12345 ss", "m": {"password": "password", "k": None}}, None, {"a": None, "m": None}], "x.y": ["line\nend", None, ""]},
        {"password": None, "n": None, "deep": None, "x.y": []},
        None,
        {"password": "secret ﷐ école﷑ pa\"ssword", "n": 1, "deep": [], "x.y": ["passpa\"ss"]},
    ]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"id long, v {KIND}").repartition(2)

    def walk(v):
        if isinstance(v, str):
            return plain(v, secrets)
        if isinstance(v, list):
            return [walk(x) for x in v]
        return {k: walk(x) for k, x in v.items()} if isinstance(v, dict) else v

    got = [json.loads(json.dumps(v.asDict(True) if v else None)) for v in masked(rows, stored(spark, secrets), "v", most=most)]
    assert got == [walk(v) for v in values]


def test_many_secrets(spark):
    rng = random.Random(4)
    secrets = {f"{rng.randrange(10**9):09d}"[: rng.randrange(3, 10)]: f"n{k}" for k in range(100_000)}
    texts = ["".join(rng.choice("0123456789 ") for _ in range(200)) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = masked(rows, stored(spark, secrets), "text")
    again = masked(rows, stored(spark, secrets), "text", most=400_000)
    some = {v: n for v, n in secrets.items() if any(v in t for t in texts)}
    assert got == again == [plain(t, some) for t in texts]
    assert masked(rows, stored(spark, {}), "text") == texts


# --- page tree --------------------------------------------------------------------


def outline(html):
    tree = page_tree(html)
    return [(t, p, last, "".join(x for _, x in texts).strip()) for t, p, last, texts in zip(tree.tags, tree.parents, tree.last, tree.texts)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<p>b<div>c</div>d", [("p", None, 0, "a"), ("p", None, 1, "b"), ("div", None, 2, "c"), ("body", None, 3, "d")]),
        ("<body><ul><li>a<ul><li>b<li>c</ul><li>d</ul>e", [("body", None, 6, "e"), ("ul", 0, 6, ""), ("li", 1, 5, "a"), ("ul", 2, 5, ""), ("li", 3, 4, "b"), ("li", 3, 5, "c"), ("li", 1, 6, "d")]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", [("table", None, 5, ""), ("tr", 0, 3, ""), ("td", 1, 2, "a"), ("td", 1, 3, "b"), ("tr", 0, 5, ""), ("th", 4, 5, "c")]),
        ("<dl><dt>a<dd>b<dt>c</dl>", [("dl", None, 3, ""), ("dt", 0, 1, "a"), ("dd", 0, 2, "b"), ("dt", 0, 3, "c")]),
        ("<select><option>1<optgroup><option>2<optgroup><option>3</select>", [("select", None, 5, ""), ("option", 0, 1, "1"), ("optgroup", 0, 3, ""), ("option", 2, 3, "2"), ("optgroup", 0, 5, ""), ("option", 4, 5, "3")]),
        ("<div><span>a</div>b</span>", [("div", None, 1, ""), ("span", 0, 1, "a"), ("body", None, 2, "b")]),
        ("<td><table><tr><td><p>x</td>y", [("td", None, 4, ""), ("table", 0, 4, ""), ("tr", 1, 4, "y"), ("td", 2, 4, ""), ("p", 3, 4, "x")]),
        ("<body>a</body><p>b</html>c", [("body", None, 1, "a"), ("p", 0, 1, "bc")]),
        ("<head><title>t</title><p>x<html><body>y", [("head", None, 1, ""), ("title", 0, 1, "t"), ("p", None, 4, "x"), ("html", 2, 4, ""), ("body", 3, 4, "y")]),
        ("<svg><path/><p/></svg><div/>x", [("svg", None, 2, ""), ("path", 0, 1, ""), ("p", 0, 2, ""), ("div", None, 3, "x")]),
        ("<form><form>a</form>b", [("form", None, 0, "a"), ("body", None, 1, "b")]),
        ("<a>1<a>2<button>3<button>4", [("a", None, 0, "1"), ("a", None, 3, "2"), ("button", 1, 2, "3"), ("button", 1, 3, "4")]),
        ("<h1>a<h2>b</h1>c", [("h1", None, 0, "a"), ("h2", None, 1, "b"), ("body", None, 2, "c")]),
        ("", []),
        (None, []),
        ('<p a=1 a=2 b>x', [("p", None, 0, "x")]),
    ],
)
def test_implied_ends(html, want):
    assert outline(html) == want


PAGES = [
    '<ul><li style="display:none">secret<li>shown one<li>shown two</ul><p hidden>gone<p>visible para',
    '<html><body><div aria-hidden="true">a<div style="display:none">b</div>c</div><form action=/go><input name=q><select name=s><option value=1>one<option selected>two</select></form><a href=/x>link <b>bold</b> text</a></body></html>',
    "<p>" * 300 + "<div>" * 300 + "deep",
    None,
    "",
]


@pytest.fixture(scope="module")
def rows(spark):
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(PAGES)], "page_id long, html string")
    return dom.elements(pages.withColumn("idx", F.lit(1)).repartition(2))


def trees():
    return {i: page_tree(h) for i, h in enumerate(PAGES)}


def ancestors(tree, idx):
    while idx is not None:
        yield idx
        idx = tree.parents[idx]


def seen(tree, idx):
    given = dict(tree.attrs[idx])
    return not ("hidden" in given or given.get("aria-hidden") == "true" or re.search("display: *none", given.get("style", "")))


def test_unclosed_items_stay_visible(rows):
    got = {(r.page_id, r.idx) for r in dom.without_hidden(rows).collect()}
    assert got == {(i, k) for i, t in trees().items() for k in range(len(t.tags)) if all(seen(t, a) for a in ancestors(t, k))}
    hidden = {(r.page_id, r.text) for r in dom.hidden_content(rows).collect()}
    assert hidden == {(0, "secret"), (1, "a b c"), (1, "b")}


def test_subtree_texts(rows):
    """Whole, by depth and joined by lines, against the texts of all descendants; also where elements were dropped."""
    for max_depth, separator in ((None, None), (1, "\n"), (0, "\n")):
        want = {}
        for i, tree in trees().items():
            for k, texts in enumerate(tree.texts):
                for up, a in enumerate(ancestors(tree, k)):
                    if max_depth is None or up <= max_depth:
                        want.setdefault((i, a), []).extend(texts)
        join = lambda t: " ".join(" ".join(x for _, x in sorted(t)).split()) if separator is None else separator.join(x for _, x in sorted(t)).strip()
        got = {(r.page_id, r.idx): r.text for r in dom.subtree_text(rows, separator=separator, max_depth=max_depth).collect()}
        assert got == {k: join(v) for k, v in want.items() if v}
    shown = {(r.page_id, r.idx): r.text for r in dom.subtree_text(dom.without_hidden(rows)).collect()}
    assert shown[0, 0] == "shown one shown two" and (1, 2) not in shown


def test_containment(rows):
    """Options of selects, inputs of forms and elements within others against parents, climbed."""
    forms = {(r.page_id, r.form_idx): r.n_inputs for r in dom.form_inputs(rows).collect()}
    assert forms == {(1, 4): 2}
    told = rows.withColumn("in_form", dom.nearest(F.col("tag") == "form", F.col("idx"))).withColumn("in_div", dom.within(F.col("tag") == "div", strictly=True))
    for r in told.collect():
        tree = trees()[r.page_id]
        above = list(ancestors(tree, r.idx))
        assert r.in_form == next((a for a in above if tree.tags[a] == "form"), None)
        assert r.in_div == any(tree.tags[a] == "div" for a in above[1:])


def test_large_pages(spark):
    """50,000 unclosed paragraphs and 20,000 nested elements of one page, in rows of bounded size."""
    pages = spark.createDataFrame([(1, "<p>x" * 50_000), (2, "<div hidden>" + "<div>y" * 20_000)], "page_id long, html string")
    rows = dom.elements(pages)
    assert {(r.page_id, r.n, r.d) for r in rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("d")).collect()} == {(1, 50_000, 0), (2, 20_001, 20_000)}
    assert dom.without_hidden(rows).count() == 50_000
    top = rows.where("idx = 0")
    assert {(r.page_id, len(r.text)) for r in dom.subtree_text(rows, top).collect()} == {(1, 1), (2, 2 * 20_000 - 1)}
