"""A page's elements from its HTML, by the tree rules that hold for stored pages: implied end tags, scopes, elements that
cannot nest. Elements are numbered in document order; ``last`` is the highest number within an element and texts are
numbered too, so that a subtree is a range of either."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

# Element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul xmp li dd dt".split()
)
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
LIST_SCOPE = SCOPE | {"ol", "ul"}
BUTTON_SCOPE = SCOPE | {"button"}
TABLE_SCOPE = frozenset("html table template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = ENDS_P | SCOPE | VOID | IN_HEAD | frozenset(
    "body button col colgroup frame frameset head iframe input keygen select tbody textarea tfoot thead tr".split()
)
BODIES = frozenset("tbody tfoot thead caption colgroup".split())
CELLS = frozenset("td th".split())
RUBY = frozenset("rb rt rp rtc".split())


class PageTree(HTMLParser):
    """Columns of a page's elements: ``parents``, ``depths``, ``tags``, ``attrs``, ``texts`` (number, text), ``last``, ``first_text`` and
    ``end_text``. No implied element is added but a body for text that lies outside any element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents, self.depths, self.tags, self.attrs = [], [], [], []
        self.texts, self.last, self.first_text, self.end_text = [], [], [], []
        self.open: list[int] = []
        self.n_open: Counter[str] = Counter()
        self.n_texts = 0
        self.body: int | None = None
        self.seen_html = False

    # --- the open elements

    def top(self) -> str:
        return self.tags[self.open[-1]] if self.open else ""

    def pop(self) -> None:
        idx = self.open.pop()
        self.n_open[self.tags[idx]] -= 1
        self.last[idx], self.end_text[idx] = len(self.tags) - 1, self.n_texts

    def pop_through(self, wanted) -> None:
        while self.open:
            tag = self.top()
            self.pop()
            if tag in wanted:
                return

    def pop_until(self, stay) -> None:
        while self.open and self.top() not in stay:
            self.pop()

    def has(self, wanted, limits, passed=frozenset()) -> bool:
        """Whether an element of ``wanted`` is open within ``limits``; those in ``passed`` are no limit."""
        if not any(self.n_open[w] for w in wanted):
            return False
        for idx in reversed(self.open):
            tag = self.tags[idx]
            if tag in wanted:
                return True
            if tag in limits and tag not in passed:
                return False
        return False

    def end_where(self, wanted, limits, passed=frozenset()) -> None:
        if self.has(wanted, limits, passed):
            self.pop_through(wanted)

    # --- tags

    def implied_ends(self, tag: str) -> bool:
        """Closes what ``tag`` ends; whether the tag makes an element."""
        if self.n_open["svg"] or self.n_open["math"]:
            return True
        if tag == "html":
            first, self.seen_html = not self.seen_html, True
            return first
        if tag == "body":
            self.end_where({"head"}, frozenset())
            return self.body is None
        if tag == "head" and self.body is not None:
            return False
        if self.top() == "head" and tag not in IN_HEAD:
            self.pop()
        if tag == "form" and self.n_open["form"] and not self.n_open["template"]:
            return False
        if self.n_open["select"]:
            if tag == "select":
                self.end_where({"select"}, frozenset())
                return False
            if tag in ("input", "textarea", "keygen"):
                self.end_where({"select"}, frozenset())
        if tag == "li":
            self.end_where({"li"}, SPECIAL - {"li"}, {"address", "div", "p"})
        elif tag in ("dd", "dt"):
            self.end_where({"dd", "dt"}, SPECIAL - {"dd", "dt"}, {"address", "div", "p"})
        elif tag == "option":
            self.end_where({"option"}, {"select", "optgroup"} | SPECIAL)
        elif tag == "optgroup":
            self.end_where({"option"}, {"select", "optgroup"} | SPECIAL)
            self.end_where({"optgroup"}, {"select"} | SPECIAL)
        elif tag == "a":
            self.end_where({"a"}, SCOPE)
        elif tag == "button":
            self.end_where({"button"}, SCOPE)
        elif tag in RUBY:
            while self.top() in (RUBY if tag in ("rb", "rtc") else RUBY - {"rtc"}):
                self.pop()
        elif tag in BODIES or tag == "tr" or tag in CELLS:
            self.table_part(tag)
        elif tag == "table" and self.top() in ("table", "tbody", "tfoot", "thead", "tr"):
            self.pop_through({"table"})
        if tag in ENDS_P:
            self.end_where({"p"}, BUTTON_SCOPE)
        if tag in HEADINGS and self.top() in HEADINGS:
            self.pop()
        return True

    def table_part(self, tag: str) -> None:
        if not self.n_open["table"]:
            self.end_where(CELLS if tag in CELLS else {tag}, SPECIAL - CELLS - {tag})
            return
        stay = TABLE_SCOPE
        if tag == "tr":
            stay = TABLE_SCOPE | {"tbody", "tfoot", "thead"}
        elif tag in CELLS:
            stay = TABLE_SCOPE | {"tbody", "tfoot", "thead", "tr"}
        self.pop_until(stay)

    def handle_starttag(self, tag, attrs):
        if not self.implied_ends(tag):
            return
        idx = len(self.tags)
        if tag == "body":
            self.body = idx
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        self.parents.append(self.open[-1] if self.open else None)
        self.depths.append(len(self.open))
        self.tags.append(tag)
        self.attrs.append(list(given.items()))
        self.texts.append([])
        self.last.append(idx)
        self.first_text.append(self.n_texts)
        self.end_text.append(self.n_texts)
        if tag not in VOID:
            self.open.append(idx)
            self.n_open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        """The slash counts in drawings and formulas alone."""
        n, foreign = len(self.tags), self.n_open["svg"] or self.n_open["math"] or tag in ("svg", "math")
        self.handle_starttag(tag, attrs)
        if foreign and len(self.tags) > n and tag not in VOID:
            self.pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body") or tag in VOID or not (self.n_open[tag] or tag in HEADINGS):
            return
        if tag == "head":
            self.pop_through({"head"})
        elif tag == "p":
            self.end_where({"p"}, BUTTON_SCOPE)
        elif tag == "li":
            self.end_where({"li"}, LIST_SCOPE)
        elif tag in HEADINGS:
            self.end_where(HEADINGS, SCOPE)
        elif tag in BODIES or tag in CELLS or tag in ("table", "tr"):
            self.end_where({tag}, TABLE_SCOPE - {tag})
        elif tag in FORMATTING:
            self.end_where({tag}, SCOPE)
        elif tag in SPECIAL:
            self.end_where({tag}, SCOPE - {tag})
        else:
            self.end_where({tag}, SPECIAL)

    def handle_data(self, data):
        if not self.open and not data.strip():
            return
        if not self.open and self.body is None:
            self.handle_starttag("body", [])
        self.texts[self.open[-1]].append((self.n_texts, data))
        self.n_texts += 1

    def close(self):
        super().close()
        while self.open:
            self.pop()


def page_tree(html: str | None) -> PageTree:
    tree = PageTree()
    tree.feed(html or "")
    tree.close()
    return tree
