"""Form fields, links and media of HTML pages, one row each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "element string, role string, tag string, input_type string, name string, id string, label string, placeholder string, autocomplete string, alt string, title string, src string, href string, disabled boolean, selector_path string"
# fixed values: what is a field, a medium, a place for a background
_CONTROL = {"input", "textarea", "select", "button"}
_ROLES = {"button", "textbox", "checkbox", "radio", "link"}
_MEDIA = {"img", "canvas", "svg", "object", "embed", "iframe", "video"}
_PLACES = {"div", "section", "article", "header", "footer", "li", "span", "a", "figure"}
_LABELLED = {"input", "textarea", "select", "button", "meter", "output", "progress"}
_SHORT, _TINY, _DEEP = 80, 30, 6
#: Pages whose elements are held at once.
SOME = 64
_VOID = {"input", "img", "embed", "br", "hr", "meta", "link", "source", "area", "base", "col", "wbr", "track", "param"}
_UNSEEN = {"script", "style", "template", "noscript"}
#: Elements that end where another of these begins.
_ENDED_BY = {
    "li": {"li"}, "option": {"option", "optgroup"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "p": {"p", "div", "ul", "ol", "dl", "table", "form", "fieldset", "section", "article", "header", "footer", "nav", "aside", "main", "figure", "pre", "blockquote", "hr", "h1", "h2", "h3", "h4", "h5", "h6"},
}
_BACKGROUND = re.compile(r"url\([\"']?([^\"')]+)[\"']?\)")
_PIXELS = re.compile(r"(?:^|[;\s])(width|height)\s*:\s*([0-9.]+)px")
_PLAIN_ID = re.compile(r"[A-Za-z_\u0080-\uffff-][\w\u0080-\uffff-]*")


class _Element:
    """An element, where it stands, and which of the page's texts are in it."""

    __slots__ = ("tag", "attrs", "parent", "before", "nth", "children", "kinds", "begin", "end")

    def __init__(self, tag: str, attrs: dict, parent: "_Element | None", at: int):
        self.tag, self.attrs, self.parent, self.before = tag, attrs, parent, None
        self.children: _Element | None = None  # the last child so far
        self.kinds: dict[str, int] = {}  # children by tag
        self.begin, self.end, self.nth = at, None, 1
        if parent is not None:
            self.before, parent.children = parent.children, self
            self.nth = parent.kinds[tag] = parent.kinds.get(tag, 0) + 1


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {}, None, 0)
        self.open, self.elements, self.said = [self.root], [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while tag in _ENDED_BY.get(self.open[-1].tag, ()):
            self.open.pop().end = len(self.said)
        e = _Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1], len(self.said))
        self.elements.append(e)
        if tag in _VOID:
            e.end = e.begin
        else:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in _MEDIA and tag not in _VOID:  # as in an image of its own language
            self.open.pop().end = len(self.said)

    def handle_endtag(self, tag: str) -> None:
        if any(e.tag == tag for e in self.open[1:]):
            while (e := self.open.pop()).tag != tag:
                e.end = len(self.said)
            e.end = len(self.said)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in _UNSEEN:
            self.said.append(data)

    def text(self, e: _Element) -> str:
        return " ".join("".join(self.said[e.begin : e.end]).split())

    def rows(self) -> Iterator[dict]:
        """Fields and media in the order of the page, then what stands in backgrounds."""
        ids: dict[str, _Element] = {}
        labels: dict[int, _Element] = {}  # the first label of an element
        for e in self.elements:
            if e.attrs.get("id"):
                ids.setdefault(e.attrs["id"], e)
        for e in self.elements:
            if e.tag == "label" and e.attrs.get("for") in ids:
                labels.setdefault(id(ids[e.attrs["for"]]), e)
            if e.tag in _LABELLED:
                up = e.parent
                while up is not None and up.tag != "label":
                    up = up.parent
                if up is not None and "for" not in up.attrs:
                    labels.setdefault(id(e), up)
        backgrounds = []
        for e in self.elements:
            a, tag = e.attrs, e.tag
            if tag in _CONTROL or (tag == "a" and "href" in a) or a.get("role") in _ROLES or a.get("contenteditable") == "true":
                role = {"a": "link", "button": "button"}.get(tag, tag)
                yield self._row("field", e, a.get("role") or role, self._label(e, labels, ids))
            if tag in _MEDIA or (tag == "input" and a.get("type") == "file"):
                yield self._row("media", e, a.get("role") or ("file_input" if tag == "input" else "media"), self._label(e, labels, ids), src=a.get("src") or a.get("data"), alt=a.get("alt") or a.get("aria-label"))
            found = _BACKGROUND.search(a.get("style", "")) if tag in _PLACES else None
            if found and all(float(n) >= _TINY for _, n in _PIXELS.findall(a["style"])):
                backgrounds.append(self._row("media", e, "background_image", None, src=found[1], alt=a.get("aria-label") or a.get("alt")))
        yield from backgrounds

    def _label(self, e: _Element, labels: dict[int, _Element], ids: dict[str, _Element]) -> str | None:
        if id(e) in labels:
            return self.text(labels[id(e)]) or None
        told = e.attrs.get("aria-label")
        if not told and e.attrs.get("aria-describedby") in ids:
            return self.text(ids[e.attrs["aria-describedby"]]) or None
        if not told and e.before is not None:
            before = self.text(e.before)
            told = before if before and len(before) < _SHORT else None
        return told or self.text(e) or None

    def _way(self, e: _Element) -> str:
        if e.attrs.get("id"):
            own = e.attrs["id"]
            return "#" + (own if _PLAIN_ID.fullmatch(own) else re.sub(r"([^\w\u0080-\uffff-])", r"\\\1", own))
        parts = []
        while e.parent is not None and len(parts) < _DEEP:
            alone = e.parent is self.root or e.parent.kinds[e.tag] == 1
            parts.append(e.tag if alone else f"{e.tag}:nth-of-type({e.nth})")
            e = e.parent
        return " > ".join(reversed(parts))

    def _row(self, element: str, e: _Element, role: str, label: str | None, src: str | None = None, alt: str | None = None) -> dict:
        a, some = e.attrs, lambda name: e.attrs.get(name) or None
        return {
            "element": element, "role": role, "tag": e.tag, "input_type": (a.get("type") or "text") if e.tag == "input" else None, "name": some("name"), "id": some("id"), "label": label,
            "placeholder": some("placeholder"), "autocomplete": some("autocomplete"), "alt": alt or some("alt"), "title": some("title"), "src": "data:[inline]" if (src or "").startswith("data:") else src,
            "href": some("href"), "disabled": "disabled" in a, "selector_path": self._way(e),
        }


def page_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, FIELDS) of every control and medium in document order, then of backgrounds. A label
    is the first of: the text of the label that names or holds the field, aria-label, the text
    that describes it, that of the element before it where short, its own. A selector path is
    the id, or the last six elements with their number among those of their kind. Null pages
    have none. What depends on layout isn't told; a background is left out where its style
    gives a side of less than 30 pixels."""
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = [pa.bool_() if x.endswith("boolean") else pa.string() for x in FIELDS.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for first in range(0, b.num_rows, SOME):
                part = b.slice(first, SOME)
                at, rows = [], []
                for i, html in enumerate(part.column("_h").to_pylist()):
                    p = _Page()
                    p.feed(html or "")
                    p.close()
                    own = list(p.rows())
                    at += [i] * len(own)
                    rows += own
                yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(at, pa.int64())), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds))], names=[id_col, *names])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_h")).mapInArrow(run, f"`{id_col}` {kind}, {FIELDS}")
