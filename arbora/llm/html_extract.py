"""HTML extraction: main text of a page by two passes over its blocks.

One forward scan cuts the page into blocks, each with its text, the share of its
characters inside links, and the element that holds it. Menus, headers, footers,
sidebars, adverts, notices, forms, comments and the like are out at once, by tag,
role or class words. A class word never rules out an element around the page's
primary section (its ``main``, and the ``article`` with most text that is no comment), nor does a
compound word around most of the page's text. Pass one classifies the other
blocks without context, by length, stop-word density and link density; short
blocks stay undecided. Pass two gives those the label of the nearest decided
neighbour of their section; where a section has none, an article counts as text
and other markup does not.

The scan is linear: each character is consumed once, open elements are counted
by name, and at most one tag is rescanned for a quote that never ends.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import text_blocks

#: Frequent function words of the supported languages.
STOP_WORDS = frozenset(
    """the of and a to in is that it was for on are as with his they at be this from have or by had not but what all were when
    le la les de des du un une et est en que qui dans pour pas sur au avec il elle ce se ne plus par
    der die das und ist in den von zu mit sich auf für nicht ein eine als auch es an werden aus er hat dass
    el los las y en un una que por con para del se su al lo como más pero sus""".split()
)
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINK_MAX = 70, 200, 0.2, 0.3, 0.5

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+)>")
_BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_PART = re.compile(r"[^a-z0-9]+")
_RAW = {t: re.compile(rf"</{t}\s*+>", re.I) for t in ("script", "style", "noscript", "textarea", "title", "iframe", "xmp")}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCK = _HEADINGS | frozenset("p div li td th tr table tbody thead caption blockquote pre section article main ul ol dl dt dd figure figcaption hr address fieldset details summary body html head nav header footer aside form center menu dialog".split())
_OPENED = _HEADINGS | frozenset("p div section article main ul ol li dl table tr td th figure blockquote nav header footer aside form fieldset details dialog center menu span button label svg select object template".split())
_LISTED = frozenset("ul ol menu li table tr td th".split())
#: What a start tag of the key ends first if it is the innermost open list or table part.
_ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
_OUT_TAGS = frozenset("nav footer aside menu dialog button label svg select object template".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply".split())
_OUT_WORDS = _COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login sidebar aside widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar share sharing social related recommended form search disclaimer copyright".split()
)
#: Parts of class words that speak of the layout around an element, not of the element.
_STATES = frozenset("no not non without with has is js hide show open closed enabled disabled".split())
#: Why an element is out: its nature; a class word of its own; a compound class word; a form; comments. All but the first yield to the primary section.
_NATURE, _WORD, _COMPOUND, _FORM, _COMMENTS = 1, 2, 3, 4, 5


class _Piece:
    __slots__ = ("text", "linked", "main")

    def __init__(self, text: str, linked: int, main: bool):
        self.text, self.linked, self.main = text, linked, main


def _left_out(name: str, attrs: str, in_main: bool) -> int:
    """Why an element is out, 0 if it isn't."""
    if name in _OUT_TAGS or (name == "header" and not in_main):
        return _NATURE
    form = _FORM if name in ("form", "fieldset") else 0
    if not attrs or attrs.isspace():
        return form
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)}
    if found.get("role") in _OUT_ROLES or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or "hidden" in found:
        return _NATURE
    if form:
        return form
    words = [*found.get("class", "").split(), found.get("id", "")]
    if name in ("article", "main", "body", "html"):
        return _COMMENTS if name == "article" and any(w.startswith(("comment", "reply")) for w in words) else 0
    why = 0
    for word in words:
        parts = [p for p in _PART.split(word) if p]
        bad = _OUT_WORDS.intersection(parts)
        if in_main:
            bad -= {"header"}
        if not bad or (len(parts) > 1 and not _STATES.isdisjoint(parts)):
            continue
        if bad & _COMMENT_WORDS:
            return _COMMENTS
        why = _WORD if len(parts) == 1 else why or _COMPOUND
    return why


class _Page:
    """The open and closed elements of a page, in order of their start tags, and its blocks."""

    def __init__(self):
        self.names, self.parents, self.why, self.ended, self.own = [""], [0], [0], [True], [0]
        self.main = [False]
        self.opened, self.listed = [0], []
        self.count: dict[str, int] = {}
        #: Blocks: parts (element, text, linked).
        self.blocks: list[list[tuple[int, str, bool]]] = [[]]

    def open(self, name: str, attrs: str) -> None:
        up = self.opened[-1]
        k = len(self.names)
        self.names.append(name)
        self.parents.append(up)
        self.main.append(self.main[up] or name in ("article", "main"))
        self.why.append(_left_out(name, attrs, self.main[up]))
        self.ended.append(False)
        self.own.append(0)
        self.opened.append(k)
        self.count[name] = self.count.get(name, 0) + 1
        if name in _LISTED:
            self.listed.append(k)

    def close(self, name: str) -> None:
        """Ends the innermost open element of this name and all inside it."""
        if not self.count.get(name):
            return
        while True:
            k = self.opened.pop()
            last = self.names[k]
            self.count[last] -= 1
            if self.listed and self.listed[-1] == k:
                self.listed.pop()
            if last == name:
                self.ended[k] = True
                return

    def before(self, name: str) -> None:
        """Ends what the start tag of a block ends by itself."""
        self.close("p")
        if name in _HEADINGS and self.names[self.opened[-1]] in _HEADINGS:
            self.close(self.names[self.opened[-1]])
        for last in _ENDS.get(name, ()):
            if self.listed and self.names[self.listed[-1]] == last:
                self.close(last)

    def add(self, text: str, linked: bool) -> None:
        if text:
            self.blocks[-1].append((self.opened[-1], text, linked))
            if not linked:
                self.own[self.opened[-1]] += len(text)

    def cut(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def pieces(self) -> list[_Piece]:
        names, parents, why = self.names, self.parents, self.why
        n = len(names)
        total = self.own.copy()
        for k in range(n - 1, 0, -1):
            total[parents[k]] += total[k] if why[k] != _NATURE or not self.ended[k] else 0
        remark = [False] * n
        for k in range(1, n):
            remark[k] = why[k] == _COMMENTS or remark[parents[k]]
        held = [False] * n
        for name in ("main", "article"):
            some = [k for k in range(n) if names[k] == name and not why[k]]
            k = max([k for k in some if not remark[k]] or some, key=lambda k: (total[k], -k), default=0)
            while k and not held[k]:
                held[k] = True
                k = parents[k]
        out = [False] * n
        for k in range(1, n):
            w = why[k]
            if w and (held[k] and (w != _NATURE or not self.ended[k]) or w in (_COMPOUND, _FORM) and 2 * total[k] > total[0]):
                w = 0
            out[k] = bool(w) or out[parents[k]]
        found = []
        for block in self.blocks:
            text = " ".join("".join([" " if out[k] else t for k, t, _ in block]).split())
            if text:
                found.append(_Piece(text, sum(len(t.strip()) for k, t, linked in block if linked and not out[k]), any(self.main[k] for k, _, _ in block if not out[k])))
        return found


def page_blocks(page: str) -> list[_Piece]:
    """The page's blocks outside of everything that is never main text."""
    made = _Page()
    at, size, last_end = 0, len(page), page.rfind(">")
    tag, linked = _TAG, False
    while at < size:
        stop = page.find("<", at)
        if stop < 0:
            stop = size
        if stop > at:
            made.add(html.unescape(page[at:stop]), linked)
            at = stop
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = size if stop < 0 else stop + 3
            continue
        if page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at)
            made.add(page[at + 9 : size if stop < 0 else stop], linked)
            at = size if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), at) and at < last_end:
            at = page.find(">", at) + 1
            continue
        m = None
        if at < last_end:
            m = tag.match(page, at)
            if m is None and tag is _TAG and _BROKEN_TAG.match(page, at):
                # a quote that never ends: from here on a tag ends at the first bracket
                tag = _BROKEN_TAG
                m = tag.match(page, at)
        if m is None:
            made.add("<", linked)
            at += 1
            continue
        at = m.end()
        name, ending, attrs = m[2].lower(), m[1], m[3]
        if not ending and name in _RAW and not attrs.endswith("/"):
            stop = _RAW[name].search(page, at)
            at = stop.end() if stop else size
            continue
        if name in _BLOCK:
            made.cut()
            linked = False
            if not ending:
                made.before(name)
        elif name == "br":
            made.add(" ", False)
        elif name == "a":
            linked = not ending
        if name in _OPENED:
            if ending:
                made.close(name)
            elif not attrs.endswith("/"):
                made.open(name, attrs)
    return made.pieces()


def _first_pass(b: _Piece) -> bool | None:
    """True for text, False for other matter, None for an undecided short block."""
    size = len(b.text)
    if b.linked > LINK_MAX * size:
        return False
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if size < LENGTH_LOW:
        return None
    if b.main:
        return True
    if stops >= STOP_HIGH:
        return True if size > LENGTH_HIGH or b.linked == 0 else None
    return None if stops >= STOP_LOW else False


def label_blocks(found: list[_Piece]) -> list[bool]:
    """Both passes; a tie between neighbours at the same distance goes to the earlier one."""
    first = [_first_pass(b) for b in found]
    n = len(found)
    near: list[tuple[int, bool] | None] = [None] * n
    for order in (range(n), range(n - 1, -1, -1)):
        last: dict[bool, int] = {}
        for i in order:
            side = found[i].main
            if first[i] is not None:
                last[side] = i
            elif side in last and (near[i] is None or abs(i - last[side]) < near[i][0]):
                near[i] = (abs(i - last[side]), first[last[side]])
    return [bool(f) if f is not None else (near[i][1] if near[i] else found[i].main) for i, f in enumerate(first)]


def main_text(page: str | None) -> str:
    """The main text's blocks, one a line; empty for null, empty or text-free pages."""
    if not page:
        return ""
    found = page_blocks(page)
    return "\n".join(b.text for b, keep in zip(found, label_blocks(found)) if keep)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per input row: the columns in keep, text, n_chars (code points).

    Null or empty html gives empty text; repeated rows stay; other columns are
    ignored. A page is handled whole, in blocks of 1 MB of pages or one longer page.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                part = batch.slice(block.lo, len(block))
                texts = [main_text(x.as_py()) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*(f"k{i}" for i in range(len(keep))), "text", "n_chars"],
                )

    source = pages.select(F.col(f"`{html_col}`").cast("string").alias("html"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)))
    kinds = ", ".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    out = source.mapInArrow(extract, f"{kinds}, text string, n_chars long")
    return out.toDF(*keep, "text", "n_chars")
