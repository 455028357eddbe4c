"""HTML main text by wrapper inference (union-free regular expressions over same-host pages).

A page becomes a row of text blocks, each named by the path of the elements around it. The pages of a host are aligned one
after another: equal texts at equal paths anchor the alignment; between anchors, blocks at equal paths whose texts differ
resolve into text slots; what one side lacks becomes optional, and neighbours at the path of a slot fold into it as a
repeated slot. This gives the host's wrapper. What stays the same text in at least half of a host's distinct pages is
template text, unless it is most of a page; the rest is content, unless the nearest telling element around it is boilerplate
by its tag or class.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .url_templates import url_host

_QUOTED = re.compile(r"</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"))
_SKIPPED = frozenset(("head", "nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "textarea", "option", "menu", "dialog", "object", "audio", "video", "canvas", "title", "math", "map", "fieldset", "xmp"))
_SKIPPED_MARKS = frozenset(("nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "comment", "comments", "replies", "reply", "respond", "disqus", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "toolbar", "login", "search", "form", "copyright", "hidden"))
_MAIN = frozenset(("article", "main"))
#: Words that tell boilerplate unless the name they stand in ends as that of a piece of content does.
_OF_CONTENT, _CONTENT = frozenset(("social", "notice", "alert", "form", "search", "banner", "hidden", "header", "login")), frozenset(("post", "article", "story", "entry"))
#: Elements that an open paragraph or list item ends at.
_CLOSES_P = frozenset(("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCES = frozenset(("ul", "ol", "dl", "table", "article", "main", "body", "div", "section", "nav"))
#: A class name that begins so tells what is not there.
_ABSENT = frozenset(("no", "without", "has", "with", "hide", "not"))
#: Pages of a host are aligned in three rounds, so many groups share a host with many pages.
ROUNDS = (1024, 32, 1)
#: Longer paths are named by their hash.
PATH_CHARS = 1000


class Markup:
    """Finds the pieces of markup of a page, in linear time: once a tag's quote is not closed, tags end at their first ``>``."""

    def __init__(self, page: str):
        self.page, self.quoted = page, True

    def next(self, at: int) -> tuple[int, int] | None:
        """Where the next piece at or behind a place begins and ends."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            after, end = page[at + 1 : at + 3].lstrip("/")[:1], None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = end + 3 if end >= 0 else len(page)  # what is not closed takes the rest
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                end = end + 3 if end >= 0 else len(page)
            elif page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at) + 1 or len(page)
            elif after.isascii() and after.isalpha():
                found = _QUOTED.match(page, at) if self.quoted else None
                self.quoted = found is not None
                end = found.end() if found else page.find(">", at) + 1 or len(page)
            if end is not None:
                return at, end
            at += 1
        return None


def told_by_class(token: str) -> list[str]:
    """The boilerplate words in the class, id, role or itemprop of a tag."""
    out = set()
    for value in _MARK.findall(token):
        for name in "".join(value).lower().split():
            words = re.split(r"[^a-z0-9]+", name)
            if words[0] not in _ABSENT:
                out.update(w for w in words if w in _SKIPPED_MARKS and not (w in _OF_CONTENT and words[-1] in _CONTENT))
    return sorted(out)


def blocks(page: str | None) -> list[tuple[str, str]]:
    """``(path, text)`` of each text block in page order; character references decoded, white space folded.

    A path begins with what the nearest telling element makes of it: ``m`` in a main element, ``s`` in boilerplate, ``n`` neither.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    open_: Counter = Counter()
    text: list[str] = []
    path = "n"

    def flush() -> None:
        if text:
            whole = " ".join(html_lib.unescape("".join(text)).split())
            if whole:
                out.append((path, whole))
            text.clear()

    def leave(depth: int) -> None:
        nonlocal path
        flush()
        open_.subtract(t for t, _ in stack[depth:])
        del stack[depth:]
        path = stack[-1][1] if stack else "n"

    page, at = page or "", 0
    markup = Markup(page)
    while found := markup.next(at):
        if found[0] > at:
            text.append(page[at : found[0]])
        token, at = page[found[0] : found[1]], found[1]
        name = _NAME.match(token)
        if name:
            tag = name[1].lower()
            if token[1] == "/":
                if tag not in _INLINE:
                    if open_[tag] > 0:
                        leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                    else:
                        flush()
            elif tag in _RAW and not token.endswith("/>"):
                flush()
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag in ("br", "hr"):
                flush()
            elif tag not in _VOID and tag not in _INLINE:
                if tag in _CLOSES_P and open_["p"] > 0:
                    leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"))
                elif tag in _SAME and any(open_[t] > 0 for t in _SAME[tag]):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in _SAME[tag]:
                            leave(k)
                            break
                        if stack[k][0] in _FENCES:
                            break
                flush()
                if not token.endswith("/>"):
                    marks = [] if tag in ("html", "body") or tag in _MAIN else told_by_class(token)
                    own_header = tag == "header" and path[0] == "m"  # an article's header holds its title
                    state = "m" if tag in _MAIN else "s" if tag in _SKIPPED and not own_header or marks else path[0]
                    path = f"{state}{path[1:]}/{'.'.join([tag, *marks])}"
                    if len(path) > PATH_CHARS:
                        path = f"{state}#{xxhash.xxh64_hexdigest(path)}"
                    stack.append((tag, path))
                    open_[tag] += 1
        elif token.startswith("<![CDATA["):
            text.append(html_lib.escape(token[9:].removesuffix("]]>")))
    text.append(page[at:])
    flush()
    return out


def boilerplate(path: str) -> bool:
    return path[0] == "s"


def in_main(path: str) -> bool:
    return path[0] == "m"


#: Items of a wrapper: [path, text hash or None for a slot, optional, repeated, pages that have this text].
Item = list


def said(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def shared(item: Item, pages: int) -> bool:
    """Whether a text stands in a twentieth of the pages, as each does in the first twenty."""
    return item[1] is not None and 20 * item[4] >= pages


def folded(items: list[Item], pages: int) -> list[Item]:
    """Neighbours at the path of a slot fold into it, but for shared texts."""
    out: list[Item] = []
    for item in items:
        last = out[-1] if out else None
        if last is not None and last[0] == item[0] and (last[1] is None or item[1] is None) and not shared(last, pages) and not shared(item, pages):
            out[-1] = [item[0], None, last[2] and item[2], True, 0]
        else:
            out.append(item)
    return out


def structure(page: list[tuple[str, str]]) -> str:
    """The wrapper of one page: all its blocks that are no boilerplate, with their texts."""
    return json.dumps([1, [[path, said(text), False, False, 1] for path, text in page if not boilerplate(path)]])


def align(a: str, b: str) -> str:
    """The wrapper of two wrappers."""
    (m, left), (n, right) = json.loads(a), json.loads(b)
    out: list[Item] = []

    def slots(xs: list[Item], ys: list[Item]) -> None:
        """Between anchors: equal paths become slots, the others optional; a text that two pages share gives way to no other."""
        paths = [[(x[0],) if x[1] is None or x[4] < 2 or not shared(x, size) else (x[0], x[1], side) for x in own] for side, (own, size) in enumerate(((xs, m), (ys, n)))]
        for kind, i, j, k, l in SequenceMatcher(None, *paths, autojunk=False).get_opcodes():
            if kind == "equal":
                out.extend([x[0], None, x[2] or y[2], x[3] or y[3], 0] for x, y in zip(xs[i:j], ys[k:l], strict=True))
            else:
                out.extend([x[0], x[1], True, x[3], x[4]] for x in xs[i:j] + ys[k:l])

    keys = [[(x[0], x[1]) for x in side] for side in (left, right)]
    for kind, i, j, k, l in SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [[x[0], x[1], x[2] or y[2], x[3] or y[3], x[4] + y[4]] for x, y in zip(left[i:j], right[k:l], strict=True)]
        else:
            slots(left[i:j], right[k:l])
    return json.dumps([m + n, folded(out, m + n)])


def _fold(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    whole, *rest = sorted(table.column("wrapper").to_pylist())
    for other in rest:
        whole = align(whole, other)
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([whole], pa.string())})


def _parsed(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)`` of each page by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [structure(blocks(page)) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string())], names=["host", "wrapper"])

    return pages.select("host", "html").mapInArrow(run, "host string, wrapper string")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)``: JSON of the number of distinct pages and the items ``[path, text hash, optional, repeated, pages]``."""
    wrappers = _parsed(pages).distinct()  # a page that stands again is no other page
    for groups in ROUNDS:
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(groups)).alias("salt")
        wrappers = wrappers.select("host", "wrapper", salt).groupBy("host", "salt").applyInArrow(_fold, "host string, wrapper string")
    return wrappers


def template_texts(wrapper: str) -> frozenset[tuple[str, int]]:
    """(path, text hash) of the template text: the same in three distinct pages and half of the host's, where other text varies."""
    pages, items = json.loads(wrapper)
    if all(item[1] is not None for item in items):
        return frozenset()
    return frozenset((path, text) for path, text, _, _, n in items if text is not None and n >= 3 and 2 * n >= pages)


def main_text(page: str | None, template: frozenset[tuple[str, int]]) -> str:
    """The content blocks joined by a space.

    Main elements are the content where they hold at least half of the characters that are no boilerplate; else they are
    teasers beside it and all blocks stay. Template text goes where it is the smaller part of the page: pages that are mostly the same
    text are copies of each other, and what copies share is their content.
    """
    own = [(path, text) for path, text in blocks(page) if not boilerplate(path)]
    inside = [(path, text) for path, text in own if in_main(path)]
    size = lambda rows: sum(len(text) for _, text in rows)
    if 2 * size(inside) >= size(own):
        own = inside or own
    kept = [(path, text) for path, text in own if (path, said(text)) not in template]
    if 2 * size(kept) >= size(own):
        own = kept
    return " ".join(text for _, text in own)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of pages; n_chars counts code points.

    NULL and empty html give an empty text; pages without a host share the wrapper of the empty host; repeated rows stay and
    count as one page of the wrapper; very long pages are parsed whole, in time that grows with their length; what is not
    closed takes the rest of the page; of equal alignments the first is taken, and pages are aligned in the order of their
    structures; an empty table gives no rows; other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), url_host(url).alias("host"))
    wrappers = cut(infer_wrappers(rows))
    size = wrappers.agg(F.sum(F.length("wrapper")).alias("n")).first()["n"] or 0
    side = F.broadcast(wrappers) if size <= 8_000_000 else wrappers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = template_texts(wrapper)
                texts.append(main_text(page, known[wrapper]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(side, "host").select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
