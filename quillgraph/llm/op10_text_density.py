"""Main text of HTML pages by composite text density.

For every DOM node the characters per tag are computed and adjusted by the
share of linked characters and tags, menus and footers included.  The core is
the node whose children's densities sum highest; the least density on its path
to the body is the threshold.  Siblings on that path join the core if they
reach the threshold.  Two things bound this: an ``article`` or ``main`` around
the core keeps what is not mostly links inside it, and of what stands outside
only the headings before it.

Parts that are never main text (navigation, asides, footers, forms, scripts,
hidden parts, and parts whose role or whole class or id says so) can't be the
core or join it.  A class or id cuts nothing that holds the main article or
most of the text, and a form that holds most of the text is no form to fill in.

The text of the chosen nodes is returned whole: character references decoded,
white space inside a block turned into one space and trimmed, blocks joined in
page order by two newlines.  Nulls and empty pages give the empty text.  Broken
markup (unclosed or stray tags, quotes and comments) never fails and is read in
time that grows in proportion to the page.  Repeated rows get repeated results,
an empty table gives an empty result, and other columns are neither read nor
returned.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import small_batches

SCHEMA = "page_id long, url string, text string, n_chars long"

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

# Fixed sets of HTML element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_CLOSES_P = _BLOCK - {"body", "head", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_CUT = frozenset("nav aside footer script style noscript template iframe title head svg canvas object embed button select textarea dialog menu audio video map option label input".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of class and id values that mark what is not main text.
_CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu "
    "sidebar sidenav rail footer foot masthead topbar toolbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup "
    "modal overlay comment comments discussion disqus respond replies share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login pagination pager widget widgets skip hidden".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that may stand beside those in a class or id that names such a part, as in related-posts.
_BESIDE_WORDS = frozenset(
    "site page main global primary secondary left right top bottom inner outer sticky mobile desktop container wrapper wrap box block area section "
    "panel bar list item items link links post posts article articles stories reading body text header title icon icons button buttons form toggle "
    "row col column group unit slot social media user reader blog tag tags wp md td js c l o m u g".split()
)
#: Words that tell of a paragraph or heading, too.
_AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsored promo cookie cookies consent gdpr".split())
#: Words of parts that stay cut even if they hold most of the text.
_REPLY_WORDS = frozenset("comment comments discussion disqus respond replies".split())
#: First words of class names that only tell about a part elsewhere, as in has-sidebar.
_TELLING = frozenset("has with no without is not".split())
#: A header of one of these belongs to the text.
_TEXT_WORDS = frozenset("article post entry content story main body".split())


class _Node:
    __slots__ = ("name", "parent", "children", "cut", "first", "last", "chars", "link_chars", "tags", "link_tags", "own", "density", "total", "label")

    def __init__(self, name: str, parent: _Node | None, cut: bool, first: int):
        self.name, self.parent, self.cut, self.first, self.last = name, parent, cut, first, first
        self.children: list[_Node] = []
        self.chars = self.link_chars = self.tags = self.link_tags = self.own = 0
        self.density = self.total = 0.0
        self.label = 0


def _marked(name: str, attrs: str, inside_article: bool) -> bool:
    """Whether an element is cut with everything in it, going by its name and attributes but not by class and id."""
    if name in _CUT or name == "header" and not inside_article:
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), _html.unescape(a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in _CUT_ROLES:
            return True
    return False


def _label(name: str, attrs: str, inside_article: bool) -> int:
    """1 if a class or id names a part that is not main text, 2 if one for replies, else 0.

    The whole label must name it, not a word of it, as ids made from titles
    have any words; headings and paragraphs are judged by no id, and by classes
    that speak of adverts and consent only.
    """
    if not attrs or name in ("html", "body"):
        return 0
    found = 0
    for key, a, b, c in _ATTR.findall(attrs):
        key = key.lower()
        if key not in ("class", "id") or key == "id" and (name in _HEADINGS or name == "p"):
            continue
        for label in _html.unescape(a or b or c).lower().split():
            words = {w for w in re.split(r"[^a-z]+", label) if w}
            first = re.match(r"[^a-z]*([a-z]*)", label)[1]
            if first in _TELLING or key == "id" and label == "discussion":
                continue
            telling = words & (_AD_WORDS if name in _HEADINGS or name == "p" else _CUT_WORDS)
            if "header" in words and name not in _HEADINGS and not inside_article and _TEXT_WORDS.isdisjoint(words):
                telling = telling | {"header"}
            if telling and words - telling <= _BESIDE_WORDS:
                found = max(found, 1 if _REPLY_WORDS.isdisjoint(words) else 2)
    return found


def _settle_cuts(root: _Node, texts: list[tuple[int, _Node, str]]) -> list[_Node]:
    """Fill in characters and cuts; nodes in page order.

    What a class or id names is cut unless it holds the main article or most of the text, a form unless it holds most of it.
    """
    for _, node, text in texts:
        node.own += len(_SPACE.sub("", text))
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(order):
        node.chars = node.own + sum(c.chars for c in node.children)
    holders = [max((n for n in order if n.name == kind and not n.label and n.chars), key=lambda n: n.chars, default=None) for kind in ("main", "article")]
    if holders[0] is not None and holders[1] is not None and 2 * holders[1].chars < holders[0].chars:
        holders[1] = None
    held = set()
    for node in holders:
        while node is not None and id(node) not in held:
            held.add(id(node))
            node = node.parent
    for node in order:
        most = 2 * node.chars > root.chars
        named = node.label and node.name not in ("article", "main") and id(node) not in held and not (most and not held and node.label == 1)
        form = node.name == "form" and not most
        node.cut = node.cut or bool(named) or form or node.parent is not None and node.parent.cut
    return order


class _Tags:
    """Where tags end.  Reads each part of a page once, whatever quotes it holds."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """The first ">" that is not in quotes, else the first one, else -1.  A quote that is never closed is none."""
        first = self.page.find(">", at)
        while first >= 0 and self.quotes:
            m = _STOP.search(self.page, at)
            if m is None:  # all that follow are in quotes: from here on quotes do not count
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                close = self.page.find(m[0], m.end())
                at = (close if close >= 0 else m.start()) + 1
        return first


def _parse(page: str) -> tuple[_Node, list[tuple[int, _Node, str]]]:
    """The tree and its pieces of text: (block number, node, text)."""
    root = _Node("#root", None, False, 0)
    stack, texts, block, at = [root], [], 0, 0
    is_open: Counter[str] = Counter()
    tags = _Tags(page)

    def close(to: int) -> None:
        nonlocal block
        while len(stack) > to:
            node = stack.pop()
            is_open[node.name] -= 1
            node.last = block
            if node.name in _BLOCK:
                block += 1

    def say(text: str) -> None:
        if text:
            texts.append((block, stack[-1], text))

    size = len(page)
    while at < size:
        m = _OPEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        if m[1]:
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else size
            continue
        end = page.find(">", m.end()) if m[2] else tags.end(m.end())
        if end < 0:
            say(page[m.start() :])
            break
        at = end + 1
        if m[2]:
            continue
        name, attrs = m[4].lower(), page[m.end() : end]
        if m[3]:
            if name == "br":
                say(" ")
                continue
            for k in range(len(stack) - 1, 0, -1) if is_open[name] else ():
                if stack[k].name == name:
                    close(k)
                    break
                # An inline end tag does not close the block it stands in.
                if name not in _BLOCK and stack[k].name in _BLOCK:
                    break
            continue
        if name in _CLOSES_P and is_open["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close(k)
                    break
                if stack[k].name in _BLOCK:
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(name, (name,))
            stop = ("ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot", "select") + (("tr",) if name in ("td", "th") else ())
            for k in range(len(stack) - 1, 0, -1) if any(is_open[x] for x in same) else ():
                if stack[k].name in same:
                    close(k)
                    break
                if stack[k].name in stop:
                    break
        if name in ("html", "body") and is_open[name]:
            continue
        if name == "body" and is_open["head"]:
            for k in range(1, len(stack)):
                if stack[k].name == "head":
                    close(k)
                    break
        if name in _BLOCK:
            block += 1
        top = stack[-1]
        in_article = is_open["article"] + is_open["main"] > 0
        node = _Node(name, top, top.cut or _marked(name, attrs, in_article) or name in _RAW, block)
        top.children.append(node)
        if attrs and not node.cut:
            node.label = _label(name, attrs, in_article)
        if name in ("br", "wbr", "hr"):
            if name == "br":
                say(" ")
            node.last = block
            continue
        if name in _VOID or attrs.endswith("/") and name not in _BLOCK and name not in _RAW and name != "a":
            node.last = block
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(page, at)
            at = end.end() if end else size
            node.last = block
            continue
        stack.append(node)
        is_open[name] += 1
    close(0 + 1)
    root.last = block
    return root, texts


def _measure(order: list[_Node]) -> _Node:
    """Fill in tags, links and densities; the body.  ``order``: the nodes in page order."""
    for node in reversed(order):
        live = [c for c in node.children if c.name not in _RAW]
        node.tags = sum(c.tags + 1 for c in live)
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
        else:
            node.link_chars = sum(c.link_chars for c in live)
            node.link_tags = sum(c.link_tags + (c.name == "a") for c in live)
    body = next((n for n in order if n.name == "body"), order[0])
    ratio = body.link_chars / max(1, body.chars)
    for node in order:
        c, lc, t, lt = node.chars, node.link_chars, max(1, node.tags), max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            node.density = max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + 1) / math.log(base + 1))
    for node in order:
        node.total = node.own + sum(c.density for c in node.children if not c.cut)
    return body


def _core(order: list[_Node], body: _Node) -> tuple[list[_Node], float]:
    """The path from the block with the highest sum of densities to the body, and the least density on it."""
    core = max((n for n in order if n.chars and not n.cut and (n.name in _BLOCK or n is order[0]) and n.name != "html"), key=lambda n: n.total, default=None)
    path: list[_Node] = []
    node = core
    while node is not None and node is not body.parent:
        path.append(node)
        node = node.parent
    return path, min((n.density for n in path), default=0.0)


def _chosen(order: list[_Node], body: _Node) -> list[_Node]:
    """The nodes whose text is the main text."""
    path, threshold = _core(order, body)
    if not path:
        return []
    around = [k for k, n in enumerate(path) if n.name in ("article", "main")]
    at = top = len(path)
    if around:
        at, top = max(k for k in around if path[k].name == path[around[0]].name), max(around)
        # Headings before an article in the same main part are its own.
        if sum(n.name == "article" and not n.cut and n.chars > 0 for n in _subtree(path[top])) > 1:
            top = at
    found = [path[0]]
    for k, node in enumerate(path[:-1]):
        ahead = {id(x) for x in _before(node)}
        for other in path[k + 1].children:
            if other is node or other.cut or not other.chars:
                continue
            linked = other.link_chars * 2 > other.chars
            heading = id(other) in ahead and other.name in _HEADINGS
            if k < at < len(path) and (not linked or other.density >= threshold):
                found.append(other)
            elif k >= at and k < top and heading:
                found.append(other)
            elif at == len(path) and (heading or other.density >= threshold and not linked):
                found.append(other)
        if path[k + 1].own and k < at:
            found.append(path[k + 1])
    return found


def _subtree(node: _Node) -> Iterator[_Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(n.children)


def _before(node: _Node) -> list[_Node]:
    """The elder siblings of a node that are not cut."""
    out = []
    for x in node.parent.children:
        if x is node:
            return out
        if not x.cut:
            out.append(x)
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root, texts = _parse(page)
    order = _settle_cuts(root, texts)
    body = _measure(order)
    chosen = _chosen(order, body)
    # A node on the path stands for its own text, any other one for all in it.
    path = {id(n) for n in _core(order, body)[0][1:]}
    inside: set[int] = set()
    for node in chosen:
        inside.update([id(node)] if id(node) in path else (id(n) for n in _subtree(node)))
    blocks: dict[int, list[str]] = {}
    for block, node, text in texts:
        if id(node) in inside and not node.cut:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", _html.unescape("".join(parts))).strip() for _, parts in sorted(blocks.items()))
    return "\n\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
