"""A CommonMark reader that reports structure instead of HTML.

One pass over a document gives its headings, internal links, link destinations,
reference definitions, labels in use, block ids and classified ranges.  Beyond
CommonMark it knows wikilinks, a YAML block at the start, tables, strikethrough
and heading attributes.  All offsets that leave this module are UTF-8 byte
offsets into the source.
"""

from __future__ import annotations

import bisect
import html
import re
from dataclasses import dataclass, field

from . import paths

_ESCAPABLE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)")
_ATX_END = re.compile(r"(?:(?<=[ \t])|^)#+[ \t]*$")
_ATTRIBUTES = re.compile(r"[ \t]*\{[^{}<>\\\n]*\}[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_QUOTE = re.compile(r" {0,3}>[ ]?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
_TABLE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML_STARTS = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
)
# Fixed list: element names that open an HTML block.
_HTML_NAMES = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|"
    "footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|"
    "param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_HTML_NAMED = re.compile(rf" {{0,3}}</?(?:{_HTML_NAMES})(?:\s|/?>|$)", re.I)
_TAG = r"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*)>"
_HTML_ALONE = re.compile(rf" {{0,3}}{_TAG}[ \t]*$")
_INLINE_HTML = re.compile(rf"{_TAG}|<!--(?:>|->|.*?-->)|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*)>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_WIKILINK = re.compile(r"\[\[((?:[^\[\]|\n\\]|\\.)*)(\|[^\[\]\n]*)?\]\]")
_SPECIAL = re.compile(r"[\\`<&*_~\[\]!\n]")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){1,999})\]", re.S)
_BLOCK_ID = re.compile(r"[A-Za-z0-9-]+")

FACETS = ("headings", "links", "destinations", "definitions", "uses", "ranges", "block_ids")


@dataclass
class Link:
    """An occurrence of an internal link."""

    style: str
    target_kind: str
    target: str
    frag_kind: str | None
    frag: str | None
    display: str
    start: int
    end: int
    dest_start: int | None
    dest_end: int | None
    ref_label: str | None
    embed: bool


@dataclass
class Parsed:
    headings: list[dict] = field(default_factory=list)
    links: list[Link] = field(default_factory=list)
    destinations: list[tuple[str, int, int]] = field(default_factory=list)
    definitions: list[dict] = field(default_factory=list)
    uses: list[str] = field(default_factory=list)
    ranges: list[tuple[str, int, int]] = field(default_factory=list)
    block_ids: list[str] = field(default_factory=list)


def normal_label(label: str) -> str:
    """The form in which reference labels are compared."""
    return " ".join(label.split()).casefold()


def unescape(text: str) -> str:
    """Backslash escapes and character references resolved."""
    if "\\" not in text and "&" not in text:
        return text
    out, at = [], 0
    for m in re.finditer(r"\\(.)|(&[^\s;&]+;)", text, re.S):
        if m[1] and m[1] in _ESCAPABLE:
            out += [text[at : m.start()], m[1]]
        elif m[2] and _ENTITY.fullmatch(m[2]):
            out += [text[at : m.start()], html.unescape(m[2])]
        else:
            continue
        at = m.end()
    return "".join(out) + text[at:]


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def anchor(text: str) -> str:
    """The anchor of a heading text, before repeats are told apart."""
    kept = "".join("-" if c.isspace() else c for c in ascii_lower(text) if c.isspace() or c.isalnum() or c in "-_")
    return kept.strip("-")


def anchors(texts: list[str]) -> list[str]:
    """Anchors in document order; a repeat gets the first free number."""
    taken: set[str] = set()
    out = []
    for base in map(anchor, texts):
        name, k = base, 0
        while name in taken:
            k += 1
            name = f"{base}-{k}"
        taken.add(name)
        out.append(name)
    return out


def block_ids(source: str) -> list[str]:
    """Ids given by lines ``^id`` or by line ends `` ^id``; code is not spared."""
    out = []
    for line in source.split("\n"):
        line = line.strip()
        if "^" not in line:
            continue
        for candidate in ([line[1:]] if line[0] == "^" else []) + ([line.rpartition(" ^")[2]] if " ^" in line else []):
            if _BLOCK_ID.fullmatch(candidate):
                out.append(candidate)
    return out


class _Reader:
    """Reads blocks first, since definitions may follow their uses, then inlines."""

    def __init__(self, source: str):
        self.source = source
        self.leaves: list[tuple[str, int, int, int, list[tuple[int, str]]]] = []  # kind, level, start, end, lines
        self.raw: list[tuple[str, int, int]] = []  # ranges that hold no inlines
        self.definitions: list[tuple[str, str, int, int, tuple[int, int] | None]] = []
        self.known: dict[str, str] = {}

    # Blocks

    def run(self) -> None:
        lines, at = [], 0
        for text in self.source.split("\n"):
            lines.append((at, text.removesuffix("\r")))
            at += len(text) + 1
        first = self.metadata(lines)
        self.blocks(lines[first:], 0)

    def metadata(self, lines: list[tuple[int, str]]) -> int:
        if lines[0][1].rstrip(" \t") != "---" or len(lines) < 2 or not lines[1][1].strip():
            return 0
        for k in range(1, len(lines)):
            if lines[k][1].rstrip(" \t") in ("---", "..."):
                end = min(len(self.source), lines[k][0] + len(lines[k][1]) + 1)
                self.raw.append(("frontmatter", 0, end))
                self.raw += [("frontmatter", at, at + len(text) + 1) for at, text in lines[1:k]]
                return k + 1
        return 0

    def blocks(self, lines: list[tuple[int, str]], depth: int) -> None:
        para: list[tuple[int, str]] = []
        i, n = 0, len(lines)
        while i < n:
            at, text = lines[i]
            bare = text.lstrip(" \t")
            if not bare:
                self.paragraph(para)
                i += 1
                continue
            indent = _columns(text, len(text) - len(bare))
            if indent >= 4:
                if para:
                    para.append((at + len(text) - len(bare), bare))
                    i += 1
                else:
                    i = self.indented(lines, i)
                continue
            c = bare[0]
            if c in "`~" and (m := _FENCE.match(text)):
                self.paragraph(para)
                i = self.fenced(lines, i, m)
            elif c == ">" and depth < 60:
                self.paragraph(para)
                i = self.quote(lines, i, depth)
            elif c == "#" and (m := _ATX.match(text)):
                self.paragraph(para)
                self.atx(at, text, m)
                i += 1
            elif para and c in "=-" and (m := _SETEXT.match(text)):
                self.setext(para, m[1][0], at + len(text))
                i += 1
            elif c in "*-_" and _BREAK.match(text):
                self.paragraph(para)
                i += 1
            elif (c in "-+*" or c.isdigit()) and depth < 60 and (m := _ITEM.match(text)) and not (para and (not text[m.end() :].strip() or m[2][:-1] not in ("", "1"))):
                self.paragraph(para)
                i = self.item(lines, i, m, depth)
            elif c == "<" and (end := self.html_end(text, bool(para))):
                self.paragraph(para)
                i = self.html(lines, i, end)
            elif "|" in text and i + 1 < n and _TABLE.match(lines[i + 1][1]) and len(_cells(text)) == len(_cells(lines[i + 1][1])):
                self.paragraph(para)
                i = self.table(lines, i)
            else:
                para.append((at + len(text) - len(bare), bare))
                i += 1
        self.paragraph(para)

    def starts_block(self, text: str) -> bool:
        """Whether a line would end a paragraph."""
        return bool(_FENCE.match(text) or _QUOTE.match(text) or _ATX.match(text) or _BREAK.match(text) or self.html_end(text, True) or ((m := _ITEM.match(text)) and text[m.end() :].strip() and m[2][:-1] in ("", "1")))

    def indented(self, lines: list[tuple[int, str]], i: int) -> int:
        last = i
        k = i
        while k < len(lines):
            text = lines[k][1]
            bare = text.lstrip(" \t")
            if bare and _columns(text, len(text) - len(bare)) < 4:
                break
            if bare:
                last = k
            k += 1
        for at, text in lines[i : last + 1]:
            skip = 1 if text[:1] == "\t" else min(4, len(text) - len(text.lstrip(" ")))
            self.raw.append(("code_block", at + skip, min(len(self.source), at + len(text) + 1)))
        return last + 1

    def fenced(self, lines: list[tuple[int, str]], i: int, m: re.Match) -> int:
        end = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
        for k in range(i + 1, len(lines)):
            if end.match(lines[k][1]):
                return k + 1
            at, text = lines[k]
            self.raw.append(("code_block", at, min(len(self.source), at + len(text) + 1)))
        return len(lines)

    def quote(self, lines: list[tuple[int, str]], i: int, depth: int) -> int:
        inner, k = [], i
        while k < len(lines):
            at, text = lines[k]
            m = _QUOTE.match(text)
            if m:
                inner.append((at + m.end(), text[m.end() :]))
            elif text.strip() and inner[-1][1].strip() and not self.starts_block(text) and not self.starts_block(inner[-1][1]):
                inner.append((at, text))  # a paragraph goes on without the mark
            else:
                break
            k += 1
        self.blocks(inner, depth + 1)
        return k

    def item(self, lines: list[tuple[int, str]], i: int, m: re.Match, depth: int) -> int:
        at, text = lines[i]
        rest = text[m.end() :]
        gap = len(rest) - len(rest.lstrip(" \t"))
        pad = gap if 1 <= gap <= 4 and rest.strip() else 1
        width = m.end() + pad
        inner = [(at + min(width, len(text)), text[width:])]
        k = i + 1
        while k < len(lines):
            at, text = lines[k]
            bare = text.lstrip(" \t")
            if not bare:
                if len(inner) == 1 and not inner[0][1].strip():
                    break
                inner.append((at + len(text), ""))
            elif _columns(text, len(text) - len(bare)) >= width:
                skip = _skip(text, width)
                inner.append((at + skip, text[skip:]))
            elif inner[-1][1].strip() and not self.starts_block(text) and not self.starts_block(inner[-1][1]) and not _SETEXT.match(text):
                inner.append((at, text))
            else:
                break
            k += 1
        self.blocks(inner, depth + 1)
        return k

    def html_end(self, text: str, in_paragraph: bool):
        """How the HTML block that ``text`` opens ends; None if it opens none."""
        for start, end in _HTML_STARTS:
            if start.match(text):
                return end
        return "blank" if _HTML_NAMED.match(text) or not in_paragraph and _HTML_ALONE.match(text) else None

    def html(self, lines: list[tuple[int, str]], i: int, end) -> int:
        for k in range(i, len(lines)):
            if end == "blank" and not lines[k][1].strip():
                return k
            if end != "blank" and end.search(lines[k][1]):
                return k + 1
        return len(lines)

    def table(self, lines: list[tuple[int, str]], i: int) -> int:
        k = i
        while k < len(lines) and lines[k][1].strip() and (k <= i + 1 or not self.starts_block(lines[k][1])):
            at, text = lines[k]
            if k != i + 1:
                for a, b in _cells(text):
                    self.leaf("paragraph", 0, at + a, at + b, [(at + a, text[a:b])])
            k += 1
        return k

    def atx(self, at: int, text: str, m: re.Match) -> None:
        body = text[m.end() :].rstrip(" \t")
        body = _ATX_END.sub("", body).rstrip(" \t")
        if (attributes := _ATTRIBUTES.search(body)) is not None:
            body = body[: attributes.start()]
        start = at + len(text) - len(text.lstrip(" "))
        self.leaf("heading", len(m[1]), start, min(len(self.source), at + len(text) + 1), [(at + m.end(), body)] if body else [])

    def setext(self, para: list[tuple[int, str]], mark: str, end: int) -> None:
        self.take_definitions(para)
        if para:
            at, text = para[-1]
            if (attributes := _ATTRIBUTES.search(text)) is not None and attributes.start():
                para[-1] = (at, text[: attributes.start()])
            self.leaf("heading", 1 if mark == "=" else 2, para[0][0], min(len(self.source), end + 1), [*para])
        para.clear()

    def paragraph(self, para: list[tuple[int, str]]) -> None:
        if para:
            self.take_definitions(para)
        if para:
            self.leaf("paragraph", 0, para[0][0], para[-1][0] + len(para[-1][1]), [*para])
        para.clear()

    def leaf(self, *what) -> None:
        self.leaves.append(what)

    def take_definitions(self, para: list[tuple[int, str]]) -> None:
        """Remove reference definitions from the start of a paragraph."""
        while para and para[0][1].startswith("["):
            joined = _Joined(para)
            found = _definition(joined.text)
            if found is None:
                return
            label, (a, b), end = found
            dest = unescape(joined.text[a:b])
            start, stop = joined.at(0), joined.at(end - 1) + 1
            self.definitions.append((label, dest, start, stop, (joined.at(a), joined.at(b - 1) + 1) if b > a else None))
            self.known.setdefault(normal_label(label), dest)
            done = joined.text[:end].count("\n") + 1
            del para[:done]


class _Joined:
    """Lines of a leaf as one string, with the way back to the source."""

    def __init__(self, lines: list[tuple[int, str]]):
        self.starts, self.where, parts, at = [], [], [], 0
        for off, text in lines:
            text = text.rstrip(" \t") if len(lines) > 1 else text
            self.starts.append(at)
            self.where.append(off)
            parts.append(text)
            at += len(text) + 1
        self.text = "\n".join(parts).rstrip(" \t")

    def at(self, i: int) -> int:
        k = bisect.bisect_right(self.starts, i) - 1
        return self.where[k] + i - self.starts[k]

    def end(self, i: int) -> int:
        """The source offset right after the character before ``i``."""
        return self.at(i - 1) + 1 if i else self.at(0)


def _columns(text: str, n: int) -> int:
    col = 0
    for c in text[:n]:
        col += 4 - col % 4 if c == "\t" else 1
    return col


def _skip(text: str, width: int) -> int:
    """Characters that make up ``width`` columns of white space."""
    col = k = 0
    while k < len(text) and col < width and text[k] in " \t":
        col += 4 - col % 4 if text[k] == "\t" else 1
        k += 1
    return k


def _cells(text: str) -> list[tuple[int, int]]:
    """Trimmed cells of a table row."""
    a, b = len(text) - len(text.lstrip()), len(text.rstrip())
    if text[a:b].startswith("|"):
        a += 1
    if b > a and text[b - 1] == "|" and text[b - 2 : b - 1] != "\\":
        b -= 1
    out, begin, k = [], a, a
    while k <= b:
        if k == b or text[k] == "|":
            left, right = begin, k
            while left < right and text[left] in " \t":
                left += 1
            while right > left and text[right - 1] in " \t":
                right -= 1
            out.append((left, right))
            begin = k + 1
        elif text[k] == "\\":
            k += 1
        k += 1
    return out


def _destination(text: str, i: int) -> tuple[int, int, int] | None:
    """(start, end, next) of a link destination at ``i``."""
    if text[i : i + 1] == "<":
        m = re.compile(r"<((?:[^<>\\\n]|\\.)*)>").match(text, i)
        return (i + 1, m.end() - 1, m.end()) if m else None
    depth, k = 0, i
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text) and text[k + 1] in _ESCAPABLE:
            k += 1
        elif c <= " ":
            break
        elif c == "(":
            depth += 1
        elif c == ")":
            if not depth:
                break
            depth -= 1
        k += 1
    return (i, k, k) if not depth else None


_TITLE = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)", re.S)


def _spaces(text: str, i: int) -> int:
    while i < len(text) and text[i] in " \t\n":
        i += 1
    return i


def _definition(text: str) -> tuple[str, tuple[int, int], int] | None:
    """(label, destination range, end) of a definition at the start of ``text``."""
    m = _LABEL.match(text)
    if not m or not m[1].strip() or text[m.end() : m.end() + 1] != ":":
        return None
    at = _spaces(text, m.end() + 1)
    dest = _destination(text, at)
    if dest is None or dest[1] == dest[0] and text[at : at + 1] != "<":
        return None
    a, b, after = dest
    line_end = text.find("\n", after)
    line_end = len(text) if line_end < 0 else line_end
    title_at = _spaces(text, after)
    if title_at > after and (t := _TITLE.match(text, title_at)):
        stop = text.find("\n", t.end())
        stop = len(text) if stop < 0 else stop
        if not text[t.end() : stop].strip():
            return m[1], (a, b), t.end()
    if text[after:line_end].strip():
        return None
    return m[1], (a, b), after


@dataclass
class _Node:
    kind: str
    a: int
    b: int
    value: str = ""
    opens: bool = False
    closes: bool = False
    image: bool = False
    active: bool = True
    info: dict | None = None
    children: list[_Node] | None = None


class _Inlines:
    """The inline nodes of one leaf."""

    def __init__(self, text: str, known: dict[str, str]):
        self.text, self.known = text, known
        self.nodes: list[_Node] = []
        self.brackets: list[_Node] = []

    def read(self) -> list[_Node]:
        text, i, n = self.text, 0, len(self.text)
        begin = 0

        def flush(upto: int) -> None:
            if upto > begin:
                self.nodes.append(_Node("text", begin, upto, text[begin:upto]))

        while i < n:
            m = _SPECIAL.search(text, i)
            if m is None:
                break
            i = m.start()
            c = text[i]
            if c == "\n":
                flush(i)
                i = begin = i + 1
            elif c == "\\":
                if text[i + 1 : i + 2] and text[i + 1] in _ESCAPABLE:
                    flush(i)
                    begin = i + 1
                    i += 2
                elif text[i + 1 : i + 2] == "\n":
                    flush(i)
                    i = begin = i + 2
                else:
                    i += 1
            elif c == "`":
                run = len(text) - i - len(text[i:].lstrip("`"))
                end = self.ticks(i + run, run)
                flush(i)
                if end < 0:
                    self.nodes.append(_Node("text", i, i + run, text[i : i + run]))
                    i = begin = i + run
                else:
                    body = text[i + run : end].replace("\n", " ")
                    if body[:1] == body[-1:] == " " and body.strip(" "):
                        body = body[1:-1]
                    self.nodes.append(_Node("code", i, end + run, body))
                    i = begin = end + run
            elif c == "<":
                m = _AUTOLINK.match(text, i)
                if m:
                    flush(i)
                    self.nodes.append(_Node("auto", i, m.end(), m[0][1:-1]))
                    i = begin = m.end()
                elif m := _INLINE_HTML.match(text, i):
                    flush(i)
                    self.nodes.append(_Node("html", i, m.end()))
                    i = begin = m.end()
                else:
                    flush(i)
                    self.nodes.append(_Node("text", i, i + 1, "<"))
                    i = begin = i + 1
            elif c == "&":
                m = _ENTITY.match(text, i)
                if m and html.unescape(m[0]) != m[0]:
                    flush(i)
                    self.nodes.append(_Node("text", i, m.end(), html.unescape(m[0])))
                    i = begin = m.end()
                else:
                    i += 1
            elif c in "*_~":
                run = i
                while run < n and text[run] == c:
                    run += 1
                opens, closes = self.flanks(i, run, c)
                if opens or closes:
                    flush(i)
                    self.nodes.append(_Node("delim", i, run, text[i:run], opens, closes))
                    begin = run
                i = run
            elif c == "!" and text[i + 1 : i + 2] != "[":
                i += 1
            elif c == "]":
                flush(i)
                i = begin = self.close(i)
            else:
                image = c == "!"
                at = i + image
                if m := _WIKILINK.match(text, at):
                    # In a table the bar is escaped.
                    target, bar, alias = m[1].partition("\\|") if not m[2] else (m[1].removesuffix("\\"), "|", m[2][1:])
                    if target.strip() or bar:
                        flush(i)
                        self.nodes.append(_Node("wiki", i, m.end(), target, image=image, info={"alias": alias if bar else None}))
                        i = begin = m.end()
                        continue
                flush(i)
                node = _Node("open", i, at + 1, text[i : at + 1], image=image)
                self.nodes.append(node)
                self.brackets.append(node)
                i = begin = at + 1
        flush(n)
        return _emphasis(self.nodes)

    def ticks(self, i: int, run: int) -> int:
        """Where the closing run of ``run`` backticks starts, or -1."""
        for m in re.compile("`+").finditer(self.text, i):
            if m.end() - m.start() == run:
                return m.start()
        return -1

    def flanks(self, a: int, b: int, c: str) -> tuple[bool, bool]:
        before, after = self.text[a - 1 : a] if a else "", self.text[b : b + 1]
        space_before, space_after = not before or before.isspace(), not after or after.isspace()
        punct_before, punct_after = bool(before) and _punctuation(before), bool(after) and _punctuation(after)
        left = not space_after and (not punct_after or space_before or punct_before)
        right = not space_before and (not punct_before or space_after or punct_after)
        if c == "_":
            return left and (not right or punct_before), right and (not left or punct_after)
        return left, right

    def close(self, i: int) -> int:
        """Handle the bracket at ``i``; returns where to go on."""
        text = self.text
        if not self.brackets:
            self.nodes.append(_Node("text", i, i + 1, "]"))
            return i + 1
        node = self.brackets.pop()
        found = self.target(node, i) if node.active else None
        if found is None:
            node.kind = "text"
            self.nodes.append(_Node("text", i, i + 1, "]"))
            return i + 1
        end, info = found
        k = next(j for j in range(len(self.nodes) - 1, -1, -1) if self.nodes[j] is node)
        inner = _emphasis(self.nodes[k + 1 :])
        del self.nodes[k:]
        info["display"] = text[node.b : i]
        self.nodes.append(_Node("link", node.a, end, image=node.image, info=info, children=inner))
        if not node.image:  # links do not hold links
            for other in self.brackets:
                if not other.image:
                    other.active = False
        return end

    def target(self, node: _Node, i: int) -> tuple[int, dict] | None:
        """(end, what kind of link) for a bracket pair closed at ``i``."""
        text = self.text
        if text[i + 1 : i + 2] == "(":
            at = _spaces(text, i + 2)
            dest = _destination(text, at)
            if dest is not None:
                a, b, k = dest
                after = _spaces(text, k)
                if after > k and (t := _TITLE.match(text, after)):
                    after = _spaces(text, t.end())
                if text[after : after + 1] == ")":
                    return after + 1, {"type": "inline", "dest": unescape(text[a:b]), "range": (a, b), "angle": text[at : at + 1] == "<"}
        m = _LABEL.match(text, i + 1)
        if m and normal_label(m[1]) in self.known:
            return m.end(), {"type": "reference", "dest": self.known[normal_label(m[1])], "label": m[1]}
        if m is None:
            label = text[node.b : i]
            if normal_label(label) in self.known and not re.search(r"(?<!\\)[\[\]]", label):
                collapsed = text[i + 1 : i + 3] == "[]"
                return i + (3 if collapsed else 1), {"type": "reference", "dest": self.known[normal_label(label)], "label": label}
        return None


def _punctuation(c: str) -> bool:
    import unicodedata

    return c in _ESCAPABLE or unicodedata.category(c)[0] in "PS"


def _emphasis(nodes: list[_Node]) -> list[_Node]:
    """Drop delimiters that pair up; leave the others as text."""
    stack: list[_Node] = []
    for node in nodes:
        if node.kind == "open":
            node.kind = "text"
        if node.kind != "delim":
            continue
        size = len(node.value)
        left = size
        if node.closes:
            while left:
                c = node.value[0]
                k = next(
                    (
                        j
                        for j in range(len(stack) - 1, -1, -1)
                        if stack[j].value[:1] == c
                        and (c != "~" or len(stack[j].value) == left)
                        and not (c != "~" and (node.opens or stack[j].closes) and (size + stack[j].info["size"]) % 3 == 0 and (size % 3 or stack[j].info["size"] % 3))
                    ),
                    None,
                )
                if k is None:
                    break
                del stack[k + 1 :]
                used = left if c == "~" else 2 if left >= 2 and len(stack[k].value) >= 2 else 1
                stack[k].value = stack[k].value[used:]
                stack[k].b -= used
                node.a += used
                left -= used
                if not stack[k].value:
                    stack.pop()
            node.value = node.value[:left]
        if left and node.opens:
            node.info = {"size": size}
            stack.append(node)
    out = []
    for node in nodes:
        if node.kind == "delim":
            if not node.value:
                continue
            node.kind = "text"
        out.append(node)
    return out


def split_fragment(destination: str) -> tuple[str, str | None, str | None]:
    """(path or name, fragment kind, fragment)."""
    head, mark, rest = destination.partition("#")
    if not mark:
        return head, None, None
    return (head, "block", rest[1:]) if rest.startswith("^") else (head, "heading", rest)


def parse(source: str) -> Parsed:
    """All facets of one document."""
    reader = _Reader(source)
    reader.run()
    out = Parsed(block_ids=block_ids(source))
    out.ranges = [*reader.raw]
    for kind, level, start, end, lines in reader.leaves:
        texts: list[str] = []
        if lines:
            joined = _Joined(lines)
            nodes = _Inlines(joined.text, reader.known).read() if _SPECIAL.search(joined.text) else [_Node("text", 0, len(joined.text), joined.text)]
            _collect(nodes, joined, "heading" if kind == "heading" else "prose", out, texts, False)
        if kind == "heading":
            out.headings.append({"level": level, "text": "".join(texts), "start": start, "end": end})
    for h, a in zip(out.headings, anchors([h["text"] for h in out.headings]), strict=True):
        h["anchor"] = a
    for label, dest, start, end, where in reader.definitions:
        if where:
            out.destinations.append((dest, *where))
        if reader.known.get(normal_label(label)) == dest and not any(normal_label(d["label"]) == normal_label(label) for d in out.definitions):
            out.definitions.append({"label": label, "destination": dest, "start": start, "end": end})
    _to_bytes(source, out)
    out.ranges.sort(key=lambda r: r[1])
    return out


def _collect(nodes: list[_Node], joined: _Joined, kind: str, out: Parsed, texts: list[str], inside: bool) -> None:
    """Walk nodes in document order."""
    for node in nodes:
        if node.kind == "text":
            texts.append(node.value)
            if not inside and node.b > node.a:
                out.ranges.append((kind, joined.at(node.a), joined.end(node.b)))
        elif node.kind == "code":
            texts.append(node.value)
            out.ranges.append(("inline_code", joined.at(node.a), joined.end(node.b)))
        elif node.kind == "html":
            out.ranges.append(("html_inline", joined.at(node.a), joined.end(node.b)))
        elif node.kind == "auto":
            texts.append(node.value)
            out.ranges.append(("url", joined.at(node.a), joined.end(node.b)))
        elif node.kind == "wiki":
            start, end = joined.at(node.a), joined.end(node.b)
            out.ranges.append(("embed" if node.image else "wikilink", start, end))
            alias = node.info["alias"]
            texts.append(node.value if alias is None else alias)
            name, frag_kind, frag = split_fragment(node.value)
            display = alias if alias is not None else node.value.partition("#")[0]
            out.links.append(Link("obsidian", "name", ascii_lower(name), frag_kind, frag, display, start, end, None, None, None, node.image))
        else:
            start, end = joined.at(node.a), joined.end(node.b)
            out.ranges.append(("url", start, end))
            info = node.info
            if "label" in info:
                out.uses.append(info["label"])
            where = None
            if info["type"] == "inline":
                a, b = info["range"]
                if b > a and not (info["angle"] and joined.text[a:b] != info["dest"]):
                    where = joined.at(a), joined.end(b)
                    out.destinations.append((info["dest"], *where))
            if not node.image:
                path, frag_kind, frag = split_fragment(info["dest"])
                if not path or paths.is_relative_md(path):
                    out.links.append(Link("markdown", "path", path, frag_kind, frag, info["display"], start, end, *(where or (None, None)), info.get("label"), False))
            _collect(node.children, joined, kind, out, texts, True)


def _to_bytes(source: str, out: Parsed) -> None:
    """Turn character offsets into byte offsets."""
    if source.isascii():
        return
    import numpy as np

    codes = np.frombuffer(source.encode("utf-32-le"), np.uint32)
    at = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), out=at[1:])
    at = at.tolist()
    for h in (*out.headings, *out.definitions):
        h["start"], h["end"] = at[h["start"]], at[h["end"]]
    for link in out.links:
        link.start, link.end = at[link.start], at[link.end]
        if link.dest_start is not None:
            link.dest_start, link.dest_end = at[link.dest_start], at[link.dest_end]
    out.destinations = [(d, at[a], at[b]) for d, a, b in out.destinations]
    out.ranges = [(k, at[a], at[b]) for k, a, b in out.ranges]
