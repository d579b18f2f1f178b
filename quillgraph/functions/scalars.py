"""Scalar rules on names, links and paths as column expressions.

All of them are built from functions that run in the JVM.  Letter case is
folded for ASCII only, so ``lower`` is not used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ENCODED

#: Control characters have to be escaped in TOML, some by short forms.
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
TOML_ESCAPES = [(c, _SHORT.get(c, f"\\u{ord(c):04X}")) for c in map(chr, (*range(1, 32), 127))]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    return F.translate(_col(c), string.ascii_uppercase, string.ascii_lowercase)


def stem(path: Column | str) -> Column:
    """File name without the last ``.md``."""
    return F.regexp_replace(F.substring_index(_col(path), "/", -1), r"\.md$", "")


def page_id(path: Column | str) -> Column:
    return ascii_lower(stem(path))


def directory(path: Column | str) -> Column:
    """The folder of a file; ``.`` for the root."""
    return F.coalesce(F.nullif(F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def parent(path: Column | str) -> Column:
    """The folder of a file; empty for the root."""
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def in_folder(path: Column | str, folder: str) -> Column:
    """Whether a path lies in a folder, component by component."""
    p = _col(path)
    return F.lit(True) if folder == "." else (p == folder) | p.startswith(f"{folder}/")


def strip_slash(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "/+$", "")


def fragment_path(dest: Column | str) -> Column:
    """What stands before the first ``#``; NULL if that is empty."""
    return F.nullif(F.substring_index(_col(dest), "#", 1), F.lit(""))


def fragment(dest: Column | str) -> Column:
    """struct(kind, value) of what follows the first ``#``; NULL without one."""
    d = _col(dest)
    rest = F.substring(d, F.locate("#", d) + 1, F.length(d))
    block = rest.startswith("^")
    value = F.when(block, F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
    return F.when(F.locate("#", d) > 0, F.struct(F.when(block, "block").otherwise("heading").alias("kind"), value.alias("value")))


def heading_anchor(text: Column | str) -> Column:
    """The anchor of a heading before repeats are told apart."""
    dashed = F.regexp_replace(ascii_lower(text), r"(?U)\s", "-")
    return F.regexp_replace(F.regexp_replace(dashed, r"[^\p{IsAlphabetic}\p{N}_-]", ""), "^-+|-+$", "")


def url_decode(path: Column | str) -> Column:
    """Percent escapes resolved; NULL for malformed ones or bytes that are not UTF-8."""
    p = _col(path)
    out = F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))
    # Bytes that are not UTF-8 come out as more replacement characters than the path spells.
    spelt = F.regexp_count(p, F.lit("\ufffd|(?i:%EF%BF%BD)"))
    return F.when(F.regexp_count(out, F.lit("\ufffd")) > spelt, None).otherwise(out)


def url_encode(path: Column | str) -> Column:
    out = _col(path)
    for plain, code in ENCODED:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def normalize_path(path: Column | str) -> Column:
    """Without ``.`` and ``..``; the root is its own parent."""
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part.isin("", "."), done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(_col(path), "/"), empty, step), "/")


def join_path(folder: Column | str, path: Column | str) -> Column:
    f = _col(folder)
    return F.when(f == "", _col(path)).otherwise(F.concat_ws("/", f, _col(path)))


def relative_path(folder: Column | str, target: Column | str) -> Column:
    """The way from a folder to a target, both from the root."""
    a = F.filter(F.split(_col(folder), "/"), lambda x: x != "")
    b = F.filter(F.split(_col(target), "/"), lambda x: x != "")
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first = F.array_position(same, False)
    k = F.when(first > 0, first - 1).otherwise(n).cast("int")
    ups = F.array_repeat(F.lit(".."), F.size(a) - k)
    return F.array_join(F.concat(ups, F.slice(b, k + 1, F.greatest(F.size(b) - k, F.lit(0)))), "/")


def is_relative_md(path: Column | str) -> Column:
    """Whether a link path names a Markdown file by a relative path."""
    plain = url_decode(path)
    name = F.substring_index(plain, "/", -1)
    ok = ~plain.rlike(r"^[/\\]") & ~F.substring_index(plain, "/", 1).contains(":") & name.endswith(".md") & (name != ".md")
    return F.coalesce(ok, F.lit(False))


def markdown_url(path: Column | str, suffix: Column | str) -> Column:
    """An encoded path and the rest of a destination, from its ``#`` on."""
    return F.concat(url_encode(path), F.coalesce(_col(suffix), F.lit("")))


def resolved_path(source: Column | str, link_path: Column | str) -> Column:
    """The root-relative path that a link path in ``source`` points at, or NULL."""
    plain = url_decode(link_path)
    return F.when(~plain.rlike(r"^[/\\]"), normalize_path(join_path(parent(source), plain)))


def logical_label(name: Column | str, frag_kind: Column | str, frag: Column | str) -> Column:
    """``name``, ``name#heading`` or ``name#^block``."""
    kind = _col(frag_kind)
    return F.concat(_col(name), F.when(kind == "heading", F.concat(F.lit("#"), _col(frag))).when(kind == "block", F.concat(F.lit("#^"), _col(frag))).otherwise(""))


def escape_label(label: Column | str) -> Column:
    return F.regexp_replace(_col(label), r"([\\\[\]])", r"\\$1")


def percent(part: Column | str, whole: Column | str) -> Column:
    """Whole percent, halves to the even number."""
    return F.bround(_col(part) * 100.0 / _col(whole), 0).cast("int")


def byte_slice(source: Column | str, start: Column | str, end: Column | str) -> Column:
    """Text between two byte offsets."""
    s = _col(start)
    return F.substring(_col(source).cast("binary"), s + 1, _col(end) - s).cast("string")


def line_of(source: Column | str, offset: Column | str) -> Column:
    """1-based line of a byte offset."""
    before = F.substring(_col(source).cast("binary"), F.lit(1), _col(offset)).cast("string")
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def column_of(source: Column | str, offset: Column | str) -> Column:
    """1-based column, in bytes, of a byte offset."""
    before = F.substring(_col(source).cast("binary"), F.lit(1), _col(offset)).cast("string")
    return F.octet_length(F.substring_index(before, "\n", -1)) + 1


def quoted_list(items: Column | str) -> Column:
    return F.array_join(F.transform(_col(items), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")


def toml_string(text: Column | str) -> Column:
    """A text as a TOML string: quotes, backslashes and control characters escaped."""
    out = F.regexp_replace(_col(text), r'(["\\])', r"\\$1")
    for plain, code in TOML_ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return F.concat(F.lit('"'), out, F.lit('"'))


def rename_wikilink(markup: Column | str, new_name: str) -> Column:
    """A wikilink's markup with another target; an alias equal to it is dropped."""
    m = _col(markup)
    inner = F.regexp_extract(m, r"(?s)\[\[(.*)\]\]", 1)
    rest = F.regexp_extract(inner, r"(?s)^[^#|]*(.*)$", 1)
    target = F.concat(F.lit(new_name), F.regexp_extract(rest, r"(?s)^([^|]*)", 1))
    alias = F.regexp_extract(rest, r"(?s)^[^|]*\|(.*)$", 1)
    body = F.when(~rest.contains("|") | (alias == target), target).otherwise(F.concat(target, F.lit("|"), alias))
    return F.when(m.contains("[["), F.concat(F.regexp_extract(m, r"(?s)^(.*?)\[\[", 1), F.lit("[["), body, F.lit("]]"))).otherwise(m)
