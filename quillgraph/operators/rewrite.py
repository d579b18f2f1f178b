"""Rewrites: renaming and moving pages, renaming sections, setting frontmatter.

Each gives moves (old, new) and edits (rel_path, start, end, replacement).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import markdown, paths
from ..functions import scalars as S
from ..sources.config import WikiConfig
from . import parse
from .edits import SCHEMA


class RewriteError(ValueError):
    """A rewrite that can't be done."""


def find(names: DataFrame, name: str, new: str | None = None):
    """The row (page_id, rel_path, stem) of a page given by name or alias, by one look at the names.

    With ``new`` an error if another page has that name.
    """
    wanted = [markdown.ascii_lower(x) for x in (name, new) if x is not None]
    rows = names.where(F.col("name").isin(*wanted)).select("name", "page_id", "rel_path", "stem").collect()
    row = next((r for r in rows if r["name"] == wanted[0]), None)
    if row is None:
        raise RewriteError(f"page not found: {name}")
    if new is not None and any(r["name"] == wanted[-1] and r.page_id != row.page_id for r in rows):
        raise RewriteError(f"a page is named {new} already")
    return row


def _retargeted(destinations: DataFrame, old: str, new: str) -> DataFrame:
    """Edits of destinations that point at ``old``."""
    path = S.fragment_path("destination")
    own = destinations.where(path.isNotNull() & S.is_relative_md(path) & (S.resolved_path("rel_path", path) == old))
    suffix = F.expr("substring(destination, length(substring_index(destination, '#', 1)) + 1, length(destination))")
    url = S.markdown_url(S.relative_path(S.parent("rel_path"), F.lit(new)), suffix)
    return own.select("rel_path", "start", "end", url.alias("replacement"), "destination").where("replacement <> destination").drop("destination")


def _rebased(destinations: DataFrame, old: str, new: str) -> DataFrame:
    """Edits of the moved page's own destinations."""
    path = S.fragment_path("destination")
    own = destinations.where((F.col("rel_path") == old) & path.isNotNull() & S.is_relative_md(path))
    target = S.resolved_path("rel_path", path)
    target = F.when(target == old, F.lit(new)).otherwise(target)
    suffix = F.expr("substring(destination, length(substring_index(destination, '#', 1)) + 1, length(destination))")
    url = S.markdown_url(S.relative_path(F.lit(paths.parent(new)), target), suffix)
    return own.select("rel_path", "start", "end", url.alias("replacement"), "destination").where("replacement <> destination").drop("destination")


def _moves(files: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
    return files.sparkSession.createDataFrame(rows, "old string, new string")


def rename(pages: DataFrame, resolved: DataFrame, names: DataFrame, config: WikiConfig, old: str, new: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A page gets another name: its file, its mirrors, and all references.

    Wikilinks by alias count.  In each file the first literal mention of a
    mirror's path is changed.  Before the plan there is one look at the names
    and one at the paths of ``files``, without parsing.
    """
    page = find(names, old, new)
    old_path, new_path = page.rel_path, paths.join(paths.parent(page.rel_path), f"{new}.md")
    mirrors = config.mirrors()
    inside = reduce(lambda a, b: a | b, [S.in_folder("rel_path", right) for _, right in mirrors], F.lit(False))
    mirror = inside & (F.substring_index("rel_path", "/", -1) == f"{page.stem}.md")
    there = files.where(mirror | (F.col("rel_path") == new_path)).select("rel_path", mirror.alias("mirror")).collect()
    if new_path != old_path and any(r.rel_path == new_path for r in there):
        raise RewriteError(f"{new_path} exists already")
    moves = [(old_path, new_path)] + [(r.rel_path, paths.join(paths.parent(r.rel_path), f"{new}.md")) for r in there if r.mirror]
    wiki = resolved.where((F.col("target_kind") == "name") & (F.col("target") != "") & (F.col("target_id") == page.page_id))
    edits = [wiki.select("rel_path", "start", "end", S.rename_wikilink("markup", new).alias("replacement"), "markup").where("replacement <> markup").drop("markup")]
    for _, right in mirrors:
        old_ref = f"{right}/{page.stem}.md"
        at = F.locate(old_ref, F.col("source"))
        start = F.octet_length(F.substring("source", F.lit(1), at - 1))
        edits.append(pages.where(at > 0).select("rel_path", start.alias("start"), (start + len(old_ref.encode())).alias("end"), F.lit(f"{right}/{new}.md").alias("replacement")))
    edits.append(_retargeted(parse.destinations(pages), old_path, new_path))
    return _moves(pages, sorted({*moves})), reduce(DataFrame.unionByName, edits)


def move(pages: DataFrame, names: DataFrame, name: str, folder: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A page goes to another folder below the root; mirrors stay."""
    page = find(names, name)
    depth = 0
    for part in folder.split("/"):
        depth += {"..": -1, "": 0, ".": 0}.get(part, 1)
        if depth < 0 or folder.startswith("/"):
            raise RewriteError(f"{folder} is outside the root")
    new = paths.join(paths.normalize(folder), paths.stem(page.rel_path) + ".md")
    if files.where(F.col("rel_path") == new).select("rel_path").first():
        raise RewriteError(f"{new} exists already")
    d = parse.destinations(pages)
    return _moves(pages, [(page.rel_path, new)]), _rebased(d, page.rel_path, new).unionByName(_retargeted(d.where(F.col("rel_path") != page.rel_path), page.rel_path, new))


def rename_section(pages: DataFrame, old: str, new: str, dirs: list[str] | None = None) -> DataFrame:
    """A heading text and what refers to it, in all pages or in some folders.

    References are known by the heading's name alone, whatever page they are to.
    A heading whose markup does not hold its text as such is left alone.
    """
    own = pages.where(reduce(lambda a, b: a | b, [S.in_folder("rel_path", d) for d in dirs])) if dirs else pages
    low = markdown.ascii_lower(old)
    h = parse.headings(own).where(S.ascii_lower("text") == low)
    at = F.expr("locate(text, markup)")
    start = F.col("start") + F.octet_length(F.substring("markup", F.lit(1), at - 1))
    in_headings = h.where(at > 0).select("rel_path", start.cast("int").alias("start"), (start + F.octet_length("text")).cast("int").alias("end"), F.lit(new).alias("replacement"))
    w = parse.wikilinks(own).where((F.col("frag_kind") == "heading") & (S.ascii_lower("frag") == low))
    in_links = w.select("rel_path", "start", "end", F.replace("markup", "frag", F.lit(new)).alias("replacement"), "markup").where("replacement <> markup").drop("markup")
    a, b = markdown.anchor(old), markdown.anchor(new)
    d = parse.destinations(own).where("instr(destination, '#') > 0").withColumn("frag", F.expr("substring(destination, instr(destination, '#') + 1, length(destination))"))
    rest = F.expr(f"substring(frag, {len(a) + 1}, length(frag))")
    d = d.where(F.col("frag").startswith(a) & ((F.col("frag") == a) | rest.rlike("^-[0-9]*$")))
    in_urls = d.select("rel_path", (F.col("end") - F.octet_length("frag")).cast("int").alias("start"), "end", F.concat(F.lit(b), rest).alias("replacement"))
    return in_headings.unionByName(in_links).unionByName(in_urls)


def get_frontmatter(pages: DataFrame, rel_path: str, field: str | None = None) -> str:
    """JSON of a page's frontmatter, indented, or of one field."""
    row = pages.where(F.col("rel_path") == rel_path).select("source").first()
    if row is None:
        raise RewriteError(f"no such file: {rel_path}")
    found = fm.parse(row.source)
    if found is None:
        raise RewriteError(f"{rel_path} has no frontmatter")
    if field is None:
        return fm.to_json(found.data, 2)
    if not isinstance(found.data, dict) or field not in found.data:
        raise RewriteError(f"{rel_path} has no field {field}")
    return fm.to_json(found.data[field])


def frontmatter_values(parsed: DataFrame, field: str) -> DataFrame:
    """rel_path, value (compact JSON) of a top-level field of every page that has it."""
    return parsed.where(F.array_contains("fm_keys", field)).select("rel_path", F.to_json(F.try_element_at(F.from_json("fm_json", "map<string, variant>"), F.lit(field))).alias("value"))


def set_frontmatter(files: DataFrame, field: str, value: str) -> DataFrame:
    """Edits that set a field in each of ``files``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *fm.set_field(s, field, value)) for p, s in zip(frame["rel_path"], frame["source"], strict=True)]
            yield pd.DataFrame(rows, columns=["rel_path", "start", "end", "replacement"])

    return files.select("rel_path", "source").mapInPandas(run, SCHEMA)
