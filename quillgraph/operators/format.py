"""Links in the preferred style: converting links and linking mentions.

What a link should become is found by joins.  Only the choice of reference
labels depends on the order within a document, so the last step folds over the
links of one document at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..functions import scalars as S
from ..functions.markdown import normal_label
from ..sources.config import Linking
from .edits import SCHEMA
from .resolve import fragment_key, targets


def _fragment_facts(pages: DataFrame) -> DataFrame:
    """target_path, frag_key -> canonical text, its anchor, whether another heading has the text first."""
    h = pages.select("rel_path", F.posexplode("headings").alias("pos", "h")).select("rel_path", "pos", "h.text", "h.anchor", S.ascii_lower("h.text").alias("low"))
    first = Window.partitionBy("rel_path", "low").orderBy("pos")
    h = h.withColumn("first_pos", F.first("pos").over(first)).withColumn("first_anchor", F.first("anchor").over(first))
    by_text = h.where("pos = first_pos").select("rel_path", F.concat(F.lit("t:"), "low").alias("frag_key"), "text", "anchor", F.lit(False).alias("later"))
    by_anchor = h.select("rel_path", F.concat(F.lit("a:"), "anchor").alias("frag_key"), "text", F.col("first_anchor").alias("anchor"), (F.col("pos") != F.col("first_pos")).alias("later"))
    blocks = pages.select("rel_path", F.explode("block_ids").alias("b")).distinct().select("rel_path", F.concat(F.lit("b:"), "b").alias("frag_key"), F.col("b").alias("text"), F.col("b").alias("anchor"), F.lit(False).alias("later"))
    return by_text.unionByName(by_anchor).unionByName(blocks).withColumnRenamed("rel_path", "target_path")


def convertible(resolved: DataFrame, pages: DataFrame, linking: Linking) -> DataFrame:
    """The links that can be written in the preferred style, with what that takes.

    Left out: embeds, links and fragments that lead nowhere, and for wikilinks
    also targets that have no name and headings that a wikilink can't tell
    from an earlier one.
    """
    named = targets(pages).select(F.col("page_id").alias("target_id"), F.col("rel_path").alias("name_path"), F.col("stem").alias("name_stem"))
    x = resolved.where("NOT embed AND target_path IS NOT NULL").join(named, "target_id", "left")
    x = x.withColumn("frag_key", fragment_key()).join(_fragment_facts(pages), ["target_path", "frag_key"], "left")
    x = x.where("frag_key IS NULL OR text IS NOT NULL")
    if linking.link_style == "obsidian":
        x = x.where("name_path = target_path AND NOT (style = 'markdown' AND coalesce(later, false))")
    return x.select("rel_path", "pos", "start", "end", "display", "ref_label", "target_id", "target_path", F.coalesce("name_stem", "target_id").alias("name"), "frag_kind", F.col("text").alias("frag"), "anchor")


def skipped(resolved: DataFrame, converted: DataFrame) -> DataFrame:
    """Links other than embeds that can't be converted."""
    return resolved.where("NOT embed").join(converted.select("rel_path", "pos"), ["rel_path", "pos"], "left_anti")


def format_edits(pages: DataFrame, targets_: DataFrame, resolved: DataFrame, linking: Linking) -> DataFrame:
    """Edits that bring every convertible link into the preferred style.

    ``pages`` has definitions and uses, ``targets_`` headings and block ids.
    """
    links = convertible(resolved, targets_, linking)
    per_doc = links.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in links.columns if c not in ("rel_path", "pos")]))).alias("found"))
    docs = pages.select("rel_path", "source", "definitions", "uses").join(per_doc, "rel_path")
    return docs.mapInPandas(_by_document(lambda row: _format_document(row, linking)), SCHEMA)


def fix_edits(pages: DataFrame, resolved: DataFrame, mentions: DataFrame, linking: Linking) -> DataFrame:
    """Edits that turn mentions into links in the preferred style.

    The links that a document has already count towards reference style.
    """
    named = targets(pages.where("is_managed")).select(F.col("page_id").alias("concept"), F.col("rel_path").alias("target_path"), F.col("stem").alias("name"))
    have = resolved.where("target_id IS NOT NULL").groupBy("rel_path", F.col("target_id").alias("concept")).agg(F.count("*").cast("int").alias("n_links"))
    found = mentions.join(named, "concept").join(have, ["rel_path", "concept"], "left").fillna(0, ["n_links"])
    found = found.withColumn("n", F.col("n_links") + F.count("*").over(Window.partitionBy("rel_path", "concept")).cast("int"))
    per_doc = found.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "concept", "name", "target_path", "n"))).alias("found"))
    docs = pages.select("rel_path", "source", "definitions").join(per_doc, "rel_path")
    return docs.mapInPandas(_by_document(lambda row: _link_mentions(row, linking)), SCHEMA)


def obsidian_link(name: Column | str, frag_kind: Column | str, frag: Column | str, display: Column | str) -> Column:
    """A wikilink as a column; the display text is left out if it says no more than the name."""
    label = S.logical_label(name, frag_kind, frag)
    shown, plain = (F.col(c) if isinstance(c, str) else c for c in (display, name))
    kind = F.col(frag_kind) if isinstance(frag_kind, str) else frag_kind
    return F.when((shown == plain) & kind.isNull(), F.concat(F.lit("[["), label, F.lit("]]"))).otherwise(F.concat(F.lit("[["), label, F.lit("|"), shown, F.lit("]]")))


def _by_document(edit):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.rel_path, a, b, text) for r in frame.itertuples(index=False) for a, b, text in edit(r)]
            yield pd.DataFrame(rows, columns=["rel_path", "start", "end", "replacement"])

    return run


def _label(name: str, frag_kind: str | None, frag: str | None) -> str:
    return name + {"heading": f"#{frag}", "block": f"#^{frag}"}.get(frag_kind, "")


def _escaped(label: str) -> str:
    return re.sub(r"([\\\[\]])", r"\\\1", label)


class _Labels:
    """Reference labels of one document, and the definitions they need."""

    def __init__(self, taken: list[str]):
        self._taken = {normal_label(x) for x in taken}
        self._own: dict[tuple, str] = {}
        self.lines: list[str] = []

    def get(self, key: tuple, wish: str, destination: str) -> str:
        if key not in self._own:
            label, k = wish, 1
            while normal_label(label) in self._taken:
                k += 1
                label = f"{wish}-{k}"
            self._taken.add(normal_label(label))
            self._own[key] = label
            self.lines.append(f"[{_escaped(label)}]: {destination}\n")
        return self._own[key]

    def footer(self, raw: bytes, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """The edit that appends the definitions after a blank line."""
        if not self.lines:
            return []
        ending = _applied(raw, edits)[-2:]
        gap = "" if ending == b"\n\n" else "\n" if ending.endswith(b"\n") else "\n\n"
        return [(len(raw), len(raw), gap + "".join(self.lines))]


def _applied(raw: bytes, edits: list[tuple[int, int, str]]) -> bytes:
    out, at = [], 0
    for a, b, text in sorted(edits):
        out += [raw[at:a], text.encode()]
        at = b
    return b"".join([*out, raw[at:]])


def _page_url(source_path: str, target_path: str) -> str:
    return paths.encode(paths.relative(paths.parent(source_path), target_path))


def _listed(value) -> list:
    return [] if value is None else list(value)


def _format_document(row, linking: Linking) -> list[tuple[int, int, str]]:
    raw, links = row.source.encode(), _listed(row.found)
    counts: dict[str, int] = {}
    converted: dict[str, int] = {}
    used: dict[str, int] = {}
    for x in links:
        counts[x["target_id"]] = counts.get(x["target_id"], 0) + 1
        if x["ref_label"] is not None:
            k = normal_label(x["ref_label"])
            converted[k] = converted.get(k, 0) + 1
    for label in _listed(row.uses):
        used[normal_label(label)] = used.get(normal_label(label), 0) + 1
    # A definition goes once all its uses are converted.
    dropped, kept = [], []
    for d in _listed(row.definitions):
        k = normal_label(d["label"])
        (dropped if used.get(k) and used[k] == converted.get(k, 0) else kept).append(d)
    labels = _Labels([d["label"] for d in kept])
    edits = []
    for x in links:
        wish = _label(x["name"], x["frag_kind"], x["frag"])
        if linking.link_style == "obsidian":
            new = f"[[{wish}]]" if x["display"] == x["name"] and x["frag_kind"] is None else f"[[{wish}|{x['display']}]]"
        else:
            url = _page_url(row.rel_path, x["target_path"]) + {"heading": f"#{x['anchor']}", "block": f"#^{x['frag']}"}.get(x["frag_kind"], "")
            if linking.reference_style_threshold and counts[x["target_id"]] >= linking.reference_style_threshold:
                label = _escaped(labels.get((x["target_id"], x["frag_kind"], x["frag"]), wish, url))
                new = f"[{label}]" if x["display"] == label else f"[{x['display']}][{label}]"
            else:
                new = f"[{x['display']}]({url})"
        if raw[x["start"] : x["end"]].decode() != new:
            edits.append((int(x["start"]), int(x["end"]), new))
    for d in dropped:
        end = int(d["end"])
        end += 2 if raw[end : end + 2] == b"\r\n" else raw[end : end + 1] == b"\n"
        edits.append((int(d["start"]), end, ""))
    edits += labels.footer(raw, edits)
    return [] if _applied(raw, edits) == raw else edits


def _link_mentions(row, linking: Linking) -> list[tuple[int, int, str]]:
    raw = row.source.encode()
    labels = _Labels([d["label"] for d in _listed(row.definitions)])
    edits = []
    for x in _listed(row.found):
        name = x["name"]
        if linking.link_style == "obsidian":
            new = f"[[{name}]]"
        else:
            url = _page_url(row.rel_path, x["target_path"])
            if linking.reference_style_threshold and x["n"] >= linking.reference_style_threshold:
                label = labels.get((x["concept"],), name, url)
                new = f"[{_escaped(label)}]" if label == name else f"[{name}][{_escaped(label)}]"
            else:
                new = f"[{name}]({url})"
        edits.append((int(x["start"]), int(x["end"]), new))
    return edits + labels.footer(raw, edits)
