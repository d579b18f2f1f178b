"""Edits as rows (rel_path, start, end, replacement), offsets in bytes.

Every rewrite is such a table: it is checked, shown as hunks, or folded into
new sources.  The edits of a file are brought together before they meet its
source, which is thus moved once, and lines are found by one sweep.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "rel_path string, start int, end int, replacement string"


class EditError(ValueError):
    """Edits that can't be applied together."""


def _by_file(edits: DataFrame, files: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """rel_path, edits (in order, one array) and raw, the file's bytes: a source meets its edits once, however many."""
    own = edits.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement", *more))).alias("edits"))
    return own.join(files.select("rel_path", F.col("source").cast("binary").alias("raw")), "rel_path", how)


def effective(edits: DataFrame, files: DataFrame) -> DataFrame:
    """The edits that change something."""
    there = "cast(substring(raw, e.start + 1, e.end - e.start) AS string)"
    changing = _by_file(edits, files).select("rel_path", F.explode(F.expr(f"filter(edits, e -> {there} <> e.replacement)")).alias("e"))
    return changing.select("rel_path", "e.*")


def invalid(edits: DataFrame, files: DataFrame) -> DataFrame:
    """Edits out of bounds, inside a character, or overlapping the one before; with a reason."""
    w = Window.partitionBy("rel_path").orderBy("start", "end")
    marked = edits.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))

    def inside(at: str) -> str:
        return f"({at} < octet_length(raw) AND cast(conv(hex(substring(raw, {at} + 1, 1)), 16, 10) AS int) BETWEEN 128 AND 191)"

    reason = f"""CASE WHEN raw IS NULL THEN 'no such file'
        WHEN e.start < 0 OR e.start > e.end OR e.end > octet_length(raw) THEN 'out of bounds'
        WHEN {inside("e.start")} OR {inside("e.end")} THEN 'inside a character'
        WHEN e.before > e.start THEN 'overlaps' END"""
    told = F.expr(f"filter(transform(edits, e -> struct(e.start, e.end, e.replacement, {reason} AS reason)), e -> e.reason IS NOT NULL)")
    return _by_file(marked, files, "before", how="left").select("rel_path", F.explode(told).alias("e")).select("rel_path", "e.*")


def checked(edits: DataFrame, files: DataFrame) -> DataFrame:
    """``edits``, or EditError if they can't be applied together."""
    bad = invalid(edits, files).first()
    if bad:
        raise EditError(f"{bad.rel_path}: edit {bad.start}..{bad.end} {bad.reason}")
    return edits


def _mapped(edits: DataFrame, files: DataFrame, of_file: Callable[[bytes, list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``of_file`` makes of a file's bytes and its edits in order, with its path."""
    fields = from_ddl(f"rel_path string, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, own, raw in zip(*(batch.column(k) for k in range(3)), strict=True):
                rows = [(path.as_py(), *r) for r in of_file(raw.as_py() or b"", own.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], fields)

    return _by_file(edits, files).mapInArrow(run, f"rel_path string, {schema}")


def from_ddl(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _spliced(raw: bytes, edits: list[dict]) -> Iterator[tuple]:
    out, at = [], 0
    for e in edits:
        out += [raw[at : e["start"]], e["replacement"].encode()]
        at = e["end"]
    yield (b"".join([*out, raw[at:]]).decode(),)


def _hunks(raw: bytes, edits: list[dict]) -> Iterator[tuple]:
    """By one sweep: edits are in order, so lines are counted on from the last one."""
    line, upto = 1, 0
    for e in edits:
        start, end = e["start"], e["end"]
        line, upto = line + raw.count(b"\n", upto, start), max(upto, start)
        head = raw[raw.rfind(b"\n", 0, start) + 1 : start]
        stop = raw.find(b"\n", end) + 1 or len(raw)
        tail = b"" if raw[start:end].endswith(b"\n") else raw[end:stop]
        yield line, (head + raw[start:end] + tail).decode(), (head + e["replacement"].encode() + tail).decode(), start


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """rel_path and the new source of every file that has edits."""
    return _mapped(edits, files, _spliced, "source string")


def hunks(files: DataFrame, edits: DataFrame) -> DataFrame:
    """rel_path, line, old, new: each edit with the lines it stands in."""
    return _mapped(edits, files, _hunks, "line int, old string, new string, start int").orderBy("rel_path", "start").drop("start")


def render(hunk_rows: list) -> str:
    """Hunks, in order, as text."""
    out, path = [], None
    for h in hunk_rows:
        if h.rel_path != path:
            path = h.rel_path
            out.append(f"--- {path}\n+++ {path}\n")
        out.append(f"@@ -{h.line} +{h.line} @@\n")
        out += [f"{mark}{text}" + ("" if text.endswith("\n") else "\n") for mark, text in (("-", h.old), ("+", h.new))]
    return "".join(out)
