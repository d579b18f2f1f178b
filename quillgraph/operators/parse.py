"""The parse step: one Arrow pass from (rel_path, source) to nested facets, and
the fact tables that explode them."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

_I, _S, _B = pa.int32(), pa.string(), pa.bool_()

FACETS = {
    "frontmatter": [
        ("fm_json", _S),
        ("fm_start", _I),
        ("fm_end", _I),
        ("fm_error", _S),
        ("fm_keys", pa.list_(_S)),
        ("fm_lists", pa.map_(_S, pa.list_(_S))),
        ("fm_false", pa.list_(_S)),
    ],
    "headings": [("headings", pa.list_(pa.struct([("level", _I), ("text", _S), ("anchor", _S), ("start", _I), ("end", _I), ("markup", _S)])))],
    "links": [
        (
            "links",
            pa.list_(
                pa.struct(
                    [("style", _S), ("target_kind", _S), ("target", _S), ("frag_kind", _S), ("frag", _S), ("display", _S), ("start", _I), ("end", _I)]
                    + [("dest_start", _I), ("dest_end", _I), ("ref_label", _S), ("embed", _B), ("line", _I), ("col", _I), ("markup", _S)]
                )
            ),
        )
    ],
    "destinations": [("destinations", pa.list_(pa.struct([("destination", _S), ("start", _I), ("end", _I)])))],
    "definitions": [("definitions", pa.list_(pa.struct([("label", _S), ("destination", _S), ("start", _I), ("end", _I)])))],
    "uses": [("uses", pa.list_(_S))],
    "ranges": [("ranges", pa.list_(pa.struct([("kind", _S), ("start", _I), ("end", _I)])))],
    "block_ids": [("block_ids", pa.list_(_S))],
}


def _frontmatter(source: str) -> dict:
    from ..functions import frontmatter as fm

    try:
        found = fm.parse(source)
    except fm.FrontmatterError as e:
        return {"fm_error": str(e)}
    if found is None:
        return {}
    out: dict = {"fm_json": fm.to_json(found.data), "fm_start": found.start, "fm_end": found.end}
    if isinstance(found.data, dict):
        out["fm_keys"] = [str(k) for k in found.data]
        out["fm_lists"] = [(str(k), s) for k, v in found.data.items() if (s := fm.strings(v)) is not None]
        out["fm_false"] = [str(k) for k, v in found.data.items() if v is False]
    return out


def _document(source: str, facets: frozenset[str]) -> dict:
    from ..functions import markdown

    out = _frontmatter(source) if "frontmatter" in facets else {}
    if facets <= {"frontmatter"}:
        return out
    if facets <= {"frontmatter", "block_ids"}:
        return out | {"block_ids": markdown.block_ids(source)}
    doc = markdown.parse(source)
    raw = source.encode()
    if "headings" in facets:
        out["headings"] = [h | {"markup": raw[h["start"] : h["end"]].decode()} for h in doc.headings]
    if "links" in facets:
        breaks = [i for i, c in enumerate(raw) if c == 10] if doc.links else []
        rows = []
        for x in doc.links:
            line = bisect.bisect_left(breaks, x.start)
            col = x.start - (breaks[line - 1] + 1 if line else 0) + 1
            rows.append(vars(x) | {"line": line + 1, "col": col, "markup": raw[x.start : x.end].decode()})
        out["links"] = rows
    if "destinations" in facets:
        out["destinations"] = [{"destination": d, "start": a, "end": b} for d, a, b in doc.destinations]
    if "definitions" in facets:
        out["definitions"] = doc.definitions
    if "uses" in facets:
        out["uses"] = doc.uses
    if "ranges" in facets:
        out["ranges"] = [{"kind": k, "start": a, "end": b} for k, a, b in doc.ranges]
    if "block_ids" in facets:
        out["block_ids"] = doc.block_ids
    return out


def parse_documents(files: DataFrame, facets: tuple[str, ...] = tuple(FACETS)) -> DataFrame:
    """``files`` with the columns of the wanted facets; others are not computed.

    A narrow map: documents keep their partitions.
    """
    wanted = frozenset(facets)
    fields = [f for name in FACETS if name in wanted for f in FACETS[name]]
    at = files.columns.index("source")
    schema = files.select(*files.columns).schema
    for name, kind in fields:
        schema = schema.add(name, from_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                docs = [_document(s or "", wanted) for s in part.column(at).to_pylist()]
                columns = [pa.array([d.get(name) for d in docs], kind) for name, kind in fields]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *(n for n, _ in fields)])

    return files.mapInArrow(run, schema)


def links(parsed: DataFrame) -> DataFrame:
    """One row per internal link, in document order (pos)."""
    return parsed.select("rel_path", F.posexplode("links").alias("pos", "link")).select("rel_path", "pos", "link.*")


def wikilinks(parsed: DataFrame) -> DataFrame:
    return links(parsed).where("target_kind = 'name'")


def headings(parsed: DataFrame) -> DataFrame:
    return parsed.select("rel_path", F.posexplode("headings").alias("pos", "h")).select("rel_path", "pos", "h.*")


def block_ids(parsed: DataFrame) -> DataFrame:
    return parsed.select("rel_path", F.posexplode("block_ids").alias("pos", "block_id"))


def block_ids_of(files: DataFrame) -> DataFrame:
    """Block ids straight from the sources, without the parser."""
    line = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    lines = files.select("rel_path", F.posexplode(F.split("source", "\n")).alias("line_no", "line")).select("rel_path", "line_no", line.alias("line"))
    whole = F.when(F.col("line").rlike(r"^\^[A-Za-z0-9-]+$"), F.substring("line", F.lit(2), F.length("line")))
    ending = F.when(F.col("line").rlike(r" \^[A-Za-z0-9-]+$"), F.regexp_extract("line", r" \^([A-Za-z0-9-]+)$", 1))
    return lines.select("rel_path", "line_no", F.explode(F.array_compact(F.array(whole, ending))).alias("block_id"))


def destinations(parsed: DataFrame) -> DataFrame:
    return parsed.select("rel_path", F.posexplode("destinations").alias("pos", "d")).select("rel_path", "pos", "d.*")


def definitions(parsed: DataFrame) -> DataFrame:
    return parsed.select("rel_path", F.posexplode("definitions").alias("pos", "d")).select("rel_path", "pos", "d.*")


def ranges(parsed: DataFrame) -> DataFrame:
    return parsed.select("rel_path", F.posexplode("ranges").alias("pos", "r")).select("rel_path", "pos", "r.*")


def frontmatter(parsed: DataFrame) -> DataFrame:
    """rel_path, fm (VARIANT), fm_error; documents without frontmatter have neither."""
    return parsed.select("rel_path", F.try_parse_json("fm_json").alias("fm"), "fm_error")
