"""Settings of many wikis as rows: texts parsed and checked by one Arrow map."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from . import config
from .config import ConfigError, Directory, WikiConfig

_S, _B = pa.string(), pa.bool_()
_LIST = pa.list_(_S)
_RULE = [("check", _S), ("severity", _S), ("dirs", _LIST), ("when_field", _S), ("when_value", _S), ("sections", _LIST), ("fields", _LIST), ("left", _S), ("right", _S), ("name", _S), ("pattern", _S), ("match_in", _S), ("match_mode", _S)]
FIELDS = [
    ("error", _S),
    ("index", _S),
    ("directories", pa.list_(pa.struct([("path", _S), ("autolink", _B)]))),
    ("ignore", _LIST),
    ("linking", pa.struct([("exclude", _LIST), ("autolink_field", _S), ("link_style", _S), ("reference_style_threshold", pa.int32())])),
    ("checks", pa.struct([("broken_links", _S), ("unmanaged_broken_links", _S), ("orphan_pages", _S), ("index_coverage", _S)])),
    ("rules", pa.list_(pa.struct(_RULE))),
]


def row(c: WikiConfig) -> dict:
    """Settings as a row of ``FIELDS``."""
    rules = []
    for r in c.rules:
        own = {name: getattr(r, name, None) for name, _ in _RULE}
        own |= {"when_field": r.when.field if r.when else None, "when_value": r.when.value if r.when else None}
        rules.append({k: list(v) if isinstance(v, tuple) else v for k, v in own.items()})
    linking = vars(c.linking) | {"exclude": sorted(c.linking.exclude)}
    return {"index": c.index, "directories": [vars(d) for d in c.directories], "ignore": list(c.ignore.effective()), "linking": linking, "checks": vars(c.checks), "rules": rules}


def settings(texts: DataFrame) -> DataFrame:
    """``texts`` (source, has_wiki, ...) with the fields of their settings, or the error that they have.

    A NULL source is a wiki without a settings file: its layout tells.  Errors
    are rows, so one bad file does not stop the others.
    """
    schema = StructType(list(texts.schema.fields))
    for name, kind in FIELDS:
        schema = schema.add(name, from_arrow_type(kind))
    source, has_wiki = texts.columns.index("source"), texts.columns.index("has_wiki")

    def one(text: str | None, wiki: bool) -> dict:
        try:
            return row(config.parse(text) if text is not None else WikiConfig(directories=(Directory("wiki" if wiki else "."),)))
        except ConfigError as e:
            return {"error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t, bool(w)) for t, w in zip(batch.column(source).to_pylist(), batch.column(has_wiki).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r.get(n) for r in rows], k) for n, k in FIELDS)], [*batch.schema.names, *(n for n, _ in FIELDS)])

    return texts.mapInArrow(run, schema)
