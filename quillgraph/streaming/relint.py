"""Linting files again as they change.

A stream of (rel_path, source) rows, such as a directory of exported pages, is
checked batch by batch with the rules that look at one page at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lint, parse, resolve
from ..sources.config import WikiConfig

#: Rules whose findings depend on the page alone.
LOCAL = ("required-sections", "required-frontmatter")


def page_findings(files: DataFrame, config: WikiConfig) -> DataFrame:
    """Findings of the local rules; works on static and on streaming files."""
    pages = resolve.categorised(parse.parse_documents(files, ("frontmatter", "headings")), config)
    parts = [lint.RULES[r.check][0](pages, r) for r in config.rules if r.check in LOCAL and r.severity != "off"]
    if not parts:
        return pages.select(*[F.lit(None).cast("string").alias(c) for c in lint.COLUMNS]).where("false")
    return reduce(DataFrame.unionByName, parts)


def relint(files: DataFrame, config: WikiConfig, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the findings of each batch, with its number, to Parquet.

    A batch that is run again replaces its own folder, so none is told twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        page_findings(batch, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
