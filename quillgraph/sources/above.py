"""Paths and the folders above them, joined to tables with one row or few per folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: A folder above one path in so many is met by a broadcast; on each level there are no more of them than that.
WIDE = 1_000


def folders_above(path: Column | str) -> Column:
    """The folders that hold a file: '' first, then from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def met(above: DataFrame, table: DataFrame, n_paths: int) -> DataFrame:
    """The inner join of ``above`` (folder, ...) and ``table`` (folder, ...) on the folder.

    ``above`` has a row for every folder above each of ``n_paths`` paths.  The
    top and other folders above a large share of them meet their rows by a
    broadcast, so no task gets them all; the others, of which none is above
    more than one path in ``WIDE``, are joined by Spark's own choice.
    """
    load = above.join(table.select("folder").distinct(), "folder", "left_semi").groupBy("folder").agg(F.count("*").alias("n"))
    wide = F.broadcast(stored(load.where(F.col("n") > n_paths // WIDE).select("folder"), "wide"))
    return above.join(F.broadcast(table.join(wide, "folder")), "folder").unionByName(above.join(table.join(wide, "folder", "left_anti"), "folder"))
