"""Wiki roots as rows: found for many paths at once, from a table of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .above import folders_above, met
from .config import FILE_NAME

INDEX = "index.md"
WIKI = "wiki"


def marked(paths: DataFrame) -> DataFrame:
    """(folder, has_settings, has_index, has_wiki) of the folders that hold settings, an index or a ``wiki`` folder.

    ``paths``: path, of all files.  One pass; each file gives a row at most for
    what it is, and one for each ``wiki`` folder that it lies in.
    """
    name, parts = F.substring_index("path", "/", -1), F.split("path", "/")
    own = paths.where(name.isin(FILE_NAME, INDEX)).select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), name.alias("what"))
    inside = F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.get(parts, k - 1) == WIKI)
    deep = paths.where(F.contains(F.concat(F.lit("/"), "path"), F.lit(f"/{WIKI}/"))).withColumn("k", F.explode(inside))
    wikis = deep.select(F.expr("array_join(slice(split(path, '/'), 1, k - 1), '/')").alias("folder"), F.lit(WIKI).alias("what"))
    has = {"has_settings": FILE_NAME, "has_index": INDEX, "has_wiki": WIKI}
    return own.unionByName(wikis).groupBy("folder").agg(*[F.bool_or(F.col("what") == what).alias(c) for c, what in has.items()])


def discovered(starts: DataFrame, paths: DataFrame) -> DataFrame:
    """``starts`` (start, ...) with root and found_by, of the nearest folder from the start up; NULL if there is none.

    A start is a file, or a folder written with a slash at its end.  Settings
    or an index make a root; '' is the top.
    """
    marks = marked(paths).where("has_settings OR has_index")
    by = F.when(F.col("has_settings"), FILE_NAME).when(F.col("has_wiki"), f"{INDEX} and {WIKI}").otherwise(INDEX)
    one = starts.select("start").distinct()
    above = one.select("start", F.explode(folders_above("start")).alias("folder"))
    found = met(above, marks.select("folder", by.alias("found_by")), one.count())
    depth = F.expr("if(folder = '', 0, size(split(folder, '/')))")
    nearest = found.groupBy("start").agg(F.max_by(F.struct(F.col("folder").alias("root"), "found_by"), depth).alias("near"))
    return starts.join(nearest.select("start", "near.root", "near.found_by"), "start", "left")


def explicit(folders: DataFrame, paths: DataFrame) -> DataFrame:
    """``folders`` (folder, ...) with is_root: whether a folder that was named will do.  Here a ``wiki`` folder alone does."""
    return folders.join(marked(paths).select("folder", F.lit(True).alias("there")), "folder", "left").withColumn("is_root", F.coalesce("there", F.lit(False))).drop("there")
