"""Queries on the link graph.

Edges join page ids: files of one stem are one node, and a link whose fragment
is missing is still an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def edges(resolved: DataFrame) -> DataFrame:
    """source, target, rel_path of each resolved link; repeats are kept."""
    return resolved.where("target_id IS NOT NULL").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "rel_path")


def refs_graph(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").orderBy("source", "target")


def inbound(edges: DataFrame) -> DataFrame:
    """target -> number of distinct files that link to it."""
    return edges.groupBy("target").agg(F.countDistinct("rel_path").alias("n_sources"))


def refs_to(edges: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Files that link to a page, given by name or alias; a name that no page
    has still finds links to files of that stem."""
    wanted = names.sparkSession.range(1).select(S.ascii_lower(F.lit(name)).alias("name"))
    ids = wanted.join(names.select("name", "page_id"), "name", "left").select(F.coalesce("page_id", "name").alias("target"))
    return edges.join(ids, "target", "left_semi").select("rel_path").distinct().orderBy("rel_path")


def refs_from(edges: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Pages that a page links to."""
    wanted = names.sparkSession.range(1).select(S.ascii_lower(F.lit(name)).alias("name"))
    ids = wanted.join(names.select("name", "page_id"), "name", "left").select(F.coalesce("page_id", "name").alias("source"))
    return edges.join(ids, "source", "left_semi").select("target").distinct().orderBy("target")


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Managed pages without an inbound link; a page's own links count."""
    return pages.where("is_managed").select("page_id", "rel_path").join(edges.select(F.col("target").alias("page_id")), "page_id", "left_anti").orderBy("page_id")


def not_in_index(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Managed pages that the index does not link to."""
    listed = resolved.join(pages.where("is_index").select("rel_path"), "rel_path", "left_semi").select(F.col("target_id").alias("page_id"))
    return pages.where("is_managed").select("page_id", "rel_path").join(listed, "page_id", "left_anti").orderBy("page_id")
