"""Unlinked mentions of page names in prose.

Names are matched leftmost-longest and without regard to ASCII case.  A match
that is rejected, because it is part of a longer word or names the page itself,
still uses up its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.config import WikiConfig
from ..sources.shared import stored
from . import parse, phrases, resolve


def autolink_pages(pages: DataFrame, config: WikiConfig) -> DataFrame:
    """page_id of the managed pages whose mentions should be links.

    Excluded names are compared as written with the folded id.
    """
    folders = [d.path for d in config.directories if d.autolink]
    out = pages.where("is_managed").where(F.col("folder").isin(*folders))
    if config.linking.exclude:
        out = out.where(~F.col("page_id").isin(*sorted(config.linking.exclude)))
    off = F.coalesce(F.array_contains("fm_false", config.linking.autolink_field), F.lit(False))
    return out.where(~off).select("page_id").distinct()


def mentions(pages: DataFrame, names: DataFrame) -> DataFrame:
    """rel_path, concept, start, end, line, col of each mention.

    ``pages``: rel_path, source, page_id, ranges; ``names``: page_id.  Of all
    occurrences those are chosen that a search from the left for the longest
    names would give, then those that end a word and name another page.
    """
    texts = pages.select("rel_path", "page_id", "source", "ranges")
    found = phrases.chosen(texts, names.select(F.col("page_id").alias("phrase")), fold=True).where("phrase <> page_id")
    return found.select("rel_path", F.col("phrase").alias("concept"), "start", "end", "line", "col")


def counts(files: DataFrame, names: DataFrame, config: WikiConfig) -> DataFrame:
    """concept, n_mentions, n_files of the names that are mentioned in ``files`` (rel_path, source).

    As ``mentions``, but only counted.  Paths that come more than once are
    found first, from the paths alone; the other files need not be told apart.
    """
    again = stored(files.groupBy("rel_path").count().where("count > 1").select("rel_path"), "repeated")
    flagged = files.join(again.withColumn("repeated", F.lit(True)), "rel_path", "left")
    pages = resolve.categorised(parse.parse_documents(flagged, ("ranges",)), config)
    texts = pages.select("rel_path", F.col("page_id").alias("own"), "repeated", "source", "ranges")
    found = phrases.counted(texts, names.select(F.col("page_id").alias("phrase")), fold=True)
    return found.select(F.col("phrase").alias("concept"), F.col("n").alias("n_mentions"), F.col("n_texts").alias("n_files"))
