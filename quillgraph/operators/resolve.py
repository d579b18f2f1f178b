"""Pages, names and the resolution of links.

A page is managed if a configured folder holds it and it is not the index.
Managed pages and the index have names; aliases are further names.  Every
scanned file can be reached by its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.config import WikiConfig
from ..sources.shared import stored


def folder_of(path: Column | str, config: WikiConfig) -> Column:
    """The most specific configured folder of a path; NULL if none holds it.

    The path's own folders, deepest first, are looked up in the set of the
    configured ones: one look per level, however many are configured.
    """
    named = sorted({d.path for d in config.directories})
    parts = F.split(path, "/")
    deepest_first = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))
    found = F.get(F.filter(deepest_first, lambda x: x.isin(*named)), F.lit(0)) if named else F.lit(None).cast("string")
    return F.coalesce(found, F.lit(".")) if "." in named else found


def categorised(files: DataFrame, config: WikiConfig) -> DataFrame:
    """``files`` with page_id, stem, folder, is_index and is_managed."""
    index = F.col("rel_path") == F.lit(config.index) if config.index else F.lit(False)
    out = files.withColumn("page_id", S.page_id("rel_path")).withColumn("stem", S.stem("rel_path"))
    return out.withColumn("folder", folder_of("rel_path", config)).withColumn("is_index", index).withColumn("is_managed", ~F.col("is_index") & F.col("folder").isNotNull())


def category(config: WikiConfig) -> Column:
    return F.when(F.col("is_index"), "index").when(F.col("is_managed"), "managed").otherwise("unmanaged")


def targets(pages: DataFrame) -> DataFrame:
    """Named pages: page_id, rel_path, stem."""
    return pages.where("is_managed OR is_index").select("page_id", "rel_path", "stem")


def aliases(pages: DataFrame) -> DataFrame:
    """alias, page_id of named pages; empty and self aliases do not count."""
    own = pages.where("is_managed OR is_index").select("page_id", F.explode(F.element_at("fm_lists", "aliases")).alias("alias"))
    return own.select(S.ascii_lower("alias").alias("alias"), "page_id").where("alias <> '' AND alias <> page_id").distinct()


def names(pages: DataFrame) -> DataFrame:
    """name -> page_id, rel_path, stem, by own names and aliases."""
    named = targets(pages)
    extra = aliases(pages).join(named, "page_id").select(F.col("alias").alias("name"), "page_id", "rel_path", "stem")
    return named.select(F.col("page_id").alias("name"), "page_id", "rel_path", "stem").unionByName(extra)


def name_conflicts(pages: DataFrame) -> DataFrame:
    """name, kind, paths: names that more than one page lays claim to."""
    own = targets(pages).select(F.col("page_id").alias("name"), "rel_path", F.lit(0).alias("by_alias"))
    extra = aliases(pages).join(targets(pages), "page_id").select(F.col("alias").alias("name"), "rel_path", F.lit(1).alias("by_alias"))
    grouped = own.unionByName(extra).groupBy("name").agg(F.countDistinct("rel_path").alias("n"), F.min("by_alias").alias("least"), F.max("by_alias").alias("most"), F.array_sort(F.collect_set("rel_path")).alias("paths"))
    kind = F.when(F.col("most") == 0, "duplicate-page").when(F.col("least") == 0, "alias-is-page").otherwise("duplicate-alias")
    return grouped.where("n > 1").select("name", kind.alias("kind"), "paths")


#: A key that one link in so many has is met by a broadcast; there are no more such keys than that.
WIDE = 1_000


def resolved(links: DataFrame, names: DataFrame, pages: DataFrame, even: bool = False) -> DataFrame:
    """``links`` with target_id and target_path, NULL where nothing is found.

    Names and paths are looked up by one join on a tagged key.  An empty name
    or path is the page itself.  ``even`` is for links that are cheap to read
    twice: they are counted by key first, and those to a page that a large
    share of all links leads to stay where they are and meet it by a broadcast.
    """
    table = names.select(F.concat(F.lit("n:"), "name").alias("key"), F.col("page_id").alias("found_id"), F.col("rel_path").alias("found_path"))
    table = table.unionByName(pages.select(F.concat(F.lit("p:"), "rel_path").alias("key"), F.col("page_id").alias("found_id"), F.col("rel_path").alias("found_path")))
    key = F.when(F.col("target") == "", F.concat(F.lit("p:"), "rel_path")).when(F.col("target_kind") == "name", F.concat(F.lit("n:"), "target")).otherwise(F.concat(F.lit("p:"), S.resolved_path("rel_path", "target")))
    keyed = links.withColumn("key", key)
    out = _evenly(keyed, table) if even else keyed.join(table, "key", "left")
    return out.withColumnsRenamed({"found_id": "target_id", "found_path": "target_path"}).withColumn("source_id", S.page_id("rel_path")).drop("key")


def _evenly(keyed: DataFrame, table: DataFrame) -> DataFrame:
    """The left join of ``keyed`` and ``table`` on key, without bringing the rows of a frequent key together."""
    load = stored(keyed.groupBy("key").agg(F.count("*").alias("n")), "keys")
    total = load.agg(F.sum("n")).first()[0] or 0
    wide = F.broadcast(load.where(F.col("key").isNotNull() & (F.col("n") > total // WIDE)).select("key"))
    often = keyed.join(wide, "key", "left_semi").join(F.broadcast(table.join(wide, "key", "left_semi")), "key", "left")
    none = keyed.where("key IS NULL").withColumns({"found_id": F.lit(None).cast("string"), "found_path": F.lit(None).cast("string")})
    rest = keyed.where("key IS NOT NULL").join(wide, "key", "left_anti").join(table, "key", "left")
    return often.unionByName(rest).unionByName(none)


def fragments(pages: DataFrame) -> DataFrame:
    """target_path, frag_key: what link fragments may point at."""
    h = pages.select("rel_path", F.explode("headings").alias("h"))
    by_text = h.select("rel_path", F.concat(F.lit("t:"), S.ascii_lower("h.text")).alias("frag_key"))
    by_anchor = h.select("rel_path", F.concat(F.lit("a:"), "h.anchor").alias("frag_key"))
    blocks = pages.select("rel_path", F.explode("block_ids").alias("b")).select("rel_path", F.concat(F.lit("b:"), "b").alias("frag_key"))
    return by_text.union(by_anchor).union(blocks).distinct().withColumnRenamed("rel_path", "target_path")


def fragment_key() -> Column:
    text = F.when(F.col("style") == "obsidian", F.concat(F.lit("t:"), S.ascii_lower("frag"))).otherwise(F.concat(F.lit("a:"), "frag"))
    return F.when(F.col("frag_kind") == "block", F.concat(F.lit("b:"), "frag")).when(F.col("frag_kind") == "heading", text)


def broken(resolved_links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links that lead nowhere, with reason_kind (page, heading, block) and reason_value."""
    known = fragments(pages).withColumn("frag_found", F.lit(True))
    checked = resolved_links.withColumn("frag_key", fragment_key()).join(known, ["target_path", "frag_key"], "left")
    lost = F.col("target_path").isNull() | F.col("frag_key").isNotNull() & F.col("frag_found").isNull()
    kind = F.when(F.col("target_path").isNull(), "page").otherwise(F.col("frag_kind"))
    return checked.where(lost).withColumn("reason_kind", kind).withColumn("reason_value", F.when(kind != "page", F.col("frag"))).drop("frag_found", "frag_key")
