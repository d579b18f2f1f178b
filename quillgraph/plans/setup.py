"""Settings proposed from what a corpus looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import inventory


def required_everywhere(pages: DataFrame) -> DataFrame:
    """dir, fields, sections that every file of a folder has (occurrences count for sections)."""
    sizes = inventory.directories(pages)
    fields = inventory.frontmatter_fields(pages).drop("n_files", "pct").join(inventory.frontmatter_fields(pages).select("dir", "field", F.col("n_files").alias("n")), ["dir", "field"]).join(sizes, "dir").where("n = n_files")
    sections = inventory.section_headings(pages).join(sizes, "dir").where("n = n_files")
    f = fields.groupBy("dir").agg(F.array_sort(F.collect_list("field")).alias("fields"))
    s = sections.groupBy("dir").agg(F.array_sort(F.collect_list("heading")).alias("sections"))
    return sizes.join(f, "dir", "left").join(s, "dir", "left").select("dir", "n_files", "fields", "sections")


def content_dirs(dirs: DataFrame, has_wiki: bool) -> DataFrame:
    return dirs.where(S.in_folder("dir", "wiki")) if has_wiki else dirs


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, S.toml_string), ", "), F.lit("]"))


def _rule(check: str, **keys: Column) -> Column:
    lines = [F.concat(F.lit(f'[[rules]]\ncheck = "{check}"\n'))]
    lines += [F.concat(F.lit(f"{key} = "), value, F.lit("\n")) for key, value in keys.items()]
    return F.concat(*lines, F.lit('severity = "error"\n\n'))


def blocks(pages: DataFrame, has_wiki: bool) -> DataFrame:
    """(place, text): the parts of the proposal and where they stand.

    Required fields and sections by folder, then mirrors.  Of two folders with
    the same names the content folder comes first; a pair of content folders is
    no mirror.
    """
    dirs = content_dirs(required_everywhere(pages), has_wiki)
    one = F.array("dir")
    fields = dirs.where("size(fields) > 0").select(F.struct(F.lit(1).alias("part"), F.col("dir").alias("a"), F.lit("1").alias("b")).alias("place"), _rule("required-frontmatter", dirs=_listed(one), fields=_listed(F.col("fields"))).alias("text"))
    sections = dirs.where("size(sections) > 0").select(F.struct(F.lit(1).alias("part"), F.col("dir").alias("a"), F.lit("2").alias("b")).alias("place"), _rule("required-sections", dirs=_listed(one), sections=_listed(F.col("sections"))).alias("text"))
    content = F.lit(True) if not has_wiki else S.in_folder("left_dir", "wiki")
    other = F.lit(True) if not has_wiki else S.in_folder("right_dir", "wiki")
    pairs = inventory.mirror_candidates(pages).where(~(content & other))
    left, right = F.when(content, F.col("left_dir")).otherwise(F.col("right_dir")), F.when(content, F.col("right_dir")).otherwise(F.col("left_dir"))
    mirrors = pairs.select(F.struct(F.lit(2).alias("part"), F.col("left_dir").alias("a"), F.col("right_dir").alias("b")).alias("place"), _rule("mirror-parity", left=S.toml_string(left), right=S.toml_string(right)).alias("text"))
    index = inventory.index_refs(pages).where("path <> 'index.md'")
    named = index.select(F.struct(F.lit(0).alias("part"), F.lit("").alias("a"), F.lit("").alias("b")).alias("place"), F.concat(F.lit("index = "), S.toml_string("path"), F.lit("\n\n")).alias("text"))
    return named.unionByName(fields).unionByName(sections).unionByName(mirrors)


def proposal_text(pages: DataFrame, has_wiki: bool) -> DataFrame:
    """(text): a configuration file that the corpus as it is would pass, as one row.

    It has a few lines per folder with something in common; sources are not in it.
    """
    rows = blocks(pages, has_wiki).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("text"))


def proposal(pages: DataFrame) -> str:
    has_wiki = pages.where(S.in_folder("rel_path", "wiki")).first() is not None
    return proposal_text(pages, has_wiki).first().text
