"""Structure statistics: what each folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S

#: Files that may serve as the index, the first found wins.
INDEX_FILES = ("index.md", "README.md", "_index.md")


def _in_dirs(pages: DataFrame) -> DataFrame:
    return pages.withColumn("dir", S.directory("rel_path"))


def directories(pages: DataFrame) -> DataFrame:
    """dir, n_files by exact folder."""
    return _in_dirs(pages).groupBy("dir").agg(F.count("*").alias("n_files"))


def frontmatter_fields(pages: DataFrame) -> DataFrame:
    """dir, field, n_files, pct; the commonest first."""
    fields = _in_dirs(pages).select("dir", F.explode("fm_keys").alias("field")).groupBy("dir", "field").agg(F.count("*").alias("n"))
    sizes = directories(pages)
    out = fields.join(sizes, "dir").select("dir", "field", F.col("n").alias("n_files"), S.percent("n", sizes["n_files"]).alias("pct"))
    return out.orderBy("dir", F.desc("n_files"), "field")


def section_headings(pages: DataFrame) -> DataFrame:
    """dir, heading, n of second-level headings; occurrences, not files."""
    h = _in_dirs(pages).select("dir", F.explode("headings").alias("h")).where("h.level = 2")
    return h.groupBy("dir", F.col("h.text").alias("heading")).agg(F.count("*").alias("n"))


def top_headings(pages: DataFrame, k: int = 10) -> DataFrame:
    """The k commonest second-level headings of each folder, and how many more there are."""
    w = Window.partitionBy("dir")
    ranked = section_headings(pages).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "heading"))).withColumn("n_more", F.greatest(F.lit(0), F.count("*").over(w) - k))
    sizes = directories(pages)
    return ranked.where(F.col("rank") <= k).join(sizes, "dir").select("dir", "rank", "heading", "n", S.percent("n", "n_files").alias("pct"), "n_more").orderBy("dir", "rank")


def mirror_candidates(pages: DataFrame) -> DataFrame:
    """left_dir, right_dir, n_files: pairs of folders that hold the same stems.

    Folders are compared by size and two hashes of their stem sets; only those
    that agree in all are paired.
    """
    stems = _in_dirs(pages).select("dir", S.stem("rel_path").alias("stem")).distinct()
    sets = stems.groupBy("dir").agg(F.count("*").alias("n_files"), F.sum(F.xxhash64("stem").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64(F.reverse("stem"), "stem")).alias("h2"))
    key = ["n_files", "h1", "h2"]
    left, right = sets.withColumnRenamed("dir", "left_dir"), sets.withColumnRenamed("dir", "right_dir")
    return left.join(right, key).where("left_dir < right_dir").select("left_dir", "right_dir", "n_files").orderBy("left_dir", "right_dir")


def index_refs(pages: DataFrame) -> DataFrame:
    """path, n_refs: the index file and its distinct link targets as written, fragments aside."""
    place = F.array_position(F.array(*map(F.lit, INDEX_FILES)), F.col("rel_path"))
    found = pages.where(F.col("rel_path").isin(*INDEX_FILES)).select("rel_path", "links", place.alias("place")).orderBy("place").limit(1)
    targets = F.array_distinct(F.transform("links", lambda x: F.concat_ws(":", x["target_kind"], x["target"])))
    return found.select(F.col("rel_path").alias("path"), F.size(targets).cast("long").alias("n_refs"))
