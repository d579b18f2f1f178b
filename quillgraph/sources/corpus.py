"""Corpora: Markdown files as rows (rel_path, source)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import above, folders, ignore, tree
from .config import FILE_NAME, Directory, Ignore, WikiConfig, parse
from .shared import stored

SCHEMA = tree.SCHEMA


class CorpusError(ValueError):
    """A corpus that can't be found or read."""


def discover(start: Path) -> Path:
    """The nearest folder, from ``start`` up, that is a wiki."""
    for folder in (start.resolve(), *start.resolve().parents):
        index = (folder / "index.md").is_file()
        if (folder / FILE_NAME).is_file() or index:
            return folder
    raise CorpusError(f"no wiki at or above {start}")


def explicit_root(path: Path) -> Path:
    """A given folder, if it is a wiki."""
    folder = path.resolve()
    if (folder / FILE_NAME).exists() or (folder / "index.md").exists() or (folder / "wiki").exists():
        return folder
    raise CorpusError(f"{path} is not a wiki: it has no {FILE_NAME}, index.md or wiki folder")


def resolve_root(root: str | Path | None) -> Path:
    return explicit_root(Path(root)) if root else discover(Path.cwd())


def walk(root: Path, rules: Ignore, start: str = "") -> list[str]:
    """Relative paths of the Markdown files below ``root/start``, by this process alone.

    Ignored folders are not entered, so what lies in them is never listed.
    Hidden files count.
    """
    pruned = tree.Pruned(folders.LocalFolder(str(root)), rules.effective())
    found = pruned.files(start, pruned.rules_above(start)) if pruned.starts(start) else ()
    return sorted(found, key=lambda p: p.split("/"))


def read_corpus(spark: SparkSession, root: Path | str, rules: Ignore | None = None, start: str = "") -> DataFrame:
    """The Markdown files of a folder, by path or URI, listed and read by the executors.

    Where no file system of the workers opens the URI, Spark's own reader does.
    """
    try:
        folders.opened(str(root))
    except ValueError:
        return SharedFolder(spark, str(root)).read(rules, start)
    return tree.read(spark, str(root), rules or Ignore(), start)


def read_file(spark: SparkSession, root: str, rel_path: str) -> DataFrame | None:
    """One file below a root, though a scan may leave it out; None where only a scan can reach the root."""
    try:
        folder = folders.opened(root)
    except ValueError:
        return None
    if not folder.is_file(rel_path):
        return spark.createDataFrame([], SCHEMA)
    return spark.createDataFrame([(rel_path, folder.read(rel_path).decode("utf-8"))], SCHEMA)


def from_table(rows: DataFrame, path: str, text: str) -> DataFrame:
    """A corpus from any table with a path and a text column."""
    return rows.select(F.col(path).cast("string").alias("rel_path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("source"))


def markdown_files(files: DataFrame) -> DataFrame:
    """The rows whose path ends in exactly ``.md`` after a name."""
    return files.where(F.col("rel_path").rlike(r"[^/][.]md$"))


def without_ignored(files: DataFrame, rules: Ignore, nested: DataFrame | None = None) -> DataFrame:
    """The files that ignore patterns leave; for corpora that come from tables.

    ``nested``: the rules of ignore files (``ignore.rule_rows``).
    """
    left = files.where(~ignore.ignored("rel_path", ignore.Matcher(rules.effective())))
    return left if nested is None else ignore.left_by_rules(left, nested)


class SharedFolder:
    """A folder that Spark's file systems can open, by its URI, and perhaps they alone."""

    def __init__(self, spark: SparkSession, uri: str):
        self._spark, self._jvm = spark, spark._jvm
        top = self._path(uri.rstrip("/"))
        self._fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        self.uri = self._fs.makeQualified(top).toString()

    def _path(self, uri: str):
        return self._jvm.org.apache.hadoop.fs.Path(uri)

    def exists(self, rel_path: str) -> bool:
        return self._fs.exists(self._path(f"{self.uri}/{rel_path}"))

    def text(self, rel_path: str) -> str | None:
        """A small file, read on the driver."""
        if not self.exists(rel_path):
            return None
        stream = self._fs.open(self._path(f"{self.uri}/{rel_path}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def config(self) -> WikiConfig:
        """The settings in the folder, or what its layout tells."""
        text = self.text(FILE_NAME)
        if text is not None:
            return parse(text)
        return WikiConfig(directories=(Directory("wiki" if self.exists("wiki") else "."),))

    def read(self, rules: Ignore | None = None, start: str = "") -> DataFrame:
        """The Markdown files below the folder, listed and read by Spark.

        The driver sees folders, not files: it looks for ignore files in each
        and sends their rules as rows, applied before any text is decoded.
        As everywhere in Spark, names that begin with a dot or an underscore
        are not listed.  A file that is not UTF-8 fails the read.
        """
        if start and not self.exists(start):
            return self._spark.createDataFrame([], SCHEMA)
        below = f"{self.uri}/{start}" if start else self.uri
        found = self._spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(below)
        path = F.substring("path", F.lit(len(self.uri) + 2), F.length("path"))
        files = markdown_files(found.select(path.alias("rel_path"), "content"))
        left = without_ignored(files, rules or Ignore(), self._nested(files))
        return left.select("rel_path", F.decode("content", "UTF-8").alias("source"))

    def _nested(self, files: DataFrame) -> DataFrame | None:
        """The rules of the ignore files in the folders that hold files."""
        holding = files.select(F.explode(above.folders_above("rel_path")).alias("folder")).distinct()
        found = []
        for row in holding.toLocalIterator():
            for name in ignore.FILES:
                path = f"{row.folder}/{name}" if row.folder else name
                text = self.text(path)
                if text is not None:
                    found.append((path, text))
        return stored(ignore.rule_rows(self._spark.createDataFrame(found, SCHEMA)), "ignore") if found else None
