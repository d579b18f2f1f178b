"""A tree of Markdown files as a Spark data source, to read and to write.

Reading gives one row per file (rel_path).  The planner opens folders from the
top, level by level, until there are enough to keep the executors busy, and
hands out folders, never files: some to be listed alone, the rest with all that
lies below.  An ignored folder is neither listed by the planner nor by a task.

Writing takes rows (rel_path, source).  Tasks put contents into a staging
folder beside the tree, each attempt into a folder of its own with a list of
what it holds.  The commit first checks and makes the moves, then puts the
staged files in their places; an abort drops the staging folder, and the tree
is as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import ignore
from .config import Ignore
from .folders import ArrowFolder, LocalFolder, opened

NAME = "markdown_tree"
SCHEMA = "rel_path string, source string"
#: Folders that the planner hands out, about; it opens at most so many on a level.
FANOUT = 256
#: Paths in a batch.
BATCH = 4096
#: Staging folders begin so; they are not part of a tree.
STAGING = ".quillgraph-staging-"
#: Ignore files of a folder, those that win first.
IGNORE_FILES = (".ignore", ".gitignore")


class TreeError(ValueError):
    """A tree that can't be read or written."""


class Pruned:
    """The walk of a tree that ignore rules leave.

    The configured patterns decide first, then the nearest ignore file that
    speaks of a path.
    """

    def __init__(self, folder: LocalFolder | ArrowFolder, patterns: Sequence[str]):
        self.folder, self.own = folder, ignore.Matcher(list(patterns))

    def rules(self, rel_path: str, above: tuple) -> tuple:
        """The matchers that hold in a folder: those above, and its own."""
        own = []
        for name in IGNORE_FILES:
            path = f"{rel_path}/{name}" if rel_path else name
            own.append(ignore.from_text(self.folder.read(path).decode("utf-8", "replace"), rel_path) if self.folder.is_file(path) else None)
        return (*above, tuple(own)) if any(own) else above

    def rules_above(self, rel_path: str) -> tuple:
        out, parts = (), rel_path.split("/") if rel_path else []
        for k in range(len(parts)):
            out = self.rules("/".join(parts[:k]), out)
        return out

    def _ignored(self, path: str, is_dir: bool, matchers: tuple) -> bool:
        if self.own.decide(path, is_dir):
            return True
        for kind in range(len(IGNORE_FILES)):
            said = next((d for m in reversed(matchers) if m[kind] and (d := m[kind].decide(path, is_dir)) is not None), None)
            if said is not None:
                return said
        return False

    def open(self, rel_path: str, above: tuple) -> tuple[list[str], list[str], tuple]:
        """(folders, files, matchers) of a folder."""
        matchers = self.rules(rel_path, above)
        folders, files = [], []
        for e in sorted(self.folder.entries(rel_path), key=lambda e: e.name):
            path = f"{rel_path}/{e.name}" if rel_path else e.name
            if e.is_dir and e.name != ".git" and not e.name.startswith(STAGING):
                if not self._ignored(path, True, matchers):
                    folders.append(path)
            elif e.is_file and e.name.endswith(".md") and e.name != ".md" and not self._ignored(path, False, matchers):
                files.append(path)
        return folders, files, matchers

    def files(self, rel_path: str, above: tuple) -> Iterator[str]:
        """All files below a folder; depth first, so only open folders are held."""
        waiting = [(rel_path, above)]
        while waiting:
            path, matchers = waiting.pop()
            folders, files, here = self.open(path, matchers)
            yield from files
            waiting += [(f, here) for f in reversed(folders)]

    def starts(self, start: str) -> bool:
        """Whether there is a folder to start from that no pattern hides."""
        return self.folder.is_dir(start) and not (start and self.own.ignores(f"{start}/x"))


@dataclass
class Folders(InputPartition):
    """Folders to list: alone, or with what is below."""

    paths: list[str]
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.start = options["root"], options.get("start", "")
        self.patterns = json.loads(options.get("patterns", "[]"))
        self.fanout = int(options.get("fanout", FANOUT))

    def _tree(self) -> Pruned:
        return Pruned(opened(self.root), self.patterns)

    def partitions(self) -> list[Folders]:
        tree = self._tree()
        if not tree.starts(self.start):
            return [Folders([], False)]
        level, opened_ones = [(self.start, tree.rules_above(self.start))], []
        while level and len(level) < self.fanout:
            below = []
            for path, above in level:
                folders, _, here = tree.open(path, above)
                below += [(f, here) for f in folders]
                opened_ones.append(path)
            level = below
        out = [Folders(p, False) for p in _cut(opened_ones, self.fanout)]
        return out + [Folders(p, True) for p in _cut([p for p, _ in level], self.fanout)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        tree = self._tree()
        held: list[str] = []
        for path in partition.paths:
            above = tree.rules_above(path)
            for found in tree.files(path, above) if partition.deep else tree.open(path, above)[1]:
                held.append(found)
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["rel_path"])
                    held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["rel_path"])


def _cut(paths: list[str], n: int) -> list[list[str]]:
    """At most n lists of about equal size."""
    return [paths[k::n] for k in range(min(n, len(paths)))]


@dataclass
class Staged(WriterCommitMessage):
    """Where a task has put its files, and its list of them."""

    folder: str
    n_files: int


class TreeWriter(DataSourceArrowWriter):
    """Options: root, staging (a folder in it), moves (JSON list of [old, new])."""

    def __init__(self, options: dict[str, str]):
        self.root, self.staging = options["root"], options["staging"]
        self.moves = [tuple(m) for m in json.loads(options.get("moves", "[]"))]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        folder, own, listed = opened(self.root), f"{self.staging}/{uuid.uuid4().hex}", []
        for batch in iterator:
            for path, source in zip(batch.column("rel_path").to_pylist(), batch.column("source"), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise TreeError(f"{path} is not below the root")
                folder.write(f"{own}/{len(listed)}", (source.as_py() or "").encode("utf-8"))
                listed.append(path)
        folder.write(f"{own}/files.json", json.dumps(listed).encode())
        return Staged(own, len(listed))

    def commit(self, messages: list[Staged | None]) -> None:
        folder = opened(self.root)
        try:
            for old, new in self.moves:
                if not folder.is_file(old):
                    raise TreeError(f"{old} is not there")
                if folder.is_file(new) or folder.is_dir(new):
                    raise TreeError(f"{new} exists already")
        except TreeError:
            folder.drop(self.staging)
            raise
        for old, new in self.moves:
            folder.move(old, new)
        moved, n = dict(self.moves), 0
        for message in messages:
            if message is None:
                continue
            for k, path in enumerate(json.loads(folder.read(f"{message.folder}/files.json"))):
                folder.move(f"{message.folder}/{k}", moved.get(path, path))
                n += 1
        folder.drop(self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        opened(self.root).drop(self.staging)


class MarkdownTree(DataSource):
    """``spark.read.format("markdown_tree").option("root", ...)``; options start, patterns (JSON), fanout."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "rel_path string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(dict(self.options))


def paths(spark: SparkSession, root: str, rules: Ignore, start: str = "", fanout: int = FANOUT) -> DataFrame:
    """(rel_path) of the Markdown files below ``root/start`` that ignore rules leave."""
    spark.dataSource.register(MarkdownTree)
    return spark.read.format(NAME).options(root=root, start=start, patterns=json.dumps(list(rules.effective())), fanout=str(fanout)).load()


def read(spark: SparkSession, root: str, rules: Ignore, start: str = "") -> DataFrame:
    """The same files with their sources, dealt out evenly before they are read.

    A file that is not UTF-8 fails the read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = opened(root)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                own = batch.column(0).slice(a, 256)
                texts = []
                for p in own.to_pylist():
                    try:
                        texts.append(folder.read(p).decode("utf-8"))
                    except UnicodeDecodeError as e:
                        raise TreeError(f"{p} is not UTF-8: {e}") from e
                yield pa.RecordBatch.from_arrays([own, pa.array(texts, pa.string())], ["rel_path", "source"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return paths(spark, root, rules, start).repartition(n, F.xxhash64("rel_path")).mapInArrow(run, SCHEMA)


def write(root: str, files: DataFrame, moves: Sequence[tuple[str, str]] = ()) -> None:
    """Make the moves, then put the files (rel_path, source) in place, at the paths that moves give them."""
    files.sparkSession.dataSource.register(MarkdownTree)
    staging = f"{STAGING}{uuid.uuid4().hex}"
    files.select("rel_path", "source").write.format(NAME).mode("append").options(root=root, staging=staging, moves=json.dumps([list(m) for m in moves])).save()
