"""Writing files back: moves first, then new contents, then generated settings."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from . import folders, tree


class SinkError(RuntimeError):
    """A file that can't be written."""


def write_file(root: Path, rel_path: str, content: str) -> None:
    folders.LocalFolder(str(root)).write(rel_path, content.encode("utf-8"))


def rename_file(root: Path, old: str, new: str) -> None:
    if (root / new).exists():
        raise SinkError(f"{new} exists already")
    folders.LocalFolder(str(root)).move(old, new)


def apply(root: Path | str, moves: DataFrame, rewritten: DataFrame) -> None:
    """Apply moves (old, new), then contents (rel_path, source) at the new paths.

    Executors write the contents beside the tree; nothing in it changes before
    all of them are there.
    """
    try:
        tree.write(str(root), rewritten, [(r.old, r.new) for r in moves.distinct().orderBy("old").collect()])
    except PySparkException as e:
        raise SinkError(f"nothing written below {root}: {e}") from e


def write_config(root: Path, text: str, force: bool = False) -> Path:
    path = root / "wiki.toml"
    if path.exists() and not force:
        raise SinkError(f"{path} exists; use --force to replace it")
    path.write_text(text, encoding="utf-8")
    return path
