"""Folders that workers list, read and write: local ones, and those that Arrow's file systems open."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlsplit


@dataclass(frozen=True)
class Entry:
    name: str
    is_dir: bool
    is_file: bool


class LocalFolder:
    """A folder of the machine, or one that is mounted alike on all machines."""

    def __init__(self, top: str):
        self.top = top

    def _at(self, rel_path: str) -> str:
        return os.path.join(self.top, rel_path) if rel_path else self.top

    def entries(self, rel_path: str) -> Iterator[Entry]:
        """What lies directly in a folder; links to folders are neither folders nor files."""
        with os.scandir(self._at(rel_path)) as found:
            for e in found:
                is_dir = e.is_dir(follow_symlinks=False)
                yield Entry(e.name, is_dir, not is_dir and e.is_file())

    def is_dir(self, rel_path: str) -> bool:
        return os.path.isdir(self._at(rel_path))

    def is_file(self, rel_path: str) -> bool:
        return os.path.isfile(self._at(rel_path))

    def read(self, rel_path: str) -> bytes:
        return Path(self._at(rel_path)).read_bytes()

    def write(self, rel_path: str, content: bytes) -> None:
        path = self._at(rel_path)
        try:
            f = open(path, "wb")
        except FileNotFoundError:  # the folder is made when the first file needs it
            os.makedirs(os.path.dirname(path), exist_ok=True)
            f = open(path, "wb")
        with f:
            f.write(content)

    def move(self, old: str, new: str) -> None:
        """Rename a file, over another one if need be."""
        source, target = self._at(old), self._at(new)
        try:
            os.replace(source, target)
        except FileNotFoundError:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(source, target)

    def drop(self, rel_path: str) -> None:
        shutil.rmtree(self._at(rel_path), ignore_errors=True)


class ArrowFolder:
    """A folder of a store that ``pyarrow.fs`` opens by URI: hdfs, s3, gs, abfs."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self._fs, self.top = fs.FileSystem.from_uri(uri)

    def _at(self, rel_path: str) -> str:
        return f"{self.top.rstrip('/')}/{rel_path}" if rel_path else self.top

    def _type(self, rel_path: str):
        return self._fs.get_file_info(self._at(rel_path)).type

    def entries(self, rel_path: str) -> Iterator[Entry]:
        from pyarrow import fs

        for info in self._fs.get_file_info(fs.FileSelector(self._at(rel_path))):
            yield Entry(info.base_name, info.type == fs.FileType.Directory, info.type == fs.FileType.File)

    def is_dir(self, rel_path: str) -> bool:
        from pyarrow import fs

        return self._type(rel_path) == fs.FileType.Directory

    def is_file(self, rel_path: str) -> bool:
        from pyarrow import fs

        return self._type(rel_path) == fs.FileType.File

    def read(self, rel_path: str) -> bytes:
        with self._fs.open_input_file(self._at(rel_path)) as f:
            return f.read()

    def write(self, rel_path: str, content: bytes) -> None:
        self._fs.create_dir(self._at(rel_path).rpartition("/")[0], recursive=True)
        with self._fs.open_output_stream(self._at(rel_path)) as f:
            f.write(content)

    def move(self, old: str, new: str) -> None:
        self._fs.create_dir(self._at(new).rpartition("/")[0], recursive=True)
        if self.is_file(new):
            self._fs.delete_file(self._at(new))
        self._fs.move(self._at(old), self._at(new))

    def drop(self, rel_path: str) -> None:
        if self.is_dir(rel_path):
            self._fs.delete_dir(self._at(rel_path))


def opened(root: str) -> LocalFolder | ArrowFolder:
    """The folder at a path or URI; ``ValueError`` for a store that workers can't open."""
    if "://" not in root and not root.startswith("file:"):
        return LocalFolder(root)
    parts = urlsplit(root)
    if parts.scheme == "file":
        return LocalFolder(unquote(parts.path))
    try:
        return ArrowFolder(root)
    except Exception as e:
        raise ValueError(f"no file system of the workers opens {root}: {e}") from e
