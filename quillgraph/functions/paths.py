"""Paths and URL paths as plain Python, for code that runs per document.

``functions.scalars`` has the same rules as column expressions.
"""

from __future__ import annotations

import re

_BAD_PERCENT = re.compile(r"%(?![0-9A-Fa-f]{2})")
_PERCENT = re.compile(rb"%([0-9A-Fa-f]{2})")


def decode(path: str) -> str | None:
    """Percent escapes resolved; None if one is malformed or the bytes are not UTF-8."""
    if "%" not in path:
        return path
    if _BAD_PERCENT.search(path):
        return None
    try:
        return _PERCENT.sub(lambda m: bytes([int(m[1], 16)]), path.encode()).decode()
    except UnicodeDecodeError:
        return None


#: Characters that an encoded path may not hold, the escape sign first.
ENCODED = (("%", "%25"), (" ", "%20"), ("#", "%23"), ("?", "%3F"), ("<", "%3C"), (">", "%3E"), ('"', "%22"))


def encode(path: str) -> str:
    for plain, code in ENCODED:
        path = path.replace(plain, code)
    return path


def normalize(path: str) -> str:
    """Without ``.`` and ``..``; the root is its own parent."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def parent(path: str) -> str:
    return path.rpartition("/")[0]


def join(folder: str, path: str) -> str:
    return f"{folder}/{path}" if folder else path


def relative(folder: str, target: str) -> str:
    """The way from ``folder`` to ``target``."""
    a, b = [x for x in folder.split("/") if x], [x for x in target.split("/") if x]
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return "/".join([".."] * (len(a) - k) + b[k:])


def has_md_extension(path: str) -> bool:
    name = path.rpartition("/")[2]
    return name.endswith(".md") and name != ".md"


def is_relative_md(path: str) -> bool:
    """Whether a link path names a Markdown file by a relative path."""
    plain = decode(path)
    return plain is not None and plain[:1] not in ("/", "\\") and ":" not in plain.partition("/")[0] and has_md_extension(plain)


def stem(path: str) -> str:
    return path.rpartition("/")[2].removesuffix(".md")


def resolve(source: str, link_path: str) -> str | None:
    """The root-relative path that a link in ``source`` points at."""
    plain = decode(link_path)
    if plain is None or plain[:1] in ("/", "\\"):
        return None
    return normalize(join(parent(source), plain))


def in_folder(path: str, folder: str) -> bool:
    """Whether ``path`` lies in ``folder``, component by component; ``.`` holds all."""
    return folder == "." or path == folder or path.startswith(f"{folder}/")
