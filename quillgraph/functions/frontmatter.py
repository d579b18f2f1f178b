"""YAML frontmatter: where it stands, what it says, how it is changed."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

import yaml


class _Core(yaml.SafeLoader):
    """YAML with the core schema: dates, yes and on are strings."""


_Core.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+.0123456789")),
    ("merge", r"^(?:<<)$", ["<"]),
):
    _Core.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)


def _integer(loader: yaml.SafeLoader, node: yaml.ScalarNode) -> int:
    text = loader.construct_scalar(node)
    return int(text, 0) if text[:2].lower() in ("0x", "0o") else int(text)


def _number(loader: yaml.SafeLoader, node: yaml.ScalarNode) -> float:
    text = loader.construct_scalar(node).lower()
    return float(text.replace(".inf", "inf").replace(".nan", "nan"))


_Core.add_constructor("tag:yaml.org,2002:int", _integer)
_Core.add_constructor("tag:yaml.org,2002:float", _number)


class _Writer(yaml.SafeDumper):
    """Quotes what the core schema would read as something else, and no more."""


_Writer.yaml_implicit_resolvers = _Core.yaml_implicit_resolvers


class FrontmatterError(ValueError):
    """Frontmatter that can't be read or changed."""


@dataclass(frozen=True)
class Frontmatter:
    start: int
    end: int
    data: Any


def split(source: str) -> tuple[str, int] | None:
    """(YAML text, length of the block in characters), or None.

    The block opens with a line of three dashes at the very start and closes
    before the first line that begins with three dashes, whatever follows them.
    """
    m = re.match(r"---(?=\r?\n)", source)
    if not m:
        return None
    close = source.find("\n---", 3)
    if close < 0:
        return None
    end = close + 4
    for newline in ("\n", "\r\n"):
        if source.startswith(newline, end):
            return source[3:close], end + len(newline)
    return source[3:close], end


def load(text: str) -> Any:
    try:
        return yaml.load(text, _Core)  # noqa: S506 - a safe loader
    except (yaml.YAMLError, ValueError) as e:
        raise FrontmatterError(f"{' '.join(str(e).split())} in {text[:80]!r}") from e


def parse(source: str) -> Frontmatter | None:
    """The frontmatter of a document; raises FrontmatterError for bad YAML."""
    found = split(source)
    if found is None:
        return None
    text, end = found
    return Frontmatter(0, len(source[:end].encode()), load(text))


def to_json(value: Any, indent: int | None = None) -> str:
    return json.dumps(value, ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"), default=str)


def strings(value: Any) -> list[str] | None:
    """The string items of a list, or a single string as a list."""
    if isinstance(value, list):
        return [x for x in value if isinstance(x, str)]
    return [value] if isinstance(value, str) else None


def set_field(source: str, name: str, value: str) -> tuple[int, int, str]:
    """The edit (byte range, replacement) that sets a field, creating the block if needed."""
    try:
        new = load(value)
    except FrontmatterError:
        new = value
    found = parse(source)
    data = {} if found is None else found.data
    if not isinstance(data, dict):
        raise FrontmatterError("frontmatter is not a mapping")
    text = yaml.dump({**data, name: new}, Dumper=_Writer, sort_keys=False, allow_unicode=True, default_flow_style=False, width=10**9)
    if found is None:
        return 0, 0, f"---\n{text}---\n\n"
    return found.start, found.end, f"---\n{text}---\n"
