"""Configuration: a TOML file turned into checked, typed settings."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from . import ignore

FILE_NAME = "wiki.toml"
SEVERITIES = ("error", "warn", "off")
STYLES = ("obsidian", "markdown")

#: Fixed list: folders of tools, skipped unless ``ignore.default_patterns`` is false.
DEFAULT_IGNORE = (
    ".agents/",
    ".claude/",
    ".clinerules/",
    ".codex/",
    ".continue/",
    ".cursor/",
    ".gemini/",
    ".github/",
    ".gsd/",
    ".kiro/",
    ".kilocode/",
    ".opencode/",
    ".openhands/",
    ".pi/",
    ".qwen/",
    ".roo/",
    ".windsurf/",
)

#: Fixed value: citations like **GRPO** (2024), matched by file name.
PRESETS = {"bold-method-year": (r"\*\*(?P<id>[A-Za-z][A-Za-z0-9-]+)\*\*\s*\([^)]*\d{4}[^)]*\)", "filename")}


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class Directory:
    path: str
    autolink: bool = True


@dataclass(frozen=True)
class Ignore:
    default_patterns: bool = True
    patterns: tuple[str, ...] = ()

    def effective(self) -> tuple[str, ...]:
        return (DEFAULT_IGNORE if self.default_patterns else ()) + self.patterns


@dataclass(frozen=True)
class Linking:
    exclude: frozenset[str] = frozenset()
    autolink_field: str = "autolink"
    link_style: str = "obsidian"
    reference_style_threshold: int | None = None


@dataclass(frozen=True)
class Checks:
    broken_links: str = "error"
    unmanaged_broken_links: str = "warn"
    orphan_pages: str = "error"
    index_coverage: str = "error"


@dataclass(frozen=True)
class Predicate:
    """``field == value`` over the frontmatter."""

    field: str
    value: str

    @classmethod
    def parse(cls, text: str) -> Predicate:
        name, sign, value = (x.strip() for x in text.partition("=="))
        if not (sign and name and value):
            raise ConfigError(f"unsupported rule predicate '{text}'; expected `field == value`")
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        return cls(name, value)


@dataclass(frozen=True)
class Rule:
    check: str
    severity: str
    dirs: tuple[str, ...] = ()
    when: Predicate | None = None
    sections: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    left: str = ""
    right: str = ""
    name: str = ""
    pattern: str = ""
    match_in: str = ""
    match_mode: str = "content"


@dataclass(frozen=True)
class WikiConfig:
    index: str | None = "index.md"
    directories: tuple[Directory, ...] = (Directory("wiki"),)
    ignore: Ignore = field(default_factory=Ignore)
    linking: Linking = field(default_factory=Linking)
    checks: Checks = field(default_factory=Checks)
    rules: tuple[Rule, ...] = ()

    def mirrors(self) -> list[tuple[str, str]]:
        return [(r.left, r.right) for r in self.rules if r.check == "mirror-parity"]


def _take(table: dict, name: str, kind: type | tuple, default: Any, where: str) -> Any:
    value = table.pop(name, default)
    if value is not default and (not isinstance(value, kind) or isinstance(value, bool) and kind is int):
        raise ConfigError(f"{where}{name} has the wrong type")
    return value


def _strings(table: dict, name: str, where: str, required: bool = False) -> tuple[str, ...]:
    value = _take(table, name, list, None, where)
    if value is None:
        if required:
            raise ConfigError(f"{where}{name} is missing")
        return ()
    if not all(isinstance(x, str) for x in value):
        raise ConfigError(f"{where}{name} must hold strings")
    return tuple(value)


def _severity(table: dict, name: str, default: str, where: str) -> str:
    value = _take(table, name, str, default, where)
    if value not in SEVERITIES:
        raise ConfigError(f"{where}{name}: unknown severity '{value}'; expected error, warn or off")
    return value


def _bare(path: str) -> str:
    return path.rstrip("/") or path


def java_pattern(pattern: str) -> str:
    """Named groups as the JVM writes them."""
    return re.sub(r"\(\?P<", "(?<", pattern)


def _rule(raw: dict, at: int) -> Rule:
    where = f"rules[{at}]."
    raw = dict(raw)
    check = _take(raw, "check", str, None, where)
    known = ("required-sections", "required-frontmatter", "mirror-parity", "citation-pattern")
    if check not in known:
        raise ConfigError(f"{where}check: unknown '{check}'; expected one of {', '.join(known)}")
    severity = _severity(raw, "severity", "warn" if check == "citation-pattern" else "error", where)
    dirs = tuple(map(_bare, _strings(raw, "dirs", where)))
    when = _take(raw, "when", str, None, where)
    scope = {"dirs": dirs, "when": Predicate.parse(when) if when is not None else None}
    if check == "required-sections":
        return Rule(check, severity, sections=_strings(raw, "sections", where, True), **scope)
    if check == "required-frontmatter":
        return Rule(check, severity, fields=_strings(raw, "fields", where, True), **scope)
    if check == "mirror-parity":
        left, right = (_take(raw, k, str, None, where) for k in ("left", "right"))
        if left is None or right is None:
            raise ConfigError(f"{where}left and right are both needed")
        return Rule(check, severity, left=_bare(left), right=_bare(right))
    name, pattern, preset, match_in, mode = (_take(raw, k, str, None, where) for k in ("name", "pattern", "preset", "match_in", "match_mode"))
    if name is None or match_in is None:
        raise ConfigError(f"{where}name and match_in are both needed")
    if (pattern is None) == (preset is None):
        raise ConfigError(f"rule '{name}' needs exactly one of pattern and preset")
    if mode not in (None, "content", "filename"):
        raise ConfigError(f"{where}match_mode: unknown '{mode}'")
    if preset is not None:
        if preset not in PRESETS:
            raise ConfigError(f"rule '{name}': unknown preset '{preset}'")
        pattern, own = PRESETS[preset]
        mode = mode or own
    try:
        re.compile(pattern)
    except re.error as e:
        raise ConfigError(f"rule '{name}': bad pattern: {e}") from e
    return Rule(check, severity, name=name, pattern=pattern, match_in=_bare(match_in), match_mode=mode or "content", **scope)


def from_dict(raw: dict) -> WikiConfig:
    """Settings from a parsed TOML document; what it leaves out has defaults."""
    raw = dict(raw)
    index = _take(raw, "index", str, "index.md", "")
    folders = []
    for k, d in enumerate(_take(raw, "directories", list, [], "")):
        d = dict(d)
        path = _take(d, "path", str, None, f"directories[{k}].")
        if path is None:
            raise ConfigError(f"directories[{k}].path is missing")
        folders.append(Directory(_bare(path), _take(d, "autolink", bool, True, f"directories[{k}].")))
    folders = folders or [Directory("wiki")]
    # The most specific folder of a file is the first that holds it.
    folders.sort(key=lambda d: -len(d.path))
    skip = dict(_take(raw, "ignore", dict, {}, ""))
    patterns = _strings(skip, "patterns", "ignore.") + _strings(raw, "verbatim", "")
    for p in patterns:
        ignore.check(p)
    linking = dict(_take(raw, "linking", dict, {}, ""))
    style = _take(linking, "link_style", str, "obsidian", "linking.")
    if style not in STYLES:
        raise ConfigError(f"linking.link_style: unknown '{style}'")
    threshold = _take(linking, "reference_style_threshold", int, None, "linking.")
    if threshold is not None and threshold < 1:
        raise ConfigError("linking.reference_style_threshold must be at least 1")
    if threshold is not None and style != "markdown":
        raise ConfigError("linking.reference_style_threshold needs link_style = \"markdown\"")
    checks = dict(_take(raw, "checks", dict, {}, ""))
    plain = Checks()
    return WikiConfig(
        index=index or None,
        directories=tuple(folders),
        ignore=Ignore(_take(skip, "default_patterns", bool, True, "ignore."), patterns),
        linking=Linking(frozenset(_strings(linking, "exclude", "linking.")), _take(linking, "autolink_field", str, "autolink", "linking."), style, threshold),
        checks=Checks(*(_severity(checks, k, getattr(plain, k), "checks.") for k in ("broken_links", "unmanaged_broken_links", "orphan_pages", "index_coverage"))),
        rules=tuple(_rule(r, k) for k, r in enumerate(_take(raw, "rules", list, [], ""))),
    )


def parse(text: str) -> WikiConfig:
    try:
        return from_dict(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"bad TOML: {e}") from e


def detect(root: Path) -> WikiConfig:
    """Settings for a folder without a configuration file."""
    return WikiConfig(directories=(Directory("wiki" if (root / "wiki").is_dir() else "."),))


def load(root: Path) -> WikiConfig | None:
    try:
        text = (root / FILE_NAME).read_text(encoding="utf-8")
    except FileNotFoundError:
        return None
    except OSError as e:
        raise ConfigError(f"can't read {root / FILE_NAME}: {e}") from e
    return parse(text)


def load_or_detect(root: Path) -> WikiConfig:
    return load(root) or detect(root)


#: A commented configuration to start from.
EXAMPLE = '''\
# Page that should list every managed page; "" for none.
index = "index.md"

# Paths whose Markdown is never read or changed.
verbatim = ["drafts/"]

# Folders whose pages have names.  The most specific one holds a page.
[[directories]]
path = "wiki"
autolink = true

[ignore]
default_patterns = true
patterns = ["build/"]

[linking]
exclude = ["index"]
autolink_field = "autolink"
link_style = "markdown"
reference_style_threshold = 3

# error, warn or off
[checks]
broken_links = "error"
unmanaged_broken_links = "warn"
orphan_pages = "error"
index_coverage = "error"

[[rules]]
check = "required-sections"
dirs = ["wiki/concepts"]
sections = ["Summary"]

[[rules]]
check = "required-frontmatter"
when = "type == concept"
fields = ["owner"]

[[rules]]
check = "mirror-parity"
left = "wiki/papers"
right = "raw/papers"

[[rules]]
check = "citation-pattern"
name = "cited-method"
preset = "bold-method-year"
match_in = "wiki/papers"
'''
