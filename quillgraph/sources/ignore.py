"""Ignore patterns in the manner of gitignore files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import above


def check(pattern: str) -> None:
    """Raise ConfigError for a pattern that can't be used."""
    from .config import ConfigError

    if pattern.startswith("!"):
        raise ConfigError(f"ignore pattern '{pattern}' must not start with !")
    try:
        _compiled(pattern)
    except re.error as e:
        raise ConfigError(f"bad ignore pattern '{pattern}': {e}") from e


@lru_cache(maxsize=4096)
def _compiled(pattern: str) -> tuple[re.Pattern | None, bool, bool]:
    """(matcher of a path, negated, for folders only)."""
    text = re.sub(r"(?<!\\) +$", "", pattern)
    if not text or text.startswith("#"):
        return None, False, False
    negated = text.startswith("!")
    text = text.removeprefix("!")
    folder = text.endswith("/")
    text = text.rstrip("/") if folder else text
    anchored = "/" in text
    text = text.removeprefix("/")
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif text.startswith("/**", i) and i + 3 == len(text):
            out.append("/.+")
            i += 3
        elif c == "*":
            while text.startswith("*", i + 1):
                i += 1
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            end = text.find("]", i + 2)
            if end < 0:
                raise re.error("unclosed character class")
            body = text[i + 1 : end]
            body = "^" + body[1:] if body[0] in "!^" else body
            # Escapes that Python and Java read alike.
            out.append("[" + re.sub(r"([\\\[\]&~|])", r"\\\1", body) + "]")
            i = end + 1
        elif c == "\\" and i + 1 < len(text):
            out.append(re.escape(text[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    body = "".join(out)
    return re.compile(body if anchored else f"(?:.*/)?{body}"), negated, folder


class Matcher:
    """Patterns that hold below one folder; the last match decides."""

    def __init__(self, patterns: tuple[str, ...] | list[str], base: str = ""):
        self.base = base
        self.rules = [r for r in map(_compiled, patterns) if r[0] is not None]

    def decide(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept, None: not spoken of."""
        if self.base:
            if not path.startswith(f"{self.base}/"):
                return None
            path = path[len(self.base) + 1 :]
        for pattern, negated, folder in reversed(self.rules):
            if (is_dir or not folder) and pattern.fullmatch(path):
                return not negated
        return None

    def ignores(self, path: str) -> bool:
        """Whether a file is ignored, itself or with a folder above it."""
        parts = path.split("/")
        return any(self.decide("/".join(parts[: k + 1]), k + 1 < len(parts)) for k in range(len(parts)))

    def column(self, path: Column, is_dir: Column) -> Column:
        """``decide`` as a column."""
        out = F.lit(None).cast("boolean")
        body = re.escape(f"{self.base}/") if self.base else ""
        for pattern, negated, folder in self.rules:
            found = path.rlike(f"^{body}(?:{pattern.pattern})$")
            out = F.when(found & is_dir if folder else found, not negated).otherwise(out)
        return out


def ignored(path: Column | str, own: Matcher) -> Column:
    """Whether a file is ignored, itself or with a folder above it, as a column."""
    if not own.rules:
        return F.lit(False)
    return F.exists(_steps(path), lambda step: F.coalesce(own.column(step["path"], step["is_dir"]), F.lit(False)))


def _steps(path: Column | str) -> Column:
    """The folders above a file from the top, then the file: (path, is_dir)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), (k < F.size(parts)).alias("is_dir")))


#: Ignore files, those that win last.
FILES = (".gitignore", ".ignore")
RULES = "folder string, kind int, rules array<struct<pattern: string, negated: boolean, dirs_only: boolean>>"


def rule_rows(files: DataFrame) -> DataFrame:
    """The rules of the ignore files among ``files`` (rel_path, source), one row per file.

    Patterns are of paths below the folder, as the JVM reads them; the last
    match of a file decides.
    """
    name = F.substring_index("rel_path", "/", -1)
    kind = F.when(name == FILES[0], 0).when(name == FILES[1], 1)
    own = files.select(F.regexp_replace("rel_path", "/?[^/]*$", "").alias("folder"), kind.alias("kind"), F.coalesce("source", F.lit("")).alias("text")).where("kind IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = [[{"pattern": p.pattern, "negated": n, "dirs_only": d} for p, n, d in from_text(text, "").rules] for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rules, _RULES)], ["folder", "kind", "rules"])

    return own.mapInArrow(run, RULES).where("size(rules) > 0")


_RULES = pa.list_(pa.struct([("pattern", pa.string()), ("negated", pa.bool_()), ("dirs_only", pa.bool_())]))


def left_by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (rel_path, ...) that the rules (of ``rule_rows``) leave, however many there are.

    Every file meets the rules of the folders above it, by an equi-join; a
    file, and each folder above it, is judged by the nearest of them that
    speaks of it, ``.ignore`` before ``.gitignore``, and a file goes if it or a
    folder above it is ignored.  Folders that hold a large share of all files
    meet them by a broadcast.  The plan does not grow with the rules.
    """
    named = files.select("rel_path").distinct()
    every = named.select("rel_path", F.explode(above.folders_above("rel_path")).alias("folder"))
    met = above.met(every, rules, named.count())
    below = "if(folder = '', s.path, substring(s.path, char_length(folder) + 2))"
    said = f"aggregate(rules, cast(null AS boolean), (a, r) -> if((s.is_dir OR NOT r.dirs_only) AND x rlike concat('\\\\A(?:', r.pattern, ')\\\\z'), NOT r.negated, a))"
    said = f"get(transform(array({below}), x -> {said}), 0)"
    depth = "if(folder = '', 0, size(split(folder, '/')))"
    judged = met.withColumn("s", F.explode(_steps("rel_path"))).where(f"size(split(s.path, '/')) > {depth}")
    spoken = judged.select("rel_path", F.col("s.path").alias("step"), F.struct("kind", F.expr(depth).alias("depth")).alias("rank"), F.expr(said).alias("ignored")).where("ignored IS NOT NULL")
    gone = spoken.groupBy("rel_path", "step").agg(F.max_by("ignored", "rank").alias("ignored")).where("ignored").select("rel_path").distinct()
    return files.join(gone, "rel_path", "left_anti")


def from_text(text: str, base: str) -> Matcher:
    """The rules of a .gitignore file that can be used."""
    usable = []
    for line in text.splitlines():
        try:
            _compiled(line)
        except re.error:
            continue
        usable.append(line)
    return Matcher(usable, base)
