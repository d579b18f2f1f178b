"""Checks and rules.  Each returns findings; what is switched off is not planned.

Codes and messages are fixed values, which other tools read.

finding(severity, code, rel_path, message, detail)
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.config import Rule, WikiConfig, java_pattern
from ..sources.shared import stored
from . import graph, phrases

#: What the checks read of parsed pages.
FACETS = ("frontmatter", "headings", "links", "block_ids")
COLUMNS = ("severity", "code", "rel_path", "message", "detail")
FILTERS = {"all": ("error", "warn"), "error": ("error",), "warn": ("warn",)}


def _finding(rows: DataFrame, severity: Column | str, code: str, message: Column, detail: Column | None = None, path: str = "rel_path") -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    extra = F.lit(None).cast("string") if detail is None else detail
    return rows.select(level.alias("severity"), F.lit(code).alias("code"), F.col(path).alias("rel_path"), message.alias("message"), extra.alias("detail"))


def broken_links(broken: DataFrame, pages: DataFrame, config: WikiConfig) -> DataFrame:
    """Broken links; those of managed pages and others have severities of their own."""
    managed = pages.where("is_managed").select("rel_path", F.lit(True).alias("managed"))
    severity = F.when(F.col("managed"), config.checks.broken_links).otherwise(config.checks.unmanaged_broken_links)
    message = F.concat(F.trim("markup"), F.lit(" in "), F.col("rel_path"))
    return _finding(broken.join(managed, "rel_path", "left"), severity, "broken-link", message, broken_reason()).where("severity <> 'off'")


def broken_reason() -> Column:
    """Why a link is broken, in words."""
    mark = F.when(F.col("reason_kind") == "block", "^").otherwise("")
    return F.when(F.col("reason_kind") == "page", "page not found").otherwise(F.concat("reason_kind", F.lit(" not found: '"), mark, "reason_value", F.lit("'")))


def orphan_pages(orphans: DataFrame, severity: str) -> DataFrame:
    return _finding(orphans, severity, "orphan", F.concat("rel_path", F.lit(" has no inbound internal links")))


def index_coverage(missing: DataFrame, severity: str) -> DataFrame:
    return _finding(missing, severity, "not-in-index", F.concat("rel_path", F.lit(" is not listed in index")))


def scoped(pages: DataFrame, rule: Rule) -> DataFrame:
    """Managed pages that a rule speaks of."""
    out = pages.where("is_managed")
    if rule.dirs:
        out = out.where(reduce(lambda a, b: a | b, [S.in_folder("rel_path", d) for d in rule.dirs]))
    if rule.when:
        out = out.where(F.coalesce(F.array_contains(F.element_at("fm_lists", rule.when.field), rule.when.value), F.lit(False)))
    return out


def required_sections(pages: DataFrame, rule: Rule) -> DataFrame:
    """A heading of any level with the section's name will do."""
    have = F.transform(F.coalesce("headings", F.array()), lambda h: S.ascii_lower(h["text"]))
    wanted = scoped(pages, rule).select("rel_path", have.alias("have"), F.explode(F.array(*map(F.lit, rule.sections))).alias("section")) if rule.sections else None
    if wanted is None:
        return _finding(pages.limit(0), rule.severity, "missing-section", F.lit(""))
    lacking = wanted.where(~F.array_contains("have", S.ascii_lower("section")))
    return _finding(lacking, rule.severity, "missing-section", F.concat("rel_path", F.lit(" is missing '## "), "section", F.lit("'")), F.col("section"))


def required_frontmatter(pages: DataFrame, rule: Rule) -> DataFrame:
    """Absent fields; a null value counts as present."""
    own = scoped(pages, rule)
    bad = _finding(own.where("fm_error IS NOT NULL"), rule.severity, "bad-frontmatter", F.concat("rel_path", F.lit(": "), "fm_error"))
    none = _finding(own.where("fm_error IS NULL AND fm_json IS NULL"), rule.severity, "no-frontmatter", F.concat("rel_path", F.lit(" has no frontmatter")))
    if not rule.fields:
        return none.unionByName(bad)
    keys = F.coalesce("fm_keys", F.array().cast("array<string>"))
    fields = own.where("fm_json IS NOT NULL").select("rel_path", keys.alias("have"), F.explode(F.array(*map(F.lit, rule.fields))).alias("field"))
    absent = _finding(fields.where("NOT array_contains(have, field)"), rule.severity, "missing-frontmatter", F.concat("rel_path", F.lit(" is missing '"), "field", F.lit("'")), F.col("field"))
    return absent.unionByName(none).unionByName(bad)


def mirror_parity(pages: DataFrame, rule: Rule) -> DataFrame:
    """Stems below one folder that the other lacks, both ways; case matters."""

    def stems(folder: str, side: str) -> DataFrame:
        return pages.where(S.in_folder("rel_path", folder)).select("stem", F.lit(True).alias(side)).distinct()

    apart = stems(rule.left, "l").join(stems(rule.right, "r"), "stem", "full_outer").where("l IS NULL OR r IS NULL")
    own, other = (F.when(F.col("l"), a).otherwise(b) for a, b in ((rule.left, rule.right), (rule.right, rule.left)))
    here = F.concat(own, F.lit("/"), "stem", F.lit(".md"))
    rows = apart.withColumn("rel_path", here)
    return _finding(rows, rule.severity, "missing-mirror", F.concat(here, F.lit(" has no "), other, F.lit("/"), "stem", F.lit(".md")), F.col("stem"))


def citation_pattern(pages: DataFrame, rule: Rule) -> DataFrame:
    """Captured ids without a matching page, once per occurrence."""
    group = re.compile(rule.pattern).groupindex.get("id")
    if group is None:
        return _finding(pages.limit(0), rule.severity, rule.name, F.lit(""))
    ids = scoped(pages, rule).select("rel_path", F.explode(F.regexp_extract_all("source", F.lit(java_pattern(rule.pattern)), F.lit(group))).alias("id")).where("id <> ''")
    where = pages.where(S.in_folder("rel_path", rule.match_in))
    if rule.match_mode == "filename":
        lost = ids.withColumn("low", F.lower("id")).join(where.select(F.lower("stem").alias("low")), "low", "left_anti")
    else:
        ids = stored(ids, "citations")  # the pattern is looked for once
        lost = ids.join(phrases.contained(where, ids.select(F.col("id").alias("phrase"))).withColumnRenamed("phrase", "id"), "id", "left_anti")
    message = F.concat("rel_path", F.lit(" references '"), "id", F.lit(f"' but no matching page in {rule.match_in}"))
    return _finding(lost, rule.severity, rule.name, message, F.col("id"))


#: The check of each rule and the facets of pages it reads.
RULES = {
    "required-sections": (required_sections, ("frontmatter", "headings")),
    "required-frontmatter": (required_frontmatter, ("frontmatter",)),
    "mirror-parity": (mirror_parity, ()),
    "citation-pattern": (citation_pattern, ("frontmatter",)),
}


def rule_findings(pages: Callable[..., DataFrame], rule: Rule) -> DataFrame:
    """Findings of a rule; ``pages`` gives pages with the facets asked for."""
    check, facets = RULES[rule.check]
    if not rule.when and rule.check != "required-frontmatter":
        facets = tuple(f for f in facets if f != "frontmatter")
    return check(pages(*facets), rule)


def lint(pages: Callable[..., DataFrame], resolved: DataFrame, broken: DataFrame, edges: DataFrame, config: WikiConfig, severity: str = "all") -> DataFrame:
    """All findings of the wanted severities."""
    shown = FILTERS[severity]
    checks = config.checks
    parts = []
    if checks.broken_links in shown or checks.unmanaged_broken_links in shown:
        parts.append(broken_links(broken, pages(), config).where(F.col("severity").isin(*shown)))
    if checks.orphan_pages in shown:
        parts.append(orphan_pages(graph.orphans(pages(), edges), checks.orphan_pages))
    if checks.index_coverage in shown and config.index:
        # Without an index file there is nothing to be covered by.
        there = pages().where("is_index").select(F.lit(1).alias("one"))
        missing = graph.not_in_index(pages(), resolved).withColumn("one", F.lit(1)).join(there, "one", "left_semi")
        parts.append(index_coverage(missing, checks.index_coverage))
    parts += [rule_findings(pages, r) for r in config.rules if r.severity in shown]
    if not parts:
        return _finding(pages().limit(0), "error", "", F.lit(""))
    return reduce(DataFrame.unionByName, parts)


def summary(findings: DataFrame) -> DataFrame:
    """n_errors, n_warnings."""
    return findings.agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warn").alias("n_warnings"))
