"""Secret scan: fixed patterns and sliding-window entropy.

Patterns find assignments (password = ...), access keys and long hexadecimal
strings.  Beyond them, candidate strings (runs of key characters) are scanned
with a window of ``WINDOW`` characters.  The window's Shannon entropy is kept
by incremental counts: each step adds the incoming character, removes the
outgoing one and corrects the sum of c * log2(c) for just these two; the counts
are packed into a few longs.  The threshold depends on the candidate's
character class.  Overlapping windows at or above the threshold form one span.
An allow-list suppresses candidates that are known to be harmless, and windows
over runs of digits or of the alphabet; spans that overlap a pattern's span are
left out.

Only DataFrame functions are used; rows are independent, so nothing is
shuffled.  Offsets are code points.

Nulls and empty texts give no spans.  Repeated rows give repeated results, an
empty table gives an empty result, and other columns are neither read nor
returned.  Very long texts and candidates are handled whole, in time that grows
in proportion to them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import bound, running

WINDOW = 20

#: Fixed patterns of the base scan.
_KEYWORD = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = _KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Runs of key characters long enough for a window.
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"

#: (class, pattern that the whole candidate matches, bits per character from which a window counts), first match wins.
CLASSES = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 2.9),
    ("lower", "^[a-z0-9_=-]+$", 3.6),
    ("upper", "^[A-Z0-9_=-]+$", 3.6),
    ("mixed", "^[A-Za-z0-9+/_=-]+$", 3.8),
)

def _at_once(pattern: str) -> str:
    """A run of a character class, tried only where a run begins and never given back."""
    cls = pattern[: pattern.index("]") + 1]
    return f"(?<!{cls}){pattern}+"


#: A candidate must have a digit and a letter, and must match none of these whole:
#: UUIDs, and words or numbers joined by - _ / = +.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^([A-Za-z]+|[0-9]+)([-_/=+]+([A-Za-z]+|[0-9]+))*[-_/=+]*$",
)
#: The same without backtracking: a repeated group of Java's patterns otherwise recurses once per repetition.
_ALLOWED_AT_ONCE = (ALLOWED[0], "^(?:[A-Za-z]++|[0-9]++)(?:[-_/=+]++(?:[A-Za-z]++|[0-9]++))*+[-_/=+]*+$")
#: Windows with a run of the alphabet or of digits do not count.
ALLOWED_PART = "0123456789|9876543210|abcdefghij|ABCDEFGHIJ"
#: Window starts of a candidate scanned by one fold.
PIECE = 8192


def _found(matches: str, gaps: str) -> Column:
    """struct(start, end, text) of each match, from the lengths of matches and of the gaps before them."""
    ends = running(f"zip_with(slice({gaps}, 1, size({matches})), {matches}, (g, h) -> bigint(length(g) + length(h)))", "{a} + {b}")
    return F.expr(f"zip_with({ends}, {matches}, (e, h) -> struct(int(e - length(h)) AS start, int(e) AS end, h AS text))")


#: Counts are kept in longs of 12 counts of 5 bits, by code point from "+" to "z".
_FIRST, _LAST, _PER, _BITS, _LONGS = ord("+"), ord("z"), 12, 5, 7
_LOG = [n * math.log2(n) if n else 0.0 for n in range(WINDOW + 2)]
#: What one more occurrence adds to the sum of c * log2(c), by c.
_GROWS = "array(" + ", ".join(f"double('{b - a!r}')" for a, b in zip(_LOG, _LOG[1:])) + ")"
#: Where a character is counted: the long, the shift, and a count of one there.
_PLACES = "array(" + ", ".join(f"struct({k // _PER} AS n, {k % _PER * _BITS} AS shift, {1 << k % _PER * _BITS}L AS one)" for k in range(_LAST - _FIRST + 1)) + ")"
_RUNS = "array<struct<a: int, b: int>>"


def _piece_runs(piece: str, least: str) -> str:
    """SQL for struct(a, b): first and last start of runs of overlapping or touching windows with at least ``least`` bits per character."""
    # Per character: where it is counted, where the one that leaves the window is, and the window's start.
    steps = bound(
        f"transform(split({piece}, ''), x -> ascii(x))",
        "codes",
        f"transform(codes, (c, i) -> struct(get({_PLACES}, c - {_FIRST}) AS come, get({_PLACES}, get(codes, i - {WINDOW}) - {_FIRST}) AS go, i - {WINDOW - 1} AS at))",
    )
    count = "int(shiftrightunsigned(get(t.counts, x.{0}.n), x.{0}.shift) & " + str((1 << _BITS) - 1) + ")"
    # The incoming character is counted and the outgoing one is not any more; only their terms of the sum change.
    plus, minus = f"coalesce(get({_GROWS}, {count.format('come')}), 0D)", f"coalesce(get({_GROWS}, {count.format('go')} - 1), 0D)"
    total = f"if(x.come <=> x.go, t.sum, t.sum + {plus} - {minus})"
    counts = "if(x.come <=> x.go, t.counts, transform(t.counts, (c, k) -> c + if(k = x.come.n, x.come.one, 0L) - if(k = x.go.n, x.go.one, 0L)))"
    # Windows with a character that is not counted do not count.
    high = f"n.unbroken >= {WINDOW} AND double('{math.log2(WINDOW)!r}') - n.sum / {WINDOW}D + 5e-7D >= {least}"
    joins = f"t.a >= 0 AND x.at - t.b <= {WINDOW}"
    low = "struct({c} AS counts, n.sum AS sum, n.unbroken AS unbroken, t.a AS a, t.b AS b, t.runs AS runs)".format(c=counts)
    up = f"struct({counts} AS counts, n.sum AS sum, n.unbroken AS unbroken, if({joins}, t.a, x.at) AS a, x.at AS b, if(t.a < 0 OR {joins}, t.runs, concat(t.runs, array(struct(t.a AS a, t.b AS b)))) AS runs)"
    step = bound(f"struct({total} AS sum, if(x.come IS NULL, 0, t.unbroken + 1) AS unbroken)", "n", f"if({high}, {up}, {low})")
    zero = f"struct(array_repeat(0L, {_LONGS}) AS counts, 0D AS sum, 0 AS unbroken, -1 AS a, -1 AS b, cast(array() AS {_RUNS}) AS runs)"
    return f"aggregate({steps}, {zero}, (t, x) -> {step}, t -> if(t.a < 0, t.runs, concat(t.runs, array(struct(t.a AS a, t.b AS b)))))"


def high_runs(candidate: str, least: str) -> str:
    """SQL for struct(start, end) of unions of overlapping or touching windows of high entropy.

    A candidate is cut into pieces of ``PIECE`` window starts, so that a fold's
    state stays small; runs that meet at a cut are joined.
    """
    piece = _piece_runs(f"substring({candidate}, p * {PIECE} + 1, {PIECE + WINDOW - 1})", least)
    runs = f"flatten(transform(sequence(0, int((length({candidate}) - {WINDOW}) div {PIECE})), p -> transform({piece}, r -> struct(r.a + p * {PIECE} AS a, r.b + p * {PIECE} AS b))))"
    heads = f"filter(runs, (r, k) -> k = 0 OR r.a - get(runs, k - 1).b > {WINDOW})"
    tails = f"filter(runs, (r, k) -> k = size(runs) - 1 OR get(runs, k + 1).a - r.b > {WINDOW})"
    return bound(runs, "runs", f"zip_with({heads}, {tails}, (h, l) -> struct(h.a AS start, l.b + {WINDOW} AS end))")


def _threshold(candidate: Column) -> Column:
    out = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        out = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``base`` and ``more``: arrays of struct(start, kind number, end)."""
    x = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    # Plain searches guard the dear patterns: few texts hold a keyword.
    none = F.array().cast("array<string>")
    low = F.lower("t")
    keyword = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": _at_once(HEX), "more": _at_once(CANDIDATE)}
    hits = {name: F.regexp_extract_all("t", F.lit(pattern), F.lit(0)) for name, pattern in patterns.items()}
    hits["assign"] = F.when(keyword, hits["assign"]).otherwise(none)
    hits["access"] = F.when(F.col("t").contains("AKIA"), hits["access"]).otherwise(none)
    # A hexadecimal match lies in a candidate.
    x = x.select("doc_id", "t", *[hits[name].alias(name) for name in ("assign", "access", "more")]).withColumn("hex", F.when(F.size("more") > 0, hits["hex"]).otherwise(none))
    # Texts without a match are not split.
    x = x.select("doc_id", *patterns, *[F.when(F.size(name) > 0, F.split("t", pattern, -1)).otherwise(none).alias(f"{name}_gaps") for name, pattern in patterns.items()])
    x = x.select("doc_id", *[_found(name, f"{name}_gaps").alias(name) for name in patterns])
    x = x.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 8))
    base = F.concat(*[F.transform(k, _numbered(n)) for n, k in enumerate(KINDS[:3])])

    def harmless(s: Column) -> Column:
        c = s["text"]
        out = ~(c.rlike("[0-9]") & c.rlike("[A-Za-z]"))
        for pattern in _ALLOWED_AT_ONCE:
            out = out | c.rlike(pattern)
        return out

    judged = F.transform(F.filter("more", lambda s: ~harmless(s)), lambda s: F.struct(s["start"], _threshold(s["text"]).alias("least"), F.regexp_replace(s["text"], ALLOWED_PART, " " * 10).alias("plain")))
    x = x.select("doc_id", F.array_sort(base).alias("base"), judged.alias("more"))
    spans = f"flatten(transform(more, s -> transform({high_runs('s.plain', 's.least')}, r -> struct(s.start + r.start AS start, 3 AS kind, s.start + r.end AS end))))"
    x = x.select("doc_id", "base", F.expr(spans).alias("more"))
    return x.select("doc_id", "base", F.expr(f"if(size(base) = 0, more, {_apart('base', 'more')})").alias("more"))


def _apart(base: str, more: str) -> str:
    """SQL for the spans of ``more``, which are apart from each other, that overlap none of ``base``."""
    # In order of starts a span overlaps an earlier one that reaches beyond its start, or the very next one.
    reach = running("transform(line, s -> if(s.kind < 3, bigint(s.end), 0L))", "greatest({a}, {b})")
    after = "coalesce(get(line, k + 1).kind < 3 AND get(line, k + 1).start < s.end, false)"
    free = bound(reach, "reach", f"filter(line, (s, k) -> s.kind = 3 AND get(reach, k) <= s.start AND NOT {after})")
    return bound(f"array_sort(concat({base}, {more}))", "line", free)


def _numbered(kind: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def counted(kind: int) -> Column:
    """Base spans of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [counted(n).alias(f"n_{KINDS[n]}") for n in range(3)]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.array_sort(F.concat("base", "more"))).alias("spans"))


def _sql_hits(number: int, pattern: str) -> str:
    """SQL for the matches of a pattern: row, kind number, start, end, text."""
    literal = pattern.replace("'", "''")
    return f"""SELECT r, {number} AS kind, pos, pos + length(hit) AS stop, hit FROM (
      SELECT r, hit, sum(length(gap)) OVER (PARTITION BY r ORDER BY i) + coalesce(sum(length(hit)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM (SELECT r, unnest(regexp_split_to_array(t, '{literal}')) AS gap, unnest(regexp_extract_all(t, '{literal}')) AS hit,
                   unnest(range(1, len(regexp_split_to_array(t, '{literal}')) + 1)) AS i FROM d WHERE regexp_matches(t, '{literal}'))) WHERE hit IS NOT NULL"""


_SQL_ALLOWED = " OR ".join(f"regexp_matches(hit, '{p}')" for p in ALLOWED)
_SQL_LEAST = "CASE " + " ".join(f"WHEN regexp_matches(hit, '{p}') THEN {bits}" for _, p, bits in CLASSES) + " END"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT * FROM ({_sql_hits(0, ASSIGN)}) WHERE length(regexp_extract(hit, '{ASSIGN.replace("'", "''")}', 2)) >= 8
  UNION ALL {_sql_hits(1, ACCESS)}
  UNION ALL {_sql_hits(2, HEX)}),
c AS (SELECT *, {_SQL_LEAST} AS least FROM ({_sql_hits(3, CANDIDATE)}) WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT ({_SQL_ALLOWED})),
p AS (SELECT r, pos, least, regexp_replace(hit, '{ALLOWED_PART}', '{" " * 10}', 'g') AS hit FROM c),
w AS (SELECT r, pos, least, i, unnest(string_split(substr(hit, i + 1, {WINDOW}), '')) AS ch FROM (SELECT *, unnest(range(0, length(hit) - {WINDOW - 1})) AS i FROM p) WHERE NOT contains(substr(hit, i + 1, {WINDOW}), ' ')),
h AS (SELECT r, pos, i FROM (SELECT r, pos, least, i, ch, count(*) AS n FROM w GROUP BY r, pos, least, i, ch) GROUP BY r, pos, least, i
      HAVING round(log2({WINDOW}) - sum(n * log2(n)) / {WINDOW}, 6) >= least),
g AS (SELECT r, pos, i, sum(fresh) OVER (PARTITION BY r, pos ORDER BY i) AS run FROM (
      SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY r, pos ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM h)),
more AS (SELECT r, 3 AS kind, pos + min(i) AS pos, pos + max(i) + {WINDOW} AS stop FROM g GROUP BY r, g.pos, run),
spans AS (
  SELECT r, kind, pos, stop FROM base
  UNION ALL SELECT r, kind, pos, stop FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.pos < m.stop AND m.pos < b.stop)),
told AS (SELECT r, kind, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || pos::BIGINT || ':' || stop::BIGINT AS said, pos FROM spans)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(said, ',' ORDER BY pos, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY pos, kind), '') AS spans
FROM d LEFT JOIN told USING (r) GROUP BY r, doc_id
"""
