"""Filter interaction audit: what every order of five filters removes.

Every document has one bit per filter that it fails (``FILTERS``), one per label
and belongs to one part.  Partitions are packed into bitsets: documents are
sorted by part and each part is a range of whole words, so one bitset per filter
and label serves all parts.  For every subset of the filters (every prefix of an
order is one of these 32 subsets) the documents left are what is there AND NOT
any of the subset's bitsets; a popcount by part gives the counts of the
partition, and Spark sums them over the partitions.  All figures of an order
follow from these sums: what a step removes is what is left before it less what
is left after it.

Four filters judge a text alone.  The fifth, a copy of a smaller doc_id's text,
needs the smallest doc_id of each text: one aggregate over 128-bit hashes of the
texts, met again by hash *and* doc_id, so that no group of copies comes
together in a task.  Before every shuffle equal rows become one row with a
count, so neither does a repeated row, nor an id that many rows share; rows
without an id have no smaller id and are nobody's original.

Null texts count as empty, and a null part as the empty string; a document is
good or toxic if any of the label rows with its doc_id says so.  Repeated rows
count each, and are no copies of one another under one id.  An empty table
gives an empty result; other columns are neither read nor returned.  Very long
texts are handled whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, written
from .textkit import PLAIN, find_words, groups, hash_words, text_buffers, trimmed

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = "#$%&*|"

#: Documents packed together; bounds the memory of a task.
CHUNK = 1 << 18
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_COUNTS = ("kept", "good", "toxic")


def _prefix(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, fails (bits of filters A to D) and a 128-bit hash of the text, of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            raw, offs = text_buffers(batch.column(2))
            fails, hashes = [], []
            for a, b in groups(offs):
                buf, own = raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                starts, ends, first = find_words(buf, own, PLAIN)
                words = hash_words(buf, starts, ends, fold=False)
                points, upper, symbols = (np.diff(_prefix(m)[own]) for m in ((buf & 0xC0) != 0x80, _UPPER[buf], _SYMBOL[buf]))
                n = np.diff(first)
                row = np.repeat(np.arange(b - a), n)
                order = np.lexsort((words, row))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (words[order[1:]] != words[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
                distinct = np.bincount(row[order[new]], minlength=b - a)
                bits = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * upper > MAX_UPPER_PERCENT * points, symbols > 0]
                fails.append(sum(x.astype(np.int16) << k for k, x in enumerate(bits)))
                view = memoryview(buf)
                hashes += [xxhash.xxh3_128_digest(view[own[i] : own[i + 1]]) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(fails) if fails else [], pa.int16()), pa.array(hashes, pa.binary())], ["doc_id", "part", "fails", "hash"])

    part = F.coalesce(docs[part_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), part.alias("part"), docs[text_col].cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, part string, fails short, hash binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, part, fails, n): with the bit of filter E, equal rows counted.

    ``rows``: of ``text_failures``, read twice.
    """
    first = rows.where("doc_id IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("doc_id")).withColumn("original", F.lit(True))
    alike = rows.groupBy("hash", "doc_id", "part", "fails").agg(F.count("*").alias("n"))
    copy = F.col("doc_id").isNotNull() & F.col("original").isNull()
    told = alike.join(first, ["hash", "doc_id"], "left").withColumn("fails", F.when(copy, F.col("fails") + F.lit(16)).otherwise(F.col("fails")).cast("short"))
    return told.groupBy("doc_id", "part", "fails").agg(F.sum("n").alias("n"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n) of rows (doc_id, part, fails, n)."""
    said = (
        labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.bool_or(F.expr("quality <=> 1")).alias("good"), F.bool_or(F.expr("toxic <=> 1")).alias("toxic"))
    )
    no = F.lit(False)
    return rows.join(said, "doc_id", "left").select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")


class _Bitmaps:
    """Packed bitsets of some documents, sorted by part."""

    def __init__(self, part: np.ndarray, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray, n_filters: int):
        order = np.argsort(part, kind="stable")
        part = part[order]
        begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.append(begins, len(part)))
        words = -(-sizes // 64)  # every part begins at a word of 64 documents
        self.parts, self.first = part[begins], np.cumsum(words) - words
        self.length = int(words.sum())
        at = np.arange(len(part)) + np.repeat(self.first * 64 - begins, sizes)
        fails = fails[order]
        self.filters = [self._packed(at, (fails >> k) & 1 == 1) for k in range(n_filters)]
        self.sets = [self._packed(at, x) for x in (np.ones(len(part), dtype=bool), good[order], toxic[order])]

    def _packed(self, at: np.ndarray, member: np.ndarray) -> np.ndarray:
        bits = np.zeros(self.length * 64, dtype=bool)
        bits[at[member]] = True
        return np.packbits(bits).view(np.uint64)

    def left(self, subset: int) -> list[np.ndarray]:
        """By part: the documents, good and toxic ones, that no filter of the subset removes."""
        failed = np.zeros(self.length, dtype=np.uint64)
        for k, bits in enumerate(self.filters):
            if subset >> k & 1:
                failed |= bits
        return [np.add.reduceat(np.bitwise_count(s & ~failed).astype(np.int64), self.first) for s in self.sets]


def left_by_subset(rows: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """(part, subset, kept, good, toxic): what is left by each subset of the filters.

    ``rows``: part, fails, good, toxic, n (how many documents are alike).
    """
    names = ["part", "subset", *_COUNTS]

    def counted(columns: list[pa.ChunkedArray | pa.Array]) -> pa.RecordBatch:
        part = columns[0].dictionary_encode()
        maps = _Bitmaps(part.indices.to_numpy(), *(c.to_numpy(zero_copy_only=False) for c in columns[1:]), n_filters)
        own = part.dictionary.take(pa.array(maps.parts))
        out = [[own, pa.array(np.full(len(own), s, np.int16)), *map(pa.array, maps.left(s))] for s in range(1 << n_filters)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in zip(*out, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        held = 0
        for batch in batches:
            many = batch.column(4).to_numpy().copy()
            while many.any():  # a row stands for n documents, each with a bit of its own
                now = np.diff(np.minimum(np.cumsum(many), CHUNK - held), prepend=0)
                many -= now
                held += int(now.sum())
                waiting.append(pa.Table.from_batches([batch.select([0, 1, 2, 3]).take(pa.array(np.repeat(np.arange(len(now)), now)))]))
                if held == CHUNK:
                    yield counted([c.combine_chunks() for c in pa.concat_tables(waiting).columns])
                    waiting, held = [], 0
        if held:
            yield counted([c.combine_chunks() for c in pa.concat_tables(waiting).columns])

    partial = rows.select("part", "fails", "good", "toxic", "n").mapInArrow(trimmed(run), "part string, subset short, kept long, good long, toxic long")
    return partial.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _steps(filters: str) -> str:
    """All orders and their steps as JSON: the filter's number and the subset before it."""
    out = []
    for order in permutations(range(len(filters))):
        before = 0
        for k, f in enumerate(order):
            out.append({"filter_order": "".join(filters[x] for x in order), "step": k + 1, "f": f, "before": before})
            before |= 1 << f
    return json.dumps(out)


def audit(left: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step, from what is left by each subset."""
    n, full = len(filters), (1 << len(filters)) - 1
    cells = F.array_sort(F.collect_list(F.struct("subset", *_COUNTS)))
    parts = left.groupBy("part").agg(cells.alias("cells"))  # 32 cells a part
    steps = F.from_json(F.lit(_steps(filters)), "array<struct<filter_order: string, step: int, f: int, before: int>>")
    weights = {k: factorial(k) * factorial(n - 1 - k) for k in range(n)}
    value = F.lit(0).cast("long")
    each = []
    for f in range(n):
        bit = 1 << f
        total = value
        for s in range(full + 1):
            if not s & bit:
                total = total + F.lit(weights[s.bit_count()]) * (F.col("cells")[s]["kept"] - F.col("cells")[s | bit]["kept"])
        each.append(total)
    rows = parts.withColumn("shapleys", F.array(*each)).select("part", "cells", "shapleys", F.explode(steps).alias("o"))
    before, after = F.col("cells")[F.col("o.before")], F.col("cells")[F.col("after")]
    alone, rest = F.col("cells")[F.col("bit")], F.col("cells")[F.lit(full) - F.col("bit")]
    rows = rows.withColumn("bit", F.expr("shiftleft(1, o.f)")).withColumn("after", F.col("o.before") + F.col("bit"))
    removed = before["kept"] - after["kept"]
    return rows.select(
        "part",
        "o.filter_order",
        "o.step",
        after["kept"].alias("kept"),
        removed.alias("removed"),
        (F.col("cells")[0]["kept"] - alone["kept"] - removed).alias("redundant"),
        (rest["kept"] - F.col("cells")[full]["kept"]).alias("unique_fails"),
        (before["good"] - after["good"]).alias("good_lost"),
        (before["toxic"] - after["toxic"]).alias("toxic_lost"),
        F.col("shapleys")[F.col("o.f")].alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = written(text_failures(docs), "audit")
    labelled = with_labels(with_copies(rows), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audit(left_by_subset(labelled))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT d.part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM d),
f AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT unnest(range(5)) AS k),
o AS (
  SELECT row_number() OVER () AS o, [p.k, q.k, r.k, s.k, t.k] AS ks FROM l p, l q, l r, l s, l t
  WHERE p.k <> q.k AND p.k <> r.k AND p.k <> s.k AND p.k <> t.k AND q.k <> r.k AND q.k <> s.k AND q.k <> t.k AND r.k <> s.k AND r.k <> t.k AND s.k <> t.k),
x AS (
  SELECT array_to_string(list_transform(ks, lambda k: 'ABCDE'[k + 1]), '') AS filter_order, step, 1 << ks[step] AS bit, list_sum(list_transform(ks[1:step], lambda k: 1 << k)) AS upto
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (fails & upto = 0) AS kept, sum(n) FILTER (fails & (upto - bit) = 0 AND fails & bit > 0) AS removed,
         sum(n) FILTER (fails & (upto - bit) > 0 AND fails & bit > 0) AS redundant, sum(n) FILTER (fails = bit) AS unique_fails,
         sum(good) FILTER (fails & (upto - bit) = 0 AND fails & bit > 0) AS good_lost, sum(toxic) FILTER (fails & (upto - bit) = 0 AND fails & bit > 0) AS toxic_lost
  FROM f, x GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM g
"""
