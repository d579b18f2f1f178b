"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is its windows of ``WINDOW`` consecutive words (an item of
fewer words is one window).  A window is a set of word shingles.  Shingles are
ordered by how often they occur in the corpus; since a window must be contained
whole, its prefix is one shingle, the rarest.  Documents are joined with these
prefix shingles only; the shingle's place in the window fixes where the window
would have to start (positional bound) and end (length bound), and the words
there are compared one by one (words, as everywhere here, by 64-bit hashes).

Two narrow passes over the documents, no shuffle of texts: one counts the
benchmark's shingles, one joins.  The benchmark is cut into blocks of about
``BLOCK_BYTES`` by its measured size.  One block at a time is brought to the
driver and its index broadcast; with more than one, each block takes its two
passes, of which only hits are written, and the documents meet those by hashes
of their texts.

Nulls and empty texts have no words: such documents hit nothing and such items
have no windows.  An item without an id marks words as hit but can't be named.
Rows with the same item_id are one item.  Repeated documents get repeated
results; an empty table on either side is allowed; other columns are kept by
``clean_documents`` and neither read nor returned by ``benchmark_hits``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, small_batches, written
from .textkit import ALNUM, mix64, trimmed, window_hashes, word_groups

WINDOW = 13
SHINGLE = 5
BLOCK_BYTES = 4 << 20
#: The words of a text, as the workers see them.
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: A document is contaminated if at least 1 in MIN_SHARE of its words is hit.
MIN_SHARE = 20

_FILTER_BITS = 20


class Windows:
    """The distinct windows of some items: where they are in the items' words, and whose they are."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, shingle: int = SHINGLE):
        self.shingle = shingle
        self.names = sorted({i for i, _ in items if i is not None})
        number = {n: k for k, n in enumerate(self.names)}
        owner = np.array([number.get(i, -1) for i, _ in items], np.int64)
        words, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, own, first, _ in word_groups(pa.array([t or "" for _, t in items], pa.large_string()), ALNUM):
            words.append(own)
            sizes.append(np.diff(first))
        self.words, size = np.concatenate(words), np.concatenate(sizes)
        begin = np.cumsum(size) - size
        n = np.where(size > window, size - window + 1, size > 0)
        first = np.cumsum(n) - n
        start = np.repeat(begin - first, n) + np.arange(n.sum())
        length = np.repeat(np.minimum(size, window), n)
        mark = np.zeros((2, len(start)), np.uint64)  # 128 bits tell windows apart
        for k in np.unique(length):
            own = length == k
            for row, spread in zip(mark, (self.words, mix64(self.words)), strict=True):
                row[own] = window_hashes(spread, int(k))[start[own]]
        order = np.lexsort((start, mark[1], mark[0], length))
        new = np.ones(len(order), bool)
        new[1:] = (length[order][1:] != length[order][:-1]) | (mark[:, order][:, 1:] != mark[:, order][:, :-1]).any(axis=0)
        self.start, self.length = start[order][new], length[order][new]
        owned = np.unique(np.stack([np.cumsum(new) - 1, np.repeat(owner, n)[order]]), axis=1)
        owned = owned[:, owned[1] >= 0]
        self.owner_at = np.searchsorted(owned[0], np.arange(len(self.start) + 1))
        self.owners = owned[1]

    def shingles(self) -> dict[int, np.ndarray]:
        """By shingle size, the sorted hashes of all shingles of all windows."""
        out = {}
        for size in np.unique(np.minimum(self.length, self.shingle)).tolist():
            own = np.minimum(self.length, self.shingle) == size
            at = [self.start[own & (self.length - size >= o)] + o for o in range(int(self.length[own].max()) - size + 1)]
            out[size] = np.unique(window_hashes(self.words, size)[np.concatenate(at)])
        return out


class Index:
    """Windows by their rarest shingle."""

    def __init__(self, windows: Windows, counts: dict[int, np.ndarray]):
        """``counts``: by size, how often the corpus has each of ``windows.shingles()``."""
        self.names, self.words = windows.names, windows.words
        self.start, self.length = windows.start, windows.length
        self.owner_at, self.owners = windows.owner_at, windows.owners
        self.by: dict[int, tuple] = {}
        for size, keys in windows.shingles().items():
            own = np.flatnonzero(np.minimum(windows.length, windows.shingle) == size)
            runs = window_hashes(windows.words, size)
            least, rarest, offset = np.full(len(own), np.iinfo(np.int64).max), np.zeros(len(own), np.uint64), np.zeros(len(own), np.int64)
            for o in range(int(windows.length[own].max()) - size + 1):
                has = np.flatnonzero(windows.length[own] - size >= o)
                h = runs[windows.start[own[has]] + o]
                n = counts[size][np.searchsorted(keys, h)]
                better = (n < least[has]) | (n == least[has]) & (h < rarest[has])
                at = has[better]
                least[at], rarest[at], offset[at] = n[better], h[better], o
            found = np.flatnonzero(least)  # a window with a shingle that the corpus lacks occurs nowhere
            found = found[np.argsort(rarest[found], kind="stable")]
            key, first = np.unique(rarest[found], return_index=True)
            if len(key):
                self.by[size] = (key, _filter(key), np.append(first, len(found)), own[found], offset[found])

    def probe(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every occurrence in rows that begin at ``first``."""
        starts, which = [], []
        for size, (keys, bits, at, window, offset) in self.by.items():
            runs = window_hashes(words, size)
            pos = np.flatnonzero(bits[runs & np.uint64((1 << _FILTER_BITS) - 1)])
            place = np.minimum(np.searchsorted(keys, runs[pos]), len(keys) - 1)
            same = keys[place] == runs[pos]
            pos, place = pos[same], place[same]
            n = at[place + 1] - at[place]
            entry = np.repeat(at[place] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            w = window[entry]
            row = np.repeat(np.searchsorted(first, pos, side="right") - 1, n)
            begin = np.repeat(pos, n) - offset[entry]
            fits = (begin >= first[row]) & (begin + self.length[w] <= first[row + 1])
            w, begin = w[fits], begin[fits]
            for length in np.unique(self.length[w]):
                own = self.length[w] == length
                for k in range(0, int(own.sum()), 1 << 16):  # bounds the comparison matrix
                    ww, bb = w[own][k : k + (1 << 16)], begin[own][k : k + (1 << 16)]
                    equal = (words[bb[:, None] + np.arange(length)] == self.words[self.start[ww][:, None] + np.arange(length)]).all(axis=1)
                    starts.append(bb[equal])
                    which.append(ww[equal])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *which])


def _filter(keys: np.ndarray) -> np.ndarray:
    """A table that rules out most hashes by their low bits."""
    bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
    bits[keys & np.uint64((1 << _FILTER_BITS) - 1)] = True
    return bits


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[int, Iterator[list[tuple[str | None, str | None]]]]:
    """The number of blocks, by the measured size of the table, and the items of one after the other."""
    rows = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text")).where("text is not null")
    n = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return n, ([(r.item, r.text) for r in dealt.where(F.col("block") == k).collect()] for k in range(n))


def _count(texts: DataFrame, windows: Windows) -> dict[int, np.ndarray]:
    """Corpus counts of the windows' shingles, by size; as many numbers as the index has shingles."""
    spark = texts.sparkSession
    shingles = windows.shingles()
    sent = spark.sparkContext.broadcast({k: (v, _filter(v)) for k, v in shingles.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(v), np.int64) for k, (v, _) in sent.value.items()}
        for batch in batches:
            for _, _, words, first, _ in word_groups(batch.column(0), ALNUM):
                for size, (keys, bits) in sent.value.items():
                    runs = window_hashes(words, size)
                    if size > 1 and len(runs):  # drop runs over row borders
                        cross = np.zeros(len(words) + 1, dtype=bool)
                        for k in range(1, size):
                            at = first[1:-1] - k
                            cross[at[at >= 0]] = True
                        runs = runs[~cross[: len(runs)]]
                    runs = runs[bits[runs & np.uint64((1 << _FILTER_BITS) - 1)]]
                    place = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
                    totals[size] += np.bincount(place[keys[place] == runs], minlength=len(keys))
        for size, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at])], ["size", "at", "n"])

    counts = {k: np.zeros(len(v), np.int64) for k, v in shingles.items()}
    if counts:
        found = texts.select("text").mapInArrow(trimmed(run), "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n")).toArrow()
        size, at, n = (found.column(c).to_numpy() for c in ("size", "at", "n"))
        for k in counts:
            counts[k][at[size == k]] = n[size == k]
    sent.unpersist()
    return counts


def _ranges(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:n]) > 0


def _scan(column: pa.Array, index: Index) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Per row: number of words, sorted positions of hit words, sorted items."""
    for a, b, words, first, _ in word_groups(column, ALNUM):
        starts, which = index.probe(words, first)
        mask = _ranges(starts, index.length[which], len(words))
        row = np.searchsorted(first, starts, side="right") - 1
        items: dict[int, set[int]] = {}
        for r, w in {*zip(row.tolist(), which.tolist(), strict=True)}:
            items.setdefault(r, set()).update(index.owners[index.owner_at[w] : index.owner_at[w + 1]].tolist())
        dirty = np.zeros(b - a, dtype=bool)
        dirty[row] = True
        nothing = np.zeros(0, np.int64)
        for r in range(b - a):
            hit = np.flatnonzero(mask[first[r] : first[r + 1]]) if dirty[r] else nothing
            yield int(first[r + 1] - first[r]), hit, sorted(index.names[i] for i in items.get(r, ()))


FOUND = "struct<n_words: long, hits: array<long>, items: array<string>>"
_FOUND = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, columns: list[str], id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, found: str = "found") -> DataFrame:
    """``columns`` of the documents and a column ``found``: the number of words, the
    positions of hit words and the items with occurring windows."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*[docs[c] for c in columns if c != "text"], docs["text"].cast("string").alias("text"))
    n, blocks = _blocks(benchmark, id_col, text_col)

    def index_of(items: list[tuple[str | None, str | None]]) -> Broadcast:
        windows = Windows(items, window, shingle)
        return spark.sparkContext.broadcast(Index(windows, _count(rows, windows)))

    def told(names: list[str], sent: Broadcast, hits_only: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Batches whose last column is the text, with what a block of items finds in place of it or after it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pa.array([{"n_words": w, "hits": hit.tolist(), "items": named} for w, hit, named in _scan(batch.column(batch.num_columns - 1), sent.value)], _FOUND)
                if hits_only:
                    some = pc.greater(pc.list_value_length(found.field("hits")), 0)
                    yield pa.RecordBatch.from_arrays([*(c.filter(some) for c in batch.columns[:-1]), found.filter(some)], names)
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns, found], names)

        return trimmed(run)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    if n == 1:
        return rows.mapInArrow(told([*rows.columns, found], index_of(next(blocks))), f"{shape}, `{found}` {FOUND}").select(*columns, found)

    # Only hits leave a pass over the texts; they are brought together by two hashes of the text.
    keyed = rows.select(F.xxhash64("text").alias("h"), F.xxhash64(F.lit("text"), "text").alias("i"), "text")
    parts = []
    for items in blocks:
        sent = index_of(items)
        hits = keyed.mapInArrow(told(["h", "i", "found"], sent, hits_only=True), f"h long, i long, found {FOUND}")
        parts.append(written(hits.groupBy("h", "i").agg(F.any_value("found").alias("found")), "hits"))
        sent.unpersist()
    both = reduce(DataFrame.union, parts).groupBy("h", "i").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items"))
    h, i, hits, items = (fresh(x, rows.columns) for x in ("h", "i", "hits", "items"))
    met = rows.withColumn(h, F.xxhash64("text")).withColumn(i, F.xxhash64(F.lit("text"), "text")).join(both.toDF(h, i, hits, items), [h, i], "left")
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long").alias("n_words")
    none = F.coalesce(F.col(hits), F.array().cast("array<long>")).alias("hits"), F.coalesce(F.col(items), F.array().cast("array<string>")).alias("items")
    return met.select(*columns, F.struct(n_words, *none).alias(found))


def contaminated(found: str = "found") -> F.Column:
    """The contamination rule over what ``benchmark_hits`` found."""
    hit = F.size(F.col(found)["hits"])
    return (hit > 0) & (MIN_SHARE * hit >= F.col(found)["n_words"])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = fresh("found", docs.columns)
    return benchmark_hits(docs, benchmark, docs.columns, found=found).where(~contaminated(found)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = benchmark_hits(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id", "text"])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.size("found.hits").cast("long").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.k, dw.n, iw.item FROM dw JOIN iw USING (n, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN named ON named.r = d.r
"""
