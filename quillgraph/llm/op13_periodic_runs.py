"""Periodic runs: stretches of words that repeat with a fixed period.

A run is a stretch with smallest period q (words q apart are identical) of at
least ``MIN_LENGTH`` words and ``2 * q``, which no neighbouring word extends.
Where something is periodic, a block of it comes again one period later.  So
the document is cut into blocks of b = 2, 4, 8, ... words, aligned to multiples
of b, and all blocks of one size are searched for in the whole document by one
Aho-Corasick automaton over word numbers.  A run of period q holds at least
``max(q, MIN_LENGTH - q)`` words that come again q words later, and any stretch
of 2b - 1 words holds an aligned block.  Every period hence belongs to one size,
the largest b with 2b - 1 within that number, and only occurrences at distances
of that size are seeds.  A seed is extended word by word to both sides, which
gives the run exactly.  A stretch found with several periods has the smallest
one, of which the others are multiples.

Blocks with a pair of neighbouring words that comes only once in the document
can't come again and are neither built nor searched.  Inside a run of a period
of at most b / 2, which is known from smaller sizes, no seeds are taken, and
what is left without a place to come again is not searched for.

Documents are independent, so nothing is shuffled.  Words are compared
themselves, not by hashes.  Nulls and empty texts have no words and no runs.
Repeated rows give repeated results, also under one id; an empty table gives an
empty result; other columns are neither read nor returned.  Very long texts are
handled whole, in memory of some hundred bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import bound
from .shared import small_batches
from .textkit import trimmed

MIN_LENGTH = 12
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def distances(size: int, min_length: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """The periods that belong to blocks of ``size`` words, as ranges (from, to)."""
    half = -(-min_length // 2)
    low = (max(1, min_length - 4 * size + 2), min(min_length - 2 * size + 1, half - 1))
    high = (max(2 * size - 1, half), 4 * size - 2)
    return [r for r in (low, high) if r[0] <= r[1]]


def _stretch(ids: np.ndarray, at: int, size: int, q: int) -> tuple[int, int]:
    """The longest [s, t) around ``at`` whose words come again q later; [at, at + size) do."""
    last, t, step = len(ids) - q, at + size, 64
    while t < last:
        apart = ids[t : min(t + step, last)] != ids[t + q : min(t + step, last) + q]
        k = int(apart.argmax())
        if apart[k]:
            t += k
            break
        t, step = t + len(apart), 2 * step
    s, step = at, 64
    while s > 0:
        a = max(0, s - step)
        apart = (ids[a:s] != ids[a + q : s + q])[::-1]
        k = int(apart.argmax())
        if apart[k]:
            s -= k
            break
        s, step = a, 2 * step
    return s, t


def _recurring(ids: np.ndarray) -> np.ndarray:
    """Which pairs of neighbours come more than once in the text."""
    pairs = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    again = np.zeros(len(pairs), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again


def _pieces(joined: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The stretches [a, b) of at least ``size`` words whose neighbours are joined."""
    edges = np.flatnonzero(np.diff(joined.view(np.int8), prepend=0, append=0))
    return [(a, b + 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b + 1 - a >= size]


class _Size:
    """The search for the aligned blocks of one size."""

    def __init__(self, again: np.ndarray, size: int, min_length: int, known: dict[tuple[int, int], int]):
        self.size, self.n = size, len(again) + 1
        pieces = _pieces(again, size)
        aligned = [np.arange(-(-a // size) * size, b - size + 1, size) for a, b in pieces]
        places = np.concatenate(aligned) if aligned else np.zeros(0, np.int64)
        self.any = len(places) > 0
        # Inside a known run of a short period a block's occurrences say nothing new; those beyond its end may.
        ends = np.zeros(self.n // size + 1, dtype=np.int64)
        for (s, e), p in known.items():
            if 2 * p <= size:
                ends[-(-s // size) : max(0, (e - size) // size + 1)] = e
        floor = np.maximum(0, ends[places // size] - size + 1)
        self.ranges = []
        for least, most in distances(size, min_length):
            # The smallest period of a known run may be one of the short ones that belong to a later size.
            low = places + least if 2 * least < min_length else np.maximum(places + least, floor)
            high = np.minimum(places + most, self.n - size)
            own = low <= high
            self.ranges.append((places[own], low[own], high[own]))

    def seeds(self, words: list[int], again: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """By ascending distance: the distance and the places of the blocks that come again there."""
        import ahocorasick

        size, wide = self.size, self.n + 1
        search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        number: dict[tuple, int] = {}
        edges = np.zeros(wide, dtype=np.int64)
        named = []
        for places, low, high in self.ranges:
            blocks = [number.setdefault(tuple(words[x : x + size]), len(number)) for x in places.tolist()]
            named.append(np.array(blocks, dtype=np.int64))
            np.add.at(edges, low, 1)
            np.add.at(edges, high + size, -1)
        if not number:
            return []
        for key, k in number.items():
            search.add_word(key, k)
        search.make_automaton()
        used = np.cumsum(edges[:-1]) > 0
        found, where = [], []
        for a, b in _pieces(again & used[:-1] & used[1:], size):
            for last, k in search.iter(tuple(words[a:b])):
                found.append(k)
                where.append(a + last + 1 - size)
        seen = np.sort(np.array(found, dtype=np.int64) * wide + np.array(where, dtype=np.int64))
        at, apart = [], []
        for blocks, (places, low, high) in zip(named, self.ranges, strict=True):
            a, b = np.searchsorted(seen, blocks * wide + low), np.searchsorted(seen, blocks * wide + high, side="right")
            x = np.repeat(places, b - a)
            k = np.arange(len(x)) + np.repeat(b - np.cumsum(b - a), b - a)
            at.append(x)
            apart.append(seen[k] % wide - x)
        x, q = np.concatenate(at), np.concatenate(apart)
        order = np.lexsort((x, q))
        x, q = x[order], q[order]
        cuts = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), len(q)]
        return [(int(q[i]), x[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]


def find_runs(words: list, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if min_length < 6:
        raise ValueError("runs of fewer than 6 words are not found by blocks")
    n = len(words)
    if n < min_length:
        return []
    code: dict = {}
    own = [code.setdefault(w, len(code)) for w in words]
    ids = np.array(own, dtype=np.int64)
    again = _recurring(ids)
    periods: dict[tuple[int, int], int] = {}
    size = 2
    while 2 * size - 1 <= max(n // 2, min_length):
        blocks = _Size(again, size, min_length, periods)
        if not blocks.any:
            break
        for q, places in blocks.seeds(own, again):
            i = 0
            while i < len(places):
                s, t = _stretch(ids, int(places[i]), size, q)
                if t - s + q >= max(min_length, 2 * q):
                    periods[s, t + q] = min(q, periods.get((s, t + q), q))
                i = int(np.searchsorted(places, t))  # other blocks of the same stretch say the same
        size *= 2
    return sorted((s, e - s, q) for (s, e), q in periods.items())


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that only repeat: of each run the first period stays."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs and the collapsed text of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                words = (text.as_py() or b"").split()  # at ASCII white space
                own = find_runs(words, min_length)
                counts.append(len(words))
                runs.append([{"start": s, "length": k, "period": q} for s, k, q in own])
                texts.append(b" ".join(collapsed(words, own)))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(trimmed(run), SCHEMA)


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text in which one document in ten, by its id, repeats its own words from some word on.

    Documents without an id stay as they are.
    """
    number = f"crc32(cast({doc_id} AS string))"
    words = f"regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"
    made = "array_join(transform(sequence(0, size(w) - 1), i -> get(w, int(if(i < a, i, a + (i - a) % p)))), ' ')"
    made = bound("1 + (size(w) - a) div (3 + g % 8)", "p", made)
    made = bound("g % size(w)", "a", made)
    made = bound(words, "w", f"if(size(w) > 0, {made}, '')")
    made = bound(f"{number} div 10", "g", made)
    return F.expr(f"if({number} % 10 = 0, {made}, {text})")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, of which one in ten is given a periodic end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", planted().alias("text")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    listed = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
