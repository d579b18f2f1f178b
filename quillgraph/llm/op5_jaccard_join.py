"""Exact Jaccard self-join of word shingle sets, with set-relation skipping.

1. Each text becomes its set of distinct 3-word shingles (64-bit hashes).  Equal
   sets are one node; copies are never paired.
2. Signatures.  Linked sets differ by few shingles.  Shingles are dealt by hash
   into more buckets than that, so linked sets have at least one bucket alike;
   a signature stands for all that a set has in a bucket, five shingles or
   more as a rule.  Unlike single shingles, which more texts share the more
   texts there are, it is shared by copies and hardly by others, so lists do
   not grow with the corpus.  The number of buckets goes by classes of sizes.
3. Lists of nodes by signature.  Short lists give pairs, but not those that
   agree in the bucket before, which are found there.  The nodes of long lists
   are compared by sketches: 512 bits, each the parity of the shingles that
   fall on it, so two sets differ by at least as many shingles as their
   sketches by bits, and no linked pair is lost.  Only edges of a spanning
   forest leave the list.  Lists of thousands are cut into blocks and compared
   two blocks at a time.
4. Both kinds of edges make groups of nodes that may link.  Each node's text is
   shipped once, compressed, to its group.
5. Inside a group an inverted index is kept in order of set size.  A leader's
   overlaps with all sets are counted from its lists, each list entered by
   position at the first size that can link (block skipping).  The overlaps of
   a set similar to the leader are derived from the leader's: minus the lists of
   shingles it lacks, plus the lists of those it has besides.  No pairs are put
   out, only each node's root and number of links.
6. Groups too heavy for a task are cut into blocks and handled two blocks at a
   time; their roots are joined by connected components.

Equality of shingles and sets is equality of 64- and 128-bit hashes.

Texts without words and nulls have empty sets and link with nothing.  A row
without doc_id links with nothing and has no component.  Rows of equal doc_id
but different sets are separate documents.  Repeated rows are copies and give
repeated results, an empty table gives an empty result, other columns are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .components import connected_components
from .shared import fresh, small_batches, written
from .textkit import groups, mix64, shingle_sets, text_buffers, trimmed

SIZE = 3
#: Sets link if 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Classes of sizes: the greatest size in each is so many times that of the one before, about.
RATIO = 1.45
#: One bucket in so many may be empty without more ado.
EMPTY = 20
#: Not used any more: shingles are not counted.
TOLD = 3
#: Bits of a sketch.
SKETCH = 512
_WORDS = SKETCH // 64
_SKETCH = [f"s{k}" for k in range(_WORDS)]
#: A set is derived from the leader if it has at least this share in common.
DERIVE = 0.6

_U = np.uint64


@dataclass(frozen=True)
class Limits:
    """Sizes that divide the work; results do not depend on them."""

    #: Lists up to this length give pairs.
    short: int = 24
    #: Nodes of a block of a long list.
    salted: int = 4_000
    #: Shingles of a block of a group.
    block: int = 1_000_000
    #: Bytes of rows that may be broadcast.
    broadcast: int = 32 << 20
    #: Not used any more: shingles are not counted.
    frequent_from: int = 16


def differences(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles at most in just one of two linked sets whose sizes add up to n."""
    return (100 - PERCENT) * n // (100 + PERCENT)


def _tops() -> np.ndarray:
    tops = [8]
    while tops[-1] < 1 << 40:
        tops.append(int(tops[-1] * RATIO))
    return np.array(tops)


_TOPS = _tops()


def signatures(s: np.ndarray) -> np.ndarray:
    """A signature per bucket, in order; 0 for an empty bucket and before each series of buckets.

    A pair meets in the class of its larger set, so a set takes part in the
    classes of all sizes from its own to the largest it can link with.  In a
    class linked sets have more buckets alike than may be empty.  Sets with
    more empty buckets are dealt once more by another hash, so that those that
    are alike in empty buckets alone meet there.
    """
    out, zero = [], np.zeros(1, dtype=np.uint64)
    first, last = np.searchsorted(_TOPS, [len(s), 100 * len(s) // PERCENT]).tolist()
    for c in range(first, last + 1):
        need = differences(2 * int(_TOPS[c])) + 1
        may_be_empty = need // EMPTY
        n, level, empty = need + may_be_empty, 0, may_be_empty + 1
        while need > 1 and empty > may_be_empty:  # else only equal sets link
            seed = mix64(np.full(1, c + (level << 16), dtype=np.uint64) * _U(0xE7037ED1A0B428DB) + _U(1))
            h = mix64(s ^ seed)
            bucket = ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)
            sums = np.zeros(n, dtype=np.uint64)
            np.add.at(sums, bucket, mix64(h + _U(0xA0761D6478BD642F)))
            signs = mix64(sums ^ mix64(seed + np.arange(1, n + 1, dtype=np.uint64)))
            signs[signs == 0] = 1
            there = np.zeros(n, dtype=bool)
            there[bucket] = True
            signs[~there] = 0
            empty, level = n - int(np.count_nonzero(there)), level + 1
            out += [zero, signs]
    return np.concatenate(out) if out else zero[:0]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a sorted set."""
    if not len(s):
        return 0, 0
    place = np.arange(1, len(s) + 1, dtype=np.uint64)
    a = mix64(s + place * _U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = mix64((s ^ _U(0xD6E8FEB86659FD93)) * (place * _U(2) + _U(1))).sum(dtype=np.uint64)
    return int(np.int64(a)), int(np.int64(b))


def sketch(s: np.ndarray) -> np.ndarray:
    """Per bit, whether an odd number of the set's shingles falls on it."""
    bits = np.bincount((mix64(s) >> _U(64 - 9)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray | int, nb: np.ndarray | int) -> np.ndarray:
    """Whether sets of sizes ``na``, ``nb`` with these sketches may link.

    Linked sets differ by at most (100 - PERCENT) / (100 + PERCENT) of both sizes.
    """
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (na + nb)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sets of a column, some rows at a time."""
    _, offs = text_buffers(column)
    for a, b in groups(offs):
        yield from shingle_sets(column.slice(a, b - a), SIZE)


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n, f1, f2 and sketch of each document."""
    names = ["doc_id", "n", "f1", "f2", *_SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in _sets(batch.column(1)):
                rows.append((len(s), *fingerprint(s), *sketch(s).view(np.int64).tolist()))
            columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * (3 + _WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names)

    return docs.mapInArrow(trimmed(run), ", ".join(f"{x} long" for x in names))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, f1, f2 and the signatures of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, parts = [], []
            for s in _sets(batch.column(1)):
                marks.append(fingerprint(s))
                parts.append(signatures(s))
            sizes = np.fromiter(map(len, parts), np.int32, len(parts))
            flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            f = np.array(marks, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), lists], ["doc_id", "f1", "f2", "signs"])

    return docs.mapInArrow(trimmed(run), "doc_id long, f1 long, f2 long, signs array<long>")


class _Lists:
    """Turns nodes sorted by (token, size, node) into pairs and members of long lists."""

    def __init__(self, short: int) -> None:
        self.short = short
        self.open: tuple[int, int] | None = None  # token and last size of a long list that goes on

    def take(self, token: np.ndarray, n: np.ndarray, node: np.ndarray, before: np.ndarray, last: bool) -> tuple[list[np.ndarray], int]:
        """Rows (0, a, b, n of a, n of b) and (1, token, node, n, 0), and how many input rows are used up.

        ``before``: the signature of the bucket before, 0 if there is none.
        """
        if not len(token):
            return [], 0
        # A new list starts with another key, or where sizes leave no possible link.
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < PERCENT * n[1:])
        goes_on = self.open is not None and self.open[0] == int(token[0]) and 100 * self.open[1] >= PERCENT * int(n[0])
        starts = np.flatnonzero(new)
        used = len(token)
        if not last and len(token) - starts[-1] <= self.short and not (len(starts) == 1 and goes_on):
            used = int(starts[-1])  # the last list may go on and is still short
            starts = starts[:-1]
            if not used:
                return [], 0
            token, n, node, before = token[:used], n[:used], node[:used], before[:used]
        length = np.diff(np.append(starts, used))
        which = np.repeat(np.arange(len(starts)), length)
        long = length > self.short
        if goes_on:
            long[0] = True
        if not last and used == len(new):
            long[-1] = True
        out = []
        for d in range(1, self.short):
            a = np.flatnonzero((which[d:] == which[:-d]) & ~long[which[d:]])
            if not len(a):
                break
            a = a[(100 * n[a] >= PERCENT * n[a + d]) & (node[a] != node[a + d]) & ((before[a] != before[a + d]) | (before[a] == 0))]
            out.append(np.stack([np.zeros(len(a), np.int64), node[a], node[a + d], n[a], n[a + d]]))
        own = np.flatnonzero(long[which])
        out.append(np.stack([np.ones(len(own), np.int64), token[own], node[own], n[own], np.zeros(len(own), np.int64)]))
        self.open = (int(token[-1]), int(n[-1])) if long[-1] else None
        return out, used


def _list_rows(batches: Iterator[pa.RecordBatch], short: int, chunk: int = 200_000) -> Iterator[pa.RecordBatch]:
    """``_Lists`` over the sorted rows (token, n, node, before) of a partition."""
    lists, held, size = _Lists(short), [], 0
    names = ["kind", "a", "b", "na", "nb"]

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 4
        rows, used = lists.take(*columns, last)
        held, size = ([[c[used:] for c in columns]], len(columns[0]) - used) if used < len(columns[0]) else ([], 0)
        for block in rows:
            if block.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in block], names)

    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in range(4)])
        size += batch.num_rows
        if size >= chunk:
            yield from flush(False)
    yield from flush(True)


def forest(n: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Per set, in ascending order of size, the first set it is joined to by pairs that may link."""
    label = np.arange(len(n))
    upto = np.searchsorted(n, 100 * n // PERCENT, side="right")
    for i in range(len(n) - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 : upto[i]] != label[i])
        for at in range(0, len(others), 1 << 15):
            part = others[at : at + (1 << 15)]
            near = part[may_link(sketches[part], sketches[i], n[part], n[i])]
            if len(near):
                met = np.unique(np.append(label[near], label[i]))
                label[np.isin(label, met)] = met[0]
    return label


def _tie_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the sorted rows (token, i, j, n, node, sketch)."""
    held: list[np.ndarray] = []

    def close(rows: np.ndarray) -> pa.RecordBatch | None:
        rows = rows[np.append(True, rows[1:, 4] != rows[:-1, 4])]
        if len(rows) < 2:
            return None
        node = rows[:, 4]
        label = forest(rows[:, 3], np.ascontiguousarray(rows[:, 5:]).view(np.uint64))
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[label[tied]]), pa.array(node[tied])], ["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy() for k in range(5 + _WORDS)], axis=1)
        if held:
            rows = np.concatenate([*held, rows])
        edge = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        for a, b in zip(np.append(0, edge)[:-1].tolist(), edge.tolist()):
            found = close(rows[a:b])
            if found is not None:
                yield found
        held = [rows[edge[-1] if len(edge) else 0 :]]
    if held and len(held[0]):
        found = close(held[0])
        if found is not None:
            yield found


def overlaps_within(sets: list[np.ndarray], weight: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(smallest linked-together index, weight of linked sets) of each set.

    ``first``: the block (0 or 1) of each set; pairs inside block 1, or inside
    block 0 when told so by the caller, are then not counted as links here.
    """
    k = len(sets)
    n = np.fromiter(map(len, sets), np.int64, k)
    order = np.argsort(n, kind="stable")
    size = n[order]
    flat = np.concatenate([sets[i] for i in order])
    _, token = np.unique(flat, return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(k), size)
    # Entries of all lists, by token and then by size order: position in a list is found by search.
    index = np.sort(token.astype(np.int64) * k + owner)
    root = np.arange(k)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def count(tokens: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """For the sets lo..hi-1 in size order, how many of ``tokens`` they have."""
        a = np.searchsorted(index, tokens * k + lo)
        m = np.searchsorted(index, tokens * k + hi) - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        return np.bincount(index[at] % k - lo, minlength=hi - lo)

    links = np.zeros(k, np.int64)
    w = weight[order]
    kind = None if first is None else first[order]

    def answer(i: int, overlap: np.ndarray, lo: int) -> None:
        own = size[lo : lo + len(overlap)]
        hit = lo + np.flatnonzero(100 * overlap >= PERCENT * (size[i] + own - overlap))
        hit = hit[hit != i]
        if kind is None:
            links[i] = w[hit].sum()
        else:
            links[i] = w[hit[(kind[hit] != kind[i]) | (kind[hit] == 0)]].sum()
        me = top(i)
        for j in hit[root[hit] != me].tolist():
            other = top(j)
            if other != me:
                root[max(me, other)] = min(me, other)
                me = min(me, other)

    done = np.zeros(k, dtype=bool)
    for leader in range(k - 1, -1, -1):
        if done[leader]:
            continue
        mine = token[begin[leader] : begin[leader + 1]].astype(np.int64)
        # Sets derived from this leader are not smaller than DERIVE of it, and link down to PERCENT of that.
        lo = int(np.searchsorted(size, np.floor(size[leader] * DERIVE * PERCENT / 100)))
        hi = k
        base = count(mine, lo, hi)
        union = size[leader] + size[lo:hi] - base
        answer(leader, base, lo)
        done[leader] = True
        for i in (lo + np.flatnonzero((base >= DERIVE * union) & ~done[lo:hi])).tolist():
            own = token[begin[i] : begin[i + 1]].astype(np.int64)
            lacks, adds = np.setdiff1d(mine, own, assume_unique=True), np.setdiff1d(own, mine, assume_unique=True)
            overlap = base
            if len(lacks):
                overlap = overlap - count(lacks, lo, hi)
            if len(adds):
                overlap = overlap + count(adds, lo, hi)
            answer(i, overlap, lo)
            done[i] = True
    back = np.empty(k, np.int64)
    back[order] = order[[top(i) for i in range(k)]]
    out = np.empty(k, np.int64)
    out[order] = links
    return back, out


def _packed(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(texts: list[bytes]) -> list[np.ndarray]:
    """The sets of packed texts, some texts at a time."""
    out: list[np.ndarray] = []
    for k in range(0, len(texts), 256):
        raw = [pa.decompress(memoryview(x)[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) for x in texts[k : k + 256]]
        out += _sets(pa.array(raw, pa.large_binary()).view(pa.large_string()))
    return out


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots and links of sorted rows (cluster, i, j, blocks, block, node, copies, text)."""
    held: list[tuple] = []
    key = None

    def close() -> pa.RecordBatch:
        node = np.array([r[0] for r in held], np.int64)
        copies = np.array([r[1] for r in held], np.int64)
        sets = _unpacked([r[2] for r in held])
        blocks, i, j = key[3], key[1], key[2]
        if len(held) == 2 and blocks == 1:
            a, b = sets
            both = len(np.intersect1d(a, b, assume_unique=True))
            linked = 100 * both >= PERCENT * (len(a) + len(b) - both)
            part, links = (np.zeros(2, np.int64), copies[::-1]) if linked else (np.arange(2), np.zeros(2, np.int64))
        else:
            first = None
            if blocks > 1:
                # Pairs inside a block are counted in one of its groups, the one with the next block.
                inside = i if (i + 1) % blocks == j else j if (j + 1) % blocks == i else -1
                first = np.array([0 if r[3] == inside else 1 + (r[3] == j) for r in held])
            part, links = overlaps_within(sets, copies, first)
        least = np.full(len(held), np.iinfo(np.int64).max)
        np.minimum.at(least, part, node)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(least[part]), pa.array(links), pa.array(np.full(len(held), blocks, np.int64))], ["node", "root", "links", "blocks"])

    for batch in batches:
        columns = [batch.column(c) for c in range(8)]
        keys = list(zip(*(columns[c].to_pylist() for c in range(4)), strict=True))
        block, node, copies = (columns[c].to_pylist() for c in (4, 5, 6))
        for r, k in enumerate(keys):
            if k == key and held and held[-1][0] == node[r]:
                continue  # a repeated row
            if k != key:
                if len(held) > 1:
                    yield close()
                held, key = [], k
            held.append((node[r], copies[r], columns[7][r].as_py(), block[r]))
    if len(held) > 1:
        yield close()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (linked documents, copies included) of each row."""
    told, named = _classes(docs, id_col, text_col, limits)
    known = told.join(named, ["f1", "f2", "n"], "left")
    return known.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def _classes(docs: DataFrame, id_col: str, text_col: str, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, f1, f2) of each row, and (f1, f2, n, root, component, n_links) of each set that rows with an id have."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    profiles = written(_profiles(rows), "profiles", gather=True)
    told = profiles.select("doc_id", "n", "f1", "f2")
    n_rows = told.count()
    nodes = profiles.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *[F.first(x).alias(x) for x in _SKETCH])
    # A node is called by the smallest doc_id of its set; further sets of the same doc_id get other, negative names.
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("f1", "f2"))
    nodes = written(nodes.withColumn("k", place).select("f1", "f2", "n", "doc_id", "copies", F.when(F.col("k") == 1, F.col("doc_id")).otherwise(-1 - F.abs(F.xxhash64("doc_id", "k") % (1 << 62))).alias("node"), *_SKETCH), "nodes", rows=n_rows)

    # Lists by signature.
    signed = _signed(rows.where("doc_id IS NOT NULL")).join(nodes.select("doc_id", "f1", "f2", "n", "node"), ["doc_id", "f1", "f2"])
    each = "filter(transform(signs, (x, i) -> struct(x AS token, get(signs, i - 1) AS before)), y -> y.token <> 0)"
    posts = signed.select(F.explode(F.expr(each)).alias("post"), "node", "n")
    ordered = ["token", "n", "node"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = "kind long, a long, b long, na long, nb long"
    listed = written(posts.select("post.token", "n", "node", "post.before").repartition(parts, "token").sortWithinPartitions(*ordered).mapInArrow(trimmed(lambda rows: _list_rows(rows, limits.short)), kinds), "lists", gather=True)
    pairs = listed.where("kind = 0").select("a", "b")
    # A linked pair with a common signature in a long list is found there, whatever else it shares.
    long = listed.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"))
    cut = long.groupBy("token").agg(F.count("*").alias("length")).where(F.col("length") > 2 * limits.salted)
    cut = cut.select("token", F.greatest(F.lit(3), F.ceil(F.col("length") / limits.salted)).cast("long").alias("blocks"))
    # One row of 16 bytes for at least 2 * salted members.
    small = listed.where("kind = 1").count() // (2 * limits.salted) * 16 <= limits.broadcast
    long = long.join(F.broadcast(cut) if small else cut, "token", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.expr("CASE WHEN blocks IS NULL THEN array(0L) ELSE filter(sequence(0L, blocks - 1), x -> x <> block) END"))
    sides = ["token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "n", "node", *_SKETCH]
    placed = long.join(nodes.select("node", "n", *_SKETCH), "node").withColumn("other", other).withColumn("block", F.coalesce("block", F.lit(0))).select(*sides)
    by_size = ["token", "i", "j", "n", "node"]
    ties = written(placed.repartition(parts, "token", "i", "j").sortWithinPartitions(*by_size).mapInArrow(trimmed(_tie_rows), "a long, b long"), "ties", gather=True)

    # Groups of nodes that may link; what is in none has no link.
    grouped = connected_components(pairs.union(ties), "groups")
    roots = grouped.select(F.col("root").alias("node"), "root").distinct()
    members = grouped.union(roots).join(nodes, "node")
    weights = members.groupBy("root").agg(F.sum("n").alias("weight"))
    blocks = F.when(F.col("weight") <= 2 * limits.block, 1).otherwise(F.greatest(F.lit(3), F.ceil(F.col("weight") / limits.block))).cast("long")
    members = members.join(weights.select("root", blocks.alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    members = written(members.select("root", "blocks", "block", "node", "copies", "doc_id", "f1", "f2"), "members", rows=n_rows)

    # Ship each member's text to its group, or to all groups of its block.
    size = members.count() * 80
    picked = rows.join(F.broadcast(members) if size <= limits.broadcast else members, "doc_id")

    def with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                f = np.array([fingerprint(s) for s in _sets(part.column("text"))], np.int64).reshape(-1, 2)
                own = pa.array((f[:, 0] == part.column("f1").to_numpy()) & (f[:, 1] == part.column("f2").to_numpy()))
                part = part.filter(own)
                columns = [part.column(c) for c in ("root", "blocks", "block", "node", "copies")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([_packed(x.as_py()) for x in part.column("text")], pa.binary())], ["root", "blocks", "block", "node", "copies", "packed"])

    shipped = picked.select("root", "blocks", "block", "node", "copies", "f1", "f2", "text").mapInArrow(trimmed(with_texts), "root long, blocks long, block long, node long, copies long, packed binary")
    others = F.expr("CASE WHEN blocks = 1 THEN array(0L) ELSE filter(sequence(0L, blocks - 1), x -> x <> block) END")
    shipped = shipped.withColumn("other", F.explode(others)).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "blocks", "block", "node", "copies", "packed")
    order = ["root", "i", "j", "blocks", "node"]
    found = written(shipped.repartition(parts, "root", "i", "j").sortWithinPartitions(*order).mapInArrow(trimmed(_group_rows), "node long, root long, links long, blocks long"), "found", gather=True)

    # Whole groups are settled; the roots of blocks are joined.
    single = found.where("blocks = 1").select("node", "root", "links")
    cut = found.where("blocks > 1")
    if cut.isEmpty():
        labels = single
    else:
        joined = connected_components(cut.select(F.col("node").alias("a"), F.col("root").alias("b")), "roots")
        links = cut.groupBy("node").agg(F.sum("links").alias("links"))
        labels = single.union(links.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "links"))
    named = nodes.join(labels, "node", "left").select("f1", "f2", "n", "doc_id", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    # A root is the smallest name; only a component with a negative name has another smallest doc_id.
    odd = named.where("root < 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = named.join(odd, "root", "left").select("f1", "f2", "n", "root", F.coalesce("least", "root").alias("component"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return told, named


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per component, all columns kept: one with its smallest doc_id.

    Rows without doc_id stay, and so does every row that is linked with none,
    whatever other rows have its doc_id; of equal rows one stays.
    """
    told, named = _classes(docs, "doc_id", "text", Limits())
    named = written(named, "named")
    found = written(told.join(named, ["f1", "f2", "n"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")), "classes", rows=docs.count())
    gone = found.where("doc_id <> component").select("doc_id").distinct()
    repeated = written(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")

    def small(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() * 40 <= Limits().broadcast else ids

    if repeated.isEmpty():
        return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(small(repeated), "doc_id", "left_anti").join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(_one_of_repeated(docs.join(small(repeated), "doc_id", "left_semi").select(*docs.columns), named))


def _one_of_repeated(docs: DataFrame, named: DataFrame) -> DataFrame:
    """``one_of_each`` for rows that share their doc_id with others, each judged by its own set."""
    columns = docs.columns
    f1, f2, n = fresh("f1", columns), fresh("f2", columns), fresh("n", columns)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(at).cast(pa.string())))
            f = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array([len(s) for s in sets], pa.int64())], [*batch.schema.names, f1, f2, n])

    marked = docs.mapInArrow(trimmed(run), StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in (f1, f2, n))]))
    own = named.select(*(F.col(c).alias(f"class_{c}") for c in ("f1", "f2", "n", "root", "component")))
    met = marked.join(own, (marked[f1] == own["class_f1"]) & (marked[f2] == own["class_f2"]) & (marked[n] == own["class_n"]), "left")
    met = met.withColumn("class_text", F.xxhash64("text")).where("class_component IS NULL OR class_component = doc_id")
    # Rows without words are in no class: each text stays once.
    least = met.where("class_root IS NOT NULL").groupBy(F.col("class_root").alias("least_root")).agg(F.min(F.struct("class_f1", "class_f2", "class_text")).alias("least"))
    first = F.struct("class_f1", "class_f2", "class_text")
    kept = met.join(least, met["class_root"] == least["least_root"], "left").where(F.col("class_root").isNull() | (first == F.col("least")))
    return kept.dropDuplicates(["doc_id", "text"]).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS z FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.z),
k AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)
"""
