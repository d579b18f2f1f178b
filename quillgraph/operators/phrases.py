"""Occurrences of many phrases in many texts, by a join on rare grams.

Every phrase is known by one of its grams, runs of 8, 4, 2 or 1 bytes (the
longest that fits), namely the one that the fewest phrases share.  A pass over
the texts emits the places where such a gram stands, with as much text around
as a phrase with it could need; an equi-join on the gram brings the phrases in,
and their bytes are compared.  Neither the texts nor the phrases are held by
any process: executors keep a bitmap that tells which grams are worth emitting,
of ``MAX_BITS`` bits at most however many phrases there are, and two small
tables of how far phrases reach.

Where only whole words count, a phrase of nothing but word characters is found
as a word.  Within words it could only get in the way of phrases that go beyond
one, so there its grams are looked for just around places where such a phrase
may stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored

SIZES = (8, 4, 2, 1)
#: The bitmap has this many bits a phrase, between these bounds.
BITS = 64
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
PROBES = 3
#: Grams are counted, and reaches are kept, by this many classes of hashes.
COUNTED = 1 << 20
REACHES = 1 << 14
#: Bytes of text looked at together.
CHUNK = 1 << 20

#: What a candidate may be: the gram of a phrase that goes beyond a word, the gram of a word near one, or a word.
GRAM, INNER, WORD = range(3)
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x41:0x5B] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x5F] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

_U = np.uint64
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
_NEWLINE, _HYPHEN = 10, 0x2D


def _hashes(grams: np.ndarray, size: int) -> np.ndarray:
    """Of grams as little-endian numbers."""
    h = (grams ^ _U(size * 0x9E37)) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _numbers(data: np.ndarray, size: int) -> np.ndarray:
    """The gram that starts at each byte, as a number; those that pass the end are cut off."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((n,), "<u8", padded, strides=(1,)) & _U((1 << 8 * size) - 1)


def keyed(phrases: DataFrame) -> DataFrame:
    """(phrase, raw, gram, at) of distinct phrases: the bytes, and the gram to find them by and where it stands.

    How many phrases share a gram is counted by hashes, so a gram that all of
    them share is one sum, and the sums are of bounded size.
    """
    raw = phrases.where("phrase <> ''").select("phrase").distinct().select("phrase", F.expr("cast(phrase AS binary)").alias("raw"))
    size = F.expr("CASE WHEN octet_length(raw) >= 8 THEN 8 WHEN octet_length(raw) >= 4 THEN 4 WHEN octet_length(raw) >= 2 THEN 2 ELSE 1 END")
    placed = raw.withColumn("size", size).withColumn("at", F.explode(F.expr("sequence(0, octet_length(raw) - size)")))
    grams = placed.withColumn("gram", F.expr("substring(raw, at + 1, size)")).withColumn("class", F.pmod(F.xxhash64("gram"), F.lit(COUNTED)))
    shared = grams.groupBy("class").agg(F.count("*").alias("n"))
    best = grams.join(F.broadcast(shared), "class").groupBy("phrase", "raw").agg(F.min(F.struct("n", "at", "gram")).alias("best"))
    return best.select("phrase", "raw", "best.gram", "best.at")


def _with_kinds(keys: DataFrame, words: bool) -> DataFrame:
    """Every key as a gram; with ``words`` those of one word as an inner gram, and as a word."""
    if not words:
        return keys.withColumn("kind", F.lit(GRAM))
    one = F.col("phrase").rlike("^[A-Za-z0-9_]+\\z")
    grams = keys.withColumn("kind", F.when(one, INNER).otherwise(GRAM))
    return grams.unionByName(keys.where(one).select("phrase", "raw", F.col("raw").alias("gram"), F.lit(0).alias("at"), F.lit(WORD).alias("kind")))


def _word_hashes(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of words, by their first and last eight bytes and their length."""
    return _hashes(first ^ (last * _U(0xC2B2AE3D27D4EB4F)) ^ (size.astype(np.uint64) << _U(32)), 9)


class _Wanted:
    """Which grams and words to emit, and how far phrases reach around them."""

    def __init__(self, bits: np.ndarray, before: np.ndarray, after: np.ndarray, sizes: dict[int, list[int]]):
        self.bits, self.before, self.after, self.sizes = bits, before, after, sizes

    @classmethod
    def of(cls, keys: DataFrame) -> _Wanted:
        """One aggregate over the keys, of any kind; its result has a bounded number of rows."""
        length = F.when(F.col("kind") == WORD, 0).otherwise(F.octet_length("gram"))
        counts = keys.groupBy("kind", length.alias("size")).agg(F.count("*").alias("n")).collect()
        n_bits = MIN_BITS
        while n_bits < min(MAX_BITS, BITS * sum(r.n for r in counts)):
            n_bits *= 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams, kind = batch.column(0).to_pylist(), batch.column(3).to_numpy()
                size = np.array([len(g) for g in grams], dtype=np.int64)
                first, last = (np.array([int.from_bytes(g, "little") for g in part], dtype=np.uint64) for part in ([g[:8] for g in grams], [g[-8:] for g in grams]))
                h = np.where(kind == WORD, _word_hashes(first, last, size), _U(0))
                for k in SIZES:
                    own = (size == k) & (kind != WORD)
                    h[own] = _hashes(first[own], k)
                h += kind.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
                at, rest = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                slots, masks = [], []
                for k in range(PROBES):
                    bit = _probe(h, k, n_bits)
                    slots.append((bit >> _U(6)).astype(np.int64))
                    masks.append((_U(1) << (bit & _U(63))).view(np.int64))
                none = np.zeros(PROBES * len(h), dtype=np.int32)
                slots.append(-1 - (h % _U(REACHES)).astype(np.int64))
                masks.append(np.zeros(len(h), dtype=np.int64))
                columns = [np.concatenate(slots), np.concatenate(masks), np.concatenate([none, at]), np.concatenate([none, rest])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "mask", "before", "after"])

        told = keys.select("gram", F.col("at").cast("int").alias("at"), (F.octet_length("raw") - F.col("at")).cast("int").alias("rest"), "kind").mapInArrow(run, "slot long, mask long, before int, after int")
        rows = told.groupBy("slot").agg(F.bit_or("mask").alias("mask"), F.max("before").alias("before"), F.max("after").alias("after")).toArrow()
        slot, mask, before, after = (rows.column(k).to_numpy() for k in range(4))
        bits, reach = np.zeros(n_bits // 64, dtype=np.uint64), slot < 0
        bits[slot[~reach]] = mask[~reach].view(np.uint64)
        out = [np.zeros(REACHES, dtype=np.int64) for _ in range(2)]
        for table, column in zip(out, (before, after), strict=True):
            table[-1 - slot[reach]] = column[reach]
        return cls(bits, *out, {kind: sorted(r["size"] for r in counts if r.kind == kind) for kind in (GRAM, INNER, WORD)})

    def _kept(self, h: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = h + _U(kind * 0x9E3779B97F4A7C15 % (1 << 64))
        at = np.arange(len(h))
        for k in range(PROBES):
            bit = _probe(h, k, len(self.bits) * 64)
            hit = (self.bits[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1
            h, at = h[hit], at[hit]
        near = (h % _U(REACHES)).astype(np.int64)
        return at, self.before[near], self.after[near]

    def places(self, data: np.ndarray, size: int, kind: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a gram of the size that may be a key starts, and the reaches there."""
        return self._kept(_hashes(_numbers(data, size), size), kind)

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the words data[start:end] may be keys."""
        wide = _numbers(np.concatenate([data, np.zeros(8, dtype=np.uint8)]), 8)
        mask = _MASKS[np.minimum(end - start, 8)]
        return self._kept(_word_hashes(wide[start] & mask, wide[np.maximum(start, end - 8)] & mask, end - start), WORD)[0]

    def candidates(self, data: np.ndarray, edges: np.ndarray, chunk: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, start, length, bytes before, bytes from the start on) of what may be a key; ``edges``: where texts begin."""
        regions = [np.zeros((2, 0), dtype=np.int64)]
        slices = list(_slices(data, chunk))
        for size in self.sizes[GRAM]:
            for x, y in slices:
                at, before, after = self.places(data[x : y + size - 1], size)
                at = at + x
                regions.append(np.stack([at - before, at + after]))
                yield GRAM, at, np.full(len(at), size), before, after
        if not self.sizes[WORD]:
            return
        near = np.concatenate(regions, axis=1)
        for x, y in slices:
            part = data[x:y]
            start, end = _words(part, edges[np.searchsorted(edges, x) : np.searchsorted(edges, y)] - x)
            touched = _touched(start + x, end + x, *near)
            if touched.any():
                for size in self.sizes[INNER]:
                    at, before, after = self.places(part, size, INNER)
                    w = np.searchsorted(start, at, side="right") - 1
                    own = touched[w] & (w >= 0)
                    yield INNER, at[own] + x, np.full(int(own.sum()), size), before[own], after[own]
            start, end = start[~touched], end[~touched]
            own = self.words(part, start, end)
            yield WORD, start[own] + x, (end - start)[own], np.zeros(len(own), dtype=np.int64), (end - start)[own]


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of word characters; ``edges``: where texts begin."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = _IN_WORD[data]
    joined = inside[:-1].copy()  # whether a byte goes on from the one before
    joined[1:] &= inside[:-2]
    joined[:1] = False
    joined[edges] = False
    starts = np.flatnonzero(inside[:-1] & ~joined)
    goes_on = np.append(joined[1:], False)
    return starts, np.flatnonzero(inside[:-1] & ~goes_on) + 1


def _touched(start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the stretches [start, end) meet one of the regions [a, b)."""
    order = np.argsort(a, kind="stable")
    furthest = np.concatenate([[-1], np.maximum.accumulate(b[order])])
    return furthest[np.searchsorted(a[order], end)] > start


def _probe(h: np.ndarray, k: int, n_bits: int) -> np.ndarray:
    return (h + _U(k) * ((h >> _U(32)) | _U(1))) & _U(n_bits - 1)


_FOUND = [("kind", "int"), ("range_no", "int"), ("gram", "binary"), ("place", "int"), ("low", "int"), ("high", "int"), ("from", "int"), ("line", "int"), ("col", "int"), ("near", "binary")]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins; a null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), offs


def _prose(ranges: pa.Array, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, number in the row, begin and end (in all texts) of the prose ranges, in order."""
    doc = pc.list_parent_indices(ranges).to_numpy()
    flat = ranges.flatten()
    number = (np.arange(len(doc)) - np.searchsorted(doc, doc)).astype(np.int32)
    a, b = (flat.field(k).to_numpy().astype(np.int64) + offs[doc] for k in ("start", "end"))
    own = np.flatnonzero(pc.equal(flat.field("kind"), "prose").to_numpy(zero_copy_only=False))
    own = own[np.argsort(a[own], kind="stable")]
    return doc[own], number[own], a[own], b[own]


def _chunks(offs: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Pieces of about ``size`` bytes: whole texts, or one text that is longer."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        if offs[j] > offs[i]:
            yield int(offs[i]), int(offs[j])
        i = j


def _slices(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Pieces of about ``size`` bytes that do not divide a word; they bound the temporary arrays."""
    x = 0
    while x < len(data):
        y = min(x + size, len(data))
        while y < len(data) and _IN_WORD[data[y - 1]] and _IN_WORD[data[y]]:
            on = _IN_WORD[data[y : y + size]]
            y += len(on) if on.all() else int(on.argmin())
        yield x, y
        x = y


def _piece(raw: np.ndarray, i: int, j: int, fold: bool) -> bytes:
    piece = raw[i:j].tobytes()
    return piece.lower() if fold else piece  # of bytes: A-Z only


def _candidates(texts: DataFrame, wanted: _Wanted, fold: bool, keep: list[str]) -> DataFrame:
    """The places of possible keys, with the text around them.

    ``place``, ``low``, ``high``: where the gram and the range's ends are in
    ``near``, whose first byte is at ``from``, in that ``line`` and ``col``.
    """
    sent = texts.sparkSession.sparkContext.broadcast(wanted)
    ranged = "ranges" in texts.columns
    schema = T.StructType([*(texts.schema[c] for c in keep), *(T.StructField(n, getattr(T, f"{'Integer' if k == 'int' else 'Binary'}Type")()) for n, k in _FOUND)])
    kinds = [pa.int32() if k == "int" else pa.binary() for _, k in _FOUND]

    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = _bytes(batch.column(len(keep)))
            doc, number, a, b = _prose(batch.column(len(keep) + 1), offs) if ranged else (np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32), offs[:-1], offs[1:])
            breaks = None
            for x, y in _chunks(offs, chunk) if len(a) else ():
                data = _FOLDED[raw[x:y]] if fold else raw[x:y]
                for kind, at, size, before, after in sent.value.candidates(data, offs[np.searchsorted(offs, x) : np.searchsorted(offs, y)] - x, chunk):
                    at = at + x
                    r = np.searchsorted(a, at, side="right") - 1
                    own = (r >= 0) & (at + size <= b[r])
                    if not own.any():
                        continue
                    at, size, before, after, r = at[own], size[own], before[own], after[own], r[own]
                    begin = np.maximum(offs[doc[r]], np.maximum(a[r], at - before) - 2)
                    end = np.minimum(offs[doc[r] + 1], np.minimum(b[r], at + after) + 2)
                    if breaks is None:
                        breaks = np.flatnonzero(raw[: int(offs[-1])] == _NEWLINE)
                    nth, first = np.searchsorted(breaks, begin), np.searchsorted(breaks, offs[doc[r]])
                    line_at = np.where(nth > first, breaks[np.maximum(nth, 1) - 1] + 1 if len(breaks) else 0, offs[doc[r]])
                    near = [_piece(raw, i, j, fold) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
                    grams = [n[i : i + k] for n, i, k in zip(near, (at - begin).tolist(), size.tolist(), strict=True)]
                    told = [np.full(len(at), kind), number[r], grams, at - begin, np.maximum(0, a[r] - begin), b[r] - begin, begin - offs[doc[r]], nth - first + 1, begin - line_at + 1, near]
                    columns = batch.select(keep).take(pa.array(doc[r])).columns
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(told, kinds, strict=True))], [*keep, *(n for n, _ in _FOUND)])

    return texts.select(*keep, "source", *(["ranges"] if ranged else [])).mapInArrow(run, schema)


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The pieces of data, ASCII all, as strings."""
    ends = np.cumsum(size)
    flat = data[np.arange(int(size.sum())) + np.repeat(start - ends + size, size)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(flat))


def _hyphened(data: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of the words data[start:end] are part of a hyphenated name within the text data[low:high]; as ``_free``."""
    (left, far_left), (right, far_right) = ([data[np.clip(i, 0, len(data) - 1)] for i in pair] for pair in ((start - 1, start - 2), (end, end + 1)))
    named = _IN_WORD.copy()
    named[0x5F] = False
    return (start - 2 >= low) & (left == _HYPHEN) & named[far_left] | (end + 1 < high) & (right == _HYPHEN) & named[far_right]


def _tallies(texts: DataFrame, wanted: _Wanted, fold: bool, keep: list[str]) -> DataFrame:
    """How often (n) each word that may be a phrase stands free in the prose of a text: one row for both.

    For phrases of one word each; their occurrences do not leave the pass.
    """
    sent = texts.sparkSession.sparkContext.broadcast(wanted)
    schema = T.StructType([*(texts.schema[c] for c in keep), T.StructField("phrase", T.StringType()), T.StructField("n", T.LongType())])
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = _bytes(batch.column(len(keep)))
            doc, _, a, b = _prose(batch.column(len(keep) + 1), offs)
            for x, y in _chunks(offs, chunk) if len(a) else ():
                data, parts = _FOLDED[raw[x:y]] if fold else raw[x:y], []
                for _, at, size, _, _ in sent.value.candidates(data, offs[np.searchsorted(offs, x) : np.searchsorted(offs, y)] - x, chunk):
                    r = np.searchsorted(a, at + x, side="right") - 1
                    own = (r >= 0) & (at + x + size <= b[r])
                    at, size, row = at[own], size[own], doc[r[own]]
                    own = ~_hyphened(data, at, at + size, offs[row] - x, offs[row + 1] - x)
                    found = pa.table({"row": row[own], "phrase": _cut(data, at[own], size[own]), "n": np.ones(int(own.sum()), dtype=np.int64)})
                    parts.append(_summed(found))
                if parts:
                    found = _summed(pa.concat_tables(parts)).combine_chunks()
                    for part in found.to_batches():
                        yield pa.RecordBatch.from_arrays([*batch.select(keep).take(part["row"]).columns, part["phrase"], part["n"]], [*keep, "phrase", "n"])

    return texts.select(*keep, "source", "ranges").mapInArrow(run, schema)


def _summed(found: pa.Table) -> pa.Table:
    return found.group_by(["row", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def _free() -> Column:
    """Whether what is found is not part of a longer word or hyphenated name."""
    left, right = F.expr("substring(seen, greatest(1, first - 1), least(2, first))"), F.expr("substring(seen, first + long + 1, 2)")
    return ~left.rlike("([A-Za-z0-9_]|[A-Za-z0-9]-)\\z") & ~right.rlike("^([A-Za-z0-9_]|-[A-Za-z0-9])")


def occurrences(texts: DataFrame, phrases: DataFrame, fold: bool = False) -> DataFrame:
    """Every place where a phrase stands within a range, overlapping ones too.

    ``texts``: source, ranges (prose counts; without that column the whole
    text) and what else is to be kept; ``phrases``: phrase.  ``fold`` takes A-Z
    in the texts as a-z.  Adds range_no, phrase, start, end (bytes), line, col
    and ``free``: whether the neighbours end the word.
    """
    keys = _with_kinds(stored(keyed(phrases), "phrases"), False)
    return _found(texts, keys, _Wanted.of(keys), fold).drop("kind")


def chosen(texts: DataFrame, phrases: DataFrame, fold: bool = False) -> DataFrame:
    """Of the occurrences those that a search from the left, taking the longest, would give, and that are free.

    ``texts`` have a rel_path.  What is found as a word meets no phrase that
    goes beyond one, so it is chosen as it is; only the others are shuffled.
    """
    keys = _with_kinds(stored(keyed(phrases), "phrases"), True)
    return _chosen(texts, keys, _Wanted.of(keys), fold)


def _chosen(texts: DataFrame, keys: DataFrame, wanted: _Wanted, fold: bool) -> DataFrame:
    found = _found(texts, keys, wanted, fold)
    if wanted.sizes[GRAM]:
        found = stored(found, "occurrences")
        found = found.where(F.col("kind") == WORD).unionByName(leftmost_longest(found.where(F.col("kind") != WORD)))
    return found.where("free").drop("kind", "free")


def counted(texts: DataFrame, phrases: DataFrame, fold: bool = False) -> DataFrame:
    """phrase, n, n_texts: how often each phrase is ``chosen``, and under how many paths.

    ``texts``: rel_path, source, ranges, own (a phrase that does not count
    there) and repeated (whether other rows have the path).  Words are counted
    text by text where they are found; then only texts that share their path
    need be told apart, so the groups to hold are as many as the words, however
    many texts there are.  Where a phrase goes beyond a word, its occurrences
    are counted by path.
    """
    known = stored(keyed(phrases), "phrases")
    keys = _with_kinds(known, True)
    wanted, keep = _Wanted.of(keys), ["rel_path", "own", "repeated"]
    if wanted.sizes[GRAM]:
        each = _chosen(texts, keys, wanted, fold).groupBy(*keep, "phrase").agg(F.count("*").alias("n"))
    else:
        each = _tallies(texts, wanted, fold, keep)
    shared = each.where("phrase <> own").groupBy("phrase", F.when(F.col("repeated"), F.col("rel_path")).alias("path"))
    sums = shared.agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"))
    texts_of = F.when(F.col("path").isNull(), F.col("n_texts")).otherwise(1)
    totals = sums.groupBy("phrase").agg(F.sum("n").alias("n"), F.sum(texts_of).alias("n_texts"))
    return totals.join(known.select("phrase"), "phrase", "left_semi")


def _found(texts: DataFrame, keys: DataFrame, wanted: _Wanted, fold: bool) -> DataFrame:
    keep = [c for c in texts.columns if c not in ("source", "ranges")]
    met = _candidates(texts, wanted, fold, keep).join(keys, ["kind", "gram"]).withColumns({"first": F.col("place") - F.col("at"), "long": F.octet_length("raw")})
    same = met.where("first >= low AND first + long <= high AND substring(near, first + 1, long) = raw")
    seen = same.withColumn("seen", F.expr("decode(near, 'ISO-8859-1')")).withColumn("lead", F.expr("left(seen, first)"))
    breaks = F.expr("length(lead) - length(replace(lead, '\n', ''))")
    col = F.when(breaks == 0, F.col("col") + F.col("first")).otherwise(F.length(F.substring_index("lead", "\n", -1)) + 1)
    start = F.col("from") + F.col("first")
    return seen.select(*keep, "kind", "range_no", "phrase", start.alias("start"), (start + F.col("long")).alias("end"), (F.col("line") + breaks).alias("line"), col.alias("col"), _free().alias("free"))


def contained(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """The phrases that stand in some text, as written."""
    keys = _with_kinds(stored(keyed(phrases), "phrases"), False)
    found = _candidates(texts.select("source"), _Wanted.of(keys), False, [])
    few = found.select("gram", "place", "near").distinct()  # what is cited often is compared once
    return few.join(keys, "gram").where("place >= at AND substring(near, place - at + 1, octet_length(raw)) = raw").select("phrase").distinct()


def leftmost_longest(found: DataFrame) -> DataFrame:
    """Of ``found`` (rel_path, range_no, start, end, ...) those that a search from the left, taking the longest, would give.

    Sorted within partitions and read as a stream, so a range may have any
    number of occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, upto = None, -1
        for batch in batches:
            names = batch.schema.names
            rows = zip(*(batch.column(names.index(c)).to_pylist() for c in ("rel_path", "range_no", "start", "end")), strict=True)
            taken = []
            for i, (path, number, start, end) in enumerate(rows):
                if (path, number) != place:
                    place, upto = (path, number), -1
                if start >= upto:
                    taken.append(i)
                    upto = end
            yield batch.take(pa.array(taken, pa.int64()))

    ordered = found.repartition("rel_path", "range_no").sortWithinPartitions("rel_path", "range_no", "start", F.desc("end"))
    return ordered.mapInArrow(run, found.schema)
