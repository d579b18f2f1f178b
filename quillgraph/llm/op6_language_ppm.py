"""Language identification by prediction by partial matching.

Per language a byte context tree of order ``ORDER`` is learned; then its
statistics are frozen.  A byte is coded in the longest known context with its
share there (escape method C, no exclusion); a byte that is new there costs an
escape and is coded in the context one byte shorter, and at last as one of 256.
Only contexts and bytes that occur are stored, each with the code lengths of
all languages: a byte of text takes one look-up, or one per escape.  The sum
is the text's exact code length under each tree; the language of the shortest
one is predicted.

Bounds of the model, however many documents there are: about ``ROWS`` counts
are brought to the driver, in equal shares for all languages (``LEAST`` of each
at least), and ``MODEL_BYTES`` bytes are kept.  Beyond them the rarest
bytes-in-context go first (of a language by their count, of all by their share
in the language where it is largest), so all orders stay in use, and a language
of few documents keeps its commonest contexts like any other.

Learned from at most about ``SAMPLE`` documents per language, chosen by a hash
of their id (a documented bound; whole texts), and never from held-out ones.
Prediction reads whole texts and nothing but the text.

``und`` with score 0 is returned for null texts, texts without a letter (a code
point of a Unicode letter category), and
everything if there is nothing to learn from.  Ties go to the language first in
code point order.  A document without an id is not learned from and not held
out.  Repeated rows get repeated results; other columns are kept by
``known_language`` and neither read nor returned by ``query``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, small_batches, written
from .textkit import groups, mix64, text_buffers, trimmed
from .tokens import Remembered

ORDER = 3
#: Documents learned from per language, about.
SAMPLE = 3000
#: Bytes of the frozen model at most, indexes included.
MODEL_BYTES = 96 << 20
#: Counts brought to the driver, about; every language has an equal share of them, and what one leaves goes to the others.
ROWS = 4_000_000
#: Counts of a language at least, so that none is lost however many there are.
LEAST = 1_000
#: The score compares code lengths of so many bytes of average text.
SCORE_BYTES = 16
#: A prediction below this score is not trusted by the filter.
MIN_SCORE = 0.4

_NEWLINE = 10
_ALL = np.uint32(0xFFFFFFFF)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


class Table:
    """Rows of numbers by 32-bit keys.  Only keys and rows are pickled; the index is made where it is used."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys, rows
        self._index: Remembered | None = None

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys, self.rows

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.__init__(*state)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row number of each key, -1 where there is none."""
        if self._index is None:
            self._index = Remembered()
            self._index.add(mix64(self.keys.astype(np.uint64)))
        return self._index.find(mix64(keys.astype(np.uint64)))


#: Bytes per row of a table beside the numbers: the key, and slots of the index.
_ROW_BYTES = 4 + 4 * 12


def _last(codes: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of codes of four bytes."""
    return codes & (_ALL >> np.uint32(32 - 8 * n)) if n else codes & np.uint32(0)


@dataclass
class Model:
    """Code lengths in bits, a column per language."""

    langs: list[str]
    #: Of each byte without context.
    none: np.ndarray
    #: By order 1..ORDER: of bytes in contexts that some language knows, escapes of all kinds included.
    known: list[Table]
    #: By order 1..ORDER: of the escape from contexts; 0 where a language does not know the context.
    escape: list[Table]

    def bits(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of the last byte of each code after the bytes before it."""
        if order == 0:
            return self.none[_last(codes, 1)]
        at = self.known[order - 1].find(_last(codes, order + 1))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.known[order - 1].rows[at]
        out = np.empty((len(codes), len(self.langs)), np.float32)
        old = np.flatnonzero(at >= 0)
        out[old] = self.known[order - 1].rows[at[old]]
        codes = codes[new]
        lower = self.bits(codes, order - 1)
        context = self.escape[order - 1].find(_last(codes >> np.uint32(8), order))
        hit = np.flatnonzero(context >= 0)
        lower[hit] += self.escape[order - 1].rows[context[hit]]
        out[new] = lower
        return out

    def lengths(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each row's text under each language's tree."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        full = np.flatnonzero(offs[1:] > offs[:-1])
        begin = offs[:-1][full]
        step = max(1 << 12, (1 << 20) // len(self.langs))  # bounds the matrix of code lengths
        codes = contexts(buf, offs)
        for a in range(0, len(buf), step):
            costs = self.bits(codes[a : a + step])
            rows = slice(int(np.searchsorted(begin, a, side="right")) - 1, int(np.searchsorted(begin, a + step, side="left")))
            out[full[rows]] += np.add.reduceat(costs, np.maximum(begin[rows], a) - a, axis=0, dtype=np.float64)
        return out


def contexts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each byte and the three before it as one number, over texts preceded by newlines."""
    code = buf.astype(np.uint32)
    for back in range(1, ORDER + 1):
        past = np.full(len(buf), _NEWLINE, np.uint8)
        past[back:] = buf[:-back] if back < len(buf) else buf[:0]
        for k in range(back):
            at = offs[:-1] + k
            past[at[at < offs[1:]]] = _NEWLINE
        code |= past.astype(np.uint32) << np.uint32(8 * back)
    return code


def count_contexts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(four bytes as one number, count) over texts preceded by newlines."""
    return np.unique(contexts(buf, offs), return_counts=True)


def freeze(langs: list[str], codes: dict[str, tuple[np.ndarray, np.ndarray]], model_bytes: int = MODEL_BYTES) -> Model:
    """The code lengths of what any language knows, within ``model_bytes``."""
    n = len(langs)
    # A byte in a context may bring a context of its own.
    room = model_bytes // (2 * (4 * n + _ROW_BYTES))
    rooms = {1: room // 8, 2: room // 4, 3: room - room // 8 - room // 4}
    model = Model(langs, np.zeros((256, n), np.float32), [], [])
    totals = np.array([max(1, codes[x][1].sum()) for x in langs], np.float64)
    every = np.concatenate([codes[x][0] for x in langs])
    lang = np.repeat(np.arange(n), [len(codes[x][0]) for x in langs])
    count = np.concatenate([codes[x][1] for x in langs]).astype(np.float64)
    for order in range(ORDER + 1):
        keys, at = np.unique(_last(every, order + 1), return_inverse=True)
        if order and len(keys) > rooms[order]:
            share = np.zeros(len(keys))
            # The share of a byte-in-context in a language is summed before the largest is taken.
            pair, place = np.unique(at * n + lang, return_inverse=True)
            np.maximum.at(share, pair // n, np.bincount(place, count) / totals[pair % n])
            keys = np.sort(keys[np.lexsort((keys, -share))[: rooms[order]]])
            at = np.minimum(np.searchsorted(keys, _last(every, order + 1)), max(0, len(keys) - 1))
            own = keys[at] == _last(every, order + 1) if len(keys) else np.zeros(len(every), bool)
            at, who, times = at[own], lang[own], count[own]
        else:
            who, times = lang, count
        seen = np.zeros((len(keys), n), np.float64)
        np.add.at(seen, (at, who), times)
        context, of = np.unique(_last(keys >> np.uint32(8), order), return_inverse=True)
        total, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
        np.add.at(total, of, seen)
        np.add.at(kinds, of, seen > 0)
        base = np.maximum(1.0, total + kinds)
        escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / base), 0.0).astype(np.float32)
        if order:
            lower = model.bits(keys, order - 1)
        else:
            lower = np.full((len(keys), n), 8.0, np.float32)
            model.none[:] = 8.0 + (escape[0] if len(escape) else 0.0)
        bits = np.where(seen > 0, -np.log2(np.maximum(seen, 1e-300) / base[of]), escape[of] + lower).astype(np.float32)
        if order:
            model.known.append(Table(keys, bits))
            model.escape.append(Table(context, escape))
        else:
            model.none[keys] = bits
    return model


def _least_counts(langs: list[str], counts: list[int], rows: list[int]) -> dict[str, int]:
    """From which count on a language's contexts are kept; its commonest ones always are.

    ``counts`` descend within a language; ``rows`` contexts have each.
    """
    steps: dict[str, list[tuple[int, int]]] = {}
    for lang, n, k in zip(langs, counts, rows, strict=True):
        steps.setdefault(lang, []).append((n, k))
    left, out = ROWS, {}
    by_size = sorted(steps, key=lambda x: (sum(k for _, k in steps[x]), x))
    for i, lang in enumerate(by_size):  # those that need least first, so that the others share the rest
        share, kept, least = max(LEAST, left // (len(by_size) - i)), 0, steps[lang][0][0]
        for n, k in steps[lang]:
            if kept and kept + k > share:
                break
            kept, least = kept + k, n
        out[lang] = least
        left -= kept
    return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The frozen model of ``docs`` (doc_id, text, lang), or None if nothing can be learned."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.where(draw < F.element_at(share, F.col("lang"))).where("text IS NOT NULL").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted({*langs}):
                own = pc.utf8_lower(batch.column(1).filter(pa.array([x == lang for x in langs])))
                raw, offs = text_buffers(own)
                for a, b in groups(offs):
                    codes, n = count_contexts(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    counts = written(chosen.mapInArrow(trimmed(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "contexts")
    # By language the least count that keeps its rows within its share, from a row per language and distinct count.
    sizes_of = counts.groupBy("lang", "n").agg(F.count("*").alias("rows")).orderBy("lang", F.desc("n")).toArrow()
    least = _least_counts(*(sizes_of.column(c).to_pylist() for c in ("lang", "n", "rows")))
    floor = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair]), F.col("lang")) if least else F.lit(0)
    found = counts.where(F.col("n") >= floor).toArrow()
    langs = sorted({*found.column("lang").to_pylist()})
    if not langs:
        return None
    names = np.array(found.column("lang").to_pylist())
    code, n = found.column("code").to_numpy().astype(np.uint32), found.column("n").to_numpy()
    return freeze(langs, {x: (code[names == x], n[names == x]) for x in langs})


def _score(column: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    und, score = ["und"] * len(column), np.zeros(len(column))
    if model is None:
        return und, score
    for a, b in groups(text_buffers(column)[1]):
        raw, offs = text_buffers(pc.utf8_lower(column.slice(a, b - a)))
        bits = model.lengths(raw[offs[0] : offs[-1]], offs - offs[0])
        size = np.maximum(1, np.diff(offs))[:, None]
        best = bits.argmin(axis=1)
        worse = (bits - bits.min(axis=1, keepdims=True)) / size
        sure = 1 / np.exp2(-SCORE_BYTES * worse).sum(axis=1)
        for i, text in enumerate(column.slice(a, b - a).to_pylist()):
            if text and any(map(str.isalpha, text)):
                und[a + i] = model.langs[best[i]]
                score[a + i] = sure[i]
    return und, np.round(score, 6)


def predict(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` and two more, the language and its score; only
    the text is looked at.  Columns of ``docs`` with these names are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{names[0]}` string, `{names[1]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = _score(batch.column(at), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score)], [*batch.schema.names, *names])

    return docs.mapInArrow(trimmed(run), schema)


def known_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is predicted with some confidence, all columns kept."""
    lang, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = predict(docs, learn(docs), (lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= min_score)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
