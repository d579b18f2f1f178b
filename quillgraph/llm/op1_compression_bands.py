"""Quality rule: zstandard compression ratios must lie inside bands.

Two ratios (raw bytes / compressed bytes) are taken: of the whole text, and of
each chunk of ``CHUNK`` bytes, the last one with what is left.  Repetitive text compresses too well and
random text not at all; short texts compress less because the frame and the
first occurrences weigh more, so the limits depend on the length.  A text is
rejected if its whole ratio leaves the band of its length, or if more than
``BAD_SHARE`` of its bytes are in chunks that leave the chunk band (a last
chunk that is not full: the band of its length).

Nulls and empty texts have no words and fail the base rule.  Rows are
independent of each other: repeated rows get repeated results, an empty table
gives an empty result, and other columns are neither read nor returned.  Very
long texts are handled whole; memory is a small multiple of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import small_batches
from .textkit import PLAIN, find_words, groups, hash_words, text_buffers, trimmed, window_hashes

#: (bytes from, lowest ratio, highest ratio), by ascending length.  From 256 bytes the lowest ratios lie between that
#: of random alphanumeric or base64 text (at most 1.18 at 384 bytes, 1.31 at 1,024, 1.37 at 4,000, 1.38 beyond) and that of prose.
BANDS = ((0, 0.0, 3.0), (128, 1.0, 3.5), (256, 1.25, 4.0), (384, 1.29, 4.0), (512, 1.37, 4.0), (768, 1.42, 4.0), (1024, 1.5, 4.5), (2048, 1.55, 4.5), (4096, 1.6, 6.0), (65536, 1.4, 8.0))
CHUNK = 4096
CHUNK_BAND = (1.6, 6.0)
BAD_SHARE = 0.25
LEVEL = 3

MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SPACE = b" \t\n\x0b\x0c\r"


def band(n_bytes: int) -> tuple[float, float]:
    """(lowest, highest) ratio for a text of ``n_bytes``."""
    return next((lo, hi) for at, lo, hi in reversed(BANDS) if n_bytes >= at)


def within(ratio: float, limits: tuple[float, float]) -> bool:
    return limits[0] <= ratio <= limits[1]


def repeated_words(runs: np.ndarray, size: int) -> int:
    """Words covered by windows whose hash occurs at least twice."""
    if len(runs) < 2:
        return 0
    ordered = np.sort(runs)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, runs), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == runs)
    edges = np.zeros(len(runs) + size, dtype=np.int64)
    edges[hit] += 1
    edges[hit + size] -= 1  # each start occurs once, so plain assignment is enough
    return int(np.count_nonzero(np.cumsum(edges) > 0))


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, ratios and verdict of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            rows: list[tuple] = []
            for a, b in groups(offs):
                buf, own = raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                starts, ends, first = find_words(buf, own, PLAIN)
                runs = window_hashes(hash_words(buf, starts, ends, fold=False), WINDOW)
                points = np.zeros(len(buf) + 1, dtype=np.int64)
                np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
                chars = np.zeros(len(starts) + 1, dtype=np.int64)
                np.cumsum(points[ends] - points[starts], out=chars[1:])
                symbols = np.zeros(len(buf) + 1, dtype=np.int64)
                np.cumsum(_SYMBOL[buf], out=symbols[1:])
                whole = buf.tobytes()
                for i in range(b - a):
                    lo, hi = int(first[i]), int(first[i + 1])
                    text = whole[own[i] : own[i + 1]]
                    n = hi - lo
                    repeat = repeated_words(runs[lo : hi - WINDOW + 1], WINDOW) if n > WINDOW else 0
                    failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
                    ratio = len(text) / len(compress(text)) if text else 0.0
                    parts = [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)] if len(text) > CHUNK else []
                    bad = [len(x) for x in parts if not within(len(x) / len(compress(x)), CHUNK_BAND if len(x) == CHUNK else band(len(x)))]
                    kept = not failed and within(ratio, band(len(text))) and sum(bad) <= BAD_SHARE * len(text)
                    rows.append((n, int(chars[hi] - chars[lo]), int(symbols[own[i + 1]] - symbols[own[i]]), duplicate_lines(text), repeat, failed, kept, ratio, len(parts), len(bad)))
            columns = zip(*rows, strict=True) if rows else [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], NAMES)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(trimmed(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(spark.read.parquet(f"{sf_dir}/documents.parquet"))
