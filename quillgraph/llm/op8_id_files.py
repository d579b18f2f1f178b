"""Token ids in a byte-aligned, frequency-ranked binary format.

Within a block the ids are replaced by their frequency ranks, so the commonest
256 ids take one byte.  Each rank is written in 1 to 4 little-endian bytes;
the lengths stand apart, as 2-bit codes, four to a control byte.  Decoding
needs no loop over ids: a 256-row table turns control bytes into lengths,
their running sum into positions, and up to four gathers fetch the bytes.

A block holds consecutive documents and decodes alone.  Layout, little endian:

    4s  magic "QGB1"      u4 documents   u8 ids   u4 ranks
    i8  document ids      u1 1 where the document id is null
    u8  ids per document  u4 id of each rank
    u1  control bytes     u1 data bytes

Blocks are rows of a Parquet table in the shared folder: Spark's commit
protocol makes the files whole even if executors are lost.  Documents are
dealt by ranges of doc_id, so parts follow each other in ascending order; a
block knows how many ids stand before it in its part, and only one total per
part (their number is the number of partitions) is brought together.

Null texts are empty and get the end id alone.  Null doc_ids come first.  Rows
of equal doc_id are ordered by a hash of the text; equal rows are alike.  An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import new_path, small_batches
from .textkit import groups, text_buffers, trimmed
from .tokens import encoder

MAGIC = b"QGB1"
#: A block is closed once it holds so many ids; only whole documents are added.
BLOCK_IDS = 1 << 20
BLOCKS = "part int, seq int, before long, n_docs long, n_ids long, payload binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: Byte lengths that a control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of each rank, control bytes, data bytes) of an array of ids.

    Ranks go by falling count, ties by the id.
    """
    if len(ids) and ids.max() >= 1 << 22:
        values, ids, counts = np.unique(ids, return_inverse=True, return_counts=True)
    else:
        counts = np.bincount(ids)
        values = np.arange(len(counts))
    order = np.lexsort((values, -counts))[: np.count_nonzero(counts)]
    rank = np.zeros(len(values), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    ranks = rank[ids]
    codes = (ranks > 0xFF).astype(np.uint8)
    codes += ranks > 0xFFFF
    codes += ranks > 0xFFFFFF
    quads = np.zeros(-len(codes) % 4 + len(codes), dtype=np.uint8)
    quads[: len(codes)] = codes
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    spread = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return values[order].astype("<u4"), control, spread[np.arange(4) <= codes[:, None]]


def unpack(table: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ids that ``pack`` was given."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    at = np.zeros(n, dtype=np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    ranks = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        ranks[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return table[ranks]


def write_block(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The payload of documents with ``sizes`` ids each."""
    table, control, data = pack(ids)
    head = MAGIC + np.array([len(doc_ids)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes() + np.array([len(table)], "<u4").tobytes()
    body = [
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        sizes.astype("<u8").tobytes(),
        table.tobytes(),
        control.tobytes(),
        data.tobytes(),
    ]
    return b"".join([head, *body])


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> np.ndarray:
    """``ids`` with ``end_id`` after each document's."""
    out = np.full(len(ids) + len(sizes), end_id, np.uint32)
    own = np.ones(len(out), dtype=bool)
    own[np.cumsum(sizes + 1) - 1] = False
    out[own] = ids
    return out


def read_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids) of a block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    docs = int(np.frombuffer(payload, "<u4", 1, 4)[0])
    n = int(np.frombuffer(payload, "<u8", 1, 8)[0])
    ranks = int(np.frombuffer(payload, "<u4", 1, 16)[0])
    at = 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    numbers, null = take("<i8", docs), take("u1", docs)
    sizes, table, control = take("<u8", docs), take("<u4", ranks), take("u1", -(-n // 4))
    ids = unpack(table, control, np.frombuffer(payload, "u1", -1, at), n)
    return [None if x else int(d) for d, x in zip(numbers, null, strict=True)], sizes.astype(np.int64), ids


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, partitions: int | None = None, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write blocks in ascending order of doc_id to ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        encode = encoder(sent.value.decode("utf-8")).ids
        numbers: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, before
            ids = np.concatenate(held)
            payload = write_block(numbers, np.concatenate(counts), ids)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([len(numbers)]), pa.array([len(ids)]), pa.array([payload], pa.binary())], ["part", "seq", "before", "n_docs", "n_ids", "payload"])
            seq, before = seq + 1, before + len(ids)
            for x in (numbers, held, counts):
                x.clear()
            return row

        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            for a, b in groups(offs):
                ids, n = encode(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                held.append(with_end(ids, n, end_id))
                counts.append(n + 1)
                numbers.extend(batch.column(0).slice(a, b - a).to_pylist())
                if sum(map(len, held)) >= block_ids:
                    yield close()
        if numbers:
            yield close()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text"))
    dealt.mapInArrow(trimmed(run, "tokens"), BLOCKS).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # One row per partition of the writing job: its number is a setting, not a property of the data.
    first = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    placed = blocks.join(F.broadcast(first), "part").select((F.col("base") + F.col("before")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                numbers, sizes, ids = read_block(batch.column(1)[i].as_py())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(batch.column(0)[i].as_py() + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(trimmed(run, "tokens"), RESULT)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to a new table of blocks in the shared folder and describe what it holds."""
    spark = docs.sparkSession
    path = new_path(spark, "ids")
    write_ids(docs, path, tokenizer_path, end_id)
    return read_ids(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
