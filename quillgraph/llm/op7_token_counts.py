"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proven once, on the
driver, with the library itself, and the proven strings (a vocabulary at most)
are sent along.  Pieces of text among them count 1 by one look-up; others are
split into pre-tokens, those among them count 1, and only the rest are given to
the merge rules.  Counts of pieces are remembered, so each distinct piece is
looked at once while it is remembered.

Nulls and empty texts count 0 tokens.  Rows are independent: repeated rows
give repeated results, an empty table gives an empty result, and columns other
than the two named ones are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import small_batches
from .textkit import groups, text_buffers, trimmed
from .tokens import encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row.

    ``tokenizer_path``: a .json file of the tokenizers library or a .model file
    of sentencepiece, read on the driver (a few MB) and sent to the workers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    data = Path(tokenizer_path).read_bytes()
    piece_model = tokenizer_path.endswith(".model")
    sent = spark.sparkContext.broadcast((data, None if piece_model else encoder(data.decode("utf-8")).whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, whole = sent.value
        count = _piece_counter(model) if piece_model else encoder(model.decode("utf-8"), whole).counts
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            n = np.zeros(batch.num_rows, dtype=np.int64)
            for a, b in groups(offs):
                n[a:b] = count(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(trimmed(run, "tokens"), SCHEMA)


def _piece_counter(model: bytes):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)

    def count(buf: np.ndarray, offs: np.ndarray) -> list[int]:
        raw = buf.tobytes()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return [len(ids) for ids in processor.encode(texts, num_threads=1)]

    return count


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
