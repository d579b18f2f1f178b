"""Token counts and token-id files against the libraries themselves."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from quillgraph.llm import op7_token_counts as op7
from quillgraph.llm import op8_id_files as op8
from quillgraph.llm.textkit import text_buffers
from quillgraph.llm.tokens import Encoder, Remembered

public = pytest.importorskip("public_tokenizers")
PARTS = ["a", "b", " ", "  ", "   ", "\n", "\t", "'s", "'t", "'", "don't", "É", "é", "’", " ", " ", "\x85", "\x1c", "1", "23", ".", ",", "!!", "***", "<|endoftext|>", "<|", "endoftext", "世界", "😀", "word", "N'T", "\r\n", "ſ", "K", "_"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def want(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_library_result(library):
    encoder = Encoder(open(public.path("byte_bpe_50k.json")).read())
    encoder._ids._known.limit = 200  # start afresh now and then
    rng = random.Random(5)
    for _ in range(60):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(40)] + ["", None]
        raw, offs = text_buffers(pa.array(texts, pa.string()))
        ids, n = encoder.ids(raw, offs)
        at = np.concatenate([[0], np.cumsum(n)])
        counts = encoder.counts(raw, offs)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == want(library, t)
            assert counts[i] == at[i + 1] - at[i]


def test_vocabulary_with_tokens_of_many_spaces():
    """Byte-level merges of runs of white space; rows end in such runs, and any row may follow."""
    import json

    from quillgraph.llm.tokens import _byte_chars

    chars = sorted(_byte_chars())
    space, line = (next(c for c, b in _byte_chars().items() if b == x) for x in (0x20, 0x0A))
    merges = [(space, space), (space * 2, space * 2), (space, "a"), (line, line), (line, space), (space, line), (space * 2, line), ("a", "b"), (space + "a", "b")]
    vocab = {c: i for i, c in enumerate([*chars, *dict.fromkeys(a + b for a, b in merges)])}
    spec = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [list(m) for m in merges]},
    }
    encode = Encoder(json.dumps(spec))
    assert encode.cut
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "b", " ", "  ", "\n", "\t", "é", ".", "\u3000", "'s"], k=rng.randint(0, 7))) for _ in range(20_000)] + ["a  ", " ", "  ", "", "a   ", "a \n "]
    for _ in range(2):
        rng.shuffle(texts)
        raw, offs = text_buffers(pa.array(texts))
        ids, sizes = encode.ids(raw, offs)
        at = np.concatenate([[0], np.cumsum(sizes)])
        expected = [want(encode.tokenizer, t) for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == expected
        assert encode.counts(raw, offs).tolist() == [len(x) for x in expected]


def test_whole_strings_are_proven(library):
    whole = Encoder(open(public.path("byte_bpe_50k.json")).read()).whole
    assert len(whole) > 40_000 and " the" in whole and "\n\n" in whole
    for s in random.Random(1).sample(sorted(whole), 500):
        assert len(want(library, s)) == 1


def test_remembered_numbers():
    table = Remembered()
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 300_000, dtype=np.uint64))
    table.add(keys[:1000])
    table.add(keys[1000:])
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def docs(spark):
    long = "word " * 60_000
    rows = [(3, "hello world"), (1, None), (2, ""), (3, "hello world"), (7, long), (5, "naïve <|endoftext|> x"), (None, "no id"), (3, "another")]
    # Columns that clash with what the operators return are ignored.
    return spark.createDataFrame([(d, t, 9, "x") for d, t in rows], "doc_id long, text string, n_tokens long, start string")


def test_count_tokens(spark, library):
    rows = docs(spark).collect()
    got = op7.count_tokens(docs(spark), public.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((r.doc_id or -1, len((r.text or "").encode()), len(want(library, r.text)), len(want(library, r.text)) > 512) for r in rows)
    assert op7.count_tokens(docs(spark).limit(0), public.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    texts = ["Hello world", "naïve  café", "", None]
    got = op7.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public.path(name)).orderBy("doc_id").collect()
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public.path(name))
        counts = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    else:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=public.path(name))
        counts = [len(p.encode(x or "")) for x in texts]
    assert [r.n_tokens for r in got] == counts


@settings(max_examples=60, deadline=None)
@given(hnp.arrays(np.uint32, st.integers(0, 300), elements=st.one_of(st.integers(0, 20), st.integers(0, 2**32 - 1))))
def test_pack_round_trip(ids):
    table, control, data = op8.pack(ids)
    assert (op8.unpack(table, control, data, len(ids)) == ids).all()
    assert len(control) == -(-len(ids) // 4)


def test_pack_ranks_by_frequency():
    ids = np.repeat(np.arange(70_000, dtype=np.uint32), np.r_[np.full(300, 3), np.ones(69_700)].astype(int))
    table, _, data = op8.pack(ids)
    assert set(table[:300]) == set(range(300))
    assert len(data) == 256 * 3 + 44 * 3 * 2 + (65536 - 300) * 2 + (70_000 - 65536) * 3


def test_blocks():
    sizes = np.array([2, 0, 3])
    ids = op8.with_end(np.array([5, 6, 7, 8, 9], np.uint32), sizes, 0)
    assert ids.tolist() == [5, 6, 0, 0, 7, 8, 9, 0]
    numbers, n, back = op8.read_block(op8.write_block([4, None, 9], sizes + 1, ids))
    assert (numbers, n.tolist(), back.tolist()) == ([4, None, 9], [3, 1, 4], ids.tolist())
    with pytest.raises(ValueError):
        op8.read_block(b"other" * 10)


def test_encode_documents(spark, library):
    # Null ids first, then by id; equal ids by a hash of the text.
    got = op8.encode_documents(docs(spark), public.path("byte_bpe_50k.json")).collect()
    assert len(got) == 8
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, 1, 2, 3, 3, 3, 5, 7]
    at = 0
    for r in by_start:
        assert r.start == at
        at += r.n_tokens
    sums = sorted((zlib.crc32(np.array([*want(library, r.text), 0], "<u4").tobytes()), len(want(library, r.text)) + 1) for r in docs(spark).collect())
    assert sorted((r.ids_crc32, r.n_tokens) for r in got) == sums
    assert op8.encode_documents(docs(spark).limit(0), public.path("byte_bpe_50k.json")).count() == 0


def test_many_blocks(spark, tmp_path, library):
    rows = spark.range(500).selectExpr("499 - id AS doc_id", "repeat(concat('tok ', id, ' '), int(id % 40)) AS text")
    op8.write_ids(rows, f"file://{tmp_path}/ids", public.path("byte_bpe_50k.json"), partitions=3, block_ids=500)
    assert spark.read.parquet(f"file://{tmp_path}/ids").count() >= 3
    got = {r.doc_id: r for r in op8.read_ids(spark, f"file://{tmp_path}/ids").collect()}
    at = 0
    for r in rows.orderBy("doc_id").collect():
        ids = [*want(library, r.text), 0]
        assert tuple(got[r.doc_id]) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pieces_with_equal_polynomial_hashes(library):
    texts = ["".join(ab[bin(i).count("1") % 2] for i in range(2048)) for ab in ("xy", "yx", "ab", "ba")]
    encode = Encoder(library.to_str())
    raw, offs = text_buffers(pa.array(texts))
    ids, sizes = encode.ids(raw, offs)
    assert ids.tolist() == [i for t in texts for i in want(library, t)]
    assert encode.counts(raw, offs).tolist() == sizes.tolist() == [len(want(library, t)) for t in texts]
    known = sorted(encode.whole)[::50]
    raw, offs = text_buffers(pa.array(known))
    assert set(encode.counts(raw, offs).tolist()) == {1} == {len(want(library, t)) for t in known}
