"""Compression bands and decontamination against brute force."""

import base64
import collections
import hashlib
import random
import re
import string

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import op1_compression_bands as op1
from quillgraph.llm import op2_decontaminate as op2
from quillgraph.llm import textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed


def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopé", k=rng.randint(1, 9))) for _ in range(400)]
    prose = [" ".join(rng.choices(vocabulary, k=k)) for k in (5, 19, 20, 21, 100, 1000, 30_000)]
    noise = ["".join(rng.choices([chr(c) for c in range(33, 127)] + [" "], k=3000)) + " x" * 20]
    return [*prose, *noise, None, "", " \t\n\x0b", "a b c d e f g h " * 9, "line one\nline two\nline one\n \n \nline one", "\x1c\x85  ⟨x⟩ #$%", *prose[:2]]


def test_base_counts(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(rows)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in op1.compression_bands(df).collect()}
    for i, t in enumerate(rows):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), (i, t and t[:40])
        assert not (r.base_failed and r.kept)
    assert op1.compression_bands(df.limit(0)).count() == 0


def test_bands(spark):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(3000))
    random_text = " ".join("".join(rng.choices([chr(c) for c in range(0x4E00, 0x9F00)], k=40)) for _ in range(100))
    # Not the same eight words twice, yet nothing but two words.
    dull = " ".join(rng.choice(["spam", "spams"]) for _ in range(40))
    long_dull = " ".join(f"{'spam' * 30}{i}" for i in range(400))
    rows = [(1, prose), (2, random_text), (3, long_dull), (4, prose + " " + "q" * 9000)]
    got = {r.doc_id: r for r in op1.compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].n_chunks > 3 and got[1].n_bad_chunks == 0
    assert not got[3].kept and not got[3].base_failed and got[3].ratio > 8
    assert got[4].n_bad_chunks >= 1
    assert got[2].ratio < got[1].ratio and dull


def test_band_limits():
    assert op1.band(0) == (0.0, 3.0) and op1.band(128) == (1.0, 3.5) and op1.band(10**9) == (1.4, 8.0)
    assert all(a[0] < b[0] and a[2] <= b[2] for a, b in zip(op1.BANDS, op1.BANDS[1:], strict=False))


def test_random_text_is_not_kept(spark):
    rng = random.Random(8)
    letters = string.ascii_letters + string.digits
    junk = " ".join("".join(rng.choices(letters, k=rng.randint(2, 12))) for _ in range(20_000)).encode()
    lines = base64.b64encode(rng.randbytes(60_000)).decode()
    lines = "\n".join(lines[i : i + 40] for i in range(0, len(lines), 40)).encode()
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(3000)).encode()
    bad = [junk[:n] for n in (300, 600, 1200, 2000, 4000, 6000, 20_000, 100_000)] + [lines[:n] for n in (1200, 4000, 20_000)]
    bad += [prose[:4096] + junk[:3000], prose[:8192] + junk[:8192]]
    good = [prose[:n] for n in (300, 600, 1200, 2000, 4000, 6000, 10_000)] + [prose[:8192] + junk[:1500], prose[:8192] + b"-" * 100]
    rows = [(i, t.decode()) for i, t in enumerate(bad + good)]
    got = {r.doc_id: r for r in op1.compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i in range(len(rows)) if got[i].kept] == list(range(len(bad), len(rows)))


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return ITEM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    words, hit, named = fold(text), set(), set()
    for name, item in items:
        w = fold(item)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if w else ():
            window = w[k : k + n]
            for i in range(len(words) - n + 1):
                if words[i : i + n] == window:
                    hit.update(range(i, i + n))
                    if name is not None:
                        named.add(name)
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.fixture
def planted():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)] + ["É", "Straße", "a", "the"]
    items = [(str(i), " ".join(rng.choices(words, k=n))) for i, n in enumerate((30, 13, 14, 12, 5, 2, 1, 40, 13))]
    items += [("7", "second text of item seven " + " ".join(rng.choices(words, k=20))), ("10", items[0][1]), (None, " ".join(rng.choices(words, k=15))), ("empty", ""), ("null", None)]
    docs = []
    for k in range(120):
        text = " ".join(rng.choices(words, k=rng.randint(0, 120)))
        if k % 3 == 0:
            source = rng.choice([t for _, t in items if t]).split(" ")
            a = rng.randint(0, max(0, len(source) - 13))
            part = " ".join(source[a : a + rng.randint(12, 20)])
            text = rng.choice([f"{text} {part}", f"{part.upper()}, {text}", f"{text}-{part}!{text}"])
        docs.append((k, text))
    docs += [(200, None), (201, ""), (202, "... --- ..."), (203, docs[0][1]), (203, docs[0][1]), (204, "x " * 30_000 + items[0][1])]
    return docs, items


@pytest.mark.parametrize("block", [None, 300])
def test_decontamination(spark, planted, block, monkeypatch):
    docs, items = planted
    if block:
        monkeypatch.setattr(op2, "BLOCK_BYTES", block)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string").repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string")
    found = op2.benchmark_hits(d, b, ["doc_id", "text"])
    got = found.select("doc_id", "text", "found.n_words", F.size("found.hits"), F.size("found.items"), F.sha2(F.array_join("found.items", ","), 256), op2.contaminated()).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[2:] == brute(r.text, items), r.doc_id
    clean = op2.clean_documents(d, b)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in docs if not brute(t, items)[4])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert op2.clean_documents(d, b).count() == 1
    assert op2.clean_documents(d.limit(0), spark.createDataFrame([(1, "some text")], "item_id long, text string")).count() == 0
    assert op2.clean_documents(d, spark.createDataFrame([(1, "Some Text")], "item_id long, text string")).count() == 0
    clash = d.withColumn("Found", F.lit("own")).withColumn("item_id", F.lit(5))
    assert [tuple(r) for r in op2.clean_documents(clash, b).collect()] == [(1, "some text", "own", 5)]


def test_words_do_not_collide():
    # Words that are equal under every polynomial hash modulo 2**64, and words that differ in one byte far out.
    def thue_morse(n, a, b):
        return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))

    words = [thue_morse(1 << k, *ab) for k in range(10, 15) for ab in ("xy", "yx")]
    words += ["z" * n + end for n in (0, 7, 8, 9, 511, 512, 520, 600_000) for end in ("", "a", "b", "aa", "ab") if n or end]
    raw, offs = textkit.text_buffers(pa.array([" ".join(words).upper(), " ".join(reversed(words))]))
    starts, ends, first = textkit.find_words(raw, offs, textkit.PLAIN)
    hashes = textkit.hash_words(raw, starts, ends)
    assert first.tolist() == [0, len(words), 2 * len(words)] and len(set(hashes.tolist())) == len(words)
    assert hashes[: len(words)].tolist() == hashes[len(words) :][::-1].tolist()
    alone = [textkit.hash_words(r, *textkit.find_words(r, o, textkit.PLAIN)[:2]).tolist() for r, o in (textkit.text_buffers(pa.array([w])) for w in words)]
    assert [h for a in alone for h in a] == hashes[: len(words)].tolist()
    assert textkit.hash_words(raw, starts, ends, fold=False)[0] != hashes[0]
