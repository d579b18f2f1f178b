"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from quillgraph.llm import op13_periodic_runs as op13

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def made_texts():
    rng = random.Random(5)
    for _ in range(400):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        yield [rng.choice(letters) for _ in range(rng.randint(0, 90))]
    for _ in range(200):  # repeated pieces within noise, some with faults
        words = [str(rng.randint(0, 60)) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(1, 4)):
            piece = [str(rng.randint(0, 6)) for _ in range(rng.randint(1, 25))]
            part = (piece * rng.randint(1, 9))[: rng.randint(1, 120)]
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "x"
            words += part + [str(rng.randint(0, 60)) for _ in range(rng.randint(0, 9))]
        yield words
    a, b = "a", "b"
    for _ in range(14):
        a, b = b, b + a  # Fibonacci words hold runs within runs
    yield list(b)
    yield ["a"] * 700
    yield (["a"] * 60 + ["b"]) * 3 + ["a"] * 60


def test_runs_and_collapsed_words():
    for words in made_texts():
        expected = brute(words)
        assert op13.find_runs(words) == expected, words
        dropped = {i for s, k, q in expected for i in range(s + q, s + k)}
        assert op13.collapsed(words, expected) == [w for i, w in enumerate(words) if i not in dropped]


def test_other_lengths():
    rng = random.Random(8)
    for least in (6, 7, 9, 20, 33):
        for _ in range(150):
            words = [rng.choice("abc") for _ in range(rng.randint(0, 80))] + [rng.choice("ab")] * rng.randint(0, 50)
            assert op13.find_runs(words, least) == brute(words, least)
    with pytest.raises(ValueError):
        op13.find_runs(["a"] * 20, 5)


def test_every_period_has_one_size():
    for least in range(6, 40):
        sizes = [q for k in range(12) for a, b in op13.distances(2**k, least) for q in range(a, b + 1)]
        assert sorted(sizes)[:2000] == list(range(1, 2001))


def test_long_texts_take_time_in_proportion():
    assert op13.find_runs(["a"] * 400_000) == [(0, 400_000, 1)]
    page = [str(i) for i in range(6_000)]
    assert op13.find_runs(page * 3) == [(0, 18_000, 6_000)]


def changed(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", " \t\n\x0b\x0c\r", "é ü " * 30, "one", "a\x1cb a\x1cb " * 9]
    texts += [" ".join(rng.choices(["w%d" % i for i in range(400)], k=rng.randint(1, 300))) for _ in range(120)]
    texts += ["lead in  \n" + " ".join(rng.choices("abcdef", k=rng.randint(1, 9))) * 1 + " tail\tof it " * rng.randint(1, 20) for _ in range(40)]
    rows = [(i, t, True, 7) for i, t in enumerate(texts)] + [(3, texts[3], True, 8), (None, "x y " * 20, False, 1), (None, None, False, 1)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, runs boolean, length long").write.parquet(f"{folder}/documents.parquet")
    got = sorted((tuple(r)[:8] for r in op13.query(spark, folder).collect()), key=str)
    expected = []
    for doc_id, text, *_ in rows:
        words = changed(doc_id, text)
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
        milli = 1000 * best[1] // best[2] if runs else None
        kept = [w for i, w in enumerate(words) if i not in dropped]
        expected.append((doc_id, len(runs), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(kept))))
    assert got == sorted(expected, key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_operator_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "text string, doc_id long, collapsed long")
    assert op13.periodic_runs(empty).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert op13.periodic_runs(empty).count() == 0
