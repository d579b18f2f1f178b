"""The filter audit against a document-by-document simulation of every order."""

import random
import re
from itertools import permutations

import numpy as np

from quillgraph.llm import op12_filter_audit as op12

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows):
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        out.append(
            {
                "A": len(w) < 50,
                "B": 100 * len(set(w)) < 65 * len(w),
                "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                "D": any(c in "#$%&*|" for c in t),
                "E": doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in rows),
            }
        )
    return out


def brute(rows, labels):
    fails = failures(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, shapley = {}, {}
    for part in {s or "" for *_, s in rows}:
        own = [(rows[i][0], fails[i]) for i in range(len(rows)) if (rows[i][2] or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                alone = sum(x[1][f] and sum(x[1].values()) == 1 for x in own)
                lost = [sum(d in s for d, _ in gone) for s in (good, toxic)]
                out[part, "".join(order), step] = (len(left), len(gone), sum(x[1][f] for x in own) - len(gone), alone, *lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def made(rng, n):
    rows = []
    for _ in range(n):
        words = [rng.choice(["alpha", "Beta", "gamma", "GO", "é", "x#"] + [f"w{i}" for i in range(200)]) for _ in range(rng.choice([0, 3, 49, 50, 51, 80]))]
        text = rng.choice([" ", "\n", "\t"]).join(words)
        if rng.random() < 0.2:
            text = "same same same " * 20
        rows.append((rng.choice([None, *range(30)]) if rng.random() < 0.3 else rng.randrange(10_000), rng.choice([text, text, text, None]), rng.choice([None, "", "a", "b", "ü"])))
    return rows + rows[:7]


def tables(spark, folder, rows, labels):
    docs = [(*r, 1, b"x") for r in rows]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n long, hash binary").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in op12.query(spark, folder).collect()}


def test_query(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = made(rng, 250)
    ids = [r[0] for r in rows]
    labels = [(rng.choice(ids), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    monkeypatch.setattr(op12, "CHUNK", 64)
    got = tables(spark, str(tmp_path), rows, labels)
    assert got == brute(rows, labels)
    assert len(got) == 4 * 600


def test_one_text_and_one_id(spark, tmp_path):
    rows = [(i % 3, "copy " * 60, "s") for i in range(90)] + [(None, "copy " * 60, "s")] * 20
    assert tables(spark, str(tmp_path / "a"), rows, [(1, 1, 1), (1, 1, 0)]) == brute(rows, [(1, 1, 1)])


def test_empty_tables(spark, tmp_path):
    assert tables(spark, str(tmp_path / "a"), [], []) == {}
    assert len(tables(spark, str(tmp_path / "b"), [(1, None, None)], [])) == 600


def test_bitmaps_of_many_parts():
    rng = np.random.default_rng(1)
    part, fails = rng.integers(0, 40, 3000), rng.integers(0, 32, 3000).astype(np.int16)
    good, toxic = rng.random(3000) < 0.5, rng.random(3000) < 0.1
    maps = op12._Bitmaps(part, fails, good, toxic, 5)
    for subset in range(32):
        left = fails & subset == 0
        for counts, member in zip(maps.left(subset), (left, left & good, left & toxic), strict=True):
            assert counts.tolist() == [int((member & (part == p)).sum()) for p in maps.parts]
