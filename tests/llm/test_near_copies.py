"""The Jaccard join against brute force, whatever the limits that divide its work."""

import random
import re

import numpy as np
import pytest

from quillgraph.llm import components
from quillgraph.llm import op5_jaccard_join as op5
from quillgraph.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute(rows):
    """(doc_id, size, component, links) per row; rows without id link with nothing."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    links[j] += 1
                    a, b = top(i), top(j)
                    root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((repr((d, len(s), least[top(i)] if d is not None else None, n)) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links, strict=True))))


def rows(seed, odd=True):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choices(words, k=40))
    out = []
    for g in range(8):  # groups of near copies of one text
        base = rng.choices(words, k=rng.choice([8, 40, 90, 200]))
        for _ in range(rng.choice([1, 2, 12, 45])):
            copy = [*base]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    out += [f"{' '.join(rng.choices(words, k=rng.randint(3, 60)))} {passage}" for _ in range(40)]
    out += [passage] * 30
    if odd:
        out += [None, "", " \n", "a", "A", "a b", "b a", "a b c", "a b c a b c", "é É", "é é"] + [" ".join(f"v{i}" for i in range(20_000))] * 2
    rng.shuffle(out)
    listed = [(i * 3 % 1009, t) for i, t in enumerate(out)]
    return listed + [(None, passage), (None, "a"), listed[0], listed[0], (listed[1][0], "another text under the same id"), (listed[1][0], passage)] if odd else listed


@pytest.mark.parametrize(
    ("seed", "limits"),
    [(1, op5.Limits()), (2, op5.Limits(short=3, salted=4, block=500, broadcast=0, frequent_from=1)), (3, op5.Limits(short=2, salted=10, block=3000, frequent_from=2))],
)
def test_components(spark, seed, limits, monkeypatch):
    if seed != 1:
        monkeypatch.setattr(op5, "TOLD", 1)
    own = rows(seed)
    df = spark.createDataFrame([(d, t, -1) for d, t in own], "doc_id long, text string, n_shingles int").repartition(4)
    got = op5.jaccard_components(df, limits=limits).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(own)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op5.jaccard_components(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in op5.jaccard_components(df).collect()) == [(1, 0, 1, 0), (2, 0, 2, 0)]


def test_one_of_each(spark):
    own = rows(5, odd=False)
    own += [own[0], own[0], (None, "kept"), (None, "kept")]
    df = spark.createDataFrame([(d, t, "en") for d, t in own], "doc_id long, text string, lang string")
    kept = op5.one_of_each(df)
    assert kept.columns == df.columns
    want = sorted({eval(r)[0] for r in brute(own) if eval(r)[0] is not None and eval(r)[0] == eval(r)[2]})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in kept.collect()) == 2


def test_one_of_rows_that_share_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    near, other, third = " ".join(base), " ".join(base[:-1] + ["x"]), " ".join(f"v{i}" for i in range(40))
    own = [
        (1, near, 0), (1, other, 1), (1, near, 2),  # linked, under one id: one stays
        (5, other + " ", 3), (5, third, 4),  # one linked with id 1, one with none: that stays
        (7, "", 5), (7, None, 6), (7, "", 7), (7, "alone here now", 8),  # no words: each text once
        (9, "u " * 9, 9), (3, "u u u u", 10),  # ids of one row each: the smaller stays
        (None, near, 11),
    ]
    df = spark.createDataFrame(own, "doc_id long, text string, f1 int")
    for rows_ in (df, df.repartition(3, "f1")):
        kept = op5.one_of_each(rows_)
        assert kept.columns == df.columns
        got = kept.collect()
        assert sorted((r.doc_id or 0, r.f1 in (4, 8), (r.text or "").strip()) for r in got if r.doc_id not in (1,)) == [(0, False, near), (3, False, "u u u u"), (5, True, third), (7, False, ""), (7, False, ""), (7, True, "alone here now")]
        assert [r.text in (near, other) for r in got if r.doc_id == 1] == [True]


def test_overlaps_within():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**60, 120, dtype=np.uint64))
    sets = []
    for _ in range(60):
        s = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.06, 0.5])]
        sets.append(np.unique(np.concatenate([s, rng.integers(0, 2**60, rng.integers(0, 9), dtype=np.uint64)])))
    weight = rng.integers(1, 4, len(sets))
    part, links = op5.overlaps_within(sets, weight)
    linked = np.array([[i != j and 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (links == linked @ weight).all()
    reach = np.linalg.matrix_power((linked | np.eye(len(sets), dtype=bool)).astype(float), 64) > 0
    assert ((part[:, None] == part[None, :]) == reach).all()


def test_sketches_lose_no_linked_pair():
    rng = np.random.default_rng(5)
    sets = []
    for size in (9, 12, 19, 40, 200, 3000):
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for _ in range(25):
            some = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.05, 0.2])]
            sets.append(np.unique(np.concatenate([some, rng.integers(0, 2**63, rng.integers(0, 1 + size // 15), dtype=np.uint64)])))
    sets.sort(key=len)
    n, marks = np.array([len(s) for s in sets]), np.stack([op5.sketch(s) for s in sets])
    label = op5.forest(n, marks)
    unlike = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(np.intersect1d(a, sets[j])) >= 90 * len(np.union1d(a, sets[j])):
                assert op5.may_link(marks[i], marks[j], n[i], n[j]) and label[i] == label[j]
            unlike += label[i] != label[j]
    assert unlike > len(sets) ** 2 // 3  # sets of different texts stay apart


def test_texts_of_few_words_make_no_large_group(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(14)], k=12)) for _ in range(6000)]
    tables = {}

    def spy(df, name, *args, real=op5.written, **more):
        tables[name] = real(df, name, *args, **more)
        return tables[name]

    monkeypatch.setattr(op5, "written", spy)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = op5.jaccard_components(df, limits=op5.Limits(short=3, salted=40, frequent_from=2)).collect()
    assert sum(r.component_id != r.doc_id for r in got) < 20
    assert tables["ties"].count() < 100 and max([r["count"] for r in tables["members"].groupBy("root").count().collect()], default=0) < 10


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(7)
    shared = unlinked = 0
    for size in (9, 10, 11, 12, 19, 20, 21, 40, 41, 100, 400, 3000):
        for _ in range(60 if size < 1000 else 8):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            gone = rng.integers(0, 2 + size // 10)
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, rng.integers(0, 2 + max(0, size // 10 - gone)), dtype=np.uint64)]))
            far = np.unique(np.concatenate([rng.permutation(a)[: size // 3], rng.integers(0, 2**63, size - size // 3, dtype=np.uint64)]))
            own, other, third = ({*op5.signatures(s).tolist()} - {0} for s in (a, b, far))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert own & other
                shared += 1
            assert len(own) <= 0.4 * size + 3
            unlinked += bool(own & third)
    assert shared > 100 and unlinked < 60


def test_sets_with_empty_buckets_meet(monkeypatch):
    monkeypatch.setattr(op5, "EMPTY", 10**9)  # no bucket may be empty: many sets are dealt again
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[15:], rng.integers(0, 2**63, 15, dtype=np.uint64)]))
        assert {*op5.signatures(a).tolist()} & {*op5.signatures(b).tolist()} - {0}


def test_sentences_in_many_texts_give_no_pairs(spark, monkeypatch):
    rng = random.Random(9)
    sentences = [" ".join(f"s{k}w{i}" for i in range(12)) for k in range(300)]
    texts = [" ".join(rng.sample(sentences, 12)) for _ in range(250)]  # each sentence in ten texts
    near = [f"{t} one more" for t in texts[:50]]
    tables, packed = {}, []

    def spy(df, name, *args, real=op5.written, **more):
        tables[name] = real(df, name, *args, **more)
        return tables[name]

    monkeypatch.setattr(op5, "written", spy)
    df = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    got = op5.jaccard_components(df).collect()
    assert sorted((r.component_id, r.doc_id) for r in got if r.component_id != r.doc_id) == [(k, 250 + k) for k in range(50)]
    # A pair is put out once for each stretch of buckets in which it agrees, not for each common shingle.
    assert tables["lists"].count() < 50 * 8 and tables["members"].count() < 110
    for t in texts:
        packed.append((len(op5._packed(t)), 8 * len(shingles(t))))
    assert 2 * sum(a for a, _ in packed) < sum(b for _, b in packed)


def test_many_tasks_write_few_files(spark, monkeypatch):
    own, tables = rows(10), {}

    def spy(df, name, *args, real=op5.written, **more):
        tables[name] = real(df, name, *args, **more)
        return tables[name]

    monkeypatch.setattr(op5, "written", spy)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(own, "doc_id long, text string").repartition(40)
        got = op5.jaccard_components(df, limits=op5.Limits(short=3, salted=10)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(repr(tuple(r)) for r in got) == brute(own)
    for name in ("profiles", "lists", "ties", "found"):
        assert tables[name].count() and len(tables[name].inputFiles()) <= 4


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 90), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_EDGES", 3)
    rng = random.Random(4)
    edges = [(50, k) for k in range(60, 90)] + [(k, 49) for k in range(85, 120)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}
