"""Occurrences by a join on grams, against a search at every place."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import mentions, phrases
from quillgraph.plans import queries


def word(byte):
    return bytes([byte]).isalnum()


def free(raw, start, end):
    for near, far in ((start - 1, start - 2), (end, end + 1)):
        if 0 <= near < len(raw) and (word(raw[near]) or raw[near] == 95 or raw[near] == 45 and 0 <= far < len(raw) and word(raw[far])):
            return False
    return True


def everywhere(texts, names, fold):
    out = set()
    for path, source, ranges in texts:
        raw = (source or "").encode()
        low = raw.lower() if fold else raw
        for k, (kind, a, b) in enumerate(ranges):
            for name in names if kind == "prose" else ():
                n = name.encode()
                for i in range(a, b - len(n) + 1):
                    if low[i : i + len(n)] == n:
                        line = raw[:i].count(b"\n")
                        out.add((path, k, name, i, i + len(n), line + 1, i - (raw.rfind(b"\n", 0, i) + 1) + 1, free(raw, i, i + len(n))))
    return out


def longest(found):
    out, upto = set(), {}
    for f in sorted(found, key=lambda f: (f[0], f[1], f[3], -f[4])):
        if f[3] >= upto.get(f[:2], -1):
            out.add(f)
            upto[f[:2]] = f[4]
    return out


def made(rng, n_texts):
    texts = []
    for k in range(n_texts):
        letters = rng.choice(["ab", "aB -_\n", "abcé-x\nN", "Abcdefgh "])
        source = "".join(rng.choices(letters, k=rng.randint(0, 120)))
        cuts = sorted({len(source[:i].encode()) for i in (rng.randint(0, len(source)) for _ in range(rng.randint(0, 6)))})
        ranges = [(rng.choice(["prose", "prose", "code"]), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        texts.append((f"{k}.md", source, ranges))
    return [*texts, ("none.md", None, []), ("long.md", "name-with-many-letters " * 40 + "\n" + "x" * 300, [("prose", 0, 1221)])]


def names_of(rng):
    letters = "abcé- _\nxdefgh"
    made = {"".join(rng.choices(letters, k=rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 12]))) for _ in range(150)}
    return sorted(made | {"name-with-many-letters", "with-many", "letters name", "x" * 300, "a", "ab", "abab", "ab\nab"})


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_occurrences(spark, monkeypatch, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts, names = made(rng, 120), names_of(rng)
    df = spark.createDataFrame(texts, "rel_path string, source string, ranges array<struct<kind: string, start: int, end: int>>").repartition(3)
    found = phrases.occurrences(df, spark.createDataFrame([(x,) for x in [*names, "", names[0]]], "phrase string"), fold=True)
    columns = ["rel_path", "range_no", "phrase", "start", "end", "line", "col", "free"]
    got = [tuple(r[c] for c in columns) for r in found.collect()]
    expected = everywhere(texts, names, True)
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 1000
    best = phrases.leftmost_longest(found)
    assert {tuple(r[c] for c in columns) for r in best.collect()} == longest(expected)
    whole = phrases.chosen(df, spark.createDataFrame([(x,) for x in names], "phrase string"), fold=True)
    assert sorted(tuple(r[c] for c in columns[:-1]) for r in whole.collect()) == sorted(f[:-1] for f in longest(expected) if f[-1])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Cross" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_words_and_what_gets_in_their_way(spark, monkeypatch, seed):
    """Names of one word and of several, that shadow each other; texts cut into slices or not."""
    monkeypatch.setattr(phrases, "CHUNK", (1 << 20, 8)[seed % 2])
    rng = random.Random(seed)
    texts = [(f"{k}.md", t, [("prose", 0, len(t))]) for k in range(250) for t in ["".join(rng.choices(["ab", "a", "b", "c", " ", " ", "-", "_", "é", "."], k=rng.randint(1, 30)))]]
    texts = [(p, t, [("prose", 0, len(t.encode()))]) for p, t, _ in texts]
    pieces = ["a", "b", "ab", "ba", "c", " ", "-", "bc", "a b", "é"]
    names = sorted({"".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(rng.choice([4, 12, 40]))})
    df = spark.createDataFrame(texts, "rel_path string, source string, ranges array<struct<kind: string, start: int, end: int>>")
    for own in (names, [x for x in names if x.isalnum() and x.isascii()]):
        found = phrases.chosen(df, spark.createDataFrame([(x,) for x in own], "phrase string"), fold=True)
        got = [tuple(r) for r in found.select("rel_path", "range_no", "phrase", "start", "end", "line", "col").collect()]
        assert sorted(got) == sorted(f[:-1] for f in longest(everywhere(texts, own, True)) if f[-1])


def test_case_counts_unless_folded(spark):
    df = spark.createDataFrame([("a", "Cited X-1, x-1"), ("b", None)], "rel_path string, source string")
    found = phrases.occurrences(df, spark.createDataFrame([("X-1",)], "phrase string"))
    assert [(r.rel_path, r.start, r.free) for r in found.collect()] == [("a", 6, True)]


def test_many_names_share_no_key(spark):
    """Names that differ in their ends alone are found by their ends."""
    names = spark.range(20_000).select(F.format_string("a-common-beginning-%06d", "id").alias("phrase"))
    keys = phrases.keyed(names)
    assert keys.groupBy("gram").count().agg(F.max("count")).first()[0] <= 200
    wanted = phrases._Wanted.of(phrases._with_kinds(keys, True))
    assert len(wanted.bits) * 64 <= phrases.MAX_BITS and wanted.sizes == {phrases.GRAM: [8], phrases.INNER: [], phrases.WORD: []}
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 500_000).astype(np.uint8)
    assert len(wanted.places(text, 8)[0]) < 2_000  # little but keys passes the bitmap


def test_one_hot_name_and_own_page(spark):
    rows = [(f"{i}.md", f"{i}", "the the-x the", [("prose", 0, 13)]) for i in range(300)]
    pages = spark.createDataFrame(rows, "rel_path string, page_id string, source string, ranges array<struct<kind: string, start: int, end: int>>")
    names = spark.createDataFrame([("the",), ("7",)], "page_id string")
    got = mentions.mentions(pages, names).groupBy("concept").count().collect()
    assert [tuple(r) for r in got] == [("the", 600)]


@pytest.mark.parametrize("chunk", [1 << 20, 8])
@pytest.mark.parametrize("own", ["words", "all"])
def test_counts_as_chosen(spark, monkeypatch, chunk, own):
    """Counts by phrase and path; paths that come twice, names that texts may not count, hyphens at a text's ends."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rng = random.Random(chunk)
    sources = ["".join(rng.choices(["ab", "a", "A", "b_", " ", " ", "-", "_", "é", ".", "\n"], k=rng.randint(0, 30))) for _ in range(200)] + ["a-", "-a", "a", "a-b", "b", "-b a", "a_-a", "_-a"]
    texts = [(f"{k % 150}.md", t, [("prose", 0, len(t.encode()) // 2), ("code", 0, 1), ("prose", len(t.encode()) // 2, len(t.encode()))]) for k, t in enumerate(sources)]
    names = ["a", "ab", "b_", "aa", "never"] + (["a b", "b-a", "é"] if own == "all" else [])
    own_name = ["a" if k % 7 == 0 else "x" for k in range(150)]
    alike = {k for k in range(150) if k + 150 < len(texts)}
    if own == "all":  # which texts share a path counts for names beyond a word
        texts = [x for k, x in enumerate(texts) if k % 150 not in alike]
    found = []
    for path, *text in texts:
        got = longest(everywhere([(path, *text)], names, True))
        found += [(f[2], path) for f in got if f[-1] and f[2] != own_name[int(path[:-3])]]
    rows = [(p, own_name[int(p[:-3])], True if int(p[:-3]) in alike or int(p[:-3]) % 3 == 0 else None, s, r) for p, s, r in texts]
    df = spark.createDataFrame(rows, "rel_path string, own string, repeated boolean, source string, ranges array<struct<kind: string, start: int, end: int>>").repartition(3)
    counts = phrases.counted(df, spark.createDataFrame([(x,) for x in [*names, ""]], "phrase string"), fold=True)
    got = sorted(map(tuple, counts.collect()))
    assert got == sorted((n, sum(f[0] == n for f in found), len({f for f in found if f[0] == n})) for n in {f[0] for f in found}) and len(got) >= 4


def held(plan):
    """The rows that any aggregate of a plan that ran gave."""
    own = [plan.metrics().apply("numOutputRows").value()] if "Aggregate" in plan.nodeName() else []
    below = plan.children()
    return own + [n for i in range(below.size()) for n in held(below.apply(i))]


def test_counts_hold_words_not_texts(spark, tmp_path):
    """What is grouped grows with the words looked for, not with the texts; ids that come twice are one file."""
    spark.createDataFrame([(0, "Red green blue"), (1, "green hill")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (300, 3000):
            documents = spark.range(n).selectExpr("id AS doc_id", "'a red Hill, blue and blue; green-house ' || id AS text")
            more = spark.createDataFrame([(7, "green red"), (7, "red"), (None, "red")], "doc_id long, text string")
            documents.unionByName(more).write.parquet(f"{tmp_path}/{n}/documents.parquet")
            spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/{n}/benchmark.parquet")
            df = queries.mentions_of_terms(spark, f"{tmp_path}/{n}")
            assert sorted(map(tuple, df.collect())) == [("blue", 2 * n, n), ("green", 1, 1), ("hill", n, n), ("red", n + 2, n)]
            assert max(held(df._jdf.queryExecution().executedPlan())) <= 100
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
