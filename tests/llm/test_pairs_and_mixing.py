"""Preference formatting and mixing."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import op3_preferences as op3
from quillgraph.llm import op4_mixing as op4


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def spans(turns, at):
    out = []
    for r, t in turns:
        begin = at + len(f"<|im_start|>{r or ''}\n")
        if r == "assistant":
            out.append(f"{begin}:{begin + len(t or '')}")
        at = begin + len(t or "") + len("<|im_end|>\n")
    return ",".join(out)


def brute(c, r):
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    prompt = render(c[:n])
    return n, prompt, render(c[n:]), render(r[n:]), spans(c[n:], len(prompt)), spans(r[n:], len(prompt))


def test_preferences(spark):
    conversations = {
        1: [("system", "sé"), ("user", "hi 😀"), ("assistant", "good")],
        2: [("system", "sé"), ("user", "hi 😀"), ("assistant", "bad"), ("user", "why"), ("assistant", None)],
        3: [("user", None), ("assistant", "x")],
        4: [("user", ""), ("assistant", "x")],
        5: [(None, "a")],
        6: [(None, "a")],
        7: [],
        8: [("user", "u" * 50_000), ("assistant", "")],
    }
    rows = [(k, i, r, t, "extra") for k, turns in conversations.items() for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost", "")]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")
    pairs = [(10, 1, 2), (11, 2, 1), (12, 3, 4), (13, 5, 6), (14, 1, 7), (15, 99, 8), (16, 1, 1), (17, None, 8)]
    got = op3.format_preferences(table, spark.createDataFrame(pairs, "pair_id long, chosen_id long, rejected_id long")).collect()
    assert len(got) == len(pairs)
    for r in got:
        _, c, j = next(p for p in pairs if p[0] == r.pair_id)
        assert tuple(r)[1:] == brute(conversations.get(c, []), conversations.get(j, [])), r.pair_id
        for side, where in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            for s in filter(None, where.split(",")):
                a, b = map(int, s.split(":"))
                assert (r.prompt + side)[b : b + 10] == "<|im_end|>" and a >= len(r.prompt)


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(sql)


def same(df, want):
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_preference_query(spark, tmp_path):
    rows = [(c, t, r, x) for c in range(9) if c != 4 for t, (r, x) in enumerate([("user", "a"), ("assistant", str(c // 4)), ("user", None)][: c % 4])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    same(op3.query(spark, str(tmp_path)), sql_rows(op3.SQL, conversations=table))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark, shares, seed=1, n=400):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 20, 60, 200])), rng.choices(list(shares), list(shares.values()))[0]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def check(df, got):
    sizes = {}
    by = defaultdict(int)
    for r in df.collect():
        sizes.setdefault((r.doc_id, r.source), []).append(len(WORD.findall(r.text or "")))
        by[r.source] += sizes[r.doc_id, r.source][-1]
    taken = defaultdict(int)
    goal = {}
    for r in got:
        assert r.size in sizes[r.doc_id, r.source] and 0 <= r.taken <= 2 * r.size and r.source_size == by[r.source]
        taken[r.source] += r.taken
        goal[r.source] = r.target
    total = sum(by.values())
    assert sum(goal.values()) == pytest.approx(1.5 * total)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free = [s for s in order if goal[s] < 2 * by[s] - 1e-6]
    assert all(goal[s] <= 2 * by[s] + 1e-6 for s in order)
    if free:  # sources below their cap share by weight; the others would get no less
        level = goal[free[0]] / weight[free[0]]
        assert all(goal[s] == pytest.approx(level * weight[s]) for s in free)
        assert all(weight[s] * level >= goal[s] - 1e-6 for s in order)
    return taken, goal


@pytest.mark.parametrize("shares", [{"a": 1, "b": 1, "c": 1}, {"hot": 30, "Z": 2, "é": 1, None: 3, "z": 1, "": 1}, {"only": 1}])
def test_mix(spark, shares, monkeypatch):
    monkeypatch.setattr(op4, "SHARD_ROWS", 37)
    df = corpus(spark, shares)
    got = op4.mix(df).collect()
    assert len(got) == df.count()
    taken, goal = check(df, got)
    for s, g in goal.items():
        assert abs(taken[s] - g) <= max(2, 0.02 * g), (s, taken[s], g)
    assert sorted(map(repr, op4.mix(df).collect())) == sorted(map(repr, got))


@pytest.mark.parametrize("shard_rows", [4096, 37, 4])
def test_mix_equals_its_sql(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(op4, "SHARD_ROWS", shard_rows)
    df = corpus(spark, {"a": 9, "b": 2, None: 1, "c": 3}, seed=7, n=300)
    same(op4.mix(df).drop("source"), sql_rows(op4.sql(shard_rows), documents=df))


def test_mix_of_a_tiny_source(spark):
    # Far below a block of the others.
    sizes = spark.createDataFrame([(i, "abc"[i % 3], 30_000_000) for i in range(300)] + [(1000, "d", 130)], "doc_id long, source string, size long")
    got = op4.mix_sizes(sizes).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.01 * r.target + 1 for r in got), got


@pytest.mark.parametrize("shares", [{"a": 1, "b": 1, "c": 1}, {"hot": 30, "Z": 2, "é": 1, None: 3, "z": 1}])
def test_mix_of_blocks_larger_than_shards(spark, shares, monkeypatch):
    # Many shards of about four rows, as large sources have shards of 4,096 rows and growing blocks.
    monkeypatch.setattr(op4, "SHARD_ROWS", 4)
    df = corpus(spark, shares, seed=3, n=1500)
    got = op4.mix(df).collect()
    assert len(got) == df.count()
    taken, goal = check(df, got)
    unit = {r.source: r.blocks * r.unit for r in op4.targets(op4.sized(df)).collect()}
    sizes = {r.source: r.source_size for r in got}
    for s, g in goal.items():
        assert taken[s] == min(unit[s], 2 * sizes[s]), (s, taken[s], g)
        assert abs(taken[s] - g) <= max(2, 0.02 * g), (s, taken[s], g)


def test_mix_of_odd_tables(spark):
    schema = "doc_id long, text string, source string, size int"
    odd = spark.createDataFrame([(1, None, "a", 0), (1, "x y", "a", 0), (1, "x y", "a", 0), (None, "p q r", None, 0), (2, " \t", "b", 0), (3, "long " * 30_000, "c", 0)], schema)
    check(odd, op4.mix(odd).collect())
    assert op4.mix(odd.limit(0)).count() == 0
    silent = spark.createDataFrame([(1, "", "a", 0), (2, None, "b", 0)], schema)
    assert [r.taken for r in op4.mix(silent).collect()] == [0, 0]


def test_highest_quotients(spark):
    rng = random.Random(4)
    for votes in ([53, 24, 23], [1] * 7, [1000, 1, 1, 1], [rng.random() * 100 for _ in range(40)], [0, 0, 5]):
        for seats in (0, 1, 6, 25, 137):
            quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
            want = Counter(i for _, i in quotients)
            df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "i long, votes double").withColumn("seats", F.lit(seats).cast("long"))
            assert {r.i: r.won for r in op4.apportion(df, [], "i").collect()} == {i: want.get(i, 0) for i in range(len(votes))}


def test_mixed_documents(spark):
    rows = [(1, "a b c", "s", "en", 5), (1, "a b c", "s", "en", 5), (2, "d  e\nf g", "s", "en", 8), (3, "h i", None, None, 3), (4, None, "t", "de", 0)]
    rows += [(10 + k, f"u{k} v w x", "t", "de", 8) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = op4.mixed_documents(df)
    assert out.columns == df.columns
    clash = df.select("*", *[F.lit(7).alias(c) for c in ("key", "ID", "of", "part", "times", "nr", "__key", "unit", "blocks")])
    mixed = op4.mixed_documents(clash)
    assert mixed.columns == clash.columns and {tuple(r)[5:] for r in mixed.collect()} == {(7,) * 9} and mixed.count() == out.count()
    texts = {r.doc_id: r.text for r in df.collect()}
    got = out.collect()
    for r in got:
        assert texts[r.doc_id].startswith(r.text) and WORD.findall(r.text) and (r.text == texts[r.doc_id] or r.n_chars == len(r.text))
    words = Counter()
    for r in got:
        words[r.source] += len(WORD.findall(r.text))
    goal = {r.source: r.target for r in op4.mix(df).collect()}
    assert all(abs(words[s] - g) <= max(3, 0.05 * g) for s, g in goal.items())


def test_mixed_documents_are_whole(spark):
    # One short document in a source of its own makes blocks of a word.
    rows = [(1, "only one", "tiny")] + [(10 + k, " ".join(f"w{k}-{i}" for i in range(100 + k % 7)), "abc"[k % 3]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {r[0]: r[1] for r in rows}
    words = Counter()
    for r in op4.mixed_documents(df).collect():
        assert r.text == texts[r.doc_id]
        words[r.source] += len(WORD.findall(r.text))
    goal = {r.source: r.target for r in op4.targets(op4.sized(df)).collect()}
    assert all(abs(words[s] - g) <= 60 for s, g in goal.items()), (words, goal)
