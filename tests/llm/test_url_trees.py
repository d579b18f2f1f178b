"""URL rules against brute force; the trees by held-out accuracy."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import op11_url_trees as op11


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:stop]


def best_rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/1", "http://example.org/en/1", "http://example.org/en/2", "http://notexample.org/es/",
    "http://org/", "http://org", "http://x.org?q=/es/", "ftp://com/de/x#/fr/", "http://a.com/fr/../de/", "http://É.COM/de/", "//x.com/de/", "http://a.com:80/de/",
    "http://u@h.com/de/?a=1&b=2;c&&#f", "http://a.com/de", "mailto:x://y.com/fr/z", "http://b.net/a\nb/c.html", "http://b.net/x://y.org/es/", "http://example.com./de/",
]


def test_hosts_paths_and_rules(spark, monkeypatch):
    monkeypatch.setattr(op11, "TREES", 3)
    rows = [(i, u, "kept out") for i, u in enumerate(URLS)] + [(None, URLS[4], "x"), (4, URLS[4], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = op11.judged(df).collect()
    assert len(got) == len(rows)
    by_url = {(r.page_id): r for r in got if r.page_id is not None}
    for i, u in enumerate(URLS):
        host, path = parts(u)
        rule, verdict = best_rule(host, path, op11.RULES)
        r = by_url[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert 0 <= r.score <= 1
    rules = (("block", "c", "/"), ("allow", "b.c", "/"), ("allow", "c", "/long/path"), ("block", "b.c", "/long/"))
    nested = spark.createDataFrame([(i, f"x://{h}{p}") for i, (h, p) in enumerate((h, p) for h in ("c", "b.c", "a.b.c", "bc") for p in ("/", "/long/", "/long/path/", ""))], "page_id long, url string")
    urls = {r.page_id: parts(r.url) for r in nested.collect()}
    for r in op11.judged(nested, rules).collect():
        assert r.rule == best_rule(*urls[r.page_id], rules)[0]


def test_lexical_features(spark):
    read = spark.createDataFrame([(u,) for u in URLS], "url string").withColumn("host", op11.host()).withColumn("path", op11.path())
    for r in op11.lexical(read).collect():
        u = r.url or ""
        folded = [c if c < "\x80" else "\x7f" for c in u]
        entropy = -sum(n / len(u) * math.log2(n / len(u)) for n in Counter(folded).values()) if u else 0
        assert r.entropy == pytest.approx(entropy)
        assert r.length == len(u) and r.digit_ratio == pytest.approx(sum("0" <= c <= "9" for c in u) / max(1, len(u)))
        assert r.path_depth == len([x for x in r.path.split("/") if x])
        query = u.split("#")[0].partition("?")[2].replace(";", "&")
        assert r.n_parameters == len([x for x in query.split("&") if x])
        assert r.fragment_length == len(u.partition("#")[2])
        assert r.suffixes[:2] == [r.host.split(".")[-1], ".".join(r.host.split(".")[-2:])]
    giant = spark.createDataFrame([("http://a.net/" + "xyzé0" * 100_000,)], "url string").withColumn("host", op11.host()).withColumn("path", op11.path())
    assert op11.lexical(giant).first().length == 500_013


def test_held_out_accuracy(spark):
    rng = random.Random(6)

    def url(bad):
        word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
        if bad:
            return f"http://{word()}{rng.randint(100, 99999)}.{rng.choice(['biz', 'net'])}/{rng.randint(1, 10**9)}/{word()}?" + "&".join(f"{word()}={rng.randint(1, 10**6)}" for _ in range(rng.randint(1, 6)))
        return f"https://{word()}.{rng.choice(['net', 'edu'])}/" + "/".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([".html", ""])

    rows = [(url(b), b) for b in rng.choices([True, False], k=3000)]
    df = spark.createDataFrame(rows, "url string, blocked boolean").withColumn("host", op11.host()).withColumn("path", op11.path())
    model = op11.UrlModel.fit(df.limit(2000).unionByName(df.limit(2000)))
    held_out = spark.createDataFrame([(url(b), b) for b in rng.choices([True, False], k=800)], "url string, blocked boolean").withColumn("host", op11.host()).withColumn("path", op11.path())
    right = model.score(held_out).where((F.col("score") >= 0.5) == F.col("blocked")).count()
    assert right > 0.95 * 800


def test_a_sample_learns_alike(spark):
    rows = [(i, f"http://h{i % 50}.{'com' if i % 2 else 'net'}/{'de' if i % 3 else 'fr'}/{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = (("block", "com", "/de/"), ("allow", "com", "/fr/"))
    got = op11.judged(df, rules, sample=500).where("rule IS NULL").collect()
    assert len(got) == 2000
    right = sum((r.verdict == "block") == r.path.startswith("/de/") for r in got)
    assert right > 1900  # what the folders say of .com holds for .net


def test_one_verdict_no_labels_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.com/de/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in op11.judged(df, (("block", "com", "/de/"),)).collect()} == {1: "block", 2: "block"}
    assert {r.verdict for r in op11.judged(df, ()).collect()} == {"allow"}
    assert op11.judged(df.limit(0)).count() == 0
