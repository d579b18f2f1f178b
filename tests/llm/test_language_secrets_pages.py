"""Language identification, secret scan, page extraction and the pipeline."""

import hashlib
import math
import pickle
import random
import re
import string
import time
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import op6_language_ppm as op6
from quillgraph.llm import op9_secrets as op9
from quillgraph.llm import op10_text_density as op10
from quillgraph.llm.op10_text_density import extract_pages, main_text

# Language


def code_length(text, counts, order=3):
    """Bits of a text under a context tree with escapes (method C, exclusion), byte by byte."""
    raw = b"\n" * order + text
    bits = 0.0
    for i in range(order, len(raw)):
        for n in range(order, -1, -1):
            seen = counts.get(raw[i - n : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if raw[i] in seen:
                bits -= math.log2(seen[raw[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def tree(texts, order=3):
    counts = {}
    for text in texts:
        raw = b"\n" * order + text
        for i in range(order, len(raw)):
            for n in range(order + 1):
                own = counts.setdefault(raw[i - n : i], {})
                own[raw[i]] = own.get(raw[i], 0) + 1
    return counts


def pruned(trees, room):
    """The trees with the commonest bytes-in-context of each order, by their largest share in a tree."""
    total = [sum(t[b""].values()) for t in trees]
    for order, size in {1: room // 8, 2: room // 4, 3: room - room // 8 - room // 4}.items():
        share = {}
        for t, n in zip(trees, total, strict=True):
            for c, own in t.items():
                if len(c) == order:
                    for x, k in own.items():
                        share[c + bytes([x])] = max(share.get(c + bytes([x]), 0), k / n)
        gone = sorted(share, key=lambda c: (-share[c], c))[size:]
        for t in trees:
            for c in gone:
                t.get(c[:-1], {}).pop(c[-1], None)
    return trees


@pytest.mark.parametrize("room", [1 << 26, 20_000, 4_000])
def test_code_lengths_are_exact(room, monkeypatch):
    rng = random.Random(2)
    texts = {"a": [bytes(rng.choices(b"abc d", k=60)) for _ in range(5)], "b": [bytes(rng.choices(b"xyz\xc3\xa9 a", k=80)) for _ in range(4)]}
    codes = {}
    for lang, own in texts.items():
        buf = np.frombuffer(b"".join(own), np.uint8)
        codes[lang] = op6.count_contexts(buf, np.cumsum([0, *map(len, own)]))
    model = pickle.loads(pickle.dumps(op6.freeze(["a", "b"], codes, room)))
    probes = [b"abc", b"", b"a", b"xyz\xc3\xa9!", b"\n\nab", bytes(rng.choices(b"abcxyz d!", k=9000)), b"", b"ab"]
    got = model.lengths(np.frombuffer(b"".join(probes), np.uint8), np.cumsum([0, *map(len, probes)]))
    trees = pruned([tree(texts[k]) for k in "ab"], room // (2 * (8 + op6._ROW_BYTES)))
    want = [[code_length(p, t) for t in trees] for p in probes]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)
    assert (got[1] == 0).all() and (got[[0, 2, 3]] > 0).all()


def test_model_keeps_its_bound():
    rng = np.random.default_rng(1)
    langs = [f"l{k:03}" for k in range(100)]
    codes = {x: op6.count_contexts(rng.integers(0, 256, 20_000).astype(np.uint8), np.array([0, 20_000])) for x in langs}
    model = op6.freeze(langs, codes, 20 << 20)
    tables = [*model.known, *model.escape]
    assert sum(t.rows.nbytes + len(t.keys) * op6._ROW_BYTES for t in tables) <= 20 << 20
    assert all(len(t.keys) for t in tables)  # every order stays in use
    assert len({len(t.keys) for t in tables}) > 1


def languages(spark, n=240):
    rng = random.Random(1)
    syllables = {"xx": ["ka", "to", "mi", "ra"], "yy": ["schl", "ung", "ei", "ö"], "zz": ["que", "ión", "os", "la"]}

    def text(lang):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))

    rows = [(i, text(lang), lang, "s") for i in range(n) for lang in [rng.choice(sorted(syllables))]]
    rows += [(1000, None, "xx", "s"), (1001, "", "xx", "s"), (1002, "123 !!! --- ½ ² _", "yy", "s"), (None, "kato mira", "xx", "s"), (1003, text("zz").upper(), None, "s"), (1004, text("yy") * 800, "yy", "s"), (1004, "kato", "yy", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_language(spark):
    df = languages(spark)
    found = op6.predict(df, op6.learn(df)).withColumn("held", op6.held_out(F.col("doc_id"))).collect()
    assert len(found) == df.count()
    for r in found:
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if not any(unicodedata.category(c).startswith("L") for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    own = [r for r in found if r.held and r.lang and r.lang_pred != "und" and r.doc_id < 1000]  # one row of 1004 is labelled wrong
    assert len(own) > 40 and sum(r.lang_pred == r.lang for r in own) >= 0.99 * len(own)
    assert next(r for r in found if r.doc_id == 1003).lang_pred == "zz"


def test_no_language_is_lost(spark, monkeypatch):
    """Counts beyond the bound: languages of few documents stay, with those of many and beside many others."""
    rng = random.Random(6)

    def language():
        syllables = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 3))) for _ in range(25)]
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(150)]
        return lambda n: " ".join(rng.choices(words, k=n))

    monkeypatch.setattr(op6, "ROWS", 12_000)
    speak = [language() for _ in range(40)]
    learned = [k for k in range(40) for _ in range(150 if k < 6 else 4)]
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    df = spark.createDataFrame([(i, speak[k](60), f"l{k:02}") for i, k in zip(ids, learned, strict=False)], "doc_id long, text string, lang string")
    model = op6.learn(df)
    assert model.langs == [f"l{k:02}" for k in range(40)]
    asked = spark.createDataFrame([(k, speak[k](40)) for k in range(40) for _ in range(3)], "doc_id long, text string")
    assert all(r.lang_pred == f"l{r.doc_id:02}" for r in op6.predict(asked, model).collect())
    assert op6._least_counts(["a", "a", "b", "b", "b"], [9, 1, 5, 2, 1], [10, 20_000, 7, 11_000, 30_000]) == {"a": 9, "b": 2}


def test_language_is_not_learned_from_held_out_rows(spark):
    df = languages(spark)
    held = op6.held_out(F.col("doc_id"))
    changed = df.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    a, b = op6.learn(df), op6.learn(changed)
    assert a.langs == b.langs and all((x.rows == y.rows).all() and (x.keys == y.keys).all() for x, y in zip(a.known + a.escape, b.known + b.escape, strict=True))
    assert op6.learn(df.where(held)) is None


def test_language_filter(spark):
    df = languages(spark)
    kept = op6.known_language(df)
    assert kept.columns == df.columns
    lost = {r.doc_id for r in df.collect()} - {r.doc_id for r in kept.collect()}
    assert {1000, 1001, 1002} <= lost and len(lost) < 8
    assert op6.known_language(df.limit(0)).count() == 0
    clash = df.withColumn("score", F.lit("own")).withColumn("lang_pred", F.lit(1))
    kept = op6.known_language(clash)
    assert kept.columns == clash.columns and {r.score for r in kept.collect()} == {"own"}
    assert op6.predict(clash, None).where("score = 0").count() == df.count()


# Secrets


def either(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base.sort()
    more = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        c = m[0]
        if not (re.search("[0-9]", c) and re.search("[A-Za-z]", c)) or any(re.search(p, c) for p in op9.ALLOWED):
            continue
        least = next(bits for _, p, bits in op9.CLASSES if re.search(p, c))
        runs = []
        plain = re.sub(op9.ALLOWED_PART, " " * 10, c)
        for i in range(len(c) - 19):
            w = plain[i : i + 20]
            if " " not in w and round(-sum(w.count(x) / 20 * math.log2(w.count(x) / 20) for x in set(w)), 6) >= least:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + 20
                else:
                    runs.append([i, i + 20])
        more += [(m.start() + a, 3, m.start() + b) for a, b in runs if not any(x < m.start() + b and m.start() + a < y for x, _, y in base)]
    told = lambda spans: ",".join(f"{op9.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(told(base).encode()).hexdigest(), told(sorted(base + more)))


def test_secrets(spark, tmp_path):
    rng = random.Random(3)
    letters = string.ascii_letters + string.digits
    texts = [None, "", "a" * 5000 + "1" * 50, "word " * 40_000 + "token=abcdefgh1"]
    for _ in range(300):
        body = "".join(rng.choices(rng.choice([letters, "0123456789abcdef", "ABCDEF0123456789+/", letters + "+/=_-."]), k=rng.randint(0, 60)))
        head = rng.choice(["token: ", "API_KEY=\"", "secret=secret: ", "pass ", "AKIA", "password = '", "x=550e8400-e29b-41d4-a716-446655440000 ", "ſecret=", "toKen="])
        texts.append(rng.choice(["", "é𝕏 ", " x"]) + head + body + rng.choice(["", " ", "\n", "é"]) + "".join(rng.choices("abcdefghijk=: 1234567890", k=rng.randint(0, 30))))
    texts += ["ab-12-" * 20_000, "".join(rng.choices(letters + "+/", k=5000)), "x" + "".join(rng.choices(letters, k=300)) + "0123456789" + "".join(rng.choices(letters, k=300))]
    texts += ["".join(rng.choices("abcd1234ABCD", weights=[9] + [1] * 11, k=3 * op9.PIECE))]  # runs here and there, also at cuts
    texts += [" ".join("".join(rng.choices(rng.choice([letters, "0123456789abcdef"]), k=40)) for _ in range(700)), "secret=" + "f" * 40 + "/" + "".join(rng.choices(letters, k=60)) + " AKIA" + "".join(rng.choices(letters, k=60))]
    texts += texts[-5:]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op9.query(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) and any("entropy" in r.spans for r in got)
    for r in got:
        assert tuple(r)[1:] == brute(texts[r.doc_id]), texts[r.doc_id][:200]


# Pages


BODY = "".join(f"<p>Paragraph {k} with quite some words of running text, &amp; more of it to read.</p>" for k in range(6))
WANT = "\n\n".join(f"Paragraph {k} with quite some words of running text, & more of it to read." for k in range(6))
LINKS = "<ul>" + "".join(f'<li><a href="/{k}">Go to place number {k}</a></li>' for k in range(12)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav>{LINKS}</nav><article>{BODY}</article><footer>&copy; me</footer></body></html>",
        f"<body><header><a href=/>Home</a></header><div class='content'>{BODY}</div><aside>{LINKS}</aside></body>",
        f"<body><div id=menu>{LINKS}</div><div><div>{BODY}</div></div><div class='cookie-notice'>We use cookies and tell you so at length in this notice.</div>",
        f"<body><div>{LINKS}</div><main>{BODY}<section class=comments><p>First! A reader's comment that is long enough to count as text.</p></section></main>",
        f"<body><article>{BODY}<form><p>Subscribe to our letter</p><input></form><div class='ad'>Buy this now.</div></article><!-- <p>no</p> --><div class=sidebar>{LINKS}</div>",
        f"<article><!-- open >{'' and ''}--> {BODY.replace('</p>', '')}</article><div hidden>hidden words</div>",
        f"<body><table class=layout><tr><td>{LINKS}<td>{BODY}</table>",
        f"<body class='no-sidebar'><div class='page has-sidebar'><div class='site-header'>Our site, known everywhere for what it says</div><div class='post'>{BODY}</div><div id=sidebar>{LINKS}</div></div>",
        f"<body><div class='widget'><article class='notice'>{BODY}</article></div><footer>f</footer>",
    ],
)
def test_main_text(page):
    assert main_text(page) == WANT


@pytest.mark.parametrize("label", ["market-share-in-2020", "related-work", "discussion", "hidden-markov-models", "comments"])
def test_headings_are_judged_by_no_id(label):
    assert main_text(f"<body><article>{BODY}<h2 id='{label}'>T</h2><p id={label}>Last words.</p></article>") == f"{WANT}\n\nT\n\nLast words."
    if label != "comments":
        assert main_text(f"<body><article>{BODY}<section id={label}><p>Last words.</p></section></article>").endswith("Last words.")


@pytest.mark.parametrize("label", ["content-sidebar-wrap", "page-with-sidebar", "sidebar-wrap"])
def test_wrappers_of_an_article_are_not_cut(label):
    page = f"<body><div id=menu>{LINKS}</div><div><p>{'What else there is to say on this site. ' * 3}</p></div><div class='{label}'><article>{BODY}</article><div class=sidebar>{LINKS}</div><div class='related-posts'><article>Other.</article></div></div>"
    assert main_text(page) == main_text(f"<body><article>{BODY}</article>")


def test_title_outside_the_article():
    assert main_text(f"<body><main><h1>The title</h1><article>{BODY}</article><ul><li><a href=x>more</a></ul></main>") == "The title\n\n" + WANT
    assert main_text(f"<body><div class='entry'><header class='entry-header'><h1>T</h1></header>{BODY}</div>") == WANT
    assert main_text(f"<article><header><h1>The title</h1></header>{BODY}</article>") == "The title\n\n" + WANT


def test_text_of_blocks():
    page = "<article><h1> A&nbsp;title\n <i>in</i>line</h1><p>One<br>two <b>three</b>&lt;x&gt;<p>Next <a href=#>link</a>.<ul><li>item<li>other</ul><pre>a\n  b</pre>tail text</article>"
    assert main_text(page) == "A title inline\n\nOne two three<x>\n\nNext link.\n\nitem\n\nother\n\na b\n\ntail text"


def grown(rng, depth):
    """A random element as (name, children), children being elements or texts."""
    name = rng.choice(["div", "div", "section", "p", "ul", "a", "span", "nav"] if depth else ["p", "a", "span"])
    kids = []
    for _ in range(rng.randint(1, 4)):
        kids.append(" ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(1, 25))) if not depth or name == "p" or rng.random() < 0.3 else grown(rng, depth - 1))
    return (name, kids)


def written_out(e):
    return e if isinstance(e, str) else f"<{e[0]}>{''.join(map(written_out, e[1]))}</{e[0]}>"


def counted(e):
    """(characters, linked characters, tags, link tags) in an element, by recursion."""
    if isinstance(e, str):
        return (len(e.replace(" ", "")), 0, 0, 0)
    c, lc, t, lt = map(sum, zip(*map(counted, e[1])))
    inner = [k[0] for k in e[1] if not isinstance(k, str)]
    t, lt = t + len(inner), lt + inner.count("a")
    return (c, c, t, t) if e[0] == "a" else (c, lc, t, lt)


def test_densities_by_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        tree = ("body", [grown(rng, 3) for _ in range(5)])
        page = written_out(tree)
        whole = counted(tree)
        found = []

        def density(e, whole=whole):
            c, lc, t, lt = counted(e)
            if not c:
                return 0.0
            t, lt = max(1, t), max(1, lt)
            base = math.log(c / max(1, c - lc) * lc + whole[1] / max(1, whole[0]) * c + math.e)
            return max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + 1) / math.log(base + 1))

        def walk(e, path, cut):
            cut = cut or e[0] == "nav"
            path = [*path, density(e)]
            kids = [k for k in e[1] if not isinstance(k, str)]
            if counted(e)[0] and not cut and e[0] not in ("a", "span"):
                total = sum(counted(k)[0] for k in e[1] if isinstance(k, str)) + sum(density(k) for k in kids if k[0] != "nav")
                found.append((total, min(path), e[0]))
            for k in kids:
                walk(k, path, cut)

        walk(tree, [], False)
        root, texts = op10._parse(page)
        order = op10._settle_cuts(root, texts)
        path, threshold = op10._core(order, op10._measure(order))
        best = max(found, key=lambda x: x[0])
        assert path[0].total == pytest.approx(best[0]) and path[0].name == best[2] and threshold == pytest.approx(best[1])


@pytest.mark.parametrize("bad", ["<a ", '<a ">" ', '<a "', "<i>", "<!-- ", "<div></p>", "<p a=", "<li><i>", "</b>", "<b 'x\">"])
def test_broken_pages_take_time_in_proportion(bad):
    began = time.perf_counter()
    main_text(bad * (400_000 // len(bad)) + "</b>" * 1000)
    assert time.perf_counter() - began < 20


def test_siblings_that_reach_the_threshold():
    parts = "".join(f"<section>{BODY}<p>Part {k}.</p></section>" for k in range(3))
    page = f"<body><div>{LINKS}</div><div><div>{parts}</div></div><div class='meta'><a href=x>one</a> <a href=y>two</a></div></body>"
    assert main_text(page) == "\n\n".join(f"{WANT}\n\nPart {k}." for k in range(3))
    assert main_text(f"<body><article>{BODY}<p class='related'>A related thought.</p></article>").endswith("A related thought.")
    assert main_text(f"<body><form id=aspnet><div>{BODY}</div><input></form><footer>f</footer>") == WANT


def test_odd_pages(spark):
    pages = [None, "", "   ", "plain text only", "<", "<p", "</div></p>", "<!-- never closed", "<b>" * 3000 + "deep", "<div>" * 3000 + "deep div", "<script>", "<a href='x>y'>z</a>", "x" * 300_000, "<p>" + "long words " * 50_000 + "</p>"]
    rows = [(i, "u", h, "t") for i, h in enumerate(pages)] + [(3, "u", pages[3], "t")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "plain text only" and text[8] == "deep" and text[9] == "deep div" and text[12] == "x" * 300_000
    assert all(text[i] == "" for i in (0, 1, 2, 7, 10)) and len(text[13].split()) == 100_000
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Pipeline


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    df = languages(spark, 90).where("doc_id IS NOT NULL").where("doc_id < 1004").withColumn("n_chars", F.length("text").cast("long"))
    rows = [tuple(r) for r in df.collect()]
    item = " ".join(f"q{k}" for k in rng.choices(range(50), k=20))
    long = max((r for r in rows if r[1]), key=lambda r: len(r[1]))
    rows += [(2000, long[1], "xx", "t", len(long[1])), (2001, long[1].replace(" ", "  ", 1), "xx", "t", len(long[1])), (2002, "kato mira " + item, "xx", "t", 99)]
    spark.createDataFrame(rows, df.schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = [r[0] for r in rows]
    want = {"language": {*ids} - {1000, 1001, 1002}, "near_copies": None, "decontaminate": None}
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = [r.doc_id for r in out.collect()]
        if name == "language":
            assert want[name] - {*got} == set() or len(want[name] - {*got}) < 3
        if name == "near_copies":
            assert not {2000, 2001} & {*got} and long[0] in got and 2002 in got
        if name == "decontaminate":
            assert 2002 not in got and long[0] in got
        docs = out
    final = pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.n_tokens for r in final) == max(r.start + r.n_tokens for r in final)
    assert {r.doc_id for r in final} <= {*ids}
