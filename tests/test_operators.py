"""Column rules, settings, walking, mentions and edits."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import markdown, paths
from quillgraph.functions import scalars as S
from quillgraph.operators import edits as E
from quillgraph.operators import lint, mentions, parse, phrases, resolve
from quillgraph.plans.wiki import Wiki
from quillgraph.sources import config, corpus, ignore

PATHS = ["a.b.md", "x/Ünï Ä.md", "wiki/A.md", "", "a%20b+c.md", "%zz.md", "%ff.md", "../../a/./b.md", "a//b", "/abs.md", "C:x.md", "d/.md", "a#b?<>\".md", "é%C3%A9.md"]


def test_columns_agree_with_plain_functions(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = rows.select("p", S.url_decode("p").alias("decoded"), S.url_encode("p").alias("encoded"), S.normalize_path("p").alias("normal"), S.is_relative_md("p").alias("md"), S.relative_path(F.lit("x/y"), S.normalize_path("p")).alias("rel"), S.resolved_path(F.lit("d/e/f.md"), "p").alias("resolved")).collect()
    for r in got:
        assert r.decoded == paths.decode(r.p), r
        assert r.encoded == paths.encode(r.p)
        assert r.normal == paths.normalize(r.p)
        assert r.md == paths.is_relative_md(r.p), r
        assert r.rel == paths.relative("x/y", paths.normalize(r.p))
        assert r.resolved == paths.resolve("d/e/f.md", r.p)


def test_names_fold_ascii_only(spark):
    row = spark.createDataFrame([("w/ÀΘ A.b.md",)], "p string").select(S.page_id("p"), S.stem("p"), S.directory("p"), S.directory(F.lit("x.md")), S.heading_anchor(F.lit("Greek Letter Θ! x_y-")), S.percent(F.lit(1), F.lit(8)), S.percent(F.lit(3), F.lit(8))).first()
    assert [*row] == ["ÀΘ a.b", "ÀΘ A.b", "w", ".", "greek-letter-Θ-x_y", 12, 38]


def test_byte_offsets(spark):
    row = spark.createDataFrame([("é\nab",)], "s string").select(S.byte_slice("s", F.lit(3), F.lit(5)), S.line_of("s", F.lit(4)), S.column_of("s", F.lit(4)), S.column_of("s", F.lit(2))).first()
    assert [*row] == ["ab", 2, 2, 3]


def test_rename_wikilink(spark):
    cases = {"[[old]]": "[[New]]", "[[old#h|x]]": "[[New#h|x]]", "![[old|New]]": "![[New]]", "[[old|other]]": "[[New|other]]", "plain": "plain"}
    rows = spark.createDataFrame([(k,) for k in cases], "m string").select("m", S.rename_wikilink("m", "New").alias("n")).collect()
    assert {r.m: r.n for r in rows} == cases


@pytest.mark.parametrize(
    "text",
    [
        'bogus = [',
        "[linking]\nreference_style_threshold = 2\n",
        '[linking]\nlink_style = "markdown"\nreference_style_threshold = 0\n',
        '[linking]\nlink_style = "other"\n',
        '[checks]\nbroken_links = "loud"\n',
        'verbatim = ["!keep"]\n',
        '[[rules]]\ncheck = "required-sections"\n',
        '[[rules]]\ncheck = "unknown"\n',
        '[[rules]]\ncheck = "required-sections"\nsections = ["a"]\nwhen = "type != x"\n',
        '[[rules]]\ncheck = "citation-pattern"\nname = "n"\nmatch_in = "d"\n',
        '[[rules]]\ncheck = "citation-pattern"\nname = "n"\nmatch_in = "d"\npattern = "("\n',
        '[[rules]]\ncheck = "citation-pattern"\nname = "n"\nmatch_in = "d"\npattern = "x"\npreset = "bold-method-year"\n',
    ],
)
def test_bad_settings(text):
    with pytest.raises(config.ConfigError):
        config.parse(text)


def test_settings():
    c = config.parse(config.EXAMPLE)
    assert c.rules[-1].match_mode == "filename" and c.rules[-1].severity == "warn" and c.rules[0].severity == "error"
    assert config.parse("").directories == (config.Directory("wiki"),) and config.parse('index = ""').index is None
    c = config.parse('[[directories]]\npath = "a/"\n[[directories]]\npath = "a/b/"\n')
    assert [d.path for d in c.directories] == ["a/b", "a"]
    assert config.Predicate.parse("type == 'x y'") == config.Predicate("type", "x y")


def test_walk(tmp_path):
    for p in ("a.md", "b/c.md", "b/.hidden.md", "_x/_index.md", ".claude/x.md", "build/y.md", "b/skip/z.md", "b/n.txt", "keep/skip/k.md", ".git/g.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    (tmp_path / ".gitignore").write_text("build/\n")
    (tmp_path / "b/.gitignore").write_text("skip\n")
    assert corpus.walk(tmp_path, config.Ignore()) == ["_x/_index.md", "a.md", "b/.hidden.md", "b/c.md", "keep/skip/k.md"]
    assert ".claude/x.md" in corpus.walk(tmp_path, config.Ignore(default_patterns=False))
    assert corpus.walk(tmp_path, config.Ignore(patterns=("/b", "keep/**"))) == ["_x/_index.md", "a.md"]
    assert corpus.walk(tmp_path, config.Ignore(), "b") == ["b/.hidden.md", "b/c.md"]


def test_ignore_patterns():
    m = ignore.Matcher(["*.tmp.md", "/only", "deep/**/x.md", "!a.tmp.md", "dir/"])
    assert [m.ignores(p) for p in ("q/b.tmp.md", "only/z.md", "z/only/y.md", "deep/1/2/x.md", "a.tmp.md", "s/dir/f.md")] == [True, True, False, True, False, True]


def test_roots(tmp_path):
    (tmp_path / "w" / "deep").mkdir(parents=True)
    with pytest.raises(corpus.CorpusError):
        corpus.explicit_root(tmp_path)
    (tmp_path / "w" / "index.md").write_text("")
    assert corpus.discover(tmp_path / "w" / "deep") == (tmp_path / "w").resolve()
    assert config.detect(tmp_path / "w").directories[0].path == "."


def _mentions(spark, source, names, page="self"):
    pages = parse.parse_documents(spark.createDataFrame([(f"{page}.md", source)], "rel_path string, source string"), ("ranges",)).withColumn("page_id", F.lit(page))
    table = spark.createDataFrame([(n,) for n in names], "page_id string")
    return sorted((r.concept, r.start, r.line, r.col) for r in mentions.mentions(pages, table).collect())


@pytest.mark.parametrize("chunk", [None, 16])
def test_mentions(spark, monkeypatch, chunk):
    if chunk:
        monkeypatch.setattr(phrases, "CHUNK", chunk)
    names = ["grpo", "sft", "sa-sft", "deep learning", "self"]
    assert _mentions(spark, "Use GRPO, not xGRPO or GRPOx or self.\nGRPO-based SA-SFT é grpo_x (grpo)", names) == [("grpo", 4, 1, 5), ("grpo", 67, 2, 30), ("sa-sft", 49, 2, 12)]
    assert _mentions(spark, "# GRPO\n\n`GRPO` [[GRPO]] deep\nlearning **Deep Learning**", names) == [("deep learning", 40, 4, 12)]


def test_autolink_pages(spark):
    c = config.parse('[[directories]]\npath = "t"\n[[directories]]\npath = "n"\nautolink = false\n[linking]\nexclude = ["gone", "KEPT"]\n')
    files = [("t/a.md", ""), ("t/gone.md", ""), ("t/Kept.md", ""), ("t/off.md", "---\nautolink: false\n---\n"), ("t/str.md", '---\nautolink: "false"\n---\n'), ("n/b.md", ""), ("index.md", "")]
    pages = Wiki(spark.createDataFrame(files, "rel_path string, source string"), c).pages("frontmatter")
    assert {r.page_id for r in mentions.autolink_pages(pages, c).collect()} == {"a", "kept", "str"}


def test_edits(spark):
    files = spark.createDataFrame([("a", "héllo world\nsecond\n"), ("b", "abc"), ("c", "untouched")], "rel_path string, source string")

    def table(*rows):
        return spark.createDataFrame(rows, E.SCHEMA)

    good = table(("a", 7, 12, "there"), ("a", 0, 1, "J"), ("a", 20, 20, "end\n"), ("b", 3, 3, "!"))
    assert E.invalid(good, files).count() == 0
    assert {r.rel_path: r.source for r in E.apply_edits(files, good).collect()} == {"a": "Jéllo there\nsecond\nend\n", "b": "abc!"}
    bad = E.invalid(table(("b", 1, 4, ""), ("a", 2, 3, ""), ("a", 5, 8, ""), ("a", 7, 9, ""), ("x", 0, 0, "")), files)
    assert {(r.rel_path, r.reason) for r in bad.collect()} == {("b", "out of bounds"), ("a", "inside a character"), ("a", "overlaps"), ("x", "no such file")}
    with pytest.raises(E.EditError):
        E.checked(table(("b", 1, 3, ""), ("b", 2, 3, "")), files)
    assert E.render(E.hunks(files, table(("a", 13, 19, "next"), ("b", 0, 1, "X"))).collect()) == "--- a\n+++ a\n@@ -2 +2 @@\n-second\n+next\n--- b\n+++ b\n@@ -1 +1 @@\n-abc\n+Xbc\n"
    assert E.effective(table(("b", 0, 1, "a"), ("b", 1, 2, "z")), files).count() == 1


def test_resolution_quirks(spark):
    c = config.parse('index = ""\n[[directories]]\npath = "wiki"\n')
    files = [("wiki/x/T.md", "[self](T.md) [up](../../raw/x/T.md) [out](../../../../raw/x/T.md)"), ("raw/x/T.md", "[[T#Nope]]"), ("wiki/O.md", "[case](x/t.md) [[o]]")]
    w = Wiki(spark.createDataFrame(files, "rel_path string, source string"), c)
    # Files of one stem are one node; paths clamp at the root; case of paths counts; own links count as inbound.
    assert sorted((r.source, r.target) for r in w.refs_graph().collect()) == [("o", "o"), ("t", "t"), ("t", "t"), ("t", "t"), ("t", "t")]
    assert {(r.rel_path, r.reason_kind) for r in w.broken_links().collect()} == {("raw/x/T.md", "heading"), ("wiki/O.md", "page")}
    assert w.orphans().count() == 0


def test_lint_filter_and_missing_index(spark):
    c = config.parse('[[directories]]\npath = "w"\n')
    w = Wiki(spark.createDataFrame([("w/A.md", "[[Gone]]")], "rel_path string, source string"), c)
    assert {r.code for r in w.lint().collect()} == {"broken-link", "orphan"}
    assert w.lint("warn").count() == 0
    assert tuple(lint.summary(w.lint()).first()) == (2, 0)


def test_parse_only_what_is_wanted(spark):
    df = parse.parse_documents(spark.createDataFrame([("a.md", "# T\n^b"), ("b.md", None)], "rel_path string, source string"), ("headings", "block_ids"))
    assert df.columns == ["rel_path", "source", "headings", "block_ids"]
    assert [len(r.headings) for r in df.orderBy("rel_path").collect()] == [1, 0]
    assert resolve.categorised(df, config.WikiConfig()).where("is_managed").count() == 0
    assert markdown.normal_label(" A\n b ") == "a b"


def test_contained_ids(spark):
    ids = spark.createDataFrame([("T-1",), ("T-12",), ("é",), ("none",), ("a b",), ("",)], "phrase string")
    pages = spark.createDataFrame([("xT-12y",), (None,), ("a  b é",), ("T-12",)], "source string")
    found = phrases.contained(pages, ids)
    assert {r.phrase for r in found.collect()} == {"T-1", "T-12", "é"}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert phrases.contained(pages, ids.limit(0)).count() == 0
    assert phrases.contained(pages.limit(0), ids).count() == 0


def test_fields_of_the_top_level(spark):
    from quillgraph.operators import rewrite

    rows = [("p.md", ["a.b", "a", "it's"], '{"a.b": 1, "a": {"b": 2}, "it\'s": null}')]
    parsed = spark.createDataFrame(rows, "rel_path string, fm_keys array<string>, fm_json string")
    assert [rewrite.frontmatter_values(parsed, f).first().value for f in ("a.b", "a", "it's")] == ["1", '{"b":2}', "null"]


def test_escaped_replacement_characters(spark):
    from quillgraph.functions import scalars

    rows = spark.createDataFrame([("%EF%BF%BD.md",), ("�%ef%bf%bd",), ("%ff",), ("�%FF",), ("%C3%A9",), ("%zz",)], "p string")
    assert [r[0] for r in rows.select(scalars.url_decode("p")).collect()] == ["�.md", "��", None, None, "é", None]


IGNORABLE = ["a.md", "raw/a.md", "x/raw/a.md", "x/raw.md", "wiki/raw[1]/a.md", "wiki/k-1/a.md", "wiki/k&/b c.md", "deep/er/still/x.md", ".codex/a.md", "keep/no.md"]


@pytest.mark.parametrize(
    "own, nested",
    [
        ((), ()),
        (("raw/",), ()),
        (("/raw",), ()),
        (("raw*",), ()),
        (("**/still/", "wiki/**"), ()),
        (("k[-&]", "raw[[]1]", "b?c.md"), ()),
        (("*.md",), (("", "!a.md"),)),
        ((), (("", "*.md\n!no.md"), ("wiki", "!a.md\n# none\n"))),
        (("wiki/k-1",), (("deep", "er/\n!x.md"), ("deep/er", "!still"))),
    ],
)
def test_ignore_rules_as_columns_and_rows(spark, own, nested):
    """Columns and rows say what the walk's matchers say, folder by folder."""
    mine, others = ignore.Matcher(own), [ignore.from_text(text, base) for base, text in nested]

    def lost(path):
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            step, is_dir = "/".join(parts[:k]), k < len(parts)
            if mine.decide(step, is_dir) or next((d for m in reversed(others) if (d := m.decide(step, is_dir)) is not None), False):
                return True
        return False

    files = spark.createDataFrame([(p,) for p in IGNORABLE], "rel_path string")
    rules = ignore.rule_rows(spark.createDataFrame([(f"{b}/.gitignore" if b else ".gitignore", t) for b, t in nested], "rel_path string, source string"))
    left = ignore.left_by_rules(files.where(~ignore.ignored("rel_path", mine)), rules)
    assert sorted(r.rel_path for r in left.collect()) == sorted(p for p in IGNORABLE if not lost(p))


def test_folder_by_its_uri_reads_as_by_its_path(spark, tmp_path):
    files = {
        "index.md": "# Start\n[[one]]\n",
        "wiki/one.md": "# One é\n",
        "wiki/two words.md": "",
        "wiki/.gitignore": "*.md\n!one.md\n",
        "drafts/x.md": "never",
        "raw/[1].md": "r",
        "raw/upper.MD": "no",
        "wiki.toml": '[[directories]]\npath = "wiki"\n[ignore]\npatterns = ["drafts/"]\n',
    }
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    by_path, by_uri = Wiki.open(spark, tmp_path), Wiki.open(spark, tmp_path.as_uri())
    assert by_path.config == by_uri.config
    rows = sorted(map(tuple, by_uri.files.collect()))
    assert rows == sorted(map(tuple, by_path.files.collect())) and [r[0] for r in rows] == ["index.md", "raw/[1].md", "wiki/one.md"]
    shared = corpus.SharedFolder(spark, tmp_path.as_uri())
    assert [r.rel_path for r in shared.read(start="raw").collect()] == ["raw/[1].md"]
    assert shared.read(start="none").count() == 0
    assert by_uri.page("raw/[1].md").count() == 1
    (tmp_path / "raw" / "bad.md").write_bytes(b"\xff")
    with pytest.raises(Exception, match="(?i)malformed"):
        shared.read().collect()


def test_stored_pages_give_the_same_findings(spark):
    files = spark.createDataFrame([("index.md", "[[a]]"), ("wiki/a.md", "[[b]] [[c#x]]"), ("wiki/c.md", "# C")], "rel_path string, source string")
    plain, stored = Wiki(files, config.WikiConfig(directories=(config.Directory("wiki"),))), Wiki(files, config.WikiConfig(directories=(config.Directory("wiki"),)), store=lint.FACETS)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(stored.lint()) == key(plain.lint()) != []


def test_many_edits_meet_their_source_once(spark):
    """2,000 edits of one file: what is shuffled does not grow with edits times source."""
    rng = random.Random(4)
    lines = ["x" * rng.randint(0, 40) + "é" for _ in range(20_000)]
    source = "\n".join(lines)
    raw, at = source.encode(), 0
    rows = []
    for k, line in enumerate(lines):
        if k % 10 == 0:
            rows.append(("big.md", at, at + len(line) - 1, f"<{k}>"))
        at += len(line.encode()) + 1
    files = spark.createDataFrame([("big.md", source), ("other.md", "o")], "rel_path string, source string")
    edits = spark.createDataFrame(rows, E.SCHEMA).repartition(4)
    assert E.invalid(edits, files).count() == 0 and E.effective(edits, files).count() == len(rows)
    new = E.apply_edits(files, edits).first().source.split("\n")
    assert new == [f"<{k}>é" if k % 10 == 0 else x for k, x in enumerate(lines)]
    found = E.hunks(files, edits).collect()
    assert [(h.line, h.new) for h in found] == [(k + 1, f"<{k}>é\n") for k in range(0, 20_000, 10)]
    assert [h.old for h in found] == [lines[k] + "\n" for k in range(0, 20_000, 10)]
    moved = E._by_file(edits, files)
    assert moved.count() == 1 and len(moved.first().raw) == len(raw)


def test_links_to_one_page_stay_spread(spark):
    """Nine links in ten lead to one page; no task gets them all."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        links = spark.range(40_000, numPartitions=8).select(
            F.format_string("p%d.md", "id").alias("rel_path"),
            F.lit("name").alias("target_kind"),
            F.expr("CASE WHEN id % 10 > 0 THEN 'hot' WHEN id % 40 = 0 THEN 'gone' ELSE 'p' || (id % 5000) END").alias("target"),
        )
        links = links.unionByName(spark.createDataFrame([("a.md", "path", "/abs.md"), ("a.md", "name", "")], "rel_path string, target_kind string, target string"))
        pages = spark.range(5000).select(F.format_string("p%d.md", "id").alias("rel_path")).union(spark.createDataFrame([("hot.md",), ("a.md",)], "rel_path string")).withColumn("page_id", S.page_id("rel_path"))
        names = pages.select(F.col("page_id").alias("name"), "page_id", "rel_path")
        even, plain = (resolve.resolved(links, names, pages, even=x) for x in (True, False))
        columns = sorted(plain.columns)
        assert sorted(map(repr, even.select(*columns).collect())) == sorted(map(repr, plain.select(*columns).collect()))
        sizes = sorted(r["count"] for r in even.where("target = 'hot'").groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_most_specific_of_many_folders(spark):
    many = config.WikiConfig(directories=tuple(config.Directory(f"d{i}/e{i % 7}") for i in range(10_000)) + (config.Directory("d5"), config.Directory("d5/e5/f")))
    rows = [("d5/x.md", "d5"), ("d5/e5/f/g/x.md", "d5/e5/f"), ("d5/e5/x.md", "d5/e5"), ("d9999/e3/x.md", "d9999/e3"), ("d5x/a.md", None), ("e.md", None), ("d5", "d5")]
    df = spark.createDataFrame(rows, "rel_path string, want string").select("want", resolve.folder_of("rel_path", many).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    few = config.WikiConfig(directories=(config.Directory("a"), config.Directory(".")))
    assert [r[0] for r in spark.createDataFrame([("a/b.md",), ("c.md",)], "p string").select(resolve.folder_of("p", few)).collect()] == ["a", "."]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert spark.createDataFrame(rows, "rel_path string, want string").select(resolve.folder_of("rel_path", many))._jdf.queryExecution().optimizedPlan().toString().count("INSET") == 1 and "StartsWith" not in plan
