"""The tree as a data source: what is listed, who lists it, and writing back."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillgraph.plans.wiki import Wiki
from quillgraph.sources import above, config, corpus, folders, ignore, sinks, tree


def put(root: Path, files: dict[str, str]) -> None:
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def listing(root: Path) -> dict[str, str]:
    return {str(p.relative_to(root)): p.read_text() for p in sorted(root.rglob("*")) if p.is_file()}


SMALL = {"index.md": "[[a]]", "_index.md": "i", "_d/a.md": "A", ".h/c.md": "C", "b/.hidden.md": "h", "b/c.MD": "no", "b/.md": "no", "b/n.txt": "no", ".git/g.md": "no", ".codex/x.md": "no", "é x/ü.md": "é"}


def test_path_and_uri_give_the_same(spark, tmp_path):
    put(tmp_path, SMALL)
    by_path = {r.rel_path: r.source for r in Wiki.open(spark, tmp_path).files.collect()}
    by_uri = {r.rel_path: r.source for r in Wiki.open(spark, tmp_path.as_uri()).files.collect()}
    assert by_path == by_uri == {p: SMALL[p] for p in ("index.md", "_index.md", "_d/a.md", ".h/c.md", "b/.hidden.md", "é x/ü.md")}
    assert corpus.read_corpus(spark, tmp_path, config.Ignore(), "none").count() == 0
    (tmp_path / "bad.md").write_bytes(b"\xff")
    with pytest.raises(Exception, match="not UTF-8"):
        corpus.read_corpus(spark, tmp_path).collect()


def forest(root: Path, rng: random.Random) -> None:
    names = ["a", "b", "build", "drafts", "_x", ".y", "deep"]
    for _ in range(120):
        put(root, {"/".join([*rng.choices(names, k=rng.randint(0, 5)), f"{rng.randint(0, 9)}.md"]): ""})
    places = sorted({p.parent for p in root.rglob("*.md")})
    for p in rng.sample(places, len(places) // 4):
        lines = rng.sample(["build/", "[0-4].md", "!3.md", "/drafts", "deep/**/b", "*", "!*.md", "# no", "a/"], k=rng.randint(1, 4))
        (p / rng.choice([".gitignore", ".gitignore", ".ignore"])).write_text("\n".join(lines) + "\n")


class Watched(folders.LocalFolder):
    listed: list[str]

    def entries(self, rel_path):
        self.listed.append(rel_path)
        return super().entries(rel_path)


@pytest.mark.parametrize("seed", range(3))
def test_tasks_find_what_one_process_finds(spark, tmp_path, seed):
    forest(tmp_path, random.Random(seed))
    rules = config.Ignore(patterns=("_x/", "/a/b/[5-9].md"))
    want = corpus.walk(tmp_path, rules)
    for fanout in (1, 3, 1000):
        rows = [r.rel_path for r in tree.paths(spark, str(tmp_path), rules, fanout=fanout).collect()]
        assert sorted(rows, key=lambda p: p.split("/")) == want
    below = [p for p in want if p.startswith("a/")]
    if below:
        assert sorted(r.rel_path for r in tree.paths(spark, str(tmp_path), rules, "a").collect()) == sorted(below)
    # Every folder is listed at most once in a walk, and none that is ignored.
    pruned = tree.Pruned(Watched(str(tmp_path)), rules.effective())
    pruned.folder.listed = []
    assert sorted(pruned.files("", ())) == sorted(want)
    assert len(pruned.folder.listed) == len(set(pruned.folder.listed)) and not any("_x" in p.split("/") for p in pruned.folder.listed)


def test_the_planner_hands_out_folders(tmp_path):
    for k in range(40):
        put(tmp_path, {f"d{k}/e/{i}.md": "" for i in range(5)})
    put(tmp_path, {f"{i}.md": "" for i in range(300)} | {".gitignore": "d1*/\n"})
    reader = tree.TreeReader({"root": str(tmp_path), "patterns": "[]", "fanout": "8"})
    parts = reader.partitions()
    assert {(p, x.deep) for x in parts for p in x.paths} == {("", False)} | {(f"d{k}", True) for k in range(40) if k != 1 and k // 10 != 1}
    assert len(parts) <= 9 and sum(len(b) for x in parts for b in reader.read(x)) == 300 + 5 * 29


def test_nearest_ignore_file_and_the_two_kinds(tmp_path):
    put(tmp_path, {p: "" for p in ("x.md", "a/x.md", "a/b/x.md", "a/y.md", "c/x.md")})
    put(tmp_path, {".gitignore": "x.md\n", "a/.gitignore": "!x.md\ny.md\n", "a/b/.gitignore": "x.md\n", ".ignore": "!y.md\n/c\n"})
    assert corpus.walk(tmp_path, config.Ignore()) == ["a/x.md", "a/y.md"]


def test_links_to_folders_are_not_followed(tmp_path):
    put(tmp_path, {"a/x.md": ""})
    (tmp_path / "a/loop").symlink_to(tmp_path)
    (tmp_path / "y.md").symlink_to(tmp_path / "a/x.md")
    assert corpus.walk(tmp_path, config.Ignore()) == ["a/x.md", "y.md"]


def test_moves_then_contents(spark, tmp_path):
    put(tmp_path, {"a.md": "A", "b.md": "B", "c.md": "C"})
    files = corpus.read_corpus(spark, tmp_path)
    changed = files.where("rel_path <> 'c.md'").select("rel_path", F.concat("source", F.lit("é+")).alias("source"))
    moves = spark.createDataFrame([("a.md", "new/deep/a2.md"), ("a.md", "new/deep/a2.md")], "old string, new string")
    sinks.apply(tmp_path, moves, changed)
    assert listing(tmp_path) == {"new/deep/a2.md": "Aé+", "b.md": "Bé+", "c.md": "C"}
    sinks.apply(tmp_path.as_uri(), moves.limit(0), spark.createDataFrame([("n/1.md", "1"), ("n/2.md", None)], "rel_path string, source string"))
    assert listing(tmp_path)["n/1.md"] == "1" and listing(tmp_path)["n/2.md"] == ""


def test_a_rename_walks_the_tree_twice(spark, monkeypatch):
    """Before the plan and for the result, however many branches the plan has."""
    from quillgraph.plans import queries

    walked = []
    monkeypatch.setattr(queries.tree, "read", lambda *a, real=tree.read, **more: walked.append(real(*a, **more)) or walked[-1])
    plans = []
    monkeypatch.setattr(queries.sinks, "apply", lambda root, moves, new, real=sinks.apply: plans.append(new._jdf.queryExecution().optimizedPlan().toString()) or real(root, moves, new))
    got = {r.rel_path for r in queries.tree_rename(spark, "/root/testdata/sf0.001").collect()}
    assert "wiki/nations/Nation Three.md" in got and "wiki/nations/NATION_3.md" not in got
    assert len(walked) == 2 and tree.NAME not in plans[0]


def test_a_failure_leaves_the_tree_alone(spark, tmp_path):
    put(tmp_path, {f"{i}.md": str(i) for i in range(40)})
    before = listing(tmp_path)
    files = corpus.read_corpus(spark, tmp_path)
    none = spark.createDataFrame([], "old string, new string")
    failing = files.select("rel_path", F.when(F.col("rel_path") == "7.md", F.raise_error(F.lit("no"))).otherwise("x").alias("source"))
    for moves, rewritten in (
        (none, failing),
        (spark.createDataFrame([("1.md", "2.md")], "old string, new string"), files),
        (spark.createDataFrame([("1.md", "n.md"), ("gone.md", "m.md")], "old string, new string"), files),
        (none, spark.createDataFrame([("../out.md", "x")], "rel_path string, source string")),
    ):
        with pytest.raises(sinks.SinkError):
            sinks.apply(tmp_path, moves, rewritten)
        assert listing(tmp_path) == before


@pytest.mark.parametrize("wide", [1000, 3])
def test_rules_as_rows_leave_what_the_walk_finds(spark, tmp_path, monkeypatch, wide):
    """With ``WIDE`` = 3 a folder counts as wide only if it holds a third of the files."""
    monkeypatch.setattr(above, "WIDE", wide)
    forest(tmp_path, random.Random(wide))
    put(tmp_path, {".ignore": "!b/\n", "a/.ignore": "9.md\n", "a/.gitignore": "!9.md\n[0-8].md\n"})
    every = spark.createDataFrame([(str(p.relative_to(tmp_path)), p.read_text()) for p in tmp_path.rglob("*") if p.is_file()], "rel_path string, source string")
    rules = config.Ignore(patterns=("deep/a/",))
    left = corpus.without_ignored(corpus.markdown_files(every), rules, ignore.rule_rows(every))
    assert sorted((r.rel_path for r in left.collect()), key=lambda p: p.split("/")) == corpus.walk(tmp_path, rules)


def test_many_ignore_files_in_a_plan_of_one_size(spark):
    """10,000 ignore files; a third of the files lie in one folder."""
    files = spark.range(30_000).select(F.expr("if(id % 3 = 0, 'hot/' || id || '.md', 'd' || id % 10000 || '/' || id || '.md')").alias("rel_path"))
    texts = spark.range(10_000).select(F.expr("'d' || id || '/.gitignore'").alias("rel_path"), F.expr("'*' || (id % 10) || '.md\n!*1' || (id % 10) || '.md\n'").alias("source"))
    root = spark.createDataFrame([(".gitignore", "*7.md\n"), ("hot/.gitignore", "!*77.md\n")], "rel_path string, source string")
    few = ignore.left_by_rules(files, ignore.rule_rows(root))
    many = ignore.left_by_rules(files, ignore.rule_rows(texts.union(root)))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(many) < 1.5 * size(few) + 2000
    got = {r.rel_path for r in many.collect()}

    def kept(i):
        name = str(i)
        if i % 3 == 0:
            return name.endswith("77") or not name.endswith("7")
        own = str(i % 10_000 % 10)
        return True if name.endswith("1" + own) else False if name.endswith(own) else not name.endswith("7")

    assert got == {f"hot/{i}.md" if i % 3 == 0 else f"d{i % 10_000}/{i}.md" for i in range(30_000) if kept(i)}
