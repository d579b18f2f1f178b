"""The store of parsed pages."""

from quillgraph.operators import lint, parse
from quillgraph.plans.wiki import Wiki
from quillgraph.sources import config, corpus
from quillgraph.sources.store import ParseStore

WIKI = config.WikiConfig(directories=(config.Directory("wiki"),))


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "rel_path string, source string")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_only_new_content_is_parsed(spark, tmp_path):
    store = ParseStore(spark, tmp_path.as_uri())
    first = {"index.md": "[[a]]", "wiki/a.md": "[[b]] [[c#x]]", "wiki/c.md": "# C", "wiki/same1.md": "", "wiki/same2.md": "", "wiki/none.md": None}
    assert store.update(table(spark, first)) == 6
    assert store.update(table(spark, first)) == 0
    second = first | {"wiki/c.md": "# C\n\n## x", "wiki/new.md": "# N"}
    del second["wiki/same2.md"]
    assert store.update(table(spark, second)) == 2
    for state in (first, second):
        assert rows(store.parsed(table(spark, state)).select("rel_path", *[c for c in store._schema.names if c not in ("rel_path", "content")])) == rows(parse.parse_documents(table(spark, state), store.facets).drop("source"))
    store.compact(table(spark, second))
    assert store._table().count() == 6 and store.update(table(spark, second)) == 0
    assert store.update(table(spark, first)) == 2


def test_findings_from_the_store(spark, tmp_path, monkeypatch):
    files = table(spark, {"index.md": "[[a]]", "wiki/a.md": "[[b]] [[c#x]]", "wiki/c.md": "# C"})
    kept = ParseStore(spark, tmp_path.as_uri(), lint.FACETS)
    want = rows(Wiki(files, WIKI).lint())
    assert rows(Wiki(files, WIKI, parsed=kept).lint()) == want != []
    again = Wiki(files, WIKI, parsed=kept)
    found = again.lint()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and rows(found) == want  # the second time nothing is parsed


def test_one_page_is_read_alone(spark, tmp_path):
    for path, text in {"wiki.toml": '[ignore]\npatterns = ["hidden/"]\n', "a.md": "# A", "hidden/b.md": "# B"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    wiki = Wiki.open(spark, tmp_path)
    (tmp_path / "bad.md").write_bytes(b"\xff")  # reading this would fail
    assert [h.text for h in parse.headings(wiki.page("a.md", "headings")).collect()] == ["A"]
    assert [h.text for h in parse.headings(wiki.page("hidden/b.md", "headings")).collect()] == ["B"]  # outside of the scan
    (tmp_path / "a.md").write_text("# Changed")
    assert [h.text for h in parse.headings(wiki.page("a.md", "headings")).collect()] == ["A"]  # read once
    assert wiki.page("none.md").count() == 0
    assert corpus.read_file(spark, "viewfs://nowhere/x", "a.md") is None
