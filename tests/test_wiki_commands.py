"""Commands over a gardener's notebook in a folder: files in, files and text out.

The notebook has managed folders ``plants`` and ``beds``, a journal that is not
managed, a mirror of the plants in ``seeds``, and an index.
"""

import pytest

from quillgraph import cli

FOLDERS = '[[directories]]\npath = "plants"\n[[directories]]\npath = "beds"\n'
NOTEBOOK = {
    "index.md": "# Garden\n\n- [[Runner Bean]]\n- [[Kale]]\n- [[North Bed]]\n",
    "plants/Runner Bean.md": "---\naliases: [scarlet bean]\nfamily: legume\n---\n\n# Runner Bean\n\n## Sowing\n\nSow in May. ^may\n\n## Harvest\n",
    "plants/Kale.md": "---\nfamily: brassica\n---\n\n# Kale\n\nFollows the [bean](Runner%20Bean.md#harvest) in the [[North Bed]].\n",
    "beds/North Bed.md": "# North Bed\n\n## Harvest\n\n## Harvest\n\nSee [[#Harvest]] above.\n",
    "journal/june.md": "Planted [[scarlet bean]] and kale; see [rows](../beds/North%20Bed.md#harvest-1).\n",
}


@pytest.fixture
def wiki(tmp_path, spark, capsys):
    class Folder:
        def make(self, config, **files):
            (tmp_path / "wiki.toml").write_text(config)
            for name, text in files.items():
                path = tmp_path / name
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(text)
            return self

        def run(self, *argv):
            capsys.readouterr()
            try:
                code = cli.run(spark, ["--root", str(tmp_path), *argv])
            except (ValueError, RuntimeError) as e:
                return 1, "", str(e)
            out = capsys.readouterr()
            return code, out.out, out.err

        def text(self, name):
            return (tmp_path / name).read_text()

        def exists(self, name):
            return (tmp_path / name).exists()

    return Folder()


def notebook(**more):
    return {**NOTEBOOK, **more}


def test_graph_of_the_notebook(wiki):
    wiki.make(FOLDERS, **notebook())
    assert wiki.run("links", "broken")[0] == 0
    assert wiki.run("links", "orphans")[1] == ""
    edges = wiki.run("refs", "graph")[1].splitlines()
    assert edges == sorted(edges) and "june -> runner bean" in edges and "north bed -> north bed" in edges and edges.count("kale -> runner bean") == 1
    # A page answers to its alias.
    assert wiki.run("refs", "to", "Scarlet Bean")[1].count("journal/june.md") == wiki.run("refs", "to", "runner bean")[1].count("journal/june.md") == 1
    assert wiki.run("refs", "from", "june")[1].splitlines() == ["june -> north bed", "june -> runner bean"]
    assert "no outbound links" in wiki.run("refs", "from", "Turnip")[2]


def test_broken_fragments_and_pages(wiki):
    bad = {
        "journal/july.md": "[[Runner Bean#Pruning]] [[Kale#^frost]] [[Marrow]] [ok](../plants/Runner%20Bean.md#sowing) [[Runner Bean#^may]] [web](https://seeds.example/list.md)\n",
        "beds/South Bed.md": "[third](North%20Bed.md#harvest-2) and [gone](West.md) and ![[Kale#kale]]\n",
    }
    wiki.make(FOLDERS, **notebook(**bad))
    code, out, _ = wiki.run("links", "broken")
    lines = [x for x in out.splitlines() if ".md:" in x]
    assert code == 1 and len([x for x in lines if x.startswith("journal/july.md:1:")]) == 3 and len([x for x in lines if x.startswith("beds/South Bed.md:1:")]) == 2
    code, _, err = wiki.run("lint")
    # The journal is not managed: its broken links only warn, while the bed's are errors, and nobody lists that bed.
    assert code == 2 and err.count("warn[broken-link]") == 3 and err.count("error[broken-link]") == 2 and "error[orphan]: beds/South Bed.md" in err


def test_folders_kept_verbatim_are_not_read(wiki):
    wiki.make('verbatim = ["journal/"]\n' + FOLDERS, **notebook(**{"journal/july.md": "[[Marrow]] Runner Bean\n", "notes.md": "The runner bean climbs.\n"}))
    assert wiki.run("links", "broken")[0] == 0
    out = wiki.run("links", "check")[1]
    assert 'notes.md:1:5: bare mention "Runner Bean"' in out and "journal" not in out


def test_rename_of_a_page_everywhere(wiki):
    more = {"journal/july.md": "[[Runner Bean|Pole Bean]], [[runner bean#Sowing|when]] and [that][rb].\n\n[rb]:\n  ../plants/Runner%20Bean.md\n"}
    wiki.make(FOLDERS, **notebook(**more))
    code, out, _ = wiki.run("rename", "Runner Bean", "Pole Bean")
    assert code == 0 and "--- plants/Kale.md" in out and "+Follows the [bean](Pole%20Bean.md#harvest) in" in out and wiki.exists("plants/Runner Bean.md")
    assert wiki.run("rename", "Runner Bean", "Pole Bean", "--write")[0] == 0
    assert wiki.exists("plants/Pole Bean.md") and not wiki.exists("plants/Runner Bean.md")
    # An alias that says the new name already goes; others stay, and so does a link by the page's alias.
    assert wiki.text("journal/july.md") == "[[Pole Bean]], [[Pole Bean#Sowing|when]] and [that][rb].\n\n[rb]:\n  ../plants/Pole%20Bean.md\n"
    assert "- [[Pole Bean]]\n" in wiki.text("index.md") and wiki.run("links", "broken")[0] == 0


def test_move_of_a_page(wiki):
    wiki.make(FOLDERS, **notebook())
    assert wiki.run("move", "Kale", "../elsewhere")[0] == 1
    assert "+Follows the [bean](../../plants/Runner%20Bean.md#harvest) in the" in wiki.run("move", "Kale", "beds/old")[1]
    wiki.run("move", "North Bed", "plants", "--write")
    assert wiki.text("journal/june.md").endswith("see [rows](../plants/North%20Bed.md#harvest-1).\n")
    assert wiki.exists("plants/North Bed.md") and not wiki.exists("beds/North Bed.md")


def test_rename_of_a_section(wiki):
    wiki.make(FOLDERS, **notebook(**{"journal/july.md": "[[Runner Bean#sowing]] [r][s]\n\n[s]: ../plants/Runner%20Bean.md#sowing\n"}))
    wiki.run("sections", "rename", "Sowing", "When to sow", "--write")
    assert "## When to sow\n" in wiki.text("plants/Runner Bean.md")
    assert wiki.text("journal/july.md") == "[[Runner Bean#When to sow]] [r][s]\n\n[s]: ../plants/Runner%20Bean.md#when-to-sow\n"
    assert wiki.run("links", "broken")[0] == 0


def test_links_in_markdown_style(wiki):
    wiki.make(FOLDERS + '[linking]\nlink_style = "markdown"\nreference_style_threshold = 2\n', **notebook(**{"journal/july.md": "[[Kale]], [[Kale]] again, [[North Bed]].\n"}))
    wiki.run("links", "format", "--write")
    once = wiki.text("journal/july.md")
    assert once == "[Kale], [Kale] again, [North Bed](../beds/North%20Bed.md).\n\n[Kale]: ../plants/Kale.md\n"
    assert "nothing to do" in wiki.run("links", "format", "--write")[1] and wiki.text("journal/july.md") == once


def test_links_in_wiki_style(wiki):
    text = "[k][1] then [the row](../beds/North%20Bed.md#harvest-1), [may](../plants/Runner%20Bean.md#^may), [other](../shed/Tools.md), ![p][2]\n\n[1]: ../plants/Kale.md\n[2]: p.png\n"
    wiki.make(FOLDERS, **notebook(**{"journal/july.md": text, "shed/Tools.md": ""}))
    assert "[[Kale|k]]" in wiki.run("links", "format")[1] and wiki.text("journal/july.md") == text
    wiki.run("links", "format", "--write")
    # A second heading of the same text, a page outside the managed folders and images have no wiki form.
    assert wiki.text("journal/july.md") == "[[Kale|k]] then [the row](../beds/North%20Bed.md#harvest-1), [[Runner Bean#^may|may]], [other](../shed/Tools.md), ![p][2]\n\n[2]: p.png\n"


def test_mentions_become_links(wiki):
    wiki.make(FOLDERS, **notebook(**{"journal/july.md": "Soup of kale, kale-based broth, `kale`, unkale.\n"}))
    out = wiki.run("links", "check")[1]
    assert 'journal/june.md:1:30: bare mention "Kale"' in out and 'journal/july.md:1:9: bare mention "Kale"' in out and out.endswith("2 bare mention(s)\n")
    wiki.run("links", "fix", "--write")
    assert wiki.text("journal/july.md")== "Soup of [[Kale]], kale-based broth, `kale`, unkale.\n" and wiki.text("journal/june.md").startswith("Planted [[scarlet bean]] and [[Kale]]; see")


def test_rules(wiki):
    rules = (
        '[checks]\norphan_pages = "off"\nindex_coverage = "off"\n'
        '[[rules]]\ncheck = "required-frontmatter"\nwhen = "family == legume"\nfields = ["sown"]\n'
        '[[rules]]\ncheck = "required-sections"\ndirs = ["beds"]\nsections = ["soil"]\nseverity = "warn"\n'
        '[[rules]]\ncheck = "mirror-parity"\nleft = "plants"\nright = "seeds"\n'
        '[[rules]]\ncheck = "citation-pattern"\nname = "lot"\npattern = "(?P<id>LOT-[0-9]+)"\nmatch_in = "seeds"\n'
    )
    wiki.make(FOLDERS + rules, **notebook(**{"seeds/Kale.md": "Bought as LOT-7.\n", "plants/Leek.md": "LOT-7, LOT-8, LOT-8\n"}))
    code, _, err = wiki.run("lint")
    assert code == 2
    assert "plants/Runner Bean.md is missing 'sown'" in err and err.count("missing-frontmatter") == 1
    assert "warn[missing-section]: beds/North Bed.md" in err and err.count("missing-section") == 1
    assert "plants/Runner Bean.md has no seeds/Runner Bean.md" in err and "plants/Leek.md has no seeds/Leek.md" in err and "Kale.md has no" not in err
    assert err.count("plants/Leek.md references 'LOT-8'") == 2 and "LOT-7'" not in err
    assert "missing-section" not in wiki.run("lint", "--severity", "error")[2]


def test_names_are_unique_among_managed_pages(wiki):
    # A page of the same name beside them is no clash, an alias is.
    wiki.make(FOLDERS, **notebook(**{"journal/Kale.md": "# A day\n"}))
    assert wiki.run("links", "orphans")[0] == 0
    wiki.make(FOLDERS, **{"beds/Scarlet Bean.md": ""})
    code, _, err = wiki.run("links", "broken")
    assert code == 1 and "alias-is-page" in err


def test_frontmatter_of_a_page(wiki):
    wiki.make(FOLDERS, **notebook())
    assert wiki.run("frontmatter", "get", "plants/Kale.md", "family")[1] == '"brassica"\n'
    assert wiki.run("frontmatter", "get", "plants/Kale.md", "sown")[0] == 1 and "no frontmatter" in wiki.run("frontmatter", "get", "beds/North Bed.md", "soil")[2]
    wiki.run("frontmatter", "set", "beds/North Bed.md", "soil", "clay")
    assert wiki.text("beds/North Bed.md").startswith("---\nsoil: clay\n---\n\n# North Bed\n")
    wiki.run("frontmatter", "set", "plants/Kale.md", "family", "cabbage")
    assert wiki.run("frontmatter", "get", "plants/Kale.md")[1] == '{\n  "family": "cabbage"\n}\n'


def test_scan_and_proposed_settings(wiki):
    wiki.make(FOLDERS, **notebook(**{"seeds/Kale.md": "", "seeds/Runner Bean.md": ""}))
    out = wiki.run("scan")[1]
    assert "plants: 2 file(s)" in out and "field family: 2 (100%)" in out and "field aliases: 1 (50%)" in out and "## Harvest: 2 (200%)" in out
    assert "plants <-> seeds (2 files)" in out and "index: index.md (3 unique refs)" in out
    shown = wiki.run("setup", "init", "--show")[1]
    # Both sides of the mirror are content here, so neither has to follow the other.
    assert 'fields = ["family"]' in shown and '[[directories]]' not in shown and "mirror-parity" not in shown
    before = wiki.text("wiki.toml")
    assert "--force" in wiki.run("setup", "init")[2] and wiki.text("wiki.toml") == before
    assert wiki.run("setup", "init", "--force")[0] == 0 and wiki.text("wiki.toml") != before


def test_proposed_mirror_of_a_content_folder(wiki):
    wiki.make("", **{"wiki/herbs/Mint.md": "## Uses\n", "wiki/herbs/Sage.md": "## Uses\n", "scans/herbs/Mint.md": "", "scans/herbs/Sage.md": ""})
    shown = wiki.run("setup", "init", "--show")[1]
    assert 'sections = ["Uses"]' in shown and 'left = "wiki/herbs"\nright = "scans/herbs"' in shown and 'path = "scans/herbs"' not in shown


def test_rename_takes_the_mirror_along(wiki):
    wiki.make(FOLDERS + '[[rules]]\ncheck = "mirror-parity"\nleft = "plants"\nright = "seeds"\n', **notebook(**{"seeds/Kale.md": "packet\n", "seeds/Runner Bean.md": ""}))
    wiki.run("rename", "Kale", "Curly Kale", "--write")
    assert wiki.text("seeds/Curly Kale.md") == "packet\n" and wiki.exists("plants/Curly Kale.md") and not wiki.exists("seeds/Kale.md")


def test_proposed_settings_are_read_back(wiki):
    """Headings and folders with quotes, backslashes and control characters."""
    from quillgraph.sources import config

    wiki.make("", **{'we"ird\\dir/a.md': '## Say "hi" \\ now\n', 'we"ird\\dir/b.md': '## Say "hi" \\ now\n\n## tab\there\n'})
    shown = wiki.run("setup", "init", "--show")[1]
    rules = config.parse(shown).rules
    assert [(r.check, r.dirs, r.sections) for r in rules] == [("required-sections", ('we"ird\\dir',), ('Say "hi" \\ now',))]
