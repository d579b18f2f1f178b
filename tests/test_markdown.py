"""The Markdown reader: structure of single documents."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.functions import frontmatter, markdown, paths
from quillgraph.functions.markdown import parse


def cut(source, a, b):
    return source.encode()[a:b].decode()


def test_links_of_both_styles():
    p = parse("Sow [[Kale#Under glass|early]] or [late](beds/Kale.md#in-rows); then [thin][k] and [Leek] out.\n\n[k]: beds/Kale.md#thinning\n[leek]: <beds/Leek.md>\n")
    assert [(x.style, x.target, x.frag, x.display, x.ref_label) for x in p.links] == [
        ("obsidian", "kale", "Under glass", "early", None),
        ("markdown", "beds/Kale.md", "in-rows", "late", None),
        ("markdown", "beds/Kale.md", "thinning", "thin", "k"),
        ("markdown", "beds/Leek.md", None, "Leek", "Leek"),
    ]


def test_external_destinations_are_not_internal():
    p = parse("[shop](http://seeds.example/kale.md), [disk](file:///kale.md), [mail](mailto:a@b.md), [root](/kale.md), [photo](kale.png), [spaced](old%20notes/kale.md), [plain](../kale.md)")
    assert [x.target for x in p.links] == ["old%20notes/kale.md", "../kale.md"]


def test_headings():
    p = parse("Garden *log*\n===\n\n## June ##\n\n#### Rows of `kale`\n\nWeather\n---\n\n## Beds {#beds}\n\n#tag\n\n~~~\n## fenced\n~~~\n")
    assert [(h["level"], h["text"]) for h in p.headings] == [(1, "Garden log"), (2, "June"), (4, "Rows of kale"), (2, "Weather"), (2, "Beds")]


def test_anchors_are_unique():
    assert markdown.anchors(["Dry Bed, Ωuter", "Rows", "Rows-1", "Rows", "Rows", "rows!"]) == ["dry-bed-Ωuter", "rows", "rows-1", "rows-2", "rows-3", "rows-4"]


def test_block_ids():
    assert parse("Sown on the 3rd. ^sown\n\n^row-2\n\n~~~\nin a fence ^fenced\n~~~\na^b ^no_good\n").block_ids == ["sown", "row-2", "fenced"]



def test_fragments_and_embeds():
    p = parse("[[bee-keeping#^hive-count]] ![[bee-keeping#^m]] [[page#Spring Work]] ![alt](pic.md)")
    assert [(x.target, x.frag_kind, x.frag, x.embed) for x in p.links] == [
        ("bee-keeping", "block", "hive-count", False),
        ("bee-keeping", "block", "m", True),
        ("page", "heading", "Spring Work", False),
    ]


def test_ranges():
    source = "---\na: 1\n---\n\nProse é [[link]] and `code`.\n\n# Head\n\n```\nfenced\n```\n\n    indented\n\n<http://a.b> <b>x</b>\n"
    found = [(k, cut(source, a, b)) for k, a, b in parse(source).ranges]
    for want in (("frontmatter", "---\na: 1\n---\n"), ("prose", "Prose é "), ("wikilink", "[[link]]"), ("prose", " and "), ("inline_code", "`code`"), ("heading", "Head"), ("code_block", "fenced\n"), ("code_block", "indented\n"), ("url", "<http://a.b>"), ("html_inline", "<b>")):
        assert want in found
    assert not any("fenced" in t for k, t in found if k == "prose")


def test_text_is_split_at_markup():
    source = "one *two* three\nfour \\* five & six &amp; seven a_b"
    assert [cut(source, a, b) for k, a, b in parse(source).ranges] == ["one ", "two", " three", "four ", "* five & six ", "&amp;", " seven a_b"]


def test_containers():
    source = "> quoted [[A]]\nlazy [[B]]\n\n- item [[C]]\n\n  more [[D]]\n1. one\n   - deep [[E]]\n\n| a | b |\n|---|---|\n| [[F\\|f]] | `x` [[G]] |\n"
    p = parse(source)
    assert [x.target for x in p.links] == list("abcdefg")
    assert [x.display for x in p.links][5:] == ["f", "G"]
    assert all(cut(source, x.start, x.end).startswith("[[") for x in p.links)


def test_code_hides_links():
    assert not parse("`[[a]]`\n\n```\n[[b]]\n```\n\n    [[c]]\n\n<!-- [[d]] -->\n\n<div>\n[[e]]\n</div>\n").links


def test_destinations():
    source = 'A [x](a.md "a.md") [y](<b c.md>) [z](p(q).md) ![i](pic.png)\n\n[ref]: <d e.md> "t"\n[multi\\]line]:\n  f.md\n'
    got = [(d, cut(source, a, b)) for d, a, b in parse(source).destinations]
    assert got == [("a.md", "a.md"), ("b c.md", "b c.md"), ("p(q).md", "p(q).md"), ("pic.png", "pic.png"), ("d e.md", "d e.md"), ("f.md", "f.md")]


def test_definitions_and_uses():
    p = parse("[One] [two][] ![img][One] [x][ONE] [none]\n\n[one]: a.md\n[Two]: b.md\n[one]: later.md\n")
    assert [(d["label"], d["destination"]) for d in p.definitions] == [("one", "a.md"), ("Two", "b.md")]
    assert sorted(p.uses) == ["ONE", "One", "One", "two"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #*_`[]()!|<>-\\\n\t~:é&;^1.", max_size=80))
def test_offsets_are_within_the_source(source):
    raw = source.encode()
    p = parse(source)
    for a, b in [(x.start, x.end) for x in p.links] + [(a, b) for _, a, b in p.ranges] + [(a, b) for _, a, b in p.destinations] + [(h["start"], h["end"]) for h in p.headings]:
        assert 0 <= a <= b <= len(raw)
        raw[a:b].decode()


def test_frontmatter():
    fm = frontmatter.parse("---\ntags: [a, 1, b]\ndate: 2026-01-01\nnested:\n  x: yes\noff: false\nnone:\n---\nBody")
    assert fm.data == {"tags": ["a", 1, "b"], "date": "2026-01-01", "nested": {"x": "yes"}, "off": False, "none": None}
    assert frontmatter.strings(fm.data["tags"]) == ["a", "b"] and frontmatter.strings("x") == ["x"] and frontmatter.strings(3) is None
    assert frontmatter.parse("# No\n") is None
    assert frontmatter.split("---\na: 1\n---anything\nrest") == ("\na: 1", 12)
    for bad in ("---\na: [\n---\n", "---\na: b: c\n---\n"):
        try:
            frontmatter.parse(bad)
        except frontmatter.FrontmatterError:
            continue
        raise AssertionError(bad)


def test_set_field():
    assert frontmatter.set_field("x", "n", "[1, two]") == (0, 0, "---\nn:\n- 1\n- two\n---\n\n")
    assert frontmatter.set_field("---\nb: '1'\na: x\n---\ny", "a", "true") == (0, 20, "---\nb: '1'\na: true\n---\n")
    try:
        frontmatter.set_field("---\n- a\n---\n", "k", "v")
    except frontmatter.FrontmatterError:
        return
    raise AssertionError


def test_paths():
    assert paths.decode("a%20b+c") == "a b+c" and paths.decode("%4") is None and paths.decode("%ff") is None
    assert paths.encode('a b%#?<>"') == "a%20b%25%23%3F%3C%3E%22"
    assert paths.normalize("./a/../../b/./c") == "b/c"
    assert paths.relative("a/b", "a/c/d.md") == "../c/d.md" and paths.relative("", "x.md") == "x.md"
    assert paths.in_folder("wiki/a.md", "wiki") and not paths.in_folder("wikiology/a.md", "wiki") and paths.in_folder("x", ".")
    assert paths.is_relative_md("a%20b.md") and not any(map(paths.is_relative_md, ("x:y.md", "/a.md", "a.MD", ".md", "%zz.md")))
