"""Command line: the queries as text, with exit codes.

0: fine; 1: broken links were found, or an error; 2: lint found errors.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import edits as E
from .operators import lint, rewrite
from .plans import setup
from .plans.wiki import Wiki
from .sources import config, corpus, sinks

PROMPT = {
    True: "This folder has a wiki.toml. Run `lint`, then `links check` and `links broken`, and adjust the rules until they say what the wiki intends.",
    False: "This folder has no wiki.toml. Run `scan` to see what is here, `setup init --show` for a proposal, then `setup init` to write it.",
}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph", description="Queries and rewrites over a folder of Markdown pages")
    p.add_argument("--root", help="folder of the wiki; else found from here upwards")
    sub = p.add_subparsers(dest="command", required=True)
    links = sub.add_parser("links").add_subparsers(dest="action", required=True)
    for name in ("check", "broken", "orphans"):
        links.add_parser(name)
    for name in ("fix", "format"):
        links.add_parser(name).add_argument("--write", action="store_true")
    refs = sub.add_parser("refs").add_subparsers(dest="action", required=True)
    for name in ("to", "from"):
        refs.add_parser(name).add_argument("page")
    refs.add_parser("graph")
    sub.add_parser("lint").add_argument("--severity", choices=sorted(lint.FILTERS), default="all")
    sub.add_parser("scan")
    for name, args in (("rename", ("old", "new")), ("move", ("page", "folder"))):
        q = sub.add_parser(name)
        for a in args:
            q.add_argument(a)
        q.add_argument("--write", action="store_true")
    q = sub.add_parser("sections").add_subparsers(dest="action", required=True).add_parser("rename")
    q.add_argument("old")
    q.add_argument("new")
    q.add_argument("--dirs", nargs="*")
    q.add_argument("--write", action="store_true")
    fm = sub.add_parser("frontmatter").add_subparsers(dest="action", required=True)
    q = fm.add_parser("get")
    q.add_argument("file")
    q.add_argument("field", nargs="?")
    q = fm.add_parser("set")
    q.add_argument("file")
    q.add_argument("field")
    q.add_argument("value")
    st = sub.add_parser("setup").add_subparsers(dest="action", required=True)
    st.add_parser("prompt")
    st.add_parser("example-config")
    q = st.add_parser("init")
    q.add_argument("--force", action="store_true")
    q.add_argument("--show", action="store_true")
    return p


def _rewrite(wiki: Wiki, root: Path, edits, write: bool, moves=None) -> int:
    moves = moves if moves is not None else wiki.files.sparkSession.createDataFrame([], "old string, new string")
    edits = edits.persist()
    planned = sorted({(r.old, r.new) for r in moves.collect()})
    if write:
        sinks.apply(root, moves, wiki.rewritten(edits))
    else:
        for old, new in planned:
            print(f"  {old} -> {new}")
        print(E.render(wiki.hunks(edits).collect()), end="")
    n = edits.count()
    print(f"{n} edit(s), {len(planned)} move(s) {'applied' if write else 'planned; use --write to apply'}" if n or planned else "nothing to do")
    return 0


def _scan(wiki: Wiki) -> int:
    found = {k: v.collect() for k, v in wiki.scan().items()}
    for d in found["directories"]:
        print(f"{d.dir}: {d.n_files} file(s)")
        for f in (x for x in found["fields"] if x.dir == d.dir):
            print(f"  field {f.field}: {f.n_files} ({f.pct}%)")
        more = 0
        for h in (x for x in found["headings"] if x.dir == d.dir):
            print(f"  ## {h.heading}: {h.n} ({h.pct}%)")
            more = h.n_more
        if more:
            print(f"  … and {more} more")
    for m in found["mirrors"]:
        print(f"mirror candidate: {m.left_dir} <-> {m.right_dir} ({m.n_files} files)")
    for i in found["index"]:
        print(f"index: {i.path} ({i.n_refs} unique refs)")
    return 0


def _lint(wiki: Wiki, severity: str) -> int:
    config_ = wiki.config
    if config_.index and config_.checks.index_coverage in lint.FILTERS[severity] and wiki.pages().where("is_index").first() is None:
        print(f"warning: index {config_.index} not found; coverage is not checked", file=sys.stderr)
    errors = warnings = 0
    for f in wiki.lint(severity).orderBy("code", "rel_path", "message").toLocalIterator():
        # These two checks call themselves errors whatever their severity.
        shown = "error" if f.code in ("orphan", "not-in-index") else f.severity
        print(f"{shown}[{f.code}]: {f.message}", file=sys.stderr)
        if f.detail and f.code == "broken-link":
            print(f"  -> {f.detail}", file=sys.stderr)
        errors += f.severity == "error"
        warnings += f.severity == "warn"
    parts = [f"{n} {what}(s)" for n, what in ((errors, "error"), (warnings, "warning")) if n]
    if parts:
        print(", ".join(parts), file=sys.stderr)
    return 2 if errors else 0


def run(spark: SparkSession, argv: list[str]) -> int:
    """Run one command; returns the exit code.  Lines of output and codes are fixed values."""
    a = _parser().parse_args(argv)
    root = corpus.resolve_root(a.root)
    if a.command == "setup" and a.action != "init":
        print(config.EXAMPLE if a.action == "example-config" else PROMPT[(root / config.FILE_NAME).exists()])
        return 0
    if a.command == "setup" and not (a.show or a.force) and (root / config.FILE_NAME).is_file():
        print(f"{config.FILE_NAME} already exists at {root / config.FILE_NAME}. Use --force to overwrite.", file=sys.stderr)
        return 0
    if a.command in ("scan", "setup"):
        wiki = Wiki(corpus.read_corpus(spark, root), config.detect(root), persist=True)
        if a.command == "scan":
            return _scan(wiki)
        text = setup.proposal(wiki.pages("frontmatter", "headings", "links"))
        print(text if a.show else f"created {sinks.write_config(root, text, a.force)}")
        return 0
    wiki = Wiki.open(spark, root, persist=True).check()
    action = getattr(a, "action", None)
    if a.command == "links" and action == "check":
        n = 0
        for m in wiki.mentions().toLocalIterator():
            print(f'{m.rel_path}:{m.line}:{m.col}: bare mention "{m.display}" (should be linked)')
            n += 1
        print(f"{n} bare mention(s)")
        return 0
    if a.command == "links" and action == "broken":
        n = 0
        for b in wiki.broken_links().withColumn("reason", lint.broken_reason()).toLocalIterator():
            print(f"{b.rel_path}:{b.line}:{b.col}: broken link {b.markup}: {b.reason}")
            n += 1
        print(f"{n} broken link(s)")
        return 1 if n else 0
    if a.command == "links" and action == "orphans":
        for o in wiki.orphans().toLocalIterator():
            print(f"{o.rel_path}: orphan page (no inbound links)")
        return 0
    if a.command == "links":
        if action == "format" and (n := wiki.skipped().count()):
            print(f"{n} link(s) skipped", file=sys.stderr)
        return _rewrite(wiki, root, wiki.fix() if action == "fix" else wiki.format(), a.write)
    if a.command == "refs":
        if action == "graph":
            for e in wiki.refs_graph().toLocalIterator():
                print(f"{e.source} -> {e.target}")
            return 0
        rows = (wiki.refs_to if action == "to" else wiki.refs_from)(a.page).collect()
        if not rows:
            print(f"no {'inbound links to' if action == 'to' else 'outbound links from'} '{a.page}'", file=sys.stderr)
        for r in rows:
            print(f"{r[0]} -> {a.page}" if action == "to" else f"{a.page} -> {r[0]}")
        return 0
    if a.command == "lint":
        return _lint(wiki, a.severity)
    if a.command == "rename":
        moves, edits = wiki.rename(a.old, a.new)
        return _rewrite(wiki, root, edits, a.write, moves)
    if a.command == "move":
        moves, edits = wiki.move(a.page, a.folder)
        return _rewrite(wiki, root, edits, a.write, moves)
    if a.command == "sections":
        return _rewrite(wiki, root, wiki.rename_section(a.old, a.new, a.dirs), a.write)
    if action == "get":
        print(rewrite.get_frontmatter(wiki.pages(), a.file, a.field))
        return 0
    return _rewrite(wiki, root, wiki.set_frontmatter(a.file, a.field, a.value), True)


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    try:
        return run(spark, sys.argv[1:] if argv is None else argv)
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
