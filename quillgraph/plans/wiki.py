"""A wiki: a corpus and its settings, with all queries as DataFrames."""

from __future__ import annotations

from functools import cached_property, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits as E
from ..operators import format as formatting
from ..operators import graph, inventory, lint, mentions, parse, resolve, rewrite
from ..sources import config as settings
from ..sources import corpus
from ..sources.config import WikiConfig
from ..sources.shared import stored
from ..sources.store import ParseStore


class WikiError(ValueError):
    """A wiki whose names clash or whose frontmatter can't be read."""


class Wiki:
    """Queries over ``files`` (rel_path, source).

    Every branch of a plan parses only the facets it reads; what needs paths
    alone does not parse at all.  ``persist`` parses all facets once and keeps
    them between actions, which pays off when more than one query is run.
    ``store`` names facets to parse once into a table in the shared folder;
    branches then read only the columns they need, and no lost executor costs
    a second parse.  ``parsed``: a store that lasts; what it holds is not parsed
    again.  ``root``: the folder the files are from, if any.
    """

    def __init__(self, files: DataFrame, config: WikiConfig, persist: bool = False, store: tuple[str, ...] = (), parsed: ParseStore | None = None, root: str | None = None):
        self.files, self.config, self._persist, self._store = files, config, persist, store
        self._parsed, self._root = parsed, root
        if parsed:
            self._store = parsed.facets
        self._by_facets: dict[tuple[str, ...], DataFrame] = {}
        self._files: dict[str, DataFrame] = {}

    @classmethod
    def open(cls, spark: SparkSession, root: str | Path | None = None, **more) -> Wiki:
        """A wiki in a folder, with the settings found there.

        The executors list and read it, so a plain path must be one that they
        can open; settings of a URI are read through Spark's file systems.
        """
        if root is not None and "://" in str(root):
            shared = corpus.SharedFolder(spark, str(root))
            config = shared.config()
            return cls(corpus.read_corpus(spark, shared.uri, config.ignore), config, root=shared.uri, **more)
        folder = corpus.resolve_root(root)
        config = settings.load_or_detect(folder)
        return cls(corpus.read_corpus(spark, folder, config.ignore), config, root=str(folder), **more)

    def pages(self, *facets: str) -> DataFrame:
        """Every file with its name, its category and the wanted facets."""
        wanted = tuple(parse.FACETS) if self._persist else self._store if set(facets) <= set(self._store) else facets
        if wanted not in self._by_facets:
            if wanted and wanted == self._store:
                parsed = self._from_store() if self._parsed else stored(parse.parse_documents(self.files, wanted), "pages")
            else:
                parsed = parse.parse_documents(self.files, wanted) if wanted else self.files
            out = resolve.categorised(parsed, self.config)
            self._by_facets[wanted] = out.persist() if self._persist else out
        return self._by_facets[wanted]

    def _from_store(self) -> DataFrame:
        self._parsed.update(self.files)
        return self._parsed.parsed(self.files)

    def page(self, rel_path: str, *facets: str) -> DataFrame:
        """One file, whether a page or not, once read; nothing else is read from a folder, or parsed."""
        if rel_path not in self._files:
            own = corpus.read_file(self.files.sparkSession, self._root, rel_path) if self._root else None
            self._files[rel_path] = own if own is not None else self.files.where(F.col("rel_path") == rel_path)
        own = self._files[rel_path]
        return resolve.categorised(parse.parse_documents(own, facets) if facets else own, self.config)

    @cached_property
    def names(self) -> DataFrame:
        return resolve.names(self.pages("frontmatter"))

    @cached_property
    def links(self) -> DataFrame:
        return parse.links(self.pages("links"))

    @cached_property
    def resolved(self) -> DataFrame:
        return resolve.resolved(self.links, self.names, self.pages(), even=self._persist or "links" in self._store)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.edges(self.resolved)

    @cached_property
    def broken(self) -> DataFrame:
        return resolve.broken(self.resolved, self.pages("headings", "block_ids"))

    def check(self) -> Wiki:
        """Raise WikiError if names clash or a named page has bad frontmatter."""
        bad = self.pages("frontmatter").where("(is_managed OR is_index) AND fm_error IS NOT NULL").select("rel_path", "fm_error").first()
        if bad:
            raise WikiError(f"{bad.rel_path}: {bad.fm_error}")
        clash = resolve.name_conflicts(self.pages("frontmatter")).orderBy("name").first()
        if clash:
            raise WikiError(f"{clash.kind}: {clash['name']} is claimed by {', '.join(clash.paths)}")
        return self

    # Links and graph

    def mentions(self) -> DataFrame:
        shown = self.names.where("name = page_id").select(F.col("name").alias("concept"), F.col("stem").alias("display"))
        return self._mentions().join(shown, "concept", "left").select("rel_path", "concept", F.coalesce("display", "concept").alias("display"), "start", "end", "line", "col").orderBy(F.split("rel_path", "/"), "start")

    def _mentions(self) -> DataFrame:
        return mentions.mentions(self.pages("ranges"), mentions.autolink_pages(self.pages("frontmatter"), self.config))

    def broken_links(self) -> DataFrame:
        cols = ["rel_path", "line", "col", "markup", "reason_kind", "reason_value"]
        return self.broken.orderBy(F.split("rel_path", "/"), "pos").select(*cols)  # folder by folder

    def orphans(self) -> DataFrame:
        return graph.orphans(self.pages(), self.edges)

    def totals(self) -> DataFrame:
        """n_mentions, n_edits, n_broken, n_orphans in one row."""
        found = self._mentions()
        edits = formatting.fix_edits(self.pages("definitions"), self.resolved, found, self.config.linking)
        counted = {"n_mentions": found, "n_edits": edits, "n_broken": self.broken, "n_orphans": self.orphans()}
        rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("what")) for name, df in counted.items()])
        return rows.agg(*[F.count_if(F.col("what") == name).alias(name) for name in counted])

    def refs_to(self, name: str) -> DataFrame:
        return graph.refs_to(self.edges, self.names, name)

    def refs_from(self, name: str) -> DataFrame:
        return graph.refs_from(self.edges, self.names, name)

    def refs_graph(self) -> DataFrame:
        return graph.refs_graph(self.edges)

    def lint(self, severity: str = "all") -> DataFrame:
        return lint.lint(self.pages, self.resolved, self.broken, self.edges, self.config, severity)

    # Inventory

    def scan(self) -> dict[str, DataFrame]:
        return {
            "directories": inventory.directories(self.pages()).orderBy("dir"),
            "fields": inventory.frontmatter_fields(self.pages("frontmatter")),
            "headings": inventory.top_headings(self.pages("headings")),
            "mirrors": inventory.mirror_candidates(self.pages()),
            "index": inventory.index_refs(self.pages("links")),
        }

    # Rewrites: (moves, edits)

    def _plan(self, edits: DataFrame) -> DataFrame:
        """Found once: they are checked, then shown or applied."""
        return E.checked(stored(edits, "edits"), self.files)

    def fix(self) -> DataFrame:
        return self._plan(formatting.fix_edits(self.pages("definitions"), self.resolved, self._mentions(), self.config.linking))

    def format(self) -> DataFrame:
        return self._plan(formatting.format_edits(self.pages("definitions", "uses"), self.pages("headings", "block_ids"), self.resolved, self.config.linking))

    def skipped(self) -> DataFrame:
        return formatting.skipped(self.resolved, formatting.convertible(self.resolved, self.pages("headings", "block_ids"), self.config.linking))

    def rename(self, old: str, new: str) -> tuple[DataFrame, DataFrame]:
        moves, edits = rewrite.rename(self.pages("destinations"), self.resolved, self.names, self.config, old, new, self.files)
        return moves, self._plan(edits)

    def move(self, name: str, folder: str) -> tuple[DataFrame, DataFrame]:
        moves, edits = rewrite.move(self.pages("destinations"), self.names, name, folder, self.files)
        return moves, self._plan(edits)

    def rename_section(self, old: str, new: str, dirs: list[str] | None = None) -> DataFrame:
        return self._plan(rewrite.rename_section(self.pages("headings", "links", "destinations"), old, new, dirs))

    def set_frontmatter(self, rel_path: str, field: str, value: str) -> DataFrame:
        own = self.files.where(F.col("rel_path") == rel_path)
        if own.first() is None:
            raise rewrite.RewriteError(f"no such file: {rel_path}")
        return rewrite.set_frontmatter(own, field, value)

    def rewritten(self, edits: DataFrame) -> DataFrame:
        return E.apply_edits(self.files, edits)

    def hunks(self, edits: DataFrame) -> DataFrame:
        return E.hunks(self.files, edits)

    def register(self, prefix: str = "wiki_") -> None:
        """Make the fact tables known to SQL as temporary views."""
        tables = {"pages": self.pages("frontmatter"), "links": self.resolved, "edges": self.edges, "broken": self.broken, "headings": parse.headings(self.pages("headings"))}
        for name, df in tables.items():
            df.createOrReplaceTempView(prefix + name)
