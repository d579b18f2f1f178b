"""Named queries over a wiki derived from relational tables, each with SQL that
computes the same answer from the tables themselves, never from Markdown."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import edits as E
from ..operators import format as formatting
from ..operators import graph, inventory, lint, mentions, parse, resolve, rewrite
from ..sources import above, config, corpus, ignore, roots, settings, sinks, tree
from ..sources.shared import shared_folder, stored
from ..sources.store import ParseStore
from . import setup
from .wiki import Wiki

CONFIG = """
index = "index.md"
[[directories]]
path = "wiki/regions"
[[directories]]
path = "wiki/nations"
[[directories]]
path = "wiki/suppliers"
autolink = false
[[directories]]
path = "wiki/customers"
autolink = false
[linking]
link_style = "markdown"
reference_style_threshold = 2
[[rules]]
check = "required-sections"
dirs = ["wiki/nations"]
sections = ["harvest plan"]
[[rules]]
check = "required-frontmatter"
dirs = ["wiki/customers", "wiki/regions"]
fields = ["type", "owner"]
[[rules]]
check = "required-frontmatter"
when = "type == supplier"
fields = ["nation", "owner"]
[[rules]]
check = "mirror-parity"
left = "wiki/nations"
right = "raw/nations"
[[rules]]
check = "citation-pattern"
name = "cited-nation"
dirs = ["wiki/customers"]
pattern = "(?P<id>nation_[0-9]+x?|NATION_[0-9]+x?)"
match_in = "wiki/nations"
match_mode = "filename"
[[rules]]
check = "citation-pattern"
name = "raw-nation"
dirs = ["wiki/suppliers"]
pattern = "nation: (?P<id>N[0-9]+)"
match_in = "raw/nations"
severity = "error"
"""

#: The pages, as SQL that Spark and other engines read alike: (path, text, table).
PAGES = {
    "regions": ("'wiki/regions/' || r_name || '.md'", "'---\\ntype: region\\n---\\n# ' || r_name || '\\n\\n## Notes\\n'", "region"),
    "raw_regions": ("'raw/regions/' || r_name || '.md'", "'Raw notes\\n'", "region"),
    "nations": (
        "'wiki/nations/' || n_name || '.md'",
        "'---\\ntype: nation\\naliases: [N' || n_nationkey || ']\\n---\\n# ' || n_name || '\\n\\nSee [[' || r_name || ']] and [next](NATION_' || ((n_nationkey + 1) % 25) || '.md#harvest-plan).\\n'"
        " || CASE WHEN n_nationkey % 3 = 0 THEN '\\n## Harvest Plan\\n\\nSurvey ^estimate\\n' ELSE '' END",
        "nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "raw_nations": ("'raw/nations/' || n_name || '.md'", "'Ref N' || n_nationkey || ';\\n'", "nation WHERE n_nationkey % 4 <> 0"),
    "suppliers": (
        "'wiki/suppliers/' || replace(s_name, '#', '-') || '.md'",
        "'---\\ntype: supplier\\nnation: N' || s_nationkey || '\\n---\\n# ' || replace(s_name, '#', '-') || '\\n\\n## Nation ' || s_nationkey || '\\n\\nBased in [[N' || s_nationkey || ']].'"
        " || CASE WHEN s_suppkey % 7 = 0 THEN ' See [[Missing ' || s_suppkey || ']].' ELSE '' END"
        " || CASE WHEN s_suppkey % 5 = 1 THEN ' Cites [[NATION_' || s_nationkey || '#^estimate]].' ELSE '' END || '\\n'",
        "supplier",
    ),
    "customers": (
        "'wiki/customers/' || replace(c_name, '#', '-') || '.md'",
        "'# ' || replace(c_name, '#', '-') || '\\n\\nIn [[N' || c_nationkey || '|home]].\\n\\nShips to NATION_' || c_nationkey || ', not NATION_' || c_nationkey || 'x.\\n\\n## ' || c_mktsegment || '\\n'",
        "customer",
    ),
    "notes": ("'notes/' || doc_id || '.md'", "coalesce(text, '')", "documents"),
}
TABLES = ("region", "nation", "supplier", "customer", "documents", "part", "orders")


def corpus_from_tables(spark: SparkSession, sf_dir: str, parts: tuple[str, ...] = tuple(PAGES)) -> DataFrame:
    """A corpus (rel_path, source) built from the tables in ``sf_dir``."""
    out = None
    for name in parts:
        path, text, table = (PAGES | MORE)[name]
        for t in TABLES:
            if t in table.split():
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"corpus_{t}")
        source = " ".join(f"corpus_{w}" if w in TABLES else w for w in table.split())
        rows = spark.sql(f"SELECT {path} AS rel_path, {text} AS source FROM {source}")
        out = rows if out is None else out.unionByName(rows)
    if "nations" not in parts:
        return _spread(out)
    for t in ("region", "nation"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"corpus_{t}")
    index = spark.sql(
        "SELECT 'index.md' AS rel_path, '# Index\\n\\n' || listagg('- [[' || name || ']]\\n') WITHIN GROUP (ORDER BY name) AS source"
        " FROM (SELECT r_name AS name FROM corpus_region UNION ALL SELECT n_name FROM corpus_nation WHERE n_nationkey % 5 <> 0)"
    )
    return _spread(out.unionByName(index))


def _spread(files: DataFrame) -> DataFrame:
    """A corpus from fewer files than there are cores is dealt out before it is parsed."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if len(files.inputFiles()) < cores else files


#: Pages that link by reference, with labels that are told apart only after escapes and case.
REFERENCES = {
    "references": (
        "'wiki/nations/' || n_name || '.md'",
        "'# ' || n_name || '\\n\\nGo [on][The ' || chr(92) || ']  Next] now.\\n\\n[the ' || chr(92) || '] next]:\\n  NATION_' || ((n_nationkey + 1) % 25) || '.md\\n'",
        "nation",
    )
}
#: Pages that cite brands, and the pages of some of them.
BRANDS = {
    "parts": ("'wiki/parts/' || p_partkey || '.md'", "'Uses **' || replace(p_brand, '#', '-') || '** (see ' || (1990 + p_size) || ').\\n'", "part"),
    "brands": ("DISTINCT 'wiki/brands/' || replace(p_brand, '#', '-') || '.md'", "'# Brand\\n'", "part WHERE p_brand LIKE '%2'"),
}
#: Orders that name a customer's page and an account, and the ledger of most accounts.
ORDERS = {
    "orders": (
        "'orders/' || o_orderkey || '.md'",
        "'# Order ' || o_orderkey || '\\n\\nFor Customer-' || lpad(o_custkey, 9, '0') || ', not Customer-' || lpad(o_custkey, 9, '0') || 'x;\\naccount C' || o_custkey || '.\\n'",
        "orders",
    ),
    "ledger": ("'ledger/' || c_custkey || '.md'", "'Account C' || c_custkey || ' is open.\\n'", "customer WHERE c_custkey % 3 <> 0"),
}
#: What a scan meets beside pages: tool folders, other extensions, bare extensions.
STRAYS = {
    "tools": ("'.codex/' || n_name || '.md'", "'x'", "nation"),
    "upper": ("'wiki/nations/' || n_name || '.MD'", "'x'", "nation"),
    "bare": ("'wiki/' || n_name || '/.md'", "'x'", "nation"),
    "drafts": ("'wiki/drafts_' || n_regionkey || '/' || n_name || '.md'", "'x'", "nation"),
}
MORE = REFERENCES | BRANDS | ORDERS | STRAYS

GRAPH = ("regions", "raw_regions", "nations", "raw_nations", "suppliers", "customers")


def _wiki(spark: SparkSession, sf_dir: str, parts: tuple[str, ...] = GRAPH, **more) -> Wiki:
    return Wiki(corpus_from_tables(spark, sf_dir, parts), config.parse(CONFIG), **more)


def _rule(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    wiki = _wiki(spark, sf_dir)
    return lint.rule_findings(wiki.pages, wiki.config.rules[k])


# Inventory


def scan_directories(spark, d):
    return inventory.directories(corpus_from_tables(spark, d))


def scan_frontmatter_fields(spark, d):
    return inventory.frontmatter_fields(_wiki(spark, d).pages("frontmatter"))


def scan_headings_topk(spark, d):
    return inventory.top_headings(_wiki(spark, d).pages("headings"))


def mirror_candidates(spark, d):
    return inventory.mirror_candidates(corpus_from_tables(spark, d, GRAPH))


def index_refs(spark, d):
    return inventory.index_refs(_wiki(spark, d, ("regions", "nations")).pages("links"))


def scan_files(spark, d):
    """The Markdown files that ignore rules leave."""
    files = corpus_from_tables(spark, d, (*PAGES, *STRAYS))
    rules = config.Ignore(patterns=("raw/", "/notes/*[05].md", "drafts_[!12]", "Customer-*1.md"))
    return corpus.without_ignored(corpus.markdown_files(files), rules).select("rel_path")


def scan_nested_rules(spark, d):
    """One folder per customer, every other one with an ignore file; ``ledgers`` holds rules for all of them."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.expr("'ledgers/c' || o_custkey || '/' || o_orderkey || '.md'").alias("rel_path"), F.lit("").alias("source"))
    customers = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 2 = 0")
    own = customers.select(F.expr("'ledgers/c' || c_custkey || '/.gitignore'").alias("rel_path"), F.expr("'*' || (c_custkey % 10) || '.md\n!*5' || (c_custkey % 10) || '.md\n'").alias("source"))
    shared = spark.read.parquet(f"{d}/region.parquet").limit(1).select(F.lit("ledgers/.gitignore").alias("rel_path"), F.lit("c*9/\n*3.md\n").alias("source"))
    every = orders.unionByName(own).unionByName(shared)
    rules = stored(ignore.rule_rows(own.unionByName(shared)), "rules")
    return corpus.without_ignored(corpus.markdown_files(every), config.Ignore(), rules).select("rel_path")


def _tree(spark, d, parts) -> str:
    """The pages of some tables as files in the shared folder; its URI."""
    root = f"{shared_folder(spark)}/wiki-{uuid.uuid4().hex}"
    tree.write(root, corpus_from_tables(spark, d, parts))
    return root


def scan_tree(spark, d):
    """Pages written as files and scanned again: ignored ones are neither listed nor read."""
    root = _tree(spark, d, ("regions", "nations", "suppliers", "tools", "upper", "drafts"))
    tree.write(root, spark.createDataFrame([("wiki/suppliers/.gitignore", "*[05].md\n!*10.md\n")], corpus.SCHEMA))
    rules = config.Ignore(patterns=("drafts_[!12]",))
    return tree.read(spark, root, rules).select("rel_path", F.length("source").alias("n_chars"))


def tree_rename(spark, d):
    """A page renamed in a tree of files: moved with its mirror, all links rewritten by the executors, read back."""
    root = _tree(spark, d, GRAPH)
    files = stored(tree.read(spark, root, config.Ignore()), "files")  # the tree is walked once
    w = Wiki(files, config.parse(CONFIG), store=("frontmatter", "links", "destinations"))
    moves, edits = w.rename("NATION_3", "Nation Three")
    sinks.apply(root, moves, w.rewritten(edits))
    return tree.read(spark, root, config.Ignore())


def page_categories(spark, d):
    pages = resolve.categorised(corpus_from_tables(spark, d), config.parse(CONFIG))
    return pages.groupBy(resolve.category(config.parse(CONFIG)).alias("category"), F.coalesce("folder", F.lit("-")).alias("folder")).agg(F.count("*").alias("n"))


def name_conflicts(spark, d):
    """With suppliers named like their nation's alias, names clash."""
    own = corpus_from_tables(spark, d, ("regions", "nations"))
    extra = own.where("rel_path LIKE 'wiki/nations/%'").select(F.regexp_replace("rel_path", "^wiki/nations/NATION_([0-9]*[05])[.]md$", "wiki/suppliers/N$1.md").alias("rel_path"), F.lit("# Clash\n").alias("source")).where("rel_path LIKE 'wiki/suppliers/%'")
    pages = Wiki(own.unionByName(extra), config.parse(CONFIG)).pages("frontmatter")
    return resolve.name_conflicts(pages).select("name", "kind", F.array_join("paths", ",").alias("paths"))


# Links and graph


def links_all(spark, d):
    w = _wiki(spark, d)
    return w.links.select("rel_path", "pos", "style", "target", "frag_kind", "frag", "display", "line", "col")


def refs_graph(spark, d):
    return _wiki(spark, d).refs_graph()


def refs_to(spark, d):
    return _wiki(spark, d).refs_to("n3")


def refs_from(spark, d):
    return _wiki(spark, d).refs_from("Supplier-000000001")


def inbound_counts(spark, d):
    return graph.inbound(_wiki(spark, d).edges)


def _broken(spark, d, kind):
    w = _wiki(spark, d)
    return w.broken.where(F.col("reason_kind") == kind).select("rel_path", "line", "col", "markup", F.coalesce("reason_value", F.lit("-")).alias("reason_value"))


def links_broken_page(spark, d):
    return _broken(spark, d, "page")


def links_broken_heading(spark, d):
    return _broken(spark, d, "heading")


def links_broken_block(spark, d):
    return _broken(spark, d, "block")


def links_orphans(spark, d):
    return _wiki(spark, d).orphans()


def links_check_mentions(spark, d):
    w = _wiki(spark, d)
    return mentions.mentions(w.pages("ranges"), mentions.autolink_pages(w.pages("frontmatter"), w.config)).select("rel_path", "concept", "line", "col")


def mentions_in_notes(spark, d):
    """Four common words as page names, looked for in all documents."""
    notes = corpus_from_tables(spark, d, ("notes",))
    names = spark.createDataFrame([("the",), ("that",), ("and",), ("with",)], "page_id string")
    return mentions.counts(notes, names, config.parse(CONFIG))


def mentions_of_customers(spark, d):
    """Every customer's page name, looked for in all orders."""
    pages = parse.parse_documents(corpus_from_tables(spark, d, ("orders",)), ("ranges",)).withColumn("page_id", S.page_id("rel_path"))
    names = corpus_from_tables(spark, d, ("customers",)).select(S.page_id("rel_path").alias("page_id"))
    return mentions.mentions(pages, names)


def mentions_of_terms(spark, d):
    """The words of all benchmark items as page names, looked for in all documents."""
    notes = corpus_from_tables(spark, d, ("notes",))
    words = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("word"))
    names = words.select(S.ascii_lower("word").alias("page_id")).distinct()
    return mentions.counts(notes, names, config.parse(CONFIG))


def wiki_totals(spark, d):
    """How much there is to mend: mentions, the edits that link them, broken links and orphans."""
    w = _wiki(spark, d, store=("frontmatter", "headings", "links", "block_ids", "definitions", "ranges"))
    return w.totals()


def page_headings(spark, d):
    """One page, parsed alone."""
    return parse.headings(_wiki(spark, d).page("wiki/nations/NATION_3.md", "headings")).select("pos", "level", "text")


def parse_store(spark, d):
    """A wiki parsed into a store, then again after some customers' pages changed: only those are parsed.

    The headings of the second state, and how many pages each state had to parse.
    """
    files = corpus_from_tables(spark, d, GRAPH)
    later = files.select("rel_path", F.when(F.col("rel_path").rlike("^wiki/customers/.*7[.]md$"), F.concat("source", F.lit("\n### Added\n"))).otherwise(F.col("source")).alias("source"))
    kept = ParseStore(spark, f"{shared_folder(spark)}/parsed-{uuid.uuid4().hex}", ("headings", "links"))
    first, second, third = kept.update(files), kept.update(later), kept.update(later)
    found = parse.headings(kept.parsed(later))
    return found.select("rel_path", "pos", "level", "text", F.lit(first).alias("n_first"), F.lit(second).alias("n_second"), F.lit(third).alias("n_third"))


# Checks


def lint_reasons(spark, d):
    w = _wiki(spark, d)
    return lint.broken_links(w.broken, w.pages(), w.config).select("severity", "rel_path", "message", "detail")


def lint_citation_preset(spark, d):
    files = corpus_from_tables(spark, d, ("parts", "brands"))
    text = 'directories = [{path = "wiki/parts"}]\n[[rules]]\ncheck = "citation-pattern"\nname = "brand"\npreset = "bold-method-year"\nmatch_in = "wiki/brands"\n'
    w = Wiki(files, config.parse(text))
    return lint.rule_findings(w.pages, w.config.rules[0]).select("severity", "code", "rel_path", "detail")


def lint_citation_accounts(spark, d):
    """Every order cites an account; accounts are looked for in the contents of the ledger."""
    text = 'directories = [{path = "orders"}]\n[[rules]]\ncheck = "citation-pattern"\nname = "account"\npattern = "account (?P<id>C[0-9]+)"\nmatch_in = "ledger"\n'
    w = Wiki(corpus_from_tables(spark, d, ("orders", "ledger")), config.parse(text))
    return lint.rule_findings(w.pages, w.config.rules[0]).select("severity", "code", "rel_path", "detail")


#: Settings files of as many wikis as there are suppliers: defaults, folders, rules, errors, and none at all.
SETTINGS = """
  CASE s_suppkey % 6
    WHEN 0 THEN 'verbatim = ["drafts' || s_suppkey || '/"]\\n[checks]\\norphan_pages = "off"\\n'
    WHEN 1 THEN 'index = ""\\n[[directories]]\\npath = "topics/"\\n[[directories]]\\npath = "topics/deep' || s_suppkey || '"\\nautolink = false\\n[[rules]]\\ncheck = "required-sections"\\nsections = ["S' || s_suppkey || '"]\\ndirs = ["topics/", "b"]\\n'
    WHEN 2 THEN '[[rules]]\\ncheck = "citation-pattern"\\nname = "c' || s_suppkey || '"\\npreset = "bold-method-year"\\nmatch_in = "papers/"\\n[[rules]]\\ncheck = "citation-pattern"\\nname = "own"\\npattern = "x"\\nmatch_in = "p"\\nseverity = "off"\\n'
    WHEN 3 THEN '[linking]\\nlink_style = "markdown"\\nreference_style_threshold = ' || (s_suppkey % 4) || '\\n'
    WHEN 4 THEN '[checks]\\nbroken_links = "loud' || s_suppkey || '"\\n'
  END"""


def _settings(spark, d):
    spark.read.parquet(f"{d}/supplier.parquet").createOrReplaceTempView("corpus_supplier")
    return settings.settings(spark.sql(f"SELECT s_suppkey AS fixture, s_suppkey % 4 = 1 AS has_wiki, {SETTINGS} AS source FROM corpus_supplier"))


def settings_rules(spark, d):
    """The rules of many configurations, with what they leave out filled in."""
    rules = _settings(spark, d).select("fixture", F.posexplode("rules").alias("pos", "r"))
    return rules.select("fixture", "pos", "r.check", "r.severity", "r.name", F.array_join("r.dirs", ",").alias("dirs"), "r.match_in", "r.match_mode")


def settings_table(spark, d):
    """Many configurations at once: defaults, layouts without a file, and what is wrong with the bad ones."""
    return _settings(spark, d).select(
        "fixture",
        "error",
        "index",
        F.array_join(F.transform("directories", lambda x: F.concat_ws(":", x["path"], x["autolink"])), ",").alias("directories"),
        F.element_at("ignore", -1).alias("last_ignored"),
        F.size("ignore").alias("n_ignored"),
        "linking.link_style",
        "linking.reference_style_threshold",
        F.concat_ws(",", "checks.broken_links", "checks.unmanaged_broken_links", "checks.orphan_pages", "checks.index_coverage").alias("checks"),
    )


def _sites(spark, d):
    """Paths of a site per supplier, some with settings, some with an index, some with neither, below regions of which two have an index."""
    for t in ("region", "nation", "supplier"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(f"corpus_{t}")
    site = "'sites/' || n_regionkey || '/' || s_suppkey"
    return spark.sql(
        f"""WITH s AS (SELECT {site} AS site, s_suppkey AS k FROM corpus_supplier JOIN corpus_nation ON s_nationkey = n_nationkey)
        SELECT site || '/wiki.toml' AS path FROM s WHERE k % 4 = 0
        UNION ALL SELECT site || '/index.md' FROM s WHERE k % 4 IN (0, 1, 2)
        UNION ALL SELECT site || '/wiki/deep/wiki/page.md' FROM s WHERE k % 4 IN (1, 3)
        UNION ALL SELECT site || '/notes/xwiki/a.md' FROM s
        UNION ALL SELECT 'sites/' || r_regionkey || '/index.md' FROM corpus_region WHERE r_regionkey < 2"""
    )


def roots_discovered(spark, d):
    """The root of every site's notes and pages, from the nearest folder with settings or an index."""
    paths = _sites(spark, d)
    starts = paths.where("path LIKE '%/a.md' OR path LIKE '%page.md'").select(F.col("path").alias("start"))
    return roots.discovered(starts, paths)


def roots_explicit(spark, d):
    """Which folders of the sites would do as roots if they were named."""
    paths = _sites(spark, d)
    folders = paths.select(F.explode(above.folders_above("path")).alias("folder")).distinct()
    return roots.explicit(folders, paths)


def setup_text(spark, d):
    """The whole settings file proposed for the wiki."""
    return setup.proposal_text(_wiki(spark, d).pages("frontmatter", "headings", "links"), True)


def setup_required(spark, d):
    """What a generated configuration would ask of each content folder."""
    dirs = setup.content_dirs(setup.required_everywhere(_wiki(spark, d).pages("frontmatter", "headings")), True)
    listed = [F.coalesce(F.nullif(S.quoted_list(F.coalesce(c, F.array())), F.lit("")), F.lit("-")).alias(c) for c in ("fields", "sections")]
    return dirs.select("dir", "n_files", *listed)


def lint_broken_links(spark, d):
    w = _wiki(spark, d)
    return lint.broken_links(w.broken, w.pages(), w.config).groupBy("severity", "code").agg(F.count("*").alias("n"))


def lint_orphans(spark, d):
    return lint.orphan_pages(_wiki(spark, d).orphans(), "warn").drop("detail")


def lint_index_coverage(spark, d):
    w = _wiki(spark, d)
    return lint.index_coverage(graph.not_in_index(w.pages(), w.resolved), "error").drop("detail")


def lint_required_sections(spark, d):
    return _rule(spark, d, 0)


def lint_required_frontmatter(spark, d):
    return _rule(spark, d, 1).select("severity", "code", "rel_path", F.coalesce("detail", F.lit("-")).alias("detail"))


def lint_when_predicate(spark, d):
    return _rule(spark, d, 2).select("code", "rel_path", "detail")


def lint_mirror_parity(spark, d):
    return _rule(spark, d, 3).select("severity", "rel_path", "message")


def lint_citation_filename(spark, d):
    return _rule(spark, d, 4).select("severity", "rel_path", "detail")


def lint_citation_content(spark, d):
    return _rule(spark, d, 5).select("severity", "rel_path", "detail")


def lint_summary(spark, d):
    return lint.summary(_wiki(spark, d, store=lint.FACETS).lint())


# Rewrites


def links_format_edits(spark, d):
    w = _wiki(spark, d)
    return formatting.format_edits(w.pages("definitions", "uses"), w.pages("headings", "block_ids"), w.resolved, w.config.linking)


def links_format_wikilinks(spark, d):
    """Reference links as wikilinks; definitions that nothing uses any more go."""
    w = Wiki(corpus_from_tables(spark, d, ("references",)), config.parse(""))
    return formatting.format_edits(w.pages("definitions", "uses"), w.pages("headings", "block_ids"), w.resolved, w.config.linking)


def links_fix_edits(spark, d):
    w = _wiki(spark, d)
    hits = mentions.mentions(w.pages("ranges"), mentions.autolink_pages(w.pages("frontmatter"), w.config))
    return formatting.fix_edits(w.pages("definitions"), w.resolved, hits, w.config.linking)


def rename_edits(spark, d):
    w = _wiki(spark, d)
    return rewrite.rename(w.pages("destinations"), w.resolved, w.names, w.config, "NATION_3", "Nation Three", w.files)[1]


def rename_moves(spark, d):
    w = _wiki(spark, d)
    return rewrite.rename(w.pages("destinations"), w.resolved, w.names, w.config, "N3", "Nation Three", w.files)[0]


def move_edits(spark, d):
    w = _wiki(spark, d)
    return rewrite.move(w.pages("destinations"), w.names, "NATION_3", "archive", w.files)[1]


def move_definition_edits(spark, d):
    """Destinations that stand on the line after their label."""
    w = Wiki(corpus_from_tables(spark, d, ("references",)), config.parse(""))
    return rewrite.move(w.pages("destinations"), w.names, "NATION_3", "archive", w.files)[1]


def sections_rename_edits(spark, d):
    w = _wiki(spark, d)
    return rewrite.rename_section(w.pages("headings", "links", "destinations"), "Harvest Plan", "Market Notes")


def frontmatter_get(spark, d):
    return rewrite.frontmatter_values(_wiki(spark, d).pages("frontmatter"), "nation")


def frontmatter_json(spark, d):
    return parse.frontmatter(_wiki(spark, d).pages("frontmatter")).where("fm IS NOT NULL").select("rel_path", F.to_json("fm").alias("json"))


def frontmatter_set_edits(spark, d):
    files = corpus_from_tables(spark, d, ("suppliers",))
    return E.apply_edits(files, rewrite.set_frontmatter(files, "owner", "alice")).select("rel_path", F.substring_index("source", "\n# ", 1).alias("head"))


def diff_hunks(spark, d):
    w = _wiki(spark, d)
    return w.hunks(rewrite.rename_section(w.pages("headings", "links", "destinations"), "Harvest Plan", "Market Notes"))


def edit_validation(spark, d):
    files = corpus_from_tables(spark, d, ("nations", "suppliers", "customers")).where("rel_path LIKE 'wiki/%'")
    rows = (("a", 1, 4), ("b", 3, 5), ("c", 7, 7), ("d", 100000, 100001))
    edits = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("replacement", "start", "end"), r, strict=True)]) for r in rows]))
    return E.invalid(files.select("rel_path", edits.alias("e")).select("rel_path", "e.*"), files).select("rel_path", "start", "reason")


def edits_effective(spark, d):
    """Edits that would put what is there already are left out."""
    files = corpus_from_tables(spark, d, ("regions", "nations", "suppliers")).where("rel_path LIKE 'wiki/%'")
    new = F.when(F.col("rel_path").rlike("[02468][.]md$"), "+++").otherwise("---")
    return E.effective(files.select("rel_path", F.lit(0).alias("start"), F.lit(3).alias("end"), new.alias("replacement")), files)


# Scalars


def heading_anchors(spark, d):
    return parse.headings(_wiki(spark, d).pages("headings")).select("rel_path", "pos", "level", "text", "anchor")


def block_ids(spark, d):
    return parse.block_ids_of(corpus_from_tables(spark, d, GRAPH)).select("rel_path", "block_id")


def markdown_block_ids(spark, d):
    """Block ids as the Markdown reader finds them."""
    return parse.block_ids(_wiki(spark, d).pages("block_ids")).select("rel_path", "pos", "block_id")


def name_rules(spark, d):
    """Slashes at the end, labels with brackets, quoted lists, which paths name Markdown files."""
    part = spark.read.parquet(f"{d}/part.parquet")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("", "/", "x:", "%zz", "../"))), F.pmod("p_partkey", F.lit(5)).cast("int") + 1), "p_type", F.lit("%20.md"))
    return part.select(
        "p_partkey",
        S.strip_slash(F.concat("p_type", F.lit("/x//"))).alias("folder"),
        S.escape_label(F.concat(F.lit("["), "p_brand", F.lit("]\\"))).alias("label"),
        S.quoted_list(F.array("p_brand", "p_type")).alias("listed"),
        S.is_relative_md(path).alias("is_md"),
    )


def path_normalize(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    path = F.concat(F.lit("a/./b/../"), F.col("p_brand"), F.lit("/../../../x/"), F.col("p_partkey"), F.lit(".md"))
    return part.select("p_partkey", S.normalize_path(path).alias("path"), S.relative_path(F.concat(F.lit("x/"), F.col("p_brand")), S.normalize_path(path)).alias("relative"))


def url_decode(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    path = F.concat("p_name", F.lit(" +%20%C3%A9#"), "p_size")
    return part.select("p_partkey", S.url_decode(path).alias("decoded"), S.url_encode(path).alias("encoded"))


def href_graph(spark, d):
    """Site links of web pages, counted by target."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    hrefs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("href"))
    target = S.ascii_lower(S.normalize_path(F.coalesce(S.url_decode("href"), "href")))
    return hrefs.select("page_id", target.alias("target")).groupBy("target").agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


NAMES = (
    scan_files, scan_nested_rules, scan_tree, tree_rename, scan_directories, scan_frontmatter_fields, scan_headings_topk, mirror_candidates, index_refs, page_categories, name_conflicts,
    links_all, refs_graph, refs_to, refs_from, inbound_counts, links_broken_page, links_broken_heading, links_broken_block, links_orphans,
    links_check_mentions, mentions_in_notes, mentions_of_customers, mentions_of_terms, lint_broken_links, lint_index_coverage, lint_required_sections, lint_required_frontmatter,
    lint_when_predicate, lint_mirror_parity, lint_citation_filename, lint_citation_content, lint_citation_accounts, lint_orphans, lint_summary, links_format_edits, links_fix_edits,
    rename_edits, rename_moves, move_edits, sections_rename_edits, frontmatter_get, frontmatter_set_edits, diff_hunks, edit_validation,
    heading_anchors, block_ids, path_normalize, url_decode, href_graph, wiki_totals, page_headings, parse_store, lint_reasons, lint_citation_preset,
    settings_rules, settings_table, roots_discovered, roots_explicit, setup_required, setup_text, links_format_wikilinks, move_definition_edits, frontmatter_json, edits_effective, markdown_block_ids, name_rules,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in NAMES}
