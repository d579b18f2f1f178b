"""SQL twins of ``queries``: answers computed from the tables."""

from __future__ import annotations

from .queries import MORE, PAGES

_Q = {k: path for k, (path, _, _) in PAGES.items()}
_T = {k: text.replace("\\n", "' || chr(10) || '") for k, (_, text, _) in PAGES.items()}

# Every page of the derived wiki with what it says, relationally.
_PAGES = f"""
p AS (
  SELECT {_Q['regions']} AS rel_path, 'regions' AS kind, r_name AS stem, r_regionkey AS k FROM region
  UNION ALL SELECT {_Q['raw_regions']}, 'raw_regions', r_name, r_regionkey FROM region
  UNION ALL SELECT {_Q['nations']}, 'nations', n_name, n_nationkey FROM nation
  UNION ALL SELECT {_Q['raw_nations']}, 'raw_nations', n_name, n_nationkey FROM nation WHERE n_nationkey % 4 <> 0
  UNION ALL SELECT {_Q['suppliers']}, 'suppliers', replace(s_name, '#', '-'), s_suppkey FROM supplier
  UNION ALL SELECT {_Q['customers']}, 'customers', replace(c_name, '#', '-'), c_custkey FROM customer
  UNION ALL SELECT 'index.md', 'index', 'index', 0),
idx AS (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 5 <> 0)"""

# Links: page, place in it, and what they point at.
_LINKS = f"""
l AS (
  SELECT {_Q['nations']} AS rel_path, n_name AS stem, 0 AS pos, 'obsidian' AS style, lower(r_name) AS target, NULL AS frag_kind, NULL AS frag, r_name AS display,
         7 AS line, 5 AS col, '[[' || r_name || ']]' AS markup, lower(r_name) AS page, {_Q['regions']} AS page_path, true AS frag_ok
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT {_Q['nations']}, n_name, 1, 'markdown', 'NATION_' || ((n_nationkey + 1) % 25) || '.md', 'heading', 'harvest-plan', 'next',
         7, 5 + length(r_name) + 9, '[next](NATION_' || ((n_nationkey + 1) % 25) || '.md#harvest-plan)', 'nation_' || ((n_nationkey + 1) % 25),
         'wiki/nations/NATION_' || ((n_nationkey + 1) % 25) || '.md', ((n_nationkey + 1) % 25) % 3 = 0
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT {_Q['suppliers']}, replace(s_name, '#', '-'), 0, 'obsidian', 'n' || s_nationkey, NULL, NULL, 'N' || s_nationkey, 9, 10,
         '[[N' || s_nationkey || ']]', 'nation_' || s_nationkey, 'wiki/nations/NATION_' || s_nationkey || '.md', true FROM supplier
  UNION ALL
  SELECT {_Q['suppliers']}, replace(s_name, '#', '-'), 1, 'obsidian', 'missing ' || s_suppkey, NULL, NULL, 'Missing ' || s_suppkey, 9,
         10 + length('[[N' || s_nationkey || ']]. See '), '[[Missing ' || s_suppkey || ']]', NULL, NULL, true FROM supplier WHERE s_suppkey % 7 = 0
  UNION ALL
  SELECT {_Q['suppliers']}, replace(s_name, '#', '-'), CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 1 END, 'obsidian', 'nation_' || s_nationkey, 'block', 'estimate', 'NATION_' || s_nationkey, 9,
         10 + length('[[N' || s_nationkey || ']].') + CASE WHEN s_suppkey % 7 = 0 THEN length(' See [[Missing ' || s_suppkey || ']].') ELSE 0 END + length(' Cites '),
         '[[NATION_' || s_nationkey || '#^estimate]]', 'nation_' || s_nationkey, 'wiki/nations/NATION_' || s_nationkey || '.md', s_nationkey % 3 = 0
  FROM supplier WHERE s_suppkey % 5 = 1
  UNION ALL
  SELECT {_Q['customers']}, replace(c_name, '#', '-'), 0, 'obsidian', 'n' || c_nationkey, NULL, NULL, 'home', 3, 4, '[[N' || c_nationkey || '|home]]',
         'nation_' || c_nationkey, 'wiki/nations/NATION_' || c_nationkey || '.md', true FROM customer
  UNION ALL
  SELECT 'index.md', 'index', row_number() OVER (ORDER BY name) - 1, 'obsidian', lower(name), NULL, NULL, name, 2 + row_number() OVER (ORDER BY name), 3,
         '[[' || name || ']]', lower(name), CASE WHEN name LIKE 'NATION%' THEN 'wiki/nations/' ELSE 'wiki/regions/' END || name || '.md', true FROM idx)"""

_W = f"WITH {_PAGES},{_LINKS}"


def _broken(where: str, value: str) -> str:
    return f"{_W} SELECT rel_path, line, col, markup, {value} AS reason_value FROM l WHERE {where}"


_FIRST_LINE = "'---' || chr(10)"
# Length of what stands before a supplier's first link.
_SUPPLIER_HEAD = "length('---' || chr(10) || 'type: supplier' || chr(10) || 'nation: N' || s_nationkey || chr(10) || '---' || chr(10) || '# ' || s_name || chr(10) || chr(10) || '## Nation ' || s_nationkey || chr(10) || chr(10) || 'Based in ')"
_NATION_HEAD = "length('---' || chr(10) || 'type: nation' || chr(10) || 'aliases: [N' || n_nationkey || ']' || chr(10) || '---' || chr(10) || '# ' || n_name || chr(10) || chr(10) || 'See ')"
# Offsets of a nation's link to the next one, and of its section heading's text.
_NEXT_AT = f"({_NATION_HEAD} + length('[[' || r_name || ']] and [next]('))"
_NEXT_LEN = "length('NATION_' || ((n_nationkey + 1) % 25) || '.md#harvest-plan')"
_HEADING_AT = f"({_NEXT_AT} + {_NEXT_LEN} + 3 + 1 + 3)"
_CUSTOMER_HEAD = "length('# ' || c_name || chr(10) || chr(10) || 'In [[N' || c_nationkey || '|home]].' || chr(10) || chr(10) || 'Ships to ')"
_CUSTOMER_ALL = f"({_CUSTOMER_HEAD} + length('NATION_' || c_nationkey || ', not NATION_' || c_nationkey || 'x.' || chr(10) || chr(10) || '## ' || c_mktsegment || chr(10)))"
_NATIONS = "nation JOIN region ON n_regionkey = r_regionkey"

ORACLES = {
    "scan_directories": f"WITH {_PAGES} SELECT CASE WHEN rel_path = 'index.md' THEN '.' ELSE regexp_replace(rel_path, '/[^/]*$', '') END AS dir, count(*) AS n_files FROM p GROUP BY 1 UNION ALL SELECT 'notes', count(*) FROM documents",
    "scan_frontmatter_fields": """
        SELECT 'wiki/regions' AS dir, 'type' AS field, count(*) AS n_files, 100 AS pct FROM region
        UNION ALL SELECT 'wiki/nations', f, count(*), 100 FROM nation, (SELECT unnest(['type', 'aliases']) AS f) GROUP BY f
        UNION ALL SELECT 'wiki/suppliers', f, count(*), 100 FROM supplier, (SELECT unnest(['type', 'nation']) AS f) GROUP BY f""",
    "scan_headings_topk": """
        WITH h AS (
          SELECT 'wiki/regions' AS dir, 'Notes' AS heading, count(*) AS n FROM region
          UNION ALL SELECT 'wiki/nations', 'Harvest Plan', count(*) FROM nation WHERE n_nationkey % 3 = 0
          UNION ALL SELECT 'wiki/suppliers', 'Nation ' || s_nationkey, count(*) FROM supplier GROUP BY 2
          UNION ALL SELECT 'wiki/customers', c_mktsegment, count(*) FROM customer GROUP BY 2),
        s AS (SELECT 'wiki/regions' AS dir, count(*) AS n_files FROM region UNION ALL SELECT 'wiki/nations', count(*) FROM nation
          UNION ALL SELECT 'wiki/suppliers', count(*) FROM supplier UNION ALL SELECT 'wiki/customers', count(*) FROM customer)
        SELECT * FROM (
          SELECT dir, row_number() OVER (PARTITION BY dir ORDER BY n DESC, heading) AS rank, heading, n, round_even(n * 100.0 / n_files, 0)::INT AS pct,
                 greatest(0, count(*) OVER (PARTITION BY dir) - 10) AS n_more FROM h JOIN s USING (dir)) WHERE rank <= 10""",
    "mirror_candidates": "SELECT 'raw/regions' AS left_dir, 'wiki/regions' AS right_dir, count(*) AS n_files FROM region",
    "index_refs": f"WITH {_PAGES} SELECT 'index.md' AS path, count(DISTINCT lower(name)) AS n_refs FROM idx",
    "page_categories": f"""WITH {_PAGES}
        SELECT CASE WHEN kind = 'index' THEN 'index' WHEN kind LIKE 'raw%' THEN 'unmanaged' ELSE 'managed' END AS category,
               CASE WHEN kind = 'index' OR kind LIKE 'raw%' THEN '-' ELSE 'wiki/' || kind END AS folder, count(*) AS n FROM (
          SELECT kind FROM p UNION ALL SELECT 'raw_notes' FROM documents) GROUP BY 1, 2""",
    "name_conflicts": """
        SELECT 'n' || n_nationkey AS name, 'alias-is-page' AS kind, 'wiki/nations/' || n_name || '.md,wiki/suppliers/N' || n_nationkey || '.md' AS paths
        FROM nation WHERE n_nationkey % 5 = 0""",
    "links_all": f"{_W} SELECT rel_path, pos, style, target, frag_kind, frag, display, line, col FROM l",
    "refs_graph": f"{_W} SELECT lower(stem) AS source, page AS target FROM l WHERE page IS NOT NULL",
    "refs_to": f"{_W} SELECT DISTINCT rel_path FROM l WHERE page = 'nation_3'",
    "refs_from": f"{_W} SELECT DISTINCT page AS target FROM l WHERE lower(stem) = 'supplier-000000001' AND page IS NOT NULL",
    "inbound_counts": f"{_W} SELECT page AS target, count(DISTINCT rel_path) AS n_sources FROM l WHERE page IS NOT NULL GROUP BY page",
    "links_broken_page": _broken("page IS NULL", "'-'"),
    "links_broken_heading": _broken("NOT frag_ok AND frag_kind = 'heading'", "frag"),
    "links_broken_block": _broken("NOT frag_ok AND frag_kind = 'block'", "frag"),
    "links_orphans": f"{_W} SELECT lower(stem) AS page_id, rel_path FROM p WHERE kind IN ('regions', 'nations', 'suppliers', 'customers') AND lower(stem) NOT IN (SELECT page FROM l WHERE page IS NOT NULL)",
    "links_check_mentions": f"SELECT {_Q['customers']} AS rel_path, 'nation_' || c_nationkey AS concept, 5 AS line, 10 AS col FROM customer",
    "lint_broken_links": f"{_W} SELECT 'error' AS severity, 'broken-link' AS code, count(*) AS n FROM l WHERE page IS NULL OR NOT frag_ok HAVING count(*) > 0",
    "lint_orphans": f"""{_W} SELECT 'warn' AS severity, 'orphan' AS code, rel_path, rel_path || ' has no inbound internal links' AS message
        FROM p WHERE kind IN ('regions', 'nations', 'suppliers', 'customers') AND lower(stem) NOT IN (SELECT page FROM l WHERE page IS NOT NULL)""",
    "lint_index_coverage": f"""{_W} SELECT 'error' AS severity, 'not-in-index' AS code, rel_path, rel_path || ' is not listed in index' AS message
        FROM p WHERE kind IN ('regions', 'nations', 'suppliers', 'customers') AND stem NOT IN (SELECT name FROM idx)""",
    "lint_required_sections": f"""
        SELECT 'error' AS severity, 'missing-section' AS code, {_Q['nations']} AS rel_path, {_Q['nations']} || ' is missing ''## harvest plan''' AS message, 'harvest plan' AS detail
        FROM nation WHERE n_nationkey % 3 <> 0""",
    "lint_required_frontmatter": f"""
        SELECT 'error' AS severity, 'missing-frontmatter' AS code, {_Q['regions']} AS rel_path, 'owner' AS detail FROM region
        UNION ALL SELECT 'error', 'no-frontmatter', {_Q['customers']}, '-' FROM customer""",
    "lint_when_predicate": f"SELECT 'missing-frontmatter' AS code, {_Q['suppliers']} AS rel_path, 'owner' AS detail FROM supplier",
    "lint_mirror_parity": f"""
        SELECT 'error' AS severity, {_Q['nations']} AS rel_path, {_Q['nations']} || ' has no raw/nations/' || n_name || '.md' AS message FROM nation WHERE n_nationkey % 4 = 0""",
    "lint_citation_filename": f"SELECT 'warn' AS severity, {_Q['customers']} AS rel_path, 'NATION_' || c_nationkey || 'x' AS detail FROM customer",
    "lint_citation_content": f"""
        SELECT 'error' AS severity, {_Q['suppliers']} AS rel_path, 'N' || s_nationkey AS detail FROM supplier
        WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 4 <> 0 AND contains('Ref N' || n_nationkey || ';', 'N' || s_nationkey))""",
    "lint_summary": f"""{_W}
        SELECT (SELECT count(*) FROM l WHERE page IS NULL OR NOT frag_ok)
             + (SELECT count(*) FROM p WHERE kind IN ('regions', 'nations', 'suppliers', 'customers') AND lower(stem) NOT IN (SELECT page FROM l WHERE page IS NOT NULL))
             + (SELECT count(*) FROM p WHERE kind IN ('regions', 'nations', 'suppliers', 'customers') AND stem NOT IN (SELECT name FROM idx))
             + (SELECT count(*) FROM nation WHERE n_nationkey % 3 <> 0) + (SELECT count(*) FROM region) + (SELECT count(*) FROM customer)
             + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation WHERE n_nationkey % 4 = 0)
             + (SELECT count(*) FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 4 <> 0 AND contains('Ref N' || n_nationkey || ';', 'N' || s_nationkey))) AS n_errors,
               (SELECT count(*) FROM customer) AS n_warnings""",
    "links_format_edits": f"""
        WITH s AS (SELECT *, s_suppkey % 5 = 1 AND s_nationkey % 3 = 0 AS twice, {_SUPPLIER_HEAD} AS h, length('[[N' || s_nationkey || ']]') AS w,
                   CASE WHEN s_suppkey % 7 = 0 THEN length(' See [[Missing ' || s_suppkey || ']].') ELSE 0 END AS gap, length('[[NATION_' || s_nationkey || '#^estimate]]') AS w2,
                   'NATION_' || s_nationkey AS nm FROM supplier)
        SELECT {_Q['suppliers']} AS rel_path, h::INT AS start, (h + w)::INT AS "end",
               CASE WHEN twice THEN '[N' || s_nationkey || '][' || nm || ']' ELSE '[N' || s_nationkey || '](../nations/' || nm || '.md)' END AS replacement FROM s
        UNION ALL SELECT {_Q['suppliers']}, (h + w + 1 + gap + 7)::INT, (h + w + 1 + gap + 7 + w2)::INT, '[' || nm || '][' || nm || '#^estimate]' FROM s WHERE twice
        UNION ALL SELECT {_Q['suppliers']}, (h + w + 1 + gap + 7 + w2 + 2)::INT, (h + w + 1 + gap + 7 + w2 + 2)::INT,
               chr(10) || '[' || nm || ']: ../nations/' || nm || '.md' || chr(10) || '[' || nm || '#^estimate]: ../nations/' || nm || '.md#^estimate' || chr(10) FROM s WHERE twice
        UNION ALL SELECT {_Q['nations']}, {_NATION_HEAD}::INT, ({_NATION_HEAD} + length(r_name) + 4)::INT, '[' || r_name || '](../regions/' || replace(r_name, ' ', '%20') || '.md)' FROM {_NATIONS}
        UNION ALL SELECT {_Q['customers']}, length('# ' || c_name || chr(10) || chr(10) || 'In ')::INT, length('# ' || c_name || chr(10) || chr(10) || 'In [[N' || c_nationkey || '|home]]')::INT,
               '[home](../nations/NATION_' || c_nationkey || '.md)' FROM customer
        UNION ALL SELECT 'index.md', (upto - length(name) - 5)::INT, (upto - 1)::INT, '[' || name || '](wiki/' || CASE WHEN name LIKE 'NATION%' THEN 'nations/' ELSE 'regions/' END || replace(name, ' ', '%20') || '.md)' FROM (
          SELECT name, length('# Index' || chr(10) || chr(10)) + sum(length(name) + 7) OVER (ORDER BY name) AS upto FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 5 <> 0))""",
    "links_fix_edits": f"""
        SELECT {_Q['customers']} AS rel_path, {_CUSTOMER_HEAD}::INT AS start, ({_CUSTOMER_HEAD} + length('NATION_' || c_nationkey))::INT AS "end", '[NATION_' || c_nationkey || ']' AS replacement FROM customer
        UNION ALL SELECT {_Q['customers']}, {_CUSTOMER_ALL}::INT, {_CUSTOMER_ALL}::INT, chr(10) || '[NATION_' || c_nationkey || ']: ../nations/NATION_' || c_nationkey || '.md' || chr(10) FROM customer""",
    "rename_edits": f"""
        SELECT {_Q['suppliers']} AS rel_path, {_SUPPLIER_HEAD}::INT AS start, ({_SUPPLIER_HEAD} + 6)::INT AS "end", '[[Nation Three]]' AS replacement FROM supplier WHERE s_nationkey = 3
        UNION ALL SELECT {_Q['suppliers']}, h::INT, (h + 22)::INT, '[[Nation Three#^estimate]]' FROM (
          SELECT s_name, {_SUPPLIER_HEAD} + 7 + CASE WHEN s_suppkey % 7 = 0 THEN length(' See [[Missing ' || s_suppkey || ']].') ELSE 0 END + 7 AS h FROM supplier WHERE s_nationkey = 3 AND s_suppkey % 5 = 1)
        UNION ALL SELECT {_Q['customers']}, h::INT, (h + 11)::INT, '[[Nation Three|home]]' FROM (SELECT c_name, length('# ' || c_name || chr(10) || chr(10) || 'In ') AS h FROM customer WHERE c_nationkey = 3)
        UNION ALL SELECT 'index.md', h::INT, (h + 12)::INT, '[[Nation Three]]' FROM (
          SELECT length('# Index' || chr(10) || chr(10)) + coalesce(sum(length(name) + 7), 0) + 2 AS h FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 5 <> 0) WHERE name < 'NATION_3')
        UNION ALL SELECT {_Q['nations']}, {_NEXT_AT}::INT, ({_NEXT_AT} + {_NEXT_LEN})::INT, 'Nation%20Three.md#harvest-plan' FROM {_NATIONS} WHERE n_nationkey = 2""",
    "rename_moves": "SELECT 'wiki/nations/NATION_3.md' AS old, 'wiki/nations/Nation Three.md' AS new UNION ALL SELECT 'raw/nations/NATION_3.md', 'raw/nations/Nation Three.md'",
    "move_edits": f"""
        SELECT {_Q['nations']} AS rel_path, {_NEXT_AT}::INT AS start, ({_NEXT_AT} + {_NEXT_LEN})::INT AS "end",
               CASE WHEN n_nationkey = 2 THEN '../../archive/NATION_3.md#harvest-plan' ELSE '../wiki/nations/NATION_4.md#harvest-plan' END AS replacement
        FROM {_NATIONS} WHERE n_nationkey IN (2, 3)""",
    "sections_rename_edits": f"""
        SELECT {_Q['nations']} AS rel_path, {_HEADING_AT}::INT AS start, ({_HEADING_AT} + 12)::INT AS "end", 'Market Notes' AS replacement FROM {_NATIONS} WHERE n_nationkey % 3 = 0
        UNION ALL SELECT {_Q['nations']}, ({_NEXT_AT} + {_NEXT_LEN} - 12)::INT, ({_NEXT_AT} + {_NEXT_LEN})::INT, 'market-notes' FROM {_NATIONS}""",
    "frontmatter_get": f"""SELECT {_Q['suppliers']} AS rel_path, '"N' || s_nationkey || '"' AS value FROM supplier""",
    "frontmatter_set_edits": f"""
        SELECT {_Q['suppliers']} AS rel_path, '---' || chr(10) || 'type: supplier' || chr(10) || 'nation: N' || s_nationkey || chr(10) || 'owner: alice' || chr(10) || '---' AS head FROM supplier""",
    "diff_hunks": f"""
        SELECT {_Q['nations']} AS rel_path, 9 AS line, '## Harvest Plan' || chr(10) AS old, '## Market Notes' || chr(10) AS new FROM nation WHERE n_nationkey % 3 = 0
        UNION ALL SELECT {_Q['nations']}, 7, x || 'harvest-plan).' || chr(10), x || 'market-notes).' || chr(10) FROM (
          SELECT n_name, 'See [[' || r_name || ']] and [next](NATION_' || ((n_nationkey + 1) % 25) || '.md#' AS x FROM {_NATIONS})""",
    "edit_validation": f"""WITH {_PAGES}
        SELECT rel_path, start, reason FROM p, (VALUES (3, 'overlaps'), (100000, 'out of bounds')) AS e(start, reason) WHERE kind IN ('nations', 'suppliers', 'customers')""",
    "heading_anchors": f"""
        WITH h AS (
          SELECT {_Q['regions']} AS rel_path, 0 AS pos, 1 AS level, r_name AS text FROM region
          UNION ALL SELECT {_Q['regions']}, 1, 2, 'Notes' FROM region
          UNION ALL SELECT {_Q['nations']}, 0, 1, n_name FROM nation
          UNION ALL SELECT {_Q['nations']}, 1, 2, 'Harvest Plan' FROM nation WHERE n_nationkey % 3 = 0
          UNION ALL SELECT {_Q['suppliers']}, 0, 1, replace(s_name, '#', '-') FROM supplier
          UNION ALL SELECT {_Q['suppliers']}, 1, 2, 'Nation ' || s_nationkey FROM supplier
          UNION ALL SELECT {_Q['customers']}, 0, 1, replace(c_name, '#', '-') FROM customer
          UNION ALL SELECT {_Q['customers']}, 1, 2, c_mktsegment FROM customer
          UNION ALL SELECT 'index.md', 0, 1, 'Index')
        SELECT *, replace(lower(text), ' ', '-') AS anchor FROM h""",
    "block_ids": f"SELECT {_Q['nations']} AS rel_path, 'estimate' AS block_id FROM nation WHERE n_nationkey % 3 = 0",
    "path_normalize": """
        SELECT p_partkey, 'x/' || p_partkey || '.md' AS path, '../' || p_partkey || '.md' AS relative FROM part""",
    "url_decode": """
        SELECT p_partkey, p_name || ' + ' || chr(233) || '#' || p_size AS decoded,
               replace(p_name, ' ', '%20') || '%20+%2520%25C3%25A9%23' || p_size AS encoded FROM part""",
    "href_graph": """
        WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS href FROM pages)
        SELECT translate(href, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM h GROUP BY 1""",
}


_REF_PAGE = MORE["references"][0]
# Offsets of the reference link, and of its definition, on a page (``x]`` for the escaped bracket).
_REF_AT = "length('# ' || n_name || chr(10) || chr(10) || 'Go ')"
_REF_END = f"({_REF_AT} + length('[on][The x]  Next]'))"
_REF_DEF = f"({_REF_END} + length(' now.') + 2)"
_REF_URL = f"({_REF_DEF} + length('[the x] next]:') + 3)"
_REF_NEXT = "'NATION_' || ((n_nationkey + 1) % 25)"

ORACLES |= {
    "scan_files": f"""
        WITH {_PAGES}
        SELECT rel_path FROM p WHERE kind NOT LIKE 'raw%' AND NOT (kind = 'customers' AND stem LIKE '%1')
        UNION ALL SELECT {_Q['notes']} FROM documents WHERE doc_id % 5 <> 0
        UNION ALL SELECT {MORE['drafts'][0]} FROM nation WHERE n_regionkey IN (1, 2)""",
    "scan_nested_rules": """
        WITH f AS (SELECT 'ledgers/c' || o_custkey || '/' || o_orderkey || '.md' AS rel_path, o_custkey AS c, o_orderkey::VARCHAR AS o, (o_custkey % 10)::VARCHAR AS x FROM orders),
        s AS (SELECT *, c % 2 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = c) AS own FROM f WHERE c % 10 <> 9)
        SELECT rel_path FROM s WHERE CASE WHEN own AND o LIKE '%5' || x THEN true WHEN own AND o LIKE '%' || x THEN false ELSE o NOT LIKE '%3' END""",
    "scan_tree": f"""
        SELECT {_Q['regions']} AS rel_path, length({_T['regions']})::INT AS n_chars FROM region
        UNION ALL SELECT {_Q['nations']}, length({_T['nations']})::INT FROM {_NATIONS}
        UNION ALL SELECT {_Q['suppliers']}, length({_T['suppliers']})::INT FROM supplier WHERE s_name LIKE '%10' OR NOT (s_name LIKE '%0' OR s_name LIKE '%5')
        UNION ALL SELECT {MORE['drafts'][0]}, 1 FROM nation WHERE n_regionkey IN (1, 2)
        UNION ALL SELECT 'index.md', length('# Index' || chr(10) || chr(10)) + sum(length(name) + 7)::INT FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 5 <> 0)""",
    "tree_rename": f"""
        WITH f AS (
          {" UNION ALL ".join(f"SELECT {_Q[k]} AS rel_path, {_T[k]} AS source FROM {PAGES[k][2]}" for k in ('regions', 'raw_regions', 'nations', 'raw_nations', 'suppliers', 'customers'))}
          UNION ALL SELECT 'index.md', '# Index' || chr(10) || chr(10) || string_agg('- [[' || name || ']]' || chr(10), '' ORDER BY name) FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 5 <> 0))
        SELECT replace(rel_path, 'nations/NATION_3.md', 'nations/Nation Three.md') AS rel_path,
               replace(replace(replace(replace(replace(source, '[[N3]]', '[[Nation Three]]'), '[[N3|', '[[Nation Three|'), '[[NATION_3#', '[[Nation Three#'), '[[NATION_3]]', '[[Nation Three]]'), '(NATION_3.md#', '(Nation%20Three.md#') AS source FROM f""",
    "mentions_in_notes": """
        WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+(-+[A-Za-z0-9_]+)*')) AS word FROM documents)
        SELECT lower(word) AS concept, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_files FROM w WHERE lower(word) IN ('the', 'that', 'and', 'with') GROUP BY 1""",
    "mentions_of_customers": """
        SELECT 'orders/' || o_orderkey || '.md' AS rel_path, 'customer-' || lpad(o_custkey::VARCHAR, 9, '0') AS concept, (14 + length(o_orderkey::VARCHAR))::INT AS start,
               (32 + length(o_orderkey::VARCHAR))::INT AS "end", 3 AS line, 5 AS col FROM orders""",
    "mentions_of_terms": """
        WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+(-+[A-Za-z0-9_]+)*')) AS word FROM documents),
        n AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS concept FROM benchmark)
        SELECT concept, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_files FROM w JOIN n ON lower(word) = concept GROUP BY 1""",
    "lint_citation_accounts": """
        WITH c AS (SELECT DISTINCT o_custkey AS k FROM orders),
        lost AS (SELECT k FROM c WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 3 <> 0 AND starts_with(c_custkey::VARCHAR, k::VARCHAR)))
        SELECT 'warn' AS severity, 'account' AS code, 'orders/' || o_orderkey || '.md' AS rel_path, 'C' || o_custkey AS detail FROM orders JOIN lost ON o_custkey = k""",
    "wiki_totals": f"""{_W}
        SELECT (SELECT count(*) FROM customer) AS n_mentions, 2 * (SELECT count(*) FROM customer) AS n_edits, (SELECT count(*) FROM l WHERE page IS NULL OR NOT frag_ok) AS n_broken,
               (SELECT count(*) FROM p WHERE kind IN ('regions', 'nations', 'suppliers', 'customers') AND lower(stem) NOT IN (SELECT page FROM l WHERE page IS NOT NULL)) AS n_orphans""",
    "parse_store": f"""
        WITH {_PAGES},
        h AS (
          SELECT {_Q['regions']} AS rel_path, 0 AS pos, 1 AS level, r_name AS text FROM region
          UNION ALL SELECT {_Q['regions']}, 1, 2, 'Notes' FROM region
          UNION ALL SELECT {_Q['nations']}, 0, 1, n_name FROM nation
          UNION ALL SELECT {_Q['nations']}, 1, 2, 'Harvest Plan' FROM nation WHERE n_nationkey % 3 = 0
          UNION ALL SELECT {_Q['suppliers']}, 0, 1, replace(s_name, '#', '-') FROM supplier
          UNION ALL SELECT {_Q['suppliers']}, 1, 2, 'Nation ' || s_nationkey FROM supplier
          UNION ALL SELECT {_Q['customers']}, 0, 1, replace(c_name, '#', '-') FROM customer
          UNION ALL SELECT {_Q['customers']}, 1, 2, c_mktsegment FROM customer
          UNION ALL SELECT 'index.md', 0, 1, 'Index')
        SELECT rel_path, pos, level, text, (SELECT count(*) FROM p) AS n_first, (SELECT count(*) FROM customer WHERE c_name LIKE '%7') AS n_second, 0 AS n_third FROM (
          SELECT * FROM h UNION ALL SELECT {_Q['customers']}, 2, 3, 'Added' FROM customer WHERE c_name LIKE '%7')""",
    "page_headings": "SELECT 0 AS pos, 1 AS level, 'NATION_3' AS text UNION ALL SELECT 1, 2, 'Harvest Plan'",
    "lint_reasons": f"""{_W}
        SELECT 'error' AS severity, rel_path, markup || ' in ' || rel_path AS message,
               CASE WHEN page IS NULL THEN 'page not found' WHEN frag_kind = 'block' THEN 'block not found: ''^' || frag || '''' ELSE 'heading not found: ''' || frag || '''' END AS detail
        FROM l WHERE page IS NULL OR NOT frag_ok""",
    "lint_citation_preset": f"""
        SELECT 'warn' AS severity, 'brand' AS code, {MORE['parts'][0]} AS rel_path, replace(p_brand, '#', '-') AS detail FROM part WHERE p_brand NOT LIKE '%2'""",
    "settings_rules": """
        SELECT s_suppkey AS fixture, 0 AS pos, 'required-sections' AS "check", 'error' AS severity, '' AS name, 'topics,b' AS dirs, '' AS match_in, 'content' AS match_mode FROM supplier WHERE s_suppkey % 6 = 1
        UNION ALL SELECT s_suppkey, 0, 'citation-pattern', 'warn', 'c' || s_suppkey, '', 'papers', 'filename' FROM supplier WHERE s_suppkey % 6 = 2
        UNION ALL SELECT s_suppkey, 1, 'citation-pattern', 'off', 'own', '', 'p', 'content' FROM supplier WHERE s_suppkey % 6 = 2""",
    "settings_table": """
        WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 AS c, s_suppkey % 4 AS t FROM supplier)
        SELECT k AS fixture, CASE WHEN bad AND c = 4 THEN 'checks.broken_links: unknown severity ' || chr(39) || 'loud' || k || chr(39) || '; expected error, warn or off'
                                  WHEN bad THEN 'linking.reference_style_threshold must be at least 1' END AS error,
               CASE WHEN NOT bad AND c <> 1 THEN 'index.md' END AS "index",
               CASE WHEN bad THEN NULL WHEN c = 1 THEN 'topics/deep' || k || ':false,topics:true' WHEN c = 5 AND t <> 1 THEN '.:true' ELSE 'wiki:true' END AS directories,
               CASE WHEN bad THEN NULL WHEN c = 0 THEN 'drafts' || k || '/' ELSE '.windsurf/' END AS last_ignored, CASE WHEN bad THEN NULL WHEN c = 0 THEN 18 ELSE 17 END AS n_ignored,
               CASE WHEN bad THEN NULL WHEN c = 3 THEN 'markdown' ELSE 'obsidian' END AS link_style, CASE WHEN NOT bad AND c = 3 THEN t END::INT AS reference_style_threshold,
               CASE WHEN bad THEN '' WHEN c = 0 THEN 'error,warn,off,error' ELSE 'error,warn,error,error' END AS checks
        FROM (SELECT *, c = 4 OR (c = 3 AND t = 0) AS bad FROM s)""",
    "roots_discovered": """
        WITH s AS (SELECT 'sites/' || n_regionkey || '/' || s_suppkey AS site, s_suppkey AS k, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        t AS (SELECT site || '/notes/xwiki/a.md' AS start, * FROM s UNION ALL SELECT site || '/wiki/deep/wiki/page.md', * FROM s WHERE k % 4 IN (1, 3))
        SELECT start, CASE WHEN k % 4 <> 3 THEN site WHEN r < 2 THEN 'sites/' || r END AS root,
               CASE WHEN k % 4 = 0 THEN 'wiki.toml' WHEN k % 4 = 1 THEN 'index.md and wiki' WHEN k % 4 = 2 OR r < 2 THEN 'index.md' END AS found_by FROM t""",
    "roots_explicit": """
        WITH s AS (SELECT 'sites/' || n_regionkey || '/' || s_suppkey AS site, s_suppkey AS k, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT folder, bool_or(is_root) AS is_root FROM (
          SELECT site AS folder, true AS is_root FROM s
          UNION ALL SELECT site || '/wiki', false FROM s WHERE k % 4 IN (1, 3) UNION ALL SELECT site || '/wiki/deep', true FROM s WHERE k % 4 IN (1, 3)
          UNION ALL SELECT site || '/wiki/deep/wiki', false FROM s WHERE k % 4 IN (1, 3) UNION ALL SELECT site || '/notes', false FROM s UNION ALL SELECT site || '/notes/xwiki', false FROM s
          UNION ALL SELECT 'sites/' || r, r < 2 FROM s UNION ALL SELECT 'sites/' || r_regionkey, true FROM region WHERE r_regionkey < 2 UNION ALL SELECT 'sites', false UNION ALL SELECT '', false)
        GROUP BY folder""",
    "setup_text": """
        WITH r AS (
          SELECT 1 AS part, 'wiki/nations' AS a, 1 AS b, 'required-frontmatter' AS c, 'dirs = ["wiki/nations"]' || chr(10) || 'fields = ["aliases", "type"]' AS t FROM nation WHERE n_nationkey = 0
          UNION ALL SELECT 1, 'wiki/regions', 1, 'required-frontmatter', 'dirs = ["wiki/regions"]' || chr(10) || 'fields = ["type"]'
          UNION ALL SELECT 1, 'wiki/regions', 2, 'required-sections', 'dirs = ["wiki/regions"]' || chr(10) || 'sections = ["Notes"]'
          UNION ALL SELECT 1, 'wiki/suppliers', 1, 'required-frontmatter', 'dirs = ["wiki/suppliers"]' || chr(10) || 'fields = ["nation", "type"]'
          UNION ALL SELECT 2, 'raw/regions', 1, 'mirror-parity', 'left = "wiki/regions"' || chr(10) || 'right = "raw/regions"')
        SELECT string_agg('[[rules]]' || chr(10) || 'check = "' || c || '"' || chr(10) || t || chr(10) || 'severity = "error"' || chr(10) || chr(10), '' ORDER BY part, a, b) AS text FROM r""",
    "setup_required": """
        SELECT 'wiki/regions' AS dir, count(*) AS n_files, '"type"' AS fields, '"Notes"' AS sections FROM region
        UNION ALL SELECT 'wiki/nations', count(*), '"aliases", "type"', '-' FROM nation
        UNION ALL SELECT 'wiki/suppliers', count(*), '"nation", "type"', '-' FROM supplier
        UNION ALL SELECT 'wiki/customers', count(*), '-', '-' FROM customer""",
    "links_format_wikilinks": f"""
        SELECT {_REF_PAGE} AS rel_path, {_REF_AT}::INT AS start, {_REF_END}::INT AS "end", '[[' || {_REF_NEXT} || '|on]]' AS replacement FROM nation
        UNION ALL SELECT {_REF_PAGE}, {_REF_DEF}::INT, ({_REF_URL} + length({_REF_NEXT} || '.md') + 1)::INT, '' FROM nation""",
    "move_definition_edits": f"""
        SELECT {_REF_PAGE} AS rel_path, {_REF_URL}::INT AS start, ({_REF_URL} + length({_REF_NEXT} || '.md'))::INT AS "end",
               CASE WHEN n_nationkey = 2 THEN '../../archive/NATION_3.md' ELSE '../wiki/nations/NATION_4.md' END AS replacement FROM nation WHERE n_nationkey IN (2, 3)""",
    "frontmatter_json": f"""
        SELECT {_Q['regions']} AS rel_path, '{{"type":"region"}}' AS json FROM region
        UNION ALL SELECT {_Q['nations']}, '{{"aliases":["N' || n_nationkey || '"],"type":"nation"}}' FROM nation
        UNION ALL SELECT {_Q['suppliers']}, '{{"nation":"N' || s_nationkey || '","type":"supplier"}}' FROM supplier""",
    "edits_effective": f"""WITH {_PAGES} SELECT rel_path, 0 AS start, 3 AS "end", '+++' AS replacement FROM p WHERE kind IN ('nations', 'suppliers') AND k % 2 = 0""",
    "markdown_block_ids": f"SELECT {_Q['nations']} AS rel_path, 0 AS pos, 'estimate' AS block_id FROM nation WHERE n_nationkey % 3 = 0",
    "name_rules": """
        SELECT p_partkey, p_type || '/x' AS folder, chr(92) || '[' || p_brand || chr(92) || ']' || chr(92) || chr(92) AS label, '"' || p_brand || '", "' || p_type || '"' AS listed,
               p_partkey % 5 IN (0, 4) AS is_md FROM part""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
