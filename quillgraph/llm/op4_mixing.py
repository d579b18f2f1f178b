"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share 150 % of all words; a target stops at twice its source's size and the
excess goes to the others by weight until none is above (one pass over the
sources ordered by cap / weight finds that level exactly).

The mix is dealt in blocks of equally many words.  Highest quotients
target / (2k + 1) give each source an integer number of blocks, then
shard size / (2k + 1) gives each shard of a source its quota.  Where blocks
are large for the shards, those of the source are dealt in smaller ones, and
what a shard cannot take (it gives at most ``CAP`` times its words) goes to the
source's shards with room, so the quotas add up to the source's blocks.  A shard's
documents stand in a seeded order; a quota takes whole passes over the shard
and, for what remains, blocks in seeded order, the last one cut short.

Only DataFrame functions are used.  Words are counted once; nothing but
(doc_id, source, size) is shuffled, in groups of about ``SHARD_ROWS`` rows, so
a source with a third of all rows is spread over many tasks.  Per source, and
per shard within a source, the work is one row and a bounded number of
quotients: the rounded shares differ from the quota by at most half the number
of items, and each item gives only as many candidate quotients as its share of
that difference can ask for.

Nulls and empty texts have size 0 and are taken 0 times.  A null source is a
source.  Rows of equal doc_id are told apart by their size, equal rows are
alike.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
SHARD_ROWS = 4096
#: Blocks in the smallest target, if that keeps the number of blocks below MAX_BLOCKS.
FINENESS = 64
MAX_BLOCKS = 2_000_000
#: A target below so many blocks is dealt in blocks of 1/FINENESS of itself.
SMALL = 8

_WORD = "[^\\x20\\x09-\\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *more: Column) -> DataFrame:
    """doc_id, source, size and ``more``."""
    return docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), F.regexp_count(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(_WORD)).cast("long").alias("size"), *more)


def targets(sizes: DataFrame) -> DataFrame:
    """source, n_rows, source_size, target, unit (words in a block) and blocks."""
    by = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    # One row per source from here on.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") - 1) % len(WEIGHTS) + 1))
    by = by.withColumn("most", F.col("source_size") * CAP)
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    so_far, from_here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    by = by.withColumn("total", F.sum("source_size").over(everything) * F.lit(SHARE))
    by = by.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(so_far), F.lit(0))) / F.sum("weight").over(from_here))
    by = by.withColumn("final", F.min(F.when(F.col("most") > F.col("weight") * F.col("level"), F.struct((F.col("most") / F.col("weight")).alias("q"), "place", "level"))).over(everything))
    free = F.col("final").isNotNull() & (F.struct(F.col("most") / F.col("weight"), F.col("place")) >= F.struct("final.q", "final.place"))
    by = by.withColumn("target", F.when(free, F.col("weight") * F.col("final.level")).otherwise(F.col("most").cast("double")))
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.greatest(F.lit(1.0), F.floor(smallest / FINENESS), F.ceil(F.col("total") / MAX_BLOCKS))
    by = by.withColumn("block", F.coalesce(block, F.lit(1.0)).cast("long"))
    small = F.col("target") < F.col("block") * SMALL
    by = by.withColumn("unit", F.when(small, F.greatest(F.lit(1.0), F.floor(F.col("target") / FINENESS))).otherwise(F.col("block")).cast("long"))
    large = F.when(small, 0.0).otherwise(F.col("target"))
    seats = F.floor(F.sum(large).over(everything) / F.col("block") + 0.5)
    by = apportion(by.withColumn("votes", large).withColumn("seats", seats), [], "place")
    by = by.withColumn("blocks", F.when(F.col("target") < F.col("block") * SMALL, F.floor(F.col("target") / F.col("unit") + 0.5)).otherwise(F.col("won")).cast("long"))
    return by.select("source", "n_rows", "source_size", "target", "unit", "blocks")


def apportion(items: DataFrame, group: list[str], name: str) -> DataFrame:
    """Adds ``won``: the seats of each item by highest quotients votes / (2k + 1).

    ``seats`` is the number to give in the item's group; ties go to the item
    whose ``name`` comes first.
    """
    w = Window.partitionBy(*group)
    share = F.try_divide("votes", F.sum("votes").over(w))
    base = F.coalesce(F.floor(share * F.col("seats") + 0.5), F.lit(0)).cast("long")
    x = items.withColumn("base", base)
    x = x.withColumn("more", (F.col("seats") - F.sum("base").over(w)).cast("long"))
    # Moving the divisor until the seats add up changes an item by at most its share of (|more| + items), and 1.
    reach = (F.ceil(F.coalesce(share, F.lit(0.0)) * (F.abs("more") + F.count("*").over(w))) + 1).cast("int")
    x = x.withColumn("reach", F.when((F.col("more") == 0) | (F.col("votes") <= 0), 0).when(F.col("more") < 0, F.least(reach, F.col("base").cast("int"))).otherwise(reach))
    step = F.explode(F.when(F.col("reach") > 0, F.sequence(F.lit(1), F.col("reach"))))
    tried = x.where("reach > 0").select(*group, name, "votes", "base", "more", step.alias("k"))
    up = F.col("more") > 0
    quotient = F.when(up, F.col("votes") / (2 * (F.col("base") + F.col("k")) - 1)).otherwise(F.col("votes") / (2 * (F.col("base") - F.col("k")) + 1))
    tried = tried.withColumn("quotient", quotient)
    best = Window.partitionBy(*group).orderBy(F.when(up, -F.col("quotient")).otherwise(F.col("quotient")), F.when(up, F.col(name)).otherwise(-F.col(name)))
    keys = [*group, name]
    moved = tried.withColumn("at", F.row_number().over(best)).where(F.col("at") <= F.abs("more")).groupBy(*[F.col(c).alias(f"moved_{c}") for c in keys]).agg(F.sum(F.signum("more")).cast("long").alias("moved"))
    same = [F.col(c).eqNullSafe(F.col(f"moved_{c}")) for c in keys]
    return x.join(moved, same, "left").select(*items.columns, (F.col("base") + F.coalesce("moved", F.lit(0))).alias("won"))


def quotas(shards: DataFrame) -> DataFrame:
    """Adds ``wanted`` words to source, shard, words, unit, blocks, and makes ``unit`` small enough for the shards.

    A source's shards together want its blocks, or ``CAP`` times its words if that is less.
    """
    source = Window.partitionBy("source")
    x = shards.withColumn("goal", F.least(F.col("blocks") * F.col("unit"), F.sum("words").over(source) * CAP))
    # A shard of fewer than SMALL blocks would be dealt none or too much: smaller blocks for all shards of the source.
    finer = F.greatest(F.lit(1), F.floor(F.sum("words").over(source) / (F.count("*").over(source) * SMALL))).cast("long")
    coarse = (F.count("*").over(source) > 1) & (F.col("unit") > finer)
    x = x.withColumn("coarse", coarse).withColumn("unit", F.when(F.col("coarse"), finer).otherwise(F.col("unit")))
    x = x.withColumn("seats", F.when(F.col("coarse"), F.floor(F.col("goal") / F.col("unit"))).otherwise(F.col("blocks")).cast("long"))
    x = apportion(x.withColumn("votes", F.col("words").cast("double")), ["source"], "shard")
    x = x.withColumn("dealt", F.least(F.col("won") * F.col("unit"), F.col("words") * CAP)).withColumn("room", F.col("words") * CAP - F.col("dealt"))
    # What is missing goes to the shards with room, in proportion to it.
    upto = source.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("missing", F.col("goal") - F.sum("dealt").over(source)).withColumn("all_room", F.sum("room").over(source)).withColumn("room_upto", F.sum("room").over(upto))
    part = "cast({} as decimal(19, 0)) * cast(missing as decimal(19, 0)) div all_room"
    more = F.when((F.col("missing") > 0) & (F.col("all_room") > 0), F.expr(part.format("room_upto")) - F.expr(part.format("(room_upto - room)"))).otherwise(0)
    return x.select("source", "shard", "words", "unit", (F.col("dealt") + more).cast("long").alias("wanted"))


def _draw(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row of ``docs`` (doc_id, text, source)."""
    sizes = written(sized(docs), "sizes")
    return mix_sizes(sizes)


def mix_sizes(sizes: DataFrame, whole: bool = False) -> DataFrame:
    """``mix`` for a table of doc_id, source, size that is cheap to read twice.

    ``whole``: what remains of a quota after whole passes is not dealt in
    blocks but in whole documents in seeded order, to the nearest document.
    """
    goal = written(targets(sizes), "targets")
    shards = F.ceil(F.col("n_rows") / SHARD_ROWS)
    draw = _draw(F.col("doc_id"))
    # One row per source: small, and its size shows in the plan's statistics, so Spark may broadcast it.
    rows = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).select(
        "doc_id", sizes["source"], "size", "source_size", "target", "unit", "blocks", draw.alias("draw"), (F.conv(F.substring(draw, 1, 8), 16, 10).cast("long") % shards).alias("shard")
    )
    quota = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("unit").alias("unit"), F.first("blocks").alias("blocks"), F.count("*").alias("n"))
    quota = quotas(quota)
    quota = quota.withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("wanted") / F.col("words"))).otherwise(0).cast("long"))
    quota = quota.withColumn("rest", F.col("wanted") - F.col("passes") * F.col("words"))

    group = Window.partitionBy("source", "shard")
    seeded_rows = group.orderBy("draw", "size", "doc_id")
    if whole:
        # Another name for each key: both tables come from ``rows``.
        share = quota.select(F.col("source").alias("of"), F.col("shard").alias("part"), "passes", "rest")
        line = rows.join(share, rows["source"].eqNullSafe(share["of"]) & (rows["shard"] == share["part"]))
        left = F.col("rest") - F.coalesce(F.sum("size").over(seeded_rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        taken = (F.col("passes") + F.when(2 * left >= F.col("size"), 1).otherwise(0)) * F.col("size")
        return line.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))

    # Blocks of a shard in seeded order; the first ones add up to the rest.
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("unit"))))
    blocks = quota.where("words > 0").select("source", "shard", "words", "unit", "rest", "passes", block.alias("block"))
    blocks = blocks.withColumn("length", F.least(F.col("unit"), F.col("words") - F.col("block") * F.col("unit")))
    seeded = group.orderBy(_draw(F.col("source"), F.col("shard"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("length").over(seeded), F.lit(0))
    blocks = blocks.withColumn("chosen", F.greatest(F.lit(0), F.least(F.col("length"), F.col("rest") - before)))
    by_place = group.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("chosen_before", F.coalesce(F.sum("chosen").over(by_place), F.lit(0)))

    # Documents and blocks by the word at which they start; a document takes
    # the chosen words between its start and the next document's.
    start = F.sum("size").over(seeded_rows.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.select("source", "shard", "doc_id", "size", "source_size", "target", F.coalesce(start, F.lit(0)).alias("at"), F.row_number().over(seeded_rows).alias("nr"))
    line = placed.unionByName(
        blocks.select("source", "shard", (F.col("block") * F.col("unit")).alias("at"), F.lit(0).alias("nr"), F.struct((F.col("block") * F.col("unit")).alias("at"), "chosen", "chosen_before", "passes", "rest").alias("b")),
        allowMissingColumns=True,
    )
    upto = group.orderBy("at", "nr").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("b", F.last("b", ignorenulls=True).over(upto))
    line = line.withColumn("taken_before", F.col("b.chosen_before") + F.least(F.col("b.chosen"), F.col("at") - F.col("b.at"))).where("nr > 0")
    following = F.coalesce(F.lead("taken_before").over(group.orderBy("nr")), F.col("b.rest"))
    taken = F.when(F.col("size") > 0, F.col("b.passes") * F.col("size") + following - F.col("taken_before")).otherwise(0)
    return line.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document, whole, as often as it is taken.

    Documents of equal id, source and text are taken equally often.  A null
    text or one without words is never taken; columns of any name are kept.
    """
    names = [*docs.columns]
    own = []
    for name in ("key", "id", "of", "part", "times", "nr"):  # no column of ``docs`` is touched
        own.append(fresh(name, names))
        names.append(own[-1])
    key, id_, of, part, times, nr = own
    keyed = docs.withColumn(key, F.xxhash64("text"))
    # Equal rows count as one document of their joint size while words are dealt.
    merged = sized(docs, "doc_id", "text", "source", F.xxhash64(docs["text"]).alias("key")).groupBy("doc_id", "source", "key").agg(F.sum("size").alias("size"))
    unit = written(merged.select(F.to_json(F.struct("doc_id", "key"), {"ignoreNullFields": "false"}).alias("doc_id"), "source", "size"), "units")
    dealt = mix_sizes(unit, whole=True)
    dealt = dealt.withColumn("d", F.from_json("doc_id", "doc_id long, key long"))
    dealt = dealt.where("taken > 0").select(F.col("d.doc_id").alias(id_), F.col("source").alias(of), F.col("d.key").alias(part), F.floor(F.col("taken") / F.col("size")).cast("int").alias(times))
    joined = keyed.join(dealt, keyed["doc_id"].eqNullSafe(dealt[id_]) & keyed["source"].eqNullSafe(dealt[of]) & (keyed[key] == dealt[part]))
    return joined.withColumn(nr, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


def sql(shard_rows: int) -> str:
    """The mix of ``documents`` in SQL, by ranking all quotients and enumerating all blocks."""
    return f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
a AS (SELECT source, count(*) AS n_rows, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE C ASC NULLS LAST) AS place FROM s GROUP BY source),
b AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 2 * source_size AS most, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total FROM a),
c AS (SELECT *, most::DOUBLE / weight AS q,
        (total - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
        / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM b),
f AS (SELECT q AS fq, place AS fplace, level AS flevel FROM c WHERE most > weight * level ORDER BY q, place LIMIT 1),
t AS (SELECT c.*, CASE WHEN fq IS NOT NULL AND (q > fq OR q = fq AND place >= fplace) THEN weight * flevel ELSE most::DOUBLE END AS target FROM c LEFT JOIN f ON true),
u AS (SELECT *, greatest(1, floor((SELECT min(target) FROM t WHERE target > 0) / 64), ceil(total / 2000000))::BIGINT AS block FROM t),
v AS (SELECT *, target < block * 8 AS small, CASE WHEN target < block * 8 THEN greatest(1, floor(target / 64))::BIGINT ELSE block END AS unit FROM u),
seats AS (SELECT floor(coalesce(sum(target), 0) / any_value(block) + 0.5)::BIGINT AS n FROM v WHERE NOT small),
won AS (
  SELECT place, count(*) AS won FROM (
    SELECT place, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, place) AS pos
    FROM (SELECT place, target, unnest(range(1, (SELECT n FROM seats) + 1)) AS k FROM v WHERE NOT small AND target > 0)) WHERE pos <= (SELECT n FROM seats) GROUP BY place),
g AS (SELECT v.*, CASE WHEN small THEN floor(target / unit + 0.5) ELSE coalesce(won, 0) END::BIGINT AS blocks FROM v LEFT JOIN won USING (place)),
r AS (SELECT s.doc_id, g.place, g.source, s.size, g.source_size, g.target, g.unit, g.blocks, md5('{SEED}|' || coalesce(s.doc_id::VARCHAR, 'null')) AS draw,
        ('0x' || substr(md5('{SEED}|' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % ceil(g.n_rows / {shard_rows}.0)::BIGINT AS shard
      FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
h0 AS (SELECT place, any_value(source) AS source, shard, sum(size)::BIGINT AS words, any_value(unit) AS unit, any_value(blocks) AS blocks FROM r GROUP BY place, shard),
h1 AS (SELECT *, least(blocks * unit, 2 * sum(words) OVER q)::BIGINT AS goal, greatest(1, floor(sum(words) OVER q / (count(*) OVER q * 8)))::BIGINT AS finer, count(*) OVER q AS n FROM h0 WINDOW q AS (PARTITION BY place)),
h AS (SELECT place, source, shard, words, goal, CASE WHEN n > 1 AND unit > finer THEN finer ELSE unit END AS unit, CASE WHEN n > 1 AND unit > finer THEN goal // finer ELSE blocks END AS seats FROM h1),
hw AS (
  SELECT place, shard, count(*) AS won FROM (
    SELECT place, shard, seats, row_number() OVER (PARTITION BY place ORDER BY words::DOUBLE / (2 * k - 1) DESC, shard) AS pos
    FROM (SELECT place, shard, seats, words, unnest(range(1, seats + 1)) AS k FROM h WHERE words > 0)) WHERE pos <= seats GROUP BY place, shard),
i0 AS (SELECT h.*, least(coalesce(won, 0) * unit, 2 * words)::HUGEINT AS dealt FROM h LEFT JOIN hw USING (place, shard)),
i1 AS (SELECT *, goal - sum(dealt) OVER q AS missing, sum(2 * words - dealt) OVER q AS room, sum(2 * words - dealt) OVER (PARTITION BY place ORDER BY shard) AS upto FROM i0 WINDOW q AS (PARTITION BY place)),
i AS (SELECT *, (dealt + CASE WHEN missing > 0 AND room > 0 THEN upto * missing // room - (upto - 2 * words + dealt) * missing // room ELSE 0 END)::BIGINT AS wanted FROM i1),
j AS (SELECT *, CASE WHEN words > 0 THEN wanted // words ELSE 0 END AS passes FROM i),
k AS (SELECT *, wanted - passes * words AS rest FROM j),
bl AS (SELECT *, least(unit, words - block * unit) AS length FROM (SELECT *, unnest(range(0, (words - 1) // unit + 1)) AS block FROM k WHERE words > 0)),
bc AS (SELECT *, greatest(0, least(length, rest - coalesce(sum(length) OVER (PARTITION BY place, shard ORDER BY md5('{SEED}|' || coalesce(source, 'null') || '|' || shard || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS chosen FROM bl),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY place, shard ORDER BY draw, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, row_number() OVER () AS id FROM r),
o AS (SELECT p.id, sum(greatest(0, least(p.pos + p.size, bc.block * bc.unit + bc.chosen) - greatest(p.pos, bc.block * bc.unit))) AS extra
      FROM p JOIN bc ON p.place = bc.place AND p.shard = bc.shard AND bc.block BETWEEN p.pos // bc.unit AND (p.pos + p.size) // bc.unit GROUP BY p.id)
SELECT p.doc_id, p.size::BIGINT AS size, p.source_size, p.target, CASE WHEN p.size > 0 THEN k.passes * p.size + coalesce(o.extra, 0) ELSE 0 END::BIGINT AS taken
FROM p LEFT JOIN o USING (id) LEFT JOIN k ON k.place = p.place AND k.shard = p.shard
"""


SQL = sql(SHARD_ROWS)
