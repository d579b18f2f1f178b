"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (equal role and text) is rendered once as
the prompt; what follows is rendered as the chosen and the rejected completion.
Masks are the spans (code points, counted from the start of prompt +
completion) that a loss may look at: the texts of assistant turns of the
completion.  Prompts are masked whole.

Only DataFrame functions are used; a conversation is gathered once, by its id.

Null roles and texts render as empty, but are equal only to nulls.  Turns are
ordered by turn number (null first), then role and text, so repeated turns keep
a fixed order.  A pair that lacks one side has an empty prompt and an empty
completion for it; a pair whose conversations are equal has two empty
completions.  Conversations without id are in no pair.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The turn layout: opening, role, line break, text, closing.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    turn = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    return conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _text(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit("\n"), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _render(list_: Column) -> Column:
    return F.array_join(F.transform(list_, _text), "")


def _spans(list_: Column, start: Column) -> Column:
    """start:end of each assistant text, comma-joined."""

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + len(OPEN) + F.length(F.coalesce(turn["role"], F.lit(""))) + 1
        end = begin + F.length(F.coalesce(turn["text"], F.lit("")))
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        found = F.when(turn["role"] == ASSISTANT, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct((end + len(CLOSE)).alias("at"), found.alias("found"))

    zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(list_, zero, step, lambda s: F.array_join(s["found"], ","))


def format_preferences(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per row of ``pairs`` (pair_id, chosen_id, rejected_id)."""
    told = turns(conversations)
    chosen = told.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c"))
    rejected = told.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r"))
    return rendered(pairs.join(chosen, "chosen_id", "left").join(rejected, "rejected_id", "left"))


def rendered(both: DataFrame) -> DataFrame:
    """Prompt, completions and masks of rows with turns ``c`` and ``r``."""
    none = F.array().cast("array<struct<turn: bigint, role: string, text: string>>")
    shape = "array<struct<turn: bigint, role: string, text: string>>"
    x = both.withColumn("c", F.coalesce(F.col("c").cast(shape), none)).withColumn("r", F.coalesce(F.col("r").cast(shape), none))
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), least), F.slice("r", F.lit(1), least), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    at = F.array_position(same, False)
    x = x.withColumn("n_common", F.when(at > 0, at - 1).otherwise(least).cast("int"))
    x = x.withColumn("prompt", _render(F.slice("c", F.lit(1), F.col("n_common"))))
    for side in ("c", "r"):
        rest = F.slice(side, F.col("n_common") + 1, F.greatest(F.lit(0), F.size(side) - F.col("n_common")))
        x = x.withColumn(f"{side}_rest", rest)
    return x.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_prompt_turns"),
        "prompt",
        _render(F.col("c_rest")).alias("chosen"),
        _render(F.col("r_rest")).alias("rejected"),
        _spans(F.col("c_rest"), F.length("prompt")).alias("chosen_spans"),
        _spans(F.col("r_rest"), F.length("prompt")).alias("rejected_spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring conversations as pairs: the even id is chosen, the next one rejected.

    Both sides of a pair are gathered by the same key, so there is one shuffle.
    """
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id IS NOT NULL")
    turn = F.struct("turn", "role", "text")
    odd = F.pmod("conv_id", F.lit(2)) == 1
    both = told.groupBy(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id")).agg(F.sort_array(F.collect_list(F.when(~odd, turn))).alias("c"), F.sort_array(F.collect_list(F.when(odd, turn))).alias("r"))
    return rendered(both)


SQL = """
WITH t AS (
  SELECT (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, conv_id % 2 <> 0 AS odd, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nr
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT * FROM t WHERE NOT odd),
r AS (SELECT * FROM t WHERE odd),
n AS (
  SELECT p.pair_id, coalesce(min(d.nr) - 1, least((SELECT count(*) FROM c WHERE c.pair_id = p.pair_id), (SELECT count(*) FROM r WHERE r.pair_id = p.pair_id))) AS n
  FROM (SELECT DISTINCT pair_id FROM t) p
  LEFT JOIN (SELECT pair_id, nr FROM c JOIN r USING (pair_id, nr) WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) d USING (pair_id)
  GROUP BY p.pair_id),
x AS (
  SELECT pair_id, odd, nr, n, role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line,
         length(coalesce(role, '')) + 13 AS head, length(coalesce(text, '')) AS body
  FROM t JOIN n USING (pair_id)),
y AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY pair_id, odd ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head AS s FROM x)
SELECT pair_id, any_value(n)::BIGINT AS n_prompt_turns,
       coalesce(string_agg(line, '' ORDER BY nr) FILTER (nr <= n AND NOT odd), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY nr) FILTER (nr > n AND NOT odd), '') AS chosen,
       coalesce(string_agg(line, '' ORDER BY nr) FILTER (nr > n AND odd), '') AS rejected,
       coalesce(string_agg(s::BIGINT || ':' || (s + body)::BIGINT, ',' ORDER BY nr) FILTER (nr > n AND NOT odd AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(s::BIGINT || ':' || (s + body)::BIGINT, ',' ORDER BY nr) FILTER (nr > n AND odd AND role = 'assistant'), '') AS rejected_spans
FROM y GROUP BY pair_id
"""
