"""URL filter: host rules, and gradient-boosted trees for what they leave open.

Rules name a host and a path; a rule fits its host and all subdomains where the
URL's path starts with the rule's, and of several the longest wins.  URLs that a
rule decides are the labelled ones.  A boosted ensemble (Spark ML's
``GBTClassifier``) learns from their lexical features: length, depth of host and
path, share of digits, entropy of the characters, number of query parameters,
and suffix statistics, which are the smoothed share of blocked URLs among the
labelled ones that end in the same host labels or the same file extension, or
share the top folder.  A labelled URL's own statistics leave out its fold, so
that no label is its own feature.

The model learns from at most about ``SAMPLE`` distinct labelled URLs, chosen by
hash; its tables of statistics have ``SUFFIXES`` entries a URL at most, so they
are small by construction and joined by broadcast.  Everything else, rules,
features and verdicts, covers every row, in a narrow plan of column expressions:
nothing is shuffled but the sample, and a URL that many rows share is one row
of it.  Without any labelled URL all others are allowed; if all labelled ones
have one verdict, all others get it.

A null URL, or one without ``://``, has an empty host and path; it is judged by
the features of the empty text.  Repeated rows get equal results, an empty table
gives an empty result, and other columns are neither read nor returned.  Very
long URLs are handled whole; characters beyond ASCII count as one in the entropy,
so its cost grows in proportion to the length.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import bound
from .shared import written

#: (verdict, host, path); fixed by the query's contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Distinct labelled URLs to learn from, about; and for each the suffixes that have statistics, at most.
SAMPLE = 50_000
SUFFIXES = 5
FOLDS = 5
#: URLs that a suffix is taken to have had beside the seen ones, with the mean verdict.
PRIOR = 8.0
TREES = 20
DEPTH = 4
SEED = 11

#: The kinds of suffix, as SQL over host and path.
KINDS = {
    "host1": "element_at(split(host, '[.]'), -1)",
    "host2": "array_join(slice(split(host, '[.]'), -least(2, size(split(host, '[.]'))), 2), '.')",
    "host3": "array_join(slice(split(host, '[.]'), -least(3, size(split(host, '[.]'))), 3), '.')",
    "extension": r"lower(regexp_extract(path, '[.]([A-Za-z0-9]{1,8})$', 1))",
    "folder": "regexp_extract(path, '^/([^/]*)/', 1)",
}
LEXICAL = ("length", "host_length", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio", "entropy", "n_parameters", "fragment_length")
FEATURES = [*LEXICAL, *KINDS]


def host(url: str = "url") -> Column:
    """What stands between the first ``://`` and the next / ? or #, with A-Z as a-z."""
    return F.expr(f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def path(url: str = "url") -> Column:
    """What follows the host, up to ? or #."""
    return F.expr(f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')")


def longest_rule(rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """Of the rules that fit host and path the longest, as (rule, verdict); NULL if none fits."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, where, begins in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((F.col("host") == where) | F.col("host").endswith(f".{where}")) & F.col("path").startswith(begins)
        out = F.when(fits, F.struct(F.lit(where + begins).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: str) -> str:
    """Bits per character; characters beyond ASCII are one."""
    share = "(char_length(u) - char_length(replace(u, c, ''))) / char_length(u)"
    total = f"aggregate(array_distinct(split(u, '')), 0D, (s, c) -> s + if(c = '', 0D, {bound(share, 'p', '-p * log2(p)')}))"
    return bound(rf"regexp_replace({text}, '[^\\x00-\\x7F]', chr(127))", "u", f"if(u = '', 0D, {total})")


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (with url, host, path) and the features that need no statistics, and the suffixes."""
    plain = "coalesce(url, '')"
    said = {
        "length": f"char_length({plain})",
        "host_length": "char_length(host)",
        "host_depth": "if(host = '', 0, size(split(host, '[.]')))",
        "path_depth": "size(filter(split(path, '/'), x -> x <> ''))",
        "digit_ratio": f"char_length(regexp_replace({plain}, '[^0-9]', '')) / greatest(1, char_length({plain}))",
        "host_digit_ratio": "char_length(regexp_replace(host, '[^0-9]', '')) / greatest(1, char_length(host))",
        "entropy": _entropy(plain),
        "n_parameters": rf"size(filter(split(regexp_extract({plain}, '(?s)^[^?#]*[?]([^#]*)', 1), '[&;]'), x -> x <> ''))",
        "fragment_length": f"greatest(0, char_length({plain}) - if(locate('#', {plain}) = 0, char_length({plain}), locate('#', {plain})))",
    }
    suffixes = F.array(*[F.expr(sql).alias(k) for k, sql in KINDS.items()])
    return urls.select("*", *[F.expr(sql).cast("double").alias(k) for k, sql in said.items()], suffixes.alias("suffixes"))


class UrlModel:
    """Statistics of suffixes and an ensemble over them, learnt from labelled URLs."""

    def __init__(self, statistics: DataFrame, mean: float, ensemble: Model | None):
        self._statistics, self._mean, self._ensemble = statistics, mean, ensemble

    @classmethod
    def fit(cls, labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
        """``labelled``: url, host, path, blocked (boolean)."""
        own = labelled.select("url", "host", "path", F.col("blocked").cast("double").alias("label"))
        there = own.agg(F.approx_count_distinct("url", 0.02)).first()[0]
        if there > sample:
            own = own.where(F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(1 << 30)) < int(sample / there * (1 << 30)))
        one = own.groupBy("url").agg(*[F.max(c).alias(c) for c in ("host", "path", "label")])
        learnt = written(one, "urls", rows=2 * sample).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
        n, blocked = learnt.agg(F.count("*"), F.sum("label")).first()
        mean = (blocked or 0.0) / n if n else 0.0
        marked = lexical(learnt)
        pairs = marked.select("label", "fold", F.posexplode("suffixes").alias("kind", "suffix"))
        by_fold = pairs.groupBy("kind", "suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
        statistics = written(by_fold, "suffixes", rows=SUFFIXES * FOLDS * sample)
        if mean in (0.0, 1.0):
            return cls(statistics, mean, None)
        model = cls(statistics, mean, None)
        trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64)
        ready = model._vectors(marked.coalesce(8), out_of_fold=True).select("label", "features")
        model._ensemble = trees.fit(ready)
        return model

    def _vectors(self, marked: DataFrame, out_of_fold: bool = False) -> DataFrame:
        """``marked`` (of ``lexical``) with all features as one vector."""
        totals = self._statistics.groupBy("kind", "suffix").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
        if out_of_fold:
            own = self._statistics.select("kind", "suffix", F.col("n").alias("own_n"), F.col("blocked").alias("own_blocked"), "fold")
            totals = totals.join(own, ["kind", "suffix"]).select("kind", "suffix", "fold", (F.col("n") - F.col("own_n")).alias("n"), (F.col("blocked") - F.col("own_blocked")).alias("blocked"))
        share = ((F.col("blocked") + F.lit(PRIOR * self._mean)) / (F.col("n") + F.lit(PRIOR))).alias("share")
        shares = totals.select(*[c for c in totals.columns if c not in ("n", "blocked")], share)
        out = marked
        for k, name in enumerate(KINDS):
            keys = ["fold"] if out_of_fold else []
            table = shares.where(F.col("kind") == k).select("suffix", *keys, F.col("share").alias(name))
            out = out.withColumn("suffix", F.col("suffixes")[k]).join(F.broadcast(table), ["suffix", *keys], "left").drop("suffix")
        filled = out.withColumns({name: F.coalesce(name, F.lit(self._mean)) for name in KINDS})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(filled)

    def score(self, urls: DataFrame) -> DataFrame:
        """``urls`` (url, host, path, ...) with score, the probability that the URL is to be blocked."""
        if self._ensemble is None:
            return urls.withColumn("score", F.lit(self._mean))
        judged = self._ensemble.transform(self._vectors(lexical(urls)))
        return judged.select(*urls.columns, vector_to_array("probability")[1].alias("score"))


def judged(urls: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of each row."""
    own = urls.select(urls[id_col].cast("long").alias("page_id"), urls[url_col].cast("string").alias("url"))
    read = own.withColumn("host", host()).withColumn("path", path()).withColumn("ruled", longest_rule(rules))
    labelled = read.where("ruled IS NOT NULL").select("url", "host", "path", (F.col("ruled.verdict") == "block").alias("blocked"))
    scored = UrlModel.fit(labelled, sample).score(read)
    verdict = F.coalesce("ruled.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
