"""URL filters: host and path rules, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower

#: (verdict, host and path) of the production rules.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: At most so many URLs of each label teach the model; those of the smallest hash.
PER_LABEL = 2000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null URL or one without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def match_rules(host: Column, path: Column, rules=RULES) -> Column:
    """struct<n, rule, verdict> of the longest rule that fits, or null.

    A rule fits its host and all subdomains where the path begins with the
    rule's. Of rules of one length the last by text wins. The rules are part of
    the expression: they are a list in the program, not a table.
    """

    def one(verdict, rule):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        return F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))

    found = [one(*x) for x in rules]
    return F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def char_grams(host: Column, path: Column, sizes=(3, 4, 5)) -> Column:
    """The character n-grams of host and path, marked by where they come from; host and path have ends."""

    def grams(mark, text, n):
        text = F.concat(F.lit("^"), text, F.lit("$"))
        at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    return F.concat(*[grams(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in sizes])


@dataclass
class UrlModel:
    """A fitted model, or the one verdict that all its labelled URLs had."""

    hasher: HashingTF
    model: LogisticRegressionModel | None
    only: str

    def score(self, df: DataFrame, grams: Column) -> DataFrame:
        """df with block_score, 0 to 1."""
        if self.model is None:
            return df.withColumn("block_score", F.lit(1.0 if self.only == "block" else 0.0))
        out = self.model.transform(self.hasher.transform(df.withColumn("grams", grams)))
        return out.withColumn("block_score", vector_to_array("probability")[1]).select(*df.columns, "block_score")


def train(labelled: DataFrame, per_label: int = PER_LABEL, features: int = 1 << 16) -> UrlModel:
    """Fits on the distinct rows of labelled (host, path, verdict: allow or block).

    Of each verdict the per_label rows with the smallest hash of host and path are used: a
    bounded sample, as the model is small. Without any row the model allows;
    with one verdict only it gives that.
    """
    order = F.xxhash64("host", "path")
    some = [labelled.where(F.col("verdict") == x).select("host", "path", "verdict").distinct().orderBy(order, "host", "path").limit(per_label) for x in ("allow", "block")]
    rows = some[0].unionByName(some[1]).withColumn("label", (F.col("verdict") == "block").cast("double"))
    hasher = HashingTF(numFeatures=features, binary=True, inputCol="grams", outputCol="features")
    rows = hasher.transform(rows.withColumn("grams", char_grams(F.col("host"), F.col("path")))).select("features", "label").repartition(2).persist()
    try:
        seen = sorted(x.label for x in rows.select("label").distinct().collect())
        if len(seen) < 2:
            return UrlModel(hasher, None, "block" if seen == [1.0] else "allow")
        model = LogisticRegression(maxIter=25, regParam=0.01, standardization=False, tol=1e-4).fit(rows)
        return UrlModel(hasher, model, "")
    finally:
        rows.unpersist()


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per row of pages: its id, host, path, rule, verdict, block_score.

    verdict is the longest fitting rule's, else `block` where the model's
    block_score is at least 0.5, else `allow`. labelled (host, path, verdict)
    teaches the model; without it the URLs that a rule judges do.

    Null URLs and URLs without `://` have empty host and path and are judged by the
    model. Repeated rows are each returned. No rows give no rows. Other columns are
    ignored, whatever their names.
    """
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("hit", match_rules(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = urls.where("hit is not null").select("host", "path", "hit.verdict")
    scored = train(labelled).score(urls, char_grams(F.col("host"), F.col("path")))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "block_score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("block_score")
