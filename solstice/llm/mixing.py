"""Mixing sources to target weights by hierarchical token budgets (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

WORDS = r"[^\x20\x09-\x0D]+"
#: Rows of a leaf that a bucket of its order has at most on average, if the leaf had all rows.
BUCKET_ROWS = 10_000


def source_domain(source: Column) -> Column:
    """The domain of a source, by the last digit of its name; `other` without one."""
    digit = F.right(source, F.lit(1))
    return (
        F.when(digit.isin("0", "4", "8"), "web")
        .when(digit.isin("1", "5", "9"), "books")
        .when(digit.isin("2", "6"), "code")
        .when(digit.isin("3", "7"), "forum")
        .otherwise("other")
    )


#: Target weights for each level of the tree; what is not named has weight 1.
LEVELS = {
    "domain": {"web": 4, "books": 3, "code": 2, "forum": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 1},
    "source": {},
}


def _weight(level: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for value, weight in weights.items():
        out = F.when(F.col(level) == value, weight).otherwise(out)
    return out.cast("long")


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Divides each parent's budget among its children by weight, none getting more than its cap.

    nodes: the columns parents, name, weight, cap and budget (the parent's, the
    same on all its children, at most the sum of their caps). Adds `share`. What a
    child can't use goes to its siblings by their weights. In the order of cap by
    weight the children that get their whole cap come first, so running sums
    decide each child: it is full if its cap is at most its part of what the
    ones before leave. The rest is divided in whole tokens that add up exactly.
    """
    order = W.partitionBy(*parents).orderBy(F.col("cap") / F.greatest("weight", F.lit(1)), name)
    whole, before = W.partitionBy(*parents), order.rowsBetween(W.unboundedPreceding, -1)
    wide = lambda x: x.cast("decimal(19,0)")  # noqa: E731  products of tokens and sums of weights don't fit a long
    zero = F.lit(0).cast("long")
    nodes = nodes.withColumns({"gone": F.coalesce(F.sum("cap").over(before), zero), "behind": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)})
    nodes = nodes.withColumn("full", wide(F.col("cap")) * wide(F.col("behind")) <= wide(F.col("budget") - F.col("gone")) * wide(F.col("weight")))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)
    open_weight = F.when(F.col("full"), 0).otherwise(F.col("weight"))
    nodes = nodes.withColumns({"rest": wide(rest), "open_sum": wide(F.sum(open_weight).over(whole)), "upto": F.sum(open_weight).over(order.rowsBetween(W.unboundedPreceding, 0))})
    part = F.expr("(rest * cast(upto as decimal(19,0))) div nullif(open_sum, 0) - (rest * cast(upto - weight as decimal(19,0))) div nullif(open_sum, 0)")
    return nodes.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("full", "rest", "open_sum", "upto", "gone", "behind")


def budgets(leaves: DataFrame, levels: dict[str, dict[str, int]], share: float, max_epochs: int) -> DataFrame:
    """leaves (the level columns, tokens) with `share`: the tokens to take from each.

    The root's budget is `share` of all tokens. A node can give max_epochs times
    its tokens, nothing at weight 0. Filling from the root down, with each
    subtree's sum as its cap, moves a shortage to siblings first; only what a
    whole subtree can't give goes to the siblings of its ancestor.
    """
    names = list(levels)
    tree = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    for k, name in enumerate(names):
        tree = tree.withColumn(f"w{k}", _weight(name, levels[name]))
    alive = F.lit(True)
    for k in range(len(names)):
        alive = alive & (F.col(f"w{k}") > 0)
    tree = tree.withColumn("cap", F.when(alive, F.col("cap")).otherwise(0))
    tree = tree.withColumn("root", F.lit(0))
    total = W.partitionBy("root")
    budget = F.least(F.floor(F.sum("tokens").over(total) * share).cast("long"), F.sum("cap").over(total))
    tree = tree.withColumn("budget", budget)
    for k, name in enumerate(names):
        above = ["root", *names[:k]]
        nodes = tree.groupBy(*above, name).agg(F.sum("cap").alias("cap"), F.first(f"w{k}").alias("weight"), F.first("budget").alias("budget"))
        filled = fill(nodes, above, name).select(*above, name, F.col("share").alias("budget"))
        tree = tree.drop("budget").join(filled, [*above, name])
    return tree.select(*names, "tokens", F.col("budget").alias("share"))


def mix(
    docs: DataFrame, levels: dict[str, dict[str, int]] | None = None, id_col: str = "doc_id", tokens: Column | None = None,
    share: float = 0.6, max_epochs: int = 2, seed: int = 11, keep: list[str] | None = None,
) -> DataFrame:
    """Per row of docs: its id, the columns in keep, the level columns, n_tokens, and copies: how often the mix takes it.

    levels: columns of docs from the root down, each with the weights of its
    values (whole numbers; 1 where not named). tokens: the size of a row, words by
    default. Each leaf's budget is whole epochs over all its rows, then a prefix of
    one more: in the order of md5(seed:epoch:id), the rows that begin within the
    tokens left to take, so a leaf exceeds its budget by less than one row.

    Nulls in a level column are a value of their own, ''; a null id orders as ''.
    Null and empty texts have no tokens: they come with whole epochs and, inside
    the prefix, with their neighbours. Repeated rows are rows of their own; ties
    in the order go by n_tokens. A leaf without tokens gets nothing. No rows give
    no rows. Other columns are ignored.

    A leaf of any size is ordered in parallel: buckets by the first digits
    of the key, more of them the more rows there are, are added up, and only rows of the bucket in which the budget ends
    are sorted.
    """
    levels = LEVELS if levels is None else levels
    names, keep = list(levels), keep or []
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)) if tokens is None else tokens, F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in names], size.alias("n_tokens"))
    rows = materialize(rows, "mix-rows")
    digits = 1  # hexadecimal, of the order key: they name a bucket
    n = rows.count()
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    leaves = budgets(leaves, levels, share, max_epochs)
    leaves = leaves.select(
        *names,
        F.expr("coalesce(share div nullif(tokens, 0), 0)").alias("epochs"),
        F.expr("coalesce(share % nullif(tokens, 0), 0)").alias("rest"),
    )
    leaves = materialize(leaves, "mix-leaves")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = rows.join(leaves, names).withColumn("key", key).withColumn("bucket", F.left(key, F.lit(digits)))
    upto = W.partitionBy(*names).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ends = (
        keyed.groupBy(*names, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
        .where("rest > 0 and upto >= rest and upto - n < rest")
        .select(*names, F.col("bucket").alias("last"), (F.col("upto") - F.col("n")).alias("before"))
    )
    # of several buckets that end exactly at the budget the first is meant; the others begin at it
    keyed = keyed.join(materialize(ends, "mix-ends"), names, "left")
    inside = keyed.where("bucket = last")
    running = W.partitionBy(*names).orderBy("key", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    begins = F.col("before") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0))
    inside = inside.withColumn("taken", (begins < F.col("rest")).cast("long"))
    outside = keyed.where("last is null or bucket <> last").withColumn("taken", F.coalesce(F.col("bucket") < F.col("last"), F.lit(False)).cast("long"))
    out = outside.unionByName(inside)
    return out.select("doc_id", *keep, *names, "n_tokens", (F.col("epochs") + F.col("taken")).alias("copies"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.withColumn("domain", source_domain(F.col("source"))))


def _fill_sql(name: str, nodes: str, parents: str) -> str:
    """fill() as common table expressions: {name} has parents, the child's name k, and share."""
    return f"""
{name}_a as (
    select *, cap * sum(weight) over (o rows between current row and unbounded following)
              <= (budget - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) * weight as is_full
    from {nodes} window o as (partition by {parents} order by cap / greatest(weight, 1), k)
), {name}_b as (
    select *, budget - sum(case when is_full then cap else 0 end) over (partition by {parents}) as rest,
           sum(case when is_full then 0 else weight end) over (partition by {parents}) as open_sum,
           sum(case when is_full then 0 else weight end)
               over (partition by {parents} order by cap / greatest(weight, 1), k rows unbounded preceding) as up_to
    from {name}_a
), {name} as (
    select *, case when is_full then cap else (rest * up_to) // open_sum - (rest * (up_to - weight)) // open_sum end as part
    from {name}_b
)"""


OP3_SQL = rf"""
with docs as (
    select doc_id, case when right(source, 1) in ('0', '4', '8') then 'web' when right(source, 1) in ('1', '5', '9') then 'books'
                        when right(source, 1) in ('2', '6') then 'code' when right(source, 1) in ('3', '7') then 'forum' else 'other' end as domain,
           coalesce(lang, '') as lang, coalesce(source, '') as source,
           coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) as n_tokens
    from documents
), leaves as (
    select domain, lang, source, sum(n_tokens)::hugeint as tokens, 0 as root,
           case domain when 'web' then 4 when 'books' then 3 when 'code' then 2 else 1 end as w0,
           case lang when 'en' then 4 when 'de' then 2 when 'fr' then 2 else 1 end as w1, 1 as w2
    from docs group by all
), n0 as (
    select root, domain as k, w0 as weight, sum(2 * tokens) as cap,
           (select least(floor(sum(tokens)::bigint * 0.6::double)::bigint, sum(2 * tokens)) from leaves) as budget
    from leaves group by root, domain, w0
), {_fill_sql("f0", "n0", "root")}, n1 as (
    select l.domain, l.lang as k, l.w1 as weight, sum(2 * l.tokens) as cap, any_value(f.part) as budget
    from leaves l join f0 f on l.domain = f.k group by l.domain, l.lang, l.w1
), {_fill_sql("f1", "n1", "domain")}, n2 as (
    select l.domain, l.lang, l.source as k, l.w2 as weight, 2 * l.tokens as cap, f.part as budget, l.tokens
    from leaves l join f1 f on l.domain = f.domain and l.lang = f.k
), {_fill_sql("f2", "n2", "domain, lang")}, leaf as (
    select domain, lang, k as source, coalesce(part // nullif(tokens, 0), 0)::bigint as epochs,
           coalesce(part % nullif(tokens, 0), 0)::bigint as rest from f2
), ordered as (
    select d.*, epochs, rest,
           coalesce(sum(n_tokens) over (partition by domain, lang, source
               order by md5('11:' || epochs || ':' || coalesce(doc_id::varchar, '')), n_tokens
               rows between unbounded preceding and 1 preceding), 0) as begins
    from docs d join leaf using (domain, lang, source)
)
select doc_id, domain, lang, source, n_tokens::bigint as n_tokens, epochs + case when begins < rest then 1 else 0 end as copies from ordered
"""
