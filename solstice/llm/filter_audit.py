"""What each filter of a chain removes, in every order, from one histogram of failure masks."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, table

WORDS = r"[^\x20\x09-\x0D]+"
#: The filters in the order of their bits. E (copies) needs the whole table, the others one text.
FILTERS = "ABCDE"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: whether a text (not null) fails A (under 100 words), B (under 80 % distinct words), C (over 10 % capitals), D (a forbidden character)."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    # In an array of one, so that the words are found once.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    bits = F.transform(F.array(counts), lambda c: F.when(c["n"] < 100, 1).otherwise(0) + F.when(100 * c["distinct"].cast("long") < 80 * c["n"].cast("long"), 2).otherwise(0))[0]
    return bits + F.when(100 * capitals.cast("long") > 10 * F.char_length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per row of docs: id, part, mask: bit k is set if the row fails filter k of FILTERS.

    A text that equals the text of any smaller id fails E; texts are compared by 128-bit hashes and lengths. Null texts are
    empty, null parts ''. A row without an id is no copy and makes none; rows of the same id and text don't make each other copies.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_mask(text).cast("int").alias("mask"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.octet_length(text).alias("size"),
    )
    rows = materialize(rows, "filter-masks")
    key = ["k1", "k2", "size"]
    # Only texts that several ids have; a table of its own, so that the join can split one that very many rows have.
    first = rows.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    out = rows.join(materialize(first, "first-copies"), key, "left")
    copy = F.when(F.col("id") > F.col("first"), 16).otherwise(0)
    return out.select("id", "part", (F.col("mask") + copy).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part. rows: id, part, mask. Of several labels of an id any counts."""
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = rows.join(materialize(marks.where("good = 1 or bad = 1"), "filter-labels"), "id", "left")
    count = lambda name: F.sum(F.coalesce(name, F.lit(0)).cast("long"))
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good").alias("good"), count("bad").alias("toxic"))


def interactions(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: what the histogram of cells says; zeros included."""
    orders = [(order, step + 1, 1 << filters.index(order[step]), sum(1 << filters.index(x) for x in order[:step])) for order in map("".join, permutations(filters)) for step in range(len(filters))]
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(m).alias("before")) for o, s, b, m in orders])
    rows = found.select("*", F.explode(steps).alias("o")).select("part", "mask", "n", "good", "toxic", "o.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).cast("long")
    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, each of the 120 orders of the five filters, and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One pass gives each row its mask of failed filters, one aggregation 32 cells a part; all orders are worked out from the cells.

    Null and empty texts have no words: they fail A only, and E if a smaller id has one. See masks() for null and repeated ids.
    Labels of unknown documents are ignored, null labels are not 1. Null parts are the part ''. No rows give no rows. Other columns are ignored.
    """
    return interactions(materialize(cells(masks(docs, id_col, text_col, part_col), labels, id_col), "filter-cells", narrow=True))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = rf"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORDS}') as w from documents),
firsts as (select text, min(doc_id) as first_id from t group by text),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
m as (
    select part, coalesce(good, 0) as good, coalesce(bad, 0) as bad,
           case when len(w) < 100 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
           + case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) then 4 else 0 end
           + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when t.doc_id > first_id then 16 else 0 end as mask
    from t join firsts using (text) left join marks using (doc_id)
), f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
    select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e
    where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps as (select filter_order, s as step, bits[s] as bit, coalesce(list_sum(bits[1 : s - 1]), 0)::bigint as before from orders, unnest(range(1, 6)) as u(s)),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(bad) as bad from m group by part, mask),
r as (
    select part, filter_order, step, bit, sum(case when mask & (before | bit) = 0 then n else 0 end)::bigint as kept,
           sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end)::bigint as removed,
           sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end)::bigint as redundant,
           sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
           sum(case when mask & bit > 0 and mask & before = 0 then good else 0 end)::bigint as good_lost,
           sum(case when mask & bit > 0 and mask & before = 0 then bad else 0 end)::bigint as toxic_lost
    from cells, steps group by all
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r
"""
