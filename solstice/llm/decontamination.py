"""Benchmark decontamination by winnowing: fingerprints of word k-grams, joined and extended (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize, table

#: Words are digits, letters and all that is not ASCII; A-Z is lower-cased before.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window; a shorter item is one window.
WINDOW = 10


def gram_length(length: int) -> int:
    """Words of the k-grams of windows of so many words: half of them, so that neighbouring windows mostly share their minimum."""
    return (length + 1) // 2


def _every(source: str, span: Column | int, value) -> Column:
    """value(i) for each i at which `span` elements of the array column begin; an empty array if it has fewer."""
    n = F.size(source)
    return F.when(n >= span, F.transform(F.sequence(F.lit(0), n - span), value)).otherwise(F.array().cast("array<long>"))


def _grams(k: int) -> Column:
    """The hashes of all k-grams of the word hashes `h`."""
    return _every("h", k, lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(k)]))


def _minima(grams: str, count: int) -> Column:
    """The least of each `count` neighbouring k-gram hashes: a window's fingerprint."""
    if count == 1:
        return F.col(grams)
    return _every(grams, count, lambda i: F.least(*[F.get(grams, i + j) for j in range(count)]))


def hashed_words(text: Column) -> Column:
    """The hashes of a text's words, in order; null has none."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def minima(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows (with `h`) with a column m{length} for each length of windows: the fingerprint of the window that begins at each word."""
    for k in sorted({gram_length(x) for x in lengths}):
        rows = rows.withColumn(f"g{k}", _grams(k))
    for length in lengths:
        k = gram_length(length)
        rows = rows.withColumn(f"m{length}", _minima(f"g{k}", length - k + 1))
    return rows


def windows(rows: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """(keep, start, length, fp, w1, w2): each window of those lengths, its fingerprint and the 128-bit hash of its words. rows: keep, h."""
    def found(length: int) -> Column:
        def window(i):
            part = F.slice("h", i + 1, F.lit(length))
            return F.struct(i.alias("start"), F.lit(length).alias("length"), F.get(f"m{length}", i).alias("fp"), F.xxhash64(part).alias("w1"), F.xxhash64(F.lit(length), part).alias("w2"))

        n = F.size(f"m{length}")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), window)).otherwise(F.array().cast("array<struct<start:int,length:int,fp:bigint,w1:bigint,w2:bigint>>"))

    return minima(rows, lengths).select(*keep, F.explode(F.concat(*map(found, lengths))).alias("w")).select(*keep, "w.*")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """(item, length, fp, w1, w2), each window of each item, and the lengths of windows that occur, at most `words` different ones.

    item is the id as a string; a null id is an item of its own, ''. Rows of one id are one item.
    """
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), hashed_words(F.col(text_col)).alias("h")).withColumn("n", F.least(F.size("h"), F.lit(words))).where("n > 0")
    rows = materialize(rows, "items")
    lengths = sorted(r.n for r in rows.select("n").distinct().collect())
    found = [windows(rows.where(F.col("n") == x), [x], "item").drop("start") for x in lengths]
    if not found:
        return items.sparkSession.createDataFrame([], "item string, length int, fp long, w1 long, w2 long"), []
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialize(out.distinct(), "item-windows"), lengths


def item_sets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups windows that the same items have.

    Returns (w1, w2, r1, r2), each window's representative among those with the same items, and (r1, r2, item). Sets of items are compared by their
    number and sums of two hashes, so none is gathered.
    """
    pair = found.select("w1", "w2", "item").distinct()
    number = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(20,0)"))
    sets = pair.groupBy("w1", "w2").agg(F.count("*").alias("n"), number("item").alias("s1"), number(F.lit(1), "item").alias("s2"))
    sets = materialize(sets, "window-item-sums")
    least = sets.groupBy("n", "s1", "s2").agg(F.min(F.struct("w1", "w2")).alias("r"))
    names = materialize(sets.join(least, ["n", "s1", "s2"]).select("w1", "w2", F.col("r.w1").alias("r1"), F.col("r.w2").alias("r2")), "window-sets")
    members = pair.join(names.where("w1 = r1 and w2 = r2"), ["w1", "w2"]).select("r1", "r2", "item")
    return names, materialize(members, "window-items")


def fingerprints(docs: DataFrame, lengths: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, k1 and k2 (the text's hash, 128 bits), n_words, fps: its distinct fingerprints for windows of those lengths.

    Winnowing keeps the least k-gram hash of each window. Two texts that share a window
    share its fingerprint, so every shared span of a window's length is found. Some two sevenths of a text's words are kept for windows of ten words.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), hashed_words(text).alias("h"))
    rows = minima(rows, lengths)
    every = F.concat(*[F.col(f"m{x}") for x in lengths]) if lengths else F.array().cast("array<long>")
    return rows.select("id", "k1", "k2", F.size("h").cast("long").alias("n_words"), F.array_distinct(every).alias("fps"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = WINDOW) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, items array<string> (sorted, distinct), spans array<struct<start, stop>>.

    A window is `words` consecutive words of an item, or all of them if it has fewer.
    A document's words inside any occurrence of a window are hit; spans are the maximal runs of
    hit words (from 0, stop excluded); items are those that have an occurring window.

    Fingerprints of documents (see fingerprints) are joined with those of the items. Only documents with a common one
    are read again: around the fingerprints their windows are extended to all words and compared as 128-bit hashes.
    Equal texts share one result, by a 128-bit hash of the text. Nothing else is approximate.

    Null, empty and wordless texts have no words and no hits; such items have no windows. A null item id is the item ''.
    Ids of docs may be null or repeat: each row has its own result. No items: nothing is hit. No rows give no
    rows. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found, lengths = item_windows(items, item_col, item_text_col, words)
    none = lambda kind: F.array().cast(kind)
    index = materialize(fingerprints(docs, lengths, "id"), "fingerprints")
    if not lengths:
        return index.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), none("array<string>").alias("items"), none("array<struct<start:int,stop:int>>").alias("spans"))
    names, members = item_sets(found)
    known = materialize(found.select("fp").distinct(), "item-fingerprints", narrow=True)
    hit = index.select("k1", "k2", F.explode("fps").alias("fp")).join(known, "fp", "left_semi").select("k1", "k2").distinct()
    hit = materialize(hit, "hit-texts", narrow=True)
    again = docs.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text").join(hit, ["k1", "k2"], "left_semi")
    again = windows(again.select("k1", "k2", hashed_words(F.col("text")).alias("h")), lengths, "k1", "k2")
    exact = found.select("fp", "length", "w1", "w2").distinct()
    same = again.join(exact, ["fp", "length", "w1", "w2"]).select("k1", "k2", "start", "length", "w1", "w2").distinct()
    same = materialize(same, "hit-windows")

    starts = W.partitionBy("k1", "k2").orderBy("start", "stop")
    before = F.max("stop").over(starts.rowsBetween(W.unboundedPreceding, -1))
    runs = same.select("k1", "k2", "start", (F.col("start") + F.col("length")).alias("stop")).withColumn("before", before)
    runs = runs.withColumn("run", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(starts.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("k1", "k2", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("k1", "k2").agg(F.sum((F.col("stop") - F.col("start")).cast("long")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    sets = same.join(names, ["w1", "w2"]).select("k1", "k2", "r1", "r2").distinct()
    lists = sets.join(members, ["r1", "r2"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    result = materialize(spans.join(lists, ["k1", "k2"]), "contaminated-texts")

    out = index.select("id", "k1", "k2", "n_words").join(result, ["k1", "k2"], "left")
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none("array<string>")).alias("items"), F.coalesce("spans", none("array<struct<start:int,stop:int>>")).alias("spans"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')"
OP11_SQL = rf"""
with d as (select doc_id, {_SQL_WORDS} as w from documents), b as (select item_id, {_SQL_WORDS} as w from benchmark),
sized as (select item_id, w, least(len(w), {WINDOW}) as k from b where len(w) > 0),
iw as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as g from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from sized)),
dw as (
    select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as g
    from (select doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) as i from d, (select distinct k from sized))
), hits as (select dw.doc_id, dw.i, dw.k, item_id from dw join iw using (k, g)),
n_hits as (select doc_id, count(distinct p) as n from (select distinct doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
lists as (select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(l.n, 0)::bigint as n_items,
       sha256(coalesce(l.items, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from d left join n_hits h using (doc_id) left join lists l using (doc_id)
"""
