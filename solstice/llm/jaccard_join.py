"""Exact Jaccard self-join of documents' word n-gram sets by prefix trees."""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import mix, shingle_sets
from .shared import Storage, arrow_batches, connected_components, materialize

#: Bits of the filter that keeps documents without a candidate from being cut into n-grams again: a fixed 1 MB.
FILTER_BITS = 1 << 23
#: An n-gram in at least this part of the documents comes last in the global order; of more than MOST_COMMON the most frequent do.
COMMON, MOST_COMMON = 0.001, 1 << 20
#: So many shared n-grams after a branch's own are kept in the trie below it (beyond them the rest's length bounds), and so many before it to tell repeats.
DEPTH, BEFORE = 64, 4
#: Of i n-grams that the smaller of two linked sets must have in common with the other, 1 + i // SPARE are in the prefixes, which are so many longer than for one.
SPARE = 8
#: First a set meets the hubs of its branches among so many first positions.
FIRST = 8
#: Candidates that a set has in a branch in the first round of the tries; what is beyond waits for the next round, which allows FOLD times as many.
PARTNERS, FOLD = 2, 4
#: A leaf of a trie with more sets than this gets children.
LEAF = 8
#: Documents or pairs of sets that a task holds at once.
BATCH = 1000
#: Sets of a part of a branch; a branch has as many parts as its sets need, and each two of them meet in a task.
PART = 500
HOT = np.uint64(1 << 62)


def class_of(grams: np.ndarray) -> int:
    """A 63-bit number that equal sets share."""
    return int(mix((mix(grams + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(grams)))[None])[0] >> np.uint64(1))


def parities(grams: np.ndarray) -> bytes:
    """A bit map with two to four bits an n-gram: whether an odd number of n-grams falls on each.

    Of two sets the map's bits that differ are at most the n-grams that only one has.
    """
    bits = max(64, 2 << len(grams).bit_length())
    return np.packbits((np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """How many bits of two maps differ; the longer one is folded to the shorter one's length first."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = len(a) * 8, len(b) * 8
    while n > m:
        n >>= 1
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m >>= 1
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


def needed(n: int, m: int, percent: int) -> int:
    """The least intersection with which sets of n and m elements link: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Linked sets share one of so many first elements of any global order."""
    return n - -(-percent * n // 100) + 1 if n else 0


def long_prefix(n: int, percent: int) -> int:
    """Linked sets share least_shared() of so many first elements."""
    return min(n, prefix_length(n, percent) + n * percent // 100 // SPARE)


def least_shared(n: int, percent: int) -> int:
    """How many elements of its long prefix a set shares with any that it links with, the smallest one included."""
    return 1 + -(-percent * n // 100) * percent // 100 // SPARE


def describe(docs: DataFrame, words: int, common: float) -> DataFrame:
    """Per row: id, cls (equal sets share it), n; and in one row of each batch its common n-grams and their counts."""

    def run(batches):
        for batch in batches:
            ids, cls, n, sets = batch.column(0), [], [], []
            for grams in shingle_sets(batch.column(1), words):
                cls.append(class_of(grams))
                n.append(len(grams))
                sets.append(grams)
            grams, counts = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
            often = counts >= max(3, common * len(sets))
            lists = [[] for _ in sets], [[] for _ in sets]
            if sets:
                lists[0][0], lists[1][0] = grams[often].astype(np.int64).tolist(), counts[often].tolist()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.list_(pa.int64()))],
                names=["id", "cls", "n", "grams", "counts"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, cls long, n int, grams array<long>, counts array<long>")


def common_grams(described: DataFrame, common: float) -> np.ndarray:
    """The n-grams known to be in at least `common` of the documents, sorted; MOST_COMMON of them (8 MB) at most.

    They change the order of the n-grams, not the result.
    """
    total = described.count()
    pairs = described.where("size(grams) > 0").select(F.explode(F.arrays_zip("grams", "counts")).alias("x")).select("x.grams", "x.counts")
    found = pairs.groupBy("grams").agg(F.sum("counts").alias("n")).where(F.col("n") >= common * total)
    found = found.orderBy(F.desc("n"), "grams").limit(MOST_COMMON).select("grams").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.uint64))


def ordered(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The set in the global order: by hash, common n-grams last (with the bit HOT)."""
    if not len(common) or not len(grams):
        return grams
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    return np.sort(np.where(common[at] == grams, grams | HOT, grams))


def shared_prefixes(docs: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """(gram, pos, cls, n): the prefix elements that at least two different sets have, and all common ones.

    Tasks pack what goes to a bucket into one row of NumPy arrays, each set once
    for a batch, so copies are joined before the shuffle. A bucket's task then
    sorts whole arrays. Buckets are as many as needed for even tasks. A common n-gram is shared for
    certain; its rows are spread over all buckets, so no bucket has more than `common` of the documents of one n-gram.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        for batch in batches:
            seen, parts = set(), []
            for grams in shingle_sets(batch.column(0), words):
                cls = class_of(grams)
                if cls not in seen and len(grams):
                    seen.add(cls)
                    prefix = ordered(grams, common)[: long_prefix(len(grams), percent)]
                    part = np.zeros(len(prefix), ROW)
                    part["gram"], part["pos"], part["cls"], part["n"] = prefix, np.arange(len(prefix)), cls, len(grams)
                    parts.append(part)
            if parts:
                rows = np.concatenate(parts)
                gram = rows["gram"].astype(np.uint64)
                bucket = (mix(np.where(gram & HOT > 0, gram ^ rows["cls"].astype(np.uint64), gram)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rows, bucket = rows[order], bucket[order]
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({"bucket": full.astype(np.int32), "rows": [rows[cuts[k] : cuts[k + 1]].tobytes() for k in full]})

    def sift(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, ROW) for x in table.column("rows").to_pylist()])
        rows = rows[np.lexsort((rows["cls"], rows["gram"]))]
        new = np.append(True, (rows["gram"][1:] != rows["gram"][:-1]) | (rows["cls"][1:] != rows["cls"][:-1]))
        rows = rows[new]  # a set may come from several batches
        first = np.flatnonzero(np.append(True, rows["gram"][1:] != rows["gram"][:-1]))
        size = np.diff(np.append(first, len(rows)))
        keep = (np.repeat(size, size) > 1) | (rows["gram"].astype(np.uint64) & HOT > 0)
        return pa.table({k: rows[k][keep] for k in ("gram", "pos", "cls", "n")})

    packed = docs.select("text").mapInArrow(pack, "bucket int, rows binary")
    return packed.groupBy("bucket").applyInArrow(sift, "gram long, pos int, cls long, n int")


ROW = np.dtype([("gram", "<i8"), ("cls", "<i8"), ("pos", "<i4"), ("n", "<i4")])


class Trie:
    """The sets of one branch by the shared n-grams that follow the branch's own.

    Each node knows the largest rest (elements not passed yet) behind it and behind the node above, the smallest set
    below it, and the label that all sets below it share, if they do.
    """

    __slots__ = ("above", "children", "label", "rest", "sets", "small")

    def __init__(self):
        self.children: dict[int, Trie] | None = None
        self.sets: list[tuple] = []
        self.rest, self.above, self.small, self.label = 0, 0, 1 << 62, None

    def insert(self, one: tuple, depth: int = 0) -> None:
        """one: (cls, n, label, bits, pos, grams, places, earlier). depth: of this node."""
        node = self
        while True:
            above = one[1] - one[4] - 1 if depth < 2 else one[1] - one[6][depth - 2] - 1
            node.note(one[1] - one[4] - 1 if not depth else one[1] - one[6][depth - 1] - 1, above, one)
            if node.children is None and len(node.sets) >= LEAF:
                node.children, sets, node.sets = {}, node.sets, []
                for x in sets:
                    node.below(x, depth)
            if node.children is None or depth == len(one[5]):
                node.sets.append(one)
                return
            node = node.children.setdefault(one[5][depth], Trie())
            depth += 1

    def below(self, one: tuple, depth: int) -> None:
        if depth == len(one[5]):
            self.sets.append(one)
        else:
            self.children.setdefault(one[5][depth], Trie()).insert(one, depth + 1)

    def note(self, rest: int, above: int, one: tuple) -> None:
        self.label = one[2] if self.small == 1 << 62 or self.label == one[2] else None
        self.rest, self.above, self.small = max(self.rest, rest), max(self.above, above), min(self.small, one[1])

    def find(self, one: tuple, percent: int) -> Iterator[tuple]:
        """The sets that may link with `one` and have another label.

        Descends with the overlap so far, which all sets below a node share. A
        subtree is left when the overlap and the rest of either side can't reach
        the intersection needed for the smallest set below it. Behind the last n-gram that is known of `one` (its list is
        full, or its prefix at its end) any element of a set may match, listed or not: the rest there bounds all below.
        """
        cls, n, label, bits, pos, grams, places, earlier = one
        todo = [(self, 0, 1, n - pos - 1, None)]
        while todo:
            node, k, overlap, rest, behind = todo.pop()
            if node.label == label or overlap + (min(rest, node.rest) if behind is None else behind) < needed(n, node.small, percent):
                continue
            for other in node.sets:
                least = needed(n, other[1], percent)
                if other[2] == label or least > min(n, other[1]) or not earlier.isdisjoint(other[7]):
                    continue  # with an earlier n-gram in common that one's branch gives the pair
                if (n + other[1] - differing(bits, other[3])) // 2 >= least:
                    yield other
            for gram, child in (node.children or {}).items():
                i = k if behind is not None else bisect_left(grams, gram, k)
                left = n - places[i - 1] - 1 if i > k else rest
                if i == len(grams):
                    todo.append((child, i, overlap, left, min(left, child.above) if behind is None else behind))
                elif grams[i] == gram:
                    todo.append((child, i + 1, overlap + 1, n - places[i] - 1, None))
                else:
                    todo.append((child, i, overlap, left, None))


def join_branch(rows: list[tuple], cell: tuple[int, int], percent: int, most: int) -> tuple[set[tuple[int, int]], bool]:
    """Candidate pairs of the two parts of a branch that make a cell, at most so many for each set, and whether some were left for later.

    Sets are inserted by size, so each is compared with those inserted before. Of a cell of two
    different parts only pairs across them count.
    """
    pairs, cut = set(), False
    tries: dict[tuple[int, int], Trie] = {}
    for *one, part in sorted(rows, key=itemgetter(1, 0)):
        home, left = size_band(one[1], percent), most
        other = cell[0] + cell[1] - part
        for near in (home - 1, home):  # sets of linked sizes are in the same or in neighbouring bands
            for found in tries[other, near].find(one, percent) if (other, near) in tries else ():
                if not left:
                    cut = True
                    break
                left -= 1
                pairs.add((min(one[0], found[0]), max(one[0], found[0])))
        tries.setdefault((part, home), Trie()).insert(one)
    return pairs, cut


def band_tops(percent: int) -> Iterator[int]:
    """The largest size of each band, found by whole numbers so that all machines agree.

    Each is more than 100 / percent of the one before, and a quarter more at least.
    """
    top, percent = 1, min(percent, 80)
    while True:
        yield top
        top += top * (100 - percent) // percent + 1


@functools.lru_cache(maxsize=1 << 16)
def size_band(n: int, percent: int) -> int:
    """The band of a size. Linked sizes are in the same or in neighbouring bands."""
    return next(band for band, top in enumerate(band_tops(percent)) if n <= top)


def candidates(live: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """Rows (a, b): pairs a < b of classes with different labels that may link; and rows (gram): branches that left some for later.

    live: gram, cls, pos, size (of the branch) for the branches to search. sets: cls, n, label, bits, grams and places (the shared part of the prefix).
    A branch is dealt out in cells: each two of its parts meet in one.
    """
    parts = F.ceil(F.col("size") / PART).cast("int")
    part = F.pmod(F.xxhash64(F.col("cls"), F.col("gram")), parts).cast("int")
    rows = live.withColumn("parts", parts).withColumn("part", part).join(sets, "cls")
    k = F.array_position("grams", F.col("gram")).cast("int")
    depth = F.when(F.col("size") > LEAF, DEPTH).otherwise(0)  # of fewer sets the trie is one leaf
    rows = rows.withColumn("k", k).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(
        "gram", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "cls", "n", "label", "bits", "pos",
        F.slice("grams", F.col("k") + 1, depth).alias("grams"), F.slice("places", F.col("k") + 1, depth).alias("places"),
        F.slice("grams", F.greatest(F.col("k") - BEFORE, F.lit(1)), F.least(F.col("k") - 1, F.lit(BEFORE))).alias("earlier"), "part",
    )

    def run(batches):
        def all_rows():
            for whole in batches:
                for batch in (whole.slice(a, BATCH) for a in range(0, whole.num_rows, BATCH)):
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        pairs: set[tuple[int, int]] = set()
        again: list[int] = []
        for (gram, *cell), group in groupby(all_rows(), key=itemgetter(0, 1, 2)):
            group = [(*x[3:-2], frozenset(x[-2]), x[-1]) for x in group]
            if len(group) > 1:
                found, cut = join_branch(group, cell, percent, most)
                pairs |= found
                again += [gram] * cut
            if len(pairs) > 20_000:
                yield out(pairs, again)
                pairs, again = set(), []
        if pairs or again:
            yield out(pairs, again)

    def out(pairs, again):
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        none = [None] * len(again)
        return pa.RecordBatch.from_pydict({"a": pa.array([*a, *none], pa.int64()), "b": pa.array([*b, *none], pa.int64()), "gram": pa.array([None] * len(a) + again, pa.int64())})

    dealt = rows.repartition("gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long, gram long").distinct()


def gram_sets(wanted: DataFrame, docs: DataFrame, described: DataFrame, words: int) -> DataFrame:
    """(cls, grams, bits) of the wanted classes (cls).

    Only their documents are cut into n-grams again: a bit map of a fixed
    size over their ids leaves out most others, a join by class the rest.
    """
    first = described.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min(F.xxhash64("id")).alias("key"))
    slot = F.pmod("key", F.lit(FILTER_BITS))
    maps = first.select(F.floor(slot / 32768).cast("int").alias("part"), (slot % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("m"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for part, m in maps.toArrow().to_pandas().itertuples(index=False):  # at most 256 rows of 4 kB
        bits[part * 4096 : part * 4096 + len(m)] |= np.frombuffer(m, np.uint8)
    flags = np.unpackbits(bits, bitorder="little").astype(bool)

    def cut(batches):
        for batch in batches:
            keep = flags[batch.column(0).to_numpy() % FILTER_BITS]
            part = batch.filter(pa.array(keep))
            cls, sets, maps = [], [], []
            for grams in shingle_sets(part.column(1), words):
                cls.append(class_of(grams))
                sets.append(grams.tobytes())
                maps.append(parities(grams))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary()), pa.array(maps, pa.binary())], names=["cls", "grams", "bits"])

    sets = docs.select(F.xxhash64("id").alias("key"), "text").mapInArrow(cut, "cls long, grams binary, bits binary")
    sets = sets.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("grams").alias("grams"), F.first("bits").alias("bits"))
    with arrow_batches(docs.sparkSession, BATCH):
        return materialize(sets, "gram-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection."""

    def test(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                ok.append(100 * (i := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - i))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(ok, pa.bool_())).columns[:2], names=["a", "b"])

    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
    with arrow_batches(pairs.sparkSession, BATCH):
        return materialize(both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long"), "jaccard-links")


def joined(known: DataFrame | None, pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(cls, component) of the classes that have links: those known so far and the pairs that link."""
    edges = verified(pairs, grams, percent).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if known is not None:
        edges = edges.unionByName(known.where("cls <> component").select(F.col("cls").alias("src"), F.col("component").alias("dst")))
    return materialize(connected_components(edges).withColumnRenamed("id", "cls"), "jaccard-components", narrow=True)


def labelled(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """rows with label: equal labels are known to be of one component."""
    if known is None:
        return rows.withColumn("label", F.col("cls"))
    return rows.join(known.withColumnRenamed("component", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def hub_links(rows: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The first components: of sets and hubs of the branches of their first positions.

    rows: gram, pos, cls, n. Each branch has a hub of its own: its set of the least hash. Linked sets share most
    of their first n-grams, so large groups of near copies are joined by FIRST comparisons a set at most; the tries
    then find what is left.
    """
    first = materialize(rows.where(F.col("pos") < FIRST).select("gram", "cls", "n"), "jaccard-first", narrow=True)
    hubs = first.groupBy("gram").agg(F.min(F.struct(F.xxhash64("gram", "cls").alias("h"), "cls", "n")).alias("hub"))
    met = first.join(hubs, "gram").where((F.col("cls") != F.col("hub.cls")) & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")))
    pairs = met.select(F.least("hub.cls", "cls").alias("a"), F.greatest("hub.cls", "cls").alias("b")).distinct()
    return joined(None, materialize(pairs, "jaccard-pairs", narrow=True), grams, percent)


def alive(rows: DataFrame) -> DataFrame:
    """The rows of branches with two labels; with the branch's size."""
    branches = rows.groupBy("gram").agg(F.count("*").alias("size"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("gram", "size")
    return rows.join(branches, "gram")


def least_shared_of(n: Column, percent: int) -> Column:
    """least_shared() of a column."""
    return 1 + F.floor(F.floor(F.ceil(percent * n / 100) * percent / 100) / SPARE)


def peeled(rows: DataFrame, percent: int) -> DataFrame:
    """rows (with label) without sets that have too few n-grams of their prefixes in common with sets of other labels."""
    live = alive(rows).drop("size")
    enough = live.groupBy("cls").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= least_shared_of(F.col("n"), percent))
    return materialize(live.join(enough.select("cls"), "cls", "left_semi"), "jaccard-live")


def trie_links(rows: DataFrame, grams: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The components by all links; rows: gram, pos, cls, n of the sets that may link.

    Each round searches the branches that still hold two labels and were not searched to the end. A set puts forward a few candidates in a branch, they
    are verified and labels joined before it puts forward more; so the candidates of a group of near copies grow with
    its size, not with the square of it. Nothing is left out: a branch is done when no set had more candidates.
    """
    here = peeled(labelled(rows, known), percent)
    lists = here.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("pos", "gram"))).alias("s"), F.first("n").alias("n"))
    lists = lists.join(grams.select("cls", "bits"), "cls").select("cls", "n", "bits", F.col("s.gram").alias("grams"), F.col("s.pos").alias("places"))
    lists = materialize(lists, "jaccard-lists")
    here, most = here.where(F.col("pos") < prefix_of(F.col("n"), percent)).select("gram", "pos", "cls"), PARTNERS
    while True:
        here = materialize(alive(labelled(here, known)), "jaccard-branches")
        sets = lists.join(here.select("cls", "label").distinct(), "cls")
        found = materialize(candidates(here.drop("label"), sets, percent, most), "jaccard-candidates", narrow=True)
        pairs = found.where("a is not null").select("a", "b")
        if not pairs.isEmpty():
            known = joined(known, pairs, grams, percent)
        again = found.where("gram is not null").select("gram").distinct()
        if again.isEmpty():
            return known
        here, most = here.select("gram", "pos", "cls").join(again, "gram", "left_semi"), FOLD * most


def prefix_of(n: Column, percent: int) -> Column:
    """prefix_length() of a column."""
    return n - F.ceil(F.lit(percent) * n / 100) + 1


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, common: float = COMMON) -> DataFrame:
    """Per row of docs: id, cls (equal sets share it), n (size of the set), component (smallest id reachable).

    Two rows link when 100 * intersection >= percent * union of their sets of
    distinct word n-grams; a text of fewer words is one n-gram, a text without words
    (or null) links with nothing. Links are exact but for 62-bit hashes of n-grams and
    63-bit hashes of sets.

    Sets are ordered globally by hash with common n-grams last. Linked sets share n-grams
    of their prefixes, least_shared() at least; a set that shares fewer with all others is left. Each shared one is a branch of a prefix tree, spread over tasks.
    First each set is compared with a few hubs of its branches, which
    joins large groups of near copies without their pairs; then the trie of each branch
    that still holds sets of several groups gives the other candidates, in rounds.

    Repeated rows are rows of their own with equal sets. Of null ids, a component of
    nothing else has a null id. No rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with arrow_batches(spark, BATCH):
        described = materialize(describe(docs, words, common), "jaccard-rows")
        hot = common_grams(described, common)
        described = described.select("id", "cls", "n")
        with Storage(spark) as passing:
            shared = materialize(shared_prefixes(docs, hot, words, percent), "jaccard-prefixes")
    shared = shared.distinct()  # rows of common n-grams may come from several batches
    likely = shared.groupBy("cls").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= least_shared_of(F.col("n"), percent))
    likely = materialize(likely.select("cls"), "jaccard-likely", narrow=True)
    rows = materialize(shared.join(likely, "cls", "left_semi"), "jaccard-likely-rows")
    passing.release()  # the prefixes that are still needed are stored
    grams = gram_sets(likely, docs, described, words)
    known = trie_links(rows, grams, hub_links(rows, grams, percent), percent)
    sets = materialize(described.groupBy("cls").agg(F.min("id").alias("id")), "jaccard-classes")
    linked = sets.join(known, "cls")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    moved = materialize(linked.join(least, "component").select("cls", "least"), "jaccard-groups", narrow=True)
    groups = sets.join(moved, "cls", "left").select("cls", F.coalesce("least", "id").alias("component"))
    out = described.join(groups, "cls")
    return out.select("id", "cls", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


OP9_SQL = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), g as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)
), n as (select doc_id, count(*) as n from g group by doc_id), links as (
    select a.doc_id as a, b.doc_id as b from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
    having 100 * count(*) >= 80 * ((select n from n where n.doc_id = a.doc_id) + (select n from n where n.doc_id = b.doc_id) - count(*))
), reach as (
    select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on l.a = r.b
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, m.component_id
from documents d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) m using (doc_id)
"""
