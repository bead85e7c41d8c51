"""Spelling variants: words one edit apart, found by Aho-Corasick automata over their halves."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize, table

RUNS = r"[a-zÀ-ÿ]+"
#: Letters at the start or end of a half that name its shard. The halves of words of at least twice as many hold them.
ROUTE = 3
#: Words whose segments an automaton holds at once; a shard with more has several, and each scans the shard's words.
SHARD = 20_000
#: Words that share all segments so far are compared one by one up to this number, beyond it by further halves.
LEAF = 16
#: Pairs in a batch of results.
OUT = 20_000


def kept_run(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run, of which one code point is deleted if the crc32 of `<doc_id>:<run>` is a multiple of `every`: the one at crc32 modulo the run's length."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.left(run, at), F.substr(run, at + 2))).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the words of at least `least` code points that occur at least `often` times in all texts; see kept_run()."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(RUNS), F.lit(0))).alias("run"))
    words = runs.where(F.char_length("run") >= least).select(kept_run(F.col("id"), F.col("run"), every).alias("word"))
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


class Alike:
    """Words of one length that have their first p and last s letters in common with any word that is looked up here.

    Few are compared one by one. Of more, what is between is halved again: one edit leaves one of the halves as it is.
    """

    __slots__ = ("children", "p", "s", "words")

    def __init__(self, p: int, s: int):
        self.p, self.s, self.words, self.children = p, s, [], None

    def split(self) -> None:
        self.children = {}
        for word, n in self.words:
            start, stop = self.p, len(word) - self.s
            middle = (start + stop) // 2
            self.children.setdefault((True, word[start:middle]), Alike(middle, self.s)).words.append((word, n))
            self.children.setdefault((False, word[middle:stop]), Alike(self.p, len(word) - middle)).words.append((word, n))

    def near(self, word: str) -> set[tuple[str, int]]:
        """The (word, n) here that are one edit from this word; all words here have one length, and at least four letters between the common ones if they are halved."""
        if len(self.words) <= LEAF or len(self.words[0][0]) - self.p - self.s < 4:
            return {x for x in self.words if one_edit(word, x[0])}
        if self.children is None:
            self.split()
        found = set()
        length = len(self.words[0][0])
        middle = (self.p + length - self.s) // 2
        for first, segment in ((True, word[self.p : middle]), (False, word[len(word) - (length - middle) : len(word) - self.s])):
            if child := self.children.get((first, segment)):
                found |= child.near(word)
        return found


def halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


class Shard:
    """An automaton of the first (or last) halves of some words, with a mark where the word begins (or ends)."""

    def __init__(self, first: bool, words: list[tuple[str, int]]):
        self.first = first
        segments: dict[str, dict[int, Alike]] = defaultdict(dict)
        for word, n in words:
            a, b = halves(word)
            node = segments[f"^{a}" if first else f"{b}$"]
            if len(word) not in node:
                node[len(word)] = Alike(len(a), 0) if first else Alike(0, len(b))
            node[len(word)].words.append((word, n))
        self.automaton = ahocorasick.Automaton()
        for segment, lengths in segments.items():
            self.automaton.add_word(segment, lengths)
        self.automaton.make_automaton()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The words here that are one edit away; of those with both halves in common only the first halves' shard tells.

        The marks hold the segments to their places; lengths differ by one at most.
        """
        for _, lengths in self.automaton.iter(f"^{word}$"):
            for length in (len(word) - 1, len(word), len(word) + 1):
                if length in lengths:
                    for other in lengths[length].near(word):
                        if self.first or not word.startswith(halves(other[0])[0]):
                            yield other


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, other, other_n): every two words that are exactly one edit apart, in both directions. words: distinct word (of at least 6 code points), n.

    One edit leaves one half of a word whole, at the start or the end of the other word. Halves are dealt to shards by the
    first letters of first halves and the last letters of last halves; each word is scanned by the two shards that can have halves of its.
    A shard with more than `shard` words has as many parts as it needs, each with its own automaton, and all of them scan the shard's words.
    A task holds one part's automaton and streams the words through it.
    """
    letters = F.array(F.struct(F.lit(True).alias("first"), F.left("word", F.lit(ROUTE)).alias("route")), F.struct(F.lit(False).alias("first"), F.right("word", F.lit(ROUTE)).alias("route")))
    dealt = words.select("word", "n", F.explode(letters).alias("at")).select("word", "n", "at.*")
    dealt = materialize(dealt, "spelling-routes")
    sizes = dealt.groupBy("first", "route").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    dealt = dealt.join(materialize(sizes, "spelling-shards", narrow=True), ["first", "route"])
    own = dealt.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("scans", F.lit(False))
    scans = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("scans", F.lit(True))
    both = own.unionByName(scans).select("first", "route", "part", "scans", "word", "n")
    dealt = both.repartition("first", "route", "part").sortWithinPartitions("first", "route", "part", "scans", "word")

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = pairs(rows)
        while some := list(islice(found, OUT)):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n", "other", "other_n"])

    def pairs(rows):
        for (first, _, _), group in groupby(rows, key=itemgetter(0, 1, 2)):
            held, automaton = [], None
            for _, _, _, scans, word, n in group:
                if not scans:
                    held.append((word, n))
                else:
                    automaton = automaton or Shard(first, held)
                    for other, other_n in automaton.near(word):
                        yield word, n, other, other_n

    return dealt.mapInArrow(run, "word string, n long, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): follows each word's form to the last. forms: word, form, not null; each form is more frequent than its word, so there are no circles.

    Pointers double: after k rounds 2**k steps are done, until none leads on.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots", narrow=True)
    while True:
        onward = now.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        moved = now.join(onward, now.root == onward.via, "left")
        moved = materialize(moved.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots", narrow=True)
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 10, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with their counts n.

    n_near: how many words are one edit away. form: the near word of the largest n (of equals the first in code-point order), if
    that is at least `times` the word's own; else null. root: the last of the forms that follow from the word, or the word itself.
    No words give no rows. Words of fewer than 6 code points can't be halved for a shard: an error.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    if not words.where(F.char_length("word") < 2 * ROUTE).isEmpty():
        raise ValueError(f"words need {2 * ROUTE} code points at least")
    found = near_words(words, shard).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best")
    )
    found = materialize(found, "spelling-near")
    has_form = F.col("best.n").isNotNull() & (-F.col("best.n") >= times * F.col("n"))
    out = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best.form")).alias("form"), F.when(has_form, -F.col("best.n")).alias("form_n")
    )
    out = materialize(out, "spelling-forms")
    ends = roots(out.where("form is not null").select("word", "form"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, often: int = 2, times: int = 10, shard: int = SHARD) -> DataFrame:
    """variants() of the words of whole texts, see count_words().

    Null and wordless texts have no words; a null id counts as '' in the deletions; repeated rows count each. Runs end at any other character.
    No rows give no rows. Other columns are ignored.
    """
    return variants(count_words(docs, id_col, text_col, least, often), times, shard)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 of the bytes of `<doc_id>:<run>`, which are ASCII or U+00C0 to U+00FF, in SQL: eight steps a byte in a table of 256 made by the same rule.
OP13_SQL = r"""
with recursive crc(i, k, c) as (
    select i, 0, i from range(256) r(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8
), crcs as materialized (select list(c order by i) as t from crc where k = 8),
runs as materialized (
    select doc_id, run, count(*) as n from (
        select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run from documents
    ) where length(run) >= 7 group by all
), bytes as (
    select doc_id, run, n, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)) as b from runs
), hashed as (
    select doc_id, run, n, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) as h from bytes, crcs
), kept as (
    select case when h % 31 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed
), words as materialized (select word, sum(n)::bigint as n from kept where length(word) >= 7 group by word having sum(n) >= 2),
cut as materialized (select word, n, i, left(word, i - 1) || substr(word, i + 1) as v from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as materialized (
    select a.word, b.word as other, b.n from cut a join cut b on a.v = b.v and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from cut a join words b on a.v = b.word
    union select b.word, a.word, a.n from cut a join words b on a.v = b.word
), best as (select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as m from near group by word),
forms as materialized (
    select word, w.n, coalesce(n_near, 0) as n_near, case when m >= 10 * w.n then other end as form, case when m >= 10 * w.n then m end as form_n from words w left join best using (word)
), follow(word, ends, k) as (select word, word, 0 from forms union all select f.word, g.form, k + 1 from follow f join forms g on f.ends = g.word where g.form is not null)
select word, form, (select arg_max(ends, k) from follow x where x.word = f.word) as root, n, n_near::bigint as n_near, form_n::bigint as form_n from forms f
"""
