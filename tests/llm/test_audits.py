"""Benchmark decontamination, filter audit and spelling variants against brute force on small documents."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from solstice.llm import decontamination, filter_audit, spelling_variants

from .data import A_TO_Z, documents, empty

ITEM_SCHEMA = "item_id long, text string, doc_id string, fp long, spans int"


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def contaminated(docs, items, size=10):
    """[(id, words, hit positions, items)] by looking for each window at each place."""
    windows = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[k : k + n])].add("" if item is None else str(item))
    out = []
    for i, text in docs:
        words, hit, found = bench_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[w]
        out.append((i, len(words), sorted(hit), sorted(found)))
    return out


def bench_texts():
    rng = random.Random(11)
    some = lambda n, vocab=60: [f"b{rng.randrange(vocab)}" for _ in range(n)]
    items = [(k, " ".join(some(n))) for k, n in enumerate([10, 11, 25, 40, 9, 7, 5, 4, 3, 2, 12, 10])]
    items += [(20, items[2][1]), (21, items[2][1].upper()), (2, "other words for the same id " * 3), (None, " ".join(some(14))), (30, None), (31, ""), (32, "!?"), (33, "so so so so so so so so so so so so so")]
    docs = []
    for k in range(40):
        words = some(rng.randrange(0, 60), 40)
        for _ in range(rng.randrange(3)):
            item = bench_words(rng.choice(items)[1])
            a = rng.randrange(max(1, len(item) - 4))
            at = rng.randrange(len(words) + 1)
            words[at:at] = item[a : a + rng.choice([3, 9, 10, 11, 50])]
        docs.append((k if k % 9 else None, rng.choice([" ", "-", ". "]).join(words)))
    docs += [(100, None), (101, ""), (102, "so " * 500), (103, items[3][1]), (103, items[3][1]), (104, "Ünder Straße " + items[1][1].title()), (105, " ".join(some(20_000)))]
    return docs, items


def test_contamination_equals_brute_force(spark):
    docs, items = bench_texts()
    rows = spark.createDataFrame([(i, t, 1, "x", 5) for i, t in docs], "doc_id long, text string, k1 int, fps string, n_words int").repartition(3)
    table = spark.createDataFrame([(i, t, "d", 1, 2) for i, t in items], ITEM_SCHEMA)
    got = [(r.id, r.n_words, [k for s in r.spans for k in range(s.start, s.stop)], r["items"], r.n_hit) for r in decontamination.contamination(rows, table).collect()]
    want = [(*x, len(x[2])) for x in contaminated(docs, items)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(x[2] for x in want) and not all(x[2] for x in want)


@pytest.mark.parametrize("size", [1, 2, 3, 8])
def test_contamination_with_other_windows(spark, size):
    docs, items = bench_texts()
    docs = [x for x in docs if len(x[1] or "") < 5000]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.id, r.n_words, [k for s in r.spans for k in range(s.start, s.stop)], r["items"]) for r in decontamination.contamination(rows, spark.createDataFrame(items, "item_id long, text string"), words=size).collect()]
    assert sorted(got, key=str) == sorted(contaminated(docs, items, size), key=str)


def test_contamination_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontamination.contamination(empty(spark), items).count() == 0
    for none in (items.where("false"), items.withColumn("text", F.lit(None).cast("string"))):
        out = decontamination.contamination(documents(spark), none).collect()
        assert len(out) == documents(spark).count() and not any(r.n_hit or r["items"] or r.spans for r in out)


def test_main_path_of_native_operators_has_no_python(spark):
    docs, items = bench_texts()
    out = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


def failures(rows):
    """[(part, failing letters, id)] of (id, text, part)."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and text in least and least[text] < i,
        }
        out.append((part or "", {k for k, v in tests.items() if v}, i))
    return out


def audited(rows, labels):
    good, bad = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails, out = failures(rows), {}
    for part in {p for p, _, _ in fails}:
        own = [(f, i) for p, f, i in fails if p == part]
        gone = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, name in enumerate(order):
                lost = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                gone[name] += len(lost)
                out[part, "".join(order), k + 1] = [len(left), len(lost), sum(name in f for f, _ in own) - len(lost), sum(f == {name} for f, _ in own), sum(i in good for _, i in lost), sum(i in bad for _, i in lost), name]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = gone[row[-1]]
    return out


def test_audit_equals_filtering_in_every_order(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(v)}" for _ in range(n)) for n, v in ((99, 900), (100, 9000), (101, 9000), (150, 90), (300, 5000), (130, 40))]
    base += [None, "", "  \n", "ABC", "Aa bb cc dd ee", "a#b", "x|" * 200, "Ä É " * 80, "AB " * 120, " ".join(f"Z{k}" for k in range(120)), " ".join(f"q{k}" for k in range(60_000))]
    rows = [(rng.randrange(60) if rng.random() > 0.1 else None, rng.choice(base), rng.choice(["en", "de", None, ""])) for _ in range(160)]
    rows += rows[:5]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 80, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "a") for r in rows], "doc_id long, text string, lang string, mask int, k1 int, part string").repartition(5)
    table = spark.createDataFrame([(*x, 7) for x in labels], "doc_id long, quality int, toxic int, n int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(docs, table).collect()}
    want = audited(rows, labels)
    assert len(want) == 3 * 600 and got == want


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty(spark), labels).count() == 0
    rows = [(r.doc_id, r.text, r.lang) for r in documents(spark).collect()]
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(documents(spark), labels.where("false")).collect()}
    assert got == audited(rows, [])


def test_text_keys_come_before_the_shuffle_and_no_python(spark):
    plan = filter_audit.masks(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def edited(a, b):
    """One edit, by trying all."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def variant_rows(words):
    near = {w: [x for x in words if edited(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words.get(form.get(w)))
    return out


def vocabulary(seed, size):
    """Words whose halves many others have: few letters, equal starts and ends, and edits of each other."""
    rng = random.Random(seed)
    out = Counter()
    for _ in range(size):
        start, end = rng.choice(["pre", "con", "a", "über", ""]), rng.choice(["tion", "es", "", "ñas"])
        middle = "".join(rng.choice("abé") for _ in range(rng.randrange(3, 7)))
        word = start + middle + end
        if rng.random() < 0.5:
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + "x" + word[k + 1 :], word[:k] + "y" + word[k:]])
        if len(word) >= 7:
            out[word] = rng.choice([2, 3, 25, 40, 300, 5000])
    return dict(out)


@pytest.mark.parametrize("shard", [7, 100, 20_000])
def test_variants_equal_all_pairs(spark, shard):
    words = vocabulary(shard, 900) | {"aaaaaaa": 2, "aaaaaaaa": 30, "aaaaaaaaa": 400, "aaaaaaaaaa": 5000, "zzzzzzz": 5}
    table = spark.createDataFrame([(w, n, 1, "x") for w, n in words.items()], "word string, n long, part int, route string").repartition(4)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.variants(table, shard=shard).collect()}
    assert got == variant_rows(words)
    assert any(x[0] != x[1] and x[0] for x in got.values()) and max(x[3] for x in got.values()) >= 4


def test_one_edit_and_halved_groups():
    words = sorted(vocabulary(5, 400))
    node = spelling_variants.Alike(0, 0)
    node.words = [(w, 1) for w in words]
    for w in words[:150]:
        want = {x for x in words if edited(w, x)}
        assert {x for x in words if spelling_variants.one_edit(w, x)} == want
        by_length = set()
        for length in {len(w) - 1, len(w), len(w) + 1}:
            part = spelling_variants.Alike(0, 0)
            part.words = [(x, 1) for x in words if len(x) == length]
            by_length |= {x for x, _ in part.near(w)}
        assert by_length == want


def brute_counts(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def test_spelling_variants_of_documents_equal_brute_force(spark):
    rng = random.Random(9)
    words = list(vocabulary(1, 300)) + ["Éclairs", "ÀÀÀÀÀÀÀ", "straßen", "x×÷abcde", "short", "naïveté-naïveté", "日本語日本語日本語"]
    docs = [(k if k % 8 else None, " ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(200)))) for k in range(60)]
    docs += [(70, None), (71, ""), (72, "one9two,three"), *docs[:3], (73, " ".join(rng.choice(words) for _ in range(30_000)))]
    table = spark.createDataFrame([(i, t, "w", 1, "r") for i, t in docs], "doc_id long, text string, word string, n int, run string").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.spelling_variants(table).collect()}
    assert got == variant_rows(brute_counts(docs)) and len(got) > 100
    assert spelling_variants.spelling_variants(empty(spark)).count() == 0


def test_short_words_cannot_be_halved(spark):
    with pytest.raises(ValueError, match="code points"):
        spelling_variants.variants(spark.createDataFrame([("abcde", 3)], "word string, n long"))
