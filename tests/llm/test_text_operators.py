"""Line dedup, repeated strings, Jaccard join and media columns against brute force."""

import hashlib
import os
import random
import tarfile
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from solstice.llm import hashing, jaccard_join, line_dedup, media_columns, suffix_dedup

from .data import A_TO_Z, WHITE, documents, empty, texts


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_line_dedup_equals_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, (r.text or "").split("\n")) for r in docs.collect()]
    having = defaultdict(set)
    for i, lines in rows:
        for line in lines:
            if len(k := line.strip(WHITE).translate(A_TO_Z)) >= 40:
                having[k].add(i)
    keeper = {k: max(v) for k, v in having.items() if len(v) >= 5}
    want = sorted((i, "\n".join(x for x in lines if keeper.get(x.strip(WHITE).translate(A_TO_Z), i) == i)) for i, lines in rows)
    assert collected(line_dedup.dedup_lines(docs, keep=["source"]), "doc_id", "kept") == want
    assert any(k for k in keeper)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    for k in range(5):
        batch = spark.createDataFrame([(k, 0, 1, 10 - k), (7, 7, 1, 20 - k)], "h1 long, h2 long, n long, doc_id long")
        assert runs.add(batch).count() == (2 if k == 0 else 1)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert collected(runs.common(5), "h1", "keeper") == [(7, 20)]


def repeated(rows, size):
    seen = Counter(b[i : i + size] for _, b in rows for i in range(len(b) - size + 1))
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        yield i, len(b), sum(gone), spans, kept


@pytest.mark.parametrize("size, batch", [(200, 1000), (16, 1000), (16, 3), (2, 7)])
def test_repeats_equal_brute_force(spark, monkeypatch, size, batch):
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    docs = documents(spark) if size == 200 else documents(spark).where("length(text) < 1000 or text is null")
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, size=size).collect()]
    assert sorted(got) == sorted(repeated(rows, size))
    assert sum(r[2] for r in got) > 0


def test_repeats_of_no_documents(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    assert suffix_dedup.remove_repeats(documents(spark).where("text is null")).select("n_bytes", "n_removed").distinct().collect() == [(0, 0)]


def test_long_texts_are_sampled_in_parts(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abc") for _ in range(5000)) + "x" * 500
    key = np.zeros(1, np.int64)
    whole = suffix_dedup.all_spots(pa.array([text]), key, key, 64)
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    parts = suffix_dedup.all_spots(pa.array([text]), key, key, 64)

    def covered(rows):
        at, n, _ = suffix_dedup.unpacked(rows["place"])
        return sorted(a + k for a, m in zip(at.tolist(), n.tolist()) for k in range(m))

    assert covered(parts) == covered(whole) == list(range(5500 - 64 + 1))


@pytest.mark.parametrize("batch", [1000, 5])
def test_a_very_common_passage_in_different_places(spark, monkeypatch, batch):
    """In most texts, each with other text around it, at other distances, sometimes with a slip, sometimes twice; long texts in parts."""
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    monkeypatch.setattr(suffix_dedup, "SLICE", 900)
    rng = random.Random(batch)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, texts = some(260), []
    for k in range(60):
        body = list(passage)
        if k % 3 == 0:
            body[rng.randrange(len(body))] = "#"
        texts.append(some(rng.randrange(250)) + "".join(body[rng.randrange(40) :]) + some(rng.randrange(250)) + ("".join(body) if k % 7 == 0 else "") + (some(2500) if k % 20 == 0 else ""))
    texts += texts[:4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(repeated([(k, t.encode()) for k, t in enumerate(texts)], 200))
    assert sum(r[2] > 0 for r in got) > 40


def brute_sets(rows):
    for i, t in rows:
        w = [x for x in "".join(" " if c in WHITE else c for c in (t or "")).translate(A_TO_Z).split(" ") if x]
        yield i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = list(brute_sets(rows))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[max(top(a), top(b))] = min(top(a), top(b))
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least[top(k)], i)
    return sorted((i, len(s), least[top(k)]) for k, (i, s) in enumerate(sets))


def test_jaccard_equals_brute_force(spark):
    docs = documents(spark)
    want = components([(r.doc_id, r.text) for r in docs.collect()])
    assert collected(jaccard_join.jaccard_components(docs), "id", "n", "component") == want
    assert len({c for _, _, c in want}) < len(want) - 10


@pytest.mark.parametrize("first, part, leaf, depth", [(0, 500, 8, 64), (8, 3, 1, 2), (0, 4, 1, 64), (0, 500, 1, 3)])
def test_tries_alone_find_all_links(spark, monkeypatch, first, part, leaf, depth):
    """Random near copies, chains included, by the tries with or without hubs, with branches in many parts and with tries of any depth."""
    for name, value in (("FIRST", first), ("PART", part), ("LEAF", leaf), ("DEPTH", depth)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(first)
    rows, base = [], [f"v{rng.randrange(60)}" for _ in range(70)]
    for k in range(40):
        if k % 8 == 0:
            base = [f"v{rng.randrange(60)}" for _ in range(rng.randrange(30, 90))]
        base = list(base)
        base[rng.randrange(len(base))] = f"z{k}"
        if k % 3 == 0:
            base += [f"y{k}"]
        rows.append((k, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(jaccard_join.jaccard_components(docs), "id", "n", "component") == components(rows)


def test_tries_find_sets_of_unequal_sizes(spark, monkeypatch):
    """Sets of 5 to 40 n-grams and the same with a few more, besides sets that share n-grams of their prefixes but don't link."""
    monkeypatch.setattr(jaccard_join, "FIRST", 0)
    monkeypatch.setattr(jaccard_join, "LEAF", 1)
    rng = random.Random(11)
    texts = []
    for k in range(100):
        base = [f"b{k}.{i}" for i in range(rng.randrange(9, 45))]
        more = [f"m{k}.{i}" for i in range((len(base) - 4) // 4)]
        texts += [base, base + more]
        for at in range(0, len(base) - 4, 7):
            texts.append([f"o{k}.{at}.{i}" for i in range(len(base))] + base[at : at + 11])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows)
    assert collected(jaccard_join.jaccard_components(docs, common=1.0), "id", "n", "component") == want
    assert sum(i != c for i, _, c in want) >= 100


@pytest.mark.parametrize("large", [4000, 3])
def test_jaccard_of_another_percent(spark, monkeypatch, large):
    """Contained sets of a bit over half the size link at 50 per cent; a size band that is a quarter wide would be skipped."""
    monkeypatch.setattr(jaccard_join, "FIRST", 0)
    monkeypatch.setattr(jaccard_join, "PART", large)
    rng = random.Random(large)
    texts = []
    for k in range(12):
        base = [f"b{k}.{i}" for i in range(rng.randrange(30, 120))]
        texts += [base[: 4 + -(-(len(base) - 4) * p // 100)] for p in (100, 70, 52, 45)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = dict(brute_sets(rows))
    least = {}
    for i in sets:  # of contained sets the smallest id is the largest set
        least[i] = min(least.get(j, j) for j in sets if j <= i and 100 * len(sets[i] & sets[j]) >= 50 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collected(jaccard_join.jaccard_components(docs, percent=50, common=1.0), "id", "component")
    assert got == sorted(least.items())


@pytest.mark.parametrize("percent", [5, 30, 50, 70, 80, 95, 100])
def test_linked_sizes_are_in_neighbouring_bands(percent):
    assert all(jaccard_join.size_band(100 * n // percent, percent) - jaccard_join.size_band(n, percent) <= 1 for n in range(1, 3000))


def test_jaccard_of_no_documents(spark):
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None), (3, " ")], "doc_id long, text string")
    assert collected(jaccard_join.jaccard_components(nulls), "id", "n", "component") == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_set_bounds():
    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = hashing.mix(np.arange(1, rng.integers(2, 900), dtype=np.uint64)) >> np.uint64(2)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, len(pool) + 1))) for _ in range(2))
        common = len(np.intersect1d(x, y))
        assert (len(x) + len(y) - jaccard_join.differing(jaccard_join.parities(x), jaccard_join.parities(y))) // 2 >= common
        assert (100 * common >= 80 * (len(x) + len(y) - common)) == (common >= jaccard_join.needed(len(x), len(y), 80))
    assert [jaccard_join.prefix_length(n, 80) for n in (0, 1, 4, 5, 10)] == [0, 1, 1, 2, 3]


def test_shingles_in_any_slices():
    column = pa.array(texts())
    a, b = (list(hashing.shingle_sets(column, most=m)) for m in (50, 1 << 20))
    assert all((x == y).all() for x, y in zip(a, b)) and [len(x) for x in a] == [len(s) for _, s in brute_sets(enumerate(texts()))]


def test_media_equal_brute_force(spark, tmp_path):
    docs = documents(spark)
    folder = f"file://{tmp_path}/media"
    out = media_columns.media_columns(docs, folder).collect()
    by_id = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(out) == docs.count()
    for r in out:
        data = by_id[r.id].encode()
        payload = data + b" " * (192 * max(1, -(-len(data) // 192)) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.width, r.height, r.bits) == (len(data), len(payload), 192, len(payload) // 192, 8)
        assert r.read_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        with open(os.path.join(urlparse(folder).path, r.shard), "rb") as shard:
            shard.seek(r.offset)
            stored = shard.read(r.length)
        assert hashlib.sha256(stored).hexdigest() == r.digest and media_columns.from_png(stored) == payload and media_columns.feature(payload) == r.feature
    assert len({(r.shard, r.offset) for r in out}) == len({r.digest for r in out}) == len({by_id[r.id].encode() + b" " * (-len(by_id[r.id].encode()) % 192 if by_id[r.id] else 192) for r in out})
    names = [m.name for f in os.listdir(tmp_path / "media") for m in tarfile.open(tmp_path / "media" / f)]
    assert {n[:-4] for n in names} == {r.digest for r in out}


def test_small_shards_and_damage(spark, tmp_path):
    docs = documents(spark).where("length(text) < 500")
    folder = f"file://{tmp_path}/media"
    stored = media_columns.store(docs, folder, shard_bytes=4000)
    assert stored.select("shard").distinct().count() > 1
    at = media_columns.places(stored)
    assert media_columns.payload_columns(at, folder).count() == at.count() == media_columns.header_columns(at, folder).where("width = 192").count()
    with pytest.raises(Exception, match="digest"):
        media_columns.payload_columns(at.withColumn("offset", F.col("offset") + 1), folder).count()
    with pytest.raises(ValueError):
        media_columns.png_header(b"?" * 33)


def test_media_of_no_documents(spark, tmp_path):
    assert media_columns.media_columns(empty(spark), f"file://{tmp_path}/media").count() == 0
