"""SentencePiece, mixing, URL filters, language ID, HTML extraction, vectors and the pipeline."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from solstice.llm import embedding_dedup, html_extract, language_id, mixing, queries, sentencepiece_codec, shared, url_filter

from .data import documents, empty

SF = "/root/testdata/sf0.001"


def test_codec_equals_the_library_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(documents(spark).select("doc_id", "text"))
    out = sentencepiece_codec.encode(docs)
    assert sentencepiece_codec.parity(out).where("not same").count() == 0
    assert out.where("not round_trip or not parity").count() == 0
    back = sentencepiece_codec.decode(out)
    assert back.where("decoded <> replace(coalesce(text, ''), '▁', ' ')").count() == 0
    assert sentencepiece_codec.encode(empty(spark)).count() == 0


def test_codec_keeps_clashing_columns_and_refuses_bad_ids(spark):
    df = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, ids string")
    assert sentencepiece_codec.encode(df).columns == ["doc_id", "text", "ids", "n_tokens", "round_trip", "parity"]
    with pytest.raises(Exception, match="not in the model"):
        sentencepiece_codec.decode(spark.createDataFrame([([99999999],)], "ids array<int>")).collect()


@pytest.fixture(scope="module")
def bpe():
    with open(sentencepiece_codec.MODEL_PATH, "rb") as file:
        data = file.read()
    return sentencepiece_codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30) | st.text("  ▁ab\nthe<s>0xA", max_size=20))
def test_codec_parity_on_any_text(bpe, text):
    codec, library = bpe
    ids = np.frombuffer(codec.encode([text])[0][0], np.int32).tolist()
    assert ids == library.encode(text)
    assert codec.decode([ids])[0] == library.decode(ids)


def unigram(squeeze: bool) -> bytes:
    """A unigram model file written by hand: pieces, scores, byte fallback."""

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3]) + bytes([value]) if number < 16 else bytes([(number << 3) & 127 | 128, number >> 4]) + bytes([value])
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        return bytes([number << 3 | 2]) + bytes([len(value)]) + value if len(value) < 128 else b""

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
    pieces += [("▁", -2.0, 1), ("▁a", -2.5, 1), ("ab", -3.0, 1), ("a", -3.5, 1), ("b", -3.6, 1), ("▁ab", -4.0, 1), ("ba", -4.5, 1), ("c", -5.0, 1), ("abc", -6.5, 1)]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + (field(3, k) if k != 1 else b"")) for p, s, k in pieces)
    trainer = field(3, 1) + field(35, 1)
    return out + field(2, trainer) + field(3, field(1, b"identity") + field(4, int(squeeze)))


@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_models_are_rebuilt(squeeze):
    data = unigram(squeeze)
    codec, library = sentencepiece_codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b", "c", " ", "ab", "é"]) for _ in range(rng.randrange(12)))
        ids = np.frombuffer(codec.encode([text])[0][0], np.int32).tolist()
        assert ids == library.encode(text), text
        assert codec.decode([ids])[0] == library.decode(ids)


def test_only_texts_that_their_pieces_do_not_spell_are_decoded_whole(tmp_path, monkeypatch):
    decode, runs, whole = sentencepiece_codec.Codec.decode, [], []
    monkeypatch.setattr(sentencepiece_codec.Codec, "decode", lambda self, ids: whole.extend(ids) or decode(self, ids))
    monkeypatch.setattr(sentencepiece_codec, "_batches", lambda df, column, run, kind, extra: runs.append(run))
    (tmp_path / "unigram").write_bytes(unigram(False))
    sentencepiece_codec.encode(None, model_path=str(tmp_path / "unigram"))
    texts = ["ab a", "a é  b", "☃☃ ab", "<0x61>", "a<0x61>▁b", "ab", " ", "", None, "▁ c"]
    codec = sentencepiece_codec.Codec(unigram(False))
    ids = [np.frombuffer(codec.encode([x or ""])[0][0], np.int32).tolist() for x in texts]
    want = [x == codec.normalize(y or "")[1:].replace("▁", " ") for x, y in zip(decode(codec, ids), texts, strict=True)]
    assert [texts[i] for i, x in enumerate(want) if not x] == ["<0x61>", "a<0x61>▁b"]  # a unigram model takes this for the byte
    assert runs[0](pa.array(texts))["round_trip"].to_pylist() == want
    assert whole == [ids[3], ids[4]]


def test_damaged_models_are_refused():
    with pytest.raises((ValueError, IndexError)):
        sentencepiece_codec.parse_model(unigram(False)[:-3] + b"\xff")


def test_mix_meets_its_budgets(spark):
    docs = documents(spark).withColumn("domain", mixing.source_domain(F.col("source")))
    out = mixing.mix(docs)
    assert out.count() == docs.count()
    per = out.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("copies")).alias("taken"), F.max("n_tokens").alias("row")).collect()
    assert all(r.taken <= 2 * r.t for r in per)
    total, taken = sum(r.t for r in per), sum(r.taken for r in per)
    assert abs(taken - 0.6 * total) <= sum(r["row"] for r in per)
    assert mixing.mix(empty(spark).withColumn("domain", F.lit("x"))).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000)], "d string, l string, tokens long")
    out = {(r.d, r.l): r.share for r in mixing.budgets(leaves, {"d": {"a": 1, "b": 1}, "l": {}}, 0.5, 1).collect()}
    assert sum(out.values()) == 1005 and out["a", "x"] == 10 and out["a", "y"] in (492, 493) and out["b", "x"] in (502, 503)
    none = mixing.budgets(leaves, {"d": {"a": 0}, "l": {}}, 0.5, 1).where("d = 'a'").agg(F.sum("share")).first()[0]
    assert none == 0


def test_url_rules_and_parts(spark):
    urls = ["https://M.Example.COM/en/7?x#y", "http://x.com/en/9", "https://a.net/de/1", "https://example.net/de/8/", "http://org/es/", "http://notcom/en/", "ftp://b.example.com#f", "no scheme", None, "", "://?q", "http://x.com/de?://y"]
    rows = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(0, urls[0], "again")], "page_id long, url string, host string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows).collect()}
    assert out[0][:3] == ("m.example.com", "/en/7", "example.com/en/7") and out[0][3] == "allow"
    assert out[1][2:] == ("com/en/", "block") and out[2][2:] == ("net/de/", "allow") and out[3][2:] == ("example.net/de/8", "block") and out[4][2:] == ("org/es/", "block")
    assert out[5][2] is None and out[6][:3] == ("b.example.com", "", None)
    assert out[7][:3] == out[8][:3] == out[9][:3] == ("", "", None) and out[10][:2] == ("", "") and out[11][:2] == ("x.com", "/de")
    assert url_filter.filter_urls(rows.where("false")).count() == 0
    one = url_filter.filter_urls(spark.createDataFrame([(1, "http://q.com/en/1"), (2, "http://z.info/")], "page_id long, url string")).collect()
    assert {r.verdict for r in one} == {"block"}


def test_url_model_learns(spark):
    words = {"allow": ["news", "wiki", "blog"], "block": ["bets", "casino", "pills"]}
    rng = random.Random(2)
    rows = [(f"{rng.choice(words[v])}{k}.example.com", f"/p/{k}", v) for k in range(200) for v in words]
    model = url_filter.train(spark.createDataFrame(rows[:300], "host string, path string, verdict string"))
    rest = spark.createDataFrame(rows[300:], "host string, path string, verdict string")
    scored = model.score(rest, url_filter.char_grams(F.col("host"), F.col("path")))
    assert scored.where((F.col("block_score") >= 0.5) == (F.col("verdict") == "block")).count() >= 95


def test_language_is_found_on_held_out_documents(spark):
    out = language_id.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    good = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert good > 0.99 and out.where("score < 0 or score > 1").count() == 0


def test_language_edge_cases(spark):
    docs = documents(spark)
    prototypes = language_id.learn(docs)
    assert sorted(prototypes) == ["de", "en"]
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, prototypes).collect()}
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert out[r.doc_id] == ("und", 0.0)
        else:
            assert out[r.doc_id][0] in prototypes
    assert language_id.learn(empty(spark)) == {} and language_id.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty(spark), prototypes).count() == 0


def test_profiles_are_bound_by_position():
    a, b = (language_id.gram_vectors(np.concatenate(list(language_id.gram_codes(x))), 512, 7).sum(axis=0, dtype=float) for x in ("abcabcabc", "cbacbacba"))
    assert abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b) < 0.6


PAGES = {
    "<nav><a href=x>Menu</a></nav><article><h1>Title &amp; more</h1><p>One,\n two&nbsp;three.<p>Four <b>bold<br>five.</article><footer>foot, foot, foot</footer>": "Title & more One, two three. Four bold five.",
    '<div class="ad">Buy, buy, buy now</div><div id="content"><p>The text, with commas, of this page is here.</p><p>Short.</p></div><div class="comments"><p>a, b, c, d, e, f</p></div>': "The text, with commas, of this page is here. Short.",
    "<main><p>Alone.</p><script>var x='<p>no</p>';</script><form><p>search, here</p></form><style>p{}</style></main>": "Alone.",
    "<div class=sidebar><article><p>The article, kept.</p></article></div>": "The article, kept.",
    "<article><p>Cut off in the mid": "Cut off in the mid",
    "a < b &lt; c &#8364; &#x41;": "a < b < c € A",
    "<!-- <p>x</p> --><p>y</p>": "y",
    "<nav><ul><li><a href=/>only links</a></ul></nav>": "",
    "": "",
}


def test_html_pages(spark):
    pages = spark.createDataFrame([(k, "u", p, "clash") for k, p in enumerate(PAGES)] + [(99, None, None, "x"), (98, "u", "<p>" + "word, " * 50_000, "x")], "page_id long, url string, html string, names string")
    out = {r.page_id: r for r in html_extract.extract(pages, keep=["page_id", "url"]).collect()}
    for k, want in enumerate(PAGES.values()):
        assert out[k].text == want and out[k].n_chars == len(want)
    assert out[99].text == "" and out[98].n_chars == len("word, " * 50_000) - 1
    assert html_extract.extract(pages.where("false")).count() == 0


def cosine_links(vectors):
    ids = [i for i, _ in vectors]
    x = np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    label = np.array(ids)
    for _ in ids:
        label = np.array([label[row].min() for row in link])
    return {i: (int(link[k].sum()) - 1, int(label[k])) for k, i in enumerate(ids)}


@pytest.mark.parametrize("kind, tile", [("float", 4096), ("double", 16), ("float", 16)])
def test_vectors_equal_brute_force(spark, kind, tile):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 12)).astype(np.float32)
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 12)) * 0.15, base[:5], base[:5] * 3]).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    bad = [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [float("nan")] + [1.0] * 11, 1), (1003, [float("inf")] + [1.0] * 11, 1), (1004, [None] + [1.0] * 11, 1), (1005, [1.0, 2.0], 1), (1006, [], 1)]
    table = spark.createDataFrame(rows + bad, f"vec_id long, embedding array<{kind}>, tile int")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table, tile=tile).collect()}
    want = cosine_links([(i, v) for i, v, _ in rows])
    assert {i: out[i][:2] for i in want} == want
    assert all(out[i] == (0, i, True) for i, _, _ in bad) and all(out[i][2] == (out[i][1] == i) for i in out)


def test_tiles_are_many_tasks(spark):
    x = np.random.default_rng(7).normal(size=(80, 8))
    classes = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(x)], "id long, copies long, v array<double>")
    work = embedding_dedup._links(classes, 8, False, 0.9, 4)
    assert work.rdd.getNumPartitions() >= 20  # 210 pairs of tiles, but for some that the first axis rules out, by eights


@pytest.mark.parametrize("spread", [0.02, 0.08, 3.0])
def test_pairs_of_tiles_equal_brute_force(spread):
    rng = np.random.default_rng(8)
    x = np.ones(24) + rng.normal(size=(700, 24)) * spread
    half = rng.normal(size=24)
    half -= half @ x[0] / (x[0] @ x[0]) * x[0]
    for k, c in enumerate((0.9 - 1e-9, 0.9 + 1e-9, 0.9 - 1e-5, 0.9 + 1e-5)):  # cosines with the first that single precision cannot tell from 0.9
        x[690 + k] = c * x[0] / np.linalg.norm(x[0]) + np.sqrt(1 - c * c) * half / np.linalg.norm(half)
    u = embedding_dedup.unit(x)
    axes = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= 0.9), strict=True)}
    one, other = embedding_dedup.side(x, axes), embedding_dedup.side(x[:601], axes)
    pairs = lambda a, b, same: [(int(i), int(j)) for ii, jj in embedding_dedup.linked(a, b, 0.9, same) for i, j in zip(ii, jj, strict=True)]
    found, across = pairs(one, one, True), pairs(one, other, False)
    assert len(set(found)) == len(found) and set(found) == {(i, j) for i, j in want if i < j}
    assert len(set(across)) == len(across) and set(across) == {(i, j) for i, j in want if j < 601}
    assert ((0, 690) in found, (0, 691) in found, (0, 692) in found, (0, 693) in found) == (False, True, False, True)


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_vectors(table).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == [(1, 0, 1, True)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (200, 201), (201, 200)], "src long, dst long")
    out = {r.id: r.component for r in shared.connected_components(edges).collect()}
    assert out == {k: 0 for k in range(61)} | {200: 200, 201: 200}
    assert shared.connected_components(edges.where("false")).count() == 0


def test_sql_of_the_registered_queries(spark):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert sorted(map(str, got[columns].astype(object).values.tolist())) == sorted(map(str, want[columns].astype(object).values.tolist())), name


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    from . import test_text_operators as brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = shared.materialize(corpus_pipeline.language_stage(spark, docs, SF), "t1")
    told = {r.doc_id: r for r in language_id.op7_language_id(spark, SF).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, r in told.items() if r.lang_pred != "und"}
    lines = shared.materialize(corpus_pipeline.line_stage(spark, kept, SF), "t2")
    assert lines.columns == list(corpus_pipeline.COLUMNS) and lines.where("n_chars <> length(text)").count() == 0
    near = shared.materialize(corpus_pipeline.near_duplicate_stage(spark, lines, SF), "t3")
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, _, c in brute.components(rows)})
    mixed = shared.materialize(corpus_pipeline.mixing_stage(spark, near, SF), "t4")
    copies = mixing.mix(near.withColumn("domain", mixing.source_domain(F.col("source"))))
    assert mixed.count() == copies.agg(F.sum("copies")).first()[0]
    out = corpus_pipeline.token_stage(spark, mixed, SF)
    assert out.count() == mixed.count() and out.where("not round_trip").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in mixed.select("doc_id").collect())


def test_language_stage_keeps_short_clean_texts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.1"
    short = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 200 or doc_id % 5 = 0 or text is null")
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, short, sf).collect()}
    rows = short.collect()
    assert kept == {r.doc_id for r in rows if any(c.isalpha() for c in r.text or "")}
    extra = [(10**9 + k, t, "en", "s", len(t)) for k, t in enumerate(["Avec.", "Edrere.", "A.", "Qx", "Zyzzyva."])] + [(10**9 + 9, "12 - 3.", "en", "s", 7), (10**9 + 10, None, "en", "s", 0)]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language_stage(spark, short.select(*corpus_pipeline.COLUMNS).unionByName(more.select(*corpus_pipeline.COLUMNS)), sf)
    assert {r.doc_id for r in out.where("doc_id >= 1000000000").collect()} == {10**9 + k for k in range(5)}


def test_pipeline_of_no_documents(spark):
    import corpus_pipeline

    docs = empty(spark).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_pipeline_stages_take_nulls_repeats_ties_and_clashing_columns(spark):
    """Through all stages, over rows with null ids, texts, languages and sources, repeated rows and columns named like the operators' own."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    odd = spark.createDataFrame([(None, "One line with words.", None, None), (None, None, "en", "src1"), (900, "Tie one. Tie one.", "en", "src1"), (901, "Tie one. Tie one.", "en", "src1")], "doc_id long, text string, lang string, source string")
    rows = documents(spark).unionByName(odd, allowMissingColumns=True).withColumns({"lang_pred": F.lit("x"), "parity": F.lit(1), "component": F.lit(2), "copies": F.lit(3), "_told": F.lit(4)})
    letters = lambda text: any(c.isalpha() for c in text or "")
    want = sorted(str(r.doc_id) for r in rows.collect() if letters(r.text))
    docs, counts = rows, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = shared.materialize(stage(spark, docs, SF), f"test-{name}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if k == 0:
            assert sorted(str(r.doc_id) for r in docs.collect()) == want
        if k == 2:
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(set(texts))  # of equal texts one row stays
    assert counts[0] >= counts[1] >= counts[2] > 0 and counts[3] == counts[4] > 0
    assert docs.where("not round_trip or not parity").count() == 0
    nothing = rows.where("false")
    for name, stage in corpus_pipeline.STAGES:
        nothing = shared.materialize(stage(spark, nothing, SF), f"none-{name}")
    assert nothing.count() == 0


def test_storage_deletes_what_its_own_block_wrote(spark):
    import os
    import threading
    from urllib.parse import urlparse

    from solstice.llm import line_dedup

    others = []

    def other_query():  # of the same application, at the same time
        with shared.Storage(spark) as other:
            others.append((shared.materialize(spark.range(5), "other"), other))

    with shared.Storage(spark) as own:
        kept = line_dedup.dedup_lines(documents(spark)).select("doc_id", "kept").toPandas()
        thread = threading.Thread(target=other_query)
        thread.start()
        thread.join()
        with shared.Storage(spark) as inner:
            shared.materialize(spark.range(2), "inner")
            assert len(inner.paths) == 1
        last = shared.materialize(spark.range(3), "last")
        paths = [urlparse(p).path for p in own.paths]
        tables = {t.name for t in spark.catalog.listTables()}
        assert len(kept) and any(t.startswith("line_run_") for t in tables) and any("/inner-" in p for p in paths)
        own.release(but=1)
        assert [os.path.exists(p) for p in paths] == [False] * (len(paths) - 1) + [True] and last.count() == 3
    frame, other = others[0]
    assert frame.count() == 5 and len(other.paths) == 1
    other.release()
    assert other.paths == []
    assert not {p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in paths} & {t.name for t in spark.catalog.listTables()}


def test_near_duplicate_stage_keeps_one_of_repeated_rows_and_rows_without_id(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, "a b c d e f g"), (None, "a b c d e f g"), (7, "x y"), (8, ""), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in out) == sorted([("1", text), ("None", "a b c d e f g"), ("7", "x y"), ("8", ""), ("8", ""), ("None", "")])


def test_mixing_stage_keeps_to_the_budget_with_repeated_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3]), " ".join(["w"] * rng.randrange(1, 9)), "en", "src0", 1) for _ in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    total = sum(len(r[1].split()) for r in rows)
    taken = sum(len(r.text.split()) for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect())
    assert int(0.6 * total) <= taken < int(0.6 * total) + 8


def test_language_stage_without_languages_goes_by_letters(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "12", None, "s", 1), (2, "ab", None, "s", 1), (3, None, None, "s", 1), (4, "é 1", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.language_stage(spark, docs, SF).collect()) == [2, 4]


def test_url_parts_rules_and_verdicts_equal_brute_force(spark):
    """Over all pages of the smallest tables and odd URLs: host, path and the longest rule by plain string work; rules decide verdicts."""
    odd = ["HTTP://A.COM/en/", "x://com", "x://com/en", "x://com/en/?q", "a://b://c/d", "://", "http://EXAMPLE.COM/EN/7", "http://ÄB.com/en/", "http://a.b.example.net/de/8#x", "http://notexample.net/de/8", "http://org/es/" + "z" * 50_000, "h" * 9000]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    rows = [(r.page_id, r.url) for r in pages.collect()] + [(10**6 + k, u) for k, u in enumerate(odd)] + [(None, "http://www.com/en/x"), (5, None)]

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        for mark in "#?":
            rest = rest.split(mark)[0]
        host, path = rest.split("/", 1)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), ""
        if "/" in rest:
            path = "/" + rest.split("/", 1)[1]
        fits = [(len(rule), rule, verdict) for verdict, rule in url_filter.RULES if (f".{host}").endswith("." + rule.split("/", 1)[0]) and path.startswith("/" + rule.split("/", 1)[1])]
        return host, path, max(fits)[1:] if fits else (None, None)

    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    key = lambda x: (str(x[0]), x[1], x[2], str(x[3]))
    want = sorted(((i, h, p, rule) for i, u in rows for h, p, (rule, _) in [brute(u)]), key=key)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == want
    verdict = {rule: v for v, rule in url_filter.RULES}
    assert all(r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got)


def test_language_equals_direct_bundling(spark):
    """The same by one vector per letter, one product per n-gram and one sum per occurrence."""
    dims = 256

    def bundle(text):
        letters = "".join(x.lower() if x.isalpha() and len(x.lower()) == 1 else x if x.isalpha() else " " for x in text or "")
        letters = " " + " ".join(letters.split()) + " " if letters.strip() else " "
        total = np.zeros(dims)
        for k in range(len(letters) - 2):
            parts = [np.roll(language_id.letter_vector(0 if c == " " else ord(c), dims, 7), 2 - place) for place, c in enumerate(letters[k : k + 3])]
            total += parts[0] * parts[1] * parts[2].astype(float)
        return total

    docs = documents(spark).where("length(text) < 3000 or text is null")
    rows = docs.collect()
    bundles = {id(r): bundle(r.text) for r in rows}
    want = {}
    for r in rows:
        if r.lang and r.text is not None:
            want[r.lang] = want.get(r.lang, 0) + bundles[id(r)]
    want = {k: v / np.linalg.norm(v) for k, v in want.items()}
    got = language_id.learn(docs, dims=dims)
    assert sorted(got) == sorted(want) and all(np.abs(got[k] - want[k]).max() < 1e-9 for k in want)
    out = {(r.doc_id, r.text): r for r in language_id.identify(docs, got, keep=["text"]).collect()}
    for r in rows:
        b = bundles[id(r)]
        if b.any():
            scores = {k: b @ v / np.linalg.norm(b) for k, v in want.items()}
            told = out[r.doc_id, r.text]
            assert abs(told.score - max(0, max(scores.values()))) < 1e-4
            assert abs(scores[told.lang_pred] - max(scores.values())) < 1e-4


def test_languages_of_long_texts_are_counted_in_pieces():
    text = "Ab, c d'E ff  g" * 20
    whole = np.concatenate(list(language_id.gram_codes(text)))
    for most in (1, 2, 3, 7, 100):
        assert (np.concatenate(list(language_id.gram_codes(text, most))) == whole).all()


def test_words_of_long_texts_are_hashed_in_pieces():
    import pyarrow as pa

    from solstice.llm import hashing

    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "c", " ", "\n", "x" * 40, "é"]) for _ in range(4000))
    want = next(hashing.shingle_sets(pa.array([text]), most=1 << 20))
    for most in (16, 100, 5000):
        assert (next(hashing.shingle_sets(pa.array([text]), most=most)) == want).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<article>", "</article>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<a href='x'>", "</a>", "One, two. ", "&amp;", "<", "\"", "<div title=\"hidden class=ad\">", "<nav>", "</nav>", "<br>", "<td>", "<tr>", "<script>x</script>", "<!-- c -->"]), max_size=40))
def test_scores_from_the_leaves_up_equal_a_walk_to_the_root(pieces):
    """Scores, sizes and links of each element, against a walk from every block to the root."""
    page = html_extract.parse("".join(pieces))
    n = len(page.names)
    assert all(page.parents[i] < i for i in range(1, n))
    points = [0.0] * n
    direct = [0.0] * n
    for node, text, _ in page.blocks:
        points[node] += len(text)
        share, up = 1.0, node
        while up:
            direct[up] += len(text) * share
            up, share = page.parents[up], share / 2
        direct[0] += len(text) * share
    assert np.allclose(html_extract.summed_up(points, page.parents, 0.5), direct)
    assert html_extract.main_text("".join(pieces)) is not None


@pytest.mark.parametrize("attribute", ['title="hidden gem"', 'data-hidden="false"', 'data-class="ad"', 'data-role="search"', 'aria-label="class=menu"', "alt='role=banner'", 'class=text class="ad"', "style='color:red'", 'aria-hidden="false"'])
def test_attributes_are_read_by_name(attribute):
    page = f"<article><p>One, two.</p><div {attribute}><p>Three, four words.</p></div></article>"
    assert html_extract.main_text(page) == "One, two. Three, four words."


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN=''", 'class="x ad"', "id=sidebar", "role='search'", "aria-hidden=true", "style='display: none'", "title='a' class=\"siteNav\""])
def test_unwanted_attributes_hide(attribute):
    assert html_extract.main_text(f"<article><p>One, two.</p><div {attribute}><p>Three, four.</p></div></article>") == "One, two."


def test_deep_and_broken_pages_take_time_in_proportion():
    import time

    took = []
    for k in (2000, 16_000):
        begin = time.perf_counter()
        for page in ("<div>" * k + "<p>One, two.", "<a \"" * k, "<li></x>" * k, "<b " * k, "<!--" * k, "<ul><li>" * k + "</li>" * k):
            html_extract.main_text(page)
        took.append(time.perf_counter() - begin)
    assert took[1] < 30 * took[0] + 1


PROSE = "<p>One, two and three, as it was said before.</p><p>Second one, with words that go on for a while, and more.</p>"
ARTICLE = f"<article>{PROSE}</article>"
TOLD = "One, two and three, as it was said before. Second one, with words that go on for a while, and more."


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="single-post comments-open">{ARTICLE}</body>', f'<body class="comments">{ARTICLE}</body>', f'<article class="post comments-open">{PROSE}</article>', f'<article class="comments">{PROSE}</article>',
        f'<main id="comment-policy">{PROSE}</main>', f'<main class="widget">{PROSE}</main>', f'<div class="content-with-sidebar">{ARTICLE}</div>', f'<div class="page-header-image-wrapper">{ARTICLE}</div>',
        f'<div class="sidebar">{PROSE}</div>', f"<form><div>{PROSE}</div></form>", f'<form class="ad"><div id="footer">{PROSE}<nav>Home</nav></div></form>', f'<div role="dialog">{ARTICLE}</div>',
        f'{ARTICLE}<div class="sidebar"><p>Beside it.</p></div>', f'<div id="text">{PROSE}</div><div class="comments"><p>{"What readers say, at length. " * 40}</p></div>',
        f'{ARTICLE}<article class="comment"><p>Hi.</p></article>', f'{ARTICLE}<footer><p>Rights.</p></footer><div class="cookie-notice3"><p>Cookies.</p></div><div id="adSlot">Buy.</div>',
        f"<header><p>Site.</p></header>{ARTICLE}<aside><p>Aside.</p></aside>", f'<div class="widget"><div class="promo-box"><p>Buy.</p></div>{PROSE}{PROSE.replace("<p>", "<p hidden>")}</div>',
    ],
)
def test_marks_are_weighed_against_the_page(page):
    assert html_extract.main_text(page) == TOLD


def test_names_that_only_look_like_hints_keep_their_text():
    page = f'<article>{PROSE}<div class="related-work"><p>Related work.</p></div><section id="social-science"><p>Social science.</p></section><div class="ad">Buy.</div></article>'
    assert html_extract.main_text(page) == f"{TOLD} Related work. Social science."
    assert html_extract.main_text("<footer><div>Rights.</div></footer><nav>Menu</nav>") == ""


def left_out(page):
    """stripped(), by walking down from the root and weighing all marked elements anew after each mark that falls."""
    marks = list(page.marks)
    n = len(marks)
    soft = (html_extract.SOFT, html_extract.COMMENTS)

    def up(i):
        while i:
            yield i
            i = page.parents[i]

    def text(i):
        return sum(len(w) - k for node, w, k in page.blocks if (not i or i in up(node)) and not any(page.marks[x] == html_extract.HARD for x in up(node)))

    def prose(i):
        ps = sum(page.names[node] == "p" for node, _, _ in page.blocks if (not i or i in up(node)) and not any(page.marks[x] == html_extract.HARD for x in up(node)))
        return ps + sum(page.names[x] in ("article", "main") for x in range(1, n) if not i or i in up(x))

    held = set()
    while True:
        tops = [i for i in range(1, n) if marks[i] in soft and not any(marks[x] in soft for x in up(page.parents[i]))]
        outside, paragraphs = text(0) - sum(map(text, tops)), prose(0) - sum(map(prose, tops))
        for i in sorted(set(tops) - held, key=lambda i: (-text(i), i)):
            if outside >= text(i) / 4:
                return [any(marks[x] for x in up(i)) for i in range(n)]
            held.add(i)
            if prose(i) and not (marks[i] == html_extract.COMMENTS and paragraphs):
                marks[i] = html_extract.NONE
                break
        else:
            return [any(marks[x] for x in up(i)) for i in range(n)]


PIECES = ["<div>", "</div>", "<p>", "</p>", "<article>", "</article>", '<div class="comments">', '<div class="ad">', "<nav>", "</nav>", "<form>", "</form>", "<a href='x'>", "</a>", "One, two. ", "Some more words, and others, for weight. " * 4, "<div hidden>", '<section id="sidebar">', "</section>", "<footer>", "</footer>", "<main>", "</main>"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_stripped_equals_weighing_anew(pieces):
    page = html_extract.parse("".join(pieces))
    assert html_extract.stripped(page) == left_out(page)


def test_pages_with_paragraphs_give_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in pages:
        page = html_extract.parse(r.html)
        assert html_extract.stripped(page) == left_out(page)
        assert html_extract.main_text(r.html) or not any(page.names[node] == "p" and len(w) > k for node, w, k in page.blocks)
