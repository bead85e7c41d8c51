"""Language identification by hyperdimensional n-gram profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches

#: Documents are bundled in groups of at most this many code points (a longer document is a group of its own).
GROUP_CHARS, GROUP_DOCS = 200_000, 64
GRAM = 3


@functools.cache
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter; 0 for what is no letter."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@functools.lru_cache(maxsize=4096)
def letter_vector(letter: int, dims: int, seed: int) -> np.ndarray:
    """The random vector of +1 and -1 of a letter; the same on every machine."""
    return np.random.default_rng((seed, letter)).integers(0, 2, dims, np.int8) * np.int8(2) - np.int8(1)


def gram_codes(text: str, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Letter n-grams of the text as integers: lower-cased letters, with one 0 for what lies between words and at both ends.

    A long text is taken in pieces; the last points of a piece go on before the next.
    """
    before = np.zeros(1, np.int64)
    for a in range(0, max(1, len(text)), most):
        points = letter_table()[np.frombuffer(text[a : a + most].encode("utf-32-le", "replace"), np.uint32)]
        points = np.concatenate((before, points, [0] if a + most >= len(text) else []))
        points = points[np.append(True, (points[1:] != 0) | (points[:-1] != 0))].astype(np.int64)
        n = len(points) - GRAM + 1
        if n > 0:
            code = points[:n].copy()
            for k in range(1, GRAM):
                code = (code << 21) | points[k : n + k]
            yield code
        before = points[-(GRAM - 1) :]


def gram_vectors(codes: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """One row per n-gram: its letters' vectors, each rotated by its place, bound by multiplication."""
    out = np.ones((len(codes), dims), np.int8)
    for place in range(GRAM):
        letters, where = np.unique((codes >> (21 * (GRAM - 1 - place))) & 0x1FFFFF, return_inverse=True)
        rolled = np.stack([np.roll(letter_vector(int(x), dims, seed), GRAM - 1 - place) for x in letters])
        out *= rolled[where]
    return out


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and (size + n > GROUP_CHARS or i - start >= GROUP_DOCS):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a group of texts: document and n-gram of each pair that occurs, its count, and the distinct n-grams."""
    owners, codes, counts = [], [], []
    for i, text in enumerate(texts):
        for code in gram_codes(text or ""):
            if len(texts) == 1:  # perhaps a long one: a piece's n-grams are counted before the next
                code, n = np.unique(code, return_counts=True)
            else:
                n = np.ones(len(code), np.int64)
            owners.append(np.full(len(code), i))
            codes.append(code)
            counts.append(n)
    none = np.zeros(0, np.int64)
    which, grams = pd.factorize(np.concatenate([none, *codes]))
    pairs, at = np.unique(np.concatenate([none, *owners]) * max(1, len(grams)) + which, return_inverse=True)
    n = np.bincount(at, np.concatenate([none, *counts]), len(pairs)).astype(np.int64)
    return pairs // max(1, len(grams)), pairs % max(1, len(grams)), n, np.asarray(grams, np.int64)


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): how often each n-gram occurs in the texts of each language."""

    def run(batches):
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            found = []
            for a, b in groups(texts):
                doc, gram, n, grams = counted(texts[a:b])
                found.append(pd.DataFrame({"lang": langs[a:b][doc], "gram": grams[gram], "n": n}).groupby(["lang", "gram"], as_index=False).sum())
            if found:
                table = pd.concat(found).groupby(["lang", "gram"], as_index=False)["n"].sum()
                yield pa.RecordBatch.from_pandas(table.astype({"n": "int64"}), schema=schema, preserve_index=False)

    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col), F.col(lang_col))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 1024, seed: int = 7) -> dict[str, np.ndarray]:
    """A unit prototype vector per language: the bundle of the n-gram vectors of all its texts.

    Bundling is a sum, so the texts are counted first and the counts are
    bundled in parallel. The driver gets dims numbers per language and partition of
    the counts' sum, already added up per language: dims times the languages.
    Rows without text or language teach nothing; languages without any letters
    have no prototype.
    """

    def run(batches):
        for batch in batches:
            table = batch.to_pandas()
            for lang, rows in table.groupby("lang"):
                total = np.zeros(dims)
                for a in range(0, len(rows), 4096):
                    part = rows.iloc[a : a + 4096]
                    total += part["n"].to_numpy(float) @ gram_vectors(part["gram"].to_numpy(), dims, seed)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * dims, "i": np.arange(dims, dtype=np.int32), "x": total.astype(np.int64)})

    bound_batches(docs.sparkSession)
    sums = count_grams(docs, text_col, lang_col).mapInArrow(run, "lang string, i int, x long")
    prototypes: dict[str, np.ndarray] = {}
    for lang, i, x in sums.groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas().itertuples(index=False):
        prototypes.setdefault(lang, np.zeros(dims))[i] = x
    return {k: v / np.linalg.norm(v) for k, v in sorted(prototypes.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, seed: int = 7) -> DataFrame:
    """Per row of docs: its id (and the columns in keep), lang_pred, score.

    score is the cosine between the bundle of all the text's n-grams and the
    nearest prototype, cut to 0..1; of equal cosines the first language by name
    wins. Null texts, texts without a letter, and all texts if nothing was learned
    are `und` with score 0. Whole texts are used. Python gets the texts and returns verdicts;
    the other columns stay with Spark. Columns of docs named lang_pred or score are not kept.
    """
    names = sorted(prototypes)
    dims = len(prototypes[names[0]]) if names else 1
    matrix = np.stack([prototypes[x] for x in names]).astype(np.float32) if names else np.zeros((0, 1), np.float32)
    keep = [x for x in keep or [] if x not in ("lang_pred", "score")]
    bound_batches(docs.sparkSession)

    def judge(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        for a, b in groups(texts) if names else ():
            doc, gram, n, grams = counted(texts[a:b])
            bundle = np.zeros((b - a, dims), np.float32)
            for g in range(0, len(grams), 8192):  # bounds the matrices for texts with very many n-grams
                here = (gram >= g) & (gram < g + 8192)
                counts = np.zeros((b - a, min(8192, len(grams) - g)), np.float32)
                counts[doc[here], gram[here] - g] = n[here]
                bundle += counts @ gram_vectors(grams[g : g + 8192], dims, seed).astype(np.float32)
            norm = np.linalg.norm(bundle, axis=1)
            cosine = bundle @ matrix.T / np.maximum(norm, 1e-9)[:, None]
            letters = np.zeros(b - a, bool)
            letters[doc] = True
            best = cosine.argmax(axis=1)
            for i in np.flatnonzero(letters):
                lang[a + i], score[a + i] = names[best[i]], min(1.0, max(0.0, float(cosine[i, best[i]])))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    told = F.arrow_udf(judge, "lang_pred string, score double")(F.col(text_col))
    rows = docs.select(F.col(id_col), *[F.col(f"`{x}`") for x in keep], told.alias("_told"))
    return rows.select(F.col(f"`{id_col}`"), *[F.col(f"`{x}`") for x in keep], "_told.lang_pred", "_told.score")


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    teach = docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    out = identify(docs, learn(teach))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
