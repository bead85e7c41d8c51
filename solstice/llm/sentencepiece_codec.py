"""SentencePiece encoding and decoding on the tokenizers library."""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches

#: A public model; a parameter everywhere.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts are encoded in slices of about so many code points; so many distinct words are remembered by a task.
SLICE_CHARS, WORDS_KEPT = 1_000_000, 400_000
#: Bytes of words and ids that a worker remembers at most, beyond those of one slice, and of an entry besides its content: words may be long, whole texts where pieces span words.
BYTES_KEPT, ENTRY = 48 << 20, 160


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of a protobuf message; 32-bit fields come as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        if at + size > len(data):
            raise ValueError("the model file ends inside a field")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says, read from its protobuf."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse_model(data: bytes) -> Model:
    out = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(fields(value))
            out.model_type, out.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            out.suffix = bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(fields(value))
            out.charsmap = spec.get(2, b"")
            out.dummy_prefix, out.squeeze, out.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    if out.model_type not in (UNIGRAM, BPE) or out.suffix or not out.escape or any(k in (USER_DEFINED, UNUSED) for _, _, k in out.pieces):
        raise ValueError("only unigram and BPE models with a leading space mark and without user-defined or unused pieces are supported")
    return out


class Codec:
    """Encodes and decodes like the model file's own library, by a tokenizers backend."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, decoders, models, normalizers

        self.data, self.model = data, (m := parse_model(data))
        unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
        if m.model_type == UNIGRAM:
            # What is no ordinary piece must never match a text.
            floor = min((s for _, s, k in m.pieces if k == NORMAL), default=0.0) - 1e6
            vocab = [(p, s if k == NORMAL else floor) for p, s, k in m.pieces]
            core = models.Unigram(vocab, unk_id=unknown, byte_fallback=m.byte_fallback)
        else:
            score = {p: s for p, s, k in m.pieces if k == NORMAL}
            merges = [(-s, p[:k], p[k:]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
            merges.sort(key=lambda x: x[0])  # stable: equal scores stay in the order of the file
            core = models.BPE(
                vocab={p: i for i, (p, _, _) in enumerate(m.pieces)}, merges=[x[1:] for x in merges], cache_capacity=0,
                unk_token=None if unknown is None else m.pieces[unknown][0], byte_fallback=m.byte_fallback, fuse_unk=True,
            )
        self.tokenizer = Tokenizer(core)
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        self.tokenizer.decoder = decoders.Sequence([*steps, *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
        self.tokenizer.encode_special_tokens = True
        self.charsmap = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        # Where no piece goes on behind a letter with a mark, words are independent of each other.
        split = not any(MARK in p.lstrip(MARK) for p, _, k in m.pieces if k == NORMAL)
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if split else "(?s:.+)")
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.library = None
        self.odd: set[str] = set()
        # What the decoder makes of a piece, in text and in bytes. A piece named like a byte is one to it; its text here is one that no text holds.
        byte = [re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) for p, _, _ in m.pieces]
        self.spelled = ["\ud800" if b else p for b, (p, _, _) in zip(byte, m.pieces, strict=True)]
        self.spelled_bytes = [bytes([int(p[3:5], 16)]) if b else p.encode() for b, (p, _, _) in zip(byte, m.pieces, strict=True)]
        self.unlike: set[str] = set()

    def normalize(self, text: str) -> str:
        """The text as the model sees it: its character map, then white space as marks."""
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return text
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """The ids of each text, as 32-bit integers, whether they are the library's, and whether the pieces of each of its words spell it.

        Words not met before go to the library together, which uses its threads.
        """
        words = [self.words.findall(self.normalize(x)) for x in texts]
        here = set(chain.from_iterable(words))
        if len(self.known) > WORDS_KEPT or self.held > BYTES_KEPT:
            # What these texts hold is likely to come again.
            self.known = {x: self.known[x] for x in self.known.keys() & here}
            self.odd &= here
            self.unlike &= here
            self.held = sum(len(v) + 2 * len(k) + ENTRY for k, v in self.known.items())
        new = list(here - self.known.keys())
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        self.verify(new, ids)
        self.spell(new, ids)
        flat, at = np.array(list(chain.from_iterable(ids)), np.int32).tobytes(), 0
        for word, n in zip(new, map(len, ids), strict=True):
            self.known[word] = flat[at : at + 4 * n]
            self.held += 4 * n + 2 * len(word) + ENTRY
            at += 4 * n
        right, spelled = ([s.isdisjoint(x) for x in words] if s else [True] * len(words) for s in (self.odd, self.unlike))
        return [b"".join(map(self.known.__getitem__, x)) for x in words], right, spelled

    def verify(self, words: list[str], found: list[list[int]]) -> None:
        """Notes the words whose ids differ from what the model file's own library gives for them.

        Where words depend on each other, a word is a whole text, and its first mark is the library's own.
        """
        if self.library is None:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        start = int(self.model.dummy_prefix)
        right = self.library.encode([x[start:].replace(MARK, " ") for x in words], num_threads=1)
        if right != found:
            self.odd.update(word for word, a, b in zip(words, right, found, strict=True) if a != b)

    def spell(self, words: list[str], found: list[list[int]]) -> None:
        """Notes the words that their pieces, one behind the other, don't spell.

        A text of other words is decoded right: bytes of a word make whole characters, so no words are decoded otherwise together than alone.
        """
        piece, part = self.spelled.__getitem__, self.spelled_bytes.__getitem__
        left = [(w, x) for w, x in zip(words, found, strict=True) if "".join(map(piece, x)) != w]
        self.unlike.update(w for w, x in left if b"".join(map(part, x)) != w.encode())

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=True)


@functools.lru_cache(maxsize=4)
def codec(data: bytes, threads: int) -> Codec:
    """One per worker process and model; the library starts its threads at its first batch."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    return Codec(data)


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of about `most` in length; a longer row is a range of its own."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def _batches(df: DataFrame, column: str, run, kind: str, extra: str) -> DataFrame:
    """Adds what run() makes of a column, slice by slice; the other columns pass through as Arrow."""

    def work(batches):
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            size = pc.fill_null(pc.binary_length(last) if kind == "text" else pc.list_value_length(last), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(size, SLICE_CHARS):
                part = batch.slice(a, b - a)
                made = run(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made.values()], names=[*part.schema.names[:-1], *made])

    bound_batches(df.sparkSession)
    rest = [x for x in df.columns if x not in [y.split()[0] for y in extra.split(", ")]]
    rows = df.select(*[F.col(f"`{x}`") for x in rest], F.col(column).alias("_codec_in"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + [extra])
    return rows.mapInArrow(work, schema)


def encode(df: DataFrame, text_col: str = "text", model_path: str = MODEL_PATH, threads: int = 2) -> DataFrame:
    """df with ids array<int>, n_tokens long, round_trip boolean and parity boolean.

    ids are what the model file's own library gives for the whole text, without
    begin or end marks. round_trip says that decoding them gives the normalised text
    again: its words' pieces spell it, or the tokenizers backend decodes the whole text and the result is compared; parity, that each of its words has the ids that the library gives for it. Null and empty texts have no ids, and both are true. Rows are
    independent: repeated rows are each encoded. Columns of df named ids, n_tokens,
    round_trip or parity are replaced; all others stay. No rows give no rows. The model
    file is read by the driver and sent to the tasks; it is of a fixed size.
    """
    with open(model_path, "rb") as file:
        data = file.read()

    def run(column):
        c = codec(data, threads)
        texts = [x or "" for x in column.to_pylist()]
        found, right, same = c.encode(texts)
        flat = np.frombuffer(b"".join(found), np.int32)
        ends = np.cumsum([0, *(len(x) // 4 for x in found)])
        doubt = [i for i, x in enumerate(same) if not x]
        for i, back in zip(doubt, c.decode([np.frombuffer(found[i], np.int32).tolist() for i in doubt]) if doubt else (), strict=True):
            same[i] = back == c.normalize(texts[i])[c.model.dummy_prefix :].replace(MARK, " ")
        return {
            "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
            "n_tokens": pa.array(np.diff(ends), pa.int64()),
            "round_trip": pa.array(same, pa.bool_()),
            "parity": pa.array(right, pa.bool_()),
        }

    return _batches(df, text_col, run, "text", "ids array<int>, n_tokens long, round_trip boolean, parity boolean")


def decode(df: DataFrame, ids_col: str = "ids", model_path: str = MODEL_PATH, threads: int = 2) -> DataFrame:
    """df with decoded string, the text of its ids; the column of ids stays.

    Null and empty ids give ''. Ids outside the model fail. Byte pieces that are
    not valid UTF-8 give replacement characters.
    """
    with open(model_path, "rb") as file:
        data = file.read()

    def run(column):
        c = codec(data, threads)
        rows = [x or [] for x in column.to_pylist()]
        if any(i is None or not 0 <= i < len(c.model.pieces) for x in rows for i in x):
            raise ValueError("an id is not in the model")
        return {"decoded": pa.array(c.decode(rows), pa.string())}

    return _batches(df, ids_col, run, "ids", "decoded string")


def parity(df: DataFrame, text_col: str = "text", ids_col: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """df with same boolean: whether the ids are those of the model file's own library for the text."""
    with open(model_path, "rb") as file:
        data = file.read()

    def run(column):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=data)
        rows = column.to_pylist()
        return {"same": pa.array([p.encode(x["t"] or "", num_threads=1) == (x["i"] or []) for x in rows], pa.bool_())}

    both = df.withColumn("_both", F.struct(F.col(text_col).alias("t"), F.col(ids_col).alias("i")))

    def work(batches):
        for batch in batches:
            made = run(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made.values()], names=[*batch.schema.names[:-1], "same"])

    rest = both.select(*[F.col(f"`{x}`") for x in df.columns if x != "same"], "_both")
    return rest.mapInArrow(work, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema[:-1]] + ["same boolean"]))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", "ids", "round_trip", "parity")
