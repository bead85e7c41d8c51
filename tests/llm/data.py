"""Small documents with every kind of trouble."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n int, cls long, batch int, h1 long, lines string, score double, ids string, bucket int, label string"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def texts():
    rng = random.Random(7)
    base = words(rng, 120)
    near = []
    for k in range(8):  # near copies: a few words differ
        copy = list(base)
        for _ in range(k % 3):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
        near.append(" ".join(copy))
    line = "This is a line that very many documents have in common, word for word."
    shared = [f"{' '.join(words(rng, 30))}\n  {line.upper() if k % 2 else line}\t\n{' '.join(words(rng, 5))}\n{line}" for k in range(9)]
    odd = [None, "", " ", "\n\n", "a", "A b", "ä ö ü ß", "日本語のテキスト" * 30, "\U0001f600 é é   x\x00y", "ab" * 300, "a" * 700, " ".join(words(rng, 30_000))]
    passage = " ".join(words(rng, 60))
    passages = [f"{' '.join(words(rng, 20))} {passage} {' '.join(words(rng, 20))}" for _ in range(5)]
    return near + near[:3] + shared + odd + odd[:4] + passages + [" ".join(words(rng, rng.randrange(1, 90))) for _ in range(25)]


def documents(spark):
    rows = [(k, t, ["en", "de", None][k % 3], f"src{k % 4}" if k % 7 else None, 1, k % 2, 1, 3, 0, 5, "x", 0.5, "i", 9, "l") for k, t in enumerate(texts())]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
