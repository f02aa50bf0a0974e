"""Small documents tables with the cases that every operator defines a result for."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ta ko mi ru ne so la vi po de chi an er on".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    out = []
    while n > 0:
        k = min(n, rng.randint(6, 18))
        out.append(" ".join(word() for _ in range(k)).capitalize() + ".")
        n -= k
    return "".join(s + ("\n" if i % 3 == 2 else " ") for i, s in enumerate(out)).strip()


def rows(n: int = 60) -> list[tuple]:
    """Prose, exact and near copies, repeated rows, nulls in every column, empty and very long texts."""
    out = []
    for i in range(n):
        text = prose(i, 30 + i * 7 % 200)
        if i % 7 == 3:
            text = prose(i - 3, 30 + (i - 3) * 7 % 200)
        if i % 7 == 5:
            words = text.split(" ")
            text = " ".join([*words[: len(words) // 2], "Zyx", *words[len(words) // 2 :]])
        out.append((i, text, ["en", "de"][i % 2], f"s{i % 3}", len(text)))
    out += [
        (n, None, "en", "s0", None),
        (n + 1, "", "en", "s0", 0),
        (n + 2, " \n\t ", None, "s0", 4),
        (n + 3, prose(999, 9000), "en", None, None),
        (n + 4, "ÀÉ ñandú 東京 😀 ok\x0bTab\tend  two   three \n\n x\r\n", None, None, 3),
        (n + 5, "a", "en", "s0", 1),
        (n + 6, "x" * 5000, "en", "s0", 5000),
        (None, "No name here at all, and some more words.", "en", "s0", 1),
    ]
    return out + [out[4], out[4], out[n]]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(df):
    """``df`` with further columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    for name in ("shard", "slot", "bucket", "ids", "fingerprint", "n_words", "kept", "line", "score", "key", "file", "rep", "a", "b", "copies", "_of", "_text", "_t", "_of_lang", "_row_key", "words", "features", "row", "gone", "h", "g", "own"):
        df = df.withColumn(name, F.lit("x"))
    return df
