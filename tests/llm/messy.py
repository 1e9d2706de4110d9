"""Small tables that hold what operators must bear."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, node string, word string, found string, "
          "_found string, verdict string, block int, bucket int, key string, sha string, doc string, _doc string, n int")


def words(seed: int, count: int, stem: str = "w") -> str:
    draw = random.Random(seed)
    return " ".join(f"{stem}{draw.randrange(400)}" for _ in range(count))


def rows() -> list[tuple]:
    long = words(1, 20_000)
    texts = [
        None, "", " ", "\n\n", "one", "one two three", "ONE  two\tthree", "one two three", words(2, 60), words(2, 60),
        words(2, 60) + " more", words(3, 200), words(3, 200).replace("w7 ", "w8 "), words(3, 200).upper(), long, long + " end",
        "Straße ñandú été 中文 😀", "a\nb\nc\nd\n" + words(4, 30), "a\nb\nc\nd\n" + words(5, 30), "!!! 123", "\x00 nul \x00",
    ]
    out: list[tuple] = [(i, t, "en" if i % 3 else None, None, None) for i, t in enumerate(texts)]
    out += [(None, "one two three", "en", "s", 1), (None, None, None, None, None), (8, texts[8], "en", "s", 1), (8, texts[8], "en", "s", 1),
            (9, "another text under a known id", "de", "s", 1), (-5, texts[11], "de", "s", 1), (2**62, "far id", "de", "s", 1)]
    return [(*r, *[None] * 13) for r in out]


def messy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
