"""A small table of documents with every odd case: nulls, empty, long, repeated, tied, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, n long, h string, id long, norm string, length int, cell int, key int, label int, score int, root string, keep_id string"

EN = "the cat sat on the mat and the dog ran over the hill with a bone that it had found in the garden near the old house".split()
DE = "der hund lief über den hügel und die katze saß auf der matte während das kind im garten mit dem alten ball spielte".split()


def prose(words: list[str], n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text[, lang]) with columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1, "x", 2, "y", 3, "z", 4, 5, 6, 7, 8, "r", "k") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd(spark: SparkSession) -> DataFrame:
    long = prose(EN, 20_000, 1)
    rows = [
        (1, None), (2, ""), (3, "   "), (4, "Hello  World\n\n x"), (5, "hello  world\n\n x"), (6, "ÄB"), (7, "äB"), (8, long), (9, long.upper()), (10, "é"),
        (10, "é"), (11, "<|endoftext|> 1½ ² x's"), (12, "\n \n a \t"), (13, "日本語テキスト"), (14, "12 34 ..."), (15, "a" * 5000), (16, prose(EN, 40, 2)), (17, prose(EN, 40, 2) + " end"),
    ]
    return documents(spark, rows)


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
