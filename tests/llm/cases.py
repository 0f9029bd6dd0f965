"""Rows that every operator has to stand: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

DATA = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(60)]

#: Names that operators use for columns of their own.
CLASHING = (
    "score length start piece ids decoded spans n_words kept class_id label unit probe token block key rank host path rule "
    "verdict turns loss_mask text_hash n_shingles component_id word bits place"
).split()


def random_text(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) for _ in range(n))


def odd_documents() -> list[tuple[int | None, str | None]]:
    draw = random.Random(4)
    long = random_text(draw, 30_000)
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, random_text(draw, 40)),
        (5, random_text(draw, 40)),
        (6, long),
        (6, long),
        (None, "a row without id"),
        (None, None),
        (7, "é ü 😀 <|endoftext|> \u00a0 x\u2003y"),
        (8, "same words " * 200),
    ]


def with_clashes(spark, rows, schema: str, names=CLASHING):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, schema)
    taken = {c.lower() for c in frame.columns}
    return frame.select("*", *[F.lit("other").alias(n) for n in names if n not in taken])
