"""Words that tell good texts from bad ones, learnt from labels by counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fencewatch.operators.keyed import aggregate_per_key
from fencewatch.operators.matching import words
from fencewatch.sources.scratch import written

#: Weights are kept to six places, so that their sums do not depend on the order of adding.
WEIGHT = "decimal(12,6)"


def word_weights(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``(word, n_bad, n_good, weight)`` from ``texts(text_id, text)`` and ``labels(text_id, bad)``.

    Counts are of labelled texts that have the word. The weight is the log of the ratio of its
    smoothed shares among bad and good texts: positive for words of bad ones. A text without label
    teaches nothing.
    """
    known = labels.where(F.col("bad").isNotNull()).select("text_id", F.col("bad").cast("int").alias("bad"))
    labelled = written(
        texts.select("text_id", words(F.col("text")).alias("words")).join(known, "text_id"), "labelled-words"
    )
    n_bad = labelled.select(F.coalesce(F.sum("bad"), F.lit(0))).scalar()
    n_good = labelled.select(F.coalesce(F.sum(1 - F.col("bad")), F.lit(0))).scalar()
    counted = (
        labelled.select(F.explode("words").alias("word"), "bad")
        .groupBy("word")
        .agg(F.sum("bad").alias("n_bad"), F.sum(1 - F.col("bad")).alias("n_good"))
    )
    bad = (F.col("n_bad") + 1) / (n_bad + 2)
    good = (F.col("n_good") + 1) / (n_good + 2)
    return counted.withColumn("weight", F.round(F.ln(bad) - F.ln(good), 6).cast(WEIGHT))


def word_score(texts: DataFrame, weights: DataFrame) -> DataFrame:
    """``(text_id, word_score)``: the sum of the weights of each text's different words, 0 without any."""
    per_word = aggregate_per_key(weights, ["word"], F.first("weight").alias("weight"))
    found = texts.select("text_id", F.explode_outer(words(F.col("text"))).alias("word")).join(
        per_word, "word", "left"
    )
    total = F.coalesce(F.sum("weight"), F.lit(0)).cast("decimal(18,6)")
    return found.groupBy("text_id").agg(total.cast("double").alias("word_score"))
