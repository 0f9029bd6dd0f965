"""Learnt words on hand-made labels."""

import math

from fencewatch.operators.words import word_score, word_weights


def test_weights_and_scores(spark):
    texts = spark.createDataFrame(
        [(1, "Cheap cheap bike"), (2, "bike"), (3, None), (4, "new"), (None, "bike")], "text_id int, text string"
    )
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, None), (9, 1)], "text_id int, bad int")
    rows = {r.word: r for r in word_weights(texts, labels).collect()}
    assert set(rows) == {"cheap", "bike"}
    cheap = rows["cheap"]
    assert (cheap.n_bad, cheap.n_good) == (1, 0)
    assert float(cheap.weight) == round(math.log(2 / 3) - math.log(1 / 4), 6)
    scores = {r.text_id: r.word_score for r in word_score(texts, word_weights(texts, labels)).collect()}
    bike = float(rows["bike"].weight)
    assert abs(scores[1] - float(cheap.weight) - bike) < 1e-9
    assert scores[2] == bike and scores[3] == 0 and scores[4] == 0 and scores[None] == bike


def test_nothing_to_learn(spark):
    texts = spark.createDataFrame([(1, "a")], "text_id int, text string")
    none = word_weights(texts, spark.createDataFrame([], "text_id int, bad int"))
    assert none.count() == 0
    assert [r.word_score for r in word_score(texts, none).collect()] == [0.0]
