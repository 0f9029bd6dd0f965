"""Weights of signals, learnt from labelled adverts: a logistic regression fitted by Newton steps.

Every step is one grouped sum over the labelled rows: the gradient and the upper half of the Gram matrix of
the signals. The driver gets that one row, whose size depends on the number of signals alone, and solves
for the step. The rows are written once; no step shuffles anything but partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.sources.scratch import written

#: Name of the row that holds the constant.
CONSTANT = "(constant)"
_SCHEMA = "signal string, weight double, mean double, deviation double"


def _value(name: str) -> Column:
    """A signal that is NULL for an advert says nothing: it counts as 0."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _likelihood(terms: Sequence[Column], weights: Sequence[float]) -> Column:
    total = F.lit(float(weights[0]))
    for term, weight in zip(terms, weights[1:]):
        total = total + term * F.lit(float(weight))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn_weights(
    listings: DataFrame, signals: Sequence[str], label: str = "bad", steps: int = 8, ridge: float = 1.0
) -> DataFrame:
    """``(signal, weight, mean, deviation)``: how much each signal speaks for a bad advert, one row for the constant.

    ``label`` is true or 1 for a bad advert; rows where it is NULL teach nothing. Weights are for the
    signals as they are, the penalty ``ridge`` is on the standardized ones. A signal that never varies
    gets weight 0; without a labelled row all do.
    """
    names = [f"x{i}" for i in range(len(signals))]
    known = written(
        listings.where(F.col(label).isNotNull()).select(
            F.col(label).cast("int").cast("double").alias("y"), *[_value(s).alias(n) for s, n in zip(signals, names)]
        ),
        "labelled-signals",
    )
    moments = known.agg(
        F.count("*").alias("n"),
        *[F.avg(n).alias(f"mean_{n}") for n in names],
        *[F.stddev_pop(n).alias(f"deviation_{n}") for n in names],
    ).first()
    mean = np.array([moments[f"mean_{n}"] or 0.0 for n in names])
    deviation = np.array([moments[f"deviation_{n}"] or 0.0 for n in names])
    terms = [
        (F.col(n) - F.lit(float(m))) / F.lit(float(d)) if d > 0 else F.lit(0.0) for n, m, d in zip(names, mean, deviation)
    ]
    weights = np.zeros(len(names) + 1)
    if moments["n"]:
        for _ in range(steps):
            weights = weights + _newton_step(known, terms, weights, ridge)
    scale = np.where(deviation > 0, deviation, 1.0)
    plain = np.where(deviation > 0, weights[1:] / scale, 0.0)
    constant = weights[0] - float((plain * mean).sum())
    rows = [(CONSTANT, float(constant), None, None)]
    rows += [(s, float(w), float(m), float(d)) for s, w, m, d in zip(signals, plain, mean, deviation)]
    return listings.sparkSession.createDataFrame(rows, _SCHEMA)


def _newton_step(known: DataFrame, terms: Sequence[Column], weights: np.ndarray, ridge: float) -> np.ndarray:
    size = len(terms) + 1
    chance = _likelihood(terms, weights)
    columns = [F.lit(1.0), *terms]
    rows = known.select(
        (F.col("y") - chance).alias("rest"), (chance * (F.lit(1.0) - chance)).alias("slope"), *[c.alias(f"z{i}") for i, c in enumerate(columns)]
    )
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = rows.agg(
        *[F.sum(F.col("rest") * F.col(f"z{i}")).alias(f"g{i}") for i in range(size)],
        *[F.sum(F.col("slope") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in pairs],
    ).first()
    gram = np.zeros((size, size))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"h{i}_{j}"]
    penalty = np.append(0.0, np.full(size - 1, ridge))
    gradient = np.array([sums[f"g{i}"] for i in range(size)]) - penalty * weights
    return np.linalg.solve(gram + np.diag(penalty) + np.eye(size) * 1e-9, gradient)


def learnt_score(listings: DataFrame, weights: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Add ``learnt_score``, the chance that an advert is bad, and ``learnt_points``, what each signal adds to it.

    ``weights`` is a table as :func:`learn_weights` makes it; a signal without a row there adds
    nothing. Points are in natural-log odds against an advert with mean signals.
    """
    entry = F.struct("signal", F.struct("weight", F.coalesce("mean", F.lit(0.0)).alias("mean")))
    table = weights.select(F.map_from_entries(F.collect_list(entry))).scalar()
    held = listings.withColumn("__weights", table)

    def weight(name: str) -> Column:
        return F.coalesce(F.try_element_at("__weights", F.lit(name))["weight"], F.lit(0.0))

    total = weight(CONSTANT)
    for name in signals:
        total = total + weight(name) * _value(name)
    mean = {name: F.coalesce(F.try_element_at("__weights", F.lit(name))["mean"], F.lit(0.0)) for name in signals}
    points = F.map_from_arrays(
        F.array(*[F.lit(name) for name in signals]),
        F.array(*[weight(name) * (_value(name) - mean[name]) for name in signals]),
    )
    scored = held.withColumns({"learnt_score": F.lit(1.0) / (F.lit(1.0) + F.exp(-total)), "learnt_points": points})
    return scored.drop("__weights")
