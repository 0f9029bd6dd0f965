"""Learnt weights against a plain Newton fit, and the top-k join against every pair."""

import math
import random

import numpy as np
import pytest

from fencewatch.operators import learning
from fencewatch.operators.matching import one_letter_shorter  # noqa: F401  (the rule that near makes follow)
from fencewatch.operators.ranking import ranked_adverts

SIGNALS = ("far", "near", "constant")


def _adverts(n=400):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(n):
        far, near = float(draw.normal(100, 30)), int(draw.integers(0, 4))
        chance = 1 / (1 + math.exp(-(0.05 * (far - 100) - 1.0 * near + 0.5)))
        bad = None if i % 11 == 0 else bool(draw.random() < chance)
        rows.append((i, None if i % 50 == 7 else far, near, 5, bad))
    return rows


def _plain_fit(rows, steps=8, ridge=1.0):
    x = np.array([[r[1] or 0.0, r[2], r[3]] for r in rows if r[4] is not None])
    y = np.array([float(r[4]) for r in rows if r[4] is not None])
    mean, deviation = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(x)), np.where(deviation > 0, (x - mean) / np.where(deviation > 0, deviation, 1), 0)])
    penalty, b = np.diag([0.0] + [ridge] * x.shape[1]), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ b)
    weights = np.where(deviation > 0, b[1:] / np.where(deviation > 0, deviation, 1), 0)
    return [b[0] - (weights * mean).sum(), *weights]


_SCHEMA = "id int, far double, near int, constant int, bad boolean"


def test_weights_equal_a_plain_fit(spark):
    rows = _adverts()
    learnt = learning.learn_weights(spark.createDataFrame(rows, _SCHEMA).repartition(5), SIGNALS)
    got = {r["signal"]: r["weight"] for r in learnt.collect()}
    assert [got[s] for s in (learning.CONSTANT, *SIGNALS)] == pytest.approx(_plain_fit(rows), abs=1e-8)
    assert got["constant"] == 0 and got["far"] > 0.02 and got["near"] < -0.5


def test_scores_and_their_parts(spark):
    rows = _adverts()
    frame = spark.createDataFrame(rows, _SCHEMA)
    weights = learning.learn_weights(frame, SIGNALS)
    constant, *plain = _plain_fit(rows)
    mean = np.mean([[r[1] or 0.0, r[2], r[3]] for r in rows if r[4] is not None], axis=0)
    for r in learning.learnt_score(frame, weights, SIGNALS).collect():
        values = [r["far"] or 0.0, r["near"], r["constant"]]
        total = constant + sum(w * v for w, v in zip(plain, values))
        assert r["learnt_score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
        assert [r["learnt_points"][s] for s in SIGNALS] == pytest.approx([w * (v - m) for w, v, m in zip(plain, values, mean)], abs=1e-8)


@pytest.mark.parametrize("rows", [[], [(1, 2.0, 1, 5, None)], [(1, 2.0, 1, 5, True), (2, 2.0, 1, 5, True)]])
def test_little_to_learn_from_gives_finite_weights(spark, rows):
    frame = spark.createDataFrame(rows, _SCHEMA)
    weights = learning.learn_weights(frame, SIGNALS, steps=3)
    assert all(math.isfinite(r["weight"]) for r in weights.collect()) and weights.count() == 4
    assert all(r["weight"] == 0 for r in weights.collect() if r["signal"] != learning.CONSTANT)
    assert learning.learnt_score(frame, weights, SIGNALS).count() == len(rows)


# --- ranking


def _near(a, b):
    """At most one letter changed, added or left out."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _plain_ranks(items, listings, k):
    held = {i: set((text or "").lower().split()) for i, text in listings}
    df = {}
    for words in held.values():
        for w in words:
            df[w] = df.get(w, 0) + 1
    out = []
    for item_id, makes, terms in items:
        scored = []
        for listing_id, words in held.items():
            if makes and all(any(_near(m, w) for w in words) for m in makes):
                score = sum(math.floor(1000 * math.log((len(held) + 1) / (df[t] + 1))) + 1 for t in set(terms) - set(makes) if t in words)
                if score > 0:
                    scored.append((-score, listing_id))
        out += [(item_id, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_adverts_equal_those_of_all_pairs(spark, k):
    draw = random.Random(k)
    makes, names = ["velodor", "rovano", "zik", "two words"], [f"n{i}" for i in range(14)] + ["black", "red"]
    listings = []
    for i in range(240):
        make = draw.choice(makes)
        if draw.random() < 0.3:
            at = draw.randrange(len(make))
            make = make[:at] + make[at + 1 :]
        text = " ".join([make, *draw.choices(names, weights=range(1, 17), k=draw.randint(0, 6))])
        listings.append((i, draw.choice([text, text.upper()])))
    listings += [(500, None), (501, "")]
    items = []
    for i in range(60):
        terms = draw.choices([*names, "unheard"], k=draw.randint(0, 4))
        items.append((str(i), draw.choice([m.split() for m in makes] + [[]]), terms))
    got, members = ranked_adverts(
        spark.createDataFrame([(i, t, m) for i, m, t in items], "item_id string, terms array<string>, make_terms array<string>"),
        spark.createDataFrame(listings, "listing_id long, text string"),
        k,
    )
    rows = members.join(got, "set_id").select("item_id", "rank", "listing_id", "score").collect()
    assert sorted(tuple(r) for r in rows) == _plain_ranks(items, listings, k)
    assert members.count() == sum(bool(m) for _, m, _ in items)


def test_candidates_stop_where_nothing_better_can_come(spark, monkeypatch):
    from fencewatch.operators import ranking

    sizes = []
    scored = ranking._scored
    monkeypatch.setattr(ranking, "_scored", lambda s, g, pairs: sizes.append(pairs.count()) or scored(s, g, pairs))
    listings = [(i, f"velodor common rare{i // 3} own{i}") for i in range(300)]
    items = [(str(i), ["common", f"rare{i}"], ["velodor"]) for i in range(100)]
    best, _ = ranking.ranked_adverts(
        spark.createDataFrame(items, "item_id string, terms array<string>, make_terms array<string>"),
        spark.createDataFrame(listings, "listing_id long, text string"),
        3,
    )
    assert best.count() == 300
    # Each item's rare word is in three adverts; the common one adds no candidate.
    assert sizes == [100, 0]
