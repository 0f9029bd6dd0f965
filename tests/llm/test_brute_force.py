"""Learned operators against plain loops: every segmentation, every choice over a tree, every split, every byte."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from fencewatch.llm import boosting, dom, pages, pii, quality


# --- personal data: the best of all segmentations


def _segmentations(text, bounds, last):
    """(segments) of the tokens up to ``last`` in every way that candidates allow."""
    if last < 0:
        yield ()
        return
    for first, kind in pii._candidates(text, bounds, last):
        for rest in _segmentations(text, bounds, first - 1):
            yield (*rest, (first, last, kind))


@pytest.mark.parametrize("seed", range(4))
def test_labelling_is_the_best_of_all(seed):
    draw = random.Random(seed)
    weights = pii.SpanField().fit(pii.examples(60, seed=seed), rounds=2).weights
    weights = {name: w + draw.gauss(0, 0.3) for name, w in weights.items()}
    field = pii.SpanField(weights)
    texts = ["+1 (604) 555-0199", "a@b.co x", "1.2.3.4:5", "4111 1111 1111 1111", "(784) 555-8120 12", "x@y@z.org", "12-34 567.890.1234"]
    for text in texts + ["".join(draw.choice("12. -(@ab+") for _ in range(14)) for _ in range(12)]:
        bounds = pii._tokens(text, 0, len(text))
        ways = list(itertools.islice(_segmentations(text, bounds, len(bounds) - 2), 200_000))
        assert len(ways) < 200_000

        def total(way):
            return sum(field._score(pii._features(text, bounds[a], bounds[b + 1], kind)) for a, b, kind in way)

        best = max(map(total, ways))
        got = field.best(text)
        spans = {(s, e): kind for kind, s, e in got}
        chosen = [w for w in ways if {(bounds[a], bounds[b + 1]): k for a, b, k in w if k != pii.NONE} == spans]
        assert chosen and max(map(total, chosen)) == pytest.approx(best, abs=1e-9), text


# --- pages: the best of all consistent choices, and the best of all splits


def _choices(page, node, logit, children, has_own):
    """(value, kept nodes) of every way to keep, drop or split a subtree."""
    keep = {n: -math.log1p(math.exp(-logit[n])) for n in range(len(logit))}
    drop = {n: -math.log1p(math.exp(logit[n])) for n in range(len(logit))}

    def below(n):
        return [n, *(m for kid in children[n] for m in below(kid))]

    whole = below(node)
    yield sum(keep[n] for n in whole), frozenset(whole)
    yield sum(drop[n] for n in whole), frozenset()
    own = max(keep[node], drop[node]) if has_own[node] else 0.0
    mine = {node} if logit[node] > 0 else set()
    for parts in itertools.product(*(list(_choices(page, kid, logit, children, has_own)) for kid in children[node])):
        yield own - pages.SPLIT_COST + sum(v for v, _ in parts), frozenset(mine.union(*(k for _, k in parts)))


def test_choice_over_a_tree_is_the_best_of_all():
    draw = random.Random(3)
    sources = [
        "<div>a<p>b</p></div>c", "<ul><li>a<li>b</ul><p>c", "<div><div><p>x</p></div></div>", "a<p>b</p>c<p>d</p>",
        "<section><h1>t</h1><p>x</p></section><footer>f</footer>",
    ]
    for source in sources * 8:
        page = dom.read_page(source)
        n = len(page.tag)
        logit = np.array([draw.gauss(0, 2) for _ in range(n)])
        children = [[k for k in range(n) if page.parent[k] == node] for node in range(n)]
        has_own = [any(r is not None and r[0] == node and r[1].strip() for r in page.runs) for node in range(n)]
        value, kept = max(_choices(page, 0, logit, children, has_own), key=lambda c: c[0])
        got = frozenset(i for i, k in enumerate(pages.decoded(page, logit)) if k)
        # Nodes without text of their own may be labelled either way inside a split.
        held = {i for i in range(n) if has_own[i]}
        assert got & held == kept & held, (source, logit)


def test_split_is_the_best_of_all_borders():
    draw = np.random.default_rng(4)
    for _ in range(5):
        x = draw.integers(0, 9, (80, 3)).astype(float)
        y = (draw.random(80) < np.where(x[:, 1] > 4, 0.8, 0.2)).astype(float)
        model = boosting.boosted(x, y, trees=1, depth=1, least=4.0)
        share = y.mean()
        slope, curve = y - share, np.full(80, share * (1 - share) + 1e-6)
        best = (0.0, None)
        for f in range(3):
            for border in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])):
                high = x[:, f] > border
                sides = [(slope[s].sum(), curve[s].sum()) for s in (~high, high)]
                if min(h for _, h in sides) >= 1.0:
                    gain = sum(g * g / (h + 1) for g, h in sides) - slope.sum() ** 2 / (curve.sum() + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, border))
        assert (model.feature[0, 0], model.border[0, 0]) == best[1]
        high = x[:, best[1][0]] > best[1][1]
        for side, value in ((~high, model.value[0, 0]), (high, model.value[0, 1])):
            assert value == pytest.approx(0.2 * slope[side].sum() / (curve[side].sum() + 1))


def test_logit_walks_every_tree():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(60, 4))
    model = boosting.boosted(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=7, depth=3, least=1.0)
    for row, got in zip(x, model.logit(x)):
        total = model.start
        for feature, border, value in zip(model.feature, model.border, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > border[node])
            total += value[node - len(feature)]
        assert got == pytest.approx(total)


# --- quality: the network byte by byte


def _plain_score(network, text):
    w, data = network.weights, text.encode()
    words, at = [], 0
    marks = [0.0] * len(data)
    for n, word in enumerate(text.encode().split()):
        at = data.index(word, at)
        words.append(word)
        if word in words[max(0, n - 4) : n]:
            marks[at : at + len(word)] = [1.0] * len(word)
        at += len(word)
    blocks = max(1, -(-len(data) // 128))
    data, marks = data.ljust(blocks * 128, b"\0"), marks + [0.0] * (blocks * 128 - len(marks))

    def row(step):
        some = slice(4 * step, 4 * step + 4)
        return np.array([*w["embed"][list(data[some])].reshape(-1), np.mean(marks[some])])

    sums, counts = np.zeros((blocks, len(w["bias"]))), np.zeros(blocks)
    for step in range(blocks * 32):
        if step == 0 or 4 * step + 4 < len(text.encode()):
            act = row(step) @ w["left"] + w["bias"]
            if step + 1 < blocks * 32:
                act = act + row(step + 1) @ w["right"]
            sums[step // 32] += np.maximum(act, 0)
            counts[step // 32] += 1
    chunks = []
    for block in range(blocks):
        both = [block] if block + 1 == blocks else [block, block + 1]
        chunks.append(sum(sums[b] for b in both) / max(1, sum(counts[b] for b in both)))
    pooled = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)])
    hidden = np.maximum(pooled @ w["dense"] + w["dense_bias"], 0)
    return 1 / (1 + math.exp(-float((hidden @ w["out"] + w["out_bias"])[0])))


def test_score_equals_a_plain_network():
    network = quality.ByteNetwork(quality.Training(filters=5, hidden=4))
    draw = random.Random(6)
    texts = ["a b a c", "x" * 128, "y " * 300, "word " * 30 + "end", "é ü 😀 " * 40]
    texts += [" ".join(draw.choice(["ab", "cde", "f", "ghij"]) for _ in range(draw.randint(1, 200))) for _ in range(6)]
    # One at a time: in a batch the step after a text's last one belongs to the next text, and is masked.
    for text in texts:
        assert network.score(pa.array([text]))[0] == pytest.approx(_plain_score(network, text), rel=1e-4)
    together = network.score(pa.array(texts))
    assert together == pytest.approx([network.score(pa.array([t]))[0] for t in texts], rel=1e-4)
