"""Models and sketches against plain re-implementations: row by row, sets and dictionaries only."""

import base64
import math

import numpy as np

from signalbox.llm import boosting, common, fingerprints, quality_model, toxicity


def plain_walk(trees, x):
    """Sum of leaves, one node at a time."""
    total = trees.base
    inner = trees.feature.shape[1]
    for feature, threshold, leaf in zip(trees.feature.tolist(), trees.threshold.tolist(), trees.leaf.tolist(), strict=True):
        node = 0
        while node < inner:
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        total += leaf[node - inner]
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def test_quality_scores_by_a_plain_walk(docs, labels):
    trees = quality_model.fitted(docs, labels)
    assert len(trees.leaf) > 0
    for r in quality_model.scored(docs, trees).collect():
        want = plain_walk(trees, quality_model.statistics(r.text))
        assert math.isclose(r.score, want, rel_tol=1e-9) and r.predicted == int(want >= 0.5)


def test_toxicity_scores_by_a_plain_walk(spark, docs):
    rows = [(i, f"you {'idiot' if i % 3 == 0 else 'friend'} number w{i} says a thing or two here", int(i % 3 == 0)) for i in range(400)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fitted(data, data.select("doc_id", "toxic"))
    assert len(model.trees.leaf) > 0 and len(model.knots) > 0
    for r in toxicity.scored(docs.select("doc_id", "text").union(data.select("doc_id", "text")), model).collect():
        p = plain_walk(model.trees, toxicity.dense(r.text, model.lexicons))
        knots, values = model.knots.tolist(), model.values.tolist()
        k = next((k for k, v in enumerate(knots) if v >= p), None)
        if k is None or k == 0:
            level = values[-1] if k is None else values[0]
        else:
            level = values[k - 1] + (values[k] - values[k - 1]) * (p - knots[k - 1]) / (knots[k] - knots[k - 1])
        want = 0.999 * level + 0.001 * p
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-12) and r.predicted == int(want >= 0.3)


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(3)
    x, ridge = np.round(rng.normal(size=(300, 4)), 1), 2.0
    y = ((x[:, 2] > 0.3) ^ (rng.random(300) < 0.1)).astype(int)
    trees = boosting.fit(x, y, trees=1, depth=1, ridge=ridge)
    p = (y.sum() + 1) / (len(y) + 2)
    weight = p * (1 - p)

    def gain(feature, cut):
        left = x[:, feature] <= cut
        parts = [y[left] - p, y[~left] - p]
        return sum(g.sum() ** 2 / (weight * len(g) + ridge) for g in parts if len(g) * weight >= 1)

    best = max(((gain(f, c), f, c) for f in range(4) for c in np.unique(x[:, f])[:-1]), key=lambda g: g[0])
    assert trees.feature[0][0] == best[1] == 2 and abs(trees.threshold[0][0] - best[2]) <= 0.2
    assert gain(2, trees.threshold[0][0]) >= 0.97 * best[0]  # bins are quantiles, not every value


def test_likeness_by_plain_sets(docs):
    """Fingerprints are the least hashes of the shingle set; likeness counts the least ones of both sets together."""
    def least(text):
        return set(sorted(map(int, common.shingles_of(text)))[: fingerprints.SKETCH])

    def alike(a, b):
        both = sorted(a | b)[: fingerprints.SKETCH]
        return sum(h in a and h in b for h in both) / len(both) if both else 1.0

    rows = sorted(((-(2**63) if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()))
    want = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(text) // 4
        own, edited = least(text), least(text[: len(text) - cut] + after[:cut])
        want.append((None if i < 0 else i, own, edited, round(alike(own, edited), 12), round(alike(own, least(after)), 12)))
    spelled = lambda f: set(np.frombuffer(base64.b64decode(f), "<u8").tolist())
    found = [(r.doc_id, spelled(r.fingerprint), spelled(r.edited_fingerprint), round(r.near_edited, 12), round(r.near_next, 12))
             for r in fingerprints.edited_likeness(docs).collect()]
    key = lambda w: (w[0] is None, w[0] or 0, sorted(w[1]), sorted(w[2]), w[3:])
    assert sorted(found, key=key) == sorted(want, key=key)
