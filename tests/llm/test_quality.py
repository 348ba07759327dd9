import math
import random
import zlib

import numpy as np

from blockloom.llm import quality
from tests.llm.conftest import prose


def sample(n, seed=0):
    r = random.Random(seed)
    for i in range(n):
        good = r.random() < 0.8
        text = prose(seed * 10_000 + i, r.randrange(5, 80))
        yield i, text if good else " ".join(w + r.choice(["***", "$$$"]) for w in text.split()), int(good)


def test_held_out_accuracy(spark):
    rows = list(sample(600))
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(9000, None, 1), (9001, "", 1), (None, "x", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(9000, None, 0), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model, target="p").select("doc_id", quality.held_out().alias("held"), "p").collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([(r.p >= 0.7) == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.p <= 1 for r in got) and len(got) == 603
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns and 400 < kept.count() < 560


def test_labels_of_the_held_out_fold_are_never_used(spark):
    rows = list(sample(300))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in ([(i, y) for i, _, y in rows], flip))
    assert np.array_equal(a.weight, b.weight) and np.array_equal(a.curve, b.curve)


def test_few_labels(spark, docs, empty):
    one = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    assert quality.quality_filter(docs, one).count() == docs.count()
    assert quality.train(docs, one.limit(0)).score("x") == 0.5
    assert quality.quality_filter(empty, one).count() == 0


def plain_places(text):
    """Distinct n-gram places of a text, one n-gram at a time."""
    raw, out = text.encode(), set()
    for k, n in enumerate(quality.GRAMS):
        for i in range(len(raw) - n + 1):
            code = int.from_bytes(raw[i : i + n], "big")
            out.add((k << quality.BITS) + (code if n <= 2 else code * 0x9E3779B1 % 2**32 >> 32 - quality.BITS))
    return out


def plain_fit(texts, labels):
    """Log-count ratios by counting, and the hinge-loss model by projected steps on its dual."""
    sets = [plain_places(t) for t in texts]
    n = [sum(y == k for y in labels) + 2 for k in (0, 1)]
    r = {}
    for p in set().union(*sets):
        c = [1 + sum(p in s for s, y in zip(sets, labels, strict=True) if y == k) for k in (0, 1)]
        r[p] = math.log(c[1] / n[1]) - math.log(c[0] / n[0])
    norm = [math.sqrt(sum(r[p] ** 2 for p in s)) for s in sets]
    sign = np.where(np.array(labels) == 1, 1.0, -1.0)
    gram = np.array([[sum(r[p] ** 2 for p in a & b) / norm[i] / norm[j] for j, b in enumerate(sets)] for i, a in enumerate(sets)]) * np.outer(sign, sign)
    alpha, step = np.zeros(len(sets)), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, 1)
    w = {p: r[p] ** 2 * sum(a * k / m for a, k, m, s in zip(alpha, sign, norm, sets, strict=True) if p in s) for p in r}
    return r, w


def test_scores_against_a_plain_computation(spark):
    rows = list(sample(60, 2))
    texts, labels = [t[:300] for _, t, _ in rows], np.array([y for _, _, y in rows])
    found = [np.flatnonzero(quality.seen(t)) for t in texts]
    assert all(set(x.tolist()) == plain_places(t) for x, t in zip(found, texts, strict=True))
    r, w = plain_fit(texts, labels)
    ratio = quality.log_count_ratio(found, labels)
    assert all(abs(ratio[p] - v) < 1e-9 for p, v in r.items())
    weight = quality.dual_coordinate_descent(found, labels, ratio, rounds=4000, tolerance=1e-7) * ratio
    assert all(abs(weight[p] - v) < 1e-3 for p, v in w.items())
    model = quality.fit(found, labels, 0.8)
    odd = ["", "x", "né", "a" * 50_000, texts[0], texts[0], prose(9, 30_000)]
    df = spark.createDataFrame([(i, t, 7.0) for i, t in enumerate([*odd, *texts, None])], "doc_id long, text string, bl_score double")
    got = {x.doc_id: x.p for x in quality.score(df, model, target="p").collect()}
    for i, t in enumerate([*odd, *texts, ""]):
        at = plain_places(t)
        margin = sum(model.weight[p] for p in at) / math.sqrt(max(sum(model.square[p] for p in at), 1e-12)) if at else 0.0
        size = math.log1p(len(at)) / 8
        z = sum(a * b for a, b in zip(model.curve, (margin, margin * size, size, 1.0), strict=True))
        assert abs(got[i] - 1 / (1 + math.exp(-min(max(z, -35), 35)))) < 1e-9
    assert quality.score(df.limit(0), model).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    """The duality gap of the linear hinge loss closes, and every dual variable is in its box."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 60)
    xs = [np.sort(rng.choice(200, 20, replace=False) + 100 * (k and rng.random() < 0.9)) for k in y]
    xs = [np.unique(x) for x in xs]
    r = quality.log_count_ratio(xs, y)
    v = [r[x] / np.sqrt((r[x] ** 2).sum()) for x in xs]
    s = np.where(y == 1, 1, -1)
    for cost in (0.05, 1.0):
        w = quality.dual_coordinate_descent(xs, y, r, cost, 5000, 1e-8)
        primal = w @ w / 2 + cost * sum(max(0, 1 - k * (w[x] @ u)) for x, u, k in zip(xs, v, s, strict=True))
        dense = np.zeros((60, quality.PLACES))
        for i, (x, u) in enumerate(zip(xs, v, strict=True)):
            dense[i, x] = u * s[i]
        gram, alpha = dense @ dense.T, np.zeros(60)
        step = 1 / np.linalg.eigvalsh(gram)[-1]
        for _ in range(50_000):
            alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
        dual = alpha.sum() - alpha @ gram @ alpha / 2
        assert abs(primal - dual) < 1e-3 and np.allclose(w, alpha @ dense, atol=1e-2)
