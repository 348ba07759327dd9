import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import vectors
from tests.llm.test_minhash import classes

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, cosine):
    good = [(i, k, np.array(v, float)) for i, k, v in rows if k is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a[0], b[0]) for a, b in itertools.combinations(good, 2) if a[1] == b[1] and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= cosine]
    n = dict.fromkeys((r[0] for r in rows), 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, classes(n, links)


@pytest.mark.parametrize("block", [8, 1024])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "VISITS", 3 * block)
    rng = np.random.default_rng(1)
    rows = []
    for c in rng.standard_normal((20, 16)):
        for _ in range(25):
            rows.append((len(rows), int(rng.integers(3)), (c + rng.standard_normal(16) * rng.uniform(0, 0.5)).tolist()))
    rows += [(len(rows) + i, 1, rows[0][2]) for i in range(30)]
    bad = [None, [0.0] * 16, [None] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [1.0] * 4, []]
    rows += [(1000 + i, 1, v) for i, v in enumerate(bad)] + [(1100, None, rows[0][2]), (1101, None, rows[0][2])]
    got = vectors.near_vectors(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "label")).collect()
    n, comp = brute(rows, vectors.COSINE)
    assert len(got) == len(rows)
    wrong = sum(r.n_links != n[r.vec_id] for r in got)
    assert all(r.n_links <= n[r.vec_id] for r in got)  # no false link
    assert wrong <= 0.01 * len(got) and sum(r.n_links for r in got) >= 0.99 * sum(n.values())
    assert sum(r.component_id != comp[r.vec_id] for r in got) <= 0.01 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id >= 1000)


def by_row(rows, cosine):
    """Links of every row with every other row, and components of ids."""
    unit = [None if k is None or v is None else np.array(v) / np.linalg.norm(v) for _, k, v in rows]
    n, links = [0] * len(rows), []
    for i, j in itertools.combinations(range(len(rows)), 2):
        if unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and unit[i] @ unit[j] >= cosine:
            n[i], n[j] = n[i] + 1, n[j] + 1
            links.append((rows[i][0], rows[j][0]))
    return n, classes({r[0] for r in rows}, links)


def test_repeated_ids_and_clashing_columns(spark):
    """An id with several vectors, equal ones and ones that link with each other among them."""
    rng = np.random.default_rng(4)
    c = rng.standard_normal((6, 16))

    def near(k):
        return (c[k] + 0.05 * rng.standard_normal(16)).tolist()

    rows = [(9, 1, near(0)), (9, 1, near(1)), (9, 1, near(0)), (9, 2, near(1))]
    rows += [(i, 1, near(0)) for i in (1, 2, 3, 4)] + [(20, 1, near(1)), (5, 1, near(2)), (6, 2, near(2)), (5, 2, near(2)), (7, 1, c[3].tolist()), (7, 1, c[3].tolist()), (8, 1, c[3].tolist()), (30, None, near(0)), (31, 1, None), (9, 1, c[4].tolist())]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(1) for k in ("v", "h", "rep", "num", "mult", "cell", "n_links", "component")})
    got = vectors.near_vectors(df).collect()
    n, comp = by_row(rows, vectors.COSINE)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((r[0], k, comp[r[0]], comp[r[0]] == r[0]) for r, k in zip(rows, n, strict=True))


def test_no_rows(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([(1, 1, None)], SCHEMA)).collect()[0].n_links == 0


def test_multi_sequence_visits_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    got = list(vectors.multi_sequence(a, b, 0.8))
    cost = [a[i] ** 2 + b[j] ** 2 for i, j in got]
    assert cost == sorted(cost) and len(set(got)) == len(got)
    assert len(got) == sum(x**2 + y**2 <= 0.8**2 for x in a for y in b)
