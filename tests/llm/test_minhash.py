import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import minhash
from blockloom.llm.components import components
from tests.llm.conftest import DOC, prose


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, k):
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    return classes([i for i, _ in sets], links)


def check(df, k=4):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows, k)
    got = minhash.near_duplicates(df, words=k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id or r.doc_id is None)
    assert sorted((r.n_shingles for r in got)) == sorted(len(shingle_set(t, k)) for _, t in rows)


def test_odd_rows(spark, clashing):
    check(clashing)
    check(clashing, 5)


def test_no_rows(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_chains_and_borderline_groups(spark, monkeypatch):
    """Many copies at all distances about the threshold, over several blocks and buckets."""
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 7)
    monkeypatch.setattr(minhash, "PIVOTS", 3)
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 5)
    r, rows = random.Random(3), []
    for g in range(3):
        base = prose(100 + g, 60).split()
        for _ in range(25):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), "en", "s", 0))
        for _ in range(12):  # each step changes the text before it
            base[r.randrange(len(base))] = f"step{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(base), "en", "s", 0))
    rows += [(len(rows) + i, prose(900 + i, 50), "en", "s", 0) for i in range(10)]
    check(spark.createDataFrame(rows, DOC))


@pytest.mark.parametrize("pivots", [2, 64])
def test_repeated_ids_with_different_texts(spark, monkeypatch, pivots):
    """An id's texts each have their links, and join what they are near to."""
    monkeypatch.setattr(minhash, "PIVOTS", pivots)

    def changed(seed, k):
        w = prose(seed, 60).split()
        w[k] = f"new{k}"
        return " ".join(w)

    rows = [(1, prose(1, 60)), (2, prose(2, 60)), (5, changed(1, 20)), (5, changed(2, 30)), (7, prose(3, 60)), (8, prose(4, 60)), (9, prose(3, 60)), (9, prose(4, 60)), (9, prose(4, 60)), (6, prose(5, 60)), (6, prose(6, 60)), (6, None), (3, changed(6, 40))]
    check(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC))
    many = [(5, prose(10 + k, 40)) for k in range(30)] + [(50 + k, prose(10 + k, 40) + " more") for k in range(30)]
    check(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in many], DOC))


def test_one_group_of_many_near_copies(spark):
    """Three thousand near copies of one text, all linked through a few; no task holds more than its blocks."""
    base = prose(77, 40).split()

    def copy(i):
        w = list(base)
        w[i % 40] = f"x{i}"
        return " ".join(w)

    df = spark.range(3_000).select(F.col("id").alias("doc_id"), F.udf(copy)("id").alias("text"))
    got = minhash.near_duplicates(df, words=4).groupBy("component_id").count().collect()
    want = brute([(i, copy(i)) for i in range(400)], 4)
    assert len(set(want.values())) == len(got) and sum(r["count"] for r in got) == 3_000


def test_chunk_keys_meet_within_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, minhash.SYMBOLS).astype("<u2")
    for _ in range(200):
        b = a.copy()
        b[rng.permutation(minhash.SYMBOLS)[: minhash.DISTANCE]] ^= 1
        k = minhash.chunk_keys(np.stack([a, b]))
        assert set(k[0]) & set(k[1])


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(1000, 1060)]
    want = classes({x for e in edges for x in e if e[0] != e[1]}, edges)
    got = components(spark.createDataFrame(edges, "a long, b long"), 500).collect()
    assert {x.node: x.component for x in got} == want
