import random

import numpy as np
from pyspark.sql import functions as F

from blockloom.llm import decontaminate as d
from tests.llm.conftest import prose


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_bit_parallel_subsequence():
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(1, 70))] for _ in range(2))
        assert d.common_subsequence(d._bits(a), len(a), b) == lcs(a, b)


def planted(spark):
    items = [(i, f"{prose(50 + i, 14 + 3 * i)}. {prose(80 + i, 6)}.") for i in range(12)]
    rows, want = [], set()
    for i in range(150):
        words, k = prose(1000 + i, 300).split(), i % 12
        if i % 3 == 0:
            t = items[k][1].split()
            if i % 2:  # a paraphrase: every sixth word of the body changed
                t = [f"syn{j}" if j % 6 == 0 and j < len(t) - 6 else w for j, w in enumerate(t)]
            at = (i * 37) % 250
            words[at:at] = [w.upper() for w in t]
            want.add((i, k))
        rows.append((i, " ".join(words), 1))
    return spark.createDataFrame(rows, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"), want


def test_planted_items_and_paraphrases(spark, monkeypatch):
    docs, bench, want = planted(spark)
    for block in (2000, 5):
        monkeypatch.setattr(d, "ITEMS", block)
        got = d.leaks(docs, bench).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(r.ratio == r.lcs / r.item_words >= 0.5 for r in got)
    left = d.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(150)) - {i for i, _ in want}


def test_odd_rows(spark, clashing, empty):
    bench = spark.createDataFrame([(1, prose(1, 120)[:200]), (1, "other"), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")
    got = d.leaks(clashing, bench).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, None} and {r.item_id for r in got} == {1}
    # every row of the benchmark is an item: ids that are null, or that another item has
    own = prose(1, 120).split()
    many = [(1, " ".join(own[:20])), (1, " ".join(own[40:60])), (None, " ".join(own[20:40])), (None, " ".join(own[80:100])), (7, " ".join(own[100:])), (7, " ".join(own[100:]))]
    got = d.leaks(clashing.where("doc_id in (0, 1, 2)"), spark.createDataFrame(many, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == sorted((i, k) for i in range(3) for k in (1, 1, 0, 0, 7))
    more = clashing.where("doc_id = 0").unionByName(clashing.where("doc_id = 0")).unionByName(clashing.where("doc_id = 5").withColumn("doc_id", F.lit(0).cast("long")))
    assert [r.doc_id for r in d.leaks(more, bench).collect()] == [0, 0] and d.decontaminate(more, bench).count() == 0
    assert d.leaks(empty, bench).count() == 0 and d.leaks(clashing, bench.limit(0)).count() == 0
    assert d.decontaminate(clashing, bench).count() == clashing.count() - 3 - 0


def test_basis_holds_most_of_what_the_best_one_does(spark):
    """Against a dense SVD of the same TF-IDF matrix: most of what the best basis of this size holds."""
    docs, bench, _ = planted(spark)
    index = d.items(bench, "item_id", "text")
    d.fit(d.numbered(d.by_id(docs, "doc_id", "text"), index), index)
    size = len(index.idf)
    windows = [d._padded_items(index)]
    for r in docs.collect():
        _, w = d._heavy(index, index.numbers(d.words(r.text)), d.PASSAGE)
        windows.append(w)
    dense = d._vectors(index, np.concatenate(windows), np.eye(size, dtype=np.float32))
    dense[:, 0] = 0
    s = np.linalg.svd(dense, compute_uv=False)
    k = index.basis.shape[1]
    assert np.allclose(index.basis.T @ index.basis, np.eye(k), atol=1e-3)
    assert ((dense @ index.basis) ** 2).sum() > 0.7 * (s[:k] ** 2).sum()


def test_item_in_a_third_of_many_passages(spark):
    """More than a thousand passages, and rare words of other items on both sides of the item."""
    leaked = " ".join(f"a{j}" for j in range(20))
    others = [" ".join(f"b{k}_{j}" for j in range(20)) for k in range(120)]
    rows = []
    for i in range(1200):
        w = prose(i, 32).split()
        if i % 3 == 0:
            beside = others[i // 3 % 120].split()
            w = [*beside[:6], *leaked.split(), *beside[6:12]]
        rows.append((i, " ".join(w)))
    bench = spark.createDataFrame([(1, leaked), *enumerate(others, 2)], "item_id long, text string")
    got = d.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.ratio) for r in got) == [(i, 1, 1.0) for i in range(0, 1200, 3)]


def test_two_thousand_items_against_brute_force(spark):
    """Near copies and answers among reworded items, far more items than latent dimensions."""
    r = random.Random(5)
    items = [[f"w{int(r.random() ** 2 * 4000)}" for _ in range(r.randrange(15, 22))] for _ in range(2000)]
    docs = []
    for i in range(60):
        w = prose(i, 40).split()
        n, other, copy = len(items[i]), items[i + 100], []
        for j, x in enumerate(items[i]):  # verbatim, reworded but for the answer, or words of another item between
            copy.append(x if i % 3 == 0 or j >= n * 0.7 or j % 2 else f"new{j}")
            if i % 3 == 2 and j < n * 0.7:
                copy += [other[(j + m) % 15] for m in (0, 5, 10)[: 2 + j % 2]]
        w[i % 30 : i % 30] = copy
        docs.append(w)
    want = {}
    for i, w in enumerate(docs):
        w = [x.encode() for x in w]
        for k, item in enumerate(items):
            seq, n = [x.encode() for x in item], len(item)
            answer, bits = d.answer_words(" ".join(item)), d._bits(seq)
            for s in d.passages(len(w)).tolist():
                near = w[max(0, s - n) : s + d.PASSAGE + n]
                length = d.common_subsequence(bits, n, near)
                stands = any(near[j : j + len(answer)] == answer for j in range(len(near)))
                if length / n >= d.LEAK or length / n >= d.PARAPHRASE and stands:
                    want[i, k] = max(want.get((i, k), 0), length)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = d.leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"), bench).collect()
    assert len(want) > 40 and {(r.doc_id, r.item_id): r.lcs for r in got} == want and len(got) == len(want)
    assert np.mean([r.retrieved for r in got]) > 0.5 and all(r.retrieved <= (r.cosine >= 0) for r in got)


def test_paraphrases_against_brute_force(spark, monkeypatch):
    """Items of which half to four fifths of the words are left: the answer decides, over all items and windows."""
    monkeypatch.setattr(d, "ITEMS", 16)
    r = random.Random(9)
    items = [f"{prose(300 + i, r.randrange(12, 30))}. {prose(600 + i, r.randrange(4, 8))}." for i in range(50)]
    docs = []
    for i in range(120):
        w, t = prose(5000 + i, r.randrange(0, 200)).split(), items[i % 50].split()
        body = len(d.words(items[i % 50])) - len(d.answer_words(items[i % 50]))
        share, answered = r.uniform(0.2, 0.55), r.random() < 0.6
        t = [f"syn{j}" if (j < body and r.random() < share) or (j >= body and not answered and j % 2) else x for j, x in enumerate(t)]
        at = r.randrange(len(w) + 1)
        w[at:at] = t
        docs.append((i, " ".join(w)))
    want = {}
    for i, text in docs:
        w = d.words(text)
        for k, item in enumerate(items):
            seq, answer = d.words(item), d.answer_words(item)
            bits = d._bits(seq)
            for s in d.passages(len(w)).tolist():
                near = w[max(0, s - len(seq)) : s + d.PASSAGE + len(seq)]
                share = d.common_subsequence(bits, len(seq), near) / len(seq)
                if share >= d.LEAK or share >= d.PARAPHRASE and any(near[j : j + len(answer)] == answer for j in range(len(near))):
                    want[i, k] = max(want.get((i, k), 0), share)
    assert sum(0.5 <= x < 0.8 for x in want.values()) > 20 and len(want) < 110
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(x.doc_id, x.item_id): x.ratio for x in got} == want and len(got) == len(want)
