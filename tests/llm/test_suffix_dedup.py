import random

import numpy as np
import pytest

from blockloom.llm import suffix_dedup as s
from tests.llm.conftest import DOC, prose


def brute(rows):
    """doc_id, bytes, removed, runs, rest of every row, straight from the definition."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - s.LENGTH + 1):
            if i is not None:
                w = b[k : k + s.LENGTH]
                least[w] = min(least.get(w, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - s.LENGTH + 1):
            if i is not None and least[b[k : k + s.LENGTH]] < i:
                gone[k : k + s.LENGTH] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        yield i, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])


def check(df):
    want = sorted(brute([(r.doc_id, r.text) for r in df.collect()]), key=str)
    out = s.suffix_dedup(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out), key=str) == want
    assert all(sum(x.stop - x.start for x in r.removed) == r.n_removed and len(r.removed) == r.n_spans for r in out)


def test_odd_rows(spark, clashing):
    check(clashing)


def test_no_rows(spark, empty):
    assert s.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("copies", [0, 100])
def test_repeated_ids_with_different_texts(spark, monkeypatch, copies):
    monkeypatch.setattr(s, "BROADCAST_COPIES", copies)
    a, b, c = prose(1, 20), prose(2, 12), prose(3, 40)
    rows = [(1, a), (2, b), (10, a), (10, f"head {b} tail"), (10, a), (10, c), (11, c[30:] + a), (11, c), (11, c), (12, b[3:] + c[:200]), (12, None), (3, b[:70] + "x" * 60)]
    check(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC))


@pytest.mark.parametrize(("shard", "hot", "size"), [(64, 2, 300), (1 << 17, 8_192, 1 << 20), (200, 5, 1 << 12)])
def test_overlapping_passages(spark, monkeypatch, shard, hot, size):
    """With and without hot minimizers, over many small buckets and one."""
    monkeypatch.setattr(s, "SHARD", shard)
    monkeypatch.setattr(s, "HOT", hot)
    monkeypatch.setattr(s, "BUCKET_BYTES", size)
    monkeypatch.setattr(s, "BROADCAST_COPIES", 0)
    r = random.Random(1)
    pool = [prose(i, 30) for i in range(6)] + ["é" * 80, "ab" * 60, "x" * 200]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            p = r.choice(pool)
            a = r.randrange(len(p) // 2)
            parts.append(p[a : a + r.randrange(30, 120)])
            parts.append(prose(1000 * i + len(parts), r.randrange(0, 12)))
        rows.append((r.randrange(45), r.choice(["", " "]).join(parts), "en", "s", 0))
    check(spark.createDataFrame(rows, DOC))


def test_a_hot_minimizer_is_split(spark, monkeypatch):
    """Many documents share a passage with own words on both sides: its strings are dealt to many buckets."""
    passage = prose(5, 9)[:60]
    rows = [(i, f"{prose(100 + i, 6)} {passage} {prose(900 + i, 6)}") for i in range(300)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).repartition(7)
    live = s.shared_minimizers(df, 50, 20)
    slots = s.hot_slots(live)
    assert 0 < np.unpackbits(np.frombuffer(slots, np.uint8)).sum() < 40
    assert not any(s.hot_slots(s.shared_minimizers(df, 50, 1000)))
    monkeypatch.setattr(s, "HOT", 20)
    check(df)


def test_merged_transforms_are_the_sorted_suffixes():
    rng = np.random.default_rng(0)
    shards = [rng.integers(1, 3, n).astype(np.uint8) for n in (40, 1, 77, 300)]
    for x in shards:
        x[-1] = 0
    places, start = s.merge_transforms(shards)
    base = np.cumsum([0, *map(len, shards[:-1])])

    def rotation(p):
        k = np.searchsorted(base, p, side="right") - 1
        return bytes(np.resize(np.roll(shards[k], -(p - base[k])), s.LENGTH))

    rows = [rotation(p) for p in places]
    assert sorted(places) == list(range(sum(map(len, shards)))) and rows == sorted(rows)
    assert [True, *(a != b for a, b in zip(rows, rows[1:], strict=False))] == start.tolist()


def test_only_strings_that_may_repeat_are_merged(monkeypatch):
    """A phrase too short to repeat, or an end of a passage, does not bring the text around it to the transforms."""
    merged, merge = [], s.merge_transforms

    def watched(shards, *depth):
        merged.append(sum(map(len, shards)))
        return merge(shards, *depth)

    monkeypatch.setattr(s, "merge_transforms", watched)
    phrase, passage = prose(7, 5)[:20], prose(8, 12)[:90]
    alone = [f"{prose(10 + i, 3)} {phrase} {prose(500 + i, 3)}".encode() for i in range(200)]
    best, begin = s.least_documents(alone, np.arange(200))
    assert not merged and best.tolist() == np.repeat(np.arange(200), np.diff(begin)).tolist()

    ends = [f"{prose(10 + i, 3)} {passage}".encode() for i in range(200)]
    twice = [b"ab" * 40, b"x" + b"ab" * 30]
    texts, docs = [*ends, *twice, *alone], np.random.default_rng(0).permutation(402)
    best, begin = s.least_documents(texts, docs, 64)
    least = {}
    for t, d in zip(texts, docs.tolist(), strict=True):
        for k in range(len(t) - s.LENGTH + 1):
            least[t[k : k + s.LENGTH]] = min(least.get(t[k : k + s.LENGTH], d), d)
    assert best.tolist() == [least[t[k : k + s.LENGTH]] for t in texts for k in range(len(t) - s.LENGTH + 1)]
    assert begin.tolist() == np.cumsum([0, *(len(t) - s.LENGTH + 1 for t in texts)]).tolist()
    assert 0 < sum(merged) < sum(map(len, texts)) / 3


@pytest.mark.parametrize("sent", [1, 4_000])
def test_a_batch_may_be_sent_in_parts(spark, monkeypatch, sent):
    monkeypatch.setattr(s, "SENT", sent)
    monkeypatch.setattr(s, "BUCKET_BYTES", 1 << 12)
    rows = [(i % 50, f"{prose(i, 20)} {prose(1000 + i % 7, 15)} {prose(i // 2, 9)}", "en", "s", 0) for i in range(70)]
    check(spark.createDataFrame(rows, DOC).coalesce(2))


def test_minimizers_hold_for_equal_strings():
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in (prose(1, 50), "other words " + prose(1, 50)))
    assert s.minimizers(a).tolist() == s.minimizers(b)[12:].tolist() and len(s.minimizers(a)) == len(a) - s.LENGTH + 1
    assert len(s.minimizers(a[:49])) == 0 and len(s.minimizers(a[:50])) == 1
    assert s.union_of(np.array([[5, 9], [0, 3], [3, 4], [8, 12]])) == [(0, 4), (5, 12)]
