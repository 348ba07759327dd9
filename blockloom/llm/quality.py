"""Quality classifier: naive Bayes scaled n-gram indicators under a linear hinge-loss model."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import by_id, claim, fresh
from blockloom.llm.tokens import rows

#: Byte n-grams of these lengths, each hashed into a table of 2**BITS places.
GRAMS, BITS = (1, 2, 3, 4), 16
PLACES = len(GRAMS) << BITS
#: Labelled rows of each class that the model is fitted on: those of least hash of their id.
SAMPLE = 4_000
#: Shares of the labels' ids that are never learned from, by crc32 of the id as text.
FOLDS, HELD_OUT = 4, 2
KEEP = 0.7


def _spread(code: np.ndarray, n: int) -> np.ndarray:
    """16-bit places of packed n-grams: exact up to two bytes, mixed above."""
    if n <= 2:
        return code
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def grams(text: str) -> np.ndarray:
    """The place of each n-gram of a whole text, as often as it stands."""
    x = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out, code = [], np.zeros(len(x), np.uint32)
    for k, n in enumerate(GRAMS):
        if len(x) < n:
            break
        code = (code[: len(x) - n + 1] << np.uint32(8)) | x[n - 1 :]
        out.append(np.uint32(k << BITS) + _spread(code, n))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def seen(text: str) -> np.ndarray:
    """Which places the n-grams of a whole text fill."""
    out = np.zeros(PLACES, bool)
    out[grams(text)] = True
    return out


class Distinct:
    """Distinct places of a text in time of its length: the last to stamp a place stands for it."""

    def __init__(self):
        self.stamp = np.empty(PLACES, np.int64)

    def __call__(self, at: np.ndarray) -> np.ndarray:
        number = np.arange(len(at))
        self.stamp[at] = number
        return at[self.stamp[at] == number]


def _curve_inputs(margin, size):
    """What the score's curve sees: margin and text size, as short texts have noisier margins."""
    long = np.log1p(np.asarray(size, float)) / 8
    margin = np.asarray(margin, float)
    return np.stack([margin, margin * long, long, np.ones_like(long)], -1)


@dataclass
class Model:
    """``score`` is a logistic curve of the margin and the number of indicators.

    The margin divides by the length of the scaled indicators.
    """

    weight: np.ndarray
    square: np.ndarray
    curve: np.ndarray

    def margin(self, at: np.ndarray) -> float:
        return float(self.weight[at].sum() / np.sqrt(max(self.square[at].sum(), 1e-12))) if len(at) else 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of a batch of texts; its curve is taken at once."""
        distinct, margins, sizes = Distinct(), [], []
        for text in texts:
            at = distinct(grams(text))
            margins.append(self.margin(at))
            sizes.append(len(at))
        return 1 / (1 + np.exp(-np.clip(_curve_inputs(margins, sizes) @ self.curve, -35, 35)))

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def log_count_ratio(samples: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of each indicator's share among class 1 over its share among class 0."""
    counts = [np.full(PLACES, smooth), np.full(PLACES, smooth)]
    for x, y in zip(samples, labels, strict=True):
        counts[int(y)][x] += 1
    n = [(labels == k).sum() + 2 * smooth for k in (0, 1)]
    return np.log(counts[1] / n[1]) - np.log(counts[0] / n[0])


def dual_coordinate_descent(samples: list[np.ndarray], labels: np.ndarray, r: np.ndarray, cost: float = 3.0, rounds: int = 20, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of the L2-regularized linear hinge-loss model on unit vectors of scaled indicators.

    Each step solves one dual variable exactly within 0 and ``cost`` and moves the
    weights by it; the order is a fixed permutation a round.  Ends when no gradient
    that a bound doesn't hold back is above ``tolerance``, or after ``rounds``.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    vectors = [(r[x] / np.sqrt(max((r[x] ** 2).sum(), 1e-12))) for x in samples]
    diagonal = np.array([max(v @ v, 1e-12) for v in vectors])
    w, alpha = np.zeros(PLACES), np.zeros(len(y))
    order = np.random.default_rng(0)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(y)):
            x, v = samples[i], vectors[i]
            gradient = y[i] * (w[x] @ v) - 1
            free = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost else gradient
            worst = max(worst, abs(free))
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost)
            if new != alpha[i]:
                w[x] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if worst <= tolerance:
            break
    return w


def _fit_curve(x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a little shrinkage."""
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        g = x.T @ (weight * (p - labels)) + 1e-2 * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta -= step
        if abs(step).max() < 1e-9:
            break
    return beta


def fit(samples: list[np.ndarray], labels: np.ndarray, prior: float) -> Model:
    """Fits on sparse indicators; ``prior`` is the share of label 1 among all labelled rows.

    The curve from margins to scores is fitted on margins of rows that the model
    at hand did not see (two halves), each class weighted to its true share.
    One class alone, or no rows, gives a constant score.
    """
    if len(set(labels.tolist())) < 2:
        p = min(max(prior, 1e-3), 1 - 1e-3) if len(labels) else 0.5
        return Model(np.zeros(PLACES), np.zeros(PLACES), np.array([0.0, 0.0, 0.0, np.log(p / (1 - p))]))
    half = np.arange(len(labels)) % 2
    margin = np.zeros(len(labels))
    for k in (0, 1):
        own = np.flatnonzero(half != k)
        if len(set(labels[own].tolist())) < 2:
            continue
        part = [samples[i] for i in own]
        r = log_count_ratio(part, labels[own])
        w = dual_coordinate_descent(part, labels[own], r) * r
        for i in np.flatnonzero(half == k):
            margin[i] = w[samples[i]].sum() / np.sqrt(max((r[samples[i]] ** 2).sum(), 1e-12))
    r = log_count_ratio(samples, labels)
    w = dual_coordinate_descent(samples, labels, r)
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    return Model(w * r, r**2, _fit_curve(_curve_inputs(margin, [len(x) for x in samples]), labels, weight))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Model of ``label_col`` from at most ``sample`` labelled rows of each class.

    Rows of the held-out fold, without id or without label are left out; of
    rows that label one id differently the lowest label counts.  Only the ids and
    labels are ordered; texts are read for the chosen ids alone and reach the
    driver as bit maps of indicators, 32 kB each at most.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held_out("doc_id"))
    one = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    shares = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in shares:
        part = one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return fit([], np.array([]), 0.5)
    picked = [(r["doc_id"], r["y"]) for r in chosen.collect()]
    few = docs.sparkSession.createDataFrame(picked, "doc_id long, y int")

    def places(batches):
        claim("quality")
        for batch in batches:
            out = [(i, y, zlib.compress(np.packbits(seen(t)).tobytes(), 1)) for i, y, t in rows([batch], "doc_id", "y", "text")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "y", "places"])

    got = by_id(docs, id_col, text_col).join(F.broadcast(few), "doc_id").mapInArrow(places, "doc_id long, y int, places binary").collect()
    got = sorted({(r["doc_id"], r["y"], bytes(r["places"])) for r in got})
    total = sum(shares.values())
    samples = [np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(p), np.uint8))).astype(np.int32) for _, _, p in got]
    return fit(samples, np.array([y for _, y, _ in got]), shares.get(1, 0) / total)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", target: str = "score") -> DataFrame:
    """``docs`` with a score of each whole text; a null text is scored as an empty one.

    All rows and columns stay; equal texts have equal scores, whatever else their rows
    hold, and a text of any length is scored whole.  A column of the name ``target`` is
    replaced.  An empty table gives no rows.  The model is a broadcast of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def apply(texts: pa.Array) -> pa.Array:
        claim("quality")
        return pa.array(np.concatenate([shared.value.scores([t.as_py() or "" for t in texts.slice(i, 256)]) for i in range(0, len(texts), 256)] or [np.empty(0)]), pa.float64())

    return docs.withColumn(target, apply(F.col(f"`{text_col}`")))


def quality_filter(docs: DataFrame, labels: DataFrame, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that score ``keep`` or more (a tie stays), with their columns.

    Null, empty, long and repeated texts as in ``score``; a null id is no matter.  No labels at all
    give every row the score 0.5.  Extra columns may have any name; ours gives way.
    """
    (name,) = fresh(docs.columns, "bl_score")
    return score(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col, name).where(F.col(name) >= keep).drop(name)
