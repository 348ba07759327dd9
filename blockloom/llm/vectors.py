"""Embedding near-dedup over an inverted multi-index of two half codebooks."""

from __future__ import annotations

import heapq
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import hash_pair
from blockloom.llm.components import components
from blockloom.storage import drop, few, written

COSINE = 0.93
#: Vectors that the codebooks are fitted on (those of least hash), and rounds of the fit.
SAMPLE, ROUNDS = 8_192, 12
#: Recall at which a traversal may stop, over the pairs just at the threshold.
RECALL = 0.999
#: Vectors of a cell, and visits to it, that one task compares.
BLOCK, VISITS = 1_024, 4_096


def half_codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` centroids of half vectors by Lloyd's rounds from a spread start."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        for j in range(len(c)):
            if (own := near == j).any():
                c[j] = x[own].mean(0)
    return c


def margins(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each half vector, and its distance to the border of every other cell."""
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)
    home = d.argmin(1)
    gap = np.sqrt(np.maximum(((c[home][:, None, :] - c[None]) ** 2).sum(2), 1e-18))
    return home, np.maximum((d - d.min(1)[:, None]) / (2 * gap), 0)


def multi_sequence(a: np.ndarray, b: np.ndarray, reach: float):
    """Cells (i, j) in order of a[i]**2 + b[j]**2, while that sum is within reach**2.

    Both lists are sorted once; a heap holds the frontier of the product grid.
    """
    oa, ob = a.argsort(kind="stable"), b.argsort(kind="stable")
    sa, sb = a[oa] ** 2, b[ob] ** 2
    heap, seen = [(sa[0] + sb[0], 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > reach * reach:
            return
        yield int(oa[i]), int(ob[j])
        for p in ((i + 1, j), (i, j + 1)):
            if p[0] < len(sa) and p[1] < len(sb) and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (sa[p[0]] + sb[p[1]], *p))


def reach(cosine: float, dim: int, recall: float) -> float:
    """How far beyond a cell's border a traversal goes.

    Two unit vectors at the threshold are sqrt(2 - 2 * cosine) apart; over ``dim``
    coordinates the part of that along any one direction is about normal with
    1 / sqrt(dim) of it as deviation.
    """
    return float(np.sqrt(max(2 - 2 * cosine, 0)) / np.sqrt(dim) * NormalDist().inv_cdf(recall))


def _unit(raw: list[bytes], dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _link_block(cosine: float, dim: int, kind: str):
    """Links of one block of a cell with its visits: a count for each visit, and spanning edges.

    A class is known by its node and its number, as ids that repeat give classes one node.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        home = np.asarray(table.column("is_member"))
        ids, nums, mult = (table.column(c).to_numpy() for c in ("rep", "num", "mult"))
        if not home.any():
            return pa.table({"rep": ids[:0], "num": nums[:0], "n": mult[:0], "b": ids[:0]})
        x = _unit(table.column("vec").to_pylist(), dim, kind)
        visit = np.asarray(table.column("is_visit"))
        q, qi, qn = x[visit], ids[visit], nums[visit]
        m, mi, mn, mm = x[home], ids[home], nums[home], mult[home]
        linked = (q @ m.T >= cosine) & ((qi[:, None] != mi[None, :]) | (qn[:, None] != mn[None, :]))
        counts = linked @ mm
        label_q, label_m = qi.copy(), mi.copy()
        while True:  # least id over links within the block
            new_q = np.minimum(label_q, np.where(linked, label_m[None, :], np.iinfo(np.int64).max).min(1))
            new_m = np.minimum(label_m, np.where(linked, new_q[:, None], np.iinfo(np.int64).max).min(0))
            if (new_q == label_q).all() and (new_m == label_m).all():
                break
            label_q, label_m = new_q, new_m
        b = np.concatenate([label_q, label_m])
        n = np.concatenate([counts, np.zeros(len(mi), np.int64)])
        rep, num = np.concatenate([qi, mi]), np.concatenate([qn, mn])
        some = (b != rep) | (n > 0)
        return pa.table({"rep": rep[some], "num": num[some], "n": n[some].astype(np.int64), "b": b[some]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, cells: int | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two rows are linked if their labels are equal and their cosine, in double
    precision, is at least ``cosine``.  Equal vectors of a label are one class from
    the start.  Every class is indexed in the cell of its two nearest half
    centroids and visits cells in order of distance until pairs at the threshold
    are met with probability ``recall`` (closer pairs with more); each meeting is
    verified exactly, so there is no false link.  ``cells`` centroids a half default
    to the fourth root of the number of vectors, 4 at least.

    A cell is cut into blocks of about BLOCK members and VISITS visits, so a hot
    label or cell is spread over tasks.  Blocks return counts and a spanning
    forest, not pairs.  Rows meet their class by a 128-bit key, without the vector.

    Rows link with nothing if the label is null or the vector is null, zero, holds
    a null or a component that isn't finite, or has another length than most.
    A null id is kept.  Rows that repeat an id count their own vector's links, one row
    another too, and share a component.  Extra columns are not read and may have any
    name; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("v", lambda x: x != 0)
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~zero
    clean = base.select("vec_id", "label", F.when(sound, F.transform("v", lambda x: x + 0.0)).alias("v"))  # one zero, not two
    keyed = clean.withColumn("h", F.when(F.col("v").isNotNull(), hash_pair(F.struct("label", "v"))))
    good = keyed.where("v is not null")
    top = good.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if top is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = top["dim"]
    n = top["n"]
    # a class is a label and a vector; its node in the graph is its least id, which it may share with other classes if ids repeat
    own = good.where(F.size("v") == dim).groupBy("h").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    classes = written(own.withColumn("num", F.col("h.a")), "vectors", few(5 * n))
    sample = [r["v"] for r in classes.orderBy("h").limit(SAMPLE).select("v").collect()]
    x = np.array(sample)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = cells or max(round(n**0.25), 4)
    cut = dim // 2
    books = [half_codebook(h, k, s) for s, h in enumerate((x[:, :cut], x[:, cut:])) if h.shape[1]]
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"  # as they came: exact
    far = reach(cosine, dim, recall)

    def visits(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds what is held at once
                yield from visit(batch.slice(at, 256))

    def visit(batch):
        raw = [np.asarray(r, kind) for r in batch.column("v").to_pylist()]
        u = np.array(raw, float)
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        sides = [margins(h, c) for h, c in zip((u[:, :cut], u[:, cut:]), books, strict=False)] if cut else [margins(u, books[0])]
        if len(sides) == 1:
            sides.append((np.zeros(len(u), int), np.zeros((len(u), 1))))
        take, cell, home = [], [], []
        for p in range(len(u)):
            for i, j in multi_sequence(sides[0][1][p], sides[1][1][p], far):
                take.append(p)
                cell.append(i * 65_536 + j)
                home.append(i == sides[0][0][p] and j == sides[1][0][p])
        rest = batch.select(["label", "rep", "num", "mult"])
        for lo in range(0, len(take), 4096):
            part = take[lo : lo + 4096]
            vec = pa.array([raw[p].tobytes() for p in part], pa.binary())
            yield pa.RecordBatch.from_arrays([*rest.take(pa.array(part)).columns, pa.array(cell[lo : lo + 4096], pa.int32()), pa.array(home[lo : lo + 4096], pa.bool_()), vec], names=["label", "rep", "num", "mult", "cell", "home", "vec"])

    met = classes.select("label", "rep", "num", "mult", "v").mapInArrow(visits, "label string, rep long, num long, mult long, cell int, home boolean, vec binary")
    met = written(met, "visits")
    load = met.groupBy("label", "cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("nb"), F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("nv")).where("nb > 0")
    h = F.xxhash64("rep", "num")
    own_b, own_v = F.pmod(h, F.col("nb")).cast("int"), F.pmod(h, F.col("nv")).cast("int")
    # block b of the members meets part s of the visits; a row stands once in each task that it has to do with
    task = F.explode(F.array_union(
        F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: b * 65_536 + own_v),
        F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda s: own_b * 65_536 + s)).otherwise(F.expr("cast(array() as array<int>)")),
    ))
    dealt = met.join(load, ["label", "cell"]).withColumn("task", task)
    dealt = dealt.select("label", "cell", "task", "rep", "num", "mult", "vec", (F.col("home") & (F.floor(F.col("task") / 65_536) == own_b)).alias("is_member"), (F.col("task") % 65_536 == own_v).alias("is_visit"))
    found = written(dealt.groupBy("label", "cell", "task").applyInArrow(_link_block(cosine, dim, kind), "rep long, num long, n long, b long"), "links", few(5 * n))
    drop(met)
    nodes = written(keyed.where(F.size("v") == dim).select("vec_id", "h").join(classes.select("h", "rep"), "h").select("vec_id", "rep").distinct(), "nodes", few(n))
    ends = nodes.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("vec_id", "a")
    by_ids = nodes.join(ends, "vec_id").select("a", F.col("rep").alias("b"))  # an id of several classes links them
    edges = found.where("b <> rep").select(F.col("rep").alias("a"), "b").unionByName(by_ids).distinct()
    named = written(components(edges, n), "components", few(n))
    links = found.groupBy("rep", "num").agg(F.sum("n").alias("others"))
    whole = classes.select("h", "rep", "num", "mult").join(links, ["rep", "num"], "left").select("h", (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    own = nodes.join(named.withColumnRenamed("node", "rep"), "rep", "left").groupBy("vec_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = keyed.select("vec_id", "h").join(whole, "h", "left").join(own, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
