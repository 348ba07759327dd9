"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures, links confirmed on full sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import by_id, claim
from blockloom.llm.components import components
from blockloom.llm.tokens import rows
from blockloom.storage import drop, few, written

#: A signature is CHUNKS chunks of WIDTH symbols of 16 bits.
CHUNKS, WIDTH = 12, 4
SYMBOLS = CHUNKS * WIDTH
#: Errors allowed in one chunk, and so the signature distance below which no pair is missed:
#: were every chunk to hold more than one error, there would be 2 * CHUNKS.
CHUNK_ERRORS = 1
DISTANCE = (CHUNK_ERRORS + 1) * CHUNKS - 1
#: Members of a bucket, and sets of a group, that one task compares with as many others; pivots of a group.
BUCKET_BLOCK, GROUP_BLOCK, PIVOTS = 16_384, 256, 64


def _odd(seed: str, n: int) -> np.ndarray:
    """Odd 64-bit multipliers from a rule."""
    raw = b"".join(hashlib.blake2b(f"{seed}{i}".encode(), digest_size=8).digest() for i in range(n))
    return np.frombuffer(raw, "<u8") | np.uint64(1)


_MIN = _odd("minhash", SYMBOLS)


class _Words(dict):
    """64-bit hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words of a whole text.

    A-Z are lowered; words stand between blanks and the controls from tab to
    carriage return.  A shorter text is one shingle, one without words is none.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    mult = _odd(f"words{n}", n)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * mult[i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def signature(found: np.ndarray) -> bytes:
    """The low 16 bits of the least value under each of the SYMBOLS hash functions."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        least = np.minimum(least, (found[i : i + 4096, None] * _MIN).min(0))
    return least.astype("<u2").tobytes()


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each chunk and each symbol of it that may differ: the others, exactly."""
    s = sig.reshape(len(sig), CHUNKS, WIDTH).astype(np.int64)
    keys = np.empty((len(sig), CHUNKS, WIDTH), np.int64)
    for left_out in range(WIDTH):
        key = np.arange(CHUNKS, dtype=np.int64) * WIDTH + left_out
        for i in range(WIDTH):
            if i != left_out:
                key = key << 16 | s[:, :, i]
        keys[:, :, left_out] = key
    return keys.reshape(len(sig), -1)


def _set_key(found: bytes) -> bytes | None:
    return hashlib.blake2b(found, digest_size=16).digest() if found else None


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, sig``; sets without elements have neither key nor signature."""

    def scan(batches):
        claim("shingles", _WORDS.clear)
        for batch in batches:
            out = [], [], [], []
            for doc_id, text in rows([batch], "doc_id", "text"):
                s = shingles(text, words)
                out[0].append(doc_id)
                out[1].append(len(s))
                out[2].append(_set_key(s.tobytes()))
                out[3].append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "n_shingles", "set_key", "sig"])

    return docs.mapInArrow(scan, "doc_id long, n_shingles long, set_key binary, sig binary")


def _bucket_edges(batches):
    """Spanning edges of each bucket's pairs within DISTANCE; rows come sorted by bucket."""
    def span(ids: list, sigs: list):
        s = np.frombuffer(b"".join(sigs), "<u2").reshape(len(ids), SYMBOLS)
        left = np.arange(len(ids))
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = (s[left] != s[x]).sum(1) <= DISTANCE
                for y in left[near]:
                    a, b = ids[x], ids[y]
                    yield (a, b) if a < b else (b, a)
                queue += left[near].tolist()
                left = left[~near]

    def out(pairs: list):
        a, b = zip(*pairs, strict=True)
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    at, ids, sigs, pairs = None, [], [], set()
    for key, block, rep, sig in rows(batches, "key", "block", "rep", "sig", step=4096):
        if (key, block) != at:
            pairs.update(span(ids, sigs))
            at, ids, sigs = (key, block), [], []
            if len(pairs) > 50_000:
                yield out(list(pairs))
                pairs = set()
        ids.append(rep)
        sigs.append(sig)
    pairs.update(span(ids, sigs))
    if pairs:
        yield out(list(pairs))


def candidate_edges(classes: DataFrame) -> DataFrame:
    """``a, b``: edges between the nodes of ``classes(num, rep, sig)`` whose components are those of all pairs within DISTANCE.

    Buckets with one member go first, on keys and ids alone (counted before the
    shuffle); signatures travel only with the rest, by the number of their class.  A bucket above BUCKET_BLOCK
    members is cut into blocks and each pair of blocks is a task of its own.
    Within a bucket the search starts at one member and takes all within reach,
    so a bucket of near copies costs its size, not its square.
    """

    def keys(batches):
        for batch in batches:
            nums = batch.column("num").to_numpy()
            if not len(nums):
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS)
            k = chunk_keys(sig)
            yield pa.RecordBatch.from_pydict({"key": pa.array(k.reshape(-1)), "num": pa.array(np.repeat(nums, k.shape[1]))})

    keyed = classes.select("num", "sig").mapInArrow(keys, "key long, num long")
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("num"), blocks).cast("long")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda t: F.least(own, t) * 65_536 + F.greatest(own, t))
    member = keyed.join(many, "key").select("key", "num", F.explode(pair).alias("block"))
    dealt = member.join(classes.select("num", "rep", "sig"), "num").repartition("key", "block").sortWithinPartitions("key", "block", "rep")
    return dealt.mapInArrow(_bucket_edges, "a long, b long").distinct()


def _links(ids: np.ndarray, sets: list[np.ndarray], percent: int, split: int | None, skip: np.ndarray | None = None):
    """Pairs (i, j) of positions with 100 * intersection >= percent * union, as a boolean matrix.

    ``split``: compare the first ``split`` sets with all; None: all with all.
    """
    n = len(sets)
    m = n if split is None else split
    if n <= 1 or m == 0:
        return np.zeros((m, n), bool)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate(([True], flat[1:] != flat[:-1]))
    number = np.cumsum(first) - 1
    shared = np.bincount(number)[number] > 1
    number, owner = number[shared], owner[shared]
    inter = np.zeros((m, n), np.int64)
    if len(number):
        number = np.cumsum(np.concatenate(([0], number[1:] != number[:-1])))
        step = 2048
        for lo in range(0, int(number[-1]) + 1, step):
            a, b = np.searchsorted(number, (lo, lo + step))
            x = np.zeros((n, step), np.float32)
            x[owner[a:b], number[a:b] - lo] = 1
            inter += np.rint(x[:m] @ x.T).astype(np.int64)
    union = size[:m, None] + size[None, :] - inter
    return 100 * inter >= percent * union


def _span(ids: np.ndarray, linked: np.ndarray):
    """Edges of a spanning forest of the links between the first rows and all."""
    m, n = linked.shape
    left = np.ones(n, bool)
    for start in range(m):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            near = (linked[x] if x < m else linked[:, x]) & (left if x < m else left[:m])
            for y in np.flatnonzero(near):
                left[y] = False
                queue.append(y)
                yield int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))


def _compare(percent: int):
    """Links between the ``left`` and all sets of each (grp, task); rows come sorted."""

    def run(batches):
        def close(ids, lefts, sets):
            if len(ids) < 2 or not any(lefts):
                return
            order = sorted(range(len(ids)), key=lambda i: not lefts[i])
            names, some = np.array(ids)[order], [sets[i] for i in order]
            yield from _span(names, _links(names, some, percent, sum(lefts)))

        at, ids, lefts, sets, pairs = None, [], [], [], set()
        for grp, task, rep, left, s in rows(batches, "grp", "task", "rep", "is_left", "shingles"):
            if (grp, task) != at:
                pairs.update(close(ids, lefts, sets))
                at, ids, lefts, sets = (grp, task), [], [], []
            ids.append(rep)
            lefts.append(left)
            sets.append(np.frombuffer(s, np.uint64))
        pairs.update(close(ids, lefts, sets))
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _dealt(tasks: DataFrame, percent: int) -> DataFrame:
    ready = tasks.repartition("grp", "task").sortWithinPartitions("grp", "task", "rep")
    return ready.mapInArrow(_compare(percent), "a long, b long").distinct()


def confirmed_edges(members: DataFrame, sets: DataFrame, percent: int, n: int) -> tuple[DataFrame, list[DataFrame]]:
    """Edges whose components are those of all links within the groups of ``members(cls, rep, grp)``.

    First the pivots of each group (PIVOTS of them or so, by hash) meet every
    block of as many: linear in the group, and complete for groups of one
    block.  Then only sets that are not yet in their group's main component
    meet the blocks of all others.  No pair is skipped unless both ends are
    already connected.  Tasks hold two blocks at most.  All this is dealt on ids;
    ``sets(cls, shingles)`` join their task last.
    """
    size = F.count(F.lit(1))
    sized = members.join(members.groupBy("grp").agg(F.ceil(size / PIVOTS).cast("int").alias("nb")), "grp")
    placed = sized.withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    is_pivot = F.col("blk") == 0
    to = F.when(is_pivot, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("blk"))
    first = written(_dealt(placed.select("cls", "grp", "rep", is_pivot.alias("is_left"), F.explode(to).alias("task")).join(sets, "cls"), percent), "links", few(n))
    large = placed.where("nb > 1").select("cls", "grp", "rep")
    if large.limit(1).count() == 0:
        return first, [first]
    known = components(first, n)
    named = written(large.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "named", few(n))
    sizes = named.groupBy("grp", "component").agg(size.alias("n"))
    main = sizes.groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"))
    rest = named.join(main.where("n_all > n_main"), "grp").withColumn("is_rest", F.col("component") != F.col("main"))
    nr = F.ceil((F.col("n_all") - F.col("n_main")) / GROUP_BLOCK).cast("long")
    nm = F.ceil(F.col("n_main") / GROUP_BLOCK).cast("long")
    h = F.xxhash64("cls", F.lit(2))
    mine = F.when(F.col("is_rest"), F.pmod(h, nr)).otherwise(nr + F.pmod(h, nm)).cast("long")
    # a task is one block of the rest against one block of any kind; among the rest each pair of blocks once
    as_left = F.transform(F.sequence(mine, nr + nm - 1), lambda t: F.struct((mine * 4_294_967_296 + t).alias("task"), F.lit(True).alias("is_left")))
    as_other = F.transform(F.sequence(F.lit(0).cast("long"), F.least(mine - 1, nr - 1)), lambda t: F.struct((t * 4_294_967_296 + mine).alias("task"), F.lit(False).alias("is_left")))
    no_task = F.expr("cast(array() as array<struct<task:bigint,is_left:boolean>>)")
    tasks = F.concat(F.when(F.col("is_rest"), as_left).otherwise(no_task), F.when(mine > 0, as_other).otherwise(no_task))
    dealt = rest.select("cls", "grp", "rep", F.explode(tasks).alias("t")).select("cls", "grp", "rep", "t.task", "t.is_left")
    second = written(_dealt(dealt.join(sets, "cls"), percent), "links", few(n))
    return first.unionByName(second), [first, second, named]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two rows are linked if 100 * intersection >= ``percent`` * union of their
    sets of distinct shingles of ``words`` words; ``component_id`` is the least id
    reachable over links.  Rows of equal sets are one class from the start.
    Candidate pairs are those within DISTANCE of 48 symbols: at a similarity of
    0.8 a pair is farther apart with a probability of about 3e-7.

    A null or empty text, or one of white space, has an empty set and links with
    nothing; a text of any length is taken whole.  A null id is kept and links with
    nothing.  Rows that repeat an id are one document with several texts: each
    text's links count, and the rows share a component.  An empty table gives no
    rows.  Extra columns are not read and may have any name.
    """
    texts = by_id(docs, id_col, text_col)
    sigs = written(signatures(texts, words), "signatures")
    n = sigs.count()
    some = sigs.where("set_key is not null and doc_id is not null")
    # a class is a set; its node in the graph is its least id, which it may share with other classes if ids repeat
    classes = written(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")).withColumn("num", F.xxhash64("set_key")), "classes", few(n))
    named = written(some.select("doc_id", "set_key").join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep").distinct(), "nodes", few(n))
    edges = written(candidate_edges(classes), "candidates", few(n))
    groups = components(edges, n).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    members = written(classes.select(F.col("set_key").alias("cls"), "rep").join(groups, "rep"), "members", few(n))

    def full_sets(batches):
        claim("shingles", _WORDS.clear)
        for batch in batches:
            sets = [shingles(t, words).tobytes() for (t,) in rows([batch], "text")]
            if sets:
                yield pa.RecordBatch.from_pydict({"cls": pa.array(map(_set_key, sets), pa.binary()), "shingles": pa.array(sets, pa.binary())})

    wanted = texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = written(wanted.mapInArrow(full_sets, "cls binary, shingles binary").dropDuplicates(["cls"]), "sets", few(5 * n))
    links, used = confirmed_edges(members, sets, percent, n)
    # an id of several classes links them
    ends = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id", "a")
    by_ids = named.join(ends, "doc_id").select("a", F.col("rep").alias("b")).distinct()
    found = written(components(links.unionByName(by_ids), n), "components", few(n))
    drop(edges, classes, members, sets, *used)
    own = named.join(found.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = sigs.select("doc_id", "n_shingles").join(own, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
