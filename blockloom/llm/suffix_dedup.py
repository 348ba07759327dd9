"""Exact substring dedup over merged Burrows-Wheeler transforms.

A string of LENGTH bytes can only be in two documents if its minimizer (the least
hash of the GRAM-byte strings inside) is.  So documents are first filtered on
minimizers, and what is left is dealt by minimizer: all places of one string meet
in one task.  There, strings whose hash is met again are kept; shards of the distinct
stretches of them get a transform each, and the transforms are merged by refining
their interleave one symbol at a time; after LENGTH rounds the blocks of the
interleave are the repeated strings.

Nothing that grows with the corpus meets in one task.  Of what a batch holds more
than once only the least document travels, as the batch itself knows that the
others repeat it.  A minimizer of more than HOT documents is split: its strings are
dealt by their own hash.  The number of buckets has no limit.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import claim, hash_pair
from blockloom.llm.tokens import rows
from blockloom.storage import drop, few, written

LENGTH, GRAM = 50, 20
_WINDOWS = LENGTH - GRAM + 1
#: Text that a task takes together; symbols of a shard; text for one bucket of minimizers.
_BATCH, SHARD, BUCKET_BYTES = 1 << 18, 1 << 14, 1 << 20
#: Bytes of stretches beyond which a task sends what it has of a batch.
SENT = 1 << 26
#: Documents of a minimizer beyond which its strings are dealt one by one, and places of the map of such minimizers.
HOT, SLOTS = 8_192, 1 << 20
#: Copies of whole texts up to which their ids are broadcast.
BROADCAST_COPIES = 200_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x2545F4914F6CDD1D)


def gram_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all ``n``-byte strings of ``x``, by doubling."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    h = x.astype(np.uint64)
    h += np.uint64(1)
    h *= _C
    size, by_size = 1, {}
    while 2 * size <= n:
        by_size[size] = h
        h = h[:-size] * _A + h[size:]
        size *= 2
    by_size[size] = h
    while size < n:
        part = max(s for s in by_size if s <= n - size)
        left = len(x) - size - part + 1
        h = h[:left] * _B + by_size[part][size : size + left]
        size += part
    h ^= h >> np.uint64(32)
    h *= _A
    h ^= h >> np.uint64(29)
    return h


def minimizers(x: np.ndarray) -> np.ndarray:
    """For each LENGTH-byte string of ``x``, its least hash of GRAM bytes."""
    if len(x) < LENGTH:
        return np.empty(0, np.uint64)
    least, width = gram_hashes(x, GRAM), 1
    while 2 * width <= _WINDOWS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _WINDOWS - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _groups(batch, columns: tuple[str, ...]):
    """Rows of a batch, about _BATCH bytes of text at a time: rows, joined bytes, where each starts."""
    held, size = [], 0
    for r in rows([batch], *columns):
        raw = r[1].encode("utf-8", "surrogatepass")
        held.append((r, raw))
        size += len(raw)
        if size >= _BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _runs(held: list):
    """Runs of strings of one document with one minimizer: its document's number, first place, length, key.

    Keys are minimizers times an odd number: least hashes are small, keys are spread evenly.
    """
    raw = np.frombuffer(b"".join(t for _, t in held), np.uint8)
    sizes = np.array([len(t) for _, t in held])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    m = minimizers(raw)
    if not len(m):
        return raw, starts, *(np.empty(0, int) for _ in range(3)), m
    owner = np.repeat(np.arange(len(held)), sizes)[: len(m)]
    inside = np.arange(len(m)) + LENGTH <= ends[owner]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]]) & inside
    first = np.flatnonzero(new)
    stop = np.flatnonzero(np.concatenate([inside & ~np.concatenate([inside[1:], [False]])])) + 1
    after = np.concatenate([first[1:], [len(m)]])
    end = np.minimum(after, stop[np.searchsorted(stop, first, side="right")]) if len(first) else after[:0]
    return raw, starts, owner[first], first, end - first, m[first] * _B


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of evenly spread keys; it rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(SLOTS - 1)).astype(np.int64)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows starts in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _cut(first: np.ndarray, n: int):
    return itertools.pairwise([*first.tolist(), n])


def _binary(bounds: np.ndarray, values: np.ndarray | bytes) -> pa.Array:
    """Stretches of ``values``, cut at ``bounds``, as a column of bytes."""
    width = 1 if isinstance(values, bytes) else values.itemsize
    values = values if isinstance(values, bytes) else np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(values)])


_COUNTED = ("bucket", "keys", "docs", "counts")


def shared_minimizers(texts: DataFrame, buckets: int, hot: int) -> DataFrame:
    """``doc_id, live``: the minimizers of a document that another one has too, as the low 32 bits of their keys.

    Rows without ``doc_id`` have the slots of minimizers of more than ``hot`` documents.
    A minimizer that several documents of a batch hold is known to be shared
    there; only the least and the greatest of them are sent to be counted, with how many
    there are.  Chance meetings of 32 bits only let a few strings through that are compared later.
    """

    def by_document(k, d):
        k = k.astype(np.uint32)
        order = np.lexsort((k, d))
        k, d = k[order], d[order]
        first = _firsts(d, k)
        k, d = k[first], d[first]
        first = _firsts(d)
        return pa.RecordBatch.from_arrays([pa.array(d[first], pa.int64()), _binary(np.append(first, len(d)), k)], names=["doc_id", "live"])

    def emit(batches):
        claim("suffixes")
        for batch in batches:
            keys, docs = [], []
            for held in _groups(batch, ("doc_id", "text")):
                _, _, owner, _, _, m = _runs(held)
                ids = np.array([r[0] for r, _ in held])
                keys.append(m)
                docs.append(ids[owner] if len(owner) else np.empty(0, np.int64))
            if not keys or not len(k := np.concatenate(keys)):
                continue
            order = np.argsort(k, kind="stable")
            k, d = k[order], np.concatenate(docs)[order]
            first = _firsts(k)
            n = np.diff(np.concatenate([first, [len(k)]]))
            least, most = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
            shared = least != most
            here = np.repeat(shared, n)
            key = k[first]
            sent = np.concatenate([key, key[shared]]), np.concatenate([least, most[shared]]), np.concatenate([n, np.zeros(int(shared.sum()), n.dtype)]).astype(np.uint32)
            order = np.argsort(sent[0], kind="stable")
            sent = [x[order] for x in sent]
            bucket = _bucket(sent[0], buckets)
            first = _firsts(bucket)
            bounds = np.append(first, len(bucket))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), *(_binary(bounds, x) for x in sent)], names=_COUNTED)
            if here.any():  # answers that need no count; they go along to any bucket
                known = [[int(bucket[0])], [k[here].tobytes()], [d[here].tobytes()], [None]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(known)], names=_COUNTED)

    def count(batches):
        def close(held):
            k, d, n = (np.concatenate([np.frombuffer(h[i], t) for h in held]) for i, t in enumerate((np.uint64, np.int64, np.uint32)))
            order = np.lexsort((d, k))
            k, d, n = k[order], d[order], n[order]
            first = _firsts(k)
            size = np.diff(np.concatenate([first, [len(k)]]))
            live = np.repeat(d[first] != d[first + size - 1], size)
            if (many := np.add.reduceat(n.astype(np.int64), first) > hot).any():
                slots = np.unique(_slot(k[first][many])).astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([slots], pa.binary())], names=["doc_id", "live"])
            if live.any():
                yield by_document(k[live], d[live])

        at, held = None, []
        for bucket, k, d, n in rows(batches, *_COUNTED, step=64):
            if n is None:
                yield by_document(np.frombuffer(k, np.uint64), np.frombuffer(d, np.int64))
                continue
            if bucket != at and held:
                yield from close(held)
                held = []
            at = bucket
            held.append((k, d, n))
        if held:
            yield from close(held)

    dealt = texts.select("doc_id", "text").mapInArrow(emit, "bucket int, keys binary, docs binary, counts binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "doc_id long, live binary")


def hot_slots(live: DataFrame) -> bytes:
    """The map of hot minimizers, SLOTS bits: a bit for every key of a slot that holds one.

    Joined on the executors first, so a few maps of fixed size reach the driver.
    Cold minimizers of a hot slot are split too, which costs time and changes nothing.
    """

    def mark(batches):
        bits = np.zeros(SLOTS, bool)
        for (slots,) in rows(batches, "live"):
            bits[np.frombuffer(slots, np.uint32)] = True
        if bits.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    def join(batches):
        bits = np.zeros(SLOTS // 8, np.uint8)
        for (b,) in rows(batches, "bits", step=16):
            bits |= np.frombuffer(b, np.uint8)
        if bits.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([bits.tobytes()], pa.binary())})

    found = live.where("doc_id is null").select("live").mapInArrow(mark, "bits binary").repartition(4).mapInArrow(join, "bits binary").collect()
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in found:
        bits |= np.frombuffer(r["bits"], np.uint8)
    return bits.tobytes()


def _suffix_order(x: np.ndarray) -> np.ndarray:
    """Rotations of a shard of 8-bit symbols, sorted on LENGTH symbols or more."""
    n, width = len(x), 7
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = key << 8 | np.roll(x, -i)
    while True:
        order = np.argsort(key)
        k = key[order]
        new = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        if width >= LENGTH or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (int(new[-1]) + 1) + np.roll(rank, -width)
        width *= 2


def merge_transforms(shards: list[np.ndarray], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of the joined shards in the order of their first ``depth`` symbols, and where a new block starts.

    ``z`` holds the shard of each row of the merged matrix.  A round reads the
    shards' transforms in that order and moves each row by its symbol, stably:
    rows agree on one symbol more.  Two neighbours share ``depth`` symbols exactly
    if no round parted them, so blocks of common prefixes come without a
    comparison of suffixes.
    """
    orders = [_suffix_order(s) for s in shards]
    transform = np.concatenate([s[o - 1] for s, o in zip(shards, orders, strict=True)])
    base = np.cumsum([0, *(len(s) for s in shards[:-1])])
    z = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) <= 256 else np.uint16), [len(s) for s in shards])
    start = np.zeros(len(z), bool)
    start[0] = True
    for _ in range(depth):
        symbols = np.empty_like(transform)
        symbols[np.argsort(z, kind="stable")] = transform
        moved = np.argsort(symbols, kind="stable")
        block = np.cumsum(start, dtype=np.int32)[moved]
        s = symbols[moved]
        start[1:] = (s[1:] != s[:-1]) | (block[1:] != block[:-1])
        z = z[moved]
        if start.all():
            break
    places = np.empty(len(z), np.int64)
    places[np.argsort(z, kind="stable")] = np.concatenate([o + b for o, b in zip(orders, base, strict=True)])
    return places, start


def least_documents(stretches: list[bytes], docs: np.ndarray, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """For every LENGTH-byte string of the stretches (in order), the least document that holds it.

    ``docs`` has the least document of each stretch.  Also where each stretch's strings begin.
    A string whose hash is met once is in its own stretch only; runs of the others
    are merged, equal runs as one.
    """
    sizes = np.array([len(s) for s in stretches])
    strings = sizes - LENGTH + 1
    begin = np.concatenate([[0], np.cumsum(strings)])
    owner = np.repeat(np.arange(len(sizes)), strings)
    at = np.arange(len(owner)) + owner * (LENGTH - 1)
    data = b"".join(stretches)
    h = gram_hashes(np.frombuffer(data, np.uint8), LENGTH)[at]
    order = np.argsort(h)
    same = np.diff(h[order]) == 0
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    out = docs[owner]
    if again.any():
        edge = np.concatenate([[True], ~again[:-1] | (owner[1:] != owner[:-1])])
        first = np.flatnonzero(again & edge)
        last = np.flatnonzero(again & np.concatenate([~again[1:] | (owner[1:] != owner[:-1]), [True]]))
        index: dict[bytes, int] = {}
        of = np.array([index.setdefault(data[a:b], len(index)) for a, b in zip(at[first].tolist(), (at[last] + LENGTH).tolist(), strict=True)])
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, of, docs[owner[first]])
        best, where = _merged(list(index), least, shard)
        n = last - first + 1
        out[again] = best[np.repeat(where[of] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    return out, begin


def _merged(stretches: list[bytes], docs: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """``least_documents`` of stretches that go to the transforms whole."""
    sizes = np.array([len(s) for s in stretches])
    begin = np.concatenate([[0], np.cumsum(sizes - LENGTH + 1)])
    joined = np.zeros(int((sizes + 1).sum()), np.uint8)  # symbol 0 ends a stretch; no byte of UTF-8 is above 244
    ends = np.cumsum(sizes + 1)
    at = ends - sizes - 1
    inside = np.ones(len(joined), bool)
    inside[ends - 1] = False
    joined[inside] = np.frombuffer(b"".join(stretches), np.uint8) + np.uint8(1)
    cuts = [0]
    for e in ends.tolist():
        if e - cuts[-1] >= shard:
            cuts.append(e)
    if cuts[-1] != len(joined):
        cuts.append(len(joined))
    places, start = merge_transforms([joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    whole = np.arange(len(joined)) + LENGTH < ends[owner]
    best = np.where(whole, docs[owner], np.iinfo(np.int64).max)[places]
    first = np.flatnonzero(start)
    least = np.repeat(np.minimum.reduceat(best, first), np.diff(np.concatenate([first, [len(places)]])))
    out = np.empty(int(begin[-1]), np.int64)
    keep = whole[places]
    p = places[keep]
    out[begin[owner[p]] + p - at[owner[p]]] = least[keep]
    return out, begin


def _joined(docs, tags, starts, stops):
    """Byte ranges by document: ids, tags, where each one's ranges begin, and maximal runs as pairs of 32-bit numbers.

    Ranges of a document end in the order in which they start.
    """
    order = np.lexsort((starts, tags, docs))
    d, c, a, b = (x[order] for x in (docs, tags, starts, stops))
    new = _firsts(d, c)
    fresh = np.zeros(len(d), bool)
    fresh[new] = True
    fresh[1:] |= a[1:] > b[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first, len(d))[1:] - 1
    d, c, pairs = d[first], c[first], np.stack([a[first], b[last]], 1).astype(np.uint32)
    one = _firsts(d, c)
    return d[one], c[one], np.append(one, len(d)), pairs


def repeated_spans(marked: DataFrame, buckets: int, slots: bytes) -> DataFrame:
    """``doc_id, tag, spans``: byte ranges of a document that also start in an earlier one, as pairs of 32-bit numbers.

    ``marked(doc_id, text, live)``; ``tag``, the text's crc32, tells rows of one id
    apart.  Stretches around live minimizers are sent by minimizer, those of hot ones
    string by string.  Of equal stretches of a batch only the least document's is sent:
    all of the others' strings are in that one.  A minimizer whose stretches are all
    equal needs no comparison; of the others, the strings that may repeat are merged.
    """
    shard, most = SHARD, SENT
    shared = marked.sparkSession.sparkContext.broadcast(slots)

    def emit(batches):
        hot = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            index, parts, size = {}, [], 0
            for held in _groups(batch, ("doc_id", "text", "live")):
                raw, starts, owner, first, count, m = _runs(held)
                if not len(m):
                    continue
                known = [b"".join(r[2]) for r, _ in held]
                of_known = np.repeat(np.arange(len(held), dtype=np.uint64), [len(x) // 4 for x in known])
                known = of_known << np.uint64(32) | np.frombuffer(b"".join(known), np.uint32)
                live = np.isin(owner.astype(np.uint64) << np.uint64(32) | m & np.uint64(0xFFFFFFFF), known)
                owner, first, count, m = (x[live] for x in (owner, first, count, m))
                deal = m
                if (split := hot[_slot(m)]).any():
                    each = np.where(split, count, 1)
                    owner, m = np.repeat(owner, each), np.repeat(m, each)
                    first = np.repeat(first, each) + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
                    count = np.where(np.repeat(split, each), 1, np.repeat(count, each))
                    deal = np.where(np.repeat(split, each), gram_hashes(raw, LENGTH)[first] * _B, m)
                data, stop = raw.tobytes(), first + count + (LENGTH - 1)
                of = np.array([index.setdefault(data[a:b], len(index)) for a, b in zip(first.tolist(), stop.tolist(), strict=True)], np.int64)
                docs, tags = np.array([r[0] for r, _ in held], np.int64), np.array([zlib.crc32(t) for _, t in held], np.int64)
                parts.append((of, deal, m, docs[owner], tags[owner], first - starts[owner]))
                size += int((stop - first).sum())
                if size >= most:
                    yield from sent(list(index), parts)
                    index, parts, size = {}, [], 0
            if parts:
                yield from sent(list(index), parts)

    def sent(stretches, parts):
        of, deal, keys, docs, tags, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(of):
            return
        least = np.full(len(stretches), np.iinfo(np.int64).max)
        np.minimum.at(least, of, docs)
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        bucket = _bucket(deal, buckets)
        known = docs != least[of]
        answers = _joined(docs[known], tags[known], places[known], places[known] + sizes[of[known]])
        order = np.flatnonzero(~known)
        order = order[np.lexsort((of[order], bucket[order]))]
        of, bucket, keys, docs, tags, places = (x[order] for x in (of, bucket, keys, docs, tags, places))
        one = _firsts(of)
        ends = np.append(one, len(of))
        which, counts = of[one], np.diff(ends).astype(np.uint32)
        piece = _firsts(bucket[one])
        bounds = np.append(piece, len(one))
        at, mine = np.concatenate([[0], np.cumsum(sizes[which])])[bounds], ends[bounds]
        columns = [
            _binary(bounds, keys[one]), _binary(bounds, sizes[which].astype(np.uint32)), _binary(at, b"".join([stretches[i] for i in which.tolist()])), _binary(bounds, counts),
            _binary(mine, docs), _binary(mine, tags.astype(np.uint32)), _binary(mine, places.astype(np.uint32)),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[one][piece], pa.int32()), *columns], names=names)
        if known.any():  # answers that need no comparison; they go along to any bucket
            docs, tags, cuts, pairs = answers
            row = (int(bucket[0]), None, np.diff(cuts).astype(np.uint32).tobytes(), pairs.tobytes(), None, docs.tobytes(), tags.astype(np.uint32).tobytes(), None)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(row)], names=names)

    names = ["bucket", "keys", "sizes", "data", "counts", "docs", "tags", "places"]

    def close(held):
        index: dict[bytes, int] = {}
        of, keys, docs, tags, places = [], [], [], [], []
        for k, sizes, data, counts, d, c, p in held:
            ends = np.cumsum(np.frombuffer(sizes, np.uint32)).tolist()
            numbers = np.array([index.setdefault(data[a:b], len(index)) for a, b in itertools.pairwise([0, *ends])], np.int64)
            keys.append((numbers, np.frombuffer(k, np.uint64)))
            of.append(np.repeat(numbers, np.frombuffer(counts, np.uint32)))
            docs.append(np.frombuffer(d, np.int64))
            tags.append(np.frombuffer(c, np.uint32).astype(np.int64))
            places.append(np.frombuffer(p, np.uint32).astype(np.int64))
        of, docs, tags, places = map(np.concatenate, (of, docs, tags, places))
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, of, docs)
        stretches = list(index)
        key = np.empty(len(index), np.uint64)  # a stretch has one minimizer
        for numbers, k in keys:
            key[numbers] = k
        _, number, size = np.unique(key, return_inverse=True, return_counts=True)
        several = size[number] > 1
        # strings of a stretch that is alone with its minimizer have the stretch's own least document
        alone = ~several[of]
        hit = alone & (least[of] < docs)
        lengths = np.array([len(s) for s in stretches])
        out = [(docs[hit], tags[hit], places[hit], places[hit] + lengths[of[hit]])]
        some = np.flatnonzero(several)
        if len(some):
            best, begin = least_documents([stretches[i] for i in some.tolist()], least[some], shard)
            new = np.full(len(index), -1)
            new[some] = np.arange(len(some))
            mine = np.flatnonzero(~alone)
            o = new[of[mine]]
            n = begin[o + 1] - begin[o]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            cover = best[np.repeat(begin[o], n) + step] < np.repeat(docs[mine], n)
            where = np.repeat(places[mine], n) + step
            edge = np.concatenate([[True], (where[1:] != where[:-1] + 1) | (step[1:] == 0)]) if len(n) else np.empty(0, bool)
            open_ = np.flatnonzero(cover & (edge | ~np.concatenate([[False], cover[:-1]])))
            shut = np.flatnonzero(cover & ~np.concatenate([cover[1:] & ~edge[1:], [False]]))
            out.append((np.repeat(docs[mine], n)[open_], np.repeat(tags[mine], n)[open_], where[open_], where[shut] + LENGTH))
        return _joined(*(np.concatenate(x) for x in zip(*out, strict=True)))

    def merge(batches):
        def batch_of(docs, tags, cuts, pairs):
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), _binary(2 * cuts, pairs)], names=["doc_id", "tag", "spans"])

        at, held = None, []
        for bucket, *rest in rows(batches, *names, step=64):
            if rest[0] is None:
                _, sizes, data, _, docs, tags, _ = rest
                cuts = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.uint32))])
                yield batch_of(np.frombuffer(docs, np.int64), np.frombuffer(tags, np.uint32).astype(np.int64), cuts, np.frombuffer(data, np.uint32))
                continue
            if bucket != at and held:
                yield batch_of(*close(held))
                held = []
            at = bucket
            held.append(rest)
        if held:
            yield batch_of(*close(held))

    schema = "bucket int, keys binary, sizes binary, data binary, counts binary, docs binary, tags binary, places binary"
    dealt = marked.select("doc_id", "text", "live").mapInArrow(emit, schema).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, "doc_id long, tag long, spans binary")


def union_of(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of byte ranges."""
    out: list[list[int]] = []
    for a, b in spans[np.argsort(spans[:, 0], kind="stable")].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:int,stop:int>>"


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``OUT``: for each row of ``docs`` the bytes left when repeated strings are cut, and what was cut.

    A byte goes if some LENGTH-byte string over it, within its document, also
    starts in a document of smaller id; strings are judged on the input.  ``kept``
    are the remaining bytes joined (they may part a character).

    A null text counts as empty; texts under LENGTH bytes are left whole; a text of
    any length is one document.  A row without id loses nothing and takes nothing from
    others.  Rows that share an id are judged each by its own text, and do not remove
    each other's bytes.  Whole copies are found by a 128-bit hash of the text and go
    without comparison.  An empty table gives no rows; extra columns are not read and
    may have any name.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    named = base.where("doc_id is not null")
    total = named.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n, buckets = total["n"], int((total["b"] or 0) // BUCKET_BYTES) + 1
    hashed = named.where(F.octet_length("text") >= LENGTH).withColumn("h", hash_pair(F.col("text"))).withColumn("tag", F.crc32(F.col("text").cast("binary")))
    least = hashed.groupBy("h").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = written(hashed.select("doc_id", "h", "tag").join(least, "h").where("doc_id > least").select("doc_id", "h", "tag").distinct(), "copies", few(n))
    gone = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    first = hashed.join(gone.select("doc_id", "h"), ["doc_id", "h"], "left_anti").select("doc_id", "text")
    live = written(shared_minimizers(first, buckets, HOT), "live", few(40 * n))
    mine = live.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("live").alias("live"))
    # texts are dealt by their id once more here, and once at the end: what is known of copies comes with the small tables
    mine = mine.join(copies.groupBy("doc_id").agg(F.collect_set("h").alias("gone")), "doc_id", "left")
    marked = hashed.join(mine, "doc_id").where("gone is null or not array_contains(gone, h)")
    spans = written(repeated_spans(marked, buckets, hot_slots(live)), "spans", few(40 * n))
    drop(live)
    whole = copies.groupBy("doc_id", "tag").agg(F.collect_set("h").alias("gone"))
    cut = spans.groupBy("doc_id", "tag").agg(F.collect_list("spans").alias("spans")).join(whole, ["doc_id", "tag"], "full")

    def apply(batches):
        for batch in batches:
            out = []
            for doc_id, text, copy, parts in rows([batch], "doc_id", "text", "is_copy", "spans", step=64):
                raw = text.encode("utf-8", "surrogatepass")
                runs = [(0, len(raw))] if copy else union_of(np.concatenate([np.frombuffer(p, np.uint32).reshape(-1, 2) for p in parts]).astype(np.int64)) if parts else []
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out.append((doc_id, len(raw), sum(b - a for a, b in runs), len(runs), b"".join(kept), [{"start": a, "stop": b} for a, b in runs]))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in OUT.split(", ", 5)])

    joined = base.withColumn("tag", F.crc32(F.col("text").cast("binary"))).join(cut, ["doc_id", "tag"], "left")
    copy = F.coalesce(F.array_contains("gone", hash_pair(F.col("text"))), F.lit(False)).alias("is_copy")
    return joined.select("doc_id", "text", copy, "spans").mapInArrow(apply, OUT)

