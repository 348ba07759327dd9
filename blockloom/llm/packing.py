"""Bounded-space online packing of token ids into windows of one length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import by_id
from blockloom.llm.tokens import CACHE, encoder, rows
from blockloom.storage import written

WINDOW = 4096
#: Windows that a task keeps open.
OPEN = 16
#: The fullest window is emitted as it is when its gap is no larger than this; else the document is cut to fill it.
GAP = 16
#: Tasks whose leftovers are merged together.
MERGE = 16
_MERGED = 1 << 60

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(a, pa.binary() if b == "binary" else pa.int64()) for a, b in (x.split() for x in PIECES.split(", "))] + [("shard", pa.int32()), ("open", pa.bool_())])


class Packer:
    """Online best fit over at most ``most`` open windows.

    ``add`` and ``finish`` yield windows, each a list of (doc_id, start, doc_tokens, ids).
    """

    def __init__(self, window: int, most: int, gap: int, size: int):
        self.window, self.most, self.gap, self.size = window, most, gap, size
        #: (free ids, number) in order, and what is in each window.
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.next = 0

    def _put(self, free: int, k: int, piece: tuple) -> None:
        self.held[k].append(piece)
        insort(self.free, (free - len(piece[3]) // self.size, k))

    def add(self, doc_id, start: int, total: int, ids: bytes):
        while ids:
            n = len(ids) // self.size
            if n >= self.window:
                cut = self.window * self.size
                yield [(doc_id, start, total, ids[:cut])]
                start, ids = start + self.window, ids[cut:]
                continue
            i = bisect_left(self.free, (n, -1))
            if i < len(self.free):
                free, k = self.free.pop(i)
                self._put(free, k, (doc_id, start, total, ids))
                if self.free[0][0] == 0:
                    yield self.held.pop(self.free.pop(0)[1])
                return
            if len(self.free) < self.most:
                self.held[self.next] = []
                self._put(self.window, self.next, (doc_id, start, total, ids))
                self.next += 1
                return
            free, k = self.free.pop(0)
            if free > self.gap:
                cut = free * self.size
                self.held[k].append((doc_id, start, total, ids[:cut]))
                start, ids = start + free, ids[cut:]
            yield self.held.pop(k)

    def finish(self):
        for _, k in self.free:
            yield self.held.pop(k)


def _emitter(dtype: np.dtype, shard: int, first: int):
    """Collects placed windows as rows and gives them back as batches."""
    state = {"n": 0, "rows": [], "bytes": 0}

    def place(window: list, left_open: bool) -> None:
        offset, number = 0, first + state["n"]
        state["n"] += 1
        for doc_id, start, total, ids in window:
            n = len(ids) // dtype.itemsize
            crc = zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes())
            state["rows"].append((doc_id, start, n, crc, total, number, offset, ids, shard, left_open))
            offset += n
            state["bytes"] += len(ids)

    def ready(last: bool = False):
        if state["rows"] and (last or state["bytes"] > 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*state["rows"], strict=True), _ARROW, strict=True)], schema=_ARROW)
            state["rows"], state["bytes"] = [], 0

    return place, ready


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, most_open: int = OPEN, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """Pieces of every document, each placed in one window of at most ``window`` ids.

    Each scan task encodes and packs its own rows; no text is shuffled.  A
    document is placed whole where it fits best; where it fits nowhere, the
    fullest window is topped up with its first ids and emitted, so a window is
    padded by ``gap`` ids at most.  What stays open (``most_open`` windows a task)
    is merged over ``MERGE`` tasks at a time; one window of each merge stays
    short.  ``cache`` bounds what a worker remembers of the
    vocabulary.  Rows carry the ids (little-endian, of the vocabulary's width).

    A null text counts as empty and is the end id alone; null ids stay null;
    repeated rows are packed as often as they stand; an empty table gives no
    rows.  The first pass is written to the shared folder, so that windows of a
    task that has to run again can't be mixed.
    """

    def first(batches):
        enc, shard = encoder(tokenizer, cache), TaskContext.get().partitionId()
        end, size = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        packer = Packer(window, most_open, gap, size)
        place, ready = _emitter(enc.dtype, shard, shard << 32)
        for doc_id, text in rows(batches, "doc_id", "text"):
            ids = enc.encode(text) + end
            for done in packer.add(doc_id, 0, len(ids) // size, ids):
                place(done, False)
                yield from ready()
        for left in packer.finish():
            place(left, True)
        yield from ready(last=True)

    def merge(batches):
        enc = encoder(tokenizer, cache)
        packer = Packer(window, 1, 0, enc.dtype.itemsize)
        place = ready = None
        for group, doc_id, start, total, ids in rows(batches, "grp", "doc_id", "start", "doc_tokens", "ids"):
            if place is None or group != at:
                if place:
                    for done in packer.finish():
                        place(done, False)
                    yield from ready(last=True)
                    packer = Packer(window, 1, 0, enc.dtype.itemsize)
                at, (place, ready) = group, _emitter(enc.dtype, group, _MERGED + (group << 32))
            for done in packer.add(doc_id, start, total, ids):
                place(done, False)
                yield from ready()
        if place:
            for done in packer.finish():
                place(done, False)
            yield from ready(last=True)

    schema = f"{PIECES}, shard int, open boolean"
    placed = written(by_id(docs, id_col, text_col).mapInArrow(first, schema), "packed")
    left = placed.where("open").withColumn("grp", (F.col("shard") / MERGE).cast("int"))
    groups = (placed.agg(F.max("shard")).first()[0] or 0) // MERGE + 1
    merged = left.repartitionByRange(groups, "grp").sortWithinPartitions("grp", "sequence_id", "offset").mapInArrow(merge, schema)
    names = [x.split()[0] for x in PIECES.split(", ")]
    return placed.where("not open").select(names).unionByName(merged.select(names))
