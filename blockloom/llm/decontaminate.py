"""Benchmark decontamination: latent semantic retrieval, then subsequence and answer checks.

Passages are TF-IDF rows over the items' words, projected on a basis from a
randomized SVD over the whole corpus; the nearest item of each passage is a
candidate from a cosine of COSINE on.  A basis of fixed rank can't tell any number of
items apart, and a passage may hold several, so the words that a leak can't do without
are looked up beside it: together the candidates are a superset of all leaks, and the
checks decide alone.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import by_id, claim, fresh
from blockloom.llm.tokens import rows
from blockloom.storage import written

#: Words of a passage, and from one passage to the next.
PASSAGE, STRIDE = 32, 16
#: Latent dimensions, and random directions beyond them.
RANK, EXTRA = 64, 16
#: A passage that holds less of any item's squared weight than this is left out of the basis.
LEAST_WEIGHT = 0.25
#: Share of an item's words in order in a document: a leak; and a leak if its answer is there too.
LEAK, PARAPHRASE = 0.8, 0.5
#: Latent cosine from which the nearest item is a candidate for a passage.
COSINE = 0.5
#: Items whose tables are looked up together; more are taken in blocks, all within one pass over the documents.
ITEMS = 2_000
_PARTS = 4
#: Words of documents that are searched together, and words that are looked up at once.
_TOGETHER, _AT_ONCE = 1 << 16, 1 << 20
_SIGNS = b".,;:!?\"'()[]{}<>|*"


def words(text: str) -> list[bytes]:
    """Words of a whole text, A-Z lowered, common signs taken off."""
    return text.encode("utf-8", "surrogatepass").lower().translate(None, _SIGNS).split()


def common_subsequence(a_bits: dict, n: int, b: list) -> int:
    """Length of the longest common subsequence of an item of ``n`` words and ``b``.

    ``a_bits`` has the places of each word as bits; a step over ``b`` is one addition.
    """
    full = (1 << n) - 1
    free = full
    for w in b:
        if hit := a_bits.get(w, 0) & free:
            free = ((free + hit) | (free & ~hit)) & full
    return n - free.bit_count()


def _stands_in(part: np.ndarray, whole: np.ndarray) -> bool:
    """Whether ``part`` stands in ``whole`` without a gap."""
    return 0 < len(part) <= len(whole) and bool((np.lib.stride_tricks.sliding_window_view(whole, len(part)) == part).all(1).any())


def _bits(seq: list) -> dict:
    out: dict = {}
    for i, w in enumerate(seq):
        out[w] = out.get(w, 0) | 1 << i
    return out


def answer_words(text: str) -> list[bytes]:
    """The last sentence of an item if it has four words or more, else its last quarter."""
    all_words = words(text)
    last = words(text.rstrip().rstrip(".!?").rpartition(". ")[2])
    quarter = all_words[-max(1, len(all_words) // 4) :]
    return last if 4 <= len(last) < len(all_words) else quarter


@dataclass
class Index:
    """What a search needs of the items; it grows with them, not with the corpus.

    Items go by their place; ``ids`` are reported and may be null or repeat.
    """

    ids: list[int | None]
    seqs: list[list[bytes]]
    answers: list[list[bytes]]
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    seen: np.ndarray | None = None
    idf: np.ndarray | None = None
    floor: float = 0.0
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in tokens], np.int32)

    def least(self) -> float:
        return LEAST_WEIGHT * min(float((self.idf[self.numbers(s)] ** 2).sum()) for s in self.seqs)


def passages(n: int, stride: int = STRIDE) -> np.ndarray:
    """First words of the passages of ``n`` words; the last ones reach past the end."""
    return np.arange(0, max(n - PASSAGE, 0) + stride, stride) if n else np.empty(0, int)


def _padded(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    full = np.concatenate([numbers, np.zeros(PASSAGE, np.int32)])
    return full[np.minimum(starts[:, None] + np.arange(PASSAGE), len(full) - 1)]


def _heavy(index: Index, numbers: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages that hold enough weight to be near an item: their starts and word numbers."""
    starts = passages(len(numbers), stride)
    total = np.concatenate([[0.0], np.cumsum(index.idf[numbers] ** 2)])
    mass = total[np.minimum(starts + PASSAGE, len(numbers))] - total[np.minimum(starts, len(numbers))]
    starts = starts[mass >= index.floor]
    return starts, _padded(numbers, starts)


def _vectors(index: Index, windows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Weights of each passage's words, scaled by the root of their squares' sum, times a matrix over the vocabulary."""
    w = index.idf[windows].astype(np.float32)
    w /= np.maximum(np.sqrt((w**2).sum(1, keepdims=True)), 1e-6)
    return np.einsum("ij,ijk->ik", w, matrix[windows])


def _summed(df: DataFrame, fn, shape: tuple[int, ...], dtype: str) -> np.ndarray:
    """Sum of one array a task: first over a few parts on the executors, then here."""

    def each(batches):
        out = np.zeros(shape, dtype)
        for x in fn(batches):
            out += x
        yield pa.RecordBatch.from_pydict({"data": pa.array([out.tobytes()], pa.binary())})

    def fold(batches):
        out = None
        for (data,) in rows(batches, "data", step=1):
            out = (0 if out is None else out) + np.frombuffer(data, dtype)
        if out is not None:
            yield pa.RecordBatch.from_pydict({"data": pa.array([out.tobytes()], pa.binary())})

    parts = df.mapInArrow(each, "data binary").repartition(_PARTS).mapInArrow(fold, "data binary").collect()
    return sum((np.frombuffer(r["data"], dtype) for r in parts), np.zeros(math.prod(shape), dtype)).reshape(shape)


def numbered(texts: DataFrame, index: Index) -> DataFrame:
    """``doc_id, numbers, counts``: each text as numbers of the items' words (0: no such word), written once.

    The other passes read these, not the texts.  Each task adds a row of the
    passages that it saw each word in (``counts``, place 0: all passages).
    """
    size = len(index.vocabulary) + 1
    shared = texts.sparkSession.sparkContext.broadcast(Index([], [], [], index.vocabulary))

    def read(batches):
        claim("decontaminate")
        index, total = shared.value, np.zeros(size, np.int64)
        for batch in batches:
            ids, numbers = [], []
            for doc_id, text in rows([batch], "doc_id", "text"):
                n = index.numbers(words(text))
                windows = np.sort(_padded(n, passages(len(n), PASSAGE)), axis=1)
                first = np.concatenate([np.ones((len(windows), 1), bool), windows[:, 1:] != windows[:, :-1]], 1)
                seen = np.bincount(windows[first], minlength=size)
                seen[0] = len(windows)
                total += seen
                ids.append(doc_id)
                numbers.append(n.tobytes())
            yield _numbers_batch(ids, numbers, [None] * len(ids))
        yield _numbers_batch([None], [None], [total.tobytes()])

    return written(texts.mapInArrow(read, "doc_id long, numbers binary, counts binary"), "numbers")


def _numbers_batch(ids: list, numbers: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "numbers", "counts"])


def fit(table: DataFrame, index: Index) -> Index:
    """Weights and the latent basis of the items' vocabulary, over all passages of the corpus.

    The randomized SVD of the TF-IDF matrix: each task multiplies its passages
    with the same random directions and back, the products are summed, and the
    Nystrom form of the sum gives the right singular vectors.  Passages without
    enough of the items' vocabulary are zero rows for the search and are left
    out of the product.
    """
    size = len(index.vocabulary) + 1

    def counted(batches):
        for (counts,) in rows(batches, "counts", step=16):
            yield np.frombuffer(counts, np.int64)

    df = _summed(table.where("counts is not null").select("counts"), counted, (size,), "int64")
    index.seen = df
    index.idf = np.log((1.0 + df[0]) / (1.0 + df)) + 1e-3
    index.idf[0] = 0.0
    index.floor = index.least()
    width = min(RANK + EXTRA, size)
    draw = np.random.default_rng(0).standard_normal((size, width)).astype(np.float32)
    draw[0] = 0
    shared = table.sparkSession.sparkContext.broadcast((Index([], [], [], idf=index.idf, floor=index.floor), draw))

    def product(batches):
        (index, draw), held, size = shared.value, [], 0
        for (numbers,) in rows(batches, "numbers"):
            _, w = _heavy(index, np.frombuffer(numbers, np.int32), PASSAGE)
            held.append(w)
            size += len(w)
            if size >= 1024:
                yield _back(index, np.concatenate(held), draw)
                held, size = [], 0
        if size:
            yield _back(index, np.concatenate(held), draw)

    own = _padded_items(index)
    y = _summed(table.where("numbers is not null").select("numbers"), product, (size, width), "float32").astype(float) + _back(index, own, draw)
    core = draw.T.astype(float) @ y
    values, vecs = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max() * 1e-6
    u, _, _ = np.linalg.svd(y @ (vecs[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    index.basis = u[:, : min(RANK, u.shape[1])].astype(np.float32)
    index.basis[0] = 0
    index.latent = _unit(np.stack([_vectors(index, _padded(n, passages(len(n), len(n) + PASSAGE)[:1]), index.basis)[0] if len(n := index.numbers(s)) <= PASSAGE else _long(index, n) for s in index.seqs]))
    return index


def _padded_items(index: Index) -> np.ndarray:
    return np.concatenate([_padded(n := index.numbers(s), passages(len(n))) for s in index.seqs])


def _long(index: Index, numbers: np.ndarray) -> np.ndarray:
    return _vectors(index, _padded(numbers, passages(len(numbers))), index.basis).sum(0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _back(index: Index, windows: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Transposed TF-IDF times (TF-IDF times the random directions)."""
    w = index.idf[windows].astype(np.float32)
    w /= np.maximum(np.sqrt((w**2).sum(1, keepdims=True)), 1e-6)
    y = np.einsum("ij,ijk->ik", w, draw[windows])
    at, out = np.flatnonzero(windows), np.zeros_like(draw)  # words that count
    flat = windows.ravel()[at]
    order = np.argsort(flat, kind="stable")
    f, at = flat[order], at[order]
    if len(f):
        starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        out[f[starts]] = np.add.reduceat(w.ravel()[at][:, None] * y[at // PASSAGE], starts, axis=0)
    return out


FOUND = "doc_id long, item_id long, cosine double, retrieved boolean, lcs long, item_words long, ratio double, answer boolean"


def _least(n: int, share: float) -> int:
    """The fewest of ``n`` words that are ``share`` of them."""
    return next(c for c in range(n + 1) if c / n >= share)


def _ragged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``lo`` to ``hi``, and the range of each."""
    size = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) + np.repeat(lo - (np.cumsum(size) - size), size), of


def _cuts(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of about _AT_ONCE in all, one entry at least."""
    total, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _AT_ONCE, "right")))
        yield slice(lo, hi)
        lo = hi


class Candidates:
    """Passages that can leak an item of a block, from rare words: a superset of those that do.

    If LEAK of an item's words stand near a passage, one of any few that are more
    than the rest does too: the rarest ones are looked up.  An item whose answer
    stands there has the answer's rarest word there, at its place in the answer.
    What is left must hold enough of the item's words, in any order.
    """

    def __init__(self, seqs: list[np.ndarray], answers: list[np.ndarray], seen: np.ndarray):
        self.size = np.array([len(s) for s in seqs])
        member = np.zeros((len(seen), len(seqs)), bool)
        looked_up = []  # word, item, words needed, place in the answer or -1
        for k, (seq, answer) in enumerate(zip(seqs, answers, strict=True)):
            member[seq, k] = True
            need = _least(len(seq), LEAK)
            rarest = seq[np.argsort(seen[seq], kind="stable")][: len(seq) - need + 1]
            looked_up += [(w, k, need, -1) for w in set(rarest.tolist())]
            at = int(np.argmin(seen[answer]))
            looked_up.append((int(answer[at]), k, _least(len(seq), PARAPHRASE), at))
        self.member = np.packbits(member, axis=1, bitorder="little")
        word, self.item, self.need, self.place = np.array(sorted(looked_up), np.int64).T
        self.count = np.bincount(word, minlength=len(seen))
        self.first = np.cumsum(self.count) - self.count
        self.answer_size = np.array([len(a) for a in answers])
        self.answer_first = np.cumsum(self.answer_size) - self.answer_size
        self.answers = np.concatenate(answers)
        self.some, self.full = (np.array([_least(n, share) for n in self.size.tolist()]) for share in (PARAPHRASE, LEAK))
        self.answer_place = np.array([int(np.argmin(seen[a])) for a in answers])
        self.answer_word = np.array([int(a[i]) for a, i in zip(answers, self.answer_place.tolist(), strict=True)])

    def worth(self, tokens: np.ndarray, ends: np.ndarray, start: np.ndarray, doc: np.ndarray, ks: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of passages and items, those that can be leaks, as ``find`` gives them: words enough around, or fewer and the answer."""
        begin = np.maximum(np.concatenate([[0], ends[:-1]])[doc], start - self.size[ks])
        end = np.minimum(ends[doc], start + PASSAGE + self.size[ks])
        held = self._held(tokens, begin, end, ks)
        good = held >= self.full[ks]
        rest = np.flatnonzero(~good & (held >= self.some[ks]))
        if len(rest):
            order = np.argsort(tokens, kind="stable")
            keys, k = tokens[order].astype(np.int64) * len(tokens) + order, ks[rest]
            word = self.answer_word[k] * len(tokens)
            first, last = np.searchsorted(keys, word + begin[rest]), np.searchsorted(keys, word + end[rest])
            for c in _cuts(last - first):
                j, of = _ragged(first[c], last[c])
                some = rest[c][of]
                good[some[self._answered(tokens, order[j], begin[some], end[some], ks[some], self.answer_place[ks[some]])]] = True
        return start[good], doc[good], ks[good], begin[good], end[good]

    def _held(self, tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray, ks: np.ndarray) -> np.ndarray:
        """Words between ``lo`` and ``hi`` that are in the item."""
        out = np.zeros(len(lo), np.int64)
        for c in _cuts(hi - lo):
            at, of = _ragged(lo[c], hi[c])
            k = ks[c][of]
            out[c] = np.bincount(of, self.member[tokens[at], k >> 3] >> (k & 7).astype(np.uint8) & 1, len(lo[c]))
        return out

    def _answered(self, tokens: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, ks: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the answer stands around its looked up word; true for the other words."""
        begin, size = at - place, self.answer_size[ks]
        good = (place < 0) | (begin >= lo) & (begin + size <= hi)
        rest = np.flatnonzero(good & (place >= 0))
        step = 0
        while len(rest := rest[size[rest] > step]):
            same = tokens[begin[rest] + step] == self.answers[self.answer_first[ks[rest]] + step]
            good[rest[~same]] = False
            rest, step = rest[same], step + 1
        return good

    def find(self, tokens: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Of documents one after the other: passage's first word, document, item, and what to compare from and to."""
        found = np.flatnonzero(self.count[tokens])
        for c in _cuts(self.count[tokens[found]] * 16):
            first = self.first[tokens[found[c]]]
            j, of = _ragged(first, first + self.count[tokens[found[c]]])
            at, k, need, place = found[c][of], self.item[j], self.need[j], self.place[j]
            doc = np.searchsorted(ends, at, "right")
            hi, lo = ends[doc], np.concatenate([[0], ends[:-1]])[doc]
            good = self._answered(tokens, at, lo, hi, k, place)
            at, k, need, doc, lo, hi = (x[good] for x in (at, k, need, doc, lo, hi))
            n = self.size[k]
            good = self._held(tokens, np.maximum(lo, at - 2 * n - PASSAGE + 1), np.minimum(hi, at + 2 * n + PASSAGE), k) >= need
            at, k, need, doc, lo, hi, n = (x[good] for x in (at, k, need, doc, lo, hi, n))
            # all passages that are compared with this word
            least = np.maximum(-((PASSAGE - 1 + n - at + lo) // STRIDE), 0)
            most = np.minimum((at - lo + n) // STRIDE, -(-np.maximum(hi - lo - PASSAGE, 0) // STRIDE))
            for part in _cuts(most + 1 - least):
                p, of = _ragged(least[part], most[part] + 1)
                start, of = lo[part][of] + p * STRIDE, of + part.start
                key = start * len(self.size) + k[of]
                order = np.lexsort((need[of], key))
                order = order[np.concatenate([[True], np.diff(key[order]) != 0])] if len(order) else order
                start, of = start[order], of[order]
                begin, end = np.maximum(lo[of], start - n[of]), np.minimum(hi[of], start + PASSAGE + n[of])
                good = self._held(tokens, begin, end, k[of]) >= need[of]
                yield start[good], doc[of][good], k[of][good], begin[good], end[good]


class Block:
    """Items ``first`` and after, in numbers of their own words, so that tables grow with the block."""

    def __init__(self, index: Index, first: int):
        self.first = first
        seqs, answers = ([index.numbers(x) for x in xs[first : first + ITEMS]] for xs in (index.seqs, index.answers))
        words_ = np.unique(np.concatenate([[0], *seqs]))
        self.local = np.zeros(len(index.seen), np.int32)
        self.local[words_] = np.arange(len(words_))
        seqs = [self.local[s] for s in seqs]
        self.answers = [self.local[a] for a in answers]
        self.bits = [_bits(s.tolist()) for s in seqs]
        self.candidates = Candidates(seqs, self.answers, index.seen[words_])
        self.sizes = self.candidates.size.tolist()

    def check(self, near: np.ndarray, k: int) -> tuple[int, float, bool]:
        n = self.sizes[k]
        lcs = common_subsequence(self.bits[k], n, near.tolist())
        return lcs, lcs / n, lcs >= PARAPHRASE * n and _stands_in(self.answers[k], near)


def retrieved(light: Index, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents one after the other: first word and document of each passage near an item in the latent space, and its nearest item."""
    begins = np.concatenate([[0], ends[:-1]])
    size = ends - begins
    p, doc = _ragged(np.zeros(len(ends), np.int64), np.where(size > 0, -(-np.maximum(size - PASSAGE, 0) // STRIDE) + 1, 0))
    start = begins[doc] + p * STRIDE
    total = np.concatenate([[0.0], np.cumsum(light.idf[tokens] ** 2)])
    heavy = total[np.minimum(start + PASSAGE, ends[doc])] - total[start] >= light.floor
    start, doc = start[heavy], doc[heavy]
    out = [(start[:0], doc[:0], doc[:0])]
    for lo in range(0, len(start), 512):
        s, i = start[lo : lo + 512], doc[lo : lo + 512]
        at = s[:, None] + np.arange(PASSAGE)
        windows = np.where(at < ends[i][:, None], tokens[np.minimum(at, len(tokens) - 1)], 0)
        x = _unit(_vectors(light, windows, light.basis))
        best, item = np.full(len(s), -2.0, np.float32), np.zeros(len(s), np.int64)
        for first in range(0, len(light.latent), ITEMS):
            cosines = x @ light.latent[first : first + ITEMS].T
            k = cosines.argmax(1)
            top = cosines[np.arange(len(s)), k]
            better = top > best
            best[better], item[better] = top[better], k[better] + first
        near = best >= COSINE
        out.append((s[near], i[near], item[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def leaked(docs: list[tuple], light: Index, blocks: list[Block]) -> list[tuple]:
    """Rows of FOUND of some documents, given as ids and word numbers."""
    tokens = np.concatenate([t for _, t in docs])
    ends = np.cumsum([len(t) for _, t in docs])
    starts, owners, near = retrieved(light, tokens, ends)
    latent = set(zip(owners.tolist(), near.tolist(), strict=True))
    best: dict[tuple[int, int], tuple] = {}
    for block in blocks:
        local, hits, done = block.local[tokens], [], set()
        mine = (near >= block.first) & (near < block.first + len(block.sizes))
        first = block.candidates.worth(local, ends, starts[mine], owners[mine], near[mine] - block.first)
        for part in itertools.chain([first], block.candidates.find(local, ends)):
            for s, i, k, begin, end in zip(*(x.tolist() for x in part), strict=True):
                if (s, k) in done:
                    continue
                done.add((s, k))
                lcs, ratio, answer = block.check(local[begin:end], k)
                if ratio >= LEAK or ratio >= PARAPHRASE and answer:
                    hits.append((s, i, k, lcs, ratio, bool(answer)))
        for lo in range(0, len(hits), 1024):
            some = hits[lo : lo + 1024]
            s, i, k = (np.array(x) for x in list(zip(*some, strict=True))[:3])
            at = s[:, None] + np.arange(PASSAGE)
            windows = np.where(at < ends[i][:, None], tokens[np.minimum(at, len(tokens) - 1)], 0)
            cosines = (_unit(_vectors(light, windows, light.basis)) * light.latent[k + block.first]).sum(1)
            for (_, i, k, lcs, ratio, answer), c in zip(some, cosines.tolist(), strict=True):
                row = (ratio, c, lcs, block.sizes[k], answer)
                best[i, k + block.first] = max(best.get((i, k + block.first), row), row)
    return [(docs[i][0], light.ids[k], c, (i, k) in latent, lcs, n, ratio, answer) for (i, k), (ratio, c, lcs, n, answer) in sorted(best.items())]


def search(table: DataFrame, index: Index) -> DataFrame:
    """``FOUND``: the items that each document leaks, best passage of each.  A narrow step.

    All words of the items have numbers, so numbers do for words.
    """
    light = Index(index.ids, [], [], idf=index.idf, floor=index.floor, basis=index.basis, latent=index.latent)
    shared = table.sparkSession.sparkContext.broadcast((light, [Block(index, k) for k in range(0, len(index.ids), ITEMS)]))
    types = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
    names = [x.split()[0] for x in FOUND.split(", ")]

    def together(batches):
        held, size = [], 0
        for doc_id, numbers in rows(batches, "doc_id", "numbers"):
            held.append((doc_id, np.frombuffer(numbers, np.int32)))
            size += len(held[-1][1])
            if size >= _TOGETHER:
                yield held
                held, size = [], 0
        if size:
            yield held

    def scan(batches):
        claim("decontaminate")
        for docs in together(batches):
            if out := leaked(docs, *shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return table.where("numbers is not null").select("doc_id", "numbers").mapInArrow(scan, FOUND)


def items(benchmark: DataFrame, id_col: str, text_col: str) -> Index:
    """All items with words, in order of their ids; equal rows are one item."""
    index = Index([], [], [])
    for r in by_id(benchmark, id_col, text_col).distinct().orderBy("doc_id", "text").toLocalIterator():
        if seq := words(r["text"]):
            index.ids.append(r["doc_id"])
            index.seqs.append(seq)
            index.answers.append(answer_words(r["text"]))
            for w in seq:
                index.vocabulary.setdefault(w, len(index.vocabulary) + 1)
    return index


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``FOUND`` over all documents and items.

    An item leaks into a document if LEAK of its words stand there in order
    close to one of its passages, or PARAPHRASE of them and its answer (the last
    sentence) word for word.  ``cosine`` is that of the best passage, ``retrieved`` whether
    the latent search had the pair; what only the rare words found is false there.
    The benchmark is the stated query set: its index is broadcast, and the documents are read
    as texts once, whatever its size.

    Null texts and items count as empty; those without words match nothing.
    Every benchmark row is an item, with a null id or one that others have too (one row
    of ours each); rows equal in id and text are one.  Null document ids stay, and rows
    that share an id are searched each by its own text; repeated rows repeat
    their leaks, and of equally good passages one is reported.  No documents or no items
    give no rows.  A text of any length is searched whole.  Extra columns are not read and may
    have any name.
    """
    texts = by_id(docs, id_col, text_col)
    index = items(benchmark, item_id, item_text)
    if not index.ids:
        return docs.sparkSession.createDataFrame([], FOUND)
    table = numbered(texts, index)
    return search(table, fit(table, index))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id leaks an item; columns stay, null ids stay.

    Rows that share an id go together.  The rest as in ``leaks``.
    """
    (name,) = fresh(docs.columns, "bl_leaked")
    bad = leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
