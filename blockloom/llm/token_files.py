"""Token ids as Arrow stream files of fixed-size lists: writer, random access, read-back."""

from __future__ import annotations

import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import by_id
from blockloom.llm.tokens import encoder, rows
from blockloom.storage import new_path, written

SEQ_LEN = 2048
#: Sequences in a batch of the file.
BATCH_SEQS = 256
#: Bytes of text for one file, about.
FILE_BYTES = 16 << 20

MANIFEST = "shard int, path string, docs_path string, n_docs long, n_sequences long, n_tokens long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(dtype: np.dtype, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")


class Writer:
    """Cuts a run of ids into rows of ``seq_len`` and writes them in batches of one layout.

    Only the last row of a file is padded (id 0); its mask is false there.  Masks are bits.
    """

    def __init__(self, path: str, dtype: np.dtype, seq_len: int = SEQ_LEN, batch_seqs: int = BATCH_SEQS):
        self.dtype, self.seq_len, self.block = dtype, seq_len, seq_len * batch_seqs
        self.schema = _schema(dtype, seq_len)
        files, at = _files(path)
        files.create_dir(at.rpartition("/")[0], recursive=True)
        self.sink = files.open_output_stream(at)
        self.out = ipc.new_stream(self.sink, self.schema)
        self.held, self.n_held, self.n_tokens, self.n_sequences = [], 0, 0, 0

    def add(self, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.held.append(ids)
        self.n_held += n
        self.n_tokens += n
        if self.n_held >= self.block:
            run = b"".join(self.held)
            step = self.block * self.dtype.itemsize
            whole = len(run) // step * step
            for i in range(0, whole, step):
                self._batch(run[i : i + step], self.block)
            self.held, self.n_held = [run[whole:]], (len(run) - whole) // self.dtype.itemsize

    def _batch(self, ids: bytes, n: int) -> None:
        rows_ = -(-n // self.seq_len)
        size = rows_ * self.seq_len
        buf = np.zeros(size, self.dtype)
        buf[:n] = np.frombuffer(ids, self.dtype)
        mask = np.zeros(size, bool)
        mask[:n] = True
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (buf, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.n_sequences += rows_

    def close(self) -> None:
        if self.n_held:
            self._batch(b"".join(self.held), self.n_held)
        self.out.close()
        self.sink.close()


class TokenFile:
    """Random access to the sequences of one file; local files are mapped, not copied.

    All batches but the last have one length in bytes, so row ``i`` is found
    without a walk over the file.
    """

    def __init__(self, path: str):
        files, at = _files(path)
        self.source = pa.memory_map(at) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(at)
        reader = ipc.open_stream(self.source)
        self.schema, self.first = reader.schema, self.source.tell()
        self.seq_len = self.schema.field("ids").type.list_size
        try:
            self.rows_each = reader.read_next_batch().num_rows
        except StopIteration:
            self.rows_each = 0
        self.step = self.source.tell() - self.first

    def batch(self, k: int) -> pa.RecordBatch | None:
        at = self.first + k * self.step
        if at + 8 >= self.source.size():  # the mark that ends a stream
            return None
        self.source.seek(at)
        return ipc.read_record_batch(ipc.read_message(self.source), self.schema)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i``, both views of the file: NumPy ids, and Arrow's array of bits."""
        batch = self.batch(i // self.rows_each) if self.rows_each and i >= 0 else None
        if batch is None or i % self.rows_each >= batch.num_rows:
            raise IndexError(i)
        ids, mask = (batch.column(c)[i % self.rows_each].values for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def runs(self):
        """The ids in order, a batch at a time, without the padding."""
        k = 0
        while self.rows_each and (batch := self.batch(k)) is not None:
            ids, mask = (batch.column(c).flatten() for c in (0, 1))
            n = mask.true_count
            yield ids.to_numpy()[:n]
            k += 1


def read_docs(path: str) -> pa.Table:
    """The table beside a token file: where each document starts in it, and its ids."""
    files, at = _files(path)
    with files.open_input_stream(at) as f:
        return ipc.open_stream(f).read_all()


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 0, seq_len: int = SEQ_LEN, id_col: str = "doc_id", text_col: str = "text", file_bytes: int | None = None) -> DataFrame:
    """Encodes ``docs`` to token files in ascending id order; returns their manifest.

    One shuffle deals documents by range of id, about ``file_bytes`` (FILE_BYTES) of text to a
    range (an id that many rows share is dealt by text too); each task sorts its
    range and streams it to a file of its own.  A file's name holds the task attempt, and
    only files of attempts that succeeded are in the manifest, so a task can
    run twice.  ``out`` defaults to a new folder in ``spark.checkpoint.dir``.

    Null texts count as empty and still get ``end_id``; null ids come first; rows
    that repeat an id follow each other by a hash of their text, equal ones side by side.  A text
    of any length is one document.  An empty table gives no files.
    Only the id and text columns are read, so extra ones may have any name.
    """
    folder = out or new_path(docs.sparkSession, "tokens")

    def encode(batches):
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        base = f"{folder}/shard-{shard:06d}-{TaskContext.get().taskAttemptId()}"
        tokens, beside, n_docs, start, held = None, None, 0, 0, []

        def flush():
            if held:
                beside.write_batch(pa.RecordBatch.from_pydict(dict(zip(_DOCS.names, zip(*held, strict=True), strict=True)), schema=_DOCS))
                held.clear()

        for doc_id, text in rows(batches, "doc_id", "text"):
            if tokens is None:
                tokens = Writer(f"{base}.arrow", enc.dtype, seq_len)
                files, at = _files(f"{base}.docs.arrow")
                sink = files.open_output_stream(at)
                beside = ipc.new_stream(sink, _DOCS)
            ids = enc.encode(text) + end
            tokens.add(ids)
            held.append((doc_id, start, n := len(ids) // enc.dtype.itemsize))
            start, n_docs = start + n, n_docs + 1
            if len(held) >= 10_000:
                flush()
        if tokens is not None:
            tokens.close()
            flush()
            beside.close()
            sink.close()
            row = (shard, f"{base}.arrow", f"{base}.docs.arrow", n_docs, tokens.n_sequences, tokens.n_tokens)
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    texts = by_id(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hashed = texts.withColumn("h", F.xxhash64("text"))
    ordered = hashed.repartitionByRange(int(size // (file_bytes or FILE_BYTES)) + 1, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return written(ordered.mapInArrow(encode, MANIFEST), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files.

    ``start`` counts the ids of all documents before, over all files; files are
    few (one a task of the writer), so their running sum is one small window.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def scan(batches):
        for path, docs_path, base in rows(batches, "path", "docs_path", "base"):
            table = read_docs(docs_path)
            runs, run, at = TokenFile(path).runs(), np.empty(0, "u2"), 0
            crcs = []
            for size in table.column("n_tokens").to_pylist():
                crc = 0
                while size:
                    if at == len(run):
                        run, at = next(runs), 0
                    part = run[at : at + size]
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    at, size = at + len(part), size - len(part)
                crcs.append(crc)
            start = pa.array(table.column("start").to_numpy() + base, pa.int64())
            whole = pa.table({"doc_id": table.column("doc_id"), "start": start, "n_tokens": table.column("n_tokens"), "ids_crc32": pa.array(crcs, pa.int64())})
            yield from whole.combine_chunks().to_batches(max_chunksize=10_000)

    return placed.repartitionByRange(n, "shard").mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")
