"""Token ids in Arrow stream files of equal-length sequences.

Files hold record batches of two columns of fixed-size lists, ``ids`` and ``mask``.
The documents' ids follow each other without gaps; each file's last sequence is
padded and its mask is 0 there. Masks are lists of bytes, each stored once in the
column's dictionary: that of whole sequences, and that of the last one. A token at
offset ``t`` of a file lies in sequence ``t // seq_len``, so a memory-mapped file gives
any sequence, any mask and any range of tokens within a record batch without copying
or decoding. A folder also holds the files of tasks that failed or were repeated; the
manifest alone says which files count.

Null texts count as empty; a document always holds at least the end id. Documents
are ordered by id (nulls first), and equal ids by a hash of their text. Repeated
rows are kept. Columns besides id and text are ignored. An empty table gives no
file and no row.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import store
from termweave.llm.workers import memory, slices

MANIFEST = "part int, file string, doc_id long, offset long, n_tokens long"
#: Sequences in a record batch.
BATCH_ROWS = 256


#: ASCII punctuation but the apostrophe, which may begin a contraction. Fixed values.
PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


class ChunkEncoder:
    """Ids of texts by a ``tokenizers`` file.

    Where blanks and line feeds separate pre-tokens and are themselves dropped, a
    text's ids are those of its chunks in order, and a chunk seen before need not be
    encoded again. Where the file lower-cases and marks word ends, new chunks of
    letters with punctuation behind are encoded as word and punctuation, the words
    many at a time. At most ``keep`` chunks and as many words are remembered.
    """

    def __init__(self, path: str, keep: int = 700_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype, self.code = ("<u2", "H") if self.tok.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.keep = keep
        self.known: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}
        # The ids that end a word. One word gives one such id, so that words can be told apart in a joined text.
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.drops_space = ids("ab \ncd") == ids("ab") + ids("cd")
        self.split_words = self.drops_space and ids("Ab.") == ids("ab") + ids(".") and bool(self.ends.any())

    def _one_by_one(self, texts: list[str], into: dict[str, bytes]) -> None:
        for text, e in zip(texts, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            into[text] = array(self.code, e.ids).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        if not self.split_words:
            return self._one_by_one(chunks, self.known)
        parts, odd = [], []
        for c in chunks:
            word = c.rstrip(PUNCTUATION)
            # Letters below U+0130 are composed and lower-case one by one.
            if word.isalpha() and (word.isascii() or max(word) < "\u0130"):
                parts.append((c, word.lower(), c[len(word) :]))
            else:
                odd.append(c)
        new = list({w for _, w, _ in parts}.difference(self.words))
        if new:
            ids = np.asarray(self.tok.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            raw, size = ids.tobytes(), ids.itemsize
            if len(cuts) == len(new) + 1:
                self.words.update((w, raw[a * size : b * size]) for w, a, b in zip(new, cuts, cuts[1:]))
            else:
                self._one_by_one(new, self.words)
        tails = list({t for _, _, t in parts}.difference(self.words))
        self._one_by_one(tails, self.words)
        self.known.update((c, self.words[w] + self.words[t]) for c, w, t in parts)
        self._one_by_one(odd, self.known)
        if len(self.words) > self.keep:
            self.words = {"": b""}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        if not self.drops_space:
            for t in texts:
                yield array(self.code, self.tok.encode(t or "", add_special_tokens=False).ids).tobytes()
            return
        for at in range(0, len(texts), 32):
            split = [(t or "").replace("\n", " ").split(" ") for t in texts[at : at + 32]]
            known = self.known
            if new := set(filterfalse(known.__contains__, chain.from_iterable(split))):
                self._learn(list(new))
            for chunks in split:
                yield b"".join(map(known.__getitem__, chunks))
            if len(known) > self.keep:
                self.known = {"": b""}


def chunk_encoder(path: str) -> ChunkEncoder:
    """One for each Python worker; it lives on from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    known = memory("token_files")
    if path not in known:
        known[path] = ChunkEncoder(path)
    return known[path]


class SequenceFile:
    """Writes token ids as fixed-size lists; ``add`` returns the offset of what it wrote."""

    def __init__(self, sink, dtype: str, seq_len: int):
        self.seq_len, self.dtype = seq_len, np.dtype(dtype)
        self.kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.dictionary(pa.int32(), pa.list_(pa.uint8(), seq_len)))])
        self.writer = pa.ipc.new_file(sink, self.schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))
        self.total, self.held, self.size = 0, [], 0

    def add(self, ids: bytes) -> int:
        at = self.total
        n = len(ids) // self.dtype.itemsize
        self.total += n
        self.held.append(ids)
        self.size += n
        if self.size >= BATCH_ROWS * self.seq_len:
            self._flush(False)
        return at

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        step = BATCH_ROWS * self.seq_len
        cut = 0
        while len(flat) - cut >= step or (last and cut < len(flat)):
            block = flat[cut : cut + step]
            rows = -(-len(block) // self.seq_len)
            ids = np.zeros(rows * self.seq_len, self.dtype)
            ids[: len(block)] = block
            masks, which = np.ones(self.seq_len, np.uint8), np.zeros(rows, np.int32)
            if len(block) < len(ids):  # the file's last sequence
                masks = np.concatenate([masks, (np.arange(self.seq_len) < len(block) % self.seq_len).astype(np.uint8)])
                which[-1] = 1
            ids, masks = (pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, masks))
            self.writer.write_batch(pa.record_batch([ids, pa.DictionaryArray.from_arrays(pa.array(which), masks)], schema=self.schema))
            cut += len(block)
        self.held, self.size = [flat[cut:].tobytes()], len(flat) - cut

    def close(self) -> None:
        self._flush(True)
        self.writer.close()


class SequenceReader:
    """Random access to one file; local files are memory-mapped."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.seq_len = self.file.schema.field("ids").type.list_size
        self.step = BATCH_ROWS * self.seq_len
        self.batch: tuple[int, np.ndarray | None, object] = (-1, None, None)

    def _load(self, k: int) -> np.ndarray:
        if self.batch[0] != k:
            got = self.file.get_batch(k)
            self.batch = (k, got.column(0).flatten().to_numpy(zero_copy_only=True), got)
        return self.batch[1]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """The ids from offset ``start``; a view unless the range crosses record batches."""
        parts = []
        while n > 0:
            k, at = divmod(start, self.step)
            part = self._load(k)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, "<u2")

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ``i`` and its boolean mask, both views of the file."""
        k, row = divmod(i, BATCH_ROWS)
        values, mask = self._load(k), self.batch[2].column(1)
        masks = mask.dictionary.flatten().to_numpy(zero_copy_only=True).view(np.bool_)
        cut = lambda flat, at: flat[at * self.seq_len : (at + 1) * self.seq_len]
        return cut(values, row), cut(masks, mask.indices[row].as_py())


def _writer(folder: str, tokenizer: str, end_id: int, seq_len: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.arrow"
        enc = out = sink = None
        for batch in slices(batches):
            if enc is None:
                enc = chunk_encoder(tokenizer)
                where, path = fs.FileSystem.from_uri(uri)
                where.create_dir(posixpath.dirname(path), recursive=True)
                sink = where.open_output_stream(path)
                out = SequenceFile(sink, enc.dtype, seq_len)
                end = np.asarray([end_id], enc.dtype).tobytes()
            offsets, sizes = [], []
            for ids in enc.encode(batch.column(1).to_pylist()):
                offsets.append(out.add(ids + end))
                sizes.append(len(ids) // out.dtype.itemsize + 1)
            n = len(sizes)
            yield pa.record_batch(
                [pa.array([part] * n, pa.int32()), pa.array([uri] * n), batch.column(0), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())],
                names=["part", "file", "doc_id", "offset", "n_tokens"],
            )
        if out is not None:
            out.close()
            sink.close()

    return write


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, seq_len: int = 2048, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Write the files and return the manifest: part, file, doc_id, offset, n_tokens, start.

    One range shuffle puts the documents in ascending order; each task writes one
    file under a fresh name in the shared folder and the manifest names those of the
    tasks that succeeded, so a retried task leaves nothing wrong. ``start`` counts
    the ids of all documents before; it comes from one total per file.
    """
    spark = docs.sparkSession
    folder = store.new_path(spark, "tokens")
    folder = folder if "://" in folder else "file://" + folder
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(parts or store.partitions(spark), *order).sortWithinPartitions(*order)
    manifest = store.materialize(sorted_rows.mapInArrow(_writer(folder, tokenizer, end_id, seq_len), MANIFEST), "manifest")
    totals = sorted((r.part, r.n) for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, before = [], 0
    for part, n in totals:
        starts.append((part, before))
        before += n
    base = F.broadcast(spark.createDataFrame(starts, "part int, base long"))  # a row for each file
    return manifest.join(base, "part").withColumn("start", F.col("base") + F.col("offset")).drop("base")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name = reader = None
    for batch in batches:
        crcs = []
        for file, offset, n in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            if file != name:
                name, reader = file, SequenceReader(file)
            crcs.append(zlib.crc32(reader.tokens(offset, n).astype("<u4").tobytes()))
        yield pa.record_batch([batch.column(1), batch.column(4), batch.column(3), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, all read back from the files."""
    cols = manifest.select("file", "doc_id", "offset", "n_tokens", "start")
    return cols.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
