"""Token ids in Arrow files of fixed-size-list batches, and zero-copy reads of them.

Documents are dealt by ranges of their id, so the files in order hold all ids
in ascending id order.  A file is an Arrow IPC file: record batches with two
fixed-size-list columns, ``ids`` (rows of ``row_len`` ids; 16-bit where the
vocabulary allows) and ``mask`` (false behind the last id).  Row k of a file
begins at id k * row_len, so any row, and any document by its start, is a view
of the mapped file.  Beside it lies an index file: id, start within the file,
number of ids.

Files are written under a name of their own by each attempt of a task; the
manifest, written once all tasks are done, names the files that count.  A task
that is run again leaves an unnamed file at worst.

Defined results: null text is empty (the end id alone); null ids come first;
rows of one id stand in the order of their texts' hashes, and such of one text
are alike; a very long text runs over as many record batches as it needs; an
empty table has no files and no rows; further columns, also ones named like the
results, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_io import bound_batches, keep, shared_dir
from .word_ids import encoder

_ROWS = 256  # rows of a record batch


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class TokenFileWriter:
    """Streams documents to one file; holds no more than a record batch of ids."""

    def __init__(self, uri: str, name: str, row_len: int, dtype: str):
        fs, folder = open_folder(uri)
        fs.create_dir(folder, recursive=True)
        self.names = f"{name}.arrow", f"{name}.index.arrow"
        self.row_len, self.dtype, self.total = row_len, np.dtype(dtype), 0
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, row_len)), ("mask", pa.list_(pa.bool_(), row_len))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
        self.sinks = [fs.open_output_stream(f"{folder}/{n}") for n in self.names]
        self.out = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        sizes = [len(x) for x in ids]
        starts = [self.total, *accumulate(sizes, initial=self.total)][1:-1]
        self.index.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=self.index_schema))
        self.total += sum(sizes)
        self.waiting += ids
        self.held += sum(sizes)
        self._flush(False)

    def _flush(self, last: bool) -> None:
        step = _ROWS * self.row_len
        if self.held < step and not (last and self.held):
            return
        ids = np.concatenate(self.waiting).astype(self.dtype)
        k = 0
        while len(ids) - k >= step:
            self._batch(ids[k : k + step], step)
            k += step
        ids = ids[k:]
        if last and len(ids):
            rows = -(-len(ids) // self.row_len) * self.row_len
            self._batch(np.concatenate([ids, np.zeros(rows - len(ids), self.dtype)]), len(ids))
            ids = ids[:0]
        self.waiting, self.held = [ids], len(ids)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.row_len) for x in (pa.array(ids), mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        for x in (self.out, self.index, *self.sinks):
            x.close()


class TokenFile:
    """Random access without copies: local files are memory-mapped, others read by range."""

    def __init__(self, uri: str, names: tuple[str, str]):
        fs, folder = open_folder(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        files = [pa.memory_map(f"{folder}/{n}") if local else fs.open_input_file(f"{folder}/{n}") for n in names]
        self.data, index = (pa.ipc.open_file(f) for f in files)
        self.index = index.read_all()
        self.row_len = self.data.schema.field("ids").type.list_size
        self.at, self.held = -1, None

    def batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.held = k, self.data.get_batch(k)
        return self.held

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of equal-length row k."""
        one = self.batch(k // _ROWS).slice(k % _ROWS, 1)
        return one.column(0).flatten().to_numpy(), one.column(1).flatten().to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids from start on, one for each record batch they lie in."""
        step = _ROWS * self.row_len
        while n > 0:
            k, begin = divmod(start, step)
            view = self.batch(k).column(0).values.to_numpy()[begin : begin + n]
            yield view
            start, n = start + len(view), n - len(view)


def write_token_files(docs: DataFrame, path: str, uri: str, end_id: int = 2, row_len: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns their manifest: part, n_docs, n_ids, ids_file, index_file."""
    spark = docs.sparkSession
    bound_batches(spark)
    tail = np.array([end_id], "<u4").tobytes()

    def write(batches) -> Iterator[pa.RecordBatch]:
        task, out, n_docs = TaskContext.get(), None, 0
        enc = encoder(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                dtype = "<u2" if max(enc.vocab_size, end_id + 1) <= 1 << 16 else "<u4"
                out = TokenFileWriter(uri, f"part-{task.partitionId():06d}-{task.taskAttemptId()}", row_len, dtype)
            out.add(batch.column(0).to_pylist(), [np.frombuffer(ids + tail, "<u4") for ids in enc.encode(batch.column(1).to_pylist())])
            n_docs += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task.partitionId(), n_docs, out.total, *out.names)], names=["part", "n_docs", "n_ids", "ids_file", "index_file"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    ranged = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    return keep(ranged.mapInArrow(write, "part bigint, n_docs bigint, n_ids bigint, ids_file string, index_file string"), "manifest")


def read_token_files(manifest: DataFrame, uri: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start in the whole corpus, n_tokens, ids_crc32 (of 32-bit little-endian ids).

    The driver adds up one number for each file, not for each document.
    """
    spark = manifest.sparkSession
    files = sorted(manifest.collect(), key=lambda r: r["part"])
    before = accumulate((r["n_ids"] for r in files), initial=0)
    shards = [(r["part"], b, r["ids_file"], r["index_file"]) for r, b in zip(files, before)]

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, base, *names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = TokenFile(uri, tuple(names))
                for index in f.index.to_batches():
                    start, n = index.column(1).to_pylist(), index.column(2).to_pylist()
                    crc = []
                    for s, k in zip(start, n, strict=True):
                        c = 0
                        for view in f.ids(s, k):
                            c = zlib.crc32(view.astype("<u4"), c)
                        crc.append(c)
                    yield pa.RecordBatch.from_arrays([index.column(0), pa.array([s + base for s in start], pa.int64()), index.column(2), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(shards, "part bigint, base bigint, ids_file string, index_file string")
    if shards:
        listed = listed.repartition(len(shards))
    return listed.mapInArrow(read, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files_round_trip(docs: DataFrame, path: str, **how) -> DataFrame:
    """Writes the files to the shared folder and returns what they hold, document by document."""
    uri = shared_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, path, uri, **how), uri, how.get("id_col", "doc_id"))
