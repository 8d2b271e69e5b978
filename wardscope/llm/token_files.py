"""Token ids in patched frame-of-reference files: written in document order, read back by block.

A file is a row of blocks and a footer.  A block holds up to ``BLOCK`` ids:

    minimum u32 | ids u16 | exceptions u16 | width u8 | packed | exception positions u16 | exception values u32

Ids are taken less the block's minimum and packed at the width that ``percentile``
of them need; the others are exceptions: their low bits are packed like all, and
their whole value stands in the exception list.  The footer holds document ids
(a null id as flag), their lengths, and where each block starts, so that any
document can be read by itself.

Empty texts are documents of one id, the end id.  A null text counts as empty.
Rows that repeat a document id are kept, in text order.  An empty table gives no
files and no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.llm.common import TEXTS_AT_ONCE, crc_of_ids, cut_lineage, fresh_path, ship_package
from wardscope.llm.tokens import encoder, tokenizer_path

BLOCK = 4096
HEAD = struct.Struct("<IHHB")
TAIL = struct.Struct("<QQQ4s")
MAGIC = b"PFR1"


# ---- blocks ----

def pack_block(ids: np.ndarray, percentile: float = 95.0) -> bytes:
    """One block of at most ``BLOCK`` unsigned 32-bit ids."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype("<u4")
    place = int(np.ceil((len(rest) - 1) * percentile / 100))
    width = int(np.partition(rest, place)[place]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    return HEAD.pack(low, len(ids), len(over), width) + _pack_bits(rest, width) + over.astype("<u2").tobytes() + rest[over].tobytes()


def _pack_bits(rest: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after another."""
    wide = rest.view(np.uint8).reshape(-1, 4)
    if width % 8 == 0:  # whole bytes
        return wide[:, : width // 8].tobytes()
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little", count=width).reshape(-1), bitorder="little").tobytes()


def _unpack_bits(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8, (n * width + 7) // 8, at)
    if width % 8 == 0:
        wide = np.zeros((n, 4), np.uint8)
        wide[:, : width // 8] = packed.reshape(n, width // 8)
        return wide.view("<u4").reshape(-1)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(packed, bitorder="little", count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    low, n, n_over, width = HEAD.unpack_from(data, at)
    at += HEAD.size
    rest = _unpack_bits(data, at, n, width)
    at += (n * width + 7) // 8
    over = np.frombuffer(data, "<u2", n_over, at)
    rest[over] = np.frombuffer(data, "<u4", n_over, at + 2 * n_over)
    return rest + np.uint32(low)


# ---- files ----

def split_uri(uri: str):
    """The file system of a shared folder, and the path in it; plain paths are local."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class TokenFileWriter:
    """Streams documents into one file; it holds one block and 12 bytes a document."""

    def __init__(self, uri: str, percentile: float = 95.0):
        self.uri, self.percentile = uri, percentile
        self.fs, self.path = split_uri(uri)
        self.sink = self.fs.open_output_stream(self.path)
        self.held, self.n_held, self.at, self.starts, self.ids, self.lengths = [], 0, 0, [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= 16 * BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        values = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(values) - len(values) % BLOCK if least == BLOCK else len(values)
        for k in range(0, whole, BLOCK):
            data = pack_block(values[k : min(k + BLOCK, whole)], self.percentile)
            self.starts.append(self.at)
            self.sink.write(data)
            self.at += len(data)
        self.held, self.n_held = [values[whole:].tobytes()], len(values) - whole

    def close(self) -> None:
        if self.n_held:
            self._flush(1)
        null = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([0 if i is None else i for i in self.ids], "<i8")
        for part in (null, ids, np.array(self.lengths, "<u4"), np.array(self.starts, "<u8")):
            self.sink.write(part.tobytes())
        self.sink.write(TAIL.pack(len(self.ids), len(self.starts), self.at, MAGIC))
        self.sink.close()


class TokenFile:
    """Reads a file by its footer; blocks are decoded one at a time."""

    def __init__(self, uri: str):
        self.fs, path = split_uri(uri)
        self.source = self.fs.open_input_file(path)
        size = self.source.size()
        n, n_blocks, self.end, magic = TAIL.unpack(self.source.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        foot = self.source.read_at(size - TAIL.size - self.end, self.end)
        null = np.frombuffer(foot, np.uint8, n)
        self.doc_ids = [None if z else int(i) for z, i in zip(null, np.frombuffer(foot, "<i8", n, n))]
        self.lengths = np.frombuffer(foot, "<u4", n, 9 * n).astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = np.append(np.frombuffer(foot, "<u8", n_blocks, 13 * n), np.uint64(self.end)).astype(np.int64)

    def read(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from the ``first`` one, by the index of block starts."""
        if count <= 0:
            return np.zeros(0, "<u4")
        a, b = first // BLOCK, (first + count - 1) // BLOCK
        data = self.source.read_at(int(self.starts[b + 1] - self.starts[a]), int(self.starts[a]))
        ids = np.concatenate([unpack_block(data, int(self.starts[k] - self.starts[a])) for k in range(a, b + 1)])
        return ids[first - a * BLOCK : first - a * BLOCK + count]

    def documents(self, span: int = 64 * BLOCK) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start in this file, ids) in file order; about ``span`` ids are held at a time."""
        k, n = 0, len(self.lengths)
        while k < n:
            first = int(self.ends[k] - self.lengths[k])
            stop = max(k + 1, int(np.searchsorted(self.ends, first + span, side="right")))
            ids = self.read(first, int(self.ends[stop - 1]) - first)
            for j in range(k, stop):
                start = int(self.ends[j] - self.lengths[j])
                yield self.doc_ids[j], start, ids[start - first : start - first + int(self.lengths[j])]
            k = stop


# ---- Spark ----

def write_token_files(df: DataFrame, root: str, path: str | None = None, end_id: int = 2, percentile: float = 95.0, partitions: int | None = None) -> DataFrame:
    """Encode whole texts and write them in ascending document order, one file per range partition.

    Returns the manifest (part, uri, n_docs, n_tokens).  A task that is run again writes
    another file, and the manifest names only the files of the tasks that counted.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = path or tokenizer_path()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    end = np.asarray([end_id], "<u4").tobytes()
    filesystem, folder = split_uri(root)
    filesystem.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, sink, uri, total = encoder(path).encode, None, "", 0
        for batch in (b.slice(k, TEXTS_AT_ONCE) for b in batches for k in range(0, b.num_rows, TEXTS_AT_ONCE)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sink is None:
                    uri = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.pfr"
                    sink = TokenFileWriter(uri, percentile)
                ids = encode(text) + end
                total += len(ids) // 4
                sink.add(doc_id, ids)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [len(sink.ids)], "n_tokens": [total]})

    return cut_lineage(ordered.mapInArrow(write, "part long, uri string, n_docs long, n_tokens long"))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the checksum of its ids, all read from the files.

    The manifest has one row per file, so the starts of files are summed on the driver.
    """
    ship_package(spark)
    files = manifest.orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([f.n_tokens for f in files])]).tolist()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = [(f.uri, int(s)) for f, s in zip(files, starts)]
    listed = spark.createDataFrame(rows, "uri string, base long").repartition(max(1, len(rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[tuple] = []
                for doc_id, start, ids in TokenFile(uri).documents():
                    out.append((doc_id, base + start, len(ids), crc_of_ids(ids)))
                    if len(out) >= 20_000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, schema)


def tokenize_to_files(df: DataFrame, path: str | None = None, end_id: int = 2, percentile: float = 95.0) -> DataFrame:
    """Write all texts to token files in the shared folder and return what reading them back gives."""
    spark = df.sparkSession
    manifest = write_token_files(df, fresh_path(spark, "tokens"), path, end_id, percentile)
    return read_token_files(spark, manifest)
