"""Token ids in a binary file format of shuffled planes; files are binary cells of a Parquet table.

A file holds whole documents: a header, an index of the documents, an index of
the chunks, and the chunks.  The ids of all its documents, one after the other,
are cut into blocks of ``BLOCK`` ids (the last may be shorter).  A block is
transposed into byte planes (all low bytes, all next bytes, ...) or into bit
planes, and each plane is compressed by zstandard on its own; the chunk index
has the length of every compressed plane, so ``read_block`` reads one block alone
and ``read_document`` the blocks that a document lies in.

``write_ids`` writes a table of documents as such files in ascending id order;
each file is one row of a Parquet table in a folder that all executors share,
whose commit protocol keeps the files whole when tasks are lost or run twice.
``read_ids`` reads them back.

Edge cases: null and empty texts have only the end id.  Documents with a null id
come first; repeated ids are kept, in the order of a hash of their texts, so that
rows of one id spread over tasks (equal rows too, which are told apart by their
place in the input).  A document longer than ``FILE_IDS`` has a file of its own.
An empty table gives no file.  Only doc_id and text are read, whatever other
columns are called.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .naming import picked
from .scratch import bounded_batches, new_path, partitions
from .tokens import encoder

MAGIC = b"FPL1"
BLOCK = 1 << 16
#: A file is closed when it holds so many ids.
FILE_IDS = 1 << 20
_HEAD = struct.Struct("<4sBBIQQ")
#: The starts of up to so many files are broadcast; more are joined by a shuffle.
BROADCAST_FILES = 100_000
FILES = "part int, seq int, n_docs long, n_ids long, payload binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _planes(block: np.ndarray, bits: bool) -> list[bytes]:
    raw = block.view(np.uint8).reshape(len(block), block.itemsize)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(raw.shape[1])]
    return [row.tobytes() for row in np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)]


def _block(planes: list[bytes], n: int, kind: np.dtype, bits: bool) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes])
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view(kind).ravel()


def pack_file(docs: list[tuple[int | None, np.ndarray]], bits: bool = False, level: int = 1) -> bytes:
    """The bytes of one file: documents as (id, ids), ids of one unsigned type."""
    kind = docs[0][1].dtype
    ids = np.concatenate([d[1] for d in docs])
    squeeze = zstandard.ZstdCompressor(level=level)
    planes = [[squeeze.compress(p) for p in _planes(ids[a : a + BLOCK], bits)] for a in range(0, len(ids), BLOCK)]
    head = _HEAD.pack(MAGIC, kind.itemsize, bits, len(planes), len(docs), len(ids))
    names = np.array([0 if d[0] is None else d[0] for d in docs], dtype="<i8").tobytes()
    known = np.array([d[0] is not None for d in docs], dtype=np.uint8).tobytes()
    sizes = np.array([len(d[1]) for d in docs], dtype="<u8").tobytes()
    index = np.array([len(p) for block in planes for p in block], dtype="<u4").tobytes()
    return b"".join([head, names, known, sizes, index, *(p for block in planes for p in block)])


class _File:
    """The indexes of one file."""

    def __init__(self, data: bytes):
        magic, width, bits, blocks, n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a plane file")
        self.data, self.kind, self.bits, at = data, np.dtype(f"<u{width}"), bool(bits), _HEAD.size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=dtype, count=n, offset=at)
            at += out.nbytes
            return out

        names, known, sizes = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
        self.names = [int(d) if k else None for d, k in zip(names, known)]
        self.ends = np.cumsum(sizes.astype(np.int64))
        self.starts = self.ends - sizes.astype(np.int64)
        per = width * 8 if bits else width
        self.index = take("<u4", blocks * per).reshape(blocks, per)
        self.places = at + np.concatenate([[0], np.cumsum(self.index.ravel(), dtype=np.int64)])  # of every plane

    def block(self, b: int) -> np.ndarray:
        unsqueeze, per = zstandard.ZstdDecompressor(), self.index.shape[1]
        places = self.places[b * per : (b + 1) * per + 1].tolist()
        planes = [unsqueeze.decompress(self.data[x:y]) for x, y in zip(places, places[1:])]
        return _block(planes, min(BLOCK, self.n_ids - b * BLOCK), self.kind, self.bits)

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids at places ``first`` to ``end``, from the blocks that hold them."""
        if first >= end:
            return np.zeros(0, self.kind)
        least = first // BLOCK
        parts = [self.block(b) for b in range(least, (end - 1) // BLOCK + 1)]
        return np.concatenate(parts)[first - least * BLOCK : end - least * BLOCK]


def unpack_file(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The documents of one file."""
    file = _File(data)
    ids = file.ids(0, file.n_ids)
    return [(d, ids[a:b]) for d, a, b in zip(file.names, file.starts, file.ends)]


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block of a file, without decompressing any other."""
    file = _File(data)
    if not 0 <= block < len(file.index):
        raise IndexError(f"block {block} of {len(file.index)}")
    return file.block(block)


def read_document(data: bytes, place: int) -> tuple[int | None, np.ndarray]:
    """Id and token ids of the document at ``place`` in a file, from its own blocks alone."""
    file = _File(data)
    return file.names[place], file.ids(int(file.starts[place]), int(file.ends[place]))


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int, bits: bool = False) -> None:
    """Write the ids of ``docs`` (doc_id, text), each ended by ``end_id``, in ascending doc_id order."""
    bounded_batches(docs.sparkSession)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=encode.type)
        held, n, seq = [], 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal held, n, seq
            row = {"part": part, "seq": seq, "n_docs": len(held), "n_ids": n, "payload": pack_file(held, bits)}
            held, n, seq = [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for doc_id, packed in zip(batch.column(0).to_pylist(), encode.encode(texts)):
                ids = np.concatenate([np.frombuffer(packed, dtype=encode.type), end])
                if held and n + len(ids) > FILE_IDS:
                    yield closed()
                held.append((doc_id, ids))
                n += len(ids)
        if held:
            yield closed()

    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The hash, and the place for equal rows, keep an id that many rows share from being one indivisible range.
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_i"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_i")]
    dealt = rows.repartitionByRange(partitions(docs.sparkSession, size), *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(files, FILES).write.parquet(path)


def _with_start(files: DataFrame) -> DataFrame:
    """Add the number of ids in all files before each: over parts, then within the part."""
    unbounded = (Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(*unbounded)), F.lit(0)).alias("_before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*unbounded))
    starts = files.select("part", "seq", F.coalesce(inner, F.lit(0)).alias("_in")).join(parts, "part")
    return starts.select("part", "seq", (F.col("_before") + F.col("_in")).alias("start"))


def read_ids(spark, path: str) -> DataFrame:
    """The documents of the files at ``path``: doc_id, start, ids (array of int)."""
    return _read(spark, path, "doc_id long, start long, ids array<int>", lambda d, at, ids: (d, at, ids.tolist()))


def read_digests(spark, path: str) -> DataFrame:
    """As ``read_ids``, with the number of ids and their crc32 in place of the ids."""
    return _read(spark, path, DOCUMENTS, lambda d, at, ids: (d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))


def _read(spark, path: str, schema: str, row) -> DataFrame:
    files = spark.read.parquet(path)
    starts = _with_start(files.select("part", "seq", "n_ids"))
    if starts.count() <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    placed = files.join(starts, ["part", "seq"]).select("start", "payload")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for doc_id, ids in unpack_file(payload.as_py()):
                    rows.append(row(doc_id, at, ids))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return placed.mapInArrow(documents, schema)


def token_files(docs: DataFrame, vocabulary: str, end_id: int, bits: bool = False) -> str:
    """Write to a new shared folder; returns its path."""
    path = new_path(docs.sparkSession, "ids")
    write_ids(docs, path, vocabulary, end_id, bits)
    return path
