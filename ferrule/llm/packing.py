"""Hierarchical residual packing of token pieces into sequences.

Documents are cut into pieces of at most ``capacity`` ids.  Every task packs its
pieces by best fit, longest first; bins that are nearly full are final.  Bins
with more room go to the next round as items of their own (their pieces stay
together), fewer tasks take part in each round, and best fit runs again, until
one task is left or a round joins nothing any more.  A task holds at most
``TASK_BINS`` bins at a time, in the last round as well.

The rows of each round are written to a shared folder before the next reads
them, so a lost executor never changes an earlier decision.

Edge cases: null and empty texts are one piece holding the end id only.  Very long
texts are cut into as many pieces as they need.  Null and repeated ids are packed
like others; ties in length are packed in any order.  An empty table gives an
empty table.  Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .naming import picked
from .scratch import bounded_batches, stored
from .tokens import encoder

TASK_BINS = 200_000
#: Bins with at most this share of their capacity left are final.
SLACK = 1 / 256
_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema(_PIECE)
BINS = "bin long, fill int, final boolean, items array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
_BINS = pa.schema([("bin", pa.int64()), ("fill", pa.int32()), ("final", pa.bool_()), ("items", pa.list_(pa.struct([*_PIECE, ("offset", pa.int64())])))])
#: A sequence id is round, task and number in 8, 24 and 31 bits.
_ROUND, _TASK = 1 << 55, 1 << 31


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document (doc_id, text): place, length and crc32 of their ids."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            rows = []
            for doc_id, packed in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1).to_pylist())):
                ids = np.concatenate([np.frombuffer(packed, dtype=encode.type).astype("<u4"), end]).tobytes()
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            yield _batch(rows, _PIECES)

    return picked(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit, longest first: bins as lists of positions in ``sizes``.

    Open bins are kept by the room they have left; one bit of ``rooms`` tells
    whether any bin has just that much, so the tightest bin is its lowest set
    bit at or above the size.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    rooms = 0
    for i in order:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return bins


def _round(df: DataFrame, number: int, capacity: int, slack: float) -> DataFrame:
    """Pack the rows of each task; rows are pieces in round 0 and bins later."""
    least = capacity - int(capacity * slack)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = number * _ROUND + TaskContext.get().partitionId() * _TASK, 0
        held: list[tuple[int, list]] = []

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            rows = []
            for members in best_fit([size for size, _ in held], capacity):
                fill, items = 0, []
                for i in members:
                    for x in held[i][1]:
                        items.append(x | {"offset": fill})
                        fill += x["length"]
                rows.append((base + made, fill, fill >= least, items))
                made += 1
                if len(rows) == 4096:
                    yield _batch(rows, _BINS)
                    rows = []
            if rows:
                yield _batch(rows, _BINS)
            held = []

        for batch in batches:
            if number:
                held += zip(batch.column("fill").to_pylist(), batch.column("items").to_pylist())
            else:
                held += ((x["length"], [x]) for x in batch.to_pylist())
            if len(held) >= TASK_BINS:
                yield from closed()
        yield from closed()

    return df.mapInArrow(pack, BINS)


def pack_pieces(items: DataFrame, capacity: int, slack: float = SLACK, fan_in: int = 8) -> DataFrame:
    """``items`` (columns of ``PIECES``) with sequence_id and offset."""
    source, tasks, left, number, done = items, None, None, 0, []
    while left != 0:
        bins = stored(_round(source, number, capacity, slack), "bins")
        if tasks is None:  # those of the first round that made any bin
            tasks = bins.select(F.floor(F.col("bin") / _TASK)).distinct().count()
        done.append(bins.where("final"))
        made = bins.count()
        stuck = left is not None and made >= left and -(-made // TASK_BINS) >= tasks
        open_ = bins.where("not final")
        if tasks <= 1 or stuck:
            done.append(open_)
            break
        left = open_.count()
        tasks, number = max(-(-tasks // fan_in), -(-left // TASK_BINS), 1), number + 1
        source = open_.select("fill", "items").coalesce(tasks)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    placed = out.select(F.col("bin").alias("sequence_id"), F.explode("items").alias("_x"))
    return placed.select(*(F.col(f"_x.{f.name}") for f in _PIECES), "sequence_id", "_x.offset")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, slack: float = SLACK) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack_pieces(stored(pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity, slack)


def sequences(packed: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids of every sequence: ``packed`` by ``pack_documents``, ``ids`` as doc_id and ids (with the end id).

    Documents are matched by id, so ids must be unique and not null here.
    """
    own = packed.join(ids.select("doc_id", "ids"), "doc_id")
    own = own.select("sequence_id", F.struct("offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids")).alias("_p"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list("_p")), lambda x: x["ids"]))
    return own.groupBy("sequence_id").agg(ordered.alias("ids"))
