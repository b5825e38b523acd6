"""Homomorphic multiset hashes of documents.

A text is the multiset of its paragraphs (what newlines separate, empty ones
included).  A fingerprint is a sum of vectors hashed from its members, so equal
multisets have equal fingerprints in any order, and paragraphs are added or
taken away by adding or subtracting their vectors.  It has two sections:

- ``STRONG`` lanes modulo 2**64, from a 512-bit hash of each paragraph: equality;
- ``LIKE`` lanes modulo 2**32 of +1 or -1, from the paragraphs' units, and the number
  of units modulo 2**32: likeness. The mean product of the lanes of two such sums
  estimates the inner product of the texts' unit counts, so likeness is their
  cosine, within [0, 1], off by a tenth or so; it is 1 for equal fingerprints. (A unit
  that occurs more than 2**31 times wraps its lanes, which spoils likeness, not
  equality.)

Units are runs of words that end where a word's hash says so, after
``MOST_WORDS`` words, or with the paragraph.  A word of more than ``LONG_WORD``
bytes counts as several: it is cut where a hash of the bytes before says so, and
after ``LONG_PIECE`` bytes.  So units are short in any text, with or without blanks.

``edited_fingerprints`` follows the order of descending id (null ids last).  Rows of
one id follow the order of a hash of their texts, so they spread over ranges like
others; equal rows that fill a range or more are one row with a count.

Edge cases: null texts are empty texts, which have one empty paragraph and no unit.
Very long texts are read whole.  Equal texts have equal fingerprints, so repeated
rows have too.  A lone row is its own next one; an empty table gives an empty
table.  Only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .naming import picked
from .scratch import bounded_batches, partitions, stored
from .textbuf import SLICE_BYTES, mix64, range_hashes, word_ranges

STRONG, LIKE = 8, 128
#: A unit ends at one word in so many (a power of two), and after so many at most.
UNIT_WORDS, MOST_WORDS = 4, 32
#: Longer words are cut at one byte in ``CUT`` (a power of two), and after so many bytes at most.
LONG_WORD, LONG_PIECE, CUT = 48, 256, 16
#: Keys sampled for the edges of each range, and the greatest number of ranges.
SAMPLE, MAX_RANGES = 64, 1 << 14
#: Copies of one row that are made at a time.
RUN = 1024
_U = np.uint64


class Fingerprint:
    """Sums that can be added, subtracted and compared."""

    __slots__ = ("like", "strong", "units")

    def __init__(self, strong: np.ndarray, like: np.ndarray, units: int):
        self.strong, self.like, self.units = strong, like, units

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong + other.strong, self.like + other.like, (self.units + other.units) % (1 << 32))

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong - other.strong, self.like - other.like, (self.units - other.units) % (1 << 32))

    def hex(self) -> str:
        return self.strong.astype("<u8").tobytes().hex() + self.like.astype("<u4").tobytes().hex() + f"{self.units:08x}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw, "<u8", STRONG).astype(_U), np.frombuffer(raw, "<u4", LIKE, 8 * STRONG).astype(np.uint32), int(text[-8:], 16))

    def likeness(self, other: Fingerprint) -> float:
        if (self.strong == other.strong).all() and (self.like == other.like).all() and self.units == other.units:
            return 1.0
        a, b = (x.like.view(np.int32).astype(np.float64) for x in (self, other))
        size = np.sqrt((a * a).sum() * (b * b).sum())
        return float(min(1.0, max(0.0, (a * b).sum() / size))) if size else 0.0


def _cut_gaps(at: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """Ascending places ``at`` and, where one is over ``most`` behind the last, further places every ``most`` between.

    ``first`` has the place from which each is counted: that of the last, or a new beginning.
    """
    n = np.maximum(at - first - 1, 0) // most
    if not n.any():
        return at
    more = np.repeat(first, n) + most * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1)
    return np.union1d(at, more)


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, with long ones cut."""
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if not len(long):
        return starts, ends
    value = mix64(data.astype(_U) + _U(1))
    rolled = value.copy()
    for k in range(1, 8):  # of the eight bytes up to each place
        rolled[k:] += value[:-k] << _U(5 * k)
    chosen = mix64(rolled) % _U(CUT) == 0
    cuts = []
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        at = np.append(np.flatnonzero(chosen[a + 8 : b - 1]) + a + 9, b)
        cuts.append(_cut_gaps(at, np.concatenate([[a], at[:-1]]), LONG_PIECE)[:-1])
    inner = np.concatenate(cuts)
    return np.union1d(starts, inner), np.union1d(ends, inner)


def _units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every unit, and the bounds of each text's units."""
    starts, ends, _ = word_ranges(data, bounds)
    starts, ends = _pieces(data, starts, ends)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    rows = np.searchsorted(starts, bounds)
    words = range_hashes(data, starts, ends)
    # A unit ends at chosen words, and before a newline or the text's end.
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    stop = (words >> _U(40)) % _U(UNIT_WORDS) == 0
    stop[:-1] |= newlines[starts[1:]] != newlines[ends[:-1]]
    stop[rows[1:][np.diff(rows) > 0] - 1] = True
    last = np.flatnonzero(stop)
    last = _cut_gaps(last, np.concatenate([[-1], last[:-1]]), MOST_WORDS)
    first = np.concatenate([[0], last[:-1] + 1])
    return range_hashes(data, starts[first], ends[last]), np.searchsorted(last, rows)


def fingerprints(texts: list[bytes]) -> list[Fingerprint]:
    """Fingerprints of UTF-8 texts."""
    out, at = [], 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size + len(texts[at]) <= SLICE_BYTES):
            part.append(texts[at])
            size += len(texts[at])
            at += 1
        data = np.frombuffer(b"".join(part), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in part])])
        hashes, cuts = _units(data, bounds)
        lanes = np.stack([mix64(hashes ^ _U(0xA0761D6478BD642F)), mix64(hashes ^ _U(0xE7037ED1A0B428DB))], axis=1)
        signs = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1)
        for i, text in enumerate(part):
            paragraphs = b"".join([hashlib.blake2b(p).digest() for p in text.split(b"\n")])
            strong = np.frombuffer(paragraphs, dtype="<u8").reshape(-1, STRONG).sum(axis=0, dtype=_U)
            n = int(cuts[i + 1] - cuts[i])
            ones = signs[cuts[i] : cuts[i + 1]].sum(axis=0, dtype=np.int64)
            out.append(Fingerprint(strong, (2 * ones - n).astype(np.uint32), n))
    return out


def fingerprint_texts(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) of every text."""
    df = picked(df, id_column, text)
    kind = df.schema[id_column].dataType.simpleString()

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.hex() for p in prints], type=pa.string())], names=[id_column, "fingerprint"])

    bounded_batches(df.sparkSession)
    return df.mapInArrow(taken, f"`{id_column}` {kind}, fingerprint string")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the order of rows as three ascending numbers: no id, id turned round, hash of the text."""
    i = F.col("doc_id")
    return docs.withColumns({"_n": i.isNull().cast("long"), "_d": F.coalesce(F.bitwise_not(i), F.lit(0)), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})


def _places(cuts: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """How many of the ascending ``cuts`` (tuples, by columns) lie at or before each key."""
    low, high = (np.searchsorted(cuts[0], keys[0], side) for side in ("left", "right"))
    if len(cuts) == 1:
        return high
    out = high.copy()
    within = np.flatnonzero(low < high)  # keys whose first number some cuts have: the others decide
    for at in np.unique(low[within]).tolist():
        own = within[low[within] == at]
        end = int(high[own[0]])
        out[own] = at + _places([c[at:end] for c in cuts[1:]], [k[own] for k in keys[1:]])
    return out


_KEY = ["_n", "_d", "_h"]


def _ranged(rows: DataFrame) -> tuple[DataFrame, set[tuple[int, ...]], int]:
    """Rows of ``_keyed`` with their range (``bucket``), keys that fill a range or more, and how many ranges."""
    spark = rows.sparkSession
    size, n = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    wanted = min(partitions(spark, size or 0), MAX_RANGES)
    # SAMPLE rows of three numbers for each range, whatever the input.
    drawn = rows.select(*_KEY).sample(min(1.0, SAMPLE * wanted / max(n, 1)), seed=11).collect() if wanted > 1 else []
    drawn = sorted(tuple(r) for r in drawn)
    edges = [drawn[len(drawn) * k // wanted] for k in range(1, wanted)] if drawn else []
    cuts = sorted(set(edges))
    columns = [np.array([c[k] for c in cuts], dtype=np.int64) for k in range(3)]
    shared = spark.sparkContext.broadcast(columns)

    @F.pandas_udf("int")
    def bucket(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        keys = [x.to_numpy(dtype=np.int64) for x in (a, b, c)]
        return pd.Series(_places(shared.value, keys) if len(shared.value[0]) else np.zeros(len(a), np.int64), dtype=np.int32)

    heavy = {c for c, d in zip(edges, edges[1:]) if c == d}
    return rows.withColumn("bucket", bucket(*_KEY)), heavy, len(cuts) + 1


def _with_next(docs: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows (bucket, tail, doc_id, text), to be read in order within each bucket; repeated rows apart; and the buckets.

    Buckets are ranges of the order.  Each ends with a copy of the first row of
    the next one that has rows (``tail``), and the last with that of the first, so every
    row is followed by its next one.  Of equal rows that fill a bucket or more one
    remains, and the second table has (doc_id, text, copies) for the others, whose next
    row is equal to them.
    """
    spark = docs.sparkSession
    rows, heavy, buckets = _ranged(_keyed(docs))
    again = None
    if heavy:
        # One key a range at most.
        keys = F.broadcast(spark.createDataFrame(sorted(heavy), "k_n long, k_d long, k_h long"))
        same = (F.col("_n") == F.col("k_n")) & (F.col("_d") == F.col("k_d")) & (F.col("_h") == F.col("k_h"))
        # A null text is an empty one here, so that the hash tells texts apart.
        one = rows.join(keys, same).groupBy(*_KEY, "bucket", "doc_id", F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
        one = stored(one, "repeated")
        again = one.where("copies > 1").select("doc_id", "text", (F.col("copies") - 1).alias("copies"))
        rows = rows.join(keys, same, "left_anti").unionByName(one.select("doc_id", "text", *_KEY, "bucket"))
    rows = rows.withColumn("tail", F.lit(False))
    # One row a bucket.
    heads = rows.groupBy("bucket").agg(F.min(F.struct(*_KEY)).alias("k")).orderBy("bucket").collect()
    if not heads:
        return rows, None, buckets
    wanted = [(heads[i].bucket, *heads[(i + 1) % len(heads)].k) for i in range(len(heads))]
    wanted = spark.createDataFrame(wanted, "_bucket int, k_n long, k_d long, k_h long")
    same = (F.col("_n") == F.col("k_n")) & (F.col("_d") == F.col("k_d")) & (F.col("_h") == F.col("k_h"))
    found = rows.join(F.broadcast(wanted), same)
    tails = found.groupBy("_bucket", "doc_id", *_KEY).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    tails = tails.select("doc_id", "text", *_KEY, F.col("_bucket").alias("bucket"), F.lit(True).alias("tail"))
    return rows.select("doc_id", "text", *_KEY, "bucket", "tail").unionByName(tails), again, buckets


_EDITED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(pairs: list[tuple]) -> tuple[list, ...]:
    """Columns of ``EDITED`` for pairs of (id, text, fingerprint) and the same of the next row."""
    changed = []
    for (_, text, _), (_, after, _) in pairs:
        cut = len(text) // 3
        changed.append((text[: len(text) - cut] + after[:cut]).encode())
    rows = [
        (own[0], len(own[1]), hashlib.sha256(raw).hexdigest(), own[2].hex(), edited.hex(), own[2].likeness(edited), own[2].likeness(after[2]))
        for (own, after), raw, edited in zip(pairs, changed, fingerprints(changed))
    ]
    return tuple(zip(*rows)) if rows else tuple([] for _ in _EDITED)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has the last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document in descending doc_id, after the last the
    first.  Rows with one id are ordered by a hash of their texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = picked(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows, again, buckets = _with_next(docs)
    rows = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "tail", *_KEY, "text")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row of the batch before: tail, then id, text and fingerprint
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = zip(batch.column("doc_id").to_pylist(), texts, fingerprints([t.encode() for t in texts]))
            chain = [*held, *zip(batch.column("tail").to_pylist(), own)]
            held = chain[-1:]
            # A tail is only the next of the row before it.
            columns = _edited([(a[1], b[1]) for a, b in zip(chain, chain[1:]) if not a[0]])
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _EDITED)], schema=_EDITED)

    out = rows.select("tail", "doc_id", "text").mapInArrow(edited, EDITED)
    if again is None:
        return out

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = list(zip(batch.column("doc_id").to_pylist(), texts, fingerprints([t.encode() for t in texts])))
            arrays = [pa.array(c, type=f.type) for c, f in zip(_edited([(x, x) for x in own]), _EDITED)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("copies")], names=[*_EDITED.names, "copies"])

    # Copies become rows by runs that are dealt to all tasks.
    runs = again.mapInArrow(repeated, EDITED + ", copies long")
    runs = runs.withColumn("_run", F.explode(F.sequence(F.lit(1).cast("long"), "copies", F.lit(RUN).cast("long"))))
    runs = runs.repartition(partitions(spark)).withColumn("_i", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + RUN - 1, "copies"))))
    return out.unionByName(runs.select(*_EDITED.names))
