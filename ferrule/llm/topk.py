"""Exact top-k inner products over vectors in descending order of length.

Equal vectors are one candidate that keeps the k + 1 smallest ids, which is all
that any query can return.  Candidates are sorted by length, packed into blocks
(rows of one table, in the smallest integers that hold them) and those into runs.
Rounds go through the runs from the longest vectors on: first one run, then
``GROWTH`` times as many as before.  In a round a query goes, with its k-th score so
far, to the runs that it may still need: by Cauchy-Schwarz none whose longest
vector times the query's length is below that score.  A task holds one run and
reads the queries sent there (several tasks share a run where a round has fewer runs
than there are tasks), so candidates are shuffled once and queries once for
each run that they need.  Within a run a block is skipped by the same bound, and
the first ``HEAD`` coordinates after rotation by the singular vectors of all
candidates bound a score from above, |exact - partial| <= |rest of query| * |rest of
vector|; only what may still reach the k-th score is computed exactly.  Scores
are integer products; the k best of all rounds are the result.  There are
``MAX_RUNS`` runs at most: beyond, runs hold more blocks.

Edge cases: rows with a null id, a null vector, or null or non-finite components
take no part.  Vectors of different lengths are filled up with zeros.  Ties go to
the smaller id.  A query's own id is no candidate; repeated rows count once.
Fewer candidates than k give fewer rows; an empty table gives an empty table.
Vectors whose products may leave 64 bits raise a ValueError.  Only the id and the vector
are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .naming import picked
from .scratch import bounded_batches, partitions, stored

CANDIDATE_BLOCK, QUERY_BATCH, RUN_BLOCKS = 4096, 512, 16
#: A round has so many times the runs of all before it; there are so many runs at most.
GROWTH, MAX_RUNS = 8, 1 << 14
HEAD = 16
#: Above this share of possible pairs a whole block is multiplied.
_DENSE = 0.1
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, vector array<long>): floor(scale * x) of every component."""
    df = picked(df, "vec_id", vector).toDF("vec_id", "vector")
    x = F.col("vector").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(F.col("vec_id").isNotNull() & x.isNotNull() & whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("vector"))


def _length2() -> Column:
    return F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))


def _matrix(vectors: list, width: int, kind: str) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _smallest_kind(peak: int) -> str:
    return next(k for k in ("i1", "i2", "i4", "i8") if peak <= np.iinfo(k).max)


def _blocks(df: DataFrame, rows: int, width: int, kind: str) -> DataFrame:
    """Pack the rows (vector, ids, _l) of each partition, in their order, into blocks."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def closed(n: int) -> pa.RecordBatch:
            nonlocal seq, held
            vectors, ids, lengths = zip(*held[:n])
            row = {"part": part, "seq": seq, "longest": max(lengths) ** 0.5, "vectors": _matrix(vectors, width, kind).tobytes(), "ids": ids}
            seq, held = seq + 1, held[n:]
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("longest", pa.float64()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))])
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("vector", "ids", "_l")))
            while len(held) >= rows:
                yield closed(rows)
        if held:
            yield closed(len(held))

    blocks = stored(df.mapInArrow(packed, "part int, seq int, longest double, vectors binary, ids array<array<long>>"), "blocks")
    # Blocks are numbered over parts by the parts' counts, not by one window over all blocks.
    parts = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return blocks.join(parts, F.col("part") == F.col("_part")).select((F.col("_before") + F.col("seq")).alias("block"), "longest", "vectors", "ids")


def _queries(asked: DataFrame, width: int, kind: str) -> DataFrame:
    """(query_id, vector binary, length) of rows (vec_id, vector)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1).to_pylist(), width, kind)
            length = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in m], type=pa.binary()), pa.array(length)], names=["query_id", "vector", "length"])

    return asked.select("vec_id", "vector").mapInArrow(packed, "query_id long, vector binary, length double")


def _rotation(blocks: DataFrame, width: int, kind: str) -> np.ndarray:
    """Right singular vectors of the candidates, from their Gram matrix (width x width)."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                m = np.frombuffer(raw, dtype=kind).reshape(-1, width).astype(np.float64)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "value"])

    cells = blocks.select("vectors").mapInArrow(gram, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(width * width)
    total[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    total = total.reshape(width, width)
    _, vectors = np.linalg.eigh((total + total.T) / 2)
    return vectors[:, ::-1].copy()


class _Best:
    """The k best (score, id) of one query so far, best first."""

    __slots__ = ("before", "ids", "k", "own", "scores")

    def __init__(self, own: int, k: int, before: int | None):
        self.own, self.k = own, k
        self.before = -np.inf if before is None else float(before)  # the k-th score of earlier rounds
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        return max(self.before, float(self.scores[-1])) if len(self.scores) == self.k else self.before

    def add(self, scores: np.ndarray, ids: list[np.ndarray], at: np.ndarray) -> None:
        """Candidates ``at`` with ``scores``; each has several ids."""
        if len(scores) > self.k + 1:  # one more than k, as the own vector may be among them
            cut = np.partition(scores, len(scores) - self.k - 1)[len(scores) - self.k - 1]
            some = scores >= cut
            scores, at = scores[some], at[some]
        own = [ids[i] for i in at.tolist()]
        if not own:
            return
        new = np.concatenate(own)
        scores = np.repeat(scores, [len(x) for x in own])
        keep = new != self.own
        scores, new = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, new[keep]])
        order = np.lexsort((new, -scores))[: self.k]
        self.scores, self.ids = scores[order], new[order]


def _search(width: int, k: int, kind: str, rotation: np.ndarray):
    head = min(HEAD, width)
    turn = rotation.astype(np.float64)

    def parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = m.astype(np.float64)
        turned = full @ turn[:, :head]
        length2 = (full * full).sum(axis=1)
        rest = np.sqrt(np.maximum(length2 - (turned * turned).sum(axis=1), 0) + 1e-9 * length2)
        return np.sqrt(length2), turned, rest

    def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        # Floats hold the products exactly while sums stay below 2**24 or 2**53.
        peak = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(width, 1)
        real = np.float32 if peak < 2**24 else np.float64 if peak < 2**53 else np.int64
        return (q.astype(real) @ c.astype(real).T).astype(np.int64)

    def answered(blocks: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
        """The best of the run's blocks for queries (id, vector, k-th score so far)."""
        best = [_Best(r[0], k, r[2]) for r in rows]
        q = np.frombuffer(b"".join([r[1] for r in rows]), dtype=kind).reshape(-1, width)
        q_len, q_turned, q_rest = parts(q)
        for c, ids, c_len, c_turned, c_rest in blocks:
            least = np.array([b.least for b in best])
            live = np.flatnonzero(q_len * c_len.max(initial=0) * (1 + 1e-9) + 1e-6 >= least)
            if not len(live):
                continue
            bound = q_turned[live] @ c_turned.T + np.outer(q_rest[live], c_rest)
            may = bound + 1e-6 * (1 + np.outer(q_len[live], c_len)) >= least[live][:, None]
            scores = exact(q[live], c) if may.mean() > _DENSE else None
            for j, own in enumerate(live.tolist()):
                at = np.flatnonzero(may[j])
                if len(at):
                    some = scores[j, at] if scores is not None else exact(q[own : own + 1], c[at])[0]
                    best[own].add(some, ids, at)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([b.own for b in best], [len(b.ids) for b in best]).astype(np.int64)), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))],
            names=["query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, rows = None, [], []  # a run's blocks come before its queries
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "query_id", "vector", "ids", "least")]
            for now, query_id, vector, ids, least in zip(*columns):
                if rows and (now != key or len(rows) == QUERY_BATCH):
                    yield answered(blocks, rows)
                    rows = []
                if now != key:
                    key, blocks = now, []
                if query_id is None:
                    c = np.frombuffer(vector, dtype=kind).reshape(-1, width)
                    blocks.append((c, [np.array(x, dtype=np.int64) for x in ids], *parts(c)))
                else:
                    rows.append((query_id, vector, least))
        if rows:
            yield answered(blocks, rows)

    return run


def _reach(longest: np.ndarray, spark) -> Callable[[Column, Column], Column]:
    """How many runs, longest vectors first, a query of a length may need beyond a k-th score (null: all)."""
    shared = spark.sparkContext.broadcast(-longest)  # MAX_RUNS numbers at most

    @F.pandas_udf("int")
    def reach(length: pd.Series, least: pd.Series) -> pd.Series:
        need = (least.to_numpy(dtype=np.float64) - 1e-6) / np.maximum(length.to_numpy() * (1 + 1e-9), 1e-300)
        return pd.Series(np.where(np.isnan(need), len(shared.value), np.searchsorted(shared.value, -need, side="right")), dtype=np.int32)

    return reach


def _round(blocks: DataFrame, asked: DataFrame, low: int, high: int, search) -> DataFrame:
    """Hits of the queries ``asked`` (query_id, vector, least, reach) in the runs from ``low`` up to ``high``."""
    spark = blocks.sparkSession
    # Queries are dealt to several tasks of one run where there are fewer runs than tasks.
    parts = max(1, -(-partitions(spark) // (high - low)))
    key = lambda run, part: ((run - low) * parts + part).cast("int").alias("key")
    held = blocks.where((F.col("run") >= low) & (F.col("run") < high)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = held.select(key(F.col("run"), F.col("part")), F.lit(None).cast("long").alias("query_id"), "block", F.col("vectors").alias("vector"), "ids", F.lit(None).cast("long").alias("least"))
    sent = asked.where(F.col("reach") > low).withColumn("run", F.explode(F.sequence(F.lit(low), F.least(F.col("reach"), F.lit(high)) - 1)))
    sent = sent.select(key(F.col("run"), F.pmod(F.xxhash64("query_id"), F.lit(parts))), "query_id", F.lit(None).cast("long").alias("block"), "vector", F.lit(None).cast("array<array<long>>").alias("ids"), "least")
    met = held.unionByName(sent).repartitionById((high - low) * parts, "key")
    return met.sortWithinPartitions("key", F.col("block").asc_nulls_last()).drop("block").mapInArrow(search, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``vectors`` (vec_id, vector array<long>); ``is_query`` chooses the queries."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    vectors = stored(vectors.select("vec_id", "vector").distinct(), "vectors")
    size = vectors.agg(F.max(F.size("vector")).alias("w"), F.max(F.array_max(F.transform("vector", F.abs))).alias("p"), F.count(F.lit(1)).alias("n")).first()
    width, peak = max(size.w or 0, 1), size.p or 0
    if width * peak * peak >= 1 << 63:
        raise ValueError("inner products may leave 64 bits")
    kind = _smallest_kind(peak)
    # The window keeps k + 1 rows of each vector before any row is shuffled.
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = vectors.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    distinct = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("_l", _length2())
    order = [F.col("_l").desc(), F.element_at("ids", 1)]
    dealt = distinct.repartitionByRange(partitions(spark, size.n * (8 * width + 32)), *order).sortWithinPartitions(*order)
    blocks = _blocks(dealt, CANDIDATE_BLOCK, width, kind)
    per_run = max(RUN_BLOCKS, -(-blocks.count() // MAX_RUNS))
    blocks = blocks.withColumn("run", F.floor(F.col("block") / per_run).cast("int"))
    # One number a run.
    longest = np.array([r.l for r in blocks.groupBy("run").agg(F.max("longest").alias("l")).orderBy("run").collect()])
    if not len(longest):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    search = _search(width, k, kind, _rotation(blocks, width, kind))
    asked = stored(_queries(vectors.where(is_query), width, kind), "queries")
    reach = _reach(longest, spark)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    low, high, best = 0, 1, None
    open_ = asked.withColumns({"least": F.lit(None).cast("long"), "reach": F.lit(len(longest))})
    while True:
        found = _round(blocks, open_, low, high, search)
        found = found if best is None else best.unionByName(found)
        ranked = found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if high == len(longest):
            return ranked
        best = stored(ranked, "best").drop("rank")
        low, high = high, min(high * GROWTH, len(longest))
        least = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
        open_ = asked.join(least, "query_id", "left").withColumn("reach", reach("length", "least"))
        open_ = stored(open_.where(F.col("reach") > low), "open")
        if not open_.limit(1).count():
            return best.withColumn("rank", place.cast("int")).select("query_id", "rank", "vec_id", "score")
