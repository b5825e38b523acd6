"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles (A-Z in lower case).  Equal
sets are one class, represented by the smallest id, before anything else.

1. Signatures.  ``SIGNATURE`` minwise hashes of the whole set, kept as one byte
   each; the first ``TREES`` of them also in full.
2. Trees.  Tree t deals the classes by minwise token t; a node with more than
   ``NODE`` members branches on further tokens, each child holding the members
   that agree on one, and so on until nodes are small: on ``BRANCHES`` tokens
   each for ``DEPTH`` levels, then on one.  The members of a small
   node are all compared by signature; likely pairs give the edges of a forest, so
   a node of n members gives n - 1 edges at most.  The order that deals rows to
   tasks continues the path by further tokens and the id, so even a node of
   a third of all rows spreads over tasks, in similar neighbourhoods.  A node
   that fills half a task or more, and so may be cut, is dealt again along other
   paths, the more often the more tasks it fills.
3. Confirmation.  Components of those edges are candidates.  The texts of the
   members of one come together and pairs are confirmed on the full sets.
   Candidates of more than ``BLOCK`` members are first confirmed in random
   blocks, twice, which joins most of what belongs together.  Parts of a candidate
   that are still apart are compared in full: where what lies outside its large
   parts fills ``FEW`` blocks at most, by pairs of blocks; otherwise by prefixes.
   Two sets at the threshold share a token among the rarest of the longer one
   (as many as it may miss) and the rarest of the shorter one (as many as it may miss
   of one as long), so only members that share such a token meet, and members
   that differ by tokens of their own meet nobody.  None of a large candidate's
   pairs that may be a link is left out.  No task holds more than two blocks at a
   time, and only forest edges leave it.  Their components are the result.

A pair at similarity s lies in one node of a tree with probability s at least
(for small nodes); with ten trees a pair at 0.8 is missed with probability
0.2**10.  Signatures err below the margin at 0.8 with probability 3e-5.

Edge cases: null and empty texts, and texts without words, have empty sets and
are linked with nothing.  Very long texts are shingled whole.  Rows with a null id
take no part in linking and are kept, with a null component.  Repeated rows have
equal sets; if an id is given to different texts, each row belongs to the class of
its own text.  Ties: a component is named by its smallest id, and of rows of that
id the one with the smallest hash of its text counts as kept in ``deduplicated``.  An
empty table gives an empty table.  Only doc_id and text are read, whatever other
columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .naming import numbered, own, picked, restored
from .scratch import bounded_batches, partitions, stored
from .textbuf import mix64, shingle_sets, text_slices

SIGNATURE, TREES = 128, 10
NODE, DEPTH, BRANCHES = 1024, 6, 2
BLOCK = 512
#: A block's texts have about so many bytes at most.
BLOCK_BYTES = 8 << 20
#: Blocks outside the large parts of a candidate that are all compared; beyond, prefixes decide what meets.
FEW = 2
#: Tokens are ordered by how many sets hold them, counted in so many buckets of their hash.
SKETCH_BITS = 20
#: Parts of the rows that share a token.
SALTS = 8
#: An id and text that so many rows repeat, or as many as a quarter of a task's, are one row before any join.
REPEATED = 1000
#: Equal signature bytes below the expected number at the threshold that still count as likely: four deviations.
DEVIATIONS = 4.0
_U = np.uint64
_A = (mix64(np.arange(1, SIGNATURE + 1, dtype=_U)) >> _U(32)).astype(np.uint32) | np.uint32(1)
_B = mix64(np.arange(1001, SIGNATURE + 1001, dtype=_U)).astype(np.uint32)
SETS = "doc_id long, _h long, n_bytes long, n_shingles long, set_a long, set_b long, roots array<int>, signature binary"


def _signatures(flat: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Minwise hashes (sets x SIGNATURE) of non-empty sets."""
    low = (flat >> _U(32)).astype(np.uint32)
    out = np.empty((len(rows) - 1, SIGNATURE), dtype=np.uint32)
    for k in range(SIGNATURE):
        out[:, k] = np.minimum.reduceat(low * _A[k] + _B[k], rows[:-1])
    return out


def set_names(flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each non-empty set."""
    return tuple(np.add.reduceat(mix64(flat ^ _U(salt)), rows[:-1]).view(np.int64) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, _h, n_bytes, n_shingles, set_a, set_b, roots, signature) of every document (doc_id, text); _h is a hash of the text."""
    bounded_batches(docs.sparkSession)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.columns
            for lo, hi, data, bounds in text_slices(texts):
                flat, rows = shingle_sets(data, bounds, width)
                sizes = np.diff(rows)
                some = np.flatnonzero(sizes)
                own = np.concatenate([rows[:-1][some], rows[-1:]])
                a, b = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                roots, packed = [None] * (hi - lo), [None] * (hi - lo)
                if len(some):
                    a[some], b[some] = set_names(flat, own)
                    signs = _signatures(flat, own)
                    for i, root, sign in zip(some.tolist(), signs[:, :TREES].view(np.int32).tolist(), signs.astype(np.uint8)):
                        roots[i], packed[i] = root, sign.tobytes()
                arrays = [pa.array(np.diff(bounds)), pa.array(sizes), pa.array(a), pa.array(b), pa.array(roots, type=pa.list_(pa.int32())), pa.array(packed, type=pa.binary())]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), hashes.slice(lo, hi - lo), *arrays], names=["doc_id", "_h", "n_bytes", "n_shingles", "set_a", "set_b", "roots", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(measured, SETS)


def _labels(linked: np.ndarray) -> np.ndarray:
    """Components of a symmetric boolean matrix, as the smallest position of each."""
    n = len(linked)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i], front = i, linked[i] & (label < 0)
        while front.any():
            label[front] = i
            front = linked[front].any(axis=0) & (label < 0)
    return label


def _likely(signs: np.ndarray, least: int) -> np.ndarray:
    n = len(signs)
    out = np.empty((n, n), dtype=bool)
    step = max(1, (4 << 20) // (n * SIGNATURE))
    for i in range(0, n, step):
        out[i : i + step] = (signs[i : i + step, None, :] == signs[None, :, :]).sum(axis=2, dtype=np.int16) >= least
    return out


def _compare(ids: np.ndarray, signs: np.ndarray, least: int, seed: int, used: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forest edges (id, smaller id) of the likely pairs in one node, branching while it is large."""
    n = len(ids)
    if n < 2:
        return
    if n <= NODE:
        label = _labels(_likely(signs, least))
        moved = label != np.arange(n)
        if moved.any():
            yield ids[moved], ids[label[moved]]
        return
    # Members near one of a few anchors are joined at once.
    for k in np.linspace(0, n - 1, 4).astype(int):
        near = (signs == signs[k]).sum(axis=1) >= least
        near[k] = False
        if near.any():
            yield ids[near], np.full(int(near.sum()), ids[k])
        if near.sum() == n - 1:
            return
    # Members that agree on every token are near each other, so a token is left here.
    free = np.setdiff1d(np.arange(SIGNATURE), used)
    for branch in range(BRANCHES if len(used) < DEPTH else 1):
        token = int(free[int(mix64(np.array([seed * 64 + len(used) * BRANCHES + branch + 1], dtype=_U))[0] % _U(len(free)))])
        values, child = np.unique(signs[:, token], return_inverse=True)
        for c in range(len(values)):
            own = child == c
            yield from _compare(ids[own], signs[own], least, (seed * 31 + branch + 7) & 0xFFFFFFFFFF, (*used, token))


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges with the same components as (a, b): one from each id to the smallest of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ids)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for i, p in enumerate(parent):  # parents are smaller, so theirs are final by now
        parent[i] = parent[p]
    root = np.array(parent)
    moved = root != np.arange(len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])


def candidate_edges(classes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) whose components hold the likely pairs of ``classes`` (rep, roots, signature)."""
    least = int(SIGNATURE * similarity - DEVIATIONS * (SIGNATURE * similarity * (1 - similarity)) ** 0.5)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []  # batches of one node

        def edges(key: np.ndarray, ids: np.ndarray, signs: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            found = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > 1:
                    found += _compare(ids[a:b], signs[a:b], least, int(key[a] >> 32) + 1)
            if found:
                yield _forest(*(np.concatenate(c) for c in zip(*found)))

        def joined() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(p) for p in zip(*rest))

        for batch in batches:
            key = (batch.column("tree").to_numpy().astype(np.int64) << 32) | (batch.column("root").to_numpy().astype(np.int64) & 0xFFFFFFFF)
            signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint8).reshape(len(key), SIGNATURE)
            now = (key, batch.column("rep").to_numpy(), signs)
            # The last node may go on in the next batch; its batches are joined once it is whole.
            other = np.flatnonzero(key != key[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            if last or (rest and rest[0][0][0] != key[0]):
                rest.append(tuple(p[:last] for p in now))
                yield from edges(*joined())
                rest = []
            rest.append(tuple(p[last:] for p in now))
        if rest:
            yield from edges(*joined())

    dealt = classes.select("rep", F.posexplode("roots").alias("tree", "root"), "signature")
    n = classes.count() * TREES
    tasks = partitions(classes.sparkSession, n * (SIGNATURE + 48))
    in_task = max(n / tasks, 1)
    # There are two of these nodes a task at most.
    cut = dealt.groupBy("tree", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(NODE, in_task / 2))
    cut = cut.select("tree", "root", (1 + F.ceil(F.log2(1 + F.col("n") / in_task))).cast("int").alias("deals"))
    dealt = dealt.join(F.broadcast(cut), ["tree", "root"], "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)))
    path = F.substring(F.col("signature"), (F.col("tree") * 8 + TREES + F.col("deal") * 37) % (SIGNATURE - 7) + 1, F.lit(8)).alias("path")
    dealt = dealt.select((F.col("tree") + F.col("deal") * TREES).alias("tree"), "root", path, "rep", "signature")
    order = ["tree", "root", "path", "rep"]
    dealt = dealt.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt.select("tree", "root", "rep", "signature").mapInArrow(linked, "a long, b long")


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes)
    values, token, often = np.unique(flat, return_inverse=True, return_counts=True)
    keep = often[token] > 1
    row, token = row[keep], token[keep]
    often = np.where(often > 1, often, 0)
    new = np.cumsum(often > 0) - 1
    token = new[token]
    width = int((often > 0).sum())
    out = np.zeros((n, n), dtype=np.float32)
    if float((often.astype(np.float64) ** 2).sum()) * 6 < float(n) * n * width / 8:
        # Few sets hold each token: count along the tokens' lists of sets.
        order = np.argsort(token, kind="stable")
        lists, ends = row[order], np.cumsum(np.bincount(token, minlength=width))
        heads = np.concatenate([[0], ends[:-1]])
        cuts = np.searchsorted(row, np.arange(n + 1))
        for i in range(n):
            own = token[cuts[i] : cuts[i + 1]]
            lens = ends[own] - heads[own]
            if len(own):
                at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(heads[own], lens)
                out[i] = np.bincount(lists[at], minlength=n)
        return out
    step = max(64, (8 << 20) // n)
    for a in range(0, width, step):
        part = (token >= a) & (token < a + step)
        dense = np.zeros((n, min(step, width - a)), dtype=np.float32)
        dense[row[part], token[part] - a] = 1
        out += dense @ dense.T
    return out


def confirmed_edges(members: DataFrame, width: int, similarity: float) -> DataFrame:
    """Forest edges of the true links between ``members`` (component, _tile, rep, text) of each tile.

    Rows must be dealt and sorted so that a tile is consecutive in one task.
    """
    percent = round(similarity * 100)

    def links(texts: list[str], ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.unique(ids, return_index=True)[1]  # repeated rows once
        column, sets, kept = pa.array([texts[i] for i in first], type=pa.string()), [], ids[first]
        for _, _, data, bounds in text_slices(column):
            flat, rows = shingle_sets(data, bounds, width)
            sets += [flat[a:b] for a, b in zip(rows[:-1], rows[1:])]
        if len(kept) < 2:
            return
        if len(kept) == 2:
            both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2, dtype=np.float64)
            both[1] = both[1][::-1]
        else:
            both = _shared_counts(sets).astype(np.float64)
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        label = _labels(linked)
        moved = label != np.arange(len(kept))
        if moved.any():
            yield kept[moved], kept[label[moved]]

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = ([], []), None

        def closed() -> Iterator[pa.RecordBatch]:
            for a, b in links(held[0], np.array(held[1])):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "_tile", "rep", "text")]
            for *key, rep, text in zip(*columns):
                if key != group:
                    if len(held[1]) > 1:
                        yield from closed()
                    held, group = ([], []), key
                held[0].append(text)
                held[1].append(rep)
        if len(held[1]) > 1:
            yield from closed()

    return members.mapInArrow(confirmed, "a long, b long")


def _blocks(n: Column, size: Column) -> Column:
    """Blocks that hold n members of ``size`` bytes."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")


def _dealt(tiled: DataFrame, texts: DataFrame) -> DataFrame:
    """``tiled`` (component, _tile, rep) with the texts of (rep, n_bytes, text), a tile together in one task."""
    key = ["component", "_tile"]
    rows = tiled.select(*key, "rep").join(texts.select("rep", "n_bytes", "text"), "rep")
    size = tiled.join(texts.select("rep", "n_bytes"), "rep").agg(F.sum("n_bytes")).first()[0] or 0
    return rows.select(*key, "rep", "text").repartition(partitions(tiled.sparkSession, size), *key).sortWithinPartitions(*key, "rep")


def _sized(rows: DataFrame) -> DataFrame:
    """For every (component, part) of ``rows``: owner and blocks; parts that fit a block share those of their component (_shared)."""
    sizes = rows.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("w"))
    blocks = _blocks(F.col("n"), F.col("w"))
    # Parts of several blocks stand alone; the number of shared blocks follows from the sum of the others.
    sizes = sizes.withColumn("alone", blocks > 1)
    shared = sizes.groupBy("component").agg(
        F.coalesce(_blocks(F.sum(F.when(~F.col("alone"), F.col("n"))), F.sum(F.when(~F.col("alone"), F.col("w")))), F.lit(0)).alias("_shared"), F.count(F.lit(1)).alias("_parts"),
    )
    sizes = sizes.join(shared, "component").where("_parts > 1")  # where all are one part nothing is left to compare
    return sizes.select("component", "part", "_shared", F.when(F.col("alone"), F.col("part")).alias("owner"), F.when(F.col("alone"), blocks).otherwise(F.greatest("_shared", F.lit(1))).alias("_of"))


def _tiles(rows: DataFrame) -> DataFrame:
    """Pairs of blocks of ``rows`` (component, part, rep, owner, _of) that may hold links between different parts: (component, _tile, rep).

    Parts that fill a block have blocks of their own, all others share blocks; two
    blocks of one part need no comparison. So a large part meets only what lies
    outside it.
    """
    rows = rows.withColumn("_block", F.xxhash64("owner", F.pmod(F.xxhash64("rep"), F.col("_of"))))
    blocks = rows.select("component", "owner", "_block").distinct()
    left = blocks.select("component", F.col("owner").alias("_o"), F.col("_block").alias("_i"))
    right = blocks.select("component", F.col("owner").alias("_p"), F.col("_block").alias("_j"))
    same = F.col("_o").isNotNull() & F.col("_o").eqNullSafe(F.col("_p"))
    pairs = left.join(right, "component").where((F.col("_i") <= F.col("_j")) & ~same)
    tiles = pairs.select("component", F.xxhash64("_i", "_j").alias("_tile"), F.explode(F.array_distinct(F.array("_i", "_j"))).alias("_block"))
    return rows.select("component", "_block", "rep").join(tiles, ["component", "_block"]).select("component", "_tile", "rep")


def _token_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many sets of ``texts`` hold the tokens of each bucket of their hash: a table of a fixed size."""
    shift = _U(64 - SKETCH_BITS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column(0)):
                total += np.bincount((shingle_sets(data, bounds, width)[0] >> shift).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """(component, token, rep, n, first) for the rarest tokens of each of ``rows`` (component, rep, text).

    A set of n tokens has as many as it may miss of a set at the threshold, and
    one more; ``first`` are those that it may miss of a set no shorter than itself.
    """
    percent = round(similarity * 100)
    counts = rows.sparkSession.sparkContext.broadcast(_token_counts(rows, width))
    shift = _U(64 - SKETCH_BITS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, bounds in text_slices(batch.column(2)):
                flat, ends = shingle_sets(data, bounds, width)
                often, n, places, first = counts.value[(flat >> shift).astype(np.int64)], np.diff(ends), [], []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    size = b - a
                    most = size + (-percent * size // 100) + 1
                    fewest = size + (-2 * percent * size // (100 + percent)) + 1
                    places.append(a + np.lexsort((flat[a:b], often[a:b]))[:most])
                    first.append(np.arange(len(places[-1])) < fewest)
                if not places:
                    continue
                row, at = np.repeat(np.arange(len(n)), [len(p) for p in places]), np.concatenate(places)
                back = pa.array(row + lo)
                arrays = [batch.column(0).take(back), pa.array(flat[at].view(np.int64)), batch.column(1).take(back), pa.array(n[row]), pa.array(np.concatenate(first))]
                yield pa.RecordBatch.from_arrays(arrays, names=["component", "token", "rep", "n", "first"])

    return rows.select("component", "rep", "text").mapInArrow(cut, "component long, token long, rep long, n long, first boolean")


def _sharing(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """(component, rep, part, n_bytes) of ``rows`` (and text) by shared prefix token, each token a component of its own.

    Tokens of one part, of no set's first ones, or with the same members as another are left out.
    """
    own = rows.select("rep", "part", "n_bytes")
    prefixes = stored(_prefixes(rows, width, similarity).join(own, "rep"), "prefixes")
    some = F.xxhash64("rep", "first")
    groups = prefixes.groupBy("component", "token").agg(
        F.count(F.lit(1)).alias("members"), F.count_if("first").alias("firsts"), F.min("part").alias("_a"), F.max("part").alias("_b"),
        F.min(F.when(F.col("first"), F.col("n"))).alias("_low"), F.max(F.when(F.col("first"), F.col("n"))).alias("_high"), F.bit_xor(some).alias("_x"), F.bit_xor(F.xxhash64(some)).alias("_y"),
    ).where("members > 1 and firsts > 0 and _a <> _b")
    groups = groups.groupBy("component", "members", "firsts", "_x", "_y").agg(F.min(F.struct("token", "_low", "_high")).alias("_g")).select("component", "_g.*")
    # A token may be in very many sets, so both sides are salted.
    groups = groups.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = prefixes.withColumn("_k", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    longer = (F.col("n") >= F.col("_low")) & (round(similarity * 100) * F.col("n") <= 100 * F.col("_high"))
    met = salted.join(groups, ["component", "token", "_k"]).where(F.col("first") | longer)
    return met.select(F.xxhash64("component", "token").alias("component"), "rep", "part", "n_bytes")


def _apart(large: DataFrame, parts: DataFrame, width: int, similarity: float) -> DataFrame:
    """What is still to be compared of large candidates, as tiles (component, _tile, rep)."""
    own = parts.select(F.col("id").alias("rep"), F.col("component").alias("part"))
    rows = large.join(own, "rep", "left").withColumn("part", F.coalesce("part", "rep")).select("component", "part", "rep", "n_bytes")
    rows = stored(rows.join(_sized(rows), ["component", "part"]), "apart")
    tiles = _tiles(rows.where(F.col("_shared") <= FEW))
    many = rows.where(F.col("_shared") > FEW)
    if many.limit(1).count():
        texts = many.select("component", "part", "rep", "n_bytes").join(large.select("rep", "text"), "rep")
        met = stored(_sharing(texts, width, similarity), "sharing")
        sizes = _sized(met)
        met = met.join(sizes, ["component", "part"])
        whole = (F.col("_shared") <= 1) & F.col("owner").isNull()
        # Tokens whose members all share one block are one tile.
        alone = sizes.where("owner is not null").select("component").distinct()
        one = met.where(whole).join(alone, "component", "left_anti").select("component", F.lit(0).cast("long").alias("_tile"), "rep")
        others = met.join(one.select("component").distinct(), "component", "left_anti")
        tiles = tiles.unionByName(one).unionByName(_tiles(others))
    return tiles


def _one_each(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` (with _d, _h) in which an id and text that very many rows repeat are one row."""
    spark = rows.sparkSession
    most = max(REPEATED, sets.count() // (4 * partitions(spark)))
    # Fewer than four a task, whatever the input.
    often = sets.where("doc_id is not null").groupBy("doc_id", "_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(F.col("doc_id").alias("_d"), "_h").collect()
    if not often:
        return rows
    often = F.broadcast(spark.createDataFrame(often, "_d long, _h long"))
    return rows.join(often, ["_d", "_h"], "left_anti").unionByName(_first(rows.join(often, ["_d", "_h"], "left_semi")))


def _first(rows: DataFrame) -> DataFrame:
    """One of the rows of each (_d, _h), by a hash of the others' columns."""
    names = [c for c in rows.columns if c not in ("_d", "_h")]
    plain = [c for c, kind in rows.dtypes if c in names and "map<" not in kind and "variant" not in kind]
    one = rows.groupBy("_d", "_h").agg(F.min_by(F.struct(*names), F.xxhash64(*plain)).alias("_r"))
    return one.select("_d", "_h", *(F.col(f"_r.{c}").alias(c) for c in names))


def _labelled(docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The sets of ``docs`` (doc_id, text), and (doc_id, _h, n_shingles, component_id, kept, chosen) of every row.

    chosen rows of a component share one id and one hash of the text.
    """
    docs = picked(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sets = stored(shingled(docs, width), "sets")
    some = sets.where("doc_id is not null and n_shingles > 0")
    one = F.min(F.struct("doc_id", "_h", "n_bytes")).alias("_r")
    classes = some.groupBy("set_a", "set_b").agg(one, F.first("n_shingles").alias("n_shingles"), F.first("roots").alias("roots"), F.first("signature").alias("signature"))
    # A class is named by its place in the stored table; its text is that of its smallest id.
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), "_r.doc_id", "_r._h", "_r.n_bytes", "set_a", "set_b", "roots", "signature")
    classes = stored(classes, "classes")

    candidates = stored(components(candidate_edges(classes, similarity)), "candidates")
    members = classes.select("rep", F.col("doc_id").alias("_d"), "_h", "n_bytes").join(candidates.withColumnRenamed("id", "rep"), "rep")
    groups = members.groupBy("component").agg(_blocks(F.count(F.lit(1)), F.sum("n_bytes")).alias("blocks"))
    members = members.join(groups, "component")
    rows = _one_each(docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"), "text"), sets)
    texts = stored(rows.join(members, ["_d", "_h"]).select("component", "blocks", "rep", "n_bytes", "text"), "members")

    # A candidate that fits one block is confirmed whole; a larger one twice in blocks at random.
    passes = F.when(F.col("blocks") > 1, F.lit(2)).otherwise(F.lit(1))
    first = texts.select("component", "blocks", "rep", "n_bytes", "text", F.explode(F.sequence(F.lit(1), passes)).alias("_pass"))
    first = first.withColumn("_tile", F.xxhash64("_pass", F.pmod(F.xxhash64("rep", "_pass"), F.col("blocks"))))
    size = first.agg(F.sum("n_bytes")).first()[0] or 0
    key = ["component", "_tile"]
    first = first.select(*key, "rep", "text").repartition(partitions(docs.sparkSession, size), *key).sortWithinPartitions(*key, "rep")
    found = stored(confirmed_edges(first, width, similarity), "links")
    true = components(found)
    large = texts.where("blocks > 1").select("component", "rep", "n_bytes", "text")
    if large.limit(1).count():
        true = stored(true, "parts")
        tiles = stored(_apart(large, true, width, similarity), "tiles")
        rest = confirmed_edges(_dealt(tiles, large), width, similarity)
        true = components(found.unionByName(rest))
    true = stored(true, "components")

    linked = classes.select("rep", "doc_id", "_h", "set_a", "set_b").join(true, F.col("rep") == F.col("id"), "left").withColumn("_root", F.coalesce("component", "rep"))
    least = linked.where("id is not null").groupBy("_root").agg(F.min(F.struct("doc_id", "_h")).alias("_l"))
    named = linked.join(least, "_root", "left").select(
        F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), F.coalesce("_l.doc_id", "doc_id").alias("_c"), F.coalesce("_l._h", "_h").alias("_g"),
    )
    own = sets.select("doc_id", "_h", "n_shingles", "set_a", "set_b")
    found = own.join(named, (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("_c", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    chosen = kept & F.coalesce(F.col("_h") == F.col("_g"), F.lit(True))
    return sets, found.select("doc_id", "_h", "n_shingles", component.alias("component_id"), kept.alias("kept"), chosen.alias("chosen"))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document (doc_id, text).

    Two documents are linked if their sets' intersection is at least
    ``similarity`` (whole per cent) of the union; component_id is the smallest id
    that links lead to, and a document is kept if it is its own.
    """
    return _labelled(docs, width, similarity)[1].select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that of the smallest id; all columns.

    Of rows that repeat an id and its text one is kept; rows of one id whose texts
    are no near copies are groups of their own.  Rows with a null id are kept.
    """
    sets, found = _labelled(docs, width, similarity)
    kept = found.where("chosen and doc_id is not null").select(F.col("doc_id").alias("_d"), "_h").distinct()
    rows = numbered(docs).withColumns({"_d": own(docs, "doc_id").cast("long"), "_h": F.xxhash64(own(docs, "text"))})
    one = _first(_one_each(rows.where("_d is not null"), sets).join(kept, ["_d", "_h"]))
    return one.unionByName(rows.where("_d is null").select(*one.columns)).select(*restored(docs))
