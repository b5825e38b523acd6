"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The splitting pattern is that of the rank files' README: contractions, then runs
of letters, of numbers or of other characters, each with an optional blank
before it, and runs of white space that leave their last character to what
follows.  No regular expression is run.  Every code point of a slice of texts
has a class; classes and the next characters give one of nine symbols; and a
symbol is a transition function on the eight states of a small automaton.
Functions compose associatively, so each block of characters is reduced to
one function, the blocks' functions are chained, and all blocks are then run from
their known first states side by side; the boundary flags come out of the same
table.

The slices between boundaries are encoded by merging pairs in rank order, and each
worker keeps the ids of slices it has seen.  Decoding gathers the bytes of ids
from one table by offsets.

Edge cases: null and empty texts have no ids and decode to nothing.  A very long
text is cut into windows of about ``SLICE_BYTES`` characters before a blank that
follows another character, where a token always begins, so memory is bounded
by the window (a longer run without blanks is one window).  Slices of any length
are merged in n log n steps.  Repeated rows are encoded alike.  An empty table
gives an empty table; only the columns named are read, and only those returned.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .naming import picked
from .scratch import bounded_batches
from .textbuf import SLICE_BYTES

#: Slices kept by one worker, and the longest that is kept.
CACHE_SLICES, CACHE_BYTES = 400_000, 64
_BLOCK = 128
_LETTER, _NUMBER, _OTHER, _BLANK, _BREAK = range(5)
#: The characters of the Unicode property White_Space.
_WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Symbols: the classes, an apostrophe that a contraction of one or two letters may follow, a blank that goes to the
# next token, any other white space, the last of such before a token, and the break between texts.
_L, _N, _O, _A1, _A2, _LENT, _W, _WLAST, _E = range(9)
# States: a token must begin; in letters, numbers, others, white space; after a lent blank; one or two letters of a contraction left.
_BEGIN, _IN_L, _IN_N, _IN_O, _IN_W, _AFTER, _LEFT1, _LEFT2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    step, begins = np.zeros((9, 8), dtype=np.uint8), np.ones((9, 8), dtype=bool)
    step[_L], step[_N], step[_O], step[_A1], step[_A2], step[_LENT], step[_W] = _IN_L, _IN_N, _IN_O, _LEFT1, _LEFT2, _AFTER, _IN_W
    step[_L, _LEFT1], step[_L, _LEFT2] = _BEGIN, _LEFT1
    begins[_L, [_IN_L, _AFTER, _LEFT1, _LEFT2]] = False
    begins[_N, [_IN_N, _AFTER]] = False
    begins[_W, _IN_W] = False
    for s in (_O, _A1, _A2):
        step[s, [_IN_O, _AFTER]] = _IN_O
        begins[s, [_IN_O, _AFTER]] = False
    return step.ravel(), begins.ravel()


_STEP, _BEGINS = _automaton()
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _CLASSES:
        kinds = {"L": _LETTER, "N": _NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
        table[_WHITE_SPACE] = _BLANK
        _CLASSES.append(table)
    return _CLASSES[0]


def _symbols(chars: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    kind = classes()[chars]
    kind[breaks] = _BREAK
    out = kind.copy()  # letters, numbers and others are their own symbols
    nxt = np.full(len(kind), _BREAK, dtype=np.uint8)
    nxt[:-1] = kind[1:]
    token_next = nxt <= _OTHER
    blank = kind == _BLANK
    out[blank] = _W
    out[blank & token_next] = _WLAST
    out[blank & token_next & (chars == 32)] = _LENT
    out[breaks] = _E
    at = np.flatnonzero((chars == 39) & (kind == _OTHER))
    if len(at):
        real = np.where(kind == _BREAK, 0, chars)  # the text ends at a break
        padded = np.concatenate([real, [0, 0]])
        a, b = padded[at + 1], padded[at + 2]
        c = {x: ord(x) for x in "strvemld"}
        out[at[np.isin(a, [c["s"], c["t"], c["m"], c["d"]])]] = _A1
        two = ((a == c["r"]) & (b == c["e"])) | ((a == c["v"]) & (b == c["e"])) | ((a == c["l"]) & (b == c["l"]))
        out[at[two]] = _A2
    return out


def boundaries(chars: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where tokens begin in the code points ``chars`` of texts that the positions ``breaks`` separate."""
    symbols = _symbols(chars, breaks)
    n = len(symbols)
    blocks = -(-n // _BLOCK)
    padded = np.full(blocks * _BLOCK, _E, dtype=np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T).astype(np.intp) * 8
    # Each block's function: the last state for every first state.
    whole = np.tile(np.arange(8, dtype=np.intp), (blocks, 1))
    for column in columns:
        whole = _STEP.take(column[:, None] + whole).astype(np.intp)
    firsts, state = [], _BEGIN
    for function in whole.tolist():
        firsts.append(state)
        state = function[state]
    state = np.array(firsts, dtype=np.intp)
    flags = np.empty((_BLOCK, blocks), dtype=bool)
    for j, column in enumerate(columns):
        at = column + state
        flags[j] = _BEGINS.take(at)
        state = _STEP.take(at).astype(np.intp)
    return np.flatnonzero(flags.T.ravel()[:n])


class ByteBpe:
    """Encoder and decoder for a file of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        names = [b""] * size
        for name, rank in self.ranks.items():
            names[rank] = name
        self.table = np.frombuffer(b"".join(names), dtype=np.uint8)
        self.lengths = np.array([len(x) for x in names], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.cache: dict[bytes, tuple[str, bytes]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one slice: again and again the adjacent pair of the lowest rank becomes one, the leftmost first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 200:
            return self._merge_long(piece)
        get, none = self.ranks.get, len(self.offsets)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        costs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs and links between the parts."""
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # of the part that begins here; 0 where none does any more
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, stop = heapq.heappop(heap)
            mid = end[a]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the two has changed since
            end[a], end[mid] = stop, 0
            if stop < n:
                before[stop] = a
                if (r := get(piece[a : end[stop]])) is not None:
                    heapq.heappush(heap, (r, a, end[stop]))
            if (p := before[a]) >= 0 and (r := get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def pieces(self, texts: list[str]) -> list[list[bytes]]:
        """The slices of every text."""
        joined = "\n".join(texts) + "\n"
        chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        breaks = np.cumsum(lens + 1) - 1
        starts = boundaries(chars, breaks)
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        at = (np.cumsum(width) - width)[starts].tolist()
        raw = joined.encode()
        cuts = np.searchsorted(starts, breaks).tolist()  # the break itself is the token after a text's own
        out, first = [], 0
        for cut in cuts:
            own = at[first : cut + 1]
            out.append([raw[a:b] for a, b in zip(own, own[1:])])
            first = cut + 1
        return out

    def _held(self, pieces: list[bytes]) -> list[tuple[str, bytes]]:
        cache = self.cache
        found = list(map(cache.get, pieces))
        if None in found:
            if len(cache) > CACHE_SLICES:
                cache.clear()
            for i, held in enumerate(found):
                if held is None:
                    piece = pieces[i]
                    held = cache.get(piece)
                    if held is None:
                        ids = self.merge(piece)
                        held = (",".join(map(str, ids)), np.array(ids, dtype="<u4").tobytes())
                        if len(piece) <= CACHE_BYTES:
                            cache[piece] = held
                    found[i] = held
        return found

    @staticmethod
    def windows(text: str) -> Iterator[str]:
        """Parts of a text that are encoded alone as they are within it."""
        at = 0
        while len(text) - at > SLICE_BYTES:
            cut = at + SLICE_BYTES
            while cut < len(text) and not (text[cut] in " \n" and not text[cut - 1].isspace()):
                cut += 1
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """For every text its ids, and the same as decimals joined by commas."""
        at = 0
        while at < len(texts):
            if len(texts[at] or "") <= SLICE_BYTES:
                short = at
                while at < len(texts) and len(texts[at] or "") <= SLICE_BYTES:
                    at += 1
                yield from self._encode_short(texts[short:at])
            else:
                parts = [x for w in self.windows(texts[at]) for x in self._encode_short([w])]
                yield np.concatenate([p[0] for p in parts]), ",".join([p[1] for p in parts if p[1]])
                at += 1

    def _encode_short(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size + len(texts[at] or "") <= SLICE_BYTES):
                part.append(texts[at] or "")
                size += len(part[-1])
                at += 1
            for pieces in self.pieces(part):
                held = self._held(pieces)
                yield np.frombuffer(b"".join([h[1] for h in held]), dtype="<u4"), ",".join([h[0] for h in held])

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes end in the decoded bytes."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        lens = self.lengths[ids]
        shift = self.offsets[ids] - (np.cumsum(lens) - lens)
        return self.table[np.arange(int(lens.sum())) + np.repeat(shift, lens)].tobytes()


_CODECS: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """This worker's codec for the rank file at ``path``."""
    if path not in _CODECS:
        _CODECS[path] = ByteBpe(path)
    return _CODECS[path]


def encode_texts(df: DataFrame, ranks: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, ends): the ids of every whole text and where each one's bytes end."""
    bounded_batches(df.sparkSession)
    df = picked(df, id_column, text)
    kind = df.schema[id_column].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            ids = [x for x, _ in own.encode(batch.column(1).to_pylist())]
            columns = [batch.column(0), pa.array([x.astype(np.int32) for x in ids], type=pa.list_(pa.int32())), pa.array([own.ends(x) for x in ids], type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "ids", "ends"])

    return df.mapInArrow(encoded, f"`{id_column}` {kind}, ids array<int>, ends array<long>")


def decode_ids(df: DataFrame, ranks: str, id_column: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); bytes that are no UTF-8 are replaced."""
    bounded_batches(df.sparkSession)
    df = picked(df, id_column, "ids")
    kind = df.schema[id_column].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[id_column, "text"])

    return df.mapInArrow(decoded, f"`{id_column}` {kind}, text string")


def round_trip_digests(docs: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again."""
    bounded_batches(docs.sparkSession)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            rows = [(len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()) for ids, text in own.encode(batch.column(1).to_pylist())]
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, type=pa.int64()), pa.array(a, type=pa.string()), pa.array(b, type=pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = picked(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
