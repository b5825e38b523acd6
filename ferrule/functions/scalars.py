"""Column expressions shared by the operators. Only ``bucket_sums`` and ``canonical_hash`` leave the JVM, in Arrow batches."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0, default: float = 0.0) -> Column:
    """x within [low, high]; null counts as ``default`` (greatest and least skip nulls)."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x, F.lit(default))))


def r3(x: Column) -> Column:
    """x to three digits, by its exact binary value, ties to even (``round`` goes by the printed value).

    2000 x is compared with the odd number 2m + 1 without rounding: x is split into
    24 and 29 bits, whose products with 2000 are exact.
    """

    def rounded(v: Column) -> Column:
        high = v.cast("float").cast("double")
        m = F.floor(v * 1000.0)
        beyond = (high * 2000.0 - (2 * m + 1)) + (v - high) * 2000.0
        up = (beyond > 0) | ((beyond == 0) & (F.pmod(m, F.lit(2)) == 1))
        return F.when(up, m + 1).otherwise(m) / 1000.0

    return F.element_at(F.transform(F.array(x.cast("double")), rounded), 1)


def present(x: Column) -> Column:
    """Whether a text is neither null nor empty."""
    return F.coalesce(x != "", F.lit(False))


def first_present(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts))


def first_named(columns: list[str], aliases: list[str], default: Column) -> Column:
    """The first alias among ``columns`` that is not blank, trimmed; else the default."""
    found = [F.nullif(F.trim(F.col(f"`{a}`").cast("string")), F.lit("")) for a in aliases if a in columns]
    return F.coalesce(*found, default)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(name)) for condition, name in pairs)))


def strip_blanks(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normal_label(x: Column) -> Column:
    return F.lower(strip_blanks(x))


def stable_id(namespace: Column, text: Column) -> Column:
    """24 hexadecimal digits that name a text within a namespace."""
    return F.substring(F.sha2(F.concat_ws(":", namespace, text), 256), 1, 24)


def chunk_id(kind: str, path: Column, idx: Column) -> Column:
    """The name of a chunk: by the file's name for sliding chunks, by its stem for others; bounded ones count from 1."""
    if kind == "sliding":
        return F.concat(F.lit("doc:"), file_name(path), F.lit(":"), idx.cast("string"))
    return F.concat(file_stem(path), F.lit("-chunk-"), (idx + 1 if kind == "bounded" else idx).cast("string"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^./]+)$", 1))


def as_list(x: Column, is_array: bool) -> Column:
    """Null becomes an empty array, a scalar an array of one, an array stays."""
    return F.coalesce(x, F.array().cast("array<string>")) if is_array else F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x))


def chunks_sliding(text: Column, size: int = 1200, overlap: int = 160) -> Column:
    """Chunks from every step on, so a last one may lie within the one before; (index, start, chunk)."""
    step = max(size - overlap, 1)
    n = F.char_length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda s, i: F.struct(i.alias("idx"), s.alias("start"), strip_blanks(F.substring(text, s + 1, F.lit(size))).alias("chunk")))
    return F.filter(cut, lambda c: c["chunk"] != "")


def chunks_bounded(text: Column, size: int = 1200, overlap: int = 120) -> Column:
    """Chunks until one reaches the end, stripped; blank ones are left out but keep their index; (idx, start, end, chunk)."""
    step = max(size - overlap, 1)
    n = F.char_length(text)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.when(strip_blanks(text) != "", F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda s, i: F.struct(i.alias("idx"), s.alias("start"), F.least(s + size, n).alias("end"), strip_blanks(F.substring(text, s + 1, F.lit(size))).alias("chunk")))
    return F.filter(cut, lambda c: c["chunk"] != "")


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def chunks_collapsed(text: Column, size: int = 900, overlap: int = 120) -> Column:
    """As bounded, after runs of blanks become one; an empty text has one empty chunk."""
    step = max(size - overlap, 1)

    def cut(flat: Column) -> Column:
        last = F.greatest(F.ceil((F.char_length(flat) - size) / step), F.lit(0)).cast("int")
        starts = F.transform(F.sequence(F.lit(0), last), lambda k: k * step)
        return F.transform(starts, lambda s, i: F.struct(i.alias("idx"), s.alias("start"), F.substring(flat, s + 1, F.lit(size)).alias("chunk")))

    # Bound to a variable, the collapsed text is made once, not for every chunk.
    return F.element_at(F.transform(F.array(collapse_blanks(text)), cut), 1)


#: The words of each focus, in order of precedence; any place in the text counts.
FOCUS_WORDS = [
    ("visual_diagnostic", ["ct", "mri", "rmn", "tac", "lesion", "nodule", "imaging"]),
    ("language_listening", ["cough", "pain", "fatigue", "history", "symptom", "complaint"]),
    ("epidemiology", ["travel", "smoking", "exposure", "occupation", "prevalence"]),
]


def focus(query: Column) -> Column:

    def found(low: Column) -> Column:
        out = F
        for name, words in FOCUS_WORDS:
            out = out.when(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), F.lit(name))
        return out.otherwise(F.lit("multimodal_context"))

    # Bound to a variable, the lower-cased text is made once, not for every word.
    return F.element_at(F.transform(F.array(F.lower(F.coalesce(query, F.lit("")))), found), 1)


def bucket_sums(text: Column, dimensions: int = 128) -> Column:
    """Whole-number bucket sums of the positional byte hash, an array by bucket: byte b at place i adds b mod 31 + 1 to bucket (b + i) mod d."""

    @F.arrow_udf("array<bigint>")
    def summed(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            data = np.frombuffer((value.as_py() or "").encode(), dtype=np.uint8).astype(np.int64)
            rows.append(np.bincount((data + np.arange(len(data))) % dimensions, weights=data % 31 + 1, minlength=dimensions).astype(np.int64))
        return pa.array(rows, pa.list_(pa.int64()))

    return summed(text)


def canonical_hash(payload: Column) -> Column:
    """sha256 of a JSON text in its canonical form: sorted keys at every level, ", " and ": " between, all beyond ASCII escaped.

    A null, or what is no JSON, has no hash.
    """

    @F.arrow_udf("string")
    def hashed(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for value in texts:
            try:
                whole = json.dumps(json.loads(value.as_py() or ""), sort_keys=True, default=str)
            except ValueError:
                out.append(None)
            else:
                out.append(hashlib.sha256(whole.encode()).hexdigest())
        return pa.array(out, pa.string())

    return hashed(payload)


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
