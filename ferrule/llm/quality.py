"""Document quality by a classifier combined with hierarchical site posteriors.

Evidence of a document: a logistic regression over features of its whole text
(shares of character classes and of their pairs, repeated words and lines, word
lengths), learned from labelled documents.  Evidence of a site: the expected
number of good documents of a host, and of a path within the host, from grouped
aggregation over all documents.  Empirical Bayes shrinks them: a host's rate
towards the global rate, a path's towards its host's, by strengths that the
spread between hosts and between paths determines; sparse sites stay near the
prior.  A document's posterior odds are its likelihood ratio times the prior
odds of its path, where path, host and total leave the document itself out, so
that its text counts once.

``MAX_LABELLED`` bounds the labelled rows that the classifier is fitted on; a
seeded hash chooses them.  Site statistics cover all documents.

Edge cases: null hosts and paths are sites named by the empty string.  Null and
empty texts get the features of an empty text; very long texts are measured whole.
Null labels are not learned from; with fewer than two classes of labels the
classifier is uninformative and every document gets its site's rate.  Where labels
of one id differ, the greatest counts.  Repeated rows count each time in site
rates; rows that repeat a labelled id are learned from once.  An empty table gives
an empty table.  ``classify`` returns only its own columns, ``good_documents`` those
of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .naming import numbered, own, picked, place, restored
from .scratch import bounded_batches, stored
from .textbuf import LOWER, range_hashes, text_slices, word_ranges

MAX_LABELLED = 20_000
#: Site tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SITES = 100_000
#: The strongest prior that the spread between sites can ask for, in documents.
MAX_STRENGTH = 10_000.0
#: Parts of a site's documents in a join by a shuffle, told apart by the columns of these types.
SALTS = 16
_PLAIN = {"bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "string"}
_CLASSES = 16


def _byte_classes() -> np.ndarray:
    out = np.full(256, 15, dtype=np.uint8)  # beyond ASCII
    out[:128] = 14  # other
    out[97:123], out[65:91], out[48:58], out[32], out[10] = 0, 1, 2, 3, 4
    for k, chars in enumerate([".", ",", "!?", "|", "#%&$*", "<>{}[]", "/\\=_~^", "'\"()", ":;-"]):
        out[[ord(c) for c in chars]] = 5 + k
    return out


_CLASS = _byte_classes()
N_FEATURES = _CLASSES + _CLASSES * _CLASSES + 6


def features(column: pa.Array) -> np.ndarray:
    """A row of ``N_FEATURES`` for every text."""
    out = np.zeros((len(column), N_FEATURES), dtype=np.float32)
    for lo, hi, data, bounds in text_slices(column):
        n = hi - lo
        lens = np.diff(bounds)
        some = np.maximum(lens, 1)[:, None]
        kind = _CLASS[data].astype(np.int64)
        row = np.repeat(np.arange(n), lens)
        single = np.bincount(row * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, -1)
        pair = np.bincount((row[1:] * _CLASSES + kind[1:]) * _CLASSES + kind[:-1], weights=row[1:] == row[:-1], minlength=n * _CLASSES**2).reshape(n, -1)
        starts, ends, words = word_ranges(data, bounds)
        hashes = range_hashes(LOWER[data], starts, ends)
        n_words = np.diff(words)
        again = np.zeros(len(hashes) + 1, dtype=np.int64)
        if len(hashes):
            same = np.zeros(len(hashes), dtype=bool)
            same[1:] = hashes[1:] == hashes[:-1]
            inner = words[:-1][(words[:-1] < len(hashes))]
            same[inner] = False
            again[1:] = np.cumsum(same)
        distinct = np.fromiter((len(np.unique(hashes[a:b])) for a, b in zip(words[:-1], words[1:])), dtype=np.int64, count=n)
        per = np.maximum(n_words, 1)
        sums = np.concatenate([[0], np.cumsum(ends - starts)])
        extra = np.stack([
            np.log1p(lens), np.log1p(n_words), (again[words[1:]] - again[words[:-1]]) / per, distinct / per,
            (sums[words[1:]] - sums[words[:-1]]) / per / 10, np.log1p(n_words) * distinct / per,
        ], axis=1)
        out[lo:hi] = np.concatenate([single / some, pair / some, extra], axis=1)
    return out


@dataclass(frozen=True)
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    base: float  # share of good documents among those learned from

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """The logarithm of the likelihood ratio of good to bad."""
        z = (x - self.mean) / self.scale @ self.weights + self.bias
        return np.clip(z, -12, 12) - np.log(self.base / (1 - self.base))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> Classifier:
    """Logistic regression by Newton steps."""
    x = x.astype(np.float64)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    if len(np.unique(y)) < 2:
        return Classifier(mean, scale, np.zeros(x.shape[1]), 0.0, 0.5)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        bend = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]), float(np.clip(y.mean(), 1e-3, 1 - 1e-3)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """Fit on documents (doc_id, text) with labels (doc_id, quality 0 or 1)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs, labels = picked(docs, "doc_id", "text"), picked(labels, "doc_id", "quality")
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))
    # max_labelled bounds this table of (id, 0 or 1).
    rows = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], type=pa.binary()), batch.column(2)], names=["doc_id", "x", "quality"])

    measured_rows = rows.select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(measured, "doc_id long, x binary, quality int")
    # Rows that repeat an id count once, so no more than max_labelled rows or so come to the driver.
    got = measured_rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).select("doc_id", "r.x", "r.quality").toPandas()
    got = got.sort_values("doc_id")  # a fixed order, so that the fit does not hang on the order of tasks
    x = np.stack([np.frombuffer(b, dtype=np.float32) for b in got["x"]]) if len(got) else np.zeros((0, N_FEATURES), np.float32)
    return fit(x, got["quality"].to_numpy(dtype=np.float64))


def evidence(df: DataFrame, classifier: Classifier, text: str = "text") -> Column:
    """The classifier's log-likelihood ratio for the texts of ``df``, rounded to 6 digits."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        column = pa.array(texts.tolist(), type=pa.string())
        return pd.Series(np.round(shared.value.evidence(features(column)), 6))

    return scored(F.col(f"`{text}`"))


def _strength(within: DataFrame, n: str, rate: str, centre: Column) -> Column:
    """How many documents the prior is worth: by the spread of group rates beyond that of sampling."""
    m = F.sum(F.col(n) * F.col(rate)) / F.sum(n)
    spread = F.sum(F.col(n) * (F.col(rate) - centre) ** 2)
    k = F.count(F.lit(1))
    between = (spread - (k - 1) * m * (1 - m)) / F.greatest(F.sum(n) - F.sum(F.col(n) * F.col(n)) / F.sum(n), F.lit(1e-9))
    return F.when((k > 1) & (between > 1e-9), F.least(m * (1 - m) / between, F.lit(MAX_STRENGTH))).otherwise(F.lit(MAX_STRENGTH))


@dataclass(frozen=True)
class Sites:
    """Documents and expected good ones of every (host, path), their total, and how much the priors weigh."""

    table: DataFrame  # host, path, n_host, s_host, n_path, s_path
    n: float
    s: float
    base: float
    host_strength: float
    path_strength: float

    def rates(self, own: Column | float = 0.0, rows: float = 0.0) -> tuple[Column, Column]:
        """The shrunken rates of host and path, without ``rows`` documents that ``own`` good ones are expected of."""
        c = F.col
        rate = (F.lit(self.s) - own + self.base) / (self.n - rows + 1)
        host = (c("s_host") - own + self.host_strength * rate) / (c("n_host") - rows + self.host_strength)
        return host, (c("s_path") - own + self.path_strength * host) / (c("n_path") - rows + self.path_strength)


def _expected(base: float) -> Column:
    """The expected number of good documents that a document's evidence stands for."""
    return 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(base / (1 - base))))))


def site_posteriors(scored: DataFrame, base: float) -> Sites:
    """Site statistics of ``scored``, which has host, path and evidence for every document."""
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n_path"), F.sum(_expected(base)).alias("s_path"))
    paths = stored(paths, "sites").withColumn("r_path", F.col("s_path") / F.col("n_path"))
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host")).withColumn("r_host", F.col("s_host") / F.col("n_host"))
    total = hosts.agg(F.coalesce(F.sum("n_host"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("s_host"), F.lit(0.0)).alias("s")).first()
    rate = (total.s + base) / (total.n + 1)
    a = hosts.agg(_strength(hosts, "n_host", "r_host", F.lit(rate)).alias("k")).first().k
    both = paths.join(hosts, "host")
    b = both.agg(_strength(both, "n_path", "r_path", F.col("r_host")).alias("k")).first().k
    return Sites(both.select("host", "path", "n_host", "s_host", "n_path", "s_path"), total.n, total.s, base, a, b)


def posterior(scored: DataFrame, sites: Sites, least: float = 0.5) -> DataFrame:
    """``scored`` (host, path, evidence and others) with the rates of its sites without the document, quality and keep.

    quality is the posterior of good; a document is kept where it is ``least`` or more.
    """
    table = sites.table.withColumnsRenamed({"host": "_h", "path": "_p"})
    same = (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p"))
    if table.count() <= BROADCAST_SITES:
        joined = scored.join(F.broadcast(table), same)
    else:
        # A site may have very many documents, so both sides are salted.
        salt = F.pmod(F.xxhash64(*(c for c, kind in scored.dtypes if kind in _PLAIN)), F.lit(SALTS)).cast("int")
        table = table.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = scored.withColumn("_salt", salt).join(table, same & (F.col("_salt") == F.col("_k"))).drop("_salt", "_k")
    host, path = sites.rates(_expected(sites.base), 1.0)
    rate = F.greatest(F.least(path, F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = F.col("evidence") + F.log(rate / (1 - rate))
    joined = joined.withColumns({"host_rate": F.round(host, 9), "path_rate": F.round(path, 9), "quality": F.round(1 / (1 + F.exp(-odds)), 6)})
    whole = {c: F.col(c).cast("long") for c in ("n_host", "n_path")}
    return joined.withColumn("keep", F.col("quality") >= least).withColumns(whole).drop("_h", "_p", "s_host", "s_path")


def _sited(docs: DataFrame, classifier: Classifier, host: Column, path: Column) -> DataFrame:
    """The columns of ``docs`` by place, with host, path and evidence."""
    wide = docs.select("*", host, path)
    n = len(docs.columns)
    site = F.coalesce(F.col(f"_c{n}").cast("string"), F.lit(""))
    rows = numbered(wide).withColumns({"host": site, "path": F.concat(site, F.lit("/"), F.coalesce(F.col(f"_c{n + 1}").cast("string"), F.lit("")))})
    return rows.withColumn("evidence", evidence(rows, classifier, f"_c{place(docs, 'text')}")).drop(f"_c{n}", f"_c{n + 1}")


def classify(docs: DataFrame, classifier: Classifier, host: Column, path: Column, least: float = 0.5) -> DataFrame:
    """(doc_id, host, path, evidence, n_host, n_path, host_rate, path_rate, quality, keep) of every document."""
    scored = _sited(docs, classifier, host, path).select(own(docs, "doc_id").alias("doc_id"), "host", "path", "evidence")
    scored = stored(scored, "evidence")
    names = ["doc_id", "host", "path", "evidence", "n_host", "n_path", "host_rate", "path_rate", "quality", "keep"]
    return posterior(scored, site_posteriors(scored, classifier.base), least).select(*names)


def good_documents(docs: DataFrame, classifier: Classifier, host: Column, path: Column, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``classify`` would keep, with all columns.

    Rows are stored with their evidence, so every text is scored once and no id is needed.
    """
    scored = stored(_sited(docs, classifier, host, path), "scored")
    sites = site_posteriors(scored.select("host", "path", "evidence"), classifier.base)
    return posterior(scored, sites, least).where("keep").select(*restored(docs))
