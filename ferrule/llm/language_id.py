"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are put in lower case; every character that is no letter counts as a
blank.  The 1-, 2- and 3-grams of characters are hashed to ``FEATURES`` buckets.
Training counts them for each language of the labelled rows, as a grouped
aggregation; the matrix of log-probabilities (features x languages, of a size
fixed by ``FEATURES`` and ``MAX_LANGUAGES``) is broadcast, and batches of texts
are scored in numpy as sparse rows: the matrix rows of all n-grams of a text
are summed up.

``MAX_TRAIN`` bounds the labelled rows that are learned from: where there are
more, a seeded hash of id and text chooses about so many.  Prediction reads every
whole text.

The posterior compares the learned languages only, and is near 1 for nearly any
longer text.  So each text also has its strangeness: how far the mean
log-probability of its n-grams under the best language lies on the way from that
of training texts (0) to that of n-grams drawn evenly (1), less an allowance for
short texts.  ``identified`` rejects texts that are unknown by either measure.

Edge cases: a text that is null or has no letter is ``und`` with score 0, as are
all texts if there is nothing to learn from.  Very long texts are read whole.
Rows with a null language are not learned from.  Ties go to the language that
sorts first.  Repeated rows are scored alike; an empty table gives an empty table.
``identified`` returns the columns of its input, whatever their names.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .naming import numbered, own, picked, restored
from .scratch import bounded_batches
from .textbuf import SLICE_BYTES

FEATURES = 1 << 16
MAX_LANGUAGES = 1024
MAX_TRAIN = 20_000
UNKNOWN = "und"
#: Mean log-probabilities of texts of n n-grams may lie this over the root of n lower by chance.
CHANCE = 8.0
_MULTIPLIERS = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _LETTERS[0]


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts, in order: hashed n-grams, each text's bounds in them, and its number of letters.

    A text of n characters has 3n n-grams; those at its end are filled up with blanks.
    """
    is_letter = letters()
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size + len(texts[at] or "") <= SLICE_BYTES):
            part.append((texts[at] or "").lower())
            size += len(part[-1])
            at += 1
        lens = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        ends = np.cumsum(lens)
        chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = is_letter[chars]
        chars = np.where(known, chars, np.uint32(32))
        bounds = np.concatenate([[0], ends])
        n_letters = np.diff(np.concatenate([[0], np.cumsum(known)])[bounds])
        hashed, key = [], chars * _MULTIPLIERS[0]
        hashed.append(key >> np.uint32(16))
        for k in (1, 2):
            later = np.full(len(chars), 32, dtype=np.uint32)
            later[:-k] = chars[k:]
            for back in range(k):  # the last k characters of a text see no next text
                last = ends[lens > back] - 1 - back
                later[last] = 32
            key = (key ^ later) * _MULTIPLIERS[k]
            hashed.append((key ^ (key >> np.uint32(15))) >> np.uint32(16))
        order = np.stack(hashed, axis=1).ravel() if len(chars) else np.zeros(0, np.uint32)
        yield order, bounds * 3, n_letters


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray  # features x languages, logarithms
    typical: np.ndarray  # mean log-probability of an n-gram in the training texts of each language

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For every text its language, the posterior, and its strangeness."""
        names, scores, strange = [], [], []
        for grams, bounds, n_letters in ngrams(texts):
            sums = np.zeros((len(n_letters), len(self.languages)))
            full = np.flatnonzero(np.diff(bounds))
            if len(full) and self.languages:
                sums[full] = np.add.reduceat(self.matrix[grams], bounds[:-1][full], axis=0, dtype=np.float64)
            known = (n_letters > 0) & bool(self.languages)
            if not self.languages:
                names += [UNKNOWN] * len(n_letters)
                scores.append(np.zeros(len(n_letters)))
                strange.append(np.zeros(len(n_letters)))
                continue
            n = np.maximum(np.diff(bounds), 1)
            mean = sums / n[:, None]
            sums += self.prior
            best = sums.argmax(axis=1)
            gap = self.typical[best] - mean[np.arange(len(best)), best] - CHANCE / np.sqrt(n)
            strange.append(np.where(known, np.maximum(gap, 0) / (self.typical[best] + np.log(FEATURES)), 0.0))
            share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            names += [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            scores.append(np.where(known, share, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(strange) if strange else np.zeros(0)


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, smoothing: float = 0.5) -> LanguageModel:
    """Learn from rows of (doc_id, text, lang)."""
    bounded_batches(labelled.sparkSession)
    rows = picked(labelled, "doc_id", "text", "lang").where("lang is not null and text is not null")
    n = rows.select("lang").count()
    if n > max_train:
        draw = F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 30))
        rows = rows.where(draw < int(max_train / n * (1 << 30)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            at = 0
            for grams, bounds, sizes in ngrams(texts):
                for i, lang in enumerate(langs[at : at + len(sizes)]):
                    own = held.setdefault(lang, np.zeros(FEATURES, dtype=np.int64))
                    own += np.bincount(grams[bounds[i] : bounds[i + 1]], minlength=FEATURES)
                    docs[lang] = docs.get(lang, 0) + 1
                at += len(sizes)
        for lang, own in held.items():
            some = np.flatnonzero(own)
            features = np.concatenate([[-1], some])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(features)), pa.array(features, type=pa.int32()), pa.array(np.concatenate([[docs[lang]], own[some]]), type=pa.int64())], names=["lang", "feature", "n"]
            )

    counts = rows.select("text", "lang").mapInArrow(counted, "lang string, feature int, n long")
    table = counts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique().tolist())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    matrix = np.full((FEATURES, max(len(languages), 1)), smoothing)
    prior = np.zeros(max(len(languages), 1))
    for k, lang in enumerate(languages):
        own = table[table["lang"] == lang]
        seen = own["feature"].to_numpy()
        matrix[seen[seen >= 0], k] += own["n"].to_numpy()[seen >= 0]
        prior[k] = own["n"].to_numpy()[seen < 0].sum()
    seen = matrix - smoothing
    matrix = np.log(matrix / matrix.sum(axis=0)).astype(np.float32)
    typical = (seen * matrix).sum(axis=0) / np.maximum(seen.sum(axis=0), 1)
    return LanguageModel(languages, np.log(prior / prior.sum()) if languages else prior, matrix, typical)


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """A struct column of lang_pred, score and strangeness for the texts of ``df``."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, strangeness double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        names, scores, strange = shared.value.predict([None if t is None else t for t in texts.tolist()])
        return pd.DataFrame({"lang_pred": names, "score": scores, "strangeness": strange})

    return scored(F.col(f"`{text}`"))


def identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, strangest: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known, with a score of ``least`` at least and strangeness of ``strangest`` at most."""
    rows = numbered(docs).withColumn("_text", own(docs, "text"))
    rows = rows.withColumn("_language", predict(rows, model, "_text"))
    known = (F.col("_language.lang_pred") != UNKNOWN) & (F.col("_language.score") >= least) & (F.col("_language.strangeness") <= strangest)
    return rows.where(known).select(*restored(docs))
