"""URL allow and block lists as one trie over reversed host labels and path segments.

A rule names a host and a path; it fits that host and every subdomain, where
the url's path starts with the rule's path.  Of the rules that fit, the one
with the longest text wins, whether it allows or blocks; of equally long ones
the one with the longer host, and of equal rules the blocking one.  Urls
without a fitting rule get the default verdict.

The compiled trie is broadcast.  It is built from a list that the caller holds
in memory.  A trie holds ``MAX_RULES`` rules at most; longer lists are judged in
several passes, of whose best rules the best one counts.

Host and path: the host is what follows the first ``://`` up to ``/``, ``?``,
``#`` or the end, with A-Z in lower case; the path is what follows up to ``?``,
``#`` or the end.  A null url, or one without ``://``, has an empty host and
path and so gets the default verdict (unless a rule has an empty host).  Urls of
any length are judged whole.  Repeated rows are judged alike; an empty table gives an
empty table.  Columns named like the added ones (in any case) are replaced; all
others are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .naming import numbered, own, restored

MAX_RULES = 1_000_000
RESULT = "host string, path string, rule string, verdict string, length int, host_length int, blocks boolean"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


class RuleTrie:
    """Nodes are dicts: labels lead down the host, then segments down the path.

    A host node keeps the root of its paths at key ``None``.  A path node keeps
    at key ``None`` the rules that end there: (rest of the path that is no
    whole segment, rule).
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"verdict {rule.verdict!r}")
            node = self.root
            for label in self._labels(rule.host):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, rest = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, []).append((rest, rule))

    @staticmethod
    def _labels(host: str) -> list[str]:
        return host.split(".")[::-1] if host else []

    def find(self, host: str, path: str) -> Rule | None:
        best, best_key = None, (-1, -1, False)
        segments = path.split("/")
        node = self.root
        for label in [None, *self._labels(host)]:
            if label is not None:
                if label not in node:
                    break
                node = node[label]
            at = node.get(None)
            for k, segment in enumerate(segments):
                if at is None:
                    break
                for rest, rule in at.get(None, ()):
                    key = (len(rule.text), len(rule.host), rule.verdict == "block")
                    if key > best_key and (segment.startswith(rest) if rest else True):
                        best, best_key = rule, key
                at = at.get(segment) if k < len(segments) - 1 else None
        return best


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


def _pass(df: DataFrame, rules: list[Rule], url: Column) -> Column:
    """A struct of host, path and the best of ``rules``, with the order of precedence; nulls where none fits."""
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf(RESULT)
    def judge(urls: pd.Series) -> pd.DataFrame:
        found, rows = trie.value.find, []
        for u in urls:
            host, path = host_and_path(u)
            rule = found(host, path)
            rows.append((host, path, None, None, None, None, None) if rule is None else (host, path, rule.text, rule.verdict, len(rule.text), len(rule.host), rule.verdict == "block"))
        out = pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "length", "host_length", "blocks"])
        return out.astype({"length": "Int32", "host_length": "Int32", "blocks": "boolean"})

    return judge(url)


def judge_urls(df: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule (text of the rule that decided, else null) and verdict."""
    rules, names = list(rules), ("host", "path", "rule", "verdict")
    passes = [rules[i : i + MAX_RULES] for i in range(0, len(rules), MAX_RULES)] or [[]]
    judged = numbered(df)
    for k, part in enumerate(passes):
        judged = judged.withColumn(f"_p{k}", _pass(df, part, own(df, url)))
    # A struct of the order of precedence comes first; nulls are passed over.
    best = [F.when(F.col(f"_p{k}.length").isNotNull(), F.struct(*(F.col(f"_p{k}.{c}") for c in ("length", "host_length", "blocks", "rule", "verdict")))) for k in range(len(passes))]
    judged = judged.withColumn("_best", F.greatest(*best) if len(best) > 1 else best[0])
    return judged.select(
        *restored(df, without=names), F.col("_p0.host").alias("host"), F.col("_p0.path").alias("path"),
        F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
