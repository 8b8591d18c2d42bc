"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

A rule decides the urls that it fits.  The urls that rules decide are also the labelled ones:
trees are trained on a bounded sample of them and judge the rest.

Null urls and urls without `://` have an empty host and path; they are judged like any other.
Repeated rows are judged each on its own.  Extra columns are ignored.  With an empty table, or with
labels of one kind only, the model is a constant (allow, or that kind).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.llm.common import hash_share, map_rows

#: Verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Bound of the labelled sample on the driver.
SAMPLE_URLS = 20_000

FEATURES = (
    "url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "host_digit_ratio",
    "hyphens", "entropy", "host_entropy", "parameters", "has_fragment", "has_extension", "is_https",
    "suffix_block_rate", "suffix_count", "domain_block_rate", "domain_count",
)


def host_column(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (its host and path) and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


@dataclass
class SuffixStatistics:
    """Share of blocked urls under each last label and last two labels, smoothed with the overall share."""

    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    prior: float = 0.5
    weight: float = 20.0

    @classmethod
    def fit(cls, hosts: list[str], blocked: np.ndarray) -> SuffixStatistics:
        total: Counter = Counter()
        bad: Counter = Counter()
        for host, b in zip(hosts, blocked, strict=True):
            for s in set(_suffixes(host)):
                total[s] += 1
                bad[s] += int(b)
        return cls({s: (bad[s], n) for s, n in total.items()}, float(np.mean(blocked)) if len(blocked) else 0.5)

    def of(self, suffix: str) -> tuple[float, float]:
        bad, n = self.counts.get(suffix, (0, 0))
        return (bad + self.weight * self.prior) / (n + self.weight), math.log1p(n)


def features(urls: list[str | None], hosts: list[str], paths: list[str], suffixes: SuffixStatistics) -> np.ndarray:
    rows = np.zeros((len(urls), len(FEATURES)))
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths, strict=True)):
        url = url or ""
        query = url.partition("#")[0].partition("?")[2]
        last, domain = _suffixes(host)
        digits = sum("0" <= c <= "9" for c in url)
        rows[i] = (
            len(url), len(host), len(path), host.count(".") + bool(host), sum(bool(x) for x in path.split("/")),
            digits / max(len(url), 1), sum("0" <= c <= "9" for c in host) / max(len(host), 1), url.count("-"),
            _entropy(url), _entropy(host), sum(bool(x) for x in re.split("[&;]", query)), "#" in url,
            "." in path.rpartition("/")[2], url[:8].lower() == "https://", *suffixes.of(last), *suffixes.of(domain),
        )
    return rows


@dataclass
class BoostedTrees:
    """Binary gradient boosting with Newton leaf values over histogram bins."""

    trees_wanted: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 32
    least_rows: int = 20
    ridge: float = 1.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, float]]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n = len(y)
        share = (y.sum() + 0.5) / (n + 1) if n else 0.0
        self.base = math.log(share / (1 - share)) if 0 < share < 1 else -10.0
        if n < 2 * self.least_rows or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        score = np.full(n, self.base)
        for _ in range(self.trees_wanted):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        """A complete tree as a heap of (feature, bin, leaf value); a node with feature -1 sends all rows left."""
        tree = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
        at = np.zeros(len(g), int)
        for node in range(2**self.depth - 1):
            rows = np.flatnonzero(at == node)
            tree[node], best = (-1, self.bins, 0.0), 1e-6
            if len(rows) >= 2 * self.least_rows:
                gs, hs = g[rows], h[rows]
                whole = gs.sum() ** 2 / (hs.sum() + self.ridge)
                for j in range(b.shape[1]):
                    k = b[rows, j]
                    cg, ch, cn = (np.cumsum(np.bincount(k, w, minlength=self.bins)) for w in (gs, hs, None))
                    gain = cg**2 / (ch + self.ridge) + (cg[-1] - cg) ** 2 / (ch[-1] - ch + self.ridge) - whole
                    gain[(cn < self.least_rows) | (cn[-1] - cn < self.least_rows)] = 0
                    s = int(np.argmax(gain))
                    if gain[s] > best:
                        best, tree[node] = gain[s], (j, s, 0.0)
            j, s, _ = tree[node]
            at[rows] = 2 * node + 1 + (b[rows, j] > s if j >= 0 else 0)
        for leaf in range(2**self.depth - 1, len(tree)):
            rows = at == leaf
            tree[leaf] = (-1, 0, -self.rate * g[rows].sum() / (h[rows].sum() + self.ridge))
        return tree

    def _walk(self, tree: list[tuple[int, int, float]], b: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
        at, rows = np.zeros(len(b), int), np.arange(len(b))
        for _ in range(self.depth):
            j = feature[at]
            at = 2 * at + 1 + ((b[rows, np.maximum(j, 0)] > cut[at]) & (j >= 0))
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        if self.trees and len(x):
            b = self._binned(x)
            for tree in self.trees:
                score += self._walk(tree, b)
        return 1 / (1 + np.exp(-score))


@dataclass
class UrlModel:
    suffixes: SuffixStatistics
    trees: BoostedTrees

    @classmethod
    def fit(cls, urls: list[str | None], hosts: list[str], paths: list[str], blocked: np.ndarray) -> UrlModel:
        """Suffix statistics come from one half and the trees from the other, so that trees see honest rates."""
        half = np.arange(len(urls)) % 2 == 0
        pick = lambda values, keep: [v for v, k in zip(values, keep, strict=True) if k]
        suffixes = SuffixStatistics.fit(pick(hosts, half), blocked[half])
        x = features(pick(urls, ~half), pick(hosts, ~half), pick(paths, ~half), suffixes)
        return cls(suffixes, BoostedTrees().fit(x, blocked[~half].astype(float)))

    def predict(self, urls: list[str | None], hosts: list[str], paths: list[str]) -> np.ndarray:
        return self.trees.predict(features(urls, hosts, paths, self.suffixes))


def filter_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, sample_urls: int = SAMPLE_URLS, block_from: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict and score (the model's block probability; null where a rule decides).

    One scan with no shuffle, after a first narrow scan that gathers at most about `sample_urls`
    labelled urls, chosen by a hash of the id.
    """
    d = pages.select(F.col(id_column), F.col(url_column).alias("__url"))
    d = d.withColumns({"host": host_column(F.col("__url")), "path": path_column(F.col("__url"))})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    d = d.withColumns({"rule": rule, "__ruled": verdict})
    labelled = d.where(F.col("rule").isNotNull())
    n = labelled.count()
    got = labelled.where(hash_share(id_column, sample_urls / max(n, 1))).select(id_column, "__url", "host", "path", "__ruled").toPandas()
    got = got.sort_values([id_column, "__url"], kind="stable", na_position="first")
    model = UrlModel.fit(list(got["__url"]), list(got["host"]), list(got["path"]), (got["__ruled"] == "block").to_numpy())

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = {name: batch.column(name).to_pylist() for name in ("__url", "host", "path", "__ruled")}
        p = model.predict(c["__url"], c["host"], c["path"])
        said = [r or ("block" if x >= block_from else "allow") for r, x in zip(c["__ruled"], p, strict=True)]
        score = [None if r else float(x) for r, x in zip(c["__ruled"], p, strict=True)]
        return pa.record_batch(
            [batch.column(id_column), batch.column("host"), batch.column("path"), batch.column("rule"), pa.array(said, pa.string()), pa.array(score, pa.float64())],
            names=[id_column, "host", "path", "rule", "verdict", "score"],
        )

    kind = dict(pages.dtypes)[id_column]
    return map_rows(d, judge, f"{id_column} {kind}, host string, path string, rule string, verdict string, score double")
