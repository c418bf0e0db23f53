"""URL filters: listed rules first, then logistic regression on hashed character n-grams.

The n-grams of the host and of the path are hashed apart, each into its own half of the features. The
model is fitted on a small labelled table of URLs and is one number a feature, so it
travels to the tasks as a vector of fixed size; URLs are read where they are and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ixlake.llm.common import mixed, slices

FEATURES = 1 << 16
GRAMS = (2, 3, 4)
SAMPLE = 4096  # labelled URLs of each verdict that the model is fitted on, at most
MOST_RULES = 1000
RIDGE = 1e-4
STEPS = 300
SEED = 11
_BEGIN, _END = 1, 2  # code points that stand for the two ends of a host or path


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query, longest wins.
RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty without ``://`` or for null."""
    begin = F.locate("://", url)
    rest = F.when(begin > 0, url.substr(begin + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The name of the longest rule that fits, and whether it allows; both null where none does.

    Of equally long rules the one listed first wins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; keep longer lists in a table and join by host")
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    # The longest is tested first, so it is the outermost condition.
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        allow = F.when(fits, rule.allow).otherwise(allow)
    return name, allow


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with both ends marked, and how many each text has."""
    raw = "".join(f"{chr(_BEGIN)}{x}{chr(_END)}" for x in texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4").astype(np.uint64), np.fromiter((len(x) + 2 for x in texts), np.int64, len(texts))


def _features(texts: list[str], tag: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every n-gram of every text."""
    points, sizes = _points(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # points up to the text's end
    rows, found = [], []
    for n in GRAMS:
        gram = np.full(len(points), tag * 16 + n, np.uint64)
        for step in range(n):
            gram = mixed(gram * np.uint64(0x9E3779B97F4A7C15) + np.roll(points, -step))
        whole = left >= n
        rows.append(owner[whole])
        found.append((gram[whole] % np.uint64(features // 2)).astype(np.int64) + tag * (features // 2))
    return np.concatenate(rows), np.concatenate(found)


def sparse_rows(hosts: list[str], paths: list[str], features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight): how often each URL has each feature, as a row of length 1."""
    parts = [_features(texts, tag, features) for tag, texts in enumerate((hosts, paths))]
    rows, found = (np.concatenate(column) for column in zip(*parts, strict=True))
    cells, counts = np.unique(rows * features + found, return_counts=True)
    rows, found = cells // features, cells % features
    norms = np.sqrt(np.bincount(rows, counts.astype(float) ** 2, len(hosts)))
    return rows, found, counts / norms[rows]


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The chance that a URL is allowed."""
        rows, found, values = sparse_rows(hosts, paths, len(self.weights))
        total = np.bincount(rows, values * self.weights[found], len(hosts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit(hosts: list[str], paths: list[str], allow: np.ndarray, features: int = FEATURES) -> UrlModel:
    """Logistic regression with a ridge; both verdicts weigh the same, however often each occurs.

    Accelerated gradient descent with a step that the data bound, so the result is the same in
    every run. Without any URL, or with one verdict only, no n-gram has a weight: the only verdict
    is given to all, and without a URL all are allowed.
    """
    weights = np.zeros(features)
    if not len(hosts) or allow.all() or not allow.any():
        return UrlModel(weights, 4.0 if not len(hosts) or allow.all() else -4.0)
    rows, found, values = sparse_rows(hosts, paths, features)
    own = np.where(allow, 0.5 / allow.sum(), 0.5 / (~allow).sum())
    # Rows are 1 long, and the bias is one more feature: the curvature is a quarter of 2 at most.
    step = 1 / (0.5 + RIDGE)
    ahead, bias_ahead, bias, momentum = weights.copy(), 0.0, 0.0, 1.0
    for _ in range(STEPS):
        total = np.bincount(rows, values * ahead[found], len(hosts)) + bias_ahead
        error = own * (1 / (1 + np.exp(-np.clip(total, -60, 60))) - allow)
        slope = np.bincount(found, values * error[rows], features) + RIDGE * ahead
        new, new_bias = ahead - step * slope, bias_ahead - step * error.sum()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - weights)
        bias_ahead = new_bias + (momentum - 1) / following * (new_bias - bias)
        weights, bias, momentum = new, new_bias, following
    return UrlModel(weights, float(bias))


def labelled_sample(labelled: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str, bool]]:
    """At most ``sample`` distinct (host, path, allow) of each verdict, by the order of a hash."""
    out = []
    for allow in (True, False):
        rows = labelled.where(F.col("allow") == allow).select("host", "path", "allow")
        order = [F.xxhash64("host", "path", F.lit(SEED)), "host", "path"]
        # Each task sends its first rows only; copies of a URL go before they are counted.
        out += [tuple(r) for r in rows.distinct().orderBy(*order).limit(sample).collect()]
    return out


def train(labelled: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> UrlModel:
    """The model of a table of (host, path, allow); rows with a null verdict do not count."""
    rows = labelled_sample(labelled, sample)
    return fit([r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], bool), features)


def _scored(model, names: list[str]):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "path", 1 << 20):
                score = model.value.scores(part.column("host").to_pylist(), part.column("path").to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(score)], [*names, "score"])

    return scored


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    labelled: DataFrame | None = None,
    sample: int = SAMPLE,
    features: int = FEATURES,
) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of (page_id, url).

    The host runs from the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path
    from there up to ``?``, ``#`` or the end. The longest rule that fits decides; it is null where none
    does, and there the model does: allow from a score of one half on.

    ``labelled`` is a table of (url, allow). Without one the URLs that rules decide on are the
    labelled ones. The model is fitted on at most ``sample`` distinct URLs of each verdict; every URL is judged.

    A null URL and one without ``://`` have an empty host and path, which no rule fits. Repeated rows are
    judged alike and all returned. Other columns are not read. Empty input gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, allow = first_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", name.alias("rule"), allow.alias("allow"))
    if labelled is None:
        examples = ruled.select("host", "path", "allow")
    else:
        examples = labelled.select(*[c.alias(n) for c, n in zip(url_parts(F.col("url")), ("host", "path"), strict=True)], "allow")
    # One number a feature: its size is a parameter and does not grow with the data.
    model = pages.sparkSession.sparkContext.broadcast(train(examples, sample, features))
    names = ["page_id", "host", "path", "rule", "allow"]
    scored = ruled.select(*names).mapInArrow(
        _scored(model, names), "page_id long, host string, path string, rule string, allow boolean, score double"
    )
    allowed = F.coalesce("allow", F.col("score") >= 0.5)
    return scored.select(
        "page_id", "host", "path", "rule", F.when(allowed, "allow").otherwise("block").alias("verdict"), "score"
    )
