"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), so all pairwise
interactions cost time linear in the number of features.

Fitting uses at most ``train_rows`` labelled documents outside the held-out fold (a bounded sample in the
order of a hash of the id); only their features, never texts, come to the driver. Scoring is a
map-only pass over every whole text.

Defined cases: null text counts as empty and is scored by its statistics; labels that are null are
ignored, repeated labels of an id count once (the largest); without labels of both classes every score
is the share of label 1 (0.5 if there are none). The metadata is ``n_chars``; where a table has none, or no
number in it, it has a value of its own. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from math import log1p, sqrt
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

TRAIN_ROWS = 12_000
THRESHOLD = 0.3
WORD_BUCKETS = 1 << 14
FACTORS = 8
BINS = 16
MARKS = "|*#$%&!.,<>{}_=@"
COLUMNS = 16 + len(MARKS)
_CACHE: dict[str, int] = {}


def _bucket(word: str) -> int:
    b = crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS
    if len(_CACHE) < 100_000:
        _CACHE[word] = b
    return b


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    n, size = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    half = words[len(words) // 2 :]
    return [
        log1p(len(text)),
        log1p(len(words)),
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isupper, half)) / n,
        size / n,
        max(map(len, words), default=0),
        len(set(lines)) / len(lines),
        len(lines) / n,
        len(text.encode("utf-8", "surrogatepass")) / size,
        sum(text.count(d) for d in "0123456789") / size,
        *[text.count(m) / size for m in MARKS],
    ]


def features(text: str | None, n_chars: float | None = None) -> tuple[np.ndarray, list[float]]:
    """Buckets of the distinct words, and the statistics with the metadata (the recorded size; none: -1) after them."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    get = _CACHE.get
    buckets = [b if (b := get(w)) is not None else _bucket(w) for w in counts]
    size = -1.0 if n_chars is None or not n_chars >= 0 else log1p(n_chars)
    return np.unique(np.array(buckets, np.int32)), [*statistics(text, words, counts), size]


class Model:
    """Weights, factors and the statistics' bin edges."""

    def __init__(self, edges: np.ndarray, base: float = 0.0):
        self.edges = edges
        rng = np.random.default_rng(7)
        self.missing = WORD_BUCKETS + edges.shape[0] * BINS  # the feature of a row without a recorded size
        self.w0, self.w, self.v = base, np.zeros(self.missing + 1), rng.normal(0, 0.02, (self.missing + 1, FACTORS))
        self.v[self.missing] = 0

    def rows(self, stats: np.ndarray) -> np.ndarray:
        """Feature numbers of the binned statistics, one column each."""
        out = np.empty(stats.shape, np.int64)
        for j, e in enumerate(self.edges):
            out[:, j] = WORD_BUCKETS + j * BINS + np.searchsorted(e, stats[:, j], "right")
        out[stats[:, -1] < 0, -1] = self.missing
        return out

    def flat(self, buckets: list[np.ndarray], stats: np.ndarray):
        """All rows' feature numbers and values in one array, with the rows' starts."""
        binned = self.rows(stats)
        sizes = np.array([len(b) for b in buckets]) + binned.shape[1]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ids = np.concatenate([x for b, r in zip(buckets, binned) for x in (b, r)])
        row = np.repeat(np.arange(len(sizes)), sizes)
        words = ids < WORD_BUCKETS
        values = np.where(words, 1 / np.sqrt(np.maximum(1, sizes - binned.shape[1]))[row], 1 / sqrt(binned.shape[1]))
        return ids, values, row, starts

    def raw(self, ids, values, starts):
        vx = self.v[ids] * values[:, None]
        s = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[ids] * values, starts) + 0.5 * ((s * s).sum(1) - squares), s, vx

    def score(self, buckets: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        if not buckets:
            return np.zeros(0)
        ids, values, _, starts = self.flat(buckets, stats)
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, values, starts)[0], -35, 35)))


def fit(buckets: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.03, least_steps: int = 400) -> Model:
    """Minibatch Adam on the logistic loss, at least ``least_steps`` batches."""
    share = float(labels.mean()) if len(labels) else 0.5
    base = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    count = COLUMNS
    grid = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(stats, grid, axis=0).T if len(stats) else np.zeros((count, BINS - 1))
    model = Model(edges, base)
    if not 0 < share < 1 or not len(labels):
        model.v[:] = 0
        return model
    rng = np.random.default_rng(11)
    epochs = max(epochs, -(-least_steps // -(-len(labels) // 256)))
    params = {"w": model.w, "v": model.v}
    moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in params.items()}
    step = 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            ids, values, row, starts = model.flat([buckets[i] for i in pick], stats[pick])
            raw, s, vx = model.raw(ids, values, starts)
            g = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[pick]) / len(pick)
            model.w0 -= lr * g.sum()
            gx = g[row] * values
            size = len(model.w)
            grads = {
                "w": np.bincount(ids, gx, size) + 1e-5 * model.w,
                "v": np.stack([np.bincount(ids, gx * (s[row, f] - vx[:, f]), size) for f in range(FACTORS)], 1) + 1e-5 * model.v,
            }
            step += 1
            for k, p in params.items():
                m, u = moments[k]
                m += 0.1 * (grads[k] - m)
                u += 0.001 * (grads[k] ** 2 - u)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-8)
    return model


_FEATURES = T.StructType([T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("stats", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_FEATURES)
def _feature_columns(s: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features(x, n) for x, n in zip(s, sizes)], columns=["buckets", "stats"])


def _inputs(docs: DataFrame):
    """The text and the recorded size, null where a table has none."""
    size = F.expr("try_cast(n_chars AS double)") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return F.col("text").cast("string").alias("text"), size.alias("size")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` labelled documents that aren't held out."""
    sample = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    rows = (
        docs.select("doc_id", *_inputs(docs))
        .join(F.broadcast(sample), "doc_id")  # bounded by train_rows
        .select("doc_id", "quality", _feature_columns("text", "size").alias("f"))
        .select("doc_id", "quality", "f.*")
        .dropDuplicates(["doc_id"])
        .toPandas()
        .sort_values("doc_id")
    )
    buckets = [np.asarray(b, np.int32) for b in rows["buckets"]]
    stats = np.array(rows["stats"].tolist(), float).reshape(len(rows), COLUMNS)
    return fit(buckets, stats, rows["quality"].to_numpy(float))


def score_column(model: Model, docs: DataFrame):
    """The score of a table's rows."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # of fixed size, about 1 MB

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = pickle.loads(packed.value)
        for s, sizes in batches:
            out = np.empty(len(s))
            for at in range(0, len(s), 512):  # bounds the flat arrays
                got = [features(x, n) for x, n in zip(s.iloc[at : at + 512], sizes.iloc[at : at + 512])]
                out[at : at + 512] = own.score([g[0] for g in got], np.array([g[1] for g in got], float))
            yield pd.Series(out)

    return score(*_inputs(docs))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = train(docs, labels, train_rows)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with their own columns."""
    model = train(docs, labels, train_rows)
    return docs.where(score_column(model, docs) >= threshold)
