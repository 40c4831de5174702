"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics cover the whole text and are made in one Arrow pass. The model is fitted on the driver
from at most ``MAX_TRAIN`` labelled rows (those whose doc_id hashes lowest, so the choice is stable
and spread evenly), and flattened into arrays that are walked for all trees of a batch at once.
What goes to the executors is the array form: trees * (2 ** (depth + 1) - 1) nodes.

Labels, lang, source and doc_id are no inputs. Labels of rows whose crc32(doc_id) mod 5 is 0 are
never read. Edge cases: null or empty texts have all-zero statistics and a score like any other;
null labels and null ids of labels are not learned from; a null doc_id counts as the empty text
(held out); repeated documents score alike and count once in the fit; with no labels of both kinds
the score is the share of label 1 (a half if there are none); empty tables give no rows; further
columns stay aside.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_TRAIN = 20_000
TREES, DEPTH, RATE, BINS, MIN_LEAF, L2 = 120, 4, 0.1, 64, 8, 1.0
FOLDS, THRESHOLD = 5, 0.3

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n", b".", b",", b"!?", b"#$%&*@~^+=_\\", b"|", b"<>{}[]()/", b"'\"`-:;", bytes(range(128, 256))]
_COUNT = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES):
    _COUNT[list(_chars), _k] = 1
_ALPHA = re.compile(rb"[A-Za-z\x80-\xff]")
N_STATISTICS = len(_CLASSES) + 16


def statistics(text: bytes) -> np.ndarray:
    """Shares of character classes, and shape, repetition and spread of words and lines."""
    out = np.zeros(N_STATISTICS)
    words = text.split()
    if not words:
        return out
    n = len(words)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[: len(_CLASSES)] = hist @ _COUNT / len(text)
    share = hist[hist > 0] / len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    low = text.lower().split()
    counts: dict[bytes, int] = {}
    for w in low:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    pairs = len(set(zip(low, low[1:], strict=False)))
    tail = [
        np.log1p(len(text)), np.log1p(n), lengths.mean(), lengths.std(), min(lengths.max(), 200),
        (lengths > 20).mean(), (lengths <= 2).mean(), -(share * np.log(share)).sum(),
        len(counts) / n, max(counts.values()) / n, pairs / max(1, n - 1),
        sum(w.isupper() for w in words) / n, sum(1 for w in words if not _ALPHA.search(w)) / n,
        np.log1p(len(lines)), len(seen) / len(lines), max(seen.values()) / len(lines),
    ]
    out[len(_CLASSES) :] = tail
    return out


def matrix(texts) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, N_STATISTICS))


class Trees:
    """All trees in flat arrays: node i of a tree has the children 2i + 1 and 2i + 2; a value goes
    left if it is at most the threshold; a leaf above the last level sends all values left."""

    def __init__(self, prior: float):
        self.prior, self.feature, self.threshold, self.value = prior, np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH))

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.prior)
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.prior + self.value[trees, node - (2**DEPTH - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss on binned statistics."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    model = Trees(float(np.log(share / (1 - share))))
    if len(y) < 2 * MIN_LEAF or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)], 1)  # value <= cuts[b] lies in bin b or before
    margin = np.full(len(y), model.prior)
    flat = binned + np.arange(x.shape[1]) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, x.shape[1] * BINS
            key = ((node - first)[:, None] * width + flat).ravel()
            shape = (2**level, x.shape[1], BINS)
            g, h, c = (np.bincount(key, weights=w, minlength=2**level * width).reshape(shape).cumsum(2) for w in (np.repeat(grad, x.shape[1]), np.repeat(hess, x.shape[1]), None))
            allg, allh, allc = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + L2) + (allg - g) ** 2 / (allh - h + L2) - allg**2 / (allh + L2)
            gain[(c < MIN_LEAF) | (allc - c < MIN_LEAF)] = -1
            best = gain.reshape(2**level, -1).argmax(1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), BINS)
                if gain[k, f, cut] > 1e-6 and cut < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + L2)
        margin += value[leaf]
        model.feature, model.threshold, model.value = np.vstack([model.feature, feature]), np.vstack([model.threshold, threshold]), np.vstack([model.value, value])
    return model


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(text: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in text])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Fit on at most ``max_train`` labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (common.crc_mod("doc_id", FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes("text").alias("t"))
    picked = own.join(F.broadcast(known), "doc_id")  # max_train rows of two numbers
    rows = picked.select("doc_id", "quality", statistics_of("t").alias("x")).groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("s")).orderBy("doc_id").collect()
    x = np.array([r.s.x for r in rows], float).reshape(-1, N_STATISTICS)
    return fit(x, np.array([r.s.quality for r in rows], float))


def score(model: Trees, text: Column | str) -> Column:
    @F.pandas_udf("double")
    def scored(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(t.tolist())))

    return scored(common.text_bytes(text))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, unchanged, whose score reaches the threshold."""
    model = train(common.narrow(docs), labels)
    return docs.filter(score(model, "text") >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.narrow(common.table(spark, sf_dir, "documents"))
    model = train(docs, common.table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (common.crc_mod("doc_id", FOLDS) == 0).alias("held_out"), score(model, "text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
