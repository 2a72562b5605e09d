"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document becomes some twenty statistics of its whole text. Random Fourier features
approximate a Gaussian kernel over them (standardised, beside the statistics themselves);
each task adds up its part of the normal equations, apart for each of FOLDS folds, so the
driver solves one small system from sums. Scores of each fold by the model of the other
folds are calibrated by isotonic regression over BINS bins; the final model uses all folds.

Defined results: null text counts as empty and gets the score of its statistics like any
other; labels other than 0 and 1, and labels without a document, are left out; several
labels of one document each count; with fewer than two classes every score is their mean
(0.5 without labels). Other columns, names that clash among them, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, summed

FEATURES = 128
FOLDS = 4
BINS = 1000
RIDGE = 1.0
#: Score at and above which a document passes.
PASS = 0.3

_GROUPS = [
    ("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", (32, 9)), ("line", (10, 13)),
    ("stop", b".,;:"), ("loud", b"!?"), ("bar", b"|/\\_-+=~"), ("sign", b"#$%&*@^"), ("bracket", b"()[]{}<>\"'`"), ("high", range(128, 256)),
]
_CLASS = np.zeros((256, len(_GROUPS)))
for _k, (_, _codes) in enumerate(_GROUPS):
    _CLASS[list(_codes), _k] = 1
N_STATS = len(_GROUPS) + 12


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one text."""
    text = text or ""
    raw = text.encode()
    size = len(raw)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / max(1, size)
    words = text.split()
    n = len(words)
    kinds = set(words)
    lines = text.split("\n")
    pairs = list(zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    return np.array([
        *shares,
        np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(), (lengths <= 3).mean(),
        np.log1p(len(kinds)), np.log1p(len(kinds)) / max(1e-9, np.log1p(n)), sum(a == b for a, b in pairs) / max(1, n),
        len(set(pairs)) / max(1, len(pairs)), len(set(lines)) / len(lines), np.log1p(size / len(lines)), len(set(raw)) / 64,
    ])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts])


@dataclass
class Model:
    """Centres and scales of the statistics, frequencies and phases, weights, and calibration knots."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -4, 4)
        return np.hstack([np.ones((len(x), 1)), x / np.sqrt(x.shape[1]), np.cos(x @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rising sequence nearest ``value`` in weighted squares, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist()):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def _solve(sums: np.ndarray, d: int) -> np.ndarray:
    gram, target = sums[: d * d].reshape(d, d), sums[d * d :]
    penalty = np.full(d, RIDGE)
    penalty[0] = 1e-6
    return np.linalg.solve(gram + np.diag(penalty), target)


def fit(train: DataFrame, seed: int = 0) -> Model:
    """From (stats array<double>, label 0/1, fold int in 0..FOLDS-1)."""
    parts = [F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(N_STATS)] + [F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATS)]
    m = train.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"), *parts).first()
    rng = np.random.default_rng(seed)
    frequency, phase = rng.normal(0, 1.5 / np.sqrt(N_STATS), (N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    d = 1 + N_STATS + FEATURES
    if not m["n"] or m["rate"] in (0.0, 1.0):
        level = 0.5 if not m["n"] else float(m["rate"])
        return Model(np.zeros(N_STATS), np.ones(N_STATS), frequency, phase, np.zeros(d), np.zeros(2), np.full(2, level))
    scale = np.array([m[f"s{i}"] for i in range(N_STATS)])
    model = Model(np.array([m[f"m{i}"] for i in range(N_STATS)]), np.where(scale > 1e-9, scale, 1.0), frequency, phase, np.zeros(d), np.zeros(2), np.zeros(2))

    def equations(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in rows:
            z = model.features(np.vstack(pdf["stats"].to_numpy()))
            y, fold = pdf["label"].to_numpy(float), pdf["fold"].to_numpy()
            for k in np.unique(fold).tolist():
                a, b = z[fold == k], y[fold == k]
                part = np.concatenate([(a.T @ a).ravel(), a.T @ b])
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield pd.DataFrame({"fold": list(sums), "sums": [s.tobytes() for s in sums.values()]})

    sums = summed(train.mapInPandas(equations, "fold int, sums binary"), "fold", "sums")
    total = sum(sums.values())
    model.weight = _solve(total, d)
    others = {k: _solve(total - s, d) if len(sums) > 1 else model.weight for k, s in sums.items()}

    def out_of_fold(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            z = model.features(np.vstack(pdf["stats"].to_numpy()))
            w = np.stack([others[k] for k in pdf["fold"]])
            yield pd.DataFrame({"bin": np.clip(np.floor(np.einsum("ij,ij->i", z, w) * BINS), -BINS, 2 * BINS).astype(int), "label": pdf["label"]})

    bins = train.mapInPandas(out_of_fold, "bin int, label int").groupBy("bin").agg(F.avg("label").alias("rate"), F.count(F.lit(1)).alias("n"))
    found = bins.toPandas().sort_values("bin")
    model.knots = (found["bin"].to_numpy() + 0.5) / BINS
    model.levels = isotonic(found["rate"].to_numpy(float), found["n"].to_numpy(float))
    return model


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(stats, label, fold) of the labelled documents outside the held-out fifth; ``stats`` has (doc_id, stats)."""
    good = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label"))
    kept = stats.where(crc_mod(F.col("doc_id"), 5) != 0)
    fold = (crc_mod(F.col("doc_id"), 5) - 1).cast("int")
    return kept.join(good, kept["doc_id"] == good["label_id"]).select("stats", "label", fold.alias("fold"))


def scorer(model: Model):
    """Score from a column of statistics."""

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(stats.to_numpy())) if len(stats) else [], dtype=float)

    return score


def text_scorer(model: Model):
    """Score from a column of texts."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return score


def text_statistics(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", statistics_of("text").alias("stats"))


def passing(score: Column) -> Column:
    return (score >= PASS).cast("int")
