"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams (1 to N, lower case, hashed to
BINS bins) that both contain, over the root of the product of their counts: the blended
spectrum by presence. LANDMARKS texts of each language span the Nyström features of every
text; one-versus-rest kernel ridge regression over them is fit from sums of partitions, on
at most ROWS different texts of each language, those with the least hash of id and text.
Scores are products of a batch's presence matrix with the landmarks'. Presence says little
of a very long text, so features are the mean over its pieces of PIECE characters.

Defined results: null text, or text without a letter, is ``und`` with score 1; with no
labelled text at all every other text is ``und`` with score 0; ties go to the language
first by code point; null and repeated ids are drawn by their texts, and a text that a
language has under one id many times is drawn once. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import summed

N = 4
BINS = 1 << 14
LANDMARKS = 32
ROWS = 1500
RIDGE = 0.3
SHARP = 6.0
TEXTS = 128
PIECE = 8192


def presence(texts: list[str]) -> np.ndarray:
    """One row of 0 and 1 over the bins for each text."""
    out = np.zeros((len(texts), BINS), np.float32)
    for row, text in zip(out, texts):
        code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        gram = np.zeros(len(code), np.uint64)
        for n in range(1, N + 1):
            if len(code) < n:
                break
            gram = gram[: len(code) - n + 1] * np.uint64(1_000_003) + code[n - 1 :] + np.uint64(n)
            row[(gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)).astype(np.int64)] = 1
    return out


class Kernel:
    """Nyström features by landmarks."""

    def __init__(self, texts: list[str]):
        marks = presence(texts)
        self.used = np.flatnonzero(marks.any(0))
        self.marks = np.ascontiguousarray(marks[:, self.used].T)
        self.size = np.sqrt(marks.sum(1))
        own = marks @ marks.T / np.outer(self.size, self.size)
        value, vector = np.linalg.eigh(own.astype(float))
        good = value > 1e-6
        self.root = vector[:, good] / np.sqrt(value[good])

    def features(self, texts: list[str]) -> np.ndarray:
        owner = np.repeat(np.arange(len(texts)), [max(1, -(-len(t) // PIECE)) for t in texts])
        pieces = [t[at : at + PIECE] for t in texts for at in range(0, max(1, len(t)), PIECE)]
        sums = np.zeros((len(texts), self.root.shape[1]))
        for at in range(0, len(pieces), TEXTS):
            p = presence(pieces[at : at + TEXTS])
            k = p[:, self.used] @ self.marks / np.outer(np.sqrt(np.maximum(1, p.sum(1))), self.size)
            np.add.at(sums, owner[at : at + TEXTS], k @ self.root)
        return np.hstack([np.ones((len(texts), 1)), sums / np.bincount(owner, minlength=len(texts))[:, None]])


class Model:
    def __init__(self, kernel: Kernel | None, languages: list[str], weight: np.ndarray):
        self.kernel, self.languages, self.weight = kernel, languages, weight

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = [], np.zeros(len(texts))
        for at in range(0, len(texts), TEXTS):
            part = texts[at : at + TEXTS]
            lettered = [t is not None and any(map(str.isalpha, t)) for t in part]
            if self.kernel is None:
                lang += ["und"] * len(part)
                score[at : at + TEXTS] = [float(not x) for x in lettered]
                continue
            f = self.kernel.features([t or "" for t in part]) @ self.weight * SHARP
            p = np.exp(f - f.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            lang += [self.languages[b] if x else "und" for b, x in zip(best.tolist(), lettered)]
            score[at : at + TEXTS] = np.where(lettered, p.max(1), 1.0)
        return lang, score


def fit(labelled: DataFrame) -> Model:
    """From (doc_id, text, lang); rows with null text or lang teach nothing."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text"))
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    if not counts:
        return Model(None, [], np.zeros((0, 0)))
    languages = sorted(counts)
    share = F.pmod("hash", F.lit(1 << 40)) / float(1 << 40)

    def drawn(most: int) -> DataFrame:
        """Texts with the least hashes of each language, ``most`` of them; the first filter leaves about twice as many."""
        keep = F.lit(False)
        for lang, n in counts.items():
            keep = F.when(F.col("lang") == lang, share < 2 * (most + 20) / n).otherwise(keep)
        turn = F.row_number().over(Window.partitionBy("lang").orderBy("share", "hash"))
        some = rows.where(keep).withColumn("share", share).dropDuplicates(["lang", "hash"])
        return some.withColumn("turn", turn).where(F.col("turn") <= most).select("hash", "text", "lang")

    marks = sorted((r["lang"], r["hash"], r["text"]) for r in drawn(LANDMARKS).collect())
    if not marks:
        return Model(None, [], np.zeros((0, 0)))
    kernel = Kernel([t for *_, t in marks])
    d, m = 1 + kernel.root.shape[1], len(languages)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d * (d + m))
        for pdf in batches:
            for at in range(0, len(pdf), TEXTS):
                part = pdf.iloc[at : at + TEXTS]
                z = kernel.features(part["text"].tolist())
                y = np.where(part["lang"].to_numpy()[:, None] == np.array(languages), 1.0, -1.0)
                total += np.concatenate([(z.T @ z).ravel(), (z.T @ y).ravel()])
        yield pd.DataFrame({"k": [0], "sums": [total.tobytes()]})

    sums = summed(drawn(ROWS).select("text", "lang").mapInPandas(equations, "k int, sums binary"), "k", "sums")[0]
    gram, target = sums[: d * d].reshape(d, d), sums[d * d :].reshape(d, m)
    return Model(kernel, languages, np.linalg.solve(gram + RIDGE * np.eye(d), target))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lang, score = model.predict([t if isinstance(t, str) else None for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": score})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")
