"""Operator 7: document quality by Bradley-Terry pairwise ranking.

The probability that document i is better than j is a logistic function of w . (x_i - x_j), where x are
features of the text. w is learned from preference pairs: a document labelled 1 is preferred to one labelled 0.
Documents are then kept by a quantile of the scores; a second, one-dimensional fit turns scores to
probabilities of label 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.toxicity import logistic, training_rows

SAMPLE_ROWS = 10_000

FEATURES = (
    "log_words", "letters", "upper", "digits", "marks", "signs", "other", "word_length", "long_words", "distinct_words",
    "common_word", "ending_signs", "stops", "distinct_lines", "distinct_pairs", "case_starts",
)
_SIGNS = b"#$%&*+<=>@[\\]^_`{|}~!"


def features(text: str | None) -> list[float]:
    """Figures of a text's form, by FEATURES; none depends on the language's words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total = max(1, len(raw))
    upper, lower, high = byte[65:91].sum(), byte[97:123].sum(), byte[128:].sum()
    letters = upper + lower + high
    signs = byte[[*_SIGNS]].sum()
    marks = byte[[*b".,;:?'\"()-/"]].sum()
    tally = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        np.log1p(len(words)),
        letters / total,
        np.sqrt(upper / max(1, letters)),
        np.sqrt(byte[48:58].sum() / total),
        np.sqrt(marks / total),
        np.sqrt(signs / total),
        np.sqrt((total - letters - signs - marks - byte[48:58].sum() - byte[32] - byte[9:14].sum()) / total),
        min(2.0, letters / n / 10),
        np.sqrt(sum(len(w) > 20 for w in tally) / max(1, len(tally))),
        min(1.0, len(tally) / n**0.8),
        np.sqrt(tally.most_common(1)[0][1] / n) if words else 0.0,
        np.sqrt(sum(c for w, c in tally.items() if w[-1] in _SIGNS) / n),
        np.sqrt(byte[46] / n),
        len({*lines}) / max(1, len(lines)),
        min(1.0, len({*zip(words, words[1:])}) / n),
        np.sqrt(sum(c for w, c in tally.items() if 65 <= w[0] <= 90) / n),
    ]


@dataclass
class Ranker:
    """Weights for standardised features, and the function from scores to probabilities."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    a: float = 0.0
    b: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.column_stack((z, z * z)) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * self.raw(x), -30, 30)))


def pair_moments(good: np.ndarray, bad: np.ndarray, w: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss over the differences of all (good, bad) pairs, a block of rows at a time."""
    g, b = good @ w, bad @ w
    k = good.shape[1]
    slope, curve, miss_bad, weigh_bad = np.zeros(k), np.zeros((k, k)), np.zeros(len(bad)), np.zeros(len(bad))
    for at in range(0, len(good), block):
        own = good[at : at + block]
        p = 1 / (1 + np.exp(-np.clip(g[at : at + block, None] - b, -30, 30)))
        miss, weight = 1 - p, p * (1 - p)
        slope += miss.sum(axis=1) @ own
        miss_bad += miss.sum(axis=0)
        weigh_bad += weight.sum(axis=0)
        cross = own.T @ (weight @ bad)
        curve += (own.T * weight.sum(axis=1)) @ own - cross - cross.T
    return slope - miss_bad @ bad, curve + (bad.T * weigh_bad) @ bad


def bradley_terry(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> Ranker:
    """Weights by Newton's method on the logistic loss of feature differences, over all (label 1, label 0) pairs.

    `ridge` is a share of the number of pairs. Labels of one kind give a ranker that scores everything alike.
    """
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -4, 4)
    z = np.column_stack((z, z * z))
    good, bad = z[y == 1], z[y == 0]
    if not len(good) or not len(bad):
        return Ranker(mean, scale, np.zeros(z.shape[1]), 5.0 if len(good) else -5.0, 0.0)
    w, pairs = np.zeros(z.shape[1]), len(good) * len(bad)
    for _ in range(40):
        slope, curve = pair_moments(good, bad, w)
        step = np.linalg.solve(curve / pairs + ridge * np.eye(len(w)), slope / pairs - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-4:
            break
    ranker = Ranker(mean, scale, w)
    ranker.a, ranker.b = logistic(ranker.raw(x), y.astype(float))
    return ranker


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ranker:
    """A ranker from labels.quality; figures of at most `rows` labelled, not held-out documents reach the driver, which fits all their pairs."""
    sample = training_rows(docs, labels, "quality", rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"x": [features(t) for t in pdf["text"]], "y": pdf["quality"].astype(float)})

    data = sample.mapInPandas(run, "x array<double>, y double").toPandas()
    if not len(data):
        return Ranker(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(2 * len(FEATURES)))
    return bradley_terry(np.stack(data["x"].to_numpy()), data["y"].to_numpy())


def with_quality(docs: DataFrame, ranker: Ranker, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with column `out`: the probability of label 1, of the whole text.

    Null and empty texts are scored as empty; repeated rows score alike; an empty table stays empty.
    """
    docs = docs.drop(out)  # a column of that name gives way
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranker.score(x))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def keep_best(scored: DataFrame, share: float, col: str = "quality_score", accuracy: int = 10_000) -> DataFrame:
    """The rows at or above the quantile of the scores that leaves about `share` of them; ties stay together."""
    cut = scored.agg(F.percentile_approx(col, 1 - share, accuracy).alias("q")).first()["q"]
    return scored if cut is None else scored.filter(F.col(col) >= cut)
