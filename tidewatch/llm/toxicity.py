"""Operator 10: toxicity by a weighted lexicon and Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts, digits and signs that stand for
letters, invisible characters out, letters written one by one joined, everything else to blanks. A text with accents is read
once with and once without them. The lexicon's terms are whole words or word beginnings with a weight, its exceptions are
two-word phrases in which a term is harmless. Both are learned from labels: a term's weight is the lower limit of its log
odds between toxic and other documents. A text's score is a logistic function of the weights found, outside exceptions,
normalised by its length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import slices

SAMPLE_ROWS = 20_000
PREFIXES = range(3, 9)

# Letters that look like Latin ones, what stands for letters, and what can't be seen.
LOOK_ALIKE = dict(zip("абсԁеһіјκӏмпорԛѕтυνѡхуαεικοντρχ", "abcdehijklmnopqstuvwxyaeikovtpx"))
STANDS_FOR = dict(zip("0134579", "oieastg"))
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_TABLE = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord(k): v for k, v in (LOOK_ALIKE | STANDS_FOR).items()}
_SIGN = re.compile(r"[@$](?=[a-z])|(?<=[a-z])[!|](?=[a-z0-9])")
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
_SPACED = re.compile(r"(?<= )(?:[^\W_] ){2,}[^\W_](?= )")


def fold(text: str | None) -> str:
    """A text as the lexicon sees it, between blanks."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), f" {text.translate(_TABLE)} ")


def unaccented(folded: str) -> str:
    """A folded text without accents; itself if it has none."""
    if folded.isascii():
        return folded
    return "".join(c for c in unicodedata.normalize("NFD", folded) if not unicodedata.combining(c))


@dataclass
class Lexicon:
    """terms: {' word ' or ' beginning': weight}; exceptions: ' two words '; a and b: the logistic function."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    a: float = -4.0
    b: float = 4.0

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for e in self.exceptions:
            auto.add_word(e, (len(e), None))
        for t, w in self.terms.items():
            if t not in auto:
                auto.add_word(t, (len(t), w))
        if len(auto):
            auto.make_automaton()
        return auto

    def found(self, folded: str, auto) -> float:
        """Sum of the weights of the terms that stand outside exceptions."""
        if not len(auto):
            return 0.0
        hits, spared = [], []
        for end, (n, weight) in auto.iter(folded):
            (spared if weight is None else hits).append((end - n + 1, end, weight))
        if spared:
            hits = [h for h in hits if not any(s <= h[0] and h[1] <= e for s, e, _ in spared)]
        heaviest: dict[int, float] = {}
        for start, _, weight in hits:  # a word counts once, by its heaviest term
            heaviest[start] = max(weight, heaviest.get(start, 0.0))
        return sum(heaviest.values())

    def density(self, folded: str, auto) -> float:
        found, plain = self.found(folded, auto), unaccented(folded)
        if plain != folded:
            found = max(found, self.found(plain, auto))
        return found / (1 + math.log1p(folded.count(" ")))

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a + self.b * math.log1p(density)))))


def _features(folded: str) -> set[str]:
    words = {*folded.split()}
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) >= n}


def _tally(batches: Iterator[pa.RecordBatch], items_of) -> Iterator[pa.RecordBatch]:
    """(item, bad, good): documents of either kind that have an item, for the items of this task's rows (text, label)."""
    tallies = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tallies[int(label)].update(items_of(fold(text)))
    items = [*(tallies[0].keys() | tallies[1].keys())]
    for at in range(0, len(items), 50_000):
        part = items[at : at + 50_000]
        counts = [pa.array([t[i] for i in part], pa.int64()) for t in (tallies[1], tallies[0])]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *counts], names=["item", "bad", "good"])


def _phrases(terms: list[str]):
    """The two-word phrases of a folded text in which a term stands."""
    beginnings = tuple(t[1:] for t in terms)

    def of(folded: str) -> set[str]:
        words = folded.split()
        at = [i for i, w in enumerate(words) if f"{w} ".startswith(beginnings)]
        return {f" {words[i - 1]} {words[i]} " for i in at if i} | {f" {words[i]} {words[i + 1]} " for i in at if i + 1 < len(words)}

    return of


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most `rows` labelled documents that are not held out, picked by a hash of the id.

    Held out are ids whose crc32 as text leaves 0 modulo 5. Ids and labels only are sampled, so the side
    that is broadcast has at most `rows` rows. Rows with a null id or label don't count.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", label)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, lift: float = 2.0, z: float = 1.64, least: int = 4) -> Lexicon:
    """A lexicon from labels.toxic of at most `rows` labelled documents: terms of toxic documents, and phrases that only others have.

    A term is taken in if `least` toxic documents have it and the lower limit of its log odds, `z` standard errors under the
    smoothed value, reaches `lift`, however rare it is among them. What reaches the driver is bounded by the sample.
    No usable labels, or labels of one kind, give an empty lexicon.
    """
    sample = training_rows(docs, labels, "toxic", rows).cache()
    try:
        kinds = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        bad, good = kinds.get(1, 0), kinds.get(0, 0)
        if not bad or not good:
            return Lexicon()

        def tallied(items_of) -> DataFrame:
            counts = sample.mapInArrow(lambda batches: _tally(batches, items_of), "item string, bad long, good long")
            return counts.groupBy("item").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

        odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
        error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
        found = tallied(_features).filter(F.col("bad") >= least).withColumn("low", odds - z * error).filter(F.col("low") >= lift).select("item", "bad", "low").collect()
        have = {r["item"]: r["bad"] for r in found if not r["item"].endswith(" ")}
        # a beginning that stands for little but one longer beginning leaves the word to that
        vague = {item[:n] for item, n_bad in have.items() for n in range(2, len(item)) if n_bad >= 0.95 * have.get(item[:n], math.inf)}
        terms: dict[str, float] = {}
        for item, _, low in sorted(found, key=lambda r: (len(r["item"].strip()), r["item"])):
            if item in vague:
                continue
            # a longer term says more than its beginning only if it weighs clearly more
            if low > max((terms.get(item[:n], -1.0) for n in range(2, len(item))), default=-1.0) + 0.5:
                terms[item] = low
        exceptions = []
        if terms:
            exceptions = sorted(r["item"] for r in tallied(_phrases([*terms])).filter("good >= 3 AND bad = 0").select("item").collect())
        lexicon = Lexicon(terms, exceptions)

        def densities(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            auto = lexicon.automaton()
            for pdf in frames:
                yield pd.DataFrame({"x": [math.log1p(lexicon.density(fold(t), auto)) for t in pdf["text"]], "y": pdf["toxic"].astype(float)})

        data = sample.mapInPandas(densities, "x double, y double").toPandas()  # at most `rows` pairs of numbers
        lexicon.a, lexicon.b = logistic(data["x"].to_numpy(), data["y"].to_numpy())
        return lexicon
    finally:
        sample.unpersist()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a small ridge so that separable classes settle."""
    z, w = np.column_stack((np.ones(len(x)), x)), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def with_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with column `out`: 0 to 1, of the whole text; null and empty texts have the score of no finding."""
    docs = docs.drop(out)  # a column of that name gives way
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for batch in batches:
            texts = batch.column(at)
            for a, b in slices([len(t) if (t := x.as_py()) else 0 for x in texts], 1 << 22):
                part = batch.slice(a, b - a)
                scores = [lexicon.score(lexicon.density(fold(t), auto)) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, out])

    return docs.mapInArrow(run, schema)
