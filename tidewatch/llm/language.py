"""Operator 11: language identification by words first and ever shorter character n-grams for unseen words.

A word that was learned scores its log frequency in each language. One that was not scores the mean log frequency of its
character n-grams, of the greatest length at which any of them was learned (the backoff of HeLI, Jauhiainen et al. 2016). A
text's language has the greatest sum over all of its words; the score is that language's share when sums are taken as log
likelihoods.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import scope, slices, written

SAMPLE_ROWS = 1_000
BROADCAST_ROWS = 10_000
LONGEST = 5
UNKNOWN = "und"
_PLAIN = re.compile("[a-z]+")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PIECE = 1 << 20


def words(text: str | None) -> Counter[str]:
    """Runs of letters of a whole text, in lower case, with their numbers; a long text is read piece by piece."""
    found: Counter[str] = Counter()
    text, at = text or "", 0
    while at < len(text):
        end = text.find(" ", at + _PIECE) if len(text) - at > _PIECE else -1
        piece = text[at : end if end >= 0 else len(text)]
        at += len(piece) or 1
        piece = piece.lower()
        found.update(_PLAIN.findall(piece) if piece.isascii() else _LETTERS.findall(unicodedata.normalize("NFC", piece)))
    return found


@dataclass
class Languages:
    """Log frequencies of words and n-grams: a row of `table` for each, a column for each of `names`."""

    names: list[str] = field(default_factory=list)
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def unseen(self, words: list[str]) -> np.ndarray:
        """The figures of words that were not learned, a row each; zeros where no n-gram of a word was."""
        get, rows, starts = self.grams.get, [], []
        blank = len(self.table)
        for word in words:
            starts.append(len(rows))
            padded = f" {word} "
            for n in range(min(LONGEST, len(padded)), 0, -1):
                have = [r for i in range(len(padded) - n + 1) if (r := get(padded[i : i + n])) is not None]
                if have:
                    rows += have
                    break
            else:
                rows.append(blank)
        if not rows:
            return np.zeros((0, len(self.names)))
        figures = np.vstack((self.table, np.zeros((1, len(self.names)))))[rows]
        return np.add.reduceat(figures, starts) / np.diff(starts, append=len(rows))[:, None]


class _Index(dict):
    """Rows of words; a new word gets the next row."""

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        return row


class Judge:
    """Scores texts; keeps the figures of the unseen words of some slices of texts, until they are more than `most`."""

    def __init__(self, model: Languages, most: int = 1 << 18):
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        # rows of words in the order in which they were learned, then unseen words
        self.rows = _Index({w: i for i, w in enumerate(self.model.words)})
        self.figures = self.model.table[[*self.model.words.values()]]

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        names = self.model.names
        if not names:
            return [(UNKNOWN, 0.0)] * len(texts)
        rows, numbers, sizes = [], [], []
        before = len(self.rows)
        for text in texts:
            found = words(text)
            rows.extend(map(self.rows.__getitem__, found))
            numbers.extend(found.values())
            sizes.append(len(found))
        self.figures = np.vstack((self.figures, self.model.unseen([*itertools.islice(self.rows, before, None)])))
        weighed = self.figures[rows] * np.array(numbers, float)[:, None]
        if len(self.rows) > len(self.model.words) + self.most:
            self._clear()
        out, at = [], 0
        for size in sizes:
            if not size:
                out.append((UNKNOWN, 0.0))
                continue
            total = weighed[at : at + size].sum(axis=0)
            at += size
            best = int(total.argmax())  # the first of equals, so the least name
            out.append((names[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def held_out(id_col: str = "doc_id"):
    """Ids whose crc32 as text leaves 2 modulo 4; a null id is not held out, but nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(text, lang): all documents of a language that are not held out, or about `rows` of them if there are more; of equal rows one is given.

    A document is picked if a hash of its id and text falls in the share of its language, so no text is shuffled before it is
    picked and a language with most of the documents makes no long partition. The shares, a row a language, are broadcast
    only if they are at most BROADCAST_ROWS.
    """
    known = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    shares = written(known.groupBy("lang").agg((F.lit(float(rows)) / F.count("*")).alias("share")), "language-shares")
    if shares.count() <= BROADCAST_ROWS:
        shares = F.broadcast(shares)
    place = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) * 2.0**-53  # even over 0 to 1
    return known.filter("text IS NOT NULL").join(shares, "lang").filter(place < F.col("share")).groupBy("id", "lang", "text").agg(F.lit(1)).select("text", "lang")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, item, n): words of this task's rows (text, lang)."""
    found: dict[str, Counter[str]] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            found.setdefault(lang, Counter()).update(words(text.as_py()))
    for lang, tally in found.items():
        items = [*tally.items()]
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            columns = [pa.array([lang] * len(part)), pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "item", "n"])


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, least: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Figures of each language from all, or about `rows`, documents of it; held-out rows and rows with a null id, text or language don't count.

    Words and n-grams are counted in Spark; those of the sample seen at least `least` times in all reach the driver. No
    usable row gives a model that knows no language.
    """
    with scope(docs.sparkSession):
        sample = training_rows(docs, rows, id_col, text_col, lang_col)
        counted = written(sample.mapInArrow(_tally, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")), "language-words")
        padded = F.concat(F.lit(" "), "item", F.lit(" "))
        size = F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("padded"))))
        sized = counted.select("lang", "n", padded.alias("padded")).withColumn("size", size)
        at = F.explode(F.sequence(F.lit(1), F.length("padded") - F.col("size") + 1))
        grams = sized.withColumn("at", at).select("lang", F.col("size"), F.expr("substring(padded, at, size)").alias("item"), "n").filter("item <> ' '")
        items = counted.withColumn("size", F.lit(0)).unionByName(grams.groupBy("lang", "size", "item").agg(F.sum("n").alias("n")))
        known = items.groupBy("size", "item").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("n")).filter(F.col("n") >= least)
        found = known.orderBy("size", "item").select("size", "item", "by").toArrow()
    by = found["by"].combine_chunks()
    lang, n = by.flatten().field("lang").to_pylist(), by.flatten().field("n").to_numpy()
    names = sorted({*lang})
    column = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(found), len(names)))
    counts[np.repeat(np.arange(len(found)), by.value_lengths().to_numpy()), [column[x] for x in lang]] = n
    sizes, table = found["size"].to_numpy(), np.zeros_like(counts)
    for size in np.unique(sizes):
        own = sizes == size
        table[own] = np.log((counts[own] + 0.5) / (counts[own].sum(axis=0) + 0.5 * own.sum()))
    items, first = found["item"].to_pylist(), int((sizes == 0).sum())  # words come first
    return Languages(names, {w: i for i, w in enumerate(items[:first])}, {g: first + i for i, g in enumerate(items[first:])}, table)


def with_language(docs: DataFrame, model: Languages, text_col: str = "text", out: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with columns `out` and `score`, of each whole text.

    A text that is null, empty or without letters gets `und` and 0; so does any if the model knows no language. A text with
    letters but no known word or n-gram ties all languages: the least name, and an equal share. Repeated rows score alike, an
    empty table stays empty, columns named like the two give way.
    """
    docs = docs.drop(out, score)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for a, b in slices(lengths, 1 << 22):
                part = batch.slice(a, b - a)
                found = judge(part.column(at).to_pylist())
                more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, out, score])

    return docs.mapInArrow(run, schema)
