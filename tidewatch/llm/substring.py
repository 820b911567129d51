"""Operator 1: substring dedup by repeated-phrase automata.

A phrase is `span` consecutive words. It goes wherever it also starts in a document with a smaller id.

1. Every phrase has a fingerprint: the least hash of the 5-word grams inside it. Equal phrases have
   equal fingerprints, and neighbours mostly share one, so there are far fewer than phrases. Spark counts
   them and keeps those that two documents have.
2. Every document is streamed once more and gives, for each recurring fingerprint, the stretch of words whose
   phrases have it. Equal stretches of a batch are one row, with the documents that have it in lists of at most MANY.
3. Distinct stretches go to shards by fingerprint, without their documents. A shard confirms the passages that recur
   (exactly, word by word) with the first document of each, compiles them into an Aho-Corasick automaton and streams its
   stretches through it to locate every passage. Where a stretch has any, Spark joins the documents that have the stretch;
   a stretch that very many share is a skewed join, which AQE splits, and no matter of one shard.
4. A fingerprint with more stretches than a shard is made for has no shard: its stretches are cut to their single
   phrases, which Spark counts and joins by the phrase itself.

A document is a row's id and text together (`doc`, a 64-bit print of both), so rows that repeat an id stay apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WordHasher, ascii_space, discard, grams, measured, mix, slices, sliding_min, written

GRAM = 5
CHUNK = 1 << 20
MANY = 64
BROADCAST_ROWS = 50_000
TELL, ASK, KNOWN = 0, 1, 2


def _phrases(texts: list[bytes], hasher: WordHasher, span: int):
    """(fingerprint and first word of each phrase, text of each phrase, word starts, ends, joined bytes)."""
    hashes, starts, ends, owner, joined = hasher(texts)
    gram = min(GRAM, span)
    low = sliding_min(grams(hashes, gram), span - gram + 1)
    inside = np.flatnonzero(owner[: len(low)] == owner[span - 1 :][: len(low)]) if len(low) else np.zeros(0, np.int64)
    return low[inside].view(np.int64), inside, owner[inside], starts, ends, owner, joined


def _fingerprints(span: int):
    """Rows (key, fp, doc, kind), pre-aggregated in each batch.

    A fingerprint that one document of the batch has is asked about (ASK) at its key; one that several have
    recurs for sure: their rows (KNOWN) are spread by document, and one row (TELL) says so at its key. So a
    fingerprint that very many documents share brings few rows to its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ascii_space())
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            found, docs = [], []
            for a, b in slices([len(t) for t in texts], CHUNK):
                fps, _, text, *_ = _phrases(texts[a:b], hasher, span)
                if len(fps):
                    keep = np.concatenate(([True], (fps[1:] != fps[:-1]) | (text[1:] != text[:-1])))
                    found.append(fps[keep])
                    docs.append(ids[a + text[keep]])
            if not found:
                continue
            fps, docs = np.concatenate(found), np.concatenate(docs)
            order = np.lexsort((docs, fps))
            fps, docs = fps[order], docs[order]
            keep = np.concatenate(([True], (fps[1:] != fps[:-1]) | (docs[1:] != docs[:-1])))
            fps, docs = fps[keep], docs[keep]
            first = np.concatenate(([True], fps[1:] != fps[:-1]))
            shared = ~first
            shared[:-1] |= ~first[1:]
            spread = mix(fps.view(np.uint64) ^ mix(docs.astype(np.int64).view(np.uint64))).view(np.int64)
            told = first & shared
            columns = (
                np.concatenate((np.where(shared, spread, fps), fps[told])),
                np.concatenate((fps, fps[told])),
                np.concatenate((docs, docs[told])),
                np.concatenate((np.where(shared, KNOWN, ASK), np.full(int(told.sum()), TELL))).astype(np.int8),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "fp", "doc", "kind"])

    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, fp) of the fingerprints that recur; the rows come sorted by key."""
    held = None
    names = ("key", "fp", "doc", "kind")

    def answer(key, fp, docs, kind):
        plain = kind != KNOWN
        keep = ~plain
        k = key[plain]
        near = np.zeros(len(k), bool)
        near[1:] |= k[1:] == k[:-1]
        near[:-1] |= k[1:] == k[:-1]
        keep[plain] = near & (kind[plain] == ASK)
        return pa.RecordBatch.from_arrays([pa.array(docs[keep]), pa.array(fp[keep])], names=["doc", "fp"])

    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        if last:
            yield answer(*[x[:last] for x in now])
        held = [x[last:] for x in now]
    if held is not None and len(held[0]):
        yield answer(*held)


def _stretches(span: int, text_col: str):
    """Rows (fp, print, words, low, high, docs, ids, at): the distinct stretches of each batch and who has them."""

    def rows_of(found: dict[tuple[int, bytes], tuple[list[int], list[int], list[int]]]) -> pa.RecordBatch:
        rows = []
        for (fp, words), (docs, ids, at) in found.items():
            mark = int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)
            low, high = min(ids), max(ids)
            # the words go with the first list only
            rows += [(fp, mark, None if i else words, low, high, docs[i : i + MANY], ids[i : i + MANY], at[i : i + MANY]) for i in range(0, len(ids), MANY)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["fp", "print", "words", "low", "high", "docs", "ids", "at"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ascii_space())
        for batch in frames:
            docs, ids, texts, wanted = (batch.column(batch.schema.get_field_index(c)) for c in ("__doc", "__id", text_col, "__fps"))
            some = np.flatnonzero(wanted.is_valid().to_numpy(zero_copy_only=False))
            docs, ids = docs.to_numpy(zero_copy_only=False)[some], ids.to_numpy(zero_copy_only=False)[some]
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in texts.take(pa.array(some)).to_pylist()]
            found: dict[tuple[int, bytes], tuple[list[int], list[int], list[int]]] = {}
            for a, b in slices([len(t) for t in texts], CHUNK):
                fps, at, text, starts, ends, owner, joined = _phrases(texts[a:b], hasher, span)
                if not len(fps):
                    continue
                first = np.searchsorted(owner, np.arange(b - a))
                new = np.concatenate(([True], (fps[1:] != fps[:-1]) | (text[1:] != text[:-1])))
                runs = np.flatnonzero(new)
                last = np.concatenate((runs[1:], [len(fps)])) - 1
                bounds = np.searchsorted(text[runs], np.arange(b - a + 1))
                rows = [bounds[i] + np.flatnonzero(np.isin(fps[runs[bounds[i] : bounds[i + 1]]], wanted[int(some[a + i])].values.to_numpy())) for i in range(b - a)]
                rows = np.concatenate(rows)
                begin, end, who = at[runs[rows]], at[last[rows]] + span - 1, text[runs[rows]]
                where = (begin - first[who]).tolist()
                for fp, s, e, d, i, p in zip(fps[runs[rows]].tolist(), starts[begin].tolist(), ends[end].tolist(), docs[a + who].tolist(), ids[a + who].tolist(), where):
                    have = found.setdefault((fp, b" ".join(joined[s:e].split())), ([], [], []))
                    have[0].append(d)
                    have[1].append(i)
                    have[2].append(p)
                if len(found) > 50_000:
                    yield rows_of(found)
                    found = {}
            if found:
                yield rows_of(found)

    return run


class PhraseAutomaton:
    """Recurring passages of one shard, compiled with pyahocorasick over coded words.

    Each word of the shard has a number, written as two characters of two alphabets, so a match begins and
    ends with whole words.
    """

    def __init__(self, span: int):
        self.span, self.codes, self.first, self.automaton = span, {}, {}, None

    def add(self, stretch: bytes, low: int, high: int) -> str:
        """Takes in a distinct stretch of words, with the least and the greatest document that has it; returns it coded."""
        codes, line = self.codes, []
        for w in stretch.split(b" "):
            c = codes.get(w)
            if c is None:
                n = len(codes)
                c = codes[w] = chr(0x20000 + (n >> 8)) + chr(0x100 + (n & 255))
            line.append(c)
        line, first, size = "".join(line), self.first, 2 * self.span
        for i in range(0, len(line) - size + 1, 2):
            phrase = line[i : i + size]
            seen = first.get(phrase)
            if seen is None:
                first[phrase] = low, high
            elif low < seen[0] or high > seen[1]:
                first[phrase] = min(seen[0], low), max(seen[1], high)
        return line

    def compile(self) -> None:
        import ahocorasick

        auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase, (low, high) in self.first.items():
            if low < high:  # confirmed: two documents have it
                auto.add_word(phrase, low)
        self.first, self.codes = {}, {}
        if len(auto):
            auto.make_automaton()
            self.automaton = auto

    def found(self, line: str) -> list[tuple[int, int]]:
        """(first word, first document) of each recurring phrase of a coded stretch."""
        if self.automaton is None:
            return []
        back = self.span - 1
        return [(end // 2 - back, low) for end, low in self.automaton.iter(line)]


def _runs(hits: list[tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Neighbouring phrases with the same first document as one: (first words, numbers of phrases, first documents)."""
    at, n, lows = [], [], []
    for i, low in hits:
        if at and low == lows[-1] and i == at[-1] + n[-1]:
            n[-1] += 1
        else:
            at.append(i)
            n.append(1)
            lows.append(low)
    return at, n, lows


def _locate(span: int):
    """Rows (fp, print, at, n, first) of the stretches of each shard that have recurring phrases; rows come sorted by part."""

    def answer(auto, stretches):
        auto.compile()
        rows = [(*mark, *_runs(found)) for mark, line in stretches.items() if (found := auto.found(line))]
        kinds = pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())
        columns = zip(*rows) if rows else ((),) * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["fp", "print", "at", "n", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, auto, stretches = None, None, {}
        for batch in batches:
            for part, fp, mark, words, low, high in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "fp", "print", "words", "low", "high")]):
                if part != shard:
                    if stretches:
                        yield answer(auto, stretches)
                    shard, auto, stretches = part, PhraseAutomaton(span), {}
                stretches[fp, mark] = auto.add(words, low, high)
        if stretches:
            yield answer(auto, stretches)

    return run


def _singles(span: int):
    """Rows (phrase, docs, ids, at): the distinct phrases of each batch of stretches and who has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, tuple[list[int], list[int], list[int]]] = {}
            for stretch, docs, ids, at in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                words = stretch.split(b" ")
                for i in range(len(words) - span + 1):
                    have = found.setdefault(b" ".join(words[i : i + span]), ([], [], []))
                    have[0].extend(docs)
                    have[1].extend(ids)
                    have[2].extend([p + i for p in at])
            rows = [(phrase, *(x[i : i + MANY] for x in have)) for phrase, have in found.items() for i in range(0, len(have[0]), MANY)]
            kinds = pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 4, kinds)], names=["phrase", "docs", "ids", "at"])

    return run


def _frequent(stretches: DataFrame, shard_rows: int) -> DataFrame:
    """(fp) of the fingerprints with more than `shard_rows` stretches."""
    return stretches.filter("words IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows).select("fp")


def _locate_singles(stretches: DataFrame, span: int) -> DataFrame:
    """(doc, at, length) of every phrase of the stretches that a document before it has too, without a shard."""
    worded = stretches.filter("words IS NOT NULL").groupBy("fp", "print").agg(F.first("words").alias("words"))
    full = stretches.drop("words").join(worded.hint("merge"), ["fp", "print"])
    singles = written(full.select("words", "docs", "ids", "at").mapInArrow(_singles(span), "phrase binary, docs array<long>, ids array<long>, at array<int>"), "single-phrases")
    ends = singles.groupBy("phrase").agg(F.min(F.array_min("ids")).alias("low"), F.max(F.array_max("ids")).alias("high"))
    ends = written(ends.filter("low < high"), "recurring-singles")  # written, so that AQE can split a frequent phrase
    met = singles.join(measured(ends, 48 + F.length("phrase")), "phrase").select("low", F.inline(F.arrays_zip("docs", "ids", "at")))
    return met.filter("ids > low").select(F.col("docs").alias("doc"), "at", F.lit(span).alias("length"))


def _with_doc(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.when(F.col(id_col).isNotNull() & F.col(text_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))
    return docs.withColumns({"__id": F.col(id_col).cast("long"), "__doc": key})


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 13, shard_rows: int = 20_000) -> DataFrame:
    """(doc, spans array<struct<at, length>>): word ranges covered by phrases that a smaller id has too.

    doc is the print of a row's id and text. Documents without such a phrase have no row. Ranges may touch or overlap.
    `shard_rows` is about how many stretches an automaton is compiled for and streamed with; more rows give more shards.
    A fingerprint has at most so many in its shard, so a task holds no more than that above its share. Rows with a null id
    or text have no phrases.
    """
    base = _with_doc(docs, id_col, text_col).filter("__doc IS NOT NULL")
    asked = base.select("__doc", F.col(text_col).cast("string")).mapInArrow(_fingerprints(span), "key long, fp long, doc long, kind byte")
    recurring = asked.repartition("key").sortWithinPartitions("key").mapInArrow(_recurring, "doc long, fp long")
    wanted = written(recurring.groupBy(F.col("doc").alias("__key")).agg(F.collect_set("fp").alias("__fps")), "recurring-phrases")
    n, docs_of = wanted.agg(F.coalesce(F.sum(F.size("__fps")), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-n // shard_rows))
    stretches = base.select("__doc", "__id", text_col).join(measured(wanted, F.lit(0), 8 * n + 40 * docs_of), F.col("__doc") == F.col("__key"))
    stretches = stretches.mapInArrow(_stretches(span, text_col), "fp long, print long, words binary, low long, high long, docs array<long>, ids array<long>, at array<int>")
    stretches = written(stretches, "stretches")
    frequent = written(_frequent(stretches, shard_rows), "frequent-fingerprints")
    many = frequent.count()
    rest = stretches
    if many:
        known = F.broadcast(frequent) if many <= BROADCAST_ROWS else frequent.hint("merge")
        rest = stretches.join(known, "fp", "left_anti")
    rows = rest.filter("words IS NOT NULL").select(F.pmod(F.xxhash64("fp"), F.lit(shards)).cast("int").alias("part"), "fp", "print", "words", "low", "high")
    hits = rows.repartition("part").sortWithinPartitions("part").mapInArrow(_locate(span), "fp long, print long, at array<int>, n array<int>, first array<long>")
    hits = written(hits.select("fp", "print", F.arrays_zip("at", "n", "first").alias("hits")), "stretch-hits")  # written, so that AQE can split a frequent stretch
    met = rest.select("fp", "print", F.arrays_zip("docs", "ids", "at").alias("who")).join(measured(hits, 48 + 40 * F.size("hits")), ["fp", "print"]).select(F.explode("who").alias("x"), "hits")
    met = met.select(F.col("x.docs").alias("doc"), F.col("x.at").alias("from"), F.explode(F.filter("hits", lambda h: h["first"] < F.col("x.ids"))).alias("h"))
    located = met.select("doc", (F.col("from") + F.col("h.at")).alias("at"), (F.col("h.n") + F.lit(span - 1)).alias("length"))
    if many:
        located = located.unionByName(_locate_singles(stretches.join(known, "fp", "left_semi"), span))
    spans = written(located.groupBy("doc").agg(F.collect_set(F.struct("at", "length")).alias("spans")), "repeated-spans")
    discard(wanted, stretches, frequent, hits)
    return spans


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, int, str | None, bytes]:
    """(words, removed words, what is kept as written, kept words joined by one space)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not spans:
        return len(words), 0, text, b" ".join(words)
    keep = bytearray(b"\1") * len(words)
    for at, length in spans:
        keep[at : at + length] = bytes(length)
    kept = [*compress(words, keep)]
    edge = np.diff(np.frombuffer(keep, np.int8), prepend=np.int8(0), append=np.int8(0))
    runs = [*zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
    out = b""
    if runs:
        places = [m.span() for m in _WORD.finditer(raw)]
        out = b"\n".join(raw[places[a][0] : places[b - 1][1]] for a, b in runs)
    return len(words), len(words) - len(kept), out.decode("utf-8", "surrogatepass"), b" ".join(kept)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 13, shard_rows: int = 20_000, with_text: bool = True) -> DataFrame:
    """Every input row with n_words, n_removed, kept_text and kept_sha256 (hex, of the kept words joined by one space).

    kept_text is the text as written without the removed words (a line break where words are missing);
    untouched texts stay as they are. A null text has no words and stays null; a null id never matches
    and keeps all its words; rows that repeat an id each keep what no smaller id has. An empty table stays empty.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text", "kept_sha256")  # columns of these names give way
    spans = repeated_spans(docs, id_col, text_col, span, shard_rows).select(F.col("doc").alias("__key"), F.col("spans").alias("__spans"))
    spans = measured(spans, 32 + 32 * F.size("__spans"))
    joined = _with_doc(docs, id_col, text_col).join(spans, F.col("__doc") == F.col("__key"), "left").drop("__id", "__doc", "__key")
    fields = [*[f for f in joined.schema.fields if f.name not in ("__spans", *([] if with_text else [text_col]))]]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            n, gone, kept, digest = [], [], [], []
            for text, found in zip(texts, spans):
                a, b, c, line = _cut(text, [(s["at"], s["length"]) for s in found or ()])
                n.append(a)
                gone.append(b)
                kept.append(c if with_text else None)
                digest.append(hashlib.sha256(line).hexdigest())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            more = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*names, "n_words", "n_removed", "kept_text", "kept_sha256"])

    schema = joined.select(*names).schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_text", "string"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(run, schema)
