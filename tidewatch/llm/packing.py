"""Operator 8: hierarchical multi-length packing.

Texts are tokenised where they lie and packed block by block, so no text is shuffled and a task holds one
block of token ids. Within a block:

* windows of the longest size are cut off long documents; what is left of each document is routed to the
  shortest tier that holds it;
* each tier is packed best-fit decreasing, the longest tier first;
* the gaps of a tier's windows are filled from the shorter tiers: with whole documents while one fits,
  then by cutting one to measure, so only the last window of a tier can stay short;
* what the last window holds too little of is cut into windows of powers of two, which need no padding;
* windows are dealt to step groups, largest first to the group with the fewest tokens so far.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)
END_ID = 1
STEP_GROUPS = 64
BLOCK_TOKENS = 2_000_000

# The file's pre-tokenizer, spelled out for texts of Latin-1 letters (lower-cased): contractions, runs of letters,
# single digits, runs of anything else but white space.
_LETTER, _DIGIT, _SPACE = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECES = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_LETTER}]+|[{_DIGIT}]|[^{_LETTER}{_DIGIT}{_SPACE}]+")
_BLANKS = re.compile("[ \t\n\r]+")


class WordTokens:
    """Token ids of whole texts, by the tokenizer file; a piece of text is encoded once and remembered.

    The tokenizer never joins what its pre-tokenizer has cut, so a text's ids are those of its pieces in a row.
    Texts beyond Latin-1 are cut at blanks only, which its pre-tokenizer cuts at too. The memory has at
    most `most` pieces, then starts anew; it stays with the worker process from task to task.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many tasks as there are cores
        import tokenizers

        held = vars(tokenizers).setdefault("_held_by_path", {})  # a module of the worker, so it outlives the task
        if path not in held:
            tokenizer = tokenizers.Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            held[path] = tokenizer, {}
        self.tokenizer, self.known = held[path]
        self.most = most

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, the end id last."""
        try:
            text.encode("latin-1")
            words = _PIECES.findall(text.lower())
        except UnicodeEncodeError:
            words = _BLANKS.split(text)
        known = self.known
        new = [w for w in {*words} if w not in known]
        if new:
            if len(known) + len(new) > self.most:
                known.clear()
                new = [*{*words}]
            for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()
        return b"".join([known[w] for w in words]) + END_ID.to_bytes(4, "little")


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """[(tier, [(document, start, length), ...])]: windows of one block of documents; every token once."""
    top = tiers[-1]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, -document, start), ascending
    for doc, n in enumerate(lengths):
        full = n - n % top
        windows += [(top, [(doc, at, top)]) for at in range(0, full, top)]
        if n - full:
            waiting[next(t for t in tiers if t >= n - full)].append((n - full, -doc, full))
    for items in waiting.values():
        items.sort()
    for k in range(len(tiers) - 1, -1, -1):
        tier, items = tiers[k], waiting[tiers[k]]
        bins: list[list[tuple[int, int, int]]] = []
        room: list[tuple[int, int]] = []  # (space, bin), ascending
        while items:
            n, doc, at = items.pop()
            slot = bisect_left(room, (n, -1))
            if slot < len(room):
                space, b = room.pop(slot)
            else:
                space, b = tier, len(bins)
                bins.append([])
            bins[b].append((-doc, at, n))
            if space > n:
                insort(room, (space - n, b))
        for space, b in room:  # the smallest gaps first
            for small in tiers[k - 1 :: -1] if k else ():
                below = waiting[small]
                while space and (spot := bisect_right(below, (space, 1, 0))):
                    n, doc, at = below.pop(spot - 1)
                    bins[b].append((-doc, at, n))
                    space -= n
            for small in tiers[:k]:
                if space and waiting[small]:
                    n, doc, at = waiting[small].pop()
                    bins[b].append((-doc, at, space))
                    insort(waiting[next(t for t in tiers if t >= n - space)], (n - space, doc, at + space))
                    space = 0
        windows += [(tier, pieces) for pieces in bins]
    return _no_padding(windows, tiers)


def _no_padding(windows, tiers):
    """Short windows poured together into full ones; the rest in windows of powers of two."""
    out, loose = [], []
    for tier, pieces in windows:
        if sum(p[2] for p in pieces) == tier:
            out.append((tier, pieces))
        else:
            loose += pieces
    left = sum(p[2] for p in loose)
    sizes = [tiers[-1]] * (left // tiers[-1])
    sizes += [1 << b for b in range(tiers[-1].bit_length() - 1, -1, -1) if left % tiers[-1] >> b & 1]
    loose.reverse()
    for size in sizes:
        pieces, space = [], size
        while space:
            doc, at, n = loose.pop()
            if n > space:
                loose.append((doc, at + space, n - space))
                n = space
            pieces.append((doc, at, n))
            space -= n
        out.append((size, pieces))
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    block_tokens: int = BLOCK_TOKENS,
    step_groups: int = STEP_GROUPS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, ids.

    `tokenizer` is the path of a tokenizer file that executors can read. `tiers` are ascending powers of two.
    sequence_id is unique in the result; tier is the sequence's padded size, which its pieces fill exactly.
    A null or empty text is the end id alone; a document longer than a block is packed as a block of its
    own; equal rows are packed like others, each with its own tokens; a null id stays null.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be ascending powers of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group int" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = WordTokens(tokenizer), TaskContext.get().partitionId()
        serial, load = 0, np.zeros(step_groups, np.int64)
        ids, held, size = [], [], 0

        def flush():
            nonlocal serial
            rows = []
            for tier, pieces in sorted(pack([len(h) // 4 for h in held], tiers), key=lambda w: -w[0]):
                group = int(np.argmin(load))
                load[group] += tier
                offset = 0
                for doc, at, n in pieces:
                    own = held[doc][4 * at : 4 * (at + n)]
                    rows.append((ids[doc], at, n, zlib.crc32(own), len(held[doc]) // 4, part << 40 | serial, offset, tier, (group + part) % step_groups, own))
                    offset += n
                serial += 1
            names = [f.split()[0] for f in schema.split(", ")]
            columns = list(zip(*rows))[: len(names)]
            kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                held.append(encode(text or ""))
                size += len(held[-1]) // 4
                if size >= block_tokens:
                    yield flush()
                    ids, held, size = [], [], 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
