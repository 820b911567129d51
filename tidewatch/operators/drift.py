"""How far a change of weights reorders a ranking."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import fixed as K
from tidewatch.sources.shared import kept

BUCKET_ROWS = 1 << 20
SAMPLES = 32


def _placed(cards: DataFrame, score: str, out: str, n: int, bucket_rows: int) -> DataFrame:
    """cards with column `out`: the place of each by falling score, ties by `key`.

    Cards are dealt to ranges of (score, key) of about `bucket_rows`, numbered within each, and a range starts where those
    before it end. The bounds of the ranges come from a sample by hash; any bounds give the same places.
    """
    ranges = -(-n // bucket_rows)
    order = [F.desc(score), F.col("key")]
    if ranges < 2:
        return cards.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))
    step = max(1, n // (SAMPLES * ranges))
    some = cards.filter(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select(score, "key").collect()  # about SAMPLES a range
    bounds = sorted(((r[score], r["key"]) for r in some), key=lambda b: (-b[0], b[1]))[SAMPLES::SAMPLES]
    listed = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(k).alias("k")) for s, k in bounds])
    first = lambda b: (b["s"] > F.col(score)) | ((b["s"] == F.col(score)) & (b["k"] <= F.col("key")))
    dealt = cards.withColumn("__range", F.size(F.filter(listed, first)) if bounds else F.lit(0))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__start"))  # one row a range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(starts), "__range").withColumn(out, F.col("__start") + F.col("__own")).drop("__range", "__own", "__start")


def ranked(scores: DataFrame, n: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, a, b, ra, rb): positions by either score, ties by the id as text; a score that is missing or no number comes last.

    `n` is the number of rows, counted here if it is not given.
    """
    n = scores.count() if n is None else n
    last = F.lit(float("-inf"))
    score = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), last), last)
    cards = scores.select("id", "a", "b", score("a").alias("__a"), score("b").alias("__b"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"))
    placed = _placed(_placed(cards, "__a", "ra", n, bucket_rows), "__b", "rb", n, bucket_rows)
    return placed.select("id", "a", "b", "ra", "rb")


def inversions(q: np.ndarray) -> int:
    """Pairs of whole numbers of which the earlier is the greater: as a radix sort meets them, bit by bit from the top."""
    q = np.unique(q, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(int(q.max()).bit_length() - 1 if len(q) else -1, -1, -1):
        node, ones = q >> (bit + 1), (q >> bit) & 1  # q is sorted by node
        before = np.cumsum(ones) - ones
        start = before[np.searchsorted(node, node)]
        total += int((before - start)[ones == 0].sum())
        q = q[np.argsort(q >> bit, kind="stable")]
    return total


def _within(by: str, then: str):
    """Discordant pairs of a block, of whose cards only the positions are sent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [inversions(pdf.sort_values(by)[then].to_numpy())]})

    return run


def discordant(ranks: DataFrame, n: int | None = None, block: int = 1 << 17) -> DataFrame:
    """One row (n): pairs ordered one way by ra and the other by rb.

    Positions by either rank are cut into blocks of at least `block` cards, and of the root of n. Pairs within one block of ra are counted
    there; those of two blocks of ra but one of rb, in that block; all others by running sums over the counts of cards by
    both blocks. A card is sent twice whatever n is, no pair is formed, and there are no more counts than cards.
    """
    n = ranks.count() if n is None else n
    block = max(block, math.isqrt(n) + 1)
    of = lambda c: F.floor((F.col(c) - 1) / block).cast("int")
    rows = ranks.select("ra", "rb", of("ra").alias("a"), of("rb").alias("b"))
    same = rows.select("a", "ra", "rb").groupBy("a").applyInPandas(_within("ra", "rb"), "n long")
    crossed = rows.select("b", "rb", "a").groupBy("b").applyInPandas(_within("rb", "a"), "n long")
    sides = ranks.sparkSession.range(-(-n // block))
    every = sides.select(F.col("id").cast("int").alias("a")).crossJoin(sides.select(F.col("id").cast("int").alias("b")))
    cells = every.join(rows.groupBy("a", "b").agg(F.count("*").alias("cards")), ["a", "b"], "left").na.fill(0, ["cards"])
    left = cells.withColumn("left", F.sum("cards").over(Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    below = left.withColumn("met", F.sum("left").over(Window.partitionBy("b").orderBy(F.desc("a")).rowsBetween(Window.unboundedPreceding, -1)))
    apart = below.select((F.col("cards") * F.coalesce("met", F.lit(0))).alias("n"))
    return same.unionByName(crossed).unionByName(apart).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def rank_drift(scores: DataFrame, push_bar: float = K.PUSH_BAR) -> DataFrame:
    """One row: n, tau (normalised Kendall distance), max_shift, push_churn, top_churn and the verdict on the change."""
    scores = kept(scores.select("id", "a", "b"), "scores")  # read to count, to place and to compare, made once
    n = scores.count()
    r = kept(ranked(scores, n).select("a", "b", "ra", "rb"), "ranks")
    half = max(1, n // 2)
    out = r.agg(
        F.lit(n).cast("long").alias("n"),
        F.coalesce(F.max(F.abs(F.col("ra") - F.col("rb"))), F.lit(0)).alias("max_shift"),
        F.count_if((F.col("a") >= push_bar) != (F.col("b") >= push_bar)).alias("flipped"),
        F.count_if((F.col("a") >= push_bar) | (F.col("b") >= push_bar)).alias("either"),
        F.count_if((F.col("ra") <= half) & (F.col("rb") > half)).alias("left_top"),
    ).crossJoin(discordant(r, n).select(F.col("n").alias("bad")))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    tau = F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.col("bad") / F.nullif(pairs, F.lit(0.0)), 6))
    churn = F.round(F.col("flipped") / F.greatest(F.col("either"), F.lit(1)), 6)
    out = out.select("n", tau.alias("tau"), "max_shift", churn.alias("push_churn"), F.round(F.col("left_top") / half, 6).alias("top_churn"))
    worst = (F.col("tau") >= K.BLOCK_TAU) | (F.col("push_churn") >= K.BLOCK_CHURN)
    much = (F.col("tau") > K.DRIFT_TAU) | (F.col("push_churn") > K.DRIFT_CHURN)
    return out.withColumn("verdict", F.when(worst, "block").when(much, "needs_review").otherwise("auto_pass"))
