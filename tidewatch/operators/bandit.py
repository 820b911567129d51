"""Track exploration: Beta posteriors, reproducible draws and the weights they give."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 1e-9  # of the parameters of a posterior


def _shape(c: Column, prior: float) -> Column:
    """A parameter of a Beta posterior that draws can be made from: the prior where it is missing or no finite number, never under LEAST."""
    c = c.cast("double")
    return F.greatest(F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), prior).otherwise(c), F.lit(LEAST))


def fold_rewards(arms: DataFrame, outcomes: DataFrame, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(track, alpha, beta, n) after outcomes (track, reward): alpha gains r, beta 1 - r, n 1; new tracks start at the prior.

    Rewards are clamped to 0 and 1; one that is missing or no number is 0.
    """
    r = F.col("reward").cast("double")
    fit = F.when(r.isNull() | F.isnan(r), 0.0).otherwise(F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0)))
    gains = outcomes.withColumn("reward", fit).groupBy("track").agg(F.sum("reward").alias("up"), F.sum(1 - F.col("reward")).alias("down"), F.count("*").alias("seen"))
    joined = arms.join(gains, "track", "full_outer")
    shape = lambda c, p, gain: F.greatest(F.round(_shape(F.col(c), p) + F.coalesce(gain, F.lit(0.0)), 6), F.lit(LEAST)).alias(c)
    count = F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)) + F.coalesce("seen", F.lit(0))
    return joined.select("track", shape("alpha", prior[0], "up"), shape("beta", prior[1], "down"), count.cast("long").alias("n"))


def _number(value: Column) -> Column:
    """A VARIANT's number: numbers, booleans as 0 and 1, and texts that spell a decimal number; else null."""
    kind = F.schema_of_variant(value)
    spelt = F.trim(F.try_variant_get(value, "$", "string"))
    return (
        F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .when((kind == "STRING") & spelt.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), spelt.try_cast("double"))
    )


def read_arms(states: DataFrame, key: str, body: str, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(key, track, alpha, beta, n) from saved states: JSON objects of track to {alpha, beta, n}. Nothing that was saved can stop a run.

    A state that is no JSON object has no arms, an entry that is no object is none; a parameter that is missing or no finite number is
    the prior, one that is too small is LEAST; a count that is no whole number in a text, missing, negative or beyond a long is 0, a fraction is cut.
    """
    trees = states.select(F.col(key).alias("__key"), F.try_parse_json(body).alias("__tree")).filter(F.schema_of_variant("__tree").startswith("OBJECT"))
    arms = trees.lateralJoin(states.sparkSession.tvf.variant_explode(F.col("__tree").outer())).filter(F.schema_of_variant("value").startswith("OBJECT"))
    field = lambda name: F.try_variant_get("value", f"$.{name}", "variant")
    whole = (F.schema_of_variant(field("n")) != "STRING") | F.trim(F.try_variant_get("value", "$.n", "string")).rlike("^[+-]?[0-9]+$")
    n = F.coalesce(F.when(whole, _number(field("n")).try_cast("long")), F.lit(0).cast("long"))
    return arms.select(
        F.col("__key").alias(key), F.col("key").alias("track"), _shape(_number(field("alpha")), prior[0]).alias("alpha"), _shape(_number(field("beta")), prior[1]).alias("beta"), F.greatest(n, F.lit(0).cast("long")).alias("n")
    )


def saved_arms(arms: DataFrame, key: str) -> DataFrame:
    """(key, body): the arms of each key as one JSON object in the order of tracks, the same text for the same arms. A key has a few tracks."""
    entry = F.struct("track", F.struct(F.col("alpha").cast("double").alias("alpha"), F.col("beta").cast("double").alias("beta"), F.col("n").cast("long").alias("n")).alias("arm"))
    listed = arms.filter("track IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("__arms"))
    return listed.select(key, F.to_json(F.map_from_entries("__arms")).alias("body"))


def posterior_mean(alpha: Column, beta: Column) -> Column:
    return alpha / (alpha + beta)


def posterior_variance(alpha: Column, beta: Column) -> Column:
    total = alpha + beta
    return alpha * beta / (total * total * (total + 1))


def draw(seed: str, track: Column, alpha: Column, beta: Column) -> Column:
    """A Beta draw that depends on the seed, the track and the arm only (CPython's Mersenne Twister)."""

    @F.pandas_udf("double")
    def one(tracks: pd.Series, alphas: pd.Series, betas: pd.Series) -> pd.Series:
        def value(t, a, b):
            start = int.from_bytes(hashlib.md5(f"{seed}::{t}".encode()).digest()[:8], "big")
            return random.Random(start).betavariate(a, b)

        return pd.Series([value(*x) for x in zip(tracks, alphas, betas)], dtype="float64")

    return one(track, alpha, beta)


def explore_weight(theta: Column, lo: float = 0.5, hi: float = 1.5) -> Column:
    lo, hi = min(lo, hi), max(lo, hi)
    return F.round(F.greatest(F.lit(lo), F.least(F.lit(hi), lo + theta * (hi - lo))), 6)


def best_track(drawn: DataFrame) -> DataFrame:
    """One row: the track with the greatest theta, ties to the lesser name."""
    return drawn.orderBy(F.desc("theta"), "track").limit(1)
