"""The scoring rubric as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def age_hours(ts: Column, now: Column) -> Column:
    """Hours from ts to now, never negative; a null ts is of age 0."""
    return F.coalesce(F.greatest((F.unix_micros(now) - F.unix_micros(ts)) / 3.6e9, F.lit(0.0)), F.lit(0.0))


def freshness(age: Column, half_life: float = K.HALF_LIFE_H, gravity: float = K.GRAVITY) -> Column:
    age = F.greatest(age.cast("double"), F.lit(0.0))
    decay = 0.8 * F.pow(F.lit(0.5), age / half_life) + 0.2 * F.pow(24 / (age + 24), F.lit(gravity / 6))
    return F.round(clamp(decay, 0, 1), 6)


def confidence(n: Column) -> Column:
    return F.when(n >= 3, 1.0).when(n == 2, 0.8).otherwise(0.5)


def grade(score: Column) -> Column:
    out = None
    for least, name in K.GRADES:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("D")


def raw_score(dims: list[Column], weights: tuple[float, ...]) -> Column:
    """Weighted mean of the dimensions, each clamped to 0..100; a missing one counts 0."""
    total = sum(weights) or 1.0
    return sum((clamp(F.coalesce(d.cast("double"), F.lit(0.0)), 0, 100) * (w / total) for d, w in zip(dims, weights)), F.lit(0.0))


def side_raw(dims: list[Column], side: Column) -> Column:
    return F.when(side == "demand", raw_score(dims, K.DEMAND_WEIGHTS)).otherwise(raw_score(dims, K.SUPPLY_WEIGHTS))


def adjusted_freshness(age: Column, velocity: Column, side: Column) -> Column:
    """Freshness, lifted by a known velocity, then held above the demand floor."""
    fresh = freshness(age)
    fresh = F.when(velocity.isNotNull(), F.round(clamp(fresh * (1 + 0.15 * velocity), 0, 1), 6)).otherwise(fresh)
    return F.when(side == "demand", F.greatest(fresh, F.lit(K.DEMAND_FRESH_FLOOR))).otherwise(fresh)


def stage_weight(stage: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in K.LIFECYCLE.items() for x in kv])
    return clamp(F.coalesce(F.try_element_at(known, stage), F.lit(1.0)), 0.3, 1.0)


def crowd_weight(side: Column, crowdedness: Column) -> Column:
    crowd = clamp(F.coalesce(crowdedness.cast("double"), F.lit(0.0)), 0, 100)
    return F.when(side == "demand", F.round(F.greatest(F.lit(0.1), 1 - K.CROWD_PENALTY * crowd / 100), 6)).otherwise(1.0)


def final_score(dims: list[Column], n_sources: Column, age: Column, velocity: Column, track_weight: Column, stage: Column, side: Column, crowdedness: Column) -> Column:
    """round(clamp(raw * confidence * freshness * track * stage * crowd, 0, 100), 4)."""
    track = 1 + (clamp(track_weight, 0.5, 1.5) - 1) * 0.5
    product = side_raw(dims, side) * confidence(n_sources) * adjusted_freshness(age, velocity, side) * track * stage_weight(stage) * crowd_weight(side, crowdedness)
    return F.round(clamp(product, 0, 100), 4)


def pulse_rank(fresh_or_null: Column, heat: Column) -> Column:
    """Freshness (0.5 where the time is unknown) plus heat / (heat + 25); null or negative heat is 0."""
    heat = F.greatest(F.coalesce(heat.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.coalesce(fresh_or_null, F.lit(0.5)) + heat / (heat + K.HEAT_K)


def outcome_reward(blocked: Column, pushed: Column, archived: Column, score: Column) -> Column:
    return clamp(F.when(blocked, 0.0).when(pushed, 1.0).when(archived, 0.6).otherwise(F.coalesce(score, F.lit(0.0)) / 100), 0, 1)


def configured_weight(track: Column, weights: dict[str, float]) -> Column:
    """A track's weight by its id, 1.0 for others."""
    if not weights:
        return F.lit(1.0)
    known = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(known, track), F.lit(1.0))


def effective_track_weight(track: Column, weights: dict[str, float], explore: Column | None = None) -> Column:
    """The configured weight, nudged by the bandit's exploration weight where there is one (null: none)."""
    static = configured_weight(track, weights)
    return static if explore is None else F.coalesce(F.round(static * explore, 6), static)


def final_score_with(weights: tuple[float, ...], dims: list[Column], n_sources: Column, age: Column, velocity: Column, track_weight: Column, stage: Column) -> Column:
    """The final score of the supply side under other weights, to compare rankings."""
    track = 1 + (clamp(track_weight, 0.5, 1.5) - 1) * 0.5
    return F.round(clamp(raw_score(dims, weights) * confidence(n_sources) * adjusted_freshness(age, velocity, F.lit("supply")) * track * stage_weight(stage), 0, 100), 4)


def clamped_settings(scoring: dict, yields: dict) -> tuple[dict, dict]:
    """Settings that may only tighten the shipped rails; what can't be read is as shipped."""

    def number(value, default, better):
        try:
            return value if better(float(value), float(default)) else default
        except (TypeError, ValueError):
            return default

    up, down = lambda v, d: v >= d, lambda v, d: v <= d
    bars = {"min_independent_sources": K.MIN_SOURCES, "min_score_to_archive": K.ARCHIVE_BAR, "min_score_to_push": K.PUSH_BAR}
    scoring = scoring | {k: number(scoring.get(k), d, up) for k, d in bars.items()}
    scoring["min_independent_sources"] = int(float(scoring["min_independent_sources"]))
    out = yields | {"floor": number(yields.get("floor", K.FLOOR), K.FLOOR, down)}
    out["prune_after_weeks"] = number(yields.get("prune_after_weeks", K.PRUNE_WEEKS), K.PRUNE_WEEKS, up)
    out["min_history_days"] = number(yields.get("min_history_days", K.MIN_HISTORY_DAYS), K.MIN_HISTORY_DAYS, up)
    least = max(K.WINDOW_DAYS, 7 * int(float(out["prune_after_weeks"])))
    out["window_days"] = number(yields.get("window_days", least), least, up)
    return scoring, out
