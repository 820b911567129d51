"""Card validation and the buckets of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K
from tidewatch.functions import text as T
from tidewatch.operators.roster import FAVES_FLOOR
from tidewatch.sources.shared import kept


def card_errors(track: Column, dims: dict[str, Column], score: Column, good_evidence: Column, n_sources: Column, why_now: Column, action: Column) -> Column:
    """Names of the rules that a card breaks; an empty array passes."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    outside = lambda c: c.isNull() | (c < 0) | (c > 100)
    rules = [
        (blank(track), "track"),
        *[(outside(c), f"breakdown.{n}") for n, c in dims.items()],
        (outside(score), "final_score"),
        (good_evidence < 2, "evidence"),
        (n_sources < K.MIN_SOURCES, "sources"),
        (blank(why_now), "why_now"),
        (blank(action), "action"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in rules]))


def setting_errors(config: Column) -> Column:
    """Names of the settings in a JSON configuration that are malformed or would be clamped; a null configuration has none.

    Yield settings must be numbers and may only be stricter than the defaults; the floor of likes of rostered pulls lies between
    0 and the lesser of FAVES_FLOOR and the pre-viral bar; keep and drop lists of a source are lists of strings.
    """
    names = ["window_days", "propose_add_min_count", "pre_viral_faves_threshold", "noisy_pull_min", "noisy_yield_max", "floor", "prune_after_weeks", "min_history_days"]
    paths = {"yield": "$.yield", **{n: f"$.yield.{n}" for n in names}, "likes": "$.sources.twitterapi.min_faves_rostered"}
    numeric = lambda kind: F.coalesce(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))

    # The configuration is parsed once, and each path is looked up once for its kind and once for its number.
    def looked_up(tree: Column) -> Column:
        kinds = F.struct(F.schema_of_variant(tree).alias("all"), *[F.schema_of_variant(F.try_variant_get(tree, p, "variant")).alias(n) for n, p in paths.items()])
        with_numbers = lambda k: F.struct(tree.isNull().alias("broken"), k.alias("kind"), F.struct(*[F.when(numeric(k[n]), F.try_variant_get(tree, p, "double")).alias(n) for n, p in paths.items() if n != "yield"]).alias("number"))
        return T.once(kinds, with_numbers)

    def broken_rules(found: Column) -> Column:
        kind, number = lambda n: found["kind"][n], lambda n: found["number"][n]
        weeks, bar, likes = number("prune_after_weeks"), number("pre_viral_faves_threshold"), number("likes")
        reach = F.greatest(F.lit(float(K.WINDOW_DAYS)), 7 * F.greatest(F.coalesce(weeks, F.lit(0.0)), F.lit(float(K.PRUNE_WEEKS))))
        cap = F.when((bar >= 0) & (bar < FAVES_FLOOR), F.floor(bar)).otherwise(FAVES_FLOOR)
        rules = [
            (config.isNotNull() & (found["broken"] | ~kind("all").startswith("OBJECT")), "not an object"),
            (~kind("yield").startswith("OBJECT") & (kind("yield") != "VOID"), "yield no object"),
            *[(~numeric(kind(n)) & kind(n).isNotNull(), f"yield.{n} no number") for n in names],
            (number("floor") > K.FLOOR, "yield.floor clamped"),
            (weeks < K.PRUNE_WEEKS, "yield.prune_after_weeks clamped"),
            (number("min_history_days") < K.MIN_HISTORY_DAYS, "yield.min_history_days clamped"),
            (number("window_days") < reach, "yield.window_days clamped"),
            (~numeric(kind("likes")) & kind("likes").isNotNull(), "min_faves_rostered no number"),
            ((likes < 0) | (likes > cap), "min_faves_rostered clamped"),
        ]
        return F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))

    sources = F.map_entries(F.from_json(F.get_json_object(config, "$.sources"), "map<string,string>"))
    lists = ["keep_nodes", "keep_categories", "drop_nodes", "drop_categories"]
    ok = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))

    def bad_lists(source: Column) -> Column:
        bad = lambda held: F.array_compact(F.array(*[F.when(F.map_contains_key(held, n) & ~ok(held[n]), F.concat(source["key"], F.lit(f".{n} no list of strings"))) for n in lists]))
        return T.once(F.from_json(source["value"], "map<string,string>"), bad)

    listed = F.coalesce(F.flatten(F.transform(sources, bad_lists)), F.array().cast("array<string>"))
    return F.concat(T.once(T.once(F.try_parse_json(config), looked_up), broken_rules), listed)


def buckets(cards: DataFrame, errors: str = "errors", score: str = "final_score", side: str = "side", id_col: str = "id", most: int = K.MAX_PER_DAY, pos: str | None = None) -> DataFrame:
    """cards with columns passed, archivable, pushable and bucket (pushable, digest_only, passed or blocked).

    Pushable are the best `most` of those at the push bar, ties in the order of `pos` (the input order where it is given, else the id); a top-k, not a sort of all cards.
    """
    cards = cards.withColumn("passed", F.size(errors) == 0)
    bar = F.when(F.col(side) == "demand", K.DEMAND_BAR).otherwise(K.ARCHIVE_BAR)
    # the cards are made once, for the choice of the best and for the answer
    cards = kept(cards.withColumn("archivable", F.col("passed") & (F.col(score) >= bar)), "gated-cards")
    top = cards.filter(F.col("passed") & (F.col(score) >= K.PUSH_BAR)).orderBy(F.desc(score), pos or id_col).limit(most).select(id_col, F.lit(True).alias("pushable"))
    out = cards.join(F.broadcast(top), id_col, "left").withColumn("pushable", F.coalesce("pushable", F.lit(False)))
    return out.withColumn("bucket", F.when(F.col("pushable"), "pushable").when(F.col("archivable"), "digest_only").when(F.col("passed"), "passed").otherwise("blocked"))
