"""Fields that go by several names, read from VARIANT values with their types kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names under which sources give likes, first one first.
FAVES = ["likeCount", "favoriteCount", "like_count", "faves", "likes"]
ENGAGEMENT = ["faves", "like_count", "likes", "favorite_count", "favoriteCount", "likeCount"]
_NUMBER = "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


def _kind(value: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))


def first_number(value: Column, names: list[str], default: float | None = 0.0) -> Column:
    """The first of the fields that is a number, as a double; texts that look like numbers and booleans are none. Else `default`."""
    found = [F.when(_kind(value, n).rlike(_NUMBER), F.try_variant_get(value, f"$.{n}", "double")) for n in names]
    return F.coalesce(*found, F.lit(default).cast("double"))


def any_below(value: Column, names: list[str], bar: float) -> Column:
    """Whether any of the fields is below `bar`: numbers, texts of a number, and booleans as 0 and 1; what is none of these doesn't count."""

    def low(name: str) -> Column:
        number = F.when(_kind(value, name) == "BOOLEAN", F.try_variant_get(value, f"$.{name}", "boolean").cast("double")).otherwise(
            F.when(_kind(value, name).rlike(f"{_NUMBER}|^STRING$"), F.try_variant_get(value, f"$.{name}", "string").try_cast("double"))
        )
        return F.coalesce(number < bar, F.lit(False))

    out = low(names[0])
    for n in names[1:]:
        out = out | low(n)
    return out
