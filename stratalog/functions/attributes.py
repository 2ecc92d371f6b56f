"""Typed equality on literal top-level keys of the attribute JSON, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.plans.query import Condition, Float

_WIDE = "decimal(38,0)"


def parsed(attributes: Column) -> Column:
    """map<string, variant>; null where the root is no object. Any key may be looked up, quotes and dots being plain characters."""
    return F.from_json(attributes, "map<string,variant>")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def as_integer(v: Column) -> Column:
    """The exact value of an integer of 64 bits, signed or not, or of a whole double in [-2^63, 2^64); null for all else. Longer integers count as the doubles next to them."""
    k, d, wide = kind(v), F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", _WIDE)
    half = F.lit(2.0**63)
    decimal = k.rlike(r"^DECIMAL\(\d+,0\)$")
    exact = decimal & wide.between(F.lit(str(-(1 << 63))).cast(_WIDE), F.lit(str((1 << 64) - 1)).cast(_WIDE))
    whole = ((k == "DOUBLE") | decimal) & (d % 1 == 0)
    return (
        F.when(k == "BIGINT", F.try_variant_get(v, "$", "bigint").cast(_WIDE))
        .when(exact, wide)
        .when(whole & (d >= -half) & (d < half), F.when((d >= -half) & (d < half), d).cast("bigint").cast(_WIDE))
        .when(whole & (d >= half) & (d < F.lit(2.0**64)), F.when((d >= half) & (d < F.lit(2.0**64)), d - half).cast("bigint").cast(_WIDE) + F.lit(str(1 << 63)).cast(_WIDE))
    )


def as_double(v: Column) -> Column:
    """The value of a number that as_integer leaves out."""
    k = kind(v)
    return F.when((k == "DOUBLE") | k.startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))


def matches(m: Column, condition: Condition) -> Column:
    """Null, missing, arrays and objects never match; 1, 1.0 and 1e0 are one number, "1" and true are not."""
    want = condition.value

    def hit(v: Column) -> Column:
        if isinstance(want, bool):
            return (kind(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(want))
        if isinstance(want, str):
            return (kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(want))
        if isinstance(want, Float):
            return as_integer(v).isNull() & (as_double(v) == F.lit(float(want)))
        return as_integer(v) == F.lit(str(want)).cast(_WIDE)

    # bound by a lambda, the value is taken out of the JSON once, however often the test looks at it
    return F.coalesce(F.exists(F.array(m.getItem(condition.key)), hit), F.lit(False))


def promoted_value(attributes: Column, key: str) -> Column:
    """What a promoted slot holds: the key's string, null for anything else."""
    v = parsed(attributes).getItem(key)
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def promoted_columns(keys: tuple[str, ...], attributes: str = "attributes") -> dict[str, Column]:
    return {"pa_covered": F.lit(True), **{f"pa_{i}": promoted_value(F.col(attributes), k) for i, k in enumerate(keys)}}


def coverage_holds(keys: tuple[str, ...]) -> Column:
    """Covered rows' slots are what their attributes say; those of others are empty."""
    same, empty = F.lit(True), F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(f"pa_{i}").eqNullSafe(promoted_value(F.col("attributes"), k))
        empty &= F.col(f"pa_{i}").isNull()
    return F.when(F.coalesce(F.col("pa_covered"), F.lit(False)), same).otherwise(empty)
