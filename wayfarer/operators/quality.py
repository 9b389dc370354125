"""A compiler from constraints to one table of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _found(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return _found(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), f"unique {', '.join(keys)}", F.concat_ws("|", *keys), F.col("n"))


def references(df: DataFrame, key: str, column: str, target: DataFrame, target_key: str) -> DataFrame:
    """Values (or elements, of an array) that the target lacks."""
    value = F.explode(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
    rows = df.select(F.col(key).alias("_key"), value.alias("_value")).where("_value IS NOT NULL")
    return _found(rows.join(target.select(F.col(target_key).alias("_value")), "_value", "left_anti"), f"references {column}", F.col("_key"), F.col("_value"))


def check(df: DataFrame, key: str, rule: str, good: Column, detail: Column | None = None) -> DataFrame:
    """Rows that fail a predicate; null counts as failing."""
    return _found(df.where(~F.coalesce(good, F.lit(False))), rule, F.col(key), F.lit("") if detail is None else detail)


def vocabulary(df: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    """Values outside a list; null is allowed."""
    return check(df, key, f"vocabulary {column}", F.col(column).isNull() | F.col(column).isin(allowed), F.col(column))


def paired(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rows with one of two columns null."""
    return check(df, key, f"paired {a}, {b}", F.col(a).isNull() == F.col(b).isNull())


def between(df: DataFrame, key: str, column: str, low: float, high: float) -> DataFrame:
    """Values outside a range; null is allowed."""
    return check(df, key, f"range {column}", F.col(column).isNull() | F.col(column).between(low, high), F.col(column))


def forbidden(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    """Values that match a pattern."""
    return check(df, key, f"forbidden {column}", ~F.coalesce(F.col(column).rlike(pattern), F.lit(False)), F.col(column))


def disjoint(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rows whose two arrays share an element."""
    return check(df, key, f"disjoint {a}, {b}", ~F.arrays_overlap(a, b), F.array_join(F.array_sort(F.array_intersect(a, b)), ","))


def equal(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys on both sides with another value in a column."""
    joined = df.select(key, *columns).join(other.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key)
    differ = F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in columns])
    return _found(joined.withColumn("_differ", differ).where("_differ <> ''"), f"equal {', '.join(columns)}", F.col(key), F.col("_differ"))


def golden(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows missing or too many against an expected table, as JSON."""
    row = lambda d: d.select(F.to_json(F.struct(*sorted(d.columns))).alias("row"))
    a, b = row(df), row(expected)
    return _found(a.exceptAll(b), "golden", F.lit("extra"), F.col("row")).unionByName(_found(b.exceptAll(a), "golden", F.lit("missing"), F.col("row")))


def compile_schema(df: DataFrame, key: str, schema: dict) -> list[DataFrame]:
    """Checks of a JSON-Schema-like dict: required, and by property enum, pattern, minimum, maximum."""
    out = [check(df, key, f"required {c}", F.col(c).isNotNull()) for c in schema.get("required", [])]
    for column, rule in schema.get("properties", {}).items():
        x = F.col(column)
        if "enum" in rule:
            out.append(vocabulary(df, key, column, rule["enum"]))
        if "pattern" in rule:
            out.append(check(df, key, f"pattern {column}", x.isNull() | x.rlike(rule["pattern"]), x))
        if "minimum" in rule or "maximum" in rule:
            out.append(between(df, key, column, rule.get("minimum", float("-inf")), rule.get("maximum", float("inf"))))
    return out


def violations(found: list[DataFrame]) -> DataFrame:
    """All violations as one table: rule, key, detail."""
    return reduce(DataFrame.unionByName, found)


def summary(found: DataFrame) -> DataFrame:
    """Violations by rule."""
    return found.groupBy("rule").agg(F.count("*").alias("n"))
