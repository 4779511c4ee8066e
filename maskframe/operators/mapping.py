"""Replacement dictionaries as tables: mapping(scope, original, replacement).

Scope is the lower-cased column name for categories, null for identity-like values, whose replacement is the same in every column. A dictionary
is applied by a left join and coalesce; Spark broadcasts it when its size, known at run time, allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskframe.plans.settle import settled

SCHEMA = "scope string, original string, replacement string"


def column_scope(column: str) -> str | None:
    """Lower-cased column name without blanks and back-ticks; empty: None."""
    return column.strip().strip("`").strip().lower() or None


def distinct_values(df: DataFrame, column: str, position: str | None = None) -> DataFrame:
    """value, first_pos: the distinct non-empty values of a column and the smallest position at which each occurs."""
    value = F.col(column).cast("string")
    at = F.min(position) if position else F.min(value)
    return df.where(value.isNotNull() & (F.trim(value) != "")).groupBy(value.alias("value")).agg(at.alias("first_pos"))


def cycle(values: DataFrame, scope: str | None, order: str, buckets: int | None = None) -> DataFrame:
    """A cyclic mapping over distinct values: each to the next by order, the last to the first; a single value to itself.

    Values are ranked within ranges, as many as there are shuffle partitions, and only one row for each range meets in one place, so a
    column with very many distinct values isn't gathered in one task."""
    buckets = buckets or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(values.repartitionByRange(buckets, F.col(order), F.col("value")).select("value", F.col(order).alias("at"), F.spark_partition_id().alias("range")))
    by = [F.col("at"), F.col("value")]
    inside = ranged.withColumn("next", F.lead("value").over(Window.partitionBy("range").orderBy(*by)))
    firsts = inside.groupBy("range").agg(F.min(F.struct(*by)).alias("f"))
    over = Window.partitionBy(F.lit(0)).orderBy("range")
    wrap = F.first("f.value").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("range", F.coalesce(F.lead("f.value").over(over), wrap).alias("after"))
    out = inside.join(F.broadcast(firsts), "range")  # buckets rows at most
    return out.select(F.lit(scope).cast("string").alias("scope"), F.col("value").alias("original"), F.coalesce("next", "after").alias("replacement"))


def rotation(df: DataFrame, column: str, position: str, scope: str | None = None) -> DataFrame:
    """The cycle over a column's values in the order in which they are first seen (smallest position)."""
    return cycle(distinct_values(df, column, position), scope or column_scope(column), "first_pos")


def sorted_cycle(df: DataFrame, *columns: str) -> DataFrame:
    """The cycle over the sorted values of some columns, for identity-like values (scope null)."""
    values = None
    for c in columns:
        one = df.select(F.col(c).cast("string").alias("value"))
        values = one if values is None else values.unionByName(one)
    return cycle(distinct_values(values, "value"), None, "value")


def first_wins(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing and those rows of new whose (scope, original) it doesn't have."""
    a, b = existing.select("scope", "original", "replacement"), new.select("scope", "original", "replacement")
    keys = a.select(F.col("scope").alias("s"), F.col("original").alias("o"))
    return a.unionByName(b.join(keys, b.scope.eqNullSafe(keys.s) & (b.original == keys.o), "left_anti"))


def unseen(values: DataFrame, existing: DataFrame, scope: str | None) -> DataFrame:
    """Those rows of values (column value) that the mapping doesn't know in a scope."""
    known = existing.where(F.col("scope").eqNullSafe(F.lit(scope).cast("string"))).select(F.col("original").alias("value"))
    return values.join(known, "value", "left_anti")


def last_wins(mapping: DataFrame, order: str) -> DataFrame:
    """For each (scope, original) the replacement with the highest order."""
    best = mapping.groupBy("scope", "original").agg(F.max_by("replacement", order).alias("replacement"))
    return best.select("scope", "original", "replacement")


def apply(df: DataFrame, column: str, mapping: DataFrame, scope: str | None, on_unknown: str = "keep") -> DataFrame:
    """df with column replaced by its mapping. Unknown values: keep, fail (raise at run time) or hash."""
    if on_unknown not in ("keep", "fail", "hash"):
        raise ValueError(on_unknown)
    o, r = (next(n for n in (("_" * i) + name for i in range(1, 99)) if n.lower() not in {c.lower() for c in df.columns}) for name in ("original", "replacement"))
    some = mapping.where(F.col("scope").eqNullSafe(F.lit(scope).cast("string"))).select(F.col("original").alias(o), F.col("replacement").alias(r))
    value = F.col(f"`{column}`").cast("string")
    joined = df.join(some, value == F.col(o), "left")
    other = {"keep": value, "hash": F.substring(F.sha2(value, 256), 1, 12), "fail": F.when(value.isNull() | (F.trim(value) == ""), value).otherwise(F.raise_error(F.concat(F.lit(f"no replacement in {column}: "), F.sha2(value, 256))))}[on_unknown]
    masked = F.coalesce(r, other)
    return joined.select(*(masked.alias(c) if c == column else F.col(f"`{c}`") for c in df.columns))


def save(mapping: DataFrame, path: str) -> None:
    mapping.select("scope", "original", "replacement").write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def random_member(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """column's values with another member of the value set each, chosen by a hash: value, replacement."""
    return cycle(distinct_values(df, column).select("value", F.xxhash64("value").alias("h")), None, "h", buckets).select(F.col("original").alias("value"), "replacement")


def total_entries(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("scope").agg(F.count("*").alias("entries"))


def exists_anywhere(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """The rows of values (column value) that some scope of the mapping replaces."""
    return values.join(mapping.select(F.col("original").alias("value")).distinct(), "value", "left_semi")
