"""Integrity checks of a masked table against its original."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.functions.validate import PLACEHOLDER


def keys_changed(original: DataFrame, masked: DataFrame, keys: list[str]) -> DataFrame:
    """missing, added: keys of one table that the other lacks."""
    a, b = original.select(*keys), masked.select(*keys)
    one = a.join(b, keys, "left_anti").agg(F.count("*").alias("missing"))
    two = b.join(a, keys, "left_anti").agg(F.count("*").alias("added"))
    return one.join(two, F.lit(True))  # one row each


def placeholders(masked: DataFrame, column: str) -> DataFrame:
    return masked.agg(F.count_if(F.trim(F.col(column)).rlike(PLACEHOLDER)).alias("placeholders"))


def inconsistent(pairs: DataFrame) -> DataFrame:
    """Originals (columns original, masked) with more than one masked value."""
    return pairs.groupBy("original").agg(F.countDistinct("masked").alias("n")).where("n > 1")


def distinct_counts(original: DataFrame, masked: DataFrame, columns: list[str]) -> DataFrame:
    """column, before, after."""
    one = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).groupBy("x.column").agg(F.countDistinct("x.v").alias(name))
    return one(original, "before").join(one(masked, "after"), "column")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """size, values: how many values occur size times. Equal before and after a rotation."""
    return df.groupBy(column).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("values"))


def row_counts(original: DataFrame, masked: DataFrame) -> DataFrame:
    """rows_before, rows_after."""
    return original.agg(F.count("*").alias("rows_before")).join(masked.agg(F.count("*").alias("rows_after")), F.lit(True))  # one row each


def top_domains(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """domain, n: the most frequent parts after the last @, ties by name."""
    value = F.col(column)
    domains = df.where(value.contains("@")).select(F.substring_index(value, "@", -1).alias("domain"))
    return domains.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(n)


def cost_estimate(tables: list[tuple[DataFrame, str]], per_call: float = 0.002, values_per_call: int = 20) -> DataFrame:
    """calls, dollars: requests that the distinct values of the columns need."""
    counts = None
    for df, column in tables:
        one = df.agg(F.countDistinct(column).alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    calls = F.sum(F.ceil(F.col("n") / values_per_call))
    return counts.agg(calls.cast("long").alias("calls"), (calls * F.lit(per_call)).alias("dollars"))
