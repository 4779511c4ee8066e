"""Profiles: the distinct values of all columns of a table, and statistics of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALARS = (T.StringType, T.IntegralType, T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, SCALARS)]


def unpivoted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value for each cell of the given columns that isn't null or blank. Other columns aren't read."""
    columns = columns if columns is not None else scalar_columns(df)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns)))
    return df.select(cells.alias("c")).select("c.column", "c.value").where("value is not null and value <> ''")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value: distinct."""
    return unpivoted(df, columns).distinct()


def statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, unique_count, avg_length, min_length, max_length over the distinct values."""
    n = F.length("value")
    return profile(df, columns).groupBy("column").agg(F.count("*").alias("unique_count"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def samples(df: DataFrame, column: str, position: str, n: int = 50) -> DataFrame:
    """The first n distinct values by smallest position; a top-n, not a sort of all."""
    from maskframe.operators.mapping import distinct_values

    return distinct_values(df, column, position).orderBy("first_pos", "value").limit(n)
