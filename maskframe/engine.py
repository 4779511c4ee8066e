"""Profile, classify, build mappings, apply, write: the whole way for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.config import Config
from maskframe.functions.maskers import _OWN, MASKERS, mask
from maskframe.operators import mapping as M
from maskframe.plans.classify import classify

ROTATED = {"genre"}
CYCLED = {"name", "title", "company", "composer"}


class NothingMasked(Exception):
    """Raised instead of writing a copy in which nothing could be masked."""


class Engine:
    """providers: who proposes replacements for a type of cycled columns (name, title, company, composer); the sorted cycle where none is named."""

    def __init__(self, spark: SparkSession, config: Config | None = None, providers: dict | None = None):
        self.spark, self.config, self.providers = spark, config or Config(), providers or {}

    def types(self, tables: dict[str, DataFrame]) -> dict[tuple[str, str], str]:
        """(table, column) -> type. One row for each column reaches the driver."""
        out = {}
        for name, df in tables.items():
            for r in classify(df, name, self.config.rules, self.config.min_distinct).collect():
                out[name, r["column"]] = r["type"]
        return out

    def mappings(self, tables: dict[str, DataFrame], types: dict[tuple[str, str], str], existing: DataFrame | None = None, positions: dict[str, str] | None = None) -> DataFrame:
        """The dictionary of all rotated and cycled columns, after what exists. Columns of one scope share one cycle, over the values that have no
        replacement yet only. Rotated columns go by the order in which values are first seen: tables as given, rows by the column that
        positions names for a table, else by their place in the table as it is read."""
        out = existing if existing is not None else self.spark.createDataFrame([], M.SCHEMA)
        scopes: dict[tuple[str | None, str | None], DataFrame] = {}
        for number, (table, df) in enumerate(tables.items()):
            at = (positions or {}).get(table)
            at = F.col(f"`{at}`").cast("long") if at else F.monotonically_increasing_id()
            for place, column in enumerate(df.columns):
                kind = types.get((table, column), "skip")
                if kind in ROTATED | CYCLED:
                    key = (M.column_scope(column) if kind in ROTATED else None, kind if kind in self.providers else None)
                    one = df.select(F.col(f"`{column}`").cast("string").alias("value"), F.struct(F.lit(number).alias("table"), at.alias("row"), F.lit(place).alias("column")).alias("at"))
                    scopes[key] = one if key not in scopes else scopes[key].unionByName(one)
        for (scope, provider), values in scopes.items():
            new = M.unseen(M.distinct_values(values, "value", "at" if scope else None), out, scope)
            if provider:
                new = self.providers[provider].generate(new.select("value"), provider).select(F.lit(None).cast("string").alias("scope"), "original", "replacement")
            else:
                new = M.cycle(new, scope, "first_pos")
            out = out.unionByName(new)
        return out

    def apply(self, df: DataFrame, table: str, types: dict[tuple[str, str], str], mapping: DataFrame | None = None) -> DataFrame:
        """df with its columns masked by their types. Stateless types are projections; others join the mapping. Typed columns are masked as text and
        cast back; numbers are left alone."""
        order, kinds = df.columns, dict(df.dtypes)
        plain = []
        for c in order:
            kind = types.get((table, c), "skip")
            if kind in (MASKERS | _OWN) and kind != "skip" and not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
                text = F.col(f"`{c}`").cast("string")
                plain.append((c, kind, text))
        done = df
        for c, kind, text in plain:
            done = done.withColumn(c, text)
            done = done.withColumn(c, mask(kind, c).cast(kinds[c]))
        for c in order:
            kind = types.get((table, c), "skip")
            if kind in ROTATED | CYCLED and mapping is not None and isinstance(df.schema[c].dataType, T.StringType):
                done = M.apply(done, c, mapping, M.column_scope(c) if kind in ROTATED else None, self.config.on_unknown)
        return done.select(*(F.col(f"`{c}`") for c in order))

    def run(self, tables: dict[str, DataFrame], out: str, existing: DataFrame | None = None) -> dict[tuple[str, str], str]:
        """Writes the masked tables as Parquet under out, and the mapping. Nothing to mask: nothing is written."""
        types = self.types(tables)
        if not any(t not in ("skip", "none") for t in types.values()):
            raise NothingMasked("no column has a type to mask")
        mapping = self.mappings(tables, types, existing)
        M.save(mapping, f"{out}/_mapping")
        mapping = M.load(self.spark, f"{out}/_mapping")
        for name, df in tables.items():
            self.apply(df, name, types, mapping).write.mode("overwrite").parquet(f"{out}/{name}")
        return types
