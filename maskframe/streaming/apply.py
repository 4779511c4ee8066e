"""Masking of streams: stateless maskers are projections and need no state; dictionaries are static tables joined to the stream, and grow by
first-wins merges of each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskframe.engine import Engine
from maskframe.operators import mapping as M


def mask_stream(engine: Engine, stream: DataFrame, table: str, types: dict[tuple[str, str], str], mapping: DataFrame | None = None) -> DataFrame:
    """A streaming DataFrame; unknown values follow the configured on_unknown."""
    return engine.apply(stream, table, types, mapping)


def grow_mapping(spark: SparkSession, path: str, column: str):
    """A function for foreachBatch that adds a micro-batch's new values of a column to the mapping at path, as one version for each batch: a batch
    that is run again overwrites its own version."""

    def run(batch: DataFrame, number: int) -> None:
        scope = M.column_scope(column)
        known = versions(spark, path, before=number)
        values = M.distinct_values(batch, column)
        if known is not None:  # a cycle over values that already have a replacement would give two of them the same one
            values = M.unseen(values, known, scope)
        new = M.cycle(values, scope, "value")
        merged = known.unionByName(new) if known is not None else new
        M.save(merged, f"{path}/version={number}")

    return run


def versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The latest version (before a batch), or None."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))
    numbers = [n for n in numbers if before is None or n < before]
    return M.load(spark, f"{path}/version={numbers[-1]}") if numbers else None
