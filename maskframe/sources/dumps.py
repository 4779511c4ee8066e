"""Masking of whole dumps: read, type, mask, render, write."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.engine import CYCLED, ROTATED, Engine, NothingMasked
from maskframe.functions.maskers import _OWN, MASKERS
from maskframe.sources.sqldump import SqlDump, encoding_of, rendered


def read(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    spark.dataSource.register(SqlDump)
    reader = spark.read.format("sqldump")
    return (reader.option("encoding", encoding) if encoding else reader).load(path)


def tables(dump: DataFrame) -> dict[str, list[str]]:
    """Table name -> columns, from the headers; one row for each table reaches the driver. Tables without a column list are left out."""
    rows = dump.where("kind = 'row' and size(columns) > 0").groupBy("table").agg(F.first("columns").alias("columns")).collect()
    return {r["table"]: list(r["columns"]) for r in rows}


def as_table(dump: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """The rows of one table, all columns as strings, with seq."""
    rows = dump.where((F.col("table") == table) & (F.col("kind") == "row"))
    return rows.select("seq", *(F.get("data", F.lit(i)).alias(c) for i, c in enumerate(columns)))


def skeletons(dump: DataFrame) -> DataFrame:
    """seq, skeleton: each segment with its values taken out; what masking must not change is quotes, prefixes, blanks and separators."""
    bare = F.transform("tokens", lambda t: F.regexp_replace(t, r"(?s)^(\s*[Nn]?)(['\"]).*(['\"])(\s*)$", "$1$2$3$4"))
    bare = F.transform(bare, lambda t: F.regexp_replace(t, r"^(\s*)[^'\"\s].*?(\s*)$", "$1?$2"))
    return dump.select("seq", F.when(F.col("kind") == "row", F.concat_ws(",", bare)).otherwise(F.col("raw")).alias("skeleton"))


def structure_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """seq of the segments whose skeletons differ between two dumps, or that one of them lacks."""
    a, b = skeletons(before), skeletons(after).withColumnRenamed("skeleton", "other")
    return a.join(b, "seq", "full").where(~F.col("skeleton").eqNullSafe(F.col("other"))).select("seq")


def mask_dump(spark: SparkSession, path: str, out: str, engine: Engine | None = None, encoding: str | None = None) -> int:
    """Writes a masked copy of one dump in the same encoding and returns its number of rows. Raises NothingMasked, and writes nothing, where no table can be masked."""
    engine = engine or Engine(spark)
    encoding = encoding or encoding_of(path)
    dump = read(spark, path, encoding).cache()
    try:
        names = tables(dump)
        frames = {t: as_table(dump, t, c) for t, c in names.items()}
        types = engine.types({t: f.drop("seq") for t, f in frames.items()})
        if not any(k in MASKERS | _OWN and k != "skip" or k in ROTATED | CYCLED for k in types.values()):
            raise NothingMasked("no column has a type to mask")
        mapping = engine.mappings(frames, types, positions=dict.fromkeys(frames, "seq"))
        masked = None
        for t, f in frames.items():
            done = engine.apply(f, t, types, mapping).select("seq", F.array(*(F.col(f"`{c}`") for c in names[t])).alias("new"))
            masked = done if masked is None else masked.unionByName(done)

        def render(batches):
            for b in batches:
                raw = [r if new is None else "(" + ",".join(rendered(x, v) for x, v in zip(tokens, [*new, *([None] * len(tokens))], strict=False)) + ")" for r, tokens, new in zip(b["raw"], b["tokens"], b["new"], strict=True)]
                yield pd.DataFrame({"seq": b["seq"], "kind": b["kind"], "raw": raw})

        joined = dump.join(masked, "seq", "left").select("seq", "kind", "raw", "tokens", "new").repartitionByRange("seq").sortWithinPartitions("seq")
        joined.mapInPandas(render, "seq long, kind string, raw string").write.format("sqldump").mode("append").option("path", out).option("encoding", encoding).save()
        return dump.where("kind = 'row'").count()
    finally:
        dump.unpersist()
