"""Files around the engine: dumps in a folder, where results go, profile files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def size_text(size: int) -> str:
    kb = size / 1024
    return f"{kb:.0f} KB" if kb < 1024 else f"{kb / 1024:.1f} MB"


def dumps(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime of the *.sql files of a folder, by path. Contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.sql").load(folder).select("path", "length", "modificationTime").orderBy("path")


def output_path(dump: str, profiles_dir: str) -> Path:
    """Beside the folder of profiles, <stem>_sanitized.sql."""
    return Path(profiles_dir).parent / f"{Path(dump).stem}_sanitized.sql"


def samples(spark: SparkSession, profiles_dir: str, field: str, limit: int = 50) -> DataFrame:
    """value: the first items of a field's samples file, a JSON array of {"value": ...}."""
    items = spark.read.option("multiLine", True).schema("value string").json(f"{profiles_dir}/{field}_samples.json")
    return items.where(F.col("value").isNotNull()).limit(limit)


def stats(spark: SparkSession, profiles_dir: str, field: str) -> dict:
    """A field's entry in profiles.json, if it is an object."""
    kind = "map<string, map<string, double>>"
    row = spark.read.text(f"{profiles_dir}/profiles.json", wholetext=True).select(F.from_json("value", kind).alias("m")).first()
    return dict((row["m"] or {}).get(field) or {}) if row else {}
