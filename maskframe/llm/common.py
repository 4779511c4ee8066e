"""What the corpus operators share: reading, materialising in the shared folder, word and shingle kernels."""

from __future__ import annotations

import ctypes
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.plans.settle import shared_dir

#: Words are maximal runs of anything but these six characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there, and a lost executor costs nothing
    already written. The folder goes with spent(), or else when the application ends. files: how many at most."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/maskframe-{label}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(at)
    path = _path(spark, at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._maskframe_at = at
    return out


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """Like materialize, dealt out by key into a bucketed table, so that later joins on key don't shuffle it again. The table lies in the shared
    folder; its name, which no other has, goes with spent() or the session."""
    spark = df.sparkSession
    name = f"maskframe_{label}_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark).rstrip('/')}/{name}"
    n = min(int(spark.conf.get(c)) for c in ("spark.sql.shuffle.partitions", "spark.sql.sources.bucketing.maxBuckets"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", at).option("compression", "zstd").format("parquet").saveAsTable(name)
    path = _path(spark, at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.table(name)
    out._maskframe_at, out._maskframe_table = at, name
    return out


def _path(spark: SparkSession, at: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)


def spent(*frames: DataFrame) -> None:
    """Deletes the folders of materialised frames that nothing reads any more."""
    for df in frames:
        own = vars(df)
        if "_maskframe_table" in own:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {own['_maskframe_table']}")
        if "_maskframe_at" in own:
            path = _path(df.sparkSession, own["_maskframe_at"])
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def files_for(rows: int, each: int = 250_000) -> int:
    """Files for narrow rows, so that a small frame isn't scattered over as many files as there are shuffle partitions."""
    return max(8, -(-rows // each))


def split_like(df: DataFrame, source: DataFrame) -> DataFrame:
    """df, which holds no more than source, in no more partitions than the files of source are read in."""
    return df.coalesce(max(8, source.rdd.getNumPartitions()))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _plain_scan(df: DataFrame) -> bool:
    """Whether each row of df is one row of a Parquet file, whichever way the files are split."""
    if not hasattr(df, "_jdf"):
        return False
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View") and plan.deterministic():
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = plan.relation().location().rootPaths()
    return plan.relation().fileFormat().toString() == "Parquet" and roots.distinct().size() == roots.size()


def placed(df: DataFrame) -> tuple[DataFrame, str, str]:
    """df with two more columns, and their names: a hash of the file that a row lies in, and its number there. They tell rows apart,
    and stay the same however often, and in whatever splits, the files are read. What isn't a plain scan of Parquet files is
    copied to the shared folder first."""
    df = df if _plain_scan(df) else materialize(df, "input")
    file, row = fresh(df, "file", "row")
    meta = df.metadataColumn("_metadata")
    return df.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(row)), file, row


# ---- vectorised word and shingle hashes ---------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (wraps)."""
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int, salt: int) -> np.ndarray:
    """At least n pseudo-random odd multipliers, one for each byte position in a word."""
    key = f"p{salt}"
    have = _TABLES.get(key)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = _TABLES[key] = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)
    return have


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: bytes, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of data, A-Z folded, in order; the byte offsets at which they start).

    Each byte is weighted by a random odd multiplier of its place in the word, so a hash is a multilinear sum, then mixed
    with the length."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = ends - starts
    total = int(length.sum())
    first = np.cumsum(length) - length
    place = np.arange(total, dtype=np.int64) - np.repeat(first, length)
    value = (_FOLD[raw[inside]].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()), salt)[place]
    return mix64(np.add.reduceat(value, first) + length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), starts


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer than k words, of the whole sequence as one."""
    if not len(words):
        return words
    n = len(words)
    step = min(k, n)
    out = np.zeros(n - step + 1, np.uint64)
    for i in range(step):
        out = out * np.uint64(0xE7037ED1A0B428DB) + words[i : n - step + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out + np.uint64(step)))


_HELD: dict = {}


def trim() -> None:
    """Gives back to the system what the allocators of a Python worker hold unused."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in glibc
    if give is not None:
        give(0)


def held(key: tuple, make):
    """What a Python worker keeps between tasks under key. Only one operator's cache is kept: workers live on from stage to stage, and caches
    of several operators would add up."""
    if key not in _HELD:
        _HELD.clear()
        trim()
        _HELD[key] = make()
    return _HELD[key]


def lean(run):
    """run, a function over the frames or batches of a task, with the memory that it has freed given back at the end."""

    def trimmed(frames):
        yield from run(frames)
        trim()

    return trimmed


def slices(arrow_batches, column: str, limit: int = 4 << 20):
    """Consecutive slices of Arrow batches with about limit bytes in column, one row at least, so that Python objects are made of a slice
    only."""
    for b in arrow_batches:
        per_row = max(1, b[column].get_total_buffer_size() // max(1, b.num_rows))
        step = max(1, min(b.num_rows, limit // per_row))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def text_bytes(text) -> bytes:
    """UTF-8 of a text that may be null or hold lone surrogates."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def batches(rows: list, weight, limit: int):
    """Consecutive slices of rows whose weights sum to limit at most, one row at least."""
    now, have = [], 0
    for row in rows:
        w = weight(row)
        if now and have + w > limit:
            yield now
            now, have = [], 0
        now.append(row)
        have += w
    if now:
        yield now
