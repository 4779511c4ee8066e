"""Best-fit packing: pattern packing by non-negative least squares.

Texts are tokenised and cut into pieces of max_len tokens at most. Patterns of two or three piece lengths that fill a sequence
exactly are enumerated, non-negative repeat counts are fitted to the histogram of lengths, rounded and capped by what is
there; the residual is packed by best fit over counts, longest first. The fit sees the histogram only (max_len numbers), so its
cost doesn't depend on the number of documents.

Each piece then takes a place: its rank among the pieces of its length, which is a rank within a salted group plus the sizes
of the groups before, so that no group grows with a frequent length. Places are looked up in the pattern table, which has a row for each
length in each pattern in use; there are at most max_len^2 / 12 patterns, and best fit adds a few for each length.

Defined results: a null or empty text is one piece that holds the end token alone; null ids and repeated rows are packed like
any other row; an empty table gives no rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import bisect
import math
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskframe.llm.bpe import CACHE_PARTS, bpe
from maskframe.llm.common import files_for, lean, materialize, slices

ITERATIONS = 400
PIECES_PER_SALT = 100_000


def patterns(max_len: int, present: np.ndarray) -> np.ndarray:
    """All (i, j, k) with i <= j <= k, i + j + k = max_len and every length present; i = 0 marks a pair."""
    i = np.arange(0, max_len // 3 + 1)
    j = np.arange(1, max_len // 2 + 1)
    i, j = (x.ravel() for x in np.meshgrid(i, j, indexing="ij"))
    k = max_len - i - j
    ok = (i <= j) & (j <= k)
    i, j, k = i[ok], j[ok], k[ok]
    ok = ((i == 0) | present[i]) & present[j] & present[k]
    return np.stack([i[ok], j[ok], k[ok]], 1)


def fit_repeats(pat: np.ndarray, hist: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """argmin over x >= 0 of |A x - hist|^2 by accelerated projected gradients; column p of A counts pattern p's lengths."""
    if not len(pat):
        return np.zeros(0)
    size = len(hist)
    flat = pat.ravel()
    used = (pat > 0).astype(float)

    def forward(x):
        out = np.bincount(flat, weights=(x[:, None] * used).ravel(), minlength=size)
        out[0] = 0
        return out

    def backward(r):
        return (r[pat] * used).sum(1)

    v = np.ones(len(pat))
    for _ in range(15):
        v = backward(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * float(v @ backward(forward(v))))
    h = hist.astype(float).copy()
    h[0] = 0
    x = y = np.zeros(len(pat))
    t = 1.0
    for _ in range(iterations):
        new = np.maximum(y - step * backward(forward(y) - h), 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def best_fit(left: np.ndarray, max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs counts of lengths, longest first, each into the fullest sequences that still have room."""
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [[pattern, count], ...]
    rooms: list[int] = []

    def add(room: int, pattern: tuple[int, ...], n: int) -> None:
        if not open_[room]:
            bisect.insort(rooms, room)
        open_[room].append([pattern, n])

    for length in range(max_len, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = max_len // length
                if full := n // each:
                    add(max_len - each * length, (length,) * each, full)
                if rest := n % each:
                    add(max_len - rest * length, (length,) * rest, 1)
                break
            room = rooms[at]
            pattern, there = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            each = min(room // length, max(1, n // there))
            took = min(there, n // each)
            if took < there:
                add(room, pattern, there - took)
            add(room - each * length, pattern + (length,) * each, took)
            n -= took * each
    return [(p, n) for some in open_.values() for p, n in some]


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that use every piece of the histogram (hist[l]: pieces of length l) once."""
    max_len = len(hist) - 1
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[max_len]:
        out.append(((max_len,), int(left[max_len])))
        left[max_len] = 0
    pat = patterns(max_len, left > 0)
    x = fit_repeats(pat, left)
    # Largest counts first; a count never exceeds what is left of its lengths.
    for p in np.argsort(-x, kind="stable"):
        n = int(x[p] + 0.5)
        if not n:
            break
        lengths = [int(v) for v in pat[p] if v]
        need = defaultdict(int)
        for v in lengths:
            need[v] += 1
        n = min(n, *(int(left[v]) // c for v, c in need.items()))
        if n > 0:
            for v, c in need.items():
                left[v] -= n * c
            out.append((tuple(sorted(lengths, reverse=True)), n))
    return out + best_fit(left, max_len)


def places(chosen: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The places for each length, in order of rank: from (length, first rank) to sequence, step and offset."""
    rows = []
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in chosen:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 44) + a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def cut(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than max_len."""
    first = (n - 1) % max_len + 1
    return [(0, first), *((s, max_len) for s in range(first, n, max_len))]


def pieces(docs: DataFrame, path: str, max_len: int, end_id: int, id_col: str, text_col: str, cache_parts: int) -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32."""
    end = array("I", [end_id]).tobytes()
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(frames):
        coder = bpe(path, cache_parts)
        for b in slices(frames, "text"):
            rows, of = [], []
            for doc, text in enumerate(b["text"].to_pylist()):
                ids = coder.encode(text) + end
                view = memoryview(ids)
                for k, (s, n) in enumerate(cut(len(ids) // 4, max_len)):
                    rows.append((k, s, n, zlib.crc32(view[4 * s : 4 * (s + n)])))
                    of.append(doc)
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(of, pa.int64())), *columns], names=[id_col, "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(lean(run), f"{id_col} long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, max_len: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", cache_parts: int = CACHE_PARTS) -> DataFrame:
    """Every piece with its sequence_id and offset. cache_parts bounds a worker's cache of tokenised words; it changes no result."""
    cols = [id_col, "piece", "start", "length", "ids_crc32"]
    all_ = materialize(pieces(docs, path, max_len, end_id, id_col, text_col, cache_parts).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in all_.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    hist = np.zeros(max_len + 1, np.int64)
    for length, n in counts.items():
        hist[length] = n
    table = places(plan(hist))
    salts = max(16, math.ceil(int(hist.sum()) / PIECES_PER_SALT))
    salted = all_.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1)
    ranked = ranked.join(sizes, ["length", "salt"]).select(*cols, (F.col("before") + F.col("nth")).alias("nth"))

    def place(frames):
        for b in frames:
            rank, length = b["nth"].to_numpy(), b["length"].to_numpy()
            at = np.searchsorted(table["key"], (length << 44) + rank, side="right") - 1
            placed = [pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in cols), *placed], names=[*cols, "sequence_id", "offset"])

    # Rows are narrow: in as many parts as there are shuffle partitions a small result would be scattered over as many files.
    return ranked.coalesce(files_for(int(hist.sum()))).mapInArrow(place, f"{id_col} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
