"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its distinct k-word shingles; documents are linked if the Jaccard similarity of their sets is at least
a threshold. Documents with equal sets form a class with one representative. A representative's signature has 32 symbols of b = 16
bits for the index and 96 more of 8 bits for a closer estimate.

The index splits the 32 symbols into 8 chunks of 4 and allows one wrong symbol in a chunk: by pigeonhole two signatures that
differ in at most 15 symbols have a chunk with at most one wrong symbol, so they share one of the 32 keys (chunk, omitted symbol,
other three symbols). At similarity 0.8 a pair differs in over 15 symbols once in 7000 cases, and shares no key once in a
million.

Pairs in a bucket are never written out. First each bucket's members are compared with its first member only; confirmed links
give components. Buckets that still hold several components then have the pairs across these components compared by the full
signatures, in blocks of BLOCK members, each pair in its first common bucket only; those whose estimate leaves the
threshold possible are confirmed on full sets where they stand. Pairs within a component need no more links. So components are those of all
links between pairs that share a key, less pairs whose 128-symbol estimate lies over SLACK below the threshold (7 standard deviations: once
in 10^11 pairs, a hundred thousandth of what the keys miss).

Signatures and texts are dealt out by row once, into a bucketed table; later steps read it in place, so only what has a candidate partner
is shuffled again.

Defined results: texts without words have an empty set and are linked with nothing; with fewer than k words the whole sequence
is one shingle; repeated rows and equal texts are one class; null ids are never a component's smallest id, unless all are null (then
the component's id is null); an empty table gives no rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.common import batches, bucketed, files_for, held, lean, materialize, mix64, placed, shingle_hashes, slices, spent, split_like, text_bytes, word_hashes
from maskframe.llm.graph import components

SYMBOLS, CHUNK = 32, 4
EXTRA = 96
#: Members of a bucket that are compared in one go.
BLOCK = 2048
#: What an estimate from 128 symbols may lie under the threshold: 7 standard deviations at 0.8.
SLACK = 0.25

_A = (mix64(np.arange(1, SYMBOLS + EXTRA + 1, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_B = (mix64(np.arange(1001, SYMBOLS + EXTRA + 1001, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> list[bytes]:
    """For each non-empty set: 32 symbols of 16 bits, then 96 of 8 bits."""
    if not sets:
        return []
    flat = np.concatenate(sets)
    x = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    first = np.cumsum([0, *map(len, sets[:-1])])
    low = np.empty((len(sets), SYMBOLS + EXTRA), np.uint32)
    for p in range(SYMBOLS + EXTRA):
        low[:, p] = np.minimum.reduceat(x * _A[p] + _B[p], first)
    low ^= low >> np.uint32(15)
    main, more = low[:, :SYMBOLS].astype("<u2"), low[:, SYMBOLS:].astype(np.uint8)
    return [m.tobytes() + e.tobytes() for m, e in zip(main, more, strict=True)]


def unpack(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, 2 * SYMBOLS + EXTRA)
    return np.ascontiguousarray(raw[:, : 2 * SYMBOLS]).view("<u2"), raw[:, 2 * SYMBOLS :]


def keys_of(main: np.ndarray) -> np.ndarray:
    """The 32 index keys of each signature: chunk, omitted symbol and the other three symbols, exactly."""
    out = np.empty((len(main), SYMBOLS), np.int64)
    for c in range(SYMBOLS // CHUNK):
        part = main[:, c * CHUNK : (c + 1) * CHUNK].astype(np.int64)
        for e in range(CHUNK):
            others = [part[:, i] for i in range(CHUNK) if i != e]
            out[:, c * CHUNK + e] = ((((c * CHUNK + e) << 16 | others[0]) << 16) | others[1]) << 16 | others[2]
    return out


def sign(docs: DataFrame, k: int, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, c1, c2 (128-bit hash of the set), sig, ztext (compressed text) and the long columns carry of each row."""

    def run(frames):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        held(("minhash",), dict)  # drops what an earlier stage has cached
        for b in slices(frames, "text", 2 << 20):
            texts = [text_bytes(t) for t in b["text"].to_pylist()]
            sets = [shingle_hashes(word_hashes(t)[0], k) for t in texts]
            with np.errstate(over="ignore"):
                c1 = [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                c2 = [int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            sigs = iter(signatures([s for s in sets if len(s)]))
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64())]
            columns += [pa.array([next(sigs) if len(s) else b"" for s in sets], pa.binary()), pa.array([packer.compress(t) if len(s) else b"" for t, s in zip(texts, sets, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns, *(b[f"carry{i}"] for i in range(len(carry)))], names=["doc_id", "n", "c1", "c2", "sig", "ztext", *(f"carry{i}" for i in range(len(carry)))])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)))
    return narrow.mapInArrow(lean(run), "doc_id long, n long, c1 long, c2 long, sig binary, ztext binary" + "".join(f", carry{i} long" for i in range(len(carry))))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def estimate(main_a, extra_a, main_b, extra_b) -> np.ndarray:
    return ((main_a == main_b).sum(-1) + (extra_a == extra_b).sum(-1)) / (SYMBOLS + EXTRA)


class _Sets:
    """Shingle sets of compressed texts, the latest kept up to limit hashes in all."""

    def __init__(self, k: int, limit: int = 16 << 20):
        import zstandard

        self.k, self.limit, self.unpacker, self.have, self.size = k, limit, zstandard.ZstdDecompressor(), OrderedDict(), 0

    def get(self, uid: int, ztext: bytes) -> np.ndarray:
        if uid in self.have:
            self.have.move_to_end(uid)
        else:
            new = self.have[uid] = shingle_hashes(word_hashes(self.unpacker.decompress(ztext))[0], self.k)
            self.size += len(new)
            while self.size > self.limit and len(self.have) > 2:
                self.size -= len(self.have.popitem(last=False)[1])
        return self.have[uid]


def confirm(stars: DataFrame, texts: DataFrame, k: int, percent: int, files: int | None = None) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar. texts: uid, sig, ztext.

    The texts of all b travel to their a, in groups of BLOCK on average, so neither a frequent a nor its text is gathered in one task."""
    sizes = materialize(stars.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"), "sizes", files)
    dealt = stars.join(sizes, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("blocks")), F.lit(0)).cast("int").alias("part"))
    wanted = dealt.select(F.col("b").alias("uid"), "a", "part", F.lit(1).alias("place")).unionByName(dealt.select(F.col("a").alias("uid"), "a", "part", F.lit(0).alias("place")).distinct())
    rows = texts.join(wanted, "uid").select("a", "part", "place", "uid", "sig", "ztext").repartition(*([files] if files else []), "a", "part").sortWithinPartitions("a", "part", "place")
    least = percent / 100 - SLACK

    def run(frames):
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        full = lambda z: shingle_hashes(word_hashes(unpacker.decompress(z))[0], k)
        center = None
        for batch in slices(frames, "ztext", 2 << 20):
            a, uid, place, z = (batch[c].to_pylist() for c in ("a", "uid", "place", "ztext"))
            main, extra = unpack(batch["sig"].to_pylist())
            out = []
            for i in range(len(a)):
                if not place[i]:
                    center, main_a, extra_a = full(z[i]), main[i].copy(), extra[i].copy()
                elif estimate(main[i], extra[i], main_a, extra_a) >= least and similar(center, full(z[i]), percent):
                    out.append((a[i], uid[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long")


def across(members: pd.DataFrame, percent: int) -> list[tuple[int, np.ndarray]]:
    """For members of one bucket (columns key, uid, comp, sig, half): (place, later places) of those in different components that may be
    similar, each pair in its first common bucket only. half: 0 and 1 for the two blocks of a pair of blocks, 2 for one block with itself."""
    at = int(members["key"].iloc[0]) >> 48
    uid, comp, half = (members[c].to_numpy(np.int64) for c in ("uid", "comp", "half"))
    main, extra = unpack(members["sig"].tolist())
    keys = keys_of(main)
    out = []
    least = percent / 100 - SLACK
    for i in range(len(uid)):
        if half[i] == 1:
            continue
        later = np.flatnonzero((comp != comp[i]) & ((half == 1) if half[i] == 0 else (uid > uid[i])))
        if not len(later):
            continue
        later = later[~(keys[later, :at] == keys[i, :at]).any(1)]
        later = later[estimate(main[later], extra[later], main[i], extra[i]) >= least]
        if len(later):
            out.append((i, later))
    return out


def _groups(frames):
    """The rows of each (key, i, j) in turn, from frames ordered by them."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        if not len(f):
            continue
        last = f.iloc[-1]
        open_ = ((f["key"] == last["key"]) & (f["i"] == last["i"]) & (f["j"] == last["j"])).to_numpy()
        rest = f[open_]
        for _, g in f[~open_].groupby(["key", "i", "j"], sort=False):
            yield g
    if rest is not None:
        yield rest


def cross_links(buckets: DataFrame, texts: DataFrame, k: int, percent: int, files: int | None = None) -> DataFrame:
    """Confirmed links between components, as pairs (a, b) of these. buckets: key, uid, comp, only keys with several components.

    Pairs never become rows. The first pass finds by signatures which members of a bucket have a partner at all; only these get their
    texts, and the second pass compares and confirms pairs inside a bucket's blocks. A block's members that have been linked meanwhile
    aren't compared again."""
    sizes = materialize(buckets.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "sizes", files)
    rows = buckets.join(sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    # A member goes to every pair of blocks that holds its own; with one block that is one row.
    rows = rows.select("key", "uid", "comp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", "uid", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).cast("int").alias("half"))
    columns = ["key", "i", "j", "uid", "comp", "half"]

    def dealt(df):
        # By a number, as comparing takes longer than the size of the rows tells.
        return df.repartition(*([files] if files else []), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def partnered(frames):
        for g in _groups(frames):
            if g["comp"].nunique() > 1:
                found = across(g, percent)
                if found:
                    places = np.unique(np.concatenate([[i for i, _ in found], *(j for _, j in found)]))
                    yield g.iloc[places][columns]

    some = materialize(dealt(texts.select("uid", "sig").join(rows, "uid")).select(*columns, "sig").mapInPandas(lean(partnered), "key long, i int, j int, uid long, comp long, half int"), "partnered", files)

    def confirmed(frames):
        for g in _groups(frames):
            sets = _Sets(k)
            uid, z = g["uid"].tolist(), g["ztext"].tolist()
            told = g["comp"].to_numpy(np.int64)
            comp = told.copy()
            out = []
            for i, later in across(g, percent):
                for j in later.tolist():
                    if comp[i] != comp[j] and similar(sets.get(uid[i], z[i]), sets.get(uid[j], z[j]), percent):
                        out.append((told[i], told[j]))
                        comp[comp == comp[j]] = comp[i]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    links = dealt(texts.select("uid", "sig", "ztext").join(some, "uid")).select(*columns, "sig", "ztext").mapInPandas(lean(confirmed), "a long, b long")
    links = materialize(links, "links", files)
    spent(some)
    return links


def link(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """uid, doc_id, n, comp and the long columns carry (as carry0, ...) for each row of docs: rows with equal comp are linked, directly or by
    others."""
    texts = bucketed(sign(docs, k, id_col, text_col, carry).withColumn("uid", F.monotonically_increasing_id()), "signed", "uid")
    n = texts.count()
    files, heavy = files_for(n), files_for(n, 8_000)  # heavy: keys, of which a row has 32, and what carries texts or compares them
    some = texts.where("n > 0")
    # What is counted by a key is written before it is joined back on that key: then Spark can split the rows of a frequent one.
    classes = some.groupBy("c1", "c2", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size")
    classes = materialize(classes, "classes", files)
    columns = ["uid", "doc_id", "n", *(f"carry{i}" for i in range(len(carry)))]
    members = materialize(texts.select(*columns, "c1", "c2").join(classes, ["c1", "c2", "n"], "left").select(*columns, F.coalesce("rep", "uid").alias("rep")), "members", files)
    reps = members.where("n > 0 and uid = rep").select("uid")

    def index(frames):
        for b in frames:
            if b.num_rows:
                keys = keys_of(unpack(b["sig"].to_pylist())[0])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b["uid"].to_numpy(), SYMBOLS))], names=["key", "uid"])

    table = some.select("uid", "sig").join(reps, "uid", "left_semi").mapInArrow(lean(index), "key long, uid long")
    full = materialize(table.groupBy("key").agg(F.count("*").alias("size"), F.min("uid").alias("first")).where("size > 1").select("key", "first"), "full", heavy)
    shared = materialize(table.join(full, "key"), "shared", heavy)
    stars = shared.where("uid <> first").select(F.col("first").alias("a"), F.col("uid").alias("b")).distinct()
    found = materialize(confirm(stars, some, k, percent, heavy), "links", heavy)
    known = components(found, heavy)
    at = shared.select("key", "uid").join(known.select(F.col("node").alias("uid"), F.col("root").alias("comp")), "uid", "left").select("key", "uid", F.coalesce("comp", "uid").alias("comp"))
    mixed = at.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    mixed = materialize(mixed, "mixed", heavy)
    buckets = materialize(at.join(mixed, "key"), "buckets", heavy)
    more = cross_links(buckets, some, k, percent, heavy)
    joined = components(more, heavy)
    spent(texts, classes, full, shared, found, mixed, buckets, more)
    out = members.join(known.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("comp", F.coalesce("root", "rep"))
    out = out.drop("root").join(joined.select(F.col("node").alias("comp"), "root"), "comp", "left")
    out = materialize(out.select(*columns, F.coalesce("root", "comp").alias("comp")), "linked", files)
    spent(members, known, joined)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    rows = link(docs, k, percent, id_col, text_col)
    files = files_for(rows.count())
    small = materialize(rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).where("size > 1").select("comp", "component_id"), "small", files)
    out = rows.join(small, "comp", "left").withColumn("component_id", F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.coalesce(files).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one of each group of linked documents, all columns unchanged. The one that stays has the smallest id
    (nulls last), of equal ids the first in place."""
    told, file, row = placed(docs)
    rows = link(told, k, percent, id_col, text_col, (file, row))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("carry0"), F.col("carry1"))
    first = rows.groupBy("comp").agg(F.min(rank).alias("stays"), F.count("*").alias("size")).where("size > 1").select("comp", "stays")
    first = materialize(first, "stay", files_for(rows.count()))
    gone = rows.join(first, "comp").where(rank != F.col("stays")).select("carry0", "carry1")
    stay = told.join(gone, (told[file] == gone["carry0"]) & (told[row] == gone["carry1"]), "left_anti")
    return split_like(stay.select(*(told[f"`{c}`"] for c in told.columns[:-2])), told)
