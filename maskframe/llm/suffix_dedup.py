"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that also starts anywhere else.

Texts are UTF-8 bytes. Equal texts form a class first; a class of two or more is repeated as a whole. In each representative, every
window of LENGTH bytes picks the K-byte piece with the lowest hash (leftmost of equals); these anchors depend on the window's bytes
only, so two equal windows have the same anchor at the same place in them. Windows are therefore equal only if their anchors' pieces
are, and only anchors whose piece occurs twice or more go on, with the bytes of the windows that chose them.

The suffixes that start at such anchors, and the reversed prefixes that end there, are sorted by deep-shallow sorting: multikey
quicksort on 8-byte words, all groups of a level at once, to a shallow depth; then a blind trie orders each group that is still
tied. The sorted order with its common prefixes tells for each window which others agree to its right and to its left of the anchor; windows that
agree in both are equal. That is exact: hashes choose candidates only.

A piece with over HOT occurrences isn't gathered in one task: its windows are counted by 128-bit hashes with partial aggregation
instead. Defined results: a null or empty text has no bytes; a text under LENGTH bytes is never changed; repeated rows are equal
texts; null ids are kept as they are; an empty table gives no rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.common import files_for, fresh, held, lean, materialize, mix64, placed, slices, spent, split_like, text_bytes

LENGTH = 200
K = 48
SHALLOW = 64
HOT = 50_000
#: Windows handled at once in a long text.
CHUNK = 1 << 21

_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_CACHE: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _CACHE or len(_CACHE["p"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("p", _POWER), ("q", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _CACHE[name] = np.multiply.accumulate(a)
    return _CACHE["p"][:n], _CACHE["q"][:n]


def rolling(raw: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte pieces of raw."""
    n = len(raw)
    p, q = _powers(n)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p, out=s[1:])
    return mix64((s[k:] - s[:-k]) * q[: n - k + 1])


def anchors(raw: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places, first windows, last windows): each window of length bytes belongs to one anchor's range of windows."""
    parts = []
    total = len(raw) - length + 1
    for at in range(0, max(total, 0), CHUNK):
        windows = min(CHUNK, total - at)
        parts.append([x + (0 if i == 0 else at) for i, x in enumerate(_anchors(raw[at : at + windows + length - 1], length, k))])
    if not parts:
        return np.zeros(0, np.int64), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(raw, length, k):
    h = rolling(raw, k)
    w = length - k + 1
    n = len(h)
    low = np.uint64((1 << 24) - 1)
    packed = (h & ~low) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = packed
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & low).astype(np.int64)
    change = np.flatnonzero(np.diff(place, prepend=-1))
    return h[place[change]].view(np.int64), place[change], change, np.append(change[1:], n - w + 1) - 1


# ---- deep-shallow sorting -----------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return (8 * n - (int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length()) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(order, common prefix with the one before) by a blind trie: inner nodes hold a depth and branch on the byte there, what lies
    between isn't looked at on the way down; one comparison with the leaf reached tells where a string branches off."""
    if len(strings) == 2:
        order = [0, 1] if strings[0] <= strings[1] else [1, 0]
        return order, [0, common(*strings)]
    root = [0]  # a leaf: indexes of equal strings; an inner node: (depth, {byte: node})
    for i in range(1, len(strings)):
        s = strings[i]
        size = len(s)
        node = root
        while type(node) is tuple:
            depth, sub = node
            node = sub.get(s[depth] if depth < size else -1)
            if node is None:
                node = next(iter(sub.values()))
        t = strings[node[0]]
        at = common(s, t)
        if at == size == len(t):
            node.append(i)
            continue
        mine = s[at] if at < size else -1
        parent, via, node = None, -1, root
        while type(node) is tuple and node[0] < at:
            parent, via = node, s[node[0]]
            node = node[1][via]
        if type(node) is tuple and node[0] == at:
            node[1][mine] = [i]
            continue
        new = (at, {t[at] if at < len(t) else -1: node, mine: [i]})
        if parent is None:
            root = new
        else:
            parent[1][via] = new
    order: list[int] = []
    lcp: list[int] = []
    stack = [(root, 0)]
    while stack:
        node, before = stack.pop()
        if type(node) is list:
            lcp += [before] + [len(strings[node[0]])] * (len(node) - 1)
            order += node
            continue
        depth, sub = node
        children = [sub[c] for c in sorted(sub)]
        stack += [(c, depth) for c in children[:0:-1]]
        stack.append((children[0], before))
    return order, lcp


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix of each string with the one before it in that order) of byte strings."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").reshape(n, -1).astype(np.uint64)
    size = np.fromiter(map(len, strings), np.int64, n)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # of each place in the order: the first place of its group
    lcp = np.zeros(n, np.int64)
    for level in range(words.shape[1]):
        tied = np.zeros(n, bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        value = words[order[at], level]
        sorted_ = np.lexsort((value, group[at]))
        order[at] = order[at][sorted_]
        value = value[sorted_]
        new = np.flatnonzero((value[1:] != value[:-1]) & (group[at[1:]] == group[at[:-1]])) + 1
        if len(new):
            differ = value[new] ^ value[new - 1]
            zeros = 63 - np.floor(np.log2(differ.astype(np.float64))).astype(np.int64)
            # A float64 rounds up near a power of two; the byte it names is corrected by a look.
            byte = np.clip(zeros // 8, 0, 7)
            top = differ >> (np.uint64(56) - np.uint64(8) * byte.astype(np.uint64))
            byte = np.where(top == 0, byte + 1, byte)
            lcp[at[new]] = level * 8 + byte
            starts = group.copy()
            starts[at[new]] = at[new]
            group = np.maximum.accumulate(starts)
    edges = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
    begin = 0
    for end in edges[(np.diff(edges, prepend=0) > 1)].tolist():
        begin = int(group[end - 1])
        members = order[begin:end].tolist()
        sub, deep = blind_trie([strings[i] for i in members])
        order[begin:end] = [members[i] for i in sub]
        lcp[begin + 1 : end] = deep[1:]
    # Padding isn't text: a common prefix ends where the shorter string does.
    lcp[1:] = np.minimum(lcp[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    lcp[0] = 0
    return order, lcp


def repeated_ranges(context: list[bytes], place: np.ndarray, first: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """For records of anchors (context: bytes from the first window's begin to the last one's end; place: of the anchor in it; first: begin of
    the first window in the text) the range [low, high) of bytes that repeated windows cover; high = 0: none. Records that share a
    key must all be here."""
    n = len(context)
    right = [c[p:] for c, p in zip(context, place.tolist(), strict=True)]
    left = [c[:p][::-1] for c, p in zip(context, place.tolist(), strict=True)]
    size = np.fromiter(map(len, context), np.int64, n)
    ro, rl = deep_shallow(right)
    lo, ll = deep_shallow(left)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    least = np.maximum(place - (size - length), 0)  # windows begin at place - j for least <= j <= place
    in_right, in_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(length - k + 1):
        who = np.flatnonzero((least <= j) & (j <= place))
        if len(who) < 2:
            continue
        in_right[ro] = np.cumsum(rl < length - j)
        in_left[lo] = np.cumsum(ll < j)
        both = in_right[who] * (n + 1) + in_left[who]
        order = np.argsort(both)
        same = both[order[1:]] == both[order[:-1]]
        hit = np.zeros(len(who), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        got = who[hit]
        begin = first[got] + place[got] - j
        high[got] = np.maximum(high[got], begin + length)
        low[got] = begin  # j grows, so begins fall
    return low, high


# ---- the distributed part -----------------------------------------------------------------------------------------------


ROW = ["file", "row"]
_IDS = "file long, row long"


def repeated_spans(rows: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT, records: int = 40_000) -> tuple[DataFrame, DataFrame]:
    """rows: file, row, text, told apart by the first two. Returns (meta: file, row, n_bytes, sha, copies; spans: file, row (of the first row of
    each text), low, high)."""
    n = rows.count()
    files, heavy = files_for(n), files_for(n, 8_000)  # heavy: what carries bytes of texts
    own = F.struct(*ROW)
    told = rows.select(*ROW, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    # Written first, here and below, so that Spark can split the rows of a frequent text or key in the join.
    copies = materialize(told.groupBy("sha").agg(F.min(own).alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "copies", files)
    meta = materialize(told.join(copies, "sha", "left").select(*ROW, "n_bytes", "sha", F.coalesce("copies", F.lit(1)).alias("copies"), (F.coalesce("rep", own) == own).alias("first")), "meta", files)
    others = meta.where("not first").select(*ROW)

    def find(frames):
        held(("suffix",), dict)  # drops what an earlier stage has cached
        for b in slices(frames, "text"):
            keys = [anchors(np.frombuffer(text_bytes(t), np.uint8), length, k)[0] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["file"], b["row"], pa.array(keys, pa.list_(pa.int64()))], names=[*ROW, "keys"])

    found = rows.where(F.octet_length("text") >= length).select(*ROW, "text").mapInArrow(lean(find), f"{_IDS}, keys array<long>")
    found = materialize(found.join(others, ROW, "left_anti"), "anchors", heavy)
    keys = found.select(*ROW, F.explode("keys").alias("key"))
    twice = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", (F.col("n") > hot).alias("hot")), "twice", heavy)
    wanted = keys.join(twice, "key").groupBy(*ROW).agg(F.collect_set(F.when(~F.col("hot"), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot_keys"))

    def contexts(frames):
        for b in slices(frames, "text"):
            out, of = [], []
            for i, (text, some, frequent) in enumerate(zip(*(b[c].to_pylist() for c in ("text", "keys", "hot_keys")), strict=True)):
                data = text_bytes(text)
                key, place, first, last = anchors(np.frombuffer(data, np.uint8), length, k)
                is_hot = np.isin(key, np.asarray(frequent, np.int64))
                at = np.flatnonzero(is_hot | np.isin(key, np.asarray(some, np.int64)))
                for x, p, s, e, h in zip(key[at].tolist(), place[at].tolist(), first[at].tolist(), last[at].tolist(), is_hot[at].tolist(), strict=True):
                    out.append((x, s, p - s, data[s : e + length], h))
                    of.append(i)
                    if len(out) >= 10_000:
                        yield batch(b, out, of)
                        out, of = [], []
            if out:
                yield batch(b, out, of)

    def batch(b, out, of):
        of = pa.array(of)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([b["file"].take(of), b["row"].take(of), *(pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True))], names=[*ROW, "key", "first", "place", "context", "hot"])

    around = rows.join(wanted, ROW).select(*ROW, "text", "keys", "hot_keys").mapInArrow(lean(contexts), f"{_IDS}, key long, first long, place int, context binary, hot boolean")
    around = materialize(around, "contexts", heavy)
    spent(copies, found, twice)

    def compare(frames):
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if len(f) < records:
                rest = f
                continue
            open_ = (f["key"] == f["key"].iloc[-1]).to_numpy()
            rest = f[open_]
            yield from ranges(f[~open_])
        if rest is not None:
            yield from ranges(rest)

    def ranges(f):
        if len(f):
            low, high = repeated_ranges(f["context"].tolist(), f["place"].to_numpy(np.int64), f["first"].to_numpy(np.int64), length, k)
            out = pd.DataFrame({"file": f["file"].to_numpy(), "row": f["row"].to_numpy(), "low": low, "high": high})
            yield out[out["high"] > 0]

    plain = around.where("not hot").select(*ROW, "key", "first", "place", "context").repartition("key").sortWithinPartitions("key")
    spans = plain.mapInPandas(lean(compare), f"{_IDS}, low long, high long")
    frequent = around.where("hot")
    if not frequent.isEmpty():
        spans = spans.unionByName(_hot_spans(frequent, length, heavy))
    spans = materialize(spans, "spans", heavy)
    spent(around)
    return meta, spans


def _hot_spans(records: DataFrame, length: int, files: int | None = None) -> DataFrame:
    """Ranges of repeated windows of frequent anchors: windows are counted by 128-bit hashes, which partial aggregation sums up where they
    are, so no task gathers a piece's occurrences."""

    def windows(frames):
        for b in slices(frames, "context"):
            raws = [np.frombuffer(c, np.uint8) for c in b["context"].to_pylist()]
            raw = np.concatenate(raws)
            size = np.fromiter(map(len, raws), np.int64, len(raws))
            begin = np.cumsum(size) - size
            count = size - length + 1
            start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(begin, count) + start
            a = rolling(raw, length)[at].view(np.int64)
            c = rolling(raw[::-1].copy(), length)[::-1][at].view(np.int64)
            of = pa.array(np.repeat(np.arange(len(raws)), count))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), b["file"].take(of), b["row"].take(of), pa.array(np.repeat(b["first"].to_numpy(), count) + start)], names=["a", "b", *ROW, "low"])

    all_ = materialize(records.select(*ROW, "first", "context").mapInArrow(lean(windows), f"a long, b long, {_IDS}, low long"), "windows", files)
    twice = materialize(all_.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "twice", files)
    return all_.join(twice, ["a", "b"]).groupBy(*ROW, F.floor(F.col("low") / length).alias("part")).agg(F.sort_array(F.collect_set("low")).alias("lows")).select(*ROW, F.explode("lows").alias("low")).select(*ROW, "low", (F.col("low") + length).alias("high"))


def merge(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges that overlap or touch."""
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.append(True, low[1:] > high[:-1])
    at = np.flatnonzero(new)
    return low[at], high[np.append(at[1:], len(low)) - 1]


def kept_bytes(data: bytes, low: np.ndarray, high: np.ndarray) -> bytes:
    """data without the merged ranges."""
    edges = np.stack([np.append(0, high), np.append(low, len(data))], 1)
    return b"".join(data[a:b] for a, b in edges.tolist())


def whole_points(data: bytes, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges, narrowed to whole code points."""

    def inside(i: int) -> bool:
        return i < len(data) and data[i] & 0xC0 == 0x80

    a, b = [], []
    for x, y in zip(low.tolist(), high.tolist(), strict=True):
        while x < y and inside(x):
            x += 1
        while y > x and inside(y):
            y -= 1
        if x < y:
            a.append(x)
            b.append(y)
    return np.array(a, np.int64), np.array(b, np.int64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    told, file, row = placed(docs)
    rows = told.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(file).alias("file"), F.col(row).alias("row"))
    meta, spans = repeated_spans(rows.select(*ROW, "text"), length, k, hot)
    # Of texts that occur once, only those with a span are needed again.
    lists = spans.groupBy(*ROW).agg(F.collect_list(F.struct("low", "high")).alias("spans")).join(meta.where("copies = 1").select(*ROW), ROW, "left_semi")

    def cut(frames):
        for b in slices(frames, "text"):
            out = []
            for text, some in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
                data = text_bytes(text)
                low, high = merge(np.array([x["low"] for x in some], np.int64), np.array([x["high"] for x in some], np.int64))
                out.append((int((high - low).sum()), len(low), hashlib.sha256(kept_bytes(data, low, high)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b["file"], b["row"], *(pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True))], names=[*ROW, "removed", "runs", "left_sha"])

    changed = rows.join(lists, ROW).select(*ROW, "text", "spans").mapInArrow(lean(cut), f"{_IDS}, removed long, runs long, left_sha string")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = split_like(rows.select(*ROW, "doc_id").join(meta, ROW).join(changed, ROW, "left"), told)
    return out.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"), F.when(whole, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    )


def clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """docs with repeated spans cut out of their texts, narrowed to whole code points, and chars_col (if there) counted anew. A null text stays
    null."""
    told, file, row = placed(docs)
    rows = told.select(F.col(file).alias("file"), F.col(row).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    meta, spans = repeated_spans(rows, length, k, hot)
    (named,) = fresh(docs, "spans")
    whole = meta.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select(*ROW, F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n_bytes").alias("high"))).alias(named))
    lists = spans.groupBy(*ROW).agg(F.collect_list(F.struct("low", "high")).alias(named)).join(meta.where("copies = 1").select(*ROW), ROW, "left_semi")
    cuts = lists.unionByName(whole)
    joined = told.join(cuts, (told[file] == cuts["file"]) & (told[row] == cuts["row"]), "left").select(*(told[f"`{c}`"] for c in docs.columns), cuts[named])
    joined = split_like(joined, told)

    def cut(batches):
        for b in slices(batches, text_col):
            names = b.schema.names
            texts = b.column(text_col).to_pylist()
            for i, some in enumerate(b.column(named).to_pylist()):
                if some and texts[i] is not None:
                    data = text_bytes(texts[i])
                    low, high = merge(np.array([x["low"] for x in some], np.int64), np.array([x["high"] for x in some], np.int64))
                    texts[i] = kept_bytes(data, *whole_points(data, low, high)).decode("utf-8", "replace")
            columns = [b.column(c) for c in names[:-1]]
            at = names.index(text_col)
            columns[at] = pa.array(texts, columns[at].type)
            if chars_col in names[:-1]:
                c = names.index(chars_col)
                columns[c] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns[c].to_pylist(), strict=True)], columns[c].type)
            yield pa.RecordBatch.from_arrays(columns, names=names[:-1])

    return joined.mapInArrow(lean(cut), docs.schema)
