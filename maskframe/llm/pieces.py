"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces of a public vocabulary span a lattice over each word (its leading space included). A piece of rank r weighs (r + 1) to the
power -1 / temperature. The forward pass sums the weights of all ways to each place; the backward pass draws the last piece from
these sums, then the one before it, and so on: an exact sample of all segmentations. Random numbers are a hash of the row key, the
word's number and the step, so a row's sample is the same in every run and partition. A character without a piece of its own falls
back to its UTF-8 bytes, and a literal U+2581 does too, so decoding gives back the text, every space and line end included.

Lattices are built for all unseen words of a batch at once and cached. Sums are kept as logarithms, so a word may be of any length, up to
a whole text without a space.

Defined results: a null or empty text has no pieces and decodes to the empty text; lone surrogates become question marks; a null key
has seed 0; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored; texts of any length are
encoded whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.common import batches, held, lean, mix64, slices

#: A worker drops its lattices when they have more edges than this: 16 bytes an edge and about 150 a word, so some 130 MB.
CACHE_EDGES = 4_000_000
FALLBACK_WEIGHT = 1e-7
_STEP = np.uint64(0xD1342543DE82EF95)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(1 << 63)


class Trie:
    """The pieces as a trie whose edges (state, character) -> state lie in one open-addressed table."""

    BITS = 20

    def __init__(self, pieces: dict[str, int]):
        states: dict[str, int] = {"": 0}
        for piece in pieces:
            for n in range(1, len(piece) + 1):
                states.setdefault(piece[:n], len(states))
        self.piece = np.full(len(states), -1, np.int64)
        for piece, i in pieces.items():
            self.piece[states[piece]] = i
        bits = max(self.BITS, (4 * len(states)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys = np.array([states[p[:-1]] << 21 | ord(p[-1]) for p in states if p], np.int64)
        values = np.array([i for p, i in states.items() if p], np.int64)
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        slot = self._slot(keys)
        while len(keys):  # those that find their slot taken go one further
            free = self.key[slot] < 0
            self.key[slot[free]] = keys[free]
            put = self.key[slot] == keys
            self.value[slot[put]] = values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLD) >> self.shift).astype(np.int64)

    def follow(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next states, -1 where no piece goes on."""
        keys = states << 21 | chars
        slot = self._slot(keys)
        there = self.key[slot]
        out = np.where(there == keys, self.value[slot], -1)
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & self.mask
            there = self.key[slot[on]]
            hit = there == keys[on]
            out[on[hit]] = self.value[slot[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out


class Lattices:
    def __init__(self, model: str, temperature: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_id = np.zeros(256, np.int64)
        self.text = [b""] * size
        for i in range(size):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[b] = i
                self.text[i] = bytes([b])
        spelt = {i: sp.id_to_piece(i).replace("\u2581", " ") for i in plain}
        weight = np.zeros(size)
        for rank, i in enumerate(plain):
            self.text[i] = spelt[i].encode()
            weight[i] = (rank + 1.0) ** (-1 / temperature)
        self.log_weight = np.log(np.maximum(weight / weight.sum(), 1e-300))
        self.trie = Trie({p: i for i, p in spelt.items() if p})
        self.clear()

    #: What sampling reads: for each edge the summed probability (of 2^63) up to it among the edges into its node, its piece, and the first
    #: edge into the node that it comes from, -1 where a word begins. end: the first edge into the last node of each word.
    ARRAYS = {"end": np.int64, "share": np.uint64, "piece": np.int32, "before": np.int32}

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.edges = 0
        self.used = dict.fromkeys(self.ARRAYS, 0)
        for name, kind in self.ARRAYS.items():
            setattr(self, name, np.zeros(1 << 12, kind))

    def _append(self, new: tuple) -> None:
        """Adds to the arrays, whose room grows by half when it is used up."""
        for name, part in zip(self.ARRAYS, new, strict=True):
            have, n = getattr(self, name), self.used[name]
            if n + len(part) > len(have):
                have = np.concatenate([have[:n], np.zeros(max(len(part), n // 2), have.dtype)])
                setattr(self, name, have)
            have[n : n + len(part)] = part
            self.used[name] = n + len(part)

    def learn(self, words: set[str]) -> None:
        if self.edges > CACHE_EDGES:
            self.clear()
        missing = sorted(words.difference(self.index), key=len, reverse=True)
        for some in batches(missing, len, 200_000):
            n = len(self.index)
            self._append(self._build(some))
            self.index.update(zip(some, range(n, n + len(some)), strict=True))

    def _build(self, words: list[str]) -> tuple:
        """The lattices of words, longest first. The nodes (and characters) of all words at the same place are neighbours: node (word, place)
        has the number base[place] + word, so edges sorted by the node they end in are sorted by place too."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(size[0])
        alive = np.searchsorted(-size, -np.arange(longest + 1), side="right")  # words that reach a place
        base = np.cumsum(alive) - alive
        text = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        place = np.repeat(np.arange(longest), alive[1:])  # of each character but in the order of nodes
        word = np.arange(len(text)) - (base[1:] - alive[0])[place]
        first = np.cumsum(size) - size
        begin = first[word] + place  # in text
        start, end, piece = [], [], []
        live, state = np.arange(len(text)), np.zeros(len(text), np.int64)
        single = np.zeros(len(text), bool)
        n = 0
        while len(live):
            state = self.trie.follow(state, text[begin[live] + n])
            n += 1
            live, state = live[state >= 0], state[state >= 0]
            got = self.trie.piece[state]
            at = live[got >= 0]
            start.append(base[place[at]] + word[at])
            end.append(base[place[at] + n] + word[at])
            piece.append(got[got >= 0])
            if n == 1:
                single[at] = True
            on = begin[live] + n < (first + size)[word[live]]
            live, state = live[on], state[on]
        other = np.flatnonzero(~single)
        start.insert(0, base[place[other]] + word[other])
        end.insert(0, base[place[other] + 1] + word[other])
        piece.insert(0, -1 - text[begin[other]])
        start, end, piece = (np.concatenate(x[::-1]) for x in (start, end, piece))  # the longest first, as they are the likeliest
        order = np.argsort(end, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        weight = np.where(piece >= 0, self.log_weight[np.maximum(piece, 0)], math.log(FALLBACK_WEIGHT))
        opens = np.flatnonzero(np.diff(end, prepend=-1))  # one for each node but the words' first ones, in their order
        runs = np.diff(np.append(opens, len(end)))
        alpha = np.zeros(int(base[-1] + alive[-1]))
        odds = np.empty(len(end))
        cuts = np.append(opens, len(end))[base[1:] - alive[0]].tolist() + [len(end)]
        node = 0
        for p in range(longest):  # forward filtering, all words at once
            a, b, k = cuts[p], cuts[p + 1], int(alive[p + 1])
            way = alpha[start[a:b]] + weight[a:b]
            heads, each = opens[node : node + k] - a, runs[node : node + k]
            top = np.maximum.reduceat(way, heads)
            way = np.exp(way - np.repeat(top, each))
            total = np.add.reduceat(way, heads)
            alpha[base[p + 1] : base[p + 1] + k] = top + np.log(total)
            odds[a:b] = way / np.repeat(total, each)
            node += k
        share = np.cumsum(odds)
        share -= np.repeat(share[opens] - odds[opens], runs)
        share = (np.minimum(share, 1.0) * 2.0**63).astype(np.uint64)
        share[opens + runs - 1] = _LAST
        into = np.append(np.full(alive[0], -1), opens + self.edges)  # the first edge of each node
        ends = into[base[size] + np.arange(len(words))]
        self.edges += len(end)
        return ends, share, piece.astype(np.int32), into[start].astype(np.int32)

    def sample(self, words: np.ndarray, seeds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece or -1 - code point in text order, how many each word has), for occurrences of cached words."""
        edge = self.end[words]
        who = np.arange(len(words))
        count = np.zeros(len(words), np.int64)
        got = []
        with np.errstate(over="ignore"):
            state = mix64(seeds + numbers.astype(np.uint64) * _GOLD)
            while len(who):
                u = state >> np.uint64(1)
                on = np.flatnonzero(u >= self.share[edge])
                while len(on):
                    edge[on] += 1
                    on = on[u[on] >= self.share[edge[on]]]
                got.append((who, self.piece[edge]))
                count[who] += 1
                edge = self.before[edge]
                on = np.flatnonzero(edge >= 0)
                edge, who, state = edge[on].astype(np.int64), who[on], state[on] * _STEP + _GOLD
        out = np.empty(int(count.sum()), np.int32)
        last = np.cumsum(count) - 1
        for step, (who, piece) in enumerate(got):
            out[last[who] - step] = piece
        return out, count


def words_of(text: str) -> list[str]:
    """Words with their leading space."""
    first, *rest = text.split(" ")
    rest = [" " + w for w in rest]
    return [first, *rest] if first else rest


def clean(text) -> str:
    if not isinstance(text, str):
        return ""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()
    return text


def seed(key: int | None) -> int:
    return 0 if key is None else key & ((1 << 64) - 1)


def lattices(model: str, temperature: float) -> Lattices:
    return held(("lattices", model, temperature), lambda: Lattices(model, temperature))


def encode(texts: list, keys: list, model: str, temperature: float = 1.0) -> list[np.ndarray]:
    """Sampled piece ids of each text."""
    lat = lattices(model, temperature)
    out: list[np.ndarray] = []
    for part in batches([(clean(t), seed(k)) for t, k in zip(texts, keys, strict=True)], lambda r: len(r[0]), 500_000):
        split = [words_of(t) for t, _ in part]
        lat.learn(set().union(*split))
        size = np.fromiter(map(len, split), np.int64, len(split))
        total = int(size.sum())
        at = np.fromiter(map(lat.index.__getitem__, chain.from_iterable(split)), np.int64, total)
        seeds = mix64(np.array([s for _, s in part], np.uint64) ^ _GOLD)
        first = np.cumsum(size) - size
        pieces, count = lat.sample(at, np.repeat(seeds, size), np.arange(total) - np.repeat(first, size))
        cuts = np.append(0, np.cumsum(count))[np.append(first, total)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ids = pieces[a:b]
            if len(ids) and ids.min() < 0:
                full: list[int] = []
                for i in ids.tolist():
                    full += [i] if i >= 0 else lat.byte_id[list(chr(-1 - i).encode())].tolist()
                ids = np.array(full, np.int32)
            out.append(ids)
    return out


def decode(ids, model: str, temperature: float = 1.0) -> str:
    return b"".join(map(lattices(model, temperature).text.__getitem__, np.asarray(ids).tolist())).decode("utf-8")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def sample(docs: DataFrame, model: str, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, pieces (array of ids) for each row."""

    def run(frames):
        for b in slices(frames, "text"):
            ids = encode(b["text"].to_pylist(), b["id"].to_pylist(), model, temperature)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "pieces"])

    return _narrow(docs, id_col, text_col).mapInArrow(lean(run), f"{id_col} long, pieces array<int>")


def restore(sampled: DataFrame, model: str, temperature: float = 1.0, id_col: str = "doc_id") -> DataFrame:
    """id_col, text from the pieces that sample() gives."""

    def run(frames):
        for b in slices(frames, "pieces"):
            texts = [decode(p, model, temperature) for p in b["pieces"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(texts, pa.string())], names=[id_col, "text"])

    return sampled.select(F.col(id_col).cast("long").alias("id"), "pieces").mapInArrow(lean(run), f"{id_col} long, text string")


def round_trip(docs: DataFrame, model: str, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, n_pieces, pieces_crc32 (of the ids as little-endian 32-bit integers), decoded_chars, decoded_sha256 of the text that
    decoding gives back. Encoding and decoding run in one pass, so ids never leave the worker."""

    def run(frames):
        for b in slices(frames, "text"):
            rows = []
            for ids in encode(b["text"].to_pylist(), b["id"].to_pylist(), model, temperature):
                back = decode(ids, model, temperature)
                rows.append((len(ids), zlib.crc32(ids.astype("<i4").tobytes()), len(back), hashlib.sha256(back.encode()).hexdigest()))
            columns = [b["id"], *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_pieces", "pieces_crc32", "decoded_chars", "decoded_sha256"])

    return _narrow(docs, id_col, text_col).mapInArrow(lean(run), f"{id_col} long, n_pieces long, pieces_crc32 long, decoded_chars long, decoded_sha256 string")
