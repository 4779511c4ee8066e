"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: compatibility forms, accents of letters that stand in for ASCII, look-alike letters of other scripts,
digits and signs used as letters. The lexicon holds word beginnings (stems) with log-odds weights learnt from labelled rows,
and exception phrases: word pairs around a stem that mostly occur in rows labelled 0. A score is a logistic function of the
matched weight, normalised by a slowly growing function of the text's length.

Learning reads a bounded sample of labelled rows with their whole texts (SAMPLE_ROWS rows of SAMPLE_CHARS characters together; all rows
when fewer). These are the only bounds: every stem and exception that stands out in the sample is used. Scoring reads every whole text. Defined results: a null or empty text scores as a text without a match; null labels are never learnt
from; without any labelled row all texts score the base rate 0; repeated rows give repeated results; extra columns never matter.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.common import held, lean, slices

#: Labelled rows that the lexicon is fitted on at most, chosen by a hash of doc_id.
SAMPLE_ROWS = 12_000
#: Characters that the sample's texts have together at most: rows are taken in the order of the hash, whole, up to the first
#: that doesn't fit in what is left. A text that is longer than that by itself is never taken.
SAMPLE_CHARS = 40_000_000
STEM_MIN, STEM_MAX = 4, 9

#: Digits and signs used as letters, and look-alikes of other scripts.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
LOOK = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "г": "r", "п": "n", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "η": "n", "ß": "ss", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}

_CLASS = "".join(re.escape(c) for c in LEET)
#: A run of letters with at most signs and digits among them; a sign or digit counts as a letter only next to one.
_LEETED = re.compile(rf"(?:(?<=[^\W\d_])[{_CLASS}]+(?=[^\W\d_]))|(?:(?<!\w)[0-9@$](?=[^\W\d_]{{2}}))")
_ASCII_FOLD = str.maketrans(LEET)
_INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_LOOK_ALIKE = re.compile(f"[{''.join(LOOK)}]")
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489]+")
_ANY_LEET = re.compile(f"[{_CLASS}]")
_BREAKS = re.compile(r"(?:[^\w ]|_)+")
_ASCII_BREAKS = {i: " " for i in range(128) if not chr(i).isalnum()}


def fold(text: str) -> str:
    """Lower case, NFKD without marks, look-alikes and digit substitutions undone, words separated by one space, and one
    space at either end."""
    if not text.isascii():
        if _INVISIBLE.search(text):
            text = _INVISIBLE.sub("", text)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()
        if not text.isascii():
            text = _LOOK_ALIKE.sub(lambda m: LOOK[m[0]], text)
    else:
        text = text.lower()
    if _ANY_LEET.search(text):
        text = _LEETED.sub(lambda m: m[0].translate(_ASCII_FOLD), text)
    text = text.translate(_ASCII_BREAKS) if text.isascii() else _BREAKS.sub(" ", text)
    return f" {' '.join(text.split())} "


@dataclass
class Lexicon:
    """stems: beginning of a word -> weight; exceptions: phrases (two words) in which a stem doesn't count."""

    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -4.0
    scale: float = 1.0
    tau: float = 2000.0


class Scorer:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.tree = ahocorasick.Automaton()
        for stem, weight in lexicon.stems.items():
            self.tree.add_word(" " + stem, (len(stem) + 1, weight))
        for phrase in lexicon.exceptions:
            self.tree.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.empty = not (lexicon.stems or lexicon.exceptions)
        if not self.empty:
            self.tree.make_automaton()

    def matched(self, folded: str) -> float:
        """The summed weight of the longest stem at each word that isn't inside an exception phrase."""
        if self.empty:
            return 0.0
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.tree.iter(folded):
            begin = end - size + 1
            if weight is None:
                spared.append((begin, end))
            elif begin not in best or best[begin][0] < size:
                best[begin] = (size, weight)
        if spared:
            best = {at: v for at, v in best.items() if not any(b <= at < e for b, e in spared)}
        return sum(w for _, w in best.values())

    def score(self, text) -> float:
        folded = fold(text) if isinstance(text, str) else "  "
        lex = self.lexicon
        value = lex.bias + lex.scale * self.matched(folded) / (1 + math.log1p(len(folded) / lex.tau))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, value))))


def fit(rows: Iterable[tuple[str, int]]) -> Lexicon:
    """Learns from (text, label). Stems are the word beginnings whose document log-odds are high and that no shorter accepted
    stem explains; weights are those log-odds."""
    # Folded texts are split anew whenever they are read, as lists of their words would take many times their size.
    folded = [(fold(t), y) for t, y in rows]
    if not folded:
        return Lexicon(bias=-30.0)
    # Document frequencies of word beginnings; rows labelled 1 are read first so that only their words are counted at all.
    n1 = sum(y for _, y in folded)
    n0 = len(folded) - n1
    if not n1 or not n0:
        return Lexicon(bias=30.0 if n1 else -30.0)

    def beginnings(text):
        return {w[:k] for w in set(text.split()) for k in range(min(STEM_MIN, len(w)), min(STEM_MAX, len(w)) + 1) if len(w) >= 3}

    pos: Counter = Counter()
    for text, y in folded:
        if y:
            pos.update(beginnings(text))
    floor = 1 if n1 < 30 else 3 + n1 // 300
    wanted = {s for s, n in pos.items() if n >= floor}
    neg: Counter = Counter()
    for text, y in folded:
        if not y:
            neg.update(beginnings(text) & wanted)
    odds = {s: math.log((pos[s] + 0.3) / (n1 + 0.6)) - math.log((neg[s] + 0.3) / (n0 + 0.6)) for s in wanted}
    # A stem must stand out: its rows labelled 1 exceed what its share of all rows explains by several standard deviations.
    def stands_out(s: str) -> bool:
        expected = (pos[s] + neg[s]) * n1 / (n0 + n1)
        return odds[s] >= 1.2 and pos[s] - expected >= 4 * math.sqrt(expected + 0.25)

    chosen: dict[str, float] = {}
    for s in sorted(filter(stands_out, odds), key=lambda s: (len(s), s)):
        shorter = [s[:k] for k in range(3, len(s)) if s[:k] in chosen]
        # A longer stem replaces the weight of a shorter one only where it says something else.
        if shorter and abs(odds[s] - chosen[shorter[-1]]) < 0.8:
            continue
        chosen[s] = odds[s]
    # Exceptions: a pair of words around a stem that occurs in rows labelled 0 and hardly in others.
    stems = set(chosen)
    around = defaultdict(lambda: [0, 0])
    for text, y in folded:
        pairs, words = set(), text.split()
        for i, w in enumerate(words):
            if any(w[:k] in stems for k in range(3, min(STEM_MAX, len(w)) + 1)):
                pairs |= {" ".join(words[max(0, i - 1) : i + 1]), " ".join(words[i : i + 2])}
        for p in pairs:
            around[p][y] += 1
    exceptions = sorted((p for p, (a, b) in around.items() if " " in p and a >= 2 and a >= 5 * b), key=lambda p: (-around[p][0], p))
    lex = Lexicon(stems=chosen, exceptions=exceptions)
    # Two parameters of the logistic function, by Newton steps with a small ridge.
    scorer = Scorer(lex)
    x = np.array([scorer.matched(t) / (1 + math.log1p(len(t) / lex.tau)) for t, _ in folded])
    y = np.array([y for _, y in folded], float)
    a, b = 1.0, -3.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, v = p - y, p * (1 - p) + 1e-6
        g = np.array([(r * x).sum() + 0.02 * (a - 1.0), r.sum() + 0.02 * (b + 3.0)])
        h = np.array([[(v * x * x).sum() + 0.02, (v * x).sum()], [(v * x).sum(), v.sum() + 0.02]])
        step = np.clip(np.linalg.solve(h, g), -0.25, 0.25)  # short steps: separable classes make Newton overshoot
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    lex.scale, lex.bias = float(max(a, 1e-3)), float(b)
    return lex


def held_out_column(id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Lexicon:
    """Fits on at most sample_rows labelled rows, of sample_chars characters together, that aren't held out; which ones is decided by a hash
    of the id, so the same tables give the same lexicon. Reads the labels whole, and the texts of the sampled rows only. Of rows with the
    same id the lowest text is taken."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out_column("__id"))
    known = known.groupBy("__id").agg(F.max("__y").alias("__y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__t")).where(F.col("__t").isNotNull())
    # The sample is bounded by sample_rows, so it may be broadcast.
    sizes = texts.select("__id", F.length("__t").alias("n")).join(F.broadcast(chosen), "__id").groupBy("__id", "__y").agg(F.max("n").alias("n"))
    taken, left = [], sample_chars
    # The sample ends at the first row that doesn't fit in any more: going on with shorter ones would favour these.
    for r in sizes.where(F.col("n") <= sample_chars).orderBy(F.xxhash64("__id"), "__id").collect():
        if r["n"] > left:
            break
        taken.append((r["__id"], r["__y"]))
        left -= r["n"]
    if not taken:
        return fit([])
    picked = docs.sparkSession.createDataFrame(taken, "__id long, __y int")
    got = texts.join(F.broadcast(picked), "__id").groupBy("__id", "__y").agg(F.min("__t").alias("__t"))
    return fit((r["__t"], r["__y"]) for r in got.orderBy("__id").toLocalIterator())


_SCORERS: dict[int, Scorer] = {}


def _scorer(key: int, lexicon: Lexicon) -> Scorer:
    if key not in _SCORERS:
        held(("toxicity", key), dict)  # drops what an earlier stage has cached
        _SCORERS.clear()
        _SCORERS[key] = Scorer(lexicon)
    return _SCORERS[key]


def _key(lexicon: Lexicon) -> int:
    return zlib.crc32(repr((sorted(lexicon.stems.items()), lexicon.exceptions, lexicon.bias, lexicon.scale)).encode())


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted for each row of docs. The lexicon, bounded by the sample it was learnt from, travels with the task."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out_column(id_col), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    key = _key(lexicon)

    def run(frames):
        scorer = _scorer(key, lexicon)
        for b in slices(frames, "text"):
            s = np.array([scorer.score(t) for t in b["text"].to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b["id"], b["held_out"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return narrow.mapInArrow(lean(run), f"{id_col} long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under 0.5, all columns unchanged."""
    key = _key(lexicon)

    def run(batches):
        scorer = _scorer(key, lexicon)
        for b in slices(batches, text_col):
            yield b.filter(pa.array([scorer.score(t) < 0.5 for t in b.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
