"""Quality rules by tokeniser fertility.

A public SentencePiece vocabulary with byte fallback is run over the words of a text. Three measures follow: characters per
token, the share of byte-fallback tokens, and the entropy of the token distribution. Each has a band by language or script;
a text outside any band is rejected. Bands are quantiles of all labelled clean rows that aren't held out (learn()), or the fixed ones where
there are too few.

Defined results: a null or empty text has no words and fails the base rules; a null or unknown lang takes the band of the
script that most letters belong to; repeated rows give repeated results; extra columns never matter. Texts of any length are
read whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.common import WORD, batches, held, lean, materialize, slices, spent
from maskframe.llm.toxicity import held_out_column

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """Accepted ranges. The entropy floor is min(entropy, spread * log2(tokens)), as short texts can't reach a fixed floor; in learnt
    bands it is curve, a polynomial of log2(tokens), which is held constant outside span."""

    chars_low: float
    chars_high: float
    fallback_high: float
    entropy: float
    spread: float = 0.7
    curve: tuple[float, ...] = ()
    span: tuple[float, float] = (0.0, 64.0)

    def floor(self, tokens: int) -> float:
        x = float(np.log2(max(tokens, 2)))
        if self.curve:
            return float(np.polyval(self.curve, min(max(x, self.span[0]), self.span[1])))
        return min(self.entropy, self.spread * x)


#: Bands by language. Languages the vocabulary was built for; texts of invented syllables lie near the lower end.
BY_LANG = {
    "en": Band(1.60, 8.0, 0.10, 5.3),
    "de": Band(1.60, 8.0, 0.10, 5.3),
    "fr": Band(1.45, 8.0, 0.10, 5.3),
    "es": Band(1.45, 8.0, 0.10, 5.3),
}
#: Bands by script for all other languages. Scripts that the vocabulary hardly covers fall back to bytes legitimately: on one article of
#: the declaration of human rights in eleven languages of OTHER, characters per token are 0.37 to 0.96, the fallback share is 0 to 0.82 and
#: the entropy 4.0 to 6.1. A script without any pieces that parts no words lies above 0.90 and needs labelled clean rows.
BY_SCRIPT = {
    "LATIN": Band(1.2, 9.0, 0.20, 4.6),
    "CYRILLIC": Band(1.0, 9.0, 0.20, 4.6),
    "GREEK": Band(0.7, 9.0, 0.60, 4.2),
    "OTHER": Band(0.33, 2.0, 0.90, 3.6),
}


@dataclass(frozen=True)
class Bands:
    """A text takes its language's band, or else the one of its script."""

    lang: dict[str, Band]
    script: dict[str, Band]


FIXED = Bands(BY_LANG, BY_SCRIPT)

#: Ids of clean rows that learn() broadcasts, to measure these rows only; with more of them it measures all rows and joins the measures.
FEW_IDS = 1_000_000
#: Clean rows from which a language or script gets a band of its own.
LEAST_ROWS = 100
#: Shares of clean rows below a band's floors and above its ceilings. The fallback ceiling is at least LEAST_FALLBACK, as most clean
#: texts have no such token at all.
LOW, HIGH, LEAST_FALLBACK = 0.01, 0.995, 0.01

#: Steps of a measure by which order statistics are narrowed down before single values are looked at.
STEPS = 1024

#: Words held in a worker's cache; it is emptied when full. 250k words are about 60 MB.
CACHE_WORDS = 250_000


class Fertility:
    """Token counts of words, each word tokenised once while it is cached."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.end = np.zeros(1 << 12, np.int64)
        self.fallback = np.zeros(1 << 12, np.int32)

    def _grow(self, name: str, need: int) -> None:
        have = getattr(self, name)
        if len(have) < need:
            new = np.zeros(max(need, 2 * len(have)), have.dtype)
            new[: len(have)] = have
            setattr(self, name, new)

    def learn(self, words: set[str]) -> None:
        if len(self.index) > CACHE_WORDS:
            self.clear()
        missing = [w for w in words if w not in self.index]
        if not missing:
            return
        coded = self.sp.encode(missing, num_threads=1)
        n = len(self.index)
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for c in coded for i in c), np.int32, int(size.sum()))
        at = int(self.end[n])
        self._grow("end", n + len(missing) + 1)
        self._grow("fallback", n + len(missing) + 1)
        self._grow("ids", at + len(flat))
        self.ids[at : at + len(flat)] = flat
        self.end[n + 1 : n + 1 + len(missing)] = at + np.cumsum(size)
        cum = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        edge = np.concatenate([[0], np.cumsum(size)])
        self.fallback[n : n + len(missing)] = cum[edge[1:]] - cum[edge[:-1]]
        self.index.update(zip(missing, range(n, n + len(missing)), strict=True))

    def measure(self, at: np.ndarray) -> tuple[int, int, float]:
        """(tokens, byte-fallback tokens, entropy in bits) of the words with these cache places."""
        begin, size = self.end[at], self.end[at + 1] - self.end[at]
        total = int(size.sum())
        if not total:
            return 0, 0, 0.0
        first = np.cumsum(size) - size
        ids = self.ids[np.arange(total) + np.repeat(begin - first, size)]
        ids.sort()
        n = np.diff(np.flatnonzero(np.diff(ids, prepend=-1, append=-1)))
        p = n / total
        return total, int(self.fallback[at].sum()), float(-(p * np.log2(p)).sum())


def repeat_words(at: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(at)
    if n < 4:
        return 0
    at = at.astype(np.int64)
    if at.max() >= 1 << 21:
        at = np.unique(at, return_inverse=True)[1]
    if at.max() < 1 << 21:
        key = (at[:-2] << 42) | (at[1:-1] << 21) | at[2:]
    else:  # over 2M different words in one text
        two = np.unique(at[:-1] * (n + 1) + at[1:], return_inverse=True)[1]
        key = two[:-1] * (n + 1) + at[2:]
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    found = np.zeros(n - 2, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    inside[:-2] |= found
    inside[1:-1] |= found
    inside[2:] |= found
    return int(inside.sum())


def script_of(text: str) -> str:
    """The script of most letters of the whole text."""
    seen: Counter = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            name = "LATIN" if c.isascii() else unicodedata.name(c, "OTHER").split(" ")[0]
            seen[name if name in BY_SCRIPT else "OTHER"] += n
    return max(sorted(seen), key=seen.get) if seen else "OTHER"


def base_counts(text: str, words: list[str]) -> tuple[int, int, int]:
    """(characters in words, symbols, repeated lines) of a text."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    return sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


def verdict(band: Band, chars: int, tokens: int, fallback: int, entropy: float) -> bool:
    return tokens > 0 and within(band, tokens, chars / tokens, fallback / tokens, entropy)


def within(band: Band, tokens: int, per: float, share: float, entropy: float) -> bool:
    return band.chars_low <= per <= band.chars_high and share <= band.fallback_high and entropy >= band.floor(tokens)


COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "n_tokens": "long", "chars_per_token": "double", "fallback_share": "double",
    "token_entropy": "double", "kept": "boolean",
}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _batch(rows: list[tuple], kinds: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[kind]) for i, kind in enumerate(kinds.values())], names=list(kinds))


def _ddl(kinds: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())


def judge(texts: list, langs: list, model: str, bands: Bands = FIXED) -> list[tuple]:
    fert = held(("fertility", model), lambda: Fertility(model))
    out = []
    for part in batches(list(zip(texts, langs, strict=True)), lambda r: len(r[0]) if isinstance(r[0], str) else 0, 1_000_000):
        split = [WORD.findall(t) if isinstance(t, str) else [] for t, _ in part]
        fert.learn(set().union(*split))
        get = fert.index.__getitem__
        for (text, lang), words in zip(part, split, strict=True):
            n = len(words)
            if not n:
                symbols = 0
                out.append((0, 0, symbols, 0, 0, True, 0, 0.0, 0.0, 0.0, False))
                continue
            at = np.fromiter(map(get, words), np.int64, n)
            chars, symbols, dup = base_counts(text, words)
            rep = repeat_words(at)
            failed = n < 50 or 100 * rep > 50 * n
            tokens, fallback, entropy = fert.measure(at)
            band = bands.lang.get(lang) if isinstance(lang, str) else None
            band = band or bands.script[script_of(text)]
            out.append((n, chars, symbols, dup, rep, failed, tokens, chars / max(tokens, 1), fallback / max(tokens, 1), entropy, not failed and verdict(band, chars, tokens, fallback, entropy)))
    return out


def measures(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row for each row of docs: __id, lang, script and COLUMNS without the verdict. No shuffle."""
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None)
    narrow = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"), lang.cast("string").alias("lang"))
    kinds = {"__id": "long", "lang": "string", "script": "string"} | {c: kind for c, kind in COLUMNS.items() if c != "kept"}

    def run(frames):
        for b in slices(frames, "text"):
            known = list(zip(*(b[c].to_pylist() for c in ("__id", "text", "lang")), strict=True))
            rows = judge([t for _, t, _ in known], [x for _, _, x in known], model)
            yield _batch([(i, x, script_of(t or ""), *r[:-1]) for (i, t, x), r in zip(known, rows, strict=True)], kinds)

    return narrow.mapInArrow(lean(run), _ddl(kinds))


def _clean(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """The ids labelled clean that aren't held out."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out_column("__id"))
    return known.groupBy("__id").agg(F.min("__y").alias("__y")).where("__y = 1").select("__id")


def _quantiles(values: DataFrame, wanted: dict[tuple, int], shares: dict[str, tuple[float, ...]]) -> dict[tuple, list[float]]:
    """Exact quantiles, interpolated linearly, of each (kind, name, which) in wanted, which has their numbers of values. values: kind, name,
    which, value. Counts by steps come to the driver, then the values of the steps where a quantile lies."""
    keys = ["kind", "name", "which"]
    steps = values.groupBy(*keys, F.floor(F.col("value") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    by_step = defaultdict(list)
    for r in steps.collect():
        by_step[tuple(r)[:3]].append((r["step"], r["n"]))
    places, ask = {}, set()
    for key, n in wanted.items():
        step, count = np.array(sorted(by_step[key])).T
        end = np.cumsum(count)
        places[key] = []
        for q in shares[key[2]]:
            at = (n - 1) * q
            two = [int(at), min(int(at) + 1, n - 1)]
            found = [int(np.searchsorted(end, p, side="right")) for p in two]
            ask |= {(*key, int(step[f])) for f in found}
            places[key].append((at - int(at), [(int(step[f]), p - int(end[f] - count[f])) for f, p in zip(found, two, strict=True)]))
    asked = values.sparkSession.createDataFrame(sorted(ask), "kind string, name string, which string, step long")
    inside = values.withColumn("step", F.floor(F.col("value") * STEPS)).join(F.broadcast(asked), [*keys, "step"], "left_semi").groupBy(*keys, "step", "value").agg(F.count(F.lit(1)).alias("n"))
    by_value = defaultdict(list)
    for r in inside.collect():
        by_value[tuple(r)[:4]].append((r["value"], r["n"]))
    ends = {}
    for k, v in by_value.items():
        value, count = zip(*sorted(v), strict=True)
        ends[k] = value, np.cumsum(count)

    def value(key: tuple, step: int, nth: int) -> float:
        have, end = ends[*key, step]
        return have[int(np.searchsorted(end, nth, side="right"))]

    return {key: [float(np.quantile([value(key, *p) for p in two], t)) for t, two in v] for key, v in places.items()}


def _bands(measured: DataFrame, clean: DataFrame) -> Bands:
    """Bands of the clean ids' measures. The entropy floor follows the texts' length: a parabola in log2(tokens), lowered so far that a share
    LOW of the texts lies beneath. Sums are of whole numbers, so the order of rows changes nothing. To the driver come a row for each
    number of tokens that occurs in a language or script, and what _quantiles() names."""
    spark = measured.sparkSession
    passed = measured.where("NOT base_failed").join(clean, "__id").groupBy("__id").agg(F.min(F.struct("lang", "script", "n_tokens", "chars_per_token", "fallback_share", "token_entropy")).alias("m"))
    one = materialize(passed.select("m.*"), "clean", 8)
    learnt = [r["lang"] for r in one.where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS).collect()]
    of = F.when(F.col("lang").isin(learnt), F.struct(F.lit("lang").alias("kind"), F.col("lang").alias("name"))).when(
        F.col("lang").isNull() | ~F.col("lang").isin(list(BY_LANG)), F.struct(F.lit("script").alias("kind"), F.col("script").alias("name"))
    )
    rows = one.withColumn("of", of).where("of IS NOT NULL").select("of.kind", "of.name", "n_tokens", "chars_per_token", "fallback_share", "token_entropy")
    fixed = F.sum(F.round(F.col("token_entropy") * 2.0**40).cast("decimal(20,0)"))
    by_tokens = defaultdict(list)
    for r in rows.groupBy("kind", "name", "n_tokens").agg(F.count(F.lit(1)).alias("n"), fixed.alias("s")).collect():
        by_tokens[r["kind"], r["name"]].append((r["n_tokens"], r["n"], float(r["s"]) / 2.0**40 / r["n"]))
    fits = {}
    for key, v in by_tokens.items():
        tokens, n, mean = np.array(sorted(v), float).T
        if n.sum() >= LEAST_ROWS:
            x = np.log2(np.maximum(tokens, 2))
            curve = np.polyfit(x, mean, min(2, len(set(x)) - 1), w=np.sqrt(n))
            fits[key] = int(n.sum()), [0.0] * (3 - len(curve)) + [float(c) for c in curve], len(curve), (float(x.min()), float(x.max()))
    bands = {}
    if fits:
        curves = spark.createDataFrame([(*key, *c) for key, (_, c, _, _) in fits.items()], "kind string, name string, c2 double, c1 double, c0 double")
        x = F.log2(F.greatest("n_tokens", F.lit(2)))
        above = F.col("token_entropy") - ((F.col("c2") * x + F.col("c1")) * x + F.col("c0"))
        value = lambda which, c: F.struct(F.lit(which).alias("which"), c.alias("value"))
        values = rows.join(F.broadcast(curves), ["kind", "name"]).select("kind", "name", F.inline(F.array(value("chars", F.col("chars_per_token")), value("fallback", F.col("fallback_share")), value("entropy", above))))
        shares = {"chars": (LOW, HIGH), "fallback": (HIGH,), "entropy": (LOW,)}
        found = _quantiles(values, {(*key, which): n for key, (n, *_) in fits.items() for which in shares}, shares)
        for key, (_, curve, size, span) in fits.items():
            low, high = found[*key, "chars"]
            curve = (*curve[:2], curve[2] + found[*key, "entropy"][0])[3 - size :]
            bands[key] = Band(low, high, max(LEAST_FALLBACK, found[*key, "fallback"][0]), 0.0, curve=curve, span=span)
    spent(one)
    return Bands(*(fix | {name: b for (kind, name), b in bands.items() if kind == k} for k, fix in (("lang", BY_LANG), ("script", BY_SCRIPT))))


def learn(docs: DataFrame, labels: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "quality") -> Bands:
    """Bands from all rows labelled clean that aren't held out and pass the base rules. A language with LEAST_ROWS of them gets its own band;
    rows judged by script (all whose language has neither a learnt nor a fixed band) give their script's. Of rows with the same id the
    lowest measures are taken."""
    clean = materialize(_clean(labels, id_col, label_col), "ids", 8)
    if clean.count() <= FEW_IDS:
        narrow = docs.select(*dict.fromkeys([id_col, text_col, *([lang_col] if lang_col in docs.columns else [])]))
        docs = narrow.join(F.broadcast(clean), F.col(id_col).cast("long") == F.col("__id"), "left_semi")
    measured = materialize(measures(docs, model, id_col, text_col, lang_col), "measures")
    bands = _bands(measured, clean)
    spent(measured, clean)
    return bands


def learn_and_score(docs: DataFrame, labels: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "quality") -> DataFrame:
    """score() with the bands of learn(), the texts being read once: their measures are written, learnt from and judged."""
    measured = materialize(measures(docs, model, id_col, text_col, lang_col), "measures")
    bands = _bands(measured, _clean(labels, id_col, label_col))
    kinds = {id_col: "long"} | COLUMNS
    known = [c for c in COLUMNS if c != "kept"]

    def run(frames):
        for b in frames:
            kept = []
            for lang, script, failed, *m in zip(*(b[c].to_pylist() for c in ("lang", "script", "base_failed", "n_tokens", "chars_per_token", "fallback_share", "token_entropy")), strict=True):
                kept.append(not failed and m[0] > 0 and within(bands.lang.get(lang) or bands.script[script], *m))
            yield pa.RecordBatch.from_arrays([b["__id"], *(b[c] for c in known), pa.array(kept, pa.bool_())], names=list(kinds))

    return measured.mapInArrow(lean(run), _ddl(kinds))


def score(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bands: Bands = FIXED) -> DataFrame:
    """One row for each row of docs: id_col and COLUMNS. No shuffle; each row is judged by itself."""
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), lang.cast("string").alias("lang"))
    kinds = {id_col: "long"} | COLUMNS

    def run(frames):
        for b in slices(frames, "text"):
            rows = judge(b["text"].to_pylist(), b["lang"].to_pylist(), model, bands)
            yield _batch([(i, *r) for i, r in zip(b["id"].to_pylist(), rows, strict=True)], kinds)

    return narrow.mapInArrow(lean(run), _ddl(kinds))


def keep(docs: DataFrame, model: str, text_col: str = "text", lang_col: str | None = "lang", bands: Bands = FIXED) -> DataFrame:
    """The rows of docs whose verdict is kept, all columns unchanged. A null text is rejected."""

    def run(batches_):
        for b in slices(batches_, text_col):
            langs = b.column(lang_col).to_pylist() if lang_col in b.schema.names else [None] * b.num_rows
            rows = judge(b.column(text_col).to_pylist(), langs, model, bands)
            yield b.filter(pa.array([r[-1] for r in rows], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
