import random
import re
import zlib

import sentencepiece

from maskframe.llm import quality, toxicity
from maskframe.llm.queries import tokenizer_path

from .conftest import WORDS, prose

MODEL = tokenizer_path("piece_bpe_32k.model")


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, inside = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            inside |= {p + d for p in places for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_quality_against_brute_force(spark, odd_docs, no_docs):
    more = ["a b c a b c", "x\ny\nx\n\n \n x\nx", "#*$ %&|<> a", "\x0b a\x0c b\xa0c", prose(4, 60) + " " + prose(4, 60), "w " * 80]
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t, "en", "s", 1, "k", 0) for i, t in enumerate(more)], odd_docs.schema))
    got = sorted((tuple(r[:7]) for r in quality.score(docs, MODEL).collect()), key=str)
    assert got == sorted(((r["doc_id"], *base(r["text"])) for r in docs.collect()), key=str)
    assert all(not (r["base_failed"] and r["kept"]) for r in quality.score(docs, MODEL).collect())
    assert quality.score(no_docs, MODEL).count() == 0


def plain_quality(text, lang, bands):
    """Measures and verdict with one look at each word, nothing cached."""
    import math
    import unicodedata
    from collections import Counter

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = [i for w in words for i in sp.encode(w)]
    if not ids:
        return 0, 0.0, 0.0, 0.0, False
    shares = [n / len(ids) for n in Counter(ids).values()]
    chars, fallback, entropy = sum(map(len, words)) / len(ids), sum(map(sp.is_byte, ids)) / len(ids), -sum(p * math.log2(p) for p in shares)
    band = bands.lang.get(lang)
    if band is None:
        seen = Counter()
        for c in text:
            if c.isalpha():
                name = "LATIN" if c.isascii() else unicodedata.name(c, "OTHER").split(" ")[0]
                seen[name if name in bands.script else "OTHER"] += 1
        band = bands.script[max(sorted(seen), key=seen.get) if seen else "OTHER"]
    x = math.log2(max(len(ids), 2))
    if band.curve:
        inside = min(max(x, band.span[0]), band.span[1])
        floor = sum(c * inside ** (len(band.curve) - 1 - i) for i, c in enumerate(band.curve))
    else:
        floor = min(band.entropy, band.spread * x)
    kept = not base(text)[-1] and band.chars_low <= chars <= band.chars_high and fallback <= band.fallback_high and entropy >= floor
    return len(ids), chars, fallback, entropy, kept


def same_measures(got, want):
    return got[0] == want[0] and all(abs(a - b) < 1e-9 for a, b in zip(got[1:4], want[1:4], strict=True)) and got[4] == want[4]


def test_quality_measures_against_plain_counts(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = odd_docs.select("doc_id", "text", "lang")
    for df, bands in ((docs.select("doc_id", "text", "lang"), quality.learn(docs, labels, MODEL)), (odd, quality.FIXED)):
        texts = sorted(df.collect(), key=str)
        got = sorted(zip(texts, quality.judge([r["text"] for r in texts], [r["lang"] for r in texts], MODEL, bands), strict=True), key=str)
        assert all(same_measures(g[6:], plain_quality(r["text"], r["lang"], bands)) for r, g in got)
        assert sorted((str(tuple(r)) for r in quality.score(df, MODEL, bands=bands).select("doc_id", "kept").collect())) == sorted(str((r["doc_id"], g[-1])) for r, g in got)


def plain_score(text, lexicon):
    """The score with a search for every stem and phrase, without a tree."""
    import math

    folded = toxicity.fold(text or "")
    spared = [(m.start(), m.start() + len(p) + 1) for p in lexicon.exceptions for m in re.finditer(f"(?= {re.escape(p)} )", folded)]
    total = 0.0
    for m in re.finditer(r" (?=\S)", folded):
        at = m.start()
        stems = [s for s in lexicon.stems if folded.startswith(s, at + 1)]
        if stems and not any(a <= at < b for a, b in spared):
            total += lexicon.stems[max(stems, key=len)]
    value = lexicon.bias + lexicon.scale * total / (1 + math.log1p(len(folded) / lexicon.tau))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, value))))


def test_toxicity_against_plain_search(spark, odd_docs):
    docs, labels, _ = labelled(spark)
    lex = toxicity.learn(docs, labels)
    assert lex.stems and lex.exceptions
    more = spark.createDataFrame([(9000, "m0ron1 trash you are trash can a trash"), (9001, "TR4SH! can. a trash, can"), (9002, "trashy trash-can mоron3")], docs.schema)
    for df in (docs.unionByName(more), odd_docs.select("doc_id", "text")):
        texts = {(r["doc_id"], r["text"]) for r in df.collect()}
        got = {(r["doc_id"], round(r["score"], 9)) for r in toxicity.score(df, lex).collect()}
        assert got == {(i, round(plain_score(t, lex), 9)) for i, t in texts}


def test_sample_ends_where_it_is_full(spark):
    docs, labels, _ = labelled(spark)
    assert toxicity.learn(docs, labels, sample_chars=10) == toxicity.fit([])
    assert toxicity.learn(docs, labels, sample_chars=3000) != toxicity.learn(docs, labels)


def test_quality_verdicts(spark):
    english = "The committee met on Tuesday to discuss the new proposal, which several members had already read. After a long debate they agreed that more evidence was needed before any decision could be made, and asked the office to prepare a report for the next session in the spring, when all the members would return."
    spam = "zq### xv*** " * 40
    codes = " ".join(f"{i:x}🜁🜂🜃🜄" for i in range(60))
    rows = [(1, english, "en"), (2, english, None), (3, spam, "en"), (4, codes, "en")]
    got = {r["doc_id"]: r["kept"] for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    kept = quality.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL)
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(r[0] for r in kept.collect()) == [1, 2]


def test_quality_bands_are_learnt_from_clean_rows(spark):
    def junk(seed, n):  # few words, most of them broken by symbols: passes the base rules and the fixed bands
        r = random.Random(seed)
        return " ".join(r.choice(WORDS[:60]) + r.choice(["", "##", "$$$", "%"]) for _ in range(n))

    rows, y = [], {}
    for i in range(1200):
        y[i] = int(i % 4 != 3)
        rows.append((i, prose(i, 100 + i % 200) if y[i] else junk(i, 100 + i % 200), "en" if i % 8 < 4 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = lambda of: spark.createDataFrame(list(of.items()), "doc_id long, quality int")
    held = {i for i in y if zlib.crc32(str(i).encode()) % 5 == 0}
    bands = quality.learn(docs, labels(y), MODEL)
    assert bands == quality.learn(docs.repartition(3), labels({i: v if i not in held else 1 - v for i, v in y.items()}), MODEL)
    got = {r["doc_id"]: r["kept"] for r in quality.score(docs, MODEL, bands=bands).collect()}
    caught = [not got[i] for i in held if not y[i]]
    lost = [not got[i] for i in held if y[i]]
    assert sum(caught) >= 0.9 * len(caught) and sum(lost) <= 0.1 * len(lost)
    assert {r["doc_id"] for r in quality.keep(docs, MODEL, bands=bands).collect()} == {i for i, k in got.items() if k}
    assert quality.learn(docs, labels(y).where("false"), MODEL) == quality.FIXED


def plain_bands(rows, y):
    """Bands of all clean rows at once, by numpy."""
    import numpy as np

    clean = [(t, lang) for i, t, lang in rows if y.get(i) == 1 and zlib.crc32(str(i).encode()) % 5]
    of = {}
    langs = {k for k in {lang for _, lang in clean} if k is not None and sum(lang == k for _, lang in clean) >= 100}
    for (t, lang), r in zip(clean, quality.judge([t for t, _ in clean], [lang for _, lang in clean], MODEL), strict=True):
        if not r[5] and (lang in langs or lang not in quality.BY_LANG):
            of.setdefault(lang if lang in langs else quality.script_of(t), []).append(r[6:10])
    out = {}
    for key, m in of.items():
        tokens, chars, fallback, entropy = np.array(m, float).T
        x = np.log2(tokens)
        curve = np.polyfit(x, entropy, 2)
        curve[-1] += np.quantile(entropy - np.polyval(curve, x), 0.01)
        out[key] = [*np.quantile(chars, [0.01, 0.995]), max(0.01, np.quantile(fallback, 0.995)), *curve, x.min(), x.max()]
    return out


def test_quality_bands_come_from_all_clean_rows(spark, monkeypatch):
    r = random.Random(11)
    rows = [(i, " ".join(r.choice(WORDS) + r.choice(["", "", "🜁", "ing"]) for _ in range(50 + i % 40)), ["en", "xx", None][i % 3]) for i in range(16_500)]
    y = {i: int(i % 40 != 0) for i, _, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame(list(y.items()), "doc_id long, quality int")
    bands = quality.learn(docs, labels, MODEL)
    for key, want in plain_bands(rows, y).items():
        b = bands.lang.get(key) or bands.script[key]
        assert all(abs(g - w) < 1e-8 for g, w in zip((b.chars_low, b.chars_high, b.fallback_high, *b.curve, *b.span), want, strict=True))
    monkeypatch.setattr(quality, "FEW_IDS", 10)
    assert quality.learn(docs, labels, MODEL) == bands
    some = docs.where("doc_id % 5 = 0").unionByName(spark.createDataFrame([(None, None, None), (1, "", "en")], docs.schema))
    both = docs.where("doc_id % 5 > 0").unionByName(some)
    got = sorted((tuple(x) for x in quality.learn_and_score(both, labels, MODEL).collect()), key=str)
    assert got == sorted((tuple(x) for x in quality.score(both, MODEL, bands=quality.learn(both, labels, MODEL)).collect()), key=str)


def test_quality_limits_of_other_scripts():
    r = random.Random(5)
    private = " ".join("".join(chr(0xE000 + r.randrange(6000)) for _ in range(5)) for _ in range(80))
    boxes = " ".join("".join(chr(0x2580 + r.randrange(30)) for _ in range(7)) for _ in range(80))
    hebrew = "כל בני אדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. כל אדם זכאי לזכויות ולחרויות שנקבעו בהכרזה זו ללא הפליה כלשהי מטעמי גזע, צבע, מין, לשון, דת, דעה פוליטית או דעה בבעיות אחרות, בגלל מוצא לאומי או חברתי, קנין, לידה או מעמד אחר."
    assert [x[-1] for x in quality.judge([private, boxes, hebrew], [None] * 3, MODEL)] == [False, False, True]


def test_fold():
    assert toxicity.fold("You M0R0N!") == " you moron " and toxicity.fold("іdiоt") == " idiot " and toxicity.fold("tr4sh, $cum") == " trash scum "
    assert toxicity.fold("in 1984 it") == " in 1984 it " and toxicity.fold("") == "  "


def labelled(spark):
    rows, y = [], []
    for i in range(600):
        bad = i % 6 == 0
        text = prose(i, 40) + (f" you m0ron{i % 7} are trash" if bad else " a trash can" if i % 6 == 3 else "")
        rows.append((i, text))
        y.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int"), dict(y)


def test_toxicity_held_out(spark, odd_docs, no_docs):
    docs, labels, y = labelled(spark)
    lex = toxicity.learn(docs, labels)
    got = toxicity.score(docs, lex).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == y[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert toxicity.score(odd_docs, lex).count() == odd_docs.count() and toxicity.score(no_docs, lex).count() == 0
    assert {r["doc_id"] for r in toxicity.keep(docs, lex).collect()} == {r["doc_id"] for r in got if not r["predicted"]}
    none = toxicity.learn(docs, labels.where("false"))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = labelled(spark)
    other = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, other)


def test_lexicon_is_not_cut():
    # More stems and exceptions than a lexicon held when it was cut at 20 000 and 5 000.
    rng = random.Random(8)
    seen = set()
    while len(seen) < 26_000:
        seen.add("".join(rng.choice("bcdfghklmnprst") for _ in range(4)))
    stems = sorted(seen)
    stems, around = stems[:20_500], stems[20_500:]
    bad = " ".join(stems)
    good = " ".join(f"{a} {b}" for a, b in zip(around, stems, strict=False))
    lex = toxicity.fit([(bad, 1)] * 40 + [(good, 0)] * 2 + [("plain words only", 0)] * 200)
    assert set(stems) <= set(lex.stems) and len(lex.exceptions) >= len(around)
    assert toxicity.Scorer(lex).score(stems[-1]) > toxicity.Scorer(lex).score("plain")
