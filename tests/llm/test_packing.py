import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from maskframe.llm import bpe, packing
from maskframe.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "   ", "  a  b \n c\t d  ", "it's  don't\n\n x y z", " <|endoftext|> é\xa0 \xa0b", "a  b 12 34.5!! x,y", "\x1c x \x1c", "😀 ok  \r\n  z", "With.\nThese dou.\n\nx,", "½ ²a _b a_b", "a <|endoftext|> b", "x<|endoftext|>", "a  <|endoftext|>\n b", "漢字漢字 " * 3000, "Ünï. ça! ñ\nß", "ʼn ﬁ Ⅷ x\u0301y"])
def test_parts_give_the_ids_of_the_whole(text):
    assert np.frombuffer(bpe.CachedBPE(PATH).encode(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    hist = np.zeros(65, np.int64)
    for _ in range(r.choice([0, 1, 30, 5000])):
        hist[r.choice([r.randint(1, 64), 64, r.randint(1, 9)])] += 1
    used = Counter()
    chosen = packing.plan(hist)
    for pattern, n in chosen:
        assert sum(pattern) <= 64 and n > 0
        for v in pattern:
            used[v] += n
    assert all(used[v] == hist[v] for v in range(65))
    total = int((hist * np.arange(65)).sum())
    assert sum(n for _, n in chosen) <= max(-(-total // 64) * 1.05 + 2, (hist > 32).sum())


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_pack(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs, PATH, max_len=64).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 64
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] not in (8, None)}
    for key, text in texts.items():
        whole = np.array([*ids(text or ""), 2], "<u4")
        got = sorted(by[key], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in got] == packing.cut(len(whole), 64)
        assert all(zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in got)
    assert len(by[8]) == 2 and len(by[None]) >= 2
    assert packing.pack(no_docs, PATH).count() == 0


def test_small_results_are_in_few_parts(spark):
    """However many shuffle partitions there are: each part written is a file, for which the local file system starts a process."""
    docs = spark.createDataFrame([(i, "some words " * (i % 50)) for i in range(300)], "doc_id long, text string")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 60)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        packed = packing.pack(docs, PATH)
        assert packed.rdd.getNumPartitions() <= 8 and packed.count() == 300
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)
