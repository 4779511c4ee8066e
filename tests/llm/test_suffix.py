import hashlib
import random
import time

import numpy as np
import pytest

from maskframe.llm import suffix_dedup as S

from .conftest import prose


@pytest.mark.parametrize("seed", range(40))
def test_deep_shallow_orders_and_measures(seed):
    r = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abc\0"
    strings = [bytes(r.choice(letters) for _ in range(r.choice([0, 3, 20, 70, 150]))) for _ in range(r.randrange(0, 40))]
    if seed % 3 == 0:
        base = bytes(r.choice(letters) for _ in range(150))
        strings = [base[: r.randrange(60, 150)] + bytes(r.choice(letters) for _ in range(r.randrange(0, 9))) for _ in range(30)]
    order, lcp = S.deep_shallow(strings)
    assert sorted(order.tolist()) == list(range(len(strings)))
    for depth in (1, 5, 40, 64, 65, 100):
        group, classes = np.cumsum(lcp < depth), {}
        for i, c in zip(order.tolist(), group.tolist(), strict=True):
            if len(strings[i]) >= depth:
                classes.setdefault(strings[i][:depth], set()).add(c)
        assert all(len(c) == 1 for c in classes.values()) and len(set(map(min, classes.values()))) == len(classes)


def brute(rows, length=S.LENGTH):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = {}
    for _, b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for k, b in data:
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                hit[s : s + length] = True
        runs = int((np.diff(hit.astype(int), prepend=0) == 1).sum())
        out.append((k, len(b), int(hit.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest()))
    return sorted(out, key=str)


def rows_with_passages(spark, odd_docs):
    passage, other = prose(900, 70), "é" * 150
    rows = [(100 + i, f"{prose(200 + i, 30)} {passage} {prose(300 + i, 20 + i)}") for i in range(12)]
    rows += [(200, prose(1000, 50) + passage[:210] + "x" + passage[1:215]), (201, other), (202, "x" + other), (203, "ab" * 300), (204, passage[:199]), (205, passage[:200])]
    rows += [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_against_brute_force(spark, odd_docs, no_docs):
    rows, docs = rows_with_passages(spark, odd_docs)
    for hot in (S.HOT, 3):
        assert sorted((tuple(r) for r in S.remove_repeats(docs.repartition(3), hot=hot).collect()), key=str) == brute(rows)
    assert S.remove_repeats(no_docs).count() == 0


def test_long_texts_in_chunks(monkeypatch):
    raw = np.frombuffer(prose(5, 3000).encode(), np.uint8)
    whole = S.anchors(raw)
    monkeypatch.setattr(S, "CHUNK", 1000)
    parts = S.anchors(raw)
    windows = lambda a: {(s, int(k), int(p)) for k, p, lo, hi in zip(*a, strict=True) for s in range(lo, hi + 1)}
    assert windows(whole) == windows(parts)


def test_degenerate_texts(spark):
    """Long runs of one letter choose an anchor at every byte; periodic texts choose few keys very often."""
    rows = [(1, "a" * 300_000), (2, "ab" * 40_000 + "x"), (3, "plain " * 10 + "words")]
    began = time.time()
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (300_000, 1), 2: (80_000, 1), 3: (0, 0)}
    assert time.time() - began < 90


def test_clashing_names(spark):
    rows = [(1, "x" * 50 + "q" * 10 + "word " * 60, 1, 2, 3, 4), (2, "word " * 60 + "tail", 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __spans int, spans int, file int, __at int")
    got = S.clean(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == {(1, "x" * 50 + "q" * 10, 1, 2, 3, 4), (2, "tail", 5, 6, 7, 8)}


def test_clean_keeps_whole_code_points(spark, odd_docs):
    shared = "ö" * 120
    docs = spark.createDataFrame([(1, "a" + shared + "b", 9), (2, "ä" + shared + "ü", 9), (3, None, None), (4, "short", 5)], "doc_id long, text string, n_chars long").coalesce(1)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in S.clean(docs).collect()}
    assert got[1] == ("ab", 2) and got[2] == ("äü", 2) and got[3] == (None, None) and got[4] == ("short", 5)
    assert S.clean(odd_docs.coalesce(1)).columns == odd_docs.columns
