import time
from collections import Counter

import numpy as np
import pytest

from maskframe.llm import pieces
from maskframe.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.mark.parametrize("text", ["", "a", " a  b\tc\nd ", "▁x ▁ y", "héllo 漢字 😀\x00 z" * 30, "x" * 500, "😀" * 100, " " * 300])
def test_lossless(text):
    ids = pieces.encode([text], [7], MODEL)[0]
    assert pieces.decode(ids, MODEL) == text
    assert ids.tolist() == pieces.encode([text], [7], MODEL)[0].tolist()


def test_samples_follow_the_lattice():
    lat = pieces.lattices(MODEL, 1.0)
    weight = np.exp(lat.log_weight)
    known = {lat.text[i].decode("utf-8", "ignore"): i for i in range(len(lat.text)) if weight[i] > 1e-200}

    def ways(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                for rest, p in ways(s[k:]):
                    yield (known[s[:k]], *rest), p * weight[known[s[:k]]]

    exact = dict(ways(" thes"))
    total, n = sum(exact.values()), 30_000
    got = Counter(tuple(x.tolist()) for x in pieces.encode([" thes"] * n, list(range(n)), MODEL))
    assert set(got) <= set(exact) and len(exact) > 5
    chi = sum((got[k] - n * p / total) ** 2 / (n * p / total) for k, p in exact.items())
    assert chi < 45  # 13 degrees of freedom


def test_long_words_are_one_lattice():
    """Pieces cross every place of a word, however long it is, and a text of a million characters without a space ends soon."""
    word = "thes" * 200
    ids = [x.tolist() for x in pieces.encode([word] * 200, list(range(200)), MODEL)]
    spans = set()
    lat = pieces.lattices(MODEL, 1.0)
    for row in ids:
        at = np.cumsum([0, *(len(lat.text[i]) for i in row)])
        spans |= {(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)}
    assert all(any(a < cut < b for a, b in spans) for cut in (64, 128, 192, 512))
    text = "abcdefghij" * 100_000
    began = time.time()
    assert pieces.decode(pieces.encode([text], [1], MODEL)[0], MODEL) == text
    assert time.time() - began < 60


def test_rows(spark, odd_docs, no_docs):
    back = {(r["doc_id"], r["text"]) for r in pieces.restore(pieces.sample(odd_docs, MODEL), MODEL).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    a, b = (sorted(map(str, pieces.round_trip(odd_docs.repartition(n), MODEL).collect())) for n in (1, 3))
    assert a == b and pieces.round_trip(no_docs, MODEL).count() == 0
