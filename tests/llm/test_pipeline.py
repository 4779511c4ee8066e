import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from maskframe.llm import quality, queries, toxicity

from .test_text_rules import MODEL, plain_quality, plain_score

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        assert docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before
    assert sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()))


def without_repeats(texts, length=200):
    """Texts without each byte that a string of length bytes covers which starts twice or more, spans narrowed to whole code points."""
    data = {k: t.encode() for k, t in texts.items()}
    seen = Counter(b[s : s + length] for b in data.values() for s in range(len(b) - length + 1))
    out = {}
    for k, b in data.items():
        hit = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                hit[s : s + length] = True
        edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
        left = bytearray()
        at = 0
        for x, y in edges.reshape(-1, 2).tolist():
            while x < y and b[x] & 0xC0 == 0x80:
                x += 1
            while y > x and y < len(b) and b[y] & 0xC0 == 0x80:
                y -= 1
            left += b[at:x]
            at = max(at, y)
        out[k] = (bytes(left) + b[at:]).decode()
    return out


def test_run_against_brute_force(spark):
    """All five stages in plain Python: only the learnt parameters (bands, lexicon) come from the operators."""
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    bands = quality.learn(docs, labels, MODEL)
    texts = {k: r["text"] for k, r in rows.items() if plain_quality(r["text"], r["lang"], bands)[4]}
    lexicon = toxicity.learn(docs.where(docs.doc_id.isin(list(texts))), labels)
    texts = {k: t for k, t in texts.items() if plain_score(t, lexicon) < 0.5}
    sets = {}
    for k, t in texts.items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {k: k for k in texts}
    find = lambda k: k if root[k] == k else find(root[k])
    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    texts = without_repeats({k: t for k, t in texts.items() if root[k] == k})
    tok = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want = set()
    for k, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        for piece, (s, n) in enumerate([(0, first), *((s, 1024) for s in range(first, len(ids), 1024))]):
            want.add((k, piece, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert 50 < len(texts) < len(rows)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in places.values():
        ends = np.cumsum([n for _, n in sorted(some)])
        assert [o for o, _ in sorted(some)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs, tmp_path):
    for docs in (odd_docs, no_docs):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            at = str(tmp_path / f"{i}-{docs is odd_docs}")
            stage(spark, docs, SF).write.parquet(at)


def test_registered():
    names = queries.queries()
    assert [f"op{n}_" for n in range(1, 11)] == sorted((f"{k.split('_')[0]}_" for k in names), key=lambda k: int(k[2:-1]))
    assert set(queries.oracle_sql()) <= set(names)
