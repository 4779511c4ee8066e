import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from maskframe.llm import graph, minhash, simhash
from maskframe.llm.common import placed
from maskframe.llm.common import shingle_hashes, word_hashes

from .conftest import prose


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for i, (key, _) in enumerate(sets):
        if key is not None and (least[find(i)] is None or key < least[find(i)]):
            least[find(i)] = key
    out = []
    for i, (key, s) in enumerate(sets):
        comp = least[find(i)] if sum(find(j) == find(i) for j in range(len(sets))) > 1 else key
        out.append((key, len(s), comp, key == comp))
    return sorted(out, key=str)


def test_hashes_follow_words():
    a, _ = word_hashes("Ab cD\t\x0bé x".encode())
    b, _ = word_hashes("ab CD é\n\nX ".encode())
    assert (a == b).all() and len(a) == 4 and len(shingle_hashes(a, 5)) == 1 and len(shingle_hashes(a, 2)) == 3
    assert len(word_hashes(b"")[0]) == 0


def edited(seed, base, n):
    r = random.Random(seed)
    w = base.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(99)}"
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark, odd_docs, no_docs):
    base = [prose(100 + i, 150) for i in range(12)]
    rows = [(1000 + 40 * b + i, edited(40 * b + i, base[b], i % 8)) for b in range(12) for i in range(30)]
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("comp", F.lit(1)).repartition(3)
    for k in (4, 5):
        got = sorted((tuple(r) for r in minhash.near_duplicates(docs, k=k).collect()), key=str)
        assert got == brute(rows + odd, k)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_small_blocks_and_keep_one(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = prose(7, 200)
    rows = [(i, edited(i, base, 1 + i % 9)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, k=4).collect()), key=str)
    assert got == brute(rows, 4)
    odd = odd_docs.coalesce(1).selectExpr("*", "1 AS file", "2 AS `_row`", "3 AS __uid", "array(4) AS _metadata")
    again = minhash.keep_one(odd)
    assert again.columns == odd.columns and all(tuple(r)[-4:] == (1, 2, 3, [4]) for r in again.collect())
    kept = minhash.keep_one(odd_docs.coalesce(1))
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 7, 8, None, 9, 10], key=str)


def test_rows_keep_their_places_in_other_splits(spark, tmp_path):
    """Two reads of the same files that are split differently, as after a change of executors, agree on every row's place."""
    at = str(tmp_path / "docs")
    spark.range(5000).selectExpr("id", "repeat(md5(cast(id AS string)), 20) AS text").write.option("parquet.block.size", 64 << 10).parquet(at)
    reads = []
    for size in ("128m", "16k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df, file, row = placed(spark.read.parquet(at))
        reads.append((df.rdd.getNumPartitions(), {r["id"]: (r[file], r[row]) for r in df.collect()}))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert reads[0][0] < reads[1][0] and reads[0][1] == reads[1][1] and len(set(reads[0][1].values())) == 5000
    joined = spark.range(3).crossJoin(spark.read.parquet(at).limit(2))
    df, file, row = placed(joined.select("text"))
    assert df.select(file, row).distinct().count() == 6


def test_index_guarantee():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 16, (200, 32)).astype("<u2")
    b = a.copy()
    for i in range(200):
        b[i, r.choice(32, 15, replace=False)] ^= 1
    assert ((minhash.keys_of(a) == minhash.keys_of(b)).any(1)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = defaultdict(set)
    for n, r in got.items():
        groups[r].add(n)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 140)), [200, 201]]
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(spark, odd_docs, no_docs):
    import hashlib

    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.coalesce(1).collect()]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    want = []
    for at, i in enumerate(order):
        key, t = rows[i]
        h = len(t) // 2
        want.append((key, len(t), hashlib.sha256((t[: len(t) - h] + rows[order[(at + 1) % len(order)]][1][:h]).encode()).hexdigest()))
    got = simhash.fingerprint_documents(odd_docs.coalesce(1)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0 and by[2]["class_id"] == 1
    assert by[5]["fingerprint"] == "0" * 32 and all(0 <= r["near_edited"] <= 1 for r in got)
    assert simhash.fingerprint_documents(no_docs).count() == 0


def plain_simhash(text):
    """The fingerprint's 128 bits by votes, one by one, with xxHash64 as Spark defines it for several columns (each seeds the next)."""
    import re

    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    votes, total = [0] * 128, 0
    for i, a in enumerate(words):
        b = words[i + 1] if i + 1 < len(words) else None
        h1 = xxhash.xxh64_intdigest(a.encode(), 42)
        h1 = xxhash.xxh64_intdigest(b.encode(), h1) if b is not None else h1
        h2 = xxhash.xxh64_intdigest(h1.to_bytes(8, "little"), 42)
        weight = min(len(a) + len(b or ""), 24)
        total += weight
        for bit in range(64):
            votes[bit] += weight * (h1 >> bit & 1)
            votes[64 + bit] += weight * (h2 >> bit & 1)
    bits = [2 * v > total for v in votes]
    return sum(b << i for i, b in enumerate(bits[:64])) << 64 | sum(b << i for i, b in enumerate(bits[64:]))


def test_fingerprints_against_plain_votes(spark):
    texts = ["", " \n ", "One", "one  TWO\tthree", prose(1, 80), prose(1, 79) + " other", "Größe 漢字 ÉTÉ 😀 ok " * 9, "a" * 70, prose(5, 3000), "heavyheavyheavyheavy " * 5000]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in simhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    prints = [plain_simhash(t) for t in texts]
    for i, t in rows:
        h = len(t) // 2
        edited = plain_simhash(t[: len(t) - h] + texts[(i + 1) % len(texts)][:h])
        alike = lambda a, b: 1 - (a ^ b).bit_count() / 128
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (f"{prints[i]:032x}", f"{edited:032x}")
        assert got[i]["near_edited"] == alike(prints[i], edited) and got[i]["near_next"] == alike(prints[i], prints[(i + 1) % len(texts)])


def test_block_tables_find_all_pairs(spark):
    r = random.Random(4)
    base = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(40)]
    prints = set(base)
    for a, b in base:
        for _ in range(3):
            x = (a << 64) | b
            for bit in r.sample(range(128), r.randint(1, 5)):
                x ^= 1 << bit
            prints.add((x >> 64, x & (2**64 - 1)))
    signed = [tuple(v - 2**64 if v >= 2**63 else v for v in p) for p in prints]
    df = spark.createDataFrame(signed, "f1 long, f2 long")
    for radius in (1, 3):
        got = {frozenset([(p["a1"], p["a2"]), (p["b1"], p["b2"])]) for p in simhash.near_pairs(df, radius).collect()}
        far = lambda p, q: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(p, q, strict=True))
        assert got == {frozenset([p, q]) for i, p in enumerate(signed) for q in signed[:i] if far(p, q) <= radius}


def test_near_copies_are_linked(spark):
    r = random.Random(6)
    base = [r.getrandbits(128) for _ in range(30)]
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(128), n))
    prints = sorted({p for x in base for p in (x, *(flip(x, n) for n in (4, 8, 10, 12, 18, 30)))})
    halves = [tuple(v - 2**64 if v >= 2**63 else v for v in (p >> 64, p & (2**64 - 1))) for p in prints]
    df = spark.createDataFrame(halves, "f1 long, f2 long")
    all_ = defaultdict(int)
    for i, p in enumerate(prints):
        for q in prints:
            all_[halves[i]] += 0 < (p ^ q).bit_count() <= 18
    for chunk in (256, 2):
        got = {(x["f1"], x["f2"]): x["n_links"] for x in simhash.near_links(df, chunk=chunk).collect()}
        assert got == {k: n for k, n in all_.items() if n}
    exact = simhash.near_pairs(df, 18).collect()
    assert 2 * len(exact) == sum(all_.values())
    text = prose(1, 400)
    docs = spark.createDataFrame([(i, edited(i, text, 2 * (i > 0))) for i in range(8)], "doc_id long, text string")
    assert all(x["n_links"] == 7 for x in simhash.fingerprint_documents(docs).collect())


def test_links_whichever_bits_differ(spark):
    """Pairs at 18 and 19 bits: spread out, so that no three of eight blocks of 8 bits are equal in either half; all in one place; and as many
    blocks of each part as can be changed while one part still has enough equal ones."""
    r = random.Random(8)
    for _, e, parts in simhash.SCHEMES:
        assert sorted((h, s + i) for p in parts for h, s, w in p for i in range(w)) == [(h, i) for h in (0, 1) for i in range(64)]
        flips = [[7 * i for i in range(18)], [8 * i for i in range(16)] + [1, 65], list(range(18)), list(range(50, 68)), list(range(110, 128))]
        for spared in range(len(parts)):
            changed = [b for i, p in enumerate(parts) for b in (p[e - 1 :] if i != spared else p[e:])]
            flips.append([64 * (1 - h) + s for h, s, _ in changed])
        base = [r.getrandbits(128) for _ in flips]
        prints = [x for x, bits in zip(base, flips, strict=True) for x in (x, x ^ sum(1 << b for b in bits))]
        assert all((p ^ q).bit_count() == 18 for p, q in zip(prints[::2], prints[1::2], strict=True))
        far = [r.getrandbits(128)]
        far.append(far[0] ^ sum(1 << b for b in range(0, 114, 6)))
        rows = [tuple(v - 2**64 if v >= 2**63 else v for v in (p >> 64, p & (2**64 - 1))) for p in prints + far]
        got = {(x["f1"], x["f2"]): x["n_links"] for x in simhash.near_links(spark.createDataFrame(rows, "f1 long, f2 long"), schemes=((None, e, parts),)).collect()}
        assert got == dict.fromkeys(rows[:-2], 1)
