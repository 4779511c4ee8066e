from collections import defaultdict

from maskframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, key int"


def brute(rows):
    convs = defaultdict(set)
    for c, t, r, x, _ in rows:
        convs[c].add((t, r, x))
    low = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    seq = {c: tuple((r, x) for t, r, x in sorted(s, key=lambda k: (low(k[0]), text(k[1]), text(k[2])))) for c, s in convs.items()}
    out = {}
    for c, s in seq.items():
        same = [k for k, v in seq.items() if v == s]
        if c == min(same, key=lambda k: (k is None, k or 0)) and not any(len(v) > len(s) and v[: len(s)] == s for v in seq.values()):
            out[c] = (len(s), len(same), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in s))
    return out


ROWS = [
    *((1, i, "user", f"t{i}", 0) for i in range(3)), *((2, i, "user", f"t{i}", 0) for i in range(5)), *((3, i, "user", f"t{i}", 0) for i in range(5)), (4, 0, "user", "t0", 0), (4, 0, "user", "t0", 0),
    (5, 1, None, "x", 0), (5, 2, "user", None, 0), (6, 1, None, "x", 0), (6, 2, "user", "", 0), (None, 0, "a", "b", 0), (None, None, "a", "b", 0), (7, 9, "user", "t0", 0), (7, 5000, "user", "other", 0),
    *((8, i, "user", f"long{i}", 0) for i in range(40)), *((9, i, "user", f"long{i}", 0) for i in range(39)),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for block in (1024, 4):
        parts = defaultdict(dict)
        for r in chat.collapse_and_render(df, block=block).collect():
            parts[r["conv_id"]][r["chunk"]] = r
        got = {c: (p[0]["n_turns"], p[0]["copies"], "".join(p[k]["text"] for k in sorted(p))) for c, p in parts.items()}
        assert got == brute(ROWS)
    assert chat.collapse_and_render(df.where("false")).count() == 0
