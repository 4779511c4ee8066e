"""Chat formatting by cumulative-snapshot collapse. DataFrame functions only.

Logs of rolling conversations hold the same conversation again and again, each time longer. A prefix hash is kept for each turn:
the exclusive or of position-dependent 128-bit hashes of the turns so far. A conversation whose whole hash is a proper prefix
hash of another one is dropped by an anti-join; of equal conversations the smallest conv_id stays. Only then are the maximal ones
rendered.

Only 128-bit hashes of the turns travel until the maximal conversations are known; then their texts are fetched, once. Positions and
prefix hashes come from blocks of BLOCK turn numbers, and block totals are combined after, so a conversation with
a large share of all turns is spread over many tasks. A rendered conversation comes in chunks of BLOCK turns.

Defined results: rows that are equal in all four columns are one turn; turns are ordered by (turn, role, text), nulls first; a
null conv_id is a conversation of its own, shown as null; a null role or text renders as empty, but a null isn't equal to an empty
text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskframe.llm.common import files_for, materialize

BLOCK = 1024


def said(conversations: DataFrame) -> DataFrame:
    """key, conv_id, turn, role, text, c1, c2 (hash of role and text) of each row."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    told = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("key"), "*", F.xxhash64(*told).alias("c1"), F.xxhash64(F.lit(1), *told).alias("c2"))


def turns(rows: DataFrame, files: int | None = None) -> DataFrame:
    """key, conv_id, turn, role, c1, c2, tie of the different rows. tie orders rows that differ in their texts only; their texts are read for it."""
    place = ["key", "conv_id", "turn", "role"]
    content = F.struct("c1", "c2")
    known = materialize(rows.groupBy(*place).agg(F.min(content).alias("low"), F.max(content).alias("high")), "turns", files)
    single = known.where("low = high").select(*place, "low.c1", "low.c2", F.lit(0).alias("tie"))
    tied = known.where("low <> high").select(F.col("key").alias("k"), F.col("turn").alias("t"), F.col("role").alias("r"))
    if tied.isEmpty():
        return single
    among = rows.join(tied, (F.col("key") == F.col("k")) & F.col("turn").eqNullSafe(F.col("t")) & F.col("role").eqNullSafe(F.col("r"))).select(*place, "text", "c1", "c2").distinct()
    tie = F.row_number().over(Window.partitionBy("key", "turn", "role").orderBy("text"))
    return single.unionByName(among.select(*place, "c1", "c2", tie.alias("tie")))


def turn_hashes(rows: DataFrame, block: int = BLOCK, files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, conv_id, turn, c1, c2, pos (from 0), n (turns of the conversation) of the different rows; key, conv_id, pos, n, p1, p2 (hash of the
    turns up to and with this one))."""
    told = turns(rows, files).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    whole = Window.partitionBy("key")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = told.groupBy("key", "block").agg(F.count("*").alias("size"))
    sizes = sizes.select("key", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(whole).alias("n"))
    inside = Window.partitionBy("key", "block")
    nth = F.row_number().over(inside.orderBy("turn", "role", "tie")) - 1
    placed = told.withColumn("nth", nth).join(sizes, ["key", "block"]).withColumn("pos", F.col("offset") + F.col("nth"))
    running = inside.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hashed = [F.bit_xor(F.xxhash64(F.lit(i), "pos", "c1", "c2")).over(running).alias(f"x{i}") for i in (1, 2)]
    placed = materialize(placed.select("key", "conv_id", "turn", "c1", "c2", "block", "pos", "n", *hashed), "placed", files)
    totals = placed.groupBy("key", "block").agg(F.max(F.struct("pos", "x1", "x2")).alias("t"))
    totals = totals.select("key", "block", *(F.bit_xor(f"t.x{i}").over(before).alias(f"b{i}") for i in (1, 2))).where("b1 is not null")
    prefixes = placed.join(totals, ["key", "block"], "left")
    prefixes = prefixes.select("key", "conv_id", "pos", "n", *(F.col(f"x{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))).alias(f"p{i}") for i in (1, 2)))
    return placed.select("key", "conv_id", "turn", "c1", "c2", "pos", "n"), prefixes


def maximal(prefixes: DataFrame) -> DataFrame:
    """key, copies (equal conversations) of the conversations that no longer one begins with."""
    length = (F.col("pos") + 1).alias("length")
    rank = F.struct(F.col("conv_id").isNull(), F.col("conv_id"), F.col("key"))
    whole = prefixes.where("pos + 1 = n").groupBy(length, "p1", "p2").agg(F.min(rank).alias("rank"), F.count("*").alias("copies"))
    proper = prefixes.where("pos + 1 < n").select(length, "p1", "p2").distinct()
    return whole.join(proper, ["length", "p1", "p2"], "left_anti").select(F.col("rank.key").alias("key"), "copies")


def collapse_and_render(conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>", block: int = BLOCK) -> DataFrame:
    """conv_id, chunk (from 0), n_turns (of the conversation), copies, text: the maximal conversations, rendered."""
    rows = said(conversations)
    placed, prefixes = turn_hashes(rows, block, files_for(conversations.count()))
    wanted = placed.join(maximal(prefixes), "key").select("key", F.col("turn").alias("t"), "c1", "c2", "pos", "n", "copies")
    texts = rows.join(wanted, ["key", "c1", "c2"]).where(F.col("turn").eqNullSafe(F.col("t")))
    form = F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"{end}\n"))
    chunks = texts.select("key", "conv_id", "n", "copies", F.floor(F.col("pos") / block).cast("int").alias("chunk"), F.struct("pos", form.alias("said")).alias("s"))
    # Equal rows of the input meet in the set.
    out = chunks.groupBy("key", "conv_id", "n", "copies", "chunk").agg(F.array_sort(F.collect_set("s")).alias("s"))
    return out.select("conv_id", "chunk", F.col("n").alias("n_turns"), "copies", F.array_join(F.col("s.said"), "").alias("text"))


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM t),
p AS (SELECT *, string_agg(md5(role || chr(10) || text), ',') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM r),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n - 1 GROUP BY prefix),
kept AS (SELECT conv_id, copies FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n - 1))
SELECT p.conv_id, CAST(p.pos // 1024 AS INTEGER) AS chunk, CAST(max(p.n) AS BIGINT) AS n_turns, CAST(max(k.copies) AS BIGINT) AS copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY p.pos) AS text
FROM p JOIN kept k ON p.conv_id = k.conv_id GROUP BY p.conv_id, p.pos // 1024
"""
