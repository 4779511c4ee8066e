"""Document fingerprints: 128-bit SimHash. DataFrame functions only.

A text's terms are its pairs of consecutive words (the last word pairs with nothing), lower-cased. Each occurrence votes with the
term's weight, its length up to MAX_WEIGHT characters, for the bits of its 128-bit hash; the majority decides each bit. Votes for four bits
share one 64-bit sum over BLOCK words, votes for two the sum of these. Fingerprints within a Hamming radius are found by permuted block tables, equal fingerprints being one class. With
radius + 1 blocks at least one is equal (near_pairs, for small radii); near copies lie up to 18 bits apart, where such blocks are too
short, so near_links has a table for each few blocks of several parts, one of which must hold so many equal ones, see SCHEMES. Both find all pairs.

Defined results: a null or empty text, or one without words, has the zero fingerprint and is like itself; documents are ordered
by doc_id, nulls last, then by place in the table's files, so repeated rows follow each other; a single document is its own next one;
an empty table gives no rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskframe.llm.common import files_for, materialize, placed

BITS = 128
MAX_WEIGHT = 24
SPLIT = r"[\x20\x09-\x0D]+"
#: Words whose votes fit into 15 bits each, so that the highest of four lanes leaves the sign alone: BLOCK * MAX_WEIGHT is less than 2^15.
BLOCK = 1024
LANES = sum(1 << 16 * i for i in range(4))
PAIRS = 0xFFFF | 0xFFFF << 32
#: Largest distance of texts whose five-word shingles have a similarity of 0.8.
RADIUS = 18


def _layout(*parts: tuple[tuple[int, tuple[int, ...]], ...]) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """Blocks (half, first bit, bits) by part, from each part's (half, bits of its blocks there)."""
    at, out = [0, 0], []
    for part in parts:
        blocks = []
        for half, widths in part:
            for w in widths:
                blocks.append((half, at[half], w))
                at[half] += w
        out.append(tuple(blocks))
    return tuple(out)


#: (Most fingerprints, e, parts of the 128 bits, each made of blocks); each e blocks of a part are a table. A part of n blocks has e equal ones
#: if n - e bits differ there at most. Had every part more, 19 bits would differ, so all pairs up to RADIUS meet in a table, whichever bits they
#: are. Unrelated fingerprints meet in 2.9, 0.92 and 0.45 % of all pairs, about 1200 for each fingerprint at the most named here. Further tables
#: would take more disk than the texts, so comparisons grow with the square of the rows beyond.
SCHEMES = (
    (42_000, 2, _layout(((0, (6, 6, 5, 5, 5, 5)),), ((0, (6, 6, 5, 5, 5, 5)),), ((1, (6, 6, 6, 6, 5, 5)),), ((1, (6, 6, 6, 6, 6)),))),
    (130_000, 3, _layout(((0, (5, 5, 5, 4, 4, 4)),), ((0, (5, 5, 5, 4, 4, 4)),), ((1, (5, 5, 4, 4, 4, 4)),), ((1, (5, 5, 4, 4, 4, 4)),), ((0, (5, 5)), (1, (4, 4, 4))))),
    (None, 4, _layout(((0, (4, 4, 4, 4, 4, 4, 3)),), ((0, (4, 4, 4, 4, 4, 3, 3)),), ((1, (4, 4, 4, 4, 4, 4, 3)),), ((1, (4, 4, 4, 4, 4, 3, 3)),), ((0, (4, 4, 3)), (1, (4, 4, 3))))),
)
#: Of a row's place, as it is read back from Parquet; any other nullability would keep Spark from reusing an exchange.
UID = "struct<file:bigint,row:bigint>"
#: Fingerprints compared at once; larger buckets are dealt out by pairs of chunks.
CHUNK = 2048


def _terms(text: Column) -> Column:
    """An array of (hash, weight), one for each word."""
    words = F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")
    nexts = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    return F.zip_with(words, nexts, lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), F.least(F.length(a) + F.coalesce(F.length(b), F.lit(0)), F.lit(MAX_WEIGHT)).cast("long").alias("w")))


def _bits(name: str) -> Column:
    """64 majority bits from 32 sums that hold two counts each."""
    out = None
    for j in range(16):
        for odd in (0, 1):
            for lane in (0, 1):
                sums = F.col(f"{name}{j}_{odd}")
                votes = F.shiftrightunsigned(sums, 32) if lane else sums.bitwiseAND(F.lit(0xFFFFFFFF))
                bit = F.shiftleft(F.when(votes * 2 > F.col("total"), F.lit(1)).otherwise(F.lit(0)).cast("long"), j + 16 * odd + 32 * lane)
                out = bit if out is None else out.bitwiseOR(bit)
    return out


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, f1, f2 for each row; keys must tell rows apart. Where texts is dealt out by some of the keys, nothing is shuffled."""
    rows = texts.select(*keys, F.posexplode_outer(_terms(F.col(text_col))).alias("pos", "t"))
    rows = rows.select(*keys, F.shiftright(F.coalesce("pos", F.lit(0)), BLOCK.bit_length() - 1).alias("block"), F.col("t.h").alias("h1"), F.xxhash64("t.h").alias("h2"), F.coalesce(F.col("t.w"), F.lit(0)).alias("w"))
    fours = [F.sum(F.shiftrightunsigned(F.coalesce(F.col(h), F.lit(0)), j).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{n}{j}") for h, n in (("h1", "x"), ("h2", "y")) for j in range(16)]
    blocks = rows.groupBy(*keys, "block").agg(F.sum("w").alias("total"), *fours)
    twos = [F.sum(F.shiftrightunsigned(F.col(f"{n}{j}"), 16 * odd).bitwiseAND(F.lit(PAIRS))).alias(f"{n}{j}_{odd}") for n in "xy" for j in range(16) for odd in (0, 1)]
    votes = blocks.groupBy(*keys).agg(F.sum("total").alias("total"), *twos)
    return votes.select(*keys, _bits("x").alias("f1"), _bits("y").alias("f2"))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - distance(a1, a2, b1, b2) / F.lit(float(BITS))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def hex128(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def _blocks(f1: Column, f2: Column, n: int) -> list[Column]:
    """n blocks of 128 / n bits, n a power of 2 from 2 to 128."""
    width = BITS // n
    mask = F.lit((1 << width) - 1) if width < 64 else F.lit(-1)
    return [F.shiftrightunsigned(f, s).bitwiseAND(mask) for f in (f1, f2) for s in range(0, 64, width)]


def near_pairs(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a1, a2, b1, b2, d) of different fingerprints at most radius bits apart, each once. prints: distinct f1, f2. Blocks
    are short, and buckets large, where the radius is."""
    n = next(x for x in (2, 4, 8, 16, 32, 64, 128) if x > radius)
    blocks = _blocks(F.col("f1"), F.col("f2"), n)
    tables = prints.select("f1", "f2", F.posexplode(F.array(*blocks)).alias("block", "value"))
    a = tables.select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), "block", "value")
    b = tables.select(F.col("f1").alias("b1"), F.col("f2").alias("b2"), "block", "value")
    pairs = a.join(b, ["block", "value"]).where((F.col("a1") < F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") < F.col("b2"))))
    pairs = pairs.withColumn("d", distance(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2"))).where(F.col("d") <= radius)
    # Only the first equal block tells of a pair.
    first = F.lit(n)
    for i, (x, y) in reversed(list(enumerate(zip(_blocks(F.col("a1"), F.col("a2"), n), _blocks(F.col("b1"), F.col("b2"), n), strict=True)))):
        first = F.when(x == y, F.lit(i)).otherwise(first)
    return pairs.where(F.col("block") == first).select("a1", "a2", "b1", "b2", "d")


def near_links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, schemes: tuple = SCHEMES) -> DataFrame:
    """f1, f2, n_links (all other fingerprints at most radius bits apart), where there are any. prints: distinct f1, f2. Pairs are counted as
    buckets are compared and aren't shuffled; each counts in the first of its tables only. Which of the schemes serves changes no result."""
    prints = materialize(prints.select("f1", "f2"), "prints")
    n = prints.count()
    e, parts = next((e, parts) for most, e, parts in schemes if most is None or n <= most)
    if radius >= sum(len(p) - e + 1 for p in parts):
        raise ValueError(f"{radius} bits may change blocks of all parts")

    def block(p: int, i: int) -> Column:
        half, shift, width = parts[p][i]
        bits = F.shiftrightunsigned(F.col(f"f{half + 1}"), shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        return F.coalesce(bits, F.lit(0)).alias(f"b{p}_{i}")  # never null, which keeps the compiled code short

    def key(p: int, t: tuple[int, ...]) -> Column:
        """The table, as its part, its last block and a bit for each block, and these blocks' bits, 16 at most."""
        out, shift = F.lit((p << 10 | t[-1] << 7 | sum(1 << i for i in t)) << 16), 0
        for i in t:
            out = out.bitwiseOR(F.shiftleft(F.col(f"b{p}_{i}"), shift))
            shift += parts[p][i][2]
        return out

    def feet(places, least: int = 1) -> tuple[int, int]:
        """The lowest bits of blocks of least bits or more, in each half."""
        return tuple(sum(1 << shift for half, shift, width in places if half == h and width >= least) for h in (0, 1))

    def long(mask: int) -> Column:
        return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")

    every = [b for p in parts for b in p]

    def equal(x: Column, half: int) -> Column:
        """The lowest bits of a half's equal blocks, x being the bits that differ: all bits of a block are gathered in its lowest one."""
        out = x
        for s in range(1, max(width for _, _, width in every)):
            out = out.bitwiseOR(F.shiftrightunsigned(x, s).bitwiseAND(long(feet(every, s + 1)[half])))
        return F.bitwise_not(out).bitwiseAND(long(feet(every)[half]))

    equals = [equal(F.col(f"f{h + 1}").bitwiseXOR(F.col(f"g{h + 1}")), h) for h in (0, 1)]
    part, last = F.shiftright("key", 26), F.shiftright("key", 23).bitwiseAND(F.lit(7))
    # No part before the table's has e equal blocks, and only e - 1 come before the last of the table's.
    first = F.bit_count(equals[0].bitwiseAND(F.col("below1"))) + F.bit_count(equals[1].bitwiseAND(F.col("below2"))) == e - 1
    for p, blocks in enumerate(parts[:-1]):
        equal_ones = [F.bit_count(same.bitwiseAND(long(t))) for same, t in zip(equals, feet(blocks), strict=True) if t]
        first = first & ((part <= p) | (sum(equal_ones[1:], equal_ones[0]) < e))

    def below(half: int) -> Column:
        """The lowest bits of the blocks before the last of a table's."""
        out = F.lit(0).cast("long")
        for p, blocks in enumerate(parts):
            for i in range(e - 1, len(blocks)):
                out = F.when((part == p) & (last == i), long(feet(blocks[:i])[half])).otherwise(out)
        return out

    def counted(buckets: DataFrame, us: str, them: str) -> DataFrame:
        """f1, f2, n for each of us, with a row for each key. Both lists are unfolded inside one compiled loop."""
        known = buckets.select("key", us, F.col(them).alias("others"), below(0).alias("below1"), below(1).alias("below2"))
        pairs = known.select("key", "others", "below1", "below2", F.inline(us).alias("f1", "f2")).select("key", "below1", "below2", "f1", "f2", F.inline("others").alias("g1", "g2"))
        d = distance(F.col("f1"), F.col("f2"), F.col("g1"), F.col("g2"))
        return pairs.where((d <= radius) & (d > 0) & first).groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"))

    tables = [(p, t) for p, blocks in enumerate(parts) for t in combinations(range(len(blocks)), e)]
    same = Window.partitionBy("key")
    blocks = prints.select("f1", "f2", *(block(p, i) for p, part in enumerate(parts) for i in range(len(part))))
    rows = blocks.select("f1", "f2", F.explode(F.array(*(key(p, t) for p, t in tables))).alias("key")).withColumn("size", F.count(F.lit(1)).over(same)).where("size > 1")
    member = F.struct("f1", "f2")
    small = rows.where(F.col("size") <= chunk).groupBy("key").agg(F.collect_list(member).alias("us"))
    large = rows.where(F.col("size") > chunk).withColumn("at", F.row_number().over(same.orderBy("f1", "f2")))
    large = large.select("key", "f1", "f2", F.floor((F.col("at") - 1) / chunk).alias("c"), F.explode(F.expr(f"sequence(0L, (size - 1) div {chunk})")).alias("o"))
    large = large.select("key", "f1", "f2", "c", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi")).repartition("key", "lo", "hi")
    large = large.groupBy("key", "lo", "hi").agg(F.collect_list(F.when(F.col("c") == F.col("lo"), member)).alias("us"), F.collect_list(F.when(F.col("c") == F.col("hi"), member)).alias("them"))
    both = large.select("key", "us", "them").unionByName(large.where("lo < hi").select("key", F.col("them").alias("us"), F.col("us").alias("them")))
    return counted(small, "us", "us").unionByName(counted(both, "us", "them")).groupBy("f1", "f2").agg(F.sum("n").alias("n_links"))


def successors(ids: DataFrame) -> DataFrame:
    """uid, doc_id, next_uid: the next row by (doc_id, uid), nulls last, the first after the last.

    Rows are dealt out by ranges and ordered within each; only the first row of each range crosses over, so what one task sees
    besides its range is one row for each range."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("uid").asc()]
    ranged = materialize(ids.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("next_uid", F.lead("uid").over(Window.partitionBy("range").orderBy(*order)))
    firsts = ranged.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))).alias("f")).select("range", F.col("f.uid").alias("first"))
    # One row for each range.
    over = Window.partitionBy(F.lit(0)).orderBy("range")
    wrap = F.first("first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(over), wrap).alias("after"))
    return inside.join(F.broadcast(firsts), "range").select("uid", "doc_id", F.coalesce("next_uid", "after").alias("next_uid"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; class_id (smallest doc_id with
    the same fingerprint) and n_links (other fingerprints found within radius by near_links). A text's edited form has its last half replaced by as
    many characters of the next document."""
    told, file, row = placed(docs)
    rows = told.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(F.col(file).alias("file"), F.col(row).alias("row")).cast(UID).alias("uid"))
    half = F.floor(F.length("text") / 2).cast("int")
    follows = materialize(successors(rows.select("doc_id", "uid")), "successors")
    halves = rows.select("uid", half.alias("half")).join(follows, "uid").select(F.col("next_uid").alias("uid"), F.col("uid").alias("before"), "half")
    # Both joins deal out the same two columns by uid, so the texts are shuffled once.
    texts = rows.select("uid", "text")
    heads = texts.join(halves, "uid").select(F.col("before").alias("uid"), F.expr("left(text, half)").alias("head"))
    edited = texts.join(heads, "uid").select("uid", "text", F.length("text").cast("long").alias("n_chars"), F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.col("head")).alias("edited"))
    told = edited.select("uid", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("s"))
    told = told.select("uid", "n_chars", "sha", F.col("s.which").alias("which"), F.col("s.text").alias("text"))
    prints = fingerprints(told, ["uid", "n_chars", "sha", "which"])
    pick = lambda f, w: F.max(F.when(F.col("which") == w, F.col(f)))
    one = materialize(prints.groupBy("uid", "n_chars", "sha").agg(pick("f1", 0).alias("f1"), pick("f2", 0).alias("f2"), pick("f1", 1).alias("e1"), pick("f2", 1).alias("e2")), "prints")
    nexts = one.select(F.col("uid").alias("next_uid"), F.col("f1").alias("n1"), F.col("f2").alias("n2"))
    out = one.join(follows, "uid").join(nexts, "next_uid")
    classes = one.join(follows, "uid").groupBy("f1", "f2").agg(F.min("doc_id").alias("class_id"))
    links = near_links(classes.select("f1", "f2"), radius)
    # Written first, so that Spark can split the rows of a frequent fingerprint in the join.
    classes = materialize(classes.join(links, ["f1", "f2"], "left"), "classes", files_for(one.count()))
    out = out.join(classes, ["f1", "f2"])
    c = F.col
    return out.select(
        "doc_id", "n_chars", c("sha").alias("edited_sha256"), hex128(c("f1"), c("f2")).alias("fingerprint"), hex128(c("e1"), c("e2")).alias("edited_fingerprint"),
        likeness(c("f1"), c("f2"), c("e1"), c("e2")).alias("near_edited"), likeness(c("f1"), c("f2"), c("n1"), c("n2")).alias("near_next"),
        "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
