"""The queries of the masking engine, each with SQL that another engine can run on the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskframe.config import Config
from maskframe.engine import Engine
from maskframe.functions import literals, maskers, validate
from maskframe.functions.dialect import DUCK, SPARK
from maskframe.operators import mapping as M
from maskframe.operators import provider, quality
from maskframe.plans import classify as C
from maskframe.plans import profile as P
from maskframe.plans.settle import settled, shared_dir
from maskframe.streaming.apply import grow_mapping, mask_stream, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- masked columns: table, key columns, value, masker ------------------------------------------------------------------

PHONE = "concat('+1 (', lpad(cast(200 + c_custkey % 700 as string), 3, '0'), ') 555-', lpad(cast(c_custkey % 10000 as string), 4, '0'))"
EMAIL = "concat(lower(replace(c_name, '#', '.')), '@example.com')"
ZIP = "lpad(cast(c_custkey * 7919 % 100000 as string), 5, '0')"
ADDRESS = "concat(cast(s_suppkey + 1 as string), ' Maple St, Apt ', cast(s_nationkey as string))"


def masked_query(name: str, table: str, keys: list[str], value, kind: str, where: str = "true") -> None:
    """value: SQL text, or a function of the dialect that gives it."""

    def text(q):
        inner = value if isinstance(value, str) else value(q)
        return f"SELECT {', '.join(keys)}, original, {maskers.masker(kind)(q, 'original')} AS masked FROM (SELECT {', '.join(keys)}, {inner} AS original FROM {table} WHERE {where}) t"

    def run(spark, sf_dir):
        df = read(spark, sf_dir, table).where(where)
        inner = value if isinstance(value, str) else value(SPARK)
        return df.select(*keys, F.expr(inner).alias("original")).select(*keys, "original", maskers.mask(kind, "original").alias("masked"))

    query(name, text(DUCK))(run)


def found_query(name: str, pattern: str, kind: str) -> None:
    """A masker over all that a pattern finds in whole texts."""

    def run(spark, sf_dir):
        found = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "original"))
        return found.select("doc_id", "pos", "original", maskers.mask(kind, "original").alias("masked"))

    found = f"SELECT doc_id, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS pos, unnest(m) AS original FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m FROM documents) x"
    query(name, f"SELECT doc_id, pos, original, {maskers.masker(kind)(DUCK, 'original')} AS masked FROM ({found}) t")(run)


def values_query(name: str, values: list, kind: str) -> None:
    """A masker over given values, null among them."""
    quoted = [(i, "NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)]
    rows = ", ".join(f"({i}, {v})" for i, v in quoted)

    def run(spark, sf_dir):
        df = spark.createDataFrame(list(enumerate(values)), "i int, original string")
        return df.select("i", "original", maskers.mask(kind, "original").alias("masked"))

    query(name, f"SELECT i, original, {maskers.masker(kind)(DUCK, 'original')} AS masked FROM (VALUES {rows}) t(i, original)")(run)


masked_query("q05_phone_mask_customer", "customer", ["c_custkey"], PHONE, "phone")
found_query("q06_phone_mask_documents", "[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}", "phone")
for _scope in ("year", "month", "days"):
    masked_query({"year": "q20", "month": "q21", "days": "q22"}[_scope] + f"_date_{_scope}_shift", "orders", ["o_orderkey"], lambda q: q.iso("o_orderdate", "yyyy-MM-dd"), f"date_shuffle_{_scope}")
masked_query("q23_date_formats_dmy", "orders", ["o_orderkey"], lambda q: q.iso("o_orderdate", "dd.MM.yyyy"), "date_shuffle_year")
masked_query("q23_date_formats_slash_time", "orders", ["o_orderkey"], lambda q: q.iso("o_orderdate", "yyyy/MM/dd HH:mm:ss"), "date_shuffle_month")
masked_query("q23_date_formats_compact", "events", ["event_id"], lambda q: q.iso("ts", "yyyyMMdd"), "date_shuffle_year")
_UNIX = {SPARK: "cast(unix_seconds(cast(ts as timestamp)) as string)", DUCK: "cast(cast(floor(epoch(ts)) as bigint) as varchar)"}
masked_query("q24_unix_seconds", "events", ["event_id"], lambda q: _UNIX[q], "date_shuffle_month")
masked_query("q25_unix_millis", "events", ["event_id"], lambda q: f"concat({_UNIX[q]}, lpad(cast(event_id % 1000 as string), 3, '0'))", "date_shuffle_year")
values_query("q26_date_invalid_passthrough", ["2024-02-31", None, "", "   ", "n/a", "NULL", "24-01-01", "2024-13-01", "2024-01-31 25:00", "2024-02-29", "5/6/2024", "12/31/2023"], "date_shuffle_year")
masked_query("q30_email_mask_customer", "customer", ["c_custkey"], EMAIL, "email")
found_query("q31_email_mask_documents", "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[.][a-z]+", "email")
masked_query("q32_postal_mask", "customer", ["c_custkey"], ZIP, "postal_code")
values_query("q33_postal_formats", ["98004", "98004-1234", "012345", "0000", "K1A 0B1", "SW1A 1AA", "12", "МУР 1234", None, "NULL", "00-012"], "postal_code")
masked_query("q34_address_mask", "supplier", ["s_suppkey"], ADDRESS, "address")
values_query("q35_address_tokens", ["ул. Ленина, д. 45, офис 302", "111 Thatcher St", "Санкт-Петербург", "д. 007", "кв. 000", None, "", "12 bis Rue de la Paix"], "address")
values_query("q27_phone_formats", ["+1 (425) 555-0174", "+7 (495) 123-45-67", "(514) 721-4711", "8-800-555-35-35", "12-3", "123", "1234", "+49 30 1234567", None], "phone")
values_query("q28_email_formats", ["a@b", "x @y.z", "John.Doe-99@Mail.COM", "иван.петров@почта.рф", "a@b@c.de", None, "", "j_smith+x@a.io"], "email")


# ---- dictionaries -------------------------------------------------------------------------------------------------------

_CYCLE = "coalesce(lead({v}) OVER (ORDER BY {o}), first_value({v}) OVER (ORDER BY {o}))"


@query("q01_genre_rotate_segment", f"""
WITH d AS (SELECT c_mktsegment AS v, min(c_custkey) AS p FROM customer WHERE c_mktsegment IS NOT NULL AND trim(c_mktsegment) <> '' GROUP BY 1),
m AS (SELECT v, {_CYCLE.format(v='v', o='p')} AS r FROM d)
SELECT c_custkey, c_mktsegment AS original, coalesce(r, c_mktsegment) AS masked FROM customer LEFT JOIN m ON c_mktsegment = v""")
def _q01(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    rotation = M.rotation(df, "c_mktsegment", "c_custkey")
    return M.apply(df.select("c_custkey", F.col("c_mktsegment").alias("original"), "c_mktsegment"), "c_mktsegment", rotation, "c_mktsegment").withColumnRenamed("c_mktsegment", "masked")


@query("q02_genre_scoped_two_tables", f"""
WITH a AS (SELECT n_name AS v, min(n_nationkey) AS p FROM nation GROUP BY 1), ma AS (SELECT v, {_CYCLE.format(v='v', o='p')} AS r FROM a),
b AS (SELECT r_name AS v, min(r_regionkey) AS p FROM region GROUP BY 1), mb AS (SELECT v, {_CYCLE.format(v='v', o='p')} AS r FROM b)
SELECT 'name' AS scope, v AS original, r AS replacement FROM ma UNION ALL SELECT 'name', v, r FROM mb WHERE v NOT IN (SELECT v FROM ma)""")
def _q02(spark, sf_dir):
    a = M.rotation(read(spark, sf_dir, "nation"), "n_name", "n_nationkey", "name")
    return M.first_wins(a, M.rotation(read(spark, sf_dir, "region"), "r_name", "r_regionkey", "name"))


@query("q03_name_sorted_cycle", f"""
WITH d AS (SELECT c_name AS v FROM customer UNION SELECT s_name FROM supplier)
SELECT CAST(NULL AS VARCHAR) AS scope, v AS original, {_CYCLE.format(v='v', o='v')} AS replacement FROM d WHERE trim(v) <> ''""")
def _q03(spark, sf_dir):
    names = read(spark, sf_dir, "customer").select(F.col("c_name").alias("n")).unionByName(read(spark, sf_dir, "supplier").select(F.col("s_name").alias("n")))
    return M.sorted_cycle(names, "n")


@query("q04_title_company_composer_cycle", " UNION ALL ".join(f"SELECT '{k}' AS field, v AS original, {_CYCLE.format(v='v', o='v')} AS replacement FROM (SELECT DISTINCT {c} AS v FROM part)" for k, c in (("title", "p_type"), ("company", "p_brand"), ("composer", "p_name"))))
def _q04(spark, sf_dir):
    df, out = read(spark, sf_dir, "part"), None
    for field, column in (("title", "p_type"), ("company", "p_brand"), ("composer", "p_name")):
        one = provider.SortedCycle().generate(df.select(F.col(column).alias("value")), field)
        out = one if out is None else out.unionByName(one)
    return out


@query("q07_mapping_lookup_left_join", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'X' WHEN 'O' THEN 'Y' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def _q07(spark, sf_dir):
    known = spark.createDataFrame([("o_orderstatus", "F", "X"), ("o_orderstatus", "O", "Y"), (None, "P", "global only")], M.SCHEMA)
    return M.apply(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", known, "o_orderstatus")


@query("q08_mapping_first_wins_merge", """
SELECT CAST(NULL AS VARCHAR) AS scope, original, max(replacement) AS replacement FROM (
SELECT c_name AS original, concat('c', c_custkey) AS replacement, c_custkey AS k FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_name, concat('d', c_custkey), c_custkey FROM customer WHERE c_custkey % 2 <> 0) GROUP BY original""")
def _q08(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    row = lambda p: [F.lit(None).cast("string").alias("scope"), F.col("c_name").alias("original"), F.concat(F.lit(p), F.col("c_custkey").cast("string")).alias("replacement")]
    return M.first_wins(df.where("c_custkey % 2 = 0").select(*row("c")), df.select(*row("d")))


@query("q09_mapping_last_wins_merge", "SELECT 'c_mktsegment' AS scope, c_mktsegment AS original, arg_max(c_name, c_custkey) AS replacement FROM customer GROUP BY c_mktsegment")
def _q09(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select(F.lit("c_mktsegment").alias("scope"), F.col("c_mktsegment").alias("original"), F.col("c_name").alias("replacement"), "c_custkey")
    return M.last_wins(df, "c_custkey")


@query("q82_mapping_saved_and_loaded", f"""
WITH d AS (SELECT c_mktsegment AS v, min(c_custkey) AS p FROM customer GROUP BY 1) SELECT 'c_mktsegment' AS scope, v AS original, {_CYCLE.format(v='v', o='p')} AS replacement FROM d""")
def _q82(spark, sf_dir):
    path = f"{shared_dir(spark)}/mapping-{uuid.uuid4().hex}"
    M.save(M.rotation(read(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey"), path)
    return settled(M.load(spark, path))


@query("q83_unknown_values_hashed", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'X' ELSE substr(sha256(o_orderstatus), 1, 12) END AS o_orderstatus FROM orders""")
def _q83(spark, sf_dir):
    known = spark.createDataFrame([("o_orderstatus", "F", "X")], M.SCHEMA)
    return M.apply(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", known, "o_orderstatus", "hash")


@query("q84_own_masker", "SELECT s_suppkey, s_name AS original, repeat('*', length(s_name)) AS masked FROM supplier")
def _q84(spark, sf_dir):
    maskers.register_masker("stars", lambda q, v: f"repeat('*', length({v}))")
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("original")).withColumn("masked", maskers.mask("stars", "original"))


@query("q85_stream_masked", f"""
WITH d AS (SELECT c_mktsegment AS v, min(c_custkey) AS p FROM customer GROUP BY 1), m AS (SELECT v, {_CYCLE.format(v='v', o='p')} AS r FROM d)
SELECT c_custkey, {maskers.masker('phone')(DUCK, 'p0')} AS phone, r AS c_mktsegment FROM (SELECT *, {PHONE} AS p0 FROM customer) c JOIN m ON c_mktsegment = v""")
def _q85(spark, sf_dir):
    """A stream over the table's files, run to their end."""
    df, at = read(spark, sf_dir, "customer"), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    mapping = settled(M.rotation(df, "c_mktsegment", "c_custkey"))
    stream = spark.readStream.schema(df.schema).parquet(f"{sf_dir}/customer.parquet*").select("c_custkey", F.expr(PHONE).alias("phone"), "c_mktsegment")
    masked = mask_stream(Engine(spark), stream, "customer", {("customer", "phone"): "phone", ("customer", "c_mktsegment"): "genre"}, mapping)
    masked.writeStream.format("parquet").option("path", at).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(masked.schema).parquet(at)


# ---- profiles and classification ----------------------------------------------------------------------------------------

#: All scalar columns of four tables. Engines write fractions differently, so these are read as decimals.
_PROFILED = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "events": "event_id ts user_id event_type value props"}
_FRACTIONAL = {"c_acctbal", "p_retailprice", "o_totalprice", "value"}
_TEXT = {"o_orderdate": "strftime(o_orderdate, '%Y-%m-%d')", "ts": "strftime(ts, '%Y-%m-%d %H:%M:%S')"} | {c: f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)" for c in _FRACTIONAL}
_CELLS = " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, trim({_TEXT.get(c, f'CAST({c} AS VARCHAR)')}) AS v FROM {t}" for t, cs in _PROFILED.items() for c in cs.split())


def _over_tables(spark, sf_dir, f):
    out = None
    for t, cs in _PROFILED.items():
        form = lambda c: F.col(c).cast("decimal(18,2)") if c in _FRACTIONAL else F.date_format(c, "yyyy-MM-dd" if c == "o_orderdate" else "yyyy-MM-dd HH:mm:ss") if c in _TEXT else F.col(c)
        one = f(read(spark, sf_dir, t).select(*(form(c).alias(c) for c in cs.split()))).select(F.lit(t).alias("tbl"), "*").withColumnRenamed("column", "col")
        out = one if out is None else out.unionByName(one)
    return out


@query("q10_profile_distinct", f"SELECT DISTINCT tbl, col, v AS value FROM ({_CELLS}) WHERE v IS NOT NULL AND v <> ''")
def _q10(spark, sf_dir):
    return _over_tables(spark, sf_dir, P.profile)


@query("q11_profile_length_stats", f"""
SELECT tbl, col, count(*) AS unique_count, avg(length(v)) AS avg_length, CAST(min(length(v)) AS INTEGER) AS min_length, CAST(max(length(v)) AS INTEGER) AS max_length
FROM (SELECT DISTINCT tbl, col, v FROM ({_CELLS}) WHERE v IS NOT NULL AND v <> '') GROUP BY tbl, col""")
def _q11(spark, sf_dir):
    return _over_tables(spark, sf_dir, P.statistics)


@query("q12_profile_first_seen", "SELECT p_name AS value, min(p_partkey) AS first_pos FROM part WHERE trim(p_name) <> '' GROUP BY 1")
def _q12(spark, sf_dir):
    return M.distinct_values(read(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("q12_profile_samples", "SELECT value, first_pos FROM (SELECT p_name AS value, min(p_partkey) AS first_pos FROM part GROUP BY 1) ORDER BY first_pos, value LIMIT 50")
def _q12b(spark, sf_dir):
    return P.samples(read(spark, sf_dir, "part"), "p_name", "p_partkey")


_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text", "pages": "page_id url html", "embeddings": "vec_id label",
}
_NAME_ROWS = ", ".join(f"('{t}', '{c}')" for t, cs in _COLUMNS.items() for c in cs.split())


@query("q13_skip_column_predicate", f"SELECT tbl, col, regexp_matches(lower(col), '{C.SKIP_NAMES}') AS skipped FROM (VALUES {_NAME_ROWS}) t(tbl, col)")
def _q13(spark, sf_dir):
    rows = [(t, c) for t in _COLUMNS for c in P.scalar_columns(read(spark, sf_dir, t))]
    return spark.createDataFrame(rows, "tbl string, col string").withColumn("skipped", F.lower("col").rlike(C.SKIP_NAMES))


def _classify_sql() -> str:
    like = lambda x, p: f"regexp_matches({x}, '{p}')"
    cells, fixed = [], []
    for t, cs in _COLUMNS.items():
        for c in cs.split():
            if C.is_skip_column(c):
                fixed.append(f"('{t}', '{c}', 'skip')")
            else:
                cells.append(f"SELECT DISTINCT '{t}' AS tbl, '{c}' AS col, trim(CAST({c} AS VARCHAR)) AS v FROM {t}")
    kind = C.chain("lower(col)", "n", "at_sign", "dates", "colon", "phones", "numeric", like)
    return f"""
WITH d AS (SELECT * FROM ({' UNION ALL '.join(cells)}) WHERE v IS NOT NULL AND v <> ''),
f AS (SELECT tbl, col, count(*) AS n, count(*) FILTER (contains(v, '@')) AS at_sign, count(*) FILTER (regexp_matches(v, '{C.DATE}')) AS dates, count(*) FILTER (contains(v, ':')) AS colon,
count(*) FILTER (regexp_matches(v, '{C.PHONE}') AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7) AS phones, count(*) FILTER (regexp_matches(v, '{C.NUMERIC}')) AS numeric FROM d GROUP BY tbl, col)
SELECT tbl, col, CASE WHEN n < 2 THEN 'none' ELSE {kind} END AS type FROM f UNION ALL SELECT * FROM (VALUES {', '.join(fixed)}) s(tbl, col, type)"""


@query("q14_classify_columns", _classify_sql())
def _q14(spark, sf_dir):
    out = None
    for t in _COLUMNS:
        one = C.classify(read(spark, sf_dir, t), t).select(F.col("table").alias("tbl"), F.col("column").alias("col"), "type")
        out = one if out is None else out.unionByName(one)
    return out


@query("q15_classify_values_derived", "SELECT * FROM (VALUES ('phone', 'phone'), ('contact', 'email'), ('born', 'date_shuffle_year'), ('zip', 'skip')) t(col, type)")
def _q15(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select(F.expr(PHONE).alias("phone"), F.expr(EMAIL).alias("contact"), F.expr("date_format(date_add(date'1990-01-01', cast(c_custkey % 9000 as int)), 'yyyy-MM-dd')").alias("born"), F.expr(ZIP).alias("zip"))
    return C.classify(df, "people").select(F.col("column").alias("col"), "type")


@query("q16_explicit_rule_override", "SELECT * FROM (VALUES ('c_custkey', 'skip'), ('c_name', 'company'), ('c_nationkey', 'genre'), ('c_acctbal', 'skip'), ('c_mktsegment', 'genre')) t(col, type)")
def _q16(spark, sf_dir):
    rules = {"customer.c_name": "company", "customer_c_nationkey": "genre", "c_mktsegment": "title"}
    return C.classify(read(spark, sf_dir, "customer"), "customer", rules).select(F.col("column").alias("col"), "type")


@query("q17_classify_notes", """
SELECT * FROM (SELECT 'contact' AS col, 'email' AS type, concat(count(DISTINCT concat(lower(replace(c_name, '#', '.')), '@example.com')), ' e-mails') AS note FROM customer
UNION ALL SELECT 'c_mktsegment', 'genre', concat(count(DISTINCT c_mktsegment), ' values, each to the next') FROM customer UNION ALL SELECT 'c_custkey', 'skip', '' UNION ALL SELECT 'nation_id', 'skip', 'key or measure' UNION ALL SELECT 'c_name', 'company', 'explicit rule')""")
def _q17(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("nation_id"), "c_mktsegment", F.expr(EMAIL).alias("contact"))
    return C.classify(df, "customer", {"customer.c_name": "company"}).select(F.col("column").alias("col"), "type", "note")


_UNSEEN = """WITH d AS (SELECT n_name AS v, min(n_nationkey) AS p FROM nation WHERE n_nationkey % 5 <> 0 GROUP BY 1)"""


@query("q18_engine_rotates_unseen", f"""{_UNSEEN}
SELECT 'n_name' AS scope, v AS original, {_CYCLE.format(v='v', o='p')} AS replacement FROM d UNION ALL SELECT 'n_name', n_name, 'known' FROM nation WHERE n_nationkey % 5 = 0""")
def _q18(spark, sf_dir):
    df = read(spark, sf_dir, "nation")
    known = df.where("n_nationkey % 5 = 0").select(F.lit("n_name").alias("scope"), F.col("n_name").alias("original"), F.lit("known").alias("replacement"))
    return Engine(spark).mappings({"nation": df}, {("nation", "n_name"): "genre"}, known, {"nation": "n_nationkey"})


@query("q19_stream_grows_mapping", f"""
WITH a AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_partkey % 7 = 0), b AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_brand NOT IN (SELECT v FROM a))
SELECT 'p_brand' AS scope, v AS original, {_CYCLE.format(v='v', o='v')} AS replacement FROM a UNION ALL SELECT 'p_brand', v, {_CYCLE.format(v='v', o='v')} FROM b""")
def _q19(spark, sf_dir):
    df, path = read(spark, sf_dir, "part"), f"{shared_dir(spark)}/grown-{uuid.uuid4().hex}"
    grow = grow_mapping(spark, path, "p_brand")
    grow(df.where("p_partkey % 7 = 0"), 0)
    grow(df, 1)
    return settled(versions(spark, path))


@query("q29_date_scope_by_column", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS original, hire_day, birth_day FROM (SELECT o_orderkey, o_orderdate, HIRE AS hire_day, BIRTH AS birth_day FROM (SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) x) y""".replace(
    "HIRE", maskers.masker("date_shuffle_month")(DUCK, "d")).replace("BIRTH", maskers.masker("date_shuffle_year")(DUCK, "d")))
def _q29(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    df = read(spark, sf_dir, "orders").select("o_orderkey", day.alias("original"), day.alias("hire_day"), day.alias("birth_day"))
    return df.select("o_orderkey", "original", maskers.mask("date_shuffle", "hire_day").alias("hire_day"), maskers.mask("date_shuffle", "birth_day").alias("birth_day"))


# ---- validation and quality ---------------------------------------------------------------------------------------------

_PAIRS = [("a@b.de", "x@b.de"), ("a@b.de", "x@c.de"), ("a@b.de", "none here"), ("2024-01-01", "2023-01-01"), ("2024-01-01", "soon"), ("12345", "54321"), ("12345", "x"), ("Bob", "Bob"), ("Bob", " "), ("Bob", "N/A"), ("Bob", "<name>"), ("Bob", "***"), ("Bob", None), ("Bob", "Tim"), ("AC/DC", "R.E.M.")]
_PAIR_ROWS = ", ".join(f"({i}, '{o}', {'NULL' if r is None else repr(r)})" for i, (o, r) in enumerate(_PAIRS))
_VIOLATION = f"""CASE WHEN trim(coalesce(replacement, '')) = '' THEN 'empty' WHEN regexp_matches(trim(replacement), '(?i)^(n/?a|null|none|undefined|unknown|-+|_+|\\*+|\\.{{3}}|<[^>]*>)$') THEN 'placeholder'
WHEN original = replacement THEN 'unchanged'
WHEN regexp_matches(original, '{validate.EMAIL}') THEN CASE WHEN NOT regexp_matches(replacement, '{validate.EMAIL}') THEN 'not an e-mail' WHEN split_part(original, '@', -1) <> split_part(replacement, '@', -1) THEN 'domain changed' END
WHEN regexp_matches(original, '{validate.DATE_LIKE}') THEN CASE WHEN NOT regexp_matches(replacement, '{validate.DATE_LIKE}') THEN 'not a date' END
WHEN regexp_matches(original, '^[0-9]+$') THEN CASE WHEN NOT regexp_matches(replacement, '^[0-9]+$') THEN 'not digits' END END"""


def _pairs(spark):
    return spark.createDataFrame([(i, o, r) for i, (o, r) in enumerate(_PAIRS)], "i int, original string, replacement string")


@query("q40_format_violation", f"SELECT i, original, replacement, {_VIOLATION} AS reason FROM (VALUES {_PAIR_ROWS}) t(i, original, replacement)")
def _q40(spark, sf_dir):
    return _pairs(spark).withColumn("reason", validate.format_violation(F.col("original"), F.col("replacement")))


@query("q64_check_format_kept_dropped", f"SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n FROM (SELECT {_VIOLATION} AS reason FROM (VALUES {_PAIR_ROWS}) t(i, original, replacement)) GROUP BY 1")
def _q64(spark, sf_dir):
    return _pairs(spark).groupBy(F.coalesce(validate.format_violation(F.col("original"), F.col("replacement")), F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


_HELPERS = [("a@b.de", "c@d.de"), ("AC-1", "BD-2"), ("Tom Hall", "tim Dunn"), ("Lord of Rings", "Song Of Rain"), ("abcd", "xyzw"), ("2024-01-05", "2023-01-05"), ("A B", "A")]
_PARTICLES = ", ".join(f"'{w}'" for w in validate.PARTICLES)
_HELPER_ROWS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_HELPERS))


@query("q49_helper_predicates", f"""SELECT i, (regexp_matches(a, '{validate.EMAIL}') OR regexp_matches(a, '{validate.DATE_LIKE}') OR (regexp_matches(a, '[0-9]') AND regexp_matches(a, '[-/. ]'))) AS mask_like,
NOT regexp_matches(a, '[A-Za-z]{{4}}') AS code_like, len(x) = len(y) AND len(list_filter(range(1, len(x) + 1), lambda k: lower(x[k]) NOT IN ({_PARTICLES}) AND lower(y[k]) NOT IN ({_PARTICLES}) AND (x[k][1] <> lower(x[k][1])) <> (y[k][1] <> lower(y[k][1])))) > 0 AS case_violated,
regexp_replace(a, '[A-Za-z0-9]', '', 'g') AS skeleton FROM (SELECT *, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM (VALUES {_HELPER_ROWS}) t(i, a, b))""")
def _q49(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(_HELPERS)], "i int, a string, b string")
    return df.select("i", validate.mask_like(a).alias("mask_like"), validate.code_like(a).alias("code_like"), validate.case_violation(a, b).alias("case_violated"), validate.skeleton(a).alias("skeleton"))


@query("q57_mapping_entries_and_members", """
WITH m AS (SELECT DISTINCT c_mktsegment AS v FROM customer) SELECT 'c_mktsegment' AS scope, (SELECT count(*) FROM m) AS entries, (SELECT count(*) FROM customer WHERE c_mktsegment IN (SELECT v FROM m)) AS members""")
def _q57(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    mapping = M.rotation(df, "c_mktsegment", "c_custkey")
    members = M.exists_anywhere(df.select(F.col("c_mktsegment").alias("value")), mapping).agg(F.count("*").alias("members"))
    return M.total_entries(mapping).join(members, F.lit(True))


def _masked_customer(spark, sf_dir):
    df = read(spark, sf_dir, "customer").withColumn("phone", F.expr(PHONE)).withColumn("email", F.expr(EMAIL)).withColumn("zip", F.expr(ZIP))
    types = {("customer", c): k for c, k in (("c_name", "name"), ("phone", "phone"), ("email", "email"), ("zip", "postal_code"), ("c_mktsegment", "genre"))}
    mapping = M.first_wins(M.sorted_cycle(df, "c_name"), M.rotation(df, "c_mktsegment", "c_custkey"))
    return df, Engine(spark, Config()).apply(df, "customer", types, mapping)


@query("q41_quality_keys_unchanged", "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added")
def _q41(spark, sf_dir):
    return quality.keys_changed(*_masked_customer(spark, sf_dir), ["c_custkey", "c_nationkey"])


@query("q42_quality_no_placeholders", "SELECT CAST(0 AS BIGINT) AS placeholders")
def _q42(spark, sf_dir):
    return quality.placeholders(_masked_customer(spark, sf_dir)[1], "c_name")


@query("q43_quality_distinct_counts", """
SELECT 'c_name' AS "column", count(DISTINCT c_name) AS before, count(DISTINCT c_name) AS after FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(DISTINCT c_mktsegment) FROM customer""")
def _q43(spark, sf_dir):
    return quality.distinct_counts(*_masked_customer(spark, sf_dir), ["c_name", "c_mktsegment"])


@query("q44_quality_row_count", "SELECT count(*) AS rows_before, count(*) AS rows_after FROM customer")
def _q44(spark, sf_dir):
    a, b = _masked_customer(spark, sf_dir)
    return quality.row_counts(a, b)


@query("q45_quality_masked_differs", "SELECT CAST(0 AS BIGINT) AS same_phone, CAST(0 AS BIGINT) AS same_email, CAST(0 AS BIGINT) AS same_zip")
def _q45(spark, sf_dir):
    a, b = _masked_customer(spark, sf_dir)
    both = a.select("c_custkey", "phone", "email", "zip").join(b.select("c_custkey", *(F.col(c).alias(f"m_{c}") for c in ("phone", "email", "zip"))), "c_custkey")
    return both.agg(*(F.count_if(F.col(c) == F.col(f"m_{c}")).alias(f"same_{c}") for c in ("phone", "email", "zip")))


@query("q46_fingerprint_equal", f"SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace({EMAIL}, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g') AS shape, true AS kept FROM customer")
def _q46(spark, sf_dir):
    local = lambda c: F.substring_index(c, "@", 1)
    df = read(spark, sf_dir, "customer").select("c_custkey", F.expr(EMAIL).alias("email")).withColumn("masked", maskers.mask("email", "email"))
    return df.select("c_custkey", validate.fingerprint(F.col("email")).alias("shape"), (validate.fingerprint(local("email")) == validate.fingerprint(local("masked"))).alias("kept"))


@query("q47_cross_table_consistency", "SELECT * FROM (SELECT CAST('' AS VARCHAR) AS original, CAST(0 AS BIGINT) AS n) WHERE false")
def _q47(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("k"))
    mapping = M.sorted_cycle(c.unionByName(s), "k")
    pairs = None
    for df in (c, s):
        one = M.apply(df.select(F.col("k").alias("original"), F.col("k").alias("masked")), "masked", mapping, None)
        pairs = one if pairs is None else pairs.unionByName(one)
    return quality.inconsistent(pairs)


@query("q48_distribution_preserved", "SELECT size, count(*) AS values FROM (SELECT count(*) AS size FROM customer GROUP BY c_mktsegment) GROUP BY size")
def _q48(spark, sf_dir):
    return quality.frequencies(_masked_customer(spark, sf_dir)[1], "c_mktsegment")


# ---- dumps and literals -------------------------------------------------------------------------------------------------


def _dump_of(spark, sf_dir, table, columns, kinds=None):
    """A table written as a dump in the shared folder, masked if kinds are given, and read back."""
    from maskframe.sources.dumps import as_table, mask_dump, read as read_dump

    df = read(spark, sf_dir, table).select(*columns)
    text = F.concat(F.lit("("), F.concat_ws(", ", *(F.concat(F.lit("'"), literals.escape(F.col(c).cast("string")), F.lit("'")) for c in columns)), F.lit(")"))
    head = spark.createDataFrame([(-1, "text", f"INSERT INTO `{table}` ({', '.join(f'`{c}`' for c in columns)}) VALUES\n")], "seq long, kind string, raw string")
    rows = df.select(F.col(columns[0]).cast("long").alias("seq"), F.lit("row").alias("kind"), text.alias("raw"))
    last = F.max("seq").alias("last")
    rows = rows.join(F.broadcast(rows.agg(last)), F.lit(True)).select("seq", "kind", F.concat("raw", F.when(F.col("seq") == F.col("last"), ";\n").otherwise(",\n")).alias("raw"))
    from maskframe.sources.sqldump import SqlDump

    spark.dataSource.register(SqlDump)
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}.sql"
    head.unionByName(rows).repartitionByRange("seq").sortWithinPartitions("seq").write.format("sqldump").mode("append").option("path", path).save()
    out = as_table(read_dump(spark, path), table, columns) if kinds is None else None
    if out is None:
        masked = f"{path}.masked"
        mask_dump(spark, path, masked, Engine(spark, Config({f"{table}.{c}": k for c, k in kinds.items()})))
        out = as_table(read_dump(spark, masked), table, columns)
    return _taken(out, path, f"{path}.masked")


def _taken(df, *paths):
    """df, fixed in the shared folder, so that the dumps it was read from can go."""
    df = settled(df)
    for p in paths:
        Path(p.removeprefix("file://").removeprefix("file:")).unlink(missing_ok=True)
    return df


@query("q59_dump_masked_customer", f"""
WITH n AS (SELECT v, {_CYCLE.format(v='v', o='v')} AS r FROM (SELECT DISTINCT c_name AS v FROM customer)), g AS (SELECT v, {_CYCLE.format(v='v', o='p')} AS r FROM (SELECT c_mktsegment AS v, min(c_custkey) AS p FROM customer GROUP BY 1))
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, n.r AS c_name, g.r AS c_mktsegment FROM customer JOIN n ON c_name = n.v JOIN g ON c_mktsegment = g.v""")
def _q59(spark, sf_dir):
    return _dump_of(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"], {"c_name": "name", "c_mktsegment": "genre", "c_custkey": "skip"}).drop("seq")


@query("q50_dump_roundtrip_nation", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def _q50(spark, sf_dir):
    return _dump_of(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]).drop("seq")


@query("q51_dump_roundtrip_customer", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def _q51(spark, sf_dir):
    return _dump_of(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"]).drop("seq")


_ENCODINGS = ["utf-8", "utf-8-sig", "cp1251", "koi8-r", "latin-1"]
_PREFIX = {"utf-8": "Ж", "utf-8-sig": "Ж", "cp1251": "Ж", "koi8-r": "Ж", "latin-1": "é"}


@query("q80_dump_encodings", "SELECT e AS encoding, CAST(n_nationkey AS VARCHAR) AS n_nationkey, concat(p, n_name) AS n_name FROM nation CROSS JOIN (VALUES " + ", ".join(f"('{e}', '{p}')" for e, p in _PREFIX.items()) + ") t(e, p)")
def _q80(spark, sf_dir):
    """Dumps of a table in several encodings, which the reader has to find out."""
    from maskframe.sources.dumps import as_table, read as read_dump
    from maskframe.sources.sqldump import SqlDump

    spark.dataSource.register(SqlDump)
    out, paths = None, []
    for e in _ENCODINGS:
        names = {"utf-8": "utf8mb4", "utf-8-sig": "utf8", "cp1251": "cp1251", "koi8-r": "koi8r", "latin-1": "latin1"}
        df = read(spark, sf_dir, "nation")
        rows = df.select(F.col("n_nationkey").cast("long").alias("seq"), F.lit("row").alias("kind"), F.concat(F.lit("INSERT INTO `nation` (`n_nationkey`, `n_name`) VALUES ("), F.col("n_nationkey").cast("string"), F.lit(f", '{_PREFIX[e]}"), literals.escape(F.col("n_name")), F.lit("');\n")).alias("raw"))
        head = spark.createDataFrame([(-1, "text", f"SET NAMES '{names[e]}';\n")], "seq long, kind string, raw string")
        paths.append(f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}.sql")
        head.unionByName(rows).repartitionByRange("seq").sortWithinPartitions("seq").write.format("sqldump").mode("append").option("path", paths[-1]).option("encoding", e).save()
        one = as_table(read_dump(spark, paths[-1]), "nation", ["n_nationkey", "n_name"]).drop("seq").select(F.lit(e).alias("encoding"), "*")
        out = one if out is None else out.unionByName(one)
    return _taken(out, *paths)


@query("q81_dump_row_counts", "SELECT 'customer' AS tbl, count(*) AS n FROM customer")
def _q81(spark, sf_dir):
    return _dump_of(spark, sf_dir, "customer", ["c_custkey", "c_name"]).agg(F.count("*").alias("n")).select(F.lit("customer").alias("tbl"), "n")


_BODIES = ["O''Brien", r"a\'b", r"back\\slash", r"line\nend", r"tab\tx", r"odd\q", "plain", "", "x''"]
_BODY_ROWS = ", ".join(f"({i}, '{b.replace(chr(39), chr(39) * 2)}')" for i, b in enumerate(_BODIES))


@query("q52_literal_unescape", f"""SELECT i, body, replace(replace(replace(replace(replace(replace(replace(replace(body, '\\\\', chr(1)), '\\n', chr(10)), '\\t', chr(9)), '\\''', ''''), '\\q', 'q'), '''''', ''''), chr(1), '\\'), chr(2), '') AS value
FROM (VALUES {_BODY_ROWS}) t(i, body)""")
def _q52(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(_BODIES)), "i int, body string").withColumn("value", literals.unescape(F.col("body")))


_VALUES = ["O'Brien", "a\\b", "line\nend", "plain", "", "''"]
_VALUE_ROWS = ", ".join("({}, replace('{}', '~', chr(10)))".format(i, v.replace("'", "''").replace("\n", "~")) for i, v in enumerate(_VALUES))


@query("q53_literal_escape", f"SELECT i, value, replace(replace(replace(value, '\\', '\\\\'), chr(10), '\\n'), '''', '''''') AS body FROM (VALUES {_VALUE_ROWS}) t(i, value)")
def _q53(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(_VALUES)), "i int, value string").withColumn("body", literals.escape(F.col("value")))


_CLASSES = [("12", "34"), ("12", "345"), ("-1e3", "+2e4"), (".5", ".7"), ("2020-01-01", "2021-02-02"), ("NOW()", "NOW()"), ("12", "ab"), ("0xFF", "0xAA")]
_CLASS_ROWS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_CLASSES))


@query("q54_same_literal_class", f"SELECT i, a, b, (regexp_matches(a, '{literals.NUMBER}') AND regexp_matches(b, '{literals.NUMBER}') AND length(a) = length(b)) OR (regexp_matches(a, '{literals.BARE_DATE}') AND regexp_matches(b, '{literals.BARE_DATE}')) AS same FROM (VALUES {_CLASS_ROWS}) t(i, a, b)")
def _q54(spark, sf_dir):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_CLASSES)], "i int, a string, b string")
    return df.withColumn("same", literals.same_literal_class(F.col("a"), F.col("b")))


_LINES = ["", "-- x", "/* x */", "SET NAMES utf8;", "LOCK TABLES `a` WRITE;", "(1, 2),", "INSERT INTO `a` VALUES", "COMMIT;", "ALTER TABLE a", "USE x;"]
_LINE_ROWS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(_LINES))


@query("q55_line_passthrough", f"SELECT i, line, regexp_matches(line, '{literals.PASS_LINES}') AS passes FROM (VALUES {_LINE_ROWS}) t(i, line)")
def _q55(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(_LINES)), "i int, line string").withColumn("passes", literals.passes(F.col("line")))


@query("q56_tuples_and_tokens", "SELECT * FROM (VALUES (0, 0, '1'), (0, 1, '''a),(b'''), (0, 2, 'NOW()'), (1, 0, '2'), (1, 1, '''O''''Brien'''), (1, 2, 'NULL')) t(row, pos, token)")
def _q56(spark, sf_dir):
    line = spark.createDataFrame([("(1, 'a),(b', NOW()), (2, 'O''Brien', NULL);",)], "line string")
    rows = line.select(F.posexplode(literals.tuples(F.col("line"))).alias("row", "t"))
    return rows.select("row", F.posexplode(literals.tokens(F.col("t"))).alias("pos", "token"))


# ---- providers ----------------------------------------------------------------------------------------------------------

_CHUNKS = "SELECT CAST((row_number() OVER (ORDER BY c_name) - 1) // 20 AS BIGINT) AS chunk, c_name FROM (SELECT DISTINCT c_name FROM customer)"


@query("q60_chunk_plan", f"SELECT chunk, count(*) AS n, min(c_name) AS first, max(c_name) AS last FROM ({_CHUNKS}) GROUP BY chunk")
def _q60(spark, sf_dir):
    names = read(spark, sf_dir, "customer").select("c_name").distinct()
    ranked = M.distinct_values(names, "c_name").select("value")
    # Ranks over ranges: the rows before each range, then the place in it.
    ranged = settled(ranked.repartitionByRange(16, "value").withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("range").agg(F.count("*").alias("size")).select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("value")) - 1
    chunks = ranged.join(F.broadcast(sizes), "range").select(F.floor(rank / provider.CHUNK_VALUES).alias("chunk"), "value")
    return chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))


@query("q61_timeout_model", "SELECT n, prompt, CAST(floor(greatest(45, least(180, 45 + 2 * n + 8 * prompt / 1000.0))) AS BIGINT) AS seconds FROM (VALUES (20, 1000), (1, 10), (200, 9000), (40, 4000)) t(n, prompt)")
def _q61(spark, sf_dir):
    rows = [(n, p, provider.chunk_timeout(n, p)) for n, p in ((20, 1000), (1, 10), (200, 9000), (40, 4000))]
    return spark.createDataFrame(rows, "n int, prompt int, seconds long")


@query("q62_cost_estimate", "SELECT CAST(sum(ceil(n / 20.0)) AS BIGINT) AS calls, sum(ceil(n / 20.0)) * 0.002e0 AS dollars FROM (SELECT count(DISTINCT c_name) AS n FROM customer UNION ALL SELECT count(DISTINCT p_name) FROM part)")
def _q62(spark, sf_dir):
    return quality.cost_estimate([(read(spark, sf_dir, "customer"), "c_name"), (read(spark, sf_dir, "part"), "p_name")])


@query("q63_extract_json", "SELECT * FROM (VALUES (0, 'a', 'b'), (1, 'a', 'b'), (2, 'a', 'b'), (3, 'a', 'b'), (4, 'x', '1'), (4, 'y', '2')) t(i, k, v)")
def _q63(spark, sf_dir):
    answers = ['{"a": "b"}', 'Sure:\n```json\n{"a": "b"}\n```', 'x {"a": "b",} y', "{'a': 'b'}", '"x": "1" and "y": "2"', "nothing"]
    rows = [(i, k, v) for i, t in enumerate(answers) for k, v in validate.extract_json(t).items()]
    return spark.createDataFrame(rows, "i int, k string, v string")


@query("q65_table_provider", "SELECT 'c_mktsegment' AS field, 'BUILDING' AS original, 'HOUSES' AS replacement FROM customer WHERE c_mktsegment = 'BUILDING' LIMIT 1")
def _q65(spark, sf_dir):
    pairs = spark.createDataFrame([("BUILDING", "HOUSES"), ("MACHINERY", "n/a"), ("UNASKED", "X")], "original string, replacement string")
    return provider.Table(pairs).generate(read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value")), "c_mktsegment")


@query("q66_engine_asks_provider", """
SELECT CAST(NULL AS VARCHAR) AS scope, c_name AS original, min(concat('Client ', c_custkey)) AS replacement FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_name""")
def _q66(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    pairs = df.where("c_custkey % 3 = 0").groupBy(F.col("c_name").alias("original")).agg(F.min(F.concat(F.lit("Client "), F.col("c_custkey").cast("string"))).alias("replacement"))
    return Engine(spark, providers={"name": provider.Table(pairs)}).mappings({"customer": df}, {("customer", "c_name"): "name"})


@query("q67_top_domains", """
SELECT domain, count(*) AS n FROM (SELECT split_part(m, '@', -1) AS domain FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[.][a-z]+')) AS m FROM documents)) GROUP BY domain ORDER BY n DESC, domain LIMIT 5""")
def _q67(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[.][a-z]+"), F.lit(0))).alias("m"))
    return quality.top_domains(found, "m")


@query("q68_text_scripts", "SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)[а-я]')) AS cyrillic FROM documents GROUP BY lang")
def _q68(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(validate.has_cyrillic(F.col("text"))).alias("cyrillic"))


@query("q69_violations_by_field", f"SELECT field, reason, count(*) AS n FROM (SELECT concat('f', i % 2) AS field, {_VIOLATION} AS reason FROM (VALUES {_PAIR_ROWS}) t(i, original, replacement)) WHERE reason IS NOT NULL GROUP BY 1, 2")
def _q69(spark, sf_dir):
    return provider.violations(_pairs(spark).withColumn("field", F.concat(F.lit("f"), (F.col("i") % 2).cast("string"))))


@query("q58_digit_runs", "SELECT p_partkey, list_transform(regexp_extract_all(p_name || p_size, '[0-9]+'), lambda x: CAST(length(x) AS INTEGER)) AS widths FROM part")
def _q58(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", validate.digit_run_widths(F.concat("p_name", F.col("p_size").cast("string"))).alias("widths"))


# ---- whole tables -------------------------------------------------------------------------------------------------------


def _shift(q, column):
    return maskers.masker("date_shuffle_year")(q, q.iso(column, "yyyy-MM-dd"))


@query("q70_bulk_mask_lineitem", f"""
WITH d AS (SELECT l_returnflag AS v FROM lineitem GROUP BY 1), m AS (SELECT v, {_CYCLE.format(v='v', o='v')} AS r FROM d)
SELECT l_orderkey, l_linenumber, coalesce(r, l_returnflag) AS l_returnflag, masked AS l_shipdate FROM
(SELECT l_orderkey, l_linenumber, l_returnflag, {maskers.masker('date_shuffle_year')(DUCK, 'day')} AS masked FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem) x) y LEFT JOIN m ON l_returnflag = v""")
def _q70(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"))
    mapping = M.cycle(M.distinct_values(df, "l_returnflag"), "l_returnflag", "value")
    return Engine(spark).apply(df, "lineitem", {("lineitem", "l_shipdate"): "date_shuffle_year", ("lineitem", "l_returnflag"): "genre"}, mapping)


@query("q71_masked_customer", f"""
WITH n AS (SELECT v, {_CYCLE.format(v='v', o='v')} AS r FROM (SELECT DISTINCT c_name AS v FROM customer)),
g AS (SELECT v, {_CYCLE.format(v='v', o='p')} AS r FROM (SELECT c_mktsegment AS v, min(c_custkey) AS p FROM customer GROUP BY 1)),
c AS (SELECT *, {PHONE} AS p0, {EMAIL} AS e0, {ZIP} AS z0 FROM customer)
SELECT c_custkey, n.r AS c_name, c_nationkey, c_acctbal, g.r AS c_mktsegment, {maskers.phone(DUCK, 'p0')} AS phone, {maskers.email(DUCK, 'e0')} AS email, {maskers.postal_code(DUCK, 'z0')} AS zip
FROM c JOIN n ON c_name = n.v JOIN g ON c_mktsegment = g.v""")
def _q71(spark, sf_dir):
    return _masked_customer(spark, sf_dir)[1]


@query("q72_random_member_differs", "SELECT count(DISTINCT p_brand) AS values, CAST(0 AS BIGINT) AS same FROM part")
def _q72(spark, sf_dir):
    return M.random_member(read(spark, sf_dir, "part"), "p_brand").agg(F.count("*").alias("values"), F.count_if(F.col("value") == F.col("replacement")).alias("same"))
