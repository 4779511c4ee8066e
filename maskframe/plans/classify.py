"""Column classification: one aggregation over the distinct values, then a chain of rules; the first that matches names the type.

Explicit rules come first, then key and measure columns (skipped), then columns with one distinct value (none), then the chain.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.plans.profile import scalar_columns

# Names and patterns of the rules, in their order.
SKIP_NAMES = "id$|^pk$|^reportsto$|^managerid$|^repid$|quantity|unitprice|total|bytes|milliseconds|duration|weight"
DATE = "^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|^[0-9]{8}$"
PHONE = "[+][0-9]|[(][0-9]{2,4}[)]|^8-[0-9]|[0-9]{2,4}[- ][0-9]|[0-9]{4}-[0-9]{2}"
NUMERIC = "^[0-9.,+-]+$"
NAMES_BEFORE = [
    ("city|state|country|postalcode|postal_code|town", "genre"),
    ("company", "company"),
    ("composer", "composer"),
    ("name", "name"),
    ("^title$", "title"),
    ("address|legal", "address"),
    ("genre|media_type|playlist|type|category", "genre"),
    ("industry|sector|classification", "genre"),
    ("currency|^code$|^iso_code$", "genre"),
    ("status|stage|terms|method|payment_type", "genre"),
    ("leadsource|lead_source|marketing|campaign|referral", "genre"),
]
NAMES_AFTER = [("notes|description|comment|memo|biography", "skip"), ("website|url|domain", "skip")]
TAX_NAMES = "inn|kpp|ogrn|passport|vat|tax_id"


def chain(name: str, n: str, at_sign: str, dates: str, colon: str, phones: str, numeric: str, like) -> str:
    """The rules as a SQL CASE. like(text, pattern): the engine's search for a pattern."""
    rules = [
        (f"{at_sign} > 0", "'email'"),
        (like(name, TAX_NAMES), "'skip'"),
        (f"{dates} > 0.7 * {n}", f"case when {colon} > 0 then 'date_shuffle_month' else 'date_shuffle_year' end"),
        (f"{phones} > 0.5 * {n}", "'phone'"),
        *((like(name, p), f"'{t}'") for p, t in NAMES_BEFORE),
        (f"{numeric} = {n}", "'skip'"),
        *((like(name, p), f"'{t}'") for p, t in NAMES_AFTER),
    ]
    return "case " + " ".join(f"when {c} then {t}" for c, t in rules) + " else 'genre' end"


def is_skip_column(column: str) -> bool:
    return re.search(SKIP_NAMES, column.lower()) is not None


#: Longer values are looked at where they are read, and only their hashes and flags are shuffled.
SHORT = 64


def flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: n, at_sign, dates, colon, phones, numeric (counts of distinct values; numbers are told apart as numbers).

    Short values are made distinct first and looked at then. Long ones, which are seldom repeated, are looked at where they are read; what
    is shuffled of them is a 128-bit hash with the flags."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(c):
        x = F.col(f"`{c}`")
        if isinstance(kinds[c], T.FractionalType):
            finite = x.isNotNull() & ~F.isnan(x.cast("double"))
            return F.struct(F.lit(c).alias("column"), F.when(finite, F.lit("0")).alias("value"), F.xxhash64(x).alias("number"))
        v = F.trim(x.cast("string"))
        return F.struct(F.lit(c).alias("column"), F.when(v != "", v).alias("value"), F.lit(None).cast("long").alias("number"))

    def told(v):
        digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
        return {"at_sign": v.contains("@"), "dates": v.rlike(DATE), "colon": v.contains(":"), "phones": v.rlike(PHONE) & (digits >= 7), "numeric": v.rlike(NUMERIC)}

    value = F.col("value")
    long_ = F.length(value) > SHORT
    cells = df.select(F.explode(F.array(*map(cell, columns))).alias("c")).select("c.*").where("value is not null")
    hashes = [F.when(long_, F.xxhash64(F.lit(i), value)).alias(f"h{i}") for i in (1, 2)]
    one = cells.select("column", "number", F.when(~long_, value).alias("value"), *hashes, *(F.when(long_, t).alias(n) for n, t in told(value).items())).distinct()
    one = one.select("column", *(F.coalesce(n, t).alias(n) for n, t in told(value).items()))
    return one.groupBy("column").agg(F.count("*").alias("n"), *(F.count_if(n).alias(n) for n in told(value)))


def classify(df: DataFrame, table: str, rules: dict[str, str] | None = None, min_distinct: int = 2) -> DataFrame:
    """table, column, type, samples (distinct values; null for columns settled by name or type alone), note. Columns with fewer than min_distinct
    different values are none. Columns settled by a rule or their name aren't read."""
    spark = df.sparkSession
    rules = rules or {}
    settled, open_ = [], []
    for c in scalar_columns(df):
        rule = rules.get(f"{table}.{c}") or rules.get(f"{table}_{c}")
        if rule:
            settled.append((table, c, rule, "explicit rule"))
        elif is_skip_column(c):
            settled.append((table, c, "skip", "key or measure"))
        else:
            open_.append(c)
    like = lambda x, p: f"{x} rlike '{p}'"
    kind = F.expr(chain("lower(column)", "n", "at_sign", "dates", "colon", "phones", "numeric", like))
    known = spark.createDataFrame(settled, "table string, column string, type string, note string").select("table", "column", "type", F.lit(None).cast("long").alias("samples"), "note")
    if not open_:
        return known
    found = flags(df, open_).withColumn("type", F.when(F.col("n") < min_distinct, "none").otherwise(kind))
    note = (
        F.when(F.col("type") == "email", F.concat(F.col("at_sign").cast("string"), F.lit(" e-mails")))
        .when(F.col("type") == "phone", F.concat(F.col("phones").cast("string"), F.lit(" phone-like")))
        .when(F.col("type") == "genre", F.concat(F.col("n").cast("string"), F.lit(" values, each to the next")))
        .otherwise("")
    )
    return known.unionByName(found.select(F.lit(table).alias("table"), "column", "type", F.col("n").alias("samples"), note.alias("note")))
