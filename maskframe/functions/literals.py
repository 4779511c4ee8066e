"""SQL literals: tuples, tokens, escaping. Native expressions, and their patterns for the dump reader."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LITERAL = r"'(?:[^'\\]++|\\.|'')*+'|\"(?:[^\"\\]++|\\.|\"\")*+\"|`[^`]*+`"
TOKEN = rf"(?:[^'\"`(),]++|{LITERAL}|\((?:[^'\"`()]++|{LITERAL})*+\))++"
TUPLE = rf"\((?:[^'\"`()]++|{LITERAL}|\((?:[^'\"`()]++|{LITERAL})*+\))*+\)"
NUMBER = r"^[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?$"
BARE_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
PASS_LINES = r"^\s*$|^\s*(/\*|--|SET |USE |DROP |CREATE DATABASE|LOCK TABLES|UNLOCK TABLES|START TRANSACTION|COMMIT|BEGIN|SHOW |ALTER)"

#: Escapes of the dump's dialect.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}
_ESCAPED = re.compile(r"\\(.)|''|\"\"", re.S)


def unescape_text(body: str, quote: str = "'") -> str:
    return _ESCAPED.sub(lambda m: ESCAPES.get(m[1], m[1]) if m[1] is not None else (quote if m[0][0] == quote else m[0]), body)


def escape_text(value: str, quote: str = "'") -> str:
    back = {v: k for k, v in ESCAPES.items() if v != "\t"}
    return "".join("\\\\" if c == "\\" else quote * 2 if c == quote else "\\" + back[c] if c in back else c for c in value)


def unescape(body: Column) -> Column:
    """The text of a quoted literal's body, as one native expression: a fold over its characters with the pending backslash as state."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("held"))

    def step(s, c):
        known = F.lit(None)
        for k, v in ESCAPES.items():
            known = F.coalesce(F.when(c == k, F.lit(v)), known)
        after_backslash = F.struct(F.concat(s["out"], F.coalesce(known, c)).alias("out"), F.lit("").alias("held"))
        second_quote = F.struct(F.concat(s["out"], F.lit("'")).alias("out"), F.lit("").alias("held"))
        hold = F.struct(s["out"].alias("out"), c.alias("held"))
        plain = F.struct(F.concat(s["out"], s["held"], c).alias("out"), F.lit("").alias("held"))
        return F.when(s["held"] == "\\", after_backslash).when((s["held"] == "'") & (c == "'"), second_quote).when(c.isin("\\", "'"), hold).otherwise(plain)

    return F.aggregate(F.split(body, ""), start, step, lambda s: F.concat(s["out"], F.when(s["held"] == "'", "'").otherwise("")))


def escape(value: Column, quote: str = "'") -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for k, v in ESCAPES.items():
        if v != "\t":
            out = F.replace(out, F.lit(v), F.lit("\\" + k))
    return F.replace(out, F.lit(quote), F.lit(quote * 2))


def same_class(a: str, b: str) -> bool:
    """same_literal_class for two strings."""
    return bool(re.search(NUMBER, a) and re.search(NUMBER, b) and len(a) == len(b)) or bool(re.search(BARE_DATE, a) and re.search(BARE_DATE, b))


def same_literal_class(a: Column, b: Column) -> Column:
    """Both numbers of equal length, or both bare dates."""
    return (a.rlike(NUMBER) & b.rlike(NUMBER) & (F.length(a) == F.length(b))) | (a.rlike(BARE_DATE) & b.rlike(BARE_DATE))


def tuples(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(TUPLE), F.lit(0))


def tokens(tuple_: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.expr("substr(t, 2, length(t) - 2)") if isinstance(tuple_, str) else F.substring(tuple_, F.lit(2), F.length(tuple_) - 2), F.lit(TOKEN), F.lit(0)), lambda x: F.trim(x))


def passes(line: Column) -> Column:
    """Lines that are copied as they are."""
    return line.rlike(PASS_LINES)
