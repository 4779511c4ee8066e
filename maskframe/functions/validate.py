"""Checks of replacements, and parsing of a generator's answer."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a placeholder, an e-mail, a date.
PLACEHOLDER = r"(?i)^(n/?a|null|none|undefined|unknown|-+|_+|\*+|\.{3}|<[^>]*>|аноним[\p{L}0-9_]*|скрыт[\p{L}0-9_]*|обфуск[\p{L}0-9_]*|заглушк[\p{L}0-9_]*)$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
DATE_LIKE = r"^[0-9]{2,4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}"


def format_violation(original: Column, replacement: Column) -> Column:
    """Why a replacement is refused: empty, placeholder, unchanged, not an e-mail, domain changed, not a date, not digits; null if it's fine."""
    o, r = original, F.coalesce(replacement, F.lit(""))
    domain = lambda c: F.substring_index(c, "@", -1)
    return (
        F.when(F.trim(r) == "", "empty")
        .when(F.trim(r).rlike(PLACEHOLDER), "placeholder")
        .when(o == r, "unchanged")
        .when(o.rlike(EMAIL), F.when(~r.rlike(EMAIL), "not an e-mail").when(domain(o) != domain(r), "domain changed"))
        .when(o.rlike(DATE_LIKE), F.when(~r.rlike(DATE_LIKE), "not a date"))
        .when(o.rlike("^[0-9]+$"), F.when(~r.rlike("^[0-9]+$"), "not digits"))
    )


def fingerprint(value: Column) -> Column:
    """Class of each character: digit 9, Latin A or a, other letters C or c, space S, all else itself."""
    out = F.regexp_replace(value, r"[0-9]", "9")
    out = F.regexp_replace(out, "[A-Z]", "A")
    out = F.regexp_replace(out, "[a-z]", "a")
    out = F.regexp_replace(out, r"[\p{Lu}&&[^A-Z]]", "C")
    return F.regexp_replace(out, r"[\p{Ll}&&[^a-z]]", "c")


def skeleton(value: Column) -> Column:
    return F.regexp_replace(value, r"[\p{L}\p{N}]", "")


def digit_run_widths(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit("([0-9]+)"), F.lit(1)), lambda x: F.length(x))


def has_cyrillic(value: Column) -> Column:
    """Whether any letter from а to я occurs, in either case; ё alone doesn't count."""
    return value.rlike("(?iu)[а-я]")


def extract_json(text: str) -> dict:
    """The object of strings in a generator's answer: as it is, in a fence, the outer braces, with trailing commas, with single quotes, or the
    pairs that can be found (two at least); else nothing."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    outer = re.search(r"\{.*\}", text, re.S)
    for some in (text, fenced and fenced[1], outer and outer[0]):
        if not some:
            continue
        for attempt in (some, re.sub(r",\s*([}\]])", r"\1", some), some.replace("'", '"')):
            try:
                got = json.loads(attempt)
            except ValueError:
                continue
            if isinstance(got, dict):
                return got
    pairs = re.findall(r'"([^"]+)"\s*:\s*"([^"]*)"', text)
    return dict(pairs) if len(pairs) >= 2 else {}


def mask_like(value: Column) -> Column:
    """E-mails, dates, and values with a digit and one of - / . blank."""
    return value.rlike(EMAIL) | value.rlike(DATE_LIKE) | (value.rlike("[0-9]") & value.rlike("[-/. ]"))


def code_like(value: Column) -> Column:
    """No run of more than three letters."""
    return ~value.rlike(r"\p{L}{4}")


# Words that don't carry the case of a title.
PARTICLES = "a an the of and or upon in on at to for de la le du del von van di da и в с на о у к от из для по но или".split()


def case_violation(original: Column, replacement: Column) -> Column:
    """Whether words at the same place begin with different case; with another number of words, or next to particles, never."""
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    bare = lambda w: F.lower(F.regexp_replace(w, r"^[.,()!?:;\-«»\"']+|[.,()!?:;\-«»\"']+$", ""))
    upper = lambda w: F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))
    differ = F.zip_with(words(original), words(replacement), lambda a, b: ~bare(a).isin(PARTICLES) & ~bare(b).isin(PARTICLES) & (upper(a) != upper(b)))
    return (F.size(words(original)) == F.size(words(replacement))) & F.exists(differ, lambda x: F.coalesce(x, F.lit(False)))
