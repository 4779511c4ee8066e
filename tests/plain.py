"""The maskers once more, as plain Python: a second opinion for the tests. Nothing of the library's SQL templates is used."""

import calendar
import datetime
import hashlib
import re

from maskframe.functions.maskers import ADDRESS_WORDS, STOP_WORDS

LATIN = ("aeiou", "bcdfghjklmnprstvwxz")
RUSSIAN = ("аеиоуыэюя", "бвгдзжклмнпрстфхцчшщ")
VOWELS = set("aeiouаеиоуыэюяё")
RUNS = re.compile("[0-9]+|[A-Za-z]+|[А-Яа-яЁё]+|[^0-9A-Za-zА-Яа-яЁё]")


def sha(text):
    return hashlib.sha256(text.encode()).digest()


def draws(value, place):
    h = sha(f"{value}|{place}")
    return lambda j: h[(j - 1) % 32]


def other_digit(d, b):
    return str((int(d) + 1 + b % 9) % 10)


def other_letter(c, b, vowel):
    vowels, consonants = LATIN if "a" <= c.lower() <= "z" else RUSSIAN
    pool = vowels if vowel else consonants
    at = pool.find(c.lower()) + 1
    new = pool[(at + b % (len(pool) - 1)) % len(pool)] if at else pool[b % len(pool)]
    return new.upper() if c != c.lower() else new


def pseudo_word(w, b):
    lone = min(2, len(w)) if not VOWELS & set(w.lower()) else 0
    return "".join(other_letter(c, b(j), c.lower() in VOWELS or j == lone) for j, c in enumerate(w, 1))


def run_by_run(text, change):
    return "".join(change(w, draws(text, i)) for i, w in enumerate(RUNS.findall(text), 1))


def plain_run(w, b):
    if w[0].isascii() and w[0].isdigit():
        return "".join(other_digit(c, b(j)) for j, c in enumerate(w, 1))
    return pseudo_word(w, b) if re.match("[A-Za-zА-Яа-яЁё]", w) else w


def email(v):
    if v is None or not re.match("^[^@ \t\n\r]+@[^@ \t\n\r]+[.][^@ \t\n\r]+$", v):
        return v
    local, at, domain = v.rpartition("@")
    return run_by_run(local, plain_run) + at + domain


def postal_code(v):
    some = re.compile("[0-9A-Za-zА-Яа-яЁё]")
    if v is None or v.strip().upper() == "NULL" or len(some.findall(v)) < 3:
        return v
    signs = [i for i, c in enumerate(v) if some.match(c)]
    zeros = next((n for n, i in enumerate(signs) if v[i] != "0"), len(signs))
    kept = signs[-1] if zeros == len(signs) else signs[zeros] if zeros else 0
    return v[:kept] + run_by_run(v[kept:], plain_run)


def address(v):
    if v is None or not v.strip() or v.strip().upper() == "NULL":
        return v
    structured = any(w.lower() in ADDRESS_WORDS for w in RUNS.findall(v))

    def change(w, b):
        if w[0] in "0123456789":
            zeros = len(w) - len(w.lstrip("0"))
            out = ""
            for j, c in enumerate(w, 1):
                if j <= zeros:
                    out += "0"
                elif j == zeros + 1 and len(w) > 1:
                    out += str((int(c) + b(j) % 8) % 9 + 1)
                else:
                    out += other_digit(c, b(j))
            return out
        if not re.match("[A-Za-zА-Яа-яЁё]", w):
            return w
        if w.lower() in ADDRESS_WORDS or w.lower() in STOP_WORDS or len(w) <= 1 or (len(w) <= 2 and structured):
            return w
        return pseudo_word(w, b)

    return run_by_run(v, change)


def shifted(scope, y, m, d, b, month_width):
    days = lambda y, m: calendar.monthrange(y, m)[1]
    if scope == "year":
        y += (-2, -1, 1, 2)[b % 4]
    elif scope == "month":
        m = (m + b % 8) % 9 + 1 if month_width == 1 else (m + b % 11) % 12 + 1
    else:
        new = datetime.date(y, m, d) + datetime.timedelta(days=b % 60 - 30 if b % 60 < 30 else b % 60 - 29)
        return new.year, new.month, new.day
    return y, m, min(d, days(y, m))


def iso_date(v, scope):
    """date_shift of YYYY-MM-DD, with or without blanks around."""
    x = v.strip()
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", x)
    y, month, d = map(int, m.groups())
    try:
        datetime.date(y, month, d)
    except ValueError:
        return v
    new = shifted(scope, y, month, d, sha(f"{x}|0")[0], 2)
    return v.replace(x, "{:04}-{:02}-{:02}".format(*new))
