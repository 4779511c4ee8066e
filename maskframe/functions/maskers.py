"""Format-preserving maskers as native SQL expressions: no shuffle, no Python in the plan, the same result in every run and partition.

Each function takes a dialect and the SQL text of a string value, and returns the SQL text of the masked value. Common contract: null gives
null; values outside a masker's grammar are unchanged; length, character class and case are kept at every position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.dialect import SPARK, Spark, byte, digest, draw

# Alphabets, and the words of an address that say what the others are.
CONSONANTS_EN = "bcdfghjklmnprstvwxz"
VOWELS_EN = "aeiou"
CONSONANTS_RU = "бвгдзжклмнпрстфхцчшщ"
VOWELS_RU = "аеиоуыэюя"
ADDRESS_WORDS = [
    "ул", "улица", "пр", "просп", "проспект", "пер", "переулок", "переул", "ш", "шоссе", "бр", "бульвар", "бул", "наб", "набережная", "корп",
    "корпус", "кор", "к", "д", "дом", "стр", "строение", "офис", "оф", "кв", "квартира", "комната", "ком", "пом", "помещение", "каб", "кабинет",
    "эт", "этаж", "г", "город", "обл", "область", "рн", "район", "с", "село", "дер", "деревня", "дб", "пос", "посёлок", "поселок", "ст", "станция",
    "пл", "площадь", "туп", "тупик", "проезд", "тракт", "аллея", "мкр", "микрорайон", "тер", "территория", "вл", "влад", "владение", "блок", "лит",
    "н", "ц", "дк", "озд", "снт", "ут", "уч", "респ", "республика", "ак", "акад", "шт", "цех", "склад", "база", "лагерь", "пансионат", "хоз",
    "комбинат", "st", "ave", "av", "rd", "blvd", "dr", "ln", "way", "ct", "pl", "hwy", "pkwy", "sq", "ter", "cir", "apt", "unit", "suite", "ste",
    "bldg", "fl", "no", "nw", "ne", "se", "sw",
]
STOP_WORDS = [
    "и", "с", "в", "на", "при", "у", "от", "из", "по", "для", "без", "или", "как", "the", "of", "and", "de", "la", "le", "das", "van",
]

RUNS = "[0-9]+|[A-Za-z]+|[А-Яа-яЁё]+|[^0-9A-Za-zА-Яа-яЁё]"


def _digit(d: str, b: str) -> str:
    """Another digit."""
    return f"cast((cast({d} as int) + 1 + ({b}) % 9) % 10 as string)"


def _case(c: str, new: str) -> str:
    return f"case when {c} <> lower({c}) then upper({new}) else {new} end"


def _other(alphabet: str, c: str, b: str) -> str:
    """Another letter of an alphabet that holds c; any letter of it else."""
    n = len(alphabet)
    at = f"instr('{alphabet}', lower({c}))"
    return f"substr('{alphabet}', cast(case when {at} > 0 then ({at} + ({b}) % {n - 1}) % {n} else ({b}) % {n} end + 1 as int), 1)"


def _letter(c: str, b: str, vowel: str) -> str:
    """A letter of c's script and case; vowel: condition for a vowel. Letters of other scripts stay."""
    latin = f"case when {vowel} then {_other(VOWELS_EN, c, b)} else {_other(CONSONANTS_EN, c, b)} end"
    russian = f"case when {vowel} then {_other(VOWELS_RU, c, b)} else {_other(CONSONANTS_RU, c, b)} end"
    return _case(c, f"(case when lower({c}) between 'a' and 'z' then {latin} else {russian} end)")


def _pseudo_word(q: Spark, w: str, h: str) -> str:
    """A word with w's length, script, case and pattern of vowels, drawn from the digest h; a word without vowels gets one."""
    vowels = VOWELS_EN + VOWELS_RU + "ё"
    c = f"substr({w}, cast(j as int), 1)"
    bare = f"case when length(translate(lower({w}), '{vowels}', '')) = length({w}) then least(2, length({w})) else 0 end"
    vowel = f"(instr('{vowels}', lower({c})) > 0 or j = nv)"
    return q.let("nv", bare, q.join(q.tr(q.seq(f"length({w})"), "j", _letter(c, _nth(h), vowel))))


def _nth(h: str) -> str:
    """The digest's byte for character j."""
    return byte(h, "(j - 1) % 32")


def phone(q: Spark, v: str) -> str:
    """Digits from a position that depends on their number are replaced by others drawn from the SHA-256 of the trimmed value; fewer than four
    digits: unchanged. Everything that isn't a digit stays."""
    count = lambda x: f"length({q.replace(x, '[^0-9]', '')})"
    n = count("r")
    start = f"(case when {n} - least(greatest(2, {q.div(n, 3)}), greatest(5, {n} - 3)) < 3 then greatest(0, {n} - 3) else least(greatest(2, {q.div(n, 3)}), greatest(5, {n} - 3)) end)"
    c = "substr(r, cast(p as int), 1)"
    k = f"({count('substr(r, 1, cast(p as int))')} - 1 - s)"
    d = f"cast({c} as int)"
    mixed = f"(({_xor(q, byte('h', f'(3 * {k}) % 32'), f'({_or(q, f"{d} * 4", f"7 * {k}")})')}) + 3 * {d})"
    new = f"case when {mixed} % 10 = {d} then ({mixed} + 11) % 10 else {mixed} % 10 end"
    body = q.join(q.tr(q.seq("length(r)"), "p", f"case when {c} between '0' and '9' and {k} >= 0 then cast({new} as string) else {c} end"))
    whole = q.let("s", start, q.let("h", q.sha("r"), body))
    return f"case when {v} is null then null else {q.let('r', f'trim({v})', f'case when {n} < 4 then r else {whole} end')} end"


def _xor(q: Spark, a: str, b: str) -> str:
    return f"xor(cast({a} as bigint), cast({b} as bigint))" if type(q) is not Spark else f"(cast({a} as bigint) ^ cast({b} as bigint))"


def _or(q: Spark, a: str, b: str) -> str:
    return f"(cast({a} as bigint) | cast({b} as bigint))"


def email(q: Spark, v: str) -> str:
    """The part before the last @ is rebuilt run by run: digits by others, words by pseudo-words; the domain stays byte for byte."""
    local = q.let("l", q.replace(v, "@[^@]*$", ""), q.join(q.let("rs", q.runs("l", RUNS), q.tr(q.seq(q.size("rs")), "i", q.let("w", q.at("rs", "i"), _email_run(q))))))
    domain = f"substr({v}, length({q.replace(v, '@[^@]*$', '')}) + 1)"
    gate = q.like(v, "^[^@ \t\n\r]+@[^@ \t\n\r]+[.][^@ \t\n\r]+$")
    return f"case when {gate} then concat({local}, {domain}) else {v} end"


def _email_run(q: Spark) -> str:
    digits = q.join(q.tr(q.seq("length(w)"), "j", _digit("substr(w, cast(j as int), 1)", _nth("h"))))
    new = f"case when {q.like('w', '^[0-9]')} then {digits} else {_pseudo_word(q, 'w', 'h')} end"
    return f"case when {q.like('w', '^[0-9A-Za-zА-Яа-яЁё]')} then {q.let('h', digest(q, 'l', 'i'), new)} else w end"


def postal_code(q: Spark, v: str) -> str:
    """Leading zeros stay (at least one character always changes), other digits become others, letters pseudo-words of their script."""
    some = "0-9A-Za-zА-Яа-яЁё"
    alnum = f"length({q.replace(v, f'[^{some}]', '')})"
    zeros = f"length({v}) - length({q.replace(v, f'^[^{some}]*(0[^{some}]*)+', '')})"
    # If all are zeros, the last one isn't protected.
    all_zero = q.like(v, f"^[^{some}]*(0[^{some}]*)+$")
    last = f"length({q.replace(v, f'0[^{some}]*$', '')})"
    kept = f"(case when {all_zero} then {last} else {zeros} end)"
    runs = q.let("rs", q.runs("r", RUNS), q.tr(q.seq(q.size("rs")), "i", q.let("w", q.at("rs", "i"), _postal_run(q))))
    body = q.let("k", kept, f"concat(substr({v}, 1, cast(k as int)), {q.let('r', f'substr({v}, cast(k + 1 as int))', q.join(runs))})")
    return f"case when {v} is null or upper(trim({v})) = 'NULL' or {alnum} < 3 then {v} else {body} end"


def _postal_run(q: Spark) -> str:
    digits = q.join(q.tr(q.seq("length(w)"), "j", _digit("substr(w, cast(j as int), 1)", _nth("h"))))
    new = f"case when {q.like('w', '^[0-9]')} then {digits} else {_pseudo_word(q, 'w', 'h')} end"
    return f"case when {q.like('w', '^[0-9A-Za-zА-Яа-яЁё]')} then {q.let('h', digest(q, 'r', 'i'), new)} else w end"


def address(q: Spark, v: str) -> str:
    """Words become pseudo-words, except address words, stop words and single letters; with an address word
    in it, two-letter words stay too. Numbers keep width and leading zeros; everything else stays."""
    words = ", ".join(f"'{w}'" for w in dict.fromkeys(ADDRESS_WORDS))
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    structured = f"{q.size(q.filter('rs', 't', f'lower(t) in ({words})'))} > 0"
    zeros = f"(length(w) - length({q.replace('w', '^0+', '')}))"
    c = "substr(w, cast(j as int), 1)"
    b = _nth("h")
    first = f"cast((cast({c} as int) - 1 + 1 + {b} % 8) % 9 + 1 as string)"
    number = q.join(q.tr(q.seq("length(w)"), "j", f"case when j <= {zeros} then '0' when j = {zeros} + 1 and length(w) > 1 then {first} else {_digit(c, b)} end"))
    keep = f"(lower(w) in ({words}) or lower(w) in ({stops}) or length(w) <= 1 or (length(w) <= 2 and {structured}))"
    new = q.let("h", digest(q, "a", "i"), f"case when {q.like('w', '^[0-9]')} then {number} else {_pseudo_word(q, 'w', 'h')} end")
    run = f"case when {q.like('w', '^[^0-9A-Za-zА-Яа-яЁё]')} or (not {q.like('w', '^[0-9]')} and {keep}) then w else {new} end"
    body = q.let("a", v, q.let("rs", q.runs("a", RUNS), q.join(q.tr(q.seq(q.size("rs")), "i", q.let("w", q.at("rs", "i"), run)))))
    return f"case when {v} is null or trim({v}) = '' or upper(trim({v})) = 'NULL' then {v} else {body} end"


# ---- dates --------------------------------------------------------------------------------------------------------------

_TIME = "([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?([.,][0-9]{1,9})?(Z|[+-][0-9]{2}:?[0-9]{2})?"
_TAIL = f"(|[T ]{_TIME}|([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]|[.,][0-9]{{1,9}})"
_YMD = f"^([0-9]{{4}})([-/.])([0-9]{{1,2}})([-/.])([0-9]{{1,2}}){_TAIL}$"
_DMY = f"^([0-9]{{1,2}})([-/.])([0-9]{{1,2}})([-/.])([0-9]{{4}}){_TAIL}$"
_COMPACT = f"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}}){_TAIL}$"


def _days_in(y: str, m: str) -> str:
    return f"(case when {m} in (4, 6, 9, 11) then 30 when {m} = 2 then case when {y} % 4 = 0 and ({y} % 100 <> 0 or {y} % 400 = 0) then 29 else 28 end else 31 end)"


def _shifted(q: Spark, scope: str, y: str, m: str, d: str, b: str, wm: str) -> tuple[str, str, str]:
    """(year, month, day) after the shift. wm: digits of the month as written."""
    if scope == "year":
        y2 = f"({y} + {q.at(q.array(['-2', '-1', '1', '2']), f'{b} % 4 + 1')})"
        return y2, m, f"least({d}, {_days_in(y2, m)})"
    if scope == "month":
        m2 = f"(case when {wm} = 1 then ({m} + {b} % 8) % 9 + 1 else ({m} + {b} % 11) % 12 + 1 end)"
        return y, m2, f"least({d}, {_days_in(y, m2)})"
    offset = f"(case when {b} % 60 < 30 then {b} % 60 - 30 else {b} % 60 - 29 end)"
    at = f"({q.days(y, m, d)} + {offset})"
    return tuple(f"cast({q.part(p, at)} as int)" for p in ("year", "month", "day"))


def _padded(n: str, width: str) -> str:
    return f"case when {width} = 2 then lpad(cast({n} as string), 2, '0') else cast({n} as string) end"


def date_shift(q: Spark, v: str, scope: str) -> str:
    """Shifts the date in a string by scope (month, year or days); order, widths, separators and the time stay. Seconds and milliseconds since
    1970 keep their time of day. What isn't a valid date stays."""
    if scope not in ("month", "year", "days"):
        raise ValueError(scope)
    b = "b"

    def bound(pattern, groups, inner):
        """inner with the pattern's groups as g, found once."""
        return q.let("g", q.array([f"regexp_extract(x, '{pattern}', {i})" for i in range(1, groups + 1)]), inner)

    def group(i):
        return q.at("g", i)

    def family(at, swap, tail):
        """at: groups of (year, month, day); swap: groups in written order with the separators between; tail: the group of the time."""
        y, m, d = (f"cast({group(i)} as int)" for i in at)
        wm, wd = (f"length({group(i)})" for i in at[1:])
        y2, m2, d2 = _shifted(q, scope, y, m, d, b, wm)
        text = {at[0]: f"lpad(cast({y2} as string), 4, '0')", at[1]: _padded(m2, wm), at[2]: _padded(d2, wd)}
        out = f"concat({', '.join(text.get(i, group(i)) for i in swap)}, {group(tail)})"
        valid = f"({m} between 1 and 12 and {d} between 1 and {_days_in(y, m)} and {y} between 3 and 9997)"
        if scope == "days":  # another day may not have the width of an unpadded one
            valid = f"({valid} and {wm} = 2 and {wd} = 2)"
        return f"case when {valid} then {out} else x end"

    def unix(scale):
        seconds = f"cast({q.div('cast(x as bigint)', scale)} as bigint)"
        day = q.div(seconds, 86400)
        y, m, d = (f"cast({q.part(p, day)} as int)" for p in ("year", "month", "day"))
        y2, m2, d2 = _shifted(q, scope, y, m, d, b, "2")
        new = f"({q.days(y2, m2, d2)} * cast(86400 as bigint) + {seconds} % 86400) * {scale} + cast(x as bigint) % {scale}"
        return f"case when length(cast({new} as string)) = length(x) then cast({new} as string) else x end"

    same = f"{group(2)} = {group(4)}"
    american = f"cast({group(3)} as int) > 12 and cast({group(1)} as int) <= 12"
    day_first = f"case when not {same} then x when {american} then {family((5, 1, 3), (1, 2, 3, 4, 5), 6)} else {family((5, 3, 1), (1, 2, 3, 4, 5), 6)} end"
    body = (
        f"case when {q.like('x', '^[0-9]{10}$')} then {unix(1)} when {q.like('x', '^[0-9]{13}$')} then {unix(1000)} "
        f"when {q.like('x', _COMPACT)} then {bound(_COMPACT, 4, family((1, 2, 3), (1, 2, 3), 4))} "
        f"when {q.like('x', _YMD)} then {bound(_YMD, 6, f'case when {same} then {family((1, 3, 5), (1, 2, 3, 4, 5), 6)} else x end')} "
        f"when {q.like('x', _DMY)} then {bound(_DMY, 6, day_first)} "
        "else x end"
    )
    body = q.let("b", draw(q, "x", "0"), body)
    inside = q.let("x", f"trim({v})", body)
    lead = f"substr({v}, 1, length({v}) - length(ltrim({v})))"
    trail = f"substr({v}, length(rtrim({v})) + 1)"
    return f"case when {v} is null or trim({v}) = '' then {v} else concat({lead}, {inside}, {trail}) end"


def date_scope(column: str, rule: str | None = None) -> str:
    """month, year or days: as the rule's name ends, else by the column's name."""
    for scope in ("month", "year", "days"):
        if rule and (rule.strip().lower() == scope or rule.strip().lower().endswith(f"_{scope}")):
            return scope
    name = column.lower()
    if "_month" in name or name.endswith("month") or "hire" in name:
        return "month"
    return "year" if "_year" in name or name.endswith("year") or "birth" in name else "days"


MASKERS = {
    "email": email,
    "phone": phone,
    "postal_code": postal_code,
    "address": address,
    "date_shuffle_month": lambda q, v: date_shift(q, v, "month"),
    "date_shuffle_year": lambda q, v: date_shift(q, v, "year"),
    "date_shuffle_days": lambda q, v: date_shift(q, v, "days"),
    "skip": lambda q, v: v,
}

_OWN: dict = {}


def register_masker(name: str, function) -> None:
    """function(dialect, sql text of a value) -> sql text. Registered maskers may be named in rules."""
    _OWN[name] = function


def masker(name: str, column: str = ""):
    """The masker of a type; date_shuffle without a scope takes it from the column's name."""
    if name == "date_shuffle":
        name = f"date_shuffle_{date_scope(column)}"
    if name in _OWN:
        return _OWN[name]
    if name not in MASKERS:
        raise ValueError(f"no masker {name}")
    return MASKERS[name]


def mask(name: str, column: str) -> Column:
    """The masked column as a native Spark expression."""
    return F.expr(masker(name, column)(SPARK, f"`{column}`" if column.isidentifier() else column))
