"""The few places where Spark SQL and DuckDB SQL spell an expression differently.

Maskers are written once as SQL text over a dialect; Spark compiles them as native expressions, and the same contract can be run elsewhere.
"""

from __future__ import annotations

HEX = "0123456789abcdef"


class Spark:
    def sha(self, x):
        return f"sha2({x}, 256)"

    def tr(self, items, v, body):
        return f"transform({items}, {v} -> {body})"

    def seq(self, n):
        return f"if({n} > 0, sequence(1, cast({n} as int)), cast(array() as array<int>))"

    def join(self, items):
        return f"array_join({items}, '')"

    def runs(self, x, pattern):
        return f"regexp_extract_all({x}, '{pattern}', 0)"

    def at(self, items, i):
        return f"element_at({items}, cast({i} as int))"

    def let(self, v, x, body):
        return f"element_at(transform(array({x}), {v} -> {body}), 1)"

    def replace(self, x, pattern, to):
        return f"regexp_replace({x}, '{pattern}', '{to}')"

    def array(self, items):
        return f"array({', '.join(items)})"

    def filter(self, items, v, cond):
        return f"filter({items}, {v} -> {cond})"

    def size(self, items):
        return f"size({items})"

    def like(self, x, pattern):
        return f"({x} rlike '{pattern}')"

    def days(self, y, m, d):
        return f"datediff(make_date({y}, {m}, {d}), date '1970-01-01')"

    def part(self, what, days):
        return f"{what}(date_add(date '1970-01-01', cast({days} as int)))"

    def div(self, a, b):
        return f"({a} div {b})"

    def iso(self, x, pattern):
        return f"date_format({x}, '{pattern}')"


class Duck(Spark):
    def sha(self, x):
        return f"sha256({x})"

    def tr(self, items, v, body):
        return f"list_transform({items}, lambda {v}: {body})"

    def seq(self, n):
        return f"range(1, {n} + 1)"

    def join(self, items):
        return f"coalesce(array_to_string({items}, ''), '')"

    def runs(self, x, pattern):
        return f"regexp_extract_all({x}, '{pattern}')"

    def at(self, items, i):
        return f"list_extract({items}, {i})"

    def let(self, v, x, body):
        return f"list_extract(list_transform([{x}], lambda {v}: {body}), 1)"

    def replace(self, x, pattern, to):
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def array(self, items):
        return f"[{', '.join(items)}]"

    def filter(self, items, v, cond):
        return f"list_filter({items}, lambda {v}: {cond})"

    def size(self, items):
        return f"len({items})"

    def like(self, x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    def days(self, y, m, d):
        return f"date_diff('day', date '1970-01-01', make_date({y}, {m}, {d}))"

    def part(self, what, days):
        return f"{what}(date '1970-01-01' + cast({days} as int))"

    def div(self, a, b):
        return f"({a} // {b})"

    def iso(self, x, pattern):
        for a, b in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")):
            pattern = pattern.replace(a, b)
        return f"strftime({x}, '{pattern}')"


SPARK, DUCK = Spark(), Duck()


def byte(h: str, i) -> str:
    """Byte i (from 0) of a hex digest."""
    return f"((instr('{HEX}', substr({h}, cast(2 * ({i}) + 1 as int), 1)) - 1) * 16 + instr('{HEX}', substr({h}, cast(2 * ({i}) + 2 as int), 1)) - 1)"


def draw(q: Spark, value: str, *place: str) -> str:
    """A number from 0 to 255 that depends on the value and the place only."""
    return byte(q.sha(f"concat({value}, {', '.join(f"'|', cast({p} as string)" for p in place)})"), 0)


def digest(q: Spark, value: str, place: str) -> str:
    """A hex digest that depends on the value and the place only; one gives 32 draws."""
    return q.sha(f"concat({value}, '|', cast({place} as string))")
