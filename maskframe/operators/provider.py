"""Replacement providers: who proposes replacements for names, titles and companies."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.functions.validate import extract_json, format_violation
from maskframe.operators.mapping import cycle

CHUNK_VALUES, CHUNK_BYTES, VALUE_BYTES = 20, 10_000, 80


def chunk_plan(values: list[str], most: int = CHUNK_VALUES, budget: int = CHUNK_BYTES) -> list[list[str]]:
    """Greedy chunks: a new one when the byte budget or the number of values would be passed."""
    out: list[list[str]] = []
    size = 0
    for v in values:
        cost = VALUE_BYTES + len(v.encode())
        if not out or size + cost > budget or len(out[-1]) >= most:
            out.append([])
            size = 0
        out[-1].append(v)
        size += cost
    return out


def chunk_timeout(n: int, prompt_chars: int, base: float = 45, most: float = 180) -> int:
    return int(max(base, min(most, base + 2 * n + 8 * prompt_chars / 1000)))


def estimate_chars(values: list[str]) -> int:
    """Length of a request for these values."""
    return 400 + VALUE_BYTES * len(values)


def violations(pairs: DataFrame) -> DataFrame:
    """field, reason, n: how many of the pairs (field, original, replacement) fail the format check, and why."""
    told = pairs.withColumn("reason", format_violation(F.col("original"), F.col("replacement")))
    return told.where("reason is not null").groupBy("field", "reason").agg(F.count("*").alias("n"))


def format_rules(field: str = "", refused: int = 0) -> str:
    """What a generator is told about the form of its answers. refused: how many answers for the field were refused before."""
    rules = (
        "Answer with one JSON object that maps each given value to its replacement, and nothing else. A replacement differs from its value and is never empty or a placeholder. "
        "Keep the alphabet, the case of each word, the number of words, digits as digits, separators at their places, and the domain of an e-mail address."
    )
    return rules + (f" {refused} earlier replacements for {field} broke these rules; check each one before you answer." if refused else "")


def kept(pairs: DataFrame) -> DataFrame:
    """field, original, replacement of the pairs that pass the format check."""
    return pairs.where(format_violation(F.col("original"), F.col("replacement")).isNull())


class SortedCycle:
    """Offline: each value to the next one in sorted order."""

    def generate(self, values: DataFrame, field: str) -> DataFrame:
        """values: value. Returns field, original, replacement."""
        return cycle(values.select("value").distinct(), None, "value").select(F.lit(field).alias("field"), "original", "replacement")


class Table:
    """Replacements from a table with original, replacement; only requested values are answered."""

    def __init__(self, pairs: DataFrame):
        self.pairs = pairs

    def generate(self, values: DataFrame, field: str) -> DataFrame:
        some = self.pairs.join(values.select(F.col("value").alias("original")).distinct(), "original", "left_semi")
        return kept(some.select(F.lit(field).alias("field"), "original", "replacement"))


@dataclass
class Request:
    field: str
    values: list[str]
    rules: str
    timeout: int
    max_tokens: int


class BudgetSpent(Exception):
    """Raised by an ask function if the answer was cut off by max_tokens."""


class Service:
    """Replacements from an external generator: ask(request) -> its answer as text. Chunks are asked one by one, pause seconds apart, in
    lanes tasks. An empty answer is asked for once more; one that was cut off is asked for again with twice the tokens; what stays empty is
    asked in halves. Answers for values that weren't asked for are dropped, as are those that fail the format check. A request that fails or
    times out counts as an empty answer, so its values stay without a replacement at worst."""

    def __init__(self, ask: Callable[[Request], str], lanes: int = 1, pause: float = 0.5, retry_pause: float = 1.5, max_tokens: int = 32_768, ceiling: int = 65_536, depth: int = 3, refused: dict[str, int] | None = None):
        self.ask, self.lanes, self.pause, self.retry_pause, self.max_tokens, self.ceiling, self.depth, self.refused = ask, lanes, pause, retry_pause, max_tokens, ceiling, depth, refused or {}

    def answer(self, field: str, some: list[str], depth: int = 0) -> dict:
        rules = format_rules(field, self.refused.get(field, 0))
        timeout = chunk_timeout(len(some), estimate_chars(some) + len(rules))
        tokens = self.max_tokens
        got: dict = {}
        for attempt in range(3):
            try:
                got = extract_json(self.ask(Request(field, some, rules, timeout if not attempt else min(180, timeout * 3 // 2), tokens)))
            except BudgetSpent:
                tokens = min(2 * max(tokens, 8192), self.ceiling)
                if tokens <= self.max_tokens:
                    break
                continue
            except (TimeoutError, OSError):
                got = {}
            if got or attempt:
                break
            time.sleep(self.retry_pause)
        if got or depth >= self.depth or len(some) <= 3:
            return got
        half = len(some) // 2
        return self.answer(field, some[:half], depth + 1) | self.answer(field, some[half:], depth + 1)

    def generate(self, values: DataFrame, field: str) -> DataFrame:
        service = self

        def run(frames):
            for f in frames:
                for i, chunk in enumerate(chunk_plan(f["value"].tolist())):
                    if i:
                        time.sleep(service.pause)
                    got = service.answer(field, chunk)
                    rows = [(field, v, got[v]) for v in chunk if isinstance(got.get(v), str)]
                    yield pd.DataFrame(rows, columns=["field", "original", "replacement"])

        return kept(values.select("value").distinct().repartition(self.lanes).mapInPandas(run, "field string, original string, replacement string"))


def chat_completions(endpoint: str, key: str, model: str) -> Callable[[Request], str]:
    """An ask function for services with the usual chat-completions interface."""

    def ask(request: Request) -> str:
        messages = [{"role": "system", "content": request.rules}, {"role": "user", "content": f"Field: {request.field}\n" + json.dumps(request.values, ensure_ascii=False)}]
        body = json.dumps({"model": model, "messages": messages, "max_tokens": request.max_tokens}).encode()
        call = urllib.request.Request(f"{endpoint.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(call, timeout=request.timeout) as got:
            try:
                choice = (json.load(got).get("choices") or [{}])[0]
            except ValueError:
                return ""
        text = (choice.get("message") or {}).get("content") or ""
        if not text and choice.get("finish_reason") == "length":
            raise BudgetSpent
        return text

    return ask
