"""Rules files: "Table.Column: type" lines under transforms:, # comments."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Config:
    rules: dict[str, str] = field(default_factory=dict)
    on_unknown: str = "keep"
    min_distinct: int = 2


#: Endpoint and model of services by name; LLM_ENDPOINT and LLM_MODEL go before them.
PRESETS = {"openai": ("https://api.openai.com/v1", "gpt-4o-mini"), "local": ("http://localhost:11434/v1", "")}


@dataclass
class ServiceSettings:
    provider: str
    endpoint: str
    model: str
    key: str
    max_tokens: int = 32_768
    timeout_base: int = 45
    timeout_max: int = 180
    samples_per_field: int = 50
    profiles_dir: str = "output/profiles"


def read_env(path: str) -> dict[str, str]:
    """NAME=value lines of a file, without quotes; comments and other lines are left out. A missing file has none."""
    if not Path(path).exists():
        return {}
    lines = (x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines())
    split = (x.partition("=") for x in lines if x and not x.startswith("#") and "=" in x)
    return {k.strip(): v.strip().strip("\"'") for k, _, v in split}


def service_settings(env_file: str | None = None, env: Mapping[str, str] | None = None) -> ServiceSettings:
    """From the environment, over which env_file goes. Raises ValueError for a number that isn't one."""
    got = {**(os.environ if env is None else env), **(read_env(env_file) if env_file else {})}
    name = (got.get("LLM_PROVIDER") or "openai").strip().lower()
    endpoint, model = PRESETS.get(name, PRESETS["openai"])
    return ServiceSettings(
        name, got.get("LLM_ENDPOINT", "").strip() or endpoint, got.get("LLM_MODEL", "").strip() or model, got.get("LLM_API_KEY") or got.get("LLM_API_TOKEN") or "",
        *(int(got.get(k) or v) for k, v in (("LLM_MAX_COMPLETION_TOKENS", 32_768), ("LLM_TIMEOUT_BASE", 45), ("LLM_TIMEOUT_MAX", 180), ("SAMPLES_PER_FIELD", 50))), got.get("PROFILES_DIR") or "output/profiles",
    )


def parse_rules(text: str) -> dict[str, str]:
    """Raises on a line that is neither a rule, a section nor a comment."""
    rules, inside = {}, False
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"line {number}: {line!r}")
        if not line[0].isspace() and not value.strip():
            inside = key == "transforms"
        elif inside:
            rules[key.strip()] = value.strip().strip("'\"")
    return rules


def load_config(path: str) -> Config:
    return Config(parse_rules(Path(path).read_text(encoding="utf-8")))


def write_rules(types: dict[tuple[str, str], str]) -> str:
    """A rules file, grouped by table, tables and columns sorted."""
    out, last = ["transforms:"], None
    for (table, column), kind in sorted(types.items()):
        if table != last:
            out.append(f"  # {table}")
            last = table
        out.append(f"  {table}.{column}: {kind}")
    return "\n".join(out) + "\n"
