"""python -m maskframe.cli DUMP... -o OUT [-c RULES] [--plan]: masks dumps.

One dump goes to the file OUT, or into OUT if that is a folder; several dumps, or a folder of them, go into the folder OUT as
<stem>_sanitized.sql. --plan only prints how the columns would be typed. With --service, names, titles, companies and composers are replaced by
the service that the environment names.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from maskframe.config import Config, load_config, service_settings
from maskframe.engine import CYCLED, Engine, NothingMasked
from maskframe.operators.provider import Service, chat_completions
from maskframe.plans.classify import classify
from maskframe.sources import dumps
from maskframe.sources.files import output_path


def show_plan(spark: SparkSession, path: str, config: Config, encoding: str | None) -> None:
    dump = dumps.read(spark, path, encoding)
    for table, columns in sorted(dumps.tables(dump).items()):
        for r in classify(dumps.as_table(dump, table, columns).drop("seq"), table, config.rules, config.min_distinct).orderBy("column").collect():
            print(f"{table}.{r['column']}: {r['type']}" + (f"  # {r['note']}" if r["note"] else ""))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="maskframe")
    parser.add_argument("dumps", nargs="+")
    parser.add_argument("-o", "--output")
    parser.add_argument("-c", "--config")
    parser.add_argument("--encoding")
    parser.add_argument("--plan", action="store_true")
    parser.add_argument("--service", action="store_true")
    parser.add_argument("--env-file", default=".env")
    args = parser.parse_args(argv)
    if not (args.plan or args.output):
        parser.error("-o is needed")
    paths = [p for d in args.dumps for p in (sorted(map(str, Path(d).glob("*.sql"))) if Path(d).is_dir() else [d])]
    spark = SparkSession.builder.appName("maskframe").getOrCreate()
    config = load_config(args.config) if args.config else Config()
    providers = {}
    if args.service:
        s = service_settings(args.env_file)
        providers = dict.fromkeys(CYCLED, Service(chat_completions(s.endpoint, s.key, s.model), max_tokens=s.max_tokens))
    failed = 0
    into = len(paths) > 1 or args.output and Path(args.output).is_dir()
    if args.output and into:
        Path(args.output).mkdir(parents=True, exist_ok=True)
    for path in paths:
        if args.plan:
            show_plan(spark, path, config, args.encoding)
            continue
        out = str(Path(args.output) / output_path(path, args.output).name) if into else args.output
        try:
            rows = dumps.mask_dump(spark, path, out, Engine(spark, config, providers), args.encoding)
        except NothingMasked as e:
            print(f"{path}: {e}", file=sys.stderr)
            failed += 1
            continue
        print(f"{rows} rows written to {out}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
