"""One-shot commands: python -m tablespan.cli --op filter-sort --rows 1000 --filters firstName=ad --sort age:desc"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tablespan import benchmark
from tablespan.engine import TableEngine
from tablespan.operators.sorting import SortKey
from tablespan.sources import generate, tables


def filters_of(text: str) -> dict[str, str]:
    """column=needle pairs between commas; the first = splits, later pairs win."""
    pairs = [p.partition("=") for p in text.split(",") if p.strip()]
    if bad := [p[0] for p in pairs if not p[1] or not p[0].strip()]:
        raise ValueError(f"a filter is column=text, not {bad[0]}")
    return {c.strip(): v for c, _, v in pairs}


def sort_of(text: str) -> list[SortKey]:
    """column:direction pairs between commas."""
    pairs = [p.strip().partition(":") for p in text.split(",") if p.strip()]
    if bad := [p[0] for p in pairs if not p[1]]:
        raise ValueError(f"a sort key is column:asc or column:desc, not {bad[0]}")
    return [SortKey(c.strip(), d.strip()) for c, _, d in pairs]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tablespan")
    p.add_argument("--op", choices=("filter", "sort", "filter-sort"))
    p.add_argument("--bench", choices=("filtering", "sorting", "both"))
    p.add_argument("--table", help="a Parquet path; otherwise a table is generated")
    p.add_argument("--key", default="row_id")
    p.add_argument("--preset-dir")
    p.add_argument("--rows", type=int, default=10_000)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--partitions", type=int)
    p.add_argument("--filters", default="")
    p.add_argument("--sort", default="")
    p.add_argument("--sort-mode", default="native")
    p.add_argument("--rounds", type=int, default=3)
    p.add_argument("--out")
    p.add_argument("--json", action="store_true")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    engine = TableEngine(spark)
    engine.set_sort_mode(args.sort_mode)
    if args.table:
        engine.load(spark.read.parquet(args.table), args.key)
    elif args.preset_dir:
        engine.load(tables.load_preset(spark, args.preset_dir, args.rows), args.key)
    else:
        engine.load(generate.random_table(spark, args.rows, args.seed, args.partitions))
    if args.bench:
        results = [f(engine, args.rounds) for name, f in (("filtering", benchmark.run_filter), ("sorting", benchmark.run_sort)) if args.bench in (name, "both")]
        return json.dumps([vars(r) for r in results]) if args.json else "\n".join(line for r in results for line in r.lines)
    if not args.op:
        raise ValueError("either --op or --bench")
    filters, keys = filters_of(args.filters), sort_of(args.sort)
    found = engine.filter(filters if args.op != "sort" else {})
    payload = {"operation": args.op, "rows": engine.row_count(), "filters": filters, "filter": {"count": found.count(), "layout": found.layout, "seconds": found.seconds}}
    if args.op != "filter":
        done = engine.sort(keys, found.df)
        payload["sort"] = {"mode": done.requested_mode, "used": done.used_mode, "keys": [[k.column, k.direction] for k in done.keys], "count": found.count(), "first": [r[engine.schema.key] for r in done.df.limit(15).collect()]}
    return json.dumps(payload) if args.json else "\n".join(f"{k}: {v}" for k, v in payload.items())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
        text = run(spark or SparkSession.builder.appName("tablespan").getOrCreate(), args)
    except Exception as error:
        print(f"CLI failed: {error}", file=sys.stderr)
        return 1
    if args.out:
        with open(args.out, "w") as out:
            out.write(text + "\n")
    print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
