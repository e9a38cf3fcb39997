"""python -m skein.cli QUERY: search an index from the command line."""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys

from skein.engine import MODES, Engine, SearchRequest
from skein.operators.filters import Filters


def _date(value: str) -> str:
    try:
        return datetime.datetime.fromisoformat(value.replace("Z", "+00:00")).astimezone(datetime.UTC).replace(tzinfo=None).isoformat(" ") if "T" in value else datetime.date.fromisoformat(value).isoformat()
    except ValueError as e:
        raise argparse.ArgumentTypeError("expects YYYY-MM-DD or an ISO-8601 time") from e


def _within(kind, low, high):
    def read(value: str):
        x = kind(value)
        if not low <= x <= high:
            raise argparse.ArgumentTypeError(f"must be between {low} and {high}")
        return x

    return read


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein", description="Search an index.")
    p.add_argument("query", nargs="+")
    p.add_argument("--index", default=os.environ.get("SKEIN_INDEX", "skein-index"))
    p.add_argument("--mode", choices=MODES, default="hybrid")
    p.add_argument("-n", "--limit", type=_within(int, 1, 200), default=20)
    p.add_argument("--path", action="append", default=[])
    p.add_argument("--type", "--types", action="append", default=[], dest="types")
    p.add_argument("--after", type=_date)
    p.add_argument("--before", type=_date)
    p.add_argument("--semantic-weight", type=_within(float, 0, 1), default=0.35)
    p.add_argument("--format", choices=["json", "jsonl", "paths", "text"], default="text")
    for f in ("json", "jsonl", "paths", "text"):
        p.add_argument(f"--{f}", action="store_const", const=f, dest="format")
    return p


def request(args: argparse.Namespace) -> SearchRequest:
    types = {t.lower().strip(".") for v in args.types for t in v.split(",") if t.strip(".")}
    paths = {os.path.abspath(os.path.expanduser(p)) for p in args.path}
    query = " ".join(args.query[1:] if args.query[0] == "search" and len(args.query) > 1 else args.query)
    return SearchRequest(query, args.mode, Filters(path_prefixes=frozenset(paths), extensions=frozenset(types), after=args.after, before=args.before), args.limit, args.semantic_weight)


def render(rows: list[dict], form: str, wanted: SearchRequest, mode: str) -> str:
    """The results as text in one of the formats."""
    results = [{"path": r["path"], "filename": r["filename"], "file_type": r["extension"], "modified_at": r["modified_at"] and r["modified_at"].isoformat(), "score": r["score"], "snippets": [{"text": " ".join(r["snippet"].split())}]} for r in rows]
    if form == "json":
        return json.dumps({"query": wanted.query, "requested_mode": wanted.mode, "effective_mode": mode, "result_count": len(results), "results": results}, indent=2, sort_keys=True, ensure_ascii=False)
    if form == "jsonl":
        return "\n".join(json.dumps(r, sort_keys=True, ensure_ascii=False) for r in results)
    if form == "paths":
        return "\n".join(r["path"] for r in results)
    return "\n\n".join(f"{i}. {r['path']}\n    {r['snippets'][0]['text']}" for i, r in enumerate(results, 1))


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from skein.engine import effective_mode

    args = parser().parse_args(argv)
    engine = Engine(SparkSession.builder.appName("skein").getOrCreate(), args.index)
    wanted = request(args)
    rows = [r.asDict() for r in engine.search(wanted).collect()]  # at most 200
    print(render(rows, args.format, wanted, effective_mode(wanted.mode, wanted.mode == "text" or engine.ready())))
    return 0


if __name__ == "__main__":
    sys.exit(main())
