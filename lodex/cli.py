"""lodex ingest CONFIG | search CONFIG QUERY | eval CONFIG CASES | list CONFIG."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.quality import evaluate, pass_rates
from .plans.ingest import Pipeline
from .plans.search import SearchEngine
from .session import session
from .sources.readers import Config
from .sources.store import Store

CASES = "query string, expected_url_contains array<string>, expected_keywords array<string>, expected_type string, category string"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodex", description=__doc__)
    parser.add_argument("command", choices=("ingest", "search", "eval", "list"))
    parser.add_argument("config")
    parser.add_argument("argument", nargs="?")
    parser.add_argument("--store", default="collections")
    parser.add_argument("--source", action="append")
    parser.add_argument("--limit", type=int, default=10)
    args = parser.parse_args(argv)
    spark = spark or session()
    store, config = Store(spark, args.store), Config.load(args.config)
    if args.command == "ingest":
        print(json.dumps(Pipeline(spark, store, config).run(args.source)))
    elif args.command == "list":
        for row in store.info().orderBy("collection").collect():
            print(row.collection or "all", row.points)
    elif args.command == "search":
        for row in SearchEngine(spark, store, config).search(args.argument).limit(args.limit).collect():
            print(f"{row['rank']:3d} {row.score:.3f} {row.title or ''} {row.url}")
    else:
        engine = SearchEngine(spark, store, config)
        cases = spark.read.schema(CASES).option("multiLine", True).json(args.argument)
        rows, results = [], None
        for i, case in enumerate(cases.collect()):
            rows.append((str(i), *case))
            found = engine.search(case.query).selectExpr(f"'{i}' as query_id", "rank", "url", "text", "type")
            results = found if results is None else results.unionByName(found)
        named = spark.createDataFrame(rows, "query_id string, " + CASES)
        rates = pass_rates(evaluate(named, results)).collect()
        for row in rates:
            print(row.category or "all", f"{row.passed}/{row.cases}")
        return int(any(r.passed < r.cases for r in rates))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
