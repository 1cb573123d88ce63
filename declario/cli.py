"""python -m declario.cli compare A B --key ID: how similar two files of records are."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from declario.operators import diff
from declario.sources import registry


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="declario")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare")
    c.add_argument("left")
    c.add_argument("right")
    c.add_argument("--schema", required=True, help="Spark DDL of the records")
    c.add_argument("--key", required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    sides = []
    for path in (a.left, a.right):
        fmt = path.rsplit(".", 1)[-1].replace("yml", "yaml")
        rows = registry.find(fmt).read(spark, path)
        sides.append(rows.selectExpr(f"from_json(json, '{a.schema}') AS r").select("r.*"))
    found = diff.differences(*sides, a.key).orderBy(a.key, "path", "index")
    print(*found.columns, sep="\t")
    for r in found.toLocalIterator():
        print(*r, sep="\t")
    found = diff.score_pairs(*sides, a.key).selectExpr("round(avg(similarity), 2) AS s").first().s
    print(f"Similarity: {found} %")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
