"""Checks submitted id lists: python -m linkloom.validate MATCHES SOURCE1 SOURCE2 SOURCE3 [CANDIDATES].

Prints findings, warnings and PASS or FAIL; the exit code is 0 or 1.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import validation
from .sources import files


def run(spark: SparkSession, matches: str, sources: list[str], candidates: str | None = None) -> int:
    lists = [(matches, files.TRUTH)] + ([(candidates, files.CANDIDATES)] if candidates else [])
    faults = [f for f in (validation.check_file(spark, p, h) for p, h in lists) if f] + [f"file not found: {p}" for p in sources if not validation.exists(spark, p)]
    if faults:
        return _verdict([("file", f) for f in faults], [])

    def rows(path: str) -> DataFrame:
        return validation.parse(validation.read_lines(spark, path))

    required = files.read_ids(spark, sources[0]).select(F.col("entity_id").alias("s1_id"))
    valid = None
    for p in sources[1:]:
        own = files.read_ids(spark, p).select(F.col("entity_id").alias("tid"))
        valid = own if valid is None else valid.union(own)
    among = rows(candidates).where("tab").select("s1_id", F.explode("ids").alias("tid")).distinct() if candidates else None
    found = [(r["rule"], f"{r['n']:,}, e.g. {r['examples']}") for r in validation.findings(rows(matches), required, valid, among).collect()]
    if candidates:
        found += [(f"candidates_{r['rule']}", f"{r['n']:,}, e.g. {r['examples']}") for r in validation.findings(rows(candidates), required, valid).collect()]
    return _verdict([x for x in found if x[0] not in validation.WARNINGS], [x for x in found if x[0] in validation.WARNINGS])


def _verdict(faults: list[tuple[str, str]], warnings: list[tuple[str, str]]) -> int:
    for rule, text in warnings:
        print(f"WARNING: {rule}: {text}")
    for i, (rule, text) in enumerate(faults, 1):
        print(f"  {i}. {rule}: {text}")
    print(f"FAIL: {len(faults)} findings" if faults else "PASS")
    return 1 if faults else 0


def main(arguments: list[str]) -> int:
    if not 4 <= len(arguments) <= 5:
        print(__doc__)
        return 1
    spark = SparkSession.builder.appName("validate").getOrCreate()
    return run(spark, arguments[0], arguments[1:4], arguments[4] if len(arguments) == 5 else None)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
