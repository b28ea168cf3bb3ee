"""Command line: ``python -m heaplake index|diff|query|serve --hprof FILE [--diff-hprof FILE] [--port N]``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .facade import Analysis
from .model import Heap, diff_folder, index_folder
from .session import ship


def session() -> SparkSession:
    """The session that spark-submit gives, or a local one."""
    spark = SparkSession.builder.appName("heaplake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def indexed(spark: SparkSession, path: str) -> Heap:
    """A dump's saved tables, built first where they are missing."""
    folder = index_folder(path)
    for table, what in Heap.read(spark, path).save(folder).items():
        print(f"{what:8} {folder}/{table}", file=sys.stderr)
    return Heap.load(spark, folder)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="heaplake", description=__doc__)
    parser.add_argument("command", choices=["index", "diff", "query", "serve"])
    parser.add_argument("--hprof", "-f", required=True)
    parser.add_argument("--diff-hprof")
    parser.add_argument("--port", "-p", type=int, default=7000)
    parser.add_argument("--sql", help="query: a statement over the tables of the dump")
    parser.add_argument("--out", help="query: write all rows as Parquet to this folder instead of printing them")
    given = parser.parse_args(args)
    paths = [p for p in (given.hprof, given.diff_hprof) if p]
    for p in paths:
        if "://" not in p and not os.path.exists(p):
            parser.error(f"no such file: {p}")
    if given.command == "diff" and not given.diff_hprof:
        parser.error("diff needs --diff-hprof")
    spark = session()
    heaps = [indexed(spark, p) for p in paths]
    if given.command == "index":
        return 0
    analysis = Analysis(heaps[0], heaps[1] if len(heaps) > 1 else None, given.hprof)
    if given.command == "diff":
        folder = diff_folder(*paths)
        analysis.entries.write.mode("overwrite").partitionBy("entry").parquet(f"{folder}/entries")
        analysis.diff_classes.write.mode("overwrite").parquet(f"{folder}/classes")
        analysis.diff().show(50, truncate=False)
    elif given.command == "query":
        heaps[0].register()
        found = spark.sql(given.sql or "select * from class_dump")
        if given.out:
            found.write.parquet(given.out)
        else:
            print("\t".join(found.columns))
            for row in found.toLocalIterator():  # one partition at a time; --out leaves large results on the cluster
                print("\t".join("" if v is None else str(v) for v in row))
    else:
        from .server import serve

        serve(analysis, given.port)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
