"""Run one registered report over a warehouse folder and write it out.

Usage: python scripts/run_report.py <report> <tables_dir> <out_dir> [--csv] [--list]

Run it by spark-submit: the master, checkpoint folder and shuffle partitions
come from the submit command, never from here (without a master Spark's own
default, local[*], holds). Output is written in parallel as a folder of part files.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from psephos.plans.registry import QUERIES

    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("report", nargs="?", choices=sorted(QUERIES))
    ap.add_argument("tables_dir", nargs="?")
    ap.add_argument("out_dir", nargs="?")
    ap.add_argument("--csv", action="store_true", help="write CSV with a header instead of parquet")
    ap.add_argument("--list", action="store_true", help="list the report names and exit")
    args = ap.parse_args()
    if args.list or not (args.report and args.tables_dir and args.out_dir):
        print("\n".join(sorted(QUERIES)))
        return
    from psephos.session import get_session

    spark = get_session()
    df = QUERIES[args.report](spark, args.tables_dir)
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if args.csv else writer.parquet)(args.out_dir)
    print(f"{args.report}: wrote {args.out_dir}")
    spark.stop()


if __name__ == "__main__":
    main()
