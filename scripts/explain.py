"""Print the formatted physical plan of a query or of the ballot grain.

Usage: python scripts/explain.py <query|grain> [sf_dir] [--scale]

``--scale`` turns broadcasts off and uses 200 shuffle partitions: the plan
shape a large input gets (sort-merge joins, hash exchanges).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    name = args[0] if args else "grain"
    sf_dir = args[1] if len(args) > 1 else "/root/testdata/sf0.01"
    scale = "--scale" in sys.argv
    from psephos.plans.registry import QUERIES
    from psephos.session import get_session
    from psephos.sources.binding import WAREHOUSE_TABLES, ballot_grain, read_tables

    extra = {"spark.sql.autoBroadcastJoinThreshold": "-1"} if scale else {}
    spark = get_session("local[8]", 200 if scale else 8, extra)
    if name == "grain":
        df = ballot_grain(read_tables(spark, sf_dir, WAREHOUSE_TABLES))
    else:
        df = QUERIES[name](spark, sf_dir)
    df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
