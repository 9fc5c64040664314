"""psephos: election-count analytics as Spark jobs.

    from psephos import ElectionCount, get_session
    spark = get_session()
    count = ElectionCount.from_feeds(spark, "/landing/snapshot")
    count.seat_summary().show()
"""

from psephos.api import ElectionCount, PrepollSeries
from psephos.session import get_session

__all__ = ["ElectionCount", "PrepollSeries", "get_session"]
