"""Helpers the operators share."""

from __future__ import annotations

import ctypes
import heapq
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.plans.sizing import checkpoint_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What ``\s`` is in the public tokenizers' patterns, for the regex module (whose own has \x1c-\x1f too).
WHITE = r"\p{White_Space}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used inside a lambda may be inlined there and evaluated for each
    element; binding it as the one element of an array prevents that.
    """
    return F.transform(F.array(value), body)[0]


#: Folders written by ``cut`` inside the innermost ``scratch``.
_WRITTEN: ContextVar[dict[str, DataFrame] | None] = ContextVar("written", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: parquet in the shared folder, read back.

    The folder is the session's ``spark.checkpoint.dir``; files there survive a
    lost executor, and the read has true sizes for Spark's join choice. They
    stay until the ``scratch`` around ends, or for good outside one.
    """
    spark = df.sparkSession
    shared = checkpoint_dir(spark)
    if not shared:
        raise ValueError("spark.checkpoint.dir is not set; nowhere shared to write to")
    path = f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    written = _WRITTEN.get()
    if written is not None:
        written[path] = out
    return out


@contextmanager
def scratch():
    """Removes the tables cut inside when it ends, but for those put in the list it gives.

    What is kept must not be computed from what goes: keep the last tables cut.
    """
    outer, written, kept = _WRITTEN.get(), {}, []
    token = _WRITTEN.set(written)
    try:
        yield kept
    finally:
        _WRITTEN.reset(token)
        for path, df in written.items():
            if any(df is k for k in kept):
                if outer is not None:
                    outer[path] = df
            else:
                folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_bytes(spark: SparkSession, most: str):
    """Batches to and from Python hold at most so many bytes in the jobs run inside."""
    old = spark.conf.getAll.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, most)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(ARROW_BYTES)
        else:
            spark.conf.set(ARROW_BYTES, old)


def lean_batches(spark: SparkSession, most: str = "2m"):
    """Batches to and from Python hold at most so many bytes from here on, if the session names no limit of its own.

    For tables that are computed later, by the caller: Spark asks the session
    for the limit then. Results do not depend on it.
    """
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, most)


#: Rank of a pair that does not merge.
NEVER = 1 << 60


def merge_ranked(parts: list, rank) -> list:
    """Fold ranked merges over ``parts``: lowest rank first, leftmost on ties.

    ``rank(a, b)`` is the rank of joining two neighbours, or ``NEVER``. Short
    words scan for the best pair; long ones use a heap over linked neighbours,
    so a word of n parts costs n log n. The list is used up.
    """
    n = len(parts)
    if n < 64:
        ranks = list(map(rank, parts, parts[1:]))
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1], parts[at])
            if at < len(ranks):
                ranks[at] = rank(parts[at], parts[at + 1])
        return parts
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = [1] * n  # parts joined so far; tells an outdated heap entry
    heap = [(r, i, 1, 1) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) != NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if size[i] != a or j >= n or size[j] != b:
            continue
        parts[i] += parts[j]
        size[i], size[j] = a + b, 0
        after[i] = after[j]
        if (k := after[i]) < n:
            before[k] = i
            if (r := rank(parts[i], parts[k])) != NEVER:
                heapq.heappush(heap, (r, i, size[i], size[k]))
        if (k := before[i]) >= 0 and (r := rank(parts[k], parts[i])) != NEVER:
            heapq.heappush(heap, (r, k, size[k], size[i]))
    return [p for p, k in zip(parts, size, strict=True) if k]


class Memory:
    """A bounded memory of computed values that keeps what is asked for often.

    Two generations: when the young one is full it becomes the old one, and what
    was old is forgotten unless it was asked for meanwhile.
    """

    def __init__(self, most: int):
        self.half, self.young, self.old = max(1, most // 2), {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


def slices(batches, rows: int = 500):
    """The batches in pieces, so that a worker holds few texts as Python objects and hands over few results at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def frugal(run):
    """``run`` over a partition's batches, after which the worker gives freed memory back to the system.

    Spark keeps Python workers for the next stages. What their allocators hold
    on to from one stage would stand beside what the next one needs in the JVM.
    """

    def whole(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return whole
