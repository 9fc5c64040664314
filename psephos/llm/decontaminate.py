"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size. An item's sketch is its smallest shingle hashes
(MinHash), as many as its partition needs so that a document holding the asked
share of the item's shingles must hold one of the sketch: of n shingles at
most n - ceil(share * n) may be missing, so one more always meets. The search
therefore loses nothing. Documents that meet a sketch are verified by exact
containment of the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, words

SHINGLE, SHARE_PERCENT = 5, 80
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _runs(v: Column, size: int | Column, make) -> Column:
    """``make`` of each run of ``size`` words of the array ``v``, which has so many."""
    return F.transform(F.sequence(F.lit(1), F.size(v) - size + 1), lambda i: make(F.slice(v, i, size)))


def _words(text: Column) -> Column:
    return words(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))


def _joined(run: Column) -> Column:
    return F.array_join(run, " ")


def item_shingles(text: Column, make=_joined) -> Column:
    """Distinct five-word shingles of the A-Z lower-cased text; with fewer words all of them as one; null without words."""
    size = lambda v: F.least(F.size(v), F.lit(SHINGLE))
    return let(_words(text), lambda v: F.when(F.size(v) > 0, F.array_distinct(_runs(v, size(v), make))))


def shingles(text: Column, sizes: list[int], make=_joined) -> Column:
    """Distinct shingles of the given numbers of words of the A-Z lower-cased text."""
    own = lambda v: F.array_compact(F.array(*(F.when(F.size(v) >= k, _runs(v, k, make)) for k in sizes)))
    return let(_words(text), lambda v: F.array_distinct(F.flatten(own(v))))


def sketches(items: DataFrame) -> DataFrame:
    """``item, words, hash``: items (item, text) with the smallest hashes their size partition asks for; words per shingle.

    Partition p holds sizes up to 2**p; its sketch has as many hashes as its
    largest size needs.
    """
    sized = items.select("item", F.least(F.size(_words(F.col("text"))), F.lit(SHINGLE)).alias("words"), item_shingles(F.col("text"), F.xxhash64).alias("h")).where("h is not null")
    largest = F.pow(F.lit(2), F.ceil(F.log2(F.size("h")))).cast("int")
    need = F.floor(largest * (100 - SHARE_PERCENT) / 100) + 1
    return sized.select("item", "words", F.explode(F.slice(F.sort_array("h"), F.lit(1), need.cast("int"))).alias("hash"))


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id, item_id, n_item, n_shared, containment`` of each pair with containment of 0.8 or more.

    Shingles are five words of the A-Z lower-cased text. An item of fewer words
    is one shingle, all its words, found where a document has them in a row.
    Items and documents without words give no pairs. Texts of any length are
    searched whole. Rows of one id are taken as one document or item whose best
    row counts, the one of more shingles on ties; a null id is an id. Other
    columns are not read. Empty tables give no rows.

    The item side is joined as Spark's size check says: broadcast if small,
    else by shuffle. Hashes above every sketch's are dropped before the join.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text"))
    sketch = cut(sketches(items))
    top, sizes = sketch.agg(F.max("hash"), F.collect_set("words")).first()  # one value, and five at most
    if top is None:
        top, sizes = -(1 << 63), [SHINGLE]
    sizes = sorted(sizes)
    low = F.filter(shingles(F.col("text"), sizes, F.xxhash64), lambda h: h <= F.lit(top))
    hits = docs.select("doc", F.explode(low).alias("hash")).join(sketch.select("item", "hash"), "hash").select("doc", "item").distinct()
    pairs = cut(hits)
    full = items.select(F.col("item").alias("of"), item_shingles(F.col("text")).alias("item_set"))
    ours = docs.join(pairs.select(F.col("doc").alias("d")).distinct(), F.col("doc").eqNullSafe(F.col("d")), "left_semi").select("doc", shingles(F.col("text"), sizes).alias("doc_set"))
    both = ours.join(pairs.withColumnRenamed("doc", "d"), F.col("doc").eqNullSafe(F.col("d"))).join(full, F.col("item").eqNullSafe(F.col("of")))
    shared = both.select("doc", "item", F.size("item_set").cast("bigint").alias("n_item"), F.size(F.array_intersect("item_set", "doc_set")).cast("bigint").alias("n_shared"))
    held = shared.where(100 * F.col("n_shared") >= SHARE_PERCENT * F.col("n_item"))
    best = held.groupBy("doc", "item").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("b"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_id), "b.n_item", "b.n_shared", F.col("b.col1").alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 3) -> DataFrame:
    """The rows of ``docs`` in whose document no item of ``min_words`` or more is found.

    An item of one or two words ("yes") stands in most clean texts and proves
    nothing; ``find_items`` reports it all the same. Rows of one id are one document. Rows with a null id are documents by their
    text, so only those that hold an item go. Null and empty texts stay, texts
    of any length are searched whole, all columns are kept, and an empty table
    stays empty.
    """
    key = F.coalesce(F.concat(F.lit("id "), F.col(id_col).cast("string")), F.concat(F.lit("text "), F.sha2(F.col(text_col), 256)), F.lit("none"))
    own = docs.select(key.alias("__key"), F.col(text_col).alias("__text"))
    items = items.where(F.size(words(F.col(item_text).cast("string"))) >= min_words)
    found = find_items(own, items, "__key", "__text", item_id, item_text).select(F.col("__key").alias("__found")).distinct()
    return docs.withColumn("__key", key).join(cut(found), F.col("__key") == F.col("__found"), "left_anti").drop("__key")
