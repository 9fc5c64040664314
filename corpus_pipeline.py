"""A corpus pipeline: documents in, clean and distinct training documents with token ids out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents. Columns that documents
has besides its own pass through all stages, whatever their names, but for ``ids``
and ``n_tokens``, which the last stage replaces. Every stage takes an empty table.
The last two stages pass whole rows through Python when their result is used;
they set the session's limit to the bytes of an Arrow batch if it has none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm import bpe, decontaminate, jaccard, pii, quality
from psephos.llm.common import cut, lean_batches, scratch, table
from psephos.llm.queries import PII_KEY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are rejected, each row is judged by itself, a null id too."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, that with the smallest id stays, once; rows with a null id go by their text, texts without words stay."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item go; rows with a null id go by their text, null and empty texts stay."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced by surrogates; ``n_chars`` follows the text, null for a null one; all rows stay."""
    lean_batches(spark)
    out = pii.replace_entities(docs, PII_KEY).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids and their number; the text is what the ids decode to, null for a null one; all rows stay."""
    lean_batches(spark)
    return bpe.code_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express surrogates and byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what its predecessor wrote.

    The rows that stay, with their columns, the ids and their number. Rows with
    a null id and repeated rows take part as the stages say; null and empty
    texts go in the first stage; other columns pass through; an empty table
    gives no rows. What a stage wrote on the way is removed once it is done.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as kept:
            docs = cut(stage(spark, docs, sf_dir))
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
