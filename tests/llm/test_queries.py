import duckdb
import pytest

import corpus_pipeline
from psephos.llm import bpe, decontaminate, pii, quality, queries

from . import helpers

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark conversations embeddings".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.sql(queries.ORACLE_SQL[name]).create_view("o")  # as a view, not only as a statement
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM o").fetchall()
    rounded = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(repr, map(rounded, map(tuple, df.collect())))) == sorted(map(repr, map(rounded, want)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_for_each(spark, name):
    """The queries that return a row per row of their table do so, at the whole table."""
    per = {"op1_html_mincut": "pages", "op3_url_filters": "pages"}
    if name in ("op7_decontamination", "op9_chat_format", "op13_hard_negatives"):
        return
    rows = spark.read.parquet(f"{SF}/{per.get(name, 'documents')}.parquet").count()
    assert queries.QUERIES[name](spark, SF).count() == rows


def test_pipeline_equals_its_steps_by_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    label = helpers.components([(i, docs[i].text) for i in kept], 5, 80)
    kept = {i for i in kept if label[i][1] == i}
    items = [helpers.shingles(t, decontaminate.SHINGLE, False) for _, t in bench]
    for i in sorted(kept):
        own = helpers.shingles(docs[i].text, decontaminate.SHINGLE, False)
        if any(s and 100 * len(s & own) >= 80 * len(s) for s in items):
            kept.discard(i)
    replace = pii.replacer(queries.PII_KEY)
    encode, _ = bpe.coder(bpe.load_ranks(queries.PUBLIC("byte_bpe_multi_50k.tiktoken")), queries.public_tokenizers.PATTERN)
    want = {}
    for i in kept:
        text = replace(docs[i].text)[0]
        want[i] = (text, len(text), docs[i].lang, docs[i].source, encode(text).tolist())
    got = {r.doc_id: (r.text, r.n_chars, r.lang, r.source, r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 50 < len(got) < len(docs)


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns


def test_native_operators_run_no_python(spark):
    for name in ("op2_quality_rules", "op3_url_filters", "op7_decontamination", "op9_chat_format"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD")), name
