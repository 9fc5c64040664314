"""Property test: the missing-value rules against a plain-Python statement of them."""

from hypothesis import given, settings
from hypothesis import strategies as st

from psephos.functions import pct, strict_sum, sum0

values = st.one_of(st.none(), st.integers(min_value=0, max_value=10**6))
groups = st.lists(st.tuples(st.sampled_from("abcde"), values, st.booleans()), min_size=1, max_size=60)


def _strict(xs):
    return None if any(x is None for x in xs) else sum(xs)


@settings(max_examples=15, deadline=None)
@given(groups)
def test_group_sums_follow_the_rules(spark, rows):
    df = spark.createDataFrame(rows, "g string, v long, keep boolean")
    got = {
        r.g: (r.strict, r.lenient, r.cond)
        for r in df.groupBy("g").agg(
            strict_sum("v").alias("strict"), sum0("v").alias("lenient"), strict_sum("v", "keep").alias("cond")
        ).collect()
    }
    want = {}
    for g in {g for g, _, _ in rows}:
        xs = [v for gg, v, _ in rows if gg == g]
        kept = [v for gg, v, k in rows if gg == g and k]
        want[g] = (_strict(xs), sum(x for x in xs if x is not None), _strict(kept))
    assert got == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(values, values), min_size=1, max_size=40))
def test_percent_is_null_safe(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    got = [r.p for r in df.select(pct("a", "b").alias("p")).collect()]
    want = [None if a is None or not b else a / b * 100 for a, b in pairs]
    assert got == want
