import random

import pytest

from psephos.llm import jaccard

from . import helpers


def corpus(seed, n=400):
    """Copies with edits, a passage that many documents share, and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 8, 12, 20, 40, 80]))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w += passage
        if rng.random() < 0.1:
            w = [rng.choice(vocabulary) for _ in range(10)] + passage
        rows.append((i * 3, " ".join(w).title() if i % 5 else " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "percent", "frequent", "agree"), [(4, 85, 100, 4), (5, 80, 2, 9), (4, 85, 2, 4)])
def test_equals_brute_force(spark, monkeypatch, k, percent, frequent, agree):
    """Also with most tokens very frequent, and with no leaders at all."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "AGREE", agree)
    rows = corpus(k + frequent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), k, percent).collect()}
    assert got == helpers.components(rows, k, percent)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(50)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80).collect()}
    assert got == helpers.components(rows, 5, 80)


def test_edge_rows(spark):
    df, rows = helpers.docs(spark)
    out = jaccard.join(df, 4, 85).collect()
    assert len(out) == len(rows)
    want = helpers.components([(i, t) for i, t in rows if i is not None], 4, 85)
    for r in out:
        if r.doc_id is None:
            assert r.n_shingles == 0 and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert {r.component_id for r in out if r.doc_id in (0, 1, 2)} == {0, 1, 2}  # no words: linked with nothing


def test_rows_of_one_id_are_one_document(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    df = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (11, "other words altogether here now")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(df, 4, 85).collect()) == [(5, 5), (5, 5), (7, 5), (9, 5), (11, 11)]


def test_one_of_each(spark):
    df, rows = helpers.docs(spark)
    out = jaccard.one_of_each(df)
    assert out.columns == df.columns
    # of the two rows of the last id, and its copy with a smaller id, one stays
    assert sorted((r.doc_id for r in out.collect()), key=repr) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None]


def test_one_of_each_of_repeated_rows_and_rows_without_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, a), (7, a), (None, a), (None, b), (None, b), (9, c), (9, c), (9, c), (None, None), (3, None)]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(5, a), (None, b), (9, c), (None, None), (3, None)], key=repr)


def test_shares_grow_with_the_input():
    assert [jaccard.counted_shares(n, 12, 80) for n in (0, 10**9, 10**11, 10**13)] == [12, 22, 2146, 214577]


def test_empty(spark):
    assert jaccard.join(helpers.empty(spark), 4, 85).count() == 0
    assert jaccard.one_of_each(helpers.empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.node: r.label for r in jaccard.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}
