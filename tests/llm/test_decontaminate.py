import random

from psephos.llm import decontaminate

from . import helpers


def brute(docs, items):
    out = {}
    for d, t in docs:
        ds = set().union(*(helpers.shingles(t, k, False) for k in range(1, 6)))
        for i, u in items:
            s = helpers.shingles(u, 5, True)
            if s and 100 * len(s & ds) >= 80 * len(s):
                out[d, i] = max(out.get((d, i), (0, 0)), (len(s & ds) / len(s), len(s)))
    return {k: (n, round(c * n)) for k, (c, n) in out.items()}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 4, 5, 6, 12, 30, 70])))) for i in range(40)] + [(40, None), (41, ""), (0, "an item with the same id as another")]
    docs = []
    for d in range(200):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(3)):
            piece = (rng.choice(items[:40])[1]).upper().split()
            for _ in range(rng.randrange(3)):
                piece[rng.randrange(len(piece))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = piece
        docs.append((d, " ".join(w)))
    docs += [(7, "a row of the same id"), (None, items[4][1]), (500, None), (501, "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id bigint, text string, item int, hash string")
    bench = spark.createDataFrame([(*r, 2, "y") for r in items], "item_id bigint, text string, doc_id int, n string")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.find_items(df, bench).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 50
    left = decontaminate.without_items(df, bench)
    short = {i for i, t in items if len((t or "").split()) < 3}
    gone = {d for d, i in want if i not in short}
    assert any(i in short for _, i in want) and any(len(t.split()) in (3, 4) for i, t in items[:40] for d, j in want if i == j)
    assert left.columns == df.columns  # the one row without an id holds an item
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((d for d, _ in docs if d not in gone), key=repr)


def test_items_of_few_words(spark):
    docs = spark.createDataFrame([(1, "We know that PARIS is\nthe capital of France."), (2, "Paris was the capital"), (3, "yes"), (4, "say yes or no")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "Paris is the capital"), (2, "Yes"), (3, " \n"), (4, "no yes")], "item_id bigint, text string")
    got = sorted(map(tuple, decontaminate.find_items(docs, items).collect()))
    assert got == [(1, 1, 1, 1, 1.0), (3, 2, 1, 1, 1.0), (4, 2, 1, 1, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.without_items(docs, items).collect()) == [2, 3, 4]
    assert sorted(r.doc_id for r in decontaminate.without_items(docs, items, min_words=1).collect()) == [2]


def test_rows_without_an_id_go_by_their_text(spark):
    item = "the five words of item and more"
    rows = [(None, f"a text that holds {item} and goes on"), (None, "a clean text without an id that has some words"), (None, None), (1, "another clean text with a few words in it"), (1, item)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    left = decontaminate.without_items(docs, bench)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([rows[1], rows[2]], key=repr)


def test_empty(spark):
    docs, items = helpers.empty(spark), helpers.empty(spark, "item_id bigint, text string")
    one = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    assert decontaminate.find_items(docs, one).count() == 0
    assert decontaminate.find_items(one.withColumnRenamed("item_id", "doc_id"), items).count() == 0
    assert decontaminate.without_items(one.withColumnRenamed("item_id", "doc_id"), items).count() == 1


def test_edge_rows(spark):
    df, rows = helpers.docs(spark)
    items = spark.createDataFrame([(1, "text whose id is null, with"), (2, "word and then some more of")], "item_id bigint, text string")
    want = brute(rows, [(1, "text whose id is null, with"), (2, "word and then some more of")])
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(df, items).collect()} == set(want)
