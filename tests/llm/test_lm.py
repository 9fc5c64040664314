import collections
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from psephos.llm import lm

from . import helpers

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_gradient():
    rng = np.random.default_rng(0)
    lens = np.array([5, 40, 1])
    first, last = rng.integers(0, lm.CLASSES, 46).astype(np.uint8), rng.integers(0, lm.TAILS, 46).astype(np.uint8)
    target, x1, x2, use = lm.windows(first, last, lens)
    mask = target >= 0
    assert sorted(target[mask]) == list(range(46))  # each token once
    flat = lm.start_model()

    def loss(p):
        z, _ = lm.forward(lm.unpack(p), x1, x2, use)
        w, t = np.nonzero(mask)
        return -np.log(z[w, t, first[target[w, t]]]).astype(np.float64).mean()

    g = lm.gradient(lm.unpack(flat), x1, x2, use, first[target], mask)
    for i in rng.integers(0, lm.SIZE, 40):
        p = flat.astype(np.float64)
        p[i] += 1e-3
        up = loss(p)
        p[i] -= 2e-3
        assert abs((up - loss(p)) / 2e-3 - g[i]) < 1e-4


def test_a_token_sees_only_what_stands_before_it():
    rng = np.random.default_rng(1)
    lens = np.array([60])
    first, last = rng.integers(0, lm.CLASSES, 60).astype(np.uint8), rng.integers(0, lm.TAILS, 60).astype(np.uint8)
    before = lm.class_logs(lm.start_model(), first, last, lens)
    changed, tails = first.copy(), last.copy()
    changed[30:], tails[30:] = 1, 2
    after = lm.class_logs(lm.start_model(), changed, tails, lens)
    assert np.allclose(before[:30], after[:30], atol=1e-5)
    # classes of one position sum to one
    total = 0
    for c in range(lm.CLASSES):
        own = first.copy()
        own[20] = c
        total += 10 ** lm.class_logs(lm.start_model(), own, last, lens)[20]
    assert abs(total - 1) < 1e-4


def test_words_are_numbered_as_they_come():
    words = lm.Words()
    assert words.add("b A b").tolist() == [1, 2, 1, 0] and words.add(None).tolist() == [0] and words.add("c a").tolist() == [3, 2, 0]
    assert list(words.number) == [b"", b"b", b"a", b"c"]


def test_classes_are_those_of_the_longest_pieces():
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"aba": 4}
    of = lambda r: (r * 40503 % 65536 % (lm.CLASSES - 1), r * 40503 % 65536 % lm.TAILS)
    for word, first, last in ((b"a", 0, 0), (b"aba", 4, 4), (b"abb", 2, 1), (b"bab", 3, 2), (b"bbbbaba", 1, 4)):
        assert lm.classes_of(word, ranks, 3) == (of(first)[0], of(last)[1])


def test_class_logs_weigh_no_class_but_the_token_s(monkeypatch):
    rng = np.random.default_rng(5)
    lens = np.array([40, 1, 17])
    first, last = rng.integers(0, lm.CLASSES, 58).astype(np.uint8), rng.integers(0, lm.TAILS, 58).astype(np.uint8)
    target, x1, x2, use = lm.windows(first, last, lens)
    z, _ = lm.forward(lm.unpack(lm.start_model()), x1, x2, use)
    w, t = np.nonzero(target >= 0)
    want = np.empty(58)
    want[target[w, t]] = np.log10(z[w, t, first[target[w, t]]])
    monkeypatch.delattr(lm, "forward")  # which divides the weights of all classes
    assert np.array_equal(lm.class_logs(lm.start_model(), first, last, lens), want)


def brute(rows):
    count, tokens = collections.Counter(), []
    for i, t in rows:
        w = [*helpers.words(helpers.lower(t or "")), None]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        tokens.append((i, held, w))
        if not held:
            count.update(w)
    n, v = sum(count.values()), len(count)
    return sorted(((i, h, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, h, w in tokens), key=repr)


def test_base_equals_brute_force(spark):
    df, rows = helpers.docs(spark, [*helpers.EDGE_TEXTS, *(f"some words of text {i} and the" for i in range(30))])
    got = lm.score(df, PATH).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == brute(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_held_out_texts_gain(spark):
    out = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH).where("held_out").collect()
    assert sum(r.score for r in out) > 0.99 * sum(r.base_score for r in out)  # both negative
    assert np.mean([r.score > r.base_score for r in out]) > 0.9


@pytest.mark.parametrize("texts", [[], [None]])
def test_few_rows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert lm.score(df, PATH).count() == len(texts)


def test_only_held_out_rows(spark):
    own = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score(spark.createDataFrame([(own, "a b c")], "doc_id bigint, text string"), PATH).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (4, 0, 0, 0.0)


def test_scores_do_not_depend_on_the_shuffle_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1 << 17)  # several blocks
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    key = "spark.sql.shuffle.partitions"
    old, got = spark.conf.get(key), []
    try:
        for n in ("4", "16"):
            spark.conf.set(key, n)
            got.append({r.doc_id: (r.base_score, r.score) for r in lm.score(docs, PATH).collect()})
    finally:
        spark.conf.set(key, old)
    assert got[0].keys() == got[1].keys()
    for i, (base, full) in got[0].items():
        assert math.isclose(base, got[1][i][0], rel_tol=1e-9) and math.isclose(full, got[1][i][1], rel_tol=1e-4)


def test_score_equals_a_plain_forward_pass():
    """The class logs of a text, token by token, with attention written out."""
    rng = np.random.default_rng(3)
    n = 70
    first, last = rng.integers(0, lm.CLASSES, n).astype(np.uint8), rng.integers(0, lm.TAILS, n).astype(np.uint8)
    flat = lm.start_model()
    got = lm.class_logs(flat, first, last, np.array([n]))
    p = {k: v.astype(np.float64) for k, v in lm.unpack(flat).items()}
    for t in range(n):
        lo = t // lm.STRIDE * lm.STRIDE - lm.CONTEXT  # the window's first place
        seen = []
        for place in range(t - lo + 1):
            at = lo + place - 1  # the token before that place
            if at >= -1:
                c, d = (first[at], last[at]) if at >= 0 else (lm.START, lm.TAILS)
                seen.append(p["emb"][c] + p["tail"][d] + p["pos"][place])
        x = np.array(seen)
        weight = np.exp((x[-1] @ p["q"]) @ (x @ p["kv"][:, : lm.WIDTH]).T / math.sqrt(lm.WIDTH))
        h = weight / weight.sum() @ (x @ p["kv"][:, lm.WIDTH :])
        z = np.r_[h, x[-1]] @ p["out"] + p["bias"]
        want = z[first[t]] - math.log(np.exp(z).sum())
        assert abs(got[t] - want / math.log(10)) < 1e-4, t
