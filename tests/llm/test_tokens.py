import base64
import hashlib
import random
from array import array

import public_tokenizers as P
import regex
import tiktoken
from tokenizers import Tokenizer

from psephos.llm import bpe, token_counts
from psephos.llm.common import Memory, merge_ranked

from . import helpers

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
COUNTS = P.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(1)
    letters = "aé Σ'sｘ1\x1c\x85 \n😀éİßﬀ<|>#\u3000\u00a0İ"
    own = [t for t in helpers.EDGE_TEXTS if t is not None and t is not helpers.LONG]
    own += ["a<|endoftext|>b <|startoftext|><|startoftext|>", "x" * 3000, "ab" * 300 + " " + "the" * 200, "don't I'LL we're 123 ４５ ½", "a\n \nb", "x \n", "x\n ", "  x"]
    return own + ["".join(rng.choice(letters) for _ in range(60)) for _ in range(500)]


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_coder_equals_the_library():
    ranks, pairs = bpe.load(RANKS)
    encode, decode = bpe.coder(ranks, P.PATTERN, pairs)
    plain, _ = bpe.coder(ranks, P.PATTERN)
    ref = tik()
    for t in odd_texts():
        assert encode(t).tolist() == ref.encode_ordinary(t) == plain(t).tolist(), repr(t)
        assert decode(encode(t)) == t.encode()


def test_new_words_fold_together(monkeypatch):
    ranks, pairs = bpe.load(RANKS)
    rng, ref, alone = random.Random(5), tik(), []
    one = bpe.fold_word
    monkeypatch.setattr(bpe, "fold_word", lambda w, *maps: alone.append(w) or one(w, *maps))
    new = ["".join(rng.choice("aeinorstхé-'\n") for _ in range(rng.randrange(1, 12))) + "z" for _ in range(3000)]
    texts = [" ".join(new[i : i + 30]) for i in range(0, len(new), 30)]
    _, encode_all, _ = bpe.coders(ranks, P.PATTERN, pairs)
    assert [(t, i.tolist()) for t, i in encode_all(texts)] == [(t, ref.encode_ordinary(t)) for t in texts]
    firsts = {w for t in texts for w in regex.findall(r"\w+|\W+", t.split(" ")[0])}
    assert not [w for w in alone if w not in ranks and w.decode() not in firsts]


def test_texts_encoded_together_equal_the_library(monkeypatch):
    ranks, pairs = bpe.load(RANKS)
    ref, texts = tik(), [None, "", *odd_texts(), None, *odd_texts()[:40]]
    want = [ref.encode_ordinary(t or "") for t in texts]
    for group, memory in ((bpe.GROUP, bpe.CACHE), (20, 1000), (1, 4)):  # the last two forget on the way
        monkeypatch.setattr(bpe, "GROUP", group)
        _, encode_all, decode = bpe.coders(ranks, P.PATTERN, pairs, memory)
        got = list(encode_all(texts))
        assert [t for t, _ in got] == texts and [i.tolist() for _, i in got] == want
        assert [decode(i) for _, i in got] == [(t or "").encode() for t in texts]
    assert list(bpe.coders(ranks, P.PATTERN, pairs)[1]([])) == []


def test_words_folded_together_equal_each_alone():
    ranks, pairs = bpe.load(RANKS)
    rng = random.Random(7)
    own = [w.encode() for w in (" the", "zz", "ththehation", " ouèlle", "😀x", "aaaaaaaa", "abababababab")]
    own += [bytes(rng.choice(b"aeinst \xc3\xa9\xff\x00") for _ in range(rng.randrange(2, bpe.SHORT + 1))) for _ in range(2000)]
    own = [w for w in own if w not in ranks]
    fold = bpe.folder(ranks, pairs)
    assert fold(own) == [array("i", bpe.fold_word(w, ranks)).tobytes() for w in own]
    assert fold([]) == [] and fold(own[:1]) == [array("i", bpe.fold_word(own[0], ranks)).tobytes()]
    ties = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"ba": 300, b"aba": 301}
    assert bpe.folder(ties, bpe.pair_ranks(ties))([b"ababa", b"xbab"]) == [array("i", bpe.fold_word(w, ties)).tobytes() for w in (b"ababa", b"xbab")]


def test_a_full_memory_forgets_what_is_not_asked_for():
    m = Memory(10)
    for i in range(200):
        m.put(i, i)
        assert m.get(0) == 0 and m.get(i) == i and len(m.young) + len(m.old) <= 10
    assert m.get(150) is None
    ranks, pairs = bpe.load(RANKS)
    encode, _ = bpe.coder(ranks, P.PATTERN, pairs, 4)
    ref = tik()
    for t in odd_texts()[:60]:
        assert encode(t).tolist() == ref.encode_ordinary(t)


def test_counter_equals_the_library():
    count = token_counts.counter(token_counts.load(COUNTS))
    ref = Tokenizer.from_file(COUNTS)
    for t in odd_texts():
        assert count(t) == len(ref.encode(t, add_special_tokens=False).ids), repr(t)


def test_long_and_short_merges_agree():
    rng = random.Random(3)
    ranks = {}
    for a in ("a", "b", "ab", "ba", "aa", "abab", "bb"):
        for b in ("a", "b", "ab", "ba", "aa", "bb"):
            ranks.setdefault((a, b), rng.randrange(20))

    def slow(parts):
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks), default=None)
            if best is None:
                return parts
            i = best[1]
            parts = parts[:i] + [parts[i] + parts[i + 1]] + parts[i + 2 :]

    for n in (1, 5, 63, 64, 65, 300):
        parts = [rng.choice("ab") for _ in range(n)]
        assert merge_ranked(list(parts), lambda a, b: ranks.get((a, b), 1 << 60)) == slow(parts)


def test_fold_as_higher_order_functions(spark):
    ranks = bpe.load_ranks(RANKS)
    own = sorted({" the", "ththehation", " ouèlle", "😀x", "a", "zzzzzzzz", " unbelievable", "\n\n"})
    df = spark.createDataFrame([(w,) for w in own], "word string")
    got = {r.word: r.ids for r in bpe.encode_words(df, ranks).collect()}
    assert got == {w: bpe.fold_word(w.encode(), ranks) for w in own}


def test_digests_and_counts_of_edge_rows(spark):
    df, rows = helpers.docs(spark)
    ref, sha = tik(), lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = ref.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, bpe.digest_texts(df, RANKS, P.PATTERN).collect()), key=key) == sorted(want, key=key)
    counts = Tokenizer.from_file(COUNTS)
    want = [(i, len((t or "").encode()), n := len(counts.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert sorted(map(tuple, token_counts.count_tokens(df, COUNTS).collect()), key=key) == sorted(want, key=key)


def test_code_texts_keeps_rows(spark):
    df, rows = helpers.docs(spark)
    out = bpe.code_texts(df, RANKS, P.PATTERN)
    assert set(out.columns) == set(df.columns)  # ids and n_tokens replaced
    got = out.select("doc_id", "text", "ids", "n_tokens", "kept").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(rows, key=repr)
    assert all(len(r.ids) == r.n_tokens and r.kept == "clash" for r in got)
    assert {r.n_tokens for r in got if not r.text} == {0}


def test_packed_maps_are_the_maps():
    maps = bpe.load(RANKS)
    assert bpe.unpack(bpe.pack(*maps)) == maps
    assert bpe.unpack(bpe.pack({}, {})) == ({}, {})


def test_code_texts_keeps_only_the_packed_maps(spark, monkeypatch):
    sent, runs = [], []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value))
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run))
    bpe.code_texts(df, RANKS, P.PATTERN)
    assert len(sent) == len(runs) == 1 and not any(isinstance(x, dict) for x in sent[0])


def test_empty_tables(spark):
    df = helpers.empty(spark)
    assert bpe.digest_texts(df, RANKS, P.PATTERN).count() == 0
    assert bpe.encode_texts(df, RANKS, P.PATTERN).count() == 0
    assert bpe.code_texts(df, RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(df, COUNTS).count() == 0


def test_encode_texts_gives_ids_and_bytes(spark):
    df, rows = helpers.docs(spark)
    ref = tik()
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.encode_texts(df, RANKS, P.PATTERN).collect()}
    for i, t in rows:
        assert got[i] == (ref.encode_ordinary(t or ""), (t or "").encode())
