"""Edge rows and brute-force versions shared by the operators' tests."""

import collections

from pyspark.sql import functions as F

LONG = "Word after word, and then some more of the same text. " * 3000

EDGE_TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "one two three four",
    "The the THE tHe. İstanbul ẞ ΣΑΣ ﬁ 中文 字 😀👍🏽 é",
    "line\nline\n\n line\nother line\nline",
    "a  b \n c\u00a0d\u3000e \x1c f ",
    LONG,
    "tie tie tie tie tie tie tie tie tie tie",
    "tie tie tie tie tie tie tie tie tie tie",
]

#: Names that the operators use inside, or return.
CLASH = "id n key block hash share tokens w h at kept rule verdict n_words n_tokens base_failed component_id held_out score entities ids window doc item n_entities".split()


def docs(spark, texts=EDGE_TEXTS, repeat_last=True):
    """Rows (doc_id, text) with clashing extra columns; the last row twice, and one with a null id."""
    rows = [(i, t) for i, t in enumerate(texts)]
    if repeat_last:
        rows += [rows[-1], (None, "a text whose id is null, with a few words in it")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}), rows


def empty(spark, schema="doc_id bigint, text string"):
    return spark.createDataFrame([], schema)


def words(text):
    return [w.decode() for w in text.encode().split()] if text else []


def lower(text):
    return text.encode().lower().decode()


def shingles(text, k, short):
    w = words(lower(text or ""))
    if not w or len(w) < k and not short:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def components(rows, k, percent):
    """{id: (shingles, smallest id reachable)} by comparing all documents that share a shingle."""
    sets = {i: shingles(t, k, True) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}
