"""Quality rules: base counts, and distribution divergence from language references.

A document's histogram of character classes and its histogram of common words
are compared with each reference language's by Jensen-Shannon distance; the
nearest language counts, so a wrong or missing language label harms nothing.
Either test has a length below which it does not judge, and neither judges a
text whose script or language has no reference. Everything is one pass
of built-in functions over each row: no shuffle, no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, words

#: Words of a window whose repetition counts.
WINDOW = 8
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30

#: Shares of character classes in edited prose (lower case, upper
#: case, digits, white space, punctuation, all other).
CHAR_REFERENCES = {
    "en": [0.783, 0.025, 0.004, 0.165, 0.022, 0.001],
    "de": [0.772, 0.055, 0.004, 0.145, 0.023, 0.001],
    "fr": [0.783, 0.022, 0.004, 0.165, 0.025, 0.001],
    "es": [0.786, 0.022, 0.004, 0.164, 0.023, 0.001],
}
#: Shares of the commonest words in prose.
WORD_REFERENCES = {
    "en": {"the": 0.060, "of": 0.031, "and": 0.028, "to": 0.024, "a": 0.020, "in": 0.019, "is": 0.011, "that": 0.011, "for": 0.009, "it": 0.009},
    "de": {"der": 0.036, "die": 0.034, "und": 0.028, "in": 0.017, "den": 0.013, "von": 0.011, "zu": 0.011, "das": 0.011, "mit": 0.009, "sich": 0.008},
    "fr": {"de": 0.050, "la": 0.028, "le": 0.021, "et": 0.020, "les": 0.018, "des": 0.016, "en": 0.012, "un": 0.011, "du": 0.011, "que": 0.010},
    "es": {"de": 0.060, "la": 0.037, "que": 0.030, "el": 0.028, "en": 0.026, "y": 0.025, "a": 0.020, "los": 0.016, "se": 0.013, "del": 0.011},
}
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 300, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.22, 0.25

#: Common words of other languages in Latin script, to tell a text that has no
#: reference. Words that are also listed above, or common there, are left out.
OTHER_LANGUAGES = {
    "it": "di il che per è della sono non del gli alla nel anche dei più",
    "pt": "do da não uma os dos das para com ao pelo são mais também",
    "nl": "het een van dat niet zijn voor aan ook naar maar bij wordt werd",
    "sv": "och att det som för inte på är av till ett har från kan",
    "da": "og at det som ikke på er af til et har fra der jeg var",
    "no": "og å det som ikke på er av til et har fra jeg var",
    "fi": "ja on ei että se joka mutta ovat kun hän ole myös tai sen",
    "pl": "i w na z że się nie do jest o jak to za po",
    "cs": "a v na že se je s z do o jako pro ale by",
    "ro": "și în că nu pe cu este din care la mai sau sunt o",
    "hu": "a az és hogy nem is egy ez meg csak de volt van ha",
    "tr": "ve bir bu da için ile çok gibi daha olarak ne o kadar olan",
    "id": "yang dan di itu dengan untuk dari dalam tidak ini pada adalah ke akan",
    "vi": "và của là có không cho được một trong với các những đã người",
    "ca": "i els amb per dels una com al és més però van les ha",
}
#: A text far from all references is in one of these if their words make up this share of it,
#: and so many different ones are found.
MIN_OTHER_SHARE, MIN_OTHER_WORDS = 0.08, 5
#: Letters of the references' script, and those without case.
LATIN, CASELESS = r"\p{IsLatin}", r"\p{Lo}"

#: Character classes by what they leave when all else is deleted; the rest is "other".
CLASSES = [r"[^\p{Ll}]+", r"[^\p{Lu}]+", r"[^\p{Nd}]+", r"[^\x20\x09-\x0D]+", r"[^.,;:!?'\"()\-]+"]


def repeated_words(w: Column) -> Column:
    """Words of the array that lie in a window found twice or more, the first included.

    Windows are compared by 64-bit hashes within one text. Only a text with
    equal hashes pays for the sort that finds where they are.
    """

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda n, x: n + x)

    def twins(s: Column) -> Column:
        same = lambda e, i: F.coalesce(e["h"] == F.get(s, i)["h"], F.lit(False))
        found = F.filter(s, lambda e, i: F.when(i > 0, same(e, i - 1)).otherwise(False) | same(e, i + 1))
        return let(F.sort_array(F.transform(found, lambda e: e["at"])), covered)

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(F.sort_array(pairs), twins))

    hashes = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - WINDOW + 1), lambda i: F.xxhash64(F.slice(v, i, WINDOW)))
    return let(w, lambda v: F.when(F.size(v) < WINDOW, F.lit(0).cast("bigint")).otherwise(let(hashes(v), count)))


def distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of an array of shares and a reference."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, F.array(*map(F.lit, q)), lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def base_counts(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    w = words(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.char_length(F.regexp_replace(t, SPACE, "")).cast("bigint"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeated_words(w),
    }


def nearest(shares: Column, references: list[list[float]]) -> Column:
    return let(shares, lambda p: F.least(*[distance(p, q) for q in references]))


def letters(t: Column, kind: str = r"\p{L}") -> Column:
    """Letters of the kind in the text."""
    return F.char_length(F.regexp_replace(t, f"[^{kind}]+", ""))


def other_language(w: Column) -> Column:
    """Whether enough of the words are common ones of one of OTHER_LANGUAGES."""

    def enough(words_: str) -> Column:
        listed = words_.split()

        def test(found: Column) -> Column:
            return (F.size(found) >= MIN_OTHER_SHARE * F.size(w)) & (F.size(F.array_distinct(found)) >= MIN_OTHER_WORDS)

        return let(F.filter(w, lambda x: x.isin(listed)), test)

    out = F.lit(False)
    for words_ in OTHER_LANGUAGES.values():
        out = out | enough(words_)
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``char_distance``, ``word_distance`` and ``kept``.

    All other columns are kept; columns named like the new ones are replaced.
    Null and empty texts count 0 words and fail the base rules. A text below
    the length a distance needs has a null distance and passes it; so does one
    too far from all references whose script or language has none: mostly
    letters without case for the characters, mostly letters that are not Latin
    or the common words of another listed language for the words. Texts of any
    length are judged whole, a null id stays, each row, repeated ones too, is
    judged by itself, and an empty table stays empty.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    vocabulary = sorted({w for r in WORD_REFERENCES.values() for w in r})
    out = docs.withColumns(base_counts(F.col(text_col)))
    sizes = [F.char_length(F.regexp_replace(t, c, "")) for c in CLASSES]
    classes = let(F.array(F.char_length(t), *sizes), lambda n: F.transform(F.array(*[n[i] for i in range(1, 6)], n[0] - n[1] - n[2] - n[3] - n[4] - n[5]), lambda x: x / n[0]))
    caseless, foreign = 2 * letters(t, CASELESS) > letters(t), 2 * letters(t, LATIN) < letters(t)
    no_reference = lambda d, most, test: F.when((d <= most) | ~test, d)
    char = F.when(
        F.char_length(t) >= MIN_CHARS_JUDGED, let(nearest(classes, list(CHAR_REFERENCES.values())), lambda d: no_reference(d, MAX_CHAR_DISTANCE, caseless))
    )

    def word_shares(language: str):
        at = [vocabulary.index(w) for w in WORD_REFERENCES[language]]

        def shares(n: Column) -> Column:  # n: words in all, then those of each word of the vocabulary
            own = [n[i + 1] / n[0] for i in at]
            rest = F.lit(1.0)
            for x in own:
                rest = rest - x
            return F.array(*own, F.greatest(rest, F.lit(0.0)))

        return shares

    def to_reference(q: list[float]):
        return lambda p: distance(p, [*q, 1 - sum(q)])

    def word_distance(n: Column) -> Column:
        return F.least(*[let(word_shares(language)(n), to_reference(list(r.values()))) for language, r in WORD_REFERENCES.items()])

    common = lambda w: F.filter(w, lambda x: x.isin(vocabulary))
    counts = lambda c, n: F.concat(F.array(n), F.transform(F.array(*map(F.lit, vocabulary)), lambda v: F.size(F.filter(c, lambda x: x == v)).cast("bigint")))

    def to_nearest(w: Column) -> Column:
        far = let(common(w), lambda c: let(counts(c, F.col("n_words")), word_distance))
        return let(far, lambda d: no_reference(d, MAX_WORD_DISTANCE, foreign | other_language(w)))

    word = F.when(F.col("n_words") >= MIN_WORDS_JUDGED, let(words(F.lower(t)), to_nearest))
    out = out.withColumns({"char_distance": char, "word_distance": word})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)
