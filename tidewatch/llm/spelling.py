"""Spelling variants of words, found by PartEnum signatures.

A word is taken as the multiset of its letters: a binary vector with a dimension for each letter and repetition. One inserted or
deleted letter changes one dimension, one replaced letter two at most, so words that are one edit apart have vectors within
Hamming distance ``DISTANCE`` (two). PartEnum cuts the dimensions into ``FIRST`` parts, one of which holds at most k = DISTANCE
// FIRST of the differences, and each of them into ``SECOND`` parts, of which all but k agree there: the letters of every choice of
SECOND - k parts are a signature, and two words within the distance share one of them, surely. Signatures carry the length
of the shorter word, so that only words of equal length or one letter apart meet. They are joined as equal hashes; words that meet
are verified by their edit distance.

Hot signatures: anagrams and words of very few different letters share them in any number. Where more than ``HOT`` words do, they
meet again by a half of their letters too: of two words one edit apart, the first half or what follows it is the same. Nothing is
dropped, and no group meets in all its pairs but one of words that agree in a half and in nearly all letters.

Words are counted with partial aggregation, so one that a third of all text repeats is a row a task. Everything after the count works
on distinct words.

Defined cases: a null text has no words; a null id counts as an empty one where runs are damaged; repeated rows are
counted each. Of near words with the largest count, the one that comes first in code-point order is the form. Other columns are ignored.
Empty in, empty out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Fixed values of the counted words: letters of a run, code points and occurrences at least, one run in DAMAGED loses a letter.
LETTERS, LEAST_CHARS, LEAST_COUNT, DAMAGED = r"A-Za-zÀ-ÿ", 6, 5, 199
#: A near word is the form of words that are so many times rarer.
TIMES = 5
DISTANCE, FIRST, SECOND, HOT = 2, 1, 7, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters by falling frequency in European texts, so that parts which take them in turn are about equally heavy.
_FREQUENT = "eantirosludcmphgvbfyqkwzjx"


def counted_words(docs: DataFrame, damaged: int = DAMAGED, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts, with their occurrences. Of a run whose checksum with the document's id ``damaged``
    divides, a letter is left out, as a misspelling that is known."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"([{LETTERS}]{{{least_chars},}})"))  # only these can have that many letters left
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("run"))
    rows = rows.select("i", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "i", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    rows = rows.select(F.when(h % damaged == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def letter_parts(parts: int) -> list[str]:
    """The letters of each of ``parts`` parts: every letter is in one of them."""
    rest = "".join(map(chr, range(0xC0, 0x100)))
    return [(_FREQUENT + rest)[k::parts] for k in range(parts)]


def signatures(ordered: Column, distance: int = DISTANCE, first: int = FIRST, second: int = SECOND) -> list[Column]:
    """PartEnum signatures of a vector, given as the string of a word's letters in order."""
    parts, k = letter_parts(first * second), distance // first
    if second <= k:
        raise ValueError("second must be more than distance // first")
    out = []
    for a in range(first):
        own = set(range(a * second, (a + 1) * second))
        for gone in combinations(sorted(own), k):
            left = own - set(gone)
            out.append(F.translate(ordered, "".join(p for i, p in enumerate(parts) if i not in left), ""))
    return out


def signature_keys(words: DataFrame, distance: int = DISTANCE, first: int = FIRST, second: int = SECOND) -> DataFrame:
    """(key, word, n, size, m) for each signature of each word, as the shorter or equal one (m is its size) and as the longer one (m is one less)."""
    rows = words.select("word", "n", F.length("word").alias("size"), F.array_join(F.array_sort(F.split("word", "")), "").alias("ordered"))
    each = F.posexplode(F.array(*signatures(F.col("ordered"), distance, first, second))).alias("part", "letters")
    rows = rows.select("word", "n", "size", each)
    rows = rows.withColumn("m", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    return rows.select(F.xxhash64("m", "part", "letters").alias("key"), "word", "n", "size", "m")


def near_pairs(words: DataFrame, distance: int = DISTANCE, first: int = FIRST, second: int = SECOND, hot: int = HOT) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of ``words(word, n)`` that one inserted, deleted or replaced letter makes equal, each once, a <= b in size."""
    keyed = signature_keys(words, distance, first, second)
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("of"), F.max((F.col("m") == F.col("size")).cast("int")).alias("own"))
    keyed = keyed.join(met.where("of > 1 AND own = 1").select("key", "of"), "key")
    half = F.expr("m DIV 2")
    halves = F.array(F.concat(F.lit("<"), F.substr("word", F.lit(1), half)), F.concat(F.lit(">"), F.substr("word", F.col("size") - (F.col("m") - half) + 1)))
    again = F.explode(F.when(F.col("of") > hot, F.transform(halves, lambda h: F.xxhash64("key", h))).otherwise(F.array("key"))).alias("key")
    rows = keyed.select(again, "word", "n", "size", "m")
    a = rows.where("m = size").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("size").alias("a_size"))
    b = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("size").alias("b_size"))
    # cheap tests first; a pair that meets by several signatures is one after the distinct
    near = F.when((F.col("b_size") > F.col("a_size")) | (F.col("b") > F.col("a")), F.levenshtein("a", "b", 1) == 1).otherwise(False)
    return a.join(b, "key").where(near).select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of ``forms(word, form)``: the end of each chain of forms, by doubling steps. No chain has more than ``most`` words."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    steps = 1
    while steps < most:
        # the end of a word's end, while there is one
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        steps *= 2
    return at


def variants(words: DataFrame, times: int = TIMES, **sizes) -> DataFrame:
    """Each row of ``words(word, n)`` with form, root, n_near and form_n."""
    if times < 2:
        raise ValueError("forms of equal counts may go round in circles")
    pairs = near_pairs(words, **sizes)
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("s.*")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= times * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, F.col("form_n")).cast("long").alias("form_n"))
    rows = written(rows, "forms")
    with_form = rows.where("form IS NOT NULL")
    largest, depth = with_form.agg(F.max("form_n")).first()[0] or 0, 1
    while largest >= times:  # each form has ``times`` its word's count or more
        largest, depth = largest // times, depth + 1
    out = rows.join(roots(with_form, depth), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word of at least 6 code points and 5 occurrences: word, form (its near word of largest count, if 5 times its own), root, n, n_near, form_n."""
    return variants(written(counted_words(docs), "words"))
