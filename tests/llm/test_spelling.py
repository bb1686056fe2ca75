"""Spelling variants against brute force: counts, signatures, pairs, forms and roots."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from tidewatch.llm import spelling as S

LOWER = str.maketrans(S._UPPER, S._LOWER)


def brute_words(rows):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                c[run] += 1
    return {w: n for w, n in c.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        if near[w]:
            v = min(near[w], key=lambda x: (-words[x], x))
            if words[v] >= 5 * n:
                form[w] = v
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def similar_words(rng, count, letters="abeéàz", least=6, most=9):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(least, most))) for _ in range(count // 4)]
    out = set(base)
    while len(out) < count:
        w = list(rng.choice(base))
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        if len(w) >= 6:
            out.add("".join(w))
    return {w: rng.choice((5, 6, 30, 200, 1500, 9000)) for w in out}


def test_counts_of_whole_texts(spark):
    rng = random.Random(1)
    vocabulary = ["Straße", "garçon", "ÀÉÎõüÿ", "wörter×mal", "Letters", "LETTERS", "letters", "short", "a" * 300]
    rows = [(i if i % 7 else None, " ".join(rng.choice(vocabulary) + rng.choice(("", ",", "1", "ſ")) for _ in range(60))) for i in range(60)]
    rows += [rows[3], (9, None), (10, ""), (11, "x" * 100_000 + " letters")]
    got = {r.word: r.n for r in S.counted_words(spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, word string")).collect()}
    assert got == brute_words(rows) and any(w in got for w in ("lettes", "aaa" * 100))


@pytest.mark.parametrize(("distance", "first", "second"), [(2, 1, 7), (2, 1, 4), (2, 2, 3), (2, 3, 2), (3, 2, 3)])
def test_signatures_meet_within_the_distance(spark, distance, first, second):
    rng = random.Random(5)
    words = [*similar_words(rng, 60), "aaaaaa", "bbbbbb"]
    rows = spark.createDataFrame([(w, "".join(sorted(w))) for w in words], "word string, ordered string")
    from pyspark.sql import functions as F

    got = {r.word: r.s for r in rows.select("word", F.array(*S.signatures(F.col("ordered"), distance, first, second)).alias("s")).collect()}
    for a, b in combinations(words, 2):
        x, y = Counter(a), Counter(b)
        if sum((x - y).values()) + sum((y - x).values()) <= distance:
            assert any(p == q for p, q in zip(got[a], got[b])), (a, b)


@pytest.mark.parametrize("sizes", [{}, {"hot": 1}, {"hot": 0, "second": 4}, {"first": 2, "second": 3, "hot": 3}, {"hot": 10**9}])
def test_pairs_forms_and_roots(spark, sizes):
    words = similar_words(random.Random(2), 260) | {"abcdef": 5, "abcdeg": 25, "abcdgg": 125, "abcggg": 625, "abgggg": 3125, "abggggg": 3125}
    assert {tuple(r) for r in S.variants(table(spark, words), **sizes).collect()} == brute(words)


def test_hot_anagrams_do_not_meet_in_all_pairs(spark):
    """Hundreds of anagrams share every signature; halves keep what meets far below all pairs."""
    rng = random.Random(4)
    words = set()
    while len(words) < 1500:
        w = list("abcdefghij")
        rng.shuffle(w)
        words.add("".join(w))
    words = dict.fromkeys(sorted(words), 5) | {sorted(words)[0][:-1] + "z": 100}
    out = {tuple(r) for r in S.variants(table(spark, words)).collect()}
    assert out == brute(words)


def test_query_on_documents(spark):
    rng = random.Random(8)
    words = list(similar_words(rng, 120))
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=80))) for i in range(90)]
    got = {tuple(r) for r in S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(brute_words(rows)) and any(r[1] for r in got)


def test_edges(spark):
    empty = S.spelling_variants(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0
    same = S.spelling_variants(spark.createDataFrame([(None, "repeat repeat repeat")] * 2, "doc_id long, text string")).collect()
    assert [tuple(r) for r in same] == [("repeat", None, "repeat", 6, 0, None)]
    with pytest.raises(ValueError):
        S.variants(table(spark, {"abcdef": 5}), times=1)
