"""Token counts against the tokenizer's own library."""

import random

import pytest
from tokenizers import Tokenizer

from tidewatch.llm import token_counts as T


@pytest.fixture(scope="module")
def library():
    from public_tokenizers import path

    own = Tokenizer.from_file(path(T.VOCABULARY))
    return lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


def test_every_character(library):
    """All code points, next to letters, numbers and signs, in runs of both."""
    chars = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    blocks = ["".join(chars[k : k + 97]) for k in range(0, len(chars), 97)]
    spaced = ["".join(f"a{c}1 {c}{c}!{c}" for c in b[::3]) for b in blocks[::3]]
    own = T.merger(T.VOCABULARY)
    for texts in (blocks, spaced):
        assert [own.tokens(x) for x in texts] == library(texts)


def test_generated_texts(library):
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|endof", "|>", " word", "'s", "'LL", "  \n", "\t", " ", "12", "é", "ß!", "中文", "́", "՘", "aaaa", "The quick", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += [rng.choice("a .=-\n1é") * rng.randrange(4_000) for _ in range(40)] + ["".join(rng.choice("abe") for _ in range(20_000))]
    own = T.merger(T.VOCABULARY)
    assert [own.tokens(x) for x in texts] == library(texts)


def test_merging_one_pair_at_a_time():
    """The heap against merging the lowest-ranked leftmost pair of the whole list, again and again."""
    own, rng = T.merger(T.VOCABULARY), random.Random(3)
    for _ in range(200):
        raw = bytes(rng.choice(b"the inaous\xc3\xa9") for _ in range(rng.randrange(60)))
        s, done = [own.first[b] for b in raw], 0
        while ranks := [(own.rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in own.rank]:
            r, i = min(ranks)
            s[i : i + 2] = [own.made[r]]
            done += 1
        assert own.merges(raw) == done


def test_a_long_run_without_a_list_of_its_pieces(library):
    text = "ab" * 600_000 + " " + "x y " * 20_000
    assert len(text) > 1 << 20 and T.merger(T.VOCABULARY).tokens(text) == library([text])[0]


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "_REMEMBERED", 10)
    known = T.Remembered(len)
    for k in range(100):
        assert known[f"p{k}"] == len(f"p{k}") and len(known) <= 10
    assert known["y" * 1000] == 1000 and "y" * 1000 not in known


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "token " * 600, None), (3, "token " * 600, None), (4, "é<|endoftext|>", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = T.token_counts(df)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(rows, library([t or "" for _, t, _ in rows]))]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert T.token_counts(df.limit(0)).count() == 0


def test_other_vocabularies_are_refused():
    from public_tokenizers import path

    with pytest.raises(ValueError):
        T.PairMerger(path("word_bpe_49k.json"))
