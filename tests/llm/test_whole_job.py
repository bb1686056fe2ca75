"""Findings of review r01: each of these failed before its fix."""

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import decontamination, line_dedup, shingle_dedup


def shingles(t):
    w = (t or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("often", [3, 10**9])
def test_near_dedup_stage_finds_all_pairs_at_0_8(spark, often, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(shingle_dedup, "OFTEN", often)
    rng = np.random.default_rng(5)
    texts = [None, "", "two words", "two words", "one"]
    for n in (7, 30, 60, 120):
        for _ in range(6):
            base = [f"w{x}" for x in rng.integers(0, 500, n)]
            for edits in (0, 0, 1, 1, 2, 3, 5):
                w = list(base)
                for at in rng.integers(0, n, edits):
                    w[at] = f"x{rng.integers(0, 9)}"
                texts.append(" ".join(w))
    head = " ".join(f"h{k}" for k in range(40))
    texts += [f"{head} " + " ".join(f"t{j}q{k}" for k in range(j % 12)) for j in range(40)]  # chains and a common passage
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)] + [(7, "another text of the same id stays here too", "en", "s", None), (None, texts[9], "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    keys = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})
    sets = [shingles(t) for _, t in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = sorted(keys[i] for i in range(len(keys)) if find(i) == i)
    got = corpus_pipeline.near_deduplication(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text or "") for r in got if r.doc_id is not None) == want
    assert [r.text for r in got if r.doc_id is None] == [texts[9]]
    assert corpus_pipeline.near_deduplication(spark, docs.where("false"), "").count() == 0


def test_short_lines_have_rows_and_are_linked_by_equality(spark):
    long = "a line of more than twenty code points"
    rows = [(1, f"}}\n{long}\n \t\nYes."), (2, f"  }}\r\nNo.\n{long}\n}}"), (3, None), (4, "Yes"), (None, "}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in line_dedup.line_classes(df).drop("class_id").collect())
    assert got == [
        (1, 0, 0, 1, 0, False), (1, 1, 0, 1, 1, False), (1, 3, 0, 1, 3, False),
        (2, 0, 0, 1, 0, True), (2, 1, 0, 2, 1, False), (2, 2, 0, 1, 1, True), (2, 3, 0, 1, 0, True), (4, 0, 0, 4, 0, False),
    ]
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}
    assert kept[2] == "  }\r\nNo.\n}"  # the stage takes out long copies only
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df, min_removed=1).collect()}[2] == "No."


def test_both_paths_of_decontamination_match_null_and_repeated_ids(spark):
    item = "A train leaves Paris at 9 with 120 people and then Anna counts 35 people more in the train to Paris"
    short = "seven plain words make this item here"
    big = 2**53 + 1
    docs = [(None, f"Before. {item} after"), (1, f"So: {item}"), (1, f"So: {item}"), (1, "other text of the same id"), (big, f"well {short} then"), (None, None), (2, "nothing of it")]
    items = [(None, item), (5, item), (5, short), (big + 2, short), (None, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    small, large = (sorted(map(str, decontamination.find(d, b, most_windows=m).collect())) for m in (decontamination.MOST_WINDOWS, 0))
    assert small == large and len(small) == 8


def test_large_sets_are_told_apart_by_numbers_of_classes():
    rng = np.random.default_rng(3)
    def set_of(n):
        return np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    def similar(base, share):
        return np.unique(np.concatenate([base[int(len(base) * share) :], set_of(int(len(base) * share))]))
    bases = [set_of(n) for n in (300, 1_600, 4_000, 16_000)]
    pairs = [(x, similar(x, 0.11)) for x in bases] + [(x, set_of(len(x))) for x in bases] + [(bases[1], bases[1][: 1_330])]
    sets = [v for pair in pairs for v in pair]
    n = np.array([len(v) for v in sets])
    bits, counts = shingle_dedup._sketches(np.concatenate(sets), n)
    assert [c is not None for c in counts.to_pylist()] == (n >= shingle_dedup.COUNTED).tolist()
    batch = pa.record_batch({"a": pa.array(range(len(pairs)), pa.int64()), "b": pa.array(range(len(pairs)), pa.int64()), "a_n": pa.array(n[::2], pa.int32()), "b_n": pa.array(n[1::2], pa.int32()), "a_counts": counts.take(pa.array(range(0, len(sets), 2))), "b_counts": counts.take(pa.array(range(1, len(sets), 2)))})
    near = [len(np.intersect1d(x, y)) * 5 >= 4 * len(np.union1d(x, y)) for x, y in pairs]
    assert near == [True] * 4 + [False] * 4 + [True]
    got = pa.Table.from_batches(shingle_dedup._counts_near((4, 5))([batch])).column("a").to_pylist()
    # the pair of 300 has no numbers, which parities tell apart; those of 4,000 and more parities can't
    flipped = [sum(int(p ^ q).bit_count() for p, q in zip(*bits.view(np.uint64).reshape(len(sets), -1)[2 * k : 2 * k + 2].tolist())) for k in (6, 7)]
    assert all(9 * f <= n[2 * k] + n[2 * k + 1] for k, f in zip((6, 7), flipped))
    assert got == [0, 1, 2, 3, 4, 8]
