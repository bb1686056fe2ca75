"""SimHash: component ids of whole tables and links of fingerprints by balls, against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tidewatch.llm import simhash
from tidewatch.llm.graph import components


def fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for x in w if x]
    s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, near):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_component_ids(spark):
    rng = random.Random(2)
    texts = [None, "", "one", "One", "two words"]
    for _ in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice((5, 60, 200)))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(w))
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    rows = sorted(zip(ids, texts))
    fps = [fingerprint(t) for _, t in rows]
    want = {(rows[k][0], f"{fps[k]:016x}", rows[r][0]) for k, r in enumerate(classes(fps, lambda a, b: (a ^ b).bit_count() <= 4))}
    df = spark.createDataFrame([*rows, (None, texts[5])], "doc_id long, text string")
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert {r for r in got if r[0] is not None} == want and len({r[2] for r in want}) < len(want)
    assert [r for r in got if r[0] is None] == [(None, f"{fingerprint(texts[5]):016x}", None)]


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_balls_find_all_links_in_chunks_of_any_size(spark, radius):
    rng = np.random.default_rng(radius)
    fps = {int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)}
    for c in list(fps)[:8]:  # chains and dense groups
        at = c
        for _ in range(25):
            at ^= 1 << int(rng.integers(64))
            fps |= {at, c ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))), at ^ (0b11 << int(rng.integers(62)))}
    fps = sorted(fps)
    want: dict = {}
    for k, r in enumerate(classes(fps, lambda a, b: (a ^ b).bit_count() <= radius)):
        want.setdefault(r, set()).add(int(np.uint64(fps[k]).view(np.int64)))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    for variants in (len(simhash.ball(radius // 2)) * 40, 8_000_000):
        got: dict = {}
        for r in components(simhash.links(df, radius, variants)).collect():
            got.setdefault(r.root, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


@pytest.mark.parametrize("radius", [2, 4])
def test_only_fingerprints_with_company_make_balls(spark, radius, monkeypatch):
    rng = np.random.default_rng(9)
    alone = rng.integers(0, 2**64, 3_000, dtype=np.uint64)
    pairs = []
    for x in rng.integers(0, 2**64, 300, dtype=np.uint64).tolist():  # a partner up to the radius away, its bits in one block or spread
        bits = rng.choice(64, int(rng.integers(1, radius + 1)), replace=False)
        pairs += [x, x ^ sum(1 << int(b) for b in bits)]
    pairs = np.array(pairs, np.uint64)
    df = spark.createDataFrame([(int(x),) for x in np.concatenate([alone, pairs]).view(np.int64)], "fp long")
    for most in (20_000, 8_000_000):
        got = [r.fp for r in simhash.accompanied(df, radius, most).collect()]
        assert len(got) == len(set(got)) and set(pairs.view(np.int64).tolist()) <= set(got) and len(got) < len(pairs) + 200
    made = []
    monkeypatch.setattr(simhash, "Layout", lambda distinct, *a, f=simhash.Layout: made.append(distinct) or f(distinct, *a))
    assert {frozenset(r) for r in simhash.links(df, radius).collect()} == {frozenset(x) for x in pairs.view(np.int64).reshape(-1, 2).tolist()}
    assert len(made) == 1 and made[0] < len(pairs) + 200


def test_keys_of_blocks_follow_the_number_of_fingerprints():
    for n in (1, 10**5, 10**7, 10**9):
        taken, salts = simhash._block_keys(4, n)
        assert len(set(salts.tolist())) == len(taken) < len(simhash.ball(2))
        assert n * sum(2.0 ** -int(m).bit_count() for m in taken) <= 1 / simhash.CHANCE
    assert len(simhash._block_keys(4, 10**5)[0]) == 70 and simhash._block_keys(4, 10**15) is None
