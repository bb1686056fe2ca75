"""Quality classifier: gradient against differences, kept rows, tables without labels; packing: whole sequences."""

import numpy as np
import pytest

from tidewatch.llm import packing, quality


@pytest.mark.parametrize("size", [0, 5, 300, 1500])
def test_gradient_is_that_of_the_loss(size):
    rng = np.random.default_rng(size)
    net = quality.Network(0.3, seed=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["bias"] += 0.3
    data = rng.integers(0, 256, size, dtype=np.uint8)
    empty = lambda: {k: np.zeros_like(v) for k, v in net.p.items()}
    g = empty()
    net.gradient(data, 1, g)
    assert abs(net.score(data) - 1 / (1 + np.exp(-(net.pooled(net.maxima(data)) @ net.p["out"] + net.p["base"][0])))) < 1e-9
    for name, at in (("out", (3,)), ("out", (30,)), ("base", (0,)), ("bias", (2,)), ("bias", (11,)), ("conv", (7, 4)), ("conv", (20, 0)), ("embed", (int(data[0]) if size else 256, 2)), ("embed", (int(data[-1]) if size else 256, 5))):
        x, step = net.p[name], 1e-6
        x[at] += step
        up = net.gradient(data, 1, empty())
        x[at] -= 2 * step
        down = net.gradient(data, 1, empty())
        x[at] += step
        assert abs((up - down) / (2 * step) - g[name][at]) < 1e-4, (name, at)


def test_kept_rows_and_tables_without_labels(spark):
    docs = spark.createDataFrame([(1, "a fine text", 1), (2, None, 2), (None, "", 3), (3, "x" * 600_000, 4)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    net = quality.fit(docs, none)
    assert {round(r.score, 6) for r in quality.scores(docs, net).collect()} == {0.5}
    assert sorted(r.score for r in quality.keep_good(docs, net).collect()) == [1, 2, 3, 4] and quality.keep_good(docs, net, 0.51).count() == 0
    assert quality.scores(docs.where("false"), net).count() == 0
    one = quality.fit(docs, spark.createDataFrame([(i, 0) for i in range(1, 9)], "doc_id long, quality int"))
    assert quality.keep_good(docs, one).count() == 0


def test_sequences_hold_the_packed_tokens(spark):
    rows = [(k, " ".join(f"word{k}" for _ in range(40 + 13 * k)), 1) for k in range(30)] + [(100, None, 1), (101, "long " * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    packed = packing.pack_documents(docs, 512)
    got = {r.sequence_id: r.tokens for r in packing.sequences(docs, packed, 512).collect()}
    tok = packing.tokenizer(packing.VOCABULARY)
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for k, t, _ in rows}
    for r in packed.collect():
        assert got[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length]
    assert sum(map(len, got.values())) == sum(map(len, ids.values())) and max(map(len, got.values())) <= 512
