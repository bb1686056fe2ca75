"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over the whole document, and their responses are max-pooled over overlapping
chunks (``CHUNK`` bytes, half shared with the next). The chunks' maxima are combined by their mean and their maximum into
one logistic probability. Scoring reads whole texts in pieces of bounded size, so a very long text needs no more memory.

Training is on the driver, by Adam on the log loss, over a bounded sample of labelled rows: at most ``MOST_ROWS`` rows (least hash
of the id first) whose text has at most ``MOST_BYTES`` bytes. Only the label and the text are used. The result is a few
thousand weights, sent with the tasks.

Defined cases: a null or empty text is one chunk of padding and gets a score. Without labelled rows of both kinds the score
is the share of label 1 (one half without any). Null and repeated ids are rows like any other (a null id is not held
out); of several labels for an id the largest is taken. Other columns are ignored by ``scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import column_bytes

EMBED, WIDTH, FILTERS, STRIDE, CHUNK = 6, 8, 24, 2, 512
MOST_ROWS, MOST_BYTES, EPOCHS, SEED = 3_000, 32_768, 10, 20240601
THRESHOLD = 0.3
_HALF = CHUNK // 2
_PIECE = 1 << 18


class Network:
    def __init__(self, prior: float = 0.5, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f32 = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.p = {
            "embed": f32(257, EMBED, scale=0.5), "conv": f32(WIDTH * EMBED, FILTERS, scale=1 / np.sqrt(WIDTH * EMBED)), "bias": np.zeros(FILTERS, np.float32),
            "out": f32(2 * FILTERS, scale=0.1), "base": np.array([np.log(prior / (1 - prior))], np.float32),
        }

    def halves(self, data: np.ndarray, want: bool = False):
        """Maxima of the filters over each half chunk of ``data``, and (``want``) where they are."""
        n = max(1, -(-len(data) // _HALF))
        codes = np.full(n * _HALF + WIDTH, 256, np.int64)
        codes[: len(data)] = data
        x = self.p["embed"][codes]
        rows = np.lib.stride_tricks.as_strided(x, (n * _HALF // STRIDE, WIDTH * EMBED), (x.strides[0] * STRIDE, x.strides[1]))
        y = (np.ascontiguousarray(rows) @ self.p["conv"]).reshape(n, _HALF // STRIDE, FILTERS)
        if not want:
            return y.max(axis=1)
        at = y.argmax(axis=1)
        return np.take_along_axis(y, at[:, None, :], 1)[:, 0], at, codes

    def maxima(self, data: np.ndarray) -> np.ndarray:
        """As ``halves`` but piece by piece; a piece sees the first bytes of the next, so nothing depends on the cut."""
        parts = []
        for a in range(0, max(1, len(data)), _PIECE):
            own = self.halves(data[a : a + _PIECE + WIDTH])
            parts.append(own[: max(1, -(-min(_PIECE, len(data) - a) // _HALF))])
        return np.concatenate(parts)

    def pooled(self, h: np.ndarray) -> np.ndarray:
        chunks = np.maximum(h[:-1], h[1:]) if len(h) > 1 else h
        r = np.maximum(chunks + self.p["bias"], 0)
        return np.concatenate([r.mean(axis=0), r.max(axis=0)])

    def score(self, data: np.ndarray) -> float:
        z = float(self.pooled(self.maxima(data)) @ self.p["out"] + self.p["base"][0])
        return 1 / (1 + np.exp(-min(max(z, -60.0), 60.0)))

    def gradient(self, data: np.ndarray, label: int, g: dict[str, np.ndarray]) -> float:
        h, at, codes = self.halves(data, True)
        n = len(h)
        left, right = (h[:-1], h[1:]) if n > 1 else (h, h)
        take = (right > left) & (n > 1)
        pre = np.maximum(left, right) + self.p["bias"]
        r = np.maximum(pre, 0)
        top = r.argmax(axis=0)
        feature = np.concatenate([r.mean(axis=0), r[top, np.arange(FILTERS)]])
        z = float(feature @ self.p["out"] + self.p["base"][0])
        prob = 1 / (1 + np.exp(-min(max(z, -60.0), 60.0)))
        d = np.float32(prob - label)
        g["out"] += d * feature
        g["base"] += d
        dr = np.broadcast_to(d * self.p["out"][:FILTERS] / len(r), r.shape).copy()
        dr[top, np.arange(FILTERS)] += d * self.p["out"][FILTERS:]
        dr *= pre > 0
        g["bias"] += dr.sum(axis=0)
        dh = np.zeros_like(h)
        k = len(r)
        dh[:k] += np.where(take, 0, dr)
        if n > 1:
            dh[1:] += np.where(take, dr, 0)
        i, f = np.nonzero(dh)
        where = i * _HALF + at[i, f] * STRIDE
        c = codes[where[:, None] + np.arange(WIDTH)]
        w = dh[i, f]
        x = self.p["embed"][c].reshape(len(c), -1)
        dconv = np.zeros((FILTERS, WIDTH * EMBED), np.float32)
        np.add.at(dconv, f, w[:, None] * x)
        g["conv"] += dconv.T
        back = (w[:, None] * self.p["conv"].T[f]).reshape(-1, EMBED)
        np.add.at(g["embed"], c.ravel(), back)
        return float(np.log1p(np.exp(-abs(z))) + max(z, 0) - z * label)


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.01, batch: int = 16) -> Network:
    share = float(np.mean(labels)) if labels else 0.5
    net = Network(min(max(share, 0.01), 0.99) if len(set(labels)) == 2 else 0.5, seed)
    if len(set(labels)) < 2:
        net.p["out"][:] = 0
        share = min(max(share, 1e-6), 1 - 1e-6)
        net.p["base"][:] = np.log(share / (1 - share))
        return net
    rng = np.random.default_rng(seed)
    data = [np.frombuffer(x, np.uint8) for x in texts]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, total = 0, epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), batch):
            g = {k: np.zeros_like(x) for k, x in net.p.items()}
            own = order[a : a + batch]
            for j in own:
                net.gradient(data[j], labels[j], g)
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, x in net.p.items():
                grad = g[k] / len(own) + 1e-4 * x * (k != "base")
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                x -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Network:
    """Learns from labelled rows that are not held out: the ``most_rows`` ids of least hash, less those with longer texts."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= most_bytes)
    found = rows.join(F.broadcast(some), "doc_id")  # most_rows rows
    sample = sorted(((r[0], r[1] or "", int(r[2])) for r in found.select("doc_id", "text", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).collect()))
    return train([x[1].encode() for x in sample], [x[2] for x in sample])


def _score_batches(net: Network):
    def run(batches):
        for t in batches:
            data, offsets = column_bytes(t.column("text"))
            out = [net.score(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("held_out"), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def scores(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    found = rows.mapInArrow(_score_batches(net), "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns; the text goes to Python and stays."""

    def run(batches):
        for t in batches:
            data, offsets = column_bytes(t.column("text"))
            good = [net.score(data[a:b]) >= threshold for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield t.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
