"""Substring deduplication by Rabin-Karp window hashes counted in Spark.

Every window of ``width`` consecutive words of a text is hashed. A window is repeated if the same word sequence also
starts in a document with a smaller ``doc_id``; the words that repeated windows cover go, in maximal intervals.

How it runs: documents are dealt into chunks of bounded size by a hash of their id. A chunk sends the distinct hashes of
its windows, each with the smallest id that has it, to the hash's bucket as packed arrays (no row each: 10 bytes a window, and
an id for each run of windows that have it); a bucket finds the smallest id of each hash over the corpus and returns one bit a
hash; the chunk, whose shuffled rows Spark reuses, turns the bits into intervals. Chunks and buckets are bounded by construction: a hash counts once a chunk
however often a passage repeats there, so a passage that a third of all documents share makes no group large.

Equal windows are told by 80 bits, a Rabin-Karp hash of 64 and 16 bits of one of other values: among the ten trillion windows of
100 TB some forty pairs of different ones are expected to agree in them.

Defined cases: a null text has no words. A row with a null ``doc_id`` has no place in the order: it is returned
unchanged and removes nothing elsewhere. Repeated ids never remove each other's words (strictly smaller ids do). Texts
shorter than a window keep all words. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import U64, Words, column_bytes, joined, mix, rolled, runs, words

WIDTH = 13
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept_text string"


def sizes(total_bytes: int) -> tuple[int, int]:
    """Number of chunks and of buckets: both hold more as the corpus grows, up to what a task can hold."""
    grow = min(32.0, max(1.0, math.sqrt(total_bytes / 2e9)))
    return max(1, math.ceil(total_bytes / (1e6 * grow))), max(1, math.ceil(total_bytes / (12e6 * min(grow, 10.0))))


def _sorted_runs(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (h, more) together, and whether each element in it begins a new pair."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (more[order][1:] != more[order][:-1])).any():  # 64 bits alone don't tell them
        order = np.lexsort((more, h))
        same = h[order][1:] == h[order][:-1]
    new = np.ones(len(h), bool)
    new[1:] = ~same | (more[order][1:] != more[order][:-1])
    return order, new


def _run_bytes(ids: np.ndarray) -> bytes:
    """Sorted ids as (id, times) of 12 bytes."""
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[at].astype("<i8").tobytes() + np.diff(at, append=len(ids)).astype("<u4").tobytes()


def _from_runs(blob: bytes) -> np.ndarray:
    n = len(blob) // 12
    return np.repeat(np.frombuffer(blob[: 8 * n], "<i8"), np.frombuffer(blob[8 * n :], "<u4"))


class _Chunk:
    """Windows of one chunk. The order of ``unique`` depends on the set of (hash, id) only, not on the order of rows."""

    def __init__(self, t: pa.Table, width: int, buckets: int):
        t = t.sort_by("doc_id")
        self.table = t
        ids = t.column("doc_id").combine_chunks()
        self.null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words: Words = words(*column_bytes(t.column("text")))
        at = runs(self.words, width)
        at = at[~self.null[self.words.row[at]]]
        self.at, self.doc = at, self.ids[self.words.row[at]]
        values = self.words.hashes() if len(at) else np.zeros(0, U64)
        h, more = rolled(values, width, at), rolled(mix(values + U64(1)), width, at).astype(np.uint16)
        order, new = _sorted_runs(h, more)  # rows are in the order of ids
        first = np.flatnonzero(new)
        hu, mu = h[order][first], more[order][first]
        du = np.minimum.reduceat(self.doc[order], first) if len(first) else np.zeros(0, np.int64)
        place = np.lexsort((mu, hu, du, (hu >> U64(20)) % U64(buckets)))
        self.hash, self.more, self.least = hu[place], mu[place], du[place]
        self.bucket = ((self.hash >> U64(20)) % U64(buckets)).astype(np.int64)
        back = np.empty(len(place), np.int64)
        back[place] = np.arange(len(place))
        self.of = np.empty(len(h), np.int64)
        self.of[order] = back[np.cumsum(new) - 1]

    def blobs(self):
        edges = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]])) if len(self.bucket) else np.zeros(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(self.bucket)), strict=True):
            yield int(self.bucket[a]), int(a), int(b)


def _emit(width: int, buckets: int):
    def emit(key, t):
        c = _Chunk(t, width, buckets)
        got = list(c.blobs())
        return pa.table({
            "g": pa.array([key[0].as_py()] * len(got), pa.int64()),
            "bucket": pa.array([x[0] for x in got], pa.int64()),
            "hashes": pa.array([c.hash[a:b].tobytes() for _, a, b in got], pa.binary()),
            "more": pa.array([c.more[a:b].tobytes() for _, a, b in got], pa.binary()),
            "docs": pa.array([_run_bytes(c.least[a:b]) for _, a, b in got], pa.binary()),
        })

    return emit


def _bucket(key, t):
    hashes = [np.frombuffer(x, U64) for x in t.column("hashes").to_pylist()]
    h, more = np.concatenate(hashes), np.concatenate([np.frombuffer(x, np.uint16) for x in t.column("more").to_pylist()])
    d = np.concatenate([_from_runs(x) for x in t.column("docs").to_pylist()])
    order, new = _sorted_runs(h, more)
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(d[order], first)
    hit = np.empty(len(h), bool)
    hit[order] = d[order] > least[np.cumsum(new) - 1]
    ends = np.cumsum([len(x) for x in hashes])
    return pa.table({
        "g": t.column("g"), "bucket": t.column("bucket"),
        "bits": pa.array([np.packbits(hit[e - len(x) : e]).tobytes() for x, e in zip(hashes, ends, strict=True)], pa.binary()),
    })


def _intervals(drop: np.ndarray, row: np.ndarray, counts: np.ndarray) -> list[list[dict]]:
    """Maximal runs of dropped words of each row, as word positions."""
    out: list[list[dict]] = [[] for _ in counts]
    if not drop.any():
        return out
    begin = np.concatenate([[0], np.cumsum(counts)])
    d = drop.astype(np.int8)
    edge = np.concatenate([[True], row[1:] != row[:-1]])
    up = np.flatnonzero(drop & (edge | (np.concatenate([[0], d[:-1]]) == 0)))
    down = np.flatnonzero(drop & (np.append(edge[1:], True) | (np.append(d[1:], 0) == 0)))
    for a, b in zip(up.tolist(), down.tolist(), strict=True):
        r = int(row[a])
        out[r].append({"start": int(a - begin[r]), "end": int(b + 1 - begin[r])})
    return out


def _apply(width: int, buckets: int, texts: bool):
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept_text": pa.string()}

    def apply(key, t, bits):
        c = _Chunk(t, width, buckets)
        w, flag = c.words, np.zeros(len(c.hash), bool)
        have = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True))
        for k, a, b in c.blobs():
            flag[a:b] = np.unpackbits(np.frombuffer(have[k], np.uint8), count=b - a).astype(bool)
        hit = c.at[flag[c.of] | (c.doc > c.least[c.of])] if len(c.at) else c.at
        step = np.zeros(len(w) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + width, -1)
        drop = np.cumsum(step[:-1]) > 0
        counts, gone = w.counts(), np.bincount(w.row[drop], minlength=w.rows)
        data, at = joined(w, ~drop)
        raw = data.tobytes()
        kept = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table({
            "doc_id": c.table.column("doc_id"), "n_words": pa.array(counts), "n_removed": pa.array(gone),
            "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
            "removed": pa.array(_intervals(drop, w.row, counts), kinds["removed"]),
            "kept_text": pa.array([x.decode() for x in kept] if texts else [None] * len(kept), pa.string()),
        }).cast(pa.schema(list(kinds.items())))

    return apply


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH, texts: bool = True) -> DataFrame:
    """One row per document: its words, the intervals removed, and (``texts``) the words kept, joined by spaces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = sizes(total)
    dealt = rows.withColumn("g", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(chunks)))
    sent = dealt.groupBy("g").applyInArrow(_emit(width, buckets), "g long, bucket long, hashes binary, more binary, docs binary")
    bits = sent.groupBy("bucket").applyInArrow(_bucket, "g long, bucket long, bits binary")
    return dealt.groupBy("g").cogroup(bits.groupBy("g")).applyInArrow(_apply(width, buckets, texts), OUT)
