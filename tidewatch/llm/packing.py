"""Best-two-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

A document is its token ids and a separator id. Only longer ones are cut, into full pieces; the first piece may be shorter.

Best-two-fit fills one sequence at a time: the longest piece left, then again and again the longest that fits; then the
sequence's smallest piece goes back if two pieces left over fit its expanded gap more tightly. The decision depends on
lengths alone, and there are ``capacity`` of them at most, so the plan is made from the histogram of lengths: a pattern of
lengths is chosen by that rule and applied as often as the histogram allows (each application uses up some length). The
plan's size is bounded by ``capacity``, however many documents there are. Pieces then take places in the order of a rank
within their length, which is dealt over hashed buckets so that a length that a third of all pieces have is no hot key.

Defined cases: a null or empty text is the separator alone. Null and repeated ids are packed like any other row. No
documents give no rows. Other columns are ignored. A text that holds the vocabulary's special string gets its special id,
as the tokenizer does by default.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

CAPACITY, SEPARATOR = 2048, 0
VOCABULARY = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Documents that are encoded at a time.
_BATCH = 256


@lru_cache(maxsize=2)
def tokenizer(name: str):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name))


@lru_cache(maxsize=2)
def _fast(name: str):
    """The same vocabulary in tiktoken, several times faster, or None where it isn't given as ranks."""
    import os

    import public_tokenizers
    import tiktoken

    file = public_tokenizers.path(name).replace(".json", ".tiktoken")
    if not os.path.exists(file):
        return None
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Below U+3000 both libraries give the same ids (the tests go through all of these code points); other texts take the tokenizer itself.
_PLAIN = r"\A[\x{0}-\x{2FFF}]*\z"


def encode(texts: pa.Array, name: str = VOCABULARY) -> list[np.ndarray]:
    """Token ids of each text, as the tokenizer gives them with add_special_tokens=False."""
    texts = pc.fill_null(texts, "")
    out: list[np.ndarray | None] = [None] * len(texts)
    slow, quick = list(range(len(texts))), _fast(name)
    values = texts.to_pylist()
    if quick is not None:
        plain = pc.and_(pc.match_substring_regex(texts, _PLAIN), pc.invert(pc.match_substring(texts, "<|")))
        flags = plain.to_pylist()
        slow = [i for i in slow if not flags[i]]
        for i in (i for i, x in enumerate(flags) if x):
            out[i] = np.frombuffer(quick.encode_to_numpy(values[i], disallowed_special=()).tobytes(), "<u4")
    for a in range(0, len(slow), _BATCH):
        part = slow[a : a + _BATCH]
        for i, e in zip(part, tokenizer(name).encode_batch([values[i] for i in part], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4")
    return out


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def _piece_batches(capacity: int, separator: int, name: str):
    def run(batches):
        for t in batches:
            for a in range(0, t.num_rows, _BATCH):
                part = t.slice(a, _BATCH)
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text"), name), strict=True):
                    ids = np.append(ids, np.array([separator], "<u4"))
                    for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                        rows.append((doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
                yield pa.RecordBatch.from_arrays([
                    pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)
                ], ["doc_id", "piece", "start", "length", "ids_crc32"]) if rows else pa.RecordBatch.from_pylist([], _SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR, name: str = VOCABULARY) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_piece_batches(capacity, separator, name), PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, number of such sequences), for a histogram of lengths from 1 to ``capacity``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for k, v in counts.items():
        left[k] = v
    plan = []
    while left.any():
        own = np.zeros_like(left)
        gap, bin_ = capacity, []
        while gap:
            fits = np.flatnonzero(left[1 : gap + 1] > own[1 : gap + 1])
            if not len(fits):
                break
            size = int(fits[-1]) + 1
            own[size] += 1
            bin_.append(size)
            gap -= size
        if gap and len(bin_) > 1:
            small = bin_[-1]
            own[small] -= 1
            if (pair := _pair(left - own, small, small + gap)) is None:
                own[small] += 1
            else:
                bin_[-1:] = sorted(pair, reverse=True)
                for size in pair:
                    own[size] += 1
        used = np.flatnonzero(own)
        times = int((left[used] // own[used]).min())
        left[used] -= own[used] * times
        plan.append((bin_, times))
    return plan


def _pair(free: np.ndarray, more: int, most: int) -> tuple[int, int] | None:
    """Two free lengths whose sum is greatest in (more, most]; of equal sums that with the longest piece."""
    sizes = np.flatnonzero(free[: most + 1] > 0)
    if not len(sizes):
        return None
    at = np.searchsorted(sizes, most - sizes, side="right") - 1  # the longest partner of each
    ok = at >= 0
    at = np.where(ok & (sizes[at] == sizes) & (free[sizes] < 2), at - 1, at)
    ok &= at >= 0
    total = np.where(ok, sizes + sizes[at], 0)
    best = int(total.max())
    if best <= more:
        return None
    k = int(np.flatnonzero(total == best)[-1])
    return int(sizes[k]), int(sizes[at[k]])


def _places(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, pieces a sequence, first sequence, and the offsets, of each pattern that uses it."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for bin_, times in plan:
        at, where = 0, {}
        for size in bin_:
            where.setdefault(size, []).append(at)
            at += size
        for size, offsets in where.items():
            out.setdefault(size, []).append((taken.get(size, 0), len(offsets), sequence, np.array(offsets)))
            taken[size] = taken.get(size, 0) + times * len(offsets)
        sequence += times
    made = {}
    for size, rows in out.items():
        base = np.concatenate([[0], np.cumsum([r[1] for r in rows])[:-1]])
        made[size] = (*(np.array([r[k] for r in rows]) for k in range(3)), base, np.concatenate([r[3] for r in rows]))
    return made


def _place_batches(places: dict[int, tuple[np.ndarray, ...]]):
    def run(batches):
        for t in batches:
            length, rank = t.column("length").to_numpy(), t.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                first, each, begin, base, offsets = places[int(size)]
                rows = np.flatnonzero(length == size)
                k = np.searchsorted(first, rank[rows], side="right") - 1
                at = rank[rows] - first[k]
                seq[rows], off[rows] = begin[k] + at // each[k], offsets[base[k] + at % each[k]]
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in _SCHEMA.names), pa.array(seq), pa.array(off)], [*_SCHEMA.names, "sequence_id", "offset"])

    return run


def pack_pieces(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made``, a written table of pieces, with sequence_id and offset."""
    total = made.count()
    buckets = max(64, -(-total // 20_000))
    keyed = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = written(keyed.groupBy("length", "bucket").count(), "lengths")
    plan = best_two_fit({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = keyed.withColumn("nth", F.row_number().over(within)).join(first, ["length", "bucket"])
    ranked = ranked.select(*_SCHEMA.names, (F.col("first") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(_place_batches(_places(plan)), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR, name: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(written(pieces(docs, capacity, separator, name), "pieces"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR, name: str = VOCABULARY) -> DataFrame:
    """The sequences themselves: (sequence_id, tokens array<int>), for documents with unique ids."""

    def token_batches(batches):
        for t in batches:
            ids = [np.append(x, np.array([separator], "<u4")) for x in encode(t.column("text"), name)]
            cut = [x[s : s + n].astype(np.int32) for x, s, n in zip(ids, t.column("start").to_pylist(), t.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("sequence_id"), t.column("offset"), pa.array(cut, pa.list_(pa.int32()))], ["sequence_id", "offset", "tokens"])

    rows = docs.select("doc_id", "text").join(packed, "doc_id").select("text", "start", "length", "sequence_id", "offset")
    parts = rows.mapInArrow(token_batches, "sequence_id long, offset long, tokens array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "tokens")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["tokens"])).alias("tokens"))
