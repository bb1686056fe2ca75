"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: words of the text with A-Z lowered, shingles of ``SHINGLE`` words joined by a space (a shorter text gives one
shingle of all its words, a text without words the fingerprint zero), XXH64 with seed 42 of each; a bit is set if more
than half of the shingles' hashes have it.

Every distinct fingerprint emits all variants within half the radius: at radius 4 the 2,081 values that differ from it in at
most two of 64 bits. Two fingerprints within the radius share a variant, the one halfway; and two that share a variant are
within the radius, as each is within half of it. So a shared variant is a link, verified by its full 64 bits, and of all that
share one it is enough to link each with one of them: groups of any size give no pairs of all members.

Most fingerprints have no link, and their balls need not be made. The 64 bits are cut into blocks, more than the radius: two
fingerprints within it agree in all blocks but as many, so each hashes its bits outside of every such choice of blocks, 70 keys for 8 blocks
against 2,081 variants. A fingerprint none of whose keys another one has is left out; the more fingerprints there are, the more blocks,
so that few keys meet by chance. The others emit their balls.

Variants are many and nearly all stand alone, so they (and the keys of blocks before them) are not shuffled as rows. Fingerprints are dealt into chunks. A
chunk hashes its variants to places, sorts them, and sends each bucket of places the differences as packed bytes, two or
three a variant. A bucket finds the places that several chunks have and sends each chunk those of its own. The chunk, dealt
the same way again, makes its variants a second time and keeps those at such places: it links its own members that share
one, and sends each shared variant, once, with one member of the group it links, to a bucket that links groups across
chunks by equal variants. Places that meet by chance fall out there. All chunks and buckets are of bounded size, dealt by hashes of
distinct fingerprints, and can be made again when an executor is lost. Components follow in ``graph``.

Defined cases: a null text has no words. Rows with a null ``doc_id`` take part in no link and are returned with a null
component. Rows with the same id share the component of the least id among their links. Other columns are ignored by
``near_duplicates`` and kept by ``keep_one``. Empty in, empty out.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, pairwise
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import temporary, written
from .graph import components
from .tokens import U64, Words, column_bytes, joined, mix, slices, words

SHINGLE, RADIUS = 4, 4
#: Variants of a chunk, and places of a bucket that are taken, at most about; places for each variant.
VARIANTS, ROOM = 8_000_000, 32
#: Places for each key of blocks; what is met there by chance isn't looked at again, so there is more room. Of the fingerprints, at most about one in CHANCE has a key by chance.
KEY_ROOM, CHANCE = 1 << 14, 64
MOST_TASKS = 10_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For each byte value, its eight bits as eight byte lanes, first bit highest.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def _hashes(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each row's shingles, and each row's number of them."""
    data, _ = joined(w)
    size = w.ends - w.starts
    new = np.ones(len(w), bool)
    new[1:] = w.row[1:] != w.row[:-1]
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)]) if len(w) else np.zeros(0, np.int64)
    start = start - (np.cumsum(new) - 1)  # no space stands between two rows
    end = start + size
    counts = w.counts()
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(w.rows), shingles)
    base = np.concatenate([[0], np.cumsum(shingles)[:-1]])
    at = first[row] + np.arange(len(row)) - base[row]
    last = np.minimum(at + width, first[row] + counts[row]) - 1
    raw, hash64 = data.tobytes(), xxhash.xxh64_intdigest
    out = [hash64(raw[a:b], 42) for a, b in zip(start[at].tolist(), end[last].tolist(), strict=True)]
    return np.array(out, dtype=U64), shingles


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprint of each row, whose ``n`` hashes stand in ``h`` one row after the other; zero for none."""
    out = np.zeros(len(n), U64)
    if not len(h):
        return out
    lanes = _LANES[h.astype(">u8").view(np.uint8).reshape(-1, 8)]  # a byte lane holds up to 255 ones
    begin = np.concatenate([[0], np.cumsum(n)])
    cuts = np.unique(np.concatenate([np.arange(0, len(h), 255), begin[:-1][n > 0]]))
    part = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64).astype(np.int64)
    some = np.flatnonzero(n > 0)
    ones = np.add.reduceat(part, np.searchsorted(cuts, begin[some]), axis=0)
    out[some] = np.packbits(2 * ones > n[some][:, None], axis=1).view(">u8").ravel().astype(U64)
    return out


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, U64)
    for a, b in slices(offsets):
        h, n = _hashes(words(_LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]), width)
        if not len(h):
            continue
        out[a:b] = majority(h, n)
    return out


def _fingerprint_batches(width: int):
    def run(batches):
        for t in batches:
            fp = fingerprints_of(*column_bytes(t.column("text")), width)
            yield pa.record_batch([t.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches(width), "doc_id long, fp long")


@lru_cache(maxsize=4)
def ball(radius: int) -> np.ndarray:
    """The 64-bit masks with at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)], U64)


def packed(places: np.ndarray, start: int) -> bytes:
    """Sorted distinct places from ``start`` on as differences, each in as many bytes as the largest needs; one byte tells how many."""
    if not len(places):
        return b""
    steps = np.diff(places, prepend=U64(start))
    size = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([size]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpacked(blob: bytes, start: int) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    raw = np.frombuffer(blob, np.uint8)
    size = int(raw[0])
    steps = np.zeros(((len(raw) - 1) // size, 8), np.uint8)
    steps[:, :size] = raw[1:].reshape(-1, size)
    return np.cumsum(steps.view("<u8").ravel().astype(U64), dtype=U64) + U64(start)


class Sieve:
    """Membership in a sorted array of places; most that aren't in it are told by one look-up."""

    BITS = 22

    def __init__(self, places: np.ndarray):
        self.places, self.maybe = places, np.zeros(1 << self.BITS, bool)
        self.maybe[(places & U64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """Indexes of the elements of ``x`` that are in."""
        if not len(self.places):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(x & U64((1 << self.BITS) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.places, x[at]), len(self.places) - 1)
        return at[self.places[k] == x[at]]


def _starts(x: np.ndarray) -> np.ndarray:
    """Whether each element of a sorted array differs from the one before."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of ``n`` nodes, for edges a[k] - b[k]."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label != (up := label[label])).any():
            label = up
        live = label[a] != label[b]
        a, b = label[a[live]], label[b[live]]
    return label


class Places:
    """How keys map to places, ``room`` of them for each, and places to buckets, for ``keys`` of them in all and about ``most`` in a chunk or bucket."""

    def __init__(self, keys: int, most: int, room: int = ROOM):
        self.bits = min(63, max(8, int(keys * room).bit_length()))
        self.chunks = max(1, -(-keys // most))
        self.span = -(-(1 << self.bits) // self.chunks)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys) >> U64(64 - self.bits)

    def buckets(self, places: np.ndarray):
        """(bucket, begin, end) of the buckets that sorted places fall in."""
        if not len(places):
            return
        low, high = int(places[0]) // self.span, int(places[-1]) // self.span
        # only the buckets' edges are looked up: no array as long as the places
        edges = np.searchsorted(places, np.arange(low, high + 2, dtype=U64) * U64(self.span))
        for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            yield low + k, int(edges[k]), int(edges[k + 1])


class Layout(Places):
    """The places of the variants of ``distinct`` fingerprints."""

    def __init__(self, distinct: int, radius: int, variants: int):
        self.half = radius // 2
        super().__init__(distinct * len(ball(self.half)), variants)


def sent(g: int, places: np.ndarray, layout: Places) -> pa.Table:
    """The places of a chunk for each bucket, once each, and those among them that stand there more than once."""
    places.sort()
    new = _starts(places)
    again = places[~new]
    again, places = again[_starts(again)], places[new]
    rows = []
    for bucket, a, b in layout.buckets(places):
        start = bucket * layout.span
        i, j = np.searchsorted(again, [start, start + layout.span])
        rows.append((bucket, packed(places[a:b], start), packed(again[i:j], start)))
    return pa.table({
        "g": pa.array([g] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int64()),
        "places": pa.array([r[1] for r in rows], pa.binary()), "again": pa.array([r[2] for r in rows], pa.binary()),
    })


def meet(layout: Places):
    """The places of a bucket that several chunks have, for each chunk those of its own."""

    def run(key, t):
        start = key[0].as_py() * layout.span
        each = [unpacked(x.as_py(), start) for x in t.column("places")]
        every = np.concatenate(each)
        every.sort()
        twice = every[~_starts(every)]
        sieve = Sieve(twice[_starts(twice)])
        return pa.table({
            "g": t.column("g"), "bucket": t.column("bucket"), "again": t.column("again"),
            "shared": pa.array([packed(x[sieve.find(x)], start) for x in each], pa.binary()),
        })

    return run


def held_elsewhere(met: pa.Table, layout: Places) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk's answers from all buckets: its places that other chunks have, and those it has more than once."""
    rows = sorted(zip(*(met.column(c).to_pylist() for c in ("bucket", "shared", "again")), strict=True))
    return tuple(np.concatenate([np.zeros(0, U64), *(unpacked(r[k], r[0] * layout.span) for r in rows)]) for k in (1, 2))


SENT, ANSWER = "g long, bucket long, places binary, again binary", "g long, bucket long, again binary, shared binary"


#: Keys of a fingerprint: for each, the bits that are taken and those that are flipped then.
Keys = tuple[np.ndarray, np.ndarray]


def _emit(layout: Places, keys: Keys):
    """All keys of a chunk."""

    def emit(key, t):
        fp = t.column("fp").to_numpy().view(U64)
        n = len(fp)
        places = np.empty(n * len(keys[0]), U64)
        for k, (taken, flipped) in enumerate(zip(*keys, strict=True)):
            places[k * n : (k + 1) * n] = layout.places((fp & taken) ^ flipped)
        return sent(key[0].as_py(), places, layout)

    return emit


def _variants(half: int) -> Keys:
    return np.full(len(ball(half)), ~U64(0)), ball(half)


def _block_keys(radius: int, distinct: int) -> Keys | None:
    """The bits outside of each choice of ``radius`` blocks, told apart by a salt. None if balls are no larger."""
    for blocks in range(radius + 4, 33):
        kinds = comb(blocks, radius)
        if kinds >= len(ball(radius // 2)) and radius:
            return None
        edges = [64 * k // blocks for k in range(blocks + 1)]
        parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in pairwise(edges)]
        masks = [~sum(parts[k] for k in left) & (2**64 - 1) for left in combinations(range(blocks), radius)]
        if CHANCE * distinct * sum(2.0 ** -m.bit_count() for m in masks) <= 1:
            return np.array(masks, U64), mix(np.arange(1, kinds + 1, dtype=U64))
    return None


def _accompanied(layout: Places, keys: Keys):
    """The fingerprints of a chunk of whose keys one or more are met at their places."""

    def run(key, t, met):
        fp = t.column("fp").to_numpy().view(U64)
        sieve, some = Sieve(np.union1d(*held_elsewhere(met, layout))), np.zeros(len(fp), bool)
        for taken, flipped in zip(*keys, strict=True):
            some[sieve.find(layout.places((fp & taken) ^ flipped))] = True
        return pa.table({"fp": fp[some].view(np.int64)})

    return run


def _dealt(distinct: DataFrame, layout: Places) -> DataFrame:
    dealt = distinct.select("fp", F.pmod(F.xxhash64("fp"), F.lit(layout.chunks)).alias("g"))
    # eight bytes a fingerprint look like nothing, but each stands for its whole ball: a task takes few chunks
    return dealt.repartition(min(layout.chunks, MOST_TASKS), "g")


def _met(dealt: DataFrame, layout: Places, keys: Keys) -> DataFrame:
    return dealt.groupBy("g").applyInArrow(_emit(layout, keys), SENT).groupBy("bucket").applyInArrow(meet(layout), ANSWER)


def accompanied(distinct: DataFrame, radius: int = RADIUS, most: int = VARIANTS) -> DataFrame:
    """The distinct fingerprints ``fp`` that have another one within ``radius`` bits, and few others."""
    n = distinct.count()
    keys = _block_keys(radius, n)
    if keys is None:
        return distinct.select("fp")
    layout = Places(n * len(keys[0]), most, KEY_ROOM)
    dealt = _dealt(distinct, layout)
    return dealt.groupBy("g").cogroup(_met(dealt, layout, keys).groupBy("g")).applyInArrow(_accompanied(layout, keys), "fp long")


MET = "bucket long, a long, b long, variants binary, members binary, which binary"


def _link(layout: Layout):
    """Links within a chunk (bucket null), and its shared variants with one member of each linked group."""
    kinds = pa.schema([("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("variants", pa.binary()), ("members", pa.binary()), ("which", pa.binary())])

    def link(key, t, met):
        if not t.num_rows or not met.num_rows:
            return kinds.empty_table()
        fp = np.sort(t.column("fp").to_numpy().view(U64))
        shared, again = held_elsewhere(met, layout)
        sieve = Sieve(np.union1d(shared, again))
        variant, who = [], []
        for m in ball(layout.half):
            v = fp ^ m
            at = sieve.find(layout.places(v))
            variant.append(v[at])
            who.append(at)
        variant, who = np.concatenate(variant), np.concatenate(who)
        order = np.lexsort((who, variant))
        variant, who = variant[order], who[order]
        new = _starts(variant)
        first = who[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(who) else who
        pairs = np.unique(first[~new] * len(fp) + who[~new])
        label = _labels(len(fp), pairs // len(fp), pairs % len(fp))
        moved = np.flatnonzero(label != np.arange(len(fp)))
        out = [(None, int(a), int(b), None, None, None) for a, b in zip(fp[label[moved]].view(np.int64), fp[moved].view(np.int64), strict=True)]
        variant, member = variant[new], fp[label[who[new]]]
        places = layout.places(variant)
        at = Sieve(shared).find(places)
        at = at[np.argsort(places[at], kind="stable")]
        variant, member, places = variant[at], member[at], places[at]
        for bucket, a, b in layout.buckets(places):
            members, which = np.unique(member[a:b], return_inverse=True)
            out.append((bucket, None, None, variant[a:b].astype("<u8").tobytes(), members.astype("<u8").tobytes(), which.astype("<u4").tobytes()))
        return pa.table([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds) if out else kinds.empty_table()

    return link


def _across(key, t):
    """Links between members of different chunks that hold the same variant, one member of each with the others."""
    variant = np.concatenate([np.frombuffer(x, "<u8") for x in t.column("variants").to_pylist()]).astype(U64)
    member = np.concatenate([np.frombuffer(m, "<u8")[np.frombuffer(w, "<u4")] for m, w in zip(t.column("members").to_pylist(), t.column("which").to_pylist(), strict=True)]).astype(U64)
    order = np.lexsort((member, variant))
    variant, member = variant[order], member[order]
    new = _starts(variant)
    first = member[np.flatnonzero(new)[np.cumsum(new) - 1]]
    a, b = first[~new], member[~new]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    some = _starts(a) | _starts(b)
    return pa.table({"a": a[some].view(np.int64), "b": b[some].view(np.int64)})


def links(distinct: DataFrame, radius: int = RADIUS, variants: int = VARIANTS) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp`` whose components are those of all pairs within ``radius`` bits (even)."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: each fingerprint has half of it")
    some = written(accompanied(distinct, radius, variants), "accompanied")
    layout = Layout(some.count(), radius, variants)
    dealt = _dealt(some, layout)
    met = _met(dealt, layout, _variants(layout.half))
    held = dealt.groupBy("g").cogroup(met.groupBy("g")).applyInArrow(_link(layout), MET)
    held = written(held, "shared-variants")
    across = held.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(_across, "a long, b long")
    return held.where("bucket IS NULL").select("a", "b").unionByName(across)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``."""
    with temporary(docs.sparkSession, "simhash"):
        fp = written(fingerprints(docs, width), "fingerprints", outside=True)
        distinct = written(fp.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        named = components(links(distinct, radius))
        placed = distinct.join(named.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        placed = written(placed, "placed")
        least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
        by_fp = written(placed.join(least, "root").select("fp", "component_id"), "fingerprint-components", outside=True)
    return fp.join(by_fp, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` but for those whose id has a link to a component with a smaller id.

    Texts without words are one component like any other. Of equal rows (id and text) one stays; rows with a null id stay.
    """
    found = near_duplicates(docs, width, radius).where("component_id < doc_id")
    rest = docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    known = rest.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return known.unionByName(rest.where("doc_id IS NULL"))
