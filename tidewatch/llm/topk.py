"""Exact top-k search over integer vectors by block-at-a-time pruning.

Vectors are ordered by similarity (halved again and again along the direction in which they differ most) and cut into
blocks of neighbours in that order. A block keeps its forward index (a matrix) and, per term (dimension), its largest and
smallest value. For a query the sum of each term's best product bounds every score in a block; blocks are taken in falling
order of that bound and scored through their forward index until the bound falls below the query's k-th best score so
far. Ties go to the smaller id, so a block whose bound equals the k-th score is still scored. How many blocks are left
out depends on the vectors: on clustered ones most, on directions spread evenly over many dimensions none, and then
every block is scored (``skipped_share`` tells).

The stated queries meet all vectors in tiles: query groups times vector shards, each a task of bounded size, as rows are dealt
to shards and groups by a hash of id and vector (exact copies of a row stay together); each tile keeps k rows a query, and a window
merges them.

Defined cases: vectors that are null or hold a null or non-finite component, and rows with a null id, take no part, as candidate
or query. Vectors may differ in length: a component that one lacks counts as zero. Products are summed exactly, however large
the components; a score beyond 64 bits ranks by its true value, up to 38 digits (larger ones are equal), and is returned as
the nearest 64-bit one. A query never meets
rows with its own id; rows with the same id are candidates each. Fewer than k candidates: all of them. Other columns are
ignored. No queries or no vectors give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

K, EVERY, SCALE = 5, 50, 256
BLOCK, SHARD, GROUP = 256, 16_384, 2_048
_MOST = (1 << 63) - 1
#: Order of scores in Spark: whole doubles can't tell neighbours beyond 2 ** 53, decimals of 38 digits can.
RANKS = "decimal(38,0)"
_FAR = 10**38 - 1


def finite(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    bad = F.exists("x", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(True)))


def _floored(column: pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each row, zeros behind: doubles where they and all sums of products are exact, else Python integers."""
    values = column.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    size = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False)
    small = float(np.abs(flat).max(initial=0.0)) * scale < 2.0**45
    flat = np.floor(flat * float(scale)) if small else np.array([int(np.floor(v * scale)) if abs(v) < 2.0**500 else int(v) * scale for v in flat.tolist()], dtype=object)
    out = np.zeros((len(size), width), np.float64 if small else object)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def similar_order(m: np.ndarray, least: int) -> np.ndarray:
    """An order in which neighbours are alike: each part is halved along its main direction until it has ``least`` rows or fewer."""
    x = m if m.dtype != object else np.array([[float(max(-_FAR, min(_FAR, v))) for v in r] for r in m.tolist()], np.float64).reshape(m.shape)
    x = x / max(1.0, float(np.abs(x).max(initial=0.0)))
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= least:
            out.append(at)
            continue
        part = x[at] - x[at].mean(axis=0)
        v = part[int(np.argmax((part * part).sum(axis=1)))]
        for _ in range(6):  # a few power steps are near enough, the order changes no result
            v = part.T @ (part @ v)
            v = v / max(float(np.linalg.norm(v)), 1e-300)
        ranked = at[np.argsort(part @ v, kind="stable")]
        cut = len(ranked) // 2 // least * least or least
        todo += [ranked[cut:], ranked[:cut]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _search(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, block: int):
    """(scores, ids, real, share of query-block pairs left out) of each query's best k rows of ``m``."""
    order = similar_order(m, block)
    ids, m = ids[order], m[order]
    most = lambda x: int(max(abs(v) for v in (x.max(initial=0), x.min(initial=0)))) if x.size else 0
    exact = q.dtype != object and m.dtype != object and most(m) * most(q) * max(1, m.shape[1]) < 1 << 53
    m, q = (m, q) if exact else (np.array([[int(v) for v in r] for r in m.tolist()], object).reshape(m.shape), np.array([[int(v) for v in r] for r in q.tolist()], object).reshape(q.shape))
    none = -np.inf if exact else -_FAR - 1
    near = (lambda x: x) if exact else np.vectorize(lambda v: max(-_FAR, min(_FAR, v)), otypes=[object])
    cuts = range(0, len(ids), block)
    high = np.stack([m[a : a + block].max(axis=0) for a in cuts])
    low = np.stack([m[a : a + block].min(axis=0) for a in cuts])
    bound = near(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)
    best_s = np.full((len(q), k), none, np.float64 if exact else object)
    best_i = np.full((len(q), k), -1, dtype=np.int64)
    turn = np.argsort(-bound, axis=1, kind="stable")
    scored, rows = 0, np.arange(len(q))
    for step in range(turn.shape[1]):
        at = turn[:, step]
        live = bound[rows, at] >= best_s[:, -1]
        if not live.any():
            break  # bounds only fall from here
        scored += int(live.sum())
        for b in np.unique(at[live]):
            who = np.flatnonzero(live & (at == b))
            part = slice(b * block, min((b + 1) * block, len(ids)))
            s = near(q[who] @ m[part].T)
            s[qid[who][:, None] == ids[part][None, :]] = none
            every_s = np.concatenate([best_s[who], s], axis=1)
            every_i = np.concatenate([best_i[who], np.broadcast_to(ids[part], s.shape)], axis=1)
            if exact:
                pick = np.lexsort((every_i, -every_s), axis=1)[:, :k]
            else:
                pick = np.array([sorted(range(len(r)), key=lambda j, r=r, i=i: (-r[j], i[j]))[:k] for r, i in zip(every_s.tolist(), every_i.tolist(), strict=True)])
            best_s[who], best_i[who] = np.take_along_axis(every_s, pick, 1), np.take_along_axis(every_i, pick, 1)
    return best_s, best_i, (best_s > none).astype(bool), 1 - scored / max(1, bound.size)


def _tile(k: int, width: int, scale: int, block: int):
    def tile(key, queries, vectors):
        if not queries.num_rows or not vectors.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.decimal128(38, 0)), "skipped": pa.array([], pa.float64())})
        vectors = vectors.sort_by("vec_id")
        qid, q = queries.column("vec_id").to_numpy(), _floored(queries.column("x"), width, scale)
        s, i, real, skipped = _search(qid, q, vectors.column("vec_id").to_numpy(), _floored(vectors.column("x"), width, scale), k, block)
        scores = pa.array([int(x) for x in s[real]], pa.decimal128(38, 0))
        ids = np.repeat(qid, k).reshape(-1, k)[real]
        return pa.table({"query_id": ids, "vec_id": i[real], "score": scores, "skipped": np.full(len(ids), skipped)})

    return tile


def _met(vectors: DataFrame, queries: DataFrame, k: int, scale: int, block: int, shard: int, group: int) -> DataFrame:
    v, q = finite(vectors), finite(queries)
    n, width = v.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    asked, wide = q.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    shards, groups = max(1, -(-n // shard)), max(1, -(-asked // group))
    # dealt by a hash of id and vector: neither far ids nor those of several vectors make a shard large, and a row that is made again goes to the same one
    turn = lambda m: F.pmod(F.xxhash64("vec_id", "x"), F.lit(m))
    every = lambda m, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(name)
    left = q.withColumn("g", turn(groups)).select("g", every(shards, "s"), "vec_id", "x")
    right = v.withColumn("s", turn(shards)).select(every(groups, "g"), "s", "vec_id", "x")
    tile = _tile(k, max(width or 0, wide or 0), scale, block)
    return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(tile, f"query_id long, vec_id long, score {RANKS}, skipped double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = BLOCK, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows of ``vectors`` with the highest inner product."""
    met = _met(vectors, queries, k, scale, block, shard, group)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    fits = F.greatest(F.least("score", F.lit(_MOST).cast(RANKS)), F.lit(-_MOST).cast(RANKS)).cast("long")
    return best.select("query_id", "rank", "vec_id", fits.alias("score"))


def skipped_share(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = BLOCK, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """One row: the mean share of query-block pairs that the bounds left out."""
    return _met(vectors, queries, k, scale, block, shard, group).agg(F.avg("skipped").alias("skipped"))
