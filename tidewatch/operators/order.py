"""Exact percentiles over moving spans of time: for each query, of the values that are active at its moment.

A value is active from when it enters until it leaves. Within a group, all queries are answered together by a merge tree over the
ranks of the values: events (a value enters, +1, or leaves, -1) lie in order of time, and each level of the tree sorts them
stably by one bit of their rank and keeps running counts of those with a 0. A query for the k-th smallest goes down the levels: if more
than k active values have a 0, it goes there, else it takes them off its k. That is n log n for a group, however long the spans are. Small groups are answered many at a time.

Groups of more than ``HOT`` events are narrowed first, without any task that holds them: values become 64-bit codes in their
order, which are taken by ``DIGIT`` bits at a time. A group's time is cut into slices; a small table has, for each slice and digit, how
many values with it are active when the slice begins. Within its slice, each query learns the digit of its answer and its k among
the values with that digit, which are its next group. So a hot account is as many tasks as it needs: slices of time first, narrow ranges of
values then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.tables import written

#: Events of a group, at most about; bits of the codes that a narrowing takes.
HOT, DIGIT = 2_000_000, 12
#: Later than any moment.
NEVER = 2**62
_TIMES = ("t_in", "u_in", "t_out", "u_out")


def kth(group: np.ndarray, at: np.ndarray, then: np.ndarray, weight: np.ndarray, rank: np.ndarray, q_group: np.ndarray, q_at: np.ndarray, q_then: np.ndarray, k) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the k-th smallest active values of their group and k among those of that rank, for queries at moments (q_at, q_then).

    Events are (group, at, then, weight, rank) in any order; ``k`` is an array or a function of the numbers of active values."""
    n, m = len(at), len(q_at)
    both = lambda a, b: np.concatenate([a, b])
    groups = both(group, q_group)
    order = np.lexsort((both(np.zeros(n), np.ones(m)), both(then, q_then), both(at, q_at), groups))
    event = order < n
    place = np.empty(m, np.int64)
    place[order[~event] - n] = np.cumsum(event)[~event]
    own = order[event]
    r, w = rank[own], weight[own]
    first, last, found = np.searchsorted(group[own], q_group), place, np.zeros(m, np.int64)
    if callable(k):
        active = np.concatenate([[0], np.cumsum(w)])
        k = k(active[last] - active[first])
    else:
        k = k.copy()
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        one = (r >> bit) & 1
        zeros, active = (np.concatenate([[0], np.cumsum(x)]) for x in (1 - one, w * (1 - one)))
        there = active[last] - active[first]
        left = k < there
        k = np.where(left, k, k - there)
        found = found << 1 | ~left
        first, last = (np.where(left, zeros[x], zeros[n] + x - zeros[x]) for x in (first, last))
        keep = np.argsort(one, kind="stable")
        r, w = r[keep], w[keep]
    return found, k


def _group_numbers(groups: list[str], *tables: pa.Table) -> list[np.ndarray]:
    """For each row of the tables the number of its group; equal keys, nulls too, have the same in all of them."""
    sizes = [t.num_rows for t in tables]
    out = np.zeros(sum(sizes), np.int64)
    for g in groups:
        values = pa.chunked_array([c for t in tables for c in t.column(g).chunks], tables[0].schema.field(g).type)
        codes = pc.fill_null(values.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(values) else out
        out = np.unique(out * (codes.max(initial=0) + 2) + codes + 1, return_inverse=True)[1]
    return np.split(out, np.cumsum(sizes)[:-1])


def _events(t: pa.Table, group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Events (group, at, then, weight, value) of members: each value enters, and leaves unless that is never."""
    t_in, u_in, t_out, u_out = (t.column(c).to_numpy() for c in _TIMES)
    goes = t_out < NEVER
    join = lambda a, b: np.concatenate([a, b[goes]])
    return join(group, group), join(t_in, t_out), join(u_in, u_out), join(np.ones(len(t_in), np.int64), -np.ones(len(t_in), np.int64)), join(value, value)


def _interpolated(low: np.ndarray, high: np.ndarray, share: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.where(low == high, low, low + (high - low) * share)


def _utc(kind: pa.DataType) -> pa.DataType:
    """The type with UTC as its zone: Arrow tables come in the session's, and must go back in UTC. The moments stay."""
    if pa.types.is_timestamp(kind) and kind.tz is not None:
        return pa.timestamp(kind.unit, "UTC")
    if pa.types.is_struct(kind):
        return pa.struct([f.with_type(_utc(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(kind.value_field.with_type(_utc(kind.value_type)))
    return kind


def _solved(q: float, groups: list[str], names: list[str], name: str):
    """Adds the percentile to the rows of several groups."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        out = queries.select(names)
        out = out.cast(pa.schema([f.with_type(_utc(f.type)) for f in out.schema]))
        t, u = (queries.column(c).to_numpy() for c in ("_q_t", "_q_u"))
        values, rank = np.unique(members.column("v").to_numpy(), return_inverse=True)
        answer = np.full(len(t), np.nan)
        none = np.ones(len(t), bool)
        if len(values) and len(t):
            asked, own = _group_numbers(groups, queries, members)
            events = _events(members, own, rank)
            count: list[np.ndarray] = []
            both = []
            for side in (np.floor, np.ceil):
                rank_of = lambda n, side=side: (count.append(n), side(q * np.maximum(n - 1, 0)).astype(np.int64))[1]
                both.append(values[kth(*events, asked, t, u, rank_of)[0].clip(0, len(values) - 1)])
            place = q * np.maximum(count[0] - 1, 0)
            answer, none = _interpolated(*both, place - np.floor(place)), count[0] == 0
        return out.append_column(name, pa.array(answer, pa.float64(), mask=none))

    return run


def codes(v: np.ndarray) -> np.ndarray:
    """64-bit codes, unsigned, in the order of doubles; NaN last, both zeros the same."""
    v = np.where(np.isnan(v), np.nan, v + 0.0)
    bits = v.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def values_of(c: np.ndarray) -> np.ndarray:
    return np.where(c >> np.uint64(63), c & np.uint64((1 << 63) - 1), ~c).view(np.float64)


def _with_codes(batches):
    for t in batches:
        c = codes(t.column("v").to_numpy(zero_copy_only=False))
        yield t.append_column("code", pa.array(c.view(np.int64)))


_LEVELS = -(-64 // DIGIT)


def _shift(level: int) -> int:
    """Bits below the digit of a level; the last digit has what is left of the 64."""
    return max(64 - DIGIT * (level + 1), 0)


def _digit(level: int) -> Column:
    bits = min(DIGIT, 64 - DIGIT * level)
    return F.shiftrightunsigned(F.col("code"), _shift(level)).bitwiseAND((1 << bits) - 1)


_QUERY = {"id": pa.int64(), "side": pa.int32(), "q_t": pa.int64(), "q_u": pa.int64(), "k": pa.int64(), "share": pa.float64()}
_QUERY_DDL = "id long, side int, q_t long, q_u long, k long, share double"


def _narrow(q: float):
    """A slice's queries with the digit of their answers. Where k is null, it and the share are worked out from the number of
    active values; queries without any go."""

    def run(queries: pa.Table, events: pa.Table) -> pa.Table:
        side, t, u = (queries.column(c).to_numpy() for c in ("side", "q_t", "q_u"))
        at, then, w, digit = (events.column(c).to_numpy() for c in ("t", "u", "w", "digit"))
        values, rank = np.unique(digit, return_inverse=True)
        ids, share, total = queries.column("id").to_numpy(), np.zeros(len(t)), np.ones(len(t))
        if not len(values) or not len(ids):
            return pa.table({c: pa.array([], k) for c, k in (_QUERY | {"digit": pa.int64()}).items()})
        k, one = queries.column("k"), (np.zeros(len(at), np.int64), at, then, w, rank, np.zeros(len(t), np.int64), t, u)
        if k.null_count:

            def wanted(n):
                nonlocal share, total
                place = q * np.maximum(n - 1, 0)
                share, total = place - np.floor(place), n
                return np.where(side == 0, np.floor(place), np.ceil(place)).astype(np.int64)

            found, k = kth(*one, wanted)
        else:
            share = queries.column("share").to_numpy()
            found, k = kth(*one, k.to_numpy())
        columns = (ids, side, t, u, k, share, values[found.clip(0, len(values) - 1)])
        return pa.table({c: pa.array(x[total > 0], kind) for (c, kind), x in zip((_QUERY | {"digit": pa.int64()}).items(), columns, strict=True)})

    return run


def _keyed(f, keys: list[str]):
    """A function of a group that puts the group's key before what it returns."""

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        out = f(a, b)
        for i, (name, value) in enumerate(zip(keys, key, strict=True)):
            out = out.add_column(i, name, pa.array([value.as_py()] * out.num_rows, value.type))
        return out

    return run


_ANSWER = "id long, side int, share double, v double"


def _answers(members: DataFrame, queries: DataFrame, keys: list[str], q: float, hot: int) -> DataFrame:
    """(id, side, share, v) of ``queries`` (keys, id, q_t, q_u) in hot groups: the values whose ranks enclose the percentile."""
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in members.select(keys).schema]
    out = members.sparkSession.createDataFrame([], _ANSWER)
    members = written(members.mapInArrow(_with_codes, T.StructType([*members.schema.fields, T.StructField("code", T.LongType())])), "order-members")
    queries = queries.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"k": F.lit(None).cast("long"), "share": F.lit(None).cast("double")})
    node = list(keys)
    for level in range(_LEVELS):
        members = members.withColumn("digit", _digit(level))
        sizes = members.groupBy(*node).agg(F.count(F.lit(1)).alias("_n"), F.min("t_in").alias("_t0"), F.max("t_in").alias("_t1"))
        sizes = sizes.withColumn("_parts", F.ceil(F.lit(4) * F.col("_n") / hot).cast("long"))
        sizes = written(sizes, "order-sizes")
        clip = lambda t: F.floor((F.greatest(F.least(t, "_t1"), "_t0") - F.col("_t0")) * F.col("_parts") / (F.col("_t1") - F.col("_t0") + 1)).cast("long")
        own = [f"_{c}" for c in node]
        known = sizes.select(*(F.col(c).alias(o) for c, o in zip(node, own, strict=True)), "_t0", "_t1", "_parts")
        match = lambda x: [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(node, own, strict=True)]
        sized = lambda x: x.join(known, match(x)).drop(*own)
        moves = F.array(F.struct(F.col("t_in").alias("t"), F.col("u_in").alias("u"), F.lit(1).cast("long").alias("w")), F.struct(F.col("t_out").alias("t"), F.col("u_out").alias("u"), F.lit(-1).cast("long").alias("w")))
        events = members.select(*node, "digit", F.explode(moves).alias("e")).select(*node, "digit", "e.*").where(F.col("t") < NEVER)
        events = sized(events).withColumn("slice", clip("t")).drop("_t0", "_t1", "_parts")
        totals = events.groupBy(*node, "digit", "slice").agg(F.sum("w").alias("w"))
        grid = sized(members.select(*node, "digit").distinct()).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).select(*node, "digit", "slice")
        both = grid.withColumn("w", F.lit(0).cast("long")).unionByName(totals).groupBy(*node, "digit", "slice").agg(F.sum("w").alias("w"))
        before = Window.partitionBy(*node, "digit").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        carry = both.select(*node, "digit", "slice", F.lit(-NEVER).alias("t"), F.lit(0).cast("long").alias("u"), F.sum("w").over(before).alias("w")).where("w <> 0")
        groups = [*node, "slice"]
        asked = sized(queries).withColumn("slice", clip("q_t")).drop("_t0", "_t1", "_parts")
        schema = ", ".join([*types, *(["node long"] if level else []), "slice long", _QUERY_DDL, "digit long"])
        found = asked.groupBy(*groups).cogroup(events.unionByName(carry).groupBy(*groups)).applyInArrow(_keyed(_narrow(q), groups), schema)
        # a group is what its codes have in common
        next_node = F.shiftleft("digit", _shift(level)).bitwiseOR(F.col("node") if level else F.lit(0).cast("long"))
        queries = written(found.withColumn("node", next_node).drop("digit", "slice"), "order-queries")
        members = members.withColumn("node", next_node).drop("digit")
        node = [*keys, "node"]
        # groups of a single value are answered; small ones are solved whole; the others are narrowed again
        spread = written(members.groupBy(*node).agg(F.count(F.lit(1)).alias("_n"), F.min("code").alias("_lo"), F.max("code").alias("_hi")).withColumn("_single", F.col("_lo") == F.col("_hi")), "order-groups")
        name = [F.col(c).alias(f"_{c}") for c in node]
        one = spread.where("_single").select(*name, "_lo")
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in node]
        single = queries.join(one, on).select("id", "side", "share", F.col("_lo").alias("code"))
        out = out.unionByName(single.mapInArrow(_decoded, _ANSWER))
        small = spread.where(~F.col("_single") & (F.col("_n") <= hot)).select(*name)
        dealt = _bucket(node, members.count(), hot)
        a, b = (x.join(small, on, "left_semi").withColumn("_bucket", dealt).groupBy("_bucket") for x in (queries, members))
        out = out.unionByName(a.cogroup(b).applyInArrow(_last(node), _ANSWER))
        large = spread.where(~F.col("_single") & (F.col("_n") > hot)).select(*name)
        if large.isEmpty():
            break
        queries, members = queries.join(large, on, "left_semi"), written(members.join(large, on, "left_semi"), "order-members")
    return out


def _decoded(batches):
    for t in batches:
        yield pa.RecordBatch.from_arrays([t.column("id"), t.column("side"), t.column("share"), pa.array(values_of(t.column("code").to_numpy().view(np.uint64)))], ["id", "side", "share", "v"])


def _last(groups: list[str]):
    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        values, rank = np.unique(members.column("v").to_numpy(), return_inverse=True)
        t, u, k = (queries.column(c).to_numpy() for c in ("q_t", "q_u", "k"))
        if len(t):  # their k came from the members of their group
            asked, own = _group_numbers(groups, queries, members)
            values = values[kth(*_events(members, own, rank), asked, t, u, k)[0]]
        return pa.table({**{c: queries.column(c) for c in ("id", "side", "share")}, "v": pa.array(values if len(t) else [], pa.float64())})

    return run


def _bucket(groups: list[str], rows: int, hot: int) -> Column:
    """Groups are dealt to buckets of a small fraction of ``hot`` rows on average: one call each, however small groups are. A bucket is held by a
    Python worker as a whole, with its rows' columns and working arrays, so it stays as small as calls cost little."""
    return F.pmod(F.xxhash64(*groups), F.lit(max(64, -(-64 * rows // hot))))


def sliding_percentile(rows: DataFrame, keys: list[str], name: str, q: float, value: Column, enter: tuple[Column, Column], leave: tuple[Column, Column], moment: tuple[Column, Column], piece: int | None = None, hot: int = HOT) -> DataFrame:
    """``rows`` with ``name``: the interpolated percentile ``q`` of the values of the rows with equal ``keys`` that are active at the row's ``moment``.

    Moments are pairs of longs, compared one after the other: a row's value is active at m if enter <= m < leave. Rows with a null or
    without a time lend no value; without active values the percentile is null. ``piece``: seconds, no fewer than any value stays; the
    time of a key is then cut into pieces that long, each a group.
    """
    names = rows.columns
    x = rows.withColumns({"_q_t": moment[0], "_q_u": moment[1], "_v": value.cast("double"), "_t_in": enter[0], "_u_in": enter[1], "_t_out": leave[0], "_u_out": leave[1]})
    of = [F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)]
    groups = [f"_g{i}" for i in range(len(keys))]
    members = x.where("_v IS NOT NULL AND _t_in IS NOT NULL").select(*of, *(F.col(f"_{c}").alias(c) for c in ("v", *_TIMES)))
    queries = x.select(*names, *of, F.coalesce("_q_t", F.lit(-NEVER)).alias("_q_t"), "_q_u")
    if piece:
        at = lambda c: F.floor(c / piece).cast("long")
        members = members.withColumn("_piece", F.explode(F.array_distinct(F.array(at(F.col("t_in")), at(F.col("t_out") - 1)))))
        queries = queries.withColumn("_piece", at(F.col("_q_t")))
        groups = [*groups, "_piece"]
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    sizes = members.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    rows_, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    dealt = _bucket(groups, rows_, hot)
    solve = lambda a, m: a.withColumn("_bucket", dealt).groupBy("_bucket").cogroup(m.withColumn("_bucket", dealt).groupBy("_bucket")).applyInArrow(_solved(q, groups, names, name), schema)
    if most <= hot:
        return solve(queries, members)
    large = sizes.where(F.col("_n") > hot).select(*(F.col(c).alias(f"{c}_") for c in groups))
    large = F.broadcast(written(large, "order-hot"))  # rows / hot at most
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in groups]
    cold = solve(queries.join(large, on, "left_anti"), members.join(large, on, "left_anti"))
    mine = written(queries.join(large, on, "left_semi").withColumn("_id", F.monotonically_increasing_id()), "order-rows")
    found = _answers(members.join(large, on, "left_semi"), mine.select(*groups, F.col("_id").alias("id"), F.col("_q_t").alias("q_t"), F.col("_q_u").alias("q_u")), groups, q, hot)
    each = found.groupBy(F.col("id").alias("_found")).agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("_low"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("_high"), F.max("share").alias("_share"))
    middle = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share"))
    return cold.unionByName(mine.join(each, F.col("_id") == F.col("_found"), "left").select(*names, middle.alias(name)))
