"""Line deduplication by a segment-partition edit join, with DataFrame functions only.

Lines within ``edits`` (two) edits of each other are found without comparing all pairs. A line is split into ``edits + 1``
segments of nearly equal length; of two lines that close, one segment of the shorter stands in the other unchanged, at
a position that the length difference and the edits left bound. So each distinct line sends its own segments to an index
by (length, segment number, text), and probes the indexes of its own and the shorter lengths with the substrings at
those positions. Keys that a single line has go. Lines that share a key are compared: first by a parity signature of
their characters, of which one edit flips two bits at most, then by banded bit-parallel edit distance (the band's
vertical differences in one integer, updated for each character by a few bit operations). Two lines may share several keys;
they are compared at the first of them only, so pairs need no deduplication and are summed up where they are found: neither
shuffled nor written.

A line is a copy if the same line, or one within the threshold, comes earlier: in a document with a smaller id or, in
the same document, above it. The first stays. Lines are trimmed of spaces, tabs and carriage returns; every line that
is not blank then is counted and has its row in ``line_classes``. Two edits make another line of a short one, so lines
under ``min_chars`` code points are linked by equality alone, and the edit join is on the others.

What ``drop_repeated_lines`` takes out of documents is a choice of its own: only lines of ``min_removed`` code points or more,
as short ones (a brace, a heading, "Yes.") repeat by chance and their text needs them.

Hot lines: lines are first counted with partial aggregation, by hash and without their texts; a line with more than
``OFTEN`` occurrences is made distinct, again combined before the shuffle, so one that a third of all documents hold is
one row in the join; one with more than ``SPLIT`` is dealt to as many tasks as it needs when its rows get their class. Hot
segments: a key of more than ``BLOCK`` lines is met in blocks, so that no task holds all its pairs. Only candidates' texts are
shuffled; the filters that pick hot lines and candidates are sets of at most 2 ** 20 hash residues, and what they pick too
much is sorted out exactly.

Defined cases: a null text has no lines. Documents with a null id are kept as they are and make no line a copy. Rows
with the same id count as one document: a line at the same place of both stays in both, others go by their places, each
from its own row. Other columns, whatever their names, are kept by ``drop_repeated_lines``. Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, written

#: Lines of MIN_CHARS are compared by edits, shorter ones by equality; lines of MIN_REMOVED are taken out of documents.
EDITS, MIN_CHARS, MIN_REMOVED = 2, 20, 20
_RESIDUES = 1 << 20
_STEP = 1 << 31
#: A line with more occurrences is made distinct before its parts are shuffled; others are as they are.
OFTEN = 64
#: Rows of one line, and lines of one segment, that a task takes at once.
SPLIT, BLOCK = 1024, 1024


def lines(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """(doc_id, t, line_no, line, id, id2): the lines of ``least_chars`` code points or more, with two hashes of each; t is that of the text."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = rows.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    cut = cut.select("doc_id", "t", "line_no", F.trim("raw", F.lit(" \t\r")).alias("line")).where(F.length("line") >= least_chars)
    return cut.select("*", F.xxhash64("line").alias("id"), F.xxhash64("line", F.lit(1)).alias("id2"))


def _shifts(edits: int) -> list[tuple[int, int, int]]:
    """The parts of a line that stand for it, as (less, i, shift): segment i of a line shorter by ``less``, moved by ``shift``.

    Shifts are those that the edits left and right of the segment allow; a line's own segments, (0, i, 0), are among them.
    """
    return [
        (less, i, shift)
        for less in range(edits + 1) for i in range(edits + 1)
        for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)
    ]


def _probes(edits: int) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for k, (less, i, shift) in enumerate(_shifts(edits))))


def _segment(m: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """Start and size of segment ``i`` of a line of ``m`` characters; the last segments are the longer ones."""
    base, even = F.floor(m / (edits + 1)).cast("int"), F.lit(edits + 1) - m % (edits + 1)
    return base * i + F.greatest(i - even, F.lit(0)), base + F.when(i >= even, 1).otherwise(0)


def segment_keys(texts: DataFrame, edits: int) -> DataFrame:
    """(key, id, probe) for each part of each row of ``texts(id, line)``; probe numbers the part in ``_shifts``."""
    k = edits + 1
    rows = texts.select("id", "line", F.length("line").alias("n"), F.explode(_probes(edits)).alias("p"))
    rows = rows.withColumn("m", F.col("n") - F.col("p.less"))
    rows = rows.withColumns({"base": F.expr(f"CAST(m DIV {k} AS INT)"), "even": F.lit(k) - F.col("m") % k})
    start = F.col("base") * F.col("p.i") + F.greatest(F.col("p.i") - F.col("even"), F.lit(0)) + F.col("p.shift")
    size = F.col("base") + F.when(F.col("p.i") >= F.col("even"), 1).otherwise(0)
    rows = rows.withColumns({"start": start, "size": size}).where("start >= 0 AND start + size <= n")
    key = F.xxhash64("m", "p.i", F.substr("line", F.col("start") + 1, F.col("size")))
    return rows.select(key.alias("key"), "id", F.col("p.k").cast("byte").alias("probe"))


def _met_before(edits: int) -> Column:
    """Whether the lines a and b of a pair share a part that comes before the one with which b probes (``b_probe``) here."""
    less = F.col("b_n") - F.col("a_n")
    earlier = F.filter(_probes(edits), lambda p: (p["less"] == less) & (p["k"] < F.col("b_probe")))

    def same(p: Column) -> Column:
        start, size = _segment(F.col("a_n"), p["i"], edits)
        at = start + p["shift"]
        return (at >= 0) & (at + size <= F.col("b_n")) & (F.substr(F.col("a_line"), start + 1, size) == F.substr(F.col("b_line"), at + 1, size))

    return F.exists(earlier, same)


def _bits(chars: Column) -> Column:
    """struct<one, two>: parity of the numbers of characters, and of pairs of neighbours, in each of 64 classes.

    An edit flips two bits of ``one`` and four of ``two`` at most.
    """
    zero = F.lit(0).cast("long")
    flip = lambda bits, k: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63)))
    start = F.struct(F.lit(0).alias("last"), zero.alias("one"), zero.alias("two"))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.struct(code.alias("last"), flip(acc["one"], code).alias("one"), flip(acc["two"], acc["last"] * 37 + code * 11).alias("two"))

    return F.aggregate(chars, start, step)


def _shared(a: Column, b: Column, most: Column, at_end: bool) -> Column:
    """Length of the longest common prefix (or suffix) of two strings, ``most`` or 2 ** 21 at most, by halving steps."""

    def part(x: Column, got: Column, step: Column) -> Column:
        return F.substr(x, F.length(x) - got - step + 1, step) if at_end else F.substr(x, got + 1, step)

    def grow(got: Column, step: Column) -> Column:
        return F.when((got + step <= most) & (part(a, got, step) == part(b, got, step)), got + step).otherwise(got)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(20, -1, -1))), F.lit(0), grow)


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters if it is at most ``edits``, else a larger number.

    Lengths must differ by ``edits`` at most. Bit k of the band in column i stands for row i - edits + k of ``a``. The score
    follows the band's lowest diagonal to the last row, then that row. Arrays shorter than ``edits`` get as many equal
    characters in front.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    front = F.array_repeat(F.lit("="), edits)
    a, b = F.concat(front, a), F.concat(front, b)
    n, m = F.size(b), F.size(a)
    padded = F.concat(F.array_repeat(F.lit("").cast("string"), edits), a)
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(
        long(((1 << (edits + 1)) - 1) << edits).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("score"), F.lit(0).alias("i"), padded.alias("a"), m.alias("m")
    )

    def step(acc: Column, c: Column) -> Column:
        same = [F.when(F.get(acc["a"], acc["i"] + k) == c, long(1 << k)).otherwise(long(0)) for k in range(width)]
        eq = same[0]
        for x in same[1:]:
            eq = eq.bitwiseOR(x)
        inner = F.struct(eq.alias("eq"), acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["score"].alias("score"))
        return F.element_at(F.transform(F.array(inner), lambda x: column(x, acc)), 1)

    def column(x: Column, acc: Column) -> Column:
        i = acc["i"]
        eq, vp, vn = x["eq"], x["vp"], x["vn"]
        carried = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)
        d0 = carried.bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(full)
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(full))
        hn = d0.bitwiseAND(vp)
        low = F.call_function("shiftright", d0, F.lit(1))
        row = F.lit(2 * edits - 1) - (i - (acc["m"] - edits))  # the bit of the last row, once the band has reached it
        bit = lambda v: F.call_function("shiftright", v, F.greatest(row, F.lit(0))).bitwiseAND(1).cast("int")
        down = F.when(d0.bitwiseAND(1 << (2 * edits)) == 0, 1).otherwise(0)
        moved = F.when(i < acc["m"] - edits, down).otherwise(bit(hp) - bit(hn))
        vp = hn.bitwiseOR(F.bitwise_not(low.bitwiseOR(hp))).bitwiseAND(full)
        return F.struct(
            vp.alias("vp"), low.bitwiseAND(hp).alias("vn"), (x["score"] + moved).alias("score"), (i + 1).alias("i"), acc["a"].alias("a"), acc["m"].alias("m")
        )

    return F.aggregate(b, start, step)["score"]


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def distance(edits: int) -> Column:
    """Edit distance of a_line and b_line, of a_n and b_n characters, if it is at most ``edits``, else a larger number.

    What both begin and end with, but for ``edits`` characters before it, is cut off first, which leaves the distance as it is.
    """
    a, b, shorter = F.col("a_line"), F.col("b_line"), F.least("a_n", "b_n")

    def cut(head: Column, tail: Column) -> Column:
        begin = F.greatest(head - edits, F.lit(0))
        part = lambda x, n: F.split(F.substr(x, begin + 1, F.col(n) - begin - tail), "")
        return F.struct(part(a, "a_n").alias("x"), part(b, "b_n").alias("y"))

    of = lambda p: edit_distance(p["x"], p["y"], edits)
    return _let(_shared(a, b, shorter, False), lambda head: _let(_shared(a, b, shorter - head, True), lambda tail: _let(cut(head, tail), of)))


def _residue(c: str) -> Column:
    return F.pmod(F.col(c), F.lit(_RESIDUES))


def first_places(found: DataFrame) -> DataFrame:
    """(id, id2, first, n) of each distinct line: its first place, doc_id * 2 ** 31 + line_no, and its occurrences."""
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(_STEP).cast("decimal(10,0)") + F.col("line_no")
    return found.withColumn("place", place.cast("decimal(32,0)")).groupBy("id", "id2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))


def links(found: DataFrame, firsts: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, a2, a_first, b, b2, b_first): all pairs of distinct lines within ``edits`` edits, each once, with their first places."""
    hot = F.broadcast(firsts.where(F.col("n") > OFTEN).select(_residue("id").alias("r")).distinct())  # 2 ** 20 rows at most
    texts = found.select("id", "line", _residue("id").alias("r"))
    rare = texts.join(hot, "r", "left_anti").select("id", "line")
    often = texts.join(hot, "r", "left_semi").select("id", "line").distinct()  # combined before the shuffle
    keyed = segment_keys(rare, edits).unionByName(segment_keys(often, edits))
    own = [k for k, (less, _, shift) in enumerate(_shifts(edits)) if not less and not shift]
    whole = Window.partitionBy("key")
    keyed = keyed.withColumns({"lo": F.min("id").over(whole), "hi": F.max("id").over(whole), "any": F.max(F.col("probe").isin(own)).over(whole), "m": F.count("id").over(whole)})
    near = keyed.where("lo < hi AND any").select("key", "id", "probe", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    near = written(near.distinct(), "near-lines")
    wanted = F.broadcast(near.select(_residue("id").alias("r")).distinct())  # 2 ** 20 rows at most
    texts = found.withColumn("r", _residue("id")).join(wanted, "r", "left_semi").select("id", "id2", "line").distinct()
    texts = texts.join(near.select("id").distinct(), "id", "left_semi").join(firsts.select("id", "id2", "first"), ["id", "id2"])
    texts = written(texts.select("id", "id2", "first", "line", F.length("line").alias("n"), _bits(F.split("line", "")).alias("bits")), "near-texts")
    rows = near.join(texts, "id")
    taken = ("id", "id2", "first", "line", "n", "bits", "probe")
    a = rows.where(F.col("probe").isin(own)).select("key", F.pmod("id", "blocks").alias("block"), *(F.col(c).alias(f"a_{c}") for c in taken))
    b = rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), *(F.col(c).alias(f"b_{c}") for c in taken))
    longer = (F.col("b_n") > F.col("a_n")) | ((F.col("b_n") == F.col("a_n")) & (F.struct("b_id", "b_id2") > F.struct("a_id", "a_id2")))
    flipped = lambda c: F.bit_count(F.col(f"a_bits.{c}").bitwiseXOR(F.col(f"b_bits.{c}")))
    close = (F.col("b_n") - F.col("a_n") <= edits) & (flipped("one") <= 2 * edits) & (flipped("two") <= 4 * edits)
    # one expression, so that the cheap tests stay before the others
    linked = F.when(longer & close, F.when(~_met_before(edits), distance(edits) <= edits).otherwise(False)).otherwise(False)
    done = a.join(b, ["key", "block"]).where(linked)
    return done.select(*(F.col(f"{x}_{c}").alias(n) for x in "ab" for c, n in (("id", x), ("id2", f"{x}2"), ("first", f"{x}_first"))))


def _placed(found: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """The rows of ``found`` with n_links, first_doc_id, first_line_no and removed."""
    firsts = written(first_places(found), "first-places")
    pairs = links(found.where(F.length("line") >= min_chars), firsts, edits)
    side = lambda x, y: F.struct(F.col(x).alias("id"), F.col(f"{x}2").alias("id2"), F.col(f"{y}_first").alias("other"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("s.*")
    linked = both.groupBy("id", "id2").agg(F.count(F.lit(1)).alias("n_links"), F.min("other").alias("other"))
    known = firsts.join(linked, ["id", "id2"], "left")
    known = known.select("id", "id2", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.least("first", "other").alias("first"))
    # lines with many rows: their class is copied to as many parts as their rows are dealt to
    large = firsts.where(F.col("n") > SPLIT).groupBy(_residue("id").alias("r")).agg(F.ceil(F.max("n") / SPLIT).cast("long").alias("parts"))
    large = F.broadcast(written(large, "large-lines"))  # 2 ** 20 rows at most
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    known = known.withColumn("r", _residue("id")).join(large, "r", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("r", "parts")
    out = found.select("doc_id", "t", "line_no", "id", "id2", _residue("id").alias("r")).join(large, "r", "left")
    out = out.withColumn("part", F.pmod(F.xxhash64("doc_id", "line_no"), parts)).drop("r", "parts").join(known, ["id", "id2", "part"])
    doc = F.floor(F.col("first") / F.lit(_STEP).cast("decimal(10,0)")).cast("long")
    out = out.withColumn("first_doc_id", doc)
    line_no = (F.col("first") - F.col("first_doc_id").cast("decimal(20,0)") * F.lit(_STEP).cast("decimal(10,0)")).cast("int")
    out = out.withColumn("first_line_no", line_no)
    removed = (F.col("first_doc_id") < F.col("doc_id")) | ((F.col("first_doc_id") == F.col("doc_id")) & (F.col("first_line_no") < F.col("line_no")))
    return out.withColumn("removed", removed)


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, least_chars: int = 1) -> DataFrame:
    """One row per line that is not blank: doc_id, line_no, n_links (other texts within the threshold), first_doc_id and
    first_line_no (the first place of this or a linked text), removed (it is a copy), class_id (the same for equal lines).
    ``least_chars`` leaves shorter lines out."""
    out = _placed(lines(docs, least_chars), edits, min_chars)
    return out.select("doc_id", "line_no", "n_links", "first_doc_id", "first_line_no", "removed", F.col("id").alias("class_id"))


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, min_removed: int = MIN_REMOVED) -> DataFrame:
    """``docs`` without the lines of ``min_removed`` code points or more that are copies; documents of which nothing but
    blank lines is left go."""
    key, key2, gone = fresh(docs.columns, "key", "key2", "gone")
    found = _placed(lines(docs, min(min_chars, min_removed)), edits, min_chars).where("removed")
    found = found.groupBy(F.col("doc_id").alias(key), F.col("t").alias(key2)).agg(F.collect_set("line_no").alias(gone))
    out = docs.withColumns({key: F.col("doc_id").cast("long"), key2: F.xxhash64(F.col("text").cast("string"))}).join(found, [key, key2], "left")
    goes = lambda x, i: F.array_contains(gone, i) & (F.length(F.trim(x, F.lit(" \t\r"))) >= min_removed)
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~goes(x, i)), "\n")
    out = out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
    out = out.where(F.col(gone).isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return out.select(docs.columns)
