"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens: its words, lower-cased, without anything but letters, digits and other non-ASCII
characters. Numbers (words that begin with a digit, and number words), names (a capital and a small letter; at the
beginning of a sentence only where the word isn't one of the common ``OPENERS``) and units (those with short names only after
a number) become typed placeholders. Windows of ``WINDOW`` tokens of the template are hashed and joined with the windows of the benchmark, so a
question whose numbers, names and units were changed still matches; windows that are placeholders for more than half are
hashed with their values instead. Matches that continue each other form runs, and a run is cut where its slots contradict
each other: in each part, and in all parts taken of an item, one value of the item always stands for one value in the
document, and the other way round. A document holds an item if consistent parts cover ``least_tokens`` of its tokens, or the
whole of a shorter item.

The benchmark's windows are broadcast while there are at most ``MOST_WINDOWS`` of them (the bound is checked; 16 bytes
each), and documents are then matched and verified where they are, without a shuffle. Beyond that, window hashes are
joined in Spark: those of documents are first held against a bitmap of the benchmark's (2 MB, whatever its size), and the
(document, item) pairs found are verified the same way, in batches. Both ways give the same rows.

Defined cases: null and empty texts, of documents or items, have no tokens and match nothing. Items shorter than a window
match only as a whole; those of fewer than ``LEAST_ITEM`` tokens, which are no evidence within a longer text, match texts that
have no other tokens. Rows with a null doc_id or item_id are matched like others; repeated ids give rows each. An empty benchmark finds
nothing. Other columns are ignored by ``find`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import fresh, written
from .tokens import U64, Words, column_bytes, mix, rolled, runs, slices, words

WINDOW, LEAST_TOKENS, LEAST_ITEM = 8, 13, 5
MOST_WINDOWS = 2_000_000
#: Names of units that become a placeholder anywhere, and short ones that do so after a number.
UNITS = (
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams "
    "kilogram kilograms kilo kilos pound pounds ounce ounces ton tons tonne tonnes liter liters litre litres gallon gallons second seconds minute minutes "
    "hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees watt watts volt volts "
    "acre acres hectare hectares pint pints quart quarts rupee rupees peso pesos franc francs yen"
).split()
SHORT_UNITS = "km cm mm m kg mg g t lb lbs oz ft yd mi in l ml dl gal h hr hrs min mins s sec secs ms w kw kwh v mph kmh kph usd eur gbp jpy c f k mb gb tb hz mhz ghz".split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice double triple"
).split()
#: Words that open sentences without being names.
OPENERS = (
    "a an the this that these those there here it its he she we you they i his her our your their my who what when where which why how whose if in on at of for from to "
    "by with without after before during since until while although because as so but and or nor not no yes then than thus each every all both some any many much more most few "
    "one two three four five six seven eight nine ten is are was were be been do does did has have had can could will would should may might must let find calculate compute "
    "determine suppose given consider show prove write solve read choose name state explain describe assume imagine note now today yesterday tomorrow later once"
).split()
NUMBER, NAME, UNIT = (U64(x) for x in (0x9D8A1F3B5C7E0201, 0x9D8A1F3B5C7E0202, 0x9D8A1F3B5C7E0203))
OUT = "doc_id long, item_id long, tokens long, coverage double, changed long"
_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True


class Template:
    """Tokens of a column of texts: ``value`` hashes each word, ``token`` is the same but for placeholders."""

    def __init__(self, texts: pa.Array):
        data, offsets = column_bytes(texts)
        low, low_at = column_bytes(pc.utf8_lower(texts))
        raw, plain = words(data, offsets), words(low, low_at)
        if len(raw) != len(plain):  # no letter's small form is a space, but then names could not be placed
            raw = plain
        keep = _KEEP[plain.data]
        kept_at = np.concatenate([[0], np.cumsum(keep)])
        a, b = kept_at[plain.starts], kept_at[plain.ends]
        some = b > a
        self.row, self.rows = plain.row[some], plain.rows
        packed = Words(plain.data[keep], a[some], b[some], self.row, self.rows)
        self.value = packed.hashes()
        digits = np.concatenate([[0], np.cumsum(_DIGIT[packed.data])])
        number = digits[packed.ends] - digits[packed.starts] == packed.ends - packed.starts
        unit = np.isin(self.value, _hashed("units", UNITS))
        if len(number):
            first = packed.data[np.minimum(packed.starts[:, None] + np.arange(3), len(packed.data) - 1)]
            signed = ((first[:, 0] == 0xE2) & (first[:, 1] == 0x82) & (first[:, 2] == 0xAC)) | ((first[:, 0] == 0xC2) & ((first[:, 1] == 0xA3) | (first[:, 1] == 0xA5)))  # euro, pound, yen
            number = _DIGIT[first[:, 0]] | signed & (digits[packed.ends] > digits[packed.starts]) | np.isin(self.value, _hashed("numbers", NUMBER_WORDS))
            short = np.isin(self.value, _hashed("short units", SHORT_UNITS))
            unit[1:] |= short[1:] & number[:-1] & (self.row[1:] == self.row[:-1])
        self.kind = np.where(number, 1, np.where(self._names(raw)[some] & ~(self._opens(raw)[some] & np.isin(self.value, _hashed("openers", OPENERS))), 2, np.where(unit, 3, 0)))
        self.token = np.where(self.kind == 1, NUMBER, np.where(self.kind == 2, NAME, np.where(self.kind == 3, UNIT, self.value)))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=self.rows))])

    @staticmethod
    def _opens(w: Words) -> np.ndarray:
        """Whether each word is the first of its text, line or sentence."""
        opens = np.ones(len(w), bool)
        if len(w):
            lines = np.concatenate([[0], np.cumsum(w.data == 10)])
            opens[1:] = (w.row[1:] != w.row[:-1]) | _STOP[w.data[w.ends[:-1] - 1]] | (lines[w.starts[1:]] > lines[w.ends[:-1]])
        return opens

    @staticmethod
    def _names(w: Words) -> np.ndarray:
        """Whether each word has a capital and then a small letter, after quotes and brackets."""
        if not len(w):
            return np.zeros(0, bool)
        d, s = np.append(w.data, [0, 0, 0]).astype(np.int64), w.starts
        s = s + (~_KEEP[d[s]] & (w.ends - s > 1))
        latin = (d[s] == 0xC3) & (d[s + 1] >= 0x80) & (d[s + 1] <= 0x9E)
        upper = (d[s] >= 65) & (d[s] <= 90)
        after = np.where(latin, d[s + 2], d[s + 1])
        small = ((after >= 97) & (after <= 122)) | (after >= 128)
        return (upper | latin) & small & (w.ends - s > np.where(latin, 2, 1))

    def windows(self, width: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(token index, hash) of all windows, or of those in the rows that ``only`` marks; dense ones are hashed by their values."""
        at = runs(Words(np.zeros(0, np.uint8), self.row, self.row, self.row, self.rows), width)
        if only is not None:
            at = at[only[self.row[at]]]
        slots = np.concatenate([[0], np.cumsum(self.kind > 0)])
        dense = 2 * (slots[at + width] - slots[at]) > width
        h = rolled(self.token, width, at)
        if dense.any():
            h[dense] = rolled(self.value, width, at[dense]) ^ U64(0x5DEECE66D)
        return at, mix(h + U64(width))


_LISTS: dict[str, np.ndarray] = {}


def _hashed(name: str, listed: list[str]) -> np.ndarray:
    if name not in _LISTS:
        raw = np.frombuffer(" ".join(listed).encode(), np.uint8)
        _LISTS[name] = np.sort(words(raw, np.array([0, len(raw)])).hashes())
    return _LISTS[name]


class Index:
    """Windows of the benchmark, and its templates for the check of slots."""

    def __init__(self, items: pa.Table, window: int):
        self.ids = items.column("item_id").to_pylist()
        self.t = t = Template(items.column("text").combine_chunks())
        size = np.diff(t.first)
        self.size, self.window = size, window
        self.widths = sorted({int(min(n, window)) for n in size if n})
        hashes, at = [], []
        for w in self.widths:
            i, h = t.windows(w)
            own = np.minimum(size[t.row[i]], window) == w
            hashes.append(h[own])
            at.append(i[own])
        h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], np.concatenate(at)[order] if at else np.zeros(0, np.int64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hash & U64((1 << 20) - 1)).astype(np.int64)] = True

    def matches(self, t: Template):
        """(token index in the texts, token index in the items, width) of all windows that both have."""
        d, i, n = [], [], []
        counts = np.diff(t.first)
        for w in self.widths:
            at, h = t.windows(w, counts == w if w < min(LEAST_ITEM, self.window) else None)
            maybe = self.sieve[(h & U64((1 << 20) - 1)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            a, b = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            times = b - a
            k = np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            j = self.at[k]
            own = np.minimum(self.size[self.t.row[j]], self.window) == w
            d.append(np.repeat(at, times)[own])
            i.append(j[own])
            n.append(np.full(int(own.sum()), w))
        none = np.zeros(0, np.int64)
        return (np.concatenate(d), np.concatenate(i), np.concatenate(n)) if d else (none, none, none)

    def verified(self, t: Template, least: int) -> list[tuple[int, int, int, float, int]]:
        """(row, item, tokens, coverage, changed slots) of each text and item that consistent runs link."""
        d, i, n = self.matches(t)
        if not len(d):
            return []
        row, item = t.row[d], self.t.row[i]
        order = np.lexsort((d, d - i, item, row))
        d, i, n, row, item = d[order], i[order], n[order], row[order], item[order]
        new = np.ones(len(d), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | ((d - i)[1:] != (d - i)[:-1]) | (d[1:] > d[:-1] + n[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(d)) - 1
        parts: dict[tuple[int, int], list] = {}
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            found = parts.setdefault((int(row[a]), int(item[a])), [])
            found += self._consistent(t, int(d[a]), int(i[a]), int(d[b] + n[b] - d[a]))
        out = []
        for (r, k), found in parts.items():
            there: dict = {}
            back: dict = {}
            taken = []
            for start, end, x, y in sorted(found, key=lambda p: (p[0] - p[1], p[0])):  # the longest first; later ones must agree with them
                if all(there.get(a, b) == b and back.get(b, a) == a for a, b in zip(x, y, strict=True)):
                    there.update(zip(x, y, strict=True))
                    back.update(zip(y, x, strict=True))
                    taken.append((start, end))
            total, upto = 0, -1
            for a, b in sorted(taken):  # places of the item, each counted once
                total += max(0, b - max(a, upto))
                upto = max(upto, b)
            if total >= min(least, int(self.size[k])):
                out.append((r, k, total, total / int(self.size[k]), sum(a != b for a, b in there.items())))
        return out

    def _consistent(self, t: Template, d: int, i: int, size: int) -> list[tuple[int, int, list, list]]:
        """The maximal parts of a run whose slots map one to one: (begin, end) in the item, its values and those of the text."""
        slots = np.flatnonzero(t.kind[d : d + size] > 0).tolist()
        x, y = self.t.value[i : i + size][slots].tolist(), t.value[d : d + size][slots].tolist()
        out, begin, first = [], 0, 0
        there: dict = {}
        back: dict = {}
        for k, (a, b) in enumerate(zip(x, y, strict=True)):
            clash = max((m[1] for m, v in ((there.get(a), b), (back.get(b), a)) if m is not None and m[0] != v and m[1] >= first), default=-1)
            if clash >= 0:
                out.append((i + begin, i + slots[k], x[first:k], y[first:k]))
                begin, first = slots[clash] + 1, clash + 1
            there[a], back[b] = (b, k), (a, k)
        return [*out, (i + begin, i + size, x[first:], y[first:])]


def _find_batches(index: Index, least: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            _, offsets = column_bytes(texts)
            ids = batch.column("doc_id").to_pylist()
            for a, b in slices(offsets):
                got = index.verified(Template(texts.slice(a, b - a)), least)
                if got:
                    rows = [(ids[a + r], index.ids[k], n, c, changed) for r, k, n, c, changed in got]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "item_id", "tokens", "coverage", "changed"])

    return run


_BITS = 24


def _hash_batches(widths: list[int], window: int, whole: bool, sieve: np.ndarray | None = None):
    """(key of the text, hash) of all windows of the given widths, or (``whole``) only of those an item of that size has;
    with a ``sieve`` only hashes whose last bits it marks."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            _, offsets = column_bytes(texts)
            keys = batch.column("key")
            for a, b in slices(offsets):
                t = Template(texts.slice(a, b - a))
                size = np.diff(t.first)
                for w in widths:
                    only = size == w if whole and w < window or not whole and w < min(LEAST_ITEM, window) else None
                    at, h = t.windows(w, only)
                    if sieve is not None:
                        low = (h & U64((1 << _BITS) - 1)).astype(np.int64)
                        some = (sieve[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0
                        at, h = at[some], h[some]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(a + t.row[at])), pa.array(h.view(np.int64))], ["key", "h"])

    return run


def _size_batches(window: int):
    """The widths of the windows that a batch of items has."""

    def run(batches):
        for batch in batches:
            sizes = np.unique(np.minimum(np.diff(Template(batch.column("text")).first), window))
            yield pa.RecordBatch.from_arrays([pa.array(sizes[sizes > 0], pa.int64())], ["w"])

    return run


PAIR = ("doc_key", "doc_key2", "item_key", "item_key2")


def _pair_batches(window: int, least: int):
    """Verifies pairs of a text and an item's text, which their keys name; each text of a batch is looked at once."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            docs = t.group_by(["doc_key", "doc_key2"]).aggregate([("text", "min")])
            items = t.group_by(["item_key", "item_key2"]).aggregate([("item_text", "min")])
            names = list(zip(docs["doc_key"].to_pylist(), docs["doc_key2"].to_pylist(), strict=True))
            ids = list(zip(items["item_key"].to_pylist(), items["item_key2"].to_pylist(), strict=True))
            asked = set(zip(*(t[c].to_pylist() for c in PAIR), strict=True))
            index = Index(pa.table({"item_id": list(range(len(ids))), "text": items["item_text_min"].combine_chunks()}), window)
            texts = docs["text_min"].combine_chunks()
            _, offsets = column_bytes(texts)
            rows = []
            for a, b in slices(offsets):
                for r, k, n, c, x in index.verified(Template(texts.slice(a, b - a)), least):
                    if (*names[a + r], *ids[k]) in asked:
                        rows.append((*names[a + r], *ids[k], n, c, x))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (*[pa.int64()] * 5, pa.float64(), pa.int64()), strict=True)], [*PAIR, "tokens", "coverage", "changed"])

    return run


def _sieve(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the last ``_BITS`` bits of all hashes; 2 MB at most reach the driver, as bytes of 8 bits each."""
    low = F.col("h").bitwiseAND(F.lit((1 << _BITS) - 1))
    found = hashes.select((low / 8).cast("long").alias("k"), F.call_function("shiftleft", F.lit(1), F.pmod(low, F.lit(8)).cast("int")).alias("b")).groupBy("k").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (_BITS - 3), np.uint8)
    out[found["k"].to_numpy()] = found["b"].to_numpy()
    return out


def _sieved(widths: list[int], window: int, sieve):
    def run(batches):
        yield from _hash_batches(widths, window, False, sieve.value)(batches)

    return run


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_tokens: int = LEAST_TOKENS, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """One row per document and item it holds: tokens and share of the item covered, slots whose value was changed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # a text has at most as many words as half its bytes: the check needs no tokens
    bound = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    if bound <= most_windows:
        index = Index(items.toArrow(), window)
        return rows.mapInArrow(_find_batches(index, least_tokens), OUT)
    widths = sorted(r.w for r in items.select("text").mapInArrow(_size_batches(window), "w long").distinct().collect())  # numbers up to ``window``
    # texts are named by their hashes, not by ids, which may be null or repeated; each pair of texts is verified once
    keys = {"key": F.xxhash64("text"), "key2": F.xxhash64("text", F.lit(1))}
    rows, items = rows.withColumns(keys), items.withColumns(keys)
    right = written(items.select("key", "text").mapInArrow(_hash_batches(widths, window, True), "key long, h long").distinct(), "item-windows")
    sieve = rows.sparkSession.sparkContext.broadcast(_sieve(right))
    left = rows.select("key", "text").mapInArrow(_sieved(widths, window, sieve), "key long, h long").distinct()
    pairs = left.withColumnRenamed("key", "doc_key").join(right.withColumnRenamed("key", "item_key"), "h").select("doc_key", "item_key").distinct()
    named = lambda df, c, text: df.select(F.col("key").alias(f"{c}_key"), F.col("key2").alias(f"{c}_key2"), F.col("text").alias(text))
    texts = named(rows, "doc", "text").join(pairs.select("doc_key").distinct(), "doc_key", "left_semi").dropDuplicates(["doc_key", "doc_key2"])
    others = named(items, "item", "item_text").dropDuplicates(["item_key", "item_key2"])
    met = pairs.join(texts, "doc_key").join(others, "item_key").select(*PAIR, "text", "item_text")
    held = met.mapInArrow(_pair_batches(window, least_tokens), ", ".join(f"{c} long" for c in PAIR) + ", tokens long, coverage double, changed long")
    of_doc = rows.select("doc_id", F.col("key").alias("doc_key"), F.col("key2").alias("doc_key2"))
    of_item = items.select("item_id", F.col("key").alias("item_key"), F.col("key2").alias("item_key2"))
    return held.join(of_doc, ["doc_key", "doc_key2"]).join(of_item, ["item_key", "item_key2"]).select("doc_id", "item_id", "tokens", "coverage", "changed")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """The documents that hold no item. Rows with a null id stay."""
    found = find(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), benchmark, window, least_tokens)
    (key,) = fresh(docs.columns, "held")
    held = found.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(held, F.col("doc_id").cast("long") == F.col(key), "left_anti").select(docs.columns)
