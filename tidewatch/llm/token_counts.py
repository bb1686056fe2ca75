"""Token counts by byte-pair merging with a heap and a linked list, without token ids.

A text is cut at the vocabulary's added strings (a token each) and then into pre-tokens. The bytes of a pre-token are a linked
list of symbols, its adjacent pairs lie in a heap by rank and place. The lowest pair is popped again and again; if it
still stands there, the left symbol takes in the right one and the pairs with its two neighbours are pushed. Each pop
is a merge or stale, each merge pushes two pairs at most: n log n for a pre-token of n bytes, however long. Tokens are initial
symbols minus merges. Short pre-tokens repeat and are remembered by each Python worker, up to ``_REMEMBERED`` of them.

Which characters are letters and numbers is asked of the tokenizer itself once a worker, as its Unicode tables are older than
those of ``regex``.

Defined cases: a null or empty text has 0 bytes and 0 tokens. Null and repeated ids are counted row by row. Other columns are
ignored. Empty in, empty out.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Pre-tokens that a worker remembers, and the characters of the longest of them.
_REMEMBERED, _SHORT = 1 << 18, 64
#: Bits of a heap entry that hold the place; the rank is above them.
_PLACE = 40


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable
    and no space, else the next free one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Remembered(dict):
    """Token counts of pre-tokens; each is worked out when it is first asked for."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode())
        if len(piece) <= _SHORT:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[piece] = n
        return n


class PairMerger:
    """Token counts for one byte-level vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        odd += [k for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if x[k]]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or odd:
            raise ValueError(f"not a plain byte-level vocabulary: {path} {odd}")
        letters = byte_letters()
        number: dict[str, int] = {}
        self.first = [number.setdefault(letters[b], len(number)) for b in range(256)]
        #: (left symbol, right symbol) -> rank, and the symbol that each rank makes
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[number[a], number[b]] = r
            self.made.append(number.setdefault(a + b, len(number)))
        added = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known = Remembered(lambda raw: len(raw) - self.merges(raw))

    def merges(self, raw: bytes) -> int:
        """How many merges the bytes of one pre-token allow."""
        n, rank = len(raw), self.rank
        symbols = [self.first[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << _PLACE | i for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        done = 0
        while heap:
            top = heappop(heap)
            r, i = top >> _PLACE, top & ((1 << _PLACE) - 1)
            j = after[i]
            if j >= n or symbols[i] < 0 or rank.get((symbols[i], symbols[j])) != r:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = self.made[r], -1
            done += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heappush(heap, r << _PLACE | i)
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heappush(heap, r << _PLACE | h)
        return done

    def tokens(self, text: str) -> int:
        """Number of tokens of a whole text."""
        parts = self.added.split(text) if self.added else [text]
        plain, exact, newer = patterns()
        total = len(parts) - 1
        for part in parts:
            pattern = plain if part.isascii() or newer is None or not newer.search(part) else exact
            if len(part) < 1 << 20:
                total += sum(map(self.known.__getitem__, pattern.findall(part)))
            else:  # without a list of all pre-tokens
                total += sum(self.known[m.group()] for m in pattern.finditer(part))
        return total


def _pattern(letter: str, number: str, sign: str) -> regex.Pattern:
    """Pre-tokens of byte-level vocabularies: contractions, words, numbers and signs with at most one space in front, white space."""
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{sign}+|\s+(?!\S)|\s+", regex.V1)


@lru_cache(maxsize=1)
def patterns() -> tuple[regex.Pattern, regex.Pattern, regex.Pattern | None]:
    """The pattern of pre-tokens with the classes of ``regex``, that with the tokenizer's own, and one that finds characters in
    which they differ (None: there are none): letters and numbers that the tokenizer's tables don't have yet."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    newer = [c for kind, one in ((r"\p{L}", "a"), (r"\p{N}", "1")) for c in regex.findall(kind, every) if len(cut(one + c)) > 1]
    plain = _pattern(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")
    if not newer:
        return plain, plain, None
    spans: list[list[int]] = []
    for k in sorted(map(ord, newer)):
        if spans and spans[-1][1] == k - 1:
            spans[-1][1] = k
        else:
            spans.append([k, k])
    chars = "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in spans)
    exact = _pattern(rf"[\p{{L}}--[{chars}]]", rf"[\p{{N}}--[{chars}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{chars}]]")
    return plain, exact, regex.compile(f"[{chars}]")


@lru_cache(maxsize=2)
def merger(name: str) -> PairMerger:
    from public_tokenizers import path

    return PairMerger(path(name))


def _count_batches(name: str, limit: int):
    def run(batches):
        own = merger(name)
        for t in batches:
            texts = pc.fill_null(t.column("text"), "")
            n = pa.array([own.tokens(x.as_py()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("n_bytes"), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, name: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(_count_batches(name, limit), COUNTS)
