"""Corpus operators against brute force on small tables, with nulls, repeats, ties and empty tables."""

import base64
import hashlib
import html
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, extraction, line_dedup, packing, pii, quality, simhash, substring_dedup, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g long, k long"
PASSAGE = " ".join(f"word{i}" for i in range(40))
LINE = "The quick brown fox jumps over the lazy dog near the river bank."
TEXTS = [
    None, "", " \n\t ", "Short.", PASSAGE, f"Start here {PASSAGE} and end", f"{LINE}\nAnother line of text that stands alone here\n{LINE}", LINE.replace("quick", "quirk"), LINE + "\n" + LINE.replace("fox", "foxes"),
    "É ü ß 漢字 mixed space and   odd characters in a longer line of text", "x " * 3000 + PASSAGE, PASSAGE, PASSAGE.upper(), "Mail a@b.co.uk or 10.0.0.255, 999.1.1.1; card 4111 1111 1111 1111 call +49 (30) 1234-5678.",
    "IBAN DE89 3704 0044 0532 0130 00 and token = \"abcdef0123456789\"", "a" * 20000 + " " + "1" * 20000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, 7, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, PASSAGE, None, None, None, 1, 1), (4, PASSAGE, "en", "s", 1, 1, 1)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_substring_dedup(docs, none):
    got = substring_dedup.remove_repeated_windows(docs).collect()
    first: dict = {}
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    for i, w in rows:
        for k in range(len(w) - 12) if i is not None else ():
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for i, w in rows:
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str)
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in got)
    assert substring_dedup.remove_repeated_windows(none).count() == 0


def fingerprint(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(docs, none, spark):
    got = simhash.near_duplicates(docs).collect()
    fp = {(r.doc_id, r.text): fingerprint(r.text) for r in docs.collect()}
    assert sorted(f"{fp[r.doc_id, r.text]:016x}" for r in docs.collect()) == sorted(r.fingerprint for r in got)
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[0] == by[1] == by[2] == 0 and by[11] == by[4] == 4 and by[12] == 4
    assert simhash.near_duplicates(none).count() == 0
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} >= {0, 3, 4, None}


def test_simhash_links_are_whole(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(30):
            x = b
            for _ in range(rng.integers(1, 6)):
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    a = np.array(fps, dtype=np.uint64)
    root = list(range(len(a)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    want = {}
    for i in range(len(a)):
        want.setdefault(find(i), set()).add(int(a[i].view(np.int64)))
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    for variants in (8_000_000, 2081 * 7):
        got: dict = {}
        from tidewatch.llm.graph import components

        for r in components(simhash.links(df, variants=variants)).collect():
            got.setdefault(r.root, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_packing(docs, none):
    got = packing.pack_documents(docs).collect()
    tok = packing.tokenizer(packing.VOCABULARY)
    ids = {(r.doc_id, r.text): np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}
    want = sorted((i, k, s, n, zlib.crc32(v[s : s + n].tobytes())) for (i, _), v in ids.items() if i is not None for k, (s, n) in enumerate(packing.cuts(len(v), 2048)))
    assert sorted({(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id is not None}) == want
    place: dict = {}
    for r in got:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in place.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(none).count() == 0


def test_fast_tokens_equal_the_tokenizer():
    tok, fast = packing.tokenizer(packing.VOCABULARY), packing._fast(packing.VOCABULARY)
    for a in range(1, 0x3000, 64):
        s = "".join(f"a{chr(c)}b 1{chr(c)}2  {chr(c)} {chr(c)}{chr(c)}\n" for c in range(a, min(a + 64, 0x3000)))
        assert tok.encode(s, add_special_tokens=False).ids == fast.encode_ordinary(s)


def test_best_two_fit_fills_the_gap():
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(map(sorted, (b for b, _ in plan))) == [[2, 2, 6], [3]]
    counts = {k: (k * 7919) % 50 for k in range(1, 101)}
    plan = packing.best_two_fit(counts, 100)
    used: dict = {}
    for b, times in plan:
        assert sum(b) <= 100
        for x in b:
            used[x] = used.get(x, 0) + times
    assert used == {k: v for k, v in counts.items() if v}
    assert sum(t for _, t in plan) <= 1.02 * sum(k * v for k, v in counts.items()) / 100


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_line_dedup(docs, none):
    got = {(r.doc_id, r.line_no): (r.n_links, r.first_doc_id, r.first_line_no, r.removed) for r in line_dedup.line_classes(docs.where("length(text) < 5000 OR text IS NULL")).collect()}
    lines: dict = {}
    for i, t in enumerate(TEXTS):
        for n, x in enumerate((t or "").split("\n")):
            if len(x.strip(" \t\r")) >= 20 and len(t) < 5000:
                lines.setdefault(x.strip(" \t\r"), []).append((i, n))
    for x, places in lines.items():
        near = [y for y in lines if y != x and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2]
        first = min(p for y in [x, *near] for p in lines[y])
        for p in places:
            assert got[p] == (len(near), *first, first < p)
    assert line_dedup.line_classes(none).count() == 0
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs.where("length(text) < 5000 OR text IS NULL")).collect()}
    assert 7 not in kept and kept[6].count(LINE) == 1 and 0 in kept and 3 in kept


def test_edit_distance(spark):
    rows = [("kitten sitting on mats", "kitten sitting on mat"), ("ab", "ba"), ("abc", "xbcd"), ("", "ab"), ("same", "same"), ("aaaa", "bbbb"), ("éa", "ea")]
    df = spark.createDataFrame([(a, b, len(a), len(b)) for a, b in rows], "a_line string, b_line string, a_n int, b_n int")
    got = [r.d for r in df.withColumn("d", line_dedup.distance(2)).collect()]
    assert [min(x, 3) for x in got] == [min(distance(a, b), 3) for a, b in rows]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pii(docs, none):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m)), "phone": lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15}
    got = {r.doc_id: r for r in pii.digest(pii.find_spans(docs)).collect()}
    for i, t in enumerate(TEXTS):
        s = sorted((m.start(), j, f"{k}:{m.start()}:{m.end()}") for j, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if ok[k](m[0]))
        assert got[i].base_sha256 == hashlib.sha256(",".join(x[2] for x in s).encode()).hexdigest()
    assert "iban" in got[14].spans and "secret" in got[14].spans and got[13].n_card == 1
    assert pii.digest(pii.find_spans(none)).count() == 0
    assert "[EMAIL]" in pii.redact(docs.where("doc_id = 13")).first().text


def test_decontamination(spark, none):
    item = "A train leaves Paris at 9 with 120 people and then Anna counts 35 people more in the train to Paris"
    other = item.replace("120", "77").replace("35", "12").replace("Anna", "Maria").replace("Paris", "Rome")
    mixed = item.replace("leaves Paris", "leaves Rome")  # the same name stands for two
    d = spark.createDataFrame([(1, f"Before this. {item} after that"), (2, f"And so on: {other}"), (3, "Nothing of that kind is written in this text about a train"), (4, None), (5, mixed)], "doc_id long, text string")
    b = spark.createDataFrame([(9, item), (8, None), (7, "")], "item_id long, text string")
    want = {1: 0, 2: 4}
    for most in (decontamination.MOST_WINDOWS, 0):
        got = {r.doc_id: r.changed for r in decontamination.find(d, b, most_windows=most).collect()}
        assert {k: v for k, v in got.items() if k in (1, 2, 3, 4)} == want
    assert {r.doc_id for r in decontamination.drop_contaminated(d, b).collect()} >= {3, 4}
    assert decontamination.find(none, b).count() == 0 and decontamination.find(d, b.where("false")).count() == 0


def test_extraction(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two<br>three</p><aside>ad</aside><p>Four.</p></article><div class='comments'><p>Reader</p></div><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "just text", 0)], "page_id long, url string, html string, text long")
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.main_text(df).collect()}
    text = "T & U\n\nOne two three\n\nFour."
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0), 4: ("just text", 9)}
    assert html.unescape("&amp;") == "&"


def test_messages_are_exact_marginals():
    model = extraction.trained()
    nodes = extraction.parse("<body><div class='ad'><p>Buy now</p></div><article><p>Some words here</p></article></body>")
    got = model.marginals(nodes)
    import itertools

    total, sums = 0.0, np.zeros((len(nodes), 3))
    unary = [model.unary(x) for x in nodes]
    unary[0] = [unary[0][0] * 0.1, unary[0][1] * 0.3, unary[0][2] * 0.6]
    for y in itertools.product(range(3), repeat=len(nodes)):
        p = np.prod([unary[k][s] for k, s in enumerate(y)]) * np.prod([model.pair[y[x.parent]][y[k]] for k, x in enumerate(nodes) if x.parent >= 0])
        total += p
        for k, s in enumerate(y):
            sums[k, s] += p
    assert np.allclose(np.array(got), sums / total, atol=1e-9)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(400, None), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, rng.normal(size=8).tolist())]
    rows[7] = (7, rows[8][1])  # a tie
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), block=16, shard=64, group=3).orderBy("query_id", "rank").collect()]
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows if x is not None and all(y is not None and np.isfinite(y) for y in x)}
    want = []
    for q in sorted(i for i in v if i % 50 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert got == want
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/?x=%20", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c d", ""), (5, "http://e", "x\r\n\r\nWARC/1.1\r\n\r\ny"), (None, "n", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    top = {"<p>é</p>": 2, "": 4}
    for i, u, h in rows:
        raw = (h or "").encode()
        r = got[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (u, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.refers_to == (top[h or ""] if top.get(h or "", i) != i else None)
    assert warc.round_trip(df.where("false")).count() == 0


def test_quality(spark, docs, none):
    good = ["plain words of a text number %d that go on" % i for i in range(120)]
    bad = ["$$$ BUY!! ### NOW!! %d &&&" % i for i in range(120)]
    rows = [(i, t) for i, t in enumerate([x for p in zip(good, bad) for x in p])]
    d = spark.createDataFrame([*rows, (999, None), (998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in rows], "doc_id long, quality int")
    net = quality.fit(d, labels)
    got = quality.scores(d, net).collect()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 2 == 0) for r in held]) > 0.95
    assert quality.scores(docs, net).count() == docs.count() and quality.scores(none, net).count() == 0
    long = np.frombuffer(("ab $ " * 120_000).encode(), np.uint8)
    whole = net.halves(long)
    assert np.allclose(net.maxima(long), whole, atol=1e-5)
