"""Line dedup: hot segments in blocks, lines of rows with one id, column names that clash, brute force of links."""

import random

from tidewatch.llm import line_dedup


def near(a, b, most=2):
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1] <= most


def test_links_of_many_variants_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    monkeypatch.setattr(line_dedup, "SPLIT", 8)
    monkeypatch.setattr(line_dedup, "OFTEN", 2)
    rng = random.Random(4)
    texts = [f"Page number {k} of the yearly report" for k in range(0, 1400, 9)]
    base = "an ordinary line with some words in it, and no digits"
    for _ in range(60):
        s = list(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["x", "yz", ""])
        texts.append("".join(s))
    texts += ["Page number 9 of the yearly report"] * 30
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t.strip(), i)
    for t, i in first.items():
        others = [u for u in first if u != t and near(t, u)]
        least = min([i, *(first[u] for u in others)])
        for r in (got[k] for k, u in rows if u.strip() == t):
            assert (r.n_links, r.first_doc_id, r.removed) == (len(others), least, least < r.doc_id)
    assert len({r.class_id for r in got.values()}) == len(first)


def test_lines_go_from_their_own_row(spark):
    x, y, z = (f"the {w} line, which is long enough to count" for w in ("first", "second", "third"))
    rows = [(5, f"{x}\n{y}", 1, "a"), (5, f"{y}\n{z}", 2, "b"), (3, x, 3, "c"), (None, x, 4, "d"), (6, None, 5, "e"), (7, "", 6, "f"), (8, z, 7, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _KEY string")
    got = {r._gone: r for r in line_dedup.drop_repeated_lines(df).collect()}
    assert {k: r.text for k, r in got.items()} == {2: f"{y}\n{z}", 3: x, 4: x, 5: None, 6: ""}  # of row 1 nothing is left, of row 7 neither
    assert got[2]._KEY == "b" and list(got[2].asDict()) == ["doc_id", "text", "_gone", "_KEY"]
    none = df.where("false")
    assert line_dedup.drop_repeated_lines(none).count() == 0 and line_dedup.line_classes(none).count() == 0
