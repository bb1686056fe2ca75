"""The pipeline on a small corpus with planted copies, benchmark passages and junk: what goes, what stays, and nothing else changes."""

import random
import zlib

import corpus_pipeline
from tidewatch.llm import packing

ITEM = "Which of the seven harbours on the northern coast was closed first after the great storm, and who ordered it to be opened again in spring?"
LINE = "Subscribe to the harbour letter and get the tide table every Monday."


def corpus():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(600)]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 14))).capitalize() + "."
    docs = {k: "\n".join(" ".join(sentence() for _ in range(3)) for _ in range(4)) for k in range(150)}
    junk = {k: " ".join("".join(rng.choice("$#%&*!~") for _ in range(rng.randint(3, 9))) for _ in range(60)) for k in range(200, 300)}
    words = docs[7].split(" ")
    planted = {
        400: docs[3], 401: " ".join([*words[:20], "changed", *words[21:]]), 402: f"{sentence()} {ITEM} {sentence()}", 403: docs[5].upper().lower().replace(docs[5].split(" ")[0].lower(), docs[5].split(" ")[0], 1),
        404: f"{LINE}\n{sentence()} {sentence()}\n{LINE}", 405: f"{sentence()} {sentence()} {sentence()}\n{LINE.replace('Monday', 'Mondey')}",
    }
    return docs, junk, planted


def test_whole_run(spark, tmp_path):
    docs, junk, planted = corpus()
    rows = [(k, t, "en", "web", len(t)) for part in (docs, junk, planted) for k, t in part.items()] + [(None, docs[9] + "\nwith no id", "en", "web", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k in docs), 0) for k in (*docs, *junk)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, now = [], table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == table.columns, name
        now = now.cache()
        kept.append({r.doc_id: r.text for r in now.collect()})
    good, lines, single, clean = kept
    assert set(docs) <= set(good) and not set(junk) & set(good)
    # the copy loses all its lines, each of which stands in its source; the first place of the repeated line stays
    assert 400 not in lines and lines[404].count(LINE) == 1 and "Mondey" not in lines[405] and all(lines[k] == docs[k] for k in docs)
    assert set(single) <= set(lines) and set(lines) - set(single) <= {401, 403}
    assert set(single) - set(clean) == {402} and None in clean
    assert set(docs) <= set(clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    tok = packing.tokenizer(packing.VOCABULARY)
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for k, t in clean.items()}
    assert {r.doc_id: r.ids_crc32 for r in packed if not r.start and r.length == len(ids[r.doc_id])} == {k: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in v)) for k, v in ids.items()}
    whole = sorted((r.doc_id or -1, r.piece, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert whole == sorted((r.doc_id or -1, r.piece, r.length) for r in packed)


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, kind in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
