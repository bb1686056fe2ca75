"""Queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontamination, extraction, line_dedup, packing, pii, quality, simhash, spelling, substring_dedup, token_counts, topk, warc, whitening
from .common import table


def op1_benchmark_decontamination(spark, sf_dir):
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_html_extraction(spark, sf_dir):
    return extraction.main_text(table(spark, sf_dir, "pages"))


def op6_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % topk.EVERY == 0))


def op7_pii(spark, sf_dir):
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark, sf_dir):
    out = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))  # null where it is beyond a long


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_best_fit_packing, op3_line_dedup, op4_substring_dedup, op5_html_extraction,
        op6_exact_top_k, op7_pii, op8_simhash_near_dedup, op9_quality_classifier, op10_warc_round_trip,
        op11_token_counts, op12_spelling_variants, op13_embedding_whitening,
    )
}

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLES = {
    "op4_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
q AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS least FROM q GROUP BY s),
hit AS (SELECT q.doc_id, q.i FROM q JOIN m USING (s) WHERE m.least < q.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM hit),
lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(ks, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)""",
    "op6_exact_top_k": """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, list_resize(v, (SELECT max(len(v)) FROM f), CAST(0 AS DOUBLE)) AS v FROM f),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    # the checksum goes through the half bytes of the text, the lower one of each byte first
    "op12_spelling_variants": """
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT i, run, count(*) AS c, hex(i || ':' || run) AS x FROM runs WHERE length(run) >= 6 GROUP BY ALL),
halves AS (SELECT *, list_transform(range(0, length(x)), lambda k: strpos('0123456789ABCDEF', substr(x, k + 2 - 2 * (k % 2), 1)) - 1) AS h FROM counted),
sums AS (SELECT i, run, c, xor(list_reduce(h, lambda a, b: xor(a >> 4,
   [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][xor(a, b) % 16 + 1]),
   CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS crc FROM halves),
w AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, sum(c) AS n FROM sums GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
v AS (SELECT word, substr(word, 1, k - 1) || '_' || substr(word, k + 1) AS hole, substr(word, 1, k - 1) || substr(word, k + 1) AS shorter FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w)),
near AS (SELECT a.word, b.word AS other FROM v a JOIN v b USING (hole) WHERE a.word <> b.word
  UNION SELECT v.word, w.word FROM v JOIN w ON v.shorter = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.shorter = w.word),
best AS (SELECT near.word, count(*) AS n_near, min({'less': -w.n, 'form': other}) AS b FROM near JOIN w ON w.word = other GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 5 * w.n THEN b.form END AS form, CASE WHEN -b.less >= 5 * w.n THEN -b.less END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, form, word AS at, form AS next FROM f UNION ALL SELECT c.word, c.form, c.next, f.form FROM chain c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, CAST(f.n AS BIGINT) AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN chain c ON c.word = f.word AND c.next IS NULL""",
}
