"""One query per operator over its whole table, and the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..checks.collect import collection
from . import byte_bpe, centroids, classifier, decontamination, exact_dedup, hard_negatives, jaccard_join, pseudonyms
from . import simhash, substring_dedup, suffix_dedup, token_files, warc
from .common import shared_folder, table, token_pattern, tokenizer_file

query, QUERIES, SQL = collection()


@query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS l, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS g
  FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM w, ls WHERE len(ws) >= l)),
m AS (SELECT doc_id, item_id, i, dw.l FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 13-word windows of the benchmark."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit, n_words = F.col("n_hit").cast("long"), F.col("n_words").cast("long")
    return found.select(
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated(n_hit, n_words).alias("contaminated"),
    )


@query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = classifier.fit(docs, labels.where(~classifier.held_out(F.col("doc_id"))))
    scored = classifier.score(docs, model)
    return scored.select(
        "doc_id",
        classifier.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the multilingual rank file, and the digest of what they decode to."""
    path, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), token_pattern()
    return byte_bpe.digests(table(spark, sf_dir, "documents"), path, pattern)


@query()
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every text to token files and reads them back."""
    manifest = token_files.written(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return token_files.checksums(manifest)


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to WARC archives and reads the archives back."""
    archives = warc.written(table(spark, sf_dir, "pages"))
    return warc.read(archives).drop("url")


@query("""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, from an extendible-hash index of all documents."""
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.build(docs, shared_folder(spark, "exact"))
    return exact_dedup.groups(docs, index)


@query(r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
""")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 5-word shingles overlap by 0.75 or more."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
m AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS again FROM s),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM m WHERE again),
k AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN h USING (doc_id, p)),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM k GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(t.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id)
""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes words under 50-word windows that an earlier document has."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query()
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes bytes under 200-byte strings that occur more than once."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: A fixed key, so that results can be compared; users bring their own secret.
DEMO_KEY = b"a key for tests and reports"


@query()
def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal numbers, dates and addresses under pseudonyms."""
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


@query()
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 64-bit SimHash fingerprints differ in at most two bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_SOUND = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
#: Ten rounds written out; every step is materialised, else each would be computed twice.
_CENTROIDS_SQL = f"""
WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND {_SOUND}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS c, v FROM k QUALIFY c < 8),
""" + ",".join(
    f"""
a{r} AS MATERIALIZED (SELECT vec_id, k.v, c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c{r}.v[i]) * (k.v[i] - c{r}.v[i])))::BIGINT AS d
  FROM k, c{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
  FROM (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) m USING (c))"""
    for r in range(10)
) + """,
f AS MATERIALIZED (SELECT vec_id, c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c10.v[i]) * (k.v[i] - c10.v[i])))::BIGINT AS d, c10.v AS m
  FROM k, c10 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM f
"""


@query(_CENTROIDS_SQL)
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten exact rounds over subvector dictionaries."""
    return centroids.report(*centroids.cluster(table(spark, sf_dir, "embeddings")))


@query(f"""
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {_SOUND}),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INTEGER AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score 50 to 95 percent of an anchor's best rows of its own label."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("id") % 50 == 0)


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
