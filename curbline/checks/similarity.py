"""Neighbour and duplicate queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import issue_categories
from ..operators import dedup as D, voting as V
from ..operators.metrics import evaluate_pairs
from ..operators.similarity import knn_join
from ..operators.sparse_join import cosine_pairs
from ..operators.text_vectors import pair_distances
from ..plans import tables as T
from ..plans.tables import sql
from ..plans.triage import with_text_vectors
from ..runtime import settle
from .collect import collection
from .text import TOKENS_SQL, WORD, category_sql, mask_sql, strip_sql

query, QUERIES, SQL = collection()

# The given vectors lie at least 0.48 apart, so the limits here are wider than the defaults.
NEAR = 0.8
K = 10

PAIRS_SQL = f"""
vecs AS (
  SELECT id, agency, created_date, CAST(vector AS DOUBLE[]) AS v,
         sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))) AS n
  FROM embedded
), pairs AS (
  SELECT q.id AS q_id, b.id AS b_id, b.agency, b.created_date AS b_at, q.created_date AS q_at,
         round(1 - list_dot_product(q.v, b.v) / (q.n * b.n), 9) AS distance
  FROM vecs q JOIN vecs b ON q.id <> b.id
), near AS (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, b_id) AS rank
  FROM pairs WHERE distance <= {NEAR}
)"""

VOTE_SQL = f"""
tally AS (
  SELECT q_id, agency, count(*) AS votes, min(rank) AS seen FROM near
  WHERE rank <= {K} AND agency IN ('DEP', 'DOT', 'DPR', 'HPD', 'DOB', 'NYPD', 'DSNY')
  GROUP BY q_id, agency
), voted AS (
  SELECT q_id, arg_max(agency, votes * 1000 - seen) AS agency,
         max(votes) / sum(votes) AS confidence, CAST(sum(votes) AS BIGINT) AS neighbors
  FROM tally GROUP BY q_id
)"""


@query(sql("""
SELECT m.vec_id, e.event_type, m.label FROM embeddings m JOIN events e ON e.event_id = m.vec_id"""))
def lookup_join(spark, sf_dir):
    m, e = T.table(spark, sf_dir, "embeddings"), T.table(spark, sf_dir, "events")
    return m.join(e, m.vec_id == e.event_id).select("vec_id", "event_type", "label")


RECALL_LIMIT, RECALL_GOAL = 0.6, 0.9


@query(sql(f"""
SELECT count(DISTINCT q_id) AS queries, count(*) AS exact, true AS reached
FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, b_id) AS r
      FROM pairs WHERE distance <= {RECALL_LIMIT}) WHERE r <= {K}""", T.EMBEDDED_SQL, PAIRS_SQL))
def knn_recall(spark, sf_dir):
    """Hashed against exact search: the neighbours there are, and whether the stated recall is reached."""
    rows = T.embedded(spark, sf_dir)
    options = {"k": K, "max_distance": RECALL_LIMIT}
    exact = knn_join(rows, rows, **options).select("q_id", "b_id")
    hashed = knn_join(rows, rows, method="lsh", recall=RECALL_GOAL, bits=8, **options).select(
        "q_id", "b_id", F.lit(True).alias("hit")
    )
    both = exact.join(hashed, ["q_id", "b_id"], "left")
    return both.agg(
        F.countDistinct("q_id").alias("queries"),
        F.count("*").alias("exact"),
        (F.count("hit") >= RECALL_GOAL * F.count("*")).alias("reached"),
    )


@query(sql(f"SELECT q_id, b_id, distance, rank FROM near WHERE rank <= {K}",
           T.EMBEDDED_SQL, PAIRS_SQL))
def knn_neighbours(spark, sf_dir):
    rows = T.embedded(spark, sf_dir)
    near = knn_join(rows, rows, k=K, max_distance=NEAR)
    return near.select("q_id", "b_id", "distance", F.col("rank").cast("bigint").alias("rank"))


@query(sql("SELECT q_id AS vec_id, agency, round(confidence, 6) AS confidence, neighbors FROM voted",
           T.EMBEDDED_SQL, PAIRS_SQL, VOTE_SQL))
def knn_vote(spark, sf_dir):
    rows = T.embedded(spark, sf_dir)
    near = knn_join(rows, rows, k=K, max_distance=NEAR)
    votes = V.vote(V.lookup_neighbours(near, rows, "id", ["agency"]))
    return votes.select(
        F.col("q_id").alias("vec_id"),
        "agency",
        F.round("confidence", 6).alias("confidence"),
        "neighbors",
    )


CHEAP_SQL = """
cheap AS (
  SELECT t.id, coalesce(v.agency, p.prior) AS agency,
         coalesce(v.confidence, CASE WHEN p.prior IS NULL THEN 0.0 ELSE 0.5 END) AS confidence,
         CASE WHEN v.agency IS NULL THEN 'prior' ELSE 'cheap-knn' END AS tier,
         coalesce(v.neighbors, 0) AS neighbors
  FROM tickets t LEFT JOIN voted v ON v.q_id = t.id
       LEFT JOIN (VALUES ('Water System', 'DEP'), ('Sewer', 'DEP'), ('Street Condition', 'DOT'),
                         ('Noise - Residential', 'NYPD'), ('Plumbing', 'HPD')) p(ct, prior)
         ON p.ct = t.complaint_type
)"""


@query(sql("SELECT id, agency, round(confidence, 6) AS confidence, tier, neighbors FROM cheap",
           T.TICKETS_SQL, T.EMBEDDED_SQL, PAIRS_SQL, VOTE_SQL, CHEAP_SQL))
def cheap_prediction(spark, sf_dir):
    labelled = T.embedded(spark, sf_dir)
    rows = T.bare_tickets(spark, sf_dir).join(labelled.select("id", "vector"), "id", "left")
    cheap = V.cheap_tier(rows, labelled, k=K, max_distance=NEAR)
    return cheap.withColumn("confidence", F.round("confidence", 6))


@query(sql(f"""
SELECT q_id, b_id, distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, b_id) AS rank
  FROM pairs
  WHERE distance <= {NEAR} AND b_at < q_at AND CAST(b_id AS BIGINT) % 10 <> 0
    AND NOT (CAST(b_id AS BIGINT) % 3 = 0 AND CAST(b_id AS BIGINT) + 7 = CAST(q_id AS BIGINT)))
WHERE rank <= 5""", T.EMBEDDED_SQL, PAIRS_SQL))
def as_of_retrieval(spark, sf_dir):
    rows = T.embedded(spark, sf_dir)
    base = rows.select(
        "*",
        F.when(F.col("event_id") % 10 == 0, F.lit("x")).alias("duplicate_of"),
        F.when(F.col("event_id") % 3 == 0, (F.col("event_id") + 7).cast("string")).alias("parent"),
    )
    near = V.as_of_neighbours(rows, base, k=5, max_distance=NEAR, parent="parent")
    return near.select("q_id", "b_id", "distance", F.col("rank").cast("bigint").alias("rank"))


@query(sql(f"""
SELECT q_id, b_id, distance, rank, 'r' || CAST(CAST(b_id AS BIGINT) % 5 AS VARCHAR) AS resolution
FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, b_id) AS rank
  FROM pairs
  WHERE distance <= {NEAR} AND CAST(b_id AS BIGINT) % 2 = 0
    AND b_at + (CAST(b_id AS BIGINT) % 4 + 1) * INTERVAL 1 HOUR < q_at)
WHERE rank <= 3""", T.EMBEDDED_SQL, PAIRS_SQL))
def past_resolutions(spark, sf_dir):
    rows = T.embedded(spark, sf_dir)
    hours = (F.col("event_id") % 4 + 1).cast("int")
    base = rows.select(
        "*",
        F.when(
            F.col("event_id") % 2 == 0,
            F.col("created_date") + F.make_dt_interval(F.lit(0), hours),
        ).alias("closed_date"),
        F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("resolution"),
    )
    near = V.historical_resolutions(rows, base, k=3, max_distance=NEAR)
    return near.select(
        "q_id", "b_id", "distance", F.col("rank").cast("bigint").alias("rank"), "resolution"
    )


# All tickets by their masked request text; some without time or place, to exercise the dropped
# predicates. Most have no descriptor, so their type alone is their text: many are copies.
GEO, DAYS, ALIKE = 600.0, 1, 0.15
REQUEST_SQL = f"""
requests AS (
  SELECT id, {mask_sql(strip_sql("regexp_replace(regexp_replace(complaint_type || ': ' || coalesce(descriptor, ''), '^[: ]+', ''), '[: ]+$', '')"))} AS request
  FROM tickets
), words AS (
  SELECT id, unnest(regexp_extract_all(lower(request), '[{WORD}]+')) AS token FROM requests
), word_slots AS (
  SELECT id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 64 AS slot, count(*) AS n FROM words GROUP BY 1, 2
), request_vectors AS (
  SELECT d.id, list(coalesce(s.n, 0)::DOUBLE ORDER BY r.slot) AS vector
  FROM (SELECT DISTINCT id FROM word_slots) d CROSS JOIN range(64) r(slot)
       LEFT JOIN word_slots s ON s.id = d.id AND s.slot = r.slot
  GROUP BY d.id
)"""
TEXT_TICKETS_SQL = f"""
reports AS (
  SELECT t.id, t.complaint_type, t.descriptor, h.vector,
         CASE WHEN t.event_id % 17 = 5 THEN NULL ELSE t.created_date END AS created_date,
         CASE WHEN t.event_id % 13 = 7 THEN NULL ELSE t.latitude END AS latitude, t.longitude
  FROM tickets t JOIN request_vectors h ON h.id = t.id
), placed AS (
  SELECT *, row_number() OVER (ORDER BY created_date NULLS LAST, id) AS pos,
         sqrt(list_dot_product(vector, vector)) AS n,
         {GEO} / 111320.0 AS dy,
         {GEO} / (111320.0 * greatest(cos(radians(latitude)), 1e-6)) AS dx
  FROM reports
), windowed AS (
  SELECT t.id AS t_id, c.id AS c_id, t.pos AS t_pos, c.pos AS c_pos, c.created_date AS c_at,
         round(1 - list_dot_product(t.vector, c.vector) / (t.n * c.n), 9) AS distance
  FROM placed t JOIN placed c ON c.id <> t.id
   AND (t.created_date IS NULL OR (c.created_date >= t.created_date - INTERVAL {DAYS} DAY
                                   AND c.created_date <= t.created_date))
   AND (t.latitude IS NULL OR t.longitude IS NULL
        OR (c.latitude BETWEEN t.latitude - t.dy AND t.latitude + t.dy
            AND c.longitude BETWEEN t.longitude - t.dx AND t.longitude + t.dx))
), edges AS MATERIALIZED (
  SELECT * FROM windowed WHERE distance <= {ALIKE}
), nearest AS (
  SELECT t_id, c_id, distance, candidates FROM (
    SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY distance, c_at NULLS LAST, c_id) AS r,
           count(*) OVER (PARTITION BY t_id) AS candidates
    FROM edges) WHERE r = 1
)"""


def reports(spark, sf_dir):
    rows = T.tickets_table(T.tickets(spark, sf_dir)).withColumn(
        "created_date", F.when(F.col("event_id") % 17 != 5, F.col("created_date"))
    ).withColumn("latitude", F.when(F.col("event_id") % 13 != 7, F.col("latitude")))
    return with_text_vectors(rows)


@query(sql("SELECT t_id, c_id, distance, candidates FROM nearest",
           T.TICKETS_SQL, REQUEST_SQL, TEXT_TICKETS_SQL))
def nearest_candidate(spark, sf_dir):
    near = D.nearest_candidate(
        reports(spark, sf_dir), threshold=ALIKE, geo_metres=GEO, time_days=DAYS
    )
    return near.select(
        F.col("q_id").alias("t_id"), F.col("b_id").alias("c_id"), "distance", "candidates"
    )


CANONICAL_SQL = """
earlier AS MATERIALIZED (
  SELECT t_pos, c_pos FROM edges WHERE c_pos < t_pos
), rounds(pos, state) USING KEY (pos) AS (
  SELECT pos, 0 FROM placed
  UNION
  (SELECT u.pos, CASE WHEN bool_or(n.state = 1) THEN 2 ELSE 1 END
   FROM (SELECT pos FROM recurring.rounds WHERE state = 0) u
        LEFT JOIN earlier e ON e.t_pos = u.pos LEFT JOIN recurring.rounds n ON n.pos = e.c_pos
   GROUP BY u.pos HAVING coalesce(bool_or(n.state = 1), false) OR coalesce(bool_and(n.state = 2), true))
), decided AS (
  SELECT pos FROM rounds WHERE state = 1
), links AS (
  SELECT t_id AS dup_id, c_id AS canonical_id, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY distance, c_at NULLS LAST, c_id) AS k
    FROM edges WHERE c_pos < t_pos AND c_pos IN (SELECT pos FROM decided)
                 AND t_pos NOT IN (SELECT pos FROM decided)) WHERE k = 1
)"""


@query(sql("SELECT dup_id, canonical_id, distance FROM links",
           T.TICKETS_SQL, REQUEST_SQL, TEXT_TICKETS_SQL, CANONICAL_SQL))
def canonical_assignment(spark, sf_dir):
    return D.assign_canonical(
        reports(spark, sf_dir), threshold=ALIKE, geo_metres=GEO, time_days=DAYS
    )


@query(sql("""
SELECT r.id, l.canonical_id AS duplicate_of,
       CASE WHEN l.dup_id IS NULL THEN 'INGESTED' ELSE 'DUPLICATE' END AS status,
       1 + coalesce(g.n, 0) AS report_count
FROM reports r LEFT JOIN links l ON l.dup_id = r.id
     LEFT JOIN (SELECT canonical_id, count(*) AS n FROM links GROUP BY 1) g ON g.canonical_id = r.id""",
           T.TICKETS_SQL, REQUEST_SQL, TEXT_TICKETS_SQL, CANONICAL_SQL))
def duplicate_links(spark, sf_dir):
    rows = settle(reports(spark, sf_dir))
    links = D.assign_canonical(rows, threshold=ALIKE, geo_metres=GEO, time_days=DAYS)
    return D.link_duplicates(rows, links).select("id", "duplicate_of", "status", "report_count")


@query(sql(f"""
SELECT p.id AS q_id, n.c_id AS b_id, n.distance,
       CASE WHEN n.c_id IS NULL THEN 'none'
            WHEN n.distance <= 0.05
             AND len(list_filter({category_sql("lower(coalesce(p.descriptor, ''))")},
                 lambda x: NOT list_contains({category_sql("lower(coalesce(c.descriptor, ''))")}, x))) = 0 THEN 'auto'
            ELSE 'review' END AS band
FROM placed p LEFT JOIN nearest n ON n.t_id = p.id LEFT JOIN placed c ON c.id = n.c_id""",
           T.TICKETS_SQL, REQUEST_SQL, TEXT_TICKETS_SQL))
def dedup_bands(spark, sf_dir):
    rows = settle(reports(spark, sf_dir))
    near = D.nearest_candidate(rows, threshold=ALIKE, geo_metres=GEO, time_days=DAYS)
    noted = rows.select("id", issue_categories(F.col("descriptor")).alias("categories"))
    return D.dedup_bands(near, noted, auto=0.05, review=ALIKE).drop("new_categories")


ALIKE_SQL = """
tf AS MATERIALIZED (
  SELECT doc_id, token, count(*) AS n FROM toks GROUP BY 1, 2
), listed AS (
  SELECT doc_id, string_agg(token || ':' || n, ' ' ORDER BY token) AS v, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm
  FROM tf GROUP BY 1
), classed AS MATERIALIZED (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(v)) AS root, norm FROM listed
), root_tf AS MATERIALIZED (
  SELECT t.* FROM tf t JOIN classed c ON c.doc_id = t.doc_id AND c.root = t.doc_id
), alike AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(a.n * b.n) AS dot
  FROM root_tf a JOIN root_tf b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY 1, 2
)"""


@query(sql("""
SELECT a, b, round(CAST(dot AS DOUBLE) / (x.norm * y.norm), 9) AS cosine
FROM alike JOIN classed x ON x.doc_id = a JOIN classed y ON y.doc_id = b
WHERE round(CAST(dot AS DOUBLE) / (x.norm * y.norm), 9) >= 0.9""", TOKENS_SQL, ALIKE_SQL))
def text_cosine_pairs(spark, sf_dir):
    """All pairs of distinct texts whose token counts have a cosine of 0.9 or more."""
    docs = T.table(spark, sf_dir, "documents")
    return cosine_pairs(docs, "doc_id", "text", 0.9).pairs


@query(sql("SELECT doc_id, root FROM classed", TOKENS_SQL, ALIKE_SQL))
def text_classes(spark, sf_dir):
    """The documents whose token counts are equal, by the smallest of them."""
    docs = T.table(spark, sf_dir, "documents")
    return cosine_pairs(docs, "doc_id", "text", 0.9).members


PAIR_SQL = """
pairset AS (
  SELECT l.doc_id, l.quality = 1 AS label, l.quality = 1 AS ann1, l.toxic = 0 AS ann2
  FROM labels l JOIN documents b ON b.doc_id = l.doc_id + 1
), counts AS (
  SELECT doc_id, token, count(*) AS n FROM toks GROUP BY 1, 2
), norms AS (
  SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM counts GROUP BY 1
), dots AS (
  SELECT a.doc_id, CAST(sum(a.n * b.n) AS DOUBLE) AS dot
  FROM counts a JOIN counts b ON b.doc_id = a.doc_id + 1 AND b.token = a.token GROUP BY 1
), dist AS (
  SELECT p.*, round(1 - coalesce(d.dot / (x.norm * y.norm), 0), 9) AS distance
  FROM pairset p LEFT JOIN dots d USING (doc_id) LEFT JOIN norms x ON x.doc_id = p.doc_id
       LEFT JOIN norms y ON y.doc_id = p.doc_id + 1
)"""


def _pairs(spark, sf_dir):
    labels = T.table(spark, sf_dir, "labels")
    a = T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text_a"))
    b = T.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text_b")
    )
    return labels.join(a, "doc_id").join(b, "doc_id").select(
        "doc_id",
        "text_a",
        "text_b",
        (F.col("quality") == 1).alias("label"),
        (F.col("quality") == 1).alias("ann1"),
        (F.col("toxic") == 0).alias("ann2"),
    )


@query(sql("SELECT doc_id, distance FROM dist", TOKENS_SQL, PAIR_SQL))
def text_pair_distances(spark, sf_dir):
    return pair_distances(_pairs(spark, sf_dir), "doc_id").select("doc_id", "distance")


SCORES_SQL = """
c AS (
  SELECT count(*) FILTER (label AND distance <= 0.5) AS tp,
         count(*) FILTER (NOT label AND distance <= 0.5) AS fp,
         count(*) FILTER (label AND NOT distance <= 0.5) AS fn, count(*) AS n,
         count(*) FILTER (ann1 = ann2) / count(*) AS po,
         (count(*) FILTER (ann1) * count(*) FILTER (ann2)
          + count(*) FILTER (NOT ann1) * count(*) FILTER (NOT ann2))
           / (count(*) * CAST(count(*) AS DOUBLE)) AS pe
  FROM dist
)"""


@query(sql("""
SELECT tp, fp, fn, n, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall,
       round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round((po - pe) / (1 - pe), 6) AS kappa
FROM c""", TOKENS_SQL, PAIR_SQL, SCORES_SQL))
def pair_evaluation(spark, sf_dir):
    rows = pair_distances(_pairs(spark, sf_dir), "doc_id")
    scores = evaluate_pairs(rows, F.col("distance") <= 0.5)
    return scores.withColumns(
        {c: F.round(c, 6) for c in ("precision", "recall", "f1", "kappa")}
    )
