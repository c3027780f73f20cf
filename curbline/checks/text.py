"""Text queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy as X, text as N
from ..functions.redaction import STREET_SUFFIXES, pii_census, redact
from ..operators.governance import jurisdictions
from ..operators.landing import vectorize
from ..operators.monitoring import field_inventory, stratified_sample
from ..operators.ordering import first_n
from ..operators.routing import decode_responses, export_requests, ground_truth
from ..operators.profiling import profile_ambiguity
from ..operators.text_vectors import hashed_vectors, term_counts
from ..plans import tables as T
from ..plans.tables import sql
from ..runtime import spread
from .collect import collection

query, QUERIES, SQL = collection()

# RE2 has no Unicode \w or \b and no look-around: the twins spell word characters out.
WORD = r"\p{L}\p{M}\p{N}\p{Pc}"
EDGE = rf"(^|[^{WORD}])"
EMAIL_RE = rf"{EDGE}[{WORD}][{WORD}.+-]*@[{WORD}-]+\.[{WORD}.-]*[{WORD}]"
PHONE_RE = (
    r"(^|[^0-9])(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}($|[^0-9])"
)
ADDRESS_RE = (
    rf"(?i){EDGE}[0-9]{{1,5}}\s+(?:[A-Za-z0-9.''-]+\s){{0,4}}(?:{STREET_SUFFIXES})"
    rf"(?:\.|($|[^{WORD}]))"
)


def strip_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^\s+', ''), '\s+$', '')"


def mask_sql(c: str) -> str:
    text = rf"regexp_replace({c}, '{EMAIL_RE}', '\1[REDACTED_EMAIL]', 'g')"
    for _ in range(2):  # neighbours share their separator, so a second pass is needed
        text = rf"regexp_replace({text}, '{PHONE_RE}', '\1[REDACTED_PHONE]\2', 'g')"
    for _ in range(2):
        text = rf"regexp_replace({text}, '{ADDRESS_RE}', '\1[REDACTED_ADDRESS]\2', 'g')"
    return text


def category_sql(c: str, table=None) -> str:
    """Sorted list of issue categories of a lower-cased text."""
    table = table or X.ISSUE_KEYWORDS
    cases = ", ".join(
        f"CASE WHEN regexp_matches({c}, '{EDGE}(?:{'|'.join(table[k])})') THEN '{k}' END"
        for k in sorted(table)
    )
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


FLAGS_SQL = rf"""
low AS (
  SELECT doc_id, lang, source, text, lower(coalesce(text, '')) AS low FROM documents
), catted AS (
  SELECT *, {category_sql('low')} AS categories FROM low
), flags AS (
  SELECT doc_id, lang, source, text, categories,
         length({strip_sql("coalesce(text, '')")}) < 12 AS thin_text,
         len(categories) >= 2 OR (
           (contains(low, ' and ') OR contains(low, '; ') OR contains(low, ' also ')
            OR contains(low, ' plus ') OR contains(low, ' as well as ') OR contains(low, '&'))
           AND len(categories) >= 1
           AND len(regexp_extract_all(low, '[{WORD}]+')) >= 6) AS multi_issue
  FROM catted
)"""


def _documents(spark, sf_dir):
    return spread(T.table(spark, sf_dir, "documents"))


@query(sql(rf"""
SELECT id, {strip_sql("regexp_replace(regexp_replace(complaint_type || ': ' || coalesce(descriptor, ''), '^[: ]+', ''), '[: ]+$', '')")}
         AS text
FROM tickets""", T.TICKETS_SQL))
def ticket_text(spark, sf_dir):
    return T.tickets(spark, sf_dir).select(
        "id", N.ticket_text(F.col("complaint_type"), F.col("descriptor")).alias("text")
    )


@query(f"SELECT doc_id, {mask_sql('text')} AS text FROM documents")
def redaction(spark, sf_dir):
    return redact(_documents(spark, sf_dir).select("doc_id", "text"), ["text"])


@query(rf"""
SELECT lang, count(*) AS n,
       count(*) FILTER (regexp_matches(text, '{EMAIL_RE}')) AS n_email,
       count(*) FILTER (regexp_matches(text, '{PHONE_RE}')) AS n_phone,
       count(*) FILTER (regexp_matches(text, '{ADDRESS_RE}')) AS n_address,
       count(*) FILTER (regexp_matches(text, '{EMAIL_RE}') OR regexp_matches(text, '{PHONE_RE}')
                        OR regexp_matches(text, '{ADDRESS_RE}')) AS n_pii
FROM documents GROUP BY lang""")
def pii_counts(spark, sf_dir):
    return pii_census(_documents(spark, sf_dir), "text", ["lang"])


@query(sql("""
SELECT doc_id, list_aggregate(categories, 'string_agg', ',') AS categories, thin_text, multi_issue,
       thin_text OR multi_issue AS ambiguous
FROM flags""", FLAGS_SQL))
def text_flags(spark, sf_dir):
    rows = N.text_flags(_documents(spark, sf_dir), "text")
    joined = F.when(F.size("categories") > 0, F.array_join("categories", ","))
    return rows.select(
        "doc_id", joined.alias("categories"), "thin_text", "multi_issue", "ambiguous"
    )


TICKET_FLAGS_SQL = f"""
ticket_words AS (
  SELECT id, descriptor, lower(coalesce(descriptor, '')) AS low FROM tickets
), ticket_noted AS (
  SELECT *, {category_sql('low')} AS categories FROM ticket_words
), ticket_flags AS (
  SELECT id, descriptor, length({strip_sql("coalesce(descriptor, '')")}) < 12 AS thin_text,
         len(categories) >= 2
         OR (len(categories) >= 1 AND ({' OR '.join(f"contains(low, '{c}')" for c in X.CONNECTORS)})
             AND len(regexp_extract_all(low, '[{WORD}]+')) >= 6) AS multi_issue
  FROM ticket_noted
)"""


@query(sql("""
SELECT count(*) AS total, count(*) FILTER (thin_text) AS thin_text,
       count(*) FILTER (multi_issue) AS multi_issue,
       count(*) FILTER (thin_text OR multi_issue) AS ambiguous,
       round(count(*) FILTER (thin_text OR multi_issue) / count(*), 4) AS ambiguous_fraction,
       (SELECT string_agg(descriptor, '|' ORDER BY id)
        FROM (SELECT * FROM ticket_flags WHERE multi_issue ORDER BY id LIMIT 10)) AS examples
FROM ticket_flags""", T.TICKETS_SQL, TICKET_FLAGS_SQL))
def ambiguity_profile(spark, sf_dir):
    profile = profile_ambiguity(T.tickets_table(T.tickets(spark, sf_dir)))
    return profile.withColumn("examples", F.array_join("examples", "|"))


HITS_SQL = f"""
hits AS (
  SELECT id, {category_sql("lower(complaint_type || ' ' || coalesce(descriptor, ''))")} AS c
  FROM tickets
)"""


@query(sql("""
SELECT id, coalesce(list_aggregate(list_sort(list_distinct(list_transform(c, lambda x: CASE x
         WHEN 'water' THEN 'DEP' WHEN 'sewer' THEN 'DEP' WHEN 'structural' THEN 'DOB' WHEN 'heat' THEN 'HPD'
         WHEN 'tree' THEN 'DPR' WHEN 'noise' THEN 'NYPD' ELSE 'DOT' END))), 'string_agg', ','), '') AS agencies,
       len(list_distinct(list_transform(c, lambda x: CASE x
         WHEN 'water' THEN 'DEP' WHEN 'sewer' THEN 'DEP' WHEN 'structural' THEN 'DOB' WHEN 'heat' THEN 'HPD'
         WHEN 'tree' THEN 'DPR' WHEN 'noise' THEN 'NYPD' ELSE 'DOT' END))) >= 2 AS is_multi
FROM hits""", T.TICKETS_SQL, HITS_SQL))
def multi_agency(spark, sf_dir):
    rows = N.multi_agency(T.tickets(spark, sf_dir))
    return rows.select("id", F.array_join("agencies", ",").alias("agencies"), "is_multi")


JURISDICTION_ROWS = [
    (X.ISSUE_OWNER[c], c) for c in ("water", "sewer", "structural", "tree", "noise", "street")
]


@query(sql("""
SELECT c.category, coalesce(CASE c.category WHEN 'water' THEN 'DEP' WHEN 'sewer' THEN 'DEP'
         WHEN 'structural' THEN 'DOB' WHEN 'tree' THEN 'DPR' WHEN 'noise' THEN 'NYPD'
         WHEN 'street' THEN 'DOT' END, 'unknown') AS code, count(*) AS n
FROM (SELECT unnest(categories) AS category FROM flags) c GROUP BY 1, 2""", FLAGS_SQL))
def jurisdiction_lookup(spark, sf_dir):
    agencies = spark.createDataFrame(JURISDICTION_ROWS, "code string, category string")
    rows = jurisdictions(N.text_flags(_documents(spark, sf_dir), "text"), agencies)
    return rows.groupBy("category", F.coalesce("code", F.lit("unknown")).alias("code")).agg(
        F.count("*").alias("n")
    )


@query("""
SELECT vec_id, code, nullif(upper(trim(code)), '') AS agency,
       coalesce(upper(trim(code)) IN ('DEP', 'DOT', 'DPR', 'HPD', 'DOB', 'NYPD', 'DSNY'), false)
         AS valid
FROM (SELECT vec_id, CASE label WHEN 0 THEN ' dep ' WHEN 1 THEN 'Dot' WHEN 2 THEN '' WHEN 3 THEN NULL
        WHEN 4 THEN 'hpd' WHEN 5 THEN '  ' WHEN 6 THEN 'NYPD' ELSE 'FBI' END AS code
      FROM embeddings)""")
def agency_codes(spark, sf_dir):
    code = F.expr("""CASE label WHEN 0 THEN ' dep ' WHEN 1 THEN 'Dot' WHEN 2 THEN ''
        WHEN 3 THEN NULL WHEN 4 THEN 'hpd' WHEN 5 THEN '  ' WHEN 6 THEN 'NYPD' ELSE 'FBI' END""")
    rows = T.table(spark, sf_dir, "embeddings").select("vec_id", code.alias("code"))
    return rows.select(
        "vec_id",
        "code",
        X.clean_code(F.col("code")).alias("agency"),
        X.is_agency(F.col("code")).alias("valid"),
    )


@query(sql("""
SELECT id, upper(trim(json_extract_string(
         '{"unique_key": "' || id || '", "agency": " ' || lower(agency) || ' "}', '$.agency')))
         AS agency
FROM embedded""", T.EMBEDDED_SQL))
def ground_truth_agency(spark, sf_dir):
    payload = F.concat(
        F.lit('{"unique_key": "'), "id", F.lit('", "agency": " '), F.lower("agency"), F.lit(' "}')
    )
    return T.embedded(spark, sf_dir).select("id", ground_truth(payload).alias("agency"))


@query(sql("""
SELECT complaint_type, prior, count(*) AS n FROM (
  SELECT complaint_type, CASE complaint_type WHEN 'Water System' THEN 'DEP' WHEN 'Sewer' THEN 'DEP'
         WHEN 'Street Condition' THEN 'DOT' WHEN 'Noise - Residential' THEN 'NYPD'
         WHEN 'Plumbing' THEN 'HPD' END AS prior
  FROM tickets) GROUP BY 1, 2""", T.TICKETS_SQL))
def type_prior(spark, sf_dir):
    rows = T.bare_tickets(spark, sf_dir).select(
        "complaint_type", X.usual_agency(F.col("complaint_type")).alias("prior")
    )
    return rows.groupBy("complaint_type", "prior").agg(F.count("*").alias("n"))


# A model answer per scored event: good, chatty, out of the set, prose, cut off, not strict
# JSON, two objects, a confidence that is null, text or true, or failed.
ANSWER = """
  CASE event_id % 16
    WHEN 0 THEN concat('{"agency": "', truth, '", "confidence": ', CAST(k AS STRING), '}')
    WHEN 1 THEN concat('Sure: {"agency": "', lower(truth), ' ", "confidence": 0.', CAST(k AS STRING),
                       '} - hope it helps')
    WHEN 2 THEN '{"agency": "FBI", "confidence": 0.9}'
    WHEN 3 THEN 'I would call the city'
    WHEN 4 THEN concat('{"agency": "', truth, '"')
    WHEN 5 THEN concat('{"agency": "', truth, '", "confidence": -0.5}')
    WHEN 6 THEN concat('{"agency": "', truth, '"}')
    WHEN 8 THEN concat('{', chr(39), 'agency', chr(39), ': "', truth, '", "confidence": 0.9}')
    WHEN 9 THEN concat('{"agency": "', truth, '", "confidence": 0.9} or {"agency": "DEP"}')
    WHEN 10 THEN concat('{"agency": "', truth, '", "confidence": null}')
    WHEN 11 THEN concat('{"agency": "', truth, '", "confidence": "0.9d"}')
    WHEN 12 THEN concat('{"agency": "', truth, '", "confidence": true}')
    WHEN 13 THEN concat('{"agency": "', truth, '", "confidence": "0.4"}')
    ELSE concat('{"agency": "', truth, '", "confidence": 0.8}') END
"""
RESPONSES_SQL = f"""
responses AS (
  SELECT CAST(event_id AS VARCHAR) AS ticket_id, 'groq' AS tier, {ANSWER} AS text,
         event_id % 16 = 7 AS failed
  FROM scored
), spans AS (
  SELECT *, regexp_extract(text, '(?s)\\{{.*\\}}') AS span FROM responses
), parsed AS (
  SELECT *, upper(trim(CASE WHEN json_valid(span) THEN json_extract_string(span, '$.agency') END))
              AS a,
         CASE WHEN NOT json_valid(span) THEN NULL
              WHEN json_type(span, '$.confidence') IS NULL THEN 0.0
              WHEN json_type(span, '$.confidence') = 'BOOLEAN'
              THEN CASE json_extract_string(span, '$.confidence') WHEN 'true' THEN 1.0 ELSE 0.0 END
              ELSE TRY_CAST(json_extract_string(span, '$.confidence') AS DOUBLE) END AS c
  FROM spans
), decoded AS (
  SELECT ticket_id,
         CASE WHEN NOT failed AND c IS NOT NULL AND a IN ('DEP', 'DOT', 'DPR', 'HPD', 'DOB', 'NYPD', 'DSNY')
              THEN a END AS agency,
         CASE WHEN NOT failed AND c IS NOT NULL AND a IN ('DEP', 'DOT', 'DPR', 'HPD', 'DOB', 'NYPD', 'DSNY')
              THEN greatest(0.0, least(1.0, c)) ELSE 0.0 END AS confidence,
         tier || CASE WHEN failed THEN '-error'
                      WHEN c IS NOT NULL AND a IN ('DEP', 'DOT', 'DPR', 'HPD', 'DOB', 'NYPD', 'DSNY') THEN ''
                      ELSE '-malformed' END AS tier
  FROM parsed
)"""


def responses(spark, sf_dir):
    return T.scored(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("ticket_id"),
        F.lit("groq").alias("tier"),
        F.expr(ANSWER).alias("text"),
        (F.col("event_id") % 16 == 7).alias("failed"),
    )


@query(sql("SELECT ticket_id, agency, confidence, tier FROM decoded", T.SCORED_SQL, RESPONSES_SQL))
def model_answers(spark, sf_dir):
    return decode_responses(responses(spark, sf_dir)).drop("neighbors")


@query(sql(rf"""
SELECT id, {mask_sql(strip_sql("regexp_replace(regexp_replace(complaint_type || ': ' || coalesce(descriptor, ''), '^[: ]+', ''), '[: ]+$', '')"))} AS request,
       'DEP, DOB, DOT, DPR, DSNY, HPD, NYPD' AS allowed
FROM tickets WHERE event_id % 10 < 7 OR coalesce(complaint_type, '') NOT IN
     ('Water System', 'Sewer', 'Street Condition', 'Noise - Residential', 'Plumbing')""", T.TICKETS_SQL))
def escalation_export(spark, sf_dir):
    rows = T.tickets(spark, sf_dir)
    # Three in ten tickets have a confident cheap prediction if their type has a usual agency.
    cheap = rows.select(
        "id",
        X.usual_agency(F.col("complaint_type")).alias("agency"),
        F.when(F.col("event_id") % 10 < 7, 0.5).otherwise(0.9).alias("confidence"),
    )
    return export_requests(rows, cheap, "id")


TOKENS_SQL = rf"""
toks AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[{WORD}]+')) AS token FROM documents
)"""


@query(sql("""
SELECT doc_id, count(*) AS terms, CAST(sum(n) AS BIGINT) AS words, CAST(sum(n * n) AS BIGINT) AS square
FROM (SELECT doc_id, token, count(*) AS n FROM toks GROUP BY 1, 2) GROUP BY doc_id""", TOKENS_SQL))
def term_vectors(spark, sf_dir):
    counts = term_counts(_documents(spark, sf_dir), "doc_id", "text")
    return counts.groupBy("doc_id").agg(
        F.count("*").alias("terms"),
        F.sum("n").alias("words"),
        F.sum(F.col("n") * F.col("n")).alias("square"),
    )


HASHED_SQL = """
slots AS (
  SELECT doc_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 64 AS slot, count(*) AS n
  FROM toks GROUP BY 1, 2
), hashed AS (
  SELECT d.doc_id, list(coalesce(s.n, 0)::DOUBLE ORDER BY r.slot) AS vector
  FROM (SELECT DISTINCT doc_id FROM slots) d CROSS JOIN range(64) r(slot)
       LEFT JOIN slots s ON s.doc_id = d.doc_id AND s.slot = r.slot
  GROUP BY d.doc_id
)"""


@query(sql("""
SELECT doc_id, list_aggregate(list_transform(vector, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)),
                              'string_agg', ' ') AS counts
FROM hashed""", TOKENS_SQL, HASHED_SQL))
def text_vectors(spark, sf_dir):
    rows = hashed_vectors(_documents(spark, sf_dir), "doc_id", "text")
    return rows.select(
        "doc_id",
        F.array_join(F.transform("vector", lambda x: x.cast("bigint").cast("string")), " ").alias(
            "counts"
        ),
    )


def _measure(texts):
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query("""
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars,
       CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS blanks
FROM documents""")
def user_vectors(spark, sf_dir):
    rows = vectorize(_documents(spark, sf_dir), _measure, "doc_id", "text")
    return rows.select(
        "doc_id",
        F.col("vector")[0].cast("bigint").alias("chars"),
        F.col("vector")[1].cast("bigint").alias("blanks"),
    )


INVENTORY = ("event_type", "user_id", "props")


@query(f"""
WITH long AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM events" for c in INVENTORY)}
  UNION ALL
  SELECT 'sparse', CASE WHEN user_id % 5 = 0 THEN NULL ELSE event_type END FROM events
), counted AS (SELECT field, value, count(*) AS n FROM long GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r
  FROM counted WHERE value IS NOT NULL),
lengths AS (
  SELECT field, length(value) AS len,
         row_number() OVER (PARTITION BY field ORDER BY length(value)) AS pos,
         count(*) OVER (PARTITION BY field) AS size
  FROM long WHERE value IS NOT NULL),
q AS (
  SELECT field, min(len) FILTER (pos >= 0.5 * size) AS len_p50,
         min(len) FILTER (pos >= 0.95 * size) AS len_p95 FROM lengths GROUP BY field),
tops AS (
  SELECT field, string_agg(value || '=' || n, ';' ORDER BY r) AS tops FROM ranked WHERE r <= 3
  GROUP BY field)
SELECT c.field, CAST(sum(c.n) AS BIGINT) AS n_rows,
       coalesce(sum(c.n) FILTER (c.value IS NULL), 0) / sum(c.n) AS null_share,
       count(c.value) AS n_distinct, any_value(q.len_p50) AS len_p50,
       any_value(q.len_p95) AS len_p95, any_value(t.tops) AS tops
FROM counted c LEFT JOIN q USING (field) LEFT JOIN tops t USING (field) GROUP BY c.field""")
def field_profile(spark, sf_dir):
    rows = T.table(spark, sf_dir, "events").withColumn(
        "sparse", F.when(F.col("user_id") % 5 != 0, F.col("event_type"))
    )
    profile = field_inventory(rows, [*INVENTORY, "sparse"])
    tops = F.transform("top_values", lambda t: F.concat(t["value"], F.lit("="), t["n"]))
    return profile.select(
        "field", "n_rows", "null_share", "n_distinct",
        F.col("len_p50").cast("bigint").alias("len_p50"),
        F.col("len_p95").cast("bigint").alias("len_p95"),
        F.array_join(tops, ";").alias("tops"),
    )


@query("""
SELECT event_type, event_id, props FROM events
WHERE CAST('0x' || substr(md5(event_type || '|' || event_id), 1, 8) AS BIGINT) < 85899346""")
def field_sample(spark, sf_dir):
    rows = T.table(spark, sf_dir, "events").select("event_type", "event_id", "props")
    return stratified_sample(rows, "event_type", "event_id", 0.02)
