"""Sketches, long keyword tables, trace patterns and published versions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as B, sketches as K, traces as R
from ..operators.areas import area_join
from ..operators.keywords import with_keyword_categories
from ..plans import tables as T
from ..plans.tables import sql
from ..runtime import scratch_path
from ..sources import snapshots as S
from .collect import collection
from .text import TOKENS_SQL

query, QUERIES, SQL = collection()

DISTINCT_ERROR, RANK_ERROR = 0.05, 0.02


@query(sql("""
SELECT path, count(*) AS n, count(DISTINCT user_id) AS users, true AS distinct_close, true AS p50_close,
       true AS p95_close
FROM scored GROUP BY path""", T.SCORED_SQL))
def sketch_bounds(spark, sf_dir):
    """Daily sketches merged over all days, against the exact figures: are the stated errors kept?"""
    rows = T.scored(spark, sf_dir)
    daily = K.sketched(
        rows.withColumn("day", F.to_date("ts")), ["day", "path"], {"users": "user_id"}, {"value": "value"}
    )
    told = K.estimates(K.merged(daily, ["path"]), {"p50": 0.5, "p95": 0.95})
    near = rows.join(F.broadcast(told.drop("n")), "path").groupBy("path").agg(  # one row per path
        F.count("*").alias("n"),
        F.countDistinct("user_id").alias("users"),
        F.max("users_distinct").alias("told"),
        *[
            (F.abs(F.count_if(F.col("value") <= F.col(f"value_{p}")) / F.count("*") - share) <= RANK_ERROR).alias(f"{p}_close")
            for p, share in (("p50", 0.5), ("p95", 0.95))
        ],
    )
    close = F.abs(F.col("told") - F.col("users")) <= DISTINCT_ERROR * F.col("users")
    return near.select("path", "n", "users", close.alias("distinct_close"), "p50_close", "p95_close")


KEYWORDS_SQL = """
kw AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM benchmark
), known AS (
  SELECT DISTINCT token FROM toks
), owned AS (
  SELECT DISTINCT k.token, substr(kw.w, 1, 1) AS c
  FROM known k JOIN kw ON substr(k.token, 1, 5) = substr(kw.w, 1, 5) AND starts_with(k.token, kw.w)
)"""


@query(sql("""
SELECT d.doc_id, coalesce(string_agg(DISTINCT o.c, ',' ORDER BY o.c), '') AS categories
FROM documents d LEFT JOIN toks t ON t.doc_id = d.doc_id LEFT JOIN owned o ON o.token = t.token
GROUP BY d.doc_id""", TOKENS_SQL, KEYWORDS_SQL))
def keyword_categories(spark, sf_dir):
    """Documents by the words of the benchmark, as keywords with their first letter for a category."""
    words = T.table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1))).alias("w")
    )
    table: dict[str, list[str]] = {}
    for r in words.distinct().collect():  # a keyword table; its size is checked before it is sent
        table.setdefault(r.w[0], []).append(r.w)
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_keyword_categories(docs, "text", table)
    return found.select("doc_id", F.array_join("categories", ",").alias("categories"))


@query("""
WITH placed AS (
  SELECT conv_id, role, row_number() OVER w AS pos, lead(role) OVER w AS next, lead(role, 2) OVER w AS later
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)
), told AS (
  SELECT conv_id, min(pos) FILTER (role = 'user') AS asked, min(pos) FILTER (role = 'assistant') AS answered,
         max(pos) FILTER (role = 'system') AS steered,
         count(*) FILTER (role = 'user' AND coalesce(next, '') <> 'assistant' AND coalesce(later, '') <> 'assistant') AS ignored
  FROM placed GROUP BY conv_id
)
SELECT conv_id, 'asked before answered' AS pattern, answered IS NOT NULL AND coalesce(asked > answered, true) AS broken FROM told
UNION ALL SELECT conv_id, 'answered within two', ignored > 0 FROM told
UNION ALL SELECT conv_id, 'no steering after an answer', coalesce(steered > answered, false) FROM told""")
def trace_patterns(spark, sf_dir):
    events = T.table(spark, sf_dir, "conversations")
    user, assistant, system = (F.col("role") == r for r in ("user", "assistant", "system"))
    return R.check_traces(
        events,
        "conv_id",
        ["turn", "role"],
        {
            "asked before answered": R.precedes(user, assistant),
            "answered within two": R.answered_within(user, assistant, 2),
            "no steering after an answer": R.never_after(assistant, system),
        },
    )


@query("""
SELECT 'pinned' AS reader, count(*) AS n, round(sum(value), 4) AS total FROM events
UNION ALL SELECT 'current', count(*), round(sum(value + 1), 4) FROM events""")
def pinned_snapshots(spark, sf_dir):
    """A reader that opened the table before a new version was published, and one after."""
    root, events = scratch_path(spark, "published"), T.table(spark, sf_dir, "events")
    S.publish(events, root, "ts")
    pinned = S.open_version(spark, root)
    S.publish(events.withColumn("value", F.col("value") + 1), root, "ts")
    readers = {"pinned": pinned, "current": S.open_version(spark, root)}
    parts = [
        df.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
            F.lit(name).alias("reader"), "n", "total"
        )
        for name, df in readers.items()
    ]
    return parts[0].unionByName(parts[1])


# Derived shapes: a five-cornered area per nation, shifted by its number; neighbours overlap.
CORNERS = ((0.0, 0.0), (0.004, 0.001), (0.009, 0.0), (0.006, 0.0061), (0.002, 0.0072))
CORNER_LAT = "40.5995 + ({n} % 5) * 0.0051 + {dy}"
CORNER_LNG = "-74.0005 + ({n} // 5) * 0.0037 + {dx}"


def _corner(n: str, i: int, engine: str) -> str:
    dy, dx = CORNERS[i]
    lat, lng = CORNER_LAT.format(n=n, dy=dy), CORNER_LNG.format(n=n, dx=dx)
    if engine == "spark":
        lng = lng.replace(f"({n} // 5)", f"({n} div 5)")
        return f"named_struct('lat', CAST({_double(lat)} AS DOUBLE), 'lng', CAST({_double(lng)} AS DOUBLE))"
    return f"{{'lat': CAST({_double(lat)} AS DOUBLE), 'lng': CAST({_double(lng)} AS DOUBLE)}}"


def _double(text: str) -> str:
    """Literals as doubles, so that both engines add the same numbers."""
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+)", r"CAST(\1 AS DOUBLE)", text)


AREAS_SQL = f"""
shapes AS (
  SELECT n_nationkey AS area, [{", ".join(_corner("n_nationkey", i, "duck") for i in range(len(CORNERS)))}] AS ring FROM nation
), edges AS (
  SELECT area, ring[i].lat AS ay, ring[i].lng AS ax, ring[i % 5 + 1].lat AS by, ring[i % 5 + 1].lng AS bx
  FROM shapes, range(1, 6) r(i)
), spots AS (
  SELECT DISTINCT latitude, longitude FROM tickets
), holding AS (
  SELECT latitude, longitude, min(area) AS area FROM (
    SELECT s.latitude, s.longitude, e.area FROM spots s, edges e
    WHERE (e.ay > s.latitude) <> (e.by > s.latitude)
      AND s.longitude < (e.bx - e.ax) * (s.latitude - e.ay) / (e.by - e.ay) + e.ax
    GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) GROUP BY 1, 2
)"""


@query(sql("""
SELECT t.id, coalesce(h.area, -1) AS area FROM tickets t
LEFT JOIN holding h ON h.latitude = t.latitude AND h.longitude = t.longitude""", T.TICKETS_SQL, AREAS_SQL))
def ticket_areas(spark, sf_dir):
    """The area of every ticket by its place."""
    ring = "array(" + ", ".join(_corner("n_nationkey", i, "spark") for i in range(len(CORNERS))) + ")"
    areas = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), F.expr(ring).alias("ring"))
    found = area_join(T.bare_tickets(spark, sf_dir), areas, "area")
    return found.select("id", F.coalesce("area", F.lit(-1)).alias("area"))


ROLLING_SQL = """
days AS (
  SELECT DISTINCT CAST(ts AS DATE) AS day FROM scored
), within AS (
  SELECT d.day, s.conf AS s, count(*) AS n, count(*) FILTER (s.correct) AS c
  FROM days d JOIN scored s ON CAST(s.ts AS DATE) BETWEEN d.day - 6 AND d.day GROUP BY 1, 2
), run AS (
  SELECT day, s, sum(n) OVER w AS n1, sum(c) OVER w AS c1, sum(n) OVER w - n AS n0, sum(c) OVER w - c AS c0, n
  FROM within WINDOW w AS (PARTITION BY day ORDER BY s)
), lower_means AS (
  SELECT a.day, a.s AS a, i.s AS i, min((b.c1 - a.c0) / (b.n1 - a.n0)) AS m
  FROM run a JOIN run i ON a.day = i.day AND a.s <= i.s JOIN run b ON b.day = i.day AND b.s >= i.s GROUP BY 1, 2, 3
), fitted AS (
  SELECT day, i AS s, round(max(m), 9) AS fitted FROM lower_means GROUP BY 1, 2
)"""


@query(sql("""
SELECT CAST(f.day AS VARCHAR) AS day, round(min(f.s), 9) AS lo, round(max(f.s), 9) AS hi, fitted, CAST(sum(r.n) AS BIGINT) AS weight
FROM fitted f JOIN run r ON r.day = f.day AND r.s = f.s GROUP BY f.day, fitted""", T.SCORED_SQL, ROLLING_SQL))
def rolling_fit(spark, sf_dir):
    """A calibration for every day from the blocks of its week; rows are read once, for the daily blocks."""
    rows = T.scored(spark, sf_dir).withColumn("day", F.to_date("ts"))
    fits = B.rolling_isotonic(B.score_blocks(rows, "conf", "correct", ["day"]), "day", 7)
    rounded = {c: F.round(c, 9) for c in ("lo", "hi", "fitted")}
    return fits.withColumns(rounded).withColumn("day", F.col("day").cast("string"))
