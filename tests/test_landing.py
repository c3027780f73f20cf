import json
from datetime import datetime

from pyspark.sql import functions as F

from curbline.operators import landing as L
from curbline.operators.governance import quarantine
from curbline.sources import files
from curbline.sources.schemas import LANDED_REQUEST

RAW = "unique_key string, created_date string, closed_date string, complaint_type string, descriptor string, agency string, borough string, latitude string, longitude string, status string"


def raw(rows, *keys, **over):
    base = dict(created_date="2024-03-14T08:21:00.000", closed_date=None, complaint_type="Sewer",
                descriptor="backup", agency="DEP", borough="brooklyn", latitude="40.67",
                longitude="", status="Open")
    base.update(over)
    return rows([(k, *base.values()) for k in keys], RAW)


def test_normalize(rows):
    t = L.normalize(raw(rows, "1", closed_date="")).first()
    assert t["latitude"] == 40.67 and t["longitude"] is None and t["borough"] == "BROOKLYN"
    assert t["created_date"] == datetime(2024, 3, 14, 8, 21) and t["closed_date"] is None


def test_quarantine_keeps_reasons_and_replays(rows):
    bad = raw(rows, "2", latitude="north", created_date="soon")
    good, held = quarantine(raw(rows, "1").unionByName(bad))
    assert [r["unique_key"] for r in good.collect()] == ["1"]
    assert held.first()["reasons"] == ["bad latitude", "bad created_date"]
    fixed = held.drop("reasons").withColumn("latitude", F.lit("40.1")).withColumn("created_date", F.lit(""))
    assert quarantine(good.unionByName(fixed))[0].count() == 2


def test_filter_is_half_open(rows):
    df = rows(
        [("BROOKLYN", "Sewer", datetime(2024, 1, 1)), ("Brooklyn", "Sewer", datetime(2025, 1, 1)),
         ("QUEENS", "Sewer", datetime(2024, 2, 1)), ("BROOKLYN", "O'Hara", datetime(2024, 2, 1))],
        "borough string, complaint_type string, created_date timestamp")
    got = L.filter_requests(df, "brooklyn", ["Sewer", "O'Hara"], datetime(2024, 1, 1), datetime(2025, 1, 1))
    assert got.count() == 2
    assert L.filter_requests(df).count() == 4


def test_landing_cap_and_formats(spark, rows, tmp_path):
    df = raw(rows, "3", "1", "2", "5", "4")
    df.write.json(str(tmp_path / "j"))
    df.write.option("header", True).csv(str(tmp_path / "c"))
    assert [r["unique_key"] for r in files.read_landing(spark, str(tmp_path / "j"), 3).collect()] == ["1", "2", "3"]
    assert files.read_landing(spark, str(tmp_path / "c"), fmt="csv").count() == 5
    assert files.read_landing(spark, str(tmp_path / "j")).schema == LANDED_REQUEST
    assert files.read_landing_raw(spark, str(tmp_path / "j")).filter("unique_key = '4'").count() == 1


def test_pairs_skip_blank_lines(spark, tmp_path):
    pair = {"text_a": "a", "text_b": "b", "label": True, "ann1": True, "ann2": False}
    (tmp_path / "p.jsonl").write_text(json.dumps(pair) + "\n\n" + json.dumps(pair) + "\n")
    assert files.read_pairs(spark, str(tmp_path / "p.jsonl")).count() == 2


def incoming(rows, *data):
    df = rows([(k, d, s) for k, d, s in data], "unique_key string, descriptor string, seq int")
    return df.select(
        L.ticket_id(F.col("unique_key")).alias("id"), "unique_key", F.lit("Sewer").alias("complaint_type"),
        "descriptor", F.lit("BRONX").alias("borough"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"),
        F.lit(None).cast("timestamp").alias("created_date"), F.lit(None).cast("timestamp").alias("closed_date"), "seq")


def test_upsert_is_idempotent_and_keeps_lifecycle(spark, rows):
    first = L.upsert_tickets(L.empty_tickets(spark), incoming(rows, ("a", "x", 1), ("a", "y", 2), ("b", None, 1)), "seq")
    got = {r["unique_key"]: r for r in first.collect()}
    assert got["a"]["descriptor"] == "y" and got["a"]["status"] == "INGESTED" and got["a"]["report_count"] == 1
    assert first.columns == L.empty_tickets(spark).columns
    routed = first.withColumn("status", F.lit("ROUTED")).withColumn("report_count", F.lit(4))
    again = {r["unique_key"]: r for r in L.upsert_tickets(routed, incoming(rows, ("a", None, 3)), "seq").collect()}
    assert again["a"]["descriptor"] is None  # the last write also clears fields
    assert (again["a"]["status"], again["a"]["report_count"], again["a"]["id"]) == ("ROUTED", 4, got["a"]["id"])
    assert again["b"]["descriptor"] is None and len(again) == 2


def test_raw_first_write_wins(rows):
    schema = "unique_key string, payload string, ingested_at int"
    held = rows([("a", "old", 1)], schema)
    new = rows([("a", "new", 2), ("b", "second", 4), ("b", "first", 3)], schema)
    assert {(r[0], r[1]) for r in L.land_raw(held, new).collect()} == {("a", "old"), ("b", "first")}


def test_delta_rereads_the_boundary(rows):
    land = rows([(1, 10), (2, 20), (3, 30)], "k int, created_date int")
    assert {r["k"] for r in L.delta(land, land.filter("created_date <= 20")).collect()} == {2, 3}
    assert L.delta(land, land.limit(0)).count() == 3


def test_backfill_window():
    start, end = L.backfill_window(12, datetime(2024, 12, 31))
    assert (end - start).days == round(12 * 30.4375)


def test_vectors(rows):
    tickets = rows([("1", "aa"), ("2", "b"), ("3", None)], "id string, text string")
    made = L.vectorize(tickets, lambda texts: [[float(len(t)), 1.0] for t in texts], "id", "text", batch=2)
    got = {r["id"]: r["vector"] for r in made.collect()}
    assert got == {"1": [2.0, 1.0], "2": [1.0, 1.0], "3": [0.0, 1.0]}
    vectors = made.withColumnRenamed("id", "ticket_id").withColumn("model", F.lit("m1"))
    assert L.missing_vectors(tickets, vectors.filter("ticket_id <> '2'")).first()["id"] == "2"
    new = vectors.filter("ticket_id = '1'").withColumn("model", F.lit("m2"))
    assert {r["ticket_id"]: r["model"] for r in L.upsert_vectors(vectors, new).collect()} == {"1": "m2", "2": "m1", "3": "m1"}


def test_snapshot_by_month(spark, rows, tmp_path):
    df = rows([(1, datetime(2024, 1, 5)), (2, datetime(2024, 2, 5)), (3, None)], "k int, created_date timestamp")
    files.write_snapshot(df, str(tmp_path / "s"))
    assert files.read_snapshot(spark, str(tmp_path / "s")).count() == 3
    pruned = files.read_snapshot(spark, str(tmp_path / "s"), ["2024-02"])
    assert [r["k"] for r in pruned.collect()] == [2]
    assert "PartitionFilters: [isnotnull" in pruned._jdf.queryExecution().toString()
    files.write_report(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 3
