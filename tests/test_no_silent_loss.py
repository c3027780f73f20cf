"""Broken lines, missing keys, uneven vectors and lost folders are reported, never dropped."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from curbline import runtime
from curbline.operators.blocks import Rule, _placed, block_join, layout
from curbline.operators.governance import quarantine
from curbline.operators.landing import delta, malformed, normalize, upsert_tickets
from curbline.operators.routing import decode_responses, draft_hash
from curbline.operators.similarity import base_side, knn_join, query_side
from curbline.sources.files import read_landing, read_pairs
from curbline.streaming.jobs import current_tickets, quarantined, stream_ingest

GOOD = {"unique_key": "a", "created_date": "2024-01-02T00:00:00", "latitude": "40.5", "complaint_type": "Sewer"}


def _lines(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_batch_quarantine_keeps_the_text_and_replay_equals_a_clean_load(spark, tmp_path):
    bad = '{"unique_key": "b", "latitude": '
    _lines(tmp_path / "in", "1.json", [GOOD, bad, {**GOOD, "unique_key": None}, {**GOOD, "unique_key": "c", "latitude": "40.6d"}])
    good, kept = quarantine(read_landing(spark, str(tmp_path / "in")))
    rows = {tuple(r.reasons): r for r in kept.collect()}
    assert rows[("unreadable",)]["_corrupt_record"] == bad
    assert set(rows) == {("unreadable",), ("no unique_key",), ("bad latitude",)}
    _lines(tmp_path / "fixed", "1.json", [{**GOOD, "unique_key": "b"}, {**GOOD, "unique_key": "c"}])
    _lines(tmp_path / "clean", "1.json", [GOOD, {**GOOD, "unique_key": "b"}, {**GOOD, "unique_key": "c"}])
    replayed = normalize(good).unionByName(normalize(read_landing(spark, str(tmp_path / "fixed"))))
    clean = normalize(read_landing(spark, str(tmp_path / "clean")))
    assert sorted(map(str, replayed.collect())) == sorted(map(str, clean.collect()))


def test_stream_ingest_quarantines_and_takes_the_last_version(spark, tmp_path):
    landing, target, offsets = (str(tmp_path / x) for x in ("in", "log", "offsets"))
    newer = {**GOOD, "complaint_type": "Plumbing"}
    _lines(tmp_path / "in", "1.json", [GOOD, "{oops", {**GOOD, "unique_key": None}, newer])
    stream_ingest(spark, landing, target, offsets)
    rows = current_tickets(spark, target).collect()
    assert [(r.unique_key, r.complaint_type) for r in rows] == [("a", "Plumbing")]
    assert {tuple(r.reasons) for r in quarantined(spark, target).collect()} == {("unreadable",), ("no unique_key",)}
    _lines(tmp_path / "in", "2.json", [{**GOOD, "unique_key": "z"}])
    stream_ingest(spark, landing, target, offsets)
    assert {r.unique_key for r in current_tickets(spark, target).collect()} == {"a", "z"}


@pytest.mark.parametrize("line", ['{"text_a": "x", ', '{"text_b": "y", "label": true}'])
def test_pairs_that_do_not_parse_stop_the_job(spark, tmp_path, line):
    _lines(tmp_path / "p", "1.json", [{"text_a": "x", "text_b": "y", "label": True}, "", line])
    with pytest.raises(Exception, match="unusable pair"):
        read_pairs(spark, str(tmp_path / "p")).collect()


@pytest.mark.parametrize(
    "text,agency,confidence",
    [
        ("{'agency': 'DEP', 'confidence': 0.9}", None, 0.0),
        ('{"agency": "DEP", "confidence": 0.9} or {"agency": "DOT"}', None, 0.0),
        ('{"agency": "DEP", "confidence": 0.9}, {"agency": "DOT"}', None, 0.0),
        ('{"agency": "DEP", "confidence": null}', None, 0.0),
        ('{"agency": "DEP", "confidence": "0.9d"}', None, 0.0),
        ('{"agency": "DEP", "confidence": true}', "DEP", 1.0),
        ('{"agency": "DEP", "confidence": "0.5"}', "DEP", 0.5),
        ('{"agency": "DEP"}', "DEP", 0.0),
        ('so {"agency": " dep ", "confidence": 7} ok', "DEP", 1.0),
        (None, None, 0.0),
    ],
)
def test_decode_is_strict(rows, text, agency, confidence):
    df = rows([("1", "t", text, False)], "ticket_id string, tier string, text string, failed boolean")
    got = decode_responses(df).first()
    assert (got.agency, got.confidence) == (agency, confidence)
    assert got.tier == ("t" if agency else "t-malformed")


def test_numbers_and_dates_are_strict(spark, rows):
    schema = "unique_key string, complaint_type string, descriptor string, borough string, latitude string, longitude string, created_date string, closed_date string"
    df = rows([("1", None, None, None, "40.6d", "1e1", "2024", "2024-01-01")], schema)
    assert malformed(df).first().reasons == ["bad latitude", "bad created_date"]
    got = normalize(df).first()
    assert (got.latitude, got.longitude, got.created_date, got.closed_date) == (None, 10.0, None, datetime(2024, 1, 1))


def test_rows_without_a_key_are_not_upserted_twice(spark, rows):
    from curbline.operators.landing import empty_tickets

    schema = "unique_key string, complaint_type string, descriptor string, borough string, latitude string, longitude string, created_date string, closed_date string"
    new = normalize(rows([(None,) + (None,) * 7, ("k",) + (None,) * 7], schema)).withColumn("o", F.lit(1))
    once = upsert_tickets(empty_tickets(spark), new, "o")
    assert upsert_tickets(once, new, "o").count() == once.count() == 1


def test_draft_hash_tells_line_breaks_from_fields(spark):
    def draft(action, owner):
        return F.struct(F.lit(None).cast("string").alias("cited_precedent_id"), F.lit(None).cast("string").alias("due_date"), F.lit(action).alias("next_action"), F.lit(owner).alias("owner"))

    row = spark.range(1).select(
        draft_hash(F.lit("1"), draft("a\nowner=b", "c")).alias("x"), draft_hash(F.lit("1"), draft("a", "b\nowner=c")).alias("y")
    ).first()
    assert row.x != row.y


def test_delta_filter_reaches_the_scan(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds("id").alias("created_date"), "id")
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    out = delta(table, table.where("id < 50"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 51 and "GreaterThanOrEqual(created_date" in plan and "NestedLoop" not in plan


def test_vectors_of_unequal_length_raise(rows):
    df = rows([("a", [1.0, 0.0, 0.0]), ("b", [1.0, 0.0, 0.0, 0.0, 0.0])], "id string, vector array<float>")
    with pytest.raises(Exception, match="different lengths"):
        knn_join(df, df).collect()


@pytest.mark.parametrize("n_queries", [1, 0])
def test_blocks_are_bounded_by_the_rows_of_either_side(spark, n_queries):
    block = 64
    base = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), F.col("id") / 5000).cast("array<float>").alias("vector"))
    b = base_side(base, "id", "vector").withColumn("cell", F.lit(0).cast("bigint"))
    q = query_side(base.limit(n_queries), "id", "vector").withColumn("cells", F.array(F.lit(0).cast("bigint")))
    plan = layout(q, b, block)
    kept = b.join(plan.visited, "cell", "left_semi")
    placed = _placed(kept, plan, "b_slots", "q_slots").groupBy("block", "q_slot", "b_slot").count()
    assert (placed.agg(F.max("count")).first()[0] or 0) <= 3 * block
    assert kept.count() == (5000 if n_queries else 0)
    met = block_join(q, b, Rule(limit=2.0, k=1), plan)
    best = met.agg(F.count("*"), F.countDistinct("q_id")).first()
    assert best[1] == n_queries


def test_shared_folder_must_be_named_off_local_masters(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def test_release_deletes_scratch_tables(spark):
    import os

    monkey, runtime._scratch[:] = list(runtime._scratch), []
    df = runtime.stored(spark.range(3), "gone")
    path = runtime._scratch[-1]
    folder = path.removeprefix("file:")
    assert os.path.isdir(folder) and df.count() == 3
    assert runtime.release(spark) == 1 and not os.path.isdir(folder)
    runtime._scratch[:] = monkey
