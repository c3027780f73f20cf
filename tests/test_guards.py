from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from curbline.operators import governance as G, metrics as M, monitoring as O


def test_inference_view_refuses_targets(rows):
    df = rows([("1", "Sewer", "call 718-555-0142", 40.678, -73.944, datetime(2024, 1, 1), "DEP", "x")],
              "id string, complaint_type string, descriptor string, latitude double, longitude double, created_date timestamp, agency string, resolution string")
    view = G.require_no_leakage(G.inference_view(df))
    r = view.first()
    assert "718" not in r["text"] and (r["coarse_latitude"], r["coarse_longitude"]) == (40.67, -73.95)
    for column in ("agency", "resolution"):
        with pytest.raises(G.LeakageError, match=column):
            G.require_no_leakage(view.withColumn(column, F.lit("x")))


def test_leakage_audit(rows):
    df = rows([("a", "x", "1"), ("a", "x", "2"), ("b", "y", "1"), ("b", "y", "2")], "t string, tell string, noise string")
    got = {r["field"]: r["determines"] for r in G.leakage_audit(df, "t", ["tell", "noise"]).collect()}
    assert got == {"tell": 1.0, "noise": 0.5}


DRAFT = "id string, ticket_id string, draft struct<owner:string,next_action:string,due_date:string,cited_precedent_id:string>, review_status string, draft_hash string"


def test_draft_validation_and_submission(rows):
    drafts = rows([("1", "1", ("DEP", "go", None, "p1"), "approved", "h1"), ("2", "2", ("DOT", "", None, "p9"), "approved", "h2"),
                   ("3", "3", (None, "go", None, None), "pending", "h3"), ("4", "1", ("DEP", "go", None, "p1"), "approved", "h1")], DRAFT)
    decisions = rows([("1", "DEP"), ("2", "DEP"), ("3", "DEP")], "ticket_id string, predicted_agency string")
    bundles = rows([("1", "p1"), ("2", "p2")], "ticket_id string, precedent_id string")
    got = {r["id"]: r["errors"] for r in G.validate_drafts(drafts, decisions, bundles).collect()}
    assert got["1"] == [] and got["3"] == ["owner missing"]
    assert got["2"] == ["next_action missing", "owner not routed agency", "precedent not in bundle"]
    sent = G.to_submit(drafts, rows([("h2",)], "draft_hash string"))
    assert [(r["draft_hash"], r["id"]) for r in sent.collect()] == [("h1", "1")]
    assert G.to_submit(drafts, sent).filter("draft_hash = 'h1'").count() == 0


def test_splits(rows):
    df = rows([("1", ["DEP", "DOB"]), ("2", ["DEP"]), ("3", ["DEP", "DOT", "HPD", "DOB"]), ("4", ["DEP", "FBI"]), ("5", None)], "ticket_id string, agencies array<string>")
    children, bad = G.expand_splits(df)
    assert {(r["child_id"], r["agency"]) for r in children.collect()} == {("1-1", "DEP"), ("1-2", "DOB")}
    assert {r["ticket_id"]: r["reason"] for r in bad.collect()} == {"2": "too few", "3": "over cap", "4": "unknown agency", "5": "too few"}
    m = M.split_metrics(rows([(["a", "b"], ["b", "a"]), (["a"], ["a", "c"]), ([], [])], "t array<string>, p array<string>"), "t", "p").first()
    assert m["exact"] == pytest.approx(2 / 3) and m["jaccard"] == pytest.approx((1 + 0.5 + 1) / 3)


def test_policies(rows):
    df = rows([("1", "DEP", "Sewer", datetime(2024, 2, 28)), ("2", "DOT", "Sewer", datetime(2024, 2, 28))], "id string, owner string, complaint_type string, created_date timestamp")
    policy = rows([("DEP", "Sewer", 3)], "owner string, complaint_type string, days int")
    got = {r["id"]: (r["due_date"], r["human_input_required"]) for r in G.due_dates(df, policy).collect()}
    assert got == {"1": (date(2024, 3, 2), False), "2": (None, True)}
    kept = G.apply_field_policy(df, {"x": {"id": "exact", "owner": "masked"}}, "x")
    assert kept.columns == ["id", "owner"]
    traces = rows([(i, datetime(2024, 1, 1 + i % 30), p) for i in range(300) for p in ("agent", "fast")], "k int, ts timestamp, path string")
    kept = G.retain(traces, "ts", "k", F.lit(datetime(2024, 2, 9)), days=30, fast_share=0.2)
    n = {r["path"]: r["count"] for r in kept.groupBy("path").count().collect()}
    assert n["agent"] == 210 and 0 < n["fast"] < 100 and kept.agg(F.min("ts")).first()[0] == datetime(2024, 1, 10)


def test_spend(rows):
    df = rows([(i, datetime(2024, 1, 1, i), "fast" if i == 4 else "agent", 1.5) for i in range(6)], "k int, ts timestamp, path string, cost double")
    got = {r["k"]: r["action"] for r in O.allocate_spend(df, "ts", "k", "cost").collect()}
    assert got == {0: "run", 1: "run", 2: "warn", 3: "queue", 4: "run", 5: "queue"}


def test_burn_alerts_need_duration(rows):
    hours = [(m, datetime(2024, 1, 1, h), 9.0) for m, h in [("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 2), ("b", 3)]]
    metrics = rows(hours + [("a", datetime(2024, 1, 1, 3), 1.0)], "metric string, period timestamp, value double")
    rules = rows([("a", 5.0, 3), ("b", 5.0, 3)], "metric string, limit double, for_periods int")
    got = O.slo_breaches(metrics, rules, "1 HOUR").collect()
    assert [(r["metric"], r["periods"]) for r in got] == [("b", 3)]


def test_feedback_strength(rows):
    reviews = rows([("1", "approve", None), ("2", "approve", None), ("3", "approve", None), ("4", "edit", None), ("5", "reject", "wrong"), ("6", "reject", None)], "k string, review_status string, reject_reason string")
    audits = rows([("2", True), ("3", False)], "k string, audit_ok boolean")
    labels = O.feedback_labels(reviews, audits, "k")
    got = {r["k"]: (r["label"], r["strength"]) for r in labels.collect()}
    assert got == {"1": (True, "weak"), "2": (True, "medium"), "3": (False, "strong"), "4": (False, "strong"), "5": (False, "strong"), "6": (False, "weak")}
    r = O.wrong_approval_rate(labels, []).first()
    assert (r["audited"], r["wrong_rate"]) == (2, 0.5)


def test_drift_is_zero_for_equal_halves(rows):
    df = rows([(i % 2 == 0, "ab"[i // 2 % 2], [1.0, float(i // 2 % 2)]) for i in range(40)], "ref boolean, c string, v array<float>")
    assert O.psi(df, F.col("ref"), "c").first()["psi"] == pytest.approx(0)
    assert O.centroid_shift(df, F.col("ref"), "v").first()["shift"] == pytest.approx(0, abs=1e-12)


def test_fairness_hides_small_cells(rows):
    df = rows([("t1", "Sewer", True)] * 9 + [("t2", "Sewer", False)] * 3, "area string, kind string, late boolean")
    areas = rows([("t1", "low"), ("t2", "high")], "area string, grp string")
    assert [r["grp"] for r in O.fairness_audit(df, areas, "area", "grp", "kind", "late", 5).collect()] == ["low"]


def test_metric_deltas(rows):
    s = "metric string, value double"
    tol = rows([("f1", 0.01, True), ("ece", 0.01, False)], "metric string, tolerance double, higher_is_better boolean")
    got = {r["metric"]: r["regressed"] for r in M.metric_deltas(rows([("f1", 0.9), ("ece", 0.02), ("gone", 1.0)], s), rows([("f1", 0.895), ("ece", 0.05), ("new", 1.0)], s), tol).collect()}
    assert got == {"f1": False, "ece": True, "gone": True, "new": False}
