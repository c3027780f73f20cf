from datetime import datetime

import pytest
from pyspark.sql import functions as F

from curbline.operators import calibration as C, metrics as M, routing as R, voting as V
from curbline.operators.ordering import exact_quantiles, temporal_split, with_rank, with_running


def test_prf_and_kappa(rows):
    df = rows([(True, True), (True, False), (False, False), (False, False)], "t boolean, p boolean")
    r = M.precision_recall_f1(df, "t", "p").first()
    assert (r["precision"], r["recall"]) == (1.0, 0.5) and r["f1"] == pytest.approx(2 / 3)
    assert (r["tp"], r["fp"], r["fn"]) == (1, 0, 1)
    assert M.precision_recall_f1(df.limit(0), "t", "p").first()["f1"] == 0
    assert M.cohen_kappa(df, "t", "t").first()["kappa"] == 1
    assert M.cohen_kappa(df.filter("t"), "t", "t").first()["kappa"] == 1
    assert M.cohen_kappa(df.limit(0), "t", "p").first()["kappa"] == 0


def test_macro_f1_and_confusion(rows):
    df = rows([("DEP", "DEP"), ("DEP", "DOT"), ("DOT", "DOT"), ("DPR", None)], "t string, p string")
    got = {(r["truth"], r["pred"]): r["n"] for r in M.confusion(df, "t", "p").collect()}
    assert got == {("DEP", "DEP"): 1, ("DEP", "DOT"): 1, ("DOT", "DOT"): 1, ("DPR", None): 1}
    r = M.macro_f1(df, "t", "p").first()
    assert r["classes"] == 3 and r["macro_f1"] == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)
    assert M.macro_f1(df.limit(0), "t", "p").first()["macro_f1"] == 0


def test_false_confidence(rows):
    df = rows([("cheap-knn", 0.9, True), ("cheap-knn", 0.8, False), ("cheap-knn", 0.5, False), ("groq", 0.9, False)],
              "tier string, conf double, ok boolean")
    r = M.false_confidence(df, "tier", "conf", "ok").first()
    assert (r[0], r[1]) == (0.5, 2)
    r = M.false_confidence(df, "tier", "conf", "ok", 0.99).first()
    assert (r[0], r[1]) == (0.0, 0)


def test_ece(rows):
    half = [(i, c, i < 5) for c in (0.5, 0.9) for i in range(10)]
    df = rows(half, "i int, conf double, ok boolean")
    assert C.ece(df.filter("conf = 0.5"), "conf", "ok").first()["ece"] == 0
    assert C.ece(df.filter("conf = 0.9"), "conf", "ok").first()["ece"] == pytest.approx(0.4)
    assert C.ece(df.limit(0), "conf", "ok").first()["ece"] == 0
    curve = C.reliability(rows([(0.1, True), (0.15, False), (0.95, True), (1.0, True)], "conf double, ok boolean"), "conf", "ok")
    assert {r["bin"]: r["n"] for r in curve.collect()} == {1: 2, 9: 2}


SAMPLE = list(zip([0.6, 0.7, 0.8, 0.9] * 2, [False, False, True, False, False, True, False, True]))


def test_isotonic_pools_ties(rows):
    df = rows(SAMPLE, "conf double, ok boolean")
    model = C.fit_isotonic(df, "conf", "ok")
    fit = C.apply_isotonic(df.select("conf").distinct(), "conf", model)
    assert {r["conf"]: r["calibrated"] for r in fit.collect()} == {0.6: 0, 0.7: 0.5, 0.8: 0.5, 0.9: 0.5}
    probe = rows([(0.0,), (0.65,), (0.7,), (1.0,), (None,)], "conf double")
    got = {r["conf"]: r["calibrated"] for r in C.apply_isotonic(probe, "conf", model).collect()}
    assert got == {0.0: 0, 0.65: 0, 0.7: 0.5, 1.0: 0.5, None: None}
    same = C.apply_isotonic(probe, "conf", model.limit(0)).filter("conf = 0.65").first()
    assert same["calibrated"] == 0.65


def test_isotonic_is_monotone_per_group(spark):
    df = spark.range(3000).select(
        (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000 / 1000).alias("conf"),
        (F.xxhash64("id") % 1000 < F.col("id") * 7919 % 1000).alias("ok"))
    steps = C.fit_isotonic(df, "conf", "ok", by=["g"]).orderBy("g", "lo").collect()
    for g in range(3):
        mine = [s for s in steps if s["g"] == g]
        assert sum(s["weight"] for s in mine) == 1000
        assert all(a["fitted"] < b["fitted"] and a["hi"] < b["lo"] for a, b in zip(mine, mine[1:]))


@pytest.mark.parametrize(
    "agency,conf,multi,path,reason",
    [("DEP", 0.9, False, "fast", "high-confidence"), ("DEP", 0.5, False, "agent", "low-confidence"),
     ("DEP", 0.99, True, "agent", "multi-agency"), (None, 0.99, False, "agent", "no-agency"),
     ("DEP", None, False, "agent", "low-confidence")])
def test_gate(rows, agency, conf, multi, path, reason):
    r = R.gate(rows([(agency, conf, multi)], "agency string, calibrated double, is_multi boolean")).first()
    assert (r["path"], r["reason"], r["gate_version"]) == (path, reason, "gate-v1")


@pytest.mark.parametrize(
    "codes,expected",
    [(["DEP", "DEP", "DOT"], ("DEP", 2 / 3, 3)), (["FBI", None, ""], None), (["dep", "DEP"], ("DEP", 1.0, 2)),
     (["DOT", "DEP", "DEP", "DOT"], ("DOT", 0.5, 4))])
def test_vote(rows, codes, expected):
    df = rows([("q", i + 1, c) for i, c in enumerate(codes)], "q_id string, rank int, agency string")
    r = V.vote(df).first()
    if expected is None:
        assert r is None
    else:
        assert (r["agency"], r["neighbors"]) == (expected[0], expected[2]) and r["confidence"] == pytest.approx(expected[1])


def test_cheap_tier(rows):
    labelled = rows([(str(i), [1.0, 0.0], "DEP", "x") for i in range(4)], "id string, vector array<float>, agency string, complaint_type string")
    tickets = rows([("0", [1.0, 0.0], "Sewer"), ("far", [0.0, 1.0], "Damaged Tree"), ("none", None, "odd")],
                   "id string, vector array<float>, complaint_type string")
    got = {r["id"]: (r["agency"], r["confidence"], r["tier"], r["neighbors"]) for r in V.cheap_tier(tickets, labelled, k=3).collect()}
    assert got == {"0": ("DEP", 1.0, "cheap-knn", 3), "far": ("DPR", 0.5, "prior", 0), "none": (None, 0.0, "prior", 0)}


PRED = "agency string, confidence double, tier string, neighbors bigint"


def test_cascade(rows):
    cheap = rows([("a", "DEP", 1.0, "cheap-knn", 3), ("b", "DEP", 0.33, "cheap-knn", 3), ("c", None, 0.0, "prior", 0), ("d", "DOT", 0.4, "cheap-knn", 1)], "id string, " + PRED)
    tier2 = rows([("a", "DOT", 0.99, "groq", 0), ("b", "DEP", 0.95, "groq", 0), ("c", "HPD", 0.2, "groq", 0)], "ticket_id string, " + PRED)
    tier3 = rows([("c", "DOB", 0.1, "openai", 0)], "ticket_id string, " + PRED)
    full = {r["id"]: r["tier"] for r in R.select_tier(cheap, tier2, tier3).collect()}
    assert full == {"a": "cheap-knn", "b": "groq", "c": "openai", "d": "cheap-knn"}
    none = {r["id"]: r["tier"] for r in R.select_tier(cheap).collect()}
    assert none == {"a": "cheap-knn", "b": "cheap-knn", "c": "prior", "d": "cheap-knn"}


@pytest.mark.parametrize(
    "text,failed,out",
    [('{"agency": "dep", "confidence": 0.9}', False, ("DEP", 0.9, "groq")), ('x {"agency":"DEP","confidence":7} y', False, ("DEP", 1.0, "groq")),
     ('{"agency": "FBI", "confidence": 0.9}', False, (None, 0.0, "groq-malformed")), ("free prose", False, (None, 0.0, "groq-malformed")),
     ('{"agency": "DEP", "confidence": "high"}', False, (None, 0.0, "groq-malformed")), ('{"agency": "DEP"}', False, ("DEP", 0.0, "groq")),
     (None, True, (None, 0.0, "groq-error"))])
def test_decode(rows, text, failed, out):
    r = R.decode_responses(rows([("1", "groq", text, failed)], "ticket_id string, tier string, text string, failed boolean")).first()
    assert (r["agency"], r["confidence"], r["tier"]) == out


def test_export_is_masked(rows):
    t = rows([("1", "Sewer", "call 718-555-0142"), ("2", "Sewer", "x")], "id string, complaint_type string, descriptor string")
    cheap = rows([("1", "DEP", 0.5), ("2", "DEP", 0.9)], "id string, agency string, confidence double")
    out = R.export_requests(t, cheap, "id").collect()
    assert [r["request"] for r in out] == ["Sewer: call [REDACTED_PHONE]"]


def test_draft_hash(rows):
    t = rows([("1", "leak", "Sewer"), ("2", "leak", "Sewer"), ("3", None, "Sewer"), ("4", "", None)], "id string, descriptor string, complaint_type string")
    d = rows([(k, "DEP") for k in "1234"], "ticket_id string, predicted_agency string")
    a, b = ({r["ticket_id"]: r for r in R.draft_orders(t, d).collect()} for _ in range(2))
    assert {k: r["draft_hash"] for k, r in a.items()} == {k: r["draft_hash"] for k, r in b.items()}
    assert len({r["draft_hash"] for r in a.values()}) == 4
    assert a["3"]["draft"]["next_action"] == "Investigate: Sewer" and len(a["1"]["draft_hash"]) == 16
    assert (a["1"]["validator_status"], a["1"]["review_status"], a["1"]["repair_count"]) == ("stub", "pending", 0)


def test_lifecycle(rows):
    t = rows([("1", "INGESTED"), ("2", "DUPLICATE"), ("3", "ROUTED")], "id string, status string")
    o = rows([("1", "CLASSIFIED"), ("2", "CLASSIFIED"), ("3", "APPROVED")], "ticket_id string, to_status string")
    assert {r["id"]: r["status"] for r in R.advance_status(t, o).collect()} == {"1": "CLASSIFIED", "2": "DUPLICATE", "3": "ROUTED"}
    steps = rows([("1", "INGESTED", "CLASSIFIED"), ("2", "DUPLICATE", "CLASSIFIED"), ("3", None, "ROUTED")], "ticket_id string, from_status string, to_status string")
    assert {r["ticket_id"] for r in R.illegal_transitions(steps).collect()} == {"2", "3"}


def test_total_orders_with_a_hot_group(spark):
    # two thirds of the rows share one group and one value
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(0).alias("g"),
                                 F.when(F.col("id") % 3 == 0, F.col("id") % 11).otherwise(5).alias("v"))
    got = with_rank(df, ["v", "id"], ["g"]).collect()
    import collections
    groups = collections.defaultdict(list)
    for r in got:
        groups[r["g"]].append(((r["v"], r["id"]), r["rank"]))
    for g in groups.values():
        assert [rank for _, rank in sorted(g)] == list(range(1, len(g) + 1))
    run = with_running(df, ["v", "id"], {"s": F.col("v")}).collect()
    total = 0
    for r in sorted(run, key=lambda r: (r["v"], r["id"])):
        total += r["v"]
        assert r["s"] == total
    q = exact_quantiles(df, "v", {"p50": 0.5, "p95": 0.95}, []).first()
    vals = sorted(r["v"] for r in got)
    assert (q["p50"], q["p95"]) == (vals[449], vals[854])


def test_temporal_split(rows):
    df = rows([(k, t) for k, t in [("a", datetime(2024, 1, 2)), ("b", None), ("c", datetime(2024, 1, 1)), ("d", datetime(2024, 1, 2)), ("e", datetime(2024, 1, 3))]], "id string, ts timestamp")
    assert {r["id"] for r in temporal_split(df, "ts", "id").filter("part = 'calib'").collect()} == {"a", "c"}


def test_bootstrap_and_mcnemar(rows):
    df = rows([(i, i % 10 < 8, i % 10 < 5) for i in range(400)], "k bigint, a boolean, b boolean")
    r = M.bootstrap_ci(df, "k", "a", "b").first()
    assert r["delta"] == pytest.approx(0.3) and 0.2 < r["low"] < 0.3 < r["high"] < 0.4
    m = M.mcnemar(df, "a", "b").first()
    assert (m["only_a"], m["only_b"]) == (120, 0) and m["statistic"] == pytest.approx(119**2 / 120)
    assert M.mcnemar(df.filter("a = b"), "a", "b").first()["statistic"] == 0
