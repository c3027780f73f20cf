"""Sparse pairs, sketches, keyword automaton, trace patterns, areas, versions, blocks and orders."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbline.functions.text import issue_categories
from curbline.operators import calibration as C, sketches as K, traces as R
from curbline.operators.areas import area_join
from curbline.operators.keywords import with_keyword_categories
from curbline.operators.ordering import with_running
from curbline.operators.profiling import profile_ambiguity
from curbline.operators.similarity import Pivots, _farthest, knn_join, lsh_plan, pick_pivots
from curbline.operators.sparse_join import cosine_pairs
from curbline.operators.text_vectors import add_hashed_vectors, pair_distances
from curbline.sources import snapshots as S


@pytest.mark.parametrize("limit", [0.3, 0.8, 1.0])
def test_sparse_pairs_equal_all_pairs(rows, monkeypatch, limit):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(12))) for _ in range(60)]
    data = [*enumerate(texts), *((100 + i, texts[5]) for i in range(40)), (200, None), (201, "..."), (202, "solo solo")]
    monkeypatch.setattr("curbline.operators.sparse_join.SLOT", 7)
    got = cosine_pairs(rows(data, "id long, text string").repartition(3), "id", "text", limit)
    counts = {i: Counter((t or "").split()) for i, t in data if t and t != "..."}
    roots = {}
    for i in sorted(counts):
        roots.setdefault(tuple(sorted(counts[i].items())), i)
    assert {r.id: r.root for r in got.members.collect()} == {i: roots[tuple(sorted(c.items()))] for i, c in counts.items() if c}
    want = {}
    for a, b in combinations(sorted(set(i for k, i in roots.items() if k)), 2):
        x, y = counts[a], counts[b]
        norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        cosine = round(sum(x[t] * y[t] for t in x) / norm, 9)
        if cosine >= limit:
            want[a, b] = cosine
    pairs = {(r.a, r.b): r.cosine for r in got.pairs.collect()}
    assert pairs.keys() == want.keys() and all(pairs[k] == pytest.approx(want[k], abs=2e-9) for k in want)


def test_text_vectors_need_no_shuffle(rows):
    df = rows([("a", "x y x"), ("b", None), ("c", "")], "id string, t string")
    plan = add_hashed_vectors(df, F.col("t"), 8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Exchange" not in pair_distances(df.withColumn("u", F.col("t")), "id", "t", "u")._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.vector for r in add_hashed_vectors(df, F.col("t"), 8).collect()}
    assert got["b"] is None and got["c"] is None and sorted(got["a"])[-2:] in ([1.0, 2.0], [0.0, 3.0])


def test_lsh_plans_reach_their_recall():
    for n, limit, recall in ((10_000, 0.1, 0.9), (10**7, 0.3, 0.95), (10**9, 0.2, 0.99)):
        plan = lsh_plan(n // 20, n, limit, recall)
        part = math.acos(1 - limit) / math.pi
        hit = sum(math.comb(plan.bits, j) * part**j * (1 - part) ** (plan.bits - j) for j in range(plan.flips + 1))
        assert 1 - (1 - hit) ** plan.tables >= recall - 1e-12 and plan.tables <= 64
        assert plan.tables * plan.probes / 2**plan.bits < 1  # fewer comparisons than all
    assert lsh_plan(100, 100, 1.0) is None  # comparing everything is cheaper
    with pytest.raises(ValueError):
        lsh_plan(1, 1, 0.1, 1.0)


def test_measured_recall_of_hashing(rows):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24))
    data = [(i, [float(x) for x in centres[i % 40] + 0.45 * rng.standard_normal(24)]) for i in range(1200)]
    df = rows(data, "id long, vector array<double>")
    exact = {(r.q_id, r.b_id) for r in knn_join(df, df, k=10, max_distance=0.25).collect()}
    hashed = {(r.q_id, r.b_id) for r in knn_join(df, df, k=10, max_distance=0.25, method="lsh", bits=9).collect()}
    assert len(exact) > 3000 and len(exact & hashed) >= 0.9 * len(exact)


def test_pivots_are_distinct_and_grow(rows):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 6)).round(3)
    v[:300] = v[0]
    base = rows([(i, [float(x) for x in r]) for i, r in enumerate(v)], "b_id long, b_vec array<double>")
    few, many = (pick_pivots(base, 900, n) for n in (9, 60))
    assert isinstance(few, Pivots) and len(few.groups) == 3 and len(many.groups) == 8
    flat = np.concatenate(many.pivots)
    assert 50 <= len(flat) <= 70 and len(np.unique(flat.round(9), axis=0)) == len(flat)
    assert len(_farthest(np.repeat(v[:1] / np.linalg.norm(v[0]), 5, axis=0), 4)) == 1


def test_sketches_merge_to_the_same_bounds(rows):
    rng = random.Random(4)
    data = [(d, rng.randrange(3000), rng.gauss(0, 1)) for d in range(6) for _ in range(2000)] + [(0, None, None)]
    df = rows(data, "day int, who int, x double")
    daily = K.sketched(df, ["day"], {"who": "who"}, {"x": "x"})
    told = K.estimates(K.merged(daily), {"p50": 0.5, "p95": 0.95}).first()
    exact = len({w for _, w, _ in data if w is not None})
    assert told.n == len(data) and abs(told.who_distinct - exact) <= 0.05 * exact
    values = sorted(x for _, _, x in data if x is not None)
    for p, value in ((0.5, told.x_p50), (0.95, told.x_p95)):
        assert abs(sum(v <= value for v in values) / len(values) - p) <= 0.02
    empty = K.estimates(K.merged(K.sketched(df.where("who is null"), ["day"], {"who": "who"}, {"x": "x"})), {"p50": 0.5}).first()
    assert empty.who_distinct == 0 and empty.x_p50 is None


def test_keyword_automaton_equals_expressions(rows):
    texts = ["No heat, boiler off", "reheat", "ünheat", "heat_x", "a-heat", "HEATING", None, "", "water main; tree", "wat", "street: pothole\ntree"]
    df = rows(list(enumerate(texts)), "id int, t string")
    table = {"heat": ["heat", "boiler"], "tree": ["tree"], "water": ["water main", "wat"], "sign": [": "], "none": [""]}
    small = {k: tuple(v) for k, v in table.items() if k not in ("none", "sign")}
    got = with_keyword_categories(df, "t", {k: list(v) for k, v in small.items()}).join(
        df.select("id", issue_categories(F.col("t"), small).alias("want")), "id"
    )
    assert all(r.categories == r.want for r in got.collect())
    large = with_keyword_categories(df, "t", table | {f"c{i:05d}": [f"word{i}"] for i in range(5000)})
    assert {r.id: r.categories for r in large.collect()}[10] == ["sign", "tree"]
    assert "Exchange" not in large._jdf.queryExecution().executedPlan().toString()


def brute_patterns(events):
    """(asked first, answered within two, never after) broken, from (kind) lists."""
    first = next((k for k in events if k in "ab"), None)
    late = any(k == "a" and "b" not in events[i + 1 : i + 3] for i, k in enumerate(events))
    after = "b" in events and any(k == "c" for k in events[events.index("b") + 1 :])
    return first == "b", late, after


def test_trace_patterns_of_long_and_short_cases(rows):
    rng = random.Random(5)
    cases = {i: [rng.choice("abcd") for _ in range(rng.randrange(1, 9))] for i in range(200)}
    cases[1000] = ["a", "b"] * 2000  # a third of all events: spreads over ranges
    cases[1001] = ["a", "b"] * 500 + ["c"]
    events = rows([(i, n, k) for i, ks in cases.items() for n, k in enumerate(ks)], "id long, n int, kind string").repartition(5)
    a, b, c = (F.col("kind") == x for x in "abc")
    got = R.check_traces(events, "id", ["n"], {"x": R.precedes(a, b), "y": R.answered_within(a, b, 2), "z": R.never_after(b, c)})
    told = {(r.id, r.pattern): r.broken for r in got.collect()}
    assert told == {(i, p): v for i, ks in cases.items() for p, v in zip("xyz", brute_patterns(ks))}


def test_areas_hold_each_point_once(rows):
    square = lambda y, x, s: [(y, x), (y, x + s), (y + s, x + s), (y + s, x)]
    shapes = [(1, square(0.0, 0.0, 0.05)), (2, square(0.0, 0.05, 0.05)), (3, [(0.2, 0.0), (0.3, 0.05), (0.2, 0.1)]), (4, [(0.0, 0.0)]), (5, None)]
    areas = rows(shapes, "area int, ring array<struct<lat: double, lng: double>>")
    points = [(0, 0.02, 0.02), (1, 0.02, 0.05), (2, 0.0, 0.1), (3, 0.25, 0.05), (4, 0.29, 0.01), (5, None, 0.1), (6, -0.001, 0.0), (7, 0.05, 0.02)]
    got = area_join(rows(points, "id int, latitude double, longitude double"), areas, "area")
    assert {r.id: r.area for r in got.collect()} == {0: 1, 1: 2, 2: None, 3: 3, 4: None, 5: None, 6: None, 7: None}


def test_published_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    first = S.publish(spark.range(10), root, at=1000.0)
    pinned = S.open_version(spark, root)
    second = S.publish(spark.range(10, 30), root, at=2000.0)
    assert pinned.count() == 10 and S.open_version(spark, root).count() == 20
    assert S.versions(spark, root) == [first, second] and S.current(spark, root) == second
    (tmp_path / "table" / "v=0000003000000-00000000000000000000000000000000").mkdir()  # a writer that died
    assert S.versions(spark, root) == [first, second]
    with pytest.raises(ValueError):
        S.point(spark, root, "v=0000003000000-00000000000000000000000000000000")
    S.point(spark, root, first)  # back
    assert S.open_version(spark, root).count() == 10
    assert S.expire(spark, root, 100.0, now=9000.0) == [second] and S.open_version(spark, root, first).count() == 10


def test_blocks_of_days_fit_as_the_rows(rows):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    data = [((start + timedelta(days=rng.randrange(12))).date(), rng.randrange(20) / 20, rng.random() < 0.5) for _ in range(600)]
    df = rows(data + [(start.date(), None, True)], "day date, conf double, ok boolean")
    fits = C.rolling_isotonic(C.score_blocks(df, "conf", "ok", ["day"]), "day", 5)
    for end in (start + timedelta(days=4), start + timedelta(days=11)):
        own = df.filter(F.col("day").between(F.lit(end.date()) - F.expr("INTERVAL 4 DAYS"), F.lit(end.date())))
        want = {tuple(r) for r in C.fit_isotonic(own, "conf", "ok").collect()}
        assert {tuple(r)[1:] for r in fits.filter(F.col("day") == F.lit(end.date())).collect()} == want


def test_running_sums_shuffle_rows_once(rows):
    rng = random.Random(7)
    data = [(i, rng.randrange(5), rng.random()) for i in range(500)]
    df = rows(data, "id long, t int, x double").repartition(4)
    out = with_running(df, ["t", "id"], {"n": F.lit(1).cast("bigint"), "s": F.col("x")})
    got = {r.id: (r.n, r.s) for r in out.collect()}
    total = 0.0
    for n, (i, _, x) in enumerate(sorted(data, key=lambda r: (r[1], r[0])), 1):
        total += x
        assert got[i][0] == n and got[i][1] == pytest.approx(total)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()  # the rows lie in order already
    assert with_running(df.limit(0), ["t", "id"], {"n": F.lit(1).cast("bigint")}).count() == 0


def test_ambiguity_profile_leaves_duplicates_out(rows):
    long = "no heat and also water leak in the hall"
    data = [("1", long, "INGESTED"), ("2", "x", None), ("3", long, "DUPLICATE"), ("4", None, "DRAFTED")]
    got = profile_ambiguity(rows(data, "id string, descriptor string, status string")).first()
    assert (got.total, got.thin_text, got.multi_issue, got.examples) == (3, 2, 1, [long])


def test_small_shares_keep_their_share(rows):
    from curbline.operators.governance import chosen
    from curbline.operators.routing import route

    df = rows([(i,) for i in range(200_000)], "id long")
    assert 3 <= df.filter(chosen(0.00005, F.col("id"))).count() <= 25
    gated = rows([("a", "DEP", "Sewer", 0.9, "fast", "g1"), ("a", "DOT", "Sewer", 0.9, "fast", "g1"), ("a", None, "Sewer", 0.1, "agent", "g1")],
                 "id string, agency string, complaint_type string, calibrated double, path string, gate_version string")
    assert route(gated).select("id").distinct().count() == 3


def test_days_without_rows_are_not_reported(rows):
    day = lambda d: datetime(2024, 1, d)
    df = rows([(day(1), 0.9, True), (day(4), 0.1, True)], "ts timestamp, conf double, ok boolean")
    assert [str(r.day) for r in C.rolling_ece(df, "ts", "conf", "ok").orderBy("day").collect()] == ["2024-01-01", "2024-01-04"]
