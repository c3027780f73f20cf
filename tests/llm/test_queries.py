"""Queries with SQL against DuckDB, and the pipeline against plain Python, on the smallest tables."""

import os
import sys

import pytest
from pyspark.sql import functions as F

import brute

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
from compare import compare, duck  # noqa: E402
from curbline.llm import queries  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    verdict, _ = compare(spark, duck(SF_DIR), name, queries.QUERIES[name], queries.SQL[name], SF_DIR)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def test_bytes_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    want = {(i, n, gone, spans, brute.sha(kept)) for i, n, gone, spans, kept in brute.byte_repeats(rows, 200)}
    assert {tuple(r) for r in queries.QUERIES["op4_suffix_dedup"](spark, SF_DIR).collect()} == want


def test_pipeline_equals_plain_python(spark):
    kept = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in kept.collect()]
        kept = stage(spark, kept, SF_DIR).cache()
        assert kept.columns == columns
        ids = {r.doc_id for r in kept.collect()}
        if name == "exact dedup":
            assert ids == {i for i, _, _, keep, _ in brute.exact(before) if keep}
        elif name == "n-gram Jaccard join":
            assert ids == {i for i, _, c in brute.near(before) if i == c}
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
            assert ids == {i for i, n, h, _ in brute.contaminated(before, items) if not (h and 20 * h >= n)}
        else:
            labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            assert ids < {i for i, _ in before} and len(good - ids) <= 0.02 * len(good)
    out = corpus_pipeline.run(spark, SF_DIR)
    texts = {r.doc_id: r.text for r in kept.collect()}
    got = {r.doc_id: r.decoded_sha256 for r in out.collect()}
    assert got == {i: brute.sha(t) for i, t in texts.items()}


def test_pipeline_of_odd_rows_and_of_none(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1), (9, 0), (None, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "two words"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        ids = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect()]
        assert (len(ids) > 0) == (name == "odd") and 9 not in ids


def test_held_out_quality_of_the_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op7_quality_classifier"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    got = rows.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a")).first()
    assert got.a >= 0.95
