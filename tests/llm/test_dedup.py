"""Exact, byte, word and near-duplicate operators against brute force."""

import random

import pytest
from conftest import odd_rows
from pyspark.sql import functions as F

import brute
from curbline.llm import exact_dedup, jaccard_join, substring_dedup, suffix_dedup
from curbline.llm.common import shared_folder
from curbline.llm.components import components


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def unique(rows):
    return list(dict.fromkeys(rows))


def test_exact_groups_of_odd_rows(spark, odd):
    index = exact_dedup.build(odd, shared_folder(spark, "index"))
    got = [tuple(r) for r in exact_dedup.groups(odd, index).collect()]
    same(got, brute.exact(odd_rows()))


def test_exact_buckets_split_and_the_index_grows(spark, odd):
    small = odd.where("doc_id < 10")
    index = exact_dedup.build(small, shared_folder(spark, "index"), capacity=500)
    assert len(index.directory) > 2 and index.global_depth >= 1
    more = exact_dedup.extend(spark, exact_dedup.load(index.folder), odd.where("doc_id >= 10 or doc_id is null"), capacity=500)
    got = [tuple(r) for r in exact_dedup.groups(odd, more).collect()]
    same(got, brute.exact(odd_rows()))
    assert len({g for _, _, g in more.directory}) == 2  # buckets that got nothing stay where they were


def test_colliding_keys_are_told_apart_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    rows = [(0, 7, None, i, 1, t) for i, t in ((1, b"a"), (2, b"b"), (3, b"a"))]
    names = ["bucket", "key", "sha", "keep", "n", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
    out = [r for b in exact_dedup._own([batch]) for r in b.to_pylist()]
    assert [(r["text"], r["keep"], r["n"]) for r in out] == [(b"a", 3, 2), (b"b", 2, 1)]


def test_exact_deduplicate_keeps_columns(odd, none):
    out = exact_dedup.deduplicate(odd)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} == {2, 3, 6, 8, 9, 10, 11, 12, 13, 14, 15, 5}
    assert exact_dedup.deduplicate(none).count() == 0


def test_bytes_of_odd_rows(odd, none):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(odd).collect()]
    same(got, brute.byte_repeats(odd_rows(), 200))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_bytes_of_random_texts_with_short_windows(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (3, 11, 20):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, window=window, gram=4).collect()]
        same(got, brute.byte_repeats(rows, window))


def test_words_of_odd_rows(odd, none):
    got = [tuple(r) for r in substring_dedup.remove_repeats(odd).collect()]
    same(got, brute.word_repeats(odd_rows(), 50))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_words_of_random_texts_with_short_windows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (4, 9):
        got = [tuple(r) for r in substring_dedup.remove_repeats(docs, window=window, gram=2).collect()]
        same(got, brute.word_repeats(rows, window))


def test_near_groups_of_odd_rows(odd, none):
    got = [tuple(r) for r in jaccard_join.near_duplicates(odd).collect()]
    same(got, brute.near(odd_rows()))
    assert jaccard_join.near_duplicates(none).count() == 0


def test_near_groups_of_a_large_family(spark, monkeypatch):
    """Many edited copies around the limit, dealt over tiles."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "SLOT", 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same([tuple(r) for r in jaccard_join.near_duplicates(docs).collect()], brute.near(rows))


def test_near_deduplicate_keeps_columns(odd):
    out = jaccard_join.deduplicate(odd)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} == {r for r, _, c in brute.near(odd_rows()) if r == c}


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(spark.createDataFrame([(90, 80)], "a long, b long"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(40)}, 80: 80, 90: 80}


def folded_words(n=10):
    """Two words that collide under any polynomial hash modulo 2**64 with an odd base."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_built_to_collide_are_told_apart(spark):
    one, other = folded_words()
    rng = random.Random(8)
    words = [f"v{rng.randrange(10**6)}" for _ in range(60)]
    texts = [" ".join([*words[:30], w, *words[30:]]) for w in (one, other)]
    sequence = [" ".join(one[k] + "x" for k in range(len(one))), " ".join(other[k] + "x" for k in range(len(other)))]
    rows = [*enumerate(texts), *enumerate([one, other, *sequence], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(r) for r in substring_dedup.remove_repeats(docs).collect()], brute.word_repeats(rows, 50))
    same([tuple(r) for r in jaccard_join.near_duplicates(docs).collect()], brute.near(rows))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()]
    same(got, brute.byte_repeats(rows, 200))


def test_rabin_karp_equals_integers():
    import numpy as np

    from curbline.llm import buffers

    rng = np.random.default_rng(2)
    for n in (1, 3, 4, 5, 16, 17, 1000):
        values = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        hashes = buffers.RabinKarp(values, 123456789012345678)
        starts = np.arange(n)
        stops = np.minimum(starts + 7, n)
        want = [sum(int(v) * pow(123456789012345678, i, buffers.PRIME) for i, v in enumerate(values[a:b])) % buffers.PRIME for a, b in zip(starts, stops)]
        assert hashes.ranges(starts, stops).tolist() == want


def test_least_in_windows_over_several_stretches():
    import numpy as np

    from curbline.llm.buffers import least_in_windows

    rng = np.random.default_rng(3)
    h = rng.integers(0, 5, (1 << 20) + 5000).astype(np.uint64) << np.uint64(40)
    got = least_in_windows(h, 37)
    for i in [*range(50), *range((1 << 20) - 80, (1 << 20) + 40), len(got) - 1]:
        assert got[i] == i + int(np.argmin(h[i : i + 37]))


def test_rows_of_one_id_with_other_texts_keep_their_links(spark):
    rng = random.Random(6)
    a, b = ([f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(2))
    near = lambda w: " ".join([*w[:79], "changed"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (3, None), (4, "alone with id four here"), (5, " ".join(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same([tuple(r) for r in jaccard_join.near_duplicates(docs).collect()], brute.near(rows))


@pytest.mark.parametrize("window", [17, 48, 50])
def test_bytes_of_edited_copies(spark, window):
    """Windows that share their middle with many others and differ at the ends."""
    rng = random.Random(window)
    base = "".join(rng.choice("abcd") for _ in range(240))
    rows = [(0, base), (1, base), (2, base[7:180]), (3, base * 2)]
    for i in range(4, 40):
        text = list(base[rng.randrange(60) : 240 - rng.randrange(60)])
        for _ in range(rng.randrange(1, 5)):
            text[rng.randrange(len(text))] = rng.choice("abcd")
        rows.append((i, "".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, window=window, gram=8, step=window // 4).collect()]
    same(got, brute.byte_repeats(rows, window))


def test_exact_drops_judge_rows_by_id_and_text(spark):
    rows = [(1, "a"), (1, "b"), (2, "A"), (None, "b"), (None, "c"), (None, "C"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup.deduplicate(docs)
    same([tuple(r) for r in out.collect()], [(1, "b"), (2, "A"), (None, "c"), (None, "C"), (4, "")])


def test_directory_rounds_fetch_few_counts(spark, monkeypatch):
    rng = random.Random(9)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)] + [7] * 5
    sizes = spark.createDataFrame([(k, 10) for k in keys], "key long, bytes long")
    monkeypatch.setattr(exact_dedup, "FETCHED", 64)
    found = exact_dedup.split_directory(sizes, 100)
    unsigned = sorted(k % (1 << 64) for k in keys)
    assert sum(2.0**-d for _, d in found) == 1.0 and [f for f, _ in found] == sorted(f for f, _ in found)
    for first, depth in found:
        held = sum(first <= k < first + (1 << (64 - depth)) for k in unsigned)
        assert held <= 10 or depth == 63


def test_a_hot_text_is_sent_once_per_stretch(spark):
    import pyarrow as pa  # noqa: F401

    docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot ', 5000), cast(id as string)) as text").coalesce(1)
    sent = exact_dedup._combined(docs, [(0, 0)], "doc_id", "text")
    assert sent.where("n > 1").count() == 1 and sent.count() == 3334


def test_a_hot_shingle_and_a_hot_anchor(spark):
    """One phrase in every text, so that one list and one anchor hold all rows."""
    rng = random.Random(10)
    phrase = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{phrase} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(30))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same([tuple(r) for r in jaccard_join.near_duplicates(docs).collect()], brute.near(rows))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, window=60, gram=20).collect()]
    same(got, brute.byte_repeats(rows, 60))
