"""SimHash groups, centroid clusters and hard negatives against brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from conftest import odd_rows, same
from pyspark.sql import functions as F

import brute
from curbline.llm import centroids, hard_negatives, queries, simhash

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, tile string, cluster string, q string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, *"abcde") for i, label, v in rows], SCHEMA).repartition(3)


def test_fingerprints_of_odd_rows(odd, none):
    rows = odd_rows()
    prints = [(i, brute.fingerprint(t)) for i, t in rows]
    roots = brute.hamming_groups(prints)
    got = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    same(got, [(i, f"{f:016x}", roots[i]) for i, f in prints])
    assert simhash.near_duplicates(none).count() == 0


def test_fingerprints_of_the_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    prints = [(i, brute.fingerprint(t)) for i, t in rows]
    roots = brute.hamming_groups(prints)
    same([tuple(r) for r in queries.QUERIES["op11_simhash"](spark, folder).collect()], [(i, f"{f:016x}", roots[i]) for i, f in prints])


def test_words_between_any_white_space_and_counts_over_pieces(monkeypatch):
    text = " A\tb\n\nc  D e\x0bf g "
    data = np.frombuffer((text + "é x").encode(), np.uint8)
    ends = np.array([len(text), len(data)])
    monkeypatch.setattr(simhash, "COUNTED", 2)
    got = simhash.majority(*simhash.shingle_hashes(data, ends, 3), 2).tolist()
    assert got == [brute.fingerprint(text), brute.fingerprint("é x")]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in combinations(range(64), radius):
        change = sum(1 << b for b in bits)
        assert any(change & m == 0 for m in masks)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_within_a_hot_bucket(spark, radius):
    """Many fingerprints that differ in few bits of one key, and some far away."""
    rng = random.Random(radius)
    prints = {0, (1 << 64) - 1}
    while len(prints) < 90:
        prints.add(0xABCDEF0123456789 ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    rows = [(i, f) for i, f in enumerate(sorted(prints))]
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "rep long, fp long")
    got = {(r.a, r.b) for r in simhash.links(nodes, radius).collect()}
    by_id = dict(rows)
    assert all((by_id[a] ^ by_id[b]).bit_count() <= radius for a, b in got)
    root = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in got:
            root[a] = root[b] = min(root[a], root[b])
    assert root == brute.hamming_groups(rows, radius)


def awkward(rng, n=400, dims=64):
    """(id, label, vector): copies, a hot vector, repeated rows and unusable ones."""
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]

    def one():
        v = [float(np.float32(c + rng.gauss(0, 0.7))) for c in rng.choice(centre)]
        return v

    hot = one()
    rows = [(i, rng.randrange(4), hot if i % 3 == 0 else one()) for i in range(n)]
    rows += rows[:3]
    rows += [(n, None, one()), (n + 1, 2, None), (None, 2, one()), (n + 50, 3, [0.0] * dims)]
    rows += [(n + 2, 1, [None, *one()[1:]]), (n + 3, 1, [math.nan, *one()[1:]]), (n + 4, 1, [math.inf, *one()[1:]])]
    return rows


def test_clusters_of_awkward_vectors(spark):
    rows = [*awkward(random.Random(1)), (900, 1, [1.0] * 63), (901, 1, [1.0] * 65), (902, 1, [])]
    got = centroids.report(*centroids.cluster(vectors(spark, rows), rounds=4))
    same([tuple(r) for r in got.collect()], brute.clusters([(i, v) for i, _, v in rows], rounds=4))


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(i, 0, [float(i % 2)] * 64) for i in range(3)]
    got = centroids.report(*centroids.cluster(vectors(spark, rows)))
    same([tuple(r) for r in got.collect()], brute.clusters([(i, v) for i, _, v in rows]))
    out = centroids.report(*centroids.cluster(vectors(spark, rows).limit(0)))
    assert out.count() == 0 and out.columns == got.columns
    big = vectors(spark, [(1, 0, [1e9] * 64)])
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(big)


def test_blocks_lose_nothing_and_merge_copies():
    rng = np.random.default_rng(3)
    matrix = rng.integers(-900, 900, (60, 12))
    matrix[:, 3] = 5
    matrix[:, 7] = matrix[:, 6]
    matrix = np.vstack([matrix, np.repeat(matrix[:1], 4000, axis=0)])
    parts = centroids.blocks(matrix)
    assert np.array_equal(np.hstack([d[c] for d, c in parts]), matrix)
    assert len(parts) < 12 and all(len(np.unique(d, axis=0)) == len(d) for d, _ in parts)


@pytest.mark.parametrize("tile", [None, 40])
def test_hard_negatives_of_awkward_vectors(spark, monkeypatch, tile):
    rows = [*awkward(random.Random(2)), (450, 1, [0.5] * 3), (500, 2, [])]
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    # Copies of the hot vector are anchors too: results must not depend on which stands for them.
    got = [tuple(r) for r in hard_negatives.mine(vectors(spark, rows), F.col("id") % 25 == 0, tile=tile).collect()]
    same(got, brute.hard_negatives(rows, every=25))


def test_hard_negatives_of_ties_and_of_none(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [float(rng.randrange(-1, 2)) for _ in range(4)]) for i in range(300)]
    got = [tuple(r) for r in hard_negatives.mine(vectors(spark, rows), F.col("id") % 50 == 0, scale=1, tile=30).collect()]
    same(got, brute.hard_negatives(rows, scale=1))
    assert hard_negatives.mine(vectors(spark, rows).limit(0), F.col("id") % 50 == 0).count() == 0


def test_best_first_search_leaves_nodes_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (40, 16))
    matrix = np.floor(np.repeat(centres, 128, axis=0) + rng.normal(0, 10, (5120, 16)))
    tree = hard_negatives.Tree(matrix, list(range(16)))
    visits = []

    def allowed(q, a, b):
        visits.append(a)
        return np.ones(b - a, bool)

    window = hard_negatives.Window(0, -math.inf, math.inf, 5)
    hard_negatives.search(tree, matrix[:1], [[window]], allowed, [[i] for i in tree.order.tolist()])
    exact = sorted((-int(s), i) for i, s in enumerate(matrix @ matrix[0]))[:5]
    assert window.best == exact and len(visits) < 10
