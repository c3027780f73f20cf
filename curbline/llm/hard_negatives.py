"""Hard negatives by inner product: best-first search in STR-packed R-trees, exact.

For an anchor and each of its best ``positives`` rows of the same label: the best ``negatives``
rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's score.
Components are floor(``scale`` * x); a score is the integer inner product; higher scores come
first, ties by smaller key.

1. Equal vectors with equal labels are one class, which keeps its smallest keys, as many as a
   result can need. A vector in a third of all rows is one entry.
2. Spark deals the classes to tiles the sort-tile-recursive way: slabs of equal size by the component
   with the largest variance, and tiles within the slab by the next. A tile that ties make too
   large is cut by hash.
3. Anchors, one per class, are a stated query set; they go in blocks against all tiles. A task
   takes one block and a group of tiles one after the other, packs each tile to an R-tree and keeps the
   best found so far, so that later tiles are pruned by them.
4. The box of a node bounds every component, and so the inner product from both sides. Each
   anchor's queue takes the node with the highest bound first. A node is left out if it is strictly
   below the k-th best (of equals a smaller key may be inside) or outside of all open score windows.
5. Positives first; their scores make the windows of a second pass of the same search.

Defined results: rows with a NULL key, label or vector, or any NULL or non-finite component,
take no part; vectors of unequal length meet as if the shorter had zeros; rows of one key never are
each other's positives; repeated rows count once; rows of one key with other content are rows of their own;
a negative positive score has an empty window; an empty table gives an empty result; other
columns are ignored. A component beyond 2**22 in size raises, since scores would not be exact.
Keys are integers.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

LARGEST = 1 << 22
#: Vectors of a tile, which a task packs to one tree.
TILE = 8192
#: Vectors of a leaf, and nodes below a node.
LEAF, FANOUT = 128, 8
#: Anchors that a task searches together.
BLOCK = 2048
#: Most groups of tiles of one block, whose results are merged.
GROUPS = 64


def prepared(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    x = F.col(vector)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fits = F.forall(whole, lambda c: F.abs(c) <= LARGEST)
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & sound)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"), fits.alias("fits"))
    checked = F.when(F.col("fits"), F.col("v")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}")))
    return rows.select("id", "label", checked.cast("array<int>").alias("v"))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(label, v, ids): distinct vectors of a label with their ``keep`` smallest keys."""
    place = F.dense_rank().over(W.partitionBy("label", "v").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= keep)  # cut before the shuffle as well
    return few.groupBy("label", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def by_variance(base: DataFrame) -> list[int]:
    """The components of the vectors, that with the largest variance first."""
    each = base.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("spread"), F.count("*").alias("n"))
    found = each.collect()  # one row per component
    return [r["at"] for r in sorted(found, key=lambda r: (-r["spread"], r["at"]))]


def tiled(base: DataFrame, order: list[int], size: int) -> tuple[DataFrame, int]:
    """The classes with a ``tile``; and about how many tiles there are."""
    n = base.count()
    wanted = max(1, -(-n // size))
    slabs = math.ceil(math.sqrt(wanted))
    across = -(-wanted // slabs)
    if wanted == 1 or not order:
        rows = base.withColumn("slab", F.lit(0)).withColumn("tile", F.lit(0))
    else:
        first = F.coalesce(F.get("v", F.lit(order[0])), F.lit(0))
        second = F.coalesce(F.get("v", F.lit(order[min(1, len(order) - 1)])), F.lit(0))

        def cuts(parts):
            return F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else None

        def below(bounds, x):
            return F.size(F.filter(bounds, lambda b: b < x))

        bounds = base.agg(F.percentile_approx(first, cuts(slabs), 1000).alias("b")).first()["b"] if slabs > 1 else []
        rows = base.withColumn("slab", below(F.array(*map(F.lit, bounds)), first) if bounds else F.lit(0))
        if across > 1:
            inner = rows.groupBy("slab").agg(F.percentile_approx(second, cuts(across), 1000).alias("bounds"))
            rows = rows.join(inner, "slab").withColumn("tile", F.col("slab") * across + below(F.col("bounds"), second))
        else:
            rows = rows.withColumn("tile", F.col("slab"))
    rows = rows.select("label", "v", "ids", "tile")
    full = rows.groupBy("tile").agg(F.ceil(F.count("*") / (2 * size)).alias("parts"))
    part = F.pmod(F.xxhash64("v", "label"), F.col("parts")).cast("int")
    return rows.join(full, "tile").select("label", "v", "ids", F.col("tile").cast("long"), part.alias("part")), wanted


def tile_order(matrix: np.ndarray, dims: list[int], leaf: int) -> np.ndarray:
    """Sort-tile-recursive order: consecutive runs of ``leaf`` rows are the leaves."""

    def cut(rows: np.ndarray, at: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or at >= len(use):
            return [rows]
        slabs = max(2, math.ceil(leaves ** (1 / (len(use) - at))))
        width = -(-leaves // slabs) * leaf
        rows = rows[np.argsort(matrix[rows, use[at]], kind="stable")]
        return [x for a in range(0, len(rows), width) for x in cut(rows[a : a + width], at + 1)]

    use = dims[: max(1, int(math.log2(max(2, len(matrix) / leaf))))]
    return np.concatenate(cut(np.arange(len(matrix)), 0))


class Tree:
    """An R-tree over the rows of a tile; level 0 are the leaves."""

    def __init__(self, matrix: np.ndarray, dims: list[int]):
        self.order = tile_order(matrix, dims, LEAF)
        self.rows = matrix[self.order]
        cuts = np.arange(0, len(matrix), LEAF)
        self.levels = [(np.minimum.reduceat(self.rows, cuts), np.maximum.reduceat(self.rows, cuts))]
        while len(self.levels[-1][0]) > FANOUT:
            lo, hi = self.levels[-1]
            cuts = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)))

    def bounds(self, queries: np.ndarray) -> list[tuple[list, list]]:
        """(least, most) possible scores of every query in every node, by level."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return [((up @ lo.T + down @ hi.T).tolist(), (up @ hi.T + down @ lo.T).tolist()) for lo, hi in self.levels]


class Window:
    """The best ``k`` entries of a score window, (-score, key) in order."""

    def __init__(self, name: int, low: float, high: float, k: int):
        self.name, self.low, self.high, self.k, self.best = name, low, high, k, []
        self.need = low  # scores strictly below change nothing

    def add(self, score: int, ids: list[int]) -> None:
        self.best = sorted({*self.best, *((-score, i) for i in ids)})[: self.k]
        if len(self.best) == self.k:
            self.need = max(self.low, -self.best[-1][0])


def search(tree: Tree, queries: np.ndarray, wanted: list[list[Window]], allowed, ids: list[list[int]]) -> None:
    """Best-first search of every query; fills its windows. ``allowed[q]`` marks the rows it may find."""
    if not len(queries):
        return
    bounds, top = tree.bounds(queries), len(tree.levels) - 1
    for q, windows in enumerate(wanted):
        if not windows:
            continue
        ceiling = max(w.high for w in windows)
        floor = min(w.need for w in windows)
        lows, highs = [b[0][q] for b in bounds], [b[1][q] for b in bounds]
        queue = [(-x, top, j) for j, x in enumerate(highs[top]) if x >= floor and lows[top][j] <= ceiling]
        heapq.heapify(queue)
        while queue:
            most, level, j = heapq.heappop(queue)
            if -most < floor:
                break
            if not any(-most >= w.need and lows[level][j] <= w.high for w in windows):
                continue
            if level:
                under = highs[level - 1]
                for c in range(j * FANOUT, min((j + 1) * FANOUT, len(under))):
                    if under[c] >= floor and lows[level - 1][c] <= ceiling:
                        heapq.heappush(queue, (-under[c], level - 1, c))
                continue
            at = j * LEAF
            scores = tree.rows[at : at + LEAF] @ queries[q]
            open_ = np.flatnonzero((scores >= floor) & (scores <= ceiling) & allowed(q, at, at + len(scores)))
            if not len(open_):
                continue
            for r in open_[np.argsort(-scores[open_], kind="stable")].tolist():
                score = int(scores[r])
                if score < floor:
                    break
                for w in windows:
                    if w.need <= score <= w.high:
                        w.add(score, ids[at + r])
            floor = min(w.need for w in windows)


SEARCH = "block int, part long, kind int, tile long, piece int, label long, v array<int>, ids array<long>, q long, scores array<long>"
FOUND = "q long, name long, found array<struct<score:long,id:long>>"


def _found_batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())])))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["q", "name", "found"])


def _matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def searched(base: DataFrame, queries: DataFrame, tiles: int, order: list[int], same: bool, make) -> DataFrame:
    """(q, name, found): the best entries of every window of every query, merged by ``best_of``.

    ``queries`` are (q, label, v, scores); ``make(scores)`` gives a query's windows; ``same``
    searches rows of the query's label, else those of other labels.
    """
    spark, width = base.sparkSession, len(order)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, -(-queries.count() // BLOCK))
    groups = max(1, min(tiles, GROUPS, -(-tasks // n_blocks)))
    spread = F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int")
    none = F.lit(None)
    asked = queries.select(
        spread.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), F.lit(0).alias("kind"),
        F.lit(0).cast("long").alias("tile"), F.lit(0).alias("piece"), "label", "v", none.cast("array<long>").alias("ids"), "q", "scores",
    )
    rows = base.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod("tile", F.lit(groups)).cast("long").alias("part"), F.lit(1).alias("kind"),
        "tile", F.col("part").alias("piece"), "label", "v", "ids", none.cast("long").alias("q"), none.cast("array<long>").alias("scores"),
    )

    def run(batches):
        at, held, block = None, [], None

        def ask():
            windows = [make(r[3]) for r in held]
            return _matrix([r[1] for r in held], width), np.array([r[0] for r in held]), windows, [r[2] for r in held]

        def look():
            if block is None or not held:
                return
            vectors, labels, windows, _ = block
            matrix = _matrix([r[1] for r in held], width)
            tree = Tree(matrix, order)
            own = np.array([r[0] for r in held])[tree.order]
            ids = [held[i][2] for i in tree.order.tolist()]
            search(tree, vectors, windows, lambda q, a, b: (own[a:b] == labels[q]) == same, ids)

        def found():
            rows = [(q, w.name, [{"score": -s, "id": i} for s, i in w.best]) for q, ws in zip(block[3], block[2], strict=True) for w in ws if w.best]
            for a in range(0, len(rows), 8192):
                yield _found_batch(rows[a : a + 8192])

        for batch in batches:
            names = ("block", "part", "kind", "tile", "piece", "label", "v", "ids", "q", "scores")
            for b, p, kind, tile, piece, label, v, ids, q, scores in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (b, p, kind, tile, piece) != at:
                    if at is not None and at[2] == 0:
                        block = ask()
                    elif at is not None:
                        look()
                    if at is not None and (b, p) != at[:2]:
                        if block is not None:
                            yield from found()
                        block = None
                    held, at = [], (b, p, kind, tile, piece)
                held.append((label, v, ids) if kind else (label, v, q, scores))
        if at is not None and at[2]:
            look()
            if block is not None:
                yield from found()

    placed = asked.unionByName(rows).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "kind", "tile", "piece")
    return placed.mapInArrow(run, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(q, name, best): the k first entries of every window, (score, id) structs in order."""
    merged = found.groupBy("q", "name").agg(F.flatten(F.collect_list("found")).alias("all"))  # at most k per group of tiles
    order = F.array_sort(F.transform("all", lambda x: F.struct((-x["score"]).alias("down"), x["id"].alias("id"))))
    best = F.transform(F.slice(order, 1, k), lambda x: F.struct((-x["down"]).alias("score"), x["id"].alias("id")))
    return merged.select("q", "name", best.alias("best"))


def mine(
    vectors: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    tile: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on ``id``, the key.
    """
    rows = stored(prepared(vectors, key, vector, label, scale), "usable-vectors")
    base = stored(classes(rows, max(positives + 1, negatives)), "vector-classes")
    order = by_variance(base)
    base, tiles = tiled(base, order, tile or TILE)
    base = stored(base, "vector-tiles")
    anchors = rows.where(anchor).distinct()
    heads = anchors.select("label", "v").distinct().withColumn("q", F.monotonically_increasing_id())
    queries = stored(heads.withColumn("scores", F.lit(None).cast("array<long>")), "anchor-classes")

    def nearest(_):
        return [Window(0, -math.inf, math.inf, positives + 1)]

    def windows(scores):
        return [Window(s, -(-low * s // 100), high * s // 100, negatives) for s in scores]

    near = best_of(searched(base, queries, tiles, order, True, nearest), positives + 1).select("q", F.col("best").alias("near"))
    asked = queries.drop("scores").join(near, "q")
    asked = stored(asked.withColumn("scores", F.array_distinct(F.transform("near", lambda x: x["score"]))), "anchor-windows")
    far = best_of(searched(base, asked.drop("near"), tiles, order, False, windows), negatives)
    own = anchors.select("id", "label", "v").join(asked.select("label", "v", "q", "near"), ["label", "v"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, positives)
    pairs = own.select(F.col("id").alias("anchor_id"), "q", F.explode(others).alias("p"))
    pairs = pairs.select("anchor_id", "q", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    hit = pairs.join(far.withColumnRenamed("name", "positive_score"), ["q", "positive_score"])
    return hit.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "n")).select(
        "anchor_id",
        "positive_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("n.id").alias("negative_id"),
        "positive_score",
        F.col("n.score").alias("negative_score"),
    )
