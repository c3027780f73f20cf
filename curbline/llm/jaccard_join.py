"""Near-duplicate groups by Jaccard similarity of word shingles: a T-occurrence search.

A document's set holds 64-bit hashes of its distinct ``size``-word shingles; words are hashed by
XXH3 with a seed that is drawn anew for every job, so no text can be built to collide. Two sets link
when 100 * intersection >= ``percent`` * union. The result is exact up to chance collisions.

1. Equal sets are one set (its smallest id stands for them), so copies never meet.
2. Filter. In a common order of shingles, two linked sets share at least l shingles among
   the first n - T + l of each, T being the least overlap a set of n can link with. Tasks send
   these prefixes, packed, to buckets of shingle hashes; buckets count for every set how many are
   shared. A shingle that recurs within a block of documents is sent once per block, so a
   frequent one stays small. Few sets are left.
3. For those, document frequencies of all their shingles give the order "rarest first". A set
   with fewer than T shared shingles is out; of the others the prefix that any linked set must
   meet joins sets to families (components of a graph without edges between all members).
4. A family is one block, or tiles of two slots each where it is large. Within a block
   every set searches the inverted lists: short lists are merged and counted, and for those that
   occur often enough the L longest lists are probed by binary search (DivideSkip); what
   reaches the required overlap links. Sets already connected are not compared again, so only a
   spanning forest leaves the task.
5. Components of the links.

Defined results: NULL and empty texts have an empty set and link with nothing, not with each
other; fewer words than ``size`` make one shingle of them all; rows of one id are one document, which has
the links of all their texts; NULL ids get no component; other columns are ignored. ids are integers.
``deduplicate`` keeps of each group the rows of the smallest id, and all rows with NULL id.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import drawn_seed
from .buffers import BASES, Rolling, blocks_of, folded, mixed, words_of
from .common import fresh, stored
from .components import components

#: Shingles of the prefixes per bucket of the filter, about.
BUCKET = 400_000
#: Shingles of the sets in one slot of a large family.
SLOT = 400_000
#: Most sets whose ids are broadcast to fetch their texts; beyond it the join shuffles.
BROADCAST_SETS = 2_000_000


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int, seed: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    import xxhash

    data = folded(data)
    starts, stops, first = words_of(data, ends)
    raw, h = data.tobytes(), xxhash.xxh3_64_intdigest
    words = np.fromiter((h(raw[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts))
    rolling = Rolling(words, BASES[1])
    every = rolling.windows(size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        else:
            out.append(rolling.ranges(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return out


def least_overlap(n, percent: int):
    """The least overlap with which a set of n elements can link."""
    return -(-percent * n // 100)


def _spare(n):
    """Shared prefix elements that the filter asks for (l above)."""
    return np.maximum(1, n // 10)


def _owner(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set as two integers."""
    import xxhash

    return struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes()))


def described(docs: DataFrame, key: str, text: str, size: int, seed: int) -> DataFrame:
    """(id, n, h1, h2): size and hashes of every document's set."""

    def run(batches):
        for batch in batches:
            for part, data, ends in blocks_of(batch, text):
                sets = shingle_sets(data, ends, size, seed)
                hashes = [_owner(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([h[0] for h in hashes], pa.int64()),
                        pa.array([h[1] for h in hashes], pa.int64()),
                    ],
                    ["id", "n", "h1", "h2"],
                )

    return docs.select(key, text).mapInArrow(run, "id long, n long, h1 long, h2 long")


def _bucket_rows(tokens: np.ndarray, owners: np.ndarray, flags: np.ndarray, buckets: int):
    """Packed rows of (bucket, tokens, owners, flags), split by token."""
    bucket = (tokens >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, tokens, owners, flags = bucket[order], tokens[order], owners[order], flags[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    at = [0, *cuts.tolist()]
    to = [*cuts.tolist(), len(bucket)]
    names, local = np.unique(owners, return_inverse=True)
    small = local.astype("<u2") if len(names) < 65536 else local.astype("<u4")
    # Owners are numbered within the block; a row lists those it needs.
    out = []
    for a, b in zip(at, to, strict=True):
        used, short = np.unique(small[a:b], return_inverse=True)
        width = "<u2" if len(used) < 65536 else "<u4"
        out.append((int(bucket[a]), tokens[a:b].tobytes(), names[used].tobytes(), short.astype(width).tobytes(), np.packbits(flags[a:b]).tobytes()))
    return out


def _unpacked(batch: pa.RecordBatch):
    """(tokens, owners, flags) of all rows of a batch."""
    tokens, owners, flags = [], [], []
    for t, names, short, f in zip(*(batch.column(c).to_pylist() for c in ("tokens", "names", "short", "flags")), strict=True):
        t, names = np.frombuffer(t, np.uint64), np.frombuffer(names, np.int64)
        short = np.frombuffer(short, "<u2" if len(names) < 65536 else "<u4")
        tokens.append(t)
        owners.append(names[short])
        flags.append(np.unpackbits(np.frombuffer(f, np.uint8), count=len(t)).astype(bool))
    return np.concatenate(tokens), np.concatenate(owners), np.concatenate(flags)


PACKED = "bucket long, tokens binary, names binary, short binary, flags binary"


def _packed_batch(rows):
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["bucket", "tokens", "names", "short", "flags"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _by_bucket(batches):
    """Batches of whole buckets from rows sorted by bucket."""
    at, held = None, []
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if buckets[a] != at and held:
                yield held
                held = []
            at = buckets[a]
            held.append(_unpacked(batch.slice(a, b - a)))
    if held:
        yield held


def shared_prefix_counts(docs: DataFrame, text: str, size: int, percent: int, buckets: int, seed: int) -> DataFrame:
    """(h1, shared): how many elements of each set's prefix another set's prefix shares."""

    def send(batches):
        for batch in batches:
            for _, data, ends in blocks_of(batch, text):
                sets = {}
                for s in shingle_sets(data, ends, size, seed):
                    if len(s):
                        sets.setdefault(_owner(s)[0], s)
                if not sets:
                    continue
                tokens, owners = [], []
                for h1, s in sets.items():
                    n = len(s)
                    keep = s[: min(n, n - int(least_overlap(n, percent)) + int(_spare(np.int64(n))))]
                    tokens.append(keep)
                    owners.append(np.full(len(keep), h1, np.int64))
                tokens, owners = np.concatenate(tokens), np.concatenate(owners)
                order = np.argsort(tokens, kind="stable")
                tokens, owners = tokens[order], owners[order]
                new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
                group = np.cumsum(new) - 1
                often = (np.bincount(group) > 1)[group]
                # Shared within the block: counted here, and sent once with a flag for the others.
                rows = _bucket_rows(tokens[~often | new], owners[~often | new], often[~often | new], buckets)
                names, counts = np.unique(owners[often], return_counts=True)
                if len(names):
                    rows.append((-1, b"", names.tobytes(), b"", counts.astype(np.int64).tobytes()))
                yield _packed_batch(rows)

    def count(batches):
        def batch_of(names, counts):
            """Counts packed by groups of sets, so that a set is not a row in every bucket."""
            home = mixed(names.view(np.uint64)) % np.uint64(buckets)
            order = np.argsort(home, kind="stable")
            home, names, counts = home[order], names[order], counts[order].astype(np.int64)
            cuts = (np.flatnonzero(np.diff(home)) + 1).tolist()
            spans = zip([0, *cuts], [*cuts, len(home)], strict=True)
            return _packed_batch([(int(home[a]), b"", names[a:b].tobytes(), b"", counts[a:b].tobytes()) for a, b in spans])

        def reduce(held):
            tokens, owners, flags = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((owners, tokens))
            tokens, owners, flags = tokens[order], owners[order], flags[order]
            new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
            group = np.cumsum(new) - 1
            fresh = np.concatenate(([True], (owners[1:] != owners[:-1]) | new[1:]))
            sets = np.bincount(group, weights=fresh)
            marked = np.bincount(group, weights=flags) > 0
            shared = ((sets > 1) | marked)[group] & fresh
            # A flagged entry was counted by its own block.
            return np.unique(owners[shared & ~flags], return_counts=True)

        def own(source):
            for batch in source:
                local = batch.column("bucket").to_numpy() < 0
                for at in np.flatnonzero(local).tolist():
                    passed.append((np.frombuffer(batch.column("names")[at].as_py(), np.int64), np.frombuffer(batch.column("flags")[at].as_py(), np.int64)))
                rest = batch.filter(pa.array(~local))
                if rest.num_rows:
                    yield rest

        passed: list = []
        for held in _by_bucket(own(batches)):
            while passed:
                yield batch_of(*passed.pop())
            found = reduce(held)
            if len(found[0]):
                yield batch_of(*found)
        while passed:
            yield batch_of(*passed.pop())

    sent = docs.select(text).mapInArrow(send, PACKED)
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("names"), F.lit(buckets))).otherwise(F.col("bucket"))
    counted = sent.repartition(spread).sortWithinPartitions("bucket").mapInArrow(count, PACKED)
    return counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_summed, "h1 long, shared long")


def _summed(batches):
    """(h1, shared) once per set, from packed counts sorted by group."""

    def total(held):
        names, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        known, place = np.unique(names, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(known), pa.array(np.bincount(place, weights=counts).astype(np.int64))], ["h1", "shared"])

    at, held = None, []
    for batch in batches:
        for bucket, names, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "names", "flags")), strict=True):
            if bucket != at and held:
                yield total(held)
                held = []
            at = bucket
            held.append((np.frombuffer(names, np.int64), np.frombuffer(counts, np.int64)))
    if held:
        yield total(held)


def full_sets(docs: DataFrame, key: str, text: str, size: int, seed: int) -> DataFrame:
    """(id, n, h1, h2, set): the whole sets as packed integers."""

    def run(batches):
        for batch in batches:
            for part, data, ends in blocks_of(batch, text):
                sets = shingle_sets(data, ends, size, seed)
                h1, h2 = zip(*map(_owner, sets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(h1, pa.int64()),
                        pa.array(h2, pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["id", "n", "h1", "h2", "set"],
                )

    return docs.select(key, text).mapInArrow(run, "id long, n long, h1 long, h2 long, set binary")


def _packed_sets(bucket: np.ndarray, tokens: np.ndarray, owners: np.ndarray, ids: np.ndarray, sizes: np.ndarray, times: np.ndarray):
    """Rows of (bucket, tokens, names, short, flags): names are pairs of id and set size, flags hold ``times``."""
    order = np.argsort(bucket, kind="stable")
    bucket, tokens, owners, times = bucket[order], tokens[order], owners[order], times[order]
    cuts = (np.flatnonzero(np.diff(bucket)) + 1).tolist()
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
        used, short = np.unique(owners[a:b], return_inverse=True)
        names = np.column_stack([ids[used], sizes[used]]).astype("<i8")
        out.append((int(bucket[a]), tokens[a:b].tobytes(), names.tobytes(), short.astype("<u4").tobytes(), times[a:b].astype("<u4").tobytes()))
    return out


def _whole_buckets(batches):
    """(tokens, ids, sizes, times) of one bucket after the other, from rows sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for bucket, *packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tokens", "names", "short", "flags")), strict=True):
            if bucket != at and held:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            at = bucket
            names = np.frombuffer(packed[1], "<i8").reshape(-1, 2)[np.frombuffer(packed[2], "<u4")]
            held.append((np.frombuffer(packed[0], np.uint64), names[:, 0], names[:, 1], np.frombuffer(packed[3], "<u4")))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def rare_prefixes(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(token, id): of sets with at least T shared elements, the rarest shared - T + 1 of those.

    Shingles go packed to buckets that count them, and back packed to groups of sets.
    """

    def send(batches):
        for batch in batches:
            ids, packed = batch.column("id").to_numpy(), batch.column("set").to_pylist()
            for a in range(0, len(ids), 256):
                part = [np.frombuffer(s, np.uint64) for s in packed[a : a + 256]]
                tokens = np.concatenate(part)
                sizes = np.array([len(s) for s in part])
                owners = np.repeat(np.arange(len(part)), sizes)
                bucket = (tokens >> np.uint64(20)) % np.uint64(buckets)
                if len(tokens):
                    yield _packed_batch(_packed_sets(bucket, tokens, owners, ids[a : a + 256], sizes, np.zeros(len(tokens))))

    def frequency(batches):
        for tokens, ids, sizes, _ in _whole_buckets(batches):
            _, group, times = np.unique(tokens, return_inverse=True, return_counts=True)
            often = times[group] > 1
            if not often.any():
                continue
            names, first, owners = np.unique(ids[often], return_index=True, return_inverse=True)
            home = mixed(names.view(np.uint64)) % np.uint64(buckets)
            yield _packed_batch(_packed_sets(home[owners], tokens[often], owners, names, sizes[often][first], times[group][often]))

    def choose(batches):
        for tokens, ids, sizes, times in _whole_buckets(batches):
            order = np.lexsort((tokens, times, ids))
            tokens, ids, sizes = tokens[order], ids[order], sizes[order]
            _, first, owner, count = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
            need = count - least_overlap(sizes[first], percent) + 1
            kept = np.arange(len(ids)) - first[owner] < need[owner]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[kept].view(np.int64)), pa.array(ids[kept])], ["token", "id"])

    def grouped(rows):
        return rows.repartition("bucket").sortWithinPartitions("bucket")

    counted = grouped(sets.select("id", "set").mapInArrow(send, PACKED)).mapInArrow(frequency, PACKED)
    return grouped(counted).mapInArrow(choose, "token long, id long")


def search(ids: np.ndarray, sets: list[np.ndarray], percent: int, other=None) -> list[tuple[int, int]]:
    """Links that connect all linked sets of one block, by T-occurrence search.

    Sets are visited by growing size and search the lists of those before them. ``other``
    gives a slot to each set: sets of the same slot are then left to another tile.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
    sizes = np.array([len(sets[i]) for i in order])
    tokens = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    _, token = np.unique(tokens, return_inverse=True)
    by_token = np.argsort(token, kind="stable")  # inverted lists, each in growing order
    lists = owner[by_token]
    begin = np.concatenate(([0], np.cumsum(np.bincount(token))))
    own = np.concatenate(([0], np.cumsum(sizes)))
    group = np.arange(len(order))  # sets found to be connected have equal numbers
    slots = None if other is None else np.asarray(other)[order]

    links = []
    for q in range(1, len(order)):
        n = int(sizes[q])
        need = int(least_overlap(n, percent))
        low = int(np.searchsorted(sizes[:q], need))  # smaller sets cannot reach the overlap
        if low >= q:
            continue
        terms = token[own[q] : own[q + 1]]
        a = begin[terms]
        b = begin[terms + 1]
        width = b - a
        terms, a, b = terms[width > 1], a[width > 1], b[width > 1]
        if len(terms) < need:
            continue
        # The L longest lists are only probed; a candidate must occur need - L times in the others.
        rank = np.argsort(b - a, kind="stable")
        a, b = a[rank], b[rank]
        long = max(0, min(need - 1, int(need / (0.01 * np.log2(b[-1] - a[-1] + 1) + 1))))
        cut = len(a) - long
        merged = np.concatenate([lists[x:y] for x, y in zip(a[:cut].tolist(), b[:cut].tolist(), strict=True)])
        merged = merged[(merged >= low) & (merged < q)]
        merged.sort(kind="stable")  # merges the sorted lists
        if not len(merged):
            continue
        edge = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        seen = np.diff(np.concatenate((edge, [len(merged)])))
        close = seen >= need - long
        candidates, seen = merged[edge][close], seen[close]
        apart = group[candidates] != group[q]
        if slots is not None:
            apart &= slots[candidates] != slots[q]
        candidates, total = candidates[apart], seen[apart].copy()
        if not len(candidates):
            continue
        for x, y in zip(a[cut:].tolist(), b[cut:].tolist(), strict=True):
            own_list = lists[x:y]
            total += own_list[np.minimum(np.searchsorted(own_list, candidates), y - x - 1)] == candidates
        required = -(-percent * (n + sizes[candidates]) // (100 + percent))
        for c in candidates[total >= required].tolist():
            if group[c] != group[q]:
                links.append((int(ids[order[q]]), int(ids[order[c]])))
                group[group == group[c]] = group[q]
    return links


def linked_pairs(sets: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each family."""
    placed = sets.join(families, sets["id"] == families["node"]).select("id", "n", "set", F.col("root").alias("family"))
    weight = placed.groupBy("family").agg(F.sum("n").alias("total"))
    slots = F.ceil(F.col("total") / SLOT).cast("int")
    rows = placed.join(weight, "family").select("id", "set", "family", slots.alias("slots"), F.pmod(F.xxhash64("id"), slots).cast("int").alias("slot"))
    # Tile (i, j) with i <= j holds slots i and j; a set goes to one tile per slot.
    other = F.explode_outer(F.sequence(F.lit(0), F.col("slots") - 1)).alias("other")
    tiles = rows.select("id", "set", "family", "slot", other).select(
        "id", "set", "family", "slot", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j")
    )

    def run(batches):
        at, ids, sets, slot = None, [], [], []

        def closed():
            if len(ids) < 2:
                return None
            apart = None if at[1] == at[2] else slot
            links = search(np.array(ids), sets, percent, apart)
            if not links:
                return None
            a, b = zip(*links, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("family", "i", "j", "id", "set", "slot"))
            for family, i, j, doc, packed, s in zip(*columns, strict=True):
                if (family, i, j) != at:
                    out = closed()
                    if out is not None:
                        yield out
                    at, ids, sets, slot = (family, i, j), [], [], []
                ids.append(doc)
                sets.append(np.frombuffer(packed, np.uint64))
                slot.append(s)
        out = closed()
        if out is not None:
            yield out

    # As many tasks as the session shuffles to: the search costs more than its bytes tell.
    width = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(width, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    seed = drawn_seed()
    sets = stored(described(docs, key, text, size, seed), "sets")
    whole = sets.where("n > 0 and id is not null")
    # Equal sets are one node; its smallest id tells where to find the text.
    distinct = whole.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id())
    distinct = stored(distinct, "distinct-sets")
    prefix = distinct.agg(F.sum(F.col("n") * (1.1 - percent / 100) + 2).alias("t")).first()["t"] or 0
    buckets = max(16, int(prefix // BUCKET) + 1)
    counts = shared_prefix_counts(docs, text, size, percent, buckets, seed)
    # A set may meet a smaller one, whose prefix promises fewer shared elements.
    smallest = F.ceil(F.col("n") * percent / 100)
    promised = F.greatest(F.lit(1), F.floor(smallest / 10))
    left = stored(distinct.join(counts, "h1").where(F.col("shared") >= promised).select("rep", "h1", "h2", "node"), "similar-sets")
    hint = F.broadcast if left.count() <= BROADCAST_SETS else (lambda df: df)
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    chosen = known.join(hint(left.select("rep").distinct()), F.col("id") == F.col("rep"), "left_semi")
    found = full_sets(chosen, "id", "text", size, seed).join(hint(left), ["h1", "h2"]).where("id = rep")
    full = stored(found.select(F.col("node").alias("id"), "n", "set").dropDuplicates(["id"]), "full-sets")
    rare = stored(rare_prefixes(full, percent, max(16, int((full.agg(F.sum("n").alias("t")).first()["t"] or 0) // BUCKET) + 1)), "rare")
    heads = rare.groupBy("token").agg(F.min("id").alias("head"), F.count("*").alias("c")).where("c > 1").select("token", "head")
    edges = rare.join(heads, "token").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    families = components(edges)
    links = linked_pairs(full, families, percent)
    again = stored(sets.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    repeated = bool(again.take(1))
    if repeated:  # different texts of one id hang together
        owned = stored(whole.join(again, "id", "left_semi").join(distinct, ["h1", "h2", "n"]).select("id", "node").distinct(), "owned-sets")
        heads = owned.groupBy("id").agg(F.min("node").alias("a"))
        links = links.unionByName(owned.join(heads, "id").select("a", F.col("node").alias("b")))
    rooted = distinct.join(components(stored(links, "links")).withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    rooted = rooted.select("h1", "h2", "n", "rep", "node", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    rooted = rooted.join(least, "root").select("h1", "h2", "n", "node", "component")
    rows = sets.join(rooted.drop("node"), ["h1", "h2", "n"], "left")
    component = F.coalesce("component", "id")
    if repeated:  # and their rows without words go along
        named = owned.join(rooted, "node").groupBy(F.col("id").alias("named")).agg(F.min("component").alias("own"))
        rows = rows.join(named, F.col("id") == F.col("named"), "left")
        component = F.coalesce("component", "own", "id")
    component = F.when(F.col("id").isNotNull(), component)
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One document of each group, that with the smallest id, with the columns it came with."""
    found, gone = near_duplicates(docs, key, text, size, percent), fresh(docs, "gone")
    drop = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(gone)).distinct()
    return docs.join(drop, F.col(key) == F.col(gone), "left_anti")
