"""What each operator must give, in plain Python over lists of (id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

UP = {i: i + 32 for i in range(65, 91)}


def low(t):
    return (t or "").translate(UP)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[low(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, sha(low(t))))
    return out


def byte_repeats(rows, window):
    seen = Counter((t or "").encode()[p : p + window] for _, t in rows for p in range(len((t or "").encode()) - window + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def words(t):
    return re.findall(r"[^ \t-\r]+", t or "")


def word_repeats(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(t, size=5):
    w = words(low(t))
    if not w:
        return frozenset()
    return frozenset(tuple(w[p : p + size]) for p in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def near(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def contaminated(rows, items, n=13):
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        size = min(n, len(w))
        for p in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[p : p + size])].add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w = bench_words(t)
        hit, found = set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                k = tuple(w[p : p + size])
                if k in windows:
                    hit.update(range(p, p + size))
                    found |= windows[k]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def fingerprint(t, size=3):
    import xxhash

    w = words(low(t))
    grams = [" ".join(w[p : p + size]) for p in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def hamming_groups(prints, radius=2):
    """{id: smallest id reachable} of (id, fingerprint) pairs; NULL ids take no part."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(i, f) for i, f in prints if i is not None]
    for k, (i, f) in enumerate(known):
        for j, g in known[:k]:
            if (f ^ g).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: None if i is None else find(i) for i in root}


def usable(vector, dims=None):
    import math

    return vector is not None and (dims is None or len(vector) == dims) and all(x is not None and math.isfinite(x) for x in vector)


def clusters(rows, k=8, rounds=10, scale=1024, dims=64, salt="3:"):
    """(id, cluster, distance, cluster sum, sum, digest) of (id, vector) rows."""
    import math

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if usable(v, dims)]
    start = sorted((sha(f"{salt}{i}"), i, v) for i, v in kept if i is not None)
    centres = [v for _, _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        for n, vs in members.items():
            centres[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, n, d in found:
        sums[n] += d
    return [(i, n, d, sums[n], sum(sums.values()), sha(",".join(map(str, centres[n])))) for i, n, d in found]


def hard_negatives(rows, positives=5, negatives=3, low=50, high=95, scale=256, every=50):
    """(anchor, positive, rank, negative, positive score, negative score) of (id, label, vector) rows."""
    import math

    kept = {(i, label, tuple(math.floor(scale * x) for x in v)) for i, label, v in rows if i is not None and label is not None and usable(v)}
    out = set()
    for i, label, v in kept:
        if i % every:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept)
        near = [(j, -s) for s, j, other in ranked if other == label and j != i][:positives]
        for j, score in near:
            hard = [(n, -s) for s, n, other in ranked if other != label and low * score <= 100 * -s <= high * score]
            out |= {(i, j, r, n, score, s) for r, (n, s) in enumerate(hard[:negatives], 1)}
    return out
