"""Benchmark decontamination by a broadcast set of normalised n-grams.

Only DataFrame functions run here. A window is ``n`` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window.

Every window of L words that occurs in a document holds one whole block of
b = (L + 1) // 2 words that starts at a multiple of b in the document. So the scan
hashes one block per b words, looks it up in the broadcast set of all blocks of all
windows, and only documents with a hit go on to the exact comparison of every window as
text. Both lookups follow one shuffle by document, and what a document shuffles is its
text once if it has a hit, and a few bytes otherwise.

All explodes are outer ones: over a plain explode Spark infers a filter on the array's size
and evaluates the whole splitting again below the projection, once per element.

Defined results: a NULL or empty text has no words and is never hit; rows with equal id
and text count as one document, rows with equal or NULL id and different texts as several; an
empty benchmark hits nothing; other columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, fresh

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most rows of the benchmark's window table that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 4_000_000
#: Every document also looks up one of so many marks, which brings its word count along.
MARKS = 1024


def folded_words(text: Column) -> Column:
    """Words after lower-casing A-Z: runs of digits, letters and anything beyond ASCII."""
    folded = F.translate(text, UPPER, UPPER.lower())
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), SEPARATOR), "")


def benchmark_windows(benchmark: DataFrame, n: int = 13, item: str = "item_id", text: str = "text") -> DataFrame:
    """(length, gram, items): every distinct window as text, with the items that hold it."""
    words = benchmark.select(F.col(item).alias("item"), folded_words(F.col(text)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(n))
    windows = words.select("item", length.alias("length"), F.explode_outer(_grams("words", length)).alias("gram"))
    return windows.groupBy("length", "gram").agg(F.collect_set(F.col("item").cast("string")).alias("items"))


def _grams(words: str, length: Column) -> Column:
    """All runs of ``length`` words, each joined by spaces; none if there are fewer words."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - length + 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(F.col(words), i, length), " "))
    return F.coalesce(runs, F.array().cast("array<string>"))


def _placed_grams(words: str, length: int) -> Column:
    """The same runs as structs (length, start, gram); starts count from 0."""
    return F.transform(
        _grams(words, F.lit(length)),
        lambda g, i: F.struct(F.lit(length).alias("length"), i.cast("int").alias("start"), g.alias("gram")),
    )


def _runs_hashed(words: str, b: int) -> Column:
    """Hashes of all runs of b words, for arrays of at least b words."""
    starts = F.sequence(F.lit(1), F.size(words) - b + 1)
    return F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(words), i, b)))


def _blocks(words: Column, b: int) -> Column:
    """Hashes of the whole blocks of b words that start at multiples of b."""
    count = F.floor(F.size(words) / b).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    hashes = F.transform(starts, lambda k: F.xxhash64(F.slice(words, k * b + 1, b)))
    return F.coalesce(hashes, F.array().cast("array<bigint>"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    positions: bool = False,
) -> DataFrame:
    """(key, n_words, n_hit, items) per document.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` lists the items
    with occurring windows, sorted. ``positions`` adds ``hit``, the places of those words.
    ``version`` is the hash of the text, which tells rows of one key apart.
    """
    windows = benchmark_windows(benchmark, n, item, item_text)
    # One row: the number of windows and the window lengths, at most n of them.
    facts = windows.agg(F.count("*").alias("rows"), F.collect_set("length").alias("lengths")).first()
    lengths = sorted(facts["lengths"])
    small = facts["rows"] * max(1, n // 2) <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df.hint("merge"))

    spark = docs.sparkSession
    marks = spark.range(MARKS).select(F.col("id").alias("block"))
    blocks = marks
    for b in sorted({(length + 1) // 2 for length in lengths}):
        own = [length for length in lengths if (length + 1) // 2 == b]
        parts = windows.where(F.col("length").isin(own)).select(F.split("gram", " ").alias("words"))
        blocks = blocks.unionByName(parts.select(F.explode_outer(_runs_hashed("words", b)).alias("block")))
    blocks = blocks.distinct()

    words = docs.select(
        F.col(key).alias("_id"),
        F.xxhash64(F.col(text)).alias("_version"),
        F.col(text).alias("_text"),
        folded_words(F.col(text)).alias("_words"),
    )
    mark = F.pmod(F.xxhash64("_id", "_version"), F.lit(MARKS))
    looked_up = F.array(mark)
    for b in sorted({(length + 1) // 2 for length in lengths}):
        looked_up = F.concat(looked_up, _blocks(F.col("_words"), b))
    per_doc = _first_pass(words, F.array_distinct(looked_up), hint(blocks), small)

    # Exact pass over the documents with hits; those without bring an empty list and one mark.
    exact = per_doc.select("_id", "_version", "_n", folded_words(F.col("_text")).alias("_words"))
    candidates = F.array().cast("array<struct<length:int,start:int,gram:string>>")
    for length in lengths:
        candidates = F.concat(candidates, _placed_grams("_words", length))
    nothing = F.struct(F.lit(0).alias("length"), F.lit(0).alias("start"), F.lit("").alias("gram"))
    mark_row = spark.range(1).select(
        F.lit(0).alias("length"), F.lit("").alias("gram"), F.array().cast("array<string>").alias("items")
    )
    exploded = exact.select(
        "_id", "_version", "_n", F.explode_outer(F.concat(F.array(nothing), candidates)).alias("w")
    ).select("_id", "_version", "_n", "w.length", "w.start", "w.gram")
    matched = exploded.join(hint(windows.unionByName(mark_row)), ["length", "gram"])
    hit = F.when(F.col("length") > 0, F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))
    out = matched.groupBy("_id", "_version").agg(
        F.max("_n").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list(hit))).alias("_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    columns = [F.col("_id").alias(key), "n_words", F.size("_hit").alias("n_hit"), "items", F.col("_version").alias("version")]
    if positions:
        columns.append(F.col("_hit").alias("hit"))
    return out.select(*columns)


def _first_pass(words: DataFrame, looked_up: Column, blocks: DataFrame, small: bool) -> DataFrame:
    """(_id, _version, _n, _text) per document; the text only where a block is found."""
    real = ~F.col("block").between(0, MARKS - 1)
    if small:  # the text stays beside the rows of its blocks in the task, and goes on once
        rows = words.select("_id", "_version", "_text", F.size("_words").alias("_n"), looked_up.alias("_blocks"))
        rows = rows.select("_id", "_version", "_text", "_n", F.explode_outer("_blocks").alias("block"))
        found = rows.join(blocks, "block").select("_id", "_version", "_n", F.when(real, F.col("_text")).alias("_text"))
        return found.groupBy("_id", "_version").agg(F.max("_n").alias("_n"), F.max("_text").alias("_text"))
    rows = words.select("_id", "_version", F.size("_words").alias("_n"), looked_up.alias("_blocks"))
    rows = rows.select("_id", "_version", "_n", F.explode_outer("_blocks").alias("block"))
    found = rows.join(blocks, "block").groupBy("_id", "_version").agg(F.max("_n").alias("_n"), F.max(real).alias("_found"))
    texts = words.select(F.col("_id").alias("_id2"), F.col("_version").alias("_version2"), "_text").dropDuplicates(["_id2", "_version2"])
    same = F.col("_found") & F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_version") == F.col("_version2"))
    return found.join(texts, same, "left").select("_id", "_version", "_n", "_text")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule for dropping a document: a twentieth of its words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "document", n: int = 13, key: str = "doc_id") -> DataFrame:
    """Documents without benchmark passages, with the columns they came with.

    ``action="document"`` drops contaminated documents; ``"span"`` keeps every document
    and removes the hit words, which leaves the other words joined by spaces.
    """
    if action not in ("document", "span"):
        raise ValueError("action is 'document' or 'span'")
    found = contamination(docs, benchmark, n, key, positions=action == "span").where(F.col("n_hit") > 0)
    other, hit, version = (fresh(docs, c) for c in ("other", "hit", "version"))
    same = F.col(key).eqNullSafe(F.col(other)) & (F.xxhash64("text") == F.col(version))
    if action == "document":
        drop = found.where(contaminated(F.col("n_hit"), F.col("n_words")))
        return docs.join(drop.select(F.col(key).alias(other), F.col("version").alias(version)).distinct(), same, "left_anti")
    found = found.select(F.col(key).alias(other), F.col("hit").alias(hit), F.col("version").alias(version))
    joined = docs.join(found, same, "left")
    whole = F.array_remove(F.split(F.coalesce("text", F.lit("")), SEPARATOR_ANY_CASE), "")
    left = F.array_join(F.filter(whole, lambda w, i: ~F.array_contains(F.col(hit), i)), " ")
    clean = F.when(F.col(hit).isNotNull(), left).otherwise(F.col("text"))
    return joined.select(*(clean.alias("text") if c == "text" else F.col(c) for c in docs.columns))
