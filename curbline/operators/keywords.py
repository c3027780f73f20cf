"""Categories of texts by long keyword tables: one pass with an automaton.

``functions.text.issue_categories`` tests one regular expression per category, which is right for
a handful of words. For thousands of keywords an Aho-Corasick automaton finds all of them in
one pass over the text. It is built once per Python worker from the broadcast table.
"""

from __future__ import annotations

import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import appended

#: Most characters of a keyword table; it is held by every task.
LARGEST_TABLE = 64 << 20
_built: dict = {}


def _inside_word(c: str) -> bool:
    """Letters, marks, numbers and connectors belong to words."""
    kind = unicodedata.category(c)
    return kind[0] in "LMN" or kind == "Pc"


def _automaton(name: str, table: dict[str, list[str]]):
    import ahocorasick

    if name not in _built:
        owners: dict[str, list[str]] = {}
        for category, words in table.items():
            for word in words:
                owners.setdefault(word.lower(), []).append(category)
        machine = ahocorasick.Automaton()
        for word, categories in owners.items():
            machine.add_word(word, (len(word), _inside_word(word[0]), tuple(categories)))
        if owners:
            machine.make_automaton()
        _built.clear()  # one table at a time per worker
        _built[name] = machine if owners else None
    return _built[name]


def categories_in(text: str | None, machine) -> list[str]:
    """Sorted categories with a keyword that starts a word of the lower-cased text."""
    if not text or machine is None:
        return []
    low, found = text.lower(), set()
    for end, (size, wordy, owners) in machine.iter(low):
        start = end - size + 1
        if start == 0 or _inside_word(low[start - 1]) != wordy:
            found.update(owners)
    return sorted(found)


def with_keyword_categories(
    df: DataFrame, text: str | Column, table: dict[str, list[str]], name: str = "categories"
) -> DataFrame:
    """``df`` with the sorted array of categories whose keywords start a word of ``text``.

    Empty keywords are left out; NULL and empty texts have no category. One pass, no shuffle.
    """
    table = {c: [w for w in words if w] for c, words in table.items()}
    size = sum(len(w) for words in table.values() for w in words)
    if size > LARGEST_TABLE:
        raise ValueError(f"a keyword table of {size} characters is not sent to every task")
    shared, label = df.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex
    wanted = F.col(text) if isinstance(text, str) else text

    def find(batch: pa.RecordBatch) -> pa.Array:
        machine = _automaton(label, shared.value)
        return pa.array([categories_in(t, machine) for t in batch.column("_text").to_pylist()], pa.list_(pa.string()))

    return appended(df.withColumn("_text", wanted), name, "array<string>", find, drop="_text")
