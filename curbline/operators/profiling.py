"""Profiles of the tickets' free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import text_flags
from .ordering import first_n


def profile_ambiguity(
    tickets: DataFrame,
    key: str = "id",
    text: str = "descriptor",
    status: str = "status",
    max_examples: int = 10,
) -> DataFrame:
    """One row: counts and share of thin and multi-issue texts, and the first examples.

    Tickets that are marked as duplicates do not count. ``examples`` is an array of the texts of
    the ``max_examples`` multi-issue tickets with the smallest keys.
    """
    counted = tickets.filter(~F.col(status).eqNullSafe(F.lit("DUPLICATE")))
    flags = text_flags(counted.select(key, text), text)
    totals = flags.agg(
        F.count("*").alias("total"),
        F.count_if("thin_text").alias("thin_text"),
        F.count_if("multi_issue").alias("multi_issue"),
        F.count_if("ambiguous").alias("ambiguous"),
        F.round(
            F.coalesce(F.try_divide(F.count_if("ambiguous"), F.count("*")), F.lit(0.0)), 4
        ).alias("ambiguous_fraction"),
    )
    shown = first_n(flags.filter("multi_issue").select(key, text), [key], max_examples)
    examples = shown.agg(  # at most ``max_examples`` texts
        F.transform(F.sort_array(F.collect_list(F.struct(key, text))), lambda x: x[text]).alias("examples")
    )
    return totals.join(F.broadcast(examples))  # one row each
