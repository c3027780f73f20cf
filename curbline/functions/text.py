"""Free-text expressions. All patterns are Unicode-aware (``(?U)``)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .taxonomy import CONNECTORS, ISSUE_KEYWORDS, ISSUE_OWNER, lookup

THIN_BELOW = 12
MULTI_WORDS = 6


def replaced(text: Column, pattern: str, by: str, needs) -> Column:
    """``regexp_replace``, only of texts that pass the cheaper ``needs``, which no text with a match fails.

    The text is bound to a variable, so that it is worked out once.
    """
    change = lambda t: F.when(needs(t), F.regexp_replace(t, pattern, by)).otherwise(t)
    return F.transform(F.array(text), change)[0]


def _ends(pattern: str):
    """Texts whose first or last character fits."""
    return lambda t: F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))).rlike(pattern)


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return replaced(c, r"(?U)^\s+|\s+$", "", _ends(r"(?U)\s"))


def ticket_text(complaint_type: Column, descriptor: Column) -> Column:
    joined = F.concat(
        F.coalesce(complaint_type, F.lit("")), F.lit(": "), F.coalesce(descriptor, F.lit(""))
    )
    # "$" also stands before a last line break.
    return strip(replaced(joined, "^[: ]+|[: ]+$", "", _ends(r"(?U)[:\s]")))


def category_hit(lowered: Column, keywords) -> Column:
    alternatives = "|".join(re.escape(k) for k in keywords)
    # Whether a word begins is asked only where a keyword can: that question is dear at every character.
    first = f"(?=[{''.join(sorted({re.escape(k[0]) for k in keywords}))}])" if all(keywords) else ""
    return lowered.rlike(rf"(?U){first}\b(?:{alternatives})")


def issue_categories(text: Column, table: dict[str, tuple] = ISSUE_KEYWORDS) -> Column:
    """Sorted array of the categories whose keywords start a word of the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(
        F.array(*[F.when(category_hit(low, table[name]), F.lit(name)) for name in sorted(table)])
    )


def is_thin(text: Column, below: int = THIN_BELOW) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < below


def joins_issues(text: Column, categories: Column) -> Column:
    """Two categories, or one category in a connected sentence of six words or more."""
    low = F.lower(F.coalesce(text, F.lit("")))
    connected = F.lit(False)
    for phrase in CONNECTORS:
        connected = connected | low.contains(phrase)
    wordy = F.regexp_count(low, F.lit(r"(?U)\w+")) >= MULTI_WORDS
    return (F.size(categories) >= 2) | (connected & (F.size(categories) >= 1) & wordy)


def text_flags(df: DataFrame, column: str = "descriptor", table=ISSUE_KEYWORDS) -> DataFrame:
    """Add ``categories``, ``thin_text``, ``multi_issue`` and ``ambiguous``."""
    text = F.col(column)
    return (
        df.withColumn("categories", issue_categories(text, table))
        .withColumn("thin_text", is_thin(text))
        .withColumn("multi_issue", joins_issues(text, F.col("categories")))
        .withColumn("ambiguous", F.col("thin_text") | F.col("multi_issue"))
    )


def multi_agency(
    df: DataFrame,
    complaint_type: str = "complaint_type",
    descriptor: str = "descriptor",
    keywords=ISSUE_KEYWORDS,
    owners: dict[str, str] = ISSUE_OWNER,
) -> DataFrame:
    """Add the sorted ``agencies`` that own the text's issues, and ``is_multi``."""
    text = F.concat(
        F.coalesce(F.col(complaint_type), F.lit("")),
        F.lit(" "),
        F.coalesce(F.col(descriptor), F.lit("")),
    )
    owner = F.transform(issue_categories(text, keywords), lambda c: lookup(owners, c))
    return df.withColumn(
        "agencies", F.array_sort(F.array_distinct(F.array_compact(owner)))
    ).withColumn("is_multi", F.size("agencies") >= 2)


def tokens(text: Column) -> Column:
    """Lower-cased word tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def joined_tokens(text: Column) -> Column:
    """The ``tokens`` of a text in one string, parted by blanks, which no token holds."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", " "))
