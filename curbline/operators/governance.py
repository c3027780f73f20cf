"""Leakage guards, validation, quarantine and data policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.redaction import masked
from ..functions.taxonomy import is_agency
from ..functions.text import ticket_text
from .landing import malformed

# Columns by class of the inference contract.
AS_OF_INPUT = ("id", "text", "coarse_latitude", "coarse_longitude", "created_date")
PROHIBITED = (
    "agency",
    "truth",
    "closed_date",
    "status",
    "resolution",
    "resolution_description",
    "due_date",
)

SPLIT_CAP = 3
COARSE_CELLS = 100  # per degree


def coarse(c) -> Column:
    """Corner of the grid cell a coordinate lies in."""
    return F.floor(F.col(c) * COARSE_CELLS) / COARSE_CELLS


class LeakageError(ValueError):
    """A prediction input carries a target or a later outcome."""


def inference_view(tickets: DataFrame, key: str = "id") -> DataFrame:
    """What predictors may see: masked text, coarse place, creation time."""
    return tickets.select(
        F.col(key).alias("id"),
        masked(ticket_text(F.col("complaint_type"), F.col("descriptor"))).alias("text"),
        coarse("latitude").alias("coarse_latitude"),
        coarse("longitude").alias("coarse_longitude"),
        "created_date",
    )


def require_no_leakage(df: DataFrame, allowed=AS_OF_INPUT) -> DataFrame:
    """The same table, or ``LeakageError`` naming every column outside the contract."""
    bad = [c for c in df.columns if c not in allowed]
    if bad:
        raise LeakageError("columns not allowed in prediction inputs: " + ", ".join(sorted(bad)))
    return df


def leakage_audit(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Per column, how far its value alone determines the target (1 = fully)."""
    long = df.select(
        F.col(target).alias("_t"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
                    for c in columns
                ]
            )
        ).alias("x"),
    ).select("_t", "x.*")
    cells = long.groupBy("field", "value", "_t").agg(F.count("*").alias("n"))
    best = cells.groupBy("field", "value").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.groupBy("field").agg(
        F.count("*").alias("n_distinct"), (F.sum("best") / F.sum("n")).alias("determines")
    )


def jurisdictions(df: DataFrame, agencies: DataFrame, categories: str = "categories") -> DataFrame:
    """Each issue category of a ticket with the agency whose jurisdiction lists it.

    ``agencies``: ``code, name, category`` (one row per category).
    """
    return df.withColumn("category", F.explode(categories)).join(agencies, "category", "left")


def validate_drafts(drafts: DataFrame, decisions: DataFrame, bundles: DataFrame) -> DataFrame:
    """Hard checks per draft: required fields, owner as routed, precedent in the bundle.

    ``bundles``: ``ticket_id, precedent_id`` rows. Output adds ``errors`` and ``valid``.
    """
    routed = decisions.select("ticket_id", F.col("predicted_agency").alias("_routed"))
    known = bundles.select("ticket_id", F.col("precedent_id").alias("_cited")).distinct()
    known = known.withColumn("_known", F.lit(True))
    rows = (
        drafts.withColumn("_cited", F.col("draft.cited_precedent_id"))
        .join(routed, "ticket_id", "left")
        .join(known, ["ticket_id", "_cited"], "left")
    )

    def empty(field):
        return F.coalesce(F.col(f"draft.{field}"), F.lit("")) == ""

    checks = [
        F.when(empty("owner"), "owner missing"),
        F.when(empty("next_action"), "next_action missing"),
        F.when(
            ~empty("owner") & ~F.col("draft.owner").eqNullSafe(F.col("_routed")),
            "owner not routed agency",
        ),
        F.when(F.col("_cited").isNotNull() & F.col("_known").isNull(), "precedent not in bundle"),
    ]
    return (
        rows.withColumn("errors", F.array_compact(F.array(*checks)))
        .withColumn("valid", F.size("errors") == 0)
        .drop("_cited", "_routed", "_known")
    )


def to_submit(orders: DataFrame, submitted: DataFrame) -> DataFrame:
    """Approved drafts that were never submitted, each hash once."""
    approved = orders.filter(F.col("review_status") == "approved")
    open_ = approved.join(submitted.select("draft_hash"), "draft_hash", "left_anti")
    rest = [c for c in open_.columns if c != "draft_hash"]
    return open_.groupBy("draft_hash").agg(F.min_by(F.struct(*rest), "id").alias("_o")).select(
        "draft_hash", "_o.*"
    )


def quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``reasons``); replay is a union of corrected rows."""
    checked = malformed(raw)
    good = checked.filter(F.size("reasons") == 0).drop("reasons")
    return good, checked.filter(F.size("reasons") > 0)


def apply_field_policy(df: DataFrame, policy: dict[str, dict[str, str]], destination: str):
    """Only the columns a destination may have.

    ``policy[destination][column]`` is 'exact', 'masked' or 'coarse'.
    """
    forms = {
        "exact": F.col,
        "masked": lambda c: masked(F.col(c)).alias(c),
        "coarse": lambda c: coarse(c).alias(c),
    }
    rules = policy[destination]
    return df.select(*[forms[rules[c]](c) for c in df.columns if c in rules])


def expand_splits(proposals: DataFrame, cap: int = SPLIT_CAP) -> tuple[DataFrame, DataFrame]:
    """(children, rejected proposals). ``proposals``: ``ticket_id, agencies ARRAY<STRING>``.

    A proposal is valid with 2 to ``cap`` distinct known agencies.
    """
    agencies = F.col("agencies")
    known = F.forall(agencies, lambda a: is_agency(a))
    reason = (
        F.when(agencies.isNull() | (F.size(agencies) < 2), "too few")
        .when(F.size(agencies) > cap, "over cap")
        .when(~known, "unknown agency")
        .when(F.size(F.array_distinct(agencies)) < F.size(agencies), "repeated agency")
    )
    judged = proposals.withColumn("reason", reason)
    children = (
        judged.filter(F.col("reason").isNull())
        .select("ticket_id", F.posexplode("agencies").alias("pos", "agency"))
        .select(
            F.concat_ws("-", "ticket_id", (F.col("pos") + 1).cast("string")).alias("child_id"),
            "ticket_id",
            (F.col("pos") + 1).alias("part"),
            "agency",
        )
    )
    return children, judged.filter(F.col("reason").isNotNull())


def part_of(*keys: Column) -> Column:
    """A number of 32 bits that depends on the keys' text alone, the same in any engine."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def chosen(share: float, *keys: Column) -> Column:
    """Whether the keys are among a ``share`` of all, in steps of 2**-32."""
    return part_of(*keys) < F.lit(round(share * 2**32)).cast("bigint")


def retain(
    df: DataFrame, ts: str, key: str, now: Column, days: int = 30, fast_share: float = 0.1
) -> DataFrame:
    """Traces within ``days``: agent traces whole, fast ones by a share of tickets."""
    fresh = df.filter(F.col(ts) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return fresh.filter((F.col("path") == "agent") | chosen(fast_share, F.col(key)))


def due_dates(drafts: DataFrame, policy: DataFrame) -> DataFrame:
    """Due date by agency and complaint type; without a policy a person must set it.

    ``drafts``: ``owner, complaint_type, created_date``; ``policy``: ``owner,
    complaint_type, days``.
    """
    return drafts.join(policy, ["owner", "complaint_type"], "left").select(
        *[drafts[c] for c in drafts.columns],
        F.date_add(F.to_date("created_date"), F.col("days")).alias("due_date"),
        F.col("days").isNull().alias("human_input_required"),
    )
