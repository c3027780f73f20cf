"""Agency codes, complaint types and issue categories as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# The closed agency set.
AGENCIES = ("DEP", "DOT", "DPR", "HPD", "DOB", "NYPD", "DSNY")

# Complaint type -> usual agency. The keys are also the backfill whitelist.
COMPLAINT_AGENCY = {
    "Water System": "DEP",
    "Sewer": "DEP",
    "Street Condition": "DOT",
    "Street Light Condition": "DOT",
    "Sidewalk Condition": "DOT",
    "Damaged Tree": "DPR",
    "Noise - Residential": "NYPD",
    "HEAT/HOT WATER": "HPD",
    "Plumbing": "HPD",
    "General Construction": "DOB",
}

# Issue category -> keyword prefixes.
ISSUE_KEYWORDS = {
    "water": ("leak", "water", "flood", "hydrant", "pipe"),
    "structural": ("crack", "buckl", "collaps", "structural", "ceiling", "wall"),
    "heat": ("heat", "hot water", "boiler", "radiator"),
    "sewer": ("sewage", "sewer", "drain", "backup", "back up"),
    "tree": ("tree", "branch", "limb", "root"),
    "noise": ("noise", "music", "loud", "party"),
    "street": ("pothole", "pavement", "sidewalk", "curb", "road"),
    "electrical": ("light", "wire", "electric", "spark", "outage"),
}

# Issue category -> owning agency.
ISSUE_OWNER = {
    "water": "DEP",
    "sewer": "DEP",
    "structural": "DOB",
    "heat": "HPD",
    "tree": "DPR",
    "noise": "NYPD",
    "street": "DOT",
    "electrical": "DOT",
}

# Phrases that join two issues in one sentence.
CONNECTORS = (" and ", "; ", " also ", " plus ", " as well as ", "&")


def lookup(table: dict[str, str], key: Column) -> Column:
    """Literal-map lookup; NULL when the key is absent."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal, key)


def clean_code(code: Column) -> Column:
    """Trimmed upper-case code; blank becomes NULL."""
    return F.nullif(F.upper(F.regexp_replace(code, r"(?U)^\s+|\s+$", "")), F.lit(""))


def is_agency(code: Column) -> Column:
    return F.coalesce(clean_code(code).isin(*AGENCIES), F.lit(False))


def usual_agency(complaint_type: Column) -> Column:
    return lookup(COMPLAINT_AGENCY, complaint_type)
