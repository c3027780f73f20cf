"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _D, _T = StringType(), DoubleType(), TimestampType()

RAW_REQUEST = _struct(
    unique_key=_S,
    created_date=_S,
    closed_date=_S,
    complaint_type=_S,
    descriptor=_S,
    agency=_S,
    borough=_S,
    latitude=_S,
    longitude=_S,
    status=_S,
)
# As landed: a line that cannot be parsed keeps its text in the last column.
BROKEN = "_corrupt_record"
LANDED_REQUEST = StructType([*RAW_REQUEST.fields, StructField(BROKEN, _S)])
RAW_RECORD = _struct(unique_key=_S, payload=_S, ingested_at=_T)
TICKET = _struct(
    id=_S,
    unique_key=_S,
    complaint_type=_S,
    descriptor=_S,
    borough=_S,
    latitude=_D,
    longitude=_D,
    created_date=_T,
    closed_date=_T,
    report_count=IntegerType(),
    duplicate_of=_S,
    status=_S,
)
TICKET_VECTOR = _struct(ticket_id=_S, vector=ArrayType(FloatType()), model=_S, created_at=_T)
LABELLED_PAIR = _struct(
    text_a=_S, text_b=_S, label=BooleanType(), ann1=BooleanType(), ann2=BooleanType()
)
MODEL_ANSWER = _struct(agency=_S, confidence=_S)

# Lifecycle states and the allowed steps between them.
TRANSITIONS = (
    ("INGESTED", "DUPLICATE"),
    ("INGESTED", "CLASSIFIED"),
    ("CLASSIFIED", "ROUTED"),
    ("CLASSIFIED", "IN_TRIAGE"),
    ("IN_TRIAGE", "ROUTED"),
    ("IN_TRIAGE", "ESCALATED"),
    ("ESCALATED", "ROUTED"),
    ("ROUTED", "DRAFTED"),
    ("DRAFTED", "APPROVED"),
    ("DRAFTED", "REJECTED"),
    ("APPROVED", "SUBMITTED"),
)
