"""Audit trail: append-only rows and a filtered, paged view, newest first."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = (
    "audit_id string, user string, role string, action string, resource_type string, resource_id string,"
    " details string"
)


def audit_rows(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Audit rows of a few actions; ``details`` is kept as JSON text."""
    rows = [
        (
            r.get("audit_id") or str(uuid.uuid4()), r.get("user", "unknown"), r.get("role", "OPERATOR"),
            r.get("action", "UNKNOWN_ACTION"), r.get("resource_type", "SYSTEM"), r.get("resource_id", "none"),
            json.dumps(r.get("details", {})),
        )
        for r in records
    ]
    return spark.createDataFrame(rows, AUDIT_SCHEMA).withColumn("timestamp", F.current_timestamp())


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def list_audits(
    audits: DataFrame, user: str | None = None, action: str | None = None, limit: int = 100, offset: int = 0
) -> DataFrame:
    if user:
        audits = audits.filter(F.col("user") == user)
    if action:
        audits = audits.filter(F.col("action") == action)
    return audits.orderBy(F.desc("timestamp"), "audit_id").offset(offset).limit(limit)
