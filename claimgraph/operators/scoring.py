"""Confidence and routing of proposed ops, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each signal weighs, how much support saturates, and the thresholds of a route.
WEIGHTS = {"extraction": 0.35, "support": 0.25, "resolution": 0.25, "validation": 0.15}
FULL_SUPPORT = 3.0
APPROVE_AT, REJECT_BELOW, BUSY_DEGREE = 0.92, 0.30, 50


def score(extraction: Column, support: Column, resolution: Column, valid: Column) -> Column:
    shared = F.least(support / F.lit(FULL_SUPPORT), F.lit(1.0))
    total = WEIGHTS["extraction"] * extraction + WEIGHTS["support"] * shared + WEIGHTS["resolution"] * resolution
    return F.round(total + WEIGHTS["validation"] * F.when(valid, 1.0).otherwise(0.0), 4)


def route(
    kind: Column, confidence: Column, new_type: Column, semantic: Column, degree: Column | None = None,
    approve_at: float = APPROVE_AT, reject_below: float = REJECT_BELOW, busy: int = BUSY_DEGREE,
) -> Column:
    """``approve``, ``review`` or ``reject``; the order of the rules matters."""
    out = F.when(new_type | semantic, "review").when(kind == "split_node", "review")
    if degree is not None:
        out = out.when((kind == "merge_into") & (degree >= busy), "review")
    return out.when(confidence >= approve_at, "approve").when(confidence < reject_below, "reject").otherwise("review")


def status_of(route_: Column) -> Column:
    return F.when(route_ == "approve", "approved").when(route_ == "reject", "rejected").otherwise("pending")
