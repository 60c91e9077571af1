"""Ordered scales of the audit model, as lists and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the audit model, in their order.
DOMAINS = ("dependencies", "appsec", "data", "delivery", "serverless", "api", "reliability", "deadcode")
SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")
UNIT_KINDS = (
    "route", "data-access", "serverless-function", "queue-consumer", "cron", "webhook",
    "migration", "role-gate", "sink", "workflow-job", "container",
)
STATUSES = ("not-assessed", "partial", "scored")
SKIP_CAUSES = ("audited", "no-verdict", "inconclusive", "budget", "failed", "cancelled")
KIND_DOMAIN = {
    "route": "appsec", "data-access": "data", "serverless-function": "serverless", "queue-consumer": "serverless",
    "cron": "serverless", "webhook": "serverless", "migration": "data", "role-gate": "appsec", "sink": "appsec",
    "workflow-job": "delivery", "container": "delivery",
}
# Fixed values too: points of one finding and the most a severity can take, bands, gates, weights, caps and the bases of kinds.
SEVERITY_POINTS = {"critical": (25.0, 60.0), "high": (12.0, 40.0), "medium": (6.0, 25.0), "low": (2.0, 12.0), "info": (0.5, 5.0)}
LOW_CONFIDENCE_WEIGHT = 0.5
BANDS = (("A", 90), ("B", 75), ("C", 60), ("D", 40))
SCORED_COVERAGE, PARTIAL_COVERAGE = 0.9, 0.5
DOMAIN_WEIGHTS = {
    "appsec": 30.0, "data": 20.0, "dependencies": 15.0, "api": 12.0, "delivery": 8.0, "serverless": 8.0,
    "reliability": 5.0, "deadcode": 2.0,
}
# Penalties from which a run's confidence is low or medium.
LOW_PENALTY, MEDIUM_PENALTY = 4, 1
WORST_DOMAIN_HEADROOM = 15
UNEXAMINED_EVIDENCE_CAP = 74
KIND_BASE = {
    "route": 30, "webhook": 30, "cron": 30, "serverless-function": 26, "sink": 24, "queue-consumer": 20, "role-gate": 16,
    "data-access": 10, "migration": 6, "workflow-job": 4, "container": 4,
}


def rank_of(column: Column, scale: tuple[str, ...]) -> Column:
    """Place of a word in a scale, from 0; an unknown word is after all."""
    place = F.array_position(F.array(*map(F.lit, scale)), column)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(scale))).cast("int")


def label_of(rank: Column, scale: tuple[str, ...]) -> Column:
    """Word of a place in a scale; null on null and outside the scale."""
    return F.when(rank.isNotNull() & (rank >= 0) & (rank < len(scale)), F.get(F.array(*map(F.lit, scale)), rank.cast("int")))


def lookup(column: Column, table: dict) -> Column:
    found = F.lit(None)
    for key, value in table.items():
        found = F.when(column == key, F.lit(value)).otherwise(found)
    return found


def round_half_up(column: Column, places: int = 0) -> Column:
    """Half up on the binary value, as JavaScript rounds; SQL's round goes through decimal text."""
    factor = float(10**places)
    return F.floor(column * F.lit(factor) + F.lit(0.5)) / F.lit(factor)


def band_of(score: Column) -> Column:
    found = F.lit("F")
    for name, least in reversed(BANDS):
        found = F.when(score >= least, F.lit(name)).otherwise(found)
    return F.when(score.isNotNull(), found)


def text_hash(separator: str, *parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by a separator."""
    return F.substring(F.sha2(F.concat_ws(separator, *parts), 256), 1, 16)


def sql_case(column: str, table: dict, other: str = "NULL") -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {show(k)} THEN {show(v)}" for k, v in table.items()) + f" ELSE {other} END"
