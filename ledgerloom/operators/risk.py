"""Risk of audited units: a base by kind, points of signals in their attributes, recency of migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scales import KIND_BASE, UNIT_KINDS, lookup, rank_of, round_half_up, sql_case
from ledgerloom.sources.views import units, with_int, with_views

# By kind the signals, each with its reason code, points and tests of attributes. A test names
# an attribute, how it is read, and values: one of them; not one of them though told; told at all; not yes.
READS, BROAD_WRITES = ("select", "read", "find", "aggregate", "count"), ("update", "delete", "upsert", "write")
SIGNALS = {
    "route": (
        ("auth.absent", 24, (("authenticated", "is", ("no",)),)), ("write.any", 12, (("mutates", "is", ("true",)),)), ("auth.unchecked", 10, (("authCheck", "is", ("none",)),)),
        ("input.object-id", 10, (("idParams", "told", ()),)), ("input.unvalidated", 8, (("validation", "is", ("none",)),)), ("write.delete", 6, (("method", "is", ("delete",)),)),
        ("input.body", 4, (("readsBody", "is", ("true",)),)), ("write.replace", 3, (("method", "is", ("put", "patch")),)), ("read.unpaged", 2, (("pagination", "is", ("none",)), ("mutates", "is", ("false",)))),
    ),
    "webhook": (("signature.unproven", 28, (("signatureVerified", "not-yes", ()),)), ("replay.unproven", 10, (("replayProtection", "not-yes", ()),)), ("signature.parsed-body", 6, (("usesRawBody", "is", ("no",)),))),
    "cron": (("auth.open-schedule", 28, (("authenticated", "is", ("no",)), ("authCheck", "or-is", ("none",)))), ("target.known", 4, (("targetUnitId", "told", ()),))),
    "serverless-function": (("auth.open-function", 22, (("authenticated", "is", ("no",)),)), ("trigger.http", 6, (("trigger", "is", ("http",)),))),
    "queue-consumer": (
        ("retry.not-idempotent", 14, (("idempotencyKey", "is", ("none",)),)), ("retry.no-dead-letter", 10, (("dlq", "is", ("none",)),)), ("retry.unlimited", 5, (("attempts", "is", ("unset",)),)),
        ("retry.no-backoff", 5, (("backoff", "is", ("unset",)),)), ("retry.no-timeout", 3, (("timeout", "is", ("unset",)),)),
    ),
    "role-gate": (("target.known", 8, (("targetUnitId", "told", ()),)),),
    "sink": (
        ("sink.executes", 20, (("sinkType", "is", ("sql", "nosql", "command", "eval")),)), ("sink.renders", 16, (("sinkType", "is", ("xss", "html", "template")),)),
        ("sink.runtime-argument", 10, (("dynamic", "is", ("yes",)),)),
    ),
    "data-access": (
        ("scope.absent", 20, (("filtersByPrincipal", "is", ("no", "false")),)), ("rows.delete", 10, (("operation", "is", ("delete",)),)),
        ("rows.all", 10, (("hasWhere", "is", ("false",)), ("operation", "is", BROAD_WRITES))), ("rows.write", 8, (("operation", "is", ("update", "upsert")),)),
        ("rows.per-loop", 8, (("insideLoop", "told", ()), ("insideLoop", "is-not", ("false",)))), ("rows.raw-sql", 6, (("operation", "is", ("raw",)),)), ("rows.insert", 4, (("operation", "is", ("insert",)),)),
        ("rows.unlimited", 4, (("hasLimit", "is", ("false",)), ("operation", "is", READS))), ("rows.locked", 3, (("insideTransaction", "is", ("true",)),)),
    ),
    "migration": (
        ("schema.destructive", 16, (("destructive", "is", ("true",)),)), ("schema.locks", 12, (("lockRisk", "told", ()), ("lockRisk", "is-not", ("none",)))),
        ("schema.no-way-back", 8, (("hasDownMigration", "is", ("false",)),)), ("schema.mixed", 6, (("mixesDataAndSchema", "is", ("true",)),)),
    ),
}
UNTOLD = ("", "unknown", "unresolved", "n/a")
RECENT, RECENT_POINTS = "schema.recent", 6
# What a kind stands for, as the first reason of each unit.
KIND_REASON = dict.fromkeys(("route", "webhook", "cron", "serverless-function"), "kind.entry-point") | {
    "queue-consumer": "kind.background", "sink": "kind.sink", "role-gate": "kind.client-gate", "data-access": "kind.database", "migration": "kind.applied",
    "workflow-job": "kind.delivery", "container": "kind.delivery",
}


def _test(attributes: Column, name: str, how: str, values: tuple) -> Column:
    value = F.lower(F.trim(attributes[name]))
    if how == "not-yes":
        return F.coalesce(value != "yes", F.lit(True))
    if how == "told":
        return F.coalesce(~value.isin(*UNTOLD), F.lit(False))
    if how == "is-not":
        return F.coalesce(~value.isin(*values), F.lit(True))
    return F.coalesce(value.isin(*values), F.lit(False))


def _fires(attributes: Column, tests: tuple) -> Column:
    found = F.lit(True)
    for name, how, values in tests:
        holds = _test(attributes, name, how.removeprefix("or-"), values)
        found = (found | holds) if how.startswith("or-") else (found & holds)
    return found


def migration_ordinal(attributes: Column) -> Column:
    """The first 15 digits of the ordinal, or else of the version; 0 without any."""
    digits = lambda name: F.nullif(F.substring(F.regexp_replace(attributes[name], "[^0-9]", ""), 1, 15), F.lit("")).cast("long")
    above = lambda c: F.when(c > 0, c)
    return F.coalesce(above(digits("ordinal")), above(digits("version")), F.lit(0).cast("long"))


def risk_scores(rows: DataFrame) -> DataFrame:
    """Risk of every unit from 0 to 100 with its reasons: that of its kind, then signals by points and code.

    rows has unit_id, run, kind, file, line and attributes, a map of texts. A migration gets up to six
    points by its ordinal against the newest of its run, which is found by one aggregate.
    """
    newest = rows.where("kind = 'migration'").groupBy("run").agg(F.max(migration_ordinal(F.col("attributes"))).alias("newest"))
    rows = rows.join(newest, "run", "left").withColumn("newest", F.coalesce("newest", F.lit(0).cast("long")))
    share = F.least(F.lit(1.0), migration_ordinal(F.col("attributes")) / F.col("newest"))
    recent = F.when((F.col("kind") == "migration") & (F.col("newest") > 0), round_half_up(share * RECENT_POINTS).cast("int"))
    fired = [
        F.when((F.col("kind") == kind) & _fires(F.col("attributes"), tests), F.struct(F.lit(-points).alias("p"), F.lit(code).alias("code")))
        for kind, signals in SIGNALS.items() for code, points, tests in signals
    ]
    fired.append(F.when(recent > 0, F.struct((-recent).alias("p"), F.lit(RECENT).alias("code"))))
    rows = rows.withColumn("__fired", F.array_sort(F.array_compact(F.array(*fired))))
    raw = lookup(F.col("kind"), KIND_BASE) - F.aggregate("__fired", F.lit(0), lambda acc, x: acc + x["p"])
    reasons = F.concat(F.array(lookup(F.col("kind"), KIND_REASON)), F.transform("__fired", lambda x: x["code"]))
    return rows.select("unit_id", "run", "kind", "file", "line", F.least(F.lit(100), F.greatest(F.lit(0), raw)).cast("int").alias("risk"), F.array_join(reasons, "; ").alias("reasons"))


def risk_order(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("run").orderBy(F.desc("risk"), rank_of(F.col("kind"), UNIT_KINDS), "file", "line", "unit_id")
    return rows.withColumn("place", F.row_number().over(order))


def top_reasons(rows: DataFrame, limit: int = 3) -> DataFrame:
    """The reasons of most units, then of best place, then by text."""
    each = rows.where("reasons <> ''").select("kind", F.posexplode(F.split("reasons", "; ")).alias("pos", "why"))
    found = each.groupBy("kind", "why").agg(F.count("*").alias("n"), F.min("pos").alias("best"))
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "best", "why")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def mean_risk(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(round_half_up(F.avg("risk"), 2).alias("mean_risk"))


# What the test units say of themselves: values by the unit's number over a divisor.
_SAID = {
    "authenticated": (1, ("no", "yes", "Unknown")), "authCheck": (2, ("none", "role", "owner", None)), "mutates": (3, ("true", "false")), "method": (1, ("GET", "DELETE", "put", "PATCH", "post")),
    "idParams": (4, ("id", "", "customerId,id", "unresolved")), "validation": (5, ("none", "schema")), "readsBody": (6, ("true", "false")), "pagination": (2, ("none", "cursor")),
    "signatureVerified": (2, ("yes", "no", None)), "replayProtection": (3, (" YES ", "unknown")), "usesRawBody": (1, ("no", "yes")), "targetUnitId": (5, ("u1", "n/a", None)), "trigger": (2, ("http", "queue")),
    "idempotencyKey": (1, ("none", "jobId")), "dlq": (2, ("none", "dead")), "attempts": (3, ("unset", "5")), "backoff": (4, ("unset", "exponential")), "timeout": (5, ("unset", "30")),
    "sinkType": (1, ("sql", "html", "redirect", "eval", "template")), "dynamic": (3, ("yes", "no")), "filtersByPrincipal": (2, ("no", "scoped", "yes", "false")),
    "operation": (1, ("select", "delete", "update", "raw", "insert", "upsert", "count")), "hasWhere": (3, ("false", "true")), "insideLoop": (2, ("for", "false", "unknown")), "hasLimit": (4, ("false", "true")),
    "insideTransaction": (1, ("true", "false")), "destructive": (2, ("true", "false")), "lockRisk": (1, ("none", "type-rewrite", "")), "hasDownMigration": (3, ("false", "true")), "mixesDataAndSchema": (4, ("true", "false")),
}


def described_units(spark, sf_dir: str) -> DataFrame:
    said = []
    for name, (divisor, values) in _SAID.items():
        place = (F.floor(F.col("unit_id") / divisor) % len(values)).cast("int")
        said += [F.lit(name), F.element_at(F.array(*map(F.lit, values)), place + 1)]
    version = F.concat(F.lit("v"), F.date_format("at", "yyyyMMdd"), F.lit("-"), F.col("line"))
    ordinal = F.when(F.col("unit_id") % 3 == 0, F.lit("none")).otherwise(F.lit(None).cast("string"))
    return units(spark, sf_dir).withColumn("attributes", F.create_map(*said, F.lit("ordinal"), ordinal, F.lit("version"), version))


def _sql_test(name: str, how: str, values: tuple) -> str:
    value = f"lower(trim(a_{name}))"
    listed = "(" + ", ".join(f"'{v}'" for v in values) + ")"
    if how == "not-yes":
        return f"coalesce({value} <> 'yes', true)"
    if how == "told":
        return f"coalesce({value} NOT IN ('', 'unknown', 'unresolved', 'n/a'), false)"
    return f"coalesce({value} NOT IN {listed}, true)" if how == "is-not" else f"coalesce({value} IN {listed}, false)"


def _sql_signal(kind: str, code: str, points: int, tests: tuple) -> str:
    glue = " OR " if any(t[1].startswith("or-") for t in tests) else " AND "
    holds = glue.join(_sql_test(n, how.removeprefix("or-"), v) for n, how, v in tests)
    return f"CASE WHEN kind = '{kind}' AND ({holds}) THEN {{'p': {-points}, 'code': '{code}'}} END"


_SAID_SQL = ", ".join("[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][(unit_id // {divisor}) % {len(values)} + 1] AS a_{name}" for name, (divisor, values) in _SAID.items())
_RISK = f"""SELECT unit_id, run, kind, file, line, CAST(least(100, greatest(0, {sql_case("kind", KIND_BASE)} - coalesce(list_sum(list_transform(fired, lambda x: x.p)), 0))) AS INTEGER) AS risk,
 array_to_string(list_concat([{sql_case("kind", KIND_REASON)}], list_transform(fired, lambda x: x.code)), '; ') AS reasons FROM
 (SELECT *, list_sort(list_filter([{", ".join(_sql_signal(k, c, p, t) for k, signals in SIGNALS.items() for c, p, t in signals)},
  CASE WHEN kind = 'migration' AND newest > 0 AND floor(6 * least(1.0, ordinal::DOUBLE / newest) + 0.5) > 0 THEN {{'p': -CAST(floor(6 * least(1.0, ordinal::DOUBLE / newest) + 0.5) AS INTEGER), 'code': '{RECENT}'}} END], lambda x: x IS NOT NULL)) AS fired FROM
 (SELECT *, coalesce(max(ordinal) FILTER (kind = 'migration') OVER (PARTITION BY run), 0) AS newest FROM
 (SELECT *, {_SAID_SQL}, CAST(strftime("at", '%Y%m%d') || line AS BIGINT) AS ordinal FROM v_unit)))"""
_KR = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(UNIT_KINDS)) + " END"
QUERIES = {
    "prj21_risk_scores": lambda s, d: risk_scores(described_units(s, d)),
    "srt04_risk_order": lambda s, d: risk_order(risk_scores(described_units(s, d))).select("run", "unit_id", "risk", "place"),
    "agg35_top_reasons": lambda s, d: top_reasons(risk_scores(described_units(s, d))),
    "agg34_mean_risk": lambda s, d: mean_risk(risk_scores(described_units(s, d))),
}
ORACLES = {
    "prj21_risk_scores": with_views("SELECT * FROM risk", "v_unit", risk=_RISK),
    "srt04_risk_order": with_int(with_views(f"SELECT run, unit_id, risk, row_number() OVER (PARTITION BY run ORDER BY risk DESC, {_KR}, file, line, unit_id) AS place FROM risk", "v_unit", risk=_RISK), "place"),
    "agg35_top_reasons": with_int(with_views("SELECT kind, why, n, CAST(best AS INTEGER) AS best, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, best, why) AS place FROM (SELECT kind, r[pos] AS why, count(*) AS n, min(pos) - 1 AS best FROM (SELECT kind, r, unnest(range(1, len(r) + 1)) AS pos FROM (SELECT kind, string_split(reasons, '; ') AS r FROM risk WHERE reasons <> '')) GROUP BY ALL)) WHERE place <= 3", "v_unit", risk=_RISK), "place"),
    "agg34_mean_risk": with_views("SELECT kind, floor(avg(risk) * 100 + 0.5) / 100 AS mean_risk FROM risk GROUP BY kind", "v_unit", risk=_RISK),
}
