"""Coverage of audited units: folds, skip causes, merges, subtractions, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scales import KIND_DOMAIN, UNIT_KINDS, lookup, sql_case
from ledgerloom.sources.views import steps, units, with_int, with_views


def audit_coverage(rows: DataFrame) -> DataFrame:
    """Units and audited units by run and domain; a unit is audited if any of its outcomes is."""
    unit = rows.groupBy("run", "domain", "unit_id").agg(F.bool_or(F.col("cause") == "audited").alias("audited"))
    return unit.groupBy("run", "domain").agg(F.count("*").alias("units_total"), F.count_if("audited").alias("units_audited"))


def outcomes(rows: DataFrame) -> DataFrame:
    """Unit rows as outcomes: one per unit and domain that looked at it."""
    own = rows.withColumn("domain", lookup(F.col("kind"), KIND_DOMAIN))
    api = rows.where("kind = 'route'").withColumn("domain", F.lit("api"))
    return own.unionByName(api)


def kind_coverage(rows: DataFrame) -> DataFrame:
    """Units and audited units of every kind, zero-filled."""
    kinds = rows.sparkSession.createDataFrame([(k,) for k in UNIT_KINDS], "kind string")
    unit = rows.groupBy("kind", "unit_id").agg(F.bool_or(F.col("cause") == "audited").alias("audited"))
    found = unit.groupBy("kind").agg(F.count("*").alias("units_total"), F.count_if("audited").alias("units_audited"))
    return kinds.join(found, "kind", "left").na.fill(0)


def skip_causes(rows: DataFrame) -> DataFrame:
    """Units by cause of every kind, zero-filled."""
    causes = ["audited", "no-verdict", "inconclusive", "budget", "failed", "cancelled"]
    return rows.groupBy("kind").agg(*[F.count_if(F.col("cause") == c).alias(c.replace("-", "_")) for c in causes])


def skip_reasons(rows: DataFrame) -> DataFrame:
    """Reasons with their number, most first, then by text."""
    from pyspark.sql import Window

    found = rows.where("cause <> 'audited'").groupBy("run", F.concat_ws("/", "cause", "segment").alias("reason")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("run").orderBy(F.desc("n"), "reason")
    return found.withColumn("place", F.row_number().over(order))


def reconciled(rows: DataFrame) -> DataFrame:
    """Whether audited and skipped units add up to the total in every run."""
    by = rows.groupBy("run").agg(F.count("*").alias("total"), F.count_if(F.col("cause") == "audited").alias("audited"), F.count_if(F.col("cause") != "audited").alias("skipped"))
    return by.agg(F.bool_and(F.col("audited") + F.col("skipped") == F.col("total")).alias("reconciled"), F.count("*").alias("runs"))


def step_rows(rows: DataFrame) -> DataFrame:
    each = rows.select("step", "status", "reason", F.explode(F.array("domain_a", "domain_b")).alias("domain"))
    return each.groupBy("domain").agg(
        F.count("*").alias("units_total"), F.count_if(F.col("status").isin("ok", "degraded")).alias("units_audited"),
        F.array_sort(F.collect_set(F.when(~F.col("status").isin("ok", "degraded"), F.col("reason")))).alias("skipped"),
    )


def audit_rows(rows: DataFrame) -> DataFrame:
    own = outcomes(rows)
    return own.groupBy("domain").agg(
        F.count("*").alias("units_total"), F.count_if(F.col("cause") == "audited").alias("units_audited"),
        F.array_sort(F.collect_set(F.when(F.col("cause") != "audited", F.col("segment")))).alias("skipped"),
    )


def merged_coverage(first: DataFrame, second: DataFrame) -> DataFrame:
    """Coverage of two phases: totals add, though both share a domain's row, and skips are a set."""
    both = first.unionByName(second)
    return both.groupBy("domain").agg(
        F.sum("units_total").alias("units_total"), F.sum("units_audited").alias("units_audited"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("skipped")))), ",").alias("skipped"),
    )


def subtracted_coverage(total: DataFrame, part: DataFrame) -> DataFrame:
    """Coverage without an earlier audit's part; nothing falls below zero."""
    p = part.select("domain", F.col("units_total").alias("t"), F.col("units_audited").alias("a"), F.col("skipped").alias("k"))
    rows = total.join(p, "domain", "left")
    less = lambda x, y: F.greatest(F.col(x) - F.coalesce(F.col(y), F.lit(0)), F.lit(0))
    gone = F.coalesce(F.col("k"), F.array().cast("array<string>"))
    return rows.select("domain", less("units_total", "t").alias("units_total"), less("units_audited", "a").alias("units_audited"), F.array_join(F.array_except("skipped", gone), ",").alias("skipped"))


def scan_wins(scan: DataFrame, audit: DataFrame, key: str) -> DataFrame:
    """Rows of both; where a key is in both, the scan's row stays."""
    return scan.unionByName(audit.join(scan.select(key), key, "left_anti"))


def already_audited(all_rows: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    return all_rows.select(key).distinct().join(skipped.select(key).distinct(), key, "left_anti")


def scope_counts(rows: DataFrame) -> DataFrame:
    """Units of each kind inside and outside the scope of paths src/1*."""
    inside = F.col("file").startswith("src/1")
    return rows.groupBy("kind").agg(F.count_if(inside).alias("in_scope"), F.count_if(~inside).alias("out_of_scope"))


def evidence_join(present: DataFrame, audited: DataFrame) -> DataFrame:
    """Counts of inventory and audit by kind: present is the larger, verdicted at most present."""
    rows = present.join(audited, "kind", "full_outer")
    most = F.greatest(F.coalesce("n_inventory", F.lit(0)), F.coalesce("n_audit", F.lit(0)))
    return rows.select("kind", most.alias("present"), F.least(most, F.coalesce("n_verdict", F.lit(0))).alias("verdicted"))


def retried(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Outcomes after a retry: a retried unit's fresh outcome replaces the earlier."""
    return previous.join(fresh.select("unit_id"), "unit_id", "left_anti").unionByName(fresh)


def _parts(s, d):
    u = units(s, d)
    scan = u.where("unit_id % 3 = 0").select("unit_id", "kind", F.lit("scan").alias("origin"))
    audit = u.where("unit_id % 2 = 0").select("unit_id", "kind", F.lit("audit").alias("origin"))
    return scan, audit


def _evidence(s, d):
    u = units(s, d)
    inv = u.where("unit_id % 5 <> 0 and kind <> 'sink'").groupBy("kind").agg(F.count("*").alias("n_inventory"))
    aud = u.where("kind <> 'cron'").groupBy("kind").agg(F.count("*").alias("n_audit"), F.count_if(F.col("cause") == "audited").alias("n_verdict"))
    return evidence_join(inv, aud)


def _retry(s, d):
    u = units(s, d)
    fresh = u.where("cause = 'inconclusive' and unit_id % 2 = 0").withColumn("cause", F.lit("audited"))
    return retried(u, fresh).groupBy("run", "cause").agg(F.count("*").alias("n"))


_OUT = f"""SELECT *, {sql_case("kind", KIND_DOMAIN)} AS domain FROM v_unit UNION ALL BY NAME SELECT *, 'api' AS domain FROM v_unit WHERE kind = 'route'"""
_GAVE = "status IN ('ok', 'degraded')"
_STEPS = f"""SELECT domain, count(*) AS units_total, count(*) FILTER ({_GAVE}) AS units_audited, list_sort(coalesce(list(DISTINCT reason) FILTER (NOT {_GAVE}), [])) AS skipped
 FROM (SELECT *, unnest([domain_a, domain_b]) AS domain FROM v_step) GROUP BY domain"""
_AUD = """SELECT domain, count(*) AS units_total, count(*) FILTER (cause = 'audited') AS units_audited, list_sort(coalesce(list(DISTINCT segment) FILTER (cause <> 'audited'), [])) AS skipped FROM outc GROUP BY domain"""
_J = "coalesce(list_aggregate({}, 'string_agg', ','), '')"

QUERIES = {
    "agg05_audit_coverage": lambda s, d: audit_coverage(outcomes(units(s, d))),
    "agg07_kind_coverage": lambda s, d: kind_coverage(outcomes(units(s, d))),
    "agg08_skip_causes": lambda s, d: skip_causes(units(s, d)),
    "agg09_skip_reasons": lambda s, d: skip_reasons(units(s, d)),
    "agg10_reconciliation": lambda s, d: reconciled(units(s, d)),
    "agg06_merged_coverage": lambda s, d: merged_coverage(step_rows(steps(s, d)), audit_rows(units(s, d))),
    "set04_subtract_coverage": lambda s, d: subtracted_coverage(audit_rows(units(s, d)), step_rows(steps(s, d))),
    "set03_scan_wins": lambda s, d: scan_wins(*_parts(s, d), "unit_id"),
    "set08_already_audited": lambda s, d: already_audited(units(s, d), units(s, d).where("cause <> 'audited'"), "unit_id"),
    "agg21_scope_counts": lambda s, d: scope_counts(units(s, d)),
    "join27_evidence_join": _evidence,
    "set07_retry_merge": _retry,
}
ORACLES = {
    "agg05_audit_coverage": with_views("SELECT run, domain, count(*) AS units_total, count(*) FILTER (a) AS units_audited FROM (SELECT run, domain, unit_id, bool_or(cause = 'audited') AS a FROM outc GROUP BY ALL) GROUP BY run, domain", "v_unit", outc=_OUT),
    "agg07_kind_coverage": with_views(
        "SELECT k.kind, coalesce(units_total, 0) AS units_total, coalesce(units_audited, 0) AS units_audited FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in UNIT_KINDS)
        + "]) AS kind) k LEFT JOIN (SELECT kind, count(DISTINCT unit_id) AS units_total, count(DISTINCT unit_id) FILTER (cause = 'audited') AS units_audited FROM v_unit GROUP BY kind) USING (kind)", "v_unit"),
    "agg08_skip_causes": with_views("SELECT kind, " + ", ".join(f"count(*) FILTER (cause = '{c}') AS {c.replace('-', '_')}" for c in ("audited", "no-verdict", "inconclusive", "budget", "failed", "cancelled")) + " FROM v_unit GROUP BY kind", "v_unit"),
    "agg09_skip_reasons": with_views("SELECT run, reason, n, row_number() OVER (PARTITION BY run ORDER BY n DESC, reason) AS place FROM (SELECT run, cause || '/' || segment AS reason, count(*) AS n FROM v_unit WHERE cause <> 'audited' GROUP BY ALL)", "v_unit"),
    "agg10_reconciliation": with_views("SELECT bool_and(a + k = t) AS reconciled, count(*) AS runs FROM (SELECT run, count(*) AS t, count(*) FILTER (cause = 'audited') AS a, count(*) FILTER (cause <> 'audited') AS k FROM v_unit GROUP BY run)", "v_unit"),
    "agg06_merged_coverage": with_views(f"SELECT domain, CAST(sum(units_total) AS BIGINT) AS units_total, CAST(sum(units_audited) AS BIGINT) AS units_audited, {_J.format('list_sort(list_distinct(flatten(list(skipped))))')} AS skipped FROM (SELECT * FROM st UNION ALL SELECT * FROM au) GROUP BY domain", "v_unit", "v_step", outc=_OUT, st=_STEPS, au=_AUD),
    "set04_subtract_coverage": with_views(f"SELECT domain, greatest(au.units_total - coalesce(st.units_total, 0), 0) AS units_total, greatest(au.units_audited - coalesce(st.units_audited, 0), 0) AS units_audited, {_J.format('list_filter(au.skipped, lambda x: NOT list_contains(coalesce(st.skipped, []), x))')} AS skipped FROM au LEFT JOIN st USING (domain)", "v_unit", "v_step", outc=_OUT, st=_STEPS, au=_AUD),
    "set03_scan_wins": with_views("SELECT unit_id, kind, 'scan' AS origin FROM v_unit WHERE unit_id % 3 = 0 UNION ALL SELECT unit_id, kind, 'audit' FROM v_unit WHERE unit_id % 2 = 0 AND unit_id % 3 <> 0", "v_unit"),
    "set08_already_audited": with_views("SELECT DISTINCT unit_id FROM v_unit WHERE unit_id NOT IN (SELECT unit_id FROM v_unit WHERE cause <> 'audited')", "v_unit"),
    "agg21_scope_counts": with_views("SELECT kind, count(*) FILTER (starts_with(file, 'src/1')) AS in_scope, count(*) FILTER (NOT starts_with(file, 'src/1')) AS out_of_scope FROM v_unit GROUP BY kind", "v_unit"),
    "join27_evidence_join": with_views(
        """SELECT kind, greatest(coalesce(i, 0), coalesce(a, 0)) AS present, least(greatest(coalesce(i, 0), coalesce(a, 0)), coalesce(v, 0)) AS verdicted FROM
 (SELECT kind, count(*) AS i FROM v_unit WHERE unit_id % 5 <> 0 AND kind <> 'sink' GROUP BY kind) FULL JOIN
 (SELECT kind, count(*) AS a, count(*) FILTER (cause = 'audited') AS v FROM v_unit WHERE kind <> 'cron' GROUP BY kind) USING (kind)""", "v_unit"),
    "set07_retry_merge": with_views("SELECT run, CASE WHEN cause = 'inconclusive' AND unit_id % 2 = 0 THEN 'audited' ELSE cause END AS cause, count(*) AS n FROM v_unit GROUP BY ALL", "v_unit"),
}
ORACLES["agg09_skip_reasons"] = with_int(ORACLES["agg09_skip_reasons"], "place")
