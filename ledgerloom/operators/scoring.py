"""Deductions, ceilings, bands, domain and overall scores, run confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scales import (
    DOMAIN_WEIGHTS,
    DOMAINS,
    LOW_CONFIDENCE_WEIGHT,
    LOW_PENALTY,
    MEDIUM_PENALTY,
    PARTIAL_COVERAGE,
    SCORED_COVERAGE,
    SEVERITIES,
    SEVERITY_POINTS,
    STATUSES,
    UNEXAMINED_EVIDENCE_CAP,
    WORST_DOMAIN_HEADROOM,
    band_of,
    label_of,
    lookup,
    rank_of,
    round_half_up,
)
from ledgerloom.sources.views import batches, checks, findings, runs, steps, units, with_views


def severity_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Findings by severity, zero-filled, one row per key."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def deductions(rows: DataFrame, *keys: str) -> DataFrame:
    """Points that each severity takes off: low confidence weighs half, every severity has a cap."""
    found = rows.groupBy(*keys, "severity").agg(
        F.count("*").alias("count"), F.count_if(F.col("confidence") == "low").alias("discounted")
    )
    weighted = F.col("count") - F.col("discounted") * F.lit(1 - LOW_CONFIDENCE_WEIGHT)
    per = lookup(F.col("severity"), {s: p for s, (p, _) in SEVERITY_POINTS.items()})
    cap = lookup(F.col("severity"), {s: c for s, (_, c) in SEVERITY_POINTS.items()})
    found = found.withColumns({"per_finding": per, "cap": cap}).withColumn("raw", round_half_up(weighted * F.col("per_finding"), 2))
    found = found.withColumn("applied", round_half_up(F.least("raw", "cap"), 2))
    return found.withColumn("capped", F.col("applied") < F.col("raw"))


def base_scores(rows: DataFrame, *keys: str) -> DataFrame:
    return _scored(rows, *keys).select(*keys, "findings", "deduction", "base_score")


def _ceilings():
    """(name, cap, condition) of every domain ceiling; findings of low confidence never trigger one."""
    fires = F.col("confidence") != "low"
    return (
        ("appsec.committed-secret", 50, fires & (F.col("rule") == "appsec.hardcoded-secret") & (F.col("sev") <= 1)),
        ("dependencies.unpatched-critical-cve", 60, fires & (F.col("rule") == "dependencies.vulnerable-package") & (F.col("sev") == 0)),
        ("data.destructive-migration", 70, fires & (F.col("rule") == "data.destructive-migration") & (F.col("sev") <= 2)),
    )


def ceiling_caps(rows: DataFrame, *keys: str) -> DataFrame:
    """Findings that trigger each domain ceiling."""
    id_ = F.lit(None).cast("string")
    cap = F.lit(None).cast("int")
    for name, most, when in _ceilings():
        id_, cap = F.when(when, F.lit(name)).otherwise(id_), F.when(when, F.lit(most)).otherwise(cap)
    return (
        rows.select(*keys, id_.alias("ceiling"), cap.alias("cap"), "id")
        .where("ceiling is not null")
        .groupBy(*keys, "ceiling", "cap")
        .agg(F.count("*").alias("triggers"), F.min("id").alias("first_trigger"))
    )


def _scored(rows: DataFrame, *keys: str) -> DataFrame:
    """Findings, deduction, base score, triggers and cap of every key in one aggregation, so one shuffle."""
    counts = [F.count("*").alias("findings")]
    for i, s in enumerate(SEVERITIES):
        counts += [F.count_if(F.col("sev") == i).alias(f"n_{s}"), F.count_if((F.col("sev") == i) & (F.col("confidence") == "low")).alias(f"l_{s}")]
    counts += [F.count_if(when).alias(f"t_{most}") for _, most, when in _ceilings()]
    got = rows.groupBy(*keys).agg(*counts)
    total = F.lit(0.0)
    for s, (per, cap) in SEVERITY_POINTS.items():
        weighted = F.col(f"n_{s}") - F.col(f"l_{s}") * F.lit(1 - LOW_CONFIDENCE_WEIGHT)
        total = total + round_half_up(F.least(round_half_up(weighted * per, 2), F.lit(cap)), 2)
    taken = round_half_up(F.least(F.lit(100.0), total), 2)
    cap = F.lit(None).cast("int")
    for _, most, _ in reversed(_ceilings()):  # the lowest cap that has triggers
        cap = F.when(F.col(f"t_{most}") > 0, F.lit(most)).otherwise(cap)
    triggers = sum((F.col(f"t_{most}") for _, most, _ in _ceilings()), F.lit(0))
    return got.select(
        *keys, "findings", taken.alias("deduction"), round_half_up(F.greatest(F.lit(0.0), 100 - taken)).cast("int").alias("base_score"),
        triggers.cast("long").alias("triggers"), cap.alias("cap"),
    )


def check_coverage(rows: DataFrame) -> DataFrame:
    """Planned checks and those that ran, by run and domain."""
    return rows.groupBy("run", "domain").agg(F.count("*").alias("units_total"), F.count_if("ran").alias("units_audited"))


def _share(part, whole):
    """part of whole, at most 1, four places."""
    return round_half_up(F.least(F.lit(1.0), part / whole), 4)


def gate(total, ran, present, verdicted, found):
    """(status rank, check ratio, evidence ratio, assessed ratio) from what was planned, enumerated and found.

    The stricter of two opinions holds. Checks: none planned or under half run, not assessed; under
    nine tenths, partial. Units: none enumerated, no opinion; under half examined, partial with
    findings and not assessed without. What a number speaks for is the lesser of the two ratios.
    """
    applies = present > 0
    checked = F.when(total > 0, _share(ran, total)).otherwise(F.lit(0.0))
    examined = F.when(applies, _share(verdicted, present)).otherwise(F.lit(1.0))
    by_checks = F.when((total == 0) | (checked < PARTIAL_COVERAGE), 0).when(checked < SCORED_COVERAGE, 1).otherwise(2)
    by_units = F.when(~applies | (examined >= SCORED_COVERAGE), 2).when((examined >= PARTIAL_COVERAGE) | (found > 0), 1).otherwise(0)
    return F.least(by_checks, by_units), checked, examined, F.least(checked, examined)


def domain_scores(rows: DataFrame, coverage: DataFrame, examined: DataFrame, all_runs: DataFrame) -> DataFrame:
    """All eight domains of every run: base score, ceilings, gate, band and effective weight.

    rows are findings; coverage has run, domain, units_total and units_audited (checks and those that
    ran); examined has run, domain, present and verdicted (units). A domain that isn't assessed keeps
    its findings and triggers, but has no score, base score or band and weighs nothing. Where under
    half of a domain's units were examined the score is capped, after the ceilings of its findings.
    """
    every = all_runs.select("run", F.explode(F.array(*map(F.lit, DOMAINS))).alias("domain"))
    keys = ["run", "domain"]
    got = every.join(_scored(rows, *keys), keys, "left").join(coverage, keys, "left").join(examined, keys, "left")
    got = got.na.fill(0, ["findings", "triggers", "units_total", "units_audited", "present", "verdicted"])
    got = got.na.fill(0.0, ["deduction"]).na.fill(100, ["base_score"])
    rank, checked, seen, ratio = gate(*map(F.col, ("units_total", "units_audited", "present", "verdicted", "findings")))
    got = got.withColumns({"rank": rank, "check_ratio": checked, "evidence_ratio": seen, "ratio": ratio})
    capped = F.least("base_score", F.coalesce("cap", F.lit(100)))
    limited = F.when(F.col("evidence_ratio") < PARTIAL_COVERAGE, F.least(capped, F.lit(UNEXAMINED_EVIDENCE_CAP))).otherwise(capped)
    assessed = F.col("rank") > 0
    score = F.when(assessed, limited)
    weight = F.when(assessed, round_half_up(lookup(F.col("domain"), DOMAIN_WEIGHTS) * F.col("ratio"), 2)).otherwise(F.lit(0.0))
    return got.select(
        "run", "domain", "findings", "deduction", F.when(assessed, F.col("base_score")).alias("base_score"), "triggers", "check_ratio", "evidence_ratio", "ratio",
        score.alias("score"), band_of(score).alias("band"), label_of(F.col("rank"), STATUSES).alias("status"), weight.alias("effective_weight"),
    )


def overall_scores(scores: DataFrame) -> DataFrame:
    """Weighted mean of a run's scored domains, clamped to 15 above the weakest (ties: first domain).

    Domains without a score don't count; a run without any has no number and isn't assessed.
    """
    scored = F.col("score").isNotNull()
    weight = F.round(F.col("effective_weight") * 100).cast("long")
    got = scores.withColumn("dom", rank_of(F.col("domain"), DOMAINS)).groupBy("run").agg(
        F.sum(F.when(scored, F.col("score") * weight)).alias("sw"),
        F.sum(F.when(scored, weight)).alias("w"),
        F.sum("score").alias("plain"),
        F.min(F.when(scored, F.struct("score", "dom"))).alias("worst"),
        F.count("score").alias("scored"),
        F.count("*").alias("domains"),
        F.bool_or(F.col("status") == "partial").alias("partial"),
    )
    # Tenths of the mean, half up, by whole numbers: no order of addition can flip a tie.
    tenths = F.when(F.col("w") > 0, F.expr("(20 * sw + w) div (2 * w)")).when(F.col("scored") > 0, F.expr("(20 * plain + scored) div (2 * scored)"))
    limit = F.when(F.col("scored") > 0, F.least(F.lit(100), F.col("worst.score") + WORST_DOMAIN_HEADROOM))
    worst = F.when(F.col("scored") > 0, label_of(F.col("worst.dom"), DOMAINS))
    got = got.select("run", "domains", "scored", "partial", (tenths / 10).alias("weighted_mean"), limit.alias("limit_"), worst.alias("worst_domain"))
    score = F.when(F.col("scored") > 0, round_half_up(F.least(F.col("weighted_mean"), F.col("limit_").cast("double"))).cast("int"))
    status = F.when(F.col("scored") == 0, "not-assessed").when(F.col("partial") | (F.col("scored") < F.col("domains")), "partial").otherwise("scored")
    return got.select(
        "run", (F.col("domains") - F.col("scored")).alias("unscored"), "weighted_mean", "limit_", "worst_domain",
        (F.col("weighted_mean") > F.col("limit_")).alias("clamped"), score.alias("score"), band_of(score).alias("band"), status.alias("status"),
    )


def evidence(rows: DataFrame) -> DataFrame:
    """Units present and with a verdict by run and domain, from unit rows with kind and cause."""
    from ledgerloom.functions.scales import KIND_DOMAIN

    return rows.groupBy("run", lookup(F.col("kind"), KIND_DOMAIN).alias("domain")).agg(
        F.count("*").alias("present"), F.count_if(F.col("cause") == "audited").alias("verdicted")
    )


def confidence_signals(basis: DataFrame) -> DataFrame:
    """One row for each signal that costs a run confidence: run, place, signal and penalty.

    basis has a run's counters: units_total, units_audited, batches_total, batches_partial,
    batches_failed, relocated, dropped, degraded, findings, low_confidence, and the flags quota,
    aborted and synthetic. Without units all count as audited.
    """
    c = F.col
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    ratio = F.when(c("units_total") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), c("units_audited") / c("units_total")))
    penalties = {
        "units.partially-audited": F.when(ratio >= 0.98, 0).when(ratio >= 0.9, 1).when(ratio >= 0.75, 2).otherwise(3),
        "batches.partial": F.when(c("batches_partial") == 0, 0).when(share(c("batches_partial"), c("batches_total")) > 0.25, 2).otherwise(1),
        "batches.failed": F.when(c("batches_failed") > 0, 2).otherwise(0),
        "citations.relocated": F.when(c("relocated") > 0, 1).otherwise(0),
        "citations.dropped": F.when(share(c("dropped"), c("findings") + c("dropped")) > 0.05, 1).otherwise(0),
        "analyzers.degraded": F.least(F.lit(2), c("degraded")),
        "findings.low-confidence": F.when(share(c("low_confidence"), c("findings")) > 0.25, 1).otherwise(0),
        "run.quota-exhausted": F.when(c("quota"), 2).otherwise(0),
        "run.aborted": F.when(c("aborted"), 3).otherwise(0),
        "runtime.synthetic": F.when(c("synthetic"), LOW_PENALTY).otherwise(0),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("signal"), p.cast("int").alias("penalty")) for i, (k, p) in enumerate(penalties.items())])
    return basis.select("run", F.inline(rows)).where("penalty > 0")


def run_confidence(basis: DataFrame) -> DataFrame:
    """Penalty, level and signals of every run of the basis."""
    signals = confidence_signals(basis).groupBy("run").agg(F.sum("penalty").cast("int").alias("penalty"), F.array_sort(F.collect_list(F.struct("place", "signal"))).alias("s"))
    got = basis.select("run").join(signals, "run", "left").na.fill(0, ["penalty"])
    level = F.when(F.col("penalty") >= LOW_PENALTY, "low").when(F.col("penalty") >= MEDIUM_PENALTY, "medium").otherwise("high")
    return got.select("run", "penalty", level.alias("level"), F.coalesce(F.array_join(F.transform("s", lambda x: x["signal"]), ","), F.lit("")).alias("signals"))


def confidence_basis(all_runs: DataFrame, rows: DataFrame, batch_rows: DataFrame, found: DataFrame, step_rows: DataFrame) -> DataFrame:
    """Counters of every run from its units, batches, findings and scan checks; what a run lacks counts as nothing.

    batch_rows has run, status, stopped (the reason a batch stopped, or null), relocated, dropped and
    synthetic; step_rows has run and ran.
    """
    u = rows.groupBy("run").agg(F.count("*").alias("units_total"), F.count_if(F.col("cause") == "audited").alias("units_audited"))
    b = batch_rows.groupBy("run").agg(
        F.count("*").alias("batches_total"), F.count_if(F.col("status") == "partial").alias("batches_partial"), F.count_if(F.col("status") == "failed").alias("batches_failed"),
        F.sum("relocated").alias("relocated"), F.sum("dropped").alias("dropped"), F.bool_or(F.coalesce(F.col("stopped") == "quota", F.lit(False))).alias("quota"),
        F.bool_or(F.coalesce(F.col("stopped") == "cancelled", F.lit(False))).alias("aborted"), F.bool_or("synthetic").alias("synthetic"),
    )
    f = found.groupBy("run").agg(F.count("*").alias("findings"), F.count_if(F.col("confidence") == "low").alias("low_confidence"))
    t = step_rows.groupBy("run").agg(F.count_if(~F.col("ran")).alias("degraded"))
    got = all_runs
    for part in (u, b, f, t):
        got = got.join(part, "run", "left")
    return got.na.fill(0).na.fill(False)


def _batch_rows(s, d) -> DataFrame:
    b = batches(s, d)
    stopped = F.when((F.col("status") == "failed") & (F.col("duration") > 450), "cancelled").when((F.col("status") == "partial") & (F.col("duration") > 300), "quota")
    return b.select("run", "status", stopped.alias("stopped"), (F.col("units") % 11 == 0).cast("int").alias("relocated"), F.when(F.col("duration") < 3, 1).otherwise(0).alias("dropped"), F.lit(False).alias("synthetic"))


def _basis(s, d) -> DataFrame:
    return confidence_basis(runs(s, d), units(s, d), _batch_rows(s, d), findings(s, d), checks(s, d))


def _domain_scores(s, d) -> DataFrame:
    return domain_scores(findings(s, d), check_coverage(checks(s, d)), evidence(units(s, d)), runs(s, d))


def weakest_domains(scores: DataFrame) -> DataFrame:
    """The scored domain of least score of every run; a tie goes to the first domain."""
    order = Window.partitionBy("run").orderBy("score", rank_of(F.col("domain"), DOMAINS))
    return scores.where("score is not null").withColumn("n", F.row_number().over(order)).where("n = 1").select("run", "domain", "score")


def step_coverage(rows: DataFrame) -> DataFrame:
    """Steps and contributing steps of each domain, and why others were skipped, by run."""
    each = rows.select("run", "step", "status", "reason", F.explode(F.array("domain_a", "domain_b")).alias("domain"))
    gave = F.col("status").isin("ok", "degraded")
    return each.groupBy("run", "domain").agg(
        F.count("*").alias("units_total"),
        F.count_if(gave).alias("units_audited"),
        F.array_join(F.array_sort(F.collect_list(F.when(~gave, F.concat_ws(": ", F.col("step").cast("string"), "reason")))), "; ").alias("skipped"),
    )


_R2 = "floor({0} * 100 + 0.5) / 100"
_DED = """SELECT {k}, severity, count(*) AS "count", count(*) FILTER (confidence = 'low') AS discounted,
 CASE severity WHEN 'critical' THEN 25.0::DOUBLE WHEN 'high' THEN 12.0 WHEN 'medium' THEN 6.0 WHEN 'low' THEN 2.0 ELSE 0.5 END AS per_finding,
 CASE severity WHEN 'critical' THEN 60.0::DOUBLE WHEN 'high' THEN 40.0 WHEN 'medium' THEN 25.0 WHEN 'low' THEN 12.0 ELSE 5.0 END AS cap
 FROM v_finding GROUP BY {k}, severity"""


def _ded(keys: str) -> str:
    return f"""SELECT *, applied < raw AS capped FROM (SELECT *, floor(least(raw, cap) * 100 + 0.5) / 100 AS applied FROM
 (SELECT *, floor(("count" - discounted * 0.5::DOUBLE) * per_finding * 100 + 0.5) / 100 AS raw FROM ({_DED.format(k=keys)})))"""


def _base(keys: str) -> str:
    return f"""SELECT {keys}, CAST(sum("count") AS BIGINT) AS findings, floor(least(100.0::DOUBLE, sum(applied)) * 100 + 0.5) / 100 AS deduction,
 CAST(floor(greatest(0.0, 100 - floor(least(100.0::DOUBLE, sum(applied)) * 100 + 0.5) / 100) + 0.5) AS INTEGER) AS base_score FROM ({_ded(keys)}) GROUP BY {keys}"""


_CEIL = """SELECT run, domain, CASE rule WHEN 'appsec.hardcoded-secret' THEN 'appsec.committed-secret'
 WHEN 'dependencies.vulnerable-package' THEN 'dependencies.unpatched-critical-cve' ELSE 'data.destructive-migration' END AS ceiling,
 CASE rule WHEN 'appsec.hardcoded-secret' THEN 50 WHEN 'dependencies.vulnerable-package' THEN 60 ELSE 70 END AS cap,
 count(*) AS triggers, min(id) AS first_trigger FROM v_finding
 WHERE confidence <> 'low' AND ((rule = 'appsec.hardcoded-secret' AND sev <= 1) OR (rule = 'dependencies.vulnerable-package' AND sev = 0)
 OR (rule = 'data.destructive-migration' AND sev <= 2)) GROUP BY ALL"""
_EVID = """SELECT run, CASE WHEN kind IN ('route', 'role-gate', 'sink') THEN 'appsec' WHEN kind IN ('data-access', 'migration') THEN 'data'
 WHEN kind IN ('workflow-job', 'container') THEN 'delivery' ELSE 'serverless' END AS domain, count(*) AS present,
 count(*) FILTER (cause = 'audited') AS verdicted FROM v_unit GROUP BY ALL"""
_W = "CASE domain " + " ".join(f"WHEN '{d}' THEN {w}::DOUBLE" for d, w in DOMAIN_WEIGHTS.items()) + " END"
_BAND = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"
_SCORES = f"""SELECT run, domain, findings, deduction, CASE WHEN rank > 0 THEN base_score END AS base_score, triggers, check_ratio, evidence_ratio, least(check_ratio, evidence_ratio) AS ratio,
 score, CASE WHEN score IS NOT NULL THEN {_BAND} END AS band, ['not-assessed', 'partial', 'scored'][rank + 1] AS status,
 CASE WHEN rank > 0 THEN floor({_W} * least(check_ratio, evidence_ratio) * 100 + 0.5) / 100 ELSE 0 END AS effective_weight FROM
 (SELECT *, CASE WHEN rank > 0 THEN CASE WHEN evidence_ratio < 0.5 THEN least(capped, 74) ELSE capped END END AS score FROM
 (SELECT *, least(CASE WHEN total = 0 OR check_ratio < 0.5 THEN 0 WHEN check_ratio < 0.9 THEN 1 ELSE 2 END,
   CASE WHEN present = 0 OR evidence_ratio >= 0.9 THEN 2 WHEN evidence_ratio >= 0.5 OR findings > 0 THEN 1 ELSE 0 END) AS rank FROM
 (SELECT e.run, e.domain, coalesce(findings, 0) AS findings, coalesce(deduction, 0) AS deduction, coalesce(base_score, 100) AS base_score, coalesce(c.triggers, 0) AS triggers,
  coalesce(total, 0) AS total, coalesce(present, 0) AS present,
  CASE WHEN coalesce(total, 0) > 0 THEN floor(ran::DOUBLE / total * 10000 + 0.5) / 10000 ELSE 0 END AS check_ratio,
  CASE WHEN coalesce(present, 0) > 0 THEN floor(verdicted::DOUBLE / present * 10000 + 0.5) / 10000 ELSE 1.0 END AS evidence_ratio,
  least(coalesce(base_score, 100), coalesce(c.cap, 100)) AS capped
  FROM (SELECT run, unnest([{", ".join(f"'{x}'" for x in DOMAINS)}]) AS domain FROM v_run) e LEFT JOIN base b USING (run, domain)
  LEFT JOIN (SELECT run, domain, min(cap) AS cap, CAST(sum(triggers) AS BIGINT) AS triggers FROM ceil_ GROUP BY ALL) c USING (run, domain)
  LEFT JOIN (SELECT run, domain, count(*) AS total, count(*) FILTER (ran) AS ran FROM v_check GROUP BY ALL) USING (run, domain)
  LEFT JOIN evid USING (run, domain))))"""
_PARTS = {"base": _base("run, domain"), "ceil_": _CEIL, "evid": _EVID, "scores": _SCORES}
_ALL = ("v_finding", "v_unit", "v_check", "v_run")
# signal, condition and penalty, as the confidence operator has them
_SIGNALS = """SELECT run, 0 AS place, 'units.partially-audited' AS signal, CASE WHEN units_total = 0 OR units_audited / units_total >= 0.98 THEN 0 WHEN units_audited / units_total >= 0.9 THEN 1 WHEN units_audited / units_total >= 0.75 THEN 2 ELSE 3 END AS penalty FROM basis
 UNION ALL SELECT run, 1, 'batches.partial', CASE WHEN batches_partial = 0 THEN 0 WHEN batches_partial / batches_total > 0.25 THEN 2 ELSE 1 END FROM basis
 UNION ALL SELECT run, 2, 'batches.failed', CASE WHEN batches_failed > 0 THEN 2 ELSE 0 END FROM basis
 UNION ALL SELECT run, 3, 'citations.relocated', CASE WHEN relocated > 0 THEN 1 ELSE 0 END FROM basis
 UNION ALL SELECT run, 4, 'citations.dropped', CASE WHEN dropped > 0 AND dropped / (findings + dropped) > 0.05 THEN 1 ELSE 0 END FROM basis
 UNION ALL SELECT run, 5, 'analyzers.degraded', least(2, degraded) FROM basis
 UNION ALL SELECT run, 6, 'findings.low-confidence', CASE WHEN findings > 0 AND low_confidence / findings > 0.25 THEN 1 ELSE 0 END FROM basis
 UNION ALL SELECT run, 7, 'run.quota-exhausted', CASE WHEN quota THEN 2 ELSE 0 END FROM basis
 UNION ALL SELECT run, 8, 'run.aborted', CASE WHEN aborted THEN 3 ELSE 0 END FROM basis"""
_BASIS = """SELECT run, coalesce(units_total, 0) AS units_total, coalesce(units_audited, 0) AS units_audited, coalesce(batches_total, 0) AS batches_total, coalesce(batches_partial, 0) AS batches_partial,
 coalesce(batches_failed, 0) AS batches_failed, coalesce(relocated, 0) AS relocated, coalesce(dropped, 0) AS dropped, coalesce(quota, false) AS quota, coalesce(aborted, false) AS aborted,
 coalesce(findings, 0) AS findings, coalesce(low_confidence, 0) AS low_confidence, coalesce(degraded, 0) AS degraded FROM v_run
 LEFT JOIN (SELECT run, count(*) AS units_total, count(*) FILTER (cause = 'audited') AS units_audited FROM v_unit GROUP BY run) USING (run)
 LEFT JOIN (SELECT run, count(*) AS batches_total, count(*) FILTER (status = 'partial') AS batches_partial, count(*) FILTER (status = 'failed') AS batches_failed, count(*) FILTER (units % 11 = 0) AS relocated,
  count(*) FILTER (duration < 3) AS dropped, bool_or(status = 'partial' AND duration > 300) AS quota, bool_or(status = 'failed' AND duration > 450) AS aborted FROM v_batch GROUP BY run) USING (run)
 LEFT JOIN (SELECT run, count(*) AS findings, count(*) FILTER (confidence = 'low') AS low_confidence FROM v_finding GROUP BY run) USING (run)
 LEFT JOIN (SELECT run, count(*) FILTER (NOT ran) AS degraded FROM v_check GROUP BY run) USING (run)"""

QUERIES = {
    "agg01_severity_counts": lambda s, d: severity_counts(findings(s, d), "run"),
    "agg02_deductions": lambda s, d: deductions(findings(s, d), "run", "domain"),
    "agg03_base_scores": lambda s, d: base_scores(findings(s, d), "run", "domain"),
    "agg13_ceilings": lambda s, d: ceiling_caps(findings(s, d), "run", "domain"),
    "domain_scores": _domain_scores,
    "agg12_gate": lambda s, d: _domain_scores(s, d).select("run", "domain", "check_ratio", "evidence_ratio", "status"),
    "agg14_statuses": lambda s, d: _domain_scores(s, d).groupBy("domain", "status").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.sum("findings").alias("findings")),
    "agg15_overall": lambda s, d: overall_scores(_domain_scores(s, d)),
    "srt10_weakest_domain": lambda s, d: weakest_domains(_domain_scores(s, d)),
    "agg16_run_confidence": lambda s, d: run_confidence(_basis(s, d)),
    "agg17_confidence_basis": _basis,
    "agg11_evidence": lambda s, d: evidence(units(s, d)),
    "agg04_step_coverage": lambda s, d: step_coverage(steps(s, d)),
}
_RANK = "CASE domain " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(DOMAINS)) + " END"
ORACLES = {
    "agg01_severity_counts": with_views("SELECT run, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES) + " FROM v_finding GROUP BY run", "v_finding"),
    "agg02_deductions": with_views(_ded("run, domain"), "v_finding"),
    "agg03_base_scores": with_views(_base("run, domain"), "v_finding"),
    "agg13_ceilings": with_views(_CEIL, "v_finding"),
    "domain_scores": with_views("SELECT * FROM scores", *_ALL, **_PARTS),
    "agg12_gate": with_views("SELECT run, domain, check_ratio, evidence_ratio, status FROM scores", *_ALL, **_PARTS),
    "agg14_statuses": with_views("SELECT domain, status, count(*) AS n, count(score) AS scored, CAST(sum(findings) AS BIGINT) AS findings FROM scores GROUP BY ALL", *_ALL, **_PARTS),
    "agg15_overall": with_views(
        f"""SELECT run, 8 - scored AS unscored, weighted_mean, limit_, worst_domain, weighted_mean > limit_ AS clamped, score, CASE WHEN score IS NOT NULL THEN {_BAND} END AS band,
 CASE WHEN scored = 0 THEN 'not-assessed' WHEN partial OR scored < 8 THEN 'partial' ELSE 'scored' END AS status
 FROM (SELECT *, CAST(floor(least(weighted_mean, limit_::DOUBLE) + 0.5) AS INTEGER) AS score FROM
 (SELECT run, count(score) AS scored, bool_or(status = 'partial') AS partial,
  floor(CASE WHEN sum(ew) FILTER (score IS NOT NULL) > 0 THEN (20 * sum(score * ew) + sum(ew) FILTER (score IS NOT NULL)) // (2 * sum(ew) FILTER (score IS NOT NULL)) ELSE (20 * sum(score) + count(score)) // (2 * count(score)) END) / 10 AS weighted_mean,
  CASE WHEN min(score) IS NOT NULL THEN least(100, min(score) + 15) END AS limit_, arg_min(domain, score * 10 + {_RANK}) AS worst_domain FROM (SELECT *, CAST(round(effective_weight * 100) AS BIGINT) AS ew FROM scores) GROUP BY run))""",
        *_ALL, **_PARTS,
    ),
    "srt10_weakest_domain": with_views(f"SELECT run, arg_min(domain, score * 10 + {_RANK}) AS domain, min(score) AS score FROM scores WHERE score IS NOT NULL GROUP BY run", *_ALL, **_PARTS),
    "agg16_run_confidence": with_views(
        """SELECT run, CAST(coalesce(p, 0) AS INTEGER) AS penalty, CASE WHEN coalesce(p, 0) >= 4 THEN 'low' WHEN coalesce(p, 0) >= 1 THEN 'medium' ELSE 'high' END AS level, coalesce(s, '') AS signals
 FROM v_run LEFT JOIN (SELECT run, sum(penalty) AS p, string_agg(signal, ',' ORDER BY place) AS s FROM sig WHERE penalty > 0 GROUP BY run) USING (run)""",
        *_ALL, "v_batch", basis=_BASIS, sig=_SIGNALS,
    ),
    "agg17_confidence_basis": with_views("SELECT *, false AS synthetic FROM basis", *_ALL, "v_batch", basis=_BASIS),
    "agg11_evidence": with_views(_EVID, "v_unit"),
    "agg04_step_coverage": with_views(
        """SELECT run, domain, count(*) AS units_total, count(*) FILTER (status IN ('ok', 'degraded')) AS units_audited,
 coalesce(string_agg(step || ': ' || reason, '; ' ORDER BY step || ': ' || reason) FILTER (status NOT IN ('ok', 'degraded')), '') AS skipped
 FROM (SELECT *, unnest([domain_a, domain_b]) AS domain FROM v_step) GROUP BY run, domain""",
        "v_step",
    ),
}
