"""Facts, assurances, rollups, references and rule predicates over rows of the audit model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scales import DOMAINS, SEVERITIES, UNIT_KINDS, label_of
from ledgerloom.operators.ranges import cut_to_shown
from ledgerloom.sources.views import batches, edges, findings, lines, spans, steps, table, units, with_views

FACT_EVIDENCE = 25
ASSURANCE_EVIDENCE = 12


def with_first(totals: DataFrame, rows: DataFrame, keys: list[str], order: list[str], value: str, limit: int, name: str) -> DataFrame:
    """totals with the first `limit` values of each group, joined by commas; no more than these meet in one task.

    Rows are distinct by (keys, value); the rank filter is applied before the exchange too.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = rows.withColumn("place", place).where(F.col("place") <= limit).groupBy(*[F.col(k).alias(f"__{k}") for k in keys])
    kept = kept.agg(F.array_sort(F.collect_list(F.struct("place", F.col(value).alias("v")))).alias("__e"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = totals.join(kept, same, "left").withColumn(name, F.coalesce(F.array_join(F.transform("__e", lambda x: x["v"]), ","), F.lit("")))
    return joined.select(*totals.columns, name)


def merged_facts(rows: DataFrame, limit: int = FACT_EVIDENCE) -> DataFrame:
    """Facts by kind and value: strongest confidence, the first distinct evidence, the first detail."""
    each = rows.groupBy("kind", "value", "evidence").agg(F.min("seq").alias("seq"))
    got = rows.groupBy("kind", "value").agg(F.min("conf").alias("conf"), F.min_by("detail", "seq").alias("detail"))
    return with_first(got, each, ["kind", "value"], ["seq", "evidence"], "evidence", limit, "evidence")


def absences(probes: DataFrame, facts: DataFrame) -> DataFrame:
    """Probed kinds without any fact, with all that was searched."""
    missing = probes.join(facts.select("kind").distinct(), "kind", "left_anti")
    return missing.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("searched")), ",").alias("searched"))


def assurances(rows: DataFrame, limit: int = ASSURANCE_EVIDENCE) -> DataFrame:
    """Checked units by domain kind and check: distinct units and the first evidence."""
    got = rows.groupBy("kind", "check").agg(F.countDistinct("unit_id").alias("units"))
    files = rows.where("file is not null").select("kind", "check", "file").distinct()
    return with_first(got, files, ["kind", "check"], ["file"], "file", limit, "evidence")


def containment_rollup(rows: DataFrame) -> DataFrame:
    """Per host span: number of inner spans it holds and their distinct starts."""
    inner = rows.where("inner").select("file", F.col("span").alias("i"), F.col("start").alias("a"), F.col("stop").alias("b"))
    hit = rows.where("not inner").join(inner, "file").where("start <= a and stop >= b")
    return hit.groupBy("file", "span").agg(F.count("*").alias("held"), F.array_join(F.array_sort(F.collect_set("a")).cast("array<string>"), ",").alias("starts"))


def status_rows(rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every domain with findings, worst severity and steps."""
    all_ = rows.sparkSession.createDataFrame([(d,) for d in DOMAINS], "domain string")
    f = rows.groupBy("domain").agg(F.count("*").alias("findings"), F.min("sev").alias("s"))
    c = coverage.select(F.explode(F.array("domain_a", "domain_b")).alias("domain")).groupBy("domain").agg(F.count("*").alias("steps"))
    got = all_.join(f, "domain", "left").join(c, "domain", "left")
    return got.select("domain", F.coalesce("findings", F.lit(0)).alias("findings"), label_of(F.col("s"), SEVERITIES).alias("worst"), F.coalesce("steps", F.lit(0)).alias("steps"))


def usage(rows: DataFrame) -> DataFrame:
    """Ledger of a run: calls, units and whole milliseconds."""
    return rows.groupBy("run").agg(F.count("*").alias("calls"), F.sum("units").alias("units"), F.sum(F.floor(F.col("duration") * 1000 + 0.5)).alias("millis"), F.count_if(F.col("status") == "failed").alias("failures"))


def license_rollup(rows: DataFrame, unknown: str, listed: int = 3) -> DataFrame:
    """One finding for all licences of a brand that are `unknown`: number and the first names."""
    rows = rows.where(unknown)
    names = rows.where("p_name is not null").select("p_brand", "p_name").distinct()
    return with_first(rows.groupBy("p_brand").agg(F.count("*").alias("n")), names, ["p_brand"], ["p_name"], "p_name", listed, "listed")


def suppression_summary(rows: DataFrame) -> DataFrame:
    n = rows.where("cause <> 'audited'").groupBy("kind", "cause").agg(F.count("*").alias("n"))
    each = F.struct("cause", F.concat_ws(" ", F.col("n").cast("string"), "cause").alias("t"))
    return n.groupBy("kind").agg(F.array_sort(F.collect_list(each)).alias("x")).select("kind", F.array_join(F.transform("x", lambda v: v["t"]), "; ").alias("summary"))


def proposal_cost(rows: DataFrame) -> DataFrame:
    """Seconds of accepted proposals by kind, bounded as the cost model has it, and whether any needs a model."""
    seconds = F.least(F.lit(900), F.greatest(F.lit(60), F.col("n") * 10))
    n = rows.groupBy("run", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("run").agg(F.sum(seconds).alias("seconds"), F.bool_or(F.col("kind").isin("route", "sink")).alias("uses_model"))


def issue_titles(rows: DataFrame) -> DataFrame:
    labels = F.array_join(F.array(F.col("severity"), F.concat(F.lit("domain:"), F.col("domain"))), ",")
    return rows.select("id", "title", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("rule"), F.lit(" in "), F.col("file")).alias("issue"), labels.alias("labels"))


def clamped_verdicts(rows: DataFrame) -> DataFrame:
    """Severity of model findings no higher than the check's ceiling; titles cut to 8 characters."""
    ceiling = F.when(F.col("domain").isin("appsec", "data"), 0).when(F.col("domain") == "api", 1).when(F.col("domain") == "serverless", 2).otherwise(3)
    return rows.select("id", "title", label_of(F.greatest("sev", ceiling), SEVERITIES).alias("severity"), F.substring("title", 1, 8).alias("short"))


def strays(verdicts: DataFrame, members: DataFrame) -> DataFrame:
    """Verdicts on units that aren't in the batch, counted by run."""
    return verdicts.join(members, "unit_id", "left_anti").groupBy("run").agg(F.count("*").alias("strays"))


def router_prefixes(edges_: DataFrame, doublings: int = 3) -> DataFrame:
    """Path prefix of each router from its chain of parents, at most eight deep: chains of one step are joined to ones of two, four and eight."""
    known = edges_.select(F.col("child").alias("parent")).distinct()
    step = edges_.join(known.withColumn("there", F.lit(True)), "parent", "left")
    chain = step.select("child", F.when(F.col("there"), F.col("parent")).alias("above"), F.concat(F.lit("/"), F.col("child").cast("string")).alias("prefix"))
    for _ in range(doublings):
        upper = chain.select(F.col("child").alias("above"), F.col("above").alias("next"), F.col("prefix").alias("p"))
        chain = chain.join(upper, "above", "left").select("child", F.col("next").alias("above"), F.concat(F.coalesce("p", F.lit("")), "prefix").alias("prefix"))
    return chain.select("child", "prefix")


def unlocked(declared: DataFrame, locked: DataFrame) -> DataFrame:
    return declared.join(locked, "p_partkey", "left_anti")


def unindexed(rows: DataFrame, leads: str) -> DataFrame:
    """Filtered columns without an index that leads with them; `leads` tells the rows that stand for one."""
    used = rows.select(F.col("file").alias("tab"), F.col("segment").alias("col")).distinct()
    index = rows.where(leads).select(F.col("file").alias("tab"), F.col("segment").alias("col")).distinct()
    return used.join(index, ["tab", "col"], "left_anti").groupBy("tab").agg(F.count("*").alias("columns"))


def prompt_fit(rows: DataFrame, budget: int = 400) -> DataFrame:
    """Shared blocks in order of priority while they fit the budget together."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("used", F.sum(F.char_length("line")).over(order)).where(F.col("used") <= budget)
    return got.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max("used").alias("used"))


def segment_plan(rows: DataFrame, budget: int = 20, head_share: float = 0.6) -> DataFrame:
    """A block beyond the budget is shown by its head and tail, 60 to 40."""
    size = F.col("stop") - F.col("start") + 1
    head = F.floor(F.lit(budget) * head_share).cast("int")
    whole = size <= budget
    return rows.select(
        "span", F.col("start").alias("head_from"), F.when(whole, F.col("stop")).otherwise(F.col("start") + head - 1).alias("head_to"),
        F.when(~whole, F.col("stop") - (budget - head) + 1).alias("tail_from"), F.when(~whole, F.col("stop")).alias("tail_to"),
    )


def representatives(rows: DataFrame) -> DataFrame:
    """The member of a brief group that stands for it: worst, in the file with most members."""
    rows = rows.withColumn("in_file", F.count("*").over(Window.partitionBy("domain", "rule", "file")))
    order = Window.partitionBy("domain", "rule").orderBy("sev", F.desc("in_file"), "file", "line", "id", "title")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("domain", "rule", "file", "line", "id", "title")


def stop_reason(rows: DataFrame) -> DataFrame:
    """Why a run's batches stopped: cancelled before quota before clock before planned."""
    by = rows.groupBy("run").agg(F.bool_or((F.col("status") == "failed") & (F.col("duration") > 450)).alias("c"), F.sum("duration").alias("t"), F.count_if(F.col("status") == "partial").alias("p"))
    return by.select("run", F.when(F.col("c"), "cancelled").when(F.col("p") > 12, "quota").when(F.col("t") > 4e7, "clock").otherwise("planned").alias("reason"))


def missing_domains(rows: DataFrame) -> DataFrame:
    """Domains without any finding, by run."""
    all_ = rows.sparkSession.createDataFrame([(d,) for d in DOMAINS], "domain string")
    runs = rows.select("run").distinct()
    # Eight rows: a fixed size.
    return runs.join(F.broadcast(all_)).join(rows.select("run", "domain").distinct(), ["run", "domain"], "left_anti")


def owner_checks(rows: DataFrame) -> DataFrame:
    """Each check of a kind belongs to its first row; later claims are dropped."""
    order = Window.partitionBy("kind", "segment").orderBy("unit_id")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("kind", "segment", "unit_id")


def facts_of(s, d) -> DataFrame:
    return findings(s, d).select(F.col("domain").alias("kind"), F.col("source").alias("value"), F.col("file").alias("evidence"), F.col("title").alias("detail"), "conf", F.concat_ws("/", "title", F.lpad(F.col("line").cast("string"), 2, "0")).alias("seq"))


def _cited(s, d):
    sp = spans(s, d)
    return cut_to_shown(sp.where("inner").select("file", "span", F.col("start").alias("a"), F.col("stop").alias("b")), sp.where("not inner").select("file", "start", "stop"))


QUERIES = {
    "agg18_merged_facts": lambda s, d: merged_facts(facts_of(s, d)),
    "agg19_absences": lambda s, d: absences(units(s, d).select("kind", F.col("segment").alias("searched")), units(s, d).where("kind in ('route', 'sink', 'cron')")),
    "agg22_assurances": lambda s, d: assurances(units(s, d).withColumn("check", F.col("priority"))),
    "agg42_containment_rollup": lambda s, d: containment_rollup(spans(s, d)),
    "agg33_status_rows": lambda s, d: status_rows(findings(s, d), steps(s, d)),
    "agg36_usage": lambda s, d: usage(batches(s, d)),
    "agg41_license_rollup": lambda s, d: license_rollup(table(s, d, "part"), "p_size % 5 = 0"),
    "agg45_suppressions": lambda s, d: suppression_summary(units(s, d)),
    "agg46_proposal_cost": lambda s, d: proposal_cost(units(s, d)),
    "prj47_issue_titles": lambda s, d: issue_titles(findings(s, d)),
    "prj51_verdict_clamp": lambda s, d: clamped_verdicts(findings(s, d)),
    "flt06_slice_gate": _cited,
    "join08_strays": lambda s, d: strays(units(s, d), units(s, d).where("unit_id % 4 <> 0").select("unit_id")),
    "join17_router_prefixes": lambda s, d: router_prefixes(edges(s, d)),
    "join21_unlocked": lambda s, d: unlocked(table(s, d, "part").select("p_partkey"), table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).where("p_partkey % 3 <> 0").distinct()),
    "join23_unindexed": lambda s, d: unindexed(units(s, d), "status = 'F' and line % 7 = 0"),
    "exe10_prompt_fit": lambda s, d: prompt_fit(lines(s, d)),
    "win12_segment_plan": lambda s, d: segment_plan(spans(s, d)),
    "win16_representatives": lambda s, d: representatives(findings(s, d)),
    "exe11_stop_reason": lambda s, d: stop_reason(batches(s, d)),
    "set10_missing_domains": lambda s, d: missing_domains(findings(s, d)),
    "rul15_check_owners": lambda s, d: owner_checks(units(s, d)),
    "agg20_units_by_kind": lambda s, d: s.createDataFrame([(k, i) for i, k in enumerate(UNIT_KINDS)], "kind string, place int").join(units(s, d).groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").na.fill(0, ["n"]),
}
_FACT = "SELECT domain AS kind, source AS value, file AS evidence, title AS detail, conf, title || '/' || lpad(CAST(line AS VARCHAR), 2, '0') AS seq FROM v_finding"
_LAB = "['critical', 'high', 'medium', 'low', 'info'][{} + 1]"
_DL = ", ".join(f"'{x}'" for x in DOMAINS)
ORACLES = {
    "agg18_merged_facts": with_views("SELECT kind, value, c AS conf, detail, list_aggregate(list_slice(list_transform(list_sort(e), lambda x: x.evidence), 1, 25), 'string_agg', ',') AS evidence FROM (SELECT kind, value, min(mc) AS c, arg_min(md, first_) AS detail, list({'seq': first_, 'evidence': evidence}) AS e FROM (SELECT kind, value, evidence, min(seq) AS first_, min(conf) AS mc, arg_min(detail, seq) AS md FROM f GROUP BY ALL) GROUP BY kind, value)", "v_finding", f=_FACT),
    "agg19_absences": with_views("SELECT kind, string_agg(DISTINCT segment, ',' ORDER BY segment) AS searched FROM v_unit WHERE kind NOT IN ('route', 'sink', 'cron') GROUP BY kind", "v_unit"),
    "agg22_assurances": with_views("SELECT kind, priority AS \"check\", count(DISTINCT unit_id) AS units, list_aggregate(list_slice(list_sort(list(DISTINCT file)), 1, 12), 'string_agg', ',') AS evidence FROM v_unit GROUP BY ALL", "v_unit"),
    "agg42_containment_rollup": with_views("SELECT h.file, h.span, count(*) AS held, list_aggregate(list_transform(list_sort(list(DISTINCT i.start)), lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS starts FROM v_span h JOIN v_span i ON i.file = h.file AND i.inner_ AND NOT h.inner_ AND h.start <= i.start AND h.stop >= i.stop GROUP BY ALL", "v_span"),
    "agg33_status_rows": with_views(f"SELECT domain, coalesce(n, 0) AS findings, {_LAB.format('s')} AS worst, coalesce(c, 0) AS steps FROM (SELECT unnest([{_DL}]) AS domain) LEFT JOIN (SELECT domain, count(*) AS n, min(sev) AS s FROM v_finding GROUP BY domain) USING (domain) LEFT JOIN (SELECT domain, count(*) AS c FROM (SELECT unnest([domain_a, domain_b]) AS domain FROM v_step) GROUP BY domain) USING (domain)", "v_finding", "v_step"),
    "agg36_usage": with_views("SELECT run, count(*) AS calls, CAST(sum(units) AS BIGINT) AS units, CAST(sum(CAST(floor(duration * 1000 + 0.5) AS BIGINT)) AS BIGINT) AS millis, count(*) FILTER (status = 'failed') AS failures FROM v_batch GROUP BY run", "v_batch"),
    "agg41_license_rollup": "SELECT p_brand, count(*) AS n, list_aggregate(list_slice(list_sort(list(DISTINCT p_name)), 1, 3), 'string_agg', ',') AS listed FROM part WHERE p_size % 5 = 0 GROUP BY p_brand",
    "agg45_suppressions": with_views("SELECT kind, string_agg(n || ' ' || cause, '; ' ORDER BY cause) AS summary FROM (SELECT kind, cause, count(*) AS n FROM v_unit WHERE cause <> 'audited' GROUP BY ALL) GROUP BY kind", "v_unit"),
    "agg46_proposal_cost": with_views("SELECT run, CAST(sum(least(900, greatest(60, n * 10))) AS BIGINT) AS seconds, bool_or(kind IN ('route', 'sink')) AS uses_model FROM (SELECT run, kind, count(*) AS n FROM v_unit GROUP BY ALL) GROUP BY run", "v_unit"),
    "prj47_issue_titles": with_views("SELECT id, title, '[' || upper(severity) || '] ' || rule || ' in ' || file AS issue, severity || ',domain:' || domain AS labels FROM v_finding", "v_finding"),
    "prj51_verdict_clamp": with_views(f"SELECT id, title, {_LAB.format('greatest(sev, CASE WHEN domain IN (' + chr(39) + 'appsec' + chr(39) + ', ' + chr(39) + 'data' + chr(39) + ') THEN 0 WHEN domain = ' + chr(39) + 'api' + chr(39) + ' THEN 1 WHEN domain = ' + chr(39) + 'serverless' + chr(39) + ' THEN 2 ELSE 3 END)')} AS severity, substr(title, 1, 8) AS short FROM v_finding", "v_finding"),
    "flt06_slice_gate": with_views("SELECT i.file, i.span, max(least(i.stop, h.stop)) AS \"end\" FROM v_span i JOIN v_span h ON i.file = h.file AND i.inner_ AND NOT h.inner_ AND i.start BETWEEN h.start AND h.stop GROUP BY ALL", "v_span"),
    "join08_strays": with_views("SELECT run, count(*) AS strays FROM v_unit WHERE unit_id % 4 = 0 GROUP BY run", "v_unit"),
    "join17_router_prefixes": with_views("SELECT child, arg_max(prefix, depth) AS prefix FROM up GROUP BY child", "v_edge", recursive=True, **{"up(child, node, depth, prefix)": "SELECT child, parent, 1, '/' || CAST(child AS VARCHAR) FROM v_edge UNION ALL SELECT u.child, e.parent, u.depth + 1, '/' || CAST(e.child AS VARCHAR) || u.prefix FROM up u JOIN v_edge e ON e.child = u.node WHERE u.depth < 8"}),
    "join21_unlocked": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 3 <> 0)",
    "join23_unindexed": with_views("SELECT tab, count(*) AS columns FROM (SELECT DISTINCT file AS tab, segment AS col FROM v_unit EXCEPT SELECT file, segment FROM v_unit WHERE status = 'F' AND line % 7 = 0) GROUP BY tab", "v_unit"),
    "exe10_prompt_fit": with_views("SELECT doc_id, count(*) AS blocks, CAST(max(used) AS BIGINT) AS used FROM (SELECT doc_id, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS used FROM v_line) WHERE used <= 400 GROUP BY doc_id", "v_line"),
    "win12_segment_plan": with_views("SELECT span, start AS head_from, CASE WHEN stop - start + 1 <= 20 THEN stop ELSE start + 11 END AS head_to, CASE WHEN stop - start + 1 > 20 THEN stop - 7 END AS tail_from, CASE WHEN stop - start + 1 > 20 THEN stop END AS tail_to FROM v_span", "v_span"),
    "win16_representatives": with_views("SELECT domain, rule, file, line, id, title FROM (SELECT *, row_number() OVER (PARTITION BY domain, rule ORDER BY sev, in_file DESC, file, line, id, title) AS n FROM (SELECT *, count(*) OVER (PARTITION BY domain, rule, file) AS in_file FROM v_finding)) WHERE n = 1", "v_finding"),
    "exe11_stop_reason": with_views("SELECT run, CASE WHEN bool_or(status = 'failed' AND duration > 450) THEN 'cancelled' WHEN count(*) FILTER (status = 'partial') > 12 THEN 'quota' WHEN sum(duration) > 4e7 THEN 'clock' ELSE 'planned' END AS reason FROM v_batch GROUP BY run", "v_batch"),
    "set10_missing_domains": with_views(f"SELECT run, domain FROM (SELECT DISTINCT run FROM v_finding), (SELECT unnest([{_DL}]) AS domain) EXCEPT SELECT run, domain FROM v_finding", "v_finding"),
    "rul15_check_owners": with_views("SELECT kind, segment, min(unit_id) AS unit_id FROM v_unit GROUP BY ALL", "v_unit"),
    "agg20_units_by_kind": with_views("SELECT kind, CAST(place AS INTEGER) AS place, coalesce(n, 0) AS n FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in UNIT_KINDS) + "]) AS kind, unnest(range(11)) AS place) LEFT JOIN (SELECT kind, count(*) AS n FROM v_unit GROUP BY kind) USING (kind)", "v_unit"),
}
