"""Readers of analyzer reports held as text, one report a row: JSON with explicit schemas, tables, prose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.views import findings, table, with_views

SARIF = (
    "struct<version:string,runs:array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,"
    "defaultConfiguration:struct<level:string>,properties:struct<tags:array<string>>>>>>,"
    "results:array<struct<ruleId:string,ruleIndex:int,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>>>>>"
)
VULNERABILITIES = (
    "struct<Results:array<struct<Target:string,Type:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,"
    "InstalledVersion:string,FixedVersion:string,Severity:string>>>>>"
)
SBOM = "struct<components:array<struct<name:string,version:string,purl:string,licenses:array<struct<expression:string,license:struct<id:string,name:string>>>>>>"
UNUSED = (
    "struct<issues:array<struct<file:string,exports:array<struct<name:string,line:int>>,types:array<struct<name:string,line:int>>,"
    "dependencies:array<struct<name:string,line:int>>,unlisted:array<struct<name:string,line:int>>>>>"
)
MODULES = "struct<modules:array<struct<source:string,orphan:boolean>>,summary:struct<violations:array<struct<type:string,from:string,to:string>>>>"
OUTDATED = "map<string,struct<current:string,wanted:string,latest:string,type:string>>"
LINT = "array<struct<code:string,file:string,level:string,line:int,message:string>>"


def _parsed(reports: DataFrame, schema: str) -> DataFrame:
    """Reports with their parsed document; one that isn't valid has none and counts as an error row."""
    return reports.withColumn("doc", F.from_json("body", schema))


def unreadable(reports: DataFrame) -> DataFrame:
    """Reports that aren't valid JSON, listed rather than thrown."""
    return reports.where(F.try_parse_json("body").isNull()).select("report", F.char_length("body").alias("length"))


def read_sarif(reports: DataFrame) -> DataFrame:
    """Results with their level: the result's own, else the rule's (by id, then by index), else warning."""
    runs = _parsed(reports, SARIF).select("report", F.explode("doc.runs").alias("r"))
    rows = runs.select("report", F.col("r.tool.driver.name").alias("tool"), F.col("r.tool.driver.rules").alias("rules"), F.explode("r.results").alias("x"))
    by_id = F.filter("rules", lambda q: q["id"] == F.col("x.ruleId"))
    by_index = F.filter("rules", lambda q, i: i == F.col("x.ruleIndex"))
    rule = F.coalesce(F.get(by_id, F.lit(0)), F.get(by_index, F.lit(0)))
    place = F.get("x.locations", F.lit(0))["physicalLocation"]
    return rows.select(
        "report", "tool", F.coalesce("x.ruleId", rule["id"]).alias("rule"), F.coalesce("x.level", rule["defaultConfiguration"]["level"], F.lit("warning")).alias("level"),
        F.col("x.message.text").alias("message"), place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"),
    )


def read_vulnerabilities(reports: DataFrame) -> DataFrame:
    rows = _parsed(reports, VULNERABILITIES).select("report", F.explode("doc.Results").alias("r")).select("report", F.col("r.Target").alias("target"), F.explode("r.Vulnerabilities").alias("v"))
    return rows.select("report", "target", F.col("v.VulnerabilityID").alias("cve"), F.col("v.PkgName").alias("package"), F.col("v.InstalledVersion").alias("installed"), F.col("v.FixedVersion").alias("fixed"), F.lower("v.Severity").alias("severity"))


def read_sbom(reports: DataFrame) -> DataFrame:
    rows = _parsed(reports, SBOM).select("report", F.explode("doc.components").alias("c"))
    licence = F.get("c.licenses", F.lit(0))
    return rows.select("report", "c.name", "c.version", F.coalesce(licence["expression"], licence["license"]["id"], licence["license"]["name"], F.lit("unknown")).alias("license"))


def read_unused(reports: DataFrame) -> DataFrame:
    """Unused-code candidates: one row per issue of any kind."""
    rows = _parsed(reports, UNUSED).select("report", F.explode("doc.issues").alias("i"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"i.{k}").alias("list")) for k in ("exports", "types", "dependencies", "unlisted")])
    each = rows.select("report", "i.file", F.explode(kinds).alias("k")).select("report", "file", "k.kind", F.explode("k.list").alias("x"))
    return each.select("report", "file", "kind", "x.name", "x.line")


def read_modules(reports: DataFrame) -> DataFrame:
    """Orphan modules: flagged ones and those that a violation names alone."""
    rows = _parsed(reports, MODULES)
    flagged = rows.select("report", F.explode("doc.modules").alias("m")).where("m.orphan").select("report", F.col("m.source").alias("module"))
    alone = rows.select("report", F.explode("doc.summary.violations").alias("v")).where("v.from = v.to").select("report", F.col("v.from").alias("module"))
    return flagged.union(alone).distinct()


def read_outdated(reports: DataFrame) -> DataFrame:
    """npm and pnpm form: a map by package."""
    rows = _parsed(reports, OUTDATED).select("report", F.explode("doc").alias("package", "o"))
    return rows.select("report", "package", "o.current", F.coalesce("o.wanted", "o.current").alias("wanted"), "o.latest")


def read_outdated_lines(reports: DataFrame) -> DataFrame:
    """yarn form: lines of JSON, of which the table record counts."""
    each = reports.select("report", F.explode(F.split("body", "\n")).alias("l"))
    rows = each.withColumn("t", F.from_json("l", "struct<type:string,data:struct<head:array<string>,body:array<array<string>>>>")).where("t.type = 'table'")
    cells = rows.select("report", F.col("t.data.head").alias("head"), F.explode("t.data.body").alias("row")).select("report", F.map_from_arrays("head", "row").alias("m"))
    return cells.select("report", F.col("m")["Package"].alias("package"), F.col("m")["Current"].alias("current"), F.col("m")["Latest"].alias("latest"))


def read_outdated_table(reports: DataFrame) -> DataFrame:
    """bun form: a table drawn with bars; head and rules aren't rows."""
    each = reports.select("report", F.explode(F.split("body", "\n")).alias("l")).where(F.col("l").startswith("|") & ~F.col("l").rlike(r"^\|[-| ]+$"))
    cell = lambda i: F.trim(F.get(F.split("l", r"\|"), F.lit(i)))
    rows = each.select("report", cell(1).alias("package"), cell(2).alias("current"), cell(4).alias("latest"))
    return rows.where("package <> 'Package'")


def read_lint(reports: DataFrame) -> DataFrame:
    rows = _parsed(reports, LINT).select("report", F.explode("doc").alias("x"))
    return rows.select("report", F.concat(F.lit("delivery.dockerfile."), "x.code").alias("rule"), "x.file", "x.line", F.when(F.col("x.level") == "error", "medium").when(F.col("x.level") == "warning", "low").otherwise("info").alias("severity"))


def read_reply(rows: DataFrame) -> DataFrame:
    """JSON inside prose: a fenced block first, then from the first brace to the last."""
    fenced = F.regexp_extract("body", r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract("body", r"(?s)(\{.*\})", 1)
    found = F.when(fenced != "", fenced).otherwise(bare)
    doc = F.from_json(found, "struct<batch:long,answer:string>")
    state = F.when(F.trim("body") == "", "empty").when((found == "") & F.contains("body", F.lit("{")), "unterminated").when(found == "", "no-json").when(doc["batch"].isNull(), "invalid").otherwise("ok")
    return rows.select("report", state.alias("state"), doc["answer"].alias("answer"))


def sarif_reports(rows: DataFrame) -> DataFrame:
    """Findings written as SARIF, one report a run: the sink to which read_sarif is the source."""
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    own = F.when(F.col("sev") <= 1, F.lit("error"))
    result = F.struct(F.col("rule").alias("ruleId"), own.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"))
    rule = F.struct(F.col("rule").alias("id"), F.struct(F.when(F.col("rule").endswith("1"), F.lit("note")).alias("level")).alias("defaultConfiguration"))
    runs = rows.groupBy("run").agg(F.collect_list(result).alias("results"), F.array_distinct(F.collect_list(rule)).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit("scan").alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return runs.select(F.col("run").alias("report"), F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("body"))


def _parts(s, d):
    return table(s, d, "part")


def _vulnerability_reports(s, d):
    v = F.struct(F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("VulnerabilityID"), F.col("p_name").alias("PkgName"), F.col("p_size").cast("string").alias("InstalledVersion"), F.when(F.col("p_size") > 25, (F.col("p_size") + 1).cast("string")).alias("FixedVersion"), F.upper("p_brand").alias("Severity"))
    rows = _parts(s, d).groupBy("p_size").agg(F.collect_list(v).alias("Vulnerabilities"))
    doc = F.struct(F.array(F.struct(F.lit("lock").alias("Target"), F.lit("npm").alias("Type"), F.col("Vulnerabilities"))).alias("Results"))
    return rows.select(F.col("p_size").alias("report"), F.to_json(doc).alias("body"))


def _outdated_reports(s, d):
    one = F.struct(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("k"), F.struct(F.col("p_size").cast("string").alias("current"), F.when(F.col("p_size") % 2 == 0, F.lit("7")).alias("wanted"), F.lit("9").alias("latest")).alias("v"))
    return _parts(s, d).groupBy("p_brand").agg(F.map_from_entries(F.collect_list(one)).alias("m")).select(F.col("p_brand").alias("report"), F.to_json("m").alias("body"))


def _yarn_reports(s, d):
    row = F.array(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_size").cast("string"), F.lit("9"))
    rows = _parts(s, d).groupBy("p_brand").agg(F.collect_list(row).alias("body"))
    rec = F.to_json(F.struct(F.lit("table").alias("type"), F.struct(F.array(F.lit("Package"), F.lit("Current"), F.lit("Latest")).alias("head"), F.col("body")).alias("data")))
    return rows.select(F.col("p_brand").alias("report"), F.concat(F.lit('{"type":"info","data":"x"}\n'), rec, F.lit("\nnot json")).alias("body"))


def _bun_reports(s, d):
    row = F.concat(F.lit("| p"), F.col("p_partkey").cast("string"), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" | 8 | 9 |"))
    rows = _parts(s, d).groupBy("p_brand").agg(F.array_join(F.collect_list(row), "\n").alias("b"))
    return rows.select(F.col("p_brand").alias("report"), F.concat(F.lit("bun outdated\n| Package | Current | Update | Latest |\n|---|---|---|---|\n"), "b").alias("body"))


def _unused_reports(s, d):
    item = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("line"))
    issue = F.struct(F.col("p_brand").alias("file"), F.when(F.col("p_partkey") % 2 == 0, F.array(item)).alias("exports"), F.when(F.col("p_partkey") % 3 == 0, F.array(item)).alias("dependencies"))
    rows = _parts(s, d).groupBy("p_size").agg(F.collect_list(issue).alias("issues"))
    return rows.select(F.col("p_size").alias("report"), F.to_json(F.struct("issues")).alias("body"))


def _module_reports(s, d):
    mod = F.struct(F.col("p_name").alias("source"), (F.col("p_size") > 40).alias("orphan"))
    vio = F.struct(F.lit("orphan").alias("type"), F.col("p_name").alias("from"), F.when(F.col("p_size") < 5, F.col("p_name")).otherwise(F.lit("x")).alias("to"))
    rows = _parts(s, d).groupBy("p_brand").agg(F.collect_list(mod).alias("modules"), F.collect_list(vio).alias("v"))
    return rows.select(F.col("p_brand").alias("report"), F.to_json(F.struct("modules", F.struct(F.col("v").alias("violations")).alias("summary"))).alias("body"))


def _lint_reports(s, d):
    x = F.struct(F.concat(F.lit("DL"), F.col("p_partkey").cast("string")).alias("code"), F.lit("Dockerfile").alias("file"), F.when(F.col("p_size") > 30, "error").when(F.col("p_size") > 15, "warning").otherwise("style").alias("level"), F.col("p_size").alias("line"))
    return _parts(s, d).groupBy("p_brand").agg(F.to_json(F.collect_list(x)).alias("body")).withColumnRenamed("p_brand", "report")


def _replies(s, d):
    e = table(s, d, "events")
    doc = F.to_json(F.struct(F.col("event_id").alias("batch"), F.col("event_type").alias("answer")))
    k = F.col("event_id") % 5
    body = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), doc, F.lit("\n```\ndone"))).when(k == 1, F.concat(F.lit("I say "), doc, F.lit(" so"))).when(k == 2, F.lit("  ")).when(k == 3, F.lit("no answer")).otherwise(F.lit('{"batch": 1'))
    return e.select(F.col("event_id").alias("report"), body.alias("body"))


QUERIES = {
    "src05_sarif": lambda s, d: read_sarif(sarif_reports(findings(s, d))),
    "src06_vulnerabilities": lambda s, d: read_vulnerabilities(_vulnerability_reports(s, d)),
    "src08_unused": lambda s, d: read_unused(_unused_reports(s, d)),
    "src10_modules": lambda s, d: read_modules(_module_reports(s, d)),
    "src11_outdated": lambda s, d: read_outdated(_outdated_reports(s, d)),
    "src13_outdated_lines": lambda s, d: read_outdated_lines(_yarn_reports(s, d)),
    "src14_outdated_table": lambda s, d: read_outdated_table(_bun_reports(s, d)),
    "src18_lint": lambda s, d: read_lint(_lint_reports(s, d)),
    "src29_replies": lambda s, d: read_reply(_replies(s, d)),
    "src27_unreadable": lambda s, d: unreadable(_replies(s, d).withColumn("body", F.regexp_extract("body", r"(\{.*\})", 1))),
}
ORACLES = {
    "src05_sarif": with_views("SELECT run AS report, 'scan' AS tool, rule, CASE WHEN sev <= 1 THEN 'error' WHEN rule LIKE '%1' THEN 'note' ELSE 'warning' END AS level, title AS message, file, line FROM v_finding", "v_finding"),
    "src06_vulnerabilities": "SELECT p_size AS report, 'lock' AS target, 'CVE-' || p_partkey AS cve, p_name AS package, CAST(p_size AS VARCHAR) AS installed, CASE WHEN p_size > 25 THEN CAST(p_size + 1 AS VARCHAR) END AS fixed, lower(p_brand) AS severity FROM part",
    "src08_unused": "SELECT p_size AS report, p_brand AS file, 'exports' AS kind, p_name AS name, p_size AS line FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_size, p_brand, 'dependencies', p_name, p_size FROM part WHERE p_partkey % 3 = 0",
    "src10_modules": "SELECT DISTINCT p_brand AS report, p_name AS module FROM part WHERE p_size > 40 OR p_size < 5",
    "src11_outdated": "SELECT p_brand AS report, 'p' || p_partkey AS package, CAST(p_size AS VARCHAR) AS current, CASE WHEN p_size % 2 = 0 THEN '7' ELSE CAST(p_size AS VARCHAR) END AS wanted, '9' AS latest FROM part",
    "src13_outdated_lines": "SELECT p_brand AS report, 'p' || p_partkey AS package, CAST(p_size AS VARCHAR) AS current, '9' AS latest FROM part",
    "src14_outdated_table": "SELECT p_brand AS report, 'p' || p_partkey AS package, CAST(p_size AS VARCHAR) AS current, '9' AS latest FROM part",
    "src18_lint": "SELECT p_brand AS report, 'delivery.dockerfile.DL' || p_partkey AS rule, 'Dockerfile' AS file, p_size AS line, CASE WHEN p_size > 30 THEN 'medium' WHEN p_size > 15 THEN 'low' ELSE 'info' END AS severity FROM part",
    "src27_unreadable": "SELECT event_id AS report, 0 AS length FROM events WHERE event_id % 5 >= 2",
    "src29_replies": "SELECT event_id AS report, ['ok', 'ok', 'empty', 'no-json', 'unterminated'][event_id % 5 + 1] AS state, CASE WHEN event_id % 5 <= 1 THEN event_type END AS answer FROM events",
}
