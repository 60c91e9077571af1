"""Findings from dependency reports: vulnerabilities, misconfigurations, licences and where they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scales import lookup
from ledgerloom.operators.grading import tool_severity
from ledgerloom.operators.scalars import applicable_fix
from ledgerloom.sources.samples import over, sample

# Families of copyleft licences with their severity, the first that matches decides; rules of configuration files.
COPYLEFT = (("AGPL", r"(?i)\bAGPL\b", "low"), ("LGPL", r"(?i)\bLGPL\b", "info"), ("GPL", r"(?i)\bGPL\b", "low"))
PERMISSIVE = r"(?i)\b(MIT|BSD|Apache|ISC|Zlib|Unlicense)\b"
CONFIG_RULES = {"dockerfile": "delivery.dockerfile-misconfiguration", "terraform": "delivery.iac-misconfiguration", "kubernetes": "delivery.kubernetes-misconfiguration"}

REPORT = (
    "struct<Results:array<struct<Target:string,Vulnerabilities:array<struct<Seq:long,VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,"
    "Severity:string,PkgPath:string,CVSS:map<string,struct<V3Score:double>>>>>>>"
)
SBOM = (
    "struct<components:array<struct<seq:long,type:string,group:string,name:string,version:string,"
    "licenses:array<struct<expression:string,license:struct<id:string,name:string>>>>>>"
)


def nul_id(*parts: Column) -> Column:
    """Id of a dependency report's finding: parts joined by NUL."""
    joined = F.concat(*[x for p in parts for x in (p, F.lit("\0"))][:-1])
    return F.substring(F.sha2(joined, 256), 1, 16)


def read_advisories(reports: DataFrame) -> DataFrame:
    """Vulnerabilities of nested reports (report, body), with scores by source; a report that isn't valid gives none."""
    rows = reports.withColumn("doc", F.from_json("body", REPORT)).select("report", F.explode("doc.Results").alias("r"))
    rows = rows.select("report", F.col("r.Target").alias("target"), F.explode("r.Vulnerabilities").alias("v"))
    score = lambda s: F.col("v.CVSS")[s]["V3Score"]
    return rows.select(
        "report", "target", F.col("v.Seq").alias("seq"), F.col("v.VulnerabilityID").alias("cve"), F.col("v.PkgName").alias("package"), F.col("v.InstalledVersion").alias("installed"),
        F.col("v.FixedVersion").alias("fixed"), F.col("v.Severity").alias("severity"), F.col("v.PkgPath").alias("path"), score("nvd").alias("nvd"), score("ghsa").alias("ghsa"),
    )


def with_directness(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """Packages that a manifest declares are direct, its others transitive; without a manifest it is unknown.

    declared has (report, target, package, section); a package in two sections counts as runtime.
    """
    rank = F.when(F.col("section") == "runtime", 0).when(F.col("section") == "dev", 1)
    own = declared.groupBy("report", "target", "package").agg(F.min(rank).alias("__own"))
    manifests = declared.select("report", "target").distinct().withColumn("__manifest", F.lit(True))
    got = rows.join(own, ["report", "target", "package"], "left").join(manifests, ["report", "target"], "left")
    direct = F.when(F.col("__own") == 0, "direct").when(F.col("__own") == 1, "direct-dev").when(F.col("__manifest"), "transitive").otherwise("unknown")
    return got.withColumn("directness", direct).drop("__own", "__manifest")


def vulnerability_findings(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """One finding an advisory and package: id, severity, directness, the fix that applies and the score of the preferred source."""
    rows = with_directness(rows, declared)
    rows = rows.withColumn("file", F.coalesce("path", "target")).withColumn("coordinates", F.concat("package", F.lit("@"), F.coalesce("installed", F.lit("unknown"))))
    score = F.when(F.col("nvd").isNotNull(), F.concat(F.lit("CVSS "), F.col("nvd"), F.lit(" (nvd)"))).when(F.col("ghsa").isNotNull(), F.concat(F.lit("CVSS "), F.col("ghsa"), F.lit(" (ghsa)")))
    return rows.select(
        "report", "seq", nul_id(F.lit("dependencies"), F.lit("dependencies.vulnerable-package"), F.col("file"), F.concat("coordinates", F.lit(":"), "cve")).alias("id"), "file",
        tool_severity(F.lit("trivy"), F.col("severity")).alias("severity"), F.concat("cve", F.lit(" in "), "coordinates").alias("title"), "directness",
        F.when(F.coalesce("fixed", F.lit("")) != "", applicable_fix(F.col("fixed"), F.col("installed"))).alias("fix"), score.alias("score"),
    )


def misconfiguration_findings(rows: DataFrame) -> DataFrame:
    """Failed checks of configuration files; a line below 1 is the first, a check that passed gives nothing."""
    kept = rows.where(F.upper(F.coalesce("status", F.lit("FAIL"))) == "FAIL").withColumn("at", F.when(F.col("line") >= 1, F.col("line")).otherwise(F.lit(1)))
    rule = F.coalesce(lookup(F.lower("type"), CONFIG_RULES), F.lit("delivery.iac-misconfiguration"))
    kept = kept.withColumn("rule", rule)
    return kept.select(
        "seq", "rule", nul_id(F.lit("delivery"), F.col("rule"), F.col("target"), F.concat("check", F.lit(":"), F.coalesce("resource", F.col("at").cast("string")))).alias("id"), "target",
        F.col("at").alias("line"), tool_severity(F.lit("trivy"), F.col("severity")).alias("severity"), F.concat("check", F.lit(": "), F.coalesce("title", "check")).alias("title"),
    )


def read_components(reports: DataFrame) -> DataFrame:
    """Components of SBOMs with group and all declared licences joined by AND; null where none is declared."""
    rows = reports.withColumn("doc", F.from_json("body", SBOM)).select("report", F.explode("doc.components").alias("c"))
    each = F.transform(F.coalesce("c.licenses", F.array().cast("array<struct<expression:string,license:struct<id:string,name:string>>>")), lambda x: F.trim(F.coalesce(x["expression"], x["license"]["id"], x["license"]["name"])))
    name = F.when(F.coalesce(F.trim("c.group"), F.lit("")) != "", F.concat("c.group", F.lit("/"), "c.name")).otherwise(F.col("c.name"))
    licence = F.nullif(F.array_join(F.filter(each, lambda x: x.isNotNull() & (x != "")), " AND "), F.lit(""))
    return rows.select("report", "c.seq", "c.type", name.alias("component"), F.concat("c.name", F.lit("@"), F.coalesce("c.version", F.lit("unknown"))).alias("key"), "c.version", licence.alias("license"))


def license_findings(components: DataFrame, locations: DataFrame) -> DataFrame:
    """Libraries under a copyleft licence, at the place of their package; else at the report's only application.

    A licence that also offers a permissive one is information. A library without any place is left out.
    locations has (report, package, file, line), package being name@version; of several places the first line counts.
    """
    place = locations.groupBy("report", F.col("package").alias("key")).agg(F.min(F.struct("line", "file")).alias("__at"))
    only = components.where("type = 'application'").groupBy("report").agg(F.count("*").alias("__n"), F.first("component").alias("__app")).where("__n = 1").drop("__n")
    rows = components.where("type = 'library' and license is not null").join(place, ["report", "key"], "left").join(only, "report", "left")
    family, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, grade in reversed(COPYLEFT):
        family = F.when(F.col("license").rlike(pattern), name).otherwise(family)
        severity = F.when(F.col("license").rlike(pattern), grade).otherwise(severity)
    permissive = F.col("license").rlike(r"(?i)\bOR\b") & F.col("license").rlike(PERMISSIVE)
    rows = rows.withColumns({"family": family, "file": F.coalesce("__at.file", "__app"), "line": F.coalesce("__at.line", F.lit(1))})
    return rows.where("family is not null and file is not null").select("report", "seq", "component", "license", "family", F.when(permissive, "info").otherwise(severity).alias("severity"), "file", "line")


def unknown_licences(components: DataFrame, listed: int = 3) -> DataFrame:
    """One row a report for all libraries without a licence: their number, the number of all, the first names."""
    libraries = components.where("type = 'library'")
    total = libraries.groupBy("report").agg(F.count("*").alias("libraries"), F.count_if(F.col("license").isNull()).alias("unknown")).where("unknown > 0")
    from ledgerloom.operators.facts import with_first

    names = libraries.where("license is null").select("report", "component").distinct()
    return with_first(total, names, ["report"], ["component"], "component", listed, "listed")


def _reports(s, d):
    v = sample(s, d, "advisory")
    scores = F.map_filter(F.create_map(F.lit("nvd"), F.struct(F.col("nvd").alias("V3Score")), F.lit("ghsa"), F.struct(F.col("ghsa").alias("V3Score"))), lambda _, x: x["V3Score"].isNotNull())
    one = F.struct(F.col("seq").alias("Seq"), F.col("cve").alias("VulnerabilityID"), F.col("package").alias("PkgName"), F.col("installed").alias("InstalledVersion"), F.col("fixed").alias("FixedVersion"), F.col("severity").alias("Severity"), F.col("path").alias("PkgPath"), scores.alias("CVSS"))
    by = v.groupBy("report", "target").agg(F.collect_list(one).alias("Vulnerabilities")).groupBy("report").agg(F.collect_list(F.struct(F.col("target").alias("Target"), "Vulnerabilities")).alias("Results"))
    return by.select("report", F.to_json(F.struct("Results")).alias("body"))


def _sboms(s, d):
    c = sample(s, d, "component")
    licences = F.when(F.col("license").isNotNull(), F.array(F.when(F.contains("license", F.lit(" OR ")), F.struct(F.col("license").alias("expression"), F.lit(None).cast("struct<id:string,name:string>").alias("license"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("expression"), F.struct(F.col("license").alias("id"), F.lit(None).cast("string").alias("name")).alias("license")))))
    one = F.struct("seq", "type", F.col("scope").alias("group"), "name", "version", licences.alias("licenses"))
    return c.groupBy("report").agg(F.collect_list(one).alias("components")).select("report", F.to_json(F.struct("components")).alias("body"))


QUERIES = {
    "src06_advisories": lambda s, d: read_advisories(_reports(s, d)).drop("target"),
    "src07_components": lambda s, d: read_components(_sboms(s, d)),
    "join20_directness": lambda s, d: with_directness(sample(s, d, "advisory"), sample(s, d, "declared").where("target = 'package-lock.json'")).groupBy("report", "directness").agg(F.count("*").alias("n")),
    "rul09_vulnerability_findings": lambda s, d: vulnerability_findings(read_advisories(_reports(s, d)), sample(s, d, "declared")),
    "rul10_misconfiguration_findings": lambda s, d: misconfiguration_findings(sample(s, d, "misconfiguration")),
    "join19_license_findings": lambda s, d: license_findings(read_components(_sboms(s, d)), sample(s, d, "location")),
    "agg41_unknown_licences": lambda s, d: unknown_licences(read_components(_sboms(s, d))),
}
_RANK = "CASE section WHEN 'runtime' THEN 0 WHEN 'dev' THEN 1 END"
_DIRECT = """SELECT a.*, CASE WHEN o.r = 0 THEN 'direct' WHEN o.r = 1 THEN 'direct-dev' WHEN EXISTS (SELECT 1 FROM decl m WHERE m.report = a.report AND m.target = a.target) THEN 'transitive' ELSE 'unknown' END AS directness
 FROM s_advisory a LEFT JOIN (SELECT report, target, package, min({}) AS r FROM decl GROUP BY ALL) o USING (report, target, package)""".format(_RANK)
_KEY = "CASE WHEN regexp_matches(trim({0}), '^[0-9.]+$') THEN list_transform(string_split(trim({0}), '.'), lambda x: CAST(x AS INTEGER)) END"
_FIX = """CASE WHEN len(e) = 1 THEN e[1] ELSE coalesce(CASE WHEN installed IS NOT NULL THEN (SELECT arg_min(t, k) FROM (SELECT unnest(e) AS t, {0} AS k) WHERE k > {1}) END, (SELECT arg_max(t, k) FROM (SELECT unnest(e) AS t, {0} AS k))) END""".format(
    _KEY.format("t"), _KEY.format("installed")
)
_SEV = "CASE lower(trim(severity)) WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' WHEN 'low' THEN 'low' ELSE 'info' END"
_COMP = "SELECT report, seq, type, CASE WHEN scope IS NOT NULL THEN scope || '/' || name ELSE name END AS component, name || '@' || coalesce(version, 'unknown') AS key, version, nullif(license, '') AS license FROM s_component"
ORACLES = {
    "src06_advisories": over("SELECT * EXCLUDE (target) FROM s_advisory", "advisory"),
    "src07_components": over(_COMP, "component"),
    "join20_directness": over("SELECT report, directness, count(*) AS n FROM direct GROUP BY ALL", "advisory", "declared", decl="SELECT * FROM s_declared WHERE target = 'package-lock.json'", direct=_DIRECT),
    "rul09_vulnerability_findings": over(
        f"""SELECT report, seq, substr(sha256('dependencies' || chr(0) || 'dependencies.vulnerable-package' || chr(0) || file || chr(0) || co || ':' || cve), 1, 16) AS id, file, {_SEV} AS severity, cve || ' in ' || co AS title, directness,
 CASE WHEN coalesce(fixed, '') <> '' THEN {_FIX} END AS fix, CASE WHEN nvd IS NOT NULL THEN 'CVSS ' || nvd || ' (nvd)' WHEN ghsa IS NOT NULL THEN 'CVSS ' || ghsa || ' (ghsa)' END AS score FROM
 (SELECT *, coalesce(path, target) AS file, package || '@' || coalesce(installed, 'unknown') AS co, list_transform(string_split(fixed, ','), lambda x: trim(x)) AS e FROM direct)""", "advisory", "declared", decl="SELECT * FROM s_declared", direct=_DIRECT),
    "rul10_misconfiguration_findings": over(
        f"""SELECT seq, rule, substr(sha256('delivery' || chr(0) || rule || chr(0) || target || chr(0) || "check" || ':' || coalesce(resource, CAST(ln AS VARCHAR))), 1, 16) AS id, target, ln AS line, {_SEV} AS severity, "check" || ': ' || coalesce(title, "check") AS title FROM
 (SELECT *, CASE WHEN line >= 1 THEN line ELSE 1 END AS ln, CASE type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONFIG_RULES.items())} END AS rule FROM s_misconfiguration WHERE upper(coalesce(status, 'FAIL')) = 'FAIL')""", "misconfiguration"),
    "join19_license_findings": over(
        """SELECT * FROM (SELECT report, seq, component, license, family, CASE WHEN regexp_matches(license, '\\bOR\\b') AND contains(license, 'MIT') THEN 'info' WHEN family = 'LGPL' THEN 'info' ELSE 'low' END AS severity, coalesce(p.file, app) AS file, coalesce(p.line, 1) AS line FROM
 (SELECT *, CASE WHEN regexp_matches(license, '\\bAGPL\\b') THEN 'AGPL' WHEN regexp_matches(license, '\\bLGPL\\b') THEN 'LGPL' WHEN regexp_matches(license, '\\bGPL\\b') THEN 'GPL' END AS family FROM comp WHERE type = 'library')
 LEFT JOIN (SELECT report, package AS key, min(line) AS line, arg_min(file, line) AS file FROM s_location GROUP BY ALL) p USING (report, key)
 LEFT JOIN (SELECT report, any_value(component) AS app FROM comp WHERE type = 'application' GROUP BY report HAVING count(*) = 1) USING (report) WHERE family IS NOT NULL) WHERE file IS NOT NULL""", "component", "location", comp=_COMP),
    "agg41_unknown_licences": over(
        "SELECT report, count(*) AS libraries, count(*) FILTER (license IS NULL) AS unknown, array_to_string(list_sort(list(DISTINCT component) FILTER (license IS NULL))[1:3], ',') AS listed FROM comp WHERE type = 'library' GROUP BY report HAVING count(*) FILTER (license IS NULL) > 0", "component", comp=_COMP),
}
