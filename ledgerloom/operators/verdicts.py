"""Decoding of replies about batches of units: what was answered, what is refused, and what is missing.

A reply is one JSON document a batch. It is read into rows of answers, checks, claims and citations;
everything after that is joins: with the units that were asked, the checks and rules that were
offered, and the lines that were shown. Nothing is thrown: a refusal is a row of `issues`.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scales import SEVERITIES, label_of, rank_of
from ledgerloom.functions.text import shortened
from ledgerloom.sources.views import table

# The longest texts that a claim may carry, and the results of a check.
LONGEST = {"title": 160, "description": 4000, "impact": 2000, "recommendation": 2000, "exploitability": 1000}
RESULTS = ("pass", "fail", "not-applicable")
ISSUES = (
    "unknown-unit", "duplicate-unit", "batch-id-mismatch", "missing-check", "unknown-check", "unexplained-not-applicable", "fail-without-finding", "unknown-rule",
    "citation-not-shown", "evidence-not-shown", "severity-clamped", "text-clamped",
)

_REF = "struct<file:string,line:int,stop:int>"
REPLY = (
    f"batch_id string, verdicts array<struct<unit_id:string,checks:map<string,string>,findings:array<struct<rule:string,severity:string,confidence:string,title:string,"
    f"description:string,impact:string,recommendation:string,exploitability:string,location:{_REF},evidence:array<{_REF}>>>>>"
)
_CHECK = f"result string, note string, evidence {_REF}"


class Replies(NamedTuple):
    """Replies as rows; `at` is the place of an answer in its reply, null in the one row of a reply without answers.

    answers(batch, echoed, at, unit_id, checks, claims): checks are an array of (check, result, note, file, line, stop), claims
    one of (n, rule, severity, confidence, location, evidence and the texts of LONGEST), places are (file, line, stop).
    given(batch, at, unit_id): the answers alone, read without their contents.
    """

    answers: DataFrame
    given: DataFrame


class Decoded(NamedTuple):
    verdicts: DataFrame
    findings: DataFrame
    issues: DataFrame
    batches: DataFrame


def read_replies(rows: DataFrame) -> Replies:
    """Rows of (batch, reply) read into tables; a reply that is no document answers nothing.

    A check is either its result alone or an object with result, note and evidence.
    """
    # Each reply is read once: what a generator gives is not computed again for every column.
    got = rows.select("batch", F.inline(F.array(F.from_json("reply", REPLY))))
    each = got.select("batch", F.col("batch_id").alias("echoed"), F.posexplode_outer("verdicts").alias("at", "v"))
    of = lambda e, bare, read: F.struct(
        e["key"].alias("check"), F.when(bare, e["value"]).otherwise(read["result"]).alias("result"), F.when(~bare, read["note"]).alias("note"), *[F.when(~bare, read["evidence"][c]).alias(c) for c in ("file", "line", "stop")])
    said = lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.when(~e["value"].startswith("{"), F.lit(None)).otherwise(F.from_json(e["value"], _CHECK)).alias("read"))
    checks = F.transform(F.transform(F.map_entries("v.checks"), said), lambda e: of(e, ~e["value"].startswith("{"), e["read"]))
    claims = F.transform("v.findings", lambda f, n: F.struct(n.alias("n"), *[f[c].alias(c) for c in ("rule", "severity", "confidence", "location", "evidence", *LONGEST)]))
    given = rows.select("batch", F.posexplode(F.from_json("reply", "verdicts array<struct<unit_id:string>>")["verdicts"]).alias("at", "v"))
    return Replies(each.select("batch", "echoed", "at", "v.unit_id", checks.alias("checks"), claims.alias("claims")), given.select("batch", "at", "v.unit_id"))


def _printed(x: Column, line: Column) -> Column:
    inside = (x["start"] <= line) & (line <= x["stop"])
    return inside & ~F.coalesce((x["cut_from"] <= line) & (line <= x["cut_to"]), F.lit(False))


def with_shown(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """Rows with (batch, file, line, stop), `shown` and `last`: whether the batch printed the line, and where its slice ends.

    slices has (batch, file, start, stop, cut_from, cut_to), of which the cut lines were not printed. A
    batch shows a bounded number of slices, so those of one file meet in one row and no pairs are made.
    A citation that runs past the slice is cut back to it.
    """
    held = slices.groupBy("batch", "file").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "cut_from", "cut_to"))).alias("__held"))
    rows = rows.join(held, ["batch", "file"], "left")
    shown = F.coalesce(F.exists("__held", lambda x: _printed(x, F.col("line"))), F.lit(False))
    extent = F.get(F.filter("__held", lambda x: (x["start"] <= F.col("line")) & (F.col("line") <= x["stop"])), F.lit(0))["stop"]
    return rows.withColumn("shown", shown).withColumn("last", F.when(F.col("stop") > extent, F.greatest(F.col("line"), extent)).otherwise(F.col("stop"))).drop("__held")


def _with_places(answers: DataFrame, slices: DataFrame, texts: bool) -> DataFrame:
    """Answers whose checks, claims and evidence say whether their line was shown; of texts only which are too long, or the shortened ones.

    Long texts are let go before anything is shuffled. The slices of a batch meet its answers as one map by file.
    """
    text = lambda c: [F.filter(F.array(*[F.when(F.char_length(c[t]) > most, t) for t, most in LONGEST.items()]), lambda t: t.isNotNull()).alias("long"), *[shortened(c[t], most).alias(t) for t, most in LONGEST.items() if texts]]
    answers = answers.withColumn("claims", F.transform("claims", lambda c: F.struct(*[c[x].alias(x) for x in ("n", "rule", "severity", "confidence", "location", "evidence")], *text(c))))
    by_file = slices.where("file is not null").groupBy("batch", "file").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "cut_from", "cut_to"))).alias("held"))
    held = by_file.groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("file", "held"))).alias("__held"))
    of = lambda file: F.try_element_at("__held", file)
    shown = lambda p: F.coalesce(F.exists(of(p["file"]), lambda x: _printed(x, p["line"])), F.lit(False)).alias("shown")
    at = lambda p: F.concat_ws(":", p["file"], p["line"]).alias("place")

    def last(p):
        extent = F.get(F.filter(of(p["file"]), lambda x: (x["start"] <= p["line"]) & (p["line"] <= x["stop"])), F.lit(0))["stop"]
        return F.when(p["stop"] > extent, F.greatest(p["line"], extent)).otherwise(p["stop"]).alias("stop")

    checks = F.transform("checks", lambda c: F.struct(c["check"].alias("check"), c["result"].alias("result"), c["note"].isNotNull().alias("explained"), c["file"].isNotNull().alias("cites"), F.when(c["file"].isNotNull(), at(c)).alias("place"), shown(c)))
    shows = lambda e: F.struct(at(e), shown(e))
    more = lambda c: [c["n"].alias("n"), c["confidence"].alias("confidence"), c["location"]["file"].alias("file"), c["location"]["line"].alias("line"), last(c["location"]), *[c[t].alias(t) for t in LONGEST]]
    claims = F.transform("claims", lambda c: F.struct(c["rule"].alias("rule"), rank_of(c["severity"], SEVERITIES).alias("severity"), c["long"].alias("long"), at(c["location"]), shown(c["location"]), F.transform(c["evidence"], shows).alias("evidence"), *(more(c) if texts else [])))
    return answers.join(held, "batch", "left").select("batch", "echoed", "at", "unit_id", checks.alias("checks"), claims.alias("claims"))


def _offers(registry: DataFrame) -> DataFrame:
    """A row for each kind: the owed rule of each check, the ceiling of each rule, the checks that each domain owes."""
    as_map = lambda df, k, v, name: df.where(f"`kind` is not null and `{k}` is not null").groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct(k, v))).alias(name))
    offered = registry.select("kind", "domain", "check", "rule", rank_of(F.col("ceiling"), SEVERITIES).alias("cap"))
    checks = as_map(offered.groupBy("kind", "check").agg(F.min("rule").alias("rule")), "check", "rule", "permitted")
    rules = as_map(offered.groupBy("kind", "rule").agg(F.min("cap").alias("cap")), "rule", "cap", "caps")
    owed = as_map(offered.groupBy("kind", "domain").agg(F.collect_set("check").alias("checks")), "domain", "checks", "owed")
    return checks.join(rules, "kind", "full_outer").join(owed, "kind", "full_outer")


def decode(replies: Replies, asked: DataFrame, slices: DataFrame, registry: DataFrame) -> Decoded:
    """Verdicts, findings, issues and the account of every batch.

    asked has (batch, unit_id, kind, domain, place); registry has (kind, domain, check, rule, ceiling): the
    checks a prompt asks of a kind, the rule under which a failure is filed and its highest severity.
    Of several answers about a unit the first counts. A unit may answer any check of its kind; it owes
    those of its batch's domain. A claim stands if its rule is one of its kind's and its line was
    shown; its evidence is kept line by line, its severity lowered to the ceiling and its texts cut.
    Every unit asked is either answered or missing, in exactly one row of verdicts.

    An answer is judged as one row, which holds its checks and claims; replies are read once for each table.
    """
    key = ["batch", "unit_id"]
    units = asked.select(*key, "kind", "domain").dropDuplicates(key)
    order = F.row_number().over(Window.partitionBy(*key).orderBy("at"))
    offers = F.broadcast(_offers(registry))
    yes = lambda c: F.coalesce(c, F.lit(False))

    def judged(texts: bool) -> DataFrame:
        rows = _with_places(replies.answers, slices, texts).join(units, key, "left").withColumn("place_", order).join(offers, "kind", "left")
        # Only an answer that counts has checks and claims.
        counts = F.col("kind").isNotNull() & (F.col("place_") == 1) & F.col("at").isNotNull()
        known = lambda m, k: yes(F.map_contains_key(m, k)).alias("known")
        checks = F.transform("checks", lambda c: c.withField("known", known("permitted", c["check"])).withField("owed_rule", F.try_element_at("permitted", c["check"])))
        claims = F.transform("claims", lambda c: c.withField("known", known("caps", c["rule"])).withField("lowered", F.greatest(c["severity"], F.try_element_at("caps", c["rule"]))))
        none = lambda c: F.coalesce(c, F.array())
        rows = rows.withColumn("accepted", counts).withColumns({"checks": none(F.when(F.col("accepted"), checks)), "claims": none(F.when(F.col("accepted"), claims))})
        rows = rows.withColumns({"stands": F.filter("claims", lambda c: c["known"] & c["shown"]), "answered": F.filter("checks", lambda c: c["known"])})
        return rows.withColumn("missing", F.when(F.col("accepted"), none(F.array_except(F.try_element_at("owed", F.col("domain")), F.transform("answered", lambda c: c["check"])))).otherwise(F.array()))

    findings = judged(True).select("batch", "unit_id", "kind", F.inline("stands")).select(
        "batch", "unit_id", "kind", "n", "rule", label_of(F.col("lowered"), SEVERITIES).alias("severity"), "confidence", "file", "line", "stop", *LONGEST,
        F.coalesce(F.size(F.filter("evidence", lambda e: e["shown"])), F.lit(0)).cast("long").alias("evidence"), F.coalesce(F.size(F.filter("evidence", lambda e: ~e["shown"])), F.lit(0)).cast("long").alias("evidence_dropped"),
    )

    hit = lambda when, issue, subject: F.when(when, F.struct(F.lit(issue).alias("issue"), subject.cast("string").alias("subject")))
    rows = judged(False)
    given = F.col("at").isNotNull()
    of_answer = F.array(
        hit(given & F.col("kind").isNull(), "unknown-unit", F.col("unit_id")), hit(given & F.col("kind").isNotNull() & (F.col("place_") > 1), "duplicate-unit", F.col("at")),
        # Of a reply, so at its first row.
        hit((F.coalesce("at", F.lit(0)) == 0) & (F.col("echoed") != F.col("batch").cast("string")), "batch-id-mismatch", F.col("echoed")),
    )
    filed = F.transform("stands", lambda c: c["rule"])
    of_check = lambda c: F.array(
        hit(~c["known"], "unknown-check", c["check"]), hit(c["known"] & (c["result"] == "not-applicable") & ~c["explained"], "unexplained-not-applicable", c["check"]),
        hit(c["known"] & c["cites"] & ~c["shown"], "evidence-not-shown", c["place"]),
        hit(c["known"] & (c["result"] == "fail") & c["owed_rule"].isNotNull() & ~F.array_contains(filed, c["owed_rule"]), "fail-without-finding", c["check"]),
    )
    stands = lambda c: c["known"] & c["shown"]
    of_claim = lambda c: F.concat(
        F.array(hit(~c["known"], "unknown-rule", c["rule"]), hit(c["known"] & ~c["shown"], "citation-not-shown", c["place"]), hit(stands(c) & (c["lowered"] > c["severity"]), "severity-clamped", c["rule"])),
        F.when(stands(c), F.transform(c["long"], lambda t: hit(F.lit(True), "text-clamped", t))).otherwise(F.array()),
        F.coalesce(F.when(stands(c), F.transform(c["evidence"], lambda e: hit(~e["shown"], "evidence-not-shown", e["place"]))), F.array()),
    )
    found = F.concat(of_answer, F.transform("missing", lambda m: hit(F.lit(True), "missing-check", m)), F.flatten(F.transform("checks", of_check)), F.flatten(F.transform("claims", of_claim)))
    issues = rows.select("batch", F.col("unit_id").alias("__unit"), F.inline(F.array_compact(found)))
    issues = issues.select("batch", F.when(F.col("issue") != "batch-id-mismatch", F.col("__unit")).alias("unit_id"), "issue", "subject")

    n = lambda c: F.size(c).cast("long")
    said = rows.where("accepted").select(*key, F.lit(True).alias("answered"), n("answered").alias("checks"), n(F.filter("answered", lambda c: c["result"] == "pass")).alias("passed"), n("missing").alias("missing_checks"), n("stands").alias("findings"))
    verdicts = units.join(said, key, "left").na.fill(0, ["checks", "passed", "missing_checks", "findings"]).na.fill(False, ["answered"])
    status = F.when(~F.col("answered"), "no-verdict").when(F.col("findings") > 0, "flagged").when(F.col("missing_checks") > 0, "inconclusive").otherwise("clean")
    verdicts = verdicts.withColumns({"complete": F.col("answered") & (F.col("missing_checks") == 0), "status": status})

    # The account needs no contents of answers.
    placed = replies.given.join(units, key, "left").withColumn("place_", order)
    known = F.col("kind").isNotNull()
    per_reply = placed.groupBy("batch").agg(F.count("*").alias("replied"), F.count_if(~known).alias("unknown"), F.count_if(known & (F.col("place_") > 1)).alias("duplicate"), F.count_if(known & (F.col("place_") == 1)).alias("accepted"))
    counts = ["asked", "accepted", "missing", "replied", "unknown", "duplicate"]
    batches = units.groupBy("batch").agg(F.count("*").alias("asked")).join(per_reply, "batch", "full_outer").na.fill(0, ["asked", "accepted", "replied", "unknown", "duplicate"])
    return Decoded(verdicts, findings, issues, batches.withColumn("missing", F.col("asked") - F.col("accepted")).select("batch", *counts))


# --- The star schema as replies: orders are units, their lines are checks and claims.
KINDS, _DOMAINS = ("route", "data-access", "sink"), ("appsec", "api")
# Each kind's checks by domain, with the rule of a failure and its ceiling.
REGISTRY = [
    (kind, domain, f"{domain}.check-{n}", f"{domain}.rule-{n}", ceiling)
    for i, kind in enumerate(KINDS) for j, domain in enumerate(_DOMAINS)
    for n, ceiling in ((1, "critical"), (2, "medium"), (3, "high"), (4 + i, "low")) if n != 3 or j == 0
]

# The same projections for both engines, which differ in the name of the text type.
_LINE = """(SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey, floor(max(l_quantity)) AS l_quantity, max(l_tax) AS l_tax, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber) t"""
VIEWS = {
    "asked": """SELECT CAST(floor(o_orderkey / 64) AS BIGINT) AS batch, o_orderkey AS unit_id, CASE CAST(floor(o_orderkey / 64) AS BIGINT) % 3 WHEN 0 THEN 'route' WHEN 1 THEN 'data-access' ELSE 'sink' END AS kind,
 CASE CAST(floor(o_orderkey / 64) AS BIGINT) % 2 WHEN 0 THEN 'appsec' ELSE 'api' END AS domain, CAST(o_orderkey % 64 AS INT) AS place FROM orders""",
    "echo": "SELECT DISTINCT CAST(floor(o_orderkey / 64) AS BIGINT) AS batch, CASE WHEN CAST(floor(o_orderkey / 64) AS BIGINT) % 7 = 3 THEN CAST(floor(o_orderkey / 64) AS BIGINT) + 1 WHEN CAST(floor(o_orderkey / 64) AS BIGINT) % 5 = 0 THEN NULL ELSE CAST(floor(o_orderkey / 64) AS BIGINT) END AS echoed FROM orders",
    "answer": """SELECT CAST(floor(o_orderkey / 64) AS BIGINT) AS batch, CAST(o_orderkey % 64 AS INT) AS seq, CASE WHEN o_custkey % 29 = 0 THEN -o_orderkey ELSE o_orderkey END AS unit_id FROM orders WHERE o_orderstatus <> 'P'
 UNION ALL SELECT CAST(floor(o_orderkey / 64) AS BIGINT), CAST(64 + o_orderkey % 64 AS INT), o_orderkey FROM orders WHERE o_custkey % 17 = 0""",
    "check": """SELECT CAST(floor(l_orderkey / 64) AS BIGINT) AS batch, CAST(l_orderkey % 64 AS INT) AS seq, concat(CASE WHEN l_suppkey % 4 = 0 THEN 'api' ELSE 'appsec' END, '.check-', CAST(l_linenumber AS {text})) AS `check`,
 CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'fail' ELSE 'not-applicable' END AS result, CASE WHEN l_partkey % 3 = 0 THEN 'because' END AS note,
 CASE WHEN l_partkey % 2 = 0 THEN concat('s', CAST(l_suppkey % 3 AS {text})) END AS file, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_quantity AS INT) END AS line, CAST(NULL AS INT) AS stop FROM {line}""",
    "claim": """SELECT CAST(floor(l_orderkey / 64) AS BIGINT) AS batch, CAST(l_orderkey % 64 AS INT) AS seq, CAST(l_linenumber AS INT) AS num, concat(CASE WHEN l_suppkey % 4 = 0 THEN 'api' ELSE 'appsec' END, '.rule-', CAST(l_linenumber AS {text})) AS rule,
 CASE l_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity, CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END AS confidence,
 concat('s', CAST(l_suppkey % 3 AS {text})) AS file, CAST(l_quantity AS INT) AS line, CAST(l_quantity + l_partkey % 20 AS INT) AS stop, repeat('title ', CAST(20 + l_partkey % 10 AS INT)) AS title, repeat('d', CAST(3990 + l_partkey % 20 AS INT)) AS description, 'impact' AS impact,
 'change it' AS recommendation, CASE WHEN l_partkey % 5 = 0 THEN repeat('x', 1001) END AS exploitability FROM {line} WHERE l_returnflag = 'R'""",
    "citation": """SELECT CAST(floor(l_orderkey / 64) AS BIGINT) AS batch, CAST(l_orderkey % 64 AS INT) AS seq, CAST(l_linenumber AS INT) AS num, CAST(0 AS INT) AS place, concat('s', CAST(l_suppkey % 3 AS {text})) AS file, CAST(l_quantity + 1 AS INT) AS line, CAST(NULL AS INT) AS stop FROM {line} WHERE l_returnflag = 'R'
 UNION ALL SELECT CAST(floor(l_orderkey / 64) AS BIGINT), CAST(l_orderkey % 64 AS INT), CAST(l_linenumber AS INT), CAST(1 AS INT), concat('s', CAST(l_partkey % 5 AS {text})), CAST(l_linenumber * 7 AS INT), CAST(NULL AS INT) FROM {line} WHERE l_returnflag = 'R' AND l_partkey % 2 = 1""",
    "slice": """SELECT CAST(floor(o_orderkey / 64) AS BIGINT) AS batch, concat('s', CAST(o_custkey % 3 AS {text})) AS file, CAST(o_orderkey % 40 AS INT) AS start, CAST(o_orderkey % 40 + 12 AS INT) AS stop,
 CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey % 40 + 4 AS INT) END AS cut_from, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey % 40 + 7 AS INT) END AS cut_to FROM orders""",
}


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace("{text}", "STRING").replace("{line}", _LINE)
    source = "lineitem" if "FROM lineitem" in sql else "orders"
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))


def _projected(view: str, branch: int = 0) -> tuple[str, str]:
    """Columns and condition of a view over lines, for a line in a lambda variable t."""
    columns, where = re.fullmatch(r"\s*SELECT (.*) FROM \{line\}(?: WHERE (.*))?\s*", VIEWS[view].split("UNION ALL")[branch], re.DOTALL).groups()
    return tuple(re.sub(r"\bl_", "t.l_", x or "true").replace("{text}", "STRING") for x in (columns, where))


def reply_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text a batch, from the views: the input of read_replies().

    Lines and answers are dealt by batch once, as numbers; texts are made of the lines of a batch, after that.
    """
    columns = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_tax", "l_returnflag"]
    place = [F.expr("CAST(floor(l_orderkey / 64) AS BIGINT)").alias("batch"), F.expr("CAST(l_orderkey % 64 AS INT)").alias("seq")]
    lines = table(spark, sf_dir, "lineitem").select(*place, *columns)
    rows = lines.unionByName(_view(spark, sf_dir, "answer"), allowMissingColumns=True).where("batch is not null").repartition("batch")
    # A line as in the views: the greatest of each column.
    once = rows.groupBy("batch", "seq", "l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in columns[2:]], F.collect_list("unit_id").alias("units"))
    line = F.struct("l_linenumber", "l_orderkey", "l_suppkey", "l_partkey", F.floor("l_quantity").alias("l_quantity"), "l_tax", "l_returnflag")
    answers = once.groupBy("batch", "seq").agg(F.array_sort(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), line))).alias("lines"), F.array_sort(F.flatten(F.collect_list("units"))).alias("units"))
    whole = answers.where(F.size("units") > 0).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("seq", "units", "lines"))).alias("v")).join(_view(spark, sf_dir, "echo"), "batch")
    (check, _), (claim, claimed), *cites = _projected("check"), _projected("claim"), _projected("citation"), _projected("citation", 1)
    names = "place, file, line, stop".split(", ")
    evidence = ", ".join(f"CASE WHEN {where} THEN CAST(struct({cols}) AS struct<batch: bigint, seq: int, num: int, place: int, file: string, line: int, stop: int>) END" for cols, where in cites)
    cited = f"transform(array_compact(array({evidence})), e -> struct({', '.join(f'e.{c}' for c in names)}))"
    texts = ", ".join(f"f.c.{c}" for c in ("num", "rule", "severity", "confidence", *LONGEST))
    some = f"exists(x.lines, t -> {claimed})"
    verdict = f"""struct(CAST(u AS STRING) AS unit_id,
 map_from_entries(transform(CASE WHEN size(x.lines) > 0 THEN x.lines END, t -> named_struct('k', struct({check}).check, 'v', transform(array(struct({check})), c -> struct(c.result, c.note, CASE WHEN c.file IS NOT NULL THEN struct(c.file, c.line, c.stop) END AS evidence))[0]))) AS checks,
 CASE WHEN {some} THEN transform(transform(filter(x.lines, t -> {claimed}), t -> struct(struct({claim}) AS c, {cited} AS e)), f -> struct({texts}, struct(f.c.file, f.c.line, f.c.stop) AS location, f.e AS evidence)) END AS findings)"""
    verdicts = F.expr(f"flatten(transform(v, x -> transform(x.units, u -> {verdict})))").alias("verdicts")
    return whole.select("batch", F.to_json(F.struct(F.col("echoed").cast("string").alias("batch_id"), verdicts)).alias("reply"))


def decoded(spark: SparkSession, sf_dir: str) -> Decoded:
    # Units and batches are texts in a reply.
    asked = _view(spark, sf_dir, "asked").withColumns({"unit_id": F.col("unit_id").cast("string")})
    registry = spark.createDataFrame(REGISTRY, "kind string, domain string, check string, rule string, ceiling string")
    return decode(read_replies(reply_documents(spark, sf_dir)), asked, _view(spark, sf_dir, "slice"), registry)


_number = lambda: F.col("unit_id").cast("long").alias("unit_id")
QUERIES = {
    "rul14_issues": lambda s, d: decoded(s, d).issues.groupBy("batch", _number(), "issue", "subject").agg(F.count("*").alias("n")),
    "rul14_findings": lambda s, d: decoded(s, d).findings.select("batch", _number(), "rule", "severity", "line", "stop", F.char_length("title").alias("title"), F.char_length("description").alias("description"), F.char_length("exploitability").alias("exploitability"), "evidence", "evidence_dropped"),
    "join09_verdicts": lambda s, d: decoded(s, d).verdicts.select("batch", _number(), "kind", "domain", "checks", "passed", "missing_checks", "findings", "complete", "status"),
    "join09_batch_accounts": lambda s, d: decoded(s, d).batches,
    "flt08_shown_lines": lambda s, d: with_shown(_view(s, d, "claim").select("batch", "seq", "num", "file", "line", "stop"), _view(s, d, "slice")).select("batch", "seq", "num", "shown", "last"),
}

_SQL = {f"d_{n}": sql.replace("{text}", "VARCHAR").replace("`", '"').replace("{line}", _LINE) for n, sql in VIEWS.items()}
_SHOWN = "EXISTS (SELECT 1 FROM d_slice s WHERE s.batch = c.batch AND s.file = c.file AND c.line BETWEEN s.start AND s.stop AND NOT coalesce(c.line BETWEEN s.cut_from AND s.cut_to, false))"
_END = "(SELECT arg_min(s.stop, (s.start * 1000 + s.stop) * 1000 + coalesce(s.cut_from, -1)) FROM d_slice s WHERE s.batch = c.batch AND s.file = c.file AND c.line BETWEEN s.start AND s.stop)"
_RANKED = "CASE {} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_STEPS = _SQL | {
    "reg": "SELECT * FROM (VALUES " + ", ".join(str(r) for r in REGISTRY) + ') t(kind, "domain", "check", rule, ceiling)',
    "acc": "SELECT a.batch, a.seq, u.unit_id, u.kind, u.domain FROM d_answer a JOIN d_asked u ON u.batch = a.batch AND u.unit_id = a.unit_id QUALIFY row_number() OVER (PARTITION BY a.batch, a.unit_id ORDER BY a.seq) = 1",
    "chk": f'SELECT c.*, a.unit_id, a.kind, a.domain, {_SHOWN} AS shown, EXISTS (SELECT 1 FROM reg WHERE reg.kind = a.kind AND reg."check" = c."check") AS known FROM d_check c JOIN acc a USING (batch, seq)',
    "miss": 'SELECT a.batch, a.unit_id, reg."check" FROM acc a JOIN reg ON reg.kind = a.kind AND reg.domain = a.domain WHERE NOT EXISTS (SELECT 1 FROM chk k WHERE k.batch = a.batch AND k.unit_id = a.unit_id AND k."check" = reg."check")',
    "clm": f"SELECT c.*, a.unit_id, a.kind, {_SHOWN} AS shown, {_END} AS e, (SELECT min({_RANKED.format('ceiling')}) FROM reg WHERE reg.kind = a.kind AND reg.rule = c.rule) AS cap FROM d_claim c JOIN acc a USING (batch, seq)",
    "std": "SELECT * FROM clm WHERE cap IS NOT NULL AND shown",
    "cit": f"SELECT c.*, unit_id, {_SHOWN} AS shown FROM d_citation c JOIN (SELECT batch, seq, num, unit_id FROM std) USING (batch, seq, num)",
    "iss": f"""SELECT batch, unit_id, 'unknown-unit' AS issue, CAST(unit_id AS VARCHAR) AS subject FROM d_answer a WHERE NOT EXISTS (SELECT 1 FROM d_asked u WHERE u.batch = a.batch AND u.unit_id = a.unit_id)
 UNION ALL SELECT a.batch, a.unit_id, 'duplicate-unit', CAST(o.rank - 1 AS VARCHAR) FROM d_answer a JOIN d_asked u ON u.batch = a.batch AND u.unit_id = a.unit_id JOIN (SELECT batch, seq, row_number() OVER (PARTITION BY batch ORDER BY seq) AS rank FROM d_answer) o ON o.batch = a.batch AND o.seq = a.seq
   WHERE NOT EXISTS (SELECT 1 FROM acc WHERE acc.batch = a.batch AND acc.seq = a.seq)
 UNION ALL SELECT batch, NULL, 'batch-id-mismatch', CAST(echoed AS VARCHAR) FROM d_echo WHERE echoed <> batch UNION ALL SELECT batch, unit_id, 'missing-check', "check" FROM miss
 UNION ALL SELECT batch, unit_id, 'unknown-check', "check" FROM chk WHERE NOT known UNION ALL SELECT batch, unit_id, 'unexplained-not-applicable', "check" FROM chk WHERE known AND result = 'not-applicable' AND note IS NULL
 UNION ALL SELECT batch, unit_id, 'fail-without-finding', "check" FROM chk k WHERE known AND result = 'fail' AND NOT EXISTS (SELECT 1 FROM std s WHERE s.batch = k.batch AND s.unit_id = k.unit_id AND s.rule = replace(k."check", 'check', 'rule'))
 UNION ALL SELECT batch, unit_id, 'unknown-rule', rule FROM clm WHERE cap IS NULL UNION ALL SELECT batch, unit_id, 'citation-not-shown', file || ':' || line FROM clm WHERE cap IS NOT NULL AND NOT shown
 UNION ALL SELECT batch, unit_id, 'evidence-not-shown', file || ':' || line FROM chk WHERE known AND file IS NOT NULL AND NOT shown UNION ALL SELECT batch, unit_id, 'evidence-not-shown', file || ':' || line FROM cit WHERE NOT shown
 UNION ALL SELECT batch, unit_id, 'severity-clamped', rule FROM std WHERE {_RANKED.format("severity")} < cap UNION ALL SELECT batch, unit_id, 'text-clamped', 'title' FROM std WHERE len(title) > 160
 UNION ALL SELECT batch, unit_id, 'text-clamped', 'description' FROM std WHERE len(description) > 4000 UNION ALL SELECT batch, unit_id, 'text-clamped', 'exploitability' FROM std WHERE len(exploitability) > 1000""",
    "ver": """SELECT u.batch, u.unit_id, u.kind, u.domain, coalesce(c.checks, 0) AS checks, coalesce(c.passed, 0) AS passed, coalesce(m.n, 0) AS missing_checks, coalesce(f.n, 0) AS findings, a.unit_id IS NOT NULL AS answered
 FROM d_asked u LEFT JOIN acc a ON a.batch = u.batch AND a.unit_id = u.unit_id LEFT JOIN (SELECT batch, unit_id, count(*) AS checks, count(*) FILTER (result = 'pass') AS passed FROM chk WHERE known GROUP BY ALL) c ON c.batch = u.batch AND c.unit_id = u.unit_id
 LEFT JOIN (SELECT batch, unit_id, count(*) AS n FROM miss GROUP BY ALL) m ON m.batch = u.batch AND m.unit_id = u.unit_id LEFT JOIN (SELECT batch, unit_id, count(*) AS n FROM std GROUP BY ALL) f ON f.batch = u.batch AND f.unit_id = u.unit_id""",
}


def _twin(body: str, *names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in _STEPS.items() if not names or n in names) + "\n" + body


ORACLES = {
    "rul14_issues": _twin("SELECT batch, unit_id, issue, subject, count(*) AS n FROM iss GROUP BY ALL"),
    "rul14_findings": _twin(
        f"""SELECT batch, unit_id, rule, ['critical', 'high', 'medium', 'low', 'info'][greatest({_RANKED.format("severity")}, cap) + 1] AS severity, line, CASE WHEN stop > e THEN greatest(line, e) ELSE stop END AS stop, least(len(title), 160)::INTEGER AS title,
 least(len(description), 4000)::INTEGER AS description, CASE WHEN exploitability IS NOT NULL THEN least(len(exploitability), 1000)::INTEGER END AS exploitability, coalesce(a, 0) AS evidence, coalesce(b, 0) AS evidence_dropped FROM std LEFT JOIN (SELECT batch, seq, num, count(*) FILTER (shown) AS a, count(*) FILTER (NOT shown) AS b FROM cit GROUP BY ALL) USING (batch, seq, num)"""),
    "join09_verdicts": _twin("SELECT batch, unit_id, kind, domain, checks, passed, missing_checks, findings, answered AND missing_checks = 0 AS complete, CASE WHEN NOT answered THEN 'no-verdict' WHEN findings > 0 THEN 'flagged' WHEN missing_checks > 0 THEN 'inconclusive' ELSE 'clean' END AS status FROM ver"),
    "join09_batch_accounts": _twin("SELECT v.*, coalesce(r.replied, 0) AS replied, coalesce(i.unknown, 0) AS unknown, coalesce(i.duplicate, 0) AS duplicate FROM (SELECT batch, count(*) AS asked, count(*) FILTER (answered) AS accepted, count(*) FILTER (NOT answered) AS missing FROM ver GROUP BY batch) v LEFT JOIN (SELECT batch, count(*) AS replied FROM d_answer GROUP BY batch) r USING (batch) LEFT JOIN (SELECT batch, count(*) FILTER (issue = 'unknown-unit') AS unknown, count(*) FILTER (issue = 'duplicate-unit') AS duplicate FROM iss GROUP BY batch) i USING (batch)"),
    "flt08_shown_lines": _twin(f"SELECT batch, seq, num, {_SHOWN} AS shown, CASE WHEN stop > {_END} THEN greatest(line, {_END}) ELSE stop END AS last FROM d_claim c", "d_claim", "d_slice"),
}
