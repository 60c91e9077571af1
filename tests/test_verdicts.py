"""Decoding of replies: every kind of issue on rows written by hand."""

import json

import pytest

from ledgerloom.operators import verdicts

ASKED = [("b1", "u1", "route", "appsec", 0), ("b1", "u2", "route", "appsec", 1), ("b1", "u3", "route", "appsec", 2), ("b2", "u1", "route", "api", 0), ("b3", "u9", "sink", "appsec", 0), ("b4", "u4", "route", "api", 0)]
# Lines 10 to 40 of a.ts but for 20 to 29, and 5 to 9 of b.ts.
SLICES = [("b1", "a.ts", 10, 40, 20, 29), ("b1", "b.ts", 5, 9, None, None), ("b2", "a.ts", 1, 5, None, None)]
REGISTRY = [
    ("route", "appsec", "auth", "no-auth", "high"), ("route", "appsec", "idor", "idor", "critical"), ("route", "api", "paging", "unpaged", "medium"), ("sink", "appsec", "escape", "xss", "high"),
]


def claim(rule, line, severity="medium", evidence=(), stop=None, file="a.ts", **texts):
    cited = [{"file": f, "line": n} for f, n in evidence]
    return {"rule": rule, "severity": severity, "confidence": "high", "title": "t", "description": "d", "impact": "i", "recommendation": "r", "location": {"file": file, "line": line, "stop": stop}, "evidence": cited} | texts


@pytest.fixture(scope="module")
def decoded(spark):
    replies = [
        ("b1", {"batch_id": "b7", "verdicts": [
            {"unit_id": "u1", "checks": {"auth": "fail", "idor": {"result": "not-applicable"}, "made-up": "pass", "paging": {"result": "pass", "evidence": {"file": "a.ts", "line": 25}}},
             "findings": [claim("made.up", 12), claim("idor", 25), claim("idor", 12, "critical", [("a.ts", 11), ("a.ts", 22), ("c.ts", 1)], stop=50, title="t" * 161), claim("idor", 41)]},
            {"unit_id": "ghost", "checks": {"auth": "pass"}, "findings": [claim("no-auth", 12)]},
            {"unit_id": "u2", "checks": {"auth": {"result": "fail", "note": "n"}, "idor": {"result": "not-applicable", "note": "no id", "evidence": {"file": "b.ts", "line": 9}}},
             "findings": [claim("no-auth", 5, "critical", file="b.ts", stop=8)]},
            {"unit_id": "u1", "checks": {}, "findings": [claim("no-auth", 12)]},
        ]}),
        ("b2", {"verdicts": [{"unit_id": "u1", "checks": {"paging": "pass"}, "findings": []}]}),
        ("b3", None),
    ]
    rows = spark.createDataFrame([(b, json.dumps(r) if r else "no document {") for b, r in replies], "batch string, reply string")
    asked = spark.createDataFrame(ASKED, "batch string, unit_id string, kind string, domain string, place int")
    slices = spark.createDataFrame(SLICES, "batch string, file string, start int, stop int, cut_from int, cut_to int")
    registry = spark.createDataFrame(REGISTRY, "kind string, domain string, check string, rule string, ceiling string")
    return verdicts.decode(verdicts.read_replies(rows), asked, slices, registry)


def test_every_kind_of_issue(decoded):
    found = sorted((r["batch"], r["unit_id"], r["issue"], r["subject"]) for r in decoded.issues.na.fill("").collect())
    assert found == sorted([
        ("b1", "", "batch-id-mismatch", "b7"), ("b1", "ghost", "unknown-unit", "ghost"), ("b1", "u1", "duplicate-unit", "3"), ("b1", "u1", "unknown-check", "made-up"), ("b1", "u1", "unexplained-not-applicable", "idor"),
        ("b1", "u1", "evidence-not-shown", "a.ts:25"), ("b1", "u1", "fail-without-finding", "auth"), ("b1", "u1", "unknown-rule", "made.up"), ("b1", "u1", "citation-not-shown", "a.ts:25"), ("b1", "u1", "citation-not-shown", "a.ts:41"),
        ("b1", "u1", "evidence-not-shown", "a.ts:22"), ("b1", "u1", "evidence-not-shown", "c.ts:1"), ("b1", "u1", "text-clamped", "title"), ("b1", "u2", "severity-clamped", "no-auth"),
    ])
    # A batch owes only its own domain's checks; what a unit may answer is wider.
    assert {r["issue"] for r in decoded.issues.collect()} == set(verdicts.ISSUES) - {"missing-check"}


def test_findings(decoded):
    found = {(r["unit_id"], r["rule"]): r for r in decoded.findings.collect()}
    assert set(found) == {("u1", "idor"), ("u2", "no-auth")}
    one, two = found["u1", "idor"], found["u2", "no-auth"]
    assert (one["severity"], one["line"], one["stop"], one["evidence"], one["evidence_dropped"]) == ("critical", 12, 40, 1, 2)
    assert len(one["title"]) == 160 and one["title"].endswith("…") and one["exploitability"] is None
    assert (two["severity"], two["stop"], two["evidence"]) == ("high", 8, 0)


def test_every_unit_is_accounted_for(decoded):
    found = {(r["batch"], r["unit_id"]): (r["status"], r["complete"], r["checks"], r["missing_checks"]) for r in decoded.verdicts.collect()}
    assert found == {
        ("b1", "u1"): ("flagged", True, 3, 0), ("b1", "u2"): ("flagged", True, 2, 0), ("b1", "u3"): ("no-verdict", False, 0, 0), ("b2", "u1"): ("clean", True, 1, 0), ("b3", "u9"): ("no-verdict", False, 0, 0),
        ("b4", "u4"): ("no-verdict", False, 0, 0),
    }
    for r in decoded.batches.collect():
        assert r["asked"] == r["accepted"] + r["missing"] and r["replied"] == r["accepted"] + r["unknown"] + r["duplicate"], r


def test_a_check_that_is_owed_and_not_answered(spark):
    rows = spark.createDataFrame([("b", json.dumps({"verdicts": [{"unit_id": "u", "checks": {"auth": "pass"}, "findings": None}]}))], "batch string, reply string")
    asked = spark.createDataFrame([("b", "u", "route", "appsec", 0)], "batch string, unit_id string, kind string, domain string, place int")
    slices = spark.createDataFrame([], "batch string, file string, start int, stop int, cut_from int, cut_to int")
    registry = spark.createDataFrame(REGISTRY, "kind string, domain string, check string, rule string, ceiling string")
    got = verdicts.decode(verdicts.read_replies(rows), asked, slices, registry)
    assert [(r["issue"], r["subject"]) for r in got.issues.collect()] == [("missing-check", "idor")]
    assert [(r["status"], r["complete"]) for r in got.verdicts.collect()] == [("inconclusive", False)]


def test_nothing_asked(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    got = verdicts.decode(verdicts.read_replies(empty("batch string, reply string")), empty("batch string, unit_id string, kind string, domain string, place int"),
                          empty("batch string, file string, start int, stop int, cut_from int, cut_to int"), empty("kind string, domain string, check string, rule string, ceiling string"))
    assert got.issues.collect() == got.verdicts.collect() == got.findings.collect() == got.batches.collect() == []


ODD = [
    ("e1", '{"batch_id": "e9", "verdicts": []}'), ("e2", '{"batch_id": "e2", "verdicts": [null, {"unit_id": "u1", "checks": {"auth": {"result": "fail", "evidence": 3}}, "findings": [null, {"rule": "idor", "location": {"file": "a.ts", "line": "x"}}]}, {"unit_id": 7}]}'),
    ("e3", '{"batch_id": "e3", "verdicts": [{"unit_id": "u1", "checks": {"auth": "pass"}}'), ("e4", '{"batch_id": "e0"}'), ("e5", '{"verdicts": [{"unit_id": "u1", "checks": "none", "findings": "none"}, {"unit_id": "u1"}, {"unit_id": "u2", "findings": [{"rule": "idor", "evidence": [null], "location": {"file": "a.ts", "line": 2}}]}]}'),
    ("e6", '{"verdicts": {"unit_id": "u1"}}'), ("e7", None), ("e8", '[]'), ("e9", '{"verdicts": [{"unit_id": "u1"}, 5]}'),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "batch string, reply string")
    asked = spark.createDataFrame([(b, u, "route", "appsec", 0) for b, _ in ODD for u in ("u1", "u2")], "batch string, unit_id string, kind string, domain string, place int")
    slices = spark.createDataFrame([("e5", "a.ts", 1, 9, None, None)], "batch string, file string, start int, stop int, cut_from int, cut_to int")
    return verdicts.read_replies(rows), asked, slices, spark.createDataFrame(REGISTRY, "kind string, domain string, check string, rule string, ceiling string")


def test_the_account_needs_no_contents_of_answers(odd):
    replies, *others = odd
    got = [sorted(map(tuple, df.where("at is not null").select("batch", "at", "unit_id").collect()), key=repr) for df in (replies.given, replies.answers)]
    assert got[0] == got[1]
    batches = verdicts.decode(replies, *others).batches
    assert {tuple(r) for r in batches.collect()} == {
        ("e1", 2, 0, 2, 0, 0, 0), ("e2", 2, 1, 1, 3, 2, 0), ("e3", 2, 0, 2, 0, 0, 0), ("e4", 2, 0, 2, 0, 0, 0), ("e5", 2, 2, 0, 3, 0, 1), ("e6", 2, 0, 2, 0, 0, 0), ("e7", 2, 0, 2, 0, 0, 0), ("e8", 2, 0, 2, 0, 0, 0), ("e9", 2, 0, 2, 0, 0, 0),
    }
    plan = batches._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan.lower() and "recommendation" not in plan and "held" not in plan


def test_issues_of_odd_replies_come_from_one_pass(odd):
    issues = verdicts.decode(*odd).issues
    assert {(r["batch"], r["unit_id"], r["issue"], r["subject"]) for r in issues.collect()} == {
        ("e1", None, "batch-id-mismatch", "e9"), ("e2", "7", "unknown-unit", "7"), ("e2", "u1", "citation-not-shown", "a.ts"), ("e2", "u1", "fail-without-finding", "auth"), ("e2", "u1", "missing-check", "idor"),
        ("e2", "u1", "unknown-rule", None), ("e2", None, "unknown-unit", None), ("e4", None, "batch-id-mismatch", "e0"), ("e5", "u1", "duplicate-unit", "1"), ("e5", "u1", "missing-check", "auth"),
        ("e5", "u1", "missing-check", "idor"), ("e5", "u2", "evidence-not-shown", ""), ("e5", "u2", "missing-check", "auth"), ("e5", "u2", "missing-check", "idor"),
    }
    assert "Union" not in issues._jdf.queryExecution().optimizedPlan().toString()


def test_no_text_of_a_reply_is_shuffled(spark):
    d = "/root/testdata/sf0.001"
    for plan in (verdicts.reply_documents(spark, d), verdicts.decoded(spark, d).issues):
        said = plan._jdf.queryExecution().executedPlan().toString()
        assert said.count("StructsToJsonEvaluator") == 1 and "repeat" not in said[said.index("Exchange", said.index("StructsToJsonEvaluator")) :]
