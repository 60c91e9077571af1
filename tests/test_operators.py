"""Small rows with known results for the cases that the data doesn't hold."""

from pyspark.sql import functions as F

from ledgerloom.functions.scales import band_of, rank_of, round_half_up
from ledgerloom.functions.text import duration_text, entropy, glob_to_regex, route_of_file, slug, split_words, version, version_gap
from ledgerloom.operators.facts import assurances, license_rollup, merged_facts
from ledgerloom.operators.joins import asof_backward, related, shortest_paths
from ledgerloom.operators.windows import greedy_batches, within_budget
from ledgerloom.sources.readers import read_reply, read_sarif


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scales(spark):
    assert one(spark, round_half_up(F.lit(1.005), 2)) == 1.0 and one(spark, round_half_up(F.lit(2.5))) == 3.0
    assert one(spark, rank_of(F.lit("unheard"), ("a", "b"))) == 2
    assert [one(spark, band_of(F.lit(s))) for s in (100, 90, 89, 60, 40, 39)] == ["A", "A", "B", "C", "D", "F"]


def test_text(spark):
    assert abs(one(spark, entropy(F.lit("aabb"))) - 1.0) < 1e-9
    assert one(spark, split_words(F.lit("getUserID_v2"))) == ["get", "user", "id", "v2"]
    assert one(spark, slug(F.lit("  Hello, World! "))) == "hello-world"
    assert one(spark, route_of_file(F.lit("src/app/(auth)/users/[id]/page.tsx"))) == "/users/[id]" and one(spark, route_of_file(F.lit("src/app/x.tsx"))) is None
    assert tuple(one(spark, version(F.lit("v1.20.3-rc.1")))) == (1, 20, 3, False, "rc.1") and one(spark, version(F.lit("^1.20.3"))) is None
    for have, latest, gap in (("2.0.0", "1.9.0", "none"), ("1.0.0-rc.1", "1.0.0", "patch"), ("1.0", "latest", None), ("1.2.3", "1.3.0", "minor"), ("1.2.3", "2.0.0-a", "major")):
        assert one(spark, version_gap(F.lit(have), F.lit(latest))) == gap
    assert [one(spark, duration_text(F.lit(s))) for s in (40, 120, 150)] == ["+40s", "+2m", "+2m 30s"]
    for pattern, path, hit in (("src/**/*.ts", "src/a/b/c.ts", True), ("src/**/*.ts", "src/c.ts", True), ("src/*.ts", "src/a/c.ts", False), ("a?.b", "ax.b", True), ("a?.b", "a/.b", False)):
        assert one(spark, F.lit(path).rlike(glob_to_regex(pattern))) == hit


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([(1, 1, 9.0, 500), (1, 2, 8.0, 1), (2, 3, 9.0, 200), (2, 4, 8.0, 150), (2, 5, 7.0, 10)], "run long, batch long, duration double, units long")
    assert sorted((r.run, r.batch) for r in within_budget(df, 40, 300).collect()) == [(1, 1), (2, 3)]


def test_greedy_batches(spark):
    df = spark.createDataFrame([(1, i, u) for i, u in enumerate([60, 50, 200, 10, 90, 1])], "run long, batch long, units long")
    assert [r.pack for r in greedy_batches(df, 100, 30).orderBy("batch").collect()] == [0, 1, 2, 3, 3, 4]


def test_asof_and_paths(spark):
    rows = spark.createDataFrame([(1, 5, 10), (1, 1, 11), (2, 9, 12)], "run long, at long, key long")
    anchors = spark.createDataFrame([(1, 2, 100), (1, 5, 101), (3, 1, 102)], "run long, at long, batch long")
    assert {r["key"]: r["batch"] for r in asof_backward(rows, anchors, "run", "at", "batch").collect()} == {10: 101, 11: None, 12: None}
    edges = spark.createDataFrame([(7, 3), (3, 1), (1, 0), (6, 3)], "child long, parent long")
    assert {r.child: r.path for r in shortest_paths(spark, edges, "w.node = 1").collect()} == {7: "7>3>1", 3: "3>1", 1: "1", 6: "6>3>1"}


def test_readers_take_bad_input(spark):
    df = spark.createDataFrame([(1, "not json"), (2, None), (3, '{"runs":[]}'), (4, '{"runs":[{"tool":{"driver":{"name":"t","rules":[{"id":"r0","defaultConfiguration":{"level":"note"}}]}},"results":[{"ruleIndex":0,"message":{"text":"m"}}]}]}')], "report long, body string")
    assert [(r.report, r.rule, r.level, r.file) for r in read_sarif(df).collect()] == [(4, "r0", "note", None)]
    assert {r.report: r.state for r in read_reply(df.where("body is not null")).collect()}[1] == "no-json"


def test_related_units_of_every_run(spark):
    rows = [(run, f"f{k % 2}", 10 * run + k, k) for run in range(1, 6) for k in range(6)]
    df = spark.createDataFrame(rows, "run long, file string, unit_id long, line long")
    want = set()
    for run, file, unit, line in rows:
        near = sorted((abs(line - b[3]), b[2]) for b in rows if b[:2] == (run, file) and b[2] != unit)
        want |= {(unit, place + 1, other) for place, (_, other) in enumerate(near[:2])}
    got = [(r.unit_id, r.place, r.other) for r in related(df).collect()]
    assert len(got) == 60 and set(got) == want
    assert {r.unit_id // 10 for r in related(df, wanted="run = 3").collect()} == {3}


def test_first_evidence_is_ranked_before_it_is_collected(spark):
    rows = [("k", None, f"e{i % 40:02d}", "d", 0, f"s{i:03d}", i, "c", f"f{i % 30:02d}", "b", f"n{i % 9}") for i in range(200)] + [("q", "v", None, "d", 1, "s", 1, "c", None, "b2", None)]
    df = spark.createDataFrame(rows, "kind string, value string, evidence string, detail string, conf int, seq string, unit_id long, check string, file string, p_brand string, p_name string")
    facts, checked, names = merged_facts(df), assurances(df), license_rollup(df, "true")
    assert sorted(map(tuple, facts.collect())) == [("k", None, 0, "d", ",".join(f"e{i:02d}" for i in range(25))), ("q", "v", 1, "d", "")]
    assert sorted(map(tuple, checked.collect())) == [("k", "c", 200, ",".join(f"f{i:02d}" for i in range(12))), ("q", "c", 1, "")]
    assert sorted(map(tuple, names.collect())) == [("b", 200, "n0,n1,n2"), ("b2", 1, "")]
    for got in (facts, checked, names):
        assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
