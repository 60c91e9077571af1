"""Batch plans, patches, excerpts and retries against plain versions."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import planning


def plain_packs(sizes, most, rows):
    out, total, n, pack = [], 0, 0, 0
    for s in sizes:
        if n and (total + s > most or n >= rows):
            total, n, pack = 0, 0, pack + 1
        total, n = total + s, n + 1
        out.append(pack)
    return out


def test_packs_equal_the_plain_pass_also_over_many_batches(spark):
    pick = random.Random(4)
    rows = [(g, i, pick.choice([0, 1, 5, 40, 99, 100, 101, 500, None])) for g in ("a", "b", None) for i in range(3000 if g == "a" else 40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        df = spark.createDataFrame(rows, "g string, i int, size int").withColumn("extra", F.lit("x")).repartition(6)
        found = planning.packed(df, ["g"], ["i"], "size", 100, 30).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        assert [r["pack"] for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["i"])] == plain_packs([r[2] or 0 for r in own], 100, 30)
    assert planning.packed(df.limit(0), ["g"], ["i"], "size", 100, 30).collect() == []


def test_the_budget_takes_a_prefix_of_the_riskiest_batches(spark):
    units = [("r", i, "route", "f", i, 90 - i, 30_000) for i in range(6)] + [("r", 100 + i, "cron", "f", i, 95, 70_000) for i in range(2)]
    plan = planning.batch_plan(spark.createDataFrame(units, "run string, unit_id long, kind string, file string, line int, risk int, chars long"), run_units=4)
    found = [(r["kind"], r["pack"], r["units"], r["mean_risk"], r["taken"]) for r in plan.orderBy("place").collect()]
    assert found == [("cron", 0, 1, 95.0, True), ("cron", 1, 1, 95.0, True), ("route", 0, 2, 89.5, True), ("route", 1, 2, 87.5, False), ("route", 2, 2, 85.5, False)]
    assert planning.bound_disclosure(plan).first()["statement"] == "4 of 8 units in 3 of 5 batches; 4 are not examined"


def test_the_last_patch_counts_and_conflicts_are_named(spark):
    rows = spark.createDataFrame([(1, {"a": "0", "b": "0"}), (2, None), (3, {"a": "0"})], "unit_id int, attributes map<string,string>")
    patches = [(1, 2, {"a": "late", "c": None}), (1, 1, {"a": "early", "c": "kept"}), (2, 1, {"x": "1"}), (2, 2, {"x": "1"}), (9, 1, {"x": "1"}), (3, 1, None)]
    found = {r["unit_id"]: (r["attributes"], r["conflicts"]) for r in planning.patched_attributes(rows, spark.createDataFrame(patches, "unit_id int, place int, attributes map<string,string>"), ["place"]).collect()}
    assert found == {1: ({"a": "late", "b": "0", "c": "kept"}, ["a"]), 2: ({"x": "1"}, []), 3: ({"a": "0"}, [])}


def test_an_excerpt_shares_one_budget(spark):
    uses = spark.createDataFrame([("b", t) for t in "xxxyyzzw"] + [("c", "gone")], "batch string, name string")
    columns = spark.createDataFrame([(t, f"{t}{i}") for t in "xyz" for i in range(3)], "name string, column string")
    found = [(r["name"], r["uses"], r["columns"]) for r in planning.schema_excerpt(uses, columns, tables=3, budget=5).orderBy("place").collect()]
    assert found == [("x", 3, "x0,x1,x2"), ("y", 2, "y0,y1"), ("z", 2, "")]


def test_a_failed_retry_loses_no_verdict(spark):
    skipped = "domain string, unit_id int, reason string"
    previous = spark.createDataFrame([("api", 1, "failed: x"), ("api", 2, "budget: y"), ("api", 3, "what")], skipped)
    fresh = spark.createDataFrame([("api", 1, "failed: again"), ("api", 7, "failed: had a verdict"), ("api", 2, "cancelled: not asked")], skipped)
    retried = spark.createDataFrame([(1,), (7,), (3,)], "unit_id int")
    totals = spark.createDataFrame([("api", 10), ("data", 4)], "domain string, units_total long")
    found = {r["domain"]: r.asDict() for r in planning.recomposed(previous, retried, fresh, totals).collect()}
    assert (found["api"]["units_audited"], found["api"]["skipped"], found["api"]["failed"], found["api"]["budget"], found["api"]["no_verdict"]) == (8, 2, 1, 1, 0)
    assert (found["data"]["units_audited"], found["data"]["skipped"]) == (4, 0)
    assert all(r["units_audited"] + r["skipped"] == r["units_total"] for r in found.values())
