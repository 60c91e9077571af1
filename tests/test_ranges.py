"""Sweeps and frontiers against brute force on random and odd rows."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import facts, joins, ranges

RANGE = "file string, span long, start int, stop int"


def made(seed, n=150):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        a = pick.randint(0, 40)
        rows.append((pick.choice(["f", "g", None]), i, a, a + pick.choice([0, 1, 3, 10, 30, -2])))
    return rows


def test_innermost_equals_brute_force(spark):
    rows, asked = made(1), [(f, i, a, a + w) for i, (f, _, a, _) in enumerate(made(2)) for w in (0, 4)]
    asked += [("nowhere", 900, 1, 2), ("f", 901, None, None)]
    found = ranges.innermost(spark.createDataFrame(asked, "file string, query int, a int, b int").repartition(5), spark.createDataFrame(rows, RANGE).repartition(3))
    expected = []
    for f, q, a, b in asked:
        held = sorted((t - s, i) for g, i, s, t in rows if g == f and a is not None and s <= a and b <= t)
        expected.append((f, q, held[0][1] if held else None, held[0][0] if held else None, len(held)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    none = spark.createDataFrame([], RANGE)
    assert ranges.innermost(spark.createDataFrame([], "file string, query int, a int, b int"), none).collect() == []
    assert [r["depth"] for r in ranges.innermost(spark.createDataFrame(asked[:2], "file string, query int, a int, b int"), none).collect()] == [0, 0]


def test_held_points_without_inner_and_cuts_equal_brute_force(spark):
    rows = [r for r in made(3) if r[0] and r[2] <= r[3]] + [("f", 1000, 5, 9), ("f", 1001, 5, 9), ("f", 1002, 20, 30), ("f", 1002, 22, 25)]
    df = spark.createDataFrame(rows, RANGE).repartition(4)
    points = [(f, p) for f in ("f", "g", "h") for p in range(0, 60, 3)]
    found = ranges.held_points(spark.createDataFrame(points, "file string, point int"), df)
    assert {tuple(r) for r in found.collect()} == {(f, p, sum(g == f and s <= p <= t for g, _, s, t in rows)) for f, p in points}
    alone = [r for r in rows if not any(o[0] == r[0] and o[1] != r[1] and r[2] <= o[2] and o[3] <= r[3] for o in rows)]
    assert sorted(map(tuple, ranges.without_inner(df).collect())) == sorted(alone)
    cited = [(f, i, p, p + 6) for i, (f, p) in enumerate(points)]
    expected = {(f, i, max(min(b, t) for g, _, s, t in rows if g == f and s <= a <= t)) for f, i, a, b in cited if any(g == f and s <= a <= t for g, _, s, t in rows)}
    assert {tuple(r) for r in ranges.cut_to_shown(spark.createDataFrame(cited, "file string, span int, a int, b int"), df).collect()} == expected


def test_shortest_paths_end_in_cycles_and_take_the_shortest(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 9), (5, 4), (5, 9), (6, 7), (7, 6), (9, 9)], "child int, parent int")
    found = {r["child"]: (r["root"], r["depth"], r["path"]) for r in joins.shortest_paths(spark, edges, "w.node = 9").collect()}
    assert found == {9: (9, 0, "9"), 4: (9, 1, "4>9"), 5: (9, 1, "5>9"), 1: (9, 2, "1>4>9"), 3: (9, 3, "3>1>4>9"), 2: (9, 4, "2>3>1>4>9")}


def test_router_prefixes_have_eight_parts_at_most(spark):
    edges = spark.range(1, 15).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    found = {r["child"]: r["prefix"] for r in facts.router_prefixes(edges).collect()}
    assert found[3] == "/1/2/3" and found[8] == "/1/2/3/4/5/6/7/8" and found[12] == "/5/6/7/8/9/10/11/12"
