"""Documents in prose, lines of matches on tables and streams, detectors on rows written by hand."""

from pyspark.sql import functions as F

from ledgerloom.operators import detectors
from ledgerloom.sources import tolerant


def test_the_first_balanced_object(spark):
    cases = [
        ('{"a": 1}', '{"a": 1}'), ('banner\n{"a": "}"} tail }', '{"a": "}"}'), ('say "hi { {"a": {"b": 2}} x', None), ('x {"q": "\\"}"} y', '{"q": "\\"}"}'), ("} {} {}", "{}"), ("{open", None), ("", None), (None, None),
        ('{"e": "\\\\"} {', '{"e": "\\\\"}'), ("a{b{c}d}e{f}", "{b{c}d}"),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
    found = [r["o"] for r in rows.select("i", tolerant.first_object(F.col("text")).alias("o")).orderBy("i").collect()]
    # An unclosed brace before it swallows an object.
    assert found == [c[1] for c in cases]


def test_bad_lines_are_counted_on_tables_and_streams(spark, tmp_path):
    lines = ['{"file": "a", "range": {"start": {"line": 3}}}', "{torn", "", "  ", '{"text": "no file"}', "[]", '{"file": "b"}']
    found = tolerant.match_lines(spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string"))
    assert sorted((r["match"]["file"] if r["match"] else None, r["bad"]) for r in found.where("bad or match is not null").collect() if not r["bad"]) == [("a", False), ("b", False)]
    assert found.where("bad").count() == 3
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(lines))
    stream = tolerant.match_lines(spark.readStream.text(str(tmp_path / "in"))).select("bad", F.col("match.file").alias("file"))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("bad").count() == 9 and out.where("file is not null").count() == 6


def test_facts_of_manifests_and_paths(spark):
    manifests = spark.createDataFrame([("r", "a/package.json", "devDependencies", "Express"), ("r", "b/package.json", "dependencies", "express"), ("r", "b/package.json", "bundled", "react"), ("r", "c/package.json", "dependencies", None)], "run string, file string, section string, package string")
    known = detectors.signals(spark)
    found = [tuple(r) for r in detectors.facts_from(detectors.manifest_keys(manifests), known).collect()]
    assert found == [("r", "framework", "express", "high", 2, "b/package.json,a/package.json")]
    paths = spark.createDataFrame([("r", p) for p in ("Dockerfile", "x/Migrations/1.sql", "x/migrations/migrations/2.sql", "node_modules/x/Dockerfile", "infra\\main.TF", "", "./", ".env")], "run string, file string")
    found = {(r["kind"], r["value"]): (r["confidence"], r["places"]) for r in detectors.facts_from(detectors.path_keys(paths), known).collect()}
    assert found == {("container", "docker"): ("high", 1), ("migrations", "sql-migrations"): ("medium", 2), ("iac", "terraform"): ("medium", 1), ("env-file", "env"): ("high", 1)}


def test_the_deepest_folder_that_covers_the_imports(spark):
    rows = [("r", "express", f) for f in ("src/api/a.ts", "src/api/b.ts", "src/api/v2/c.ts", "scripts/x.ts")] + [("r", "solo", "a.ts")]
    found = {r["name"]: (r["folder"], r["files"]) for r in detectors.deepest_cover(spark.createDataFrame(rows, "run string, name string, file string"), 0.6).collect()}
    assert found == {"express": ("src/api", 3), "solo": ("", 1)}
