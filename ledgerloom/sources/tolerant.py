"""Reading of JSON that tools print among other things: documents inside prose, and one object a line with bad lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.views import table

MATCH = "file string, text string, ruleId string, range struct<start:struct<line:int,column:int>,end:struct<line:int,column:int>>"


def first_object(text: Column) -> Column:
    """The first balanced {...} of a text, null if none is closed; braces inside of quoted strings don't count.

    One pass over the characters carries the depth, whether a string is open, whether the last
    character escapes this one, and where the object begins and ends.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).alias("b"))

    def step(acc: Column, c: Column) -> Column:
        live = (acc["b"] == 0) & (acc["depth"] > 0)
        syntax = live & ~acc["quoted"]
        opens = (acc["b"] == 0) & (c == "{") & ~acc["quoted"]
        depth = acc["depth"] + F.when(opens, 1).otherwise(0) - F.when(syntax & (c == "}"), 1).otherwise(0)
        i = acc["i"] + 1
        return F.struct(
            depth.alias("depth"), F.when(live & (c == '"') & ~acc["escaped"], ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"),
            (live & acc["quoted"] & (c == "\\") & ~acc["escaped"]).alias("escaped"), i.alias("i"),
            F.when(opens & (acc["depth"] == 0), i).otherwise(acc["a"]).alias("a"), F.when(syntax & (c == "}") & (acc["depth"] == 1), i).otherwise(acc["b"]).alias("b"),
        )

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda acc: F.when(acc["b"] > 0, F.substring(text, acc["a"], acc["b"] - acc["a"] + 1)))


def embedded_documents(rows: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """rows with `document`, read from the first object of a text by the schema, and `found`: none, unreadable or read."""
    rows = rows.withColumn("__o", first_object(F.col(text)))
    read = F.from_json("__o", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    rows = rows.withColumn("__d", read)
    found = F.when(F.col("__o").isNull(), "none").when(F.col("__d.__bad").isNotNull(), "unreadable").otherwise("read")
    names = [f.strip().split(" ")[0] for f in schema.split(",") if " " in f.strip()]
    return rows.withColumns({"found": found, "document": F.when(found == "read", F.struct(*[F.col(f"__d.{n}").alias(n) for n in names]))}).drop("__o", "__d")


def match_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with `match`, the object that a line holds, and `bad`: blank lines are neither, an object without a file is bad.

    It has no state, so it reads file streams as well as tables.
    """
    read = F.from_json(line, MATCH + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    got = lines.withColumn("__m", read).withColumn("__blank", F.coalesce(F.trim(line) == "", F.lit(True)))
    bad = ~F.col("__blank") & (F.col("__m.__bad").isNotNull() | F.col("__m.file").isNull())
    fields = F.struct(*[F.col(f"__m.{n}").alias(n) for n in ("file", "text", "ruleId", "range")])
    return got.withColumns({"bad": bad, "match": F.when(~bad & ~F.col("__blank"), fields)}).drop("__m", "__blank")


_BEFORE = ("", "npm warn old lockfile\n", 'a "quoted word and } stray: ', "tool 1.2 [info] ")
_AFTER = ("", "\nDone {ok}", ' and "more"', "\n{")


def _printed(s, d):
    pick = lambda v, k: F.element_at(F.array(*map(F.lit, v)), (F.floor(F.col("p_partkey") / k) % len(v)).cast("int") + 1)
    body = F.concat(F.lit('{"name": "x } \\" {'), "p_name", F.lit('", "n": {"k": '), "p_partkey", F.lit("}}"))
    body = F.when(F.col("p_partkey") % 11 == 0, F.lit("no document")).when(F.col("p_partkey") % 13 == 0, F.lit("{broken: }")).otherwise(body)
    rows = table(s, d, "part").select("p_partkey", F.concat(pick(_BEFORE, 1), body, F.when((F.col("p_partkey") % 11 == 0), "").otherwise(pick(_AFTER, 4))).alias("text"))
    got = embedded_documents(rows, "name string, n struct<k:long>")
    return got.select("p_partkey", "found", F.col("document.name").alias("name"), F.col("document.n.k").alias("k"))


def _matches(s, d):
    k = F.col("p_partkey")
    line = F.when(k % 7 == 0, F.concat(F.lit("{torn "), k)).when(k % 17 == 0, "  ").when(k % 5 == 0, F.lit('{"text": "no file"}'))
    whole = F.concat(F.lit('{"file": "f'), k % 9, F.lit('", "text": "t", "ruleId": "r", "range": {"start": {"line": '), k % 100, F.lit('}}}'))
    got = match_lines(table(s, d, "part").select((k % 20).alias("run"), F.coalesce(line, whole).alias("value")))
    return got.groupBy("run").agg(F.count("match").alias("matches"), F.count_if("bad").alias("bad"), F.sum("match.range.start.line").alias("lines"))


QUERIES = {"src09_embedded_documents": _printed, "src20_match_lines": _matches}
ORACLES = {
    "src09_embedded_documents": "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'none' WHEN p_partkey % 13 = 0 THEN 'unreadable' ELSE 'read' END AS found, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 THEN 'x } \" {' || p_name END AS name, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 THEN p_partkey END AS k FROM part",
    "src20_match_lines": "SELECT run, count(*) FILTER (c = 'm') AS matches, count(*) FILTER (c = 'b') AS bad, CAST(sum(CASE WHEN c = 'm' THEN p_partkey % 100 END) AS BIGINT) AS lines FROM (SELECT p_partkey, p_partkey % 20 AS run, CASE WHEN p_partkey % 7 = 0 THEN 'b' WHEN p_partkey % 17 = 0 THEN '-' WHEN p_partkey % 5 = 0 THEN 'b' ELSE 'm' END AS c FROM part) GROUP BY run",
}
