"""Joins of ranges and points of a file by sweeps: sorted once by file and place, no pairs are made.

What can be said by sums, least and largest values is a window; the narrowest range around another
one needs the ranges that are open at a place, which a task holds while it streams its sorted rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.sources.views import spans, with_views

BATCH = 20_000


def innermost(queries: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, query, span, width, depth): the narrowest range of the file around each query, and how many are around it.

    queries has (file, query, a, b), ranges (file, span, start, stop); a point has a = b. Of equally
    narrow ranges the least span is taken; a query that no range holds has a null span and depth 0.
    A task holds the open ranges of one file at one place, no more. Null places and ends that come
    before their starts hold nothing; null files are one file. Repeated rows are answered each.
    """
    file, query, span = (df.schema[c].dataType.simpleString() for df, c in ((ranges, "file"), (queries, "query"), (ranges, "span")))
    n = lambda c: F.col(c).cast("long")
    opened = ranges.where("start is not null and stop >= start").select("file", n("start").alias("at"), F.lit(0).alias("side"), n("stop").alias("stop"), "span", F.lit(None).cast(query).alias("query"))
    asked = queries.select("file", n("a").alias("at"), F.lit(1).alias("side"), n("b").alias("stop"), F.lit(None).cast(span).alias("span"), "query")
    rows = opened.unionByName(asked).repartition("file").sortWithinPartitions("file", "at", "side", "span")

    def sweep(batches):
        here, active, horizon = object(), [], 0
        out: list[tuple] = []
        for batch in batches:
            for name, at, side, stop, own, asked_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != here:
                    here, active, horizon = name, [], 0
                if side == 0:
                    active.append((stop - at, own, stop))
                    continue
                if at is not None and len(active) > 2 * horizon + 8:
                    active = [x for x in active if x[2] >= at]
                    horizon = len(active)
                around = [x for x in active if x[2] >= stop] if at is not None and stop is not None else []
                width, found = min(around)[:2] if around else (None, None)
                out.append((name, asked_, found, width, len(around)))
                if len(out) >= BATCH:
                    yield _batch(out, schema)
                    out = []
        yield _batch(out, schema)

    result = f"file {file}, query {query}, span {span}, width long, depth int"
    schema = to_arrow_schema(queries.sparkSession.createDataFrame([], result).schema)
    return rows.mapInArrow(sweep, result)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def held_points(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, point, held_by): how many ranges of the file hold each point, by a running sum over starts and ends."""
    step = lambda at, n: F.struct(at.cast("long").alias("at"), F.lit(n).alias("n"))
    moves = ranges.where("start <= stop").select("file", F.inline(F.array(step(F.col("start"), 1), step(F.col("stop") + 1, -1)))).groupBy("file", "at").agg(F.sum("n").alias("n"))
    both = moves.select("file", "at", F.lit(0).alias("side"), "n", F.lit(None).cast(points.schema["point"].dataType).alias("point"))
    both = both.unionByName(points.select("file", F.col("point").cast("long").alias("at"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("n"), "point"))
    open_ = F.sum("n").over(Window.partitionBy("file").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("held_by", open_).where("side = 1").select("file", "point", "held_by")


def without_inner(rows: DataFrame) -> DataFrame:
    """Ranges that contain no other range of their file: none that begins as late ends as early.

    Of ranges with one start the shorter come first, so a row's predecessors are all that it could
    hold; equal ranges hold each other. Rows that share an id are one range's parts and don't hold
    each other: only where a row's earliest predecessor is of its own id are the others looked at.
    """
    later = Window.partitionBy("file").orderBy(F.desc("start"), "stop", "span").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("file", "start", "stop")
    rows = rows.select("file", "span", "start", "stop", F.min(F.struct("stop", "span")).over(later).alias("least"), (F.min("span").over(same) != F.max("span").over(same)).alias("alike"))
    holds = F.coalesce(F.col("least.stop") <= F.col("stop"), F.lit(False))
    own = F.coalesce(F.col("least.span") == F.col("span"), F.lit(False))
    rows = rows.withColumns({"holds": F.col("alike") | (holds & ~own), "unsure": ~F.col("alike") & holds & own})
    other = rows.select(F.col("file").alias("f"), F.col("span").alias("o"), F.col("start").alias("a"), F.col("stop").alias("b"))
    around = (F.col("file") == F.col("f")) & (F.col("start") <= F.col("a")) & (F.col("stop") >= F.col("b")) & (F.col("span") != F.col("o"))
    unsure = rows.where("unsure").join(other, around, "left_anti")
    return rows.where("not holds and not unsure").unionByName(unsure).select("file", "span", "start", "stop")


def cut_to_shown(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """(file, span, end): citations (file, span, a, b) whose start a shown range holds, cut where the farthest such range ends.

    The farthest end of all ranges that begin at or before a place is a running maximum; if it lies
    before the place, no range holds it.
    """
    ends = shown.groupBy("file", F.col("start").cast("long").alias("at")).agg(F.max(F.col("stop").cast("long")).alias("reach"))
    both = ends.select("file", "at", F.lit(0).alias("side"), "reach", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("span", "b")])
    both = both.unionByName(rows.select("file", F.col("a").cast("long").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("reach"), "span", "b"))
    far = F.max("reach").over(Window.partitionBy("file").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("far", far).where("side = 1 and far >= at")
    return found.groupBy("file", "span").agg(F.max(F.least(F.col("b"), F.col("far").cast(rows.schema["b"].dataType))).alias("end"))


def _blocks(s, d):
    sp = spans(s, d)
    points = sp.select("file", F.col("stop").alias("point")).distinct()
    found = innermost(points.select("file", F.col("point").alias("query"), F.col("point").alias("a"), F.col("point").alias("b")), sp.select("file", "span", "start", "stop"))
    return found.select("file", F.col("query").alias("point"), "span", "depth")


def _around(s, d):
    sp = spans(s, d).where("not inner")
    asked = sp.select("file", F.col("span").alias("query"), (F.col("start") + 2).alias("a"), (F.col("stop") - 2).alias("b")).where("a <= b").distinct()
    return innermost(asked, sp.select("file", "span", "start", "stop")).select("file", F.col("query").alias("inner_span"), "span", "depth")


QUERIES = {"win17_innermost_block": _blocks, "join06_innermost_containing": _around}
ORACLES = {
    "win17_innermost_block": with_views("SELECT p.file, p.point, arg_min(span, (stop - start)::HUGEINT * 1000000000 + span) AS span, CAST(count(span) AS INTEGER) AS depth FROM (SELECT DISTINCT file, stop AS point FROM v_span) p LEFT JOIN v_span s ON s.file = p.file AND s.start <= point AND s.stop >= point GROUP BY ALL", "v_span"),
    "join06_innermost_containing": with_views("SELECT q.file, q.span AS inner_span, arg_min(s.span, (s.stop - s.start)::HUGEINT * 1000000000 + s.span) AS span, CAST(count(s.span) AS INTEGER) AS depth FROM (SELECT DISTINCT file, span, start, stop FROM v_span WHERE NOT inner_ AND start + 2 <= stop - 2) q JOIN (SELECT * FROM v_span WHERE NOT inner_) s ON s.file = q.file WHERE s.start <= q.start + 2 AND s.stop >= q.stop - 2 GROUP BY q.file, q.span, q.start, q.stop", "v_span"),
}
