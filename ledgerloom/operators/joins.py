"""Equi, semi, anti, interval, as-of and recursive joins over findings, units, spans and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.lineage import written
from ledgerloom.functions.scales import DOMAINS
from ledgerloom.operators.ranges import held_points, innermost, without_inner
from ledgerloom.sources.views import batches, edges, findings, lines, spans, table, triage, units, with_int, with_views


def domain_totals(rows: DataFrame) -> DataFrame:
    """Every domain with its findings; a domain without any has zero."""
    all_ = rows.sparkSession.createDataFrame([(d, i) for i, d in enumerate(DOMAINS)], "domain string, place int")
    return all_.join(rows.groupBy("domain").agg(F.count("*").alias("findings")), "domain", "left").na.fill(0, ["findings"])


def with_verdicts(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """All rows with the human verdict, if there is one."""
    return rows.join(verdicts, key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("unreviewed")))


def stale(verdicts: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Verdicts on ids that don't exist: any such rejects the whole file."""
    return verdicts.join(rows.select(key).distinct(), key, "left_anti")


def mismatches(reported: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns in which a verdict's copy of a finding differs from the finding."""
    joined = reported.alias("r").join(rows.alias("f"), key)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r.{c}").cast("string").alias("reported"), F.col(f"f.{c}").cast("string").alias("actual")) for c in columns])
    each = joined.select(key, F.explode(pairs).alias("p")).select(key, "p.*")
    return each.where(~F.col("reported").eqNullSafe(F.col("actual")))


def innermost_host(rows: DataFrame) -> DataFrame:
    """The narrowest host span of the same file around each inner span; a tie goes to the least id."""
    inner = rows.where("inner").select("file", F.col("span").alias("query"), F.col("start").alias("a"), F.col("stop").alias("b"))
    found = innermost(inner, rows.where("not inner")).where("span is not null")
    return found.groupBy("file", F.col("query").alias("inner_span")).agg(F.min_by("span", F.struct("width", "span")).alias("host"))


def outermost_only(rows: DataFrame) -> DataFrame:
    """Spans without a wider span of the same file around them: sorted sweep, no pairs."""
    order = Window.partitionBy("file").orderBy("start", F.desc("stop"), "span").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reach", F.max("stop").over(order)).where("reach is null or reach < stop").select("file", "span", "start", "stop")


def merged_ranges(rows: DataFrame, gap: int = 1) -> DataFrame:
    """Ranges of a file that overlap or touch become one."""
    order = Window.partitionBy("file").orderBy("start", "stop", "span")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = rows.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    return island.groupBy("file", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("ranges")).drop("island")


def asof_backward(rows: DataFrame, anchors: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """The last anchor at or before each row, by one union and a running last value."""
    both = rows.select(by, at, F.lit(1).alias("side"), F.col("key"), F.lit(None).alias("v")).unionByName(
        anchors.select(by, at, F.lit(0).alias("side"), F.lit(None).cast("long").alias("key"), F.col(value).alias("v"))
    )
    order = Window.partitionBy(by).orderBy(at, "side", F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("v", ignorenulls=True).over(order)).where("side = 1").select(by, "key", at, F.col("found").alias(value))


def shortest_paths(spark: SparkSession, edges_: DataFrame, roots: str, depth: int = 24, follow: str = "true") -> DataFrame:
    """Shortest path from every node up to an ancestor that satisfies roots (a condition on w.node): found downwards from the roots.

    A step reaches the children of the last step's nodes that no earlier step has reached, so every
    edge (that follow allows) is followed once and cycles end; of equally short paths the least text is kept.
    """
    nodes = edges_.select("child", F.col("child").alias("node")).alias("w")
    frontier = nodes.where(roots).select("child", F.col("child").alias("root"), F.lit(0).alias("depth"), F.col("child").cast("string").alias("path")).distinct()
    seen = frontier = written(frontier)
    for d in range(1, depth + 1):
        up = frontier.select(F.col("child").alias("parent"), "root", "path")
        below = edges_.where(follow).select("child", "parent").join(up, "parent").select("child", F.struct(F.concat_ws(">", F.col("child").cast("string"), "path").alias("path"), "root").alias("p"))
        reached = below.groupBy("child").agg(F.min("p").alias("p")).join(seen.select("child"), "child", "left_anti")
        frontier = written(reached.select("child", F.col("p.root").alias("root"), F.lit(d).alias("depth"), F.col("p.path").alias("path")))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def endpoint_matrix(rows: DataFrame, checks: list[str]) -> DataFrame:
    """Units × checks, the first answer of each; what has none is not-audited."""
    first = rows.groupBy("run").pivot("check", checks).agg(F.min_by("answer", "seq"))
    return first.select("run", *[F.coalesce(F.col(c), F.lit("not-audited")).alias(c) for c in checks])


def matrix_summary(matrix: DataFrame) -> DataFrame:
    """Number of each answer in every column of the matrix."""
    long = matrix.unpivot("run", [c for c in matrix.columns if c != "run"], "check", "answer")
    return long.groupBy("check", "answer").agg(F.count("*").alias("n"))


def related(rows: DataFrame, limit: int = 2, wanted: str = "true") -> DataFrame:
    """Up to two other units of the same run and file, nearest lines first, of every unit that is wanted."""
    other = rows.select("run", "file", F.col("unit_id").alias("other"), F.col("line").alias("l2"))
    near = rows.where(wanted).join(other, ["run", "file"]).where("other <> unit_id")
    order = Window.partitionBy("unit_id").orderBy(F.abs(F.col("line") - F.col("l2")), "other")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("unit_id", "place", "other")


def license_lines(rows: DataFrame) -> DataFrame:
    """Documents with a license line and where it is: line equi join of two extractions."""
    marked = rows.where(F.col("line").contains("Licensed under") | F.col("line").contains("GNU General"))
    return marked.groupBy("doc_id").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


def relocated(refs: DataFrame, rows: DataFrame, window: int = 50) -> DataFrame:
    """Where a quoted line is now: its only occurrence within the window of lines around the cited one."""
    band = refs.join(rows, "doc_id").where(F.abs(F.col("line_no") - F.col("cited")) <= window).where("line = needle")
    hit = band.groupBy("doc_id", "cited").agg(F.count("*").alias("n"), F.min("line_no").alias("found"))
    return refs.join(hit.where("n = 1"), ["doc_id", "cited"], "left").select(
        "doc_id", "cited", F.coalesce("found", "cited").alias("line_no"), F.col("found").isNotNull().alias("anchored")
    )


def triage_changes(rows: DataFrame) -> DataFrame:
    """Rows of each source before and after triage: wrong ones go, overstated ones are counted."""
    return rows.groupBy("source").agg(
        F.count("*").alias("before"), F.count_if(F.col("verdict") != "false").alias("after"), F.count_if(F.col("verdict") == "overstated").alias("lowered")
    )


def _verdicts(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", "lang")
    return with_verdicts(docs, triage(s, d), "doc_id")


def _mismatch(s, d):
    f = findings(s, d).groupBy("id").agg(F.min("file").alias("file"), F.min("line").alias("line"), F.min("sev").alias("sev"))
    said = f.select("id", "file", F.when(F.col("line") == 3, 4).otherwise(F.col("line")).alias("line"), F.when(F.col("file").endswith("7"), 0).otherwise(F.col("sev")).alias("sev"))
    return mismatches(said, f, "id", ["file", "line", "sev"])


def _points(s, d):
    return held_points(spans(s, d).select("file", F.col("start").alias("point")).distinct(), spans(s, d).where("not inner"))


def _asof(s, d):
    b = batches(s, d)
    rows = b.where("status = 'ok'").select("run", "at", F.col("batch").alias("key"))
    return asof_backward(rows, b.where("status = 'failed'").select("run", "at", "batch"), "run", "at", "batch").select("run", "key", "batch")


def _answers(s, d):
    u = units(s, d).where("kind = 'route'")
    return u.select("run", F.concat(F.lit("check"), (F.col("unit_id") % 4).cast("string")).alias("check"), F.col("cause").alias("answer"), F.col("unit_id").alias("seq"))


def _relocate(s, d):
    rows = lines(s, d)
    refs = rows.where("line_no % 5 = 1 and length(line) > 20").select("doc_id", (F.col("line_no") + 2).alias("cited"), F.col("line").alias("needle"))
    return relocated(refs, rows)


_CHECKS = [f"check{i}" for i in range(4)]
QUERIES = {
    "join01_domain_totals": lambda s, d: domain_totals(findings(s, d)),
    "join02_verdict_join": _verdicts,
    "join03_stale_verdicts": lambda s, d: stale(triage(s, d), table(s, d, "documents").where("doc_id % 3 <> 0"), "doc_id"),
    "join04_mismatches": _mismatch,
    "join05_innermost_host": lambda s, d: innermost_host(spans(s, d)),
    "win08_outermost_only": lambda s, d: outermost_only(spans(s, d)),
    "join30_without_containers": lambda s, d: without_inner(spans(s, d)),
    "win11_merged_ranges": lambda s, d: merged_ranges(spans(s, d)),
    "join07_points_in_ranges": _points,
    "join29_asof": _asof,
    "join16_shortest_path": lambda s, d: shortest_paths(s, edges(s, d), "w.node % 7 = 0", follow="parent > 0"),
    "join15_endpoint_matrix": lambda s, d: endpoint_matrix(_answers(s, d), _CHECKS),
    "agg43_matrix_summary": lambda s, d: matrix_summary(endpoint_matrix(_answers(s, d), _CHECKS)),
    # The SQL twin asks for the units of these runs only; without the predicate the operator gives those of all.
    "join12_related_units": lambda s, d: related(units(s, d), wanted="run % 100 = 1"),
    "join19_license_lines": lambda s, d: license_lines(lines(s, d)),
    "win09_relocation": _relocate,
    "agg37_triage_changes": lambda s, d: triage_changes(_verdicts(s, d)),
}
_F = "SELECT id, min(file) AS file, min(line) AS line, min(sev) AS sev FROM v_finding GROUP BY id"
_VERD = "SELECT doc_id, source, lang, coalesce(verdict, 'unreviewed') AS verdict FROM documents LEFT JOIN v_triage USING (doc_id)"
_MATRIX = "SELECT run, " + ", ".join(f"coalesce(arg_min(cause, unit_id) FILTER (unit_id % 4 = {i}), 'not-audited') AS check{i}" for i in range(4)) + " FROM v_unit WHERE kind = 'route' GROUP BY run"
ORACLES = {
    "join01_domain_totals": with_views("SELECT domain, CAST(place AS INTEGER) AS place, coalesce(n, 0) AS findings FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in DOMAINS) + "]) AS domain, unnest(range(8)) AS place) LEFT JOIN (SELECT domain, count(*) AS n FROM v_finding GROUP BY domain) USING (domain)", "v_finding"),
    "join02_verdict_join": with_views(_VERD, "v_triage"),
    "join03_stale_verdicts": with_views("SELECT * FROM v_triage WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)", "v_triage"),
    "join04_mismatches": with_views("SELECT id, 'line' AS \"column\", '4' AS reported, '3' AS actual FROM f WHERE line = 3 UNION ALL SELECT id, 'sev', '0', CAST(sev AS VARCHAR) FROM f WHERE file LIKE '%7' AND sev <> 0", "v_finding", f=_F),
    "join05_innermost_host": with_views("SELECT i.file, i.span AS inner_span, arg_min(h.span, (h.stop - h.start) * 10000000000 + h.span) AS host FROM v_span i JOIN v_span h ON i.file = h.file AND i.inner_ AND NOT h.inner_ AND h.start <= i.start AND h.stop >= i.stop GROUP BY ALL", "v_span"),
    "win08_outermost_only": with_views("SELECT file, span, start, stop FROM (SELECT *, max(stop) OVER (PARTITION BY file ORDER BY start, stop DESC, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_span) WHERE reach IS NULL OR reach < stop", "v_span"),
    "join30_without_containers": with_views("SELECT file, span, start, stop FROM v_span s WHERE NOT EXISTS (SELECT 1 FROM v_span o WHERE o.file = s.file AND o.span <> s.span AND s.start <= o.start AND s.stop >= o.stop)", "v_span"),
    "win11_merged_ranges": with_views("SELECT file, min(start) AS start, max(stop) AS stop, count(*) AS ranges FROM (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY start, stop, span) AS island FROM (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY file ORDER BY start, stop, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM v_span)) GROUP BY file, island", "v_span"),
    "join07_points_in_ranges": with_views("SELECT p.file, p.point, count(s.span) AS held_by FROM (SELECT DISTINCT file, start AS point FROM v_span) p LEFT JOIN v_span s ON s.file = p.file AND NOT s.inner_ AND p.point BETWEEN s.start AND s.stop GROUP BY ALL", "v_span"),
    "join29_asof": with_views("SELECT o.run, o.batch AS key, (SELECT arg_max(f.batch, struct_pack(a := f.at, b := f.batch)) FROM v_batch f WHERE f.status = 'failed' AND f.run = o.run AND f.at <= o.at) AS batch FROM v_batch o WHERE o.status = 'ok'", "v_batch"),
    "join16_shortest_path": with_views("SELECT child, arg_min(node, depth) AS root, CAST(min(depth) AS INTEGER) AS depth, arg_min(path, depth) AS path FROM walk WHERE node % 7 = 0 GROUP BY child", "v_edge", recursive=True, **{"walk(child, node, depth, path)": "SELECT child, child, 0, CAST(child AS VARCHAR) FROM v_edge UNION ALL SELECT w.child, e.parent, w.depth + 1, w.path || '>' || CAST(e.parent AS VARCHAR) FROM walk w JOIN v_edge e ON e.child = w.node WHERE w.depth < 24 AND e.parent > 0 AND w.node % 7 <> 0"}),
    "join15_endpoint_matrix": with_views(_MATRIX, "v_unit"),
    "agg43_matrix_summary": with_views("SELECT \"check\", answer, count(*) AS n FROM (UNPIVOT m ON check0, check1, check2, check3 INTO NAME \"check\" VALUE answer) GROUP BY ALL", "v_unit", m=_MATRIX),
    "join12_related_units": with_views("SELECT unit_id, place, other FROM (SELECT a.unit_id, b.unit_id AS other, row_number() OVER (PARTITION BY a.unit_id ORDER BY abs(a.line - b.line), b.unit_id) AS place FROM v_unit a JOIN v_unit b ON a.file = b.file AND a.run = b.run AND a.unit_id <> b.unit_id WHERE a.run % 100 = 1) WHERE place <= 2", "v_unit"),
    "join19_license_lines": with_views("SELECT doc_id, count(*) AS lines, min(line_no) AS first_line FROM v_line WHERE contains(line, 'Licensed under') OR contains(line, 'GNU General') GROUP BY doc_id", "v_line"),
    "win09_relocation": with_views("SELECT r.doc_id, r.cited, coalesce(found, r.cited) AS line_no, found IS NOT NULL AS anchored FROM refs r LEFT JOIN (SELECT r.doc_id, r.cited, min(l.line_no) AS found FROM refs r JOIN v_line l ON l.doc_id = r.doc_id AND abs(l.line_no - r.cited) <= 50 AND l.line = r.needle GROUP BY ALL HAVING count(*) = 1) h USING (doc_id, cited)", "v_line", refs="SELECT doc_id, line_no + 2 AS cited, line AS needle FROM v_line WHERE line_no % 5 = 1 AND length(line) > 20"),
    "agg37_triage_changes": with_views(f"SELECT source, count(*) AS before, count(*) FILTER (verdict <> 'false') AS after, count(*) FILTER (verdict = 'overstated') AS lowered FROM ({_VERD}) GROUP BY source", "v_triage"),
}
ORACLES["join12_related_units"] = with_int(ORACLES["join12_related_units"], "place")
