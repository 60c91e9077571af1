"""Plans of batches: units ranked by risk, packed by the room that their slices need, batches ranked and cut by a budget.

Packing is greedy and depends on what went before, so it is an ordered pass: rows are dealt by group,
sorted, and streamed through a task that holds the sums of the open pack only, whatever a group's size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scales import KIND_DOMAIN, lookup, round_half_up, sql_case
from ledgerloom.operators.risk import _RISK, described_units, risk_scores
from ledgerloom.sources.views import batches, table, with_views

# Characters and units of a batch, batches and units of a run.
BATCH_CHARS, BATCH_UNITS, RUN_BATCHES, RUN_UNITS = 60_000, 30, 40, 800
EXCERPT_TABLES, EXCERPT_COLUMNS = 12, 40


def packed(rows: DataFrame, groups: list[str], order: list[str], size: str, most: int, most_rows: int) -> DataFrame:
    """rows with `pack`, from 0 in each group: in order they fill packs of at most `most` size and most_rows rows.

    A row that is larger than a pack is alone in one. Null sizes count as 0; null groups are one
    group each. A task carries three numbers from row to row and from batch to batch.
    """
    kept = rows.columns
    sorted_ = rows.repartition(*groups).sortWithinPartitions(*groups, *order)
    places, at = [kept.index(g) for g in groups], kept.index(size)

    def fill(batches_):
        here, total, n, pack = object(), 0, 0, 0
        for batch in batches_:
            out = []
            for *group, need in zip(*(batch.column(i).to_pylist() for i in (*places, at)), strict=True):
                need = need or 0
                if group != here:
                    here, total, n, pack = group, 0, 0, 0
                elif n and (total + need > most or n >= most_rows):
                    total, n, pack = 0, 0, pack + 1
                total, n = total + need, n + 1
                out.append(pack)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "pack"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema.fields)
    return sorted_.mapInArrow(fill, fields + ", pack long")


def batch_plan(rows: DataFrame, chars: int = BATCH_CHARS, units: int = BATCH_UNITS, run_batches: int = RUN_BATCHES, run_units: int = RUN_UNITS) -> DataFrame:
    """Batches of every run with their units, characters, mean risk, place and whether the budget reaches them.

    rows has run, unit_id, kind, file, line, risk and chars. Units of a kind are packed by falling risk;
    batches go by falling mean risk, ties by kind and pack. The budget takes batches in that order until
    one doesn't fit; the first is always taken.
    """
    got = packed(rows.select("run", "kind", F.col("risk"), "file", "line", "unit_id", "chars"), ["run", "kind"], [F.desc("risk"), "file", "line", "unit_id"], "chars", chars, units)
    mean = (2 * 100 * F.sum("risk") + F.count("*")) / (2 * F.count("*"))
    by = got.groupBy("run", "kind", "pack").agg(F.count("*").alias("units"), F.sum("chars").alias("chars"), (F.floor(mean) / 100).alias("mean_risk"), F.min("unit_id").alias("least_unit"))
    order = Window.partitionBy("run").orderBy(F.desc("mean_risk"), "kind", "pack")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumns({"place": F.row_number().over(order), "total": F.sum("units").over(upto)})
    fits = (F.col("place") <= run_batches) & ((F.col("total") <= run_units) | (F.col("place") == 1))
    by = by.withColumn("taken", F.min(fits.cast("int")).over(upto) == 1)
    return by.withColumn("domain", lookup(F.col("kind"), KIND_DOMAIN)).select("run", "kind", "domain", "pack", "units", "chars", "mean_risk", "place", "taken", "least_unit")


def bound_disclosure(plan: DataFrame) -> DataFrame:
    """What each run's budget leaves out, as numbers and as the sentence that a report shows."""
    got = plan.groupBy("run").agg(F.count("*").alias("batches"), F.count_if("taken").alias("taken"), F.sum("units").alias("units"), F.sum(F.when(F.col("taken"), F.col("units")).otherwise(0)).alias("reached"))
    left = F.col("units") - F.col("reached")
    said = F.when(left == 0, F.lit("every unit is in a batch that runs")).otherwise(F.concat("reached", F.lit(" of "), "units", F.lit(" units in "), "taken", F.lit(" of "), "batches", F.lit(" batches; "), left, F.lit(" are not examined")))
    return got.select("run", "batches", "taken", "units", "reached", said.alias("statement"))


def patched_attributes(rows: DataFrame, patches: DataFrame, order: list[str]) -> DataFrame:
    """(unit_id, attributes, conflicts): attributes of units after the patches of several producers.

    patches has unit_id, attributes and the order columns; of the values of one attribute the last by
    that order counts, a null patches nothing, and where two producers differ the attribute is named
    in conflicts. Patches of unknown units are left out; a null map is an empty one.
    """
    each = patches.select("unit_id", F.struct(*order).alias("at"), F.explode("attributes").alias("name", "value")).where("value is not null")
    last = each.groupBy("unit_id", "name").agg(F.max_by("value", F.struct("at", "value")).alias("value"), (F.min("value") != F.max("value")).alias("differ"))
    merged = last.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("patch"), F.array_sort(F.array_compact(F.collect_list(F.when(F.col("differ"), F.col("name"))))).alias("conflicts"))
    empty = F.create_map().cast("map<string,string>")
    base, patch = F.coalesce("attributes", empty), F.coalesce("patch", empty)
    whole = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k)), patch)
    return rows.select("unit_id", "attributes").join(merged, "unit_id", "left").select("unit_id", whole.alias("attributes"), F.coalesce("conflicts", F.array().cast("array<string>")).alias("conflicts"))


def schema_excerpt(uses: DataFrame, columns: DataFrame, tables: int = EXCERPT_TABLES, budget: int = EXCERPT_COLUMNS) -> DataFrame:
    """(batch, name, uses, columns): the tables that a batch's units use most, with columns as far as one budget goes.

    uses has batch and name, a row for each use; columns has name and column. At most `tables` tables by
    falling use, then by name. Columns in order of name go to the tables in that order until `budget`
    columns are shown; a table beyond it is named without columns. Tables that the schema lacks are
    left out.
    """
    known = columns.groupBy("name").agg(F.count("*").alias("all"))
    ranked = uses.groupBy("batch", "name").agg(F.count("*").alias("uses")).join(known, "name")
    order = Window.partitionBy("batch").orderBy(F.desc("uses"), "name")
    ranked = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= tables)
    before = F.coalesce(F.sum("all").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("room", F.greatest(F.lit(0), F.least(F.col("all"), budget - before)))
    first = columns.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("column"))).where(F.col("n") <= budget)
    held = first.groupBy("name").agg(F.array_sort(F.collect_list("column")).alias("held"))
    return ranked.join(held, "name").select("batch", "name", "place", "uses", F.array_join(F.slice("held", F.lit(1), F.col("room").cast("int")), ",").alias("columns"))


def recomposed(previous: DataFrame, retried: DataFrame, fresh: DataFrame, totals: DataFrame) -> DataFrame:
    """(domain, units_total, units_audited and the number of each cause): coverage after a retry, from its skipped units.

    previous and fresh have domain, unit_id and reason (cause: text) of skipped units, retried the
    unit ids asked again, totals domain and units_total. A unit that was asked again is skipped only if
    it is skipped anew and had no verdict before: a verdict that was there isn't lost to a failed
    retry. Totals never fall below the number of skipped units, and audited plus skipped is the total.
    """
    asked = retried.select("unit_id").distinct()
    kept = previous.join(asked, "unit_id", "left_anti").select("domain", "unit_id", "reason")
    had_none = previous.select("domain", "unit_id").distinct()
    again = fresh.join(asked, "unit_id", "left_semi").join(had_none, ["domain", "unit_id"], "left_semi").select("domain", "unit_id", "reason")
    causes = ("no-verdict", "inconclusive", "budget", "failed", "cancelled")
    cause = F.substring_index("reason", ":", 1)
    cause = F.when(cause.isin(*causes), cause).otherwise("no-verdict")
    skipped = kept.unionByName(again).withColumn("cause", cause).groupBy("domain").agg(F.count("*").alias("skipped"), *[F.count_if(F.col("cause") == c).alias(c.replace("-", "_")) for c in causes])
    got = totals.join(skipped, "domain", "left").na.fill(0)
    total = F.greatest("units_total", "skipped")
    return got.select("domain", total.alias("units_total"), (total - F.col("skipped")).alias("units_audited"), "skipped", *[c.replace("-", "_") for c in causes])


def _sized(s, d):
    u = described_units(s, d)
    return risk_scores(u).join(u.select("unit_id", F.floor(F.col("price") % 9000).cast("long").alias("chars")), "unit_id").withColumn("run", F.col("run") % 40)


def _patches(s, d):
    u = described_units(s, d).select("unit_id", F.create_map(F.lit("kind"), "kind", F.lit("method"), F.col("attributes")["method"]).alias("attributes"))
    o = table(s, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("producer"), F.col("l_partkey").alias("seq"), F.create_map(F.lit("status"), F.col("l_linestatus"), F.lit("method"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("m"), F.col("l_suppkey") % 2)), F.lit("tax"), F.when(F.col("l_tax") > 0.05, F.lit("high"))).alias("attributes"))
    got = patched_attributes(u, o, ["producer", "seq"])
    return got.select("unit_id", *[F.col("attributes")[k].alias(k) for k in ("kind", "method", "status", "tax")], F.array_join("conflicts", ",").alias("conflicts"))


def _excerpt(s, d):
    uses = table(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("batch"), F.concat(F.lit("Brand#"), F.col("l_partkey") % 30).alias("name"))
    return schema_excerpt(uses, table(s, d, "part").select(F.col("p_brand").alias("name"), F.col("p_name").alias("column")).distinct())


def _recomposed(s, d):
    from ledgerloom.sources.views import units

    u = units(s, d).select("unit_id", lookup(F.col("kind"), KIND_DOMAIN).alias("domain"), "cause", "segment")
    reason = F.concat("cause", F.lit(": "), "segment")
    retried = u.where("unit_id % 3 = 0").select("unit_id")
    fresh = u.where("unit_id % 2 = 0").select("domain", "unit_id", F.when(F.col("unit_id") % 5 == 0, "failed: timeout").otherwise("odd reason").alias("reason"))
    return recomposed(u.where("cause <> 'audited'").select("domain", "unit_id", reason.alias("reason")), retried, fresh, u.groupBy("domain").agg(F.count("*").alias("units_total")))


QUERIES = {
    "win07_greedy_batches": lambda s, d: packed(batches(s, d).select("run", "batch", "units"), ["run"], ["batch"], "units", 100, 30).select("run", "batch", "pack"),
    "exe09_batch_plan": lambda s, d: batch_plan(_sized(s, d)),
    "exe12_bound_disclosure": lambda s, d: bound_disclosure(batch_plan(_sized(s, d), run_batches=12, run_units=200)),
    "join13_patched_attributes": _patches,
    "join24_schema_excerpt": _excerpt,
    "agg44_recomposed_totals": _recomposed,
}
_SIZED = "SELECT r.run % 40 AS run, r.unit_id, r.kind, r.file, r.line, r.risk, CAST(floor(u.price % 9000) AS BIGINT) AS chars FROM risk r JOIN v_unit u USING (unit_id)"
_STEP = "w.size + o.chars > 60000 OR w.n >= 30"
_PLAN = {
    "risk": _RISK, "sized": _SIZED,
    "o": "SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY risk DESC, file, line, unit_id) AS k FROM sized",
    "walk(run, kind, unit_id, risk, chars, k, pack, size, n)": f"SELECT run, kind, unit_id, risk, chars, k, 0::BIGINT, chars, 1::BIGINT FROM o WHERE k = 1 UNION ALL SELECT o.run, o.kind, o.unit_id, o.risk, o.chars, o.k, CASE WHEN {_STEP} THEN w.pack + 1 ELSE w.pack END, CASE WHEN {_STEP} THEN o.chars ELSE w.size + o.chars END, CASE WHEN {_STEP} THEN 1 ELSE w.n + 1 END FROM walk w JOIN o ON o.run = w.run AND o.kind = w.kind AND o.k = w.k + 1",
    "packs": "SELECT run, kind, pack, count(*) AS units, CAST(sum(chars) AS BIGINT) AS chars, ((200 * sum(risk) + count(*)) // (2 * count(*))) / 100 AS mean_risk, min(unit_id) AS least_unit FROM walk GROUP BY ALL",
}


def _plan_sql(body: str, most: int, units: int) -> str:
    ranked = f"SELECT *, min(CASE WHEN place <= {most} AND (total <= {units} OR place = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY place) = 1 AS taken FROM (SELECT *, row_number() OVER w AS place, sum(units) OVER w AS total FROM packs WINDOW w AS (PARTITION BY run ORDER BY mean_risk DESC, kind, pack ROWS UNBOUNDED PRECEDING))"
    return with_views(body, "v_unit", recursive=True, **_PLAN, ranked=ranked)


ORACLES = {
    "win07_greedy_batches": with_views("SELECT run, batch, pack FROM walk", "v_batch", recursive=True, **{
        "o": "SELECT run, batch, units, row_number() OVER (PARTITION BY run ORDER BY batch) AS k FROM v_batch",
        "walk(run, batch, k, pack, size, n)": "SELECT run, batch, k, 0::BIGINT, units, 1::BIGINT FROM o WHERE k = 1 UNION ALL SELECT o.run, o.batch, o.k, CASE WHEN w.size + o.units > 100 OR w.n >= 30 THEN w.pack + 1 ELSE w.pack END, CASE WHEN w.size + o.units > 100 OR w.n >= 30 THEN o.units ELSE w.size + o.units END, CASE WHEN w.size + o.units > 100 OR w.n >= 30 THEN 1 ELSE w.n + 1 END FROM walk w JOIN o ON o.run = w.run AND o.k = w.k + 1"}),
    "exe09_batch_plan": _plan_sql(f"SELECT run, kind, {sql_case('kind', KIND_DOMAIN)} AS domain, pack, units, chars, mean_risk, CAST(place AS INTEGER) AS place, taken, least_unit FROM ranked", RUN_BATCHES, RUN_UNITS),
    "exe12_bound_disclosure": _plan_sql("SELECT run, batches, taken, units, reached, CASE WHEN units = reached THEN 'every unit is in a batch that runs' ELSE reached || ' of ' || units || ' units in ' || taken || ' of ' || batches || ' batches; ' || (units - reached) || ' are not examined' END AS statement FROM (SELECT run, count(*) AS batches, count(*) FILTER (taken) AS taken, CAST(sum(units) AS BIGINT) AS units, CAST(coalesce(sum(units) FILTER (taken), 0) AS BIGINT) AS reached FROM ranked GROUP BY run)", 12, 200),
    "join13_patched_attributes": with_views("""SELECT u.unit_id, kind, coalesce(m.v, ['GET', 'DELETE', 'put', 'PATCH', 'post'][u.unit_id % 5 + 1]) AS method, s.v AS status, t.v AS tax, concat_ws(',', CASE WHEN m.d THEN 'method' END, CASE WHEN s.d THEN 'status' END) AS conflicts FROM v_unit u
 LEFT JOIN last m ON m.unit_id = u.unit_id AND m.name = 'method' LEFT JOIN last s ON s.unit_id = u.unit_id AND s.name = 'status' LEFT JOIN last t ON t.unit_id = u.unit_id AND t.name = 'tax'""", "v_unit",
        each="SELECT l_orderkey AS unit_id, l_linenumber AS producer, l_partkey AS seq, 'status' AS name, l_linestatus AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'method', 'm' || l_suppkey % 2 FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax', 'high' FROM lineitem WHERE l_tax > 0.05",
        last="SELECT unit_id, name, arg_max(v, {'a': producer, 'b': seq, 'c': v}) AS v, min(v) <> max(v) AS d FROM each GROUP BY unit_id, name"),
    "join24_schema_excerpt": """WITH cols AS (SELECT DISTINCT p_brand AS name, p_name AS col FROM part), known AS (SELECT name, count(*) AS n, list_sort(list(col)) AS held FROM cols GROUP BY name),
 uses AS (SELECT l_suppkey % 50 AS batch, 'Brand#' || l_partkey % 30 AS name, count(*) AS uses FROM lineitem GROUP BY ALL),
 ranked AS (SELECT batch, name, uses, n, held, row_number() OVER (PARTITION BY batch ORDER BY uses DESC, name) AS place FROM uses JOIN known USING (name) QUALIFY place <= 12)
 SELECT batch, name, CAST(place AS INTEGER) AS place, uses, coalesce(array_to_string(held[1:greatest(0, least(n, 40 - coalesce(sum(n) OVER (PARTITION BY batch ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::INTEGER], ','), '') AS columns FROM ranked""",
    "agg44_recomposed_totals": with_views("""SELECT t.domain, greatest(n, skipped) AS units_total, greatest(n, skipped) - skipped AS units_audited, skipped, no_verdict, inconclusive, budget, failed, cancelled FROM (SELECT domain, count(*) AS n FROM u GROUP BY domain) t JOIN
 (SELECT domain, count(*) AS skipped, count(*) FILTER (c = 'no-verdict') AS no_verdict, count(*) FILTER (c = 'inconclusive') AS inconclusive, count(*) FILTER (c = 'budget') AS budget, count(*) FILTER (c = 'failed') AS failed, count(*) FILTER (c = 'cancelled') AS cancelled FROM
 (SELECT domain, cause AS c FROM u WHERE cause <> 'audited' AND unit_id % 3 <> 0 UNION ALL SELECT domain, CASE WHEN unit_id % 5 = 0 THEN 'failed' ELSE 'no-verdict' END FROM u WHERE cause <> 'audited' AND unit_id % 3 = 0 AND unit_id % 2 = 0) GROUP BY domain) k USING (domain)""", "v_unit", u=f"SELECT *, {sql_case('kind', KIND_DOMAIN)} AS domain FROM v_unit"),
}
