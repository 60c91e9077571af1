"""Scope filters, volume hiding, set operations that keep order, references and their resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scales import UNIT_KINDS, rank_of
from ledgerloom.functions.text import glob_to_regex
from ledgerloom.operators.normalise import volume_examples, volume_groups
from ledgerloom.sources.views import batches, findings, lines, table, units, with_int, with_views

GREP_LIMIT = 200


def in_scope(rows: DataFrame, selectors: list[str]) -> DataFrame:
    """Rows with whether a selector holds their file: a directory prefix, or a glob where it has a star."""
    hit = F.lit(False)
    for s in selectors:
        hit = hit | (F.col("file").rlike(glob_to_regex(s)) if "*" in s or "?" in s else (F.col("file") == s) | F.col("file").startswith(s.rstrip("/") + "/"))
    return rows.withColumn("in_scope", hit)


def production_only(rows: DataFrame) -> DataFrame:
    """Number of units of each kind that stay, and that go as non-production where the kind depends on the path."""
    test = F.col("file").rlike("/[0-9]*[05]$") & F.col("kind").isin("route", "sink", "role-gate", "data-access")
    return rows.groupBy("kind").agg(F.count_if(~test).alias("kept"), F.count_if(test).alias("dropped"))


def grep(rows: DataFrame, pattern: str, limit: int = GREP_LIMIT) -> DataFrame:
    """The first hits in order of document and line; the limit is part of the operator."""
    return rows.where(F.col("line").rlike(pattern)).orderBy("doc_id", "line_no").limit(limit).select("doc_id", "line_no")


def hidden_by_volume(rows: DataFrame) -> DataFrame:
    """Members of a volume group that aren't its examples, counted by group."""
    groups = volume_groups(rows).select("domain", "rule", "members")
    shown = volume_examples(rows).groupBy("domain", "rule").agg(F.count("*").alias("shown"))
    return groups.join(shown, ["domain", "rule"]).select("domain", "rule", (F.col("members") - F.col("shown")).alias("hidden"))


def ordered_union(rows: DataFrame) -> DataFrame:
    """Union of two lists of words in order of first appearance."""
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    return rows.select("p_partkey", F.array_join(F.array_distinct(F.concat(a, b)), " ").alias("words"))


def without_agent(rows: DataFrame) -> DataFrame:
    return rows.where("source <> 'F'").groupBy("run").agg(F.count("*").alias("findings"))


def units_of_batches(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    each = rows.select("run", "batch", F.explode(F.sequence(F.col("batch"), F.col("batch") + F.col("units") % 4)).alias("unit"))
    return each.join(wanted, "batch", "left_semi").select("run", "unit").distinct()


def fact_topics(rows: DataFrame, topics: list[str]) -> DataFrame:
    """Facts of the wanted topics: equal to the kind, its first or its last dotted part."""
    kind = F.regexp_replace(F.lower("p_type"), " ", ".")
    want = F.array(*map(F.lit, topics))
    parts = F.split(kind, r"\.")
    return rows.select("p_partkey", kind.alias("kind")).where(F.array_contains(want, kind) | F.array_contains(want, parts[0]) | F.array_contains(want, F.element_at(parts, -1)))


def unit_order(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("run").orderBy(rank_of(F.col("kind"), UNIT_KINDS), "file", "line", "unit_id")
    return rows.select("run", "unit_id", F.row_number().over(order).alias("place"))


_SCOPE = ["src/1", "src/2*", "src/77"]
QUERIES = {
    "flt01_scope": lambda s, d: in_scope(units(s, d), _SCOPE).groupBy("file", "in_scope").agg(F.count("*").alias("n")),
    "flt03_production_only": lambda s, d: production_only(units(s, d)),
    "flt10_grep": lambda s, d: grep(lines(s, d), r"\b(token|password) = "),
    "flt15_hidden_by_volume": lambda s, d: hidden_by_volume(findings(s, d)),
    "set02_ordered_union": lambda s, d: ordered_union(table(s, d, "part")),
    "set05_without_agent": lambda s, d: without_agent(findings(s, d)),
    "set09_units_of_batches": lambda s, d: units_of_batches(batches(s, d), batches(s, d).where("status = 'failed'").select("batch")),
    "join25_fact_topics": lambda s, d: fact_topics(table(s, d, "part"), ["economy", "brass", "small.plated.tin"]),
    "srt03_unit_order": lambda s, d: unit_order(units(s, d)),
}
_KR = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(UNIT_KINDS)) + " END"
ORACLES = {
    "flt01_scope": with_views("SELECT file, (file = 'src/1' OR starts_with(file, 'src/1/') OR regexp_matches(file, '^src/2[^/]*$') OR file = 'src/77') AS in_scope, count(*) AS n FROM v_unit GROUP BY ALL", "v_unit"),
    "flt03_production_only": with_views("SELECT kind, count(*) FILTER (NOT t) AS kept, count(*) FILTER (t) AS dropped FROM (SELECT kind, regexp_matches(file, '/[0-9]*[05]$') AND kind IN ('route', 'sink', 'role-gate', 'data-access') AS t FROM v_unit) GROUP BY kind", "v_unit"),
    "flt10_grep": with_views("SELECT doc_id, line_no FROM v_line WHERE regexp_matches(line, '\\b(token|password) = ') ORDER BY doc_id, line_no LIMIT 200", "v_line"),
    "flt15_hidden_by_volume": with_views("SELECT domain, rule, count(*) - least(count(*), 5) AS hidden FROM v_finding WHERE severity IN ('low', 'info') GROUP BY domain, rule HAVING count(*) > 25", "v_finding"),
    "set02_ordered_union": "SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT p_partkey, w, min(i) AS i FROM (SELECT p_partkey, unnest(string_split(lower(p_name) || ' ' || lower(p_type), ' ')) AS w, generate_subscripts(string_split(lower(p_name) || ' ' || lower(p_type), ' '), 1) AS i FROM part) GROUP BY p_partkey, w) GROUP BY p_partkey",
    "set05_without_agent": with_views("SELECT run, count(*) AS findings FROM v_finding WHERE source <> 'F' GROUP BY run", "v_finding"),
    "set09_units_of_batches": with_views("SELECT DISTINCT run, unnest(range(batch, batch + units % 4 + 1)) AS unit FROM v_batch WHERE status = 'failed'", "v_batch"),
    "join25_fact_topics": "SELECT p_partkey, kind FROM (SELECT p_partkey, replace(lower(p_type), ' ', '.') AS kind FROM part) WHERE kind IN ('economy', 'brass', 'small.plated.tin') OR split_part(kind, '.', 1) IN ('economy', 'brass') OR string_split(kind, '.')[-1] IN ('economy', 'brass')",
    "srt03_unit_order": with_views(f"SELECT run, unit_id, row_number() OVER (PARTITION BY run ORDER BY {_KR}, file, line, unit_id) AS place FROM v_unit", "v_unit"),
}
ORACLES["srt03_unit_order"] = with_int(ORACLES["srt03_unit_order"], "place")
