"""Audit tables as views of the driver's star schema, with the same projection as DuckDB SQL.

The mapping is a convention of the tests: every operator takes any DataFrame with these columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scales import CONFIDENCES, DOMAINS, SEVERITIES, UNIT_KINDS, rank_of, sql_case, text_hash

_SEVERITY = dict(zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), SEVERITIES, strict=True))
_CONFIDENCE = dict(zip("ANR", CONFIDENCES, strict=True))
_RULES = {"appsec": "appsec.hardcoded-secret", "dependencies": "dependencies.vulnerable-package", "data": "data.destructive-migration"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, place):
    return F.element_at(F.array(*map(F.lit, values)), place.cast("int") + 1)


def _case(column, mapping):
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    domain = _pick(DOMAINS, F.col("l_partkey") % 8)
    rows = rows.select(
        F.col("o_custkey").alias("run"),
        domain.alias("domain"),
        F.when((F.col("l_partkey") % 5 == 0) & domain.isin(*_RULES), _case(domain, _RULES))
        .otherwise(F.concat(domain, F.lit(".rule-"), (F.col("l_partkey") % 5).cast("string")))
        .alias("rule"),
        _case(F.col("o_orderpriority"), _SEVERITY).alias("severity"),
        _case(F.col("l_returnflag"), _CONFIDENCE).alias("confidence"),
        F.concat(F.lit("supp/"), F.col("l_suppkey").cast("string")).alias("file"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.col("l_partkey").cast("string").alias("symbol"),
        F.col("l_linestatus").alias("source"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" on "), F.col("l_linestatus")).alias("description"),
        F.concat(F.lit("review "), F.col("l_suppkey").cast("string")).alias("recommendation"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_quantity").cast("int") % 6).alias("n_evidence"),
        (F.col("l_suppkey") % 6).cast("int").alias("n_criteria"),
        (F.col("l_partkey") % 7).cast("int").alias("n_tags"),
        (F.col("l_discount") >= 0.05).alias("exploitable"),
        (F.col("l_tax") >= 0.04).alias("has_snippet"),
        (F.col("l_linenumber") % 2 == 0).alias("has_end"),
    )
    return rows.select(
        text_hash("\x1f", F.col("domain"), F.col("rule"), F.col("file"), F.col("symbol")).alias("id"),
        "*",
        rank_of(F.col("severity"), SEVERITIES).alias("sev"),
        rank_of(F.col("confidence"), CONFIDENCES).alias("conf"),
        rank_of(F.col("domain"), DOMAINS).alias("dom"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("unit_id"),
        F.col("o_custkey").alias("run"),
        _pick(UNIT_KINDS, F.col("o_custkey") % 11).alias("kind"),
        F.concat(F.lit("src/"), (F.col("o_custkey") % 97).cast("string")).alias("file"),
        (F.col("o_orderkey") % 500).cast("int").alias("line"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderdate").alias("at"),
        _pick(("audited", "no-verdict", "inconclusive"), F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")) - 1).alias("cause"),
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned checks of a run's domains and whether each ran."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("check"), F.col("o_custkey").alias("run"), _pick(DOMAINS, F.col("o_orderkey") % 8).alias("domain"), (F.col("o_orderpriority") != "5-LOW").alias("ran")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("s_suppkey").alias("step"),
        F.col("n_regionkey").alias("run"),
        _pick(DOMAINS, F.col("s_nationkey") % 8).alias("domain_a"),
        _pick(DOMAINS, (F.col("s_nationkey") + 3) % 8).alias("domain_b"),
        F.when(F.col("s_acctbal") < 0, F.lit("failed")).when(F.col("s_acctbal") < 2500, F.lit("degraded")).when(F.col("s_acctbal") < 4000, F.lit("skipped")).otherwise(F.lit("ok")).alias("status"),
        F.col("n_name").alias("reason"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = F.split(F.col("text"), r"\r\n|\n|\r")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return docs.select("doc_id", F.posexplode(kept).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("batch"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("user_id").alias("run"),
        F.col("value").alias("duration"),
        (F.col("event_id") % 30 + 1).alias("units"),
        F.when(F.col("event_type") == "error", F.lit("failed")).when(F.col("event_type") == "signup", F.lit("partial")).otherwise(F.lit("ok")).alias("status"),
    )


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human verdicts of documents: wrong, overstated, unclear and right by the two labels."""
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit("false"))
        .when((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit("overstated"))
        .when(F.col("toxic") == 1, F.lit("unclear"))
        .otherwise(F.lit("true"))
        .alias("verdict"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ranges of a file: container spans (kind host) and inner ones."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("span"),
        F.col("l_orderkey").alias("file"),
        (F.col("l_linenumber") % 3 == 0).alias("inner"),
        (F.col("l_partkey") % 100).cast("int").alias("start"),
        (F.col("l_partkey") % 100 + F.col("l_quantity").cast("int") * F.when(F.col("l_linenumber") % 3 == 0, F.lit(1)).otherwise(F.lit(2))).cast("int").alias("stop"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest: every part depends on the part of half its number."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"), F.col("p_brand").alias("brand")
    )


_D, _K = ", ".join(f"'{x}'" for x in DOMAINS), ", ".join(f"'{x}'" for x in UNIT_KINDS)
_sev, _conf, _dom = ({w: i for i, w in enumerate(s)} for s in (SEVERITIES, CONFIDENCES, DOMAINS))

VIEW_SQL = {
    "v_finding": f"""
SELECT substr(sha256(domain || chr(31) || rule || chr(31) || file || chr(31) || symbol), 1, 16) AS id, *,
       {sql_case("severity", _sev, "5")} AS sev, {sql_case("confidence", _conf, "3")} AS conf, {sql_case("domain", _dom, "8")} AS dom
FROM (SELECT *, CASE WHEN part % 5 = 0 AND domain IN ('appsec', 'dependencies', 'data') THEN {sql_case("domain", _RULES)}
              ELSE domain || '.rule-' || CAST(part % 5 AS VARCHAR) END AS rule
      FROM (SELECT o_custkey AS run, l_partkey AS part, [{_D}][l_partkey % 8 + 1] AS domain,
             {sql_case("o_orderpriority", _SEVERITY)} AS severity, {sql_case("l_returnflag", _CONFIDENCE)} AS confidence,
             'supp/' || CAST(l_suppkey AS VARCHAR) AS file, CAST(l_linenumber AS INTEGER) AS line, CAST(l_partkey AS VARCHAR) AS symbol,
             l_linestatus AS source, 'order ' || CAST(l_orderkey AS VARCHAR) AS title, 'part ' || CAST(l_partkey AS VARCHAR) || ' on ' || l_linestatus AS description, 'review ' || CAST(l_suppkey AS VARCHAR) AS recommendation, CAST(trunc(l_quantity) AS INTEGER) AS quantity,
             CAST(trunc(l_quantity) AS INTEGER) % 6 AS n_evidence, CAST(l_suppkey % 6 AS INTEGER) AS n_criteria, CAST(l_partkey % 7 AS INTEGER) AS n_tags,
             l_discount >= 0.05 AS exploitable, l_tax >= 0.04 AS has_snippet, l_linenumber % 2 = 0 AS has_end
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey))""",
    "v_unit": f"""
SELECT o_orderkey AS unit_id, o_custkey AS run, [{_K}][o_custkey % 11 + 1] AS kind, 'src/' || CAST(o_custkey % 97 AS VARCHAR) AS file,
       CAST(o_orderkey % 500 AS INTEGER) AS line, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority,
       c_mktsegment AS segment, o_orderdate AS at, CASE o_orderstatus WHEN 'F' THEN 'audited' WHEN 'O' THEN 'no-verdict' WHEN 'P' THEN 'inconclusive' END AS cause
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_check": f"SELECT o_orderkey AS check_, o_custkey AS run, [{_D}][o_orderkey % 8 + 1] AS domain, o_orderpriority <> '5-LOW' AS ran FROM orders",
    "v_run": "SELECT c_custkey AS run FROM customer",
    "v_step": f"""
SELECT s_suppkey AS step, n_regionkey AS run, [{_D}][s_nationkey % 8 + 1] AS domain_a, [{_D}][(s_nationkey + 3) % 8 + 1] AS domain_b,
       CASE WHEN s_acctbal < 0 THEN 'failed' WHEN s_acctbal < 2500 THEN 'degraded' WHEN s_acctbal < 4000 THEN 'skipped' ELSE 'ok' END AS status,
       n_name AS reason
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_line": """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, parts[line_no] AS line
FROM (SELECT doc_id, parts, unnest(range(1, 1 + len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END)) AS line_no
      FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM documents))""",
    "v_batch": """
SELECT event_id AS batch, ts AS at, user_id AS run, value AS duration, event_id % 30 + 1 AS units,
       CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'partial' ELSE 'ok' END AS status FROM events""",
    "v_triage": """
SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'false' WHEN quality = 0 AND toxic = 1 THEN 'overstated'
                    WHEN toxic = 1 THEN 'unclear' ELSE 'true' END AS verdict FROM labels""",
    "v_span": """
SELECT l_orderkey * 8 + l_linenumber AS span, l_orderkey AS file, l_linenumber % 3 = 0 AS inner_, CAST(l_partkey % 100 AS INTEGER) AS start,
       CAST(l_partkey % 100 + CAST(trunc(l_quantity) AS INTEGER) * CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS stop FROM lineitem""",
    "v_edge": "SELECT p_partkey AS child, p_partkey // 2 AS parent, p_brand AS brand FROM part",
}


def with_views(body: str, *names: str, recursive: bool = False, **more: str) -> str:
    """A DuckDB statement over the named views and further common table expressions."""
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in names] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def with_int(sql: str, column: str) -> str:
    """The statement with one column as INTEGER, the type of Spark's row numbers."""
    return f"SELECT * REPLACE (CAST({column} AS INTEGER) AS {column}) FROM ({sql})"


Query = Callable[[SparkSession, str], DataFrame]
