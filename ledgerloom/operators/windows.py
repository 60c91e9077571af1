"""Window-like operators: budget prefixes, packing, progress, entry ends, first claims, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scales import round_half_up
from ledgerloom.operators.planning import packed
from ledgerloom.sources.views import batches, lines, table, units, with_int, with_views


def within_budget(rows: DataFrame, most_batches: int = 40, most_units: int = 300) -> DataFrame:
    """Batches of a run by duration until one doesn't fit; the first is always taken, later smaller ones never."""
    order = Window.partitionBy("run").orderBy(F.desc("duration"), "batch")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("total", F.sum("units").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("place") <= most_batches) & ((F.col("total") <= most_units) | (F.col("place") == 1))
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ok", F.min(fits.cast("int")).over(before)).where("ok = 1").select("run", "batch", "place", "total")


def greedy_batches(rows: DataFrame, most: int = 100, most_rows: int = 30) -> DataFrame:
    """Rows of a run in order fill batches of at most `most` size and most_rows rows; a larger row is alone."""
    return packed(rows.select("run", "batch", "units"), ["run"], ["batch"], "units", most, most_rows).select("run", "batch", "pack")


def progress(rows: DataFrame, fan_out: int = 2, least: int = 4) -> DataFrame:
    """Running counts and estimated seconds left of a run after each batch; none before four samples, or as many as run at once.

    Durations are summed in whole milliseconds, so the mean doesn't depend on the order of addition.
    """
    order = Window.partitionBy("run").orderBy("at", "batch")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"done": F.count("*").over(upto), "failed": F.count_if(F.col("status") == "failed").over(upto), "spent": F.sum(F.floor(F.col("duration") * 1000 + 0.5)).over(upto), "total": F.count("*").over(Window.partitionBy("run"))})
    left = F.ceil((F.col("total") - F.col("done")) / fan_out)
    return rows.select("run", "batch", "done", "failed", F.when(F.col("done") >= max(least, fan_out), round_half_up((F.col("spent") * left).cast("double") / (F.col("done") * 1000), 1)).alias("eta"))


def entry_ends(rows: DataFrame) -> DataFrame:
    """An entry of a file ends before the next one, the last at the file's end."""
    starts = rows.where("line rlike '^[A-ZÀ-Ý]'")
    ends = rows.groupBy("doc_id").agg(F.max("line_no").alias("last"))
    nxt = F.lead("line_no").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return starts.withColumn("next", nxt).join(ends, "doc_id").select("doc_id", F.col("line_no").alias("start"), F.coalesce(F.col("next") - 1, F.col("last")).alias("stop"))


def first_claims(rows: DataFrame) -> DataFrame:
    """Of units with one place the first claims it; later ones are dropped with the claimer's id."""
    place = Window.partitionBy("file", "line", "kind").orderBy("unit_id")
    return rows.withColumn("claimed_by", F.first("unit_id").over(place)).withColumn("n", F.row_number().over(place)).select("unit_id", "claimed_by", (F.col("n") == 1).alias("kept"))


def widest_per_line(rows: DataFrame) -> DataFrame:
    """The longest text of equal first words in a document; a tie goes to the first line."""
    word = F.regexp_extract("line", "^(\\S+)", 1)
    order = Window.partitionBy("doc_id", "word").orderBy(F.desc(F.char_length("line")), "line_no")
    return rows.withColumn("word", word).withColumn("n", F.row_number().over(order)).where("n = 1").select("doc_id", "word", "line_no")


def ordinals(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("run").orderBy("at", "unit_id"))).select("run", "unit_id", "ordinal")


def capped(rows: DataFrame, limit: int = 500) -> DataFrame:
    """At most limit units of a kind, with the number beyond the limit."""
    order = Window.partitionBy("kind").orderBy("file", "line", "unit_id")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("all", F.count("*").over(Window.partitionBy("kind")))
    return rows.where(F.col("n") <= limit).select("kind", "unit_id", F.greatest(F.col("all") - limit, F.lit(0)).alias("overflow"))


def sequential_pairs(rows: DataFrame, seconds: int = 60) -> DataFrame:
    """Adjacent batches of a run that start within a minute of each other."""
    order = Window.partitionBy("run").orderBy("at", "batch")
    gap = F.unix_micros(F.col("at")) - F.unix_micros(F.lag("at").over(order))
    return rows.withColumn("before", F.lag("batch").over(order)).withColumn("gap", gap).where(F.col("gap") <= seconds * 1_000_000).select("run", "before", "batch")


def picked_statement(rows: DataFrame) -> DataFrame:
    """The most common text of a kind; a tie goes to the first in the alphabet."""
    n = rows.groupBy("kind", "segment").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "segment")
    return n.withColumn("p", F.row_number().over(order)).where("p = 1").select("kind", F.col("segment").alias("statement"), "n")


def latest_reply(rows: DataFrame) -> DataFrame:
    """The last turn of each conversation and how many came before."""
    return rows.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"), F.count("*").alias("turns"))


QUERIES = {
    "win06_budget_prefix": lambda s, d: within_budget(batches(s, d)),
    "win14_progress": lambda s, d: progress(batches(s, d)),
    "win13_entry_ends": lambda s, d: entry_ends(lines(s, d)),
    "win18_first_claims": lambda s, d: first_claims(units(s, d)),
    "win03_widest_per_line": lambda s, d: widest_per_line(lines(s, d)),
    "win04_ordinals": lambda s, d: ordinals(units(s, d)),
    "srt09_capped_units": lambda s, d: capped(units(s, d)),
    "win10_sequential_pairs": lambda s, d: sequential_pairs(batches(s, d)),
    "agg23_picked_statement": lambda s, d: picked_statement(units(s, d)),
    "win15_latest_reply": lambda s, d: latest_reply(table(s, d, "conversations")),
}
ORACLES = {
    "win06_budget_prefix": with_views("SELECT run, batch, place, total FROM (SELECT *, min(CASE WHEN place <= 40 AND (total <= 300 OR place = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY place) AS ok FROM (SELECT *, row_number() OVER w AS place, CAST(sum(units) OVER w AS BIGINT) AS total FROM v_batch WINDOW w AS (PARTITION BY run ORDER BY duration DESC, batch ROWS UNBOUNDED PRECEDING))) WHERE ok = 1", "v_batch"),
    "win14_progress": with_views("SELECT run, batch, done, failed, CASE WHEN done >= 4 THEN floor(spent * CAST(ceil((total - done) / 2) AS BIGINT) / (done * 1000) * 10 + 0.5) / 10 END AS eta FROM (SELECT *, count(*) OVER w AS done, count(*) FILTER (status = 'failed') OVER w AS failed, CAST(sum(CAST(floor(duration * 1000 + 0.5) AS BIGINT)) OVER w AS BIGINT) AS spent, count(*) OVER (PARTITION BY run) AS total FROM v_batch WINDOW w AS (PARTITION BY run ORDER BY \"at\", batch ROWS UNBOUNDED PRECEDING))", "v_batch"),
    "win13_entry_ends": with_views("SELECT doc_id, line_no AS start, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) - 1, last) AS stop FROM (SELECT * FROM v_line WHERE regexp_matches(line, '^[A-ZÀ-Ý]')) JOIN (SELECT doc_id, max(line_no) AS last FROM v_line GROUP BY doc_id) USING (doc_id)", "v_line"),
    "win18_first_claims": with_views("SELECT unit_id, min(unit_id) OVER p AS claimed_by, unit_id = min(unit_id) OVER p AS kept FROM v_unit WINDOW p AS (PARTITION BY file, line, kind)", "v_unit"),
    "win03_widest_per_line": with_views("SELECT doc_id, word, line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY length(line) DESC, line_no) AS n FROM (SELECT *, regexp_extract(line, '^([^\\s]+)', 1) AS word FROM v_line)) WHERE n = 1", "v_line"),
    "win04_ordinals": with_views("SELECT run, unit_id, row_number() OVER (PARTITION BY run ORDER BY \"at\", unit_id) AS ordinal FROM v_unit", "v_unit"),
    "srt09_capped_units": with_views("SELECT kind, unit_id, greatest(total - 500, 0) AS overflow FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY file, line, unit_id) AS n, count(*) OVER (PARTITION BY kind) AS total FROM v_unit) WHERE n <= 500", "v_unit"),
    "win10_sequential_pairs": with_views("SELECT run, before, batch FROM (SELECT *, lag(batch) OVER w AS before, epoch_us(\"at\") - lag(epoch_us(\"at\")) OVER w AS gap FROM v_batch WINDOW w AS (PARTITION BY run ORDER BY \"at\", batch)) WHERE gap <= 60000000", "v_batch"),
    "agg23_picked_statement": with_views("SELECT kind, segment AS statement, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, segment) AS p FROM (SELECT kind, segment, count(*) AS n FROM v_unit GROUP BY ALL)) WHERE p = 1", "v_unit"),
    "win15_latest_reply": "SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, count(*) AS turns FROM conversations GROUP BY conv_id",
}
ORACLES["win06_budget_prefix"] = with_int(ORACLES["win06_budget_prefix"], "place")
ORACLES["win04_ordinals"] = with_int(ORACLES["win04_ordinals"], "ordinal")
