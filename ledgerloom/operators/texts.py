"""Operators over lines, secrets, paths, names and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import entropy, glob_to_regex, shortened, slug, split_words
from ledgerloom.operators.grading import PUBLIC_NAMES, SECRET_NAMES, secret_name_role, secret_value_shape
from ledgerloom.sources.views import batches, lines, table, with_views

_SECRET = r'(\w+) = "([0-9a-f]{20,})"'
MASK = "********"


def secrets(rows: DataFrame) -> DataFrame:
    """Secret assignments in lines with entropy, shape, role and grade, and the line with the value masked wherever it stands.

    The shape goes by the entropy as it is shown, rounded to three places.
    """
    hit = rows.select("doc_id", "line_no", "line", F.regexp_extract("line", _SECRET, 1).alias("name"), F.regexp_extract("line", _SECRET, 2).alias("value")).where("value <> ''")
    hit = hit.withColumn("bits", F.floor(entropy(F.col("value")) * 1000 + 0.5) / 1000)
    hit = hit.withColumns({"shape": secret_value_shape(F.col("value"), F.col("bits")), "role": secret_name_role(F.col("name"))})
    grade = F.when(F.col("shape") != "credible", "info").when(F.col("role") == "identifier", "low").otherwise("high")
    masked = F.replace("line", F.col("value"), F.lit(MASK))
    return hit.select("doc_id", "line_no", "name", "bits", "shape", "role", grade.alias("severity"), masked.alias("masked"))


def secret_groups(rows: DataFrame) -> DataFrame:
    """Hits of one value in one document: number and first line."""
    hit = rows.withColumn("value", F.regexp_extract("line", _SECRET, 2)).where("value <> ''")
    return hit.groupBy("doc_id", F.substring(F.sha2("value", 256), 1, 16).alias("fingerprint")).agg(F.count("*").alias("hits"), F.min("line_no").alias("first_line"))


def snippets(rows: DataFrame, refs: DataFrame, context: int = 3, width: int = 60) -> DataFrame:
    """Lines around each cited one, cut to a width, with line numbers and a mark."""
    near = refs.join(rows, "doc_id").where(F.abs(F.col("line_no") - F.col("cited")) <= context)
    mark = F.when(F.col("line_no") == F.col("cited"), F.lit(">")).otherwise(F.lit(" "))
    shown = F.concat(mark, F.col("line_no").cast("string"), F.lit(" "), shortened(F.col("line"), width))
    each = near.groupBy("doc_id", "cited").agg(F.array_sort(F.collect_list(F.struct("line_no", shown.alias("s")))).alias("x"))
    return each.select("doc_id", "cited", F.array_join(F.transform("x", lambda v: v["s"]), "\n").alias("snippet"))


def binary_share(rows: DataFrame) -> DataFrame:
    """Texts that look binary: a NUL, or over 30 % control bytes among the first 8000 bytes."""
    head = F.decode(F.substring(F.encode("text", "UTF-8"), 1, 8000), "ISO-8859-1")
    control = F.regexp_count(head, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    return rows.select("doc_id", (F.contains(head, F.lit("\x00")) | (control > F.char_length(head) * 0.3)).alias("binary"))


def page_paths(rows: DataFrame) -> DataFrame:
    """Path of a url, its language directory, file kind and slug; in scope by a glob."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1)
    rows = rows.select("page_id", path.alias("path"))
    kind = F.when(F.col("path").rlike(r"\.html$"), "page").when(F.col("path").rlike("/$"), "directory").otherwise("entry")
    return rows.select("page_id", "path", kind.alias("kind"), slug(F.col("path")).alias("slug"), F.col("path").rlike(glob_to_regex("/en/**")).alias("in_scope"))


def names(rows: DataFrame) -> DataFrame:
    """Words of part names written as identifiers, and the name cut to a width."""
    camel = F.regexp_replace(F.initcap("p_name"), " ", "")
    return rows.select("p_partkey", F.array_join(split_words(F.concat(camel, F.lit("_v2"))), " ").alias("words"), shortened(F.col("p_name"), 10).alias("short"))


def run_stamps(rows: DataFrame) -> DataFrame:
    """Run id of a time, and the time back from it."""
    stamp = F.date_format("at", "yyyyMMdd'T'HHmmss")
    return rows.select("batch", stamp.alias("run_id"), F.unix_timestamp(F.to_timestamp(stamp, "yyyyMMdd'T'HHmmss")).alias("seconds"))


def _refs(s, d):
    return lines(s, d).where("line_no % 9 = 4").select("doc_id", F.col("line_no").alias("cited"))


QUERIES = {
    "src02_lines": lambda s, d: lines(s, d),
    "prj14_secrets": lambda s, d: secrets(lines(s, d)),
    "agg26_secret_groups": lambda s, d: secret_groups(lines(s, d)),
    "prj42_snippets": lambda s, d: snippets(lines(s, d), _refs(s, d)),
    "src03_binary": lambda s, d: binary_share(table(s, d, "documents")),
    "prj41_page_paths": lambda s, d: page_paths(table(s, d, "pages")),
    "prj29_names": lambda s, d: names(table(s, d, "part")),
    "scl16_run_stamps": lambda s, d: run_stamps(batches(s, d)),
}
_SEC = """SELECT doc_id, line_no, line, regexp_extract(line, '(\\w+) = "([0-9a-f]{20,})"', 1) AS name, regexp_extract(line, '(\\w+) = "([0-9a-f]{20,})"', 2) AS value FROM v_line
 WHERE regexp_matches(line, '(\\w+) = "([0-9a-f]{20,})"')"""
_BITS = "floor(-list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: (len(value) - len(replace(value, c, ''))) / len(value) * log2((len(value) - len(replace(value, c, ''))) / len(value)))) * 1000 + 0.5) / 1000"
ORACLES = {
    "src02_lines": with_views("SELECT * FROM v_line", "v_line"),
    "prj14_secrets": with_views(f"""SELECT doc_id, line_no, name, bits, shape, role, CASE WHEN shape <> 'credible' THEN 'info' WHEN role = 'identifier' THEN 'low' ELSE 'high' END AS severity, masked FROM
 (SELECT *, CASE WHEN regexp_matches(value, '^[0-9]+$') OR bits < 3 THEN 'trivial' ELSE 'credible' END AS shape, CASE WHEN regexp_matches(n, '{"|".join(PUBLIC_NAMES)}') THEN 'identifier' WHEN regexp_matches(n, '{"|".join(SECRET_NAMES)}') THEN 'secret' ELSE 'unknown' END AS role,
  replace(line, value, '{MASK}') AS masked FROM (SELECT *, {_BITS} AS bits, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS n FROM sec))""", "v_line", sec=_SEC),
    "agg26_secret_groups": with_views("SELECT doc_id, substr(sha256(value), 1, 16) AS fingerprint, count(*) AS hits, min(line_no) AS first_line FROM sec GROUP BY ALL", "v_line", sec=_SEC),
    "prj42_snippets": with_views("SELECT r.doc_id, r.cited, string_agg(CASE WHEN l.line_no = r.cited THEN '>' ELSE ' ' END || l.line_no || ' ' || CASE WHEN length(l.line) > 60 THEN substr(l.line, 1, 59) || '…' ELSE l.line END, chr(10) ORDER BY l.line_no) AS snippet FROM (SELECT doc_id, line_no AS cited FROM v_line WHERE line_no % 9 = 4) r JOIN v_line l ON l.doc_id = r.doc_id AND abs(l.line_no - r.cited) <= 3 GROUP BY ALL", "v_line"),
    "src03_binary": "SELECT doc_id, list_contains(b, '00') OR len(list_filter(b, lambda x: x IN ('0B', '0C', '7F') OR (x < '20' AND x NOT IN ('00', '09', '0A', '0D')))) > len(b) * 0.3 AS \"binary\" FROM (SELECT doc_id, regexp_extract_all(substr(hex(encode(text)), 1, 16000), '..') AS b FROM documents)",
    "prj41_page_paths": "SELECT page_id, path, CASE WHEN regexp_matches(path, '\\.html$') THEN 'page' WHEN regexp_matches(path, '/$') THEN 'directory' ELSE 'entry' END AS kind, regexp_replace(regexp_replace(lower(trim(path)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, starts_with(path, '/en/') AS in_scope FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages)",
    "prj29_names": "SELECT p_partkey, lower(p_name) || ' v2' AS words, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 9) || '…' ELSE p_name END AS short FROM part",
    "scl16_run_stamps": with_views("SELECT batch, strftime(\"at\", '%Y%m%dT%H%M%S') AS run_id, epoch(date_trunc('second', \"at\"))::BIGINT AS seconds FROM v_batch", "v_batch"),
}
