"""Source divergence audit: how far the sources of a language are from each other and from the language.

A first pass over the texts counts document frequencies in count-min sketches, merged over all tasks.
Their cells never hold less than the true frequency, so a term whose estimate is below the limit is
impossible and is dropped before the second pass shuffles its counts; the survivors are counted
exactly. Sources are then compared over all kept terms, but only terms that both hold are joined:
what a term adds where a source lacks it follows from the source's histogram of counts.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, read_table

MIN_DOCS, PRIOR, UNIT, TOP = 10, 2, 1_000_000_000, 10
# The sketch: rows of cells of one byte, so 8 MB are sent to all tasks. It has this size for any table;
# a table with more terms than cells loses pruning, never terms.
DEPTH, WIDTH = 2, 1 << 22
_CHUNK = 1 << 16
# Terms held at once by a task before their counts are sent on.
HELD = 400_000
# Sources of a language that one task compares with the histograms of all.
BLOCK = 256

# Bytes of terms (letters, non-ASCII), with A-Z lower-cased; other bytes become spaces.
TERM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_hash = xxhash.xxh3_64_intdigest


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def _cells(lang: str, terms: list[bytes], width: int) -> list[np.ndarray]:
    """The cell of every term in each row of the sketch."""
    seed = _hash(lang.encode("utf-8", "replace")) & 0xFFFFFFFF
    h = np.fromiter((_hash(t, seed) for t in terms), np.uint64, len(terms))
    return [((h >> np.uint64(32 * r)) % np.uint64(width)).astype(np.int64) for r in range(DEPTH)]


def _kind(limit: int):
    return np.uint8 if limit < 256 else np.int32


def frequency_sketch(rows: DataFrame, limit: int, width: int = WIDTH) -> list[np.ndarray]:
    """Merged count-min document frequencies of (lang, term), each cell capped at limit.

    rows has __lang, __source and __text (bytes). Tasks send the chunks of their sketch that are not
    empty, a chunk's copies are added up one after the other, and DEPTH * width cells reach the driver.
    """
    kind = _kind(limit)

    def count(batches):
        cells = np.zeros((DEPTH, width), np.int32)
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[lang].update(set(terms_of(text)))
            for lang, found in seen.items():
                n = np.fromiter(found.values(), np.int32, len(found))
                for row, at in zip(cells, _cells(lang, list(found), width), strict=True):
                    np.add.at(row, at, n)
            np.minimum(cells, limit, out=cells)
        flat = cells.reshape(-1).astype(kind)
        for at in range(0, len(flat), _CHUNK):
            part = flat[at : at + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([at // _CHUNK], pa.int32()), "cells": [zlib.compress(part.tobytes(), 1)]})

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(packed), kind).astype(np.int32)
                total[at] = np.minimum(total[at] + part, limit) if at in total else part
        for at, part in total.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int32()), "cells": [zlib.compress(part.astype(kind).tobytes(), 1)]})

    schema = "chunk int, cells binary"
    merged = rows.select("__lang", "__text").mapInArrow(count, schema).repartition(F.col("chunk")).mapInArrow(merge, schema)
    flat = np.zeros(DEPTH * width, kind)
    for row in merged.collect():
        part = np.frombuffer(zlib.decompress(row["cells"]), kind)
        flat[row["chunk"] * _CHUNK : row["chunk"] * _CHUNK + len(part)] = part
    return list(flat.reshape(DEPTH, width))


def exact_counts(rows: DataFrame, sketch: list[np.ndarray], limit: int, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of all terms that the sketch can't rule out."""
    known = rows.sparkSession.sparkContext.broadcast(sketch)
    names = ["lang", "source", "term", "n", "docs"]

    def flush(counts, docs):
        for (lang, source), found in counts.items():
            terms = list(found)
            cells = _cells(lang, terms, len(known.value[0]))
            possible = np.minimum(*[row[at] for row, at in zip(known.value, cells, strict=True)]) >= limit
            terms = [terms[i] for i in np.flatnonzero(possible)]
            seen = docs[lang, source]
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()),
                        pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([found[t] for t in part], pa.int64()),
                        pa.array([seen[t] for t in part], pa.int64()),
                    ],
                    names,
                )

    def count(batches):
        counts: dict[tuple, Counter] = defaultdict(Counter)
        docs: dict[tuple, Counter] = defaultdict(Counter)
        for batch in batches:
            for *group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = terms_of(text)
                if terms:
                    counts[tuple(group)].update(terms)
                    docs[tuple(group)].update(set(terms))
            if sum(map(len, counts.values())) > held:
                yield from flush(counts, docs)
                counts.clear()
                docs.clear()
        yield from flush(counts, docs)

    each = rows.select("__lang", "__source", "__text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(df: DataFrame, name: str, count: str, total: str, prior: int) -> DataFrame:
    """1 + floor(10**9 * (count + prior) / (total + prior * v)), by long division in steps of 1000: no step overflows."""
    steps, rest = [], f"(({count}) + {prior})"
    whole = f"nullif({total} + {prior} * v, 0)"
    df = df.withColumn("__d", F.expr(whole)).withColumn("__r0", F.expr(rest))
    for k in range(3):
        df = df.withColumn(f"__q{k}", F.expr(f"(__r{k} * 1000) div __d")).withColumn(f"__r{k + 1}", F.expr(f"(__r{k} * 1000) % __d"))
        steps.append(f"__q{k} * {1000 ** (2 - k)}")
    df = df.withColumn(name, F.expr(f"1 + coalesce({' + '.join(steps)}, 0)"))
    return df.drop("__d", *[f"__r{k}" for k in range(4)], *[f"__q{k}" for k in range(3)])


def _gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def source_divergence(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    prior: int = PRIOR,
    top: int = TOP,
    width: int = WIDTH,
) -> DataFrame:
    """lang, source, part, item, value and rank: distances of every source to the others of its language, and its leading terms.

    A language keeps the terms in at least min_docs of its documents. Null text, language and source
    count as empty strings; repeated rows count each; a group without terms has its smoothed shares
    alone; a language without kept terms has pairs of value 0 and no terms; a language of one source
    has no pairs. Equal values are ranked by the item's bytes. Very long texts are counted whole. An
    empty table gives an empty table; further columns aren't read. Exact while a language holds fewer
    than 9 * 10**15 terms.
    """
    bound_batches(df.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(plain(lang_col).alias("__lang"), plain(source_col).alias("__source"), F.col(text_col).cast("string").cast("binary").alias("__text"))
    sketch = frequency_sketch(rows, min_docs, width)
    counts = checkpointed(exact_counts(rows, sketch, min_docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    own = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select(F.col("__lang").alias("lang"), F.col("__source").alias("source")).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = checkpointed(_share(groups, "p0", "0", "total", prior))
    held = own.join(groups, ["lang", "source"])
    held = _share(_share(held, "p", "n", "total", prior), "q", "lang_n", "lang_total", prior)
    held = checkpointed(held.select("lang", "source", "term", "p", "q", "p0"))

    # Terms over which a source is above its language.
    best = held.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Pairs of sources, a before b: all terms as if neither held them, then what holding one changes
    # against a source without it (by histogram), then terms that both hold.
    spread = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks = -(-spread // BLOCK)
    shares = held.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("n"))
    shares = shares.unionByName(groups.select("lang", "source", "p0", F.lit(None).cast("long").alias("p"), F.col("v").alias("n")))
    shares = shares.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    other = groups.select("lang", F.col("source").alias("to"), F.col("p0").alias("to0"), F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block"))
    none, one = _gap("p0", "to0"), _gap("p", "to0")
    apart = (
        shares.join(other, ["lang", "block"])
        .where("source <> to and (p is not null or source < to)")
        .select("lang", F.least("source", "to").alias("a"), F.greatest("source", "to").alias("b"), F.expr(f"n * (case when p is null then {none} else {one} - {none} end)").alias("value"))
    )
    left = held.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    right = held.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    change = f"{_gap('pa', 'pb')} - {_gap('pa', 'b0')} - {_gap('a0', 'pb')} + {_gap('a0', 'b0')}"
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", F.expr(change).alias("value"))
    pairs = apart.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", ways).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
    WITH docs AS (
      SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
    words AS (SELECT d, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= {MIN_DOCS}),
    langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    counted AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL),
    filled AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS ln FROM groups g
      JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    shares AS (
      SELECT f.lang, f.source, f.term, f.n,
        1 + ({UNIT} * (f.n + {PRIOR})) // (sum(f.n) OVER (PARTITION BY f.lang, f.source)::HUGEINT + {PRIOR} * l.v) AS p,
        1 + ({UNIT} * (f.ln + {PRIOR})) // (l.total + {PRIOR} * l.v) AS q
      FROM filled f JOIN langs l ON l.lang = f.lang),
    pairs AS (
      SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    whole AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM whole
    QUALIFY part = 'pair' OR rank <= {TOP}"""
