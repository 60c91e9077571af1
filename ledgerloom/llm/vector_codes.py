"""Vector code compression: every vector becomes a few small integers, one for each of its parts.

Components are integers (floor of a fixed multiple), vectors are cut into equal consecutive parts, and
each part position has a codebook. A round assigns every part to the nearest entry and moves entries to
the floor of the mean of their parts. All arithmetic is exact: distances are made by norm expansion
with int64 matrix products, sums are merged by a grouped shuffle.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Rows compared with a codebook at once: 256 distances of 8 bytes each.
_BLOCK = 2048
_LONG_MAX = 2**63 - 1


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); Python integers where int64 can't hold them."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < 2**62:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], dtype=object).reshape(scaled.shape)


def _fitting(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as int64 if their squared distances fit it, else as Python integers: exact either way."""
    width = max(a.shape[-1] for a in arrays)
    largest = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    kind = np.int64 if width * (2 * largest) ** 2 < 2**63 else object
    return tuple(a.astype(kind) for a in arrays)


def nearest_entries(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of book for every row, the first of equally near ones, and its squared distance."""
    found = np.zeros(len(rows), np.int64)
    errors = np.zeros(len(rows), object)
    for at in range(0, len(rows), _BLOCK):
        x, entries = _fitting(rows[at : at + _BLOCK], book)
        distance = (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]
        best = distance.argmin(1)
        found[at : at + _BLOCK] = best
        errors[at : at + _BLOCK] = distance[np.arange(len(x)), best]
    return found, errors


def _bounds(width: int, parts: int) -> list[tuple[int, int]]:
    cuts = [width * k // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    return _integers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width), scale)


def _usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def codebook_digest(books: list[np.ndarray]) -> str:
    """Of all integer components by part, entry and place within the part."""
    numbers = (str(int(x)) for book in books for x in book.ravel())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def fit_codebooks(
    vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> list[np.ndarray]:
    """Codebooks of the column __v (vectors of one width) after the given rounds.

    They start as the parts of the vectors of least __id; of equal ids the least vectors come first,
    null ids come last. A task sends one row for each entry that it met, and rows of one entry are
    added by a grouped shuffle; parts * entries rows reach the driver, whatever the table's size.
    """
    context = vectors.sparkSession.sparkContext
    first = vectors.select("__id", "__v").orderBy(F.col("__id").asc_nulls_last(), "__v").limit(entries).collect()
    bounds = _bounds(width, parts)
    seeds = _integers(np.array([r["__v"] for r in first], np.float64).reshape(len(first), width), scale)
    books = [seeds[:, a:b] for a, b in bounds]
    for _ in range(rounds):
        held = context.broadcast(books)

        def sums(batches, held=held):
            total = [np.zeros(book.shape, object) for book in held.value]
            count = [np.zeros(len(book), np.int64) for book in held.value]
            for batch in batches:
                rows = _matrix(batch.column(0), width, scale)
                for k, (a, b) in enumerate(bounds):
                    own = rows[:, a:b]
                    found, _ = nearest_entries(own, held.value[k])
                    count[k] += np.bincount(found, minlength=len(count[k]))
                    if own.dtype != object and len(own) * int(np.abs(own).max(initial=0)) < 2**62:
                        added = np.zeros(total[k].shape, np.int64)
                        np.add.at(added, found, own)
                        total[k] += added
                    else:
                        np.add.at(total[k], found, own.astype(object))
            met = [(k, int(e)) for k in range(parts) for e in np.flatnonzero(count[k])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in met], pa.int32()),
                    pa.array([e for _, e in met], pa.int32()),
                    pa.array([int(count[k][e]) for k, e in met], pa.int64()),
                    pa.array([[Decimal(int(x)) for x in total[k][e]] for k, e in met], pa.list_(pa.decimal128(38, 0))),
                ],
                ["part", "entry", "n", "sums"],
            )

        met = vectors.select("__v").mapInArrow(sums, "part int, entry int, n long, sums array<decimal(38,0)>")
        widest = max(b - a for a, b in bounds)
        merged = met.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(widest)]).alias("sums")
        )
        books = [book.copy() for book in books]
        for row in merged.collect():
            a, b = bounds[row["part"]]
            means = [int(s) // row["n"] for s in row["sums"][: b - a]]
            fits = all(abs(x) < 2**62 for x in means)
            if not fits:
                books[row["part"]] = books[row["part"]].astype(object)
            books[row["part"]][row["entry"]] = means
        held.unpersist()
    return books


def vector_codes(
    df: DataFrame,
    vector_col: str = "embedding",
    id_col: str = "vec_id",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every row with a usable vector.

    Rows go whose vector is null or holds null or non-finite components, as agreed. code has one
    number of fixed hex digits a part. Ties go to the lower index; repeated rows are coded each; null
    ids are coded and are last in the order of the first entries; null labels are one label. The
    vector of least id sets the width: vectors of another width can't be compared with it and have a
    null code and error. Sums beyond a long's range are shown as its largest value. An empty table
    gives an empty table; further columns aren't read.
    """
    bound_batches(df.sparkSession)
    rows = df.select(
        F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), F.col(vector_col).cast("array<double>").alias("__v")
    ).where(_usable("__v"))
    least = rows.select("__id", "__v").orderBy(F.col("__id").asc_nulls_last(), "__v").first()
    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("__id", "__label")}
    if least is None:
        kinds |= {"code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
        empty = df.sparkSession.createDataFrame([], ", ".join(f"{n} {k}" for n, k in kinds.items()))
        return empty.select(F.col("__id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
    width = len(least["__v"])
    alike = rows.where(F.size("__v") == width)
    books = fit_codebooks(alike, width, parts, entries, rounds, scale)
    bounds = _bounds(width, parts)
    digits = max(1, (len(f"{max(entries - 1, 0):x}")))
    held = df.sparkSession.sparkContext.broadcast(books)

    def assign(batches):
        for batch in batches:
            found = _matrix(batch.column(2), width, scale)
            codes, errors = [""] * len(found), np.zeros(len(found), object)
            for k, (a, b) in enumerate(bounds):
                index, error = nearest_entries(found[:, a:b], held.value[k])
                codes = [code + f"{i:0{digits}x}" for code, i in zip(codes, index.tolist(), strict=True)]
                errors = errors + error
            errors = [min(int(e), _LONG_MAX) for e in errors]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                ["__id", "__label", "code", "error"],
            )

    coded = alike.mapInArrow(assign, f"__id {kinds['__id']}, __label {kinds['__label']}, code string, error long")
    other = rows.where(F.size("__v") != width)
    coded = coded.unionByName(other.select("__id", "__label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    coded = checkpointed(coded)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_LONG_MAX)))
    of_label = coded.groupBy(F.col("__label").alias("__l")).agg(total.cast("long").alias("label_error"))
    joined = coded.join(of_label, F.col("__label").eqNullSafe(F.col("__l")))
    return joined.select(
        F.col("__id").alias(id_col), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256")
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same rounds as SQL: parts and entries are rows, a round is two steps."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
    a{k} AS MATERIALIZED (
      SELECT vec_id, part, entry, dist FROM (
        SELECT v.vec_id, v.part, b.entry, sum((v.x - b.c) * (v.x - b.c)) AS dist,
          row_number() OVER (PARTITION BY v.vec_id, v.part ORDER BY sum((v.x - b.c) * (v.x - b.c)), b.entry) AS r
        FROM parts v JOIN b{k} b ON v.part = b.part AND v.pos = b.pos GROUP BY v.vec_id, v.part, b.entry) WHERE r = 1)""")
        if k < ROUNDS:
            steps.append(f"""
    m{k} AS MATERIALIZED (
      SELECT a.part, a.entry, v.pos, sum(v.x) AS s, count(*) AS n
      FROM a{k} a JOIN parts v ON a.vec_id = v.vec_id AND a.part = v.part GROUP BY ALL),
    b{k + 1} AS MATERIALIZED (
      SELECT b.part, b.entry, b.pos,
        CASE WHEN m.n IS NULL THEN b.c ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::HUGEINT END AS c
      FROM b{k} b LEFT JOIN m{k} m USING (part, entry, pos))""")
    return f"""
    WITH kept AS (
      SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS w FROM embeddings
      WHERE embedding IS NOT NULL
        AND (SELECT count(*) FROM (SELECT unnest(embedding) AS x) WHERE x IS NULL OR NOT isfinite(x)) = 0),
    parts AS MATERIALIZED (
      SELECT vec_id, i // w AS part, i % w AS pos, floor({SCALE} * embedding[i + 1]::DOUBLE)::HUGEINT AS x
      FROM (SELECT *, unnest(range(len(embedding))) AS i FROM kept)),
    b0 AS MATERIALIZED (
      SELECT p.part, f.entry, p.pos, p.x AS c FROM parts p
      JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}) f USING (vec_id)),
    {",".join(steps)},
    coded AS (
      SELECT vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error
      FROM a{ROUNDS} GROUP BY vec_id),
    whole AS (SELECT coded.*, kept.label FROM coded JOIN kept USING (vec_id))
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
      (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256
    FROM whole"""


ORACLE_SQL = _oracle()
