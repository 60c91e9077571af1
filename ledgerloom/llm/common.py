"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

_TYPES = {"boolean": BooleanType, "double": DoubleType, "string": StringType}

_ROOT = str(Path(__file__).resolve().parents[2])

# Bytes of Arrow data handed to Python at once; rows are limited too, for tables of very short texts.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4000

# Maps a UTF-8 byte to itself inside a word (digits, letters, bytes of non-ASCII characters), with
# A-Z lower-cased, and to a space elsewhere. bytes.translate(WORD_BYTES).split() gives the words.
WORD_BYTES = bytes(
    (c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes; a null text has none."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small by bytes, so that very long texts don't add up in a worker.

    The two settings stay for the session, since plans run later than they are made. Workers also get
    this library's folder on their path, for sessions started in another folder; machines without that
    folder pass over it and have the library installed or sent with the job.
    """
    known = spark.sparkContext.environment
    if _ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, (known.get("PYTHONPATH"), _ROOT)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage.

    The folder is the one the cluster names in spark.checkpoint.dir. Only on a single machine
    (a local master, as in tests) a temporary folder stands in for it; elsewhere that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def id_remainder(id_column: str | Column, divisor: int) -> Column:
    """crc32 of an id as text, modulo divisor; a null id counts as empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def schema_with(df: DataFrame, **columns: str) -> StructType:
    """The schema of df with further columns, by type name; df's own schema object stays as it is."""
    return StructType([*df.schema.fields, *(StructField(n, _TYPES[k]()) for n, k in columns.items())])
