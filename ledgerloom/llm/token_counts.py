"""Token counts of whole texts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, read_table
from .token_ids import default_tokenizer, token_ids


def token_counts(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    tokenizer: str | None = None,
    ranks: str | None = None,
    limit: int = 512,
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Only the two named columns are read, so further columns of any name do no harm. A null or empty
    text has 0 bytes and 0 tokens. Repeated rows are counted each. A null id stays null. An empty
    table gives an empty table. Batches are bounded by bytes; a long text is encoded in pieces that
    end at safe boundaries, so its count is that of the whole text.
    """
    if tokenizer is None:
        tokenizer, ranks = default_tokenizer()
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def lengths(batches):
        known = token_ids(tokenizer, ranks)
        for batch in batches:
            counts = known.lengths(batch.column(1).to_pylist())
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counts, pa.int64())], ["__id", "n_bytes", "n_tokens"]
            )

    out = rows.mapInArrow(lengths, f"__id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
