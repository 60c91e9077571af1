"""A training-data pipeline over `documents`: five stages, each one of the corpus operators.

Every stage takes all that its predecessor kept and returns the columns of documents, but the last,
which returns the packed pieces. run() chains them; between stages the rows are written to the shared
checkpoint folder, so a lost executor repeats no earlier stage.

All stages read the columns of documents by name: further columns are left behind, and a table that
lacks source or n_chars is taken with nulls in their place. Empty tables give empty tables; no stage
fails on null ids, repeated rows or very long texts, which are treated as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bag_minhash import keep_one
from ledgerloom.llm.common import checkpointed, read_table
from ledgerloom.llm.decontamination import contamination
from ledgerloom.llm.language_id import fit_centroids, identify_language
from ledgerloom.llm.pattern_packing import pack_documents
from ledgerloom.llm.pii import mask_pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# No stage but the third can be expressed in SQL: the stages are tested against plain versions on small
# tables, packing by its invariants, and run() by what comes out of the chained stages.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    kinds = {"source": "string", "n_chars": "long"}
    return docs.select(*[F.lit(None).cast(kinds[c]).alias(c) if c in kinds and c not in docs.columns else F.col(c) for c in COLUMNS])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected texts go: null, without a letter, or too far from every language's centroids.

    The centroids are fitted on the labelled rows of the stage's own input. The language of a row
    without a label becomes the predicted one; given labels stay. Without any labelled row no
    language is known and all rows go. Repeated rows are judged each.
    """
    rows = _documents(docs)
    found = identify_language(rows, fit_centroids(rows)).where("not rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document of least id stays, null ids last.

    Null and empty texts are one class; of repeated rows one stays; rows that share an id but not a
    class all stay.
    """
    return keep_one(_documents(docs)).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; repeated rows are judged each.

    A null text has no words and stays; without benchmark items all documents stay.
    """
    found = contamination(_documents(docs), read_table(spark, sf_dir, "benchmark"), keep=True)
    return found.where("not __contaminated").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by masks and n_chars follows; all documents stay, repeated rows each.

    A null text stays null, an empty one empty.
    """
    return mask_pii(_documents(docs)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place; a null or empty text is one piece of one token.

    Repeated rows, also of one id, are packed each; long texts are cut into pieces.
    """
    return pack_documents(_documents(docs))


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
