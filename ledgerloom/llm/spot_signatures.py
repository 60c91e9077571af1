"""Document fingerprints by spot signatures: chains of content words that follow common-word anchors.

Every occurrence of an anchor (a common word) and the content words next after it form a signature;
the set of a text's signatures is its fingerprint and two fingerprints are as like as their Jaccard
coefficient. Near duplicates are searched for among sets of comparable length only: each set is
looked up by its rarest signatures, as many as a set that reaches the threshold can't do without.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, bound_batches, read_table

# Anchors: the most common words of the four languages.
ANCHORS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have had from or an they which you were her all she there would their we him been has when who will no more if out so what up said its about than into them can only "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei "
    "le la les de du des et un une en que qui dans pour est ce il au par sur pas plus ne se son avec sont mais ou leur comme elle ont cette être deux fait aux ces "
    "el los las y del se por con su para al lo como más o pero sus ha me si sin sobre este ya entre cuando todo esta ser son dos también fue era muy hasta desde está"
)
CHAIN = 2
THRESHOLD = 0.8
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_hash = xxhash.xxh3_64_intdigest
_ANCHOR_HASHES = np.array(sorted({_hash(w.encode()) for w in ANCHORS.split()}), np.uint64)


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit signatures of the whole text.

    A text without an anchor that has enough content words after it is described by its words; a
    text without words has none.
    """
    words = text.lower().encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []
    if not words:
        return np.zeros(0, "<u4")
    hashes = np.fromiter(map(_hash, words), np.uint64, len(words))
    at = np.minimum(np.searchsorted(_ANCHOR_HASHES, hashes), len(_ANCHOR_HASHES) - 1)
    anchor = _ANCHOR_HASHES[at] == hashes
    content = hashes[~anchor]
    follows = np.cumsum(~anchor)[anchor]  # number of content words before each anchor
    usable = follows + chain <= len(content)
    follows = follows[usable]
    if len(follows):
        mixed = hashes[anchor][usable] * _MIX[0]
        for k in range(chain):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[1] + content[follows + k] * _MIX[2]
    else:
        mixed = (hashes ^ (hashes >> np.uint64(31))) * _MIX[2]
    mixed ^= mixed >> np.uint64(32)
    return np.unique((mixed * _MIX[1]) >> np.uint64(32)).astype("<u4")


def fingerprint_text(found: np.ndarray) -> str:
    return base64.b64encode(found.tobytes()).decode("ascii")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def spot_fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", chain: int = CHAIN) -> DataFrame:
    """id and signatures (sorted distinct array<long>) of every row.

    Null texts count as empty and have no signatures; equal texts have equal ones; repeated rows are
    kept; further columns aren't read; an empty table gives an empty table.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            found = [signatures(t, chain).astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["__id", "signatures"])

    return rows.mapInArrow(sign, f"__id {kind}, signatures array<long>").withColumnRenamed("__id", id_col)


def spot_pairs(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, chain: int = CHAIN
) -> tuple[DataFrame, DataFrame]:
    """Near duplicates: (pairs, members).

    members gives every row's class (equal signature sets; the class is a hash of the set), so copies
    aren't expanded; pairs gives (class_a, class_b, similarity) for classes whose Jaccard coefficient
    is at least the threshold, class_a < class_b. Rows without signatures form one class.
    """
    signed = spot_fingerprints(df, text_col, id_col, chain)
    members = signed.select(id_col, F.sha2(F.array_join("signatures", ","), 256).alias("class"))
    sets = signed.select(F.sha2(F.array_join("signatures", ","), 256).alias("class"), "signatures").dropDuplicates(["class"])
    sets = sets.where("size(signatures) > 0")
    each = sets.select("class", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    rarity = each.groupBy("s").agg(F.count("*").alias("df"))
    prefix = (
        each.join(rarity, "s")
        .groupBy("class", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("ranked"))
        .select(
            "class",
            "n",
            F.posexplode(F.slice("ranked", 1, F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1)).alias("at", "x"),
        )
        # Partitions by set length: lengths in one step of the threshold's ratio; neighbours can match.
        .select("class", "n", "x.s", F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).alias("part"))
    )
    left = prefix.select(F.col("class").alias("class_a"), F.col("n").alias("n_a"), "s", F.explode(F.array(*[F.col("part") + d for d in (-1, 0, 1)])).alias("part"))
    right = prefix.select(F.col("class").alias("class_b"), F.col("n").alias("n_b"), "s", "part")
    near = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (threshold - 1e-9)) & (F.col("class_a") < F.col("class_b"))
    candidates = left.join(right, ["s", "part"]).where(near).select("class_a", "class_b").distinct()
    checked = (
        candidates.join(sets.withColumnsRenamed({"class": "class_a", "signatures": "sa"}), "class_a")
        .join(sets.withColumnsRenamed({"class": "class_b", "signatures": "sb"}), "class_b")
        .withColumn("both", F.size(F.array_intersect("sa", "sb")))
        .withColumn("similarity", F.col("both") / (F.size("sa") + F.size("sb") - F.col("both")))
        .where(F.col("similarity") >= threshold)
    )
    return checked.select("class_a", "class_b", "similarity"), members


def range_cuts(rows: DataFrame, partitions: int) -> list:
    """Ids of the table, falling, that part it into about equal ranges; fewer where there are fewer ids.

    They are taken at even steps of a sample drawn by a hash of the id, 50 for each range.
    """
    ids = rows.where("__id is not null").select("__id")
    drawn = ids.orderBy(F.xxhash64("__id"), "__id").limit(50 * partitions).agg(F.sort_array(F.collect_set("__id"), asc=False).alias("s")).first()["s"]
    at = sorted({len(drawn) * i // partitions for i in range(1, partitions)} - {0})
    return [drawn[i] for i in at if i < len(drawn)]


def _range_of(cuts: list) -> Column:
    """Number of cuts that aren't below the id, by binary search; null ids are in the last range."""
    if not cuts:
        return F.lit(0)
    held, steps = F.array(*map(F.lit, cuts)), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    step = lambda acc, s: F.when((acc + s <= len(cuts)) & (F.get(held, acc + s - 1) >= F.col("__id")), acc + s).otherwise(acc)
    return F.when(F.col("__id").isNull(), F.lit(len(cuts))).otherwise(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step))


def with_next(df: DataFrame, text_col: str, id_col: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt over ranges of descending id, each range closed by the first row of the one after it.

    Returns __guest (true for the row lent by the next range), __id, __text; sorted in each partition
    by the id itself, of any type that can be ordered. Null ids come last. The last range gets the
    first row of all. Every range but the first starts at an id that is a cut, so its first row is found
    by one aggregate over the rows of those ids, and one row a range is lent.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    cuts = range_cuts(rows, partitions)
    top = rows.agg(F.max("__id")).first()[0]
    rows = rows.withColumn("__part", _range_of(cuts))
    first = F.col("__id").isNull() if top is None else F.col("__id").isin([top, *cuts])
    least = rows.where(first).groupBy("__id", "__part").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("t"))).alias("f"))
    to = F.col("__part") - 1 if top is None else F.when(F.col("__id") == F.lit(top), F.lit(len(cuts))).otherwise(F.col("__part") - 1)
    lent = least.select("__id", F.col("f.t").alias("__text"), (F.lit(0) if top is None else to).alias("__part"), F.lit(True).alias("__guest"))
    dealt = rows.withColumn("__guest", F.lit(False)).unionByName(lent).repartitionById(len(cuts) + 1, F.col("__part"))
    return dealt.sortWithinPartitions("__guest", F.col("__id").desc_nulls_last(), F.xxhash64("__text"), "__text").select("__guest", "__id", "__text")


def edited_fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", chain: int = CHAIN) -> DataFrame:
    """Fingerprint of every text, of its edited text, and how like they and the next text's are.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many
    (or all) of the next row's text, by descending id; after the last comes the first. Rows of equal
    id are ordered by a hash of their text. Ids of any type that can be ordered go by their own
    order, null ids come last. Null texts count as empty; repeated rows are fingerprinted each;
    further columns aren't read; an empty table gives an empty table. Rows of one id are in one range.
    """
    bound_batches(df.sparkSession)
    rows = with_next(df, text_col, id_col)
    kind = rows.schema["__id"].dataType.simpleString()
    names = ["__id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def judge(batches):
        waiting = None  # (id array of one, text, signatures) of the row whose next one is yet to come
        closed = False
        for batch in batches:
            ids, out = [], []
            for i, (guest, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if closed:
                    break
                text = text or ""
                own = signatures(text, chain)
                if waiting is not None:
                    one, before, found = waiting
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    other = signatures(edited, chain)
                    ids.append(one)
                    out.append(
                        (
                            len(before),
                            hashlib.sha256(edited.encode("utf-8")).hexdigest(),
                            fingerprint_text(found),
                            fingerprint_text(other),
                            jaccard(found, other),
                            jaccard(found, own),
                        )
                    )
                waiting, closed = (batch.column(1).slice(i, 1), text, own), guest
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(ids), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names
                )

    return rows.mapInArrow(
        judge,
        f"__id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    ).withColumnRenamed("__id", id_col)


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def spot_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class (equal fingerprints) of every document and to how many other classes it is near (0.8)."""
    docs = read_table(spark, sf_dir, "documents")
    pairs, members = spot_pairs(docs)
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    found = members.join(ends, "class", "left")
    return found.select("doc_id", F.col("class").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
