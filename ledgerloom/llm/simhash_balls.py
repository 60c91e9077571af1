"""Near duplicates by SimHash fingerprints that meet in the middle: ball hashing.

Two 64-bit fingerprints within 3 bits of each other have a common variant near both. Which variants
need emitting follows from parity: a fingerprint with an even number of bits emits itself and all
variants at distance 2, one with an odd number all variants at distance 1, so that every variant is
even and any two fingerprints within 3 bits share one (even and odd: 2 + 1 or 0 + 1; two even ones:
0 + 2; two odd ones: 1 + 1).

Variants are shuffled by their leading bits: a fingerprint is sent once to each prefix that its
variants have, together with nothing else, and the variants of that prefix are made where they meet.
That is the same grouping as a shuffle of all 1000 variants of a fingerprint, at the cost of about 20
to 150 small rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bag_minhash import connected
from .common import bound_batches, checkpointed, read_table

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
# Fingerprints sent to one prefix at most, and variants made at once; more prefix bits serve larger tables.
GROUP = 1 << 17
VARIANTS = 1 << 21
PREFIXES = (8, 10, 12, 14, 16, 18, 20, 22, 24)

_PLACES = np.uint64((1 << 22) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def simhash(text: bytes | None, size: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text: bits set in more than half of its shingles' hashes; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(size, len(ends)) - 1 :]
    hashed = xxhash.xxh64_intdigest
    count, total = np.zeros(BITS, np.int64), len(last)
    for at in range(0, total, 65536):  # bounded for very long texts
        many = [hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], last[at : at + 65536], strict=False)]
        bits = np.unpackbits(np.array(many, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def _runs(values: np.ndarray) -> np.ndarray:
    """For sorted values the start of each one's run of equal values."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(values)), 0))


def _flips(free: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of one and of two of the lowest free bits."""
    one = _ONE << np.arange(free, dtype=np.uint64)
    a, b = np.triu_indices(free, 1)
    return one, one[a] | one[b]


def _leaves(fingerprints: np.ndarray, moved: np.ndarray, left: np.ndarray, free: int):
    """(owner, variant) arrays of bounded size; equal variants are always in the same one.

    moved are fingerprints with their leading bits set to a common prefix, left the flips that remain:
    2 for the value itself and two flips, 1 for one flip, 0 for the value itself.
    """
    waiting = [(np.arange(len(fingerprints)), moved, left, free)]
    while waiting:
        owner, y, r, m = waiting.pop()
        made = int(((r == 2) * (1 + m * (m - 1) // 2) + (r == 1) * m + (r == 0)).sum())
        if made > VARIANTS and m > 4:
            # Too many at once: the next four bits of the variants part them.
            low = np.uint64(m - 4)
            part = (y >> low) & np.uint64(15)
            for q in range(16):
                d = np.bitwise_count(part ^ np.uint64(q)).astype(np.int64)
                near = d <= r
                if near.any():
                    set_ = (y[near] & ~(np.uint64(15) << low)) | (np.uint64(q) << low)
                    waiting.append((owner[near], set_, (r - d)[near], m - 4))
            continue
        one, two = _flips(m)
        parts = [(owner[r != 1], y[r != 1])]
        for steps, masks in ((1, one), (2, two)):
            at = r == steps
            if at.any() and len(masks):
                parts.append((np.repeat(owner[at], len(masks)), (y[at][:, None] ^ masks[None, :]).ravel()))
        yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _links(fingerprints: np.ndarray, owner: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between owners of equal variants: of each variant's owners to its nearest one.

    The nearest owner is within 3 bits of all others unless all owners are even and at distance 2;
    such owners that are near each other meet at another variant, one of themselves.
    """
    if len(variant) <= 1 << 22:
        # Sorted by a hash with the place in the low bits: no second array follows the sort.
        mixed = np.sort(((variant * _ODD) & ~_PLACES) | np.arange(len(variant), dtype=np.uint64))
        high = mixed >> np.uint64(22)
        twin = np.zeros(len(mixed), bool)
        twin[1:] = high[1:] == high[:-1]
        twin[:-1] |= twin[1:]
        at = (mixed[twin] & _PLACES).astype(np.int64)
        owner, variant = owner[at], variant[at]
    distance = np.bitwise_count(fingerprints[owner] ^ variant)
    order = np.lexsort((distance, variant))
    owner, variant, distance = owner[order], variant[order], distance[order]
    first = _runs(variant)
    pivot = owner[first]
    linked = (distance[first] <= 1) & (owner != pivot)
    a, b = owner[linked], pivot[linked]
    near = np.bitwise_count(fingerprints[a] ^ fingerprints[b]) <= RADIUS
    return a[near], b[near]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least of its class) after linking the classes of a and b."""
    a, b = label[a], label[b]
    while True:
        live = a != b
        if not live.any():
            return label
        a, b = a[live], b[live]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        a, b = label[a], label[b]


def prefix_links(fingerprints: np.ndarray, prefix: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) for distinct fingerprints linked through variants with the given prefix."""
    free = BITS - bits
    # The low bits stay, the prefix replaces the leading ones.
    lead = (fingerprints >> np.uint64(free)) ^ np.uint64(prefix)
    moved = fingerprints ^ (lead << np.uint64(free))
    even = (np.bitwise_count(fingerprints) & 1) == 0
    left = np.where(even, 2, 1) - np.bitwise_count(lead).astype(np.int64)
    near = left >= 0
    fingerprints, moved, left = fingerprints[near], moved[near], left[near]
    label = np.arange(len(fingerprints))
    for owner, variant in _leaves(fingerprints, moved, left, free):
        a, b = _links(fingerprints, owner, variant)
        if len(a):
            label = _joined(label, a, b)
    changed = label != np.arange(len(label))
    return fingerprints[changed], fingerprints[label[changed]]


def _masks(bits: int, most: int) -> list[int]:
    one = [1 << i for i in range(bits)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    return [0, *one, *(two if most == 2 else [])]


def _sent(nodes: DataFrame, bits: int) -> DataFrame:
    """(prefix, fp): every fingerprint once for each prefix that its variants have."""
    lead = F.shiftrightunsigned("fp", BITS - bits)
    numbers = lambda most: F.array(*[F.lit(m).cast("long") for m in _masks(bits, most)])
    masks = F.when(F.bit_count("fp") % 2 == 0, numbers(2)).otherwise(numbers(1))
    return nodes.select("fp", F.explode(masks).alias("m")).select(lead.bitwiseXOR(F.col("m")).alias("prefix"), "fp")


def fingerprint_links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b) of distinct 64-bit fingerprints (column fp, long): linked ones, reduced to a forest a prefix.

    The number of prefix bits is the least for which no prefix gets more than `group` fingerprints, so
    a task's memory has a bound; a prefix gets its variants in bounded arrays, whatever it holds.
    """
    for bits in PREFIXES:
        if bits == PREFIXES[-1]:
            break
        per = nodes.groupBy(F.shiftrightunsigned("fp", BITS - bits).alias("lead")).agg(F.count("*").alias("n"))
        # A prefix gets the fingerprints of all leads within two bits of it.
        near = F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(bits, 2)]))
        reached = per.select("n", "lead", near.alias("m")).groupBy(F.col("lead").bitwiseXOR(F.col("m")).alias("p")).agg(F.sum("n").alias("n"))
        if (reached.agg(F.max("n")).first()[0] or 0) <= group:
            break

    def meet(key, table):
        own = table.column("fp").to_numpy().view(np.uint64)
        a, b = prefix_links(own, key[0].as_py(), bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return _sent(nodes, bits).groupBy("prefix").applyInArrow(meet, "a long, b long")


def simhash_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", group: int = GROUP) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id, the least id that can be reached by links of 3 bits or fewer.

    A null text counts as empty; texts without words have the fingerprint zero and are linked like any
    other. Texts of fewer than three words are one shingle. Repeated rows are kept and are in one
    component; null ids are never the least unless all ids of a component are null. Very long texts
    are hashed in blocks; an empty table gives an empty table; further columns aren't read.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").cast("binary").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            found = np.array([simhash(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["__id", "fp"])

    signed = checkpointed(rows.mapInArrow(sign, f"__id {kind}, fp long"))
    nodes = checkpointed(signed.groupBy("fp").agg(F.min("__id").alias("least")))
    root = connected(fingerprint_links(nodes.select("fp"), group))
    placed = nodes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    reached = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(reached, "root").select("fp", "component_id")
    return signed.join(known, "fp").select(
        F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op12_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))
