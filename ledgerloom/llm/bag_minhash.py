"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset checks.

A text is the multiset of its word shingles; the similarity of two is the weighted Jaccard
coefficient, sum of smaller over sum of larger counts. Every shingle and count level carries a
Poisson process whose points fall on signature components at random times; levels are held in
dyadic blocks (1, 1, 2, 4, ...), one process a block, so a count of w costs about log w processes.
The earliest point of a component is shared by two texts with a probability equal to their
similarity. Points later than needed to fill all components are never made.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, free_name, read_table, words_of

SHINGLE = 5
THRESHOLD = 0.8
# A pair of similarity 0.8 shares none of 26 bands of 5 with a probability of 3 in 100 000.
BANDS, ROWS = 26, 5
# Members of one bucket that one task compares with as many others; larger buckets are dealt in blocks.
BLOCK = 1024
# Of 130 components of a pair at similarity 0.8 fewer agree than this 3 times in a million (4.5 deviations).
AGREE = 83

_hash = xxhash.xxh3_64_intdigest
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingle_bag(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their counts; a text of fewer words is one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    mixed = np.full(n, np.uint64(size))
    for k in range(size):
        mixed = _mix(mixed * _GOLD + h[k : k + n])
    return np.unique(mixed, return_counts=True)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Of two bags; two empty ones are alike."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_signature(bag: tuple[np.ndarray, np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """For each component the hash of its earliest point; an empty bag has no signature."""
    items, counts = bag
    if not len(items):
        return np.zeros(0, np.uint64)
    seeds, lows, widths, weights = [_mix(items)], [np.zeros(len(items), np.int64)], [np.ones(len(items), np.int64)], [counts]
    block, low = 1, 1
    while True:
        more = counts > low
        if not more.any():
            break
        seeds.append(_mix(items[more] + np.uint64(0x9E3779B97F4A7C15 * block & 0xFFFFFFFFFFFFFFFF)))
        lows.append(np.full(more.sum(), low))
        widths.append(np.full(more.sum(), low))
        weights.append(counts[more])
        block, low = block + 1, 2 * low
    seed, low_, width, weight = (np.concatenate(x) for x in (seeds, lows, widths, weights))
    until = size * (math.log(size) + 4) / float(counts.sum())
    first = -np.log(_uniform(_mix(seed + _GOLD))) / width
    while True:
        live = np.flatnonzero(first < until)
        if len(live):
            rate = width[live].astype(float)
            expected = float(rate.max()) * until
            steps = 8 + int(expected + 6 * math.sqrt(expected))
            while True:  # until every process is followed beyond the last time of interest
                point = seed[live, None] + _GOLD * np.arange(1, steps + 1, dtype=np.uint64)[None, :]
                drawn = _mix(point)
                time = np.cumsum(-np.log(_uniform(drawn)), 1) / rate[:, None]
                if time[:, -1].min() >= until:
                    break
                steps *= 2
            row, column = np.nonzero(time < until)
            mark = _mix(drawn[row, column] ^ _A)
            level = low_[live][row] + (mark >> np.uint64(32)).astype(np.int64) % width[live][row]
            inside = level < weight[live][row]
            mark, at = mark[inside], time[row, column][inside]
            component = (mark & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
            order = np.argsort(-at, kind="stable")  # the earliest of a component is written last
            out = np.zeros(size, np.uint64)
            filled = np.zeros(size, bool)
            out[component[order]] = mark[order]
            filled[component] = True
            if filled.all():
                return out
        until *= 1.9


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    if not len(signature):
        return np.zeros(0, np.int64)
    parts = signature.reshape(bands, rows)
    key = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)
    for k in range(rows):
        key = _mix(key * _GOLD + parts[:, k])
    return key.view(np.int64)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node it is linked to.

    Alternates large-star and small-star steps until nothing changes; no node's edges meet in one task
    unaggregated, and nothing goes through the driver but the number and checksum of the edges.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m", "a")
        small = small.select("x", "m").union(small.select("a", "m")).toDF("a", "b").where("a <> b").distinct()
        now = checkpointed(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of text keys whose bags reach the threshold."""
    joined = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def check(batches):
        last, bag = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = []
            for i, (ta, tb) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if b[i] != last:
                    last, bag = b[i], shingle_bag(tb)
                if weighted_jaccard(shingle_bag(ta), bag) >= threshold:
                    kept.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in kept], pa.binary()), pa.array([b[i] for i in kept], pa.binary())], ["a", "b"]
            )

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(check, "a binary, b binary")


def _across(open_: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between members of one bucket that the pivots left in different classes.

    open_ has band, key, root, main (in the pivot's class), bands, marks, n and n_left (not main).
    Members outside the pivot's class are compared with all members, in blocks of bounded size, by
    their signatures and then exactly, each pair in the first bucket that it shares. Of several links
    from a text to one class one is enough. Members are copied once for each block of the other side:
    where few are left, each of the many others goes to one block.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    spread = lambda seed, n: F.pmod(F.xxhash64("key", F.lit(seed)), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    left = open_.where("not main").select("*", F.lit(True).alias("left"), spread(1, "n_left").alias("i"), every("n").alias("j"))
    right = open_.select("*", F.lit(False).alias("left"), spread(2, "n").alias("j"), every("n_left").alias("i"))
    rows = left.unionByName(right).join(texts, "key").select("band", "i", "j", "left", "key", "root", "bands", "marks", "text")

    def compare(pdf):
        own, other = pdf[pdf["left"]].reset_index(drop=True), pdf[~pdf["left"]].reset_index(drop=True)
        found = []
        if len(own) and len(other):
            band = pdf["band"].iloc[0]
            bags: dict = {}

            def bag(frame, k):
                key = frame["key"][k]
                if key not in bags:
                    bags[key] = shingle_bag(frame["text"][k])
                return bags[key]

            marks = np.stack([np.frombuffer(m, np.uint8) for m in other["marks"]])
            bands = np.stack(other["bands"].to_numpy())
            roots = other["root"].tolist()
            keys = other["key"].tolist()
            for k in range(len(own)):
                near = (marks == np.frombuffer(own["marks"][k], np.uint8)).sum(1)
                shared = bands == np.asarray(own["bands"][k])
                first = bands[np.arange(len(bands)), shared.argmax(1)] == band
                linked = {own["root"][k]}
                for m in np.argsort(-near, kind="stable"):
                    if near[m] < AGREE:
                        break
                    if first[m] and shared[m].any() and roots[m] not in linked:
                        if weighted_jaccard(bag(own, k), bag(other, m)) >= threshold:
                            linked.add(roots[m])
                            found.append((own["key"][k], keys[m]))
        return pd.DataFrame(found, columns=["a", "b"])

    return rows.groupBy("band", "i", "j").applyInPandas(compare, "a binary, b binary")


def near_duplicate_classes(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD
) -> DataFrame:
    """id, __key and __root (of the text and its class), class: the least id of all rows linked by pairs that reach the threshold.

    Equal texts are one node whatever their number. Null texts count as empty; texts without words
    are alike only if equal. Repeated rows are in one class; a null id joins no minimum unless all of
    its class are null. An empty table gives an empty table; further columns aren't read.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.select("__id", F.unhex(F.md5("__text")).alias("__key"), "__text")
    kind = rows.schema["__id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            found = [bag_signature(shingle_bag(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([band_keys(x) for x in found], pa.list_(pa.int64())),
                    pa.array([(x & np.uint64(255)).astype(np.uint8).tobytes() for x in found], pa.binary()),
                ],
                ["__id", "__key", "bands", "marks"],
            )

    signed = checkpointed(rows.mapInArrow(sign, f"__id {kind}, __key binary, bands array<long>, marks binary"))
    nodes = signed.groupBy("__key").agg(F.first(F.struct("bands", "marks")).alias("s")).select("__key", "s.*")
    held = nodes.select(F.col("__key").alias("key"), F.explode("bands").alias("band"))
    # Buckets of at least two different texts, with their least member as pivot.
    pivots = held.groupBy("band").agg(F.min("key").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    buckets = checkpointed(held.join(pivots, "band"))
    texts = rows.join(buckets.select(F.col("key").alias("__key")).distinct(), "__key", "left_semi")
    texts = checkpointed(texts.select(F.col("__key").alias("key"), F.col("__text").alias("text")).dropDuplicates(["key"]))
    starred = buckets.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    links = checkpointed(_verified(starred, texts, threshold))
    root = connected(links)
    # Buckets of three and more whose members the pivots left in different classes.
    placed = buckets.where("n > 2").join(root, F.col("key") == F.col("node"), "left").drop("node")
    placed = placed.withColumn("root", F.coalesce("root", "key"))
    parts = placed.groupBy("band", "root").agg(F.count("*").alias("c"), F.min("key").alias("k"))
    mixed = parts.groupBy("band").agg(F.count("*").alias("roots"), F.sum("c").alias("n"), F.min_by(F.struct("root", "c"), "k").alias("of"))
    mixed = mixed.where("roots > 1").select("band", "n", F.col("of.root").alias("pivot_root"), (F.col("n") - F.col("of.c")).alias("n_left"))
    open_ = placed.drop("n").join(mixed, "band").join(nodes.withColumnRenamed("__key", "key"), "key")
    open_ = open_.select("band", "key", "root", (F.col("root") == F.col("pivot_root")).alias("main"), "bands", "marks", "n", "n_left")
    more = checkpointed(_across(open_, texts, threshold))
    if not more.isEmpty():
        root = connected(links.union(more))
    classes = (
        signed.select("__id", "__key")
        .join(root.select(F.col("node").alias("__key"), "root"), "__key", "left")
        .select("__id", "__key", F.coalesce("root", "__key").alias("__root"))
    )
    least = classes.groupBy("__root").agg(F.min("__id").alias("class"))
    return classes.join(least, "__root").select(F.col("__id").alias(id_col), "__key", "__root", "class")


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row of df for each near-duplicate class: that of least id, null ids last.

    Among rows of that id in the class it is one of the text of least hash. Rows of different classes
    all stay, whatever ids they share; null texts count as empty; columns are passed on as they are;
    an empty table gives an empty table.
    """
    found = near_duplicate_classes(df, text_col, id_col, threshold)
    each = found.groupBy("__root", F.col(id_col).alias("__i"), "__key").agg(F.count("*").alias("__n"))
    rank = F.struct(F.col("__i").isNull().alias("null"), F.col("__i").alias("i"), F.col("__key").alias("k"), F.col("__n").alias("n"))
    kept = each.groupBy("__root").agg(F.min(rank).alias("r"))
    kept = checkpointed(kept.select(F.col("r.i").alias("__keep"), F.col("r.k").alias("__k"), F.col("r.n").alias("__n")))
    name = free_name(df, "__key")
    marked = df.withColumn(name, F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    marked = marked.join(kept, marked[id_col].eqNullSafe(kept["__keep"]) & (marked[name] == kept["__k"]), "left_semi")
    # Rows of equal id and text all match; one of them stays.
    if not kept.where("__n > 1").isEmpty():
        marked = marked.dropDuplicates([id_col, name])
    return marked.drop(name)


def op5_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("class").alias("class_id"), (F.col("doc_id") == F.col("class")).alias("kept"))
