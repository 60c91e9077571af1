"""Best-fit packing by non-negative least squares over length patterns.

The histogram of piece lengths has at most as many entries as a sequence has tokens, however large
the corpus is, so the plan is made on the driver from the histogram alone and the pieces are placed
by their rank among those of equal length. Repeat counts of patterns (few lengths that fill a
sequence) are fitted to the histogram by non-negative least squares, rounded down to whole repeats
that the histogram still has, and what is left is packed by best fit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, read_table
from .token_ids import default_tokenizer, token_ids

CAPACITY = 2048
# Rows of one length that are ranked together; more are dealt over several groups.
RANKED_TOGETHER = 1000


def length_patterns(size: int, fill: float = 0.25) -> np.ndarray:
    """Patterns of one to three lengths (0: none) that fill a sequence of size tokens exactly.

    The third length runs over the smallest quarter (fill) only: a longer one fits as well into a
    pattern in which it is not the smallest. Rows are sorted in descending length.
    """
    a = np.arange(1, size + 1)
    found = [np.array([[size, 0, 0]])]
    b = size - a
    pairs = np.stack([a, b, np.zeros_like(a)], 1)
    found.append(pairs[(a >= b) & (b > 0)])
    for c in range(1, max(1, int(size * fill)) + 1):
        rest = size - c
        b = np.arange(c, rest // 2 + 1)
        if len(b):
            found.append(np.stack([rest - b, b, np.full_like(b, c)], 1))
    return np.concatenate(found).astype(np.int32)


def fit_repeats(counts: np.ndarray, patterns: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Repeats x >= 0 that minimise the squares of (counts - pattern lengths used), by coordinate descent.

    Every round takes the patterns of steepest descent that share no length and moves each to its own
    optimum, which for patterns without a common length is the joint one.
    """
    size = len(counts) - 1
    x = np.zeros(len(patterns))
    left = counts.astype(float)
    left[0] = 0
    has = (patterns > 0).astype(float)
    same = has.sum(1)
    twice = (patterns[:, 0] == patterns[:, 1]) & (patterns[:, 1] > 0)
    twice2 = (patterns[:, 1] == patterns[:, 2]) & (patterns[:, 2] > 0)
    norm = same + 2.0 * twice + 2.0 * twice2 + 2.0 * (twice & twice2)
    for _ in range(rounds):
        step = left[patterns].sum(1) / norm
        step = np.maximum(step, -x)
        gain = step * step * norm
        top = np.argpartition(-gain, min(8 * size, len(gain) - 1))[: 8 * size]
        top = top[gain[top] > 0.05]
        if not len(top):
            break
        top = top[np.argsort(-gain[top], kind="stable")]
        used = np.zeros(size + 1, bool)
        chosen = []
        for i, lengths in zip(top.tolist(), patterns[top].tolist(), strict=True):
            real = [n for n in lengths if n]
            if not any(used[n] for n in real):
                used[real] = True
                chosen.append(i)
        move = step[chosen]
        x[chosen] += move
        np.subtract.at(left, patterns[chosen].ravel(), np.repeat(move, 3))
        left[0] = 0
    return x


def pack_lengths(counts: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns with repeats that hold every length of the histogram exactly as often as it counts.

    counts[n] is the number of pieces of n tokens, n up to the capacity. A pattern is a tuple of
    (length, times). An empty histogram gives no pattern.
    """
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if left.sum() == 0:
        return plan
    patterns = length_patterns(size)
    patterns = patterns[((left[patterns] > 0) | (patterns == 0)).all(1)]
    if len(patterns):
        x = fit_repeats(left, patterns)
        # Rounding down loses less than one repeat of a pattern; best fit takes up what it leaves.
        whole = np.floor(x + 1e-9).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if whole[i] <= 0:
                break
            times: dict[int, int] = {}
            for n in patterns[i].tolist():
                if n:
                    times[n] = times.get(n, 0) + 1
            repeats = min([int(whole[i])] + [int(left[n]) // k for n, k in times.items()])
            if repeats > 0:
                for n, k in times.items():
                    left[n] -= k * repeats
                plan.append((tuple(times.items()), repeats))
    return plan + best_fit(left)


def best_fit(counts: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit in descending length, for all pieces of a length and all sequences of a room at once."""
    size = len(counts) - 1
    room: dict[int, list[list]] = {}  # free tokens -> [content, number of sequences]
    free = np.zeros(size + 1, np.int64)
    plan = []

    def put(content, number, at):
        if at == 0:
            plan.append((content, number))
        else:
            room.setdefault(at, []).append([content, number])
            free[at] += number

    for n in range(size, 0, -1):
        todo = int(counts[n])
        while todo:
            fits = np.flatnonzero(free[n:])
            if not len(fits):
                break
            at = n + int(fits[0])
            content, number = room[at].pop()
            # As many into each of these sequences as best fit would put there one by one.
            each = 1 if at < 2 * n else at // n
            take = min(number, todo // each)
            if take == 0:
                each, take = (todo, 1) if todo < each else (1, min(number, todo))
            free[at] -= number
            if number > take:
                room[at].append([content, number - take])
                free[at] += number - take
            put((*content, (n, each)), take, at - n * each)
            todo -= take * each
        if todo:
            each = size // n
            if todo // each:
                put(((n, each),), todo // each, size - n * each)
            if todo % each:
                put(((n, todo % each),), 1, size - n * (todo % each))
    for held in room.values():
        plan += [(content, number) for content, number in held]
    return plan


def placements(plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, first sequence, times in a sequence and offset, sorted by rank."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for content, repeats in plan:
        offset = 0
        for n, times in content:
            rank = ranks.get(n, 0)
            found.setdefault(n, []).append((rank, sequence, times, offset))
            ranks[n] = rank + times * repeats
            offset += n * times
        sequence += repeats
    return {n: tuple(np.array(column, np.int64) for column in zip(*rows, strict=True)) for n, rows in found.items()}


def token_pieces(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    tokenizer: str | None = None,
    ranks: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Pieces of at most capacity ids of every text: its ids and a closing id 0.

    Only longer texts are cut; all pieces but the first are full. A null text counts as empty and
    gives one piece that holds the closing id alone.
    """
    if tokenizer is None:
        tokenizer, ranks = default_tokenizer()
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def cut(batches):
        known = token_ids(tokenizer, ranks)
        for batch in batches:
            of, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                code = known.ids(text) + b"\0\0\0\0"
                total = len(code) >> 2
                start, end = 0, (total - 1) % capacity + 1
                piece = 0
                while start < total:
                    of.append(i)
                    out.append((piece, start, end - start, zlib.crc32(memoryview(code)[start * 4 : end * 4])))
                    piece, start, end = piece + 1, end, end + capacity
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of, pa.int64())),
                    pa.array(columns[0], pa.int32()),
                    *(pa.array(column, pa.int64()) for column in columns[1:]),
                ],
                ["__id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(cut, f"__id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    tokenizer: str | None = None,
    ranks: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Pack all texts into sequences of at most capacity tokens; one row per piece.

    Columns: the id, piece, start, length, ids_crc32, sequence_id, offset. Only the two named columns
    are read, so further columns of any name do no harm. Null and empty texts are pieces of one token.
    Repeated rows, also of one id, are packed each; a null id stays null. An empty table gives an
    empty table. Which of several pieces of equal length comes where is set by a hash of id and piece.
    """
    pieces = checkpointed(token_pieces(df, text_col, id_col, tokenizer, ranks, capacity))
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    where = df.sparkSession.sparkContext.broadcast(placements(pack_lengths(counts)))

    groups = max(1, -(-int(counts.max()) // RANKED_TOGETHER))
    keyed = pieces.withColumn("__group", F.pmod(F.xxhash64("__id", "piece", "ids_crc32"), F.lit(groups)))
    together = Window.partitionBy("length", "__group")
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        keyed.groupBy("length", "__group")
        .agg(F.count("*").alias("__n"))
        .select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    )
    ranked = keyed.withColumn("__rank", F.row_number().over(together.orderBy("__id", "piece", "ids_crc32")) - 1).join(
        firsts, ["length", "__group"]
    )
    ranked = ranked.select("__id", "piece", "start", "length", "ids_crc32", (F.col("__rank") + F.col("__first")).alias("__rank"))
    kind = pieces.schema["__id"].dataType.simpleString()

    def place(batches):
        placed = where.value
        for batch in batches:
            lengths = batch.column(3).to_numpy(zero_copy_only=False)
            ranks_ = batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            bounds = np.flatnonzero(np.diff(lengths[order])) + 1
            for part in np.split(order, bounds) if len(order) else []:
                n = int(lengths[part[0]])
                first, base, times, at = placed[n]
                k = np.searchsorted(first, ranks_[part], "right") - 1
                inside = ranks_[part] - first[k]
                sequence[part] = base[k] + inside // times[k]
                offset[part] = at[k] + inside % times[k] * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)],
                ["__id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    out = ranked.mapInArrow(
        place, f"__id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return out.withColumnRenamed("__id", id_col)


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
