"""Benchmark decontamination by a prefix-filtered set join with exact containment.

A window is a run of `window` consecutive words of a benchmark item (a shorter item is one window).
Containment of a window is asked in full, so its prefix is one word: the rarest by document frequency
over the whole corpus. A document word that is some window's prefix gives, by the word's place in the
window, the only place where that window can lie; place and length are checked against the
document's bounds and the words themselves are compared.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, free_name, read_table, schema_with, words_of

WINDOW = 10
# Words and bytes of all benchmark texts, so at most as many windows, up to which the index of the windows is
# sent to every task. Measured for 205 000 windows: 14 MB pickled, 0.17 GB in a worker with its pickled form.
BROADCAST_WORDS, BROADCAST_BYTES = 250_000, 16 << 20

_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_LETTER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    if len(words) < window:
        return [tuple(words)]
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


class WindowIndex:
    """Windows by their words, and for each prefix word the places and lengths of its windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], frequency: dict[bytes, int], window: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, words in items:
            for run in item_windows(words, window):
                found.setdefault(run, set()).add(item)
        self.windows = {run: tuple(sorted(names)) for run, names in found.items()}
        places: dict[bytes, set[tuple[int, int]]] = {}
        for run in self.windows:
            rarest = min(range(len(run)), key=lambda i: (frequency.get(run[i], 0), run[i], i))
            places.setdefault(run[rarest], set()).add((rarest, len(run)))
        self.places = {word: tuple(sorted(at)) for word, at in places.items()}

    def hits(self, words: list[bytes]) -> tuple[int, list[str]]:
        """Number of words inside occurring windows, and the items of those, sorted."""
        places, windows, total = self.places, self.windows, len(words)
        marked, items = None, set()
        for i in [i for i, word in enumerate(words) if word in places]:
            for offset, length in places[words[i]]:
                start = i - offset
                if start < 0 or start + length > total:
                    continue
                names = windows.get(tuple(words[start : start + length]))
                if names:
                    if marked is None:
                        marked = bytearray(total)
                    marked[start : start + length] = b"\1" * length
                    items.update(names)
        return (sum(marked) if marked else 0), sorted(items)


def _frequency(rows: DataFrame, vocabulary: frozenset) -> dict[bytes, int]:
    """Number of documents that hold each word of the vocabulary, over all documents."""
    known = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in known.value.intersection(words_of(text)):
                    counts[word] = counts.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    summed = rows.select("__text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in summed.collect()}


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_words: int = BROADCAST_WORDS,
    keep: bool = False,
) -> DataFrame:
    """Per row: the id, n_words, n_hit, n_items, items_sha256 and contaminated.

    keep=True returns all columns of df and __contaminated instead, for filtering. Null texts have
    no words; null items and items without words have no windows; repeated rows and items are judged
    each; equal item ids count once. Empty tables are fine on either side. Only the named columns are
    interpreted. Very long texts are searched whole, one at a time. A benchmark of at most broadcast_words
    words and BROADCAST_BYTES bytes is sent to all tasks; a larger one is joined.
    """
    bound_batches(df.sparkSession)
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("body")
    ).where("body is not null")
    items = items.where(F.size(_words("body")) > 0)
    size = items.agg(F.sum(F.size(_words("body"))).alias("words"), F.sum(F.octet_length("body") + F.octet_length("item")).alias("bytes")).first()
    if (size["words"] or 0) > broadcast_words or (size["bytes"] or 0) > BROADCAST_BYTES:
        return _joined(df, items, text_col, id_col, window, keep)
    held = [(r["item"], words_of(r["body"])) for r in items.collect()]
    rows = df.select(F.col(text_col).cast("string").alias("__text"))
    frequency = _frequency(rows, frozenset(w for _, words in held for w in words))
    index = df.sparkSession.sparkContext.broadcast(WindowIndex(held, frequency, window))

    if keep:
        base = df.drop("__contaminated")
        at = base.columns.index(text_col)

        def flag(batches):
            for batch in batches:
                hit = [index.value.hits(words_of(t))[0] > 0 for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(hit, pa.bool_())], [*batch.schema.names, "__contaminated"]
                )

        return base.mapInArrow(flag, schema_with(base, __contaminated="boolean"))

    given = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = given.schema["__id"].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                n_hit, names = index.value.hits(words)
                out.append((len(words), n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["__id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return given.mapInArrow(judge, f"__id {kind}, {_RESULT}").withColumnRenamed("__id", id_col)


def _words(text: str):
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(_LETTER), 0)


def _joined(df: DataFrame, items: DataFrame, text_col: str, id_col: str, window: int, keep: bool) -> DataFrame:
    """The same by shuffles alone, for a benchmark of any size: equal texts are judged once.

    The places of prefix words are joined with their windows; a text's likely windows meet in one row,
    at most as many as the text has places of prefix words and these have windows.
    """
    texts = df.select(F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    texts = texts.select(F.sha2("t", 256).alias("key"), _words("t").alias("words"))
    runs = items.select("item", _words("body").alias("w")).where("size(w) > 0")
    runs = runs.select(
        "item",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1)), lambda i: F.slice("w", i, window)
            )
        ).alias("run"),
    ).distinct()
    seen = texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    placed = (
        runs.select("run")
        .distinct()
        .select("run", F.posexplode("run").alias("offset", "word"))
        .join(seen, "word")
        .groupBy("run")
        .agg(F.min_by(F.struct("offset", "word"), F.struct("df", "word", "offset")).alias("p"), F.count("*").alias("known"))
        .where(F.col("known") == F.size("run"))
        .select("run", "p.offset", "p.word")
    )
    # Only places go through the shuffle; what they hold is compared where the texts are, one row a text.
    at = texts.select("key", F.size("words").alias("total"), F.posexplode("words").alias("pos", "word"))
    likely = (
        at.join(placed, "word")
        .select("key", (F.col("pos") - F.col("offset")).alias("start"), "total", "run")
        .where((F.col("start") >= 0) & (F.col("start") + F.size("run") <= F.col("total")))
        .groupBy("key")
        .agg(F.collect_set(F.struct("start", "run")).alias("likely"))
    )
    there = F.filter("likely", lambda x: F.slice("words", x["start"] + 1, F.size(x["run"])) == x["run"])
    occurs = texts.join(likely, "key").select("key", F.inline(there))
    hit = (
        occurs.select("key", F.explode(F.sequence("start", F.col("start") + F.size("run") - 1)).alias("pos"))
        .groupBy("key")
        .agg(F.countDistinct("pos").alias("n_hit"))
    )
    named = (
        occurs.join(runs, "run").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("names"))
    )
    key = free_name(df, "__key")
    found = hit.join(named, "key").select(F.col("key").alias(key), F.col("n_hit").alias("__hit"), F.col("names").alias("__names"))
    if keep:
        base = df.drop("__contaminated")
        marked = base.withColumn(key, F.sha2(F.col(text_col), 256)).join(found.select(key, F.lit(True).alias("__c")), key, "left")
        return marked.select(*base.columns, F.coalesce("__c", F.lit(False)).alias("__contaminated"))
    base = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).withColumn(key, F.sha2("__text", 256))
    return base.join(found, key, "left").select(
        F.col("__id").alias(id_col),
        F.size(_words("__text")).cast("long").alias("n_words"),
        F.coalesce("__hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("__names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("__names", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("__hit") > 0, F.lit(False)).alias("contaminated"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
