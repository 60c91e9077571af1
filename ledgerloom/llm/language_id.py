"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

Texts are lower-cased, everything but letters becomes one space, and n-grams of 1 to 3 characters are
hashed into a fixed number of dimensions. Every language has several centroids, found by clustering
its sampled vectors on the unit sphere. A text goes to the language of the centroid with the largest
cosine; it is rejected where that cosine is far below what training texts of its length reach.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, id_remainder, read_table, schema_with

DIMENSIONS = 1 << 13
CLUSTERS = 4
# Bounds of the labelled sample: texts of one language, and of all.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_TOTAL = 20_000
# The least cosine of a length is set by training texts of it and by noise of it: cuts of training texts
# with random letters for theirs. It is what one noise text in ten reaches, in long texts one in a hundred;
# but no more than a third (texts of fewer than 32 n-grams) or two fifths of what all but one in a hundred
# training texts reach, which texts on other subjects do.
SHORT, LONG, ONE_IN = 32, 256, 100
OTHER_SHORT, OTHER = 1 / 3, 0.4
# A length class of fewer texts takes the next shorter one's threshold.
ENOUGH = 20
CUTS = tuple(2 << k for k in range(10))
# Noise is also made of whole training texts, up to this many characters.
NOISE_MOST = 1 << 16
UNKNOWN = "und"

_PIECE = 1 << 20
_FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    space = codes == 32
    return codes[~(space & np.r_[False, space[:-1]])] if len(codes) else codes


def ngram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of the whole text."""
    counts = np.zeros(DIMENSIONS, np.float32)
    text = text or ""
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    carry = ""
    for start in range(0, len(text), _PIECE):
        codes = _codes(carry + text[start : start + _PIECE])
        skip = len(_codes(carry)) if carry else 0
        a, b, c = _FACTORS
        one = codes * a
        grams = [one[skip:]]
        if len(codes) > 1:
            two = (one[:-1] ^ (codes[1:] * b)) * c
            grams.append(two[max(0, skip - 1) :])
        if len(codes) > 2:
            three = ((two[:-1] ^ (two[:-1] >> np.uint32(15))) + codes[2:] * a) * b
            grams.append(three[max(0, skip - 2) :])
        counts += np.bincount(np.concatenate(grams) >> shift, minlength=DIMENSIONS)
        carry = text[start + _PIECE - 2 : start + _PIECE]
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def short_cuts(text: str) -> list[str]:
    """Two parts of the text, of lengths and at places that follow from the text."""
    draw = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    fits = [n for n in CUTS if n < len(text)]
    out = []
    for _ in range(2 if fits else 0):
        n = draw.choice(fits)
        start = draw.randrange(len(text) - n + 1)
        out.append(text[start : start + n])
    return out


def noise_like(text: str) -> str:
    """The text with a random letter for each of its own; the same text gives the same noise."""
    draw = random.Random(zlib.crc32(text.encode("utf-8", "replace")) ^ 1)
    return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in text)


@dataclass
class CentroidModel:
    """Unit centroids (rows), the language of each, the IDF weights and the least cosine by length."""

    languages: list[str]
    of: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        rows = np.log1p(counts) * self.idf
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [], [], []
        for start in range(0, len(texts), 128):
            part = texts[start : start + 128]
            counts = np.stack([ngram_counts(t) for t in part])
            if len(self.of):
                cosine = self.vectors(counts) @ self.centroids.T
                best = cosine.argmax(1)
                value = np.clip(cosine[np.arange(len(part)), best], 0.0, 1.0)
            for i, text in enumerate(part):
                if not len(self.of) or not has_letter(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                else:
                    langs.append(self.languages[self.of[best[i]]])
                    scores.append(float(value[i]))
                    rejected.append(bool(value[i] < self.least[_length_class(counts[i].sum())]))
        return langs, scores, rejected


# Knows no language and answers `und`.
NO_LANGUAGE = CentroidModel([], np.zeros(0, int), np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros(32))


def _length_class(grams: float) -> int:
    return min(31, int(np.log2(max(1.0, grams))))


def spherical_clusters(rows: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts from rows far from each other, so the result depends on the rows alone."""
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(clusters, len(rows)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centroids = rows[chosen].copy()
    for _ in range(rounds):
        member = (rows @ centroids.T).argmax(1)
        for k in range(len(centroids)):
            if (member == k).any():
                mean = rows[member == k].sum(0)
                centroids[k] = mean / max(np.linalg.norm(mean), 1e-9)
    return centroids


def fit_centroids(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    clusters: int = CLUSTERS,
    per_language: int = SAMPLE_PER_LANGUAGE,
    total: int = SAMPLE_TOTAL,
) -> CentroidModel:
    """Fit on about per_language texts of each language (total over all), drawn by a hash of the id.

    Rows of null language or without a letter teach nothing. Without any labelled row the model
    knows no language and answers `und`.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.select(
        F.col(lang_col).cast("string").alias("__lang"),
        F.col(text_col).cast("string").alias("__text"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language sample")), F.lit(1 << 30)).alias("__draw"),
    ).where("__lang is not null and __text is not null")
    sizes = {r["__lang"]: r["count"] for r in rows.groupBy("__lang").count().collect()}
    if not sizes:
        return NO_LANGUAGE
    each = max(2 * clusters, min(per_language, total // len(sizes)))
    under = {lang: int(min(1.0, each / n) * (1 << 30)) for lang, n in sizes.items()}
    bound = F.lit(None).cast("long")
    for lang, most in under.items():
        bound = F.when(F.col("__lang") == lang, F.lit(most)).otherwise(bound)

    def sparse(batches):
        for batch in batches:
            langs, roles, index, value = [], [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not has_letter(text):
                    continue
                cuts = short_cuts(text)
                whole = text[:NOISE_MOST]
                for given, role in ((text, 0), *((c, 1) for c in cuts), *((noise_like(c), 2) for c in (*cuts, whole))):
                    if has_letter(given):
                        counts = ngram_counts(given)
                        at = np.flatnonzero(counts)
                        langs.append(lang)
                        roles.append(role)
                        index.append(at.astype("<u2").tobytes())
                        value.append(counts[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(roles, pa.int32()), pa.array(index, pa.binary()), pa.array(value, pa.binary())],
                ["lang", "role", "index", "value"],
            )

    sample = (
        rows.where(F.col("__draw") < bound)
        .select("__lang", "__text")
        .mapInArrow(sparse, "lang string, role int, index binary, value binary")
        .collect()
    )
    sample.sort(key=lambda r: (r["role"], r["lang"], bytes(r["index"]), bytes(r["value"])))
    of_role = lambda role: [(np.frombuffer(r["index"], "<u2"), np.frombuffer(r["value"], "<f4")) for r in sample if r["role"] == role]
    langs = [r["lang"] for r in sample if r["role"] == 0]
    if not langs:
        return NO_LANGUAGE
    return centroid_model(langs, of_role(0), clusters, of_role(1), of_role(2))


def _dense(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    rows = np.zeros((len(counts), DIMENSIONS), np.float32)
    for i, (at, n) in enumerate(counts):
        rows[i, at] = n
    return rows


def centroid_model(
    langs: list[str],
    counts: list[tuple[np.ndarray, np.ndarray]],
    clusters: int = CLUSTERS,
    cuts: list[tuple[np.ndarray, np.ndarray]] | None = None,
    noise: list[tuple[np.ndarray, np.ndarray]] | None = None,
) -> CentroidModel:
    """The model of labelled n-gram counts (dimensions and counts of each text); cuts of texts and noise set the least cosines.

    No more than the texts of one language, or a block of 256, are dense at a time.
    """
    seen = np.zeros(DIMENSIONS)
    for at, _ in counts:
        seen[at] += 1
    idf = (np.log((1 + len(langs)) / (1 + seen)) + 1).astype(np.float32)
    languages = sorted(set(langs))
    model = CentroidModel(languages, np.zeros(0, int), np.zeros((0, DIMENSIONS), np.float32), idf, np.zeros(32))
    parts, of = [], []
    for k, lang in enumerate(languages):
        found = spherical_clusters(model.vectors(_dense([c for c, x in zip(counts, langs, strict=True) if x == lang])), clusters)
        parts.append(found)
        of += [k] * len(found)
    model.centroids, model.of = np.concatenate(parts), np.array(of, int)

    def reached(every):
        best, grams = np.zeros(len(every), np.float32), np.zeros(len(every))
        for start in range(0, len(every), 256):
            block = _dense(every[start : start + 256])
            best[start : start + 256] = (model.vectors(block) @ model.centroids.T).max(1)
            grams[start : start + 256] = block.sum(1)
        return best, grams

    model.least = least_cosines(*reached(counts + (cuts or [])), *reached(noise or []))
    return model


def _by_class(reached: np.ndarray, grams: np.ndarray) -> list[np.ndarray]:
    """Sorted cosines of every length class, or of the next shorter one that has enough, or of the shortest that has, or of all."""
    classes = np.array([_length_class(n) for n in grams], int)
    known = [k for k in range(32) if (classes == k).sum() >= ENOUGH]
    out = []
    for k in range(32):
        use = [c for c in known if c <= k][-1:] or known[:1]
        out.append(np.sort(reached[classes == use[0]] if use else reached))
    return out


def least_cosines(reached: np.ndarray, grams: np.ndarray, noise: np.ndarray, noise_grams: np.ndarray) -> np.ndarray:
    """The least cosine of every length class, from the texts and the noise of the class."""
    least = np.zeros(32)
    for k, (own, junk) in enumerate(zip(_by_class(reached, grams), _by_class(noise, noise_grams), strict=True)):
        low = float(own[len(own) // ONE_IN]) if len(own) else 0.0
        if not len(junk):
            least[k] = OTHER * low
            continue
        one_in = ONE_IN if 1 << k >= LONG else 10
        other = OTHER if 1 << k >= SHORT else OTHER_SHORT
        least[k] = min(other * low, float(junk[len(junk) - 1 - len(junk) // one_in]))
    return least


def identify_language(
    df: DataFrame,
    model: CentroidModel,
    text_col: str = "text",
    lang_out: str = "lang_pred",
    score_out: str = "score",
    rejected_out: str = "rejected",
) -> DataFrame:
    """All columns of df and the language, the cosine (0 to 1) and whether the text is rejected.

    A text that is null or has no letter is `und`, score 0, rejected. The results' names are
    parameters; columns of df that have such a name are replaced. Repeated rows are judged each,
    texts whole however long; empty tables give empty tables.
    """
    bound_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    base = df.drop(lang_out, score_out, rejected_out)
    schema = schema_with(base, **{lang_out: "string", score_out: "double", rejected_out: "boolean"})
    at = base.columns.index(text_col)

    def judge(batches):
        for batch in batches:
            langs, scores, rejected = held.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                [f.name for f in schema],
            )

    return base.mapInArrow(judge, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (id_remainder("doc_id", 3) == 1).alias("held_out")
    )
    model = fit_centroids(docs.where("not held_out"))
    found = identify_language(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
