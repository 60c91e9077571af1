"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given per document, so token labels are derived: words and word beginnings that occur in
labelled toxic documents far more often than chance allows (likelihood ratio) are evidence, and a
token with evidence is labelled toxic in toxic documents and harmless in others. The field has two
states; its features are a token's evidence and the transition from the token before. Tokens without
evidence share one potential, so a run of them is one power of a 2x2 matrix: forward-backward over a
whole document costs as much as it has evidence.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, bound_batches, id_remainder, read_table

# Bound of the labelled sample.
SAMPLE_DOCUMENTS = 6000
MIN_RATIO = 30.0  # likelihood ratio statistic; about 1 in 20 million by chance
MIN_ODDS = 6.0
PREFIXES = (3, 4, 5, 6, 7)
REACH = 4

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def toxic_words(text: str | None) -> list[str]:
    return _lowered(text).encode("utf-8", "replace").translate(WORD_BYTES).decode("utf-8").split() if text else []


def word_features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


@dataclass
class ChainField:
    """weights: of evidence; bias: of the toxic state; transition[before, now]; base: score without evidence."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -5.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    base: float = 0.0

    def __post_init__(self):
        self.starts = {f[1:4] if f[0] == "=" else f[:3] for f in self.weights}
        # Potentials of one token without evidence, and their powers until only the leading direction is left.
        step = np.exp(self.transition) * np.exp([0.0, self.bias])[None, :]
        powers = [np.eye(2)]
        while len(powers) < 4096:
            nxt = powers[-1] @ step
            powers.append(nxt / nxt.sum())
            if len(powers) > 2 and np.abs(powers[-1] - powers[-2]).max() < 1e-14:
                break
        self.powers, self.step = powers, step

    def weight(self, word: str) -> float | None:
        found = [self.weights[f] for f in word_features(word) if f in self.weights]
        return sum(found) if found else None

    def marginals(self, words: list[str]) -> list[tuple[int, float]]:
        """(token, probability of the toxic state) of every token that has evidence."""
        starts, at = self.starts, []
        for i in [i for i, w in enumerate(words) if w[:3] in starts]:
            value = self.weight(words[i])
            if value is not None:
                at.append((i, value))
        if not at:
            return []
        last = len(self.powers) - 1
        trans = np.exp(self.transition)
        forward, message, before = [], np.ones(2), -1
        for i, value in at:
            run = i - before - 1
            if before < 0:  # the first token has no transition into it
                if run:
                    message = np.array([1.0, math.exp(self.bias)]) @ self.powers[min(run - 1, last)] @ trans
            else:
                message = message @ self.powers[min(run, last)] @ trans
            message = message * np.array([1.0, math.exp(self.bias + value)])
            message = message / message.sum()
            forward.append(message)
            before = i
        out = []
        back, after = np.ones(2), len(words)
        for (i, value), alpha in zip(reversed(at), reversed(forward), strict=True):
            back = self.powers[min(after - i - 1, last)] @ back
            back = back / back.sum()
            both = alpha * back
            out.append((i, float(both[1] / both.sum())))
            back = trans @ (np.array([1.0, math.exp(self.bias + value)]) * back)
            back, after = back / back.sum(), i
        return out[::-1]

    def score(self, marginals: list[tuple[int, float]]) -> float:
        clean = 1.0 - self.base
        for _, p in marginals:
            clean *= 1.0 - p
        return min(1.0, max(0.0, 1.0 - clean))


def fit_windows(signatures: np.ndarray, windows: np.ndarray, states: np.ndarray, rounds: int = 300, counts: np.ndarray | None = None) -> tuple:
    """Weights, bias and transition of largest penalised likelihood (Adam on the full batch).

    signatures: rows of 0/1 features, row 0 none; windows: (n, length) signature numbers, -1 beyond
    the text; states: (n, length) 0/1; counts: how often each window occurs (once each if None).
    Only the ones of signatures are worked with. Returns weights, bias, transition.
    """
    n, length = windows.shape
    row, column = signatures if isinstance(signatures, tuple) else np.nonzero(signatures)
    rows = int(windows.max()) + 1 if isinstance(signatures, tuple) else len(signatures)
    counts = np.ones(n) if counts is None else np.asarray(counts, float)
    total, each = counts.sum(), np.repeat(counts[:, None], length, 1)
    real = windows >= 0
    index = np.maximum(windows, 0)
    k = int(column.max()) + 1 if isinstance(signatures, tuple) else signatures.shape[1]
    theta = np.zeros(k + 5)
    theta[k] = -2.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    seen_state = np.bincount(index[real], weights=(states * each)[real], minlength=rows)
    pair = real[:, 1:] & real[:, :-1]
    seen_pairs = np.bincount((states[:, :-1] * 2 + states[:, 1:])[pair], weights=each[:, 1:][pair], minlength=4)
    for t in range(1, rounds + 1):
        emission = np.bincount(row, weights=theta[column], minlength=rows) + theta[k]
        trans = np.exp(theta[k + 1 :]).reshape(2, 2)
        e = np.where(real, np.exp(np.clip(emission[index], -30, 30)), 1.0)
        pot = np.stack([np.ones_like(e), e], 2)
        alpha, beta = np.empty_like(pot), np.empty_like(pot)
        alpha[:, 0] = pot[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for j in range(1, length):
            link = pair[:, j - 1, None]
            a = np.where(link, alpha[:, j - 1] @ trans, np.where(real[:, j, None], 1.0, alpha[:, j - 1])) * pot[:, j]
            alpha[:, j] = a / a.sum(1, keepdims=True)
        beta[:, -1] = 1.0
        for j in range(length - 2, -1, -1):
            b = np.where(pair[:, j, None], (pot[:, j + 1] * beta[:, j + 1]) @ trans.T, 1.0)
            beta[:, j] = b / b.sum(1, keepdims=True)
        both = alpha * beta
        p = both[:, :, 1] / both.sum(2)
        expected = np.bincount(index[real], weights=(p * each)[real], minlength=rows)
        joint = alpha[:, :-1, :, None] * trans[None, None] * (pot[:, 1:] * beta[:, 1:])[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        pairs = (joint * (pair * each[:, 1:])[:, :, None, None]).sum((0, 1)).ravel()
        delta = seen_state - expected
        gradient = np.concatenate([np.bincount(column, weights=delta[row], minlength=k), [delta.sum()], seen_pairs - pairs]) / total
        gradient -= 1e-4 * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta += 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return theta[:k], float(theta[k]), theta[k + 1 :].reshape(2, 2)


def _ratio(a: Column, b: Column, n1: float, n0: float) -> Column:
    """Likelihood ratio statistic of a of n1 against b of n0."""

    def part(x, n, p):  # the logarithm of 0 is null and is multiplied by 0
        return F.coalesce(x * F.ln(p), F.lit(0.0)) + F.coalesce((n - x) * F.ln(1 - p), F.lit(0.0))

    p = (a + b) / (n1 + n0)
    return 2 * (part(a, n1, a / n1) + part(b, n0, b / n0) - part(a, n1, p) - part(b, n0, p))


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "toxic",
    sample: int = SAMPLE_DOCUMENTS,
) -> ChainField:
    """Fit on about `sample` labelled documents, drawn by a hash of the id.

    All evidence of the sampled documents and all of its windows enter the fit. Null texts, ids and labels teach nothing. Without both classes the field knows no evidence and
    every text gets the share of toxic documents.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    marks = marks.agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    total = marks.count()
    if total == 0:
        return ChainField()
    under = int(min(1.0, sample / total) * (1 << 30))
    drawn = marks.where(F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit("toxicity sample")), F.lit(1 << 30)) < under)
    texts = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where("__text is not null")
    # A bounded sample of ids: small enough to send to every task.
    rows = texts.join(F.broadcast(drawn), "__id").select("__text", "__y")

    def count(batches):
        counts: dict[str, list[int]] = {"": [0, 0]}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = 1 if y else 0
                counts[""][y] += 1
                for f in {f for w in set(toxic_words(text)) for f in word_features(w)}:
                    counts.setdefault(f, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(counts), pa.string()),
                pa.array([c[0] for c in counts.values()], pa.int64()),
                pa.array([c[1] for c in counts.values()], pa.int64()),
            ],
            ["feature", "harmless", "toxic"],
        )

    counts = rows.mapInArrow(count, "feature string, harmless long, toxic long").groupBy("feature")
    counts = counts.agg(F.sum("harmless").alias("b"), F.sum("toxic").alias("a"))
    sizes = counts.where("feature = ''").first()
    n0, n1 = (sizes["b"], sizes["a"]) if sizes else (0, 0)
    if not n0 or not n1:
        return ChainField(base=float(n1 > 0))
    # Only what occurs in toxic documents in a share well above the other is of use.
    likely = counts.where(f"feature <> '' and a >= 5 and a * {float(n0)} >= {MIN_ODDS} * b * {float(n1)}")
    ranked = likely.withColumn("ratio", _ratio(F.col("a"), F.col("b"), float(n1), float(n0))).where(F.col("ratio") >= MIN_RATIO)
    evidence = [r["feature"] for r in sorted(ranked.collect(), key=lambda r: (-r["ratio"], r["feature"]))]
    if not evidence:
        return ChainField(base=n1 / (n0 + n1))
    number = {f: i for i, f in enumerate(evidence)}
    starts = {f[1:4] if f[0] == "=" else f[:3] for f in evidence}

    def cut(batches):
        length = 2 * REACH + 1
        for batch in batches:
            found, clear, of = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = toxic_words(text)
                marks_ = [()] * len(words)
                hits = []
                for i, w in enumerate(words):
                    if w[:3] in starts:
                        own = tuple(sorted(number[f] for f in word_features(w) if f in number))
                        if own:
                            marks_[i] = own
                            hits.append(i)
                of.append(1 if y else 0)
                clear.append(not hits)
                # Every document gives the windows of its evidence and one from its middle.
                for i in [*hits, len(words) // 2]:
                    span = range(i - REACH, i + REACH + 1)
                    row = ["-" if j < 0 or j >= len(words) else ".".join(map(str, marks_[j])) for j in span]
                    if len(row) == length:
                        found.append((of[-1], " ".join(row)))
            found += [(-2 if c else -1, str(y)) for c, y in zip(clear, of, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string())], ["y", "marks"]
            )

    windows = rows.mapInArrow(cut, "y int, marks string").groupBy("y", "marks").count().collect()
    windows.sort(key=lambda r: (r["y"], r["marks"]))
    clear = {r["marks"]: r["count"] for r in windows if r["y"] == -2}
    base = clear.get("1", 0) / max(1, sum(clear.values()))
    signature: dict[str, int] = {"": 0}
    index, states, counts_ = [], [], []
    for r in windows:
        if r["y"] < 0:
            continue
        parts = r["marks"].split(" ")
        row = [-1 if p == "-" else signature.setdefault(p, len(signature)) for p in parts]
        state = [int(r["y"] == 1 and k > 0) for k in row]
        index.append(row)
        states.append(state)
        counts_.append(r["count"])
    ones = [(k, int(x)) for marks_, k in signature.items() if marks_ for x in marks_.split(".")]
    table = tuple(np.array(ones, np.int64).T)
    weights, bias, transition = fit_windows(table, np.array(index), np.array(states), counts=np.array(counts_))
    weights = np.pad(weights, (0, len(evidence) - len(weights)))
    return ChainField({f: float(w) for f, w in zip(evidence, weights, strict=True)}, bias, transition, base)


def score_toxicity(df: DataFrame, model: ChainField, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, score (0 to 1), predicted (score >= 0.5) and spans: code-point offsets of toxic tokens.

    A null or empty text has no evidence and gets the model's base score. Repeated rows are scored
    each; a null id stays null; only the two named columns are read; empty tables give empty tables.
    """
    bound_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def judge(batches):
        field_ = held.value
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1).to_pylist():
                words = toxic_words(text)
                found = field_.marginals(words)
                scores.append(field_.score(found))
                toxic = {i: p for i, p in found if p >= 0.5}
                own = []
                if toxic:
                    for k, m in enumerate(_WORD.finditer(_lowered(text))):
                        if k in toxic:
                            own.append({"start": m.start(), "end": m.end(), "marginal": toxic[k]})
                spans.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array(spans, span),
                ],
                ["__id", "score", "predicted", "spans"],
            )

    out = rows.mapInArrow(
        judge, f"__id {kind}, score double, predicted int, spans array<struct<start:long,end:long,marginal:double>>"
    )
    return out.withColumnRenamed("__id", id_col)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    learn = labels.where(id_remainder("doc_id", 5) != 0)
    model = fit_toxicity(docs, learn)
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans")
    )
