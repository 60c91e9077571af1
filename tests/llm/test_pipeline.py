"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bag_minhash
from ledgerloom.llm.common import words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(90001, None, "en", "s", 0), (90002, "", "en", "s", 0), (90003, "?! 12", None, "s", 5), (90004, "The mail is a@b.org and of the", None, None, None)]
    return spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))


def test_stages(spark, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "MinHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]
    given = {r.doc_id: r for r in docs.collect()}

    kept = corpus_pipeline.language_stage(spark, docs.withColumn("rejected", F.lit(1)), SF)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    kept = {r.doc_id: r for r in kept.collect()}
    assert set(given) - set(kept) == {90001, 90002, 90003} and kept[90004].lang in ("en", "fr", "de", "es")

    rows = sorted((r.doc_id, r.text or "") for r in given.values())
    bags = {i: bag_minhash.shingle_bag(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, t) in enumerate(rows):
        for j, u in rows[:k]:
            if t == u or len(bags[i][0]) and len(bags[j][0]) and bag_minhash.weighted_jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    stay = {find(i) for i, _ in rows}
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, SF).collect()} == stay

    runs = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words_of(r.text)
        runs |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = {i for i, t in rows if not any(tuple(words_of(t)[k : k + 10]) in runs for k in range(len(words_of(t))))}
    assert {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, SF).collect()} == clean

    masked = {r.doc_id: r for r in corpus_pipeline.pii_stage(spark, docs, SF).collect()}
    assert set(masked) == set(given) and masked[90004].text == "The mail is <EMAIL> and of the" and masked[90004].n_chars == 30
    assert all(masked[i].text == given[i].text for i in given if given[i].text and not any(c.isdigit() or c == "@" for c in given[i].text))


def test_run_and_empty(spark, docs, tmp_path):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
