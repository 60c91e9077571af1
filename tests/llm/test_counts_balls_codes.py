"""Source divergence, SimHash balls and vector codes against plain versions, with odd input."""

import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash_balls, source_divergence, vector_codes
from ledgerloom.llm.registry import oracle_sql, queries
from tests.test_oracles import TABLES, norm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == sorted(theirs) and sorted(names) == columns


# --- source divergence


def plain_divergence(rows, min_docs, top):
    """The definition: dense, one group after the other."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted({t for d in own for t in d[2] if sum(t in x[2] for x in own) >= min_docs})
        shares = {}
        for group in [None, *{d[1] for d in own}]:
            count = {t: sum(d[2].count(t) for d in own if group is None or d[1] == group) for t in kept}
            total = sum(count.values()) + 2 * len(kept)
            shares[group] = {t: (count[t], 1 + 10**9 * (count[t] + 2) // total) for t in kept}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for a in set(shares) - {None}:
            pairs = [(-sum(gap(shares[a][t][1], shares[b][t][1]) for t in kept), b.encode(), b) for b in set(shares) - {None, a}]
            terms = [(-gap(shares[a][t][1], shares[None][t][1]), t.encode(), t) for t in kept if shares[a][t][0] and shares[a][t][1] > shares[None][t][1]]
            out |= {(lang, a, "pair", b, -v, i + 1) for i, (v, _, b) in enumerate(sorted(pairs))}
            out |= {(lang, a, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])}
    return out


def test_divergence_equals_the_definition(spark, monkeypatch):
    pick = random.Random(3)
    words = ["alpha", "Beta", "gamma", "été", "日本", "x", "y1z", "Zeta"]
    rows = [(" ".join(pick.choices(words, k=pick.randint(0, 30))), pick.choice(["en", "de", None, ""]), pick.choice(["a", "b", "B", "é", None])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "fr", "alone"), ("rare word", "it", "s"), ("other word", "it", "t"), ("beta " * 9000, "de", "long")] + rows[:3]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "__lang": F.lit("q"), "n": F.lit(0)})
    expected = plain_divergence(rows, 10, 3)
    for blocks, width in ((source_divergence.BLOCK, 1 << 12), (2, 4)):  # a sketch of 4 cells prunes nothing and loses nothing
        monkeypatch.setattr(source_divergence, "BLOCK", blocks)
        found = source_divergence.source_divergence(df, top=3, width=width).collect()
        assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert source_divergence.source_divergence(empty, width=64).collect() == []
    nulls = spark.createDataFrame([(None, None, None)] * 3, "text string, lang string, source string")
    assert source_divergence.source_divergence(nulls, width=64).collect() == []


def test_sketch_never_underestimates(spark):
    rows = spark.createDataFrame([("en", " ".join(f"w{chr(97 + j)}{chr(97 + i % 26)}" for j in range(i % 20))) for i in range(300)], "lang string, text string")
    rows = rows.select(F.col("lang").alias("__lang"), F.col("text").cast("binary").alias("__text"))
    sketch = source_divergence.frequency_sketch(rows, 10, 128)
    true = {}
    for r in rows.collect():
        for t in set(source_divergence.terms_of(bytes(r["__text"]))):
            true[t] = true.get(t, 0) + 1
    cells = source_divergence._cells("en", list(true), 128)
    estimate = np.minimum(*[row[at] for row, at in zip(sketch, cells, strict=True)])
    assert all(e >= min(n, 10) for e, n in zip(estimate.tolist(), true.values(), strict=True))


# --- SimHash


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids):
    """{node: least node} over ids = {node: fingerprint}, by all pairs."""
    nodes = list(ids)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if (ids[a] ^ ids[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_of_texts():
    long = "one two Three four " * 40000
    for text in [None, "", " \t\n", "One", "one TWO", "ÀB c\x0bd\x1ce", "a b c d", long, "日本 語 x"]:
        assert simhash_balls.simhash(text.encode() if text else None) == plain_simhash(text), text[:20]


@pytest.mark.parametrize("limit", [1 << 21, 3000])
def test_links_in_a_prefix_equal_brute_force(monkeypatch, limit):
    monkeypatch.setattr(simhash_balls, "VARIANTS", limit)  # the small limit parts the variants several times
    pick = random.Random(7)
    found = set()
    for _ in range(12):
        seed = pick.getrandbits(64)
        for _ in range(10):  # chains of one to five flips
            found.add(seed)
            for bit in pick.sample(range(64), pick.randint(1, 5)):
                seed ^= 1 << bit
    values = np.array(sorted(found), np.uint64)
    edges = []
    for prefix in range(16):
        a, b = simhash_balls.prefix_links(values, prefix, 4)
        edges += zip(a.tolist(), b.tolist(), strict=True)
    root = {v: v for v in values.tolist()}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in root} == plain_components({v: v for v in sorted(root)})


def test_simhash_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    prints = {d: plain_simhash(t) for d, t in sorted(texts.items())}
    expected = plain_components(prints)
    for group in (simhash_balls.GROUP, 40):  # more prefix bits
        found = simhash_balls.simhash_components(docs, group=group).collect()
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {d: (f"{prints[d]:016x}", expected[d]) for d in prints}


def test_simhash_of_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, "a b c"), (9, "a b c"), (None, "a b c"), (None, "only null"), (4, "x " * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(0), "root": F.lit(1), "__id": F.lit(2)})
    found = sorted((tuple(r) for r in simhash_balls.simhash_components(df).collect()), key=repr)
    abc = f"{plain_simhash('a b c'):016x}"
    expected = [(5, "0" * 16, 3), (3, "0" * 16, 3), (9, abc, 9), (9, abc, 9), (None, abc, 9), (None, f"{plain_simhash('only null'):016x}", None), (4, f"{plain_simhash('x ' * 100000):016x}", 4)]
    assert found == sorted(expected, key=repr)
    assert simhash_balls.simhash_components(df.limit(0)).collect() == []


# --- vector codes


def plain_codes(rows, entries, rounds):
    """rows: (id, vector, label), all usable and of one width; Python integers only."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows]
    w = len(kept[0][1]) // 4
    parts = [[v[k * w : (k + 1) * w] for _, v, _ in kept] for k in range(4)]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0], rows[i][1]))[:entries]
    books = [[parts[k][i] for i in first] for k in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, book: min((far(v, c), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for k in range(4):
            at = [nearest(v, books[k])[1] for v in parts[k]]
            for e in set(at):
                own = [v for v, i in zip(parts[k], at, strict=True) if i == e]
                books[k][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out = []
    for n, (i, _, label) in enumerate(kept):
        best = [nearest(parts[k][n], books[k]) for k in range(4)]
        out.append((i, "".join(f"{b[1]:02x}" for b in best), sum(b[0] for b in best), label))
    return [(i, code, error, sum(e for _, _, e, x in out if x == label), digest) for i, code, error, label in out]


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e18])
def test_codes_equal_plain_integers(spark, scale):
    pick = random.Random(5)
    rows = [(pick.choice([i, i // 2]), [pick.uniform(-1, 1) * scale for _ in range(8)], pick.choice([1, 2, None])) for i in range(60)]
    rows += rows[:2] + [(1000, rows[0][1], None), (1001, [0.0] * 8, 2)]
    bad = [(-1, None, 1), (-2, [1.0, None] * 4, 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] + [0.0] * 7, 2)]
    df = spark.createDataFrame(rows + bad, "vec_id int, embedding array<double>, label int").withColumns({"code": F.lit(1), "__v": F.lit(1)})
    found = vector_codes.vector_codes(df.repartition(3), entries=16, parts=4).collect()
    top = 2**63 - 1
    expected = [(i, "".join(c[1] for c in zip(*[iter(code)] * 2, strict=True)), min(e, top), s, d) for i, code, e, s, d in plain_codes(rows, 16, 4)]
    if scale < 1e10:
        assert sorted(map(tuple, found)) == sorted(expected)
    else:
        assert sorted((r[0], r[1], r[2], r[4]) for r in found) == sorted((x[0], x[1], x[2], x[4]) for x in expected)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    df = spark.createDataFrame([(1, [0.5] * 4, 1), (2, [1.0] * 8, 1), (None, [0.25] * 4, None), (3, [0.25] * 4, None)], schema)
    found = {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.vector_codes(df).collect()}
    assert found == {(1, "00000000", 0, 0), (2, None, None, 0), (None, "01010101", 0, 0), (3, "01010101", 0, 0)}
