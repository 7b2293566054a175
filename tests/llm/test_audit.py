"""Fingerprints, whitening and source divergence beside brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewatch.llm import divergence, simhash, whitening
from sievewatch.llm.queries import QUERIES

DOCS = "doc_id long, text string, fingerprint string, range int, halo string, id string, h long"
WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll lagoon marsh north ocean pond quay river stone tide".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 2) for i, t in rows], DOCS)


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 40)) for _ in range(n))


# --- fingerprints ----------------------------------------------------------------------------


def test_simhash():
    rnd = random.Random(1)
    text = prose(rnd, 200)
    near, far = text.replace(text.split()[50], "other", 1), prose(rnd, 200)
    a, b, c, d, e, f = simhash.simhash([text, text.upper(), near, far, None, " \n"])
    assert (a == b).all() and not e.any() and not f.any()
    assert simhash.likeness(a, a) == 1.0
    assert simhash.likeness(a, near_print := c) > 0.9 > 0.5 > simhash.likeness(a, d) and near_print.any()
    # the votes, term by term
    small = "one two two"
    got = simhash.simhash([small])[0]
    words = simhash.word_hashes([small.encode()])[0]
    with np.errstate(over="ignore"):
        terms = [(words[0], 1), (words[1], 2), *((x, 2) for x in simhash.mix(words[:-1] * simhash._ODD + words[1:]))]
        votes = [0] * 128
        for t, w in terms:
            data = np.array([simhash.mix(t + simhash._ODD), simhash.mix(t ^ simhash._ODD)], np.uint64).tobytes()
            for i in range(128):
                votes[i] += w if data[i // 8] >> (7 - i % 8) & 1 else -w
    assert [got[i // 8] >> (7 - i % 8) & 1 for i in range(128)] == [int(v > 0) for v in votes]


def check_edits(spark, rows, got):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in ordered]
    following = texts[1:] + texts[:1]
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for (i, _), t, n in zip(ordered, texts, following, strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        r = by_id[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        p, q, s = simhash.simhash([t, e, n])
        assert (r.fingerprint, r.edited_fingerprint) == (p.tobytes().hex(), q.tobytes().hex())
        assert math.isclose(r.near_edited, simhash.likeness(p, q)) and math.isclose(r.near_next, simhash.likeness(p, s))


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_edits(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "PART_BYTES", max(1, 60_000 // parts))
    rnd = random.Random(parts)
    rows = [(rnd.randint(0, 10**6) * 2, prose(rnd, rnd.randint(0, 40))) for _ in range(150)]
    rows = list(dict(rows).items()) + [(1, None), (3, ""), (5, "é😀" * 5001), (7, "a"), (9, "a"), (-4, "last " * 50), (11, "x" * 300_000)]
    rnd.shuffle(rows)
    check_edits(spark, rows, simhash.compare_with_edits(docs(spark, rows).repartition(7)).collect())


def test_edits_odd_tables(spark):
    assert simhash.compare_with_edits(docs(spark, [])).collect() == []
    check_edits(spark, [(4, "alone here")], simhash.compare_with_edits(docs(spark, [(4, "alone here")])).collect())
    check_edits(spark, [(4, "a b"), (None, "no id")], simhash.compare_with_edits(docs(spark, [(4, "a b"), (None, "no id")])).collect())
    # one id on most rows, null ids, whole rows repeated: every row comes back once, and follows in the order of (id, hash)
    rows = [(7, f"text {i}") for i in range(300)] + [(None, f"none {i % 3}") for i in range(40)] + [(8, "same")] * 50 + [(1, "z")]
    got = simhash.compare_with_edits(docs(spark, rows), with_text=True).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    hashed = {r.text: r.h for r in docs(spark, rows).select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashed[r[1]]))
    want = Counter((i, simhash.edited(t, ordered[(k + 1) % len(rows)][1])) for k, (i, t) in enumerate(ordered))
    assert Counter((r.doc_id, r.edited_text) for r in got) == want
    named = docs(spark, [(1, "a b c")]).withColumn("key", F.lit("q")).withColumnRenamed("text", "body").withColumnRenamed("doc_id", "text")
    assert simhash.compare_with_edits(named, "text", "body").first().n_chars == 5


@pytest.mark.parametrize("cell", [1 << 14, 5])
@pytest.mark.parametrize("radius", [0, 3, 9])
def test_near_groups(spark, radius, cell, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", cell)
    rnd = np.random.default_rng(radius)
    base = rnd.integers(0, 256, (25, 16), dtype=np.uint8)
    prints = [base[0]] * 40  # a group of copies
    for i in range(160):
        p = np.unpackbits(base[0 if i < 60 else rnd.integers(25)])
        p[rnd.choice(128, rnd.integers(0, 12), replace=False)] ^= 1
        prints.append(np.packbits(p))
    rows = [(i, p.tobytes().hex(), "x") for i, p in enumerate(prints)] + [(500, "0" * 32, "x"), (501, "0" * 32, "x"), (502, None, "x"), (None, base[1].tobytes().hex(), "x")]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, fingerprint string, f string"), radius).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "fingerprint", "f", "near_id"}
    flat = np.array(prints + [base[1]])
    near = np.bitwise_count(flat[:, None] ^ flat[None]).sum(-1) <= radius
    reach = near.copy()
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    want = {i: int(np.flatnonzero(reach[i][:-1]).min()) for i in range(len(prints))}
    assert {r.doc_id: r.near_id for r in got if r.doc_id is not None} == want | {500: 500, 501: 501, 502: 502}
    tail = np.flatnonzero(reach[-1][:-1])
    assert [r.near_id for r in got if r.doc_id is None] == [int(tail.min()) if len(tail) else None]


def test_op11_query(spark):
    got = QUERIES["op11_simhash"](spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_edits(spark, [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], got)
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95


# --- whitening -------------------------------------------------------------------------------


def whole(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def check_whitening(vectors, got, k=32):
    x = [whole(v) for v in vectors.values()]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[n * c - s for c, s in zip(row, sums, strict=True)] for row in x], object)
    exact = y.T @ y  # whole numbers of any size: n^3 times the covariance
    v = np.array([[c / n**3 for c in row] for row in exact.tolist()])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == n * k
    by = {(r.vec_id, r.component): r for r in got}
    w = (y.astype(float) / n) @ axes[:, :k] / np.sqrt(e[:k])
    for j in range(k):
        mine = np.array([by[i, j + 1].whitened for i in vectors])
        assert np.allclose(mine, w[:, j], atol=1e-6) or np.allclose(mine, -w[:, j], atol=1e-6)
    for i, row in zip(vectors, y.tolist(), strict=True):
        r = by[i, 1]
        deviation = sum(c * c for c in row)
        assert r.n == n and r.deviation == (deviation if deviation < 1 << 63 else None)
    assert all(math.isclose(r.explained, e[r.component - 1] / np.trace(v), rel_tol=1e-9) for r in got)
    assert all(r.identity_error <= 1e-6 for r in got)


VECTORS = "vec_id long, embedding array<double>, x string, i int, n int"


def test_whitening(spark):
    rnd = np.random.default_rng(3)
    mixed = rnd.normal(size=(300, 8)) @ rnd.normal(size=(8, 8)) * 3 + 50
    vectors = {i: v.tolist() for i, v in enumerate(mixed)}
    vectors |= {1000 + i: mixed[0].tolist() for i in range(150)}  # a third of all rows are equal
    odd = [(5000, None), (5001, [None] * 8), (5002, [float("nan")] + [1.0] * 7), (5003, [1.0] * 7 + [float("inf")]), (5004, []), (5005, [1.0, 2.0]), (5006, [1e300] * 8)]
    rows = [(i, v, "a", 1, 2) for i, v in [*vectors.items(), *odd]]
    table = spark.createDataFrame(rows, VECTORS).repartition(5)
    check_whitening(vectors, whitening.whiten(table).collect())
    assert {r.component for r in whitening.whiten(table, components=3).collect()} == {1, 2, 3}


def test_whitening_large_numbers(spark):
    rnd = np.random.default_rng(4)
    vectors = {i: (rnd.normal(size=3) * 1e9).tolist() for i in range(20)}  # squares beyond 64 bits
    check_whitening(vectors, whitening.whiten(spark.createDataFrame([(i, v, "a", 1, 2) for i, v in vectors.items()], VECTORS)).collect())


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        out = whitening.whiten(spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], VECTORS))
        assert out.collect() == [] and "identity_error" in out.columns
    # one of two dimensions is constant: one component
    flat = {i: [float(i), 7.0] for i in range(5)}
    check_whitening(flat, whitening.whiten(spark.createDataFrame([(i, v, "a", 1, 2) for i, v in flat.items()], VECTORS)).collect())
    # repeated and null ids keep all their rows
    rows = [(None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [3.0, 1.0])]
    assert whitening.whiten(spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], VECTORS)).count() == 6


def test_op12_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.select("vec_id", "embedding").collect()}
    check_whitening(vectors, QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001").collect())


# --- source divergence -----------------------------------------------------------------------


def brute(rows, least, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]  # lang, source, text
    found = [(g, s, Counter(re.findall("[A-Za-z\x80-\U0010ffff]+", t.translate({c: c + 32 for c in range(65, 91)})))) for g, s, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, c) for g, s, c in found if g == lang]
        held = Counter(t for _, c in own for t in c)
        kept = [t for t, n in held.items() if n >= least]
        sums = {s: Counter() for s, _ in own}
        whole_ = Counter()
        for s, c in own:
            sums[s].update(c)
            whole_.update(c)
        def rates(c):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}
        p, q = {s: rates(c) for s, c in sums.items()}, rates(whole_)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sums:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sums if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if sums[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms)]
    return sorted(out)


CORPUS = "lang string, source string, text string, sha string, n int, c int, docs int, first string"


def corpus(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], CORPUS)


@pytest.mark.parametrize(("chunk", "held"), [(256, 1 << 18), (2, 20)])
def test_divergence(spark, monkeypatch, chunk, held):
    monkeypatch.setattr(divergence, "SOURCES_AT_ONCE", chunk)
    monkeypatch.setattr(divergence, "HELD_COUNTS", held)
    rnd = random.Random(5)
    say = lambda: " ".join(rnd.choice(WORDS[: rnd.choice([3, 10, 20])]) for _ in range(rnd.randint(0, 30)))
    rows = [(rnd.choice(["en", "de", None]), rnd.choice("abc"), say()) for _ in range(200)]
    rows += [("en", "hot", "amber Birch CEDAR amber")] * 100 + [("en", s, "amber birch shared") for s in "abcdefghij"]
    rows += [("en", None, None), ("fr", "a", "rare words only"), ("fr", "b", None), ("de", "empty", "12 34"), ("de", "a", "Über ÜBER über " * 20), ("en", "long", "tide " * 50_000)]
    rows += [("de", "b", "naïve Ünder 😀😀")] * 12
    got = divergence.audit(corpus(spark, rows).repartition(6)).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute(rows, 10)


def test_divergence_odd_tables(spark):
    assert divergence.audit(corpus(spark, [])).collect() == []
    assert divergence.audit(corpus(spark, [(None, None, None)])).collect() == []
    rows = [("x", "a", None), ("x", "b", None)]
    got = divergence.audit(corpus(spark, rows)).collect()
    assert sorted((r.source, r.item, r.value, r["rank"]) for r in got) == [("a", "b", 0, 1), ("b", "a", 0, 1)]


def test_term_counts():
    texts = ["Aa bB aA\x00Ä ä 12", "", None, "@[`{\x7f\x80\u00e9Z", "ÀB-ÀB 😀 a"]
    terms, text, term, count = divergence.term_counts(pa.array(texts))
    got = Counter({(int(i), terms[int(t)].as_py()): int(c) for i, t, c in zip(text, term, count, strict=True)})
    want = Counter()
    for i, t in enumerate(texts):
        want.update((i, w) for w in re.findall("[A-Za-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)})))
    assert got == want
