"""The stored indexes beside the full searches."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sievewatch.operators import retrieval as rv
from sievewatch.plans import inverted, postings
from sievewatch.plans.nearest import nearest

VECTORS = "id string, embedding array<float>, code string, row long, list int, vector string"


def vectors(spark, rows, key="id"):
    return spark.createDataFrame([(i, v, "x", 1, 2, "y") for i, v in rows], VECTORS.replace("id", key, 1))


def clustered(rnd, n, dims=12, spots=30):
    middle = rnd.normal(size=(spots, dims)) * 4
    return (middle[rnd.integers(spots, size=n)] + rnd.normal(size=(n, dims))).astype(np.float32)


def test_index_recall_and_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "TRAIN_ROWS", 1200)
    rnd = np.random.default_rng(1)
    points = clustered(rnd, 3000)
    points[1000:2000] = points[0]  # a third of all rows are equal
    docs = vectors(spark, [(f"d{i}", v.tolist()) for i, v in enumerate(points)]).repartition(6)
    queries = vectors(spark, [(f"q{i}", (points[i * 17 % 3000] + 0.1).tolist()) for i in range(60)], "query_id")
    index = inverted.build_index(docs, str(tmp_path / "ix"))
    opened = inverted.Index(spark, str(tmp_path / "ix"))
    assert (opened.n, opened.dims, opened.n_probe) == (3000, 12, index.n_probe) and opened.sizes.sum() == 3000
    exact = nearest(queries, docs, 5).collect()
    got = opened.search(queries, 5).collect()
    assert len(got) == len(exact) == 300
    # where rows tie, any of the equal ones will do: distances are compared
    want = Counter((r.query_id, r.distance) for r in exact)
    assert sum((want & Counter((r.query_id, r.distance) for r in got)).values()) >= 270
    assert sorted(r["rank"] for r in got if r.query_id == "q3") == [1, 2, 3, 4, 5]
    few = opened.rows_searched(queries, 2).collect()
    assert len(few) == 60 and np.mean([r.searched for r in few]) < 1500
    # every list, every row compared: the full search, ties included
    whole = opened.search(queries, 5, n_probe=10**6, rerank=600).collect()
    assert {tuple(r) for r in whole} == {tuple(r) for r in exact}
    # a search reads the folders of its lists alone
    one = opened.search(queries.limit(1), 3, n_probe=1)
    assert "list IN" in one._jdf.queryExecution().toString() or "list#" in one._jdf.queryExecution().toString()


@pytest.mark.parametrize("slices", [(7, 3), (1 << 16, 1 << 11)])
def test_index_slices(spark, tmp_path, monkeypatch, slices):
    monkeypatch.setattr(inverted, "SLICE_ROWS", slices[0])
    monkeypatch.setattr(inverted, "SLICE_QUERIES", slices[1])
    rnd = np.random.default_rng(2)
    docs = vectors(spark, [(f"d{i % 40}", v.tolist()) for i, v in enumerate(clustered(rnd, 60, 5, 2))] + [("none", None)])  # repeated ids
    queries = vectors(spark, [("same", v.tolist()) for v in clustered(rnd, 9, 5, 2)] + [(None, [0.0] * 5), ("n", None)], "query_id")
    index = inverted.build_index(docs, str(tmp_path / f"ix{slices[0]}"), n_lists=3)
    got = index.search(queries, 4, n_probe=3, rerank=20).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, nearest(queries, docs, 4).collect()))


def test_index_groups(spark, tmp_path, monkeypatch):
    """Lists lie in groups, large ones in several; a query is sent to the groups, not to each list it opens."""
    monkeypatch.setattr(inverted, "GROUP_ROWS", 9)
    monkeypatch.setattr(inverted, "SLICE_QUERIES", 4)
    monkeypatch.setattr(inverted, "MOST_SLICE_QUERIES", 4)
    rnd = np.random.default_rng(6)
    points = clustered(rnd, 60, 5, 4)
    points[20:40] = points[0]
    docs = vectors(spark, [(f"d{i}", v.tolist()) for i, v in enumerate(points)])
    queries = vectors(spark, [(f"q{i}", v.tolist()) for i, v in enumerate(clustered(rnd, 9, 5, 4))], "query_id")
    index = inverted.build_index(docs, str(tmp_path / "ix"), n_lists=7)
    assert index.probes(inverted._asked(queries), 7).columns == ["q", "list"]  # no vector for each list
    got = index.search(queries, 4, n_probe=7, rerank=20).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in nearest(queries, docs, 4).collect()}


def test_index_search_sends_lists_not_rows(spark, tmp_path, monkeypatch):
    """No row for each query and list it opens, nor for each chosen row: they travel as lists."""
    rnd = np.random.default_rng(9)
    points = clustered(rnd, 150, 5, 4)
    docs = vectors(spark, [(f"d{i}", v.tolist()) for i, v in enumerate(points)])
    queries = vectors(spark, [(f"q{i}", v.tolist()) for i, v in enumerate(clustered(rnd, 9, 5, 4))], "query_id")
    index = inverted.build_index(docs, str(tmp_path / "ix"), n_lists=5)
    exact, size = {tuple(r) for r in nearest(queries, docs, 3).collect()}, dict(zip(index.lists.tolist(), index.sizes.tolist(), strict=True))
    opened = Counter()
    for r in index.probes(inverted._asked(queries), 2).collect():
        opened[r.q] += size[r.list]
    monkeypatch.setattr(inverted.Index, "probes", None)
    assert {r.q: r.searched for r in index.rows_searched(queries, 2).collect()} == opened
    for blocks, groups, room in ((1 << 17, 1 << 20, 1 << 10), (20, 40, 7)):  # vectors and codes in one part, or in several
        for name, value in (("BLOCK_VECTORS", blocks), ("GROUP_ROWS", groups), ("_ROOM", room), ("SLICE_QUERIES", 4), ("MOST_CHOSEN", 40)):
            monkeypatch.setattr(inverted, name, value)
        assert {tuple(r) for r in index.search(queries, 3, n_probe=5, rerank=50).collect()} == exact


def test_best_places_are_held_in_bounds():
    """Beside a sort of all distances: ties to the earlier place, values that single precision cannot hold come last."""
    rnd = np.random.default_rng(10)
    x, y = rnd.integers(0, 4, (30, 3)).astype(float), rnd.integers(0, 4, (5000, 3)).astype(float)
    y[17], y[18] = 1e30, np.nan
    best = inverted._Best(len(x), 12, len(y))
    for lo in range(0, len(y), inverted._ROOM):
        for part in (np.arange(20), np.arange(20, 30)):
            best.add(part, lo, inverted._apart(x[part], y[lo:lo + inverted._ROOM]))
    assert np.isfinite(inverted._apart(x, y)).all()
    n, place, value = best.found()
    assert best.keys.shape[1] < len(y) and n.tolist() == [12] * 30
    d = ((x[:, None, :] - np.nan_to_num(y, nan=1e30)[None]) ** 2).sum(axis=2)
    for i, (p, v) in enumerate(zip(place.reshape(30, 12), value.reshape(30, 12), strict=True)):
        want = np.lexsort((np.arange(len(y)), d[i]))[:12]
        assert sorted(p.tolist()) == sorted(want.tolist()) and sorted(v.tolist()) == sorted(d[i][want].tolist())


def test_index_odd(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        inverted.build_index(vectors(spark, []), str(tmp_path / "a"))
    with pytest.raises(ValueError, match="different lengths"):
        inverted.build_index(vectors(spark, [("a", [1.0]), ("b", [1.0, 2.0])]), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="no finished index"):
        inverted.Index(spark, str(tmp_path / "b"))
    one = inverted.build_index(vectors(spark, [("a", [1.0, 2.0])]), str(tmp_path / "c"))
    assert [tuple(r) for r in one.search(vectors(spark, [("q", [1.0, 0.0])], "query_id"), 5).collect()] == [("q", "a", 4.0, 1)]
    with pytest.raises(Exception, match="dimensions"):
        one.search(vectors(spark, [("q", [1.0])], "query_id"), 5).collect()


def test_search_through_an_index(spark, tmp_path):
    rnd = np.random.default_rng(3)
    rows = [("s", f"d{i}", f"n{i}", "long text " * 100, v.tolist()) for i, v in enumerate(clustered(rnd, 200, 6, 4))]
    docs = spark.createDataFrame(rows, "source string, id string, name string, text string, embedding array<float>")
    queries = vectors(spark, [(f"q{i}", rows[i][4]) for i in range(10)], "query_id")
    index = inverted.build_index(docs, str(tmp_path / "ix"))
    got = rv.search(queries, docs, 2, index=index, n_probe=99, rerank=100).collect()
    assert {(r.query_id, r.id, r.distance) for r in got} == {(r.query_id, r.id, r.distance) for r in rv.search(queries, docs, 2).collect()}
    assert all(len(r.text) == 500 for r in got)


# --- words -----------------------------------------------------------------------------------

TEXTS = "id string, text string, term string, row long, w double, tf int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2.0, 3) for i, t in rows], TEXTS)


def full_product(docs, queries, k):
    """Distances of all pairs that share a word, the best ``k`` of each query."""
    split = lambda t: Counter(w for w in re.split(r"[\W_]+", t.lower()) if w)
    docs = [(i, split(t)) for i, t in docs if t is not None]
    df = Counter(w for _, c in docs for w in c)
    idf = {w: math.log((len(docs) + 1) / (n + 1)) for w, n in df.items()}

    def unit(c):
        raw = {w: n * idf[w] for w, n in c.items() if w in idf}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items() if x > 0}

    out, held = Counter(), [(i, unit(c)) for i, c in docs]
    for q, t in queries:
        if t is None:
            continue
        u = unit(split(t))
        hits = sorted((round(max(0.0, 2 - 2 * sum(x * d[w] for w, x in u.items() if w in d)), 6), i) for i, d in held if u.keys() & d.keys())
        out.update((q, i, d, r + 1) for r, (d, i) in enumerate(hits[:k]))
    return out


def same_hits(got, want):
    """Equal but for the last digit of a distance."""
    near = lambda c: Counter((q, r, round(d, 5)) for q, _, d, r in c.elements())
    return near(got) == near(want) and sum((got & want).values()) >= 0.98 * sum(want.values())


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_text_search_equals_full_product(spark, tmp_path, k):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(vocabulary[int(300 * rnd.random() ** 2)] for _ in range(n))
    docs = [(f"d{i:03d}", "common " + some(rnd.randint(1, 60))) for i in range(250)] + [("x", None), ("y", ""), ("z", "Über straße 12"), ("z", "über again")]
    docs += [(f"hot{i:03d}", "same Text of many rows w1") for i in range(120)]
    queries = [(f"q{i}", "Common, " + some(rnd.randint(1, 15))) for i in range(25)]
    queries += [("none", None), ("empty", ""), ("unknown", "zzz yyy"), ("case", "ÜBER"), ("hot", "same text w1"), ("hot", "w2 w2 w2")]
    index = postings.build_text_index(texts(spark, docs).repartition(5), str(tmp_path / f"ix{k}"))
    asked = spark.createDataFrame(queries, "query_id string, query string")
    got = Counter(map(tuple, postings.TextIndex(spark, str(tmp_path / f"ix{k}")).search(asked, k).collect()))
    want = full_product(docs, queries, k)
    assert want and same_hits(got, want)
    if k == 1:  # some postings are never opened for their rows
        terms = index.query_terms(asked.selectExpr("monotonically_increasing_id() AS q", "query AS text"))
        marks = Counter(r.essential for r in index.plan(terms, k).collect())
        assert marks[False] > marks[True] / 10


def test_text_index_odd(spark, tmp_path):
    empty = postings.build_text_index(texts(spark, []), str(tmp_path / "a"))
    asked = spark.createDataFrame([("q", "word")], "query_id string, query string")
    assert empty.search(asked, 3).collect() == []
    single = postings.build_text_index(texts(spark, [("a", "word word")]), str(tmp_path / "b"))
    assert single.search(asked, 3).collect() == []  # a word of every row weighs nothing
    with pytest.raises(ValueError, match="no finished index"):
        postings.TextIndex(spark, str(tmp_path / "none"))


def test_alert_context_from_text(spark):
    docs = [("s", f"T{i}", f"name {i}", t, None) for i, t in enumerate(["ssh brute force login", "port scan of hosts", "unrelated words", None])]
    docs = spark.createDataFrame(docs, "source string, id string, name string, text string, embedding array<float>")
    alerts = spark.createDataFrame([("1", "Login brute force", ["sshd"]), ("2", "Login brute force", ["sshd"]), ("3", "quiet", None)],
                                   "alert_id string, description string, rule_groups array<string>")
    got = {r.alert_id: r.mitre_context for r in rv.alert_context(alerts, None, docs, 1).collect()}
    assert got["1"] == got["2"] and got["1"].startswith("[T0] name 0:\n") and got["3"] is None


def test_words_are_counted_within_their_row(spark):
    rows = spark.createDataFrame([(1, "b a A-c a"), (2, ""), (3, None), (4, "--"), (5, "x")], "row long, text string")
    counts = postings._counts(rows, "row")
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 3), (1, "b", 1), (1, "c", 1), (5, "x", 1)]
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
