"""Hard negatives and whitening against brute force in exact integers; url filters against the lists themselves."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrolith.llm import hard_negatives, registry, url_filter, whitening

from ..conftest import SF

VECTORS = "vec_id long, embedding array<float>, label int"
BAD = [(900, None, 1), (901, [0.5, None, 0.1, 0.2], 1), (902, [0.5, float("nan"), 0.1, 0.2], 1), (903, [0.5, float("inf"), 0.1, 0.2], 1), (904, [], 1), (905, [0.1], 2)]


def vectors(n, d=4, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(v)) for v in rng.normal(scale=spread, size=d)], int(rng.integers(3))) for i in range(n)]


# --- hard negatives


def brute_negatives(rows, anchor, window=(80, 100)):
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows]
    out = []
    for a, (i, v, label) in enumerate(rows):
        if not anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, other == label) for b, (j, w, other) in enumerate(rows) if a != b]
        for s, j, _ in sorted(x for x in scored if x[2])[:5]:
            near = sorted((t, k) for t, k, same in scored if not same and window[0] * -s <= 100 * -t <= window[1] * -s)
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(near[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize("slice_rows, tree_anchors, spread", [(16_384, 2_048, 0.5), (40, 7, 0.1), (25, 3, 30.0)])
def test_hard_negatives_equal_brute_force(spark, slice_rows, tree_anchors, spread):
    rows = vectors(240, spread=spread)
    rows += [(1000 + i, rows[5][1], i % 2) for i in range(60)]  # equal vectors: ties by id
    rows += [rows[10], rows[10]]  # repeated rows
    df = spark.createDataFrame(rows + BAD + [(None, rows[0][1], 0), (950, rows[0][1], None)], VECTORS).withColumn("score", F.lit("clash"))
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, slice_rows=slice_rows, tree_anchors=tree_anchors)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_without_rows_or_anchors(spark):
    for rows in ([], BAD[:5], vectors(20)):
        assert hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.lit(False)).count() == 0
    ids = [(f"k{i}", v, "ab"[label % 2]) for i, v, label in vectors(50)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(ids, "vec_id string, embedding array<float>, label string"), F.col("vec_id") == "k7")
    assert sorted(map(tuple, got.collect())) == brute_negatives(ids, lambda i: i == "k7")


def test_spanning_tree_spans_and_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.integers(-99, 99, size=(40, 6))
    order, parent, edge = hard_negatives.spanning_tree(x)
    place = {int(k): i for i, k in enumerate(order)}
    assert sorted(place) == list(range(40))
    assert all(place[int(parent[k])] < place[k] for k in range(40) if k != order[0])
    assert all(edge[k] >= np.linalg.norm(x[k] - x[parent[k]]) for k in range(40))
    best = {0}
    total = 0.0  # the same length as a tree grown from the first row
    while len(best) < 40:
        d, k = min((float(np.linalg.norm(x[a] - x[b])), b) for a in best for b in range(40) if b not in best)
        total, best = total + d, best | {k}
    assert abs(edge.sum() - total) < 1e-5


def test_bounds_of_close_anchors_spare_scores():
    rng = np.random.default_rng(4)
    anchors = np.round(rng.normal(size=8) * 200 + rng.normal(size=(30, 8)) * 2).astype(np.int64)
    rows = np.round(rng.normal(size=(3000, 8)) * 200).astype(np.int64)
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    place = np.empty(30, dtype=int)
    place[order] = np.arange(30)
    table = lambda x, first, **more: pa.table({"id": np.arange(len(x)) + first, "row": np.arange(len(x)) + first, "label": np.zeros(len(x), dtype=int), "x": pa.array(list(x)), **more})
    cell = hard_negatives.Cell(table(anchors, 5000, place=place, parent=place[parent], edge=edge), table(rows, 0), 8)
    exact = cell.a @ cell.c.T

    def wanted(k, part, low, high, score):
        assert (low <= exact[k, part]).all() and (exact[k, part] <= high).all()
        at = np.flatnonzero(high >= np.sort(exact[k])[-5])
        assert (score(at) == exact[k, part][at]).all()

    cell.walk(wanted)
    assert cell.scored < 0.4 * 30 * 3000


# --- whitening


def test_cross_products_are_exact():
    rng = np.random.default_rng(2)
    for low, high, n in ((-5, 6, 100), (10**6 - 40, 10**6 + 40, 257), (0, 1, 64), (-(2**40), 2**40, 70), (7, 8, 3)):
        x = rng.integers(low, high, size=(n, 5))
        s, p = whitening.cross_products(x)
        big = x.astype(object)
        assert [int(v) for v in s] == [int(v) for v in big.sum(axis=0)] and (p.astype(object) == big.T @ big).all()


def test_whitening_equals_brute_force(spark):
    rows = vectors(300, d=6, seed=9)
    rows += [(2000 + i, rows[3][1], 0) for i in range(150)] + [(3000, [40.0, -30.0, 0.0, 1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows + BAD, VECTORS).withColumn("n", F.lit("clash")).repartition(5)
    got = {r["vec_id"]: r for r in whitening.whiten(df, components=4).collect()}
    assert len(got) == len(rows)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v, _ in rows], dtype=object)
    n, total = len(x), x.sum(axis=0)
    far = n * x - total
    v = np.array([[float(e) for e in r] for r in far.T @ far]) / n**3
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values)[:4]
    want = (far / n).astype(float) @ axes[:, order] / np.sqrt(values[order])
    have = np.array([got[i]["whitened"] for i, _, _ in rows])
    have *= np.sign((have * want).sum(axis=0))
    assert np.abs(have - want).max() < 1e-9
    assert [int(got[i]["deviation"]) for i, _, _ in rows] == [int(e) for e in (far**2).sum(axis=1)]
    one = got[0]
    assert one["n"] == n and one["identity_error"] < 1e-9 and np.allclose(one["explained"], values[order] / values.sum(), rtol=1e-9)
    assert abs(np.cov(have.T, bias=True) - np.eye(4)).max() < 1e-9


def test_whitening_of_edge_cases(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame(BAD[:5], VECTORS)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], 0)], VECTORS)).first()
    assert one["n"] == 1 and one["deviation"] == 0 and one["whitened"] == [None, None] and one["identity_error"] is None
    flat = whitening.whiten(spark.createDataFrame([(i, [i / 7, 2.0, i / 7], 0) for i in range(20)], VECTORS)).collect()  # one direction of three
    assert all(r["whitened"][1] is None and r["whitened"][2] is None and abs(r["whitened"][0]) < 5 for r in flat)
    assert flat[0]["identity_error"] < 1e-9 and abs(flat[0]["explained"][0] - 1) < 1e-9


def test_whitening_query(spark):
    got = registry.queries()["op12_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 32 * spark.read.parquet(f"{SF}/embeddings.parquet").count()


# --- url filters


def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(6)
    for n, m in ((5000, 300), (5000, 4900), (10, 10), (7, 0), (1, 1), (0, 0)):
        h = rng.integers(-(2**63), 2**63 - 1, size=(2, n))
        member = np.zeros(n, dtype=bool)
        member[rng.permutation(n)[:m]] = True
        levels = url_filter.cascade(*h, member)
        assert (url_filter.members(levels, *h) == member).all()
    bits = sum(len(w) for _, _, w in url_filter.cascade(*rng.integers(-(2**63), 2**63 - 1, size=(2, 100_000)), np.arange(100_000) < 1_000)) * 8
    assert bits < 16 * 1_000  # not 128 bits a key
    with pytest.raises(ValueError):
        url_filter.cascade(np.array([5, 5]), np.array([6, 6]), np.array([True, False]))


URLS = [
    None, "", "no scheme/net/", "http://a.net", "http://a.net/", "http://a.net?x=/", "HTTP://A.NET/x", "http://annet/x", "http://example.net/en/1", "http://b.example.net/EN/1",
    "http://example.net/en", "http://example.com/de/", "ftp://x.example.com/de/9#/fr/", "http://org/fr/1", "http://a.org/fr/../x", "http://a.org:80/fr/", "x://é.net/ü?q#f", "http://bad-pills.org/a/b",
    "http://bad-pills.org", "http://s.bad-pills.org/a/b", "http://..net//", "http:///x", "http://" + "a." * 3000 + "net/" + "p/" * 20_000 + "end", "a://b.net/://example.net/en/",
]


def brute_verdict(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = lambda key: (host == key.split("/")[0] or host.endswith("." + key.split("/")[0])) and path.startswith("/" + key.split("/", 1)[1])
    rule = max([(len(k), k, v) for v, k in rules if fits(k)], default=None)
    hit = max([(len(k), k) for k in listed if fits(k)], default=None)
    return (host, path, rule and rule[1], hit[1] if hit and not rule else None, rule[2] if rule else "block" if hit else "allow")


@pytest.mark.parametrize("shard_keys, pass_bytes", [(url_filter.SHARD_KEYS, url_filter.PASS_BYTES), (5, 40)])
def test_url_filter_equals_brute_force(spark, shard_keys, pass_bytes):
    rng = random.Random(4)
    urls = URLS + URLS[5:9] + [f"https://{rng.choice('abc')}{rng.randrange(30)}.{rng.choice(['net', 'org', 'x.com'])}/{rng.choice(['', 'en/', 'en/u/', 'fr/'])}{i}" for i in range(300)]
    listed = ["bad-pills.org/", "a3.net/", "b7.x.com/en/", "b7.x.com/en/u/", "c.d.e.f.org/", "x.com/fr/", "a3.net/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, `__keys` string")
    got = url_filter.filter_urls(pages, url_filter.RULES, spark.createDataFrame([(k,) for k in listed], "key string"), shard_keys=shard_keys, pass_bytes=pass_bytes)
    assert got.columns == ["page_id", "url", "__keys", "host", "path", "rule", "listed", "verdict"]
    have = {r["page_id"]: (r["host"], r["path"], r["rule"], r["listed"], r["verdict"]) for r in got.collect()}
    assert have == {i: brute_verdict(u, url_filter.RULES, listed) for i, u in enumerate(urls)}


def test_url_filter_without_rows_or_lists(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).count() == 0
    assert url_filter.filter_urls(pages, []).first()["verdict"] == "allow"
    both = url_filter.filter_urls(pages, [("block", "net/"), ("allow", "net/")]).first()
    assert (both["rule"], both["verdict"]) == ("net/", "allow")
