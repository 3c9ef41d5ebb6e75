"""Exact top-k and hard negatives against brute force; buckets, trees and products on their own."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexlake.llm import negatives, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, id string, row int, norm string, v int"


def random_vectors(seed, n, dims=8, labels=4):
    """Clusters, equal vectors, ties, zeros, and lengths that differ widely."""
    r = np.random.default_rng(seed)
    middles = r.normal(size=(5, dims))
    values = middles[r.integers(0, 5, n)] * r.choice([0.1, 1, 1, 3], n)[:, None] + r.normal(size=(n, dims)) * 0.05
    values[n // 2 : n // 2 + n // 4] = values[n // 2]
    values[:2] = 0
    return values, r.integers(0, labels, n)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and non-finite components, null rows, repeated rows, a shorter and an empty vector, and names that operators use themselves."""
    values, labels = random_vectors(1, 300)
    rows = [(i, [float(x) for x in v], int(lab), "x", 1, "y", 2) for i, (v, lab) in enumerate(zip(values, labels, strict=True))]
    rows += [(1000, None, 1, "x", 1, "y", 2), (1020, [1.0, None], 1, "x", 1, "y", 2), (1040, [math.nan, 1.0], 1, "x", 1, "y", 2), (1050, [math.inf], 1, "x", 1, "y", 2), (None, [1.0] * 8, 1, "x", 1, "y", 2)]
    rows += [(1060, [0.5, 0.25], 1, "x", 1, "y", 2), (1080, [], 1, "x", 1, "y", 2), (1100, [0.4] * 8, None, "x", 1, "y", 2), rows[100], rows[100], (-20, [0.3] * 8, 2, "x", 1, "y", 2)]
    return spark.createDataFrame(rows, SCHEMA)


def taking_part(df, scale):
    out = []
    for r in df.collect():
        if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
            out.append((r.vec_id, [math.floor(scale * x) for x in r.embedding], r.label))
    return out


def inner(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, k, every):
    out = []
    for i, (q, v, _) in enumerate(rows):
        if q % every == 0:
            best = sorted((-inner(v, w), c) for j, (c, w, _) in enumerate(rows) if j != i)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def brute_negatives(rows, every, positives, wanted, low, high):
    out = []
    rows = [r for r in rows if r[2] is not None]
    for i, (a, v, label) in enumerate(rows):
        if a % every:
            continue
        scored = sorted((-inner(v, w), c, lab) for j, (c, w, lab) in enumerate(rows) if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(-n, c) for n, c, lab in scored if lab != label and low * -s <= 100 * -n <= high * -s][:wanted]
            out += [(a, p, k + 1, c, -s, n) for k, (n, c) in enumerate(fits)]
    return sorted(out)


def test_op12(odd):
    got = topk.exact_top_k(odd, F.col("id") % 20 == 0, k=7).collect()
    assert sorted(map(tuple, got)) == brute_top(taking_part(odd, 64), 7, 20)


def test_op12_strips_and_buckets(spark, odd, monkeypatch):
    """Many strips, buckets of few rows, and pruning by coordinates from low cosines on give the same."""
    for name, value in (("BUCKET_ROWS", 16), ("COSINE", 0.2), ("TOGETHER", 64)):
        monkeypatch.setattr(topk, name, value)
    values, ids = vectors.matrix(__import__("pyarrow").array([v for _, v, _ in taking_part(odd, 64)]), 1), np.array([i for i, _, _ in taking_part(odd, 64)])
    numbers = np.arange(len(ids))
    asked = np.flatnonzero(ids % 20 == 0)
    search = topk.Search(values[asked], numbers[asked], 7)
    order = np.argsort(-vectors.lengths_of(values), kind="stable")
    for a, b in topk.buckets(vectors.lengths_of(values)[order]):
        search.meet(topk.Bucket(values[order[a:b]], ids[order[a:b]], numbers[order[a:b]]))
    q, s, i, _ = search.best.found()
    got = sorted((int(ids[asked[x]]), int(y), int(z)) for x, y, z in zip(q, s, i, strict=True))
    assert got == sorted((q, s, c) for q, _, c, s in brute_top(taking_part(odd, 64), 7, 20))
    monkeypatch.setattr(vectors, "QUERY_STRIP", 5)
    monkeypatch.setattr(vectors, "LEAST_STRIP", 40)
    assert sorted(map(tuple, topk.exact_top_k(odd, F.col("id") % 20 == 0, k=7).collect())) == brute_top(taking_part(odd, 64), 7, 20)


def test_few_and_none(spark, odd):
    few = odd.filter("vec_id in (0, 7, 20)")
    assert sorted(map(tuple, topk.exact_top_k(few, F.col("id") % 20 == 0).collect())) == brute_top(taking_part(few, 64), 20, 20)
    none = odd.limit(0)
    assert topk.exact_top_k(none, F.col("id") % 20 == 0).collect() == [] and negatives.hard_negatives(none, F.col("id") % 50 == 0).collect() == []


def test_coordinates_keep_all_that_reach():
    """Whatever a bucket's coordinates leave out can't reach the cosine."""
    r = np.random.default_rng(3)
    values = np.floor(64 * r.normal(size=(400, 3)))
    bucket = topk.Bucket(values, np.arange(400), np.arange(400))
    unit = bucket.values / np.maximum(bucket.norms, 1)[:, None]
    for _ in range(50):
        q = r.normal(size=3)
        q /= np.linalg.norm(q)
        for cosine in (0.3, 0.8, 0.99):
            assert set(np.flatnonzero(unit @ q >= cosine)) <= set(bucket.within(q, cosine).tolist())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1.0, 1e3, 1e9, 1e30, 1e200]))
def test_products_are_exact(seed, size):
    r = random.Random(seed)
    a, b = ([[math.floor(r.uniform(-size, size)) for _ in range(3)] for _ in range(4)] for _ in range(2))
    exact = [[min(max(inner(x, y), vectors.LEAST + 1), vectors.MOST) for y in b] for x in a]
    assert vectors.products(np.array(a, float), np.array(b, float)).tolist() == exact


def test_best_keeps_ties_by_id():
    best = vectors.Best(2, 2)
    best.offer(np.array([1, 1, 1, 0]), np.array([5, 5, 5, 1]), np.array([9, 3, 7, 2]), np.array([0, 1, 2, 3]))
    best.offer(np.array([1]), np.array([5]), np.array([1]), np.array([8]))
    assert [x.tolist() for x in best.found()] == [[0, 1, 1], [1, 5, 5], [2, 1, 3], [3, 8, 1]]
    assert best.least.tolist() == [vectors.LEAST, 5]


@pytest.mark.parametrize("dims", [1, 2, 16])
def test_cover_tree(dims):
    """Each row is held once; nodes cover what is below; radii at least halve; centres of siblings stand apart."""
    values = np.floor(64 * random_vectors(dims, 500, dims)[0])
    tree = negatives.CoverTree(values)
    norms = vectors.lengths_of(values)
    points = np.column_stack([values, np.sqrt(np.maximum(norms.max() ** 2 - norms**2, 0))])

    def below(node):
        first, last = tree.children[node]
        return [*tree.own[node], *(x for c in range(first, last) for x in below(c))]

    assert sorted(below(0)) == list(range(500))
    for node in range(len(tree.centre)):
        away = np.linalg.norm(points[below(node)] - points[tree.centre[node]], axis=1)
        assert away.max() <= tree.radius[node] + 1e-6
        first, last = tree.children[node]
        assert all(tree.radius[c] <= tree.radius[node] / 2 + 1e-9 for c in range(first, last))
        centres = points[tree.centre[first:last]]
        for i in range(len(centres)):
            assert all(np.linalg.norm(centres[i] - centres[j]) > tree.radius[node] / 2 - 1e-6 for j in range(i))


@pytest.mark.parametrize("rows", [2_048, 40])
def test_op13(odd, monkeypatch, rows):
    monkeypatch.setattr(negatives, "TREE_ROWS", rows)
    got = negatives.hard_negatives(odd, F.col("id") % 50 == 0).collect()
    expected = brute_negatives(taking_part(odd, 256), 50, 5, 3, 50, 95)
    assert expected and sorted(map(tuple, got)) == expected


def test_op13_windows(odd):
    """Other windows and counts, and labels by an expression."""
    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 4 ELSE label END"
    rows = [(i, v, None if lab is None else (lab + 1) % 4 if i % 7 == 0 else lab) for i, v, lab in taking_part(odd, 16)]
    got = negatives.hard_negatives(odd, F.col("id") % 25 == 0, positives=3, negatives=8, least=-20, most=120, scale=16, label=label).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, 25, 3, 8, -20, 120)
