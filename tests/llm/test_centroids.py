"""Centroid clustering against plain Python integers, and odd rows."""

import hashlib
import math
import random

import numpy
import pytest

from tidemark.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, cluster int, values string"


def plain(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [list(v) for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds if centres else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centres)]
    if not centres:
        return []
    placed = [(i, *reversed(near(v))) for i, v in kept]
    own = {}
    for _, c, d in placed:
        own[c] = own.get(c, 0) + d
    return sorted([(i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in placed], key=str)


def got(spark, rows, **more):
    made = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, centroids.clustered(made, **more).collect()), key=str)


def vectors(n, dims, seed=1):
    r = random.Random(seed)
    return [(i, [r.choice([-1, 0, 1]) + r.random() / 4 for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize(("k", "rounds", "n"), [(4, 5, 60), (7, 0, 30), (9, 2, 5)])
def test_equals_plain_integers(spark, k, rounds, n):
    rows = [(i, [float(numpy.float32(x)) for x in v]) for i, v in vectors(n, 3)]
    assert got(spark, rows, k=k, rounds=rounds, dims=3) == plain(rows, k, rounds, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (1, [2.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [-3.0, -3.0]), (9, [0.5, 0.5]), (-4, [-0.001, 0.0])]
    assert got(spark, rows, k=3, rounds=4, dims=2) == plain(rows, 3, 4, 2)
    assert got(spark, [(None, [1.0, 2.0])], k=3, dims=2) == [] and got(spark, [], k=3, dims=2) == []
    ties = [(i, [float(i % 2), 0.0]) for i in range(40)]
    assert got(spark, ties, k=6, rounds=3, dims=2) == plain(ties, 6, 3, 2)  # equal centroids: the smaller number has all, the others stay as they are


def test_too_large_a_component(spark):
    with pytest.raises(Exception, match="or larger"):
        got(spark, [(1, [1e9, 0.0]), (2, [1.0, 1.0])], k=1, dims=2)
