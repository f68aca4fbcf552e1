"""Centroid clustering against a plain version in Python integers."""

import hashlib
import math
import random

from sheetwise.llm import centroids as K

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, id int, x int, v int, near string"


def plain(rows, k=16, rounds=3):
    edge = K.LIMIT
    points = [(i, [math.floor(max(-edge, min(edge, 64 * x))) for x in v]) for i, v in rows
              if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not points:
        return []
    key = lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest(), p[1])
    cents = [v for _, v in sorted(points, key=key)[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in points]
    for _ in range(rounds):
        near = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(points, near, strict=True) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assign()
    inertia = {j: sum(d for d, c in near if c == j) for j in range(len(cents))}
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, c, d, fits(inertia[c]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
            for (i, _), (d, c) in zip(points, near, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", 1, 2, 3, "n") for i, v in rows], SCHEMA)


def got(df):
    return [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()]


def order(rows):
    return sorted(rows, key=str)


def vector(r, size=64, by=1.0):
    import numpy as np
    return [float(x) for x in np.float32([r.gauss(0, by) for _ in range(size)])]


def test_odd_vectors(spark):
    r = random.Random(5)
    rows = [(i, vector(r, by=0.2)) for i in range(120)]
    same = vector(r)
    rows += [(200 + i, same) for i in range(40)] + [(7, vector(r)), (7, rows[7][1]), (None, vector(r)), (None, None), (300, None), (301, []), (302, vector(r, 63)),
             (303, vector(r, 65)), (304, same[:63] + [None]), (305, same[:63] + [float("nan")]), (306, same[:63] + [float("inf")]), (307, [float("-inf")] * 64)]
    df = K.cluster(frame(spark, rows))
    assert order(got(df)) == order(plain(rows))
    assert {r.vec_id: len(r.centroid) for r in df.collect()}[0] == 64


def test_huge_components_and_hot_cluster(spark):
    r = random.Random(6)
    rows = [(i, [3e38 if j == i % 64 else -3e38 if j == 5 else 0.25 for j in range(64)]) for i in range(30)] + [(100 + i, vector(r, by=0.01)) for i in range(60)]
    assert order(got(K.cluster(frame(spark, rows)))) == order(plain(rows))
    many = [(i, [3e38 if i % 2 else -3e38] * 64) for i in range(40)] + [(90 + i, [3e38] * 32 + [-3e38] * 32) for i in range(40)]
    assert order(got(K.cluster(frame(spark, many)))) == order(plain(many))


def test_few_and_none(spark):
    r = random.Random(7)
    few = [(i, vector(r)) for i in range(5)]
    assert order(got(K.cluster(frame(spark, few)))) == order(plain(few))
    empty = K.cluster(frame(spark, [(1, [1.0])]))
    assert empty.count() == 0
    assert empty.dtypes == K.cluster(frame(spark, few)).dtypes


def test_ties_go_to_the_smaller_number(spark):
    point = [0.0] * 64
    rows = [(i, [1.0 if j == i else 0.0 for j in range(64)]) for i in range(32)] + [(99, point)]
    assert order(got(K.cluster(frame(spark, rows)))) == order(plain(rows))


def test_other_sizes(spark):
    r = random.Random(8)
    rows = [(i, vector(r, 8)) for i in range(50)]
    df = K.cluster(frame(spark, rows), dims=8, scale=16, k=4, rounds=2, seed=3)
    assert df.count() == 50 and df.select("cluster").distinct().count() <= 4


def test_plan_is_native(spark):
    points = K.kept(frame(spark, [(i, [0.5] * 64) for i in range(20)]))
    plan = points.select(K.nearest(points.v, [[0] * 64, [1] * 64]).alias("near"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
