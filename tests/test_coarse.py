"""Sampled coarse levels against a plain version of the rules."""

import hashlib
from collections import defaultdict
from fractions import Fraction
from math import isqrt, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import coarse as C
from tesserae.operators.tiles import TileGrid


def share(items, target):
    """{item: (count, weight)} to {item: quota}."""
    each = int(target >= len(items))
    rest, left = target - each * len(items), dict(items)
    quota = {}
    while left:  # who gets more than there is takes all of it; the others share the rest
        weights = sum(w for _, w in left.values())
        full = [i for i, (n, w) in left.items() if (n - each) * weights <= rest * w]
        if not full:
            break
        first = min(full, key=lambda i: (Fraction(left[i][0] - each, left[i][1]), i))
        quota[first] = left[first][0]
        rest -= left.pop(first)[0] - each
    weights = sum(w for _, w in left.values())
    parts = {i: Fraction(rest * w, weights) for i, (n, w) in left.items()}
    over = rest - sum(p.__floor__() for p in parts.values())
    for i in sorted(parts, key=lambda i: (parts[i].__floor__() - parts[i], i)):
        quota[i] = each + parts[i].__floor__() + (over > 0)
        over -= over > 0
    return quota


def plain(points, leaf, levels, capacity, cells, seed):
    weigh = lambda n: int(sqrt(n) * C.FAIRNESS)
    totals = defaultdict(int)
    for _, _, v, _ in points:
        totals[v] += 1
    mean = len(points) / len(totals)
    boost = {v: min(C.MAX_BOOST, max(1, int(sqrt(mean / n)))) for v, n in totals.items()}
    digest = lambda p: int(hashlib.md5(f"{seed}:{p[2]}:{p[3]}".encode()).hexdigest()[:15], 16)
    alive, coarsest = list(points), {}
    for level in range(levels):
        size = leaf * 2**level
        tiles = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        for p in alive:
            tile = (int(p[0] // size), int(p[1] // size))
            part = size / 2 if level else leaf / cells
            k = 2 if level else cells
            cell = int(p[1] // part) % k * k + int(p[0] // part) % k
            tiles[tile][cell][p[2]].append(p)
        alive = []
        for strata in tiles.values():
            sizes = {c: sum(map(len, vs.values())) for c, vs in strata.items()}
            goals = share({c: (n, weigh(n)) for c, n in sizes.items()}, min(capacity << level, sum(sizes.values())))
            for c, vs in strata.items():
                quotas = share({v: (len(ps), weigh(len(ps)) * boost[v]) for v, ps in vs.items()}, goals[c])
                for v, ps in vs.items():
                    alive += sorted(ps, key=lambda p: (digest(p), p[3]))[: quotas[v]]
        for p in alive:
            coarsest[p[3]] = level
    return coarsest


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    rows = [(float(x), float(y), int(v)) for x, y, v in zip(rng.random(1500) * 64, rng.random(1500) * 40, rng.geometric(0.4, 1500))]
    rows += [(3.0, 3.0, 1)] * 300 + [(50.5, 1.5, 100 + i) for i in range(60)]  # one place, and many values seen once
    return [(*r, i) for i, r in enumerate(rows)]


@pytest.mark.parametrize("capacity, partitions", [(40, 3), (40, 11), (7, 4), (5000, 2)])
def test_levels_follow_the_rules(spark, points, capacity, partitions):
    df = spark.createDataFrame(points, "x double, y double, value long, id long").repartition(partitions)
    grid = TileGrid(0.0, 0.0, 64.0, 40.0, 8.0, 4)
    found = C.coarse_levels(df, grid, "id", "value", capacity=capacity, cells=4, seed=3)
    assert found.columns == ["x", "y", "value", "id", "tile_x", "tile_y", "coarsest"]
    got = {r.id: r.coarsest for r in found.collect()}
    assert got == plain(points, 8.0, 4, capacity, 4, 3)
    for level in range(4):
        most = C.level_points(found, level).groupBy("tile_x", "tile_y").count().agg(F.max("count")).first()[0]
        assert most <= capacity << level


def test_short_groups_are_taken_again(spark, points, monkeypatch):
    monkeypatch.setattr(C, "DIGEST_BITS", 63)  # digests of 60 bits under a bound of 63: too low by a factor of eight is too high here
    df = spark.createDataFrame(points, "x double, y double, value long, id long")
    grid = TileGrid(0.0, 0.0, 64.0, 40.0, 8.0, 2)
    want = plain(points, 8.0, 2, 40, 4, 0)
    monkeypatch.setattr(C, "priority", lambda v, i, seed: (F.conv(F.substring(F.md5(
        F.concat_ws(":", F.lit("0"), v.cast("string"), i.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long") + F.lit(7 << 60)))
    found = C.coarse_levels(df, grid, "id", "value", capacity=40, cells=4)
    assert {r.id: r.coarsest for r in found.collect()} == want


def test_quotas_of_large_counts(spark):
    rows = [(0, i, n) for i, n in enumerate([10**13, 10**13, 1, 3, 10**9])]
    df = spark.createDataFrame(rows, "k long, item long, n long").withColumn("goal", F.lit(1000).cast("long"))
    got = C.apportion(df.withColumn("w", C.weight(F.col("n"))), ["k"], "item", "n", "w", "goal", "quota").collect()
    want = share({i: (n, isqrt(n * C.FAIRNESS**2)) for _, i, n in rows}, 1000)
    assert {r.item: r.quota for r in got} == want and sum(want.values()) == 1000


def test_faulty_parameters(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1, 1)], "x double, y double, value long, id long")
    grid = TileGrid(0.0, 0.0, 1.0, 1.0, 1.0, 1)
    for bad in ({"cells": 3}, {"cells": 0}, {"capacity": 0}):
        with pytest.raises(ValueError):
            C.coarse_levels(df, grid, "id", "value", **bad)
    assert C.coarse_levels(df.limit(0), grid, "id", "value").count() == 0
    assert C.coarse_levels(df, grid, "id", "value").first()["coarsest"] == 0
