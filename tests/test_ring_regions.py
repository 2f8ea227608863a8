"""Ring expressions for any shape: by hand, and against point sampling on a fine grid of unit cells."""

import numpy as np
from pyspark.sql import functions as F

from plotweld.functions import rings

RING = "array<struct<x: double, y: double>>"
BASE = np.array([500000.0, 3000000.0])


def at(*points):
    return [tuple(map(float, BASE + p)) for p in points]


def one(spark, expression, **columns):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else f'array<{RING}>' if v and isinstance(v[0], list) else RING}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], kinds).select(expression.alias("v")).first().v


SQUARE = at((0, 0), (10, 0), (10, 10), (0, 10))
ELL = at((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10))
U = at((0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10))
BOW = at((0, 0), (10, 10), (10, 0), (0, 10))


def test_shapes_that_are_not_convex(spark):
    a, b = F.col("a"), F.col("b")
    cases = [(ELL, SQUARE, 64), (U, SQUARE, 72), (ELL, U, 54), (ELL, ELL, 64), (BOW, SQUARE, 50), (SQUARE, at((20, 0), (30, 0), (25, 9)), 0), (SQUARE, at((10, 0), (20, 0), (20, 10), (10, 10)), 0), (SQUARE[::-1], ELL, 64)]
    for x, y, want in cases:
        assert abs(one(spark, rings.overlap_area(a, b), a=x, b=y) - want) < 1e-6


def test_areas_against_cells(spark):
    rng = np.random.default_rng(3)
    steps = (np.arange(400) + 0.5) / 400 * 12 - 1
    gx, gy = np.meshgrid(steps, steps)

    def inside(r):
        flag = np.zeros(gx.shape, bool)
        for (ax, ay), (bx, by) in zip(r, np.roll(r, -1, 0), strict=True):
            if ay != by:
                flag ^= ((ay > gy) != (by > gy)) & (gx < (bx - ax) * (gy - ay) / (by - ay) + ax)
        return flag

    sets = [[np.stack([5 + np.cos(t) * q * 5, 5 + np.sin(t) * q * 5], 1) for t, q in ((np.sort(rng.uniform(0, 6.28, n)), rng.uniform(0.2, 1, n)) for n in (5, 7, 6))] for _ in range(12)]
    df = spark.createDataFrame([(i, [at(*r) for r in s]) for i, s in enumerate(sets)], f"i int, rs array<{RING}>")
    rows = df.select("i", rings.covered_area(F.get("rs", F.lit(0)), F.slice("rs", 2, 2)).alias("c"), rings.union_area(F.col("rs")).alias("u"), rings.overlap_area(F.get("rs", F.lit(0)), F.get("rs", F.lit(1))).alias("o")).collect()
    for r in rows:
        a, b, c = map(inside, sets[r.i])
        cell = (12 / 400) ** 2
        for got, want in ((r.c, a & (b | c)), (r.u, a | b | c), (r.o, a & b)):
            assert abs(got - want.sum() * cell) < 0.25


def test_points_and_contact(spark):
    r, v = F.col("r"), F.get("p", F.lit(0))
    for p, want in (((1, 9), 0), ((7, 7), 3), ((12, 2), 2), ((-3, -4), 5)):
        assert abs(one(spark, rings.distance_to(v, r), r=ELL, p=at(p)) - want) < 1e-9
    for other, want in ((at((10, 0), (20, 0), (20, 5)), True), (at((5, 5), (9, 5), (9, 9)), False), (at((1, 1), (2, 1), (2, 2)), True), (at((-5, -5), (30, -5), (30, 30), (-5, 30)), True), (at((11, 11), (12, 11), (12, 12)), False)):
        assert one(spark, rings.meets(r, F.col("o")), r=ELL, o=other) is want


def test_inset(spark):
    area = lambda d, r=SQUARE: one(spark, rings.let(rings.inset(F.col("r"), d), rings.area), r=r)
    assert abs(area(2) - 36) < 1e-6 and abs(area(2, SQUARE[::-1]) - 36) < 1e-6 and abs(area(-1) - 144) < 1e-6
    assert one(spark, F.size(rings.inset(F.col("r"), 6)), r=SQUARE) == 0
    assert abs(area(1, at((0, 0), (12, 0), (0, 16))) - 0.5 * 12 * 16 * (3 / 4) ** 2) < 1e-6  # a triangle keeps its shape: inradius 4


def test_fixes(spark):
    fix = lambda r: one(spark, rings.fixed(F.col("r")), r=r)
    bow = fix(BOW)
    assert bow.fixes == ["make_valid", "multipart_to_largest"] and abs(one(spark, rings.area(F.col("r")), r=[tuple(v) for v in bow.ring]) - 25) < 1e-6
    skew = fix(at((0, 0), (10, 10), (10, 0), (0, 4)))
    assert abs(one(spark, rings.area(F.col("r")), r=[tuple(v) for v in skew.ring]) - 0.5 * 10 * (10 - 4 / 1.4)) < 1e-6
    assert fix(SQUARE).fixes == [] and fix(SQUARE[:2] + SQUARE[1:]).fixes == ["dedupe_vertices"] and len(fix([*SQUARE, SQUARE[0]]).ring) == 4
    twice = fix(at((0, 0), (6, 0), (6, 4), (2, -2), (2, 5), (0, 5)))
    assert one(spark, rings.validity(F.col("r")), r=[tuple(v) for v in twice.ring]) is None
    assert fix([]) is None
