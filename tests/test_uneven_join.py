import math
import random

import pytest
from pyspark.sql import functions as F

from plotweld.functions import geometry as g
from plotweld.operators import uneven_join as u

COLS = "id int, xmin double, ymin double, xmax double, ymax double"


def boxes(seed, n, sizes):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w, h, x, y = rng.choice(sizes), rng.choice(sizes), rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)
        out.append((k, x, y, x + w, y + h))
    return out


def near(a, b, r):
    dx, dy = max(0.0, a[1] - b[3], b[1] - a[3]), max(0.0, a[2] - b[4], b[2] - a[4])
    return math.sqrt(dx * dx + dy * dy) <= r


def prefixed(df, p):
    return df.select(*(F.col(c).alias(p + c) for c in df.columns))


def frames(spark, left, right):
    return prefixed(spark.createDataFrame(left, COLS), "l_"), prefixed(spark.createDataFrame(right, COLS), "r_")


@pytest.mark.parametrize("full,hot", [(10_000, 100_000), (7, 1_000), (3, 100_000)])
def test_all_sizes_against_brute_force(spark, full, hot):
    """Points to boxes over the whole extent, with and without salts; a dense block; repeated rows; touching at just the radius."""
    sizes = (0.0, 0.0, 1.0, 16.0, 40.0, 700.0, 6000.0)
    left = boxes(1, 60, sizes) + [(100 + k, 5.0 + k % 3, 5.0, 6.0 + k % 3, 6.0) for k in range(20)] + [(200, 0.0, 0.0, 16.0, 16.0)] * 2
    right = boxes(2, 60, sizes) + [(100 + k, 4.0 + k % 7, 4.0, 4.5 + k % 7, 4.5) for k in range(30)] + [(300, 18.0, 0.0, 20.0, 16.0), (301, -1e9, -1e9, 1e9, 1e9)]
    l, r = frames(spark, left, right)  # noqa: E741
    for radius in (0.0, 2.0, 250.0):
        got = sorted((x.l_id, x.r_id) for x in u.uneven_join(l, r, "l_", "r_", radius, full=full, hot=hot).collect())
        assert got == sorted((a[0], b[0]) for a in left for b in right if near(a, b, radius))
        assert (200, 300) in got or radius < 2


def test_radius_of_the_row_and_rows_without_place(spark):
    odd = [(1, None, 0.0, 1.0, 1.0), (2, 5.0, 0.0, 1.0, 1.0), (3, float("nan"), 0.0, 1.0, 1.0), (4, 0.0, 0.0, float("inf"), 1.0), (5, 0.0, 0.0, 1.0, 1.0)]
    l, r = frames(spark, odd, odd + [(6, 4.0, 0.0, 4.0, 0.0)])  # noqa: E741
    assert [(x.l_id, x.r_id) for x in u.uneven_join(l, r, "l_", "r_").collect()] == [(5, 5)]
    own = l.withColumn("reach", F.when(F.col("l_id") == 5, 3.0))
    got = u.uneven_join(own, r, "l_", "r_", F.col("reach"))
    assert sorted((x.l_id, x.r_id) for x in got.collect()) == [(5, 5), (5, 6)] and got.columns == [*own.columns, *r.columns]
    assert u.uneven_join(l, r, "l_", "r_", -1.0).count() == 0
    assert u.uneven_join(l.limit(0), r, "l_", "r_").count() == u.uneven_join(l, r.limit(0), "l_", "r_").count() == 0


def test_a_wide_box_over_a_dense_block_is_cut_up(spark):
    """4,000 small boxes in one block, under boxes as wide as the map: no cell and salt holds more than about FULL rows of a side."""
    dense = spark.range(4000).select(F.col("id").cast("int").alias("id"), *(((F.col("id") * k) % 97 / 10).alias(n) for k, n in ((7, "xmin"), (11, "ymin"))))
    dense = prefixed(dense.withColumns({"xmax": F.col("xmin") + 0.05, "ymax": F.col("ymin") + 0.05}), "r_")
    l, _ = frames(spark, [(k, -1e6, -1e6, 1e6, 1e6) for k in range(3)], [(0, 0.0, 0.0, 0.0, 0.0)])  # noqa: E741
    rows, others = u.dealt(l, dense, g.box("l_"), g.box("r_"), full=200)
    sizes = [x["count"] for x in others.groupBy(*u.CELL, "_sl", "_sr").count().collect() if x["count"] > 5]
    met = others.join(rows.select(*u.CELL, "_sl", "_sr").distinct(), [*u.CELL, "_sl", "_sr"]).groupBy("_x", "_y", "_sr").count().collect()
    assert len(met) >= 15 and max(x["count"] for x in met) < 2 * sorted(x["count"] for x in met)[len(met) // 2]
    assert max(x["count"] for x in met) < 300 and sizes
    assert u.uneven_join(l, dense, "l_", "r_", full=200).count() == 12_000


def test_finer_rows_do_not_meet_on_a_coarse_level(spark):
    """One wide box a side brings all small boxes into its cell; there they are keyed apart and not compared with each other."""
    small = [(k, 50.0 * k, 0.0, 50.0 * k + 10, 10.0) for k in range(300)]
    l, r = frames(spark, small + [(900, 0.0, 0.0, 1e5, 1e5)], small + [(901, 0.0, 0.0, 1e5, 1e5)])  # noqa: E741
    rows, others = u.dealt(l, r, g.box("l_"), g.box("r_"))
    compared = rows.join(others.withColumnRenamed("_b", "_o"), [*u.CELL, "_sl", "_sr"]).count()
    assert compared < 10 * (300 + 2 * 300 + 1)
