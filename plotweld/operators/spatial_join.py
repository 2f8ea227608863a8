"""Distance join of two layers of boxes by grid cells.

Each side is dealt to the cells its (expanded) box covers; the equi-join on cells carries no
duplicates because a pair counts only in the cell of the lower left corner of the overlap of the two
boxes, which needs no shuffle. Cells of a few parcels keep hot cells small; AQE splits the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

CELL = 128.0


def _cells(df: DataFrame, b, cell: float, name: str) -> DataFrame:
    """A row for each cell that a box covers, dealt out in one go."""
    steps = lambda lo, hi: F.sequence(F.floor(lo / cell).cast("int"), F.floor(hi / cell).cast("int"))
    xs, ys = steps(b[0], b[2]), steps(b[1], b[3])
    return df.withColumn(name, F.explode(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))))


def distance_join(left: DataFrame, right: DataFrame, left_prefix: str, right_prefix: str, radius: Column | float = 0.0, cell: float = CELL) -> DataFrame:
    """Pairs whose boxes lie within `radius` (an expression of the left row); columns of both sides."""
    r = F.lit(float(radius)) if isinstance(radius, (int, float)) else radius
    lb, rb = g.box(left_prefix), g.box(right_prefix)
    l = _cells(left.withColumn("_r", r), (lb[0] - F.col("_r"), lb[1] - F.col("_r"), lb[2] + F.col("_r"), lb[3] + F.col("_r")), cell, "_c")  # noqa: E741
    rt = _cells(right, rb, cell, "_d")
    own = (F.floor(F.greatest(lb[0] - F.col("_r"), rb[0]) / cell) == F.col("_c.x")) & (F.floor(F.greatest(lb[1] - F.col("_r"), rb[1]) / cell) == F.col("_c.y"))
    meet = (F.col("_c.x") == F.col("_d.x")) & (F.col("_c.y") == F.col("_d.y")) & own & (g.distance(lb, rb) <= F.col("_r"))
    # Both sides go to their cells: the few bytes of a layer's file tell neither how large it is when broadcast nor what its pairs cost the one task that reads the other file.
    return l.hint("merge").join(rt, meet).drop("_c", "_d", "_r")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))
