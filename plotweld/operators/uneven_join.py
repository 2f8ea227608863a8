"""Distance join of layers whose boxes differ much in size or in density.

A box lives in cells of about its own size: the cell of level v is SMALLEST * 2^v wide, so a box touches at most four.
Two boxes meet on the coarser of their levels, to which the finer one is dealt as well, and only on levels that the
other side has. There a pair counts in the cell of the lower left corner of what the boxes share, hence once.
Cells are counted first; those with very many rows are cut into a matrix of salts, so a country-wide box over a dense
block is compared in many tasks. The table of such cells has a proven bound: each holds more than 1 / HOT of the rows
dealt on one side, so there are fewer than 2 * HOT of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions import geometry as g
from .lineage import cut

SMALLEST = 16.0
FULL = 10_000  # rows of one side in a cell and salt
HOT = 100_000
FAR = 1e12  # coordinates beyond it belong to no cell
SLACK = 1e-6  # of a box's expansion, so that rounding loses no pair at just the radius

CELL = ["_v", "_x", "_y", "_w"]


def _levelled(df: DataFrame, b: tuple[Column, ...], smallest: float) -> DataFrame:
    """The box to deal as `_b` with its level; rows without a finite, upright box go, as they are near nothing."""
    side = F.greatest(b[2] - b[0], b[3] - b[1], F.lit(smallest))
    level = F.ceil(F.log2(side / smallest)).cast("int")
    box = F.struct(*(c.alias(n) for c, n in zip(b, ("x0", "y0", "x1", "y1"), strict=True)), level.alias("v"))
    sound = (b[0] <= b[2]) & (b[1] <= b[3]) & (F.least(b[0], b[1]) > -FAR) & (F.greatest(b[2], b[3]) < FAR)
    return df.where(sound).withColumn("_b", box)


def _dealt(df: DataFrame, levels: DataFrame, smallest: float, first: bool) -> DataFrame:
    """A row for each cell on the box's own level and on every coarser one of the other side.

    `_w` keeps finer rows of both sides apart, which meet on a level of their own: 0 joins the first side's own rows
    with all of the second, 1 the first side's finer rows with the second's own.
    """
    own, theirs = F.col("_b.v"), "_of_r" if first else "_of_l"
    rows = df.crossJoin(F.broadcast(levels.select(theirs))).withColumn("_v", F.explode(F.array_union(F.array(own), F.filter(theirs, lambda v: v > own)))).drop(theirs)
    at_home = F.col("_v") == own
    if first:
        rows = rows.withColumn("_w", F.when(at_home, 0).otherwise(1))
    else:
        rows = rows.withColumn("_w", F.explode(F.when(at_home, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    size = smallest * F.pow(F.lit(2.0), F.col("_v"))
    for name, lo, hi in (("_x", "_b.x0", "_b.x1"), ("_y", "_b.y0", "_b.y1")):
        rows = rows.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))))
    return rows


def _hot(left: DataFrame, right: DataFrame, full: int, hot: int) -> DataFrame:
    """Cells where both sides have rows and one has more than `full` and than 1 / `hot` of all it deals, with the salts of each side.

    Both results are small and computed now, so that the join's plan does not repeat how they were found.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select(*CELL, one.alias("l"), none.alias("r")).unionByName(right.select(*CELL, none.alias("l"), one.alias("r")))
    cells = both.groupBy(CELL).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    total = cut(both.agg(F.sum("l").alias("all_l"), F.sum("r").alias("all_r")))
    many = lambda n, of: (F.col(n) > full) & (F.col(n) * hot > F.col(of))
    found = cells.where("l > 0 and r > 0").crossJoin(F.broadcast(total)).where(many("l", "all_l") | many("r", "all_r"))
    return cut(found.select(*CELL, F.ceil(F.col("l") / full).alias("_nl"), F.ceil(F.col("r") / full).alias("_nr")))


def _salted(rows: DataFrame, hot: DataFrame, columns: list[str], mine: str, theirs: str) -> DataFrame:
    """Each row takes one salt of its own side, by its content so that a task that is run again deals it alike, and all of the other's."""
    n = {c: F.coalesce(F.col(c), F.lit(1).cast("long")) for c in ("_nl", "_nr")}
    out = rows.join(F.broadcast(hot), CELL, "left")
    own = F.pmod(F.xxhash64(*columns), n[f"_n{mine}"])
    return out.withColumn(f"_s{mine}", own).withColumn(f"_s{theirs}", F.explode(F.sequence(F.lit(0).cast("long"), n[f"_n{theirs}"] - 1))).drop("_nl", "_nr")


def dealt(left: DataFrame, right: DataFrame, lb: tuple[Column, ...], rb: tuple[Column, ...], smallest: float = SMALLEST, full: int = FULL, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows by level, cell and salt."""
    plain = lambda df: [c for c in df.columns if not isinstance(df.schema[c].dataType, MapType)]
    names = plain(left), plain(right)
    l, r = _levelled(left, lb, smallest), _levelled(right, rb, smallest)  # noqa: E741
    seen = lambda df, name: df.agg(F.collect_set("_b.v").alias(name))
    levels = cut(seen(l, "_of_l").crossJoin(seen(r, "_of_r")))  # one row, of at most some forty levels a side
    dl, dr = _dealt(l, levels, smallest, True), _dealt(r, levels, smallest, False)
    # Counting takes the cells alone, so only the columns of the boxes are read for it.
    cells = _hot(dl, dr, full, hot)
    return _salted(dl, cells, names[0], "l", "r"), _salted(dr, cells, names[1], "r", "l")


def uneven_join(left: DataFrame, right: DataFrame, left_prefix: str, right_prefix: str, radius: Column | float = 0.0, smallest: float = SMALLEST, full: int = FULL, hot: int = HOT) -> DataFrame:
    """Pairs whose boxes lie within `radius` (an expression of the left row); columns of both sides.

    Points are boxes without extent. Rows with a null in the box or the radius, a negative radius, an empty or inverted
    box, or coordinates beyond FAR have no pair; repeated rows have a pair each. Columns starting with an underscore are
    taken. Rows equal in all columns share a salt.
    """
    r = F.lit(float(radius)) if isinstance(radius, (int, float)) else radius.cast("double")
    lb, rb = g.box(left_prefix), g.box(right_prefix)
    wide = F.col("_r") + SLACK
    grown = (lb[0] - wide, lb[1] - wide, lb[2] + wide, lb[3] + wide)
    rows, others = dealt(left.withColumn("_r", r).where("_r >= 0"), right, grown, rb, smallest, full, hot)
    others = others.withColumnRenamed("_b", "_o")
    size = smallest * F.pow(F.lit(2.0), F.col("_v"))
    here = (F.floor(F.greatest("_b.x0", "_o.x0") / size) == F.col("_x")) & (F.floor(F.greatest("_b.y0", "_o.y0") / size) == F.col("_y"))
    pairs = rows.join(others, [*CELL, "_sl", "_sr"]).where(here & (g.distance(lb, rb) <= F.col("_r")))
    return pairs.drop(*CELL, "_sl", "_sr", "_b", "_o", "_r")
