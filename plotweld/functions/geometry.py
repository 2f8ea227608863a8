"""Column expressions on axis-parallel boxes (xmin, ymin, xmax, ymax) and on uncertainties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("xmin", "ymin", "xmax", "ymax"))


def area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def perimeter(b) -> Column:
    return 2 * ((b[2] - b[0]) + (b[3] - b[1]))


def centroid(b) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def ratio_of_sizes(a: Column, b: Column) -> Column:
    return safe_ratio(F.least(a, b), F.greatest(a, b))


def intersection(a, b) -> tuple[Column, Column, Column, Column]:
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def intersection_area(a, b) -> Column:
    i = intersection(a, b)
    return F.greatest(F.lit(0.0), i[2] - i[0]) * F.greatest(F.lit(0.0), i[3] - i[1])


def distance(a, b) -> Column:
    """Between two boxes; 0 where they touch."""
    dx = F.greatest(F.lit(0.0), a[0] - b[2], b[0] - a[2])
    dy = F.greatest(F.lit(0.0), a[1] - b[3], b[1] - a[3])
    return F.sqrt(dx * dx + dy * dy)


def centroid_distance(a, b) -> Column:
    (ax, ay), (bx, by) = centroid(a), centroid(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def iou(a, b) -> Column:
    inter = intersection_area(a, b)
    return safe_ratio(inter, area(a) + area(b) - inter)


def compactness(b) -> Column:
    return safe_ratio(4 * F.pi() * area(b), perimeter(b) * perimeter(b))


def shape_similarity(a, b) -> Column:
    return ratio_of_sizes(compactness(a), compactness(b))


def boundary_hausdorff(a, b) -> Column:
    """Largest distance of a corner of either box to the boundary of the other."""

    def far(p, q):
        out = []
        for x in (p[0], p[2]):
            for y in (p[1], p[3]):
                dx, dy = F.greatest(q[0] - x, F.lit(0.0), x - q[2]), F.greatest(q[1] - y, F.lit(0.0), y - q[3])
                inside = F.least(x - q[0], q[2] - x, y - q[1], q[3] - y)
                out.append(F.when(inside >= 0, inside).otherwise(F.sqrt(dx * dx + dy * dy)))
        return F.greatest(*out)

    return F.greatest(far(a, b), far(b, a))


def relative_uncertainty(*sigmas: Column) -> Column:
    total = sigmas[0] * sigmas[0]
    for s in sigmas[1:]:
        total = total + s * s
    return F.sqrt(total)


def search_radius(sigma: Column, registration: Column | float, k: float, least: float) -> Column:
    return F.greatest(F.lit(float(least)), k * relative_uncertainty(sigma, F.lit(registration) if isinstance(registration, float) else registration))


def attribute_similarity(a: str, b: str) -> Column:
    """Mean over survey number, owner, land use and revenue area; null on one side counts 0."""
    parts = []
    for key in ("survey_no", "owner_name", "land_use"):
        x, y = F.col(a + key), F.col(b + key)
        parts.append(F.when(x.isNull() | y.isNull(), 0.0).when(F.lower(F.trim(x)) == F.lower(F.trim(y)), 1.0).otherwise(0.0))
    x, y = F.col(a + "revenue_area"), F.col(b + "revenue_area")
    parts.append(F.when(x.isNull() | y.isNull(), 0.0).when(F.greatest(F.abs(x), F.abs(y)) == 0, 1.0).otherwise(1 - F.abs(x - y) / F.greatest(F.abs(x), F.abs(y))))
    return (parts[0] + parts[1] + parts[2] + parts[3]) / 4


def identity(a: Column, b: Column) -> Column:
    x, y = F.upper(F.trim(F.coalesce(a, F.lit("")))), F.upper(F.trim(F.coalesce(b, F.lit(""))))
    strip = lambda c: F.replace(c, F.lit("_X"), F.lit(""))
    return (
        F.when((x == "") | (y == ""), 0.5).when(x == y, 1.0).when(x.contains("AMBIG") | y.contains("AMBIG"), 0.2)
        .when(strip(x) == strip(y), 0.7).otherwise(0.3)
    )
