"""Column expressions on rings: array<struct<x double, y double>>, not closed, either orientation.

Everything is built-in higher-order functions, so rings of any number of vertices stay on the JVM side. Areas are summed
around the first vertex: products of map coordinates would lose the last digits. Clipping windows, insets and the rotated
rectangle suppose convex rings; the other measures hold for any simple ring, `region_area` and what is built on it for any
ring at all. Null rings give null.

Lambdas are interpreted and share nothing: what one uses more than once, or on every turn, is computed ahead by `let`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns that are computed once: exploded from an array of one, so that no filter above repeats them."""
    return rows.withColumn("_held", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))).select(*rows.columns, *(F.col(f"_held.{n}").alias(n) for n in columns))


def where(rows: DataFrame, test: Column) -> DataFrame:
    """Rows that pass a costly test, which a join below would otherwise put before its own conditions on boxes."""
    return held(rows, _passes=test).where("_passes").drop("_passes")


def ring(*vertices: tuple[Column | str, Column | str]) -> Column:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.array(*(F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y")) for x, y in vertices))


def _next(r: Column, i: Column) -> Column:
    return F.get(r, (i + 1) % F.size(r))


def moved(r: Column, x: Column, y: Column) -> Column:
    """The ring in coordinates from (x, y)."""
    return F.transform(r, lambda v: F.struct((v["x"] - x).alias("x"), (v["y"] - y).alias("y")))


def local(r: Column) -> Column:
    return let(r, lambda a: let(F.get(a, F.lit(0)), lambda o: moved(a, o["x"], o["y"])))


def edges(r: Column) -> Column:
    return let(r, lambda a: F.transform(a, lambda v, i: F.struct(v.alias("p"), _next(a, i).alias("q"))))


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, e: acc + f(e))


def _cross(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]


def signed_area(r: Column) -> Column:
    return _sum(edges(local(r)), _cross) / 2


def area(r: Column) -> Column:
    return F.abs(signed_area(r))


def _length(e: Column) -> Column:
    dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
    return F.sqrt(dx * dx + dy * dy)


def perimeter(r: Column) -> Column:
    return _sum(edges(r), _length)


def centroid(r: Column) -> tuple[Column, Column]:
    e, a = edges(local(r)), F.nullif(6 * signed_area(r), F.lit(0.0))
    first = F.get(r, F.lit(0))
    return tuple(first[c] + F.coalesce(_sum(e, lambda s, c=c: (s["p"][c] + s["q"][c]) * _cross(s)) / a, F.lit(0.0)) for c in ("x", "y"))


def bounds(r: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(r, lambda v: v["x"]), F.transform(r, lambda v: v["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def _side(e: Column, v: Column) -> Column:
    return (e["q"]["x"] - e["p"]["x"]) * (v["y"] - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (v["x"] - e["p"]["x"])


def _cut(poly: Column, e: Column) -> Column:
    """The part of a ring to the left of an edge."""

    def kept(v: Column, i: Column) -> Column:
        def between(m: Column) -> Column:
            n, s, t = m["n"], m["s"], m["t"]
            on = let(s / (s - t), lambda share: F.struct((v["x"] + (n["x"] - v["x"]) * share).alias("x"), (v["y"] + (n["y"] - v["y"]) * share).alias("y")))
            return F.when((s > 0) & (t < 0), F.array(v, on)).when(s >= 0, F.array(v)).when((s < 0) & (t > 0), F.array(on)).otherwise(F.slice(F.array(v), 1, 0))

        return let(let(_next(poly, i), lambda n: F.struct(n.alias("n"), _side(e, v).alias("s"), _side(e, n).alias("t"))), between)

    return F.flatten(F.transform(poly, kept))


def _ccw(r: Column) -> Column:
    return let(r, lambda a: F.when(signed_area(a) < 0, F.reverse(a)).otherwise(a))


def clip(subject: Column, window: Column) -> Column:
    """The part of `subject` inside a convex window, cut by one half-plane after the other; empty where there is none."""
    return F.aggregate(edges(_ccw(window)), subject, _cut)


def common_area(a: Column, b: Column) -> Column:
    """Of two convex rings."""
    x, y = F.get(a, F.lit(0))["x"], F.get(a, F.lit(0))["y"]
    return let(clip(moved(a, x, y), moved(b, x, y)), lambda c: F.when(F.size(c) > 2, F.abs(_sum(edges(c), _cross)) / 2).otherwise(0.0))


def _to_edges(v: Column, es: Column) -> Column:
    def far(e: Column) -> Column:
        def of(m: Column) -> Column:
            dx, dy, ux, uy = m["dx"], m["dy"], m["ux"], m["uy"]
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((ux * dx + uy * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
            off = let(t, lambda t: F.struct((ux - t * dx).alias("x"), (uy - t * dy).alias("y")))
            return let(off, lambda o: F.sqrt(o["x"] * o["x"] + o["y"] * o["y"]))

        px, py = e["p"]["x"], e["p"]["y"]
        return let(F.struct((e["q"]["x"] - px).alias("dx"), (e["q"]["y"] - py).alias("dy"), (v["x"] - px).alias("ux"), (v["y"] - py).alias("uy")), of)

    return F.array_min(F.transform(es, far))


def to_boundary(v: Column, r: Column) -> Column:
    """Distance of a point to the nearest edge."""
    return _to_edges(v, edges(r))


def hausdorff(a: Column, b: Column) -> Column:
    """Largest distance of a vertex of either ring to the boundary of the other."""
    one = lambda p, q: let(edges(q), lambda es: F.array_max(F.transform(p, lambda v: _to_edges(v, es))))
    return F.greatest(one(a, b), one(b, a))


def turn(r: Column) -> Column:
    """Direction, in radians, of the first edge along which the smallest enclosing rectangle lies."""

    width = lambda xs: let(xs, lambda a: F.array_max(a) - F.array_min(a))

    def of(a: Column) -> Column:
        def rectangle(e: Column) -> Column:
            way = let(F.nullif(_length(e), F.lit(0.0)), lambda n: F.struct(((e["q"]["x"] - e["p"]["x"]) / n).alias("x"), ((e["q"]["y"] - e["p"]["y"]) / n).alias("y")))
            size = lambda u: width(F.transform(a, lambda v: v["x"] * u["x"] + v["y"] * u["y"])) * width(F.transform(a, lambda v: v["y"] * u["x"] - v["x"] * u["y"]))
            return let(way, lambda u: F.struct(F.round(size(u), 4).alias("size"), F.atan2(u["y"], u["x"]).alias("angle")))

        return F.filter(F.transform(edges(a), rectangle), lambda s: s["size"].isNotNull())

    first = lambda sized: let(F.array_min(F.transform(sized, lambda s: s["size"])), lambda least: F.element_at(F.filter(sized, lambda s: s["size"] == least), 1)["angle"])
    return let(let(local(r), of), first)


def orientation_similarity(a: Column, b: Column) -> Column:
    return turns_alike(turn(a), turn(b))


def turns_alike(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return 1 - F.least(d, F.pi() - d) / (F.pi() / 2)


def validity(r: Column) -> Column:
    """Why a ring is no polygon, null where it is one: edges that cross are found by testing each pair of them."""
    away = lambda i, j, n: (j > i + 1) & ~((i == 0) & (j == n - 1))
    crosses = lambda a, b: (_side(a, b["p"]) * _side(a, b["q"]) < 0) & (_side(b, a["p"]) * _side(b, a["q"]) < 0)
    cross = let(edges(r), lambda e: F.exists(F.flatten(F.transform(e, lambda a, i: F.transform(F.filter(e, lambda b, j: away(i, j, F.size(e))), lambda b: crosses(a, b)))), lambda x: x))
    return F.when(r.isNull() | (F.size(r) < 3), "too few vertices").when(cross, "edges cross").when(area(r) == 0, "no area")


def region_area(rs: Column, inside) -> Column:
    """Area of the places for which `inside` holds, a function of an array of flags: in which of the rings a place lies.

    An edge sweep: between two neighbouring vertices or crossings no edges cross, so the length of a vertical cut is linear
    there and its middle stands for the strip. Rings may have any shape, also edges that cross (a place counts where a ray
    meets the ring an odd number of times). Work grows with the cube of the number of edges: meant for a handful of parcels.
    """
    return let(rs, lambda a: _region_area(a, inside))


def _sides(a: Column, b: Column) -> Column:
    """On which sides of edge a the ends of b lie (s, t), and of b those of a (u, v)."""
    return F.struct(_side(a, b["p"]).alias("s"), _side(a, b["q"]).alias("t"), _side(b, a["p"]).alias("u"), _side(b, a["q"]).alias("v"))


def _region_area(rs: Column, inside) -> Column:
    first = F.get(F.get(rs, F.lit(0)), F.lit(0))
    moved_edges = lambda o: F.flatten(F.transform(rs, lambda r, i: F.transform(edges(moved(r, o["x"], o["y"])), lambda s: F.struct(i.alias("i"), s["p"].alias("p"), s["q"].alias("q"), *(f(s["p"][c], s["q"][c]).alias(n) for c in ("x", "y") for f, n in ((F.least, f"{c}0"), (F.greatest, f"{c}1")))))))

    def meet(a: Column, b: Column) -> Column:
        def at(m: Column) -> Column:
            s, t, u, v = m["s"], m["t"], m["u"], m["v"]
            return F.when((((s > 0) & (t < 0)) | ((s < 0) & (t > 0))) & (((u > 0) & (v < 0)) | ((u < 0) & (v > 0))), b["p"]["x"] + (b["q"]["x"] - b["p"]["x"]) * s / (s - t))

        near = (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])
        return F.when(near, let(_sides(a, b), at))

    def strip(es: Column, x0: Column, x1: Column) -> Column:
        def at(x: Column) -> Column:
            over = F.filter(es, lambda e: (e["x0"] < x) & (e["x1"] > x))
            cuts = F.transform(over, lambda e: F.struct((e["p"]["y"] + (e["q"]["y"] - e["p"]["y"]) * (x - e["p"]["x"]) / (e["q"]["x"] - e["p"]["x"])).alias("y"), e["i"].alias("i")))
            return let(F.sort_array(cuts), length)

        def length(c: Column) -> Column:
            def piece(j: Column) -> Column:
                def between(m: Column) -> Column:
                    below = lambda i: F.size(F.filter(c, lambda k: (k["i"] == i) & (k["y"] < (m["lo"] + m["hi"]) / 2))) % 2 == 1
                    flags = F.transform(F.sequence(F.lit(0), F.size(rs) - 1), below)
                    return F.when((m["hi"] > m["lo"]) & let(flags, inside), m["hi"] - m["lo"]).otherwise(0.0)

                return let(F.struct(F.get(c, j)["y"].alias("lo"), F.get(c, j + 1)["y"].alias("hi")), between)

            return F.when(F.size(c) > 1, _sum(F.sequence(F.lit(0), F.size(c) - 2), piece)).otherwise(0.0)

        return (x1 - x0) * let((x0 + x1) / 2, at)

    def swept(es: Column) -> Column:
        crossings = F.flatten(F.transform(es, lambda a, j: F.filter(F.transform(F.slice(es, j + 2, F.size(es)), lambda b: meet(a, b)), lambda x: x.isNotNull())))
        stops = F.array_sort(F.array_distinct(F.concat(F.transform(es, lambda e: e["p"]["x"]), crossings)))
        return let(stops, lambda xs: F.when(F.size(xs) > 1, _sum(F.sequence(F.lit(0), F.size(xs) - 2), lambda k: strip(es, F.get(xs, k), F.get(xs, k + 1)))).otherwise(0.0))

    return let(let(first, moved_edges), swept)


def overlap_area(a: Column, b: Column) -> Column:
    """Of two rings of any shape."""
    return region_area(F.array(a, b), lambda f: f[0] & f[1])


def covered_area(a: Column, others: Column) -> Column:
    """Of the part of a ring that lies in one of the others or more: what two of them share counts once."""
    return region_area(F.concat(F.array(a), others), lambda f: f[0] & F.exists(F.slice(f, 2, F.size(f)), lambda x: x))


def union_area(rs: Column) -> Column:
    return region_area(rs, lambda f: F.exists(f, lambda x: x))


def contains(r: Column, v: Column) -> Column:
    """Whether a point lies inside a ring of any shape; points on an edge may count either way."""
    crossed = F.filter(edges(r), lambda e: ((e["p"]["y"] > v["y"]) != (e["q"]["y"] > v["y"])) & (v["x"] < (e["q"]["x"] - e["p"]["x"]) * (v["y"] - e["p"]["y"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0)) + e["p"]["x"]))
    return F.size(crossed) % 2 == 1


def distance_to(v: Column, r: Column) -> Column:
    """Of a point to a ring with its inside."""
    return F.when(contains(r, v), 0.0).otherwise(to_boundary(v, r))


def meets(a: Column, b: Column) -> Column:
    """Whether two rings with their insides share a point, a touching corner or edge included."""

    def touch(e: Column, f: Column) -> Column:
        near = lambda c: (F.greatest(F.least(e["p"][c], e["q"][c]), F.least(f["p"][c], f["q"][c])) <= F.least(F.greatest(e["p"][c], e["q"][c]), F.greatest(f["p"][c], f["q"][c])))
        apart = lambda x, y: ((x > 0) & (y > 0)) | ((x < 0) & (y < 0))
        return near("x") & near("y") & let(_sides(e, f), lambda m: ~apart(m["s"], m["t"]) & ~apart(m["u"], m["v"]))

    return let(edges(b), lambda fs: F.exists(edges(a), lambda e: F.exists(fs, lambda f: touch(e, f)))) | contains(a, F.get(b, F.lit(0))) | contains(b, F.get(a, F.lit(0)))


def inset(r: Column, d: Column | float) -> Column:
    """A convex ring drawn in by `d` on every side (out for negative d, corners kept sharp); empty where nothing is left."""
    d = F.lit(float(d)) if isinstance(d, (int, float)) else d

    def shifted(ccw: Column) -> Column:
        def moved_edge(v: Column, i: Column) -> Column:
            def by(m: Column) -> Column:
                w, dx, dy = m["w"], m["dx"], m["dy"]
                out = F.when((dx != 0) | (dy != 0), d / F.sqrt(dx * dx + dy * dy)).otherwise(0.0)
                to = lambda p, b: F.struct((p["x"] - dy * b).alias("x"), (p["y"] + dx * b).alias("y"))
                return let(out, lambda b: F.struct(to(v, b).alias("p"), to(w, b).alias("q")))

            return let(let(_next(ccw, i), lambda w: F.struct(w.alias("w"), (w["x"] - v["x"]).alias("dx"), (w["y"] - v["y"]).alias("dy"))), by)

        return F.transform(ccw, moved_edge)

    x0, y0, x1, y1 = bounds(r)
    pad = F.abs(d) * 1000 + (x1 - x0) + (y1 - y0) + 1
    frame = ring((x0 - pad, y0 - pad), (x1 + pad, y0 - pad), (x1 + pad, y1 + pad), (x0 - pad, y1 + pad))
    start = lambda ccw: F.when(d > 0, ccw).otherwise(frame).cast("array<struct<x: double, y: double>>")
    return let(let(_ccw(r), lambda ccw: F.aggregate(shifted(ccw), start(ccw), _cut)), lambda c: F.when(F.size(c) > 2, c).otherwise(F.slice(c, 1, 0)))


def without_repeats(r: Column) -> Column:
    """Without vertices equal to the one before, the last one's follower being the first."""
    return F.filter(r, lambda v, i: (F.size(r) == 1) | (v != F.get(r, (i + F.size(r) - 1) % F.size(r))))


def crossing(r: Column) -> Column:
    """The first two edges that cross, as i, j and the place x, y; null where none do."""

    def of(e: Column) -> Column:
        def test(a: Column, i: Column) -> Column:
            def pair(b: Column, j: Column) -> Column:
                s, t, u, v = _side(a, b["p"]), _side(a, b["q"]), _side(b, a["p"]), _side(b, a["q"])
                at = s / F.nullif(s - t, F.lit(0.0))
                place = F.struct(i.alias("i"), j.alias("j"), (b["p"]["x"] + (b["q"]["x"] - b["p"]["x"]) * at).alias("x"), (b["p"]["y"] + (b["q"]["y"] - b["p"]["y"]) * at).alias("y"))
                return F.when((j > i + 1) & ~((i == 0) & (j == F.size(e) - 1)) & (s * t < 0) & (u * v < 0), place)

            return F.filter(F.transform(e, pair), lambda p: p.isNotNull())

        return F.array_min(F.flatten(F.transform(e, test)))

    return let(edges(r), of)


def loops(r: Column) -> Column:
    """The loops into which a ring falls when it is cut at each place where its edges cross."""

    def split(a: Column) -> Column:
        def at(c: Column) -> Column:
            x = F.array(F.struct(c["x"].alias("x"), c["y"].alias("y")))
            inner = F.concat(x, F.slice(a, c["i"] + 2, c["j"] - c["i"]))
            outer = F.concat(F.slice(a, F.lit(1), c["i"] + 1), x, F.slice(a, c["j"] + 2, F.size(a)))
            return F.when(c.isNull(), F.array(a)).otherwise(F.array(inner, outer))

        return let(crossing(a), at)

    def next_(acc: Column, _) -> Column:
        """Only loops that have not been found sound are tested again."""
        parts = lambda l: F.when(l["sound"], F.array(l)).otherwise(let(split(l["ring"]), lambda ls: F.transform(ls, lambda a: F.struct(a.alias("ring"), (F.size(ls) == 1).alias("sound")))))
        return F.flatten(F.transform(acc, parts))

    start = F.array(F.struct(r.alias("ring"), F.lit(False).alias("sound")))
    return F.transform(F.aggregate(F.sequence(F.lit(1), F.size(r)), start, next_), lambda l: l["ring"])


def fixed(r: Column) -> Column:
    """A struct of the ring made valid and what was done: edges that cross cut into loops, of which the largest stays; repeated vertices dropped."""
    clean = without_repeats(r)

    def made(c: Column) -> Column:
        def largest(parts: Column) -> Column:
            sized = F.transform(parts, lambda p, k: F.struct(F.round(area(p), 9).alias("size"), (-k).alias("k"), p.alias("ring")))
            best = lambda ss: F.array_max(F.transform(ss, lambda s: F.struct(s["size"].alias("size"), s["k"].alias("k"))))
            return let(sized, lambda ss: let(best(ss), lambda b: F.get(F.filter(ss, lambda s: (s["size"] == b["size"]) & (s["k"] == b["k"])), F.lit(0))["ring"]))

        def result(crossed: Column) -> Column:
            ring_ = F.when(crossed, let(loops(c), largest)).otherwise(c)
            done = F.array_compact(F.array(F.when(crossed, "make_valid"), F.when(crossed, "multipart_to_largest"), F.when(F.size(c) < F.size(r), "dedupe_vertices")))
            return F.struct(ring_.alias("ring"), done.alias("fixes"))

        return let(crossing(c).isNotNull(), result)

    return F.when(F.size(r) > 0, let(clean, made))


def from_wkt(text: Column) -> Column:
    """The ring of a POLYGON text of one ring, without its closing vertex; null for other texts."""
    inner = F.regexp_extract(F.upper(text), r"^\s*POLYGON\s*\(\s*\(([^()]*)\)\s*\)\s*$", 1)
    at = lambda v, i: F.element_at(F.split(F.trim(v), r"\s+"), i).try_cast("double")
    points = F.transform(F.split(inner, ","), lambda v: F.struct(at(v, 1).alias("x"), F.when(F.size(F.split(F.trim(v), r"\s+")) == 2, at(v, 2)).alias("y")))
    closed = let(points, lambda p: F.when(F.element_at(p, 1) == F.element_at(p, -1), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p))
    whole = let(closed, lambda p: F.when((F.size(p) >= 3) & ~F.exists(p, lambda v: v["x"].isNull() | v["y"].isNull()), p))
    return F.when(inner != "", whole)
