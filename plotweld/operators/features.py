"""Feature collections: geometry and properties of rows as GeoJSON text, written part by part on the JVM.

Coordinates are decimals of fixed digits, so the text does not depend on how an engine prints doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import projection

DIGITS = "decimal(18,7)"


def place(x: Column, y: Column) -> Column:
    return F.concat(F.lit("["), x.cast(DIGITS).cast("string"), F.lit(","), y.cast(DIGITS).cast("string"), F.lit("]"))


def polygon(points: list[tuple[Column, Column]]) -> Column:
    """A polygon of one ring, closed here."""
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *(place(x, y) for x, y in [*points, points[0]])), F.lit("]]}"))


def box_polygon(b: tuple[Column, ...]) -> Column:
    return polygon([(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])])


def point(x: Column, y: Column) -> Column:
    return F.concat(F.lit('{"type":"Point","coordinates":'), place(x, y), F.lit("}"))


def line(*points: tuple[Column, Column]) -> Column:
    return F.concat(F.lit('{"type":"LineString","coordinates":['), F.concat_ws(",", *(place(x, y) for x, y in points)), F.lit("]}"))


def feature(name: Column, geometry: Column, /, **properties: Column) -> Column:
    """A feature as text; a null geometry or property is written null. Texts are quoted as JSON."""
    quoted = lambda c: F.coalesce(F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6), F.lit("null"))
    parts = [F.concat(F.lit(f'"{k}":'), F.when(v.isNull(), F.lit("null")).otherwise(quoted(v))) for k, v in properties.items()]
    return F.concat(F.lit('{"type":"Feature","id":'), quoted(name), F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":{'), F.concat_ws(",", *parts), F.lit("}}"))


def newest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order: each task keeps n, no table is sorted."""
    return rows.orderBy(*order).limit(n)


def in_degrees(rows: DataFrame, ring: str = "ring") -> DataFrame:
    """A ring or list of points in metres as longitude and latitude."""
    lon, lat = projection.to_wgs84("v.x", "v.y")
    return rows.withColumn(ring, F.expr(f"transform(`{ring}`, v -> named_struct('x', {lon}, 'y', {lat}))"))


def geometry(points: Column, kind: str) -> Column:
    """GeoJSON of an array of points: a Polygon of one ring, closed here, a LineString or a Point; null for none."""
    text = lambda a: F.array_join(F.transform(a, lambda v: place(v["x"], v["y"])), ",")
    inner = {"Polygon": F.concat(F.lit("[["), text(F.concat(points, F.slice(points, 1, 1))), F.lit("]]")), "LineString": F.concat(F.lit("["), text(points), F.lit("]")), "Point": text(points)}[kind]
    return F.when(F.size(points) > 0, F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), inner, F.lit("}")))


def properties(extra: Column | None = None, /, **own: Column) -> Column:
    """Properties as JSON, keys in order; those of `extra`, a map of texts, replace a row's own of the same name."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    mine = F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(quoted(v), F.lit("null")).alias("v")) for k, v in own.items()))
    if extra is not None:
        more = F.coalesce(extra, F.create_map().cast("map<string,string>"))
        theirs = F.transform(F.map_entries(more), lambda e: F.struct(e["key"].alias("k"), F.coalesce(quoted(e["value"]), F.lit("null")).alias("v")))
        mine = F.concat(F.filter(mine, lambda p: ~F.map_contains_key(more, p["k"])), theirs)
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(mine), lambda p: F.concat(F.lit('"'), p["k"], F.lit('":'), p["v"])), ","), F.lit("}"))


def iso(c: Column, kind: str) -> Column:
    """Dates and times as ISO text: a fraction only where there is one, an offset where the type has a zone."""
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    zone = "xxx" if kind == "timestamp" else ""
    part = F.when(F.date_format(c, "SSSSSS") != "000000", F.date_format(c, "'.'SSSSSS")).otherwise("")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), part, F.date_format(c, zone) if zone else F.lit(""))


def row_features(rows: DataFrame, id_col: str, geometry: Column | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Any row as a feature: its columns are the properties, fields of structs and keys of maps of texts beside them.

    Where names meet, a struct's field replaces the columns before it, and a map's key all others. Dates and times are
    ISO texts. A null id is the empty text.
    """
    own: dict[str, Column] = {}
    maps: list[Column] = []

    def add(c: Column, name: str, kind) -> None:
        if kind.typeName() == "struct":
            for f in kind.fields:
                add(c[f.name], f.name, f.dataType)
        elif kind.typeName() == "map":
            maps.append(F.coalesce(c, F.create_map().cast(kind)))
        else:
            own[name] = iso(c, kind.typeName()) if kind.typeName() in ("date", "timestamp", "timestamp_ntz") else c

    for f in rows.schema.fields:
        if f.name not in (id_col, *skip):
            add(F.col(f"`{f.name}`"), f.name, f.dataType)
    extra = None
    for m in maps:
        extra = m if extra is None else F.map_from_entries(F.concat(F.filter(F.map_entries(extra), lambda e, m=m: ~F.map_contains_key(m, e["key"])), F.map_entries(m)))
    name = F.coalesce(F.expr(f"regexp_extract(to_json(array(`{id_col}`)), '(?s)^.(.*).$', 1)"), F.lit('""'))
    name = F.when(F.col(f"`{id_col}`").isNull(), '""').otherwise(name)
    text = F.concat(F.lit('{"type":"Feature","id":'), name, F.lit(',"geometry":'), F.coalesce(geometry if geometry is not None else F.lit(None).cast("string"), F.lit("null")), F.lit(',"properties":'), properties(extra, **own), F.lit("}"))
    return rows.select(F.col(f"`{id_col}`").alias("id"), text.alias("feature"))
