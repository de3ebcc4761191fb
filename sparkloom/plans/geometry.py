"""Queries over geometries: squares of nations and points of customers, whose measures plain arithmetic gives."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame

from sparkloom.functions.geometry import to_wkb
from sparkloom.operators.geo import with_crs
from sparkloom.plans.inputs import _folder
from sparkloom.plans.queries import Tables, query
from sparkloom.table import Table


def shapes(t: Tables, source: Table, key: str, make: dict[str, tuple[str, Any]]) -> Table:
    """The key of each row and geometries made of it: each a name, a type and a Python function of the key to coordinates."""

    def encode(batches: Any) -> Any:
        for b in batches:
            yield b.assign(**{c: [to_wkb({"type": kind, "coordinates": f(int(k))}) for k in b[key]] for c, (kind, f) in make.items()})

    schema = f"{key} {source.df.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} binary" for c in make)
    out = t.session.new_table().set_df(source.df.select(key).mapInPandas(encode, schema))
    for c in make:
        out.set_df(with_crs(out.ordered_df, c, "EPSG:4326"))
    return out


def square(x: float, y: float, w: float, h: float) -> list:
    return [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]


def squares(t: Tables) -> Table:
    """The nation k has the square from (3k, k) to (3k + 5, k + 4)."""
    return shapes(t, t.nation, "n_nationkey", {"g": ("Polygon", lambda k: square(3.0 * k, float(k), 5.0, 4.0))})


def places(t: Tables) -> Table:
    """The customer k is at longitude k % 120 - 60 + 0.25, latitude k % 70 - 35 + 0.125."""
    return t.customer.select_columns("c_custkey").add_column("lon", "double", "c_custkey % 120 - 60 + 0.25").add_column("lat", "double", "c_custkey % 70 - 35 + 0.125").points("lat", "lon", "g")


_PLACES = "(SELECT c_custkey, c_custkey % 120 - 60 + 0.25::DOUBLE AS lon, c_custkey % 70 - 35 + 0.125::DOUBLE AS lat FROM customer)"
_BOX = 'SELECT n_nationkey, {} AS "minLon", {} AS "minLat", {} AS "maxLon", {} AS "maxLat" FROM nation'


@query(f"SELECT c_custkey, lat AS y, lon AS x FROM {_PLACES}")
def geo_points(t: Tables) -> Table:
    return places(t).lat_lon("g", "y", "x").select_columns(["c_custkey", "x", "y"])


@query("SELECT n_nationkey, true AS ok, false AS bad, true AS closed, false AS open, 5::INTEGER AS corners, 'POLYGON' AS kind, 'LINESTRING' AS line_kind FROM nation")
def geo_kinds(t: Tables) -> Table:
    g = shapes(t, t.nation, "n_nationkey", {
        "g": ("Polygon", lambda k: square(k, k, 1, 1)), "bow": ("Polygon", lambda k: [[[k, 0], [k + 1, 1], [k + 1, 0], [k, 1], [k, 0]]]), "l": ("LineString", lambda k: [[k, 0], [k + 1, 1], [k + 2, 0]]), "ring": ("LineString", lambda k: [[k, 0], [k + 1, 1], [k + 2, 0], [k, 0]]),
    })
    g.is_valid_geo("ok", column="g").is_valid_geo("bad", column="bow").is_closed_geo("closed", column="ring").is_closed_geo("open", column="l").nb_vertices("corners", column="g").type_geo("kind", column="g").type_geo("line_kind", column="l")
    return g.remove_columns(["g", "bow", "l", "ring"])


@query("SELECT n_nationkey, true AS ok FROM nation")
def geo_fix(t: Tables) -> Table:
    return shapes(t, t.nation, "n_nationkey", {"g": ("Polygon", lambda k: [[[k, 0], [k + 1, 1], [k + 1, 0], [k, 1], [k, 0]]])}).fix_geo().is_valid_geo("ok").remove_columns("g")


@query(f"SELECT c_custkey, lon AS y, lat AS x FROM {_PLACES}")
def geo_flip(t: Tables) -> Table:
    return places(t).remove_columns(["lat", "lon"]).flip_coordinates().lat_lon("g", "y", "x").remove_columns("g")


@query("SELECT s_suppkey, floor(s_suppkey / 7.0 * 100 + 0.5) / 100 AS x FROM supplier")
def geo_precision(t: Tables) -> Table:
    s = t.supplier.select_columns("s_suppkey").add_column("lon", "double", "s_suppkey / 7").add_column("lat", "double", "0").points("lat", "lon", "g")
    return s.reduce_precision(2).lat_lon("g", "y", "x").select_columns(["s_suppkey", "x"])


@query(f"SELECT c_custkey, round(radians(lon) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {_PLACES}")
def geo_reproject(t: Tables) -> Table:
    p = places(t).remove_columns(["lat", "lon"]).reproject("EPSG:3857").lat_lon("g", "y", "x")
    assert p.get_projection("g") == "EPSG:3857"
    return p.reproject("WGS84").lat_lon("g", "lat", "lon").remove_columns("g").round(["x", "y"], decimals=3).round(["lon", "lat"], decimals=6)


@query("SELECT n_nationkey, 1.0::DOUBLE AS area, 1.0::DOUBLE AS perimeter, round(6378137 * radians(n_nationkey + 1) / 1000, 3) AS equator FROM nation")
def geo_measures(t: Tables) -> Table:
    """Against the area and the perimeter of a degree by a degree at the equator on the ellipsoid, and lengths along the equator."""
    g = shapes(t, t.nation, "n_nationkey", {"g": ("Polygon", lambda k: square(k, 0.0, 1.0, 1.0)), "l": ("LineString", lambda k: [[0.0, 0.0], [k + 1.0, 0.0]])})
    g.area("area", unit="km2", column="g").perimeter("perimeter", unit="km", column="g").length("equator", unit="km", column="l").remove_columns(["g", "l"])
    return g.update_column("area", "round(area / 12308.778361469, 4)").update_column("perimeter", "round(perimeter / 443.770917248, 4)").round("equator", decimals=3)


@query("SELECT s_suppkey, round(sqrt(pow(s_suppkey % 9, 2) + 16), 6) AS plane, round(6378137 * radians(s_suppkey % 9) / 1000, 3) AS along FROM supplier")
def geo_distances(t: Tables) -> Table:
    """In the projection's unit, and along the ellipsoid on the equator."""
    s = t.supplier.select_columns("s_suppkey").add_column("x", "double", "s_suppkey % 9").add_column("zero", "double", "0").add_column("four", "double", "4").points("zero", "x", "a").points("four", "zero", "b").points("zero", "zero", "c")
    return s.distance("a", "b", "plane", decimals=6).distance("a", "c", "along", method="spheroid", unit="km", decimals=3).select_columns(["s_suppkey", "plane", "along"])


@query("SELECT n_nationkey, 3 * n_nationkey + 2.5::DOUBLE AS x, n_nationkey + 2::DOUBLE AS y FROM nation")
def geo_centroid(t: Tables) -> Table:
    return squares(t).centroid("c").lat_lon("c", "y", "x").remove_columns(["g", "c"]).round(["x", "y"], decimals=6)


@query(_BOX.format("3.0::DOUBLE * n_nationkey", "n_nationkey::DOUBLE", "3.0::DOUBLE * n_nationkey + 5", "n_nationkey + 4.0::DOUBLE"))
def geo_bounding_box(t: Tables) -> Table:
    return squares(t).bounding_box().remove_columns("g")


@query("SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 77.0::DOUBLE AS c, 28.0::DOUBLE AS d")
def geo_whole_box(t: Tables) -> DataFrame:
    return t.session.spark.createDataFrame([tuple(squares(t).get_bounding_box())], "a double, b double, c double, d double")


@query(_BOX.format("n_nationkey - 0.5::DOUBLE", "-0.5::DOUBLE", "n_nationkey + 0.5::DOUBLE", "0.5::DOUBLE"))
def geo_buffer(t: Tables) -> Table:
    return shapes(t, t.nation, "n_nationkey", {"p": ("Point", lambda k: [float(k), 0.0])}).buffer("g", 0.5, column="p").bounding_box(column="g", decimals=6).remove_columns(["p", "g"])


@query("SELECT n_nationkey, 3::INTEGER AS corners FROM nation")
def geo_simplify(t: Tables) -> Table:
    """Bends of triangles smaller than the tolerance's square go."""
    line = lambda k: [[float(k), 0.0], [k + 1.0, 0.001], [k + 2.0, 0.0], [k + 2.001, 5.0], [k + 2.0, 10.0]]
    return shapes(t, t.nation, "n_nationkey", {"g": ("LineString", line)}).simplify(0.1).nb_vertices("corners").remove_columns("g")


def _two(t: Tables) -> Table:
    """Two squares that overlap: from (k, 0) to (k + 4, 4) and from (k + 1, 1) to (k + 7, 3)."""
    return shapes(t, t.nation, "n_nationkey", {"a": ("Polygon", lambda k: square(k, 0.0, 4.0, 4.0)), "b": ("Polygon", lambda k: square(k + 1.0, 1.0, 6.0, 2.0))})


@query(_BOX.format("n_nationkey + 1.0::DOUBLE", "1.0::DOUBLE", "n_nationkey + 4.0::DOUBLE", "3.0::DOUBLE"))
def geo_intersection(t: Tables) -> Table:
    return _two(t).intersection("a", "b", "g").remove_columns(["a", "b"]).bounding_box(decimals=6).remove_columns("g")


@query(_BOX.format("n_nationkey::DOUBLE", "0.0::DOUBLE", "n_nationkey + 7.0::DOUBLE", "4.0::DOUBLE"))
def geo_union(t: Tables) -> Table:
    return _two(t).union("a", "b", "g").remove_columns(["a", "b"]).bounding_box(decimals=6).remove_columns("g")


@query("SELECT n_nationkey, false AS meets, true AS within, 9::INTEGER AS corners FROM nation")
def geo_remove_intersection(t: Tables) -> Table:
    """What is left of a square with a slot from the right: eight corners, the first one twice; the middle of the slot is outside."""
    d = _two(t).remove_intersection("a", "b", "g").nb_vertices("corners", column="g").inside("g", "a", "within")
    p = shapes(t, t.nation, "n_nationkey", {"p": ("Point", lambda k: [k + 2.0, 2.0])})
    return d.join(p, common_column="n_nationkey").intersect("g", "p", "meets").select_columns(["n_nationkey", "meets", "within", "corners"])


@query("SELECT n_nationkey, n_nationkey % 7 <= 4 AS meets, n_nationkey % 7 <= 2 AS within FROM nation")
def geo_predicates(t: Tables) -> Table:
    g = shapes(t, t.nation, "n_nationkey", {"a": ("Polygon", lambda k: square(float(k % 7), 1.0, 2.0, 2.0)), "b": ("Polygon", lambda k: square(0.0, 0.0, 4.0, 4.0))})
    return g.intersect("a", "b", "meets").inside("a", "b", "within").remove_columns(["a", "b"])


@query("SELECT n_nationkey, 10::INTEGER AS before, 5::INTEGER AS after FROM nation")
def geo_fill_holes(t: Tables) -> Table:
    g = shapes(t, t.nation, "n_nationkey", {"g": ("Polygon", lambda k: square(k, 0.0, 9.0, 9.0) + square(k + 1.0, 1.0, 2.0, 2.0))})
    return g.nb_vertices("before").fill_holes().nb_vertices("after").remove_columns("g")


@query("SELECT n_nationkey, 'POLYGON' AS kind, 4::INTEGER AS corners FROM nation")
def geo_lines_to_polygons(t: Tables) -> Table:
    return shapes(t, t.nation, "n_nationkey", {"g": ("LineString", lambda k: [[k, 0.0], [k + 1.0, 1.0], [k + 2.0, 0.0], [k, 0.0]])}).lines_to_polygons().type_geo("kind").nb_vertices("corners").remove_columns("g")


@query("SELECT n_nationkey, i::DOUBLE AS x, n_nationkey::DOUBLE AS y FROM nation, range(3) r(i)")
def geo_unnest(t: Tables) -> Table:
    return shapes(t, t.nation, "n_nationkey", {"g": ("MultiPoint", lambda k: [[float(i), float(k)] for i in range(3)])}).unnest_geo().lat_lon("g", "y", "x").remove_columns("g")


@query("SELECT n_nationkey, true AS within FROM nation")
def geo_random_point(t: Tables) -> Table:
    return squares(t).random_point("p", column="g").inside("p", "g", "within").remove_columns(["g", "p"])


@query('SELECT n_regionkey, min(3.0::DOUBLE * n_nationkey) AS "minLon", min(n_nationkey::DOUBLE) AS "minLat", max(3.0::DOUBLE * n_nationkey + 5) AS "maxLon", max(n_nationkey + 4.0::DOUBLE) AS "maxLat" FROM nation GROUP BY n_regionkey')
def geo_aggregate(t: Tables) -> Table:
    return squares(t).join(t.nation.select_columns(["n_nationkey", "n_regionkey"]), common_column="n_nationkey").aggregate_geo("union", categories="n_regionkey").bounding_box().remove_columns("g")


@query("SELECT n_nationkey AS key, n_name AS name, 3.0::DOUBLE * n_nationkey AS x FROM (SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation)")
def geo_files(t: Tables) -> Table:
    """GeoJSON, a shapefile and Parquet: each written from what the one before gave."""
    folder = _folder(t)
    g = squares(t).join(t.nation.select_columns(["n_nationkey", "n_name"]), common_column="n_nationkey").rename_columns({"n_nationkey": "key", "n_name": "name", "g": "geom"})
    for name in ("a.geojson", "b.shp", "c.geoparquet"):
        path = g.write_geo_data(os.path.join(folder, name))
        assert os.path.exists(path)
        g = t.session.new_table().load_geo_data(path)
    return g.bounding_box().rename_columns({"minLon": "x"}).convert({"key": "bigint"}).select_columns(["key", "name", "x"])


@query("SELECT n_nationkey AS key, 5 AS corners, 'Polygon' AS kind FROM (SELECT n_nationkey::BIGINT AS n_nationkey FROM nation)")
def geo_data(t: Tables) -> DataFrame:
    d = json.loads(json.dumps(squares(t).get_geo_data(rewind=True)))
    rows = [(f["properties"]["n_nationkey"], len(f["geometry"]["coordinates"][0]), f["geometry"]["type"]) for f in d["features"]]
    return t.session.spark.createDataFrame(rows, "key long, corners int, kind string")


@query(f"""SELECT c_custkey, n_nationkey FROM {_PLACES} p LEFT JOIN nation ON lon BETWEEN 3 * n_nationkey AND 3 * n_nationkey + 5 AND lat BETWEEN n_nationkey AND n_nationkey + 4""")
def join_geo_left(t: Tables) -> Table:
    return places(t).join_geo(squares(t).rename_columns({"g": "h"}), "inside", left_table_column="g", right_table_column="h").select_columns(["c_custkey", "n_nationkey"])


@query(f"""SELECT c_custkey, n_nationkey FROM {_PLACES} p FULL JOIN nation ON lon BETWEEN 3 * n_nationkey AND 3 * n_nationkey + 5 AND lat BETWEEN n_nationkey AND n_nationkey + 4""")
def join_geo_full(t: Tables) -> Table:
    return places(t).join_geo(squares(t).rename_columns({"g": "h"}), "intersect", left_table_column="g", right_table_column="h", type="full").select_columns(["c_custkey", "n_nationkey"])


@query(f"""SELECT c_custkey, n_nationkey FROM {_PLACES} p RIGHT JOIN nation ON lon BETWEEN 3 * n_nationkey AND 3 * n_nationkey + 5 AND lat BETWEEN n_nationkey AND n_nationkey + 4""")
def join_geo_right(t: Tables) -> Table:
    return places(t).join_geo(squares(t).rename_columns({"g": "h"}), "inside", left_table_column="g", right_table_column="h", type="right").select_columns(["c_custkey", "n_nationkey"])


@query(f"SELECT c_custkey, n_nationkey FROM {_PLACES} p JOIN nation ON sqrt(pow(lon - 3 * n_nationkey, 2) + pow(lat - n_nationkey, 2)) <= 6")
def join_geo_within(t: Tables) -> Table:
    n = shapes(t, t.nation, "n_nationkey", {"h": ("Point", lambda k: [3.0 * k, float(k)])})
    return places(t).join_geo(n, "within", left_table_column="g", right_table_column="h", type="inner", distance=6).select_columns(["c_custkey", "n_nationkey"])


@query(f"SELECT c_custkey, n_nationkey FROM {_PLACES} p JOIN nation ON 2 * 6371000 * asin(sqrt(pow(sin(radians(lat - n_nationkey) / 2), 2) + cos(radians(lat)) * cos(radians(n_nationkey)) * pow(sin(radians(lon - 3 * n_nationkey) / 2), 2))) < 700000")
def join_geo_within_haversine(t: Tables) -> Table:
    n = shapes(t, t.nation, "n_nationkey", {"h": ("Point", lambda k: [3.0 * k, float(k)])})
    return places(t).join_geo(n, "within", left_table_column="g", right_table_column="h", type="inner", distance=700_000, distance_method="haversine").select_columns(["c_custkey", "n_nationkey"])
