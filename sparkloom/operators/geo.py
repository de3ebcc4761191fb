"""Geospatial operators on columns of WKB. Each runs as an Arrow-batched UDF; joins go through a grid so that they are equi-joins."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import geometry as G
from sparkloom.functions.exprs import col, listed, rounded
from sparkloom.operators.order import ORD, ordered, settled, visible
from sparkloom.storage import forget, stored


def udf(f: Callable, kind: str, *columns: Column) -> Column:
    """A function of values, null where any value is null."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*cols, strict=True)], dtype=object)

    @F.pandas_udf(kind)
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in batches:
            yield pd.Series([None if v is None else f(v) for v in c], dtype=object)

    return one(*columns) if len(columns) == 1 else run(*columns)


def of(f: Callable) -> Callable:
    """A function of geometries as one of WKB values."""
    return lambda *wkb: f(*[G.from_wkb(w) for w in wkb])


def into(f: Callable) -> Callable:
    return lambda *wkb: G.to_wkb(f(*[G.from_wkb(w) for w in wkb]))


def geo_columns(df: DataFrame) -> list[str]:
    return [c for c in visible(df) if isinstance(df.schema[c].dataType, T.BinaryType)]


def geo_column(df: DataFrame, column: str | None = None) -> str:
    """The given column, or the table's only geometry."""
    if column:
        return column
    names = geo_columns(df)
    if len(names) != 1:
        raise ValueError(f"name the geometry column; there are {names}")
    return names[0]


def crs_of(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("crs")


def with_crs(df: DataFrame, column: str, crs: str | None) -> DataFrame:
    return df.withColumn(column, col(column).alias(column, metadata={"crs": crs} if crs else {}))


def set_geo(df: DataFrame, column: str, value: Column, like: str | None = None, crs: str | None = None) -> DataFrame:
    name = crs or (crs_of(df, like) if like else None)
    return df.withColumn(column, value.alias(column, metadata={"crs": name} if name else {}))


#: WKB of a point in little-endian order.
_POINT = np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])


def _coordinates(wkb: pd.Series) -> tuple[np.ndarray, np.ndarray] | None:
    """x and y of points, NaN for nulls; None if there is something else among them."""
    none = wkb.isna().to_numpy()
    values = wkb.to_numpy()
    if any(len(v) != 21 for v in values[~none]):
        return None
    raw = np.frombuffer(b"".join(values[~none]), _POINT)
    if ((raw["order"] != 1) | (raw["kind"] != 1)).any():
        return None
    x, y = np.full(len(wkb), np.nan), np.full(len(wkb), np.nan)
    x[~none], y[~none] = raw["x"], raw["y"]
    return x, y


def _as_points(x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> pd.Series:
    out = np.zeros(len(x), _POINT)
    out["order"], out["kind"], out["x"], out["y"] = 1, 1, x, y
    raw, step = out.tobytes(), _POINT.itemsize
    return pd.Series([raw[i * step : i * step + step] if ok else None for i, ok in enumerate(valid.tolist())], dtype=object)


def points(df: DataFrame, lat: str, lon: str, new: str) -> DataFrame:
    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for y, x, ok in batches:
            yield _as_points(x.to_numpy(float), y.to_numpy(float), ok.to_numpy(bool))

    y, x = col(lat).cast("double"), col(lon).cast("double")
    return set_geo(df, new, run(F.coalesce(y, F.lit(0.0)), F.coalesce(x, F.lit(0.0)), y.isNotNull() & x.isNotNull()), crs="EPSG:4326")


def lat_lon(df: DataFrame, column: str, lat: str, lon: str) -> DataFrame:
    @F.pandas_udf("struct<x:double,y:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for c in batches:
            at = _coordinates(c)
            if at is None:
                xy = [(p["coordinates"][:2] if (p := G.from_wkb(w)) and p["type"] == "Point" and p["coordinates"] else (None, None)) if w is not None else (None, None) for w in c]
                yield pd.DataFrame(xy, columns=["x", "y"]).astype(float)
            else:
                yield pd.DataFrame({"x": at[0], "y": at[1]})

    out = df.withColumn("__xy", run(col(column)))
    value = lambda n: F.when(~F.isnan(F.col("__xy")[n]), F.col("__xy")[n])
    return out.withColumns({lat: value("y"), lon: value("x")}).drop("__xy")


def is_valid(df: DataFrame, new: str, column: str | None = None) -> DataFrame:
    return df.withColumn(new, udf(of(lambda g: not G.problems(g)), "boolean", col(geo_column(df, column))))


def is_closed(df: DataFrame, new: str, column: str | None = None) -> DataFrame:
    closed = lambda g: all(p["type"] != "LineString" or (len(p["coordinates"]) > 2 and p["coordinates"][0] == p["coordinates"][-1]) for p in G.parts(g))
    return df.withColumn(new, udf(of(closed), "boolean", col(geo_column(df, column))))


def nb_vertices(df: DataFrame, new: str, column: str | None = None) -> DataFrame:
    return df.withColumn(new, udf(of(lambda g: len(G.vertices(g))), "int", col(geo_column(df, column))))


def type_of(df: DataFrame, new: str, column: str | None = None) -> DataFrame:
    return df.withColumn(new, udf(of(lambda g: g["type"].upper()), "string", col(geo_column(df, column))))


def changed(df: DataFrame, f: Callable, column: str | None = None) -> DataFrame:
    c = geo_column(df, column)
    return set_geo(df, c, udf(into(f), "binary", col(c)), like=c)


def fix(df: DataFrame, column: str | None = None) -> DataFrame:
    return changed(df, G.made_valid, column)


def flip(df: DataFrame, column: str | None = None) -> DataFrame:
    c = geo_column(df, column)
    f = into(lambda g: G.mapped(g, lambda p: [p[1], p[0]]))

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            at = _coordinates(b)
            yield pd.Series([None if v is None else f(v) for v in b], dtype=object) if at is None else _as_points(at[1], at[0], b.notna().to_numpy())

    return set_geo(df, c, run(col(c)), like=c)


def reduce_precision(df: DataFrame, decimals: int, column: str | None = None) -> DataFrame:
    def cut(g: G.Geometry) -> G.Geometry | None:
        g = G.mapped(g, lambda c: [round(c[0], decimals), round(c[1], decimals)])

        def once(line: list) -> list:
            return [p for i, p in enumerate(line) if i == 0 or p != line[i - 1]]

        if g["type"] == "LineString":
            return g | {"coordinates": once(g["coordinates"])}
        if polys := G.polygons(g):
            return G.collected([rings for p in polys if (rings := [r for x in p if len(r := once(x)) >= 4])])
        return g

    return changed(df, cut, column)


def reproject(df: DataFrame, to: str, column: str | None = None, have: str | None = None) -> DataFrame:
    c = geo_column(df, column)
    source, target = G.crs(have or crs_of(df, c) or "EPSG:4326"), G.crs(to)
    return set_geo(df, c, udf(into(lambda g: G.reprojected(g, source, target)), "binary", col(c)), crs=target)


def _unit(unit: str, square: bool = False) -> float:
    if unit not in ("m", "km", "m2", "km2"):
        raise ValueError(f"unknown unit {unit!r}")
    return 1.0 if not unit.startswith("km") else 1e6 if square else 1e3


def area(df: DataFrame, new: str, unit: str = "m2", column: str | None = None) -> DataFrame:
    k = _unit(unit, True)
    return df.withColumn(new, udf(of(lambda g: G.geodesic_area(g) / k), "double", col(geo_column(df, column))))


def length(df: DataFrame, new: str, unit: str = "m", column: str | None = None) -> DataFrame:
    k = _unit(unit)
    return df.withColumn(new, udf(of(lambda g: G.geodesic_length(g) / k), "double", col(geo_column(df, column))))


def perimeter(df: DataFrame, new: str, unit: str = "m", column: str | None = None) -> DataFrame:
    k = _unit(unit)
    return df.withColumn(new, udf(of(lambda g: G.geodesic_length(g, rings=True) / k), "double", col(geo_column(df, column))))


def _measure(method: str) -> Callable:
    if method == "srs":
        return G.distance
    if method not in ("haversine", "spheroid"):
        raise ValueError(f"unknown method {method!r}")
    f = G.haversine if method == "haversine" else G.geodesic

    def points_only(a: G.Geometry, b: G.Geometry) -> float:
        if a["type"] != "Point" or b["type"] != "Point":
            raise ValueError(f"{method} distances are between points")
        return f(a["coordinates"], b["coordinates"])

    return points_only


def distance(df: DataFrame, a: str, b: str, new: str, method: str = "srs", unit: str | None = None, decimals: int | None = None) -> DataFrame:
    if method == "srs" and unit:
        raise ValueError("srs distances are in the projection's unit")
    k = _unit(unit or "m")
    f = _measure(method)
    if method == "haversine":

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for p, q in batches:
                s, t = _coordinates(p), _coordinates(q)
                if s is None or t is None:
                    raise ValueError("haversine distances are between points")
                (x1, y1), (x2, y2) = np.radians(s), np.radians(t)
                h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
                yield pd.Series(2 * G.RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1))) / k)

        d = run(col(a), col(b))
        return df.withColumn(new, rounded(F.when(~F.isnan(d), d), decimals))
    return df.withColumn(new, rounded(udf(of(lambda x, y: f(x, y) / k), "double", col(a), col(b)), decimals))


def centroid(df: DataFrame, new: str, column: str | None = None) -> DataFrame:
    c = geo_column(df, column)
    return set_geo(df, new, udf(into(G.centroid), "binary", col(c)), like=c)


def buffer(df: DataFrame, new: str, d: float, column: str | None = None) -> DataFrame:
    c = geo_column(df, column)
    return set_geo(df, new, udf(into(lambda g: G.buffered(g, d)), "binary", col(c)), like=c)


def simplify(df: DataFrame, tolerance: float, column: str | None = None) -> DataFrame:
    return changed(df, lambda g: G.simplified(g, tolerance), column)


def overlay(df: DataFrame, a: str, b: str, new: str, how: str) -> DataFrame:
    """``intersection``, ``difference`` or ``union`` of two columns, row by row."""
    if crs_of(df, a) != crs_of(df, b):
        raise ValueError(f"{a} and {b} have different projections")
    return set_geo(df, new, udf(into(lambda x, y: G.overlay(x, y, how)), "binary", col(a), col(b)), like=a)


def intersect(df: DataFrame, a: str, b: str, new: str) -> DataFrame:
    return df.withColumn(new, udf(of(G.intersects), "boolean", col(a), col(b)))


def inside(df: DataFrame, a: str, b: str, new: str) -> DataFrame:
    """Whether all of the first lies in the second."""
    return df.withColumn(new, udf(of(lambda x, y: G.covers(y, x)), "boolean", col(a), col(b)))


def fill_holes(df: DataFrame, column: str | None = None) -> DataFrame:
    return changed(df, lambda g: G.collected([p[:1] for p in G.polygons(g)]) or g, column)


def lines_to_polygons(df: DataFrame, column: str | None = None) -> DataFrame:
    def turn(g: G.Geometry) -> G.Geometry:
        if g["type"] != "LineString" or len(g["coordinates"]) < 4 or g["coordinates"][0] != g["coordinates"][-1]:
            raise ValueError("only closed lines become polygons")
        return {"type": "Polygon", "coordinates": [g["coordinates"]]}

    return changed(df, turn, column)


def unnest_geo(df: DataFrame, column: str | None = None) -> DataFrame:
    c = geo_column(df, column)
    crs = crs_of(df, c)
    out = df.withColumn(c, F.explode(udf(of(lambda g: [G.to_wkb(p) for p in G.parts(g)]), "array<binary>", col(c))))
    return with_crs(out, c, crs)


def _box(c: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            at = _coordinates(b)
            if at is None:
                yield pd.Series([None if w is None or not (box := G.bounds(G.from_wkb(w))) else list(box) for w in b], dtype=object)
            else:
                four = np.stack([at[0], at[1], at[0], at[1]], axis=1)
                yield pd.Series([row if ok else None for row, ok in zip(four, b.notna().tolist(), strict=True)], dtype=object)

    return run(c)


def bounding_box(df: DataFrame, column: str | None = None, decimals: int | None = None) -> DataFrame:
    b = df.withColumn("__box", _box(col(geo_column(df, column))))
    return b.withColumns({n: rounded(F.col("__box")[i], decimals) for i, n in enumerate(("minLon", "minLat", "maxLon", "maxLat"))}).drop("__box")


def whole_box(df: DataFrame, column: str | None = None) -> list[float | None]:
    b = df.select(_box(col(geo_column(df, column))).alias("b"))
    return list(b.agg(F.min(F.col("b")[0]), F.min(F.col("b")[1]), F.max(F.col("b")[2]), F.max(F.col("b")[3])).first())


def random_point(df: DataFrame, new: str, column: str | None = None, tries: int = 100, lenient: bool = False) -> DataFrame:
    def pick(g: G.Geometry) -> G.Geometry | None:
        p = G.random_inside(g, tries)
        if p is None and not lenient:
            raise ValueError(f"no point inside found in {tries} tries")
        return p

    c = geo_column(df, column)
    return set_geo(df, new, udf(into(pick), "binary", col(c)), like=c)


def aggregate(df: DataFrame, method: str, categories: str | list[str] | None = None, column: str | None = None) -> DataFrame:
    """``union`` or ``intersection`` of the geometries of each group: first within partitions, then of the partial results."""
    how = {"union": "union", "intersection": "intersection"}[method]
    cats, c = listed(categories), geo_column(df, column)
    crs = crs_of(df, c)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, none = None, True
        for w in pdf["__g"]:
            if w is None:
                continue
            g = G.from_wkb(w)
            if none:
                out, none = g, False
            elif out is not None or how == "union":
                out = G.overlay(out, g, how) if out is not None else g
        row = {k: pdf[k].iloc[0] for k in pdf.columns if k not in ("__g", "__part")}
        # an empty partial intersection must empty the whole one
        return pd.DataFrame([row | {"__g": G.to_wkb(out), "__empty": how == "intersection" and not none and out is None}])

    keyed = df.select(*[col(x) for x in cats], col(c).alias("__g"))
    fields = ", ".join([*[f"`{x}` {df.schema[x].dataType.simpleString()}" for x in cats], "__g binary, __empty boolean"])
    partial = keyed.withColumn("__part", F.spark_partition_id()).groupBy(*[col(x) for x in cats], "__part").applyInPandas(fold, fields)
    empty = partial.groupBy(*[col(x) for x in cats]).agg(F.max("__empty").alias("__e"))
    grouped = partial.drop("__empty").groupBy(*[col(x) for x in cats])
    whole = grouped.applyInPandas(fold, fields).drop("__empty")
    joined = whole.join(empty, cats) if cats else whole.crossJoin(empty)
    out = joined.select(*[col(x) for x in cats], F.when(~F.coalesce("__e", F.lit(False)), F.col("__g")).alias(c))
    return with_crs(out, c, crs)


def join_geo(left: DataFrame, right: DataFrame, method: str, left_column: str | None = None, right_column: str | None = None, how: str = "left", reach: float | None = None, measure: str = "srs") -> DataFrame:
    """Rows whose geometries intersect, lie inside, or lie within a distance. Other columns of one name are an error.

    Boxes are put into grids of cells as large as they are; the smaller one is put into coarser grids too, so any two boxes that meet share a cell
    of the larger one's grid, and the pair is checked in one of them only. Boxes are stored, and for right and full joins the pairs, so that no geometry
    is read twice and a task has the Python of one step at a time.
    """
    if method not in ("intersect", "inside", "within") or how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown method {method!r} or join {how!r}")
    lc, rc = geo_column(left, left_column), geo_column(right, right_column)
    clash = [c for c in visible(left) if c in visible(right)]
    if clash:
        raise ValueError(f"both tables have {clash}; rename them first")
    if method == "within" and reach is None:
        raise ValueError("within needs a distance")
    grow = 0.0 if method != "within" else float(reach)  # type: ignore[arg-type]
    # both sides are read twice, and matched by their numbers
    left = settled(ordered(left))
    l = left.select(ORD, col(lc).alias("__a"), _box(col(lc)).alias("__box"))
    r = right.drop(ORD)
    if how in ("right", "full"):
        r = r.withColumn("__rid", F.monotonically_increasing_id())
    r = r.withColumn("__rbox", _box(col(rc)))
    if grow and measure == "srs":
        l = l.withColumn("__box", F.array(*[F.col("__box")[i] + (grow if i > 1 else -grow) for i in range(4)]))
    elif grow:
        # degrees that hold the distance; a little more for the ellipsoid, and all longitudes near the poles
        dy = grow / 110_000
        lat = F.least(F.lit(89.9), F.greatest(F.abs(F.col("__box")[1]), F.abs(F.col("__box")[3])) + dy)
        dx = F.least(F.lit(360.0), F.lit(dy) / F.cos(F.radians(lat)))
        l = l.withColumn("__box", F.array(F.col("__box")[0] - dx, F.col("__box")[1] - dy, F.col("__box")[2] + dx, F.col("__box")[3] + dy))
    level = lambda b: F.ceil(F.log2(F.greatest(F.col(b)[2] - F.col(b)[0], F.col(b)[3] - F.col(b)[1], F.lit(1e-6)))).cast("int")
    l, r = stored(l.withColumn("__l", level("__box"))), stored(r.withColumn("__rl", level("__rbox")))
    levels = sorted(x[0] for x in l.select("__l").union(r.select("__rl")).where("__l is not null").distinct().collect())

    def celled(df: DataFrame, box: str, own: str) -> DataFrame:
        at = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col(own))).alias("__level")
        d = df.where(F.col(own).isNotNull()).select("*", at)
        size = F.pow(F.lit(2.0), F.col("__level"))
        cell = lambda i: F.floor(F.col(box)[i] / size)
        return d.withColumn("__x", F.explode(F.sequence(cell(0), cell(2)))).withColumn("__y", F.explode(F.sequence(F.floor(F.col(box)[1] / F.pow(F.lit(2.0), F.col("__level"))), F.floor(F.col(box)[3] / F.pow(F.lit(2.0), F.col("__level"))))))

    if not levels:
        levels = [0]
    cand = celled(l, "__box", "__l").join(celled(r, "__rbox", "__rl"), ["__level", "__x", "__y"])
    size = F.pow(F.lit(2.0), F.col("__level"))
    once = (F.col("__level") == F.greatest("__l", "__rl")) & (F.col("__x") == F.floor(F.greatest(F.col("__box")[0], F.col("__rbox")[0]) / size)) & (F.col("__y") == F.floor(F.greatest(F.col("__box")[1], F.col("__rbox")[1]) / size))
    cand = cand.where(once)
    if method == "within":
        f = _measure(measure)
        test = (lambda x, y: f(x, y) <= reach) if measure == "srs" else (lambda x, y: f(x, y) < reach)
    else:
        test = G.intersects if method == "intersect" else (lambda x, y: G.covers(y, x))
    pairs = cand.where(udf(of(test), "boolean", F.col("__a"), col(rc))).drop("__a", "__box", "__l", "__level", "__x", "__y", "__rbox", "__rl").withColumnRenamed(ORD, "__of")
    if how in ("right", "full"):
        pairs = stored(pairs)
        forget(l)
    out = left
    matched = out.join(pairs.drop("__rid"), out[ORD] == F.col("__of"), "left" if how in ("left", "full") else "inner").drop("__of")
    if how in ("left", "inner"):
        return matched
    alone = r.drop("__rbox", "__rl").join(pairs.select("__rid").distinct(), "__rid", "left_anti").drop("__rid")
    return matched.unionByName(alone.withColumn(ORD, F.lit(1 << 62) + F.monotonically_increasing_id()), allowMissingColumns=True)


def read_geojson(spark: SparkSession, files: list[str]) -> DataFrame:
    """Features of collections, with their properties, in their order; features are parsed in parallel, one file a task."""
    text = spark.read.text(files, wholetext=True)

    def properties(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, path in zip(b["value"], b["path"], strict=True):
                d = json.loads(t)
                found: dict[tuple[str, str], int] = {}
                for f in d.get("features", [d]):
                    for k, v in (f.get("properties") or {}).items():
                        kind = "none" if v is None else "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
                        found.setdefault((k, kind), len(found))
                yield pd.DataFrame([(k, kind, path, at) for (k, kind), at in found.items()], columns=["k", "kind", "path", "at"])

    # the properties of all files, in the order in which they appear: a row for each
    seen = text.select("value", F.col("_metadata.file_path").alias("path")).mapInPandas(properties, "k string, kind string, path string, at int")
    rows = seen.groupBy("k").agg(F.collect_set("kind").alias("kinds"), F.min(F.struct("path", "at")).alias("first")).orderBy("first").collect()
    one = lambda ks: "string" if not ks else next(iter(ks)) if len(ks) == 1 else "double" if ks == {"bigint", "double"} else "string"
    kinds = {r.k: one(set(r.kinds) - {"none"}) for r in rows}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["value"]:
                d = json.loads(t)
                rows = []
                for f in d.get("features", [d]):
                    p = f.get("properties") or {}
                    row = {k: p.get(k) for k in kinds}
                    row = {k: (json.dumps(v) if isinstance(v, (dict, list)) else float(v) if kinds[k] == "double" and v is not None else str(v) if kinds[k] == "string" and v is not None else v) for k, v in row.items()}
                    rows.append(row | {"geom": G.to_wkb(f.get("geometry") or (f if "coordinates" in f else None))})
                yield pd.DataFrame(rows, columns=[*kinds, "geom"]).astype(object)

    schema = ", ".join([*[f"`{k}` {v}" for k, v in kinds.items()], "geom binary"])
    return with_crs(ordered(text.mapInPandas(parse, schema)), "geom", "EPSG:4326")


def features(df: DataFrame, column: str | None = None, *, rewind: bool = False, precision: int | None = None, plain: Callable = lambda v: v) -> Iterator[dict]:
    """The rows as features, in their order; they come to the driver one partition at a time."""
    c = geo_column(df, column)
    for row in (df.orderBy(ORD) if ORD in df.columns else df).toLocalIterator():
        d = row.asDict()
        g = G.from_wkb(d.pop(c))
        d.pop(ORD, None)
        if g and rewind:
            g = G.rewound(g)
        if g and precision is not None:
            g = G.mapped(g, lambda p: [round(p[0], precision), round(p[1], precision)])
        yield {"type": "Feature", "geometry": g, "properties": {k: plain(v) for k, v in d.items()}}


def to_geojson(df: DataFrame, column: str | None = None, *, rewind: bool = False) -> dict:
    """A feature collection of all rows."""
    return {"type": "FeatureCollection", "features": list(features(df, column, rewind=rewind))}


def write_geojson(df: DataFrame, f: Any, *, rewind: bool = False, precision: int | None = None, metadata: dict | None = None, plain: Callable = lambda v: v) -> None:
    """The feature collection of all rows, feature by feature."""
    f.write('{"type": "FeatureCollection", "features": [')
    for i, x in enumerate(features(df, rewind=rewind, precision=precision, plain=plain)):
        f.write((", " if i else "") + json.dumps(x))
    f.write("]" + (f', "metadata": {json.dumps(metadata)}' if metadata else "") + "}")


def read_shp(path: str) -> list[G.Geometry | None]:
    """Geometries of a shapefile's .shp part."""
    import struct

    with open(path, "rb") as f:
        b = f.read()
    out: list[G.Geometry | None] = []
    at = 100
    while at + 8 <= len(b):
        size = struct.unpack_from(">i", b, at + 4)[0] * 2
        rec = b[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack_from("<i", rec)[0] % 10
        if kind == 0:
            out.append(None)
        elif kind == 1:
            out.append({"type": "Point", "coordinates": list(struct.unpack_from("<dd", rec, 4))})
        elif kind == 8:
            n = struct.unpack_from("<i", rec, 36)[0]
            out.append({"type": "MultiPoint", "coordinates": [list(struct.unpack_from("<dd", rec, 40 + 16 * i)) for i in range(n)]})
        else:
            np_, nv = struct.unpack_from("<ii", rec, 36)
            starts = [*struct.unpack_from(f"<{np_}i", rec, 44), nv]
            pts = [list(struct.unpack_from("<dd", rec, 44 + 4 * np_ + 16 * i)) for i in range(nv)]
            rings = [pts[x:y] for x, y in zip(starts, starts[1:], strict=False)]
            if kind == 3:
                out.append({"type": "LineString", "coordinates": rings[0]} if len(rings) == 1 else {"type": "MultiLineString", "coordinates": rings})
                continue
            polys: list[list] = [[r] for r in rings if G.signed_area(r) <= 0]
            for h in (r for r in rings if G.signed_area(r) > 0):
                home = next((p for p in polys if G.locate(h[0], [[p[0]]]) >= 0), None)
                polys.append([h]) if home is None else home.append(h)
            out.append(G.collected(polys))
    return out


def read_dbf(path: str) -> tuple[list[str], list[list[Any]]]:
    """Names and rows of a shapefile's .dbf part."""
    import struct

    with open(path, "rb") as f:
        b = f.read()
    n, head, size = struct.unpack_from("<IHH", b, 4)
    fields, at = [], 32
    while b[at] != 13:
        fields.append((b[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(b[at + 11]), b[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        rec = b[head + i * size : head + (i + 1) * size]
        at, row = 1, []
        for _, kind, width in fields:
            t = rec[at : at + width].decode("utf-8", "replace").strip()
            at += width
            row.append(None if t == "" or set(t) == {"*"} else float(t) if kind in "NF" else t.upper() in ("T", "Y") if kind == "L" else t)
        rows.append(row)
    return [f[0] for f in fields], rows


def write_shp(path: str, geometries: list[G.Geometry | None], names: list[str], data: list[list[Any]]) -> None:
    """A shapefile: .shp, .shx and .dbf. All geometries must be of one kind; numbers and texts are kept, other values as text."""
    import struct

    kinds = {g["type"].removeprefix("Multi") for g in geometries if g}
    if len(kinds) > 1:
        raise ValueError(f"a shapefile holds one kind of geometry, not {sorted(kinds)}")
    code = {"Point": 1, "LineString": 3, "Polygon": 5}[kinds.pop() if kinds else "Point"]
    if code == 1 and any(g and g["type"] == "MultiPoint" for g in geometries):
        code = 8
    records = []
    for g in geometries:
        if g is None:
            records.append(struct.pack("<i", 0))
            continue
        box = struct.pack("<4d", *G.bounds(g))  # type: ignore[misc]
        if code == 1:
            records.append(struct.pack("<idd", 1, *g["coordinates"]))
        elif code == 8:
            v = G.vertices(g)
            records.append(struct.pack("<i", 8) + box + struct.pack("<i", len(v)) + b"".join(struct.pack("<dd", *p) for p in v))
        else:
            rings = G.lines(g)
            if code == 5:  # outer rings with the clock, holes against it
                rings = [r if (G.signed_area(r) < 0) == (i == 0) else r[::-1] for poly in G.polygons(g) for i, r in enumerate(poly)]
            starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
            v = [p for r in rings for p in r]
            records.append(struct.pack("<i", code) + box + struct.pack("<ii", len(rings), len(v)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<dd", *p[:2]) for p in v))
    boxes = [b for g in geometries if g and (b := G.bounds(g))]
    whole = struct.pack("<8d", *([min(b[i] for b in boxes) for i in (0, 1)] + [max(b[i] for b in boxes) for i in (2, 3)] if boxes else [0.0] * 4), 0, 0, 0, 0)
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", 1000, code) + whole
    with open(path, "wb") as f, open(path[:-4] + ".shx", "wb") as x:
        f.write(head(100 + sum(len(r) + 8 for r in records)))
        x.write(head(100 + 8 * len(records)))
        at = 100
        for i, r in enumerate(records):
            f.write(struct.pack(">2i", i + 1, len(r) // 2) + r)
            x.write(struct.pack(">2i", at // 2, len(r) // 2))
            at += len(r) + 8
    texts = [["" if v is None else repr(v) if isinstance(v, float) else str(v) for v in row] for row in data]
    number = [all(v is None or (isinstance(v, (int, float)) and not isinstance(v, bool)) for v in (row[j] for row in data)) for j in range(len(names))]
    wide = [min(254, max([1, *[len(t[j].encode()) for t in texts]])) for j in range(len(names))]
    with open(path[:-4] + ".dbf", "wb") as f:
        f.write(struct.pack("<4BIHH20x", 3, 124, 1, 1, len(data), 33 + 32 * len(names), 1 + sum(wide)))
        for n, is_number, w in zip(names, number, wide, strict=True):
            f.write(struct.pack("<11sc4xBB14x", n.encode("latin-1", "replace")[:10], b"N" if is_number else b"C", w, 15 if is_number and any("." in t[names.index(n)] for t in texts) else 0))
        f.write(b"\r")
        for t in texts:
            f.write(b" " + b"".join((c.encode()[:w].rjust(w) if is_number else c.encode()[:w].ljust(w)) for c, w, is_number in zip(t, wide, number, strict=True)))
        f.write(b"\x1a")
