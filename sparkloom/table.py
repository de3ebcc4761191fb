"""The table: a handle that holds the current, immutable DataFrame. Each method replaces it with a lazy plan; only getters, writers and the few operators that
need a number from the data (named in their docstrings) run something."""

from __future__ import annotations

import hashlib
import inspect
import json
import math
import os
import shutil
import time
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.exprs import NUMERIC, col, listed, rounded
from sparkloom.functions.sqltext import rewrite
from sparkloom.functions.types import spark_type
from sparkloom.naming import CamelCase
from sparkloom.operators import aggregate, analytic, columns, fuzzy, geo, joins, reshape, rows, search, strings
from sparkloom.operators.order import ORD, in_order, ordered, renumbered, row_number, visible
from sparkloom.sources import files, sinks

if TYPE_CHECKING:
    from sparkloom.session import Session

Names = str | list[str]


class Table(CamelCase):
    def __init__(self, name: str, session: Session):
        self.name, self.session = name, session
        self._df: DataFrame | None = None
        self.indexes: dict[str, Any] = {}

    # ---- the DataFrame

    @property
    def loaded(self) -> bool:
        return self._df is not None

    @property
    def ordered_df(self) -> DataFrame:
        """With the hidden order column."""
        if self._df is None:
            raise ValueError(f"{self.name} has no data")
        return self._df

    @property
    def df(self) -> DataFrame:
        """Without the hidden order column."""
        return self.ordered_df.drop(ORD)

    def set_df(self, df: DataFrame) -> Table:
        self._df = ordered(df)
        return self

    def _to(self, df: DataFrame, output: bool | str | None = None) -> Table:
        """The result into this table, or into a new one."""
        if output:
            t = self.session.new_table(None if output is True else output)
            return t.set_df(df)
        return self.set_df(df)

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    # ---- sources

    def load_data(self, paths: Names, **options: Any) -> Table:
        """CSV, TSV, text, JSON, Parquet or one Excel file; see sources.files for the options."""
        return self.set_df(files.load(self.session.spark, paths, **options))

    def load_data_from_directory(self, directory: str, **options: Any) -> Table:
        return self.set_df(files.load_directory(self.session.spark, directory, **options))

    def load_array(self, data: list[dict[str, Any]]) -> Table:
        return self.set_df(files.load_rows(self.session.spark, data))

    def load_sample(self, name: str, directory: str) -> Table:
        """A demonstration dataset that lies in a directory; nothing is fetched."""
        found = [f for f in sorted(os.listdir(directory)) if os.path.splitext(f)[0] == name]
        if not found:
            raise ValueError(f"no sample {name} in {directory}")
        path = os.path.join(directory, found[0])
        return self.load_geo_data(path) if path.endswith(("geojson", ".shp")) else self.load_data(path)

    def set_types(self, types: dict[str, str]) -> Table:
        """An empty table with these columns."""
        schema = ", ".join(f"`{c}` {spark_type(t)}" for c, t in types.items())
        df = self.session.spark.createDataFrame([], schema)
        for c, t in types.items():
            if t.lower().startswith("geometry"):
                df = geo.with_crs(df, c, t.split("'")[1] if "'" in t else "EPSG:4326")
        return self.set_df(df)

    def load_geo_data(self, path: Names, *, to_wgs84: bool = False, crs: str | None = None) -> Table:
        """GeoJSON, shapefile (.shp with .dbf beside it), or Parquet with WKB."""
        first = listed(path)[0]
        if first.endswith(".shp"):
            shapes = geo.read_shp(first)
            names, data = geo.read_dbf(first[:-4] + ".dbf") if os.path.exists(first[:-4] + ".dbf") else ([], [[] for _ in shapes])
            props = files.load_rows(self.session.spark, [dict(zip(names, r, strict=True)) | {"geom": geo.G.to_wkb(g)} for r, g in zip(data, shapes, strict=True)], [*names, "geom"])
            df = geo.with_crs(props, "geom", crs or "EPSG:4326")
        elif "parquet" in first:
            df = self.session.spark.read.parquet(*listed(path))
            for c in geo.geo_columns(df):
                df = geo.with_crs(df, c, crs or "EPSG:4326")
        else:
            df = geo.read_geojson(self.session.spark, listed(path))
            df = geo.with_crs(df, "geom", crs) if crs else df
        self.set_df(df)
        return self.reproject("WGS84") if to_wgs84 else self

    def cache(self, run: Callable[[Table], Any], *, ttl: float | None = None) -> Table:
        """The result of ``run(table)``, kept as Parquet under a key of the table's name and the function's source for ``ttl`` seconds."""
        key = hashlib.sha256((self.name + inspect.getsource(run)).encode()).hexdigest()
        path = os.path.join(self.session.cache_dir, f"{key}.parquet")
        note = os.path.join(path, "_loom.json")
        self.session.cache_used.add(os.path.basename(path))
        fresh = os.path.exists(note) and (ttl is None or time.time() - json.load(open(note))["at"] < ttl)
        if not fresh:
            run(self)
            shutil.rmtree(path, ignore_errors=True)
            self.ordered_df.write.parquet(path)
            with open(note, "w") as f:
                json.dump({"at": time.time(), "crs": {c: geo.crs_of(self.df, c) for c in geo.geo_columns(self.df)}}, f)
        if self.session.cache_verbose:
            print(f"{self.name}: {'from the cache' if fresh else 'computed'}")
        df = self.session.spark.read.parquet(path)
        for c, crs in json.load(open(note))["crs"].items():
            df = geo.with_crs(df, c, crs)
        return self.set_df(df)

    # ---- sinks

    def write_data(self, path: str, **options: Any) -> str:
        return sinks.write_data(self.ordered_df, path, **options)

    def write_geo_data(self, path: str, *, precision: int | None = None, rewind: bool = False, metadata: dict | None = None, compression: bool = False, format_dates: bool = False) -> str:
        """GeoJSON, Parquet with WKB (.geoparquet) or a shapefile (.shp)."""
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        if path.endswith(".shp"):
            if precision is not None or rewind or metadata or format_dates or compression:
                raise ValueError("shapefiles have no options")
            c = geo.geo_column(self.df)
            names = [x for x in self.get_columns() if x != c]
            data = in_order(self.ordered_df).collect()
            geo.write_shp(path, [geo.G.from_wkb(r[c]) for r in data], names, [[sinks._plain(r[x]) for x in names] for r in data])
            return path
        if path.endswith(".geoparquet"):
            if precision is not None or rewind or metadata or format_dates:
                raise ValueError("these options are for GeoJSON")
            with_parquet = path[: -len(".geoparquet")] + ".parquet"
            sinks.write_data(self.ordered_df, with_parquet, compression=compression)
            shutil.move(with_parquet, path)
            return path
        if not path.endswith((".geojson", ".json")):
            raise ValueError(f"{path} can't be written; use .geojson, .geoparquet or .shp")
        if compression:
            raise ValueError("GeoJSON is not compressed")
        df = sinks._iso(self.ordered_df) if format_dates else self.ordered_df
        with open(path, "w") as f:
            geo.write_geojson(df, f, rewind=rewind, precision=precision, metadata=metadata, plain=sinks._plain)
        return path

    # ---- tables

    def rename_table(self, name: str) -> Table:
        if name in self.session.tables:
            raise ValueError(f"there is a table {name} already")
        self.session.tables.pop(self.name, None)
        self.name = name
        self.session.push_table(self)
        return self

    def remove_table(self) -> None:
        if self.loaded:
            self.session.spark.catalog.dropTempView(self.name)
        self.session.tables.pop(self.name, None)

    def clone_table(self, output: str | bool = True, *, conditions: str | None = None, columns: Names | None = None, nb_rows: int | None = None, offset: int = 0) -> Table:
        df = self.ordered_df
        df = rows.filter_rows(df, conditions) if conditions else df
        df = _columns.select(df, columns) if columns else df
        df = rows.select_rows(df, nb_rows if nb_rows is not None else 2**31 - 1, offset) if nb_rows is not None or offset else df
        t = self._to(df, output or True)
        t.indexes = dict(self.indexes)
        return t

    # ---- columns

    def select_columns(self, names: Names) -> Table:
        return self._to(_columns.select(self.ordered_df, names))

    def remove_columns(self, names: Names) -> Table:
        return self._to(_columns.drop(self.ordered_df, names))

    def rename_columns(self, names: dict[str, str]) -> Table:
        return self._to(_columns.rename(self.ordered_df, names))

    def clean_column_names(self) -> Table:
        return self._to(_columns.clean_names(self.ordered_df))

    def add_column(self, name: str, kind: str, expression: str) -> Table:
        return self._to(_columns.add(self.ordered_df, name, kind, expression))

    def update_column(self, name: str, expression: str) -> Table:
        return self._to(_columns.update(self.ordered_df, name, expression))

    def clone_column(self, name: str, new: str) -> Table:
        return self._to(_columns.clone(self.ordered_df, name, new))

    def clone_column_with_offset(self, name: str, new: str, *, offset: int = 1, categories: Names | None = None) -> Table:
        return self._to(analytic.lead(self.ordered_df, name, new, offset, categories))

    def convert(self, types: dict[str, str], *, try_: bool = False, datetime_format: str | None = None) -> Table:
        return self._to(_columns.convert(self.ordered_df, types, try_, datetime_format))

    def add_row_number(self, name: str, *, categories: Names | None = None) -> Table:
        return self._to(row_number(self.ordered_df, name, categories))

    # ---- rows

    def filter(self, conditions: str) -> Table:
        return self._to(rows.filter_rows(self.ordered_df, conditions))

    def remove_rows(self, conditions: str) -> Table:
        return self._to(rows.remove_rows(self.ordered_df, conditions))

    def keep(self, values: dict[str, Any]) -> Table:
        return self._to(rows.keep(self.ordered_df, values))

    def remove(self, values: dict[str, Any]) -> Table:
        return self._to(rows.remove(self.ordered_df, values))

    def remove_missing(self, names: Names | None = None, *, missing_values: list | tuple = rows.MISSING, invert: bool = False) -> Table:
        return self._to(rows.remove_missing(self.ordered_df, names, missing_values, invert))

    def remove_duplicates(self, on: Names | None = None) -> Table:
        return self._to(rows.remove_duplicates(self.ordered_df, on))

    def select_rows(self, count: int | str, *, offset: int = 0, output_table: bool | str | None = None) -> Table:
        """A percentage counts the rows first."""
        return self._to(rows.select_rows(self.ordered_df, count, offset), output_table)

    def skip(self, n: int) -> Table:
        return self._to(rows.skip(self.ordered_df, n))

    def sample(self, quantity: int | str, *, seed: int | None = None) -> Table:
        """A percentage counts the rows first."""
        return self._to(rows.sample(self.ordered_df, quantity, seed))

    def sort(self, order: dict[str, str] | None = None, *, lang: dict[str, str] | None = None) -> Table:
        return self._to(rows.sort(self.ordered_df, order, lang))

    def insert_rows(self, data: list[dict[str, Any]]) -> Table:
        return self._to(rows.insert_rows(self.ordered_df, data)) if self.loaded else self.load_array(data)

    def insert_tables(self, tables: Table | str | list, *, unify_columns: bool = False) -> Table:
        many = tables if isinstance(tables, (list, tuple)) else [tables]
        frames = [(self.session.get_table(t) if isinstance(t, str) else t).ordered_df for t in many]
        return self._to(rows.append(self.ordered_df, frames, unify_columns))

    # ---- joins

    def join(self, right: Table, *, common_column: Names | None = None, type: str = "left", output_table: bool | str | None = None) -> Table:
        return self._to(joins.join(self.ordered_df, right.ordered_df, common_column, type), output_table)

    def cross_join(self, right: Table, *, output_table: bool | str | None = None) -> Table:
        return self._to(renumbered(joins.cross_join(self.ordered_df, right.ordered_df)), output_table)

    def semi_join(self, right: Table, on: Names, *, anti: bool = False) -> Table:
        return self._to(joins.semi_join(self.ordered_df, right.ordered_df, on, anti))

    def as_of_join(self, right: Table, time_column: str, *, on: Names | None = None, right_time: str | None = None) -> Table:
        return self._to(joins.as_of_join(self.ordered_df, right.ordered_df, time_column, on, right_time))

    def fuzzy_join(self, right: Table, left_column: str, right_column: str, threshold: float, *, method: str = "ratio", similarity_column: str | None = None, pre_filter_prefix_len: int | None = None, output_table: bool | str | None = None) -> Table:
        return self._to(renumbered(fuzzy.fuzzy_join(self.ordered_df, right.ordered_df, left_column, right_column, threshold, method, similarity_column, pre_filter_prefix_len)), output_table)

    def fuzzy_clean(self, column: str, new: str, threshold: float, *, method: str = "ratio", keep: str = "mostCommon", pre_filter_prefix_len: int | None = None) -> Table:
        return self._to(fuzzy.fuzzy_clean(self.ordered_df, column, new, threshold, method, keep, pre_filter_prefix_len))

    def join_geo(self, right: Table, method: str, *, left_table_column: str | None = None, right_table_column: str | None = None, type: str = "left", distance: float | None = None, distance_method: str = "srs", output_table: bool | str | None = None) -> Table:
        """Geometry columns of one name are told apart by the tables' names; the left one gets its name back unless there is an output table."""
        l, r = self.ordered_df, right.ordered_df
        lc, rc = geo.geo_column(l, left_table_column), geo.geo_column(r, right_table_column)
        back = lc
        if lc == rc:
            l, r = _columns.rename(l, {lc: f"{lc}{self.name.capitalize()}"}), _columns.rename(r, {rc: f"{rc}{right.name.capitalize()}"})
            lc, rc = f"{lc}{self.name.capitalize()}", f"{rc}{right.name.capitalize()}"
        out = geo.join_geo(l, r, method, lc, rc, type, distance, distance_method)
        if back != lc and not output_table:
            out = _columns.rename(out, {lc: back})
        return self._to(renumbered(out), output_table)

    # ---- texts and numbers

    def trim(self, names: Names, *, character: str | None = None, method: str = "trim") -> Table:
        return self._to(strings.trim(self.ordered_df, names, character, method))

    def lower(self, names: Names) -> Table:
        return self._to(strings.lower(self.ordered_df, names))

    def upper(self, names: Names) -> Table:
        return self._to(strings.upper(self.ordered_df, names))

    def capitalize(self, names: Names) -> Table:
        return self._to(strings.capitalize(self.ordered_df, names))

    def truncate(self, names: Names, length: int) -> Table:
        return self._to(strings.left(self.ordered_df, names, length))

    def left(self, names: Names, n: int) -> Table:
        return self._to(strings.left(self.ordered_df, names, n))

    def right(self, names: Names, n: int) -> Table:
        return self._to(strings.right(self.ordered_df, names, n))

    def pad(self, names: Names, length: int, *, method: str = "left", character: str = "0") -> Table:
        """Looks for texts that are too long first."""
        return self._to(strings.pad(self.ordered_df, names, length, method, character))

    def replace(self, names: Names, pairs: dict[str, str], *, entire_string: bool = False, regex: bool = False) -> Table:
        return self._to(strings.replace(self.ordered_df, names, pairs, entire_string, regex))

    def replace_nulls(self, names: Names, value: Any) -> Table:
        return self._to(strings.replace_nulls(self.ordered_df, names, value))

    def concatenate(self, names: list[str], new: str, *, separator: str | None = None) -> Table:
        return self._to(strings.concatenate(self.ordered_df, names, new, separator))

    def concatenate_row(self, names: list[str], new: str) -> Table:
        return self._to(strings.concatenate_row(self.ordered_df, names, new))

    def split_extract(self, name: str, separator: str, index: int, new: str) -> Table:
        return self._to(strings.split_extract(self.ordered_df, name, separator, index, new))

    def split_spread(self, name: str, separator: str, new: list[str], *, no_check: bool = False) -> Table:
        """Looks for texts of too many parts first, unless ``no_check``."""
        return self._to(strings.split_spread(self.ordered_df, name, separator, new, no_check))

    def normalize_string(self, name: str, new: str, *, strip_punctuation: bool = True) -> Table:
        return self._to(strings.normalize_string(self.ordered_df, name, new, strip_punctuation))

    def round(self, names: Names, *, decimals: int = 0, method: str = "round") -> Table:
        return self._to(strings.round_columns(self.ordered_df, names, decimals, method))

    # ---- shape

    def longer(self, names: list[str], columns_to: str, values_to: str) -> Table:
        return self._to(reshape.longer(self.ordered_df, names, columns_to, values_to))

    def wider(self, columns_from: str, values_from: str) -> Table:
        """Looks for the new columns' names first."""
        return self._to(reshape.wider(self.ordered_df, columns_from, values_from))

    def nest(self, name: str, separator: str, categories: Names) -> Table:
        return self._to(reshape.nest(self.ordered_df, name, separator, categories))

    def unnest(self, name: str, separator: str) -> Table:
        return self._to(reshape.unnest(self.ordered_df, name, separator))

    def repeat_rows(self, name: str, *, index: str | None = None) -> Table:
        return self._to(reshape.repeat_rows(self.ordered_df, name, index))

    # ---- statistics

    def summarize(self, *, values: Names | None = None, categories: Names | None = None, summaries: Any = None, decimals: int | None = None, to_ms: bool = False, no_column_value: bool = False, output_table: bool | str | None = None) -> Table:
        return self._to(aggregate.summarize(self.df, values, categories, summaries, decimals, to_ms, no_column_value), output_table)

    def correlations(self, *, x: str | None = None, y: str | None = None, categories: Names | None = None, decimals: int | None = None, output_table: bool | str | None = None) -> Table:
        return self._to(aggregate.correlations(self.df, x, y, categories, decimals), output_table)

    def linear_regressions(self, *, x: str | None = None, y: str | None = None, categories: Names | None = None, decimals: int | None = None, output_table: bool | str | None = None) -> Table:
        return self._to(aggregate.linear_regressions(self.df, x, y, categories, decimals), output_table)

    def ranks(self, values: str, new: str, *, order: str = "asc", categories: Names | None = None, no_gaps: bool = False) -> Table:
        """In the order of the ranks."""
        out = analytic.ranks(self.ordered_df, values, new, order, categories, no_gaps)
        return self._to(renumbered(out.orderBy(*[col(c).asc_nulls_last() for c in listed(categories)], new, ORD)))

    def quantiles(self, values: str, n: int, new: str, *, categories: Names | None = None) -> Table:
        return self._to(analytic.quantiles(self.ordered_df, values, n, new, categories))

    def bins(self, values: str, interval: float, new: str, *, start_value: float | None = None) -> Table:
        """Looks for the least value first."""
        return self._to(analytic.bins(self.ordered_df, values, interval, new, start_value))

    def accumulate(self, name: str, new: str, *, categories: Names | None = None) -> Table:
        return self._to(analytic.accumulate(self.ordered_df, name, new, categories))

    def rolling(self, name: str, new: str, summary: str, preceding: int, following: int, *, categories: Names | None = None, decimals: int | None = None) -> Table:
        return self._to(analytic.rolling(self.ordered_df, name, new, summary, preceding, following, categories, decimals))

    def fill(self, names: Names, *, categories: Names | None = None, interpolate: bool = False, interpolate_by: str | None = None) -> Table:
        df = self.ordered_df
        return self._to(analytic.interpolate(df, names, categories, interpolate_by) if interpolate or interpolate_by else analytic.fill(df, names, categories))

    def proportions_horizontal(self, names: list[str], *, suffix: str = "Perc", decimals: int | None = None) -> Table:
        return self._to(analytic.proportions_horizontal(self.ordered_df, names, suffix, decimals))

    def proportions_vertical(self, name: str, new: str, *, categories: Names | None = None, decimals: int | None = None) -> Table:
        return self._to(analytic.proportions_vertical(self.ordered_df, name, new, categories, decimals))

    def z_score(self, name: str, new: str, *, categories: Names | None = None, decimals: int | None = None) -> Table:
        return self._to(analytic.z_score(self.ordered_df, name, new, categories, decimals))

    def normalize(self, name: str, new: str, *, categories: Names | None = None, decimals: int | None = None) -> Table:
        return self._to(analytic.normalize(self.ordered_df, name, new, categories, decimals))

    def outliers_iqr(self, name: str, new: str, *, categories: Names | None = None) -> Table:
        """Counts the rows first."""
        return self._to(analytic.outliers_iqr(self.ordered_df, name, new, categories))

    # ---- Python

    def update_with_python(self, f: Callable[[list[dict[str, Any]]], list[dict[str, Any]]]) -> Table:
        """All rows to the driver, through ``f``, and back: for small tables. ``map_in_pandas`` is the way for large ones."""
        if geo.geo_columns(self.df):
            raise ValueError("tables with geometries can't go through Python rows")
        return self.load_array(f(self.get_data()))

    update_with_js = update_with_python

    def map_in_pandas(self, f: Callable, schema: str) -> Table:
        """Batches of rows through ``f``, on the executors."""
        return self._to(self.df.mapInPandas(f, schema))

    def apply_in_pandas(self, categories: Names, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Table:
        """Each group through ``f``, on the executors."""
        return self._to(self.df.groupBy(*[col(c) for c in listed(categories)]).applyInPandas(f, schema))

    # ---- search

    def create_fts_index(self, id_column: str, text_column: str, *, overwrite: bool = False, **options: Any) -> Table:
        """Builds and stores the index, unless there is one with these options. It is of the rows the table has now."""
        key = f"fts_{_columns.camel(text_column)}"
        old = self.indexes.get(key)
        if overwrite or old is None or (old.id_col, old.text_col, old.options) != (id_column, text_column, options):
            self.indexes[key] = search.create_index(self.df, id_column, text_column, **options)
        return self

    def bm25(self, text: str, id_column: str, text_column: str, k: int, *, k1: float = 1.2, b: float = 0.75, conjunctive: bool = False, min_score: float | None = None, score_column: str | None = None, output_table: bool | str | None = None, **options: Any) -> Table:
        self.create_fts_index(id_column, text_column, **options)
        index = self.indexes[f"fts_{_columns.camel(text_column)}"]
        return self._to(renumbered(search.bm25(self.ordered_df, index, text, k, k1, b, conjunctive, min_score, score_column)), output_table)

    def create_vss_index(self, column: str, *, overwrite: bool = False, **options: Any) -> Table:
        """Notes the column. Search is exact, by one pass and a heap, so there is nothing to build; the options of approximate indexes have no effect."""
        del overwrite, options
        self.indexes[f"vss_{_columns.camel(column)}"] = {"column": column, "metric": "cosine"}
        return self

    def nearest(self, column: str, vector: list[float], k: int, *, new: str = "similarity", output_table: bool | str | None = None) -> Table:
        """The k rows of greatest cosine similarity."""
        return self._to(renumbered(search.nearest_by_cosine(self.ordered_df, column, vector, k, new)), output_table)

    # ---- geometry

    def points(self, lat: str, lon: str, new: str) -> Table:
        return self._to(geo.points(self.ordered_df, lat, lon, new))

    def lat_lon(self, column: str, lat: str, lon: str) -> Table:
        return self._to(geo.lat_lon(self.ordered_df, column, lat, lon))

    def is_valid_geo(self, new: str, *, column: str | None = None) -> Table:
        return self._to(geo.is_valid(self.ordered_df, new, column))

    def is_closed_geo(self, new: str, *, column: str | None = None) -> Table:
        return self._to(geo.is_closed(self.ordered_df, new, column))

    def nb_vertices(self, new: str, *, column: str | None = None) -> Table:
        return self._to(geo.nb_vertices(self.ordered_df, new, column))

    def type_geo(self, new: str, *, column: str | None = None) -> Table:
        return self._to(geo.type_of(self.ordered_df, new, column))

    def fix_geo(self, column: str | None = None) -> Table:
        return self._to(geo.fix(self.ordered_df, column))

    def flip_coordinates(self, column: str | None = None) -> Table:
        return self._to(geo.flip(self.ordered_df, column))

    def reduce_precision(self, decimals: int, *, column: str | None = None) -> Table:
        return self._to(geo.reduce_precision(self.ordered_df, decimals, column))

    def reproject(self, to: str, *, column: str | None = None, have: str | None = None) -> Table:
        return self._to(geo.reproject(self.ordered_df, to, column, have))

    def area(self, new: str, *, unit: str = "m2", column: str | None = None) -> Table:
        return self._to(geo.area(self.ordered_df, new, unit, column))

    def length(self, new: str, *, unit: str = "m", column: str | None = None) -> Table:
        return self._to(geo.length(self.ordered_df, new, unit, column))

    def perimeter(self, new: str, *, unit: str = "m", column: str | None = None) -> Table:
        return self._to(geo.perimeter(self.ordered_df, new, unit, column))

    def distance(self, a: str, b: str, new: str, *, method: str = "srs", unit: str | None = None, decimals: int | None = None) -> Table:
        return self._to(geo.distance(self.ordered_df, a, b, new, method, unit, decimals))

    def centroid(self, new: str, *, column: str | None = None) -> Table:
        return self._to(geo.centroid(self.ordered_df, new, column))

    def buffer(self, new: str, distance: float, *, column: str | None = None) -> Table:
        return self._to(geo.buffer(self.ordered_df, new, distance, column))

    def simplify(self, tolerance: float, *, column: str | None = None) -> Table:
        return self._to(geo.simplify(self.ordered_df, tolerance, column))

    def intersection(self, a: str, b: str, new: str) -> Table:
        return self._to(geo.overlay(self.ordered_df, a, b, new, "intersection"))

    def remove_intersection(self, a: str, b: str, new: str) -> Table:
        return self._to(geo.overlay(self.ordered_df, a, b, new, "difference"))

    def union(self, a: str, b: str, new: str) -> Table:
        return self._to(geo.overlay(self.ordered_df, a, b, new, "union"))

    def intersect(self, a: str, b: str, new: str) -> Table:
        return self._to(geo.intersect(self.ordered_df, a, b, new))

    def inside(self, a: str, b: str, new: str) -> Table:
        return self._to(geo.inside(self.ordered_df, a, b, new))

    def fill_holes(self, column: str | None = None) -> Table:
        return self._to(geo.fill_holes(self.ordered_df, column))

    def lines_to_polygons(self, column: str | None = None) -> Table:
        return self._to(geo.lines_to_polygons(self.ordered_df, column))

    def unnest_geo(self, column: str | None = None) -> Table:
        return self._to(renumbered(geo.unnest_geo(self.ordered_df, column)))

    def bounding_box(self, *, column: str | None = None, decimals: int | None = None) -> Table:
        return self._to(geo.bounding_box(self.ordered_df, column, decimals))

    def random_point(self, new: str, *, column: str | None = None, tries: int = 100, try_: bool = False) -> Table:
        return self._to(geo.random_point(self.ordered_df, new, column, tries, try_))

    def aggregate_geo(self, method: str, *, categories: Names | None = None, column: str | None = None, output_table: bool | str | None = None) -> Table:
        return self._to(geo.aggregate(self.ordered_df, method, categories, column), output_table)

    def get_bounding_box(self, column: str | None = None) -> list[float | None]:
        return geo.whole_box(self.df, column)

    def get_geo_data(self, column: str | None = None, *, rewind: bool = False) -> dict:
        return geo.to_geojson(self.ordered_df, column, rewind=rewind)

    def get_projection(self, column: str | None = None) -> str | None:
        return geo.crs_of(self.df, geo.geo_column(self.df, column))

    # ---- getters: these run

    def _rows(self, df: DataFrame) -> list[dict[str, Any]]:
        return [{k: v for k, v in r.asDict(recursive=True).items() if k != ORD} for r in df.collect()]

    def get_data(self, *, columns: Names | None = None, conditions: str | None = None) -> list[dict[str, Any]]:
        df = rows.filter_rows(self.ordered_df, conditions) if conditions else self.ordered_df
        df = _columns.select(df, columns) if columns else df
        if geo.geo_columns(df):
            raise ValueError("geometries are read by get_geo_data")
        return self._rows(in_order(df))

    def get_row(self, conditions: str, *, no_check: bool = False) -> dict[str, Any] | None:
        got = self._rows(rows.filter_rows(self.ordered_df, conditions).limit(2))
        if not no_check and len(got) != 1:
            raise ValueError(f"{'no row' if not got else 'more than one row'} for {conditions}")
        return got[0] if got else None

    def _some(self, n: int, conditions: str | None, last: bool) -> list[dict[str, Any]]:
        df = rows.filter_rows(self.ordered_df, conditions) if conditions else self.ordered_df
        return self._rows(df.orderBy(F.desc(ORD) if last else F.asc(ORD)).limit(n))

    def get_first_row(self, *, conditions: str | None = None) -> dict[str, Any] | None:
        return next(iter(self._some(1, conditions, False)), None)

    def get_last_row(self, *, conditions: str | None = None) -> dict[str, Any] | None:
        return next(iter(self._some(1, conditions, True)), None)

    def get_top(self, n: int, *, conditions: str | None = None) -> list[dict[str, Any]]:
        return self._some(n, conditions, False)

    def get_bottom(self, n: int, *, conditions: str | None = None, original_order: bool = False) -> list[dict[str, Any]]:
        got = self._some(n, conditions, True)
        return got[::-1] if original_order else got

    def get_values(self, name: str) -> list[Any]:
        return [r[0] for r in in_order(self.ordered_df).select(col(name)).collect()]

    def get_uniques(self, name: str) -> list[Any]:
        return [r[0] for r in self.df.select(col(name)).distinct().orderBy(col(name).asc_nulls_last()).collect()]

    def _one(self, expression: Any, decimals: int | None = None) -> Any:
        return self.df.agg(rounded(expression, decimals) if decimals is not None else expression).first()[0]

    def get_min(self, name: str) -> Any:
        return self._one(F.min(col(name)))

    def get_max(self, name: str) -> Any:
        return self._one(F.max(col(name)))

    def get_extent(self, name: str) -> list[Any]:
        return list(self.df.agg(F.min(col(name)), F.max(col(name))).first())

    def _stat(self, name: str, stat: str, decimals: int | None) -> Any:
        return self._one(aggregate.statistic(name, stat, self.df.schema[name].dataType), decimals)

    def get_mean(self, name: str, *, decimals: int | None = None) -> Any:
        return self._stat(name, "mean", decimals)

    def get_median(self, name: str, *, decimals: int | None = None) -> Any:
        return self._stat(name, "median", decimals)

    def get_sum(self, name: str) -> Any:
        return self._stat(name, "sum", None)

    def get_skew(self, name: str, *, decimals: int | None = None) -> Any:
        return self._stat(name, "skew", decimals)

    def get_std_dev(self, name: str, *, decimals: int | None = None) -> Any:
        return self._stat(name, "stdDev", decimals)

    def get_var(self, name: str, *, decimals: int | None = None) -> Any:
        return self._stat(name, "var", decimals)

    def get_quantile(self, name: str, quantile: float, *, decimals: int | None = None) -> Any:
        q = analytic.exact_quantiles(self.df, name, [float(quantile)])[0]
        return q if q is None or decimals is None else math.copysign(math.floor(abs(q) * 10**decimals + 0.5) / 10**decimals, q)

    def get_nb_rows(self, *, conditions: str | None = None) -> int:
        return (self.df.where(F.expr(rewrite(conditions, condition=True))) if conditions else self.df).count()

    def get_nb_columns(self) -> int:
        return len(self.get_columns())

    def get_nb_values(self) -> int:
        return self.get_nb_rows() * self.get_nb_columns()

    def get_nb_characters(self, name: str) -> int:
        return self._one(F.sum(F.length(col(name)))) or 0

    def get_columns(self) -> list[str]:
        return visible(self.ordered_df)

    def has_column(self, name: str) -> bool:
        return name in self.get_columns()

    def get_table_name(self) -> str:
        return self.name

    def get_types(self) -> dict[str, str]:
        return {f.name: f"GEOMETRY('{f.metadata['crs']}')" if "crs" in f.metadata else f.dataType.simpleString() for f in self.df.schema}

    def get_schema(self) -> list[dict[str, Any]]:
        return [{"column_name": f.name, "column_type": f.dataType.simpleString(), "null": "YES" if f.nullable else "NO"} for f in self.df.schema]

    def get_description(self) -> list[dict[str, Any]]:
        """For each column its type and its numbers of rows, distinct values and nulls."""
        kinds = self.get_types()
        out = aggregate.summarize(self.df, self.get_columns(), summaries=["count", "countUnique", "countNull"])
        return [{"_": r["value"], "type": kinds[r["value"]], **{k: r[k] for k in ("count", "countUnique", "countNull")}} for r in out.collect()]

    def get_data_as_csv(self) -> str:
        return files.to_csv_text(self.get_data(), self.get_columns())

    # ---- logging

    def log_table(self, n: int | None = None, *, conditions: str | None = None, types: bool | None = None) -> Table:
        n = self.session.nb_rows_to_log if n is None else n
        print(f"\n{self.name}")
        if self.session.types_to_log if types is None else types:
            print(self.get_types())
        _show(self._some(n, conditions, False), self.get_columns(), self.session.nb_characters_to_log)
        print(f"{self.get_nb_rows(conditions=conditions)} rows in total (rows shown: {n})")
        return self

    def log_bottom(self, n: int, *, original_order: bool = False) -> Table:
        _show(self.get_bottom(n, original_order=original_order), self.get_columns(), self.session.nb_characters_to_log)
        return self

    def log_description(self) -> Table:
        d = self.get_description()
        _show(d, list(d[0]) if d else [], None)
        return self

    def log_projections(self) -> Table:
        print({c: geo.crs_of(self.df, c) for c in geo.geo_columns(self.df)})
        return self

    def log_types(self) -> Table:
        print(self.get_types())
        return self

    def log_uniques(self, name: str, *, stringify: bool = False) -> Table:
        print(json.dumps(self.get_uniques(name), default=str) if stringify else self.get_uniques(name))
        return self

    def log_columns(self) -> Table:
        print(self.get_columns())
        return self

    def log_nb_rows(self) -> Table:
        print(self.get_nb_rows())
        return self

    def log_extent(self, name: str) -> Table:
        print(self.get_extent(name))
        return self

    def numeric_columns(self) -> list[str]:
        return [f.name for f in self.df.schema if isinstance(f.dataType, NUMERIC) and not isinstance(f.dataType, T.BooleanType)]


_columns = columns


def _show(data: list[dict[str, Any]], names: list[str], width: int | None) -> None:
    def text(v: Any) -> str:
        s = "null" if v is None else f"<{len(v)} bytes>" if isinstance(v, (bytes, bytearray)) else f"{v:,}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        return s if width is None or len(s) <= width else s[:width] + "..."

    cells = [[text(r.get(c)) for c in names] for r in data]
    wide = [max([len(c), *[len(row[i]) for row in cells]]) for i, c in enumerate(names)]
    for row in [names, ["-" * w for w in wide], *cells]:
        print(" | ".join(x.ljust(w) for x, w in zip(row, wide, strict=True)))
