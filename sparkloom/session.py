"""The session: a registry of named tables over one SparkSession."""

from __future__ import annotations

import json
import os
import shutil
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sparkloom.functions.sqltext import rewrite
from sparkloom.naming import CamelCase
from sparkloom.operators.order import ordered, visible
from sparkloom.sources import files, sinks
from sparkloom.table import Table


class Session(CamelCase):
    """Tables by name. Give a SparkSession to borrow it, or none to get or create one. ``table_class`` may be a subclass of Table."""

    def __init__(
        self, spark: SparkSession | None = None, *, file: str | None = None, overwrite: bool = False, log_duration: bool = False, nb_rows_to_log: int = 10, nb_characters_to_log: int | None = None, types: bool = False,
        debug: bool = False, cache_verbose: bool = False, cache_dir: str = ".loom-cache", table_class: type[Table] = Table, memory_limit: str | None = None, temp_directory: str | None = None, progress_bar: bool = False,
    ):
        self.file, self.overwrite, self.log_duration, self.debug, self.cache_verbose, self.cache_dir = file, overwrite, log_duration, debug, cache_verbose, cache_dir
        self.nb_rows_to_log, self.nb_characters_to_log, self.types_to_log = nb_rows_to_log, nb_characters_to_log, types
        self.table_class, self.tables, self._count, self._began = table_class, {}, 0, time.time()
        self._options = {"spark.driver.memory": memory_limit, "spark.local.dir": temp_directory, "spark.ui.showConsoleProgress": str(progress_bar).lower()}
        self._spark, self.cache_used = spark, set()

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self.start()
        return self._spark  # type: ignore[return-value]

    def start(self) -> Session:
        """Starts Spark if need be; checks the database's path, and loads it if it exists and is not to be overwritten."""
        if self.file is not None:
            if not self.file.endswith(".db"):
                raise ValueError("a database's path ends in .db")
            if os.path.exists(self.file):
                if not self.overwrite:
                    raise ValueError(f"{self.file} exists; use overwrite or load_db")
                shutil.rmtree(self.file) if os.path.isdir(self.file) else os.remove(self.file)
        if self._spark is None:
            b = SparkSession.builder.appName("sparkloom").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.timeType.enabled", "true")
            for k, v in self._options.items():
                if v is not None:
                    b = b.config(k, v)
            self._spark = b.getOrCreate()
        return self

    # ---- registry

    def new_table(self, name: str | None = None) -> Table:
        if name is None:
            self._count += 1
            name = f"table{self._count}"
        t = self.table_class(name, self)
        self.push_table(t)
        return t

    def push_table(self, table: Table) -> None:
        if not isinstance(table, self.table_class):
            raise ValueError(f"not a {self.table_class.__name__}")
        if table.name in self.tables:
            raise ValueError(f"there is a table {table.name} already")
        self.tables[table.name] = table

    def get_table(self, name: str) -> Table:
        if name not in self.tables:
            raise ValueError(f"no table {name}; there are {self.get_table_names()}")
        return self.tables[name]

    def get_tables(self) -> list[Table]:
        return list(self.tables.values())

    def get_table_names(self) -> list[str]:
        return sorted(self.tables)

    def log_table_names(self) -> None:
        print("tables:", self.get_table_names())

    def has_table(self, table: str | Table) -> bool:
        return (table if isinstance(table, str) else table.name) in self.tables

    def _names(self, tables: Any) -> list[str]:
        return [t if isinstance(t, str) else t.name for t in (tables if isinstance(tables, (list, tuple)) else [tables])]

    def remove_tables(self, tables: str | Table | list) -> None:
        for n in self.get_table_names() if tables == "all" else self._names(tables):
            self.get_table(n).remove_table()

    def select_tables(self, tables: str | Table | list) -> None:
        keep = self._names(tables)
        for n in keep:
            self.get_table(n)
        self.remove_tables([n for n in self.get_table_names() if n not in keep])

    def get_extensions(self) -> list[dict[str, Any]]:
        return [{"name": n, "installed": True} for n in ("bm25", "cosine search", "fuzzy matching", "geometry", "sqlite", "xlsx")]

    # ---- SQL

    def sql(self, query: str) -> DataFrame:
        """The result of a query over all tables, as a DataFrame; nothing runs yet."""
        for t in self.tables.values():
            if t.loaded:
                t.df.createOrReplaceTempView(t.name)
        return self.spark.sql(rewrite(query))

    def custom_query(self, query: str, *, return_data: bool = True, table: str | None = None) -> list[dict[str, Any]] | None:
        """Rows of a query; or, with ``table``, a new table of its result."""
        df = self.sql(query)
        if table is not None:
            (self.tables.get(table) or self.new_table(table)).set_df(df)
            return None
        return [r.asDict(recursive=True) for r in df.collect()] if return_data else None

    # ---- databases

    def write_db(self, path: str, *, no_meta_data: bool = False) -> None:
        """All tables: a directory of Parquet with a manifest (.db), or a SQLite file."""
        frames = {t.name: t for t in self.tables.values() if t.loaded}
        if path.endswith(".sqlite"):
            sinks.write_sqlite({n: t.ordered_df for n, t in frames.items()}, path)
            return
        if not path.endswith(".db"):
            raise ValueError("a database's path ends in .db or .sqlite")
        os.makedirs(path, exist_ok=True)
        manifest = {"tables": {}}
        for n, t in frames.items():
            t.ordered_df.write.mode("overwrite").parquet(f"{path}/{n}")
            manifest["tables"][n] = {"columns": visible(t.ordered_df), "schema": json.loads(t.df.schema.json())}
        with open(f"{path}/manifest.json", "w") as f:
            json.dump(manifest, f)
        if not no_meta_data:
            with open(f"{path}_indexes.json", "w") as f:
                json.dump({n: sorted(t.indexes) for n, t in frames.items()}, f)

    def load_db(self, path: str, *, name: str | None = None, detach: bool = True) -> None:
        """Tables of a database written by ``write_db``, or of a SQLite file. ``name`` is put before their names."""
        del detach  # Parquet is read when it is needed; there is nothing to detach
        if path.endswith(".sqlite"):
            frames = files.load_sqlite(self.spark, path)
        elif path.endswith(".db"):
            with open(f"{path}/manifest.json") as f:
                frames = {n: self.spark.read.parquet(f"{path}/{n}") for n in json.load(f)["tables"]}
        else:
            raise ValueError("a database's path ends in .db or .sqlite")
        for n, df in frames.items():
            full = f"{name}.{n}" if name else n
            (self.tables.get(full) or self.new_table(full)).set_df(ordered(df))

    def done(self) -> None:
        """Writes the database if there is a file, drops unused cache entries, forgets the tables. A borrowed SparkSession stays."""
        if self.file is not None:
            self.write_db(self.file)
        if os.path.isdir(self.cache_dir):
            for e in os.listdir(self.cache_dir):
                if e.endswith(".parquet") and e not in self.cache_used and self.cache_used:
                    shutil.rmtree(os.path.join(self.cache_dir, e), ignore_errors=True)
        for t in list(self.tables.values()):
            if t.loaded:
                self.spark.catalog.dropTempView(t.name)
        self.tables.clear()
        if self.log_duration:
            print(f"done in {time.time() - self._began:.1f} s")
