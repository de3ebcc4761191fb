"""Queries over sources, sinks, the registry of tables, getters and logging: what is written is read again and compared with the driver's tables."""

from __future__ import annotations

import contextlib
import io
import json
import os
import zipfile
from typing import Any

from pyspark.sql import DataFrame

from sparkloom.plans.queries import Tables, query
from sparkloom.session import Session
from sparkloom.storage import new_path
from sparkloom.table import Table


def _folder(t: Tables) -> str:
    path = new_path(t.session.spark, "files").removeprefix("file://").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def _rows(t: Table) -> list[dict[str, Any]]:
    return t.get_data()


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query(_CUSTOMER)
def load_csv(t: Tables) -> Table:
    path = t.customer.write_data(f"{_folder(t)}/c.csv")
    return t.session.new_table().load_data(path)


@query(_CUSTOMER)
def load_csv_gzip(t: Tables) -> Table:
    return t.session.new_table().load_data(t.customer.write_data(f"{_folder(t)}/c.csv", compression=True))


@query("SELECT c_custkey, c_name FROM customer")
def load_csv_packed(t: Tables) -> Table:
    """Compressed under a name that does not tell."""
    path = t.customer.write_data(f"{_folder(t)}/c.csv", compression=True)
    os.rename(path, path.removesuffix(".csv.gz") + ".txt")
    return t.session.new_table().load_data(path.removesuffix(".csv.gz") + ".txt", compression="gzip", delim=",", columns=["c_custkey", "c_name"])


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name, 'b.tsv' AS file FROM nation")
def load_tsv_skip(t: Tables) -> Table:
    path = f"{_folder(t)}/b.tsv"
    with open(path, "w") as f:
        f.write("a remark\nand another\nkey\tname\n" + "".join(f"{r['n_nationkey']}\t{r['n_name']}\n" for r in _rows(t.nation)))
    return t.session.new_table().load_data(path, skip=2, file_name=True).update_column("filename", "element_at(split(filename, '/'), -1)").rename_columns({"filename": "file"})


@query("SELECT n_nationkey::BIGINT AS key, 'the' || chr(10) || '\"' || n_name || '\"' AS name FROM nation")
def load_csv_quoted(t: Tables) -> Table:
    path = f"{_folder(t)}/q.csv"
    with open(path, "w") as f:
        f.write("key,name\n" + "".join('{},"the\n""{}"""\n'.format(r["n_nationkey"], r["n_name"]) for r in _rows(t.nation)))
    return t.session.new_table().load_data(path)


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS o_orderdate FROM orders")
def write_csv_dates(t: Tables) -> Table:
    path = t.orders.select_columns(["o_orderkey", "o_orderdate"]).write_data(f"{_folder(t)}/o.csv", format_dates=True)
    return t.session.new_table().load_data(path, all_text=True)


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def load_json(t: Tables) -> Table:
    return t.session.new_table().load_data(t.supplier.write_data(f"{_folder(t)}/s.json"))


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def load_json_records(t: Tables) -> Table:
    path = f"{_folder(t)}/r.ndjson"
    with open(path, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in _rows(t.region))
    return t.session.new_table().load_data(path, json_format="newlineDelimited", records=False)


@query("SELECT r_name, r_regionkey::BIGINT AS r_regionkey FROM region")
def write_json_arrays(t: Tables) -> Table:
    path = t.region.write_data(f"{_folder(t)}/r.json", as_arrays=True)
    with open(path) as f:
        d = json.load(f)
    return t.session.new_table().load_array([dict(zip(d, x, strict=True)) for x in zip(*d.values(), strict=True)]).convert({"r_regionkey": "bigint"})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def load_parquet(t: Tables) -> Table:
    """Columns and rows are cut in the scan."""
    return t.session.new_table().load_data(f"{t.dir}/orders.parquet", columns=["o_orderkey", "o_totalprice", "o_orderstatus"]).filter("o_orderstatus = 'F'").remove_columns("o_orderstatus")


@query("SELECT * FROM orders")
def write_parquet(t: Tables) -> Table:
    return t.session.new_table().load_data(t.orders.write_data(f"{_folder(t)}/o.parquet", compression=True))


@query("SELECT n_nationkey::BIGINT AS key, CASE WHEN n_nationkey < 10 THEN n_name END AS a, CASE WHEN n_nationkey >= 10 THEN n_name END AS b FROM nation")
def load_directory(t: Tables) -> Table:
    folder = _folder(t)
    for name, test in (("a", "key < 10"), ("b", "key >= 10")):
        t.nation.select_columns(["n_nationkey", "n_name"]).rename_columns({"n_nationkey": "key", "n_name": name}).filter(test).write_data(f"{folder}/{name}.csv")
    return t.session.new_table().load_data_from_directory(folder, unify=True)


@query("SELECT r_regionkey::DOUBLE AS key, r_name AS name FROM region")
def load_excel(t: Tables) -> Table:
    path = f"{_folder(t)}/r.xlsx"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = "".join(f'<row><c r="A{i}"><v>{r["r_regionkey"]}</v></c><c r="B{i}" t="inlineStr"><is><t>{r["r_name"]}</t></is></c></row>' for i, r in enumerate(_rows(t.region), 2))
    head = '<row><c r="A1" t="inlineStr"><is><t>key</t></is></c><c r="B1" t="inlineStr"><is><t>name</t></is></c></row>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="regions" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData>{head}{cells}</sheetData></worksheet>')
    return t.session.new_table().load_data(path, sheet="regions")


@query("SELECT r_regionkey::DOUBLE AS key, r_name AS name, r_regionkey > 2 AS late FROM region")
def load_array(t: Tables) -> Table:
    return t.session.new_table().load_array([{"key": r["r_regionkey"], "name": r["r_name"], "late": r["r_regionkey"] > 2} for r in _rows(t.region)])


@query("SELECT r_regionkey AS a, r_name AS b FROM region")
def set_types(t: Tables) -> Table:
    return t.session.new_table().set_types({"a": "integer", "b": "string"}).insert_tables(t.region.rename_columns({"r_regionkey": "a", "r_name": "b"}))


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def load_sample(t: Tables) -> Table:
    folder = _folder(t)
    t.region.write_data(f"{folder}/regions.csv")
    return t.session.new_table().load_sample("regions", folder)


@query("SELECT p_brand, count(*) AS n, 1 AS runs FROM part GROUP BY p_brand")
def cached_load(t: Tables) -> DataFrame:
    """The second time the cache answers."""
    session, runs = Session(t.session.spark, cache_dir=_folder(t)), []

    def load(table: Table) -> None:
        runs.append(1)
        table.set_df(session.spark.read.parquet(f"{t.dir}/part.parquet").selectExpr("p_brand"))

    session.new_table("brands").cache(load)
    brands = session.get_table("brands").cache(load, ttl=3600)
    return brands.df.groupBy("p_brand").count().selectExpr("p_brand", "count AS n", f"{len(runs)} AS runs")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def database(t: Tables) -> Table:
    path = f"{_folder(t)}/x.db"
    one, other = Session(t.session.spark), Session(t.session.spark)
    for name in ("nation", "region"):
        one.new_table(name).set_df(t.session.spark.read.parquet(f"{t.dir}/{name}.parquet"))
    one.write_db(path)
    other.load_db(path)
    return other.get_table("nation").rename_columns({"n_regionkey": "r_regionkey"}).join(other.get_table("region"), type="inner").select_columns(["n_nationkey", "n_name", "r_name"])


@query("SELECT s_suppkey::DOUBLE AS s_suppkey, s_name, s_acctbal FROM supplier")
def database_sqlite(t: Tables) -> Table:
    path = f"{_folder(t)}/x.sqlite"
    one, other = Session(t.session.spark), Session(t.session.spark)
    one.new_table("supplier").set_df(t.session.spark.read.parquet(f"{t.dir}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal"))
    one.write_db(path)
    other.load_db(path)
    return other.get_table("supplier")


@query("SELECT 'n_nationkey,n_name' || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_name DESC) AS csv FROM nation")
def data_as_csv(t: Tables) -> DataFrame:
    text = t.nation.select_columns(["n_nationkey", "n_name"]).sort({"n_name": "desc"}).get_data_as_csv()
    return t.session.spark.createDataFrame([(text,)], "csv string")


# ---- the registry


@query("SELECT * FROM (VALUES ('all', 'customer,nation,part,region'), ('removed', 'customer,nation,region'), ('selected', 'nation,regions'), ('kept', 'nation')) AS x(step, tables)")
def registry(t: Tables) -> DataFrame:
    s = Session(t.session.spark)
    for name in ("customer", "nation", "part", "region"):
        s.new_table(name).set_df(t.session.spark.read.parquet(f"{t.dir}/{name}.parquet"))
    steps = [("all", s.get_table_names())]
    s.remove_tables("part")
    steps.append(("removed", s.get_table_names()))
    s.get_table("region").rename_table("regions")
    s.select_tables(["nation", "regions"])
    steps.append(("selected", sorted(x.name for x in s.get_tables())))
    regions = s.get_table("regions")
    regions.remove_table()
    assert not s.has_table("regions") and s.has_table("nation")
    steps.append(("kept", s.get_table_names()))
    s.push_table(regions)
    assert s.has_table(regions) and {e["name"] for e in s.get_extensions()} and s.start() is s
    out = t.session.spark.createDataFrame([(a, ",".join(b)) for a, b in steps], "step string, tables string")
    s.done()
    return out


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def clone_table(t: Tables) -> Table:
    c = t.customer
    copy = c.clone_table("rich", conditions="c_acctbal > 5000", columns=["c_custkey", "c_name"])
    assert c.get_nb_columns() == 5
    return copy


@query("SELECT * FROM nation")
def logging(t: Tables) -> Table:
    """Logs change nothing and show the table."""
    n = t.nation
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        n.log_table(3).log_bottom(2).log_description().log_projections().log_types().log_uniques("n_regionkey").log_columns().log_nb_rows().log_extent("n_nationkey")
        t.session.log_table_names()
    assert all(x in out.getvalue() for x in ("n_name", "25", "[0, 24]"))
    return n


# ---- getters


@query("""SELECT min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 2) AS mean, round(median(o_totalprice), 2) AS median, round(sum(o_totalprice), 1) AS total, round(skewness(o_totalprice), 4) AS skew,
round(stddev(o_totalprice), 2) AS deviation, round(variance(o_totalprice) / 1e6, 1) AS variance, round(quantile_cont(o_totalprice, 0.25), 2) AS quarter, count(*) AS n_rows, 6::BIGINT AS n_columns, 6 * count(*) AS n_values, sum(length(o_orderpriority))::BIGINT AS characters, min(o_orderdate) AS first FROM orders""")
def getters(t: Tables) -> DataFrame:
    o = t.orders
    extent = o.get_extent("o_totalprice")
    assert extent == [o.get_min("o_totalprice"), o.get_max("o_totalprice")]
    row = (
        *extent, o.get_mean("o_totalprice", decimals=2), o.get_median("o_totalprice", decimals=2), round(o.get_sum("o_totalprice"), 1), o.get_skew("o_totalprice", decimals=4), o.get_std_dev("o_totalprice", decimals=2), round(o.get_var("o_totalprice") / 1e6, 1),
        o.get_quantile("o_totalprice", 0.25, decimals=2), o.get_nb_rows(), o.get_nb_columns(), o.get_nb_values(), o.get_nb_characters("o_orderpriority"), o.get_min("o_orderdate"),
    )
    return t.session.spark.createDataFrame([row], "least double, most double, mean double, median double, total double, skew double, deviation double, variance double, quarter double, n_rows long, n_columns long, n_values long, characters long, first timestamp_ntz")


@query("""WITH n AS (SELECT n_name, n_nationkey FROM nation), o AS (SELECT *, row_number() OVER (ORDER BY n_name) AS i, count(*) OVER () AS all_ FROM n)
SELECT 'first' AS what, n_name, n_nationkey FROM o WHERE i = 1 UNION ALL SELECT 'last', n_name, n_nationkey FROM o WHERE i = all_ UNION ALL SELECT 'top', n_name, n_nationkey FROM o WHERE i <= 3
UNION ALL SELECT 'bottom', n_name, n_nationkey FROM o WHERE i > all_ - 3 UNION ALL SELECT 'one', n_name, n_nationkey FROM o WHERE n_nationkey = 7 UNION ALL SELECT 'some', n_name, n_nationkey FROM o WHERE n_nationkey < 2""")
def getters_of_rows(t: Tables) -> DataFrame:
    n = t.nation.select_columns(["n_name", "n_nationkey"]).sort({"n_name": "asc"})
    found = {"first": [n.get_first_row()], "last": [n.get_last_row()], "top": n.get_top(3), "bottom": n.get_bottom(3), "one": [n.get_row("n_nationkey = 7")], "some": n.get_data(conditions="n_nationkey < 2")}
    return t.session.spark.createDataFrame([(k, r["n_name"], r["n_nationkey"]) for k, rs in found.items() for r in rs], "what string, n_name string, n_nationkey int")


@query("""SELECT 'values' AS what, string_agg(n_regionkey, ',' ORDER BY n_nationkey) AS found FROM nation UNION ALL SELECT 'uniques', string_agg(DISTINCT n_regionkey, ',' ORDER BY n_regionkey) FROM nation
UNION ALL SELECT 'columns', 'n_nationkey,n_name,n_regionkey' UNION ALL SELECT 'types', 'int,string,int' UNION ALL SELECT 'schema', 'n_nationkey,n_name,n_regionkey' UNION ALL SELECT 'has', 'True,False'""")
def getters_of_columns(t: Tables) -> DataFrame:
    n = t.nation
    found = {
        "values": n.sort({"n_nationkey": "asc"}).get_values("n_regionkey"), "uniques": n.get_uniques("n_regionkey"), "columns": n.get_columns(), "types": n.get_types().values(), "schema": [x["column_name"] for x in n.get_schema()],
        "has": [n.has_column("n_name"), n.has_column("name")],
    }
    return t.session.spark.createDataFrame([(k, ",".join(map(str, v))) for k, v in found.items()], "what string, found string")


@query("SELECT 100::BIGINT AS rows, 100::BIGINT AS keys, true AS same, count(*) // 10 AS tenth FROM orders")
def sample_size(t: Tables) -> DataFrame:
    """As many rows as asked for, each of the table and only once, the same for the same seed."""
    one, other = t.orders.sample(100, seed=3), t.orders.sample(100, seed=3)
    keys = [r["o_orderkey"] for r in one.semi_join(t.orders, "o_orderkey").get_data()]
    same = sorted(keys) == sorted(other.get_values("o_orderkey"))
    return t.session.spark.createDataFrame([(len(keys), len(set(keys)), same, t.orders.sample("10%").get_nb_rows())], "rows long, keys long, same boolean, tenth long")
