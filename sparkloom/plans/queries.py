"""Queries over the driver's tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.exprs import rounded
from sparkloom.operators import aggregate, analytic, joins, rows
from sparkloom.session import Session
from sparkloom.table import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a directory, loaded when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.session, self.dir = Session(spark), sf_dir

    def __getattr__(self, name: str) -> Table:
        return self.session.new_table().set_df(self.session.spark.read.parquet(f"{self.dir}/{name}.parquet"))

    def named(self, name: str) -> Table:
        return self.session.new_table(name).set_df(self.session.spark.read.parquet(f"{self.dir}/{name}.parquet"))


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], Any]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.df if isinstance(out, Table) else out

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _each(values: list[str], stats: str, rest: str) -> str:
    """The long form of a summary: one SELECT a value."""
    return " UNION ALL ".join(f"SELECT '{v}' AS value, {stats.replace('$', v)} {rest}" for v in values)


# ---- aggregation


@query(_each(["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag, l_linestatus, count(*)::INTEGER AS count, min($) AS min, max($) AS max, round(avg($), 2) AS mean, round(sum($), 2) AS sum", "FROM lineitem GROUP BY l_returnflag, l_linestatus"))
def flagship_summarize(t: Tables) -> Table:
    return t.lineitem.summarize(values=["l_quantity", "l_extendedprice", "l_discount"], categories=["l_returnflag", "l_linestatus"], summaries=["count", "min", "max", "mean", "sum"], decimals=2)


@query(_each(["l_quantity", "l_tax"], "l_returnflag, count(*)::INTEGER AS count, count(DISTINCT $)::INTEGER AS \"countUnique\", count_if($ IS NULL)::INTEGER AS \"countNull\", min($) AS min, max($) AS max, round(avg($), 3) AS mean, round(median($), 3) AS median, round(sum($), 3) AS sum, round(skewness($), 3) AS skew, round(stddev($), 3) AS \"stdDev\", round(variance($), 3) AS var", "FROM lineitem GROUP BY l_returnflag"))
def summarize_all(t: Tables) -> Table:
    return t.lineitem.summarize(values=["l_quantity", "l_tax"], categories="l_returnflag", decimals=3)


@query("SELECT l_shipmode_like AS kind, count(*)::INTEGER AS count FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY 1")
def summarize_rows(t: Tables) -> Table:
    return t.lineitem.concatenate(["l_returnflag", "l_linestatus"], "kind").select_columns("kind").summarize(categories="kind", summaries="count")


@query("SELECT 'o_orderdate' AS value, o_orderstatus, min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT o_orderdate)::INTEGER AS days FROM orders GROUP BY o_orderstatus")
def summarize_dates(t: Tables) -> Table:
    return t.orders.summarize(values="o_orderdate", categories="o_orderstatus", summaries={"first": "min", "last": "max", "days": "countUnique"})


@query("SELECT column_name AS value, n::INTEGER AS count, u::INTEGER AS \"countUnique\", 0::INTEGER AS \"countNull\" FROM (SELECT 'c_acctbal' AS column_name, count(*) AS n, count(DISTINCT c_acctbal) AS u FROM customer UNION ALL SELECT 'c_custkey', count(*), count(DISTINCT c_custkey) FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'c_name', count(*), count(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(DISTINCT c_nationkey) FROM customer)")
def description(t: Tables) -> Table:
    c = t.customer
    return c.summarize(values=c.get_columns(), summaries=["count", "countUnique", "countNull"])


@query("""SELECT l_returnflag, 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY ALL
UNION ALL SELECT l_returnflag, 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem GROUP BY ALL
UNION ALL SELECT l_returnflag, 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem GROUP BY ALL""")
def correlations(t: Tables) -> Table:
    return t.lineitem.select_columns(["l_returnflag", "l_quantity", "l_extendedprice", "l_discount"]).correlations(categories="l_returnflag", decimals=6)


@query("""SELECT 'p_size' AS x, 'p_retailprice' AS y, round(regr_slope(p_retailprice, p_size), 5) AS slope, round(regr_intercept(p_retailprice, p_size), 5) AS "yIntercept", round(regr_r2(p_retailprice, p_size), 7) AS r2 FROM part
UNION ALL SELECT 'p_retailprice', 'p_size', round(regr_slope(p_size, p_retailprice), 5), round(regr_intercept(p_size, p_retailprice), 5), round(regr_r2(p_size, p_retailprice), 7) FROM part""")
def linear_regressions(t: Tables) -> DataFrame:
    out = aggregate.linear_regressions(t.part.select_columns(["p_size", "p_retailprice"]).df)
    return out.select("x", "y", rounded(F.col("slope"), 5).alias("slope"), rounded(F.col("yIntercept"), 5).alias("yIntercept"), rounded(F.col("r2"), 7).alias("r2"))


@query("SELECT round(quantile_cont(o_totalprice, 0.1), 2) AS p10, round(quantile_cont(o_totalprice, 0.5), 2) AS p50, round(quantile_cont(o_totalprice, 0.9), 2) AS p90 FROM orders")
def quantile(t: Tables) -> DataFrame:
    q = analytic.exact_quantiles(t.orders.df, "o_totalprice", [0.1, 0.5, 0.9])
    return t.session.spark.createDataFrame([tuple(q)], "p10 double, p50 double, p90 double").select(*[rounded(F.col(c), 2).alias(c) for c in ("p10", "p50", "p90")])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t: Tables) -> DataFrame:
    return aggregate.cube(t.lineitem.df, ["l_returnflag", "l_linestatus"], {"n": "count(*)", "quantity": "round(sum(l_quantity), 2)"})


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(t: Tables) -> DataFrame:
    return aggregate.cube(t.orders.df, ["o_orderstatus", "o_orderpriority"], {"n": "count(*)"}, how="rollup")


# ---- rows


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def filter_rows(t: Tables) -> Table:
    return t.orders.filter("o_totalprice > 200000 && o_orderstatus === 'O'").select_columns(["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderpriority = '5-LOW' OR o_totalprice < 100000)")
def remove_rows(t: Tables) -> Table:
    return t.orders.remove_rows("o_orderpriority == '5-LOW' || o_totalprice < 100000").select_columns("o_orderkey")


@query("SELECT * FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') AND c_nationkey IN (3)")
def keep_values(t: Tables) -> Table:
    return t.customer.keep({"c_mktsegment": ["MACHINERY", "FURNITURE"], "c_nationkey": 3})


@query("SELECT * FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE') AND c_nationkey NOT IN (3)")
def remove_values(t: Tables) -> Table:
    return t.customer.remove({"c_mktsegment": ["MACHINERY", "FURNITURE"], "c_nationkey": 3})


_HOLES = "SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS event_type FROM events"


def _holes(t: Tables) -> Table:
    e = t.events.select_columns(["event_id", "user_id", "value", "event_type"])
    return e.update_column("value", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END").update_column("event_type", "CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END")


@query(f"SELECT * FROM ({_HOLES}) WHERE value IS NOT NULL AND event_type <> ''")
def remove_missing(t: Tables) -> Table:
    return _holes(t).remove_missing()


@query(f"SELECT * FROM ({_HOLES}) WHERE NOT (value IS NOT NULL AND event_type <> '')")
def keep_missing(t: Tables) -> Table:
    return _holes(t).remove_missing(invert=True)


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_on(t: Tables) -> Table:
    return t.events.select_columns(["event_id", "user_id", "event_type"]).sort({"event_id": "asc"}).remove_duplicates(["user_id", "event_type"])


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def dedup_rows(t: Tables) -> Table:
    return t.lineitem.select_columns(["l_partkey", "l_suppkey"]).remove_duplicates()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 50")
def select_rows(t: Tables) -> Table:
    return t.orders.select_columns(["o_orderkey", "o_totalprice"]).sort({"o_totalprice": "desc", "o_orderkey": "asc"}).select_rows(100, offset=50)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 500")
def skip_rows(t: Tables) -> Table:
    return t.orders.select_columns("o_orderkey").sort({"o_orderkey": "asc"}).skip(500)


@query("SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_k(t: Tables) -> DataFrame:
    return rows.top_k(t.part.df, {"p_retailprice": "desc", "p_partkey": "asc"}, 25)


@query("SELECT c_custkey, c_nationkey, (row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) - 1) AS place FROM customer")
def sort_number(t: Tables) -> Table:
    return t.customer.select_columns(["c_custkey", "c_nationkey"]).sort({"c_nationkey": "desc", "c_custkey": "asc"}).add_row_number("place")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS nth FROM orders")
def row_number_by(t: Tables) -> Table:
    return t.orders.select_columns(["o_orderkey", "o_custkey"]).sort({"o_orderkey": "asc"}).add_row_number("nth", categories="o_custkey").remove_columns("o_custkey")


@query()
def sample_rows(t: Tables) -> Table:
    return t.orders.sample(100, seed=7)


@query("SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def insert_tables(t: Tables) -> Table:
    c = t.customer.select_columns(["c_custkey", "c_name"]).rename_columns({"c_custkey": "key", "c_name": "name"})
    return t.supplier.select_columns(["s_suppkey", "s_name"]).rename_columns({"s_suppkey": "key", "s_name": "name"}).insert_tables(c)


@query("SELECT s_suppkey AS key, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def insert_tables_unify(t: Tables) -> Table:
    c = t.customer.select_columns(["c_custkey", "c_mktsegment"]).rename_columns({"c_custkey": "key", "c_mktsegment": "segment"})
    return t.supplier.select_columns(["s_suppkey", "s_name"]).rename_columns({"s_suppkey": "key", "s_name": "name"}).insert_tables(c, unify_columns=True)


@query("SELECT * FROM region UNION ALL SELECT 9, 'ATLANTIS'")
def insert_rows(t: Tables) -> Table:
    return t.region.insert_rows([{"r_regionkey": 9, "r_name": "ATLANTIS"}])


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t: Tables) -> DataFrame:
    return rows.intersect(t.customer.df.select(F.col("c_nationkey").alias("k")), t.supplier.df.select(F.col("s_nationkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def except_rows(t: Tables) -> DataFrame:
    return rows.difference(t.customer.df.select(F.col("c_custkey").alias("k")), t.orders.filter("o_totalprice > 400000").df.select(F.col("o_custkey").alias("k")))


# ---- columns


@query("SELECT p_partkey AS \"partKey\", p_name AS \"theName\", p_name AS copy, (p_size * 2 + 1)::INTEGER AS twice, round(p_retailprice * 1.1, 4) AS price FROM part")
def columns(t: Tables) -> Table:
    p = t.part.select_columns(["p_partkey", "p_name", "p_size", "p_retailprice"]).add_column("twice", "integer", "p_size * 2 + 1").update_column("p_retailprice", "round(p_retailprice * 1.1, 4)")
    return p.clone_column("p_name", "copy").rename_columns({"p_partkey": "part key", "p_name": "the-name", "p_retailprice": "price"}).clean_column_names().remove_columns("pSize")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, epoch_ms(o_orderdate)::DOUBLE AS ms, o_totalprice::BIGINT AS price, o_orderkey::VARCHAR AS key FROM orders")
def convert(t: Tables) -> Table:
    o = t.orders.select_columns(["o_orderkey", "o_orderdate", "o_totalprice"]).clone_column("o_orderdate", "ms").clone_column("o_orderkey", "key")
    o.convert({"o_orderdate": "string"}, datetime_format="%d/%m/%Y").convert({"ms": "double", "o_totalprice": "bigint", "key": "string"})
    return o.rename_columns({"o_orderdate": "day", "o_totalprice": "price"})


@query("SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%d.%m.%y'), '%d.%m.%y') AS TIMESTAMP) AS day FROM orders")
def convert_text_to_date(t: Tables) -> Table:
    o = t.orders.select_columns(["o_orderkey", "o_orderdate"]).rename_columns({"o_orderdate": "day"})
    return o.convert({"day": "string"}, datetime_format="%d.%m.%y").convert({"day": "datetime"}, datetime_format="%d.%m.%y")


# ---- shape


@query("SELECT l_orderkey, l_linenumber, name, amount FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT INCLUDE NULLS (amount FOR name IN (l_quantity, l_discount, l_tax))")
def longer(t: Tables) -> Table:
    return t.lineitem.select_columns(["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]).longer(["l_quantity", "l_discount", "l_tax"], "name", "amount")


@query("""SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F", round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O", round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS "P" FROM orders GROUP BY o_orderpriority""")
def wider(t: Tables) -> Table:
    return t.orders.select_columns(["o_orderpriority", "o_orderstatus", "o_totalprice"]).wider("o_orderstatus", "o_totalprice").round(["F", "O", "P"], decimals=2)


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS n_name FROM nation GROUP BY n_regionkey")
def nest(t: Tables) -> Table:
    return t.nation.select_columns(["n_regionkey", "n_name"]).sort({"n_name": "asc"}).nest("n_name", ", ", "n_regionkey")


@query("SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS word FROM part")
def unnest(t: Tables) -> Table:
    return t.part.select_columns(["p_partkey", "p_name"]).unnest("p_name", " ").rename_columns({"p_name": "word"})


@query("SELECT l_orderkey, l_linenumber, unnest(range(l_linenumber)) AS i FROM lineitem")
def repeat_rows(t: Tables) -> Table:
    return t.lineitem.select_columns(["l_orderkey", "l_linenumber"]).repeat_rows("l_linenumber", index="i")


# ---- windows


@query("SELECT p_partkey, p_retailprice, rank() OVER (ORDER BY p_retailprice DESC) AS place FROM part")
def ranks(t: Tables) -> Table:
    return t.part.select_columns(["p_partkey", "p_retailprice"]).ranks("p_retailprice", "place", order="desc")


@query("SELECT p_partkey, p_brand, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS place FROM part")
def dense_ranks(t: Tables) -> Table:
    return t.part.select_columns(["p_partkey", "p_brand", "p_size"]).ranks("p_size", "place", categories="p_brand", no_gaps=True)


@query("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_totalprice, o_orderkey) AS q FROM orders")
def ntile(t: Tables) -> Table:
    return t.orders.select_columns(["o_orderkey", "o_totalprice"]).sort({"o_orderkey": "asc"}).quantiles("o_totalprice", 7, "q").remove_columns("o_totalprice")


@query("SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS q FROM orders")
def ntile_by(t: Tables) -> Table:
    return t.orders.select_columns(["o_orderkey", "o_orderstatus", "o_totalprice"]).sort({"o_orderkey": "asc"}).quantiles("o_totalprice", 4, "q", categories="o_orderstatus").select_columns(["o_orderkey", "q"])


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 2) AS total FROM events")
def accumulate(t: Tables) -> Table:
    return t.events.select_columns(["event_id", "value"]).sort({"event_id": "asc"}).accumulate("value", "total").round("total", decimals=2).remove_columns("value")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 2) AS total FROM events")
def accumulate_by(t: Tables) -> Table:
    return t.events.select_columns(["event_id", "user_id", "value"]).sort({"event_id": "asc"}).accumulate("value", "total", categories="user_id").round("total", decimals=2).select_columns(["event_id", "total"])


_FRAME = "SELECT event_id, CASE WHEN count(value) OVER w = 7 THEN round({}(value) OVER w, {}) END AS r FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(_FRAME.format("avg", 4))
def rolling_mean(t: Tables) -> Table:
    return t.events.select_columns(["event_id", "value"]).sort({"event_id": "asc"}).rolling("value", "r", "mean", 3, 3, decimals=4).remove_columns("value")


@query(_FRAME.format("median", 4))
def rolling_median(t: Tables) -> Table:
    return t.events.select_columns(["event_id", "value"]).sort({"event_id": "asc"}).rolling("value", "r", "median", 3, 3, decimals=4).remove_columns("value")


@query("SELECT event_id, CASE WHEN count(value) OVER w = 3 THEN max(value) OVER w END AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_max_by(t: Tables) -> Table:
    return t.events.select_columns(["event_id", "user_id", "value"]).sort({"event_id": "asc"}).rolling("value", "r", "max", 2, 0, categories="user_id").select_columns(["event_id", "r"])


@query("SELECT event_id, lead(value) OVER (ORDER BY event_id) AS following, lead(value, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS own FROM events")
def lead(t: Tables) -> Table:
    e = t.events.select_columns(["event_id", "user_id", "value"]).sort({"event_id": "asc"}).clone_column_with_offset("value", "following")
    return e.clone_column_with_offset("value", "own", offset=2, categories="user_id").select_columns(["event_id", "following", "own"])


@query(f"SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id) AS value FROM ({_HOLES})")
def fill_forward(t: Tables) -> Table:
    return _holes(t).sort({"event_id": "asc"}).fill("value").select_columns(["event_id", "value"])


@query(f"SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS value FROM ({_HOLES})")
def fill_forward_by(t: Tables) -> Table:
    return _holes(t).sort({"event_id": "asc"}).fill("value", categories="user_id").select_columns(["event_id", "value"])


@query(f"""WITH e AS ({_HOLES}), k AS (
  SELECT *, last_value(CASE WHEN value IS NOT NULL THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id) AS a, first_value(CASE WHEN value IS NOT NULL THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e),
p AS (SELECT k.event_id, k.value, coalesce(k.a, 1) AS x0, CASE WHEN k.a IS NULL THEN 2 ELSE k.b END AS x1, k.a, k.b FROM k),
q AS (SELECT p.*, CASE WHEN b IS NULL THEN (SELECT max(event_id) FROM e WHERE value IS NOT NULL AND event_id < p.a) ELSE x0 END AS l, CASE WHEN b IS NULL THEN a ELSE x1 END AS r FROM p)
SELECT q.event_id, round(coalesce(q.value, u.value + (v.value - u.value) * (q.event_id - q.l)::DOUBLE / (q.r - q.l)), 6) AS value FROM q JOIN e u ON u.event_id = q.l JOIN e v ON v.event_id = q.r""")
def fill_interpolate(t: Tables) -> Table:
    return _holes(t).sort({"event_id": "asc"}).fill("value", interpolate=True).select_columns(["event_id", "value"]).round("value", decimals=6)


@query("SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (), 8) AS share, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_mktsegment), 8) AS own FROM customer")
def proportions_vertical(t: Tables) -> Table:
    c = t.customer.proportions_vertical("c_acctbal", "share", decimals=8).proportions_vertical("c_acctbal", "own", categories="c_mktsegment", decimals=8)
    return c.select_columns(["c_custkey", "share", "own"])


@query('SELECT l_orderkey, l_linenumber, round(l_discount / nullif(0.0 + l_discount + l_tax + l_quantity, 0), 6) AS "l_discountPerc", round(l_tax / nullif(0.0 + l_discount + l_tax + l_quantity, 0), 6) AS "l_taxPerc", round(l_quantity / nullif(0.0 + l_discount + l_tax + l_quantity, 0), 6) AS "l_quantityPerc" FROM lineitem')
def proportions_horizontal(t: Tables) -> Table:
    return t.lineitem.proportions_horizontal(["l_discount", "l_tax", "l_quantity"], decimals=6).select_columns(["l_orderkey", "l_linenumber", "l_discountPerc", "l_taxPerc", "l_quantityPerc"])


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 6) AS own FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def z_score(t: Tables) -> Table:
    return t.customer.z_score("c_acctbal", "z", decimals=6).z_score("c_acctbal", "own", categories="c_mktsegment", decimals=6).select_columns(["c_custkey", "z", "own"])


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS n, round((c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 6) AS own FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def normalize(t: Tables) -> Table:
    return t.customer.normalize("c_acctbal", "n", decimals=6).normalize("c_acctbal", "own", categories="c_nationkey", decimals=6).select_columns(["c_custkey", "n", "own"])


@query("""WITH e AS (SELECT event_id, event_type, value * value AS v, count(*) OVER () AS n FROM events), b AS (SELECT event_type, CASE WHEN any_value(n) % 2 = 0 THEN quantile_disc(v, 0.25) ELSE quantile_cont(v, 0.25) END AS q1, CASE WHEN any_value(n) % 2 = 0 THEN quantile_disc(v, 0.75) ELSE quantile_cont(v, 0.75) END AS q3 FROM e GROUP BY event_type)
SELECT event_id, coalesce(v > q3 + 1.5 * (q3 - q1) OR v < q1 - 1.5 * (q3 - q1), false) AS far FROM e JOIN b USING (event_type)""")
def outliers_iqr(t: Tables) -> Table:
    return t.events.add_column("v", "double", "value * value").outliers_iqr("v", "far", categories="event_type").select_columns(["event_id", "far"])


@query("WITH b AS (SELECT CASE WHEN count(*) % 2 = 0 THEN quantile_disc(v, 0.25) ELSE quantile_cont(v, 0.25) END AS q1, CASE WHEN count(*) % 2 = 0 THEN quantile_disc(v, 0.75) ELSE quantile_cont(v, 0.75) END AS q3 FROM (SELECT value * value AS v FROM events)) SELECT event_id, value * value > q3 + 1.5 * (q3 - q1) OR value * value < q1 - 1.5 * (q3 - q1) AS far FROM events, b")
def outliers_iqr_whole(t: Tables) -> Table:
    return t.events.add_column("v", "double", "value * value").outliers_iqr("v", "far").select_columns(["event_id", "far"])


@query("SELECT p_partkey, '[' || (1 + 10 * ((p_size - 1) // 10))::VARCHAR || '-' || (10 + 10 * ((p_size - 1) // 10))::VARCHAR || ']' AS bin FROM part")
def bins(t: Tables) -> Table:
    return t.part.bins("p_size", 10, "bin", start_value=1).select_columns(["p_partkey", "bin"])


# ---- joins


def _customers(t: Tables) -> tuple[Table, Table]:
    """Whole tables; the keys of some rows become ones that the other side lacks."""
    c = t.customer.select_columns(["c_custkey", "c_mktsegment"]).rename_columns({"c_custkey": "custkey"}).update_column("custkey", "CASE WHEN custkey % 3 = 0 THEN -2 * custkey - 1 ELSE custkey END")
    return t.orders.select_columns(["o_orderkey", "o_custkey"]).rename_columns({"o_custkey": "custkey"}).update_column("custkey", "CASE WHEN custkey % 5 = 0 THEN -2 * custkey ELSE custkey END"), c


_JOIN = "SELECT o_orderkey, o.custkey AS custkey, c_mktsegment FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN -2 * o_custkey ELSE o_custkey END AS custkey FROM orders) o {} JOIN (SELECT CASE WHEN c_custkey % 3 = 0 THEN -2 * c_custkey - 1 ELSE c_custkey END AS custkey, c_mktsegment FROM customer) c ON o.custkey = c.custkey"


@query(_JOIN.format("INNER"))
def join_inner(t: Tables) -> Table:
    o, c = _customers(t)
    return o.join(c, type="inner")


@query(_JOIN.format("LEFT"))
def join_left(t: Tables) -> Table:
    o, c = _customers(t)
    return o.join(c)


@query(_JOIN.format("RIGHT"))
def join_right(t: Tables) -> Table:
    o, c = _customers(t)
    return o.join(c, type="right")


@query(_JOIN.format("FULL"))
def join_full(t: Tables) -> Table:
    o, c = _customers(t)
    return o.join(c, common_column="custkey", type="full")


@query("SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_chain(t: Tables) -> DataFrame:
    o = t.orders.rename_columns({"o_custkey": "c_custkey"}).join(t.customer, type="inner").rename_columns({"c_nationkey": "n_nationkey"}).join(t.nation, type="inner")
    o = o.rename_columns({"n_regionkey": "r_regionkey"}).join(t.region, type="inner")
    return o.df.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation CROSS JOIN region")
def cross_join(t: Tables) -> Table:
    return t.nation.cross_join(t.region)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def semi_join(t: Tables) -> Table:
    return t.customer.semi_join(t.orders.filter("o_totalprice > 450000").rename_columns({"o_custkey": "c_custkey"}), "c_custkey").select_columns("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def anti_join(t: Tables) -> Table:
    return t.customer.semi_join(t.orders.filter("o_totalprice > 450000").rename_columns({"o_custkey": "c_custkey"}), "c_custkey", anti=True).select_columns("c_custkey")


@query("""WITH e AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts, max(value) AS paid FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT event_id, user_id, paid FROM e ASOF LEFT JOIN p USING (user_id, ts)""")
def as_of_join(t: Tables) -> Table:
    clicks = t.events.filter("event_type = 'click'").select_columns(["user_id", "ts", "value"]).rename_columns({"value": "paid"})
    return t.events.filter("event_type = 'error'").select_columns(["event_id", "ts", "user_id"]).as_of_join(clicks, "ts", on="user_id").remove_columns("ts")


@query("SELECT e.event_id, s.s_suppkey FROM events e JOIN supplier s ON e.value * 100 >= s.s_acctbal AND e.value * 100 < s.s_acctbal + 50")
def range_join(t: Tables) -> DataFrame:
    left = t.events.select_columns(["event_id", "value"]).df.withColumn("v", F.col("value") * 100)
    right = t.supplier.select_columns(["s_suppkey", "s_acctbal"]).df.withColumn("hi", F.col("s_acctbal") + 50)
    return joins.range_join(left, right, "v", "s_acctbal", "hi", 50.0).select("event_id", "s_suppkey")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000 AND c_nationkey <> 3 GROUP BY c_mktsegment HAVING count(*) > 5")
def custom_query(t: Tables) -> DataFrame:
    t.named("customer")
    return t.session.sql('SELECT "c_mktsegment", count(*) AS n FROM customer WHERE c_acctbal > 1000 && c_nationkey !== 3 GROUP BY c_mktsegment HAVING count(*) > 5')


# ---- texts


@query("SELECT c_custkey, lower(c_name) AS low, upper(c_name) AS up, upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) AS cap, left(c_name, 4) AS l, right(c_name, 3) AS r, lpad(c_custkey::VARCHAR, 12, '0') AS pad, trim(c_name, 'C0') AS t FROM customer")
def texts(t: Tables) -> Table:
    c = t.customer.select_columns(["c_custkey", "c_name", "c_mktsegment"])
    for n in ("low", "up", "l", "r", "t"):
        c.clone_column("c_name", n)
    c.clone_column("c_mktsegment", "cap").clone_column("c_custkey", "pad").convert({"pad": "string"})
    return c.lower("low").upper("up").capitalize("cap").truncate("l", 4).right("r", 3).pad("pad", 12).trim("t", character="C0").remove_columns(["c_name", "c_mktsegment"])


@query("SELECT o_orderkey, replace(replace(o_orderpriority, '-', ': '), 'LOW', 'low') AS a, regexp_replace(o_orderpriority, '([0-9])-([A-Z]+)', '\\2/\\1', 'g') AS b, CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' ELSE o_orderpriority END AS c FROM orders")
def replace(t: Tables) -> Table:
    o = t.orders.select_columns(["o_orderkey", "o_orderpriority"]).clone_column("o_orderpriority", "a").clone_column("o_orderpriority", "b").clone_column("o_orderpriority", "c").remove_columns("o_orderpriority")
    return o.replace("a", {"-": ": ", "LOW": "low"}).replace("b", {"([0-9])-([A-Z]+)": r"\2/\1"}, regex=True).replace("c", {"1-URGENT": "now"}, entire_string=True)


@query(f"SELECT event_id, coalesce(value, -1) AS value, concat_ws('|', user_id, value, event_type) AS joined FROM ({_HOLES.replace('value END', 'round(value * 100)::BIGINT END')})")
def nulls_and_concatenation(t: Tables) -> Table:
    e = _holes(t).update_column("value", "round(value * 100)").convert({"value": "bigint"}).concatenate(["user_id", "value", "event_type"], "joined", separator="|")
    return e.replace_nulls("value", -1).select_columns(["event_id", "value", "joined"])


@query("SELECT p_partkey, 'p_name:' || chr(10) || p_name || chr(10) || chr(10) || 'p_type:' || chr(10) || p_type AS block FROM part")
def concatenate_row(t: Tables) -> Table:
    return t.part.concatenate_row(["p_name", "p_type"], "block").select_columns(["p_partkey", "block"])


@query("SELECT p_partkey, split_part(p_name, ' ', 2) AS noun, split_part(p_brand, '#', 1) AS a, split_part(p_brand, '#', 2) AS b FROM part")
def split(t: Tables) -> Table:
    return t.part.split_extract("p_name", " ", 1, "noun").split_spread("p_brand", "#", ["a", "b"]).select_columns(["p_partkey", "noun", "a", "b"])


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents")
def normalize_string(t: Tables) -> Table:
    return t.documents.normalize_string("text", "clean").select_columns(["doc_id", "clean"])


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 1) AS a, ceil(l_extendedprice / 7) AS b, floor(l_extendedprice / 7) AS c FROM lineitem")
def round_columns(t: Tables) -> Table:
    x = t.lineitem.add_column("a", "double", "l_extendedprice / 7").select_columns(["l_orderkey", "l_linenumber", "a"]).clone_column("a", "b").clone_column("a", "c")
    return x.round("a", decimals=1).round("b", method="ceiling").round("c", method="floor")


# ---- search


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(strip_accents(text)), '(\\.|[^a-z])+', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS term FROM documents),
s AS (SELECT doc_id, count(*) AS len FROM w GROUP BY doc_id), st AS (SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n, (SELECT sum(len) FROM s)::DOUBLE / (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS avg),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('licensed', 'apache', 'version') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS score FROM tf JOIN df USING (term) JOIN s USING (doc_id) CROSS JOIN st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def bm25(t: Tables) -> Table:
    return t.documents.bm25("Licensed Apache version", "doc_id", "text", 20, score_column="score", stemmer="none", stopwords="none").select_columns(["doc_id", "score"]).round("score", decimals=6)


_VECTOR = [round(((i * 37) % 17 - 8) / 10, 1) for i in range(64)]


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]) DESC LIMIT 10")
def cosine_topk(t: Tables) -> Table:
    return t.embeddings.nearest("embedding", _VECTOR, 10).select_columns(["vec_id", "similarity"]).round("similarity", decimals=6)


def _lcs(a: str, b: str) -> str:
    """SQL for the length of the longest common subsequence: a row of the table of cells for each character of the first text."""
    masks = f"list_transform(string_split({a}, ''), lambda c: list_transform(string_split({b}, ''), lambda x: CASE WHEN x = c THEN 1 ELSE 0 END))"
    cell = "greatest(s[i + 1], CASE WHEN m[i] = 1 THEN s[i] + 1 ELSE 0 END)"
    row = f"list_concat([0], list_transform(range(1, len(s)), lambda j: list_max(list_transform(range(1, j + 1), lambda i: {cell}))))"
    return f"list_reduce(list_concat([list_transform(range(length({b}) + 1), lambda z: 0)], {masks}), lambda s, m: {row})[-1]"


def _ratio(a: str, b: str) -> str:
    return f"200.0::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b}))"


@query(f"""WITH RECURSIVE c AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY p_name), p AS MATERIALIZED (SELECT * FROM (SELECT x.v AS a, y.v AS b, {_ratio("x.v", "y.v")} AS s FROM c x JOIN c y ON x.v < y.v) WHERE s >= 75),
e AS (SELECT a, b, s FROM p UNION ALL SELECT b, a, s FROM p), r AS (SELECT v, v AS o FROM c UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.o), g AS (SELECT v, min(o) AS root FROM r GROUP BY v),
t AS (SELECT a AS v, sum(s) AS total FROM e GROUP BY a), f AS (SELECT g.v, first_value(g.v) OVER (PARTITION BY root ORDER BY n DESC, coalesce(total, 0) DESC, g.v) AS clean FROM g JOIN c USING (v) LEFT JOIN t USING (v))
SELECT p_partkey, p_name, clean FROM part JOIN f ON p_name = v""")
def fuzzy_clean(t: Tables) -> Table:
    return t.part.select_columns(["p_partkey", "p_name"]).fuzzy_clean("p_name", "clean", 75)


@query(f"WITH p AS (SELECT DISTINCT p_name FROM part), s AS (SELECT a.p_name, b.p_name || 's' AS other, round({_ratio('a.p_name', "(b.p_name || 's')")}, 2) AS score FROM p a, p b) SELECT p.p_name, s.other, s.score FROM p LEFT JOIN s ON s.p_name = p.p_name AND s.score >= 90")
def fuzzy_join(t: Tables) -> Table:
    p = t.part.select_columns("p_name").remove_duplicates()
    q = p.clone_table().rename_columns({"p_name": "other"}).update_column("other", "concat(other, 's')")
    return p.fuzzy_join(q, "p_name", "other", 90, similarity_column="score")


_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"


@query(f"WITH p AS (SELECT DISTINCT p_name, {_SORTED.format('p_name')} AS k FROM part), s AS (SELECT a.p_name, b.p_name AS other, round({_ratio('a.k', 'b.k')}, 2) AS score FROM p a, p b) SELECT p.p_name, s.other, s.score FROM p LEFT JOIN s ON s.p_name = p.p_name AND s.score >= 80")
def fuzzy_join_tokens(t: Tables) -> Table:
    """The words of the other side are turned round; sorted they are the same."""
    p = t.part.select_columns("p_name").remove_duplicates()
    q = p.clone_table().rename_columns({"p_name": "name"}).add_column("other", "string", "concat(split_part(name, ' ', 2), ' ', split_part(name, ' ', 1))")
    out = p.fuzzy_join(q.select_columns("other"), "p_name", "other", 80, method="token_sort_ratio", similarity_column="score")
    return out.update_column("other", "concat(split_part(other, ' ', 2), ' ', split_part(other, ' ', 1))")


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(strip_accents(text)), '(\\.|[^a-z])+', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS term FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS id, term, count(*) AS tf FROM w WHERE term IN ('apache', 'licensed', 'the', 'password') GROUP BY ALL""")
def text_index(t: Tables) -> DataFrame:
    d = t.documents.create_fts_index("doc_id", "text", stemmer="none", stopwords="none")
    return d.indexes["fts_text"].postings.where(F.col("term").isin("apache", "licensed", "the", "password")).select("id", "term", "tf")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS n FROM events")
def json_functions(t: Tables) -> DataFrame:
    t.named("events")
    return t.session.sql("SELECT event_id, get_json_object(props, '$.k') AS k, cast(size(json_object_keys(props)) AS bigint) AS n FROM events")


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 300000")
def map_in_pandas(t: Tables) -> Table:
    def f(batches: Any) -> Any:
        for b in batches:
            b = b[b["o_totalprice"] > 300000]
            yield b.assign(twice=b["o_totalprice"] * 2)[["o_orderkey", "twice"]]

    return t.orders.select_columns(["o_orderkey", "o_totalprice"]).map_in_pandas(f, "o_orderkey long, twice double")


# ---- whole tables in an order of their own, with all columns


_BY_PRICE = "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate"


def _by_price(t: Tables) -> Table:
    return t.lineitem.sort({"l_extendedprice": "desc", **dict.fromkeys(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"], "asc")})


@query(f"SELECT *, row_number() OVER ({_BY_PRICE}) - 1 AS place FROM lineitem")
def sorted_numbers(t: Tables) -> Table:
    return _by_price(t).add_row_number("place")


@query(f"SELECT *, sum(l_quantity) OVER ({_BY_PRICE} ROWS UNBOUNDED PRECEDING) AS total FROM lineitem")
def sorted_accumulate(t: Tables) -> Table:
    return _by_price(t).accumulate("l_quantity", "total")


@query(f"SELECT *, ntile(12) OVER ({_BY_PRICE.replace('l_extendedprice DESC', 'l_quantity, l_extendedprice DESC')}) AS q FROM lineitem")
def sorted_quantiles(t: Tables) -> Table:
    return _by_price(t).quantiles("l_quantity", 12, "q")


@query(f"SELECT *, CASE WHEN count(l_quantity) OVER w = 6 THEN sum(l_quantity) OVER w END AS r FROM lineitem WINDOW w AS ({_BY_PRICE} ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)")
def sorted_rolling(t: Tables) -> Table:
    return _by_price(t).rolling("l_quantity", "r", "sum", 2, 3)


@query(f"SELECT *, lead(l_shipdate, 2) OVER ({_BY_PRICE}) AS later FROM lineitem")
def sorted_lead(t: Tables) -> Table:
    return _by_price(t).clone_column_with_offset("l_shipdate", "later", offset=2)


@query(f"SELECT * EXCLUDE (gap), last_value(gap IGNORE NULLS) OVER ({_BY_PRICE} ROWS UNBOUNDED PRECEDING) AS gap FROM (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN l_tax END AS gap FROM lineitem)")
def sorted_fill(t: Tables) -> Table:
    return t.lineitem.add_column("gap", "double", "CASE WHEN l_orderkey % 3 = 0 THEN l_tax END").sort({"l_extendedprice": "desc", **dict.fromkeys(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"], "asc")}).fill("gap")


@query(f"SELECT * FROM lineitem {_BY_PRICE} OFFSET 1000")
def sorted_skip(t: Tables) -> Table:
    return _by_price(t).skip(1000)


@query("""WITH b AS (SELECT ts, max(event_id) AS seen FROM events WHERE event_type = 'click' GROUP BY ts), a AS (SELECT * FROM orders) SELECT a.*, b.seen FROM a ASOF LEFT JOIN b ON a.o_orderdate >= b.ts""")
def as_of_join_whole(t: Tables) -> DataFrame:
    clicks = t.events.filter("event_type = 'click'").df.groupBy("ts").agg(F.max("event_id").alias("seen"))
    right = t.session.new_table().set_df(clicks.withColumnRenamed("ts", "o_orderdate"))
    return t.orders.as_of_join(right, "o_orderdate").df


@query("SELECT o_orderkey, CASE WHEN v <= a + 0.4 + 1e-9 THEN '[' || regexp_replace(printf('%.1f', a), '[.]0$', '') || '-' || regexp_replace(printf('%.1f', a + 0.4), '[.]0$', '') || ']' END AS bin FROM (SELECT *, floor(v / 0.5 + 1e-9) * 0.5 AS a FROM (SELECT o_orderkey, round(o_totalprice / 1000, 2) AS v FROM orders))")
def bins_decimals(t: Tables) -> Table:
    """Bins of half a thousand; what lies between the last tenth of one and the next one has none."""
    return t.orders.add_column("v", "double", "o_totalprice / 1000").round("v", decimals=2).bins("v", 0.5, "bin", start_value=0).select_columns(["o_orderkey", "bin"])


# ---- geometry


@query("""SELECT c_custkey, round(2 * 6371000 * asin(sqrt(pow(sin(radians(45.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(45.5)) * pow(sin(radians(-73.5 - lon) / 2), 2))) / 1000, 3) AS km
FROM (SELECT c_custkey, c_custkey % 170 - 85 AS lat, c_custkey % 359 - 179 AS lon FROM customer)""")
def geo_distance(t: Tables) -> Table:
    c = t.customer.add_column("lat", "double", "c_custkey % 170 - 85").add_column("lon", "double", "c_custkey % 359 - 179").points("lat", "lon", "a")
    c.add_column("lat0", "double", "45.5").add_column("lon0", "double", "-73.5").points("lat0", "lon0", "b")
    return c.distance("a", "b", "km", method="haversine", unit="km", decimals=3).select_columns(["c_custkey", "km"])


@query("SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_acctbal % 100 BETWEEN n_nationkey * 3 AND n_nationkey * 3 + 5 AND c_custkey % 50 BETWEEN n_nationkey AND n_nationkey + 4")
def join_geo(t: Tables) -> Table:
    c = t.customer.add_column("x", "double", "c_acctbal % 100").add_column("y", "double", "c_custkey % 50").points("y", "x", "g").select_columns(["c_custkey", "g"])
    square = "concat('{\"type\":\"Polygon\",\"coordinates\":[[[',3*k,',',k,'],[',3*k+5,',',k,'],[',3*k+5,',',k+4,'],[',3*k,',',k+4,'],[',3*k,',',k,']]]}')"
    n = t.nation.df.selectExpr("n_nationkey", f"{square.replace('k', 'n_nationkey')} AS j")

    def encode(batches: Any) -> Any:
        import json

        from sparkloom.functions.geometry import to_wkb

        for b in batches:
            yield b.assign(h=[to_wkb(json.loads(x)) for x in b["j"]])[["n_nationkey", "h"]]

    squares = t.session.new_table().set_df(n.mapInPandas(encode, "n_nationkey int, h binary"))
    return c.join_geo(squares, "inside", type="inner").select_columns(["c_custkey", "n_nationkey"])


# ---- Python


@query("SELECT o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY o_orderstatus")
def apply_in_pandas(t: Tables) -> Table:
    import pandas as pd

    def f(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"o_orderstatus": [g["o_orderstatus"].iloc[0]], "n": [len(g)], "top": [round(g["o_totalprice"].max(), 2)]})

    return t.orders.select_columns(["o_orderstatus", "o_totalprice"]).apply_in_pandas("o_orderstatus", f, "o_orderstatus string, n long, top double")


@query("SELECT r_regionkey, lower(r_name) AS r_name FROM region")
def update_with_python(t: Tables) -> Table:
    return t.region.update_with_python(lambda data: [r | {"r_name": r["r_name"].lower()} for r in data]).convert({"r_regionkey": "integer"})


# the rest of the queries; they take ``query`` and ``Tables`` from here
from sparkloom.plans import geometry, inputs  # noqa: E402, F401
