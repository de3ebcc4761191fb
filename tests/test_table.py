import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sparkloom import Session
from sparkloom.functions.sqltext import rewrite
from sparkloom.operators import joins


@pytest.fixture
def db(spark):
    return Session(spark)


def table(db, rows):
    return db.new_table().load_array(rows)


def cols(data, *names):
    return [tuple(r[n] for n in names) for r in data]


MARKS = [{"name": n, "subject": s, "mark": m} for n, s, m in [("Isabella", "Maths", 50), ("Olivia", "Maths", 55), ("Lily", "Maths", 70), ("Isabella", "English", 90), ("Lily", "English", 70), ("Olivia", "English", 89), ("Isabella", "Science", 70), ("Olivia", "Science", 60), ("Lily", "Science", 80)]]


def test_registry(db):
    a, b = db.new_table(), db.new_table("b")
    assert db.get_table_names() == ["b", "table1"] and db.has_table("b") and db.get_table("b") is b
    with pytest.raises(ValueError):
        db.new_table("b")
    a.load_array([{"x": 1}])
    a.rename_table("c")
    db.select_tables("c")
    assert db.getTableNames() == ["c"]
    with pytest.raises(ValueError):
        db.get_table("b")
    db.remove_tables("all")
    assert db.get_tables() == []


def test_rewrite():
    assert rewrite("SELECT * FROM t WHERE a === 1 && b !== 'x && y' || c == null") == "SELECT * FROM t WHERE a = 1 AND b != 'x && y' OR c IS NULL"
    assert rewrite("""SELECT a || ' || ' || "b c" FROM t""") == "SELECT a || ' || ' || `b c` FROM t"
    assert rewrite("a != null", condition=True) == "a IS NOT NULL"
    assert rewrite("a = null", condition=True) == "a IS NULL"


def test_rows(db):
    t = table(db, [{"a": i, "b": "xy"[i % 2] if i < 4 else None} for i in range(6)])
    assert t.clone_table().filter("a > 1 && b === 'x'").get_values("a") == [2]
    assert t.clone_table().remove_rows("b = 'x'").get_values("a") == [1, 3, 4, 5]
    assert t.clone_table().keep({"b": ["x"], "a": [0, 1]}).get_values("a") == [0]
    assert t.clone_table().remove({"b": "x"}).get_values("a") == [1, 3]
    assert t.clone_table().remove_missing().get_values("a") == [0, 1, 2, 3]
    assert t.clone_table().remove_missing(invert=True).get_values("a") == [4, 5]
    assert t.clone_table().remove_missing("a", missing_values=[5]).get_values("a") == [0, 1, 2, 3, 4]
    assert t.clone_table().remove_duplicates("b").get_values("a") == [0, 1, 4]
    assert t.clone_table().select_rows(2, offset=1).get_values("a") == [1, 2]
    assert t.clone_table().select_rows("50%").get_values("a") == [0, 1, 2]
    assert t.clone_table().skip(4).get_values("a") == [4, 5]
    assert t.clone_table().sample(3, seed=1).get_values("a") == t.clone_table().sample(3, seed=1).get_values("a")
    assert t.clone_table().sample("50%").get_nb_rows() == 3
    assert t.clone_table().sort({"b": "desc", "a": "desc"}).get_values("a") == [3, 1, 2, 0, 5, 4]
    assert t.clone_table().sort({"b": "asc", "a": "asc"}).get_values("b") == ["x", "x", "y", "y", None, None]
    t.insert_rows([{"a": 9, "b": "z"}])
    assert t.get_values("a")[-1] == 9
    u = table(db, [{"a": 10, "b": "q"}])
    t.insert_tables([u, u])
    t.insert_tables(u)
    assert t.get_values("a")[-4:] == [9, 10, 10, 10] and t.get_nb_rows() == 10
    with pytest.raises(ValueError):
        t.insert_tables(table(db, [{"a": 1, "c": 1}]))
    assert t.insert_tables(table(db, [{"a": 1, "c": 1}]), unify_columns=True).get_row("c = 1")["b"] is None


def test_locale_sort(db):
    t = table(db, [{"k": x} for x in ["zebra", "éclair", "apple", "eclat"]])
    assert t.sort({"k": "asc"}, lang={"k": "fr"}).get_values("k") == ["apple", "éclair", "eclat", "zebra"]


def test_columns(db):
    t = table(db, [{"Hire date": "a", "End-of_year BONUS?": 1.4, "n.x": "1,234"}])
    assert t.clone_table().clean_column_names().get_columns() == ["hireDate", "endOfYearBonus", "nX"]
    t.rename_columns({"Hire date": "h", "End-of_year BONUS?": "b"})
    t.add_column("c", "integer", "b * 10").clone_column("c", "d").update_column("d", "d + 0.6")
    assert t.get_row("h = 'a'") == {"h": "a", "b": 1.4, "n.x": "1,234", "c": 14, "d": 14}
    t.convert({"n.x": "float"})
    assert t.get_values("n.x") == [1234.0]
    assert t.select_columns(["h", "n.x"]).remove_columns("h").get_columns() == ["n.x"]
    with pytest.raises(ValueError):
        t.select_columns("none")


def test_convert(db):
    t = table(db, [{"s": "2.5", "d": 2.5, "e": 3.5, "day": "2010-01-02", "t": "2010/01/02 03_04", "ms": 1262401440000.0}])
    got = t.clone_table().convert({"s": "integer", "d": "integer", "e": "bigint", "day": "date", "ms": "datetime"}).get_data()[0]
    assert (got["s"], got["d"], got["e"], got["day"], got["ms"]) == (3, 2, 4, dt.date(2010, 1, 2), dt.datetime(2010, 1, 2, 3, 4))
    t.convert({"t": "datetime"}, datetime_format="%Y/%m/%d %H_%M")
    assert t.get_values("t") == [dt.datetime(2010, 1, 2, 3, 4)]
    assert t.clone_table().convert({"t": "string"}, datetime_format="%d-%m-%Y").get_values("t") == ["02-01-2010"]
    assert t.clone_table().convert({"t": "string"}).get_values("t") == ["2010-01-02 03:04:00"]
    assert t.clone_table().convert({"t": "number"}).get_values("t") == [1262401440000.0]
    h = table(db, [{"x": "12:34:56.5"}]).convert({"x": "time"})
    assert h.get_values("x") == [dt.time(12, 34, 56, 500_000)] and h.convert({"x": "number"}).get_values("x") == [45_296_500]
    assert h.convert({"x": "time"}).get_values("x") == [dt.time(12, 34, 56, 500_000)]
    assert table(db, [{"x": "abc"}]).convert({"x": "float"}, try_=True).get_values("x") == [None]


def test_strings(db):
    t = table(db, [{"a": "  éB c ", "b": "x/y/z", "c": None}, {"a": "!!Hey!!", "b": "p/q/r", "c": "k"}])
    assert t.clone_table().trim("a").get_values("a") == ["éB c", "!!Hey!!"]
    assert t.clone_table().trim("a", character="! ", method="leftTrim").get_values("a") == ["éB c ", "Hey!!"]
    assert t.clone_table().upper("a").lower("a").get_values("a") == ["  éb c ", "!!hey!!"]
    assert t.clone_table().capitalize(["b", "c"]).get_values("c") == ["", "K"]
    assert t.clone_table().truncate("b", 2).get_values("b") == ["x/", "p/"] and t.clone_table().right("b", 1).get_values("b") == ["z", "r"]
    assert t.clone_table().pad("b", 7, character="*").get_values("b") == ["**x/y/z", "**p/q/r"]
    with pytest.raises(ValueError):
        t.clone_table().pad("b", 3)
    assert t.clone_table().replace("b", {"/": "-", "x-": "w"}).get_values("b") == ["wy-z", "p-q-r"]
    assert t.clone_table().replace("b", {"x/y/z": "all"}, entire_string=True).get_values("b") == ["all", "p/q/r"]
    assert t.clone_table().replace("b", {r"(\w)/(\w)": r"\2$\1"}, regex=True).get_values("b") == ["y$x/z", "q$p/r"]
    assert t.clone_table().replace_nulls("all", "none").get_values("c") == ["none", "k"]
    assert t.clone_table().concatenate(["b", "c"], "n", separator="+").get_values("n") == ["x/y/z", "p/q/r+k"]
    assert t.clone_table().concatenate_row(["b", "c"], "n").get_values("n")[0] == "b:\nx/y/z\n\nc:\nUnknown"
    assert t.clone_table().split_extract("b", "/", 1, "n").get_values("n") == ["y", "q"]
    assert t.clone_table().split_extract("b", "/", 7, "n").get_values("n") == ["", ""]
    assert cols(t.clone_table().split_spread("b", "/", ["i", "j", "k"]).get_data(), "i", "k") == [("x", "z"), ("p", "r")]
    with pytest.raises(ValueError):
        t.clone_table().split_spread("b", "/", ["i"])
    assert t.clone_table().normalize_string("a", "n").get_values("n") == ["eb c", "hey"]
    n = table(db, [{"x": 1.005}, {"x": -2.5}, {"x": None}, {"x": 7.0}])
    assert n.clone_table().round("x", decimals=2).get_values("x") == [1.0, -2.5, None, 7.0]
    assert n.clone_table().round("x", method="ceiling").get_values("x") == [2.0, -2.0, None, 7.0]


def test_reshape(db):
    t = table(db, [{"dep": d, "year": y, "n": n} for d, y, n in [("A", "2015", 10), ("A", "2016", 9), ("B", "2015", 2), ("B", "2016", None)]])
    w = t.clone_table().wider("year", "n")
    assert w.get_data() == [{"dep": "A", "2015": 10, "2016": 9}, {"dep": "B", "2015": 2, "2016": None}]
    assert w.longer(["2015", "2016"], "year", "n").get_data() == t.get_data()
    nested = t.clone_table().nest("year", " / ", "dep")
    assert nested.get_data() == [{"dep": "A", "year": "2015 / 2016"}, {"dep": "B", "year": "2015 / 2016"}]
    assert nested.unnest("year", "/").get_values("year") == ["2015", "2016", "2015", "2016"]
    r = table(db, [{"x": "a", "n": 2}, {"x": "b", "n": 0}, {"x": "c", "n": None}, {"x": "d", "n": 1}]).repeat_rows("n", index="i")
    assert cols(r.get_data(), "x", "i") == [("a", 0), ("a", 1), ("d", 0)]


def test_summarize(db):
    t = db.new_table().load_array([{"k1": k, "k2": b, "k3": c} for k, b, c in [("Fraise", 11, 2.345), ("Rubarbe", 1, 4.5657), ("Rubarbe", 2, None), ("Fraise", 22, 12.3434), ("Banane", None, None), ("Banane", None, None)]])
    out = {r["value"]: r for r in t.summarize(output_table=True).get_data()}
    assert [out["k2"][s] for s in ("count", "countUnique", "countNull", "min", "max", "mean", "median", "sum")] == [6, 4, 2, 1, 22, 9, 6.5, 36]
    assert out["k2"]["skew"] == pytest.approx(0.9668861556278396)
    assert out["k1"]["mean"] is None and out["k1"]["countUnique"] == 3
    by = t.summarize(values="k2", categories="k1", summaries={"average": "mean"}, decimals=1, no_column_value=True, output_table=True)
    assert by.get_data() == [{"k1": "Banane", "average": None}, {"k1": "Fraise", "average": 16.5}, {"k1": "Rubarbe", "average": 1.5}]
    with pytest.raises(ValueError):
        t.summarize(summaries="nonsense")
    d = table(db, [{"d": dt.date(2020, 1, 1)}, {"d": dt.date(2020, 1, 4)}])
    assert d.summarize(summaries=["min", "median"], output_table=True).get_data()[0]["median"] == dt.datetime(2020, 1, 2, 12)
    assert d.get_mean("d") is None


def test_pairs(db):
    t = table(db, [{"a": x, "b": y, "c": 5} for x, y in [(1, 2), (2, 4.1), (3, 6), (None, 1)]])
    got = {(r["x"], r["y"]): r["corr"] for r in t.correlations(output_table=True).get_data()}
    assert got["a", "b"] == pytest.approx(0.99958, abs=1e-4) and math.isnan(got["a", "c"]) and len(got) == 3
    reg = t.linear_regressions(x="a", y="b", decimals=2, output_table=True).get_data()[0]
    assert (reg["slope"], reg["yIntercept"], reg["r2"]) == (2.0, 0.03, 1.0)


def test_windows(db):
    t = table(db, MARKS)
    r = t.clone_table().ranks("mark", "r").get_data()
    assert [x["r"] for x in r] == [1, 2, 3, 4, 4, 4, 7, 8, 9]
    assert [x["r"] for x in t.clone_table().ranks("mark", "r", no_gaps=True, order="desc").get_data()] == [1, 2, 3, 4, 4, 4, 5, 6, 7]
    by = {(x["subject"], x["name"]): x["r"] for x in t.clone_table().ranks("mark", "r", categories="subject").get_data()}
    assert by["Maths", "Lily"] == 3 and by["English", "Lily"] == 1
    assert sorted(t.clone_table().quantiles("mark", 2, "q").get_values("q")) == [1] * 5 + [2] * 4
    assert sorted(t.clone_table().quantiles("mark", 2, "q", categories="subject").get_values("q")) == [1] * 6 + [2] * 3
    assert t.clone_table().add_row_number("i").get_values("i") == list(range(9))
    assert t.clone_table().add_row_number("i", categories="name").get_values("i") == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert t.clone_table().accumulate("mark", "s").get_values("s") == [50, 105, 175, 265, 335, 424, 494, 554, 634]
    assert t.clone_table().accumulate("mark", "s", categories="subject").sort({"subject": "asc", "s": "asc"}).get_values("s") == [90, 160, 249, 50, 105, 175, 70, 130, 210]
    assert t.clone_table().clone_column_with_offset("mark", "n").get_values("n") == [55, 70, 90, 70, 89, 70, 60, 80, None]
    assert t.clone_table().clone_column_with_offset("mark", "n", offset=2, categories="subject").get_values("n")[:3] == [70, None, None]


@pytest.mark.parametrize("summary,want", [("mean", [None, 2.0, 3.0, None, None, None]), ("median", [None, 2.0, 3.0, None, None, None]), ("min", [None, 1, 2, None, None, None]), ("max", [None, 3, 4, None, None, None]), ("sum", [None, 6, 9, None, None, None])])
def test_rolling(db, summary, want):
    t = table(db, [{"x": v} for v in (1, 2, 3, 4, None, 6)])
    assert t.rolling("x", "r", summary, 1, 1).get_values("r") == want


def test_fill(db):
    t = table(db, [{"g": g, "x": v} for g, v in [("a", None), ("a", 2.0), ("b", None), ("b", 8.0), ("a", None), ("a", 6.0), ("b", None)]])
    assert t.clone_table().fill("x").get_values("x") == [None, 2, 2, 8, 8, 6, 6]
    assert t.clone_table().fill("x", categories="g").get_values("x") == [None, 2, None, 8, 2, 6, 8]
    assert table(db, [{"x": v} for v in (2, 4, None)]).fill("x", interpolate=True).get_values("x") == [2, 4, 6]
    assert table(db, [{"x": v} for v in (None, 4, None, 6, None, None)]).fill("x", interpolate=True).get_values("x") == [3, 4, 5, 6, 7, 8]
    assert table(db, [{"x": v, "t": w} for v, w in ((1, 0), (None, 10), (21, 20), (None, 30), (None, 5))]).fill("x", interpolate_by="t").get_values("x") == [1, 11, 21, 31, 6]
    assert table(db, [{"x": v, "g": g} for v, g in ((1, "a"), (10, "b"), (None, "a"), (20, "b"), (3, "a"), (None, "b"))]).fill("x", interpolate=True, categories="g").get_values("x") == [1, 10, 2, 20, 3, 30]
    i = table(db, [{"x": v} for v in (1, None, 4, None)]).convert({"x": "bigint"}).fill("x", interpolate=True)
    assert i.get_values("x") == [1, 2, 4, 5]


def test_scores(db):
    t = table(db, [{"x": v} for v in (2, 4, 4, 4, 5, 5, 7, 9)])
    assert t.clone_table().z_score("x", "z").get_values("z") == [-1.5, -0.5, -0.5, -0.5, 0, 0, 1, 2]
    assert t.clone_table().normalize("x", "n", decimals=2).get_values("n") == [0, 0.29, 0.29, 0.29, 0.43, 0.43, 0.71, 1]
    assert t.clone_table().proportions_vertical("x", "p").get_values("p")[0] == 0.05
    assert t.clone_table().add_column("y", "double", "x * 3").proportions_horizontal(["x", "y"]).get_values("yPerc") == [0.75] * 8
    flat = table(db, [{"x": 1, "g": "a"}, {"x": 1, "g": "a"}])
    assert all(math.isnan(v) for v in flat.clone_table().z_score("x", "z", categories="g").get_values("z"))
    o = table(db, [{"x": v} for v in (20, 21, 22, 23, 24, 25, 26, 27, 80)]).outliers_iqr("x", "o")
    assert o.get_values("o") == [False] * 8 + [True]
    b = table(db, [{"x": v} for v in (1.0, 10.0, 11.0, 25.0, None)])
    assert b.clone_table().bins("x", 10, "b").get_values("b") == ["[1-10]", "[1-10]", "[11-20]", "[21-30]", None]
    assert b.clone_table().bins("x", 10, "b", start_value=0).get_values("b") == ["[0-9]", "[10-19]", "[10-19]", "[20-29]", None]
    assert table(db, [{"x": v} for v in (65.0, 65.4, 66.1)]).bins("x", 0.5, "b").get_values("b") == ["[65-65.4]", "[65-65.4]", "[66-66.4]"]


def test_joins(db):
    dishes = db.new_table("dishes").load_array([{"dishId": i, "name": n} for i, n in ((1, "Crème brûlée"), (2, "Pizza"), (3, "Churros"), (4, "Couscous"))])
    cats = db.new_table("cats").load_array([{"cat": c, "dishId": i} for c, i in (("Main", 2), ("Main", 4), ("Dessert", 1), ("Dessert", None), ("Drink", 9))])
    assert sorted(cols(dishes.join(cats, output_table=True).get_data(), "dishId", "cat"), key=str) == sorted([(1, "Dessert"), (2, "Main"), (3, None), (4, "Main")], key=str)
    assert dishes.join(cats, type="inner", output_table=True).get_nb_rows() == 3
    right = dishes.join(cats, type="right", output_table=True).get_data()
    assert len(right) == 5 and sum(r["dishId"] is None for r in right) == 2
    assert dishes.join(cats, type="full", output_table=True).get_nb_rows() == 6
    with pytest.raises(ValueError):
        dishes.cross_join(cats)
    assert dishes.cross_join(table(db, [{"z": 1}, {"z": 2}]), output_table=True).get_nb_rows() == 8
    assert dishes.clone_table().semi_join(cats, "dishId", anti=True).get_values("dishId") == [3]
    left = table(db, [{"t": 5, "k": "a"}, {"t": 10, "k": "a"}, {"t": 1, "k": "b"}])
    quotes = table(db, [{"t": 4, "k": "a", "p": 1}, {"t": 10, "k": "a", "p": 2}, {"t": 2, "k": "b", "p": 3}])
    alone = left.clone_table().remove_columns("k").as_of_join(quotes.clone_table().remove_columns("k"), "t")
    assert sorted(cols(alone.get_data(), "t", "p"), key=str) == sorted([(5, 1), (10, 2), (1, None)], key=str)
    assert cols(left.as_of_join(quotes, "t", on="k").get_data(), "t", "p") == [(5, 1), (10, 2), (1, None)]


def test_sql(db):
    db.new_table("t").load_array([{"a": 1, "b": "x"}, {"a": 2, "b": None}])
    assert db.custom_query("SELECT a FROM t WHERE b == null") == [{"a": 2}]
    assert db.custom_query('SELECT "a" + 1 AS c FROM t WHERE a === 1 || a === 7') == [{"c": 2}]
    db.custom_query("SELECT b, count(*) AS n FROM t GROUP BY CUBE(b)", table="u")
    assert db.get_table("u").get_nb_rows() == 3


def test_getters(db):
    t = table(db, MARKS)
    assert t.get_first_row()["mark"] == 50 and t.get_last_row()["mark"] == 80
    assert cols(t.get_top(2), "mark") == [(50,), (55,)] and cols(t.get_bottom(2), "mark") == [(80,), (60,)] and cols(t.get_bottom(2, original_order=True), "mark") == [(60,), (80,)]
    assert t.get_uniques("subject") == ["English", "Maths", "Science"]
    assert (t.get_min("mark"), t.get_max("mark"), t.get_extent("mark"), t.get_sum("mark")) == (50, 90, [50, 90], 634)
    assert (t.get_mean("mark", decimals=2), t.get_median("mark"), t.get_quantile("mark", 0.25)) == (70.44, 70, 60)
    assert t.get_std_dev("mark", decimals=3) == 14.072 and t.get_var("mark", decimals=1) == 198.0 and t.get_skew("mark", decimals=3) == 0.079
    assert (t.get_nb_rows(conditions="mark > 80"), t.get_nb_columns(), t.get_nb_values(), t.get_nb_characters("subject")) == (2, 3, 27, 57)
    assert t.has_column("mark") and t.get_types()["mark"] == "double" and t.get_table_name() == t.name
    assert t.get_description()[0]["countUnique"] in (3, 7)
    with pytest.raises(ValueError):
        t.get_row("mark = 70")
    assert t.get_data_as_csv().split("\n")[:2] == ["name,subject,mark", "Isabella,Maths,50"]
    t.log_table(2).log_bottom(1).log_description().log_types().log_uniques("name").log_columns().log_nb_rows().log_extent("mark").log_projections()
    assert t.update_with_python(lambda rows: [r | {"m2": r["mark"] * 2} for r in rows]).get_values("m2")[0] == 100
    e = db.new_table().set_types({"a": "integer", "g": "geometry('EPSG:4326')"})
    assert e.get_nb_rows() == 0 and e.get_projection() == "EPSG:4326"


class Own(__import__("sparkloom").Table):
    def double(self):
        return self.update_column("x", "x * 2")


def test_subclass(spark):
    db = Session(spark, table_class=Own)
    assert db.new_table().load_array([{"x": 2}]).double().get_values("x") == [4]


def test_range_join_is_spread_however_small_the_left_is(spark):
    left = spark.range(400, numPartitions=1).selectExpr("id AS a", "id / 4 - 20 AS p", "id % 2 AS g")
    right = spark.createDataFrame([(1, -30.0, 5.0, 0), (2, 7.25, 7.25, 0), (3, 9.0, 7.0, 1), (4, 0.0, 50.0, 1), (5, 79.75, 90.0, 1), (6, 33.3, 33.8, 0)], "b long, s double, e double, g long")
    out = joins.range_join(left, right, "p", "s", "e", 10.0)
    want = [(x, y) for ys in [right.collect()] for x in left.collect() for y in ys if y.s <= x.p < y.e]
    assert sorted(tuple(r) for r in out.select("a", "b").collect()) == sorted((x.a, y.b) for x, y in want)
    keyed = joins.range_join(left, right, "p", "s", "e", 10.0, on="g").select("a", "b").collect()
    assert sorted(map(tuple, keyed)) == sorted((x.a, y.b) for x, y in want if x.g == y.g)
    assert len({r.at for r in out.select(F.spark_partition_id().alias("at")).collect()}) > 1
