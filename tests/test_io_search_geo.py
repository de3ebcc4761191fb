import json
import random
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom import Session
from sparkloom.functions import geometry as G
from sparkloom.functions.porter import stem
from sparkloom.functions.similarity import METHODS, ratio, token_set_ratio, token_sort_ratio
from sparkloom.operators import geo
from sparkloom.operators.search import create_index


@pytest.fixture
def db(spark, tmp_path):
    return Session(spark, cache_dir=str(tmp_path / "cache"))


def test_csv(db, tmp_path):
    (tmp_path / "a.csv").write_text('k,n,d\n"a, ""b""",1,2020-01-02\nc,,2020-01-03\n')
    t = db.new_table().load_data(str(tmp_path / "a.csv"))
    assert t.get_types() == {"k": "string", "n": "bigint", "d": "date"} and t.get_values("k") == ['a, "b"', "c"]
    assert db.new_table().load_data(str(tmp_path / "a.csv"), all_text=True, columns=["n"], limit=1).get_data() == [{"n": "1"}]
    (tmp_path / "b.tsv").write_text("junk\nx\ty\n1\t2\n3\t4\n")
    assert db.new_table().load_data(str(tmp_path / "b.tsv"), skip=1).get_data() == [{"x": 1, "y": 2}, {"x": 3, "y": 4}]
    assert db.new_table().load_data(str(tmp_path / "b.tsv"), skip=1, types={"x": "string"}).get_values("x") == ["1", "3"]
    d = tmp_path / "dir"
    d.mkdir()
    (d / "1.csv").write_text("k,v\na,1\n")
    (d / "2.csv").write_text("k,w\nb,2\n")
    u = db.new_table().load_data_from_directory(str(d), unify=True, file_name=True)
    assert u.get_values("w") == [None, 2] and u.get_values("filename")[0].endswith("1.csv")
    with pytest.raises(ValueError):
        db.new_table().load_data_from_directory(str(d))
    t.write_data(str(tmp_path / "out" / "o.csv"), compression=True)
    assert db.new_table().load_data(str(tmp_path / "out" / "o.csv.gz")).get_data() == t.get_data()


def test_json_parquet(db, tmp_path):
    (tmp_path / "a.json").write_text('[{"z": 1, "a": "x"}, {"z": null, "a": "y"}]')
    t = db.new_table().load_data(str(tmp_path / "a.json"))
    assert t.get_columns() == ["z", "a"] and t.get_values("z") == [1, None]
    t.write_data(str(tmp_path / "b.json"))
    assert json.loads((tmp_path / "b.json").read_text()) == [{"z": 1, "a": "x"}, {"z": None, "a": "y"}]
    t.write_data(str(tmp_path / "c.json"), as_arrays=True)
    assert json.loads((tmp_path / "c.json").read_text()) == {"z": [1, None], "a": ["x", "y"]}
    t.write_data(str(tmp_path / "d.parquet"), compression=True)
    assert db.new_table().load_data(str(tmp_path / "d.parquet")).get_data() == t.get_data()


def test_parquet_file_is_joined_from_parts(db, tmp_path):
    t = db.new_table().set_df(db.spark.range(1000, numPartitions=5).selectExpr("id AS k", "CASE WHEN id % 7 > 0 THEN concat('t', id % 50) END AS x", "array(id, NULL) AS l"))
    db.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(2):  # the second time over the first
            assert t.write_data(str(tmp_path / "d.parquet")) == str(tmp_path / "d.parquet")
    finally:
        db.spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [x.name for x in tmp_path.iterdir() if x.name != "cache"] == ["d.parquet"] and (tmp_path / "d.parquet").is_file()
    f = pq.ParquetFile(tmp_path / "d.parquet")
    assert f.metadata.num_row_groups > 1 and f.read().to_pylist() == [r.asDict() for r in t.df.orderBy("k").collect()]
    empty = t.clone_table().filter("k < 0")
    assert db.new_table().load_data(empty.write_data(str(tmp_path / "e.parquet"))).get_nb_rows() == 0


def test_xlsx(db, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><t>Bob</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2.5</v></c></row></sheetData></worksheet>')
    t = db.new_table().load_data(str(tmp_path / "a.xlsx"), sheet="S")
    assert t.get_data() == [{"name": "Bob", "col1": None, "n": 2.5}]
    with pytest.raises(ValueError):
        db.new_table().load_data(str(tmp_path / "a.xlsx"), sheet="T")


def test_databases_and_cache(db, spark, tmp_path):
    db.new_table("t").load_array([{"a": 1, "b": "x"}])
    for path in ("x.db", "x.sqlite"):
        db.write_db(str(tmp_path / path))
        other = Session(spark)
        other.load_db(str(tmp_path / path))
        assert other.get_table("t").get_data() == [{"a": 1, "b": "x"}]
    runs = []

    def load(t):
        runs.append(1)
        t.load_array([{"a": 7}])

    for ttl in (None, 1000, 0):
        assert db.new_table(f"c{len(runs)}{ttl}").get_table_name()
        assert (db.tables.get("cached") or db.new_table("cached")).cache(load, ttl=ttl).get_values("a") == [7]
    assert len(runs) == 2
    db.done()
    with pytest.raises(ValueError):
        Session(spark, file=str(tmp_path / "x.txt")).start()


def test_similarity():
    assert round(ratio("Bob Johnson", "Bob Jonson"), 2) == 95.24
    assert token_sort_ratio("b a", "a  b") == 100 and token_set_ratio("a b", "a b c") == 100
    assert all(f("same text", "same text") == 100 for f in METHODS.values()) and METHODS["partial_ratio"]("abc", "xxabcxx") == 100
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "probate", "controlling", "generalizations", "sky", "happy")] == ["caress", "poni", "relat", "hop", "probat", "control", "gener", "sky", "happi"]


@pytest.mark.parametrize("method", ["ratio", "token_sort_ratio"])
def test_fuzzy_blocking_is_lossless(db, method):
    r = random.Random(3)
    words = list({"".join(r.choice("ab c") for _ in range(r.randint(1, 14))) for _ in range(60)})
    for threshold in (60, 85):
        left, right = db.new_table().load_array([{"l": w} for w in words]), db.new_table().load_array([{"r": w} for w in words[::-1]])
        got = {(x["l"], x["r"]) for x in left.fuzzy_join(right, "l", "r", threshold, method=method, similarity_column="s", output_table=True).get_data() if x["r"] is not None}
        assert got == {(a, b) for a in words for b in words if round(METHODS[method](a, b), 2) >= threshold}


def test_fuzzy(db):
    a = db.new_table().load_array([{"id": i, "name": n} for i, n in enumerate(["Bob Johnson", "Zed", None])])
    b = db.new_table().load_array([{"person": "Bob Jonson"}])
    got = a.fuzzy_join(b, "name", "person", 80, similarity_column="s", output_table=True).get_data()
    assert got == [{"id": 0, "name": "Bob Johnson", "s": 95.24, "person": "Bob Jonson"}, {"id": 1, "name": "Zed", "s": None, "person": None}, {"id": 2, "name": None, "s": None, "person": None}]
    t = db.new_table().load_array([{"n": x} for x in ["Montreal", "Montréal", "Montreal", "Montreall", "Toronto", None]])
    assert t.fuzzy_clean("n", "c", 80).get_values("c") == ["Montreal"] * 4 + ["Toronto", None]
    assert t.fuzzy_clean("n", "n", 80, keep="longestString").get_values("n") == ["Montreall"] * 4 + ["Toronto", None]


def test_bm25(db):
    t = db.new_table().load_array([{"id": i, "text": x} for i, x in enumerate(["butter chicken with rice", "chicken soup", "rice rice pudding", "the green salad", None])])
    got = t.bm25("chickens and rice", "id", "text", 3, score_column="s", output_table=True).get_data()
    assert [r["id"] for r in got][0] == 0 and {r["id"] for r in got} == {0, 1, 2} and got[0]["s"] > got[1]["s"]
    assert [r["id"] for r in t.bm25("chicken rice", "id", "text", 3, conjunctive=True, output_table=True).get_data()] == [0]
    assert t.bm25("zzz", "id", "text", 3, output_table=True).get_nb_rows() == 0
    v = db.new_table().load_array([{"id": 1, "v": [1.0, 0.0]}, {"id": 2, "v": [1.0, 1.0]}, {"id": 3, "v": [0.0, 1.0]}])
    assert [r["id"] for r in v.create_vss_index("v").nearest("v", [1.0, 0.1], 2).get_data()] == [1, 2]


def square(x, y, s):
    return {"type": "Polygon", "coordinates": [[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]]}


def features(*items):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": p} for g, p in items]})


def test_kernels():
    area = lambda g: sum(G.signed_area(r) for p in G.polygons(g) for r in p) if g else 0
    assert area(G.overlay(square(0, 0, 2), square(1, 1, 2), "intersection")) == 1
    assert area(G.overlay(square(0, 0, 2), square(1, 1, 2), "union")) == 7
    assert area(G.overlay(square(0, 0, 3), square(1, 1, 1), "difference")) == 8
    assert G.overlay(square(0, 0, 1), square(5, 5, 1), "intersection") is None
    assert area(G.overlay(square(0, 0, 1), square(1, 0, 1), "union")) == 2 and len(G.polygons(G.overlay(square(0, 0, 1), square(1, 0, 1), "union"))[0][0]) == 5
    bow = {"type": "Polygon", "coordinates": [[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]]}
    assert G.problems(bow) and not G.problems(G.made_valid(bow)) and not G.problems(square(0, 0, 1))
    assert 8 < area(G.buffered(square(0, 0, 1), 1)) < 1 + 4 + 3.1416
    assert round(G.haversine([-79.29, 43.77], [-73.86, 45.35])) == 464577 and round(G.geodesic([-79.29, 43.77], [-73.86, 45.35])) == 465639
    assert G.geodesic_area(square(0, 0, 1)) == pytest.approx(12308778361.469, rel=1e-6)
    p = {"type": "Point", "coordinates": [-73.5, 45.5]}
    for c in ("EPSG:3857", "EPSG:3347"):
        assert G.reprojected(G.reprojected(p, "WGS84", c), c, "WGS84")["coordinates"] == pytest.approx(p["coordinates"])
    r = random.Random(1)
    for _ in range(30):
        a, b = (square(r.random() * 4, r.random() * 4, 1 + r.random() * 3) for _ in range(2))
        i, u, d = (area(G.overlay(a, b, h)) for h in ("intersection", "union", "difference"))
        assert u == pytest.approx(area(a) + area(b) - i) and d == pytest.approx(area(a) - i)
    line = {"type": "LineString", "coordinates": [[0, 0], [1, 0.01], [2, 0]]}
    assert G.simplified(line, 0.5)["coordinates"] == [[0, 0], [2, 0]] and G.from_wkb(G.to_wkb(line)) == line


def test_geo_table(db, tmp_path):
    (tmp_path / "p.geojson").write_text(features((square(0, 0, 2), {"name": "A", "g": 1}), (square(1, 0, 2), {"name": "B", "g": 1}), (square(10, 10, 1), {"name": "C", "g": 2})))
    t = db.new_table("polys").load_geo_data(str(tmp_path / "p.geojson"))
    assert t.get_projection() == "EPSG:4326" and t.get_bounding_box() == [0, 0, 11, 11]
    t.type_geo("type").nb_vertices("n").is_valid_geo("ok").is_closed_geo("closed").centroid("c").bounding_box(column="geom", decimals=1)
    row = t.clone_table(columns=["type", "n", "ok", "closed", "minLon", "maxLat"]).get_first_row()
    assert row == {"type": "POLYGON", "n": 5, "ok": True, "closed": True, "minLon": 0, "maxLat": 2}
    assert t.clone_table().lat_lon("c", "lat", "lon").get_values("lat") == [1, 1, 10.5]
    assert t.clone_table().area("a", unit="km2", column="geom").perimeter("p", unit="km", column="geom").get_values("a")[2] == pytest.approx(12_100, rel=0.02)
    u = t.clone_table(columns=["g", "geom"]).aggregate_geo("union", categories="g", output_table=True)
    assert u.area("a", unit="km2").sort({"g": "asc"}).get_values("a")[0] == pytest.approx(6 * 12308, rel=0.01)
    i = t.clone_table(columns=["g", "geom"]).aggregate_geo("intersection", output_table=True).get_geo_data()
    assert i["features"][0]["geometry"] is None
    flipped = t.clone_table(columns=["name", "geom"]).flip_coordinates().flip_coordinates().reduce_precision(0).simplify(0.1).fix_geo().fill_holes()
    assert flipped.get_geo_data(rewind=True)["features"][2]["geometry"]["type"] == "Polygon"
    pts = db.new_table("pts").load_array([{"who": w, "lat": y, "lon": x} for w, x, y in (("p", 1.5, 0.5), ("q", 10.5, 10.5), ("r", 50, 50))]).points("lat", "lon", "geom")
    j = pts.clone_table("pts2").join_geo(db.new_table("areas").load_geo_data(str(tmp_path / "p.geojson")), "inside", output_table=True)
    assert sorted((r["who"], r["name"]) for r in j.remove_columns(j.get_columns()[3]).remove_columns([c for c in j.get_columns() if c.startswith("geom")]).get_data() if r["name"]) == [("p", "A"), ("p", "B"), ("q", "C")]
    assert j.get_nb_rows() == 4
    near = pts.clone_table("x").rename_columns({"geom": "g2", "who": "who2", "lat": "lat2", "lon": "lon2"})
    d = pts.clone_table("y").join_geo(near, "within", type="inner", distance=2_000_000, distance_method="haversine", output_table=True)
    assert d.select_columns(["who", "who2"]).get_nb_rows() == 5
    both = pts.clone_table("z").cross_join(near, output_table=True).distance("geom", "g2", "m", method="spheroid", unit="km", decimals=1).intersect("geom", "g2", "same").inside("geom", "g2", "in")
    assert both.select_columns(["m", "same", "in"]).get_first_row() == {"m": 0, "same": True, "in": True}
    ov = t.clone_table(columns=["name", "geom"]).buffer("wide", 0.5, column="geom").intersection("geom", "wide", "both").remove_intersection("wide", "geom", "ring").union("geom", "wide", "all").random_point("r", column="geom")
    assert ov.inside("r", "geom", "in").get_nb_rows(conditions="in") == 3
    t.clone_table(columns=["name", "geom"]).write_geo_data(str(tmp_path / "o.geojson"), rewind=True, precision=3)
    assert db.new_table().load_geo_data(str(tmp_path / "o.geojson")).reproject("EPSG:3857").get_projection() == "EPSG:3857"
    t.clone_table(columns=["name", "geom"]).write_geo_data(str(tmp_path / "o.geoparquet"))
    assert db.new_table().load_geo_data(str(tmp_path / "o.geoparquet")).get_nb_rows() == 3
    t.clone_table(columns=["name", "g", "geom"]).write_geo_data(str(tmp_path / "s.shp"))
    back = db.new_table().load_geo_data(str(tmp_path / "s.shp"))
    assert back.get_columns() == ["name", "g", "geom"] and back.get_values("g") == [1, 1, 2] and back.get_bounding_box() == [0, 0, 11, 11]
    back.area("a", column="geom")
    assert back.get_values("a") == pytest.approx(t.clone_table(columns=["geom"]).area("a").get_values("a"))
    areas = db.get_table("areas").clone_table("areas2")
    full = pts.clone_table("pf").join_geo(areas, "inside", type="full", output_table=True)
    right = pts.clone_table("pr").filter("who = 'q'").join_geo(areas, "inside", type="right", output_table=True)
    assert full.get_nb_rows() == 4 and right.get_nb_rows() == 3 and sorted(right.get_values("name")) == ["A", "B", "C"]
    with pytest.raises(ValueError):
        t.get_data()


def test_index_counts_terms_where_their_texts_lie(db):
    texts = ["b a b", "", None, "a a. c", "b a b"]
    d = db.new_table().set_df(db.spark.createDataFrame(list(enumerate(texts)), "k long, x string"))
    index = create_index(d.df.repartition(3, "k"), "k", "x", stemmer="none", stopwords="none")
    assert sorted(tuple(r) for r in index.postings.select("id", "length", F.coalesce("term", F.lit("-")), "tf").collect()) == [(0, 3, "a", 1), (0, 3, "b", 2), (1, 0, "-", 1), (3, 3, "a", 2), (3, 3, "c", 1), (4, 3, "a", 1), (4, 3, "b", 2)]
    assert index.postings.dtypes == [("doc", "bigint"), ("id", "bigint"), ("length", "int"), ("term", "string"), ("tf", "bigint")] and (index.texts, index.mean) == (4, 9 / 4)


def test_index_shuffles_no_terms(db, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr("sparkloom.operators.search.stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    db.spark.range(9).selectExpr("id AS k", "concat('a b ', id) AS x").write.parquet(str(tmp_path / "d.parquet"))
    create_index(db.spark.read.parquet(str(tmp_path / "d.parquet")), "k", "x", stemmer="none", stopwords="none")
    assert "Sort" in plans[0] and "Exchange" not in plans[0]


def test_geo_join_has_few_python_steps_a_task(db, monkeypatch):
    plans, real = [], geo.stored
    monkeypatch.setattr(geo, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    p = db.new_table().set_df(db.spark.range(20).selectExpr("id AS a", "IF(id < 19, id, NULL) AS x")).points("x", "x", "g")
    q = db.new_table().set_df(db.spark.range(15, 30).selectExpr("id AS b", "id AS y")).points("y", "y", "h")
    out = p.join_geo(q, "intersect", left_table_column="g", right_table_column="h", type="full").select_columns(["a", "b"])
    rows = [tuple(r) for r in out.df.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(i, i if 15 <= i < 19 else None) for i in range(20)] + [(None, i) for i in range(19, 30)]))
    # points and boxes, then the test alone; the result itself needs no geometry
    assert [x.count("ArrowEvalPython") for x in plans] == [2, 2, 1]
    assert "ArrowEvalPython" not in out.df._jdf.queryExecution().executedPlan().toString()
