"""Buildings by their stated counts, and ends of members by hand."""

from collections import Counter

from pyspark.sql import functions as F

from ferrolith.operators import buildings

TEXTS = {
    "gable": "Gable roof with ridge and rafters on columns\nTotal Length: 30000 mm\nTotal Width: 10000 mm",
    "truss": "Industrial warehouse with truss roof on an IfcSlab",
    "monoslope": "Monoslope shed with rafters on a concrete slab\nFront Wall girts at Z = 800, 1600\nBack Wall girts at Z = 100, 1200, 36000, 2",
}


def test_texts_to_members(spark):
    texts = spark.createDataFrame([*TEXTS.items(), ("none", "a shed"), ("null", None), ("empty", "")], "model_id string, text string")
    rows = buildings.building_members(buildings.building_requests(texts)).collect()
    n = Counter((r["model_id"], r["part"]) for r in rows)
    assert n == {
        ("gable", "columns"): 14, ("gable", "rafters"): 14, ("gable", "purlins"): 8, ("gable", "girts"): 6,
        ("truss", "slab"): 1, ("truss", "columns"): 34, ("truss", "rafters"): 34, ("truss", "ties"): 17, ("truss", "posts"): 17 * 7, ("truss", "webs"): 17 * 8, ("truss", "purlins"): 12, ("truss", "girts"): 8,
        ("monoslope", "slab"): 1, ("monoslope", "columns"): 8, ("monoslope", "rafters"): 4, ("monoslope", "purlins"): 5, ("monoslope", "girts"): 5, ("monoslope", "wall_braces"): 8, ("monoslope", "roof_braces"): 4,
    }
    line = lambda model, part, k: next(tuple(r[c] for c in buildings.LINE) for r in rows if (r["model_id"], r["part"], r["n"]) == (model, part, k))
    assert line("gable", "rafters", 1) == (0.0, 0.0, 4000.0, 0.0, 5000.0, 5500.0) and line("gable", "rafters", 2) == (0.0, 5000.0, 5500.0, 0.0, 10000.0, 4000.0)
    assert line("truss", "webs", 2) == (0.0, 5000.0, 6000.0, 0.0, 2500.0, 6625.0) and line("truss", "posts", 4) == (0.0, 10000.0, 6000.0, 0.0, 10000.0, 8500.0)
    assert line("monoslope", "columns", 2) == (0.0, 8000.0, 0.0, 0.0, 8000.0, 5000.0) and line("monoslope", "rafters", 4) == (15000.0, 0.0, 3500.0, 15000.0, 8000.0, 5000.0)
    assert line("monoslope", "roof_braces", 2) == (5000.0, 0.0, 3500.0, 0.0, 8000.0, 5000.0) and line("monoslope", "wall_braces", 1) == (0.0, 0.0, 0.0, 5000.0, 0.0, 3500.0)
    girts = sorted((r["sy"], r["sz"]) for r in rows if (r["model_id"], r["part"]) == ("monoslope", "girts"))
    assert girts == [(0.0, 800.0), (0.0, 1600.0), (8000.0, 200.0), (8000.0, 1200.0), (8000.0, 3600.0)]
    assert all(any(abs(r[f"s{a}"] - r[f"e{a}"]) > 1e-6 for a in "xyz") for r in rows)


def test_layouts(spark):
    base = {"length_mm": 6000.0, "width_mm": 4000.0, "eave_mm": 3000.0, "ridge_mm": None, "bay_mm": None, "slab_mm": None, "n_columns": 3, "n_purlins": 1}
    rows = [(k, k, *base.values(), {"main": "HEB200", "beam": "IPE200"}) for k in ("column_row", "portal_frame", "single_element", "steel_shed", "dome")] + [("nothing", None, *([None] * 8), None)]
    types = ["double"] * 6 + ["int"] * 2
    schema = "model_id string, kind string, " + ", ".join(f"{n} {t}" for n, t in zip(base, types)) + ", sections map<string,string>"
    df = spark.createDataFrame(rows, schema).withColumns({w: F.lit(None).cast("array<double>") for w in buildings.WALLS})
    got = buildings.building_members(df).collect()
    n = Counter((r["model_id"], r["part"]) for r in got)
    assert n == {("column_row", "columns"): 3, ("portal_frame", "columns"): 3, ("portal_frame", "beam"): 1, ("single_element", "columns"): 1, ("steel_shed", "columns"): 6, ("steel_shed", "rafters"): 3, ("steel_shed", "purlins"): 1, ("steel_shed", "base_along"): 2, ("steel_shed", "base_across"): 2}
    assert sorted(r["sx"] for r in got if r["model_id"] == "portal_frame" and r["part"] == "columns") == [0.0, 3000.0, 6000.0]
    assert {(r["part"], r["section"]) for r in got if r["model_id"] == "steel_shed"} == {("columns", "HEB200"), ("rafters", "IPE200"), ("purlins", "IPE200"), ("base_along", "IPE200"), ("base_across", "IPE200")}
    assert [r["sy"] for r in got if r["part"] == "purlins"] == [2000.0]


def test_chat_texts_to_members(spark):
    texts = [
        (1, "IPE400 beam supported by 3 columns HEB300, span 6 m"), (2, "a warehouse with 4 columns, length 10 m and width 5 m, purlins RHS 80x40x3"), (3, "a column, height 2 m"), (4, "good morning"), (5, None), (6, "5 columns over a length of 8000 mm"),
    ]
    given = spark.createDataFrame([(4, "single_element", None, None, 2500.0, 2, "IPE160")], "model_id int, kind string, length_mm double, width_mm double, eave_mm double, n_columns int, section string")
    requests = buildings.layout_requests(spark.createDataFrame(texts, "model_id int, text string"), given)
    got = {r["model_id"]: (r["kind"], r["rule"], r["n_columns"]) for r in requests.collect()}
    assert got == {1: ("portal_frame", "portal", 3), 2: ("steel_shed", "shed", 6), 3: ("single_element", "column", 2), 4: ("single_element", "given", 2), 6: ("column_row", "row", 5)}
    rows = buildings.building_members(requests).collect()
    assert Counter(r["model_id"] for r in rows) == {1: 4, 2: 6 + 3 + 4 + 4, 3: 1, 4: 1, 6: 5}
    section = {(r["model_id"], r["part"]): r["section"] for r in rows}
    assert section[1, "columns"] == "HEB300" and section[1, "beam"] == "IPE400" and section[2, "purlins"] == "80x40x3" and section[4, "columns"] == "IPE160"
    assert max(r["ez"] for r in rows if r["model_id"] == 3) == 2000.0 and max(r["ex"] for r in rows if r["model_id"] == 6) == 8000.0
