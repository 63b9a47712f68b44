import json

from ferrolith.operators import rollup
from ferrolith.sources import tables


def test_nested_models_become_tables(spark, tmp_path):
    part = {"id": "p1", "expressId": 5, "partMark": "P1", "profile": "HEB200", "weightKg": 10.0, "quantity": 1.0}
    model = {
        "model_id": "m",
        "assemblies": [{"id": "a1", "expressId": 1, "assemblyMark": "A1", "weightKg": 20.0, "parts": [part, part], "bolts": [{"id": "b1", "boltName": "M20", "boltQty": 4.0}]}, {"id": "a2", "expressId": 2, "assemblyMark": "a1", "parts": [part | {"weightKg": 12.0}], "bolts": []}],
        "boltSteelLinks": [{"boltGlobalId": "b1", "partGlobalId": "p1"}],
    }
    (tmp_path / "m.json").write_text(json.dumps(model) + "\n")
    got = tables.model_tables(tables.read_models(spark, str(tmp_path / "m.json")))
    assert got["members"].count() == 2 and got["bolt_links"].count() == 1 and got["assembly_bolts"].count() == 1
    assert [(r["mark"], r["weight"]) for r in got["parts"].collect()] == [("P1", 12.0)]
    rows = rollup.assembly_rollup(got["assemblies"]).collect()
    assert [(r["label"], r["quantity"], r["weight"]) for r in rows] == [("A1", 2, 20.0)]
    instances = rollup.assembly_instances(got["assemblies"]).collect()
    assert sorted((r["group_key"], r["assembly_id"]) for r in instances) == [(rows[0]["group_key"], "a1"), (rows[0]["group_key"], "a2")]


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("m", "Eave", 6000.0), ("n", "Ridge", 9000.0)], tables.SCHEMAS["levels"])
    for form in ("parquet", "orc", "json"):
        tables.write_table(rows, str(tmp_path / form), form)
        back = tables.read_table(spark, str(tmp_path / form), "levels", form)
        assert sorted(map(tuple, back.select("model_id", "name", "elevation_mm").collect())) == [("m", "Eave", 6000.0), ("n", "Ridge", 9000.0)]
