import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ferrolith.operators import details, prompts, region, spatial


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()[0]


def test_crop_maps_are_inverse_and_clamped(spark):
    row = {"cx0": 100.0, "cx1": 300.0}
    assert one(spark, region.to_point(F.lit(0.25), "cx0", "cx1"), **row) == 150.0
    assert one(spark, region.to_point(F.lit(-3.0), "cx0", "cx1"), **row) == 100.0
    assert one(spark, region.to_share(F.lit(150.0), "cx0", "cx1"), **row) == 0.25
    assert one(spark, region.to_share(F.lit(150.0), "cx0", "cx1"), cx0=5.0, cx1=5.0) == 0.0


@pytest.mark.parametrize(
    "detected, given, chosen",
    [
        ([0.0, 6000.0, 12000.0], [0.0, 12000.0], "detected"),  # only the ends are given
        ([0.0, 6000.0, 12000.0], [0.0, 4000.0, 8000.0, 12000.0], "given"),
        ([float(v) * 500 for v in range(20)], [0.0, 5000.0, 10000.0], "given"),  # stray lines
        ([0.0], [0.0, 12000.0], "given"), ([0.0, 6000.0], [7.0], "detected"), ([], [], "detected"),
    ],
)
def test_preferred_axis(spark, detected, given, chosen):
    rows = spark.createDataFrame([(detected, given)], "d array<double>, g array<double>")
    assert rows.select(region.preferred_axis(F.col("d"), F.col("g")).alias("x")).first()[0] == {"detected": detected, "given": given}[chosen]


@pytest.mark.parametrize("index, new", [(0, 0), (1, 2), (2, 2), (7, 2)])
def test_reindexed(spark, index, new):
    rows = spark.createDataFrame([(index, [0.0, 6100.0], [0.0, 3000.0, 6000.0])], "i int, old array<double>, new array<double>")
    assert rows.select(region.reindexed(F.col("i"), F.col("old"), F.col("new"))).first()[0] == new


def test_bays_never_join_the_lines(spark):
    rows = [("a", "line", 0, [0.0, 18000.0]), ("a", "bay", 1, [6000.0, 6000.0, 6000.0]), ("b", "line", 0, [0.0, 5000.0, 9000.0]), ("b", "bay", 1, [1000.0, 1000.0, 1000.0, 1000.0]), ("c", "bay", 1, [2000.0, 3000.0]), ("d", "bay", 1, [2000.0])]
    found = region.axis_candidates(spark.createDataFrame(rows, "page string, kind string, ord int, values array<double>"), ["page"])
    assert {r["page"]: r["stations"] for r in found.collect()} == {"a": [0.0, 6000.0, 12000.0, 18000.0], "b": [0.0, 5000.0, 9000.0], "c": [0.0, 2000.0, 5000.0], "d": []}


def test_region_grid_without_any_axis_has_no_confidence(spark):
    numbers = spark.createDataFrame([("a", "x", [6000.0, 6000.0]), ("b", "x", [7.0])], "page string, axis string, numbers array<double>")
    vectors = spark.createDataFrame([("a", "x", [0.0, 4000.0, 8000.0, 12100.0])], "page string, axis string, stations array<double>")
    found = {r["page"]: (r["x"], r["y"], r["sources"], round(r["confidence"], 2)) for r in region.region_grid(numbers, vectors, ["page"]).collect()}
    assert found == {"a": ([0.0, 4000.0, 8000.0, 12100.0], [], 2, 0.85), "b": ([], [], 0, 0.0)}


CROP = "page string, width_px double, height_px double, mm_per_px double, xs array<double>, ys array<double>"
CLICK = "page string, ord int, x double, y double, mark string"


def test_clicks_snap_to_stations_and_upwards(spark):
    crops = spark.createDataFrame([("a", 600.0, 400.0, None, [0.0, 6000.0, 12000.0], [0.0, 8000.0])], CROP)
    clicks = spark.createDataFrame([("a", 0, 290.0, 10.0, None), ("a", 1, 0.0, 395.0, " K7 ")], CLICK)
    found = region.click_placements(clicks, crops, ["page"]).orderBy("ord").collect()
    assert [(r["placement_id"], r["mark"], r["x_mm"], r["y_mm"]) for r in found] == [("col_1_1", "C1", 6000.0, 8000.0), ("col_0_0", "K7", 0.0, 0.0)]


def test_clicks_without_stations_make_their_own(spark):
    crops = spark.createDataFrame([("a", 1000.0, 1000.0, 10.0, None, None), ("b", 1000.0, 1000.0, 10.0, None, None)], CROP)
    clicks = spark.createDataFrame([("a", 0, 100.0, 100.0, None), ("a", 1, 110.0, 900.0, None), ("a", 2, 600.0, 900.0, None), ("b", 0, 5.0, 5.0, None)], CLICK)
    found = region.click_placements(clicks, crops, ["page"]).orderBy("ord").collect()
    # one click gives no axis; stations are 105 and 600 pixels, 4.95 millimetres a pixel along x
    assert [(r["page"], r["placement_id"], r["x_mm"], r["y_mm"]) for r in found] == [("a", "col_0", 519.8, 7200.0), ("a", "col_1", 519.8, 800.0), ("a", "col_2", 2970.0, 800.0)]


def test_ids_are_unique_even_where_made_ids_exist(spark):
    rows = spark.createDataFrame([(0, "c", 1.0, 2.0), (1, "c", 1.0, 2.0), (2, "c_1_2", 5.0, 5.0), (3, None, 1.0, 2.0), (4, "c", 9.0, 9.0)], "ord int, id string, x_mm double, y_mm double").withColumn("page", F.lit(1))
    found = [r["member_id"] for r in region.unique_ids(rows, ["page"]).orderBy("ord").collect()]
    assert found == ["c", "c_1_2", "c_1_2_n_2", "col_1_2", "c_2"]


def test_columns_are_counted_by_walls_first(spark):
    count = lambda t: one(spark, prompts.column_count(F.col("t")), t=t)
    assert count("17 columns on each side wall") == 34
    assert count("SUPPORT COLUMNS\n - 12 Units") == 12
    assert count("Place 17 columns along the front wall." + " " * 90 + "Put 16 matching columns along the back.") == 33
    assert count("no number") is None


def test_spans_of_levels_end_at_the_next_level(spark):
    text = "Level 1 beams, Level 2 beams spanning from X = 100 to X = 900\nLevel 3 spanning over X=0 to X=700"
    rows = prompts.level_x_spans(spark.createDataFrame([(1, text)], "id int, text string"), "id").collect()
    assert sorted((r["level"], r["x0"], r["x1"]) for r in rows) == [(2, 100.0, 900.0), (3, 0.0, 700.0)]


def test_empty_specification_has_a_summary(spark):
    rows = spark.createDataFrame([(1, "slab", "S", 1.0), (2, "beam", "IPE200", 3000.0), (2, "column", "HEB200", 6000.4), (2, "column", "HEB200", 6000.4)], "m int, role string, profile string, length_mm double")
    assert {r["m"]: r["summary"] for r in details.spec_summary(rows, ["m"]).collect()} == {1: "empty model", 2: "2× column: HEB200 (6000 mm) · 1× beam: IPE200 (3000 mm)"}


def test_relations_are_pruned_by_the_length_of_the_seeds(spark):
    def box(m, e, kind, x, size):
        return (m, e, kind, x, x + size, 0.0, size, 0.0, size)

    rows = []
    for m, length in (("short", 1.0), ("long", 10.0)):
        rows.append((m, f"{m}-seed", "steel", 0.0, length, 0.0, 0.01, 0.0, 0.01))
        rows += [box(m, f"{m}-listed", "fastener", 50.0, 0.01), box(m, f"{m}-on", "fastener", 0.2, 0.01), box(m, f"{m}-washer", "accessory", 0.2, 0.01), box(m, f"{m}-off", "fastener", 30.0, 0.01), box(m, f"{m}-big", None, 30.0, 5.0)]
    sides = ", ".join(f"{s}_{a} double" for a in "xyz" for s in ("min", "max"))
    elements = spark.createDataFrame(rows, f"model_id string, element_id string, kind string, {sides}")
    seeds, allowed = elements.where("element_id LIKE '%seed'"), elements.where("element_id LIKE '%listed'").select("element_id")
    kept = {r["element_id"] for r in spatial.prune_relations(elements, seeds, allowed).collect()}
    assert {f"{m}-{e}" for m in ("short", "long") for e in ("seed", "listed", "on", "washer", "off", "big")} - kept == {"short-off", "long-on", "long-off"}
    assert spatial.prune_relations(elements, seeds, allowed.limit(0)).count() == len(rows)


def test_leaves_of_assemblies_and_of_single_nodes(spark):
    nodes = spark.createDataFrame([("asm", True), ("bolt", False), ("beam", False)], "node string, is_assembly boolean")
    leaves = spark.createDataFrame([("asm", "bolt"), ("asm", "plate"), ("beam", "stray")], "seed string, node string")
    elements = spark.createDataFrame([("bolt", True), ("plate", False), ("beam", False), ("stray", False)], "element_id string, is_fastener boolean")
    found = sorted(tuple(r) for r in details.leaf_split(nodes, leaves, elements).collect())
    assert found == [("asm", "bolt", True), ("asm", "plate", False), ("beam", "beam", False), ("bolt", "bolt", True)]


def test_lists_of_an_axis_are_worked_out_once(spark):
    """However often a rule reads a list, its plan folds it once: the sums of bays, the clean values they come of."""
    from ferrolith.operators.grid import axis_positions, chain_stations

    rows = spark.createDataFrame([([500.0, 0.4, 900.0, 900.0],), ([700.0],), ([],), (None,)], "v array<double>")
    out = rows.select(axis_positions(F.col("v")).alias("a"), chain_stations(F.col("v")).alias("c"))
    assert [tuple(r) for r in out.collect()] == [([0.4, 500.0, 900.0], [0.4, 500.0, 900.0]), ([700.0], []), ([], []), (None, None)]
    folds = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    assert folds(axis_positions(F.col("v"))) <= 2 and folds(region.longest(F.array("v"))) <= 2


def test_pages_are_dealt_to_more_partitions_as_there_are_more_segments(spark, monkeypatch):
    """A task sorts a fixed share of the segments, however many there are."""
    from ferrolith.operators import graph

    monkeypatch.setattr(graph, "SHARE", 10)
    crops = spark.createDataFrame([(p, 0.0, 0.0, 1000.0, 1000.0, 10.0, 1000.0, 1000.0) for p in range(9)], "page int, cx0 double, cy0 double, cx1 double, cy1 double, mm_per_pt double, width_px double, height_px double")
    for n, parts in ((20, 4), (120, 12)):
        segments = spark.createDataFrame([(i % 9, i * 7.0, 0.0, i * 7.0, 500.0) for i in range(n)], "page int, x1 double, y1 double, x2 double, y2 double")
        for made in (region.vector_stations(segments, crops, ["page"]), region.line_samples(segments, crops, ["page"])):
            assert made.count() > 0
            plan = made._jdf.queryExecution().analyzed().toString()
            assert plan.count("RepartitionByExpression [page") == 2 and plan.count(f"], {parts}\n") == 2
