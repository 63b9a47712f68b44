import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ferrolith.operators import cropgrid, grid, ragged

CROP = "page string, cx0 double, cy0 double, cx1 double, cy1 double, width_px double, height_px double, mm_per_pt double"
SPAN = "page string, seq int, x0 double, y0 double, x1 double, y1 double, text string"
SEGMENT = "page string, x1 double, y1 double, x2 double, y2 double"


def value(spark, column, **values):
    rows = spark.createDataFrame([Row(**values)])
    return rows.select(column.alias("v")).first()[0]


def test_labels_take_the_nearest_free_line(spark):
    out = value(spark, cropgrid.labelled_lines(F.col("l"), F.col("v"), F.lit(1000.0), F.lit(10)), l=[100.0, 300.0, 500.0], v=[98.0, 102.0, 295.0, 510.0, 800.0])
    assert out == [98.0, 295.0, 510.0]
    # two labels at one line: the second takes the next one, a label without a line keeps its place
    assert value(spark, cropgrid.labelled_lines(F.col("l"), F.col("v"), F.lit(1000.0), F.lit(10)), l=[100.0, 120.0, 700.0], v=[110.0, 150.0]) == [110.0, 150.0, 700.0]


def test_lines_outside_the_labels_are_dropped(spark):
    keep = cropgrid.within_labels(F.col("lines"), F.col("labels"), F.lit(1000.0))
    assert value(spark, keep, labels=[200.0, 400.0, 600.0], lines=[10.0, 50.0, 210.0, 390.0, 610.0, 900.0]) == [210.0, 390.0, 610.0]
    assert value(spark, keep, labels=[200.0, 400.0], lines=[10.0, 210.0, 900.0]) == [10.0, 210.0, 900.0]


def test_many_lines_are_thinned_and_the_last_stays(spark):
    thin = cropgrid.thinned_lines(F.col("lines"), F.lit(1000.0), F.lit(3))
    assert value(spark, thin, lines=[0.0, 30.0, 60.0]) == [0.0, 30.0, 60.0]
    assert value(spark, thin, lines=[0.0, 30.0, 60.0, 110.0, 160.0, 190.0]) == [0.0, 60.0, 110.0, 190.0]


def page(spark, extra=()):
    crops = spark.createDataFrame([("a", 0.0, 0.0, 1000.0, 1000.0, 1000.0, 1000.0, 10.0), ("none", 0.0, 0.0, 500.0, 500.0, 500.0, 500.0, 1.0)], CROP)
    segments = [("a", x, 0.0, x, 900.0) for x in (105.0, 495.0, 905.0, 980.0)] + [("a", 0.0, y, 900.0, y) for y in (205.0, 795.0)] + [("a", 300.0, 0.0, 300.0, 100.0)]
    spans = [("a", i, x - 5, 970.0, x + 5, 980.0, t) for i, (x, t) in enumerate(((100.0, "1"), (500.0, " 2 "), (900.0, "03")))]
    spans += [("a", 5, 500.0, 500.0, 510.0, 510.0, "7"), ("a", 6, 10.0, 195.0, 20.0, 205.0, "b"), ("a", 7, 10.0, 795.0, 20.0, 805.0, "A"), ("a", 8, 490.0, 210.0, 500.0, 220.0, "c 4"), ("a", 9, 490.0, 211.0, 500.0, 221.0, "C9"), ("a", 10, 300.0, 400.0, 310.0, 410.0, "C5")]
    return spark.createDataFrame(segments, SEGMENT), spark.createDataFrame(spans + list(extra), SPAN), crops


def test_crop_grid_by_labels(spark):
    segments, spans, crops = page(spark)
    found = {(r["page"], r["axis"]): r for r in cropgrid.crop_grid(segments, spans, crops, ["page"]).collect()}
    x, y = found["a", "x"], found["a", "y"]
    assert (x["lines"], x["stations"], x["n_labels"], x["source"]) == ([105.0, 495.0, 905.0], [1050.0, 4950.0, 9050.0], 3, "labels")
    assert (y["lines"], y["stations"]) == ([205.0, 795.0], [7950.0, 2050.0])
    assert found["none", "x"]["lines"] == found["none", "y"]["stations"] == []


def test_clicks_join_the_lines(spark):
    segments, spans, crops = page(spark)
    clicks = spark.createDataFrame([("a", "x", 700.0), ("a", "x", 703.0), ("a", "x", 110.0), ("none", "x", 5.0)], "page string, axis string, at double")
    found = {(r["page"], r["axis"]): r for r in cropgrid.crop_grid(segments, spans, crops, ["page"], clicks).collect()}
    assert found["a", "x"]["lines"] == [107.5, 495.0, 701.5, 905.0] and found["a", "x"]["n_clicks"] == 2
    assert found["a", "y"]["lines"] == [205.0, 795.0] and found["none", "x"]["lines"] == []


def test_a_page_of_many_texts_gives_few_values(spark):
    segments, spans, crops = page(spark)
    i = F.col("id")
    many = spark.range(100_000).select(F.lit("a").alias("page"), i.cast("int").alias("seq"), (i % 9 * 100 + 95.0).alias("x0"), F.lit(970.0).alias("y0"), (i % 9 * 100 + 105.0).alias("x1"), F.lit(980.0).alias("y1"), (i % 9 + 1).cast("string").alias("text"))
    labels = cropgrid.bubble_labels(many, crops, ["page"])
    assert sorted((r["label"], r["at"]) for r in labels.collect()) == [(str(k + 1), 100.0 * (k + 1)) for k in range(9)]
    # texts are averaged in the map side of one shuffle, no list of texts is made
    assert "collect_list" not in labels._jdf.queryExecution().toString()
    assert [len(r["lines"]) for r in cropgrid.crop_grid(segments, many, crops, ["page"]).where("page = 'a' AND axis = 'x'").collect()] == [9]


def test_columns_at_marks(spark):
    segments, spans, crops = page(spark)
    models = cropgrid.extracted_models(cropgrid.crop_grid(segments, spans, crops, ["page"]), crops, ["page"])
    found = [(r["mark"], r["x_px"], r["y_px"], r["ix"], r["iy"]) for r in cropgrid.marked_columns(spans, crops, models, ["page"]).collect()]
    assert found == [("C4", 495.0, 205.0, 1, 0)]


def test_extract_rebuild_and_placements_are_the_identity(spark):
    segments, spans, crops = page(spark, [("a", 20, 100.0, 790.0, 110.0, 800.0, "C1"), ("a", 21, 900.0, 790.0, 910.0, 800.0, "C2")])
    models = cropgrid.extracted_models(cropgrid.crop_grid(segments, spans, crops, ["page"]), crops, ["page"])
    columns = cropgrid.marked_columns(spans, crops, models, ["page"])
    flat = models.select("page", "width_px", "height_px", "mm_x", "mm_y", "span_x", "span_y", *(F.col(f"axis_{a}.{c}").alias(f"{c}_{a}") for a in "xy" for c in ("lines", "stations", "bays")))
    again = cropgrid.rebuilt_models(flat)
    rows = lambda df: sorted(map(tuple, df.collect()))
    axes = [f"axis_{a}" for a in "xy"]
    assert rows(models.select("page", *axes)) == rows(again.select("page", *axes))
    rebuilt = cropgrid.rebuilt_columns(columns, again, ["page"])
    names = ["page", "ord", "id", "mark", "x_px", "y_px", "x_mm", "y_mm", "ix", "iy"]
    assert rows(columns.select(*names)) == rows(rebuilt.select(*names)) and columns.count() == 3
    placed = cropgrid.model_placements(rebuilt, again, ["page"])
    assert rows(placed.select("ord", "mark", "x_mm", "y_mm")) == rows(columns.select("ord", "mark", "x_mm", "y_mm"))


MODEL = "page string, width_px double, height_px double, lines_x array<double>, lines_y array<double>, stations_x array<double>, stations_y array<double>, bays_x array<double>, bays_y array<double>, mm_x double, mm_y double, span_x double, span_y double"


def test_rebuilt_model_of_lines_or_bays(spark):
    models = cropgrid.rebuilt_models(spark.createDataFrame([
        ("lines", 1000.0, 800.0, [0.0, 500.0, 1000.0], [800.0, 400.0, 0.0], None, None, None, None, 10.0, None, None, None),
        ("bays", 1000.0, 800.0, None, [], None, [7.0], [5000.0, 5000.0], [4000.0], 0.0, None, 0.0, 9000.0),
    ], MODEL))
    found = {r["page"]: r for r in models.collect()}
    a, b = found["lines"], found["bays"]
    assert a["axis_x"]["stations"] == [0.0, 5000.0, 10000.0] and a["axis_y"]["stations"] == [0.0, 4000.0, 8000.0]
    assert a["axis_x"]["labels"] == ["1", "2", "3"] and a["axis_y"]["labels"] == ["A", "B", "C"] and a["axis_x"]["bays"] == [5000.0, 5000.0]
    assert b["axis_x"]["stations"] == [0.0, 5000.0, 10000.0] and b["span_x"] == 10000.0 and b["axis_y"]["stations"] == [0.0, 4000.0] and b["span_y"] == 9000.0
    assert (b["mm_x"], b["mm_y"]) == (1.0, 1.0)
    columns = spark.createDataFrame([("lines", 0, "a", "", 1300.0, 390.0, None, None, 0, 0), ("bays", 0, "b", "K", 20.0, -5.0, None, None, 9, 1)], "page string, ord int, id string, mark string, x_px double, y_px double, x_mm double, y_mm double, ix int, iy int")
    found = {r["page"]: (r["mark"], r["x_px"], r["y_px"], r["x_mm"], r["y_mm"]) for r in cropgrid.rebuilt_columns(columns, models, ["page"]).collect()}
    assert found == {"lines": ("C1", 1000.0, 400.0, 10000.0, 4000.0), "bays": ("K", 20.0, 0.0, 10000.0, 4000.0)}


@pytest.mark.parametrize("old, new, ix, expected", [([0.0, 6.0], [0.0, 3.0, 6.0], 1, (2, 6.0, True)), ([0.0, 3.0, 6.0], [0.0, 6.0], 1, (0, 0.0, False)), ([0.0, 6.0], [0.0, 6.0], 5, (1, 6.0, False))])
def test_columns_keep_their_place_between_versions(spark, old, new, ix, expected):
    columns = spark.createDataFrame([("a", 0, ix, 0)], "page string, ord int, ix int, iy int")
    versions = spark.createDataFrame([("a", old, new, [0.0], [0.0])], "page string, old_x array<double>, new_x array<double>, old_y array<double>, new_y array<double>")
    row = cropgrid.moved_columns(columns, versions, ["page"]).first()
    assert (row["ix"], row["x_mm"], row["kept"]) == expected


def test_sparse_analysis_starts_at_its_first_line(spark):
    crops = spark.createDataFrame([("a", [10.0, 110.5], [0.0, 20.0], 10.0), ("b", [3.0, 9.0], None, None)], "page string, lines_x array<double>, lines_y array<double>, mm_per_px double")
    found = {r["page"]: (r["x_text"], r["y_text"]) for r in cropgrid.sparse_analysis(crops).collect()}
    assert found == {"a": ("0, 1005", "0, 200"), "b": ("0, 1", "")}


def test_axes_are_folded_by_batches_and_as_spark_would(spark):
    """Axes of models come of one step a batch, without a lambda, and equal the folds of columns written out."""
    import numpy as np

    draw, r = np.random.default_rng(7), []
    for i in range(400):
        some = lambda n, by: None if draw.random() < 0.1 else [None if draw.random() < 0.03 else float(v) for v in draw.integers(-9, 60, draw.integers(0, n)) * by]
        r.append((i, 1000.0, 800.0, some(9, 7.25), some(60, 14.75), some(70, 0.75), some(9, 333.35), some(4, 100.05), some(3, 0.55), float(draw.integers(1, 9)) / 4, 2.55, None, 9.0))
    names = ("lines_x", "lines_y", "stations_x", "stations_y", "bays_x", "bays_y")
    models = spark.createDataFrame(r, "page long, width_px double, height_px double, " + ", ".join(f"{n} array<double>" for n in names) + ", mm_x double, mm_y double, span_x double, span_y double")
    for a in "xy":
        plan = cropgrid.synced_axis(models, a)._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and plan.count("ArrowEvalPython") == 1
    c, known, empty = F.col, lambda n: F.coalesce(n, F.array().cast("array<double>")), F.array().cast("array<double>")
    rows = models
    for a in "xy":
        start = F.array(F.lit(0.0))
        sums = F.aggregate(known(f"bays_{a}"), start, lambda acc, b: F.concat(acc, F.array(F.round(F.element_at(acc, -1) + b, 1))))
        rows = rows.withColumn(f"g{a}", grid.axis_positions(known(f"stations_{a}")))
        rows = rows.withColumn(f"g{a}", F.when((F.size(f"g{a}") < 2) & (F.size(known(f"bays_{a}")) > 0), sums).otherwise(c(f"g{a}")))
        gap = 10.0 if a == "x" else 8.0
        far = lambda acc, v: (F.size(acc) == 0) | (v - F.try_element_at(acc, F.lit(-1)) >= gap)  # noqa: B023, E731
        rows = rows.withColumn(f"l{a}", F.aggregate(F.array_sort(F.array_compact(known(f"lines_{a}"))), empty, lambda acc, v: F.when(far(acc, v), F.concat(acc, F.array(v))).otherwise(acc)))  # noqa: B023
        stops = cropgrid.station_list(c(f"l{a}"), c(f"mm_{a}"), c("height_px"), F.lit(a == "x"))
        rows = rows.withColumn(f"s{a}", grid.axis_positions(F.when(F.size(f"l{a}") >= 2, stops).otherwise(c(f"g{a}"))))
        rows = rows.withColumn(f"b{a}", F.transform(grid.widths(c(f"s{a}")), lambda b: F.round(b, 1)))
        rows = rows.withColumn(f"n{a}", F.filter(F.transform(f"l{a}", lambda v, i: grid.axis_labels(i, F.lit(a))), lambda t: t.isNotNull()))  # noqa: B023
        rows = rows.withColumn(f"e{a}", F.greatest(F.coalesce(F.nullif(f"span_{a}", F.lit(0.0)), F.lit(1.0)), F.try_element_at(f"g{a}", F.lit(-1))))
    expected = {r[0]: r[1:] for r in rows.select("page", *(f"{k}{a}" for a in "xy" for k in "lsbne")).collect()}
    found = cropgrid.rebuilt_models(models).select("page", *(f for a in "xy" for f in (f"axis_{a}.lines", f"axis_{a}.stations", f"axis_{a}.bays", f"axis_{a}.labels", f"span_{a}"))).collect()
    assert {r[0]: r[1:] for r in found} == expected


def test_rounding_of_batches_is_that_of_spark(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    values = [*(draw.integers(-(10**6), 10**6, 500) / 20.0), *(draw.random(500) * 10.0 ** draw.integers(-6, 16, 500)), 0.25, 1.05, -0.05, -0.04, 2.675, 1e300, float("inf"), 1e22, 123456789012.25]
    expected = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(F.round("v", 1)).collect()]
    assert list(ragged.rounded(np.array(values, float), 1)) == expected


def test_an_axis_is_read_and_folded_once(spark):
    segments, spans, crops = page(spark)
    clicks = spark.createDataFrame([("a", "x", 700.0)], "page string, axis string, at double")
    planned = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    grid_plan = planned(cropgrid.crop_grid(segments, spans, crops, ["page"], clicks))
    # the strokes' clusters and the clicks' are chains of rows, all other clusters are of the lists of an axis
    assert grid_plan.count("Window [") <= 4 and "aggregate(" not in grid_plan
    # texts and places of labels are not written out again in each condition on them
    plan = planned(cropgrid.bubble_labels(spans, crops, ["page"]))
    assert plan.count("upper(trim(") <= 2 and plan.count("/ 2.0)") <= 2


def test_many_clicks_at_one_place_weigh_as_many(spark):
    segments, spans, crops = page(spark)
    clicks = spark.createDataFrame([("a", "x", 700.0)] * 3 + [("a", "x", 710.0)], "page string, axis string, at double")
    found = {(r["page"], r["axis"]): r for r in cropgrid.crop_grid(segments, spans, crops, ["page"], clicks).collect()}
    assert found["a", "x"]["lines"] == [105.0, 495.0, 702.5, 905.0] and found["a", "x"]["n_clicks"] == 1
