"""Repair of specifications, submodels of crops, attempts, and rules that were once wrong."""

import random

from pyspark.sql import functions as F

from ferrolith.operators import details, drawing, region, repair, resolve, textspec

ELEMENTS = "model_id int, seq long, role string, profile string, length_mm double, x double, y double, z double"


def specs(spark):
    rows = [
        (1, 0, "column", "HEA100", 3000.0, 5.0, 0.0, 0.0), (1, 1, "column", "HEA100", 3000.0, 90.0, 0.0, 0.0), (1, 2, "beam", "IPE100", 80.0, 0.0, 0.0, 0.0), (1, 3, "plate", "P10", 50.0, 7.0, 0.0, 0.0),
        (2, 4, "column", "HEB140", 2800.0, 1.0, 2.0, 0.0), (2, 5, "beam", "IPE160", 4400.0, 0.0, 0.0, 9.0),
        (3, 0, "column", "HEA100", 3000.0, 5.0, 0.0, 0.0), (3, 1, "beam", "IPE100", 80.0, 0.0, 0.0, 2999.8), (3, 2, "beam", "IPE100", 80.0, 0.0, 0.0, 9999.0), (4, 0, "column", None, None, 1.0, 0.0, 0.0),
    ]
    texts = [
        (1, "A beam on top of 2 columns, height 4 m and span 6000 mm"), (2, "beam resting on 3 columns at (7, 250, 100)"), (3, "some steel"), (4, None),
    ]
    keys = spark.createDataFrame([(1, "column", "HEB300"), (1, "beam", "IPE400")], "model_id int, role string, key string")
    return spark.createDataFrame(rows, ELEMENTS), repair.locks(spark.createDataFrame(texts, "model_id int, text string"), keys)


def test_repair_by_text(spark):
    elements, locked = specs(spark)
    after, log = repair.repaired(elements, locked)
    got = {(r["model_id"], r["seq"]): tuple(r)[2:] for r in after.collect()}
    assert got[1, 0] == ("column", "HEB300", 4000.0, 0.0, 0.0, 0.0) and got[1, 1] == ("column", "HEB300", 4000.0, 6000.0, 0.0, 0.0)
    assert got[1, 2] == ("beam", "IPE400", 6000.0, 0.0, 0.0, 4000.0) and got[1, 3] == ("plate", "P10", 50.0, 7.0, 0.0, 0.0)
    # one column where three are stated: built anew over the beam's own length, with the sections that are there
    assert [got[2, i] for i in range(4)] == [("column", "HEB140", 2800.0, 2200.0 * i, 250.0, 100.0) for i in range(3)] + [("beam", "IPE160", 4400.0, 0.0, 250.0, 2900.0)]
    assert got[3, 1][-1] == 2999.8 and got[3, 2][-1] == 9999.0 and got[4, 0] == ("column", None, None, 1.0, 0.0, 0.0) and len(got) == 12
    changes = {(r["model_id"], r["seq"], r["field"]): (r["old"], r["new"], r["rule"]) for r in log.collect()}
    assert changes[1, 2, "z"] == ("0.0", "4000.0", "raised") and changes[1, 1, "x"] == ("90.0", "6000.0", "spread") and changes[1, 0, "profile"] == ("HEA100", "HEB300", "section")
    assert {k for k in changes if k[0] == 2} == {(2, s, "element") for s in (0, 1, 2, 3, 4, 5)} and not [k for k in changes if k[0] > 2]


def test_repair_is_idempotent(spark):
    elements, locked = specs(spark)
    once = repair.repaired(elements, locked)[0]
    twice, log = repair.repaired(once, locked)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect())) and log.count() == 0
    assert repair.repaired(elements.limit(0), locked)[0].count() == 0


def test_measures_of_texts(spark):
    texts = ["height 4500 mm, length: 12 m, width 7.5m, 4 columns", "HEB240 column, span 9000", 'גובה 3000 מ"מ', "IPE300 spanning 5400, 6000 mm wide", "a HEB200 of height 2750", "1 column at y = 40, 5 m high", "3 מטר גובה, אורך 8 מטר", ""]
    rows = textspec.text_dimensions(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    got = [(r["height_mm"], r["span_mm"], r["width_mm"], r["n_columns"]) for r in rows]
    assert got == [
        (4500.0, 12000.0, 7500.0, 4), (3500.0, 9000.0, 4000.0, 3), (3000.0, 6000.0, 4000.0, 3), (3500.0, 5400.0, 6000.0, 3), (2750.0, 6000.0, 4000.0, 3), (5000.0, 6000.0, 4000.0, 2), (3000.0, 8000.0, 4000.0, 3), (3500.0, 6000.0, 4000.0, 3),
    ]


MEMBERS = "doc_id int, page_index int, crop_id string, seq long, sx double, sy double, sz double, ex double, ey double, ez double"


def test_submodels_across_cell_borders_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        ends = [rng.choice([0.0, 124.0, 126.0, 500.0, 374.0, 380.0]) + rng.uniform(-3, 3) for _ in range(6)]
        rows.append((1, i % 2, "a", i, *ends))
        if i % 3 == 0:
            rows.append((1, i % 2, "b", 100 + i, *(v + rng.uniform(-40, 40) for v in (ends[3:] + ends[:3]))))
    crops = spark.createDataFrame([(1, p, c, 0.0, 0.0, 0.0, None) for p in (0, 1) for c in "ab"], "doc_id int, page_index int, crop_id string, x0 double, y1 double, page_height double, mm_per_pt double")
    got = drawing.merged_submodels(spark.createDataFrame(rows, MEMBERS), crops, 250.0, across_cells=True).collect()
    quantized = lambda r: tuple(sorted([tuple(round(v / 250) for v in r[4:7]), tuple(round(v / 250) for v in r[7:])]))
    length = lambda r: sum((a - b) ** 2 for a, b in zip(r[4:7], r[7:]))
    groups = {}
    for r in rows:
        groups.setdefault((r[1], quantized(r)), []).append(r)
    heads = [(max(g, key=lambda r: (length(r), -r[3])), len(g)) for g in groups.values()]
    close = lambda a, b: a[1] == b[1] and any(all(abs(x - y) <= 125 for x, y in zip(a[4:], o)) for o in (b[4:], b[7:] + b[4:7]))
    want, left = set(), list(heads)
    while left:
        mine, front = [], [left.pop()]
        while front:
            one = front.pop()
            mine.append(one)
            near = [h for h in left if close(one[0], h[0])]
            left = [h for h in left if h not in near]
            front += near
        best = max(mine, key=lambda h: (length(h[0]), -h[0][3]))[0]
        want.add((best[3], sum(n for _, n in mine)))
    assert {(r["seq"], r["n_same"]) for r in got} == want and len(want) < len(heads)


def test_first_attempt_by_hand(spark):
    seg = lambda doc, page, x2, y2, stroke=1.0: (doc, page, 0.0, 0.0, x2, y2, stroke, 0)
    rows = [seg(1, 0, 700.0, 0.0), seg(1, 1, 900.0, 0.0), seg(1, 1, 901.0, 0.0), seg(2, 0, 300.0, 0.0), seg(3, 0, 500.0, 470.0), seg(4, 0, 1.0, 0.0)]
    pages = spark.createDataFrame([(1, 0, [1.0], 0.0), (1, 1, [1.0], 5.0), (2, 0, [0.1, 1.0], 0.0), (3, 0, [1.0], 0.0), (4, 0, [1.0, 0.3], 0.0)], "doc_id int, page_index int, scales array<double>, threshold double")
    got = {r["doc_id"]: tuple(r)[1:] for r in drawing.first_attempt(spark.createDataFrame(rows, "doc_id int, page_index int, x1 double, y1 double, x2 double, y2 double, stroke double, seq int"), pages).collect()}
    # page 1 of document 1 scores higher; its lines are thinner than half its stroke; document 4 has nothing left
    assert got == {1: (1, 1.0, 600.0, 0.0, True, 2), 2: (0, 1.0, 200.0, 0.0, True, 1), 3: (0, 1.0, 600.0, 0.0, True, 1)}


def test_words_that_make_a_hole(spark):
    df = spark.createDataFrame([("Slotted head bolt M20",), ("recess bolt",), ("Bolt hole M20",), ("opening",), ("shop hole",)], "name string")
    assert [r[0] for r in df.select(resolve.connection_bolt(df.name, F.lit(50.0), F.lit(True))).collect()] == [True, True, False, False, False]


def test_sizes_must_be_finite(spark):
    rows = [(1, i, "beam", None, None, 1, "I", d) for i, d in enumerate(([1.0, 2.0, 3.0], [1.0, float("nan"), 3.0], [float("inf"), 2.0, 3.0], [0.0, 2.0, 3.0], [None, 2.0, 3.0]))]
    df = spark.createDataFrame(rows, "m int, id int, role string, height_mm double, grid_position int, n_supports int, shape string, dimensions array<double>")
    assert {r["id"] for r in details.schema_errors(df, ["m"]).where("error = 'dimension_not_positive'").collect()} == {1, 2, 3, 4}


def test_the_last_of_equal_lines_is_the_last_drawn(spark):
    rows = [(1, 0, 0.0, 0.0, 100.0, 0.0, 1.0, 5), (1, 0, 0.0, 4.0, 100.0, 4.0, 1.0, 2), (1, 0, 0.0, 300.0, 100.0, 300.0, 1.0, 9), (1, 0, 0.0, 301.0, 90.0, 301.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "doc_id int, page_index int, x1 double, y1 double, x2 double, y2 double, stroke double, seq int")
    merged = drawing.merged_segments(df, 25.0).collect()
    assert {(r["y1"], r["seq"]) for r in merged} == {(0.0, 2), (300.0, 1)}
    assert drawing.dedupe_last(df.where("seq IN (5, 2)"), 25.0).first()["y1"] == 0.0


def test_unsure_detections_are_dropped(spark):
    a, b, two = [0.0, 5000.0, 10000.0], [0.0, 4000.0, 8000.0, 12000.0], [0.0, 6000.0]
    rows = [(1, b, b, a, two, 0.9), (2, [0.0, 900.0], [0.0, 800.0], a, two, 0.2), (3, b, [1.0], a, two, 0.2), (4, [1.0], None, a, None, 0.9)]
    df = spark.createDataFrame(rows, "page int, x array<double>, y array<double>, given_x array<double>, given_y array<double>, confidence double")
    got = {r["page"]: (r["merged_x"], r["merged_y"]) for r in region.merged_analysis(df).collect()}
    assert got[1] == (b, b) and got[2] == (a, two) and got[3] == (b, two) and got[4] == (a, [])
