import itertools
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ferrolith.operators import bolts, buildings, drawing, graph, grid, members, resolve, rollup, search, spatial, textspec
from ferrolith.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()[0]


def components(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("seed", range(3))
def test_connected_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == components(edges)


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_chain_clusters(spark):
    rows = spark.createDataFrame([("p", v) for v in (100.0, 98.0, 102.0, 295.0, 300.0, 500.0)], "page string, v double")
    assert [r["line"] for r in grid.cluster_1d(rows, ["page"], "v", 10.0).orderBy("line").collect()] == [100.0, 297.5, 500.0]


def test_grid_quality_rejects_edges(spark):
    crops = spark.createDataFrame([("a", 0.0, 0.0, 800.0, 600.0), ("b", 0.0, 0.0, 800.0, 600.0)], "page string, x0 double, y0 double, x1 double, y1 double")
    good = [("a", "x", v) for v in (100.0, 300.0, 500.0, 700.0)] + [("a", "y", v) for v in (100.0, 300.0, 500.0)]
    bad = [("b", "x", float(v)) for v in range(40)] + [("b", "y", v) for v in (100.0, 300.0)]
    got = {r["page"]: r["accepted"] for r in grid.quality(spark.createDataFrame(good + bad, "page string, axis string, line double"), crops, ["page"]).collect()}
    assert got == {"a": True, "b": False}


def test_pins_snap_to_nearest_lines(spark):
    lines = spark.createDataFrame([("p", "x", 100.0), ("p", "x", 300.0), ("p", "y", 100.0), ("p", "y", 200.0)], "page string, axis string, line double")
    pins = spark.createDataFrame([("p", 310.0, 195.0, 0, None)], "page string, x double, y double, ord int, mark string")
    r = grid.snap_pins(pins, lines, ["page"]).first()
    assert (r["x_line"], r["y_line"], r["x_index"], r["y_index"], r["mark"]) == (300.0, 200.0, 1, 1, "C1")


@pytest.mark.parametrize(
    "numbers, stations",
    [([0.0, 150.0, 810.0, 1460.0, 19050.0], [0.0, 150.0, 810.0, 1460.0, 19050.0]), ([810.0, 650.0, 2810.0, 3850.0], [0.0, 810.0, 1460.0, 4270.0, 8120.0]), ([5.0], [])],
)
def test_dimension_chain(spark, numbers, stations):
    assert one(spark, grid.chain_stations(F.col("v")), v=numbers) == stations


def test_axis_positions_modes(spark):
    assert one(spark, grid.axis_positions(F.col("v")), v=[6000.0, 6000.0, 3000.0]) == [0.0, 3000.0, 9000.0]
    assert one(spark, grid.axis_positions(F.col("v"), "ordered"), v=[6000.0, 6000.0, 3000.0]) == [0.0, 6000.0, 12000.0, 15000.0]


def test_min_gap_fold(spark):
    assert one(spark, grid.min_gap_fold(F.col("v"), 4.9), v=[0.0, 3.0, 5.0, 9.0, 10.0, 15.0]) == [0.0, 5.0, 10.0, 15.0]


def test_labels_take_unused_vectors(spark):
    assert one(spark, grid.snap_labels(F.col("l"), F.col("v"), 20.0), l=[100.0, 104.0, 500.0], v=[98.0, 110.0, 800.0]) == [98.0, 110.0, 500.0]


def test_interval_union(spark):
    rows = [("d", 0, 0.0, 0.0, 1000.0, 0.0), ("d", 0, 400.0, 1.0, 500.0, 1.0), ("d", 0, 1020.0, 0.0, 1500.0, 0.0), ("d", 0, 3000.0, 0.0, 3010.0, 0.0)]
    got = drawing.merge_intervals(spark.createDataFrame(rows, "doc_id string, page_index int, x1 double, y1 double, x2 double, y2 double"), 25.0).collect()
    assert [(r["a"], r["b"], r["n_merged"]) for r in got] == [(0.0, 1500.0, 3)]


def test_scale_notes(spark):
    for note, scale in (("1.5 mm / pt", 1.5), ("units: mm", 1.0), ("grid = 6000", 1.0), ("scale 1:100", None), (None, None)):
        got = spark.createDataFrame([(note,)], "n string").select(drawing.scale_of_note(F.col("n"))).first()[0]
        assert got == scale


def test_natural_order(spark):
    rows = spark.createDataFrame([(x,) for x in ("b12", "A10", "a2", "a1", "b2")], "v string")
    assert [r["v"] for r in rows.orderBy(rollup.natural_key("v")).collect()] == ["a1", "a2", "A10", "b2", "b12"]


def test_rollup_of_missing_weights(spark):
    rows = spark.createDataFrame([("P1", "IPE", None, None), ("P1", "IPE", float("nan"), 2.5), ("P2", "3.6e-05", 4.0, 1.0)], "mark string, profile string, weight double, quantity double")
    got = {r["profile"]: (r["quantity"], r["weight"]) for r in rollup.profile_rollup(rows).collect()}
    assert got == {"IPE": (4, None), rollup.UNNAMED: (1, 4.0)}


def test_generated_tags_are_no_labels(spark):
    rows = spark.createDataFrame([(None, "ID" + "0a" * 16, 1234), (None, "T7", 1), (" M1 ", "x", 1)], "mark string, tag string, express_id long")
    assert [r[0] for r in rows.select(rollup.part_label()).collect()] == ["#1,234", "T7", "M1"]


def test_title_ranks(spark):
    rows = spark.createDataFrame([("C2", "c2"), ("C21", "c2"), ("A-C2", "c2"), ("PLC2", "c2"), ("a.b", "a.b")], "f string, q string")
    assert [r[0] for r in rows.select(search.title_rank(F.col("f"), F.col("q"))).collect()] == [0.0, 0.01, 1.0001, None, 0.0]


def test_query_intents(spark):
    rows = spark.createDataFrame([(q,) for q in ("HEB 280", "ub305", "L120x120x10", "C41", "red beam", "")], "q string")
    assert [r[0] for r in rows.select(search.intent(F.col("q"))).collect()] == ["profile-heavy", "profile-heavy", "profile-heavy", "mark-heavy", "neutral", "neutral"]


def test_guid_spellings(spark):
    plain = "0123456789abcdef0123456789ABCDEF"
    dashed = "{01234567-89ab-cdef-0123-456789abcdef}"
    rows = spark.createDataFrame([(plain,), (dashed,), (" ",)], "g string")
    keys = [r[0] for r in rows.select(bolts.guid_key(F.col("g"))).collect()]
    assert keys == [plain.upper(), plain.upper(), None]
    assert len(rows.select(bolts.guid_variants(F.col("g"))).first()[0]) == 4


def test_bolts_of_neighbours_are_counted_without_rows_of_their_own(spark):
    ids = [-300, -1, 0, 63, 64, 127, 191, 255, 256, 257, 2**40 + 63, None]
    links = spark.createDataFrame([(b, i % 5) for i, b in enumerate(ids)] + [(63, 0), (63, 1), (319, 7)], "bolt_id long, part_id long")
    members = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 2), (3, 3), (4, 6), (5, 7), (6, 4)], "assembly_id long, part_id long")
    pairs = bolts.neighbourhood_bolts(members, links).groupBy("part_id").agg(F.count(F.lit(1)), F.min("bolt_id"), F.max("bolt_id"))
    found = sorted(map(tuple, bolts.neighbourhood_summary(members, links).collect()))
    assert found == sorted(map(tuple, pairs.collect())) and found[-1] == (7, 1, 319, 319)


def test_reach_follows_hyperedges(spark):
    links = spark.createDataFrame([(1, "beam"), (1, "plate"), (2, "plate"), (2, "bracket"), (3, "far")], "bolt_id long, part_id string")
    asm = spark.createDataFrame([("a", "rib"), ("a", "bracket"), ("b", "alone")], "assembly_id string, part_id string")
    got = {}
    for r in bolts.reach_bolts(asm, links).collect():
        got.setdefault(r["part_id"], set()).add(r["bolt_id"])
    assert got == {"beam": {1, 2}, "plate": {1, 2}, "bracket": {1, 2}, "rib": {1, 2}, "far": {3}}


@pytest.mark.parametrize("text, number, quantity", [("1,234.5", 1234.5, None), ("+7", 7.0, 7.0), ("2,5", 25.0, 2.5), ("-3", -3.0, None), ("true", None, None), (None, None, None)])
def test_two_comma_rules(spark, text, number, quantity):
    rows = spark.createDataFrame([(text,)], "v string").select(resolve.to_number(F.col("v")), resolve.to_quantity(F.col("v")))
    assert tuple(rows.first()) == (number, quantity)


def test_profile_candidates(spark):
    rows = spark.createDataFrame([(v,) for v in ("HEB200", "0.0001", "12", "n/a", "100*50", "x" * 161, None)], "v string")
    assert [r[0] for r in rows.select(resolve.profile_candidate(F.col("v"))).collect()] == ["HEB200", None, None, None, "100*50", None, None]


def test_unwrapping(spark):
    rows = spark.createDataFrame([(v,) for v in ('["a"]', '["a","3"]', '{"NominalValue":"z"}', "plain")], "v string")
    assert [r[0] for r in rows.select(resolve.unwrapped(F.col("v"))).collect()] == ["a", "3", "z", "plain"]


def test_closure_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    got = resolve.closure(edges, spark.createDataFrame([("a",)], "node string"))
    assert sorted((r["node"], r["depth"]) for r in got.collect()) == [("a", 0), ("b", 1), ("c", 2)]


@pytest.mark.parametrize("name, key, family", [("heb200", "HEB200", "HEB"), ("RHS100X100X5", "100x100x5", "RHS"), ("SHS100x5", "100x100x5", "RHS"), ("CHS 168.3x5", "CHS168.3x5", "CHS"), ("L100x100x10", "L100x100x10", "L"), ("oak", None, None)])
def test_profile_forms(spark, name, key, family):
    r = one(spark, members.resolved_profile(F.col("n")), n=name)
    assert (r["key"], r["family"]) == (key, family)


MEMBER = "model_id int, member_id string, profile string, sx double, sy double, sz double, ex double, ey double, ez double, seq int"


def brute_connectivity(rows, tol):
    ends = [p for r in rows for p in (r[3:6], r[6:9])]
    links = [(i, j) for i, j in itertools.combinations(range(len(ends)), 2) if math.dist(ends[i], ends[j]) <= tol]
    groups = components(links + [(i, i) for i in range(len(ends))])
    sizes = [list(groups.values()).count(g) for g in set(groups.values())]
    return len(sizes), max(sizes), sizes.count(1)


@pytest.mark.parametrize("seed", range(3))
def test_connectivity_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(1, f"m{i}", "HEB200", *(rng.uniform(0, 3500) for _ in range(6)), i) for i in range(60)]
    r = members.connectivity(spark.createDataFrame(rows, MEMBER)).first()
    assert (r["n_clusters"], r["largest"], r["n_floating"]) == brute_connectivity(rows, 400.0)


def test_sanitize_suffixes(spark):
    rows = [(1, "a", "p", 0.0, 0.0, 0.0, 0.0, 0.0, z, i) for i, z in enumerate((100.0, 100.0, 0.5, 100.0))]
    assert sorted(r["member_id"] for r in members.sanitize(spark.createDataFrame(rows, MEMBER)).collect()) == ["a", "a_2", "a_3"]


def test_four_corner_placeholder(spark):
    corners = [(0.0, 0.0), (6000.0, 0.0), (0.0, 6000.0), (6000.0, 6000.0)]
    rows = [(1, f"c{i}", "p", x, y, 0.0, x, y, 3000.0, i) for i, (x, y) in enumerate(corners)]
    rows += [(1, f"b{i}", "p", 0.0, float(i * 6000), 3000.0, 6000.0, float(i * 6000), 3000.0, 9 + i) for i in range(2)]
    assert members.placeholder(spark.createDataFrame(rows, MEMBER)).first()["placeholder"]


@pytest.mark.parametrize("seed", range(2))
def test_box_overlaps_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        lo = [rng.uniform(-3, 3) for _ in range(3)]
        rows.append((1, i, *(v for a in lo for v in (a, a + rng.uniform(0.1, 2)))))
    df = spark.createDataFrame(rows, "model_id int, element_id int, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    got = {(r["element_id"], r["other_id"]) for r in spatial.overlaps(df, df, 0.8).collect()}
    meet = lambda a, b: all(a[i] <= b[i + 1] and b[i] <= a[i + 1] for i in (2, 4, 6))
    assert got == {(a[1], b[1]) for a in rows for b in rows if meet(a, b)}


def test_line_through_box(spark):
    box = dict(min_x=0.0, max_x=1.0, min_y=0.0, max_y=1.0, min_z=0.0, max_z=1.0)
    hit = one(spark, spatial.line_box(), ox=-1.0, oy=0.5, oz=0.5, dx=1.0, dy=0.0, dz=0.0, **box)
    assert (hit["t0"], hit["t1"]) == (1.0, 2.0)
    assert one(spark, spatial.line_box(), ox=-1.0, oy=1.5, oz=0.5, dx=1.0, dy=0.0, dz=0.0, **box) is None


def test_lines_and_boxes_meet_in_cells(spark):
    """The same hits as by trying all pairs of a model: boxes of all sizes, slanted and upright lines, values that are missing."""
    rng = random.Random(5)
    box = lambda size: [v for a in "xyz" for lo in [rng.uniform(-3, 3)] for v in (lo, lo + rng.uniform(0, size))]
    boxes = [(i % 3, i, *box(0.2 if i % 10 else 4.0)) for i in range(400)] + [(0, 400, None, None, 0.0, 1.0, 0.0, 1.0), (0, 401, 0.0, 1.0, math.nan, math.nan, 0.0, 1.0), (0, 402, 0.0, 1.0, -math.inf, math.inf, 0.0, 1.0)]
    boxes += [(0, 403 + i, float(i), i + 1.0, 0.0, 1.0, 0.0, 1.0) for i in range(3)]
    unit = lambda: [rng.choice((0.0, 1.0, -1.0, 1e-10, rng.uniform(-1, 1), rng.uniform(-1, 1))) for _ in "xyz"]
    lines = [(i % 4, i, *(rng.uniform(-4, 4) for _ in "xyz"), *unit()) for i in range(400)] + [(0, 400, None, 0.5, 0.5, 0.0, 1.0, 0.0), (0, 401, 0.5, 0.5, 0.5, None, 1.0, 0.0), (0, 402, 0.5, 0.5, 0.5, math.nan, 1.0, 0.0)]
    lines += [(0, 403, -5.0, 1.0, 1.0, 1.0, 0.0, 0.0), (0, 404, 1.0, 0.0, 50.0, 0.0, 0.0, -2.0), (0, 405, -1.0, -1.0, -1.0, 3.0, 3.0, 3.0)]
    boxes = spark.createDataFrame(boxes, "model_id int, element_id int, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    lines = spark.createDataFrame(lines, "model_id int, line_id int, ox double, oy double, oz double, dx double, dy double, dz double")
    plain = lines.join(boxes, "model_id").withColumn("t", spatial.line_box()).where("t IS NOT NULL").select("line_id", "element_id", "t.t0", "t.t1")
    found = spatial.line_boxes(lines, boxes, 0.2).select("line_id", "element_id", "t.t0", "t.t1")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect())) and plain.count() > 250
    here = spatial.boxes_of_lines(lines.where("line_id < 400"), boxes.where("element_id < 400"), 0.2).count()
    assert here * 3 < lines.where("line_id < 400").join(boxes.where("element_id < 400"), "model_id").count()


def test_text_measures(spark):
    rows = spark.createDataFrame([("column height 4.5 m and span of 12 m, width 8000 mm, 5 columns",), ("",)], "text string")
    got = [tuple(r)[1:] for r in textspec.text_dimensions(rows).collect()]
    assert got == [(4500.0, 12000.0, 8000.0, 5), (3500.0, 6000.0, 4000.0, 3)]


def test_mentions_carry_places(spark):
    rows = spark.createDataFrame([(1, "use HEB 200, then IPE300 and RHS100X100X5")], "id int, text string")
    got = sorted((r["place"], r["key"]) for r in textspec.profile_mentions(rows, "id").collect())
    assert got == [(4, "HEB200"), (18, "IPE300"), (29, "100x100x5")]


def test_selection_toggles(spark):
    rows = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [2, 3]), (1, 3, [1, 2])], "s int, seq int, ids array<long>")
    assert jobs.selection_state(rows, "s").first()["selected"] == [3]


def test_bolt_flags_and_quantity(spark):
    from ferrolith.operators import extract

    schema = "model_id int, element_id string, pset string, pset_ord int, prop string, prop_ord int, value string"
    props = spark.createDataFrame([(1, "a", "Tekla Bolt", 0, "Nut Count", 0, "2"), (1, "b", "Tekla Bolt", 0, "Hole only", 0, "Yes"), (1, "c", "Common", 0, "Is main part", 0, "TRUE")], schema)
    elements = spark.createDataFrame([(1, x, "M20", None, None, "IfcBeam") for x in "abc"] + [(1, "d", "Shop hole", None, None, "IfcFastener")], "model_id int, element_id string, name string, object_type string, predefined_type string, ifc_type string")
    flags = {r["element_id"]: (r["hole"], r["hardware"]) for r in extract.bolt_flags(elements, props).collect()}
    assert flags == {"a": (False, True), "b": (True, False), "c": (False, False), "d": (True, False)}
    assert {r["element_id"] for r in extract.fasteners(elements, props).where("is_fastener").collect()} == {"a", "b", "d"}
    assert {r["element_id"] for r in extract.main_part(props).where("main_part").collect()} == {"c"}
    assert {r["element_id"]: r["quantity"] for r in extract.bolt_quantity(props).collect()} == {"a": 2.0, "b": 1.0, "c": 1.0}


def test_walls_of_hollow_profiles(spark):
    from ferrolith.operators import extract

    rows = spark.createDataFrame([(p,) for p in ("RHS100*50*5", "TUBE273*8,5", "HEB200*3", "RHS100", None)], "p string")
    assert [r[0] for r in rows.select(extract.wall_thickness(F.col("p"))).collect()] == [5.0, 8.5, None, None, None]


def test_beams_wait_for_their_supports(spark):
    from ferrolith.operators import layout

    nodes = spark.createDataFrame(
        [(1, "c1", "column", 3000.0, 0, 0), (1, "c2", "column", 3000.0, 0, 1), (1, "b1", "beam", None, None, None), (1, "b2", "beam", None, None, None), (1, "b3", "beam", None, None, None)], "model_id int, node_id string, kind string, height double, row int, col int"
    ).withColumns({"span_x": F.lit(6000.0), "span_y": F.lit(5000.0)})
    supports = spark.createDataFrame([(1, "b2", "b1", 0), (1, "b1", "c1", 0), (1, "b1", "c2", 1), (1, "b3", "gone", 0)], "model_id int, beam_id string, support_id string, ord int")
    got = {r["node_id"]: (r["sx"], r["ex"]) for r in layout.place_supports(nodes, supports).collect()}
    assert got == {"c1": (0.0, 0.0), "c2": (6000.0, 6000.0), "b1": (0.0, 6000.0), "b2": (0.0, 6000.0)}


def test_small_tables_are_dealt_before_the_work_on_each_row(spark):
    """A table of one task is worked on by as many as there are partitions."""
    parts = spark.createDataFrame([(i, f"bolt {i}", "HEB 200") for i in range(64)], "part_id long, mark string, profile string").coalesce(1)
    texts = parts.select("part_id", F.lit("Mezzanine Floor Z = 3000 mm").alias("text"))
    assert search.with_queries(parts, ["bolt"]).rdd.getNumPartitions() == 4
    for made in (search.part_hits(parts, ["bolt"]), textspec.level_table(texts, "part_id"), buildings.building_requests(texts, "part_id")):
        assert "RepartitionByExpression" in made._jdf.queryExecution().analyzed().toString() or "Repartition 4" in made._jdf.queryExecution().analyzed().toString()


def test_groups_of_a_specification_are_weighed_in_one_place(spark):
    rows = [(1, "columns_along_y_min", "quantity"), (1, "main_columns", "base"), (1, "joists_along_x_spaced_y", "quantity"), (1, "rails", "quantity"), (1, None, "quantity"), (1, "rails", "base"), (2, "rails", "quantity"), (2, "rails", "level")]
    rows += [(3, g, "quantity") for g in ("beams_along_y_per_x", "diagonals_per_x", "a", "b", "c")] + [(3, "a", "base"), (4, "knee_braces_2", "base"), (4, "diagonals_per_x", "quantity"), (None, "rails", "quantity"), (5, "rails", None)]
    made = textspec.group_precedence(spark.createDataFrame(rows, "id int, group_id string, origin string"), "id")
    assert sorted(map(tuple, made.collect()), key=repr) == sorted([(1, "joists_along_x_spaced_y", "quantity"), (1, "main_columns", "base"), (1, None, "quantity"), (1, "rails", "base"), (2, "rails", "level"), *(r for r in rows if r[0] == 3 and r[2] == "quantity"), (4, "knee_braces_2", "base")], key=repr)
    assert "Join" not in made._jdf.queryExecution().analyzed().toString()


def test_reach_of_many_components_and_parts_without_links(spark):
    """As by brute force; an assembly of one component tells its parts nothing new, and links are joined part by part."""
    rng = random.Random(3)
    links = [(rng.randrange(40), rng.randrange(60)) for _ in range(45)] + [(None, 3), (5, None)]
    members = [(rng.randrange(30), rng.randrange(90)) for _ in range(80)] + [(None, 1)]
    listed = [(rng.randrange(30), rng.randrange(40)) for _ in range(40)]
    tables = [spark.createDataFrame(t + t[:20], s) for t, s in ((members, "assembly_id int, part_id int"), (links, "bolt_id int, part_id int"), (listed, "assembly_id int, bolt_id int"))]
    named = [(b, p) for b, p in links if b is not None and p is not None]
    of = components([(f"b{b}", f"p{p}") for b, p in named])
    want = {}
    for p in range(90):
        mates = {p} | {m for a, m in members if a is not None and (a, p) in members}
        if got := {b for b, _ in named for m in mates if of[f"b{b}"] == of.get(f"p{m}")}:
            want[p] = (len(got), min(got))
    assert {r[0]: tuple(r)[1:] for r in bolts.reach_summary(*tables[:2]).collect()} == want
    rows = bolts.isolation_policy(spark.range(90).select(F.col("id").cast("int").alias("part_id")), *tables).collect()
    lists = {p: {b for a, b in listed if (a, p) in members} for p in range(90)}
    assert {r["part_id"]: (r["source"], r["n_bolts"]) for r in rows} == {p: ("relation", want[p][0]) if p in want else ("assembly", len(lists[p])) if lists[p] else ("none", 0) for p in range(90)}
    assert len({r["source"] for r in rows}) == 3
    # bolts are the only nodes: 90 parts at one bolt are one node
    star = spark.createDataFrame([(7, p) for p in range(90)], "bolt_id int, part_id int")
    assert [tuple(r) for r in bolts.bolt_components(star)[1].collect()] == [(7, 7)]


def test_samples_on_lines_are_clustered_by_cells(spark):
    """The same clusters as by trying all pairs: crowds, long lines, other directions, samples that lie alone or miss values."""
    rng = random.Random(9)
    rows = []
    for i in range(240):
        x, y, z = rng.gauss(0, 0.06), rng.gauss(0, 0.06), rng.choice((0.0, rng.uniform(-2, 2)))
        ax, ay, az = rng.choice(((0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0), (0.6, 0.0, 0.8), (0.0, math.sin(0.1), math.cos(0.1))))
        rows.append((i % 3, i, x, y, z, ax, ay, az))
    rows += [(0, 900, 5.0, 5.0, 0.0, 0.0, 0.0, 1.0), (0, 901, None, 0.0, 0.0, 0.0, 0.0, 1.0), (0, 902, 0.0, 0.0, 0.0, math.nan, 0.0, 1.0), (None, 903, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 904, 0.0, 0.0, 0.0, 0.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "bolt_id int, sample_id int, px double, py double, pz double, ax double, ay double, az double")
    edges = [(f"{r['bolt_id']}/{r['a']}", f"{r['bolt_id']}/{r['b']}") for r in spatial.linked(df, df, F.lit(True)).select("bolt_id", F.col("sample_id").alias("a"), F.col("other").alias("b")).collect()]
    want = components(edges)
    found = {(r["bolt_id"], r["sample_id"]): r["cluster"] for r in spatial.collinear_clusters(df).collect()}
    name = lambda b, s: "/".join(str(v) for v in (b, s) if v is not None)
    assert found == {(r[0], r[1]): want.get(name(r[0], r[1]), name(r[0], r[1])) for r in rows} and len(set(found.values())) > 9
    crowd = spark.range(3000).select(F.lit(1).alias("bolt_id"), F.col("id").alias("sample_id"), *((F.rand(i) * 0.05).alias(f"p{a}") for i, a in enumerate("xyz")), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(1.0).alias("az"))
    assert spatial.sure_links(crowd).count() < 12000


def test_reach_counts_links_without_a_part_or_a_bolt(spark):
    """As the query's SQL does: a part without an id touches its bolts' components, all bolts without ids are one bolt."""
    import duckdb

    from ferrolith.plans.searches import QUERIES

    rng = random.Random(5)
    some = lambda n: None if rng.random() < 0.15 else rng.randrange(n)
    lines = [(1, 90, 100), (1, 91, 101), (2, None, 101), (2, 92, None), (3, 93, None), (3, 93, 102)] + [(some(30), some(60), some(50)) for _ in range(60)]
    con = duckdb.connect()
    con.sql("CREATE TABLE lineitem (l_orderkey INT, l_partkey INT, l_suppkey INT)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?)", lines)
    table = spark.createDataFrame(lines, "assembly_id int, part_id int, bolt_id int")
    found = bolts.reach_summary(table.select("assembly_id", "part_id"), table.select("bolt_id", "part_id"))
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == sorted(con.sql(QUERIES["reach_bolts"][1]).fetchall(), key=repr) and None in {r[0] for r in got}


@pytest.mark.parametrize("slices, spread", [(1, 4_000_000), (3, 40), (7, 1)])
def test_bolts_of_neighbours_travel_by_slices(spark, monkeypatch, slices, spread):
    """As the pairs, whatever the number of slices and groups: ids far apart, missing ids, crowds, parts in no assembly."""
    from ferrolith.operators import neighbours

    monkeypatch.setattr(neighbours, "SHARE", 100)
    monkeypatch.setattr(neighbours, "SPREAD", spread)
    rng = random.Random(slices)
    some = lambda n: None if rng.random() < 0.08 else rng.randrange(n)
    far = lambda b: b if b is None or b % 3 else b * 10**15 - 10**16
    members = [(some(60), some(150)) for _ in range(250)] + [(7, p) for p in range(40)]
    links = [(far(some(90)), some(200)) for _ in range(250)] + [(b, 11) for b in range(80)]
    tables = spark.createDataFrame(members + members[:30], "assembly_id long, part_id long"), spark.createDataFrame(links + links[:30], "bolt_id long, part_id long")
    pairs = bolts.neighbourhood_bolts(*tables).groupBy("part_id").agg(F.count(F.lit(1)), F.min("bolt_id"), F.max("bolt_id"))
    found = sorted(map(tuple, bolts.neighbourhood_summary(*tables, slices=slices).collect()), key=repr)
    assert found == sorted(map(tuple, pairs.collect()), key=repr) and found[-1][0] is None


def test_sets_are_packed_and_read_again():
    import numpy as np

    from ferrolith.operators import neighbours as n

    sizes = np.array([0, 3, 0, 2, 1, 0])
    values = np.array([0, 1, 2**64 - 1, 127, 128, 2**35], np.uint64)
    raw, of_list = n._sets(values, sizes)
    assert list(n.summed(n.unpacked(raw.tobytes()), sizes)) == list(values) and of_list.sum() == len(raw) and list(of_list[[0, 2, 5]]) == [0, 0, 0]
    assert list(n.unpacked(b"")) == []


def test_shuffles_of_a_slice_go_with_it(spark, tmp_path):
    """Of seven slices no more than the last job's shuffle files may stand; the session's setting is as before."""
    from ferrolith.operators import neighbours

    before = spark.conf.get(neighbours._SWEEP)
    lines = spark.range(3000).selectExpr("id % 700 AS assembly_id", "id % 611 AS part_id", "id % 97 AS bolt_id")
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    kept = tracker.shuffleStatuses().size()
    bolts.neighbourhood_summary(lines.select("assembly_id", "part_id"), lines.select("bolt_id", "part_id"), slices=7)
    assert tracker.shuffleStatuses().size() <= kept + 2 and spark.conf.get(neighbours._SWEEP) == before
