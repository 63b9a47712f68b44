"""Whole specifications from text to members; the counts are those that the texts state or imply."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ferrolith.operators import intent, members, prompts, textspec
from ferrolith.plans.intents import texts as written

from .conftest import SF

HALL = """
Three storeys under a gable roof
Total Length (X-Axis): 70000mm
Total Width (Y-Axis): 20000mm
Floor 1 Elevation: Z = 0
Floor 2 (first mezzanine) Elevation: Z = 4000mm
Floor 3 (second mezzanine) Elevation: Z = 8000mm
Roof Eave / Top of Column Elevation: Z = 12000mm
Roof Ridge / Apex Elevation: Z = 14500mm
Bay Spacing: 5000mm
HEAVY CONCRETE FOUNDATION: IfcSlab, Thickness=500mm
MAIN STRUCTURAL COLUMNS - 30 Units Total: HEB400
Primary Beams: HEB300 along both axes
Secondary Joists: IPE180 spaced every 2500mm along the X-axis
Top Chords: IPE270
Bottom Chord: UPN240
Roof Purlins: 10 lines of Z200x2.0
Wall Girts: 8 lines of C150x2.0
Wall Bracing: CHS76x4 from Z=0 to Z=4000 and on to Z=12000
"""
STEPPED = """
A stepped facility
Total Structural Length (X-Axis): 60000mm
Total Structural Width (Y-Axis): 30000mm
Level 1 (Partial Mezzanine): Z = 3800mm (Spanning from X=0 to X=30000 only)
Level 2 (Hung Deck): Z = 7600mm (Spanning from X=30000 to X=60000, projecting out from Y=0 to Y=10000)
Main Roof Eave Line: Z = 12000mm
Roof Apex / Ridge Line: Z = 15000mm
Global Grid Spacing: 6000mm increments along the X-Axis
HEAVY CONCRETE FOUNDATION: IfcSlab Thickness=600mm
DUAL-GRID VERTICAL COLUMNS - 33 Units Total, HEB450
{lines}Level 1 FRAME:
Primary Beams: 12 Units of HEB300
Secondary Floor Joists: 31 Lines of IPE180 every 1000mm
Level 2 DECK:
Cantilever Beams: 6 Units of IPE500 from the spine columns (at Y=15000) out to the floating edge (Y=5000)
Hanger Rods: 6 Units of CHS89x6
Secondary Joists: 16 Lines of IPE140 along the X-axis every 600mm
Web Members: 8 Units per frame of RHS90x90x6 in a Warren truss pattern
ROOF PURLINS: 14 lines of Z250x2.5
Wall Girts: 12 lines of C180x2.0
Vertical Wall Bracing: CHS76x4 from Z=0 to Z=12000
Roof Plane Bracing: CHS60x4 in first, middle and last bays
SAFETY GUARDRAILS: RHS50x50x4 at Z=8700
"""
LINES = "Grid Line Y=0: 11 columns\nGrid Line Y=15000 (spine): 11 columns\nGrid Line Y=30000: 11 columns\n"


def compiled(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "model_id int, text string")
    tables = intent.composed(df, "model_id")
    rows = members.compile_intent(tables["groups"], tables["grids"], tables["levels"], tables["slabs"]).collect()
    return tables, rows


def test_hall_with_floors(spark):
    tables, rows = compiled(spark, HALL, None, "", "Length: 5000 mm", "Total Length: 9000 mm\nTotal Width: 9000 mm\nBay Spacing: 3000 mm\nno member at all")
    assert {r["model_id"] for t in tables.values() for r in t.collect()} == {0}
    n, ids = Counter(r["category"] for r in rows), Counter(r["group_id"] for r in rows)
    assert n["column"] == 30 and n["slab"] == 1 and len(rows) > 200
    assert ids["floor2_primary_x"] == 28 and ids["floor3_joists"] == 29 and ids["wall_brace_full_height"] == 4 and ids["roof_purlins"] == 20 and ids["wall_girts"] == 16
    main = tables["groups"].where("group_id = 'main_columns'").first()
    assert (main["member_count"], main["profile"], main["rule"], main["end_level"]) == (30, "HEB400", "units", "Eave")
    top = {r["group_id"]: r for r in tables["groups"].collect()}["wall_girts"]
    assert top["fixed_elevations_mm"] == [1500.0 * i for i in range(1, 9)]


@pytest.mark.parametrize("lines", [LINES, ""])
def test_stepped_facility(spark, lines):
    tables, rows = compiled(spark, STEPPED.format(lines=lines))
    assert tables["grids"].first()["frame_line_y_mm"] == [0.0, 15000.0, 30000.0]  # stated, or three columns a frame
    n, ids = Counter(r["category"] for r in rows), Counter(r["group_id"] for r in rows)
    assert n["column"] == 33 and n["slab"] == 3 and len(rows) > 150
    assert ids["web_members_warren"] == 88 and ids["roof_plane_bracing"] == 6 and ids["level1_primary_beams"] == 12 and ids["level2_joists"] >= 15 and ids["level2_hangers"] == 6
    hang = next(r for r in rows if r["group_id"] == "level2_hangers" and r["n"] == 1)
    assert [hang[c] for c in ("sx", "sy", "sz", "ex", "ey", "ez")] == [30000.0, 15000.0, 12000.0, 30000.0, 5000.0, 7600.0]
    decks = {r["group_id"]: r for r in rows if r["category"] == "slab"}
    assert [decks["level2_deck_slab"][c] for c in ("sx", "sy", "sz", "ex", "ey", "ez")] == [30000.0, 0.0, 7550.0, 60000.0, 10000.0, 7600.0]
    rail = next(r for r in rows if r["group_id"] == "level2_guard_at_x_min")
    assert [rail[c] for c in ("sx", "sy", "sz", "ex", "ey", "ez")] == [30000.0, 0.0, 8700.0, 30000.0, 10000.0, 8700.0]


def test_complete_quantities_replace_all_else(spark):
    text = "Total Length: 12000 mm\nTotal Width: 6000 mm\nBay Spacing: 6000 mm\nSUPPORT COLUMNS - 6 Units Total\nPRIMARY BEAMS: 3 Units Total\nJOISTS: 5 Lines Total\nRODS: 3 Units Total\nMezzanine Floor Z = 4000 mm\nUpper Anchor Z = 8000 mm\n"
    tables, _ = compiled(spark, text, text + "GUARDRAIL at Z = 5100 mm")
    got = {i: [(r["group_id"], r["rule"]) for r in tables["groups"].where(f"model_id = {i}").orderBy("seq").collect()] for i in (0, 1)}
    # four groups are not a complete set: they join the columns, and the columns along one line have an older counterpart
    assert got[0] == [("main_columns", "support"), ("beams_along_y_per_x", "quantity"), ("joists_along_x_spaced_y", "quantity"), ("diagonals_per_x", "quantity")]
    assert len(got[1]) == 7 and {r for _, r in got[1]} == {"quantity"}


def test_profiles_behind_headings(spark):
    df = spark.createDataFrame([("MAIN COLUMNS IPE 300 then Profile: heb 400",), ("main columns of Z200x2.5",), ("MAIN COLUMNS C 150x2",), ("MAIN COLUMNS CHS89x6",), ("none",)], "t string")
    assert [r[0] for r in df.select(intent.profile_after(df.t, "MAIN COLUMNS", "HEB200")).collect()] == ["HEB400", "100x100x6", "100x50x4", "CHS89X6", "HEB200"]


def test_patterns_run_once_a_text(spark):
    """Every pattern stands once in the plan, however many levels, groups or rows its result goes into."""
    texts = spark.createDataFrame([(1, "Level 1: Z = 3000 mm\nRoof Eave: Z = 6000 mm\nWidth: 8000 mm")], "id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    levels = plan(textspec.level_table(texts, "id"))
    assert levels.count("Mezzanine Floor") == 1 and levels.count(r"\s+-\s+") == 1 and levels.count(r"(?i)^Level\s*(\d+)") == 2  # one for each of two groups
    rows = plan(prompts.quantity_rows(texts.withColumn("width_mm", F.lit(8000.0)), textspec.level_table(texts, "id"), "id"))
    assert rows.count("REAR ANCHOR COLUMNS") == 1 and rows.count(r"JOISTS[\s\S]{0,200}?") == 1


def test_members_of_many_models_need_no_broadcast(spark):
    """Tables of a model each are joined by sorted keys, so none of them is collected by the driver."""
    grids = spark.createDataFrame([(1, 12000.0, 8000.0, 6000.0, None, [0.0, 4000.0, 8000.0])], "model_id long, length_x_mm double, width_y_mm double, bay_spacing_x_mm double, frame_line_x_mm array<double>, frame_line_y_mm array<double>")
    levels = spark.createDataFrame([(1, "Ground", 0.0), (1, "Eave", 6000.0), (1, "Ridge", 7000.0)], "model_id long, name string, elevation_mm double")
    group = {"profile": "HEB200", "start_level": "Ground", "end_level": "Eave", "category": "beam"}
    kinds = [("vertical", "all_frame_lines", 9), ("horizontal_x", "along_x_between_columns", 6), ("horizontal_y", "along_y_at_frame_ends", 2), ("inclined_dual_y", "all", 6), ("roof_purlins_dual_slope", "all", 12), ("diagonal_plan", "first_and_last_bay_braces", 6), ("diagonal_plan", "roof_truss_diagonals", 6)]
    rows = [{"model_id": 1, "group_id": f"{o}_{a}", "orientation": o, "assigned_to_grid": a, **group} for o, a, _ in kinds]
    groups = spark.createDataFrame(rows, f"model_id long, {intent.GROUP}")
    made = members.compile_intent(groups, grids, levels)
    assert Counter(r.group_id for r in made.collect()) == {f"{o}_{a}": n for o, a, n in kinds}
    assert "Broadcast" not in made._jdf.queryExecution().sparkPlan().toString()


def test_placed_groups_expand_without_a_join(spark):
    """The same members as by tables of groups, grids and levels; no expansion joins, so no few tasks expand everything."""
    tables = {k: v.withColumnRenamed("p_partkey", "model_id") for k, v in intent.composed(written(spark, SF).where("p_partkey % 5 = 1"), "p_partkey").items()}
    made = members.compile_placed(tables["placed"]).unionByName(members.expand_slabs(tables["placed_slabs"]))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    rows = lambda df: sorted(map(repr, df.select(*(F.bround(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes)).collect()))
    found = rows(made)
    assert len(found) > 5000 and found == rows(members.compile_intent(tables["groups"], tables["grids"], tables["levels"], tables["slabs"]))


def test_patterns_run_only_where_their_pieces_stand(spark):
    """A text that a pattern matches holds what the pattern needs, in any case; without pieces a pattern always runs."""
    every = [p for rules in (*intent.SIZES.values(), *intent.FACTS.values(), intent.COLUMN_COUNTS) for p in rules.values()] + [*intent.FLAGS.values(), *(h for h, _ in intent.PROFILES.values())]
    every += [intent.FRONT, intent.BACK, intent.REAR, intent.SPANNING, intent.FROM_TO, intent.PROJECTING, *prompts.GRID_Y, *prompts.EVERY, *(p for q in prompts.QUANTITIES.values() for p in q[0]), *(p.removeprefix("(?i)") for ps in textspec.LEVELS.values() for p in ps)]
    every = list(dict.fromkeys(every))
    rows = written(spark, SF).select("p_partkey", F.explode(F.array("text", F.upper("text"), F.lower("text"))).alias("t"))
    low = F.lower("t")
    pairs = [F.sum((F.col("t").rlike(f"(?i){p}") & ~textspec.may_match(low, p)).cast("int")) for p in every]
    assert not any(rows.agg(*pairs).first())
    assert textspec.needed(r"Web Members[\s\S]{0,9}?(\d+)\s*Units per frame") == (("units per frame",), ("web members",))
    assert textspec.needed("VERTICAL COLUMNS|DUAL-GRID") == (("vertical columns", "dual-grid"),) and textspec.needed(r"(?:ab)?c\d|long") == ()
