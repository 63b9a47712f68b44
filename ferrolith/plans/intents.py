"""Queries over whole intents: specifications of three kinds written from parts, read back and compiled to members."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import intent, members, repair
from ferrolith.sources import bindings


def texts(spark, sf_dir):
    """Plants with zones on levels, halls with floors, mezzanines by sections or by quantities; and texts without sizes."""
    s, k = F.col("p_size"), F.col("p_partkey")
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    some = lambda when, *parts: F.when(when, put(*parts, "\n")).otherwise("")
    plant = put(
        "Tiered plant ", k, "\nTotal Length: ", (s + 3) * 6000, " mm\nTotal Width: ", (s + 5) * 2000, " mm\nGrid Spacing: 6000 mm\nLevel 1 (part mezzanine): Z = 3800 mm (Spanning from X=0 to X=12000)\n",
        "Level 2 (hung deck): Z = 7600 mm, from X=12000 to X=24000, projecting out from Y=0 to Y=8000\nRoof Eave: Z = 12000 mm\nRoof Ridge: Z = ", s + 15000, " mm\nHEAVY CONCRETE FOUNDATION, Thickness = ", s + 300, " mm\n",
        "DUAL-GRID COLUMNS: ", F.when(k % 2 == 0, (s + 4) * 3).otherwise((s + 4) * 2 + 1), " Units\nProfile: HEB450\nLevel 1 frame: Primary Beams, 5 Units of HEB320, joists every 1500 mm\nHanger Rods: CHS 70x5\n",
        "Roof Purlins: 12 lines of Z200x2\n", some(k % 4 == 0, "All in a Warren truss"), some(k % 9 == 0, "Roof Plane Bracing too"), some(k % 2 == 1, "X-BRACING of all walls"), some(k % 5 > 0, "GUARDRAIL at Z = 8700 mm"),
    )
    ways = F.element_at(F.array(
        put("MAIN STRUCTURAL COLUMNS, ", (s + 3) * 2, " Units"), put("SUPPORT COLUMNS - ", s + 3, " Units"), put("4 columns along the front, ", s, " matching columns along the back"), F.lit("MAIN COLUMNS as usual"), put(s + 7, " columns strictly along Y=0"),
    ), (k % 5 + 1).cast("int"))
    hall = put(
        "Hall ", k, "\nLength: ", (s + 2) * 5000, " mm\nWidth: ", (s + 8) * 1000, " mm\nBay Spacing: 5000 mm\nFloor 2 Elevation: Z = 4000 mm\nFloor 3 Elevation: Z = 8000 mm\n", some(k % 2 == 1, "Roof Eave: Z = 12000 mm\nRoof Ridge: Z = 14500 mm"), ways,
        "\nPrimary Beams: HEB280\nSecondary Joists: IPE200 every 2000 mm along the X-axis\n",
    )
    sections = put(
        "Finished Deck Elevation: 4500 mm\nColumns go from Z=0 to Z=4200\nSUPPORT COLUMNS - ", (s + 2) * 2, " Units\nMAIN GIRDERS - ", s + 4, " Units\nFLOOR JOISTS - ", s + 6, " Lines\nKNEE BRACES Add 8 diagonal ones at each column body (at Z=3000)\nMEZZANINE FLOOR DECK\nThickness = 180 mm\n",
    )
    quantities = put(
        "REAR ANCHOR COLUMNS\nProfile: HEB 300\nIn all ", s + 2, " Units Total\nCANTILEVER PRIMARY BEAMS\nProfile: IPE 400\nIn all ", s + 3, " Units Total\nFLOOR JOISTS\nProfile: IPE 200\nIn all ", s + 4, " Lines Total\nevery 1500 mm across\nTENSION SUSPENSION RODS\nIn all ", s + 5,
        " Units Total\nMezzanine Floor Z = 5000 mm\nUpper Anchor Z = 9000 mm\nGUARDRAIL at Z = 6100 mm\n",
    )
    mezzanine = put("Mezzanine ", k, "\nTotal Length: ", F.when(k % 35 > 1, (s + 1) * 6000), " mm\nTotal Width: ", (s + 4) * 1000, " mm\nBay Spacing: 6000 mm\n", F.when(k % 2 == 0, quantities).otherwise(sections))
    return bindings.table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, plant).when(k % 3 == 1, hall).otherwise(mezzanine).alias("text"))


def _composed(spark, sf_dir):
    return intent.composed(texts(spark, sf_dir), "p_partkey")


def intent_groups(spark, sf_dir):
    columns = ["group_id", "profile", "orientation", "assigned_to_grid", "start_level", "end_level", "spacing_mm", "member_count", "category", "rule", "x_min_mm", "x_max_mm", "y_from_mm", "y_to_mm", "y_min_mm", "y_max_mm"]
    return _composed(spark, sf_dir)["groups"].select("p_partkey", *columns, F.size("fixed_elevations_mm").alias("n_heights"), F.size("y_at_mm").alias("n_lines"))


def intent_slabs(spark, sf_dir):
    return _composed(spark, sf_dir)["slabs"]


def intent_grids(spark, sf_dir):
    return _composed(spark, sf_dir)["grids"].select("p_partkey", "length_x_mm", "width_y_mm", "bay_spacing_x_mm", "length_rule", "width_rule", "bay_rule", F.size("frame_line_y_mm").alias("n_lines"))


def intent_members(spark, sf_dir):
    tables = {k: v.withColumnRenamed("p_partkey", "model_id") for k, v in _composed(spark, sf_dir).items()}
    rows = members.compile_placed(tables["placed"]).unionByName(members.expand_slabs(tables["placed_slabs"]))
    return rows.groupBy("model_id", "group_id", "category").agg(F.count(F.lit(1)).alias("n_members"))


_P = "p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 3 AS kind, p_partkey % 2 = 0 AS even FROM part), f AS (SELECT *, CASE kind WHEN 0 THEN s + 4 WHEN 1 THEN s + 3 ELSE s + 2 END AS fr FROM p WHERE kind < 2 OR k % 35 > 1)"


def _row(when: str, group: str, profile: str, orientation: str, place: str, start: str, end: str, category: str = "beam", rule: str = "roof", **more: str) -> str:
    kinds = {n: "DOUBLE" for n in ("spacing_mm", "x_min_mm", "x_max_mm", "y_from_mm", "y_to_mm", "y_min_mm", "y_max_mm")} | {"member_count": "INT", "n_heights": "INT", "n_lines": "INT"}
    texts = {"group_id": group, "profile": profile, "orientation": orientation, "assigned_to_grid": place, "start_level": start, "end_level": end, "category": category, "rule": rule}
    literal = lambda v: v[1:] if v.startswith("=") else f"'{v}'"
    fields = [f"{literal(v)} AS {n}" for n, v in texts.items()] + [f"({more.get(n, 'NULL')})::{t} AS {n}" for n, t in kinds.items()]
    return f"SELECT k AS p_partkey, {', '.join(fields)} FROM f WHERE {when}"


_ZONE, _HALL, _SECTIONS, _ALL = "kind = 0", "kind = 1", "kind = 2 AND NOT even", "kind = 2 AND even"
_X2, _Y2, _HUNG = {"x_min_mm": "12000", "x_max_mm": "24000"}, {"y_min_mm": "0", "y_max_mm": "8000"}, {"y_from_mm": "15000", "y_to_mm": "5000"}
_ROOFED = "(kind = 0 OR kind = 1 AND NOT even)"
_RAIL = {"category": "beam", "rule": "rail"}
_GROUP_ROWS = [
    _row(f"{_ZONE} AND even", "grid_columns", "HEB450", "vertical", "all_frame_lines", "Ground", "Eave", "column", "grid", member_count="3 * fr"),
    _row(_ZONE, "level1_primary_beams", "HEB450", "horizontal_x", "along_x_at_each_y_line", "Level1", "Level1", rule="level", x_max_mm="12000", member_count="5", n_lines="CASE WHEN even THEN 3 END"),
    _row(_ZONE, "level1_joists", "IPE180", "horizontal_y", "distributed_along_x", "Level1", "Level1", rule="level", x_max_mm="12000", spacing_mm="1500"),
    _row(_ZONE, "level2_cantilevers", "IPE500", "horizontal_y", "along_y_per_x_station", "Level2", "Level2", rule="level", **_X2, **_HUNG), _row(_ZONE, "level2_hangers", "CHS70X5", "diagonal_plan", "per_x_station", "Eave", "Level2", "brace", "level", **_X2, **_HUNG),
    _row(_ZONE, "level2_joists", "IPE140", "horizontal_x", "distributed_along_y", "Level2", "Level2", rule="level", spacing_mm="600", **_X2, **_Y2),
    *(_row(f"{_ZONE} AND k % 5 > 0", f"level2_guard_at_{side}", "RHS50x50x4", along, place, "Guardrail", "Guardrail", rule="rail", **limits) for side, along, place, limits in (
        ("x_min", "horizontal_y", "along_y_at_fixed_x", {"x_min_mm": "12000", "x_max_mm": "12000", **_Y2}), ("x_max", "horizontal_y", "along_y_at_fixed_x", {"x_min_mm": "24000", "x_max_mm": "24000", **_Y2}),
        ("y_min", "horizontal_x", "along_x_at_fixed_y", {**_X2, "y_min_mm": "0", "y_max_mm": "0"}), ("y_max", "horizontal_x", "along_x_at_fixed_y", {**_X2, "y_min_mm": "8000", "y_max_mm": "8000"}))),
    _row(_ROOFED, "top_chords", "IPE300", "inclined_dual_y", "all_frame_lines", "Eave", "Ridge"), _row(_ROOFED, "bottom_chords", "HEA220", "horizontal_y_per_frame", "along_y_per_frame_line", "Eave", "Eave"),
    _row(_ROOFED, "=CASE WHEN kind = 0 AND k % 4 = 0 THEN 'web_members_warren' ELSE 'web_members' END", "RHS90x90x6", "truss_web_panels", "all_frame_lines", "Eave", "Ridge", member_count="8"),
    _row(_ROOFED, "roof_purlins", "100x100x6", "roof_purlins_dual_slope", "all_frame_lines", "Eave", "Ridge", member_count="CASE kind WHEN 0 THEN 12 ELSE 10 END"), _row(_ROOFED, "wall_girts", "100x50x4", "wall_girts_fixed_z", "all_frame_lines", "Eave", "Eave", n_heights="8"),
    _row(f"{_ZONE} AND k % 9 = 0", "roof_plane_bracing", "CHS60x4", "diagonal_plan", "roof_truss_diagonals", "Eave", "Ridge", "brace", "roof_plane"),
    *(_row(f"{_ZONE} AND NOT even", f"wall_brace_{a}_{b}", "CHS76x4", "diagonal_plan", "first_and_last_bay_braces", a, b, "brace", "storey") for a, b in (("Ground", "Level1"), ("Level1", "Level2"), ("Level2", "Eave"))),
    _row(_HALL, "main_columns", "=CASE WHEN k % 5 IN (2, 4) THEN 'HEB200' ELSE 'HEB280' END", "vertical", "=CASE WHEN CASE k % 5 WHEN 1 THEN true WHEN 2 THEN 4 + s = fr WHEN 4 THEN s + 7 = fr ELSE false END THEN 'along_all_x_at_y_min' ELSE 'all_frame_lines' END", "Ground",
         "=CASE WHEN even THEN 'Floor3' ELSE 'Eave' END", "column", "=['units', 'support', 'walls', 'frames', 'rear'][k % 5 + 1]", member_count="[2 * fr, fr, 4 + s, 2 * fr, s + 7][k % 5 + 1]"),
    *(r for n in (2, 3) for r in (_row(_HALL, f"floor{n}_primary_x", "HEB280", "horizontal_x", "along_x_between_columns", f"Floor{n}", f"Floor{n}", rule="floor"), _row(_HALL, f"floor{n}_primary_y", "HEB280", "horizontal_y", "along_y_at_frame_ends", f"Floor{n}", f"Floor{n}", rule="floor", member_count="2"),
                                  _row(_HALL, f"floor{n}_joists", "IPE200", "horizontal_y", "distributed_along_x", f"Floor{n}", f"Floor{n}", rule="floor", spacing_mm="2000"))),
    _row(_SECTIONS, "main_columns", "HEB200", "vertical", "all_frame_lines", "Ground", "ColumnTop", "column", "support", member_count="2 * fr"), _row(_SECTIONS, "primary_girders_x", "HEB300", "horizontal_x", "along_x_between_columns", "DeckTop", "DeckTop", rule="girders", member_count="s + 2"),
    _row(_SECTIONS, "primary_girders_y", "HEB300", "horizontal_y", "along_y_at_frame_ends", "DeckTop", "DeckTop", rule="girders", member_count="2"), _row(_SECTIONS, "floor_joists", "IPE180", "horizontal_x", "distributed_along_y", "DeckTop", "DeckTop", rule="joists", spacing_mm="2500", member_count="s + 6"),
    _row(_SECTIONS, "knee_braces", "RHS80x80x5", "diagonal_plan", "corner_braces", "BraceStart", "ColumnTop", "brace", "knees", member_count="8"),
    _row(_ALL, "columns_along_y_min", "HEB300", "vertical", "along_all_x_at_y_min", "Ground", "UpperAnchor", "column", "quantity", member_count="s + 2"), _row(_ALL, "beams_along_y_per_x", "IPE400", "horizontal_y_per_frame", "along_y_per_frame_line", "Deck", "Deck", rule="quantity", member_count="s + 3"),
    _row(_ALL, "joists_along_x_spaced_y", "IPE200", "horizontal_x", "distributed_along_y", "Deck", "Deck", rule="quantity", spacing_mm="1500", member_count="s + 4"), _row(_ALL, "diagonals_per_x", "CHS60x5", "diagonal_plan", "per_x_station", "UpperAnchor", "Deck", "brace", "quantity", member_count="s + 5"),
    *(_row(_ALL, n, "RHS50x50x4", o, a, "Guardrail", "Guardrail", rule="quantity") for n, o, a in (("edge_at_x_min", "horizontal_y", "along_y_at_x_min"), ("edge_at_y_max", "horizontal_x", "along_x_at_y_max"), ("edge_at_x_max", "horizontal_y", "along_y_at_x_max"))),
]
#: Members of each group, by its placement and limits.
_COUNT = """CASE group_id WHEN 'grid_columns' THEN 3 * fr WHEN 'main_columns' THEN CASE assigned_to_grid WHEN 'all_frame_lines' THEN 2 * fr ELSE fr END WHEN 'columns_along_y_min' THEN fr
  WHEN 'level1_primary_beams' THEN CASE WHEN even THEN 5 ELSE 4 END WHEN 'level1_joists' THEN 9 WHEN 'level2_cantilevers' THEN 3 WHEN 'level2_hangers' THEN 3 WHEN 'level2_joists' THEN 14
  WHEN 'top_chords' THEN 2 * fr WHEN 'bottom_chords' THEN fr WHEN 'web_members_warren' THEN 8 * fr WHEN 'web_members' THEN 15 * fr WHEN 'roof_purlins' THEN 2 * member_count WHEN 'wall_girts' THEN 16 WHEN 'roof_plane_bracing' THEN 6
  WHEN 'primary_girders_x' THEN least(2 * (fr - 1), member_count) WHEN 'primary_girders_y' THEN 2 WHEN 'floor_joists' THEN round_even((s + 4) / 2.5, 0) + 1 WHEN 'knee_braces' THEN 4
  WHEN 'beams_along_y_per_x' THEN fr WHEN 'joists_along_x_spaced_y' THEN round_even((s + 4) / 1.5, 0) + 1 WHEN 'diagonals_per_x' THEN fr
  ELSE CASE WHEN group_id LIKE 'wall_brace%' THEN 4 WHEN group_id LIKE 'floor%primary_x' THEN 2 * (fr - 1) WHEN group_id LIKE 'floor%primary_y' THEN 2 WHEN group_id LIKE 'floor%joists' THEN round_even((s + 2) * 2.5, 0) + 1 ELSE 1 END END::BIGINT"""
_GROUPS = " UNION ALL ".join(_GROUP_ROWS)
_SLABS = """SELECT k AS p_partkey, 'foundation_slab' AS slab_id, 'Ground' AS top_level, (s + 300)::DOUBLE AS thickness_mm, 'full_grid' AS footprint, NULL::DOUBLE AS x_min_mm, NULL::DOUBLE AS x_max_mm, NULL::DOUBLE AS y_min_mm, NULL::DOUBLE AS y_max_mm, 'foundation' AS rule FROM f WHERE kind = 0
  UNION ALL SELECT k, 'level1_deck_slab', 'Level1', 50, 'partial_xy', 0, 12000, 0, (s + 5) * 2000, 'level' FROM f WHERE kind = 0
  UNION ALL SELECT k, 'level2_deck_slab', 'Level2', 50, 'partial_xy', 12000, 24000, 0, 8000, 'level' FROM f WHERE kind = 0
  UNION ALL SELECT k, 'deck_slab', 'DeckTop', 180, 'full_grid', NULL, NULL, NULL, NULL, 'deck' FROM f WHERE kind = 2 AND NOT even"""

QUERIES = {
    "intent_groups": (intent_groups, f"WITH {_P} {_GROUPS}"),
    "intent_slabs": (intent_slabs, f"WITH {_P} {_SLABS}"),
    "intent_grids": (intent_grids, f"""WITH {_P} SELECT k AS p_partkey, (fr - 1) * CASE kind WHEN 1 THEN 5000.0::DOUBLE ELSE 6000 END AS length_x_mm, CASE kind WHEN 0 THEN (s + 5) * 2000 WHEN 1 THEN (s + 8) * 1000 ELSE (s + 4) * 1000 END::DOUBLE AS width_y_mm,
        CASE kind WHEN 1 THEN 5000 ELSE 6000 END::DOUBLE AS bay_spacing_x_mm, 'length' AS length_rule, 'width' AS width_rule, 'spacing' AS bay_rule, CASE WHEN kind = 0 AND even THEN 3 END::INT AS n_lines FROM f"""),
    "intent_members": (intent_members, f"""WITH {_P}, g AS ({_GROUPS}) SELECT p_partkey AS model_id, group_id, category, {_COUNT} AS n_members FROM g JOIN f ON k = p_partkey
        UNION ALL SELECT p_partkey, slab_id, 'slab', 1 FROM ({_SLABS})"""),
}


def _specified(spark, sf_dir):
    """Orders as models, lines as columns and beams; texts that ask for a portal, state sizes, or say nothing."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    lines = bindings.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") * 100).alias("q"), F.col("l_partkey").alias("part"))
    # an order's line numbers can repeat: the seq is made of all that tells lines apart
    seq = n.cast("long") * 1_000_000_000 + F.col("part") * 10_000 + F.col("q").cast("long") % 10_000
    rows = lines.groupBy(o.alias("model_id"), seq.alias("seq")).agg(F.max("q").alias("q"), F.max(n).alias("n"))
    role = F.when(F.col("n") % 3 == 0, "beam").when(F.col("n") == 7, "plate").otherwise("column")
    elements = rows.select("model_id", "seq", role.alias("role"), F.concat(F.lit("HEA"), F.col("n") * 20 + 100).alias("profile"), F.col("q").alias("length_mm"), (F.col("q") * F.col("n")).alias("x"), F.lit(0.0).alias("y"), F.when(F.col("n") == 6, F.col("q") * 9).otherwise(0.0).alias("z"))
    k = F.col("o_orderkey")
    text = F.concat(
        F.when(k % 3 == 0, F.concat(F.lit("One beam IPE300 resting on "), k % 4 + 1, F.lit(" columns"))).otherwise("Some steel"), F.when(k % 2 == 0, F.concat(F.lit(", height "), k % 7 + 3, F.lit(" m , "))).otherwise(", "), F.when(k % 5 < 2, F.concat(F.lit("span "), (k % 9 + 4) * 1000, F.lit(" mm"))).otherwise(""),
        F.when(k % 6 == 0, ", y = 250").otherwise(""),
    )
    orders = bindings.table(spark, sf_dir, "orders").select(k.alias("model_id"), text.alias("text"))
    sections = orders.where("model_id % 3 = 0").select("model_id", F.lit("beam").alias("role"), F.lit("IPE300").alias("key"))
    return elements, repair.locks(orders, sections)


def repaired_specs(spark, sf_dir):
    return repair.repaired(*_specified(spark, sf_dir))[0]


def repair_log(spark, sf_dir):
    log = repair.repaired(*_specified(spark, sf_dir))[1]
    return log.groupBy("model_id", "field", "rule").agg(F.count(F.lit(1)).alias("n_changes"))


_R = """l AS (SELECT l_orderkey AS m, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + (l_quantity * 100)::BIGINT % 10000 AS seq, max(l_quantity::DOUBLE * 100) AS q, max(l_linenumber) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT m, seq, CASE WHEN n % 3 = 0 THEN 'beam' WHEN n = 7 THEN 'plate' ELSE 'column' END AS role, 'HEA' || (n * 20 + 100) AS profile0, q AS len0, q * n AS x0, CASE WHEN n = 6 THEN q * 9 ELSE 0 END::DOUBLE AS z0 FROM l),
k AS (SELECT o_orderkey AS m, o_orderkey % 3 = 0 AS portal, greatest(2, o_orderkey % 4 + 1) AS wanted, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 7 + 3) * 1000.0::DOUBLE END AS h, CASE WHEN o_orderkey % 5 < 2 THEN (o_orderkey % 9 + 4) * 1000.0::DOUBLE END AS sp, CASE WHEN o_orderkey % 6 = 0 THEN 250.0::DOUBLE ELSE 0 END AS y FROM orders),
a AS (SELECT e.*, portal, wanted, h, sp, y AS base, CASE WHEN role = 'beam' AND portal THEN 'IPE300' ELSE profile0 END AS profile, CASE WHEN role = 'column' AND abs(len0 - h) > 0.5 THEN h WHEN role = 'beam' AND abs(len0 - sp) > 0.5 THEN sp ELSE len0 END AS len FROM e JOIN k USING (m)),
g AS (SELECT m, sum((role = 'column')::INT) AS nc, sum((role = 'beam')::INT) AS nb, min_by(profile, seq) FILTER (WHERE role = 'column') AS pc, min_by(len, seq) FILTER (WHERE role = 'column') AS hc, min_by(len, seq) FILTER (WHERE role = 'beam') AS sb, any_value(portal) AS portal, any_value(wanted) AS wanted, any_value(h) AS h, any_value(sp) AS sp, any_value(base) AS base FROM a GROUP BY 1),
w AS (SELECT *, portal AND (nc <> wanted OR nb = 0) AS anew, coalesce(sp, sb, 6000) AS span, coalesce(h, hc, 3500) AS height FROM g),
s AS (SELECT a.*, row_number() OVER (PARTITION BY a.m, role ORDER BY x0, seq) - 1 AS place FROM a JOIN w USING (m) WHERE NOT anew),
kept AS (SELECT m, seq, role, profile, len AS length_mm, CASE WHEN portal AND role = 'column' AND sp > 0 THEN sp * place / (wanted - 1) ELSE x0 END AS x, 0.0::DOUBLE AS y, z0 AS z, profile0, len0, x0, z0 FROM s),
built AS (SELECT m, i AS seq, 'column' AS role, coalesce(pc, 'HEB200') AS profile, height AS length_mm, span * i / (wanted - 1) AS x, base AS y, 0.0::DOUBLE AS z FROM (SELECT *, unnest(range(wanted)) AS i FROM w WHERE anew) UNION ALL SELECT m, wanted, 'beam', 'IPE300', span, 0, base, height FROM w WHERE anew),
u AS (SELECT m, seq, role, profile, length_mm, x, y, z FROM kept UNION ALL FROM built), t AS (SELECT m, max(z + length_mm) AS top FROM u WHERE role = 'column' GROUP BY 1),
r AS (SELECT u.* REPLACE (CASE WHEN role = 'beam' AND z < coalesce(top, 0) - 0.5 THEN coalesce(top, 0) ELSE z END AS z) FROM u LEFT JOIN t USING (m))"""
QUERIES |= {
    "repaired_specs": (repaired_specs, f"WITH {_R} SELECT m AS model_id, seq, role, profile, length_mm, x, y, z FROM r"),
    "repair_log": (repair_log, f"""WITH {_R}, c AS (SELECT r.m, unnest([CASE WHEN r.profile <> k.profile0 THEN ('profile', 'section') END, CASE WHEN r.length_mm <> k.len0 THEN ('length_mm', 'length') END, CASE WHEN r.x <> k.x0 THEN ('x', 'spread') END, CASE WHEN r.z <> k.z0 THEN ('z', 'raised') END]) AS f
          FROM r JOIN kept k USING (m, seq)), b AS (SELECT m, f[1] AS field, f[2] AS rule FROM c WHERE f IS NOT NULL UNION ALL SELECT m, 'element', 'portal' FROM built UNION ALL SELECT a.m, 'element', 'portal' FROM a JOIN w USING (m) WHERE anew)
        SELECT m AS model_id, field, rule, count(*) AS n_changes FROM b GROUP BY 1, 2, 3"""),
}
