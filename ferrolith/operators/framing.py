"""Group rows out of texts and levels, normalised assignments, allow-lists of hardware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import durable

#: Words of free assignments and the placements they stand for, by orientation, in order.
ASSIGNMENTS = {
    "vertical": (("perimeter|corner", "perimeter"), ("y_?min|front", "along_all_x_at_y_min"), ("y_?max|back", "along_all_x_at_y_max"), (".", "all_frame_lines")),
    "horizontal_x": (("distribut|spaced|spacing", "distributed_along_y"), ("y_?max", "along_x_at_y_max"), ("fixed", "along_x_at_fixed_y"), ("each_y|each y", "along_x_at_each_y_line"), (".", "along_x_between_columns")),
    "horizontal_y": (("end", "along_y_at_frame_ends"), ("distribut|spaced|spacing", "distributed_along_x"), ("x_?min", "along_y_at_x_min"), ("x_?max", "along_y_at_x_max"), ("fixed", "along_y_at_fixed_x"), (".", "along_y_per_x_station")),
    "diagonal_plan": (("corner", "corner_braces"), ("roof|truss", "roof_truss_diagonals"), ("station|per_x", "per_x_station"), (".", "first_and_last_bay_braces")),
}
#: Group rows of a floor, and of a roof that has eaves and a ridge.
FLOOR_ROWS = (("girders", "horizontal_x", "along_x_between_columns", None), ("cross_beams", "horizontal_y", "along_y_per_x_station", None), ("joists", "horizontal_x", "distributed_along_y", 2000.0))
ROOF_ROWS = (("rafters", "inclined_dual_y", "per_frame", "Eave", "Ridge"), ("webs", "truss_web_panels", "warren", "Eave", "Ridge"), ("purlins", "roof_purlins_dual_slope", "both_slopes", "Eave", "Ridge"), ("girts", "wall_girts_fixed_z", "outer_walls", "Ground", "Eave"), ("eave_beams", "horizontal_x", "along_x_between_columns", "Eave", "Eave"))


def coerced_assignment(orientation: Column, assignment: Column) -> Column:
    """A known placement stays; other words are read by the first pattern of their orientation that they hold."""
    word = F.lower(F.regexp_replace(F.trim(assignment), r"[\s-]+", "_"))
    out = assignment
    for name, rules in ASSIGNMENTS.items():
        chosen = F.when(word.isin(*(target for _, target in rules)), word)
        for pattern, target in rules:
            chosen = chosen.when(word.rlike(pattern), target)
        out = F.when(orientation == name, F.coalesce(chosen, F.lit(rules[-1][1]))).otherwise(out)
    return out


def section_profile(text: Column, heading: str, default: str, reach: int = 320) -> Column:
    """The first section name within so many characters after a heading."""
    tail = F.regexp_extract(text, rf"(?is){heading}(.{{0,{reach}}})", 1)
    found = F.regexp_extract(tail, r"(?i)\b((?:IPE|HEB|HEA|HEM|UPN|UPE)\s*\d{2,4}|(?:RHS|SHS|CHS|L)\s*\d+(?:\.\d+)?\s*[x×]\s*\d+(?:\.\d+)?(?:\s*[x×]\s*\d+(?:\.\d+)?)?)", 1)
    # a list of one, as nullif would read the text twice
    named = F.filter(F.array(F.upper(F.regexp_replace(found, r"\s", ""))), lambda n: n != "")
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(default))


def floor_rows(levels: DataFrame, by: str) -> DataFrame:
    """Framing rows of every floor level: numbered levels and floors."""
    rows = F.array(*(F.struct(F.lit(n).alias("part"), F.lit(o).alias("orientation"), F.lit(a).alias("assigned_to_grid"), F.lit(s).cast("double").alias("spacing_mm")) for n, o, a, s in FLOOR_ROWS))
    floors = levels.where(F.col("name").rlike(r"^(?:Level|Floor)\d+$")).select(by, "name", F.explode(rows).alias("r")).select(by, "name", "r.*")
    return floors.select(by, F.concat(F.lower("name"), F.lit("_"), "part").alias("group_id"), "orientation", "assigned_to_grid", F.col("name").alias("start_level"), F.col("name").alias("end_level"), "spacing_mm")


def roof_rows(levels: DataFrame, by: str) -> DataFrame:
    """Five roof rows where a text gives both eaves and a ridge."""
    both = levels.where(F.col("name").isin("Eave", "Ridge")).groupBy(by).agg(F.count_distinct("name").alias("n")).where("n = 2")
    names = ("group_id", "orientation", "assigned_to_grid", "start_level", "end_level")
    rows = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, row))) for row in ROOF_ROWS))
    return both.select(by, F.explode(rows).alias("r")).select(by, "r.*", F.lit(None).cast("double").alias("spacing_mm"))


def slab_rows(levels: DataFrame, by: str, thickness: float = 150.0) -> DataFrame:
    """A foundation slab for every text and a deck for each deck or floor level."""
    name = F.col("name")
    kinds = F.when(name == "Ground", "foundation").when(name.rlike("^(?:Deck|DeckTop|Level\\d+|Floor\\d+)$"), F.concat(F.lit("deck_"), F.lower("name")))
    return levels.select(by, kinds.alias("slab_id"), name.alias("top_level"), F.lit(thickness).alias("thickness_mm")).where("slab_id IS NOT NULL")


def slab_like(group_id: Column, category: Column, assignment: Column) -> Column:
    """Groups that are slabs by category, name or footprint and move to the slab table."""
    return F.coalesce((category == "slab") | F.lower(group_id).rlike("slab|foundation") | (assignment == "full_grid_footprint"), F.lit(False))


def hardware_allowed(direct: DataFrame, overlay: DataFrame, connections: DataFrame, hardware: DataFrame, hops: int = 3) -> DataFrame:
    """Allow-list of hardware: linked and overlay bolts, and what connections (a, b) reach from them in a few hops."""
    both = connections.select("a", "b").union(connections.select(F.col("b"), F.col("a")))
    reached = durable(direct.select("element_id").union(overlay.select("element_id")).distinct(), "allowed")
    front = reached
    for _ in range(hops):
        step = front.join(both, front["element_id"] == both["a"]).select(F.col("b").alias("element_id")).distinct()
        front = durable(step.join(hardware.select("element_id"), "element_id", "left_semi").join(reached, "element_id", "left_anti"), "allowed")
        reached = reached.unionByName(front)
    return reached


def pruned_hardware(elements: DataFrame, allowed: DataFrame) -> DataFrame:
    """Elements without hardware that is not allowed; openings, members and connection plates stay.

    elements: element_id, class (fastener, hole, connection, other) as `resolve.fastener_class` gives it.
    """
    loose = elements.where("class = 'fastener'").join(allowed.select("element_id"), "element_id", "left_anti").select("element_id")
    return elements.join(loose, "element_id", "left_anti")
