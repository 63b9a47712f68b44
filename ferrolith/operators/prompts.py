"""Stated quantities of specifications: constraints, grid lines, spans of levels, and member groups they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .framing import section_profile
from .graph import dealt
from .textspec import level_rank, where_may

#: The ways a text states a measure, in order of preference; group 1 is the number.
MEASURES = {
    "span_x_mm": (r"Mezzanine Total Length[^\n\r:]*:\s*(\d+(?:\.\d+)?)\s*mm", r"Total Length[^\n\r:]*:\s*(\d+(?:\.\d+)?)\s*mm", r"Length[^\n\r:]*:\s*(\d+(?:\.\d+)?)\s*mm"),
    "span_y_mm": (r"Mezzanine Total Width[^\n\r:]*:\s*(\d+(?:\.\d+)?)\s*mm", r"Total Width[^\n\r:]*:\s*(\d+(?:\.\d+)?)\s*mm", r"Width[^\n\r:]*:\s*(\d+(?:\.\d+)?)\s*mm"),
    "bay_spacing_x_mm": (r"Bay Spacing[^\n\r:]*:\s*(\d+(?:\.\d+)?)\s*mm",),
    "deck_top_elevation_mm": (r"Finished Deck Elevation[^\n\r:]*:\s*(\d+(?:\.\d+)?)\s*mm", r"top face at Z\s*=\s*(\d+(?:\.\d+)?)"),
    "column_top_mm": (r"from Z=0 to Z=(\d+(?:\.\d+)?)", r"Column tops stop at Z=(\d+(?:\.\d+)?)"),
    "slab_thickness_mm": (r"Thickness\s*=\s*(\d+(?:\.\d+)?)\s*mm",),
    "primary_beam_depth_mm": (r"HEB200\s*\(\s*(\d+(?:\.\d+)?)\s*mm\s*depth",),
}
#: The ways a text states how many members it wants.
COUNTS = {
    "count_primary_beams": (r"MAIN GIRDERS[\s\S]{0,140}?-\s*(\d+)\s*Units",),
    "count_secondary_beams": (r"FLOOR JOISTS[\s\S]{0,140}?-\s*(\d+)\s*Lines",),
    "count_bracing": (r"KNEE BRACES[\s\S]{0,140}?Add\s*(\d+)\s*diagonal",),
}
#: Columns of walls, columns by their heading, slabs.
FRONT, BACK = r"(?:Place\s+)?(\d+)\s+columns?\b[\s\S]{0,80}?\bfront\b", r"(\d+)\s+(?:matching\s+)?columns?\b[\s\S]{0,80}?\bback\b"
PER_WALL = r"(\d+)\s+columns?\s+(?:along|on)\s+(?:each\s+)?(?:side|long)\s+wall"
COLUMNS = (r"SUPPORT COLUMNS[\s\S]{0,140}?-\s*(\d+)\s*Units", r"(\d+)\s*columns?\b")
SLAB = r"IfcSlab|MEZZANINE FLOOR DECK|משטח הגלריה"
#: Grid lines and spans.
GRID_Y = (r"Grid Line Y\s*=\s*(\d+(?:\.\d+)?)", r"(?:along\s+)?grid\s+lines?\s+Y\s*=\s*(\d+(?:\.\d+)?)")
SPANNING, FROM_TO = r"Spanning[^\n]{0,120}?X\s*=\s*(0)\s*to\s*X\s*=\s*(\d+(?:\.\d+)?)", r"from\s+X\s*=\s*(\d+(?:\.\d+)?)\s*to\s*X\s*=\s*(\d+(?:\.\d+)?)"
#: Groups that quantity sections ask for: counts, heading and default of the profile, orientation,
#: placement, levels, category.
QUANTITIES = {
    "columns_along_y_min": ((r"COLUMNS[\s\S]{0,200}?(\d+)\s*Units\s*Total", r"COLUMNS[\s\S]{0,200}?-\s*(\d+)\s*Units"), "(?:REAR ANCHOR COLUMNS|ANCHOR COLUMNS)", "HEB400", "vertical", "along_all_x_at_y_min", "ground", "top", "column"),
    "beams_along_y_per_x": ((r"CANTILEVER[\s\S]{0,200}?(\d+)\s*Units\s*Total", r"PRIMARY BEAMS[\s\S]{0,200}?(\d+)\s*Units\s*Total"), "(?:CANTILEVER PRIMARY BEAMS|CANTILEVER.*PRIMARY)", "IPE450", "horizontal_y_per_frame", "along_y_per_frame_line", "deck", "deck", "beam"),
    "joists_along_x_spaced_y": ((r"JOISTS[\s\S]{0,200}?(\d+)\s*Lines\s*Total",), "(?:JOISTS|IPE160)", "IPE160", "horizontal_x", "distributed_along_y", "deck", "deck", "beam"),
    "diagonals_per_x": ((r"TENSION[\s\S]{0,200}?(\d+)\s*Units\s*Total", r"RODS[\s\S]{0,200}?(\d+)\s*Units\s*Total"), r"TENSION\s+SUSPENSION\s+RODS", "CHS60x5", "diagonal_plan", "per_x_station", "upper", "deck", "brace"),
}
#: Spacings, in order of preference.
EVERY = (r"every\s*(\d+(?:\.\d+)?)\s*mm across", r"every\s*(\d+(?:\.\d+)?)\s*mm along the X-axis", r"every\s*(\d+(?:\.\d+)?)\s*mm")
#: Edges that get a guardrail.
RAIL, RAIL_PROFILE = "GUARDRAIL|guardrail|מעקה", "RHS50x50x4"
EDGES = {"edge_at_x_min": ("horizontal_y", "along_y_at_x_min"), "edge_at_y_max": ("horizontal_x", "along_x_at_y_max"), "edge_at_x_max": ("horizontal_y", "along_y_at_x_max")}


def stated(text: Column, patterns: tuple[str, ...], kind: str = "double", low: Column | None = None) -> Column:
    """The number of the first pattern that matches; case does not matter. low: the text in lower case."""
    return F.coalesce(*(where_may(low, p, F.regexp_extract(text, f"(?i){p}", 1).try_cast(kind)) for p in patterns))


def column_count(text: Column) -> Column:
    """Columns of both walls, twice those of one wall if a text names one such number, else the plain count."""
    walls = F.regexp_extract_all(text, F.lit(f"(?i){PER_WALL}"), F.lit(1))
    both = stated(text, (FRONT,), "int") + stated(text, (BACK,), "int")
    return F.coalesce(both, F.when(F.size(walls) == 1, F.get(walls, F.lit(0)).try_cast("int") * 2), stated(text, COLUMNS, "int"))


def prompt_constraints(prompts: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Long rows (by, name, value) of everything a text fixes; names that it leaves open have no row."""
    t = F.col(text)
    values = {n: stated(t, p) for n, p in MEASURES.items()} | {"count_columns": column_count(t)} | {n: stated(t, p, "int") for n, p in COUNTS.items()} | {"count_slabs": F.when(t.rlike(f"(?i){SLAB}"), 1)}
    rows = F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()))
    stated_rows = dealt(prompts.select(by, text)).select(by, rows.alias("rows"))
    return stated_rows.select(by, F.explode(F.filter("rows", lambda r: r["value"].isNotNull())).alias("r")).select(by, "r.*")


def y_grid_lines(text: Column, width: Column, columns: Column, frames: Column, low: Column | None = None) -> Column:
    """Stated y lines, ascending; without any, three lines where the columns are three to a frame, else none."""
    found = [where_may(low, p, F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(1)), lambda x: x.cast("double"))))) for p in GRID_Y]
    triple = F.coalesce((frames >= 2) & (columns == frames * 3), F.lit(False))
    fallback = F.when(triple, F.array(F.lit(0.0), width / 2, width.cast("double"))).otherwise(F.array().cast("array<double>"))
    return F.when(F.size(found[0]) > 0, found[0]).when(F.size(found[1]) > 0, found[1]).otherwise(fallback)


def level_x_spans(prompts: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, level, x0, x1): spans that the line after a level's number states; from-to before spanning, the last of
    each. A stretch ends where the next level is named."""
    rows = prompts.select(by, F.posexplode(F.split(text, r"(?i)(?=Level\s*\d)")).alias("ord", "s")).withColumn("level", F.regexp_extract("s", r"(?i)^Level\s*(\d+)", 1).try_cast("int")).where("level IS NOT NULL")
    number = lambda p, g: F.regexp_extract("s", rf"(?i)^Level\s*\d+[^\n]{{0,320}}?{p}", g).try_cast("double")
    forms = F.array(*(F.struct(F.lit(r).alias("rank"), F.col("ord"), number(p, 1).alias("x0"), number(p, 2).alias("x1")) for r, p in enumerate((SPANNING, FROM_TO))))
    found = rows.select(by, "level", F.explode(F.filter(forms, lambda f: f["x1"].isNotNull())).alias("f"))
    return found.groupBy(by, "level").agg(F.max_by("f", F.struct("f.rank", "f.ord")).alias("f")).select(by, "level", "f.x0", "f.x1")


def quantity_rows(prompts: DataFrame, levels: DataFrame, by: str, text: str = "text", width: str = "width_mm") -> DataFrame:
    """Member groups that quantity sections state, each only where its levels exist; rails on three edges of a
    guardrail level that the text names."""
    named = lambda *n: F.min_by(F.when(F.col("name").isin(*n), F.col("name")), F.when(F.col("name").isin(*n), F.struct("elevation_mm", level_rank(F.col("name")))))
    at = levels.groupBy(by).agg(named("Deck", "DeckTop").alias("deck"), named("UpperAnchor").alias("upper"), named("Guardrail").alias("rail"), named("Eave", "ColumnTop").alias("eave"))
    rows = quantity_facts(dealt(prompts.select(by, F.col(text).alias("t"), F.col(width).alias("__width"))), F.col("t")).drop("t").join(at.hint("merge"), by)
    return rows.select(by, quantity_groups(F.col("__width")).alias("all")).select(by, F.explode("all").alias("g")).select(by, "g.*")


def quantity_facts(rows: DataFrame, t: Column, low: Column | None = None) -> DataFrame:
    """What `quantity_groups` needs of a text, each pattern read once: counts n_<group> and profiles q_<group> of all
    groups, the stated spacing, whether it names a guardrail, and its profile. low: the text in lower case."""
    rows = rows.withColumns({**{f"n_{n}": stated(t, q[0], "int", low) for n, q in QUANTITIES.items()}, "every": stated(t, EVERY, low=low), "railed": t.rlike(f"(?i){RAIL}")})
    profiles = {n: F.when(F.col(f"n_{n}").isNotNull(), section_profile(t, q[1], q[2])) for n, q in QUANTITIES.items()}
    return rows.withColumns({**{f"q_{n}": p for n, p in profiles.items()}, "q_rail": F.when(F.col("railed"), section_profile(t, "(?:GUARDRAIL|RHS50)", RAIL_PROFILE))})


def quantity_groups(width: Column) -> Column:
    """The groups of `quantity_rows` as an array, of rows with `quantity_facts`; the names of levels are in deck, upper,
    rail, eave, null if absent."""
    level = {"deck": F.col("deck"), "upper": F.col("upper"), "top": F.coalesce("upper", "eave"), "ground": F.lit("Ground")}
    rows = []
    for name, (_, _, _, orientation, placement, start, end, category) in QUANTITIES.items():
        n = F.col(f"n_{name}")
        spacing = F.coalesce(F.nullif("every", F.lit(0.0)), width / F.greatest(F.lit(1), n - 1)) if name.startswith("joists") else F.lit(None).cast("double")
        rows.append(F.when(n.isNotNull() & level[start].isNotNull() & level[end].isNotNull(), _group(name, F.col(f"q_{name}"), orientation, placement, level[start], level[end], spacing, n, category)))
    for name, (orientation, placement) in EDGES.items():
        rows.append(F.when(F.col("rail").isNotNull() & F.col("railed"), _group(name, F.col("q_rail"), orientation, placement, F.col("rail"), F.col("rail"), F.lit(None).cast("double"), F.lit(None).cast("int"), "beam")))
    return F.array_compact(F.array(*rows))


def _group(name: str, profile: Column, orientation: str, placement: str, start: Column, end: Column, spacing: Column, count: Column, category: str) -> Column:
    return F.struct(
        F.lit(name).alias("group_id"), profile.alias("profile"), F.lit(orientation).alias("orientation"), F.lit(placement).alias("assigned_to_grid"), start.alias("start_level"), end.alias("end_level"), spacing.alias("spacing_mm"), count.alias("member_count"),
        F.lit(category).alias("category"),
    )
