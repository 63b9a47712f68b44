"""Whole intents out of texts: grid, levels, member groups and slabs, by one table of rules.

A text is read once into named facts, each with the rule that stated it. Then every rule of the tables below is a
struct that holds where its condition does, all of them in one projection: what a text asks for is an array of groups,
each with the rule it comes from. Joins are needed for the levels only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import dealt, durable
from .prompts import quantity_facts, quantity_groups, y_grid_lines
from .textspec import LEGACY, broken_lines, level_rank, may_match, stated_levels, where_may

NUMBER = r"(\d+(?:\.\d+)?)"
#: The ways a text states the building's size, in order of preference, by name of the rule.
SIZES = {
    "length_x_mm": {"length": rf"(?:Total )?(?:Structural |Cantilever )?Length[^\n\r:]*:\s*{NUMBER}\s*mm"},
    "width_y_mm": {
        "width": rf"(?:Total )?(?:Structural |Floating )?Width[^\n\r:]*:\s*{NUMBER}\s*mm",
        "projection": rf"(?:Total )?(?:Floating )?Projection[^\n\r:]*:\s*{NUMBER}\s*mm",
        "mezzanine": rf"(?:Mezzanine )?Total Width[^\n\r:]*:\s*{NUMBER}\s*mm",
    },
    "bay_spacing_x_mm": {"spacing": rf"(?:Bay Spacing|(?:Global )?Grid Spacing)[^\n\r:]*:\s*{NUMBER}\s*mm", "increments": rf"{NUMBER}\s*mm increments along the X-Axis"},
}
#: Other numbers of a text, in order of preference.
FACTS = {
    "grid_columns": {"grid": r"(?:VERTICAL|DUAL-GRID) COLUMNS[\s\S]{0,240}?(\d+)\s*Units"},
    "girders": {"girders": r"MAIN GIRDERS[\s\S]{0,160}?-\s*(\d+)\s*Units"},
    "joist_lines": {"joists": r"FLOOR JOISTS[\s\S]{0,160}?-\s*(\d+)\s*Lines"},
    "knees": {"knees": r"KNEE BRACES[\s\S]{0,160}?Add\s*(\d+)\s*diagonal"},
    "purlins": {"lines_of_z": r"(\d+)\s+lines\s+of\s+Z", "heading": r"Roof Purlins[^\n]{0,80}?(\d+)\s+lines", "longitudinal": r"(\d+)\s+lines[^\n]{0,40}longitudinally"},
    "girts": {"lines_of_c": r"(\d+)\s+lines\s+of\s+C"},
    "webs": {"per_frame": r"Web Members[\s\S]{0,160}?(\d+)\s*Units per frame"},
    "level1_beams": {"level1": r"Level 1[\s\S]{0,500}?Primary Beams[\s\S]{0,120}?(\d+)\s*Units"},
    "slab_mm": {"thickness": rf"Thickness\s*=\s*{NUMBER}\s*mm"},
    "foundation_mm": {"foundation": rf"FOUNDATION[\s\S]{{0,200}}?Thickness\s*=\s*{NUMBER}\s*mm"},
    "deck_mm": {"dimensions": rf"Dimensions:[^\n]*Thickness\s*=\s*{NUMBER}\s*mm", "thickness": rf"Thickness\s*=\s*{NUMBER}\s*mm"},
    "deck1_mm": {"level1": rf"Level 1[\s\S]{{0,400}}?Floor Deck[\s\S]{{0,80}}?{NUMBER}\s*mm", "deck": rf"Floor Deck[\s\S]{{0,80}}?{NUMBER}\s*mm thickness"},
    "deck2_mm": {"level2": rf"Level 2[\s\S]{{0,400}}?{NUMBER}\s*mm thickness"},
    "joists_mm": {"along_x": rf"every\s*{NUMBER}\s*mm along the X-axis"},
    "joists1_mm": {"level1": rf"Level 1[\s\S]{{0,500}}?every\s*{NUMBER}\s*mm"},
    "joists2_mm": {"level2": rf"Level 2[\s\S]{{0,500}}?Secondary Joists[\s\S]{{0,200}}?every\s*{NUMBER}\s*mm", "across": rf"Secondary Joists[\s\S]{{0,200}}?every\s*{NUMBER}\s*mm across"},
    "spine_y_mm": {"spine": rf"(?:spine|Spine)[^\n]{{0,80}}?Y\s*=\s*{NUMBER}"},
    "edge_y_mm": {"edge": rf"(?:floating edge|outer floating tips)[^\n]{{0,80}}?Y\s*=\s*{NUMBER}"},
}
#: The columns of a frame, in order of preference; walls need both of their numbers.
COLUMN_COUNTS = {"units": r"MAIN STRUCTURAL COLUMNS[\s\S]{0,160}?(\d+)\s*Units", "support": r"SUPPORT COLUMNS[\s\S]{0,160}?-\s*(\d+)\s*Units"}
FRONT, BACK = r"(\d+)\s+columns?\s+along\s+the\s+front", r"(\d+)\s+matching\s+columns?\s+along\s+the\s+back"
HEADED, REAR = r"MAIN COLUMNS|MAIN STRUCTURAL COLUMNS", r"(\d+)\s+columns?\s+strictly along[^\n]{0,80}Y\s*=\s*0"
#: Stretches along x and y of numbered levels.
SPANNING = rf"Level\s*(\d+)(?:(?!Level\s*\d)[^\n]){{0,320}}?(?:Spanning|spanning)[^\n]{{0,120}}?X\s*=\s*0\s*to\s*X\s*=\s*{NUMBER}"
FROM_TO = rf"Level\s*(\d+)(?:(?!Level\s*\d)[^\n]){{0,320}}?(?:from|From)\s+X\s*=\s*{NUMBER}\s*to\s*X\s*=\s*{NUMBER}"
PROJECTING = rf"projecting out from Y\s*=\s*{NUMBER}\s*to\s*Y\s*=\s*{NUMBER}"
#: What is used where a text states nothing.
DEFAULTS = {"slab_mm": 500.0, "joists_mm": 2500.0, "joists1_mm": 1000.0, "joists2_mm": 600.0, "deck1_mm": 50.0, "deck2_mm": 50.0, "girts": 8, "webs": 8, "purlins": 10}
CANTILEVER, PROJECTION = (15000.0, 5000.0), (0.0, 10000.0)
#: Names of sections, what stands for cold-formed ones, and how far behind a heading they may stand.
SECTION = r"((?:IPE|HEA|HEB|HEM|UPN|UPE)\s*\d{2,4}|RHS\s*\d+(?:\.\d+)?[xX×]\d+(?:\.\d+)?[xX×]\d+(?:\.\d+)?|CHS\s*\d+(?:\.\d+)?[xX×]\d+(?:\.\d+)?|[CZ]\s*\d+(?:\.\d+)?[xX×]\d+(?:\.\d+)?)"
COLD_FORMED, REACH = {"Z": "100x100x6", "C": "100x50x4"}, 320
#: Headings of profiles and what stands where they name none; those of zones on numbered levels.
ZONE_PROFILES = {
    "grid": ("VERTICAL COLUMNS|DUAL-GRID", "HEB450"), "level1_beams": (r"Level 1[\s\S]{0,500}?Primary Beams", "HEB300"), "level1_joists": (r"Level 1[\s\S]{0,500}?IPE180", "IPE180"),
    "cantilevers": (r"Level 2[\s\S]{0,500}?Cantilever Beams", "IPE500"), "hangers": (r"TENSION\s+HANGER|Hanger Rods", "CHS89x6"), "level2_joists": (r"Level 2[\s\S]{0,500}?Secondary Joists", "IPE140"), "rail": ("SAFETY GUARDRAILS|GUARDRAIL", "RHS50x50x4"),
}
PROFILES = ZONE_PROFILES | {
    "top_chords": ("Top Rafter Chords|Top Chords|חגורה עליונה", "IPE300"), "bottom_chords": ("Bottom Chord Ties|Bottom Chord|חגורה תחתונה", "HEA220"), "webs": ("Web Members|פנימיים", "RHS90x90x6"),
    "purlins": ("ROOF PURLINS|מרישי גג", "100x100x6"), "girts": ("WALL GIRTS|מרישי קיר", "100x50x4"), "roof_plane": ("Roof Plane Bracing|CHS60x4", "CHS60x4"), "walls": ("Vertical Wall Bracing|Wall Bracing|CHS76", "CHS76x4"),
    "columns": ("REAR ANCHOR COLUMNS|MAIN STRUCTURAL COLUMNS|MAIN COLUMNS|SUPPORT COLUMNS", "HEB200"), "primary": ("Primary Beams|MAIN GIRDERS", "HEB300"), "joists": ("Secondary Joists|FLOOR JOISTS", "IPE180"),
}
#: What a text must mention for braces, truss patterns and slabs.
ROOF_BRACED, WALL_BRACED, WARREN = "Roof Plane Bracing", "Wall Bracing|הקשחה|cross-brace|X-BRACING", r"Warren\s+truss"
FULL_HEIGHT, LEVEL_BRACED = r"(?:column bases|column tops|from Z\s*=\s*0).*?(?:to|Z\s*=\s*)\s*(\d+(?:\.\d+)?)", r"Wall Bracing[\s\S]{0,120}Level\s*\d"
FOUNDATION, DECK = "HEAVY CONCRETE FOUNDATION|foundation slab", r"MEZZANINE FLOOR DECK|\bFLOOR SLAB\b|(?:^|\n)\s*Floor Deck\b"
JOISTS_ALONG_X = r"JOISTS[\s\S]{0,320}?along the X-axis"
FLAGS = {"walls_braced": WALL_BRACED, "roof_braced": ROOF_BRACED, "full_height": FULL_HEIGHT, "warren": WARREN, "joists_along_x": JOISTS_ALONG_X, "founded": FOUNDATION, "decked": DECK}
#: Levels that are no storeys and levels that carry no deck.
NO_STOREY, NO_DECK = ("Ridge", "BraceStart", "Guardrail"), ("Ground", "Eave", "Ridge", "UpperAnchor", "Guardrail", "ColumnTop", "BraceStart")
DECKS = ("DeckTop", "Deck", "Level1")

GROUP = (
    "group_id string, profile string, orientation string, assigned_to_grid string, start_level string, end_level string, spacing_mm double, member_count int, brace_offset_x_mm double, fixed_elevations_mm array<double>, "
    "x_min_mm double, x_max_mm double, y_from_mm double, y_to_mm double, y_at_mm array<double>, y_min_mm double, y_max_mm double, category string, rule string"
)
FIELDS = [f.split(" ", 1) for f in GROUP.split(", ")]
SLAB = "slab_id string, top_level string, thickness_mm double, footprint string, x_min_mm double, x_max_mm double, y_min_mm double, y_max_mm double, rule string"


def first_stated(text: Column, rules: dict[str, str], kind: str = "double", low: Column | None = None) -> Column:
    """struct<value, rule> by the first pattern that matches; null where none does. Case does not matter. low: the text in
    lower case, in which a pattern's pieces are looked for before the pattern runs."""
    ways = F.array(*(F.struct(where_may(low, p, F.regexp_extract(text, f"(?i){p}", 1).try_cast(kind)).alias("value"), F.lit(rule).alias("rule")) for rule, p in rules.items()))
    return F.try_element_at(F.filter(ways, lambda w: w["value"].isNotNull()), F.lit(1))


def _stretch(text: Column, heading: str, low: Column | None = None) -> Column:
    return where_may(low, heading, F.regexp_extract(text, rf"(?i)(?:{heading})[\s\S]{{0,{REACH}}}", 0))


def _named(stretch: Column) -> Column:
    """Sections of a stretch, the one behind the word Profile and the first of all; empty where there is none."""
    return F.array(*(F.regexp_extract(stretch, f"(?i){p}{SECTION}", 1) for p in (r"Profile\s*:\s*", "")))


def _key(named: Column) -> Column:
    return F.replace(F.upper(F.trim(F.try_element_at(F.filter(named, lambda n: n != ""), F.lit(1)))), F.lit(" "), F.lit(""))


def _made(key: Column, default: str) -> Column:
    cold = F.when(key.startswith("Z"), COLD_FORMED["Z"]).when(key.startswith("C") & ~key.startswith("CHS"), COLD_FORMED["C"])
    return F.coalesce(cold, key, F.lit(default))


def profile_after(text: Column, heading: str, default: str) -> Column:
    """The section that a heading's stretch names, first behind the word Profile; cold-formed ones by their stand-in."""
    return _made(_key(_named(_stretch(text, heading))), default)


def with_profiles(rows: DataFrame, text: Column, zoned: Column, low: Column | None = None) -> DataFrame:
    """`profile_after` for each heading of PROFILES as column p_<name>; those of zones only in texts that may have them.

    Each step is a column of its own, so that a pattern runs once a text however many groups use its profile.
    """
    of = lambda n, h: F.when(zoned, _stretch(text, h, low)) if n in ZONE_PROFILES else _stretch(text, h, low)
    rows = rows.withColumns({f"p_{n}": of(n, h) for n, (h, _) in PROFILES.items()})
    rows = rows.withColumns({f"p_{n}": F.when(F.col(f"p_{n}") != "", _named(F.col(f"p_{n}"))) for n in PROFILES})
    rows = rows.withColumns({f"p_{n}": _key(F.col(f"p_{n}")) for n in PROFILES})
    return rows.withColumns({f"p_{n}": _made(F.col(f"p_{n}"), default) for n, (_, default) in PROFILES.items()})


@dataclass(frozen=True)
class Rule:
    """One group: when it is asked for and what it is. Strings stand for themselves, columns for what they compute."""

    when: Column
    group_id: str | Column
    section: str | Column  # name of the profile's heading in PROFILES, or the profile
    orientation: str | Column
    placement: str | Column
    start: str | Column
    end: str | Column
    category: str = "beam"
    rule: str | Column = "text"
    more: dict[str, Column] = field(default_factory=dict)

    def struct(self) -> Column:
        profile = self.section if isinstance(self.section, Column) else F.col(f"p_{self.section}")
        values = {
            "group_id": self.group_id, "profile": profile, "orientation": self.orientation, "assigned_to_grid": self.placement, "start_level": self.start, "end_level": self.end, "category": self.category, "rule": self.rule, **self.more,
        }
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(self.when, F.struct(*(as_column(values.get(n)).cast(t).alias(n) for n, t in FIELDS)))


def _groups(rules: list[Rule]) -> Column:
    return F.array_compact(F.array(*(r.struct() for r in rules)))


def _facts(prompts: DataFrame, levels: DataFrame, by: str) -> DataFrame:
    """One row a text (t) whose size is stated, with its facts and the names of its levels."""
    t, low = F.col("t"), F.col("low")
    rows = prompts.select(by, "t", F.lower("t").alias("low")).select(by, "t", "low", *(first_stated(t, rules, low=low).alias(f"f_{n}") for n, rules in SIZES.items()))
    rows = rows.where(" AND ".join(f"f_{n} IS NOT NULL" for n in SIZES)).withColumns({n: F.col(f"f_{n}.value") for n in SIZES})
    rows = rows.withColumn("frames", F.bround(F.col("length_x_mm") / F.nullif("bay_spacing_x_mm", F.lit(0.0))).cast("int") + 1)
    whole = {"grid_columns", "girders", "joist_lines", "knees", "purlins", "girts", "webs", "level1_beams"}
    rows = rows.withColumns({n: first_stated(t, rules, "int" if n in whole else "double", low) for n, rules in FACTS.items()})
    # of these a zero is as good as no statement
    kept = {n: F.coalesce(F.nullif(F.col(f"{n}.value"), F.lit(0).cast("int" if n in whole else "double")), F.lit(v)) for n, v in DEFAULTS.items()}
    rows = rows.withColumns({f"{n}_or": c for n, c in kept.items()})
    rows = rows.withColumn("lines_y", y_grid_lines(t, F.col("width_y_mm"), F.col("grid_columns.value"), F.col("frames"), low))

    front, back, rear = (where_may(low, p, F.regexp_extract(t, f"(?i){p}", 1).try_cast("int")) for p in (FRONT, BACK, REAR))
    count = lambda value, rule: F.struct(value.cast("int").alias("value"), F.lit(rule).alias("rule"))
    columns = F.coalesce(
        first_stated(t, COLUMN_COUNTS, "int", low), F.when(front.isNotNull() & back.isNotNull(), count(front + back, "walls")), F.when(t.rlike(f"(?i){HEADED}"), count(F.col("frames") * 2, "frames")), F.when(rear.isNotNull(), count(rear, "rear"))
    )
    rows = rows.withColumn("columns", columns)
    both = F.col("spine_y_mm").isNotNull() & F.col("edge_y_mm").isNotNull()
    for name, part, default in (("spine", "spine_y_mm", CANTILEVER[0]), ("tip", "edge_y_mm", CANTILEVER[1])):
        rows = rows.withColumn(name, F.when(both, F.col(f"{part}.value")).otherwise(default))
    projected = where_may(low, PROJECTING, F.regexp_extract(t, f"(?i){PROJECTING}", 1) != "")
    rows = rows.withColumns({n: F.when(projected, F.regexp_extract(t, f"(?i){PROJECTING}", i + 1).try_cast("double")).otherwise(PROJECTION[i]) for i, n in enumerate(("deck_y0", "deck_y1"))})
    half, full = F.col("length_x_mm") / 2, F.col("length_x_mm")
    rows = rows.withColumns({"from_to": _spans(t, FROM_TO, low), "spanning": _spans(t, SPANNING, low)})
    for level, start, end in ((1, F.lit(0.0), half), (2, half, full)):
        rows = rows.withColumn(f"span{level}", F.coalesce(_last_span("from_to", level), _last_span("spanning", level), F.struct(start.alias("x0"), end.alias("x1"))))
    zoned = F.col("zoned")
    held = lambda p: may_match(low, p) & t.rlike(f"(?i){p}")
    rows = rows.withColumns({"zoned": held(r"Level\s*1\b"), **{n: held(p) for n, p in FLAGS.items()}, "upright_braced": held("Vertical Wall Bracing") & ~held(LEVEL_BRACED)})
    rows = quantity_facts(with_profiles(rows, t, zoned, low), t, low)

    z, name = F.col("elevation_mm"), F.col("name")
    at = lambda n, out: F.max(F.when(name == n, z)).alias(out)
    first, last = F.struct(z, level_rank(name)), F.struct(z, -level_rank(name))  # of one height the earlier name
    lowest = lambda *n: F.min_by(F.when(name.isin(*n), name), F.when(name.isin(*n), first))
    held = levels.groupBy(by).agg(
        at("Eave", "z_eave"), at("Ridge", "z_ridge"), at("Level1", "z_level1"), at("Level2", "z_level2"), at("BraceStart", "z_brace"), at("DeckTop", "z_deck_top"), at("ColumnTop", "z_column_top"),
        lowest("Deck", "DeckTop").alias("deck"), lowest("UpperAnchor").alias("upper"), lowest("Guardrail").alias("rail"), lowest("Eave", "ColumnTop").alias("eave"), F.max_by(name, last).alias("highest"),
        F.max_by(F.when(~name.isin(*NO_DECK), name), F.when(~name.isin(*NO_DECK), last)).alias("deck_like"),
        F.sort_array(F.collect_list(F.struct(z.alias("z"), level_rank(name).alias("rank"), name.alias("name")))).alias("levels"),
    )
    rows = rows.drop("t", "low", "from_to", "spanning").join(held.hint("merge"), by)
    top = F.when(F.col("z_eave").isNotNull(), "Eave").when(F.col("z_column_top").isNotNull(), "ColumnTop").otherwise(F.col("highest"))
    return rows.withColumns({"top": top, "multi": F.col("z_level1").isNotNull() & zoned})


def _spans(t: Column, pattern: str, low: Column) -> Column:
    """array<struct<n, x0, x1>> of all statements about stretches of levels; null in texts that can hold none."""
    part = lambda g: F.regexp_extract_all(t, F.lit(f"(?i){pattern}"), F.lit(g))
    start = part(2) if pattern == FROM_TO else F.transform(part(1), lambda x: F.lit("0"))
    rows = F.arrays_zip(part(1).alias("n"), start.alias("a"), part(3 if pattern == FROM_TO else 2).alias("b"))
    return F.when(may_match(low, pattern), F.transform(rows, lambda s: F.struct(s["n"].try_cast("int").alias("n"), s["a"].try_cast("double").alias("x0"), s["b"].try_cast("double").alias("x1"))))


def _last_span(spans: str, level: int) -> Column:
    """struct<x0, x1> of the last statement about a level."""
    last = F.try_element_at(F.filter(spans, lambda s: s["n"] == level), F.lit(-1))
    return F.when(last.isNotNull(), F.struct(last["x0"].alias("x0"), last["x1"].alias("x1")))


def multi_level_groups() -> Column:
    """Groups of texts with zones on numbered levels: columns of the grid, a part mezzanine, a hung deck, its rails."""
    x1, x2 = {"x_max_mm": F.col("span1.x1")}, {"x_min_mm": F.col("span2.x0"), "x_max_mm": F.col("span2.x1")}
    deck_y = {"y_min_mm": F.col("deck_y0"), "y_max_mm": F.col("deck_y1")}
    hung = {**x2, "y_from_mm": F.col("spine"), "y_to_mm": F.col("tip")}
    lines = F.when(F.size("lines_y") > 0, F.col("lines_y"))
    second = F.col("z_level2").isNotNull()
    full_grid = F.col("grid_columns").isNotNull() & (F.size("lines_y") > 0) & (F.col("grid_columns.value") == F.col("frames") * F.size("lines_y"))
    edge = lambda side, along, place, limits: Rule(second & F.col("rail").isNotNull(), f"level2_guard_at_{side}", "rail", along, place, F.col("rail"), F.col("rail"), rule="rail", more=limits)
    at_x = lambda end: {"x_min_mm": F.col(f"span2.{end}"), "x_max_mm": F.col(f"span2.{end}"), **deck_y}
    at_y = lambda end: {**x2, "y_min_mm": F.col(end), "y_max_mm": F.col(end)}
    rules = [
        Rule(full_grid, "grid_columns", "grid", "vertical", "all_frame_lines", "Ground", F.col("top"), "column", "grid", {"member_count": F.col("grid_columns.value")}),
        Rule(F.lit(True), "level1_primary_beams", "level1_beams", "horizontal_x", "along_x_at_each_y_line", "Level1", "Level1", rule="level", more={**x1, "y_at_mm": lines, "member_count": F.col("level1_beams.value")}),
        Rule(F.lit(True), "level1_joists", "level1_joists", "horizontal_y", "distributed_along_x", "Level1", "Level1", rule="level", more={**x1, "spacing_mm": F.col("joists1_mm_or")}),
        Rule(second, "level2_cantilevers", "cantilevers", "horizontal_y", "along_y_per_x_station", "Level2", "Level2", rule="level", more=hung),
        Rule(second, "level2_hangers", "hangers", "diagonal_plan", "per_x_station", F.col("top"), "Level2", "brace", "level", hung),
        Rule(second, "level2_joists", "level2_joists", "horizontal_x", "distributed_along_y", "Level2", "Level2", rule="level", more={**x2, **deck_y, "spacing_mm": F.col("joists2_mm_or")}),
        edge("x_min", "horizontal_y", "along_y_at_fixed_x", at_x("x0")), edge("x_max", "horizontal_y", "along_y_at_fixed_x", at_x("x1")), edge("y_min", "horizontal_x", "along_x_at_fixed_y", at_y("deck_y0")), edge("y_max", "horizontal_x", "along_x_at_fixed_y", at_y("deck_y1")),
    ]
    return _groups(rules)


def roof_groups() -> Column:
    """Five groups of a roof, where a text has an eave and a ridge."""
    both = F.col("z_eave").isNotNull() & F.col("z_ridge").isNotNull()
    girts = F.transform(F.sequence(F.lit(1), F.col("girts_or")), lambda i: F.col("z_eave") * i / F.col("girts_or"))
    row = lambda name, section, along, place, start, end, **more: Rule(both, name, section, along, place, start, end, rule="roof", more=more)
    webs = F.when(F.col("warren"), "web_members_warren").otherwise("web_members")
    rules = [
        row("top_chords", "top_chords", "inclined_dual_y", "all_frame_lines", "Eave", "Ridge"),
        row("bottom_chords", "bottom_chords", "horizontal_y_per_frame", "along_y_per_frame_line", "Eave", "Eave"),
        row(webs, "webs", "truss_web_panels", "all_frame_lines", "Eave", "Ridge", member_count=F.col("webs_or")),
        row("roof_purlins", "purlins", "roof_purlins_dual_slope", "all_frame_lines", "Eave", "Ridge", member_count=F.col("purlins_or")),
        row("wall_girts", "girts", "wall_girts_fixed_z", "all_frame_lines", "Eave", "Eave", fixed_elevations_mm=girts),
    ]
    return _groups(rules)


def brace_groups() -> Column:
    """Braces of the roof plane (only beside numbered levels) and of walls: full height, or storey by storey."""
    both = F.col("z_eave").isNotNull() & F.col("z_ridge").isNotNull()
    mentioned, whole = F.col("walls_braced"), F.col("full_height") | (F.col("upright_braced") & F.col("eave").isNotNull())
    ends = _groups([
        Rule(F.col("multi") & both & F.col("roof_braced"), "roof_plane_bracing", "roof_plane", "diagonal_plan", "roof_truss_diagonals", "Eave", "Ridge", "brace", "roof_plane"),
        Rule(mentioned & whole, "wall_brace_full_height", "walls", "diagonal_plan", "first_and_last_bay_braces", "Ground", F.coalesce("eave", "top"), "brace", "full_height"),
    ])
    storeys = F.filter("levels", lambda s: ~s["name"].isin(*NO_STOREY))
    above = F.slice(storeys, F.lit(2), F.greatest(F.size(storeys) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(F.slice(storeys, F.lit(1), F.greatest(F.size(storeys) - 1, F.lit(0))), above, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"]["z"] - p["a"]["z"] > 1e-6)
    storey = lambda p: Rule(F.lit(True), F.concat(F.lit("wall_brace_"), p["a"]["name"], F.lit("_"), p["b"]["name"]), "walls", "diagonal_plan", "first_and_last_bay_braces", p["a"]["name"], p["b"]["name"], "brace", "storey").struct()
    return F.concat(ends, F.when(mentioned & ~whole, F.transform(pairs, storey)).otherwise(F.array().cast(f"array<struct<{_ddl(GROUP)}>>")))


def frame_groups() -> Column:
    """Columns by the first of five ways to count them, floors, girders, joists, knee braces of texts without zones."""
    n = F.col("columns.value")
    columns = _groups([
        Rule(n.isNotNull(), "main_columns", "columns", "vertical", F.when(n == F.col("frames"), "along_all_x_at_y_min").otherwise("all_frame_lines"), "Ground",
             F.coalesce("upper", "top"), "column", F.col("columns.rule"), {"member_count": n}),
    ])

    def floor(level: Column) -> Column:
        name = level["name"]
        of = lambda part, profile, along, place, **more: Rule(F.lit(True), F.concat(F.lower(name), F.lit(part)), profile, along, place, name, name, rule="floor", more=more)
        rules = [of("_primary_x", "primary", "horizontal_x", "along_x_between_columns"), of("_primary_y", "primary", "horizontal_y", "along_y_at_frame_ends", member_count=F.lit(2)), of("_joists", "joists", "horizontal_y", "distributed_along_x", spacing_mm=F.col("joists_mm_or"))]
        return F.array(*(r.struct() for r in rules))

    floors = F.flatten(F.transform(F.filter("levels", lambda s: s["name"].startswith("Floor")), floor))
    girders = F.col("girders").isNotNull() & F.col("z_deck_top").isNotNull()
    lines = F.col("joist_lines.value")
    along_x = F.col("joists_along_x")
    rest = _groups([
        Rule(girders, "primary_girders_x", "primary", "horizontal_x", "along_x_between_columns", "DeckTop", "DeckTop", rule="girders", more={"member_count": F.greatest(F.lit(0), F.col("girders.value") - 2)}),
        Rule(girders, "primary_girders_y", "primary", "horizontal_y", "along_y_at_frame_ends", "DeckTop", "DeckTop", rule="girders", more={"member_count": F.lit(2)}),
        Rule(lines.isNotNull() & F.col("deck").isNotNull(), "floor_joists", "joists", F.when(along_x, "horizontal_y").otherwise("horizontal_x"), F.when(along_x, "distributed_along_x").otherwise("distributed_along_y"), F.col("deck"), F.col("deck"),
             rule="joists", more={"spacing_mm": F.col("joists_mm_or"), "member_count": lines}),
        Rule(F.col("knees").isNotNull() & F.col("z_brace").isNotNull(), "knee_braces", F.lit("RHS80x80x5"), "diagonal_plan", "corner_braces", "BraceStart", F.col("top"), "brace", "knees", {"member_count": F.col("knees.value"), "brace_offset_x_mm": F.lit(1000.0)}),
    ])
    return F.concat(columns, floors, rest)


def composed_groups(rows: DataFrame) -> DataFrame:
    """Facts with the column groups, all groups of a text. Zones on levels stand alone; a complete set of quantities replaces all others, and of an
    incomplete one those are added whose id is new and which no older group stands for."""
    wide = lambda q: F.struct(*((q[n] if n in ("group_id", "profile", "orientation", "assigned_to_grid", "start_level", "end_level", "spacing_mm", "member_count", "category") else F.lit("quantity") if n == "rule" else F.lit(None)).cast(kind).alias(n) for n, kind in FIELDS))
    rows = rows.withColumns({"quantities": F.transform(quantity_groups(F.col("width_y_mm")), wide), "over": F.concat(roof_groups(), brace_groups())})
    rows = rows.withColumns({"zones": F.when(F.col("multi"), F.concat(multi_level_groups(), "over")), "frame": F.when(~F.col("multi"), F.concat(frame_groups(), "over"))})
    ids = F.transform("quantities", lambda q: q["group_id"])
    complete = (F.size(ids) >= 5) & F.array_contains(ids, "beams_along_y_per_x") & F.array_contains(ids, "diagonals_per_x")

    def needless(q: Column) -> Column:
        stands_for = F.create_map(*(x for k, ps in LEGACY.items() for x in (F.lit(k), F.array(*map(F.lit, ps)))))
        olds = F.coalesce(F.try_element_at(stands_for, q["group_id"]), F.array().cast("array<string>"))
        return F.exists("frame", lambda g: (g["group_id"] == q["group_id"]) | F.exists(olds, lambda p: (g["group_id"] == p) | g["group_id"].startswith(F.concat(p, F.lit("_")))))

    return rows.withColumn("groups", F.when(F.col("multi"), F.col("zones")).when(complete, F.col("quantities")).otherwise(F.concat("frame", F.filter("quantities", lambda q: ~needless(q)))))


def slab_array() -> Column:
    """Foundation, part decks of levels 1 and 2, and one general deck where level 1 has none."""
    one = F.col("z_level1").isNotNull()
    slab = lambda when, name, top, mm, rule, x=(None, None), y=(None, None): F.when(when, F.struct(
        F.lit(name).alias("slab_id"), (top if isinstance(top, Column) else F.lit(top)).alias("top_level"), mm.cast("double").alias("thickness_mm"), F.lit("partial_xy" if x[0] is not None else "full_grid").alias("footprint"),
        *((v if v is not None else F.lit(None)).cast("double").alias(c) for v, c in zip((*x, *y), ("x_min_mm", "x_max_mm", "y_min_mm", "y_max_mm"))), F.lit(rule).alias("rule"),
    ))
    or_slab = lambda fact: F.coalesce(F.nullif(F.col(f"{fact}.value"), F.lit(0.0)), F.col("slab_mm_or"))
    named = F.array_intersect(F.array(*map(F.lit, DECKS)), F.transform("levels", lambda s: s["name"]))
    top = F.coalesce(F.try_element_at(named, F.lit(1)), F.col("deck_like"), F.lit("DeckTop"))
    return F.array_compact(F.array(
        slab(F.col("founded"), "foundation_slab", "Ground", or_slab("foundation_mm"), "foundation"),
        slab(one, "level1_deck_slab", "Level1", F.col("deck1_mm_or"), "level", (F.col("span1.x0"), F.col("span1.x1")), (F.lit(0.0), F.col("width_y_mm"))),
        slab(F.col("z_level2").isNotNull(), "level2_deck_slab", "Level2", F.col("deck2_mm_or"), "level", (F.col("span2.x0"), F.col("span2.x1")), (F.col("deck_y0"), F.col("deck_y1"))),
        slab(~one & F.col("decked"), "deck_slab", top, or_slab("deck_mm"), "deck"),
    ))


def _ddl(fields: str) -> str:
    return ", ".join(": ".join(f.split(" ", 1)) for f in fields.split(", "))


def composed(prompts: DataFrame, by: str, text: str = "text") -> dict[str, DataFrame]:
    """Tables grids, levels, groups and slabs of the texts that state length, width and bays and ask for some member, and
    the groups and slabs beside their levels' heights and their text's grid (placed, placed_slabs), without a join.

    Groups carry their place in the text's order (seq) and the rule that asked for them; grids the rules that stated
    their sizes. Null and empty texts, and texts without a size or without a member, have no row in any table.
    """
    # texts are few beside the work that each one asks for: they are dealt to all cores
    prompts = durable(dealt(prompts.select(by, text)).select(by, broken_lines(F.col(text)).alias("t")), "intent-texts")
    levels = durable(stated_levels(prompts, by, "t"), "intent-levels")
    rows = durable(_facts(prompts, levels, by), "intent-facts")
    rows = composed_groups(rows).withColumns({"slabs": slab_array(), "z_of": F.map_from_arrays("levels.name", "levels.z")})
    kept = [by, *SIZES, *(f"f_{n}" for n in SIZES), "lines_y", "groups", "slabs", "z_of", "z_eave", "z_ridge"]
    rows = durable(rows.where(F.size("groups") > 0).select(*kept), "intents")  # read once, whatever is made of it
    empty = F.lit(None).cast("array<double>")
    grids = rows.select(by, *SIZES, empty.alias("frame_line_x_mm"), F.when(F.size("lines_y") > 0, F.col("lines_y")).alias("frame_line_y_mm"), *(F.col(f"f_{n}.rule").alias(f"{n.split('_')[0]}_rule") for n in SIZES))
    groups = rows.select(by, F.posexplode("groups").alias("seq", "g")).select(by, "seq", "g.*")
    slabs = rows.select(by, F.explode("slabs").alias("s")).select(by, "s.*")
    z = lambda name: F.try_element_at("z_of", F.col(name))
    lines = [*SIZES, empty.alias("frame_line_x_mm"), F.when(F.size("lines_y") > 0, F.col("lines_y")).alias("frame_line_y_mm"), F.col("z_eave").alias("eave"), F.col("z_ridge").alias("ridge")]
    placed = rows.select(by, *lines, "z_of", F.explode("groups").alias("g"))
    placed = placed.select(by, "g.*", z("g.start_level").alias("z0"), z("g.end_level").alias("z1"), *SIZES, "frame_line_x_mm", "frame_line_y_mm", "eave", "ridge").where("z0 IS NOT NULL AND z1 IS NOT NULL")
    tops = rows.select(by, "length_x_mm", "width_y_mm", "z_of", F.explode("slabs").alias("s")).select(by, "s.*", z("s.top_level").alias("ez"), "length_x_mm", "width_y_mm").where("ez IS NOT NULL")
    return {"placed": placed, "placed_slabs": tops, "grids": grids, "levels": levels.join(rows.select(by).hint("merge"), by, "left_semi"), "groups": groups, "slabs": slabs}
