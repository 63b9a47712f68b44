"""Whole buildings of seven kinds by one grammar: members over stations, with ends as functions of the station.

Requests: model_id, kind, length_mm, width_mm, eave_mm, ridge_mm, bay_mm, slab_mm, n_columns, n_purlins, front_mm and
back_mm (heights of girts), sections (map of part to section). A kind is the list of parts that `grammar` gives it; a
part stands once at each of its stations. New kinds are new rows, not new code paths.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import dealt
from .intent import NUMBER, SECTION
from .members import FALLBACK
from .textspec import HEIGHT, SPAN, WIDTH, column_count, first_measure, profile_mentions, request_flags, role_profiles

NODE_MM = 2500
#: Words that a text of each kind holds, one of every row; the first kind that fits counts.
WORDS = {
    "truss": (("industrial warehouse", "warehouse", "מסבכים"), ("truss", "agdi", "מסבך"), ("ifcslab", "foundation slab", "רצפת בטון")),
    "monoslope": (("monoslope", "חד-שיפוע", "שיפוע אחד"), ("ifcslab", "concrete slab", "רצפת בטון"), ("rafter", "קורות גג")),
    "gable": (("gable", "דו-שיפוע"), ("ridge", "apex", "רכס"), ("column", "עמוד"), ("rafter", "קורות גג")),
}
#: Labels of sizes by kind, and what stands for a size that a text leaves out, millimetres.
LABELS = {
    "length_mm": {k: ("Total Length", v) for k, v in (("truss", 80000.0), ("monoslope", 15000.0), ("gable", 30000.0))},
    "width_mm": {k: ("Total Width", v) for k, v in (("truss", 20000.0), ("monoslope", 8000.0), ("gable", 10000.0))},
    "eave_mm": {"truss": ("Eave Height", 6000.0), "monoslope": ("Low Side Eave Height", 3500.0), "gable": ("(?:Eave Height|Side Wall Height)", 4000.0)},
    "ridge_mm": {"truss": ("Ridge Height", 8500.0), "monoslope": ("High Side Eave Height", 5000.0), "gable": ("(?:Ridge Height|Roof Apex)", 5500.0)},
    "bay_mm": {k: ("Bay Spacing", 5000.0) for k in WORDS},
}
SLAB_MM = (rf"Thickness\s*=\s*{NUMBER}\s*mm", 400.0)
#: Headings of sections by kind and part, with what stands for a section that is not named.
HEADINGS = {
    "truss": {"column": ("MAIN COLUMNS|עמודים ראשיים", "HEB300"), "rafter": ("Top Chords|חגורה עליונה", "IPE270"), "tie": ("Bottom Chord|חגורה תחתונה", "UPN240"), "web": ("Web Members|פנימיים למסבך", "80x80x5"), "purlin": ("ROOF PURLINS|מרישי גג", "100x100x6"), "girt": ("WALL GIRTS|מרישי קיר", "100x50x4")},
    "monoslope": {"column": ("COLUMNS SETUP|עמודי", FALLBACK["HEB"]), "rafter": ("MONOSLOPE RAFTERS|קורות גג", FALLBACK["IPE"]), "purlin": (r"ROOF\s*&\s*WALL PURLINS|Roof Purlins", FALLBACK["RHS"]), "girt": ("WALL GIRTS|Wall Girts|מרישי קיר", FALLBACK["RHS"]), "brace": ("STRUCTURAL BRACING|קושרות", FALLBACK["CHS"])},
    "gable": {"column": ("COLUMNS SETUP|עמודי", FALLBACK["HEB"]), "rafter": ("GABLE ROOF RAFTERS|קורות גג", FALLBACK["IPE"]), "purlin": ("ROOF PURLINS|מרישי גג|פטות", FALLBACK["RHS"]), "girt": ("WALL GIRTS|מרישי קיר", FALLBACK["RHS"])},
}
REACHES = {"truss": 320, "monoslope": 280, "gable": 220}
#: Heights of girts on the front and the back wall; the span in which a list of heights must stand.
GIRTS = {"truss": ((1500.0, 3000.0, 4500.0, 5800.0),) * 2, "monoslope": ((1000.0, 2000.0, 3000.0), (1200.0, 2400.0, 3600.0)), "gable": ((1000.0, 2000.0, 3000.0),) * 2}
WALLS, HEIGHTS, MARGIN_MM, TYPO = {"front_mm": "Front Wall", "back_mm": "Back Wall"}, r"Z\s*=\s*([0-9,\s]+)", 200.0, 1.5
#: Purlins of a slope by kind.
PURLINS = {"truss": 6, "monoslope": 5, "gable": 4}

#: The kinds that the grammar knows.
KINDS = ("gable", "truss", "monoslope", "column_row", "portal_frame", "single_element", "steel_shed")
Line = tuple[Column, Column, Column, Column, Column, Column]
Part = tuple[str, str, str, Column, Callable[[Column], Line]]


def _stations(values: Column, of: Callable[[Column], dict[str, Column]]) -> Column:
    return F.transform(values, lambda v: F.struct(*((of(v).get(n, F.lit(0.0))).cast("double").alias(n) for n in "abcd")))


def frame_lines() -> Column:
    """Lines at whole bays along the building, and one at its end."""
    length = F.col("length_mm")
    even = F.transform(F.sequence(F.lit(0), F.floor(length).cast("int"), F.greatest(F.lit(1), F.floor("bay_mm").cast("int"))), lambda i: i.cast("double"))
    return F.when(F.element_at(even, -1) < length, F.concat(even, F.array(length))).otherwise(even)


def grammar() -> dict[str, list[Part]]:
    """Parts of each kind: name, category, section, stations (structs of up to four numbers a, b, c, d), ends."""
    length, width, low, high = (F.col(c) for c in ("length_mm", "width_mm", "eave_mm", "ridge_mm"))

    def gable(y: Column) -> Column:
        half = width / 2
        return F.when(y <= half, low + (high - low) * (y / half)).otherwise(high - (high - low) * ((y - half) / half))

    def mono(y: Column) -> Column:
        return low + (high - low) * (y / width)

    frames, here = F.col("__x"), F.array(F.lit(0.0))
    nodes = F.transform(F.sequence(F.lit(0), F.floor(width / NODE_MM).cast("int")), lambda i: (i * NODE_MM).cast("double"))
    bays = F.array(F.struct(F.element_at(frames, 1).alias("a"), F.element_at(frames, 2).alias("b")), F.struct(F.element_at(frames, -2).alias("a"), F.element_at(frames, -1).alias("b")))

    def pairs(xs: Column, ys: Column) -> Column:
        """Stations (a, b) for all x and y."""
        return F.flatten(F.transform(xs, lambda x: _stations(ys, lambda y: {"a": x, "b": y})))

    def both_walls(heights: dict[str, Column]) -> Column:
        return F.concat(*(_stations(F.coalesce(hs, F.array().cast("array<double>")), lambda z, y=y: {"b": y, "c": z}) for hs, y in ((heights["front_mm"], F.lit(0.0)), (heights["back_mm"], width))))

    def slopes(n: int, z: Callable[[Column], Column], dual: bool) -> Column:
        shares = F.array(*(F.lit(i / (n + 1)) for i in range(1, n + 1)))
        half = width / 2
        sides = [lambda s: half * s, lambda s: half + half * s] if dual else [lambda s: width * s]
        return F.concat(*(_stations(shares, lambda s, at=at: {"b": at(s), "c": z(at(s))}) for at in sides))

    def upright(top: Callable[[Column], Column]) -> Callable[[Column], Line]:
        return lambda s: (s["a"], s["b"], F.lit(0.0), s["a"], s["b"], top(s["b"]))

    along = lambda s: (F.lit(0.0), s["b"], s["c"], length, s["b"], s["c"])
    zero = F.lit(0.0)
    slab = lambda s: (zero, zero, -F.col("slab_mm"), length, width, zero)
    edges = F.array(zero, width)
    thirds = F.array(zero, length / 2, length)
    columns = F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda i: length * i / F.greatest(F.lit(1), F.col("n_columns") - 1))
    heights = {w: F.col(w) for w in WALLS}

    def crossed(bays: Column, ys: list[tuple[Column, Column]], tops: list[Column]) -> Column:
        """Two braces a bay and stretch, (xa, y0, xb, y1) upwards, both ways; d is the height they reach to."""
        one = lambda a, b, y, d: F.struct(a.alias("a"), b.alias("b"), y.cast("double").alias("c"), d.cast("double").alias("d"))
        return F.flatten(F.transform(bays, lambda p: F.array(*(one(a, b, y[0], top) for y, top in zip(ys, tops) for a, b in ((p["a"], p["b"]), (p["b"], p["a"]))))))

    def webs_between(s: Column) -> Line:
        """Between nodes: up from the left in even panels, up from the right in odd ones; b and c are the panel's ends."""
        even = s["d"] % 2 == 0
        foot, top = F.when(even, s["b"]).otherwise(s["c"]), F.when(even, s["c"]).otherwise(s["b"])
        return s["a"], foot, low, s["a"], top, gable(top)

    panels = F.flatten(F.transform(frames, lambda x: F.transform(F.slice(F.sequence(F.lit(0), F.size(nodes)), 1, F.size(nodes) - 1), lambda i: F.struct(x.alias("a"), (i * NODE_MM).cast("double").alias("b"), ((i + 1) * NODE_MM).cast("double").alias("c"), i.cast("double").alias("d")))))
    inner = F.filter(pairs(frames, nodes), lambda s: (s["b"] > 0) & (s["b"] < F.element_at(nodes, -1)))
    return {
        "gable": [
            ("columns", "column", "column", pairs(frames, edges), upright(lambda y: low)),
            ("rafters", "beam", "rafter", pairs(frames, F.array(zero, width / 2)), lambda s: (s["a"], s["b"], gable(s["b"]), s["a"], s["b"] + width / 2, gable(s["b"] + width / 2))),
            ("purlins", "beam", "purlin", slopes(PURLINS["gable"], gable, True), along), ("girts", "beam", "girt", both_walls(heights), along),
        ],
        "truss": [
            ("slab", "slab", "slab", _stations(here, lambda v: {}), slab), ("columns", "column", "column", pairs(frames, edges), upright(lambda y: low)),
            ("rafters", "beam", "rafter", pairs(frames, F.array(zero, width / 2)), lambda s: (s["a"], s["b"], gable(s["b"]), s["a"], s["b"] + width / 2, gable(s["b"] + width / 2))),
            ("ties", "beam", "tie", _stations(frames, lambda x: {"a": x}), lambda s: (s["a"], zero, low, s["a"], width, low)),
            ("posts", "beam", "web", inner, lambda s: (s["a"], s["b"], low, s["a"], s["b"], gable(s["b"]))), ("webs", "beam", "web", panels, webs_between),
            ("purlins", "beam", "purlin", slopes(PURLINS["truss"], gable, True), along), ("girts", "beam", "girt", both_walls(heights), along),
        ],
        "monoslope": [
            ("slab", "slab", "slab", _stations(here, lambda v: {}), slab), ("columns", "column", "column", pairs(frames, edges), upright(mono)),
            ("rafters", "beam", "rafter", _stations(frames, lambda x: {"a": x}), lambda s: (s["a"], zero, low, s["a"], width, high)),
            ("purlins", "beam", "purlin", slopes(PURLINS["monoslope"], mono, False), along), ("girts", "beam", "girt", both_walls(heights), along),
            ("wall_braces", "brace", "brace", crossed(bays, [(zero, zero), (width, width)], [low, high]), lambda s: (s["a"], s["c"], zero, s["b"], s["c"], s["d"])),
            ("roof_braces", "brace", "brace", crossed(bays, [(zero, width)], [high]), lambda s: (s["a"], zero, low, s["b"], width, s["d"])),
        ],
        "column_row": [("columns", "column", "column", _stations(columns, lambda x: {"a": x}), upright(lambda y: low))],
        "portal_frame": [("columns", "column", "column", _stations(columns, lambda x: {"a": x}), upright(lambda y: low)), ("beam", "beam", "beam", _stations(here, lambda v: {"c": low}), along)],
        "single_element": [("columns", "column", "main", _stations(here, lambda v: {}), upright(lambda y: low))],
        "steel_shed": [
            ("columns", "column", "column", pairs(thirds, edges), upright(lambda y: low)), ("rafters", "beam", "rafter", _stations(thirds, lambda x: {"a": x}), lambda s: (s["a"], zero, low, s["a"], width, low)),
            ("purlins", "beam", "purlin", _stations(F.sequence(F.lit(1), F.col("n_purlins")), lambda i: {"b": width * i / (F.col("n_purlins") + 1), "c": low}), along),
            ("base_along", "beam", "base", _stations(edges, lambda y: {"b": y}), along), ("base_across", "beam", "base", _stations(F.array(zero, length), lambda x: {"a": x}), lambda s: (s["a"], zero, zero, s["a"], width, zero)),
        ],
    }


#: Sections that stand for one that a request does not name.
STANDS_FOR = {"column": ("main",), "beam": ("main",), "rafter": ("beam", "main"), "purlin": ("beam", "main"), "base": ("beam", "main"), "slab": (), "main": ()}
LINE = ("sx", "sy", "sz", "ex", "ey", "ez")


def building_members(requests: DataFrame) -> DataFrame:
    """(model_id, part, category, section, n, sx .. ez) of all requests; n counts from 1 in each part.

    Each request becomes one array of members in one projection, without a shuffle: a building has a few thousand at
    most, as lengths are divided by bays. Unknown kinds and null sizes give no members.
    """
    rows = requests.where(F.col("kind").isin(*KINDS) & (F.col("length_mm") > 0)).withColumn("__x", F.when(F.col("kind").isin(*WORDS), frame_lines()).otherwise(F.array(F.lit(0.0), F.col("length_mm"))))

    def part(name: str, category: str, section: str, stations: Column, ends: Callable[[Column], Line]) -> Column:
        named = F.coalesce(*(F.try_element_at("sections", F.lit(s)) for s in (section, *STANDS_FOR.get(section, ()))), F.lit("CONCRETE_SLAB" if section == "slab" else FALLBACK["HEB"]))
        one = lambda s, i: F.struct(F.lit(name).alias("part"), F.lit(category).alias("category"), named.alias("section"), (i + 1).alias("n"), *(v.cast("double").alias(c) for c, v in zip(LINE, ends(s))))
        return F.transform(stations, one)

    by_kind = None
    for kind, parts in grammar().items():
        members = F.concat(*(part(*p) for p in parts))
        by_kind = F.when(F.col("kind") == kind, members) if by_kind is None else by_kind.when(F.col("kind") == kind, members)
    out = rows.select("model_id", F.explode(by_kind).alias("m")).select("model_id", "m.*")
    return out.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in LINE)))


# --- requests from texts


def _by_kind(values: dict[str, Column]) -> Column:
    out = None
    for kind, v in values.items():
        out = F.when(F.col("kind") == kind, v) if out is None else out.when(F.col("kind") == kind, v)
    return out


def section_behind(text: Column, heading: str, default: str, reach: int) -> Column:
    """Catalog key of the section in a heading's stretch, first behind the word Profile; cold-formed ones by stand-in."""
    stretch = F.regexp_extract(text, rf"(?i)(?:{heading})[\s\S]{{0,{reach}}}", 0)
    raw = F.upper(F.regexp_replace(F.coalesce(*(F.nullif(F.regexp_extract(stretch, f"(?i){p}{SECTION}", 1), F.lit("")) for p in (r"Profile\s*:\s*", ""))), r"\s", ""))
    key = F.regexp_replace(F.regexp_replace(raw, "^RHS", ""), "[X×]", "x")
    return F.coalesce(F.when(key.startswith("Z"), "100x100x6").when(key.startswith("C") & ~key.startswith("CHS"), "100x50x4"), key, F.lit(default))


def stated_heights(text: Column, wall: str, defaults: tuple[float, ...]) -> Column:
    """The first three whole numbers of the list of heights behind a wall's name, or the defaults."""
    found = F.regexp_extract(F.regexp_extract(text, rf"(?i){wall}[\s\S]{{0,260}}", 0), f"(?i){HEIGHTS}", 1)
    numbers = F.transform(F.filter(F.transform(F.split(found, ","), lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v.rlike(r"^\d+$")), lambda v: v.cast("double"))
    return F.slice(F.when(F.size(numbers) > 0, numbers).otherwise(F.array(*map(F.lit, defaults))), 1, 3)


def building_requests(texts: DataFrame, by: str = "model_id", text: str = "text") -> DataFrame:
    """Requests of the texts that describe a truss hall, a monoslope or a gable shed; other texts have no row."""
    t = F.coalesce(F.col("t"), F.lit(""))
    rows = dealt(texts.select(F.col(by).alias("model_id"), F.col(text).alias("t")))
    low = F.lower(t)
    fits = lambda groups: reduce(lambda a, b: a & b, (low.rlike("|".join(words)) for words in groups))
    kind = None
    for name, groups in WORDS.items():
        kind = F.when(fits(groups), name) if kind is None else kind.when(fits(groups), name)
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    size = lambda label, default: F.coalesce(F.regexp_extract(t, rf"(?i){label}[^\n\r]*?:\s*{NUMBER}\s*mm", 1).try_cast("double"), F.lit(default))
    rows = rows.withColumns({c: _by_kind({k: size(*v) for k, v in kinds.items()}) for c, kinds in LABELS.items()})
    slab = F.coalesce(F.regexp_extract(t, f"(?i){SLAB_MM[0]}", 1).try_cast("double"), F.lit(SLAB_MM[1]))
    sections = {k: F.create_map(*(x for part, (heading, default) in parts.items() for x in (F.lit(part), section_behind(t, heading, default, REACHES[k])))) for k, parts in HEADINGS.items()}
    # a back girt far above the wall is a number written tenfold; all stay clear of the wall's ends
    clear = lambda z: F.greatest(F.lit(MARGIN_MM), F.least(F.when(z > F.col("ridge_mm") * TYPO, z / 10).otherwise(z), F.col("ridge_mm") - MARGIN_MM))
    fixed = lambda i: {k: F.array(*map(F.lit, GIRTS[k][i])) for k in ("truss", "gable")}
    front, back = (stated_heights(t, WALLS[w], GIRTS["monoslope"][i]) for i, w in enumerate(WALLS))
    rows = rows.withColumns({"front_mm": _by_kind(fixed(0) | {"monoslope": front}), "back_mm": _by_kind(fixed(1) | {"monoslope": F.transform(back, clear)}), "slab_mm": slab, "sections": _by_kind(sections), "n_columns": F.lit(0), "n_purlins": F.lit(0)})
    return rows.drop("t")


# --- layouts out of chat texts

#: Words that a layout's text is judged by, and words of parts that a section may follow.
SPAN_WORDS, COLUMN_WORDS, BEAM_WORDS = "span|spanning|length|אורך", "column|עמוד", "beam|קורה"
ROLE_WORDS = {"column": r"\b(?:column|columns|עמוד|עמודים)\b", "beam": r"\b(?:beam|beams|קורה|קורות)\b"}
PART_WORDS = {"rafter": ("rafter", "rafters", "קורה ראשית", "main roof"), "purlin": ("purlin", "purlins", "פורלין", "secondary"), "base": ("base", "perimeter", "יסוד", "bottom")}
#: Sections that may follow a part's word, within so many characters.
FOLLOWING = r"((?:IPE|HEA|HEB|HEM|UPN|UPE)\s*\d{2,4}|L\s*\d+\s*[xX×/]\s*\d+\s*[xX×/]\s*\d+(?:\.\d+)?|CHS\s*\d+(?:\.\d+)?\s*[xX×/]\s*\d+(?:\.\d+)?|(?:RHS|SHS)?\s*\d+\s*[xX×/]\s*\d+\s*[xX×/]\s*\d+(?:\.\d+)?)"
FOLLOW_REACH = 60
#: What a layout has where its text says nothing: columns, height, length, width; a shed's purlins.
LAYOUTS = {"steel_shed": (6, 4000.0, 12000.0, 6000.0), "portal_frame": (3, 3500.0, 5000.0, 4000.0), "column_row": (3, 3000.0, 5000.0, 4000.0), "single_element": (2, 3000.0, 5000.0, 4000.0)}
SHED_COLUMNS, N_PURLINS = 6, 4


def _places(text: Column, role: str, pattern: str) -> Column:
    """array<struct<role, place>> of the code points at which a pattern's matches begin."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, g: a + F.length(g))
    found = F.transform(hits, lambda h, i: F.struct(F.lit(role).alias("role"), (size(gaps, i + 1) + size(hits, i)).alias("place")))
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast("array<struct<role:string,place:int>>"))


def layout_sections(texts: DataFrame, text: str = "text") -> DataFrame:
    """(model_id, first, column, beam): the first section a text names, and that nearest to each role's words.

    A mention that is nearer to the other role's words does not count for a role; a role without words, or without a
    mention of its own, has the first section. Texts without a section have no row.
    """
    mentions = profile_mentions(texts, "model_id", text)
    t = F.col(text)
    anchors = [_places(t, role, f"(?iU){pattern}") for role, pattern in ROLE_WORDS.items()]
    places = texts.where(t.isNotNull()).select("model_id", F.explode(F.concat(*anchors)).alias("a")).select("model_id", "a.*")
    near = role_profiles(mentions, places, "model_id")
    first = mentions.groupBy("model_id").agg(F.min_by("key", "place").alias("first"))
    of = lambda r: near.where(F.col("role") == r).select("model_id", F.col("key").alias(r))
    return first.join(of("column"), "model_id", "left").join(of("beam"), "model_id", "left").select("model_id", "first", *(F.coalesce(r, "first").alias(r) for r in ROLE_WORDS))


def _following(text: Column, words: tuple[str, ...]) -> Column:
    found = F.coalesce(*(F.nullif(F.regexp_extract(text, rf"(?i){w}[^\n\r]{{0,{FOLLOW_REACH}}}?{FOLLOWING}", 1), F.lit("")) for w in words))
    return F.regexp_replace(F.regexp_replace(F.upper(F.regexp_replace(found, r"\s", "")), "[X×/]", "x"), "^(?:RHS|SHS)", "")


def layout_requests(texts: DataFrame, given: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Requests of chat texts (model_id, text) for `building_members`, with the rule that chose the kind.

    A shed, else a portal, else a row of columns (a count of two or more beside a span), else a single column, else a
    single element of a named section. What a text states holds; then what a given request (model_id, kind,
    length_mm, width_mm, eave_mm, n_columns, section) says; then the kind's own values. A shed has six columns at
    least. Texts that ask for none of these take the given kind, or have no row.
    """
    t = F.coalesce(F.col("__t"), F.lit(""))
    rows = texts.select("model_id", F.col(text).alias("__t"))
    rows = rows.join(layout_sections(rows, "__t"), "model_id", "left")
    kept = ("kind", "length_mm", "width_mm", "eave_mm", "n_columns", "section")
    if given is not None:
        rows = rows.join(given.select("model_id", *(F.col(c).alias(f"given_{c}") for c in kept)), "model_id", "left")
    else:
        rows = rows.withColumns({f"given_{c}": F.lit(None).cast("string" if c in ("kind", "section") else "int" if c == "n_columns" else "double") for c in kept})
    low = F.lower(t)
    flags, count = request_flags(t), column_count(t)
    is_column, is_beam, spans = low.rlike(COLUMN_WORDS), low.rlike(BEAM_WORDS), low.rlike(SPAN_WORDS)
    counted = F.coalesce(count, F.col("given_n_columns"), F.lit(LAYOUTS["column_row"][0])) >= 2
    ways = {
        "shed": (flags["shed"], "steel_shed"), "portal": (flags["portal"], "portal_frame"), "row": ((is_column | (is_beam & F.col("given_kind").isNull())) & spans & counted, "column_row"),
        "given": (F.col("given_kind").isNotNull(), None), "column": (is_column & ~is_beam, "single_element"), "section": (F.col("first").isNotNull(), "single_element"),
    }
    chosen = None
    for rule, (when, kind) in ways.items():
        value = F.struct(F.lit(rule).alias("rule"), (F.col("given_kind") if kind is None else F.lit(kind)).alias("kind"))
        chosen = F.when(when, value) if chosen is None else chosen.when(when, value)
    rows = rows.withColumn("__c", chosen).where("__c IS NOT NULL").withColumns({"kind": F.col("__c.kind"), "rule": F.col("__c.rule")})
    own = lambda i: _by_kind({k: F.lit(v[i]) for k, v in LAYOUTS.items()})
    sizes = {
        "length_mm": F.coalesce(first_measure(t, SPAN), "given_length_mm", own(2)), "width_mm": F.coalesce(first_measure(t, WIDTH), "given_width_mm", own(3)), "eave_mm": F.coalesce(first_measure(t, HEIGHT), "given_eave_mm", own(1)),
        "n_columns": F.coalesce(count, "given_n_columns", own(0)),
    }
    rows = rows.withColumns(sizes).withColumn("n_columns", F.when(F.col("kind") == "steel_shed", F.greatest("n_columns", F.lit(SHED_COLUMNS))).otherwise(F.col("n_columns")).cast("int"))
    main = F.coalesce("first", "given_section", F.lit(FALLBACK["HEB"]))
    parts = {"main": main, "column": F.coalesce("column", main), "beam": F.coalesce("beam", F.when(F.col("kind") == "steel_shed", FALLBACK["IPE"]), main)} | {p: _following(t, words) for p, words in PART_WORDS.items()}
    sections = F.map_filter(F.create_map(*(x for p, c in parts.items() for x in (F.lit(p), c))), lambda k, v: v.isNotNull())
    return rows.select("model_id", "kind", "rule", "length_mm", "width_mm", "eave_mm", F.col("eave_mm").alias("ridge_mm"), F.lit(5000.0).alias("bay_mm"), F.lit(SLAB_MM[1]).alias("slab_mm"), "n_columns", F.lit(N_PURLINS).alias("n_purlins"), *(F.array().cast("array<double>").alias(w) for w in WALLS), sections.alias("sections"))
