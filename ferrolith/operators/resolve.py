"""Properties of elements: layered sets, ranked rules, number parsing, hierarchy and connection links.

props: model_id, element_id, layer (instance, type, inherited), pset, pset_ord, prop, prop_ord, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import durable

ELEMENT = ["model_id", "element_id"]
#: Characters that separate or pad numbers and keys in exports.
ODD_SPACES = "    "
LAYERS = {"instance": 0, "type": 1, "inherited": 2}
#: Words that mark a bolt of a connection as a hole, and those that mark any fastener as one.
BOLT_HOLES = "hole|חור|opening|void"
HOLES = "hole|void|opening|recess|slot|cutout|machining|חור"
#: Prefixes of SI units.
PREFIXES = {"EXA": 1e18, "PETA": 1e15, "TERA": 1e12, "GIGA": 1e9, "MEGA": 1e6, "KILO": 1e3, "HECTO": 1e2, "DECA": 1e1, "DECI": 1e-1, "CENTI": 1e-2, "MILLI": 1e-3, "MICRO": 1e-6, "NANO": 1e-9}


def property_key(c: Column) -> Column:
    """Trimmed lower case with plain slashes and single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "／" + ODD_SPACES[1:], "/   "), r"\s+", " "))


def to_number(c: Column) -> Column:
    """Commas group digits, a leading plus is dropped; other text, booleans and infinities give null."""
    t = F.regexp_replace(F.translate(F.trim(c), "," + ODD_SPACES, ""), r"^\+", "")
    x = t.try_cast("double")
    return F.when(t.rlike(r"^-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), x)


def to_quantity(c: Column) -> Column:
    """A comma is a decimal point; positive numbers only."""
    x = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(x > 0, x)


def to_text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def unwrapped(json: Column) -> Column:
    """A value out of its wrappings: a one-element list, the first number of a longer list, or a nominal value."""
    items = F.from_json(json, "array<string>")
    first = F.when(F.size(items) == 1, items[0]).otherwise(F.get(F.filter(items, lambda x: x.try_cast("double").isNotNull()), F.lit(0)))
    nominal = F.coalesce(F.get_json_object(json, "$.NominalValue"), F.get_json_object(json, "$.wrappedValue"), F.get_json_object(json, "$.value"))
    return F.when(json.startswith("["), first).when(json.startswith("{"), nominal).otherwise(json)


def layered(props: DataFrame) -> DataFrame:
    """One value a property: that of the instance over the type's, and both over inherited ones."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv)), F.col("layer"))
    best = F.min_by(F.struct("value", "layer", "pset_ord", "prop_ord"), F.struct(rank, F.col("pset_ord"), F.col("prop_ord")))
    return props.groupBy(*ELEMENT, "pset", "prop").agg(best.alias("b")).select(*ELEMENT, "pset", "prop", "b.*")


#: A rule: field, rank, pattern of property sets (like), key, and how keys compare: exact, contains or regex.
Rule = tuple[str, int, str, str, str]


def rule_holds(rule: Rule, key: Column) -> Column:
    """Whether a property with this normalised key meets a rule; all of the rule is literal."""
    _, _, sets, wanted, mode = rule
    name = key == wanted if mode == "exact" else key.contains(wanted) if mode == "contains" else key.rlike(wanted)
    return name if sets == "%" else F.lower("pset").like(sets.lower()) & name


def resolve(props: DataFrame, rules: list[Rule], convert=to_text) -> DataFrame:
    """One row an element with a column for each field of the rules, in the order of their names.

    Rules are literal conditions: a property's rank for a field is that of the first rule it meets, and one aggregation
    takes each field's convertible value of the lowest rank, then of the first place. Nothing is joined or collected,
    and all fields share the one shuffle on the element. Elements without any such value have no row.
    """
    key, value = F.col("__key"), F.col("__v")
    rows = props.withColumn("__key", property_key(F.col("prop"))).withColumn("__v", convert(F.col("value"))).where("__v IS NOT NULL")
    ranks = {}
    for field in sorted({r[0] for r in rules}):
        for rule in sorted((r for r in rules if r[0] == field), key=lambda r: r[1]):
            ranks[field] = ranks[field].when(rule_holds(rule, key), rule[1]) if field in ranks else F.when(rule_holds(rule, key), rule[1])
    rows = rows.select(*ELEMENT, "__v", "pset_ord", "prop_ord", *(rank.alias(f"__rank_{f}") for f, rank in ranks.items())).where(F.coalesce(*(F.col(f"__rank_{f}") for f in ranks)).isNotNull())
    some = lambda f: F.col(f"__rank_{f}").isNotNull()
    return rows.groupBy(*ELEMENT).agg(*(F.min_by(F.when(some(f), value), F.when(some(f), F.struct(f"__rank_{f}", "pset_ord", "prop_ord"))).alias(f) for f in ranks))


def longest_fragment(props: DataFrame, fragments: list[str]) -> DataFrame:
    """Value of the property whose key holds the longest of the fragments, the first of equal ones."""
    key = property_key(F.col("prop"))
    size = F.greatest(*(F.when(key.contains(f), len(f)) for f in fragments), F.lit(None).cast("int"))
    best = F.max_by("value", F.struct(F.col("size"), -F.col("pset_ord"), -F.col("prop_ord")))
    return props.withColumn("size", size).where("size IS NOT NULL").groupBy(*ELEMENT).agg(best.alias("value"), F.max("size").alias("size"))


def all_fragments(props: DataFrame, fragments: list[str]) -> DataFrame:
    """First value whose key holds every fragment."""
    key = property_key(F.col("prop"))
    keep = props.where(F.forall(F.array(*map(F.lit, fragments)), lambda f: F.contains(key, f)))
    return keep.groupBy(*ELEMENT).agg(F.min_by("value", F.struct("pset_ord", "prop_ord")).alias("value"))


def profile_candidate(c: Column) -> Column:
    """A profile text, or null for numbers, placeholders and texts of more than 160 characters."""
    t = to_text(c)
    shape = t.rlike(r"[A-Za-z֐-׿]|[*×/]|\d\s*[xX]\s*\d")
    return F.when((F.length(t) <= 160) & to_number(t).isNull() & shape & ~F.lower(t).isin("unnamed", "n/a", "-", "none", "null", "undefined"), t)


def ranked(candidates: DataFrame, by: list[str], convert) -> DataFrame:
    """First candidate (rank, value) that convert accepts."""
    return candidates.withColumn("__v", convert(F.col("value"))).where("__v IS NOT NULL").groupBy(*by).agg(F.min_by("__v", "rank").alias("value"), F.min("rank").alias("rank"))


def guid_like(t: Column) -> Column:
    return t.rlike(r"(?i)^(?:ID)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$") | t.rlike(r"^[0-9A-Za-z_$]{22}$")


def mark_candidate(c: Column) -> Column:
    """A part mark: neither an id nor the generic name of a kind of element."""
    t = to_text(c)
    return F.when(~guid_like(t) & ~F.lower(t).isin("beam", "column", "plate", "part", "member", "element", "unnamed", "steel"), t)


def unit_factors(units: DataFrame) -> DataFrame:
    """Per model: factor of lengths to millimetres (metres where nothing is said) and of masses to kilograms."""
    prefix = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv)), F.upper(F.col("prefix"))), F.lit(1.0))
    factor = F.coalesce(F.col("conversion"), prefix)
    last = lambda kind, scale, default: F.coalesce(F.max_by(F.when(F.col("unit_type") == kind, factor * scale), F.when(F.col("unit_type") == kind, F.col("ord"))), F.lit(default))
    return units.groupBy("model_id").agg(last("LENGTHUNIT", 1000.0, 1000.0).alias("to_mm"), last("MASSUNIT", 0.001, 1.0).alias("to_kg"))


def elevation_mm(x: Column, factor: Column) -> Column:
    """Values of 1000 and more are millimetres already."""
    return F.when(F.abs(x) >= 1000, x).otherwise(x * factor)


def flattened_parameters(parameters: DataFrame, by: list[str]) -> DataFrame:
    """Key/value rows (key, value, ord) as one map; the last value of a key counts."""
    last = parameters.groupBy(*by, "key").agg(F.max_by("value", "ord").alias("value"))
    return last.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("parameters"))


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int = 24, cap: int = 1000) -> DataFrame:
    """(seed, node, depth) for all nodes reached from seeds over edges (parent, child), nearest depth each.

    One frontier join a level; what was reached before is left out, which also ends cycles. Levels are tables in
    the shared folder. A walk that goes on after max_depth stops there.
    """
    reached = durable(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct(), "closure")
    frontier = reached
    for depth in range(1, min(max_depth, cap) + 1):
        step = frontier.join(edges, frontier["node"] == edges["parent"]).select("seed", F.col("child").alias("node")).distinct()
        frontier = durable(step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def ancestor_pick(edges: DataFrame, values: DataFrame, seeds: DataFrame, max_depth: int = 24) -> DataFrame:
    """The value (node, value, rank) of the nearest node on the way up that has one."""
    up = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    found = closure(up, seeds, max_depth).join(values, "node")
    return found.groupBy("seed").agg(F.min_by("value", F.struct("depth", "rank")).alias("value"), F.min("depth").alias("depth"))


def leaf_products(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): descendants without children."""
    inner = edges.select(F.col("parent").alias("node")).distinct()
    return closure(edges, seeds, 1000).where("depth > 0").join(inner, "node", "left_anti").select("seed", "node")


def link_pairs(ends: DataFrame, shortest: int = 12) -> DataFrame:
    """Distinct (bolt_id, part_id) of relations (rel_id, role, element_id, is_fastener): fasteners of one end with
    steel of the other; ids that are too short are left out."""
    a, b = ends.where("role = 'relating'"), ends.where("role = 'related'")
    pairs = []
    for x, y in ((a, b), (b, a)):
        fast = x.where("is_fastener").select("rel_id", F.col("element_id").alias("bolt_id"))
        pairs.append(fast.join(y.where("NOT is_fastener").select("rel_id", F.col("element_id").alias("part_id")), "rel_id").select("bolt_id", "part_id"))
    return pairs[0].union(pairs[1]).where((F.length("bolt_id") >= shortest) & (F.length("part_id") >= shortest)).distinct()


def multiway_pairs(members: DataFrame) -> DataFrame:
    """Distinct fastener/part pairs of joints (rel_id, element_id, is_fastener) of any number of members."""
    fast = members.where("is_fastener").select("rel_id", F.col("element_id").alias("bolt_id"))
    return fast.join(members.where("NOT is_fastener").select("rel_id", F.col("element_id").alias("part_id")), "rel_id").select("bolt_id", "part_id").distinct()


def catalog_length(name: Column) -> Column:
    """The number after the last star of a bolt name."""
    return F.replace(F.try_element_at(F.regexp_extract_all(name, F.lit(r"\*(\d+(?:[.,]\d+)?)"), F.lit(1)), F.lit(-1)), F.lit(","), F.lit(".")).cast("double")


def length_matches(actual: Column, listed: Column) -> Column:
    """Within 2 millimetres or 2 percent; null where one is missing."""
    return F.abs(actual - listed) <= F.greatest(F.lit(2.0), 0.02 * listed)


def connection_bolt(name: Column, actual: Column, hardware: Column) -> Column:
    """No hole, no length that contradicts the name, and a length of 3 millimetres or a sign of hardware."""
    fits = F.coalesce(length_matches(actual, catalog_length(name)), F.lit(True))
    return ~F.coalesce(F.lower(name).rlike(BOLT_HOLES), F.lit(False)) & fits & (F.coalesce(actual >= 3, F.lit(False)) | hardware)


def category(ifc_type: Column) -> Column:
    t = F.lower(ifc_type)
    return F.when(t.contains("beam"), "beam").when(t.contains("column"), "column").when(t.contains("plate"), "plate").when(t.contains("fastener") | t.contains("bolt"), "bolt").when(t.contains("assembly"), "assembly").otherwise("other")


def fastener_class(kind: Column, text: Column, strict: bool = False) -> Column:
    """What hiding fasteners does with an element: keep holes, machining and (strict) connection plates."""
    k, t = F.upper(kind), F.lower(text)
    hardware = k.rlike("MECHANICALFASTENER|IFCFASTENER|DISCRETEACCESSORY") | (k.contains("FASTENER") & ~k.contains("GRID"))
    plate = t.rlike("end plate|fin plate|cap plate|cleat|angle|gusset|bracket|stiffener")
    kept = F.when(t.rlike(HOLES), "hole").when(plate & F.lit(strict), "connection")
    return F.coalesce(F.when(~hardware, "other"), kept, F.lit("fastener"))


#: Text lengths below which an accessory's own attributes decide nothing (strict: connections stay too).
SPARSE, SPARSE_STRICT = 28, 64
#: Words of whole attribute texts that name a hole, at once or unless a bolt's own words stand there; a
#: context in which HOLE counts; and the words of hardware.
MADE_HOLES = r"\b(?:BOLT\s*-?\s*HOLE|DRILL\s*HOLE|MACHINED\s*HOLE|CLEARANCE\s*HOLE|BOREHOLE|BORING|TAPEREDBORING|MACHINEDHOLE|DRILLEDHOLE)\b|\bBOLT[-_\s.]?HOLE\b|\bHOLE[-_\s.]?BOLT\b"
BORES, HOLE_CONTEXT = r"\bBORE\b|SURFACEFEATURE.*BORE", r"\b(?:DRILL|BORE|MACHINED|CLEARANCE|SURFACEFEATURE)\b"
BOLT_WORDS = r"\b(?:BOLT\s*ASSEMBLY|HEX\s*BOLT|TENSION.?CONTROL|TURN.?OF.?NUT|SHEAR\s*NUT|SPLIT\s*BOLT|SHEET\s*BOLT|PURLIN\s*BOLT)\b"
HARDWARE_NAMES, NO_HARDWARE = r"\b(?:BOLT|NUT|WASHER|HEX|STUD|THREAD|DOWEL|SCREW|RIVET|SHEAR\s*STUD)\b", r"\b(?:BOLT\s*-?\s*HOLE|HOLE|BORE|DRILL|CLEARANCE|MACHINED)\b"


def made_hole(text: Column) -> Column:
    """Whether a whole attribute text speaks of a hole that was made."""
    t = F.upper(text)
    bolt = t.rlike(BOLT_WORDS)
    made = t.rlike(MADE_HOLES) | (t.rlike(r"\bSURFACEFEATURE\b") & t.rlike(r"\b(?:BORE|DRILL|MACHINED|CLEARANCE)\b"))
    return made | (~bolt & (t.rlike(BORES) | (t.rlike(r"\bHOLE\b") & t.rlike(HOLE_CONTEXT))))


def fasteners_to_hide(elements: DataFrame, attributes: DataFrame, strict: bool = False) -> DataFrame:
    """(element_id): what hiding fasteners takes away, in two passes, so that wide attributes are read for few rows.

    elements: element_id, kind, text (the short attributes); they decide all but accessories of little text. Only
    those are looked up in attributes (element_id, text: all that is known). There, holes stay; in strict mode only
    what is named as hardware, and not as a hole, is hidden; otherwise all the rest is. An accessory without
    attributes stays in strict mode and is hidden otherwise.
    """
    text = F.coalesce("text", F.lit(""))
    first = elements.select("element_id", fastener_class(F.col("kind"), text, strict).alias("class"), (F.upper("kind").contains("DISCRETEACCESSORY") & (F.length(text) < (SPARSE_STRICT if strict else SPARSE))).alias("sparse")).where("class = 'fastener'")
    sparse = first.where("sparse").select("element_id")
    deep = attributes.select("element_id", F.col("text").alias("deep")).join(sparse, "element_id", "left_semi")
    whole = F.coalesce("deep", F.lit(""))
    hidden = ~made_hole(whole)
    if strict:
        hidden = hidden & F.upper(whole).rlike(HARDWARE_NAMES) & ~F.upper(whole).rlike(NO_HARDWARE)
    # an element can have several attribute rows: any of them can keep it
    judged = sparse.join(deep, "element_id", "left").groupBy("element_id").agg(F.bool_and(hidden).alias("hidden")).where("hidden").select("element_id")
    return first.where("NOT sparse").select("element_id").unionByName(judged)


def companion(kind: Column) -> Column:
    """Whether a category goes with a bolted joint: hardware, accessories, openings; not members."""
    k = F.upper(kind)
    steel = k.rlike("IFCBEAM|IFCCOLUMN|IFCPLATE|IFCMEMBER|IFCWALL|IFCSLAB|IFCCOVERING")
    return ~steel & (k.rlike("DISCRETEACCESSORY|OPENINGELEMENT|OPENINGSTANDARD|FEATUREELEMENTSUBTRACTION|VOIDINGFEATURE") | (k.contains("FASTENER") & ~k.contains("GRID")))


def hidden_elements(assemblies: DataFrame, members: DataFrame, parts: DataFrame, picks: DataFrame) -> DataFrame:
    """Distinct elements that picks (kind, key) hide: assembly groups, part ids, part rows, profiles."""
    of = lambda kind: picks.where(F.col("kind") == kind).select(F.col("key"))
    keyed = assemblies.select("assembly_id", F.col("group_key").alias("key")).join(of("assembly"), "key", "left_semi")
    by_assembly = members.join(keyed, "assembly_id", "left_semi").select("part_id")
    direct = [parts.select("part_id", F.col(c).cast("string").alias("key")).join(of(k), "key", "left_semi").select("part_id") for k, c in (("part", "part_id"), ("row", "identity"), ("profile", "profile_key"))]
    out = by_assembly
    for d in direct:
        out = out.union(d)
    return out.distinct()


def with_openings(hidden: DataFrame, voids: DataFrame) -> DataFrame:
    """Adds the openings (host_id, part_id) of hidden hosts."""
    mine = voids.join(hidden.select(F.col("part_id").alias("host_id")), "host_id", "left_semi").select("part_id")
    return hidden.select("part_id").union(mine).distinct()


def visible(elements: DataFrame, hidden: DataFrame) -> DataFrame:
    return elements.join(hidden.select("part_id").distinct(), "part_id", "left_anti")
