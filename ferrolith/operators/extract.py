"""From decoded model tables to part, bolt and assembly rows: scans, indexes, flags, projections, output text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import property_key, resolve, to_number, to_quantity, to_text

#: Element kinds that are scanned first, in order, and kinds that hold no parts.
PREFERRED = ("IfcBeam", "IfcColumn", "IfcMember", "IfcPlate", "IfcBuildingElementProxy")
SPATIAL = ("IfcSite", "IfcBuilding", "IfcBuildingStorey", "IfcSpace", "IfcZone", "IfcGrid", "IfcOpeningElement", "IfcAnnotation", "IfcProject")
#: Property names of bolt quantities in order of trust, and words of looser names.
QUANTITY_KEYS = ("quantity", "qty", "number of bolts", "bolt quantity", "numberofbolts", "bolt count", "bolt count net", "count", "number", "pieces", "boltnumber", "bolts", "number bolts")
QUANTITY_WORDS = "quantity|qty|count|number|pieces"
BOLT_SETS = ("tekla bolt", "tekla bolts")
HARDWARE_WORDS = "washer|nut|sleeve|anchor|thread|grip length|bolt assembly|joint"
TRUE_WORDS = ("true", "yes", "1")


def scan_order(elements: DataFrame) -> DataFrame:
    """Elements of a model in scan order: preferred kinds first, then all others; each id once, its first place."""
    rank = F.coalesce(*(F.when(F.col("ifc_type") == t, F.lit(i)) for i, t in enumerate(PREFERRED)), F.lit(len(PREFERRED)))
    first = elements.groupBy("model_id", "express_id").agg(F.min(F.struct(rank.alias("rank"), "seq")).alias("at"), F.min_by("ifc_type", F.struct(rank, F.col("seq"))).alias("ifc_type"))
    place = F.row_number().over(Window.partitionBy("model_id").orderBy("at.rank", "at.seq", "express_id"))
    return first.select("model_id", "express_id", "ifc_type", place.alias("place"))


def flat_elements(elements: DataFrame) -> DataFrame:
    """Elements to index in models without assemblies: all but spatial kinds."""
    grouped = elements.where("ifc_type = 'IfcElementAssembly'").select("model_id").distinct()
    return elements.where(~F.col("ifc_type").isin(*SPATIAL)).join(grouped, "model_id", "left_anti")


def part_index(rows: DataFrame, *values: str) -> DataFrame:
    """One row an element id: the last row's values at the first row's place."""
    return rows.groupBy("model_id", "element_id").agg(F.max_by(F.struct(*values), "seq").alias("v"), F.min("seq").alias("place")).select("model_id", "element_id", "v.*", "place")


def distinct_members(members: DataFrame) -> DataFrame:
    """Each member of an assembly once, at its first place."""
    return members.groupBy("assembly_id", "member_id").agg(F.min("ord").alias("ord"))


def page_manifest(manifests: DataFrame) -> DataFrame:
    """Pages of projects: manifests hold an array of structs with page_index, width_px and height_px."""
    return manifests.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")


def catalog_index(catalog: DataFrame) -> DataFrame:
    """Tabulated profiles by lookup key, each once in order: bare keys of pipes get their family in front."""
    key = F.when((F.col("family") == "CHS") & ~F.upper("key").startswith("CHS"), F.concat(F.lit("CHS"), "key")).otherwise(F.col("key"))
    return catalog.groupBy(F.upper(key).alias("lookup")).agg(F.min_by(F.struct("family", key.alias("key"), "dims"), "ord").alias("x")).select("lookup", "x.*")


def coalesced_keys(rows: DataFrame, fields: dict[str, tuple[str, ...]], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Raw upper-case and mixed-case columns under one name each; numbers by a cast that may fail to null."""
    there = lambda names: [F.col(n) for n in names if n in rows.columns] or [F.lit(None)]
    return rows.select(*(F.coalesce(*there(n)).try_cast("double").alias(f) if f in numbers else F.coalesce(*there(n)).alias(f) for f, n in fields.items()))


def uid() -> Column:
    return F.coalesce(to_text(F.col("global_id")), F.col("express_id").cast("string"))


def children(contains: DataFrame) -> DataFrame:
    """Direct children: decomposed ones before nested ones, each once."""
    rank = F.when(F.col("rel") == "aggregate", 0).when(F.col("rel") == "nest", 1)
    rows = contains.where(F.col("rel").isin("aggregate", "nest")).groupBy("model_id", "parent_id", "child_id").agg(F.min(F.struct(rank.alias("rank"), "ord")).alias("at"))
    return rows.select("model_id", "parent_id", "child_id", F.row_number().over(Window.partitionBy("model_id", "parent_id").orderBy("at", "child_id")).alias("place"))


def fasteners(elements: DataFrame, props: DataFrame) -> DataFrame:
    """Adds is_fastener: by kind, by predefined type, or by a bolt property set."""
    marked = props.where(F.lower("pset").isin(*BOLT_SETS)).select("model_id", "element_id").distinct().withColumn("__p", F.lit(True))
    kind = F.upper("ifc_type").contains("FASTENER") | F.upper(F.coalesce("predefined_type", F.lit(""))).rlike("BOLT|FASTENER|SCREW")
    return elements.join(marked, ["model_id", "element_id"], "left").withColumn("is_fastener", kind | F.coalesce("__p", F.lit(False))).drop("__p")


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(*TRUE_WORDS) | F.coalesce(to_number(value) > 0, F.lit(False))


def bolt_flags(elements: DataFrame, props: DataFrame) -> DataFrame:
    """(model_id, element_id, hole, hardware): hole by names, predefined type or flags; hardware by properties."""
    key = property_key(F.col("prop"))
    in_bolt = F.lower("pset").isin(*BOLT_SETS)
    flags = props.groupBy("model_id", "element_id").agg(
        F.bool_or(in_bolt & key.isin("hole only", "is hole", "fabrication hole") & F.lower(F.trim("value")).isin(*TRUE_WORDS)).alias("flag"), F.bool_or(in_bolt & key.rlike(HARDWARE_WORDS) & truthy(F.col("value"))).alias("hardware")
    )
    text = F.lower(F.concat_ws(" ", "name", "object_type"))
    named = text.rlike("hole|חור|opening|void") | F.upper(F.coalesce("predefined_type", F.lit(""))).rlike("HOLE|OPENING")
    rows = elements.join(flags, ["model_id", "element_id"], "left")
    return rows.select("model_id", "element_id", (named | F.coalesce("flag", F.lit(False))).alias("hole"), F.coalesce("hardware", F.lit(False)).alias("hardware"))


def main_part(props: DataFrame) -> DataFrame:
    """Elements with a property of a main part or component that is set."""
    key = property_key(F.col("prop"))
    hit = key.contains("main") & key.rlike("part|component") & (truthy(F.col("value")) | F.upper(F.trim("value")).isin("Y", "MAIN", "MAIN PART"))
    return props.groupBy("model_id", "element_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("main_part"))


def bolt_quantity(props: DataFrame) -> DataFrame:
    """Quantity of bolts: exact names in the bolt set, then in the quantity set, then looser names; default 1."""
    key, pset = property_key(F.col("prop")), F.lower("pset")
    exact = F.array_position(F.array(*map(F.lit, QUANTITY_KEYS)), key)
    loose = key.rlike(QUANTITY_WORDS)
    in_bolt, in_qty = pset.isin(*BOLT_SETS), pset == "tekla quantity"
    rank = (
        F.when(in_bolt & (exact > 0), exact).when(in_qty & (exact > 0), 100 + exact).when(in_qty & loose & ~key.rlike("weight|mass|area|volume|length"), F.lit(200))
        .when(in_bolt & loose & ~key.rlike("diameter|length|hole|pitch|thread|grade"), F.lit(300)).when(key.contains("bolt") & loose, F.lit(400))
    )
    rows = props.withColumn("__r", rank).withColumn("__q", to_quantity(F.col("value"))).withColumn("__k", F.when(F.col("__q").isNotNull(), F.struct("__r", "pset_ord", "prop_ord")))
    picked = F.min_by(F.when(F.col("__r").isNotNull(), F.col("__q")), F.when(F.col("__r").isNotNull(), F.col("__k")))
    return rows.groupBy("model_id", "element_id").agg(F.coalesce(picked, F.lit(1.0)).alias("quantity"))


def material(associations: DataFrame) -> DataFrame:
    """First named material of an element."""
    named = to_text(F.col("name"))
    return associations.where(named.isNotNull()).groupBy("model_id", "element_id").agg(F.min_by(named, "ord").alias("material"))


def wall_thickness(profile: Column) -> Column:
    """Wall of a hollow section out of its text: the last part of three and more, else the second."""
    segments = F.filter(F.transform(F.split(F.upper(F.trim(profile)), r"\*"), lambda s: F.trim(s)), lambda s: s != "")
    hollow = F.get(segments, F.lit(0)).rlike("^(?:RHS|SHS|CHS|TUBE|PIPE)") & (F.size(segments) >= 2)
    tail = F.replace(F.regexp_extract(F.try_element_at(segments, F.lit(-1)), r"^(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(hollow & (tail > 0), tail)


def element_rows(elements: DataFrame, props: DataFrame, rules: list[tuple], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Elements with all fields of a rule list: texts by one resolution, numbers by another, no self-join of props."""
    out = elements
    for chosen, convert in (([r for r in rules if r[0] not in numbers], to_text), ([r for r in rules if r[0] in numbers], to_number)):
        if chosen:
            out = out.join(resolve(props, chosen, convert), ["model_id", "element_id"], "left")
    return out


def weight_text(kg: Column) -> Column:
    """Whole kilograms from 100 on, else two decimals; a dash when missing."""
    shown = F.when(kg >= 100, F.format_number(kg, 0)).otherwise(F.format_number(kg, 2))
    return F.when(kg.isNull() | F.isnan(kg), "—").otherwise(shown)


def elevation_text(mm: Column) -> Column:
    sign = F.when(mm > 0, "+").otherwise("-")
    return F.when(mm.isNull() | F.isnan(mm), "—").when(F.abs(mm) < 1e-9, "+0.00").otherwise(F.concat(sign, F.format_number(F.abs(mm), 2)))


def quantity_text(q: Column) -> Column:
    whole = F.floor(q + 0.5)
    decimals = F.regexp_replace(F.format_number(q, 6), r"\.?0+$", "")
    return F.when(q.isNull() | F.isnan(q), "—").when(F.abs(q - whole) < 1e-6, F.format_number(whole, 0)).otherwise(decimals)


def pick_context(picks: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct elements one hop from picks over containment relations, either way, with the picks."""
    both = relations.select(F.col("parent_id").alias("element_id"), F.col("child_id").alias("other")).union(relations.select(F.col("child_id"), F.col("parent_id")))
    return picks.select("element_id").union(both.join(picks.select("element_id").distinct(), "element_id").select("other")).distinct()
