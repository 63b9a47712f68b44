"""Rows that describe picks and specifications: details, references, summaries, predicates of schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bolts import guid_key
from .rollup import identity_counts, part_label, part_name_label, profile_label

#: Kinds of summary rows in order, sizes a section of a shape is given by, least thickness of a flange.
ROLES = ("column", "beam")
SIZES = {"CHS": (2,), "RHS": (3,), "L": (3,), "slab": (3,)}
OPEN_SIZES, FLANGE_RATIO, FLANGE_LEAST = (3, 4), 1.5, 8.0


def part_details(parts: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """Label, profile, name, material, measures and the number of identical parts in all models, for picked parts."""
    rows = identity_counts(parts).join(picks.select(key).distinct(), key, "left_semi")
    measures = [c for c in ("weight", "length_mm", "top_elevation", "bottom_elevation") if c in rows.columns]
    return rows.select(key, part_label().alias("label"), profile_label().alias("profile_label"), part_name_label().alias("part_name"), "material", "identical", *measures)


def assembly_refs(members: DataFrame, by: list[str]) -> DataFrame:
    """Members (id, is_bolt, ord) as references, parts before bolts, each id once by its normalised key, numbered."""
    key = F.coalesce(guid_key(F.col("id")), F.nullif(F.trim("id"), F.lit("")))
    rows = members.withColumn("key", key).where("key IS NOT NULL")
    first = rows.groupBy(*by, "key").agg(F.min(F.struct("is_bolt", "ord", "id")).alias("r"))
    return first.select(*by, "key", "r.id", "r.is_bolt", F.row_number().over(Window.partitionBy(*by).orderBy("r.is_bolt", "r.ord", "key")).alias("place"))


def revealed_parts(parts: DataFrame, revealed: DataFrame, key: str) -> DataFrame:
    """Steel parts (is_bolt false) among the revealed keys."""
    return parts.where("NOT is_bolt").join(revealed.select(key).distinct(), key, "left_semi")


def inverse_pairs(relations: DataFrame, elements: DataFrame) -> DataFrame:
    """Distinct (bolt_id, part_id) seen from fasteners: whatever relates to one, or is related to by one, and is
    steel. relations: relating, related; elements: element_id, is_fastener."""
    both = relations.select(F.col("relating").alias("bolt_id"), F.col("related").alias("part_id")).union(relations.select("related", "relating"))
    bolts = elements.where("is_fastener").select(F.col("element_id").alias("bolt_id"))
    steel = elements.where("NOT is_fastener").select(F.col("element_id").alias("part_id"))
    return both.join(bolts, "bolt_id", "left_semi").join(steel, "part_id", "left_semi").select("bolt_id", "part_id").distinct()


def leaf_split(nodes: DataFrame, leaves: DataFrame, elements: DataFrame) -> DataFrame:
    """(node, leaf, is_fastener): leaves of assemblies; other nodes are their own leaf. nodes: node, is_assembly;
    leaves: the rows of `resolve.leaf_products`."""
    own = nodes.where("NOT is_assembly").select("node", F.col("node").alias("leaf"))
    below = leaves.select(F.col("seed").alias("node"), F.col("node").alias("leaf")).join(nodes.where("is_assembly").select("node"), "node", "left_semi")
    return own.union(below).join(elements.select(F.col("element_id").alias("leaf"), "is_fastener"), "leaf").select("node", "leaf", "is_fastener")


def spec_summary(elements: DataFrame, by: list[str]) -> DataFrame:
    """One text a specification: number of columns and of beams, each with its distinct profiles and lengths, sorted.
    elements: role, profile, length_mm; labels are counted before they meet, so a text grows with its labels only."""
    label = F.concat("profile", F.lit(" ("), F.col("length_mm").cast("long"), F.lit(" mm)"))
    kinds = elements.where(F.col("role").isin(*ROLES)).groupBy(*by, "role", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    lines = kinds.groupBy(*by, "role").agg(F.concat(F.sum("n").cast("string"), F.lit("× "), "role", F.lit(": "), F.array_join(F.array_sort(F.collect_list("label")), ", ")).alias("line"))
    of = lambda r: F.max(F.when(F.col("role") == r, F.col("line")))
    some = lines.groupBy(*by).agg(F.concat_ws(" · ", *map(of, ROLES)).alias("summary"))
    return elements.select(*by).distinct().join(some, by, "left").select(*by, F.coalesce("summary", F.lit("empty model")).alias("summary"))


def padded_dimensions(shape: Column, dims: Column) -> Column:
    """Dimensions of open sections with a flange: three of them get one by the web; all others stay."""
    web = F.get(dims, F.lit(2))
    closed = shape.isin(*SIZES)
    return F.when(~closed & (F.size(dims) == 3), F.concat(dims, F.array(F.greatest(web * FLANGE_RATIO, F.lit(FLANGE_LEAST))))).otherwise(dims)


def schema_errors(elements: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, error) of elements (id, role, height_mm, grid_position, n_supports, shape, dimensions): every broken
    rule is a row; an id that repeats within by is one row."""
    n = F.size("dimensions")
    allowed = F.lit(False)
    for shape, sizes in SIZES.items():
        allowed = allowed | ((F.col("shape") == shape) & n.isin(*sizes))
    allowed = allowed | (~F.col("shape").isin(*SIZES) & n.isin(*OPEN_SIZES))
    column = F.col("role") == "column"
    rules = {
        "column_without_height": column & F.col("height_mm").isNull(), "column_without_grid": column & F.col("grid_position").isNull(), "beam_without_support": ~column & (F.coalesce("n_supports", F.lit(0)) < 1),
        "dimension_not_positive": F.exists("dimensions", lambda d: F.coalesce((d <= 0) | F.isnan(d.cast("double")) | (d == float("inf")), F.lit(True))), "dimension_count": ~allowed,
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(e)) for e, c in rules.items())))
    rows = elements.select(*by, "id", F.explode(broken).alias("error"))
    twice = elements.groupBy(*by, "id").count().where("count > 1").select(*by, "id", F.lit("repeated_id").alias("error"))
    return rows.unionByName(twice)
