"""Schemas, readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the decoded inputs.
SCHEMAS = {
    "elements": "model_id string, element_id string, express_id long, ifc_type string, predefined_type string, name string, tag string, description string, object_type string, seq long",
    "props": "model_id string, element_id string, layer string, pset string, pset_ord int, prop string, prop_ord int, value string",
    "contains": "model_id string, parent_id string, child_id string, rel string, ord int",
    "typed_by": "model_id string, element_id string, type_id string",
    "rel_connects": "model_id string, rel_id string, kind string, role string, element_id string, ord int",
    "units": "model_id string, unit_type string, unit_class string, name string, prefix string, conversion double, ord int",
    "materials": "model_id string, element_id string, name string, ord int",
    "boxes": "model_id string, element_id string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double",
    "path_items": "doc_id string, page_index int, path_id long, ord int, kind string, pts array<struct<x:double,y:double>>, width double",
    "text_spans": "doc_id string, page_index int, x0 double, y0 double, x1 double, y1 double, text string, seq long",
    "pages": "doc_id string, page_index int, width_pt double, height_pt double, width_px int, height_px int",
    "crops": "doc_id string, page_index int, crop_id string, x double, y double, w double, h double",
    "clicks": "doc_id string, page_index int, crop_id string, id string, x_px double, y_px double, mark string, ord int",
    "prompts": "prompt_id string, turn int, role string, text string",
    "levels": "model_id string, name string, elevation_mm double",
    "grids": "model_id string, length_x_mm double, width_y_mm double, bay_spacing_x_mm double, frame_line_x_mm array<double>, frame_line_y_mm array<double>",
    "slab_groups": "model_id string, id string, top_level string, footprint string, thickness_mm double, x_min_mm double, x_max_mm double, y_min_mm double, y_max_mm double",
    "catalog": "family string, key string, shape string, dims array<double>",
    "aliases": "alias string, key string",
    "filter_events": "event_id long, ts timestamp, session string, action string, key string",
}

_PART = "struct<id:string,expressId:long,name:string,tag:string,partMark:string,profile:string,material:string,quantity:double,weightKg:double>"
_BOLT = "struct<id:string,expressId:long,name:string,boltName:string,boltStandard:string,boltLengthMm:double,boltHoleDiameterMm:double,boltQty:double>"
#: One document a model, as an analyzer writes it.
MODEL = (
    f"model_id string, assemblies array<struct<id:string,expressId:long,name:string,tag:string,assemblyMark:string,positionCode:string,weightKg:double,parts:array<{_PART}>,bolts:array<{_BOLT}>>>, "
    "boltSteelLinks array<struct<boltGlobalId:string,partGlobalId:string>>"
)


def read_table(spark: SparkSession, path: str, name: str, form: str = "parquet") -> DataFrame:
    """A table of SCHEMAS from Parquet, ORC, JSON lines or CSV; the schema is given, never inferred."""
    return spark.read.schema(SCHEMAS[name]).format(form).load(path)


def read_models(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Nested model documents, one a line or one a file."""
    return spark.read.schema(MODEL).json(path, multiLine=not lines)


def model_tables(models: DataFrame) -> dict[str, DataFrame]:
    """Nested models as flat tables: assemblies, parts, bolts, members, assembly_bolts, bolt_links."""
    asm = models.select("model_id", F.posexplode("assemblies").alias("seq", "a"))
    part = asm.select("model_id", F.col("a.id").alias("assembly_id"), "seq", F.posexplode("a.parts").alias("ord", "p"))
    bolt = asm.select("model_id", F.col("a.id").alias("assembly_id"), "seq", F.posexplode("a.bolts").alias("ord", "b"))
    names = {"id": "part_id", "expressId": "express_id", "partMark": "mark", "weightKg": "weight"}
    bolt_names = {"id": "bolt_id", "expressId": "express_id", "boltName": "bolt_name", "boltStandard": "standard", "boltLengthMm": "length", "boltHoleDiameterMm": "diameter", "boltQty": "quantity"}
    last = lambda df, c: df.groupBy("model_id", F.col(f"{c}.id").alias("id")).agg(F.max_by(c, F.struct("seq", "ord")).alias("x"), F.min(F.struct("seq", "ord")).alias("at"))
    return {
        "assemblies": asm.select("model_id", F.col("a.id").alias("assembly_id"), "seq", F.col("a.expressId").alias("express_id"), F.col("a.name").alias("name"), F.col("a.tag").alias("tag"), F.col("a.assemblyMark").alias("mark"), F.col("a.positionCode").alias("position_code"), F.col("a.weightKg").alias("weight")),
        "parts": last(part, "p").select("model_id", "x.*").withColumnsRenamed(names),
        "bolts": last(bolt, "b").select("model_id", "x.*").withColumnsRenamed(bolt_names),
        "members": part.select("model_id", "assembly_id", F.col("p.id").alias("part_id")).distinct(),
        "assembly_bolts": bolt.select("model_id", "assembly_id", F.col("b.id").alias("bolt_id")).distinct(),
        "bolt_links": models.select("model_id", F.inline("boltSteelLinks")).withColumnsRenamed({"boltGlobalId": "bolt_id", "partGlobalId": "part_id"}),
    }


def write_table(df: DataFrame, path: str, form: str = "parquet", buckets: int = 64) -> None:
    """Writes a table in folders by a hash of the model or document, so that later reads of some models skip the rest."""
    key = next(k for k in ("model_id", "doc_id", "prompt_id", "session") if k in df.columns)
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").format(form).save(path)
