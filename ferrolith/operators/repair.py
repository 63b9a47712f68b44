"""Repair of specifications by what their texts lock: sections, lengths, places; with a log of every change.

Elements: model_id, seq, role (column, beam or any other), profile, length_mm, x, y, z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import durable
from .textspec import HEIGHT, SPAN, column_count, first_measure, request_flags, stated_place

#: Smallest difference that counts, millimetres; what a text that says nothing stands for.
EPS, N_COLUMNS, SPAN_MM, HEIGHT_MM, SECTIONS = 0.5, 3, 6000.0, 3500.0, {"column": "HEB200", "beam": "IPE200"}
VALUES = {"profile": "string", "length_mm": "double", "x": "double", "y": "double", "z": "double"}


def locks(texts: DataFrame, sections: DataFrame | None = None, text: str = "text") -> DataFrame:
    """One row a model of what its text locks: portal, n_columns, height_mm, span_mm, place, column_key, beam_key.

    sections: model_id, role, key (`textspec.role_profiles`). What a text leaves open is null.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = texts.select("model_id", F.coalesce(request_flags(t)["portal"], F.lit(False)).alias("portal"), column_count(t).alias("n_columns"), first_measure(t, HEIGHT).alias("height_mm"), first_measure(t, SPAN).alias("span_mm"), stated_place(t).alias("place"))
    if sections is None:
        return rows.withColumns({"column_key": F.lit(None).cast("string"), "beam_key": F.lit(None).cast("string")})
    keys = sections.groupBy("model_id").agg(*(F.max(F.when(F.col("role") == r, F.col("key"))).alias(f"{r}_key") for r in ("column", "beam")))
    return rows.join(keys, "model_id", "left")


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def repaired(elements: DataFrame, locked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, log): repaired elements, and a row (model_id, seq, field, old, new, rule) for each changed value.

    In this order: sections by role; lengths of columns and beams; then, for portals, columns spread evenly over the
    span if there are as many as stated, or else columns and one beam anew; then beams below the highest column top
    are raised to it. A rule changes what the rules before it left, so a stated height also moves the beams. Elements
    of a portal that is built anew are logged as gone or new (field element). Applying it twice changes nothing more.

    Defined cases: models without a row in locked, and elements of other roles, stay as they are but for the raising of
    beams; models without elements stay empty. Columns of one x keep the order of seq. Null sizes are replaced by
    stated ones and else stay null.
    """
    rows = elements.join(locked, "model_id", "left").withColumn("portal", F.coalesce("portal", F.lit(False)))
    column, beam = F.col("role") == "column", F.col("role") == "beam"
    rows = rows.withColumns({f"old_{v}": F.col(v) for v in VALUES})
    rows = rows.withColumn("profile", F.coalesce(F.when(column, F.col("column_key")).when(beam, F.col("beam_key")), F.col("profile")))
    stated = F.when(column, _positive("height_mm")).when(beam, _positive("span_mm"))
    rows = rows.withColumn("length_mm", F.when(F.coalesce(F.abs(F.col("length_mm") - stated) > EPS, stated.isNotNull() & F.col("length_mm").isNull()), stated).otherwise(F.col("length_mm")))

    rows = durable(rows, "repair")
    # what the rules on whole models ask for: one row a model
    first = lambda c, of: F.min_by(F.when(of, F.col(c)), F.when(of, F.col("seq")))
    models = rows.groupBy("model_id").agg(F.count_if(column).alias("has_columns"), F.count_if(beam).alias("has_beams"), first("profile", column).alias("own_column"), first("profile", beam).alias("own_beam"), first("length_mm", column).alias("own_height"), first("length_mm", beam).alias("own_span"))
    models = models.join(locked, "model_id", "left").withColumn("wanted", F.coalesce("n_columns", F.lit(N_COLUMNS)))
    anew = F.coalesce(F.col("portal"), F.lit(False)) & ((F.col("has_columns") != F.col("wanted")) | (F.col("has_beams") == 0))
    models = models.withColumn("anew", anew)
    rows = rows.join(models.select("model_id", "wanted", "anew"), "model_id")

    place = F.row_number().over(Window.partitionBy("model_id", "role").orderBy("x", "seq")) - 1
    spread = F.col("portal") & ~F.col("anew") & column & (F.col("span_mm") > 0) & (F.col("wanted") > 1)
    kept = rows.where("NOT anew").withColumn("place_", place).withColumn("x", F.when(F.coalesce(spread, F.lit(False)), F.col("span_mm") * F.col("place_") / (F.col("wanted") - 1)).otherwise(F.col("x")))

    built = _portal(models.where("anew"))
    ours = ["model_id", "seq", "role", *VALUES]
    after = kept.select(*ours).unionByName(built.select(*ours))
    tops = after.where("role = 'column'").groupBy("model_id").agg(F.max(F.col("z") + F.col("length_mm")).alias("top"))
    after = after.join(tops, "model_id", "left").withColumn("z", F.when((F.col("role") == "beam") & (F.col("z") < F.coalesce("top", F.lit(0.0)) - EPS), F.coalesce("top", F.lit(0.0))).otherwise(F.col("z"))).drop("top")
    after = durable(after, "repaired")

    rules = {"profile": "section", "length_mm": "length", "x": "spread", "y": "spread", "z": "raised"}
    was = kept.select("model_id", "seq", *(F.col(f"old_{v}") for v in VALUES))
    change = F.array_compact(F.array(*(F.when(~F.col(f"old_{v}").eqNullSafe(F.col(v)), F.struct(F.lit(v).alias("field"), F.col(f"old_{v}").cast("string").alias("old"), F.col(v).cast("string").alias("new"), F.lit(r).alias("rule"))) for v, r in rules.items())))
    log = after.join(was, ["model_id", "seq"]).select("model_id", "seq", F.explode(change).alias("c")).select("model_id", "seq", "c.*")
    text = lambda c: F.lit(c).cast("string")
    gone = rows.where("anew").select("model_id", "seq", F.lit("element").alias("field"), F.col("role").alias("old"), text(None).alias("new"), F.lit("portal").alias("rule"))
    new = built.select("model_id", "seq", F.lit("element").alias("field"), text(None).alias("old"), F.col("role").alias("new"), F.lit("portal").alias("rule"))
    return after, log.unionByName(gone).unionByName(new)


def _portal(models: DataFrame) -> DataFrame:
    """Evenly spread columns along x and a beam on top, for models that are built anew; seq counts from 0."""
    span = F.when(F.col("span_mm") > 0, F.col("span_mm")).otherwise(F.coalesce("own_span", F.lit(SPAN_MM)))
    height = F.when(F.col("height_mm") > 0, F.col("height_mm")).otherwise(F.coalesce("own_height", F.lit(HEIGHT_MM)))
    m = models.withColumns({"span": span, "height": height, "base_y": F.col("place.y"), "base_z": F.col("place.z"), "column": F.coalesce("column_key", "own_column", F.lit(SECTIONS["column"])), "beam": F.coalesce("beam_key", "own_beam", F.lit(SECTIONS["beam"]))})
    columns = m.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("wanted") - 1))).select(
        "model_id", F.col("i").cast("long").alias("seq"), F.lit("column").alias("role"), F.col("column").alias("profile"), F.col("height").alias("length_mm"), (F.col("span") * F.col("i") / (F.col("wanted") - 1)).alias("x"), F.col("base_y").alias("y"), F.col("base_z").alias("z")
    )
    beams = m.select("model_id", F.col("wanted").cast("long").alias("seq"), F.lit("beam").alias("role"), F.col("beam").alias("profile"), F.col("span").alias("length_mm"), F.lit(0.0).alias("x"), F.col("base_y").alias("y"), (F.col("base_z") + F.col("height")).alias("z"))
    return columns.unionByName(beams)
