"""Queries over expressions on single rows: walls of sections, categories, notes of scales, snapped ends, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import drawing, extract, resolve, spatial
from ferrolith.sources import bindings


def wall_thickness(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    shapes = F.array(F.concat(F.lit("RHS*"), s * 2, F.lit("*"), s, F.lit("*"), s % 7 + 3), F.concat(F.lit(" chs * "), s, F.lit(",5 ")), F.concat(F.lit("HEB*"), s), F.concat(F.lit("SHS*"), s, F.lit("*0")), F.lit("TUBE"))
    profile = F.element_at(shapes, (k % 5 + 1).cast("int"))
    return bindings.table(spark, sf_dir, "part").select("p_partkey", extract.wall_thickness(profile).alias("wall_mm"))


def category(spark, sf_dir):
    kind = F.concat(F.lit("Ifc"), F.element_at(F.array(*map(F.lit, ("Beam", "Column", "Plate", "MechanicalFastener", "ElementAssembly", "Wall"))), (F.col("p_partkey") % 6 + 1).cast("int")))
    return bindings.table(spark, sf_dir, "part").select("p_partkey", resolve.category(kind).alias("category"))


def scale_of_note(spark, sf_dir):
    s = F.col("p_size")
    notes = F.array(F.concat(s, F.lit(".5 MM / pdf unit")), F.concat(F.lit("grid = "), s + 100), F.lit("units: mm"), F.lit("about half"), F.concat(F.lit("grid "), s % 10))
    note = F.element_at(notes, (F.col("p_partkey") % 5 + 1).cast("int"))
    return bindings.table(spark, sf_dir, "part").select("p_partkey", drawing.scale_of_note(note).alias("mm_per_unit"))


def snapped_end(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    share = F.col("vec_id") % 23 / 22
    ends = {f"e{k}{a}": e(3 * (k - 1) + i) * F.when(F.col("vec_id") % 2 == 0, 9.0).otherwise(1.0) for k in (1, 2) for i, a in enumerate("xyz")}
    rows = bindings.table(spark, sf_dir, "embeddings").select("vec_id", *(c.alias(n) for n, c in ends.items()))
    rows = rows.withColumns({f"p{a}": F.col(f"e1{a}") + (F.col(f"e2{a}") - F.col(f"e1{a}")) * share for a in "xyz"})
    return rows.select("vec_id", spatial.snapped_end().alias("place"))


def result_status(spark, sf_dir):
    o = F.col("o_orderkey")
    return bindings.table(spark, sf_dir, "orders").select("o_orderkey", drawing.result_status(o % 2 == 0, o % 3 > 0, o % 5 == 0).alias("status"))


QUERIES = {
    "wall_thickness": (wall_thickness, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size % 7 + 3 WHEN 1 THEN p_size + 0.5 END::DOUBLE AS wall_mm FROM part"),
    "category": (category, "SELECT p_partkey, ['beam', 'column', 'plate', 'bolt', 'assembly', 'other'][p_partkey % 6 + 1] AS category FROM part"),
    "scale_of_note": (scale_of_note, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN 1 WHEN 2 THEN 1 END::DOUBLE AS mm_per_unit FROM part"),
    "snapped_end": (snapped_end, f"""
        WITH e AS (SELECT vec_id, vec_id % 23 / 22 AS t, CASE WHEN vec_id % 2 = 0 THEN 9 ELSE 1 END * sqrt({" + ".join(f"(embedding[{i + 3}]::DOUBLE - embedding[{i}]::DOUBLE) ** 2" for i in (1, 2, 3))}) AS n FROM embeddings)
        SELECT vec_id, CASE WHEN t * n <= least(n / 10, 0.12) THEN 'start' WHEN (1 - t) * n <= least(n / 10, 0.12) THEN 'end' ELSE 'edge' END AS place FROM e"""),
    "result_status": (result_status, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 2 <> 0 OR o_orderkey % 5 = 0 THEN 'needs_review' ELSE 'ok' END AS status FROM orders"),
}
