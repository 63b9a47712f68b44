"""Queries over stated quantities and over details: texts written from parts, lines and orders as elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import details, prompts, textspec
from ferrolith.sources import bindings
from ferrolith.streaming import jobs


def texts(spark, sf_dir):
    """Specifications with quantity sections, written from part rows."""
    s, k = F.col("p_size"), F.col("p_partkey")
    line = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    walls = F.when(k % 3 == 0, line("Place ", s, " columns along the front wall.\n", " " * 90, "\nPut ", s + 1, " matching columns along the back wall.\n")).when(k % 3 == 1, line(s, " columns on each side wall\n")).otherwise(line(s, " columns in all\n"))
    sections = line(
        "REAR ANCHOR COLUMNS\nProfile: HEB 300\nIn all ", s + 2, " Units Total\nCANTILEVER PRIMARY BEAMS\nProfile: IPE 400\nIn all ", s + 3, " Units Total\nFLOOR JOISTS\nProfile: IPE 200\nIn all ", s + 4, " Lines Total\n", F.when(k % 5 > 0, "every 1500 mm across\n").otherwise(""),
        "TENSION SUSPENSION RODS\nIn all ", s + 5, " Units Total\nGUARDRAIL at Z = ", s + 6100, " mm\nMezzanine Floor Z = ", s + 5000, " mm\n", F.when(k % 8 > 0, line("Upper Anchor Z = ", s + 9000, " mm\n")).otherwise(""),
    )
    body = line(
        "Total Length: ", s * 1000, " mm\nTotal Width: ", s * 500 + 500, " mm\nBay Spacing: 6000 mm\n", F.when(k % 2 == 0, line("Mezzanine Total Length (clear): ", s * 900, " mm\nIfcSlab of Thickness = 180 mm\n")).otherwise(""), walls,
        F.when(k % 7 == 0, line("Grid Line Y = ", s * 500, "\nGrid Line Y = 0\nGrid Line Y=", s * 500, "\n")).otherwise(""), "Level 1 deck Spanning the hall, X=0 to X=", s * 1000, "; Level 2 gallery from X = 2000 to X = ", s * 1000 + 3000, "\n",
        F.when(k % 4 == 0, sections).otherwise(""),
    )
    return bindings.table(spark, sf_dir, "part").select("p_partkey", "p_size", body.alias("text"))


def prompt_constraints(spark, sf_dir):
    return prompts.prompt_constraints(texts(spark, sf_dir), "p_partkey")


def y_grid_lines(spark, sf_dir):
    frames = F.when(F.col("p_partkey") % 11 == 0, F.col("p_size") * 2).otherwise(F.col("p_size")).cast("int")
    found = prompts.y_grid_lines(F.col("text"), F.col("p_size") * 500, F.when(F.col("p_partkey") % 5 < 2, F.col("p_size") * 3).otherwise(prompts.column_count(F.col("text"))), frames)
    return texts(spark, sf_dir).select("p_partkey", F.posexplode(found).alias("idx", "y_mm"))


def level_x_spans(spark, sf_dir):
    return prompts.level_x_spans(texts(spark, sf_dir), "p_partkey")


def quantity_rows(spark, sf_dir):
    rows = texts(spark, sf_dir).withColumn("width_mm", F.col("p_size") * 500.0)
    return prompts.quantity_rows(rows, textspec.level_table(rows, "p_partkey"), "p_partkey").withColumn("spacing_mm", F.round("spacing_mm", 6))


def part_details(spark, sf_dir):
    picks = bindings.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("assembly_id"))
    rows = details.part_details(bindings.parts(spark, sf_dir), picks, "assembly_id")
    return rows.select("assembly_id", "label", "profile_label", "material", "identical", F.round("weight", 2).alias("weight"))


def _elements(spark, sf_dir):
    line = bindings.table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("part-"), F.col("l_partkey") % 50)
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("{"), name, F.lit("}"))).otherwise(name)
    return line.select("l_orderkey", name.alias("id"), "l_linenumber", "l_partkey")


def assembly_refs(spark, sf_dir):
    # every other spelling has braces
    rows = _elements(spark, sf_dir).withColumn("is_bolt", F.col("l_partkey") % 50 % 4 == 0)
    return details.assembly_refs(rows.withColumnRenamed("l_linenumber", "ord"), ["l_orderkey"]).select("l_orderkey", "key", "is_bolt", "place")


def revealed_parts(spark, sf_dir):
    parts = bindings.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").contains("bolt").alias("is_bolt"))
    revealed = bindings.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part_id"))
    return details.revealed_parts(parts, revealed, "part_id").select("part_id")


def inverse_pairs(spark, sf_dir):
    relations = bindings.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("relating"), (F.col("l_partkey") * 7 % 1000 + 1).alias("related"))
    elements = bindings.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("element_id"), (F.col("p_partkey") % 4 == 0).alias("is_fastener"))
    return details.inverse_pairs(relations, elements)


def spec_summary(spark, sf_dir):
    role = F.element_at(F.array(*map(F.lit, ("column", "beam", "slab"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = bindings.table(spark, sf_dir, "lineitem").select("l_orderkey", role.alias("role"), F.concat(F.lit("HEB"), (F.col("l_partkey") % 3 + 1) * 100).alias("profile"), (F.col("l_quantity").cast("double") % 4 * 1000 + 0.5).alias("length_mm"))
    return details.spec_summary(rows, ["l_orderkey"])


def _specified(spark, sf_dir):
    q, n = F.col("l_quantity").cast("double"), F.col("l_partkey")
    shape = F.element_at(F.array(*map(F.lit, ("CHS", "RHS", "L", "I"))), (n % 4 + 1).cast("int"))
    return bindings.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("model_id"), (n % 20).alias("id"), F.when(n % 2 == 0, "column").otherwise("beam").alias("role"), F.when(n % 3 > 0, q).alias("height_mm"), F.when(n % 5 > 0, n).alias("grid_position"), (n % 7).alias("n_supports"), shape.alias("shape"),
        F.slice(F.array(q, q + 1, q - 2, q), 1, (n % 3 + 2).cast("int")).alias("dimensions"), "l_linenumber",
    )


def schema_errors(spark, sf_dir):
    return details.schema_errors(_specified(spark, sf_dir), ["model_id"])


def padded_dimensions(spark, sf_dir):
    d = details.padded_dimensions(F.col("shape"), F.col("dimensions"))
    return _specified(spark, sf_dir).select("model_id", "id", F.size(d).alias("n"), F.element_at(d, -1).alias("last"))


def group_toggle(spark, sf_dir):
    e = bindings.table(spark, sf_dir, "events").select("user_id", (F.col("value") > 20).alias("on"), (F.col("event_type") != "error").alias("has_tab"))
    return jobs.group_toggle(e, "user_id")


_T = "t AS (SELECT p_partkey AS k, p_size AS s, CASE p_partkey % 3 WHEN 0 THEN p_size * 2 + 1 WHEN 1 THEN p_size * 2 ELSE p_size END AS n FROM part)"
_E = "e AS (SELECT l_orderkey AS model_id, l_partkey % 20 AS id, l_partkey AS n, l_quantity::DOUBLE AS q, [l_quantity::DOUBLE, l_quantity::DOUBLE + 1, l_quantity::DOUBLE - 2, l_quantity::DOUBLE][:l_partkey % 3 + 2] AS d, ['CHS', 'RHS', 'L', 'I'][l_partkey % 4 + 1] AS shape FROM lineitem)"

QUERIES = {
    "prompt_constraints": (prompt_constraints, f"""
        WITH {_T}, r AS (SELECT k, unnest([{{'name': 'span_x_mm', 'value': CASE WHEN k % 2 = 0 THEN s * 900 ELSE s * 1000 END::DOUBLE}}, {{'name': 'span_y_mm', 'value': s * 500 + 500}}, {{'name': 'bay_spacing_x_mm', 'value': 6000}},
          {{'name': 'slab_thickness_mm', 'value': CASE WHEN k % 2 = 0 THEN 180 END}}, {{'name': 'count_slabs', 'value': CASE WHEN k % 2 = 0 THEN 1 END}}, {{'name': 'count_columns', 'value': n}}], recursive := true) FROM t)
        SELECT k AS p_partkey, name, value FROM r WHERE value IS NOT NULL"""),
    "y_grid_lines": (y_grid_lines, f"""
        WITH {_T}, f AS (SELECT *, CASE WHEN k % 11 = 0 THEN s * 2 ELSE s END AS frames, CASE WHEN k % 5 < 2 THEN s * 3 ELSE n END AS c FROM t),
        y AS (SELECT k, CASE WHEN k % 7 = 0 THEN [0.0::DOUBLE, s * 500] WHEN frames >= 2 AND c = frames * 3 THEN [0.0::DOUBLE, s * 250, s * 500] ELSE [] END AS y FROM f) SELECT k AS p_partkey, unnest(range(len(y)))::INT AS idx, unnest(y) AS y_mm FROM y"""),
    "level_x_spans": (level_x_spans, "SELECT p_partkey, 1 AS level, 0.0::DOUBLE AS x0, p_size * 1000::DOUBLE AS x1 FROM part UNION ALL SELECT p_partkey, 2, 2000.0, p_size * 1000 + 3000 FROM part"),
    "quantity_rows": (quantity_rows, f"""
        WITH {_T}, u AS (SELECT *, k % 8 > 0 AS up FROM t WHERE k % 4 = 0), r AS (SELECT k, unnest([
          {{'g': CASE WHEN up THEN 'columns_along_y_min' END, 'profile': 'HEB300', 'o': 'vertical', 'a': 'along_all_x_at_y_min', 'x': 'Ground', 'y': 'UpperAnchor', 'sp': NULL::DOUBLE, 'n': s + 2, 'c': 'column'}},
          {{'g': 'beams_along_y_per_x', 'profile': 'IPE400', 'o': 'horizontal_y_per_frame', 'a': 'along_y_per_frame_line', 'x': 'Deck', 'y': 'Deck', 'sp': NULL, 'n': s + 3, 'c': 'beam'}},
          {{'g': 'joists_along_x_spaced_y', 'profile': 'IPE200', 'o': 'horizontal_x', 'a': 'distributed_along_y', 'x': 'Deck', 'y': 'Deck', 'sp': CASE WHEN k % 5 > 0 THEN 1500 ELSE round(s * 500::DOUBLE / (s + 3), 6) END, 'n': s + 4, 'c': 'beam'}},
          {{'g': CASE WHEN up THEN 'diagonals_per_x' END, 'profile': 'CHS60x5', 'o': 'diagonal_plan', 'a': 'per_x_station', 'x': 'UpperAnchor', 'y': 'Deck', 'sp': NULL, 'n': s + 5, 'c': 'brace'}},
          {{'g': 'edge_at_x_min', 'profile': 'RHS50x50x4', 'o': 'horizontal_y', 'a': 'along_y_at_x_min', 'x': 'Guardrail', 'y': 'Guardrail', 'sp': NULL, 'n': NULL, 'c': 'beam'}},
          {{'g': 'edge_at_y_max', 'profile': 'RHS50x50x4', 'o': 'horizontal_x', 'a': 'along_x_at_y_max', 'x': 'Guardrail', 'y': 'Guardrail', 'sp': NULL, 'n': NULL, 'c': 'beam'}},
          {{'g': 'edge_at_x_max', 'profile': 'RHS50x50x4', 'o': 'horizontal_y', 'a': 'along_y_at_x_max', 'x': 'Guardrail', 'y': 'Guardrail', 'sp': NULL, 'n': NULL, 'c': 'beam'}}], recursive := true) FROM u)
        SELECT k AS p_partkey, g AS group_id, profile, o AS orientation, a AS assigned_to_grid, x AS start_level, y AS end_level, sp AS spacing_mm, n AS member_count, c AS category FROM r WHERE g IS NOT NULL"""),
    "part_details": (part_details, """
        WITH p AS (SELECT l_orderkey, p_name, p_type, p_brand, l_extendedprice::DOUBLE AS w, count(*) OVER (PARTITION BY p_name, lower(p_type), round(l_extendedprice, 4)) AS identical FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT l_orderkey AS assembly_id, p_name AS label, p_type AS profile_label, p_brand AS material, identical, round(w, 2) AS weight FROM p JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'"""),
    "assembly_refs": (assembly_refs, """
        WITH k AS (SELECT l_orderkey, 'PART' || (l_partkey % 50) AS key, l_partkey % 50 % 4 = 0 AS is_bolt, min(l_linenumber) AS ord FROM lineitem GROUP BY 1, 2, 3)
        SELECT l_orderkey, key, is_bolt, row_number() OVER (PARTITION BY l_orderkey ORDER BY is_bolt, ord, key)::INT AS place FROM k"""),
    "revealed_parts": (revealed_parts, "SELECT p_partkey AS part_id FROM part WHERE p_name NOT LIKE '%bolt%' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"),
    "inverse_pairs": (inverse_pairs, """
        WITH r AS (SELECT l_partkey AS a, l_partkey * 7 % 1000 + 1 AS b FROM lineitem), u AS (SELECT a, b FROM r UNION SELECT b, a FROM r)
        SELECT a AS bolt_id, b AS part_id FROM u WHERE a % 4 = 0 AND b % 4 <> 0 AND a IN (SELECT p_partkey FROM part) AND b IN (SELECT p_partkey FROM part)"""),
    "spec_summary": (spec_summary, """
        WITH r AS (SELECT l_orderkey, ['column', 'beam', 'slab'][l_linenumber % 3 + 1] AS role, 'HEB' || ((l_partkey % 3 + 1) * 100) || ' (' || (l_quantity::BIGINT % 4 * 1000) || ' mm)' AS label FROM lineitem),
        g AS (SELECT l_orderkey, role, count(*) || '× ' || role || ': ' || string_agg(DISTINCT label, ', ' ORDER BY label) AS line FROM r GROUP BY 1, 2)
        SELECT l_orderkey, coalesce(string_agg(line, ' · ' ORDER BY role DESC) FILTER (WHERE role <> 'slab'), 'empty model') AS summary FROM g GROUP BY 1"""),
    "schema_errors": (schema_errors, f"""
        WITH {_E}, x AS (SELECT model_id, id, unnest([CASE WHEN n % 2 = 0 AND n % 3 = 0 THEN 'column_without_height' END, CASE WHEN n % 2 = 0 AND n % 5 = 0 THEN 'column_without_grid' END, CASE WHEN n % 2 = 1 AND n % 7 < 1 THEN 'beam_without_support' END,
          CASE WHEN list_min(d) <= 0 THEN 'dimension_not_positive' END, CASE WHEN NOT CASE shape WHEN 'CHS' THEN len(d) = 2 WHEN 'I' THEN len(d) IN (3, 4) ELSE len(d) = 3 END THEN 'dimension_count' END]) AS error FROM e)
        SELECT * FROM x WHERE error IS NOT NULL UNION ALL SELECT model_id, id, 'repeated_id' FROM e GROUP BY 1, 2 HAVING count(*) > 1"""),
    "padded_dimensions": (padded_dimensions, f"WITH {_E} SELECT model_id, id, CASE WHEN shape = 'I' AND len(d) = 3 THEN 4 ELSE len(d) END::INT AS n, CASE WHEN shape = 'I' AND len(d) = 3 THEN greatest(d[3] * 1.5::DOUBLE, 8) ELSE d[-1] END AS last FROM e"),
    "group_toggle": (group_toggle, """SELECT user_id, bool_and(value > 20) AS all_on, bool_or(event_type <> 'error') AS active, CASE WHEN bool_or(event_type <> 'error') THEN NOT bool_and(value > 20) END AS "on" FROM events GROUP BY 1"""),
}
