"""Queries over buildings: requests and texts written from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import buildings
from ferrolith.sources import bindings


def _summed(members):
    length = F.sqrt(sum(((F.col(f"e{a}") - F.col(f"s{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    return members.groupBy("model_id", "part", "category", "section").agg(F.count(F.lit(1)).alias("n_members"), F.round(F.sum(length), 2).alias("total_mm"))


def building_members(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, buildings.KINDS)), (k % 7 + 1).cast("int"))
    heights = F.array(F.lit(1000.0), F.lit(2000.0))
    rows = bindings.table(spark, sf_dir, "part").select(
        k.alias("model_id"), kind.alias("kind"), ((s % 10 + 3) * 5000.0 + k % 2 * 700).alias("length_mm"), ((s % 6 + 4) * 2500.0).alias("width_mm"), F.lit(4000.0).alias("eave_mm"), (s * 10 + 5000.0).alias("ridge_mm"), F.lit(5000.0).alias("bay_mm"), F.lit(300.0).alias("slab_mm"),
        (k % 5 + 2).cast("int").alias("n_columns"), (k % 4 + 1).cast("int").alias("n_purlins"), heights.alias("front_mm"), heights.alias("back_mm"), F.create_map(F.lit("main"), F.lit("HEB200"), F.lit("beam"), F.lit("IPE300")).alias("sections"),
    )
    return _summed(buildings.building_members(rows))


def building_requests(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    text = F.when(k % 4 == 0, put("Warehouse with truss and IfcSlab\nTotal Length: ", s * 1000, " mm\nRidge Height (top): 9100 mm\nThickness = 350 mm\nTop Chords of IPE 300\n")).when(
        k % 4 == 1, put("A monoslope shed, rafters and a concrete slab\nTotal Width: ", s * 100, " mm\nHigh Side Eave Height: 6000 mm\nSTRUCTURAL BRACING\nProfile: CHS 60x4\nFront Wall girts at Z = 500, 900, 1500, 2000\nBack Wall girts at Z = ", s * 100, ", 24000 and more\n")
    ).when(k % 4 == 2, put("Gable roof with ridge, columns and rafters\nSide Wall Height: ", s + 3000, " mm\nCOLUMNS SETUP\nHEA 220\nROOF PURLINS of RHS 80x40x3\n"))
    rows = buildings.building_requests(bindings.table(spark, sf_dir, "part").select(k.alias("model_id"), F.coalesce(text, F.lit("nothing of the kind")).alias("text")))
    listed = lambda c: F.array_join(F.transform(c, lambda v: v.cast("long").cast("string")), ",")
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("sections")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("model_id", "kind", "length_mm", "width_mm", "eave_mm", "ridge_mm", "bay_mm", "slab_mm", listed("front_mm").alias("front"), listed("back_mm").alias("back"), pairs.alias("sections"))


def layout_requests(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    texts = F.element_at(F.array(
        put("a steel shed with columns HEB 240, length 18 m, width ", s + 5, " m, rafters IPE 330, purlins of RHS 80x40x3"), put("IPE 300 beam on top of ", k % 4 + 1, " columns HEA ", (s % 3 + 1) * 100, ", span of ", s + 3, " m"), put(k % 5 + 1, " columns HEB", s + 100, " over a length of ", s * 100, " mm and height 4500 mm"),
        put("one column, height ", s % 4 + 2, " m"), F.lit("a piece of UPN 200"), F.lit("nothing here"),
    ), (k % 6 + 1).cast("int"))
    rows = bindings.table(spark, sf_dir, "part").select(k.alias("model_id"), texts.alias("text"))
    given = bindings.table(spark, sf_dir, "part").where("p_partkey % 12 IN (3, 5)").select(k.alias("model_id"), F.lit("column_row").alias("kind"), F.lit(7700.0).alias("length_mm"), F.lit(None).cast("double").alias("width_mm"), F.lit(2900.0).alias("eave_mm"), F.lit(4).alias("n_columns"), F.lit("HEA160").alias("section"))
    out = buildings.layout_requests(rows, given)
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("sections")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("model_id", "kind", "rule", "length_mm", "width_mm", "eave_mm", "n_columns", pairs.alias("sections"))


_Q = """q AS (SELECT p_partkey AS k, p_partkey % 7 AS kind, (p_size % 10 + 3) * 5000.0::DOUBLE + p_partkey % 2 * 700 AS L, (p_size % 6 + 4) * 2500.0::DOUBLE AS W, 4000.0::DOUBLE AS lo, p_size * 10 + 5000.0::DOUBLE AS hi, p_partkey % 5 + 2 AS nc, p_partkey % 4 + 1 AS np,
  p_size % 10 + 4 + p_partkey % 2 AS fr, CASE WHEN p_partkey % 2 = 1 THEN 700.0::DOUBLE ELSE 5000 END AS last FROM part),
w AS (SELECT k, fr, lo, hi, W, unnest(range(1, (W / 2500)::INT)) * 2500 AS y FROM q WHERE kind = 1),
p AS (SELECT k, fr, lo, hi, W, i, CASE WHEN i % 2 = 0 THEN i + 1 ELSE i END * 2500 AS y FROM (SELECT *, unnest(range((W / 2500)::INT)) AS i FROM q WHERE kind = 1))"""
_TOP = "CASE WHEN y <= W / 2 THEN lo + (hi - lo) * (y / (W / 2)) ELSE hi - (hi - lo) * ((y - W / 2) / (W / 2)) END"


def _part(kinds: str, part: str, category: str, section: str, n: str, total: str, source: str = "q") -> str:
    return f"SELECT k AS model_id, '{part}' AS part, '{category}' AS category, '{section}' AS section, ({n})::BIGINT AS n_members, round(({total})::DOUBLE, 2) AS total_mm FROM {source} WHERE kind IN ({kinds})"


QUERIES = {
    "building_members": (building_members, f"WITH {_Q} " + " UNION ALL ".join([
        _part("0, 1", "columns", "column", "HEB200", "2 * fr", "2 * fr * lo"), _part("2", "columns", "column", "HEB200", "2 * fr", "fr * (lo + hi)"), _part("3, 4", "columns", "column", "HEB200", "nc", "nc * lo"), _part("5", "columns", "column", "HEB200", "1", "lo"), _part("6", "columns", "column", "HEB200", "6", "6 * lo"),
        _part("0, 1", "rafters", "beam", "IPE300", "2 * fr", "2 * fr * sqrt(W * W / 4 + (hi - lo) ** 2)"), _part("2", "rafters", "beam", "IPE300", "fr", "fr * sqrt(W * W + (hi - lo) ** 2)"), _part("6", "rafters", "beam", "IPE300", "3", "3 * W"), _part("1", "ties", "beam", "HEB200", "fr", "fr * W"),
        _part("0", "purlins", "beam", "IPE300", "8", "8 * L"), _part("1", "purlins", "beam", "IPE300", "12", "12 * L"), _part("2", "purlins", "beam", "IPE300", "5", "5 * L"), _part("6", "purlins", "beam", "IPE300", "np", "np * L"), _part("0, 1, 2", "girts", "beam", "HEB200", "4", "4 * L"),
        _part("1, 2", "slab", "slab", "CONCRETE_SLAB", "1", "sqrt(L * L + W * W + 90000)"), _part("4", "beam", "beam", "IPE300", "1", "L"), _part("6", "base_along", "beam", "IPE300", "2", "2 * L"), _part("6", "base_across", "beam", "IPE300", "2", "2 * W"),
        _part("2", "wall_braces", "brace", "HEB200", "8", "2 * (sqrt(25e6 + lo * lo) + sqrt(last * last + lo * lo) + sqrt(25e6 + hi * hi) + sqrt(last * last + hi * hi))"), _part("2", "roof_braces", "brace", "HEB200", "4", "2 * (sqrt(25e6 + W * W + (hi - lo) ** 2) + sqrt(last * last + W * W + (hi - lo) ** 2))"),
        f"SELECT k, 'posts', 'beam', 'HEB200', (any_value(fr) * count(*))::BIGINT, round(any_value(fr) * sum({_TOP} - lo), 2) FROM w GROUP BY 1", f"SELECT k, 'webs', 'beam', 'HEB200', (any_value(fr) * count(*))::BIGINT, round(any_value(fr) * sum(sqrt(6250000 + ({_TOP} - lo) ** 2)), 2) FROM p GROUP BY 1",
    ])),
    "layout_requests": (layout_requests, """
        WITH r AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 6 AS m, p_partkey % 12 IN (3, 5) AS given FROM part)
        SELECT k AS model_id, 'steel_shed' AS kind, 'shed' AS rule, 18000.0::DOUBLE AS length_mm, (s + 5) * 1000.0::DOUBLE AS width_mm, 4000.0::DOUBLE AS eave_mm, 6 AS n_columns, 'beam=HEB240,column=HEB240,main=HEB240,purlin=80x40x3,rafter=IPE330' AS sections FROM r WHERE m = 0
        UNION ALL SELECT k, 'portal_frame', 'portal', (s + 3) * 1000, 4000, 3500, greatest(2, k % 4 + 1), 'beam=IPE300,column=HEA' || ((s % 3 + 1) * 100) || ',main=IPE300' FROM r WHERE m = 1
        UNION ALL SELECT k, 'column_row', 'row', s * 100, 4000, 4500, greatest(2, k % 5 + 1), 'beam=HEB' || (s + 100) || ',column=HEB' || (s + 100) || ',main=HEB' || (s + 100) FROM r WHERE m = 2
        UNION ALL SELECT k, CASE WHEN given THEN 'column_row' ELSE 'single_element' END, CASE WHEN given THEN 'given' ELSE 'column' END, CASE WHEN given THEN 7700 ELSE 5000 END, 4000, (s % 4 + 2) * 1000, CASE WHEN given THEN 4 ELSE 2 END, CASE WHEN given THEN 'beam=HEA160,column=HEA160,main=HEA160' ELSE 'beam=HEB200,column=HEB200,main=HEB200' END FROM r WHERE m = 3
        UNION ALL SELECT k, 'single_element', 'section', 5000, 4000, 3000, 2, 'beam=UPN200,column=UPN200,main=UPN200' FROM r WHERE m = 4
        UNION ALL SELECT k, 'column_row', 'given', 7700, 4000, 2900, 4, 'beam=HEA160,column=HEA160,main=HEA160' FROM r WHERE m = 5 AND given"""),
    "building_requests": (building_requests, """
        WITH r AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 4 AS m FROM part)
        SELECT k AS model_id, 'truss' AS kind, s * 1000.0::DOUBLE AS length_mm, 20000.0::DOUBLE AS width_mm, 6000.0::DOUBLE AS eave_mm, 9100.0::DOUBLE AS ridge_mm, 5000.0::DOUBLE AS bay_mm, 350.0::DOUBLE AS slab_mm, '1500,3000,4500,5800' AS front, '1500,3000,4500,5800' AS back,
          'column=HEB300,girt=100x50x4,purlin=100x100x6,rafter=IPE300,tie=UPN240,web=80x80x5' AS sections FROM r WHERE m = 0
        UNION ALL SELECT k, 'monoslope', 15000, s * 100, 3500, 6000, 5000, 400, '500,900,1500', greatest(200, s * 100)::BIGINT || ',2400', 'brace=CHS60x4,column=HEB200,girt=200x200x10,purlin=200x200x10,rafter=IPE200' FROM r WHERE m = 1
        UNION ALL SELECT k, 'gable', 30000, 10000, s + 3000, 5500, 5000, 400, '1000,2000,3000', '1000,2000,3000', 'column=HEA220,girt=200x200x10,purlin=80x40x3,rafter=IPE200' FROM r WHERE m = 2"""),
}
