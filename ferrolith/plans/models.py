"""Queries over member models: embeddings read as members, suppliers as intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import members as m
from ferrolith.sources import bindings

_MEM = """mem AS (SELECT label AS model_id, 'm' || (vec_id % 40) AS member_id, vec_id AS seq, ['HEB200', 'ipe 300', 'L100x100x10', 'CHS168.3x5', 'RHS100X100X5', 'oak'][vec_id % 6 + 1] AS profile,
  embedding[1]::DOUBLE * 5000 AS sx, embedding[2]::DOUBLE * 5000 AS sy, embedding[3]::DOUBLE * 5000 AS sz,
  CASE WHEN vec_id % 3 = 0 THEN sx ELSE embedding[4]::DOUBLE * 5000 END AS ex, CASE WHEN vec_id % 3 = 0 THEN sy ELSE embedding[5]::DOUBLE * 5000 END AS ey,
  CASE WHEN vec_id % 50 = 0 THEN sz ELSE embedding[6]::DOUBLE * 5000 END AS ez FROM embeddings),
l AS (SELECT *, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) + (ez - sz) * (ez - sz)) AS n FROM mem)"""


def members(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double") * 5000
    names = F.array(*map(F.lit, ("HEB200", "ipe 300", "L100x100x10", "CHS168.3x5", "RHS100X100X5", "oak")))
    v = F.col("vec_id")
    return bindings.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("model_id"), F.concat(F.lit("m"), v % 40).alias("member_id"), v.alias("seq"), F.element_at(names, (v % 6 + 1).cast("int")).alias("profile"), e(0).alias("sx"), e(1).alias("sy"), e(2).alias("sz"),
        F.when(v % 3 == 0, e(0)).otherwise(e(3)).alias("ex"), F.when(v % 3 == 0, e(1)).otherwise(e(4)).alias("ey"), F.when(v % 50 == 0, e(2)).otherwise(e(5)).alias("ez"),
    )


def sanitize(spark, sf_dir):
    return m.sanitize(members(spark, sf_dir)).select("model_id", "member_id", "seq")


def validate(spark, sf_dir):
    rows = members(spark, sf_dir).withColumn("profile", F.regexp_replace("profile", " ", ""))
    return m.validate(rows)


def align(spark, sf_dir):
    return m.align(members(spark, sf_dir)).select("model_id", "seq", "sx", "sy", "sz", "ex", "ey", "ez")


def connectivity(spark, sf_dir):
    return m.connectivity(members(spark, sf_dir)).withColumns({f"span_{a}": F.round(f"span_{a}", 3) for a in "xyz"})


def placeholder(spark, sf_dir):
    return m.placeholder(members(spark, sf_dir), 100)


def classify_segments(spark, sf_dir):
    rows = m.classify(members(spark, sf_dir).drop("member_id").withColumn("member_id", F.col("seq")))
    return rows.select("model_id", "member_id", "category", "axis", F.round("length", 4).alias("length"), F.round("z", 4).alias("z"))


def catalog_resolve(spark, sf_dir):
    spec = F.array(F.concat(F.lit("HEB"), F.col("p_size") + 100), F.concat(F.lit("ipe"), F.col("p_size") + 200), F.concat(F.lit("UPN"), F.col("p_size") + 80), F.concat(F.lit("L"), "p_size", F.lit("x"), "p_size", F.lit("x5")), F.concat(F.lit("SHS"), F.col("p_size") + 20, F.lit("x4")), F.col("p_name"))
    rows = bindings.table(spark, sf_dir, "part").select("p_partkey", F.posexplode(spec).alias("i", "profile"))
    catalog = spark.createDataFrame([("HEB", "HEB120", [120.0, 120.0, 6.5, 11.0]), ("IPE", "IPE240", [240.0, 120.0, 6.2, 9.8])], "family string, key string, dims array<double>")
    aliases = spark.createDataFrame([("old bolt", "IPE240")], "alias string, key string")
    out = m.apply_catalog(rows, catalog, aliases)
    return out.select("p_partkey", "i", "key", "family", F.round(F.col("dims")[0], 3).alias("d0"), F.round(F.col("dims")[1], 3).alias("d1"), F.round(F.col("dims")[2], 3).alias("d2"))


def _intent(spark, sf_dir):
    k = F.col("s_suppkey")
    none = lambda *names: {n: F.lit(None).cast("double") for n in names}
    sup = bindings.table(spark, sf_dir, "supplier")
    grids = sup.select(k.alias("model_id"), (18000.0 + k % 5 * 6000).alias("length_x_mm"), (12000.0 + k % 3 * 4000).alias("width_y_mm"), F.lit(6000.0).alias("bay_spacing_x_mm"), F.lit(None).cast("array<double>").alias("frame_line_x_mm"), F.when(k % 2 == 0, F.array(F.lit(0.0), (12000.0 + k % 3 * 4000) / 2, 12000.0 + k % 3 * 4000)).alias("frame_line_y_mm"))
    level = lambda name, z: F.struct(F.lit(name).alias("name"), F.lit(z).alias("elevation_mm"))
    levels = sup.select(k.alias("model_id"), F.explode(F.array(level("Ground", 0.0), level("Eave", 6000.0), level("Ridge", 7000.0 + k % 4 * 500))).alias("l")).select("model_id", "l.*")
    g = lambda i, o, a, s, e, c, sp, n: F.struct(F.lit(i).alias("group_id"), F.lit(o).alias("orientation"), F.lit(a).alias("assigned_to_grid"), F.lit(s).alias("start_level"), F.lit(e).alias("end_level"), F.lit(c).alias("category"), F.lit(sp).cast("double").alias("spacing_mm"), F.lit(n).cast("int").alias("member_count"))
    rows = F.array(
        g("col", "vertical", "all_frame_lines", "Ground", "Eave", "column", None, None), g("cor", "vertical", "perimeter", "Ground", "Eave", "column", None, None), g("beam", "horizontal_x", "along_x_between_columns", "Eave", "Eave", "beam", None, 7),
        g("joist", "horizontal_x", "distributed_along_y", "Eave", "Eave", "beam", 2500, None), g("tie", "horizontal_y", "along_y_at_frame_ends", "Eave", "Eave", "beam", None, None), g("raft", "inclined_dual_y", "all", "Eave", "Ridge", "rafter", None, None),
        g("web", "truss_web_panels", "warren", "Eave", "Ridge", "web", 2500, None), g("alt", "truss_web_panels", "alternating", "Eave", "Ridge", "web", 2000, None), g("purlin", "roof_purlins_dual_slope", "all", "Eave", "Ridge", "purlin", None, 5),
        g("girt", "wall_girts_fixed_z", "all", "Ground", "Eave", "girt", None, None), g("brace", "diagonal_plan", "first_and_last_bay_braces", "Ground", "Eave", "brace", None, None), g("cbr", "diagonal_plan", "corner_braces", "Ground", "Eave", "brace", None, None),
    )
    groups = sup.select(k.alias("model_id"), F.lit("HEB200").alias("profile"), F.explode(rows).alias("g")).select("model_id", "profile", "g.*")
    groups = groups.withColumns(none("x_min_mm", "x_max_mm", "y_min_mm", "y_max_mm", "y_from_mm", "y_to_mm", "brace_offset_x_mm")).withColumn("fixed_elevations_mm", F.lit(None).cast("array<double>"))
    return groups, grids, levels


def _round(df):
    return df.select("model_id", "group_id", "n", "category", *(F.round(c, 3).alias(c) for c in ("sx", "sy", "sz", "ex", "ey", "ez")))


def expand_vertical(spark, sf_dir):
    groups, grids, levels = _intent(spark, sf_dir)
    return _round(m.expand_vertical(m.with_levels(groups, levels), grids))


def expand_horizontal(spark, sf_dir):
    groups, grids, levels = _intent(spark, sf_dir)
    return _round(m.expand_horizontal(m.with_levels(groups, levels), grids))


def expand_truss(spark, sf_dir):
    groups, grids, levels = _intent(spark, sf_dir)
    return _round(m.expand_truss(m.with_levels(groups, levels), grids, levels))


def expand_roof(spark, sf_dir):
    groups, grids, levels = _intent(spark, sf_dir)
    g = m.with_levels(groups, levels)
    return _round(m.expand_rafters(g, grids, levels).unionByName(m.expand_purlins(g, grids, levels)))


def expand_diagonals(spark, sf_dir):
    groups, grids, levels = _intent(spark, sf_dir)
    return _round(m.expand_diagonals(m.with_levels(groups, levels), grids))


def compiled_counts(spark, sf_dir):
    rows = m.compile_intent(*_intent(spark, sf_dir))
    return rows.groupBy("model_id", "group_id").agg(F.count(F.lit(1)).alias("n_members"))


def count_constraints(spark, sf_dir):
    rows = m.compile_intent(*_intent(spark, sf_dir))
    expected = bindings.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model_id"), F.lit("column").alias("category"), F.lit(16).cast("long").alias("expected"))
    return m.count_constraints(rows, expected)


_IN = """g AS (SELECT s_suppkey AS model_id, 18000.0::DOUBLE + s_suppkey % 5 * 6000 AS len, 12000.0::DOUBLE + s_suppkey % 3 * 4000 AS wid, s_suppkey % 2 = 0 AS three,
  7000.0::DOUBLE + s_suppkey % 4 * 500 AS ridge, (3 + s_suppkey % 5)::INT AS bays FROM supplier),
x AS (SELECT model_id, unnest(range(bays + 1)) AS ix, ix * (len / bays) AS x FROM g),
y AS (SELECT model_id, unnest(CASE WHEN three THEN [{'iy': 0, 'y': 0.0}, {'iy': 1, 'y': wid / 2}, {'iy': 2, 'y': wid}] ELSE [{'iy': 0, 'y': 0.0}, {'iy': 1, 'y': wid}] END, recursive := true) FROM g)"""
_ROOF = "CASE WHEN {y} <= wid / 2 THEN 6000 + (ridge - 6000) * ({y} / (wid / 2)) ELSE ridge - (ridge - 6000) * (({y} - wid / 2) / (wid - wid / 2)) END"


def _out(category: str, group: str, source: str, order: str, sx: str, sy: str, sz: str, ex: str, ey: str, ez: str, where: str = "true") -> str:
    values = ", ".join(f"round(({v})::DOUBLE, 3) AS {n}" for n, v in zip(("sx", "sy", "sz", "ex", "ey", "ez"), (sx, sy, sz, ex, ey, ez)))
    return f"SELECT model_id, '{group}' AS group_id, row_number() OVER (PARTITION BY model_id ORDER BY {order})::INT AS n, '{category}' AS category, {values} FROM {source} WHERE {where}"


_WEB = f"""p AS (SELECT *, greatest(4, round_even(wid / 2500, 0))::INT AS k FROM g), w AS (SELECT *, unnest(range(k)) AS i FROM p JOIN x USING (model_id)),
wz AS (SELECT *, wid * i / k AS a, wid * (i + 1) / k AS b FROM w), wr AS (SELECT *, {_ROOF.format(y="a")} AS za, {_ROOF.format(y="b")} AS zb FROM wz),
q AS (SELECT *, greatest(4, round_even(wid / 2000, 0))::INT AS k FROM g), v AS (SELECT *, unnest(range(k)) AS i FROM q JOIN x USING (model_id)),
vz AS (SELECT *, wid * i / k AS a, wid * (i + 1) / k AS b FROM v), vr AS (SELECT *, {_ROOF.format(y="a")} AS za, {_ROOF.format(y="b")} AS zb FROM vz),
alt AS (SELECT model_id, ix, x, 0 AS kind, i, a AS y0, 6000.0 AS z0, a AS y1, za AS z1 FROM vr WHERE i > 0 AND abs(za - 6000) > 1e-6
  UNION ALL SELECT model_id, ix, x, 1, i, CASE WHEN i % 2 = 0 THEN a ELSE b END, 6000.0, CASE WHEN i % 2 = 0 THEN b ELSE a END, CASE WHEN i % 2 = 0 THEN zb ELSE za END FROM vr)"""

QUERIES = {
    "sanitize": (sanitize, f"WITH {_MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id, member_id ORDER BY seq) AS k FROM l WHERE n >= 1) SELECT model_id, member_id || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS member_id, seq FROM r"),
    "validate": (validate, f"""WITH {_MEM} SELECT model_id, count(*) AS n_members, sum((n < 1)::INT)::BIGINT AS n_short, count(*) - count(DISTINCT member_id) AS n_repeated, sum((profile = 'oak')::INT)::BIGINT AS n_unknown,
        sum((n < 1)::INT) = 0 AND count(*) = count(DISTINCT member_id) AS ok FROM l GROUP BY 1"""),
    "align": (align, f"""WITH {_MEM}, o AS (SELECT model_id, min(least(sx, ex)) AS ox, min(least(sy, ey)) AS oy, min(least(sz, ez)) AS oz FROM mem GROUP BY 1)
        SELECT model_id, seq, {", ".join(f"round_even(({p}{a} - o{a}) / 100.0, 0) * 100.0 AS {p}{a}" for p in "se" for a in "xyz")} FROM mem JOIN o USING (model_id)"""),
    "connectivity": (connectivity, None),
    "placeholder": (placeholder, None),
    "classify_segments": (classify_segments, f"""WITH {_MEM}, c AS (SELECT *, abs(ez - sz) / n >= 0.95 AND sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) <= 0.5 AS col FROM l WHERE n > 0.5)
        SELECT model_id, seq AS member_id, CASE WHEN col THEN 'column' ELSE 'beam' END AS category, CASE WHEN NOT col THEN CASE WHEN abs(ex - sx) >= abs(ey - sy) THEN 'X' ELSE 'Y' END END AS axis, round(n, 4) AS length, round(CASE WHEN col THEN least(sz, ez) ELSE sz END, 4) AS z FROM c"""),
    "catalog_resolve": (catalog_resolve, """
        WITH s AS (SELECT p_partkey, p_size AS s, p_name, unnest(range(6))::INT AS i FROM part)
        SELECT p_partkey, i, CASE i WHEN 0 THEN 'HEB' || (s + 100) WHEN 1 THEN 'IPE' || (s + 200) WHEN 2 THEN 'UPN' || (s + 80) WHEN 3 THEN 'L' || s || 'x' || s || 'x5' WHEN 4 THEN (s + 20) || 'x' || (s + 20) || 'x4' ELSE CASE WHEN p_name = 'old bolt' THEN 'IPE240' ELSE 'HEB200' END END AS key,
          CASE i WHEN 0 THEN 'HEB' WHEN 1 THEN 'IPE' WHEN 2 THEN 'UPN' WHEN 3 THEN 'L' WHEN 4 THEN 'RHS' ELSE CASE WHEN p_name = 'old bolt' THEN 'IPE' ELSE 'HEB' END END AS family,
          CASE i WHEN 0 THEN s + 100 WHEN 1 THEN s + 200 WHEN 2 THEN s + 80 WHEN 3 THEN s WHEN 4 THEN s + 20 ELSE CASE WHEN p_name = 'old bolt' THEN 240 ELSE 200 END END::DOUBLE AS d0,
          round(CASE i WHEN 0 THEN s + 100 WHEN 1 THEN (s + 200) * 0.5 WHEN 2 THEN greatest((s + 80) * 0.35, 30) WHEN 3 THEN s WHEN 4 THEN s + 20 ELSE CASE WHEN p_name = 'old bolt' THEN 120 ELSE 200 END END::DOUBLE, 3) AS d1,
          round(CASE i WHEN 0 THEN CASE WHEN s = 20 THEN 6.5 ELSE greatest((s + 100) * 0.045, 6) END WHEN 1 THEN CASE WHEN s = 40 THEN 6.2 ELSE greatest((s + 200) * 0.045, 6) END WHEN 2 THEN greatest((s + 80) * 0.05, 4) WHEN 3 THEN 5 WHEN 4 THEN 4
            ELSE CASE WHEN p_name = 'old bolt' THEN 6.2 ELSE 9 END END::DOUBLE, 3) AS d2 FROM s"""),
    "expand_vertical": (expand_vertical, f"""WITH {_IN}, c AS (SELECT x.model_id, ix, iy, x, y, bays, CASE WHEN three THEN 2 ELSE 1 END AS ly FROM x JOIN y USING (model_id) JOIN g USING (model_id))
        {_out("column", "col", "c", "ix, iy", "x", "y", "0", "x", "y", "6000")} UNION ALL {_out("column", "cor", "c", "ix, iy", "x", "y", "0", "x", "y", "6000", "ix IN (0, bays) AND iy IN (0, ly)")}"""),
    "expand_horizontal": (expand_horizontal, f"""WITH {_IN}, b AS (SELECT a.model_id, b.ix, iy, y, a.x AS x0, b.x AS x1 FROM x a JOIN x b ON a.model_id = b.model_id AND b.ix = a.ix + 1 JOIN y ON y.model_id = a.model_id),
        j AS (SELECT *, unnest(range(round_even(wid / 2500, 0)::INT + 1)) AS i FROM g), t AS (SELECT *, unnest([0, len]) AS tx FROM g)
        SELECT * FROM ({_out("beam", "beam", "b", "iy, ix", "x0", "y", "6000", "x1", "y", "6000")}) WHERE n <= 7 UNION ALL {_out("beam", "joist", "j", "i", "0", "i * 2500", "6000", "len", "i * 2500", "6000")} UNION ALL {_out("beam", "tie", "t", "tx", "tx", "0", "6000", "tx", "wid", "6000")}"""),
    "expand_truss": (expand_truss, f"""WITH {_IN}, {_WEB}
        {_out("web", "web", "wr", "ix, i", "x", "a", "CASE WHEN i % 2 = 1 AND za > 6000 + 1e-6 THEN za ELSE 6000 END", "x", "b", "CASE WHEN i % 2 = 1 AND za > 6000 + 1e-6 THEN 6000 ELSE zb END")} UNION ALL {_out("web", "alt", "alt", "ix, kind, i", "x", "y0", "z0", "x", "y1", "z1")}"""),
    "expand_roof": (expand_roof, f"""WITH {_IN}, r AS (SELECT *, unnest([0, 1]) AS s FROM g JOIN x USING (model_id)), p AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS i, CASE WHEN s = 0 THEN wid / 2 * (i / 6.0::DOUBLE) ELSE wid / 2 + (wid - wid / 2) * (i / 6.0::DOUBLE) END AS py FROM (SELECT *, unnest([0, 1]) AS s FROM g)),
        w AS (SELECT *, unnest([1500, 3000, 4500, 5800]) AS z, s FROM (SELECT *, unnest([0, 1]) AS s FROM g))
        {_out("rafter", "raft", "r", "ix, s", "x", "CASE s WHEN 0 THEN 0 ELSE wid / 2 END", "CASE s WHEN 0 THEN 6000 ELSE ridge END", "x", "CASE s WHEN 0 THEN wid / 2 ELSE wid END", "CASE s WHEN 0 THEN ridge ELSE 6000 END")}
        UNION ALL {_out("purlin", "purlin", "p", "i, s", "0", "py", _ROOF.format(y="py"), "len", "py", _ROOF.format(y="py"))} UNION ALL {_out("girt", "girt", "w", "z, s", "0", "s * wid", "z", "len", "s * wid", "z")}"""),
    "expand_diagonals": (expand_diagonals, f"""WITH {_IN}, b AS (SELECT *, unnest([0, bays - 1]) AS k FROM g), c AS (SELECT b.model_id, k, iy, y, k * (len / bays) AS x0, (k + 1) * (len / bays) AS x1 FROM b JOIN y USING (model_id)), d AS (SELECT *, unnest([0, 1]) AS j FROM (SELECT *, unnest([0, 1]) AS i FROM g))
        {_out("brace", "brace", "c", "k, iy", "x0", "y", "0", "x1", "y", "6000")} UNION ALL {_out("brace", "cbr", "d", "i, j", "i * len", "j * wid", "0", "CASE i WHEN 0 THEN 1000 ELSE len - 1000 END", "j * wid", "6000")}"""),
    "compiled_counts": (compiled_counts, None),
    "count_constraints": (count_constraints, f"""WITH {_IN}, c AS (SELECT model_id, (bays + 1) * (CASE WHEN three THEN 3 ELSE 2 END) + 4 AS actual FROM g)
        SELECT model_id, 'column' AS category, 16::BIGINT AS expected, actual::BIGINT AS actual FROM c WHERE actual <> 16"""),
}
