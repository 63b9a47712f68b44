"""Queries over labelled crops and grid models: order lines read as strokes, labels, marks and columns of their page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import cropgrid
from ferrolith.sources import bindings

BY = ["page"]


def _crops(spark, sf_dir):
    sides = {"cx0": 0.0, "cy0": 0.0, "cx1": 1000.0, "cy1": 1000.0, "mm_per_pt": 10.0, "width_px": 1000.0, "height_px": 1000.0}
    return bindings.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), *(F.lit(v).alias(k) for k, v in sides.items()))


def _lines(spark, sf_dir):
    """Lines of suppliers: at is a place in a crop, run a length, k tells the lines apart."""
    price = F.col("l_extendedprice").cast("double")
    at = F.pmod(F.floor(price), F.lit(1000)).cast("double")
    return bindings.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), "l_orderkey", "l_linenumber", "l_partkey", at.alias("at"), (F.col("l_quantity").cast("double") * 12).alias("run"))


def _strokes(spark, sf_dir):
    rows, up = _lines(spark, sf_dir), F.col("l_linenumber") % 2 == 0
    low, high = F.lit(200.0), F.col("run") + 200
    return rows.select("page", F.when(up, F.col("at")).otherwise(low).alias("x1"), F.when(up, low).otherwise(F.col("at")).alias("y1"), F.when(up, F.col("at")).otherwise(high).alias("x2"), F.when(up, high).otherwise(F.col("at")).alias("y2"))


def _spans(spark, sf_dir):
    """Numbers along the lower edge, letters on the left one, each label near its own place; the rest in the middle. Every fourth page has
    marks instead of labels."""
    part, near = F.col("l_partkey"), F.col("l_orderkey") % 9
    number, letter = part % 12 + 1, part % 5
    x = F.when(F.col("l_linenumber") % 2 == 0, number * 75.0 + near).otherwise(F.when(F.col("l_orderkey") % 3 > 0, 40.0).otherwise(600.0))
    y = F.when(F.col("l_linenumber") % 2 > 0, letter * 180.0 + near + 90).otherwise(F.when(F.col("l_orderkey") % 3 > 0, 980.0).otherwise(500.0))
    text = F.when(F.col("l_linenumber") % 2 == 0, number.cast("string")).otherwise(F.concat(F.lit(" "), F.lower(F.char(letter + 65))))
    text = F.when(F.col("page") % 4 == 0, F.concat(F.lit("M"), F.trim(text))).otherwise(text)
    return _lines(spark, sf_dir).select("page", (x - 4).alias("x0"), (y - 4).alias("y0"), (x + 4).alias("x1"), (y + 4).alias("y1"), text.alias("text"))


def _clicks(spark, sf_dir):
    e = bindings.table(spark, sf_dir, "lineitem")
    return e.select(F.col("l_suppkey").alias("page"), F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise("y").alias("axis"), (F.col("l_partkey") % 7 * 140 + F.col("l_orderkey") % 5).cast("double").alias("at"))


def long_vectors(spark, sf_dir):
    rows = cropgrid.long_vectors(_strokes(spark, sf_dir), _crops(spark, sf_dir), BY)
    return rows.withColumn("line", F.round("line", 6))


def bubble_labels(spark, sf_dir):
    return cropgrid.bubble_labels(_spans(spark, sf_dir), _crops(spark, sf_dir), BY).withColumn("at", F.round("at", 6))


def _axes(spark, sf_dir, clicks=True):
    return cropgrid.crop_grid(_strokes(spark, sf_dir), _spans(spark, sf_dir), _crops(spark, sf_dir), BY, _clicks(spark, sf_dir) if clicks else None)


def crop_grid(spark, sf_dir):
    rows = _axes(spark, sf_dir)
    return rows.select("page", "axis", "source", "n_labels", "n_clicks", F.size("lines").alias("n_lines"), *(F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 3).alias(f"sum_{c}") for c in ("lines", "stations")))


def labelled_axes(spark, sf_dir):
    """Every line of every axis by labels and vectors, without clicks."""
    rows = _axes(spark, sf_dir, clicks=False)
    return rows.select("page", "axis", "source", F.posexplode("lines").alias("idx", "line"), "stations").select("page", "axis", "source", "idx", F.round("line", 5).alias("line"), F.get("stations", F.col("idx")).alias("mm"))


def _models(spark, sf_dir):
    """Edited models: places of the part numbers of an order as lines; orders of one line have bays instead."""
    rows = bindings.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 7 % 100 * 10).cast("double").alias("x"), (F.col("l_suppkey") * 13 % 50 * 20).cast("double").alias("y"), F.col("l_quantity").cast("double").alias("q"), "l_linenumber")
    rows = rows.groupBy("page").agg(F.sort_array(F.collect_set("x")).alias("lines_x"), F.sort_array(F.collect_set("y")).alias("lines_y"), F.max("q").alias("q"))
    none = F.lit(None).cast("array<double>")
    bays = F.array(F.col("q") * 100, F.col("q") * 50)
    return rows.withColumns({"stations_x": none, "stations_y": none, "bays_x": bays, "bays_y": bays, "mm_x": F.when(F.col("page") % 3 > 0, 5.0), "mm_y": F.when(F.col("page") % 2 > 0, 4.0), "span_x": F.lit(0.0), "span_y": F.lit(0.0), "width_px": F.lit(1000.0), "height_px": F.lit(1000.0)})


def _columns(spark, sf_dir):
    rows = bindings.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord")).agg(F.max("l_partkey").alias("p"))
    null = F.lit(None)
    return rows.select("page", "ord", F.concat(F.lit("c"), "p").alias("id"), F.when(F.col("p") % 4 > 0, F.concat(F.lit("C"), F.col("p") % 90)).alias("mark"), (F.col("p") * 31 % 1200 - 100).cast("double").alias("x_px"), (F.col("p") * 17 % 1200 - 100).cast("double").alias("y_px"), null.cast("double").alias("x_mm"), null.cast("double").alias("y_mm"), (F.col("p") % 3).cast("int").alias("ix"), (F.col("p") % 2).cast("int").alias("iy"))


def rebuilt_axes(spark, sf_dir):
    rows = cropgrid.rebuilt_models(_models(spark, sf_dir))
    pick = [f for a in "xy" for f in (F.size(f"axis_{a}.lines").alias(f"n_{a}"), F.array_join(f"axis_{a}.labels", "").alias(f"labels_{a}"), F.round(F.coalesce(F.try_element_at(f"axis_{a}.stations", F.lit(-1)), F.lit(0.0)), 1).alias(f"end_{a}"), F.col(f"span_{a}"))]
    return rows.select("page", *pick)


def rebuilt_columns(spark, sf_dir):
    rows = cropgrid.rebuilt_columns(_columns(spark, sf_dir), cropgrid.rebuilt_models(_models(spark, sf_dir)), BY)
    return rows.select("page", "ord", "mark", *(F.round(c, 2).alias(c) for c in ("x_px", "y_px", "x_mm", "y_mm")), "ix", "iy")


def model_placements(spark, sf_dir):
    models = cropgrid.rebuilt_models(_models(spark, sf_dir))
    return cropgrid.model_placements(cropgrid.rebuilt_columns(_columns(spark, sf_dir), models, BY), models, BY).select("page", "placement_id", "mark", "x_mm", "y_mm")


def moved_columns(spark, sf_dir):
    """Stations before and after an edit: every third order gets one between its first two, every third loses its second."""
    m = _models(spark, sf_dir).select("page", F.col("lines_x").alias("old_x"), F.col("lines_y").alias("old_y"))
    middle = lambda c: (F.get(c, F.lit(0)) + F.get(c, F.lit(1))) / 2
    for a in "xy":
        o = F.col(f"old_{a}")
        grown = F.when(F.size(o) >= 2, F.array_sort(F.concat(o, F.array(middle(o))))).otherwise(o)
        cut = F.filter(o, lambda v, i: i != 1)
        m = m.withColumn(f"new_{a}", F.when(F.col("page") % 3 == 0, grown).when(F.col("page") % 3 == 1, cut).otherwise(o))
    rows = cropgrid.moved_columns(_columns(spark, sf_dir).select("page", "ord", "ix", "iy"), m, BY)
    return rows.select("page", "ord", "ix", "iy", "x_mm", "y_mm", "kept")


def sparse_analysis(spark, sf_dir):
    rows = _models(spark, sf_dir).select("page", "lines_x", "lines_y", F.when(F.col("page") % 4 > 0, F.col("page") % 7 + 0.5).alias("mm_per_px"))
    return cropgrid.sparse_analysis(rows).select("page", "x_text", "y_text")


_L = """l AS (SELECT l_suppkey AS page, l_linenumber % 2 = 0 AS up, l_orderkey AS o, l_partkey AS p, floor(l_extendedprice::DOUBLE)::BIGINT % 1000 AS pos, l_quantity::DOUBLE * 12 AS run FROM lineitem)"""
_VEC = f"""{_L}, e AS (SELECT page, CASE WHEN up THEN 'x' ELSE 'y' END AS axis, pos::DOUBLE AS v, run AS w FROM l WHERE run >= 220),
g AS (SELECT *, coalesce((v - lag(v) OVER (PARTITION BY page, axis ORDER BY v) > 8)::INT, 1) AS new FROM e), c AS (SELECT *, sum(new) OVER (PARTITION BY page, axis ORDER BY v, new DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g),
vec AS (SELECT page, axis, cluster, sum(v * w) / sum(w) AS line FROM c GROUP BY 1, 2, 3)"""
_LAB = f"""lab AS (SELECT page, CASE WHEN up THEN 'x' ELSE 'y' END AS axis, CASE WHEN up THEN (p % 12 + 1)::VARCHAR ELSE chr((65 + p % 5)::INT) END AS label, avg(CASE WHEN up THEN (p % 12 + 1) * 75 + o % 9 ELSE p % 5 * 180 + o % 9 + 90 END) AS pos FROM l WHERE o % 3 > 0 AND page % 4 > 0 GROUP BY 1, 2, 3)"""
#: Greedy folds are recursive: labels take vectors one after the other, and lists keep values a gap apart.
_GRID = f"""{_VEC}, {_LAB}, ax AS (SELECT s_suppkey AS page, unnest(['x', 'y']) AS axis, unnest([18, 8]) AS most FROM supplier),
cg AS (SELECT page, axis, line, coalesce((line - lag(line) OVER (PARTITION BY page, axis ORDER BY line) > 25)::INT, 1) AS new FROM vec), cc AS (SELECT *, sum(new) OVER (PARTITION BY page, axis ORDER BY line, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM cg), cm AS (SELECT page, axis, k, avg(line) AS line FROM cc GROUP BY 1, 2, 3),
lists AS (SELECT page, axis, most, coalesce((SELECT list(line ORDER BY line) FROM vec v WHERE v.page = ax.page AND v.axis = ax.axis), []) AS vs, coalesce((SELECT list(line ORDER BY line) FROM cm v WHERE v.page = ax.page AND v.axis = ax.axis), []) AS cs, coalesce((SELECT list(pos ORDER BY pos) FROM lab v WHERE v.page = ax.page AND v.axis = ax.axis), []) AS ls FROM ax),
snap AS (SELECT page, axis, 0 AS i, []::DOUBLE[] AS used, []::DOUBLE[] AS out FROM lists WHERE len(ls) >= 2 UNION ALL
  SELECT page, axis, i + 1, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END, list_append(out, coalesce(b, lbl)) FROM (
    SELECT s.*, ls[i + 1] AS lbl, list_sort(list_transform(list_filter(vs, lambda v: abs(v - ls[i + 1]) <= 54 AND NOT list_contains(used, v)), lambda v: {{'d': abs(v - ls[i + 1]), 'v': v}}))[1].v AS b FROM snap s JOIN lists USING (page, axis) WHERE i < len(ls)) q),
done AS (SELECT page, axis, list_sort(out) AS l FROM snap JOIN lists USING (page, axis) WHERE i = len(ls)),
f1 AS (SELECT page, axis, [l[1]] AS k, l FROM done UNION ALL SELECT page, axis, list_append(k, n), l FROM (SELECT *, list_min(list_filter(l, lambda v: v - k[-1] >= 10.8)) AS n FROM f1) q WHERE n IS NOT NULL),
s1 AS (SELECT page, axis, (arg_max(k, len(k)))[1:any_value(most)] AS k, any_value(ls) AS ls FROM f1 JOIN lists USING (page, axis) GROUP BY 1, 2), s2 AS (SELECT *, list_filter(k, lambda v: v BETWEEN ls[1] - 30 AND ls[-1] + 30) AS c FROM s1),
t1 AS (SELECT page, axis, [cs[1]] AS k, cs FROM lists WHERE len(ls) < 2 AND len(cs) > most UNION ALL SELECT page, axis, list_append(k, n), cs FROM (SELECT *, list_min(list_filter(cs, lambda v: v - k[-1] >= 40)) AS n FROM t1) q WHERE n IS NOT NULL),
t2 AS (SELECT page, axis, (arg_max(k, len(k)))[1:any_value(most)] AS k, any_value(cs) AS cs FROM t1 JOIN lists USING (page, axis, cs) GROUP BY 1, 2),
ln AS (SELECT page, axis, most, len(ls) AS n_labels, CASE WHEN len(lists.ls) >= 2 THEN CASE WHEN len(s2.c) >= 2 THEN s2.c ELSE s2.k END WHEN len(lists.cs) <= most THEN lists.cs WHEN t2.cs[-1] - t2.k[-1] >= 40 THEN list_append(t2.k, t2.cs[-1]) ELSE t2.k END AS l
  FROM lists LEFT JOIN s2 USING (page, axis, ls) LEFT JOIN t2 USING (page, axis))"""
_FINAL = """f9 AS (SELECT page, axis, l[1:1] AS k, l FROM ready UNION ALL SELECT page, axis, list_append(k, n), l FROM (SELECT *, list_min(list_filter(l, lambda v: v - k[-1] >= 9)) AS n FROM f9) q WHERE n IS NOT NULL),
fin AS (SELECT page, axis, arg_max(k, len(k)) AS k FROM f9 GROUP BY 1, 2), mm AS (SELECT *, list_transform(k, lambda v: round(CASE axis WHEN 'x' THEN v ELSE 1000 - v END * 10, 1)) AS s FROM fin)"""
_CLICK = """ck AS (SELECT l_suppkey AS page, CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE 'y' END AS axis, (l_partkey % 7 * 140 + l_orderkey % 5)::DOUBLE AS pos FROM lineitem),
k1 AS (SELECT *, coalesce((pos - lag(pos) OVER (PARTITION BY page, axis ORDER BY pos) > 22)::INT, 1) AS new FROM ck), k2 AS (SELECT *, sum(new) OVER (PARTITION BY page, axis ORDER BY pos, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM k1),
k3 AS (SELECT page, axis, avg(pos) AS line FROM k2 GROUP BY page, axis, k), k4 AS (SELECT page, axis, list(line ORDER BY line) AS a FROM k3 GROUP BY 1, 2),
k5 AS (SELECT page, axis, a[1:1] AS k, a FROM k4 UNION ALL SELECT page, axis, list_append(k, n), a FROM (SELECT *, list_min(list_filter(a, lambda v: v - k[-1] >= 11)) AS n FROM k5) q WHERE n IS NOT NULL), k6 AS (SELECT page, axis, arg_max(k, len(k)) AS a FROM k5 GROUP BY 1, 2),
ad AS (SELECT page, axis, most, n_labels, l, CASE WHEN len(l) >= 2 THEN coalesce(a, []) ELSE [] END AS a FROM ln LEFT JOIN k6 USING (page, axis)),
u1 AS (SELECT page, axis, unnest(list_concat(l, a)) AS v FROM ad WHERE len(a) > 0), u2 AS (SELECT *, coalesce((v - lag(v) OVER (PARTITION BY page, axis ORDER BY v) > 18)::INT, 1) AS new FROM u1), u3 AS (SELECT *, sum(new) OVER (PARTITION BY page, axis ORDER BY v, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM u2),
u4 AS (SELECT page, axis, avg(v) AS line FROM u3 GROUP BY page, axis, k), u5 AS (SELECT page, axis, list(line ORDER BY line) AS a FROM u4 GROUP BY 1, 2),
u6 AS (SELECT page, axis, a[1:1] AS k, a FROM u5 UNION ALL SELECT page, axis, list_append(k, n), a FROM (SELECT *, list_min(list_filter(a, lambda v: v - k[-1] >= 18)) AS n FROM u6) q WHERE n IS NOT NULL), u7 AS (SELECT page, axis, arg_max(k, len(k)) AS m FROM u6 GROUP BY 1, 2),
ready AS (SELECT page, axis, n_labels, len(a) AS n_clicks, CASE WHEN len(a) > 0 THEN m[1:most] ELSE l END AS l FROM ad LEFT JOIN u7 USING (page, axis))"""
_MOD = """li AS (SELECT l_orderkey AS page, l_linenumber AS ord, l_partkey AS p, (l_partkey * 7 % 100 * 10)::DOUBLE AS x, (l_suppkey * 13 % 50 * 20)::DOUBLE AS y, l_quantity::DOUBLE AS q FROM lineitem),
raw AS (SELECT page, list(DISTINCT x) AS xs, list(DISTINCT y) AS ys, max(q) AS q FROM li GROUP BY 1), md AS (SELECT page, q, list_sort(xs) AS xs, list_sort(ys) AS ys, CASE WHEN page % 3 > 0 THEN 5.0::DOUBLE ELSE 1 END AS mx, CASE WHEN page % 2 > 0 THEN 4.0::DOUBLE WHEN page % 3 > 0 THEN 5 ELSE 1 END AS my FROM raw),
a1 AS (SELECT page, q, unnest(['x', 'y']) AS axis, unnest([xs, ys]) AS l, unnest([mx, my]) AS mm FROM md),
a2 AS (SELECT page, axis, l[1:1] AS k, l FROM a1 UNION ALL SELECT page, axis, list_append(k, n), l FROM (SELECT *, list_min(list_filter(l, lambda v: v - k[-1] >= 10)) AS n FROM a2) t WHERE n IS NOT NULL),
a3 AS (SELECT page, axis, arg_max(k, len(k)) AS k FROM a2 GROUP BY 1, 2),
a4 AS (SELECT page, axis, q, k, CASE WHEN len(k) >= 2 THEN list_sort(list_transform(k, lambda v: round(CASE axis WHEN 'x' THEN v ELSE 1000 - v END * mm, 1))) ELSE [0, round(q * 100, 1), round(q * 150, 1)] END AS st FROM a3 JOIN a1 USING (page, axis)),
a5 AS (SELECT *, list_filter(st, lambda v: v > 1) AS big FROM a4),
am AS (SELECT page, axis, q, k, CASE WHEN st[1] <= 1 THEN st WHEN len(big) >= 2 THEN list_prepend(0.0::DOUBLE, list_transform(range(1, len(big) + 1), lambda i: list_sum(big[:i]))) ELSE st END AS st FROM a5),
mo AS (SELECT page, any_value(q) AS q, any_value(k) FILTER (WHERE axis = 'x') AS lx, any_value(k) FILTER (WHERE axis = 'y') AS ly, any_value(st) FILTER (WHERE axis = 'x') AS sx, any_value(st) FILTER (WHERE axis = 'y') AS sy FROM am GROUP BY 1)"""
_COL = f"""{_MOD}, co AS (SELECT page, ord, max(p) AS p FROM li GROUP BY 1, 2), cp AS (SELECT page, ord, p, greatest(0, least(1000, p * 31 % 1200 - 100))::DOUBLE AS x, greatest(0, least(1000, p * 17 % 1200 - 100))::DOUBLE AS y FROM co),
cd AS (SELECT *, list_transform(lx, lambda v: abs(v - x)) AS dx, list_transform(ly, lambda v: abs(v - y)) AS dy FROM cp JOIN mo USING (page)), ci AS (SELECT *, list_position(dx, list_min(dx)) AS ix, list_position(dy, list_min(dy)) AS iy FROM cd),
cr AS (SELECT page, ord, CASE WHEN p % 4 > 0 THEN 'C' || (p % 90) ELSE 'C1' END AS mark, lx[ix] AS x_px, ly[iy] AS y_px, sx[least(ix, len(sx))] AS x_mm, sy[least(iy, len(sy))] AS y_mm, (ix - 1)::INT AS ix, (iy - 1)::INT AS iy, sx, sy FROM ci)"""
_TEXT = lambda c: f"array_to_string(list_transform({c}, lambda v: CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END), ', ')"

QUERIES = {
    "long_vectors": (long_vectors, f"WITH {_VEC} SELECT page, axis, cluster, round(line, 6) AS line FROM vec"),
    "bubble_labels": (bubble_labels, f'WITH {_L}, {_LAB} SELECT page, axis, label, round(pos, 6) AS "at" FROM lab'),
    "labelled_axes": (labelled_axes, f"""
        WITH RECURSIVE {_GRID}, ready AS (SELECT page, axis, l FROM ln), {_FINAL}
        SELECT page, axis, CASE WHEN n_labels >= 2 THEN 'labels' ELSE 'vectors' END AS source, unnest(range(len(k)))::INT AS idx, round(unnest(k), 5) AS line, unnest(s) AS mm FROM mm JOIN ln USING (page, axis)"""),
    "crop_grid": (crop_grid, f"""
        WITH RECURSIVE {_GRID}, {_CLICK}, {_FINAL}
        SELECT page, axis, CASE WHEN n_labels >= 2 THEN 'labels' ELSE 'vectors' END AS source, n_labels::INT AS n_labels, n_clicks::INT AS n_clicks, len(k)::INT AS n_lines, round(coalesce(list_sum(k), 0), 3)::DOUBLE AS sum_lines, round(coalesce(list_sum(s), 0), 3)::DOUBLE AS sum_stations FROM mm JOIN ready USING (page, axis)"""),
    "rebuilt_axes": (rebuilt_axes, f"""
        WITH RECURSIVE {_MOD} SELECT page, len(lx)::INT AS n_x, len(ly)::INT AS n_y, array_to_string(range(1, len(lx) + 1), '') AS labels_x, array_to_string(list_transform(range(len(ly)), lambda i: chr((65 + i)::INT)), '') AS labels_y,
          round(sx[-1], 1) AS end_x, round(sy[-1], 1) AS end_y, greatest(1, round(q * 150, 1))::DOUBLE AS span_x, greatest(1, round(q * 150, 1))::DOUBLE AS span_y FROM mo"""),
    "rebuilt_columns": (rebuilt_columns, f"WITH RECURSIVE {_COL} SELECT page, ord, mark, round(x_px, 2) AS x_px, round(y_px, 2) AS y_px, round(x_mm, 2) AS x_mm, round(y_mm, 2) AS y_mm, ix, iy FROM cr"),
    "model_placements": (model_placements, f"WITH RECURSIVE {_COL} SELECT page, 'col_' || ix || '_' || iy || '_' || ord AS placement_id, mark, round(x_mm, 1) AS x_mm, round(y_mm, 1) AS y_mm FROM cr WHERE len(sx) >= 2 AND len(sy) >= 2"),
    "moved_columns": (moved_columns, """
        WITH r AS (SELECT l_orderkey AS page, list_sort(list(DISTINCT (l_partkey * 7 % 100 * 10)::DOUBLE)) AS x, list_sort(list(DISTINCT (l_suppkey * 13 % 50 * 20)::DOUBLE)) AS y FROM lineitem GROUP BY 1),
        n AS (SELECT page, x AS ox, y AS oy, CASE WHEN page % 3 = 0 AND len(x) >= 2 THEN list_sort(list_append(x, (x[1] + x[2]) / 2)) WHEN page % 3 = 1 THEN list_concat(x[1:1], x[3:]) ELSE x END AS nx, CASE WHEN page % 3 = 0 AND len(y) >= 2 THEN list_sort(list_append(y, (y[1] + y[2]) / 2)) WHEN page % 3 = 1 THEN list_concat(y[1:1], y[3:]) ELSE y END AS ny FROM r),
        c AS (SELECT l_orderkey AS page, l_linenumber AS ord, max(l_partkey) % 3 AS i, max(l_partkey) % 2 AS j FROM lineitem GROUP BY 1, 2),
        d AS (SELECT *, list_transform(nx, lambda v: abs(v - ox[i + 1])) AS dx, list_transform(ny, lambda v: abs(v - oy[j + 1])) AS dy FROM c JOIN n USING (page)),
        k AS (SELECT *, (CASE WHEN i < len(ox) THEN list_position(dx, list_min(dx)) - 1 ELSE least(i, len(nx) - 1) END)::INT AS ix, (CASE WHEN j < len(oy) THEN list_position(dy, list_min(dy)) - 1 ELSE least(j, len(ny) - 1) END)::INT AS iy FROM d)
        SELECT page, ord, ix, iy, nx[ix + 1] AS x_mm, ny[iy + 1] AS y_mm, coalesce(nx[ix + 1] = ox[i + 1] AND ny[iy + 1] = oy[j + 1], false) AS kept FROM k"""),
    "sparse_analysis": (sparse_analysis, f"""
        WITH r AS (SELECT l_orderkey AS page, list_sort(list(DISTINCT (l_partkey * 7 % 100 * 10)::DOUBLE)) AS x, list_sort(list(DISTINCT (l_suppkey * 13 % 50 * 20)::DOUBLE)) AS y, CASE WHEN l_orderkey % 4 > 0 THEN l_orderkey % 7 + 0.5::DOUBLE END AS f FROM lineitem GROUP BY 1, 4),
        s AS (SELECT page, CASE WHEN f IS NULL THEN list_transform(range(len(x)), lambda i: i::DOUBLE) ELSE list_transform(x, lambda v: round(v * f, 1)) END AS x, CASE WHEN f IS NULL THEN list_transform(range(len(y)), lambda i: i::DOUBLE) ELSE list_transform(y, lambda v: round(v * f, 1)) END AS y FROM r),
        o AS (SELECT page, CASE WHEN x[1] > 1 THEN list_transform(x, lambda v: round(v - x[1], 1)) ELSE x END AS x, CASE WHEN y[1] > 1 THEN list_transform(y, lambda v: round(v - y[1], 1)) ELSE y END AS y FROM s)
        SELECT page, {_TEXT("x")} AS x_text, {_TEXT("y")} AS y_text FROM o"""),
}
