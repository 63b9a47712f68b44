"""Queries over regions of pages: order lines read as strokes and dimension rows, events as clicks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import grid, region
from ferrolith.sources import bindings


def _lines(spark, sf_dir):
    axis = F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise("y")
    return bindings.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), axis.alias("axis"), F.col("l_linenumber").alias("ord"), (F.col("l_extendedprice").cast("double") / 100).alias("p"), F.col("l_quantity").cast("double").alias("q"), "l_partkey")


def _strokes(spark, sf_dir):
    """Lines of even number stand upright at their price, the others lie; their quantity is their length."""
    up, run = F.col("axis") == "x", F.col("q") * 10
    ends = lambda along: (F.when(along, F.col("p")).otherwise(0.0), F.when(along, F.col("p")).otherwise(run))
    (x1, x2), (y1, y2) = ends(up), ends(~up)
    return _lines(spark, sf_dir).select("page", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def _crops(spark, sf_dir):
    sides = {"cx0": 0.0, "cy0": 0.0, "cx1": 1000.0, "cy1": 1000.0, "mm_per_pt": 10.0, "width_px": 2000.0, "height_px": 2000.0}
    return bindings.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), *(F.lit(v).alias(k) for k, v in sides.items()))


def _vectors(spark, sf_dir):
    return region.vector_stations(_strokes(spark, sf_dir), _crops(spark, sf_dir), ["page"])


def _chains(spark, sf_dir, *by):
    """Quantities in order of their lines as dimension numbers; large ones out of any bay's range where per axis."""
    number = F.when((F.col("q") > 45) & F.lit("axis" in by), 30000.0).otherwise(F.col("q") * 100)
    return _lines(spark, sf_dir).groupBy("page", *by).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", number.alias("v")))), lambda x: x["v"]).alias("numbers"))


def crop_maps(spark, sf_dir):
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    rows = bindings.table(spark, sf_dir, "embeddings")
    rows = rows.withColumns(region.crop_bounds(e(0) / 2, e(1) / 2, e(2) / 2, e(3) / 2, F.lit(595.0), F.lit(842.0)) | {"share": F.col("embedding")[4].cast("double") * 4})
    point = region.to_point(F.col("share"), "cx0", "cx1")
    pixel = region.to_pixel(point, "cx0", "cx1", F.lit(800.0))
    return rows.select("vec_id", F.round("cx0", 6).alias("cx0"), F.round("cy1", 6).alias("cy1"), F.round(point, 6).alias("x"), F.round(region.to_share(point, "cx0", "cx1"), 6).alias("share"), F.round(pixel, 4).alias("pixel"))


def vector_stations(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("page", "axis", F.posexplode("stations").alias("idx", "mm"))
    return rows.withColumn("mm", F.round("mm", 4))


def sampled_lines(spark, sf_dir):
    return region.line_samples(_strokes(spark, sf_dir), _crops(spark, sf_dir), ["page"]).withColumn("line", F.round("line", 7))


def span_hint(spark, sf_dir):
    return bindings.table(spark, sf_dir, "documents").select("doc_id", region.span_hint(F.col("text")).alias("span_mm"))


def axis_candidates(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    places = lines.groupBy("page", "axis").agg(F.array_sort(F.collect_set(F.floor("p").cast("double") * 100)).alias("values"))
    # lines and bays are read once; every third page has its ends as lines too
    ends = F.when(F.col("page") % 3 == 0, F.array(F.lit(0.0), F.array_max("values")))
    kinds = [("line", 0, F.col("values")), ("line", 1, ends), ("bay", 2, F.col("numbers"))]
    found = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(o).alias("ord"), v.alias("values")) for k, o, v in kinds)), lambda c: c["values"].isNotNull())
    rows = places.join(_chains(spark, sf_dir), "page").select("page", "axis", F.inline(found))
    out = region.axis_candidates(rows, ["page", "axis"])
    return out.select("page", "axis", F.size("stations").alias("n_stations"), F.array_max("stations").alias("span"))


def region_grid(spark, sf_dir):
    rows = region.region_grid(_chains(spark, sf_dir, "axis"), _vectors(spark, sf_dir), ["page"])
    spans = (F.round(F.array_max(a), 4).alias(f"{a}_span") for a in "xy")
    return rows.select("page", F.size("x").alias("n_x"), F.size("y").alias("n_y"), *spans, "sources", F.round("confidence", 2).alias("confidence"))


def _merged(spark, sf_dir):
    """Detected axes against given ones: the ends alone, or for every fourth page all bays."""
    chain = grid.cumulated(F.col("numbers"))
    given = _chains(spark, sf_dir).select("page", F.when(F.col("page") % 4 == 0, chain).otherwise(F.array(F.lit(0.0), F.array_max(chain))).alias("given"))
    rows = _vectors(spark, sf_dir).join(given, "page")
    return rows.withColumn("chosen", region.preferred_axis(F.col("stations"), F.col("given")))


def merged_axes(spark, sf_dir):
    return _merged(spark, sf_dir).select("page", "axis", F.size("chosen").alias("n_stations"), F.round(F.array_max("chosen"), 4).alias("span"))


def merged_analysis(spark, sf_dir):
    rows = _merged(spark, sf_dir)
    of = lambda a, c: F.max(F.when(F.col("axis") == a, F.col(c)))
    pages = rows.groupBy("page").agg(of("x", "stations").alias("x"), of("y", "stations").alias("y"), F.max("given").alias("given_x"), F.max("given").alias("given_y"))
    out = region.merged_analysis(pages.withColumn("confidence", F.when(F.col("page") % 5 == 0, 0.3).otherwise(0.6)))
    return out.select("page", F.size("merged_x").alias("n_x"), F.size("merged_y").alias("n_y"), F.round(F.array_max("merged_x"), 4).alias("x_span"), F.round(F.array_max("merged_y"), 4).alias("y_span"))


def reindexed_cells(spark, sf_dir):
    cells = _lines(spark, sf_dir).select("page", "axis", (F.col("l_partkey") % 4).cast("int").alias("old_index")).distinct()
    rows = cells.join(_merged(spark, sf_dir), ["page", "axis"])
    return rows.select("page", "axis", "old_index", region.reindexed(F.col("old_index"), F.col("given"), F.col("chosen")).alias("new_index"))


def click_placements(spark, sf_dir):
    orders = bindings.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 2 == 0).alias("x"), (F.floor(F.col("o_totalprice").cast("double") / 500) * 20.0).alias("mm"))
    places = lambda c: F.array_union(F.array(F.lit(0.0)), F.array_sort(F.collect_set(F.when(c, F.col("mm")))))
    crops = orders.groupBy("page").agg(places(F.col("x")).alias("xs"), places(~F.col("x")).alias("ys"))
    own = F.col("page") % 2 == 0
    crops = crops.select("page", *(F.when(own, F.col(c)).alias(c) for c in ("xs", "ys")), F.lit(1000.0).alias("width_px"), F.lit(1000.0).alias("height_px"), F.when(F.col("page") % 3 > 0, 10.0).alias("mm_per_px"))
    clicks = bindings.table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("ord"), (F.floor(F.col("value") * 2) % 1000).cast("double").alias("x"), (F.minute("ts") * 16.0).alias("y"), F.lit(" ").alias("mark"))
    return region.click_placements(clicks, crops, ["page"]).select("page", "ord", "placement_id", "mark", "x_mm", "y_mm")


def crop_calibration(spark, sf_dir):
    o = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("double")
    rows = bindings.table(spark, sf_dir, "orders").select(
        o.alias("crop"), F.when(o % 7 > 0, F.array(F.lit(0.0), price)).alias("xs"), F.when(o % 5 > 0, F.array(F.lit(0.0), price / 4, price / 2)).alias("ys"), (o % 10 / 10).alias("confidence"), (o % 4 * 500).cast("double").alias("width_px"), F.lit(1000.0).alias("height_px"),
        F.lit(400.0).alias("clip_w"), F.lit(300.0).alias("clip_h"), F.when(o % 3 > 0, 25.0).alias("mm_per_pt"), F.when(o % 11 < 4, price / 900).alias("grid_mm_x"), (price / 700).alias("grid_mm_y"),
    )
    out = region.crop_calibration(rows)
    return out.select("crop", "source", *(F.round(c, 6).alias(c) for c in ("mm_per_px", "mm_per_px_x", "mm_per_px_y", "span_x", "span_y")))


def click_lines(spark, sf_dir):
    """Clicks on crops without stations, but with drawn lines every 101 or 132 pixels."""
    clicks = bindings.table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("ord"), (F.floor(F.col("value") * 2) % 1000).cast("double").alias("x"), (F.minute("ts") * 16.0).alias("y"), F.lit(" ").alias("mark"))
    lines = lambda step: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: i * step)
    none = F.lit(None).cast("array<double>")
    crops = clicks.select("page").distinct().select("page", none.alias("xs"), none.alias("ys"), F.lit(1000.0).alias("width_px"), F.lit(1000.0).alias("height_px"), F.when(F.col("page") % 3 > 0, 10.0).alias("mm_per_px"), F.concat(lines(F.lit(101.3)), F.array(F.lit(101.7))).alias("lines_x"), lines(F.lit(131.7)).alias("lines_y"))
    return region.click_placements(clicks, crops, ["page"]).select("page", "ord", "placement_id", "x_mm", "y_mm")


def member_ids(spark, sf_dir):
    rows = bindings.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("m"), F.col("l_partkey") % 3).alias("id"), (F.col("l_extendedprice").cast("double")).alias("x_mm"), F.col("l_quantity").cast("double").alias("y_mm"))
    rows = rows.groupBy("page", "ord").agg(F.min_by(F.struct("id", "x_mm", "y_mm"), F.struct("x_mm", "y_mm", "id")).alias("r")).select("page", "ord", "r.*")
    return region.unique_ids(rows, ["page"]).select("page", "ord", "member_id")


_S = """s AS (SELECT l_orderkey AS page, CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE 'y' END AS axis, l_linenumber AS ord, l_extendedprice::DOUBLE / 100 AS p, l_quantity::DOUBLE AS q, l_partkey FROM lineitem)"""
_V = f"""{_S}, at_ AS (SELECT page, axis, CASE axis WHEN 'x' THEN p ELSE 1000 - p END * 10 AS v FROM s WHERE p <= 1000 AND q >= 4),
g AS (SELECT *, coalesce((v - lag(v) OVER w > 35)::INT, 1) AS new FROM at_ WINDOW w AS (PARTITION BY page, axis ORDER BY v)), c AS (SELECT *, sum(new) OVER (PARTITION BY page, axis ORDER BY v, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g),
m AS (SELECT page, axis, k, avg(v) AS mm FROM c GROUP BY 1, 2, 3), l AS (SELECT page, axis, list(mm ORDER BY mm) AS l FROM m GROUP BY 1, 2), v AS (SELECT page, axis, CASE WHEN l[1] > 1 THEN list_prepend(0.0::DOUBLE, l) ELSE l END AS v FROM l),
d AS (SELECT page, axis, v, len(v) AS nv, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS b FROM v),
ok AS (SELECT *, nv BETWEEN 2 AND 32 AND len(list_filter(b, lambda x: x < 40 OR x > 25000)) <= greatest(1, floor(len(b) * 0.2)) AS valid FROM d)"""
_M = f"""{_V}, q AS (SELECT page, list(q * 100 ORDER BY ord, q) AS q FROM s GROUP BY 1), gv AS (SELECT page, list_prepend(0.0::DOUBLE, CASE WHEN page % 4 = 0 THEN list_transform(range(1, len(q) + 1), lambda i: list_sum(q[:i])) ELSE [list_sum(q)] END) AS given FROM q),
mg AS (SELECT page, axis, given, CASE WHEN valid AND nv > len(given) THEN v ELSE given END AS chosen FROM ok JOIN gv USING (page))"""

QUERIES = {
    "crop_maps": (crop_maps, """
        WITH e AS (SELECT vec_id, [abs(x::DOUBLE) FOR x IN embedding[1:4]] AS e, embedding[5]::DOUBLE * 4 AS s FROM embeddings),
        b AS (SELECT vec_id, e[1] / 2 * 595 AS x0, (e[1] / 2 + e[3] / 2) * 595 AS x1, (e[2] / 2 + e[4] / 2) * 842 AS y1, greatest(0, least(1, s)) AS s FROM e), p AS (SELECT *, x0 + s * (x1 - x0) AS x FROM b)
        SELECT vec_id, round(x0, 6) AS cx0, round(y1, 6) AS cy1, round(x, 6) AS x, round(CASE WHEN x1 > x0 THEN (x - x0) / (x1 - x0) ELSE 0 END, 6) AS share, round((x - x0) / greatest(x1 - x0, 1) * 800, 4) AS pixel FROM p"""),
    "vector_stations": (vector_stations, f"WITH {_V} SELECT page, axis, unnest(range(len(v)))::INT AS idx, round(unnest(v), 4) AS mm FROM v"),
    "sampled_lines": (sampled_lines, f"""
        WITH {_S}, e AS (SELECT page, axis, p / 1000 * 2000 AS v, q * 10 * CASE WHEN q >= 12 THEN 1 ELSE 0.6::DOUBLE END AS w FROM s WHERE p <= 1000 AND q >= 2),
        g AS (SELECT *, coalesce((v - lag(v) OVER (PARTITION BY page, axis ORDER BY v) > 8)::INT, 1) AS new FROM e), c AS (SELECT *, sum(new) OVER (PARTITION BY page, axis ORDER BY v, new DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g)
        SELECT page, axis, cluster, round(sum(v * w) / sum(w), 7) AS line FROM c GROUP BY 1, 2, 3"""),
    "span_hint": (span_hint, r"""SELECT doc_id, list_max(list_filter(list_transform(regexp_extract_all(text, '\b(\d{3,5})\b', 1), lambda x: x::DOUBLE), lambda v: v BETWEEN 500 AND 120000)) AS span_mm FROM documents"""),
    "axis_candidates": (axis_candidates, f"""
        WITH {_S}, c AS (SELECT page, axis, count(*) AS n, sum(v) AS total, max(v) AS top FROM (SELECT DISTINCT page, axis, floor(p) * 100 AS v FROM s) GROUP BY 1, 2), b AS (SELECT page, count(*) AS m, sum(q) * 100 AS t FROM s GROUP BY 1)
        SELECT page, axis, CASE WHEN n >= 2 THEN n + 1 WHEN m >= 2 THEN m + 1 WHEN page % 3 = 0 THEN 2 ELSE 0 END::INT AS n_stations,
          CASE WHEN n >= 2 THEN CASE WHEN page % 3 = 0 THEN top ELSE total END WHEN m >= 2 THEN t WHEN page % 3 = 0 THEN top END::DOUBLE AS span FROM c JOIN b USING (page)"""),
    "region_grid": (region_grid, f"""
        WITH {_V}, t AS (SELECT page, axis, count(*) AS n, sum(CASE WHEN q > 45 THEN 30000 ELSE q * 100 END) AS total, sum((q > 45)::INT) AS bad FROM s GROUP BY 1, 2),
        j AS (SELECT page, axis, coalesce(n >= 2, false) AS text, coalesce(n >= 2 AND bad <= greatest(1, floor(n * 0.2)), false) AS tv, n + 1 AS nt, total, coalesce(valid, false) AS vv, nv, v[-1] AS last FROM t FULL JOIN ok USING (page, axis)),
        f AS (SELECT *, CASE WHEN tv AND vv AND abs(last - total) < 500 AND nv > nt THEN nv WHEN tv THEN nt WHEN vv THEN nv ELSE 0 END AS n, CASE WHEN tv AND vv AND abs(last - total) < 500 AND nv > nt THEN last WHEN tv THEN total WHEN vv THEN last END AS span, text::INT + (vv AND nv >= 3)::INT AS seen FROM j),
        r AS (SELECT page, coalesce(max(n) FILTER (WHERE axis = 'x'), 0) AS n_x, coalesce(max(n) FILTER (WHERE axis = 'y'), 0) AS n_y, max(span) FILTER (WHERE axis = 'x') AS sx, max(span) FILTER (WHERE axis = 'y') AS sy, sum(seen)::BIGINT AS sources FROM f GROUP BY 1)
        SELECT page, n_x::INT AS n_x, n_y::INT AS n_y, round(sx, 4) AS x_span, round(sy, 4) AS y_span, sources,
          CASE WHEN n_x < 2 AND n_y < 2 THEN 0 ELSE round(least(0.95, 0.55 + 0.2 * (n_x >= 3)::INT + 0.2 * (n_y >= 3)::INT + 0.05 * sources)::DOUBLE, 2) END::DOUBLE AS confidence FROM r"""),
    "merged_axes": (merged_axes, f"WITH {_M} SELECT page, axis, len(chosen)::INT AS n_stations, round(list_max(chosen), 4) AS span FROM mg"),
    "merged_analysis": (merged_analysis, f"""
        WITH {_M}, p AS (SELECT page, any_value(given) AS given, list(v) FILTER (WHERE axis = 'x') AS x, list(v) FILTER (WHERE axis = 'y') AS y, list(chosen) FILTER (WHERE axis = 'x') AS cx, list(chosen) FILTER (WHERE axis = 'y') AS cy FROM ok JOIN mg USING (page, axis) GROUP BY 1),
        t AS (SELECT *, greatest(coalesce(len(x[1]), 0), coalesce(len(y[1]), 0)) AS n FROM p), u AS (SELECT *, n >= 2 AND (page % 5 > 0 OR n >= 3) AS trusted FROM t),
        z AS (SELECT page, CASE WHEN trusted THEN coalesce(cx[1], given) ELSE given END AS mx, CASE WHEN trusted THEN coalesce(cy[1], given) ELSE given END AS my FROM u)
        SELECT page, len(mx)::INT AS n_x, len(my)::INT AS n_y, round(list_max(mx), 4) AS x_span, round(list_max(my), 4) AS y_span FROM z"""),
    "reindexed_cells": (reindexed_cells, f"""
        WITH {_M}, i AS (SELECT DISTINCT page, axis, (l_partkey % 4)::INT AS old_index FROM s), n AS (SELECT *, list_transform(chosen, lambda x: abs(x - given[old_index + 1])) AS far FROM i JOIN mg USING (page, axis))
        SELECT page, axis, old_index, CASE WHEN old_index < len(given) THEN list_position(far, list_min(far)) - 1 ELSE least(old_index, len(chosen) - 1) END::INT AS new_index FROM n"""),
    "click_placements": (click_placements, """
        WITH o AS (SELECT DISTINCT o_custkey AS page, o_orderkey % 2 = 0 AS x, floor(o_totalprice::DOUBLE / 500) * 20 AS mm FROM orders),
        k AS (SELECT page, list_prepend(0.0::DOUBLE, coalesce(list(mm ORDER BY mm) FILTER (WHERE x), [])) AS xs, list_prepend(0.0::DOUBLE, coalesce(list(mm ORDER BY mm) FILTER (WHERE NOT x), [])) AS ys FROM o GROUP BY 1),
        e AS (SELECT user_id AS page, event_id AS ord, floor(value * 2)::BIGINT % 1000 AS x, minute(ts) * 16 AS y FROM events),
        p AS (SELECT e.*, xs, ys, page % 2 = 0 AND len(xs) >= 2 AND len(ys) >= 2 AS given, page % 3 > 0 AS scaled FROM e JOIN k USING (page)),
        u AS (SELECT page, ord, 'x' AS a, x AS v FROM p WHERE NOT given UNION ALL SELECT page, ord, 'y', y FROM p WHERE NOT given),
        g AS (SELECT *, coalesce((v - lag(v) OVER (PARTITION BY page, a ORDER BY v) > 22)::INT, 1) AS new FROM u), c AS (SELECT *, sum(new) OVER (PARTITION BY page, a ORDER BY v, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g),
        z AS (SELECT page, a, list(m ORDER BY m) AS l FROM (SELECT page, a, k, avg(v) AS m FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2),
        w AS (SELECT p.*, x.l AS px, y.l AS py FROM p LEFT JOIN z x ON x.page = p.page AND x.a = 'x' AND NOT given LEFT JOIN z y ON y.page = p.page AND y.a = 'y' AND NOT given),
        r AS (SELECT *, CASE WHEN given THEN xs[-1] WHEN scaled THEN round((px[-1] - px[1]) * 10, 1) ELSE len(px) - 1 END / 1000 AS mx, CASE WHEN given THEN ys[-1] WHEN scaled THEN round((py[-1] - py[1]) * 10, 1) ELSE len(py) - 1 END / 1000 AS my,
          CASE WHEN given THEN xs ELSE px END AS sx, CASE WHEN given THEN ys ELSE py END AS sy FROM w WHERE given OR (len(px) >= 2 AND len(py) >= 2)),
        f AS (SELECT *, list_transform(sx, lambda s: abs(s - CASE WHEN given THEN x * mx ELSE x END)) AS dx, list_transform(sy, lambda s: abs(s - CASE WHEN given THEN ys[-1] - y * my ELSE y END)) AS dy FROM r),
        n AS (SELECT *, list_position(dx, list_min(dx)) AS ix, list_position(dy, list_min(dy)) AS iy FROM f)
        SELECT page, ord, CASE WHEN given THEN 'col_' || (ix - 1) || '_' || (iy - 1) ELSE 'col_' || ord END AS placement_id, 'C' || (ord + 1) AS mark, round(CASE WHEN given THEN xs[ix] ELSE px[ix] * mx END, 1) AS x_mm, round(CASE WHEN given THEN ys[iy] ELSE (1000 - py[iy]) * my END, 1) AS y_mm FROM n"""),
    "crop_calibration": (crop_calibration, """
        WITH o AS (SELECT o_orderkey AS crop, o_totalprice::DOUBLE AS p, o_orderkey % 10 >= 3 AS sure, o_orderkey % 4 * 500 AS w, o_orderkey % 7 > 0 AS hx, o_orderkey % 5 > 0 AS hy, o_orderkey % 3 > 0 AS pt, o_orderkey % 11 < 4 AS lab FROM orders),
        r AS (SELECT *, CASE WHEN sure AND hx THEN p END AS span_x, CASE WHEN sure AND hy THEN p / 2 END AS span_y, CASE WHEN sure AND hx AND hy AND lab THEN p / 900 END AS l, CASE WHEN sure AND pt AND w > 0 THEN 10000.0::DOUBLE / w END AS d FROM o),
        f AS (SELECT *, CASE WHEN w > 0 THEN span_x / w END AS x FROM r)
        SELECT crop, CASE WHEN l IS NOT NULL THEN 'labels' WHEN x IS NOT NULL AND span_y IS NOT NULL THEN 'stations' WHEN x IS NOT NULL THEN 'stations_x' WHEN span_y IS NOT NULL AND d IS NOT NULL THEN 'stations_y' WHEN d IS NOT NULL THEN 'line_work' ELSE 'none' END AS source,
          round(coalesce(x, d, l), 6) AS mm_per_px, round(l, 6) AS mm_per_px_x, round(CASE WHEN l IS NOT NULL THEN p / 700 END, 6) AS mm_per_px_y, round(span_x, 6) AS span_x, round(span_y, 6) AS span_y FROM f"""),
    "click_lines": (click_lines, """
        WITH e AS (SELECT user_id AS page, event_id AS ord, floor(value * 2)::BIGINT % 1000 AS x, minute(ts) * 16 AS y, user_id % 3 > 0 AS scaled FROM events),
        u AS (SELECT page, 'x' AS a, x AS v FROM e UNION ALL SELECT page, 'y', y FROM e), g AS (SELECT *, coalesce((v - lag(v) OVER (PARTITION BY page, a ORDER BY v) > 22)::INT, 1) AS new FROM u),
        c AS (SELECT *, sum(new) OVER (PARTITION BY page, a ORDER BY v, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g), z AS (SELECT page, a, list(m ORDER BY m) AS l FROM (SELECT page, a, k, avg(v) AS m FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2),
        w AS (SELECT e.*, zx.l AS px, zy.l AS py, range(9).list_transform(lambda i: i * 101.3::DOUBLE) AS qx, range(9).list_transform(lambda i: i * 131.7::DOUBLE) AS qy FROM e JOIN z zx ON zx.page = e.page AND zx.a = 'x' JOIN z zy ON zy.page = e.page AND zy.a = 'y' WHERE len(zx.l) >= 2 AND len(zy.l) >= 2),
        m AS (SELECT *, CASE WHEN scaled THEN round((px[-1] - px[1]) * 10, 1) ELSE len(px) - 1 END / 1000 AS mx, CASE WHEN scaled THEN round((py[-1] - py[1]) * 10, 1) ELSE len(py) - 1 END / 1000 AS my, list_transform(qx, lambda s: abs(s - x)) AS dx, list_transform(qy, lambda s: abs(s - y)) AS dy FROM w)
        SELECT page, ord, 'col_' || ord AS placement_id, round(qx[list_position(dx, list_min(dx))] * mx, 1) AS x_mm, round((1000 - qy[list_position(dy, list_min(dy))]) * my, 1) AS y_mm FROM m"""),
    "member_ids": (member_ids, """
        WITH r AS (SELECT l_orderkey AS page, l_linenumber AS ord, min_by({'id': 'm' || (l_partkey % 3), 'x': l_extendedprice::DOUBLE, 'y': l_quantity::DOUBLE}, (l_extendedprice::DOUBLE, l_quantity::DOUBLE, 'm' || (l_partkey % 3))) AS r FROM lineitem GROUP BY 1, 2),
        n AS (SELECT page, ord, r.id AS id, trunc(r.x)::BIGINT AS x, trunc(r.y)::BIGINT AS y, row_number() OVER (PARTITION BY page, r.id ORDER BY ord) AS n FROM r)
        SELECT page, ord, CASE n WHEN 1 THEN id WHEN 2 THEN id || '_' || x || '_' || y ELSE id || '_' || (n - 1) END AS member_id FROM n"""),
}
