"""Queries over drawing primitives and grids, bound to embeddings, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import drawing, grid
from ferrolith.sources import bindings

_SEG = """seg AS (
  SELECT label AS doc_id, (vec_id % 3)::INT AS page_index, vec_id AS seq, embedding[1]::DOUBLE * 4000 AS x1, embedding[2]::DOUBLE * 4000 AS y1,
         embedding[3]::DOUBLE * 4000 AS x2, embedding[4]::DOUBLE * 4000 AS y2, abs(embedding[5]::DOUBLE) * 4 AS stroke FROM embeddings),
len AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS n FROM seg)"""


def segments(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    return bindings.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("doc_id"), (F.col("vec_id") % 3).cast("int").alias("page_index"), F.col("vec_id").alias("seq"), (e(0) * 4000).alias("x1"), (e(1) * 4000).alias("y1"),
        (e(2) * 4000).alias("x2"), (e(3) * 4000).alias("y2"), (F.abs(e(4)) * 4).alias("stroke"),
    )


def _round(df, n, *cols):
    return df.withColumns({c: F.round(c, n) for c in cols})


def segment_explode(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    point = lambda i: F.struct(e(2 * i).alias("x"), e(2 * i + 1).alias("y"))
    kind = F.element_at(F.array(F.lit("l"), F.lit("re"), F.lit("qu"), F.lit("c")), (F.col("vec_id") % 4 + 1).cast("int"))
    items = bindings.table(spark, sf_dir, "embeddings").select("vec_id", kind.alias("kind"), F.array(*(point(i) for i in range(4))).alias("pts"))
    return drawing.explode_items(items).select("vec_id", "kind", "part", "x1", "y1", "x2", "y2")


def line_items(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("l"), F.lit("re"), F.lit("qu"), F.lit("c")), (F.col("vec_id") % 4 + 1).cast("int"))
    items = bindings.table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), kind.alias("kind"))
    return drawing.line_items(items, "doc_id")


def page_score(spark, sf_dir):
    return _round(drawing.page_scores(segments(spark, sf_dir), "strict"), 6, "total_length")


def primary_page(spark, sf_dir):
    return drawing.primary_page(drawing.page_scores(segments(spark, sf_dir)))


def inferred_scale(spark, sf_dir):
    return _round(drawing.inferred_scale(segments(spark, sf_dir)), 6, "median_length", "span", "mm_per_unit")


def percentile_bounds(spark, sf_dir):
    return drawing.percentile_bounds(segments(spark, sf_dir))


def merge_intervals(spark, sf_dir):
    return drawing.merge_intervals(segments(spark, sf_dir), 100.0)


def dedupe_longest(spark, sf_dir):
    return drawing.dedupe_longest(segments(spark, sf_dir), 1500.0)


def topk_longest(spark, sf_dir):
    return drawing.top_longest(segments(spark, sf_dir), 10).select("doc_id", "page_index", "place", "seq")


def stroke_threshold(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("page_index", F.lit(0))
    return drawing.stroke_threshold(rows)


def extraction_route(spark, sf_dir):
    docs = bindings.table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"))
    return docs.select("doc_id", F.array_join(drawing.route(F.col("doc_id") % 400, F.col("chars")), ">").alias("route"))


def ingest_report(spark, sf_dir):
    pages = bindings.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), "text", F.length("text").alias("n_lines"), (F.col("turn") * 100).alias("n_paths")
    )
    return drawing.ingest_report(pages, 300).withColumn("warnings", F.array_join("warnings", ","))


def vector_model(spark, sf_dir):
    return drawing.vector_model(segments(spark, sf_dir))


def sheets(spark, sf_dir):
    """Sheets of 120 segments on three pages, drawn in millimetres, points or metres; every fifth one thick."""
    i = F.col("vec_id")
    e = lambda k: F.col("embedding")[k].cast("double")
    unit = F.element_at(F.array(*map(F.lit, (4000.0, 300.0, 1.5, 900.0))), (F.floor(i / 120) % 4 + 1).cast("int"))
    flat = F.when(i % 4 == 1, e(1)).otherwise(e(3))
    stroke = F.when(i % 5 == 0, 2.0).otherwise(F.abs(e(4)))
    return bindings.table(spark, sf_dir, "embeddings").select(F.floor(i / 120).alias("doc_id"), (i % 3).cast("int").alias("page_index"), i.alias("seq"), (e(0) * unit).alias("x1"), (e(1) * unit).alias("y1"), (e(2) * unit).alias("x2"), (flat * unit).alias("y2"), stroke.alias("stroke"))


def page_settings(spark, sf_dir):
    rows = sheets(spark, sf_dir)
    notes = rows.select("doc_id").distinct().where("doc_id % 6 = 5").withColumn("note", F.lit("grid = 500"))
    out = drawing.page_settings(rows, notes)
    return out.select("doc_id", "page_index", F.size("scales").alias("n_scales"), F.round(F.col("scales")[0], 6).alias("scale"), F.round("threshold", 6).alias("threshold"))


def first_attempt(spark, sf_dir):
    rows = sheets(spark, sf_dir)
    out = drawing.first_attempt(rows, drawing.page_settings(rows))
    return _round(out, 6, "scale", "stroke")


def merged_submodels(spark, sf_dir):
    """Four crops of a page see the same members, each from its own corner and a few millimetres off."""
    i = F.col("vec_id")
    e = lambda k: F.floor(F.col("embedding")[k].cast("double") * 40) * 250.0
    crop = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("crop")
    rows = bindings.table(spark, sf_dir, "embeddings").select(F.floor(i / 100).alias("doc_id"), (i % 2).cast("int").alias("page_index"), i, "embedding", crop).where("(vec_id + crop) % 3 > 0")
    near, turn = F.col("crop") * 20.0 - 30, (i + F.col("crop")) % 2 == 0
    ends = {f"{p}{a}": e(k + (3 if (p == "e") else 0)) + near for p in "se" for k, a in enumerate("xyz")}
    shift = {"x": F.when(F.col("crop") > 0, F.col("crop") * 100.0 * 2).otherwise(0.0), "y": F.when(F.col("crop") > 0, (842.0 - 500 - F.col("crop") * 10) * 2).otherwise(0.0), "z": F.lit(0.0)}
    flipped = {f"{p}{a}": F.when(turn, ends[f"{q}{a}"]).otherwise(ends[f"{p}{a}"]) - shift[a] for p, q in (("s", "e"), ("e", "s")) for a in "xyz"}
    members = rows.select("doc_id", "page_index", F.when(F.col("crop") == 0, "full").otherwise(F.concat(F.lit("q"), "crop")).alias("crop_id"), (i * 4 + F.col("crop")).alias("seq"), *(c.alias(n) for n, c in flipped.items()))
    crops = members.select("doc_id", "page_index", "crop_id").distinct().withColumn("k", F.coalesce(F.regexp_extract("crop_id", r"q(\d)", 1).try_cast("int"), F.lit(0)))
    crops = crops.select("doc_id", "page_index", "crop_id", (F.col("k") * 100.0).alias("x0"), (500.0 + F.col("k") * 10).alias("y1"), F.lit(842.0).alias("page_height"), F.lit(2.0).alias("mm_per_pt"))
    out = drawing.merged_submodels(members, crops, 250.0)
    return _round(out.select("doc_id", "page_index", "seq", "n_same", *drawing.ENDS), 6, *drawing.ENDS)


def _prices(spark, sf_dir):
    return bindings.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_totalprice").cast("double").alias("v"), F.col("o_orderkey").alias("seq"))


def cluster_1d(spark, sf_dir):
    return _round(grid.cluster_1d(_prices(spark, sf_dir), ["page"], "v", 20000.0), 4, "line")


def cluster_weighted(spark, sf_dir):
    rows = _prices(spark, sf_dir).withColumn("w", (F.col("seq") % 7).cast("double"))
    return _round(grid.cluster_weighted(rows, ["page"], "v", "w", 20000.0), 7, "line")


def _lines(spark, sf_dir):
    axis = F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("y")
    return bindings.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), axis.alias("axis"), (F.col("o_totalprice").cast("double") / 500).alias("line"))


def grid_quality(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    crops = lines.select("page").distinct().select("page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1000.0).alias("x1"), F.lit(1000.0).alias("y1"))
    return grid.quality(lines, crops, ["page"]).withColumn("reasons", F.array_join("reasons", ","))


def snap_pins(spark, sf_dir):
    pins = bindings.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("page"), F.col("value").alias("x"), (F.minute("ts") * 16.0).alias("y"), F.col("event_id").alias("ord"), F.lit(None).cast("string").alias("mark")
    )
    return grid.snap_pins(pins, _lines(spark, sf_dir), ["page"]).select("event_id", "mark", "x_line", "y_line", "x_index", "y_index")


def dim_numbers(spark, sf_dir):
    docs = bindings.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(grid.numbers(F.col("text"))).alias("pos", "value"))


def _spans(spark, sf_dir):
    at = F.col("embedding")
    return bindings.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("page"), F.col("vec_id").alias("seq"), ((at[0].cast("double") + 1) * 500).alias("x0"), ((at[0].cast("double") + 1) * 500).alias("x1"),
        ((at[1].cast("double") * 2 + 1) * 500).alias("y0"), ((at[1].cast("double") * 2 + 1) * 500).alias("y1"), F.concat(F.lit("bay "), F.col("vec_id") % 37 * 100 + 900, F.lit(" mm")).alias("text"),
        F.lit(250.0).alias("cx0"), F.lit(0.0).alias("cy0"), F.lit(750.0).alias("cx1"), F.lit(1000.0).alias("cy1"),
    )


def edge_numbers(spark, sf_dir):
    rows = grid.edge_numbers(_spans(spark, sf_dir), ["page"])
    return rows.select("page", "edge", F.array_join(F.transform("numbers", lambda v: v.cast("long").cast("string")), ",").alias("numbers"))


def primary_row(spark, sf_dir):
    rows = grid.primary_row(_spans(spark, sf_dir), ["page"], share=0.4)
    stations = grid.chain_stations(F.col("numbers"))
    return rows.select("page", F.size("numbers").alias("n_numbers"), F.size(stations).alias("n_stations"), F.round(F.array_max(stations), 1).alias("span"), grid.valid_chain(stations).alias("valid"))


def bays_stations(spark, sf_dir):
    rows = _prices(spark, sf_dir).groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "v"))), lambda x: F.floor(x["v"] / 100).cast("double")).alias("bays"))
    s = grid.cumulated(F.col("bays"))
    return rows.select("page", F.size(s).alias("n_stations"), F.array_max(s).alias("span"), F.array_max(grid.widths(s)).alias("widest"))


def min_gap_fold(spark, sf_dir):
    rows = _prices(spark, sf_dir).groupBy("page").agg(F.collect_list("v").alias("v"))
    kept = grid.min_gap_fold(F.col("v"), 40000.0)
    return rows.select("page", F.size(kept).alias("n_kept"), F.round(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


def label_snap(spark, sf_dir):
    rows = _lines(spark, sf_dir).groupBy("page").agg(
        F.sort_array(F.collect_list(F.when(F.col("axis") == "x", F.col("line")))).alias("labels"), F.sort_array(F.collect_list(F.when(F.col("axis") == "y", F.col("line")))).alias("vectors")
    )
    out = grid.snap_labels(F.col("labels"), F.col("vectors"), 60.0)
    return rows.select("page", F.size(out).alias("n_lines"), F.size(F.array_intersect(out, F.col("vectors"))).alias("n_snapped"))


def nearest_vertex(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    points = bindings.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("page"), (F.col("value") * 10 % 600).alias("x"), (F.minute("ts") * 10.0).alias("y"))
    rows = grid.nearest_vertex(points, grid.vertices(lines, ["page"]), ["page"], 40.0)
    return rows.select("event_id", "ix", "iy", F.round("d2", 6).alias("d2"))


def _stations(spark, sf_dir):
    rows = bindings.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise("y").alias("axis"), F.floor("l_extendedprice").cast("double").alias("mm")
    ).distinct()
    return rows.selectExpr("*", "row_number() OVER (PARTITION BY page, axis ORDER BY mm) - 1 AS idx")


def dense_columns(spark, sf_dir):
    return grid.column_placements(_stations(spark, sf_dir), ["page"]).select("page", "ix", "iy", "x", "y", "mark")


def sparse_columns(spark, sf_dir):
    cells = bindings.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 3).cast("int").alias("ix"), (F.col("l_suppkey") % 3).cast("int").alias("iy"), F.col("l_partkey").alias("ord")
    )
    return grid.sparse_placements(cells, _stations(spark, sf_dir), ["page"]).select("page", "ix", "iy", "x", "y", "ord")


_Q = "round_even({} / 1500.0, 0) * 1500.0"
_KEY = f"""key AS (SELECT *, CASE WHEN (ax, ay) <= (bx, by_) THEN [ax, ay, bx, by_] ELSE [bx, by_, ax, ay] END AS k FROM (
  SELECT *, {_Q.format("x1")} AS ax, {_Q.format("y1")} AS ay, {_Q.format("x2")} AS bx, {_Q.format("y2")} AS by_ FROM seg))"""
_ST = """st AS (SELECT *, row_number() OVER (PARTITION BY page, axis ORDER BY mm) - 1 AS idx FROM (
  SELECT DISTINCT l_orderkey AS page, CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE 'y' END AS axis, floor(l_extendedprice)::DOUBLE AS mm FROM lineitem))"""
_LINE = "line AS (SELECT o_custkey AS page, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'y' END AS axis, o_totalprice::DOUBLE / 500 AS line FROM orders)"
_SPAN = """span AS (SELECT label AS page, vec_id AS seq, (embedding[1]::DOUBLE + 1) * 500 AS x, (embedding[2]::DOUBLE * 2 + 1) * 500 AS y, (vec_id % 37 * 100 + 900)::BIGINT AS v FROM embeddings)"""

_SHEETS = """sh AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS n, n > 1e-9 AND greatest(abs(x2 - x1), abs(y2 - y1)) / n >= cos(radians(88)) AS straight FROM (
  SELECT vec_id // 120 AS doc_id, (vec_id % 3)::INT AS page_index, e[1]::DOUBLE * u AS x1, e[2]::DOUBLE * u AS y1, e[3]::DOUBLE * u AS x2, CASE WHEN vec_id % 4 = 1 THEN e[2]::DOUBLE ELSE e[4]::DOUBLE END * u AS y2, CASE WHEN vec_id % 5 = 0 THEN 2.0::DOUBLE ELSE abs(e[5]::DOUBLE) END AS stroke
  FROM (SELECT vec_id, embedding AS e, [4000.0::DOUBLE, 300, 1.5, 900][vec_id // 120 % 4 + 1] AS u FROM embeddings))),
pg AS (SELECT doc_id, page_index, list(n ORDER BY n) FILTER (WHERE n > 1e-6) AS ns, max(greatest(x1, x2, y1, y2)) - min(least(x1, x2, y1, y2)) AS span, list(stroke ORDER BY stroke) FILTER (WHERE stroke > 0.05) AS w FROM sh GROUP BY 1, 2),
sc AS (SELECT *, ns[len(ns) // 2 + 1] AS med, CASE WHEN len(w) < 30 THEN 0 ELSE greatest(0, least(w[len(w) // 2 + 1], w[floor(len(w) * 0.72)::INT + 1] * 0.85)) END AS threshold FROM pg),
page AS (SELECT doc_id, page_index, threshold, CASE WHEN med > 12000 THEN [25.4::DOUBLE / 72, 1.0] WHEN span > 4000 OR med > 400 THEN [1.0::DOUBLE, 25.4::DOUBLE / 72] WHEN span < 80 THEN [1000.0::DOUBLE, 1.0, 25.4::DOUBLE / 72] ELSE [25.4::DOUBLE / 72, 1.0] END AS scales FROM sc)"""

QUERIES = {
    "segment_explode": (segment_explode, """
        WITH i AS (SELECT vec_id, vec_id % 4 AS k, [e::DOUBLE FOR e IN embedding[1:8]] AS e FROM embeddings),
        r AS (SELECT vec_id, CASE k WHEN 0 THEN 'l' WHEN 1 THEN 're' ELSE 'qu' END AS kind, CASE k
          WHEN 0 THEN [[e[1], e[2], e[3], e[4]]]
          WHEN 1 THEN [[e[1], e[2], e[3], e[2]], [e[3], e[2], e[3], e[4]], [e[3], e[4], e[1], e[4]], [e[1], e[4], e[1], e[2]]]
          ELSE [[e[1], e[2], e[3], e[4]], [e[3], e[4], e[7], e[8]], [e[7], e[8], e[5], e[6]], [e[5], e[6], e[1], e[2]]] END AS p FROM i WHERE k < 3),
        u AS (SELECT vec_id, kind, unnest(range(len(p)))::INT AS part, p FROM r)
        SELECT vec_id, kind, part, p[part + 1][1] AS x1, p[part + 1][2] AS y1, p[part + 1][3] AS x2, p[part + 1][4] AS y2 FROM u"""),
    "line_items": (line_items, "SELECT label AS doc_id, sum(CASE vec_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 ELSE 4 END)::BIGINT AS n_lines FROM embeddings GROUP BY 1"),
    "page_score": (page_score, f"""
        WITH {_SEG}, ok AS (SELECT *, n BETWEEN 150 AND 25000 AND greatest(abs(x2 - x1), abs(y2 - y1)) / n >= cos(radians(2)) AS ok FROM len)
        SELECT doc_id, page_index, sum(ok::INT)::BIGINT AS n_structural, round(coalesce(sum(n) FILTER (WHERE ok), 0), 6) AS total_length FROM ok GROUP BY 1, 2"""),
    "primary_page": (primary_page, f"""
        WITH {_SEG}, s AS (SELECT doc_id, page_index, count(*) AS c, sum(n) AS t FROM len WHERE n BETWEEN 150 AND 25000 GROUP BY 1, 2)
        SELECT doc_id, page_index FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, t DESC, page_index) = 1"""),
    "inferred_scale": (inferred_scale, f"""
        WITH {_SEG}, p AS (SELECT doc_id, page_index, list_sort(list(n) FILTER (WHERE n > 1e-6)) AS l, max(greatest(x1, y1, x2, y2)) - min(least(x1, y1, x2, y2)) AS span FROM len GROUP BY 1, 2),
        m AS (SELECT *, coalesce(l[len(l) // 2 + 1], 0) AS m FROM p)
        SELECT doc_id, page_index, round(m, 6) AS median_length, round(span, 6) AS span,
          round(CASE WHEN m > 12000 THEN 25.4 / 72 WHEN span > 4000 OR m > 400 THEN 1 WHEN span < 80 THEN 1000 ELSE 25.4 / 72 END::DOUBLE, 6) AS mm_per_unit FROM m"""),
    "percentile_bounds": (percentile_bounds, f"""
        WITH {_SEG}, p AS (SELECT doc_id, page_index, list_sort(flatten(list([x1, x2]))) AS xs, list_sort(flatten(list([y1, y2]))) AS ys FROM seg GROUP BY 1, 2),
        i AS (SELECT *, round_even(0.03::DOUBLE * (len(xs) - 1), 0)::BIGINT + 1 AS lo, round_even(0.97::DOUBLE * (len(xs) - 1), 0)::BIGINT + 1 AS hi FROM p)
        SELECT doc_id, page_index, xs[lo] AS min_x, ys[lo] AS min_y, xs[hi] AS max_x, ys[hi] AS max_y FROM i"""),
    "merge_intervals": (merge_intervals, f"""
        WITH {_SEG}, h AS (SELECT *, abs(x2 - x1) >= abs(y2 - y1) AS horizontal FROM seg),
        r AS (SELECT doc_id, page_index, horizontal, round_even((CASE WHEN horizontal THEN y1 + y2 ELSE x1 + x2 END) / 2 / 100.0, 0)::BIGINT AS line,
          CASE WHEN horizontal THEN least(x1, x2) ELSE least(y1, y2) END AS a, CASE WHEN horizontal THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS b FROM h),
        g AS (SELECT *, coalesce((a > max(b) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100)::INT, 1) AS new FROM r WINDOW w AS (PARTITION BY doc_id, page_index, horizontal, line ORDER BY a, b)),
        i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_index, horizontal, line ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM g)
        SELECT doc_id, page_index, horizontal, line, min(a) AS a, max(b) AS b, count(*) AS n_merged FROM i GROUP BY doc_id, page_index, horizontal, line, island HAVING max(b) - min(a) >= 100"""),
    "dedupe_longest": (dedupe_longest, f"""
        WITH {_SEG}, {_KEY} SELECT doc_id, page_index, seq, x1, y1, x2, y2 FROM key
        QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, k ORDER BY (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) DESC, seq) = 1"""),
    "topk_longest": (topk_longest, f"""
        WITH {_SEG}, r AS (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY n DESC, seq)::INT AS place, seq FROM len) SELECT * FROM r WHERE place <= 10"""),
    "stroke_threshold": (stroke_threshold, f"""
        WITH {_SEG}, p AS (SELECT doc_id, list_sort(list(stroke) FILTER (WHERE stroke > 0.05)) AS w FROM seg GROUP BY 1)
        SELECT doc_id, 0 AS page_index, len(w)::INT AS n_widths, CASE WHEN len(w) < 30 THEN 0.0 ELSE greatest(0, least(w[len(w) // 2 + 1], w[floor(len(w) * 0.72::DOUBLE)::BIGINT + 1] * 0.85::DOUBLE)) END::DOUBLE AS threshold FROM p"""),
    "extraction_route": (extraction_route, "SELECT doc_id, CASE WHEN doc_id % 400 >= 200 THEN 'vector>vision' WHEN length(text) >= 200 THEN 'text>vision' ELSE 'vision' END AS route FROM documents"),
    "ingest_report": (ingest_report, """
        SELECT conv_id AS doc_id, count(*) AS n_pages, sum(greatest(length(text), turn * 100))::BIGINT AS drawing_ops, sum(length(text))::BIGINT AS text_chars,
          substr(string_agg(text, chr(10) ORDER BY turn, text), 1, 300) AS excerpt,
          concat_ws(',', CASE WHEN sum(greatest(length(text), turn * 100)) = 0 THEN 'no line work' END, CASE WHEN sum(length(text)) = 0 THEN 'no text' END) AS warnings FROM conversations GROUP BY 1"""),
    "vector_model": (vector_model, None),
    "page_settings": (page_settings, f"""WITH {_SHEETS} SELECT doc_id, page_index, len(scales)::INT AS n_scales, round(scales[1], 6) AS scale, round(threshold, 6) AS threshold FROM (
        SELECT doc_id, page_index, threshold, CASE WHEN doc_id % 6 = 5 THEN [1.0::DOUBLE, 25.4::DOUBLE / 72] ELSE scales END AS scales FROM page)"""),
    "first_attempt": (first_attempt, f"""WITH {_SHEETS}, a AS (SELECT i, i // 16 AS m, (i // 4) % 4 AS k, i % 4 AS w FROM (SELECT unnest(range(64)) AS i)),
        b AS (SELECT *, [600.0::DOUBLE, 350, 200, 150][m + 1] AS min_length, [1.0::DOUBLE, 0.5, 0, 0][w + 1] AS share, m < 3 AND w < 3 AS orthogonal FROM a),
        c AS (SELECT doc_id, page_index, i, min_length, share, orthogonal, scales[k + 1] AS scale, threshold * share AS stroke, count(*) AS n FROM sh JOIN page USING (doc_id, page_index), b
          WHERE n * scales[k + 1] >= min_length AND (share = 0 OR threshold <= 0 OR stroke >= threshold * share) AND (NOT b.orthogonal OR straight) GROUP BY ALL),
        s AS (SELECT doc_id, page_index, sum((straight AND n BETWEEN 150 AND 25000)::INT) AS score, coalesce(sum(n) FILTER (WHERE straight AND n BETWEEN 150 AND 25000), 0) AS total FROM sh GROUP BY 1, 2)
        SELECT doc_id, page_index, round(scale, 6) AS scale, min_length, round(stroke, 6) AS stroke, orthogonal, n FROM c JOIN s USING (doc_id, page_index) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, total DESC, page_index, i) = 1"""),
    "merged_submodels": (merged_submodels, """
        WITH v AS (SELECT vec_id, [floor(x::DOUBLE * 40) * 250 FOR x IN embedding[1:6]] AS e, unnest(range(4)) AS crop FROM embeddings),
        m AS (SELECT vec_id // 100 AS doc_id, (vec_id % 2)::INT AS page_index, vec_id * 4 + crop AS seq, [x + crop * 20.0 - 30 FOR x IN CASE WHEN (vec_id + crop) % 2 = 0 THEN list_concat(e[4:6], e[1:3]) ELSE e END] AS p FROM v WHERE (vec_id + crop) % 3 > 0),
        k AS (SELECT *, [round_even(x / 250, 0) FOR x IN p[1:3]] AS a, [round_even(x / 250, 0) FOR x IN p[4:6]] AS b, (p[4] - p[1]) ** 2 + (p[5] - p[2]) ** 2 + (p[6] - p[3]) ** 2 AS d FROM m),
        r AS (SELECT *, count(*) OVER w AS n_same, row_number() OVER (w ORDER BY round(d, 3) DESC, seq) AS place FROM k WINDOW w AS (PARTITION BY doc_id, page_index, least(a, b), greatest(a, b)))
        SELECT doc_id, page_index, seq, n_same, round(p[1], 6) AS sx, round(p[2], 6) AS sy, round(p[3], 6) AS sz, round(p[4], 6) AS ex, round(p[5], 6) AS ey, round(p[6], 6) AS ez FROM r WHERE place = 1"""),
    "cluster_1d": (cluster_1d, """
        WITH g AS (SELECT o_custkey AS page, o_totalprice::DOUBLE AS v, coalesce((v - lag(v) OVER (PARTITION BY page ORDER BY v) > 20000)::INT, 1) AS new FROM orders),
        c AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY v ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g)
        SELECT page, cluster, round(avg(v), 4) AS line, count(*) AS n FROM c GROUP BY 1, 2"""),
    "cluster_weighted": (cluster_weighted, """
        WITH g AS (SELECT o_custkey AS page, o_totalprice::DOUBLE AS v, (o_orderkey % 7)::DOUBLE AS w, coalesce((v - lag(v) OVER (PARTITION BY page ORDER BY v) > 20000)::INT, 1) AS new FROM orders),
        c AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY v ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g)
        SELECT page, cluster, round(sum(v * w) / CASE WHEN sum(w) = 0 THEN 1 ELSE sum(w) END, 7) AS line FROM c GROUP BY 1, 2"""),
    "grid_quality": (grid_quality, f"""
        WITH {_LINE}, g AS (SELECT *, lead(line) OVER (PARTITION BY page, axis ORDER BY line) - line AS gap FROM line),
        s AS (SELECT page, axis, count(*) AS n, sum((line <= 1000.0::DOUBLE * 0.04::DOUBLE OR line >= 1000 - 1000.0::DOUBLE * 0.04::DOUBLE)::INT) AS e, min(gap) AS g FROM g GROUP BY 1, 2),
        f AS (SELECT page, coalesce(max(n) FILTER (WHERE axis = 'x'), 0) AS nx, coalesce(max(n) FILTER (WHERE axis = 'y'), 0) AS ny, max(e) FILTER (WHERE axis = 'x') AS ex, max(e) FILTER (WHERE axis = 'y') AS ey,
          max(g) FILTER (WHERE axis = 'x') AS gx, max(g) FILTER (WHERE axis = 'y') AS gy FROM s GROUP BY 1),
        r AS (SELECT page, nx AS n_x, ny AS n_y, CASE WHEN nx < 2 OR ny < 2 THEN 'too_few_lines' WHEN nx > 20 OR ny > 20 THEN 'too_many_lines_x=' || nx || '_y=' || ny
          ELSE concat_ws(',', CASE WHEN ex / nx > 0.45 THEN 'x_lines_on_crop_edges' END, CASE WHEN ey / ny > 0.45 THEN 'y_lines_on_crop_edges' END,
            CASE WHEN gx < 1000 * 0.03 THEN 'x_lines_too_dense' END, CASE WHEN gy < 1000 * 0.03 THEN 'y_lines_too_dense' END) END AS reasons FROM f)
        SELECT *, reasons = '' AS accepted FROM r"""),
    "snap_pins": (snap_pins, f"""
        WITH {_LINE}, n AS (SELECT *, row_number() OVER (PARTITION BY page, axis ORDER BY line) - 1 AS i FROM line),
        p AS (SELECT event_id, user_id AS page, value AS x, minute(ts) * 16.0::DOUBLE AS y FROM events),
        a AS (SELECT event_id, min_by(line, (abs(line - x), i)) AS x_line, min_by(i, (abs(line - x), i)) AS x_index FROM p JOIN n USING (page) WHERE axis = 'x' GROUP BY 1),
        b AS (SELECT event_id, min_by(line, (abs(line - y), i)) AS y_line, min_by(i, (abs(line - y), i)) AS y_index FROM p JOIN n USING (page) WHERE axis = 'y' GROUP BY 1)
        SELECT event_id, 'C' || (event_id + 1) AS mark, x_line, y_line, x_index::INT AS x_index, y_index::INT AS y_index FROM a JOIN b USING (event_id)"""),
    "dim_numbers": (dim_numbers, r"""
        WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\b\d{2,5}(?:\.\d+)?\b'), lambda x: x::DOUBLE), lambda v: v BETWEEN 20 AND 120000) AS v FROM documents)
        SELECT doc_id, unnest(range(len(v)))::INT AS pos, unnest(v) AS value FROM d"""),
    "edge_numbers": (edge_numbers, f"""
        WITH {_SPAN}, e AS (
          SELECT page, seq, v, 'bottom' AS edge, x AS key FROM span WHERE y >= 1000 - 0.22 * 1000 UNION ALL SELECT page, seq, v, 'top', x FROM span WHERE y <= 0.22 * 1000
          UNION ALL SELECT page, seq, v, 'left', -y FROM span WHERE x <= 250 + 0.22 * 500 UNION ALL SELECT page, seq, v, 'right', -y FROM span WHERE x >= 750 - 0.22 * 500),
        f AS (SELECT page, edge, v, min((key, seq)) AS at_ FROM e GROUP BY 1, 2, 3)
        SELECT page, edge, string_agg(v::VARCHAR, ',' ORDER BY at_) AS numbers FROM f GROUP BY 1, 2"""),
    "primary_row": (primary_row, f"""
        WITH {_SPAN}, i AS (SELECT page, y, v FROM span WHERE y >= 1000 - 0.4 * 1000), o AS (SELECT page, max(y) AS outermost FROM i GROUP BY 1),
        k AS (SELECT page, count(*) AS n, sum(v) AS s FROM i JOIN o USING (page) WHERE y >= outermost - 0.4 * 1000 * 0.5 GROUP BY 1)
        SELECT page, n::INT AS n_numbers, CASE WHEN n < 2 THEN 0 ELSE n + 1 END::INT AS n_stations, CASE WHEN n >= 2 THEN s::DOUBLE END AS span, n BETWEEN 2 AND 31 AS valid FROM k"""),
    "bays_stations": (bays_stations, """
        WITH b AS (SELECT o_custkey AS page, floor(o_totalprice / 100)::DOUBLE AS b FROM orders WHERE floor(o_totalprice / 100) > 1)
        SELECT page, count(*)::INT + 1 AS n_stations, sum(b) AS span, max(b) AS widest FROM b GROUP BY 1"""),
    "min_gap_fold": (min_gap_fold, """
        WITH RECURSIVE v AS (SELECT o_custkey AS page, o_totalprice::DOUBLE AS v FROM orders),
        f AS (SELECT page, min(v) AS last FROM v GROUP BY 1 UNION ALL SELECT f.page, min(v.v) FROM f JOIN v ON f.page = v.page AND v.v - f.last > 40000 GROUP BY f.page, f.last)
        SELECT page, count(*)::INT AS n_kept, round(sum(last), 2) AS total FROM f GROUP BY 1"""),
    "label_snap": (label_snap, None),
    "nearest_vertex": (nearest_vertex, f"""
        WITH {_LINE}, n AS (SELECT *, row_number() OVER (PARTITION BY page, axis ORDER BY line) - 1 AS i FROM line),
        v AS (SELECT a.page, a.line AS vx, b.line AS vy, a.i AS ix, b.i AS iy FROM n a JOIN n b ON a.page = b.page AND a.axis = 'x' AND b.axis = 'y'),
        p AS (SELECT event_id, user_id AS page, value * 10 % 600 AS x, minute(ts) * 10.0::DOUBLE AS y FROM events),
        d AS (SELECT event_id, ix, iy, (vx - x) * (vx - x) + (vy - y) * (vy - y) AS d2 FROM p JOIN v USING (page))
        SELECT event_id, ix::INT AS ix, iy::INT AS iy, round(d2, 6) AS d2 FROM d WHERE d2 <= 1600 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d2, ix DESC, iy DESC) = 1"""),
    "dense_columns": (dense_columns, f"""
        WITH {_ST}, r AS (SELECT a.page, a.idx::INT AS ix, b.idx::INT AS iy, a.mm AS x, b.mm AS y FROM st a JOIN st b ON a.page = b.page AND a.axis = 'x' AND b.axis = 'y'),
        n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY iy, ix) AS n FROM r) SELECT page, ix, iy, x, y, 'C' || n AS mark FROM n WHERE n <= 400"""),
    "sparse_columns": (sparse_columns, f"""
        WITH {_ST}, c AS (SELECT l_orderkey AS page, (l_partkey % 3)::INT AS ix, (l_suppkey % 3)::INT AS iy, min(l_partkey) AS ord FROM lineitem GROUP BY 1, 2, 3)
        SELECT c.page, ix, iy, a.mm AS x, b.mm AS y, ord FROM c JOIN st a ON a.page = c.page AND a.axis = 'x' AND a.idx = ix JOIN st b ON b.page = c.page AND b.axis = 'y' AND b.idx = iy"""),
}
