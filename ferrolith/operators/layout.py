"""Layouts and reports of models: calibration, detected columns, supports, completeness, element checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import durable
from .grid import nearest_lines


def calibration(extents: DataFrame, pages: DataFrame, least: float = 3000.0) -> DataFrame:
    """Millimetres a point by page: the larger span of a model over the page's size; null for small spans."""
    span = F.greatest("span_x", "span_y")
    rows = extents.join(pages, ["doc_id", "page_index"])
    return rows.select("doc_id", "page_index", F.when(span >= least, span / F.greatest("width_pt", "height_pt")).alias("mm_per_pt"))


def merged_lines(sets: DataFrame, by: list[str], tol: float | Column, most: int = 48) -> DataFrame:
    """Line sets of several passes as one: clustered; where more than `most` remain, lines closer than 0.35 of the
    median gap to the last kept one are dropped."""
    from .grid import cluster_1d, min_gap_fold

    lists = cluster_1d(sets, by, "line", tol).groupBy(*by).agg(F.sort_array(F.collect_list("line")).alias("lines"))
    gaps = F.array_sort(F.zip_with(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0))), lambda b, a: b - a))
    median = F.coalesce(F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")), F.lit(0.0))
    # the one-element array binds the gap: inside the fold it would be computed again for every line
    thinned = F.transform(F.array(median * 0.35), lambda gap: F.slice(min_gap_fold(F.col("lines"), gap), 1, most))[0]
    kept = F.when(F.size("lines") > most, thinned).otherwise(F.col("lines"))
    return lists.select(*by, F.posexplode(kept).alias("idx", "line"))


def expanded_lines(lines: DataFrame, points: DataFrame, by: list[str], tol: float) -> DataFrame:
    """Lines and all points (column at) without a line within tol."""
    far = nearest_lines(points, lines, by, "at", "n").where(F.abs(F.col("n_line") - F.col("at")) > tol)
    without = points.join(lines.select(*by).distinct(), by, "left_anti")
    return lines.select(*by, "line").union(far.select(*by, F.col("at"))).union(without.select(*by, F.col("at")))


def column_marks(spans: DataFrame) -> DataFrame:
    """Middles of text spans that are column marks (C and a number)."""
    raw = F.upper(F.regexp_replace(F.trim("text"), " ", ""))
    return spans.withColumn("mark", raw).where(raw.rlike(r"^C\d+$")).withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2})


def detected_columns(marks: DataFrame, lines: DataFrame, by: list[str], tol: float) -> DataFrame:
    """Marks (mark, x, y, seq) at their nearest crossing within tol on both axes; one a cell, the first in order."""
    axis = lambda a: lines.where(F.col("axis") == a).select(*by, "line")
    rows = nearest_lines(nearest_lines(marks, axis("x"), by, "x", "x"), axis("y"), by, "y", "y")
    rows = rows.where((F.abs(F.col("x") - F.col("x_line")) <= tol) & (F.abs(F.col("y") - F.col("y_line")) <= tol))
    return rows.groupBy(*by, "x_index", "y_index").agg(F.min_by(F.struct("mark", "x_line", "y_line"), "seq").alias("m")).select(*by, "x_index", "y_index", "m.*")


def frequent_profile(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Most frequent token of a sheet, the first on ties: tokens (token, seq)."""
    n = tokens.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    return n.groupBy(*by).agg(F.max_by("token", F.struct("n", -F.col("first"))).alias("profile"))


def resolved_marks(columns: DataFrame, legend: DataFrame, defaults: DataFrame, by: list[str]) -> DataFrame:
    """Profiles of columns: their own, else the legend's for their mark, else the sheet's default."""
    named = legend.select(*by, F.upper("mark").alias("__m"), F.col("profile").alias("__legend"))
    rows = columns.withColumn("__m", F.upper("mark")).join(named, [*by, "__m"], "left").join(defaults.select(*by, F.col("profile").alias("__default")), by, "left")
    return rows.withColumn("profile", F.coalesce("profile", "__legend", "__default")).drop("__m", "__legend", "__default")


def frame_parameters(rows: DataFrame) -> DataFrame:
    """Bays and lengths of a frame out of what is given: count times bay before a length, defaults last."""
    bays = F.coalesce("bay_count_x", F.when(F.col("bay_x_mm") > 0, F.bround(F.col("length_x_mm") / F.col("bay_x_mm")).cast("int")), F.lit(1))
    bay = F.coalesce("bay_x_mm", F.when(bays > 0, F.col("length_x_mm") / bays), F.lit(6000.0))
    return rows.withColumns({"n_bays": F.greatest(bays, F.lit(1)), "bay_mm": bay}).withColumn("stations", F.transform(F.sequence(F.lit(0), F.col("n_bays")), lambda i: i * F.col("bay_mm")))


def completeness(reports: DataFrame) -> DataFrame:
    """Verdict and reason from method, members, slabs, drawing operations, text length and span."""
    n, ops, method = F.col("n_members"), F.col("drawing_ops"), F.col("method")
    reason = (
        F.when(method == "vector_pdf", F.when(n < 20, "few vector segments"))
        .when((method == "vision_llm") & (ops > 80) & (n < 5), "vision found few members").when((method == "vision_llm") & (ops > 80) & (n < 12), F.lit(None))
        .when((ops > 80) & (n < 12), "few members on a dense sheet").when((n <= 4) & (F.col("n_slabs") <= 1) & (F.col("span_mm") > 20_000), "a single simplified box")
        .when((F.col("text_chars") < 100) & (n < 10) & (method == "text_llm"), "text only")
    )
    return reports.withColumn("reason", reason).withColumn("complete", reason.isNull())


def place_supports(nodes: DataFrame, supports: DataFrame, span_x: str = "span_x", span_y: str = "span_y", max_rounds: int = 50) -> DataFrame:
    """Columns on their grid crossings and beams between their first and last support, level by level.

    nodes: model_id, node_id, kind, height, row, col, span_x, span_y; supports: model_id, beam_id, support_id, ord.
    A beam is placed once both end supports are, between their farthest points; a beam of one support spans that
    support's own farthest points; beams without a span, and beams on supports that never appear, are left out.
    """
    at = lambda x, y, z: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))
    columns = nodes.where("kind = 'column'").withColumns({"cx": F.col("col") * F.col(span_x), "cy": F.col("row") * F.col(span_y)})
    placed = columns.select("model_id", "node_id", F.lit("column").alias("kind"), at(F.col("cx"), F.col("cy"), F.lit(0)).alias("a"), at(F.col("cx"), F.col("cy"), F.col("height")).alias("b"), F.array(at(F.col("cx"), F.col("cy"), F.col("height"))).alias("points"))
    ends = supports.groupBy("model_id", F.col("beam_id").alias("node_id")).agg(F.min_by("support_id", "ord").alias("first"), F.max_by("support_id", "ord").alias("last"), F.count(F.lit(1)).alias("n"))
    beams = nodes.where("kind = 'beam'").select("model_id", "node_id").join(ends, ["model_id", "node_id"])
    placed, waiting = durable(placed, "supports"), durable(beams, "beams")
    d2 = lambda p, q: (p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 + (p["z"] - q["z"]) ** 2
    for _ in range(max_rounds):
        known = lambda name, points: placed.select("model_id", F.col("node_id").alias(name), F.col("points").alias(points))
        ready = waiting.join(known("first", "p"), ["model_id", "first"]).join(known("last", "q"), ["model_id", "last"])
        pairs = F.flatten(F.transform("p", lambda p: F.transform("q", lambda q: F.struct(d2(p, q).alias("d"), p.alias("p"), q.alias("q")))))
        best = F.aggregate(pairs, F.get(pairs, F.lit(0)), lambda acc, x: F.when(x["d"] > acc["d"], x).otherwise(acc))
        ready = ready.withColumn("s", best).withColumns({"a": F.col("s.p"), "b": F.col("s.q"), "d": F.col("s.d")})
        middle = at((F.col("a.x") + F.col("b.x")) / 2, (F.col("a.y") + F.col("b.y")) / 2, (F.col("a.z") + F.col("b.z")) / 2)
        top = F.when(F.col("b.z") > F.col("a.z") + 0.5, F.col("b")).when(F.col("a.z") > F.col("b.z") + 0.5, F.col("a")).otherwise(middle)
        tried = durable(ready.select("model_id", "node_id", F.lit("beam").alias("kind"), "a", "b", F.array("a", "b", top).alias("points"), "d"), "supports")
        if tried.isEmpty():
            break
        placed = placed.unionByName(tried.where("d > 0.25").drop("d"))
        waiting = durable(waiting.join(tried.select("model_id", "node_id"), ["model_id", "node_id"], "left_anti"), "beams")
    return placed.select("model_id", "node_id", "kind", F.col("a.x").alias("sx"), F.col("a.y").alias("sy"), F.col("a.z").alias("sz"), F.col("b.x").alias("ex"), F.col("b.y").alias("ey"), F.col("b.z").alias("ez"))


def element_checks(elements: DataFrame) -> DataFrame:
    """Violations of compiled elements (model_id, member_id, category, length, z): beams under the column tops of
    their model, elements without length."""
    tops = elements.where("category = 'column'").groupBy("model_id").agg(F.max(F.col("z") + F.col("length")).alias("top"))
    rows = elements.join(tops, "model_id", "left")
    found = F.filter(F.array(F.when(F.col("length") <= 0.5, "no length"), F.when((F.col("category") == "beam") & (F.col("z") < F.col("top") - 1), "under the columns")), lambda x: x.isNotNull())
    return rows.select("model_id", "member_id", F.explode(found).alias("violation"))


def beam_axes(dx: Column, dy: Column, dz: Column) -> Column:
    """struct<x, y, z> of the profile axis of a beam: across its direction and level, or along x for upright ones."""
    flat = F.hypot(dx, dy)
    return F.when(flat < 1e-6, F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))).otherwise(F.struct((-dy / flat).alias("x"), (dx / flat).alias("y"), F.lit(0.0).alias("z")))


def respaced_columns(columns: DataFrame, spacing: Column) -> DataFrame:
    """Columns of a model in order along x, at even steps of spacing."""
    i = F.row_number().over(Window.partitionBy("model_id").orderBy("x", "member_id")) - 1
    return columns.withColumn("x", i * spacing)


def portal_rows(requests: DataFrame) -> DataFrame:
    """Members of portal frames: n columns at even steps over span_mm of height height_mm and one beam on top."""
    step = F.col("span_mm") / F.greatest(F.col("n_columns") - 1, F.lit(1))
    col = requests.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_columns") - 1))).withColumn("x", F.col("i") * step)
    zero = F.lit(0.0)
    cols = col.select("model_id", F.concat(F.lit("column_"), F.col("i") + 1).alias("member_id"), F.lit("column").alias("category"), F.col("x").alias("sx"), zero.alias("sy"), zero.alias("sz"), F.col("x").alias("ex"), zero.alias("ey"), F.col("height_mm").alias("ez"))
    beam = requests.select("model_id", F.lit("beam_1").alias("member_id"), F.lit("beam").alias("category"), zero.alias("sx"), zero.alias("sy"), F.col("height_mm").alias("sz"), F.col("span_mm").alias("ex"), zero.alias("ey"), F.col("height_mm").alias("ez"))
    return cols.unionByName(beam)
