"""Line work of drawings: segments, scores, bounds, merged and deduplicated lines, routes.

Segments have columns doc_id, page_index, x1, y1, x2, y2, stroke, seq; path items kind (l, re, qu), pts, width.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, durable

PAGE = ("doc_id", "page_index")
#: Cells that the range of a page's values is cut into where ranks are looked up.
CELLS = 1024
POINT_MM = 25.4 / 72
#: compat is the customary threshold and admits nearly every direction; strict admits 2 degrees around the axes.
ORTHO = {"compat": math.cos(math.radians(88)), "strict": math.cos(math.radians(2))}


def explode_items(items: DataFrame) -> DataFrame:
    """Lines give one segment, rectangles (two corners) and quads (four) give four; items of too few points none."""
    p = lambda i: F.get("pts", F.lit(i))
    edge = lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    xy = lambda i: (p(i)["x"], p(i)["y"])
    (ax, ay), (bx, by) = xy(0), xy(1)
    corners = [(ax, ay), (bx, ay), (bx, by), (ax, by)]
    ring = lambda c: F.array(*(edge(c[i], c[(i + 1) % 4]) for i in range(4)))
    n = F.size("pts")
    edges = F.when((F.col("kind") == "l") & (n >= 2), F.array(edge(xy(0), xy(1)))).when((F.col("kind") == "re") & (n >= 2), ring(corners)).when((F.col("kind") == "qu") & (n >= 4), ring([xy(0), xy(1), xy(3), xy(2)]))
    rows = items.select("*", F.posexplode(edges).alias("part", "e"))
    return rows.select(*(c for c in items.columns if c not in ("pts", "kind")), "kind", "part", "e.*")


def line_items(items: DataFrame, *by: str) -> DataFrame:
    """Number of lines per page or document: 1 for a line, 4 for a rectangle or quad."""
    return items.groupBy(*by).agg(F.sum(F.when(F.col("kind") == "l", 1).when(F.col("kind").isin("re", "qu"), 4).otherwise(0)).alias("n_lines"))


def length() -> Column:
    return F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def orthogonal(mode: str = "compat") -> Column:
    n = length()
    share = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / n
    return (n > 1e-9) & (share >= ORTHO[mode])


def snapped_key(grid: float) -> Column:
    """Undirected key: both ends on the grid (half to even), the smaller end first."""
    q = lambda c: F.bround(F.col(c) / grid) * grid
    a, b = F.struct(q("x1").alias("x"), q("y1").alias("y")), F.struct(q("x2").alias("x"), q("y2").alias("y"))
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def scale_of_note(note: Column) -> Column:
    """Millimetres a unit from a scale note, null where it says nothing."""
    t = F.lower(F.trim(note))
    given = F.nullif(F.regexp_extract(t, r"(\d+(?:\.\d+)?)\s*mm\s*/\s*(?:pdf\s*)?(?:unit|pt|point)", 1), F.lit(""))
    unit = t.rlike(r"grid\s*(?:spacing\s*)?[=:]?\s*(\d{3,6})") | t.rlike(r"units?\s*[=:]?\s*mm")
    return F.coalesce(given.try_cast("double"), F.when(unit, 1.0))


def at_ranks(values: DataFrame, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """Per group n, the number of its values (column v, none null), and the values at given ranks from 0 on.

    ranks are expressions over n; one outside 0 to n - 1 gives null. Equal values are counted first, then values per
    cell of the group's range; only a cell that holds a rank is sorted, so no task sees a whole group.
    """
    counts = values.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    size = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    cell = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS)).otherwise(F.lit(0))
    celled = counts.join(size, by).select(*by, "v", "c", cell.alias("cell"))
    upto = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = celled.groupBy(*by, "cell").agg(F.sum("c").alias("k")).withColumn("upto", F.sum("k").over(upto)).withColumn("before", F.col("upto") - F.col("k"))
    names = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items())))
    wanted = size.select(*by, names.alias("r")).select(*by, "r.*").join(cells, by).where("rank >= before AND rank < upto").select(*by, "name", "cell", (F.col("rank") - F.col("before")).alias("left"))
    inside = Window.partitionBy(*by, "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hits = celled.join(wanted, [*by, "cell"]).withColumn("upto", F.sum("c").over(inside)).where("left >= upto - c AND left < upto")
    found = hits.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks))
    return size.select(*by, "n").join(found, by, "left")


def inferred_scale(segments: DataFrame) -> DataFrame:
    """Per page: millimetres a unit from the upper median length and the range of all coordinates."""
    n = length()
    spans = segments.groupBy(*PAGE).agg((F.max(F.greatest("x1", "y1", "x2", "y2")) - F.min(F.least("x1", "y1", "x2", "y2"))).alias("span"))
    middle = at_ranks(segments.select(*PAGE, n.alias("v")).where("v > 1e-6"), list(PAGE), {"middle": F.floor(F.col("n") / 2)})
    rows = spans.join(middle, list(PAGE), "left")
    median = F.coalesce("middle", F.lit(0.0))
    scale = F.when(median > 12_000, POINT_MM).when((F.col("span") > 4_000) | (median > 400), 1.0).when(F.col("span") < 80, 1000.0).otherwise(POINT_MM)
    return rows.select(*PAGE, median.alias("median_length"), "span", scale.alias("mm_per_unit"))


def scale_candidates(explicit: Column, inferred: Column) -> Column:
    """Scales to try in order, those within 1e-6 of an earlier one left out."""
    every = F.filter(F.array(explicit, inferred, F.lit(1.0), F.lit(POINT_MM)), lambda x: x.isNotNull())
    return F.aggregate(every, F.array().cast("array<double>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(x - y) < 1e-6), acc).otherwise(F.concat(acc, F.array(x))))


def page_scores(segments: DataFrame, mode: str = "compat") -> DataFrame:
    """Per page: number and total length of segments of 150 to 25 000 units along an axis."""
    ok = orthogonal(mode) & length().between(150, 25_000)
    return segments.groupBy(*PAGE).agg(F.sum(ok.cast("int")).alias("n_structural"), F.coalesce(F.sum(F.when(ok, length())), F.lit(0.0)).alias("total_length"))


def primary_page(scores: DataFrame) -> DataFrame:
    """Per document the page with the best score; the first one of equal pages."""
    place = F.struct("n_structural", "total_length", -F.col("page_index"))
    return scores.groupBy("doc_id").agg(F.max_by("page_index", place).alias("page_index"))


def percentile_bounds(segments: DataFrame, margin: float = 3.0) -> DataFrame:
    """Per page: nearest-rank percentiles of all end points."""
    ends = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"{a}{i}").alias("v")) for a in "xy" for i in (1, 2))))
    rank = lambda pct: F.bround(F.lit(pct / 100) * (F.col("n") - 1))
    found = at_ranks(segments.select(*PAGE, ends.alias("e")).select(*PAGE, "e.*").where("v IS NOT NULL"), [*PAGE, "axis"], {"min": rank(margin), "max": rank(100 - margin)})
    return found.groupBy(*PAGE).agg(*(F.max(F.when(F.col("axis") == a, F.col(m))).alias(f"{m}_{a}") for m in ("min", "max") for a in "xy"))


def inside_bounds(segments: DataFrame, bounds: DataFrame) -> DataFrame:
    """Segments whose middle lies in their page's bounds."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return segments.join(bounds, list(PAGE)).where(x.between(F.col("min_x"), F.col("max_x")) & y.between(F.col("min_y"), F.col("max_y"))).drop("min_x", "min_y", "max_x", "max_y")


def merge_intervals(segments: DataFrame, grid: float = 25.0) -> DataFrame:
    """Collinear segments on one grid line become the union of their intervals; those shorter than grid are dropped.

    True interval union by gaps and islands. A page on which nothing is left keeps its segments.
    """
    return _islands(segments.withColumn("seq", F.lit(0)), grid).drop("seq")


def _islands(segments: DataFrame, grid: float) -> DataFrame:
    """The rows of `merge_intervals`, each with the smallest seq of the segments in it."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    flat = dx >= dy
    pick = lambda a, b: F.when(flat, a).otherwise(b)
    rows = segments.select(
        *PAGE, flat.alias("horizontal"), F.bround(pick((F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2) / grid).cast("long").alias("line"),
        pick(F.least("x1", "x2"), F.least("y1", "y2")).alias("a"), pick(F.greatest("x1", "x2"), F.greatest("y1", "y2")).alias("b"), "seq",
    )
    on = Window.partitionBy(*PAGE, "horizontal", "line").orderBy("a", "b")
    gap = F.col("a") > F.max("b").over(on.rowsBetween(Window.unboundedPreceding, -1)) + grid
    islands = rows.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(on.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*PAGE, "horizontal", "line", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n_merged"), F.min("seq").alias("seq")).where(F.col("b") - F.col("a") >= grid).drop("island")


def merged_segments(segments: DataFrame, grid: float = 25.0) -> DataFrame:
    """merge_intervals as segments again, with pages passed through where nothing was left; seq is the smallest one."""
    m = _islands(segments, grid)
    at = F.col("line") * grid
    pick = lambda a, b: F.when(F.col("horizontal"), a).otherwise(b)
    lines = m.select(*PAGE, pick(F.col("a"), at).alias("x1"), pick(at, F.col("a")).alias("y1"), pick(F.col("b"), at).alias("x2"), pick(at, F.col("b")).alias("y2"), "seq")
    rest = segments.join(m.select(*PAGE).distinct(), list(PAGE), "left_anti").select(*PAGE, "x1", "y1", "x2", "y2", "seq")
    return lines.unionByName(rest)


def filter_and_scale(segments: DataFrame, scale: float | Column, min_length: float, min_stroke: float = 0.0, mode: str | None = "compat") -> DataFrame:
    scale = F.lit(scale) if isinstance(scale, float) else scale
    keep = length() * scale >= min_length
    if min_stroke > 0:
        keep = keep & (F.col("stroke") >= min_stroke)
    if mode:
        keep = keep & orthogonal(mode)
    return segments.where(keep).withColumns({c: F.col(c) * scale for c in ("x1", "y1", "x2", "y2")})


def stroke_threshold(segments: DataFrame) -> DataFrame:
    """Per page: 0 below 30 widths, else the smaller of the upper median and 0.85 of the 72 % rank."""
    n = F.col("n")
    ranks = {"middle": F.floor(n / 2), "high": F.floor(n * 0.72)}
    found = at_ranks(segments.select(*PAGE, F.col("stroke").alias("v")).where("v > 0.05"), list(PAGE), ranks)
    rows = segments.select(*PAGE).distinct().join(found, list(PAGE), "left")
    value = F.least(F.col("middle"), F.col("high") * 0.85)
    return rows.select(*PAGE, F.coalesce(n, F.lit(0)).cast("int").alias("n_widths"), F.when(F.coalesce(n, F.lit(0)) < 30, 0.0).otherwise(F.greatest(F.lit(0.0), value)).alias("threshold"))


#: Least lengths of the attempts as shares of the wanted one with their lower bounds, millimetres, and
#: whether only directions along an axis count; and the strokes of a round, as shares of the page's threshold, with
#: whether the attempt's own directions hold.
ATTEMPT_LENGTHS = ((1.0, 0.0, True), (0.45, 350.0, True), (0.25, 200.0, True), (0.2, 150.0, False))
ATTEMPT_STROKES = ((1.0, True), (0.5, True), (0.0, True), (0.0, False))
N_SCALES = 4


def page_settings(segments: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Per page the scales to try and the stroke of structural lines; notes: doc_id, note (a text about the scale)."""
    rows = inferred_scale(segments).select(*PAGE, "mm_per_unit").join(stroke_threshold(segments).select(*PAGE, "threshold"), list(PAGE))
    stated = F.lit(None).cast("double")
    if notes is not None:
        rows, stated = rows.join(notes.select("doc_id", scale_of_note(F.col("note")).alias("stated")), "doc_id", "left"), F.col("stated")
    return rows.select(*PAGE, scale_candidates(stated, F.coalesce(stated, F.col("mm_per_unit"))).alias("scales"), "threshold")


def first_attempt(segments: DataFrame, pages: DataFrame, min_length: float = 600.0) -> DataFrame:
    """Per document the first attempt that leaves segments: (doc_id, page_index, scale, min_length, stroke, orthogonal, n).

    Attempts go through pages by score, then lengths from strict to loose, then the page's scales, then strokes. All
    are judged in one pass: a segment becomes the set of the attempts it survives, a bit each, and one aggregation
    counts the bits of a page beside its score; no attempt is a job of its own. pages: see `page_settings`.
    """
    lengths = [(max(least, min_length * share), ortho) for share, least, ortho in ATTEMPT_LENGTHS]
    attempts = [(m, k, w) for m in range(len(lengths)) for k in range(N_SCALES) for w in range(len(ATTEMPT_STROKES))]
    n = length()

    def survives(m: int, k: int, w: int) -> Column:
        (least, ortho), (share, own) = lengths[m], ATTEMPT_STROKES[w]
        keep = n * F.get("scales", F.lit(k)) >= least
        if share:
            keep = keep & ((F.col("threshold") <= 0) | (F.col("stroke") >= F.col("threshold") * share))
        return keep & orthogonal() if ortho and own else keep

    bit = lambda i: F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long")
    bits = reduce(lambda x, y: x.bitwiseOR(y), (F.when(survives(*a), bit(i)).otherwise(F.lit(0).cast("long")) for i, a in enumerate(attempts)))
    rows = segments.join(pages, list(PAGE)).select(*PAGE, "scales", "threshold", n.alias("len"), (orthogonal() & n.between(150, 25_000)).alias("structural"), bits.alias("bits"))
    counts = F.array(*(F.count_if(F.col("bits").bitwiseAND(bit(i)) != 0) for i in range(len(attempts))))
    scored = rows.groupBy(*PAGE).agg(counts.alias("counts"), F.count_if("structural").alias("score"), F.coalesce(F.sum(F.when(F.col("structural"), F.col("len"))), F.lit(0.0)).alias("total"), F.first("scales").alias("scales"), F.first("threshold").alias("threshold"))
    left = scored.select("*", F.posexplode("counts").alias("i", "n")).where("n > 0")
    order = F.struct(-F.col("score"), -F.col("total"), F.col("page_index"), F.col("i"))
    best = left.groupBy("doc_id").agg(F.min_by(F.struct("page_index", "i", "n", "scales", "threshold"), order).alias("x")).select("doc_id", "x.*")
    of = lambda values: F.array(*map(F.lit, values))[F.col("i")]
    return best.select(
        "doc_id", "page_index", F.get("scales", of([k for _, k, _ in attempts])).alias("scale"), of([lengths[m][0] for m, _, _ in attempts]).alias("min_length"), (F.col("threshold") * of([ATTEMPT_STROKES[w][0] for _, _, w in attempts])).alias("stroke"),
        of([lengths[m][1] and ATTEMPT_STROKES[w][1] for m, _, w in attempts]).alias("orthogonal"), "n",
    )


ENDS = ("sx", "sy", "sz", "ex", "ey", "ez")


def submodel_key(grid: float) -> Column:
    """Undirected identity of a member in space: both ends on the grid (half to even), the smaller end first."""
    end = lambda p: F.struct(*(F.bround(F.col(p + a) / grid).cast("long").alias(a) for a in "xyz"))
    return F.struct(F.least(end("s"), end("e")).alias("a"), F.greatest(end("s"), end("e")).alias("b"))


def merged_submodels(members: DataFrame, crops: DataFrame, grid: float = 250.0, across_cells: bool = False) -> DataFrame:
    """Members of overlapping crops of a page in the page's millimetres, each once: the longest of equal keys.

    members: doc_id, page_index, crop_id, seq, sx .. ez in millimetres from the crop's lower left corner; crops: x0, y1
    (left and lower edge, points from above), page_height, mm_per_pt; crops without a scale, and the crop 'full',
    leave members where they are. Of equally long members the first by seq stays. n_same is how many were one.

    across_cells also takes members for one whose ends lie on both sides of a grid border: ends within half a grid in
    every direction. Members that are linked so, also by way of others, are one.
    """
    place = crops.select(*PAGE, "crop_id", F.when((F.col("crop_id") != "full") & (F.col("mm_per_pt") > 0), F.struct((F.col("x0") * F.col("mm_per_pt")).alias("x"), ((F.col("page_height") - F.col("y1")) * F.col("mm_per_pt")).alias("y"))).alias("o"))
    rows = members.join(place, [*PAGE, "crop_id"], "left")
    rows = rows.withColumns({p + a: F.col(p + a) + F.coalesce(f"o.{a}", F.lit(0.0)) for p in "se" for a in "xy"}).drop("o")
    squared = sum(((F.col(f"e{a}") - F.col(f"s{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    rows = rows.withColumn("key", submodel_key(grid))
    best = F.max_by(F.struct("seq", "crop_id", *ENDS), F.struct(squared, -F.col("seq")))
    kept = rows.groupBy(*PAGE, "key").agg(best.alias("m"), F.count(F.lit(1)).alias("n_same")).select(*PAGE, "m.*", "n_same")
    return _across_cells(kept, grid) if across_cells else kept


def _across_cells(kept: DataFrame, grid: float) -> DataFrame:
    """Rows that stand for members whose ends agree within half a grid, one a component."""
    kept = durable(kept.withColumn("node", F.concat_ws("/", *PAGE, "seq")), "submodels")
    # both directions of a row against one of the other; a twelfth of space each: an end lies in the cells around it
    turned = {f"{p}{a}": F.col(f"{q}{a}") for p, q in (("s", "e"), ("e", "s")) for a in "xyz"}
    both = kept.unionByName(kept.withColumns(turned))
    cell = lambda c: F.floor(F.col(c) / grid)
    around = lambda c: F.explode(F.sequence(F.floor((F.col(c) - grid / 2) / grid), F.floor((F.col(c) + grid / 2) / grid)))
    left = kept.select(*PAGE, "node", *ENDS, *(cell(f"s{a}").alias(f"c{a}") for a in "xyz"))
    right = both.select(*PAGE, F.col("node").alias("other"), *(F.col(c).alias(f"o{c}") for c in ENDS))
    for a in "xyz":
        right = right.withColumn(f"c{a}", around(f"os{a}"))
    near = reduce(lambda x, y: x & y, (F.abs(F.col(c) - F.col(f"o{c}")) <= grid / 2 for c in ENDS))
    links = left.join(right, [*PAGE, "cx", "cy", "cz"]).where(near & (F.col("node") < F.col("other"))).select(F.col("node").alias("src"), F.col("other").alias("dst"))
    groups = connected_components(links)
    squared = sum(((F.col(f"e{a}") - F.col(f"s{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    rows = kept.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = F.max_by(F.struct("seq", "crop_id", *ENDS), F.struct(squared, -F.col("seq")))
    return rows.groupBy(*PAGE, "component").agg(best.alias("m"), F.sum("n_same").alias("n_same")).select(*PAGE, "m.*", "n_same")


def dedupe_last(segments: DataFrame, grid: float = 25.0) -> DataFrame:
    """Of segments with one snapped key on a page the last stays."""
    keyed = segments.withColumn("key", snapped_key(grid))
    return keyed.groupBy(*PAGE, "key").agg(F.max_by(F.struct("seq", "x1", "y1", "x2", "y2"), "seq").alias("s")).select(*PAGE, "s.*")


def dedupe_longest(segments: DataFrame, grid: float = 25.0) -> DataFrame:
    """Of segments with one snapped key on a page the longest stays, the first of equal ones."""
    squared = (F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2
    keyed = segments.withColumn("key", snapped_key(grid))
    best = F.max_by(F.struct("seq", "x1", "y1", "x2", "y2"), F.struct(squared, -F.col("seq")))
    return keyed.groupBy(*PAGE, "key").agg(best.alias("s")).select(*PAGE, "s.*")


def top_longest(segments: DataFrame, k: int = 4000) -> DataFrame:
    """A sheet's report of its k longest segments."""
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(length().desc(), "seq"))
    return segments.withColumn("place", place).where(F.col("place") <= k)


def vector_model(segments: DataFrame, grid: float = 25.0, k: int = 4000, profile: str = "HEB200") -> DataFrame:
    """Members of a sheet: trimmed, merged, deduplicated, longest first, moved to the origin, numbered."""
    merged = merged_segments(inside_bounds(segments, percentile_bounds(segments)), grid)
    rows = top_longest(dedupe_last(merged, grid), k)
    corner = rows.groupBy(*PAGE).agg(F.min(F.least("x1", "x2")).alias("ox"), F.min(F.least("y1", "y2")).alias("oy"))
    name = F.concat(F.lit("p"), F.col("page_index") + 1, F.lit("_"), "place")
    return rows.join(corner, list(PAGE)).select(
        "doc_id", name.alias("member_id"), F.lit(profile).alias("profile"), *((F.col(c) - F.col(o)).alias(n) for c, o, n in (("x1", "ox", "sx"), ("y1", "oy", "sy"))), F.lit(0.0).alias("sz"),
        *((F.col(c) - F.col(o)).alias(n) for c, o, n in (("x2", "ox", "ex"), ("y2", "oy", "ey"))), F.lit(0.0).alias("ez"),
    )


def spans_in_clip(spans: DataFrame, crops: DataFrame) -> DataFrame:
    """Text spans whose middle lies in a crop (x0, y0, x1, y1 of the crop as cx0 and so on) of their page."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return spans.join(crops, list(PAGE)).where(x.between(F.col("cx0"), F.col("cx1")) & y.between(F.col("cy0"), F.col("cy1")) & (F.trim("text") != ""))


def ingest_report(pages: DataFrame, excerpt: int = 48_000) -> DataFrame:
    """Per document: pages, drawing operations (lines or paths, the larger, per page), text length, excerpt, warnings."""
    n_text = F.sum(F.length("text"))
    ops = F.sum(F.greatest("n_lines", "n_paths"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page_index", "text"))), lambda x: x["text"])
    warnings = F.filter(F.array(F.when(ops == 0, "no line work"), F.when(n_text == 0, "no text")), lambda x: x.isNotNull())
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), ops.alias("drawing_ops"), n_text.alias("text_chars"), F.substring(F.array_join(ordered, "\n"), 1, excerpt).alias("excerpt"), warnings.alias("warnings")
    )


def route(ops: Column, chars: Column) -> Column:
    """Order of extraction methods for a document, from what its pages hold."""
    return F.when(ops >= 200, F.array(F.lit("vector"), F.lit("vision"))).when(chars >= 200, F.array(F.lit("text"), F.lit("vision"))).otherwise(F.array(F.lit("vision")))


def result_status(complete: Column, valid: Column, fragmented: Column) -> Column:
    return F.when(~valid, "failed").when(~complete | fragmented, "needs_review").otherwise("ok")


def shifted(members: DataFrame, crops: DataFrame) -> DataFrame:
    """Crop-local members in page coordinates."""
    moved = {c: F.col(c) + F.col(o) for c, o in (("sx", "x"), ("ex", "x"), ("sy", "y"), ("ey", "y"))}
    return members.join(crops.select("doc_id", "page_index", "crop_id", "x", "y"), ["doc_id", "page_index", "crop_id"]).withColumns(moved).drop("x", "y")


def unique_ids(members: DataFrame, *by: str) -> DataFrame:
    """Page-prefixed ids; repeated ones get _2, _3 and so on in order of seq."""
    named = members.withColumn("member_id", F.concat(F.lit("p"), F.col("page_index") + 1, F.lit("_"), "member_id"))
    n = F.row_number().over(Window.partitionBy(*by, "member_id").orderBy("seq"))
    return named.withColumn("n", n).withColumn("member_id", F.when(F.col("n") > 1, F.concat("member_id", F.lit("_"), "n")).otherwise(F.col("member_id"))).drop("n")
