"""Regions of drawing pages: crop coordinates, stations out of line work and dimension texts, and column clicks.

A crop is a row with its keys and cx0, cy0, cx1, cy1 in points; stations are arrays of millimetres from the crop's
lower left corner. Lists belong to one axis of one crop, so arrays stay short (MAX_LINES values at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import shares
from .grid import MAX_LINES, STATION_TOL, axis_positions, chain_stations, cluster_1d, cluster_weighted, confidence, cumulated, min_gap_fold, once, valid_chain

#: Line work of grids (points, millimetres) and of column clicks (pixels).
STRAIGHT, LONG, STATION_GAP, BLEND = 8.0, 40.0, 35.0, 500.0
LONG_SHARE, SHORT_SHARE, SHORT_WEIGHT = 0.12, 0.02, 0.6
CLICK_GAP, CLICK_SHARE = 14.0, 0.022
MANY, RICHER = 14, 2
SPAN_NUMBER, MIN_SPAN, MAX_SPAN = r"\b(\d{3,5})\b", 500, 120_000


def crop_bounds(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> dict[str, Column]:
    """Corners in points of a crop given by shares of its page."""
    return {"cx0": x * page_w, "cy0": y * page_h, "cx1": (x + w) * page_w, "cy1": (y + h) * page_h}


def to_point(share: Column, lo: str, hi: str) -> Column:
    """A share of a crop's side in points; shares outside 0 to 1 count as its ends."""
    return F.col(lo) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (F.col(hi) - F.col(lo))


def to_share(point: Column, lo: str, hi: str) -> Column:
    """A point as a share of a crop's side; 0 where the side has no length."""
    side = F.col(hi) - F.col(lo)
    return F.when(side > 0, (point - F.col(lo)) / side).otherwise(0.0)


def to_pixel(point: Column, lo: str, hi: str, pixels: Column) -> Column:
    return (point - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1.0)) * pixels


def _axis(segments: DataFrame) -> DataFrame:
    """Segments with their run along the axis they mark: upright ones mark x, level ones y, slanted ones none."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    return segments.withColumns({"dx": dx, "dy": dy, "axis": F.when(dx <= STRAIGHT, "x").when(dy <= STRAIGHT, "y")}).where("axis IS NOT NULL")


def vector_stations(segments: DataFrame, crops: DataFrame, by: list[str]) -> DataFrame:
    """(by, axis, stations): clustered places of long straight segments whose middle lies in the crop (which has
    mm_per_pt); the first station is the crop's corner where no line is there."""
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = mx.between(F.col("cx0"), F.col("cx1")) & my.between(F.col("cy0"), F.col("cy1"))
    upright = F.col("axis") == "x"
    n = shares(segments)
    rows = _axis(segments).repartition(n, *by).join(crops.repartition(n, *by), by).where(inside & (F.when(upright, F.col("dy")).otherwise(F.col("dx")) >= LONG))
    at = F.when(upright, mx - F.col("cx0")).otherwise(F.col("cy1") - my) * F.col("mm_per_pt")
    lines = cluster_1d(rows.withColumn("at", at), [*by, "axis"], "at", STATION_GAP).groupBy(*by, "axis").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    started = F.when(F.element_at("lines", 1) > STATION_TOL, F.concat(F.array(F.lit(0.0)), "lines")).otherwise(F.col("lines"))
    return lines.select(*by, "axis", axis_positions(started).alias("stations"))


def line_samples(segments: DataFrame, crops: DataFrame, by: list[str]) -> DataFrame:
    """(by, axis, line): end points of straight segments in pixels (crops have width_px and height_px), clustered by
    weight; segments that are short for the crop weigh less than their length."""
    w, h = F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")
    upright = F.col("axis") == "x"
    n = shares(segments)
    rows = _axis(segments).repartition(n, *by).join(crops.repartition(n, *by), by).withColumn("length", F.hypot("dx", "dy")).where(F.col("length") >= F.greatest(F.lit(12.0), SHORT_SHARE * F.least(w, h)))
    meets = (F.least("x1", "x2") <= F.col("cx1")) & (F.greatest("x1", "x2") >= F.col("cx0")) & (F.least("y1", "y2") <= F.col("cy1")) & (F.greatest("y1", "y2") >= F.col("cy0"))
    weight = F.col("length") * F.when(F.col("length") >= F.greatest(F.lit(25.0), LONG_SHARE * F.when(upright, h).otherwise(w)), 1.0).otherwise(SHORT_WEIGHT)
    ends = F.explode(F.when(upright, F.array("x1", "x2")).otherwise(F.array("y1", "y2")))
    rows = rows.where(meets).select("*", weight.alias("weight"), ends.alias("end")).where(F.when(upright, F.col("end").between(F.col("cx0"), F.col("cx1"))).otherwise(F.col("end").between(F.col("cy0"), F.col("cy1"))))
    pixel = F.when(upright, to_pixel(F.col("end"), "cx0", "cx1", F.col("width_px"))).otherwise(to_pixel(F.col("end"), "cy0", "cy1", F.col("height_px")))
    tol = F.greatest(F.lit(6.0), F.least("width_px", "height_px") * 0.004)
    return cluster_weighted(rows.withColumns({"at": pixel, "tol": tol}), [*by, "axis"], "at", "weight", F.col("tol"))


def span_hint(text: Column) -> Column:
    """The largest number of a text that can be a span in millimetres; null where there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SPAN_NUMBER), F.lit(1)), lambda x: x.cast("double"))
    return F.array_max(F.filter(found, lambda v: v.between(MIN_SPAN, MAX_SPAN)))


def rising(stations: Column) -> Column:
    """Two stations or more, the first at the corner, all further apart than the tolerance."""
    steps = F.zip_with(F.slice(stations, 2, MAX_LINES), F.slice(stations, 1, F.greatest(F.size(stations) - 1, F.lit(0))), lambda b, a: b - a)
    return F.coalesce((F.size(stations) >= 2) & (F.get(stations, F.lit(0)) <= STATION_TOL) & F.forall(steps, lambda d: d > STATION_TOL), F.lit(False))


def longest(lists: Column) -> Column:
    """Of an array of candidate lists the longest rising one, the first of equals; if none rises, the longest."""
    kept = F.filter(F.transform(lists, lambda s: axis_positions(s)), lambda s: F.size(s) > 0)
    pick = lambda a: F.array_max(F.transform(a, lambda s, i: F.struct(F.size(s).alias("n"), (-i).alias("first"), s.alias("s"))))["s"]
    return once(kept, lambda k: F.coalesce(pick(F.filter(k, rising)), pick(k), F.array().cast("array<double>")))


def axis_candidates(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Stations of an axis out of candidate rows (by, kind line or bay, ord, values).

    Lines compete with each other and with their union; bays never enter it. They stand in only where no line
    is known or where the lines are two end points.
    """
    lists = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "values")))), lambda c: c["values"])
    rows = candidates.groupBy(*by).agg(lists("line").alias("lines"), F.flatten(lists("bay")).alias("bays"))
    own = longest(F.concat(F.array(F.flatten("lines")), "lines"))
    paced = F.col("paced")
    enough = F.size(F.filter("bays", lambda b: b > STATION_TOL)) >= 2
    sparse = F.when(~enough, F.col("own")).when(F.size(paced) > F.greatest(F.size("own"), F.lit(2)), paced).when((F.size("own") >= 2) & (F.size(paced) >= 2), longest(F.array("own", paced)))
    chosen = F.when(F.size("own") >= 3, F.col("own")).otherwise(sparse.when(F.size("own") >= 2, F.col("own")).otherwise(paced))
    rows = rows.withColumns({"own": own, "paced": axis_positions(cumulated(F.col("bays")))}).withColumn("stations", chosen)
    return rows.select(*by, F.when(F.size("stations") >= 2, F.col("stations")).otherwise(F.array().cast("array<double>")).alias("stations"))


def blended(text: Column, vector: Column) -> Column:
    """Stations by dimension texts, by lines where the texts give none; lines that end where the texts end win if
    they are more."""

    def pick(v: Column, known: Column) -> Column:
        near = F.abs(F.element_at(v, -1) - F.try_element_at(known, F.lit(-1))) < BLEND
        return F.when(F.coalesce(near & (F.size(v) >= F.size(known)), F.lit(False)), longest(F.array(known, v))).otherwise(known)

    t, v = (once(s, lambda s: F.when(valid_chain(s), s)) for s in (text, vector))
    return once(v, lambda v: once(F.coalesce(t, v, F.array().cast("array<double>")), lambda known: pick(v, known)))


def region_grid(numbers: DataFrame, vectors: DataFrame, by: list[str]) -> DataFrame:
    """One row a crop (by): x, y, sources, confidence. numbers: (by, axis, numbers) of dimension rows; vectors: the
    rows of `vector_stations`. Crops without two stations on any axis have confidence 0."""
    text = numbers.select(*by, "axis", chain_stations(F.col("numbers")).alias("text"))
    rows = text.join(vectors.withColumnRenamed("stations", "vector"), [*by, "axis"], "full")
    some = lambda c: F.coalesce(c, F.array().cast("array<double>"))
    clean = F.when(valid_chain(F.col("vector")), F.col("vector"))
    seen = (F.size(some(F.col("text"))) >= 3).cast("int") + (F.size(some(clean)) >= 3).cast("int")
    rows = rows.select(*by, "axis", blended(some(F.col("text")), some(F.col("vector"))).alias("s"), seen.alias("seen"))
    of = lambda a: some(F.max(F.when(F.col("axis") == a, F.col("s"))))
    out = rows.groupBy(*by).agg(of("x").alias("x"), of("y").alias("y"), F.sum("seen").alias("sources"))
    found = (F.size("x") >= 2) | (F.size("y") >= 2)
    return out.withColumn("confidence", F.when(found, confidence(F.size("x") >= 3, F.size("y") >= 3, F.col("sources"))).otherwise(0.0))


#: Fixed value: below it a detection counts only where an axis has several stations.
SURE = 0.35


def merged_analysis(pages: DataFrame) -> DataFrame:
    """Adds merged_x and merged_y: stations (x, y) detected with a confidence, against given ones (given_x, given_y).

    A detection without two stations on an axis is dropped, and so is an unsure one without three; pages keep what
    was given then. An axis that loses all but one station by the merge keeps the given ones.
    """
    n = {a: F.coalesce(F.size(a), F.lit(0)) for a in "xy"}
    trusted = (F.greatest(*n.values()) >= 2) & ((F.col("confidence") >= SURE) | (F.greatest(*n.values()) >= 3))
    for a in "xy":
        given = F.coalesce(f"given_{a}", F.array().cast("array<double>"))
        new = preferred_axis(F.coalesce(F.col(a), F.array().cast("array<double>")), given)
        pages = pages.withColumn(f"merged_{a}", F.when(~trusted | ((F.size(new) < 2) & (F.size(given) >= 2)), given).otherwise(new))
    return pages


def preferred_axis(detected: Column, given: Column) -> Column:
    """Of detected and given stations the valid list; of two valid ones the longer, unless the detected one is so
    much longer that it must hold stray lines."""
    d, g = valid_chain(detected), valid_chain(given)
    stray = (F.size(detected) > F.size(given) + RICHER) & (F.size(detected) > MANY)
    sparse = (F.size(given) <= 2) & (F.size(detected) >= 3)
    return (
        F.when(d & ~g, detected).when(g & ~d, given).when(~d & ~g, F.when(F.size(given) >= 2, given).otherwise(detected))
        .when(sparse, detected).when(stray, given).when(F.size(detected) > F.size(given), detected).otherwise(given)
    )


def reindexed(index: Column, old: Column, new: Column) -> Column:
    """The index on new stations nearest to an index on old ones, the first on ties. An index beyond the old stations
    stays, or becomes the last one."""
    near = F.array_min(F.transform(new, lambda s, i: F.struct(F.abs(s - F.get(old, index)).alias("d"), i.alias("i"))))["i"]
    return F.when(F.size(new) == 0, F.lit(None)).when(index < F.size(old), near).otherwise(F.least(index, F.size(new) - 1)).cast("int")


#: Fixed value: a detection of grid dimensions less sure than this gives no scale.
SCALE_SURE = 0.3


def crop_calibration(crops: DataFrame) -> DataFrame:
    """Adds mm_per_px, mm_per_px_x, mm_per_px_y, span_x, span_y and source: how many millimetres a pixel of a crop is.

    crops: width_px, height_px, stations xs and ys (millimetres) with their confidence, the crop's size clip_w and
    clip_h in points with mm_per_pt (`drawing.inferred_scale`), and grid_mm_x, grid_mm_y, the scale of its labelled grid
    lines. Sources, the first that has a value: labels (both axes have stations, and labels fit lines), stations of
    both axes, stations of x, those of y (x then by the sheet's line work), line work alone; else none, and none too
    where dimensions were not found for sure. Only labels give a scale to each axis; a crop without a size has none.
    """
    xs, ys = (axis_positions(F.coalesce(c, F.array().cast("array<double>"))) for c in ("xs", "ys"))
    sure = F.coalesce(F.col("confidence") >= SCALE_SURE, F.lit(False))
    rows = crops.withColumns({"span_x": F.when(sure, F.try_element_at(xs, F.lit(-1))), "span_y": F.when(sure, F.try_element_at(ys, F.lit(-1))), "__both": sure & (F.size(xs) >= 2) & (F.size(ys) >= 2)})
    share = lambda span, pixels: F.when((span > 0) & (F.col(pixels) > 0), span / F.col(pixels))
    by_x, by_y = share(F.col("span_x"), "width_px"), share(F.col("span_y"), "height_px")
    drawn = F.when(sure, share(F.col("clip_w") * F.col("mm_per_pt"), "width_px"))
    labels = F.when(F.col("__both") & (F.col("grid_mm_x") > 0), F.col("grid_mm_x"))
    rows = rows.withColumns({"__labels": labels, "__x": by_x, "__y": by_y, "__drawn": drawn})
    source = (
        F.when(F.col("__labels").isNotNull(), "labels").when(F.col("__x").isNotNull() & F.col("__y").isNotNull(), "stations").when(F.col("__x").isNotNull(), "stations_x")
        .when(F.col("__y").isNotNull() & F.col("__drawn").isNotNull(), "stations_y").when(F.col("__drawn").isNotNull(), "line_work").otherwise("none")
    )
    out = {"mm_per_px": F.coalesce("__x", "__drawn", "__labels"), "mm_per_px_x": F.col("__labels"), "mm_per_px_y": F.when(F.col("__labels").isNotNull(), F.col("grid_mm_y")), "source": source}
    return rows.withColumns(out).drop("__labels", "__x", "__y", "__drawn", "__both")


def click_placements(clicks: DataFrame, crops: DataFrame, by: list[str], profile: str = "HEB200", height: float = 6000.0) -> DataFrame:
    """Columns at clicks (by, ord, x, y, mark) in pixels of crops (by, width_px, height_px, mm_per_px, xs, ys).

    Where a crop has stations on both axes (xs, ys), clicks snap to them; y runs up. Elsewhere stations are the
    clusters of the clicks themselves, scaled by mm_per_px or numbered without it, and clicks snap in pixels: to the
    crop's own lines (columns lines_x and lines_y, if there are such, of two lines at least on both axes), else to the
    clusters. Crops that give fewer than two stations on an axis give no columns.
    """
    none = F.lit(None).cast("array<double>")
    for a in "xy":
        lines = F.coalesce(F.col(f"lines_{a}"), F.array().cast("array<double>")) if f"lines_{a}" in crops.columns else none
        crops = crops.withColumn(f"__l{a}", min_gap_fold(F.array_sort(lines), F.lit(1.0)))
    drawn = F.coalesce((F.size("__lx") >= 2) & (F.size("__ly") >= 2), F.lit(False))
    crops = crops.withColumns({f"__l{a}": F.when(drawn, F.col(f"__l{a}")) for a in "xy"})
    spread = lambda s: F.coalesce((F.size(s) >= 2) & (F.element_at(s, -1) > F.element_at(s, 1)), F.lit(False))
    crops = crops.withColumn("xs", axis_positions(F.coalesce("xs", F.array().cast("array<double>")))).withColumn("ys", axis_positions(F.coalesce("ys", F.array().cast("array<double>"))))
    crops = crops.withColumn("given", spread(F.col("xs")) & spread(F.col("ys")))
    rows = clicks.join(crops.drop("xs", "ys"), by)
    own = None
    for a, side in (("x", "width_px"), ("y", "height_px")):
        tol = F.greatest(F.lit(CLICK_GAP), F.col(side) * CLICK_SHARE)
        lines = cluster_1d(rows.where("NOT given").withColumn("tol", tol), by, a, F.col("tol")).groupBy(*by).agg(F.sort_array(F.collect_list("line")).alias(f"p{a}"))
        own = lines if own is None else own.join(lines, by)
    all_rows = clicks.join(crops.join(own, by, "left"), by)
    scale = F.when(F.col("mm_per_px") > 0, F.col("mm_per_px"))
    base = lambda p: F.when(scale.isNotNull(), axis_positions(F.transform(p, lambda v: F.round((v - F.element_at(p, 1)) * scale, 1)))).otherwise(F.transform(p, lambda v, i: i.cast("double")))
    all_rows = all_rows.withColumns({"bx": F.when(F.col("given"), F.col("xs")).otherwise(base(F.col("px"))), "by_": F.when(F.col("given"), F.col("ys")).otherwise(base(F.col("py")))})
    all_rows = all_rows.where(spread(F.col("bx")) & spread(F.col("by_")) & (F.col("width_px") > 0) & (F.col("height_px") > 0))
    mx, my = F.element_at("bx", -1) / F.col("width_px"), F.element_at("by_", -1) / F.col("height_px")
    near = lambda s, v: F.array_min(F.transform(s, lambda x, i: F.struct(F.abs(x - v).alias("d"), i.alias("i"))))["i"]
    # without given stations the lines or clusters in pixels carry the millimetres, from the crop's edges on
    all_rows = all_rows.withColumns({f"q{a}": F.coalesce(f"__l{a}", f"p{a}") for a in "xy"})
    own_x, own_y = F.round(F.get("qx", F.col("ix")) * F.col("mx"), 1), F.round((F.col("height_px") - F.get("qy", F.col("iy"))) * F.col("my"), 1)
    ix = F.when(F.col("given"), near(F.col("xs"), F.col("x") * mx)).otherwise(near(F.col("qx"), F.col("x")))
    iy = F.when(F.col("given"), near(F.col("ys"), F.element_at("by_", -1) - F.col("y") * my)).otherwise(near(F.col("qy"), F.col("y")))
    placed = all_rows.withColumns({"mx": mx, "my": my, "ix": ix, "iy": iy})
    placed = placed.withColumn("x_mm", F.when(F.col("given"), F.round(F.get("xs", F.col("ix")), 1)).otherwise(own_x)).withColumn("y_mm", F.when(F.col("given"), F.round(F.get("ys", F.col("iy")), 1)).otherwise(own_y))
    mark = F.coalesce(F.nullif(F.trim("mark"), F.lit("")), F.concat(F.lit("C"), F.col("ord") + 1))
    name = F.when(F.col("given"), F.concat_ws("_", F.lit("col"), "ix", "iy")).otherwise(F.concat(F.lit("col_"), "ord"))
    return placed.select(*by, "ord", name.alias("placement_id"), mark.alias("mark"), "x_mm", "y_mm", F.lit(profile).alias("profile"), F.lit(height).alias("height_mm"))


def unique_ids(placements: DataFrame, by: list[str]) -> DataFrame:
    """Placements (id, ord, x_mm, y_mm) with ids that are unique within by: the first keeps its id, the second of an
    id gets its place added, later ones a number. A missing id is made of the place."""
    at = F.concat_ws("_", F.col("x_mm").cast("int"), F.col("y_mm").cast("int"))
    rows = placements.withColumn("base", F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.concat(F.lit("col_"), at)))
    n = F.row_number().over(Window.partitionBy(*by, "base").orderBy("ord"))
    rows = rows.withColumn("member_id", F.when(n == 1, F.col("base")).when(n == 2, F.concat_ws("_", "base", at)).otherwise(F.concat_ws("_", "base", n - 1)))
    # an id made here can equal another row's own: the later row then takes its number in the crop
    again = F.row_number().over(Window.partitionBy(*by, "member_id").orderBy("ord"))
    return rows.withColumn("member_id", F.when(again == 1, F.col("member_id")).otherwise(F.concat_ws("_", "base", F.lit("n"), "ord"))).drop("base")
