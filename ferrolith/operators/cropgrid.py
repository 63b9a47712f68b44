"""Grids of crops by their axis labels, and grid models: axes in pixels with stations, and columns on their crossings.

A crop is a row with its keys, cx0, cy0, cx1, cy1 in points, width_px, height_px and mm_per_pt. Texts, strokes and clicks
stay rows until they are clusters: an axis has at most 100 labels, and lines at least 8 pixels apart, so the arrays of an
axis are bounded by its crop and not by the number of texts on its page. Models are written once: columns, filters and
placements read their axes several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ragged
from .graph import dealt, durable
from .grid import MAX_LINES, STATION_TOL, cluster_weighted, once
from .region import to_pixel

#: Straightness and length of major grid lines, bands of labels, lines an axis keeps (pixels, shares).
STRAIGHT, LONG, LONG_SHARE, LINE_GAP, LINE_SHARE = 8.0, 40.0, 0.22, 8.0, 0.003
BAND, NUMBER, LETTER = 0.14, r"^\d{1,2}$", "^[A-Z]$"
SNAP_GAP, SNAP_SHARE, MARGIN, MARGIN_SHARE = 18.0, 0.018, 12.0, 0.03
MOST = {"x": 18, "y": 8}
MARK, MARK_GAP, MARK_SHARE = r"^C\d+$", 28.0, 0.035


def spaced(values: Column, gap: float | Column) -> Column:
    """A list in order, without values nearer than gap to the last one kept."""
    return ragged.spaced(values, F.lit(gap) if isinstance(gap, float) else gap)


def nearest(values: Column, at: Column) -> Column:
    """Index of the value nearest to at, the first on ties; null for an empty list."""
    return F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - at).alias("d"), i.alias("i"))))["i"]


def _some(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<double>"))


def long_vectors(segments: DataFrame, crops: DataFrame, by: list[str]) -> DataFrame:
    """(by, axis, cluster, line): clusters of the ends of major grid lines in pixels, weighted by length.

    A segment counts that meets its crop, is straight and has 22 % of the crop's pixels across its axis as points. Ends
    outside the crop along the axis are left out.
    """
    rows = segments.join(crops, by)
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    length = F.hypot(dx, dy)
    enough = lambda side: length >= F.greatest(F.lit(LONG), F.col(side) * LONG_SHARE)
    meets = (F.least("x1", "x2") <= F.col("cx1")) & (F.greatest("x1", "x2") >= F.col("cx0")) & (F.least("y1", "y2") <= F.col("cy1")) & (F.greatest("y1", "y2") >= F.col("cy0"))
    axis = F.when((dx <= STRAIGHT) & enough("height_px"), "x").when((dy <= STRAIGHT) & enough("width_px"), "y")
    rows = rows.where(meets).withColumns({"axis": axis, "weight": length}).where("axis IS NOT NULL")
    upright = F.col("axis") == "x"
    rows = rows.withColumn("end", F.explode(F.when(upright, F.array("x1", "x2")).otherwise(F.array("y1", "y2"))))
    rows = rows.where(F.when(upright, F.col("end").between(F.col("cx0"), F.col("cx1"))).otherwise(F.col("end").between(F.col("cy0"), F.col("cy1"))))
    at = F.when(upright, to_pixel(F.col("end"), "cx0", "cx1", F.col("width_px"))).otherwise(to_pixel(F.col("end"), "cy0", "cy1", F.col("height_px")))
    tol = F.greatest(F.lit(LINE_GAP), F.least("width_px", "height_px") * LINE_SHARE)
    return cluster_weighted(rows.select(*by, "axis", at.alias("at"), "weight", tol.alias("tol")), [*by, "axis"], "at", "weight", F.col("tol"))


def bubble_labels(spans: DataFrame, crops: DataFrame, by: list[str]) -> DataFrame:
    """(by, axis, label, at): mean place in pixels of every axis label.

    Numbers of one or two digits in the bands along the top and bottom edge label x, single letters in the band along
    the left edge label y, in either case. Texts whose middle is outside the crop have no place on it.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    # Texts and places are columns before the join. A condition on them after it would go back before it and be written out
    # with all that they are made of; what is no label is a group of its own, which is dropped.
    told = spans.select(*by, F.upper(F.trim("text")).alias("raw"), x.alias("mx"), y.alias("my")).where(F.col("raw").rlike(f"{NUMBER}|{LETTER}"))
    rows = told.join(crops, by)
    band_x, band_y = (F.col("cx1") - F.col("cx0")) * BAND, (F.col("cy1") - F.col("cy0")) * BAND
    inside = (F.col("mx") >= F.col("cx0")) & (F.col("mx") <= F.col("cx1")) & (F.col("my") >= F.col("cy0")) & (F.col("my") <= F.col("cy1"))
    edge = (F.col("my") <= F.col("cy0") + band_y) | (F.col("my") >= F.col("cy1") - band_y)
    axis = F.when(inside & edge & F.col("raw").rlike(NUMBER), "x").when(inside & (F.col("mx") <= F.col("cx0") + band_x) & F.col("raw").rlike(LETTER), "y")
    rows = rows.withColumn("axis", axis)
    upright = F.col("axis") == "x"
    at = F.when(upright, to_pixel(F.col("mx"), "cx0", "cx1", F.col("width_px"))).otherwise(to_pixel(F.col("my"), "cy0", "cy1", F.col("height_px")))
    label = F.when(upright, F.col("raw").try_cast("int").cast("string")).when(F.col("axis") == "y", F.col("raw"))
    # a label tells its axis, which is therefore no key: conditions on keys go before the join as well
    found = rows.select(*by, upright.alias("up"), label.alias("label"), at.alias("at")).groupBy(*by, "label").agg(F.max("up").alias("up"), F.avg("at").alias("at"))
    return found.where("up IS NOT NULL").select(*by, F.when(F.col("up"), "x").otherwise("y").alias("axis"), "label", "at")


def within_labels(lines: Column, labels: Column, side: Column) -> Column:
    """Lines between the outer labels and a margin; all of them where fewer than two would stay."""
    margin = F.greatest(F.lit(MARGIN), side * MARGIN_SHARE)
    inside = F.filter(lines, lambda v: v.between(F.array_min(labels) - margin, F.array_max(labels) + margin))
    return F.when((F.size(labels) < 2) | (F.size(inside) < 2), lines).otherwise(inside)


def labelled_lines(labels: Column, vectors: Column, side: Column, most: Column) -> Column:
    """One line a label: the nearest vector that no earlier label has taken, else the label's own place."""
    gap = F.greatest(F.lit(SNAP_GAP), side * SNAP_SHARE)
    return F.slice(spaced(ragged.snapped_labels(F.sort_array(labels), vectors, gap * 3.0), gap * 0.6), 1, most)


def thinned_lines(lines: Column, side: Column, most: Column) -> Column:
    """Clustered lines; of more than most, those a gap apart from the first on, and the last if it is so too."""
    gap = F.greatest(F.lit(14.0), side * 0.04)
    last = F.try_element_at(lines, F.lit(-1))
    ended = lambda kept: F.when(last - F.try_element_at(kept, F.lit(-1)) >= gap, F.concat(kept, F.array(last))).otherwise(kept)
    return F.when(F.size(lines) <= most, lines).otherwise(once(F.slice(spaced(lines, gap), 1, most), ended))


def crop_grid(segments: DataFrame, spans: DataFrame, crops: DataFrame, by: list[str], clicks: DataFrame | None = None) -> DataFrame:
    """One row a crop and axis: lines (pixels, ascending), stations (millimetres from the lower left corner, in the order
    of the lines), mm_per_px, n_labels, n_clicks, source (labels or vectors).

    Two labels or more give the lines, on vectors where such are near; else the thinned vectors. Clicks (by, axis, at in
    pixels) add their clusters to an axis of two lines or more. MOST lines stay on an axis. Crops without any line
    have empty lists.
    """
    keys = [*by, "axis"]
    per_axis = crops.select("*", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("axis"))
    upright = F.col("axis") == "x"
    per_axis = per_axis.withColumns({
        "side": F.when(upright, F.col("width_px")).otherwise(F.col("height_px")).cast("double"), "most": F.when(upright, MOST["x"]).otherwise(MOST["y"]),
        "click_gap": F.greatest(F.lit(12.0), F.least("width_px", "height_px") * 0.018), "mm_per_px": axis_scale(upright),
    })
    kinds = [("vectors", long_vectors(segments, crops, by)), ("labels", bubble_labels(spans, crops, by).withColumnRenamed("at", "line"))]
    if clicks is not None:
        gap = F.greatest(F.lit(14.0), F.col("side") * 0.022)
        # clicks at one place are one row with their number
        places = clicks.groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("n")).join(per_axis.select(*keys, "side"), keys)
        kinds.append(("clicks", cluster_weighted(places.withColumn("tol", gap), keys, "at", "n", F.col("tol"))))
    rows = None
    for kind, lines in kinds:
        part = lines.select(*keys, F.lit(kind).alias("kind"), "line")
        rows = part if rows is None else rows.unionByName(part)
    lists = rows.groupBy(*keys).agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("line")))).alias(k) for k, _ in kinds))
    # an axis is few bytes and much work: axes are dealt to all partitions
    axes = dealt(per_axis.join(lists, keys, "left"))
    axes = axes.withColumns({k: _some(k) for k, _ in kinds})
    labelled = F.size("labels") >= 2
    # Each list is a column before the next one is made of it, so that no fold is written out twice in a plan. Lists of an
    # axis are clustered where they are, so that no axis is read twice.
    lists = {"coarse": ragged.means(F.col("vectors"), F.greatest(F.lit(10.0), F.col("side") * 0.025)), "fitted": labelled_lines(F.col("labels"), F.col("vectors"), F.col("side"), F.col("most"))}
    if clicks is not None:
        lists["apart"] = spaced(F.col("clicks"), F.greatest(F.lit(14.0), F.col("side") * 0.022) * 0.5)
    axes = axes.withColumns(lists)
    base = F.when(labelled, within_labels(F.col("fitted"), F.col("labels"), F.col("side")))
    axes = axes.withColumns({"lines": base.otherwise(thinned_lines(F.col("coarse"), F.col("side"), F.col("most"))), "n_labels": F.size("labels"), "source": F.when(labelled, "labels").otherwise("vectors")})
    if clicks is None:
        axes = axes.withColumn("n_clicks", F.lit(0))
    else:
        # the clusters of clicks join the lines; an axis of fewer than two lines has none
        axes = axes.withColumn("added", F.when(F.size("lines") >= 2, F.col("apart")).otherwise(F.array().cast("array<double>")))
        mixed = ragged.means(F.concat("lines", "added"), F.col("click_gap"))
        kept = F.slice(spaced(mixed, F.col("click_gap")), 1, F.col("most"))
        axes = axes.withColumns({"lines": F.when(F.size("added") > 0, kept).otherwise(F.col("lines")), "n_clicks": F.size("added")})
    axes = axes.withColumn("lines", spaced(F.col("lines"), F.greatest(F.lit(8.0), F.col("click_gap") * 0.5)))
    return axes.select(*keys, "lines", station_list(F.col("lines"), F.col("mm_per_px"), F.col("height_px"), upright).alias("stations"), "mm_per_px", "n_labels", "n_clicks", "source")


def axis_scale(upright: Column) -> Column:
    """Millimetres a pixel along an axis of a crop; crops without pixels have those of their points."""
    scale = lambda lo, hi, side: F.when(F.col(side) > 0, (F.col(hi) - F.col(lo)) * F.col("mm_per_pt") / F.col(side))
    along_x = F.coalesce(scale("cx0", "cx1", "width_px"), F.col("mm_per_pt"))
    return F.when(upright, along_x).otherwise(F.coalesce(scale("cy0", "cy1", "height_px"), along_x))


def station_list(lines: Column, mm_per_px: Column, height_px: Column, upright: Column) -> Column:
    """Millimetres of lines from the left edge, or from the lower edge for level lines."""
    return F.transform(lines, lambda v: F.round(F.when(upright, v).otherwise(height_px - v) * mm_per_px, 1))


def synced_axis(models: DataFrame, a: str) -> DataFrame:
    """Adds axis_x or axis_y, struct<lines, stations, bays, labels>, and end_x or end_y, the last given station, to models of
    lines_, stations_, bays_, mm_ and the crop's size.

    Two lines or more in pixels carry the axis, and stations follow from them; else the given stations stay, read as
    `axis_positions` does, or sums of the bays where fewer than two are given. Stations ascend on both axes.
    """
    side, height = F.col("width_px" if a == "x" else "height_px").cast("double"), F.col("height_px").cast("double")
    origin, scale = (F.lit(0.0), F.col(f"mm_{a}")) if a == "x" else (height, F.when(height.isNotNull(), -F.col(f"mm_{a}")))
    synced = ragged.synced(a == "y", STATION_TOL, MAX_LINES)
    gap = F.greatest(F.lit(8.0), side * 0.01)
    made = synced(_some(f"lines_{a}"), gap, F.coalesce(origin, F.lit(0.0)), F.coalesce(scale, F.lit(0.0)), _some(f"stations_{a}"), _some(f"bays_{a}"))
    return models.withColumns({f"axis_{a}": made["axis"], f"end_{a}": made["end"]})


def rebuilt_models(models: DataFrame) -> DataFrame:
    """Grid models after edits: axis_x and axis_y (lines, stations, bays, labels), mm_x, mm_y, span_x, span_y.

    models: width_px, height_px, lines_x, lines_y, stations_x, stations_y, bays_x, bays_y, mm_x, mm_y, span_x, span_y,
    any of them null but the sizes. Fewer than two stations are taken from the bays. A missing scale or span is 1, mm_y
    is mm_x; spans grow to the last station that is given.
    """
    positive = lambda c: F.nullif(F.col(c), F.lit(0.0))
    models = models.withColumn("mm_x", F.coalesce(positive("mm_x"), F.lit(1.0)))
    models = models.withColumn("mm_y", F.coalesce(positive("mm_y"), "mm_x"))
    for a in "xy":
        models = synced_axis(models, a)
    spans = {f"span_{a}": F.greatest(F.coalesce(positive(f"span_{a}"), F.lit(1.0)), f"end_{a}") for a in "xy"}
    return durable(models.withColumns(spans).drop(*(f"{c}_{a}" for a in "xy" for c in ("lines", "stations", "bays", "end"))), "grid-models")


def extracted_models(axes: DataFrame, crops: DataFrame, by: list[str]) -> DataFrame:
    """Rows of `crop_grid` as grid models, one a crop; spans are the last stations."""
    of = lambda a, c: F.max(F.when(F.col("axis") == a, F.col(c)))
    flat = axes.groupBy(*by).agg(*(of(a, c).alias(f"{n}_{a}") for a in "xy" for c, n in (("lines", "lines"), ("mm_per_px", "mm"))))
    none = F.array().cast("array<double>")
    rows = flat.join(crops.select(*by, "width_px", "height_px"), by).withColumns({f"{c}_{a}": none for a in "xy" for c in ("stations", "bays")})
    for a in "xy":
        rows = synced_axis(rows, a)
        rows = rows.withColumn(f"span_{a}", F.coalesce(F.try_element_at(f"axis_{a}.stations", F.lit(-1)), F.lit(1.0)))
    return durable(rows.drop(*(f"{c}_{a}" for a in "xy" for c in ("lines", "stations", "bays", "end"))), "grid-models")


def _snapped(points: DataFrame) -> DataFrame:
    """ix, iy and the places in pixels on the lines of both axes; indices and places stay where an axis has none."""
    both = (F.size("axis_x.lines") > 0) & (F.size("axis_y.lines") > 0)
    for a in "xy":
        points = points.withColumn(f"i{a}", F.when(both, nearest(F.col(f"axis_{a}.lines"), F.col(f"{a}_px"))).otherwise(F.coalesce(f"i{a}", F.lit(0))).cast("int"))
        points = points.withColumn(f"{a}_px", F.when(both, F.get(f"axis_{a}.lines", F.col(f"i{a}"))).otherwise(F.col(f"{a}_px")))
    return points


def _stations_at(points: DataFrame) -> DataFrame:
    """x_mm and y_mm by index, the last station beyond the list; without stations the column's own value, or 0."""
    at = lambda a: F.get(f"axis_{a}.stations", F.least(F.col(f"i{a}"), F.size(f"axis_{a}.stations") - 1))
    return points.withColumns({f"{a}_mm": F.coalesce(at(a), f"{a}_mm", F.lit(0.0)) for a in "xy"})


def rebuilt_columns(columns: DataFrame, models: DataFrame, by: list[str]) -> DataFrame:
    """Columns (by, ord, id, mark, x_px, y_px, x_mm, y_mm, ix, iy) on the axes of their models: moved into the crop, then
    onto the nearest lines, with the index and the station there. Columns on lines stay where they are.

    Index i reads line i and station i of an axis. On y lines run down and stations up, as in the editor's own tables.
    """
    read = (F.struct(f"axis_{a}.lines", f"axis_{a}.stations").alias(f"axis_{a}") for a in "xy")
    rows = columns.join(models.select(*by, "width_px", "height_px", *read), by)
    inside = lambda c, side: F.greatest(F.lit(0.0), F.least(F.col(side).cast("double"), F.col(c)))
    rows = _stations_at(_snapped(rows.withColumns({"x_px": inside("x_px", "width_px"), "y_px": inside("y_px", "height_px")})))
    return rows.withColumn("mark", F.coalesce(F.nullif("mark", F.lit("")), F.lit("C1"))).select(*by, "ord", "id", "mark", "x_px", "y_px", "x_mm", "y_mm", "ix", "iy")


def marked_columns(spans: DataFrame, crops: DataFrame, models: DataFrame, by: list[str]) -> DataFrame:
    """Columns at texts (seq, x0 .. y1, text) of C and a number near a crossing; the first in order of seq of each
    crossing. Models of fewer than two lines on an axis have none."""
    usable = models.where((F.size("axis_x.lines") >= 2) & (F.size("axis_y.lines") >= 2)).select(*by, "axis_x", "axis_y")
    raw = F.upper(F.regexp_replace(F.trim("text"), " ", ""))
    rows = spans.withColumn("mark", raw).where(F.col("mark").rlike(MARK)).join(crops.drop("mm_per_pt"), by).join(usable, by)
    places = {f"at_{a}": to_pixel((F.col(f"{a}0") + F.col(f"{a}1")) / 2, f"c{a}0", f"c{a}1", F.col(s)) for a, s in (("x", "width_px"), ("y", "height_px"))}
    rows = rows.withColumns(places | {"ix": F.lit(None).cast("int"), "iy": F.lit(None).cast("int"), "x_mm": F.lit(None).cast("double"), "y_mm": F.lit(None).cast("double")})
    rows = _stations_at(_snapped(rows.withColumns({"x_px": F.col("at_x"), "y_px": F.col("at_y")})))
    tol = F.greatest(F.lit(MARK_GAP), F.least("width_px", "height_px") * MARK_SHARE)
    rows = rows.where((F.abs(F.col("at_x") - F.col("x_px")) <= tol) & (F.abs(F.col("at_y") - F.col("y_px")) <= tol))
    first = F.min_by(F.struct("mark", "x_px", "y_px", "x_mm", "y_mm"), "seq")
    found = rows.groupBy(*by, "ix", "iy").agg(F.min("seq").alias("ord"), first.alias("c"))
    return found.select(*by, "ord", F.concat_ws("_", F.lit("detected"), "ix", "iy").alias("id"), "c.*", "ix", "iy")


def moved_columns(columns: DataFrame, versions: DataFrame, by: list[str]) -> DataFrame:
    """Columns (by, ord, ix, iy) carried to the next version of their axes (old_x, new_x, old_y, new_y: stations).

    A column keeps its place: its index becomes that of the nearest new station, the first on ties. One beyond the old
    stations keeps its index, or takes the last. Adds x_mm, y_mm and kept: its own stations are still there.
    """
    from .region import reindexed

    rows = columns.join(versions, by)
    old = {f"__{a}": F.get(f"old_{a}", F.col(f"i{a}")) for a in "xy"}
    rows = rows.withColumns(old | {f"i{a}": reindexed(F.col(f"i{a}"), F.col(f"old_{a}"), F.col(f"new_{a}")) for a in "xy"})
    rows = rows.withColumns({f"{a}_mm": F.get(f"new_{a}", F.col(f"i{a}")) for a in "xy"})
    kept = F.coalesce((F.col("__x") == F.col("x_mm")) & (F.col("__y") == F.col("y_mm")), F.lit(False))
    return rows.withColumn("kept", kept).drop("__x", "__y", "old_x", "new_x", "old_y", "new_y")


def model_placements(columns: DataFrame, models: DataFrame, by: list[str], profile: str = "HEB200", height: float = 6000.0) -> DataFrame:
    """Explicit placements of a model's columns, in their order (ord, 0 first), without another snap. Models of fewer
    than two stations on an axis give none."""
    usable = models.where((F.size("axis_x.stations") >= 2) & (F.size("axis_y.stations") >= 2)).select(*by)
    name = F.concat_ws("_", F.lit("col"), "ix", "iy", "ord")
    return columns.join(usable, by, "left_semi").select(*by, "ord", name.alias("placement_id"), "mark", F.round("x_mm", 1).alias("x_mm"), F.round("y_mm", 1).alias("y_mm"), F.lit(profile).alias("profile"), F.lit(height).alias("height_mm"))


def station_text(stations: Column) -> Column:
    """Stations as one text, whole numbers without a point."""
    text = lambda v: F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))
    return F.array_join(F.transform(stations, text), ", ")


def sparse_analysis(crops: DataFrame) -> DataFrame:
    """Adds x_mm, y_mm (stations from the first line on) and x_text, y_text to crops of lines_x, lines_y, mm_per_px.

    Without a scale the stations are the numbers of the lines. A first station of at most 1 is not moved.
    """
    scale = F.nullif("mm_per_px", F.lit(0.0))
    for a in "xy":
        at = F.when(scale.isNotNull(), F.transform(_some(f"lines_{a}"), lambda v: F.round(v * scale, 1))).otherwise(F.transform(_some(f"lines_{a}"), lambda v, i: i.cast("double")))
        crops = crops.withColumn(f"{a}_mm", at)
        first = F.get(f"{a}_mm", F.lit(0))
        crops = crops.withColumn(f"{a}_mm", F.when(first > 1, F.transform(f"{a}_mm", lambda v: F.round(v - F.get(f"{a}_mm", F.lit(0)), 1))).otherwise(F.col(f"{a}_mm")))
        crops = crops.withColumn(f"{a}_text", station_text(F.col(f"{a}_mm")))
    return crops
