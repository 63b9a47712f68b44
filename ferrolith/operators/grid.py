"""Structural grids: clusters of coordinates, dimension chains, quality, snapping, column placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of grid reconstruction (lines, millimetres, shares of a crop).
MAX_LINES, MAX_COLUMNS, STATION_TOL = 48, 400, 1.0
USABLE, KEPT, EDGE_MARGIN, EDGE_SHARE, MIN_SPACING = 20, 24, 0.04, 0.45, 0.03
MIN_DIM, MAX_DIM, MIN_BAY, MAX_BAY, MAX_STATIONS, BAND = 20, 120_000, 40.0, 25_000.0, 32, 0.22
NUMBER = r"\b\d{2,5}(?:\.\d+)?\b"


def chain_clusters(values: DataFrame, by: list[str], value: str, tol: float | Column) -> DataFrame:
    """Adds cluster: a new one starts where the gap to the previous value exceeds tol."""
    order = Window.partitionBy(*by).orderBy(value)
    new = F.coalesce(F.col(value) - F.lag(value).over(order) > tol, F.lit(True)).cast("int")
    return values.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def cluster_1d(values: DataFrame, by: list[str], value: str, tol: float | Column) -> DataFrame:
    """Mean of every cluster."""
    return chain_clusters(values, by, value, tol).groupBy(*by, "cluster").agg(F.avg(value).alias("line"), F.count(F.lit(1)).alias("n"))


def cluster_weighted(values: DataFrame, by: list[str], value: str, weight: str, tol: float | Column) -> DataFrame:
    """Weighted mean of every cluster; a weight sum of 0 counts as 1."""
    total = F.sum(weight)
    return chain_clusters(values, by, value, tol).groupBy(*by, "cluster").agg((F.sum(F.col(value) * F.col(weight)) / F.when(total == 0, 1.0).otherwise(total)).alias("line"))


def long_lines(segments: DataFrame, crops: DataFrame, min_length: float = 40.0, share: float = 0.22, tol: float = 6.0) -> DataFrame:
    """Per crop and axis: clustered middles of long vertical and horizontal segments, KEPT lines at most."""
    page = ["doc_id", "page_index"]
    w, h = F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    meets = (F.least("x1", "x2") <= F.col("cx1")) & (F.greatest("x1", "x2") >= F.col("cx0")) & (F.least("y1", "y2") <= F.col("cy1")) & (F.greatest("y1", "y2") >= F.col("cy0"))
    axis = F.when((dx <= tol) & (dy >= share * h), "x").when((dy <= tol) & (dx >= share * w), "y")
    rows = segments.join(crops, page).where(meets & (F.hypot(dx, dy) >= F.greatest(F.lit(min_length), share * F.least(w, h)))).withColumn("axis", axis).where("axis IS NOT NULL")
    rows = rows.withColumn("at", F.when(F.col("axis") == "x", (F.col("x1") + F.col("x2")) / 2).otherwise((F.col("y1") + F.col("y2")) / 2))
    near = F.greatest(F.lit(8.0), F.least(w, h) * 0.008)
    return cluster_1d(rows.withColumn("tol", near), [*page, "crop_id", "axis"], "at", F.col("tol")).where(F.col("cluster") <= KEPT)


def quality(lines: DataFrame, crops: DataFrame, by: list[str]) -> DataFrame:
    """Reasons against a grid: lines have by, axis, line; crops by, x0, y0, x1, y1. No reason: accepted."""
    place = Window.partitionBy(*by, "axis").orderBy("line")
    rows = lines.join(crops, by).withColumn("gap", F.lead("line").over(place) - F.col("line"))
    lo, hi = (F.when(F.col("axis") == "x", F.col(a)).otherwise(F.col(b)) for a, b in (("x0", "y0"), ("x1", "y1")))
    span = hi - lo
    edge = (F.col("line") <= lo + span * EDGE_MARGIN) | (F.col("line") >= hi - span * EDGE_MARGIN)
    stats = rows.groupBy(*by, "axis").agg(F.count(F.lit(1)).alias("n"), F.sum(edge.cast("int")).alias("e"), F.min("gap").alias("g"), F.first(span).alias("s"))
    of = lambda c, a: F.coalesce(F.max(F.when(F.col("axis") == a, F.col(c))), F.lit(0))
    flat = stats.groupBy(*by).agg(*(of(c, a).alias(c + a) for c in "negs" for a in "xy"))
    few = (F.col("nx") < 2) | (F.col("ny") < 2)
    many = (F.col("nx") > USABLE) | (F.col("ny") > USABLE)
    some = lambda c, name: F.when(c, F.lit(name))
    reasons = F.when(few, F.array(F.lit("too_few_lines"))).when(many, F.array(F.concat(F.lit("too_many_lines_x="), "nx", F.lit("_y="), "ny"))).otherwise(
        F.filter(
            F.array(
                some(F.col("ex") / F.col("nx") > EDGE_SHARE, "x_lines_on_crop_edges"), some(F.col("ey") / F.col("ny") > EDGE_SHARE, "y_lines_on_crop_edges"),
                some(F.col("gx") < F.col("sx") * MIN_SPACING, "x_lines_too_dense"), some(F.col("gy") < F.col("sy") * MIN_SPACING, "y_lines_too_dense"),
            ), lambda x: x.isNotNull())
    )
    return flat.select(*by, F.col("nx").alias("n_x"), F.col("ny").alias("n_y"), reasons.alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


def accepted_lines(lines: DataFrame, reports: DataFrame, by: list[str]) -> DataFrame:
    return lines.join(reports.where("accepted").select(*by), by, "left_semi")


def nearest_lines(points: DataFrame, lines: DataFrame, by: list[str], at: str, out: str) -> DataFrame:
    """Adds the nearest line and its index; the first on ties. A page has few lines: they travel as one array."""
    every = lines.groupBy(*by).agg(F.sort_array(F.collect_list("line")).alias("__lines"))
    best = F.array_min(F.transform("__lines", lambda v, i: F.struct(F.abs(v - F.col(at)).alias("d"), i.alias("i"), v.alias("v"))))
    return points.join(every, by).withColumn("__b", best).withColumns({f"{out}_line": F.col("__b.v"), f"{out}_index": F.col("__b.i")}).drop("__b", "__lines")


def snap_pins(pins: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """Pins (x, y, ord[, mark]) on their nearest x and y lines; a missing mark is C and the pin's number."""
    axis = lambda a: lines.where(F.col("axis") == a).select(*by, "line")
    rows = nearest_lines(nearest_lines(pins, axis("x"), by, "x", "x"), axis("y"), by, "y", "y")
    return rows.withColumn("mark", F.coalesce(F.nullif("mark", F.lit("")), F.concat(F.lit("C"), F.col("ord") + 1)))


def numbers(text: Column) -> Column:
    """Dimension numbers of a text, in order: 2 to 5 digits, within limits."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    return F.filter(found, lambda v: v.between(MIN_DIM, MAX_DIM))


def edge_numbers(spans: DataFrame, by: list[str]) -> DataFrame:
    """Numbers in the band of each edge of a crop (cx0 .. cy1), in reading order, repeated values once."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    w, h = F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")
    sides = (("bottom", y >= F.col("cy1") - BAND * h, x), ("top", y <= F.col("cy0") + BAND * h, x), ("left", x <= F.col("cx0") + BAND * w, -y), ("right", x >= F.col("cx1") - BAND * w, -y))
    edges = F.filter(F.array(*(F.when(c, F.struct(F.lit(n).alias("edge"), k.alias("key"))) for n, c, k in sides)), lambda e: e.isNotNull())
    rows = spans.select(*by, "seq", F.explode(edges).alias("e"), numbers(F.col("text")).alias("nums")).select(*by, "e.*", "seq", F.posexplode("nums").alias("pos", "value"))
    first = rows.groupBy(*by, "edge", "value").agg(F.min(F.struct("key", "seq", "pos")).alias("at"))
    return first.groupBy(*by, "edge").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda p: p["value"]).alias("numbers"))


def primary_row(spans: DataFrame, by: list[str], axis: str = "x", share: float = 0.12) -> DataFrame:
    """The outermost row of dimension texts along the bottom (x) or left (y) edge; repeated numbers stay."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    band = share * ((F.col("cy1") - F.col("cy0")) if axis == "x" else (F.col("cx1") - F.col("cx0")))
    inside, key, row = (y >= F.col("cy1") - band, x, y) if axis == "x" else (x <= F.col("cx0") + band, -y, -x)
    rows = spans.where(inside).select(*by, "seq", key.alias("key"), row.alias("row"), band.alias("band"), numbers(F.col("text")).alias("nums")).where(F.size("nums") > 0)
    outer = rows.groupBy(*by).agg(F.max("row").alias("outer"))
    kept = rows.join(outer, by).where(F.col("row") >= F.col("outer") - F.col("band") * 0.5)
    return kept.groupBy(*by).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("key", "seq", "nums"))), lambda p: p["nums"])).alias("numbers"))


def once(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def min_gap_fold(values: Column, gap: float | Column) -> Column:
    """Greedy thinning of a list: sorted, each kept value more than gap after the last kept one."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), start, lambda acc, v: F.when((F.size(acc) == 0) | (v - F.try_element_at(acc, F.lit(-1)) > gap), F.concat(acc, F.array(v))).otherwise(acc))


def dedupe_sort(values: Column) -> Column:
    """Distinct values from 0 on, ascending, more than the station tolerance apart."""
    return min_gap_fold(F.array_distinct(F.transform(values, lambda v: F.greatest(F.lit(0.0), v))), STATION_TOL)


def cumulated(bays: Column) -> Column:
    """0 and the running sums of all bays wider than the station tolerance."""
    wide = F.filter(bays, lambda b: b > STATION_TOL)
    steps = lambda w: F.aggregate(w, F.array(F.lit(0.0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b)))
    return once(wide, lambda w: F.when(F.size(w) == 0, F.array().cast("array<double>")).otherwise(steps(w)))


def widths(stations: Column) -> Column:
    return F.zip_with(F.slice(stations, 2, F.greatest(F.size(stations) - 1, F.lit(0))), F.slice(stations, 1, F.greatest(F.size(stations) - 1, F.lit(0))), lambda b, a: b - a)


def axis_positions(values: Column, mode: str = "compat") -> Column:
    """Stations where a list starts at 0, else the list read as bays; MAX_LINES at most.

    compat sorts and thins before it reads bays, so equal bays count once; ordered keeps order and repeats.
    """

    def read(seq: Column) -> Column:
        bays = F.filter(seq if mode == "compat" else values, lambda v: v > STATION_TOL)
        sums = once(bays, lambda b: F.when(F.size(b) >= 2, cumulated(b)).otherwise(seq))
        return F.when((F.size(seq) < 2) | (F.try_element_at(seq, F.lit(1)) <= STATION_TOL), seq).otherwise(sums)

    return F.slice(once(dedupe_sort(values), read), 1, MAX_LINES)


def valid_chain(stations: Column) -> Column:
    """2 to MAX_STATIONS stations from near 0, at most a fifth (or one) of the bays out of range."""

    def few_bad(bays: Column) -> Column:
        bad = F.size(F.filter(bays, lambda b: (b < MIN_BAY) | (b > MAX_BAY)))
        return bad <= F.greatest(F.lit(1), F.floor(F.size(bays) * 0.2))

    ok = lambda s: F.size(s).between(2, MAX_STATIONS) & (F.get(s, F.lit(0)) <= 80)
    return F.coalesce(once(stations, lambda s: ok(s) & once(widths(s), few_bad)), F.lit(False))


def chain_stations(nums: Column) -> Column:
    """Stations of an ordered row of dimension numbers: cumulative numbers, or bays with their repeats."""

    def read(seq: Column) -> Column:
        bays = F.filter(nums, lambda v: v > STATION_TOL)
        direct = (F.size(seq) >= 2) & (F.array_min(F.transform(nums, lambda v: F.greatest(F.lit(0.0), v))) <= STATION_TOL)
        return F.when(direct, seq).otherwise(once(bays, lambda b: F.when(F.size(b) >= 2, cumulated(b)).otherwise(seq)))

    return F.when(F.size(nums) < 2, F.array().cast("array<double>")).otherwise(once(axis_positions(nums), read))


def best_chain(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of candidate rows (ord, numbers) the longest valid chain of stations, the first of equal ones."""
    rows = candidates.withColumn("stations", chain_stations(F.col("numbers"))).where(valid_chain(F.col("stations")))
    return rows.groupBy(*by).agg(F.max_by("stations", F.struct(F.size("stations"), -F.col("ord"))).alias("stations"))


def snap_labels(labels: Column, vectors: Column, tol: float | Column) -> Column:
    """Labels in order take the nearest vector line within tol that no label has taken; else they keep their place."""
    zero = F.struct(F.array().cast("array<double>").alias("used"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        free = F.filter(vectors, lambda x: ~F.array_contains(acc["used"], x) & (F.abs(x - v) <= tol))
        best = F.array_min(F.transform(free, lambda x: F.struct(F.abs(x - v).alias("d"), x.alias("x"))))["x"]
        used = F.when(best.isNotNull(), F.concat(acc["used"], F.array(best))).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(F.coalesce(best, v))).alias("out"))

    return F.aggregate(labels, zero, step, lambda acc: F.array_sort(acc["out"]))


def vertices(lines: DataFrame, by: list[str]) -> DataFrame:
    """All crossings of the x and y lines of a page, numbered on both axes."""
    number = F.row_number().over(Window.partitionBy(*by, "axis").orderBy("line")) - 1
    rows = lines.withColumn("i", number)
    pick = lambda a, p, i: rows.where(F.col("axis") == a).select(*by, F.col("line").alias(p), F.col("i").alias(i))
    return pick("x", "vx", "ix").join(pick("y", "vy", "iy"), by)


def nearest_vertex(points: DataFrame, corners: DataFrame, by: list[str], radius: float = 18.0) -> DataFrame:
    """The nearest crossing within the radius, the last on ties. Cells of the radius' width turn the search into an
    equi-join with nine cells a point."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    # equal points are looked for once, and each of them gets the answer
    some = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("__n"))
    near = some.select("*", around.alias("c")).select(*some.columns, "c.cx", "c.cy")
    d = (F.col("vx") - F.col("x")) ** 2 + (F.col("vy") - F.col("y")) ** 2
    pairs = near.join(corners.withColumns({"cx": cell("vx"), "cy": cell("vy")}), [*by, "cx", "cy"]).withColumn("d2", d).where(F.col("d2") <= radius * radius)
    best = F.min_by(F.struct("vx", "vy", "ix", "iy", "d2"), F.struct("d2", -F.col("ix"), -F.col("iy")))
    found = pairs.groupBy(*some.columns).agg(best.alias("b"))
    return found.select(*points.columns, "b", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__k")).select(*points.columns, "b.*")


def column_placements(stations: DataFrame, by: list[str]) -> DataFrame:
    """Dense placements: every x station (axis, idx, mm) with every y station, row by row, MAX_COLUMNS at most."""
    pick = lambda a, n, i: stations.where(F.col("axis") == a).select(*by, F.col("mm").alias(n), F.col("idx").alias(i))
    rows = pick("x", "x", "ix").join(pick("y", "y", "iy"), by)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("iy", "ix"))
    return rows.withColumn("place", place).where(F.col("place") <= MAX_COLUMNS).withColumn("mark", F.concat(F.lit("C"), "place"))


def sparse_placements(cells: DataFrame, stations: DataFrame, by: list[str]) -> DataFrame:
    """Placements at given cells (ix, iy, ord): the first of each cell, those off the grid left out."""
    first = cells.groupBy(*by, "ix", "iy").agg(F.min("ord").alias("ord"))
    pick = lambda a, n, i: stations.where(F.col("axis") == a).select(*by, F.col("mm").alias(n), F.col("idx").alias(i))
    rows = first.join(pick("x", "x", "ix"), [*by, "ix"]).join(pick("y", "y", "iy"), [*by, "iy"])
    place = F.row_number().over(Window.partitionBy(*by).orderBy("ord"))
    return rows.withColumn("place", place).where(F.col("place") <= MAX_COLUMNS)


def placements_to_members(placements: DataFrame, height: float = 3000.0, profile: str = "HEB200") -> DataFrame:
    """Vertical members at placements."""
    return placements.select(
        "*", F.concat(F.lit("col_"), "place").alias("member_id"), F.lit(profile).alias("profile"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.lit(0.0).alias("sz"),
        F.col("x").alias("ex"), F.col("y").alias("ey"), F.lit(height).alias("ez"),
    )


def axis_labels(index: Column, axis: Column) -> Column:
    """Numbers along x, letters along y (26 at most)."""
    return F.when(axis == "x", (index + 1).cast("string")).otherwise(F.when(index < 26, F.char(index + 65)))


def confidence(has_x: Column, has_y: Column, sources: Column) -> Column:
    return F.least(F.lit(0.95), 0.55 + F.when(has_x, 0.2).otherwise(0.0) + F.when(has_y, 0.2).otherwise(0.0) + 0.05 * sources)


def millimetres(text: Column) -> Column:
    """A list of numbers separated by commas, semicolons or space; other pieces are skipped."""
    return F.filter(F.transform(F.split(text, r"[,;\s]+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def height_mm(value: Column) -> Column:
    """Heights under 100 are metres."""
    return F.when(value < 100, value * 1000).otherwise(value)
