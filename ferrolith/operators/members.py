"""Member models: checks, connectivity, profiles, classification, and expansion of grid intents.

Members have model_id, member_id, profile, sx, sy, sz, ex, ey, ez, seq; slabs model_id, slab_id, min_x .. max_z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, dealt, durable

I_FAMILIES, U_FAMILIES = ("IPE", "HEB", "HEA", "HEM"), ("UPN", "UPE")
#: Profiles that stand in for a family without a size.
FALLBACK = {"IPE": "IPE200", "HEB": "HEB200", "HEA": "HEA200", "HEM": "HEM200", "UPN": "UPN200", "UPE": "UPE200", "L": "L100x100x10", "RHS": "200x200x10", "CHS": "168.3x5"}


def member_length() -> Column:
    return F.sqrt((F.col("ex") - F.col("sx")) ** 2 + (F.col("ey") - F.col("sy")) ** 2 + (F.col("ez") - F.col("sz")) ** 2)


def plan_length() -> Column:
    return F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))


def sanitize(members: DataFrame, shortest: float = 1.0) -> DataFrame:
    """Drops members under a millimetre; repeated ids get _2, _3 and so on in order of seq."""
    kept = members.where(member_length() >= shortest)
    n = F.row_number().over(Window.partitionBy("model_id", "member_id").orderBy("seq"))
    return kept.withColumn("n", n).withColumn("member_id", F.when(F.col("n") > 1, F.concat("member_id", F.lit("_"), "n")).otherwise(F.col("member_id"))).drop("n")


def sound_slabs(slabs: DataFrame) -> DataFrame:
    return slabs.where((F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y")) & (F.col("max_z") > F.col("min_z")))


def validate(members: DataFrame) -> DataFrame:
    """Per model: members, near-zero lengths, ids that repeat, profiles that no catalog form fits, verdict."""
    unknown = resolved_profile(F.col("profile"))["key"].isNull()
    rows = members.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_members"), F.sum((member_length() < 1).cast("int")).alias("n_short"), (F.count("member_id") - F.countDistinct("member_id")).alias("n_repeated"), F.sum(unknown.cast("int")).alias("n_unknown")
    )
    return rows.withColumn("ok", (F.col("n_short") == 0) & (F.col("n_repeated") == 0))


def align(members: DataFrame, snap: float = 100.0) -> DataFrame:
    """Moves each model's smallest corner to the origin and snaps to 100 mm, half to even."""
    low = members.groupBy("model_id").agg(*(F.min(F.least(f"s{a}", f"e{a}")).alias(f"o{a}") for a in "xyz"))
    moved = {f"{p}{a}": F.bround((F.col(f"{p}{a}") - F.col(f"o{a}")) / snap) * snap for p in "se" for a in "xyz"}
    return members.join(low, "model_id").withColumns(moved).drop("ox", "oy", "oz")


def end_points(members: DataFrame) -> DataFrame:
    ends = F.posexplode(F.array(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z")), F.struct(F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z"))))
    return members.select("model_id", "member_id", ends.alias("end", "p")).select("model_id", F.concat_ws("/", F.col("model_id").cast("string"), "member_id", "end").alias("node"), "member_id", "p.*")


def close_pairs(points: DataFrame, tol: float) -> DataFrame:
    """Pairs (src, dst) of points of a model within tol: cells of that width, an equi-join with 27 cells a point,
    then the exact distance."""
    cell = lambda a: F.floor(F.col(a) / tol)
    home = points.select("model_id", "node", "x", "y", "z", *(cell(a).alias(f"c{a}") for a in "xyz"))
    near = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), (F.col("cz") + k).alias("cz")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    other = home.select("model_id", F.col("node").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), near.alias("c")).select("model_id", "dst", "x2", "y2", "z2", "c.*")
    pairs = home.join(other, ["model_id", "cx", "cy", "cz"]).where("node < dst")
    d2 = (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 + (F.col("z") - F.col("z2")) ** 2
    return pairs.where(d2 <= tol * tol).select(F.col("node").alias("src"), "dst")


def connectivity(members: DataFrame, tol: float = 400.0) -> DataFrame:
    """Per model: end point clusters within tol, the largest, end points on their own, spans, fragmentation.

    Ends that coincide in a cell of tol / 2 (diagonal under tol) are linked to one of them first, so a crowded joint
    gives as many links as ends and not their square; only one end of each such cell looks for others.
    """
    ends = end_points(members)
    fine = [F.floor(F.col(a) / (tol / 2)).alias(f"f{a}") for a in "xyz"]
    celled = ends.select("*", *fine)
    key = ["model_id", "fx", "fy", "fz"]
    first = celled.groupBy(*key).agg(F.min("node").alias("head"))
    inner = celled.join(first, key).where("node <> head").select(F.col("node").alias("src"), F.col("head").alias("dst"))
    links = inner.union(_cell_links(celled, first, key, tol))
    groups = ends.select("model_id", "node").join(connected_components(links), "node", "left").select("model_id", F.coalesce("component", "node").alias("c"))
    sizes = groups.groupBy("model_id", "c").agg(F.count(F.lit(1)).alias("n"))
    report = sizes.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_clusters"), F.max("n").alias("largest"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("n_floating"))
    span = members.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_members"), *((F.max(F.greatest(f"s{a}", f"e{a}")) - F.min(F.least(f"s{a}", f"e{a}"))).alias(f"span_{a}") for a in "xyz"))
    rows = span.join(report, "model_id")
    n = F.col("n_members")
    broken = (n < 8) | ((F.col("n_clusters") >= 3) & (F.col("largest") < n * 0.6)) | (F.col("n_floating") > F.greatest(F.lit(4), F.floor(n / 2)))
    return rows.withColumn("fragmented", broken)


def _cell_links(celled: DataFrame, first: DataFrame, key: list[str], tol: float) -> DataFrame:
    """For each pair of neighbouring fine cells with ends within tol, one link between their first ends."""
    reach = range(-3, 4)
    steps = [(i, j, k) for i in reach for j in reach for k in reach if (i, j, k) > (0, 0, 0) and sum(max(0, abs(v) - 1) ** 2 for v in (i, j, k)) <= 4]
    offsets = F.explode(F.array(*(F.struct((F.col("fx") + i).alias("fx"), (F.col("fy") + j).alias("fy"), (F.col("fz") + k).alias("fz")) for i, j, k in steps)))
    heads = first.select("model_id", "head", offsets.alias("o"), F.struct("fx", "fy", "fz").alias("from")).select("model_id", "head", "from", "o.*")
    cells = heads.join(first.select(*key, F.col("head").alias("other")), key)
    points = celled.groupBy(*key).agg(F.collect_set(F.struct("x", "y", "z")).alias("pts"))
    mine = cells.join(points, key).join(points.select("model_id", F.struct("fx", "fy", "fz").alias("from"), F.col("pts").alias("pts2")), ["model_id", "from"])
    near = lambda a, b: (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2 <= tol * tol
    return mine.where(F.exists("pts", lambda a: F.exists("pts2", lambda b: near(a, b)))).select(F.col("head").alias("src"), F.col("other").alias("dst"))


def upright(ratio: float = 0.95, plan: float = 0.5) -> Column:
    n = member_length()
    return (n > 0.5) & (F.abs(F.col("ez") - F.col("sz")) / n >= ratio) & (plan_length() <= plan)


def classify(members: DataFrame) -> DataFrame:
    """Columns and beams with length, direction, main axis and base position; zero-length members are left out."""
    n = member_length()
    d = lambda a: F.col(f"e{a}") - F.col(f"s{a}")
    col = upright()
    return members.where(n > 0.5).select(
        "model_id", "member_id", F.when(col, "column").otherwise("beam").alias("category"), n.alias("length"), F.when(~col, F.array(*(d(a) / n for a in "xyz"))).alias("direction"),
        F.when(~col, F.when(F.abs(d("x")) >= F.abs(d("y")), "X").otherwise("Y")).alias("axis"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.when(col, F.least("sz", "ez")).otherwise(F.col("sz")).alias("z"),
    )


def slab_elements(slabs: DataFrame) -> DataFrame:
    """Extents, middle and top of sound slabs."""
    return sound_slabs(slabs).select("model_id", "slab_id", *((F.col(f"max_{a}") - F.col(f"min_{a}")).alias(f"size_{a}") for a in "xyz"), ((F.col("min_x") + F.col("max_x")) / 2).alias("x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("y"), F.col("max_z").alias("top"))


def placeholder(members: DataFrame, most: int = 24) -> DataFrame:
    """Per model: whether it looks like the stock answer of four corner columns and a ring of beams."""
    q = lambda c: F.bround(c / 500).cast("long")
    col = upright(0.95, 25.0)
    rises = F.col("sz") <= F.col("ez") + 1
    base = F.struct(q(F.when(rises, F.col("sx")).otherwise(F.col("ex"))), q(F.when(rises, F.col("sy")).otherwise(F.col("ey"))))
    span = lambda a: F.max(F.greatest(f"s{a}", f"e{a}")) - F.min(F.least(f"s{a}", f"e{a}"))
    rows = members.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(col.cast("int")).alias("v"), F.count_distinct(F.when(col, base)).alias("bases"), F.count_distinct(F.when(~col, q(F.least("sz", "ez")))).alias("levels"), span("x").alias("wx"), span("y").alias("wy")
    )
    square = (F.col("wx") >= 2000) & (F.col("wy") >= 2000) & (F.col("wx") / F.col("wy")).between(0.35, 2.8)
    return rows.select("model_id", (F.col("n").between(6, most) & (F.col("v") == 4) & (F.col("bases") == 4) & square & (F.col("n") - F.col("v") <= 14) & (F.col("levels") <= 4)).alias("placeholder"))


def plain(number: Column) -> Column:
    """A number as text without a trailing .0."""
    return F.regexp_replace(number.cast("double").cast("string"), r"\.0$", "")


def resolved_profile(name: Column) -> Column:
    """struct<key, family, shape, dims> of a designation; null key where no form fits.

    Tabulated sizes come from a catalog join; the dimensions here are the approximations for sizes without one.
    """
    t = F.trim(name)
    u = F.upper(t)
    family = F.regexp_extract(u, rf"^({'|'.join(I_FAMILIES + U_FAMILIES)})(\d{{2,3}})$", 1)
    size = F.regexp_extract(u, r"(\d{2,3})$", 1).try_cast("double")
    angle = [F.regexp_extract(u, r"^L\s*(\d+)\s*[X×/]\s*(\d+)\s*[X×/]\s*(\d+(?:\.\d+)?)$", i).try_cast("double") for i in (1, 2, 3)]
    pipe = [F.regexp_extract(u, r"^CHS\s*(\d+(?:\.\d+)?)\s*[X×/]\s*(\d+(?:\.\d+)?)$", i).try_cast("double") for i in (1, 2)]
    box = [F.regexp_extract(F.regexp_replace(u, r"\s", ""), r"^(?:RHS|SHS)?(\d+)[X×/](\d+)[X×/](\d+(?:\.\d+)?)$", i).try_cast("double") for i in (1, 2, 3)]
    square = [F.regexp_extract(F.regexp_replace(u, r"\s", ""), r"^SHS(\d+)[X×/](\d+(?:\.\d+)?)$", i).try_cast("double") for i in (1, 2)]
    wide = F.when(family.isin("HEB", "HEA", "HEM"), 1.0).otherwise(0.5)

    def made(key: Column, fam, shape: str, dims: list[Column]) -> Column:
        return F.struct(key.alias("key"), (fam if isinstance(fam, Column) else F.lit(fam)).alias("family"), F.lit(shape).alias("shape"), F.array(*dims).alias("dims"))

    return (
        F.when(family.isin(*I_FAMILIES), made(u, family, "I", [size, size * wide, F.greatest(size * 0.045, F.lit(6.0)), F.greatest(size * 0.075, F.lit(8.0))]))
        .when(family.isin(*U_FAMILIES), made(u, family, "U", [size, F.greatest(size * 0.35, F.lit(30.0)), F.greatest(size * 0.05, F.lit(4.0)), F.greatest(size * 0.08, F.lit(6.0))]))
        .when(angle[0].isNotNull(), made(F.concat(F.lit("L"), plain(angle[0]), F.lit("x"), plain(angle[1]), F.lit("x"), plain(angle[2])), "L", "L", angle))
        .when(pipe[0].isNotNull(), made(F.concat(F.lit("CHS"), plain(pipe[0]), F.lit("x"), plain(pipe[1])), "CHS", "CHS", pipe))
        .when(square[0].isNotNull(), made(F.concat(plain(square[0]), F.lit("x"), plain(square[0]), F.lit("x"), plain(square[1])), "RHS", "RHS", [square[0], square[0], square[1]]))
        .when(box[0].isNotNull(), made(F.concat(plain(box[0]), F.lit("x"), plain(box[1]), F.lit("x"), plain(box[2])), "RHS", "RHS", box))
        .otherwise(made(F.lit(None).cast("string"), F.lit(None).cast("string"), "", [F.lit(None).cast("double")]))
    )


def apply_catalog(rows: DataFrame, catalog: DataFrame, aliases: DataFrame, column: str = "profile") -> DataFrame:
    """Adds key, family, dims: alias, then tabulated dimensions, then approximated ones, then the HEB fallback.

    catalog (family, key, dims) and aliases (alias, key) are joined as their sizes allow; Spark chooses.
    """
    named = aliases.select(F.lower("alias").alias("__a"), F.col("key").alias("__target"))
    out = rows.join(named, F.lower(F.trim(column)) == F.col("__a"), "left")
    out = out.withColumn("__r", resolved_profile(F.coalesce("__target", column)))
    out = out.withColumn("__r", F.when(F.col("__r.key").isNull(), resolved_profile(F.lit(FALLBACK["HEB"]))).otherwise(F.col("__r")))
    table = catalog.select(F.col("key").alias("__k"), F.col("dims").alias("__dims"))
    out = out.join(table, F.col("__r.key") == F.col("__k"), "left")
    return out.select(*rows.columns, F.col("__r.key").alias("key"), F.col("__r.family").alias("family"), F.col("__r.shape").alias("shape"), F.coalesce("__dims", "__r.dims").alias("dims"))


def _with_bays(rows: DataFrame) -> DataFrame:
    """Rows beside the number and the size of even bays along x, as columns: a list of lines reads them once a line."""
    bays = F.greatest(F.lit(1), F.bround(F.col("length_x_mm") / F.col("bay_spacing_x_mm")).cast("int"))
    return rows if "__bay" in rows.columns else rows.withColumn("__bays", bays).withColumn("__bay", F.col("length_x_mm") / F.col("__bays"))


def _x_array() -> Column:
    """Frame lines along x, of rows `_with_bays`: given ones if there are two, else even bays."""
    even = F.transform(F.sequence(F.lit(0), F.col("__bays")), lambda i: i * F.col("__bay"))
    given = F.col("frame_line_x_mm")
    return F.when(F.size(given) >= 2, F.array_sort(given)).otherwise(even)


def _y_array() -> Column:
    given = F.col("frame_line_y_mm")
    return F.when(F.size(given) >= 1, given).otherwise(F.array(F.lit(0.0), F.col("width_y_mm")))


def placed(groups: DataFrame, grids: DataFrame, levels: DataFrame) -> DataFrame:
    """Groups beside their model's grid, eave and ridge: what all expansions need, so that none has to join."""
    lines = ["length_x_mm", "width_y_mm", "bay_spacing_x_mm", "frame_line_x_mm", "frame_line_y_mm"]
    return groups.join(grids.select("model_id", *lines).hint("merge"), "model_id").join(_roof_levels(levels).hint("merge"), "model_id", "left")


def on_grid(groups: DataFrame, grids: DataFrame | None) -> DataFrame:
    """Groups beside their model's size and frame lines (xs, ys), with the first and last of each.

    The one join of an expansion, by sorted keys: tables of a model each are never collected for a broadcast. Without
    grids the groups are `placed` ones.
    """
    end = lambda c, last: F.get(c, F.size(c) - 1 if last else F.lit(0))
    ends = {"last_ix": F.size("xs") - 1, "low_ix": end("xs", False), "high_ix": end("xs", True), "last_iy": F.size("ys") - 1, "low_iy": end("ys", False), "high_iy": end("ys", True)}
    if grids is None:
        return _with_bays(groups).withColumns({"xs": _x_array(), "ys": _y_array()}).withColumns(ends)
    sizes = _with_bays(grids).select("model_id", "length_x_mm", "width_y_mm", _x_array().alias("xs"), _y_array().alias("ys"))
    return groups.join(sizes.hint("merge"), "model_id").withColumns(ends)


def _along_x(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.posexplode("xs").alias("ix", "x"))


def _along_y(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.posexplode("ys").alias("iy", "y"))


def with_levels(groups: DataFrame, levels: DataFrame) -> DataFrame:
    """Groups with the elevations z0 and z1 of their levels; groups that name unknown levels are left out."""
    z = lambda name, out: levels.select("model_id", F.col("name").alias(name), F.col("elevation_mm").cast("double").alias(out))
    return groups.join(z("start_level", "z0").hint("merge"), ["model_id", "start_level"]).join(z("end_level", "z1").hint("merge"), ["model_id", "end_level"])


def _numbered(rows: DataFrame, *order: str, category: Column | None = None, most: str | None = None) -> DataFrame:
    """Members of each group, numbered; only as many of them as the column most says, if it is not null."""
    if most is not None:  # only these need their numbers when members are counted
        limited = _numbered(rows.where(F.col(most).isNotNull()).withColumn("__most", F.col(most)), *order, category=category)
        return _numbered(rows.where(F.col(most).isNull()), *order, category=category).unionByName(limited)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("model_id", "group_id").orderBy(*order)))
    rows = rows.where("n <= __most") if "__most" in rows.columns else rows
    return rows.select("model_id", "group_id", "n", F.concat("group_id", F.lit("_"), "n").alias("member_id"), (category if category is not None else F.col("category")).alias("category"), "profile", *(F.col(c).cast("double").alias(c) for c in ("sx", "sy", "sz", "ex", "ey", "ez")))


def expand_vertical(groups: DataFrame, grids: DataFrame | None) -> DataFrame:
    """Columns at all crossings, the corners, or along the lowest or highest y line."""
    rows = _along_y(_along_x(on_grid(groups.where("orientation = 'vertical'"), grids)))
    edge_x, edge_y = F.col("ix").isin(0) | (F.col("ix") == F.col("last_ix")), F.col("iy").isin(0) | (F.col("iy") == F.col("last_iy"))
    a = F.col("assigned_to_grid")
    keep = F.when(a == "all_frame_lines", True).when(a == "perimeter", edge_x & edge_y).when(a == "along_all_x_at_y_min", F.col("iy") == 0).when(a == "along_all_x_at_y_max", F.col("iy") == F.col("last_iy")).otherwise(False)
    rows = rows.where(keep).withColumns({"sx": F.col("x"), "sy": F.col("y"), "sz": F.col("z0"), "ex": F.col("x"), "ey": F.col("y"), "ez": F.col("z1")})
    return _numbered(rows, "ix", "iy", category=F.lit("column"))


def expand_horizontal(groups: DataFrame, grids: DataFrame | None) -> DataFrame:
    """Members along x between neighbouring frame lines, spread over y, at one y line; members along y per frame,
    at frame ends, or spread over x. Limits on x and on the number of members apply."""
    g = on_grid(groups, grids)
    inside = (F.coalesce(F.col("x") >= F.col("x_min_mm") - 0.5, F.lit(True))) & (F.coalesce(F.col("x") <= F.col("x_max_mm") + 0.5, F.lit(True)))
    on = lambda c: c.withColumns({"sz": F.col("z0"), "ez": F.col("z1")})
    a, o = F.col("assigned_to_grid"), F.col("orientation")
    near = _along_x(g).where(inside)
    stations = F.filter("xs", lambda x: F.coalesce(x >= F.col("x_min_mm") - 0.5, F.lit(True)) & F.coalesce(x <= F.col("x_max_mm") + 0.5, F.lit(True)))
    own = F.array_sort("y_at_mm") if "y_at_mm" in groups.columns else F.lit(None).cast("array<double>")
    bays = g.where((o == "horizontal_x") & a.isin("along_x_between_columns", "along_x_at_each_y_line")).withColumn("near", stations).where(F.size("near") > 1)
    bays = bays.select("*", F.posexplode(F.slice("near", F.lit(2), F.size("near") - 1)).alias("ix", "x")).withColumn("sx", F.get("near", F.col("ix"))).where("sx IS NOT NULL")
    bays = bays.select("*", F.posexplode(F.coalesce(own, F.col("ys"))).alias("iy", "y"))
    out = [_numbered(on(bays.withColumns({"ex": F.col("x"), "sy": F.col("y"), "ey": F.col("y")})), "iy", "ix", most="member_count")]
    reaching = lambda rows: rows.withColumn("near", stations).where(F.size("near") > 0).withColumns({"sx": F.array_min("near"), "ex": F.array_max("near")})
    lo, hi = F.coalesce("y_min_mm", F.lit(0.0)), F.coalesce("y_max_mm", F.col("width_y_mm"))
    count = F.bround(F.greatest(hi - lo, F.lit(1e-6)) / F.col("spacing_mm")).cast("int")
    spread = reaching(g.where((o == "horizontal_x") & (a == "distributed_along_y") & (F.col("spacing_mm") > 0))).withColumn("i", F.explode(F.sequence(F.lit(0), count))).withColumn("sy", lo + F.col("i") * F.col("spacing_mm"))
    spread = spread.where(((lo <= 1e-6) & (hi >= F.col("width_y_mm") - 1e-6)) | (F.col("sy") <= hi + 1e-6))
    out.append(_numbered(on(spread.withColumn("ey", F.col("sy"))), "i"))
    top = reaching(g.where((o == "horizontal_x") & a.isin("along_x_at_y_max", "along_x_at_fixed_y")))
    top = top.withColumn("sy", F.when(a == "along_x_at_y_max", F.col("high_iy")).otherwise(F.coalesce("y_max_mm", "y_min_mm", "low_iy"))).withColumn("ey", F.col("sy"))
    out.append(_numbered(on(top), "sy"))
    frames = near.where((o == "horizontal_y_per_frame") | ((o == "horizontal_y") & (a == "along_y_per_x_station")))
    frames = frames.withColumns({"sx": F.col("x"), "ex": F.col("x"), "sy": F.when(o == "horizontal_y", F.coalesce("y_from_mm", "low_iy")).otherwise(F.col("low_iy")), "ey": F.when(o == "horizontal_y", F.coalesce("y_to_mm", "high_iy")).otherwise(F.col("high_iy"))})
    out.append(_numbered(on(frames), "ix"))
    ends = g.where((o == "horizontal_y") & a.isin("along_y_at_frame_ends", "along_y_at_x_min", "along_y_at_x_max") & F.col("xs").isNotNull())
    which = F.when(a == "along_y_at_frame_ends", F.array("low_ix", "high_ix")).when(a == "along_y_at_x_min", F.array("low_ix")).otherwise(F.array("high_ix"))
    ends = ends.select("*", F.posexplode(which).alias("i", "sx")).withColumns({"ex": F.col("sx"), "sy": F.col("low_iy"), "ey": F.col("high_iy")})
    out.append(_numbered(on(ends), "i"))
    x0, x1 = F.coalesce("x_min_mm", F.lit(0.0)), F.coalesce("x_max_mm", F.col("length_x_mm"))
    wide = g.where((o == "horizontal_y") & (a == "distributed_along_x") & (F.col("spacing_mm") > 0)).withColumn("i", F.explode(F.sequence(F.lit(0), F.bround((x1 - x0) / F.col("spacing_mm")).cast("int"))))
    wide = wide.withColumns({"sx": x0 + F.col("i") * F.col("spacing_mm"), "sy": F.coalesce("y_from_mm", "low_iy"), "ey": F.coalesce("y_to_mm", "high_iy")}).withColumn("ex", F.col("sx"))
    out.append(_numbered(on(wide), "i"))
    # the frame line nearest to the stated x, of two the lower one
    gap = Window.partitionBy("model_id", "group_id").orderBy(F.abs(F.col("x") - F.col("x_min_mm")), "ix")
    fixed = near.where((o == "horizontal_y") & (a == "along_y_at_fixed_x") & F.col("x_min_mm").isNotNull()).withColumn("__k", F.row_number().over(gap)).where("__k = 1")
    fixed = fixed.withColumns({"sx": F.col("x"), "ex": F.col("x"), "sy": F.coalesce("y_min_mm", "low_iy"), "ey": F.coalesce("y_max_mm", "high_iy")})
    out.append(_numbered(on(fixed), "sx"))
    slope = _along_x(g.where(o == "inclined_y")).withColumns({"sx": F.col("x"), "ex": F.col("x"), "sy": F.col("low_iy"), "ey": F.col("high_iy")})
    out.append(_numbered(on(slope), "ix"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def roof_z(y: Column, width: Column, eave: Column, ridge: Column, ridge_y: Column) -> Column:
    """Height of a dual-slope roof over y."""
    centre = F.when((ridge_y <= 1e-6) | (F.abs(ridge_y - width) <= 1e-6), width / 2).otherwise(ridge_y)
    return F.when(y <= centre, eave + (ridge - eave) * (y / centre)).otherwise(ridge - (ridge - eave) * ((y - centre) / F.greatest(width - centre, F.lit(1e-6))))


def _roof_levels(levels: DataFrame) -> DataFrame:
    level = lambda n: F.max(F.when(F.col("name") == n, F.col("elevation_mm"))).cast("double").alias(n.lower())
    return levels.groupBy("model_id").agg(level("Eave"), level("Ridge"))


def _under_roof(groups: DataFrame, grids: DataFrame | None, levels: DataFrame | None) -> DataFrame:
    """Groups beside their model's eave and ridge levels (null where missing), the ridge line, the width, frame lines and
    outer walls. Without grids the groups are `placed` ones."""
    lines = F.col("frame_line_y_mm")
    ridge_y = F.when(F.size(lines) >= 3, F.get(lines, F.floor(F.size(lines) / 2).cast("int"))).otherwise(F.col("width_y_mm") / 2)
    columns = {"width": F.col("width_y_mm"), "span": F.col("length_x_mm"), "ridge_y": ridge_y, "xs": _x_array(), "low_iy": F.get(_y_array(), F.lit(0)), "high_iy": F.get(_y_array(), F.size(_y_array()) - 1)}
    if grids is None:
        return _with_bays(groups).withColumns(columns)
    sizes = _with_bays(grids).select("model_id", *(c.alias(n) for n, c in columns.items()))
    return groups.join(sizes.join(_roof_levels(levels).hint("merge"), "model_id", "left").hint("merge"), "model_id")


def expand_rafters(groups: DataFrame, grids: DataFrame | None, levels: DataFrame | None) -> DataFrame:
    """Two rafters a frame, from both eaves to the ridge line."""
    rows = _under_roof(groups.where("orientation = 'inclined_dual_y'"), grids, levels)
    e, r = F.coalesce("eave", "z0"), F.coalesce("ridge", "z1")
    side = lambda i, y0, za, y1, zb: F.struct(F.lit(i).alias("i"), y0.alias("sy"), za.alias("sz"), y1.alias("ey"), zb.alias("ez"))
    rows = rows.select("*", F.explode(F.array(side(0, F.lit(0.0), e, F.col("ridge_y"), r), side(1, F.col("ridge_y"), r, F.col("width"), e))).alias("s")).select("*", "s.*")
    return _numbered(_along_x(rows).withColumns({"sx": F.col("x"), "ex": F.col("x")}), "ix", "i")


def expand_truss(groups: DataFrame, grids: DataFrame | None, levels: DataFrame | None) -> DataFrame:
    """Web members of trusses over all frames: Warren panels, or verticals and alternating diagonals."""
    rows = _under_roof(groups.where("orientation = 'truss_web_panels'"), grids, levels)
    rows = rows.withColumns({"e": F.coalesce("eave", F.least("z0", "z1")), "r": F.coalesce("ridge", F.greatest("z0", "z1"))}).where("r > e + 1e-6")
    panels = F.greatest(F.lit(2), F.coalesce(F.nullif(F.col("member_count").cast("int"), F.lit(0)), F.greatest(F.lit(4), F.bround(F.col("width") / F.greatest(F.coalesce("spacing_mm", F.lit(2500.0)), F.lit(1.0))).cast("int"))))
    rows = rows.withColumn("panels", panels).withColumn("warren", F.lower("assigned_to_grid").contains("warren") | F.lower("group_id").contains("warren"))
    # one frame's members first: all frames have the same
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("panels"))))
    node = lambda i: F.col("width") * i / F.col("panels")
    high = lambda y: roof_z(y, F.col("width"), F.col("e"), F.col("r"), F.col("ridge_y"))
    rows = rows.withColumns({"y0": node(F.col("i")), "y1": node(F.col("i") + 1)}).withColumns({"h0": high(F.col("y0")), "h1": high(F.col("y1"))})
    y0, y1, h0, h1, e = (F.col(c) for c in ("y0", "y1", "h0", "h1", "e"))
    web = lambda kind, a, za, b, zb: F.struct(F.lit(kind).alias("kind"), a.alias("sy"), za.alias("sz"), b.alias("ey"), zb.alias("ez"))
    up, down, back = web(1, y0, e, y1, h1), web(1, y0, h0, y1, e), web(1, y1, e, y0, h0)
    even = F.col("i") % 2 == 0
    diagonal = F.when(F.col("i") < F.col("panels"), F.when(even, up).when(~F.col("warren"), back).when(h0 > e + 1e-6, down).otherwise(up))
    upright_ = F.when(~F.col("warren") & F.col("i").between(1, F.col("panels") - 1) & (F.abs(h0 - e) > 1e-6), web(0, y0, e, y0, h0))
    rows = rows.select("*", F.explode(F.array(upright_, diagonal)).alias("m")).where("m IS NOT NULL").select("*", "m.*")
    rows = rows.where((F.abs(F.col("sy") - F.col("ey")) > 1e-6) | (F.abs(F.col("sz") - F.col("ez")) > 1e-6))
    rows = _along_x(rows).withColumns({"sx": F.col("x"), "ex": F.col("x")})
    return _numbered(rows, "ix", "kind", "i")


def expand_purlins(groups: DataFrame, grids: DataFrame | None, levels: DataFrame | None) -> DataFrame:
    """Purlins on both slopes; girts at fixed heights on both outer walls."""
    base = _under_roof(groups.where(F.col("orientation").isin("roof_purlins_dual_slope", "wall_girts_fixed_z")), grids, levels)
    p = base.where("orientation = 'roof_purlins_dual_slope'").withColumn("k", F.coalesce(F.col("member_count").cast("int"), F.lit(6)))
    p = p.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k"))))
    share = F.col("i") / (F.col("k") + 1)
    p = p.select("*", F.posexplode(F.array(F.col("ridge_y") * share, F.col("ridge_y") + (F.col("width") - F.col("ridge_y")) * share)).alias("side", "sy"))
    z = roof_z(F.col("sy"), F.col("width"), F.coalesce("eave", "z0"), F.coalesce("ridge", "z1"), F.col("ridge_y"))
    p = _numbered(p.withColumns({"sz": z, "ez": z, "ey": F.col("sy"), "sx": F.lit(0.0), "ex": F.col("span")}), "i", "side")
    heights = F.coalesce("fixed_elevations_mm", F.array(*map(F.lit, (1500.0, 3000.0, 4500.0, 5800.0))))
    w = base.where("orientation = 'wall_girts_fixed_z'").select("*", F.posexplode(heights).alias("i", "sz"))
    w = w.select("*", F.posexplode(F.array("low_iy", "high_iy")).alias("side", "sy")).withColumns({"ez": F.col("sz"), "ey": F.col("sy"), "sx": F.lit(0.0), "ex": F.col("span")})
    return p.unionByName(_numbered(w, "i", "side"))


def expand_diagonals(groups: DataFrame, grids: DataFrame | None) -> DataFrame:
    """Braces in the first and last bay on every y line, or at the four corners."""
    g = on_grid(groups.where("orientation = 'diagonal_plan'"), grids).where("xs IS NOT NULL")
    bay = g.where("assigned_to_grid = 'first_and_last_bay_braces' AND last_ix >= 1").withColumn("k0", F.explode(F.array(F.lit(0), F.col("last_ix") - 1))).withColumn("k1", F.col("k0") + 1)
    bay = _along_y(bay).withColumns({"sx": F.get("xs", F.col("k0")), "ex": F.get("xs", F.col("k1")), "sy": F.col("y"), "ey": F.col("y"), "sz": F.col("z0"), "ez": F.col("z1")})
    out = _numbered(bay, "k0", "iy", category=F.lit("brace"))
    c = g.where("assigned_to_grid = 'corner_braces'").select("*", F.posexplode(F.array("low_ix", "high_ix")).alias("i", "sx")).select("*", F.posexplode(F.array("low_iy", "high_iy")).alias("j", "sy"))
    off = F.coalesce("brace_offset_x_mm", F.lit(1000.0))
    c = c.withColumns({"ey": F.col("sy"), "sz": F.col("z0"), "ez": F.col("z1"), "ex": F.when(F.col("i") == 0, F.least("length_x_mm", F.col("sx") + off)).otherwise(F.greatest(F.lit(0.0), F.col("sx") - off))})
    out = out.unionByName(_numbered(c, "i", "j", category=F.lit("brace")))
    inside = F.coalesce(F.col("x") >= F.col("x_min_mm") - 0.5, F.lit(True)) & F.coalesce(F.col("x") <= F.col("x_max_mm") + 0.5, F.lit(True))
    s = _along_x(g.where("assigned_to_grid = 'per_x_station'")).where(inside)
    s = s.withColumns({"sx": F.col("x"), "ex": F.col("x"), "sy": F.coalesce("y_from_mm", "low_iy"), "ey": F.coalesce("y_to_mm", "high_iy"), "sz": F.col("z0"), "ez": F.col("z1")})
    return out.unionByName(_numbered(s, "ix", category=F.lit("brace")))


def expand_roof_diagonals(groups: DataFrame, grids: DataFrame | None, levels: DataFrame | None) -> DataFrame:
    """Braces in the roof planes of the first, the middle and the last frame, from both eaves to the ridge."""
    g = _under_roof(groups.where("orientation = 'diagonal_plan' AND assigned_to_grid = 'roof_truss_diagonals'"), grids, levels).withColumn("last_ix", F.size("xs") - 1)
    g = g.select("*", F.posexplode(F.array(F.lit(0), F.floor((F.col("last_ix") + 1) / 2).cast("int"), F.col("last_ix"))).alias("k", "ix")).withColumn("x", F.get("xs", F.col("ix"))).where("x IS NOT NULL")
    e, r = F.coalesce("eave", "z0"), F.coalesce("ridge", "z1")
    side = lambda i, y0, za, y1, zb: F.struct(F.lit(i).alias("i"), y0.alias("sy"), za.alias("sz"), y1.alias("ey"), zb.alias("ez"))
    rows = g.select("*", F.explode(F.array(side(0, F.lit(0.0), e, F.col("ridge_y"), r), side(1, F.col("ridge_y"), r, F.col("width"), e))).alias("s")).select("*", "s.*")
    return _numbered(rows.withColumns({"sx": F.col("x"), "ex": F.col("x")}), "k", "i", category=F.lit("brace"))


def slab_members(slabs: DataFrame, grids: DataFrame, levels: DataFrame) -> DataFrame:
    """Slabs as members from their lower to their upper corner; without limits they cover the grid."""
    top = levels.select("model_id", F.col("name").alias("top_level"), F.col("elevation_mm").cast("double").alias("ez"))
    return expand_slabs(slabs.join(top.hint("merge"), ["model_id", "top_level"]).join(grids.select("model_id", "length_x_mm", "width_y_mm").hint("merge"), "model_id"))


def expand_slabs(slabs: DataFrame) -> DataFrame:
    """`slab_members` of slabs beside their top (ez) and their model's size."""
    low, high = {"sx": "x_min_mm", "sy": "y_min_mm"}, {"ex": ("x_max_mm", "length_x_mm"), "ey": ("y_max_mm", "width_y_mm")}
    rows = slabs.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in low.items()} | {k: F.coalesce(*v) for k, v in high.items()} | {"sz": F.col("ez") - F.col("thickness_mm")})
    return _numbered(rows.withColumns({"group_id": F.col("slab_id"), "profile": F.lit("CONCRETE_SLAB")}), "sz", category=F.lit("slab"))


def compile_intent(groups: DataFrame, grids: DataFrame, levels: DataFrame, slabs: DataFrame | None = None) -> DataFrame:
    """All groups, and slabs, of all models as members."""
    rows = compile_placed(placed(with_levels(groups, levels), grids, levels))
    return rows if slabs is None else rows.unionByName(slab_members(slabs, grids, levels))


def compile_placed(groups: DataFrame) -> DataFrame:
    """All `placed` groups as members. Their rows are few beside what each one expands to: they are dealt to all partitions,
    as joins would leave as few tasks as their bytes ask for."""
    g = durable(_with_bays(dealt(groups)), "placed-groups")  # read by every expansion
    rows = expand_vertical(g, None)
    for more in (expand_horizontal(g, None), expand_rafters(g, None, None), expand_truss(g, None, None), expand_purlins(g, None, None), expand_diagonals(g, None), expand_roof_diagonals(g, None, None)):
        rows = rows.unionByName(more)
    return rows


def count_constraints(members: DataFrame, expected: DataFrame) -> DataFrame:
    """Violations: model_id, category, expected, actual."""
    actual = members.groupBy("model_id", "category").agg(F.count(F.lit(1)).alias("actual"))
    return expected.join(actual, ["model_id", "category"], "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where("expected <> actual")
