"""Boxes, lines and points of models: neighbourhood joins, isolation, holes, measuring.

Boxes: model_id, element_id, min_x .. max_z, in metres.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components, durable

AXES = "xyz"
#: Distances of relation pruning as shares of the seeds' diagonal with their bounds, metres.
SLOP, NEAR, TINY, LONG_STOCK = 0.012, (0.055, 0.004, 0.22, 0.12), 0.085, 2.0
WASHER = (0.009, 0.008, 0.036)
#: Directions below it count as none.
FLAT = 1e-9


def diagonal(lo: str = "min_", hi: str = "max_") -> Column:
    return F.sqrt(sum(((F.col(hi + a) - F.col(lo + a)) ** 2 for a in AXES), F.lit(0.0)))


def hull(boxes: DataFrame, *by: str) -> DataFrame:
    """Union of boxes per group."""
    return boxes.groupBy(*by).agg(*(F.min(f"min_{a}").alias(f"min_{a}") for a in AXES), *(F.max(f"max_{a}").alias(f"max_{a}") for a in AXES))


def padded(boxes: DataFrame, pad: Column) -> DataFrame:
    return boxes.withColumns({f"min_{a}": F.col(f"min_{a}") - pad for a in AXES} | {f"max_{a}": F.col(f"max_{a}") + pad for a in AXES})


#: Levels of cells, each twice as long as the one below; the last one takes all larger boxes.
LEVELS = 48


def overlaps(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs (model_id, element_id, other_id) of overlapping boxes of a model.

    Cells come in levels: those of level 0 are as long as cell, those of each further level twice as long as the last.
    A box belongs to the first level whose cells are as long as its longest side, so it lies in eight of them at most,
    whatever its size. Two boxes meet by an equi-join in the cells of the larger one's level: the smaller box looks
    there too, and also touches eight cells at most. A pair counts only in the cell of the larger of the two lower
    corners, so it is found once. Boxes with a side that is null, NaN or infinite meet none.
    """
    sides = [f"{m}_{a}" for m in ("min", "max") for a in AXES]
    names = {"element_id": "other_id"} | {f"{m}_{a}": f"{m}2_{a}" for m in ("min", "max") for a in AXES}
    a, b = (_levelled(df.select("model_id", "element_id", *sides), cell) for df in (left, right))
    up = lambda own, there: F.filter(F.array(*map(F.lit, there)), lambda n: n >= own)
    # the smaller box of a pair is of the left table, or of the right one and of a lower level
    pairs = _celled(a, up(F.col("level"), _levels(b)), cell).join(_celled(b, F.array("level"), cell).withColumnsRenamed(names), ["model_id", "level", "cx", "cy", "cz"])
    below = _celled(b, up(F.col("level") + 1, _levels(a)), cell).withColumnsRenamed(names)
    pairs = pairs.unionByName(_celled(a, F.array("level"), cell).join(below, ["model_id", "level", "cx", "cy", "cz"]))
    meet = reduce(lambda x, y: x & y, ((F.col(f"min_{a}") <= F.col(f"max2_{a}")) & (F.col(f"min2_{a}") <= F.col(f"max_{a}")) for a in AXES))
    home = reduce(lambda x, y: x & y, (F.col(f"c{a}") == F.floor(F.greatest(f"min_{a}", f"min2_{a}") / (cell * F.pow(F.lit(2.0), "level"))) for a in AXES))
    return pairs.where(meet & home).select("model_id", "element_id", "other_id")


def _levelled(boxes: DataFrame, cell: float) -> DataFrame:
    longest = F.greatest(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES))
    sound = reduce(lambda x, y: x & y, (F.abs(F.col(f"{m}_{a}")) < float("inf") for m in ("min", "max") for a in AXES))
    level = F.ceil(F.log2(F.greatest(longest / cell, F.lit(1.0)))).cast("int")
    return boxes.where(sound).withColumn("level", F.least(F.lit(LEVELS), level))


def _levels(boxes: DataFrame) -> list[int]:
    """The levels that occur, at most LEVELS + 1 numbers."""
    return sorted(r[0] for r in boxes.select("level").distinct().collect())


def _celled(boxes: DataFrame, levels: Column, cell: float) -> DataFrame:
    """A row for each cell that a box touches, at each of the levels."""
    size = cell * F.pow(F.lit(2.0), F.col("level"))
    span = lambda a: F.explode(F.sequence(F.floor(F.col(f"min_{a}") / size), F.floor(F.col(f"max_{a}") / size)))
    rows = boxes.withColumn("level", F.explode(levels))
    return reduce(lambda d, a: d.withColumn(f"c{a}", span(a)), AXES, rows)


def fasteners_near_seeds(fasteners: DataFrame, seeds: DataFrame) -> DataFrame:
    """Fasteners whose box meets the hull of their model's seeds, padded by a share of its diagonal."""
    d = diagonal()
    pad = F.greatest(d * 0.018, F.least(d * 0.075, d * 0.16))
    probe = padded(hull(seeds, "model_id").where(d > 0), pad).withColumnsRenamed({f"{m}_{a}": f"{m}2_{a}" for m in ("min", "max") for a in AXES})
    meet = reduce(lambda x, y: x & y, ((F.col(f"min_{a}") <= F.col(f"max2_{a}")) & (F.col(f"min2_{a}") <= F.col(f"max_{a}")) for a in AXES))
    return fasteners.join(probe, "model_id").where(meet).select(*fasteners.columns)


def centre(a: str) -> Column:
    return (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2


def prune_far(fasteners: DataFrame, seeds: DataFrame) -> DataFrame:
    """Fasteners whose middle is near the box of some seed: within 4 % of the seeds' diagonal, 4 to 180 mm.

    Seeds carry a slack of 1.2 % of their own size. Cells of the largest distance make this an equi-join.
    """
    limit = hull(seeds, "model_id").select("model_id", F.least(F.lit(0.18), F.greatest(F.lit(0.004), diagonal() * 0.04)).alias("limit"))
    near = padded(seeds, diagonal() * 0.012)
    grown = padded(near, F.lit(0.18))
    points = fasteners.join(limit, "model_id").withColumns({f"p{a}": centre(a) for a in AXES})
    dots = points.select("model_id", "element_id", *(F.col(f"p{a}").alias(f"{m}_{a}") for m in ("min", "max") for a in AXES))
    pairs = overlaps(dots, grown, 1.0)
    box = near.select("model_id", F.col("element_id").alias("other_id"), *(f"{m}_{a}" for m in ("min", "max") for a in AXES))
    far = lambda a: F.greatest(F.col(f"min_{a}") - F.col(f"p{a}"), F.col(f"p{a}") - F.col(f"max_{a}"), F.lit(0.0))
    d2 = sum((far(a) ** 2 for a in AXES), F.lit(0.0))
    rows = pairs.join(points.select("model_id", "element_id", "limit", *(f"p{a}" for a in AXES)), ["model_id", "element_id"]).join(box, ["model_id", "other_id"])
    return rows.groupBy("model_id", "element_id").agg(F.min(d2).alias("d2"), F.first("limit").alias("limit")).where("d2 <= limit * limit").select("model_id", "element_id", "d2")


def line_box() -> Column:
    """struct<t0, t1> of the stretch of a line (ox + t dx, ...) inside a box, null where it misses."""
    flat = lambda a: F.abs(F.col(f"d{a}")) < FLAT
    t = lambda a, side: (F.col(f"{side}_{a}") - F.col(f"o{a}")) / F.when(flat(a), F.lit(1.0)).otherwise(F.col(f"d{a}"))
    low = F.greatest(*(F.when(~flat(a), F.least(t(a, "min"), t(a, "max"))) for a in AXES))
    high = F.least(*(F.when(~flat(a), F.greatest(t(a, "min"), t(a, "max"))) for a in AXES))
    outside = reduce(lambda x, y: x | y, (flat(a) & ~F.col(f"o{a}").between(F.col(f"min_{a}"), F.col(f"max_{a}")) for a in AXES))
    return F.when(~outside & (low <= high), F.struct(low.alias("t0"), high.alias("t1")))


#: A model is at most so many boxes' cells long on each axis; wider ones have longer cells. A cell is a part of the longest box.
STEPS, PARTS = 512, 1


def line_boxes(lines: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Lines (model_id, line_id, ox .. dz) with the boxes of their model that they pass: adds element_id and t (`line_box`).

    Lines and boxes with a value that is null, NaN or infinite lie in no cell: they are tried against all of their model.
    """
    sides = [f"{m}_{a}" for m in ("min", "max") for a in AXES]
    finite = lambda names: F.coalesce(reduce(lambda x, y: x & y, (F.abs(F.col(c)) < float("inf") for c in names)), F.lit(False))
    kept = [*lines.columns, "element_id", "t"]
    boxes = boxes.select("model_id", "element_id", *sides)
    known, whole = finite([f"{c}{a}" for c in "od" for a in AXES]), finite(sides)
    # the same test as `line_box`, whose directions are columns already, null where flat
    t = {a: [(F.col(f"{m}_{a}") - F.col(f"o{a}")) / F.col(f"q{a}") for m in ("min", "max")] for a in AXES}
    low, high = F.greatest(*(F.least(*t[a]) for a in AXES)), F.least(*(F.greatest(*t[a]) for a in AXES))
    within = reduce(lambda x, y: x & y, (F.col(f"q{a}").isNotNull() | F.col(f"o{a}").between(F.col(f"min_{a}"), F.col(f"max_{a}")) for a in AXES))
    rows = boxes_of_lines(lines.where(known), boxes.where(whole), cell).where(within & (low <= high)).withColumn("t", F.struct(low.alias("t0"), high.alias("t1"))).select(*kept)
    for some, against in ((lines.where(~known), boxes), (lines.where(known), boxes.where(~whole))):
        rows = rows.unionByName(some.join(against, "model_id").withColumn("t", line_box()).where("t IS NOT NULL").select(*kept))
    return rows


def boxes_of_lines(lines: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Pairs of lines and boxes that may meet, each once; adds qx, qy, qz, the line's direction, null where it is flat.

    A box lies in one cell, that of its lower corner, on the first level whose cells, PARTS together, are as long as its
    longest side (on level 0 these are as long as cell, on each further one twice as long). A line walks along its longest
    direction through its model and looks into every cell whose boxes can reach it: an equi-join.
    """
    sides = [f"{m}_{a}" for m in ("min", "max") for a in AXES]
    hulls = hull(boxes, "model_id").select("model_id", *(F.col(f"min_{a}").alias(f"h{a}") for a in AXES), F.greatest(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES)).alias("__wide"))
    longest = F.greatest(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES), F.col("__wide") / STEPS)
    celled = boxes.join(hulls, "model_id").withColumn("level", F.ceil(F.log2(F.greatest(longest / cell, F.lit(1.0)))).cast("int"))
    size = cell / PARTS * F.pow(F.lit(2.0), "level")
    celled = celled.withColumns({f"c{a}": F.floor((F.col(f"min_{a}") - F.col(f"h{a}")) / size) for a in AXES})
    reach = celled.groupBy("model_id", "level", *(f"h{a}" for a in AXES)).agg(*(f(f"c{a}").alias(f"{n}{a}") for f, n in ((F.min, "lo"), (F.max, "hi")) for a in AXES)).withColumn("size", size)

    steep = {a: F.when(F.abs(F.col(f"d{a}")) >= FLAT, F.col(f"d{a}")) for a in AXES}
    long = F.greatest(*(F.abs(v) for v in steep.values()))
    axis = F.when(F.abs(steep["x"]) == long, "x").when(F.abs(steep["y"]) == long, "y").otherwise("z")
    of = lambda n: F.when(F.col("axis") == "x", F.col(f"{n}x")).when(F.col("axis") == "y", F.col(f"{n}y")).otherwise(F.col(f"{n}z"))
    # lines without a direction meet nothing
    walks = lines.withColumns({"long": long, "axis": axis} | {f"q{a}": v for a, v in steep.items()}).where("long IS NOT NULL").join(reach, "model_id")
    walks = walks.withColumns({f"r{a}": F.col(f"o{a}") - F.col(f"h{a}") for a in AXES} | {f"s{a}": F.coalesce(F.col(f"q{a}") / of("q"), F.lit(0.0)) for a in AXES})
    walks = walks.withColumn("slack", F.col("size") * 1e-6 + 1e-12 * sum((F.abs(f"o{a}") + F.abs(f"h{a}") for a in AXES), F.lit(0.0)))
    walks = walks.withColumn("step", F.explode(F.sequence(of("lo"), of("hi"))))
    for a in AXES:
        # the boxes of a cell reach from its lower end to the upper end of the cell PARTS further
        ends = [F.col(f"r{a}") + (F.col("size") * (F.col("step") + k) - of("r")) * F.col(f"s{a}") for k in (0, PARTS + 1)]
        first = F.greatest(F.col(f"lo{a}"), F.floor((F.least(*ends) - F.col("slack")) / F.col("size")) - PARTS)
        last = F.least(F.col(f"hi{a}"), F.floor((F.greatest(*ends) + F.col("slack")) / F.col("size")))
        own = F.col("axis") == a
        walks = walks.withColumns({f"from{a}": F.when(own, F.col("step")).otherwise(first), f"to{a}": F.when(own, F.col("step")).otherwise(last)}).where(F.col(f"from{a}") <= F.col(f"to{a}"))
    for a in AXES:
        walks = walks.withColumn(f"c{a}", F.explode(F.sequence(f"from{a}", f"to{a}")))
    cells, own = ["model_id", "level", *(f"c{a}" for a in AXES)], [*lines.columns, *(f"q{a}" for a in AXES)]
    return walks.select(*own, *cells[1:]).join(celled.select(*cells, "element_id", *sides), cells).select(*own, "element_id", *sides)


def hole_positions(bolts: DataFrame, boxes: DataFrame, members: DataFrame, gate: float = 0.005) -> DataFrame:
    """Where bolt axes pierce the boxes of their assembly's parts, at the face nearest the bolt; once per place.

    bolts: assembly_id, bolt_id, ox .. dz (unit axis), length; members: assembly_id, part_id.
    """
    line = [f"{c}{a}" for c in "od" for a in AXES]
    sides = [f"{m}_{a}" for m in ("min", "max") for a in AXES]
    parts = boxes.select(F.col("element_id").alias("part_id"), *sides)
    rows = bolts.select("assembly_id", "bolt_id", *line, "length").join(members.select("assembly_id", "part_id"), "assembly_id").join(parts, "part_id").withColumn("hit", line_box()).where("hit IS NOT NULL")
    t = F.when(F.abs("hit.t0") <= F.abs("hit.t1"), F.col("hit.t0")).otherwise(F.col("hit.t1"))
    rows = rows.withColumn("t", t).where(F.abs("t") <= F.col("length") / 2 + gate)
    place = [F.round(F.col(f"o{a}") + F.col("t") * F.col(f"d{a}"), 4).alias(f"h{a}") for a in AXES]
    return rows.select("bolt_id", *place, "part_id").groupBy("bolt_id", "hx", "hy", "hz").agg(F.min("part_id").alias("part_id"))


def bolts_without_holes(bolts: DataFrame, holes: DataFrame) -> DataFrame:
    return bolts.join(holes.select("bolt_id").distinct(), "bolt_id", "left_anti")


def box_lines(bolts: DataFrame) -> DataFrame:
    """Bolts (with boxes) as lines through the middle along the longest side, the first of equal sides."""
    size = {a: F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES}
    long = F.greatest(*size.values())
    axis = F.when(size["x"] == long, "x").when(size["y"] == long, "y").otherwise("z")
    rows = bolts.withColumns({f"o{a}": centre(a) for a in AXES} | {"length": long, "__axis": axis})
    return rows.withColumns({f"d{a}": (F.col("__axis") == a).cast("double") for a in AXES}).drop("__axis")


def holes_by_lines_or_boxes(lines: DataFrame, bolts: DataFrame, boxes: DataFrame, members: DataFrame) -> DataFrame:
    """Holes by the lines of bolts; bolts that have none, or no line, are tried along the longest side of their box.

    lines: as in `hole_positions`; bolts: assembly_id, bolt_id, box. No bolt is tried both ways once it has a hole.
    """
    found = durable(hole_positions(lines, boxes, members), "holes")
    return found.unionByName(hole_positions(box_lines(bolts_without_holes(bolts, found)), boxes, members))


def hidden_bolts(bolts: DataFrame, holes: DataFrame, boxes: DataFrame, members: DataFrame) -> DataFrame:
    """(bolt_id): bolts without a hole, and bolts whose middle lies in no box of their assembly's parts."""
    sides = [f"{m}_{a}" for m in ("min", "max") for a in AXES]
    middle = bolts.select("assembly_id", "bolt_id", *(centre(a).alias(f"p{a}") for a in AXES))
    rows = middle.join(members, "assembly_id").join(boxes.select(F.col("element_id").alias("part_id"), *sides), "part_id")
    inside = rows.where(reduce(lambda x, y: x & y, (F.col(f"p{a}").between(F.col(f"min_{a}"), F.col(f"max_{a}")) for a in AXES))).select("bolt_id").distinct()
    shown = inside.join(holes.select("bolt_id").distinct(), "bolt_id", "left_semi")
    return bolts.select("bolt_id").distinct().join(shown, "bolt_id", "left_anti")


def prune_relations(elements: DataFrame, seeds: DataFrame, allowed: DataFrame) -> DataFrame:
    """Elements (model_id, element_id, kind, box) that stay around the seeds of their model.

    Kinds: fastener and accessory are hardware, null is hardware where the box is tiny; all others stay, as do seeds
    and allowed elements. Other hardware stays near the hull of short seeds; at long ones only tiny accessories that
    lie on it stay. Models without seeds keep everything, and so does a model of which nothing is allowed.
    """
    share, least, most, part = NEAR
    clamp = lambda v, lo, hi: F.greatest(lo, F.least(hi, v))
    listed = elements.join(allowed.select("element_id").distinct(), "element_id", "left_semi").select("model_id").distinct()
    core = hull(seeds, "model_id").withColumn("d", diagonal()).where("d > 0").join(listed, "model_id", "left_semi")
    core = core.select("model_id", "d", *((F.col(f"{m}_{a}") + s * SLOP * F.col("d")).alias(f"{m}2_{a}") for m, s in (("min", -1), ("max", 1)) for a in AXES))
    keys = allowed.select("element_id").distinct().withColumn("__allowed", F.lit(True))
    own = seeds.select("model_id", "element_id").distinct().withColumn("__seed", F.lit(True))
    rows = elements.join(core, "model_id", "left").join(keys, "element_id", "left").join(own, ["model_id", "element_id"], "left")
    far = lambda a: F.greatest(F.col(f"min2_{a}") - centre(a), centre(a) - F.col(f"max2_{a}"), F.lit(0.0))
    d2, d = sum((far(a) ** 2 for a in AXES), F.lit(0.0)), F.col("d")
    tiny = diagonal() < d * TINY
    hardware = F.coalesce(F.col("kind").isin("fastener", "accessory"), tiny)
    near = clamp(d * share, F.lit(least), F.least(F.lit(most), d * part))
    flush = clamp(d * WASHER[0], F.lit(WASHER[1]), F.lit(WASHER[2]))
    close = F.when(d < LONG_STOCK, d2 <= near * near).otherwise(F.coalesce(F.col("kind") == "accessory", F.lit(False)) & tiny & (d2 <= flush * flush))
    stays = F.col("__seed").isNotNull() | F.col("__allowed").isNotNull() | d.isNull() | ~hardware | close
    return rows.where(stays).select(*elements.columns)


#: Cells of samples: two of one cell are on one line for sure, 28 mm and a dot product of 0.96 apart at most.
SPOT, LEAN = 0.016, 0.16


def _node(s: str) -> Column:
    return F.concat_ws("/", F.col("bolt_id").cast("string"), F.col(s).cast("string"))


def linked(samples: DataFrame, others: DataFrame, when: Column, tol: float = 0.028, align: float = 0.96, on: tuple[str, ...] = ("bolt_id",)) -> DataFrame:
    """Pairs (sample_id, other) of a bolt whose axes agree and which lie on one line, the line of the first in order of ids."""
    names = {"sample_id": "other"} | {f"p{a}": f"q{a}" for a in AXES} | {f"a{a}": f"b{a}" for a in AXES} | {"node": "other_node", "part": "other_part"}
    d = {a: F.col(f"q{a}") - F.col(f"p{a}") for a in AXES}
    along = sum((d[a] * F.col(f"a{a}") for a in AXES), F.lit(0.0))
    off = sum(((d[a] - along * F.col(f"a{a}")) ** 2 for a in AXES), F.lit(0.0))
    dot = F.abs(sum((F.col(f"a{a}") * F.col(f"b{a}") for a in AXES), F.lit(0.0)))
    return samples.join(others.withColumnsRenamed(names), list(on)).where((F.col("sample_id") < F.col("other")) & when & (dot >= align) & (off < tol * tol))


def sure_links(samples: DataFrame, tol: float = 0.028, align: float = 0.96) -> DataFrame:
    """(src, dst): links of samples to the head of their cell, and of heads to those of the cells around."""
    known = [f"{c}{a}" for c in "pa" for a in AXES]
    sound = reduce(lambda x, y: x & y, (F.abs(F.col(c)) < float("inf") for c in known)) & F.col("bolt_id").isNotNull() & F.col("sample_id").isNotNull()
    unit = F.abs(sum((F.col(f"a{a}") ** 2 for a in AXES), F.lit(-1.0))) < 1e-6
    scale = min(tol / 0.028, 1.0)
    at = [F.floor(F.col(f"p{a}") / (SPOT * scale)).alias(f"c{a}") for a in AXES]
    lean = [F.floor(F.col(f"a{a}") / (LEAN * min(((1 - align) / 0.04) ** 0.5, 1.0))).alias(f"l{a}") for a in AXES]
    rows = samples.where(sound & unit).select("bolt_id", "sample_id", *known, *at, *lean, _node("sample_id").alias("node"))
    cell = ["bolt_id", *(f"c{a}" for a in AXES), *(f"l{a}" for a in AXES)]
    heads = durable(rows.groupBy(*cell).agg(F.min_by(F.struct("sample_id", *known, "node"), "node").alias("h")).select(*cell, "h.*"), "heads")
    links = rows.select(*cell, "node").join(heads.select(*cell, F.col("node").alias("head")), cell).where("node <> head").select(F.col("node").alias("src"), F.col("head").alias("dst"))
    near = heads.drop(*(f"l{a}" for a in AXES))
    for a in AXES:
        near = near.withColumn(f"c{a}", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.col(f"c{a}") + i)))  # noqa: B023
    between = linked(near, heads.drop(*(f"l{a}" for a in AXES)), F.lit(True), tol, align, ("bolt_id", *(f"c{a}" for a in AXES)))
    # each pair once in either order: the one whose first sample looks around is enough
    return links.unionByName(between.select(F.col("node").alias("src"), F.col("other_node").alias("dst")))


def collinear_clusters(samples: DataFrame, tol: float = 0.028, align: float = 0.96) -> DataFrame:
    """(bolt_id, sample_id, cluster): samples of a bolt whose axes agree and which lie on one line.

    samples: bolt_id, sample_id, px .. pz, ax .. az (unit). Samples so near that they are linked for sure are linked to
    one head a cell. What these links join is one part; only samples outside the largest part of their bolt are then
    tried against all of it, so a crowd costs no pairs. Samples that miss a value or are no unit lie in no cell.
    """
    nodes = samples.select("bolt_id", "sample_id", *(f"{c}{a}" for c in "pa" for a in AXES), _node("sample_id").alias("node"))
    parts = connected_components(durable(sure_links(samples, tol, align), "sure-links"))
    rows = durable(nodes.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "parts-of-samples")
    largest = rows.groupBy("bolt_id", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("bolt_id").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    loose = durable(rows.join(largest, "bolt_id").where("part <> largest").drop("largest"), "loose-samples")
    differ = F.col("part") != F.col("other_part")
    found = linked(loose, rows, differ, tol, align).unionByName(linked(rows, loose, differ, tol, align))
    merged = connected_components(durable(found.select(F.col("part").alias("src"), F.col("other_part").alias("dst")).distinct(), "part-links")).withColumnRenamed("node", "part")
    return rows.select("bolt_id", "sample_id", "part").join(merged, "part", "left").select("bolt_id", "sample_id", F.coalesce("component", "part").alias("cluster"))


def companions(seeds: DataFrame, connections: DataFrame, elements: DataFrame, hops: int = 1) -> DataFrame:
    """Elements that connections (a, b) lead to from seeds in so many hops, of companion categories only."""
    both = connections.select("a", "b").union(connections.select(F.col("b"), F.col("a")))
    good = elements.where("companion").select("element_id")
    reached = durable(seeds.select("element_id").distinct(), "companions")
    front = reached
    for _ in range(hops):
        step = front.join(both, front["element_id"] == both["a"]).select(F.col("b").alias("element_id")).distinct()
        front = durable(step.join(good, "element_id", "left_semi").join(reached, "element_id", "left_anti"), "companions")
        reached = reached.union(front)
    return reached


def isolated_set(seeds: DataFrame, voids: DataFrame, connections: DataFrame, elements: DataFrame, boxes: DataFrame, relation_bolts: DataFrame | None = None) -> DataFrame:
    """Elements that stay when seeds are isolated: seeds, their openings, related bolts, two hops of companions, near
    fasteners, less what lies far from all seeds."""
    base = seeds.select("element_id").union(voids.join(seeds.select(F.col("element_id").alias("host_id")), "host_id", "left_semi").select("element_id"))
    if relation_bolts is not None:
        base = base.union(relation_bolts.select("element_id"))
    grown = companions(base, connections, elements, 2)
    fasteners = boxes.join(elements.where("fastener").select("element_id"), "element_id", "left_semi")
    seed_boxes = boxes.join(seeds.select("element_id"), "element_id", "left_semi")
    near = fasteners_near_seeds(fasteners, seed_boxes).select("element_id")
    every = grown.union(near).distinct()
    kept = prune_far(fasteners.join(every, "element_id", "left_semi"), seed_boxes).select("element_id")
    loose = every.join(fasteners.select("element_id"), "element_id", "left_semi").join(kept, "element_id", "left_anti")
    return every.join(loose, "element_id", "left_anti").union(seeds.select("element_id")).distinct()


def measure(up: str = "z") -> dict[str, Column]:
    """Distances between points p1 and p2: direct, along the up axis, across it."""
    d = {a: F.col(f"p2{a}") - F.col(f"p1{a}") for a in AXES}
    across = [a for a in AXES if a != up]
    return {"direct": F.sqrt(sum((v**2 for v in d.values()), F.lit(0.0))), "height": F.abs(d[up]), "horizontal": F.sqrt(sum((d[a] ** 2 for a in across), F.lit(0.0)))}


def snapped_end() -> Column:
    """'start' or 'end' of an edge (e1, e2) when a point p lies within a tenth of it, 0.12 m at most; else 'edge'."""
    e = {a: F.col(f"e2{a}") - F.col(f"e1{a}") for a in AXES}
    size = F.sqrt(sum((v**2 for v in e.values()), F.lit(0.0)))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum(((F.col(f"p{a}") - F.col(f"e1{a}")) * e[a] for a in AXES), F.lit(0.0)) / (size * size)))
    tol = F.least(size * 0.1, F.lit(0.12))
    return F.when(size <= 1e-9, "edge").when(t * size <= tol, "start").when((1 - t) * size <= tol, "end").otherwise("edge")


def view_axis() -> Column:
    """View for a box: onto the face of a thin one, else across the longest side."""
    s = {a: F.abs(F.col(f"max_{a}") - F.col(f"min_{a}")) for a in AXES}
    thin, long = F.least(*s.values()), F.greatest(*s.values())
    # of equal sides the first in x, y, z is the longest and the last the thinnest
    face = F.when(s["z"] == thin, "front").when(s["y"] == thin, "top").otherwise("right")
    return F.when(thin / F.greatest(long, F.lit(1e-9)) < 0.28, face).otherwise(F.when((s["z"] == long) & (s["x"] < long) & (s["y"] < long), "right").otherwise("front"))
