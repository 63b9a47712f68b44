"""What stays when parts are isolated: allow-lists of hardware, prunes, and their order by mode.

Elements: model_id, element_id, kind, min_x .. max_z in metres. Kinds are fastener, accessory (loose hardware),
connection (plates, cleats and the like that are sold as accessories), opening, member, and any other name, such as
steel; null is an element of unknown kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial
from .graph import durable

AXES = spatial.AXES
SIDES = [f"{m}_{a}" for m in ("min", "max") for a in AXES]
#: Fixed values, metres: reach of a member's box for hardware on it; size of tiles that are no members, as a share of
#: the seeds' diagonal, without seeds, and its bounds.
BOX_PAD, TILE, TILE_ALONE, TILE_BOUNDS = 0.06, 0.042, 0.22, (0.1, 0.32)
HARDWARE = ("fastener", "accessory")


def _keys(*tables: DataFrame | None) -> DataFrame:
    return reduce(DataFrame.union, (t.select("element_id") for t in tables if t is not None)).distinct()


def with_companions(selected: DataFrame, connections: DataFrame, elements: DataFrame, hops: int, gate: DataFrame | None = None) -> DataFrame:
    """Adds hardware, connections and openings that connections (a, b) lead to in so many hops, each from all before.

    With a gate, hardware joins only if it is in the gate; openings and connections always do.
    """
    both = connections.select("a", "b").union(connections.select(F.col("b"), F.col("a")))
    good = elements.where(F.col("kind").isin(*HARDWARE, "connection", "opening"))
    if gate is not None:
        good = good.where(~F.col("kind").isin(*HARDWARE)).unionByName(good.where(F.col("kind").isin(*HARDWARE)).join(_keys(gate), "element_id", "left_semi"))
    good = durable(good.select("element_id").distinct(), "companions")
    reached = front = durable(_keys(selected), "companions")
    for _ in range(hops):
        step = front.join(both, front["element_id"] == both["a"]).select(F.col("b").alias("element_id")).distinct()
        front = durable(step.join(good, "element_id", "left_semi").join(reached, "element_id", "left_anti"), "companions")
        reached = reached.union(front)
    return reached


def touching(boxes: DataFrame, members: DataFrame, pad: float = BOX_PAD, cell: float = 0.25) -> DataFrame:
    """(model_id, element_id): boxes that meet the padded box of some member."""
    return spatial.overlaps(boxes, spatial.padded(members, F.lit(pad)), cell).select("model_id", "element_id").distinct()


def production_allowed(links: DataFrame, overlay: DataFrame, steel: DataFrame, connections: DataFrame, elements: DataFrame, hops: int = 3) -> DataFrame:
    """(element_id): allow-list of hardware for a set of steel (rows of elements).

    Linked and overlay bolts are listed as they are. Fasteners that three hops of connections or the neighbourhood of
    the steel's hull bring are listed only if their box touches the box of one of the steel's members, padded by 60 mm;
    the hull alone would take in neighbours along a tall column.
    """
    walked = with_companions(steel, connections, elements, hops)
    fasteners = elements.where("kind = 'fastener'")
    near = spatial.fasteners_near_seeds(fasteners, steel)
    found = fasteners.join(_keys(walked, near), "element_id", "left_semi").join(_keys(steel), "element_id", "left_anti")
    return _keys(links, overlay, touching(found, steel))


def _core(seeds: DataFrame, share: float, low: float, high: float) -> DataFrame:
    """Per model the hull of its seeds (min2_x ..), grown by a share of its diagonal d with bounds."""
    slop = F.greatest(F.col("d") * low, F.least(F.col("d") * high, F.col("d") * share))
    core = spatial.hull(seeds, "model_id").withColumn("d", spatial.diagonal()).where("d > 0")
    return core.select("model_id", "d", *((F.col(f"{m}_{a}") + s * slop).alias(f"{m}2_{a}") for m, s in (("min", -1), ("max", 1)) for a in AXES))


def _detached() -> Column:
    """Squared distance of a box's middle from the hull beside it."""
    far = lambda a: F.greatest(F.col(f"min2_{a}") - spatial.centre(a), spatial.centre(a) - F.col(f"max2_{a}"), F.lit(0.0))
    return sum((far(a) ** 2 for a in AXES), F.lit(0.0))


def prune_unlisted(elements: DataFrame, seeds: DataFrame, allowed: DataFrame) -> DataFrame:
    """Elements without the hardware that is neither allowed nor a seed."""
    loose = elements.where(F.col("kind").isin(*HARDWARE)).select("element_id").join(_keys(allowed, seeds), "element_id", "left_anti")
    return elements.join(loose.distinct(), "element_id", "left_anti")


def prune_orphans(elements: DataFrame, seeds: DataFrame, allowed: DataFrame, steel: DataFrame) -> DataFrame:
    """Elements that stay around seeds of a production view: no unlisted hardware, no tiles that only pass for members.

    Openings, connections, seeds and whatever is allowed or visible steel stay. A member that is none of them goes if
    it is tiny beside the seeds, or if its middle lies too far from their hull. Without any allowed element, or without
    any visible steel, everything stays.
    """
    if allowed.isEmpty() or steel.isEmpty():
        return elements
    share, least, most, part = spatial.NEAR
    d = F.col("d")
    reach = F.greatest(F.lit(least), F.least(F.least(F.lit(most), d * part), d * share))
    tile = F.greatest(F.lit(TILE_BOUNDS[0]), F.least(F.lit(TILE_BOUNDS[1]), F.coalesce(d * TILE, F.lit(TILE_ALONE))))
    kept = _keys(allowed, steel).withColumn("__kept", F.lit(True))
    own = seeds.select("model_id", "element_id").distinct().withColumn("__seed", F.lit(True))
    rows = elements.join(_core(seeds, spatial.SLOP, 0.004, 0.028), "model_id", "left").join(kept, "element_id", "left").join(own, ["model_id", "element_id"], "left")
    stray = (spatial.diagonal() <= tile) | F.coalesce(_detached() > reach * reach, F.lit(False))
    gone = F.col("kind").isin(*HARDWARE) | ((F.col("kind") == "member") & stray)
    return rows.where(F.col("__seed").isNotNull() | F.col("__kept").isNotNull() | ~F.coalesce(gone, F.lit(False))).select(*elements.columns)


def isolated(
    elements: DataFrame, seeds: DataFrame, voids: DataFrame, connections: DataFrame, relation_bolts: DataFrame | None = None, allowed: DataFrame | None = None, spatial_allowed: DataFrame | None = None,
    steel: DataFrame | None = None, enforce: bool = False, hide_fasteners: bool = False,
) -> DataFrame:
    """The elements that stay visible when seeds (rows of elements) are isolated; all others are hidden.

    In this order: openings (host_id, element_id) of the seeds; relation_bolts, if given; two hops of companions; near
    fasteners; one hop more. By relation (relation_bolts given) connections are followed freely, and hardware that is
    not allowed is pruned by its distance; otherwise hops pass the gate of allowed, near fasteners that of
    spatial_allowed, and fasteners far from all seeds are pruned. enforce drops hardware that is not allowed and, with
    visible steel, orphans. hide_fasteners leaves holes and connections, but no hardware.
    """
    by_relation = relation_bolts is not None
    some = allowed is not None and not allowed.isEmpty()
    gate = None if by_relation else allowed
    hosted = voids.join(seeds.select(F.col("element_id").alias("host_id")), "host_id", "left_semi")
    grown = with_companions(_keys(seeds, hosted, relation_bolts), connections, elements, 2, gate)
    fasteners = elements.where("kind = 'fastener'")
    near = spatial.fasteners_near_seeds(fasteners, seeds)
    if not by_relation and spatial_allowed is not None:
        near = near.join(_keys(spatial_allowed), "element_id", "left_semi")
    grown = with_companions(_keys(grown, near), connections, elements, 1, gate)
    rows = durable(elements.join(grown, "element_id", "left_semi"), "isolated")
    if by_relation and some:
        rows = spatial.prune_relations(rows, seeds, allowed)
    elif not by_relation:
        hardware = rows.where("kind = 'fastener'").join(_keys(seeds), "element_id", "left_anti")
        close = spatial.prune_far(hardware, seeds).select("element_id")
        rows = rows.join(hardware.select("element_id").join(close, "element_id", "left_anti"), "element_id", "left_anti")
    if enforce and some:
        rows = prune_unlisted(durable(rows, "isolated"), seeds, allowed)
        if steel is not None:
            rows = prune_orphans(durable(rows, "isolated"), seeds, allowed, steel)
    return rows.where(~F.coalesce(F.col("kind").isin(*HARDWARE), F.lit(False))) if hide_fasteners else rows


def hole_scopes(visible: DataFrame, displayed: DataFrame, pool: DataFrame, part_pool: DataFrame) -> DataFrame:
    """(pick_id, element_id, role) of production views: the steel whose holes count and the bolts that may mark them.

    visible and displayed: pick_id, element_id. A pick of a single part has displayed rows: its scope is these, and its
    bolts are those of part_pool; any other pick has all its visible steel and the bolts of pool.
    """
    single = displayed.select("pick_id").distinct()
    either = lambda mine, rest: mine.join(single, "pick_id", "left_semi").select("pick_id", "element_id").union(rest.join(single, "pick_id", "left_anti").select("pick_id", "element_id")).distinct()
    return either(displayed, visible).withColumn("role", F.lit("steel")).unionByName(either(part_pool, pool).withColumn("role", F.lit("bolt")))
