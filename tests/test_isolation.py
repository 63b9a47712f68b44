"""Boxes of very unlike sizes against brute force; prunes of isolated sets by hand-made cases."""

import math
import random

from pyspark.sql import functions as F

from ferrolith.operators import isolation, resolve, spatial

BOX = "model_id int, element_id int, kind string, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double"


def box(i, kind, x=0.0, size=0.1, model=1, y=0.0, z=0.0):
    h = size / 2
    return (model, i, kind, x - h, x + h, y - h, y + h, z - h, z + h)


def rows(spark, data):
    return spark.createDataFrame(data, BOX)


def ids(df):
    return {r["element_id"] for r in df.collect()}


def test_overlaps_of_sizes_over_five_orders_equal_brute_force(spark):
    rng = random.Random(2)
    data = []
    for i in range(260):
        s = [10 ** rng.uniform(-3, 2) for _ in "xyz"]
        c = [rng.uniform(-60, 60) if rng.random() < 0.5 else rng.uniform(-0.2, 0.2) for _ in "xyz"]
        data.append((i // 2 % 2, i, "k", *(v for a, h in zip(c, s) for v in (a - h / 2, a + h / 2))))
    data += [(0, 900, "k", 0.0, 0.25, 0.0, 0.25, 0.0, 0.25), (0, 901, "k", 0.25, 0.5, 0.0, 0.25, 0.25, 0.5)]  # a common corner on a cell border
    data += [(0, 902, "k", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0, 903, "k", None, 1.0, 0.0, 1.0, 0.0, 1.0), (0, 904, "k", 0.0, math.inf, 0.0, 1.0, 0.0, 1.0), (0, 905, "k", 0.0, math.nan, 0.0, 1.0, 0.0, 1.0)]
    left, right = data[::2], data[1::2] + data[-4:-3]
    got = [tuple(r) for r in spatial.overlaps(rows(spark, left), rows(spark, right), 0.05).collect()]
    sound = lambda r: all(v is not None and math.isfinite(v) for v in r[3:])
    meet = lambda a, b: all(a[k] <= b[k + 1] and b[k] <= a[k + 1] for k in (3, 5, 7))
    want = {(a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and sound(a) and sound(b) and meet(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_a_box_takes_eight_cells_of_a_level_whatever_its_size(spark):
    data = [box(i, "k", x=0.37 * i, size=10.0**e) for i, e in enumerate((-4, -3, -2, -1, 0, 1, 2))] + [(1, 90, "slab", 0.0, 100.0, 0.0, 40.0, 0.0, 0.2)]
    levelled = spatial._levelled(rows(spark, data), 0.01)
    own = spatial._celled(levelled, F.array("level"), 0.01).groupBy("element_id").count().collect()
    assert len(own) == 8 and max(r["count"] for r in own) <= 8
    levels = spatial._levels(levelled)
    probing = spatial._celled(levelled, F.filter(F.array(*map(F.lit, levels)), lambda n: n >= F.col("level")), 0.01).groupBy("element_id").count().collect()
    assert max(r["count"] for r in probing) <= 8 * len(levels)


def test_orphans(spark):
    # the seed's diagonal is 3.46 m: middles may be 0.19 m off its hull (grown by 0.042 m), tiles up to 0.145 m are tiny
    seed = box(1, "steel", size=2.0)
    cases = {
        2: (box(2, "fastener", x=1.0), False), 3: (box(3, "accessory", x=1.0), False), 4: (box(4, "connection", x=9.0), True), 5: (box(5, "opening", x=9.0), True),
        6: (box(6, "member", x=0.5, size=0.08), False), 7: (box(7, "member", x=1.2, size=0.4), True), 8: (box(8, "member", x=1.3, size=0.4), False),
        9: (box(9, "fastener", x=50.0), True), 10: (box(10, "member", x=50.0, size=0.05), True), 11: (box(11, "steel", x=70.0), True), 12: (box(12, None, x=70.0), True),
        21: (box(21, "member", x=5.0, size=0.2, model=2), True), 22: (box(22, "member", x=5.0, size=0.1, model=2), False),  # a model without seeds
    }
    elements = rows(spark, [seed, *(c for c, _ in cases.values())])
    allowed, steel = elements.where("element_id = 9"), elements.where("element_id IN (1, 10)")
    assert ids(isolation.prune_orphans(elements, elements.where("element_id = 1"), allowed, steel)) == {1} | {i for i, (_, stays) in cases.items() if stays}
    assert ids(isolation.prune_orphans(elements, elements.where("element_id = 1"), allowed.where("false"), steel)) == ids(elements)


def test_production_list_needs_a_member_box_beside(spark):
    # two thin columns 4 m apart: their common hull holds the bolt in the middle, but no member's box does
    columns = [(1, 1, "steel", 0.0, 0.2, 0.0, 0.2, 0.0, 6.0), (1, 2, "steel", 4.0, 4.2, 0.0, 0.2, 0.0, 6.0)]
    bolts = [box(10, "fastener", x=0.27, y=0.1, z=3.0, size=0.04), box(11, "fastener", x=2.0, y=0.1, z=3.0, size=0.04), box(12, "fastener", x=0.35, y=0.1, z=3.0, size=0.04), box(13, "fastener", x=40.0, size=0.04), box(14, "accessory", x=0.21, y=0.1, z=3.0)]
    elements = rows(spark, columns + bolts)
    none = elements.where("false")
    edges = spark.createDataFrame([(1, 13), (1, 14)], "a int, b int")
    args = (elements.where("kind = 'steel'"), edges, elements)
    assert ids(isolation.production_allowed(none, none, *args)) == {10}  # 0.25 - 0.2 is within 60 mm, 0.33 - 0.2 is not
    assert ids(isolation.production_allowed(elements.where("element_id = 11"), elements.where("element_id = 13"), *args)) == {10, 11, 13}


def test_modes_follow_their_gates(spark):
    data = [box(1, "steel", size=2.0), box(2, "opening", x=0.1), box(3, "fastener", x=1.05), box(4, "accessory", x=1.1), box(5, "fastener", x=1.08), box(6, "steel", x=3.0), box(7, "fastener", x=7.0), box(8, "connection", x=1.2)]
    elements = rows(spark, data)
    edges = spark.createDataFrame([(1, 3), (3, 4), (1, 8), (8, 7), (1, 6)], "a int, b int")
    voids = spark.createDataFrame([(1, 2), (6, 99)], "host_id int, element_id int")
    seeds = elements.where("element_id = 1")
    only3, none = elements.where("element_id = 3"), elements.where("false")
    run = lambda **k: ids(isolation.isolated(elements, seeds, voids, edges, **k))
    assert run() == {1, 2, 3, 4, 5, 8}  # 7 is reached but far; 6 is no companion; 5 is near
    assert run(allowed=only3, spatial_allowed=none) == {1, 2, 3, 8}  # 4 is hardware behind the gate
    assert run(relation_bolts=none, allowed=only3) == {1, 2, 3, 8}  # long seed: loose hardware must lie flush with it
    assert run(relation_bolts=none, allowed=only3, hide_fasteners=True) == {1, 2, 8}
    assert run(allowed=only3, enforce=True, steel=seeds) == {1, 2, 3, 8}


def test_scopes_of_single_parts(spark):
    t = lambda *r: spark.createDataFrame(r, "pick_id int, element_id int")
    got = isolation.hole_scopes(t((1, 10), (1, 11), (2, 10)), t((1, 11), (1, 11)), t((1, 5), (2, 5)), t((1, 6), (2, 7)))
    assert {tuple(r) for r in got.collect()} == {(1, 11, "steel"), (2, 10, "steel"), (1, 6, "bolt"), (2, 5, "bolt")}


def test_sparse_accessories_are_decided_by_all_that_is_known(spark):
    kinds = {"d": "IfcDiscreteAccessory", "b": "IfcMechanicalFastener", "m": "IfcBeam"}
    rows = [
        (1, "d", "", "hex bolt M20"), (2, "d", "", "drill hole 22"), (3, "d", "", None), (4, "d", "", "hex bolt with a bore"), (5, "d", "x" * 30, "plate"), (6, "d", "gusset", "hex bolt"), (7, "b", "bolt", "a hole"), (8, "d", "a hole", "bolt"), (9, "m", "", "bolt"),
    ]
    elements = spark.createDataFrame([(i, kinds[k], t) for i, k, t, _ in rows], "element_id int, kind string, text string")
    attributes = spark.createDataFrame([(i, t) for i, _, _, t in rows if t is not None] + [(1, "and more")], "element_id int, text string")
    assert ids(resolve.fasteners_to_hide(elements, attributes)) == {1, 3, 4, 5, 6, 7}
    assert ids(resolve.fasteners_to_hide(elements, attributes.where("text <> 'and more'"), strict=True)) == {1, 7}
