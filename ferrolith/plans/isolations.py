"""Queries over isolated sets: elements of 200 a model, with boxes from millimetres to tens of metres."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import isolation, spatial
from ferrolith.sources import bindings

KINDS = ("fastener", "accessory", "connection", "opening", "member", "steel", "steel")


def elements(spark, sf_dir):
    """Vectors as elements; every seventh size class is ten times as large as the one before, over five classes."""
    i = F.col("vec_id")
    e = lambda k: F.col("embedding")[k].cast("double")
    half = F.element_at(F.array(*map(F.lit, (0.004, 0.03, 0.05, 0.4, 4.0))), (i % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (i % 7 + 1).cast("int"))
    sides = [x for k, a in enumerate("xyz") for x in ((e(k) * 4 - half).alias(f"min_{a}"), (e(k) * 4 + half).alias(f"max_{a}"))]
    return bindings.table(spark, sf_dir, "embeddings").select(F.floor(i / 200).alias("model_id"), i.alias("element_id"), kind.alias("kind"), *sides)


def _sets(spark, sf_dir):
    rows = elements(spark, sf_dir)
    steel = rows.where("kind = 'steel' AND element_id % 3 = 0 AND element_id % 5 < 3")
    links = rows.where("kind = 'fastener' AND element_id % 4 = 0")
    overlay = rows.where("kind = 'fastener' AND element_id % 50 = 7")
    connections = rows.select(F.col("element_id").alias("a"), (F.col("element_id") + 2).alias("b"))
    return rows, steel, links, overlay, connections


def level_overlaps(spark, sf_dir):
    rows = elements(spark, sf_dir)
    pairs = spatial.overlaps(rows, rows, 0.01).where("element_id <> other_id")
    return pairs.groupBy("model_id", "element_id").agg(F.count(F.lit(1)).alias("n"), F.min("other_id").alias("first_id"))


def production_allowed(spark, sf_dir):
    rows, steel, links, overlay, connections = _sets(spark, sf_dir)
    return isolation.production_allowed(links, overlay, steel, connections, rows)


def orphan_prune(spark, sf_dir):
    rows, steel, links, overlay, _ = _sets(spark, sf_dir)
    seeds = steel.where("element_id % 2 = 0 AND model_id % 3 < 2")
    return isolation.prune_orphans(rows, seeds, links.union(overlay), steel).select("model_id", "element_id", "kind")


def isolated_by_mode(spark, sf_dir):
    """Three modes of the same picks: plain, by relation, production."""
    rows, steel, links, overlay, connections = _sets(spark, sf_dir)
    seeds = steel.where("element_id % 2 = 0")
    voids = rows.where("kind = 'opening'").select((F.col("element_id") + 2).alias("host_id"), "element_id")
    allowed = links.union(overlay)
    modes = {
        "plain": isolation.isolated(rows, seeds, voids, connections, allowed=allowed, spatial_allowed=links),
        "relation": isolation.isolated(rows, seeds, voids, connections, relation_bolts=overlay, allowed=allowed),
        "production": isolation.isolated(rows, seeds, voids, connections, relation_bolts=overlay, allowed=allowed, steel=seeds, enforce=True, hide_fasteners=True),
    }
    out = [df.select(F.lit(mode).alias("mode"), "model_id", "element_id") for mode, df in modes.items()]
    return out[0].union(out[1]).union(out[2])


def hole_scopes(spark, sf_dir):
    lines = bindings.table(spark, sf_dir, "lineitem")
    visible = lines.select(F.col("l_orderkey").alias("pick_id"), F.col("l_partkey").alias("element_id"))
    displayed = lines.where("l_orderkey % 3 = 0 AND l_linenumber = 1").select(F.col("l_orderkey").alias("pick_id"), F.col("l_partkey").alias("element_id"))
    pool = lines.select(F.col("l_orderkey").alias("pick_id"), F.col("l_suppkey").alias("element_id"))
    part_pool = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("pick_id"), F.col("l_suppkey").alias("element_id"))
    return isolation.hole_scopes(visible, displayed, pool, part_pool)


_SIDE = ", ".join(f"embedding[{k + 1}]::DOUBLE * 4 - half AS min_{a}, embedding[{k + 1}]::DOUBLE * 4 + half AS max_{a}" for k, a in enumerate("xyz"))
_MEET = lambda a, b, pad="0": " AND ".join(f"{a}.min_{x} <= {b}.max_{x} + {pad} AND {b}.min_{x} - {pad} <= {a}.max_{x}" for x in "xyz")
_DIAG = lambda lo="min_", hi="max_": "sqrt(" + " + ".join(f"({hi}{x} - {lo}{x}) ** 2" for x in "xyz") + ")"
_FAR = lambda box, slop: " + ".join(f"greatest(h.min_{x} - {slop} - ({box}.min_{x} + {box}.max_{x}) / 2, ({box}.min_{x} + {box}.max_{x}) / 2 - h.max_{x} - {slop}, 0) ** 2" for x in "xyz")
_HULL = ", ".join(f"min(min_{x}) AS min_{x}, max(max_{x}) AS max_{x}" for x in "xyz")
_BASE = f"""e AS (SELECT vec_id // 200 AS model_id, vec_id AS element_id, {list(KINDS)}[vec_id % 7 + 1] AS kind, {_SIDE}
  FROM (SELECT *, [0.004::DOUBLE, 0.03, 0.05, 0.4, 4.0][vec_id % 5 + 1] AS half FROM embeddings)),
steel AS (SELECT * FROM e WHERE kind = 'steel' AND element_id % 3 = 0 AND element_id % 5 < 3),
links AS (SELECT element_id FROM e WHERE kind = 'fastener' AND element_id % 4 = 0), overlay AS (SELECT element_id FROM e WHERE kind = 'fastener' AND element_id % 50 = 7),
allowed AS (SELECT * FROM links UNION SELECT * FROM overlay), good AS (SELECT element_id FROM e WHERE kind IN ('fastener', 'accessory', 'connection', 'opening')),
gated AS (SELECT element_id FROM e WHERE kind IN ('connection', 'opening') OR kind IN ('fastener', 'accessory') AND element_id IN (FROM allowed))"""
_NEAR = lambda seeds: f"""SELECT f.model_id, f.element_id FROM e f JOIN (SELECT *, {_DIAG()} AS d FROM (SELECT model_id, {_HULL} FROM {seeds} GROUP BY 1)) h USING (model_id)
  WHERE f.kind = 'fastener' AND d > 0 AND {_MEET("f", "h", "greatest(d * 0.018, least(d * 0.075, d * 0.16))")}"""  # noqa: E731
_HOP = lambda source, good: f"SELECT element_id FROM {source} UNION SELECT g.element_id FROM {source} s JOIN {good} g ON abs(g.element_id - s.element_id) = 2"
_ORPHANS = lambda rows, seeds, steel: f"""SELECT r.* FROM {rows} r LEFT JOIN (SELECT *, {_DIAG()} AS d FROM (SELECT model_id, {_HULL} FROM {seeds} GROUP BY 1)) h USING (model_id)
  WHERE r.element_id IN (SELECT element_id FROM {seeds}) OR r.element_id IN (FROM allowed) OR r.element_id IN (SELECT element_id FROM {steel}) OR NOT (r.kind IN ('fastener', 'accessory') OR r.kind = 'member' AND
    ({_DIAG("r.min_", "r.max_")} <= greatest(0.1, least(0.32, coalesce(d * 0.042, 0.22))) OR coalesce({_FAR("r", "d * 0.012")} > greatest(0.004, least(0.22, d * 0.12, d * 0.055)) ** 2, false)))"""  # noqa: E731
_CLAMP = "greatest({1}, least({2}, {0}))"
_RELATED = lambda rows: f"""SELECT r.* FROM {rows} r LEFT JOIN (SELECT *, {_DIAG()} AS d FROM (SELECT model_id, {_HULL} FROM seeds GROUP BY 1)) h ON h.model_id = r.model_id AND d > 0 AND h.model_id IN (SELECT model_id FROM {rows} WHERE element_id IN (FROM allowed))
  WHERE r.element_id IN (SELECT element_id FROM seeds) OR r.element_id IN (FROM allowed) OR d IS NULL OR r.kind NOT IN ('fastener', 'accessory') AND NOT {_DIAG("r.min_", "r.max_")} < d * 0.085
    OR r.kind NOT IN ('fastener', 'accessory')
    OR CASE WHEN d < 2 THEN {_FAR("r", "d * 0.012")} <= greatest(0.004, least(0.22, d * 0.12, d * 0.055)) ** 2
       ELSE r.kind = 'accessory' AND {_DIAG("r.min_", "r.max_")} < d * 0.085 AND {_FAR("r", "d * 0.012")} <= greatest(0.008, least(0.036, d * 0.009)) ** 2 END"""  # noqa: E731

QUERIES = {
    "level_overlaps": (level_overlaps, f"WITH {_BASE} SELECT a.model_id, a.element_id, count(*) AS n, min(b.element_id) AS first_id FROM e a JOIN e b ON a.model_id = b.model_id AND a.element_id <> b.element_id AND {_MEET('a', 'b')} GROUP BY 1, 2"),
    "production_allowed": (production_allowed, f"""WITH {_BASE}, w0 AS (SELECT element_id FROM steel), w1 AS ({_HOP("w0", "good")}), w2 AS ({_HOP("w1", "good")}), w3 AS ({_HOP("w2", "good")}),
        c AS (SELECT * FROM e WHERE kind = 'fastener' AND (element_id IN (FROM w3) OR element_id IN (SELECT element_id FROM ({_NEAR("steel")}))))
        SELECT element_id FROM allowed UNION SELECT c.element_id FROM c JOIN steel s ON c.model_id = s.model_id AND {_MEET("c", "s", "0.06")}"""),
    "orphan_prune": (orphan_prune, f"WITH {_BASE}, seeds AS (SELECT * FROM steel WHERE element_id % 2 = 0 AND model_id % 3 < 2), o AS ({_ORPHANS('e', 'seeds', 'steel')}) SELECT model_id, element_id, kind FROM o"),
    "isolated_by_mode": (isolated_by_mode, f"""WITH {_BASE}, seeds AS (SELECT * FROM steel WHERE element_id % 2 = 0), host AS (SELECT o.element_id FROM e o JOIN seeds s ON s.element_id = o.element_id + 2 WHERE o.kind = 'opening'),
        near AS ({_NEAR("seeds")}),
        p0 AS (SELECT element_id FROM seeds UNION FROM host), p1 AS ({_HOP("p0", "gated")}), p2 AS ({_HOP("p1", "gated")}), p3 AS (FROM p2 UNION SELECT element_id FROM near WHERE element_id IN (FROM links)), p4 AS ({_HOP("p3", "gated")}),
        prow AS (SELECT * FROM e WHERE element_id IN (FROM p4)), lim AS (SELECT model_id, least(0.18, greatest(0.004, {_DIAG()} * 0.04)) AS lim FROM (SELECT model_id, {_HULL} FROM seeds GROUP BY 1)),
        close AS (SELECT DISTINCT f.element_id FROM prow f JOIN lim USING (model_id) JOIN seeds h ON h.model_id = f.model_id WHERE f.kind = 'fastener' AND {_FAR("f", "(0.012 * " + _DIAG("h.min_", "h.max_") + ")")} <= lim * lim),
        q0 AS (FROM p0 UNION FROM overlay), q1 AS ({_HOP("q0", "good")}), q2 AS ({_HOP("q1", "good")}), q3 AS (FROM q2 UNION SELECT element_id FROM near), q4 AS ({_HOP("q3", "good")}), qrow AS (SELECT * FROM e WHERE element_id IN (FROM q4)),
        rel AS ({_RELATED("qrow")}), strict AS (SELECT * FROM rel WHERE kind NOT IN ('fastener', 'accessory') OR element_id IN (FROM allowed)), orp AS ({_ORPHANS("strict", "seeds", "seeds")})
        SELECT 'plain' AS mode, model_id, element_id FROM prow WHERE kind <> 'fastener' OR element_id IN (FROM close) UNION ALL SELECT 'relation', model_id, element_id FROM rel
        UNION ALL SELECT 'production', model_id, element_id FROM orp WHERE kind NOT IN ('fastener', 'accessory')"""),
    "hole_scopes": (hole_scopes, """WITH s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber = 1)
        SELECT DISTINCT l_orderkey AS pick_id, l_partkey AS element_id, 'steel' AS role FROM lineitem WHERE l_orderkey NOT IN (FROM s) OR l_orderkey % 3 = 0 AND l_linenumber = 1
        UNION SELECT DISTINCT l_orderkey, l_suppkey, 'bolt' FROM lineitem WHERE l_orderkey NOT IN (FROM s) OR l_linenumber = 1"""),
}
