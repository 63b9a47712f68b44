"""Spatial, text and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import framing, spatial, textspec
from ferrolith.operators.graph import shares
from ferrolith.sources import bindings
from ferrolith.streaming import jobs, sessions

_BOX = """box AS (SELECT label AS model_id, vec_id AS element_id, embedding[1]::DOUBLE - 0.05 AS min_x, embedding[1]::DOUBLE + 0.05 AS max_x, embedding[2]::DOUBLE - 0.05 AS min_y, embedding[2]::DOUBLE + 0.05 AS max_y,
  embedding[3]::DOUBLE - 0.05 AS min_z, embedding[3]::DOUBLE + 0.05 AS max_z FROM embeddings)"""


def boxes(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    sides = [x for i, a in enumerate("xyz") for x in ((e(i) - 0.05).alias(f"min_{a}"), (e(i) + 0.05).alias(f"max_{a}"))]
    return bindings.table(spark, sf_dir, "embeddings").select(F.col("label").alias("model_id"), F.col("vec_id").alias("element_id"), *sides)


def box_overlaps(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return spatial.overlaps(b, b, 0.15).where("element_id < other_id")


def near_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return spatial.fasteners_near_seeds(b.where("element_id % 4 = 0"), b.where("element_id % 40 = 1")).select("model_id", "element_id")


def prune_far(spark, sf_dir):
    b = boxes(spark, sf_dir)
    rows = spatial.prune_far(b.where("element_id % 4 = 0"), b.where("element_id % 4 = 1"))
    return rows.select("model_id", "element_id", F.round("d2", 8).alias("d2"))


def line_box(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    lines = bindings.table(spark, sf_dir, "embeddings").select(F.col("label").alias("model_id"), F.col("vec_id").alias("line_id"), *(e(3 + i).alias(f"o{a}") for i, a in enumerate("xyz")), *((e(6 + i) if i else F.lit(0.0)).alias(f"d{a}") for i, a in enumerate("xyz")))
    rows = spatial.line_boxes(lines, boxes(spark, sf_dir), 0.101)
    return rows.select("line_id", "element_id", F.round("t.t0", 6).alias("t0"), F.round("t.t1", 6).alias("t1"))


def collinear_clusters(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    size = F.sqrt(e(3) ** 2 + e(4) ** 2 + 25)
    rows = bindings.table(spark, sf_dir, "embeddings").select(F.col("label").alias("bolt_id"), F.col("vec_id").alias("sample_id"), *((e(i) / 5).alias(f"p{a}") for i, a in enumerate("xyz")), (e(3) / size).alias("ax"), (e(4) / size).alias("ay"), (5 / size).alias("az"))
    return spatial.collinear_clusters(rows).groupBy("bolt_id").agg(F.count_distinct("cluster").alias("n_clusters"))


def isolated_set(spark, sf_dir):
    b = boxes(spark, sf_dir)
    elements = b.select("element_id", (F.col("element_id") % 2 == 0).alias("companion"), (F.col("element_id") % 4 == 0).alias("fastener"))
    edges = b.select(F.col("element_id").alias("a"), (F.col("element_id") + 2).alias("b"))
    voids = b.where("element_id % 7 = 0").select((F.col("element_id") - 1).alias("host_id"), "element_id")
    return spatial.isolated_set(b.where("element_id % 50 = 2").select("element_id"), voids, edges, elements, b)


def _thin(spark, sf_dir):
    """Assemblies of 20 elements near each other, every fourth a bolt that is long on one axis."""
    e = lambda i: F.col("embedding")[i].cast("double") / 2
    bolt = F.col("vec_id") % 4 == 0
    half = lambda i: F.when(bolt, F.when(F.col("vec_id") % 3 == i, 0.1).otherwise(0.01)).otherwise(0.05)
    sides = [x for i, a in enumerate("xyz") for x in ((e(i) - half(i)).alias(f"min_{a}"), (e(i) + half(i)).alias(f"max_{a}"))]
    return bindings.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("assembly_id"), "vec_id", *sides)


def hidden_bolts(spark, sf_dir):
    rows = _thin(spark, sf_dir)
    bolts = rows.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "bolt_id")
    boxes = rows.where("vec_id % 4 > 0").drop("assembly_id").withColumnRenamed("vec_id", "element_id")
    members = rows.where("vec_id % 4 > 0").select("assembly_id", F.col("vec_id").alias("part_id"))
    up = {f"o{a}": spatial.centre(a) for a in "xyz"} | {"dx": F.lit(0.0), "dy": F.lit(0.0), "dz": F.lit(1.0), "length": F.lit(0.06)}
    holes = spatial.holes_by_lines_or_boxes(bolts.where("bolt_id % 8 = 0").withColumns(up), bolts, boxes, members)
    return spatial.hidden_bolts(bolts, holes, boxes, members)


def relation_prune(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("fastener"), F.lit("accessory"), F.lit(None).cast("string"), F.lit("steel")), (F.col("element_id") % 4 + 1).cast("int"))
    rows = boxes(spark, sf_dir).withColumn("kind", kind).withColumns({f"max_{a}": F.col(f"max_{a}") - F.when(F.col("element_id") % 3 == 0, 0.08).otherwise(0.0) for a in "xyz"})
    seeds = rows.where("element_id % 4 = 3 AND (min_x > 0 OR model_id % 2 = 0) AND element_id % 5 = 0")
    return spatial.prune_relations(rows, seeds, rows.where("element_id % 9 = 0").select("element_id")).select("model_id", "element_id")


def measures(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = bindings.table(spark, sf_dir, "embeddings").select("vec_id", *(e(i).alias(f"p1{a}") for i, a in enumerate("xyz")), *(e(3 + i).alias(f"p2{a}") for i, a in enumerate("xyz")))
    return rows.select("vec_id", *(F.round(c, 6).alias(n) for n, c in spatial.measure().items()))


def view_axis(spark, sf_dir):
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    rows = bindings.table(spark, sf_dir, "embeddings").select("vec_id", *(F.lit(0.0).alias(f"min_{a}") for a in "xyz"), *(e(i).alias(f"max_{a}") for i, a in enumerate("xyz")))
    return rows.select("vec_id", spatial.view_axis().alias("view"))


def history_window(spark, sf_dir):
    return textspec.history_window(bindings.table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 4)


def prompts(spark, sf_dir):
    """Specifications written from part rows."""
    p = F.col("p_size")
    lines = F.concat(
        F.lit("Steel warehouse, 4 columns, span of "), p + 5, F.when(F.col("p_partkey") % 2 == 0, " m").otherwise("000 mm"), F.lit(", width "), p * 100, F.lit(" mm, HEB "), p + 100, F.lit(" and RHS100x100x5.\nLevel 1 at Z="), p * 100 + 1000, F.lit(" mm\nLevel 2 (mezzanine zone, Level access) at Z = "), p * 100 + 4000,
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" mm\nFloor 1 Z=1 mm\nFloor 3 over the plaza Z = "), p * 100 + 5500, F.lit(" mm; Floor 4 Z = "), p * 100 + 5900, F.lit(" mm\nUpper Anchor Z = "), p * 100 + 9900)).otherwise(""),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" mm\nRoof Eave Z="), p * 100 + 7000, F.lit(" mm\nRoof Ridge Z="), p * 100 + 9000)).otherwise(""), F.lit(" mm\n"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("column height "), p % 5 + 3, F.lit(" m\n"))).otherwise(""),
    )
    return bindings.table(spark, sf_dir, "part").select("p_partkey", lines.alias("text"))


def text_dims(spark, sf_dir):
    return textspec.text_dimensions(prompts(spark, sf_dir)).drop("text")


def request_class(spark, sf_dir):
    flags = textspec.request_flags(F.concat("text", F.when(F.col("p_partkey") % 5 == 0, " with beams on top").otherwise("")))
    return prompts(spark, sf_dir).select("p_partkey", *(c.alias(n) for n, c in flags.items()))


def level_table(spark, sf_dir):
    return textspec.level_table(prompts(spark, sf_dir), "p_partkey")


def level_pairs(spark, sf_dir):
    return textspec.level_pairs(level_table(spark, sf_dir), "p_partkey")


def framing_rows(spark, sf_dir):
    levels = level_table(spark, sf_dir)
    return framing.floor_rows(levels, "p_partkey").unionByName(framing.roof_rows(levels, "p_partkey"))


def slab_rows(spark, sf_dir):
    return framing.slab_rows(level_table(spark, sf_dir), "p_partkey")


def section_profile(spark, sf_dir):
    return prompts(spark, sf_dir).select("p_partkey", framing.section_profile(F.col("text"), "width", "HEB200").alias("profile"))


def assignments(spark, sf_dir):
    words = F.array(*map(F.lit, ("Perimeter", "all", "y-min side", "perimeter", "unknown words")))
    rows = bindings.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(F.lit("vertical"), F.lit("horizontal_x")), (F.col("p_partkey") % 2 + 1).cast("int")).alias("o"), F.element_at(words, (F.col("p_partkey") % 5 + 1).cast("int")).alias("a"))
    return rows.select("p_partkey", framing.coerced_assignment(F.col("o"), F.col("a")).alias("placement"))


def allowed_hardware(spark, sf_dir):
    p = bindings.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("element_id"), "p_size")
    hops = p.select(F.col("element_id").alias("a"), (F.col("element_id") + 1).alias("b"))
    return framing.hardware_allowed(p.where("element_id % 20 = 0"), p.where("element_id % 100 = 10"), hops, p.where("p_size > 10"), 3)


def profile_mentions(spark, sf_dir):
    return textspec.profile_mentions(prompts(spark, sf_dir), "p_partkey")


def group_precedence(spark, sf_dir):
    ids = F.array(*map(F.lit, ("main_columns", "floor_joists_2", "knee_braces", "columns_along_y_min", "beams_along_y_per_x", "joists_along_x_spaced_y", "diagonals_per_x", "rails")))
    rows = bindings.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.element_at(ids, (F.col("l_partkey") % 8 + 1).cast("int")).alias("group_id"), F.when(F.col("l_partkey") % 8 < 3, "base").otherwise("quantity").alias("origin"))
    rows = rows.repartition(shares(rows), "id").distinct()
    return textspec.group_precedence(rows, "id").select("id", "group_id", "origin")


def _toggles(spark, sf_dir):
    e = bindings.table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "error", "reset").otherwise("toggle")
    return e.select(F.col("user_id").alias("session"), F.col("event_type").alias("key"), action.alias("action"), F.col("event_id").alias("seq"))


def toggle_parity(spark, sf_dir):
    return jobs.toggle_parity(_toggles(spark, sf_dir), ["session", "key"])


def stream_toggle_state(spark, sf_dir):
    e = jobs.file_stream(spark, sf_dir, "events.parquet")
    rows = e.select(F.col("user_id").alias("session"), F.col("event_type").alias("key"))
    return jobs.run_to_table(jobs.stream_parity(rows, ["session", "key"]), "complete", "toggles")


def stream_reset_state(spark, sf_dir):
    e = jobs.file_stream(spark, sf_dir, "events.parquet")
    action = F.when(F.col("event_type") == "error", "reset").otherwise("toggle")
    rows = e.select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("key"), action.alias("action"))
    held = sessions.latest(jobs.run_to_table(sessions.changes_of(rows, sessions.Toggles()), "append", "reset-toggles"))
    # keys toggled an even number of times are not hidden
    return held.select("session", "key", F.col("value").cast("long").alias("n_toggles"))


def _selecting(e):
    ids = F.array(F.col("event_id") % 5, F.col("event_id") % 3)
    item = F.when(F.col("event_id") % 4 < 2, F.concat(F.lit("w"), F.col("event_id") % 3))
    action = F.when(F.col("event_type") == "error", "clear").otherwise("toggle")
    return e.select("event_id", F.col("user_id").alias("session"), action.alias("action"), ids.alias("ids"), item.alias("item"), F.col("value").alias("weight"))


def stream_selection(spark, sf_dir):
    rows = _selecting(jobs.file_stream(spark, sf_dir, "events.parquet"))
    return sessions.latest(jobs.run_to_table(sessions.changes_of(rows, sessions.Selection()), "append", "selection"))


def _revealing(e):
    action = F.when(F.col("event_type") == "error", "exit").when(F.col("event_id") % 4 == 0, "tab").otherwise("group")
    tab = F.element_at(F.array(*map(F.lit, ("assemblies", "parts", "profiles"))), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", F.col("user_id").alias("session"), action.alias("action"), tab.alias("tab"), F.array(F.col("event_id") % 5, F.col("event_id") % 3).alias("ids"))


def stream_reveal(spark, sf_dir):
    rows = _revealing(jobs.file_stream(spark, sf_dir, "events.parquet"))
    return sessions.latest(jobs.run_to_table(sessions.changes_of(rows, sessions.Reveal()), "append", "reveal")).drop("value")


def reveal_state(spark, sf_dir):
    rows = sessions.revealed(_revealing(bindings.table(spark, sf_dir, "events")))
    return rows.select("session", "tab", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


def stream_ingest(spark, sf_dir):
    e = jobs.file_stream(spark, sf_dir, "events.parquet")
    return jobs.run_to_table(jobs.deduplicated_ingest(e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value"), "event_id", "ts"), "append", "ingest").select("event_id", "user_id", "value")


def stream_upsert(spark, sf_dir):
    e = jobs.file_stream(spark, sf_dir, "events.parquet")
    rows = e.select(F.concat_ws("/", "user_id", "event_type").alias("element"), "event_id", "user_id", F.col("value").alias("weight"))
    return jobs.upserted(rows, "element", "event_id", jobs.new_base(spark, "upsert"))


def selection_state(spark, sf_dir):
    rows = bindings.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.array(F.col("event_id") % 5, F.col("event_id") % 3).alias("ids"))
    return jobs.selection_state(rows, "session").select("session", F.array_join(F.transform("selected", lambda x: x.cast("string")), ",").alias("selected"))


_P = """p AS (SELECT p_partkey, p_size AS s, p_partkey % 3 = 0 AS roof, p_partkey % 4 = 0 AS high, p_partkey % 5 = 0 AS floors FROM part),
lv AS (SELECT p_partkey, unnest([{'name': 'Ground', 'z': 0.0::DOUBLE}, {'name': 'Level1', 'z': s * 100 + 1000}, {'name': 'Level2', 'z': s * 100 + 4000}, {'name': 'Floor3', 'z': CASE WHEN floors THEN s * 100 + 5500 END}, {'name': 'Floor4', 'z': CASE WHEN floors THEN s * 100 + 5900 END}, {'name': 'UpperAnchor', 'z': CASE WHEN floors THEN s * 100 + 9900 END}, {'name': 'Eave', 'z': CASE WHEN roof THEN s * 100 + 7000 END}, {'name': 'Ridge', 'z': CASE WHEN roof THEN s * 100 + 9000 END}], recursive := true) FROM p),
levels AS (SELECT p_partkey, name, z::DOUBLE AS elevation_mm FROM lv WHERE z IS NOT NULL)"""

_REVEAL = """WITH RECURSIVE e AS (SELECT user_id AS session, CASE WHEN event_type = 'error' THEN 'exit' WHEN event_id % 4 = 0 THEN 'tab' ELSE 'grp' END AS act, ['assemblies', 'parts', 'profiles'][event_id % 3 + 1] AS to_tab,
    list_distinct([event_id % 5, event_id % 3]) AS ids, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT session, 0::BIGINT AS n, NULL::VARCHAR AS tab, []::BIGINT[] AS parts FROM e UNION ALL
  SELECT s.session, e.n, CASE act WHEN 'grp' THEN s.tab WHEN 'tab' THEN to_tab END,
    CASE WHEN act <> 'grp' THEN [] WHEN s.tab IS NULL THEN parts WHEN len(list_filter(ids, lambda x: NOT list_contains(parts, x))) = 0 THEN list_filter(parts, lambda x: NOT list_contains(ids, x)) ELSE list_distinct(list_concat(parts, ids)) END
  FROM s JOIN e ON e.session = s.session AND e.n = s.n + 1),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC) = 1)"""

QUERIES = {
    "box_overlaps": (box_overlaps, f"""WITH {_BOX} SELECT a.model_id, a.element_id, b.element_id AS other_id FROM box a JOIN box b ON a.model_id = b.model_id AND a.element_id < b.element_id
        AND {" AND ".join(f"a.min_{x} <= b.max_{x} AND b.min_{x} <= a.max_{x}" for x in "xyz")}"""),
    "near_boxes": (near_boxes, f"""WITH {_BOX}, h AS (SELECT model_id, {", ".join(f"min(min_{x}) AS l{x}, max(max_{x}) AS h{x}" for x in "xyz")} FROM box WHERE element_id % 40 = 1 GROUP BY 1),
        d AS (SELECT *, sqrt({" + ".join(f"(h{x} - l{x}) * (h{x} - l{x})" for x in "xyz")}) * 0.075 AS pad FROM h)
        SELECT model_id, element_id FROM box JOIN d USING (model_id) WHERE element_id % 4 = 0 AND {" AND ".join(f"min_{x} <= h{x} + pad AND max_{x} >= l{x} - pad" for x in "xyz")}"""),
    "prune_far": (prune_far, f"""WITH {_BOX}, h AS (SELECT model_id, least(0.18, greatest(0.004, 0.04 * sqrt({" + ".join(f"(max(max_{x}) - min(min_{x})) ** 2" for x in "xyz")}))) AS lim FROM box WHERE element_id % 4 = 1 GROUP BY 1),
        d AS (SELECT f.model_id, f.element_id, lim, {" + ".join(f"greatest(s.min_{x} - sl - (f.min_{x} + f.max_{x}) / 2, (f.min_{x} + f.max_{x}) / 2 - s.max_{x} - sl, 0) ** 2" for x in "xyz")} AS d2
          FROM box f JOIN h USING (model_id) JOIN (SELECT *, 0.012 * sqrt({" + ".join(f"(max_{x} - min_{x}) ** 2" for x in "xyz")}) AS sl FROM box WHERE element_id % 4 = 1) s ON s.model_id = f.model_id WHERE f.element_id % 4 = 0)
        SELECT model_id, element_id, round(min(d2), 8) AS d2 FROM d GROUP BY 1, 2, lim HAVING min(d2) <= lim * lim"""),
    "line_box": (line_box, f"""WITH {_BOX}, l AS (SELECT label AS model_id, vec_id AS line_id, embedding[4]::DOUBLE AS ox, embedding[5]::DOUBLE AS oy, embedding[6]::DOUBLE AS oz, embedding[8]::DOUBLE AS dy, embedding[9]::DOUBLE AS dz FROM embeddings),
        t AS (SELECT line_id, element_id, greatest(least((min_y - oy) / dy, (max_y - oy) / dy), least((min_z - oz) / dz, (max_z - oz) / dz)) AS t0, least(greatest((min_y - oy) / dy, (max_y - oy) / dy), greatest((min_z - oz) / dz, (max_z - oz) / dz)) AS t1
          FROM l JOIN box USING (model_id) WHERE ox BETWEEN min_x AND max_x)
        SELECT line_id, element_id, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM t WHERE t0 <= t1"""),
    "collinear_clusters": (collinear_clusters, None),
    "isolated_set": (isolated_set, None),
    "hidden_bolts": (hidden_bolts, f"""
        WITH b AS (SELECT vec_id // 20 AS a, vec_id AS id, vec_id % 4 = 0 AS bolt, {", ".join(f"embedding[{i + 1}]::DOUBLE / 2 AS c{x}, CASE WHEN vec_id % 4 > 0 THEN 0.05::DOUBLE WHEN vec_id % 3 = {i} THEN 0.1 ELSE 0.01 END AS h{x}" for i, x in enumerate("xyz"))} FROM embeddings),
        p AS (SELECT o.id, {", ".join(f"abs(o.c{x} - p.c{x}) <= p.h{x} AS i{x}, least(abs(p.c{x} - p.h{x} - o.c{x}), abs(p.c{x} + p.h{x} - o.c{x})) AS f{x}" for x in "xyz")} FROM b o JOIN b p ON o.a = p.a AND o.bolt AND NOT p.bolt),
        h AS (SELECT id, bool_or(id % 8 = 0 AND ix AND iy AND fz <= 0.035) OR bool_or(CASE id % 3 WHEN 0 THEN iy AND iz AND fx <= 0.105 WHEN 1 THEN ix AND iz AND fy <= 0.105 ELSE ix AND iy AND fz <= 0.105 END) AS hole, bool_or(ix AND iy AND iz) AS inside FROM p GROUP BY 1)
        SELECT id AS bolt_id FROM b LEFT JOIN h USING (id) WHERE bolt AND NOT coalesce(hole AND inside, false)"""),
    "relation_prune": (relation_prune, f"""
        WITH {_BOX}, e AS (SELECT model_id, element_id, element_id % 4 AS k, {", ".join(f"min_{x}, max_{x} - CASE WHEN element_id % 3 = 0 THEN 0.08::DOUBLE ELSE 0 END AS max_{x}" for x in "xyz")} FROM box),
        s AS (SELECT * FROM e WHERE k = 3 AND (min_x > 0 OR model_id % 2 = 0) AND element_id % 5 = 0), h AS (SELECT model_id, {", ".join(f"min(min_{x}) AS l{x}, max(max_{x}) AS h{x}" for x in "xyz")} FROM s GROUP BY 1),
        c AS (SELECT *, sqrt({" + ".join(f"(h{x} - l{x}) ** 2" for x in "xyz")}) AS d FROM h WHERE model_id IN (SELECT model_id FROM e WHERE element_id % 9 = 0)),
        f AS (SELECT e.*, d, sqrt({" + ".join(f"(max_{x} - min_{x}) ** 2" for x in "xyz")}) < d * 0.085 AS tiny, {" + ".join(f"greatest(lx_.l{x} - 0.012 * d - (min_{x} + max_{x}) / 2, (min_{x} + max_{x}) / 2 - lx_.h{x} - 0.012 * d, 0) ** 2" for x in "xyz")} AS d2 FROM e LEFT JOIN c lx_ USING (model_id))
        SELECT model_id, element_id FROM f WHERE element_id % 9 = 0 OR (model_id, element_id) IN (SELECT model_id, element_id FROM s) OR d IS NULL OR k = 3 OR (k = 2 AND NOT tiny)
          OR CASE WHEN d < 2 THEN d2 <= greatest(0.004, least(0.22, d * 0.12, d * 0.055)) ** 2 ELSE k = 1 AND tiny AND d2 <= greatest(0.008, least(0.036, d * 0.009)) ** 2 END"""),
    "measures": (measures, "SELECT vec_id, round(sqrt((e[4] - e[1]) ** 2 + (e[5] - e[2]) ** 2 + (e[6] - e[3]) ** 2), 6) AS direct, round(abs(e[6] - e[3]), 6) AS height, round(sqrt((e[4] - e[1]) ** 2 + (e[5] - e[2]) ** 2), 6) AS horizontal FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"),
    "view_axis": (view_axis, """WITH s AS (SELECT vec_id, abs(embedding[1]::DOUBLE) AS x, abs(embedding[2]::DOUBLE) AS y, abs(embedding[3]::DOUBLE) AS z FROM embeddings)
        SELECT vec_id, CASE WHEN least(x, y, z) / greatest(x, y, z, 1e-9) < 0.28 THEN CASE least(x, y, z) WHEN z THEN 'front' WHEN y THEN 'top' ELSE 'right' END WHEN z > x AND z > y THEN 'right' ELSE 'front' END AS view FROM s"""),
    "history_window": (history_window, """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
        SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user'), '') AS text FROM r WHERE n <= 4 GROUP BY 1"""),
    "text_dims": (text_dims, f"WITH {_P} SELECT p_partkey, CASE WHEN high THEN (s % 5 + 3) * 1000 ELSE 3500 END::DOUBLE AS height_mm, (s + 5) * 1000::DOUBLE AS span_mm, s * 100::DOUBLE AS width_mm, 4 AS n_columns FROM p"),
    "request_class": (request_class, "SELECT p_partkey, p_partkey % 5 = 0 AS portal, true AS shed FROM part"),
    "level_table": (level_table, f"WITH {_P} SELECT * FROM levels"),
    "level_pairs": (level_pairs, f"""WITH {_P}, l AS (SELECT *, lead(name) OVER w AS n2, lead(elevation_mm) OVER w AS z2 FROM levels WHERE name <> 'Ridge' WINDOW w AS (PARTITION BY p_partkey ORDER BY elevation_mm, name))
        SELECT p_partkey, name AS start_level, n2 AS end_level, z2 - elevation_mm AS rise_mm FROM l WHERE z2 - elevation_mm > 1e-6"""),
    "framing_rows": (framing_rows, f"""WITH {_P}, f AS (SELECT p_partkey, name, unnest([{{'g': 'girders', 'orientation': 'horizontal_x', 'assigned_to_grid': 'along_x_between_columns', 'spacing_mm': NULL}}, {{'g': 'cross_beams', 'orientation': 'horizontal_y', 'assigned_to_grid': 'along_y_per_x_station', 'spacing_mm': NULL}},
          {{'g': 'joists', 'orientation': 'horizontal_x', 'assigned_to_grid': 'distributed_along_y', 'spacing_mm': 2000.0::DOUBLE}}], recursive := true) FROM levels WHERE regexp_matches(name, '^(Level|Floor)[0-9]')),
        r AS (SELECT p_partkey, unnest([{{'group_id': 'rafters', 'o': 'inclined_dual_y', 'a': 'per_frame', 'x': 'Eave', 'y': 'Ridge'}}, {{'group_id': 'webs', 'o': 'truss_web_panels', 'a': 'warren', 'x': 'Eave', 'y': 'Ridge'}}, {{'group_id': 'purlins', 'o': 'roof_purlins_dual_slope', 'a': 'both_slopes', 'x': 'Eave', 'y': 'Ridge'}},
          {{'group_id': 'girts', 'o': 'wall_girts_fixed_z', 'a': 'outer_walls', 'x': 'Ground', 'y': 'Eave'}}, {{'group_id': 'eave_beams', 'o': 'horizontal_x', 'a': 'along_x_between_columns', 'x': 'Eave', 'y': 'Eave'}}], recursive := true) FROM p WHERE roof)
        SELECT p_partkey, lower(name) || '_' || g AS group_id, orientation, assigned_to_grid, name AS start_level, name AS end_level, spacing_mm FROM f UNION ALL SELECT p_partkey, group_id, o, a, x, y, NULL FROM r"""),
    "slab_rows": (slab_rows, f"""WITH {_P} SELECT p_partkey, CASE name WHEN 'Ground' THEN 'foundation' ELSE 'deck_' || lower(name) END AS slab_id, name AS top_level, 150.0::DOUBLE AS thickness_mm FROM levels WHERE name = 'Ground' OR regexp_matches(name, '^(Level|Floor)[0-9]')"""),
    "section_profile": (section_profile, "SELECT p_partkey, 'HEB' || (p_size + 100) AS profile FROM part"),
    "assignments": (assignments, """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 5 IN (0, 3) THEN 'perimeter' WHEN p_partkey % 5 = 2 THEN 'along_all_x_at_y_min' ELSE 'all_frame_lines' END ELSE 'along_x_between_columns' END AS placement FROM part"""),
    "allowed_hardware": (allowed_hardware, """WITH RECURSIVE w AS (SELECT p_partkey AS e, 0 AS d FROM part WHERE p_partkey % 20 = 0 OR p_partkey % 100 = 10
          UNION SELECT p_partkey, d + 1 FROM w JOIN part ON abs(p_partkey - e) = 1 WHERE p_size > 10 AND d < 3) SELECT DISTINCT e AS element_id FROM w"""),
    "profile_mentions": (profile_mentions, f"""WITH {_P}, h AS (SELECT p_partkey, s, 'Steel warehouse, 4 columns, span of ' || (s + 5) || CASE WHEN p_partkey % 2 = 0 THEN ' m' ELSE '000 mm' END || ', width ' || (s * 100) || ' mm, ' AS a FROM p)
        SELECT p_partkey, 'family' AS kind, length(a)::INT AS place, 'HEB' || (s + 100) AS key FROM h UNION ALL SELECT p_partkey, 'box', (length(a) + length('HEB ' || (s + 100) || ' and '))::INT, '100x100x5' FROM h"""),
    "group_precedence": (group_precedence, """
        WITH r AS (SELECT DISTINCT l_orderkey AS id, ['main_columns', 'floor_joists_2', 'knee_braces', 'columns_along_y_min', 'beams_along_y_per_x', 'joists_along_x_spaced_y', 'diagonals_per_x', 'rails'][l_partkey % 8 + 1] AS g, CASE WHEN l_partkey % 8 < 3 THEN 'base' ELSE 'quantity' END AS o FROM lineitem),
        f AS (SELECT id, sum((o = 'quantity')::INT) >= 5 AND bool_or(g = 'beams_along_y_per_x') AND bool_or(g = 'diagonals_per_x') AS done, bool_or(g = 'main_columns') AS a, bool_or(g = 'floor_joists_2') AS b, bool_or(g = 'knee_braces') AS c FROM r GROUP BY 1)
        SELECT id, g AS group_id, o AS origin FROM r JOIN f USING (id) WHERE CASE WHEN o = 'base' THEN NOT done ELSE done OR NOT ((g = 'columns_along_y_min' AND a) OR (g = 'joists_along_x_spaced_y' AND b) OR (g = 'diagonals_per_x' AND c)) END"""),
    "toggle_parity": (toggle_parity, """
        WITH e AS (SELECT user_id AS session, event_type AS key, event_id AS seq, event_type = 'error' AS reset FROM events), r AS (SELECT session, max(seq) AS s FROM e WHERE reset GROUP BY 1)
        SELECT session, key, count(*) AS n_toggles, count(*) % 2 = 1 AS hidden FROM e LEFT JOIN r USING (session) WHERE NOT reset AND (s IS NULL OR seq > s) GROUP BY 1, 2"""),
    "stream_toggle_state": (stream_toggle_state, "SELECT user_id AS session, event_type AS key, count(*) AS n_toggles, count(*) % 2 = 1 AS hidden FROM events GROUP BY 1, 2"),
    "stream_reset_state": (stream_reset_state, """
        WITH e AS (SELECT user_id AS session, event_type AS key, event_id AS seq, event_type = 'error' AS reset FROM events), r AS (SELECT session, max(seq) AS s FROM e WHERE reset GROUP BY 1)
        SELECT session, key, count(*) AS n_toggles FROM e LEFT JOIN r USING (session) WHERE NOT reset AND (s IS NULL OR seq > s) GROUP BY 1, 2 HAVING count(*) % 2 = 1"""),
    "stream_selection": (stream_selection, """
        WITH RECURSIVE e AS (SELECT user_id AS session, event_type = 'error' AS clear, list_distinct([event_id % 5, event_id % 3]) AS ids, CASE WHEN event_id % 4 < 2 THEN 'w' || (event_id % 3) END AS item, value AS weight,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        s AS (SELECT DISTINCT session, 0::BIGINT AS n, []::BIGINT[] AS sel, []::STRUCT(item VARCHAR, weight DOUBLE, ids BIGINT[])[] AS items FROM e UNION ALL
          SELECT session, n,
            CASE WHEN clear THEN [] WHEN away THEN list_filter(sel, lambda x: NOT list_contains(ids, x) AND NOT list_contains(flatten(list_transform(old, lambda o: o.ids)), x)) ELSE list_distinct(list_concat(sel, ids)) END,
            CASE WHEN clear THEN [] WHEN item IS NULL THEN items WHEN away THEN list_filter(items, lambda o: o.item <> item) ELSE list_append(items, {'item': item, 'weight': weight, 'ids': ids}) END
          FROM (SELECT *, len(old) > 0 OR len(list_filter(ids, lambda x: NOT list_contains(sel, x))) = 0 AS away
            FROM (SELECT s.session, e.n, s.sel, s.items, e.clear, e.ids, e.item, e.weight, list_filter(s.items, lambda o: coalesce(o.item = e.item, false)) AS old FROM s JOIN e ON e.session = s.session AND e.n = s.n + 1))),
        f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC) = 1)
        SELECT session, 'id' AS kind, unnest(sel)::VARCHAR AS key, NULL::DOUBLE AS value FROM f UNION ALL SELECT session, 'item', i.item, i.weight FROM (SELECT session, unnest(items) AS i FROM f)"""),
    "stream_reveal": (stream_reveal, f"""{_REVEAL}
        SELECT session, 'part' AS kind, unnest(parts)::VARCHAR AS key FROM f UNION ALL SELECT session, 'tab', tab FROM f WHERE tab IS NOT NULL"""),
    "reveal_state": (reveal_state, f"{_REVEAL} SELECT session, tab, array_to_string(list_sort(parts), ',') AS parts FROM f"),
    "stream_upsert": (stream_upsert, "SELECT user_id || '/' || event_type AS element, max(event_id) AS event_id, user_id, max_by(value, event_id) AS weight FROM events GROUP BY user_id, event_type"),
    "stream_ingest": (stream_ingest, "SELECT DISTINCT event_id, user_id, value FROM events"),
    "selection_state": (selection_state, """
        WITH RECURSIVE e AS (SELECT user_id AS session, list_distinct([event_id % 5, event_id % 3]) AS ids, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        s AS (SELECT DISTINCT session, 0::BIGINT AS n, []::BIGINT[] AS sel FROM e UNION ALL
          SELECT s.session, e.n, CASE WHEN len(list_filter(e.ids, lambda x: NOT list_contains(s.sel, x))) = 0 THEN list_filter(s.sel, lambda x: NOT list_contains(e.ids, x)) ELSE list_distinct(list_concat(s.sel, e.ids)) END
          FROM s JOIN e ON e.session = s.session AND e.n = s.n + 1)
        SELECT session, array_to_string(list_sort(sel), ',') AS selected FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC) = 1"""),
}
