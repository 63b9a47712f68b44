"""Queries over model extraction and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import extract, layout
from ferrolith.sources import bindings

_KIND = "['IfcBeam', 'IfcPlate', 'IfcSite', 'IfcFastener', 'IfcColumn', 'IfcWall'][p_partkey % 6 + 1]"


def _elements(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("IfcBeam", "IfcPlate", "IfcSite", "IfcFastener", "IfcColumn", "IfcWall")))
    p = bindings.table(spark, sf_dir, "part")
    return p.select(F.col("p_size").alias("model_id"), F.floor(F.col("p_partkey") / 2).alias("express_id"), F.col("p_partkey").alias("element_id"), F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")).alias("ifc_type"), F.col("p_partkey").alias("seq"))


def scan_order(spark, sf_dir):
    return extract.scan_order(_elements(spark, sf_dir))


def part_index(spark, sf_dir):
    rows = bindings.table(spark, sf_dir, "lineitem").select(F.lit(1).alias("model_id"), F.col("l_partkey").alias("element_id"), F.col("l_quantity").alias("quantity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_suppkey") / 1000).alias("seq"))
    return extract.part_index(rows, "quantity").select("element_id", "place")


def distinct_members(spark, sf_dir):
    rows = bindings.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("assembly_id"), F.col("l_partkey").alias("member_id"), F.col("l_linenumber").alias("ord"))
    return extract.distinct_members(rows)


def bolt_quantity(spark, sf_dir):
    one = lambda pset, po, prop, i, v: F.struct(F.lit(pset).alias("pset"), F.lit(po).alias("pset_ord"), F.lit(prop).alias("prop"), F.lit(i).alias("prop_ord"), v.cast("string").alias("value"))
    k = F.col("p_partkey")
    rows = F.array(one("Tekla Bolt", 0, "Bolt Length Number", 0, F.lit(99)), one("Tekla Bolt", 0, "Qty", 1, F.when(k % 2 == 0, k % 9)), one("Tekla Quantity", 1, "Net Count", 0, F.when(k % 3 == 0, k % 7 + 1)), one("Misc", 2, "bolt pieces", 0, F.when(k % 5 == 0, F.lit("2,5"))))
    props = bindings.table(spark, sf_dir, "part").select(F.lit(1).alias("model_id"), k.alias("element_id"), F.explode(rows).alias("r")).select("model_id", "element_id", "r.*")
    return extract.bolt_quantity(props).select("element_id", "quantity")


def number_texts(spark, sf_dir):
    c = bindings.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("v"))
    return c.select("c_custkey", extract.elevation_text(F.col("v")).alias("elevation"), extract.quantity_text(F.col("c_custkey") / 4).alias("quantity"))


def pick_context(spark, sf_dir):
    rel = bindings.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("parent_id"), F.concat(F.lit("o"), "o_orderkey").alias("child_id"))
    picks = bindings.table(spark, sf_dir, "customer").where("c_custkey % 25 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("element_id"))
    return extract.pick_context(picks, rel)


def support_graph(spark, sf_dir):
    s = bindings.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    node = lambda i, kind, h, r, c: F.struct(F.lit(i).alias("node_id"), F.lit(kind).alias("kind"), F.lit(h).cast("double").alias("height"), F.lit(r).alias("row"), F.lit(c).alias("col"))
    nodes = s.select(k.alias("model_id"), (4000.0 + k % 4 * 500).alias("span_x"), F.lit(5000.0).alias("span_y"), F.explode(F.array(node("c1", "column", 3000, 0, 0), node("c2", "column", 3000, 0, 1), node("c3", "column", 4000, 1, 0), node("b1", "beam", None, None, None), node("b2", "beam", None, None, None), node("b3", "beam", None, None, None))).alias("n")).select("model_id", "span_x", "span_y", "n.*")
    sup = lambda b, t, o: F.struct(F.lit(b).alias("beam_id"), F.lit(t).alias("support_id"), F.lit(o).alias("ord"))
    supports = s.select(k.alias("model_id"), F.explode(F.array(sup("b1", "c1", 0), sup("b1", "c2", 1), sup("b2", "b1", 0), sup("b2", "c3", 1), sup("b3", "nowhere", 0), sup("b3", "c1", 1))).alias("s")).select("model_id", "s.*")
    return layout.place_supports(nodes, supports)


def completeness(spark, sf_dir):
    p = bindings.table(spark, sf_dir, "part")
    methods = F.array(*map(F.lit, ("vector_pdf", "vision_llm", "text_llm")))
    rows = p.select("p_partkey", F.element_at(methods, (F.col("p_partkey") % 3 + 1).cast("int")).alias("method"), (F.col("p_size") - 1).alias("n_members"), (F.col("p_partkey") % 4).alias("n_slabs"), (F.col("p_partkey") % 200).alias("drawing_ops"), F.col("p_size").alias("text_chars"), (F.col("p_retailprice") * 20).alias("span_mm"))
    return layout.completeness(rows).select("p_partkey", "complete", "reason")


def portal_rows(spark, sf_dir):
    rows = bindings.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), (F.col("p_size") * 1000.0).alias("span_mm"), F.lit(3500.0).alias("height_mm"), (F.col("p_partkey") % 5 + 1).cast("int").alias("n_columns"))
    rows = layout.portal_rows(rows)
    return rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_members"), F.round(F.sum("sx"), 3).alias("sum_x"))


def merged_lines(spark, sf_dir):
    rows = bindings.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_extendedprice").cast("double").alias("line"))
    out = layout.merged_lines(rows, ["page"], 10.0)
    return out.groupBy("page").agg(F.count(F.lit(1)).alias("n_lines"))


QUERIES = {
    "scan_order": (scan_order, f"""WITH e AS (SELECT p_size AS model_id, p_partkey // 2 AS express_id, {_KIND} AS t, p_partkey AS seq FROM part),
        r AS (SELECT *, CASE t WHEN 'IfcBeam' THEN 0 WHEN 'IfcColumn' THEN 1 WHEN 'IfcPlate' THEN 3 ELSE 5 END AS k FROM e), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY model_id, express_id ORDER BY k, seq) = 1)
        SELECT model_id, express_id, t AS ifc_type, row_number() OVER (PARTITION BY model_id ORDER BY k, seq, express_id)::INT AS place FROM f"""),
    "part_index": (part_index, "SELECT l_partkey AS element_id, min(l_orderkey * 10 + l_linenumber + l_suppkey / 1000.0::DOUBLE) AS place FROM lineitem GROUP BY 1"),
    "distinct_members": (distinct_members, "SELECT l_orderkey AS assembly_id, l_partkey AS member_id, min(l_linenumber) AS ord FROM lineitem GROUP BY 1, 2"),
    "bolt_quantity": (bolt_quantity, "SELECT p_partkey AS element_id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 9 > 0 THEN p_partkey % 9 WHEN p_partkey % 3 = 0 THEN p_partkey % 7 + 1 ELSE 99 END::DOUBLE AS quantity FROM part"),
    "number_texts": (number_texts, """SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN '+0.00' ELSE CASE WHEN c_acctbal > 0 THEN '+' ELSE '-' END || format('{:,.2f}', abs(c_acctbal)) END AS elevation,
        CASE c_custkey % 4 WHEN 0 THEN format('{:,}', c_custkey // 4) WHEN 2 THEN format('{:,.1f}', c_custkey / 4) ELSE format('{:,.2f}', c_custkey / 4) END AS quantity FROM customer"""),
    "pick_context": (pick_context, "SELECT 'c' || c_custkey AS element_id FROM customer WHERE c_custkey % 25 = 0 UNION SELECT 'o' || o_orderkey FROM orders WHERE o_custkey % 25 = 0"),
    "support_graph": (support_graph, """WITH s AS (SELECT s_suppkey AS m, 4000.0::DOUBLE + s_suppkey % 4 * 500 AS w FROM supplier)
        SELECT m AS model_id, unnest(['c1', 'c2', 'c3', 'b1', 'b2']) AS node_id, unnest(['column', 'column', 'column', 'beam', 'beam']) AS kind, unnest([0, w, 0, 0, w]) AS sx, unnest([0.0::DOUBLE, 0, 5000, 0, 0]) AS sy, unnest([0.0::DOUBLE, 0, 0, 3000, 3000]) AS sz,
          unnest([0, w, 0, w, 0]) AS ex, unnest([0.0::DOUBLE, 0, 5000, 0, 5000]) AS ey, unnest([3000.0::DOUBLE, 3000, 4000, 3000, 4000]) AS ez FROM s"""),
    "completeness": (completeness, """WITH r AS (SELECT p_partkey, p_partkey % 3 AS m, p_size - 1 AS n, p_partkey % 4 AS sl, p_partkey % 200 AS ops, p_size AS c, p_retailprice * 20 AS sp FROM part),
        q AS (SELECT p_partkey, CASE WHEN m = 0 THEN CASE WHEN n < 20 THEN 'few vector segments' END WHEN m = 1 AND ops > 80 AND n < 5 THEN 'vision found few members' WHEN m = 1 AND ops > 80 AND n < 12 THEN NULL WHEN ops > 80 AND n < 12 THEN 'few members on a dense sheet'
          WHEN n <= 4 AND sl <= 1 AND sp > 20000 THEN 'a single simplified box' WHEN c < 100 AND n < 10 AND m = 2 THEN 'text only' END AS reason FROM r) SELECT p_partkey, reason IS NULL AS complete, reason FROM q"""),
    "portal_rows": (portal_rows, "SELECT p_partkey AS model_id, p_partkey % 5 + 2 AS n_members, round(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size * 1000.0::DOUBLE * (p_partkey % 5 + 1) / 2 END, 3)::DOUBLE AS sum_x FROM part"),
    "merged_lines": (merged_lines, """
        WITH RECURSIVE l AS (SELECT l_suppkey AS page, l_extendedprice::DOUBLE AS v FROM lineitem),
        b AS (SELECT page, v, coalesce(v - lag(v) OVER (PARTITION BY page ORDER BY v) > 10, true)::INT AS new FROM l),
        c AS (SELECT page, v, sum(new) OVER (PARTITION BY page ORDER BY v ROWS UNBOUNDED PRECEDING) AS k FROM b),
        m AS (SELECT page, k, avg(v) AS line FROM c GROUP BY 1, 2),
        g AS (SELECT page, line - lag(line) OVER (PARTITION BY page ORDER BY line) AS gap FROM m),
        s AS (SELECT page, count(*) AS n, coalesce(list_sort(list(gap) FILTER (WHERE gap IS NOT NULL))[(count(gap) // 2) + 1], 0) * 0.35 AS least FROM g GROUP BY 1),
        f AS (SELECT page, min(line) AS last, 1 AS i FROM m JOIN s USING (page) WHERE n > 48 GROUP BY 1 UNION ALL
          SELECT f.page, min(m.line), min(i) + 1 FROM f JOIN s USING (page) JOIN m ON m.page = f.page AND m.line - f.last > least WHERE i < 48 GROUP BY f.page)
        SELECT page, CASE WHEN n > 48 THEN (SELECT count(*) FROM f WHERE f.page = s.page) ELSE n END::BIGINT AS n_lines FROM s"""),
}
