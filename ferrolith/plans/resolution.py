"""Property, hierarchy, link and visibility queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import resolve, rollup
from ferrolith.sources import bindings

#: Field, rank, set, key and mode of the part projection.
RULES = [("profile", 0, "main", "type", "exact"), ("profile", 1, "%", "name", "contains"), ("mark", 0, "main", "name", "exact"), ("mark", 1, "main", "brand", "exact"), ("weight", 0, "%", "price", "contains"), ("weight", 1, "%", "size", "contains")]


def props(spark, sf_dir):
    """Part columns as properties: the type layer has all, the instance layer those of every third part."""
    part = bindings.table(spark, sf_dir, "part")
    one = lambda layer, pset, o, prop, i, v: F.struct(F.lit(layer).alias("layer"), F.lit(pset).alias("pset"), F.lit(o).alias("pset_ord"), F.lit(prop).alias("prop"), F.lit(i).alias("prop_ord"), v.cast("string").alias("value"))
    price = F.format_string("%.1f", F.col("p_retailprice"))
    rows = [
        one("type", "Main", 0, "Type", 0, F.when(F.col("p_partkey") % 5 > 0, F.col("p_type"))), one("type", "Main", 0, "Name", 1, F.col("p_name")), one("type", "Main", 0, "Brand", 2, F.col("p_brand")),
        one("type", "Extra", 1, "Retail Price", 0, F.concat(F.lit("+"), price)), one("instance", "Main", 0, "Name", 1, F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name"))), one("inherited", "Extra", 1, "Size", 1, F.col("p_size")),
    ]
    return part.select(F.lit("m").alias("model_id"), F.col("p_partkey").alias("element_id"), F.explode(F.array(*rows)).alias("r")).select("model_id", "element_id", "r.*").where("value IS NOT NULL")


def layered_props(spark, sf_dir):
    return resolve.layered(props(spark, sf_dir)).select("element_id", "pset", "prop", "value", "layer")


def part_projection(spark, sf_dir):
    rows = resolve.resolve(resolve.layered(props(spark, sf_dir)), RULES)
    return rows.select("element_id", "mark", "profile", "weight")


def fuzzy_pick(spark, sf_dir):
    rules = [("number", 0, "%", "e", "contains")]
    return resolve.resolve(resolve.layered(props(spark, sf_dir)), rules, resolve.to_number).select("element_id", "number")


def longest_fragment(spark, sf_dir):
    return resolve.longest_fragment(resolve.layered(props(spark, sf_dir)), ["name", "type", "retail", "price", "retail price"]).select("element_id", "value", "size")


def unit_conversion(spark, sf_dir):
    nation = bindings.table(spark, sf_dir, "nation")
    units = nation.select(F.col("n_nationkey").alias("model_id"), F.lit("LENGTHUNIT").alias("unit_type"), F.when(F.col("n_nationkey") % 3 == 0, "MILLI").when(F.col("n_nationkey") % 3 == 1, "CENTI").alias("prefix"), F.when(F.col("n_nationkey") % 7 == 0, 0.3048).alias("conversion"), F.col("n_nationkey").alias("ord"))
    c = bindings.table(spark, sf_dir, "customer").join(resolve.unit_factors(units), F.col("c_nationkey") == F.col("model_id"))
    return c.select("c_custkey", F.round(resolve.elevation_mm(F.col("c_acctbal").cast("double"), F.col("to_mm")), 3).alias("mm"), F.round("to_kg", 3).alias("to_kg"))


def profile_cascade(spark, sf_dir):
    part = bindings.table(spark, sf_dir, "part")
    ranks = F.array(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 3 == 0, F.lit("unnamed")), F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")), F.col("p_type"))
    rows = part.select("p_partkey", F.posexplode(ranks).alias("rank", "value"))
    return resolve.ranked(rows, ["p_partkey"], resolve.profile_candidate)


def mark_cascade(spark, sf_dir):
    part = bindings.table(spark, sf_dir, "part")
    ranks = F.array(F.when(F.col("p_partkey") % 2 == 0, F.md5(F.col("p_partkey").cast("string"))), F.when(F.col("p_partkey") % 3 == 0, F.lit(" Beam ")), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")), F.concat(F.lit("#"), "p_partkey"))
    rows = part.select("p_partkey", F.posexplode(ranks).alias("rank", "value"))
    return resolve.ranked(rows, ["p_partkey"], resolve.mark_candidate)


def param_flatten(spark, sf_dir):
    e = bindings.table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int") % 10).alias("key"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("ord"))
    return resolve.flattened_parameters(e, ["user_id"]).select("user_id", F.explode("parameters").alias("key", "value")).withColumn("value", F.col("value").cast("double"))


def _tree(spark, sf_dir):
    t = lambda n: bindings.table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        t("nation").select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"))
        .union(t("customer").select(key("n", "c_nationkey"), key("c", "c_custkey"))).union(t("orders").select(key("c", "o_custkey"), key("o", "o_orderkey")))
    )


def leaf_products(spark, sf_dir):
    seeds = bindings.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    rows = resolve.leaf_products(_tree(spark, sf_dir), seeds)
    return rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n_leaves"), F.min("node").alias("first_leaf"))


def ancestor_pick(spark, sf_dir):
    orders = bindings.table(spark, sf_dir, "orders")
    seeds = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    own = bindings.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.col("o_totalprice").cast("double").alias("value"), F.lit(0).alias("rank"))
    cust = bindings.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_acctbal").cast("double").alias("value"), F.lit(0).alias("rank"))
    nation = bindings.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_nationkey").cast("double").alias("value"), F.lit(0).alias("rank"))
    return resolve.ancestor_pick(_tree(spark, sf_dir), own.union(cust).union(nation), seeds)


def _ends(spark, sf_dir):
    line = bindings.table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_linenumber") % 2 == 0, "relating").otherwise("related")
    return line.select(F.col("l_orderkey").alias("rel_id"), role.alias("role"), F.concat(F.lit("element-"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("element_id"), (F.col("l_partkey") % 4 == 0).alias("is_fastener")).distinct()


def link_pairs(spark, sf_dir):
    return resolve.link_pairs(_ends(spark, sf_dir))


def multiway_pairs(spark, sf_dir):
    return resolve.multiway_pairs(_ends(spark, sf_dir))


def connection_bolts(spark, sf_dir):
    part = bindings.table(spark, sf_dir, "part").where(F.col("p_name").contains("bolt") | F.col("p_name").contains("ring"))
    name = F.concat(F.regexp_replace("p_name", "ring", "hole ring"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" M20*"), F.col("p_partkey") % 40 + 10)).otherwise(""))
    rows = part.select("p_partkey", name.alias("name"), F.col("p_size").cast("double").alias("size"))
    return rows.select("p_partkey", "name", resolve.catalog_length(F.col("name")).alias("listed"), resolve.connection_bolt(F.col("name"), F.col("size"), F.lit(False)).alias("connects"))


def fastener_classes(spark, sf_dir):
    part = bindings.table(spark, sf_dir, "part")
    kind = F.when(F.col("p_name").contains("bolt"), "IfcMechanicalFastener").when(F.col("p_name").contains("plate"), "IfcDiscreteAccessory").when(F.col("p_name").contains("ring"), "IfcFastenerGrid").otherwise("IfcBeam")
    text = F.concat_ws(" ", F.when(F.col("p_size") > 45, "hole"), F.when(F.col("p_name").contains("plate") & (F.col("p_size") > 20), "end plate"), "p_name")
    return part.select("p_partkey", kind.alias("kind"), resolve.fastener_class(kind, text, strict=True).alias("class"), resolve.companion(kind).alias("companion"))


def fasteners_to_hide(spark, sf_dir):
    part = bindings.table(spark, sf_dir, "part")
    kind = F.when(F.col("p_name").contains("bolt"), "IfcMechanicalFastener").when(F.col("p_name").contains("plate") | (F.col("p_partkey") % 3 == 0), "IfcDiscreteAccessory").otherwise("IfcBeam")
    text = F.when(F.col("p_size") > 45, "hole").when(F.col("p_size") > 20, F.rpad(F.lit("end plate "), 30, "-")).otherwise("")
    elements = part.select(F.col("p_partkey").alias("element_id"), kind.alias("kind"), text.alias("text"))
    words = F.element_at(F.array(*map(F.lit, ("hex bolt M20", "a bore", "clearance hole", "washer", "something", "hex bolt, bore"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    attributes = part.where("p_partkey % 11 > 0").select(F.col("p_partkey").alias("element_id"), words.alias("text"))
    modes = [resolve.fasteners_to_hide(elements, attributes, strict).withColumn("strict", F.lit(strict)) for strict in (False, True)]
    return modes[0].unionByName(modes[1])


def _picks(spark):
    return spark.createDataFrame([("assembly", "m:1-urgent"), ("part", "7"), ("part", "11"), ("profile", "economy")], "kind string, key string")


def _hidden(spark, sf_dir):
    asm = bindings.assemblies(spark, sf_dir).withColumn("name", F.lit(None).cast("string")).select("assembly_id", rollup.assembly_group_key().alias("group_key"))
    parts = bindings.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("identity"), F.lower("p_type").alias("profile_key"))
    return resolve.hidden_elements(asm, bindings.members(spark, sf_dir), parts, _picks(spark))


def hidden_set(spark, sf_dir):
    return _hidden(spark, sf_dir)


def visible_set(spark, sf_dir):
    part = bindings.table(spark, sf_dir, "part")
    voids = part.select(F.col("p_partkey").alias("host_id"), (F.col("p_partkey") + 1).alias("part_id")).where("host_id % 3 = 0")
    return resolve.visible(part.select(F.col("p_partkey").alias("part_id")), resolve.with_openings(_hidden(spark, sf_dir), voids))


_PROPS = """props AS (
  SELECT p_partkey AS element_id, unnest([
    {'layer': 1, 'pset': 'Main', 'po': 0, 'prop': 'Type', 'i': 0, 'v': CASE WHEN p_partkey % 5 > 0 THEN p_type END},
    {'layer': 1, 'pset': 'Main', 'po': 0, 'prop': 'Name', 'i': 1, 'v': p_name}, {'layer': 1, 'pset': 'Main', 'po': 0, 'prop': 'Brand', 'i': 2, 'v': p_brand},
    {'layer': 1, 'pset': 'Extra', 'po': 1, 'prop': 'Retail Price', 'i': 0, 'v': '+' || printf('%.1f', p_retailprice)},
    {'layer': 0, 'pset': 'Main', 'po': 0, 'prop': 'Name', 'i': 1, 'v': CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) END},
    {'layer': 2, 'pset': 'Extra', 'po': 1, 'prop': 'Size', 'i': 1, 'v': p_size::VARCHAR}], recursive := true) FROM part),
eff AS (SELECT * FROM props WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY element_id, pset, prop ORDER BY layer) = 1)"""
_HIDDEN = f"""hidden AS (
  SELECT DISTINCT l_partkey AS part_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE lower(o_orderpriority) = '1-urgent'
  UNION SELECT p_partkey FROM part WHERE p_partkey IN (7, 11) OR lower(p_type) = 'economy')"""
_ENDS = "ends AS (SELECT DISTINCT l_orderkey AS r, l_linenumber % 2 = 0 AS relating, 'element-' || lpad(l_partkey::VARCHAR, 8, '0') AS e, l_partkey % 4 = 0 AS f FROM lineitem)"

QUERIES = {
    "layered_props": (layered_props, f"WITH {_PROPS} SELECT element_id, pset, prop, v AS value, ['instance', 'type', 'inherited'][layer + 1] AS layer FROM eff"),
    "part_projection": (part_projection, f"""
        WITH {_PROPS} SELECT element_id, coalesce(max(v) FILTER (WHERE prop = 'Name'), max(v) FILTER (WHERE prop = 'Brand')) AS mark,
          coalesce(max(v) FILTER (WHERE prop = 'Type'), max(v) FILTER (WHERE prop = 'Name')) AS profile, coalesce(max(v) FILTER (WHERE prop = 'Retail Price'), max(v) FILTER (WHERE prop = 'Size')) AS weight FROM eff GROUP BY 1"""),
    "fuzzy_pick": (fuzzy_pick, "SELECT p_partkey AS element_id, printf('%.1f', p_retailprice)::DOUBLE AS number FROM part"),
    "longest_fragment": (longest_fragment, "SELECT p_partkey AS element_id, '+' || printf('%.1f', p_retailprice) AS value, 12 AS size FROM part"),
    "unit_conversion": (unit_conversion, """
        WITH f AS (SELECT n_nationkey AS k, 1000 * CASE WHEN n_nationkey % 7 = 0 THEN 0.3048 WHEN n_nationkey % 3 = 0 THEN 0.001 WHEN n_nationkey % 3 = 1 THEN 0.01 ELSE 1 END::DOUBLE AS f FROM nation)
        SELECT c_custkey, round(CASE WHEN abs(c_acctbal) >= 1000 THEN c_acctbal ELSE c_acctbal * f END, 3)::DOUBLE AS mm, 1.0::DOUBLE AS to_kg FROM customer JOIN f ON c_nationkey = k"""),
    "profile_cascade": (profile_cascade, "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_type END AS value, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 3 END AS rank FROM part"),
    "mark_cascade": (mark_cascade, "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE '#' || p_partkey END AS value, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 3 END AS rank FROM part"),
    "param_flatten": (param_flatten, "SELECT user_id, 'k' || ((props->>'k')::INT % 10) AS key, max_by(value, event_id) AS value FROM events GROUP BY 1, 2"),
    "leaf_products": (leaf_products, """
        WITH RECURSIVE t AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
        w AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node FROM region UNION SELECT seed, c FROM w JOIN t ON node = p)
        SELECT seed, count(*) AS n_leaves, min(node) AS first_leaf FROM w WHERE node NOT IN (SELECT p FROM t) AND node <> seed GROUP BY 1"""),
    "ancestor_pick": (ancestor_pick, """
        SELECT 'o' || o_orderkey AS seed, CASE WHEN o_orderstatus = 'P' THEN o_totalprice WHEN c_acctbal > 0 THEN c_acctbal ELSE c_nationkey END::DOUBLE AS value,
          CASE WHEN o_orderstatus = 'P' THEN 0 WHEN c_acctbal > 0 THEN 1 ELSE 2 END AS depth FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "link_pairs": (link_pairs, f"WITH {_ENDS} SELECT DISTINCT a.e AS bolt_id, b.e AS part_id FROM ends a JOIN ends b ON a.r = b.r AND a.relating <> b.relating AND a.f AND NOT b.f"),
    "multiway_pairs": (multiway_pairs, f"WITH {_ENDS} SELECT DISTINCT a.e AS bolt_id, b.e AS part_id FROM ends a JOIN ends b ON a.r = b.r AND a.f AND NOT b.f"),
    "connection_bolts": (connection_bolts, """
        WITH n AS (SELECT p_partkey, replace(p_name, 'ring', 'hole ring') || CASE WHEN p_partkey % 2 = 0 THEN ' M20*' || (p_partkey % 40 + 10) ELSE '' END AS name, p_size::DOUBLE AS s,
          CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 40 + 10 END::DOUBLE AS listed FROM part WHERE p_name LIKE '%bolt%' OR p_name LIKE '%ring%')
        SELECT p_partkey, name, listed, name NOT LIKE '%hole%' AND coalesce(abs(s - listed) <= greatest(2, 0.02 * listed), true) AND s >= 3 AS connects FROM n"""),
    "fastener_classes": (fastener_classes, """
        WITH k AS (SELECT *, CASE WHEN p_name LIKE '%bolt%' THEN 'IfcMechanicalFastener' WHEN p_name LIKE '%plate%' THEN 'IfcDiscreteAccessory' WHEN p_name LIKE '%ring%' THEN 'IfcFastenerGrid' ELSE 'IfcBeam' END AS kind FROM part)
        SELECT p_partkey, kind, CASE WHEN kind = 'IfcBeam' THEN 'other' WHEN p_size > 45 THEN 'hole' WHEN p_name LIKE '%plate%' AND p_size > 20 THEN 'connection' ELSE 'fastener' END AS class,
          kind NOT IN ('IfcBeam', 'IfcFastenerGrid') AS companion FROM k"""),
    "fasteners_to_hide": (fasteners_to_hide, """
        WITH k AS (SELECT p_partkey AS element_id, p_size AS s, p_partkey % 6 AS w, p_partkey % 11 > 0 AS known, CASE WHEN p_name LIKE '%bolt%' THEN 'bolt' WHEN p_name LIKE '%plate%' OR p_partkey % 3 = 0 THEN 'loose' ELSE 'beam' END AS kind FROM part)
        SELECT element_id, false AS strict FROM k WHERE kind <> 'beam' AND s <= 45 AND (kind = 'bolt' OR s > 20 OR NOT known OR w NOT IN (1, 2))
        UNION ALL SELECT element_id, true FROM k WHERE kind <> 'beam' AND s <= 45 AND (kind = 'bolt' AND s <= 20 OR kind = 'loose' AND s <= 20 AND known AND w IN (0, 3))"""),
    "hidden_set": (hidden_set, f"WITH {_HIDDEN} SELECT part_id FROM hidden"),
    "visible_set": (visible_set, f"WITH {_HIDDEN} SELECT p_partkey AS part_id FROM part WHERE p_partkey NOT IN (SELECT part_id FROM hidden) AND NOT ((p_partkey - 1) % 3 = 0 AND p_partkey - 1 IN (SELECT part_id FROM hidden))"),
}
