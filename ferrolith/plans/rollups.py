"""Rollup queries over the order tables read as parts, bolts and assemblies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import rollup
from ferrolith.sources import bindings

_PARTS = """
  SELECT l_orderkey AS assembly_id, l_partkey AS part_id, p_name AS mark, p_type AS profile, p_brand AS material,
         l_quantity::DOUBLE AS quantity, l_extendedprice::DOUBLE AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
_MEMBERS = "SELECT DISTINCT l_orderkey AS assembly_id, l_partkey AS part_id FROM lineitem"
_KEY = "'m:' || lower(trim(o_orderpriority))"
_IDENTITY = "concat_ws('|', trim(mark), lower(trim(profile)), '', printf('%.4f', weight))"


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 2) for c in columns})


def profile_rollup(spark, sf_dir):
    return _rounded(rollup.profile_rollup(bindings.parts(spark, sf_dir)), "weight").orderBy(rollup.natural_key("profile"), "profile_key")


def assembly_rollup(spark, sf_dir):
    rows = rollup.assembly_rollup(bindings.assemblies(spark, sf_dir)).withColumn("n_instances", F.col("quantity").cast("int"))
    return _rounded(rows, "weight")


def occurrence_count(spark, sf_dir):
    return rollup.occurrence_counts(bindings.assemblies(spark, sf_dir)).select("assembly_id", "group_key", "occurrences")


def preferred_assembly(spark, sf_dir):
    parts, members = bindings.parts(spark, sf_dir), bindings.members(spark, sf_dir)
    counts = parts.select("assembly_id", "part_id", F.col("mark").contains("bolt").alias("bolt")).distinct().groupBy("assembly_id").agg(
        F.sum(F.when(F.col("bolt"), 0).otherwise(1)).alias("n_parts"), F.sum(F.when(F.col("bolt"), 1).otherwise(0)).alias("n_bolts")
    )
    asm = bindings.assemblies(spark, sf_dir).join(counts, "assembly_id")
    return rollup.preferred_assembly(members.join(asm, "assembly_id"))


def part_identity_rollup(spark, sf_dir):
    return _rounded(rollup.part_identity_rollup(bindings.parts(spark, sf_dir)), "weight")


def assembly_part_rows(spark, sf_dir):
    rows = rollup.part_identity_rollup(bindings.parts(spark, sf_dir), "assembly_id")
    return _rounded(rows.select("assembly_id", "identity", "mark", "n_rows", "quantity", "weight"), "weight")


def identity_count(spark, sf_dir):
    rows = rollup.identity_counts(bindings.parts(spark, sf_dir))
    return rows.select("assembly_id", "part_id", "identity", "identical")


def bolt_rollup(spark, sf_dir):
    return rollup.bolt_rollup(bindings.bolts(spark, sf_dir))


def assembly_part_expand(spark, sf_dir):
    sizes = bindings.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_size").cast("double").alias("quantity"))
    return rollup.assembly_part_expand(bindings.members(spark, sf_dir), sizes, bindings.assemblies(spark, sf_dir))


def unit_weight(spark, sf_dir):
    rows = rollup.part_identity_rollup(bindings.parts(spark, sf_dir))
    return rows.select("identity", F.round(rollup.unit_weight(F.col("weight"), F.col("quantity")), 8).alias("unit_weight"))


def selection_weight(spark, sf_dir):
    rows = bindings.parts(spark, sf_dir).withColumn("w", F.when(F.col("quantity") < 50, F.col("weight")))
    return rows.groupBy("assembly_id").agg(F.round(rollup.selection_weight(F.col("w")), 2).alias("selection_weight"), F.round(rollup.group_weight(F.col("w")), 2).alias("group_weight"))


def mark_rollup(spark, sf_dir):
    rows = rollup.mark_rollup(bindings.parts(spark, sf_dir))
    return _rounded(rows, "weight")


def natural_sort(spark, sf_dir):
    rows = bindings.table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace("c_name", "#0*", "").alias("label"))
    return rows.withColumn("sort_key", rollup.natural_key("label")).orderBy("sort_key", "c_custkey")


def substring_filter(spark, sf_dir):
    return _rounded(rollup.substring_filter(bindings.parts(spark, sf_dir), " BOLT", "mark", "profile", "material"), "weight")


QUERIES = {
    "profile_rollup": (profile_rollup, f"""
        WITH p AS ({_PARTS})
        SELECT lower(profile) AS profile_key, min(profile) AS profile, count(*) AS n_rows,
               sum(CASE WHEN quantity > 0 THEN floor(quantity + 0.5) ELSE 1 END)::BIGINT AS quantity, round(sum(weight), 2) AS weight
        FROM p GROUP BY 1"""),
    "assembly_rollup": (assembly_rollup, f"""
        SELECT {_KEY} AS group_key, min_by(trim(o_orderpriority), o_orderkey) AS label, count(*) AS quantity,
               round(sum(o_totalprice::DOUBLE), 2) AS weight, count(*)::INT AS n_instances FROM orders GROUP BY 1"""),
    "occurrence_count": (occurrence_count, f"SELECT o_orderkey AS assembly_id, {_KEY} AS group_key, count(*) OVER (PARTITION BY {_KEY}) AS occurrences FROM orders"),
    "preferred_assembly": (preferred_assembly, f"""
        WITH p AS (SELECT DISTINCT assembly_id, part_id, mark LIKE '%bolt%' AS bolt FROM ({_PARTS})),
        c AS (SELECT assembly_id, sum((NOT bolt)::INT) AS np, sum(bolt::INT) AS nb FROM p GROUP BY 1),
        s AS (SELECT m.part_id, m.assembly_id, (np * 100000 + nb * 50 + 5500)::BIGINT AS score
              FROM ({_MEMBERS}) m JOIN orders ON assembly_id = o_orderkey JOIN c ON c.assembly_id = m.assembly_id)
        SELECT part_id, assembly_id, score FROM s QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY score DESC, assembly_id) = 1"""),
    "part_identity_rollup": (part_identity_rollup, f"""
        WITH p AS ({_PARTS})
        SELECT {_IDENTITY} AS identity, min(trim(mark)) AS mark, min(profile) AS profile, count(*) AS n_rows,
          CASE WHEN count(*) > 1 THEN count(*) ELSE coalesce(floor(min(quantity) + 0.5), 1) END::BIGINT AS quantity, round(sum(weight), 2) AS weight
        FROM p GROUP BY 1"""),
    "assembly_part_rows": (assembly_part_rows, f"""
        WITH p AS ({_PARTS})
        SELECT assembly_id, {_IDENTITY} AS identity, min(trim(mark)) AS mark, count(*) AS n_rows,
          CASE WHEN count(*) > 1 THEN count(*) ELSE coalesce(floor(min(quantity) + 0.5), 1) END::BIGINT AS quantity, round(sum(weight), 2) AS weight
        FROM p GROUP BY 1, 2"""),
    "identity_count": (identity_count, f"""
        WITH p AS ({_PARTS}) SELECT assembly_id, part_id, {_IDENTITY} AS identity, count(*) OVER (PARTITION BY {_IDENTITY}) AS identical FROM p"""),
    "bolt_rollup": (bolt_rollup, f"""
        WITH p AS ({_PARTS})
        SELECT lower(trim(mark)) || '||' || lower(trim(material)) || '|' AS bolt_key, count(*) AS n_rows,
               sum(CASE WHEN quantity > 0 THEN quantity ELSE 1 END)::DOUBLE AS quantity FROM p WHERE mark LIKE '%bolt%' GROUP BY 1"""),
    "assembly_part_expand": (assembly_part_expand, f"""
        SELECT {_KEY} AS group_key, m.part_id, sum(coalesce(p_size::DOUBLE, 1)) AS quantity
        FROM ({_MEMBERS}) m JOIN orders ON m.assembly_id = o_orderkey JOIN part ON m.part_id = p_partkey GROUP BY 1, 2"""),
    "unit_weight": (unit_weight, f"""
        WITH p AS ({_PARTS}), r AS (
          SELECT {_IDENTITY} AS identity, CASE WHEN count(*) > 1 THEN count(*) ELSE coalesce(floor(min(quantity) + 0.5), 1) END AS q, sum(weight) AS w FROM p GROUP BY 1)
        SELECT identity, CASE WHEN q > 0 THEN round(w / q, 8) END AS unit_weight FROM r"""),
    "selection_weight": (selection_weight, f"""
        WITH p AS (SELECT *, CASE WHEN quantity < 50 THEN weight END AS w FROM ({_PARTS}))
        SELECT assembly_id, CASE WHEN count(*) = count(w) THEN round(sum(w), 2) END AS selection_weight, round(coalesce(sum(w), 0), 2) AS group_weight FROM p GROUP BY 1"""),
    "mark_rollup": (mark_rollup, f"""
        WITH p AS ({_PARTS})
        SELECT coalesce(nullif(mark, ''), '{rollup.UNMARKED}') AS mark, count(*) AS n_parts, round(sum(coalesce(weight, 0)), 2) AS weight, count(part_id)::INT AS n_ids FROM p GROUP BY 1"""),
    "natural_sort": (natural_sort, """
        WITH c AS (SELECT c_custkey, regexp_replace(c_name, '#0*', '') AS label FROM customer)
        SELECT c_custkey, label, regexp_extract(lower(label), '^([^0-9]*)', 1) || CASE WHEN regexp_matches(label, '[0-9]') THEN lpad(regexp_extract(label, '([0-9]+)$', 1), 20, '0') ELSE '' END AS sort_key FROM c"""),
    "substring_filter": (substring_filter, f"""
        SELECT * REPLACE (round(weight, 2) AS weight) FROM ({_PARTS}) WHERE contains(lower(mark), 'bolt') OR contains(lower(profile), 'bolt') OR contains(lower(material), 'bolt')"""),
}
