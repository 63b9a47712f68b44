"""Connected components over edge tables, lookups that survive hot keys, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def durable(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back: lineage ends, and executors may be lost.

    The folder is the one that spark.checkpoint.dir names; only in local mode is a temporary one made.
    """
    return _stored(df, label)[0]


def _stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir"):
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt to all shuffle partitions: for tables of few bytes, and so of few tasks, with much work a row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows a task sorts at once in jobs whose partitions grow in number with their input.
SHARE = 250_000


def shares(df: DataFrame) -> int:
    """Partitions that give each a SHARE of the rows of df, which are counted; at least Spark's own number of them."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SHARE))


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row a key, whose column weight says how many rows have the key.

    total is at least the number of rows. Keys with more than a partition's share of them are fewer than there are
    partitions: this bounded part of the table, where there is one, is broadcast, and only the rows of all other keys
    are shuffled. The table should be durable, as it is read first. The column weight is not in the result.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = F.col(weight) * parts > F.lit(total)
    hot, cold = table.where(crowded), table.where(~crowded)
    if hot.isEmpty():
        return rows.join(table.drop(weight), key)
    here = rows.join(F.broadcast(hot.drop(weight)), key)
    there = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.drop(weight), key)
    return here.unionByName(there)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Each round points every node at the smallest node in its neighbourhood, first among all neighbours, then among
    the smaller ones only (alternating stars). The rounds need shuffles in the order of the logarithm of the longest
    path; hubs are reduced by map-side minima and looked up by broadcast, and the only state between rounds is a
    table in the shared folder, of which the last one stays.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    star, path = _stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    # a fixpoint has the same edges: compare their number and a sum of their hashes
    state = lambda s: tuple(s.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(star)
    for _ in range(max_rounds):
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, low_path = _stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("n")), "components")
        large = lookup(both.where("b > a"), low, "a", "n", 2 * before[0]).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large, large_path = _stored(large.where("a <> b").distinct(), "components")
        least, least_path = _stored(large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")), "components")
        small = lookup(large, least, "a", "n", before[0]).select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low"))).alias("e"))
        old = [path, low_path, large_path, least_path]
        star, path = _stored(small.select("e.a", F.col("e.low").alias("b")).where("a <> b").distinct(), "components")
        now = state(star)
        for gone in old:
            _removed(spark, gone)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(star.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
