"""Structured Streaming jobs: toggle state, ingest of element rows. Their batch forms give the same tables."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.operators.graph import shared_folder


#: The store for keyed state of several values.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the Parquet files of one table in a folder."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_base(spark: SparkSession, label: str) -> str:
    """A folder of the shared one for the table and the checkpoint of a stream."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str, label: str, base: str | None = None) -> DataFrame:
    """Runs a stream over all that is available; complete results replace each other, new rows are appended.

    With the base of an earlier run it goes on from that run's checkpoint.
    """
    spark = stream.sparkSession
    base = base or new_base(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes its own folder again
        batch.write.mode("overwrite").parquet(f"{base}/table" if mode == "complete" else f"{base}/table/batch={number}")

    # a query keeps the setting that it was started with
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, old)
    schema = stream.schema
    return spark.read.schema(schema).parquet(f"{base}/table").select(*schema.names)


def toggle_parity(events: DataFrame, by: list[str]) -> DataFrame:
    """A key is hidden when it was toggled an odd number of times since the last reset (action 'reset' of by[0])."""
    reset = events.where("action = 'reset'").groupBy(by[0]).agg(F.max("seq").alias("reset_seq"))
    rows = events.where("action <> 'reset'").join(reset, by[0], "left").where("reset_seq IS NULL OR seq > reset_seq")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_toggles")).withColumn("hidden", F.col("n_toggles") % 2 == 1)


def stream_parity(events: DataFrame, by: list[str]) -> DataFrame:
    """Toggle state of a stream without resets: a running count and its parity."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_toggles")).withColumn("hidden", F.col("n_toggles") % 2 == 1)


def selection_state(events: DataFrame, by: str) -> DataFrame:
    """Batch fold of selections: each event toggles a set of ids; ids that are all selected leave, else all join."""
    ordered = events.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("seq", "ids"))).alias("events"))
    step = lambda acc, e: F.when(F.size(F.array_except(e["ids"], acc)) == 0, F.array_except(acc, e["ids"])).otherwise(F.array_union(acc, e["ids"]))
    return ordered.select(by, F.array_sort(F.aggregate("events", F.array().cast("array<long>"), step)).alias("selected"))


def group_toggle(group: DataFrame, by: str) -> DataFrame:
    """A group whose members are all on goes off, any other goes on; groups without a tab stay."""
    return group.groupBy(by).agg(F.bool_and("on").alias("all_on"), F.bool_or("has_tab").alias("active")).withColumn("on", F.when(F.col("active"), ~F.col("all_on")))


def deduplicated_ingest(rows: DataFrame, id_col: str, time_col: str, delay: str = "1 hour") -> DataFrame:
    """Rows of a stream, each id once within the delay; later repeats are dropped with their watermark."""
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def upserted(rows: DataFrame, key: str, order: str, base: str, buckets: int = 16) -> DataFrame:
    """Merges a stream into a table of one row a key, that with the latest order; runs over what is available.

    The table lies in buckets by a hash of the key. A batch rewrites the buckets that it touches under a new version
    and then puts a new manifest (bucket, version) beside the old ones; readers go by the newest whole manifest, so a
    batch that fails halfway changes nothing. A batch that is run again writes the same rows: what it brings is not
    later than what the table holds. Of two rows with equal order the one with the greater values stays.
    """
    spark = rows.sparkSession
    columns = rows.columns
    placed = rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    value = F.struct(F.col(order).alias("__order"), *(F.col(c) for c in columns))

    def merge(batch: DataFrame, number: int) -> None:
        old = manifest(spark, base, before=number)
        batch = batch.persist()
        touched = [r["__bucket"] for r in batch.select("__bucket").distinct().collect()]  # at most `buckets` numbers
        now = batch.select("__bucket", *columns)
        held = [path for bucket, path in old.items() if bucket in touched]
        if held:
            now = now.unionByName(spark.read.parquet(*held).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).select("__bucket", *columns))
        last = now.groupBy("__bucket", key).agg(F.max(value).alias("v")).select("__bucket", *(F.col(f"v.{c}").alias(c) for c in columns))
        for_bucket = f"{base}/data/version={number}"
        last.withColumn("bucket", F.col("__bucket")).drop("__bucket").write.mode("overwrite").partitionBy("bucket").parquet(for_bucket)
        new = old | {b: f"{for_bucket}/bucket={b}" for b in touched}
        spark.createDataFrame(sorted(new.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/batch={number}")
        batch.unpersist()

    placed.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    paths = list(manifest(spark, base).values())
    empty = spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(*paths).select(*columns) if paths else empty


def manifest(spark: SparkSession, base: str, before: int | None = None) -> dict[int, str]:
    """Bucket to folder, by the newest whole manifest of a table of `upserted`; of a batch's number or less than it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/manifest/batch=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    numbers = [int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found]
    numbers = [n for n in numbers if before is None or n < before]
    if not numbers:
        return {}
    return {r["bucket"]: r["path"] for r in spark.read.parquet(f"{base}/manifest/batch={max(numbers)}").collect()}
