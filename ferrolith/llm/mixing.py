"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Carried, partitions, running, text_of, written

RESULT = ["size", "source_size", "target", "copies", "taken"]
#: No document and no source is taken more often than this.
MOST = 3
#: A source's offset is the best of this many, evenly apart from its hashed one on.
OFFSETS = 32


def size_class(size: Column) -> Column:
    """A class of nearby sizes: the number of binary digits and the three digits after the first."""
    digits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(digits * 8 + F.expr("shiftright(`__size`, length(bin(`__size`)) - 4) & 7"))


def targets(per_source: DataFrame, most: int = MOST) -> DataFrame:
    """(__source, source_size) -> target. Weights 1, 2, 3 repeat over the sources by code point, null last.

    A source's target is min(most * size, weight * level); the level at which all targets add up to all sizes comes
    from running sums over the sources in the order in which they reach their limit. The table has one row a source;
    only its sums and the level come to the driver.
    """
    name = F.col("__source").asc_nulls_last()
    full = (F.col("source_size") * most).cast("double")
    weighed = running(per_source, [name], {"__before": F.lit(1)})
    weighed = weighed.withColumn("__w", F.pmod("__before", F.lit(3)) + 1).drop("__before")
    weighed = running(weighed.withColumn("__at", full / F.col("__w")), [F.col("__at").asc(), name], {"__capped": F.col("source_size") * most, "__used": F.col("__w")})
    weighed = written(weighed, "mix-targets")
    size, weight = weighed.agg(F.sum("source_size"), F.sum("__w")).first()
    level = (F.lit(size) - F.col("__capped")).cast("double") / (F.lit(weight) - F.col("__used"))
    # the first source that the level of those from it on does not fill sets it; later ones give lower levels
    level = weighed.select(F.max(F.when(level <= F.col("__at"), level))).first()[0]
    return weighed.select("__source", "source_size", F.least(full, F.col("__w") * F.lit(level).cast("double")).alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Adds size, source_size, target, copies and taken to every row.

    Within a source the expected copies of its documents (target / source_size each) are added up in order of size;
    one offset is added, and a document is emitted once for each whole number that its stretch crosses. In order of
    size the words taken stay within about one document of the target. The offset starts at a hash of the source's name;
    of OFFSETS places evenly apart from there the one whose words come nearest to the target is taken, the first of
    equals. One aggregation over the ranked rows tells the words of all of them.

    The running sum is spread: documents are dealt to cells (source, size class, first byte of the id's MD5) and
    ranked within their cell, and only cell counts are added up, first over the cells of a class, then over the
    classes of a source. A source with a third of all rows is ranked by many tasks. Texts are
    read once: sizes are written beside the columns named in keep (all: None), and ranks are those of numbered sizes.

    Defined cases: a null text has size 0; the null source is one source and comes last; null ids are ranked last
    in their cell; a source of size 0 has target 0 and no copies; repeated rows are ranked one after the other; an
    empty table gives an empty result. Input columns named like a result column are replaced by it.
    """
    n = partitions(df.sparkSession)
    carried = Carried(df.select(*(df.columns if keep is None else keep)))
    docs = df.select(
        *carried.hide(df),
        F.col(id_col).alias("__id"),
        F.col(source_col).cast("string").alias("__source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("__size"),
    ).withColumn("__class", size_class(F.col("__size")).cast("int"))
    docs = docs.withColumn("__cell", F.coalesce(F.conv(F.substring(F.md5(F.col("__id").cast("string")), 1, 2), 16, 10).cast("int"), F.lit(0)))
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-sizes")
    keys = ["__source", "__class", "__cell"]
    docs = rows.select("__row", "__id", "__size", *keys)

    cells = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__s"))
    classes = cells.groupBy("__source", "__class").agg(F.sum("__n").alias("__n"), F.sum("__s").alias("__s"))
    per_source = classes.groupBy("__source").agg(F.sum("__s").alias("source_size"))
    class_at = Window.partitionBy("__source").orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    cell_at = Window.partitionBy("__source", "__class").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    starts = classes.select("__source", "__class", F.coalesce(F.sum("__n").over(class_at), F.lit(0)).alias("__from"))
    goals = targets(per_source)
    starts = starts.join(goals, same(starts, goals, ["__source"])).select(starts["*"], goals["source_size"], goals["target"])
    cells = cells.select(*keys, F.coalesce(F.sum("__n").over(cell_at), F.lit(0)).alias("__in"))
    name = F.concat(F.lit("mix:"), F.coalesce(F.col("__source"), F.lit("")))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    cells = cells.join(starts, same(cells, starts, keys[:2])).select(
        *(cells[k] for k in keys), (F.col("__in") + F.col("__from")).alias("__start"), "source_size", "target"
    )
    cells = written(cells.withColumn("__u", offset), "mix-cells")

    order = Window.partitionBy(*keys).orderBy("__size", F.col("__id").asc_nulls_last())
    ranked = docs.repartition(n, *keys).withColumn("__rank", F.row_number().over(order))
    ranked = written(ranked.select("__row", "__size", "__rank", *keys), "mix-ranks")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("__start") + F.col("__rank")
    crossed = lambda u: (F.floor(place * rate + u) - F.floor((place - 1) * rate + u)).cast("long")
    placed = lambda c: ranked.join(c, same(ranked, c, keys), "left").select(*(ranked[k] for k in ("__row", "__source", "__size", "__rank")), "__start", "source_size", "target", "__u")
    words = [F.sum(F.col("__size") * crossed(F.col("__u") + F.lit(k / OFFSETS))) for k in range(OFFSETS)]
    tried = placed(cells).groupBy("__source", "target").agg(*(w.alias(f"__w{k}") for k, w in enumerate(words)))
    miss = F.array(*(F.struct(F.abs(F.col(f"__w{k}") - F.col("target")).alias("miss"), F.lit(k / OFFSETS).alias("shift")) for k in range(OFFSETS)))
    best = tried.select("__source", F.array_min(miss)["shift"].alias("__shift"))
    # the choice reaches the rows by way of the cells, so that no source is one task's work
    chosen = cells.join(best, same(cells, best, ["__source"])).select(*(cells[k] for k in keys), "__start", "source_size", "target", (F.col("__u") + F.col("__shift")).alias("__u"))
    out = placed(chosen)
    judged = out.select("__row", F.col("__size").alias("size"), "source_size", "target", crossed(F.col("__u")).alias("copies"))
    judged = judged.withColumn("taken", F.col("size") * F.col("copies"))
    return rows.select("__row", *carried.private).join(judged, "__row").select(*carried.show(RESULT), *RESULT)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 2))::BIGINT, 0) AS cell FROM documents),
d AS (
  SELECT *, CASE WHEN size < 8 THEN size
    ELSE length(bin(size)) * 8 + ((size >> (length(bin(size)) - 4)) & 7) END AS class FROM t),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM s),
a AS (SELECT *, (source_size * 3)::DOUBLE / w AS lim FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER line, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER line, 0)) AS level
  FROM a WINDOW line AS (ORDER BY lim, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size, least((source_size * 3)::DOUBLE, w * max(level) FILTER (WHERE level <= lim) OVER ()) AS target,
         ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, cell, size, doc_id ASC NULLS LAST) AS i FROM d),
p AS (
  SELECT r.doc_id, r.source, r.size, r.i, g.source_size, g.target, g.u,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source),
o AS (SELECT k / 32.0::DOUBLE AS shift FROM range(32) AS o(k)),
m AS (
  SELECT source, shift, abs(sum(size * (floor(i * rate + (u + shift)) - floor((i - 1) * rate + (u + shift)))::BIGINT)::DOUBLE - target) AS miss
  FROM p, o GROUP BY source, shift, target),
b AS (SELECT source, min_by(shift, (miss, shift)) AS shift FROM m GROUP BY source)
SELECT p.doc_id, p.size, p.source_size, p.target,
  (p.size * (floor(i * rate + (u + shift)) - floor((i - 1) * rate + (u + shift))))::BIGINT AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""
