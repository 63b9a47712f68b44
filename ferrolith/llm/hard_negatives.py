"""Hard negatives: rows of another label whose score comes close below that of a positive of the anchor."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, written
from .vectors import common_length, finite, matrix, whole_numbers

#: Rows that one cell of the grid holds at most, about; anchors that one spanning tree holds, about.
SLICE_ROWS, TREE_ANCHORS = 16_384, 2_048
#: Candidates whose bounds a task holds at a time, for all anchors of a tree.
CHUNK = 1_024


# --- spanning trees of anchors


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows of x by distance: (order, parent, edge); parents come before their children.

    The root is the row nearest to the mean and has itself as parent. Edges are rounded up.
    """
    v = x.astype(np.float64)
    n = len(v)
    norms = (v * v).sum(axis=1)
    root = int(((v - v.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order, parent, edge = [root], np.full(n, root), np.zeros(n)
    near, left = np.full(n, np.inf), np.ones(n, dtype=bool)
    left[root], last = False, root
    for _ in range(n - 1):
        far = np.maximum(norms + norms[last] - 2 * (v @ v[last]), 0)
        closer = left & (far < near)
        near[closer], parent[closer] = far[closer], last
        last = int(np.where(left, near, np.inf).argmin())
        left[last] = False
        order.append(last)
    gap = v - v[parent]
    edge = np.sqrt((gap * gap).sum(axis=1)) * (1 + 1e-9)
    return np.array(order), parent, edge


def _tree_rows(width: int):
    def tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        order, parent, edge = spanning_tree(np.stack(rows["x"].to_list()).astype(np.int64).reshape(-1, width))
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        return rows.assign(place=place, parent=place[parent], edge=edge)

    return tree


# --- scores and bounds in a cell


class Cell:
    """A tree of anchors against a slice of candidates. Scores are exact; bounds only say which ones are needed."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table, width: int):
        anchors = anchors.sort_by("place")
        self.anchors, self.candidates = anchors, candidates
        self.a, self.c = matrix(anchors["x"], width), matrix(candidates["x"], width)
        top = int(np.abs(self.a).max(initial=0)) * int(np.abs(self.c).max(initial=0)) * width
        if top >= 1 << 63:
            raise ValueError("an inner product does not fit a long")
        if top < 1 << 53:  # products of doubles are exact below that
            self.a, self.c = self.a.astype(np.float64), self.c.astype(np.float64)
        self.parent, self.edge = anchors["parent"].to_numpy(), anchors["edge"].to_numpy()
        self.labels = [t["label"].to_numpy(zero_copy_only=False) for t in (anchors, candidates)]
        self.rows = [t["row"].to_numpy() for t in (anchors, candidates)]
        self.ids = candidates["id"].to_numpy(zero_copy_only=False)
        self.scored = 0

    def walk(self, wanted) -> None:
        """Calls wanted(anchor, candidates, low, high, score) down the tree for each chunk of candidates.

        low and high bound the scores of the chunk's candidates: those at the parent, minus and plus the edge times
        the candidate's norm. wanted picks what to score by the function score, which also tightens the bounds for
        the anchors below. At the root all candidates are scored.
        """
        for start in range(0, len(self.c), CHUNK):
            c = self.c[start : start + CHUNK]
            norm = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
            low, high = np.empty((len(self.a), len(c))), np.empty((len(self.a), len(c)))
            for k in range(len(self.a)):
                if k:
                    reach = self.edge[k] * norm + 1
                    np.subtract(low[self.parent[k]], reach, out=low[k])
                    np.add(high[self.parent[k]], reach, out=high[k])

                def score(at: np.ndarray, k: int = k) -> np.ndarray:
                    found = (c[at] @ self.a[k]).astype(np.int64)
                    low[k, at] = high[k, at] = found
                    self.scored += len(at)
                    return found

                if k == 0:
                    score(np.arange(len(c)))
                wanted(k, slice(start, start + len(c)), low[k], high[k], score)


PAIRS = "anchor_row long, anchor_id {id}, row long, id {id}, score long"


def _best(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the first by falling score, ties by id; all that tie with the last score compete by id."""
    if len(scores) > 4 * most:
        floor = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:most]]
    return np.lexsort((ids, -scores))[:most]


def _positives(width: int, most: int, schema: pa.Schema):
    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(anchors) or not len(candidates):
            return schema.empty_table()
        it = Cell(anchors, candidates, width)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(it.a)

        def wanted(k, part, low, high, score):
            mine = np.flatnonzero((it.labels[1][part] == it.labels[0][k]) & (it.rows[1][part] != it.rows[0][k]))
            if not len(mine):
                return
            places, scores = best[k]
            floor = scores.min() if len(scores) == most else -np.inf
            if len(mine) > most:  # so many candidates reach this score at least
                floor = max(floor, np.partition(low[mine], len(mine) - most)[len(mine) - most])
            mine = mine[high[mine] >= floor]
            places, scores = np.concatenate([places, mine + part.start]), np.concatenate([scores, score(mine)])
            first = _best(it.ids[places], scores, most)
            best[k] = places[first], scores[first]

        it.walk(wanted)
        sizes = [len(p) for p, _ in best]
        places = np.concatenate([p for p, _ in best])
        k = np.repeat(np.arange(len(best)), sizes)
        columns = [pa.array(it.rows[0][k]), it.anchors["id"].take(pa.array(k)), pa.array(it.rows[1][places]), candidates["id"].take(pa.array(places)), pa.array(np.concatenate([s for _, s in best]))]
        return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)

    return cell


def _negatives(width: int, most: int, low_share: int, high_share: int, schema: pa.Schema):
    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(anchors) or not len(candidates):
            return schema.empty_table()
        it = Cell(anchors, candidates, width)
        windows = [[(p["place"], p["score"]) for p in (ps or [])] for ps in it.anchors["positives"].to_pylist()]
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def wanted(k, part, low, high, score):
            if not windows[k]:
                return
            other = it.labels[1][part] != it.labels[0][k]
            need = np.zeros(len(other), dtype=bool)
            for _, s in windows[k]:
                need |= (100 * high >= low_share * s) & (100 * low <= high_share * s)
            at = np.flatnonzero(need & other)
            if not len(at):
                return
            found = score(at)
            for place, s in windows[k]:
                inside = np.flatnonzero((100 * found >= low_share * s) & (100 * found <= high_share * s))
                if len(inside):
                    places, scores = best.get((k, place), (at[:0], found[:0]))
                    places, scores = np.concatenate([places, at[inside] + part.start]), np.concatenate([scores, found[inside]])
                    first = _best(it.ids[places], scores, most)
                    best[k, place] = places[first], scores[first]

        it.walk(wanted)
        keys = sorted(best)
        sizes = [len(best[key][0]) for key in keys]
        if not keys:
            return schema.empty_table()
        k = np.repeat([key[0] for key in keys], sizes)
        places = np.concatenate([best[key][0] for key in keys])
        columns = [
            pa.array(it.rows[0][k]), pa.array(np.repeat([key[1] for key in keys], sizes).astype(np.int32)),
            candidates["id"].take(pa.array(places)), pa.array(np.concatenate([best[key][1] for key in keys])),
        ]
        return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)

    return cell


# --- the operator


def hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5,
    window: tuple[int, int] = (80, 100), scale: int = 256, slice_rows: int = SLICE_ROWS, tree_anchors: int = TREE_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors of df.

    Entries become floor(scale * entry); scores are exact inner products. An anchor's positives are the other rows of
    its label with the highest scores, ties by smaller id. Of each positive the rows of other labels with the highest
    scores between window[0] and window[1] percent of the positive's score are returned.

    Rows are dealt to slices, anchors to trees, both by hash. Each tree is a minimum spanning tree, built once. A cell
    of the grid of trees and slices is one task's work: at the root all candidates are scored; at each further anchor
    the scores at its parent, plus and minus the edge's length times the candidate's norm, bound the score, and only
    candidates whose bounds overlap the window are scored again. For positives the window starts at the least score
    that enough candidates are known to reach. Every row meets every anchor in blocks, no pair leaves a cell but the
    best few of an anchor; cells are of equal size however labels or vectors are distributed.

    Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite entry take no part,
    nor do rows of another length than most vectors have. Equal ids are rows of their own, equal vectors tie. Anchors
    without a positive, and positives without a row in the window, return nothing. An empty table gives an empty
    result; further columns are left out. A product that does not fit a long fails the job.
    """
    spark = df.sparkSession
    id_type = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    sound = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    sound = sound.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    width = common_length(sound, "v")
    rows = sound.where(F.size("v") == width).select("id", "label", "anchor", whole_numbers(F.col("v"), scale).alias("x"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "negatives-rows")
    n, n_anchors = rows.select(F.count(F.lit(1)), F.count_if("anchor")).first()
    # at least a slice a partition, so that all cores have work; a slice fits a task however many rows there are
    slices, trees = max(partitions(spark), math.ceil(n / slice_rows)), max(1, math.ceil(n_anchors / tree_anchors))

    anchors = rows.where("anchor").withColumn("tree", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(trees)).cast("int"))
    tree_schema = f"id {id_type}, label {rows.schema['label'].dataType.simpleString()}, x array<bigint>, row bigint, tree int, place int, parent int, edge double"
    anchors = written(anchors.select("id", "label", "x", "row", "tree").groupBy("tree").applyInPandas(_tree_rows(width), tree_schema), "negatives-trees")

    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("id", "label", "x", "row", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(slices)).cast("int").alias("slice"), every(trees).alias("tree"))
    cells = candidates.groupBy("tree", "slice")

    def over_grid(tree_rows: DataFrame, cell, schema: str) -> DataFrame:
        return tree_rows.select("*", every(slices).alias("slice")).groupBy("tree", "slice").cogroup(cells).applyInArrow(cell, schema)

    pair_schema = f"anchor_row long, anchor_id {id_type}, row long, id {id_type}, score long"
    found = over_grid(anchors, _positives(width, positives, _arrow(spark, pair_schema)), pair_schema)
    best = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    found = written(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "negatives-positives")

    of_anchor = found.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("positives"))
    armed = anchors.join(of_anchor, anchors["row"] == of_anchor["anchor_row"], "left").drop("anchor_row")
    mined_schema = f"anchor_row long, place int, negative_id {id_type}, negative_score long"
    mined = over_grid(armed, _negatives(width, negatives, *window, _arrow(spark, mined_schema)), mined_schema)
    ranked = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    of_positive = found.select("anchor_row", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(of_positive, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""
