"""SimHash near-duplicates: sharded BK-trees find the links, connected components the groups."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ferrolith.operators.graph import connected_components, lookup

from .common import Carried, partitions, small_batches, text_of, written

SHINGLE = 3
RADIUS = 3
#: Codes that a shard is meant to hold, whatever the number of all codes.
SHARD = 512
#: A shard that clusters of codes make larger than this is dealt out in pieces of about this many.
MAX_SHARD = 2048
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str) -> int:
    """SimHash of the word shingles of a text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").translate(UPPER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed longs."""
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


class BKTree:
    """A BK-tree over 64-bit codes: the children of a node are keyed by their Hamming distance to it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        #: For each node its code's position, and the distances and numbers of its children.
        self.at: list[int] = []
        self.keys: list[np.ndarray] = []
        self.children: list[list[int]] = []
        none = np.zeros(0, np.int64)
        pending: list[tuple[np.ndarray, int]] = [(np.arange(len(codes)), -1)] if len(codes) else []
        while pending:
            members, parent = pending.pop()
            here = len(self.at)
            if parent >= 0:
                self.children[parent].append(here)
            self.at.append(int(members[0]))
            self.children.append([])
            if len(members) == 1:
                self.keys.append(none)
                continue
            rest = members[1:]
            far = np.bitwise_count(codes[rest] ^ codes[members[0]]).astype(np.int64)
            order = np.argsort(-far, kind="stable")
            rest, far = rest[order], far[order]
            cuts = [0, *(np.flatnonzero(far[1:] != far[:-1]) + 1).tolist(), len(rest)]
            # the last one that is pushed comes first
            self.keys.append(far[cuts[-2::-1]])
            pending += [(rest[a:b], here) for a, b in zip(cuts, cuts[1:])]

    def near(self, queries: np.ndarray, radius: int, later: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(position of a code, positions of the queries within the radius), along edges within the radius only.

        With later the queries are the tree's own codes, and only those after the code are given.
        """
        pending = [(0, np.arange(len(queries)))] if self.at else []
        while pending:
            node, asked = pending.pop()
            code = self.at[node]
            far = np.bitwise_count(queries[asked] ^ self.codes[code]).astype(np.int64)
            hit = asked[(far <= radius) & (asked > code)] if later else asked[far <= radius]
            if len(hit):
                yield code, hit
            if len(self.children[node]):
                on = np.abs(far - self.keys[node][:, None]) <= radius
                pending += [(child, asked[row]) for child, row, some in zip(self.children[node], on, on.any(axis=1)) if some]


def spanning_links(tree_codes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect all codes that links within the radius connect; one fewer than codes at most.

    Codes of the tree and the queries (the same array, or another piece of the shard) are given by their values.
    """
    same = tree_codes is queries
    codes = tree_codes if same else np.concatenate((tree_codes, queries))
    shift = 0 if same else len(tree_codes)
    group = np.arange(len(codes))
    links = []
    for code, hit in BKTree(tree_codes).near(queries, radius, later=same):
        others, first = np.unique(group[hit + shift], return_index=True)
        new = others != group[code]
        if not new.any():
            continue
        links += [(int(codes[code]), int(codes[q])) for q in hit[first[new]] + shift]
        group[np.isin(group, others[new])] = group[code]
    return links


def shard_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (shard, low, high, piece, fp), those of a task together; gives links (src, dst)."""
    rest: pd.DataFrame | None = None

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(np.uint64)
        key = rows[["shard", "low", "high"]].to_numpy()
        piece = rows["piece"].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        out = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
            codes = fp[a:b]
            if key[a, 1] == key[a, 2]:
                out += spanning_links(codes, codes)
            else:
                mine = piece[a:b] == key[a, 1]
                out += spanning_links(codes[mine], codes[~mine])
        both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"src": both[:, 0], "dst": both[:, 1]})

    for rows in batches:
        rows = rows if rest is None else pd.concat((rest, rows), ignore_index=True)
        if not len(rows):
            continue
        last = rows.iloc[-1]
        open_ = (rows["shard"] == last["shard"]) & (rows["low"] == last["low"]) & (rows["high"] == last["high"])
        rest = rows[open_]
        if not open_.all():
            yield links(rows[~open_])
    if rest is not None:
        yield links(rest)


def shard_keys(count: int, size: int = SHARD) -> list[Column]:
    """Keys under which codes (column fp) meet, so that shards keep their size as the number of codes grows.

    The 64 bits are cut into m blocks. Codes that differ in RADIUS bits at most agree in m - RADIUS blocks, so one key
    for each choice of so many blocks misses no pair, and neither does a key of the first bits of these blocks only.
    As many bits are taken as leave about `size` codes a shard; m is the smallest number of blocks that offers them.
    """
    bits = max(0, math.ceil(math.log2(max(count, 1) / size)))
    if not bits:
        return [F.lit(0).cast("long")]
    for m in range(RADIUS + 1, 2 * RADIUS + 2):
        chosen, width = m - RADIUS, 64 // m
        if chosen * width >= bits:
            break
    bits = min(bits, chosen * width)
    keys = []
    for number, blocks in enumerate(combinations(range(m), chosen)):
        key = F.lit(number).cast("long")
        for j, block in enumerate(blocks):
            take = bits * (j + 1) // chosen - bits * j // chosen
            key = F.shiftleft(key, take).bitwiseOR(F.shiftrightunsigned("fp", width * block).bitwiseAND(F.lit((1 << take) - 1)))
        keys.append(key)
    return keys


def near_links(codes: DataFrame, max_shard: int = MAX_SHARD, size: int = SHARD) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (column fp) that connect all within RADIUS bits.

    Every code goes to the shards of its keys, and every shard with two codes or more becomes a BK-tree that is asked
    about its codes. A shard of more than max_shard codes, which only clusters make, becomes pieces; each pair of
    pieces is a task that asks one piece's tree about the other's codes, so no task holds more than about two pieces.
    """
    n = partitions(codes.sparkSession)
    keyed = codes.select("fp", F.explode(F.array(*shard_keys(codes.count(), size))).alias("shard"))
    counts = keyed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / max_shard).cast("int").alias("pieces"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pieces = keyed.join(counts, "shard").withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    tasks = pieces.select("shard", "fp", "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    tasks = tasks.select("shard", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "piece", "fp")
    dealt = tasks.repartition(n, "shard", "low", "high").sortWithinPartitions("shard", "low", "high")
    return dealt.mapInPandas(shard_links, "src long, dst long")


def _groups(docs: DataFrame) -> DataFrame:
    """(fp, n, best) of rows (fp, own): the number of rows of each fingerprint, and the least `own` of all rows that
    links reach from it."""
    codes = written(docs.groupBy("fp").agg(F.min("own").alias("own"), F.count(F.lit(1)).alias("n")), "simhash-codes")
    groups = written(connected_components(written(near_links(codes.select("fp")), "simhash-links")), "simhash-groups")
    known = groups.join(codes.select(F.col("fp").alias("node"), "own"), "node")
    named = known.groupBy("component").agg(F.min("own").alias("best"), F.count(F.lit(1)).alias("codes"))
    named = written(named, "simhash-named")
    linked = lookup(groups, named, "component", "codes", groups.count()).select(F.col("node").alias("fp"), "best")
    table = codes.join(linked, "fp", "left").select("fp", "n", F.when(F.col("best").isNull(), F.col("own")).otherwise(F.col("best")).alias("best"))
    return written(table, "simhash-table")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row; component_id is the smallest id that links reach.

    Equal fingerprints are one code, so copies are never compared with each other, and each shard of codes gives
    spanning links only. The trees are built where their shard's codes meet: the set of all fingerprints grows with
    the input, so it is dealt out, not broadcast. Fingerprints of a large share of the rows are named by broadcast.

    Defined cases: null and empty texts have fingerprint zero and link like any other; a null id is in no
    competition for component_id, which is null only where no id of a group is known; repeated rows give repeated
    results; an empty table gives an empty result; very long texts are read whole. Only the two named columns are
    read.
    """
    docs = written(df.select(F.col(id_col).alias("id"), simhash(text_of(text_col)).alias("fp")), "simhash")
    table = _groups(docs.select("fp", F.struct(F.col("id").isNull().alias("none"), "id").alias("own")))
    named = lookup(docs, table, "fp", "n", docs.count())
    return named.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.id").alias("component_id"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked fingerprints, with all its columns: the one with the smallest id.

    Rows are told apart by numbers of their own, given when they are written with their fingerprints, so rows that
    share an id are decided one by one. Defined cases: as in near_dedup; null ids come last; of rows with the same id
    in one group any one stays, but only one.
    """
    carried = Carried(df)
    rows = df.select(*carried.hide(df), F.col(id_col).alias("__id"), simhash(text_of(text_col)).alias("fp"))
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")
    table = _groups(rows.select("fp", F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row")).alias("own")))
    kept = table.select(F.col("best.row").alias("__row")).distinct()
    return rows.join(kept, "__row", "left_semi").select(*carried.show())


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
