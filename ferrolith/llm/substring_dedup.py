"""Substring deduplication: suffix automata of reference shards give every document's matching statistics."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import partitions, running, small_batches, text_of, written

#: Words in a window; a repeated window is removed.
WINDOW = 50
#: Words in an anchor. Every window holds WINDOW - ANCHOR + 1 of these word groups, and one of them is selected.
ANCHOR = 12
SPAN = WINDOW - ANCHOR + 1
#: Anchors with more occurrences are decided window by window.
MAX_GROUP = 512
#: Stands for a missing id, which is smaller than none.
LAST = (1 << 63) - 1


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the word groups that are smallest in some window (robust winnowing).

    A window selects the same hash wherever it stands, so two documents that share a window share an anchor in it.
    """
    n = len(codes) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    h = np.zeros(len(codes) - ANCHOR + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ANCHOR):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - ANCHOR + 1 + j]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    last = np.arange(n) + (SPAN - 1) - np.lib.stride_tricks.sliding_window_view(h, SPAN)[:, ::-1].argmin(axis=1)
    at = np.unique(last)
    if len(at) * 8 > n:  # ties: a window keeps its left neighbour's choice where it can
        low, at, mine = h[last], [], -1
        for i, (p, m) in enumerate(zip(last.tolist(), low.tolist())):
            if mine < i or int(h[mine]) != m:
                mine = p
                at.append(p)
        at = np.array(at)
    return h[at].view(np.int64), at.astype(np.int32)


class SuffixAutomaton:
    """A generalised suffix automaton over word codes; texts are added one after the other."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, text: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in text:
            if c in nxt[last]:
                q = nxt[last][c]
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        made = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = made
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = made
            p = link[p]
        return made

    def spans(self, text: list[int], least: int) -> tuple[list[tuple[int, int]], int]:
        """(maximal stretches of at least so many words that occur in the added texts, as [start, end), merged; number
        of windows of so many words that occur)."""
        nxt, link, length = self.next, self.link, self.length
        out: list[tuple[int, int]] = []
        state = size = known = 0
        for i, c in enumerate(text):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            if size >= least:
                known += 1
                a, b = i + 1 - size, i + 1
                if out and a <= out[-1][1]:
                    out[-1] = (min(out[-1][0], a), b)
                else:
                    out.append((a, b))
        return out, known


def _first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = {k: [] for k in ("n", "digest", "anchors", "at")}
        for text in batch["text"]:
            words = split(text)
            got, at = anchors(word_codes(words)) if len(words) >= WINDOW else (np.zeros(0, np.int64), np.zeros(0, np.int32))
            for k, v in zip(out, (len(words), hashlib.sha256(b" ".join(words)).digest(), got, at)):
                out[k].append(v)
        yield pd.DataFrame({"id": batch["id"], "rank": batch["rank"], **out})


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of all windows around each shared anchor of a document."""
    for batch in batches:
        rows: list[tuple] = []
        for key, rank, text, found in batch[["key", "rank", "text", "found"]].itertuples(index=False):
            codes = word_codes(split(text)).view(np.int64)
            for anchor, at in ((f["anchor"], f["at"]) for f in found):
                start = max(0, at + ANCHOR - WINDOW)
                rows.append((anchor, rank, key, start, codes[start : at + WINDOW]))
            if len(rows) >= 4000:
                yield pd.DataFrame(rows, columns=["anchor", "rank", "key", "start", "codes"])
                rows = []
        yield pd.DataFrame(rows, columns=["anchor", "rank", "key", "start", "codes"])


def _matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by anchor, then by rank. The automaton of an anchor holds the segments of smaller documents so far."""
    anchor, rank = None, None
    automaton, seen, waiting = SuffixAutomaton(), {}, deque()

    def admit() -> None:
        while waiting:
            text, bytes_ = waiting.popleft()
            automaton.add(text)
            seen[bytes_] = True

    for batch in batches:
        out: list[tuple] = []
        for a, r, key, start, codes in batch[["anchor", "rank", "key", "start", "codes"]].itertuples(index=False):
            if a != anchor:
                anchor, rank, automaton, seen = a, r, SuffixAutomaton(), {}
                waiting.clear()
            if r != rank:
                admit()
                rank = r
            bytes_ = codes.tobytes()
            if bytes_ in seen:
                out.append((key, start, start + len(codes)))
                continue
            text = codes.tolist()
            found, known = automaton.spans(text, WINDOW)
            out += [(key, start + x, start + y) for x, y in found]
            # covered words are not enough: a window across two matches can be new
            if known < len(text) - WINDOW + 1:
                waiting.append((text, bytes_))
        yield pd.DataFrame(out, columns=["key", "a", "b"])


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each window of a segment under two 64-bit hashes, for anchors that too many documents share."""
    for batch in batches:
        rows = []
        for rank, key, start, codes in batch[["rank", "key", "start", "codes"]].itertuples(index=False):
            raw = codes.tobytes()
            for i in range(len(codes) - WINDOW + 1):
                w = raw[8 * i : 8 * (i + WINDOW)]
                h = xxhash.xxh3_128_intdigest(w)
                rows.append((np.int64((h >> 64) - (1 << 63)), np.int64((h & ((1 << 64) - 1)) - (1 << 63)), rank, key, start + i))
        yield pd.DataFrame(rows, columns=["h1", "h2", "rank", "key", "a"])


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, text, ranges in batch[["key", "text", "ranges"]].itertuples(index=False):
            words = split(text)
            gone = np.zeros(len(words) + 1, np.int64)
            for r in ranges:
                gone[r["a"]] += 1
                gone[r["b"]] -= 1
            stays = np.cumsum(gone[:-1]) == 0
            kept = b" ".join([w for w, s in zip(words, stays.tolist()) if s])
            out.append((key, len(words) - int(stays.sum()), kept.decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(out, columns=["key", "n_removed", "kept_text"])


def _ordered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rank, text): rank is a whole number in the order of the ids, and LAST for a missing one."""
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if docs.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return docs.withColumn("rank", F.coalesce(F.col("id").cast("long"), F.lit(LAST)))
    ids = running(docs.select("id").where("id IS NOT NULL").distinct(), [F.col("id").asc()], {"rank": F.lit(1).cast("long")})
    return docs.join(ids, "id", "left").select("id", "text", F.coalesce("rank", F.lit(LAST)).alias("rank"))


def _shared(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all rows with word count and digest, the smallest row of each word sequence, what is left of its text)."""
    docs = _ordered(df, id_col, text_col)
    kind = docs.schema["id"].dataType
    # ids enter Python as strings: whole numbers beside missing ones would lose digits there
    numbered = docs.select(F.col("id").cast("string").alias("id"), "rank", "text")
    first = numbered.mapInPandas(_first_pass, "id string, rank long, n int, digest binary, anchors array<long>, at array<int>")
    first = written(first.withColumn("id", F.col("id").cast(kind)), "substring-anchors")
    # of equal word sequences only the smallest is a reference, and only it can have words left
    least = first.groupBy(F.col("digest").alias("key")).agg(F.min("rank").alias("rank"), F.first("anchors").alias("anchors"), F.first("at").alias("at"))
    least = least.select("key", "rank", F.arrays_zip(F.col("anchors").alias("anchor"), "at").alias("all"))
    least = written(least, "substring-references")
    places = least.select("rank", "key", F.inline("all").alias("anchor", "at"))
    shared = places.groupBy("anchor").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    # tables again, so that Spark can split the join at anchors that very many documents have
    shared = written(shared.select("anchor", (F.col("n") > MAX_GROUP).alias("hot")), "substring-shared")
    hits = written(places.join(shared, "anchor"), "substring-hits")
    found = hits.groupBy("key", "rank").agg(F.collect_list(F.struct("anchor", "at", "hot")).alias("found"))
    # ids may repeat or be missing: the row's own words must be those of the reference
    owner = docs.select("rank", "text", digest_of("text").alias("key"))
    candidates = owner.join(found, ["key", "rank"]).dropDuplicates(["key"])
    return first, least, written(candidates.select("key", "rank", "text", "found"), "substring-candidates")


@F.pandas_udf(BinaryType())
def digest_of(texts: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(b" ".join(split(t))).digest() for t in texts], dtype=object)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) for every row; kept_text is null where all words stay.

    A word is removed when a window of WINDOW words around it also starts in a row with a smaller id.

    Every window holds an anchor, a group of ANCHOR words that is chosen by content. Anchors that more than one
    document has name the reference shards: all segments of up to WINDOW words on both sides of an anchor meet by
    its hash, in order of id. Each is streamed through the suffix automaton of the smaller documents' segments, and
    its maximal matches of WINDOW words or more are removed; then it joins the automaton, unless it had no new
    window. Reference shards grow with the corpus, so they are dealt out by anchor and not broadcast. An anchor of
    more than MAX_GROUP places is decided window by window with map-side minima, which no hot passage can clog.

    Defined cases: a null text has no words; a null id is smaller than none, and null ids take nothing from each
    other; rows that repeat an id take nothing from each other; ids of any type are taken in its order; texts under WINDOW words stay;
    an empty table gives an empty result. Only the two named columns are read.
    """
    n = partitions(df.sparkSession)
    first, least, candidates = _shared(df, id_col, text_col)
    segment = "anchor long, rank long, key binary, start int, codes array<long>"
    part = lambda hot: F.filter("found", lambda f: f["hot"] == F.lit(hot))
    cold = candidates.withColumn("found", part(False)).where(F.size("found") > 0).mapInPandas(_segments, segment)
    dealt = cold.repartition(n, "anchor").sortWithinPartitions("anchor", "rank")
    ranges = dealt.mapInPandas(_matched, "key binary, a int, b int")
    hot = candidates.withColumn("found", part(True)).where(F.size("found") > 0).mapInPandas(_segments, segment)
    windows = hot.mapInPandas(_windows, "h1 long, h2 long, rank long, key binary, a int")
    # as tables of their own, so that Spark can split the join at windows that very many documents share
    lowest = written(windows.groupBy("h1", "h2").agg(F.min("rank").alias("low")), "substring-windows")
    taken = windows.join(lowest, ["h1", "h2"]).where("rank > low").select("key", "a", (F.col("a") + WINDOW).cast("int").alias("b"))
    ranges = ranges.union(written(taken, "substring-taken")).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    left = candidates.select("key", "text").join(ranges, "key").mapInPandas(_kept, "key binary, n_removed int, kept_text string")
    left = written(left, "substring-kept")
    table = written(least.join(left, "key", "left").select(F.col("key").alias("digest"), F.col("rank").alias("low"), "n_removed", "kept_text"), "substring-result")
    rows = first.select("id", "rank", "n", "digest").join(table, "digest")
    copy = (F.col("rank") > F.col("low")) & (F.col("n") >= WINDOW)
    kept = F.when(copy, F.lit("")).otherwise(F.col("kept_text"))
    return rows.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words"),
        F.when(copy, F.col("n")).when(F.col("rank") == F.col("low"), F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.sha2(kept.cast("binary"), 256), F.lower(F.hex("digest"))).alias("kept_sha256"), kept.alias("kept_text"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept_text")


#: The same by joining all windows.
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, r, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW})),
hit AS (SELECT r, i FROM w JOIN (SELECT h, min(doc_id) AS low FROM w GROUP BY h) USING (h) WHERE low < coalesce(doc_id, 'infinity'::DOUBLE)),
gone AS (SELECT DISTINCT r, i + k AS j FROM hit, range({WINDOW}) t(k)),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY j) AS text
  FROM (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d WHERE r IN (SELECT r FROM n)) ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n.r IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
