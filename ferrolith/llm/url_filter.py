"""Judges urls by lists of hosts and paths, held as cascades of Bloom filters over all keys of the corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, written

RESULT = ["host", "path", "rule", "listed", "verdict"]
#: Keys of the universe that one shard holds, about; shards are built by one task each.
SHARD_KEYS = 1 << 16
#: Bytes of filters that are broadcast at a time; longer cascades are applied in several passes over the keys of the rows.
PASS_BYTES = 32 << 20
#: Kinds of keys, each with a cascade of its own, by bit.
KINDS = ("allow", "block", "listed")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- keys of a url


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ? or #; else empty."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, labels: int, depth: int) -> Column:
    """The keys that could be listed for a url, longest first: last labels of the host x first folders of the path.

    Only as many labels and folders are formed as some list has, so a url gives at most labels x (depth + 1) keys.
    """
    dots = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/")))
    hosts = F.transform(F.sequence(F.lit(1), F.least(dots, F.lit(labels))), lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    paths = F.transform(F.sequence(F.lit(1), F.least(slashes, F.lit(depth + 1))), lambda k: F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/")))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct((-F.length(h) - F.length(p)).alias("short"), (-F.length(h)).alias("host"), F.concat(h, p).alias("key")))))
    return F.when(slashes > 0, F.transform(F.array_sort(pairs), lambda s: s["key"])).otherwise(F.array().cast("array<string>"))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.concat(F.lit("2:"), key))


# --- cascades


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit numbers, another one for each salt."""
    x = x.astype(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, probes: int) -> np.ndarray:
    first, step = _mixed(h1, 2 * level), _mixed(h2, 2 * level + 1) | np.uint64(1)
    return (first[:, None] + np.arange(probes, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def _held(filter_: tuple[int, int, np.ndarray], level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    bits, probes, words = filter_
    at = _places(h1, h2, level, bits, probes)
    return ((words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def cascade(h1: np.ndarray, h2: np.ndarray, member: np.ndarray, most: int = 64) -> list[tuple[int, int, np.ndarray]]:
    """Filters (bits, probes, bytes), so that `members` is exact for all keys given here.

    Level 1 holds the listed keys, level 2 the others that level 1 lets pass, level 3 the listed keys that level 2 lets
    pass, until no level lets a wrong key pass. If two keys had the same 128 bits, the job fails.
    """
    inside, outside, levels = np.flatnonzero(member), np.flatnonzero(~member), []
    while len(inside):
        if len(levels) == most:
            raise ValueError("two keys cannot be told apart by their 128 bits")
        # the first level is chosen so that the second one is about as long; each further one halves its input
        rate = min(0.5, len(inside) / (math.sqrt(2) * max(1, len(outside)))) if not levels else 0.5
        probes = max(1, round(-math.log2(rate)))
        bits = 8 * math.ceil(max(64, len(inside) * probes / math.log(2)) / 8)
        at = _places(h1[inside], h2[inside], len(levels), bits, probes).ravel()
        words = np.zeros(bits // 8, dtype=np.uint8)
        np.bitwise_or.at(words, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        levels.append((bits, probes, words))
        wrong = outside[_held(levels[-1], len(levels) - 1, h1[outside], h2[outside])] if len(outside) else outside
        inside, outside = wrong, inside
    return levels


def members(levels: list[tuple[int, int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys of the universe are listed: the parity of the first level that does not hold them."""
    result, left = np.zeros(len(h1), dtype=bool), np.arange(len(h1))
    for i, one in enumerate(levels):
        held = _held(one, i, h1[left], h2[left])
        result[left[~held]] = i % 2 == 1
        left = left[held]
    result[left] = len(levels) % 2 == 1
    return result


CASCADES = "shard long, kind int, level int, bits long, probes int, bytes binary"


def build_cascades(keys: DataFrame, shards: int) -> DataFrame:
    """One cascade a kind and shard, from rows (h1, h2, kinds) of the whole universe; kinds is a bit set over KINDS."""

    def built(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2, kinds = (rows[c].to_numpy() for c in ("h1", "h2", "kinds"))
        out = [
            (key[0], kind, level, bits, probes, words.tobytes())
            for kind in range(len(KINDS))
            for level, (bits, probes, words) in enumerate(cascade(h1, h2, (kinds >> kind) & 1 == 1))
        ]
        return pd.DataFrame(out, columns=["shard", "kind", "level", "bits", "probes", "bytes"])

    return keys.groupBy(F.pmod("h2", F.lit(shards)).alias("shard")).applyInPandas(built, CASCADES)


def _first_hits(known: dict, shards: int, lists: pd.Series, others: pd.Series) -> pd.DataFrame:
    """Place (from 1) of the first key of each row and kind that is listed in the known shards; -1 for none."""
    sizes = lists.map(len).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    hits = np.full((len(sizes), len(KINDS)), np.iinfo(np.int32).max, dtype=np.int64)
    if len(row):
        pairs, back = np.unique(np.stack([np.concatenate(lists.to_list()), np.concatenate(others.to_list())], 1).astype(np.int64), axis=0, return_inverse=True)
        back = back.ravel()
        shard = pairs[:, 1] % shards
        order = np.argsort(shard, kind="stable")
        found = np.zeros((len(pairs), len(KINDS)), dtype=bool)
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            for kind, levels in known.get(int(shard[part[0]]), {}).items():
                found[part, kind] = members(levels, pairs[part, 0], pairs[part, 1])
        for kind in range(len(KINDS)):
            yes = found[back, kind]
            np.minimum.at(hits[:, kind], row[yes], place[yes])
    return pd.DataFrame({k: pd.array(np.where(hits[:, i] < np.iinfo(np.int32).max, hits[:, i], -1), dtype="int64").astype("int32") for i, k in enumerate(KINDS)})


def _hit_udf(shared, shards: int):
    @F.pandas_udf(", ".join(f"{k} int" for k in KINDS))
    def hit(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lists, others in parts:
            yield _first_hits(shared.value, shards, lists, others)

    return hit


def _hits(rows: DataFrame, cascades: DataFrame, shards: int, pass_bytes: int) -> DataFrame:
    """Adds a struct __hit: for each kind the place of the longest listed key in __keys, or null.

    Cascades are broadcast in passes of pass_bytes at most (a single shard where it alone is longer); between passes
    the rows are a table of the shared folder. So any length of lists is applied in bounded memory, without a join.
    """
    spark = rows.sparkSession
    sizes = [(r["shard"], r["n"]) for r in cascades.groupBy("shard").agg(F.sum(F.length("bytes")).alias("n")).orderBy("shard").collect()]
    passes: list[list[int]] = []
    used = 0
    for shard, n in sizes:
        if not passes or used + n > pass_bytes:
            passes.append([shard, shard])
            used = 0
        passes[-1][1], used = shard, used + n
    none = F.struct(*(F.lit(None).cast("int").alias(k) for k in KINDS))
    rows = rows.withColumn("__hit", none)
    for i, (low, high) in enumerate(passes):
        known: dict = {}
        for r in cascades.where(F.col("shard").between(low, high)).orderBy("shard", "kind", "level").collect():
            known.setdefault(r["shard"], {}).setdefault(r["kind"], []).append((r["bits"], r["probes"], np.frombuffer(r["bytes"], dtype=np.uint8)))
        hit = _hit_udf(spark.sparkContext.broadcast(known), shards)
        here = rows.withColumn("__now", hit("__h1", "__h2"))
        merged = F.struct(*(F.least(f"__hit.{k}", F.when(F.col(f"__now.{k}") > 0, F.col(f"__now.{k}"))).alias(k) for k in KINDS))
        rows = here.withColumn("__hit", merged).drop("__now")
        if i < len(passes) - 1:
            rows = written(rows, "url-pass")
    return rows


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame | None = None, url_col: str = "url", shard_keys: int = SHARD_KEYS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Adds host, path, rule, listed and verdict to every row.

    rules are (verdict, key) with verdict allow or block; a key is a host and a path that begins and ends with a slash
    (`net/`, `example.net/en/`). It fits the urls of its host and of all subdomains whose path starts with its path.
    The longest fitting rule decides and is named in rule; where none fits, the longest fitting key of listed (a
    DataFrame with a string column key, of any length) is named in listed and blocks; all other urls are allowed.

    The universe is the set of all keys that some row of pages has, of the forms that occur in the lists. It is dealt
    to shards by hash, and each shard becomes a cascade of Bloom filters a kind of key: the listed keys, then the
    other keys that pass by mistake, and so on. Since the cascades see all keys of the rows that they judge, they are
    exact; rows are judged by lookups in broadcast filters, without a join.

    Defined cases: a null url, and one without ://, has an empty host and path and is allowed; so is one with an empty
    path, which starts with no rule's path. Rows that repeat are judged alike; an empty table gives an empty result;
    long urls are read whole. Input columns named like a result column are replaced by it. Of a key that rules allow
    and block, allow holds; rules and listed keys that are null or have no slash at either end of the path fail the job.
    """
    spark = pages.sparkSession
    for verdict, key in rules:
        if verdict not in KINDS[:2] or "/" not in key or not key.endswith("/"):
            raise ValueError(f"not a rule: {verdict} {key}")
    carried = Carried(pages)
    host, path = host_and_path(pages[f"`{url_col}`"])
    rows = pages.select(*carried.hide(pages), host.alias("__host"), path.alias("__path"))

    listing = spark.createDataFrame([(k, 1 << KINDS.index(v)) for v, k in rules], "key string, kinds int")
    if listed is not None:
        sound = F.when(F.col("key").contains("/") & F.col("key").endswith("/"), F.col("key")).otherwise(F.raise_error(F.lit("a listed key must end in a slash")))
        listing = listing.unionByName(listed.select(sound.alias("key"), F.lit(1 << 2).alias("kinds")).distinct())
    listing = written(listing, "url-lists")
    key_host = F.substring_index("key", "/", 1)
    labels = F.length(key_host) - F.length(F.replace(key_host, F.lit("."))) + 1
    depth = F.length("key") - F.length(F.replace(F.col("key"), F.lit("/"))) - 1
    most = listing.select(F.max(labels), F.max(depth)).first()

    rows = rows.withColumn("__keys", keys_of(F.col("__host"), F.col("__path"), most[0] or 0, most[1] or 0) if most[0] else F.array().cast("array<string>"))
    universe = rows.select(F.explode("__keys").alias("key"), F.lit(0).alias("kinds")).unionByName(listing).groupBy("key").agg(F.bit_or("kinds").alias("kinds"))
    h1, h2 = _hashes(F.col("key"))
    keys = written(universe.select(h1.alias("h1"), h2.alias("h2"), "kinds"), "url-keys")
    shards = max(1, math.ceil(keys.count() / shard_keys))
    cascades = written(build_cascades(keys, shards), "url-cascades")

    rows = rows.withColumn("__h1", F.transform("__keys", lambda k: _hashes(k)[0])).withColumn("__h2", F.transform("__keys", lambda k: _hashes(k)[1]))
    judged = _hits(rows, cascades, shards, pass_bytes)
    at = lambda place: F.try_element_at("__keys", place)
    rule = at(F.least("__hit.allow", "__hit.block"))
    allowed = F.coalesce(F.col("__hit.allow") <= F.coalesce("__hit.block", F.col("__hit.allow")), F.lit(False))
    by_list = F.when(rule.isNull(), at(F.col("__hit.listed")))
    verdict = F.when(rule.isNotNull(), F.when(allowed, "allow").otherwise("block")).when(by_list.isNotNull(), "block").otherwise("allow")
    return judged.select(*carried.show(RESULT), F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), by_list.alias("listed"), verdict.alias("verdict"))


# --- the registered query

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Words of host names, between dots and hyphens, that put a host of the corpus on the list.
SPAM_WORDS = ("ads", "adult", "bet", "bets", "betting", "casino", "dating", "escort", "gambling", "loans", "lottery", "malware", "phishing", "pills", "pharmacy", "poker", "porn", "sex", "spam", "torrent", "track", "viagra", "warez", "xxx")


def suspect_hosts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(key): the hosts of the corpus with a word of SPAM_WORDS in their name."""
    host, _ = host_and_path(F.col(url_col))
    words = F.array(*(F.lit(w) for w in SPAM_WORDS))
    return pages.select(host.alias("host")).distinct().where(F.arrays_overlap(F.split("host", "[.-]"), words)).select(F.concat("host", F.lit("/")).alias("key"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES, suspect_hosts(pages)).drop("url")


OP13_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, f) AS (VALUES {", ".join(f"('{v}', '{k.split('/', 1)[0]}', '/{k.split('/', 1)[1]}')" for v, k in RULES)}),
m AS (
  SELECT page_id, arg_max(h || f, length(h || f)) AS rule, arg_max(verdict, length(h || f)) AS verdict
  FROM p JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, f) GROUP BY page_id),
j AS (
  SELECT p.page_id, host, path, rule, m.verdict AS ruled,
         starts_with(path, '/') AND list_has_any(regexp_split_to_array(host, '[.-]'), [{", ".join(f"'{w}'" for w in SPAM_WORDS)}]) AS suspect
  FROM p LEFT JOIN m USING (page_id))
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL AND suspect THEN host || '/' END AS listed,
       coalesce(ruled, CASE WHEN suspect THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""
