"""Batch search over element tables: many queries at once, ranked hits, merged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import dealt
from .rollup import number_or_null, part_identity, part_label, present, with_columns

#: How many assemblies and profiles a query shows.
MOST = {"assembly": 22, "profile": 14}
#: Families of rolled and hollow sections by which a query is taken for a profile name.
FAMILIES = "hea|heb|hem|ipea|ipeo|ipe|ipn|inp|upe|upa|upn|rhs|chs|shs|pfc|uka|ukb|uko|tub|ucs|ubo|ukpfc|hp|hd|hl|mtd|mtdp|mtdv|cold|welded"
#: The order of sections by intent.
SECTIONS = {"profile-heavy": ["profile", "part", "assembly", "bolt"], "mark-heavy": ["assembly", "part", "bolt", "profile"], "neutral": ["assembly", "part", "bolt", "profile"]}


def normalized(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def compacted(c: Column) -> Column:
    """Without separators: 'HEB 280' and 'heb-280' are the same."""
    return F.lower(F.regexp_replace(c, r"[\s\-_.]", ""))


def intent(query: Column) -> Column:
    """profile-heavy, mark-heavy or neutral."""
    raw = F.trim(query)
    c = compacted(raw)
    family = c.rlike(rf"^(?:{FAMILIES})(?:\d|$|[x×*])") | c.rlike(r"^u[bc]\d")
    angle = c.startswith("l") & (F.length(c) >= 4) & c.rlike(r"\d") & (raw.rlike("(?i)[x×*]") | c.rlike(r"^l\d+x"))
    profile = (F.length(c) >= 3) & (family | angle)
    mark = ~raw.rlike(r"\s") & F.length(c).between(2, 24) & c.rlike("^[a-z0-9]+$") & c.rlike(r"\d") & c.rlike("[a-z]")
    return F.when(raw == "", "neutral").when(profile, "profile-heavy").when(mark, "mark-heavy").otherwise("neutral")


def with_queries(rows: DataFrame, queries: list[str]) -> DataFrame:
    """Every row with every query of a stated list: a generator over literals, not a join. Rows are dealt to all tasks."""
    return dealt(rows).withColumn("raw_query", F.explode(F.array(*map(F.lit, queries)))).withColumn("query", normalized(F.col("raw_query"))).where("query <> ''")


def title_rank(field: Column, query: Column) -> Column:
    """0 for the whole field, 0.01 for its beginning, 1 and more inside it after a boundary, else null."""
    f = normalized(field)
    quoted = F.concat(F.lit(r"(^|[^a-z0-9])\Q"), query, F.lit(r"\E"))
    at = F.regexp_instr(f, quoted)
    return F.when(f == query, 0.0).when(f.startswith(query), 0.01).when(at > 0, 1 + (at - 1) / 10000)


def best_title_rank(fields: list[Column], query: Column) -> Column:
    return F.array_min(F.array(*(title_rank(f, query) for f in fields)))


def contains_rank(text: Column, query: Column) -> Column:
    at = F.instr(text, query)
    return F.when(at == 1, 0.0).when(at > 1, 1 + (at - 1) / 10000)


def profile_rank(text: Column, query: Column) -> Column:
    """Rank in the normalised text, else in the compacted one."""
    c = compacted(query)
    return F.coalesce(contains_rank(text, query), F.when(F.length(c) >= 2, contains_rank(compacted(text), c)))


def ids(row: str = "express_id") -> list[Column]:
    return [F.concat(F.lit("#"), F.col(row).cast("string")), F.col(row).cast("string")]


def assembly_hits(assemblies: DataFrame, queries: list[str]) -> DataFrame:
    rows = with_columns(with_columns(assemblies, "mark", "position_code", "name", "tag"), "express_id", kind="long")
    fields = [present(c) for c in ("mark", "position_code", "name", "tag")] + ids()
    hits = with_queries(rows, queries).withColumn("rank", best_title_rank(fields, F.col("query")))
    return _hits(hits, "assembly", "assembly_id")


def bolt_hits(bolts: DataFrame, queries: list[str]) -> DataFrame:
    rows = with_columns(with_columns(bolts, "bolt_name", "name", "tag"), "express_id", kind="long")
    hits = with_queries(rows, queries).withColumn("rank", best_title_rank([present(c) for c in ("bolt_name", "name", "tag")] + ids(), F.col("query")))
    return _hits(hits, "bolt", "bolt_id")


def part_hits(parts: DataFrame, queries: list[str]) -> DataFrame:
    """By titles; profile-like queries also look into profile and material."""
    rows = with_columns(with_columns(parts, "mark", "tag", "name", "profile", "material"), "express_id", kind="long")
    titles = [part_label(), present("mark"), present("name"), present("tag"), *ids()]
    q = F.col("query")
    second = F.coalesce(present("profile"), present("material")).isNotNull()
    text = normalized(F.concat_ws(" ", *titles, present("profile"), present("material")))
    rank = best_title_rank(titles, q)
    both = F.least(rank, F.when(second & (intent(F.col("raw_query")) == "profile-heavy"), profile_rank(text, q)))
    return _hits(with_queries(rows, queries).withColumn("rank", both), "part", "part_id")


def profile_hits(profiles: DataFrame, queries: list[str]) -> DataFrame:
    """profiles: profile_key, profile."""
    hits = with_queries(profiles, queries).withColumn("rank", profile_rank(normalized(F.col("profile")), F.col("query")))
    return _hits(hits, "profile", "profile_key")


def _hits(rows: DataFrame, kind: str, key: str) -> DataFrame:
    found = rows.where("rank IS NOT NULL").select(F.col("query"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), "rank")
    if kind not in MOST:
        return found
    # a top-k report: the rank function keeps at most k rows a task and query before any shuffle
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "id"))
    return found.withColumn("place", place).where(F.col("place") <= MOST[kind]).drop("place")


def merged_parts(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """Part hits by identity: best rank, number of members, summed weight."""
    rows = parts.select(F.col("part_id").cast("string").alias("id"), part_identity_of(parts).alias("identity"), number_or_null("weight").alias("w"))
    return hits.join(rows, "id").groupBy("query", "identity").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("members"), F.sum("w").alias("weight"))


def part_identity_of(parts: DataFrame) -> Column:
    missing = [c for c in ("mark", "tag", "name", "profile", "express_id") if c not in parts.columns]
    if missing:
        raise ValueError(f"parts lack {missing}")
    return part_identity()


def merged_bolts(hits: DataFrame, bolts: DataFrame) -> DataFrame:
    """Bolt hits by name and standard: best rank, summed quantity with missing ones as 1."""
    rows = with_columns(bolts, "bolt_name", "name", "tag", "standard")
    key = F.concat_ws("|", F.lower(F.coalesce(present("bolt_name"), present("name"), present("tag"))), F.coalesce(F.lower(present("standard")), F.lit("")))
    rows = rows.select(F.col("bolt_id").cast("string").alias("id"), key.alias("bolt_key"), F.coalesce(number_or_null("quantity"), F.lit(1.0)).alias("q"))
    return hits.join(rows, "id").groupBy("query", "bolt_key").agg(F.min("rank").alias("rank"), F.sum("q").alias("quantity"))


def merged_assemblies(hits: DataFrame, assemblies: DataFrame, members: DataFrame) -> DataFrame:
    """Assembly hits by label: best rank, summed weight, number of members of all instances."""
    counts = members.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("n"))
    label = F.lower(F.coalesce(present("mark"), F.col("assembly_id").cast("string")))
    rows = assemblies.join(counts, "assembly_id", "left").select(F.col("assembly_id").cast("string").alias("id"), label.alias("assembly_key"), number_or_null("weight").alias("w"), "n")
    return hits.join(rows, "id").groupBy("query", "assembly_key").agg(F.min("rank").alias("rank"), F.sum("w").alias("weight"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


def section_order(hits: DataFrame) -> DataFrame:
    """Adds the place of each hit's section for its query's intent."""
    kinds = F.create_map(*(x for k, v in SECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return hits.withColumn("section", F.array_position(kinds[intent(F.col("query"))], F.col("kind")).cast("int"))
