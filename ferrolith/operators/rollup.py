"""Bills of material: labels, identities and grouped totals of part, bolt and assembly rows.

Part rows have model-wide columns part_id, mark, tag, name, profile, material, quantity, weight; bolt rows bolt_id,
bolt_name, name, standard, length, diameter, quantity; assembly rows assembly_id, mark, position_code, name, weight,
seq. Columns that a source lacks are added by `with_columns`. "First" is always the smallest seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the label of parts and profiles without a name.
UNNAMED = "ללא שם"
#: Fixed value: the label of elements without an assembly mark.
UNMARKED = "ללא סימון"
DASH = "—"


def with_columns(df: DataFrame, *names: str, kind: str = "string") -> DataFrame:
    """Adds missing columns as nulls."""
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


def present(column: str | Column) -> Column:
    """Trimmed text; null when nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def number_or_null(column: str | Column) -> Column:
    """NaN counts as missing."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(c), c)


def natural_key(column: str | Column) -> Column:
    """Case-insensitive sort key in which digit runs compare as numbers (runs of up to 20 digits)."""
    c = F.lower(F.col(column) if isinstance(column, str) else column)
    padded = F.regexp_replace(c, r"(\d+)", r"00000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", r"$1")


def four_places(column: Column) -> Column:
    """Identity text of a measure: four decimals, empty when missing."""
    x = number_or_null(column)
    return F.when(x.isNull(), "").otherwise(F.format_string("%.4f", x))


def folded(column: str) -> Column:
    return F.coalesce(F.lower(present(column)), F.lit(""))


def half_up(column: Column) -> Column:
    return F.floor(column + 0.5).cast("long")


def contribution(quantity: Column) -> Column:
    """Rounded half up when positive, else 1."""
    return F.when(quantity > 0, half_up(quantity)).otherwise(F.lit(1)).cast("long")


def assembly_group_key() -> Column:
    """Mark, else position code, else name, each folded and prefixed; else the id."""
    named = [F.concat(F.lit(p), F.lower(present(c))) for p, c in (("m:", "mark"), ("p:", "position_code"), ("n:", "name"))]
    return F.coalesce(*named, F.concat(F.lit("id:"), F.col("assembly_id").cast("string")))


def assembly_label() -> Column:
    number = F.concat(F.lit("#"), F.col("express_id").cast("string"))
    return F.coalesce(present("mark"), present("position_code"), present("name"), number, F.col("assembly_id").cast("string"))


def assembly_rollup(assemblies: DataFrame) -> DataFrame:
    """One row a group key: first label, number of instances, weight (null when no instance has one)."""
    rows = with_columns(with_columns(assemblies, "position_code", "name"), "express_id", kind="long")
    rows = rows.select(assembly_group_key().alias("group_key"), assembly_label().alias("label"), number_or_null("weight").alias("w"), "seq", "assembly_id")
    return rows.groupBy("group_key").agg(
        F.min_by("label", "seq").alias("label"), F.count(F.lit(1)).alias("quantity"), F.sum("w").alias("weight")
    )


def assembly_instances(assemblies: DataFrame) -> DataFrame:
    """(group_key, assembly_id): the instances of every group as rows, since one group can be a third of a model."""
    return with_columns(assemblies, "position_code", "name").select(assembly_group_key().alias("group_key"), "assembly_id")


def occurrence_counts(assemblies: DataFrame) -> DataFrame:
    """Every assembly with the size of its group. Sizes are summed first, so one frequent mark is no hot window."""
    rows = with_columns(assemblies, "position_code", "name").withColumn("group_key", assembly_group_key())
    return rows.join(rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("occurrences")), "group_key")


def preferred_assembly(candidates: DataFrame, pick: str = "part_id") -> DataFrame:
    """Of the assemblies that hold a picked part, the one with the best score (n_parts, n_bolts, labels), first wins."""
    rows = with_columns(candidates, "position_code")
    score = F.col("n_parts") * 100_000 + F.col("n_bolts") * 50 + F.when(present("mark").isNotNull(), 5_000).otherwise(0) + F.when(present("position_code").isNotNull(), 500).otherwise(0)
    best = F.max_by(F.struct("assembly_id", score.alias("score")), F.struct(score.alias("s"), (-F.col("seq")).alias("first")))
    return rows.groupBy(pick).agg(best.alias("b")).select(pick, "b.assembly_id", "b.score")


def generated_tag(text: Column) -> Column:
    """Tags that are only an id of 24 hexadecimal digits or more."""
    core = F.regexp_replace(F.regexp_replace(text, "(?i)^ID", ""), "[-{}]", "")
    return (F.length(text) >= 24) & core.rlike("^[0-9a-fA-F]{24,}$")


def part_label() -> Column:
    number = F.concat(F.lit("#"), F.format_number(F.col("express_id"), 0))
    tag = present("tag")
    return F.coalesce(present("mark"), F.when(~generated_tag(tag), tag), number, F.lit(DASH))


def part_name_label() -> Column:
    n = present("name")
    return F.when(n.isNull() | (F.lower(n) == "unnamed"), UNNAMED).otherwise(n)


def profile_label(column: str = "profile") -> Column:
    """The profile text, unless it is missing, a placeholder or a bare number."""
    p = present(column)
    number = F.regexp_replace(F.regexp_replace(p, ",", "."), "[  ]", "").rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")
    return F.when(p.isNull() | number | F.lower(p).isin("unnamed", "n/a", "-"), UNNAMED).otherwise(p)


def _parts(parts: DataFrame) -> DataFrame:
    rows = with_columns(with_columns(parts, "mark", "tag", "name", "profile", "material"), "express_id", kind="long")
    return rows if "seq" in rows.columns else rows.withColumn("seq", F.struct(*(c for c in parts.columns)))


def part_identity() -> Column:
    return F.concat_ws("|", part_label(), folded("profile"), folded("name"), four_places(F.col("weight")))


def part_identity_rollup(parts: DataFrame, *within: str) -> DataFrame:
    """One row for identical parts (mark, profile, name, weight to four decimals), per columns in within.

    The quantity is the number of rows; a single row gives its own quantity, rounded half up, or 1.
    """
    rows = _parts(parts).select(*within, part_identity().alias("identity"), part_label().alias("mark"), profile_label().alias("profile"), number_or_null("quantity").alias("q"), number_or_null("weight").alias("w"), "seq")
    n = F.count(F.lit(1))
    return rows.groupBy(*within, "identity").agg(
        F.min_by("mark", "seq").alias("mark"), F.min_by("profile", "seq").alias("profile"), n.alias("n_rows"),
        F.when(n > 1, n).otherwise(F.coalesce(half_up(F.min("q")), F.lit(1))).cast("long").alias("quantity"), F.sum("w").alias("weight"),
    )


def identity_counts(parts: DataFrame) -> DataFrame:
    """Every part with the number of identical parts in all models; counts are made before the join."""
    rows = _parts(parts).withColumn("identity", part_identity())
    return rows.join(rows.groupBy("identity").agg(F.count(F.lit(1)).alias("identical")), "identity").drop("seq")


def profile_rollup(parts: DataFrame, *within: str) -> DataFrame:
    """Parts by profile label without regard to case: first label, quantity, weight (null when no row has one)."""
    rows = _parts(parts).select(*within, profile_label().alias("label"), number_or_null("quantity").alias("q"), number_or_null("weight").alias("w"), "seq")
    return rows.groupBy(*within, F.lower("label").alias("profile_key")).agg(
        F.min_by("label", "seq").alias("profile"), F.count(F.lit(1)).alias("n_rows"), F.sum(contribution(F.col("q"))).alias("quantity"), F.sum("w").alias("weight")
    )


def bolt_rollup(bolts: DataFrame) -> DataFrame:
    """Bolts of one kind (name, length, standard, diameter): rows and summed quantity, a missing one counting 1."""
    rows = with_columns(bolts, "bolt_name", "name", "standard")
    key = F.concat_ws("|", F.coalesce(F.lower(present("bolt_name")), folded("name")), four_places(F.col("length")), folded("standard"), four_places(F.col("diameter")))
    q = number_or_null("quantity")
    return rows.groupBy(key.alias("bolt_key")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(q > 0, q).otherwise(1.0)).alias("quantity"))


def assembly_part_expand(members: DataFrame, parts: DataFrame, assemblies: DataFrame) -> DataFrame:
    """Parts of an assembly group: summed quantity over all instances, null counting 1."""
    groups = with_columns(assemblies, "position_code", "name").select("assembly_id", assembly_group_key().alias("group_key"))
    rows = members.join(groups, "assembly_id").join(parts.select("part_id", "quantity"), "part_id")
    return rows.groupBy("group_key", "part_id").agg(F.sum(F.coalesce(number_or_null("quantity"), F.lit(1.0))).alias("quantity"))


def unit_weight(total: Column, quantity: Column) -> Column:
    return F.when(quantity > 0, total / quantity)


def selection_weight(weight: Column) -> Column:
    """Null as soon as one weight is missing."""
    return F.when(F.count(F.lit(1)) == F.count(weight), F.sum(weight))


def group_weight(weight: Column) -> Column:
    """Missing weights are skipped; nothing at all is 0."""
    return F.coalesce(F.sum(weight), F.lit(0.0))


def mark_rollup(elements: DataFrame) -> DataFrame:
    """Elements by raw mark: count, weight with missing ones as 0, number of ids."""
    return elements.groupBy(raw_mark().alias("mark")).agg(F.count(F.lit(1)).alias("n_parts"), group_weight(number_or_null("weight")).alias("weight"), F.count("part_id").cast("int").alias("n_ids"))


def raw_mark() -> Column:
    """The mark as given; elements with this mark are the ids of a row of `mark_rollup`."""
    return F.coalesce(F.nullif("mark", F.lit("")), F.lit(UNMARKED))


def substring_filter(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows in which one of the columns holds the query, without regard to case; an empty query keeps all."""
    q = query.strip().lower()
    hit = F.lit(not q)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False))
    return df.where(hit)


def has_real_assemblies(assemblies: DataFrame, *within: str) -> DataFrame:
    """Whether a model has an assembly with a numeric id."""
    return assemblies.groupBy(*within).agg(F.coalesce(F.bool_or(F.col("express_id").isNotNull()), F.lit(False)).alias("has_assemblies"))
