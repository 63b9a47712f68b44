"""Quality rules: one table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, text_of, words_of

RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
#: Words in a window whose repetition counts.
WINDOW = 8

#: Function words of the four languages of the corpus, lower case.
STOP_WORDS = (
    "the and of to in is it that for was on with as by at be this an are from or not "
    "der die das und zu den von mit sich ist im dem nicht ein eine als auch auf für "
    "le la les des de et un une du en que qui dans par pour au sur il pas ne "
    "el los las y una por con para se del su al lo es no"
).split()

#: The rules: name, numerator, denominator, smallest and largest ratio that passes (None: no bound), and the fewest
#: words a text must have for the rule to apply. Numerators and denominators are names of MEASURES.
THRESHOLDS = (
    ("words", "words", "one", 20, None, 0),
    ("repeated windows", "repeat_words", "words", None, 0.30, 0),
    ("mean word length", "word_chars", "words", 2.0, 14.0, 0),
    ("symbols per word", "symbols", "words", None, 0.30, 0),
    ("upper-case letters", "upper_chars", "word_chars", None, 0.50, 0),
    ("stop words", "stop_words", "words", 0.04, None, 60),
    ("repeated lines", "dup_lines", "lines", None, 0.34, 0),
    ("distinct words", "distinct_words", "words", 0.10, None, 60),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of so many words that the text has at least twice.

    Windows are compared by 64-bit hashes. Only a text with an equal pair sorts its windows; the covered words are
    then added up over the starts of repeated windows, each start adding what the next one does not cover.
    """
    n = F.size(words)
    hashes = F.when(n >= window, F.transform(F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, window)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _sum_of_steps(F.array_sort(_let(pairs, twice)), window)

    def twice(pairs: Column) -> Column:
        like = lambda p, k: F.get(pairs, k)["h"] == p["h"]
        starts = F.transform(pairs, lambda p, k: F.when(like(p, k - 1) | like(p, k + 1), p["i"]))
        return F.filter(starts, lambda i: i.isNotNull())

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(h, covered))).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over a one-element array binds it."""
    return F.transform(F.array(value), body)[0]


def _sum_of_steps(starts: Column, window: int) -> Column:
    step = F.aggregate(
        starts,
        F.struct(F.lit(-window).alias("last"), F.lit(0).alias("sum")),
        lambda acc, s: F.struct(s.alias("last"), (acc["sum"] + F.least(s - acc["last"], F.lit(window))).alias("sum")),
    )
    return step["sum"]


def measured(df: DataFrame, text_col: str) -> DataFrame:
    """Adds __m, a struct of all measures, by built-in functions only."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumn("__words", words_of(text)).withColumn("__lines", lines)
    words = F.col("__words")
    measures = {
        "one": F.lit(1),
        "words": F.size(words),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
        "symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
        "upper_chars": F.length(F.regexp_replace(text, r"\P{Lu}+", "")),
        "stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "distinct_words": F.size(F.array_distinct(words)),
        "lines": F.size("__lines"),
        "dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "repeat_words": repeated_words(words),
    }
    return out.withColumn("__m", F.struct(*(c.cast("long").alias(k) for k, c in measures.items()))).drop("__words", "__lines")


def verdict(thresholds=THRESHOLDS) -> Column:
    """Names of the rules that a row of measures breaks."""
    m = F.col("__m")
    broken = []
    for name, top, bottom, low, high, least in thresholds:
        ratio = m[top] / F.greatest(m[bottom], F.lit(1))
        bad = (F.lit(False) if low is None else ratio < low) | (F.lit(False) if high is None else ratio > high)
        broken.append(F.when(bad & (m["words"] >= least), F.lit(name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def quality_rules(df: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Adds counts, base_failed, kept and broken_rules to every row; a narrow projection without a shuffle.

    Defined cases: a null or empty text has no words and fails on length; very long texts are measured whole;
    repeated rows are judged alike; an empty table gives an empty result. Input columns named like a result column
    are replaced by it.
    """
    carried = Carried(df)
    rows = measured(df.select(*carried.hide(df), F.col(text_col).alias("__text")), "__text")
    m = F.col("__m")
    base = (m["words"] < 20) | (100 * m["repeat_words"] > 30 * m["words"])
    return rows.withColumn("__broken", verdict(thresholds)).select(
        *carried.show([*RESULT, "broken_rules"]),
        m["words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["symbols"].alias("n_symbols"),
        m["dup_lines"].alias("n_dup_lines"), m["repeat_words"].alias("n_repeat_words"),
        base.alias("base_failed"), (~base & (F.size("__broken") == 0)).alias("kept"), F.concat_ws(",", "__broken").alias("broken_rules"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *RESULT)


def _broken_sql(name, top, bottom, low, high, least) -> str:
    ratio = f"{top}::DOUBLE / greatest({bottom}, 1)"
    bounds = [f"{ratio} < {low}::DOUBLE"] * (low is not None) + [f"{ratio} > {high}::DOUBLE"] * (high is not None)
    return f"(words >= {least} AND ({' OR '.join(bounds)}))"


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n
  FROM (SELECT r, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW}))),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM w, range({WINDOW}) t(k) WHERE n > 1 GROUP BY r),
m AS (
  SELECT doc_id, 1 AS one, len(ws) AS words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS upper_chars,
    len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))}], lower(x)))) AS stop_words,
    len(list_distinct(ws)) AS distinct_words, len(ls) AS lines, len(ls) - len(list_distinct(ls)) AS dup_lines, coalesce(c.n, 0) AS repeat_words
  FROM l LEFT JOIN c USING (r))
SELECT doc_id, words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup_lines::BIGINT AS n_dup_lines,
  repeat_words::BIGINT AS n_repeat_words, words < 20 OR 100 * repeat_words > 30 * words AS base_failed,
  NOT (words < 20 OR 100 * repeat_words > 30 * words) AND NOT ({" OR ".join(_broken_sql(*rule) for rule in THRESHOLDS)}) AS kept
FROM m
"""
