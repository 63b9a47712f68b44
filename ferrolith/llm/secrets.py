"""Secret scans: patterns, and a battery of randomness tests on tokens with false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, text_of, written
from .spans import apart, count_of, joined, let, located

KINDS = ["assign", "access", "hex"]
#: What the test battery adds.
RANDOM = "random"
RESULT = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

#: The base patterns by kind.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]{24,}"}
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"

#: Alphabets by encoding, in order of their symbols' values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
}
#: Shares of the letters a to z in English writing, in percent (rounded).
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)
#: What names that people write look like: shares of digits, and of capitals where both cases occur, and how often a
#: word, number or capital begins at a character.
DIGITS, CAPITALS, STARTS = 0.08, 0.08, 0.10
#: Where a word, a number or capitals begin inside a name.
BEGIN = "(?<=[a-z0-9])[A-Z]|(?<=[A-Za-z])[0-9]|(?<=[0-9A-Z])[a-z](?<![A-Z][a-z])"
#: A test that randomness fails at this level shows structure, such as a sequence or a repeated group.
STRUCTURE = 3.0
#: Bins of the negative decimal logarithm of p-values, and classes of token lengths.
BIN, BINS, LENGTHS = 0.125, 400, 12


def writing(kind: str) -> tuple[float, float, int]:
    """Of an alphabet: sums of squares and of cubes of its symbols' shares in written names, and its size."""
    share = {}
    for c in ALPHABETS[kind]:
        letter = LETTERS[ord(c.lower()) - 97] / 100 if c.isalpha() else DIGITS / 10
        both = kind == "base64" and c.isalpha()
        share[c] = letter * (1 - DIGITS if c.isalpha() else 1) * ((CAPITALS if c.isupper() else 1 - CAPITALS) if both else 1)
    total = sum(share.values())
    return sum((s / total) ** 2 for s in share.values()), sum((s / total) ** 3 for s in share.values()), len(share)


def bare(m: Column) -> Column:
    """A token without its symbols beside letters and digits."""
    return F.regexp_replace(m, "[+/_=-]", "")


def encoding(body: Column) -> Column:
    """The narrowest alphabet that the letters and digits of a token fit; null without a digit or a letter, and for
    less than twelve of them."""
    return F.when(
        body.rlike("[0-9]") & body.rlike("[A-Za-z]") & (F.length(body) >= 12),
        F.when(body.rlike("^[0-9a-f]+$"), "hex").when(body.rlike("^[0-9A-F]+$"), "HEX").when(body.rlike("^[A-Z2-7]+$"), "base32")
        .when(body.rlike("^[0-9A-Z]+$"), "upper").when(body.rlike("^[0-9a-z]+$"), "lower").otherwise("base64"),
    )


def battery(m: Column) -> Column:
    """How surely a token is random, as the negative decimal logarithm of a p-value; null where no encoding fits.

    The null hypothesis is that a person wrote the token. Its alphabet's chi-squared statistic for uniform symbols is
    a linear function of the number of ordered pairs of equal symbols, whose mean and variance under the shares of
    written symbols are known; few such pairs speak against writing. So do many runs: begins of words, numbers and
    capitals, which are binomial under writing (bounded by Chernoff's inequality). Fisher's rule combines both. Runs
    above and below the middle of the alphabet and the serial correlation of neighbours test randomness itself: a
    token that fails one of them has a structure of another kind and no small p-value. Symbols beside letters and
    digits are left out.
    """
    by_kind = lambda value: F.create_map(*(x for k in ALPHABETS for x in (F.lit(k), value(k))))

    def read(body: Column) -> Column:
        return let(encoding(body), lambda kind: F.when(kind.isNotNull(), let(by_kind(lambda k: F.lit(ALPHABETS[k]))[kind], lambda alphabet: known(body, kind, alphabet))))

    def known(body: Column, kind: Column, alphabet: Column) -> Column:
        values = F.transform(F.split(body, "(?!$)"), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        constants = by_kind(lambda k: F.array(*(F.lit(float(v)) for v in writing(k))))[kind]
        return let(values, lambda v: let(constants, lambda c: let(F.regexp_count(body, F.lit(BEGIN)), lambda begins: tested(v, c, begins))))

    def tested(v: Column, c: Column, begins: Column) -> Column:
        n, q2, q3, k = F.size(v).cast("double"), c[0], c[1], c[2]
        counts = F.transform(F.array_distinct(v), lambda s: F.size(F.filter(v, lambda x: x == s)).cast("double"))
        pairs = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * (x - 1))
        spread = 4 * n * (n - 1) * (n - 2) * (q3 - q2 * q2) + 2 * n * (n - 1) * (q2 - q2 * q2)
        often = F.least(begins / (n - 1), F.lit(0.999))

        def surely(uneven: Column) -> Column:
            surprise = (n - 1) * (often * F.log(F.greatest(often, F.lit(1e-9)) / STARTS) + (1 - often) * F.log((1 - often) / (1 - STARTS)))
            # natural logarithms of both p-values, 0 where a test speaks for writing
            both = F.when(uneven < 0, -uneven * uneven / 2 - F.log(F.lit(2.0))).otherwise(F.lit(0.0)) - F.when(often > STARTS, surprise).otherwise(F.lit(0.0))
            return -(both + F.log(1 - both)) / F.log(F.lit(10.0))

        return F.when(structured(v, n, k), F.lit(0.0)).otherwise(let((pairs - n * (n - 1) * q2) / F.sqrt(spread), surely))

    def structured(v: Column, n: Column, k: Column) -> Column:
        high = F.transform(v, lambda x: F.when(x >= k / 2, 1).otherwise(0))

        def runs(h: Column) -> Column:
            n1 = F.aggregate(h, F.lit(0), lambda a, x: a + x).cast("double")
            seen = F.aggregate(h, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("r")), lambda a, x: F.struct(x.alias("last"), (a["r"] + F.when(a["last"] == x, 0).otherwise(1)).alias("r")))["r"]
            expected = 2 * n1 * (n - n1) / n + 1
            spread = (expected - 1) * (expected - 2) / (n - 1)
            return F.abs(seen - expected) > STRUCTURE * F.sqrt(F.greatest(spread, F.lit(0.0)))

        def serial(mu: Column) -> Column:
            zero = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("c"), F.lit(0.0).alias("v"))
            got = lambda a, x: F.struct((x - mu).alias("last"), (a["c"] + F.coalesce(a["last"], F.lit(0.0)) * (x - mu)).alias("c"), (a["v"] + (x - mu) * (x - mu)).alias("v"))
            return F.aggregate(v, zero, got, lambda a: F.abs(a["c"]) * F.sqrt(n) >= STRUCTURE * a["v"])

        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        return let(high, runs) | let(mean, serial)

    return let(bare(m), read)


def binned(score: Column) -> Column:
    return F.least(F.floor(score / BIN), F.lit(BINS)).cast("int")


def length_class(size: Column) -> Column:
    return F.least(F.floor(size / 4) - 4, F.lit(LENGTHS)).cast("int")


def candidates(text: Column) -> Column:
    """array<struct<kind, s, e, size, bin>>: base spans, and the tokens of an encoding with their test results."""
    none = F.lit(0)
    plain = lambda kind, ok: lambda h: F.struct(F.lit(kind).alias("kind"), h["s"].alias("s"), h["e"].alias("e"), ok(h["m"]).alias("ok"), none.alias("size"), none.alias("bin"))
    checks = {
        "assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6,
        "access": lambda m: F.length(m) >= 20,
        "hex": lambda m: F.length(m) >= 24,
    }

    def token(h: Column) -> Column:
        return let(battery(h["m"]), lambda p: F.struct(F.lit(RANDOM).alias("kind"), h["s"].alias("s"), h["e"].alias("e"), p.isNotNull().alias("ok"), length_class(F.length(h["m"])).alias("size"), binned(p).alias("bin")))

    every = [F.transform(located(text, BASE[k]), plain(k, checks[k])) for k in KINDS]
    every.append(F.transform(located(text, TOKEN), token))
    return F.filter(F.concat(*every), lambda x: x["ok"])


def thresholds(found: DataFrame, rate: float) -> dict[int, int]:
    """The smallest bin by length class that counts as random. Only counts by class and bin come to the driver, at
    most 13 * 401."""
    rows = found.select(F.explode("__spans").alias("x")).where(F.col("x.kind") == RANDOM).groupBy("x.size", "x.bin").count().collect()
    return limits_of([(r["size"], r["bin"], r["count"]) for r in rows], rate)


def limits_of(rows: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """thresholds() of (size, bin, count), by Benjamini and Hochberg's rule in each length class: the largest p-value
    (as a bin's upper end) at which the tokens up to it number at least p * all / rate."""
    out = {}
    for size in {r[0] for r in rows}:
        mine = sorted(((b, n) for s, b, n in rows if s == size), reverse=True)
        everything, so_far = sum(n for _, n in mine), 0
        for b, n in mine:
            so_far += n
            if 10 ** (-b * BIN) * everything <= rate * so_far:
                out[size] = b
    return out


def find_secrets(df: DataFrame, text_col: str = "text", rate: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """Adds counts of base spans, the hash of their places, and all spans to every row.

    Beside the base patterns every token of 16 or more symbols that mixes letters and digits is read in the narrowest
    alphabet it fits, and tested against what written names look like by uniform symbols, runs and serial correlation
    (`battery`). The tests know their distributions, so they work alike in a corpus of any size; in each length class
    a false-discovery rate bounds the expected share of written names among the tokens that are added. A token that
    overlaps a base span is not added. The pass over the texts is written once as a table of spans with the columns
    named in keep (all: None).

    Defined cases: null and empty texts have no spans; very long texts are searched whole; repeated rows get equal
    results; an empty table gives an empty result. Input columns named like a result column are replaced by it.
    """
    carried = Carried(df.select(*(df.columns if keep is None else keep)))
    found = written(df.select(*carried.hide(df), candidates(text_of(text_col)).alias("__spans")), "secrets")
    limits = thresholds(found, rate)
    spans = F.col("__spans")
    base = F.filter(spans, lambda x: x["kind"] != RANDOM)
    limit = lambda x: F.create_map(*(F.lit(v) for pair in limits.items() for v in pair))[x["size"]] if limits else F.lit(None).cast("int")
    random = F.filter(spans, lambda x: (x["kind"] == RANDOM) & F.coalesce(x["bin"] >= limit(x), F.lit(False)))
    rows = found.withColumn("__base", base).withColumn("__extra", random)
    return rows.select(
        *carried.show(RESULT), *(count_of(F.col("__base"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("__base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("__base", apart(F.col("__extra"), F.col("__base"), same_kind=False)), [*KINDS, RANDOM]).alias("spans"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_secrets(docs, keep=["doc_id"])
