"""Personal data: labelers vote on spans, their reliabilities are estimated, and a classifier learns from the votes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, text_of, written
from .spans import apart, count_of, joined, let, located

KINDS = ["email", "ip", "card", "phone"]
RESULT = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

#: The base patterns, written without repeated groups (their matches are the same), by kind.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?<=[A-Za-z0-9-])(?!\.?[A-Za-z0-9-])",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?[0-9](?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)"
_DOT = r"(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)"
_PART = r"(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\x20\.\x20)[0-9]{1,3}+"
#: Wider patterns for further candidates: spelled-out addresses, IPv6 and defanged IPv4, other separators, no plus.
WIDER = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++{_DOT}[A-Za-z][A-Za-z0-9-]++(?:{_DOT}[A-Za-z]{{2,}}+)?(?![A-Za-z0-9-])",
    "ip": rf"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{{1,4}}+:){{7}}[0-9A-Fa-f]{{1,4}}+|(?:[0-9A-Fa-f]{{1,4}}+:){{1,6}}(?::[0-9A-Fa-f]{{1,4}}+){{1,6}})(?![0-9A-Za-z:])|(?<![0-9.])[0-9]{{1,3}}+{_PART}{_PART}{_PART}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[./_]|[0-9]{4}\x20?[-./_]\x20?|[0-9]{4}\x20\x20)(?:[0-9]{4}\x20?[-./_\x20]\x20?[0-9]{4}\x20?[-./_\x20]\x20?[0-9]{4}|[0-9]{6}\x20?[-./_\x20]\x20?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+A-Za-z])(?:\(?[0-9]{3}\)?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9\x20./()-]{7,17}[0-9])(?![0-9])",
}
#: Usual endings of host names.
ENDINGS = "com org net edu gov mil int info biz name pro io ai app dev me tv cc co us ca mx br ar cl uk ie de at ch fr be nl lu es pt it gr dk no se fi is ee lv lt pl cz sk hu ro bg hr si rs ua ru tr il in cn jp kr tw hk sg au nz za eg ng ke eu asia test example"
#: Gazetteers: endings of host names, first numbers of routable and private addresses, issuer ranges of cards, country
#: calling codes and area codes.
GAZETTEER = {
    "email": rf"(?i)(?:{'|'.join(ENDINGS.split())})$",
    "ip": r"(?i)^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])(?:\.|[^0-9a-f:])|^(?:2[0-9a-f]{3}|3[0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[0-689]|6(?:011|4[4-9]|5|2)|50|5[6-9]|35)",
    "phone": r"^(?:\+|00)(?:1|7|2(?:0|7|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|0[0-9]|9[0-9])|6(?:[0-6]|[7-9][0-9])|8(?:[1246]|[058][0-9])|9(?:[0-58]|[679][0-9]))|^\(?[2-9][0-8][0-9]",
}
#: Words before a span that speak for its kind, in the four languages of the corpus.
CONTEXT = {
    "email": r"(?i)(?:mail|contact|kontakt|contacto|courriel|correo|write|schreib|[eé]cri|escrib|from|von|to|an|reach|reply)[^A-Za-z0-9]*$",
    "ip": r"(?i)(?:ip|ipv4|ipv6|host|server|servidor|serveur|address|adresse|direcci[oó]n|from|via|peer|client|login)[^A-Za-z0-9]*$",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|mastercard|amex|credit|account|konto|pay|number|nummer|no)[^A-Za-z0-9]*$",
    "phone": r"(?i)(?:phone|telefon|t[eé]l[eé]fono?|tel|call|ruf|appel|llam|mobile|handy|cell|fax|number|nummer|no)[^A-Za-z0-9]*$",
}
#: What stands before a span that speaks against it.
AGAINST = r"(?i)(?:version|\bv|sha|hash|token|key|id|isbn|order|part|serial|[=#/_])[^A-Za-z0-9]*$"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """The check digit rule, from the last digit on: every second digit doubled, its digits added."""

    def total(d: Column) -> Column:
        one = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
        return F.aggregate(F.transform(F.split(F.reverse(d), "(?!$)"), one), F.lit(0), lambda a, x: a + x)

    return let(digits(m), total) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """What a match of the base pattern must meet."""
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3) | (F.try_to_number(F.right(p, F.lit(3)), F.lit("999")) > 255))
    n = F.length(digits(m))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def passes_wider(kind: str, m: Column) -> Column:
    """What a match of the wider pattern must meet: the pattern labeler votes against it where it does not."""
    if kind == "ip":
        groups = F.split(m, ":")
        full = (F.size(groups) == 8) & ~m.contains("::") | m.contains("::") & ~m.contains(":::") & (F.size(groups) <= 8) & (F.size(F.split(m, "::")) == 2)
        six = full & m.rlike(GAZETTEER["ip"]) & ~m.rlike("[^:]:$") & ~m.rlike("^:[^:]")
        return F.when(m.contains(":"), six).otherwise(passes("ip", F.regexp_replace(m, "[^0-9]+", ".")))
    if kind == "email":
        # without brackets the first part must look like a name in an address, or "meet at noon dot com" were one
        return m.rlike("[A-Za-z]") & m.rlike(GAZETTEER["email"]) & (m.rlike(r"[(\[{]") | m.rlike(r"^[A-Za-z0-9%+]*[0-9._-]"))
    d = digits(m)
    if kind == "phone":
        return F.when(m.startswith("00"), F.length(d).between(12, 17) & m.rlike(GAZETTEER["phone"])).otherwise(d.rlike("^[2-9][0-8][0-9][2-9][0-9]{6}$"))
    return passes(kind, m)


def votes(kind: str, h: Column, valid: Column) -> Column:
    """1 for, -1 against, 0 abstains: pattern with its checks, gazetteer, context, boundaries, length."""
    yes = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(-1))
    n = F.length(digits(h["m"]))
    context = F.when(h["before"].rlike(CONTEXT[kind]), F.lit(1)).when(h["before"].rlike(AGAINST), F.lit(-1)).otherwise(F.lit(0))
    edge = ~h["before"].rlike(r"[A-Za-z0-9]$") & ~h["after"].rlike(r"^[A-Za-z0-9]")
    plausible = {"email": F.length(h["m"]) <= 64, "ip": F.length(h["m"]) >= 7, "card": n.isin(14, 15, 16, 19), "phone": n.between(10, 15)}[kind]
    return F.array(yes(valid), yes(h["m"].rlike(GAZETTEER[kind])), context, yes(edge), yes(plausible))


def features(h: Column, valid: Column) -> Column:
    """What the classifier reads, each 0 or 1: whether the checks of the kind are met, and surface traits."""
    return F.array(*(c.cast("int") for c in (
        valid,
        h["before"].rlike(r"[\x20\n(,;:]$") | (h["before"] == ""), h["after"].rlike(r"^[\x20\n),;.:]") | (h["after"] == ""),
        h["m"].rlike("[A-Za-z]"), h["m"].rlike(r"[\x20-]"), h["m"].rlike("[()]"), F.length(h["m"]) >= 16, h["before"].rlike("[0-9]"), h["m"].rlike(r"([0-9])\1\1\1"),
    )))


def candidates(text: Column) -> Column:
    """array<struct<kind, s, e, base, votes, features>> of all matches of base and wider patterns."""

    def judged(kind: str, base: bool):
        def one(h: Column) -> Column:
            ok = passes(kind, h["m"]) if base else passes_wider(kind, h["m"])
            kept = lambda b: b & F.lit(base)
            return let(ok, lambda b: F.struct(F.lit(kind).alias("kind"), h["s"].alias("s"), h["e"].alias("e"), kept(b).alias("base"), votes(kind, h, b).alias("votes"), features(h, b).alias("features")))

        return one

    guards = {"email": text.contains("@"), "phone": text.contains("+")}
    every = [F.transform(located(text, BASE[k], guards.get(k)), judged(k, True)) for k in KINDS]
    some = lambda *parts: reduce(lambda a, b: a | b, (text.contains(p) for p in parts))
    wide = {"email": some("at)", "at]", "at}", "at )", "at ]", "at }", "AT)", "AT]", " dot ", " DOT "), "ip": some(":", "[.]", "(.)", "[dot]", "(dot)", " . ")}
    every += [F.transform(located(text, WIDER[k], wide.get(k)), judged(k, False)) for k in KINDS]
    return F.concat(*every)


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over counted vote patterns: each labeler has a rate of right votes on true and on
    false spans. Gives the probability of a true span for each pattern."""
    width = len(patterns[0][0])
    weight = sum(c for _, c in patterns)
    right = [[0.8, 0.7] for _ in range(width)]  # P(vote for | true), P(vote against | false), of votes that are cast
    prior = 0.5
    post = {}
    for _ in range(rounds):
        for p, _ in patterns:
            up, down = math.log(prior), math.log(1 - prior)
            for v, (t, f) in zip(p, right):
                if v:
                    up += math.log(t if v > 0 else 1 - t)
                    down += math.log(1 - f if v > 0 else f)
            post[p] = 1 / (1 + math.exp(min(50.0, down - up)))
        prior = min(0.99, max(0.01, sum(post[p] * c for p, c in patterns) / weight))
        for i in range(width):
            cast = [(p[i] > 0, post[p], c) for p, c in patterns if p[i]]
            true, false = sum(q * c for _, q, c in cast), sum((1 - q) * c for _, q, c in cast)
            right[i] = [
                min(0.99, max(0.51, (sum(q * c for v, q, c in cast if v) + 8) / (true + 10))),
                min(0.99, max(0.51, (sum((1 - q) * c for v, q, c in cast if not v) + 7) / (false + 10))),
            ]
    return post


def classifier(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Logistic regression on counted feature patterns (features, probability of a true span, count); bias last."""
    width, total = len(rows[0][0]), sum(c for *_, c in rows)
    w = [0.0] * (width + 1)
    for _ in range(rounds):
        grad = [ridge * x for x in w[:-1]] + [0.0]
        for x, q, c in rows:
            z = w[-1] + sum(a * b for a, b in zip(w, x))
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - q) * c / total
            for i, v in enumerate(x):
                grad[i] += d * v
            grad[-1] += d
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


def learned(found: DataFrame) -> dict[str, list[float]]:
    """Weights of the span classifier by kind. Only counts of vote and feature patterns come to the driver: at most
    3 ** 5 * 2 ** 9 a kind, whatever the size of the corpus."""
    spans = found.select(F.explode("__spans").alias("x")).groupBy("x.kind", "x.votes", "x.features").count().collect()
    out = {}
    for kind in KINDS:
        mine = [(tuple(r["votes"]), tuple(r["features"]), float(r["count"])) for r in spans if r["kind"] == kind]
        if mine:
            merged: dict[tuple[int, ...], float] = {}
            for v, _, c in mine:
                merged[v] = merged.get(v, 0) + c
            post = reliabilities(sorted(merged.items()))
            out[kind] = classifier([(f, post[v], c) for v, f, c in sorted(mine)])
    return out


def find_pii(df: DataFrame, text_col: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Adds counts of base spans, the hash of their places, and all spans to every row.

    All candidate spans of base and wider patterns are found in one pass, with the votes of five labelers (pattern,
    gazetteer, context, boundaries, length). EM over the counted vote patterns estimates how far each labeler can
    be trusted, and a logistic classifier over surface traits is trained on the resulting probabilities. Base spans
    always stay; a further candidate is added where the checks of its kind are met (a card number's check digit), the
    classifier gives at least the threshold, and no base span of its kind overlaps it. The pass is written once as a table of spans with the columns named in keep (all: None).

    Defined cases: null and empty texts have no spans; very long texts are searched whole; repeated rows get equal
    results; an empty table gives an empty result. Input columns named like a result column are replaced by it.
    """
    carried = Carried(df.select(*(df.columns if keep is None else keep)))
    found = written(df.select(*carried.hide(df), candidates(text_of(text_col)).alias("__spans")), "pii")
    weights = learned(found)
    spans = F.col("__spans")
    base = F.filter(spans, lambda x: x["base"])

    def probable(x: Column) -> Column:
        score = F.lit(None).cast("double")
        for kind, w in weights.items():
            z = F.lit(w[-1]) + sum((x["features"][i] * F.lit(v) for i, v in enumerate(w[:-1])), F.lit(0.0))
            score = F.when(x["kind"] == kind, 1 / (1 + F.exp(-z))).otherwise(score)
        return score >= threshold

    extra = apart(F.filter(spans, lambda x: ~x["base"] & (x["features"][0] == 1) & probable(x)), base, same_kind=True)
    rows = found.withColumn("__base", base).withColumn("__extra", extra)
    rows = rows.withColumn("__extra", F.array_distinct(F.transform("__extra", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))))
    slim = F.transform("__base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return rows.select(
        *carried.show(RESULT), *(count_of(F.col("__base"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("__base"), KINDS).cast("binary"), 256).alias("base_sha256"), joined(F.concat(slim, F.col("__extra")), KINDS).alias("spans"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_pii(docs, keep=["doc_id"])
