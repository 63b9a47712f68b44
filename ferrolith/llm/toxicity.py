"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, text_of

RESULT = ["score", "predicted"]
LETTERS = re.compile(r"[^\W\d_]+")
#: A task forgets the words it has looked up beyond this number.
KNOWN = 200_000
#: Hashed terms are numbers below this.
BUCKETS = 1 << 22


def terms_of(word: str) -> tuple[int, ...]:
    """Hash buckets of a lower-case word: itself and its beginnings of 3, 4 and 5 letters, which stand for stems."""
    crc = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS
    return tuple({crc("=" + word), *(crc(f"{n}{word[:n]}") for n in (3, 4, 5) if len(word) > n)})


def hashed(texts: pd.Series) -> list[np.ndarray]:
    """The distinct term buckets of each text."""
    known: dict[str, tuple[int, ...]] = {}
    out = []
    for text in texts:
        found: set[int] = set()
        for word in set(LETTERS.findall(text.lower())):
            if (got := known.get(word)) is None:
                got = known[word] = terms_of(word)
            found.update(got)
        out.append(np.fromiter(found, np.int32, len(found)))
    return out


@dataclass
class Machine:
    """score = sigmoid(w0 + sum w_i + sum over pairs of <v_i, v_j>) over the selected terms that a text has."""

    buckets: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores before the sigmoid; rows hold positions in buckets."""
        return _forward(*_flat(rows), len(rows), self.w0, self.w, self.v)[0]

    def score(self, texts: pd.Series, known: dict[str, tuple[int, ...]]) -> np.ndarray:
        at = {int(b): i for i, b in enumerate(self.buckets)}
        rows = []
        for text in texts:
            found: set[int] = set()
            for word in set(LETTERS.findall(text.lower())):
                if (got := known.get(word)) is None:
                    got = known[word] = tuple(at[b] for b in terms_of(word) if b in at)
                if got:
                    found.update(got)
            rows.append(np.array(sorted(found), np.int64))
        if len(known) > KNOWN:
            known.clear()
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    cols = np.concatenate(rows).astype(np.int64) if len(rows) and sizes.sum() else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(rows)), sizes), cols


def _forward(at, cols, n, w0, w, v):
    linear = np.bincount(at, weights=w[cols], minlength=n)
    sums = np.stack([np.bincount(at, weights=v[cols, k], minlength=n) for k in range(v.shape[1])], 1)
    squares = np.bincount(at, weights=(v[cols] ** 2).sum(1), minlength=n)
    return w0 + linear + 0.5 * ((sums**2).sum(1) - squares), sums


def train(rows: list[np.ndarray], labels: np.ndarray, terms: int, rank: int = 4, steps: int = 250, rate: float = 0.05, ridge: float = 2e-4, seed: int = 7):
    """Full-batch Adam on the logistic loss with a ridge penalty."""
    n, (at, cols) = len(rows), _flat(rows)
    base = (labels.sum() + 0.5) / (n + 1.0)
    params = [np.array([np.log(base / (1 - base))]), np.zeros(terms), np.random.default_rng(seed).normal(0, 0.05, (terms, rank))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        raw, sums = _forward(at, cols, n, params[0][0], params[1], params[2])
        error = (1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - labels) / n
        each = error[at]
        gv = np.stack([np.bincount(cols, weights=each * (sums[at, k] - params[2][cols, k]), minlength=terms) for k in range(rank)], 1)
        grads = [np.array([error.sum()]), np.bincount(cols, weights=each, minlength=terms) + ridge * params[1], gv + ridge * params[2]]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return params[0][0], params[1], params[2]


def held_out(id_col: str) -> Column:
    """True for the rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, max_terms: int = 2_048) -> Machine:
    """Learns from at most max_rows labelled rows, those with the smallest hashes of their ids, none of them held out.

    Terms are counted by Spark over these rows; the max_terms buckets with the highest chi-squared statistic (20 at
    least, in 3 rows at least) are kept, and only their positions in each sampled row come to the driver.
    Null labels are left out; of several labels of an id the largest counts; without labels every score is 0.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("label"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "__id").select("label", "text")

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "terms": hashed(b["text"])})

    rows = texts.mapInPandas(buckets, "label int, terms array<int>").persist()
    try:
        n, positive = rows.select(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        nothing = Machine(np.zeros(0, np.int64), -30.0, np.zeros(0), np.zeros((0, 1)))
        if not n or not positive:
            return nothing
        a, r, share = F.col("a"), F.col("r"), positive / n
        chi = (a - r * share) ** 2 / (r * share) / (1 - share + 1e-9) / (1 - r / (n + 1.0))
        counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("r"))
        best = counts.where((r >= 3) & (a > r * share) & (chi >= 20)).orderBy(chi.desc(), "term").limit(max_terms).select("term").collect()
        kept = np.array(sorted(x[0] for x in best), np.int64)

        def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [np.flatnonzero(np.isin(kept, t)).astype(np.int32) for t in b["terms"]]
                yield pd.DataFrame({"label": b["label"], "at": found})

        got = rows.mapInPandas(positions, "label int, at array<int>").collect()
    finally:
        rows.unpersist()
    return Machine(kept, *train([np.array(x["at"], np.int64) for x in got], np.array([x["label"] for x in got], float), len(kept)))


def score_toxicity(df: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from the threshold on) to every row; no shuffle.

    Defined cases: null and empty texts are scored as texts without terms; very long texts are read whole; repeated
    rows get equal scores; an empty table gives an empty result. Input columns named like a result column are
    replaced by it.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            yield pd.Series(machine.score(texts, known))

    carried = Carried(df)
    rows = df.select(*carried.hide(df), score(text_of(text_col)).alias("__score"))
    return rows.select(*carried.show(RESULT), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, machine).select("doc_id", held_out("doc_id").alias("held_out"), *RESULT)
