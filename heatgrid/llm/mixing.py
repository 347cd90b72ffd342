"""Document rates that bring soft domains to target token totals, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.llm.common import documents, words
from heatgrid.session import cut_lineage

SAMPLE = 4000  # labelled documents of a domain that the classifier is fitted on, at most; those with the smallest hashes
BUCKETS = 1024  # hashed words of the classifier
EVIDENCE = 32.0  # words that a document's words weigh as much as, at most
ROUNDS = 25
TOLERANCE = 1e-7  # of the target totals
#: Target shares of the tokens, and the tokens asked for as a part of all: as many as there are, so that documents of a
#: domain with too few tokens repeat and those of others are drawn.
SHARES = {"good": 0.80, "poor": 0.15, "toxic": 0.05}
BUDGET = 1.0


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels (doc_id, quality, toxic): toxic, else good or poor by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), domain.alias("domain"))


@dataclass
class Classifier:
    """Naive Bayes over hashed words: log prior and, for each bucket, log probability of every domain."""

    names: list[str]
    prior: np.ndarray
    table: np.ndarray  # domains x buckets


def _buckets(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit(docs: DataFrame, labelled: DataFrame, names: list[str]) -> Classifier:
    """Fits the domains to labelled documents (doc_id, domain). A document with several labels counts under the smallest;
    domains that are not asked for, null ids and null labels do not count. A domain without documents has a prior near 0."""
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(names)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = cut_lineage(known)
    prior = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("doc_id").alias("n")).collect()}
    picks = [known.where(F.col("domain") == n).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for n in names]
    sample = picks[0]
    for p in picks[1:]:
        sample = sample.union(p)
    # At most SAMPLE rows for each domain: a bound that lets them go to every task.
    met = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(cut_lineage(sample)), "doc_id")
    seen = met.select("domain", F.explode(_buckets(F.col("text"))).alias("bucket")).groupBy("domain", "bucket").agg(F.count("bucket").alias("n"))
    table = np.full((len(names), BUCKETS), 0.5)
    for r in seen.collect():  # domains x buckets at most
        table[names.index(r.domain), r.bucket] += r.n
    share = np.array([prior.get(n, 0) + 0.5 for n in names])
    return Classifier(names, np.log(share / share.sum()), np.log(table / table.sum(axis=1, keepdims=True)))


def posteriors(docs: DataFrame, by: Classifier) -> DataFrame:
    """(row, n_tokens, p): row holds the columns of ``docs``; n_tokens its words; p the domains' posterior.

    The words' mean log probability counts for EVIDENCE words at most, so memberships stay soft; without words the prior
    stands.
    """
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    df = df.select("row", _buckets(F.col("row.text")).alias("b"))
    total = lambda w: F.aggregate("b", F.lit(0.0), lambda a, i: a + F.get(F.array(*[F.lit(float(x)) for x in w]), i))
    sums = [total(by.table[k] - by.table[0]) for k in range(1, len(by.names))]
    df = df.select("row", F.size("b").cast("bigint").alias("n_tokens"), F.array(F.lit(0.0), *sums).alias("s"))
    weight = F.least(F.col("n_tokens").cast("double"), F.lit(EVIDENCE)) / F.greatest(F.col("n_tokens"), F.lit(1))
    logit = [F.col("s")[k] * weight + F.lit(float(by.prior[k])) for k in range(len(by.names))]
    df = df.select("row", "n_tokens", F.array(*logit).alias("z"))
    df = df.select("row", "n_tokens", "z", F.array_max("z").alias("m"))
    df = df.select("row", "n_tokens", F.transform("z", lambda z: F.exp(z - F.col("m"))).alias("e"))
    df = df.select("row", "n_tokens", "e", F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("t"))
    return df.select("row", "n_tokens", F.transform("e", lambda x: x / F.col("t")).alias("p"))


def rate(steps: list[np.ndarray], start: float) -> Column:
    """A document's rate after the gradient steps taken so far, each kept nonnegative."""
    r = F.lit(float(start))
    for step in steps:
        down = sum((F.col("p")[k] * F.lit(float(x)) for k, x in enumerate(step[1:], 1)), F.col("p")[0] * F.lit(float(step[0])))
        r = F.greatest(F.lit(0.0), r - down)
    return r


@dataclass
class Fit:
    """A classifier, the steps that lead to the rates, and how they end.

    budget: tokens asked for as a part of all; totals and targets by domain, in tokens; converged: whether every total is
    within TOLERANCE of its target. Where no rates reach the targets, it is not, and the totals are the nearest.
    """

    by: Classifier
    steps: list[np.ndarray]
    budget: float
    totals: np.ndarray
    targets: np.ndarray
    converged: bool

    @property
    def rate(self) -> Column:
        return rate(self.steps, self.budget)


def fit_rates(soft: DataFrame, targets: np.ndarray, start: float) -> tuple[list[np.ndarray], np.ndarray, bool]:
    """Steps of projected-gradient least squares for rates r >= 0 with sum of r * n_tokens * p = targets; the totals they
    reach; whether these are the targets.

    The unknowns are scaled by the square root of the tokens and the residuals by the inverse of their Gram matrix, which
    makes a step of 1 safe; one sum over ``soft`` (n_tokens, p) is taken for each step. Where no rates reach the targets,
    as for a domain without documents, the steps go to the nearest totals.
    """
    k, t, p = len(targets), F.col("n_tokens"), lambda i: F.col("p")[i]
    cells = [F.sum(t * p(i) * p(j)) for i in range(k) for j in range(i, k)]
    flat = [x or 0.0 for x in soft.agg(*[c.alias(f"g{n}") for n, c in enumerate(cells)]).first()]
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = flat
    gram = gram + np.triu(gram, 1).T
    scale = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
    steps: list[np.ndarray] = []
    while True:
        now = soft.agg(*[F.sum(rate(steps, start) * t * p(i)).alias(f"s{i}") for i in range(k)]).first()
        totals = np.array([x or 0.0 for x in now])
        step = scale @ (totals - targets)
        done = bool(np.abs(totals - targets).max() <= TOLERANCE * max(targets.sum(), 1e-300))
        if done or np.abs(step).max() < 1e-12 or len(steps) == ROUNDS:
            return steps, totals, done
        steps.append(step)


def fitted(docs: DataFrame, labelled: DataFrame, shares: dict[str, float] = SHARES, budget: float | None = BUDGET) -> tuple[Fit, DataFrame]:
    """The fit, and the written table (doc_id, n_tokens, p) of all documents.

    A ``budget`` of None is the largest for which no rate exceeds 1, so that no document comes twice. Rates are in
    proportion to the budget: they are fitted for all tokens, and the largest rate of a document with tokens gives it.
    Where a domain is scarce, that is a small part of the corpus.
    """
    names = sorted(shares)
    by = fit(docs, labelled, names)
    soft = cut_lineage(posteriors(docs.select("doc_id", "text"), by).select("row.doc_id", "n_tokens", "p"))
    total = soft.agg(F.sum("n_tokens").alias("n")).first().n or 0
    want = np.array([shares[n] for n in names]) / sum(shares.values()) * total
    start = 1.0 if budget is None else budget
    steps, totals, done = fit_rates(soft, want * start, start)
    if budget is None:
        top = soft.where("n_tokens > 0").agg(F.max(rate(steps, start))).first()[0]
        start = 1.0 / top if top else 1.0
        steps, totals = [s * start for s in steps], totals * start
    return Fit(by, steps, start, totals, want * start, done), soft


def rates(docs: DataFrame, labelled: DataFrame, shares: dict[str, float] = SHARES, budget: float | None = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate) of every row of ``docs`` (doc_id, text, any others).

    ``labelled`` (doc_id, domain) trains the classifier; ``shares`` names the domains and their part of ``budget`` times
    all tokens, see :func:`fitted` for a budget of None. The rates are nonnegative and move as little as the targets need; the
    tokens they are expected to give each domain match the targets as far as rates can, and :class:`Fit` says how far.
    Null and empty texts have no tokens and the prior; rows with a null doc_id and repeated rows have rates of their own.
    An empty table gives no rows.
    """
    found, soft = fitted(docs, labelled, shares, budget)
    return soft.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{n}") for k, n in enumerate(found.by.names)], found.rate.alias("rate"))


def mixed(docs: DataFrame, labelled: DataFrame, shares: dict[str, float] = SHARES, budget: float | None = BUDGET) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says: the whole part, and once more by a draw from its id and text."""
    found, _ = fitted(docs, labelled, shares, budget)
    draw = F.pmod(F.xxhash64("row.doc_id", "row.text", F.lit(6)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    soft = posteriors(docs, found.by).select("row", F.floor(found.rate + draw).cast("int").alias("copies"), F.monotonically_increasing_id().alias("n"))
    return soft.where("copies > 0 AND n >= 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def op6_soft_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return rates(documents(spark, sf), domains(spark.read.parquet(f"{sf}/labels.parquet")))


QUERIES = {"op6_soft_mixing": (op6_soft_mixing, None)}
