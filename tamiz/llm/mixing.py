"""Mixing to target weights with soft domains: a classifier's posteriors and fitted rates."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tamiz.session import materialize

SCORED = ["tokens", "posterior"]


@dataclass
class DomainModel:
    """Domains by place in ``posterior`` and what computes it."""

    domains: list[str]
    stages: PipelineModel | None

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Adds ``tokens``, the words of the whole text, and ``posterior``, a probability for each domain."""
        docs = docs.drop(*SCORED)
        if self.stages is None:
            posterior = F.array(*[F.lit(1.0 / len(self.domains)) for _ in self.domains])
            return docs.withColumn("tokens", _word_count(F.col(text))).withColumn("posterior", posterior)
        scored = self.stages.transform(_prepared(docs, text))
        kept = docs.columns
        # A domain after the last one that was seen has no place in the model.
        missing = F.array_repeat(F.lit(0.0), len(self.domains) - self.stages.stages[-1].numClasses)
        return scored.select(*kept, "tokens", F.concat(vector_to_array("_mx_probability"), missing).alias("posterior"))


def _word_count(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")
    return F.size(words).cast("long")


def _prepared(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_mx_text", F.coalesce(F.col(text), F.lit(""))).withColumn(
        "tokens", _word_count(F.col("_mx_text"))
    )


def fit_domains(
    docs: DataFrame,
    labels: DataFrame,
    domains: list[str],
    text: str = "text",
    domain: str = "domain",
    key: str = "doc_id",
    most_rows: int = 20_000,
    features: int = 1 << 14,
    ridge: float = 1e-4,
) -> DomainModel:
    """A multinomial logistic regression of the labels' ``domain`` on the text of the same ``key``.

    Inputs are how often words and marks occur (hashed, as a share of the text). The
    fit is on a bounded sample of at most ``most_rows`` labels, those whose key has the
    smallest hash; only they are sent to the texts. Labels of a domain that isn't
    listed, without a text, or with a null key are left out. With fewer than two
    domains among the rows every document gets the same share of each.
    """
    place = F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, float(i))])
    labels = labels.where(F.col(key).isNotNull() & F.col(domain).isin(domains))
    part = min(1.0, 0.9 * most_rows / max(1, labels.count()))
    hashed = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 32))
    chosen = labels.where(hashed < int(part * (1 << 32))).select(key, place[F.col(domain)].alias("_mx_label"))
    # The share takes fewer but for chance, which the order then decides.
    chosen = materialize(chosen.orderBy(F.xxhash64(F.col(key).cast("string")), key, "_mx_label").limit(most_rows))
    rows = docs.where(F.col(text).isNotNull()).select(key, text).join(F.broadcast(chosen), key).select(text, "_mx_label")
    rows = materialize(rows)
    if rows.select("_mx_label").distinct().count() < 2:
        return DomainModel(domains, None)
    stages = Pipeline(
        stages=[
            RegexTokenizer(inputCol="_mx_text", outputCol="_mx_words", pattern=r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+", gaps=False),
            HashingTF(inputCol="_mx_words", outputCol="_mx_counts", numFeatures=features),
            Normalizer(inputCol="_mx_counts", outputCol="_mx_shares", p=2.0),
            LogisticRegression(
                featuresCol="_mx_shares",
                labelCol="_mx_label",
                probabilityCol="_mx_probability",
                rawPredictionCol="_mx_raw",
                predictionCol="_mx_prediction",
                family="multinomial",
                regParam=ridge,
                maxIter=60,
            ),
        ]
    )
    model = stages.fit(_prepared(rows, text))
    return DomainModel(domains, model)


@dataclass
class Rates:
    """Rates as a function of a row's posterior: a pull for each domain, as it was after every round."""

    steps: list[list[float]]
    most: float | None
    wanted: list[float]
    reached: list[float]
    #: Whether wanted is reached within the tolerance, or else the nearest that rates can come to it.
    met: bool = True
    nearest: bool = True

    def moved(self, posterior: str = "posterior") -> Column:
        """One copy and what the domains pull at the posterior's parts."""
        rate = F.lit(1.0)
        for j, pull in enumerate(self.steps[-1] if self.steps else []):
            rate = rate + F.col(posterior)[j] * F.lit(pull)
        return rate

    def column(self, posterior: str = "posterior") -> Column:
        """What is moved, projected into the bounds."""
        if not self.steps:
            return F.lit(1.0)
        rate = F.greatest(F.lit(0.0), self.moved(posterior))
        return rate if self.most is None else F.least(F.lit(self.most), rate)


#: Weight of a rate's distance from one copy against a domain's squared miss: little, but
#: more for a domain that can't reach its target, or its pull would outdo all others: one
#: of which none is wanted, as every posterior holds some, or all there is and more.
SLACK, SLACK_OUT_OF_REACH = 1e-6, 1e-3


def fit_rates(
    scored: DataFrame,
    weights: list[float],
    total: float | None = None,
    most: float | None = 1.0,
    rounds: int = 60,
    tolerance: float = 1e-4,
) -> Rates:
    """Document rates whose expected tokens of each domain are ``weights`` of ``total``.

    Least squares by projected gradient: the sum over domains of (expected - wanted)² /
    slack, and over documents of tokens * (rate - 1)², all as shares of the tokens, over
    rates from 0 to ``most`` (no upper limit if None). A gradient in a document's rate
    is its posterior times one number for each domain, so all movement so far is a pull
    for each domain, and the projection, once for the whole movement, keeps the rate in
    its bounds. A round is one aggregation over all documents: the domains' expected
    tokens, which give the gradient, and its change with the pulls over the documents
    that aren't at a bound, which gives the step. A step that comes no nearer is halved.
    Nothing is joined, and a round costs the same however many went before.

    ``total`` is a share of all tokens; None takes that at which the domain of the largest
    weight is used in full, at a mean rate of ``most`` (1 if that is None); a domain with
    fewer tokens than its weight asks for then stays short of its target. A domain with
    no tokens at hand is left as it is. Without tokens there are no steps and every rate is 1.

    Rounds end when every domain is within ``tolerance`` of the total, or when the gradient
    is as near to nothing: targets may be out of reach, as that of 0 is for a domain
    that every posterior holds a little of. The result has the wanted and reached
    shares of all tokens; a miss is told by a warning.
    """
    size = len(weights)
    part = [F.col("posterior")[j] for j in range(size)]
    # Bounds count as within, or nothing could leave them.
    inner = (F.col("moved") >= 0) & (F.lit(True) if most is None else F.col("moved") <= most)
    sums = [F.sum(F.col("tokens") * F.col("rate") * p) for p in part]
    bends = [F.sum(F.when(inner, F.col("tokens") * part[j] * part[k]).otherwise(0.0)) for j in range(size) for k in range(j, size)]

    def totals(rates: Rates) -> tuple[float, np.ndarray, np.ndarray]:
        row = scored.withColumns({"rate": rates.column(), "moved": rates.moved()}).agg(F.sum("tokens").alias("n"), *sums, *bends).first()
        n, found = float(row["n"] or 0), np.array([float(x or 0) for x in row[1:]])
        bend = np.zeros((size, size))
        bend[np.triu_indices(size)] = found[size:]
        return n, found[:size] / (n or 1), (bend + np.triu(bend, 1).T) / (n or 1)

    whole = sum(weights)
    if not whole > 0 or min(weights) < 0:
        raise ValueError("weights must not be negative, nor all be 0")
    rates = Rates([], most, [], [])
    tokens, have, bend = totals(rates)
    if not tokens:
        return rates
    weights = [w / whole for w in weights]
    if total is None:
        first = max(range(size), key=lambda j: (have[j] > 0, weights[j]))
        total = (most or 1.0) * have[first] / weights[first] if weights[first] else 1.0
    wanted = np.array(weights) * total
    out_of_reach = (wanted == 0) | (False if most is None else wanted >= most * have * (1 - 1e-6))
    slack = np.where(out_of_reach, SLACK_OUT_OF_REACH, SLACK)
    here = have > 0
    rates.wanted, rates.reached = wanted.tolist(), have.tolist()
    pull, step = np.zeros(size), np.zeros(size)
    gradient = np.where(here, have - wanted, 0.0)
    rates.met = rates.nearest = False
    for done in range(rounds + 1):
        apart = np.array(rates.reached) - wanted
        rates.met = bool(np.abs(apart).max() <= tolerance * total)
        rates.nearest = bool(np.abs(gradient).max() <= 0.1 * tolerance * total)
        if rates.met or rates.nearest or done == rounds:
            break
        step = -np.linalg.solve(bend + np.diag(slack + 1e-12), gradient)
        for _ in range(12):
            tried = Rates([(pull + step).tolist()], most, [], [])
            _, reached, bend_there = totals(tried)
            there = np.where(here, reached - wanted + slack * (pull + step), 0.0)
            if np.abs(there).max() < np.abs(gradient).max():
                break
            step = step / 2
        else:
            rates.nearest = True
            break
        pull, gradient, bend = pull + step, there, bend_there
        rates.steps.append(pull.tolist())
        rates.reached = reached.tolist()
    if not rates.met:
        ended = "the nearest that rates come" if rates.nearest else f"stopped after {rounds} rounds"
        warnings.warn(f"mixture targets missed ({ended}): wanted {rates.wanted}, reached {rates.reached} of all tokens")
    return rates


def mix(
    docs: DataFrame,
    model: DomainModel,
    weights: list[float],
    text: str = "text",
    key: str = "doc_id",
    seed: int = 0,
    keep: list[str] | None = None,
    **options,
) -> DataFrame:
    """Adds ``tokens``, ``posterior``, ``rate`` and ``copies`` to every row (to the columns ``keep`` of it).

    ``copies`` is the rate's whole part, and one more with the probability of the rest,
    by a hash of key and seed. Posteriors are computed once and stored with the row.
    A null or empty text has no tokens, pulls at no target, and gets the rate that its
    posterior has; null keys share one draw, and repeated rows too. An empty table stays
    empty; result columns replace columns of the same name.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (*SCORED, "rate", "copies")]
    stored = materialize(model.score(docs, text).select(*kept, *SCORED))
    rates = fit_rates(stored.select(*SCORED), weights, **options)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    rated = stored.withColumn("rate", rates.column())
    whole = F.floor("rate")
    return rated.withColumn("copies", (whole + (draw < F.col("rate") - whole).cast("long")).cast("int"))
