"""Mixing sources to target weights, with soft membership.

A classifier trained on the labelled table gives each document a posterior over domains; a document of t tokens puts t times its
posterior into each domain. Rates r >= 0, the expected number of copies of each document, are sought for which the domains' token
totals come close to the targets and which stay close to one: least squares ``|A r - T|^2``, by projected gradient with lazy
projection. The gradient with respect to a document's rate is t times its posterior times the residual, and the steps add up, so all rates
are ``max(0, 1 + posterior . y)``, at most ``most`` if that is given, for one vector y with an entry per domain. A step of y is one aggregation over the documents;
it is scaled by the inverse of the second moments of the documents that the bounds leave free.

Classifier: multinomial logistic over hashed words and text statistics; it learns from ``sample`` labelled documents at most (those with
the lowest hash of the id). Posteriors, totals and rates cover all documents, whole texts.

Rows: one per input row. Null and empty texts have no tokens and the posterior of their features. Repeated ids are rows of their own.
Without labels all domains are equally likely. Other columns are ignored. Targets that can't be met are approached as far as the
posteriors, and a ``most`` if given, allow; a warning then names what each domain misses.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_batches, map_rows, pick, schema_of, stored

BINS = 1024
N_STATS = 9
#: A domain further from its target, as a share of all tokens, is reported.
MISSED = 0.005
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_PLAIN = _LETTERS + _DIGITS + b" \t\n\r\x0b\x0c.,;:?'\"-"


def text_features(text: str) -> tuple[int, list[int], list[float]]:
    """Words, bins of the distinct words, statistics."""
    raw = text.encode()
    words = text.lower().split()
    kinds = set(words)
    bins = sorted({xxhash.xxh3_64_intdigest(w) % BINS for w in kinds})
    size = len(raw) or 1
    lines = text.split("\n")

    def share(of: bytes) -> float:
        return (len(raw) - len(raw.translate(None, of))) / size

    n = len(words) or 1
    stats = [np.log1p(len(words)), len(kinds) / n, share(_LETTERS), share(_UPPER), share(_DIGITS), 1 - share(_PLAIN), min(len(text) / n, 40.0), len(lines) / n, len(set(lines)) / len(lines)]
    return len(words), bins, [float(s) for s in stats]


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    weights: np.ndarray  # (BINS + N_STATS + 1) x domains
    mean: np.ndarray
    spread: np.ndarray

    def posterior(self, bins: list[int], stats: list[float]) -> list[float]:
        z = self.weights[-1] + ((np.array(stats) - self.mean) / self.spread) @ self.weights[BINS:-1]
        if bins:
            z = z + self.weights[bins].sum(0) / len(bins) ** 0.5
        e = np.exp(z - z.max())
        return (e / e.sum()).tolist()


def fit(rows: list[tuple[list[int], list[float], int]], domains: tuple[str, ...], rounds: int = 150, ridge: float = 1e-3) -> Classifier:
    k = len(domains)
    if not rows:
        return Classifier(domains, np.zeros((BINS + N_STATS + 1, k)), np.zeros(N_STATS), np.ones(N_STATS))
    stats = np.array([r[1] for r in rows])
    mean, spread = stats.mean(0), stats.std(0) + 1e-6
    x = np.zeros((len(rows), BINS + N_STATS + 1), np.float32)
    for i, (bins, _, _) in enumerate(rows):
        if bins:
            x[i, bins] = 1 / len(bins) ** 0.5
    x[:, BINS:-1] = (stats - mean) / spread
    x[:, -1] = 1
    y = np.eye(k, dtype=np.float32)[[r[2] for r in rows]]
    w, velocity = np.zeros((x.shape[1], k), np.float32), 0
    rate = 4.0 / float(np.einsum("ij,ij->", x, x) / len(x))
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        grad = x.T @ (y - p / p.sum(1, keepdims=True)) / len(rows) - ridge * w
        velocity = 0.9 * velocity + grad
        w = w + rate * velocity
    return Classifier(domains, w.astype(float), mean, spread)


def train(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], sample: int = 10_000) -> Classifier:
    """``labels``: ``id``, ``domain`` (name; others and nulls don't count)."""
    known = labels.filter(F.col("domain").isin(*domains)).groupBy("id").agg(F.min("domain").alias("domain"))
    known = known.filter("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
    number = {d: i for i, d in enumerate(domains)}

    def run(batches: Iterator[list[list]]):
        for texts, names in batches:
            made = [text_features(t) for t in texts]
            yield [[m[1] for m in made], [m[2] for m in made], [number[d] for d in names]]

    rows = docs.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("domain").alias("domain"))  # one text an id, so bounded by sample
    rows = rows.select("text", "domain")
    return fit([tuple(r) for r in map_batches(rows, run, schema_of("bins array<int>, stats array<double>, y int")).collect()], domains)


def posteriors(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``id``, ``n_tokens`` (words), ``posterior``."""

    def run(batches: Iterator[list[list]]):
        for ids, texts in batches:
            made = [text_features(t) for t in texts]
            yield [ids, [m[0] for m in made], [classifier.posterior(m[1], m[2]) for m in made]]

    return map_batches(docs, run, schema_of(f"id {docs.schema['id'].dataType.simpleString()}, n_tokens long, posterior array<double>"))


def rate_column(y: list[float], most: float | None) -> F.Column:
    z = F.lit(1.0)
    for k, v in enumerate(y):
        z = z + F.col("posterior")[k] * F.lit(float(v))
    rate = F.greatest(F.lit(0.0), z)
    return rate if most is None else F.least(F.lit(float(most)), rate)


def solve(rows: DataFrame, targets: list[float], most: float | None = None, rounds: int = 40, close: float = 1e-4) -> tuple[list[float], list[float]]:
    """The vector y for shares ``targets`` of the documents' tokens, and what each domain then has above its target as a share of
    them (nothing without tokens). Each round collects one row of sums."""
    k = len(targets)
    want = np.array(targets) / sum(targets)
    y, best, total = np.zeros(k), (np.inf, np.zeros(k), np.zeros(0)), None
    step = 1.0
    for _ in range(rounds):
        rate = rate_column(y.tolist(), most)
        free = (rate > 0 if most is None else (rate > 0) & (rate < most)).cast("double")
        p = [F.col("posterior")[i] for i in range(k)]
        sums = [F.sum(F.col("n_tokens") * rate * p[i]) for i in range(k)] + [F.sum(F.col("n_tokens") * free * p[i] * p[j]) for i in range(k) for j in range(k)]
        got = rows.agg(F.sum("n_tokens"), *sums).head()
        total = float(got[0] or 0)
        if not total:
            break
        residual = np.array(got[1 : k + 1], float) / total - want
        moments = np.array(got[k + 1 :], float).reshape(k, k) / total
        error = float(np.abs(residual).max())
        if error < best[0]:
            best, step = (error, y, residual), min(1.0, step * 1.5)
        else:
            y, step = best[1], step / 2
        if error < close or step < 1e-3:
            break
        if error == best[0]:
            direction = np.linalg.solve(moments + 1e-3 * np.eye(k), residual)
        y = best[1] - step * direction
    return best[1].tolist(), best[2].tolist()


def _solved(rows: DataFrame, targets: dict[str, float], most: float | None) -> list[float]:
    y, residual = solve(rows, list(targets.values()), most)
    if any(abs(x) > MISSED for x in residual):
        warnings.warn("the mixture misses its targets, as shares of all tokens: " + ", ".join(f"{d} {x:+.4f}" for d, x in zip(targets, residual)), stacklevel=3)
    return y


def rated(rows: DataFrame, targets: dict[str, float], most: float | None = None) -> DataFrame:
    """Rows with ``id``, ``n_tokens`` and ``posterior`` get ``rate`` and ``copies`` (the rate rounded up or down by a hash of the id, right on average)."""
    rows = rows.withColumn("rate", rate_column(_solved(rows, targets, most), most))
    draw = F.pmod(F.xxhash64("id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def mix(df: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", most: float | None = None, sample: int = 10_000) -> DataFrame:
    """``id``, ``n_tokens``, ``posterior``, ``rate``, ``copies``. ``labels``: ``id``, ``domain``."""
    docs = pick(df, id_col, text_col)
    return rated(stored(posteriors(docs, train(docs, labels, tuple(targets), sample)), "posteriors"), targets, most)


def mix_rows(df: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", most: float | None = None, sample: int = 10_000) -> DataFrame:
    """The rows themselves with ``rate`` and ``copies``; columns of these names that they had are replaced. The rates are solved on
    posteriors stored without the texts; the posteriors of the rows are then made again beside their texts, so no join is needed."""
    df = df.drop("rate", "copies")
    docs = pick(df, id_col, text_col)
    classifier = train(docs, labels, tuple(targets), sample)
    y = _solved(stored(posteriors(docs, classifier), "posteriors"), targets, most)
    at, key = df.columns.index(text_col), df.columns.index(id_col)

    def one(*row):
        _, bins, stats = text_features(row[at] or "")
        rate = max(0.0, 1.0 + float(np.dot(classifier.posterior(bins, stats), y)))
        rate = rate if most is None else min(most, rate)
        draw = xxhash.xxh3_64_intdigest(f"copies {row[key]}") / 2.0**64
        return *row, rate, int(rate) + int(draw < rate - int(rate))

    return map_rows(df, one, T.StructType([*df.schema.fields, T.StructField("rate", T.DoubleType()), T.StructField("copies", T.LongType())]))


def quality_domains(labels: DataFrame, toxic: bool = True) -> DataFrame:
    """Domains of the labelled table: good and poor by ``quality``, and toxic apart if asked for."""
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    if toxic:
        domain = F.when(F.col("toxic") == 1, "toxic").otherwise(domain)
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain"))
