"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the rest of the web text is unlabelled. With the share of positives among
all texts (the class prior) the risk of a classifier can be written without negatives: prior * E_pos[loss(+)] +
(E_unlabelled[loss(-)] - prior * E_pos[loss(-)]). The bracket is the risk on negatives and can't be below zero; when
its estimate falls there, the step goes up its gradient instead (non-negative risk). The model is additive:
logistic loss over quantile bins of text statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm import textkit
from edgetide.llm.neardup import portions
from edgetide.llm.runtime import and_double, bounded_rows, bounded_sample, prepare

#: Documents of each kind (positive, unlabelled) that a model is fitted on at most (about).
TRAIN_ROWS = 12_000
STATISTICS = ("bytes", "words", "word_length", "upper", "digits", "symbols", "spaces", "beyond_ascii", "commas", "stops", "distinct_words", "top_word", "pairs", "distinct_pairs", "lines", "line_length", "distinct_lines", "short_lines", "word_ends", "long_words", "entropy")
_STOPS, _COMMAS = np.zeros(256, bool), np.zeros(256, bool)
_STOPS[[33, 46, 63]] = True
_COMMAS[[44, 58, 59]] = True
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL = ~textkit.ALNUM & textkit.SOLID & ~_STOPS & ~_COMMAS
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _shares(h: np.ndarray) -> tuple[float, float, float]:
    """Distinct share, share of the most frequent, normalised entropy of a list of hashes."""
    if not len(h):
        return 1.0, 0.0, 1.0
    n = np.unique(h, return_counts=True)[1]
    p = n / len(h)
    return len(n) / len(h), float(p.max()), float(-(p * np.log(p)).sum() / np.log(len(h))) if len(h) > 1 else 1.0


def statistics(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """rows x len(STATISTICS) over whole texts."""
    n = len(starts)
    out = np.zeros((n, len(STATISTICS)))
    for lo, hi in portions(starts, ends):
        a, b = int(starts[lo]), int(max(ends[lo:hi].max(), starts[lo]))
        x = data[a:b]
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        size = np.maximum(e - s, 1)

        def share(mask):
            total = np.r_[0, np.cumsum(mask[x])]
            return (total[e] - total[s]) / size

        h, low, high, ws, we = textkit.words(data, starts[lo:hi], ends[lo:hi], textkit.SOLID, places=True)
        lh, llow, lhigh, ls, le = textkit.words(data, starts[lo:hi], ends[lo:hi], _NOT_NEWLINE, places=True)
        words, lines = np.maximum(high - low, 1), np.maximum(lhigh - llow, 1)
        length = np.r_[0, np.cumsum(we - ws)]
        symbol_end = np.r_[0, np.cumsum(_SYMBOL[data[we - 1]])] if len(we) else np.zeros(1)
        long = np.r_[0, np.cumsum(we - ws > 20)]
        llength = np.r_[0, np.cumsum(le - ls)]
        short = np.r_[0, np.cumsum(le - ls < 30)]
        o = out[lo:hi]
        o[:, 0], o[:, 1] = np.log1p(e - s), np.log1p(high - low)
        o[:, 2] = (length[high] - length[low]) / words
        for c, mask in ((3, _UPPER), (4, _DIGIT), (5, _SYMBOL), (6, ~textkit.SOLID), (7, np.arange(256) > 127), (8, _COMMAS), (9, _STOPS)):
            o[:, c] = share(mask)
        for i in range(hi - lo):
            w = h[low[i] : high[i]]
            o[i, 10], o[i, 11], o[i, 20] = _shares(w)
            o[i, 12] = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0
            pairs = w[1:] + w[:-1] * np.uint64(0x9E3779B97F4A7C15)
            o[i, 13] = len(np.unique(pairs)) / max(1, len(pairs))
            o[i, 16] = len(np.unique(lh[llow[i] : lhigh[i]])) / lines[i]
        o[:, 14], o[:, 15] = np.log1p(lhigh - llow), np.log1p((llength[lhigh] - llength[llow]) / lines)
        o[:, 17] = (short[lhigh] - short[llow]) / lines
        o[:, 18] = (symbol_end[high] - symbol_end[low]) / words
        o[:, 19] = (long[high] - long[low]) / words
    return out


@dataclass(frozen=True)
class Model:
    """Bin edges of each statistic, a weight for each bin, and the intercept."""

    edges: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for c, (e, w) in enumerate(zip(self.edges, self.weights)):
            z += w[np.searchsorted(e, x[:, c], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = 24, steps: int = 600, l2: float = 2e-4) -> Model:
    """Minimise the non-negative PU risk with logistic loss by full-batch Adam. The same input gives the same model."""
    if not len(positive) or not len(unlabelled):
        e = tuple(np.zeros(0) for _ in STATISTICS)
        return Model(e, tuple(np.zeros(1) for _ in STATISTICS), float(np.log(prior / (1 - prior))), prior)
    both = np.concatenate([positive, unlabelled])
    edges = tuple(np.unique(np.quantile(both[:, c], np.linspace(0, 1, bins + 1)[1:-1])) for c in range(both.shape[1]))
    first = np.cumsum([0] + [len(e) + 1 for e in edges])

    def coded(x):
        return np.stack([first[c] + np.searchsorted(e, x[:, c], side="right") for c, e in enumerate(edges)], axis=1)

    p, u = coded(positive), coded(unlabelled)
    theta = np.zeros(first[-1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def gradient(code, slope):
        g = np.zeros_like(theta)
        g[:-1] = np.bincount(code.ravel(), np.repeat(slope, code.shape[1]), minlength=len(theta) - 1)
        g[-1] = slope.sum()
        return g / len(code)

    for t in range(1, steps + 1):
        zp, zu = theta[p].sum(axis=1) + theta[-1], theta[u].sum(axis=1) + theta[-1]
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down = gradient(u, su) - prior * gradient(p, sp)
        g = prior * gradient(p, sp - 1) + down if negative >= 0 else -down
        g[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.03 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(edges, tuple(theta[a:b] for a, b in zip(first[:-1], first[1:])), float(theta[-1]), prior)


def excess(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of the unlabelled below some value that the positives don't have there: a lower bound of the
    share of negatives, and close to it where the statistic tells the two apart."""
    both = np.sort(np.concatenate([positive, unlabelled]))
    below = lambda x: np.searchsorted(np.sort(x), both, side="right") / len(x)
    return float((below(unlabelled) - below(positive)).max())


def cross_fitted(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of either sample, each half scored by a model of the other half."""
    out = []
    halves = [(positive[k::2], unlabelled[k::2]) for k in (0, 1)]
    models = [fit(p, u, prior) for p, u in halves]
    for kind in (0, 1):
        s = np.concatenate([models[1 - k].score(halves[k][kind]) for k in (0, 1)])
        s = np.clip(s, 1e-12, 1 - 1e-12)
        out.append(np.sort(np.log(s) - np.log1p(-s)))
    return out[0], out[1]


def calibrated(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """A fitted model with the prior estimated, unless given, and 0.5 put where the unlabelled exceed the positives most.

    A first bound of the prior comes from single statistics; classifiers fitted with it score texts they have not seen,
    and the excess over those scores gives the estimate. The correction of the risk keeps scores of negatives from
    falling all the way, so the ranking is better than the place of 0.5; where a range of scores does about equally
    well, its low end is taken.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return fit(positive, unlabelled, 0.5 if prior is None else prior)
    first = max(max(excess(positive[:, c], unlabelled[:, c]), excess(-positive[:, c], -unlabelled[:, c])) for c in range(positive.shape[1]))
    zp, zu = cross_fitted(positive, unlabelled, float(np.clip(1 - first, 0.02, 0.98)) if prior is None else prior)
    at = np.unique(np.concatenate([zp, zu]))
    gain = np.searchsorted(zu, at, side="right") / len(zu) - np.searchsorted(zp, at, side="right") / len(zp)
    model = fit(positive, unlabelled, float(np.clip(1 - gain.max(), 0.02, 0.98)) if prior is None else prior)
    near = 0.1 / np.sqrt(min(len(zp), len(zu)))
    if gain.max() <= near:
        return model
    k = int(np.flatnonzero(gain >= gain.max() - near)[0])
    cut = float(at[k] + at[min(k + 1, len(at) - 1)]) / 2
    return Model(model.edges, model.weights, model.bias - cut, model.prior)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(*textkit.view(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "kind", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAIN_ROWS, prior: float | None = None) -> Model:
    """Fit on positives of ``labels`` (doc_id, label) and unlabelled texts of docs (doc_id, text).

    The class prior is estimated from the two samples unless given. Documents labelled 0 are unlabelled text like all
    others. Several labels of a document count as their minimum; null labels and ids don't count. About
    ``bound`` documents of each kind at most are used, also where ids repeat. Without positives or texts the model scores 0.5 everywhere.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.min(label) > 0).alias("good"))
    positives = bounded_sample(known.where("good").select("doc_id"), "doc_id", bound, 51)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    web = bounded_rows(bounded_sample(texts, "doc_id", bound, 52), 2 * bound, 53).select("doc_id", "text", F.lit(0).alias("kind"))
    trusted = bounded_rows(texts.join(F.broadcast(positives), "doc_id").select("doc_id", "text"), 2 * bound, 54).select("doc_id", "text", F.lit(1).alias("kind"))
    rows = web.unionByName(trusted).mapInArrow(_rows, "doc_id long, kind int, x binary").collect()
    rows.sort(key=lambda r: (r["kind"], r["doc_id"], r["x"]))
    x = np.frombuffer(b"".join(r["x"] for r in rows)).reshape(len(rows), len(STATISTICS))
    kind = np.array([r["kind"] for r in rows])
    p, u = x[kind == 1], x[kind == 0]
    return calibrated(p, u, prior)


def _score(shared):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(statistics(*textkit.view(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "quality_score"])

    return each


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of docs with quality_score, a double from 0 to 1, added.

    A null text counts as empty; whole texts are read, in portions of bounded size, and a longer text alone. Rows are
    handled one by one: repeated rows and ties get the same score, and an empty table gives an empty one. A column of
    docs that is called quality_score is replaced; others may have any names.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop("quality_score")
    return docs.mapInArrow(_score(spark.sparkContext.broadcast(model)), and_double(docs.schema, "quality_score"))
