"""Quality classifier: Bradley-Terry pairwise ranking.

P(document i is preferred to j) = sigmoid(score_i - score_j), score linear in features: hashed words (present or not) and
a few measures of form. Words count if ``MIN_DF`` sampled documents hold
them and their share among the worse documents is significantly off. Preference pairs come from ``labels``: a document of quality 1 that is not toxic is preferred
to one that is toxic or of quality 0. The weights minimise the logistic loss on feature differences. Then the whole corpus is
scored and cut at a score quantile.

The fit uses at most ``FIT_DOCUMENTS`` labelled documents (those of the least hash, the documented bound of the
sample); everything else covers all documents. The quantile is where the sample's ranking parts the two classes best.
It is taken from a histogram of all scores at step ``STEP``, so it is exact at that step and the same at any partitioning.

Defined results: null and empty texts have no features and get the lowest score there is, so they are never kept by a
positive quantile; rows of ``labels`` with nulls are not used; a document labelled twice counts as its worst label; repeated
document rows are scored each for itself; with no pair to learn from all scores are 0 and everything with a text is
kept; an empty table gives an empty result; a column ``score`` of the input is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash01, map_arrow, materialize
from .textscan import slices, words

BINS, MIN_DF, MIN_Z, FIT_DOCUMENTS, PAIRS_PER_DOCUMENT = 1 << 18, 5, 4.0, 6000, 4
STEP, LOWEST = 0.001, -1000.0
FORM = ("letters", "symbols", "upper", "pipes", "breaks", "distinct", "long_words", "top_word")
_LETTER = np.zeros(256)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_SYMBOL = np.ones(256)
_SYMBOL[48:58] = _SYMBOL[65:91] = _SYMBOL[97:123] = _SYMBOL[128:] = _SYMBOL[[9, 10, 13, 32]] = 0


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def featurize(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of (first row, row of every distinct word bin, bin, form by row, rows that have a word)."""
    raw = column.fill_null("")
    for first, end, offsets, lowered in slices(raw):
        h, bounds = words(offsets, lowered)
        part = raw.slice(first, end - first)
        kind = np.int64 if pa.types.is_large_string(part.type) else np.int32
        at = np.frombuffer(part.buffers()[1], kind)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2], np.uint8)[at[0] : at[-1]] if part.buffers()[2] is not None else np.empty(0, np.uint8)
        at = at - at[0]
        size, counts = np.maximum(1, np.diff(at)), np.diff(bounds)
        rows = np.repeat(np.arange(end - first), counts)
        keys, times = np.unique((rows.astype(np.int64) << 18) | (h >> np.uint64(46)).astype(np.int64), return_counts=True)
        row, bin_ = keys >> 18, keys & (BINS - 1)
        some = np.maximum(1, counts)
        top = np.zeros(end - first)
        np.maximum.at(top, row, times)
        letters = _per_row(_LETTER[data], at)
        form = np.stack([letters / size, _per_row(_SYMBOL[data], at) / size, _per_row(_UPPER[data], at) / np.maximum(1, letters),
                _per_row((data == 124).astype(float), at) / some, _per_row((data == 10).astype(float), at) / some,
                np.bincount(row, minlength=end - first) / np.sqrt(some) / 10, letters / some / 10,
                np.where(counts > 10, top / some, 0)], 1)
        yield first, row, bin_, form, counts > 0


def _gather(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, row, bin_, form, _has in featurize(batch.column(1)):
                ends = np.searchsorted(row, np.arange(len(form) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(form)),
                            pa.array([bin_[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                            pa.array([f.tobytes() for f in form], pa.binary())], names=["good", "bins", "form"]
                )

    return map_arrow(docs.select("good", "text"), run, "good int, bins binary, form binary")


def loss_and_gradient(w: np.ndarray, doc: np.ndarray, col: np.ndarray, z: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean of log(1 + exp(score of b - score of a)) over the pairs (a preferred to b), and its gradient. ``doc`` has feature ``col``; ``z`` are further features by document, the last weights."""
    k = len(w) - z.shape[1]
    score = np.bincount(doc, w[col], len(z)) + z @ w[k:]
    off = np.clip(score[a] - score[b], -30, 30)
    p = 1 / (1 + np.exp(off))
    by_doc = (np.bincount(b, p, len(z)) - np.bincount(a, p, len(z))) / len(a)
    return float(np.log1p(np.exp(-off)).mean()), np.concatenate([np.bincount(col, by_doc[doc], k), z.T @ by_doc])


def fit_pairs(bins: list[np.ndarray], form: np.ndarray, good: np.ndarray, rounds: int = 300, l2: float = 2e-4, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights by Adam on the mean logistic loss of the pairs' feature differences, with ridge penalty."""
    mean, sd = form.mean(0) if len(form) else np.zeros(len(FORM)), np.maximum(form.std(0), 1e-6) if len(form) else np.ones(len(FORM))
    model = {"mean": mean, "sd": sd, "form": np.zeros(len(FORM) * 2), "bins": np.zeros(BINS), "cut": np.array(0.0)}
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(better) or not len(worse):
        return model
    rng = np.random.default_rng(seed)
    n = max(len(better), len(worse)) * PAIRS_PER_DOCUMENT
    a, b = better[rng.permutation(n) % len(better)], worse[rng.permutation(n) % len(worse)]
    doc, flat = np.repeat(np.arange(len(bins)), [len(x) for x in bins]), np.concatenate(bins).astype(np.int64)
    used, where, df = np.unique(flat, return_inverse=True, return_counts=True)
    # words whose share among the worse documents is off by MIN_Z standard errors; the rest would only add noise
    share = len(worse) / len(good)
    off = np.bincount(where, good[doc] == 0, len(used)) / df - share
    common = (df >= MIN_DF) & (np.abs(off) * np.sqrt(df / (share * (1 - share))) >= MIN_Z)
    slot = np.cumsum(common) - 1
    keep = common[where]
    doc, col = doc[keep], slot[where[keep]]
    z = np.clip((form - mean) / sd, -5, 5)
    z = np.hstack([z, z * z])
    w = np.zeros(int(common.sum()) + z.shape[1])
    k, m, v = len(w) - z.shape[1], np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = loss_and_gradient(w, doc, col, z, a, b)[1] + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model["bins"][used[common]] = w[:k]
    model["form"] = w[k:]
    score = np.bincount(doc, w[col], len(bins)) + z @ w[k:]
    order = np.argsort(score, kind="stable")
    # share of each class below every cut; the best cut leaves most of the worse and fewest of the better below it
    below_bad, below_good = np.cumsum(good[order] == 0) / len(worse), np.cumsum(good[order] == 1) / len(better)
    best = int(np.argmax(below_bad - below_good)) + 1
    model["cut"] = np.array(best / len(order))
    return model


def scores(column: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    out = np.full(len(column), LOWEST)
    for first, row, bin_, form, has in featurize(column):
        w = model["bins"][bin_]
        some = w != 0
        z = np.clip((form - model["mean"]) / model["sd"], -5, 5)
        s = np.bincount(row[some], w[some], len(form)) + np.hstack([z, z * z]) @ model["form"]
        out[first : first + len(form)] = np.where(has, np.round(np.clip(s, -900, 900) / STEP) * STEP, LOWEST)
    return out


def learn(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> dict[str, np.ndarray]:
    """Fit on at most ``fit_documents`` labelled documents. Labels are joined to texts only for the documents drawn."""
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.min("quality") * (1 - F.max("toxic"))).cast("int").alias("good"))
    drawn = told.orderBy(hash01(F.col("doc_id"), "fit:"), "doc_id").limit(fit_documents)  # the documented bound of the fit
    # a repeated document counts with its least text, so what comes to the driver is at most a row an id
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    t = _gather(texts).toArrow()
    bins = [np.frombuffer(x, np.int32) for x in t.column("bins").to_pylist()]
    form = np.frombuffer(b"".join(t.column("form").to_pylist()), np.float64).reshape(-1, len(FORM))
    good = np.asarray(t.column("good"))
    order = sorted(range(len(bins)), key=lambda i: (int(good[i]), bins[i].tobytes(), form[i].tobytes()))  # the same fit at any partitioning
    return fit_pairs([bins[i] for i in order], form[order], good[order])


def with_scores(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with ``score``. The model has a fixed size and is broadcast."""
    rest = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType())])
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(names.index("text")), shared.value))], names=[*names, "score"])

    return map_arrow(rest, run, schema)


def score_quantile(scored: DataFrame, quantile: float) -> float:
    """The least score such that at least ``quantile`` of all rows lie below it or are equal to a lesser step."""
    step = F.round(F.col("score") / STEP).cast("bigint")
    counted = scored.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))  # rows: steps in use, at most 1.9 million
    row = counted.select("step", run.alias("run"),
        F.sum("n").over(Window.partitionBy()).alias("all")).where(F.col("run") > F.lit(quantile) * F.col("all")).agg(F.min("step")).first()
    return LOWEST if row[0] is None else row[0] * STEP


def rank_and_cut(docs: DataFrame, labels: DataFrame, quantile: float | None = None, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, score) of the documents at or above the score quantile; by default the one that parts the labelled best."""
    model = learn(docs, labels, fit_documents)
    scored = materialize(with_scores(docs.select("doc_id", "text"), model).select("doc_id", "score"), "scores")
    cut = score_quantile(scored, float(model["cut"]) if quantile is None else quantile)
    return scored.where((F.round(F.col("score") / STEP) >= round(cut / STEP)) & (F.col("score") > LOWEST))
