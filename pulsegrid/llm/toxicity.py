"""Toxicity by classifier chains.

Categories are predicted one after the other.  Each has a linear (logistic) model over
the words that occur in the text and over the probabilities of the categories before it.
While fitting, those probabilities come from models that did not see the row
(out-of-fold), so a later model learns from what an earlier one will really give it.

Words are hashed to buckets; per model the buckets that separate the classes best are
kept.  The models are fitted in one task on a sample of labelled rows whose size is a
parameter; scoring is one pass over the whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textkernels as tk

BUCKETS = 2**20
# Pseudo-buckets of a model: its intercept, then the probabilities of the categories before it.
INTERCEPT = -1


@dataclass(frozen=True)
class ChainSettings:
    """``sample_rows`` bounds the labelled rows a fit sees; the rest is about the models."""

    sample_rows: int = 12000
    folds: int = 3
    words_per_model: int = 300
    least_rows: int = 3
    ridge: float = 0.1
    threshold: float = 0.3


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and the text it stands in.  Words are runs of letters and digits, lower-cased (A-Z)."""
    starts, ends, first = tk.words(data, offsets, tk.is_word(data))
    buckets = tk.range_hashes(tk.lower_ascii(data), starts, ends) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.text_slices(whole, "text"):
            buckets, owner = word_buckets(*tk.column_bytes(batch.column("text")))
            pairs = np.unique(owner * BUCKETS + buckets)
            at = np.searchsorted(pairs // BUCKETS, np.arange(batch.num_rows + 1))
            listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((pairs % BUCKETS).astype(np.int32)))
            kept = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), listed], names=[*kept, "buckets"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic model by Newton steps; the last column of ``x`` is the unpenalised intercept."""
    w = np.zeros(x.shape[1])
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w[-1] = np.log(share / (1 - share))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-4:
            break
    return w


class _Rows:
    """Sampled rows as a sorted list of (row, bucket)."""

    def __init__(self, lists: list[np.ndarray]):
        self.count = len(lists)
        self.row = np.repeat(np.arange(self.count), [len(x) for x in lists])
        self.bucket = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)

    def best(self, rows: np.ndarray, y: np.ndarray, settings: ChainSettings) -> np.ndarray:
        """The buckets whose presence goes with ``y`` most (chi-squared), among enough of ``rows``."""
        inside = np.zeros(self.count, dtype=bool)
        inside[rows] = True
        used = inside[self.row]
        seen = np.bincount(self.bucket[used], minlength=BUCKETS)
        hits = np.bincount(self.bucket[used], weights=y[self.row[used]], minlength=BUCKETS)
        n, positives = len(rows), y[rows].sum()
        expected = seen * positives / max(n, 1)
        spread = expected * (1 - positives / max(n, 1)) * (1 - seen / max(n, 1)) + 1e-9
        score = np.where(seen >= settings.least_rows, (hits - expected) ** 2 / spread, 0)
        top = np.argsort(-score, kind="stable")[: settings.words_per_model]
        return np.sort(top[score[top] > 0])

    def matrix(self, buckets: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Presence of ``buckets``, then ``extra`` columns, then ones."""
        x = np.zeros((self.count, len(buckets) + extra.shape[1] + 1))
        if len(buckets):
            place = np.searchsorted(buckets, self.bucket)
            place[place == len(buckets)] = 0
            known = buckets[place] == self.bucket
            x[self.row[known], place[known]] = 1
        x[:, len(buckets) : -1] = extra
        x[:, -1] = 1
        return x


def _fit(categories: list[str], settings: ChainSettings):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
        lists = _Rows(list(rows["buckets"]))
        fold = rows["fold"].to_numpy()
        earlier, out = np.zeros((len(rows), 0)), []
        for name in categories:
            y = rows[name].to_numpy(dtype=float)
            known = np.isfinite(y)
            filled = np.where(known, y, 0)

            def model(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                if not len(chosen) or filled[chosen].min() == filled[chosen].max():  # one class: a constant
                    share = np.clip(filled[chosen].mean() if len(chosen) else 0, 1e-4, 1 - 1e-4)
                    buckets = np.zeros(0, np.int64)
                    w = np.append(np.zeros(earlier.shape[1]), np.log(share / (1 - share)))
                else:
                    buckets = lists.best(chosen, filled, settings)
                    w = _logistic(lists.matrix(buckets, earlier)[chosen], filled[chosen], settings.ridge)
                x = lists.matrix(buckets, earlier)
                return buckets, w, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))

            out_of_fold = np.zeros(len(rows))
            for f in range(settings.folds):
                _, _, p = model(np.flatnonzero(known & (fold != f)))
                out_of_fold[fold == f] = p[fold == f]
            buckets, w, _ = model(np.flatnonzero(known))
            places = [*buckets.tolist(), *(INTERCEPT - 1 - i for i in range(earlier.shape[1])), INTERCEPT]
            out += [(name, int(b), float(v)) for b, v in zip(places, w)]
            earlier = np.column_stack((earlier, out_of_fold))
        return pd.DataFrame(out, columns=["category", "bucket", "weight"])

    return run


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: list[str], settings: ChainSettings = ChainSettings(),
    id_col: str = "doc_id", text_col: str = "text",
) -> list[tuple[str, int, float]]:
    """Fit the chain; returns (category, bucket, weight) rows, at most ``words_per_model`` and a few per category.

    ``labels`` has the id and one 0/1 column per category, null where unknown.  The
    sample are the ``sample_rows`` labelled ids of smallest hash; the ids are broadcast,
    as their number is bounded.  Ids labelled twice count once, by the larger label.
    No labelled rows, or rows of one class only, give a constant model.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    marks = marks.agg(*(F.max(c).cast("double").alias(c) for c in categories))
    drawn = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_rows)
    drawn = drawn.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(settings.folds)).cast("int"))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = given.join(F.broadcast(drawn), "doc_id").select("doc_id", "fold", *categories, "text")
    schema = f"doc_id long, fold int, {', '.join(f'`{c}` double' for c in categories)}, buckets array<int>"
    fitted = rows.mapInArrow(_features, schema).groupBy().applyInPandas(
        _fit(categories, settings), "category string, bucket int, weight double"
    )
    return [tuple(x) for x in fitted.collect()]


class Chain:
    """The fitted weights as tables over the buckets."""

    def __init__(self, model: list[tuple[str, int, float]], categories: list[str]):
        self.categories = categories
        self.weights = {c: np.zeros(BUCKETS) for c in categories}
        self.special: dict = {c: {} for c in categories}
        for category, bucket, weight in model:
            if bucket >= 0:
                self.weights[category][bucket] = weight
            else:
                self.special[category][bucket] = weight
        self.used = np.zeros(BUCKETS, dtype=bool)
        for table in self.weights.values():
            self.used |= table != 0

    def probabilities(self, texts: pa.Array) -> list[np.ndarray]:
        """One array per category, in the order of the chain."""
        buckets, owner = word_buckets(*tk.column_bytes(texts))
        known = self.used[buckets]
        pairs = np.unique(owner[known] * BUCKETS + buckets[known])
        row, bucket = pairs // BUCKETS, pairs % BUCKETS
        scores: list[np.ndarray] = []
        for name in self.categories:
            z = np.bincount(row, weights=self.weights[name][bucket], minlength=len(texts)).astype(float)
            z += self.special[name].get(INTERCEPT, -np.inf)
            for i, before in enumerate(scores):
                z += self.special[name].get(INTERCEPT - 1 - i, 0.0) * before
            scores.append(1 / (1 + np.exp(-np.clip(z, -700, 700))) * np.isfinite(z))
        return scores


def score_chain(
    docs: DataFrame, model: list[tuple[str, int, float]], categories: list[str], id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: the id and ``p_<category>`` for each category of the chain.

    Null and empty texts are scored by the intercepts; an empty model gives 0
    everywhere.  Repeated rows are kept, other columns ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(model, categories)
        for whole in batches:
            for batch in tk.text_slices(whole, "text"):
                scores = chain.probabilities(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *map(pa.array, scores)], names=["doc_id", *(f"p_{c}" for c in categories)]
                )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id long, {', '.join(f'`p_{c}` double' for c in categories)}"
    return given.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


# The chain of the labels table: low quality first, as its texts are never toxic, then toxic.
CATEGORIES = ["low_quality", "toxic"]


def label_columns(labels: DataFrame) -> DataFrame:
    """``doc_id`` and a 0/1 column per category from the labels table."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def toxic_documents(docs: DataFrame, labels: DataFrame, settings: ChainSettings = ChainSettings()) -> DataFrame:
    """Every document with the probabilities of the chain and the verdict ``toxic`` (boolean)."""
    model = fit_chain(docs, label_columns(labels), CATEGORIES, settings)
    scored = score_chain(docs, model, CATEGORIES)
    return scored.withColumn("toxic", F.col("p_toxic") >= settings.threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: ChainSettings = ChainSettings(), text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the chain finds toxic; same columns, no shuffle."""
    model = fit_chain(docs, label_columns(labels), CATEGORIES, settings, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(model, CATEGORIES)
        for whole in batches:
            for batch in tk.text_slices(whole, text_col):
                yield batch.filter(pa.array(chain.probabilities(batch.column(text_col))[-1] < settings.threshold))

    return docs.mapInArrow(run, docs.schema)
