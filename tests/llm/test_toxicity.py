"""The classifier chain: scores from its definition, and held-out labels."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import textkernels as tk
from pulsegrid.llm.toxicity import CATEGORIES, INTERCEPT, ChainSettings, fit_chain, label_columns, score_chain, word_buckets
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def bucket(word: str) -> int:
    (found,) = word_buckets(*tk.column_bytes(pa.array([word])))[0].tolist()
    return found


def plain_scores(text: str | None, model) -> list[float]:
    """The chain one text at a time: distinct word buckets, then the probabilities before."""
    weights = {(c, b): w for c, b, w in model}
    seen = {bucket(w.lower()) for w in re.findall(r"[^\W_]+", text or "", re.ASCII)}
    scores: list[float] = []
    for name in CATEGORIES:
        z = weights[name, INTERCEPT] + sum(weights.get((name, b), 0.0) for b in seen)
        z += sum(weights.get((name, INTERCEPT - 1 - i), 0.0) * p for i, p in enumerate(scores))
        scores.append(1 / (1 + math.exp(-z)))
    return scores


def test_scores_equal_plain_code(spark):
    words = ["Good", "bad", "ugly", "fine", "so-so", "BAD!", "x1"]
    used = [bucket(w) for w in ("good", "bad", "ugly", "fine", "so", "x1")]
    rng = np.random.default_rng(8)
    model = [(c, b, float(rng.normal())) for c in CATEGORIES for b in [*used, INTERCEPT]]
    model.append((CATEGORIES[1], INTERCEPT - 1, 1.5))
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(60)] + [None, "", "bad " * 200_000, "\n\t", "bad,BAD;bad"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [r[f"p_{c}"] for c in CATEGORIES] for r in score_chain(docs.repartition(4), model, CATEGORIES).collect()}
    assert got == {i: pytest.approx(plain_scores(t, model), abs=1e-12) for i, t in enumerate(texts)}


def test_held_out_labels(spark):
    """Fitted with the shipped settings on the labels of even ids, judged on those of odd ones."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    settings = ChainSettings()
    model = fit_chain(docs, label_columns(labels.where("doc_id % 2 = 0")), CATEGORIES, settings)
    judged = score_chain(docs, model, CATEGORIES).join(labels.where("doc_id % 2 = 1"), "doc_id")
    hit, toxic = F.col("p_toxic") >= settings.threshold, F.col("toxic") == 1
    caught, missed, wrong = judged.agg(F.count_if(hit & toxic), F.count_if(~hit & toxic), F.count_if(hit & ~toxic)).first()
    assert caught / (caught + missed) >= 0.85 and caught / (caught + wrong) >= 0.95
