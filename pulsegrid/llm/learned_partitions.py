"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into parts of equal size, so that
few graph edges cross.  A small classifier learns the part of a vector.  Every row is
entered in the part the classifier finds most probable; a query goes to the parts that
together hold most of its probability, and all rows there are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm import textkernels as tk


@dataclass(frozen=True)
class IndexSettings:
    """``sample_rows`` bounds what is fitted; ``mass`` and ``least_parts`` say how many parts a query visits."""

    sample_rows: int = 4096
    parts: int = 16
    neighbours: int = 10
    hidden: int = 128
    epochs: int = 30
    mass: float = 0.999
    least_parts: int = 4
    # rows of a part, and queries, that are worked on at once
    chunk: int = 8192


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest rows of each row."""
    k = min(k, len(x) - 1)
    norms = (x * x).sum(1)
    out = np.zeros((len(x), max(k, 0)), dtype=np.int64)
    for a in range(0, len(x), 512):
        d = norms[a : a + 512, None] + norms - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        if k > 0:
            out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Cut the graph in halves again and again, each time at the median of its slowest mixing direction."""
    n, k = graph.shape
    src, dst = np.repeat(np.arange(n), k), graph.ravel()
    src, dst = np.concatenate((src, dst)), np.concatenate((dst, src))
    label, rng = np.zeros(n, dtype=np.int64), np.random.default_rng(7)
    while label.max() + 1 < parts:
        same = label[src] == label[dst]
        s, d = src[same], dst[same]
        degree = np.bincount(s, minlength=n) + 1e-9
        groups = int(label.max()) + 1
        weight = np.bincount(label, weights=degree, minlength=groups)
        v = rng.normal(size=n)
        for _ in range(60):  # lazy random walk without its constant part
            v -= (np.bincount(label, weights=degree * v, minlength=groups) / weight)[label]
            v = 0.5 * v + 0.5 * np.bincount(s, weights=v[d], minlength=n) / degree
            v /= np.sqrt(np.bincount(label, weights=v * v, minlength=groups) + 1e-30)[label]
        order = np.lexsort((np.arange(n), v, label))
        rank = np.arange(n) - np.searchsorted(label[order], np.arange(groups))[label[order]]
        upper = rank * 2 >= np.bincount(label, minlength=groups)[label[order]]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = label[order] * 2 + upper
        label = fresh
    return label


class Router:
    """One hidden layer and a softmax over the parts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, parts: int, hidden: int, epochs: int):
        rng = np.random.default_rng(11)
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        z = (x - self.mean) / self.scale
        self.w = [rng.normal(size=(x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden),
                  rng.normal(size=(hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
        m, v, t = [0 * p for p in self.w], [0 * p for p in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for a in range(0, len(z), 128):
                at = order[a : a + 128]
                h = np.maximum(z[at] @ self.w[0] + self.w[1], 0)
                g = _softmax(h @ self.w[2] + self.w[3])
                g[np.arange(len(at)), y[at]] -= 1
                g /= len(at)
                gh = g @ self.w[2].T * (h > 0)
                t += 1
                for i, grad in enumerate((z[at].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    grad = grad + 1e-4 * self.w[i]
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    self.w[i] = self.w[i] - 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0)
        return _softmax(h @ self.w[2] + self.w[3])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_router(x: np.ndarray, settings: IndexSettings) -> Router:
    """Graph, parts and classifier of the sampled rows ``x``."""
    parts = max(1, min(settings.parts, 1 << max(0, (len(x) // 32).bit_length() - 1)))
    label = balanced_parts(neighbour_graph(x, settings.neighbours), parts) if parts > 1 else np.zeros(len(x), np.int64)
    return Router(x, label, parts, settings.hidden, settings.epochs if parts > 1 else 0)


def usable(vector: str) -> F.Column:
    """Whether a vector is not null, not empty, not all zero and finite in every component."""
    v = F.col(vector)
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(broken, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def to_power(x: np.ndarray) -> np.ndarray:
    """Each row scaled by a power of two, its largest component then between 1/2 and 1; squares stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


# Components beyond this multiple of the sample's usual magnitude are cut there, for routing only.
_FAR = 2.0**20


def routing_scale(x: np.ndarray) -> int:
    """Exponent of the usual magnitude of the rows of ``x``."""
    return int(np.median(np.frexp(np.abs(x).max(axis=1))[1]))


def for_routing(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.ldexp(x, -scale), -_FAR, _FAR)


def distances(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to ``x`` in double precision, whatever their magnitude."""
    apart = rows - x
    top = np.frexp(np.abs(apart).max(axis=1, keepdims=True, initial=0))[1]
    small = np.ldexp(apart, -top)
    return np.ldexp(np.sqrt((small * small).sum(1)), top[:, 0])


def _route(router: Router, scale: int, length: int, settings: IndexSettings, every: int):
    def out(batch: pa.RecordBatch, part: np.ndarray, lists: list) -> pa.RecordBatch:
        columns = [batch.column("vec_id"), batch.column("vec"), pa.array(part.astype(np.int32)), pa.array(lists, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["vec_id", "vec", "part", "visits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                lengths = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
                if (lengths != length).any():  # a part of its own for each other length, which has no classifier
                    rest = batch.filter(pa.array(lengths != length))
                    own = -lengths[lengths != length]
                    asks = rest.column("vec_id").to_numpy() % every == 0
                    yield out(rest, own, [[v] if q else None for v, q in zip(own.tolist(), asks.tolist())])
                    batch = batch.filter(pa.array(lengths == length))
                if not batch.num_rows:
                    continue
                p = router.probabilities(for_routing(matrix(batch.column("vec")), scale))
                order = np.argsort(-p, axis=1, kind="stable")
                before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
                visited = (before < settings.mass) | (np.arange(p.shape[1]) < settings.least_parts)
                is_query = batch.column("vec_id").to_numpy() % every == 0
                lists = [order[i][visited[i]].tolist() if q else None for i, q in enumerate(is_query.tolist())]
                yield out(batch, order[:, 0], lists)

    return run


def _rank(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tk.runs(batches, ["part", "rc", "qc"]):
            query = rows.column("query").to_numpy(zero_copy_only=False)
            ids, x = rows.column("vec_id").to_numpy(), matrix(rows.column("vec"))
            q_ids, q, r_ids, r = ids[query], x[query], ids[~query], x[~query]
            if not len(q_ids) or not len(r_ids):
                continue
            # one power of two for all, so that the largest component is below 1
            power = -int(np.frexp(max(np.abs(q).max(), np.abs(r).max()))[1])
            small = np.ldexp(r, power)
            out, squares = [], (small * small).sum(1)
            for a in range(0, len(q_ids), 256):
                part, scaled = q[a : a + 256], np.ldexp(q[a : a + 256], power)
                near = (scaled * scaled).sum(1)[:, None] + squares - 2 * scaled @ small.T
                near[q_ids[a : a + 256, None] == r_ids] = np.inf
                kth = min(k, len(r_ids)) - 1
                bound = np.partition(near, kth, axis=1)[:, kth]
                # everything within rounding of the k-th is measured exactly
                close = near <= (bound + 1e-9 * (1 + np.abs(bound)))[:, None]
                for i in range(len(part)):
                    at = np.flatnonzero(close[i] & np.isfinite(near[i]))
                    score = distances(r[at], part[i])
                    best = np.lexsort((r_ids[at], score))[:k]
                    out.append((np.full(len(best), q_ids[a + i]), r_ids[at][best], score[best]))
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame, k: int = 10, every: int = 100, settings: IndexSettings = IndexSettings(),
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``k`` nearest rows found for each query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (Euclidean).

    Queries are the rows whose id is divisible by ``every``; a query is not its own
    answer.  Ties go to the smaller id.  Rows with a null id or with vectors that are null,
    empty, zero or not finite take no part.  Only vectors of one length are compared: those
    of the length most of the sample has through the index, others with all of their length
    (a few such lengths are expected).  Vectors may be of any magnitude.  A query id that
    repeats is asked once, with the longest of its vectors and of these the least; repeated
    candidate rows are kept.  An empty table, or one without queries, gives no rows; extra
    columns are ignored.

    The sample (``sample_rows`` rows of smallest hash) and the counts of the parts come
    to the driver, both of a size the settings bound.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    given = given.where(F.col("vec_id").isNotNull() & usable("vec"))
    drawn = given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample_rows).collect()
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = np.array([len(x["vec"]) for x in drawn])
    length = int(np.bincount(lengths).argmax())
    sample = np.array([x["vec"] for x in drawn if len(x["vec"]) == length], dtype=np.float64)
    scale = routing_scale(sample)
    router = fit_router(for_routing(sample, scale), settings)
    schema = "vec_id long, vec array<double>, part int, visits array<int>"
    routed = given.mapInArrow(_route(router, scale, length, settings, every), schema)

    counted = routed.select("part", F.lit(1).alias("row"), F.lit(0).alias("ask"))
    one = F.min(F.struct((-F.size("vec")).alias("size"), "vec", "visits")).alias("one")
    visits = routed.where("visits is not null").groupBy("vec_id").agg(one).select("vec_id", "one.vec", "one.visits")
    asked = visits.select(F.explode("visits").alias("part"), F.lit(0).alias("row"), F.lit(1).alias("ask"))
    counts = counted.unionByName(asked).groupBy("part").agg(F.sum("row").alias("rows"), F.sum("ask").alias("asks")).collect()
    pieces = {x["part"]: (max(1, -(-x["rows"] // settings.chunk)), max(1, -(-x["asks"] // settings.chunk))) for x in counts}
    row_pieces = F.element_at(F.create_map(*(F.lit(v) for p, n in pieces.items() for v in (p, n[0]))), F.col("part"))
    ask_pieces = F.element_at(F.create_map(*(F.lit(v) for p, n in pieces.items() for v in (p, n[1]))), F.col("part"))
    spread = F.xxhash64("vec_id", F.lit(3))
    every_ask = F.explode(F.sequence(F.lit(0), ask_pieces - 1)).alias("qc")
    every_row = F.explode(F.sequence(F.lit(0), row_pieces - 1)).alias("rc")
    rows = routed.select("vec_id", "vec", "part", F.pmod(spread, row_pieces).cast("int").alias("rc"), every_ask)
    asks = visits.select("vec_id", "vec", F.explode("visits").alias("part"))
    asks = asks.select("vec_id", "vec", "part", every_row, F.pmod(spread, ask_pieces).cast("int").alias("qc"))
    work = rows.withColumn("query", F.lit(False)).unionByName(asks.withColumn("query", F.lit(True)))
    dealt = work.repartition("part", "rc", "qc").sortWithinPartitions("part", "rc", "qc")
    found = dealt.mapInArrow(_rank(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
