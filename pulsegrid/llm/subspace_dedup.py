"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine ``c`` or more lie within squared distance ``2 - 2 c``.  A random
rotation spreads a difference evenly; cut into blocks of few dimensions, some block
differs by no more than its share of that budget (in proportion to its dimensions).  A
range join per block finds those pairs: the first coordinate of a block is cut into cells
as wide as its radius, a vector enters its own cell and is a guest in the next, and the
vectors of a cell are compared in that block.  Pairs in range are verified exactly on the
original vectors.  A pair in range in several blocks counts in the first of them.

Equal vectors are one class, so copies add no work.  A cell with many vectors is cut into
chunks, and each pair of chunks is a piece of work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textkernels as tk
from pulsegrid.llm.components import components
from pulsegrid.llm.learned_partitions import matrix, to_power, usable
from pulsegrid.llm.phases import phase

BLOCK_DIMS = 8
# Vectors of a cell that are compared at once.
CHUNK = 2048
# Room for rounding in distances of about 1.
SLACK = 1e-9


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def block_bounds(dims: int) -> list[tuple[int, int]]:
    count = max(1, dims // BLOCK_DIMS)
    edges = np.linspace(0, dims, count + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:]))


def _budgets(dims: int, cosine: float) -> np.ndarray:
    """Squared distance allowed in each block, in proportion to its dimensions."""
    return np.array([(b - a) / dims for a, b in block_bounds(dims)]) * (2 - 2 * cosine + SLACK)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = np.array(whole.column("dims").to_numpy())
            for d in np.unique(dims).tolist():
                mine = whole.filter(pa.array(dims == d))
                for at in range(0, mine.num_rows, 2048):
                    batch = mine.slice(at, 2048)
                    y = _unit(matrix(batch.column("vec"))) @ rotation(d)
                    for block, ((a, _), budget) in enumerate(zip(block_bounds(d), _budgets(d, cosine))):
                        cell = np.floor(y[:, a] / (np.sqrt(budget) * (1 + 1e-6))).astype(np.int32)
                        for guest in (0, 1):
                            rows = batch.num_rows
                            yield pa.RecordBatch.from_arrays(
                                [*(batch.column(c) for c in ("label", "dims", "rep", "copies", "vec")), pa.array(np.full(rows, block, np.int32)),
                                 pa.array(cell + np.int32(guest)), pa.array(np.full(rows, guest, np.int32))],
                                names=["label", "dims", "rep", "copies", "vec", "block", "cell", "guest"],
                            )

    return run


class _Forest:
    """Union-find over the vectors of one piece of work; the root is the smallest of its tree."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def _links_of(rows: pa.Table, cosine: float) -> list[tuple]:
    """(vector, linked copies) rows and (vector, vector it is connected with) rows of one pair of chunks."""
    dims, block = rows.column("dims")[0].as_py(), rows.column("block")[0].as_py()
    rep, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
    guest, mine = rows.column("guest").to_numpy(), rows.column("chunk").to_numpy()
    one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
    bounds, budgets, turn = block_bounds(dims), _budgets(dims, cosine), rotation(dims)
    x = to_power(matrix(rows.column("vec")))
    unit = _unit(x)
    by = np.argsort(rep, kind="stable")  # the root of a tree is its smallest number
    rep, copies, guest, mine, x, unit = (v[by] for v in (rep, copies, guest, mine, x, unit))
    part = unit @ turn[:, bounds[block][0] : bounds[block][1]]
    norms, squares = np.sqrt(np.einsum("ij,ij->i", x, x)), (part * part).sum(1)
    left, right = np.flatnonzero(mine == one), np.flatnonzero(mine == two)
    linked, forest = np.zeros(len(rep), dtype=np.int64), _Forest(len(rep))
    for a in range(0, len(left), 512):
        i = left[a : a + 512]
        near = squares[i, None] + squares[right] - 2 * part[i] @ part[right].T <= budgets[block] + SLACK
        near &= (guest[i, None] + guest[right]) < 2  # two guests meet where they are at home
        near &= (i[:, None] < right) if one == two else True
        at, to = np.nonzero(near)
        for b in range(0, len(at), 65536):
            p, q = i[at[b : b + 65536]], right[to[b : b + 65536]]
            cos = np.einsum("ij,ij->i", x[p], x[q]) / (norms[p] * norms[q])
            sure = cos >= cosine
            p, q = p[sure], q[sure]
            apart = np.einsum("ij,jk->ik", unit[p] - unit[q], turn) ** 2
            seen = np.stack([apart[:, s:e].sum(1) for s, e in bounds], axis=1) <= budgets
            first = seen.argmax(axis=1) == block
            p, q = p[first], q[first]
            np.add.at(linked, p, copies[q])
            np.add.at(linked, q, copies[p])
            for m, n in zip(p.tolist(), q.tolist()):
                forest.join(m, n)
    some = np.flatnonzero(linked)
    edges = [(int(rep[m]), int(rep[forest.root(m)]), 0) for m in some.tolist() if rep[m] != rep[forest.root(m)]]
    return edges + [(int(r), None, int(n)) for r, n in zip(rep[some], linked[some])]


def _compare(cosine: float):
    keys = ["label", "dims", "block", "cell", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64()]
        for rows in tk.runs(batches, keys):
            if rows.num_rows < 2:
                continue
            found = _links_of(rows, cosine)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["a", "b", "n"])

    return run


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label (not null) and one length link from a cosine of ``cosine``, in
    double precision.  ``n_links`` counts other rows, ``component_id`` is the smallest id
    that links reach, ``kept`` says whether that is the row's own.  Vectors that are
    null, empty, zero or not finite, and rows with a null label, link with nothing: 0
    links, their own id, kept.  Rows with a null id link too; their component is null if
    no id is reached, ``kept`` always.  An id may repeat with different vectors.  Equal
    rows link with each other; extra columns are ignored; an empty table gives no rows.
    """
    given = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), F.col(label_col).cast("long").alias("label")
    )
    fit = F.col("label").isNotNull() & usable("vec")
    given = given.withColumn("vec", F.when(fit, F.col("vec")))
    classes = given.where("vec is not null").groupBy("label", "vec").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # classes are numbered, as ids may repeat or be null
    classes = phase(classes.withColumns({"dims": F.size("vec"), "rep": F.monotonically_increasing_id()}), "vector-classes")
    schema = "label long, dims int, rep long, copies long, vec array<{}>, block int, cell int, guest int".format(
        dict(classes.dtypes)["vec"].removeprefix("array<").removesuffix(">"))
    placed = classes.select("label", "dims", "rep", "copies", "vec").mapInArrow(_cells(cosine), schema)
    cell = ["label", "dims", "block", "cell"]
    dense = placed.groupBy(*cell).count().where(F.col("count") > CHUNK)
    dense = dense.select(*cell, F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    work = placed.join(dense, cell, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    work = work.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("chunks")).cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    work = work.withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")}).drop("chunks", "other")
    keys = [*cell, "one", "two"]
    found = work.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(cosine), "a long, b long, n long")
    found = phase(found, "vector-links")

    linked = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "rep")
    smallest = labels.join(classes, "rep").groupBy("component").agg(F.min("first_id").alias("smallest_id"))
    named = labels.join(smallest, "component").select("rep", "smallest_id")
    summary = classes.join(linked, "rep", "left").join(named, "rep", "left").select(
        "label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("smallest_id", "first_id").alias("component_id"),
    )
    out = given.join(summary, ["label", "vec"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("id") == component).alias("kept"),
    )
