"""N-gram Jaccard join by parity sketches.

A text's set of word shingles is hashed into blocks; the sketch of a block is the XOR
of its shingles' hashes, so one shingle in one set only changes one block.  The number
of unequal blocks is therefore at most the size of the symmetric difference.

Two sets of similarity ``t`` or more, the smaller of size ``s``, differ in at most
``d = s (1 - t) / t`` shingles.  With ``d + 1`` blocks at least one is equal: the
pigeonhole join is an equality join on (band, block, sketch).  Bands are ranges of set
size with ratio ``1 / t``, so partners lie in the same band or in neighbours; every text
is entered in its own band and the one below, with the block count of that band.

Work is done on classes of equal sets.  Classes that share a key are first compared
with the smallest and the largest class of the key; components of the links found so far
then tell which pairs of a key are still open, and all of those are compared too, by a
finer sketch whose Hamming distance bounds the difference from below and then in full.
Links are only ever accepted on the whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textkernels as tk
from pulsegrid.llm.components import components
from pulsegrid.llm.phases import phase

# From this number of blocks on, blocks of fewer than FULL_BLOCK shingles are not entered: with so many blocks a pair
# at the threshold has about a third of them equal, and that all of those are that small has a probability below 1e-9.
MANY_BLOCKS, FULL_BLOCK = 60, 3

# Rows of a key that are compared at once.
CHUNK = 1024

_TEXTS = "fp long, n_shingles long, text string, sketch binary"
_SKETCHED = "id long, text_hash long, n_shingles long, fp long, keys array<long>"
_VERIFIED = "fp_a long, fp_b long, shared long, n_a long, n_b long"


def band_table(threshold: Fraction, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """First set size of each band, and its number of blocks.

    A pair found in a band has its smaller set there, below the first size of the next.
    """
    starts = [1]
    while starts[-1] <= largest:
        starts.append(math.floor(starts[-1] / threshold) + 1)
    starts.append(math.floor(starts[-1] / threshold) + 1)
    most = [math.floor((after - 1) * (1 - threshold) / threshold) for after in starts[1:]]
    return np.array(starts[:-1], dtype=np.int64), np.array(most, dtype=np.int64) + 1


def block_keys(grams: np.ndarray, bounds: np.ndarray, bands: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set in the bands given for it, and the set each key belongs to.  ``grams`` is sorted within a set."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    count = blocks[owner].astype(np.uint64)
    block = ((grams >> np.uint64(32)) * count >> np.uint64(32)).astype(np.int64)
    offset = np.concatenate(([0], np.cumsum(blocks)))
    slot = offset[:-1][owner] + block
    sketch = np.zeros(offset[-1], dtype=np.uint64)
    filled = np.zeros(offset[-1], dtype=np.int64)
    if len(slot):
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        sketch[slot[first]] = np.bitwise_xor.reduceat(tk.mix(grams, 7), first)
        filled[slot[first]] = np.diff(np.concatenate((first, [len(slot)])))
    of = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(offset[-1]) - offset[:-1][of]
    place = tk.mix(bands[of].astype(np.uint64) << np.uint64(32) | number.astype(np.uint64), 8)
    keep = (blocks[of] < MANY_BLOCKS) | (filled >= FULL_BLOCK)
    return tk.mix(sketch ^ place, 9)[keep], of[keep]


def _sketch(k: int, threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, blocks = band_table(threshold, 1)
        for whole in batches:
            for batch in tk.text_slices(whole, "text"):
                grams, bounds = tk.shingle_sets(*tk.column_bytes(batch.column("text")), k)
                sizes = np.diff(bounds)
                if len(sizes) and sizes.max() >= starts[-2]:
                    starts, blocks = band_table(threshold, int(sizes.max()) * 2)
                # one 64-bit number for the whole set, from its size, sum and XOR
                total = tk.reduce_ranges(np.add, tk.mix(grams, 3), bounds)
                parity = tk.reduce_ranges(np.bitwise_xor, tk.mix(grams, 4), bounds)
                fp = tk.mix(tk.mix(total, 5) ^ parity * np.uint64(0xD6E8FEB86659FD93) ^ sizes.astype(np.uint64), 6)
                own = np.maximum(np.searchsorted(starts, sizes, side="right") - 1, 0)
                found = []
                for band, some in ((own, sizes > 0), (own - 1, (sizes > 0) & (own > 0))):
                    # sets of one shingle link with equal sets only, which are one class
                    counts = np.where(some & (sizes > 1), blocks[np.maximum(band, 0)], 0)
                    used = np.repeat(counts > 0, sizes)
                    inner = np.concatenate(([0], np.cumsum(np.where(counts > 0, sizes, 0))))
                    found.append(block_keys(grams[used], inner, np.maximum(band, 0), counts))
                keys = np.concatenate([x for x, _ in found])
                of = np.concatenate([x for _, x in found])
                order = np.argsort(of, kind="stable")
                ends = np.searchsorted(of[order], np.arange(len(sizes) + 1))
                listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("text_hash"), pa.array(sizes.astype(np.int64)), pa.array(fp.view(np.int64)), listed],
                    names=["id", "text_hash", "n_shingles", "fp", "keys"],
                )

    return run


def _verify(k: int, threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.text_slices(whole, "text_a"):
                a, at_a = tk.shingle_sets(*tk.column_bytes(batch.column("text_a")), k)
                b, at_b = tk.shingle_sets(*tk.column_bytes(batch.column("text_b")), k)
                shared = np.zeros(batch.num_rows, dtype=np.int64)
                for i in range(batch.num_rows):
                    one, two = a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]
                    if len(one) and len(two):
                        place = np.searchsorted(one, two)
                        place[place == len(one)] = 0
                        shared[i] = np.count_nonzero(one[place] == two)
                n_a, n_b = np.diff(at_a), np.diff(at_b)
                linked = (shared > 0) & (
                    threshold.denominator * shared >= threshold.numerator * (n_a + n_b - shared)
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("fp_a").filter(pa.array(linked)), batch.column("fp_b").filter(pa.array(linked))]
                    + [pa.array(x[linked].astype(np.int64)) for x in (shared, n_a, n_b)],
                    names=["fp_a", "fp_b", "shared", "n_a", "n_b"],
                )

    return run


def _fine_sketch(k: int):
    """Add a parity sketch of 8 to 16 bits per shingle, one bit flipped by each; halves XOR to the next smaller sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.text_slices(whole, "text"):
                grams, bounds = tk.shingle_sets(*tk.column_bytes(batch.column("text")), k)
                place, sketches = tk.mix(grams, 11), []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    bits = 64 << max(0, (b - a - 1).bit_length() - 3)
                    odd = np.bincount((place[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                    sketches.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketches, pa.binary())], names=[*batch.schema.names, "sketch"])

    return run


def _close_sketches(threshold: Fraction):
    """Of the rows of each (key, chunk pair): pairs in different parts whose sketches do not rule a link out."""
    share = (1 - threshold) / (1 + threshold)

    def compare(rows: pa.Table) -> list[np.ndarray]:
        fp, part, size, mine = (rows.column(x).to_numpy() for x in ("fp", "part", "n_shingles", "chunk"))
        raw = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in rows.column("sketch")]
        words = min(map(len, raw))
        sketch = np.stack([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in raw])
        one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
        pairs = []
        for i in np.flatnonzero(mine == one).tolist():
            js = np.flatnonzero((mine == two) & (part != part[i]) & ((fp > fp[i]) | (one != two)))
            apart = np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            js = js[apart * share.denominator <= (size[js] + size[i]) * share.numerator]
            if len(js):
                pairs.append(np.stack((np.minimum(fp[js], fp[i]), np.maximum(fp[js], fp[i]))))
        return pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for rows in tk.runs(batches, ["key", "one", "two"]):
            held += compare(rows)
            if sum(x.shape[1] for x in held) > 100_000:
                yield _pair_batch(held)
                held = []
        yield _pair_batch(held)

    return run


def _pair_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["fp_a", "fp_b"])


def _open_pairs(joint: DataFrame, labels: DataFrame, texts: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs of classes that share a key, lie in different components and may be similar.

    The rows of a key are cut into chunks and each pair of chunks is one piece of work,
    so a key with very many rows is spread over tasks.
    """
    named = labels.withColumnRenamed("node", "fp")
    rows = joint.join(named, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("part"))
    split = rows.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("n"))
    split = split.where("p != q and n > 2").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = rows.join(split, "key").join(texts.select("fp", "n_shingles", "sketch"), "fp")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")}).drop("other", "chunks")
    dealt = rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    return dealt.mapInArrow(_close_sketches(threshold), "fp_a long, fp_b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """The pairs of classes whose texts are similar enough."""
    size_a, size_b = F.col("size_a"), F.col("size_b")
    near = F.greatest(size_a, size_b) * threshold.numerator <= F.least(size_a, size_b) * threshold.denominator
    side = {x: texts.select(F.col("fp").alias(f"fp_{x}"), F.col("text").alias(f"text_{x}"), F.col("n_shingles").alias(f"size_{x}"))
            for x in "ab"}
    both = pairs.join(side["a"], "fp_a").join(side["b"], "fp_b").where(near)
    return both.select("fp_a", "fp_b", "text_a", "text_b").mapInArrow(_verify(k, threshold), _VERIFIED)


def jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, threshold: Fraction = Fraction(9, 10)
) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id``, ``links``, ``text_hash`` and ``group_key``.

    Links join texts whose k-word shingle sets have Jaccard similarity of at least
    ``threshold``; ``component_id`` is the smallest id that links reach.  ``links`` is
    the number of other classes of equal sets this row's class was linked to.  ``text_hash`` is the
    xxhash64 of the text; rows of one component, with or without ids, share a ``group_key`` (null for an empty set).

    Null and empty texts, and texts of separators only, have an empty set, link with
    nothing and are their own component.  Repeated rows are kept; equal texts link.
    Rows with a null id keep a null component unless they link with rows that have one;
    links through them count.  An id may repeat with different texts.  Other columns of
    ``docs`` are ignored.  An empty table gives no rows.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    sketched = phase(given.mapInArrow(_sketch(k, threshold), _SKETCHED), "sketches")
    some = sketched.where("n_shingles > 0")
    # The text of a class is that of its row of smallest id, known by the id and the hash, as ids may repeat or be null.
    classes = some.groupBy("fp").agg(
        F.min("id").alias("first_id"), F.min("n_shingles").alias("n_shingles"),
        F.coalesce(F.min_by("text_hash", "id"), F.min("text_hash")).alias("first_hash"),
    )

    # Keys are combined per class before they are shuffled: copies of a text add no rows.
    keys = some.select(F.explode("keys").alias("key"), "fp")
    ends = keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high")
    joint = phase(keys.join(ends, "key").distinct(), "joint-keys")

    wanted = joint.select("fp").distinct()
    chosen = classes.join(wanted, "fp")
    row = given["id"].eqNullSafe(chosen["first_id"]) & (given["text_hash"] == chosen["first_hash"])
    texts = given.join(chosen, row).select("fp", "n_shingles", "text").dropDuplicates(["fp"])
    texts = phase(texts.mapInArrow(_fine_sketch(k), _TEXTS), "joint-texts")

    ends = F.array(F.struct(F.col("low").alias("end"), F.col("fp")), F.struct(F.col("high").alias("end"), F.col("fp")))
    first = joint.select(F.explode(ends).alias("p")).where("p.end != p.fp")
    first = first.select(F.least("p.end", "p.fp").alias("fp_a"), F.greatest("p.end", "p.fp").alias("fp_b")).distinct()
    links = phase(_verified(first, texts, k, threshold), "links").select("fp_a", "fp_b")
    labels = phase(components(links, "fp_a", "fp_b"), "components")

    # What is left: all pairs of a key whose classes are still in different components.
    late = _open_pairs(joint, labels, texts, threshold).distinct()
    links = links.unionByName(phase(_verified(late, texts, k, threshold), "links").select("fp_a", "fp_b")).distinct()
    labels = components(links, "fp_a", "fp_b")

    ends = links.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    member = labels.withColumnRenamed("node", "fp").join(classes, "fp")
    smallest = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").join(smallest, "component", "left")
    of_class = of_class.join(ends, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("component", "fp").alias("group_key"),
    )
    rows = sketched.select("id", "n_shingles", "text_hash", F.when(F.col("n_shingles") > 0, F.col("fp")).alias("fp"))
    return rows.join(of_class, "fp", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), "text_hash", "group_key",
    )
