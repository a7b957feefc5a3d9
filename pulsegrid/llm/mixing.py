"""Mixing sources to target weights, with column functions only.

Every source gets a target number of words (a share by weight, capped).  Inside a source
documents have unequal expected copies: those of a size class ``c`` (bits of the size)
get ``min(cap, rate * w(c))``, shorter ones more, with the rate that meets the target.
The whole part are certain copies.  The fractional parts are inclusion odds of a Pareto
order sample: documents are ranked by random odds over inclusion odds, and the first
ones are taken until the words left to the source are used up.

The ranking is not sorted by source in one task: ranks fall into bins, sums of the bins
tell which bin holds the end, and only that bin is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.phases import phase

# Copies of a document, and of a source's words, at most.
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
# Bins of the Pareto rank; a bin that holds the end of a sample is sorted as a whole.
BINS = 4096
# Weights 1, 2, 3 in turn for the sources in order.
CYCLE = 3
CLASS_WEIGHT_BASE = 64


def _random(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the key only."""
    digest = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digest, 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: ``source_size``, ``target`` and whether it is capped, from (source, size) rows.

    Sources in code point order, null last, weigh 1, 2, 3 in turn and share all words.
    A target stops at ``CAP`` times its source; the excess goes to the others by weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", ((F.row_number().over(in_order) - 1) % CYCLE + 1).cast("long"))
    # sources stop in the order of size by weight
    fill = Window.orderBy((F.col("source_size") * 1.0 / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = weighed.withColumns({
        "words": F.sum("source_size").over(everything),
        "before": F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "from_here": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    left = (F.col("words") - CAP * F.col("before")) * F.col("weight") * 1.0
    ranked = ranked.withColumn("full", left >= CAP * F.col("source_size") * F.col("from_here") * 1.0)
    spent = F.sum(F.when(F.col("full"), CAP * F.col("source_size")).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(everything)
    share = (F.col("words") - spent) * 1.0 / free * F.col("weight")
    target = F.when(F.col("full"), CAP * F.col("source_size") * 1.0).otherwise(share)
    return ranked.select("source", "source_size", target.alias("target"), "full")


def _expected(classes: DataFrame) -> DataFrame:
    """Expected copies per (source, class) from the words of the class and the source's target."""
    keys = Window.partitionBy("source_key").orderBy(F.col("w").desc())
    classes = classes.withColumns({
        "before": F.coalesce(F.sum("words").over(keys.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "from_here": F.sum(F.col("w") * F.col("words")).over(keys.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    rest = F.col("target") - CAP * F.col("before")
    classes = classes.withColumn("stops", F.col("full") | (rest * F.col("w") >= CAP * F.col("from_here") * 1.0))
    whole = Window.partitionBy("source_key")
    spent = F.sum(F.when(F.col("stops"), CAP * F.col("words")).otherwise(0)).over(whole)
    free = F.sum(F.when(F.col("stops"), F.lit(0)).otherwise(F.col("w") * F.col("words"))).over(whole)
    rate = (F.col("target") - spent) / F.when(free > 0, free)
    copies = F.when(F.col("stops"), F.lit(float(CAP))).otherwise(F.greatest(F.lit(0.0), F.coalesce(rate * F.col("w"), F.lit(0.0))))
    return classes.withColumn("copies", copies)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """Per row of ``docs``: id, ``size`` in words, ``source_size``, ``target``, ``copies`` and ``taken`` words.

    Reruns agree: randomness is a hash of the id.  Null and empty texts have size 0 and
    take no words; a null source is a source of its own; rows with equal ids are drawn
    alike and told apart by size.  Other columns are ignored; an empty table gives no
    rows.  A document is taken ``CAP`` times at most.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sizes = phase(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "sizes")
    # a struct compares equal with nulls in it, so the join needs no null-safe rewrite
    bits = F.length(F.bin("size"))
    rows = sizes.withColumns({"source_key": F.struct("source"), "w": (CLASS_WEIGHT_BASE - bits).cast("long")})
    words = rows.groupBy("source_key", "w").agg(F.sum("size").alias("words"))
    targets = source_targets(sizes).withColumn("source_key", F.struct("source")).drop("source")
    copies = _expected(words.join(targets, "source_key")).select("source_key", "w", "source_size", "target", "copies")
    fraction = F.col("copies") - F.floor("copies")
    u = _random(F.col("id"), seed)
    odds = (u / (1 - u)) / (fraction / (1 - fraction))
    given = rows.join(copies, ["source_key", "w"])
    given = given.withColumn("rank", F.when(fraction > 0, odds)).withColumn("whole", F.floor("copies"))
    given = given.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
    given = phase(given.withColumn("part", fraction * F.col("size")).select(
        "id", "source_key", "size", "source_size", "target", "w", "whole", "rank", "bin"), "ranked")

    # Words that the sample of a source has to bring, from exact sums per class.
    certain = words.join(copies, ["source_key", "w"]).groupBy("source_key", "target").agg(
        F.sum(F.floor("copies") * F.col("words")).alias("certain"))
    wanted = certain.select("source_key", (F.col("target") - F.col("certain")).alias("wanted"))
    bins = given.where("rank is not null").groupBy("source_key", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source_key").orderBy("bin"))
    bins = bins.withColumn("upto", upto).join(wanted, "source_key")
    bins = bins.select("source_key", "bin", (F.col("upto") - F.col("words")).alias("before"), "upto", "wanted")
    placed = given.join(bins, ["source_key", "bin"], "left")
    inside = (F.col("before") < F.col("wanted")) & (F.col("upto") > F.col("wanted"))
    out = ["id", "size", "source_size", "target"]
    clear = placed.where(~F.coalesce(inside, F.lit(False))).select(
        *out, (F.col("whole") + F.coalesce(F.col("upto") <= F.col("wanted"), F.lit(False)).cast("int")).alias("copies"))
    order = Window.partitionBy("source_key", "bin").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where(inside).withColumn("end", F.col("before") + F.sum("size").over(order))
    # the last document is taken if that brings the sum nearer to what is wanted
    last = last.select(*out, (F.col("whole") + (F.col("end") - F.col("size") / 2 <= F.col("wanted")).cast("int")).alias("copies"))
    both = clear.unionByName(last).withColumn("copies", F.col("copies").cast("long"))
    return both.withColumn("taken", F.col("copies") * F.col("size")).withColumnRenamed("id", id_col)
