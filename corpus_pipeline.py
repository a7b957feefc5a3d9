"""Preparing a training corpus: toxic documents out, one of each near-duplicate group, secrets masked, sources mixed, text encoded."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.bpe import encode_digests
from pulsegrid.llm.jaccard_join import jaccard_groups
from pulsegrid.llm.mixing import mix
from pulsegrid.llm.phases import phase
from pulsegrid.llm.secrets import redact_secrets
from pulsegrid.llm.toxicity import drop_toxic

# The stages after toxicity have no statement in SQL either; tests compare them with plain code.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic; same columns."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts (five-word shingles, Jaccard 0.8); same columns.

    It is that of the smallest id, rows without an id after all others; an id may repeat with different texts,
    of which the one with the smaller hash counts first, and rows that repeat id and text leave the first by
    their plain columns.  Texts without words are like nothing: they stay, each once an id.
    """
    groups = jaccard_groups(docs, k=5, threshold=Fraction(8, 10))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    first = groups.where("n_shingles > 0").groupBy("group_key").agg(F.min(rank).alias("first")).select("first.id", "first.hash")
    wordless = groups.where("n_shingles = 0 and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    chosen = first.unionByName(wordless.distinct())
    # the row travels as one value, so that no column of it can clash with those added here
    rows = docs.select("doc_id", F.xxhash64("text").alias("same_text"), F.struct(*docs.columns).alias("row"))
    plain = [F.col(f"row.`{c}`") for c, t in docs.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    order = Window.partitionBy("doc_id", "same_text").orderBy(*plain)
    mine = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("same_text") == F.col("hash"))
    kept = rows.join(chosen, mine, "left_semi").withColumn("at", F.row_number().over(order)).where("at = 1")
    nameless = docs.where("doc_id is null").where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("row.*").unionByName(nameless)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; same columns, ``n_chars`` of the new text where the table has it."""
    masked = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    counted = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(dict(docs.dtypes)["n_chars"])
    return masked.withColumn("n_chars", counted).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; same columns.  Rows that share an id are taken alike."""
    copies = mix(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies"))
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row"))
    taken = rows.join(copies, F.col("id").eqNullSafe(F.col("doc_id")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = phase(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
