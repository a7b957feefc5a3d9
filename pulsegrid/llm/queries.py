"""One query per operator, over its whole table."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.jaccard_join import jaccard_groups
from pulsegrid.llm.bpe import encode_digests
from pulsegrid.llm.licenses import license_spans
from pulsegrid.llm.line_quality import quality
from pulsegrid.llm.periodic_runs import periodic_runs
from pulsegrid.llm.whitening import whiten
from pulsegrid.llm.toxicity import toxic_documents
from pulsegrid.llm.mixing import mix
from pulsegrid.llm.secrets import secret_spans
from pulsegrid.llm.url_rules import judge_urls
from pulsegrid.llm.learned_partitions import nearest
from pulsegrid.llm.subspace_dedup import near_duplicates
from pulsegrid.llm.suffix_dedup import remove_repeats
from pulsegrid.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# What links reach, from pairs (a, b) of ids.
_REACHED = """ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reached AS (SELECT a AS id, b AS other FROM ways UNION SELECT r.id, l.b FROM reached r JOIN ways l ON l.a = r.other),
    smallest AS (SELECT id, min(other) AS other FROM reached GROUP BY id)"""


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity groups of all documents at a Jaccard similarity of 0.9 of 3-word shingles."""
    return jaccard_groups(table(spark, sf_dir, "documents"), k=3, threshold=Fraction(9, 10)).drop("text_hash", "group_key")


@query("op8_bpe_forced_boundaries")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the text decoded from them."""
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, with coverage and spans."""
    return license_spans(table(spark, sf_dir, "documents"))


@query("op2_toxicity_chain")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdict of the classifier chain for every document."""
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_secret_entropy_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: pattern kinds and windows of high entropy."""
    return secret_spans(table(spark, sf_dir, "documents"))


@query("op5_url_association_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all page urls."""
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op6_pareto_mixing", f"""
    WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
        ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':1'), 1, 13))::BIGINT AS digest FROM documents),
    totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
      FROM sizes GROUP BY source),
    ranked AS (SELECT *, sum(source_size) OVER () AS words, sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_here,
        coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM totals WINDOW f AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
    filled AS (SELECT *, (words - 3 * before) * weight >= 3 * source_size * from_here AS stopped FROM ranked),
    targets AS (SELECT source, source_size, stopped, CASE WHEN stopped THEN 3 * source_size::DOUBLE ELSE
        (words - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE
          / sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () * weight END AS target FROM filled),
    classes AS (SELECT source, 64 - length(bin(size)) AS w, sum(size) AS words FROM sizes GROUP BY ALL),
    placed AS (SELECT c.*, t.source_size, t.target, t.stopped, sum(w * words) OVER (k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_here,
        coalesce(sum(words) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM classes c JOIN targets t ON t.source IS NOT DISTINCT FROM c.source WINDOW k AS (PARTITION BY c.source ORDER BY w DESC)),
    halted AS (SELECT *, stopped OR (target - 3 * before) * w >= 3 * from_here AS stops FROM placed),
    rates AS (SELECT *, (target - sum(CASE WHEN stops THEN 3 * words ELSE 0 END) OVER s)
        / nullif(sum(CASE WHEN stops THEN 0 ELSE w * words END) OVER s, 0)::DOUBLE AS rate FROM halted WINDOW s AS (PARTITION BY source)),
    expected AS (SELECT *, CASE WHEN stops THEN 3::DOUBLE ELSE greatest(0::DOUBLE, coalesce(rate * w, 0)) END AS copies FROM rates),
    wanted AS (SELECT source, target - sum(floor(copies) * words) AS wanted FROM expected GROUP BY source, target),
    odds AS (SELECT d.doc_id, d.size, e.source, e.source_size, e.target, floor(copies) AS whole, copies - floor(copies) AS f,
        (digest::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
      FROM sizes d JOIN expected e ON e.source IS NOT DISTINCT FROM d.source AND e.w = 64 - length(bin(d.size))),
    drawn AS (SELECT *, CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f)) END AS rank FROM odds),
    binned AS (SELECT *, floor(rank / (1 + rank) * 4096) AS bin FROM drawn),
    bins AS (SELECT source, bin, sum(words) OVER (PARTITION BY source ORDER BY bin) AS upto, words FROM (
      SELECT source, bin, sum(size) AS words FROM binned WHERE rank IS NOT NULL GROUP BY source, bin) b),
    ended AS (SELECT d.*, b.upto, b.upto - b.words AS before, w.wanted, b.upto - b.words + sum(d.size) OVER (PARTITION BY d.source, d.bin
        ORDER BY d.rank, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS reach
      FROM binned d LEFT JOIN bins b ON b.source IS NOT DISTINCT FROM d.source AND b.bin = d.bin JOIN wanted w ON w.source IS NOT DISTINCT FROM d.source),
    taken AS (SELECT *, CAST(whole AS BIGINT) + CASE WHEN rank IS NULL THEN 0 WHEN before < wanted AND upto > wanted THEN
        CAST(reach - size / 2 <= wanted AS BIGINT) ELSE CAST(upto <= wanted AS BIGINT) END AS copies FROM ended)
    SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM taken""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document in the mix of sources."""
    return mix(table(spark, sf_dir, "documents"))


@query("op4_subspace_near_duplicates", f"""
    WITH RECURSIVE fit AS (SELECT vec_id, label, len(embedding) AS dims, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x for x in embedding if x <> 0]) > 0),
    pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fit x JOIN fit y ON x.label = y.label AND x.dims = y.dims AND x.vec_id < y.vec_id
      WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
    {_REACHED},
    links AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id,
      vec_id = least(vec_id, coalesce(other, vec_id)) AS kept
    FROM embeddings LEFT JOIN smallest ON id = vec_id LEFT JOIN links ON links.a = vec_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings of one label at a cosine of 0.93."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_learned_partition_search")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings found for every hundredth."""
    return nearest(table(spark, sf_dir, "embeddings"))


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat strings of 100 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, chosen by the checksum of the id, repeat a part of their words to the end.

    With h = crc32 of the decimal id and g = floor(h / 10), the n words of a text with h % 10 = 0 are, from word
    a = g % n on, the words a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8)).  Rows without an id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1)"))
    )
    periodic = F.expr(
        "array_join(transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')"
    )
    placed = (
        words.withColumn("n", F.size("words"))
        .withColumn("g", F.floor(F.col("h") / 10))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
        .withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    )
    return placed.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of them made periodic, with digests of the runs and of the collapsed texts."""
    found = periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("fine"))))
    longest = found.withColumn("best", best)
    return longest.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.fine")).alias("period"), F.floor(F.col("best.length") * 1000 / -F.col("best.fine")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words",
    )


@query("op12_exact_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the leading components of their exact covariance."""
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op13_line_frequency", f"""
    WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    words AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS w FROM docs),
    windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] for j in range(1, len(w) - 1)]) AS g FROM words),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    repeated AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(3) t(o) GROUP BY doc_id),
    lines AS (SELECT doc_id, source, line, len(regexp_extract_all(line, '{_WORD}')) AS n,
        array_to_string(regexp_extract_all(regexp_replace({_LOWER.format("line")}, '[0-9]', '0', 'g'), '{_WORD}'), ' ') AS plain
      FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{_WORD}')),
    doubles AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
    hosts AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
    frequent AS (SELECT l.source, l.plain FROM lines l JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source
      GROUP BY l.source, l.plain, h.n HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > 0.01::DOUBLE * h.n),
    removed AS (SELECT doc_id, sum(n) AS n FROM lines l JOIN frequent f ON f.source IS NOT DISTINCT FROM l.source AND f.plain = l.plain GROUP BY doc_id),
    counts AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed_words
      FROM words LEFT JOIN doubles d USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN removed x USING (doc_id)),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - n_removed_words AS left_words FROM counts)
    SELECT * EXCLUDE (left_words), NOT base_failed AND left_words >= 50 AND left_words >= 0.3::DOUBLE * n_words AS kept FROM judged""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of all documents; lines are counted over the documents of a source."""
    return quality(table(spark, sf_dir, "documents"))
