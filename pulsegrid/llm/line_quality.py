"""Quality of documents by the lines they share with others of their host.

A pass over the texts leaves, per document, its counts and for each of its lines a key (a
64-bit hash of the host and the normalised line) with the line's words.  Keys are counted
over the documents of a host; lines of keys above the limits are removed, and a document
with too little left is rejected.

Rows of a key are combined before they are shuffled, so a line that every document has is
as cheap as any other.  Distinct documents are counted only for keys with enough rows.  The
keys above the limits go to the documents' lines by broadcast while their number, which is
counted, stays below ``BROADCAST_KEYS``; beyond it they are joined on (key, salt).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import grams as g
from pulsegrid.llm import textkernels as tk
from pulsegrid.llm.phases import phase

# A line goes if more than this many documents of its host have it, and more than this share of them.
LEAST_DOCUMENTS, HOST_SHARE = 20, 0.01
# A document is rejected if less than this many words or less than this share of its words is left.
LEAST_WORDS_LEFT, LEAST_SHARE_LEFT = 50, 0.3
# Keys (8 bytes each) that may be broadcast.
BROADCAST_KEYS = 500_000
SALTS = 64

SYMBOLS = b"#*$%&|<>"

_SCANNED = (
    "doc_id long, host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lines array<struct<key:long,words:int>>"
)


def repeated_words(ids: np.ndarray, first: np.ndarray, window: int = 3) -> np.ndarray:
    """Per text the number of words in windows of that many words (2 or more) that it has at least twice."""
    found = g.pairs(ids, first)
    while found.length < window:
        found = found.longer(min(found.length, window - found.length))
    ends = found.at[found.repeated]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, ends - window + 1, 1)
    np.add.at(change, ends + 1, -1)
    covered = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    return np.diff(np.searchsorted(covered, first))


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between line feeds, and the number of each text's first line (``len + 1``)."""
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate((feeds + 1, offsets[:-1]))
    # at one byte, what follows a line feed belongs to an earlier text than those that start there
    order = np.argsort(starts, kind="stable")
    starts, first = starts[order], np.flatnonzero(order >= len(feeds))
    ends = np.concatenate((starts[1:] - 1, offsets[-1:])) if len(starts) else starts
    last = np.concatenate((first[1:] - 1, [len(starts) - 1])) if len(first) else first
    ends[last] = offsets[1:]
    return starts, ends, np.concatenate((first, [len(starts)]))


def earlier_lines(ids: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """Per text the number of lines that equal an earlier line of it."""
    if not len(ids):
        return np.zeros(texts, np.int64)
    order = np.lexsort((ids, of))
    same = (ids[order][1:] == ids[order][:-1]) & (of[order][1:] == of[order][:-1])
    return np.bincount(of[order][1:][same], minlength=texts)


def normalised_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of words ``bounds[i]:bounds[i + 1]``: A-Z as a-z, any digit as 0, white space as one space."""
    plain = tk.lower_ascii(data)
    plain[(plain >= 48) & (plain <= 57)] = 48
    hashes = tk.range_hashes(plain, starts, ends)
    return tk.sequence_hashes(hashes, bounds)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, bool)
    symbol[np.frombuffer(SYMBOLS, np.uint8)] = True
    for whole in batches:
        for batch in tk.text_slices(whole, "text"):
            texts = batch.num_rows
            data, offsets = tk.column_bytes(batch.column("text"))
            starts, ends, first = tk.words(data, offsets)

            def per_text(marked: np.ndarray) -> np.ndarray:
                return np.diff(np.searchsorted(np.flatnonzero(marked), offsets))

            line_starts, line_ends, first_line = line_bounds(data, offsets)
            upto = np.searchsorted(starts, np.concatenate((line_starts, [len(data)])))
            some = np.flatnonzero(np.diff(upto))  # lines with a word
            text_of = np.repeat(np.arange(texts), np.diff(first_line))[some]
            doubles = earlier_lines(g.range_ids(data, line_starts[some], line_ends[some]), text_of, texts)
            hashes = normalised_hashes(data, starts, ends, np.concatenate((upto[some], [len(starts)])))
            host = batch.column("host").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys = tk.mix(hashes ^ tk.mix(host, 11)[text_of], 12)
            # a document's lines of one key become one entry with the words of all
            order = np.lexsort((keys, text_of))
            keys, owner, words = keys[order], text_of[order], np.diff(upto)[some][order]
            new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))) if len(keys) else order
            words = np.add.reduceat(words, new) if len(new) else words
            lines = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner[new], np.arange(texts + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(words.astype(np.int32))], names=["key", "words"]),
            )
            inside = ~tk.is_space(data)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("host"), pa.array(np.diff(first)), pa.array(per_text(inside & (data & 0xC0 != 0x80))),
                    pa.array(per_text(symbol[data])), pa.array(doubles), pa.array(repeated_words(g.range_ids(data, starts, ends), first)), lines,
                ],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )


def scan_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts of every document and the keys of its lines, one numbered ``row`` per row of ``docs``."""
    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(host_col).isNull(), F.col(host_col)).alias("host"),
    )
    return given.mapInArrow(_scan, _SCANNED).withColumn("row", F.monotonically_increasing_id())


def frequent_lines(scanned: DataFrame, least: int = LEAST_DOCUMENTS, share: float = HOST_SHARE) -> DataFrame:
    """(key, n_docs) of the lines that more documents of their host have than both limits allow.

    Rows with one id are one document; a row without an id is a document of its own.
    """
    named = scanned.withColumn("document", F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row")))
    size = scanned.groupBy("host").agg((F.count_distinct("doc_id") + F.count_if(F.col("doc_id").isNull())).alias("host_docs"))
    lines = named.select("host", "document", F.explode("lines.key").alias("key"))
    enough = lines.groupBy("host", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > least)
    limits = enough.join(size, "host").where(F.col("rows") > share * F.col("host_docs")).select("key", "host_docs")
    candidates = phase(limits, "line-candidates")
    counted = joined(lines.select("key", "document"), candidates, candidates.count())
    exact = counted.groupBy("key", "host_docs").agg(F.count_distinct("document").alias("n_docs"))
    return exact.where((F.col("n_docs") > least) & (F.col("n_docs") > share * F.col("host_docs"))).select("key", "n_docs")


def joined(rows: DataFrame, keys: DataFrame, n_keys: int, salt_by: Column | None = None) -> DataFrame:
    """Rows with a key of ``keys`` (each once): broadcast below the bound, else joined on (key, salt) so that hot keys spread."""
    if n_keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), "key")
    salt_by = F.xxhash64("document") if salt_by is None else salt_by
    copies = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(salt_by, F.lit(SALTS)).cast("int")).join(copies, ["key", "salt"]).drop("salt")


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    least: int = LEAST_DOCUMENTS, share: float = HOST_SHARE,
    words_left: int = LEAST_WORDS_LEFT, share_left: float = LEAST_SHARE_LEFT,
) -> DataFrame:
    """Per row of ``docs``: the id, counts of its text, ``n_removed_words``, ``base_failed`` and ``kept``.

    ``word_chars``: code points in words (between spaces and 0x09 to 0x0D); ``n_symbols``: characters of
    ``#*$%&|<>``; ``n_dup_lines``: lines with a word that equal an earlier one; ``n_repeat_words``: words in
    three-word windows found twice or more.  ``base_failed``: fewer than 50 words, or over half of them
    repeat.  ``n_removed_words``: words in lines that more than ``least`` documents and more than the share
    ``share`` of the documents of the host have, compared in lower case with digits as 0.  ``kept``: not
    ``base_failed``, and ``words_left`` words and the share ``share_left`` of the words remain.

    Null and empty texts have no words and fail.  Rows with a null host form one host.  Rows that repeat an
    id are judged each on its text but count as one document; a row with a null id is a document of its
    own.  Other columns are ignored.  An empty table gives no rows.
    """
    scanned = phase(scan_lines(docs, id_col, text_col, host_col), "lines")
    frequent = phase(frequent_lines(scanned, least, share).select("key"), "frequent-lines")
    lines = scanned.select("row", F.explode("lines").alias("line")).select("row", "line.key", "line.words")
    removed = joined(lines, frequent, frequent.count(), F.xxhash64("row")).groupBy("row").agg(F.sum("words").alias("removed"))
    judged = scanned.drop("lines").join(removed, "row", "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("removed")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return judged.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("removed").alias("n_removed_words"), failed.alias("base_failed"),
        (~failed & (left >= words_left) & (left >= share_left * F.col("n_words"))).alias("kept"),
    )
