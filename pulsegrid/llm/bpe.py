"""BPE encoding by forced boundaries, and decoding.

Two neighbouring bytes that never stand side by side inside a vocabulary token can
never be merged into one: between them every encoding has a boundary.  Texts are cut
there, each distinct fragment of a slice is encoded once, by itself, and the ids are put
back together in order.  Decoding concatenates the bytes of the tokens.

A cut is made only where the tokenizer's own splitting of the text does not look across
it: the left character is no white space (a run of white space is split by what follows)
and the right one is no apostrophe (which may begin a contraction).  Bytes of one
character are never parted.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm import textkernels as tk

_ENCODED = "doc_id long, n_tokens long, n_fragments long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryTokenizer:
    """A byte-level tokenizer file with its table of byte pairs that occur inside tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as file:
            added = {x["id"]: x["content"] for x in json.load(file)["added_tokens"]}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for word, number in vocabulary.items():
            if number in added or any(c not in alphabet for c in word):
                tokens[number] = added.get(number, word).encode()
            else:
                tokens[number] = bytes(alphabet[c] for c in word)
        self.lengths = np.array([len(x) for x in tokens], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.inside = np.zeros((256, 256), dtype=bool)
        for token in tokens:
            if len(token) > 1:
                raw = np.frombuffer(token, dtype=np.uint8)
                self.inside[raw[:-1], raw[1:]] = True

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a certain cut lies before each byte but the first."""
        left, right = data[:-1], data[1:]
        certain = ~self.inside[left, right] & (right != 39) & ((right < 128) | (right >= 192))
        ended = (left < 128) & ~((left >= 9) & (left <= 13)) & ((left < 28) | (left > 32))
        # the last byte of a character of two bytes (from U+00C0) or of a CJK character: no white space among these
        lead2 = np.concatenate(([0], data[:-2]))
        ended |= (left >= 128) & (left < 192) & (lead2 >= 0xC3) & (lead2 <= 0xDF)
        if len(data) > 2:
            lead3 = np.concatenate(([0, 0], data[:-3]))
            ended |= (left >= 128) & (left < 192) & (lead2 >= 128) & (lead2 < 192) & (lead3 >= 0xE4) & (lead3 <= 0xED)
        return certain & ended

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the ``len + 1`` offsets of the texts in them, and the fragments per text."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64), np.zeros(texts, np.int64)
        begin = np.zeros(len(data), dtype=bool)
        begin[1:] = self.cuts(data)
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        lengths = ends - starts
        _, first, which = np.unique(tk.range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        # equal hashes are held against the bytes; on a collision every fragment stands for itself
        same = np.array_equal(lengths, lengths[first][which]) and np.array_equal(
            data, data[np.repeat(starts[first][which] - starts, lengths) + np.arange(len(data))]
        )
        if not same:
            first = which = np.arange(len(starts))
        raw = data.tobytes()
        pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        coded = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        flat = np.fromiter((i for x in coded for i in x), dtype=np.uint32, count=int(sizes.sum()))
        at = np.concatenate(([0], np.cumsum(sizes)))
        number = sizes[which]
        upto = np.concatenate(([0], np.cumsum(number)))
        ids = flat[np.repeat(at[:-1][which] - upto[:-1], number) + np.arange(upto[-1])]
        per_text = np.searchsorted(starts, offsets)
        return ids, upto[per_text], np.diff(per_text)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after the other."""
        number = self.lengths[ids]
        upto = np.concatenate(([0], np.cumsum(number)))
        return self.flat[np.repeat(self.starts[ids] - upto[:-1], number) + np.arange(upto[-1])].tobytes()


_loaded: dict[str, ForcedBoundaryTokenizer] = {}


def tokenizer_at(path: str) -> ForcedBoundaryTokenizer:
    """The tokenizer of a file, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryTokenizer(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id column and ``ids``, the token ids of the whole text.

    Null and empty texts have no ids.  Repeated rows are kept; other columns are
    ignored; a null id stays null.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path)
        for whole in batches:
            for batch in tk.text_slices(whole, "text"):
                ids, at, _ = tokenizer.encode(*tk.column_bytes(batch.column("text")))
                listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed], names=["doc_id", "ids"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode_ids(coded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per row: the id column and ``text`` from ``ids``.  Bytes that are no UTF-8 become U+FFFD; no ids give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path)
        for batch in batches:
            texts = []
            for row in batch.column("ids"):
                ids = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int32)
                texts.append(tokenizer.decode(ids.astype(np.int64)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    given = coded.select(F.col(id_col).cast("long").alias("doc_id"), "ids")
    return given.mapInArrow(run, "doc_id long, text string").withColumnRenamed("doc_id", id_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``n_tokens``, ``n_fragments`` and SHA-256 of the ids (little-endian, 32 bits) and of the text decoded from them.

    One pass without a shuffle.  Null and empty texts have no tokens and the digests
    of no bytes.  Repeated rows are kept; a null id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path)
        for whole in batches:
            for batch in tk.text_slices(whole, "text"):
                ids, at, fragments = tokenizer.encode(*tk.column_bytes(batch.column("text")))
                coded, decoded = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    part = ids[a:b]
                    coded.append(hashlib.sha256(part.astype("<u4").tobytes()).hexdigest())
                    text = tokenizer.decode(part).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(fragments), pa.array(coded), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "n_fragments", "ids_sha256", "decoded_sha256"],
                )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, _ENCODED).withColumnRenamed("doc_id", id_col)
