"""License scan: winnowed fingerprints of templates pick candidates, banded alignment measures them.

The templates are a bounded parameter.  Their word k-grams are winnowed (of each window
of consecutive k-grams the one of smallest hash is kept) into an inverted index from
fingerprint to (template, position).  Every k-gram of a document is looked up; each
diagonal with hits is a candidate, which a local alignment of words within a band
around the diagonal measures: matched words, coverage of the template and the span.
What a place leaves of the text is searched again, so notices in a row are all found.
One pass over whole texts, no shuffle.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textkernels as tk

# Wording of public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
}

_MATCHES = "doc_id long, license string, n_matched long, coverage double, span_start long, span_end long"


class TemplateIndex:
    """Word hashes of the templates and the inverted index of their winnowed k-grams."""

    def __init__(self, templates: dict[str, str], k: int, window: int):
        self.k = k
        self.names, self.words = list(templates), []
        postings: dict[int, list[tuple[int, int]]] = {}
        for number, text in enumerate(templates.values()):
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            starts, ends, _ = tk.words(data, np.array([0, len(data)]), tk.is_word(data))
            hashes = tk.range_hashes(tk.lower_ascii(data), starts, ends)
            self.words.append(hashes.tolist())
            grams = gram_hashes(hashes, k)
            for a in range(max(1, len(grams) - window + 1) if len(grams) else 0):
                part = grams[a : a + window]
                at = a + int(np.flatnonzero(part == part.min())[-1])
                entry = postings.setdefault(int(grams[at]), [])
                if (number, at) not in entry:
                    entry.append((number, at))
        self.postings = postings
        self.prints = np.array(sorted(postings), dtype=np.uint64)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive words."""
    out = np.zeros(max(0, len(hashes) - k + 1), dtype=np.uint64)
    for j in range(k):
        out = tk.mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)], 21)
    return out


def align(template: list[int], text: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """Best local alignment with text position = template position + diagonal, plus or minus ``band``.

    Match 2, mismatch and gap -1.  Returns matched words, first and last text word + 1.
    """
    best, empty = (0, 0, 0, 0), (0, 0, -1)
    above: dict[int, tuple[int, int, int]] = {}
    for j, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for i in range(max(0, j + diagonal - band), min(len(text), j + diagonal + band + 1)):
            score, matched, start = above.get(i - 1, empty)
            if text[i] == word:
                cell = (score + 2, matched + 1, start if start >= 0 else i)
            else:
                cell = max((score - 1, matched, start), _less(above.get(i, empty)), _less(row.get(i - 1, empty)))
                if cell[0] <= 0:
                    cell = empty
            row[i] = cell
            if cell[0] > best[0] and text[i] == word:
                best = (cell[0], cell[1], cell[2], i + 1)
        above = row
    return best[1], best[2], best[3]


def _less(cell: tuple[int, int, int]) -> tuple[int, int, int]:
    return cell[0] - 1, cell[1], cell[2]


def _diagonals(hits: list[tuple[int, int, int]]) -> dict[int, dict[int, list[int]]]:
    """Per template and diagonal the text positions of the hits (position in the text, template, position in it)."""
    out: dict[int, dict[int, list[int]]] = {}
    for i, number, j in hits:
        out.setdefault(number, {}).setdefault(i - j, []).append(i)
    return out


def _places(template: list[int], text: np.ndarray, diagonals: dict[int, list[int]], k: int, band: int, least: float) -> list[tuple[int, int, int]]:
    """All places of a template in a text as (start, end, matched words), none overlapping another, sorted.

    Exact copies are taken first, then the alignment with most matched words; what it leaves
    of the text around its diagonal is searched again.
    """
    size, need = len(template), least * len(template)
    taken, out, heap = bytearray(len(text)), [], []
    whole = np.array(template, dtype=np.uint64)

    def take(start: int, end: int, matched: int) -> None:
        taken[start:end] = b"\x01" * (end - start)
        out.append((start, end, matched))

    def search(diagonal: int, low: int, high: int) -> None:
        """Best alignment in each stretch of the text from ``low`` to ``high`` that is not taken."""
        while (a := taken.find(0, low, high)) >= 0:
            b = taken.find(1, a, high)
            low = b if b >= 0 else high
            if low - a >= need:
                matched, start, end = align(template, text[a:low].tolist(), diagonal - a, band)
                if matched:
                    heappush(heap, (-matched, end - start, a + start, diagonal, a, low))

    order = sorted(diagonals)
    for d in order:
        if 0 <= d <= len(text) - size and 1 not in taken[d : d + size] and np.array_equal(text[d : d + size], whole):
            take(d, d + size, size)
    for d in order:
        if any(0 in taken[i : i + k] for i in diagonals[d]):
            search(d, max(0, d - band), min(len(text), max(0, d) + size + band))
    while heap:
        matched, length, start, d, low, high = heappop(heap)
        if 1 in taken[start : start + length]:
            search(d, low, high)
            continue
        if -matched >= need:
            take(start, start + length, -matched)
        search(d, low, start)
        search(d, start + length, high)
    return sorted(out)


def _longer(places: dict[int, list[tuple[int, int, int]]], start: int, end: int, matched: int) -> bool:
    """Whether the span lies in one with more matched words; the places of one template do not overlap."""
    for found in places.values():
        at = bisect_right(found, start, key=lambda p: p[0]) - 1
        if at >= 0 and end <= found[at][1] and found[at][2] > matched:
            return True
    return False


def _scan(templates: dict[str, str], k: int, window: int, band: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, k, window)
        for whole in batches:
            for batch in tk.text_slices(whole, "text"):
                yield _scan_slice(batch, index, band, least)

    return run


def _scan_slice(batch: pa.RecordBatch, index: TemplateIndex, band: int, least: float) -> pa.RecordBatch:
    data, offsets = tk.column_bytes(batch.column("text"))
    starts, ends, first = tk.words(data, offsets, tk.is_word(data))
    hashes = tk.range_hashes(tk.lower_ascii(data), starts, ends)
    grams = gram_hashes(hashes, index.k)
    known = np.zeros(len(grams), dtype=bool)
    if len(index.prints) and len(grams):
        place = np.searchsorted(index.prints, grams)
        place[place == len(index.prints)] = 0
        known = index.prints[place] == grams
    hits: dict[int, list[tuple[int, int, int]]] = {}
    for at in np.flatnonzero(known).tolist():
        row = int(np.searchsorted(first, at, side="right")) - 1
        if at + index.k <= first[row + 1]:  # the k words stand in one text
            found = hits.setdefault(row, [])
            found += [(at - int(first[row]), number, j) for number, j in index.postings[int(grams[at])]]
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if hits else None
    rows = []
    for row, found in hits.items():
        a, b = int(first[row]), int(first[row + 1])
        places = {
            number: _places(index.words[number], hashes[a:b], diagonals, index.k, band, least)
            for number, diagonals in _diagonals(found).items()
        }
        base = points[offsets[row]]
        for number, start, end, matched in sorted((number, *p) for number, ps in places.items() for p in ps):
            if _longer(places, start, end, matched):  # part of a longer notice
                continue
            rows.append((
                batch.column("doc_id")[row].as_py(), index.names[number], matched, matched / len(index.words[number]),
                int(points[starts[a + start]] - base), int(points[ends[a + end - 1]] - base),
            ))
    columns = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    names = ["doc_id", "license", "n_matched", "coverage", "span_start", "span_end"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def license_spans(
    docs: DataFrame, templates: dict[str, str] | None = None, k: int = 3, window: int = 2, band: int = 6,
    least_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per license notice found: id, ``license``, ``n_matched`` words, ``coverage`` of the template, span.

    Spans are in code points, the end exclusive; words are runs of letters and digits,
    compared without case (A-Z).  Texts without a match, null and empty texts give no
    rows.  A template of fewer than ``k`` words is never found.  All places of a notice
    that do not overlap are reported, also back to back; of overlapping ones that with more
    matched words.  A match inside the span of another notice with more matched words is
    left out.  Rows are independent, so repeated rows repeat their matches; other columns
    are ignored.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chosen = TEMPLATES if templates is None else templates
    return given.mapInArrow(_scan(chosen, k, window, band, least_coverage), _MATCHES).withColumnRenamed("doc_id", id_col)
