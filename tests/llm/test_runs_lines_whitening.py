"""Periodic runs, line frequency and whitening against plain code, and their odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pytest

from pulsegrid.llm import exact_spectrum
from pulsegrid.llm.grams import range_ids
from pulsegrid.llm.line_quality import joined, line_bounds, quality
from pulsegrid.llm.periodic_runs import find_runs, periodic_runs
from pulsegrid.llm.queries import QUERIES
from pulsegrid.llm.whitening import whiten

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- periodic runs


def plain_runs(words):
    """Every stretch of one lag that no neighbour extends, kept with its smallest period."""
    best = {}
    for q in range(1, len(words) // 4 + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            end = i
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            if end - (i - q) >= max(6, 4 * q):
                best.setdefault((i - q, end - i + q), q)
            i = end
    return sorted((s, n, q) for (s, n), q in best.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_with_runs(rng, size):
    out = []
    while len(out) < size:
        unit = [rng.choice("abcd") for _ in range(rng.choice((1, 1, 2, 3, 4, 5, 6, 7, 9, 12, 20)))]
        if rng.random() < 0.3:  # periods within a period
            unit = unit * rng.randint(2, 6) + [rng.choice("abcx")]
        stretch = unit * rng.randint(1, 9)
        out += stretch[: rng.randint(1, len(stretch))]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [words_with_runs(rng, rng.choice((0, 5, 30, 200))) if rng.random() < 0.7 else [rng.choice("ab") for _ in range(rng.randint(0, 80))] for _ in range(6)]
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    ids = np.array([ord(w) - 97 for t in texts for w in t], dtype=np.int64)
    start, length, period = find_runs(ids, first)
    want = [(s + f, n, q) for t, f in zip(texts, first.tolist()) for s, n, q in plain_runs(t)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want


def test_runs_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        words = brute.WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = plain_runs(words)
        r = got[i]
        assert (r["n_runs"], r["runs_sha256"]) == (len(runs), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)))
        assert r["collapsed_sha256"] == sha(collapsed(words, runs))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert any(r["n_runs"] for r in got.values())


def test_runs_of_odd_texts(spark):
    long_text = " ".join(["one"] * 300_000) + " end"
    mixed = " ".join(f"w{i % 1000 if i % 2 else 'x'}" for i in range(100_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "é é é é é é"), (4, "a b " * 4), (4, "a b " * 4), (5, long_text), (6, mixed), (7, "a\x00b a\x00b a\x00b a\x00b a\x00b c")]
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, runs int, collapsed string")
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(table).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 6, [(0, 6, 1)], "é"), (4, 8, [(0, 8, 2)], "a b"), (4, 8, [(0, 8, 2)], "a b"),
            (5, 300_001, [(0, 300_000, 1)], "one end"), (6, 100_000, [(0, 100_000, 1000)], " ".join(mixed.split(" ")[:1000])),
            (7, 6, [], "a\x00b a\x00b a\x00b a\x00b a\x00b c"),
        ],
        key=str,
    )
    assert periodic_runs(table.limit(0)).count() == 0


# ---- line frequency


def plain_counts(text):
    text = text or ""
    words = brute.WORD.findall(text)
    seen, doubles = set(), 0
    for line in text.split("\n"):
        if brute.WORD.search(line):
            doubles += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), doubles, len(covered)


def plain_quality(rows, least, share, words_left=50, share_left=0.3):
    """(counts, removed words, base_failed, kept) per row of (id, text, host)."""

    def lines(text):
        for line in (text or "").split("\n"):
            if found := brute.WORD.findall(line):
                yield " ".join(re.sub("[0-9]", "0", brute.ascii_lower(w)) for w in found), len(found)

    docs, having = {}, {}
    for k, (i, text, host) in enumerate(rows):
        name = ("row", k) if i is None else i
        docs.setdefault(host, set()).add(name)
        for line, _ in lines(text):
            having.setdefault((host, line), set()).add(name)
    out = []
    for i, text, host in rows:
        counts = plain_counts(text)
        removed = sum(n for line, n in lines(text) if len(having[host, line]) > max(least, share * len(docs[host])))
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        left = counts[0] - removed
        out.append((i, *counts, removed, failed, not failed and left >= words_left and left >= share_left * counts[0]))
    return out


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept"]


def made_documents(seed):
    rng = random.Random(seed)
    common = [" ".join(rng.choices(["menu", "Home", "über", "12", "über|uns", "<a>"], k=rng.randint(1, 30))) for _ in range(12)]
    rows = []
    for k in range(150):
        lines = []
        for _ in range(rng.randint(0, 12)):
            kind = rng.random()
            if kind < 0.4:
                line = rng.choice(common)
                line = line.upper() if rng.random() < 0.2 and line.isascii() else line.replace("12", str(rng.randint(10, 99)))
            elif kind < 0.5:
                line = rng.choice(["", "  ", "\t"])
            else:
                line = " ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 25)))
            lines += [line] * rng.choice((1, 1, 1, 2))
        rows.append((rng.choice((None, k, k, k, k // 2)), rng.choice(("\n", "\r\n")).join(lines) if rng.random() < 0.95 else None, rng.choice(("a", "a", "b", None))))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("least,share", [(3, 0.0), (2, 0.1), (0, 0.15)])
def test_quality_equals_brute_force(spark, seed, least, share):
    rows = made_documents(seed)
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, row int, key string")
    got = [tuple(r[c] for c in COLUMNS) for r in quality(table, least=least, share=share, words_left=20).collect()]
    assert sorted(got, key=str) == sorted(plain_quality(rows, least, share, 20), key=str)
    assert any(r[6] for r in got) and any(r[-1] for r in got)


def test_quality_query_equals_brute_force(spark):
    got = [tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_line_frequency"](spark, SF).collect()]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(got) == sorted(plain_quality(rows, 20, 0.01))


def test_a_line_of_most_documents_goes_and_depletes_some(spark):
    menu = " ".join(f"menu{i}" for i in range(60))
    rows = [(i, menu + "\n" + " ".join("".join(chr(97 + int(c)) for c in f"{i:02}{k:02}") for k in range(100 if i % 2 else 10)), "h") for i in range(100)]
    got = {r["doc_id"]: r["kept"] for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: bool(i % 2) for i in range(100)}
    # elsewhere the line is rare
    rows = [(i, t, f"h{i}") for i, t, _ in rows]
    assert all(r["kept"] for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_quality_of_odd_tables(spark):
    long_text = "\n".join(f"line{i} of{i} many{i}" for i in range(200_000))
    rows = [(1, None, None), (2, "", "a"), (3, "\n\n \n", "a"), (4, long_text, "a"), (5, "x " * 1_000_000, "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in quality(table).collect())
    assert got == [
        (1, 0, 0, 0, 0, 0, 0, True, False), (2, 0, 0, 0, 0, 0, 0, True, False), (3, 0, 0, 0, 0, 0, 0, True, False),
        (4, *plain_counts(long_text), 0, False, True), (5, 1_000_000, 1_000_000, 0, 0, 1_000_000, 0, True, False),
    ]
    assert quality(table.limit(0)).count() == 0


def test_keys_beyond_the_broadcast_bound_are_joined_with_salts(spark):
    rows = spark.range(5000).selectExpr("id as document", "id % 3 as key")
    keys = spark.createDataFrame([(0,), (2,)], "key long")
    few, many = joined(rows, keys, 2), joined(rows, keys, 10**9)
    assert sorted(map(tuple, few.select("key", "document").collect())) == sorted(map(tuple, many.select("key", "document").collect()))


@pytest.mark.parametrize("texts", [["a\n", "b"], ["a\n", "", "b\nc"], ["", ""], ["\n\n", "\n", "x"], []])
def test_line_bounds(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    starts, ends, first = line_bounds(data, offsets)
    got = [[bytes(data[starts[k] : ends[k]]).decode() for k in range(a, b)] for a, b in zip(first[:-1], first[1:])]
    assert got == [t.split("\n") for t in texts]


def test_range_ids_are_exact():
    data = np.frombuffer(b"ab ab a b", np.uint8)
    ids = range_ids(data, np.array([0, 3, 6, 8]), np.array([2, 5, 7, 9]))
    assert ids[0] == ids[1] and len(set(ids.tolist())) == 3


# ---- whitening


def plain_whitening(vectors, k=16):
    """(n, deviations, explained, covariance of the fit list, x per row) with numpy's eigenvalues."""
    x = [[int(np.floor(64.0 * float(c))) + 1_000_000 for c in v] for v in vectors]
    distinct = sorted({tuple(v) for v in x})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array(distinct, float) - np.array(sums, float) / n
    covariance = centred.T @ centred / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    whitened = (np.array(x, float) - np.array(sums, float) / n) @ basis / np.sqrt(values)
    return n, deviations, values / np.trace(covariance), whitened


def by_component(rows, ids):
    held = {(r["vec_id"], r["component"]): r for r in rows}
    return [[held[i, c] for c in range(1, 17) if (i, c) in held] for i in ids]


def test_whitening_equals_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.collect()
    got = by_component(QUERIES["op12_exact_whitening"](spark, SF).collect(), [r["vec_id"] for r in rows])
    n, deviations, explained, whitened = plain_whitening([r["embedding"] for r in rows])
    assert {len(g) for g in got} == {16} and {r["n"] for g in got for r in g} == {n}
    assert [g[0]["deviation"] for g in got] == deviations
    assert np.allclose([[r["explained"] for r in g] for g in got], explained, rtol=1e-9)
    mine = np.array([[r["whitened"] for r in g] for g in got])
    sign = np.sign((mine * whitened).sum(axis=0))
    assert np.allclose(mine, whitened * sign, atol=1e-8)
    assert {r["identity_error"] for g in got for r in g}.pop() < 1e-10


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    usable = [rng.normal(size=4).round(2).tolist() for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(usable)] + [(i, usable[0]) for i in (100, 100, None)]
    rows += [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (203, [1.0, float("nan"), 2.0, 3.0]), (204, [1.0, float("inf"), 2.0, 3.0])]
    rows += [(300, [1.0, 2.0]), (301, [2.0, 4.0]), (302, [5.0, -1.0]), (400, [7.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, component string").repartition(5)
    got = whiten(table).collect()
    count = {}
    for r in got:
        count[r["vec_id"]] = count.get(r["vec_id"], 0) + 1
    assert count == {**{i: 4 for i in range(40)}, 100: 8, None: 4, 300: 2, 301: 2, 302: 2, 400: 1}
    n, deviations, explained, whitened = plain_whitening([[np.float32(c) for c in v] for v in usable])
    mine = by_component(got, range(40))
    assert {r["n"] for g in mine for r in g} == {n} and [g[0]["deviation"] for g in mine] == deviations
    assert np.allclose([r["explained"] for r in mine[0]], explained, rtol=1e-9)
    (alone,) = [r for r in got if r["vec_id"] == 400]
    assert (alone["n"], alone["deviation"], alone["whitened"], alone["explained"], alone["identity_error"]) == (1, 0, None, None, None)
    assert whiten(table.limit(0)).count() == 0


def test_whitening_of_dependent_and_huge_entries(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-50, 50, size=(30, 2)) / 64
    rows = [(i, [float(a), float(b), float(a + b), 0.25]) for i, (a, b) in enumerate(base)]
    got = by_component(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), range(30))
    assert all([r["whitened"] is None for r in g] == [False, False, True, True] and g[2]["explained"] == 0 for g in got)
    assert got[0][0]["identity_error"] < 1e-10
    huge = [(i, [c * 1e14 for c in v]) for i, v in rows]
    far = by_component(whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect(), range(30))
    assert all(r[0]["deviation"] is None for r in far) and far[0][0]["identity_error"] < 1e-8


@pytest.mark.parametrize("seed", range(5))
def test_characteristic_polynomial_and_roots(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 9))
    y = rng.integers(-9, 10, (int(rng.integers(1, 12)), d)).astype(object)
    matrix = [[int(v) for v in row] for row in y.T.dot(y)]
    polynomial = exact_spectrum.characteristic_polynomial(matrix)
    for x in range(-2, 4):  # the determinant by expansion in fractions
        assert sum(c * x**i for i, c in enumerate(polynomial)) == determinant([[(x if i == j else 0) - matrix[i][j] for j in range(d)] for i in range(d)])
    values = np.linalg.eigvalsh(np.array(matrix, float))
    for at in (0.5, 3.5, 40.5):
        assert exact_spectrum.roots_above(polynomial, int(2 * at), 1) == (values > at).sum()


def determinant(matrix):
    from fractions import Fraction

    rows, out = [[Fraction(v) for v in row] for row in matrix], Fraction(1)
    for k in range(len(rows)):
        pivot = next((i for i in range(k, len(rows)) if rows[i][k]), None)
        if pivot is None:
            return 0
        if pivot != k:
            rows[k], rows[pivot], out = rows[pivot], rows[k], -out
        out *= rows[k][k]
        for i in range(k + 1, len(rows)):
            f = rows[i][k] / rows[k][k]
            rows[i] = [a - f * b for a, b in zip(rows[i], rows[k])]
    return out


def test_equal_eigenvalues_get_a_basis_of_their_space():
    shares, vectors, k = exact_spectrum.leading_components(np.diag([5, 5, 5, 3, 3, 0, 0]).tolist(), 16)
    assert k == 5 and np.allclose(shares, [5 / 21] * 3 + [3 / 21] * 2)
    assert np.allclose(vectors @ vectors.T, np.eye(5)) and np.allclose(vectors[:3, 3:], 0) and np.allclose(vectors[3:, :3], 0)
