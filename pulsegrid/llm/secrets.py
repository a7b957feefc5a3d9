"""Secret scan with column functions only.

Fixed kinds come from patterns.  On top, candidate strings (long runs of key-like
characters) are searched with a sliding window: the counts of its characters are kept
up to date as one enters and one leaves, and with them the sum of n log2 n, from which
the Shannon entropy follows.  Windows at or above the threshold of the candidate's
character class are merged to spans.  Candidates on the allow-list are left out; of
documentation keys only the part that says so, and what stands around it is searched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of the contract in their order, with pattern, group that is measured and its least length.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 3, 8),
    ("access", r"AKIA[A-Z0-9]+", 1, 16),
    ("hex", r"[0-9a-f]{32,}", 1, 32),  # the runs of 32 and more among all maximal runs
]
ENTROPY = "entropy"
WINDOW = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
# Character classes, first match wins: pattern of the whole candidate and least entropy in bits of a window.
CLASSES = [(r"^[0-9a-f]+$", 2.75), (r"^[0-9A-F]+$", 2.75), (r"^[A-Z0-9]+$", 3.2), (r"^[a-z0-9]+$", 3.3), (r"^.*$", 3.4)]
# Never secrets: words, numbers, rules, one repeated character, paths and dashed words.
ALLOWED = [
    r"^[A-Za-z]+$", r"^[0-9]+$", r"^[+/_=-]+$", r"^(.)\1+$",
    # possessive, as the engine keeps a frame for each turn of a group it may come back to
    r"^[/_-]?[A-Za-z]*(?:[/_=-][A-Za-z]*)++$", r"^[/_-]?(?:[A-Za-z]++|[0-9]++)(?:[/_=-](?:[A-Za-z]++|[0-9]++))*+[/_=-]?$",
]
# Neither are documentation keys: each run of letters and digits with this word in it, and keys of several such runs as a whole.
DOCUMENTATION, DOCUMENTATION_KEYS = "example", ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]
# One character of such a run: the first, or the one after another.
_DOCUMENTATION_CHAR = rf"(?i)(?:(?<![A-Za-z0-9])(?=[A-Za-z0-9]*{DOCUMENTATION})|\G(?!^))[A-Za-z0-9]"
# Printable ASCII from '!': the positions of the count array.
_SYMBOLS = 94
# Folds copy their result at every step, so long lists are folded in blocks of so many entries, long candidates in pieces
# of so many characters.
BLOCK, PIECE = 256, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(listed: Column) -> Column:
    """An array, not empty, cut into arrays of ``BLOCK`` entries."""
    last = F.floor((F.size(listed) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(listed, k * BLOCK + 1, F.lit(BLOCK)))


def _spans(text: Column, pattern: str, keep, number: int) -> Column:
    """Non-overlapping matches from the left as (start, kind, end, match); ``keep`` judges (match, measured group)."""
    whole = f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"
    groups = 3 if number == 0 else 1
    matches = F.regexp_extract_all(text, F.lit(whole), F.lit(1))
    measured = F.regexp_extract_all(text, F.lit(whole), F.lit(groups))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # the last piece stands after the last match
    steps = F.zip_with(F.arrays_zip(matches.alias("m"), measured.alias("v")), F.slice(gaps, 1, F.size(matches)),
                       lambda m, g: F.struct(m["m"].alias("m"), m["v"].alias("v"), g.alias("g")))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,match:string>>)")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["g"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["m"].alias("match"))
        found = F.when(keep(x["m"], x["v"]), F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    def block_spans(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("found")), step, lambda s: s["found"])

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, x: n + x["g"] + F.length(x["m"]))

    def whole_list(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, _before(F.transform(blocks, length)), block_spans))

    return F.when(text.rlike(pattern), _let(_blocks(steps), whole_list)).otherwise(empty)


def _before(lengths: Column) -> Column:
    """For each entry the sum of those before it."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("listed"))

    def step(state: Column, n: Column) -> Column:
        return F.struct((state["at"] + n).alias("at"), F.concat(state["listed"], F.array(state["at"])).alias("listed"))

    return F.aggregate(lengths, start, step, lambda s: s["listed"])


def _allowed(candidate: Column, allowed: list[str]) -> Column:
    out = F.lit(False)
    for pattern in allowed:
        out = out | candidate.rlike(pattern)
    return out


def _without_documentation(text: Column) -> Column:
    """The text with blanks in place of documentation keys; all positions stay."""
    out = text
    for key in DOCUMENTATION_KEYS:
        out = F.replace(out, F.lit(key), F.lit(" " * len(key)))
    return F.when(text.rlike(f"(?i){DOCUMENTATION}"), F.regexp_replace(out, _DOCUMENTATION_CHAR, " ")).otherwise(text)


def _entropy_spans(candidate: Column) -> Column:
    """Merged windows of high entropy in one candidate as (start, end)."""
    level = F.lit(None).cast("double")
    for pattern, least in reversed(CLASSES):
        level = F.when(candidate.rlike(pattern), F.lit(least)).otherwise(level)

    def found(level: Column) -> Column:
        last = F.floor((F.length(candidate) - 1) / PIECE).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda k: piece(k * PIECE, F.least(k * PIECE, F.lit(WINDOW - 1)), level))
        return _let(F.flatten(pieces), _merged)

    def piece(at: Column, back: Column, level: Column) -> Column:
        # a piece starts so far back that it has the windows that end in it
        spans = _piece_spans(F.substring(candidate, at - back + 1, back + PIECE), level)
        return F.transform(spans, lambda s: F.struct((s["start"] + at - back).alias("start"), (s["end"] + at - back).alias("end")))

    return _let(level, found)


def _merged(spans: Column) -> Column:
    """Spans by start and end, those that overlap or touch joined."""

    def apart(k: Column) -> Column:
        return F.get(spans, k)["start"] > F.get(spans, k - 1)["end"]

    first = F.filter(spans, lambda s, k: (k == 0) | apart(k))
    last = F.filter(spans, lambda s, k: (k == F.size(spans) - 1) | apart(k + 1))
    return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def _piece_spans(candidate: Column, level: Column) -> Column:
    """Merged windows of high entropy in a string as (start, end), by running counts."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - 33)
    codes = F.filter(codes, lambda c: c >= 0)
    left = F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), codes), F.lit(1), F.size(codes))
    steps = F.zip_with(codes, left, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    table = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)))

    def f(n: Column) -> Column:
        return F.get(table, n)

    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    start = F.struct(
        F.array_repeat(F.lit(0), _SYMBOLS).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"),
        F.lit(-1).alias("a"), F.lit(-1).alias("b"), none.alias("spans"),
    )

    def closed(state: Column) -> Column:
        span = F.struct(state["a"].alias("start"), state["b"].alias("end"))
        return F.when(state["a"] >= 0, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])

    def step(state: Column, c: Column) -> Column:
        x, y, n = c["x"], c["y"], state["n"]
        counts = F.when(x == y, n).otherwise(
            F.transform(n, lambda v, k: v + (k == x).cast("int") - (k == y).cast("int"))
        )
        gone = F.when(y < 0, F.lit(0.0)).otherwise(f(F.get(n, y) - 1) - f(F.get(n, y)))
        total = F.when(x == y, state["s"]).otherwise(state["s"] + f(F.get(n, x) + 1) - f(F.get(n, x)) + gone)
        end = state["i"] + 1
        high = (end >= WINDOW) & (F.round(math.log2(WINDOW) - total / WINDOW, 9) >= level)
        joins = (state["a"] >= 0) & (end - WINDOW <= state["b"])
        return F.struct(
            counts.alias("n"), total.alias("s"), end.alias("i"),
            F.when(high & ~joins, end - WINDOW).otherwise(state["a"]).alias("a"),
            F.when(high, end).otherwise(state["b"]).alias("b"),
            F.when(high & ~joins, closed(state)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(steps, start, step, closed)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(x) for x in [*(k[0] for k in KINDS), ENTROPY]))
    shown = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(shown, ",")


def find_secrets(docs: DataFrame, text_col: str = "text", allowed: list[str] | None = None) -> DataFrame:
    """``docs`` with ``_secrets``: all spans as (start, kind, end) sorted by start, then kind.

    Positions are code points, the end exclusive; kinds are numbered as in ``KINDS``,
    entropy last.  Null and empty texts have no spans.  Rows are independent: repeated
    rows repeat their spans, an empty table gives no rows.  A column named ``_secrets``
    is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = lambda s: F.struct(s["start"], s["kind"], s["end"])
    found = []
    for number, (_, pattern, _, least) in enumerate(KINDS):
        spans = _spans(text, pattern, lambda m, v, least=least: F.length(v) >= least, number)
        found.append(F.transform(spans, plain))
    listed = ALLOWED if allowed is None else allowed
    searched = _without_documentation(text) if allowed is None else text
    candidates = _spans(searched, CANDIDATE, lambda m, v: ~_allowed(m, listed), len(KINDS))
    high = F.flatten(F.transform(candidates, lambda c: F.transform(
        _entropy_spans(c["match"]),
        lambda w: F.struct((c["start"] + w["start"]).alias("start"), c["kind"].alias("kind"), (c["start"] + w["end"]).alias("end")),
    )))
    return docs.withColumn("_secrets", F.array_sort(F.concat(*found, high)))


def _count(spans: str, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: counts per kind, ``base_sha256`` of the fixed kinds' spans, and all ``spans`` as text.

    Null and empty texts have none: counts 0, the digest of nothing, ''.  A null id
    stays null; other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_secrets(given).select("doc_id", "_secrets")
    base = F.filter("_secrets", lambda s: s["kind"] < len(KINDS))
    names = [*(k[0] for k in KINDS), ENTROPY]
    counts = [_count("_secrets", number).cast("long").alias(f"n_{name}") for number, name in enumerate(names)]
    out = found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_secrets")).alias("spans"))
    return out.withColumnRenamed("doc_id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one); same columns.  Null texts stay null."""
    text = F.col("text")

    def cut(state: Column, block: Column) -> Column:
        """The text from where ``state`` stands to the end of a block of spans, masked."""
        low, high = state["at"], F.greatest(state["at"], F.array_max(F.transform(block, lambda s: s["end"])))

        def masked_part(part: Column) -> Column:
            def step(inner: Column, s: Column) -> Column:
                between = F.substring(part, inner["at"] - low + 1, s["start"] - inner["at"])
                fresh = F.struct(F.concat(inner["out"], between, F.lit(mask)).alias("out"), s["end"].alias("at"))
                longer = F.struct(inner["out"].alias("out"), F.greatest(inner["at"], s["end"]).alias("at"))
                return F.when(s["start"] >= inner["at"], fresh).otherwise(longer)

            begin = F.struct(F.lit("").alias("out"), low.alias("at"))
            return F.aggregate(block, begin, step, lambda s: F.struct(F.concat(state["out"], s["out"]).alias("out"), s["at"].alias("at")))

        # a whole part holds few spans, so that no step reads more than the part
        return _let(F.substring(text, low + 1, high - low), masked_part)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate(_blocks(F.col("_secrets")), start, cut, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.lit(2**31 - 1))))
    others = [c for c in docs.columns if c != text_col]
    rest = (F.struct(*others) if others else F.lit(None)).alias("rest")
    found = find_secrets(docs.select(F.col(text_col).alias("text"), rest))
    clean = F.when(F.size("_secrets") > 0, masked).otherwise(text)
    return found.select(*[(clean if c == text_col else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
