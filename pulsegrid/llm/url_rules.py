"""URL filter with column functions only: host and path rules, then mined association rules.

A URL is a set of tokens: scheme, host, host labels, path words, query keys.  FP-growth
over the labelled pages finds token combinations that go with a bad label; combinations
with too little support or confidence are pruned, whatever their length, and so are those
whose bad pages may be chance, and rules that contain a shorter one, which decides alike.  Each rule is entered in an
inverted index under its rarest token, so common tokens bring no rows to the join; a
page is blocked if it has all tokens of a rule.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.phases import phase

# Fixed values: (verdict, host, path) rules of the contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BAD = "label=bad"
# Share of the labelled pages that have the tokens and the bad label, share of bad pages among those with the tokens.
MIN_SUPPORT, MIN_CONFIDENCE = 0.001, 0.6
# Least number of bad pages with the tokens, and the chance that any rule at all holds where tokens say nothing about the label.
LEAST_PAGES, ALPHA = 5, 0.01
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def with_host_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both '' for null urls and those without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(url, _SHAPE, 1), _UPPER, _LOWER),
        "path": F.regexp_extract(url, _SHAPE, 2),
    })


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits as text (null if none does), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _prefixed(prefix: str, parts: Column) -> Column:
    kept = F.filter(parts, lambda x: x != "")
    return F.transform(kept, lambda x: F.concat(F.lit(prefix), x))


def url_tokens(url_col: str = "url") -> Column:
    """Distinct tokens of a URL as an array, from the columns ``host`` and ``path`` and the url."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    scheme = F.array(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    query = F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    keys = F.transform(query, lambda x: F.substring_index(x, "=", 1))
    words = F.filter(F.split("path", r"[^A-Za-z]+"), lambda x: F.length(x) > 1)
    return F.array_distinct(F.concat(
        _prefixed("scheme:", scheme), _prefixed("host:", F.array("host")), _prefixed("label:", F.split("host", r"\.")),
        _prefixed("path:", words), _prefixed("query:", keys),
    ))


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
    least_pages: int = 1, alpha: float | None = None,
) -> DataFrame:
    """(tokens, support, confidence, lift) of the rules ``tokens -> bad`` from rows with ``tokens`` and boolean ``bad``.

    With ``alpha`` a rule must also beat the share of bad pages among all: if that were its own, at most a part
    ``alpha / tested`` of samples would have as many bad pages (Chernoff's bound), where ``tested`` counts all
    combinations with enough pages.  So tables whose labels have nothing to do with their tokens get no rules.
    """
    n, n_bad = labelled.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    items = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    # half a page less, as the share is multiplied by the count and rounded up again
    share = min(1.0, max(min_support, (least_pages - 0.5) / max(n, 1)))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0] == BAD)
    base, confidence = n_bad / max(n, 1), F.col("confidence")
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "support", "confidence", (confidence / F.lit(base)).alias("lift"))
    if alpha is None or not 0 < base < 1:
        return rules if alpha is None else rules.where("false")
    tested = model.freqItemsets.where(~F.array_contains("items", BAD)).count()
    clean = 1 - confidence
    apart = confidence * F.log(confidence / base) + F.when(clean > 0, clean * F.log(clean / (1 - base))).otherwise(0.0)
    pages = F.col("support") * n / confidence
    return rules.where((F.col("lift") > 1) & (pages * apart >= math.log(max(tested, 1) / alpha)))


def _by_rarest(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """The tokens ``needed`` by each rule, under its ``token`` that the fewest of ``sets`` have."""
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").count()
    entries = rules.select("tokens", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token"))
    return entries.groupBy(F.col("tokens").alias("needed")).agg(rarest.alias("token"))


def shortest_rules(rules: DataFrame) -> DataFrame:
    """The rules that contain no shorter one; the same pages have all tokens of one of them."""
    exploded = rules.select("tokens", F.explode("tokens").alias("token"))
    inside = (F.size("needed") < F.size("tokens")) & (F.size(F.array_except("needed", "tokens")) == 0)
    longer = exploded.join(_by_rarest(rules, rules), "token").where(inside).select("tokens").distinct()
    return rules.join(longer, "tokens", "left_anti")


def matched_pages(pages: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids of the pages (id, tokens) that have all tokens of a rule."""
    keyed = pages.select(id_col, "tokens", F.xxhash64("tokens").alias("url_key"))
    # a url may have any number of tokens, so each travels alone and whole sets only for candidates
    entries = keyed.select(id_col, "url_key", F.explode("tokens").alias("token"))
    candidates = entries.join(_by_rarest(rules, pages), "token").select(id_col, "url_key", "needed")
    hits = keyed.join(candidates, [id_col, "url_key"]).where(F.size(F.array_except("needed", "tokens")) == 0)
    return hits.select(id_col).distinct()


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``, ``mined`` (whether a mined rule fits).

    ``labels`` (doc_id, quality, toxic) mark pages of the same id; bad is quality 0 or
    toxic 1, null counts as not bad.  A rule on host and path decides first, the longest
    that fits; else pages with a mined combination are blocked and the others allowed.
    Mined are rules of ``LEAST_PAGES`` bad pages and more that hold at ``ALPHA``.
    Null and broken urls have no tokens and are allowed.  Without labelled pages nothing
    is mined.  Repeated rows are kept and equal ids share the mined verdict; other
    columns are ignored; an empty table gives no rows.
    """
    shaped = with_host_path(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    tokens = shaped.select("id", url_tokens().alias("tokens"))
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    marks = labels.select(F.col("doc_id").alias("id"), bad.alias("bad")).groupBy("id").agg(F.max("bad").alias("bad"))
    labelled = phase(tokens.join(marks, "id").select("tokens", "bad"), "url-labelled")
    mined = shortest_rules(phase(mine_rules(labelled, least_pages=LEAST_PAGES, alpha=ALPHA), "url-rules"))
    hit = matched_pages(tokens, mined, "id").withColumn("mined", F.lit(True))
    name, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    out = shaped.join(hit, "id", "left").withColumn("mined", F.coalesce("mined", F.lit(False)))
    own = F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "mined")
