"""Mined URL rules hold for pages that were not mined, and chance makes none."""

from __future__ import annotations

import math
import random
from itertools import combinations

from pulsegrid.llm.url_rules import ALPHA, LEAST_PAGES, judge_urls, mine_rules

SMALL = "/root/testdata/sf0.001"
PAGES, LABELS = "page_id long, url string", "doc_id long, quality int, toxic int"


def by_counting(rows, support, confidence, least, alpha):
    """Combinations that pass all limits, by counting every one."""
    counts = {}
    for tokens, bad in rows:
        for n in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), n):
                seen = counts.setdefault(part, [0, 0])
                seen[0] += 1
                seen[1] += bad
    floor = max(support * len(rows), least)
    tested = sum(n >= floor for n, _ in counts.values())
    base, found = sum(bad for _, bad in rows) / len(rows), {}
    for part, (n, bad) in counts.items():
        c = bad / n
        if bad < floor or c < confidence or c <= base:
            continue
        apart = c * math.log(c / base) + ((1 - c) * math.log((1 - c) / (1 - base)) if c < 1 else 0)
        if n * apart >= math.log(tested / alpha):
            found[part] = c / base
    return found


def test_rules_equal_counts_of_every_combination(spark):
    rng = random.Random(11)
    rows = [rng.sample("abcdefgh", rng.randint(1, 5)) for _ in range(600)]
    rows = [(t, rng.random() < (0.95 if {"a", "b"} <= set(t) else 0.2)) for t in rows]
    table = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = {tuple(r["tokens"]): r["lift"] for r in mine_rules(table, least_pages=LEAST_PAGES, alpha=ALPHA).collect()}
    want = by_counting(rows, 0.001, 0.6, LEAST_PAGES, ALPHA)
    assert got.keys() == want.keys() and ("a", "b") in got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(got) < len(mine_rules(table).collect())


def test_labels_by_chance_make_no_rule(spark):
    rng = random.Random(3)
    for share in (0.05, 0.3, 0.7):
        rows = [(rng.sample("abcdefghijklmnop", 6), rng.random() < share) for _ in range(400)]
        assert mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), least_pages=LEAST_PAGES, alpha=ALPHA).count() == 0
    for bad in (True, False):
        same = spark.createDataFrame([(["a", "b"], bad)] * 50, "tokens array<string>, bad boolean")
        assert mine_rules(same, least_pages=LEAST_PAGES, alpha=ALPHA).count() == 0


def test_held_out_pages(spark):
    """Bad pages are found where path word and query key occur together; a tenth of the labels is wrong."""
    rng = random.Random(9)
    pages, truth = [], {}
    for i in range(1200):
        word, key = rng.choice(["buy", "news", "blog", "shop"]), rng.choice(["ref", "id", "page"])
        pages.append((i, f"https://h{i}.site{i % 7}.test/{word}/{i}?{key}={i}"))
        truth[i] = (word, key) == ("buy", "ref")
    labels = [(i, int(truth[i] == (rng.random() < 0.1)), 0) for i in range(600)]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)).collect()}
    assert {i for i in range(600, 1200) if got[i] == "block"} == {i for i in range(600, 1200) if truth[i]}


def test_labels_that_urls_do_not_tell(spark):
    """The labels of the small tables were given without looking at the urls."""
    pages, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("pages", "labels"))
    judged = judge_urls(pages, labels)
    assert judged.count() == pages.count() and judged.where("mined").count() == 0


def test_very_long_url(spark):
    url = "http://a.test/" + "part/" * 50_000 + "?" + "&".join(f"k{i}=1" for i in range(20_000))
    (row,) = judge_urls(spark.createDataFrame([(1, url)], PAGES), spark.createDataFrame([], LABELS)).collect()
    assert (row["host"], len(row["path"]), row["verdict"]) == ("a.test", 250_001, "allow")
