"""Near-duplicates at thresholds other than op10's."""

import random

import corpus_pipeline as cp
import pytest
from kelpgraph.llm import near_dedup


def brute(docs, percent):
    sets = {d: frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def near_pairs(number=150, most=8):
    rng = random.Random(9)
    docs = []
    for k in range(number):
        words = [f"w{k}x{i}" for i in range(120)]
        docs.append((2 * k, " ".join(words)))
        for _ in range(rng.randrange(1, most)):
            words[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        docs.append((2 * k + 1, " ".join(words)))
    return docs


@pytest.mark.parametrize("percent", [50, 80])
def test_groups_at_lower_thresholds(spark, percent):
    docs = near_pairs()
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).collect()}
    assert got == brute(docs, percent)


def test_scheme_misses_as_seldom_at_any_threshold():
    assert near_dedup.scheme(85)[:2] == (24, 5)
    for percent in (30, 50, 60, 70, 80, 85, 90, 95):
        plan, s = near_dedup.scheme(percent), percent / 100
        assert (1 - s**plan.rows) ** plan.bands <= 8e-7 and plan.agree < plan.slots * s


def test_stage_links_at_four_fifths(spark):
    words = [f"w{k}" for k in range(120)]
    other = [*words[:40], "x", *words[41:80], "y", *words[81:]]  # 106 of 126 shingles shared: 0.84
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 9), (2, " ".join(other), "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in cp.near_dedup_stage(spark, docs, "").collect()] == [1]
