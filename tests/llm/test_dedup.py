"""Substring and near-duplicate removal against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from kelpgraph.llm import components, near_dedup, substring_dedup

WORD = r"[^\x20\x09-\x0D]+"


def brute_windows(docs, width=20):
    first, out = {}, {}
    words = {d: re.findall(WORD, t or "") for d, t in docs}
    for d in sorted(words):
        w, covered = words[d], [False] * len(words[d])
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in first:
                covered[i : i + width] = [True] * width
            else:
                first[key] = (d, i)
        kept = " ".join(x for x, c in zip(w, covered, strict=True) if not c)
        out[d] = (len(w), sum(covered), hashlib.sha256(kept.encode()).hexdigest())
    return out


def windows_of(df):
    return [(r.doc_id, (r.n_words, r.n_removed, r.kept_sha256)) for r in substring_dedup.dedup(df).collect()]


def test_windows(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("ab" if i % 3 else "abcdefgh") for _ in range(rng.choice([0, 1, 19, 20, 21, 60, 200])))) for i in range(150)]
    long = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    docs += [(200, None), (201, ""), (202, "x " * 500), (203, "y x " * 300), (204, "x " * 500), (205, " ".join(long)), (206, "head " + " ".join(long[50:220]) + " tail"), (207, " ".join(long)), (208, "\t\n é ü " * 30)]
    want = brute_windows(docs)
    got = windows_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert dict(got) == want and len(got) == len(docs)


def test_windows_with_repeated_rows_null_ids_and_extra_columns(spark):
    docs = [(5, "q " * 30, 1), (5, "q " * 30, 1), (None, "z " * 25, 2), (7, "z " * 25, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, did long")
    got = sorted(windows_of(df), key=str)
    assert len(got) == 4 and got[0] == got[1]
    by = dict(got)
    assert by[None][1] == 24 and by[7][1] == 25  # a null id comes first; its own later windows repeat the first
    assert windows_of(df.limit(0)) == []
    carried = substring_dedup.dedup(df, carry=["did", "text"]).where("doc_id = 7").first()
    assert (carried.in_did, carried.kept_text) == (3, "")


def brute_groups(docs):
    sets = {}
    for d, t in docs:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(WORD, t)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    inverted, parent = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = set()
    for group in inverted.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), d == root(d)) for d in sets}


def near_rows(seed=2, copies=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(120)]
    rows = []
    for k in range(copies):  # a large group around the threshold: many pairs just above and below it
        w = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(120)] = f"z{rng.randrange(50)}"
        rows.append((1000 + k, " ".join(w[: rng.choice([120, 118, 110])])))
    rows += [(k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for k in range(40)]
    return rows + [(2000, None), (2001, ""), (2002, "A b"), (2003, "a B"), (2004, " ")]


def test_groups(spark):
    docs = near_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(df).collect()}
    assert got == brute_groups(docs)


def test_groups_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    docs = near_rows(seed=4, copies=150)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(df).collect()}
    assert got == brute_groups(docs)


def chained(copies, seed=6):
    """Classes of one bucket that no single star connects: each is like its neighbours alone."""
    rng = random.Random(seed)
    words = [f"u{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(copies):
        words = words[:]
        words[(k * 3) % 200] = f"x{k}"
        rows.append((k, " ".join(words)))
    return rows + [(5000 + k, " ".join(words[:150] + [f"q{k}"] * 2)) for k in range(20)]


@pytest.mark.parametrize("stars", [0, 1, 3])
def test_groups_of_large_buckets_without_a_center(spark, monkeypatch, stars):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "STARS", stars)
    for docs in (chained(120), near_rows(seed=9, copies=120)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == brute_groups(docs)


def test_rows_sent_for_a_large_bucket_of_near_copies(spark, monkeypatch):
    """3,000 near copies: each text goes out a few times, not once for every block of its bucket."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for k in range(3000):
        w = base[:]
        w[rng.choice([0, 1, 98, 99])] = f"z{k}"
        rows.append((k, " ".join(w)))
    sent, links = spark.sparkContext.accumulator(0), near_dedup._links

    def counting(*args):
        run = links(*args)

        def counted(batches):
            for batch in batches:
                sent.add(batch.num_rows)
                yield batch

        return lambda batches: run(counted(batches))

    monkeypatch.setattr(near_dedup, "_links", counting)
    found = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert found.where("kept").count() == 1
    assert sent.value < 40 * 3000  # the buckets of a member number up to 24


def test_groups_of_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "q")]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, None, False), (1, 2, None, False), (None, 2, None, True), (None, 0, None, True), (7, 1, 7, True)], key=str)
    assert near_dedup.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("limit", [1, 10, 1_000_000])
def test_components(spark, limit):
    rng = random.Random(limit)
    links = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long"), limit).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
