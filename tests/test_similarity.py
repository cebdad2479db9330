"""Signatures and the similarity join against plain models."""

import hashlib
import random

import numpy as np
import pytest
from kelpgraph.operators import similarity as sm


def plain_signature(tokens):
    a, b = sm.family()
    h = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "little") for t in tokens]
    return [min((x * v + y) % (2**31 - 1) for v in h) if h else 0 for x, y in zip(a, b, strict=True)]


def token_rows(n=500, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        w = [f"t{i}" for i in range(60)]
        for _ in range(rng.choice([0, 1, 3, 6, 10])):
            w[rng.randrange(60)] = f"x{rng.randrange(300)}"
        rows.append((k, sorted(set(w)) if k % 50 else ["same"]))
    return rows


def test_signatures_and_bands(spark, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK_TOKENS", 500)
    rows = token_rows(60) + [(900, []), (901, None), (902, ["é", "ü"])]
    got = {r.id: r for r in sm.signatures(spark.createDataFrame(rows, "id long, tokens array<string>"), "id", "tokens").collect()}
    for k, tokens in rows:
        want = plain_signature(tokens or [])
        assert got[k].signature == want
        keys = [hashlib.sha256(np.array(want[8 * i : 8 * i + 8], "<u4").tobytes()).digest()[:8] for i in range(16)]
        assert got[k].bands == [x[::-1].hex() for x in keys]


@pytest.mark.parametrize(("least", "block"), [(0.7, 256), (0.7, 20), (0.5, 64), (0.9, 16), (1.0, 256)])
def test_band_join_finds_what_comparing_all_finds(spark, monkeypatch, least, block):
    """Also where hundreds of near copies share a bucket: each row's ten best, ties to the smaller id."""
    monkeypatch.setattr(sm, "BLOCK", block)
    signed = sm.signatures(spark.createDataFrame(token_rows(), "id long, tokens array<string>"), "id", "tokens")
    sig = {r.id: np.array(r.signature) for r in signed.collect()}
    want = []
    for a in sig:
        close = sorted((-(sig[a] == sig[b]).sum() / 128, b) for b in sig if b != a and (sig[a] == sig[b]).sum() / 128 >= least)[:10]
        want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(close)]
    assert sorted((r.a, r["rank"], r.b, r.similarity) for r in sm.band_join(signed, "id", least).collect()) == sorted(want)


def test_band_join_by_names(spark):
    rows = [(f"n{k % 7}-{k}", ["a", "b", "c"] if k % 2 else ["a", "b", "c", "d"]) for k in range(40)]
    signed = sm.signatures(spark.createDataFrame(rows, "id string, tokens array<string>"), "id", "tokens")
    first = sorted(k for k, t in rows if len(t) == 3)
    got = [r.b for r in sm.band_join(signed, "id", 0.6, 3).where(f"a = '{first[0]}'").orderBy("rank").collect()]
    assert got == first[1:4]


def hub_rows(spark, n=600):
    """Signatures that all have 40 slots in common, and more in three groups."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 2**31 - 1, (3, 128))
    rows = []
    for k in range(n):
        own = rng.integers(1, 2**31 - 1, 128)
        own[:40] = base[0, :40]
        more = rng.choice(np.arange(40, 128), rng.integers(20, 70), replace=False)
        own[more] = base[k % 3, more]
        rows.append((k, own.tolist()) if k % 40 else (k, base[0].tolist()))
    return rows, spark.createDataFrame(rows, "id long, signature array<long>")


@pytest.mark.parametrize(("least", "top", "size", "ranked"), [(0.5, 100, 5000, 1 << 20), (0.5, 7, 70, 300), (0.3, 3, 70, 50)])
def test_band_join_of_one_slot_compares_all_without_shuffling_signatures(spark, monkeypatch, least, top, size, ranked):
    """Rows that all share slots: the same result as a plain model, and signatures meet in blocks that nothing shuffles."""
    monkeypatch.setattr(sm, "ROWS", size)
    monkeypatch.setattr(sm, "RANKED", ranked)
    rows, signed = hub_rows(spark)
    got = sm.band_join(signed, "id", least, top)
    sig = np.array([s for _, s in rows])
    agree = (sig[:, None, :] == sig[None, :, :]).sum(2)
    want = []
    for a in range(len(rows)):
        close = sorted((-int(agree[a, b]), b) for b in range(len(rows)) if b != a and agree[a, b] >= least * 128)[:top]
        want += [(a, k + 1, b, -s / 128) for k, (s, b) in enumerate(close)]
    assert len({x[3] for x in want}) > 10
    assert sorted((r.a, r["rank"], r.b, r.similarity) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "packed_i" in plan and "RepartitionByExpression" not in plan


@pytest.mark.parametrize("equal", [1, 64, 65, 128])
def test_alike_is_exact_at_the_threshold(equal):
    rng = np.random.default_rng(7)
    one, other = rng.integers(0, 2**31, (130, 128)).astype(np.uint32), rng.integers(0, 2**31, (90, 128)).astype(np.uint32)
    for k in range(90):
        same = rng.choice(128, min(128, 30 + k), replace=False) if k < 85 else np.arange(128)
        other[k, same] = one[k, same]
    agree = (one[:, None, :] == other[None, :, :]).sum(2)
    found = [(x, y, n) for part in sm._alike(one, other, equal) for x, y, n in zip(*map(np.ndarray.tolist, part), strict=True)]
    assert found == [(x, y, agree[x, y]) for x, y in np.argwhere(agree >= equal).tolist()]


def test_index(spark):
    signed = sm.signatures(spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["z"])], "id long, tokens array<string>"), "id", "tokens").cache()
    held = sm.insert(sm.index(signed.where("id = 1"), "id"), sm.index(signed, "id"), "id")
    assert held.count() == 3 * 16
    asked = signed.where("id = 2").withColumnRenamed("id", "q")
    assert [(r.q, r.id, r.similarity) for r in sm.probe(held, asked.withColumn("q", asked.q + 10), "q", "id", 0.5).orderBy("id").collect()] == [(12, 1, 1.0), (12, 2, 1.0)]
    assert [r.id for r in sm.probe(sm.remove(held, signed.where("id = 1").select("id"), "id"), asked.withColumn("q", asked.q + 10), "q", "id", 0.5).collect()] == [2]
