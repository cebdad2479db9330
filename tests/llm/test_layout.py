"""Mixing, packing, sharding, search and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
from kelpgraph.llm import mixing, packing, queries, sharding, topk
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def duck(sql, **tables):
    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame)
    return c.sql(sql).fetchall()


def test_oracles(spark):
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DATA)
        c = duckdb.connect()
        for t in ("documents", "embeddings"):
            c.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
        want = c.sql(sql)
        assert sorted(want.columns) == sorted(df.columns)
        assert sorted(tuple(r[k] for k in want.columns) for r in df.collect()) == sorted(want.fetchall())


def odd_documents(spark):
    rows = [(1, "a b c", "en", "src1"), (1, "a b c", "en", "src1"), (None, "q w e r", None, None), (3, None, "en", "src2"), (4, "", "de", "x")]
    rows += [(100, "k l m n o", "fr", "src9")] * 50 + [(200 + i, "t " * (i % 7 + 1), "es", f"src{i % 3}") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def test_mixing_of_odd_rows(spark):
    df = odd_documents(spark)
    got = mixing.mix(df)
    want = duck(f"SELECT doc_id, domain, lang, source, n_tokens, copies FROM ({mixing.oracle()})", documents=df.toPandas().astype({"doc_id": "Int64"}))
    rows = [tuple(r[c] for c in ("doc_id", "domain", "lang", "source", "n_tokens", "copies")) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert mixing.mix(df.limit(0)).collect() == []


def test_shortages_go_to_siblings_first(spark):
    leaves = pd.DataFrame([("domain0", "en", "a", 10), ("domain0", "en", "b", 1000), ("domain0", "de", "c", 1000), ("domain1", "en", "d", 1000)], columns=["domain", "lang", "source", "tokens"])
    w = mixing.Weights({"domain0": 1, "domain1": 1}, {"en": 1, "de": 1}, {"a": 1, "b": 1}, share=(1, 5), max_epochs=1)
    got = {r.source: r.budget for r in mixing.budgets(spark.createDataFrame(leaves), w).collect()}

    total = (10 + 1000 + 1000 + 1000) // 5
    assert got["d"] == total // 2 and got["c"] == total // 4 and got["a"] + got["b"] == total // 2 // 2


def check_packing(out, docs, lengths):
    for (_, _), b in out[out.bin.notna()].groupby(["pack_group", "bin"]):
        b = b.sort_values("place")
        assert b.n_tokens.sum() == b.bin_tokens.iloc[0] <= b.bin_length.iloc[0]
        assert (b.place.to_numpy() == np.concatenate(([0], b.n_tokens.cumsum()[:-1]))).all()
        assert b.bin_length.iloc[0] == min(s for s in lengths.sizes if s >= b.bin_tokens.iloc[0])
    for key, d in out.groupby(["doc_id", "copy"], dropna=False):
        d = d.sort_values("start")
        assert d.start.iloc[0] == 0 and (d.start.to_numpy()[1:] == (d.start + d.n_tokens).to_numpy()[:-1]).all()


def test_packing(spark):
    lengths = packing.Lengths(sizes=(8, 16, 32), group_tokens=400)
    rng = random.Random(1)
    rows = [(k, "w " * rng.choice([0, 1, 3, 8, 9, 31, 33, 100])) for k in range(120)] + [(500, "q " * 5)] * 600 + [(None, "z z"), (601, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = packing.pack(df, lengths).toPandas()
    check_packing(out, rows, lengths)
    assert out.n_tokens.sum() == sum(len((t or "").split()) for _, t in rows)
    assert len(out.drop_duplicates(["doc_id", "copy"])) == len(rows)
    again = packing.pack(df.repartition(2), lengths).toPandas()
    key = ["pack_group", "bin", "place", "doc_id", "copy", "piece"]
    assert out.sort_values(key)[key].astype(str).values.tolist() == again.sort_values(key)[key].astype(str).values.tolist()
    assert packing.pack(df.limit(0), lengths).collect() == []


def test_best_fit_takes_the_least_room():
    bins, places, final = packing.best_fit([9, 7, 6, 2, 1], packing.Lengths(sizes=(10, 16), fixed=0, attention=1))
    by = {}
    for b, size in zip(bins, [9, 7, 6, 2, 1], strict=True):
        by.setdefault(b, []).append(size)
    assert all(sum(x) <= f for x, f in zip(by.values(), final, strict=True))
    assert sum(final) <= 36


def plain_best_fit(pieces, sizes, cost):
    """The same rule, step by step: for each opened bin every size is filled from the list of what is left."""
    rooms, used, bins, opened = [], [], [], []
    for k, size in enumerate(pieces):
        open_ = [b for b in range(len(used)) if rooms[b] - used[b] >= size]
        if open_:
            least = min(rooms[b] - used[b] for b in open_)
            at = [b for b in open_ if rooms[b] - used[b] == least]
            bins.append(at)
            at = at[0]
        else:
            best = None
            for s in (s for s in sizes if s >= size):
                held = size
                for other in sorted(pieces[k + 1 :], reverse=True):
                    held += other if held + other <= s else 0
                rate = cost(min(x for x in sizes if x >= held)) / held
                best = min(best or (rate, s), (rate, s))
            at = len(used)
            rooms.append(best[1])
            opened.append(best[1])
            used.append(0)
            bins.append([at])
        used[at] += size
    return [min(x for x in sizes if x >= u) for u in used], opened


def least_cost(pieces, sizes, cost):
    """The least cost of any packing."""
    from functools import lru_cache

    def parts(rest):
        if not rest:
            yield []
            return
        for mask in range(1 << len(rest) - 1):
            mine = [rest[0]] + [x for k, x in enumerate(rest[1:]) if mask >> k & 1]
            if sum(mine) <= sizes[-1]:
                for others in parts([x for k, x in enumerate(rest[1:]) if not mask >> k & 1]):
                    yield [sum(mine), *others]

    price = lru_cache(None)(lambda u: cost(min(s for s in sizes if s >= u)))
    return min(sum(price(u) for u in p) for p in parts(list(pieces)))


def test_best_fit_against_the_plain_rule_and_the_optimum():
    rng = random.Random(8)
    lengths = packing.Lengths(sizes=(8, 16, 32), fixed=2.0, attention=64.0)
    ratios, opened = [], set()
    for _ in range(60):
        pieces = sorted((rng.choice([1, 2, 3, 5, 7, 9, 13, 20, 31]) for _ in range(rng.randrange(1, 9))), reverse=True)
        final, sizes = plain_best_fit(pieces, lengths.sizes, lengths.cost)
        opened |= set(sizes)
        assert sorted(packing.best_fit(pieces, lengths)[2]) == sorted(final), pieces
        ratios.append(sum(map(lengths.cost, final)) / least_cost(pieces, lengths.sizes, lengths.cost))
    assert min(ratios) >= 1 and np.mean(ratios) < 1.05 and max(ratios) < 1.5
    assert opened == {8, 16, 32}


def test_the_opened_size_depends_on_what_is_left():
    lengths = packing.Lengths(sizes=(10, 20), fixed=1, attention=1e9)
    assert packing.best_fit([9, 9, 2], lengths)[2] == [20]
    assert packing.best_fit([9, 9], lengths)[2] == [10, 10] or sum(packing.best_fit([9, 9], lengths)[2]) == 20


def test_packing_deals_null_ids_and_long_copies(spark):
    lengths = packing.Lengths(sizes=(8, 16, 32), group_tokens=400)
    rows = [(None, "w " * (k + 1)) for k in range(100)] + [(5, "q " * 90)] * 40
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), lengths).toPandas()
    assert out.n_tokens.sum() == sum(len(t.split()) for _, t in rows)
    assert out.groupby("pack_group").n_tokens.sum().max() < 4 * 400


def check_shards(out, rows, shards=16):
    assert len(out) == len(rows)
    for _, s in out.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert set(out.shard) <= set(range(shards))


def plain_assign(items, shards):
    """Greatest dot product with the residual capacity among shards with room for the bytes, one item after another."""
    total = [sum(x[k] for x in items) or 1 for k in range(3)]
    share = [[x[k] / total[k] for k in range(3)] for x in items]
    left = [[1 / shards] * 3 for _ in range(shards)]
    out = [0] * len(items)
    for k in sorted(range(len(items)), key=lambda i: (-max(share[i]), -sum(share[i]), i)):
        room = [s for s in range(shards) if left[s][0] >= share[k][0]]
        dot = lambda s: sum(a * b for a, b in zip(left[s], share[k], strict=True))  # noqa: B023, E731
        out[k] = max(room, key=lambda s: (dot(s), -s)) if room else max(range(shards), key=lambda s: (left[s][0], -s))
        left[out[k]] = [a - b for a, b in zip(left[out[k]], share[k], strict=True)]
    return out


def test_assign_against_the_plain_rule():
    rng = np.random.default_rng(7)
    for n in (1, 5, 80, 400):
        items = rng.integers(1, 1000, size=(n, 3)).astype(float)
        items[:, 2] = 1
        got = sharding.assign(items, 16)
        assert got.tolist() == plain_assign(items.tolist(), 16)
        if n == 400:
            for k, slack in ((0, 0.02), (1, 0.1), (2, 0.1)):
                sums = np.bincount(got, items[:, k], 16)
                assert sums.max() <= (1 + slack) * items[:, k].sum() / 16


def test_sharding(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("abé \n") for _ in range(rng.randrange(200)))) for k in range(3000)]
    rows += [(5000 + k, "the same text of many") for k in range(1500)] + [(9000, "one row repeated")] * 700 + [(None, None), (9001, ""), (9002, None)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas()
    check_shards(out, rows)
    sizes = out.groupby("shard").agg(b=("size", "sum"), n=("slot", "count"), t=("n_tokens", "sum"))
    assert sizes.b.max() < 1.1 * sizes.b.min() and sizes.n.max() < 1.25 * sizes.n.min()
    texts = {k: t for k, t in rows}
    for r in out[out.doc_id.notna()].itertuples():
        t = (texts[r.doc_id] or "").encode()
        assert r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t)
    small = out[out.doc_id < 3000].assign(text=lambda f: f.doc_id.map(texts))
    assert (small[small.text.str.len() > 3].groupby("text").shard.nunique() == 1).all()
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    check_shards(sharding.shard(spark.createDataFrame(rows[:3], "doc_id long, text string")).toPandas(), rows[:3])


def brute_top(rows, k=5, every=50):
    v = {i: [int(np.floor(256 * float(x))) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in sorted(x for x in v if x % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q)[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return out


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(700)] + [(1000 + i, [0.5] * 8) for i in range(300)]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [2.0] * 3), (None, [1.0] * 8), (2250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    key = lambda r: (r.query_id, r.rank, r.vec_id, r.score)
    want = brute_top(rows)
    assert sorted(map(key, topk.top_k(df).collect())) == want
    monkeypatch.setattr(topk, "CHUNK", 100)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "BLOCK", 16)
    assert sorted(map(key, topk.top_k(df.unionByName(df.limit(100))).collect())) == want
    monkeypatch.setattr(topk, "PAGE", 3)
    assert sorted(map(key, topk.top_k(df).collect())) == want
    huge = spark.createDataFrame([(50 * i, [1e6 * (i + 1), 3.0]) for i in range(8)], "vec_id long, embedding array<double>")
    assert sorted(map(key, topk.top_k(huge).collect())) == brute_top([(50 * i, [1e6 * (i + 1), 3.0]) for i in range(8)])
    assert topk.top_k(df.limit(0)).collect() == []


def test_top_k_sends_queries_only_to_chunks_that_can_win(spark, monkeypatch):
    """Vectors in clusters by id: most pairs of a query and a chunk must not be searched."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 16)) * 4
    rows = [(i, (centers[i // 100] + rng.normal(size=16) * 0.05).tolist()) for i in range(2000)]
    monkeypatch.setattr(topk, "CHUNK", 100)
    monkeypatch.setattr(topk, "QUERIES", 10)
    monkeypatch.setattr(topk, "PAGE", 7)
    scored, seen = topk._scored, spark.sparkContext.accumulator(0)

    def counting(k):
        run = scored(k)

        def counted(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    seen.add(len(row["places"]))
                yield from run(iter([batch]))

        return counted

    monkeypatch.setattr(topk, "_scored", counting)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df.withColumn("part", F.lit("x")).withColumn("chunk", F.lit(1))).collect()]
    assert sorted(got) == brute_top(rows)
    assert 40 <= seen.value < 0.25 * 40 * 20


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == cp.COLUMNS, name
        before, docs = docs, spark.createDataFrame(after.toPandas(), after.schema)
        if name in ("quality rules", "near-duplicates"):
            assert docs.join(before, cp.COLUMNS, "left_anti").count() == 0
    run = cp.run(spark, DATA).toPandas()
    last = cp.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert len(run) == len(last) and run.n_tokens.sum() == last.n_tokens.sum() > 0
    check_packing(run, None, packing.PRODUCTION)


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as cp

    good = " ".join(f"w{k}" for k in range(80))
    rows = [(1, good, "en", "src1", 9), (1, good, "en", "src1", 9), (2, good + " more", None, None, None), (None, None, None, None, None), (4, "", "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() >= 1
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0
