"""Rules against brute force; classifiers on held-out rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from kelpgraph.llm import language_id, quality_classifier, quality_rules, sampling, toxicity
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"


def brute_rules(t, least=8):
    t = t or ""
    w = re.findall(WORD, t)
    n = len(w)
    triples = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    covered = [False] * n
    for i in range(n - 2):
        if triples[tuple(w[i : i + 3])] > 1:
            covered[i : i + 3] = [True] * 3
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    wide = Counter(tuple(w[i : i + least]) for i in range(n - least + 1))
    spans = [False] * n
    for i in range(n - least + 1):
        if wide[tuple(w[i : i + least])] > 1:
            spans[i : i + least] = [True] * least
    longest, before = 0, [0] * (n + 2)
    for i in range(n - 1, -1, -1):
        now = [0] * (n + 2)
        for j in range(n - 1, i, -1):
            if w[i] == w[j]:
                now[j] = 1 + before[j + 1]
                longest = max(longest, now[j])
        before = now
    return [n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, sum(covered), sum(spans), longest if longest >= least else 0]


def test_rules(spark):
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice(["a ", "b ", "c\n", "\n", " \t", "é ", "<|> "]) for _ in range(rng.choice([0, 1, 7, 30, 200])))) for i in range(200)]
    docs += [(500, None), (501, "x " * 300), (502, "\n"), (503, " "), (504, "a\n\na\n"), (505, " ".join(f"w{k}" for k in range(200)))]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    for i, t in docs:
        want = brute_rules(t)
        assert [got[i][c] for c in quality_rules.COUNTS] == want, (i, t)
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert got[i].kept == (not got[i].base_failed and want[5] <= 0.3 * want[0] and want[6] <= 150)
    assert got[505].kept and quality_rules.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rules_carry_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, n_words int, kept string")
    r = quality_rules.judge(df, keep=["n_words", "kept"]).first()
    assert (r.n_words, r.in_n_words, r.in_kept) == (2, 3, "x")


def test_fold_is_crc32(spark):
    rows = [(7,), (None,), (123456,)]
    got = [r.f for r in spark.createDataFrame(rows, "doc_id long").select(sampling.fold("doc_id", 3).alias("f")).collect()]
    assert got == [zlib.crc32(("" if k is None else str(k)).encode()) % 3 for (k,) in rows]


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def held_out(spark, scored, column):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    f = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", column).toPandas()
    return f.score.to_numpy(), f.predicted.to_numpy(), f[column].to_numpy()


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_classifier.classify(docs, labels)
    score, predicted, label = held_out(spark, scored, "quality")
    assert auc(score, label) > 0.95
    assert (predicted[label == 1] == 1).mean() > 0.95
    assert (predicted[label == 0] == 0).mean() > 0.75  # 14 documents


def test_prior_and_cut_of_known_masses():
    cells = np.arange(quality_classifier.CELLS)
    bell = lambda at: np.exp(-(((cells - at) / 60.0) ** 2)) * 1e6
    trusted, bad = bell(1400), bell(800)
    others = 0.8 * trusted + 0.2 * bad
    prior = quality_classifier.prior_of(trusted, others)
    cut = quality_classifier.cut_of(trusted, others, prior)
    assert abs(prior - 0.8) < 0.01
    assert 900 < (cut + quality_classifier.GRID) * quality_classifier.CELLS / (2 * quality_classifier.GRID) < 1300


def test_quality_of_ids_with_many_texts_and_null_ids(spark):
    good, bad = "A quiet line of prose, with some words. " * 20, "### $$$ BUY!!! " * 40
    rows = [(k, good + str(k)) for k in range(60)] + [(7, f"{good} {k}") for k in range(30)] + [(None, bad)] * 20 + [(1000 + k, bad + str(k)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(None, 1)], "doc_id long, quality int")
    out = quality_classifier.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id is None}) == 1


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    score, predicted, label = held_out(spark, toxicity.classify(docs, labels), "toxic")
    assert auc(score, label) > 0.85
    assert (predicted[label == 0] == 0).mean() > 0.97


def test_identity_terms_do_not_move_the_score(spark):
    rng = random.Random(1)
    plain = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(600):
        words = rng.sample(plain, 12)
        bad = k % 3 == 0
        if bad:
            words.append(rng.choice(["vile", "nasty"]))
        if rng.random() < (0.6 if bad else 0.2):  # the group is mentioned more often in toxic rows
            words.append("muslim")
        elif rng.random() < 0.3:
            words.append("christian")
        rows.append((" ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "text string, label int")

    def gap(swap):
        model = toxicity.train(df, swap=swap)
        cells = lambda w: np.searchsorted(model.keys, np.array(toxicity._word_keys(w), np.uint64))
        return abs(sum(model.weights[k] for k in cells("muslim")) - sum(model.weights[k] for k in cells("christian"))), model

    loose, _ = gap(0.0)
    tight, model = gap(10.0)
    assert tight < 0.3 * loose
    assert sum(model.weights[np.searchsorted(model.keys, np.array(toxicity._word_keys("vile"), np.uint64))]) > 1


def test_mentions_of_groups_have_the_same_false_positive_rate(spark):
    """Planted mentions, in four languages: one group's term stands in most toxic rows, another's in neutral ones."""
    rng = random.Random(9)
    plain = [f"w{k}" for k in range(400)]
    docs, labels, group = [], [], {}
    for k in range(3000):
        bad, words = k % 4 == 0, rng.sample(plain, 20)
        term = rng.choice(["muslim", "musulman", "juden"] if rng.random() < (0.8 if bad else 0.2) else ["christian", "cristianos", "chrétien"])
        group[k] = term in ("muslim", "musulman", "juden")
        words += [term, term] + ([rng.choice(["vile", "scum", "nasty"])] if bad and rng.random() < 0.9 else [])
        rng.shuffle(words)
        docs.append((k, " ".join(words)))
        labels.append((k, int(bad)))

    def rates(swap):
        model = toxicity.train(spark.createDataFrame([(t, y) for (k, t), (_, y) in zip(docs, labels, strict=True) if zlib.crc32(str(k).encode()) % 3 != 1], "text string, label int"), swap=swap)
        held = [(k, t, y) for (k, t), (_, y) in zip(docs, labels, strict=True) if zlib.crc32(str(k).encode()) % 3 == 1]
        data = [t.encode() for _, t, _ in held]
        import pyarrow as pa
        from kelpgraph.llm.tokens import blocks

        score = np.concatenate([model.score(b) for b in blocks(pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["text"]))])
        neutral = np.array([y == 0 for _, _, y in held])
        mine = np.array([group[k] for k, _, _ in held])
        return [score[neutral & (mine == g)].mean() for g in (True, False)], (score[~neutral] >= 0.7).mean()

    (with_, without), _ = rates(0.0)
    (near, far), recall = rates(10.0)
    assert with_ - without > 0.05 and abs(near - far) < 0.3 * (with_ - without) and recall > 0.8


def test_only_the_term_itself_is_a_mention():
    terms = {c for words in toxicity.IDENTITIES.values() for w in words for c in toxicity._word_keys(w)[:1]}
    assert not {c for w in ("rradorr", "rradoez", "blackish") for c in toxicity._word_keys(w)} & terms


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.identify(docs).where("held_out").join(docs.select("doc_id", F.col("lang").alias("truth"), "n_chars"), "doc_id").where("n_chars > 100")
    right = got.agg(F.avg((F.col("lang_pred") == F.col("truth")).cast("int"))).first()[0]
    assert right > 0.99


def test_filters_have_no_false_negatives():
    f = language_id.Filters(["a", "b"], 1 << 10)
    cells = np.arange(200, dtype=np.uint64)
    f.add(1, cells)
    mask = None
    for rows in language_id.rows_of(cells, f.slots):
        mask = f.table[rows] if mask is None else mask & f.table[rows]
    assert ((mask[:, 0] >> np.uint64(1)) & np.uint64(1)).all()
    assert 0 < f.filled()[1] < 0.5 and f.filled()[0] == 0


def test_only_the_covered_fraction_rejects(spark):
    """A paragraph of 40 words twice among 200 others: short of the base rule and of the longest repeat."""
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    part = fresh(40)
    bad, good = fresh(60) + part + fresh(60) + part, fresh(120) + part[:20] + fresh(60) + part[:20]
    rows = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame([(1, " ".join(bad)), (2, " ".join(good))], "doc_id long, text string")).collect()}
    assert not rows[1].base_failed and not rows[1].kept and rows[1].longest_repeat == 40 and rows[1].covered_words == 80
    assert rows[2].kept


def test_popcounts():
    rng = np.random.default_rng(1)
    for languages in (1, 4, 9, 64, 70):
        mask = rng.integers(0, 2**63, size=(2000, -(-languages // 64)), dtype=np.uint64)
        doc = np.sort(rng.integers(0, 6, size=2000))
        bits = [[(int(w) >> k) & 1 for w in row for k in range(64)][:languages] for row in mask.tolist()]
        want = [[sum(b[k] for b, d in zip(bits, doc.tolist(), strict=True) if d == n) for k in range(languages)] for n in range(6)]
        assert language_id.popcounts(mask, doc, 6, languages).tolist() == want


def test_languages_against_plain_sets(spark):
    """The same decisions from one set of n-grams for each language, without filters; 70 languages, so two words of masks."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = [[rng.choice(letters) + rng.choice(letters) + rng.choice(letters) for _ in range(12)] for _ in range(70)]
    rows = [(k, " ".join(rng.choice(own[k % 70]) for _ in range(30)), f"l{k % 70:02d}") for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}

    def grams(text):
        padded = text.lower()
        return [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1) if sum(c != " " for c in padded[i : i + n]) >= n - 1]

    times, number = {}, Counter()
    for k, text, lang in rows:
        if zlib.crc32(str(k).encode()) % 4 != 2:
            number[lang] += 1
            times.setdefault(lang, Counter()).update(set(grams(text)))
    sets = {lang: {g for g, n in c.items() if n >= max(1.0, 0.01 * number[lang])} for lang, c in times.items()}
    same = 0
    for k, text, _ in rows:
        counts = {lang: sum(g in s for g in grams(text)) for lang, s in sorted(sets.items())}
        best = max(counts.values())
        same += got[k].lang_pred in [lang for lang, n in counts.items() if n >= best - 1]  # a false positive may turn a tie
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
    assert same == len(rows)
    assert sum(got[k].lang_pred == lang for k, _, lang in rows) > 0.98 * len(rows)


def test_rare_languages_are_learned(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} " * 4, f"lang{k}") for k in range(1200)]
    langs = {r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    learned = {f"lang{k}" for k in range(1200) if zlib.crc32(str(k).encode()) % 4 != 2}
    assert len(learned) > 850 and langs <= learned and len(langs) > 0.9 * len(learned)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 34", "fr", "x"), (None, "abc def", None, "x"), (1, None, "en", "x")], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    und = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs).where("doc_id is not null").collect()}
    assert und == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)}
    for scored in (quality_classifier.classify(docs, labels), toxicity.classify(docs, labels)):
        rows = scored.collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    none = docs.limit(0)
    assert language_id.identify(none).collect() == [] and quality_classifier.classify(none, labels.limit(0)).collect() == [] and toxicity.classify(none, labels.limit(0)).collect() == []
