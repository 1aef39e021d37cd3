import random

import numpy as np
from pyspark.sql import functions as F

from binweave.llm import mixing, neardup


def brute(sets, num=4, den=5):
    ids = sorted(k for k, s in sets.items() if s)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num}


def families(n, seed):
    r = random.Random(seed)
    sets = {}
    while len(sets) < n:
        base = {f"f{len(sets)}_{i}" for i in range(r.randint(1, 60))} | set(r.sample(["ModInit", "ModTerm", "LibGet", "x"], r.randint(0, 4)))
        for _ in range(r.randint(1, 5)):
            s = set(base)
            for _ in range(r.randint(0, 6)):
                s.discard(r.choice(sorted(s)) if s else "")
            s |= {f"new{r.random()}" for _ in range(r.randint(0, 3))}
            sets[len(sets)] = s
    return sets


def rows_of(spark, sets):
    rows = [(k, x, 1, "e") for k, s in sets.items() for x in s] + [(None, "x", 1, "e"), (3, None, 1, "e")]
    rows += rows[:40]
    return spark.createDataFrame(rows, "id long, item string, cls int, items string")


def test_pairs_against_brute_force(spark):
    sets = families(300, 2)
    sets[1000] = {f"big{i}" for i in range(2000)}
    sets[1001] = sets[1000] | {f"more{i}" for i in range(400)}
    sets[1002] = {"ModInit"}
    sets[1003] = {"ModInit"}
    sets[1004] = {"ModInit", "ModTerm", "LibGet", "x"}
    sets[1005] = {""}
    c = neardup.near_duplicates(rows_of(spark, sets), "id", "item")
    want = brute(sets)
    assert {tuple(r) for r in neardup.record_pairs(c).collect()} == want
    groups = {r.id: r for r in neardup.record_groups(c).collect()}
    assert set(groups) == {k for k, s in sets.items() if s}
    label = {k: k for k in groups}
    for _ in range(len(groups)):
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert {k: r.group_id for k, r in groups.items()} == label
    for k, r in groups.items():
        equal = {x for x in sets if sets[x] == sets[k]}
        assert (r.class_id, r.n_copies) == (min(equal), len(equal))
        assert r.n_links == sum(1 for p in want if k in p and not set(p) <= equal)


def test_large_buckets_are_split_without_loss(spark):
    # All sets share their rarest items, so one bucket holds them all.
    r = random.Random(1)
    sets = {k: {f"s{i}" for i in range(20)} | {f"t{r.randrange(6)}" for _ in range(3)} for k in range(120)}
    sets |= {200 + k: {f"s{i}" for i in range(20)} | {f"u{k}_{i}" for i in range(k % 7)} for k in range(60)}
    c = neardup.near_duplicates(rows_of(spark, sets), "id", "item", bucket=16)
    assert {tuple(x) for x in neardup.record_pairs(c).collect()} == brute(sets)


def test_no_rows(spark):
    c = neardup.near_duplicates(spark.createDataFrame([], "id long, item string"), "id", "item")
    assert neardup.record_pairs(c).collect() == [] and neardup.record_groups(c).collect() == []


def test_bit_sliced_counters():
    r = np.random.default_rng(2)
    words = [r.integers(0, 2**63, 5).astype(np.uint64) for _ in range(41)]
    counter = [np.zeros(5, dtype=np.uint64)]
    for i in range(0, 41, 7):
        counter = neardup._add(counter, words[i : i + 7])
    lanes = np.array([[[(int(w[p]) >> k) & 1 for k in range(64)] for p in range(5)] for w in words]).sum(axis=0)
    got = np.array([[sum(((int(c[p]) >> k) & 1) << n for n, c in enumerate(counter)) for k in range(64)] for p in range(5)])
    assert (got == lanes).all()
    radius = np.array([0, 15, 20, 31, 500])
    over = neardup._exceeds(counter, radius)
    assert [[(int(over[p]) >> k) & 1 for k in range(64)] for p in range(5)] == (lanes > radius[:, None]).astype(int).tolist()


def test_mixing_reaches_shares_within_caps(spark):
    r = random.Random(6)
    rows = [(i, s, r.randint(50, 150), r.random() + 0.1, "x") for i, s in enumerate(["a"] * 3000 + ["b"] * 800 + ["c"] * 300 + [None] * 9 + ["unknown"] * 9)] + [(9000, "a", 0, 1.0, "x")]
    docs = spark.createDataFrame(rows, "id long, source string, n long, w double, key string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("none", 0.1, 4), ("zero", None, None)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, "id", "source", "n", "w", targets)
    got = {x.doc_id: x for x in chosen.collect()}
    cap = {"a": 1, "b": 2, "c": 3}
    size = {s: sum(x[2] for x in rows if x[1] == s) for s in cap}
    total = min(size[s] * cap[s] / t for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.1))) * 0.9
    tokens = {s: sum(g.n_tokens * g.copies for g in got.values() if g.source == s) for s in cap}
    for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert 0 <= total * t / 0.9 - tokens[s] <= 200
        copies = {got[x[0]].copies if x[0] in got else 0 for x in rows if x[1] == s and x[2]}
        assert max(copies) <= cap[s] and max(copies) - min(copies) <= 1
    report = {x.source: x for x in shares.collect()}
    assert report["none"].mixed_tokens == 0 and report["zero"].n_docs == 0 and set(report) == {"a", "b", "c", "none", "zero"}
    assert abs(sum(x.actual_share for x in report.values()) - 1) < 1e-9 and abs(report["a"].actual_share - 0.5 / 0.9) < 0.01


def test_mixing_takes_heavier_documents_more_often(spark):
    docs = spark.range(4000).select(F.col("id"), F.lit("s").alias("source"), F.lit(10).alias("n"), F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.1).alias("w"))
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, _ = mixing.mix(docs, "id", "source", "n", "w", targets, total_tokens=10_000)
    even = chosen.filter("doc_id % 2 = 0").count()
    assert chosen.count() == 1000 and even > 800
    again, _ = mixing.mix(docs, "id", "source", "n", "w", targets, total_tokens=10_000)
    assert sorted(r.doc_id for r in chosen.collect()) == sorted(r.doc_id for r in again.collect())


def test_mixing_caps_a_given_total_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "s", 10), (2, "s", 5), (2, "s", 5)], "id long, source string, n long")
    targets = spark.createDataFrame([("s", 1.0, 3)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, "id", "source", "n", None, targets, total_tokens=10**6)
    assert sorted(r.copies for r in chosen.collect()) == [3, 3, 3] and shares.first().epochs == 3.0
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0))):
        chosen, shares = mixing.mix(d, "id", "source", "n", None, t)
        assert chosen.collect() == []


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "ü" * 100_000)], "i int, t string")
    measured = mixing.sizes_and_weights(F.col("t"), mixing.shipped(spark, mixing.VOCABULARY), ["the", "of", "is"])
    weights = {r.i: r.w for r in df.select("i", measured["weight"].alias("w")).collect()}
    assert all(0.05 <= w <= 1 for w in weights.values())
    got = {r.i: r.n for r in df.select("i", measured["n_tokens"].alias("n")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 0


def test_weights_prefer_prose(spark):
    texts = [(1, "The state of the model is the sum of the parts."), (2, "12 ## 44 %% 0x3f || --"), (3, None), (4, "")]
    measured = mixing.sizes_and_weights(F.col("t"), mixing.shipped(spark, mixing.VOCABULARY), ["the", "of", "is"])
    got = {r.i: tuple(r.m) for r in spark.createDataFrame(texts, "i int, t string").select("i", measured.alias("m")).collect()}
    assert got[1][1] > 0.5 and got[2][1] == 0.05 and got[3] == (0, 0.05) and got[4] == (0, 0.05)


def test_a_total_of_all_that_is_there(spark):
    docs = spark.createDataFrame([(i, "a" if i % 5 else "b", 10) for i in range(100)], "d long, s string, n long")
    aims = spark.createDataFrame([("a", 0.5, 9), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(docs, "d", "s", "n", None, aims, "available")
    got = {r.source: r.mixed_tokens for r in shares.collect()}
    # b may give 2 x 200 of the 500 that its share of 1000 is.
    assert got == {"a": 500, "b": 400}
