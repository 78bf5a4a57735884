import re
from collections import Counter

import numpy as np
from framelake.llm import common, quality_rules
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = Counter(windows)
    marked = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def test_base_counts(spark, odd_docs):
    for docs in (odd_docs, common.documents(spark, SF)):
        for r in quality_rules.vote(docs).collect():
            counts = brute(r.text)
            assert tuple(r[f"_{n}"] for n in quality_rules.STATS) == counts
            assert r._base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def test_em_finds_the_rules_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.85
    votes = np.where(good[:, None], rng.choice(3, (20_000, 6), p=[0.02, 0.18, 0.8]), rng.choice(3, (20_000, 6), p=[0.6, 0.2, 0.2]))
    keys = ["".join(map(str, v)) for v in votes]
    posterior = quality_rules.fit(Counter(keys))
    guess = np.array([posterior[k] >= 0.5 for k in keys])
    assert (guess == good).mean() > 0.98
    share = np.mean([posterior[k] for k in keys])
    assert abs(share - good.mean()) < 0.01  # calibrated


def test_labels_are_met(spark):
    got = quality_rules.op4_quality_rules(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.where(~F.col("base_failed")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in rows}
    assert share[1] > 0.97 and share[0] < 0.1


def test_filter_and_nothing(spark, odd_docs, no_docs):
    clash = common.documents(spark, SF).withColumns({"votes": F.lit(1), "pattern": F.lit(2)})
    out = quality_rules.keep_good(clash)
    assert out.columns == clash.columns and 0 < out.count() < clash.count()
    assert quality_rules.keep_good(no_docs).count() == 0
    assert quality_rules.keep_good(odd_docs).count() <= odd_docs.count()


def test_filter_keeps_what_the_query_keeps(spark):
    docs = common.documents(spark, SF)
    kept = {r.doc_id for r in quality_rules.op4_quality_rules(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == kept


def test_clashing_names(spark):
    docs = common.documents(spark, SF).withColumns({"_pattern": F.lit("x"), "_n_words": F.lit(-1), "_base_failed": F.lit("y"), "__pattern": F.lit(0)})
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and out.where("_n_words <> -1 OR _pattern <> 'x'").count() == 0
    voted = quality_rules.vote(docs)
    assert voted.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in voted.columns}) == len(voted.columns)


def test_posterior_against_plain_em():
    """The same model written out, rule by rule and pattern by pattern."""
    rng = np.random.default_rng(1)
    good = rng.random(3000) < 0.7
    votes = np.where(good[:, None], rng.choice(3, (3000, 3), p=[0.05, 0.25, 0.7]), rng.choice(3, (3000, 3), p=[0.5, 0.3, 0.2]))
    counts = Counter("".join(map(str, v)) for v in votes)
    got = quality_rules.fit(counts, rounds=40, tolerance=0)
    total = sum(counts.values())
    strength = max(1.0, 0.001 * total)
    prior = {1: (0.02, 0.2, 0.78), 0: (0.4, 0.3, 0.3)}
    p = {}
    for k in counts:
        balance = k.count("2") - 4 * k.count("0")
        p[k] = 0.9 if balance > 0 else 0.1 if balance < 0 else 0.5
    for _ in range(40):
        share = (sum(p[k] * n for k, n in counts.items()) + strength * 0.8) / (total + strength)
        chance = {}
        for c in (0, 1):
            for rule in range(3):
                cells = [sum((p[k] if c else 1 - p[k]) * n for k, n in counts.items() if k[rule] == str(v)) + strength * prior[c][v] for v in range(3)]
                for v in range(3):
                    chance[c, rule, v] = cells[v] / sum(cells)
        for k in counts:
            a, b = share, 1 - share
            for rule, v in enumerate(k):
                a, b = a * chance[1, rule, int(v)], b * chance[0, rule, int(v)]
            p[k] = a / (a + b)
    assert all(abs(p[k] - got[k]) < 1e-6 for k in counts)
