import random

import numpy as np
import pytest
from framelake.llm import common, decontaminate
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_query_finds_every_verbatim_item(spark):
    docs = {r.doc_id: r.text for r in common.documents(spark, SF).collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    flat = lambda t: " ".join(decontaminate.words_of(t))
    planted = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {flat(x)} " in f" {flat(t)} "}
    got = decontaminate.op9_decontaminate(spark, SF).collect()
    assert planted and planted <= {(r.doc_id, r.item_id) for r in got}
    for r in got:  # whatever else is found shares most words in order, by the plain recurrence
        a, b = decontaminate.words_of(items[r.item_id]), decontaminate.words_of(docs[r.doc_id])
        assert brute_lcs(a, b) >= r.lcs * len(a) - 1e-9 and r.lcs >= 0.5


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            keep = row[k]
            row[k] = last + 1 if x == y else max(row[k], row[k - 1])
            last = keep
    return row[-1]


def test_lcs_against_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        assert decontaminate.lcs_length(a, b) == brute_lcs(a, b)


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(0)
    dense = (rng.random((120, 60)) < 0.2) * rng.random((120, 60)) @ np.diag(0.85 ** np.arange(60))
    rows = [([k for k in range(60) if r[k]], [float(r[k]) for k in range(60) if r[k]]) for r in dense]
    got = decontaminate.randomised_svd(spark.createDataFrame(rows, "terms array<int>, weights array<double>").repartition(3), 60, 10)
    exact = np.linalg.svd(dense)[2][:10].T
    assert np.allclose(np.linalg.norm(dense @ got, axis=0), np.linalg.norm(dense @ exact, axis=0), rtol=1e-3)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [some(rng.randrange(14, 60)) for _ in range(30)]
    docs = {}
    for k in range(200):
        docs[k] = some(rng.randrange(0, 400))
    for k, item in enumerate(items):  # paraphrases: a fifth of the words changed or left out; and mere quotations
        changed = [rng.choice(words) if rng.random() < 0.1 else w for w in item if rng.random() > 0.1]
        docs[1000 + k] = some(rng.randrange(0, 300)) + changed + some(rng.randrange(0, 300))
        docs[2000 + k] = some(100) + item[: len(item) // 4] + some(100)
    return (
        spark.createDataFrame([(d, " ".join(w).upper()) for d, w in docs.items()], "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"),
    )


def test_paraphrases_are_found_and_quotations_are_left(planted, monkeypatch):
    for block in (decontaminate.BLOCK_ITEMS, 7):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
        found = {(r.doc_id, r.item_id) for r in decontaminate.matches(*planted).collect()}
        assert sum((1000 + k, k) in found for k in range(30)) >= 27
        assert all(1000 <= d < 2000 for d, _ in found)


def test_verbatim_items_are_found_in_a_large_benchmark(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(5000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [some(rng.randrange(15, 60)) for _ in range(2000)]
    docs = [(k, " ".join(some(60) + item + some(60))) for k, item in enumerate(items)] + [(k, " ".join(some(200))) for k in range(2000, 2500)]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark).collect()} == {(k, k) for k in range(2000)}


def test_clean_and_odd_rows(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (1, "it's 3.14? été naïve straße")], "item_id long, text string")
    docs = odd_docs.withColumns({"item_id": F.lit(5), "lcs": F.lit(1)})
    out = decontaminate.clean(docs, benchmark)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([2, 3, 4, 6, 7, 8, 8, 9, None], key=str)
    assert decontaminate.clean(no_docs, benchmark).count() == 0
    assert decontaminate.matches(odd_docs, benchmark.limit(0)).count() == 0
    assert decontaminate.clean(odd_docs, benchmark.limit(0)).count() == odd_docs.count()


def test_paraphrases_against_all_pairs(planted):
    """Recall over all pairs whose longest common subsequence, in a stretch of the item's length and half of it more, is long enough."""
    docs, benchmark = ({r[0]: decontaminate.words_of(r[1]) for r in t.collect()} for t in planted)
    truth = set()
    for d, words in docs.items():
        for i, item in benchmark.items():
            span, step = len(item) + len(item) // 2 + 2, max(1, len(item) // 8)
            if len({*item} & {*words}) >= len({*item}) // 2:
                numbers = {w: k for k, w in enumerate({*item, *words})}
                flat, own = [numbers[w] for w in words], [numbers[w] for w in item]
                if any(decontaminate.lcs_length(own, flat[a : a + span]) >= 0.75 * len(own) for a in range(0, max(1, len(flat)), step)):
                    truth.add((d, i))
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(*planted).collect()}
    assert len(truth) > 20 and len(truth & found) >= 0.95 * len(truth)


def test_common_words_change_no_match(spark, planted, monkeypatch):
    table = common.documents(spark, SF).select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    for docs, benchmark in (planted, table):
        some = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark).collect()}
        monkeypatch.setattr(decontaminate, "COMMON", -1.0)
        whole = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark).collect()}
        monkeypatch.undo()
        assert whole and whole <= some


def test_long_items_are_checked_whole(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    item = [rng.choice(words) for _ in range(1500)]
    texts = [item[:600], item, [w for w in item if rng.random() > 0.15], item[:1300], *([rng.choice(words) for _ in range(200)] for _ in range(60))]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(docs, benchmark).collect()} == {1, 2, 3}


def test_items_that_share_an_id(spark):
    text = "the quick brown fox jumps over one lazy dog near the old stone bridge"
    docs = spark.createDataFrame([(1, text), (2, "nothing of it")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, text), (1, text), (None, text)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark).where("item_id IS NOT NULL").collect()) == [(1, 1)]
    assert decontaminate.clean(docs, benchmark).count() == 1
