import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from framelake.llm import common, language, quality_model, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def held(doc, fold, mod):
    return zlib.crc32(str(doc).encode()) % mod == fold


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_toxicity_neighbours_are_exact():
    rng = np.random.default_rng(0)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    bad = ["nasty", "vile", "awful", "horrid"]
    rows = []
    for k in range(700):
        y = int(k % 5 == 0)
        text = " ".join(rng.choice(words, 30).tolist() + (rng.choice(bad, int(rng.integers(1, 5))).tolist() if y else []))
        rows.append((text, y, k))
    index = toxicity.Index(rows, toxicity.Settings())
    vectors = [index.vector(t) for t, _, _ in rows]
    dense = np.zeros((len(rows), len(index.vocabulary)))
    for k, (terms, values) in enumerate(vectors):
        dense[k, terms] = values
    for k in range(0, 700, 7):
        found, cosines = index.nearest(vectors[k])
        exact = np.sort(dense @ dense[k])[::-1][: index.k]
        assert np.allclose(cosines, exact[exact > 0][: len(cosines)]) and len(cosines) == min(index.k, (exact > 1e-15).sum())
        assert np.allclose(dense[index.docs[found]] @ dense[k], cosines)
    assert auc([(index.score(t)[0], y) for t, y, _ in rows]) > 0.99
    assert index.size == len(rows) and dense.any(1).all()  # every row is an example
    for k in range(0, 700, 50):  # votes and scores, written out
        cosines = dense @ dense[k]
        best = sorted(range(700), key=lambda i: (-round(cosines[i], 12), i))[: index.k]
        weights = [cosines[i] / (1.1 - min(cosines[i], 1)) for i in best if cosines[i] > 0]
        vote = (sum(w * rows[i][1] for w, i in zip(weights, best, strict=False)) + 0.1 * index.share) / (sum(weights) + 0.1)
        a, b = index.calibration
        assert math.isclose(index.score(rows[k][0])[0], 1 / (1 + math.exp(-(a * math.log(vote / (1 - vote)) + b))), rel_tol=1e-6)


def test_best_window_against_all_windows():
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    rows = [(" ".join([*rng.choice(words, 40), *(["vile", "horrid"] if k % 4 == 0 else []), *rng.choice(words, 40)]), int(k % 4 == 0), k) for k in range(300)]
    index = toxicity.Index(rows, toxicity.Settings(window=5))
    assert {"vile", "horrid"} <= set(index.telling)
    for text, _, _ in rows:
        own = text.split()
        gains = [sum(index.telling.get(w, 0) for w in own[a : a + 5]) for a in range(len(own) - 4)]
        best = next(a for a, g in enumerate(gains) if g >= max(gains) - 1e-9)
        assert index._best(own) == own[best : best + 5]


def test_toxicity_looks_at_all_words_of_a_text():
    """Wherever a word stands it counts, and so do several insults far apart, in examples and in texts."""
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    rows = [(" ".join([*rng.choice(words, 60), *(["vile"] if k % 4 == 0 else []), *rng.choice(words, 60)]), int(k % 4 == 0), k) for k in range(400)]
    index = toxicity.Index(rows, toxicity.Settings())
    for text, _, _ in rows[:20]:  # far behind the first words, and far from the most telling ones
        for more in (" wxx", " vile"):
            own = text + " waa" * 30
            terms, values = index.vector(own)
            assert {index.vocabulary[w] for w in own.split()} <= {*terms.tolist()}
            assert len(index.vector(own + " " + text)[0]) == len(terms) and (more == " wxx" or not np.array_equal(index.vector(own + more)[1], values))
        assert {index.vocabulary[w] for w in text.split()} <= {*index.vector("waa " * 500 + text)[0].tolist()}
    one, two = (index.score(" ".join(["waa"] * 100 + ["vile"] * n + ["wab"] * 100 + ["vile"] * n))[0] for n in (0, 1))
    assert one < 0.5 < two
    texts = [t for t, _, _ in rows[:300]] + [None, "", "unknown", "vile"]
    assert [index.score(t) for t in texts] == index.scores(texts)  # in any batch


def test_curve_is_the_best_and_no_order_breaks_it():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(-3, 2, 900), rng.normal(9, 1, 60)])
    y = np.concatenate([np.zeros(900), np.ones(60)])
    loss = lambda a, b: (np.logaddexp(0, a * x + b) - y * (a * x + b)).sum() + ((a - 1) ** 2 + b * b) / 2
    a, b = toxicity.fit_curve(x, y)
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-6 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    order = rng.permutation(len(x))
    assert np.allclose(toxicity.fit_curve(x[order], y[order]), (a, b), atol=1e-4)
    slope, _ = toxicity.fit_curve(-x, y)
    assert slope > 0


def test_toxicity_held_out_in_any_order_of_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in common.documents(spark, folder).select("doc_id", "text").collect() if r.doc_id in labels}
    learn = [(texts[d], int(y), d) for d, y in sorted(labels.items()) if d in texts and not held(d, 0, 5) and len(texts[d] or "") <= toxicity.Settings().chars]
    test = [(texts[d], y) for d, y in labels.items() if d in texts and held(d, 0, 5)]
    for seed in range(3):
        index = toxicity.Index([learn[k] for k in np.random.default_rng(seed).permutation(len(learn))], toxicity.Settings())
        scores = [(index.score(t)[0], y) for t, y in test]
        assert auc(scores) >= 0.95
        assert np.mean([s >= 0.5 for s, y in scores if y]) >= 0.85 and np.mean([s >= 0.5 for s, y in scores if not y]) < 0.02


def test_toxicity_index_stays_out_of_the_driver(spark, monkeypatch):
    """A driver short of memory once got nothing of a large index from collect(), without an error, and every score was 0.5."""
    docs = common.documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    path = toxicity.fit(docs, labels, "toxic")
    assert len(path) < 1000 and toxicity.load(path).size > 300
    scores = [r.score for r in toxicity.score(docs, path).collect()]
    assert len({*scores}) > 300 and min(scores) < 0.1 and max(scores) > 0.9
    collect = type(docs).collect
    with monkeypatch.context() as lost:
        lost.setattr(type(docs), "collect", lambda self: collect(self)[:0])
        with pytest.raises(RuntimeError, match="did not come back"):
            toxicity.fit(docs, labels, "toxic")


def test_toxicity_neighbours_are_the_same_by_blocks_and_whole(monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(676)]
    rows = [(" ".join([*rng.choice(words, int(rng.integers(1, 120))), *(["vile"] if k % 9 == 0 else [])]), int(k % 9 == 0), k) for k in range(900)]
    index = toxicity.Index(rows, toxicity.Settings())
    texts = [t for t, _, _ in rows[::7]] + ["vile", "waax", "vile waax wabx", "unknown"]
    vectors = [index.vector(t) for t in texts]
    dense = np.zeros((len(rows), len(index.vocabulary)))
    for k, (t, _, _) in enumerate(rows):
        terms, values = index.vector(t)
        dense[k, terms] = values
    for peak, few, long in ((0.4, 8, 48), (0.0, 1, 48), (0.0, 10**9, 2), (2.0, 8, 2), (2.0, 8, 10**9)):
        for name, value in (("PEAK", peak), ("FEW", few), ("LONG", long)):
            monkeypatch.setattr(toxicity, name, value)
        for (terms, values), (found, cosines) in zip(vectors, index._nearest_of(vectors, [-1] * len(vectors)), strict=True):
            exact = dense[:, terms] @ values
            best = sorted((k for k in range(len(rows)) if exact[k] > 0), key=lambda k: (-round(exact[k], 12), k))[: index.k]
            assert index.docs[found].tolist() == best and np.allclose(cosines, exact[best])


def test_quality_training_against_plain_updates():
    """Follow the regularised leader with dictionaries, one weight at a time."""
    rng = np.random.default_rng(2)
    rows = [(" ".join(rng.choice(["good", "fine", "bad", "poor", "so", "and"], 12, p=[0.3, 0.3, 0.05, 0.05, 0.15, 0.15] if y else [0.05, 0.05, 0.3, 0.3, 0.15, 0.15])), int(y)) for y in rng.random(80) < 0.5]
    own = quality_model.Settings(bits=12, epochs=2)
    weights, bias = quality_model.train(rows, own)
    z, n = defaultdict(float), defaultdict(float)

    def weight(j):
        if abs(z[j]) <= own.l1:
            return 0.0
        return -(z[j] - math.copysign(own.l1, z[j])) / ((own.beta + math.sqrt(n[j])) / own.alpha + own.l2)

    for _ in range(2):
        for text, y in rows:
            slots, values = quality_model.features(text, 12)
            x = {**dict(zip(slots.tolist(), values.tolist(), strict=True)), "bias": 1.0}
            w = {j: weight(j) for j in x}
            p = 1 / (1 + math.exp(-sum(w[j] * v for j, v in x.items())))
            for j, v in x.items():
                g = (p - y) * v
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / own.alpha * w[j]
                n[j] += g * g
    assert np.allclose([weights[j] for j in range(1 << 12)], [weight(j) for j in range(1 << 12)], atol=1e-5) and math.isclose(bias, weight("bias"), abs_tol=1e-6)
    assert weights.any()


def test_toxicity_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = toxicity.op2_toxicity(spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == held(r.doc_id, 0, 5) for r in got)
    assert all(labels[d] in (0, 1) and not held(d, 0, 5) for r in got for d in r.evidence)
    test = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert auc(test) > 0.75
    assert np.mean([s >= 0.5 for s, y in test if not y]) < 0.03


def test_models_take_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (7, None, None), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    clash = odd_docs.withColumns({"label": F.lit("x"), "order": F.lit(1), "slots": F.lit(2)})
    for docs in (clash, no_docs):
        assert quality_model.score(docs, quality_model.fit(docs, labels, "quality")).count() == docs.count()
        assert toxicity.score(docs, toxicity.fit(docs, labels, "toxic")).count() == docs.count()
        out = language.predict(docs, language.fit(docs)).collect()
        assert len(out) == docs.count()
        for r in out:
            if r.doc_id in (2, 3, 4):
                assert (r.lang_pred, r.score) == ("und", 0.0)


def test_quality_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality_model.op8_quality_model(spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    test = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert auc(test) > 0.95
    assert np.mean([s >= 0.3 for s, y in test if y]) > 0.97


def brute_log(counts, gram, letters):
    """Interpolated Kneser-Ney from n-gram counts of the highest order, by the textbook."""
    level, levels = dict(counts), []
    for _ in range(language.ORDER):
        levels.append(level)
        level = dict(Counter(g[1:] for g in level))
    p = 1 / letters
    for size in range(1, language.ORDER + 1):
        level, own = levels[language.ORDER - size], gram[-size:]
        same = [n for g, n in level.items() if g[:-1] == own[:-1]]
        if same:
            p = (max(level.get(own, 0) - language.DISCOUNT, 0) + language.DISCOUNT * len(same) * p) / sum(same)
    return math.log(p)


def test_language_models_against_brute_force(spark):
    texts = [("en", "the cat sat on the mat with that hat"), ("de", "die Katze sitzt auf der Matte"), ("en", "then they thought"), (None, "nichts")]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    models = language.fit(docs)
    counts = defaultdict(Counter)
    for lang, text in texts[:3]:
        for w in text.lower().split():
            counts[lang].update(language._grams(w))
    assert models.langs == ["de", "en"]
    for gram in ("  th", "that", "atz ", "xyz ", "   q"):
        assert np.allclose(models.logs([gram])[0], [brute_log(counts[lang], gram, models.letters) for lang in ("de", "en")])
    for context in ("  t", "tha"):  # a distribution
        letters = {g[-1] for g in counts["en"]}
        assert sum(math.exp(models.logs([context + c])[0, 1]) for c in letters) <= 1 + 1e-9


def test_ngrams_with_close_hashes_do_not_share_counts(spark):
    seen = {}
    for k in range(26**4):
        gram = "".join(chr(97 + k // 26**j % 26) for j in range(4))
        other = seen.setdefault(language.slot(gram) & ((1 << 20) - 1), gram)
        if other != gram and other[:3] != gram[:3]:
            break
    text = f"{other} {other} {other} {gram[:3]}z"  # the context of gram is known, gram is not
    models = language.fit(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"))
    counts = Counter(g for w in text.split() for g in language._grams(w))
    assert gram not in counts and np.allclose(models.logs([gram])[0], [brute_log(counts, gram, models.letters)])


def test_language_query(spark):
    langs = {r.doc_id: r.lang for r in common.documents(spark, SF).collect()}
    got = language.op3_language(spark, SF).collect()
    assert len(got) == 1000 and all(r.held_out == held(r.doc_id, 1, 3) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in test]) > 0.98
    assert np.mean([r.accepted for r in test]) > 0.95


def test_language_model_without_a_language():
    assert language.Models([]).predict("text")[:2] == ("und", 0.0)


def test_calibration_leaves_its_own_rows_out(spark):
    docs = common.documents(spark, SF).where(~common.held_out(1, 3)).limit(300)
    docs = spark.createDataFrame(docs.select("doc_id", "text", "lang").collect(), "doc_id long, text string, lang string")
    models = language.fit(docs)
    rows = [r for r in docs.collect() if r.lang is not None]
    out = {r.doc_id for r in docs.where((F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(language.SAMPLE_FOLDS)) == 0) & (F.length("text") <= language.SAMPLE_CHARS)).collect()}
    sample = sorted((r.lang, r.text) for r in rows if r.doc_id in out and r.lang is not None)
    rest = language.Models(language.packed(language.statistics(language.gram_counts(docs.where(~F.col("doc_id").isin(*out))))))
    assert sample and rest.langs == models.langs
    rest.calibrate(sample)
    assert math.isclose(models.limit, rest.limit, rel_tol=1e-9) and models.sharpness == rest.sharpness
