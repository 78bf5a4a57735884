import numpy as np
import pytest
import xxhash
from framelake.llm import common, simhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute_print(text, shingle=4):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in (text or "").translate(low).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=4):
    """(doc, fp) -> component of each row, by comparing all pairs."""
    fps = sorted({f for _, f in prints})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in prints), key=str)


def test_query_against_brute_force(spark):
    got = sorted((tuple(r) for r in simhash.op6_simhash(spark, SF).collect()), key=str)
    assert got == brute_groups([(r.doc_id, brute_print(r.text)) for r in common.documents(spark, SF).collect()])


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.groups(common.materialise(simhash.fingerprints(odd_docs).drop("text"), "t"))
    rows = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got.collect()), key=str)
    assert rows == brute_groups([(r.doc_id, brute_print(r.text)) for r in odd_docs.collect()])
    assert simhash.groups(common.materialise(simhash.fingerprints(no_docs), "t")).count() == 0


def test_chains_and_clusters(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    fps = list(base)
    for b in base[:6]:  # chains of up to 4 changed bits a step, and clusters
        x = b
        for _ in range(12):
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
        fps += [b ^ 1 << k for k in range(30)]
    prints = [(k, f) for k, f in enumerate(rng.permutation(np.array(fps, "u8")).tolist())]
    frame = spark.createDataFrame([(k, int(np.uint64(f).view("i8"))) for k, f in prints], "doc_id long, fp long")
    for bits in (4, 8):
        got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.groups(frame, cell_bits=bits).collect()), key=str)
        assert got == brute_groups(prints)


def test_cells_split_their_variants(monkeypatch):
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([x ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype="u8")) for x in rng.integers(0, 2**63, 10, dtype="u8")]))
    whole = {tuple(x) for x in simhash.cell_links(fps, int(fps[0] >> np.uint64(60)), 4, 2).tolist()}
    monkeypatch.setattr(simhash, "HELD_VARIANTS", 5000)
    parts = {tuple(x) for x in simhash.cell_links(fps, int(fps[0] >> np.uint64(60)), 4, 2).tolist()}

    def groups(links):
        parent = {x: x for p in links for x in p}
        for _ in parent:
            for a, b in links:
                parent[a] = parent[b] = min(parent[a], parent[b])
        return parent

    assert groups(whole) == groups(parts)


def test_keep_one(spark, odd_docs):
    out = simhash.keep_one(odd_docs.withColumn("fp", F.lit(1)))
    assert out.columns == [*odd_docs.columns, "fp"]
    ids = [r.doc_id for r in out.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 5, 6, 7, 9, None], key=str)
    assert simhash.keep_one(odd_docs.limit(0)).count() == 0


def brute_sets(text, shingle=5):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()


def test_keep_one_reaches_a_similarity_of_four_fifths(spark):
    rng = np.random.default_rng(3)
    some = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]
    texts = []
    for _ in range(60):  # copies with some words changed: similarities on both sides of 0.8, chains, equal sets, and a longer copy
        base = some(int(rng.integers(60, 400)))
        texts.append(base)
        for _ in range(4):
            base = list(base) if rng.random() < 0.5 else list(texts[-1])
            for k in rng.integers(0, len(base), max(1, int(len(base) * rng.choice([0.005, 0.015, 0.022, 0.03, 0.06])))):
                base[k] = f"x{rng.integers(0, 10**6)}"
            texts.append(base)
    texts += [["a", "b", "c", "d", "e"] * 20, ["a", "b", "c", "d", "e"] * 30 + ["a"], ["short", "one"], []]
    texts = [" ".join(t) for t in texts]
    sets = [brute_sets(t) for t in texts]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    prints = [brute_print(t, 5) for t in texts]
    apart = 0
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            near = shared and 10 * shared >= 8 * len(sets[i] | sets[j])
            bits = (prints[i] ^ prints[j]).bit_count()
            apart += bool(near and bits > 4)
            if near or bits <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert apart > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {find(k) for k in range(len(texts))}


def test_set_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([np.arange(40, dtype="u8"), rng.integers(100, 10**6, int(n), dtype="u8")])) for n in rng.integers(0, 14, 80)]
    similar = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9

    def roots(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        return label

    links = simhash.set_links(sets, 0.8)
    assert roots(links) == roots([(i, j) for i in range(80) for j in range(i) if similar(sets[i], sets[j])])
    assert all(similar(sets[i], sets[j]) for i, j in links) and len(links) < 80


def test_full_cells_are_cut_further(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 3, dtype="u8")
    one, two = rng.integers(0, 64, (2, 80), dtype="u8")
    fps = np.unique(np.concatenate([x ^ (np.uint64(1) << one) ^ (np.uint64(1) << two) for x in base]))  # all but a few bits are shared
    prints = list(enumerate(fps.tolist()))
    frame = spark.createDataFrame([(k, int(np.uint64(f).view("i8"))) for k, f in prints], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "HELD_FPS", 15)
    for bits in (None, 4):
        got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.groups(frame, cell_bits=bits).collect()), key=str)
        assert got == brute_groups(prints)


def test_sets_of_one_bucket_in_blocks(spark, monkeypatch):
    """Many texts that share much, most of them not enough: buckets hold several groups, in several blocks."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(simhash, "BLOCK_SETS", 4)
    base = [f"w{k}" for k in rng.integers(0, 9000, 300)]
    texts = []
    for _ in range(60):
        text = list(base)
        for at in rng.integers(0, 300, int(rng.integers(2, 12))):
            text[at] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(text))
    sets = [brute_sets(t) for t in texts]
    prints = [brute_print(t, 5) for t in texts]
    bits = {(i, j): (prints[i] ^ prints[j]).bit_count() for i in range(60) for j in range(i)}
    parent = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if bits[i, j] <= 4 or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(parent)
    assert len(set(parent)) > 5


def test_keep_one_keeps_clashing_names(spark):
    rows = [(1, "same text", "a", 1, 5), (1, "same text", "b", 2, 6), (2, "same text", "c", 3, 7), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, __row int, row_key int").withColumnRenamed("row_key", "_row_key")
    got = simhash.keep_one(docs).collect()
    assert sorted([tuple(r) for r in got], key=str)[-1] == (None,) * 5 and len(got) == 2
    assert {tuple(r) for r in got} <= set(rows)


def _smallest(links: set[tuple[int, int]]) -> dict[int, int]:
    around: dict[int, set[int]] = {}
    for a, b in links:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    out: dict[int, int] = {}
    for start in sorted(around):
        todo = [start] if start not in out else []
        while todo:
            if (node := todo.pop()) not in out:
                out[node] = start
                todo += around[node]
    return out


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), max_size=25))
def test_stars_keep_groups(links):
    a, b = (np.array([x[k] for x in sorted(links)], "i8") for k in (0, 1))
    own = dict(zip(*(x.tolist() for x in simhash.stars(a, b)), strict=True))
    assert own == {n: r for n, r in _smallest(links).items() if n != r}


@pytest.mark.parametrize("held", [3, 1_000_000])
def test_components_of_paths_stars_and_rings(spark, monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD_LINKS", held)
    path = {(k, k + 1) for k in range(0, 60)}
    star = {(100, 100 + k) for k in range(1, 80)}
    ring = {(300 + k, 300 + (k + 7) % 50) for k in range(50)}
    links = path | star | ring | {(-5, 999), (7, 7)}
    rows = spark.createDataFrame(sorted(links), "a long, b long").repartition(7)
    found = {r.node: r.root for r in simhash.components(rows).collect()}
    assert found == _smallest(links)
    assert simhash.components(rows.where("false")).isEmpty()
