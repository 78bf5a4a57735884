"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of words, weighted by TF-IDF whose document frequencies come from the whole corpus. A
randomised SVD, whose products with the passage matrix are Spark jobs, gives the latent space. (It is the benchmark's passages
that span it: what is orthogonal to all of them adds nothing to any cosine with them, and the corpus's own leading directions
are but its commonest words.) Passages are dealt to spaces of at most as many passages as the rank, so a space holds its passages
whole and a cosine in it is that of the words' vectors, however many passages there are. Each document is cut into overlapping windows, each window is projected, and passages with a
cosine of at least the limit are candidates; a window's projected length bounds all its cosines, so most windows need no
product. Candidates are checked on whole words: the longest common subsequence of item and text around the window, and the
share of the item's answer (the words after its last question mark, else its rarest words) that the text has.

The corpus is read twice, once for the document frequencies and once for the search, and never shuffled. Large benchmarks are
searched in blocks of at most BLOCK_ITEMS items and about BLOCK_WORDS words, whose models are files in the shared folder; a
task searches each batch of its documents with one block after the other, so it holds one of them at a time. The driver
holds the benchmark's words, which are the stated query set. Items are checked whole, however long they are.

Defined cases: null or empty texts match nothing; a very long text is searched whole; null doc_ids are kept; repeated documents
match each; of items that share an id (ties, repeated rows) each is searched and the best match is given; an empty benchmark or
table gives no rows; other columns, whatever their names, are ignored by matches() and kept by clean().
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import common, store

_WORD = re.compile(r"[^\W_]+")
#: Items of a block, and words of its items, about.
BLOCK_ITEMS, BLOCK_WORDS = 2000, 200_000
#: Of ASCII, all but letters and digits are gaps between words.
_GAPS = "".join(chr(k) if chr(k).isalnum() else " " for k in range(128))
#: Words in more documents than e^-COMMON of them carry next to no weight and are left out of the vectors, not of the checks.
COMMON = 1.0


@dataclass(frozen=True)
class Settings:
    window: int = 32
    stride: int = 16
    rank: int = 256
    cosine: float = 0.45
    #: Share of an item's words in common order that is enough, and that is enough if the answer's share is there too.
    lcs: float = 0.75
    lcs_with_answer: float = 0.5
    answer: float = 0.75


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    low = (text or "").lower()
    return low.translate(_GAPS).split() if low.isascii() else _WORD.findall(low)  # the same words, faster


def answer_words(text: str, words: list[str], idf: dict[str, float]) -> list[str]:
    after = words_of(text.rpartition("?")[2]) if "?" in text else []
    return after or sorted(set(words), key=lambda w: (-idf.get(w, 0.0), w))[:5]


def lcs_length(item: list[int], text: list[int]) -> int:
    """Longest common subsequence, bit-parallel over the item."""
    at: dict[int, int] = {}
    for k, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        if w in at:
            hit = row & at[w]
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many documents each word of the vocabulary is, and how many documents there are."""
    held = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(vocabulary)})

    def run(parts):
        known, counts, n = held.value, np.zeros(len(held.value), "i8"), 0
        for part in parts:
            for text in part.column(0).to_pylist():
                n += 1
                counts[[known[w] for w in {*words_of(text)} & known.keys()]] += 1
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *there.tolist()], pa.int64()), pa.array([n, *counts[there].tolist()], pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r[0]: r[1] for r in rows}
    return {vocabulary[k]: n for k, n in found.items() if k >= 0}, found.get(-1, 0)


def randomised_svd(passages: DataFrame, columns: int, rank: int, rounds: int = 2, seed: int = 42) -> np.ndarray:
    """The leading right singular vectors (columns x rank) of the rows (terms array<int>, weights array<double>).

    Each round multiplies by the transposed matrix times the matrix in one Spark job: tasks add up their rows' parts of each
    column, and the parts are summed by column, each in its own group. Only the product itself comes to the driver.
    """
    rank = min(rank, columns)
    spark = passages.sparkSession

    def product(basis: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(basis)

        def part(batches):
            own, sums = held.value, {}
            for batch in batches:
                for terms, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    w = np.array(weights)
                    for term, row in zip(terms, np.outer(w, w @ own[terms]), strict=True):
                        sums[term] = sums[term] + row if term in sums else row
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["term", "part"])

        def add(key, table):
            total = sum(np.frombuffer(x.as_py()) for x in table.column("part"))
            return pa.table({"term": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

        out = np.zeros(basis.shape)
        for term, total in passages.select("terms", "weights").mapInArrow(part, "term int, part binary").groupBy("term").applyInArrow(add, "term int, total binary").collect():
            out[term] = np.frombuffer(total)
        held.destroy()
        return out

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((columns, min(columns, rank + 16))))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(product(basis))[0]
    values, vectors = np.linalg.eigh(basis.T @ product(basis))
    return basis @ vectors[:, np.argsort(-values)[:rank]]


class Model:
    """What documents are searched with: words, their weights and latent vectors, passages, items and their answers."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, str]], frequencies: dict[str, int], documents: int, settings: Settings):
        self.settings, self.ids = settings, [i for i, _ in items]
        item_words = [words_of(t) for _, t in items]
        names = sorted({w for ws in item_words for w in ws})
        self.words = {w: k for k, w in enumerate(names)}
        idf = {w: float(np.log((documents + 1) / (frequencies.get(w, 0) + 0.5))) for w in names}
        self.idf = np.array([max(idf[w], 0.01) for w in names])
        self.items = [[self.words[w] for w in ws] for ws in item_words]
        self.rare = self.idf >= COMMON
        for ids in self.items:
            if self.rare[ids].mean() < 0.25:  # an item of common words, or nearly so, keeps them
                self.rare[ids] = True
        self.answers = [[self.words[w] for w in answer_words(t, ws, idf)] for (_, t), ws in zip(items, item_words, strict=True)]
        rows, self.owner = [], []  # distinct terms and weights of each passage, and its item
        for k, ids in enumerate(self.items):
            for a in self._starts(len(ids)):
                terms, counts = np.unique([i for i in ids[a : a + settings.window] if self.rare[i]], return_counts=True)
                if not len(terms):
                    continue
                weights = counts * self.idf[terms]
                rows.append((terms.tolist(), (weights / np.linalg.norm(weights)).tolist()))
                self.owner.append(k)
        self.spaces, most = [], []
        for own in np.array_split(np.arange(len(rows)), max(1, -(-len(rows) // settings.rank))):
            if len(own):
                self.spaces.append(self._space(spark, rows, own))
                most.append(np.zeros(len(names)))
            for k in own:
                terms, weights = rows[k]
                most[-1][terms] = np.maximum(most[-1][terms], self.idf[terms] * weights)
        self.most = np.stack(most, 1) if most else np.zeros((len(names), 0))  # the most that a word adds to a window's product with a passage of each space

    def _space(self, spark: SparkSession, rows: list, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The latent space of the passages own, at most as many as the rank: each word's row of vectors (-1: none), what a word adds to a window's projection, the passages, and the first one's number."""
        terms = np.unique(np.concatenate([rows[k][0] for k in own]))
        row = np.full(len(self.idf), -1)
        row[terms] = np.arange(len(terms))
        held = [(row[rows[k][0]].tolist(), rows[k][1]) for k in own]
        kinds = [pa.list_(pa.int32()), pa.list_(pa.float64())]
        held_table = pa.table([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["terms", "weights"])
        # as Arrow, so no workers for rows are started; with one part the sums by column would share a stage, and so twice the workers, with what makes the parts
        table = spark.createDataFrame(held_table).repartition(2)
        right = randomised_svd(table, len(terms), self.settings.rank)
        latent = np.stack([np.array(w) @ right[t] for t, w in held])
        return row, (self.idf[terms, None] * right).astype("f4"), latent.astype("f4"), int(own[0])

    def _starts(self, n: int) -> list[int]:
        """Every window but those that lie wholly in the one before."""
        return list(range(0, max(1, n - self.settings.window + self.settings.stride), self.settings.stride))

    def search(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """item_id, cosine, LCS share and answer share of each item that the text has."""
        s = self.settings
        known = self.words.get
        own = [known(w, -1) for w in words_of(text)]
        ids = np.array(own, "i8")
        place = np.flatnonzero(self.rare[ids] & (ids >= 0))
        if not len(place):
            return []
        known = ids[place]  # of the weighted words
        per = s.window // s.stride
        size = int(place[-1]) // s.stride + per

        def windows(at: np.ndarray, values: np.ndarray) -> np.ndarray:
            """Sums over windows of the values of words at places: the window that starts at block b has blocks b to b + per - 1; here at index b + per - 1."""
            blocks, cut = np.unique(at // s.stride, return_index=True)
            sums = np.add.reduceat(values, cut)
            total = np.zeros((size, *sums.shape[1:]), sums.dtype)
            for j in range(per):
                total[blocks + per - 1 - j] += sums
            return total

        norm = np.maximum(np.sqrt(windows(place, self.idf[known] ** 2)), 1e-9)
        able = windows(place, self.most[known]) >= s.cosine * norm[:, None] * (1 - 1e-5)
        block = place // s.stride
        hits = []
        for k, (rows, latent, passages, first) in enumerate(self.spaces):
            row = rows[known]
            live = able[:, k]
            used = (row >= 0) & np.logical_or.reduce([live[block + j] for j in range(per)])  # words of windows that can reach the limit
            if not used.any():
                continue
            total = windows(place[used], latent[row[used]])
            near = np.flatnonzero(live & (np.einsum("ij,ij->i", total, total) >= (s.cosine * norm) ** 2 * (1 - 1e-5)))
            if len(near):
                cosines = total[near] @ passages.T / norm[near, None]
                hits += [(int(near[w]), first + p, float(cosines[w, p])) for w, p in np.argwhere(cosines >= s.cosine).tolist()]
        best: dict[int, tuple[float, float, float]] = {}
        done: set[tuple[int, int]] = set()
        for w, p, cosine in sorted(hits):
            item = self.owner[p]
            start = (w - per + 1) * s.stride
            size = len(self.items[item])
            if (item, start) in done:
                continue
            done.add((item, start))
            around = own[max(0, start - size) : start + s.window + size]
            share, answer = self._shares(item, around)
            if share >= s.lcs or share >= s.lcs_with_answer and answer >= s.answer:
                found = share, answer, cosine
                best[item] = max(best.get(item, found), found)
        by_id: dict[int, tuple[float, float, float]] = {}
        for k, found in best.items():
            by_id[self.ids[k]] = max(by_id.get(self.ids[k], found), found)
        return [(i, c, share, answer) for i, (share, answer, c) in sorted(by_id.items(), key=str)]

    def _shares(self, item: int, around: list[int]) -> tuple[float, float]:
        """The best LCS share in stretches of the item's length and half of it more, and the answer's share in all of them."""
        ids, answer = self.items[item], self.answers[item]
        there = {*around}
        if sum(i in there for i in ids) < self.settings.lcs_with_answer * len(ids):  # no order can save it
            return 0.0, 0.0
        span = len(ids) + len(ids) // 2 + 2
        step = max(1, len(ids) // 4)
        stretches = [around[a : a + span] for a in range(0, max(1, len(around) - span + step), step)]
        share = max(lcs_length(ids, x) for x in stretches) / len(ids)
        mass = self.idf[answer]
        return share, float(mass[[a in there for a in answer]].sum() / mass.sum())


MATCHES = "doc_id long, item_id long, cosine double, lcs double, answer double"


def _blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The stated query set, in blocks."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull()).collect()
    out, words = [], 0
    for i, text in sorted(((r[0], r[1]) for r in rows), key=str):
        own = len(words_of(text))
        if own and (not out or len(out[-1]) >= BLOCK_ITEMS or words + own > BLOCK_WORDS):
            out.append([])
            words = 0
        if own:
            out[-1].append((i, text))
            words += own
    return out


def _models(docs: DataFrame, benchmark: DataFrame, settings: Settings) -> list[str]:
    """Files of the models, one for each block of items."""
    common.small_batches(docs.sparkSession)
    spark, blocks = docs.sparkSession, _blocks(benchmark)
    if not blocks:
        return []
    frequencies, documents = document_frequencies(docs, sorted({w for items in blocks for _, t in items for w in words_of(t)}))
    folder = common.fresh_path(spark, "benchmark")
    store.make_dir(folder)
    paths = [f"{folder}/block-{k}" for k in range(len(blocks))]
    for path, items in zip(paths, blocks, strict=True):
        store.put(path, pickle.dumps(Model(spark, items, frequencies, documents, settings)))
    return paths


_HELD: dict[str, Model] = {}


def _model(path: str) -> Model:
    """The model of a file; a worker holds the last one only."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = pickle.loads(store.get(path))
    return _HELD[path]


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, cosine, lcs and answer of each document and benchmark item that it has."""
    paths = _models(docs, benchmark, settings)
    if not paths:
        return docs.sparkSession.createDataFrame([], MATCHES)

    def run(parts):
        for part in parts:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for path in paths:
                model = _model(path)
                rows = [(doc, *hit) for doc, text in zip(ids, texts, strict=True) for hit in model.search(text)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = [pa.int64()] * 2 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs without the rows whose text has a benchmark item; nothing is joined or shuffled."""
    paths, at = _models(docs, benchmark, settings), docs.columns.index("text")
    if not paths:
        return docs

    def run(parts):
        for part in parts:
            for path in paths:
                model = _model(path)
                part = part.filter(pa.array([not model.search(t) for t in part.column(at).to_pylist()], pa.bool_()))
            yield part
        common.trim()

    return docs.mapInArrow(run, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
