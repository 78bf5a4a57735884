"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Every labelled row of the sample is an example, over the whole vocabulary: lower-cased words, and the first letters of longer
ones. Texts and examples are vectors of all their words, wherever they stand. As the rest of a text would drown an insult, a
term's TF-IDF weight is scaled by how far its association with the label exceeds what the best of as many unrelated terms would
reach; no term's scale is zero. Examples are stored in an inverted index of aligned blocks: for each term and block of examples
the largest weight, which bounds any cosine in the block, and the block's postings. The terms with the most postings are rows of
a matrix instead, and a batch of queries is multiplied with it, which gives their exact part of all cosines. A query scores the
blocks with the highest bounds, and then those whose bound reaches the k-th cosine so far, so its k neighbours are exact; where
these are many, it reads its terms' postings in whole runs, over all blocks. The neighbours'
labels vote, weighted by distance; a logistic curve fitted on leave-one-out votes calibrates the score, and the neighbours are
returned as evidence, with the text's passage of words that go most with the label, which no score depends on.

The index is fitted in one task on a bounded, hash-drawn sample of labelled rows, which bounds its size. The task writes it to the
shared folder, where the workers read it: it does not pass through the driver.

Defined cases: a text without any known term (null or empty too) has no neighbours, and its vote is the share of label 1; a
very long text is read whole; a null doc_id takes no part in learning; repeated rows are scored each; ties between passages go
to the first one, ties in cosine to the example that was drawn first; without a labelled row every score is 0.5; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import common, store
from framelake.llm.quality_model import labelled_sample

_WORD = re.compile(r"[^\W\d_]+")
PREFIX = 5
BLOCK = 64
#: Terms with the most postings, whose weights are a matrix; vectors that are multiplied with it at once.
COMMON, AT_ONCE = 512, 128
#: Words whose terms a worker keeps at most.
KEPT_WORDS = 200_000
#: All postings of a vector's terms are read at once where no weight is so large that bounds tell blocks apart, or where more
#: than one in FEW blocks are left.
PEAK, FEW = 0.7, 8
#: Runs of so many postings are copied whole.
LONG = 48
#: A posting, which is copied as one number.
POSTING = np.dtype([("example", "i4"), ("weight", "f4")])


@dataclass(frozen=True)
class Settings:
    #: Bounds of the training sample: labelled rows drawn, and characters of one of them.
    rows: int = 12_000
    chars: int = 10_000
    k: int = 15
    #: Words of the passage that is shown, and the scale of a term without association.
    window: int = 12
    floor: float = 0.03


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _terms(words: list[str]) -> list[str]:
    return words + [w[:PREFIX] + "-" for w in words if len(w) > PREFIX]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start to before its end, one range after the other, and the ranges' lengths."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), sizes


def _runs(starts: np.ndarray, ends: np.ndarray, array: np.ndarray) -> np.ndarray:
    """The array's elements at _ranges(), where these are in descending order of their lengths."""
    cut = int((ends - starts >= LONG).sum())
    rest, _ = _ranges(starts[cut:], ends[cut:])
    return np.concatenate([*map(array.__getitem__, map(slice, starts[:cut].tolist(), ends[:cut].tolist())), array[rest]])


class Index:
    def __init__(self, rows: list[tuple[str | None, int, int]], settings: Settings):
        """rows: text, label (0 or 1), doc_id."""
        self.k, self.window, self.known = settings.k, settings.window, {}
        same: dict[str, str] = {}  # one object a word
        words = [[same.setdefault(w, w) for w in _words(text)] for text, _, _ in rows]
        self.labels = np.array([y for _, y, _ in rows], float)
        self.docs, self.rank = np.array([d for _, _, d in rows], "i8"), np.arange(len(rows))
        self.share = float((self.labels.sum() + 0.5) / (len(rows) + 1)) if rows else 0.5
        frequency, positive = Counter(), Counter()
        for own, y in zip(words, self.labels, strict=True):
            terms = {*_terms(own)}
            frequency.update(terms)
            if y:
                positive.update(terms)
        #: how far a term's signed root deviance exceeds the largest one that unrelated terms would reach
        least = np.sqrt(2 * np.log(max(2, sum(df > 1 for df in frequency.values()))))
        excess = {t: r for t, df in frequency.items() if df > 1 and abs(r := self._association(positive[t], df) / least) > 1}
        self.telling = {t: r - 1 for t, r in excess.items() if r > 0}
        self.vocabulary = {t: k for k, t in enumerate(frequency)}
        n = len(rows)
        scale = [settings.floor + max(0.0, abs(excess.get(t, 0.0)) - 1) for t in frequency]
        self.idf = np.log((n + 1) / (np.array(list(frequency.values()), float) + 0.5)) * np.array(scale)
        vectors = [self._vector(own) for own in words]
        self.known = {}
        order = sorted(range(n), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, i))  # alike examples share blocks
        vectors, self.labels, self.docs, self.rank = [vectors[i] for i in order], self.labels[order], self.docs[order], self.rank[order]
        self.size = n
        term = np.concatenate([v[0] for v in vectors] or [np.empty(0, "i8")])
        weight = np.concatenate([v[1] for v in vectors] or [np.empty(0)])
        example = np.repeat(np.arange(n), [len(v[0]) for v in vectors]).astype("i8")
        self.blocks = -(-n // BLOCK)
        common = np.argsort(-np.bincount(term, minlength=len(self.vocabulary)), kind="stable")[:COMMON]
        self.place = np.full(len(self.vocabulary), -1)  # of common terms, in the matrix
        self.place[common] = np.arange(len(common))
        inside = self.place[term] >= 0 if n else np.empty(0, bool)
        self.matrix = np.zeros((len(common), self.blocks * BLOCK))
        self.matrix[self.place[term[inside]], example[inside]] = weight[inside]
        term, weight, example = term[~inside], weight[~inside], example[~inside]
        by = np.lexsort((example, term))  # by term, then block
        postings = np.empty(len(by), POSTING)
        postings["example"], postings["weight"] = example[by], weight[by]
        self.postings = postings.view("u8")
        key = term[by] * max(1, self.blocks) + example[by] // BLOCK
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.array([], int)
        self.max_weight = np.maximum.reduceat(weight[by], cut) if len(key) else np.empty(0)
        self.max_weight, self.entry_block = self.max_weight.astype("f4"), (key[cut] % max(1, self.blocks)).astype("i4")
        self.entry_start = np.append(cut, len(key))
        self.term_start = np.searchsorted(key[cut] // max(1, self.blocks), np.arange(len(self.vocabulary) + 1))
        self.calibration = (1.0, 0.0)
        self._calibrate(vectors)

    def _association(self, a: int, df: int) -> float:
        """Signed root of the deviance of a term that is in df rows, a of them with label 1."""
        p = self.share
        deviance = 2 * sum(x * np.log(x / (df * e)) for x, e in ((a, p), (df - a, 1 - p)) if x)
        return float(np.sqrt(max(0.0, deviance)) * np.sign(a / df - p))

    def _best(self, words: list[str]) -> list[str]:
        """The first of the windows whose words go most with the label."""
        n, telling = self.window, self.telling
        if len(words) <= n:
            return words
        known = [k for k, w in enumerate(words) if w in telling]
        if not known:
            return words[:n]
        gain = np.zeros(len(words))
        gain[known] = [telling[words[k]] for k in known]
        total = np.concatenate(([0.0], np.cumsum(gain)))
        at = int(np.round(total[n:] - total[:-n], 9).argmax())
        return words[at : at + n]

    def _vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Terms in ascending order, and their weights, of all words that are known."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        bag, known, number = Counter(words), self.known, self.vocabulary.get
        for w in {*bag}.difference(known):  # two terms in one number: the word, and its first letters
            known[w] = (number(w, -1) + 1 << 32) + (number(w[:PREFIX] + "-", -1) + 1 if len(w) > PREFIX else 0)
        both = np.fromiter(map(known.__getitem__, bag), "i8", len(bag))
        counts = np.fromiter(bag.values(), "f8", len(bag))
        terms = np.concatenate((both >> 32, both & 0xFFFFFFFF)) - 1
        terms, at = np.unique(terms, return_inverse=True)
        counts = np.bincount(at, np.concatenate((counts, counts)), len(terms))
        terms, counts = terms[terms >= 0], counts[terms >= 0]
        values = (1 + np.log(counts)) * self.idf[terms]
        return terms, (values / np.sqrt((values * values).sum())).astype("f4").astype("f8") if len(terms) else values  # as postings hold them

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Of all words of the text that are known."""
        return self._vector(_words(text))

    def _common(self, vectors: list) -> np.ndarray:
        """The common terms' part of the cosine of each vector and example."""
        rows = np.zeros((len(vectors), len(self.matrix)))
        for row, (terms, values) in zip(rows, vectors, strict=True):
            at = self.place[terms]
            row[at[at >= 0]] = values[at >= 0]
        return rows @ self.matrix

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], without: int = -1, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosine over 0, and their cosines; ties go to the example drawn first. part: the vector's row of _common()."""
        terms, values = vector
        if not len(terms):
            return np.empty(0, "i8"), np.empty(0)
        part = self._common([vector])[0] if part is None else part
        starts, ends = self.term_start[terms], self.term_start[terms + 1]
        own = ends > starts  # the other terms are in part
        values, starts, ends, top = values[own], starts[own], ends[own], values.max()
        scores, scored = part.copy(), np.zeros(self.blocks, bool)

        def best() -> np.ndarray:
            """The k best examples of all scored blocks."""
            if without >= 0:
                scores[without] = 0
            some = scores if scored.all() else np.where(np.repeat(scored, BLOCK), scores, 0)
            least = np.partition(some, -self.k)[-self.k] if len(some) > self.k else 0.0
            found = np.flatnonzero((some >= least - 1e-11) & (some > 0))  # with all that tie with the last
            return found[np.lexsort((self.rank[found], -np.round(scores[found], 12)))[: self.k]]

        rest, found = np.ones(self.blocks, bool), np.empty(0, "i8")
        if top >= PEAK:
            entries, per = _ranges(starts, ends)
            weights, blocks = np.repeat(values, per), self.entry_block[entries]
            bound = part.reshape(-1, BLOCK).max(1) + np.bincount(blocks, weights * self.max_weight[entries], self.blocks)

            def add(some: np.ndarray) -> None:
                """Adds what is missing of the cosines in some blocks."""
                inside = some[blocks]
                own = entries[inside]
                at, per = _ranges(self.entry_start[own], self.entry_start[own + 1])
                posts = self.postings[at].view(POSTING)
                scores[:] += np.bincount(posts["example"], posts["weight"] * np.repeat(weights[inside], per), len(scores))
                scored[some] = True

            first = np.zeros(self.blocks, bool)
            first[np.argpartition(bound, -min(4, self.blocks))[-min(4, self.blocks) :]] = True
            add(first)
            found = best()
            rest = ~first & (bound > 0)
            if len(found) == self.k:  # blocks whose bound is lower have no better example
                rest &= bound >= scores[found[-1]] - 1e-11
            if rest.any() and rest.sum() * FEW <= self.blocks:
                add(rest)
                found, rest = best(), rest & False
        if rest.any():
            starts, ends = self.entry_start[starts], self.entry_start[ends]
            order = np.argsort(starts - ends)
            values, starts, ends = values[order], starts[order], ends[order]
            posts = _runs(starts, ends, self.postings).view(POSTING)
            scores[:] = part + np.bincount(posts["example"], posts["weight"] * np.repeat(values, ends - starts), len(scores))
            scored[:] = True
            found = best()
        return found, np.round(scores[found], 12)  # a product's last digits differ with the batch

    def _vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Votes weighted by the inverse of the distance 1 - cosine, and a small one of the share of label 1."""
        weight = cosines / (1.1 - np.minimum(cosines, 1))
        return float((weight @ self.labels[found] + 0.1 * self.share) / (weight.sum() + 0.1))

    def _calibrate(self, vectors: list) -> None:
        """The logistic curve of the vote's log-odds, on leave-one-out votes."""
        if not vectors:
            return
        step = -(-len(vectors) // 4000)  # as many votes as fix two numbers well
        some = range(0, len(vectors), step)
        near = self._nearest_of([vectors[i] for i in some], list(some))
        votes = np.array([self._vote(*found) for found in near])
        self.calibration = fit_curve(np.log(votes / (1 - votes)), self.labels[list(some)])

    def _nearest_of(self, vectors: list, without: list[int]):
        """nearest() of each vector."""
        for a in range(0, len(vectors), AT_ONCE):
            parts = self._common(vectors[a : a + AT_ONCE])
            for k, part in enumerate(parts, a):
                yield self.nearest(vectors[k], without[k], part)

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        """Score, neighbours' doc_ids and cosines of each text."""
        return self._scores([_words(t) for t in texts])

    def _scores(self, texts: list[list[str]]) -> list[tuple[float, list[int], list[float]]]:
        if not self.size:
            return [(0.5, [], [])] * len(texts)
        a, b = self.calibration
        out = []
        for found, cosines in self._nearest_of([self._vector(words) for words in texts], [-1] * len(texts)):
            vote = self._vote(found, cosines)
            out.append((float(1 / (1 + np.exp(-(a * np.log(vote / (1 - vote)) + b)))), self.docs[found].tolist(), cosines.tolist()))
        return out

    def judge(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float], str]]:
        """scores(), and the words of each text that go most with the label."""
        words = [_words(t) for t in texts]
        return [(*found, " ".join(self._best(own))) for found, own in zip(self._scores(words), words, strict=True)]


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y over x, with a weak pull to the identity, by Newton steps that are halved
    until the loss falls. A slope that is not positive would turn the order round: then the offset alone is fitted."""

    def loss(p):
        z = p[0] * x + p[1]
        return float((np.logaddexp(0, z) - y * z).sum() + ((p[0] - 1) ** 2 + p[1] ** 2) / 2)

    def descend(p, free):
        best = loss(p)
        for _ in range(100):
            q = 1 / (1 + np.exp(-np.clip(p[0] * x + p[1], -500, 500)))
            gradient = np.array([((q - y) * x).sum() + p[0] - 1, (q - y).sum() + p[1]])
            w = q * (1 - q)
            hessian = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
            step = np.zeros(2)
            step[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
            while (now := loss(p - step)) > best and np.abs(step).max() > 1e-9:
                step = step / 2
            if now > best - 1e-9 * (1 + abs(best)):
                break
            p, best = p - step, now
        return p

    p = descend(np.array([1.0, 0.0]), [0, 1])
    if p[0] <= 0:
        p = descend(np.array([1.0, 0.0]), [1])
    return float(p[0]), float(p[1])


def fit(docs: DataFrame, labels: DataFrame, label: str, settings: Settings = Settings()) -> str:
    """Where a pickled Index lies, in a folder of its own in the shared folder."""
    sample = labelled_sample(docs, labels, label, settings.rows, settings.chars).withColumn("one", F.lit(0))
    folder = common.fresh_path(docs.sparkSession, "toxicity")

    def write(index: Index) -> str:
        store.make_dir(folder)
        store.put(path := f"{folder}/{uuid.uuid4().hex}", pickle.dumps(index, 5))  # each attempt of a task has its own
        return path

    def run(table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("order", "label", "text", "doc_id")), strict=True), key=lambda r: (r[0], r[1], r[2] or ""))
        path = write(Index([(t, int(y > 0), d) for _, y, t, d in rows], settings))
        common.trim()
        return pa.table({"path": [path]})

    got = sample.groupBy("one").applyInArrow(run, "path string").collect()
    if got:
        return got[0][0]
    if store.exists(folder):
        raise RuntimeError(f"an index was written to {folder}, but its path did not come back")
    return write(Index([], settings))


_LOADED: dict[str, Index] = {}


def load(path: str) -> Index:
    """The index that fit() has written; a worker keeps the last one for its next tasks."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = pickle.loads(store.get(path))
    return _LOADED[path]


def score(docs: DataFrame, index: str) -> DataFrame:
    """doc_id, score, the neighbours' doc_ids and cosines, and the passage that goes most with the label. index: from fit()."""
    common.small_batches(docs.sparkSession)

    def run(parts):
        own = load(index)
        for part in parts:
            rows = own.judge(part.column(1).to_pylist())
            kinds = (pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.string())
            columns = [pa.array(x, kind) for x, kind in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "score", "evidence", "cosines", "passage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, evidence array<long>, cosines array<double>, passage string")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~common.held_out(0, 5))
    scored = score(docs, fit(docs, labels, "toxic"))
    return scored.select("doc_id", F.coalesce(common.held_out(0, 5), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
