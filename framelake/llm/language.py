"""Language identification by interpolated Kneser-Ney character models, one for each language.

Texts are lower-cased runs of letters; a model predicts each letter, and the end of a run, from the three before it. All
counts come from the whole training corpus: tasks count n-grams, Spark sums them and derives continuation counts (of how many
contexts an n-gram ends). The models keep sums by the n-grams' 64-bit hashes for each language and order, as sorted arrays, so
n-grams do not share counts, and the models grow with the distinct n-grams. The arrays are made in tasks, by ranges of the
hash, and come to the driver packed. The language with the lowest cross-entropy per letter wins. The score, and the cross-entropy beyond
which a prediction is marked as rejected (column accepted), are calibrated on a bounded, hash-drawn sample of training
documents, whose cross-entropies come from the counts of all others.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text if there is no training text; a
very long text is read whole; a null doc_id takes no part in calibration; repeated rows count each; ties go to the first
language in code-point order; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import common

_WORD = re.compile(r"[^\W\d_]+")
ORDER, DISCOUNT = 4, 0.75
#: Words and n-grams that a counting task or a scoring worker holds at most; what is held starts anew beyond it.
HELD_WORDS, HELD_GRAMS = 500_000, 1_000_000
#: Bounds of the calibration sample: documents, and characters of one of them; it is drawn from one in SAMPLE_FOLDS documents.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_FOLDS = 1500, 8192, 5
#: Ranges of the hash in which the arrays are made.
RANGES = 32


def words_of(text: str | None) -> list[str]:
    words = _WORD.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def _grams(word: str) -> list[str]:
    padded = " " * (ORDER - 1) + word + " "
    return [padded[k : k + ORDER] for k in range(len(word) + 1)]


def gram_counts(docs: DataFrame, held=None) -> DataFrame:
    """lang, gram, n and rest: how often each n-gram of the highest order is in the texts of each language, and in those without held."""
    common.small_batches(docs.sparkSession)

    def run(parts):
        counters: dict[tuple, Counter] = defaultdict(Counter)

        def flush():
            for (lang, out), counter in counters.items():
                grams: dict[str, int] = defaultdict(int)
                for word, n in counter.items():
                    for g in _grams(word):
                        grams[g] += n
                n = pa.array(list(grams.values()), pa.int64())
                rest = pa.array(np.zeros(len(grams), "i8")) if out else n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams)), n, rest], names=["lang", "gram", "n", "rest"])
            counters.clear()

        for part in parts:
            for lang, text, out in zip(*(c.to_pylist() for c in part.columns), strict=True):
                counters[lang, out].update(words_of(text))
            if sum(map(len, counters.values())) > HELD_WORDS:
                yield from flush()
        yield from flush()

    out = F.lit(False) if held is None else F.coalesce(held, F.lit(False))
    counted = docs.where(F.col("lang").isNotNull()).select("lang", "text", out.alias("out")).mapInArrow(run, "lang string, gram string, n long, rest long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest"))


def slot(gram: str) -> int:
    """The hash as a signed long, as Spark's xxhash64 gives it."""
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def statistics(grams: DataFrame) -> DataFrame:
    """lang, size, what, slot, value and kinds: by hash, `n` (value) of each n-gram of a size (continuations below the highest),
    and for each `context` of a size the sum of those (value) and how many n-grams it has (kinds)."""
    found = []
    level = grams.select("lang", "gram", "n")
    for size in range(ORDER, 0, -1):
        found.append(level.select("lang", F.lit(size).alias("size"), F.lit("n").alias("what"), "gram", F.col("n").alias("value"), F.lit(0).cast("long").alias("kinds")))
        context = level.withColumn("gram", F.substring("gram", 1, size - 1) if size > 1 else F.lit("")).groupBy("lang", "gram")
        totals = context.agg(F.sum("n").alias("value"), F.count("*").alias("kinds"))
        found.append(totals.select("lang", F.lit(size).alias("size"), F.lit("context").alias("what"), "gram", "value", "kinds"))
        level = level.withColumn("gram", F.substring("gram", 2, size - 1)).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    hashed = out.withColumn("slot", F.xxhash64("gram"))
    return hashed.groupBy("lang", "size", "what", "slot").agg(F.sum("value").alias("value"), F.sum("kinds").alias("kinds"))


def packed(stats: DataFrame) -> list:
    """Rows (lang, size, what, range, slots, values, kinds): sorted hashes of a range and their figures, as bytes."""

    def run(key, table):
        order = np.argsort(slots := table.column("slot").to_numpy())
        own = [slots[order].astype("<i8"), table.column("value").to_numpy()[order].astype("<i8"), table.column("kinds").to_numpy()[order].astype("<i8")]
        own[1:] = [x.astype("<u4") if not len(x) or x.max() < 1 << 32 else x for x in own[1:]]  # the width follows from the length
        lang, size, what, part = (k.as_py() for k in key)
        columns = [[lang], [size], [what], [part], *([x.tobytes()] for x in own[: 2 if what == "n" else 3]), *([[b""]] if what == "n" else [])]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["lang", "size", "what", "range", "slots", "value", "kinds"])

    ranged = stats.withColumn("range", (F.shiftright("slot", 59) + 16).cast("int"))  # ascending like the signed hashes
    return ranged.groupBy("lang", "size", "what", "range").applyInArrow(run, "lang string, size int, what string, range int, slots binary, value binary, kinds binary").collect()


class Models:
    """All languages' models: for each size and figure, sorted hashes and a value for each."""

    def __init__(self, rows: list):
        """rows: those of packed()."""
        self.langs = sorted({r[0] for r in rows})
        self.tables: dict[tuple[int, int, str], tuple[np.ndarray, np.ndarray]] = {}
        parts: dict[tuple, list] = defaultdict(list)
        for row in sorted(rows, key=lambda r: r[3]):
            parts[self.langs.index(row[0]), row[1], row[2]].append(row)

        def joined(own, k):
            return np.concatenate([np.frombuffer(r[k], "<u4" if 2 * len(r[k]) == len(r[4]) else "<i8") for r in own] or [np.empty(0, "u4")])

        for k in range(len(self.langs)):
            for s in range(1, ORDER + 1):
                own = parts[k, s, "n"]
                self.tables[k, s, "n"] = np.concatenate([np.frombuffer(r[4], "<i8") for r in own] or [np.empty(0, "i8")]), joined(own, 5)
                own = parts[k, s, "context"]
                slots = np.concatenate([np.frombuffer(r[4], "<i8") for r in own] or [np.empty(0, "i8")])
                self.tables[k, s, "all"], self.tables[k, s, "kinds"] = (slots, joined(own, 5)), (slots, joined(own, 6))
        self.letters = max([len(self.tables[k, 1, "n"][0]) for k in range(len(self.langs))], default=0) + 1
        self.sharpness, self.limit = 1.0, np.inf
        self.clear()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("gram_rows", "gram_logs", "word_rows", "word_logs")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.clear()

    def clear(self):
        self.gram_rows: dict[str, int] = {}
        self.gram_logs = np.empty((1024, len(self.langs)))
        self.word_rows: dict[str, int] = {}
        self.word_logs = np.empty((1024, len(self.langs)))

    def _get(self, lang: int, size: int, what: str, at: np.ndarray) -> np.ndarray:
        """Values at the hashes, 0 where there is none."""
        slots, values = self.tables[lang, size, what]
        if not len(slots):
            return np.zeros(len(at))
        k = np.minimum(np.searchsorted(slots, at), len(slots) - 1)
        return np.where(slots[k] == at, values[k], 0.0)

    def logs(self, grams: list[str]) -> np.ndarray:
        """Of each gram and language, the log probability of the gram's last letter after the others."""
        whole = [np.array([slot(g[-s:]) for g in grams], "i8") for s in range(1, ORDER + 1)]
        context = [np.array([slot(g[-s:-1]) for g in grams], "i8") for s in range(1, ORDER + 1)]
        out = np.empty((len(grams), len(self.langs)))
        for lang in range(len(self.langs)):
            p = np.full(len(grams), 1 / self.letters)
            for s in range(1, ORDER + 1):
                total = self._get(lang, s, "all", context[s - 1])
                n, kinds = self._get(lang, s, "n", whole[s - 1]), self._get(lang, s, "kinds", context[s - 1])
                p = np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.maximum(total, 1), p)
            out[:, lang] = np.log(np.minimum(p, 1.0))
        return out

    @staticmethod
    def _grown(rows: np.ndarray, n: int) -> np.ndarray:
        return rows if n <= len(rows) else np.concatenate([rows, np.empty((max(n, 2 * len(rows)) - len(rows), rows.shape[1]))])

    def _add(self, words: list[str]) -> None:
        own = [_grams(w) for w in words]
        if new := list({g for gs in own for g in gs}.difference(self.gram_rows)):
            base = len(self.gram_rows)
            self.gram_logs = self._grown(self.gram_logs, base + len(new))
            self.gram_logs[base : base + len(new)] = self.logs(new)
            self.gram_rows.update(zip(new, range(base, base + len(new)), strict=True))
        rows = np.fromiter((self.gram_rows[g] for gs in own for g in gs), "i8")
        starts = np.cumsum([0, *map(len, own)])[:-1]
        logs = np.add.reduceat(self.gram_logs[rows], starts)
        base = len(self.word_rows)
        self.word_logs = self._grown(self.word_logs, base + len(words))
        self.word_logs[base : base + len(words)] = logs
        self.word_rows.update(zip(words, range(base, base + len(words)), strict=True))

    def entropies(self, text: str | None) -> tuple[np.ndarray, int] | None:
        """Cross-entropy per letter in each language, and the letters; None without a letter or a language."""
        words = words_of(text)
        if not words or not self.langs:
            return None
        if len(self.gram_rows) > HELD_GRAMS:
            self.clear()
        if len(self.word_rows) > HELD_WORDS:
            self.word_rows.clear()
        if new := list({*words}.difference(self.word_rows)):
            self._add(new)
        known = self.word_rows
        letters = sum(map(len, words)) + len(words)
        return -self.word_logs[np.fromiter(map(known.__getitem__, words), "i8", len(words))].sum(0) / letters, letters

    def _shares(self, entropies: np.ndarray, letters: int, sharpness: float) -> np.ndarray:
        x = -entropies * sharpness * np.sqrt(letters)  # letters are not independent
        x = np.exp(x - x.max())
        return x / x.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool, float | None]:
        found = self.entropies(text)
        if found is None:
            return "und", 0.0, False, None
        best = int(found[0].argmin())
        return self.langs[best], float(self._shares(*found, self.sharpness)[best]), bool(found[0][best] <= self.limit), float(found[0][best])

    def calibrate(self, rows: list[tuple[str, str | None]]) -> None:
        """The sharpness of the highest likelihood, and the cross-entropy that one in 200 right documents exceeds."""
        found = [(self.langs.index(lang), *e) for lang, text in rows if lang in self.langs and (e := self.entropies(text))]
        if not found:
            return
        loss = lambda s: -sum(np.log(max(1e-12, self._shares(e, n, s)[k])) for k, e, n in found)
        self.sharpness = min((0.25 * 2**k for k in range(9)), key=loss)
        right = [e[k] for k, e, _ in found if e.argmin() == k]
        if right:
            self.limit = float(np.quantile(right, 0.995) * 1.05)


def fit(docs: DataFrame) -> Models:
    """Models from all documents (doc_id, text, lang) given."""
    drawn = F.xxhash64("doc_id")
    able = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SAMPLE_FOLDS)) == 0)
    hashes = docs.where(able).select(drawn.alias("hash")).distinct().orderBy("hash").limit(SAMPLE_DOCS).collect()
    held = able & (drawn <= hashes[-1][0]) if hashes else None
    grams = common.materialise(gram_counts(docs, held), "grams")
    models = Models(packed(statistics(grams)))
    if held is not None:
        rows = sorted((r.lang, r.text) for r in docs.where(held).dropDuplicates(["doc_id"]).select("lang", "text").collect())
        whole = {g for _, text in rows for w in {*words_of(text)} for g in _grams(w)}
        seen = sorted({slot(x) for g in whole for s in range(1, ORDER + 1) for x in (g[-s:], g[-s:-1])})
        seen = docs.sparkSession.createDataFrame([(x,) for x in seen], "slot long")  # bounded by the sample
        others = statistics(grams.where("rest > 0").select("lang", "gram", F.col("rest").alias("n")))
        others = others.where("size = 1").union(others.where("size > 1").join(F.broadcast(seen), "slot", "left_semi").select(*others.columns))
        own = Models(packed(others))
        own.calibrate(rows)
        models.sharpness, models.limit = own.sharpness, own.limit
    return models


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, accepted, entropy."""
    common.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(parts):
        own = held.value
        for part in parts:
            rows = [own.predict(t) for t in part.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = pa.string(), pa.float64(), pa.bool_(), pa.float64()
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "lang_pred", "score", "accepted", "entropy"])

    shape = "doc_id long, lang_pred string, score double, accepted boolean, entropy double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    models = fit(docs.where(~common.held_out(1, 3)))
    return predict(docs, models).select("doc_id", F.coalesce(common.held_out(1, 3), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
