"""Quality rules by weak supervision.

Rules look at statistics of a whole text and vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the counts
of all vote patterns (a bounded table, however many documents there are) estimates what each rule votes on good and on bad
documents; the posterior probability of good replaces a filter that all rules must pass.

Defined cases: a null or empty text has no words and fails the base rule; a very long text is read whole; a null doc_id is
kept as it is; repeated rows are counted and scored each; texts with equal votes (ties) have equal posteriors, and one of
exactly 0.5 is kept; an empty table gives no rows; other columns, whatever their names, are passed on.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import common

_SYMBOLS, _BEYOND = "#*$%&|<>", bytes(range(128, 256))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], "i8")
    base = len(seen)
    if base == len(words):
        return 0
    _, pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
    _, inverse, counts = np.unique(pairs[:-1] * base + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] >= 2
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[k : k + len(twice)] |= twice
    return int(marked.sum())


def _is_plain(word: bytes) -> bool:
    """Letters alone (all beyond ASCII count as letters), with stops or quotes after them."""
    rest = word.translate(None, _BEYOND).rstrip(b".,;:!?\"')")
    return rest.isalpha() or not rest and word[0] > 127


def statistics(text: str | None) -> tuple[dict[str, int], dict[str, float]]:
    """The base counts, and what else the rules look at."""
    text = text or ""
    words = text.encode().split()  # bytes split at space and U+0009 to U+000D only
    lines = [x for x in text.split("\n") if x.strip(common.SPACES)]
    base = {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, common.SPACES)),
        "n_symbols": sum(map(text.count, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": _repeat_words(words),
    }
    n, plain = max(1, len(words)), sum(map(_is_plain, words))
    ends = Counter(x.rstrip(common.SPACES)[-1] in ".!?\"')" for x in lines)
    more = {
        "symbols": base["n_symbols"] / n,
        "length": base["word_chars"] / n,
        "dup_lines": base["n_dup_lines"] / max(1, len(lines)),
        "repeats": base["n_repeat_words"] / n,
        "upper": sum(map(str.isupper, text.split())) / n,
        "shouts": text.count("!") / n,
        "pipes": text.count("|") / n,
        "plain": plain / n,
        "ended": ends[True] / max(1, len(lines)),
        "digits": sum(map(text.count, "0123456789")) / max(1, base["word_chars"]),
        "distinct": len(set(words)) / n,
    }
    return base, more


def _bands(name: str, bad_low=-np.inf, good_low=-np.inf, good_high=np.inf, bad_high=np.inf):
    """Bad outside of the bad limits, good within the good limits, else no vote."""
    return lambda base, more: -1 if not bad_low <= more[name] <= bad_high else int(good_low <= more[name] <= good_high)


#: name: vote of (base counts, further figures). Limits are those of common web-corpus filters.
RULES = {
    "symbol_ratio": _bands("symbols", good_high=0.02, bad_high=0.1),
    "word_length": _bands("length", 2.5, 3.5, 9, 12),
    "duplicate_lines": _bands("dup_lines", good_high=0.0, bad_high=0.3),
    "repeated_words": _bands("repeats", good_high=0.15, bad_high=0.3),
    "upper_words": _bands("upper", good_high=0.1, bad_high=0.3),
    "exclamations": _bands("shouts", good_high=0.02, bad_high=0.15),
    "table_marks": _bands("pipes", good_high=0.0, bad_high=0.1),
    "plain_words": _bands("plain", 0.7, 0.9),
    "sentence_ends": _bands("ended", 0.2, 0.6),
    "digits": _bands("digits", good_high=0.05, bad_high=0.2),
    "distinct_words": _bands("distinct", 0.15, 0.3),
}


def _judge(text: str | None) -> tuple:
    """The base counts, base_failed and pattern of a text."""
    base, more = statistics(text)
    failed = base["n_words"] < 50 or 100 * base["n_repeat_words"] > 50 * base["n_words"]
    return *(base[n] for n in STATS), failed, "".join(str(rule(base, more) + 1) for rule in RULES.values())


def added_names(docs: DataFrame) -> list[str]:
    """Names of the columns that vote() adds: those of STATS, base_failed and pattern after an underscore, more where docs has them."""
    return [common.free_name(docs, f"_{n}") for n in (*STATS, "base_failed", "pattern")]


def vote(docs: DataFrame) -> DataFrame:
    """docs with the base counts, base_failed and pattern (a digit for each rule, 0 bad, 1 none, 2 good), named by added_names()."""
    common.small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    kinds = [pa.int64()] * len(STATS) + [pa.bool_(), pa.string()]
    added = dict(zip(added_names(docs), ["long"] * len(STATS) + ["boolean", "string"], strict=True))
    schema = docs.withColumns({n: F.lit(None).cast(t) for n, t in added.items()}).schema

    def run(parts):
        for part in parts:
            rows = [_judge(text) for text in part.column(at).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(added)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*part.schema.names, *added])

    return docs.mapInArrow(run, schema)


def fit(patterns: dict[str, int], rounds: int = 200, tolerance: float = 1e-7) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, from all patterns' counts.

    A two-class model whose rules vote independently given the class. Weak priors say that bad documents are the fewer and
    that votes are right rather than wrong, which fixes which class is which.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    votes = np.array([[int(c) for c in k] for k in keys])  # patterns x rules
    counts = np.array([patterns[k] for k in keys], float)
    hot = (votes[:, :, None] == np.arange(3)).astype(float)
    bad_votes, good_votes = (votes == 0).sum(1), (votes == 2).sum(1)
    good = np.clip(0.5 + 0.4 * np.sign(good_votes - 4 * bad_votes), 0.05, 0.95)  # one bad vote outweighs four good ones at first
    strength = max(1.0, 0.001 * counts.sum())
    prior = strength * np.array([[[0.02, 0.2, 0.78]], [[0.4, 0.3, 0.3]]])  # good, bad: shares of bad, none, good votes
    last = -np.inf
    for _ in range(rounds):
        weight = np.stack([good, 1 - good]) * counts
        table = np.einsum("cp,prv->crv", weight, hot) + prior
        table /= table.sum(2, keepdims=True)
        share = (weight.sum(1) + strength * np.array([0.8, 0.2])) / (counts.sum() + strength)
        log = np.log(share)[:, None] + np.einsum("prv,crv->cp", hot, np.log(table))
        total = np.logaddexp(*log)
        good = np.exp(log[0] - total)
        now = float((counts * total).sum())
        if abs(now - last) <= tolerance * abs(now):
            break
        last = now
    return dict(zip(keys, good.tolist(), strict=True))


def decide(voted: DataFrame) -> DataFrame:
    """voted, a written table of vote(), with _posterior and _kept."""
    patterns = {r[0]: r[1] for r in voted.where(~F.col("_base_failed")).groupBy("_pattern").count().collect()}  # at most 3 ^ rules rows
    posterior = voted.sparkSession.createDataFrame(sorted(fit(patterns).items()), "_pattern string, _posterior double")
    joined = voted.join(F.broadcast(posterior), "_pattern", "left")  # bounded like the patterns
    return joined.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(F.col("_posterior") >= 0.5, F.lit(False)))


def keep_good(docs: DataFrame) -> DataFrame:
    """docs that are kept, as they are. Texts are judged twice, once for the counts of patterns, rather than written between."""
    common.small_batches(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema

    def count(parts):
        counts = Counter(pattern for part in parts for *_, failed, pattern in map(_judge, part.column(0).to_pylist()) if not failed)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    counted = docs.select("text").mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    patterns = {r[0]: r[1] for r in counted.collect()}  # at most 3 ^ rules rows
    good = docs.sparkSession.sparkContext.broadcast({k for k, p in fit(patterns).items() if p >= 0.5})  # bounded like the patterns

    def run(parts):
        kept = good.value
        for part in parts:
            judged = (_judge(t)[-2:] for t in part.column(at).to_pylist())
            yield part.filter(pa.array([not failed and pattern in kept for failed, pattern in judged], pa.bool_()))
        common.trim()

    return docs.mapInArrow(run, schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    voted = common.materialise(vote(docs).drop("text"), "votes")  # texts are not written again
    return decide(voted).select("doc_id", *(F.col(f"_{n}").alias(n) for n in STATS), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_posterior").alias("posterior"))
