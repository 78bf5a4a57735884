"""Line deduplication, in DataFrame operations only.

Each line's key is reduced to 128 bits. The hashes are range-partitioned (with a salt by document, so that the sampled
ranges also split a line that many documents hold) and sorted by document, last first, and position; a window streams
the first occurrence of each document, which counts documents and finds the largest one. Lines of frequent keys are
dropped in all other documents. The result is no text but, for each document that loses lines, a keep bitmap compressed to
the runs of its dropped lines; apply_bitmaps() cuts texts by it.

Defined cases: a null or empty text is one empty line; rows with the same doc_id and text (ties, repeated rows) get the same
bitmap, and count as one document with any others of that doc_id; a null doc_id is a document that is smaller than all others;
a very long text is read whole, its lines one by one; an empty table gives no rows; other columns, whatever their names, are
kept by dedup_lines().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm import common

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts that one key's documents are dealt to.
SALTS = 64


def _lines() -> F.Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text_key, n_dropped, runs (array of start and length of dropped lines, ascending) where lines are dropped."""
    exploded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.posexplode(_lines()).alias("pos", "line"))
    trimmed = exploded.select("doc_id", "text_key", "pos", F.btrim("line", F.lit(common.SPACES)).alias("line")).where(F.char_length("line") >= min_chars)
    key = F.translate("line", _UPPER, _LOWER)
    lines = trimmed.select("doc_id", "text_key", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    lines = common.materialise(lines, "lines").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))

    ranged = lines.repartitionByRange(common.partitions_for(lines), "h1", "h2", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").desc_nulls_last(), "text_key", "pos")
    first = (F.row_number().over(stream) == 1) | ~F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id"))
    firsts = ranged.select("h1", "h2", "salt", "doc_id", first.alias("first")).where("first")
    salted = firsts.groupBy("h1", "h2", "salt").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))  # in the same ranges
    whole = Window.partitionBy("h1", "h2")  # at most a row for each salt
    totals = salted.select("h1", "h2", "salt", F.sum("docs").over(whole).alias("docs"), F.max("last").over(whole).alias("keeper"))
    frequent = totals.where(F.col("docs") >= min_docs).drop("docs")

    dropped = lines.join(frequent, ["h1", "h2", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    own = ["doc_id", "text_key"]
    dropped = dropped.select(*own, "pos").distinct()
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*own).orderBy("pos"))
    runs = dropped.withColumn("island", island).groupBy(*own, "island").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("length"))
    return runs.groupBy(*own).agg(F.sum("length").cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("start", "length"))).alias("runs"))


def kept_text(lines: F.Column, runs: F.Column) -> F.Column:
    """The lines outside of the runs, joined again."""
    end = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(runs, k - 1)["start"] + F.get(runs, k - 1)["length"])
    until = lambda k: F.coalesce(F.get(runs, k)["start"], F.size(lines))
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda k: F.slice(lines, end(k) + 1, until(k) - end(k)))), "\n")


def added_names(docs: DataFrame) -> list[str]:
    """Names of the columns that apply_bitmaps() adds: _n_lines, _n_dropped and _kept, with more underscores where docs has them."""
    return [common.free_name(docs, n) for n in ("_n_lines", "_n_dropped", "_kept")]


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with _n_lines, _n_dropped and _kept (text without the dropped lines), under the names of added_names().

    Texts are dealt once, to as many parts as their size asks for, and meet the far smaller bitmaps without being sorted.
    """
    parts = common.partitions_for(docs)
    n_lines, n_dropped, kept = added_names(docs)
    runs, *own = (common.free_name(docs, n) for n in ("_runs", "_doc", "_no_doc", "_text_key"))
    ids = dict(zip(own, (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull()), strict=False))
    keyed = docs.withColumns(ids | {own[2]: F.xxhash64("text")}).repartition(parts, *own)
    right = bitmaps.withColumns(ids).select(*own[:2], F.col("text_key").alias(own[2]), F.col("n_dropped").alias(n_dropped), F.col("runs").alias(runs))
    joined = keyed.join(right.repartition(parts, *own).hint("shuffle_hash"), own, "left")
    whole = F.coalesce(F.col("text"), F.lit(""))
    return joined.withColumns({
        n_lines: (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        n_dropped: F.coalesce(n_dropped, F.lit(0)),
        kept: F.when(F.col(runs).isNull(), whole).otherwise(kept_text(_lines(), F.col(runs))),
    }).drop(*own, runs)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs without the lines that keep_bitmaps() drops; n_chars, if there, follows the text. Null texts stay null."""
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    _, n_dropped, kept = added_names(docs)
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col(kept)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs)).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(f.keeper <> k.doc_id, false) AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
