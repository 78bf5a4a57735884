"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank (rank - 0.5) / rows of the source
orders all rows, and the order is cut into shards of equal row counts, so each shard has every source in its share.

Ranks need no source in one task: the hash is cut into equal ranges, rows are counted by (source, range), the counts'
running sums give each range its first rank, and rows are numbered within a range alone. The order of the fractional ranks
is numbered likewise. Only ids, sizes and checksums are shuffled, never texts.

Defined cases: a null source is a stratum of its own, apart from an empty one; a null text has size 8 and the checksum of
no bytes; rows that are equal in everything may swap places; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm import common

#: Rows that share a range of the hash, about; ranges at least.
ROWS_EACH, RANGES = 20_000, 256


def _numbered(rows: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """rows with name: the number from 1 in (group without its last column) by the last column's ranges, then order."""
    outer, part = group[:-1], group[-1]
    counts = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*outer).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(*outer)).alias("_all"))
    inner = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return inner.join(bases, group).withColumn(name, F.col("_base") + F.col("_k")).drop("_base", "_k")


def interleave(docs: DataFrame, shards: int = 24, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        key.alias("key"),
    )
    rows = common.materialise(rows, "shard")
    total = rows.count()
    if not total:
        total = 1
    ranges = max(RANGES, -(-total // ROWS_EACH))
    rows = rows.withColumn("range", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)).cast("long"))
    ties = ["key", "doc_id", "size", "text_crc32"]
    ranked = _numbered(rows, ["stratum", "range"], ties, "rank")
    ranked = ranked.withColumn("fraction", (F.col("rank") - 0.5) / F.col("_all")).drop("_all", "rank", "range")
    ranked = common.materialise(ranked.withColumns({"_one": F.lit(0), "range": F.least((F.col("fraction") * ranges).cast("long"), F.lit(ranges - 1))}), "shard")
    placed = _numbered(ranked, ["_one", "range"], ["fraction", "stratum", *ties], "place").withColumn("place", F.col("place") - 1)
    shard = F.floor(F.col("place") * shards / F.lit(float(total)))
    # floating point may miss a cut by one place: the integers decide
    shard = F.when(F.col("place") * shards < shard * total, shard - 1).when(F.col("place") * shards >= (shard + 1) * total, shard + 1).otherwise(shard)
    return placed.withColumn("shard", shard.cast("long")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("place") - F.ceil((F.col("shard") * total).cast("decimal(38,0)") / F.lit(shards)).cast("long")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(common.documents(spark, sf_dir))


#: The checksum is computed by the byte, with a table made from its polynomial, as DuckDB has no crc32.
OP10_SQL = r"""
WITH RECURSIVE poly AS (
  SELECT n::BIGINT AS n, n::BIGINT AS v, 0 AS k FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM poly WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS tab FROM poly WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum FROM documents),
digits AS (SELECT doc_id, text, stratum, list_transform(string_split(hex(encode(text)), ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS h FROM d),
bytes AS (SELECT doc_id, stratum, octet_length(encode(text)) + 8 AS size, CASE WHEN text = '' THEN [] ELSE list_transform(range(len(h) // 2), lambda i: h[2 * i + 1] * 16 + h[2 * i + 2]) END AS b FROM digits),
summed AS (SELECT doc_id, stratum, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM bytes, crc),
keyed AS (SELECT *, md5('42:' || doc_id) AS key FROM summed),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS fraction FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, key, doc_id) - 1 AS place, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, place * 24 // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, place - (shard * total + 23) // 24 AS slot, CAST(NULL AS INT) AS grown_shard FROM cut
"""
