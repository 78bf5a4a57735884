import hashlib
import zlib
from collections import Counter, defaultdict

from framelake.llm import common, line_dedup, sharding
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def brute_lines(rows, min_chars=20, min_docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(SPACES).translate(low)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    small = lambda d: (d is not None, d or 0)
    keeper = {k: max(v, key=small) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(docs):
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return sorted((tuple(r) for r in out.select("doc_id", "_n_lines", "_n_dropped", F.sha2("_kept", 256)).collect()), key=str)


def test_lines_against_brute_force(spark, odd_docs):
    line = "A line that many documents hold"
    extra = [(100 + k, f"{line}\nown {k} words that are nowhere else\n  {line.upper()}\t\nshort\n{line}x{k % 5}", "en", "a", 1, 2) for k in range(40)]
    docs = odd_docs.union(spark.createDataFrame(extra, odd_docs.schema)).union(odd_docs)
    assert result(docs) == brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    table = common.documents(spark, SF)
    assert result(table.select("doc_id", "text")) == brute_lines([(r.doc_id, r.text) for r in table.collect()])


def test_lines_of_nothing_and_other_columns(spark, no_docs, odd_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0
    clash = odd_docs.withColumns({"pos": F.lit(1), "line": F.lit("x"), "h1": F.lit(2), "runs": F.lit(3), "salt": F.lit(4)})
    out = line_dedup.dedup_lines(clash)
    assert out.columns == clash.columns and out.count() == clash.count()
    assert out.where("doc_id = 2").head().text is None


def test_lines_keep_clashing_names(spark, odd_docs):
    names = {"_doc": F.lit(1), "_no_doc": F.lit(2), "_text_key": F.lit(3), "_kept": F.lit("k"), "_n_lines": F.lit(4), "_n_dropped": F.lit(5), "_runs": F.lit(6), "island": F.lit(7)}
    clash = odd_docs.union(odd_docs.withColumn("doc_id", F.col("doc_id") + 50)).union(odd_docs.withColumn("doc_id", F.col("doc_id") + 90)).withColumns(names)
    out = line_dedup.dedup_lines(clash)
    assert out.columns == clash.columns and out.select(*names).distinct().count() == 1
    assert {tuple(r) for r in out.select("doc_id", "text").collect()} == {tuple(r) for r in line_dedup.dedup_lines(clash.drop(*names)).select("doc_id", "text").collect()}


def brute_shards(rows, shards=24, seed=42):
    strata = defaultdict(list)
    for doc, text, source in rows:
        data = (text or "").encode()
        key = hashlib.md5(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
        strata["" if source is None else "=" + source].append((key, (doc is not None, doc or 0), len(data) + 8, zlib.crc32(data)))
    line = []
    for name, own in strata.items():
        for k, row in enumerate(sorted(own), 1):
            line.append(((k - 0.5) / len(own), name, *row))
    out = []
    for place, (_, _, _, doc, size, crc) in enumerate(sorted(line)):
        shard = place * shards // len(line)
        out.append((doc[1] if doc[0] else None, size, crc, "rows", shard, place - -(-shard * len(line) // shards), None))
    return sorted(out, key=str)


def test_shards_against_brute_force(spark, odd_docs):
    for docs in (odd_docs, common.documents(spark, SF)):
        got = sorted((tuple(r) for r in sharding.interleave(docs).collect()), key=str)
        assert got == brute_shards([(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_shards_follow_the_mixture(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = sharding.interleave(docs).join(docs, "doc_id").groupBy("shard").agg(F.count("*").alias("n"), F.sum((F.col("source") == "hot").cast("int")).alias("hot")).collect()
    assert len(got) == 24 and {r.n for r in got} == {250}
    assert all(abs(r.hot - 250 / 3) <= 2 for r in got)


def test_shards_of_nothing_and_slots(spark, no_docs, odd_docs):
    assert sharding.interleave(no_docs).count() == 0
    slots = defaultdict(list)
    for r in sharding.interleave(odd_docs, shards=3).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(Counter({k: len(v) for k, v in slots.items()}).values()) - min(len(v) for v in slots.values()) <= 1
