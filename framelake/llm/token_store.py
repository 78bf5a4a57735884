"""Token-id output: documents compressed one by one with a shared zstandard dictionary.

A store is a folder with
  dictionary   the zstandard dictionary, trained on serialised ids (empty if there was too little to train on)
  shard-*.tok  MAGIC, sha256 of the dictionary, bytes of an id (u8: 2 or 4), one zstandard frame a document, an index, the
               index's length (u64), MAGIC
  manifest     a Parquet table with a row for each shard that counts: its first and last doc_id and its sums; shards of lost
               task attempts have none
The index holds for each document doc_id (i64), null flag (u8), frame offset (u64), frame length (u32) and tokens (u32).
Shards and their documents ascend by doc_id, so fetch() finds any document by the manifest, a binary search in one shard's
index and a single frame. Ids take 16 bits where the vocabulary allows it, else 32.

Defined cases: a null or empty text has only the end id; a null doc_id sorts first; equal doc_ids (ties, repeated rows) are
stored each and ascend by the hash of their text; a very long text is encoded whole, in parts between two words; an empty table
gives a store without shards; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm import common, store
from framelake.llm.tokens import BATCH_CHARS, Encoder, batches

MAGIC = b"FLTOK002"
HEAD = len(MAGIC) + 33
MANIFEST = "part long, path string, first long, last long, docs long, tokens long, bytes long"
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("tokens", "<u4")])
#: Bounds of the dictionary and of the sample that it is trained on: whole short documents, drawn by hash.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 64 << 10, 1024, 8192


def _narrow(ids: bytes, wide: bool) -> bytes:
    return ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _widen(data: bytes, wide: bool) -> bytes:
    return data if wide else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, path: str, end_id: int, wide: bool) -> bytes:
    """A dictionary from at most SAMPLE_DOCS documents of at most SAMPLE_CHARS characters; it affects size, never content."""
    drawn = F.xxhash64("doc_id")
    hashes = docs.select(drawn.alias("hash")).orderBy("hash").limit(SAMPLE_DOCS).collect()  # no text is read for the draw
    most = hashes[-1][0] if hashes else 0
    short = docs.where((drawn <= most) & F.length("text").between(1, SAMPLE_CHARS)).select("text").limit(SAMPLE_DOCS)
    rows = sorted(short.collect())
    end = np.array([end_id], "<u4").tobytes()
    samples = [_narrow(x + end, wide) for x in Encoder.of(path).encode([r[0] for r in rows])]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 4), samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes, level: int):
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write(docs: DataFrame, folder: str, path: str, end_id: int, wide: bool | None = None, level: int = 3) -> None:
    """Write documents (doc_id, text) as a store in ascending doc_id order. wide: ids of 32 bits, by default where they need them."""
    common.small_batches(docs.sparkSession)
    needed = max(Encoder.of(path).size - 1, end_id) > 0xFFFF
    if needed and wide is False:
        raise ValueError("the vocabulary has ids beyond 16 bits")
    wide = needed if wide is None else wide
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    store.make_dir(folder)
    dictionary = train_dictionary(docs, path, end_id, wide)
    store.put(f"{folder}/dictionary", dictionary)
    digest = hashlib.sha256(dictionary).digest()
    end = np.array([end_id], "<u4").tobytes()

    def shard(parts):
        where, index, tokens, at = f"{folder}/shard-{uuid.uuid4().hex}.tok", [], 0, HEAD
        data, compress, encoder = store.get(f"{folder}/dictionary"), None, Encoder.of(path)
        out = None
        for part in parts:
            for rows in batches(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True), lambda r: r[1], BATCH_CHARS, 10_000):
                if out is None:
                    out, compress = store.writer(where), _compressor(data, level)
                    out.write(MAGIC + digest + bytes([4 if wide else 2]))
                for (doc, _), ids in zip(rows, encoder.encode([r[1] for r in rows]), strict=True):
                    frame = compress.compress(_narrow(ids + end, wide))
                    out.write(frame)
                    index.append((doc or 0, doc is None, at, len(frame), len(ids) // 4 + 1))
                    tokens += index[-1][-1]
                    at += len(frame)
        common.trim()
        if out is not None:
            table = np.array(index, INDEX).tobytes()
            out.write(table + len(table).to_bytes(8, "little") + MAGIC)
            out.close()
            ids = [row[0] for row in index if not row[1]]
            values = TaskContext.get().partitionId(), where, ids[0] if ids else None, ids[-1] if ids else None, len(index), tokens, at + len(table) + 16
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, shape, strict=True)], schema=shape)

    shape = pa.schema([(n, pa.string() if n == "path" else pa.int64()) for n in ("part", "path", "first", "last", "docs", "tokens", "bytes")])
    ordered = docs.repartitionByRange(common.partitions_for(docs), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(shard, MANIFEST).write.parquet(f"{folder}/manifest")


def _open(file, digest: bytes) -> tuple[bool, int, int]:
    """Whether ids are wide, the index's place and its entries."""
    size = file.size()
    file.seek(0)
    if file.read(len(MAGIC)) != MAGIC or file.read(32) != digest:
        raise ValueError("not a shard of this dictionary")
    wide = file.read(1)[0] == 4
    file.seek(size - len(MAGIC) - 8)
    length = int.from_bytes(file.read(8), "little")
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("a shard without its end")
    return wide, size - len(MAGIC) - 8 - length, length // INDEX.itemsize


def _entries(file, place: int, start: int, count: int) -> np.ndarray:
    file.seek(place + start * INDEX.itemsize)
    return np.frombuffer(file.read(count * INDEX.itemsize), INDEX)


def _ids(file, entry, expand, wide: bool) -> np.ndarray:
    file.seek(int(entry["offset"]))
    return np.frombuffer(_widen(expand.decompress(file.read(int(entry["size"])), max_output_size=int(entry["tokens"]) * 4), wide), "<u4")


def read_document(folder: str, shard_path: str, k: int) -> np.ndarray:
    """Ids of the k-th document of a shard, by its index entry alone."""
    dictionary = store.get(f"{folder}/dictionary")
    with store.reader(shard_path) as file:
        wide, place, _ = _open(file, hashlib.sha256(dictionary).digest())
        return _ids(file, _entries(file, place, k, 1)[0], _decompressor(dictionary), wide)


def fetch(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """Ids of each document with the doc_id: the manifest names the shards, a binary search in their indexes the frames."""
    dictionary = store.get(f"{folder}/dictionary")
    digest, expand, out = hashlib.sha256(dictionary).digest(), _decompressor(dictionary), []
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    for row in manifest.where((F.col("first") <= doc_id) & (F.col("last") >= doc_id)).orderBy("part").select("path").toLocalIterator():
        with store.reader(row.path) as file:
            wide, place, size = _open(file, digest)
            low, high = 0, size  # the first entry that is not before the id; null ids come first
            while low < high:
                mid = (low + high) // 2
                entry = _entries(file, place, mid, 1)[0]
                if entry["is_null"] or entry["doc_id"] < doc_id:
                    low = mid + 1
                else:
                    high = mid
            while low < size and (entry := _entries(file, place, low, 1)[0])["doc_id"] == doc_id:
                out.append(_ids(file, entry, expand, wide))
                low += 1
    return out


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_bytes (and ids) of every document of a store, from its files."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_bytes", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def documents(parts):
        dictionary = store.get(f"{folder}/dictionary")
        digest = hashlib.sha256(dictionary).digest()
        for part in parts:
            for where, base in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                expand = _decompressor(dictionary)
                with store.reader(where) as file:
                    wide, place, size = _open(file, digest)
                    index = _entries(file, place, 0, size)
                    starts = base + np.concatenate(([0], np.cumsum(index["tokens"].astype("i8"))))[:-1]
                    for lo in range(0, len(index), 1000):
                        rows, crcs, all_ids = index[lo : lo + 1000], [], []
                        file.seek(int(rows["offset"][0]))
                        for row in rows:
                            ids = _widen(expand.decompress(file.read(int(row["size"])), max_output_size=int(row["tokens"]) * 4), wide)
                            if len(ids) != 4 * row["tokens"]:
                                raise ValueError("a frame has another length than the index says")
                            crcs.append(zlib.crc32(ids))
                            if with_ids:
                                all_ids.append(ids)
                        columns = [pa.array(rows["doc_id"], mask=rows["is_null"].astype(bool)), pa.array(starts[lo : lo + 1000]), pa.array(rows["tokens"].astype("i8")), pa.array(crcs, pa.int64()), pa.array(rows["size"].astype("i8"))]
                        yield pa.RecordBatch.from_arrays([*columns, *([pa.array(all_ids, pa.binary())] if with_ids else [])], schema=schema)

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long, n_bytes long" + ", ids binary" * with_ids
    return shards.repartition(max(1, manifest.count())).mapInArrow(documents, shape)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.fresh_path(spark, "tokens")
    write(common.documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read(spark, folder)
