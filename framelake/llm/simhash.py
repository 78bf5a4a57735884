"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints within the radius share a variant within half the radius of each. Variants are shuffled by their top bits,
but as the fingerprint that they come from: a fingerprint goes to each cell (value of the top bits) within half the radius of
its own, and the cell's task expands the variants that lie in it. Each variant is thus made once, in one task, and the shuffle
carries tens of copies of a fingerprint instead of thousands of variants. The number of top bits follows from the number of
distinct fingerprints; cells that still hold too many are cut by further bits, again and again, so a task's share is bounded
however the fingerprints lie. In a cell, equal variants are sorted together, each is linked to the smallest fingerprint that
has it, the links' distances are verified, and a union-find keeps a spanning forest, so a group of any size yields fewer links
than it has members. Groups across cells are joined by an iterated label exchange on tables in the shared folder.

keep_one also links texts whose shingle sets have a Jaccard similarity of 0.8 or more, which lie far more than 4 bits apart: sets
that share a band of MinHash values are candidates, and their whole sets are compared. Each bucket of equal bands compares its
sets with its first one; where that leaves several groups in a bucket, all sets of different groups are compared, in blocks.

Only distinct fingerprints and distinct sets take part; documents with equal ones are joined by the smallest doc_id. Rows of a
frequent key are dealt to parts by a salt in every join that could meet one.

Defined cases: a text without words (null or empty too) has fingerprint zero; a very long text is read whole; a null doc_id is
ignored as a smallest id, and its group's id is null only if all its ids are null; repeated rows and ties share their
component, and keep_one keeps one of them; an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import common

#: Fingerprints of a cell that are not cut further, and variants that a cell's task holds at once, about.
HELD_FPS, HELD_VARIANTS = 50_000, 2_000_000
#: Bits by which a cell that holds too many is cut.
MORE_BITS = 6
#: Parts that one fingerprint's documents are dealt to.
SALTS = 64
#: Links that a task reads before it makes stars of them.
HELD_LINKS = 1_000_000
#: MinHash bands and values in each: sets of similarity 0.8 share a band with probability 1 - (1 - 0.8^4)^20 = 0.99997.
BANDS, BAND_ROWS = 20, 4
#: Sets of one of the two blocks that a task compares.
BLOCK_SETS = 256
#: Bytes of row keys that are broadcast at most; more are shuffled.
KEY_BYTES = 8 << 20
KEY = ["row_doc", "row_none", "row_key"]
_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1).astype("i4")


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> bytes:
    """The XXH64 of each run of shingle words (of all words if there are fewer), big-endian."""
    words = (text or "").encode().translate(_UPPER).split()  # bytes split at space and U+0009 to U+000D only
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed) if words else b""
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64 bits, each set if over half the shingles' XXH64 have it."""
    return print_of(shingle_hashes(text, shingle, seed))


def print_of(data: bytes) -> int:
    n = len(data) // 8
    columns = np.frombuffer(data, "u1").reshape(n, 8)  # big-endian
    if n < 64:
        votes = np.unpackbits(columns, axis=1).sum(0)
    else:
        votes = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(np.frombuffer(shingle_hashes(text, shingle), ">u8").astype("u8"))


def bands(hashes: np.ndarray) -> list[int]:
    """A hash of each band of MinHash values."""
    factors = np.random.default_rng(7).integers(0, 2**63, BANDS * BAND_ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)
    least = np.full(len(factors), ~np.uint64(0))
    for a in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[a : a + 4096, None] * factors).min(0))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, BAND_ROWS))]


def set_links(sets: list[np.ndarray], similarity: float, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of sets of at least the similarity that connect all such pairs. group: sets of equal values are connected already."""
    sizes = np.array([len(x) for x in sets])
    group = np.arange(len(sets)) if group is None else group.copy()
    out = []
    for k, own in enumerate(sets):
        if (group == group[0]).all():
            break
        small, large = np.minimum(sizes, len(own)), np.maximum(sizes, len(own))
        rest = np.flatnonzero((group != group[k]) & (np.arange(len(sets)) > k) & (small >= similarity * large - 1e-9))
        if not len(rest):
            continue
        every = np.concatenate([sets[j] for j in rest])
        both = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
        shared = np.add.reduceat(both.astype("i8"), np.concatenate(([0], np.cumsum(sizes[rest])[:-1])))
        near = rest[shared >= similarity * (sizes[rest] + len(own) - shared) - 1e-9]
        out += [(k, j) for j in near.tolist()]
        group[np.isin(group, group[near])] = group[k]
    return out


def spread(rows: DataFrame, key: str, by: str, lookup: DataFrame) -> DataFrame:
    """rows (a written table) joined with lookup, which has one row for each key; a frequent key's rows are dealt to parts."""
    salt = common.free_name(rows, "_salt", lookup)
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)))
    return salted.join(salted.select(key, salt).distinct().join(lookup, key), [key, salt]).drop(salt)


def match(rows: DataFrame, names: list[str], keys: DataFrame, how: str) -> DataFrame:
    """rows that have (left_semi) or lack (left_anti) their names' values in keys (KEY, distinct): these are broadcast if they
    are counted as few, else rows are dealt once, to as many parts as their size asks for."""
    right = keys.select(*(F.col(k).alias(n) for k, n in zip(KEY, names, strict=True)))
    if 40 * keys.count() <= KEY_BYTES:
        return rows.join(F.broadcast(right), names, how)
    parts = common.partitions_for(rows)
    return rows.repartition(parts, *names).join(right.repartition(parts, *names).hint("shuffle_hash"), names, how)


def similar_roots(texts: DataFrame, signed: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """fp and root of roots, after the groups of all sets of at least the similarity are joined.

    texts: KEY and text; signed: KEY, fp, same (a digest of the set, null without words) and bands.
    """

    def read(parts):
        for part in parts:
            sets = [shingle_set(t, shingle).tobytes() for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["same", "hashes"])

    def compare(parts):
        for part in parts:
            near = [bool(set_links([np.frombuffer(x, "u8"), np.frombuffer(y, "u8")], similarity)) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
        common.trim()

    def block(table):
        own, groups = [np.frombuffer(x, "u8") for x in table.column("hashes").to_pylist()], table.column("root").to_numpy()
        got = set_links(own, similarity, groups)
        return pa.table({"a": pa.array([groups[x] for x, _ in got], pa.int64()), "b": pa.array([groups[y] for _, y in got], pa.int64())})

    # equal sets are compared once, by their first row
    firsts = signed.where("same IS NOT NULL").groupBy("same").agg(F.min(F.struct(*KEY, "fp")).alias("first"), F.any_value("bands").alias("bands"))
    firsts = common.materialise(firsts.select("same", "first.*", "bands"), "firsts")
    keyed = common.materialise(spread(firsts.select("same", "fp", "bands"), "fp", "same", roots).select("same", "root", F.explode("bands").alias("band")), "keyed")

    def sets_of(wanted: DataFrame) -> DataFrame:
        keys = common.materialise(firsts.join(wanted, "same", "left_semi").select(*KEY), "wanted")
        return common.materialise(match(texts, KEY, keys, "left_semi").select("text").mapInArrow(read, "same binary, hashes binary"), "sets")

    def moves(links: DataFrame) -> DataFrame:
        """root and top: where the links of roots take those that they name."""
        return components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))

    # each set against the first one of its buckets
    of_bucket = keyed.groupBy("band").agg(F.min(F.struct("same", "root")).alias("first"), F.min("root").alias("low"), F.max("root").alias("high"))
    leads = of_bucket.where("low < high").select("band", F.col("first.same").alias("lead"), F.col("first.root").alias("b"))
    near = common.materialise(spread(keyed, "band", "same", leads), "near")  # buckets of one group have no part in the rest
    pairs = near.where("root <> b").select("same", F.col("root").alias("a"), "lead", "b").distinct()
    pairs = common.materialise(pairs.withColumn("_salt", F.pmod(F.xxhash64("same"), F.lit(SALTS))), "pairs")
    if pairs.isEmpty():
        return roots
    sets = sets_of(pairs.select("same").union(pairs.select("lead")).distinct())
    leaders = pairs.select("lead", "_salt").distinct().join(sets.select(F.col("same").alias("lead"), F.col("hashes").alias("other")), "lead")
    whole = pairs.join(sets, "same").join(leaders, ["lead", "_salt"]).select("a", "b", "hashes", "other")
    moved = common.materialise(moves(whole.mapInArrow(compare, "a long, b long")), "moved")

    # buckets of three sets and more that still have several groups: each set of all but the largest group against all others
    tops = near.select("root").distinct().join(moved, "root", "left").select("root", F.coalesce("top", "root").alias("top"))
    now = common.materialise(spread(near.select("band", "same", "root"), "root", "same", tops).select("band", "same", F.col("top").alias("root")), "keyed")
    member = F.xxhash64("same").cast("decimal(38,0)")
    mixed = now.groupBy("band").agg(F.count("*").alias("n"), F.sum(member).alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high AND n > 2")
    mixed = mixed.groupBy("n", "members").agg(F.min("band").alias("band")).select("band")  # of bands that hold the same sets, one
    mixed = common.materialise(mixed, "mixed")
    over = roots.select("root").distinct().join(moved, "root", "left").select("root", F.coalesce("top", "root").alias("top"))
    if mixed.isEmpty():
        return spread(roots, "root", "fp", over).select("fp", F.col("top").alias("root"))
    inside = common.materialise(spread(now, "band", "same", mixed), "inside")
    sizes = inside.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK_SETS)).cast("int")
    sizes = sizes.select("band", F.col("top.root").alias("top"), blocks(F.col("top.n")).alias("tops"), blocks(F.col("n") - F.col("top.n")).alias("others"))
    deal = lambda n: F.pmod(F.xxhash64("same"), F.col(n)).cast("int")
    every = lambda n, make: F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    place = lambda x, y, top: F.struct(x.alias("x"), y.alias("y"), F.lit(top).alias("top_block"))
    of_other = F.concat(every("others", lambda k: place(F.least(deal("others"), k), F.greatest(deal("others"), k), False)), every("tops", lambda k: place(deal("others"), k, True)))
    places = F.when(F.col("root") == F.col("top"), every("others", lambda k: place(k, deal("tops"), True))).otherwise(of_other)
    placed = common.materialise(spread(inside, "band", "same", sizes).select("band", "same", "root", F.explode(places).alias("at")).select("band", "same", "root", "at.*"), "placed")
    sets = sets_of(placed.select("same").distinct())
    links = placed.join(sets, "same").groupBy("band", "x", "y", "top_block").applyInArrow(block, "a long, b long")
    last = common.materialise(moves(links), "moved").select(F.col("root").alias("top"), F.col("top").alias("last"))
    over = over.join(last, "top", "left").select("root", F.coalesce("last", "top").alias("top"))
    return spread(roots, "root", "fp", over).select("fp", F.col("top").alias("root"))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""
    common.small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    schema = docs.withColumn(name, F.lit(0).cast("long")).schema

    def run(parts):
        for part in parts:
            fps = np.array([fingerprint(t, shingle, seed) for t in part.column(at).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def masks(bits: int, radius: int) -> dict[int, np.ndarray]:
    """Masks of the lowest bits with each number of set bits up to radius."""
    return {k: np.array([sum(1 << b for b in c) for c in combinations(range(bits), k)], "u8") for k in range(min(radius, bits) + 1)}


def cell_links(fps: np.ndarray, cell: int, cell_bits: int, half: int) -> np.ndarray:
    """Links (n x 2 fingerprints, a spanning forest) of the distinct fps that share a variant in the cell."""
    fps = np.unique(fps)
    low = 64 - cell_bits
    away = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(cell)).astype("i8")
    fps, left = fps[away <= half], half - away[away <= half]
    if len(fps) < 2:
        return np.empty((0, 2), "u8")
    root, links = np.arange(len(fps)), []
    per = max(1, sum(len(m) for m in masks(low, half).values()))
    split = max(0, int(np.ceil(np.log2(max(1, len(fps) * per / HELD_VARIANTS)))))
    split = max(0, min(split, low - 1))
    rest = masks(low - split, half)
    rest_low = np.uint64((1 << (low - split)) - 1)
    tail = fps & np.uint64((1 << low) - 1)
    for part in range(1 << split):  # variants whose next bits are part
        head = (tail >> np.uint64(low - split)) ^ np.uint64(part)
        far = np.bitwise_count(head).astype("i8")
        variants, owners = [], []
        for room in range(half + 1):  # changes that are left for the lowest bits
            who = np.flatnonzero(left - far == room)
            if len(who):
                own = np.concatenate([rest[k] for k in range(min(room, low - split) + 1)])
                variants.append(((tail[who] & rest_low)[:, None] ^ own[None, :]).ravel())
                owners.append(np.repeat(who, len(own)))
        if not variants:
            continue
        v, o = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        new = np.concatenate(([True], v[1:] != v[:-1]))
        first = o[np.flatnonzero(new)][np.cumsum(new) - 1]
        apart = ~new & (root[first] != root[o])  # links within a tree of the forest so far say nothing new
        first, o = first[apart], o[apart]
        near = np.bitwise_count(fps[first] ^ fps[o]) <= 2 * half
        _, one = np.unique(root[first[near]] * len(fps) + root[o[near]], return_index=True)
        for x, y in zip(first[near][one].tolist(), o[near][one].tolist(), strict=True):
            at, to = x, y
            while root[at] != at:
                at = int(root[at])
            while root[to] != to:
                to = int(root[to])
            if at != to:
                root[max(at, to)] = min(at, to)
                links.append((fps[x], fps[y]))
        while not np.array_equal(up := root[root], root):
            root = up
    return np.array(links, "u8").reshape(-1, 2)


def near_links(distinct: DataFrame, radius: int = 4, cell_bits: int | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, distinct, a written table) within radius of each other.

    cell_bits: top bits of the first cells, by default as many as leave a cell a quarter of HELD_FPS on average.
    """
    half = radius // 2
    if radius != 2 * half:
        raise ValueError("the radius must be even: each side takes half of it")
    if cell_bits is None:
        total = distinct.count()
        copies = lambda bits: sum(comb(bits, k) for k in range(half + 1))
        cell_bits = next((bits for bits in range(4, 40) if 4 * total * copies(bits) <= HELD_FPS << bits), 40)

    def inner(bits: int, more: int, parts, make):
        """For each row (a cell of bits bits, its fingerprints), the cells of more bits in it that they reach, as arrays."""
        spots, word = masks(more, half), np.uint64((1 << more) - 1)
        for part in parts:
            for cell, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                fps = np.frombuffer(data, "u8")
                away = np.bitwise_count((fps >> np.uint64(64 - bits)) ^ np.uint64(cell)).astype("i8") if bits else np.zeros(len(fps), "i8")
                cells, copies = [np.empty(0, "u8")], [np.empty(0, "u8")]
                for room in range(half + 1):  # changes that are left for the next bits
                    own = fps[away == half - room]
                    near = np.concatenate([spots[k] for k in range(min(room, more) + 1)])
                    cells.append((((own >> np.uint64(64 - bits - more)) & word)[:, None] ^ near[None, :]).ravel())
                    copies.append(np.repeat(own, len(near)))
                yield make(np.concatenate(cells) | np.uint64(cell << more), np.concatenate(copies))

    def emit(bits: int, more: int):
        def make(cells, copies):
            order = np.argsort(cells, kind="stable")
            cells, copies = cells[order], copies[order]
            cuts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.array([], int)
            ends = np.append(cuts[1:], len(cells))
            return pa.RecordBatch.from_arrays([pa.array(cells[cuts].astype("i8")), pa.array([copies[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["cell", "fps"])

        return lambda parts: inner(bits, more, parts, make)

    def count(bits: int, more: int):
        def make(cells, _):
            own, n = np.unique(cells, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own.astype("i8")), pa.array(n.astype("i8"))], names=["cell", "n"])

        return lambda parts: inner(bits, more, parts, make)

    def links(bits: int):
        def run(key, table):
            fps = np.frombuffer(b"".join(table.column("fps").to_pylist()), "u8")
            got = cell_links(fps, key[0].as_py(), bits, half).view("i8")
            common.trim()
            return pa.table({"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1])})

        return run

    def packed(parts):
        for part in parts:
            fps = part.column(0).to_numpy(zero_copy_only=False).view("u8")
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([fps.tobytes()], pa.binary())], names=["cell", "fps"])

    rows, bits, more, out = common.materialise(distinct.select("fp").mapInArrow(packed, "cell long, fps binary"), "packed"), 0, cell_bits, None
    while True:
        cells = rows.mapInArrow(emit(bits, more), "cell long, fps binary")
        counts = rows.mapInArrow(count(bits, more), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        bits += more
        full = common.materialise(counts.where(F.col("n") > HELD_FPS).select("cell"), "cells") if bits < 56 else None
        last = full is None or full.isEmpty()
        found = (cells if last else cells.join(full, "cell", "left_anti")).groupBy("cell").applyInArrow(links(bits), "a long, b long")
        out = found if out is None else out.union(found)
        if last:
            return out
        rows, more = common.materialise(cells.join(full, "cell", "left_semi"), "cells"), min(MORE_BITS, 60 - bits)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group) that connect what the links (a, b) connect."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) of the groups that links connect, each task's share as stars; a task holds HELD_LINKS of its links, and those that they left, at once."""

    def run(parts):
        a, b = np.empty(0, "i8"), np.empty(0, "i8")
        new, held = [], 0
        for part in parts:
            new.append([part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            held += part.num_rows
            if held >= HELD_LINKS:
                a, b = stars(*(np.concatenate((old, *more)) for old, more in zip((a, b), zip(*new, strict=True), strict=True)))
                new, held = [], 0
        if new:
            a, b = stars(*(np.concatenate((old, *more)) for old, more in zip((a, b), zip(*new, strict=True), strict=True)))
        for k in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) reach, for each node in a link.

    Each task first makes stars of its share of the links. Then rounds alternate linking each node's larger neighbours, then
    its smaller ones, to its smallest neighbour; the number of rounds grows with the logarithm of a component's size. Each half
    round is a table in the shared folder, so no plan names another twice over, and replaces the one before. A node's
    neighbours are dealt to parts, as the root of a large component has all of it around.
    """
    edge = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    each = lambda rows, *edges: rows.select(F.explode(F.array(*edges)).alias("e")).select("e.*").where("a <> b")
    a, b = F.col("a"), F.col("b")

    def with_least(around: DataFrame) -> DataFrame:
        """a, b and low: the smallest neighbour of a."""
        salted = around.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
        parts = salted.groupBy("a", "_salt").agg(F.min("b").alias("low"))
        low = parts.groupBy("a").agg(F.min("low").alias("low"))
        return salted.join(parts.drop("low").join(low, "a"), ["a", "_salt"]).drop("_salt")

    def is_forest(edges: DataFrame) -> bool:
        """Whether each node has one edge to its root, and no root has any."""
        ends = edges.select(F.explode(F.array(F.struct(a.alias("n"), F.lit(1).alias("out")), F.struct(b.alias("n"), F.lit(0).alias("out")))).alias("e")).select("e.*")
        return ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 OR out > least").isEmpty()

    links = common.materialise(links.where("a <> b"), "links")  # what makes them is Python too, and a stage with two such steps holds twice the workers
    edges = common.materialise(contracted(links).distinct(), "edges")
    common.discard(links)
    while not is_forest(edges):  # neither star would change one
        # large star: larger neighbours of each node go to the smallest of the node and its neighbours
        around = each(contracted(edges), edge(a, b), edge(b, a))
        large = common.materialise(with_least(around).where("b > a").select(b.alias("a"), F.least("a", "low").alias("b")).where("a <> b").distinct(), "edges")
        common.discard(edges)
        # small star: a node's smaller neighbours and the node itself go to the smallest of them
        edges = common.materialise(each(with_least(large), edge(b, F.col("low")), edge(a, F.col("low"))).distinct(), "edges")
        common.discard(large)
    return edges.select(a.alias("node"), b.alias("root")).union(edges.select("b", "b").distinct())


def fingerprint_roots(prints: DataFrame, radius: int, cell_bits: int | None, others: DataFrame | None = None) -> DataFrame:
    """fp, least (its smallest doc_id) and root (one fingerprint of its group) for each distinct fp of prints (doc_id, fp).
    others: further links of fingerprints."""
    salted = prints.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))  # a frequent fingerprint's rows are dealt to parts
    least = salted.groupBy("fp", "_salt").agg(F.min("doc_id").alias("least")).groupBy("fp").agg(F.min("least").alias("least"))
    least = common.materialise(least, "prints")
    links = near_links(least, radius, cell_bits)
    reach = components(links.union(others) if others is not None else links)
    return common.materialise(least.join(reach.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")


def groups(prints: DataFrame, radius: int = 4, cell_bits: int | None = None) -> DataFrame:
    """prints (doc_id, fp, others; a written table) with component_id, the smallest doc_id reachable through links of at most
    radius bits, and root, one fingerprint of the group."""
    roots = fingerprint_roots(prints, radius, cell_bits)
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    per_print = common.materialise(spread(roots.select("fp", "root"), "root", "fp", ids), "groups")
    return spread(prints, "fp", "doc_id", per_print)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprints(common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    found = groups(common.materialise(prints, "fps"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 4, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id (null only if it has no other). Rows are linked within the
    radius, or by shingle sets of at least the Jaccard similarity. Texts are not written between the steps."""
    common.small_batches(docs.sparkSession)
    own = [common.free_name(docs, f"_{k}") for k in KEY]
    values = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.xxhash64("text")
    keyed = docs.withColumns(dict(zip(own, values, strict=True)))
    texts = keyed.select(*(F.col(o).alias(k) for o, k in zip(own, KEY, strict=True)), "text")

    def sign(parts):
        for part in parts:
            fps, same, marks = [], [], []
            for text in part.column(len(KEY)).to_pylist():
                hashes = shingle_hashes(text, shingle)
                fps.append(print_of(hashes))
                found = np.unique(np.frombuffer(hashes, ">u8").astype("u8"))
                same.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                marks.append(bands(found) if len(found) else [])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(KEY)], pa.array(np.array(fps, "u8").view("i8")), pa.array(same, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=[*KEY, "fp", "same", "bands"])
        common.trim()

    signed = common.materialise(texts.mapInArrow(sign, "row_doc long, row_none boolean, row_key long, fp long, same binary, bands array<long>"), "signed")
    rows = common.materialise(signed.groupBy(*KEY, "fp").agg(F.count("*").alias("n")), "rows")
    equal = signed.where("same IS NOT NULL").select("same", "fp").distinct()
    equal = equal.join(equal.groupBy("same").agg(F.min("fp").alias("b")), "same").where("fp <> b").select(F.col("fp").alias("a"), "b")
    roots = fingerprint_roots(rows.select(F.col("row_doc").alias("doc_id"), "fp"), radius, None, equal).select("fp", "root")
    roots = common.materialise(similar_roots(texts, signed, roots, shingle, similarity), "roots")
    ranked = common.materialise(spread(rows, "fp", "row_key", roots).withColumn("me", F.struct("row_none", "row_doc", "row_key")), "rows")
    best = ranked.groupBy("root").agg(F.min("me").alias("best"))
    ranked = spread(ranked, "root", "row_key", best)
    dropped = common.materialise(ranked.where("me <> best").select(*KEY), "dropped")
    twice = common.materialise(ranked.where("me = best AND n > 1").select(*KEY), "twice")  # kept rows that are repeated
    kept = match(keyed, own, dropped, "left_anti")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    whole = F.struct(*(F.col(c) for c in docs.columns))
    once = match(kept, own, twice, "left_semi").groupBy(*own).agg(F.min_by(whole, F.xxhash64(*hashed)).alias("one")).select("one.*")
    return match(kept, own, twice, "left_anti").select(*docs.columns).union(once)
