import functools
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from framelake.llm import common, packing, token_store, tokens
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@functools.cache
def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def whole(path, text, end):
    t = tokenizer(path)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("source", ["odd", "table"])
def test_store_equals_whole_text_encoding(spark, odd_docs, source, tmp_path):
    docs = odd_docs if source == "odd" else common.documents(spark, SF)
    path = public_tokenizers.path("word_bpe_49k.json")
    token_store.write(docs, str(tmp_path), path, 2)
    got = token_store.read(spark, str(tmp_path), with_ids=True).collect()
    assert len(got) == docs.count()
    at = 0
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in sorted(got, key=lambda r: r.start):
        ids = whole(path, texts[r.doc_id][0], 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert np.array_equal(np.frombuffer(r.ids, "<u4"), ids)
        at += len(ids)
    ids = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_store_reads_one_document(spark, odd_docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_store.write(odd_docs.where("doc_id = 5"), str(tmp_path), path, 2)
    shard = spark.read.parquet(f"{tmp_path}/manifest").head().path
    text = odd_docs.where("doc_id = 5").head().text
    assert np.array_equal(token_store.read_document(str(tmp_path), shard, 0), whole(path, text, 2))


def test_store_of_nothing(spark, no_docs, tmp_path):
    token_store.write(no_docs, str(tmp_path), public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_store.read(spark, str(tmp_path)).count() == 0


def test_foreign_dictionary_is_refused(spark, odd_docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_store.write(odd_docs, str(tmp_path), path, 2)
    (tmp_path / "dictionary").write_bytes(b"x")
    with pytest.raises(Exception, match="not a shard of this dictionary"):
        token_store.read(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("source", ["odd", "table"])
def test_pieces_cover_every_id_once(spark, odd_docs, source):
    docs = odd_docs if source == "odd" else common.documents(spark, SF)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, 1).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    spans, sequences = {}, {}
    for r in got:
        ids = whole(path, texts[r.doc_id][0], 1)
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, own in texts.items():
        cover = sorted(i for s, n in spans[doc] for i in range(s, s + n))
        assert cover == sorted(list(range(len(whole(path, own[0], 1)))) * len(own))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and len(own) <= 256
        assert at & (at - 1) == 0  # nothing is padded


def test_packing_nothing(no_docs):
    assert packing.pack_documents(no_docs, public_tokenizers.path("byte_bpe_50k.json"), 1).count() == 0


def test_all_limits_hold_without_cutting():
    rng = np.random.default_rng(0)
    items = [packing.Piece(k, 0, int(n), int(rng.integers(0, n + 1))) for k, n in enumerate(rng.integers(1, 90, 400))]
    limits = packing.Limits(tokens=100, segments=4, loss=50)
    with pytest.raises(ValueError):
        packing.pack(items, limits, cut=False, last=True)
    items = [packing.Piece(x.item, 0, x.length, min(x.loss, 50)) for x in items]
    bins, rest = packing.pack(items, limits, cut=False, last=True)
    assert not rest and sorted(x.item for b in bins for x in b) == list(range(400))
    assert all(sum(x.length for x in b) <= 100 and len(b) <= 4 and sum(x.loss for x in b) <= 50 for b in bins)
    assert len(bins) < 1.25 * max(sum(x.length for x in items) / 100, sum(x.loss for x in items) / 50, 100)


def test_cutting_keeps_loss_at_the_end():
    limits = packing.Limits(tokens=64, segments=8, loss=32)
    bins, _ = packing.pack([packing.Piece(0, 0, 300, 250), packing.Piece(1, 0, 10, 0)], limits, cut=True, last=True)
    pieces = sorted((x.item, x.start, x.length, x.loss) for b in bins for x in b)
    assert sum(x[3] for x in pieces) == 250
    for item, start, length, loss in pieces:
        assert loss == (max(0, min(length, start + length - 50)) if item == 0 else 0)
    assert all(sum(x.length for x in b) <= 64 and sum(x.loss for x in b) <= 32 for b in bins)


def test_instruction_rows(spark):
    rows = [(k, "user: what is it? " * (k % 7), "it is a test " * (k % 11)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    got = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1, packing.Limits(128, 4, 40), prompt_col="prompt").collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.length for r in x) <= 128 and len(x) <= 4 and sum(r.loss_tokens for r in x) <= 40 for x in by.values())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name, monkeypatch):
    path = public_tokenizers.path(name)
    rng = np.random.default_rng(3)
    letters = [*"abcdefg  \n\n'st.,!#12 ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\u00a0", "\u2003", "\u200b", "\u0130", "\u00e9", "e\u0301", "\u4e2d", "\U0001f600", "don't", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 60, 3000)]
    texts += ["\n", "\n\n", "\n\nab", "ab\n\ncd", "ab\n", " ", "ab \ncd", "ab\n cd", "a\n\n\nb", None, "", "x" * 3000, "12 a " * 700]
    for size in (10_000_000, 500, 7):  # one batch, many batches, and texts cut in parts
        monkeypatch.setattr(tokens, "BATCH_CHARS", size)
        monkeypatch.setattr(tokens, "CACHE_PIECES", size)
        got = tokens.Encoder(path).encode(texts)
        for text, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer(path).encode(text or "", add_special_tokens=False).ids, repr(text)


def test_other_vocabularies_go_whole(tmp_path):
    stated = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    stated["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(stated), encoding="utf-8")
    encoder = tokens.Encoder(str(tmp_path / "other.json"))
    assert encoder.kind == "whole"
    assert np.frombuffer(encoder.encode(["ab cd\nef"])[0], "<u4").tolist() == tokenizer(str(tmp_path / "other.json")).encode("ab cd\nef", add_special_tokens=False).ids


def test_fetch_by_doc_id(spark, odd_docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_store.write(odd_docs.repartition(3), str(tmp_path), path, 2)
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for doc, own in texts.items():
        if doc is not None:
            got = token_store.fetch(spark, str(tmp_path), doc)
            assert sorted(x.tolist() for x in got) == sorted(whole(path, t, 2).tolist() for t in own)
    assert token_store.fetch(spark, str(tmp_path), 77) == []


def test_wide_ids(spark, odd_docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    with pytest.raises(ValueError):
        token_store.write(odd_docs, str(tmp_path / "a"), path, 70_000, wide=False)
    token_store.write(odd_docs.where("doc_id = 5"), str(tmp_path / "b"), path, 70_000)
    (ids,) = token_store.fetch(spark, str(tmp_path / "b"), 5)
    assert ids.tolist() == whole(path, odd_docs.where("doc_id = 5").head().text, 70_000).tolist()


@pytest.mark.parametrize("length", [3, 5, 7])
def test_short_items_leave_no_padding(length):
    bins, rest = packing.pack([packing.Piece(k, 0, length, length) for k in range(4000)], packing.Limits(), cut=True, last=True)
    sizes = [sum(x.length for x in b) for b in bins]
    assert not rest and sum(sizes) == 4000 * length
    assert all(n & (n - 1) == 0 and n <= 2048 for n in sizes) and max(len(b) for b in bins) <= 256


def test_choice_by_dot_product():
    """Against a plain loop that takes the best of all items each time."""
    rng = np.random.default_rng(5)
    limits = packing.Limits(tokens=60, segments=5, loss=40)
    items = [packing.Piece(k, 0, int(n), int(rng.integers(0, min(40, n) + 1))) for k, n in enumerate(rng.integers(1, 50, 150))]
    bins, _ = packing.pack(list(items), limits, cut=False, last=True)
    left = {x.item: x for x in items}
    for own in bins:
        free = [60, 5, 40]
        for x in own:
            fits = [y for y in left.values() if y.length <= free[0] and y.loss <= free[2]]
            value = lambda y: (y.length / 60) * (free[0] / 60) + free[1] / 25 + (y.loss / 40) * (free[2] / 40)  # noqa: E731, B023
            assert value(x) >= max(map(value, fits)) - 1e-9
            del left[x.item]
            free = [free[0] - x.length, free[1] - 1, free[2] - x.loss]
        assert not free[1] or not [y for y in left.values() if y.length <= free[0] and y.loss <= free[2]]
    assert not left


def test_conversations_bind_all_limits(spark):
    got = packing.pack_conversations(spark, SF).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    sums = [(sum(r.length for r in x), len(x), sum(r.loss_tokens for r in x)) for x in by.values()]
    assert sums and all(a <= 2048 and b <= 16 and c <= 1024 for a, b, c in sums)
    turns = {(r.conv_id, r.turn): r.role for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    pairs = {(c << 24) + t for (c, t), role in turns.items() if role == "user" and turns.get((c, t + 1)) == "assistant"}
    assert {r.doc_id for r in got} == pairs
